"""License scans against a plain alignment of every template with every whole text."""

import re

import pytest

from colloquy.llm import licenses

MIT, BODY, APACHE = (licenses.TEMPLATES[k] for k in ("MIT", "MIT-text", "Apache-2.0"))


def words_of(text):
    return [(m.group().translate({c: c + 32 for c in range(65, 91)}), m.start(), m.end()) for m in re.finditer(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text or "")]


def best_run(template, words):
    """The most template words that the text has in the same order within as many words and a band."""
    most = 0
    for start in range(-licenses.BAND, len(words)):
        part = [w for w, _, _ in words[max(0, start) : max(0, start + len(template) + licenses.BAND)]]
        row = [0] * (len(part) + 1)
        for t in template:
            last = row
            row = [0] * (len(part) + 1)
            for j, w in enumerate(part):
                row[j + 1] = last[j] + 1 if t == w else max(last[j + 1], row[j])
        most = max(most, row[-1])
    return most


TEXTS = [
    None,
    "",
    " \n ",
    "the mit license",
    f"é 日本 {MIT}\nmore",
    f"{MIT} and {APACHE} x {MIT}",
    MIT.upper(),
    "Released under the new MIT License.",
    "Licensed under CC BY-NC 4.0.",
    "Licensed under CC BY-SA 4.0",
    BODY,
    "word " * 400 + BODY.replace("modify", "alter").replace("free of charge", "free of any charge") + " word" * 400,
    " ".join(BODY.split()[: len(BODY.split()) // 2]),
    "This work is licensed under the GNU General Public License, version 3.",
    "under the " * 500,
]


def scanned(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'x' as license_id", "1 as start", "2 as coverage").repartition(3)
    out = {i: [] for i in range(len(texts))}
    for r in sorted(licenses.scan(df, **more).collect(), key=lambda r: (r["doc_id"], r["start"])):
        out[r["doc_id"]].append(r)
    return out


def test_planted(spark):
    got = scanned(spark, TEXTS)
    names = [[r["license_id"] for r in got[i]] for i in range(len(TEXTS))]
    assert names == [[], [], [], [], ["MIT"], ["MIT", "Apache-2.0", "MIT"], ["MIT"], ["MIT"], ["CC-BY-NC-4.0"], ["CC-BY-SA-4.0"], ["MIT-text"], ["MIT-text"], [], ["GPL-3.0"], []]
    for i, text in enumerate(TEXTS):
        for r in got[i]:
            template = [w for w, _, _ in words_of(licenses.TEMPLATES[r["license_id"]])]
            found = [w for s in r["spans"] for w, _, _ in words_of(text[s["start"] : s["end"]])]
            at = iter(template)
            assert all(w in at for w in found) and len(found) == r["n_matched"] and r["coverage"] == pytest.approx(len(found) / len(template))
            assert (r["start"], r["end"]) == (r["spans"][0]["start"], r["spans"][-1]["end"])
    assert TEXTS[4][got[4][0]["start"] : got[4][0]["end"]] == "Released under the MIT License"
    assert [len(got[i][0]["spans"]) for i in (10, 7)] == [1, 2]


def test_against_brute_force(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").where("text rlike '(?i)licen|the of|under'").orderBy("doc_id").limit(25).collect()] + TEXTS
    texts = [(t or "")[-1500:] for t in texts]
    short = {k: v for k, v in licenses.TEMPLATES.items() if k in ("MIT", "Apache-2.0", "GPL-3.0", "MPL-2.0")}
    for name, template in short.items():
        words = [w for w, _, _ in words_of(template)]
        got = scanned(spark, texts, templates={name: template})
        for i, t in enumerate(texts):
            assert bool(got[i]) == (best_run(words, words_of(t)) >= 0.8 * len(words)), (name, t[-200:])


def test_edges(spark):
    df = spark.createDataFrame([(None, MIT), (1, MIT), (1, MIT)], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["license_id"]) for r in licenses.scan(df).collect()) == [(0, "MIT"), (1, "MIT"), (1, "MIT")]
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df, {}).count() == 0
    assert [r["license_id"] for r in licenses.scan(df.limit(1), {"none": "...", "one": "MIT"}).collect()] == ["one"]
    with pytest.raises(ValueError):
        licenses.Index({"huge": "x" * (licenses.MOST_TEMPLATE_BYTES + 1)})


def unbanded(template, words):
    """The template words that the text has in the same order, wherever they stand."""
    row = [0] * (len(words) + 1)
    for t in template:
        last, row = row, [0] * (len(words) + 1)
        for j, w in enumerate(words):
            row[j + 1] = last[j] + 1 if t == w else max(last[j + 1], row[j])
    return row[-1]


def test_words_put_in_or_left_out(spark):
    w = BODY.split()
    strange = lambda n: " ".join(f"q{i}" for i in range(n))
    half = len(w) // 2
    texts = [" ".join([*w[:half], strange(n), *w[half:]]) for n in (13, 40, 3000)]
    texts += [" ".join(w[:k] + w[k + 14 :]) for k in (10, 40)] + [" ".join(w[:k] + w[k + 24 :]) for k in (10, 40)]
    texts += [" ".join([*w[:20], strange(15), *w[20:45], strange(20), *w[45:60], strange(9), *w[60:]]), f"{texts[0]} {strange(30)} {texts[3]} {BODY}", f"{BODY} {strange(500)} " + " ".join(w[:half])]
    got = scanned(spark, texts, templates={"MIT-text": BODY})
    template = [x for x, _, _ in words_of(BODY)]
    for i, text in enumerate(texts):
        most = unbanded(template, [x for x, _, _ in words_of(text)])
        assert bool(got[i]) == (most >= 0.8 * len(template)), (i, most)
        if i not in (8, 9) and got[i]:
            assert [r["n_matched"] for r in got[i]] == [most], i
        for r in got[i]:
            found = iter(template)
            assert all(x in found for s in r["spans"] for x, _, _ in words_of(text[s["start"] : s["end"]]))
    assert [len(got[i]) for i in (8, 9)] == [3, 1]
    # another license inside what was put in is found too
    both = scanned(spark, [" ".join([*w[:half], strange(300), APACHE, strange(300), *w[half:]])])
    assert [r["license_id"] for r in both[0]] == ["MIT-text", "Apache-2.0"]
