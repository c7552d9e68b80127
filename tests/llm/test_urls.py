"""URL rules and mined rules against plain loops over all combinations."""

import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from colloquy.llm import urls
from colloquy.llm._scratch import Scratch
from colloquy.llm.queries import URL_RULES

ODD = [None, "", "no scheme", "://", "http://", "HTTP://COM/", "http://com", "http://com/", "https://a.com/x", "https://acom/x", "https://www.example.com/en/1", "https://WWW.Example.COM/en/1", "https://www.example.com/en", "https://x.www.example.com/en/", "https://m.example.com/en/", "http://a.net/es/1?x=http://b.com/", "http://a.net/EN/es/", "http://net/fr/#a", "http://a.net?/es/", "http://a.net#/es/", "http://É.net/es/\n/b", "http://user@a.com:80/x", "x://y://com/", "http://a.com//", "https://a.b.c.d/e/f12/g3.HTML?b=1&a=2&b&=3&&c#?z=1"]


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "page_id bigint, url string")


def rows_of(spark, values):
    url = F.col("url")
    parsed = frame(spark, values).withColumns({"host": urls.host_of(url), "path": urls.path_of(url)})
    return parsed.withColumn("tokens", urls.tokens_of(url, F.col("host"), F.col("path")))


def test_hosts_paths_and_rules(spark):
    got = {r["page_id"]: r for r in urls.judge(frame(spark, ODD), URL_RULES).collect()}
    for k, url in enumerate(ODD):
        host, path = split(url)
        verdict, rule = rule_of(host, path, URL_RULES)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), url
        assert got[k]["verdict"] == verdict if rule else got[k]["verdict"] in ("allow", "block")


def test_longest_rule_wins(spark):
    rng = random.Random(3)
    labels = ["a", "b", "aa"]
    rules = [(rng.choice(["allow", "block"]), ".".join(rng.choices(labels, k=rng.randint(1, 3))), "/" + "".join(rng.choices("xy/", k=rng.randint(0, 3)))) for _ in range(60)]
    rules = list({r[1] + "|" + r[2]: r for r in rules}.values())
    values = [f"s://{'.'.join(rng.choices(labels, k=rng.randint(1, 4)))}/{''.join(rng.choices('xy/', k=4))}" for _ in range(200)]
    got = urls.judge(frame(spark, values), rules).collect()
    assert len(got) == 200
    for r in got:
        fits = [h + p for _, h, p in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert (r["rule"] is None) == (not fits) and (not fits or len(r["rule"]) == max(map(len, fits)))
    with pytest.raises(ValueError):
        urls.fitting_rule(F.col("a"), F.col("b"), [("allow", f"h{k}", "/") for k in range(1001)])


def test_tokens(spark):
    got = {r["url"]: r["tokens"] for r in rows_of(spark, ODD).collect()}
    assert got[ODD[-1]] == ["host:a.b.c.d", "site:c.d", "top:d", "sub:a", "first:e", "second:f#", "ending:.HTML", "parts:3", "query:a&b&c"]
    assert got[None] == got[""] == got["no scheme"] == ["parts:0"]
    assert all(len(set(t)) == len(t) <= 9 for t in got.values())


def mined_by_hand(rows, support, confidence):
    """{(tokens, label): (hits, seen)} from all combinations of each row's tokens."""
    rows = [(t, v) for t, v in rows if v is not None]
    seen, hits = Counter(), Counter()
    for tokens, label in rows:
        for size in range(1, len(tokens) + 1):
            for c in itertools.combinations(sorted(tokens), size):
                seen[c] += 1
                hits[c, label] += 1
    least = -(-Fraction(str(support)) * len(rows) // 1)
    return {k: (n, seen[k[0]]) for k, n in hits.items() if n >= least and n / seen[k[0]] >= confidence}


@pytest.mark.parametrize("support, confidence", [(0.02, 0.8), (0.1, 0.55), (0.5, 0.5)])
def test_mined_rules_and_index(spark, support, confidence):
    rng = random.Random(int(support * 100))
    draw = lambda: sorted({f"{place}:{rng.choice('abcd'[: place + 2])}" for place in range(3) for _ in range(rng.randint(0, 2))})[:6]
    rows = [(t, rng.choice(["allow", "block" if "0:a" in t else "allow", "block" if "2:b" in t else None])) for t in (draw() for _ in range(150))]
    rows += [(["0:a", "1:b", "9:hot"], "block")] * 80
    labelled = spark.createDataFrame(rows, "tokens array<string>, label string")
    mined = urls.mine(labelled, Scratch(spark, "urls"), support, confidence)
    want = mined_by_hand(rows, support, confidence)
    got = mined.collect()
    assert {(tuple(r["tokens"]), r["label"]): (r["hits"], r["seen"]) for r in got} == want and len(got) == len(want)
    freq = Counter(x for t, v in rows if v is not None for x in t)
    assert all(r["posted"] == min(r["tokens"], key=lambda x: (freq[x], x)) for r in got)
    others = [draw() for _ in range(60)] + [[], ["none"], ["0:a", "1:b", "9:hot"]]
    best = {tuple(r["tokens"]): r["label"] for r in urls.surest(spark.createDataFrame([(t,) for t in others], "tokens array<string>").distinct(), mined).collect()}
    for t in others:
        fits = [(-n / s, -n, len(c), c, v) for (c, v), (n, s) in want.items() if set(c) <= set(t)]
        assert best.get(tuple(t)) == (min(fits)[4] if fits else None)


def test_verdicts_of_open_urls(spark):
    """Labels from the rules carry over to other hosts by what the URLs have in common."""
    values = [f"http://s{k % 7}.shop.net/es/{k}" for k in range(60)] + [f"http://s{k % 7}.com/de/{k}.html" for k in range(60)]
    values += ["http://other.org/es/5", "http://s3.shop.org/de/9.html", "http://q.io"]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(frame(spark, values), URL_RULES).collect()}
    assert (got[120], got[121]) == ("block", "allow") and got[122] == "allow"
    told = spark.createDataFrame([("http://x.org/es/1", "allow"), ("http://y.org/de/1.html", "block"), (None, "block"), ("http://z", None)], "url string, label string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(frame(spark, values), URL_RULES, labels=told, min_support=0.3).collect()}
    assert (got[0], got[60], got[120], got[121]) == ("block", "allow", "allow", "block")


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(None, "http://a.com/x"), (1, None), (1, None), (2, "http://a.org/" + "y" * 200_000), (2, "http://a.org/" + "y" * 200_000), (3, "http://b.net/es/")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 as host", "2 as path", "3 as fit", "4 as tokens", "5 as label", "6 as verdict", "7 as rule")
    got = urls.judge(df, URL_RULES).collect()
    assert sorted(str(r["page_id"]) for r in got) == ["1", "1", "2", "2", "3", "None"] and all(r["verdict"] for r in got)
    assert urls.judge(frame(spark, []), URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(frame(spark, ["http://a.org/"]), URL_RULES).collect()} == {"allow"}
