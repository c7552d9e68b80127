"""Transcript files by hand: what is read, and errors that name the file."""

import json

import pytest

from colloquy.sources import transcripts as T


def put(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(folder)


def test_csv(spark, tmp_path):
    path = put(tmp_path, a_dot_csv='speaker,text\nx,"one two\nthree"\ny,   \nx,\nz,"say ""it"" é"\n', sub__b_dot_csv="speaker,text\nx,\t a b \n", note_dot_txt="text\nno\n")
    got = sorted((r["file"].rsplit("/", 1)[1], *r[1:]) for r in T.read_csv(spark, path).collect())
    assert got == [("a.csv", 0, "one two\nthree", 0, 1200), ("a.csv", 1, 'say "it" é', 1200, 2400), ("b.csv", 0, "a b", 0, 800)]


def test_csv_of_another_form_is_named(spark, tmp_path):
    path = put(tmp_path, a_dot_csv="speaker,text\nx,y\n", b_dot_csv="text\ny\n")
    with pytest.raises(Exception, match="[ab].csv"):
        T.read_csv(spark, path).collect()


def test_csv_in_order_of_the_file(spark, tmp_path):
    rows = [f"row {k}" for k in range(5000)]
    path = put(tmp_path, **{f"f{j}_dot_csv": "text\n" + "\n".join(rows[j:]) + "\n" for j in range(3)})
    got = T.read_csv(spark, path)
    for j in range(3):
        mine = [r["text"] for r in got.where(f"file like '%f{j}.csv'").orderBy("seq").collect()]
        assert mine == rows[j:]
    assert {(r["start_ms"], r["end_ms"]) for r in got.where("seq = 4").collect()} == {(3200, 4000)}


def test_csv_without_rows_or_column(spark, tmp_path):
    path = put(tmp_path / "a", good_dot_csv="text\nx\n", bad_dot_csv="text\n  \n\n", none_dot_csv="text\n")
    with pytest.raises(T.NoRows, match="bad.csv, .*none.csv"):
        T.read_csv(spark, path)
    with pytest.raises(ValueError, match="no column text"):
        T.read_csv(spark, put(tmp_path / "b", x_dot_csv="words\nx\n"))


def test_json(spark, tmp_path):
    file = {"version": "1.0", "total_segments": 2, "extra": 1, "segments": [{"id": "s0", "text": "hé\nllo", "audio_start_time": 0.0, "audio_end_time": 1.2345, "sequence_id": 0}, {"id": "s1", "text": None, "sequence_id": 1}]}
    path = put(tmp_path, one__transcripts_dot_json=json.dumps(file, indent=2), two__transcripts_dot_json='{"segments": []}')
    got = T.read_json(spark, path).orderBy("sequence_id").collect()
    assert [(r["id"], r["text"], r["start_ms"]) for r in got] == [("s0", "hé\nllo", 0), ("s1", None, None)] and abs(got[0]["end_ms"] - 1234.5) <= 0.5


@pytest.mark.parametrize("text, message", [("{nothing", "no transcript: .*broken"), ('{"version": "1.0"}', "no transcript: .*broken"), ("", "no transcript: .*broken"), ('{"total_segments": 3, "segments": []}', "another number .*broken")])
def test_broken_json_is_named(spark, tmp_path, text, message):
    path = put(tmp_path, good__t_dot_json='{"segments": []}', broken__t_dot_json=text or " ")
    with pytest.raises(Exception, match=message):
        T.read_json(spark, path).collect()


def test_rttm(spark, tmp_path):
    path = put(tmp_path, a_dot_rttm="; note\nSPEAKER f 1 1.5 0.25 <NA> <NA> bob <NA> <NA>\n\nSPKR-INFO f 1 <NA>\n  SPEAKER indented\nSPEAKER f 1 0.000\t2 <NA> <NA> amy\nSPEAKER f 1 9 1 <NA> <NA> bob x\n", b_dot_rttm="SPEAKER g 1 1 1 <NA> <NA> amy\n")
    got = sorted((r["file"][-6:], *r[1:]) for r in T.read_rttm(spark, path).collect())
    assert got == [("a.rttm", 0, "bob", 1500, 1750), ("a.rttm", 0, "bob", 9000, 10000), ("a.rttm", 1, "amy", 0, 2000), ("b.rttm", 0, "amy", 1000, 2000)]
    for bad in ("SPEAKER f 1 1.5 0.25", "SPEAKER f 1 x 1 <NA> <NA> bob"):
        with pytest.raises(Exception, match="broken SPEAKER line in .*bad.rttm"):
            T.read_rttm(spark, put(tmp_path / "bad", bad_dot_rttm=bad)).collect()
