"""Caption files by hand."""

import json

from colloquy.functions.captions import captions


def test_forms(spark):
    rows = [("m", 1, "two\nlines", 61_001, 3_723_004, None), ("m", 0, "one", 0, 1500, "Ann"), ("e", 0, None, 0, 0, None)]
    table = spark.createDataFrame(rows, "meeting_id string, seq int, transcript string, start_ms bigint, end_ms bigint, who string")
    got = {r["meeting_id"]: r for r in captions(table, speaker="who", offset=4).collect()}
    m = got["m"]
    assert m["srt"] == "5\n00:00:00,000 --> 00:00:01,500\nAnn: one\n\n6\n00:01:01,001 --> 01:02:03,004\ntwo\nlines\n\n"
    assert m["vtt"] == "WEBVTT\n\n00:00:00.000 --> 00:00:01.500\n<v Ann>one\n\n00:01:01.001 --> 01:02:03.004\ntwo\nlines\n\n"
    assert m["plain"] == "Ann: one\ntwo\nlines\n" and json.loads(m["json"]) == {"text": m["plain"]}
    assert json.loads(m["verbose_json"]) == {"task": "transcribe", "language": "en", "duration": 3723.004, "text": m["plain"], "segments": [{"id": 0, "text": "one", "start": 0.0, "end": 1.5}, {"id": 1, "text": "two\nlines", "start": 61.001, "end": 3723.004}]}
    assert got["e"]["srt"] == "5\n00:00:00,000 --> 00:00:00,000\n\n\n" and captions(table.limit(0)).count() == 0
