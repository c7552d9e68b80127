"""A recording's segments as one text: SRT, WEBVTT, plain lines, and JSON short or with times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import srt_time


def captions(segments: DataFrame, key: str = "meeting_id", order: str = "seq", text: str = "transcript", speaker: str | None = None, language: str = "en", offset: int = 0) -> DataFrame:
    """(key, srt, vtt, plain, json, verbose_json) of each recording's segments (key, order, text, start_ms, end_ms).

    Cues are numbered from 1 + ``offset`` in SRT and name the ``speaker``, if there is one, in front of the text, in WEBVTT
    as a voice. Segments of one order follow by their start. A null text is empty. A recording's segments, one file when
    they are written, are put together in one row.
    """
    who = F.col(speaker) if speaker else F.lit(None).cast("string")
    one = F.struct(F.col(order).alias("o"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.coalesce(text, F.lit("")).alias("t"), who.alias("w"))
    rows = segments.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("r"))
    span = lambda x, mark: F.concat(srt_time(x["s"], mark), F.lit(" --> "), srt_time(x["e"], mark), F.lit("\n"))
    said = lambda x: F.concat(F.coalesce(F.concat(x["w"], F.lit(": ")), F.lit("")), x["t"])
    voiced = lambda x: F.concat(F.coalesce(F.concat(F.lit("<v "), x["w"], F.lit(">")), F.lit("")), x["t"])
    joined = lambda f: F.array_join(F.transform("r", f), "")
    plain = joined(lambda x: F.concat(said(x), F.lit("\n")))
    seconds = lambda ms: (ms / 1000).cast("double")
    timed = F.transform("r", lambda x, i: F.struct(i.cast("bigint").alias("id"), x["t"].alias("text"), seconds(x["s"]).alias("start"), seconds(x["e"]).alias("end")))
    length = seconds(F.array_max(F.transform("r", lambda x: x["e"])))
    return rows.select(
        key,
        joined(lambda x, i: F.concat((i + 1 + offset).cast("string"), F.lit("\n"), span(x, ","), said(x), F.lit("\n\n"))).alias("srt"),
        F.concat(F.lit("WEBVTT\n\n"), joined(lambda x: F.concat(span(x, "."), voiced(x), F.lit("\n\n")))).alias("vtt"),
        plain.alias("plain"),
        F.to_json(F.struct(plain.alias("text"))).alias("json"),
        F.to_json(F.struct(F.lit("transcribe").alias("task"), F.lit(language).alias("language"), length.alias("duration"), plain.alias("text"), timed.alias("segments"))).alias("verbose_json"),
    )
