"""Transcript files written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colloquy.operators.search_index import Index
from colloquy.plans.intervals import ALL, turns
from colloquy.plans.registry import query
from colloquy.sources import transcripts as T
from colloquy.sources.files import shared_dir
from colloquy.sources.tables import SEG, load, transcripts


def folder(spark, kind):
    return f"{shared_dir(spark)}/colloquy/{kind}-{uuid.uuid4().hex[:12]}"


def meeting_of(file):
    return F.regexp_extract(file, "meeting_id=([^/]+)/", 1)


@query("s3_csv_files", f"with {SEG} select meeting_id, row_number() over (partition by meeting_id order by seq) - 1 seq, transcript \"text\", start_ms, end_ms from seg")
def s3(spark, d):
    """A CSV file for each conversation, its texts between blanks; times follow from the texts."""
    path = folder(spark, "csv")
    rows = load(spark, d, "conversations").select(F.concat(F.lit("meeting-"), "conv_id").alias("meeting_id"), "turn", F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"), "role")
    rows.repartition("meeting_id").sortWithinPartitions("meeting_id", "turn").select("meeting_id", "role", "text").write.partitionBy("meeting_id").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return T.read_csv(spark, path).select(meeting_of("file").alias("meeting_id"), "seq", "text", "start_ms", "end_ms")


@query("s4_json_files", f"with {SEG} select meeting_id, row_number() over (partition by meeting_id order by seq) - 1 sequence_id, id, transcript \"text\", start_ms, end_ms from seg")
def s4(spark, d):
    """A transcript file for each meeting, read back."""
    path = folder(spark, "json")
    T.write_json(transcripts(spark, d), path, "2024-01-01T00:00:00Z")
    return T.read_json(spark, path).select(meeting_of("file").alias("meeting_id"), "sequence_id", "id", "text", "start_ms", "end_ms")


@query("s9_rttm_files", f"{ALL}, o as (select *, row_number() over (partition by meeting_id order by start_ms, end_ms, speaker_key) r from turns), f as (select meeting_id, speaker_key, row_number() over (partition by meeting_id order by min(r)) - 1 speaker from o group by 1, 2) select meeting_id, speaker::int speaker, speaker_key \"name\", start_ms, end_ms from turns join f using (meeting_id, speaker_key)")
def s9(spark, d):
    """Speaker turns as RTTM files, read back, with speakers numbered by their first line."""
    path = folder(spark, "rttm")
    T.write_rttm(turns(spark, d), path)
    return T.read_rttm(spark, path).select(meeting_of("file").alias("meeting_id"), "speaker", "name", "start_ms", "end_ms")


SEARCHES = ["Then", "th_n%tion", "nt the", "%an", "%", "é", "_he"]


@query("j1_p2_indexed_search", f"with {SEG}, q as (select unnest({SEARCHES!r}) q) select q query, meeting_id, id from seg, q where lower(transcript) like '%' || lower(q) || '%'")
def j1(spark, d):
    """Searches over an index of the transcripts, wildcards included."""
    t = transcripts(spark, d).select("meeting_id", "id", "transcript")
    index = Index.build(t, folder(spark, "grams"))
    out = None
    for q in SEARCHES:
        found = index.find(t, q).select(F.lit(q).alias("query"), "meeting_id", "id")
        out = found if out is None else out.unionByName(found)
    return out
