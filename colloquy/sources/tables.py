"""The meeting data model over the stored tables: meetings, transcript segments and speaker turns.

Times are whole milliseconds, so sums and comparisons are exact; seconds are derived at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """Blank-separated words, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def duration_ms(text: Column) -> Column:
    """Estimated speech: 0.4 s a word, half a second at least."""
    return F.greatest(F.size(words(text)).cast("long") * 400, F.lit(500).cast("long"))


def segments(rows: DataFrame, meeting: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Transcript segments with times that follow from the texts' lengths, one after the other in each meeting.

    Rows whose trimmed text is empty are dropped. Columns: id, meeting_id, seq, speaker, transcript, start_ms, end_ms.
    """
    kept = rows.select(F.col(meeting).alias("m"), F.col(order).alias("seq"), F.col(speaker).alias("speaker"), F.trim(F.col(text)).alias("transcript")).where("transcript != ''").withColumn("d", duration_ms(F.col("transcript")))
    before = Window.partitionBy("m").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    timed = kept.withColumn("start_ms", F.coalesce(F.sum("d").over(before), F.lit(0)))
    return timed.select(F.concat(F.lit("transcript-"), "m", F.lit("-"), "seq").alias("id"), F.concat(F.lit("meeting-"), "m").alias("meeting_id"), "seq", "speaker", "transcript", "start_ms", (F.col("start_ms") + F.col("d")).alias("end_ms"))


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return segments(load(spark, folder, "conversations"))


def meetings(spark: SparkSession, folder: str) -> DataFrame:
    """id, title, created_s (seconds since the epoch), folder_path (null for every third)."""
    ids = load(spark, folder, "conversations").select("conv_id").distinct()
    created = F.unix_timestamp(F.lit(EPOCH)) + F.col("conv_id") * 60
    return ids.select(F.concat(F.lit("meeting-"), "conv_id").alias("id"), F.concat(F.lit("conv-"), "conv_id").alias("title"), created.alias("created_s"), F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("/rec/"), "conv_id")).alias("folder_path"))


def role_key(speaker: Column) -> Column:
    return F.when(speaker == "user", "S1").when(speaker == "assistant", "S2").otherwise("S3")


def raw_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Speaker turns: the segments, late by 0.3 s or early by 0.2 s."""
    shift = F.when(F.col("seq") % 2 == 0, 300).otherwise(-200)
    return transcripts(spark, folder).select("meeting_id", role_key(F.col("speaker")).alias("speaker_key"), (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"))


#: The same in SQL, as common table expressions.
SEG = r"""
seg0 as (select conv_id m, turn seq, role speaker, trim(text) transcript from conversations where trim(text) <> ''),
seg1 as (select *, greatest(len(list_filter(string_split_regex(transcript, '\s+'), lambda x: x <> ''))::bigint * 400, 500) d from seg0),
seg as (select 'transcript-' || m || '-' || seq id, 'meeting-' || m meeting_id, seq, speaker, transcript,
        coalesce(sum(d) over (partition by m order by seq rows between unbounded preceding and 1 preceding), 0)::bigint start_ms,
        (sum(d) over (partition by m order by seq rows between unbounded preceding and current row))::bigint end_ms from seg1)"""
MEET = """
meet as (select 'meeting-' || conv_id id, 'conv-' || conv_id title, 1704067200 + conv_id * 60 created_s,
         case when conv_id % 3 <> 0 then '/rec/' || conv_id end folder_path from (select distinct conv_id from conversations))"""
RAW = """
raw as (select meeting_id, case speaker when 'user' then 'S1' when 'assistant' then 'S2' else 'S3' end speaker_key,
        start_ms + case when seq % 2 = 0 then 300 else -200 end start_ms,
        end_ms + case when seq % 2 = 0 then 300 else -200 end end_ms from seg)"""
TURNS = """
isl0 as (select *, max(end_ms) over (partition by meeting_id, speaker_key order by start_ms, end_ms rows between unbounded preceding and 1 preceding) before_ms from raw),
isl1 as (select *, sum(case when before_ms is null or start_ms - before_ms >= 500 then 1 else 0 end) over (partition by meeting_id, speaker_key order by start_ms, end_ms rows between unbounded preceding and current row) island from isl0),
turns as (select meeting_id, speaker_key, min(start_ms) start_ms, max(end_ms) end_ms from isl1 group by meeting_id, speaker_key, island having max(end_ms) - min(start_ms) > 100)"""
