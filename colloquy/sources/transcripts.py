"""Transcript files: CSV with a text column, JSON as the recorder writes it, and RTTM speaker turns.

Files are read by Spark's own readers, so any file system of the cluster will do, and named in errors. ``file`` is a row's
file as a URI.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.sources.tables import duration_ms

SEGMENT = "id string, text string, timestamp string, audio_start_time double, audio_end_time double, duration double, sequence_id bigint"
TRANSCRIPT = f"version string, last_updated string, total_segments bigint, segments array<struct<{SEGMENT.replace(' ', ':').replace(',:', ',')}>>"


class NoRows(ValueError):
    """Files without a row to read."""


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The files at a path, without what is in them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("file"))


def read_csv(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """(file, seq, text, start_ms, end_ms) of the CSV files at a path, one meeting each, with a header that has ``text``.

    Texts are trimmed, empty ones left out, the others numbered from 0 in the file's order. They follow one another: 0.4 s a
    word and half a second at least. No column ``text``, or a file without a row that is left, is an error, found before anything is
    returned; a file whose header is another than the first one's stops the query with its name. Quoted texts may hold line
    breaks.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    if text not in raw.columns:
        raise ValueError(f"no column {text} in {path}")
    # a file is read by one task from its beginning, so ids rise along it
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.regexp_replace(F.col(text), r"^\s+|\s+$", "").alias("text")).where("text != ''")
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    # files are listed once more only if some have no rows
    if rows.select("file").distinct().count() < len(raw._jdf.inputFiles()):
        empty = _files(spark, path, "*.csv").select(same("file").alias("name")).join(rows.select(same("file").alias("name")).distinct(), "name", "left_anti").orderBy("name").take(5)
        if empty:
            raise NoRows("no text is left in " + ", ".join(r["name"] for r in empty))
    order = Window.partitionBy("file").orderBy("line")
    timed = rows.withColumn("d", duration_ms(F.col("text")))
    end = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return timed.select("file", (F.row_number().over(order) - 1).cast("bigint").alias("seq"), "text", (end - F.col("d")).alias("start_ms"), end.alias("end_ms"))


def write_json(segments: DataFrame, path: str, last_updated: str) -> None:
    """A ``transcripts.json`` file for each meeting of (meeting_id, seq, id, transcript, start_ms, end_ms), under a folder
    ``meeting_id=<id>``, with segments numbered from 0 by ``seq``. A meeting's segments are one row: a file is read whole."""
    seconds = lambda c: (c / 1000).cast("double")
    one = F.struct("seq", F.struct("id", F.col("transcript").alias("text"), F.lit(last_updated).alias("timestamp"), seconds(F.col("start_ms")).alias("audio_start_time"), seconds(F.col("end_ms")).alias("audio_end_time"), seconds(F.col("end_ms") - F.col("start_ms")).alias("duration")).alias("s"))
    meetings = segments.groupBy("meeting_id").agg(F.sort_array(F.collect_list(one)).alias("rows"))
    numbered = F.transform("rows", lambda x, k: x["s"].withField("sequence_id", k.cast("bigint")))
    file = F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit(last_updated).alias("last_updated"), F.size("rows").alias("total_segments"), numbered.alias("segments")), {"pretty": "true"})
    meetings.select("meeting_id", file.alias("value")).repartition("meeting_id").write.partitionBy("meeting_id").text(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, sequence_id, id, text, start_ms, end_ms) of all segments of the transcript files at a path.

    A file that is no such JSON, or has another number of segments than it says, stops the query with its name. Fields that
    a segment lacks are null. A file without segments has no rows.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", TRANSCRIPT).alias("t"))
    broken = F.col("t").isNull() | F.col("t.segments").isNull()
    count = F.coalesce(F.col("t.total_segments"), F.size("t.segments").cast("bigint"))
    segments = F.when(broken, F.raise_error(F.concat(F.lit("no transcript: "), "file"))).when(count != F.size("t.segments"), F.raise_error(F.concat(F.lit("another number of segments than it says: "), "file"))).otherwise(F.col("t.segments"))
    millis = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return raw.select("file", F.explode(segments).alias("s")).select("file", "s.*").select("file", "sequence_id", "id", "text", millis("audio_start_time").alias("start_ms"), millis("audio_end_time").alias("end_ms"))


def write_rttm(turns: DataFrame, path: str) -> None:
    """RTTM files of (meeting_id, speaker_key, start_ms, end_ms), in folders ``meeting_id=<id>``, by start and end."""
    seconds = lambda c: F.format_string("%.3f", c / 1000)
    line = F.format_string("SPEAKER %s 1 %s %s <NA> <NA> %s <NA> <NA>", F.col("meeting_id"), seconds(F.col("start_ms")), seconds(F.col("end_ms") - F.col("start_ms")), F.col("speaker_key"))
    turns.repartition("meeting_id").sortWithinPartitions("meeting_id", "start_ms", "end_ms", "speaker_key").select("meeting_id", line.alias("value")).write.partitionBy("meeting_id").text(path)


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """(file, speaker, name, start_ms, end_ms) of the SPEAKER lines at a path; other lines are left out.

    The speakers of a file are numbered from 0 by their first line. A SPEAKER line with fewer than eight fields, or without
    numbers for its onset and duration, stops the query with the file's name. Large files are read by several tasks.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"))
    fields = lines.where(F.col("value").startswith("SPEAKER")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    number = lambda k: F.expr(f"try_cast(get(f, {k}) as double)")
    wrong = (F.size("f") < 8) | number(3).isNull() | number(4).isNull()
    millis = lambda x: F.round(x * 1000).cast("bigint")
    turns = fields.select("file", "line", F.when(wrong, F.raise_error(F.concat(F.lit("a broken SPEAKER line in "), "file"))).otherwise(F.get("f", F.lit(7))).alias("name"), millis(number(3)).alias("start_ms"), millis(number(3) + number(4)).alias("end_ms"))
    first = turns.groupBy("file", "name").agg(F.min("line").alias("line"))
    numbered = first.select("file", "name", (F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1).cast("int").alias("speaker"))
    return turns.join(numbered, ["file", "name"]).select("file", "speaker", "name", "start_ms", "end_ms")
