"""What must not grow faster than the input: plans without a row for each frame, batches that are handled in parts."""

import pytest
from pyspark.sql import functions as F

from colloquy.plans import registry


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_frame_errors_have_no_row_for_each_frame(spark, small):
    text = plan(registry.queries()["a22_frame_errors"](spark, small))
    assert "sequence(" not in text and "Join" not in text


def test_embed_ranges_read_each_activity_once(spark, small):
    """The activity of a window is made by one step and read by one, not anew for each of its frames."""
    text = plan(registry.queries()["e11_embed_ranges"](spark, small))
    assert text.count("MapInArrow") == 2 and "588" not in text and "Join" not in text


def test_windows_are_mapped_without_a_table_each(spark):
    from colloquy.operators import vectors as V

    items = spark.createDataFrame([("r", w, k, [float(k == i) + 0.1 * w for i in range(3)]) for w in range(3) for k in range(3)], "recording string, window int, local int, e array<double>")
    cents = spark.createDataFrame([("r", 10 + i, [float(i == (j + 1) % 3) for j in range(3)]) for i in range(3)], "recording string, speaker int, centroid array<double>")
    frame = V.map_windows(items, cents, "recording", "window", "local", "e")
    assert "FlatMapGroupsInPandas" not in plan(frame)
    assert {(r["window"], r["local"], r["speaker"]) for r in frame.collect()} == {(w, k, 10 + (k + 1) % 3) for w in range(3) for k in range(3)}


def test_turns_vote_once_and_speakers_are_found_in_one_pass(spark):
    """The votes are one step of the turns' plan; clusters, their folding and their centroids one pass over the jobs."""
    from colloquy.operators import diarize as D

    windows = spark.createDataFrame([("r", 0, [1] * 120)], "recording string, window int, activity array<int>")
    mapping = spark.createDataFrame([("r", 0, 0, 7)], "recording string, window int, local int, speaker int")
    lengths = spark.createDataFrame([("r", 10**6)], "recording string, samples bigint")
    assert plan(D.speaker_turns(D.speaker_runs(windows, mapping, lengths))).count("MapInArrow") == 1
    items = spark.createDataFrame([("r", 0, 0, 60, [1.0])], "recording string, window int, local int, clean int, e array<double>")
    text = plan(D.global_speakers(items))
    assert "FlatMapGroupsInPandas" not in text and text.count("MapInArrow") == 2


def test_der_mapping_has_no_table_for_each_meeting(spark, small):
    assert "FlatMapGroupsInPandas" not in plan(registry.queries()["j14_der_mapping"](spark, small))


def test_parts_of_batches_are_bounded():
    import numpy as np
    import pyarrow as pa

    from colloquy.functions.arrow import parts_of

    batch = pa.RecordBatch.from_arrays([pa.array(list(np.zeros((3000, 1000)))), pa.array(range(3000))], ["x", "k"])
    parts = list(parts_of([batch], 1 << 20))
    assert len(parts) > 20 and max(p.nbytes for p in parts) < 2 << 20 and pa.Table.from_batches(parts).column("k").to_pylist() == list(range(3000))


def test_loudness_does_not_join_samples(spark, small):
    """Both sides of the join are measured: no array of samples is in its rows."""
    frame = registry.queries()["m12_loudness"](spark, small)
    join = next(n for n in iter_nodes(frame._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join")
    assert "array<" not in join.schema().catalogString()


def iter_nodes(node):
    yield node
    children = node.children()
    for k in range(children.size()):
        yield from iter_nodes(children.apply(k))


@pytest.mark.parametrize("name", ["m9_m11_m12_m14_m16_signal", "m15_resample_chunks", "m18_split_at_silence", "u1_u4_model_hooks"])
def test_batches_of_arrays_and_texts_are_small(spark, small, name):
    """Python workers hold several times a batch: its bytes are bounded, whatever a row's size."""
    from colloquy.functions.arrow import PART_BYTES

    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(conf)
    assert registry.queries()[name](spark, small).columns
    assert int(spark.conf.get(conf)) == PART_BYTES


def test_postings_are_dealt_in_partitions_of_bounded_size(spark):
    """Partitions are split by their size, so that one bucket's sort doesn't grow with the table."""
    from colloquy.operators.search_index import postings_of

    rows = spark.range(3000).selectExpr("cast(id as string) id", "'the same words' transcript")
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        out = postings_of(rows.repartition(8), "id", "transcript")
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        assert out.count() == 3000 * 12 and out.columns == ["key", "gram", "bucket"]
        assert len(sizes) > 1
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_csv_files_are_listed_once(spark, tmp_path, monkeypatch):
    """A second listing is made only to name files without a text."""
    from colloquy.sources import transcripts as T

    real, asked = T._files, []
    monkeypatch.setattr(T, "_files", lambda *a: asked.append(a) or real(*a))
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("text\nsome words\n")
    assert T.read_csv(spark, str(tmp_path)).count() == 3 and not asked
    (tmp_path / "3.csv").write_text("text\n  \n")
    with pytest.raises(T.NoRows, match="3.csv"):
        T.read_csv(spark, str(tmp_path))
    assert len(asked) == 1
