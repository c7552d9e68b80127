"""The pipeline's stages one by one, against brute force."""

import corpus_pipeline
import pytest
from test_llm import linked


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = {r["doc_id"]: r for r in docs.collect()}
        if number < 3:
            assert docs.columns == columns and set(rows) <= set(before)
        if name == "language_id":
            assert len(rows) >= 0.95 * len(before)
        if name == "ngram_jaccard_join":
            ids = sorted(before)
            groups = linked([before[i]["text"] for i in ids], 5, 80)
            assert set(rows) == {ids[k] for k, (_, top) in groups.items() if top == k}
        if name == "substring_dedup":
            assert set(rows) == set(before) and all(len(rows[i]["text"]) == rows[i]["n_chars"] for i in rows)
        if name == "best_fit_packing":
            assert set(rows) == set(before)


def test_odd_rows(spark, small, tmp_path):
    import shutil

    shutil.copytree(small, tmp_path / "in")
    rows = [(None, "the and of that", "en", "s", 3), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "123", "xx", "s", 3)]
    odd = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    kept = corpus_pipeline.identify_language(spark, odd, small)
    assert [r["doc_id"] for r in kept.collect()] == [None]
    assert corpus_pipeline.drop_near_copies(spark, odd, small).count() == 4
    assert corpus_pipeline.drop_repeated_passages(spark, odd, small).count() == 4
    assert pytest.approx(corpus_pipeline.pack_sequences(spark, odd, small).count()) == 4
