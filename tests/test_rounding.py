"""Rounding and upper case as the SQL twins have them."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import audio as A
from colloquy.functions import text as X
from colloquy.plans import registry


def test_halves(spark):
    rng = np.random.default_rng(5)
    values = [0.285, 1.005, -2.675, 0.0000005, -0.0000004, 1e300, 0.4999995, 0.0, *(np.round(rng.normal(size=400), 6) + 5e-7).tolist(), *(np.float32(rng.normal(size=200)) * 5.0).astype(float).tolist()]
    got = [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "x double").select(A.rounded(F.col("x"), 6), A.rounded(F.col("x"), 2)).collect()]
    want = duckdb.execute("select round(x, 6), round(x, 2) from (select unnest($1::double[]) x)", [values]).fetchall()
    assert list(map(str, got)) == list(map(str, want))


@pytest.mark.parametrize("name, table", [("m6_j12_mix", "embeddings"), ("m7_duck", "embeddings"), ("m8_dynamic_mix", "embeddings"), ("m10_peak_normalise", "embeddings"), ("e2_unit", "embeddings"), ("k15_checkpoints", "events")])
def test_queries_round_like_their_sql(spark, tmp_path, name, table):
    """Negative numbers that round to nothing, which SQL engines give as -0.0, and halves of both kinds."""
    if table == "events":
        made = "select k::bigint event_id, timestamp '2024-01-01' + k * interval 1 second ts, 1::bigint user_id, 'view' event_type, 150 + (k % 16) / 16.0::double + 0.0005 as value from range(3000) t(k)"
    else:
        made = "select k::bigint vec_id, list_transform(range(1, 65), lambda i: case when i % 8 = 1 then -1e-8 else ((k * 64 + i) * 37 % 4001 - 2000) / 8192 end)::float[] embedding, 0::int as label from range(200) t(k)"
    duck = duckdb.connect()
    duck.execute(f"create table {table} as {made}")
    duck.execute(f"copy {table} to '{tmp_path}/{table}.parquet' (format parquet)")
    frame = registry.queries()[name](spark, str(tmp_path))
    result = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(str(tuple(r[c] for c in names)) for r in frame.collect()) == sorted(map(str, result.fetchall()))


def test_checkpoints_of_odd_events(spark, tmp_path):
    """Users that begin with nothing or below it, and events without a time, a number or a value."""
    duck = duckdb.connect()
    duck.execute(f"""copy (select case when k % 97 <> 5 then k end::bigint event_id, case when k % 89 <> 7 then timestamp '2024-01-01' + (k // 2) * interval 1 second end ts, (k % 4)::bigint user_id, 'view' event_type,
        case when k < 12 then 0.0 when k % 4 = 3 then -150.0 - k % 7 when k % 83 = 11 then null else 150.0 + k % 13 end::double as value from range(3000) t(k)) to '{tmp_path}/events.parquet' (format parquet)""")
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    rows = registry.queries()["k15_checkpoints"](spark, str(tmp_path)).select("user_id", "checkpoint", "n").collect()
    want = sorted(duck.execute(registry.oracle_sql()["k15_checkpoints"]).fetchall())
    assert sorted(map(tuple, rows)) == want and min(c for _, c, _ in want) < 0


def test_tidy_has_one_capital_letter(spark):
    texts = ["ßa", "ŉa", "ﬁn", "ᾀa", "ǆa", "éa", "  ab .", " ab  ", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.tidy(F.col("t"))).collect()]
    assert got == ["ẞa", "ŉa", "ﬁn", "ᾈa", "Ǆa", "Éa", "Ab.", "Ab", ""]
