"""Array and time arithmetic of the audio path, over arrays built from the stored numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import audio as A
from colloquy.functions import loudness as L
from colloquy.functions import resampling as R
from colloquy.functions import signal as S
from colloquy.functions.arrow import PART_BYTES, small_batches
from colloquy.plans.registry import query
from colloquy.sources.tables import load

VEC = "v as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings)"


def vectors(spark, d):
    # arrays are repeated from here on, and Python's part of a batch is several times the batch
    small_batches(spark, PART_BYTES)
    return load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


@query("a16_levels", f"with {VEC} select vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)), 6) rms, round(list_max(list_transform(e, lambda x: abs(x))), 6) peak from v")
def a16(spark, d):
    return vectors(spark, d).select("vec_id", A.rounded(A.rms(F.col("e")), 6).alias("rms"), A.rounded(A.peak(F.col("e")), 6).alias("peak"))


@query("p18_activity", f"with {VEC} select vec_id, sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)) > 0.125 active, round(least(1.0, 9 * list_max(list_transform(e, lambda x: abs(x)))), 6) peak from v")
def p18(spark, d):
    return vectors(spark, d).select("vec_id", (A.rms(F.col("e")) > 0.125).alias("active"), A.rounded(F.least(F.lit(1.0), 9 * A.peak(F.col("e"))), 6).alias("peak"))


@query("m5_mono", f"with {VEC} select vec_id, list_transform(range(1, 33), lambda i: round((e[2 * i - 1] + e[2 * i]) / 2, 6) + 0.0) mono from v")
def m5(spark, d):
    return vectors(spark, d).select("vec_id", F.transform(A.mono(F.col("e"), 2), lambda x: A.rounded(x, 6) + 0.0).alias("mono"))


PAIRS = "p as (select a.vec_id, list_transform(a.embedding, lambda x: x::double * 5) m, list_transform(b.embedding, lambda x: x::double * 5) s from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def pairs(spark, d):
    a = load(spark, d, "embeddings")
    five = lambda c: F.transform(c, lambda x: x.cast("double") * 5)
    return a.select("vec_id", five("embedding").alias("m")).join(a.select((F.col("vec_id") - 1).alias("vec_id"), five("embedding").alias("s")), "vec_id")


@query("m6_j12_mix", f"with {PAIRS} select vec_id, list_transform(range(1, 65), lambda i: round(case when abs(m[i] + s[i]) > 1 then sign(m[i] + s[i]) else m[i] + s[i] end, 6)) mixed from p")
def m6(spark, d):
    return pairs(spark, d).select("vec_id", F.transform(A.mix(F.col("m"), F.col("s")), lambda x: A.rounded(x, 6)).alias("mixed"))


@query("m7_duck", f"with {PAIRS}, r as (select *, sqrt(list_sum(list_transform(m, lambda x: x * x)) / len(m)) > 0.625 loud from p) select vec_id, list_transform(range(1, 65), lambda i: round(greatest(-1, least(1, m[i] + s[i] * case when loud then 0.3 else 1 end)), 6)) mixed from r")
def m7(spark, d):
    return pairs(spark, d).select("vec_id", F.transform(A.duck(F.col("m"), F.col("s"), threshold=0.625, gain=0.3), lambda x: A.rounded(x, 6)).alias("mixed"))


@query("m8_dynamic_mix", f"with {PAIRS}, r as (select *, sqrt(list_sum(list_transform(m, lambda x: x * x)) / 64) a, sqrt(list_sum(list_transform(s, lambda x: x * x)) / 64) b from p), q as (select *, least(0.9, greatest(0.1, a / (a + b))) k from r) select vec_id, list_transform(range(1, 65), lambda i: round(m[i] * k + s[i] * (1 - k), 6)) mixed from q")
def m8(spark, d):
    return pairs(spark, d).select("vec_id", F.transform(A.dynamic_mix(F.col("m"), F.col("s")), lambda x: A.rounded(x, 6)).alias("mixed"))


@query("m10_peak_normalise", f"with {VEC} select vec_id, list_transform(e, lambda x: round(case when list_max(list_transform(e, lambda y: abs(y))) > 0.3 then x / list_max(list_transform(e, lambda y: abs(y))) else x end, 6)) e from v")
def m10(spark, d):
    return vectors(spark, d).select("vec_id", F.transform(A.peak_normalise(F.col("e"), limit=0.3), lambda x: A.rounded(x, 6)).alias("e"))


@query("w10_argmax", f"with {VEC} select vec_id, (list_position(e, list_max(e)) - 1)::bigint arg from v")
def w10(spark, d):
    return vectors(spark, d).select("vec_id", (F.array_position("e", F.array_max("e")) - 1).alias("arg"))


@query("a24_channel_speaker", f"with {PAIRS}, e as (select vec_id, list_sum(list_transform(m, lambda x: abs(x))) a, list_sum(list_transform(s, lambda x: abs(x))) b from p) select vec_id, case when a > 1.1 * b then '0' when b > 1.1 * a then '1' else '?' end speaker from e")
def a24(spark, d):
    return pairs(spark, d).select("vec_id", A.louder_channel(F.col("m"), F.col("s")).alias("speaker"))


@query("m17_frame_seconds", "select event_id, round(event_id * 270 / 16000.0 + 0.5 * 991 / 16000.0, 6)::double s from events")
def m17(spark, d):
    return load(spark, d, "events").select("event_id", F.round(F.col("event_id") * 270 / 16000.0 + 0.5 * 991 / 16000.0, 6).alias("s"))


@query("m19_fixed_chunks", f"with {VEC}, i as (select vec_id, unnest(range(0, len(e))) i from v) select vec_id, i // 30 chunk_no, count(*) n from i group by 1, 2")
def m19(spark, d):
    i = vectors(spark, d).select("vec_id", F.posexplode("e").alias("i", "x"))
    return i.groupBy("vec_id", F.floor(F.col("i") / 30).alias("chunk_no")).agg(F.count("*").alias("n"))


@query("m20_buffer_timeout", "select o_orderkey, (case when o_orderkey % 2 = 0 then least(greatest(2.0 * (o_custkey % 4000) / 48000 * 1000, 80), 200) else least(greatest(2.0 * (o_custkey % 4000) / 48000 * 1000, 20), 50) end)::double ms from orders")
def m20(spark, d):
    ms = 2.0 * (F.col("o_custkey") % 4000) / 48000 * 1000
    return load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.least(F.greatest(ms, F.lit(80.0)), F.lit(200.0))).otherwise(F.least(F.greatest(ms, F.lit(20.0)), F.lit(50.0))).alias("ms"))


@query("m21_progress_scale", "select event_id, case event_type when 'error' then 0 when 'view' then least(40, floor(value))::int else 40 + least(60, floor(value))::int end::bigint pct from events")
def m21(spark, d):
    f = F.floor("value")
    return load(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", F.least(F.lit(40), f)).otherwise(40 + F.least(F.lit(60), f)).cast("long").alias("pct"))


@query("m22_embedding_codec", "select vec_id, len(embedding)::bigint * 4 n_bytes, true same, vec_id % 10 = 0 rejected from embeddings")
def m22(spark, d):
    """Written as little-endian bytes and read back; a blob of another length is null."""
    v = load(spark, d, "embeddings").select("vec_id", "embedding", S.to_blob("embedding").alias("blob"))
    bad = F.when(F.col("vec_id") % 10 == 0, F.substring("blob", 1, 255)).otherwise(F.col("blob"))
    return v.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), (F.col("embedding") == S.from_blob("blob")).alias("same"), S.from_blob(bad).isNull().alias("rejected"))


@query("m23_backoff", "select n_nationkey::bigint n, least(5 * pow(2, n_nationkey), 60)::double s from nation")
def m23(spark, d):
    return load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.least(5 * F.pow(F.lit(2.0), "n_nationkey"), F.lit(60.0)).alias("s"))


@query("m9_m11_m12_m14_m16_signal")
def m11(spark, d):
    """Filters, loudness, denoising and filterbanks of each vector taken as samples."""
    v = vectors(spark, d)
    out = v.select("vec_id", S.high_pass("e").alias("high_passed"), S.normalise("e").alias("normalised"), S.spectral_subtraction("e").alias("denoised"), S.filterbank(F.flatten(F.array_repeat("e", 20))).alias("bank"))
    tidy = F.transform("bank", lambda frame: F.transform(frame, lambda x: F.round(x, 6)))
    return out.select("vec_id", "high_passed", "normalised", "denoised", F.size("bank").cast("long").alias("bank_frames"), tidy.alias("bank"))


@query("m12_loudness")
def m12(spark, d):
    """Loudness of each vector, repeated for most of a second, before and after the gain to -23 LUFS. Chunks of a recording
    of forty vectors, one after the other."""
    v = vectors(spark, d).select(F.floor(F.col("vec_id") / 40).alias("recording"), F.col("vec_id").alias("chunk"), F.transform(F.flatten(F.array_repeat("e", 100)), lambda x: x / 50).alias("samples"))
    # samples are measured on either side and never joined
    lufs = lambda rows, name: rows.select("recording", "chunk", F.round(L.integrated_loudness("samples", F.lit(8000)), 6).alias(name))
    return lufs(v, "before_lufs").join(lufs(L.normalise_chunks(v, 8000), "after_lufs"), ["recording", "chunk"]).drop("recording")


@query("m15_resample_chunks")
def m15b(spark, d):
    """Recordings of forty vectors, a chunk each, from 48 to 16 kHz without a seam."""
    v = vectors(spark, d).select(F.floor(F.col("vec_id") / 40).alias("recording"), F.col("vec_id").alias("chunk"), F.flatten(F.array_repeat("e", 40)).alias("samples"))
    return R.resample_chunks(v, 48_000, 16_000).select("recording", "chunk", "first", F.transform("samples", lambda x: F.round(x, 6)).alias("samples"))


def _sinc(points: int, at: str, cut: float) -> str:
    """DuckDB list of ``points`` values, each a windowed sinc around the place ``at`` (of output i) over the samples j."""
    k = f"(j - {at})"
    bell = f"case when abs({k}) <= 16 / {cut} then 0.5 + 0.5 * cos(pi() * {k} * {cut} / 16) else 0 end"
    wave = f"case when {k} = 0 then 1.0 else sin(pi() * {k} * {cut}) / (pi() * {k} * {cut}) end"
    return f"list_transform(range(0, {points}), lambda i: round(list_sum(list_transform(range(0, 64), lambda j: {wave} * {cut} * {bell} * e[j + 1])), 5) + 0.0)"


@query("m15_resample", f"select vec_id, {_sinc(32, 'i * 2.0::double', 0.5)} half, {_sinc(128, 'i * 0.5::double', 1.0)} double from (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings)")
def m15(spark, d):
    """Windowed-sinc resampling of each vector to half and to twice the rate."""
    tidy = lambda x: A.rounded(x, 5) + 0.0
    return vectors(spark, d).select("vec_id", F.transform(S.resample("e", F.lit(2), F.lit(1)), tidy).alias("half"), F.transform(S.resample("e", F.lit(1), F.lit(2)), tidy).alias("double"))


@query("m18_split_at_silence")
def m18(spark, d):
    """Long segments split where they are quietest near the target length."""
    v = vectors(spark, d).select("vec_id", F.flatten(F.array_repeat("e", 50)).alias("e"))
    return S.split_at_silence(v, "vec_id", "e", sample_rate=100, most_s=15, around_s=3)


@query("m1_m2_start_tokens", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' started, row_number() over (partition by o_orderdate order by o_orderkey) - 1 seq from orders")
def m1(spark, d):
    """Start tokens as (time, number), as equal times must differ; times in RFC 3339."""
    from pyspark.sql import Window

    return load(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started"), (F.row_number().over(Window.partitionBy("o_orderdate").orderBy("o_orderkey")).cast("long") - 1).alias("seq"))


@query("m3_mixed_times", "select o_orderkey, epoch(o_orderdate)::bigint s from orders")
def m3(spark, d):
    """Texts in three formats, read as one time."""
    k = F.col("o_orderkey") % 3
    t = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS+00:00"))
    return load(spark, d, "orders").select("o_orderkey", F.unix_timestamp(A.any_time(t)).alias("s"))


@query("m4_segment_seconds", "select event_id, value / 1000 start_s, (value * 3 - value) / 1000 duration_s from events")
def m4(spark, d):
    return load(spark, d, "events").select("event_id", (F.col("value") / 1000).alias("start_s"), ((F.col("value") * 3 - F.col("value")) / 1000).alias("duration_s"))
