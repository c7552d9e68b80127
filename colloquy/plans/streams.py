"""Batch forms of the stream operators; the streams themselves are tested against them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import streams as ST
from colloquy.plans.registry import query
from colloquy.sources.tables import SEG, load, transcripts


def events(spark, d):
    return load(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("st1_j11_mix_windows", "select epoch_us(ts) // 600000 * 600000 start_us, coalesce(sum(value) filter (user_id % 2 = 0), 0)::double mic, coalesce(sum(value) filter (user_id % 2 = 1), 0)::double system, count(*) n from events group by 1")
def st1(spark, d):
    w = ST.two_streams(events(spark, d), F.when(F.col("user_id") % 2 == 0, "mic").otherwise("system"), F.col("at"), F.col("value"))
    return w.select(F.unix_micros("window.start").alias("start_us"), "mic", "system", "n")


@query("st2_lag_correction", "with w as (select user_id, epoch_us(ts) us, event_id from events), g as (select *, us - lag(us) over (partition by user_id order by us, event_id) lag_us from w) select user_id, event_id, min(lag_us) over (partition by user_id order by us range between 75000000000 preceding and current row) low_lag from g")
def st2(spark, d):
    """The least lag of each stream in a sliding window, from which drift is corrected."""
    e = events(spark, d).withColumn("us", F.unix_micros("at"))
    g = e.withColumn("lag_us", F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id")))
    return g.select("user_id", "event_id", F.min("lag_us").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-75000000000, 0)).alias("low_lag"))


@query("st3_late_rows", "with o as (select *, max(epoch_us(ts)) over (partition by user_id order by event_id, id rows between unbounded preceding and 1 preceding) head from (select user_id, event_id + case when event_id % 17 = 0 then 40 else 0 end event_id, event_id id, ts from events)) select id event_id from o where head is null or epoch_us(ts) >= head - 3600000000")
def st3(spark, d):
    """Rows that arrive more than an hour behind the newest are dropped, by each stream's arrival order."""
    e = events(spark, d).select("user_id", F.col("event_id").alias("id"), (F.col("event_id") + F.when(F.col("event_id") % 17 == 0, 40).otherwise(0)).alias("arrival"), F.unix_micros("at").alias("us"))
    head = F.max("us").over(Window.partitionBy("user_id").orderBy("arrival", "id").rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumn("head", head).where("head is null or us >= head - 3600000000").select(F.col("id").alias("event_id"))


@query("st4_partial_window", "select user_id, count(*) % 50 n_left from events group by 1 having count(*) % 50 > 0")
def st4(spark, d):
    """What is left for the last, partial window at the stream's end."""
    return events(spark, d).groupBy("user_id").agg((F.count("*") % 50).alias("n_left")).where("n_left > 0")


SESS = "g as (select user_id, epoch_us(ts) us, event_id, case when epoch_us(ts) - lag(epoch_us(ts)) over w >= 7200000000 or lag(epoch_us(ts)) over w is null then 1 else 0 end b from events window w as (partition by user_id order by ts, event_id)), s0 as (select *, sum(b) over (partition by user_id order by us, event_id rows between unbounded preceding and current row) k from g), s as (select user_id, min(us) a, max(us) z, count(*) n from s0 group by user_id, k)"


@query("st5_st6_sessions", f"with {SESS}, p as (select user_id, a, z, unnest(range(0, (z - a) // 3600000000 + 1)) piece from s) select user_id, piece, a + piece * 3600000000 start_us, least(a + piece * 3600000000 + 3600000000, z) end_us from p")
def st5(spark, d):
    """Sessions with a two-hour gap, in pieces of an hour at most."""
    s = ST.split_sessions(ST.speech_sessions(events(spark, d), "user_id", "at", "2 hours"), 3600)
    return s.select("user_id", "piece", "start_us", "end_us")


def arrivals(spark, d):
    """Segments as they would arrive: in reverse within tens, every fifth twice."""
    t = load(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("sequence_id"), (F.col("turn") * 1000).alias("start_ms"), "text")
    arrival = F.floor(F.col("sequence_id") / 10) * 1000 + 9 - F.col("sequence_id") % 10
    again = t.where("sequence_id % 5 = 0").withColumn("text", F.lit("again")).withColumn("arrival", arrival + 500)
    return t.withColumn("arrival", arrival).unionByName(again)


@query("st7_st8_reorder", "select conv_id session_id, turn sequence_id, row_number() over (partition by conv_id order by turn) place, text <> 'again' first_kept from conversations")
def st7(spark, d):
    return ST.reordered(arrivals(spark, d), "session_id", "sequence_id", "start_ms").select("session_id", "sequence_id", F.col("place").cast("long").alias("place"), (F.col("text") != "again").alias("first_kept"))


@query("st9_last_wins", "select conv_id session_id, turn sequence_id, case when turn % 5 = 0 then 'again' else text end \"text\" from conversations")
def st9(spark, d):
    return arrivals(spark, d).groupBy("session_id", "sequence_id").agg(F.max_by("text", "arrival").alias("text"))


@query("st10_stale_sessions", "select conv_id session_id, turn sequence_id from conversations where conv_id = (select max(conv_id) from conversations)")
def st10(spark, d):
    a = load(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("sequence_id"))
    return a.join(F.broadcast(a.agg(F.max("session_id").alias("session_id"))), "session_id")


@query("st11_count_or_time", "with n as (select user_id, epoch_us(ts) us, (row_number() over (partition by user_id, epoch_us(ts) // 86400000000 order by ts, event_id) - 1) // 50 b, epoch_us(ts) // 86400000000 as day from events) select user_id, day, b batch, count(*) n from n group by 1, 2, 3")
def st11(spark, d):
    """Micro-batches of 50 items, or a day."""
    e = events(spark, d).withColumn("day", F.floor(F.unix_micros("at") / 86400000000))
    b = F.floor((F.row_number().over(Window.partitionBy("user_id", "day").orderBy("at", "event_id")) - 1) / 50)
    return e.withColumn("batch", b).groupBy("user_id", "day", "batch").agg(F.count("*").alias("n"))


@query("st12_debounce", "with g as (select user_id, event_id, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) - epoch_us(ts) to_next from events) select event_id from g where to_next is null or to_next > 1800000000")
def st12(spark, d):
    """The writes of a debounced writer: rows that no other follows within half an hour."""
    to_next = F.lead(F.unix_micros("at")).over(Window.partitionBy("user_id").orderBy("at", "event_id")) - F.unix_micros("at")
    return events(spark, d).withColumn("to_next", to_next).where("to_next is null or to_next > 1800000000").select("event_id")


@query("st13_sentences", rf"with {SEG}, n as (select meeting_id, seq, transcript, coalesce(sum(regexp_matches(transcript, '[.?!]\s*$')::int) over (partition by meeting_id order by seq rows between unbounded preceding and 1 preceding), 0)::bigint sentence_no from seg) select meeting_id, sentence_no, string_agg(transcript, ' ' order by seq) \"text\", bool_or(regexp_matches(transcript, '[.?!]\s*$')) final from n group by 1, 2".replace('\\"', '"'))
def st13(spark, d):
    return ST.sentences(transcripts(spark, d), "meeting_id", "seq", "transcript")


@query("st14_overlap_buffers", "with n as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 i from events), w as (select *, unnest(range(greatest(0, ceil((i - 19) / 16.0)::bigint), i // 16 + 1)) buffer from n) select user_id, buffer, count(*) n, min(i) first_index, round(sum(value), 4) total from w group by 1, 2")
def st14(spark, d):
    """Buffers of 20 values that begin with the last four of the one before."""
    w = ST.overlapping_windows(events(spark, d).withColumn("o", F.struct("at", "event_id")), "user_id", "o", "value", 20, 4)
    return w.withColumn("total", F.round("total", 4))


@query("st15_outcome_counts", "select count(*) queued, count(*) filter (event_type = 'error') failed, count(*) filter (event_type = 'click') skipped from events")
def st15(spark, d):
    return events(spark, d).agg(F.count("*").alias("queued"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "click").alias("skipped"))


@query("st16_jitter", "with g as (select event_id, epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id order by ts, event_id rows between 3 preceding and current row) age from events) select event_id, age >= 3600000000 ready from g")
def st16(spark, d):
    """Ready once the oldest of the last four is an hour old."""
    us = F.unix_micros("at")
    oldest = F.min(us).over(Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(-3, 0))
    return events(spark, d).select("event_id", (us - oldest >= 3600000000).alias("ready"))


@query("st19_retry_pool", "select o_orderkey, least(o_orderkey % 5, 3)::bigint attempts, o_orderkey % 5 > 3 failed from orders")
def st19(spark, d):
    """Attempts of each chunk under at most three tries."""
    k = F.col("o_orderkey") % 5
    return load(spark, d, "orders").select("o_orderkey", F.least(k, F.lit(3)).alias("attempts"), (k > 3).alias("failed"))


@query("k15_checkpoints", "with c as (select user_id, value, sum((value * 1000)::bigint) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)::bigint total from events) select user_id, (total - 1) // 300000 checkpoint, count(*) n from c group by 1, 2")
def k15(spark, d):
    """Flushes by cumulative sample count."""
    # a cast to a whole number rounds halves to even
    n = F.rint(F.col("value") * 1000).cast("long")
    order = Window.partitionBy("user_id").orderBy(F.col("at").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    total = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # whole numbers are divided towards zero: a total of nothing is in checkpoint 0
    return events(spark, d).withColumn("total", total).groupBy("user_id", F.expr("(total - 1) div 300000").alias("checkpoint")).agg(F.count("*").alias("n"))


@query("k16_recovered", "select user_id, count(*) n, string_agg(event_id::varchar, ',' order by event_id) parts from events group by 1")
def k16(spark, d):
    """Checkpoints concatenated in name order."""
    s = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("event_id")).alias("s"))
    return s.select("user_id", "n", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("parts"))


@query("u1_u4_model_hooks", r"""with w as (select doc_id, text, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), ' ') heard, regexp_extract_all(lower(text), '\p{L}+') l from documents),
v as (select doc_id, unnest([{'n': len(list_filter(l, lambda x: list_contains(['der','die','und','das','ist','nicht'], x))), 'g': 'de'}, {'n': len(list_filter(l, lambda x: list_contains(['the','and','of','to','is','that'], x))), 'g': 'en'}, {'n': len(list_filter(l, lambda x: list_contains(['el','los','que','las','una','por'], x))), 'g': 'es'}, {'n': len(list_filter(l, lambda x: list_contains(['le','les','des','est','une','dans'], x))), 'g': 'fr'}]) x from w),
b as (select doc_id, max(x.n) top, case when count(*) filter (x.n = t) = 1 then max(x.g) filter (x.n = t) end lang from (select *, max(x.n) over (partition by doc_id) t from v) group by 1)
select w.doc_id, heard, round(least(strlen(heard) / 100, 0.9) + 0.1, 6)::double confidence, strlen(heard) < 50 is_partial, lang, lang is not null and top >= 3 reliable,
case when regexp_matches(trim(text), '[.?!]\s') then regexp_extract(trim(text), '^(.*?[.?!])\s', 1, 's') else trim(text) end summary from w join b on b.doc_id = w.doc_id""")
def u1(spark, d):
    """Speech, language and summary models behind Arrow hooks, with deterministic stubs."""
    from colloquy.functions import models as M
    from colloquy.functions.arrow import PART_BYTES, small_batches

    small_batches(spark, PART_BYTES)
    docs = load(spark, d, "documents")
    out = docs.select("doc_id", M.transcribe("text").alias("t"), M.detect_language("text").alias("l"), M.summarise("text").alias("s"))
    return out.select("doc_id", F.col("t.text").alias("heard"), F.round("t.confidence", 6).alias("confidence"), "t.is_partial", "l.lang", "l.reliable", F.col("s.content").alias("summary"))


@query("u2_batch_closure", "select event_type, max(value) - min(value) spread from events group by 1")
def u2(spark, d):
    """A user's function over batches as a grouped aggregate."""
    from colloquy.functions import models as M

    return events(spark, d).groupBy("event_type").agg(M.spread("value").alias("spread"))
