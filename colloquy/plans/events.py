"""Event metrics: batches, counters, sessions, gaps, rate limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import streams as ST
from colloquy.plans.registry import query
from colloquy.sources.tables import load

MS = "epoch_us(ts)"


def events(spark, d):
    return load(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def by_user():
    return Window.partitionBy("user_id").orderBy("us", "event_id")


@query("a5_metric_batches", f"with n as (select *, (row_number() over (partition by user_id order by {MS}, event_id) - 1) // 50 batch from events) select user_id, batch, count(*) n, round(sum(value), 4) total, round(avg(value), 4) mean, max({MS}) - min({MS}) span_us, round(case when max({MS}) = min({MS}) then 0 else count(*) / ((max({MS}) - min({MS})) / 1e6) end, 6)::double per_s from n group by 1, 2")
def a5(spark, d):
    """Batches of 50 events of each user."""
    n = events(spark, d).withColumn("batch", F.floor((F.row_number().over(by_user()) - 1) / 50))
    span = F.max("us") - F.min("us")
    return n.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), span.alias("span_us"), F.round(F.when(span == 0, 0.0).otherwise(F.count("*") / (span / 1e6)), 6).alias("per_s"))


@query("a6_a7_outcomes", "select user_id, count(*) queued, count(*) filter (event_type = 'purchase') completed, count(*) filter (event_type = 'error') failed, greatest(count(*) - count(*) filter (event_type in ('purchase', 'error')), 0) pending, case when count(*) = 0 then 100 else count(*) filter (event_type in ('purchase', 'error')) * 100 // count(*) end::bigint pct from events group by 1")
def a6(spark, d):
    done, bad, n = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error"), F.count("*")
    return events(spark, d).groupBy("user_id").agg(n.alias("queued"), done.alias("completed"), bad.alias("failed"), F.greatest(n - done - bad, F.lit(0)).alias("pending"), F.when(n == 0, 100).otherwise(F.floor((done + bad) * 100 / n)).cast("long").alias("pct"))


@query("a10_mean_confidence", "select user_id, round(coalesce(avg(value) filter (event_type <> 'error'), 0), 6) confidence from events group by 1")
def a10(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("event_type") != "error", F.col("value"))), F.lit(0.0)), 6).alias("confidence"))


@query("a18_daily_counters", "select strftime(ts, '%Y-%m-%d') as day, count(*) n, sum(count(*)) over (order by strftime(ts, '%Y-%m-%d'))::bigint total, date_diff('day', date '2023-12-25', min(ts)::date)::bigint days_since from events group by 1")
def a18(spark, d):
    by_day = events(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    # one row a day
    return by_day.select("day", "n", F.sum("n").over(Window.orderBy("day")).alias("total"), F.datediff(F.to_date("day"), F.lit("2023-12-25")).cast("long").alias("days_since"))


@query("a19_daily_users", "select strftime(ts, '%Y-%m-%d') as day, count(distinct user_id) users from events group by 1")
def a19(spark, d):
    return events(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").dropDuplicates(["day", "user_id"]).groupBy("day").agg(F.count("*").alias("users"))


@query("a20_first_use", f"select event_id from (select *, row_number() over (partition by user_id, event_type order by {MS}, event_id) r from events) where r = 1")
def a20(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("us", "event_id")
    return events(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("event_id")


@query("a21_st18_active_time", f"with p as (select user_id, {MS} us, event_type, lead({MS}) over (partition by user_id order by {MS}, event_id) nxt, max({MS}) over (partition by user_id) fin, min({MS}) over (partition by user_id) beg from events) select user_id, max(fin) - min(beg) - coalesce(sum(coalesce(nxt, fin) - us) filter (event_type = 'error'), 0)::bigint active_us, coalesce(sum(coalesce(nxt, fin) - us) filter (event_type = 'error'), 0)::bigint paused_us from p group by 1")
def a21(spark, d):
    """An error pauses until the next event; an open pause lasts to the end."""
    e = events(spark, d).withColumn("next", F.lead("us").over(by_user())).withColumn("fin", F.max("us").over(Window.partitionBy("user_id")))
    paused = F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.coalesce("next", "fin") - F.col("us"))), F.lit(0))
    return e.groupBy("user_id").agg((F.max("us") - F.min("us") - paused).alias("active_us"), paused.alias("paused_us"))


@query("a23_safe_workers", "select c_custkey, greatest(1, least(c_custkey % 9, c_nationkey % 12, 4))::bigint workers, case when c_custkey % 2 = 0 then 2 else greatest(1, least(6, (c_nationkey % 12) // 3)) end::bigint diarization from customer")
def a23(spark, d):
    c = load(spark, d, "customer")
    cores = F.col("c_nationkey") % 12
    return c.select("c_custkey", F.greatest(F.lit(1), F.least(F.col("c_custkey") % 9, cores, F.lit(4))).cast("long").alias("workers"), F.when(F.col("c_custkey") % 2 == 0, 2).otherwise(F.greatest(F.lit(1), F.least(F.lit(6), F.floor(cores / 3)))).cast("long").alias("diarization"))


@query("a25_text_confidence", "select conv_id, round(avg(least(strlen(text) / 100.0, 0.9) + 0.1), 6)::double confidence, bool_or(strlen(text) < 150) partial from conversations group by 1")
def a25(spark, d):
    n = F.octet_length("text")
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.avg(F.least(n / 100.0, F.lit(0.9)) + 0.1), 6).alias("confidence"), F.bool_or(n < 150).alias("partial"))


@query("w6_error_bursts", f"with e as (select user_id, event_id, {MS} us from events where event_type = 'error'), c as (select *, count(*) over (partition by user_id order by us range between 200000000000 preceding and current row) n from e) select event_id, n, max((n > 5)::int) over (partition by user_id order by us, event_id rows between unbounded preceding and current row) = 1 dead from c")
def w6(spark, d):
    """More than five errors within the window kill a stream for good; here the window is 200 000 s."""
    e = events(spark, d).where("event_type = 'error'")
    n = F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-200000000000, 0))
    dead = F.bool_or(F.col("n") > 5).over(by_user().rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("n", n).select("event_id", "n", dead.alias("dead"))


@query("w7_w13_gaps", f"with g as (select event_id, lead({MS}) over w - {MS} to_next, {MS} - lag({MS}) over w since from events window w as (partition by user_id order by {MS}, event_id)) select event_id, coalesce(to_next > 30000000000, false) stalled, coalesce(since > 2 * 15000000000, false) gap from g")
def w7(spark, d):
    e = events(spark, d).select("event_id", (F.lead("us").over(by_user()) - F.col("us")).alias("to_next"), (F.col("us") - F.lag("us").over(by_user())).alias("since"))
    return e.select("event_id", F.coalesce(F.col("to_next") > 30000000000, F.lit(False)).alias("stalled"), F.coalesce(F.col("since") > 2 * 15000000000, F.lit(False)).alias("gap"))


@query("w8_sliding_minimum", f"select event_id, min(value) over (partition by user_id order by {MS} range between 75000000000 preceding and current row) low from events")
def w8(spark, d):
    low = F.min("value").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-75000000000, 0))
    return events(spark, d).select("event_id", low.alias("low"))


@query("w12_rate_limit", f"with recursive e as (select user_id, {MS} us, event_id from events where event_type = 'error'), r as (select user_id, min(us) us, arg_min(event_id, (us, event_id)) event_id from e group by 1 union all select r.user_id, min(e.us), arg_min(e.event_id, (e.us, e.event_id)) from r join e on e.user_id = r.user_id and e.us >= r.us + 10000000000 group by 1) select user_id, event_id from r")
def w12(spark, d):
    """At most one error event of each user in 10 000 s: the exact fold over the ordered events."""
    return ST.rate_limited(events(spark, d).where("event_type = 'error'"), "user_id", "us", "event_id", 10_000_000_000)


@query("w14_st17_health", f"with g as (select user_id, {MS} us, event_type = 'error' e, sum((event_type <> 'error')::int) over (partition by user_id order by {MS} rows between unbounded preceding and current row) g, lead({MS}) over (partition by user_id order by {MS}) - {MS} gap from events), s as (select *, sum(e::int) over (partition by user_id, g order by us rows between unbounded preceding and current row) k from g) select user_id, case when k >= 3 or gap > 30000000000 then 'Dead' when k >= 1 then 'Degraded' else 'Running' end state, count(*) n from s group by 1, 2")
def w14(spark, d):
    """Stream states of each user over its events."""
    return ST.health_states(events(spark, d), "user_id", "us", "event_type")


@query("p17_property_denylist", "select event_id, event_type kept_type from events where event_type <> 'click'")
def p17(spark, d):
    e = load(spark, d, "events").select("event_id", F.map_filter(F.create_map(F.lit("type"), "event_type", F.lit("email"), F.lit("x")), lambda k, _: k != "email").alias("p"))
    return e.where(F.col("p")["type"] != "click").select("event_id", F.col("p")["type"].alias("kept_type"))


@query("p19_resource_gate", "select c_custkey, not (c_acctbal > 5000 or c_nationkey > 20 or c_custkey % 11 = 0) can_proceed, ((c_acctbal > 5000)::int + (c_nationkey > 20)::int + (c_custkey % 11 = 0)::int)::bigint warnings from customer")
def p19(spark, d):
    w = F.array_compact(F.array(F.when(F.col("c_acctbal") > 5000, "memory"), F.when(F.col("c_nationkey") > 20, "cpu"), F.when(F.col("c_custkey") % 11 == 0, "temperature")))
    return load(spark, d, "customer").select("c_custkey", (F.size(w) == 0).alias("can_proceed"), F.size(w).cast("long").alias("warnings"))


@query("st20_sessions", f"with g as (select user_id, {MS} us, case when {MS} - lag({MS}) over (partition by user_id order by {MS}, event_id) >= 14400000000 or lag({MS}) over (partition by user_id order by {MS}, event_id) is null then 1 else 0 end b, event_id from events), s as (select *, sum(b) over (partition by user_id order by us, event_id rows between unbounded preceding and current row) k from g) select user_id, min(us) start_us, max(us) last_us, count(*) n from s group by user_id, k")
def st20(spark, d):
    """App sessions: a gap of four hours ends one."""
    e = load(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("at", "4 hours")).agg(F.unix_micros(F.min("at")).alias("start_us"), F.unix_micros(F.max("at")).alias("last_us"), F.count("*").alias("n"))
    return s.select("user_id", "start_us", "last_us", "n")
