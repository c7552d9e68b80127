"""Catalogues, budgets, gates, monitors: the smaller operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.plans.registry import query
from colloquy.sources.tables import load


def orders(spark, d):
    return load(spark, d, "orders")


def pick(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


@query("x1_x2_model_catalogue", "select p_partkey, coalesce(case when p_partkey % 3 = 0 then p_size * 1000 end, p_size * 100)::bigint context_length, coalesce(case when p_partkey % 4 <> 0 then p_name end, 'Unknown') as name from part")
def x1(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.struct(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 1000).alias("context_length")).alias("top_provider"), (F.col("p_size") * 100).alias("context_length"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("name"))
    return p.select("p_partkey", F.coalesce("top_provider.context_length", "context_length").cast("long").alias("context_length"), F.coalesce("name", F.lit("Unknown")).alias("name"))


@query("x3_budget_source", "select o_orderkey, case o_orderkey % 4 when 0 then least(coalesce(case when o_custkey % 2 = 0 then o_custkey end, 4096), 16384) when 1 then 32768 when 2 then coalesce(case when o_custkey % 3 = 0 then o_custkey * 10 end, 128000) else 8192 end::bigint budget from orders")
def x3(spark, d):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    b = F.when(k == 0, F.least(F.coalesce(F.when(c % 2 == 0, c), F.lit(4096)), F.lit(16384))).when(k == 1, 32768).when(k == 2, F.coalesce(F.when(c % 3 == 0, c * 10), F.lit(128000))).otherwise(8192)
    return orders(spark, d).select("o_orderkey", b.cast("long").alias("budget"))


@query("x4_ttl_cache", "with n as (select max(epoch(o_orderdate)) t from orders) select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) cached from orders, n where n.t - epoch(o_orderdate) < 86400 * 400 group by 1")
def x4(spark, d):
    o = orders(spark, d)
    now = o.agg(F.max(F.unix_timestamp("o_orderdate")).alias("t"))
    return o.crossJoin(F.broadcast(now)).where(F.col("t") - F.unix_timestamp("o_orderdate") < 86400 * 400).groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("cached"))


@query("x5_x6_context_probe", "select o_orderkey, case o_orderkey % 3 when 0 then o_custkey when 1 then o_custkey + 1 else 4000 end::bigint context_length, o_custkey::bigint num_ctx from orders")
def x5(spark, d):
    m = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("llama.context_length"), "o_custkey")).when(F.col("o_orderkey") % 3 == 1, F.create_map(F.lit("context_size"), F.col("o_custkey") + 1)).otherwise(F.create_map(F.lit("other"), "o_custkey"))
    found = F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in ("llama.context_length", "llama.context_size", "context_length", "context_size")], F.lit(4000))
    file = F.concat(F.lit("FROM x\nPARAMETER num_ctx "), "o_custkey", F.lit("\nPARAMETER top_p 1"))
    return orders(spark, d).select("o_orderkey", found.cast("long").alias("context_length"), F.regexp_extract(file, r"PARAMETER\s+num_ctx\s+(\d+)", 1).cast("long").alias("num_ctx"))


@query("x7_family_order", "select o_orderkey, case when n like '%llama%' then 4096 when n like '%mistral%' then 8192 when n like '%codellama%' then 16384 else 4000 end::bigint size from (select o_orderkey, (['llama3','codellama','mistral','phi'])[o_orderkey % 4 + 1] n from orders)")
def x7(spark, d):
    n = pick(["llama3", "codellama", "mistral", "phi"], F.col("o_orderkey"))
    return orders(spark, d).select("o_orderkey", F.when(n.contains("llama"), 4096).when(n.contains("mistral"), 8192).when(n.contains("codellama"), 16384).otherwise(4000).cast("long").alias("size"))


@query("x8_best_model", "select p_brand, max_by(p_partkey, (p_size, p_partkey)) best from part where p_retailprice > 1000 group by 1")
def x8(spark, d):
    return load(spark, d, "part").where("p_retailprice > 1000").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("best"))


@query("x9_x20_hardware_tiers", "select c_custkey, case when c_acctbal >= 8000 then 'large' when c_acctbal >= 4000 then 'medium' else 'small' end model, case when c_nationkey % 3 = 0 and c_acctbal >= 6000 then 'ultra' when c_nationkey % 3 = 0 or c_acctbal >= 5000 then 'high' when c_acctbal >= 1000 then 'medium' else 'low' end tier from customer")
def x9(spark, d):
    b, gpu = F.col("c_acctbal"), F.col("c_nationkey") % 3 == 0
    return load(spark, d, "customer").select("c_custkey", F.when(b >= 8000, "large").when(b >= 4000, "medium").otherwise("small").alias("model"), F.when(gpu & (b >= 6000), "ultra").when(gpu | (b >= 5000), "high").when(b >= 1000, "medium").otherwise("low").alias("tier"))


@query("x10_device_kind", "select o_orderkey, case when regexp_matches(lower(n), 'airpods|bluetooth|buds') then 'bluetooth' when regexp_matches(lower(n), 'built-in|usb|internal') then 'wired' when o_custkey % 100 > 50 then 'bluetooth' when o_custkey % 100 < 20 then 'wired' else 'unknown' end kind from (select o_orderkey, o_custkey, (['AirPods Pro','Built-in Mic','X100','USB Audio','Line'])[o_orderkey % 5 + 1] n from orders)")
def x10(spark, d):
    n, ms = F.lower(pick(["AirPods Pro", "Built-in Mic", "X100", "USB Audio", "Line"], F.col("o_orderkey"))), F.col("o_custkey") % 100
    kind = F.when(n.rlike("airpods|bluetooth|buds"), "bluetooth").when(n.rlike("built-in|usb|internal"), "wired").when(ms > 50, "bluetooth").when(ms < 20, "wired").otherwise("unknown")
    return orders(spark, d).select("o_orderkey", kind.alias("kind"))


@query("x11_presence_monitor", "with e as (select user_id, event_id, event_type = 'error' miss from events), g as (select *, sum((not miss)::int) over (partition by user_id order by event_id rows between unbounded preceding and current row) k from e), r as (select *, sum(miss::int) over (partition by user_id, k order by event_id rows between unbounded preceding and current row) streak from g) select event_id from r where miss and streak % 2 = 0")
def x11(spark, d):
    """An event for every second miss in a row."""
    miss = (F.col("event_type") == "error").cast("int")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = load(spark, d, "events").withColumn("miss", miss).withColumn("k", F.sum(1 - F.col("miss")).over(w))
    streak = F.sum("miss").over(Window.partitionBy("user_id", "k").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("streak", streak).where("miss = 1 and streak % 2 = 0").select("event_id")


@query("x12_list_changed", "with c as (select user_id, event_id, floor(value)::bigint % 3 n from events) select event_id from (select *, lag(n) over (partition by user_id order by event_id) before from c) where before <> n")
def x12(spark, d):
    c = load(spark, d, "events").withColumn("n", F.floor("value") % 3)
    return c.withColumn("before", F.lag("n").over(Window.partitionBy("user_id").orderBy("event_id"))).where("before != n").select("event_id")


@query("x13_notification_gate", "select event_id from events where user_id % 5 <> 0 and (user_id % 7 <> 0 or event_type = 'error') and event_type in ('error', 'purchase', 'view')")
def x13(spark, d):
    critical = F.col("event_type") == "error"
    wanted = spark.createDataFrame([("error",), ("purchase",), ("view",)], "event_type string")
    gate = (F.col("user_id") % 5 != 0) & ((F.col("user_id") % 7 != 0) | critical)
    return load(spark, d, "events").where(gate).join(F.broadcast(wanted), "event_type").select("event_id")


@query("x14_batch_plan", "with n as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 p, count(*) over (partition by user_id) c from events) select event_id, p // 32 batch, p = c - 1 is_last from n")
def x14(spark, d):
    p = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    n = load(spark, d, "events").withColumn("p", p).withColumn("c", F.count("*").over(Window.partitionBy("user_id")))
    return n.select("event_id", F.floor(F.col("p") / 32).alias("batch"), (F.col("p") == F.col("c") - 1).alias("is_last"))


@query("x15_generation_limit", "select o_orderkey, least(8192 - p, greatest(m, 0))::bigint room from (select o_orderkey, o_orderkey % 8000 + 1 p, o_custkey % 3000 - 500 m from orders)")
def x15(spark, d):
    p, m = F.col("o_orderkey") % 8000 + 1, F.col("o_custkey") % 3000 - 500
    room = F.when((p >= 8192) | (p <= 0), F.raise_error(F.lit("the prompt fills the context")).cast("long")).otherwise(F.least(8192 - p, F.greatest(m, F.lit(0))).cast("long"))
    return orders(spark, d).select("o_orderkey", room.alias("room"))


@query("x16_selected_blocks", "select o_custkey, string_agg(o_orderpriority, chr(10) order by o_orderkey) filter (o_orderkey % 3 = 0) selected, count(*) filter (o_orderkey % 3 <> 0) kept from orders group by 1")
def x16(spark, d):
    o = orders(spark, d)
    s = F.sort_array(F.collect_list(F.when(F.col("o_orderkey") % 3 == 0, F.struct("o_orderkey", "o_orderpriority"))))
    return o.groupBy("o_custkey").agg(s.alias("s"), F.count_if(F.col("o_orderkey") % 3 != 0).alias("kept")).select("o_custkey", F.when(F.size("s") > 0, F.array_join(F.transform("s", lambda x: x["o_orderpriority"]), "\n")).alias("selected"), "kept")


@query("x17_speaker_report", "select user_id, count(*) segment_count, round(sum(value), 4) talk_time_seconds, (user_id % 8)::bigint color_index from events group by 1")
def x17(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("segment_count"), F.round(F.sum("value"), 4).alias("talk_time_seconds")).withColumn("color_index", (F.col("user_id") % 8).cast("long"))


@query("x21_progress", "select o_orderkey, case when t = 0 then 0 else least(100, d * 100 // t) end::bigint pct, least(99, case when t = 0 then 0 else least(100, d * 100 // t) end)::bigint in_flight from (select o_orderkey, o_custkey % 50 t, o_orderkey % 70 d from orders)")
def x21(spark, d):
    t, n = F.col("o_custkey") % 50, F.col("o_orderkey") % 70
    pct = F.when(t == 0, 0).otherwise(F.least(F.lit(100), F.floor(n * 100 / t))).cast("long")
    return orders(spark, d).select("o_orderkey", pct.alias("pct"), F.least(F.lit(99).cast("long"), pct).alias("in_flight"))


@query("x22_complete_files", "with want as (select p_partkey f, p_size::bigint size from part where p_partkey % 2 = 0), have as (select p_partkey f, (case when p_partkey % 6 = 0 then p_size + 1 else p_size end)::bigint size from part where p_partkey % 10 <> 0) select min(w.f) first_bad, count(*) n_bad from want w left join have h on h.f = w.f where h.size is null or h.size <> w.size")
def x22(spark, d):
    p = load(spark, d, "part")
    want = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("f"), F.col("p_size").alias("size"))
    have = p.where("p_partkey % 10 != 0").select(F.col("p_partkey").alias("f"), F.when(F.col("p_partkey") % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("found"))
    return want.join(have, "f", "left").where("found is null or found != size").agg(F.min("f").alias("first_bad"), F.count("*").alias("n_bad"))


@query("x23_digest_check", "select doc_id, doc_id % 2 = 0 valid from documents")
def x23(spark, d):
    digest = F.sha2("text", 256)
    told = F.when(F.col("doc_id") % 2 == 0, F.upper(digest)).otherwise(F.reverse(digest))
    return load(spark, d, "documents").select("doc_id", (F.lower(digest) == F.lower(told)).alias("valid"))


@query("x24_rebuild_plan", "select c_custkey, a.n::bigint attempt, a.ms::bigint wait_ms, a.n = 5 fallback from customer, (values (1, 250), (2, 1000), (3, 2000), (4, 4000), (5, 150)) a(n, ms) where c_custkey % 2 = 0 or a.n <> 5")
def x24(spark, d):
    plan = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(ms).cast("long").alias("ms")) for n, ms in ((1, 250), (2, 1000), (3, 2000), (4, 4000), (5, 150))])
    c = load(spark, d, "customer").select("c_custkey", F.explode(plan).alias("a")).where("c_custkey % 2 = 0 or a.n != 5")
    return c.select("c_custkey", F.col("a.n").alias("attempt"), F.col("a.ms").alias("wait_ms"), (F.col("a.n") == 5).alias("fallback"))


@query("x25_any_downloading", "select o_custkey, bool_or(o_orderstatus = 'O') downloading from orders group by 1")
def x25(spark, d):
    s = orders(spark, d).groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return s.select("o_custkey", F.exists("s", lambda x: x == "O").alias("downloading"))


@query("x26_size_label", "select o_orderkey, case when m = 0 then '' when m < 1024 then '~' || m || ' MiB' else '~' || printf('%.1f', floor(m / 102.4 + 0.5) / 10) || ' GiB' end label from (select o_orderkey, o_orderkey * 8 % 4096 m from orders)")
def x26(spark, d):
    m = F.col("o_orderkey") * 8 % 4096
    return orders(spark, d).select("o_orderkey", F.when(m == 0, "").when(m < 1024, F.concat(F.lit("~"), m, F.lit(" MiB"))).otherwise(F.concat(F.lit("~"), F.format_string("%.1f", m / 1024.0), F.lit(" GiB"))).alias("label"))


@query("x27_two_payloads", "select conv_id, string_agg(text, chr(10) order by turn) raw_text, string_agg(role || ': ' || text, chr(10) order by turn) labelled from conversations group by 1")
def x27(spark, d):
    s = load(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    return s.select("conv_id", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("raw_text"), F.array_join(F.transform("s", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("labelled"))
