"""Meeting store: scans, search, pagination, joins, counts, merges."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions import sql
from colloquy.functions import text as X
from colloquy.operators import merges
from colloquy.plans.registry import query
from colloquy.sources import files
from colloquy.sources.tables import MEET, SEG, load, meetings, transcripts, words
from colloquy.sources.versions import Versions, save_meetings

SECONDS = "start_ms / 1000.0 audio_start_time, end_ms / 1000.0 audio_end_time"


@query("s1_meetings_newest_first", f"with {MEET} select id, title, created_s from meet order by created_s desc")
def s1(spark, d):
    return meetings(spark, d).select("id", "title", "created_s").orderBy(F.desc("created_s"))


@query("s2_meeting_by_id", f"with {MEET} select id, title, created_s, folder_path from meet where id = 'meeting-7'")
def s2(spark, d):
    return meetings(spark, d).where("id = 'meeting-7'").limit(1)


@query("s3_segment_timing", f"with {SEG} select id, meeting_id, start_ms / 1000.0 start_s, end_ms / 1000.0 end_s, (end_ms - start_ms) / 1000.0 duration_s from seg")
def s3(spark, d):
    t = transcripts(spark, d)
    return t.select("id", "meeting_id", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration_s"))


@query("w5_running_times", f"with {SEG} select meeting_id, max(end_ms)::bigint total_ms, count(*) n_segments from seg group by 1")
def w5(spark, d):
    return transcripts(spark, d).groupBy("meeting_id").agg(F.max("end_ms").alias("total_ms"), F.count("*").alias("n_segments"))


@query("s4_transcript_json", f"with {SEG} select meeting_id, id, seq sequence_id, transcript \"text\" from seg")
def s4(spark, d):
    """The file format's nested JSON, written and parsed again."""
    one = F.struct("id", F.col("transcript").alias("text"), F.col("seq").alias("sequence_id"))
    files = transcripts(spark, d).groupBy("meeting_id").agg(F.to_json(F.struct(F.lit("1.0").alias("version"), F.count("*").alias("total_segments"), F.collect_list(one).alias("segments"))).alias("file"))
    schema = "version string, total_segments bigint, segments array<struct<id:string,text:string,sequence_id:bigint>>"
    return files.select("meeting_id", F.explode(F.from_json("file", schema)["segments"]).alias("s")).select("meeting_id", "s.id", "s.sequence_id", "s.text")


@query("s5_metadata_tolerant", "with x as (select event_id, case when event_id % 7 = 0 then left(props, 4) else props end p from events) select event_id, case when json_valid(p) then (p ->> 'k')::bigint end k from x")
def s5(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return load(spark, d, "events").select("event_id", F.from_json(raw, "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("s6_metadata_strict", "select event_id, case when trim(props) = '' then null else props ->> 'k' end field from events")
def s6(spark, d):
    """Blank fields are null; text that is no JSON stops the query."""
    checked = F.when(F.get_json_object("props", "$").isNull(), F.raise_error(F.lit("metadata is no JSON"))).otherwise(F.get_json_object("props", "$.k"))
    return load(spark, d, "events").select("event_id", F.nullif(F.trim(checked), F.lit("")).alias("field"))


FILES = """files as (select doc_id, source folder, 'audio_' || doc_id || '.' || (['mp4','txt','WAV','mp3','json','flac','m4a'])[doc_id % 7 + 1] as name, n_chars as size from documents)"""


def audio_listing(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ["mp4", "txt", "WAV", "mp3", "json", "flac", "m4a"])), (F.col("doc_id") % 7 + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", F.col("source").alias("folder"), F.concat(F.lit("audio_"), "doc_id", F.lit("."), ext).alias("name"), F.col("n_chars").alias("size"))


@query("s7_audio_files", f"with {FILES} select doc_id, name, size from files where lower(regexp_extract(name, '\\.([^.]*)$', 1)) in ('mp4','m4a','wav','mp3','flac','ogg','aac','mkv','webm','wma') and size <= 5000")
def s7(spark, d):
    return X.audio_files(audio_listing(spark, d), max_bytes=5000).select("doc_id", "name", "size")


@query("s8_first_audio_file", f"""with {FILES}, k as (select *, case lower(regexp_extract(name, '\\.([^.]*)$', 1)) when 'mp4' then 0 when 'm4a' then 1 when 'wav' then 2 when 'mp3' then 3 when 'flac' then 4 end p from files)
select folder, min_by(name, (p, name)) name from k where p is not null group by folder""")
def s8(spark, d):
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    priority = F.when(ext == "mp4", 0).when(ext == "m4a", 1).when(ext == "wav", 2).when(ext == "mp3", 3).when(ext == "flac", 4)
    listed = audio_listing(spark, d).withColumn("p", priority).where("p is not null")
    return listed.groupBy("folder").agg(F.min_by("name", F.struct("p", "name")).alias("name"))


@query("s9_rttm_lines", f"""with {SEG}, r as (select meeting_id, speaker, min(start_ms) f from seg group by 1, 2), n as (select *, row_number() over (partition by meeting_id order by f) - 1 idx from r)
select s.meeting_id, n.idx::bigint speaker_index, s.start_ms / 1000.0 onset, (s.end_ms - s.start_ms) / 1000.0 duration from seg s join n on s.meeting_id = n.meeting_id and s.speaker = n.speaker""")
def s9(spark, d):
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", "meeting_id", F.col("start_ms") / 1000, (F.col("end_ms") - F.col("start_ms")) / 1000, "speaker")
    return X.read_rttm(transcripts(spark, d).select(line.alias("value")))


@query("s12_unsaved_meetings", f"with {MEET} select id, created_s last_updated from meet where folder_path is null")
def s12(spark, d):
    return meetings(spark, d).where(F.col("folder_path").isNull()).select("id", F.col("created_s").alias("last_updated")).orderBy(F.desc("last_updated"))


@query("s13_segments_by_meeting", f"with {SEG} select id, seq from seg where meeting_id = 'meeting-3'")
def s13(spark, d):
    return transcripts(spark, d).where("meeting_id = 'meeting-3'").select("id", "seq").orderBy("seq")


@query("s14_config_singleton", "select r_regionkey::bigint id, r_name provider from region where r_regionkey = 1 limit 1")
def s14(spark, d):
    return load(spark, d, "region").where("r_regionkey = 1").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("provider")).limit(1)


@query("s11_legacy_import", "select n_nationkey::bigint id, n_name as name, null::bigint region from nation where n_nationkey % 2 = 0 union all select n_nationkey::bigint, n_name, n_regionkey::bigint from nation where n_nationkey % 2 = 1")
def s11(spark, d):
    n = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    return n.where("id % 2 = 0").select("id", "name").unionByName(n.where("id % 2 = 1"), allowMissingColumns=True)


@query("s15_current_history", f"with {SEG} select id, seq from seg where meeting_id = 'meeting-1'")
def s15(spark, d):
    return transcripts(spark, d).where("meeting_id = 'meeting-1'").select("id", "seq")


@query("s16_template_catalogue", """with t as (select n_nationkey % 10 id, 0 prio, 'custom-' || n_nationkey as name from nation where n_nationkey % 3 = 0 union all select n_nationkey % 10, 1, 'bundled-' || n_nationkey from nation where n_nationkey % 3 = 1 union all select n_nationkey % 10, 2, 'builtin-' || n_nationkey from nation where n_nationkey % 3 = 2)
select id::bigint id, min_by(name, (prio, name)) as name from t group by id""")
def s16(spark, d):
    n = load(spark, d, "nation")
    kind = F.element_at(F.array(*map(F.lit, ["custom-", "bundled-", "builtin-"])), F.col("n_nationkey") % 3 + 1)
    rows = n.select((F.col("n_nationkey") % 10).cast("long").alias("id"), (F.col("n_nationkey") % 3).alias("prio"), F.concat(kind, "n_nationkey").alias("name"))
    first = Window.partitionBy("id").orderBy("prio", "name")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").select("id", "name")


SNIPPET = """case when instr(lower(transcript), 'then') = 0 then substr(transcript, 1, 200) else
 case when instr(lower(transcript), 'then') > 101 then '...' else '' end ||
 substr(transcript, greatest(instr(lower(transcript), 'then') - 100, 1), least(instr(lower(transcript), 'then') + 103, length(transcript)) - greatest(instr(lower(transcript), 'then') - 100, 1) + 1) ||
 case when instr(lower(transcript), 'then') + 103 < length(transcript) then '...' else '' end end"""


@query("j1_p2_f1_search", f"with {SEG}, {MEET} select m.id meeting_id, m.title, s.id, {SNIPPET} match_context from seg s join meet m on m.id = s.meeting_id where lower(s.transcript) like '%then%'")
def search(spark, d):
    """Transcript search with match snippets."""
    hits = X.search(transcripts(spark, d), "transcript", "Then")
    found = hits.join(meetings(spark, d).select(F.col("id").alias("meeting_id"), "title"), "meeting_id")
    return found.select("meeting_id", "title", "id", X.match_context(F.col("transcript"), "Then").alias("match_context"))


@query("p3_ascii_fold", "select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') folded from documents")
def p3(spark, d):
    return load(spark, d, "documents").select("doc_id", X.ascii_lower(F.col("text")).alias("folded"))


@query("f2_legacy_snippet", "with x as (select doc_id, text t, instr(lower(text), 'tion') p from documents) select doc_id, substr(t, greatest(p - 1 - 100, 0) + 1, least(length(t), p - 1 + 4 + 100) - greatest(p - 1 - 100, 0)) snippet from x")
def f2(spark, d):
    return load(spark, d, "documents").select("doc_id", X.legacy_snippet(F.col("text"), "tion").alias("snippet"))


@query("j4_o8_search_fallback", f"with {SEG}, c as (select 'meeting-' || (doc_id % 200) meeting_id, doc_id, text from documents), h as (select meeting_id, id ref, 0 rank from seg where lower(transcript) like '%tion%') select meeting_id, ref, rank from h union all select meeting_id, 'doc-' || doc_id, 1 from c where lower(text) like '%tion%' and meeting_id not in (select distinct meeting_id from h)")
def j4(spark, d):
    """Transcript hits, then chunk hits of meetings that have none."""
    hits = X.search(transcripts(spark, d), "transcript", "tion").select("meeting_id", F.col("id").alias("ref"), F.lit(0).alias("rank"))
    chunks = load(spark, d, "documents").select(F.concat(F.lit("meeting-"), F.col("doc_id") % 200).alias("meeting_id"), F.concat(F.lit("doc-"), "doc_id").alias("ref"), "text")
    rest = X.search(chunks, "text", "tion").join(hits.select("meeting_id").distinct(), "meeting_id", "left_anti")
    return hits.unionByName(rest.select("meeting_id", "ref", F.lit(1).alias("rank")))


@query("a26_distinct_hits", f"with {SEG} select distinct meeting_id from seg where lower(transcript) like '%tion%'")
def a26(spark, d):
    return X.search(transcripts(spark, d), "transcript", "tion").select("meeting_id").distinct()


@query("p1_reshape", f"with {SEG} select id, transcript \"text\", {SECONDS} from seg")
def p1(spark, d):
    return transcripts(spark, d).select("id", F.col("transcript").alias("text"), (F.col("start_ms") / 1000).alias("audio_start_time"), (F.col("end_ms") / 1000).alias("audio_end_time"))


@query("p4_title_or_match", f"with {SEG}, {MEET} select id, title from meet where contains(lower(title), '12') or id in (select meeting_id from seg where contains(lower(transcript), 'then'))")
def p4(spark, d):
    m, hit = meetings(spark, d), X.search(transcripts(spark, d), "transcript", "then").select(F.col("meeting_id").alias("id")).distinct()
    return m.join(hit.withColumn("hit", F.lit(True)), "id", "left").where(F.lower("title").contains("12") | F.col("hit")).select("id", "title")


@query("p6_p7_p9_valid_segments", f"with {SEG} select id from seg where start_ms is not null and end_ms is not null and end_ms > start_ms and trim(transcript) <> ''")
def p6(spark, d):
    return transcripts(spark, d).where("start_ms is not null and end_ms is not null and end_ms > start_ms").where(F.trim("transcript") != "").select("id")


@query("p8_min_length", f"with {SEG} select id, (end_ms - start_ms) * 16 samples from seg where (end_ms - start_ms) * 16 >= 16000")
def p8(spark, d):
    return transcripts(spark, d).select("id", ((F.col("end_ms") - F.col("start_ms")) * 16).alias("samples")).where("samples >= 16000")


@query("p10_recoverable", f"with {MEET} select id from meet where created_s > 1704067200 + 5000 - 4000 and created_s < 1704067200 + 5000 - 2")
def p10(spark, d):
    now = 1704067200 + 5000
    return X.recoverable(meetings(spark, d), "created_s", now, window_s=4000).select("id")


@query("p12_status", "select o_orderkey, case when lower(s) in ('processing','pending','started') then 'processing' when lower(s) = 'completed' then 'completed' when lower(s) = 'failed' then 'error' else 'error' end status from (select o_orderkey, (['PENDING','completed','Failed','started','odd'])[o_orderkey % 5 + 1] s from orders)")
def p12(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ["PENDING", "completed", "Failed", "started", "odd"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return load(spark, d, "orders").select("o_orderkey", X.job_status(raw).alias("status"))


@query("p14_job_state", "select o_orderkey, case when o_orderkey % 4 = 0 then 'running' when s in ('queued','running') then 'interrupted' else s end state from (select o_orderkey, (['queued','running','completed','failed','cancelled'])[o_orderkey % 5 + 1] s from orders)")
def p14(spark, d):
    o = load(spark, d, "orders")
    stored = o.select("o_orderkey", F.element_at(F.array(*map(F.lit, ["queued", "running", "completed", "failed", "cancelled"])), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("stored"))
    live = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("running").alias("live"))
    return stored.join(live, "o_orderkey", "left").select("o_orderkey", F.coalesce("live", F.when(F.col("stored").isin("queued", "running"), "interrupted").otherwise(F.col("stored"))).alias("state"))


@query("p15_skip_reason", "select o_orderkey, case when o_orderkey % 3 = 0 then 'already_done' when o_totalprice < 50000 then 'too_short' when o_orderstatus = 'F' then 'no_audio' end reason from orders")
def p15(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, "already_done"), F.when(F.col("o_totalprice") < 50000, "too_short"), F.when(F.col("o_orderstatus") == "F", "no_audio")).alias("reason"))


@query("p16_summary_stale", "with u as (select o_custkey c, max(epoch(o_orderdate)) changed, max(case when o_orderstatus = 'F' then epoch(o_orderdate) end) job from orders group by 1) select c_custkey, (coalesce(u.changed, 0) is not null and u.c is not null and 1500000000 < greatest(coalesce(u.job, 0), coalesce(u.changed, 0))) stale from customer left join u on u.c = c_custkey where c_acctbal > 0")
def p16(spark, d):
    at = F.unix_timestamp("o_orderdate")
    changed = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(at).alias("changed"), F.max(F.when(F.col("o_orderstatus") == "F", at)).alias("job"))
    done = load(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    latest = F.greatest(F.coalesce("job", F.lit(0)), F.coalesce("changed", F.lit(0)))
    return done.join(changed, "c_custkey", "left").select("c_custkey", (F.col("changed").isNotNull() & (latest > 1500000000)).alias("stale"))


@query("p20_session_filter", "select event_id from events where case when user_id % 10 = 0 then true when user_id < 50 then user_id = 7 else user_id >= 60 end")
def p20(spark, d):
    keep = F.when(F.col("user_id") % 10 == 0, True).when(F.col("user_id") < 50, F.col("user_id") == 7).otherwise(F.col("user_id") >= 60)
    return load(spark, d, "events").where(keep).select("event_id")


@query("j2_label_join", f"with {SEG} select s.id, l.quality::bigint quality from seg s left join labels l on l.doc_id = s.seq * 37 + length(s.transcript)")
def j2(spark, d):
    t = transcripts(spark, d).withColumn("doc_id", F.col("seq") * 37 + F.length("transcript"))
    return t.join(load(spark, d, "labels"), "doc_id", "left").select("id", F.col("quality").cast("long").alias("quality"))


@query("j3_summary_exists", "select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def j3(spark, d):
    return load(spark, d, "orders").join(load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("j8_counts_per_speaker", f"with {SEG} select k.meeting_id, k.speaker, (select count(*) from seg s where s.meeting_id = k.meeting_id and s.speaker = k.speaker and length(s.transcript) > 300) segment_count from (select distinct meeting_id, speaker from seg) k")
def j8(spark, d):
    t = transcripts(spark, d)
    long = t.where(F.length("transcript") > 300).groupBy("meeting_id", "speaker").agg(F.count("*").alias("n"))
    return t.select("meeting_id", "speaker").distinct().join(long, ["meeting_id", "speaker"], "left").select("meeting_id", "speaker", F.coalesce("n", F.lit(0)).alias("segment_count"))


@query("j9_exists", f"with {SEG}, {MEET} select id, exists (select 1 from seg s where s.meeting_id = meet.id and s.speaker = 'system') has_system, not exists (select 1 from seg s where s.meeting_id = meet.id and s.seq > 4) is_short from meet")
def j9(spark, d):
    t = transcripts(spark, d).groupBy(F.col("meeting_id").alias("id")).agg(F.bool_or(F.col("speaker") == "system").alias("s"), F.bool_or(F.col("seq") > 4).alias("l"))
    return meetings(spark, d).join(t, "id", "left").select("id", F.coalesce("s", F.lit(False)).alias("has_system"), (~F.coalesce("l", F.lit(False))).alias("is_short"))


@query("j10_f36_labels", f"with {SEG} select id, coalesce(nullif(trim(n), ''), case when speaker = 'system' then 'Me' end, 'Speaker ' || idx) label from (select *, case speaker when 'user' then '  Ana ' when 'assistant' then ' ' end n, case speaker when 'user' then 1 when 'assistant' then 2 else 3 end idx from seg)")
def j10(spark, d):
    names = spark.createDataFrame([("user", "  Ana ", False, "S1"), ("assistant", " ", False, "S2"), ("system", None, True, "S3")], "speaker string, name string, is_self boolean, key string")
    t = transcripts(spark, d).join(F.broadcast(names), "speaker", "left")
    return t.select("id", X.speaker_label(F.col("name"), F.col("is_self"), F.col("key")).alias("label"))


@query("a1_segments_per_meeting", f"with {SEG} select meeting_id, count(*) total from seg group by 1")
def a1(spark, d):
    return transcripts(spark, d).groupBy("meeting_id").agg(F.count("*").alias("total"))


@query("a2_last_end", f"with {SEG}, {MEET} select m.id, max(s.end_ms) / 1000.0 last_end from meet m left join seg s on s.meeting_id = m.id and s.speaker = 'system' group by 1")
def a2(spark, d):
    t = transcripts(spark, d).where("speaker = 'system'").select(F.col("meeting_id").alias("id"), "end_ms")
    return meetings(spark, d).join(t, "id", "left").groupBy("id").agg((F.max("end_ms") / 1000).alias("last_end"))


@query("o1_page", f"with {SEG} select id, start_ms, (select count(*) from seg) total, 20 + 10 < (select count(*) from seg) has_more from seg order by start_ms nulls first, id limit 10 offset 20")
def o1(spark, d):
    """Page 3 of 10 rows, with the total and whether more follow."""
    t = transcripts(spark, d)
    total = t.agg(F.count("*").alias("total"))
    page = t.orderBy(F.asc_nulls_first("start_ms"), "id").offset(20).limit(10)
    return page.crossJoin(F.broadcast(total)).select("id", "start_ms", "total", (F.lit(30) < F.col("total")).alias("has_more"))


@query("o2_numeric_suffix", "select s_suppkey, row_number() over (order by coalesce(try_cast(substr(k, 2) as int), 0), s_suppkey) pos from (select s_suppkey, case when s_suppkey % 9 = 0 then 'Sx' else 'S' || (s_suppkey % 50) end k from supplier)")
def o2(spark, d):
    key = F.when(F.col("s_suppkey") % 9 == 0, "Sx").otherwise(F.concat(F.lit("S"), F.col("s_suppkey") % 50))
    rows = load(spark, d, "supplier").select("s_suppkey", X.key_number(key).alias("number"))
    return merges.ranked(rows, ["number", "s_suppkey"], "pos").select("s_suppkey", (F.col("pos") + 1).alias("pos"))


@query("o3_sort_nulls_zero", f"with {SEG} select id, row_number() over (partition by meeting_id order by coalesce(case when seq % 3 <> 0 then start_ms end, 0), seq) pos from seg")
def o3(spark, d):
    start = F.coalesce(F.when(F.col("seq") % 3 != 0, F.col("start_ms")), F.lit(0))
    return transcripts(spark, d).select("id", F.row_number().over(Window.partitionBy("meeting_id").orderBy(start, "seq")).cast("long").alias("pos"))


@query("o4_page_merge", f"with {SEG}, p as (select id, start_ms, 0 page from seg where seq < 4 union all select id, start_ms + 1, 1 from seg where seq >= 2) select id, min_by(start_ms, page) start_ms from p group by 1")
def o4(spark, d):
    """Pages appended, the first of each id kept."""
    t = transcripts(spark, d)
    pages = t.where("seq < 4").select("id", "start_ms", F.lit(0).alias("page")).unionByName(t.where("seq >= 2").select("id", F.col("start_ms") + 1, F.lit(1)).toDF("id", "start_ms", "page"))
    return pages.groupBy("id").agg(F.min_by("start_ms", "page").alias("start_ms"))


@query("o5_fetch_all", f"with {SEG} select id from seg where meeting_id = 'meeting-2'")
def o5(spark, d):
    return transcripts(spark, d).where("meeting_id = 'meeting-2'").select("id")


@query("o6_top_one", f"with {SEG} select id, end_ms from seg order by end_ms desc, id limit 1")
def o6(spark, d):
    return transcripts(spark, d).select("id", "end_ms").orderBy(F.desc("end_ms"), "id").limit(1)


@query("o7_recent_list", "with l as (select user_id, event_type, max(event_id) last from events group by 1, 2) select user_id, event_type, pos from (select *, row_number() over (partition by user_id order by last desc) pos from l) where pos <= 3")
def o7(spark, d):
    last = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    return last.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last"))).cast("long")).where("pos <= 3").select("user_id", "event_type", "pos")


@query("o9_o10_key_sets", "select s_suppkey k, s_suppkey in (select p_partkey * 2 from part) also_new from supplier where s_suppkey not in (select p_partkey * 3 from part)")
def o9(spark, d):
    parts = load(spark, d, "part")
    old = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).join(parts.select((F.col("p_partkey") * 3).alias("k")), "k", "left_anti")
    return old.join(parts.select((F.col("p_partkey") * 2).alias("k")).distinct().withColumn("also", F.lit(True)), "k", "left").select("k", F.coalesce("also", F.lit(False)).alias("also_new"))


@query("k1_k8_k9_cascade", f"with {SEG}, {MEET}, alive as (select id from meet where title not like '%5') select s.id from seg s join alive a on a.id = s.meeting_id")
def k8(spark, d):
    """Deleting meetings deletes their segments."""
    gone = meetings(spark, d).where(F.col("title").endswith("5")).select("id")
    _, children = merges.delete_cascade(meetings(spark, d), gone, "id", [(transcripts(spark, d), "meeting_id")])
    return children[0].select("id")


OLD = "old as (select c_custkey k, c_acctbal v, c_mktsegment e from customer where c_custkey % 3 <> 0)"
NEW = "new as (select c_custkey k, c_acctbal + 1 v, case when c_custkey % 2 = 0 then 'new' end e from customer where c_custkey % 5 <> 0)"


def old_new(spark, d):
    c = load(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("e"))
    new = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 1).alias("v"), F.when(F.col("c_custkey") % 2 == 0, "new").alias("e"))
    return old, new


@query("k2_upsert", f"with {OLD}, {NEW} select coalesce(new.k, old.k) k, round(case when new.k is not null then new.v else old.v end, 4) v, case when new.k is not null then new.e else old.e end e from old full join new on old.k = new.k")
def k2(spark, d):
    return merges.upsert(*old_new(spark, d), ["k"]).select("k", F.round("v", 4).alias("v"), "e")


@query("k3_upsert_keep", f"with {OLD}, {NEW} select coalesce(new.k, old.k) k, round(case when new.k is not null then new.v else old.v end, 4) v, coalesce(new.e, old.e) e from old full join new on old.k = new.k")
def k3(spark, d):
    return merges.upsert(*old_new(spark, d), ["k"], keep_if_null=["e"]).select("k", F.round("v", 4).alias("v"), "e")


@query("k4_replace_key_set", f"with {OLD}, {NEW} select new.k, round(new.v, 4) v, old.e from new left join old on old.k = new.k")
def k4(spark, d):
    old, new = old_new(spark, d)
    return merges.upsert(old, new, ["k"], keep_old=["e"], drop_missing=True).select("k", F.round("v", 4).alias("v"), "e")


RUNS = "ev as (select o_custkey m, o_orderkey t, (['pending','completed','failed','cancelled'])[o_orderkey % 4 + 1] s from orders)"


@query("k5_k6_k7_compare_and_set", f"with {RUNS}, st as (select m, max(t) start_t from ev where s = 'pending' group by 1), fin as (select ev.m, min(ev.t) t from ev join st on st.m = ev.m and ev.t > st.start_t where s <> 'pending' group by 1) select st.m, st.start_t, coalesce(e.s, 'pending') status, coalesce(e.s, 'pending') in ('failed', 'cancelled') restored from st left join fin on fin.m = st.m left join ev e on e.m = fin.m and e.t = fin.t")
def k6(spark, d):
    """The last start wins; the first end after it is final; failed and cancelled runs restore the backup."""
    events = load(spark, d, "orders").select(F.col("o_custkey").alias("m"), F.col("o_orderkey").alias("t"), F.element_at(F.array(*map(F.lit, ["pending", "completed", "failed", "cancelled"])), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("s"))
    done = merges.first_terminal(events, "m", "t", "s", "pending")
    return done.select("m", "start_t", "status", F.col("status").isin("failed", "cancelled").alias("restored"))


@query("k10_rename", f"with {MEET} select id, case when id = 'meeting-4' then 'Renamed' else title end title from meet")
def k10(spark, d):
    return meetings(spark, d).select("id", F.when(F.col("id") == "meeting-4", "Renamed").otherwise(F.col("title")).alias("title"))


@query("k11_replace_partition", f"with {SEG} select id, transcript \"text\" from seg where meeting_id <> 'meeting-2' union all select 'new-' || seq, upper(transcript) from seg where meeting_id = 'meeting-2'")
def k11(spark, d):
    t = transcripts(spark, d)
    fresh = t.where("meeting_id = 'meeting-2'").select(F.concat(F.lit("new-"), "seq").alias("id"), "meeting_id", F.upper("transcript").alias("text"))
    return merges.replace_partition(t.select("id", "meeting_id", F.col("transcript").alias("text")), fresh, "meeting_id").select("id", "text")


@query("k13_json_field", "select event_id, (props ->> 'k') k, 'de' lang from events")
def k13(spark, d):
    """One field set, the others kept."""
    e = load(spark, d, "events").select("event_id", merges.set_json_field(F.col("props"), "lang", F.lit("de")).alias("p"))
    return e.select("event_id", F.get_json_object("p", "$.k").alias("k"), F.get_json_object("p", "$.lang").alias("lang"))


@query("k14_st9_last_write_wins", "select user_id, event_type, max_by(value, event_id) last_value from events group by 1, 2")
def k14(spark, d):
    return load(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("last_value"))


@query("k20_retention", f"with {SEG}, {MEET}, gone as (select id from meet where created_s < 1704067200 + 1000 or (folder_path is not null and created_s < 1704067200 + 3000)) select id from seg where meeting_id not in (select id from gone)")
def k20(spark, d):
    m = meetings(spark, d)
    gone = m.where("created_s < 1704067200 + 1000 or (folder_path is not null and created_s < 1704067200 + 3000)").select("id")
    return merges.delete_cascade(m, gone, "id", [(transcripts(spark, d), "meeting_id")])[1][0].select("id")


@query("k21_derived_counts", f"with {SEG} select meeting_id, count(*) transcript_count, max(end_ms)::bigint last_updated from seg group by 1")
def k21(spark, d):
    return transcripts(spark, d).groupBy("meeting_id").agg(F.count("*").alias("transcript_count"), F.max("end_ms").alias("last_updated"))


@query("k22_dynamic_update", "select doc_id, case when doc_id % 2 = 0 then 'FAILED' else 'PENDING' end status, left(replace(replace(text, chr(13), ''), chr(10), ' '), 1000) error, case when doc_id % 2 = 0 then 99 end::bigint end_time from documents")
def k22(spark, d):
    doc = load(spark, d, "documents")
    return merges.update_process(doc.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "FAILED").otherwise("PENDING").alias("status"), F.col("text").alias("error")), now=99)


@query("k23_guarded_insert", "with old as (select n_nationkey id, n_name title from nation where n_nationkey < 15), new as (select n_nationkey + 5 id, n_name title from nation where n_nationkey between 8 and 22) select id::bigint id, title from new where not exists (select 1 from old where old.id = new.id or old.title = new.title)")
def k23(spark, d):
    n = load(spark, d, "nation")
    old = n.where("n_nationkey < 15").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"))
    new = n.where("n_nationkey between 8 and 22").select((F.col("n_nationkey") + 5).cast("long").alias("id"), F.col("n_name").alias("title"))
    return merges.guarded_insert(old, new, ["id", "title"])


@query("k24_settings", """with old as (select c_custkey id, 'first' provider, c_name as model, c_mktsegment first_key, null::varchar second_key from customer where c_custkey % 3 <> 0),
new as (select c_custkey id, case when c_custkey % 2 = 0 then 'first' else 'second' end provider, 'model-' || c_nationkey model from customer where c_custkey % 2 = 0 or c_custkey % 5 = 0),
u as (select coalesce(n.id, o.id) id, coalesce(n.provider, o.provider) provider, coalesce(n.model, o.model) model, o.first_key, o.second_key from old o full join new n on n.id = o.id)
select id, provider, model, case when provider = 'first' then case when id % 4 <> 0 then 'key-' || id end else first_key end first_key, case when provider = 'second' then case when id % 4 <> 0 then 'key-' || id end else second_key end second_key from u""")
def k24(spark, d):
    """Settings: provider and model upserted, keys kept; then the provider's key set, or cleared for every fourth row."""
    c = load(spark, d, "customer")
    old = c.where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("id"), F.lit("first").alias("provider"), F.col("c_name").alias("model"), F.col("c_mktsegment").alias("first_key"), F.lit(None).cast("string").alias("second_key"))
    provider = F.when(F.col("c_custkey") % 2 == 0, "first").otherwise("second")
    new = c.where("c_custkey % 2 = 0 or c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), provider.alias("provider"), F.concat(F.lit("model-"), "c_nationkey").alias("model"), F.lit(None).cast("string").alias("first_key"), F.lit(None).cast("string").alias("second_key"))
    now = merges.upsert(old, new, ["id"], keep_old=["first_key", "second_key"])
    return merges.set_by_name(now, "provider", {"first": "first_key", "second": "second_key"}, F.when(F.col("id") % 4 != 0, F.concat(F.lit("key-"), "id")))


@query("k12_atomic_sink", "select n_nationkey::bigint id, n_name as name from nation")
def k12(spark, d):
    """A table written, and replaced by a second version, which is read back."""
    store = Versions(spark, f"{files.shared_dir(spark)}/atomic-{uuid.uuid4().hex[:12]}")
    n = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    store.write({"nations": n.where("id < 3")})
    store.write({"nations": n})
    return store.read("nations")


@query("k1_k10_whole_writes", f"with {SEG}, {MEET} select s.id, s.meeting_id, case when m.title like '%7' then 'Renamed ' || m.id else m.title end title, case when m.title like '%7' then 'Renamed ' || m.id else m.title end chunk_name, s.transcript from seg s join meet m on m.id = s.meeting_id")
def k1(spark, d):
    """Meetings and segments saved in two writes, each as a whole; then some meetings renamed in both tables at once."""
    store = Versions(spark, f"{files.shared_dir(spark)}/saved-{uuid.uuid4().hex[:12]}")
    m, t = meetings(spark, d).select("id", "title"), transcripts(spark, d).select("id", "meeting_id", "transcript").join(meetings(spark, d).select(F.col("id").alias("meeting_id"), F.col("title").alias("chunk_name")), "meeting_id").select("id", "meeting_id", "chunk_name", "transcript")
    even = F.col("number") % 2 == 0
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("bigint")
    for part in (even, ~even):
        save_meetings(store, m.withColumn("number", number("id")).where(part).drop("number"), t.withColumn("number", number("meeting_id")).where(part).drop("number"))

    def renamed(meeting, segment):
        named = lambda title, key: F.when(title.endswith("7"), F.concat(F.lit("Renamed "), key)).otherwise(title)
        return {"meetings": meeting.withColumn("title", named(F.col("title"), F.col("id"))), "segments": segment.withColumn("chunk_name", named(F.col("chunk_name"), F.col("meeting_id")))}

    store.change("meetings", "segments", by=renamed)
    return store.read("segments").join(store.read("meetings").withColumnRenamed("id", "meeting_id"), "meeting_id").select("id", "meeting_id", "title", "chunk_name", "transcript")


RUN_LOG = """log as (select o_custkey m, o_orderkey t, row_number() over (partition by o_custkey order by o_orderkey, o_totalprice) i, (['start', 'completed', 'failed', 'start', 'cancelled'])[o_orderkey % 5 + 1] kind, 'summary ' || o_orderkey summary, o_orderkey % 7 = 0 stale from orders),
runs as (select distinct m, 0::bigint i, 'none' status, null::bigint started, null::varchar summary, null::varchar backup from log
  union all
  select r.m, l.i, case when l.kind = 'start' then 'pending' when r.status = 'pending' and not l.stale then l.kind else r.status end, case when l.kind = 'start' then l.t else r.started end,
         case when l.kind = 'start' or r.status <> 'pending' or l.stale then r.summary when l.kind = 'completed' then l.summary else coalesce(r.backup, r.summary) end,
         case when l.kind = 'start' then r.summary when r.status = 'pending' and not l.stale then null else r.backup end
  from runs r join log l on l.m = r.m and l.i = r.i + 1)"""


@query("k5_k7_summary_backup", f"with recursive {RUN_LOG} select m, status, started, summary, backup from runs qualify row_number() over (partition by m order by i desc) = 1")
def k5(spark, d):
    """Summaries over their runs: a start keeps a copy of the summary, a run that fails puts it back, one that completes
    drops it; what a superseded run says is ignored."""
    kind = F.element_at(F.array(*map(F.lit, ["start", "completed", "failed", "start", "cancelled"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_totalprice")
    log = load(spark, d, "orders").select(F.col("o_custkey").alias("m"), F.col("o_orderkey").alias("t"), F.row_number().over(own).alias("i"), kind.alias("kind"), F.concat(F.lit("summary "), "o_orderkey").alias("summary"), (F.col("o_orderkey") % 7 == 0).alias("stale"))
    # a run's end names its start; the stale ones name another
    begun = F.last(F.when(F.col("kind") == "start", F.col("t")), ignorenulls=True).over(Window.partitionBy("m").orderBy("i"))
    return merges.summary_states(log.withColumn("run", F.when(F.col("stale"), F.lit(-1)).otherwise(begun)), "m", "i", "t")


@query("u8_sql_functions", "select doc_id, ceil((length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) * 7 + (strlen(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) * 8) / 20)::bigint tokens, length(regexp_replace(text, '[^\\p{L}]', '', 'g'))::bigint n_letters, printf('[%02d:%02d]', n_chars // 60, n_chars % 60) shown from documents")
def u8(spark, d):
    """The functions called from SQL."""
    sql.register(spark)
    return spark.sql("select doc_id, token_estimate(text) tokens, letters(text) n_letters, clock(n_chars) shown from {docs}", docs=load(spark, d, "documents"))


@query("a8_word_metrics", f"with {SEG} select meeting_id, sum(len(string_split_regex(transcript, '\\s+')))::bigint n_words, round(case when sum(end_ms - start_ms) = 0 then 0 else sum(len(string_split_regex(transcript, '\\s+'))) / (sum(end_ms - start_ms) / 60000.0) end, 6) wpm from seg group by 1")
def a8(spark, d):
    n, ms = F.sum(F.size(F.split("transcript", r"\s+"))), F.sum(F.col("end_ms") - F.col("start_ms"))
    return transcripts(spark, d).groupBy("meeting_id").agg(n.alias("n_words"), F.round(F.when(ms == 0, 0.0).otherwise(n / (ms / 60000.0)), 6).alias("wpm"))


@query("a9_segment_stats", f"with {SEG} select meeting_id, round(avg(end_ms - start_ms) / 1000, 6) avg_s, min(end_ms - start_ms) / 1000.0 min_s, max(end_ms - start_ms) / 1000.0 max_s, sum(end_ms - start_ms) / 1000.0 total_s, round(sum(case when speaker = 'user' then end_ms - start_ms else 0 end) / sum(end_ms - start_ms), 6) speech_ratio from seg group by 1")
def a9(spark, d):
    length = F.col("end_ms") - F.col("start_ms")
    return transcripts(spark, d).groupBy("meeting_id").agg(F.round(F.avg(length) / 1000, 6).alias("avg_s"), (F.min(length) / 1000).alias("min_s"), (F.max(length) / 1000).alias("max_s"), (F.sum(length) / 1000).alias("total_s"), F.round(F.sum(F.when(F.col("speaker") == "user", length).otherwise(0)) / F.sum(length), 6).alias("speech_ratio"))


@query("f45_estimated_duration", "select doc_id, greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::bigint * 400, 500) ms from documents")
def f45(spark, d):
    return load(spark, d, "documents").select("doc_id", F.greatest(F.size(words(F.col("text"))).cast("long") * 400, F.lit(500).cast("long")).alias("ms"))
