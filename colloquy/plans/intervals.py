"""Speaker turns against transcript segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import diarize as D
from colloquy.operators import intervals as I
from colloquy.plans.registry import query
from colloquy.sources.tables import RAW, SEG, TURNS, load, raw_turns, role_key, transcripts


def turns(spark, d):
    return I.merge_runs(raw_turns(spark, d), ["meeting_id", "speaker_key"], "start_ms", "end_ms", 500, 100)


ALL = f"with {SEG}, {RAW}, {TURNS}"


@query("w1_merge_turns", f"{ALL} select meeting_id, speaker_key, start_ms, end_ms from turns")
def w1(spark, d):
    return turns(spark, d)


@query("a4_union_length", f"{ALL}, u0 as (select *, max(end_ms) over (partition by meeting_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) r from raw) select meeting_id, sum(greatest(0, end_ms - greatest(start_ms, coalesce(r, start_ms))))::bigint covered_ms from u0 group by 1")
def a4(spark, d):
    return I.union_length(raw_turns(spark, d), ["meeting_id"], "start_ms", "end_ms", "covered_ms")


RANK = "rk as (select meeting_id, speaker_key, row_number() over (partition by meeting_id order by min(start_ms), min(end_ms), speaker_key) - 1 idx from turns group by 1, 2)"


@query("a3_speech_per_speaker", f"{ALL}, {RANK} select t.meeting_id, rk.idx speaker_index, sum(t.end_ms - t.start_ms)::bigint speech_ms from turns t join rk on rk.meeting_id = t.meeting_id and rk.speaker_key = t.speaker_key group by 1, 2")
def a3(spark, d):
    t = turns(spark, d)
    joined = t.join(I.speaker_rank(t), ["meeting_id", "speaker_key"])
    return joined.groupBy("meeting_id", F.col("speaker_index").cast("long").alias("speaker_index")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))


J5 = f"""{ALL}, {RANK},
p as (select s.meeting_id, s.id, s.start_ms s, s.end_ms e, t.speaker_key k, rk.idx, sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) total
      from seg s join turns t on t.meeting_id = s.meeting_id and t.start_ms < s.end_ms and t.end_ms > s.start_ms join rk on rk.meeting_id = t.meeting_id and rk.speaker_key = t.speaker_key where s.end_ms > s.start_ms group by all),
best as (select *, row_number() over (partition by meeting_id, id order by total desc, idx) r from p),
near as (select s.meeting_id, s.id, t.speaker_key k, row_number() over (partition by s.meeting_id, s.id order by greatest(0, t.start_ms - s.end_ms, s.start_ms - t.end_ms), t.start_ms, t.end_ms, rk.idx) r
      from seg s join turns t on t.meeting_id = s.meeting_id join rk on rk.meeting_id = t.meeting_id and rk.speaker_key = t.speaker_key
      where s.end_ms > s.start_ms and greatest(0, t.start_ms - s.end_ms, s.start_ms - t.end_ms) <= 1000 and not exists (select 1 from p where p.meeting_id = s.meeting_id and p.id = s.id))
select meeting_id, id, k speaker_key, round(least(1.0, total / (e - s)), 6)::double overlap from best where r = 1
union all select meeting_id, id, k, 0.0::double from near where r = 1"""


@query("j5_overlap_assign", J5)
def j5(spark, d):
    """Who speaks in each segment: by overlap, else the nearest turn within a second."""
    out = I.assign_speakers(transcripts(spark, d), turns(spark, d))
    return out.select("meeting_id", "id", "speaker_key", F.round("overlap", 6).alias("overlap"))


GAPPY = "rare as (select meeting_id, speaker_key, start_ms, start_ms + 400 end_ms from turns)"


@query("j5b_nearest_turn", f"""{ALL}, {GAPPY}, rk as (select meeting_id, speaker_key, row_number() over (partition by meeting_id order by min(start_ms), min(end_ms), speaker_key) - 1 idx from rare group by 1, 2),
g as (select s.meeting_id, s.id, t.speaker_key k, greatest(0, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) part, greatest(0, t.start_ms - s.end_ms, s.start_ms - t.end_ms) gap, t.start_ms ts, t.end_ms te, rk.idx, s.end_ms - s.start_ms len from seg s join rare t on t.meeting_id = s.meeting_id join rk on rk.meeting_id = t.meeting_id and rk.speaker_key = t.speaker_key),
o as (select meeting_id, id, k, idx, sum(part) total, max(len) len from g group by all having sum(part) > 0),
o1 as (select *, row_number() over (partition by meeting_id, id order by total desc, idx) r from o),
n as (select *, row_number() over (partition by meeting_id, id order by gap, ts, te, idx) r from g where gap <= 1000 and not exists (select 1 from o where o.meeting_id = g.meeting_id and o.id = g.id))
select meeting_id, id, k speaker_key, round(least(1.0, total / len), 6)::double overlap from o1 where r = 1 union all select meeting_id, id, k, 0.0::double from n where r = 1""")
def j5b(spark, d):
    """Short turns, so that most segments fall back to the nearest one or are dropped."""
    short = turns(spark, d).withColumn("end_ms", F.col("start_ms") + 400)
    out = I.assign_speakers(transcripts(spark, d), short)
    return out.select("meeting_id", "id", "speaker_key", F.round("overlap", 6).alias("overlap"))


@query("j5c_speaker_order", f"{ALL}, {RANK} select meeting_id, speaker_key, idx speaker_index from rk")
def j5c(spark, d):
    return I.speaker_rank(turns(spark, d)).withColumn("speaker_index", F.col("speaker_index").cast("long"))


@query("j6_clock_map", "select event_id, round((k * 1440000 + least(greatest(s - k * 1441792 - 1024, 0), 1440000)) / 48000, 6) transcript_s from (select event_id, value * 48000 * 10 s, floor(value * 48000 * 10 / 1441792) k from events)")
def j6(spark, d):
    return load(spark, d, "events").select("event_id", F.round(I.file_to_transcript(F.col("value") * 10), 6).alias("transcript_s"))


def new_turns(spark, d):
    return turns(spark, d).select("meeting_id", F.when(F.col("speaker_key") == "S1", 1).when(F.col("speaker_key") == "S2", 0).otherwise(2).alias("speaker"), (F.col("start_ms") + 700).alias("start_ms"), (F.col("end_ms") + 700).alias("end_ms"))


@query("j7_overlap_matrix", f"{ALL}, n as (select meeting_id, case speaker_key when 'S1' then 1 when 'S2' then 0 else 2 end speaker, start_ms + 700 s, end_ms + 700 e from turns) select n.meeting_id, n.speaker::bigint speaker, t.speaker_key, sum(least(n.e, t.end_ms) - greatest(n.s, t.start_ms))::bigint overlap_ms from n join turns t on t.meeting_id = n.meeting_id and n.s < t.end_ms and t.start_ms < n.e group by 1, 2, 3")
def j7(spark, d):
    return I.overlap_matrix(new_turns(spark, d), turns(spark, d)).withColumn("speaker", F.col("speaker").cast("long"))


@query("j7_o11_stable_labels", f"""with recursive {SEG}, {RAW}, {TURNS}, n as (select meeting_id, case speaker_key when 'S1' then 1 when 'S2' then 0 else 2 end speaker, start_ms + 700 s, end_ms + 700 e from turns),
m as (select n.meeting_id, n.speaker, t.speaker_key k, sum(least(n.e, t.end_ms) - greatest(n.s, t.start_ms)) o from n join turns t on t.meeting_id = n.meeting_id and n.s < t.end_ms and t.start_ms < n.e group by 1, 2, 3),
q as (select *, row_number() over (partition by meeting_id order by o desc, speaker, k) r from m),
g as (select distinct meeting_id, 0::bigint r, []::integer[] sp, []::varchar[] ks from n
      union all select g.meeting_id, q.r, case when list_contains(sp, q.speaker) or list_contains(ks, q.k) then sp else list_append(sp, q.speaker) end, case when list_contains(sp, q.speaker) or list_contains(ks, q.k) then ks else list_append(ks, q.k) end from g join q on q.meeting_id = g.meeting_id and q.r = g.r + 1),
l as (select meeting_id, arg_max(sp, r) sp, arg_max(ks, r) ks from g group by 1),
a as (select meeting_id, unnest(sp) speaker, unnest(ks) k from l),
z as (select meeting_id, unnest(range(0, max(speaker) + 1)) speaker from n group by 1),
free as (select meeting_id, 'S' || i k, row_number() over (partition by meeting_id order by i) p from (select distinct meeting_id from n) n, range(1, 20) t(i) where not exists (select 1 from turns t where t.meeting_id = n.meeting_id and t.speaker_key = 'S' || i)),
rest as (select meeting_id, speaker, row_number() over (partition by meeting_id order by speaker) p from z where not exists (select 1 from a where a.meeting_id = z.meeting_id and a.speaker = z.speaker))
select meeting_id, speaker::int speaker, k speaker_key from a union all select rest.meeting_id, speaker::int, k from rest join free on free.meeting_id = rest.meeting_id and free.p = rest.p""")
def j7b(spark, d):
    """New speakers take over previous keys, one to one."""
    new, old = new_turns(spark, d), turns(spark, d)
    return I.stable_labels(I.overlap_matrix(new, old), new.groupBy("meeting_id").agg((F.max("speaker") + 1).alias("n")), old.select("meeting_id", "speaker_key"))


@query("p11_mixed_speech", J5.replace("select meeting_id, id, k speaker_key, round(least(1.0, total / (e - s)), 6)::double overlap from best where r = 1\nunion all select meeting_id, id, k, 0.0::double from near where r = 1", "select s.id, coalesce(b.total / (b.e - b.s) < 0.6, false) mixed from seg s left join best b on b.id = s.id and b.meeting_id = s.meeting_id and b.r = 1 where not exists (select 1 from near where near.id = s.id and near.r = 1)\nunion all select id, true from near where r = 1"))
def p11(spark, d):
    t = transcripts(spark, d)
    o = I.assign_speakers(t, turns(spark, d)).select("meeting_id", "id", "overlap")
    return t.join(o, ["meeting_id", "id"], "left").select("id", F.coalesce(F.col("overlap") < 0.6, F.lit(False)).alias("mixed"))


@query("e12_merge_speakers", f"{ALL}, mv as (select meeting_id, case when speaker_key = 'S3' then 'S2' else speaker_key end speaker_key, start_ms, end_ms from turns), u0 as (select *, max(end_ms) over (partition by meeting_id, speaker_key order by start_ms, end_ms rows between unbounded preceding and 1 preceding) r from mv) select meeting_id, speaker_key, sum(greatest(0, end_ms - greatest(start_ms, coalesce(r, start_ms))))::bigint talk_ms from u0 group by 1, 2")
def e12(spark, d):
    """S3 merged into S2: turns move over, talk time counts overlaps once."""
    moved = turns(spark, d).withColumn("speaker_key", F.when(F.col("speaker_key") == "S3", "S2").otherwise(F.col("speaker_key")))
    return I.union_length(moved, ["meeting_id", "speaker_key"], "start_ms", "end_ms", "talk_ms")


@query("x18_duration", f"{ALL} select meeting_id, coalesce(case when count(*) % 3 = 0 and count(*) > 3 then count(*) * 10.0 end, max(end_ms) / 1000.0)::double duration_s from seg group by 1")
def x18(spark, d):
    n = F.count("*")
    return transcripts(spark, d).groupBy("meeting_id").agg(F.coalesce(F.when((n % 3 == 0) & (n > 3), n * 10.0), F.max("end_ms") / 1000).alias("duration_s"))


@query("x19_status_view", f"{ALL}, c as (select meeting_id, count(distinct speaker_key) n, sum(end_ms - start_ms)::bigint speech from turns group by 1) select s.meeting_id, count(*) segments, coalesce(max(c.n), 0) speakers, coalesce(max(c.speech), 0)::bigint speech_ms, max(s.end_ms)::bigint duration_ms from seg s left join c on c.meeting_id = s.meeting_id group by 1")
def x19(spark, d):
    seg = transcripts(spark, d).groupBy("meeting_id").agg(F.count("*").alias("segments"), F.max("end_ms").alias("duration_ms"))
    talk = turns(spark, d).groupBy("meeting_id").agg(F.count_distinct("speaker_key").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech"))
    return seg.join(talk, "meeting_id", "left").select("meeting_id", "segments", F.coalesce("n", F.lit(0)).alias("speakers"), F.coalesce("speech", F.lit(0)).alias("speech_ms"), "duration_ms")


FRAMES = "f as (select meeting_id, speaker_key k, unnest(range(ceil(start_ms / 100.0)::bigint, ceil(end_ms / 100.0)::bigint)) f from turns), h as (select meeting_id, case speaker_key when 'S1' then 'H1' when 'S2' then 'H2' else 'H3' end k, unnest(range(ceil((start_ms + 300) / 100.0)::bigint, ceil((end_ms + 300) / 100.0)::bigint)) f from turns)"


@query("a22_frame_errors", f"{ALL}, {FRAMES}, a as (select meeting_id, f, count(*) n from (select distinct meeting_id, f, k from f) group by 1, 2), b as (select meeting_id, f, count(*) n from (select distinct meeting_id, f, k from h) group by 1, 2), c as (select f.meeting_id, f.f, count(*) n from (select distinct * from f) f join (select distinct * from h) h on h.meeting_id = f.meeting_id and h.f = f.f and right(h.k, 1) = right(f.k, 1) group by 1, 2) select a.meeting_id, sum(a.n)::bigint reference, sum(greatest(a.n - coalesce(b.n, 0), 0))::bigint missed, sum(least(a.n, coalesce(b.n, 0)) - coalesce(c.n, 0))::bigint confused from a left join b on a.meeting_id = b.meeting_id and a.f = b.f left join c on a.meeting_id = c.meeting_id and a.f = c.f group by 1")
def a22(spark, d):
    """Missed and confused speech on 100 ms frames against shifted turns, whose speakers are mapped to the reference's."""
    t = turns(spark, d)

    def frames(shift):
        first, end = F.ceil((F.col("start_ms") + shift) / 100), F.ceil((F.col("end_ms") + shift) / 100)
        runs = t.select(F.col("meeting_id").alias("recording"), F.col("speaker_key").alias("who"), first.alias("s"), end.alias("e")).where("e > s")
        return I.merge_runs(runs, ["recording", "who"], "s", "e", 1, 0)

    return D.count_errors(frames(0), frames(300)).where("speech > 0").select(F.col("recording").alias("meeting_id"), F.col("speech").alias("reference"), "missed", "confused")


@query("a14_w11_frame_votes", f"{ALL}, f as (select meeting_id, speaker_key k, unnest(range(start_ms // 1000, end_ms // 1000 + 1)) f from raw), v as (select meeting_id, f, k, count(*) n from f group by all), r as (select *, row_number() over (partition by meeting_id, f order by n desc, k) r from v) select meeting_id, f::bigint frame, k speaker_key from r where r <= 1")
def a14(spark, d):
    """The best supported speaker of each second."""
    f = raw_turns(spark, d).select("meeting_id", "speaker_key", F.explode(F.sequence(F.floor(F.col("start_ms") / 1000), F.floor(F.col("end_ms") / 1000))).alias("frame"))
    votes = f.groupBy("meeting_id", "frame", "speaker_key").agg(F.count("*").alias("n"))
    return votes.withColumn("r", F.row_number().over(Window.partitionBy("meeting_id", "frame").orderBy(F.desc("n"), "speaker_key"))).where("r <= 1").select("meeting_id", "frame", "speaker_key")


@query("w2_run_lengths", f"with {SEG}, n as (select meeting_id, speaker, seq, row_number() over (partition by meeting_id order by seq) - row_number() over (partition by meeting_id, speaker order by seq) g from seg) select meeting_id, speaker, min(seq) first_seq, count(*) n from n group by meeting_id, speaker, g")
def w2(spark, d):
    g = F.row_number().over(Window.partitionBy("meeting_id").orderBy("seq")) - F.row_number().over(Window.partitionBy("meeting_id", "speaker").orderBy("seq"))
    return transcripts(spark, d).withColumn("g", g).groupBy("meeting_id", "speaker", "g").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n")).drop("g")


@query("w9_analysis_windows", f"with {SEG}, m as (select meeting_id, max(end_ms)::bigint n from seg group by 1), w as (select meeting_id, n, unnest(case when n <= 10000 then [0] else range(0, n - 10000 + 1, 3000) || (case when (n - 10000) % 3000 <> 0 then [((n - 10000) // 3000 + 1) * 3000] else [] end) end) s from m) select meeting_id, s::bigint start_ms, least(s + 10000, n) - s filled_ms from w")
def w9(spark, d):
    """Windows of 10 s every 3 s; the last one is padded."""
    m = transcripts(spark, d).groupBy("meeting_id").agg(F.max("end_ms").alias("n"))
    last = F.when(F.col("n") <= 10000, 0).otherwise(F.ceil((F.col("n") - 10000) / 3000) * 3000).cast("long")
    w = m.select("meeting_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(3000).cast("long"))).alias("start_ms"))
    return w.select("meeting_id", "start_ms", (F.least(F.col("start_ms") + 10000, F.col("n")) - F.col("start_ms")).alias("filled_ms"))
