"""Speaker identification from windows of local activity to labelled transcript segments, and its error rate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.functions.arrow import parts_of
from colloquy.operators import diarize as D
from colloquy.operators import intervals as I
from colloquy.plans.intervals import ALL, J5, RANK, new_turns, turns
from colloquy.plans.registry import query
from colloquy.sources.files import settled
from colloquy.sources.tables import load, transcripts

FRAMES_PER_WINDOW = 589


def lengths(spark, d):
    return transcripts(spark, d).groupBy(F.col("meeting_id").alias("recording")).agg((F.max("end_ms") * 16).alias("samples"))


def windows(spark, d):
    """What a segmentation model would say: in windows of 10 s every 3 s, the meeting's speakers, named anew in each window."""
    last = F.greatest(F.lit(0), F.ceil((F.col("samples") - 160_000) / 48_000))
    spans = lengths(spark, d).select("recording", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("window"))
    t = turns(spark, d).select(F.col("meeting_id").alias("recording"), (F.substring("speaker_key", 2, 1).cast("int") - 1).alias("k"), (F.col("start_ms") * 16).alias("s"), (F.col("end_ms") * 16).alias("e"))
    # a turn meets the windows that it reaches into; spans come along as rows, so there is no join
    near = t.withColumn("window", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("s") - 160_000) / 48_000)).cast("int"), F.greatest(F.lit(0), F.floor(F.col("e") / 48_000)).cast("int"))))
    rows = near.select("recording", "window", F.struct("k", "s", "e").alias("turn")).unionByName(spans.withColumn("turn", F.lit(None).cast("struct<k:int,s:bigint,e:bigint>")))
    here = rows.groupBy("recording", "window").agg(F.collect_list("turn").alias("turns"), F.max(F.col("turn").isNull()).alias("is_window")).where("is_window").drop("is_window")
    return here.mapInArrow(_activity, "recording string, window int, activity binary")


def _activity(batches):
    for batch in parts_of(batches, 1 << 17):
        n, turns = batch.num_rows, batch.column("turns")
        row = np.repeat(np.arange(n), np.diff(turns.offsets.to_numpy()))
        k, s, e = (turns.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "s", "e"))
        window = batch.column("window").to_numpy().astype(np.int64)
        # the first frame at or behind a time
        frame = lambda t: np.clip(-((window[row] * 48_000 - t) // 270), 0, FRAMES_PER_WINDOW)
        # frames at which a local speaker's turns begin and end, summed up along the window
        place = (row * D.LOCALS + (k + window[row]) % D.LOCALS) * (FRAMES_PER_WINDOW + 1)
        cells = n * D.LOCALS * (FRAMES_PER_WINDOW + 1)
        begins, ends = frame(s), np.maximum(frame(s), frame(e))
        edges = np.zeros(cells, np.int16)
        np.add.at(edges, place + begins, 1)
        np.subtract.at(edges, place + ends, 1)
        on = edges.reshape(n, D.LOCALS, -1)[:, :, :-1].cumsum(2, dtype=np.int16) > 0
        mask = np.packbits(on, axis=1, bitorder="little")[:, 0]
        at = pa.array(np.arange(n + 1, dtype=np.int32) * FRAMES_PER_WINDOW)
        activity = pa.BinaryArray.from_buffers(pa.binary(), n, [None, at.buffers()[1], pa.py_buffer(np.ascontiguousarray(mask))])
        yield pa.RecordBatch.from_arrays([batch.column("recording"), batch.column("window"), activity], ["recording", "window", "activity"])


ACTIVE = f"""{ALL},
len as (select meeting_id, max(end_ms) * 16 samples from seg group by 1),
win as (select meeting_id, samples, unnest(range(0, greatest(0, ceil((samples - 160000) / 48000.0))::bigint + 1)) w from len),
fr as (select meeting_id, samples, w, unnest(range(0, {FRAMES_PER_WINDOW})) f from win),
act as (select distinct fr.meeting_id, fr.samples, w, f, right(speaker_key, 1)::int - 1 k from fr join turns t on t.meeting_id = fr.meeting_id and t.start_ms * 16 <= w * 48000 + f * 270 and w * 48000 + f * 270 < t.end_ms * 16),
solo as (select meeting_id, w, f, max(k) k from act group by 1, 2, 3 having count(*) = 1),
runs as (select meeting_id, w, k, f, f - row_number() over (partition by meeting_id, w, k order by f) island from solo),
spans as (select meeting_id, w, k, min(f) a, max(f) + 1 b, count(*) n from runs group by meeting_id, w, k, island),
jobs as (select meeting_id, w, k, sum(n)::int clean, list(struct_pack("start" := floor(a / {FRAMES_PER_WINDOW}.0::double * 160000)::bigint + w * 48000, "end" := floor(least(b, {FRAMES_PER_WINDOW - 1}) / {FRAMES_PER_WINDOW}.0::double * 160000)::bigint + w * 48000) order by a) ranges from spans group by 1, 2, 3 having sum(n) >= 10)"""

VOTED = f"""{ACTIVE},
grid as (select meeting_id, floor(w * 48000 / 270.0::double + 0.5)::bigint + f g, max(samples) samples, count(*) covered from fr group by 1, 2),
spoke as (select meeting_id, floor(w * 48000 / 270.0::double + 0.5)::bigint + f g, count(*) n from act group by 1, 2),
votes as (select act.meeting_id, floor(act.w * 48000 / 270.0::double + 0.5)::bigint + f g, act.k, count(*) v from act join jobs on jobs.meeting_id = act.meeting_id and jobs.w = act.w and jobs.k = act.k group by 1, 2, 3),
first_job as (select meeting_id, k, row_number() over (partition by meeting_id order by min(w * 3 + (k + w) % 3)) c from jobs group by meeting_id, k),
ranked as (select v.meeting_id, v.g, v.k, row_number() over (partition by v.meeting_id, v.g order by v.v desc, c) r, floor(s.n / d.covered::double + 0.5) many
           from votes v join first_job using (meeting_id, k) join spoke s on s.meeting_id = v.meeting_id and s.g = v.g join grid d on d.meeting_id = v.meeting_id and d.g = v.g where v.g <= d.samples // 270),
kept as (select meeting_id, k, g, g - row_number() over (partition by meeting_id, k order by g) island from ranked where r <= many)"""


@query("e11_embed_ranges", f"{ACTIVE} select recording, \"window\", \"local\", clean, r['start'] \"start\", r['end'] \"end\" from (select meeting_id recording, w \"window\", (k + w) % 3 \"local\", clean, unnest(ranges) r from jobs)")
def e11(spark, d):
    """Sample ranges in which each window's local speakers speak alone."""
    return D.embed_jobs(windows(spark, d)).select("recording", "window", "local", "clean", F.explode("ranges").alias("r")).select("recording", "window", "local", "clean", "r.*")


@query("a14_w11_speaker_runs", f"{VOTED} select meeting_id recording, k::bigint speaker, min(g) \"first\", max(g) + 1 \"end\" from kept group by meeting_id, k, island")
def a14(spark, d):
    """Runs of frames in which each speaker is one of as many as the windows say on average. The mapping is the windows' own."""
    said = settled(windows(spark, d), "windows")
    jobs = D.embed_jobs(said).withColumn("k", F.pmod(F.col("local") - F.col("window"), F.lit(3)))
    # numbered by their first job, as clusters are
    first = jobs.groupBy("recording", "k").agg(F.min(F.col("window") * 3 + F.col("local")).alias("speaker"))
    mapping = jobs.join(first, ["recording", "k"]).select("recording", "window", "local", "speaker")
    runs = D.speaker_runs(said, mapping, lengths(spark, d))
    named = runs.join(first.withColumn("speaker", F.col("speaker").cast("bigint")), ["recording", "speaker"]).select("recording", F.col("k").cast("bigint").alias("speaker"), "first", "end")
    return I.merge_runs(named, ["recording", "speaker"], "first", "end", 1, 0)


def embedded(spark, d, said):
    """Jobs with a stand-in for a voice model: a speaker's vector, in a block of its own, with noise that differs by window."""
    jobs = D.embed_jobs(said).withColumn("k", F.pmod(F.col("local") - F.col("window"), F.lit(3)))
    v = load(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: F.lit(1.0) + x.cast("double") * 0.05).alias("v"))
    count = v.agg((F.max("vec_id") + 1).alias("vectors"))
    number = F.regexp_extract("recording", "([0-9]+)$", 1).cast("bigint")
    picked = jobs.join(F.broadcast(count)).withColumn("vec_id", F.pmod(number * 31 + F.col("window") * 7, F.col("vectors"))).join(v, "vec_id")
    block = lambda i: F.when(F.col("k") == i, F.col("v")).otherwise(F.array_repeat(F.lit(0.0), F.size("v")))
    return picked.select("recording", "window", "local", "clean", F.concat(*(block(i) for i in range(3))).alias("e"))


#: Each cluster is one speaker, so the twin knows whom the turns belong to.
CHAIN = f"""{VOTED},
voted as (select meeting_id, k, min(g) * 270 s, (max(g) + 1) * 270 e from kept group by meeting_id, k, island),
apart as (select *, sum(case when b is null or s - b >= 8000 then 1 else 0 end) over (partition by meeting_id, k order by s rows between unbounded preceding and current row) part from (select *, lag(e) over (partition by meeting_id, k order by s) b from voted)),
heard as (select meeting_id, k, floor((min(s) + 495.5) * 1000 / 16000)::bigint start_ms, floor((max(e) + 495.5) * 1000 / 16000)::bigint end_ms from apart group by meeting_id, k, part having max(e) - min(s) > 1600),
mapped as (select meeting_id, 'S' || (k + 1) speaker_key, unnest([start_ms, end_ms]) ms, k, start_ms id, unnest([0, 1]) edge from heard),
clocked as (select meeting_id, speaker_key, id, edge, round((floor(x / 1441792) * 1440000 + least(greatest(x - floor(x / 1441792) * 1441792 - 1024, 0), 1440000)) / 48000 * 1000)::bigint ms from (select *, ms / 1000.0::double * 48000 x from mapped)),
said as (select meeting_id, speaker_key, min(ms) start_ms, max(ms) end_ms from clocked group by meeting_id, speaker_key, id)"""


def diarized(spark, d):
    """Turns from activity alone (E11, E8, E9, J13, A14, W1)."""
    said = settled(windows(spark, d), "windows")
    return D.diarize(said, embedded(spark, d, said), lengths(spark, d), long=10, min_size=1, min_share=0.0)


@query("e14_diarized_segments", CHAIN + ", " + J5[len(ALL) + 1 :].replace("from turns", "from said").replace("join turns", "join said"))
def e14(spark, d):
    """The whole chain: turns, with the keys that earlier turns had (J7), on the transcript's clock (J6), and each segment's
    speaker (J5)."""
    new = settled(diarized(spark, d), "turns").withColumnRenamed("recording", "meeting_id").withColumn("speaker", F.col("speaker").cast("int"))
    old = turns(spark, d)
    keys = I.stable_labels(I.overlap_matrix(new, old), new.groupBy("meeting_id").agg((F.max("speaker") + 1).alias("n")), old.select("meeting_id", "speaker_key"))
    clock = lambda c: F.round(I.file_to_transcript(F.col(c) / 1000) * 1000).cast("bigint").alias(c)
    said = new.join(keys, ["meeting_id", "speaker"]).select("meeting_id", "speaker_key", clock("start_ms"), clock("end_ms"))
    out = I.assign_speakers(transcripts(spark, d), said)
    return out.select("meeting_id", "id", "speaker_key", F.round("overlap", 6).alias("overlap"))


@query("a22_error_rate", f"""{ALL},
hyp as (select meeting_id, case speaker_key when 'S1' then 1 when 'S2' then 0 else 2 end k, start_ms + 700 s, end_ms + 700 e from turns union all select meeting_id, 3, end_ms, end_ms + 1200 from turns where speaker_key = 'S1'),
r as (select distinct meeting_id, unnest(range(greatest(0, floor((start_ms + 5) / 10.0)::bigint), greatest(0, floor((end_ms + 5) / 10.0)::bigint))) f, speaker_key k from turns),
h as (select distinct meeting_id, unnest(range(greatest(0, floor((s + 5) / 10.0)::bigint), greatest(0, floor((e + 5) / 10.0)::bigint))) f, k from hyp),
o as (select h.meeting_id, h.k, r.k rk, count(*) n from h join r on r.meeting_id = h.meeting_id and r.f = h.f group by 1, 2, 3),
x as (select meeting_id, k, rk, n from o union all select m.meeting_id, s, null, 0 from (select distinct meeting_id from h) m, range(0, 4) t(s)),
p as (select a.meeting_id, [a.rk, b.rk, c.rk, d.rk] rks, row_number() over (partition by a.meeting_id order by a.n + b.n + c.n + d.n desc) r
      from x a join x b on b.meeting_id = a.meeting_id and b.k = 1 join x c on c.meeting_id = a.meeting_id and c.k = 2 join x d on d.meeting_id = a.meeting_id and d.k = 3 where a.k = 0
      and coalesce(b.rk <> a.rk, true) and coalesce(c.rk <> a.rk, true) and coalesce(c.rk <> b.rk, true) and coalesce(d.rk <> a.rk, true) and coalesce(d.rk <> b.rk, true) and coalesce(d.rk <> c.rk, true)),
good as (select h.meeting_id, h.f, count(*) n from h join p on p.meeting_id = h.meeting_id and p.r = 1 join r on r.meeting_id = h.meeting_id and r.f = h.f and r.k = p.rks[h.k + 1] group by 1, 2),
nr as (select meeting_id, f, count(*) n from r group by 1, 2), nh as (select meeting_id, f, count(*) n from h group by 1, 2),
a as (select coalesce(nr.meeting_id, nh.meeting_id) meeting_id, coalesce(nr.f, nh.f) f, coalesce(nr.n, 0) r, coalesce(nh.n, 0) h from nr full join nh on nh.meeting_id = nr.meeting_id and nh.f = nr.f)
select a.meeting_id recording, sum(r)::bigint speech, sum(greatest(r - h, 0))::bigint missed, sum(greatest(h - r, 0))::bigint false_alarm, sum(least(r, h) - coalesce(good.n, 0))::bigint confused,
       round((sum(greatest(r - h, 0)) + sum(greatest(h - r, 0)) + sum(least(r, h) - coalesce(good.n, 0)))::double / greatest(sum(r), 1)::double, 9) rate
from a left join good on good.meeting_id = a.meeting_id and good.f = a.f group by 1""")
def a22(spark, d):
    """Turns that come late, under other names, with a speaker who isn't there, against the reference."""
    ref = turns(spark, d).select(F.col("meeting_id").alias("recording"), F.col("speaker_key").alias("speaker"), "start_ms", "end_ms")
    hyp = new_turns(spark, d).withColumnRenamed("meeting_id", "recording")
    ghost = ref.where("speaker = 'S1'").select("recording", F.lit(3).alias("speaker"), F.col("end_ms").alias("start_ms"), (F.col("end_ms") + 1200).alias("end_ms"))
    return D.error_rate(ref, hyp.unionByName(ghost)).withColumn("rate", F.round("rate", 9))
