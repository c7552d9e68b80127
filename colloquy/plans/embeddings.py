"""Speaker embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions import audio as A
from colloquy.operators import vectors as V
from colloquy.plans.registry import query
from colloquy.sources.tables import RAW, SEG, TURNS, load


def vecs(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")


VEC = "v as (select vec_id, list_transform(embedding, lambda x: x::double) e, label from embeddings)"
CENT = f"""{VEC}, pl as (select label, unnest(e) x, generate_subscripts(e, 1) i from v), pm as (select label, i, avg(x) m from pl group by 1, 2),
c0 as (select label, list(m order by i) c from pm group by 1), cent as (select label, list_transform(c, lambda x: x / greatest(sqrt(list_sum(list_transform(c, lambda y: y * y))), 1e-12)) c from c0)"""


@query("e1_cosine", f"with {VEC} select a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) cosine from v a join v b on b.vec_id = a.vec_id + 1")
def e1(spark, d):
    v = vecs(spark, d)
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(b, "vec_id").select("vec_id", A.rounded(V.cosine(F.col("e"), F.col("f")), 6).alias("cosine"))


@query("e2_unit", f"with {VEC} select vec_id, list_transform(e, lambda x: round(x * 3 / greatest(sqrt(list_sum(list_transform(e, lambda y: 9 * y * y))), 1e-12), 6)) unit from v")
def e2(spark, d):
    return vecs(spark, d).select("vec_id", F.transform(V.unit(F.transform("e", lambda x: x * 3)), lambda x: A.rounded(x, 6)).alias("unit"))


@query("a12_e5_weighted_profile", f"with {VEC}, pl as (select vec_id, label, (vec_id % 50)::double w, unnest(e) x, generate_subscripts(e, 1) i from v where vec_id % 50 >= 10), pm as (select label, i, sum(x * w) / sum(w) m from pl group by 1, 2), c0 as (select label, list(m order by i) c from pm group by 1) select label::bigint label, list_transform(c, lambda x: round(x / greatest(sqrt(list_sum(list_transform(c, lambda y: y * y))), 1e-12), 5)) profile from c0")
def a12(spark, d):
    """Profiles from sources with at least ten seconds, weighted by their seconds."""
    rows = vecs(spark, d).withColumn("secs", (F.col("vec_id") % 50).cast("double"))
    return V.mean_vector(rows.where("secs >= 10"), "label", "e", F.col("secs")).select(F.col("label").cast("long").alias("label"), F.transform("centroid", lambda x: A.rounded(x, 5)).alias("profile"))


@query("a13_centroids", f"with {CENT} select label::bigint label, list_transform(c, lambda x: round(x, 5)) centroid from cent")
def a13(spark, d):
    return V.mean_vector(vecs(spark, d), "label", "e").select(F.col("label").cast("long").alias("label"), F.transform("centroid", lambda x: A.rounded(x, 5)).alias("centroid"))


MATCH = f"{CENT}, p as (select c from cent where label = 0), s as (select label % 3 g, label, list_cosine_similarity(cent.c, p.c) sim from cent, p), r as (select *, row_number() over (partition by g order by sim desc, label desc) r, lead(sim) over (partition by g order by sim desc, label desc) nx from s)"


@query("e3_match_self", f"with {MATCH} select g::bigint g, label::bigint label, round(sim, 5) similarity, case when sim >= 0.5 and sim - coalesce(nx, '-inf'::double) >= 0.15 then 'Auto' when sim >= 0.35 then 'Suggest' else 'None' end decision from r where r = 1")
def e3(spark, d):
    cents = V.mean_vector(vecs(spark, d), "label", "e")
    m = V.match_self(cents.withColumn("g", (F.col("label") % 3).cast("long")), cents.where("label = 0"), "g", "label")
    return m.select("g", F.col("label").cast("long").alias("label"), A.rounded(F.col("similarity"), 5).alias("similarity"), "decision")


@query("e4_apply_match", f"with {MATCH} select g::bigint g, label::bigint label from r where r = 1 and sim >= 0.5 and sim - coalesce(nx, '-inf'::double) >= 0.15 and g not in (select label % 3 from v where label = 4)")
def e4(spark, d):
    """Only where a group has no self yet."""
    has_self = vecs(spark, d).where("label = 4").select((F.col("label") % 3).cast("long").alias("g")).distinct()
    return e3(spark, d).where("decision = 'Auto'").join(has_self, "g", "left_anti").select("g", "label")


@query("e6_forget_profile", "select vec_id, case when label <> 0 then len(embedding) end::bigint kept from embeddings")
def e6(spark, d):
    return vecs(spark, d).select("vec_id", F.when(F.col("label") != 0, F.size("e")).cast("long").alias("kept"))


@query("e7_distances", f"with {VEC}, q as (select *, vec_id // 25 g from v) select a.vec_id a, b.vec_id b, round(greatest(0, 1 - list_cosine_similarity(a.e, b.e)), 6) distance from q a join q b on a.g = b.g and a.vec_id < b.vec_id")
def e7(spark, d):
    """Within recordings of 25 embeddings."""
    q = vecs(spark, d).withColumn("g", F.floor(F.col("vec_id") / 25))
    a, b = q.select("g", F.col("vec_id").alias("a"), F.col("e").alias("x")), q.select("g", F.col("vec_id").alias("b"), F.col("e").alias("y"))
    return a.join(b, "g").where("a < b").select("a", "b", A.rounded(F.greatest(F.lit(0.0), 1 - V.cosine(F.col("x"), F.col("y"))), 6).alias("distance"))


def recordings(spark, d):
    return vecs(spark, d).withColumn("recording", F.floor(F.col("vec_id") / 40)).withColumn("frames", F.col("vec_id") % 90)


@query("e8_e10_cluster")
def e8(spark, d):
    """Average linkage in each recording, over embeddings of at least 60 frames where there are two."""
    r = recordings(spark, d)
    long = F.sum((F.col("frames") >= 60).cast("int")).over(Window.partitionBy("recording"))
    train = r.withColumn("n_long", long).where("n_long < 2 or frames >= 60")
    return V.cluster(train, "recording", "vec_id", "e", 0.8)


@query("e9_fold_small", f"""with {VEC}, r as (select vec_id, e, label, vec_id // 40 recording, vec_id % 90 frames, list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12)) u from v),
s as (select recording, label, count(*) n, sum(frames) m, sum(sum(frames)) over (partition by recording) al from r group by 1, 2),
k as (select recording, label, n < 4 or m < 0.02 * al small from s),
pl as (select recording, label, unnest(u) x, generate_subscripts(u, 1) i from r), pm as (select recording, label, i, avg(x) m from pl group by 1, 2, 3), c as (select recording, label, list(m order by i) c from pm group by 1, 2),
mv as (select r.recording, r.vec_id, arg_max(c.label, (list_cosine_similarity(r.e, c.c), c.label)) t from r join k on k.recording = r.recording and k.label = r.label and k.small join c on c.recording = r.recording join k b on b.recording = c.recording and b.label = c.label and not b.small group by 1, 2)
select r.recording, r.vec_id, coalesce(mv.t, r.label)::bigint label from r left join mv on mv.vec_id = r.vec_id""")
def e9(spark, d):
    """Small clusters folded into the most similar large one; the clusters are the table's labels in each recording."""
    r = recordings(spark, d).withColumn("label", F.col("label").cast("long"))
    return V.fold_small(r, "recording", "vec_id", "e", "label", "frames", min_size=4)


@query("e10_train_set", "with q as (select vec_id, vec_id // 40 g, vec_id % 90 frames from embeddings), n as (select *, sum((frames >= 60)::int) over (partition by g) k from q) select vec_id from n where k < 2 or frames >= 60")
def e10(spark, d):
    long = F.sum((F.col("frames") >= 60).cast("int")).over(Window.partitionBy("recording"))
    return recordings(spark, d).withColumn("k", long).where("k < 2 or frames >= 60").select("vec_id")


@query("e11_embed_jobs", "with f as (select user_id w, event_id % 3 l, row_number() over (partition by user_id order by event_id) f, value from events), c as (select w, l, f from f where value > 20), j as (select w, l, count(*) clean from c group by 1, 2 having count(*) >= 10) select w::bigint w, l::bigint l, clean from j")
def e11(spark, d):
    """Windows' local speakers with at least ten clean frames."""
    f = load(spark, d, "events").select(F.col("user_id").alias("w"), (F.col("event_id") % 3).alias("l"), "value").where("value > 20")
    return f.groupBy(F.col("w").cast("long").alias("w"), F.col("l").cast("long").alias("l")).agg(F.count("*").alias("clean")).where("clean >= 10")


@query("e13_self_flag", "select vec_id, (vec_id = (vec_id // 40) * 40 + 3) is_self, nullif(trim(case when vec_id % 2 = 0 then '  ' else 'n' || vec_id end), '') display_name from embeddings")
def e13(spark, d):
    r = recordings(spark, d)
    return r.select("vec_id", (F.col("vec_id") == F.col("recording") * 40 + 3).alias("is_self"), F.nullif(F.trim(F.when(F.col("vec_id") % 2 == 0, "  ").otherwise(F.concat(F.lit("n"), "vec_id"))), F.lit("")).alias("display_name"))


@query("e14_j13_window_speakers", f"""with {CENT}, g as (select c, row_number() over (order by label) - 1 k from cent), s as (select vec_id // 3 w, vec_id % 3 l, k, list_cosine_similarity(v.e, g.c) sim from v, g),
n as (select vec_id // 3 w, count(*) n from v group by 1), blank as (select w, l, -1 - l k, 0.0 sim from n, (values (0), (1), (2)) t(l) where l >= n.n),
x as (select * from s union all select * from blank),
t as (select a.w, a.k a, b.k b, c.k c, row_number() over (partition by a.w order by a.sim + b.sim + c.sim desc) r from x a join x b on b.w = a.w and b.k <> a.k join x c on c.w = a.w and c.k <> a.k and c.k <> b.k where a.l = 0 and b.l = 1 and c.l = 2)
select w "window", l "local", case l when 0 then a when 1 then b else c end::bigint speaker from t join (select vec_id // 3 w2, vec_id % 3 l from v) o on o.w2 = t.w where r = 1""")
def j13(spark, d):
    """Local speakers of each window mapped to the corpus's centroids, one for each label."""
    v = vecs(spark, d)
    cents = V.few_centroids(V.mean_vector(v, "label", "e"), "label")
    w = v.select(F.floor(F.col("vec_id") / 3).alias("window"), (F.col("vec_id") % 3).alias("local"), "e")
    return V.assign_windows(w, "window", "local", "e", cents)


@query("j14_der_mapping", f"""with {SEG}, {RAW}, {TURNS}, n as (select meeting_id, case speaker_key when 'S1' then 1 when 'S2' then 0 else 2 end speaker, start_ms + 700 s, end_ms + 700 e from turns),
m as (select n.meeting_id, n.speaker, t.speaker_key k, sum(least(n.e, t.end_ms) - greatest(n.s, t.start_ms)) o from n join turns t on t.meeting_id = n.meeting_id and n.s < t.end_ms and t.start_ms < n.e group by 1, 2, 3),
x as (select * from m union all select meeting_id, s, null, 0 from (select distinct meeting_id from m), range(0, 3) t(s)),
t as (select a.meeting_id, a.k a, b.k b, c.k c, row_number() over (partition by a.meeting_id order by a.o + b.o + c.o desc) r from x a join x b on b.meeting_id = a.meeting_id and coalesce(b.k <> a.k, true) join x c on c.meeting_id = a.meeting_id and coalesce(c.k <> a.k, true) and coalesce(c.k <> b.k, true) where a.speaker = 0 and b.speaker = 1 and c.speaker = 2)
select * from (select meeting_id, unnest([0, 1, 2])::int speaker, unnest([a, b, c]) speaker_key from t where r = 1) where speaker_key is not null""")
def j14(spark, d):
    """Hypothesis speakers mapped to reference speakers so that most time is shared."""
    from colloquy.operators import intervals as I
    from colloquy.plans.intervals import new_turns, turns

    m = I.overlap_matrix(new_turns(spark, d), turns(spark, d))
    return I.best_speakers(m.withColumn("speaker", F.col("speaker").cast("int")))


@query("p5_voiceprint_state", "select vec_id, case when vec_id % 30 < 10 then 'too_short' when vec_id % 4 = 0 or (case when vec_id % 5 = 0 then null when vec_id % 7 = 0 then 'old' else 'm1' end) is distinct from 'm1' then 'voice_missing' when vec_id % 2 = 1 and label not in (select label from embeddings where vec_id < 5) then 'not_saved' else 'ready' end state from embeddings")
def p5(spark, d):
    v = vecs(spark, d)
    model = F.when(F.col("vec_id") % 5 == 0, None).when(F.col("vec_id") % 7 == 0, "old").otherwise("m1")
    saved = v.where("vec_id < 5").select("label").distinct().withColumn("saved", F.lit(True))
    state = F.when(F.col("vec_id") % 30 < 10, "too_short").when((F.col("vec_id") % 4 == 0) | ~model.eqNullSafe(F.lit("m1")), "voice_missing").when((F.col("vec_id") % 2 == 1) & F.col("saved").isNull(), "not_saved").otherwise("ready")
    return v.join(F.broadcast(saved), "label", "left").select("vec_id", state.alias("state"))
