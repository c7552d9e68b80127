"""The live path: alignment of two streams, mixed windows, stream health, batches by count or time, jitter, checkpoints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import buffers as B
from colloquy.operators import health as H
from colloquy.operators import live as L
from colloquy.plans.registry import query
from colloquy.sources.tables import load


def chunks(spark, d):
    """Chunks of 10 to 20 ms of two streams for each supplier: delays vary, the system's clock drifts, every 90 chunks 150 ms
    are lost, and every 50 chunks seven of them come late, all at about one time."""
    lines = load(spark, d, "lineitem").withColumn("odd", F.col("l_linenumber") % 2)
    own = Window.partitionBy("l_suppkey", "odd").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = lines.select(F.col("l_suppkey").alias("session_id"), "odd", (F.row_number().over(own) - 1).cast("bigint").alias("chunk"), (160 + 16 * (F.col("l_quantity").cast("bigint") % 11)).alias("n"), (F.col("l_partkey") * 7 % 160).alias("delay"), F.sum(160 + 16 * (F.col("l_quantity").cast("bigint") % 11)).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("before"))
    place, stall = F.col("chunk") % 50, F.lit(0)
    stall = F.when(place.between(40, 46), (47 - place) * 500).otherwise(0)
    arrival = F.col("before") + 2400 * F.floor(F.col("chunk") / 90) + F.when(F.col("odd") == 0, F.col("chunk") * 3 + 800).otherwise(0) + F.col("delay") + stall
    return rows.select("session_id", F.when(F.col("odd") == 1, "mic").otherwise("system").alias("device"), "chunk", "n", arrival.cast("bigint").alias("arrival"))


CHUNKS = """
lines as (select l_suppkey session_id, l_linenumber % 2 odd, row_number() over w - 1 chunk, 160 + 16 * (l_quantity::bigint % 11) n, l_partkey * 7 % 160 delay,
          (sum(160 + 16 * (l_quantity::bigint % 11)) over (w rows between unbounded preceding and current row))::bigint so_far
          from lineitem window w as (partition by l_suppkey, l_linenumber % 2 order by l_orderkey, l_linenumber, l_partkey, l_quantity)),
sent as (select session_id, case odd when 1 then 1 else 2 end d, chunk, n, so_far + 2400 * (chunk // 90) + case odd when 0 then chunk * 3 + 800 else 0 end + delay
         + case when chunk % 50 between 40 and 46 then (47 - chunk % 50) * 500 else 0 end a from lines),
queue as (select *, row_number() over (partition by session_id order by a, d, chunk) k from sent)"""

#: One step for each chunk of every session: the stream that it belongs to, then what becomes of it, then the windows.
TRACK = "{'e': NULL::bigint, 'adrift': false, 'moved': 0::bigint, 'gat': NULL::bigint, 'gsince': NULL::bigint, 'side': 0, 'since': 0::bigint, 'turn': 0, 'lags': []::struct(t bigint, v bigint)[]}"
ALIGN = f"""{CHUNKS},
fold as (
  select session_id, 0::bigint k, NULL::bigint head, [{TRACK}, {TRACK}] s, 0 d, 0::bigint chunk, 0::bigint spot, 0::bigint n, 0::bigint held, 0::bigint dropped, 0::bigint silence, NULL::bigint gap_at, 0::bigint gap,
         NULL::bigint h0, 0::bigint k1, 0::bigint k2, []::bigint[] have from (select distinct session_id from sent)
  union all
  select session_id, k, head + (k1 + k2) * 9600,
         [case when k2 > 0 and x.e < head + (k1 + k2) * 9600 then struct_update(x, e := head + (k1 + k2) * 9600, adrift := true) else x end for x in s], d, chunk, spot, n, held, dropped, silence, gap_at, gap, head, k1, k2, have
  from (select *, case when greatest(have[1], have[2]) - k1 * 9600 >= 9600 and abs(have[1] - have[2]) > 8000 then (greatest(have[1], have[2]) - k1 * 9600) // 9600 else 0 end k2
  from (select *, least(have[1], have[2]) // 9600 k1
  from (select *, [coalesce(x.e - head, 0) for x in s] have
  from (select session_id, k, head, d, chunk, spot, n, held, greatest(0, least(n, end0 - spot)) dropped, greatest(0, spot - end0) silence, gap_at, gap,
               case d when 1 then [me2, s[2]] else [s[1], me2] end s
        from (select *, struct_update(me1, e := greatest(end0, spot + n)) me2
        from (select *,
               case when fresh then head when gap > 0 then me.e + gap when held > 0 then me.e + held else me.e end end0_raw,
               case when fresh then a - n - coalesce(olag, 0) when gap > 0 then me.e + gap when held > 0 then me.e + held when back > 0 then me.e - back else me.e end spot,
               case when gap > 0 then greatest(gat1, head) end gap_at,
               case when fresh then {{'e': me.e, 'adrift': false, 'moved': 0::bigint, 'gat': NULL::bigint, 'gsince': NULL::bigint, 'side': 0, 'since': 0::bigint, 'turn': 0, 'lags': [{{'t': a, 'v': coalesce(olag, 0)}}]}}
                    when gap > 0 then {{'e': me.e, 'adrift': false, 'moved': me.moved, 'gat': NULL::bigint, 'gsince': NULL::bigint, 'side': me.side, 'since': me.since, 'turn': me.turn,
                                        'lags': list_append(list_filter(lags1, lambda x: x.t < gs1 and x.v < delay - gap + me.moved and a - x.t <= 12000), {{'t': a, 'v': delay - gap + me.moved}})}}
                    when islate then {{'e': me.e, 'adrift': false, 'moved': me.moved, 'gat': gat1, 'gsince': gs1, 'side': me.side, 'since': me.since, 'turn': me.turn, 'lags': lags1}}
                    else {{'e': me.e, 'adrift': false, 'moved': me.moved + held - back, 'gat': NULL::bigint, 'gsince': NULL::bigint, 'side': side1, 'since': since1, 'turn': turn1, 'lags': lags1}} end me1,
               greatest(coalesce(end0_raw, head), head) end0
        from (select *, case when not fresh and not islate and turn1 = 1 then least(off, 16) else 0 end held, case when not fresh and not islate and turn1 = -1 then least(-off, 16, n) else 0 end back,
               case when not fresh and islate and a - gs1 >= 2400 then late else 0 end gap
        from (select *,
               case when me.turn <> 0 then me.side when side0 = 0 or side0 <> me.side then side0 when turn1 <> 0 then 0 else me.side end side1,
               case when me.turn = 0 and (side0 = 0 or side0 <> me.side) then a else me.since end since1
        from (select *, case when me.turn <> 0 then case when abs(off) <= 16 or sign(off) <> me.turn then 0 else me.turn end when side0 <> 0 and side0 = me.side and a - me.since >= 32000 then side0 else 0 end turn1
        from (select *, case when abs(off) > 80 then sign(off)::int else 0 end side0
        from (select *, late > 1600 islate, coalesce(me.gat, me.e) gat1, coalesce(me.gsince, a) gs1, case when olag is null then 0 else lags1[1].v - me.moved - olag end off
        from (select *, delay - (lags1[1].v - me.moved) late
        from (select *, list_append(list_filter(me.lags, lambda x: x.v < delay + me.moved and a - x.t <= 12000), {{'t': a, 'v': delay + me.moved}}) lags1
        from (select *, me.e is null or me.adrift fresh, coalesce(a - n - me.e, 0) delay, case when ot.e is not null and not ot.adrift and len(ot.lags) > 0 then ot.lags[1].v - ot.moved end olag
        from (select q.session_id, q.k, q.d, q.chunk, q.n, q.a, coalesce(f.head, q.a - q.n) head, f.s, f.s[q.d] me, f.s[3 - q.d] ot from fold f join queue q on q.session_id = f.session_id and q.k = f.k + 1)
        )))))))))))))))"""


@query("st2_j11_alignment", f"with recursive {ALIGN} select session_id, case d when 1 then 'mic' else 'system' end device, chunk, spot \"at\", n, held, dropped, silence, gap_at, gap from fold where k > 0")
def st2(spark, d):
    """Where each chunk of two live streams goes: gaps after 150 ms of lateness, drift taken back a millisecond a chunk."""
    return L.aligned(chunks(spark, d)).where("event = 'placed'").select("session_id", "device", "chunk", "at", "n", "held", "dropped", "silence", "gap_at", "gap")


@query("st1_st3_st4_mixed_windows", f"""with recursive {ALIGN},
full_ones as (select session_id, h0 + j * 9600 "at", 9600::bigint n, greatest(0, least(9600, 9600 - (have[1] - j * 9600))) mic_lacks, greatest(0, least(9600, 9600 - (have[2] - j * 9600))) system_lacks, false final
              from (select *, unnest(range(0, k1 + k2)) j from fold where k > 0)),
last_ones as (select *, row_number() over (partition by session_id order by k desc) r, [coalesce(x.e - head, 0) for x in s] left_over from fold where k > 0)
select * from full_ones
union all select session_id, head, greatest(left_over[1], left_over[2]), greatest(left_over[2] - left_over[1], 0), greatest(left_over[1] - left_over[2], 0), true from last_ones where r = 1 and greatest(left_over[1], left_over[2]) > 0""")
def st1(spark, d):
    """Windows of 600 ms once both streams fill them or one is starved for 500 ms, and what is left at the end."""
    windows = L.aligned(chunks(spark, d)).where("event <> 'placed'")
    return windows.select("session_id", "at", "n", "mic_lacks", "system_lacks", (F.col("event") == "rest").alias("final"))


def capture_log(spark, d):
    """Each user's events as the log of a capture stream, twenty seconds as a millisecond."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.col("event_id") % 11
    kind = F.when(F.row_number().over(own) == 1, "installed").when(k.isin(0, 1), "rebuilt").when(k == 2, "failed").when(k == 3, "disconnected").when(k.isin(4, 5), "error").when((k == 6) & (F.col("event_id") % 7 == 0), "removed").otherwise("audio")
    return load(spark, d, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 20_000_000).alias("at"), kind.alias("kind"))


#: The state after each log row; what was due before it is a stall and a number of tries.
HEALTH = """log as (select user_id, epoch_us(ts) // 20000000 "at", case when row_number() over (partition by user_id order by ts, event_id) = 1 then 'installed' when event_id % 11 in (0, 1) then 'rebuilt' when event_id % 11 = 2 then 'failed'
                when event_id % 11 = 3 then 'disconnected' when event_id % 11 in (4, 5) then 'error' when event_id % 11 = 6 and event_id % 7 = 0 then 'removed' else 'audio' end kind from events),
steps as (select *, row_number() over (partition by user_id order by "at", list_position(['installed', 'rebuilt', 'audio', 'error', 'disconnected', 'failed', 'removed'], kind)) i from log),
life as (
  select user_id, 0::bigint i, 0::bigint "at", '' kind, 'Absent' status, 0::bigint since, null::bigint heard, false rebuilt, false awaited, false told, null::bigint told_at, 0 short, 30000::bigint retry, 0::bigint failed_at, []::bigint[] errors,
         null::bigint stalled, ''::varchar stall_status, false stall_degraded, 0 stall_short, 30000::bigint stall_retry, 0::bigint tried_from, 0::bigint tries, false recovered, false degraded from (select distinct user_id from log)
  union all
  select user_id, i, "at", kind,
         case when dies then case when short2 >= 3 then 'Failed' else 'Dead' end when kind in ('installed', 'rebuilt') then 'Running' when kind = 'failed' then 'Failed' when kind = 'removed' then 'Absent' else status1 end,
         case when kind in ('installed', 'rebuilt') then "at" else since end, case when kind in ('installed', 'rebuilt') then null when kind = 'audio' then "at" else heard end,
         case when kind in ('installed', 'rebuilt') then kind = 'rebuilt' else rebuilt end,
         case when kind in ('installed', 'rebuilt') then kind = 'rebuilt' when dies or kind in ('failed', 'removed') or back then false else awaited1 end,
         case when kind = 'installed' then false when back then false when kind = 'failed' or degraded2 or dies and short2 >= 3 then true else told1 end,
         case when degraded2 then "at" else told_at1 end, short2,
         case when dies and short2 >= 3 then least(2 * retry2, 300000) when dies then retry2 when kind = 'failed' then case when status1 = 'Failed' or short1 >= 3 then least(2 * retry1, 300000) else 30000 end else retry1 end,
         case when dies and short2 >= 3 or kind = 'failed' then "at" else failed1 + tries * retry1 end, case when kind in ('installed', 'rebuilt') then [] when hurts then errors2 else errors end,
         stalled, case when stalled is not null then status0 end, stall_degraded, short1, retry1, failed1, tries, back and told1, degraded2
  from (select *, dies and not told1 and (told_at1 is null or "at" - told_at1 >= 10000) degraded2
  from (select *, case when not dies then short1 when not rebuilt or delivered >= 3000 then 0 else short1 + 1 end short2, case when dies and (not rebuilt or delivered >= 3000) then 30000 else retry1 end retry2
  from (select *, hurts and (kind = 'disconnected' or len(errors2) > 5) dies, kind = 'audio' and status1 = 'Running' and awaited1 and "at" - since >= 3000 back
  from (select *, list_append(list_filter(errors, lambda x: "at" - x <= 2000), "at") errors2, kind in ('error', 'disconnected') and status0 = 'Running' hurts, status0 status1,
               case when status0 = 'Failed' then greatest(0, ("at" - failed1) // retry1) else 0 end tries
  from (select *, case when stalled is null then status when short1 >= 3 then 'Failed' else 'Dead' end status0, case when stalled is not null then false else awaited end awaited1,
               told or stall_degraded or stalled is not null and short1 >= 3 told1, case when stall_degraded then stalled else told_at end told_at1,
               case when stalled is not null and short1 >= 3 then least(2 * retry0, 300000) else retry0 end retry1, case when stalled is not null and short1 >= 3 then stalled else failed_at end failed1
  from (select *, case when stalled is null then short when not rebuilt or delivered >= 3000 then 0 else short + 1 end short1, case when stalled is not null and (not rebuilt or delivered >= 3000) then 30000 else retry end retry0,
               stalled is not null and not told and (told_at is null or stalled - told_at >= 10000) stall_degraded
  from (select l.user_id, s.i, s."at", s.kind, l.status, l.since, l.heard, l.rebuilt, l.awaited, l.told, l.told_at, l.short, l.retry, l.failed_at, l.errors, greatest(0, coalesce(l.heard - l.since, 0)) delivered,
               case when l.status = 'Running' and greatest(l.since, coalesce(l.heard, 0)) + 3001 <= s."at" then greatest(l.since, coalesce(l.heard, 0)) + 3001 end stalled
        from life l join steps s on s.user_id = l.user_id and s.i = l.i + 1))))))))"""


@query("st17_w14_lifecycle", f"""with recursive {HEALTH}
select user_id, "at", kind, status, recovered, degraded, short::int short_lived, retry retry_ms from life where i > 0
union all select user_id, stalled, 'stall', stall_status, false, stall_degraded, stall_short::int, stall_retry from life where stalled is not null
union all select user_id, unnest(range(tried_from + stall_retry, tried_from + (tries + 1) * stall_retry, stall_retry)), 'retry', 'Failed', false, false, stall_short::int, stall_retry from life where tries > 0""")
def st17(spark, d):
    """The life of each stream: stalls, recoveries, streams given up and tried again at doubling times."""
    return H.lifecycle(capture_log(spark, d), "user_id")


def ticks(spark, d):
    """Each user's events, thirty seconds as a millisecond."""
    return load(spark, d, "events").select("user_id", "event_id", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 30_000_000).alias("at"))


TICKS = 'e as (select user_id, event_id, value, epoch_us(ts) // 30000000 "at" from events)'


@query("st11_batches", f"""with {TICKS}, g as (select *, coalesce("at" - lag("at") over (partition by user_id order by "at", event_id) >= 5000, false)::int idle from e),
b as (select *, sum(idle) over (partition by user_id order by "at", event_id rows between unbounded preceding and current row) burst from g),
p as (select *, (row_number() over (partition by user_id, burst order by "at", event_id) - 1) // 50 batch from b)
select user_id, min("at") first_at, max("at") last_at, max("at") + case when count(*) = 50 then 0 else 5000 end closed_at, count(*) n, round(sum(value), 4) total, count(*) = 50 "full" from p group by user_id, burst, batch""")
def st11(spark, d):
    """Batches of 50 rows, or of what there is once five seconds bring none."""
    return B.batches(ticks(spark, d), "user_id", "at", "event_id", "value").withColumn("total", F.round("total", 4))


@query("st16_jitter_reads", f"""with recursive {TICKS}, chunk as (select user_id, "at", 160 + 16 * (event_id % 11) n from e where event_id % 3 <> 0),
asks as (select user_id, "at", row_number() over (partition by user_id order by "at") i from e where event_id % 3 = 0),
seen as (select r.user_id, r.i, r."at", coalesce(sum(c.n) filter (c."at" <= r."at"), 0)::bigint come, coalesce(sum(c.n) filter (c."at" + 3000 <= r."at"), 0)::bigint old from asks r left join chunk c on c.user_id = r.user_id group by 1, 2, 3),
f as (select user_id, 0::bigint i, 0::bigint "at", 0::bigint taken, null::bigint given, 0::bigint silence, 0::bigint "left" from (select distinct user_id from asks)
      union all select s.user_id, s.i, s."at", f.taken + case when s.old > f.taken then least(320, s.come - f.taken) else 0 end, case when s.old > f.taken then least(320, s.come - f.taken) end,
                       case when s.old > f.taken then 320 - least(320, s.come - f.taken) else 0 end, s.come - f.taken - case when s.old > f.taken then least(320, s.come - f.taken) else 0 end
      from f join seen s on s.user_id = f.user_id and s.i = f.i + 1)
select user_id, "at", given, silence, "left" from f where i > 0""")
def st16(spark, d):
    """What reads get from a buffer that holds chunks back for three seconds, and the silence for what has not come."""
    e = ticks(spark, d)
    chunk = e.where("event_id % 3 != 0").select("user_id", "at", (160 + 16 * (F.col("event_id") % 11)).alias("n"))
    return B.jitter_reads(chunk, e.where("event_id % 3 = 0").select("user_id", "at", F.lit(320).alias("n")), "user_id", 3000)


@query("k15_saver", f"""with recursive {TICKS}, l as (select user_id, "at", 48000 * (event_id % 97) n, ("at" // 20000) % 2 = 0 ok, row_number() over (partition by user_id order by "at", event_id) i, count(*) over (partition by user_id) most from e),
f as (select user_id, 0::bigint i, 0::bigint most, 0::bigint "at", ''::varchar "event", 0::bigint samples, 0::bigint pending, 0::bigint dropped, 0::bigint failures, null::bigint retry_at, 0::bigint number from (select distinct user_id from l)
      union all select user_id, i, most, "at", "event", case when "event" = 'written' then x end, case when "event" = 'written' then 0 else x - lost end, lost, case "event" when 'written' then 0 when 'failed' then failures + 1 else failures end,
                       case "event" when 'written' then null when 'failed' then "at" + least(5000 * 2 ** least(failures, 4), 60000)::bigint else retry_at end, case when "event" = 'written' then number + 1 else number end
      from (select *, case when "event" in ('waits', 'failed') then greatest(0, x - 28800000) else 0 end lost
      from (select f.user_id, l.i, l.most, l."at", f.pending + l.n x, case when f.pending + l.n < 1440000 then '' when f.retry_at > l."at" then 'waits' when l.ok then 'written' else 'failed' end "event", f.failures, f.retry_at, f.number
            from f join l on l.user_id = f.user_id and l.i = f.i + 1)))
select user_id, "at", "event", case when "event" = 'written' then number - 1 end::int "checkpoint", coalesce(samples, 0) samples, pending, dropped, retry_at from f where "event" <> ''
union all select user_id, "at", 'rest', number::int, pending, 0, 0, null from f where i > 0 and i = most and pending > 0""")
def k15(spark, d):
    """The checkpoints of each user's audio, with writes that fail for twenty seconds of every forty."""
    log = ticks(spark, d).withColumns({"n": 48000 * (F.col("event_id") % 97), "ok": F.floor(F.col("at") / 20000) % 2 == 0})
    return B.checkpoints(log, "user_id", ["at", "event_id"])
