"""Writes as functions of old and new rows: upserts, cascades, compare-and-set, partition replacement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.arrow import fold_in_order


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: list[str] = (), keep_old: list[str] = (), drop_missing: bool = False) -> DataFrame:
    """New rows over old ones by key. ``keep_if_null``: old values stay where new ones are null; ``keep_old``: old values
    always stay; ``drop_missing``: keys that are only in the old rows go."""
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "right" if drop_missing else "full")

    def value(c: str) -> Column:
        if c in keys or c in keep_if_null:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        if c in keep_old:
            return F.col(f"o.{c}")
        return F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*[value(c).alias(c) for c in old.columns])


def delete_cascade(parents: DataFrame, gone: DataFrame, key: str, children: list[tuple[DataFrame, str]]) -> tuple[DataFrame, list[DataFrame]]:
    """Parents without the ids in ``gone``, and each child table without theirs."""
    ids = gone.select(F.col(key).alias("__gone")).distinct()
    left = [df.join(ids, df[column] == ids["__gone"], "left_anti") for df, column in [(parents, key), *children]]
    return left[0], left[1:]


def first_terminal(events: DataFrame, key: str, order: str, status: str, start: str) -> DataFrame:
    """Compare-and-set over an event log: the last start of each key, and the first other status after it, if any."""
    started = events.where(F.col(status) == start).groupBy(key).agg(F.max(order).alias("start_t"))
    ends = events.where(F.col(status) != start).join(started, key).where(F.col(order) > F.col("start_t")).groupBy(key).agg(F.min_by(status, order).alias("end"))
    return started.join(ends, key, "left").select(key, "start_t", F.coalesce("end", F.lit(start)).alias("status"))


def summary_states(log: DataFrame, key: str, order: str, time: str) -> DataFrame:
    """(key, status, started, summary, backup) after a log of rows (key, order, time, kind, run, summary).

    A ``start`` makes a run pending and copies the summary there is to ``backup``. ``completed``, ``failed`` and
    ``cancelled`` name the run by the time of its ``start``; they count only while that very run is pending. The first puts
    the new summary in place, the others the backup; all of them clear the backup. One state a key is kept, and the rows of
    a key are read in order.
    """

    def step(state, row):
        status, started, summary, backup = state or ("none", None, None, None)
        if row["kind"] == "start":
            return ("pending", row[time], summary, summary), []
        if status != "pending" or row["run"] != started:
            return (status, started, summary, backup), []
        return (row["kind"], started, row["summary"] if row["kind"] == "completed" else summary if backup is None else backup, None), []

    return fold_in_order(log, [key], [order], [time, "kind", "run", "summary"], step, lambda state: [state], "status string, started bigint, summary string, backup string")


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` replaced by its rows; on files, the same as dynamic partition overwrite."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def set_json_field(json: Column, field: str, value: Column | None) -> Column:
    """Sets a field of a flat JSON object and keeps the others; a null value removes it."""
    fields = F.map_filter(F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: k != field)
    return F.to_json(fields if value is None else F.map_concat(fields, F.create_map(F.lit(field), value)))


def update_process(rows: DataFrame, now: int) -> DataFrame:
    """Only given fields change; an end time comes with a final status; errors are one line of 1000 characters at most."""
    error = F.substring(F.replace(F.replace(F.col("error"), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" ")), 1, 1000)
    return rows.withColumn("error", error).withColumn("end_time", F.when(F.col("status").isin("COMPLETED", "FAILED"), F.lit(now).cast("long")))


def set_by_name(rows: DataFrame, name: str, columns: dict[str, str], value: Column) -> DataFrame:
    """Sets the one column that each row's ``name`` stands for; a null value clears it. A name without a column stops the
    query."""
    unknown = F.raise_error(F.concat(F.lit("no column for "), F.coalesce(F.col(name), F.lit("null"))))
    return rows.withColumns({c: F.when(F.col(name) == k, value).when(F.col(name).isin(list(columns)), F.col(c)).otherwise(unknown) for k, c in columns.items()})


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers all rows from 0 by ``order``, whose first column is a whole number, without one task for all: rows are
    counted by its value, the counts are summed up, and each value's rows are numbered for themselves."""
    first = order[0]
    sizes = rows.groupBy(first).agg(F.count("*").alias("__n"))
    # values fall in blocks, so the running sum of a block starts from a sum over few rows
    block = F.floor(F.col(first) / 4096)
    blocks = sizes.groupBy(block.alias("__block")).agg(F.sum("__n").alias("__sum"))
    starts = blocks.select("__block", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    within = F.coalesce(F.sum("__n").over(Window.partitionBy("__block").orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.withColumn("__block", block).join(starts, "__block").select(first, (F.col("__start") + within).alias("__before"))
    own = F.row_number().over(Window.partitionBy(first).orderBy(*order[1:])) - 1
    return rows.withColumn("__own", own).join(before, first).select(*rows.columns, (F.col("__before") + F.col("__own")).alias(name))


def guarded_insert(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """New rows that share none of the columns' values with an old row: one anti join for each, so each can be hashed."""
    return reduce(lambda df, c: df.join(old.select(c).distinct(), c, "left_anti"), columns, new).select(new.columns)
