"""Tables that change together: versioned folders, and one small file that names the folders of every table of a version.

A write puts its rows into new folders and then publishes a version file with the next number. Publishing is one rename
that never replaces a file, so readers see all of a write or nothing of it, whenever a writer stops, and of two writers
that started from one version one gets an error. Folders of a version are never changed. Works on any file system of
Hadoop's whose rename is atomic; object stores without one need a committer of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


class Versions:
    """The tables under ``root``, a URI that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._java = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._java.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _store(self):
        return self._path("").getFileSystem(self._conf)

    def version(self) -> int:
        """The number of the last version; 0 before the first write."""
        folder = self._path("versions")
        if not self._store().exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._store().listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def state(self, version: int | None = None) -> dict:
        """What a version file says: ``tables`` (name: schema and folders by part) and ``done`` (writer: its last batch)."""
        number = self.version() if version is None else version
        if not number:
            return {"tables": {}, "done": {}}
        source = self._store().open(self._path(f"versions/{number:012d}.json"))
        try:
            return json.loads(self._java.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def read(self, name: str, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """A table as of a version, the last one by default; ``parts`` of it only. An unknown table is an error."""
        tables = self.state(version)["tables"]
        if name not in tables:
            raise KeyError(f"no table {name} under {self.root}")
        return self._frame(tables[name], parts)

    def _frame(self, table: dict, parts: list[str] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(table["schema"])
        folders = [f"{self.root}/{f}" for part, f in sorted(table["folders"].items()) if parts is None or part in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write(self, tables: dict[str, DataFrame], since: int | None = None) -> int:
        """Replaces the tables given, all at once; the others stay. Returns the new version.

        ``since`` is the version that the rows were made from, the last one by default: another write after it is a
        ``Conflict``, and nothing of this one is seen.
        """
        base = self.version() if since is None else since
        state = self.state(base)
        for name, rows in tables.items():
            folder = f"data/{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{folder}")
            state["tables"][name] = {"schema": json.loads(rows.schema.json()), "folders": {"": folder}}
        return self._publish(state, base)

    def change(self, *names: str, by: Callable[..., dict[str, DataFrame]], attempts: int = 3) -> int:
        """Writes what ``by`` makes of the named tables; tried again on newer tables if another writer comes first."""
        for left in reversed(range(attempts)):
            base = self.version()
            tables = self.state(base)["tables"]
            try:
                return self.write(by(*(self._frame(tables[n]) for n in names)), since=base)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def merge(self, name: str, rows: DataFrame, keys: list[str], order: str, writer: str, batch: int, buckets: int = 64) -> int:
        """Rows into a table by key; of rows with one key that with the largest ``order`` stays, be it old or new.

        The table is kept in buckets of the keys, and only those that the rows touch are read and written anew. A writer's
        batch that has been merged is left out when it comes again, so a batch that failed at any point can be repeated.
        """
        base = self.version()
        state = self.state(base)
        if state["done"].get(writer, -1) >= batch:
            return base
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = rows.withColumn("bucket", bucket)
        touched = sorted(str(r["bucket"]) for r in new.select("bucket").distinct().collect())  # ``buckets`` numbers at most
        table = state["tables"].get(name, {"schema": json.loads(rows.schema.json()), "folders": {}})
        both = new.unionByName(self._frame(table, touched).withColumn("bucket", bucket))
        others = [c for c in rows.columns if c not in keys]
        last = both.groupBy("bucket", *keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*", "bucket").select(*rows.columns, "bucket")
        folder = f"data/{name}-{uuid.uuid4().hex}"
        last.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        state["tables"][name] = table | {"folders": table["folders"] | {k: f"{folder}/bucket={k}" for k in touched}}
        state["done"][writer] = batch
        return self._publish(state, base)

    def _publish(self, state: dict, base: int) -> int:
        number = base + 1
        beside, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{number:012d}.json")
        out = self._store().create(beside)
        try:
            out.write(json.dumps(state).encode())
        finally:
            out.close()
        self._rename(beside, final)
        return number

    def _rename(self, made, final) -> None:
        """The one step that makes a write visible."""
        context = self._java.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._java.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(made, final, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                raise Conflict(f"{final} has been written by another") from e
            raise

    def clean(self, keep: int = 2) -> list[str]:
        """Deletes the version files but the last ``keep``, and the folders that only they name or none does. Not to be run
        beside writers."""
        last, store = self.version(), self._store()
        kept = range(max(1, last - keep + 1), last + 1)
        used = {f.split("/")[1] for n in kept for t in self.state(n)["tables"].values() for f in t["folders"].values()}
        gone = []
        for f in store.listStatus(self._path("versions")) if last else []:
            name = f.getPath().getName()
            if name not in {f"{n:012d}.json" for n in kept}:
                store.delete(f.getPath(), True)
                gone.append(name)
        for f in store.listStatus(self._path("data")) if store.exists(self._path("data")) else []:
            if f.getPath().getName() not in used:
                store.delete(f.getPath(), True)
                gone.append(f.getPath().getName())
        return gone


def checked(rows: DataFrame, failed: Column, message: str) -> DataFrame:
    """The rows; a write of them stops with an error where ``failed`` holds."""
    first = rows.columns[0]
    return rows.withColumn(first, F.when(failed, F.raise_error(message).cast(rows.schema[first].dataType)).otherwise(F.col(first)))


def save_meetings(store: Versions, meetings: DataFrame, segments: DataFrame) -> int:
    """Adds meetings (id, ...) and their segments (id, meeting_id, ...): all rows or, on any error, none.

    Ids that are there already or twice among the new ones, null ids, and segments of no new meeting are errors. The
    tables are ``meetings`` and ``segments``; they begin with the first write.
    """
    known = store.state()["tables"]
    new = meetings.select("id").withColumn("__there", F.lit(True))
    out = {}
    for name, rows in (("meetings", meetings), ("segments", segments)):
        wrong = F.col("id").isNull() | (F.col("__n") > 1)
        counted = rows.join(rows.groupBy("id").agg(F.count("*").alias("__n")).withColumnRenamed("id", "__id"), F.col("id").eqNullSafe(F.col("__id"))).drop("__id")
        if name == "segments":
            counted, wrong = counted.join(new.select(F.col("id").alias("meeting_id"), "__there").distinct(), "meeting_id", "left"), wrong | F.col("__there").isNull()
        if name in known:
            old = store.read(name)
            counted = counted.join(old.select("id", F.lit(True).alias("__old")), "id", "left")
            wrong = wrong | F.col("__old").isNotNull()
        fresh = checked(counted, wrong, f"{name}: an id that is null, not new or without its meeting").select(*rows.columns)
        out[name] = old.unionByName(fresh) if name in known else fresh
    return store.write(out)
