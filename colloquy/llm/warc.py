"""WARC archives: one gzip member for each record, written and read by Spark tasks.

The reader is sequential: it inflates a stream piece by piece, takes a record's block by its Content-Length, and checks
the block's and the payload's digest. Archives lie in a folder that all nodes share, opened by its URI.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm._scratch import Scratch

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 18


class WarcError(ValueError):
    """A record breaks the format or one of its digests."""


def record(kind: str, record_id: str, uri: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None = None) -> bytes:
    """One record as a gzip member; a revisit has the HTTP header, with the full payload's length, and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """Inflated gzip members of a stream, one at a time."""
    rest, inflate, parts = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(READ_BYTES)
        if not data:
            if parts:
                raise WarcError("the archive ends within a record")
            return
        parts.append(inflate.decompress(data))
        rest = b""
        if inflate.eof:
            rest = inflate.unused_data
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of one record; raises WarcError unless framing and digests hold."""
    at = member.find(b"\r\n\r\n")
    if not member.startswith(b"WARC/1.") or at < 0:
        raise WarcError("no WARC header")
    lines = member[:at].decode("utf-8").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    try:
        size = int(head["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    block = member[at + 4 : at + 4 + size]
    if len(block) != size or member[at + 4 + size :] != b"\r\n\r\n":
        raise WarcError("the block has another length than Content-Length")
    if (want := head.get("warc-block-digest")) and want != "sha256:" + hashlib.sha256(block).hexdigest():
        raise WarcError("block digest differs")
    return head, block


def read_records(stream: BinaryIO) -> Iterator[dict]:
    """Records of one archive: id, type, refers_to, payload (None in a revisit), payload_bytes, payload_digest."""
    for member in members(stream):
        head, block = parse(member)
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
        kind = head.get("warc-type", "")
        if kind == "response" and digest and digest != hashlib.sha256(payload).hexdigest():
            raise WarcError("payload digest differs")
        length = re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)
        yield {
            "record_id": head.get("warc-record-id", "").strip("<>"), "record_type": kind, "refers_to": (r := head.get("warc-refers-to")) and r.strip("<>"), "target_uri": head.get("warc-target-uri"),
            "payload": payload if kind == "response" else None, "payload_bytes": int(length[1]) if length and kind == "revisit" else len(payload), "payload_digest": digest,
        }


ID = "urn:page:"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 100, archive_bytes: int = 1 << 26) -> DataFrame:
    """Writes a record for each page under ``folder``, a URI; returns the manifest (path, n_records).

    Of pages with equal payloads of at least ``revisit_bytes`` bytes, the one with the smallest id is a response and the
    others revisit it; a repeated row of that page is a response again. Shorter payloads are all responses. Null html is
    an empty payload. A null id has no page to be compared: it revisits if any page with an id has its payload. A task
    writes under another name and renames, so one that is tried again leaves the same archive.
    """
    id_type = pages.schema[id_col].dataType.simpleString()
    page = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), F.encode(F.coalesce(pages[html_col], F.lit("")), "UTF-8").alias("payload"))
    light = page.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n"))
    first = light.where(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")

    def squeeze(batches):
        for batch in batches:
            ids, urls, payloads = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload"))
            digests = [hashlib.sha256(p).hexdigest() for p in payloads]
            full = [record("response", ID + ("" if i is None else str(i)), u, p, len(p), d) for i, u, p, d in zip(ids, urls, payloads, digests)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(urls, pa.string()), pa.array(digests, pa.string()), pa.array([len(p) for p in payloads], pa.int64()), pa.array(full, pa.binary())], ["page_id", "url", "digest", "n", "full"])

    # the page itself moves by its id, so that equal payloads meet in no single task
    decided = light.where(F.col("n") >= revisit_bytes).join(first, "digest").where(F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))).where("first_id is not null").select(F.col("page_id").alias("to_id"), F.col("digest").alias("to_digest"), "first_id").distinct()
    full = page.mapInArrow(squeeze, f"page_id {id_type}, url string, digest string, n bigint, full binary")
    ready = full.join(decided, F.col("page_id").eqNullSafe(F.col("to_id")) & (F.col("digest") == F.col("to_digest")), "left").select("page_id", "url", "digest", "n", "first_id", F.when(F.col("first_id").isNull(), F.col("full")).alias("full"))

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        part, number, out, size, count, name, temporary = TaskContext.get().partitionId(), 0, None, 0, 0, "", ""
        attempt = TaskContext.get().taskAttemptId()
        done: list[tuple[str, int]] = []

        def close():
            out.close()
            store.move(temporary, f"{root}/{name}")
            done.append((f"{folder}/{name}", count))

        for batch in batches:
            for page_id, url, digest, n, first_id, full in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "n", "first_id", "full"))):
                if out is None:
                    name = f"pages-{part:06d}-{number:04d}.warc.gz"
                    temporary = f"{root}/.{name}.{attempt}"
                    out, size, count, number = store.open_output_stream(temporary, compression=None), 0, 0, number + 1
                data = full if full is not None else record("revisit", ID + ("" if page_id is None else str(page_id)), url, None, n, digest, f"{ID}{first_id}")
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n_records"])

    return ready.mapInArrow(write, "path string, n_records bigint")


def read_archives(paths: DataFrame, id_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """Records of the archives whose URIs are in column ``path``; each archive is one sequential read.

    A broken archive raises WarcError. An empty ``paths`` gives no rows.
    """
    fields = [("page_id", id_type), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", id_type)] + [("payload", "binary")] * payloads

    def number(urn):
        text = urn.removeprefix(ID) if urn else ""
        return None if not text else text if id_type == "string" else int(text)

    def run(batches):
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []

                def flush(rows):
                    columns = list(zip(*rows)) or [()] * len(fields)
                    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(t) or pa.binary()) for c, (_, t) in zip(columns, fields)], [f[0] for f in fields])

                with store.open_input_stream(name, compression=None) as stream:
                    for r in read_records(stream):
                        rows.append((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) + ((r["payload"],) if payloads else ()))
                        if len(rows) >= 1000:
                            yield flush(rows)
                            rows = []
                yield flush(rows)

    return paths.select("path").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes all pages as archives in the shared folder and reads them back: a row for each record."""
    scratch = Scratch(spark, "warc")
    manifest = scratch.save(write_archives(pages, scratch.path("archives"), **options), "manifest")
    archives = max(1, manifest.count())
    return read_archives(manifest.repartition(archives), pages.schema[options.get("id_col", "page_id")].dataType.simpleString())
