"""Merkle manifest of a table, by time-forward processing.

Rows are leaves of one tree for each value of a column; the trees' roots are the leaves of a last tree. Nodes are labelled
such that children come before their parent: (last place below it, level). A sweep over the labels takes the messages of
the next node, its children's digests, from a priority queue, and sends the node's digest to the parent. The reversed
sweep starts at the root and sends each node's proof, what is left of it above the node, down to its children.

The queue's outer part is Spark's sorted shuffle: a block of ``1 << HEIGHT`` neighbours is one run of a task's sorted rows,
which may spill; the inner part is a heap of the messages within a block, one or two for each level. Digests of blocks go
on to blocks further up, so a tree of n leaves takes log n / HEIGHT rounds, and no task holds more than a block.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm._scratch import Scratch

#: Levels of a block.
HEIGHT = 10
EMPTY = hashlib.sha256().hexdigest()


def node_digest(*children: str) -> str:
    """The digest of a node: sha256 of its children's digests as hex text, in their order."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value of a leaf: ``-`` if null, else its number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def widths(leaves: int) -> list[int]:
    """Nodes of each level, from the leaves up to the one that remains."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // 2))
    return out


class Block:
    """A run of neighbours on one level of a tree, ``first`` the place of the first of them, and the nodes above them."""

    def __init__(self, first: int, width: int, height: int = HEIGHT):
        self.first = first
        self.widths = widths(width)[: height + 1]
        self.levels = len(self.widths) - 1

    def label(self, level: int, place: int) -> tuple[int, int]:
        """Children have smaller labels than their parent: the last place below a node, then its level."""
        return min(((place + 1) << level) - 1, self.widths[0] - 1), level

    def forward(self, digests: Iterable[str]) -> Iterator[tuple[str, ...]]:
        """The messages that each node receives, in the order of labels; the last node is the top.

        A block of one level only receives its one digest.
        """
        queue: list[tuple[tuple[int, int], int, str]] = []
        for place, digest in enumerate(digests, self.first):
            if not self.levels:
                yield (digest,)
                return
            heapq.heappush(queue, (self.label(1, place >> 1), place, digest))
            while queue and queue[0][0][0] <= place:
                label, child, message = heapq.heappop(queue)
                got = [message]
                while queue and queue[0][0] == label:
                    got.append(heapq.heappop(queue)[2])
                yield tuple(got)
                if label[1] < self.levels:
                    heapq.heappush(queue, (self.label(label[1] + 1, child >> 2), child >> 1, node_digest(*got)))

    def top(self, messages: tuple[str, ...]) -> str:
        """The digest of the node that received the last messages."""
        return node_digest(*messages) if self.levels else messages[0]

    def backward(self, log: list[tuple[str, ...]], above: str) -> Iterator[tuple[int, str]]:
        """(place, proof) of the block's members, the last one first. ``log`` is what ``forward`` gave, ``above`` the top's
        own proof. A proof names its steps from the member upwards: ``-`` for no sibling, or ``<`` or ``>`` and the digest of
        the sibling on that side."""
        if not self.levels:
            yield self.first, above
            return
        number = len(log)
        top = (self.levels, self.first >> self.levels)
        queue = [((-self.label(*top)[0], -top[0]), *top, above)]
        while queue:
            _, level, place, proof = heapq.heappop(queue)
            if level == 0:
                yield place, proof
                continue
            number -= 1
            children = log[number]
            for k in range(len(children)):
                child = 2 * place + k
                side = "-" if len(children) == 1 else f"<{children[0]}" if k else f">{children[1]}"
                end, depth = self.label(level - 1, child)
                heapq.heappush(queue, ((-end, -depth), level - 1, child, side + proof))


def steps(proof: str) -> Iterator[tuple[str, str]]:
    """(side, digest) of a proof's steps; no digest where a node has no sibling."""
    at = 0
    while at < len(proof):
        size = 0 if proof[at] == "-" else 64
        yield proof[at], proof[at + 1 : at + 1 + size]
        at += 1 + size


def fold(digest: str, proof: str) -> str:
    """The root that follows from a leaf and its proof."""
    for side, sibling in steps(proof):
        digest = node_digest(digest) if side == "-" else node_digest(sibling, digest) if side == "<" else node_digest(digest, sibling)
    return digest


def proof_digest(proof: str) -> str:
    """sha256 of the siblings' digests as hex text, from the leaf's level to the root's."""
    return hashlib.sha256("".join(d for _, d in steps(proof)).encode()).hexdigest() if proof else EMPTY


def ranked(rows: DataFrame, order: list, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``place``, a row's number within its ``tree`` by ``order``, and ``width``, the tree's number of rows.

    Rows are sorted over all tasks; numbers within a task are added to the counts of the tasks before it. Equal rows are
    spread over tasks.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def number(batches):
        part, tree, at = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            numbers = []
            for t in batch.column("tree").to_pylist():
                at = at + 1 if t == tree and at >= 0 else 0
                tree = t
                numbers.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())], [*batch.schema.names, "part", "at"])

    keyed = rows.withColumn("spread", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()))
    columns = [F.col("tree").asc_nulls_first(), *order, F.col("spread")]
    ordered = keyed.repartitionByRange(*columns).sortWithinPartitions(*columns).drop("spread")
    local = scratch.save(ordered.mapInArrow(number, f"{schema}, part int, at bigint"), name)
    counts = local.groupBy("tree", "part").agg(F.count("*").alias("n"))
    one_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(one_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.save(counts.select(F.col("tree").alias("t"), F.col("part").alias("p"), before.alias("before"), F.sum("n").over(one_tree).alias("width")), f"{name}-starts")
    joined = local.join(starts, local["tree"].eqNullSafe(starts["t"]) & (local["part"] == starts["p"]))
    return joined.select(*rows.columns, (F.col("at") + F.col("before")).alias("place"), "width")


def _by_block(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions(F.col("tree").asc_nulls_first(), "block", *more)


def _sweep_up(tree_type: str, height: int):
    """Forward sweep over sorted (tree, block, place, width, digest): a row for each block."""

    def run(batches):
        def flush():
            nonlocal out
            rows, out = out, []
            kinds = [tree_kind, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["tree", "block", "width", "digest", "log"])

        def settle():
            block = Block(first, width, height)
            log = list(block.forward(digests))
            out.append((key[0], key[1], width, block.top(log[-1]), ["".join(m) for m in log]))

        key, first, width, digests, out, tree_kind = None, 0, 0, [], [], None
        for batch in batches:
            tree_kind = batch.schema.field("tree").type
            for tree, number, place, wide, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "place", "width", "digest"))):
                if (tree, number) != key:
                    if digests:
                        settle()
                        if len(out) >= 16:
                            yield flush()
                    key, first, width, digests = (tree, number), place, wide, []
                digests.append(digest)
        if digests:
            settle()
        if out:
            yield flush()

    return run, f"tree {tree_type}, block bigint, width bigint, digest string, log array<string>"


def _messages(log: list[str]) -> list[tuple[str, ...]]:
    return [(m[:64], m[64:]) if len(m) > 64 else (m,) for m in log]


def _sweep_down(make, members: list[str], names: list[str], height: int):
    """Reversed sweep over sorted (tree, block, place falling): a block's own row, with its log, its proof and what its
    leaves are told, comes before its members. make(members' columns, proofs, told) gives the columns of the result."""

    def run(batches):
        proofs: Iterator[tuple[int, str]] = iter(())
        told = None
        for batch in batches:
            rows, found, tolds = [], [], []
            own = {c: batch.column(c) for c in ("log", "above", "width", "told", "block")}
            for k, (member, place) in enumerate(zip(batch.column("member").to_pylist(), batch.column("place").to_pylist())):
                if not member:
                    head = {c: v[k].as_py() for c, v in own.items()}
                    proofs, told = Block(head["block"] << height, head["width"], height).backward(_messages(head["log"]), head["above"]), head["told"]
                    continue
                at, proof = next(proofs)
                if at != place:
                    raise ValueError(f"the proof of place {at} meets place {place}")
                rows.append(k)
                found.append(proof)
                tolds.append(told)
            if rows:
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(make([part.column(c) for c in members], found, tolds), names)

    return run


def _pass_on(columns, proofs, tolds):
    return [*columns, pa.array(proofs, pa.string()), pa.array(tolds, pa.string())]


class Forest:
    """The trees over (tree, place, width, digest), block by block, each round in a table of its own."""

    def __init__(self, leaves: DataFrame, scratch: Scratch, name: str, height: int):
        self.leaves, self.scratch, self.name, self.height = leaves, scratch, name, height
        self.kind = leaves.schema["tree"].dataType.simpleString()
        self.rounds: list[DataFrame] = []
        level, width = leaves, leaves.agg(F.max("width")).first()[0] or 0
        while True:
            run, schema = _sweep_up(self.kind, height)
            rows = _by_block(level.select("tree", F.shiftright("place", height).alias("block"), "place", "width", "digest"), F.col("place"))
            self.rounds.append(scratch.save(rows.mapInArrow(run, schema), f"{name}-{len(self.rounds)}"))
            if width <= 1 << height:
                break
            width = -(-width >> height)
            level = self.lower(len(self.rounds) - 1).withColumn("width", F.ceil(F.col("width") / (1 << height)).cast("bigint"))

    def lower(self, number: int) -> DataFrame:
        """The blocks of a round that are members of blocks of the next."""
        return self.rounds[number].where(F.col("width") > 1 << self.height).select("tree", F.col("block").alias("place"), "width", "digest")

    def last(self, number: int) -> DataFrame:
        """The blocks of a round that are whole trees."""
        return self.rounds[number].where(F.col("width") <= 1 << self.height)

    def roots(self) -> DataFrame:
        """(tree, digest)"""
        out = self.last(0)
        for number in range(1, len(self.rounds)):
            out = out.unionByName(self.last(number))
        return out.select("tree", "digest")

    def proofs(self, above: DataFrame, make, columns: list[str], names: list[str], schema: str) -> DataFrame:
        """What ``make`` gives for ``columns`` of the leaves and their proofs. ``above``: (tree, above, told), the proof of
        each tree's root, and a text that all its leaves are told."""
        known, above = None, above.withColumnRenamed("tree", "t")
        for number in reversed(range(len(self.rounds))):
            head = self.last(number).join(above, F.col("tree").eqNullSafe(F.col("t"))).drop("t")
            if known is not None:
                told = known.withColumnsRenamed({"tree": "t", "place": "b"})
                head = head.unionByName(self.rounds[number].join(told, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b"))).drop("t", "b"))
            head = head.select("tree", "block", F.lit((1 << 63) - 1).alias("place"), F.lit(False).alias("member"), "width", "log", "above", "told")
            members = (self.lower(number - 1) if number else self.leaves).drop("width", "digest" if number else "log")
            members = members.withColumns({"block": F.shiftright("place", self.height), "member": F.lit(True)})
            rows = _by_block(head.unionByName(members, allowMissingColumns=True), F.desc("place"))
            if not number:
                return rows.mapInArrow(_sweep_down(make, columns, names, self.height), schema)
            found = rows.mapInArrow(_sweep_down(_pass_on, ["tree", "place"], ["tree", "place", "above", "told"], self.height), f"tree {self.kind}, place bigint, above string, told string")
            known = self.scratch.save(found, f"{self.name}-proofs-{number}")
        raise AssertionError("a forest has a round at least")


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "lang", id_col: str = "doc_id", claims: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """A row for each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and proof.

    A leaf is the digest of the row's ``fields`` (``field``). The leaves of each value of ``tree``, by rising id, are a
    tree: two neighbours become one node, a last one without a neighbour a node too, until one, ``subroot``, remains. The
    subroots, by the trees' values (null first, UTF-8 order), make ``root`` likewise. ``proof`` names the siblings from
    leaf to root (see ``Block.backward``), ``proof_sha256`` is the digest of their digests. ``claims`` gives other
    expressions for some fields, as someone else may claim them: ``folded_root`` follows from the claimed row and the proof,
    ``verified`` tells whether it is the root. ``height`` is the number of levels of a block.

    A null id comes first; rows with one id are ordered by their leaves, and equal rows take any order. A single row is its
    own root. An empty table gives no rows. Extra columns take no part.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    claimed = [(claims or {}).get(f, docs[f]) for f in fields]
    leaves = scratch.save(docs.select(docs[tree].alias("tree"), docs[id_col].alias("doc_id"), leaf_digest(*(docs[f] for f in fields)).alias("digest"), leaf_digest(*claimed).alias("claimed")), "leaves")
    placed = scratch.save(ranked(leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest")], scratch, "order"), "places")
    scratch.drop("leaves", "order", "order-starts")
    forest = Forest(placed, scratch, "trees", height)

    subroots = forest.roots().select(F.lit(0).alias("tree"), F.col("tree").alias("value"), "digest")
    crown = Forest(scratch.save(ranked(subroots, [F.col("value").asc_nulls_first()], scratch, "subroot-order"), "subroots"), scratch, "crown", height)
    tops = crown.roots().select("tree", F.lit("").alias("above"), F.col("digest").alias("told"))

    def of_trees(columns, proofs, roots):
        value, digest = columns
        return [value, pa.array(proofs, pa.string()), pa.array([d + r for d, r in zip(digest.to_pylist(), roots)], pa.string())]

    above = scratch.save(crown.proofs(tops, of_trees, ["value", "digest"], ["tree", "above", "told"], f"tree {forest.kind}, above string, told string"), "above")

    def of_leaves(columns, proofs, told):
        doc_id, leaf, claim = columns
        roots = [t[64:] for t in told]
        folded = [fold(c, p) for c, p in zip(claim.to_pylist(), proofs)]
        text = lambda values: pa.array(values, pa.string())
        return [doc_id, leaf, text([t[:64] for t in told]), text(roots), text([proof_digest(p) for p in proofs]), text(folded), pa.array([f == r for f, r in zip(folded, roots)]), text(proofs)]

    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
    return forest.proofs(above, of_leaves, ["doc_id", "digest", "claimed"], names, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof string")
