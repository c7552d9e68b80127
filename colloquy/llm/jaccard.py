"""Exact Jaccard self-join of documents on word shingles, as connected components.

Sets of one size band meet in a tile. Within a tile the hash space is cut into one more part than two similar sets of the
band can differ by, so two linked sets agree in a whole part; equal parts name a group. A group's sets are compared with
the group's most central set first; what is then still apart is compared in square sub-tiles of bounded size. Hashed
bitmaps bound each overlap from above, and pairs that pass intersect their sorted arrays. Sub-tiles give no pairs: those on
bitmaps give the sets that have a candidate, those on arrays as many links as join what is linked. Equal sets count as one
node, so copies never multiply.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm._bitset import filter_rows, set_bits, slot_of
from colloquy.llm._scratch import Scratch, lean
from colloquy.llm._text import Words, chunks, join, mix, string_parts
from colloquy.llm.components import components

#: Ratio of the size bands, and parts above the least number, so that a few empty parts do not count.
BAND, SPARE = 1.5, 6
BITMAP_LONGS, MOST_LONGS = 16, 2048
#: So many of a set's smallest groups go along with it: two sets that share several groups are compared in one of them.
LEAST_GROUPS = 16
_edges = [1]
while _edges[-1] < 1 << 40:
    _edges.append(max(_edges[-1] + 1, int(_edges[-1] * BAND)))
EDGES = np.array(_edges)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; with fewer words than ``width``, the whole sequence is one."""
    words = Words(raw, offsets, fold=True)
    h, first = words.hash, words.first
    n = max(0, len(h) - width + 1)
    grams = h[:n].copy()
    for i in range(1, width):
        grams = join(grams, h[i : i + n], np.uint64(i))
    grams = mix(grams, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            code = h[a : a + 1].copy()
            for i in range(a + 1, b):
                code = join(code, h[i : i + 1], np.uint64(i - a))
            out.append(mix(code, 1000 + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(numbers: np.ndarray) -> int:
    """A set's name: equal for equal sets. Positive, as it is hashed to 63 bits."""
    with np.errstate(over="ignore"):
        code = mix(numbers, 77).sum(dtype=np.uint64) + np.uint64(len(numbers))
    return int(mix(np.array([code]))[0] >> np.uint64(1))


def parts_of(numbers: np.ndarray, percent: int) -> np.ndarray:
    """Names of a set's parts, in its own band's tile and, where it reaches into it, the next band's."""
    n = len(numbers)
    band = int(np.searchsorted(EDGES, n, "right")) - 1
    sums = None
    out = []
    for tile in (band, band + 1):
        if tile > band and n * 100 < percent * int(EDGES[tile]):
            break
        differ = (100 - percent) * 2 * (int(EDGES[tile + 1]) - 1) // (100 + percent)
        if differ == 0:
            continue  # sets of this tile are linked only if equal
        parts = differ + 1 + SPARE
        if sums is None:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(numbers, 99), dtype=np.uint64, out=sums[1:])
        bounds = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        edge = np.concatenate([[0], np.searchsorted(numbers, bounds), [n]])
        size = np.diff(edge)
        code = mix((sums[edge[1:]] - sums[edge[:-1]]) + size.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.arange(parts, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7), 3 + tile)
        # a linked set differs in at most ``own`` parts; if there are more others than empty ones, one that isn't empty is equal
        own = (100 - percent) * (n + min(int(EDGES[tile + 1]) - 1, 100 * n // percent)) // (100 + percent)
        out.append(code[size > 0] if parts - own > (size == 0).sum() else code)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap_of(numbers: np.ndarray, longs: int = BITMAP_LONGS) -> np.ndarray:
    bits = np.zeros(longs * 64, bool)
    bits[(numbers & np.uint64(longs * 64 - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def wide_bitmap_of(numbers: np.ndarray) -> np.ndarray | None:
    """A bitmap of two bits and more for each number, if the plain one has fewer: full bitmaps bound nothing."""
    longs = 1 << max(0, int(2 * len(numbers) - 1).bit_length() - 6)
    return bitmap_of(numbers, min(longs, MOST_LONGS)) if longs > BITMAP_LONGS else None


def _per_document(width: int, make, names: list[str], sets_of, wanted=None):
    """An Arrow function that calls make(id column, set list) over bounded runs of rows; with ``wanted``, only of rows
    whose column ``slot`` it wants."""

    def run(batches):
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted(batch.column("slot").to_numpy())))
            raw, offsets = string_parts(batch.column("text"))
            for a, b in chunks(offsets):
                columns = make(batch.column("doc_id").slice(a, b - a), sets_of(raw, offsets[a : b + 1], width))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def similar(na, nb, both, percent: int):
    return 100 * both >= percent * (na + nb - both)


def overlap_bound(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """An upper bound of the overlaps of sets with these bitmaps (rows) and sizes."""
    only_x = np.bitwise_count(x & ~y).sum(-1, dtype=np.int64)
    only_y = np.bitwise_count(y & ~x).sum(-1, dtype=np.int64)
    return np.minimum(nx - only_x, ny - only_y)


def _may_be_similar(x: str, y: str, percent: int) -> Column:
    """Whether two bitmaps of one length, of sets of ``na`` and ``nb`` numbers, leave enough overlap."""
    only = lambda p, q: F.aggregate(F.zip_with(p, q, lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))), F.lit(0), lambda s, v: s + v)
    top = F.least(F.col("na") - only(x, y), F.col("nb") - only(y, x))
    return 100 * top >= percent * (F.col("na") + F.col("nb") - top)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            xs, ys = batch.column("x"), batch.column("y")
            for i in range(batch.num_rows):
                x, y = xs[i].values.to_numpy(), ys[i].values.to_numpy()
                keep.append(bool(similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _whole_tiles(batches):
    """Tables of whole tiles, of rows that arrive sorted by tile, with the number where each tile starts and the last ends."""
    rest = None

    def starts(table):
        key = [table.column(c).to_numpy() for c in ("group", "i", "j")]
        return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])]))

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            edge = starts(rest)
            if len(edge) > 1:
                yield rest.slice(0, edge[-1]), edge
                rest = rest.slice(edge[-1])
    if rest is not None:
        yield rest, np.append(starts(rest), rest.num_rows)


def _lists(column) -> list[np.ndarray]:
    column = column.combine_chunks()
    values = np.array(column.flatten()).view(np.uint64)
    return np.split(values, np.cumsum(column.value_lengths().to_numpy())[:-1])


def _as_long(bits: np.ndarray, longs: int) -> np.ndarray:
    """The same set's bitmap of fewer bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, longs), 0)


def _candidates(tile: dict, bits: np.ndarray, percent: int):
    """For one row of a tile after the other, the rows of other components that the bounds leave, if the pair belongs to
    this group: the two share no smaller group by what is known of each one's smallest groups."""
    left, component, n, least, group = (tile[k] for k in ("left", "component", "n", "least", "group"))
    a, b = np.flatnonzero(left == tile["i"]), np.flatnonzero(left == tile["j"])
    for p, x in enumerate(a.tolist()):
        ys = b[p + 1 :] if tile["i"] == tile["j"] else b
        ys = ys[component[ys] != component[x]]
        ys = ys[np.minimum(n[ys], n[x]) * 100 >= np.maximum(n[ys], n[x]) * percent]
        if len(ys):
            ys = ys[similar(n[ys], n[x], overlap_bound(bits[ys], bits[x], n[ys], n[x]), percent)]
        if len(ys):
            ys = ys[~np.isin(least[ys], least[x][least[x] < group]).any(1)]
        if len(ys):
            yield x, ys


def _tiles_of(batches):
    """(rows, columns, lists of ``data``) of each tile."""
    for table, edge in _whole_tiles(batches):
        columns = {c: table.column(c).to_numpy() for c in ("group", "i", "j", "left", "node", "component", "n")}
        columns["least"] = np.array(table.column("least").combine_chunks().flatten()).reshape(-1, LEAST_GROUPS)
        data = _lists(table.column("data"))
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            tile = {c: v[s] if c in ("group", "i", "j") else v[s:e] for c, v in columns.items()}
            yield table.slice(s, e - s), tile, data[s:e]


def _near_rows(percent: int):
    """The rows, once each, that have a candidate by bitmaps in their tile."""

    def run(batches):
        for rows, tile, data in _tiles_of(batches):
            shortest = min(len(d) for d in data)
            bits = np.array([d if len(d) == shortest else _as_long(d, shortest) for d in data])
            near = np.zeros(len(data), bool)
            for x, ys in _candidates(tile, bits, percent):
                near[x] = near[ys] = True
            if near.any():
                yield from rows.select(["group", "node", "component", "n"]).filter(pa.array(near)).to_batches()

    return run


def _links(percent: int):
    """Links that join the components of each tile's sets as all of its links would: fewer than it has rows."""

    def run(batches):
        for _, tile, data in _tiles_of(batches):
            most = max(BITMAP_LONGS, min(MOST_LONGS, 1 << max(0, int(2 * tile["n"].max() - 1).bit_length() - 6)))
            bits = np.array([bitmap_of(d, most) for d in data]).view(np.uint64)
            tile["component"] = tile["component"].copy()
            found = []
            for x, ys in _candidates(tile, bits, percent):
                for y in ys.tolist():
                    one, other = tile["component"][x], tile["component"][y]
                    if one != other and similar(len(data[x]), len(data[y]), len(np.intersect1d(data[x], data[y], assume_unique=True)), percent):
                        found.append((tile["node"][x], tile["node"][y]))
                        tile["component"][tile["component"] == other] = one
            if found:
                both = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], ["a", "b"])

    return run


def linked_components(docs: DataFrame, width: int = 5, percent: int = 80, tile_rows: int = 512, id_col: str = "doc_id", text_col: str = "text", sets_of=shingle_sets) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that a document reaches by links) for every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; two documents are linked when their shingle sets have a
    Jaccard similarity of at least ``percent`` / 100. Null, empty and blank texts have no shingles and no links. Rows with
    the same id are documents of their own; a null id takes no part, and its component is null. No link between
    different sets is lost, however many sets are alike. ``sets_of`` makes other sets than shingles of (bytes, offsets,
    width), as sorted 64-bit hashes. Column ``node`` names the set.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    kept = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    id_type = kept.schema["doc_id"].dataType.simpleString()

    def names(ids, sets):
        return [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([bitmap_of(s) if len(s) else None for s in sets], pa.list_(pa.int64())), pa.array([wide_bitmap_of(s) for s in sets], pa.list_(pa.int64()))]

    nodes = scratch.save(kept.mapInArrow(lean(_per_document(width, names, ["doc_id", "n_shingles", "node", "bits", "wide"], sets_of)), f"doc_id {id_type}, n_shingles bigint, node bigint, bits array<bigint>, wide array<bigint>"), "nodes")
    # the document with the smallest id stands for all with its set; the others are left out of all that follows
    known = nodes.where("doc_id is not null and node is not null")
    least = scratch.save(known.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "least")
    sets = scratch.save(known.join(least, ["node", "doc_id"], "left_semi").dropDuplicates(["node"]).withColumnRenamed("n_shingles", "n"), "sets")
    copies = set_bits(known.select("doc_id", "node").join(least.select("node", F.col("doc_id").alias("least_id")), "node").where("doc_id != least_id").select(F.col("doc_id").alias("key")).distinct())
    mistaken = set_bits(filter_rows(least, "doc_id", copies).select(F.col("doc_id").alias("key")))
    shared = spark.sparkContext.broadcast((copies, mistaken))

    def stands(slots):
        some, again = shared.value
        return ~some.among(slots) | again.among(slots)

    def parts(ids, sets):
        found = [(node_of(s), parts_of(s, percent)) for s in sets if len(s)]
        node = np.repeat(np.array([x for x, _ in found], np.int64), [len(p) for _, p in found])
        group = np.concatenate([p for _, p in found]).view(np.int64) if found else np.zeros(0, np.int64)
        return [pa.array(group), pa.array(node)]

    slotted = kept.where("doc_id is not null").select("doc_id", "text", slot_of("doc_id").alias("slot"))
    shuffled = slotted.mapInArrow(lean(_per_document(width, parts, ["grp", "node"], sets_of, stands)), "grp bigint, node bigint").repartition("grp")
    members = scratch.save(shuffled.dropDuplicates(["grp", "node"]).withColumn("many", F.count("*").over(Window.partitionBy("grp"))).where("many > 1"), "members")
    central = scratch.save(members.groupBy("node").agg(F.sum("many").alias("weight")), "central")
    leaders = scratch.save(members.join(central, "node").groupBy("grp").agg(F.max(F.struct("weight", "node")).alias("best")).select("grp", F.col("best.node").alias("leader")), "leaders")
    first_pairs = members.join(leaders, "grp").where("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    first_pairs = scratch.save(first_pairs, "pairs")

    def arrays(ids, sets):
        some = [s for s in sets if len(s)]
        return [pa.array([node_of(s) for s in some], pa.int64()), pa.array([s.view(np.int64) for s in some], pa.list_(pa.int64()))]

    def fetched(asked: DataFrame, name: str) -> DataFrame:
        """node and set of the nodes asked for, from one document each."""
        asked = scratch.save(asked, f"{name}-asked")
        ids = set_bits(least.join(asked, "node", "left_semi").select(F.col("doc_id").alias("key")))
        told = spark.sparkContext.broadcast(ids)
        full = slotted.mapInArrow(lean(_per_document(width, arrays, ["node", "set"], sets_of, lambda slots: told.value.among(slots))), "node bigint, set array<bigint>")
        return scratch.save(full.join(asked.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), f"{name}-sets")

    def exact(pairs: DataFrame, name: str) -> DataFrame:
        """The linked ones of pairs that passed the bounds: only their sets are fetched."""
        full = fetched(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), name)
        both = pairs.join(full.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(full.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        links = scratch.save(both.select("a", "b", "x", "y").mapInArrow(lean(_verify(percent)), "a bigint, b bigint"), name)
        scratch.drop(f"{name}-asked", f"{name}-sets")
        return links

    def bounded(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that sizes and bitmaps don't rule out."""
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits{side}"), F.col("wide").alias(f"wide{side}")), side)
        possible = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).where(_may_be_similar("bitsa", "bitsb", percent))
        halved = lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) / 2), F.slice(x, F.size(x) / 2 + 1, F.size(x) / 2), lambda p, q: p.bitwiseOR(q))
        # bitmaps of linked sets are of the same length, or one is of twice the other's
        x = F.when(F.size("widea") == 2 * F.size("wideb"), halved("widea")).otherwise(F.col("widea"))
        y = F.when(F.size("wideb") == 2 * F.size("widea"), halved("wideb")).otherwise(F.col("wideb"))
        possible = possible.withColumns({"widea": x, "wideb": y})
        unknown = F.coalesce(F.size("widea") != F.size("wideb"), F.lit(True)) | F.col("widea").isNull() | F.col("wideb").isNull()
        return scratch.save(possible.where(unknown | _may_be_similar("widea", "wideb", percent)).select("a", "b"), name)

    links = exact(bounded(first_pairs, "bounded"), "links")
    joined = components(links, scratch, "first")

    # groups whose members, but for the one that all were compared with, are still apart: what the bounds leave of them
    # stays as rows of sets, never as pairs
    others = members.join(leaders, "grp").where("node != leader").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_groups = others.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    apart = others.join(open_groups, "grp", "left_semi").join(sets.select("node", "n"), "node").select(F.col("grp").alias("group"), "node", "component", "n")
    apart = scratch.save(apart, "apart")
    filled = F.concat(F.sort_array(F.collect_list("group")), F.array_repeat(F.lit((1 << 63) - 1), LEAST_GROUPS))
    smallest = scratch.save(apart.groupBy("node").agg(F.slice(filled, 1, LEAST_GROUPS).alias("least")), "smallest")

    def dealt(rows: DataFrame, data: DataFrame, numbers: Column) -> DataFrame:
        """Rows of (node, data) in square tiles of ``tile_rows`` rows a side, and of 2048 ``numbers`` for each of these."""
        sized = rows.groupBy("group").agg(F.ceil(F.greatest(F.count("*"), F.sum(numbers) / 2048) / tile_rows).cast("int").alias("tiles"))
        tiled = rows.join(sized, "group").withColumn("left", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiled = tiled.withColumns({"i": F.least("left", "other"), "j": F.greatest("left", "other")}).join(data.join(smallest, "node"), "node")
        return tiled.select("group", "i", "j", "left", "node", "component", "n", "least", "data").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")

    near = apart
    for name, bits in (("near", F.col("bits")), ("nearer", F.coalesce("wide", "bits"))):
        kept_rows = dealt(near, sets.select("node", bits.alias("data")), F.lit(0)).mapInArrow(lean(_near_rows(percent)), apart.schema)
        near = scratch.save(kept_rows.distinct(), name)
    scratch.drop("members", "central", "leaders", "pairs", "bounded", "apart", "near")
    if near.take(1):
        full = fetched(near.select("node").distinct(), "more")
        more = scratch.save(dealt(near, full.withColumnRenamed("set", "data"), F.col("n")).mapInArrow(lean(_links(percent)), "a bigint, b bigint"), "more")
        scratch.drop("more-asked", "more-sets", "nearer", "smallest")
        if more.take(1):
            joined = components(links.unionByName(more), scratch, "second")

    # the smallest id of each set's component; sets without links have their own
    placed = least.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = scratch.save(placed.groupBy("component").agg(F.min("doc_id").alias("lowest")), "lowest")
    labels = scratch.save(placed.join(lowest, "component").select("node", "lowest"), "labels")
    out = nodes.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"), "node")


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the document with the smallest id of each component; rows with a null id stay.

    Only rows of ids that bit sets of bounded size cannot tell apart are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "jaccard-gone")
    linked = scratch.save(linked_components(docs, width, percent, id_col=id_col, text_col=text_col).select("doc_id", (F.col("component_id") < F.col("doc_id")).alias("goes")).where("doc_id is not null").distinct(), "linked")
    gone = linked.where("goes").select(F.col("doc_id").alias("key"))
    out_bits = set_bits(gone)
    stay_bits = set_bits(filter_rows(linked.where("not goes").select(F.col("doc_id").alias("key")), "key", out_bits))
    clear = filter_rows(docs, id_col, out_bits, inside=False)
    maybe = filter_rows(docs, id_col, out_bits, stay_bits)
    key = "__gone_id"
    gone_ids = gone.select(F.col("key").alias(key))
    return clear.unionByName(maybe.join(gone_ids, maybe[id_col] == gone_ids[key], "left_anti"))
