"""Near copies by SimHash over a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so that neighbours in the order
share bits, and cut into blocks. A node of the index is described by two masks:
the bits set in all fingerprints below it and those set in any. Two nodes are at
least as far apart as the bits that are fixed in both and differ, so a pair of
upper nodes prunes everything below it. Pairs of nodes descend level by level
as joins; what reaches the blocks is compared there, first by small groups and
then by fingerprint. A pair of blocks gives only the edges of a spanning forest
of its links, so a dense group of n fingerprints gives n edges and not n * n.
Classes are the connected components of all edges, found by alternating stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.common import strings
from oddsloom.session import materialize

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Fingerprints in a block at most, and in the groups that a block is searched by.
BLOCK, GROUP = 8192, 32
_HASHES, _COMPARED, _FANOUT_BITS = 1 << 16, 1 << 21, 5


def fingerprint(text: str) -> int:
    """SimHash of a text's word shingles, unsigned; zero for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    begins, ends = begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, count, total = xxhash.xxh64_intdigest, len(begins), np.zeros(64, np.int64)
    for at in range(0, count, _HASHES):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begins[at : at + _HASHES], ends[at : at + _HASHES])]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and the fingerprint of each whole text as a signed long; null texts count as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(text) for text in strings(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch[key] for key in keys], pa.array(marks, pa.int64())], names=[*keys, "fingerprint"]
            )

    schema = docs.select(*keys).schema.add("fingerprint", "long")
    return docs.select(*keys, "text").mapInArrow(run, schema)


def gray_order(mark: Column) -> Column:
    """Rank of a fingerprint in the reflected Gray code, shifted so that signed order is rank order."""
    rank = mark
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _blocks(marks: DataFrame) -> DataFrame:
    """Distinct fingerprints in Gray order, cut into blocks; a block's id is the order of its first one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(orders: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(orders[0])], pa.int64()),
                    pa.array([int(np.bitwise_and.reduce(values))], pa.int64()),
                    pa.array([int(np.bitwise_or.reduce(values))], pa.int64()),
                    pa.array([values.tolist()], pa.list_(pa.int64())),
                ],
                names=["block", "every", "any", "marks"],
            )

        orders, values = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            orders = np.concatenate((orders, batch["place"].to_numpy(zero_copy_only=False)))
            values = np.concatenate((values, batch["fingerprint"].to_numpy(zero_copy_only=False)))
            while len(values) > BLOCK:
                yield cut(orders[:BLOCK], values[:BLOCK])
                orders, values = orders[BLOCK:], values[BLOCK:]
        if len(values):
            yield cut(orders, values)

    placed = marks.select("fingerprint", gray_order(F.col("fingerprint")).alias("place"))
    ordered = placed.repartitionByRange("place").sortWithinPartitions("place")
    return ordered.mapInArrow(run, "block long, every long, any long, marks array<long>")


def _apart(a: str, b: str) -> Column:
    """Least distance between fingerprints below two nodes."""
    differ = F.expr(f"({a}.every & ~{b}.any) | ({b}.every & ~{a}.any)")
    return F.bit_count(differ)


def _block_pairs(nodes: DataFrame, count: int) -> DataFrame:
    """(a, b) of blocks, a <= b, that no node of the index keeps apart.

    ``nodes`` are the blocks without their fingerprints. Upper nodes group
    blocks by leading bits of their rank; each level prunes the next one.
    """
    depth = max(1, math.ceil(math.log2(max(2, count))))
    steps = [*range(_FANOUT_BITS, depth + _FANOUT_BITS, _FANOUT_BITS)]
    place = F.col("block").bitwiseXOR(F.lit(-(1 << 63)))
    keyed = nodes.withColumns({f"up{bits}": F.shiftrightunsigned(place, 64 - bits) for bits in steps})
    levels = []
    for bits, upper in zip(steps, [steps[0], *steps]):
        levels.append(
            keyed.groupBy(F.col(f"up{bits}").alias("node")).agg(
                F.bit_and("every").alias("every"), F.bit_or("any").alias("any"), F.first(f"up{upper}").alias("parent")
            )
        )
    levels.append(keyed.select(F.col("block").alias("node"), "every", "any", F.col(f"up{steps[-1]}").alias("parent")))
    # The top level has 2 ** _FANOUT_BITS nodes at most; each names all that it may be paired with.
    top = F.sequence(F.lit(0).cast("long"), F.lit((1 << _FANOUT_BITS) - 1).cast("long"))
    pairs = levels[0].select(F.col("node").alias("a"), F.explode(top).alias("b")).where("a <= b")
    for level in [levels[0].drop("parent").withColumn("parent", F.col("node")), *levels[1:]]:
        left, right = level.alias("l"), level.alias("r")
        both = pairs.join(left, F.col("a") == F.col("l.parent")).join(right, F.col("b") == F.col("r.parent"))
        near = both.where(_apart("l", "r") <= DISTANCE).where("l.node <= r.node")
        pairs = near.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    return pairs


def _groups(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(marks), GROUP)
    return np.bitwise_and.reduceat(marks, starts), np.bitwise_or.reduceat(marks, starts)


def _joined(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Component labels after adding links; a label is the smallest index of its component."""
    while True:
        low = np.minimum(labels[left], labels[right])
        merged = labels.copy()
        for ends in (left, right):
            np.minimum.at(merged, ends, low)
            np.minimum.at(merged, labels[ends], low)
        merged = merged[merged]
        if (merged == labels).all():
            return labels
        labels = merged


def forest(first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two blocks, or within one where ``second`` is None."""
    other = first if second is None else second
    every_a, any_a = _groups(first)
    every_b, any_b = _groups(other)
    marks = first if second is None else np.concatenate((first, second))
    shift = 0 if second is None else len(first)
    padded = [np.pad(x, (0, -len(x) % GROUP)).reshape(-1, GROUP) for x in (first, other)]
    valid = [np.pad(np.ones(len(x), bool), (0, -len(x) % GROUP)).reshape(-1, GROUP) for x in (first, other)]
    fixed = (every_a[:, None] & ~any_b[None, :]) | (every_b[None, :] & ~any_a[:, None])
    near = np.bitwise_count(fixed.view(np.uint64)) <= DISTANCE
    rows, columns = np.nonzero(np.triu(near) if second is None else near)
    labels = np.arange(len(marks))
    step = max(1, _COMPARED // GROUP**2)
    for at in range(0, len(rows), step):
        r, c = rows[at : at + step], columns[at : at + step]
        apart = padded[0][r][:, :, None] ^ padded[1][c][:, None, :]
        close = np.bitwise_count(apart.view(np.uint64)) <= DISTANCE
        close &= valid[0][r][:, :, None] & valid[1][c][:, None, :]
        pair, i, j = np.nonzero(close)
        left, right = r[pair] * GROUP + i, c[pair] * GROUP + j + shift
        apart_ends = labels[left] != labels[right]
        if apart_ends.any():
            labels = _joined(labels, left[apart_ends], right[apart_ends])
    child = np.nonzero(labels != np.arange(len(labels)))[0]
    return marks[child], marks[labels[child]]


def _links(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that connect what lies within the distance."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                first = batch["first"][row].values.to_numpy(zero_copy_only=False)
                same = batch["a"][row].as_py() == batch["b"][row].as_py()
                second = None if same else batch["second"][row].values.to_numpy(zero_copy_only=False)
                u, v = forest(first, second)
                if len(u):
                    high, low = np.maximum(u, v), np.minimum(u, v)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["u", "v"]
                    )

    held = blocks.select("block", "marks")
    rows = (
        pairs.join(held.select(F.col("block").alias("a"), F.col("marks").alias("first")), "a")
        .join(held.select(F.col("block").alias("b"), F.col("marks").alias("second")), "b")
        .withColumn("second", F.when(F.col("a") != F.col("b"), F.col("second")).otherwise(F.array().cast("array<long>")))
        .select("a", "b", "first", "second")
        .repartition("a", "b")
    )
    return rows.mapInArrow(run, "u long, v long").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that is not the smallest of its component, and that smallest node.

    Alternates large stars and small stars until nothing changes. Every round is
    written to the shared folder, which cuts the lineage.
    """
    edges = materialize(edges, "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = _state(edges)
        if now == state:
            return edges
        state = now


def classes(marks: DataFrame, least: Column) -> DataFrame:
    """(fingerprint, least): each distinct fingerprint and the smallest ``least`` of its class.

    ``marks`` has a row per document; a written table keeps it from being
    computed again.
    """
    distinct = materialize(marks.groupBy("fingerprint").agg(F.min(least).alias("own")), "distinct")
    blocks = materialize(_blocks(distinct), "blocks")
    pairs = _block_pairs(blocks.drop("marks"), blocks.count())
    links = components(_links(blocks, pairs))
    roots = links.select("v").distinct().select(F.col("v").alias("fingerprint"), F.col("v").alias("root"))
    member = links.select(F.col("u").alias("fingerprint"), F.col("v").alias("root")).unionByName(roots)
    placed = distinct.join(member, "fingerprint", "left").select(
        "fingerprint", "own", F.coalesce("root", "fingerprint").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("own").alias("least"))
    return materialize(placed.join(lowest, "root").select("fingerprint", "least"), "classes")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links.

    Null ids take part but are never a component's id unless all of its ids are
    null. Repeated rows stay repeated.
    """
    marks = materialize(with_fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long"))), "fingerprints")
    known = classes(marks, F.col("doc_id"))
    return marks.join(known, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("least").alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: the one with the smallest (doc_id, hash of the text); all columns as they came.

    Rows equal in id and text are one document; the smallest of them stays.
    """
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    marks = materialize(with_fingerprints(docs.withColumn("_hash", text_hash), ("doc_id", "_hash")), "fingerprints")
    known = classes(marks, F.struct("doc_id", "_hash"))
    kept = known.select(F.col("least.doc_id").alias("_id"), F.col("least._hash").alias("_kept")).distinct()
    rest = [name for name in docs.columns if name != "doc_id"]
    held = docs.withColumn("_hash", text_hash).join(
        kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_kept")), "left_semi"
    )
    single = held.groupBy("doc_id", "_hash").agg(F.min(F.struct(*rest)).alias("_row"))
    return single.select(*[F.col("doc_id") if name == "doc_id" else F.col(f"_row.{name}") for name in docs.columns])
