"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are range partitioned by id, so partitions and the shards within them
are in ascending order of doc_id. A shard holds whole documents, ``SHARD_IDS``
ids or the end of the partition closing it. Its ids become a grammar: in each
round the pairs of neighbours that occur ``LEAST`` times or more are counted by
sorting, every place takes the more frequent of the overlapping pairs there, and
each pair taken becomes a nonterminal. Rounds end when one shortens the sequence
by less than ``1 / GAIN`` of it. Unlike the textbook form, which replaces one
pair at a time, a round replaces all pairs that win their places.

A shard's payload, all numbers little-endian and unsigned:

    magic "RPG1"; width, rounds (1 byte each); 2 bytes unused
    first nonterminal, rules, symbols, ids (4, 4, 8, 8 bytes)
    rules known after each round (4 bytes each)
    left and right symbol and expansion length of each rule (4 bytes each, by column)
    symbols (``width`` bytes each, 2 to 4)

Rule k makes nonterminal ``first + k``. Expansion lengths tell where an id stands
among the symbols, so any range is decoded from the symbols that cover it alone.
A shard's row also has the ids and sizes of its documents; the table of shards
is Parquet in the shared folder, written by Spark's committer, so a lost task is
written again and never twice.

Null and empty texts have the end id only. A null doc_id precedes all others,
equal ids stay in the order they were read in and may fall into several shards.
A very long text is one document of one shard, which is then larger than others.
An empty table gives no shard. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.llm import bpe_tree
from oddsloom.llm.common import strings
from oddsloom.session import materialize

#: Ids that close a shard; least count of a pair; a round must take this part of the symbols for another to follow.
SHARD_IDS, LEAST, GAIN = 1 << 20, 16, 16
END_ID = 0
SHARDS = "part int, number int, n_ids long, doc_ids array<long>, doc_sizes array<long>, payload binary"

_HEAD = struct.Struct("<4sBBHIIQQ")
_MAGIC = b"RPG1"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _taken(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose pair is replaced, the number of the pair there, and the pairs by number."""
    keys = symbols[:-1].astype(np.uint64)
    keys <<= np.uint64(32)
    keys |= symbols[1:]
    ordered = np.sort(keys)
    ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]), len(ordered) - 1)
    sizes = np.diff(ends, prepend=-1)
    often = np.flatnonzero(sizes >= least)
    pairs, counts = ordered[ends[often]], sizes[often]
    if not len(pairs):
        return (np.empty(0, np.int64),) * 2 + (pairs,)
    # A hash table of the frequent pairs; one whose slot is taken by another waits for the next round.
    shift = np.uint64(64 - len(pairs).bit_length() - 2)
    table = np.zeros(1 << (64 - int(shift)), np.int32)
    table[(pairs * _SPREAD) >> shift] = np.arange(len(pairs))
    found = table[(keys * _SPREAD) >> shift]
    count = counts[found]
    count[pairs[found] != keys] = 0
    # Equal neighbours alternate, counted from where their run begins, so that equal passages are cut alike.
    begins = np.arange(len(count))
    steps = begins.copy()
    begins[1:][count[1:] == count[:-1]] = 0
    np.maximum.accumulate(begins, out=begins)
    strength = 2 * count + ((steps - begins) & 1 == 0)
    wins = count > 0
    wins[1:] &= strength[1:] > strength[:-1]
    wins[:-1] &= strength[:-1] > strength[1:]
    places = np.flatnonzero(wins)
    used, numbers = np.unique(found[places], return_inverse=True)
    return places, numbers, pairs[used]


def compress(ids: np.ndarray, least: int = LEAST, gain: int = GAIN) -> bytes:
    """Payload of a shard with these ids."""
    symbols = ids.astype(np.uint32)
    first = int(symbols.max(initial=0)) + 1
    lengths, rules, ends = np.empty(0, np.int64), [], []

    def size(of: np.ndarray) -> np.ndarray:
        result = np.ones(len(of), np.int64)
        result[of >= first] = lengths[of[of >= first] - first]
        return result

    while len(symbols) > 1:
        places, numbers, pairs = _taken(symbols, least)
        if not len(places):
            break
        left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        symbols[places] = (first + len(lengths) + numbers).astype(np.uint32)
        lengths = np.concatenate((lengths, size(left) + size(right)))
        rules.append((left, right))
        ends.append(len(lengths))
        before = len(symbols)
        symbols = np.delete(symbols, places + 1)
        if len(places) * gain < before or len(ends) == 255:
            break
    columns = [np.concatenate([rule[side] for rule in rules]) if rules else np.empty(0) for side in (0, 1)]
    known = first + len(lengths)
    width = 2 if known <= 1 << 16 else 3 if known <= 1 << 24 else 4
    head = _HEAD.pack(_MAGIC, width, len(ends), 0, first, len(lengths), len(symbols), len(ids))
    numbers = [np.array(ends), *columns, lengths]
    body = symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    return b"".join([head, *[column.astype("<u4").tobytes() for column in numbers], body.tobytes()])


class Grammar:
    """A payload opened for decoding."""

    def __init__(self, payload: bytes) -> None:
        magic, width, rounds, _, self.first, rules, symbols, self.n_ids = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size
        columns = []
        for size in (rounds, rules, rules, rules):
            columns.append(np.frombuffer(payload, "<u4", size, at))
            at += 4 * size
        self.ends, self.left, self.right, self.lengths = columns
        packed = np.zeros((symbols, 4), np.uint8)
        packed[:, :width] = np.frombuffer(payload, np.uint8, symbols * width, at).reshape(-1, width)
        self.symbols = packed.view("<u4").ravel()

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        for begin in [0, *self.ends.tolist()][:-1][::-1]:
            pairs = symbols >= self.first + begin
            places = np.flatnonzero(pairs)
            if len(places):
                rules = symbols[places] - np.uint32(self.first)
                symbols = np.repeat(symbols, pairs + 1)
                places = places + np.arange(len(places))
                symbols[places], symbols[places + 1] = self.left[rules], self.right[rules]
        return symbols

    def ids(self) -> np.ndarray:
        return self._expanded(self.symbols)

    def range(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` up to ``end``, expanding only symbols that cover them."""
        begin, end = max(0, begin), min(end, self.n_ids)
        if begin >= end:
            return np.empty(0, np.uint32)
        sizes = np.ones(len(self.symbols), np.int64)
        pairs = self.symbols >= self.first
        sizes[pairs] = self.lengths[self.symbols[pairs] - np.uint32(self.first)]
        ends = np.cumsum(sizes)
        low, high = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left") + 1
        skipped = begin - int(ends[low] - sizes[low])
        return self._expanded(self.symbols[low:high])[skipped : skipped + end - begin]


def write(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode whole texts with the tokenizer file ``path``, write shards in order of doc_id and give the table of them."""

    def shard(part: int, number: int, doc_ids: list, held: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(held)
        values = [part, number, len(ids), doc_ids, [len(one) for one in held], compress(ids)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = [field.split()[0] for field in SHARDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, end = bpe_tree.codec(path), np.array([END_ID], np.uint32)
        part = number = size = 0
        doc_ids, held = [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                part = some["part"][0].as_py()
                for doc_id, text in zip(some["doc_id"].to_pylist(), strings(some["text"]), strict=True):
                    ids = np.concatenate((book.encode(text), end))
                    doc_ids.append(doc_id)
                    held.append(ids)
                    size += len(ids)
                    if size >= shard_ids:
                        yield shard(part, number, doc_ids, held)
                        number, size, doc_ids, held = number + 1, 0, [], []
        if held:
            yield shard(part, number, doc_ids, held)

    keys = ["doc_id", "row"]
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    return materialize(placed.mapInArrow(run, SHARDS), "token-shards")


def starts(shards: DataFrame) -> DataFrame:
    """part, number and the ids in all shards before it."""
    upto = (Window.unboundedPreceding, -1)
    sizes = shards.select("part", "number", "n_ids")
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(*upto))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("held"))
    outer = parts.select("part", F.sum("held").over(Window.orderBy("part").rowsBetween(*upto)).alias("outer"))
    return sizes.withColumn("inner", inner).join(outer, "part").select(
        "part", "number", (F.coalesce("outer", F.lit(0)) + F.coalesce("inner", F.lit(0))).alias("first_id")
    )


def summary(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the shards' decoded ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["part", "number", "doc_ids", "doc_sizes", "payload"]).to_pylist():
                plain = memoryview(Grammar(row["payload"]).ids().astype("<u4").tobytes())
                ends = np.cumsum(row["doc_sizes"]).tolist()
                begins = [0, *ends[:-1]]
                size = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * size, pa.int32()), pa.array([row["number"]] * size, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(begins, pa.int64()),
                        pa.array(row["doc_sizes"], pa.int64()),
                        pa.array([zlib.crc32(plain[4 * b : 4 * e]) for b, e in zip(begins, ends)], pa.int64()),
                    ],
                    names=["part", "number", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    schema = "part int, number int, doc_id long, within long, n_tokens long, ids_crc32 long"
    return shards.mapInArrow(run, schema).join(starts(shards), ["part", "number"]).select(
        "doc_id", (F.col("first_id") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def fetch(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of parts of documents: ``wanted`` has doc_id, begin and end, counted from the document's first id."""
    index = shards.select("part", "number", F.posexplode(F.arrays_zip("doc_ids", "doc_sizes")).alias("at", "doc"), "doc_sizes")
    index = index.select(
        "part", "number", F.col("doc.doc_ids").alias("doc_id"), F.col("doc.doc_sizes").alias("size"),
        F.aggregate(F.slice("doc_sizes", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, b: a + b).alias("within"),
    )
    asked = index.join(wanted.select("doc_id", "begin", "end"), "doc_id")

    def run(requests: pa.Table, shard: pa.Table) -> pa.Table:
        book = Grammar(shard["payload"][0].as_py())
        found = []
        for row in requests.to_pylist():
            begin, end = max(0, row["begin"]), min(row["end"], row["size"])
            found.append(book.range(row["within"] + begin, row["within"] + end))
        columns = {name: requests[name] for name in ("doc_id", "begin", "end")}
        return pa.table({**columns, "ids": pa.array(found, pa.list_(pa.int64()))})

    needed = asked.select(F.col("part").alias("p"), F.col("number").alias("k")).distinct()
    opened = shards.select(F.col("part").alias("p"), F.col("number").alias("k"), "payload").join(needed, ["p", "k"], "left_semi")
    schema = "doc_id long, begin long, end long, ids array<long>"
    return asked.groupBy("part", "number").cogroup(opened.groupBy("p", "k")).applyInArrow(run, schema)
