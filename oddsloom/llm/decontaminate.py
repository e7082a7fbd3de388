"""Benchmark passages in documents: rare word n-grams as seeds, then Smith-Waterman.

Test items are cut into passages of words. A first pass counts in how many
documents each of their n-grams occurs; a seed weighs the more the rarer it is.
A second pass looks the n-grams of whole documents up among the seeds. Where the
seeds of a passage that lie close together have a small share of the weight of
all its seeds, document and passage are aligned by Smith-Waterman over words.
The share is relative, so a passage that was copied often, or edited alike in
many copies, is found as well. The score is the alignment's share of a perfect
one, so inserted, deleted and replaced words lower it step by step. Long items
are also cut into short overlapping parts, so that an excerpt of a fixed number
of words is found however long its item is; a part's score is that of the part.

Only passages travel to the tasks, in shards of a fixed number of words; each
further shard is a further pass, so what is broadcast does not grow. Words are
runs of letters and digits in ASCII and of all other characters, in lower case.
Null texts count as empty. Items of three or four words are found where they
stand whole, word for word; items of fewer identify no passage and are never
reported. Repeated rows are searched each, repeated items reported once a
document. A very long text is searched whole, near its seeds only. Empty tables
give no rows. Words are told apart by 64-bit hashes, a polynomial over their
bytes, so texts made to collide can count as equal. Extra columns are ignored by
``find`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.common import strings

#: Words of a seed, of the shortest item, and of items that have to stand whole.
GRAM, LEAST_WORDS, WHOLE_WORDS = 3, 3, 4
#: Words of a passage, and by how many the next one of a long item starts later.
PASSAGE, STRIDE = 256, 128
#: Words of all passages that one pass broadcasts (8 bytes each, and as much for the seeds).
SHARD_WORDS = 1_000_000
THRESHOLD = 0.4
#: Words of a part of a long item, by how many the next starts later, and matched words that are worth a find in one.
#: Any excerpt of ENOUGH words is whole in some part, and items of up to ENOUGH / THRESHOLD words need no parts.
PART, PART_STRIDE, ENOUGH = 50, 25, 25
#: Share of the weight of a passage's seeds that is worth an alignment.
SEED_SHARE = 0.05
_MATCH, _MISMATCH, _GAP = 2, -1, -1
_FILTER_BITS = 22

_LOWER = np.zeros(256, np.uint8)
for _code in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _LOWER[_code] = _code
_LOWER[65:91] = np.arange(97, 123)
_PRIME, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_BYTES = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _SPREAD
_BYTES ^= _BYTES >> np.uint64(29)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _SPREAD
    return values ^ (values >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    codes = _LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    inside = codes > 0
    edges = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    offsets = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _PRIME))
    return _mixed(np.add.reduceat(_BYTES[codes[inside]] * powers[offsets], first))


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each n-gram, by the place of its first word."""
    count = len(words) - GRAM + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for place in range(GRAM):
        total = total * _PRIME + words[place : place + count]
    return _mixed(total)


def align(passage: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of two word sequences, and its first place in ``window`` and the one after its last.

    A cell holds its score in the upper and the place where its alignment begins
    in the lower half of a number, so one maximum carries both along.
    """
    one = np.int64(1) << np.int64(32)
    places = np.arange(len(window) + 1)
    slope = -_GAP * places * one
    row, best = places.copy(), (0, 0, 0)
    for word in passage:
        hit = np.where(window == word, _MATCH, _MISMATCH) * one
        cell = np.maximum(row + _GAP * one, places)
        np.maximum(cell[1:], row[:-1] + hit, out=cell[1:])
        row = np.maximum.accumulate(cell + slope) - slope
        top = int(row.argmax())
        if int(row[top] >> 32) > best[0]:
            best = int(row[top] >> 32), int(row[top] & (one - 1)), top
    return best


class Seeds:
    """Passages of one shard, and the sorted hashes of their seeds with their weights."""

    def __init__(
        self, passages: list[tuple[int | None, int, np.ndarray]], seeds: list[np.ndarray], weights: list[np.ndarray]
    ) -> None:
        self.items = [item for item, _, _ in passages]
        self.parts = [number < 0 for _, number, _ in passages]
        self.words = [words for _, _, words in passages]
        hashes = np.concatenate([*seeds, np.empty(0, np.uint64)])
        owners = np.repeat(np.arange(len(seeds)), [len(own) for own in seeds])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]
        self.weights = np.concatenate([*weights, np.empty(0)])[order]
        self.wanted = SEED_SHARE * np.bincount(owners, self.weights[np.argsort(order)], len(seeds))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the grams that are seeds, and for each the number of the seed; one for each passage that has it."""
        places = np.nonzero(self.filter[grams >> np.uint64(64 - _FILTER_BITS)])[0]
        low = np.searchsorted(self.hashes, grams[places], "left")
        high = np.searchsorted(self.hashes, grams[places], "right")
        sizes = high - low
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        at = np.arange(int(sizes.sum())) - np.repeat(first, sizes) + np.repeat(low, sizes)
        return np.repeat(places, sizes), at

    def matches(self, text: str, threshold: float) -> dict[int | None, tuple[float, int, int]]:
        """Per item found in a text: score, and the first and last word of the alignment.

        Parts of an item only count where no whole passage of it is found.
        """
        words = word_hashes(text)
        places, seeds = self.hits(gram_hashes(words))
        found: dict[int | None, tuple[float, int, int]] = {}
        in_parts: dict[int | None, tuple[float, int, int]] = {}
        if not len(places):
            return found
        reached = np.bincount(self.owners[seeds], self.weights[seeds], len(self.words)) >= self.wanted
        for owner in np.unique(self.owners[seeds][reached[self.owners[seeds]]]):
            passage, mine = self.words[owner], self.owners[seeds] == owner
            own, own_seeds = places[mine], seeds[mine]
            gaps = np.nonzero(np.diff(own) > 2 * len(passage))[0] + 1
            for cluster, held in zip(np.split(own, gaps), np.split(own_seeds, gaps), strict=True):
                if self.weights[np.unique(held)].sum() < self.wanted[owner]:
                    continue
                begin = max(0, int(cluster[0]) - len(passage))
                end = min(len(words), int(cluster[-1]) + GRAM + len(passage))
                best, first, last = align(passage, words[begin:end])
                score = best / (_MATCH * len(passage))
                kept, least = (in_parts, max(threshold, ENOUGH / PART)) if self.parts[owner] else (found, threshold)
                least = 1.0 if len(passage) <= WHOLE_WORDS else least
                known = kept.get(self.items[owner])
                if score >= least and (known is None or score > known[0]):
                    kept[self.items[owner]] = (score, begin + first, begin + last - 1)
        return {**in_parts, **found}


def passages(benchmark: DataFrame) -> DataFrame:
    """item_id, number and word hashes (as signed longs) of all items of enough words; parts have numbers below zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, numbers, words = [], [], []
            for item, text in zip(batch["item_id"].to_pylist(), strings(batch["text"]), strict=True):
                hashes = word_hashes(text)
                if len(hashes) >= LEAST_WORDS:
                    last = max(0, -(-(len(hashes) - PASSAGE) // STRIDE))
                    for number in range(last + 1):
                        items.append(item)
                        numbers.append(number)
                        words.append(hashes[number * STRIDE : number * STRIDE + PASSAGE].view(np.int64))
                    if len(hashes) * THRESHOLD > ENOUGH:
                        for number in range(1 - (-(len(hashes) - PART) // PART_STRIDE)):
                            begin = min(number * PART_STRIDE, len(hashes) - PART)
                            items.append(item)
                            numbers.append(-1 - number)
                            words.append(hashes[begin : begin + PART].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int64()), pa.array(numbers, pa.int64()), pa.array(words, pa.list_(pa.int64()))],
                names=["item_id", "number", "words"],
            )

    rows = benchmark.select(F.col("item_id").cast("long"), "text")
    return rows.mapInArrow(run, "item_id long, number long, words array<long>")


def _frequencies(texts: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """In how many rows of ``texts`` each wanted n-gram occurs; at most one result row per wanted n-gram."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.value
        present = np.zeros(1 << _FILTER_BITS, bool)
        present[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        counts = np.zeros(len(hashes), np.int64)
        for batch in batches:
            for text in strings(batch["text"]):
                grams = gram_hashes(word_hashes(text))
                grams = grams[present[grams >> np.uint64(64 - _FILTER_BITS)]]
                at = np.searchsorted(hashes, grams)
                at = at[hashes[np.minimum(at, len(hashes) - 1)] == grams] if len(grams) else at
                counts[np.unique(at)] += 1
        seen = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["at", "n"]
        )

    rows = texts.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return {row.at: row.n for row in rows.collect()}


def shards(docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> Iterator[Seeds]:
    """Passages with their seeds, about ``shard_words`` words at a time; an item's passages and parts stay together."""
    cut = passages(benchmark)
    total = cut.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    count = max(1, -(-total // shard_words))
    rows_read = docs.count() if total else 0
    part = F.pmod(F.xxhash64("item_id"), F.lit(count))
    for shard in range(count if total else 0):
        rows = cut.where(part == shard).orderBy("item_id", "number").collect()
        held = [(row.item_id, row.number, np.array(row.words, np.int64).view(np.uint64)) for row in rows]
        grams = [np.unique(gram_hashes(words)) for _, _, words in held]
        wanted = np.unique(np.concatenate([*grams, np.empty(0, np.uint64)]))
        known = _frequencies(docs, wanted)
        often = [np.array([known.get(int(at), 0) for at in np.searchsorted(wanted, own)]) for own in grams]
        weights = [np.log1p(rows_read / (seen + 0.5)) for seen in often]
        yield Seeds(held, grams, weights)


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word for each item found in each document, by its best passage."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, score double, first_word long, last_word long"
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    result = spark.createDataFrame([], schema)

    def finder(shared):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [
                    {"doc_id": doc_id, "item_id": item, "score": score, "first_word": first, "last_word": last}
                    for doc_id, text in zip(batch["doc_id"].to_pylist(), strings(batch["text"]), strict=True)
                    for item, (score, first, last) in shared.value.matches(text, threshold).items()
                ]
                fields = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())]
                yield pa.RecordBatch.from_pylist(
                    found, pa.schema([*fields, ("first_word", pa.int64()), ("last_word", pa.int64())])
                )

        return run

    for count, seeds in enumerate(shards(rows, benchmark)):
        part = rows.mapInArrow(finder(spark.sparkContext.broadcast(seeds)), schema)
        result = part if not count else result.unionByName(part)
    return result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` in which no item is found, all columns as they came."""

    def cleaner(shared):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not shared.value.matches(text, threshold) for text in strings(batch["text"])]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    result = docs
    for seeds in shards(docs, benchmark):
        result = result.mapInArrow(cleaner(docs.sparkSession.sparkContext.broadcast(seeds)), docs.schema)
    return result
