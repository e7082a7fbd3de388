"""Language model scores from a log-frequency Bloom filter.

Counts of words and word pairs of the training rows are quantised to the power
of two below them; the filter holds an n-gram once for each level up to its own.
A probe asks level after level until one is missing, so a count can come out
too high, by the filter's error rate, but never too low. Pair and word counts
from such probes give interpolated (Dirichlet smoothed) probabilities.

The filter is made of blocks, one n-gram lying in one block. Its size follows
the training tokens, and what is broadcast at once is bounded by ``SHARD_BYTES``:
a larger filter is broadcast shard after shard, each pass noting the levels that
its shard knows, and scores are computed from the union of the notes.

The base score uses exact counts: those of frequent words travel as a table of
bounded size, the rest are joined. Words are told apart by 64-bit hashes. Null
texts count as empty: a single end token. Repeated rows train and are scored each.
Very long texts are hashed in pieces. An empty table gives no rows; without
training rows every count is 0. Extra columns are ignored. Two words of over a
thousand bytes made for the purpose can share a hash, which is a polynomial.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.common import fold, strings
from oddsloom.session import materialize

#: Bytes of a filter block; bits per training token; probes per level; filter bytes in one broadcast.
BLOCK_BYTES, BITS_PER_TOKEN, SHARD_BYTES = 1 << 18, 6, 160 << 20
#: Words whose exact counts are broadcast, at most.
HEAD = 1 << 19
#: Weight of the word model in a pair's probability, in counts.
SMOOTHING = 4.0
HELD_OUT_FOLD = 1

_PRIME, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
END = np.uint64(0xD6E8FEB86659FD93)
#: A word per byte in lower case, 0 for white space.
_CODES = (np.arange(1, 257, dtype=np.uint64)) * _SPREAD
_CODES ^= _CODES >> np.uint64(29)
_CODES[65:91] = _CODES[97:123]
_CODES[[9, 10, 11, 12, 13, 32]] = 0
_SPACE = re.compile(rb"[\x09-\x0D\x20]")
#: Bytes of text that are hashed at once, n-grams that are counted at once, and rows whose texts are Python strings at once.
_PIECE, _COUNTED, _ROWS = 1 << 18, 1 << 20, 256


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _SPREAD
    return values ^ (values >> np.uint64(29))


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse."""
    inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
    return tuple(
        np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, base)))) for base in (_PRIME, inverse)
    )


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word; a polynomial over its bytes, read off a running sum over all bytes."""
    codes = np.frombuffer(raw, np.uint8)
    forward, back = _powers(max(2 * _PIECE, 1 << len(raw).bit_length()))
    inside = _CODES[codes] != 0
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[codes] * forward[: len(raw)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * back[starts]), starts


def _pieces(raws: list[bytes]) -> Iterator[bytes]:
    """The texts, a space after each, in pieces of about _PIECE bytes that end between words."""
    held, size = [], 0
    for raw in raws:
        begin = 0
        while len(raw) - begin > _PIECE:
            cut = _SPACE.search(raw, begin + _PIECE)
            end = cut.end() if cut else len(raw)
            yield b"".join([*held, raw[begin:end]])
            held, size, begin = [], 0, end
        held += [raw[begin:], b" "]
        size += len(raw) - begin + 1
        if size >= _PIECE:
            yield b"".join(held)
            held, size = [], 0
    yield b"".join(held)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of several texts, each text closed by END, and the number of tokens of each."""
    raws = [text.encode("utf-8", "replace") for text in texts]
    hashes, starts, at = [], [], 0
    for piece in _pieces(raws):
        own, begins = _word_hashes(piece)
        hashes.append(own)
        starts.append(begins + at)
        at += len(piece)
    words, begins = np.concatenate(hashes), np.concatenate(starts)
    text_ends = np.cumsum([len(raw) + 1 for raw in raws])
    counts = np.diff(np.searchsorted(begins, text_ends), prepend=0) + 1
    result = np.full(int(counts.sum()), END)
    result[np.arange(len(words)) + np.searchsorted(text_ends, begins, "right")] = words
    return result, counts


def _bundles(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive rows of about _PIECE characters together, and their texts."""
    for first in range(0, batch.num_rows, _ROWS):
        rows = batch.slice(first, _ROWS)
        texts = strings(rows["text"])
        begin = size = 0
        for place, text in enumerate(texts):
            size += len(text)
            if size >= _PIECE or place == len(texts) - 1:
                yield rows.slice(begin, place + 1 - begin), texts[begin : place + 1]
                begin, size = place + 1, 0


def pairs(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the first one of a text follows END."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(counts) - counts] = END
    return _mixed(before * _PAIR + words)


def _places(grams: np.ndarray, blocks: int) -> np.ndarray:
    half = np.uint64(32)
    return ((_mixed(grams ^ _PAIR) >> half) * np.uint64(blocks)) >> half


def _first(grams: np.ndarray, level: int) -> np.ndarray:
    return _mixed(grams + np.uint64(level) * _SPREAD)


def _bit(first: np.ndarray, probe: int, block_bytes: int) -> np.ndarray:
    """Number of one of the three bits of a level within the block, whose size is a power of two."""
    mixed = first >> np.uint64(32) if probe == 1 else _mixed(first ^ _PAIR) if probe == 2 else first
    return (mixed & np.uint64(block_bytes * 8 - 1)).astype(np.int64)


def levels(shard: np.ndarray, first: int, grams: np.ndarray, blocks: int, block_bytes: int) -> np.ndarray:
    """Quantised count level of each n-gram, 0 where absent or in another shard; ``shard`` begins at block ``first``."""
    held = len(shard) // block_bytes
    place = _places(grams, blocks).astype(np.int64) - first
    result = np.zeros(len(grams), np.uint8)
    active = np.nonzero((place >= 0) & (place < held))[0]
    asked, offset, level = grams[active], place[active] * block_bytes, 1
    while len(active):
        mixed = _first(asked, level)
        for probe in range(3):
            at = _bit(mixed, probe, block_bytes)
            hit = (shard[offset + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0
            active, asked, offset, mixed = active[hit], asked[hit], offset[hit], mixed[hit]
        result[active] = level
        level += 1
    return result


def _amount(level: np.ndarray) -> np.ndarray:
    """Count that a level stands for: 1, then the middle of its range."""
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, 1.5 * 2.0 ** (level.astype(float) - 1)))


def _counted(rows: DataFrame, blocks: int = 0) -> DataFrame:
    """Hashes of the texts' words with their counts or, given the number of blocks, of their pairs with blocks and counts."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        columns = [pa.array(grams.view(np.int64)), pa.array(n)]
        if not blocks:
            return pa.RecordBatch.from_arrays(columns, names=["gram", "n"])
        return pa.RecordBatch.from_arrays([pa.array(_places(grams, blocks).astype(np.int64)), *columns], names=["block", "gram", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, texts in _bundles(batch):
                words, counts = tokens(texts)
                held.append(pairs(words, counts) if blocks else words)
                size += len(words)
                if size >= _COUNTED:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return rows.select("text").mapInArrow(run, "block long, gram long, n long" if blocks else "gram long, n long")


def _with_blocks(grams: DataFrame, blocks: int) -> DataFrame:
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch["gram"].to_numpy().view(np.uint64), blocks).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch["gram"], batch["n"]], names=["block", "gram", "n"])

    return grams.mapInArrow(place, "block long, gram long, n long")


def build_filter(grams: DataFrame, blocks: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block and its bytes, from rows of (block, gram, n) in which a gram may occur several times."""

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(batch["gram"].to_numpy(), batch["n"].to_numpy()) for batch in batches]
        if not parts:
            return
        gathered = np.concatenate([gram for gram, _ in parts]).view(np.uint64)
        order = np.argsort(gathered)
        gathered, counts = gathered[order], np.concatenate([n for _, n in parts])[order]
        starts = np.nonzero(np.diff(gathered, prepend=gathered[:1] + np.uint64(1)))[0]
        gathered, counts = gathered[starts], np.add.reduceat(counts, starts)
        place = _places(gathered, blocks).astype(np.int64)
        top = np.floor(np.log2(counts)).astype(int) + 1
        for block in np.unique(place):
            mine = place == block
            own, own_top, bits = gathered[mine], top[mine], np.zeros(block_bytes * 8, bool)
            for level in range(1, int(own_top.max()) + 1):
                mixed = _first(own[own_top >= level], level)
                for probe in range(3):
                    bits[_bit(mixed, probe, block_bytes)] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block)], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()])],
                names=["block", "bits"],
            )

    return grams.repartition("block").select("block", "gram", "n").mapInArrow(fill, "block long, bits binary")


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The frequent words and their counts, at most ``most``, and the least count among them."""
    level = F.floor(F.log2("n")).cast("int").alias("level")
    sizes = sorted(((row.level, row.m) for row in counts.groupBy(level).agg(F.count("*").alias("m")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for bottom, size in sizes:
        total += size
        if total > most:
            break
        least = 1 << bottom
    table = counts.where(F.col("n") >= least).select("gram", "n").toArrow()
    grams = table["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return grams[order], table["n"].to_numpy()[order], least


def score(
    docs: DataFrame, head_words: int = HEAD, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each whole text."""
    spark = docs.sparkSession
    held_out = (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long"), held_out, F.coalesce("text", F.lit("")).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = materialize(_counted(training).groupBy("gram").agg(F.sum("n").alias("n")), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-total * BITS_PER_TOKEN // (block_bytes * 8)))
    counted = _counted(training, blocks).unionByName(_with_blocks(counts, blocks))
    made = materialize(build_filter(counted, blocks, block_bytes), "filter")
    grams, amounts, least = _head(counts, head_words)
    head = spark.sparkContext.broadcast((grams, amounts))
    floor = total + 0.5 * (distinct + 1)
    per_shard = max(1, shard_bytes // block_bytes)

    def shard(number: int) -> np.ndarray:
        """Blocks of one shard; blocks without n-grams have no row."""
        own = F.col("block").between(number * per_shard, (number + 1) * per_shard - 1)
        size = min(per_shard, blocks - number * per_shard)
        table = np.zeros(size * block_bytes, np.uint8)
        for row in made.where(own).toLocalIterator():
            at = (row.block - number * per_shard) * block_bytes
            table[at : at + block_bytes] = np.frombuffer(row.bits, np.uint8)
        return table

    def model(word: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
        seen, context = _amount(word), _amount(before)
        joint = np.minimum(_amount(pair), context)
        return np.log10((joint + SMOOTHING * (seen + 0.5) / floor) / (context + SMOOTHING))

    def levels_of(words: np.ndarray, counts: np.ndarray, table: np.ndarray, first: int) -> np.ndarray:
        """Levels of words and of pairs, one after the other."""
        own, place = np.unique(words, return_inverse=True)
        word = levels(table, first, own, blocks, block_bytes)[place]
        return np.concatenate((word, levels(table, first, pairs(words, counts), blocks, block_bytes)))

    def before_of(word: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[np.cumsum(counts) - counts] = end
        return before

    def totals(words: np.ndarray, counts: np.ndarray, noted: np.ndarray) -> np.ndarray:
        """The model's score of each text; every text ends with END, whose level is that of the last token."""
        word, pair = noted[: len(words)], noted[len(words) :]
        logs = model(word, before_of(word, counts, int(word[-1])), pair)
        return np.add.reduceat(logs, np.cumsum(counts) - counts)

    def base(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Sum and number of known tokens over the head, and the rest per text."""
        known, amount = head.value
        own, place = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        own_hit = known[at] == own if len(known) else np.zeros(len(own), bool)
        own_logs = np.zeros(len(own))
        own_logs[own_hit] = np.log10((amount[at[own_hit]] + 0.5) / floor)
        hit, logs = own_hit[place], own_logs[place]
        starts = np.cumsum(counts) - counts
        rest = np.split(np.where(hit, np.uint64(0), words), starts[1:])
        missing = [part[~own] for part, own in zip(rest, np.split(hit, starts[1:]), strict=True)]
        return np.add.reduceat(logs, starts), np.add.reduceat(hit.astype(np.int64), starts), missing

    fields = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, rest array<long>"
    shards = -(-blocks // per_shard)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    if shards > 1:
        # Every pass has to meet the same numbers, wherever the rows come from.
        numbered = materialize(numbered, "numbered")

    def first_pass(table) -> object:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some, texts in _bundles(batch):
                    words, counts = tokens(texts)
                    sums, known, rest = base(words, counts)
                    columns = [
                        some["row"], some["doc_id"], some["held_out"], pa.array(counts.astype(np.int64)),
                        pa.array(known), pa.array(sums),
                        pa.array([part.view(np.int64) for part in rest], pa.list_(pa.int64())),
                    ]
                    noted = levels_of(words, counts, table.value, 0)
                    if shards == 1:
                        columns.append(pa.array(totals(words, counts, noted)))
                    else:
                        columns.append(pa.array(_notes(noted, counts), pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        return run

    last = "score" if shards == 1 else "notes"
    names = [field.split()[0] for field in fields.split(", ")] + [last]
    schema = f"{fields}, {last} {'double' if shards == 1 else 'binary'}"
    table = spark.sparkContext.broadcast(shard(0))
    scored = materialize(numbered.mapInArrow(first_pass(table), schema), "scored")
    if shards > 1:
        scored = _more_shards(scored, numbered, shards, shard, per_shard, levels_of, model)
    rest = scored.select("row", F.explode("rest").alias("gram")).groupBy("row", "gram").agg(F.count("*").alias("tf"))
    unseen = counts.where(F.col("n") < least)
    logs = F.col("tf") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / floor)
    joined = rest.join(unseen, "gram", "left").groupBy("row").agg(
        F.sum(logs).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf"))).alias("more_known")
    )
    zero = F.lit(0)
    return scored.drop("rest").join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", zero)).alias("base_score"),
        "score",
    )


def _notes(noted: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Levels of each text's words and pairs, packed."""
    cuts = np.cumsum(counts)[:-1]
    size = len(noted) // 2
    halves = zip(np.split(noted[:size], cuts), np.split(noted[size:], cuts), strict=True)
    return [zlib.compress(np.concatenate(pair).tobytes(), 1) for pair in halves]


def _more_shards(
    scored: DataFrame, numbered: DataFrame, shards: int, shard: Callable[[int], np.ndarray], per_shard: int,
    levels_of: Callable[..., np.ndarray], model: Callable[..., np.ndarray],
) -> DataFrame:
    """Add the notes of the other shards and compute scores from all notes of a row."""
    spark, every = scored.sparkSession, scored.select("row", "notes")

    def noting(table, first):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some, texts in _bundles(batch):
                    words, counts = tokens(texts)
                    notes = pa.array(_notes(levels_of(words, counts, table.value, first), counts), pa.binary())
                    yield pa.RecordBatch.from_arrays([some["row"], notes], names=["row", "notes"])

        return run

    for number in range(1, shards):
        table = spark.sparkContext.broadcast(shard(number))
        part = numbered.mapInArrow(noting(table, number * per_shard), "row long, notes binary")
        every = every.unionByName(materialize(part, "notes"))
        table.unpersist()

    def merge(group: pa.Table) -> pa.Table:
        best = None
        for notes in group["notes"].to_pylist():
            levels_ = np.frombuffer(zlib.decompress(notes), np.uint8)
            best = levels_ if best is None else np.maximum(best, levels_)
        size = len(best) // 2
        word = best[:size]
        before = np.concatenate((word[-1:], word[:-1]))
        return pa.table({"row": group["row"][:1], "score": [float(model(word, before, best[size:]).sum())]})

    return scored.drop("notes").join(every.groupBy("row").applyInArrow(merge, "row long, score double"), "row")
