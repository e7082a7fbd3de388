"""Toxicity by compression distance.

Two separate zstandard dictionaries are trained, one on windows of toxic texts and
one on windows of ordinary ones. A window's distance is the number of bytes that
the toxic dictionary saves against the ordinary one. A second distance tells
single words better: the bytes saved by putting a list of words that toxic texts
hold more often (raw content, not trained) before windows of ordinary texts. The
two distances of all windows of a whole text are summed up in a few statistics
each, which a logistic curve, fitted on labelled rows that no dictionary has
seen, turns into a score. The README has the figures of each distance alone.

Labels are only read outside the held-out fold (fold 0). Fitting uses a bounded
sample of labelled rows; scoring reads every byte of every text.

Null and empty texts have one window, a space. Repeated rows are scored each and
train once. Very long texts are cut into windows in lists of bounded length. An
empty table gives no rows; without labels of both classes the score is their
share, 0 without any. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.common import fold, strings
from oddsloom.session import materialize

#: Labelled rows of each class that a fit reads at most, half for dictionaries and half for the curve.
SAMPLE = 6000
#: Bytes of a window and of the step to the next; a word of up to WINDOW - STEP bytes is whole in some window.
WINDOW, STEP = 64, 40
ORDINARY_BYTES, TOXIC_WORDS = 40_000, 4000
#: Size of a trained dictionary, and windows of each class that it is trained on at most.
BOOK_BYTES, BOOK_WINDOWS = 16_000, 40_000
#: Candidates for the least evidence, as the lower bound of a log ratio, that a word is toxic.
EVIDENCE = (1.5, 2.0, 2.5, 3.0)
_EDGE = b".,!?;:\"'()[]|#$%&*"
_BUNDLE = 20_000


def windows(raw: bytes) -> Iterator[list[bytes]]:
    """Windows of a text in lists of bounded length; an empty text has one window."""
    last = max(1, len(raw) - WINDOW + STEP)
    for begin in range(0, last, STEP * _BUNDLE):
        yield [raw[at : at + WINDOW] or b" " for at in range(begin, min(last, begin + STEP * _BUNDLE), STEP)]


class Distances:
    """Compressors over the two trained dictionaries, and over ordinary windows with each of several word lists before."""

    def __init__(self, trained: tuple[bytes, bytes], ordinary: bytes, words: list[bytes]) -> None:
        parameters = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=32,
            strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )

        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            book = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_AUTO)
            book.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=book, compression_params=parameters)

        plain = compressor(ordinary)
        self.pairs = [(compressor(trained[0]), compressor(trained[1]))]
        self.pairs += [(plain, compressor(book + ordinary)) for book in words]

    @staticmethod
    def _lengths(compressor: zstandard.ZstdCompressor, bundle: list[bytes]) -> np.ndarray:
        packed = compressor.multi_compress_to_buffer(bundle)
        return np.fromiter((len(packed[i]) for i in range(len(packed))), np.int64, len(bundle))

    def statistics(self, texts: list[str]) -> np.ndarray:
        """Per text and pair of dictionaries, the trained ones first: what a logistic curve reads."""
        raws = [text.encode("utf-8", "replace").lower() for text in texts]
        sums = np.zeros((len(raws), len(self.pairs), 4))
        best = np.zeros((len(raws), len(self.pairs), 3))
        bundle: list[bytes] = []
        owners: list[int] = []

        def flush() -> None:
            owner = np.array(owners)
            places, starts = np.unique(owner, return_index=True)
            lengths = {first: self._lengths(first, bundle) for first in dict.fromkeys(first for first, _ in self.pairs)}
            for kind, (first, other) in enumerate(self.pairs):
                saved = (lengths[first] - self._lengths(other, bundle)).astype(float)
                columns = (np.ones(len(saved)), saved, saved >= 3, np.where(saved > 2, saved, 0))
                for column, values in enumerate(columns):
                    sums[places, kind, column] += np.add.reduceat(np.asarray(values, float), starts)
                for place, begin, end in zip(places, starts, [*starts[1:], len(saved)], strict=True):
                    top = np.concatenate((best[place, kind], saved[begin:end]))
                    best[place, kind] = np.sort(np.partition(top, len(top) - 3)[-3:])[::-1]
            bundle.clear()
            owners.clear()

        for place, raw in enumerate(raws):
            for part in windows(raw):
                bundle.extend(part)
                owners.extend([place] * len(part))
                if len(bundle) >= _BUNDLE:
                    flush()
        if bundle:
            flush()
        count = sums[:, :, 0]
        return np.stack(
            [
                sums[:, :, 1] / count, np.log1p(np.maximum(best[:, :, 0], 0)),
                np.log1p(np.maximum(best.sum(axis=2), 0)), sums[:, :, 2] / np.sqrt(count),
                sums[:, :, 3] / np.sqrt(count), np.log(count),
            ],
            axis=2,
        )


@dataclass(frozen=True)
class Model:
    """Dictionaries and a logistic curve; without weights every score is ``constant``."""

    trained: tuple[bytes, bytes]
    ordinary: bytes
    words: bytes
    weights: np.ndarray | None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    constant: float = 0.0

    def scores(self, distances: Distances, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        values = distances.statistics(texts).reshape(len(texts), -1)
        return _curve(_design(values, self.centre, self.scale), self.weights)


def _design(values: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(values)), (values - centre) / scale))


def _curve(design: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(design @ weights, -700, 700)))


def _fit_curve(values: np.ndarray, label: np.ndarray, penalty: float = 1.0) -> tuple:
    """Penalised logistic regression by Newton steps; also its log loss."""
    centre, scale = values.mean(axis=0), np.maximum(values.std(axis=0), 1e-6)
    design, weights = _design(values, centre, scale), np.zeros(values.shape[1] + 1)
    ridge = penalty * np.diag([0.0, *np.ones(values.shape[1])])
    for _ in range(50):
        p = _curve(design, weights)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge + 1e-9 * np.eye(len(weights))
        step = np.linalg.solve(hessian, design.T @ (p - label) + ridge @ weights)
        weights = weights - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(_curve(design, weights), 1e-9, 1 - 1e-9)
    return weights, centre, scale, float(-(label * np.log(p) + (1 - label) * np.log(1 - p)).sum())


def _sample(docs: DataFrame, labels: DataFrame, column: str, size: int) -> DataFrame:
    """label, part (0 or 1) and text of at most about ``size`` labelled training rows of each class, by a hash of the id.

    A document labelled more than once counts with its largest label, one that
    is stored more than once counts once.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    totals = {row.label: row.n for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / (1 << 20)
    wanted = F.lit(False)
    for label, total in totals.items():
        wanted = wanted | ((F.col("label") == label) & (share < size / total))
    part = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(2)).cast("int").alias("part")
    chosen = known.where(wanted).select("doc_id", "label", part)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "part").agg(F.min("text").alias("text"))


def _words(rows: DataFrame) -> list[tuple[bytes, float, int]]:
    """Words that toxic texts hold more often than ordinary ones: word, evidence, toxic texts; bounded in number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                found = {word.strip(_EDGE) for word in text.encode("utf-8", "replace").lower().split()}
                held = [word for word in found if 3 <= len(word) <= WINDOW - STEP]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held, pa.binary()), pa.array([label] * len(held), pa.int32())], names=["word", "label"]
                )

    totals = {row.label: row.n for row in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    a, b = F.sum("label"), F.sum(1 - F.col("label"))
    counted = rows.mapInArrow(run, "word binary, label int").groupBy("word").agg(a.alias("a"), b.alias("b"))
    ratio = F.log((F.col("a") + 0.5) / (totals.get(1, 0) + 1)) - F.log((F.col("b") + 0.5) / (totals.get(0, 0) + 1))
    evidence = ratio - 1.5 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = (
        counted.where("a >= 3").withColumn("evidence", evidence).where(F.col("evidence") >= min(EVIDENCE))
        .orderBy(F.desc("evidence"), "word").limit(TOXIC_WORDS)
    )
    return [(bytes(row.word), row.evidence, row.a) for row in best.collect()]


def _ordinary(rows: DataFrame) -> bytes:
    """Windows from all over ordinary texts, up to the dictionary's size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn, order = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace").lower()
                rng = np.random.default_rng(doc_id & 0xFFFFFFFF)
                for at in rng.integers(0, max(1, len(raw) - WINDOW), 2):
                    drawn.append(raw[at : at + WINDOW])
                    order.append(float(rng.random()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(drawn, pa.binary()), pa.array(order, pa.float64())], names=["drawn", "place"]
            )

    drawn = rows.where("label = 0").mapInArrow(run, "drawn binary, place double")
    kept = drawn.orderBy("place", "drawn").limit(ORDINARY_BYTES // WINDOW).collect()
    return b" ".join(bytes(row.drawn) for row in kept)


def _trained(rows: DataFrame, label: int) -> bytes:
    """A dictionary trained on windows from all over the texts of a class; where they are too few, the windows themselves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace").lower()
                rng = np.random.default_rng([doc_id & 0xFFFFFFFF, 1])
                for at in range(0, len(raw), WINDOW * _BUNDLE):
                    part = raw[at : at + WINDOW * _BUNDLE]
                    drawn = [part[begin : begin + WINDOW] for begin in range(0, len(part), WINDOW)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(drawn, pa.binary()), pa.array(rng.random(len(drawn)), pa.float64())],
                        names=["drawn", "place"],
                    )

    drawn = rows.where(F.col("label") == label).mapInArrow(run, "drawn binary, place double")
    kept = [bytes(row.drawn) for row in drawn.orderBy("place", "drawn").limit(BOOK_WINDOWS).collect()]
    try:
        return zstandard.train_dictionary(BOOK_BYTES, kept).as_bytes()
    except zstandard.ZstdError:
        return b"".join(kept)[:BOOK_BYTES]


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", size: int = SAMPLE) -> Model:
    """Train dictionaries and curve. Without labelled rows of both classes the score is constant."""
    rows = materialize(_sample(docs, labels, column, size), "labelled")
    first, second = rows.where("part = 0"), rows.where("part = 1")
    trained = (_trained(first, 0), _trained(first, 1))
    ordinary, words = _ordinary(first), _words(first)
    books = []
    for least in EVIDENCE:
        chosen = sorted((n, word) for word, evidence, n in words if evidence >= least)
        books.append(b"".join(b" " + word + b" " for _, word in chosen))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(trained, ordinary, books)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                values = distances.statistics(strings(some["text"])).reshape(some.num_rows, -1)
                yield pa.RecordBatch.from_arrays(
                    [some["label"], pa.array(values.tolist(), pa.list_(pa.float64()))], names=["label", "statistics"]
                )

    seen = second.select("label", "text").mapInArrow(run, "label int, statistics array<double>").collect()
    label = np.array([row.label for row in seen], float)
    if not all(trained) or len(set(label.tolist())) < 2:
        share = float(label.mean()) if len(label) else 0.0
        return Model(trained, ordinary, b"", None, constant=share)
    values = np.array([row.statistics for row in seen]).reshape(len(seen), 1 + len(books), -1)
    fitted = [_fit_curve(values[:, [0, kind]].reshape(len(seen), -1), label) for kind in range(1, 1 + len(books))]
    chosen = int(np.argmin([loss for *_, loss in fitted]))
    weights, centre, scale, _ = fitted[chosen]
    return Model(trained, ordinary, books[chosen], weights, centre, scale)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for each whole text; null texts count as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.trained, model.ordinary, [model.words])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                values = model.scores(distances, strings(some["text"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        some["doc_id"], pa.array([value == 0 for value in some["fold"].to_pylist()], pa.bool_()),
                        pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32), pa.int32()),
                    ],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), fold(F.col("doc_id")).cast("int").alias("fold"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
