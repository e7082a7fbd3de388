"""Document quality by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics. Per class, count, sum and
sum of outer products are added up over all labelled training rows, one row per
task, so fitting needs no sample and no driver-side table. The covariance of a
class is shrunk towards the pooled one and towards a multiple of the identity;
its Cholesky factor is computed once and kept in the model. A score is the
posterior of label 1 from the difference of the two Gaussian log densities.

Null texts count as empty; texts without words share one vector, all zero, and so
one score. Repeated rows are scored each, and train as often as they are stored. A
very long text is read whole, compressed in blocks. An empty table gives no rows;
labels of fewer than two classes give 0.5 for every row. Extra columns are ignored
by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.common import fold, strings

#: Names of the statistics, in the order of the vectors.
STATISTICS = (
    "log_bytes", "mean_word", "word_spread", "distinct_words", "top_word", "upper", "digits", "sentence_marks",
    "symbols", "high_bytes", "line_breaks", "packed", "words_per_mark", "entropy", "symbol_words", "capital_words",
)
_LINES = re.compile(rb"\n")
_SYMBOL_CODES = np.frombuffer(b"!\"#$%&*+/:;<=>?@[\\]^_`{|}~", np.uint8)
_PACK_BYTES = 1 << 20


def _logit(share: float) -> float:
    """Log odds of a share, bounded away from 0 and 1."""
    return float(np.log((share + 1e-3) / (1 - share + 1e-3)))


def _packed_share(raw: bytes) -> float:
    """Compressed over plain length, in blocks so that long texts need no second copy."""
    packer, size = zlib.compressobj(1), 0
    for begin in range(0, len(raw), _PACK_BYTES):
        size += len(packer.compress(raw[begin : begin + _PACK_BYTES]))
    return (size + len(packer.flush())) / len(raw)


def statistics(text: str) -> np.ndarray:
    """The vector of one text; the empty text has a vector of its own (all zero)."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return np.zeros(len(STATISTICS))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, lower = len(raw), raw.lower().split()
    frequency: dict[bytes, int] = {}
    for word in lower:
        frequency[word] = frequency.get(word, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    upper, small = int(counts[65:91].sum()), int(counts[97:123].sum())
    marks = int(counts[46] + counts[44])
    symbols = int(counts[_SYMBOL_CODES].sum())
    spread = np.fromiter(frequency.values(), float) / len(words)
    symbol_ends = sum(word[-1] in b"!#$%&*|~^@=+" for word in words)
    capitals = sum(word[:1].isupper() and word[1:2].isupper() for word in words)
    return np.array(
        [
            np.log1p(size),
            np.log(lengths.mean()),
            np.log1p(lengths.std()),
            _logit(len(frequency) / len(words)),
            _logit(spread.max()),
            _logit(upper / max(1, upper + small)),
            _logit(int(counts[48:58].sum()) / size),
            _logit(marks / len(words) / 2),
            _logit(symbols / size),
            _logit(int(counts[128:].sum()) / size),
            _logit(int(counts[10]) / size),
            np.log(_packed_share(raw)),
            np.log1p(len(words) / (marks + 1)),
            float(-(spread * np.log(spread)).sum()) / np.log(len(words) + 1),
            _logit(symbol_ends / len(words)),
            _logit(capitals / len(words)),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """Centre and scale of the statistics; per class a mean, a Cholesky factor, its log determinant and a log prior."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    log_dets: tuple[float, ...]
    log_priors: tuple[float, ...]

    def posterior(self, vectors: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        if len(self.means) < 2:
            return np.full(len(vectors), 0.5)
        standard = (vectors - self.centre) / self.scale
        logs = []
        for mean, factor, log_det, prior in zip(
            self.means, self.factors, self.log_dets, self.log_priors, strict=True
        ):
            white = np.linalg.solve(factor, (standard - mean).T)
            logs.append(prior - 0.5 * (white * white).sum(axis=0) - 0.5 * log_det)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def with_statistics(docs: DataFrame, skip_held_out: bool = False) -> DataFrame:
    """doc_id, its fold and the statistics of each whole text; on request without the held-out fold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [statistics(text) for text in strings(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["fold"], pa.array(vectors, pa.list_(pa.float64()))],
                names=["doc_id", "fold", "statistics"],
            )

    chosen = docs.select(F.col("doc_id").cast("long"), fold(F.col("doc_id")).cast("int").alias("fold"), "text")
    if skip_held_out:
        chosen = chosen.where("fold <> 0")
    return chosen.mapInArrow(run, "doc_id long, fold int, statistics array<double>")


def _moments(labelled: DataFrame) -> list:
    """Count, sum and outer-product sum per class, one row per task and class."""
    size = len(STATISTICS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0, np.zeros(size), np.zeros((size, size))] for _ in range(2)]
        for batch in batches:
            vectors = np.array(batch["statistics"].to_pylist(), float).reshape(-1, size)
            label = np.array(batch["label"].to_pylist(), int)
            for kind, total in enumerate(totals):
                chosen = vectors[label == kind]
                total[0] += len(chosen)
                total[1] += chosen.sum(axis=0)
                total[2] += chosen.T @ chosen
        kinds = [kind for kind in range(2) if totals[kind][0]]
        if kinds:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kinds, pa.int32()),
                    pa.array([totals[kind][0] for kind in kinds], pa.int64()),
                    pa.array([totals[kind][1].tolist() for kind in kinds], pa.list_(pa.float64())),
                    pa.array([totals[kind][2].ravel().tolist() for kind in kinds], pa.list_(pa.float64())),
                ],
                names=["label", "n", "total", "outer"],
            )

    parts = labelled.mapInArrow(run, "label int, n long, total array<double>, outer array<double>")
    cells = [("total", size), ("outer", size * size)]
    sums = [F.array(*[F.sum(F.col(name)[i]) for i in range(width)]).alias(name) for name, width in cells]
    return parts.groupBy("label").agg(F.sum("n").alias("n"), *sums).orderBy("label").collect()


def fit(rows: DataFrame, labels: DataFrame, column: str, pooled: float = 0.2, ridge: float = 0.02) -> Discriminant:
    """Fit on the statistics of labelled rows outside the held-out fold (fold 0).

    A document labelled more than once counts with its smallest label; null
    labels are ignored. With fewer than two classes every score is 0.5.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    training = rows.where("fold <> 0").join(known, "doc_id").select("label", "statistics")
    moments = _moments(training)
    size = len(STATISTICS)
    if len(moments) < 2:
        return Discriminant(np.zeros(size), np.ones(size), (), (), (), ())
    count = sum(row.n for row in moments)
    centre = sum(np.array(row.total) for row in moments) / count
    spread = sum(np.array(row.outer).reshape(size, size) for row in moments) / count - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-6))
    means, scatters = [], []
    for row in moments:
        mean = np.array(row.total) / row.n
        scatter = np.array(row.outer).reshape(size, size) / row.n - np.outer(mean, mean)
        means.append((mean - centre) / scale)
        scatters.append(scatter / np.outer(scale, scale))
    within = sum(row.n * scatter for row, scatter in zip(moments, scatters, strict=True)) / count
    factors, log_dets = [], []
    for scatter in scatters:
        shrunk = (1 - pooled) * scatter + pooled * within
        shrunk = (1 - ridge) * shrunk + ridge * np.trace(shrunk) / size * np.eye(size) + 1e-6 * np.eye(size)
        factor = np.linalg.cholesky(shrunk)
        factors.append(factor)
        log_dets.append(float(2 * np.log(np.diag(factor)).sum()))
    priors = tuple(float(np.log(row.n / count)) for row in moments)
    return Discriminant(centre, scale, tuple(means), tuple(factors), tuple(log_dets), priors)


def score(rows: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (posterior of label 1) and predicted for rows of ``with_statistics``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.array(batch["statistics"].to_pylist(), float).reshape(-1, len(STATISTICS))
            values = model.posterior(vectors)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([value == 0 for value in batch["fold"].to_pylist()], pa.bool_()),
                    pa.array(values, pa.float64()),
                    pa.array((values >= threshold).astype(np.int32), pa.int32()),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose score reaches the threshold, all columns as they came."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch["text"])
            if texts:
                vectors = np.stack([statistics(text) for text in texts])
                yield batch.filter(pa.array(model.posterior(vectors) >= threshold))

    return docs.mapInArrow(run, docs.schema)
