"""Exact nearest neighbours by a block matrix join.

Vectors are packed into blocks, each with its int8 form: every vector has a
scale of its own, whole numbers of at most 127 and the exact norm of what
rounding lost. Each block of queries meets each block of candidates, block
ids being the join key, as one tile. Products of the int8 forms give every
inner product up to a bound that follows from the norms. Pairs whose upper bound
lies under the 20th best lower bound of their query are discarded; the inner
products of the rest are computed from the original vectors in double
precision, and each tile passes its best ones on to be merged.

Null vectors, zero vectors and those with a null or non-finite component take
no part, neither do rows without an id or of another length than most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of a candidate block and of a query block, and the tasks that share a query block at most.
BLOCK, QUERIES, STRIPES = 4096, 2048, 16
_EXACT, _PAIRS, _ROWS = 1 << 24, 1 << 16, 256


def _quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 form, scale, norm of the form and norm of the rest of each vector."""
    scale = np.maximum(np.abs(vectors).max(axis=1) / 127, np.finfo(float).tiny)
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    form = codes * scale[:, None]
    return codes, scale, np.linalg.norm(form, axis=1), np.linalg.norm(vectors - form, axis=1)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact products of int8 matrices; floats hold them as long as sums stay under 2 ** 24 (or 2 ** 53)."""
    kind = np.float32 if left.shape[1] * 127 * 127 < _EXACT else np.float64
    return (left.astype(kind) @ right.astype(kind).T).astype(np.float64)


def _inner(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in the order of the components."""
    total = np.zeros(len(left))
    for place in range(left.shape[1]):
        total += left[:, place] * right[:, place]
    return total


class Packed:
    """Vectors of a block with their ids and int8 form."""

    def __init__(self, ids: bytes, vectors: bytes) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(len(self.ids), -1)
        self.codes, self.scale, self.norm, self.rest = _quantised(self.vectors)


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, ties to smaller ids."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    return rows[first], ids[first], scores[first]


def tile(queries: Packed, candidates: Packed, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, candidate ids and scores of each query's k nearest in one tile."""
    found = []
    full_norm = candidates.norm + candidates.rest
    for begin in range(0, len(queries.ids), _ROWS):
        some = slice(begin, begin + _ROWS)
        product = _products(queries.codes[some], candidates.codes)
        product *= queries.scale[some, None] * candidates.scale[None, :]
        error = queries.rest[some, None] * full_norm + queries.norm[some, None] * candidates.rest
        error += 1e-9 * (error + full_norm * (queries.norm[some] + queries.rest[some])[:, None])
        own = queries.ids[some, None] == candidates.ids[None, :]
        lower = np.nan_to_num(np.where(own, -np.inf, product - error), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        kept = min(k, lower.shape[1])
        floor = -np.partition(-lower, kept - 1, axis=1)[:, kept - 1]
        rows, columns = np.nonzero(~(product + error < floor[:, None]) & ~own)
        rows += begin
        scores = [
            _inner(queries.vectors[rows[at : at + _PAIRS]], candidates.vectors[columns[at : at + _PAIRS]])
            for at in range(0, len(rows), _PAIRS)
        ]
        found.append(_best(rows, candidates.ids[columns], np.concatenate([*scores, np.empty(0)]), k))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _usable(vectors: DataFrame) -> DataFrame:
    """id and vector as doubles, of rows that take part."""
    doubles = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), doubles.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size("vector") == (common["size"] if common else 0))


def _pack(rows: DataFrame, name: str, blocks: int) -> DataFrame:
    """One row per block: its number, ids and vectors as bytes."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy().astype(np.int64)
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.lexsort((*flat.T[::-1], ids))
        return pa.table(
            {
                name: pa.array([table[name][0].as_py()], pa.int64()),
                f"{name}_ids": pa.array([ids[order].tobytes()], pa.binary()),
                f"{name}_vectors": pa.array([np.ascontiguousarray(flat[order]).tobytes()], pa.binary()),
            }
        )

    number = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).alias(name)
    schema = f"{name} long, {name}_ids binary, {name}_vectors binary"
    return rows.select(number, "vec_id", "vector").groupBy(name).applyInArrow(run, schema)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK, queries: int = QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest other rows by inner product, ties to smaller ids.

    ``is_query`` is a condition on ``vec_id``. Rows equal in id and vector are
    one. Other rows that share an id are candidates of their own; as queries
    they share one list, and none of them is in it.
    """
    rows = _usable(vectors).distinct()
    asked = rows.where(is_query)
    total, wanted = rows.count(), asked.count()
    candidate_blocks, query_blocks = max(1, -(-total // block)), max(1, -(-wanted // queries))
    candidates = _pack(rows, "block", candidate_blocks)
    every = F.sequence(F.lit(0).cast("long"), F.lit(candidate_blocks - 1).cast("long"))
    blocks = _pack(asked, "part", query_blocks).withColumn("block", F.explode(every))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Packed, tuple]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch["part"][row].as_py()
                asking, so_far = held.get(part) or (
                    Packed(batch["part_ids"][row].as_py(), batch["part_vectors"][row].as_py()), None
                )
                found = tile(asking, Packed(batch["block_ids"][row].as_py(), batch["block_vectors"][row].as_py()), k)
                if so_far is not None:
                    found = _best(*[np.concatenate(pair) for pair in zip(so_far, found, strict=True)], k)
                held[part] = (asking, found)
        for asking, (places, ids, scores) in held.values():
            yield pa.RecordBatch.from_arrays(
                [pa.array(asking.ids[places]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"]
            )

    # A task joins a stripe of the candidate blocks with a query block and passes on one list per query.
    stripe = F.pmod("block", F.lit(STRIPES))
    tiles = blocks.join(candidates, "block").repartition("part", stripe)
    columns = ("part", "part_ids", "part_vectors", "block_ids", "block_vectors")
    near = tiles.select(*columns).mapInArrow(run, "query_id long, vec_id long, score double")

    def merge(table: pa.Table) -> pa.Table:
        pairs = zip(table["score"].to_pylist(), table["vec_id"].to_pylist(), strict=True)
        top = heapq.nsmallest(k, ((-value, vec_id) for value, vec_id in pairs))
        return pa.table(
            {
                "query_id": pa.array([table["query_id"][0].as_py()] * len(top), pa.int64()),
                "rank": pa.array(range(1, len(top) + 1), pa.int32()),
                "vec_id": pa.array([vec_id for _, vec_id in top], pa.int64()),
                "score": pa.array([-value for value, _ in top], pa.float64()),
            }
        )

    return near.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
