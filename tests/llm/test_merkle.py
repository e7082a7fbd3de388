"""Merkle manifest against a direct computation."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from oddsloom.llm import merkle_butterfly

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, place string, root string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def of_row(row):
    texts = [None if v is None else str(v) for v in (row[0], row[3], row[2], row[4], row[1])]
    return H(*["-" if v is None else f"{len(v.encode())}:{v}" for v in texts])


def climbed(nodes):
    """Root and, for each node, the pairs (left, right) on its path."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i - i % 3
            steps[k].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], steps


def expected(rows):
    by_source = collections.defaultdict(list)
    for row in rows:
        by_source[row[3]].append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        own = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, of_row(r)))
        trees[source] = own, climbed([of_row(r) for r in own])
    root, upper = climbed([trees[s][1][0] for s in order])
    out = []
    for source, more in zip(order, upper):
        own, (subroot, steps) = trees[source]
        for row, below in zip(own, steps):
            path = below + more
            altered = row[1] is not None and zlib.crc32(str(row[0] if row[0] is not None else "").encode()) % 2 == 0
            cur = of_row((row[0], row[1].replace("\n", ""), *row[2:])) if altered else of_row(row)
            for left, right in path:
                cur = H(left, cur, right)
            out.append((row[0], of_row(row), subroot, root, H(*[l + r for l, r in path]), cur, cur == root))
    return sorted(out, key=repr)


def query(docs, levels):
    altered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    copy = F.when(altered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle_butterfly.digest(merkle_butterfly.verify(docs, copy, levels))
    return sorted(map(tuple, found.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", "y", "z", "w") for row in rows], SCHEMA).repartition(5)


def test_sizes_of_trees(spark):
    """Trees from one leaf to several ragged rounds, hashed in blocks of 1, 3 and 729 leaves."""
    sizes = [1, 2, 3, 4, 8, 9, 10, 27, 28, 29, 55, 64, 83]
    rows, at = [], 0
    for number, size in enumerate(sizes):
        for i in range(size):
            at += 1
            rows.append((at * 7919 % 100003, f"text {at}\nline" if i % 2 else f"text {at}", "en", f"src{number}", at))
    want = expected(rows)
    docs = frame(spark, rows)
    assert query(docs, 0) == want
    assert query(docs, 1) == want
    assert query(docs, 6) == want


def test_awkward_rows(spark):
    rows = [
        (1, None, None, None, None), (2, "", "", "", 0), (3, "\n\n", "de", "é", 2), (None, "no id\n", "en", "b", 6), (None, None, "en", "b", None),
        (4, "same\n", "en", "a", 5), (4, "same\n", "en", "a", 5), (4, "other\n", "en", "a", 6), (5, "x\n" * 70000, "en", None, -1), (-6, "minus\n", None, "ÿ", 7),
    ] + [(7, "copy\n", "en", "hot", 5)] * 40
    want = expected(rows)
    assert query(frame(spark, rows), 0) == want
    assert query(frame(spark, rows), 6) == want
    one = [(9, "alone", "en", "a", 5)]
    assert query(frame(spark, one), 6) == expected(one)
    assert query(frame(spark, []), 6) == []


def test_proofs_can_be_folded(spark):
    rows = [(i, f"{i}", "en", f"s{i % 4}", 1) for i in range(50)]
    leaves = merkle_butterfly.document_leaves(frame(spark, rows), F.col("text"))
    proven = merkle_butterfly.manifest(leaves, {"doc_id": "long", "leaf": "string"}, ["doc_id"], levels=1, lanes=2)
    for row in proven.collect():
        cur = row.leaf
        for left, right in row.steps:
            cur = H(left, cur, right)
        assert cur == row.root
    assert leaves.where("claimed is not null").count() == 0


@pytest.mark.parametrize("name", ["op13_merkle_butterfly"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from oddsloom.llm.catalog import LLM_ORACLES, LLM_QUERIES

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    frame = LLM_QUERIES[name](spark, folder)
    cursor = db.execute(LLM_ORACLES[name])
    assert [c[0] for c in cursor.description] == frame.columns
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(row)) for row in frame.collect())
