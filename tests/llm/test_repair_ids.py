"""Shards of token ids: round trips, and the query's rows against the tokenizers library."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from oddsloom.llm import repair_ids
from oddsloom.llm.common import tokenizer_path

LIBRARY = Tokenizer.from_file(tokenizer_path())


def check_payload(ids, least, gain):
    ids = np.array(ids, np.uint32)
    book = repair_ids.Grammar(repair_ids.compress(ids, least, gain))
    assert book.n_ids == len(ids)
    assert book.ids().tolist() == ids.tolist()
    for begin, end in ((0, 1), (len(ids) // 3, len(ids) // 2 + 1), (max(0, len(ids) - 2), len(ids) + 5), (3, 3), (0, len(ids))):
        assert book.range(begin, end).tolist() == ids[begin:end].tolist()
    for k, (left, right) in enumerate(zip(book.left.tolist(), book.right.tolist())):
        assert max(left, right) < book.first + k
        sizes = [1 if side < book.first else int(book.lengths[side - book.first]) for side in (left, right)]
        assert book.lengths[k] == sum(sizes)
    return book


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=200), st.integers(2, 4))
def test_any_ids_come_back(ids, least):
    check_payload(ids, least, 1000)


def test_long_and_odd_sequences():
    rng = np.random.default_rng(3)
    check_payload([], 2, 16)
    check_payload([7], 2, 16)
    check_payload([0] * 5001, 2, 1000)
    check_payload([1, 2] * 3000 + [2, 1] * 2000, 2, 1000)
    check_payload([70000, 4000000000, 70000, 4000000000] * 10, 2, 16)
    check_payload(rng.integers(0, 70000, 20000), 2, 16)
    passage = rng.integers(0, 50000, 64)
    book = check_payload(np.tile(passage, 200), 16, 16)
    assert len(book.symbols) <= 200 * 8


def rows_of(texts):
    want, start = [], 0
    for doc_id, text in texts:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return want


def test_documents(spark):
    texts = [(None, "no id"), (-3, "minus"), (1, None), (2, ""), (3, "!!! ids 0 0 0"), (4, "one two three " * 4000), (5, "same"), (5, "same"),
             (6, "<|endoftext|> é 日本語 😀"), (1 << 40, "x" * 3000)] + [(100 + i, f"words of {i % 3} rows") for i in range(40)]
    want = rows_of(sorted(texts, key=lambda row: (row[0] is not None, row[0] or 0)))
    schema = "doc_id long, text string, part string, number string, payload string, n_ids string"
    docs = spark.createDataFrame([(*row, "a", "b", "c", "d") for row in texts[::-1]], schema).repartition(6)
    for size in (1, 50, 1 << 20):
        shards = repair_ids.write(docs, tokenizer_path(), size)
        assert sorted(map(tuple, repair_ids.summary(shards).collect()), key=lambda row: row[1]) == want
    shards = repair_ids.write(docs, tokenizer_path(), 50)
    wanted = spark.createDataFrame([(4, 5, 25), (6, 0, 1000), (2, 0, 9), (12345, 0, 5)], "doc_id long, begin long, end long")
    got = {row.doc_id: row.ids for row in repair_ids.fetch(shards, wanted).collect()}
    whole = {doc_id: LIBRARY.encode(text or "", add_special_tokens=False).ids + [0] for doc_id, text in texts}
    assert got == {4: whole[4][5:25], 6: whole[6], 2: [0]}
    empty = docs.where("false")
    assert repair_ids.summary(repair_ids.write(empty, tokenizer_path())).collect() == []


def test_repeated_ids_fill_several_parts(spark):
    rows = [(1, "hot words here")] * 300 + [(i, f"n {i}") for i in range(2, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards = repair_ids.write(docs, tokenizer_path(), 40)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(map(tuple, repair_ids.summary(shards).collect()), key=lambda row: row[1])
    assert got == rows_of(rows)
    assert shards.where("array_contains(doc_ids, 1L)").select("part").distinct().count() > 1
