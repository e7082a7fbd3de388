import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from oddsloom.llm import bpe_tree
from oddsloom.llm.common import tokenizer_path

PATH = tokenizer_path()


LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def by_tree(text, leaf=24, window=12):
    book = bpe_tree.codec(PATH)
    parts = bpe_tree.split_text(text.encode(), leaf)
    return book.join_tree(parts, [book.encode(part.decode()) for part in parts], window)


def hard_texts():
    rng = random.Random(5)
    letters = "".join(rng.choice("abcdefgh") for _ in range(3000))
    return [
        "", " ", "a", "a" * 4001, " " * 3001 + "x", "x" + "\n \t" * 900, letters, "é" * 1501, "日本語" * 700,
        "😀" * 500, "1" * 2500, "!" * 2000 + "'" + "s" * 900, "it's we'll they're " * 90, "'" * 800, "ab'cd" * 300,
        "<|endoftext|>" * 90, "x<|endoftext|> y  <|endoftext|>" * 60, "!" * 300 + "<|endoftext|>" + "!" * 300,
        "<|endof" * 80, "-" * 1000 + " " * 500 + "=" * 700, "a1b2 c3,d4  e5\n\n" * 120, "ſK" * 300,
    ]


def test_tree_equals_library_on_hard_texts(library):
    for text in hard_texts():
        want = library.encode(text, add_special_tokens=False).ids
        for leaf, window in ((24, 12), (7, 4), (200, 64), (64, 1)):
            assert by_tree(text, leaf, window).tolist() == want, (text[:20], leaf, window)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "'", "'s", "'ll", "1", "é", "<|endoftext|>", "\n", "!", "😀", "Zq"])))
def test_tree_equals_library_on_mixtures(words):
    text = "".join(words)
    assert by_tree(text, 5, 3).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_operator(spark, library):
    texts = [*hard_texts(), None, "plain words, and more.", "plain words, and more."]
    rows = [(i if i != 3 else None, text, "x") for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe_tree.encode(docs, PATH, "digest", leaf=100, window=40).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append(
            (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256(back.encode()).hexdigest())
        )
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    encoded = bpe_tree.encode(docs, PATH, leaf=100, window=40)
    back = bpe_tree.decode(encoded, PATH).collect()
    assert sorted([(row.doc_id, row.text) for row in back], key=repr) == sorted(
        [(doc_id, text or "") for doc_id, text, _ in rows], key=repr
    )
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_tree.encode(empty, PATH, "digest").count() == 0
