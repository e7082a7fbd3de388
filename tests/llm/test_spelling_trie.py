"""Spelling variants against direct computations."""

import collections
import random
import re
import zlib

from oddsloom.llm import spelling_trie

SCHEMA = "doc_id long, text string, word string, n string, no string, part string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows, deleted=199):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % deleted == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words):
    near = {w: [o for o in words if one_apart(w, o)] for w in words}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[word] = best if best is not None and words[best] >= 5 * words[word] else None
    out = []
    for word, n in words.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out.append((word, form[word], root, n, len(near[word]), words.get(form[word])))
    return sorted(out)


def found(spark, words):
    return sorted(map(tuple, spelling_trie.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)).collect()))


def test_neighbours_of_dense_words(spark):
    """Few letters, so that words have many neighbours, runs of equal letters and ties."""
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.choice([1, 1, 2, 5, 10, 25, 50, 700]) for _ in range(900)}
    words |= {"a" * size: size**4 for size in range(1, 12)} | {"z" * 3000: 1, "z" * 2999: 9, "z" * 1500 + "y" + "z" * 1499: 100}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert found(spark, words) == expected(words)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    assert found(spark, words) == expected(words)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found(spark, {}) == []
    assert found(spark, {"alone": 3}) == [("alone", None, "alone", 3, 0, None)]


def test_node_numbers(spark):
    words = {w: 1 for w in "car card care cart cat dog do d".split()}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    for backwards in (False, True):
        rows = spelling_trie.number_nodes(frame, backwards).collect()
        node_of = {}
        for row in rows:
            key = row.word[::-1] if backwards else row.word
            assert len(row.nodes) == len(key) + 1 and row.nodes[0] == 0
            for i, node in enumerate(row.nodes):
                assert node_of.setdefault(node, key[:i]) == key[:i]
        assert len(set(node_of.values())) == len(node_of) and sorted(node_of) == list(range(len(node_of)))
        assert sorted(row.no for row in rows) == list(range(len(words)))


def test_counts_of_awkward_rows(spark):
    rng = random.Random(4)
    stems = ["planet", "Planéts", "PLANETS", "plané×÷ts", "gardens", "garden", "gardenss", "short", "ÀÉÎÿabc", "àéîÿabc", "日本語planet"]
    rows = [(None, None), (1, None), (2, ""), (None, "planet planet7planet"), (3, "x" * 70000 + " " + "PLANET-" * 50)]
    rows += [(i, " ".join(rng.choices(stems, k=30))) for i in range(-5, 400)] + [(7, "garden hot words planet")] * 50
    docs = spark.createDataFrame([(*row, "a", "b", "c", "d") for row in rows], SCHEMA).repartition(6)
    want = counted(rows)
    assert dict(map(tuple, spelling_trie.count_words(docs).collect())) == want
    assert found(spark, want) == expected(want)
    assert any(form for _, form, *_ in expected(want)) and len(want) > len({lowered(s) for s in stems})
    assert spelling_trie.variants(spelling_trie.count_words(docs.where("false"))).collect() == []
