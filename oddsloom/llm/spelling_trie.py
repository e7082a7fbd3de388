"""Spelling variants by a dictionary of pairs of trie nodes.

The words' prefixes are the nodes of one trie, their suffixes those of another,
built on the reversed words. Sorting words over ranges lets every range number
its own nodes: a word shares the nodes of its common prefix with the word before
it and adds the others. What precedes a range (its last word, that word's nodes
and how many nodes and words there are) is settled from one row a range.

Each word enters the dictionary under integer pairs (prefix node, suffix node):
with nothing between them at each of its positions ("split"), and with one
letter between them ("skip"). Words with equal skip pairs differ by one replaced
letter; a skip pair equal to a split pair is a letter deleted or inserted. Nodes
are exact, so are neighbours. Of a run of equal letters only the last counts as
deleted, so each neighbour is met once. Words under one pair differ by one
letter there: a pair holds as many words as there are letters, and one more, and
no key gathers more, however frequent its letters are.

A word's form is its most frequent neighbour, if frequent enough; counts grow
along forms, so they make trees, whose roots are found by doubling pointers.

Null texts have no words; a null doc_id counts as empty text in the checksum
that decides on deletions. Empty texts, and words too short or too rare, give no
row. Repeated rows count each time. Texts are read whole; a very long word costs
two dictionary rows a letter. Ties go to the word that is smaller in code-point
order. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.common import strings
from oddsloom.session import materialize

#: One run in so many loses a letter; least length and count of a word; how much more frequent a form is.
DELETED, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Distinct words that a task counts before it passes them on.
HELD = 1 << 18

_NUMBERED = "part int, no long, word string, n long, nodes array<long>, last_of_run array<boolean>"


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n over whole texts, after the deletions."""
    runs_of = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}").findall

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), strings(batch["text"]), strict=True):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # Bytes in lower case: A-Z only, whatever the other letters are.
                for word, n in Counter(runs_of(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % DELETED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield counted(held)
                    held = Counter()
        if held:
            yield counted(held)

    words = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class _Trie:
    """Numbers nodes of words that come in order; knows the path of the last word."""

    def __init__(self, last: str = "", path: list[int] | None = None, known: int = 0, words: int = 0) -> None:
        self.last, self.path, self.known, self.words = last, path or [0], known, words

    def add(self, word: str) -> list[int]:
        shared = len(os.path.commonprefix((self.last, word)))
        fresh = len(word) - shared
        self.path = self.path[: shared + 1] + list(range(self.known + 1, self.known + fresh + 1))
        self.last, self.known, self.words = word, self.known + fresh, self.words + 1
        return self.path


def _starts(ranges: list) -> dict[int, tuple]:
    """State of the trie before each range, from what each range is by itself."""
    at, starts = _Trie(), {}
    for row in sorted(ranges, key=lambda row: row.part):
        starts[row.part] = (at.last, at.path, at.known, at.words)
        shared = len(os.path.commonprefix((at.last, row.first)))
        # By itself the range's first word has the nodes 1, 2, ... of which the first ``shared`` are known already.
        path = [at.path[node] if node <= shared else at.known + node - shared for node in row.path]
        at = _Trie(row.last, path, at.known + row.known - shared, at.words + row.words)
    return starts


def _ordered(rows: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, str, str, int]]:
    for batch in rows:
        yield from zip(*[batch[name].to_pylist() for name in ("part", "key", "word", "n")], strict=True)


def number_nodes(words: DataFrame, backwards: bool = False) -> DataFrame:
    """no (place in order), word, n, the nodes of its prefixes (or, backwards, suffixes) by length, and whether each letter ends a run."""
    key = F.reverse("word") if backwards else F.col("word")
    ranged = materialize(
        words.select(key.alias("key"), "word", "n").repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ranges"
    )
    in_order = ranged.repartition("part").sortWithinPartitions("part", "key").select("part", "key", "word", "n")

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, trie = None, "", _Trie()

        def row() -> pa.RecordBatch:
            values = [part, first, trie.last, trie.path, trie.known, trie.words]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            names = ["part", "first", "last", "path", "known", "words"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for own, word, _, _ in _ordered(batches):
            if own != part:
                if part is not None:
                    yield row()
                part, first, trie = own, word, _Trie()
            trie.add(word)
        if part is not None:
            yield row()

    schema = "part int, first string, last string, path array<long>, known long, words long"
    spark = words.sparkSession
    starts = spark.sparkContext.broadcast(_starts(in_order.mapInArrow(alone, schema).collect()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, trie = None, _Trie()

        def tell(held: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            names = ["part", "no", "word", "n", "nodes", "last_of_run"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds, strict=True)], names=names)

        held, letters = [], 0
        for own, key_, word, n in _ordered(batches):
            if own != part:
                part, trie = own, _Trie(*starts.value[own])
            ends = [a != b for a, b in zip(word, word[1:])] + [True]
            held.append((own, trie.words, word, n, trie.add(key_), ends))
            letters += len(word)
            if letters >= 1 << 16:
                yield tell(held)
                held, letters = [], 0
        if held:
            yield tell(held)

    return in_order.mapInArrow(run, _NUMBERED).drop("part")


def neighbours(words: DataFrame) -> DataFrame:
    """no, word, n, n_near and best (n and negated no of the most frequent neighbour) for each of the distinct ``words``."""
    forward = materialize(number_nodes(words), "prefixes")
    backward = number_nodes(words, backwards=True).select("word", F.col("nodes").alias("suffix"))
    size = F.size("last_of_run")
    entry = F.transform(
        F.sequence(F.lit(0), 2 * size),
        lambda k: F.struct(
            F.get("nodes", F.floor(k / 2).cast("int")).alias("p"),
            F.get("suffix", (size - F.floor((k + 1) / 2)).cast("int")).alias("s"),
            (k % 2 == 1).alias("skip"),
            F.get("last_of_run", F.floor(k / 2).cast("int")).alias("ends"),
        ),
    )
    entries = forward.join(backward, "word").select("no", "n", F.explode(entry).alias("e"))
    held = F.struct("n", (-F.col("no")).alias("minus"), F.col("e.skip").alias("skip"), F.col("e.ends").alias("ends"))
    groups = entries.groupBy(F.col("e.p").alias("p"), F.col("e.s").alias("s")).agg(F.collect_list(held).alias("words"))
    one = groups.where(F.size("words") > 1).select("words", F.explode("words").alias("w"))

    def near(other):
        replaced = F.col("w.skip") & other.skip & (other.minus != F.col("w.minus"))
        inserted = ~F.col("w.skip") & other.skip & other.ends
        return replaced | inserted | (F.col("w.skip") & F.col("w.ends") & ~other.skip)

    met = one.select((-F.col("w.minus")).alias("no"), F.filter("words", near).alias("near")).where(F.size("near") > 0)
    best = F.array_max(F.transform("near", lambda other: F.struct(other.n.alias("n"), other.minus.alias("minus"))))
    found = met.select("no", F.size("near").cast("long").alias("links"), best.alias("best"))
    found = found.groupBy("no").agg(F.sum("links").alias("n_near"), F.max("best").alias("best"))
    return forward.select("no", "word", "n").join(found, "no", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


def _roots(forms: DataFrame) -> DataFrame:
    """no and the number of the last form, from rows of (no, root) where root is the next form; doubles the reach each time."""
    while True:
        onward = forms.select(F.col("no").alias("root"), F.col("root").alias("next"))
        forms = materialize(
            forms.join(onward, "root", "left").select("no", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots",
        )
        if not forms.where("moved").limit(1).count():
            return forms.drop("moved")
        forms = forms.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n for each of the distinct ``words`` with counts n."""
    near = neighbours(words)
    often = F.col("best.n") >= ratio * F.col("n")
    near = materialize(
        near.select(
            "no", "word", "n", "n_near", F.when(often, -F.col("best.minus")).alias("form_no"), F.when(often, F.col("best.n")).alias("form_n")
        ),
        "neighbours",
    )
    roots = _roots(near.where(F.col("form_no").isNotNull()).select("no", F.col("form_no").alias("root")))
    names = near.select("no", "word")
    forms = names.select(F.col("no").alias("form_no"), F.col("word").alias("form"))
    ends = roots.join(names.select(F.col("no").alias("root"), F.col("word").alias("root_word")), "root").select("no", "root_word")
    return near.join(forms, "form_no", "left").join(ends, "no", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
