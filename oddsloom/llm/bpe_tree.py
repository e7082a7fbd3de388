"""Byte-level BPE by tree concatenation.

A long text is halved until its parts are short, the parts are encoded in
parallel tasks, and the encodings are joined pairwise up the tree. At a join a
window around the cut is encoded again and grows until both sides agree:

* A hard boundary is a place that the pre-tokenizer splits in any context, for
  instance between a letter and a space. Encodings of what lies before and
  after it simply concatenate, so a window between the hard boundaries next to
  the cut replaces exactly the tokens that the cut may have changed.
* In text without such places (one very long word, a run of spaces) the window
  takes a growing number of tokens on either side. Neighbouring tokens of one
  word are a valid encoding exactly if each pair of neighbours is; so once the
  window's outer tokens are those of the two sides, the splice is valid too.

Ids equal those of the tokenizer file used on the whole text, special tokens in
the text included. Null texts count as empty; an empty text has no ids. Repeated
rows are encoded each, a null doc_id stays null. A very long text is parts of
``LEAF`` bytes while it is encoded, and one row when they are joined. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.common import strings

#: Longest part that is encoded in one go, and first reach of a window to either side of a cut, in bytes.
LEAF, WINDOW = 32768, 256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and digits end at any other character, other signs at white space, letters and digits; an apostrophe
#: may belong to the letter after it, and white space to whatever follows.
_HARD = regex.compile(
    r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])|(?<=')(?=[\s\p{N}])"
)
_PLAIN = regex.compile(r"\p{L}+|\p{N}+|\s+|[^\s\p{L}\p{N}']+")
_ZONE = 64
_EMPTY = np.empty(0, np.uint32)


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable Latin-1 bytes stand for themselves, the others take the letters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = {item["content"]: item["id"] for item in content["added_tokens"]}
        letters = _byte_letters()
        ranks = {
            bytes(letters[c] for c in token): rank
            for token, rank in content["model"]["vocab"].items()
            if token not in self.special
        }
        self._encoding = tiktoken.Encoding(
            "file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special
        )
        pieces = {**{rank: token for token, rank in ranks.items()}}
        pieces |= {rank: token.encode() for token, rank in self.special.items()}
        self.lengths = np.zeros(max(pieces) + 1, np.int64)
        for rank, token in pieces.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, allowed_special="all") if text else _EMPTY

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8; bytes that are no UTF-8 become the replacement character."""
        return self._encoding.decode_bytes(ids.tolist()).decode("utf-8", "replace").encode()

    def _splits_special(self, raw: bytes, place: int) -> bool:
        for token in self.special:
            mark = token.encode()
            at = raw.find(mark, max(0, place - len(mark) + 1), place + len(mark) - 1)
            if 0 <= at < place:
                return True
        return False

    def boundary_before(self, raw: bytes, least: int, cut: int) -> int | None:
        """Last hard boundary in (least, cut], if there is one."""
        begin = _char_start(raw, least)
        text = raw[begin : _char_end(raw, min(len(raw), cut + 4))].decode()
        for match in reversed([*_HARD.finditer(text)]):
            place = begin + len(text[: match.start()].encode())
            if least < place <= cut and not self._splits_special(raw, place):
                return place
        return None

    def boundary_after(self, raw: bytes, cut: int, most: int) -> int | None:
        """First hard boundary in [cut, most), if there is one."""
        begin = _char_start(raw, max(0, cut - 4))
        text = raw[begin : _char_end(raw, most)].decode()
        for match in _HARD.finditer(text):
            place = begin + len(text[: match.start()].encode())
            if cut <= place < most and not self._splits_special(raw, place):
                return place
        return None

    def _tokens(self, ids: np.ndarray, size: int) -> int:
        """How many of the first tokens begin within the first ``size`` bytes."""
        sizes = np.cumsum(self.lengths[ids[:size]])
        return int(np.searchsorted(sizes, size)) + 1 if size else 0

    def _uniform(self, raw: bytes, place: int, begin: int, end: int, token: int) -> bool:
        """Whether the characters around ``place`` are of one kind, further than a token and a contraction reach."""
        around = _ZONE + int(self.lengths[token])
        if place - around < begin or place + around > end:
            return False
        zone = raw[_char_start(raw, place - around) : _char_end(raw, place + around)]
        return _PLAIN.fullmatch(zone.decode()) is not None

    def join(
        self, raw: bytes, begin: int, cut: int, end: int, left: np.ndarray, right: np.ndarray, window: int = WINDOW
    ) -> np.ndarray:
        """Encoding of raw[begin:end] from those of raw[begin:cut] and raw[cut:end].

        A side agrees if the window ends at a hard boundary or at the end of
        the text, or if its outer token is the side's own and lies well within
        one word.
        """
        raw, cut, end, reach = raw[begin:end], cut - begin, end - begin, window
        reverse = left[::-1]
        while True:
            low = 0 if cut <= reach else self.boundary_before(raw, cut - reach, cut)
            high = end if end - cut <= reach else self.boundary_after(raw, cut, cut + reach)
            x, y = low, high
            if low is None:
                first = len(left) - self._tokens(reverse, reach)
                x = cut - int(self.lengths[left[first:]].sum())
                while raw[x] & 0xC0 == 0x80:
                    first, x = first - 1, x - int(self.lengths[left[first - 1]])
            else:
                first = len(left) - self._tokens(reverse, cut - low)
            if high is None:
                last = self._tokens(right, reach)
                y = cut + int(self.lengths[right[:last]].sum())
                while y < end and raw[y] & 0xC0 == 0x80:
                    last, y = last + 1, y + int(self.lengths[right[last]])
            else:
                last = self._tokens(right, high - cut)
            again = self.encode(raw[x:y].decode())
            same_left = x == low or x == 0 or (again[0] == left[first] and self._uniform(raw, x, 0, end, left[first]))
            same_right = y == high or y == end or (
                again[-1] == right[last - 1] and self._uniform(raw, y, 0, end, right[last - 1])
            )
            if same_left and same_right:
                return np.concatenate((left[:first], again, right[last:]))
            reach *= 4

    def join_tree(self, parts: list[bytes], ids: list[np.ndarray], window: int = WINDOW) -> np.ndarray:
        """Encoding of the whole text from those of its consecutive parts, joined pairwise."""
        raw = b"".join(parts)
        ends = np.cumsum([0, *map(len, parts)]).tolist()
        pieces = [(ends[i], ends[i + 1], ids[i]) for i in range(len(parts))]
        while len(pieces) > 1:
            joined = [
                (a[0], b[1], self.join(raw, a[0], a[1], b[1], a[2], b[2], window))
                for a, b in zip(pieces[::2], pieces[1::2])
            ]
            pieces = joined + pieces[len(joined) * 2 :]
        return pieces[0][2] if pieces else _EMPTY


def _char_start(raw: bytes, place: int) -> int:
    while 0 < place < len(raw) and raw[place] & 0xC0 == 0x80:
        place -= 1
    return place


def _char_end(raw: bytes, place: int) -> int:
    while place < len(raw) and raw[place] & 0xC0 == 0x80:
        place += 1
    return place


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The codec of a file, once per worker."""
    return Codec(path)


def split_text(raw: bytes, leaf: int = LEAF) -> list[bytes]:
    """Parts of a text by halving until none is over ``leaf`` bytes, 8 at least; their number is a power of two."""
    parts = [raw]
    while max(map(len, parts)) > max(8, leaf):
        halved = []
        for part in parts:
            middle = _char_start(part, len(part) // 2)
            halved += [part[:middle], part[middle:]]
        parts = halved
    return parts


def _finish(ids: np.ndarray, output: str, book: Codec) -> dict:
    if output == "ids":
        return {"n_tokens": len(ids), "ids": ids.astype(np.int32)}
    plain = ids.astype("<u4").tobytes()
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(plain).hexdigest(),
        "decoded_sha256": hashlib.sha256(book.decode(ids)).hexdigest(),
    }


_OUTPUTS = {
    "ids": ("n_tokens long, ids array<int>", (pa.int64(), pa.list_(pa.int32()))),
    "digest": ("n_tokens long, ids_sha256 string, decoded_sha256 string", (pa.int64(), pa.string(), pa.string())),
}


def encode(docs: DataFrame, path: str, output: str = "ids", leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """doc_id, n_tokens and, by ``output``, the ids or digests of the ids and of their decoded text.

    Texts of up to ``leaf`` bytes are encoded where they are read. Parts of
    longer ones are spread over tasks by (row, part) and joined per row.
    """
    fields, kinds = _OUTPUTS[output]
    names = [field.split()[0] for field in fields.split(", ")]
    schema = f"doc_id long, {fields}"

    def finished(doc_ids: list, results: list[np.ndarray]) -> pa.RecordBatch:
        book = codec(path)
        rows = [_finish(ids, output, book) for ids in results]
        columns = [pa.array([row[name] for row in rows], kind) for name, kind in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *columns], names=["doc_id", *names])

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                yield finished(some["doc_id"].to_pylist(), [codec(path).encode(text) for text in strings(some["text"])])

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, text in zip(*[batch[name].to_pylist() for name in ("row", "doc_id", "text")], strict=True):
                pieces = split_text(text.encode(), leaf)
                size = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * size, pa.int64()), pa.array([doc_id] * size, pa.int64()),
                        pa.array(range(size), pa.int32()), pa.array(pieces, pa.binary()),
                    ],
                    names=["row", "doc_id", "part", "piece"],
                )

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [codec(path).encode(piece.decode()).tobytes() for piece in batch["piece"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, "ids"]
            )

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        ids = [np.frombuffer(part, np.uint32) for part in table["ids"].to_pylist()]
        result = codec(path).join_tree(table["piece"].to_pylist(), ids, window)
        return pa.Table.from_batches([finished([table["doc_id"][0].as_py()], [result])])

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long"), text)
    short = rows.where(F.octet_length("text") <= leaf).mapInArrow(whole, schema)
    long = rows.where(F.octet_length("text") > leaf).withColumn("row", F.monotonically_increasing_id())
    pieces = long.mapInArrow(parts, "row long, doc_id long, part int, piece binary").repartition("row", "part")
    leaves = pieces.mapInArrow(encoded, "row long, doc_id long, part int, piece binary, ids binary")
    return short.unionByName(leaves.groupBy("row").applyInArrow(joined, schema))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for rows with ids; null ids give null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if not ids.is_valid else codec(path).decode(np.array(ids.as_py(), np.uint32)).decode()
                for ids in batch["ids"]
            ]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
