"""Byte-level BPE as a monoid: halves are encoded apart and joined by encoding windows round the cut again."""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from areaflow.llm.common import ship_package, small_batches, table

LEAF = 2048
WINDOW = 32

# The characters with the Unicode property White_Space.
WHITE_SPACE = frozenset(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                                  0x202F, 0x205F, 0x3000]))
_STABLE = unicodedata.ucd_3_2_0


@lru_cache(maxsize=65536)
def kind(char: str) -> str:
    """s, l, n or o for white space, letters, numbers and others; u where Unicode versions may differ."""
    if char in WHITE_SPACE:
        return "s"
    category = _STABLE.category(char)
    if category in ("Cn", "Cs", "Zs", "Zl", "Zp"):
        return "u"
    return {"L": "l", "N": "n"}.get(category[0], "o")


def cut_is_safe(left: str, right: str) -> bool:
    """True when no match of the pattern spans the cut between two characters, whatever stands further off.

    A match holds white space only at its start or throughout, so white space after
    anything else begins a match; letters, numbers and other marks never share a
    match, except in contractions, which begin with a mark and end in letters.
    """
    a, b = kind(left), kind(right)
    if b == "s":
        return a in "lno"
    return (a, b) in {("l", "n"), ("n", "l"), ("l", "o"), ("n", "o"), ("o", "n")}


class Codec:
    """Encoder of one vocabulary with the tree operations; pieces are (text, ids) pairs."""

    def __init__(self, rank_lines: bytes, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, rank_lines.splitlines()))}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.leaf, self.window = leaf, window

    def leaf_ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text)) if text else []

    def _tree(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.leaf_ids(text[start:end])
        middle = (start + end) // 2
        left, right = self._tree(text, start, middle), self._tree(text, middle, end)
        return self.join(text, start, middle, end, left, right)

    def join(self, text: str, start: int, cut: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[start:end] from the ids of its parts before and after `cut`.

        The window grows on both sides, twice as wide each time, until each edge is a
        safe cut or an end; what lies outside is then encoded as if it stood alone, so
        its tokens stay.
        """
        if cut_is_safe(text[cut - 1], text[cut]):
            return left + right
        a = self._safe_before(text, start, cut)
        b = self._safe_after(text, cut, end)
        kept_left = self._drop_tail(left, len(text[a:cut].encode()))
        kept_right = self._drop_head(right, len(text[cut:b].encode()))
        return kept_left + self.leaf_ids(text[a:b]) + kept_right

    def _safe_before(self, text: str, start: int, cut: int) -> int:
        width, near = self.window, cut
        while True:
            low = max(start, cut - width)
            for i in range(near - 1, low, -1):
                if cut_is_safe(text[i - 1], text[i]):
                    return i
            if low == start:
                return start
            width, near = width * 2, low + 1

    def _safe_after(self, text: str, cut: int, end: int) -> int:
        width, near = self.window, cut
        while True:
            high = min(end, cut + width)
            for i in range(near + 1, high):
                if cut_is_safe(text[i - 1], text[i]):
                    return i
            if high == end:
                return end
            width, near = width * 2, high - 1

    def _drop_tail(self, ids: list[int], n_bytes: int) -> list[int]:
        k = len(ids)
        while n_bytes > 0:
            k -= 1
            n_bytes -= len(self.bytes_of[ids[k]])
        assert n_bytes == 0, "a safe cut is a token border"
        return ids[:k]

    def _drop_head(self, ids: list[int], n_bytes: int) -> list[int]:
        k = 0
        while n_bytes > 0:
            n_bytes -= len(self.bytes_of[ids[k]])
            k += 1
        assert n_bytes == 0, "a safe cut is a token border"
        return ids[k:]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: halves are decoded apart and concatenated."""
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=4)
def codec(rank_lines: bytes, pattern: str, leaf: int) -> Codec:
    return Codec(rank_lines, pattern, leaf)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, leaf: int = LEAF,
                     keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, and the ids themselves if wanted.

    `vocabulary` is a rank file the driver can read; its content (some MB, fixed) is
    broadcast.  A null text is an empty one and has no ids.  Each row is encoded by
    itself, so repeated rows and null ids need no care; only doc_id and text are read.
    Ids of a text of any length are those of encoding it at once.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    with open(vocabulary, "rb") as lines:
        ranks = spark.sparkContext.broadcast(lines.read())

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if keep_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(ranks.value, pattern, leaf)
        for batch in batches:
            ids = [tree.encode(t or "") for t in batch.column("text").to_pylist()]
            columns = [
                batch.column("doc_id"), pa.array(list(map(len, ids)), pa.int64()),
                pa.array([hashlib.sha256(np.asarray(i, "<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(tree.decode(i)).hexdigest() for i in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(
                columns + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
        + (", ids array<int>" if keep_ids else ""))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN, keep_ids=False)
