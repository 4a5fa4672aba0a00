"""Token ids in binary files: framed records with masked checksums, and an offset index for shuffled reads."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaflow.llm.common import ship_package, small_batches, table
from areaflow.session import checkpoint_dir, cut_lineage

END_ID = 2
CACHED_PIECES = 450_000  # in each of two generations
READ_BYTES = 8_000_000
# Fixed values of the file format: added to a rotated checksum, and the size of frames and index entries.
MASK_DELTA = 0xA282EAD8
HEAD, FOOT = 12, 4  # bytes: length and its checksum; checksum of the data
INDEX = np.dtype([("null_id", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8")])

# Texts are cut into pieces before white space and before full stops and commas after letters, both seen only in ASCII:
# no match of the tokenizer's pattern spans such a cut, whatever stands further off.  So each piece is encoded by itself
# and looked up when it comes again.  A cut is where a byte's bits meet those of the byte before it.
CUT_HERE, CUT_AFTER = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
CUT_HERE[list(b"\t\n\x0b\x0c\r ")], CUT_HERE[list(b".,")] = 1, 2
CUT_AFTER[[c for c in range(256) if not CUT_HERE[c] & 1]] = 1
CUT_AFTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 3
# The other characters of white space, as the last three bytes up to their end, or two after any byte.
WIDE_WHITE = np.array([int.from_bytes(chr(c).encode(), "big") for c in (
    0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
SHORT_WHITE = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0)])
JOINED = 64  # pieces the library encodes as one text


def masked(data: bytes) -> int:
    """CRC-32, rotated by 15 bits and shifted, so that checksums of stored checksums stay sound."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    """length, its masked checksum, the data, its masked checksum."""
    size = struct.pack("<Q", len(data))
    return b"".join((size, struct.pack("<I", masked(size)), data, struct.pack("<I", masked(data))))


def unframe(buffer: bytes, at: int) -> bytes:
    size, check = struct.unpack_from("<QI", buffer, at)
    if masked(buffer[at:at + 8]) != check:
        raise ValueError("length of a record is damaged")
    data = buffer[at + HEAD:at + HEAD + size]
    if len(data) != size or masked(data) != struct.unpack_from("<I", buffer, at + HEAD + size)[0]:
        raise ValueError("a record is damaged")
    return data


def store(location: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, as Spark names it, that all executors share."""
    uri = re.sub(r"^file:/*", "file:///", location)
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def piece_offsets(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts in UTF-8 begin, and the end of the last; `starts` are those of the texts."""
    cut = np.zeros(len(data) + 1, bool)
    np.not_equal(CUT_HERE[data[1:]] & CUT_AFTER[data[:-1]], 0, out=cut[1:-1])
    if data.max() >= 0x80:
        at = np.flatnonzero(cut[1:-1] & (data[:-1] >= 0x80)) + 1
        a, b, c = (data[at - k].astype(np.int64) for k in (3, 2, 1))
        white = np.isin(b << 8 | c, SHORT_WHITE) | np.isin(a << 16 | b << 8 | c, WIDE_WHITE)
        cut[at[white]] = False
    cut[starts] = cut[-1] = True
    return np.flatnonzero(cut)



class PieceEncoder:
    """The tokenizers library with its defaults over pieces of texts; ids of pieces met lately are kept.

    The literal of an added token has no white space, so a piece holds it whole.
    """

    def __init__(self, model: str, limit: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = np.dtype(self.code)
        # Bytes of text behind each id: tokens are written with one character for each byte, added ones as they are.
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.n_bytes[number] = len(token)
        for number, token in self.tokenizer.get_added_tokens_decoder().items():
            self.n_bytes[number] = len(token.content.encode())
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = limit

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known; what was not met since the last change of generations is forgotten."""
        new = []
        for piece in pieces:
            old = self.older.get(piece)
            if old is None:
                new.append(piece)
            else:
                self.known[piece] = old
        joined = [p for p in new if p[0] in " \n" and not p.isspace()]
        self.learn_apart([p for p in new if p[0] not in " \n" or p.isspace()])
        for a in range(0, len(joined), 20_000):
            self.learn_joined(joined[a:a + 20_000])

    def learn_apart(self, pieces: list[str]) -> None:
        for a in range(0, len(pieces), 20_000):
            part = pieces[a:a + 20_000]
            for piece, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[piece] = array(self.code, got.ids).tobytes()

    def learn_joined(self, pieces: list[str]) -> None:
        """Pieces that begin with white space and end without are cut from each other in any order, so they are encoded
        many in one text; the bytes behind the ids tell them apart."""
        texts = ["".join(pieces[a:a + JOINED]) for a in range(0, len(pieces), JOINED)]
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(g.ids for g in got), self.width)
        ends, cuts = np.cumsum(self.n_bytes[ids]), np.cumsum([len(p.encode()) for p in pieces])
        last = np.searchsorted(ends, cuts)
        if not len(ends) or ends[-1] != cuts[-1] or (ends[last] != cuts).any():
            return self.learn_apart(pieces)  # not the tokens of a byte-level vocabulary
        data, start = ids.tobytes(), 0
        for piece, end in zip(pieces, ((last + 1) * self.width.itemsize).tolist()):
            self.known[piece] = data[start:end]
            start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text in this vocabulary's width, least byte first."""
        raw = [t.encode() for t in texts]
        data, sizes = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        if not data:
            return [b""] * len(texts)
        ends = np.cumsum(sizes)
        offsets = piece_offsets(np.frombuffer(data, np.uint8), ends - sizes)
        pieces = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [
            None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        different = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, different))
        new = [k for k, data in enumerate(found) if data is None]
        self.learn({different[k] for k in new})
        for k in new:
            found[k] = self.known[different[k]]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // self.width.itemsize
        ids, code = np.frombuffer(b"".join(found), self.width), pieces.indices.to_numpy()
        # The ids of the pieces one after the other, as they stand in the texts.
        n = counts[code]
        before = np.append(0, np.cumsum(n))
        every = ids[np.arange(before[-1]) + np.repeat((np.cumsum(counts) - counts)[code] - before[:-1], n)].tobytes()
        cuts = (before[np.searchsorted(offsets, np.append(0, ends))] * self.width.itemsize).tolist()
        return [every[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def encoder(model: str) -> PieceEncoder:
    return PieceEncoder(model)


def write_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; returns the manifest.

    Documents are range-partitioned by doc_id (nulls first; the text's length and a row
    number break ties) and each partition becomes one file of framed records and one
    index of (doc_id, offset, length).  File names carry the task attempt and only
    attempts that ended are in the manifest (part, path, rows, tokens, bytes), so lost
    executors and repeated attempts leave at most files that nothing refers to.  A null
    text is an empty one: its record holds the end id alone.  An empty table gives an
    empty manifest.  doc_id must be an integer; only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as text:
        model = spark.sparkContext.broadcast(text.read())  # a vocabulary: some MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model.value)
        end = np.array([end_id], pieces.width).tobytes()
        context = TaskContext.get()
        part = context.partitionId()
        files, root = store(folder)
        path = f"{root}/part-{part:06d}-{context.taskAttemptId()}"
        sink, index, at, tokens = None, [], 0, 0
        for batch in batches:
            if sink is None:
                files.create_dir(root, recursive=True)
                sink = files.open_output_stream(f"{path}.records")
            ids = batch.column("doc_id").to_pylist()
            for doc, data in zip(ids, pieces.encode([t or "" for t in batch.column("text").to_pylist()])):
                record = frame(data + end)
                index.append((doc is None, doc or 0, at, len(record)))
                at += len(record)
                tokens += len(data) // pieces.width.itemsize + 1
                sink.write(record)
        if sink is None:
            return
        sink.close()
        with files.open_output_stream(f"{path}.index") as out:
            out.write(frame(np.array(index, INDEX).tobytes()))
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_rows": [len(index)], "tokens": [tokens],
                                          "bytes": [at], "width": [pieces.width.itemsize]},
                                         schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_rows", pa.int64()),
                                                           ("tokens", pa.int64()), ("bytes", pa.int64()), ("width", pa.int32())]))

    keys = [F.col("doc_id").asc_nulls_first(), F.octet_length("text").asc_nulls_first(), F.col("_row")]
    ordered = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(
        *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return cut_lineage(ordered.mapInArrow(
        run, "part int, path string, n_rows bigint, tokens bigint, bytes bigint, width int"))


def read_files(manifest: DataFrame, folder: str, shuffle_seed: int | None = None,
               read_bytes: int = READ_BYTES) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit), in file order or, with a seed, shuffled by the index.

    start counts the ids of all documents before.  Each file is read by one task, its
    records in runs of about `read_bytes`; a shuffled read takes the index entries of a
    file in seeded order.  Damaged records end the job.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def records(path: str, width: int, base: int) -> Iterator[tuple]:
        source, root = store(folder)
        path = f"{root}/{os.path.basename(path)}"
        with source.open_input_stream(f"{path}.index") as entries:
            index = np.frombuffer(unframe(entries.read(), 0), INDEX)
        counts = (index["length"].astype(np.int64) - HEAD - FOOT) // width
        starts = base + np.cumsum(counts) - counts
        order = np.arange(len(index))
        if shuffle_seed is not None:
            order = np.random.default_rng([shuffle_seed, base]).permutation(len(index))
        with source.open_input_file(f"{path}.records") as data:
            at = 0
            while at < len(order):
                last = at + 1
                if shuffle_seed is None:
                    span = index["offset"] + index["length"] - index["offset"][at]
                    last = max(last, int(np.searchsorted(span, read_bytes, side="right")))
                low = int(index["offset"][order[at]])
                high = int(index["offset"][order[last - 1]] + index["length"][order[last - 1]])
                data.seek(low)
                buffer = data.read(high - low)
                for k in order[at:last]:
                    raw = unframe(buffer, int(index["offset"][k]) - low)
                    ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                    yield None if index["null_id"][k] else int(index["doc_id"][k]), int(starts[k]), ids
                at = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                for record in records(row["path"], row["width"], row["base"]):
                    held.append(record)
                    size += len(record[2])
                    if size >= read_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    n = max(1, manifest.count())
    return files.select("path", "width", "base", "part").repartitionByRange(n, "part").mapInArrow(
        run, "doc_id bigint, start bigint, ids binary")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    manifest = write_files(table(spark, folder, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_files(manifest, out).select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"),
                                            F.crc32("ids").alias("ids_crc32"))
