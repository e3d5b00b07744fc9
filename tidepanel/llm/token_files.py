"""op12: token ids in binary files that share one zstandard dictionary, each document a frame of its own.

A file is: the mark, the bytes of an id (2 or 4), the SHA-256 of the dictionary; the frames, one a document; the index, an entry a
document in ascending order of doc_id (null first) with the place of its frame and its number of ids; the place of the index, the
number of documents and of ids, the mark. So one document is read by its index entry and one frame. The dictionary lies beside the
files under its hash, and a reader refuses one that doesn't hash to what the file holds. It is trained once, on the serialised ids
of a bounded sample of documents (a documented parameter); every document is encoded and written whole.

Documents are put in order by a range partitioning on doc_id (and a hash of the text, so many rows of one id spread), each
partition writes files of bounded size under a name of its own, and a file appears under its name only when it is whole. A
repeated task writes the same bytes again. Files know nothing of each other: `start` is a running sum over the table of files.

Rows: a null text is empty; an empty text is its end id alone. Rows of one doc_id stand in the order of a hash of the text, then
the text; null ids come first, as one more id. Very long texts are one frame. Extra columns play no part. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

MARK = b"TPIDS001"
INDEX = np.dtype([("missing", "u1"), ("doc_id", "<i8"), ("place", "<u8"), ("tokens", "<u8")])
TAIL = np.dtype([("index", "<u8"), ("docs", "<u8"), ("tokens", "<u8"), ("mark", "S8")])
#: A file is closed once it holds so many bytes of frames or documents.
FILE_BYTES, FILE_DOCS = 64 << 20, 1 << 20
#: The dictionary: bytes of it, documents of the sample, and bytes of the longest document that the sample takes.
DICTIONARY, SAMPLE, LONGEST = 112 << 10, 1500, 64 << 10


# ------------------------------------------------------------------ encoding

#: A space behind a character that isn't one: no token reaches across the place before it, as byte-level tokens are cut at spaces first.
_CUT = re.compile("(?<=[^\\s\\u180e\\u200b\\ufeff])(?= )")
_WORD = re.compile(" [^\\s\\u180e\\u200b\\ufeff](?:.*[^\\s\\u180e\\u200b\\ufeff])?", re.DOTALL)
_RUN = re.compile("[\\s\\u180e\\u200b\\ufeff] ")


class Encoder:
    """Ids of texts by the tokenizers library; what stands between two cuts is encoded once and kept, up to `most` pieces.

    Only for tokenizers without a normaliser that cut texts by the byte-level pattern and put no space in front; others are
    given whole texts.
    """

    def __init__(self, path: str, end: int | None = 0, most: int = 1_400_000):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = tokenizers.Tokenizer.from_file(path)
        self.kind = "<u2" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.end = b"" if end is None else np.array([end], self.kind).tobytes()
        self.most, self.kept, self.older = most, {}, {}
        split = str(self.model.pre_tokenizer)
        #: Bytes of each token: byte-level tokens have a character a byte.
        words = self.model.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(words.values(), default=0) + 1, np.int64)
        self.bytes[list(words.values())] = list(map(len, words))
        self.cut = self.model.normalizer is None and split.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in split

    def _learn(self, new: set[str]) -> None:
        """Keep the ids of pieces. Of two generations the older goes when the newer is half of `most`; what is used comes over."""
        if len(self.kept) + len(new) > self.most // 2:
            self.kept, self.older = {}, self.kept
        again = self.older.keys() & new
        self.kept.update(zip(again, map(self.older.__getitem__, again)))
        alone, joined = [], []
        for p in new - again:
            (joined if _WORD.fullmatch(p) else alone).append(p)
        for lo in range(0, len(alone), 4096):
            self._each(alone[lo : lo + 4096])
        for lo in range(0, len(joined), 2000):
            self._together(joined[lo : lo + 2000])

    def _each(self, pieces: list[str]) -> None:
        for piece, e in zip(pieces, self.model.encode_batch(pieces, add_special_tokens=False), strict=True):
            self.kept[piece] = np.array(e.ids, self.kind).tobytes()

    def _together(self, pieces: list[str]) -> None:
        """Encode pieces as one text: each starts with a space behind a character that isn't one. Bytes of tokens tell them apart."""
        ids = np.array(self.model.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, np.int64)
        ends, wanted = np.cumsum(self.bytes[ids]), np.cumsum([len(p.encode()) for p in pieces])
        last = np.searchsorted(ends, wanted)
        if last[-1] >= len(ends) or (ends[last] != wanted).any():
            return self._each(pieces)
        raw, width, lo = ids.astype(self.kind).tobytes(), int(self.kind[-1]), 0
        for piece, hi in zip(pieces, ((last + 1) * width).tolist(), strict=True):
            self.kept[piece] = raw[lo:hi]
            lo = hi
        return None

    def serialised(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, little-endian."""
        if not self.cut:
            return [np.array(e.ids, self.kind).tobytes() + self.end for e in self.model.encode_batch(texts, add_special_tokens=False)]
        cut = [(_CUT.split(t) if "\0" in t or _RUN.search(t) else t.replace(" ", "\0 ").split("\0")) for t in texts]
        found = [list(map(self.kept.get, pieces)) for pieces in cut]
        new = {p for pieces, ids in zip(cut, found, strict=True) if None in ids for p, x in zip(pieces, ids, strict=True) if x is None}
        if new:
            self._learn(new)
            found = [[self.kept[p] if x is None else x for p, x in zip(pieces, ids, strict=True)] if None in ids else ids for pieces, ids in zip(cut, found, strict=True)]
        return [b"".join(ids) + self.end for ids in found]


@cache
def _encoder(path: str, end: int | None) -> Encoder:
    return Encoder(path, end)


def _slices(column: pa.Array, most: int = 1 << 20):
    """Runs of rows of about `most` characters."""
    texts, size, held = column.to_pylist(), 0, []
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


# ---------------------------------------------------------------- dictionary


def trained(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of at most `size` bytes; the samples themselves where they are too few to train on."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 4)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _coder(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def dictionary_of(docs: DataFrame, path: str, end: int | None = 0, sample: int = SAMPLE, longest: int = LONGEST) -> bytes:
    """The dictionary trained in one task on at most `sample` documents, drawn by a hash of their ids, of up to `longest` bytes each."""
    fit = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= longest).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    few = shared.bounded_sample(fit, "doc_id", sample)

    def train(batches):
        coded = [s for b in batches for texts in _slices(b.column("text")) for s in _encoder(path, end).serialised(texts)]
        yield pa.RecordBatch.from_arrays([pa.array([trained(coded)], pa.binary())], names=["dictionary"])

    rows = few.select("text").coalesce(1).mapInArrow(train, "dictionary binary").collect()  # one row of bounded size
    return bytes(rows[0][0]) if rows else b""


# --------------------------------------------------------------------- files


class Writer:
    """Files of one partition, one after the other."""

    def __init__(self, folder: str, part: int, kind: str, dictionary: bytes, level: int = 3):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.part, self.kind, self.number, self.out = part, kind, 0, None
        self.hash = hashlib.sha256(dictionary).digest()
        self.press = zstandard.ZstdCompressor(level=level, dict_data=_coder(dictionary))

    def add(self, doc_id: int | None, ids: bytes):
        """Write one document; gives the row of a file that it fills."""
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.number:06d}.ids"
            self.hidden = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.index = self.fs.open_output_stream(self.hidden), []
            self.at = self.out.write(MARK + bytes([int(self.kind[-1])]) + self.hash)
            self.tokens = 0
        n = len(ids) // int(self.kind[-1])
        self.index.append((doc_id is None, doc_id or 0, self.at, n))
        self.at += self.out.write(self.press.compress(ids))
        self.tokens += n
        if self.at >= FILE_BYTES or len(self.index) >= FILE_DOCS:
            return self.close()
        return None

    def close(self):
        if self.out is None:
            return None
        self.out.write(np.array(self.index, INDEX).tobytes())
        self.out.write(np.array([(self.at, len(self.index), self.tokens, MARK)], TAIL).tobytes())
        self.out.close()
        self.fs.move(self.hidden, f"{self.folder}/{self.name}")
        row = (self.part, self.number, self.name, len(self.index), self.tokens, self.at)
        self.out, self.number = None, self.number + 1
        return row


class Reader:
    """One file of ids: whole, or one document by its index entry and frame."""

    def __init__(self, folder: str, name: str):
        self.fs, where = pa.fs.FileSystem.from_uri(folder)
        self.file = self.fs.open_input_file(f"{where}/{name}")
        head = self.file.read_at(41, 0)
        self.tail = np.frombuffer(self.file.read_at(TAIL.itemsize, self.file.size() - TAIL.itemsize), TAIL)[0]
        if head[:8] != MARK or self.tail["mark"] != MARK:
            raise ValueError(f"{name} is no whole file of ids")
        self.kind, self.hash = f"<u{head[8]}", head[9:]
        with self.fs.open_input_file(f"{where}/{self.hash.hex()}.dictionary") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != self.hash:
            raise ValueError(f"{name} was written with another dictionary")
        at, n = int(self.tail["index"]), int(self.tail["docs"])
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        self.ends = np.append(self.index["place"][1:], np.uint64(at)).astype(np.int64)
        self.press = zstandard.ZstdDecompressor(dict_data=_coder(dictionary))

    def ids(self, row: int) -> np.ndarray:
        """The ids of the file's row-th document."""
        at = int(self.index["place"][row])
        return np.frombuffer(self.press.decompress(self.file.read_at(int(self.ends[row]) - at, at)), self.kind)

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document; the first one where the id repeats, None where it isn't."""
        first = int(self.index["missing"].sum())
        row = first + int(np.searchsorted(self.index["doc_id"][first:], doc_id))
        return self.ids(row) if row < len(self.index) and self.index["doc_id"][row] == doc_id else None


def write(docs: DataFrame, tokenizer: str, folder: str, end: int | None = 0) -> DataFrame:
    """Encode docs (doc_id, text) into files in `folder`; gives the table of files (part, number, name, docs, tokens, bytes, start).

    start is the number of ids in all files before.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary = dictionary_of(docs, tokenizer, end)
    fs, where = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(where, recursive=True)
    with fs.open_output_stream(f"{where}/{hashlib.sha256(dictionary).hexdigest()}.dictionary") as f:
        f.write(dictionary)
    shipped = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY bytes

    def task(batches):
        coder = _encoder(tokenizer, end)
        out, rows = Writer(folder, TaskContext.get().partitionId(), coder.kind, shipped.value), []
        for b in batches:
            ids, at = b.column("doc_id").to_pylist(), 0
            for texts in _slices(b.column("text")):
                for coded in coder.serialised(texts):
                    rows.append(out.add(ids[at], coded))
                    at += 1
        rows.append(out.close())
        rows = [r for r in rows if r]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("part", "number", "name", "docs", "tokens", "bytes"), map(list, zip(*rows, strict=True)), strict=True)))

    tie = F.xxhash64("text")
    ordered = docs.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    files = shared.stored(ordered.mapInArrow(task, "part long, number long, name string, docs long, tokens long, bytes long"))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def read(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; a task reads whole files, a frame at a time."""

    def task(batches):
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                file = Reader(folder, name)
                for lo in range(0, len(file.index), 10_000):
                    part = file.index[lo : lo + 10_000]
                    ids = [file.ids(lo + i) for i in range(len(part))]
                    sizes = np.array([len(x) for x in ids], np.int64)
                    if (sizes != part["tokens"].astype(np.int64)).any():
                        raise ValueError(f"{name}: a frame doesn't hold the ids that its index says")
                    starts = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64(), mask=part["missing"] == 1), pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    few = files.select("name", "start").repartition(max(1, min(files.count(), 100_000)), "name")
    return few.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op12_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every document's place, length and checksum as read back from the files."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"{shared.shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    files = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tokenizer), folder)
    return read(files, folder)
