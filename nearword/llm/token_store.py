"""Token ids as binary files in document order, Simple-8b coded, and their reader.

Documents are dealt out by ranges of ``doc_id`` and sorted; each task tokenizes its range as it streams by
and writes files of at most about ``FILE_TOKENS`` ids to the shared folder. A file::

    8 bytes   magic "NWTOK8B\\x01"
    words     Simple-8b words, little-endian, in blocks of 2048 ids
    index     n_docs x (doc_id int64, n_tokens int64), then n_blocks + 1 int64: where blocks begin, in words
    32 bytes  n_words, n_docs, n_blocks, flags (bit 0: doc_ids are null) as int64

A file's name is new for each attempt, and the manifest that Spark commits names the attempt's files that
count, so a lost executor or a repeated task leaves no doubt.

Defined cases: a null or empty text has the end id alone. Null ids come first and are read back as null.
Repeated ids are neighbours, in order of their text's hash. An empty table has no files. Other columns
are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearword.llm import simple8b, textbytes, tokenizing
from nearword.llm.storage import Scratch, open_input, open_output

MAGIC = b"NWTOK8B\x01"
FILE_TOKENS = 64 << 20
#: Ids that the reader decodes at once.
READ_BLOCKS = 512
MANIFEST = "part long, seq long, file string, n_docs long, n_tokens long"
_NULL = np.iinfo(np.int64).min


class Writer:
    """Writes one file; :meth:`add` may be called any number of times."""

    def __init__(self, uri: str):
        self.uri, self._out = uri, open_output(uri)
        self._out.write(MAGIC)
        self._rest = np.zeros(0, np.uint32)
        self._docs: list[np.ndarray] = []
        self._first = [np.zeros(1, np.int64)]
        self.n_words = self.n_tokens = self.n_docs = 0

    def _put(self, ids: np.ndarray) -> None:
        words, first = simple8b.encode(ids)
        self._out.write(words.astype("<u8").tobytes())
        self._first.append(first[1:] + self.n_words)
        self.n_words += len(words)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self._docs.append(np.stack([doc_ids, lengths], axis=1).astype("<i8"))
        self.n_docs += len(doc_ids)
        self.n_tokens += len(ids)
        ids = np.concatenate([self._rest, ids]) if len(self._rest) else ids
        whole = len(ids) // simple8b.BLOCK * simple8b.BLOCK
        if whole:
            self._put(ids[:whole])
        self._rest = ids[whole:].copy()

    def close(self) -> None:
        if len(self._rest):
            self._put(self._rest)
        first = np.concatenate(self._first).astype("<i8")
        for rows in self._docs:
            self._out.write(rows.tobytes())
        self._out.write(first.tobytes())
        self._out.write(np.array([self.n_words, self.n_docs, len(first) - 1, 0], "<i8").tobytes())
        self._out.close()


class Reader:
    """Reads one file: :attr:`doc_ids`, :attr:`lengths`, and ids by blocks or by document."""

    def __init__(self, uri: str):
        self._in = open_input(uri)
        size = self._in.size()
        if size < len(MAGIC) + 32 or self._in.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri}: not a token file")
        self.n_words, self.n_docs, self.n_blocks, _ = np.frombuffer(self._in.read_at(32, size - 32), "<i8").tolist()
        begin = len(MAGIC) + 8 * self.n_words
        if size != begin + 16 * self.n_docs + 8 * (self.n_blocks + 1) + 32:
            raise ValueError(f"{uri}: its lengths don't agree")
        rows = np.frombuffer(self._in.read_at(16 * self.n_docs, begin), "<i8").reshape(-1, 2)
        self.doc_ids, self.lengths = rows[:, 0], rows[:, 1]
        self.first = np.frombuffer(self._in.read_at(8 * (self.n_blocks + 1), begin + 16 * self.n_docs), "<i8")

    def blocks(self, a: int, b: int) -> np.ndarray:
        """The ids of blocks a to b."""
        lo, hi = int(self.first[a]), int(self.first[b])
        return simple8b.decode(np.frombuffer(self._in.read_at(8 * (hi - lo), len(MAGIC) + 8 * lo), "<u8")).astype(np.uint32)

    def ids(self, k: int) -> np.ndarray:
        """The ids of document k, from the blocks that hold them."""
        lo = int(self.lengths[:k].sum())
        hi = lo + int(self.lengths[k])
        a = lo // simple8b.BLOCK
        return self.blocks(a, -(-hi // simple8b.BLOCK))[lo - a * simple8b.BLOCK : hi - a * simple8b.BLOCK] if hi > lo else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[np.ndarray]:
        """Each document's ids in order, a few blocks in memory."""
        held, at, block = np.zeros(0, np.uint32), 0, 0
        for size in self.lengths.tolist():
            parts, have = [], len(held) - at
            while have < size:
                parts.append(held[at:])
                held, at = self.blocks(block, min(block + READ_BLOCKS, self.n_blocks)), 0
                block = min(block + READ_BLOCKS, self.n_blocks)
                size -= have
                have = len(held)
            parts.append(held[at : at + size])
            at += size
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)


def write(docs: DataFrame, folder: str, vocabulary: str, end: int = 0, file_tokens: int = FILE_TOKENS, slice_bytes: int = tokenizing.SLICE_BYTES) -> DataFrame:
    """Tokenize and write all documents; returns the manifest, a row per file: part, seq, file, n_docs, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, made, writer = TaskContext.get().partitionId(), 0, [], None
        encoder = tokenizing.encoder(vocabulary)
        for batch in batches:
            for piece in textbytes.slices(batch, "text", slice_bytes):
                ids, first = encoder.encode(piece.column("text"), end)
                names = np.asarray(piece.column("doc_id").fill_null(_NULL)).astype(np.int64)
                if writer is None:
                    writer = Writer(f"{folder}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.tok8b")
                writer.add(names, ids, np.diff(first))
                if writer.n_tokens >= file_tokens:
                    made.append((part, seq, writer))
                    writer.close()
                    writer, seq = None, seq + 1
        if writer is not None:
            writer.close()
            made.append((part, seq, writer))
        if made:
            yield pa.RecordBatch.from_pylist(
                [{"part": p, "seq": s, "file": w.uri, "n_docs": w.n_docs, "n_tokens": w.n_tokens} for p, s, w in made],
                pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    ranged = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return Scratch(docs.sparkSession, "token-manifest").cut(ordered.mapInArrow(run, MANIFEST), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids in all files before: sums within 1024 parts, then over those sums."""
    grouped = manifest.withColumn("__group", F.floor(F.col("part") / 1024))
    groups = grouped.groupBy("__group").agg(F.sum("n_tokens").alias("__all"))
    before = groups.select("__group", (F.sum("__all").over(Window.orderBy("__group")) - F.col("__all")).alias("__before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("__group").orderBy("part", "seq")) - F.col("n_tokens")
    return grouped.withColumn("__inner", inner).join(before, "__group").select(*manifest.columns, (F.col("__inner") + F.col("__before")).alias("start"))


def read(manifest: DataFrame) -> DataFrame:
    """A row per document, read from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["file"])
                lengths = reader.lengths
                if int(lengths.sum()) != row["n_tokens"] or len(lengths) != row["n_docs"]:
                    raise ValueError(f"{row['file']}: not what the manifest says")
                starts = row["start"] + np.cumsum(lengths) - lengths
                crc = np.fromiter((zlib.crc32(x.astype("<u4", copy=False)) for x in reader.documents()), np.int64, len(lengths))
                names = pa.array(reader.doc_ids.astype(np.int64), mask=reader.doc_ids == _NULL)
                out = pa.RecordBatch.from_arrays([names, pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                for at in range(0, out.num_rows, 50_000):
                    yield out.slice(at, 50_000)

    spark = manifest.sparkSession
    dealt = with_starts(manifest).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
