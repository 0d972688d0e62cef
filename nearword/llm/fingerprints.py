"""Document fingerprints by MinHash, and the documents that they bring together.

A fingerprint has one byte for each of 128 hash permutations: eight bits of a hash of the smallest value
among the text's distinct shingles of five words. Two fingerprints' share of equal bytes, corrected for
bytes that agree by chance, estimates the Jaccard similarity of the two sets. Bands of the smallest values
are joined in Spark, and what meets is verified by the Jaccard similarity of the full sets, 0.8 or more:
:func:`similar` has the components of these links.

Defined cases: null, empty and blank texts have a fingerprint of zeros, alike among themselves, and are
linked with nothing. A text of fewer than five words is one shingle. Null ids come first in the order of
documents; rows with one id are in order of their text's hash. The only document of a table is its own next.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearword.llm import idfilter, near_dup, textbytes
from nearword.llm.storage import Scratch

SHINGLE = 5
PERMUTATIONS = 128
#: Similar documents meet in 25 bands of 5 values: at a similarity of 0.8 one pair in 20,000 doesn't, above it fewer.
RULE = near_dup.Rule(n=SHINGLE, bands=25, rows=5, paired=False)
#: How texts are packed while they are dealt out, as lists of which most bytes would be text.
LEVEL = 3
PACKED = "doc_id long, place long, n_bytes long, packed binary"

COMPARED = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def fingerprints(texts: pa.Array, n: int = SHINGLE, permutations: int = PERMUTATIONS) -> np.ndarray:
    """(texts, permutations) uint8."""
    hashes, first = textbytes.distinct_shingles(texts, n)
    full = np.diff(first) > 0
    out = np.zeros((len(full), permutations), np.uint8)
    if full.any():
        least = near_dup.signatures(hashes, np.append(first[:-1][full], first[-1]), permutations, paired=False)
        mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[full] = (mixed >> np.uint32(24)).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated similarity of fingerprints row by row, 0 to 1."""
    equal = (a == b).mean(axis=1)
    return np.clip((equal - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each document, in hexadecimal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([r.tobytes().hex() for r in fingerprints(part.column("text"))], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def similar(docs: DataFrame, rule: near_dup.Rule = RULE) -> DataFrame:
    """Documents brought together by bands and verified by the Jaccard similarity of their full sets.

    A row per document: doc_id, n_shingles, component_id, kept, and set_rep, the smallest id with an equal set.
    """
    return near_dup.near_duplicates(docs, rule)


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many of the start of the next one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compare(names: list, texts: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    other = fingerprints(pa.array(changed, pa.large_string()))
    return [
        pa.array(names, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(c.encode()).digest() for c in changed], pa.binary()),
        pa.array([r.tobytes() for r in prints], pa.binary()),
        pa.array([r.tobytes() for r in other], pa.binary()),
        pa.array(likeness(prints, other)),
        pa.array(likeness(prints, next_prints)),
    ]


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, place, n_bytes, packed) of each document: hash of its text, length and Zstandard frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in textbytes.slices(batch, "text"):
                data, offsets = textbytes.string_buffers(part.column("text"))
                view = memoryview(np.ascontiguousarray(data))
                frames = [compressor.compress(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("place"), pa.array(np.diff(offsets)), pa.array(frames, pa.binary())], ["doc_id", "place", "n_bytes", "packed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("place"), "text").mapInArrow(run, PACKED)


def unpacked(batch: pa.RecordBatch, size: int = textbytes.SLICE_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of a batch of packed rows, in runs of about ``size`` bytes of text."""
    reader = zstandard.ZstdDecompressor()
    ends = np.concatenate([[0], np.cumsum(np.asarray(batch.column("n_bytes")))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        part = batch.slice(at, to - at)
        yield part.column("doc_id").to_pylist(), [reader.decompress(x.as_buffer()).decode() if n else "" for x, n in zip(part.column("packed"), part.column("n_bytes").to_pylist(), strict=True)]
        at = to
    textbytes.release()


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of the documents that verified links join with a smaller id; an id with several texts once, by its smallest component."""
    return similar(docs).where("component_id < doc_id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document in order of doc_id, with component_id of :func:`similar`.

    Documents are dealt out by ranges of doc_id, their texts packed, so that all but a range's last meet the
    next in their own task. The first and the last document of each range, two rows a task, are matched in a
    second step. Components are looked up for documents alone that may have another's.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    joined = scratch.cut(linked(docs), "linked")
    maybe, alone = idfilter.parted(_compared(docs, scratch), "doc_id", joined, "doc_id")
    found = maybe.join(joined, "doc_id", "left").select(*maybe.columns, F.coalesce("component_id", "doc_id").alias("component_id"))
    return alone.withColumn("component_id", F.col("doc_id")).unionByName(found)


def _compared(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """:func:`compared` without component_id."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    schema = pa.schema([*zip(names, kinds, strict=True), ("edge", pa.int32()), ("part", pa.int64()), ("text", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def mark(name, text: str, edge: int) -> pa.RecordBatch:
            ends = [pa.array([edge], pa.int32()), pa.array([part], pa.int64()), pa.array([text], pa.large_string())]
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *(pa.nulls(1, k) for k in kinds[1:]), *ends], schema=schema)

        for batch in batches:
            for ids, texts in unpacked(batch):
                prints = fingerprints(pa.array(texts, pa.large_string()))
                if held is None:
                    yield mark(ids[0], texts[0], 1)
                else:
                    ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], prints])
                held = ids[-1], texts[-1], prints[-1:]
                if len(ids) > 1:
                    columns = _compare(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
                    n = len(ids) - 1
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int64)), pa.nulls(n, pa.large_string())], schema=schema)
        if held is not None:
            yield mark(held[0], held[1], 2)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textbytes.slices(batch, "text"):
                texts, following = piece.column("text").to_pylist(), piece.column("following").to_pylist()
                prints, others = (fingerprints(pa.array(x, pa.large_string())) for x in (texts, following))
                yield pa.RecordBatch.from_arrays(_compare(piece.column("doc_id").to_pylist(), texts, following, prints, others), names)

    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    ranged = packed(docs).repartitionByRange(order[0]).sortWithinPartitions(*order)
    out = scratch.cut(ranged.mapInArrow(run, f"{COMPARED}, edge int, part long, text string"), "compared")
    parts = sorted(r[0] for r in out.where("edge = 1").select("part").collect())  # as many as there are tasks
    shown = [F.lower(F.hex(n)).alias(n) if k == pa.binary() else F.col(n) for n, k in zip(names, kinds, strict=True)]
    if not parts:
        return out.select(*shown)
    pairs = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, other long")
    heads = out.where("edge = 1").select(F.col("part").alias("other"), F.col("text").alias("following"))
    ends = out.where("edge = 2").select("doc_id", "part", "text").join(pairs, "part").join(heads, "other").select("doc_id", "text", "following")
    return out.where("edge = 0").select(*names).union(ends.mapInArrow(last, COMPARED)).select(*shown)
