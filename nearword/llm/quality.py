"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Tokens are runs of letters and digits and runs of other signs. Counted are hashed unigrams and bigrams of
tokens, and hashed bigrams of their shapes: a word's shape is how it uses capitals and digits, a sign is its
own, and a token after itself makes a bigram of its own. The target model is made of texts labelled good,
the raw one of all documents. The log ratio of the two, per token, times ``TOKENS`` is a document's log
importance weight: that of so many tokens of its kind, so that long texts are not certain by their length
and the noise decides between close ones. Adding Gumbel noise to it, a function of the id, and taking the k
largest draws k documents without replacement in proportion to their weights.

``k`` is a budget: as many documents as good ones are to be expected, which is all documents times the share
of good ones among labelled documents and two of its standard errors; or a share that the caller gives. The
k-th largest key is found exactly by counting digits of the keys, 65,536 counts a pass, so nothing is
sorted and no task or driver holds the documents. Weights are integers (in units of 2**-20), so that every
pass finds the same keys.

Defined cases: null and empty texts have no n-grams and a weight of 0. Null ids have noise of their own,
alike among themselves. Rows with one id and one text have one key and are taken or left together, with
which more than k rows may be taken. Without labelled texts of both kinds all rows are taken. An empty
table gives an empty result. Other columns are carried through by :func:`selected`.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearword.llm import labelled, textbytes
from nearword.llm.storage import Scratch

log = logging.getLogger(__name__)

#: Hash buckets of each of the three kinds of n-grams.
FAMILY = 1 << 12
BUCKETS = 3 * FAMILY
UNIT = 1 << 20
#: Good texts that the target model is fitted on at most, whatever their length: executors count them.
SAMPLE = 3000
#: Pseudo-counts that the target model takes from the raw one, for each of its own.
PRIOR = 0.3
#: A document's weight is that of so many tokens of its kind: the higher, the less the noise decides.
TOKENS = 10
#: Standard errors of the labels' share of good documents that the budget has on top of it.
MARGIN = 2.0
SEED = 3
#: Tasks that add up the counts of all tasks.
SUMS = 16

_KIND = np.full(256, 2, np.uint8)
_KIND[textbytes.SPACES] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER, _DIGIT = np.zeros(256, np.int32), np.zeros(256, np.int32)
_UPPER[65:91], _DIGIT[48:58] = 1, 1
_REPEAT = np.uint64(0x5EED)
_NULL_ID = np.int64(-(1 << 63))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token's unigram, bigram and bigram of shapes, first): three in turn for each token."""
    data, offsets = textbytes.string_buffers(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    new = np.empty(n, bool)
    new[0], new[1:] = True, kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    at = np.flatnonzero(new)
    ends = np.append(at[1:], n)
    token = kind[at] > 0
    starts, ends = at[token], ends[token]
    first = np.searchsorted(starts, offsets)
    hashes = textbytes.range_hashes(data, starts, ends, folded=False)
    sums = [np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)]) for table in (_UPPER, _DIGIT)]
    upper, digit = (x[ends] - x[starts] for x in sums)
    size = ends - starts
    shape = np.where(digit > 0, 4 + (digit == size), np.where(upper == 0, 1, np.where(upper == 1, 2, np.where(2 * upper > size, 3, 6)))).astype(np.uint64)
    shape = np.where(kind[starts] == 2, hashes, shape)
    before, last = np.empty_like(shape), np.empty_like(hashes)
    before[1:], last[1:] = shape[:-1], hashes[:-1]
    heads = first[:-1][np.diff(first) > 0]
    before[heads], last[heads] = 0, 0
    odd = np.uint64(0x9E3779B97F4A7C15)
    pair = textbytes.mix64(hashes * odd + last)
    of_shapes = np.where(hashes == last, _REPEAT, textbytes.mix64(shape * odd + before))
    mask = np.uint64(FAMILY - 1)
    kinds = [(values & mask) + np.uint64(i * FAMILY) for i, values in enumerate((hashes, pair, of_shapes))]
    return np.stack(kinds, axis=1).reshape(-1).astype(np.int64), 3 * first


@dataclass
class Model:
    """``ratio``: each bucket's log ratio in units; ``share``: of the documents that are drawn, None for all."""

    ratio: np.ndarray
    share: float | None


def weights(texts: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """Each text's log importance weight, in units: its n-grams' log ratio per token, times TOKENS."""
    buckets, first = grams(texts)
    reach = np.concatenate([[0], np.cumsum(ratio[buckets])])
    return np.rint((reach[first[1:]] - reach[first[:-1]]) * (3 * TOKENS) / np.maximum(np.diff(first), 1)).astype(np.int64)


def noise(ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Gumbel noise of each id."""
    u = (textbytes.mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(12)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / (1 << 52)))


def keys(weight: np.ndarray, ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Weight and noise in units: an integer that orders like their sum."""
    return weight + np.rint(noise(ids, seed) * UNIT).astype(np.int64)


def raw_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all of ``docs``: a row of counts for each task, added up in SUMS tasks, whose rows the driver adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in textbytes.slices(batch, "text"):
                counts += np.bincount(grams(part.column("text"))[0], minlength=BUCKETS)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["sum", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for row in batch.column("counts"):
                total += np.frombuffer(row.as_buffer(), np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    parts = docs.select("text").mapInArrow(run, "sum int, counts binary").repartition(SUMS, "sum")
    return sum((np.frombuffer(r[0], np.int64) for r in parts.select("counts").mapInArrow(add, "counts binary").collect()), np.zeros(BUCKETS, np.int64))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labels 0 and 1, each once."""
    return labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()


def labelled_share(docs: DataFrame, labels: DataFrame, margin: float = MARGIN) -> float | None:
    """The share of good ones among all labelled documents and ``margin`` standard errors; None without both kinds."""
    there = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    n = dict(known_labels(labels).join(there, "doc_id", "left_semi").groupBy("quality").count().collect())
    good, bad = n.get(1, 0), n.get(0, 0)
    if not good or not bad:
        log.warning("labelled texts: %d good, %d bad; without both kinds all documents are taken", good, bad)
        return None
    share = good / (good + bad)
    return min(1.0, share + margin * (share * (1 - share) / (good + bad)) ** 0.5)


def sample(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, text) of good texts, SAMPLE at most, by hash of id."""
    rows = labelled.chosen(docs, known_labels(labels).where("quality = 1"), "quality", SAMPLE, seed)
    parts = [(r["doc_id"], r["h"]) for r in rows]
    return labelled.texts_of(docs, docs.sparkSession.createDataFrame(parts, "doc_id long, h long"))


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Each bucket's log ratio of the target model to the raw one, in units; 0 for buckets that no document has."""
    share, most = raw / max(raw.sum(), 1), prior * max(target.sum(), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log((target + most * share) / (target.sum() + most)) - np.log(share)
    return np.where(raw > 0, np.rint(np.nan_to_num(ratio, nan=0.0, posinf=0.0, neginf=0.0) * UNIT), 0).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, share: float | None = None) -> Model:
    """The models' ratio and the budget; ``share`` of the documents, else as labels let expect."""
    found = labelled_share(docs, labels)
    if found is None:
        return Model(np.zeros(BUCKETS, np.int64), share)
    return Model(log_ratios(raw_counts(docs), raw_counts(sample(docs, labels))), found if share is None else share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, log_weight, key (in units)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch, "text"):
                weight = weights(part.column("text"), model.ratio)
                ids = part.column("doc_id").cast(pa.int64())
                key = keys(weight, np.asarray(ids.fill_null(int(_NULL_ID))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(weight), pa.array(key)], ["doc_id", "weight", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, weight long, key long")


def kth_largest(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """(the k-th largest value of a long column, how many of the rows with that value are among the k)."""
    prefix = 0
    for shift in (48, 32, 16, 0):
        value: Column = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
        within = rows if shift == 48 else rows.where(F.shiftrightunsigned(value, shift + 16) == prefix)
        digit = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(0xFFFF))
        for d, n in sorted(within.groupBy(digit.alias("digit")).count().collect(), reverse=True):
            if n >= k:
                prefix = prefix << 16 | d
                break
            k -= n
    return prefix - (1 << 63), k


@dataclass
class Choice:
    """A row is taken if its key is above ``key``, or equal and its id is at most ``doc_id`` (None: every id)."""

    key: int
    doc_id: int | None = None


def choose(rows: DataFrame, model: Model) -> Choice:
    """The Gumbel top-k of scored rows, k being the budget."""
    if model.share is None:
        return Choice(-(1 << 63))
    n = rows.count()
    k = min(n, math.ceil(n * model.share))
    if not k:
        return Choice((1 << 63) - 1, -(1 << 63))
    key, need = kth_largest(rows, "key", k)
    ties = rows.where(F.col("key") == key).select((-F.coalesce(F.col("doc_id"), F.lit(-(1 << 62)))).alias("id"))
    if ties.count() <= need:
        return Choice(key)
    return Choice(key, -kth_largest(ties, "id", need)[0])


def sampled(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The documents that are taken: doc_id, log_weight, key."""
    model = fit(docs, labels, share)
    rows = Scratch(docs.sparkSession, "quality").cut(scored(docs, model), "scored")
    choice = choose(rows, model)
    taken = (F.col("key") > choice.key) | (F.col("key") == choice.key) & (F.lit(True) if choice.doc_id is None else F.coalesce(F.col("doc_id") <= choice.doc_id, F.lit(True)))
    return rows.where(taken).select("doc_id", (F.col("weight") / UNIT).alias("log_weight"), (F.col("key") / UNIT).alias("key"))


def selected(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are taken, with all their columns: a filter as the table streams by, without a shuffle."""
    model = fit(docs, labels, share)
    choice = choose(Scratch(docs.sparkSession, "quality").cut(scored(docs, model), "scored"), model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch, "text", 4 << 20):
                ids = np.asarray(part.column("doc_id").cast(pa.int64()).fill_null(int(_NULL_ID)))
                key = np.concatenate([keys(weights(p.column("text"), model.ratio), np.asarray(p.column("doc_id").cast(pa.int64()).fill_null(int(_NULL_ID)))) for p in textbytes.slices(part, "text")])
                taken = (key > choice.key) | (key == choice.key) & (True if choice.doc_id is None else ids <= choice.doc_id)
                yield part.filter(pa.array(taken))

    return docs.mapInArrow(run, docs.schema)
