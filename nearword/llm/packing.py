"""Best-fit packing of token sequences, improved by swaps.

Sequences hold ``capacity`` tokens, so a piece's length is one of ``capacity`` values and a packing is
known from how many bins have which lengths in them. The plan is made on these counts: best-fit
decreasing, then a local search which exchanges one piece for one, two for one, or moves one, between
underfull bins, each time with a larger sum of squared fills, until bins empty. Its work and its memory
depend on ``capacity`` alone, not on how many documents there are. Spark then numbers the pieces of each
length and hands each its place.

Defined cases: a null or empty text is the end id alone. Repeated rows are packed one by one. Null ids
are kept. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearword.llm import textbytes, tokenizing
from nearword.llm.storage import Scratch

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows that are numbered together: pieces of one length are dealt to so many times fewer groups.
GROUP_ROWS = 50_000

#: A kind of bin: its lengths in descending order.
Bin = tuple[int, ...]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. Only documents over ``capacity`` are cut; their first piece takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizing.encoder(vocabulary)
        for batch in batches:
            for part in textbytes.slices(batch, "text", tokenizing.SLICE_BYTES):
                ids, first = encoder.encode(part.column("text"), end)
                lengths = np.diff(first)
                counts = -(-lengths // capacity)
                head = lengths - (counts - 1) * capacity
                owner = np.repeat(np.arange(len(lengths)), counts)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = np.where(number == 0, 0, head[owner] + (number - 1) * capacity)
                length = np.where(number == 0, head[owner], capacity)
                begin = first[owner] + start
                little = ids.astype("<u4", copy=False)
                crc = np.fromiter((zlib.crc32(little[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)), np.int64, len(owner))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()).take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Bin]:
    """Best-fit decreasing over all pieces: how many bins there are of each kind."""
    open_bins: dict[int, Counter[Bin]] = {}  # by room
    rooms: list[int] = []
    done: Counter[Bin] = Counter()

    def put(kind: Bin, n: int) -> None:
        room = capacity - sum(kind)
        if not room:
            done[kind] += n
        elif n:
            if room not in open_bins:
                open_bins[room] = Counter()
                insort(rooms, room)
            open_bins[room][kind] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                most = capacity // length
                if left >= most:
                    put((length,) * most, left // most)
                if left % most:
                    put((length,) * (left % most), 1)
                break
            room = rooms[k]
            kinds = open_bins[room]
            kind = min(kinds)
            each = room // length
            bins = min(kinds[kind], -(-left // each))
            kinds[kind] -= bins
            if not kinds[kind]:
                del kinds[kind]
                if not kinds:
                    del open_bins[room]
                    rooms.pop(k)
            full = min(bins, left // each)
            put(tuple(sorted(kind + (length,) * each, reverse=True)), full)
            if bins > full:
                put(tuple(sorted(kind + (length,) * (left - full * each), reverse=True)), bins - full)
            left -= min(left, bins * each)
    for kinds in open_bins.values():
        done.update(kinds)
    return +done


def _two(bin: Bin) -> list[tuple[int, Bin]]:
    """Pairs of a bin's pieces by their sum, one for each pair of lengths: a bin has few different ones, as they add up to its fill at most."""
    counts = Counter(bin)
    lengths = sorted(counts)
    return sorted({(x + y, (x, y)) for i, x in enumerate(lengths) for y in lengths[i:] if x < y or counts[x] > 1})


def _exchange(a: Bin, b: Bin, capacity: int) -> tuple[Bin, Bin] | None:
    """The exchange between a bin and one that is no fuller with which the first gets fullest; None if it gains nothing."""
    room = capacity - sum(a)
    best: tuple[int, Bin, Bin] | None = None
    give = [(0, ())] + [(x, (x,)) for x in sorted(set(a))]
    take = [(x, (x,)) for x in sorted(set(b))]
    two = _two(b)
    sums = [s for s, _ in take]
    for lost, out in give + _two(a):  # moves, one for one, two for one
        k = bisect_left(sums, lost + room + 1) - 1
        if k >= 0 and sums[k] > lost and (best is None or sums[k] - lost > best[0]):
            best = (sums[k] - lost, out, take[k][1])
    sums = [s for s, _ in two]
    for lost, out in give[1:]:  # one for two
        k = bisect_left(sums, lost + room + 1) - 1
        if k >= 0 and sums[k] > lost and (best is None or sums[k] - lost > best[0]):
            best = (sums[k] - lost, out, two[k][1])
    if best is None:
        return None
    first, second = list(a), list(b)
    for x in best[1]:
        first.remove(x)
        second.append(x)
    for x in best[2]:
        second.remove(x)
        first.append(x)
    return tuple(sorted(first, reverse=True)), tuple(sorted(second, reverse=True))


def local_search(bins: Counter[Bin], capacity: int) -> Counter[Bin]:
    """Exchanges between underfull bins until no bin can be saved or none gains.

    Each exchange makes the fuller bin of the two fuller, so the sum of squared fills rises and the search ends.
    """
    bins = Counter(bins)
    total = sum(sum(k) * n for k, n in bins.items())
    least = -(-total // capacity)
    while sum(bins.values()) > least:
        under = sorted((k for k in bins if sum(k) < capacity), key=lambda k: (-sum(k), k))
        gained = False
        for i, a in enumerate(under):
            for b in reversed(under[i:]):
                n = min(bins[a], bins[b]) if a != b else bins[a] // 2
                if not n:
                    continue
                if made := _exchange(a, b, capacity):
                    for kind, by in ((a, -n), (b, -n), (made[0], n), (made[1], n)):
                        if kind:
                            bins[kind] += by
                            if not bins[kind]:
                                del bins[kind]
                    gained = True
                if not bins[a]:
                    break
        if not gained:
            break
    return +bins


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Counter[Bin]:
    """How many bins of which kinds hold ``counts`` pieces of each length."""
    return local_search(best_fit(counts, capacity), capacity)


def places(bins: Counter[Bin]) -> dict[str, np.ndarray]:
    """Runs of pieces by (length, rank among that length): key, first sequence of the run, offset there. As many as kinds have pieces."""
    used: Counter[int] = Counter()
    keys, sequences, offsets = [], [], []
    base = 0
    for kind in sorted(bins, reverse=True):
        at = 0
        for length in kind:
            keys.append((length << 44) + used[length])
            sequences.append(base)
            offsets.append(at)
            used[length] += bins[kind]
            at += length
        base += bins[kind]
    order = np.argsort(np.array(keys, np.int64))
    return {"key": np.array(keys, np.int64)[order], "sequence": np.array(sequences, np.int64)[order], "offset": np.array(offsets, np.int64)[order]}


def numbered(cut: DataFrame, rows: int) -> DataFrame:
    """``cut`` with ``rank``, gapless from 0 among the pieces of one length, found in groups of about GROUP_ROWS rows."""
    groups = max(1, -(-rows // GROUP_ROWS))
    dealt = cut.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sizes = dealt.groupBy("length", "__group").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("length", "__group", (F.sum("__n").over(Window.partitionBy("length").orderBy("__group")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("length", "__group").orderBy("doc_id", "piece", "ids_crc32"))
    return dealt.withColumn("__inner", inner).join(before, ["length", "__group"]).withColumn("rank", F.col("__before") + F.col("__inner") - 1).drop("__group", "__before", "__inner")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = Scratch(docs.sparkSession, "packing").cut(pieces(docs, vocabulary, capacity, end), "pieces")
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = places(plan(counts, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.asarray(batch.column("rank")).astype(np.int64)
            key = (np.asarray(batch.column("length")).astype(np.int64) << 44) + rank
            k = np.searchsorted(table["key"], key, side="right") - 1
            sequence = table["sequence"][k] + key - table["key"][k]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(table["offset"][k])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = numbered(cut, sum(counts.values())).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
