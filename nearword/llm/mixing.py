"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall by hash into a fixed number of blocks of their source. A source's target is a number of
whole passes over its blocks and a remainder: blocks in the order of a seeded permutation until the
target is met, the last one cut between documents; one more document, the one nearest in size to
what is missing, closes the gap. What a source draws (blocks, repeats counted, the cut one and the closing
document among them at places of their own) is then split among the output shards by a binary tree over
words: each node gives its left half a multivariate hypergeometric share of the words that it has of each
source, so that the quotas add up exactly and shards are like samples without replacement. Every shard
takes the draws that fill its quota from the source's permuted ones, disjoint from the others', and is
shuffled by a hash in itself. A shard's words are its quotas' but for half a block of each source.

The driver holds the block table alone: sources x BLOCKS rows, whatever the number of documents. The
sources with their weights are the mixture's configuration and must be few enough for that. The table is
broadcast while it has at most BROADCAST_ROWS rows, else Spark plans the join.

Defined cases: a null source is a source of its own, the last. Null and empty texts have size 0, are in
the blocks of their source and add nothing to what is taken. Rows with one doc_id share block and order;
where a cut falls on them they are left out together. An empty table gives an empty mixture.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearword.llm import textbytes
from nearword.llm.storage import Scratch

WEIGHTS = (3.0, 1.0, 2.0)
BLOCKS = 1024
SHARDS = 16
#: The words of the mixture against those of the input, and how often a source may be repeated.
TOTAL, MOST_PASSES = 1.5, 2.0
SEED = 20

#: Rows of the block table that are broadcast, of at most 200 bytes each but for long names of sources.
BROADCAST_ROWS = 1 << 17
#: Units that the tree splits words in, at most.
UNITS = 1 << 24
#: A shard's order is written in so many runs, each a task's or less.
RUNS = 64

#: ``passes`` whole draws of a block go to ``shards``; what the cut and the closing document add, to a shard of its own.
TABLE = (
    "b_source string, b_block int, source_size long, target double, passes int, cut_key long, cut_id long, cut_size long, cut_shard int, "
    "close_id long, close_shard int, shards array<int>"
)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the number of words of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch, "text"):
                _, _, first = textbytes.word_bounds(*textbytes.string_buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("source"), pa.array(np.diff(first))], ["doc_id", "source", "size"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, size long")


def targets(own: Sequence[int], weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST_PASSES) -> list[float]:
    """Each source's words: by weight (taken in turn), at most ``most`` times its own, the excess shared by weight among the others."""
    weight = [weights[i % len(weights)] for i in range(len(own))]
    out, free, left = [0.0] * len(own), set(range(len(own))), total * sum(own)
    while free:
        unit = left / sum(weight[i] for i in free)
        above = [i for i in sorted(free) if weight[i] * unit > most * own[i]]
        if not above:
            for i in free:
                out[i] = weight[i] * unit
            break
        for i in above:
            out[i] = most * own[i]
            left -= out[i]
            free.discard(i)
    return out


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): how many of each source's units each shard gets; all sums are exact."""
    if shards <= 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    share = total * left // shards
    if total * left % shards and rng.random() < (total * left % shards) / shards:
        share += 1
    part = rng.multivariate_hypergeometric(counts, share, method="marginals")
    return np.concatenate([split(part, left, rng), split(counts - part, shards - left, rng)])


def _key(doc_id: Column, seed: int) -> Column:
    return F.xxhash64(doc_id, F.lit(seed))


def _block(doc_id: Column, seed: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(seed), F.lit("block")), F.lit(blocks)).cast("int")


def filled(words: list[np.ndarray], shards: int, seed: int) -> list[np.ndarray]:
    """The shard of each source's draws, which have so many words, in their order: by the tree's quotas of words."""
    words = [np.maximum(w, 1) for w in words]  # blocks without words are spread too
    own = np.array([int(w.sum()) for w in words], np.int64)
    unit = max(1, -(-int(own.sum()) // UNITS))
    counts = -(-own // unit)
    quotas = split(counts, shards, np.random.default_rng([seed, len(words)]))
    out = []
    for i, w in enumerate(words):
        ends = np.cumsum(quotas[:, i]) * (own[i] / max(1, counts[i]))
        out.append(np.minimum(np.searchsorted(ends, np.cumsum(w) - w / 2, side="right"), shards - 1))
    return out


def block_table(sized: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, shards: int = SHARDS, seed: int = SEED, blocks: int = BLOCKS) -> DataFrame:
    """A row per source and block: how often all of it is drawn, where its last draw is cut, and the shards its draws go to."""
    spark = sized.sparkSession
    blocked = sized.select("doc_id", "source", "size", _block(F.col("doc_id"), seed, blocks).alias("block"))
    found = blocked.groupBy("source", "block").agg(F.sum("size").alias("size")).collect()  # sources x blocks
    names = sorted({r["source"] for r in found if r["source"] is not None}) + [None] * any(r["source"] is None for r in found)
    if not names:
        return _frame(sized, [])
    at = {name: i for i, name in enumerate(names)}
    held = np.full((len(names), blocks), -1, np.int64)
    for r in found:
        held[at[r["source"]], r["block"]] = r["size"]
    own = np.where(held > 0, held, 0).sum(axis=1)
    aims = targets([int(x) for x in own], weights, total)

    draws, cuts = [], {}
    for i, name in enumerate(names):
        present = np.flatnonzero(held[i] >= 0)
        rng = np.random.default_rng([seed, i])
        passes = int(aims[i] // own[i]) if own[i] else 0
        rest = aims[i] - passes * own[i]
        order = [rng.permutation(present) for _ in range(passes + 1)]
        last = order.pop()
        whole = int(np.searchsorted(np.cumsum(held[i][last]), rest + 0.5, side="right")) if own[i] else 0
        draws.append(np.concatenate([*order, last[:whole]]).astype(np.int64))
        if own[i] and whole < len(last):
            cuts[name] = (int(last[whole]), int(rest - held[i][last[:whole]].sum() + 0.5))

    ends = _cut_ends(blocked, cuts, seed)
    table = {}
    for i, name in enumerate(names):
        passes = np.bincount(draws[i], minlength=blocks)
        for block in np.flatnonzero(held[i] >= 0).tolist():
            end = ends.get(name, (None,) * 4) if cuts.get(name, (None,))[0] == block else (None,) * 4
            table[name, block] = [name, block, int(own[i]), float(aims[i]), int(passes[block]), *end[:3], None, None, None, []]

    closing = _closing(blocked, _frame(sized, list(table.values())), seed, blocks)
    words, extras = [], []
    for i, name in enumerate(names):
        rng = np.random.default_rng([seed, i, 1])
        more = [("cut", cuts[name][0], ends[name][3])] if name in ends else []
        more += [("close", *closing[name][:2])] if name in closing else []
        places = np.sort(rng.integers(0, len(draws[i]) + 1, len(more)))
        words.append(np.insert(held[i][draws[i]], places, [n for _, _, n in more]))
        extras.append(list(zip((places + np.arange(len(more))).tolist(), more, strict=True)))
        if name in closing:
            table[name, closing[name][0]][9] = closing[name][2]
    for i, (name, shard) in enumerate(zip(names, filled(words, shards, seed), strict=True)):
        for place, (what, block, _) in extras[i]:
            table[name, block][8 if what == "cut" else 10] = int(shard[place])
        whole = np.delete(shard, [place for place, _ in extras[i]])
        for block, s in zip(draws[i].tolist(), whole.tolist(), strict=True):
            table[name, block][11].append(s)
    return _frame(sized, list(table.values()))


def _cut_ends(blocked: DataFrame, cuts: dict, seed: int) -> dict:
    """For each source whose last draw is cut, ``cuts``' (block, room): (key, id, size) of the last document that goes in, and the words that do. A row per source."""
    if not cuts:
        return {}
    frame = blocked.sparkSession.createDataFrame([(name, *c) for name, c in cuts.items()], "c_source string, c_block int, room long")
    rows = blocked.join(F.broadcast(frame), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("block") == F.col("c_block")))
    rows = rows.select("source", "size", "room", _key(F.col("doc_id"), seed).alias("key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    taken = F.sum("size").over(Window.partitionBy("source").orderBy("key", "id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = rows.withColumn("taken", taken).where("taken <= room").groupBy("source").agg(F.max(F.struct("key", "id", "size", "taken")).alias("last"))
    return {r["source"]: tuple(r["last"]) for r in last.collect()}


def _closing(blocked: DataFrame, table: DataFrame, seed: int, blocks: int) -> dict:
    """For each source that misses a word or more: (block, words, id) of the document outside its remainder that is nearest in size to what is missing."""
    decided = _decided(blocked.withColumn("__size", F.col("size")), table, seed, blocks)
    rest = decided.groupBy("source").agg(F.first("target").alias("aim"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("source_size").alias("all")).where("aim - taken >= 1")
    rest = rest.select(F.col("source").alias("r_source"), F.floor(F.col("aim") - F.col("taken")).alias("gap"), F.floor(F.col("aim") / F.col("all")).cast("int").alias("whole"))
    fits = decided.join(rest, F.col("source").eqNullSafe(F.col("r_source"))).where("doc_id IS NOT NULL AND size > 0 AND size < 2 * gap AND copies = whole")
    fits = fits.groupBy("source", "block", "doc_id", "gap").agg(F.sum("size").alias("size")).where("size < 2 * gap")
    nearest = F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.xxhash64("doc_id").alias("h"), "doc_id", "block", "size")).alias("best")
    return {r["source"]: (r["best"]["block"], r["best"]["size"], r["best"]["doc_id"]) for r in fits.groupBy("source").agg(nearest).collect()}


def _frame(near: DataFrame, rows: list) -> DataFrame:
    out = near.sparkSession.createDataFrame([tuple(r) for r in rows], TABLE).coalesce(1)
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


def _drawn(passes: Column, within_cut: Column) -> tuple[Column, Column]:
    """(copies, the shards of the copies) of a document that is in the cut draw or isn't."""
    closes = F.coalesce(F.col("doc_id") == F.col("close_id"), F.lit(False))
    extra = F.when(within_cut, F.array("cut_shard")).when(closes, F.array("close_shard")).otherwise(F.array().cast("array<int>"))
    return passes + (within_cut | closes).cast("int"), F.concat("shards", extra)


def _decided(rows: DataFrame, table: DataFrame, seed: int, blocks: int) -> DataFrame:
    """``rows``, which have doc_id, source and __size, with source_size, target, copies and draws."""
    block = _block(rows["doc_id"], seed, blocks)
    own = F.struct(_key(rows["doc_id"], seed).alias("a"), F.coalesce(rows["doc_id"], F.lit(-(1 << 63))).alias("b"), rows["__size"].alias("c"))
    last = F.struct(F.col("cut_key").alias("a"), F.col("cut_id").alias("b"), F.col("cut_size").alias("c"))
    met = rows.join(table, rows["source"].eqNullSafe(F.col("b_source")) & (block == F.col("b_block")))
    copies, draws = _drawn(F.col("passes"), F.col("cut_key").isNotNull() & (own <= last))
    return met.withColumns({"copies": copies, "draws": draws})


def decide(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, shards: int = SHARDS, seed: int = SEED, blocks: int = BLOCKS) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies, taken, draws (the shards of its copies) and orders (their places there)."""
    sized = Scratch(docs.sparkSession, "mixing").cut(sizes(docs), "sizes")
    table = block_table(sized, weights, total, shards, seed, blocks)
    out = _decided(sized.withColumn("__size", F.col("size")), table, seed, blocks)
    orders = F.transform("draws", lambda _, copy: _order(F.col("doc_id"), copy, seed))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "draws", orders.alias("orders"))


def _order(doc_id: Column, copy: Column, seed: int) -> Column:
    return F.xxhash64(doc_id, copy, F.lit(seed))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, shards: int = SHARDS, seed: int = SEED, blocks: int = BLOCKS) -> DataFrame:
    """The mixture: ``docs`` with all its columns, a row as often as it is taken, and mix_shard and mix_order; see :func:`in_order`."""
    sized = Scratch(docs.sparkSession, "mixing").cut(sizes(docs), "sizes")
    table = block_table(sized, weights, total, shards, seed, blocks)
    packed = docs.select(F.struct(*docs.columns).alias("__row")).select("__row", F.col("__row.doc_id").alias("doc_id"), F.col("__row.source").alias("source"))
    met = packed.join(table, F.col("source").eqNullSafe(F.col("b_source")) & (_block(F.col("doc_id"), seed, blocks) == F.col("b_block")))
    # only the order of documents with one id depends on their size; words are counted there alone
    words = F.regexp_count(F.coalesce(F.col("__row.text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    same = F.struct(_key(F.col("doc_id"), seed).alias("a"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("b"))
    last = F.struct(F.col("cut_key").alias("a"), F.col("cut_id").alias("b"))
    within = F.when(F.col("cut_key").isNull(), False).when(same == last, words <= F.col("cut_size")).otherwise(same < last)
    met = met.withColumn("__within", within)
    each = met.select("__row", "doc_id", F.posexplode(_drawn(F.col("passes"), F.col("__within"))[1]).alias("copy", "mix_shard"))
    return each.select(*[F.col("__row")[c].alias(c) for c in docs.columns], "mix_shard", _order(F.col("doc_id"), F.col("copy"), seed).alias("mix_order"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The mixture dealt out by shard and run of its order, and sorted by them: files hold runs of shuffled shards, of RUNS a shard or fewer."""
    run = F.shiftrightunsigned("mix_order", 64 - RUNS.bit_length() + 1)
    return mixed.withColumn("__run", run).repartition("mix_shard", "__run").sortWithinPartitions("mix_shard", "mix_order").drop("__run")
