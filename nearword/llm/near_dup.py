"""Near-duplicate documents by min-max hashing, and the same job by plain MinHash bands.

A document's set is its distinct shingles of ``n`` words (A-Z lower-cased). Under each permutation both the
smallest and the largest value are kept, so ``bands * rows`` signature values take half as many hash
evaluations; the two are equal between documents with probability J each, hence unbiased, and as they
hardly agree by the same chance the estimate varies less than with one value. Bands are of minima of
different permutations or of maxima of different ones, so a pair of similarity J misses all bands with
probability (1 - J**rows)**bands at most: 5e-6 at J = 0.8 by default.

Links are exact: each is confirmed on the two full sets. The steps:

1. Documents with equal sets are one class, represented by its smallest id; copies never meet as pairs.
2. Class representatives are dealt to buckets by band. Of each bucket with two or more, one member, the
   pivot, is compared with all others: linear in the bucket, whatever its size.
3. Components of the confirmed links. In buckets whose members are of several components yet, those outside
   the largest are compared with random members of it, one in each of a few buckets, and components are found
   anew; that leaves documents that have no link to most of their bucket.
4. These are compared with all members of other components in their buckets, which makes the result exact;
   a bucket's largest component is only met, never joined with itself, and a pair is formed in the first of
   the buckets that it shares alone. Members of a large bucket are met in chunks of CHUNK_ROWS, each a key of
   its own, so no task gets a bucket whole.

Before texts are fetched, pairs whose set sizes exclude the threshold are left out, and those whose sketches
(two bits of each signature value) agree in fewer places than a pair at the threshold does but once in
10**6. For the last step, sketches have one bit of 6144 values: they leave out pairs below about J = 0.76, so
what is formed and verified are links and close misses. ``Rule.sketched`` = False goes without sketches.

Defined cases: null, empty and blank texts have the empty set and are linked with nothing. A text of fewer
than ``n`` words is one shingle. A null ``doc_id`` is returned with a null component and kept. An id
that represents several classes joins them: links are found and confirmed by each of its texts.
An empty table gives an empty result. Other columns are ignored by :func:`near_duplicates` and carried through by :func:`kept_rows`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearword.llm import idfilter, textbytes
from nearword.llm.components import components
from nearword.llm.storage import Scratch

#: Elements of sets that are hashed at once, so that they stay in a core's cache.
CHUNK = 1 << 15


@dataclass(frozen=True)
class Rule:
    """Shingle length, threshold as a ratio of integers, and the banding.

    ``paired``: minima and maxima, else minima of twice as many permutations. ``sketched``: whether pairs are
    left out by sketches before their texts are fetched.
    """

    n: int = 5
    over: int = 80
    of: int = 100
    bands: int = 40
    rows: int = 6
    paired: bool = True
    sketched: bool = True

    @property
    def permutations(self) -> int:
        return self.bands * self.rows // (2 if self.paired else 1)

    def sketch_limit(self, values: int, bits: int) -> int:
        """Values in which sketches of so many bits a value may differ: the mean at the threshold and 4.75 standard deviations."""
        differ = (1 - 2.0**-bits) * (1 - self.over / self.of)
        return int(values * differ + 4.75 * (values * differ * (1 - differ)) ** 0.5)


#: Values of the sketches for the last step, one bit each; others have two.
FINE = 6144
#: Members of a bucket that one task meets with a stray document.
CHUNK_ROWS = 4096
#: How many random members of its buckets' largest components a stray document is compared with.
TRIES = 16


def affine(permutations: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the permutations x -> a x + b modulo 2**32."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, permutations, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, permutations, np.uint64).astype(np.uint32)


def signatures(hashes: np.ndarray, first: np.ndarray, permutations: int, paired: bool = True) -> np.ndarray:
    """(sets, values) uint32: each set's minima under the permutations, then, if ``paired``, its maxima. Sets must not be empty."""
    a, b = affine(permutations)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((permutations * (1 + paired), len(first) - 1), np.uint32)
    at = 0
    while at < len(first) - 1:
        to = max(at + 1, int(np.searchsorted(first, first[at] + CHUNK, side="right")) - 1)
        part, begins = low[first[at] : first[to]], first[at:to] - first[at]
        work = np.empty_like(part)
        for i in range(permutations):
            np.multiply(part, a[i], out=work)
            np.add(work, b[i], out=work)
            np.minimum.reduceat(work, begins, out=out[i, at:to])
            if paired:
                np.maximum.reduceat(work, begins, out=out[permutations + i, at:to])
        at = to
    return out.T


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) int64: a hash of each band's number and values."""
    out = np.empty((len(signature), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(signature), band + 1, np.uint64)
        for value in range(band * rows, (band + 1) * rows):
            key = textbytes.mix64(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, value].astype(np.uint64))
        out[:, band] = key
    return out.view(np.int64)


def sketches(signature: np.ndarray, bits: int) -> np.ndarray:
    """(sets, longs) int64: one or two bits of a hash of each signature value, packed."""
    mixed = (signature ^ (signature >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    each = 64 // bits
    longs = -(-signature.shape[1] // each)
    padded = np.zeros((len(signature), longs * each), np.uint64)
    padded[:, : signature.shape[1]] = mixed >> np.uint32(32 - bits)
    shifted = padded.reshape(len(signature), longs, each) << (bits * np.arange(each, dtype=np.uint64))
    return np.bitwise_or.reduce(shifted, axis=2).view(np.int64)


def signed(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch) of each document; the last three null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch, "text"):
                hashes, first = textbytes.distinct_shingles(part.column("text"), rule.n)
                counts = np.diff(first)
                full = counts > 0
                keys = [hashlib.blake2b(hashes[a:b], digest_size=16).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                signature = signatures(hashes, np.append(first[:-1][full], first[-1]), rule.permutations, rule.paired)
                bands, sketch = band_keys(signature, rule.bands, rule.rows), sketches(signature, 2)
                lists = []
                for values in (bands, sketch):
                    width = values.shape[1]
                    offsets = np.concatenate([[0], np.cumsum(np.where(full, width, 0))]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~full, False)), pa.array(values.reshape(-1))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(keys, pa.binary()), *lists], ["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


def longs_of(values: int, bits: int) -> int:
    """How many longs a sketch has."""
    return -(-values * bits // 64)


def possible(rule: Rule, values: int, bits: int) -> Column:
    """Whether sizes (n, m) and sketches (s.., t..) of a pair leave it possible that it reaches the threshold."""
    few, many = F.least("n", "m"), F.greatest("n", "m")
    sizes = few * rule.of >= many * rule.over
    if not rule.sketched:
        return sizes
    differ = F.lit(0)
    for i in range(longs_of(values, bits)):
        x = F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))
        differ = differ + F.bit_count(x if bits == 1 else x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return sizes & (differ <= rule.sketch_limit(values, bits))


def detailed(texts: DataFrame, rule: Rule) -> DataFrame:
    """(rep, m, t.., v..) of each text but those with the empty set: its set's size, FINE sketch, and halves of its band keys, two in a long."""
    longs, halves = longs_of(FINE, 1), -(-rule.bands // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch, "text"):
                hashes, first = textbytes.distinct_shingles(part.column("text"), rule.n)
                full = np.diff(first) > 0  # an id with a full text may have an empty one too
                first = np.append(first[:-1][full], first[-1])
                fine = sketches(signatures(hashes, first, FINE // 2, True), 1)
                keys = band_keys(signatures(hashes, first, rule.permutations, rule.paired), rule.bands, rule.rows).view(np.uint64) >> np.uint64(32)
                padded = np.zeros((len(keys), 2 * halves), np.uint64)
                padded[:, : rule.bands] = keys
                packed = (padded[:, ::2] << np.uint64(32) | padded[:, 1::2]).view(np.int64)
                columns = [part.column("doc_id").cast(pa.int64()).filter(pa.array(full)), pa.array(np.diff(first)), *(pa.array(c) for c in fine.T), *(pa.array(c) for c in packed.T)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["rep", "m", *(f"t{i}" for i in range(longs)), *(f"v{i}" for i in range(halves))]
    return texts.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def first_shared(rule: Rule) -> Column:
    """Whether no band before ``band`` is equal too: a pair (u.., v..) is formed in the first bucket it shares."""
    out = F.lit(True)
    for j in range(rule.bands):
        x = F.col(f"u{j // 2}").bitwiseXOR(F.col(f"v{j // 2}"))
        half = F.shiftrightunsigned(x, 32) if j % 2 == 0 else x.bitwiseAND(F.lit(0xFFFFFFFF))
        out = out & ((F.col("band") <= j) | (half != 0))
    return out


def confirmed(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of doc_ids in ``texts`` whose full sets reach the threshold, with ``shared`` and ``united`` sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in textbytes.slices(batch, "text_b"):
                theirs, first = textbytes.distinct_shingles(part.column("text_b"), rule.n)
                left, right = np.asarray(part.column("a")), np.asarray(part.column("b"))
                rows = []
                for k in range(part.num_rows):
                    own = part.column("text_a")[k].as_py()
                    if held != (left[k], own):  # an id may have several texts
                        held, mine = (left[k], own), textbytes.distinct_shingles(part.column("text_a").slice(k, 1), rule.n)[0]
                    other = theirs[first[k] : first[k + 1]]
                    small, large = (mine, other) if len(mine) <= len(other) else (other, mine)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    shared = int((large[at] == small).sum()) if len(large) else 0
                    united = len(mine) + len(other) - shared
                    if shared * rule.of >= united * rule.over and shared:
                        rows.append((int(left[k]), int(right[k]), shared, united))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", "shared", "united"])

    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, shared long, united long")


def unsettled_members(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, band, rep, label, main, k, chunks) of the buckets with several components: main is the largest and k its size there."""
    placed = members.select("bucket", "band", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "band", "rep", F.coalesce("label", "rep").alias("label"))
    counts = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = counts.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("most"), F.count(F.lit(1)).alias("labels"), F.sum("k").alias("all")).where("labels > 1")
    chunks = F.ceil(F.col("all") / CHUNK_ROWS).cast("int").alias("chunks")
    return scratch.cut(placed.join(mixed.select("bucket", F.col("most.label").alias("main"), F.col("most.k").alias("k"), chunks), "bucket"), "unsettled")


def chunk() -> Column:
    """Which of its bucket's chunks a member is in."""
    return F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk")


def every_chunk() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")


def links(reps: DataFrame, docs: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """All links (a, b) that join components, between representatives (rep, n, bands, sketch), a row per set; not all links inside one."""
    values = rule.bands * rule.rows
    longs = range(longs_of(values, 2))
    nodes = scratch.cut(reps.select("rep", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in longs]), "nodes")
    left = nodes.withColumnRenamed("rep", "a")
    right = nodes.select(F.col("rep").alias("b"), F.col("n").alias("m"), *[F.col(f"s{i}").alias(f"t{i}") for i in longs])
    every = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    shared = every.groupBy("bucket").agg(F.min(F.xxhash64("rep")).alias("pivot"), F.max(F.xxhash64("rep")).alias("__last")).where("pivot != __last").drop("__last")
    members = scratch.cut(every.join(shared, "bucket"), "members")  # buckets of two or more, each row with its pivot's hash
    wanted = scratch.cut(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    maybe, _ = idfilter.parted(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", wanted, "doc_id")
    texts = scratch.cut(maybe.join(wanted, "doc_id", "left_semi"), "texts")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    asked: list[DataFrame] = []

    def tried(pairs: DataFrame) -> DataFrame:
        if asked:
            pairs = pairs.join(reduce(DataFrame.union, asked), ["a", "b"], "left_anti")
        asked.append(scratch.cut(pairs, "asked"))
        return scratch.cut(confirmed(asked[-1], texts, rule), "links").select("a", "b")

    pivots = nodes.select(F.col("rep").alias("a"), F.xxhash64("rep").alias("pivot")).distinct()
    star = ordered(members.select(F.col("rep").alias("b"), "pivot").distinct().join(pivots, "pivot").select("a", "b"))
    found = tried(star.join(left, "a").join(right, "b").where(possible(rule, values, 2)).select("a", "b").distinct())
    unsettled = unsettled_members(members, components(found, scratch), scratch)
    partner = unsettled.where("label = main AND k > 1").groupBy("bucket", "chunks").agg(F.min_by("rep", F.xxhash64("rep", "bucket")).alias("b")).select("bucket", "b", every_chunk())
    strays = unsettled.where("label != main AND k > 1").select("bucket", F.col("rep").alias("a"), chunk()).join(partner, ["bucket", "chunk"])
    turn = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("bucket")))
    some = ordered(strays.withColumn("turn", turn).where(F.col("turn") <= TRIES).select("a", "b"))
    more = tried(some.join(left, "a").join(right, "b").where(possible(rule, values, 2)).select("a", "b").distinct())
    if not more.isEmpty():
        found = found.union(more)
        unsettled = unsettled_members(members, components(found, scratch), scratch)
    left_over = texts.join(unsettled.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    wide = unsettled.drop("k").join(scratch.cut(detailed(left_over, rule), "detailed"), "rep")
    own = {"rep": "a", "m": "n"} | {f"t{i}": f"s{i}" for i in range(longs_of(FINE, 1))} | {f"v{i}": f"u{i}" for i in range(-(-rule.bands // 2))}
    one = wide.where("label != main").select("*", every_chunk()).drop("chunks").withColumnsRenamed(own)
    two = wide.select("*", chunk()).drop("band", "main", "chunks").withColumnsRenamed({"rep": "b", "label": "other"})
    once = (F.col("label") != F.col("other")) & ((F.col("other") == F.col("main")) | (F.col("a") < F.col("b")))
    rest = ordered(one.join(two, ["bucket", "chunk"]).where(once & possible(rule, FINE, 1) & first_shared(rule)).select("a", "b"))
    return found.union(tried(rest))


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id), set_rep (its class)."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    signs = scratch.cut(signed(docs, rule), "signed")
    full = signs.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = scratch.cut(full.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes, ["set_key"]).where("doc_id = rep").select("set_key", "rep", F.col("n_shingles").alias("n"), "bands", "sketch").dropDuplicates(["set_key"])
    found = components(links(reps, docs, rule, scratch), scratch)
    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", "rep", F.coalesce("label", "rep").alias("label"))
    own = signs.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("rep", "doc_id").alias("set_rep"))


def kept_rows(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    gone = near_duplicates(docs, rule).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = Scratch(docs.sparkSession, "near-dup-gone").cut(gone, "gone")
    maybe, stay = idfilter.parted(docs, "doc_id", gone, "__gone")  # few are looked up
    return stay.unionByName(maybe.join(gone, maybe["doc_id"] == gone["__gone"], "left_anti"))
