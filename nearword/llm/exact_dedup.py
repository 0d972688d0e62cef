"""Exact deduplication by a persistent digest index.

The index is Parquet tables bucketed and sorted by digest: a base with one sorted file a bucket, and a tail
of what was appended since. A batch's digests are grouped (map-side partial aggregates, so a group of any
size costs one row per task), those that the index holds already are removed by sort-merge anti-joins, and
the rest are appended in the same bucketing. Joins read the index as it lies: the base is neither shuffled
nor sorted again, the tail is not shuffled. When the tail has grown to a part of the base, both are written
into a new base, with as many buckets as its rows need. All of it is DataFrame functions.

Rows get their group's answer by a join on the digest with one row per digest of the batch. Groups of more
than a 4096th of the batch, which are 4096 at most, are broadcast for it, so no task gets a large group.

Defined cases: a null or empty text, and one of white space only, has the empty normal form, and all of
these are equal. A null ``doc_id`` is kept in its group and stays only if no other id has as many code
points. Rows that repeat both doc_id and text all count in ``group_size`` and are marked alike. Columns beside ``doc_id`` and ``text``
are not read by :func:`ingest`; :func:`kept_rows` carries them through. An empty batch changes nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearword.llm import idfilter
from nearword.llm.storage import Scratch

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Groups of a larger part of a batch are broadcast: there are at most so many.
HOT_GROUPS = 4096
#: Rows of a bucket when a base is written, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 20, 64
#: The tail is written into a new base when it has this part of the base's rows.
TAIL = 0.25
COLUMNS = "digest BINARY, keep_id BIGINT, keep_code_points BIGINT, group_size BIGINT, batch STRING"


def normal_form(text: Column) -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_code_points, digest): the SHA-256 of each whole text's normal form, as 32 bytes."""
    return docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_code_points"), F.unhex(F.sha2(normal_form(F.col("text")), 256)).alias("digest"))


class DigestIndex:
    """One row per digest that was ever let in: (digest, keep_id, keep_code_points, group_size, batch).

    ``path`` is where its files lie: ``base-N`` and ``tail-N`` for the newest N that has a marker ``made-N``;
    an index that exists there is opened again. ``buckets``: of each base; by its rows if None. Catalog
    tables, which bucketed reading needs, are of this session and go with :meth:`close`; files stay.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.fixed = spark, path, buckets
        self._name = f"digest_index_{uuid.uuid4().hex}"
        self._made: set[str] = set()
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # one sorted file a bucket is read as sorted
        self.version, self.buckets, self.rows = self._latest()

    def _latest(self) -> tuple[int, int, int]:
        """(version, buckets, rows of the base) by the newest marker; version 0 if there is none."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(root):
            return 0, 0, 0
        names = [s.getPath() for s in store.listStatus(root) if s.getPath().getName().startswith("made-")]
        found = max((int(p.getName().removeprefix("made-")) for p in names if store.exists(hadoop.Path(p, "_SUCCESS"))), default=0)
        return (found, *self.spark.read.parquet(f"{self.path}/made-{found:06d}").first()) if found else (0, 0, 0)

    def _table(self, part: str, version: int, buckets: int) -> str:
        """The name of the catalog's table for a part's files."""
        name = f"{self._name}_{part}_{version}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/{part}-{version:06d}'")
        self._made.add(name)
        return name

    def parts(self) -> list[DataFrame]:
        """The base and the tail; none before the first batch."""
        if not self.version:
            return []
        names = [self._table(part, self.version, self.buckets) for part in ("base", "tail")]
        for name in names:
            self.spark.sql(f"REFRESH TABLE {name}")
        return [self.spark.table(name) for name in names]

    def table(self) -> DataFrame:
        """All rows."""
        return reduce(DataFrame.union, self.parts() or [self.spark.createDataFrame([], COLUMNS)])

    def _write(self, rows: DataFrame, part: str, version: int, buckets: int) -> None:
        name, path = self._table(part, version, buckets), f"{self.path}/{part}-{version:06d}"
        # by the number of the bucket, which is what bucketBy computes: a task a bucket, also where rows come from a union of bucketed tables
        dealt = rows.select("digest", "keep_id", "keep_code_points", "group_size", "batch").repartitionById(buckets, F.pmod(F.hash("digest"), F.lit(buckets)))
        dealt.write.mode("append").format("parquet").option("path", path).bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)

    def _new_base(self, rows: DataFrame, n: int) -> None:
        """Write a base and its marker; what an attempt left that failed before is cleared."""
        version = self.version + 1
        buckets = self.fixed or max(LEAST_BUCKETS, -(-n // BUCKET_ROWS))
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for part in ("base", "tail"):
            left = hadoop.Path(f"{self.path}/{part}-{version:06d}")
            left.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)
        self._write(rows, "base", version, buckets)
        self.spark.createDataFrame([(buckets, n)], "buckets int, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/made-{version:06d}")
        self.version, self.buckets, self.rows = version, buckets, n

    def missing(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index doesn't hold: sort-merge anti-joins, the index's side as bucketed."""
        for part in self.parts():
            groups = groups.join(part.select("digest").hint("merge"), "digest", "left_anti")
        return groups

    def append(self, groups: DataFrame, batch: str) -> None:
        """Let in the groups that aren't there."""
        fresh = self.missing(groups).withColumn("batch", F.lit(batch))
        if not self.version:
            self._new_base(fresh, groups.count())
            return
        self._write(fresh, "tail", self.version, self.buckets)
        if self.parts()[1].count() > TAIL * self.rows:
            self.compact()

    def compact(self) -> None:
        """Write base and tail into a new base, then make it the one that counts."""
        if self.version:
            self._new_base(self.table(), sum(part.count() for part in self.parts()))

    def held(self, groups: DataFrame) -> DataFrame:
        """The index's row for each group that it holds."""
        return reduce(DataFrame.union, [groups.select("digest").join(part.hint("merge"), "digest") for part in self.parts()])

    def close(self) -> None:
        """Drop the catalog's tables; the files stay."""
        for name in sorted(self._made):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._made.clear()


def groups_of(digested: DataFrame) -> DataFrame:
    """One row per digest: the row that stays (most code points, then smallest doc_id) and the group's size. Plain maxima and sums, so they hash."""
    lengths = digested.groupBy("digest", "n_code_points").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    best = lengths.groupBy("digest").agg(F.max_by("id", "n_code_points").alias("keep_id"), F.max("n_code_points").alias("keep_code_points"), F.sum("n").alias("group_size"))
    return best.select("digest", "keep_id", "keep_code_points", "group_size")


def ingest(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Deduplicate a batch against the index and itself, and append what is new.

    Returns a row per input row: doc_id, keep_id, group_size, kept, text_sha256, new_group. ``keep_id`` is
    the row that stays for this text: of this batch if ``new_group``, else an earlier batch's; then
    ``kept`` is false for all. ``group_size`` counts the batch that let the text in. To retry a batch
    after a failed append, give it the same ``batch``: what was let in then is found again.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    digested = scratch.cut(digests(docs), "digests")
    groups = scratch.cut(groups_of(digested), "groups")
    index.append(groups, batch)
    found = scratch.cut(index.held(groups), "held")
    rows = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = groups.where(F.col("group_size") > max(1, rows // HOT_GROUPS)).select("digest")
    few = F.broadcast(found.join(F.broadcast(hot), "digest", "left_semi"))  # HOT_GROUPS rows at most
    of_hot = digested.join(few, "digest")
    others = digested.join(F.broadcast(hot), "digest", "left_anti").join(found.hint("merge"), "digest")
    new = F.col("batch") == batch
    return of_hot.union(others).select(
        "doc_id", "keep_id", "group_size",
        (new & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_code_points") == F.col("keep_code_points"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), new.alias("new_group"),
    )


def kept_rows(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows that repeat doc_id and text, one stays.

    Rows whose id no dropped row has stay as they are read; the others are looked up by id and digest.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    told = scratch.cut(ingest(docs, index, batch).select(F.col("doc_id").alias("__keep"), F.col("text_sha256").alias("__sha"), "kept"), "told")
    keep = told.where("kept").drop("kept")
    twice = scratch.cut(keep.groupBy("__keep", "__sha").count().where("count > 1").select("__keep"), "twice")
    asked = scratch.cut(told.where("NOT kept").select("__keep").union(twice), "asked")
    maybe, stay = idfilter.parted(docs, "doc_id", asked, "__keep")
    own = maybe.withColumn("__own", F.sha2(normal_form(F.col("text")), 256))
    met = own.join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__keep")) & (F.col("__own") == F.col("__sha")), "left_semi")
    if not twice.isEmpty():
        met = met.dropDuplicates(["doc_id", "__own"])
    return stay.unionByName(met.drop("__own"))
