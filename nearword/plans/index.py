"""Index tables: built from features, kept as Parquet, appended to.

    postings    term_id, id, lat, lon, impact  clustered by term and cell; in memory with the term instead
    term_info   term, term_id, df, hot
    meta        n_features, kind, block_size
    doc_length  id, num_words

Each is a folder of batches: the build's, ``base``, and one for each append. A batch counts once its ``meta``
is written, which is last. A build is a generation of its own, ``g00001`` and on; the newest with a whole
``base`` is the index, so overwriting never leaves readers without one.

``hot`` says that a term has more postings than a block of the list storage holds. On disk, postings are
range-partitioned and sorted by term and then cell, so that row-group statistics prune terms and places; a
frequent term spreads over as many files as its cells need.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearword.functions import formulas
from nearword.operators import weights
from nearword.plans.scratch import cut, remove, store

BLOCK_SIZE = 4096
#: Bytes of a stored posting in the two kinds of index.
POSTING_BYTES = {"s2i": 28, "if": 32}
#: Cells a side that postings are clustered by, and that term cells are summed up in.
CELLS = 64
_BUCKETS = 1024

TABLES = ("postings", "term_info", "meta", "doc_length")


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    term_info: DataFrame
    meta: DataFrame
    doc_length: DataFrame
    kind: str = "s2i"
    block_size: int = BLOCK_SIZE

    def persisted(self) -> Index:
        """The same, kept in memory and on disk once computed."""
        return Index(*[getattr(self, name).persist() for name in TABLES], self.kind, self.block_size)

    def named(self) -> DataFrame:
        """Postings with their term."""
        if "term" in self.postings.columns:
            return self.postings
        return self.postings.join(self.term_info.select("term", "term_id"), "term_id").select("term", "id", "lat", "lon", "impact")


def most_in_block(block_size: int = BLOCK_SIZE, kind: str = "s2i") -> int:
    """How many postings a block of the list storage holds."""
    return block_size // POSTING_BYTES[kind]


def numbered_terms(frequencies: DataFrame) -> DataFrame:
    """``frequencies`` (term, df) with ``term_id``, dense from 0: rank in the hash bucket plus the buckets before."""
    dealt = frequencies.withColumn("__bucket", F.pmod(F.xxhash64("term"), F.lit(_BUCKETS)))
    counts = dealt.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy("term"))
    return dealt.withColumn("__rank", rank).join(F.broadcast(before), "__bucket").withColumn("term_id", F.col("__before") + F.col("__rank") - 1).drop("__bucket", "__rank", "__before")


def hot(df: Column, block_size: int = BLOCK_SIZE, kind: str = "s2i") -> Column:
    return df > most_in_block(block_size, kind)


def build(features: DataFrame, kind: str = "s2i", block_size: int = BLOCK_SIZE, most: int | None = None, unique: bool = False) -> Index:
    """The tables of (id, lat, lon, text). ``kind`` 'if' is the plain inverted file, which differs in its block size only.

    ``most``: the first features by id only. ``unique``: raise when an id occurs twice; else its texts are
    merged in one, at the smallest of its places.
    """
    if kind not in POSTING_BYTES:
        raise ValueError(f"unknown kind of index: {kind!r}")
    if most is not None:
        features = features.orderBy("id").limit(most)
    if unique and (again := weights.repeated_ids(features).first()):
        raise ValueError(f"repeated id: {again[0]}")
    postings = weights.postings(features)
    term_info = numbered_terms(weights.document_frequency(postings)).select("term", "term_id", "df", hot(F.col("df"), block_size, kind).alias("hot"))
    return Index(postings, term_info, weights.dataset_size(features), weights.doc_length(features), kind, block_size)


def for_query(features: DataFrame, keywords: str) -> Index:
    """The rows of the tables that a query reads, of features that have no index yet: one pass over the texts.

    Postings and df are of the query's terms alone; postings are cut, so that df and scores start from them.
    """
    terms = weights.query_terms(features.sparkSession, keywords)
    postings = cut(weights.postings(features).join(F.broadcast(terms), "term"), "query-postings")
    return Index(postings, weights.document_frequency(postings), weights.dataset_size(features), weights.doc_length(features))


def _clustered(postings: DataFrame) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) * CELLS)
    rows = postings.withColumn("__x", cell("lat")).withColumn("__y", cell("lon"))
    return rows.repartitionByRange("term_id", "__x", "__y", "id").sortWithinPartitions("term_id", "__x", "__y", "id").drop("__x", "__y")


def _write(spark: SparkSession, index: Index, path: str, batch: str) -> None:
    """Write all tables into their folders for ``batch``, in place of what an earlier attempt left, meta last."""
    at = lambda name: f"{path}/{name}/batch={batch}"
    remove(spark, at("meta"))
    info = cut(index.term_info, "term-info")
    numbered = index.postings.join(info.select("term", "term_id"), "term").select("term_id", "id", "lat", "lon", "impact")
    _clustered(numbered).write.mode("overwrite").parquet(at("postings"))
    info.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(at("term_info"))
    index.doc_length.write.mode("overwrite").parquet(at("doc_length"))
    meta = index.meta.select("n_features", F.lit(index.kind).alias("kind"), F.lit(index.block_size).alias("block_size"))
    meta.coalesce(1).write.mode("overwrite").parquet(at("meta"))


def _generations(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """(all generations that have a folder, those with a whole base), ascending."""
    files, made = store(spark, path)
    if not files.exists(made(path)):
        return [], []
    names = [s.getPath().getName() for s in files.listStatus(made(path))]
    found = sorted(int(n[1:]) for n in names if re.fullmatch(r"g\d+", n))
    return found, [g for g in found if files.exists(made(f"{_root(path, g)}/meta/batch=base/_SUCCESS"))]


def _root(path: str, generation: int) -> str:
    return f"{path}/g{generation:05d}"


def current(spark: SparkSession, path: str) -> str:
    """The folder of the newest whole generation at ``path``."""
    whole = _generations(spark, path)[1]
    if not whole:
        raise FileNotFoundError(f"no index at {path}")
    return _root(path, whole[-1])


def save(index: Index, path: str, mode: str = "error") -> None:
    """Write all tables below ``path`` as a new generation. ``mode``: 'error' if there is an index, 'overwrite' takes its place once the new one is whole.

    The generation before the new one stays for who reads it still; earlier ones are removed.
    """
    if mode not in ("error", "overwrite"):
        raise ValueError(f"unknown mode: {mode!r}")
    spark = index.meta.sparkSession
    found, whole = _generations(spark, path)
    if whole and mode == "error":
        raise FileExistsError(f"there is an index at {path}")
    _write(spark, index, _root(path, max(found, default=0) + 1), "base")
    for old in found:
        if old not in whole[-1:]:
            remove(spark, _root(path, old))


def open_index(spark: SparkSession, path: str) -> Index:
    """The tables at ``path``. After appends, df and N are sums over the batches that were written whole; ids stay as first given."""
    root = current(spark, path)
    own = spark.read.parquet(f"{root}/meta").withColumn("batch", F.col("batch").cast("string"))
    whole = F.broadcast(own.select("batch").distinct())  # a row per append
    read = lambda name: spark.read.parquet(f"{root}/{name}").withColumn("batch", F.col("batch").cast("string")).join(whole, "batch", "left_semi").drop("batch")
    postings, info, length = (read(name) for name in ("postings", "term_info", "doc_length"))
    kind, block_size = spark.read.parquet(f"{root}/meta/batch=base").select("kind", "block_size").first()
    terms = info.groupBy("term").agg(F.min("term_id").alias("term_id"), F.sum("df").alias("df")).withColumn("hot", hot(F.col("df"), block_size, kind))
    return Index(postings, terms, own.agg(F.sum("n_features").alias("n_features")), length, kind, block_size)


def append(spark: SparkSession, path: str, features: DataFrame, batch: str | None = None) -> None:
    """Insert features after the build: new postings, lengths, and additions to df and N.

    A text's impacts depend on that text alone, so postings that exist stay right. Ids are not updated and
    nothing is deleted. New terms get ids after those there are. A batch that is appended again under its
    name takes the place of what it wrote before, also of what a failed attempt left.
    """
    batch = batch or uuid.uuid4().hex
    root, opened = current(spark, path), open_index(spark, path)
    new = build(features, opened.kind, opened.block_size)
    before = spark.read.parquet(f"{root}/term_info").where(F.col("batch").cast("string") != batch)
    old = before.groupBy("term").agg(F.min("term_id").alias("known"))
    base = before.agg(F.coalesce(F.max("term_id") + 1, F.lit(0))).first()[0]
    counts = cut(new.term_info.select("term", "df").join(old, "term", "left"), "appended-counts")
    fresh = numbered_terms(counts.where("known IS NULL").select("term", "df")).withColumn("term_id", F.col("term_id") + base)
    added = counts.where("known IS NOT NULL").select("term", F.col("known").alias("term_id"), "df").unionByName(fresh.select("term", "term_id", "df"))
    info = added.select("term", "term_id", "df", hot(F.col("df"), opened.block_size, opened.kind).alias("hot"))
    _write(spark, Index(new.postings, info, new.meta, new.doc_length, opened.kind, opened.block_size), root, batch)


def compacted(index: Index) -> DataFrame:
    """Postings as they are stored: term_id instead of the term; 'if' with 64-bit ids."""
    id_type = "int" if index.kind == "s2i" else "bigint"
    rows = index.postings
    if "term_id" not in rows.columns:
        rows = rows.join(index.term_info.select("term", "term_id"), "term")
    return rows.select(F.col("term_id").cast("int").alias("term_id"), F.col("id").cast(id_type).alias("id"), "lat", "lon", "impact")


def cell_max_impact(postings: DataFrame, cells: int = CELLS) -> DataFrame:
    """(term, cx, cy, n, box, max_impact): what an aggregate tree holds of each term's postings in a cell of the unit square."""
    return postings.groupBy("term", F.floor(F.col("lat") * cells).alias("cx"), F.floor(F.col("lon") * cells).alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"), F.max("impact").alias("max_impact")
    )


def build_stats(features: DataFrame) -> DataFrame:
    """One row of build statistics, over features that have tokens except for n_features."""
    own = features.select("text", formulas.tokens(F.col("text")).alias("t"))
    words = F.coalesce(F.size("t"), F.lit(0))
    words = F.when(words > 0, words).otherwise(0)
    totals = own.select(words.alias("w"), F.when(words > 0, F.size(F.array_distinct("t"))).alias("d"), F.when(words > 0, F.length("text")).alias("c")).agg(
        F.count(F.lit(1)).alias("n_features"),
        F.sum(F.col("w").cast("long")).alias("total_words"),
        F.count("d").alias("dataset_lines"),
        F.sum(F.col("d").cast("long")).alias("n_postings"),
        F.avg(F.col("d").cast("double")).alias("avg_distinct_terms"),
        F.avg(F.col("c").cast("double")).alias("avg_line_length"),
    )
    terms = features.select(F.explode(formulas.tokens(F.col("text"))).alias("term")).agg(F.count_distinct("term").alias("n_terms"))
    return totals.withColumn("n_terms", terms.scalar()).withColumn("list_bytes", F.col("n_postings") * POSTING_BYTES["s2i"])


def postings_read(index: Index, keywords: str) -> int:
    """How many postings the known terms of a query have, which is what its search reads."""
    terms = weights.query_terms(index.postings.sparkSession, keywords)
    return index.term_info.join(F.broadcast(terms), "term").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]


def built_message(index: Index) -> DataFrame:
    """One row (message) about a finished build."""
    return index.meta.select(F.format_string("indexed %d features", "n_features").alias("message"))


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes) of each stored table, and of all as ``total``: what their files take."""
    files, made = store(spark, path)
    root = current(spark, path)
    sizes = [(name, int(files.getContentSummary(made(f"{root}/{name}")).getLength())) for name in TABLES]
    return spark.createDataFrame([*sizes, ("total", sum(n for _, n in sizes))], "name string, bytes long")
