"""From raw documents to packed sequences, in five stages.

Every stage is written as Parquet and read again by the next, and all but the last return the columns of
``documents``. What a stage leaves out stays out.

Defined cases, in the order of the stages: a null or empty text has a weight of 0 in the quality draw, is
one text with all of no other characters than white space, of which one row stays, is near nothing, has no
words in the mixture, which may leave it out, and is packed as the end id alone. A null doc_id is an id of
its own to exact dedup, near dedup keeps it, and it is mixed and packed like others. Rows that repeat an id
and a text become one. Columns beside those of ``documents`` are carried along, whatever their names. An
empty table passes every stage as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearword.llm import exact_dedup, mixing, near_dup, packing, quality
from nearword.llm.queries import public_vocabulary, table
from nearword.llm.storage import Scratch, ship


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards documents labelled good; what it rejects goes."""
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal text stays, by a new digest index."""
    index = exact_dedup.DigestIndex(spark, Scratch(spark, "digest-index").path)
    kept = exact_dedup.kept_rows(docs, index, "pipeline")
    index.close()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: shingles of five words, similarity 0.8."""
    return near_dup.kept_rows(docs, near_dup.Rule(n=5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources at their target weights: rows as often as they are taken, in the order of its shards."""
    return mixing.in_order(mixing.mix(docs)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048, a row per piece."""
    return packing.pack(docs, public_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL has no hashed models, MinHash or tokenizers; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
