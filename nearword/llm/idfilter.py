"""A fixed-size filter of ids: which rows of a large table may have one of some ids.

Ids are hashed to 2**24 bits, kept as 2**18 words at most, whatever their number; so the table of words may
be broadcast. Rows that aren't flagged have none of the ids for sure; flagged ones are joined exactly. While
the ids are few beside the bits, a join with a large table then shuffles few of its rows; with very many ids
most rows are flagged, and the join is as without the filter. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, WORD = 24, 6


def _place(column: Column) -> tuple[Column, Column]:
    """(word, place in it) of an id; null is an id too, and types of integers are alike."""
    h = F.xxhash64(column.cast("string")).bitwiseAND(F.lit((1 << BITS) - 1))
    return F.shiftright(h, WORD), h.bitwiseAND(F.lit((1 << WORD) - 1)).cast("int")


def words(ids: DataFrame, column: str) -> DataFrame:
    """(__word, __bits) of the ids."""
    word, at = _place(F.col(column))
    marked = ids.select(word.alias("__word"), at.alias("__at")).select("__word", F.expr("shiftleft(1L, __at)").alias("__bit"))
    return marked.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))


def parted(rows: DataFrame, column: str, ids: DataFrame, of: str) -> tuple[DataFrame, DataFrame]:
    """(the rows whose ``column`` may be in ``of`` of ``ids``, the rows where it isn't). ``ids`` should be a written table: it is read for each part."""
    word, at = _place(F.col(column))
    met = rows.withColumn("__word", word).withColumn("__at", at).join(F.broadcast(words(ids, of)), "__word", "left")
    maybe = F.coalesce(F.expr("shiftrightunsigned(__bits, __at)").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return met.where(maybe).select(rows.columns), met.where(~maybe).select(rows.columns)
