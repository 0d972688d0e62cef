"""Which labelled texts a model is fitted on: a sample by id hash, of texts that are there.

Labels are joined with the texts before the sample is drawn, so that labels without a text take no place.
A row is an id, a label and a text: copies of it are one. Of ids with several texts, every id gives one
before any gives a second, so that no id fills the sample.

Where there are many more rows than places, those with large hashes are left out before rows are ranked: the
places go to the smallest hashes anyway, so a task ranks a few times the places, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearword.llm.storage import Scratch


#: Rows that are ranked, for each place; the hashes of fewer than a quarter of them can't fail to fill the places.
SPARE = 4


def chosen(docs: DataFrame, known: DataFrame, label: str, most: int, seed: int) -> list[Row]:
    """(doc_id, label, h, n, place) of at most ``most`` texts of each label in ``known`` (doc_id, label): hash of text, bytes, place in the label's order by hash of id."""
    texts = docs.where("text IS NOT NULL AND doc_id IS NOT NULL")
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    rows = texts.join(known.select(F.col("doc_id").cast("long").alias("doc_id"), label), "doc_id").distinct()
    rows = Scratch(docs.sparkSession, "labelled").cut(rows.withColumn("u", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)), "rows")
    turn = F.row_number().over(Window.partitionBy("doc_id", label).orderBy("h"))
    place = F.row_number().over(Window.partitionBy(label).orderBy("turn", "u", "doc_id"))
    ids = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.approx_count_distinct("doc_id", 0.05).alias("n")).collect()}  # a row per label
    small = F.lit(False)
    for value, n in ids.items():
        small = small | (F.col(label) == value) & (F.lit(True) if n <= 2 * SPARE * most else F.col("u") < int((1 << 63) * (SPARE * most / n)))
    few = rows.where(small).withColumn("turn", turn).where(F.col("turn") <= most).withColumn("place", place).where(F.col("place") <= most)
    return few.select("doc_id", label, "h", "n", "place").orderBy(label, "place").collect()


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of bounded ``rows`` (doc_id, h and more), each once, with the columns of ``rows`` but h."""
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(rows), "doc_id").where(F.xxhash64("text") == F.col("h")).drop("h").distinct()
