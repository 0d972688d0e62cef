"""Features and objects of interest from text files, and results to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FEATURES = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("text", T.StringType())])

#: Partitions of a text whose counts are broadcast, 16 bytes each.
MOST_PARTITIONS = 1 << 20

#: White space that may separate the fields of an object.
BLANKS = r"\s+"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of text files, from 1 in the order of Spark's partitions.

    Lines are numbered within their partition as they are read; partitions are then offset by the counts
    before them, one row each, which are broadcast up to MOST_PARTITIONS. A null line cannot occur; an empty
    file has no rows.
    """
    lines = _lines(spark, path)
    few = lines.rdd.getNumPartitions() <= MOST_PARTITIONS
    seen = lines.withColumn("__seq", F.monotonically_increasing_id())
    seen = seen.withColumn("__part", F.shiftright("__seq", 33)).withColumn("__at", F.col("__seq").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = seen.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return seen.join(F.broadcast(before) if few else before, "__part").select((F.col("__before") + F.col("__at") + 1).alias("line_no"), "line")


def _split_features(lines: DataFrame) -> DataFrame:
    parts = F.split("line", " ", 4)
    return lines.select(
        "line",
        F.get(parts, F.lit(0)).try_cast("int").alias("id"),
        F.get(parts, F.lit(1)).try_cast("double").alias("lat"),
        F.get(parts, F.lit(2)).try_cast("double").alias("lon"),
        F.get(parts, F.lit(3)).alias("text"),
    )


def _sound() -> Column:
    return F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("text").isNotNull()


def read_features(spark: SparkSession, path: str, mode: str = "permissive", lower: bool = False, most: int | None = None) -> DataFrame:
    """Features ``id lat lon text`` of lines split at single spaces, in UTF-8.

    ``mode``: 'permissive' leaves out lines with a bad number or without text (see :func:`rejected_features`),
    'failfast' raises when such a line is met. ``lower``: texts in lower case. ``most``: the first lines only.
    """
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"unknown mode: {mode!r}")
    lines = _lines(spark, path) if most is None else numbered_lines(spark, path).orderBy("line_no").limit(most).select("line")
    split = _split_features(lines)
    if mode == "failfast":
        wrong = F.raise_error(F.concat(F.lit("not a feature: "), F.col("line")))
        split = split.withColumn("id", F.when(_sound(), F.col("id")).otherwise(wrong.cast("int")))
    else:
        split = split.where(_sound())
    return split.select("id", "lat", "lon", F.lower("text").alias("text") if lower else F.col("text"))


def rejected_features(spark: SparkSession, path: str) -> DataFrame:
    """The lines that :func:`read_features` leaves out."""
    return _split_features(_lines(spark, path)).where(~_sound()).select("line")


def _split_objects(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("line"), BLANKS)
    return lines.select(
        "line_no",
        "line",
        F.get(parts, F.lit(0)).try_cast("int").alias("src_id"),
        F.get(parts, F.lit(1)).try_cast("double").alias("lat"),
        F.get(parts, F.lit(2)).try_cast("double").alias("lon"),
    )


def read_objects(spark: SparkSession, path: str, key: str = "line_no") -> DataFrame:
    """Objects of interest ``id lat lon``: a token, latitude and longitude, and whatever follows.

    ``key``: 'line_no' takes the line's number as id, 'src_id' the first token. Lines without two
    coordinates are left out (see :func:`rejected_objects`); the first token need not be a number unless
    it is the id.
    """
    if key not in ("line_no", "src_id"):
        raise ValueError(f"unknown key: {key!r}")
    found = _split_objects(numbered_lines(spark, path)).where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col(key).isNotNull())
    return found.select(F.col(key).cast("long").alias("id"), "lat", "lon")


def rejected_objects(spark: SparkSession, path: str) -> DataFrame:
    return _split_objects(numbered_lines(spark, path)).where(F.col("lat").isNull() | F.col("lon").isNull()).select("line_no", "line")


def load_objects_once(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Objects from the Parquet folder ``table``, which is made of ``path`` if it isn't there."""
    read_objects(spark, path).write.mode("ignore").parquet(table)
    return spark.read.parquet(table)


def append_rows(rows: DataFrame, path: str, header: bool = False) -> None:
    """Append rows to text files, fields separated by a blank."""
    rows.write.mode("append").option("sep", " ").option("header", header).csv(path)
