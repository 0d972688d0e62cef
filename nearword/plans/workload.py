"""Query workloads: points and keywords, drawn by seeded hashes so that a run can be repeated anywhere.

A draw's number is made of the first 52 bits of the MD5 of its values and the seed, which any engine can compute.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearword.functions.formulas import tokens
from nearword.operators import weights

CUSTOM, RANDOM, MOST_FREQUENT, BY_FREQUENCY = "custom", "random", "mostFrequent", "byFrequency"


@dataclass(frozen=True)
class Query:
    query_no: int
    keywords: str
    lat: float
    lon: float


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def drawn(seed: int, *values: object) -> float:
    """The same of values on the driver."""
    return (int(hashlib.md5("|".join(map(str, (*values, seed))).encode()).hexdigest()[:13], 16) + 0.5) / float(1 << 52)


def query_points(n: int, space_max: float, seed: int) -> list[tuple[float, float]]:
    """``n`` points in the square from 0 to ``space_max``."""
    return [(drawn(seed, i, "lat") * space_max, drawn(seed, i, "lon") * space_max) for i in range(n)]


def random_keywords(term_info: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` terms drawn uniformly and without replacement."""
    return term_info.where("df > 0").select("term", uniform(seed, "term").alias("u")).orderBy("u", "term").limit(n).select("term")


def frequent_keywords(term_info: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """``n`` of the ``most`` terms with the highest df, drawn uniformly."""
    return random_keywords(weights.most_frequent_terms(term_info, most), n, seed)


def proportional_keywords(term_info: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` terms drawn without replacement in proportion to df: the smallest of -ln(u) / df."""
    return term_info.where("df > 0").select("term", (-F.log(uniform(seed, "term")) / F.col("df")).alias("u")).orderBy("u", "term").limit(n).select("term")


def custom_keywords(spark, text: str) -> list[str]:
    return [r[0] for r in spark.createDataFrame([(text,)], "q string").select(F.explode(F.array_distinct(tokens(F.col("q"))))).collect()]


def queries(term_info: DataFrame, kind: str, n_queries: int, n_keywords: int, seed: int, text: str = "", most: int = 5, space_max: float = 10000.0) -> list[Query]:
    """A workload: a handful of queries of a handful of terms each, on the driver."""
    points = query_points(n_queries, space_max, seed)
    out = []
    for no, (lat, lon) in enumerate(points):
        if kind == CUSTOM:
            terms = custom_keywords(term_info.sparkSession, text)
        else:
            draw = {
                RANDOM: lambda s: random_keywords(term_info, n_keywords, s),
                MOST_FREQUENT: lambda s: frequent_keywords(term_info, n_keywords, most, s),
                BY_FREQUENCY: lambda s: proportional_keywords(term_info, n_keywords, s),
            }.get(kind)
            if draw is None:
                raise ValueError(f"unknown type of query: {kind!r}")
            terms = [r[0] for r in draw(seed + no).collect()]
        out.append(Query(no, " ".join(terms), lat, lon))
    return out
