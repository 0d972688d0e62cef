"""The query operators over postings (term, id, lat, lon, impact) with (term, df) and the number of features.

Scores are rounded to nine places before they are ranked, so that sums taken in another order rank alike;
equal scores go by descending id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearword.functions import formulas
from nearword.operators import spatial, weights

PLACES = 9


def ranked(rows: DataFrame, k: int | None) -> DataFrame:
    """The ``k`` rows with the highest score, then id; all for None."""
    out = rows.orderBy(F.desc("score"), F.desc("id"))
    return out if k is None else out.limit(k)


def theta(index, keywords: str) -> DataFrame:
    """(id, lat, lon, theta) of the features that have a query term."""
    terms = weights.query_terms(index.postings.sparkSession, keywords)
    return weights.relevance(index.postings, weights.query_weights(terms, index.term_info, index.meta))


def preference(index, objects: DataFrame, keywords: str, rule: str | int, radius: float, k: int | None = 10, grouped: bool = False) -> DataFrame:
    """The objects with the best neighbourhood for the keywords: id, lat, lon, score.

    Objects without a relevant feature in their neighbourhood have score 0 and compete too.
    """
    name = formulas.neighbourhood(rule)
    scores = spatial.best_neighbour(objects, theta(index, keywords), name, radius, grouped)
    own = objects.select("id", "lat", "lon").dropDuplicates(["id"])
    score = F.round(F.coalesce(F.col("score"), F.lit(0.0)), PLACES).alias("score")
    return ranked(own.join(scores, "id", "left").select("id", "lat", "lon", score), k)


def blended(index, lat: float, lon: float, most: float, keywords: str, k: int | None, alpha: float) -> DataFrame:
    """The features with the best blend of nearness and relevance: id, lat, lon, score, distance.

    score = alpha * (1 - distance / most) + theta, of features with a query term.
    """
    dist = formulas.distance(F.col("lat"), F.col("lon"), F.lit(float(lat)), F.lit(float(lon)))
    scored = theta(index, keywords).withColumn("distance", dist)
    score = F.round(formulas.spatial_partial(F.col("distance"), most, alpha) + F.col("theta"), PLACES)
    return ranked(scored.select("id", "lat", "lon", score.alias("score"), F.round("distance", PLACES).alias("distance")), k)


def in_rectangle(index, min_lat: float, min_lon: float, max_lat: float, max_lon: float, keywords: str) -> DataFrame:
    """(id, lat, lon, score): relevance of the features in a closed rectangle that have a query term, best first."""
    inside = formulas.in_rect(F.col("lat"), F.col("lon"), min_lat, min_lon, max_lat, max_lon)
    terms = weights.query_terms(index.postings.sparkSession, keywords)
    own = weights.query_weights(terms, index.term_info, index.meta)
    found = weights.relevance(index.postings.where(inside), own)
    return ranked(found.select("id", "lat", "lon", F.round("theta", PLACES).alias("score")), None)


def objects_in_rectangle(objects: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> DataFrame:
    """The objects in a closed rectangle."""
    return objects.where(formulas.in_rect(F.col("lat"), F.col("lon"), min_lat, min_lon, max_lat, max_lon))
