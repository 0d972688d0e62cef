"""Term statistics of features and weights of queries.

Features are rows (id, text) or (id, lat, lon, text). A null text counts as empty: the feature is one of N,
without postings. Rows of one id count as that many features with one merged text, at the smallest of their
places.

Terms are counted and texts' vector lengths taken row by row, in arrays, so neither texts nor their tokens
are shuffled; only rows of repeated ids, which are found by their ids alone, are merged by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearword.functions import formulas
from nearword.plans.scratch import cut


def text_tokens(features: DataFrame) -> DataFrame:
    """(id, term): every token, with repeats."""
    return features.select("id", F.explode(formulas.tokens(F.col("text"))).alias("term"))


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` replaced by its ``terms`` (term, tf), from the runs of its sorted tokens, and ``norm``."""
    own = [c for c in rows.columns if c != "text"]
    ordered = rows.select(*own, F.array_sort(formulas.tokens(F.coalesce("text", F.lit("")))).alias("t"))
    at = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.get("t", i - 1) != F.get("t", i - 2)))
    starts = ordered.withColumn("at", F.when(F.size("t") > 0, at).otherwise(F.array().cast("array<int>")))

    def run(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get("at", k + 1), F.size("t") + 1)
        return F.struct(F.get("t", begin - 1).alias("term"), (end - begin).cast("long").alias("tf"))

    counted = starts.select(*own, F.transform("at", run).alias("terms"))

    def added(total: Column, x: Column) -> Column:
        w = formulas.term_weight(x["tf"])
        return total + w * w

    return counted.select(*own, "terms", F.sqrt(F.aggregate("terms", F.lit(0.0), added)).alias("norm"))


def repeated_ids(features: DataFrame) -> DataFrame:
    """(__id) of several rows, written; found by the ids alone."""
    return cut(features.groupBy("id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("id").alias("__id")), "repeated-ids")


def weighed(features: DataFrame) -> DataFrame:
    """(id, lat, lon, term, tf, norm) of every feature's terms; without lat and lon where features have none."""
    place = [c for c in ("lat", "lon") if c in features.columns]
    rows = features.select("id", *place, "text")

    def exploded(some: DataFrame) -> DataFrame:
        # outer, as explode would have its filter of empty arrays pushed into the projections and count each text many times
        each = _counted(some).select("id", *place, "norm", F.explode_outer("terms").alias("x")).where("x IS NOT NULL")
        return each.select("id", *place, "x.term", "x.tf", "norm")

    again = repeated_ids(features)
    if again.isEmpty():
        return exploded(rows)
    same = rows["id"].eqNullSafe(again["__id"])
    merged = rows.join(again, same, "left_semi")
    tf = text_tokens(merged).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    norm = doc_norm(tf).select(F.col("id").alias("__id"), "norm")
    out = tf.join(norm, tf["id"].eqNullSafe(norm["__id"])).drop("__id")
    if place:
        least = merged.groupBy(F.col("id").alias("__id")).agg(F.min(F.struct(*place)).alias("at"))
        out = out.join(least, out["id"].eqNullSafe(least["__id"])).select(*out.columns, *[F.col(f"at.{c}").alias(c) for c in place])
    return exploded(rows.join(again, same, "left_anti")).unionByName(out)


def term_frequency(features: DataFrame) -> DataFrame:
    """(id, term, tf)."""
    return weighed(features.select("id", "text")).select("id", "term", "tf")


def doc_length(features: DataFrame) -> DataFrame:
    """(id, num_words) of features that have tokens."""
    return features.select("id", F.size(formulas.tokens(F.col("text"))).alias("num_words")).where("num_words > 0")


def doc_norm(frequencies: DataFrame) -> DataFrame:
    """(id, norm): the length of each text's weight vector, of (id, term, tf)."""
    return frequencies.groupBy("id").agg(formulas.norm(formulas.term_weight(F.col("tf"))).alias("norm"))


def norms(features: DataFrame) -> DataFrame:
    """(id, norm) of features that have tokens."""
    return weighed(features.select("id", "text")).groupBy("id").agg(F.max("norm").alias("norm"))


def postings(features: DataFrame) -> DataFrame:
    """(term, id, lat, lon, impact) of every feature's terms; without lat and lon where features have none."""
    rows = weighed(features)
    place = [c for c in ("lat", "lon") if c in rows.columns]
    return rows.select("term", "id", *place, formulas.impact(formulas.term_weight(F.col("tf")), F.col("norm")).alias("impact"))


def document_frequency(frequencies: DataFrame) -> DataFrame:
    """(term, df): how many features have the term."""
    return frequencies.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def dataset_size(features: DataFrame) -> DataFrame:
    """One row (n_features): all features, those without tokens too."""
    return features.agg(F.count(F.lit(1)).alias("n_features"))


def vocabulary_size(frequencies: DataFrame) -> DataFrame:
    """One row (n_terms)."""
    return frequencies.agg(F.count_distinct("term").alias("n_terms"))


def most_frequent_terms(term_info: DataFrame, n: int) -> DataFrame:
    """The ``n`` terms with the highest df, by term where equal; fewer if there are fewer."""
    return term_info.where("df > 0").select("term", "df").orderBy(F.desc("df"), "term").limit(n)


def query_terms(spark, keywords: str) -> DataFrame:
    """(term): the distinct tokens of a query."""
    return spark.createDataFrame([(keywords,)], "q string").select(F.explode(F.array_distinct(formulas.tokens(F.col("q")))).alias("term"))


def query_weights(terms: DataFrame, term_info: DataFrame, n_features: DataFrame) -> DataFrame:
    """(term, qw, ql) of the known query terms: weight and length of the query's vector. Unknown terms drop out.

    As many rows as the query has terms; ``term_info`` is reached by the terms, which are the broadcast side.
    """
    known = term_info.join(F.broadcast(terms), "term")
    ids = [c for c in ("term_id",) if c in term_info.columns]
    weighted = known.select("term", *ids, formulas.query_weight(n_features.scalar(), F.col("df")).alias("qw"))
    length = F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy(F.lit(0))))  # over the query's own terms
    return weighted.select("term", *ids, "qw", length.alias("ql"))


def _by(postings: DataFrame) -> str:
    """What postings name their term by: stored ones by its id."""
    return "term" if "term" in postings.columns else "term_id"


def relevance(postings: DataFrame, weights: DataFrame, keep: tuple[str, ...] = ("id", "lat", "lon")) -> DataFrame:
    """(id, ..., theta): textual relevance of each feature that has a query term."""
    partial = formulas.textual_partial(F.col("impact"), F.col("qw"), F.col("ql"))
    matched = postings.join(F.broadcast(weights), _by(postings)).withColumn("partial", partial)
    return matched.groupBy(*keep).agg(F.sum("partial").alias("theta"))


def term_source(postings: DataFrame, term: str) -> DataFrame:
    """A term's postings in order of id."""
    return postings.where(F.col("term") == term).orderBy("id")


def scored_source(postings: DataFrame, weights: DataFrame, lat: float, lon: float, most: float, alpha: float, n_terms: int) -> DataFrame:
    """(term, id, lat, lon, score): each posting with its textual and spatial share, best first."""
    matched = postings.join(F.broadcast(weights), _by(postings))
    dist = formulas.distance(F.col("lat"), F.col("lon"), F.lit(float(lat)), F.lit(float(lon)))
    score = formulas.textual_partial(F.col("impact"), F.col("qw"), F.col("ql")) + formulas.spatial_partial(dist, most, alpha, n_terms)
    return matched.select("term", "id", "lat", "lon", score.alias("score")).orderBy(F.desc("score"), F.desc("id"))
