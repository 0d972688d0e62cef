"""The registered queries over the driver's tables, and the SQL that gives the same rows.

The tables have no places, so customers (objects), documents and parts (features) get some by integer
arithmetic that is exact in any engine. All queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearword.functions import formulas
from nearword.operators import search, spatial, weights
from nearword.plans import experiment, index, workload
from nearword.plans.scratch import scratch_path
from nearword.sources import properties, text

Query = Callable[[SparkSession, str], DataFrame]

KEYWORDS = "hand, ther, ering"
UNKNOWN = "[qqqq, zzzz]"
RADIUS, K, ALPHA, PLACES = 0.05, 20, 0.3, 9
RECT = (0.2, 0.3, 0.7, 0.8)
POINT = (0.41, 0.57)
DIAGONAL = formulas.space_diagonal(1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: str, a: int, b: int) -> list:
    return [(F.col(key) * a % 10007 / F.lit(10007.0)).alias("lat"), (F.col(key) * b % 10009 / F.lit(10009.0)).alias("lon")]


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as objects of interest."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *_place("c_custkey", 7919, 6271))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as features."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *_place("doc_id", 5779, 3571), "text")


def short_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as features with short texts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("id"), *_place("p_partkey", 4099, 8219), F.col("p_name").alias("text"))


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.term_frequency(features(spark, sf_dir))


def _index(spark: SparkSession, sf_dir: str, keywords: str = KEYWORDS) -> index.Index:
    return index.for_query(features(spark, sf_dir), keywords)


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.postings(features(spark, sf_dir))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, PLACES) for n in names})


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = formulas.tokens(F.col("text"))
    return features(spark, sf_dir).select("id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.concat_ws(" ", t)).alias("digest"), formulas.has_tokens(F.col("text")).alias("has_tokens"))


def preference(rule: str, grouped: bool = False, keywords: str = KEYWORDS) -> Query:
    return lambda spark, sf_dir: search.preference(_index(spark, sf_dir, keywords), objects(spark, sf_dir), keywords, rule, RADIUS, K, grouped)


def query_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    return _rounded(weights.query_weights(weights.query_terms(spark, KEYWORDS), i.term_info, i.meta), "qw", "ql")


def scored_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _index(spark, sf_dir)
    own = weights.query_weights(weights.query_terms(spark, KEYWORDS), i.term_info, i.meta)
    return _rounded(weights.scored_source(i.postings, own, *POINT, DIAGONAL, ALPHA, 3), "score")


def rect_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("lat"), F.col("lon"), F.col("lat"), F.col("lon"))
    rect = tuple(F.lit(x) for x in RECT)
    return objects(spark, sf_dir).select("id", F.round(formulas.rect_min_distance(rect, at), PLACES).alias("least"), F.round(formulas.rect_max_distance(rect, at), PLACES).alias("most"))


def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = [F.round(c, 6).alias(c) for c in ("avg_distinct_terms", "avg_line_length")]
    return index.build_stats(features(spark, sf_dir)).select("n_features", "total_words", "dataset_lines", "n_postings", "n_terms", "list_bytes", *means)


def hot_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.document_frequency(_tf(spark, sf_dir)).select("term", "df", index.hot(F.col("df")).alias("hot"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = index.numbered_terms(weights.document_frequency(_tf(spark, sf_dir)))
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term_id").alias("n_ids"), F.min("term_id").alias("least"), F.max("term_id").alias("most"))


def cell_max_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(index.cell_max_impact(_postings(spark, sf_dir), 8), "max_impact")


def _saved(spark: SparkSession, sf_dir: str, kind: str) -> index.Index:
    path = scratch_path(spark, f"index-{kind}")
    index.save(index.build(features(spark, sf_dir), kind), path)
    return index.open_index(spark, path)


def if_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _saved(spark, sf_dir, "if")
    return _rounded(index.compacted(i).groupBy("id").agg(F.count("term_id").alias("n_terms"), F.sum("impact").alias("total")), "total")


def if_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.preference(_saved(spark, sf_dir, "if"), objects(spark, sf_dir), KEYWORDS, "range", RADIUS, K)


def index_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """df and N of an index that documents were appended to after its build."""
    path = scratch_path(spark, "index-append")
    every = features(spark, sf_dir)
    later = F.col("id") % 3 == 0
    index.save(index.build(every.where(~later)), path)
    index.append(spark, path, every.where(later))
    i = index.open_index(spark, path)
    own = i.named().groupBy("term").agg(F.count(F.lit(1)).alias("n_postings"))
    return i.term_info.select("term", "df", "hot").join(own, "term").withColumn("n_features", i.meta.scalar())


def feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a feature file, with lines that are no features, read again."""
    path = scratch_path(spark, "features")
    own = short_features(spark, sf_dir).select(F.concat_ws(" ", "id", "lat", "lon", "text").alias("value"))
    wrong = spark.createDataFrame([("x 1.0 2.0 no id",), ("7 1.0 east no number",), ("8 1.0 2.0",), ("",)], "value string")
    own.union(wrong).write.text(path)
    return text.read_features(spark, path)


def object_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an object file, with other blanks and a line without coordinates, read again."""
    path = scratch_path(spark, "objects")
    own = objects(spark, sf_dir).select(F.concat(F.col("id").cast("string"), F.lit("\t "), F.col("lat").cast("string"), F.lit("  "), F.col("lon").cast("string"), F.lit(" (tag) name")).alias("value"))
    own.union(spark.createDataFrame([("5 nowhere",)], "value string")).write.text(path)
    return text.read_objects(spark, path, "src_id")


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How lines of a text file in several parts are numbered."""
    path = scratch_path(spark, "lines")
    objects(spark, sf_dir).select(F.col("id").cast("string").alias("value")).repartition(5, "value").write.text(path)
    return text.numbered_lines(spark, path).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("line_no").alias("n_numbers"),
        F.min("line_no").alias("least"),
        F.max("line_no").alias("most"),
        F.sum(F.col("line").cast("long")).alias("total"),
    )


SMALL_BLOCK = 1024


def index_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot terms of an inverted file with small blocks, after an append and in another reader."""
    path = scratch_path(spark, "index-small")
    every, later = features(spark, sf_dir), F.col("id") % 2 == 0
    index.save(index.build(every.where(~later), "if", SMALL_BLOCK), path)
    index.save(index.build(every.where(~later), "if", SMALL_BLOCK), path, "overwrite")
    index.append(spark, path, every.where(later), "second")
    index.append(spark, path, every.where(later), "second")  # the same batch again
    return index.open_index(spark, path).term_info.select("term", "df", "hot")


def stored_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir, "s2i").doc_length.select("id", F.col("num_words").cast("long").alias("num_words"))


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings as stored, by term_id, with the terms that the vocabulary gives them."""
    i = _saved(spark, sf_dir, "s2i")
    stored = index.compacted(i).join(i.term_info.select("term_id", "term", "df"), "term_id")
    return _rounded(stored.select("term", F.col("id").cast("long").alias("id"), "lat", "lon", "impact", "df"), "impact")


def built_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.built_message(index.build(features(spark, sf_dir)))


def _feature_file(spark: SparkSession, sf_dir: str) -> str:
    """Parts as one feature file in order of id, texts in upper case."""
    path = scratch_path(spark, "features")
    own = short_features(spark, sf_dir).repartition(1).sortWithinPartitions("id")
    own.select(F.concat_ws(" ", "id", "lat", "lon", F.upper("text")).alias("value")).write.text(path)
    return path


def _object_file(spark: SparkSession, sf_dir: str) -> str:
    """Customers as one object file in order of id, so that a line's number is a customer's rank."""
    path = scratch_path(spark, "objects")
    own = objects(spark, sf_dir).repartition(1).sortWithinPartitions("id")
    own.select(F.concat_ws(" ", F.lit("x"), "lat", "lon", F.lit("(tag) name")).alias("value")).write.text(path)
    return path


def feature_file_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_features(spark, _feature_file(spark, sf_dir), "failfast", lower=True)


def feature_file_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first features of a file, as the option for the most tuples asks."""
    return text.read_features(spark, _feature_file(spark, sf_dir), most=100)


def objects_loaded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by line number, from the table that the first of two loads made."""
    path, made = _object_file(spark, sf_dir), scratch_path(spark, "objects-table")
    text.load_objects_once(spark, path, made)
    return text.load_objects_once(spark, path, made)


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows appended to text in two runs, as lines."""
    path = scratch_path(spark, "results")
    rows = objects(spark, sf_dir).select("id", (F.col("id") % 4).alias("code"))
    for part in (0, 1):
        text.append_rows(rows.where(F.col("id") % 2 == part), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def near_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality of rows whose scores differ by less than the tolerance, or by more."""
    own = objects(spark, sf_dir).withColumn("score", F.col("lat"))
    a = {c: F.col(c) for c in ("id", "lat", "lon", "score")}
    b = a | {"score": F.col("score") + (F.col("id") % 3) * 6e-10}
    return own.select("id", formulas.nearly_equal(a, b).alias("same"))


CONFIG = """# an experiment
experiment.name = {names}
experiment.folder = {folder}
experiment.startRound = 1
experiment.endRound = {rounds}
dataset.featuresFile = {features}
dataset.objectsFile = {objects}
dataset.spaceMaxValue = 1
query.type = {kind}
query.keywords = [Small, ring, qqqq]
query.numKeywords = 2
query.numMostFrequentTerms = 6
query.numQueries = 2
query.numWarmUpQueries = 1
query.numResults = 20
query.neighborhood = {rules}
query.radius = 0.05
query.alpha = 0.3
"""


def _configured(spark: SparkSession, sf_dir: str, build: str, search: str, rules: str = "1", kind: str = "custom") -> list[experiment.Outcome]:
    """The outcomes of a build and of searches whose configurations are read from files, over feature and object files."""
    fixed = {"folder": scratch_path(spark, "experiment"), "features": _feature_file(spark, sf_dir), "objects": _object_file(spark, sf_dir), "kind": kind, "rounds": 1}
    found = []
    for names, swept in ((build, "1"), (search, rules)):
        path = scratch_path(spark, "configuration")
        spark.createDataFrame([(CONFIG.format(names=names, rules=swept, **fixed),)], "value string").coalesce(1).write.text(path)
        found += experiment.run_all(spark, path, shared=True)
    return found


def _all_rows(found: list[experiment.Outcome]) -> DataFrame:
    """The results of all searches, with their rule."""
    searches = [o for o in found if o.postings]
    return reduce(DataFrame.unionByName, [o.rows.withColumn("rule", F.lit(o.config.neighbourhood)) for o in searches])


def config_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build and preference searches by every rule."""
    return _all_rows(_configured(spark, sf_dir, "S2IBuildIndex", "PreferenceSearch", "1;0;2"))


def config_if_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_rows(_configured(spark, sf_dir, "IFBuildIndex", "IFSearch"))


def config_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that blend distance and text, at drawn points."""
    return _all_rows(_configured(spark, sf_dir, "S2IBuildIndex", "S2ISearch")).drop("rule")


def config_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each query of a workload of frequent terms asked and read."""
    found = [o for o in _configured(spark, sf_dir, "S2IBuildIndex", "S2ISearch", kind="mostFrequent") if o.postings]
    asked = [sorted({r[0]: r[1] for r in o.rows.select("query_no", "keywords").distinct().collect()}.items()) for o in found]  # a row per query
    rows = [(no, " ".join(sorted(words.split())), n) for o, own in zip(found, asked, strict=True) for (no, words), n in zip(own, o.postings, strict=True)]
    return spark.createDataFrame(rows, "query_no int, keywords string, n_postings long")


SWEEP = "experiment.name = PreferenceSearch\nquery.neighborhood = 1;nn\nquery.numResults = 5;10\nexperiment.startRound=2\nexperiment.endRound=3\ndataset.featuresFile=/data/town-bars.txt\n! no\nquery.radius : 0.5\n"


def config_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiments that a configuration with several values stands for; no table is read."""
    made = [properties.config(p) for p in properties.sweep(properties.parse(SWEEP))]
    rows = [(c.name, c.neighbourhood, c.k, c.radius, c.round, c.seed, c.label) for c in made]
    return spark.createDataFrame(rows, "name string, rule string, k int, radius double, round int, seed long, label string")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("id") % 4).cast("int")
    return objects(spark, sf_dir).select("id", formulas.neighbourhood_name(n).alias("rule"), formulas.storage_bucket(F.col("id") * 12345).alias("bucket"), formulas.rendered(id=F.col("id"), code=n).alias("shown"))


def df_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("hand",), ("ther",), ("qqqq",)], "term string")
    found = weights.document_frequency(_tf(spark, sf_dir))
    return F.broadcast(asked).join(found, "term", "left").select("term", formulas.df_or_absent(F.col("df")).alias("df"))


def _workload(draw: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: draw(weights.document_frequency(_tf(spark, sf_dir)))


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a workload; no table is read."""
    return spark.createDataFrame(workload.query_points(10, 1.0, 7), "lat double, lon double")


QUERIES: dict[str, Query] = {
    "text_tokens": text_tokens,
    "term_frequency": _tf,
    "doc_length": lambda s, d: weights.doc_length(features(s, d)).select("id", F.col("num_words").cast("long").alias("num_words")),
    "doc_norm": lambda s, d: _rounded(weights.norms(features(s, d)), "norm"),
    "postings_impact": lambda s, d: _rounded(_postings(s, d), "impact"),
    "document_frequency": lambda s, d: weights.document_frequency(_tf(s, d)),
    "vocabulary_size": lambda s, d: weights.vocabulary_size(_tf(s, d)),
    "vocabulary_ids": vocabulary,
    "dataset_size": lambda s, d: weights.dataset_size(features(s, d)),
    "most_frequent_terms": lambda s, d: weights.most_frequent_terms(weights.document_frequency(_tf(s, d)), K),
    "df_lookup": df_lookup,
    "query_weights": query_weights,
    "theta_relevance": lambda s, d: _rounded(search.theta(_index(s, d), KEYWORDS), "theta"),
    "term_source": lambda s, d: _rounded(weights.term_source(_index(s, d, "hand").postings, "hand"), "impact"),
    "scored_source": scored_source,
    "mbr_keyword": lambda s, d: search.in_rectangle(_index(s, d), *RECT, KEYWORDS),
    "tksk_alpha": lambda s, d: search.blended(_index(s, d), *POINT, DIAGONAL, KEYWORDS, K, ALPHA),
    "skpq_range": preference("range"),
    "skpq_range_group": preference("range", True),
    "skpq_nn": preference("nn"),
    "skpq_nn_group": preference("nn", True),
    "skpq_influence": preference("influence"),
    "skpq_influence_group": preference("influence", True),
    "skpq_unknown_keyword": preference("influence", False, UNKNOWN),
    "objects_in_rectangle": lambda s, d: search.objects_in_rectangle(objects(s, d), *RECT),
    "distance_join": lambda s, d: spatial.distance_join(objects(s, d), features(s, d), RADIUS).withColumn("distance", formulas.rounded(F.col("distance"), PLACES)),
    "nearest_with_ties": lambda s, d: _rounded(spatial.nearest_with_ties(objects(s, d), features(s, d)), "distance"),
    "rect_min_distance": rect_min_distance,
    "index_build_stats": build_stats,
    "hot_terms": hot_terms,
    "cell_max_impact": cell_max_impact,
    "if_postings": if_postings,
    "if_search_range": if_search,
    "index_append": index_append,
    "feature_file": feature_file,
    "object_file": object_file,
    "line_numbers": line_numbers,
    "codes": codes,
    "index_reopened": index_reopened,
    "stored_lengths": stored_lengths,
    "stored_postings": stored_postings,
    "built_message": built_message,
    "feature_file_lower": feature_file_lower,
    "feature_file_first": feature_file_first,
    "objects_loaded_once": objects_loaded_once,
    "result_lines": result_lines,
    "near_equality": near_equality,
    "config_preference": config_preference,
    "config_if_search": config_if_search,
    "config_blended": config_blended,
    "config_statistics": config_statistics,
    "config_sweep": config_sweep,
    "random_keywords": _workload(lambda t: workload.random_keywords(t, 5, 7)),
    "frequent_keywords": _workload(lambda t: workload.frequent_keywords(t, 5, K, 7)),
    "proportional_keywords": _workload(lambda t: workload.proportional_keywords(t, 5, 7)),
    "query_points": query_points,
}


def _uniform(seed: int, *values: str) -> str:
    key = " || '|' || ".join(f"{v}::VARCHAR" for v in values)
    return f"((('0x' || substr(md5({key} || '|{seed}'), 1, 13))::BIGINT + 0.5e0) / 4503599627370496.0e0)"


_FEATURES = r"""
feat AS (SELECT doc_id AS id, ((doc_id * 5779) % 10007) / 10007.0e0 AS lat, ((doc_id * 3571) % 10009) / 10009.0e0 AS lon, text FROM documents),
lists AS (SELECT id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS t, text FROM feat),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM lists) GROUP BY id, term)"""
_OBJECTS = """
obj AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 10007) / 10007.0e0 AS lat, ((c_custkey * 6271) % 10009) / 10009.0e0 AS lon FROM customer)"""
_POSTINGS = """
norms AS (SELECT id, sqrt(sum((1 + ln(tf)) * (1 + ln(tf)))) AS norm FROM tf GROUP BY id),
post AS (SELECT tf.term, tf.id, feat.lat, feat.lon, (1 + ln(tf.tf)) / norms.norm AS impact FROM tf JOIN norms USING (id) JOIN feat USING (id)),
info AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def _weights(*terms: str) -> str:
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""
raw_qw AS (SELECT term, ln(1 + (SELECT count(*) FROM feat)::DOUBLE / df) AS qw FROM info WHERE term IN (SELECT * FROM (VALUES {values}))),
qw AS (SELECT term, qw, (SELECT sqrt(sum(qw * qw)) FROM raw_qw) AS ql FROM raw_qw),
theta AS (SELECT id, lat, lon, sum(impact * (qw / ql)) AS theta FROM post JOIN qw USING (term) GROUP BY id, lat, lon)"""


_QUERY = _weights("hand", "ther", "ering")
_DISTANCE = "sqrt((obj.lat - theta.lat) * (obj.lat - theta.lat) + (obj.lon - theta.lon) * (obj.lon - theta.lon))"


def _preference(score: str, weights_sql: str = _QUERY) -> str:
    return f"""
WITH {_FEATURES}, {_OBJECTS}, {_POSTINGS}, {weights_sql},
pairs AS (SELECT obj.id, theta.theta, {_DISTANCE} AS distance FROM obj CROSS JOIN theta),
best AS ({score})
SELECT obj.id, obj.lat, obj.lon, round(coalesce(best.score, 0.0e0), 9) AS score FROM obj LEFT JOIN best USING (id)
ORDER BY score DESC, obj.id DESC LIMIT {K}"""


_RANGE = _preference(f"SELECT id, max(theta) AS score FROM pairs WHERE distance <= {RADIUS} GROUP BY id")
_NN = _preference("SELECT id, max(theta) AS score FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY distance) AS r FROM pairs) WHERE r = 1 GROUP BY id")
_DECAYED = f"SELECT id, max(theta * pow(2.0e0, -distance / {RADIUS}e0)) AS score FROM pairs GROUP BY id"
_INFLUENCE = _preference(_DECAYED)
_INSIDE = f"lat BETWEEN {RECT[0]} AND {RECT[2]} AND lon BETWEEN {RECT[1]} AND {RECT[3]}"
_FROM_POINT = f"sqrt((lat - {POINT[0]}e0) * (lat - {POINT[0]}e0) + (lon - {POINT[1]}e0) * (lon - {POINT[1]}e0))"
_PAIR = "sqrt((obj.lat - feat.lat) * (obj.lat - feat.lat) + (obj.lon - feat.lon) * (obj.lon - feat.lon))"
_BLEND = f"{ALPHA}e0 * (1 - {_FROM_POINT} / sqrt(2.0e0))"

ORACLE_SQL: dict[str, str] = {
    "text_tokens": f"WITH {_FEATURES} SELECT id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest, len(t) > 0 AS has_tokens FROM lists",
    "term_frequency": f"WITH {_FEATURES} SELECT id, term, tf FROM tf",
    "doc_length": f"WITH {_FEATURES} SELECT id, len(t) AS num_words FROM lists WHERE len(t) > 0",
    "doc_norm": f"WITH {_FEATURES}, {_POSTINGS} SELECT id, round(norm, 9) AS norm FROM norms",
    "postings_impact": f"WITH {_FEATURES}, {_POSTINGS} SELECT term, id, lat, lon, round(impact, 9) AS impact FROM post",
    "document_frequency": f"WITH {_FEATURES}, {_POSTINGS} SELECT term, df FROM info",
    "vocabulary_size": f"WITH {_FEATURES} SELECT count(DISTINCT term) AS n_terms FROM tf",
    "vocabulary_ids": f"WITH {_FEATURES}, v AS (SELECT count(DISTINCT term) AS n FROM tf) SELECT n, n AS n_ids, 0::BIGINT AS least, n - 1 AS most FROM v",
    "dataset_size": "SELECT count(*) AS n_features FROM documents",
    "most_frequent_terms": f"WITH {_FEATURES}, {_POSTINGS} SELECT term, df FROM info ORDER BY df DESC, term LIMIT {K}",
    "df_lookup": f"WITH {_FEATURES}, {_POSTINGS} SELECT q.term, coalesce(df, -1) AS df FROM (VALUES ('hand'), ('ther'), ('qqqq')) q(term) LEFT JOIN info USING (term)",
    "query_weights": f"WITH {_FEATURES}, {_POSTINGS}, {_QUERY} SELECT term, round(qw, 9) AS qw, round(ql, 9) AS ql FROM qw",
    "theta_relevance": f"WITH {_FEATURES}, {_POSTINGS}, {_QUERY} SELECT id, lat, lon, round(theta, 9) AS theta FROM theta",
    "term_source": f"WITH {_FEATURES}, {_POSTINGS} SELECT term, id, lat, lon, round(impact, 9) AS impact FROM post WHERE term = 'hand' ORDER BY id",
    "scored_source": f"WITH {_FEATURES}, {_POSTINGS}, {_QUERY} SELECT term, id, lat, lon, round(impact * (qw / ql) + {_BLEND} / 3, 9) AS score FROM post JOIN qw USING (term)",
    "mbr_keyword": f"WITH {_FEATURES}, {_POSTINGS}, {_QUERY} SELECT id, lat, lon, round(theta, 9) AS score FROM theta WHERE {_INSIDE} ORDER BY score DESC, id DESC",
    "tksk_alpha": f"WITH {_FEATURES}, {_POSTINGS}, {_QUERY} SELECT id, lat, lon, round({_BLEND} + theta, 9) AS score, round({_FROM_POINT}, 9) AS distance FROM theta ORDER BY score DESC, id DESC LIMIT {K}",
    "skpq_range": _RANGE,
    "skpq_range_group": _RANGE,
    "skpq_nn": _NN,
    "skpq_nn_group": _NN,
    "skpq_influence": _INFLUENCE,
    "skpq_influence_group": _INFLUENCE,
    "skpq_unknown_keyword": _preference(_DECAYED, _weights("qqqq", "zzzz")),
    "objects_in_rectangle": f"WITH {_OBJECTS} SELECT id, lat, lon FROM obj WHERE {_INSIDE}",
    "distance_join": f"WITH {_FEATURES}, {_OBJECTS} SELECT obj.id AS object_id, feat.id AS feature_id, round({_PAIR}, 9) AS distance FROM obj CROSS JOIN feat WHERE {_PAIR} <= {RADIUS}",
    "nearest_with_ties": f"""
WITH {_FEATURES}, {_OBJECTS}, r AS (
    SELECT obj.id AS object_id, feat.id AS feature_id, {_PAIR} AS distance, rank() OVER (PARTITION BY obj.id ORDER BY {_PAIR}) AS k
    FROM obj CROSS JOIN feat
)
SELECT object_id, feature_id, round(distance, 9) AS distance FROM r WHERE k = 1""",
    "rect_min_distance": f"""
WITH {_OBJECTS}, g AS (
    SELECT id, greatest({RECT[0]}e0 - lat, lat - {RECT[2]}e0, 0.0e0) AS a, greatest({RECT[1]}e0 - lon, lon - {RECT[3]}e0, 0.0e0) AS b,
        greatest(lat - {RECT[0]}e0, {RECT[2]}e0 - lat) AS c, greatest(lon - {RECT[1]}e0, {RECT[3]}e0 - lon) AS d FROM obj
)
SELECT id, round(sqrt(a * a + b * b), 9) AS least, round(sqrt(c * c + d * d), 9) AS most FROM g""",
    "index_build_stats": f"""
WITH {_FEATURES}
SELECT count(*) AS n_features, sum(len(t))::BIGINT AS total_words, count(*) FILTER (len(t) > 0) AS dataset_lines, sum(len(list_distinct(t)))::BIGINT AS n_postings,
    (SELECT count(DISTINCT term) FROM tf) AS n_terms, (28 * sum(len(list_distinct(t))))::BIGINT AS list_bytes,
    round(avg(len(list_distinct(t))) FILTER (len(t) > 0), 6) AS avg_distinct_terms, round(avg(length(text)) FILTER (len(t) > 0), 6) AS avg_line_length
FROM lists""",
    "hot_terms": f"WITH {_FEATURES}, {_POSTINGS} SELECT term, df, df > 146 AS hot FROM info",
    "cell_max_impact": f"""
WITH {_FEATURES}, {_POSTINGS}
SELECT term, floor(lat * 8)::BIGINT AS cx, floor(lon * 8)::BIGINT AS cy, count(*) AS n, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon, round(max(impact), 9) AS max_impact
FROM post GROUP BY term, cx, cy""",
    "if_postings": f"WITH {_FEATURES}, {_POSTINGS} SELECT id, count(*) AS n_terms, round(sum(impact), 9) AS total FROM post GROUP BY id",
    "if_search_range": _RANGE,
    "index_append": f"WITH {_FEATURES}, {_POSTINGS} SELECT term, df, df > 146 AS hot, df AS n_postings, (SELECT count(*) FROM feat) AS n_features FROM info",
    "feature_file": "SELECT p_partkey::INTEGER AS id, ((p_partkey * 4099) % 10007) / 10007.0e0 AS lat, ((p_partkey * 8219) % 10009) / 10009.0e0 AS lon, p_name AS text FROM part",
    "object_file": f"WITH {_OBJECTS} SELECT id, lat, lon FROM obj",
    "line_numbers": "SELECT count(*) AS n, count(*) AS n_numbers, 1::BIGINT AS least, count(*) AS most, sum(c_custkey)::BIGINT AS total FROM customer",
    "codes": """
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'nn' WHEN 1 THEN 'range' WHEN 2 THEN 'influence' END AS rule,
    concat(c_custkey * 12345 // 1000000, '/', c_custkey * 12345 // 1000) AS bucket, concat('id=', c_custkey, ' code=', c_custkey % 4) AS shown
FROM customer""",
}

_SHORT = r"""
feat AS (SELECT p_partkey AS id, ((p_partkey * 4099) % 10007) / 10007.0e0 AS lat, ((p_partkey * 8219) % 10009) / 10009.0e0 AS lon, p_name AS text FROM part),
lists AS (SELECT id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS t, text FROM feat),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM lists) GROUP BY id, term)"""
_LINES = """
obj AS (SELECT row_number() OVER (ORDER BY c_custkey) AS id, ((c_custkey * 7919) % 10007) / 10007.0e0 AS lat, ((c_custkey * 6271) % 10009) / 10009.0e0 AS lon FROM customer)"""
_ASKED = _weights("small", "ring")
_CONFIG_SEED = properties.Config(features="features").seed  # of the feature file's folder and the first round


def _configured_sql(rules: dict[str, str]) -> str:
    """Preference searches of two queries of the same keywords, by rule."""
    ranked = "SELECT id, lat, lon, round(coalesce(score, 0.0e0), 9) AS score FROM obj LEFT JOIN ({}) USING (id) ORDER BY score DESC, id DESC LIMIT 20"
    one = " UNION ALL ".join(f"SELECT '{rule}' AS rule, * FROM ({ranked.format(sql)})" for rule, sql in rules.items())
    return f"""
WITH {_SHORT}, {_LINES}, {_POSTINGS}, {_ASKED},
pairs AS (SELECT obj.id, theta.theta, {_DISTANCE} AS distance FROM obj CROSS JOIN theta), found AS ({one})
SELECT q::INTEGER AS query_no, 'small ring qqqq' AS keywords, id, lat, lon, score, rule FROM found, range(2) t(q)"""


def _drawn_points(n: int, warm: int, seed: int) -> str:
    points = [(i - warm, *p) for i, p in enumerate(workload.query_points(n + warm, 1.0, seed)) if i >= warm]
    return ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, a, b in points)


_IN_RANGE = f"SELECT id, max(theta) AS score FROM pairs WHERE distance <= {RADIUS} GROUP BY id"
_NEAREST = "SELECT id, max(theta) AS score FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY distance) AS r FROM pairs) WHERE r = 1 GROUP BY id"
_FROM_QUERY = "sqrt((theta.lat - q.lat) * (theta.lat - q.lat) + (theta.lon - q.lon) * (theta.lon - q.lon))"

ORACLE_SQL |= {
    "random_keywords": f"WITH {_FEATURES}, {_POSTINGS} SELECT term FROM info ORDER BY {_uniform(7, 'term')}, term LIMIT 5",
    "frequent_keywords": f"WITH {_FEATURES}, {_POSTINGS} SELECT term FROM (SELECT term FROM info ORDER BY df DESC, term LIMIT {K}) ORDER BY {_uniform(7, 'term')}, term LIMIT 5",
    "proportional_keywords": f"WITH {_FEATURES}, {_POSTINGS} SELECT term FROM info ORDER BY -ln({_uniform(7, 'term')}) / df, term LIMIT 5",
    "query_points": f"SELECT {_uniform(7, 'i', chr(39) + 'lat' + chr(39))} AS lat, {_uniform(7, 'i', chr(39) + 'lon' + chr(39))} AS lon FROM range(10) t(i)",
    "index_reopened": f"WITH {_FEATURES}, {_POSTINGS} SELECT term, df, df > {SMALL_BLOCK // 32} AS hot FROM info",
    "stored_lengths": f"WITH {_FEATURES} SELECT id, len(t) AS num_words FROM lists WHERE len(t) > 0",
    "stored_postings": f"WITH {_FEATURES}, {_POSTINGS} SELECT term, id, lat, lon, round(impact, 9) AS impact, df FROM post JOIN info USING (term)",
    "built_message": "SELECT concat('indexed ', count(*), ' features') AS message FROM documents",
    "feature_file_lower": f"WITH {_SHORT} SELECT id::INTEGER AS id, lat, lon, lower(text) AS text FROM feat",
    "feature_file_first": f"WITH {_SHORT} SELECT id::INTEGER AS id, lat, lon, upper(text) AS text FROM feat ORDER BY id LIMIT 100",
    "objects_loaded_once": f"WITH {_LINES} SELECT id, lat, lon FROM obj",
    "result_lines": "SELECT concat(c_custkey, ' ', c_custkey % 4) AS line FROM customer",
    "near_equality": "SELECT c_custkey AS id, c_custkey % 3 < 2 AS same FROM customer",
    "config_preference": _configured_sql({"range": _IN_RANGE, "nn": _NEAREST, "influence": _DECAYED}),
    "config_if_search": _configured_sql({"range": _IN_RANGE}),
    "config_blended": f"""
WITH {_SHORT}, {_POSTINGS}, {_ASKED}, q(query_no, lat, lon) AS (VALUES {_drawn_points(2, 1, _CONFIG_SEED)}),
scored AS (SELECT query_no, id, theta.lat, theta.lon, round(0.3e0 * (1 - {_FROM_QUERY} / sqrt(2.0e0)) + theta, 9) AS score, round({_FROM_QUERY}, 9) AS distance FROM theta, q)
SELECT query_no::INTEGER AS query_no, 'small ring qqqq' AS keywords, id::INTEGER AS id, lat, lon, score, distance
FROM scored QUALIFY row_number() OVER (PARTITION BY query_no ORDER BY score DESC, id DESC) <= 20""",
    "config_statistics": f"""
WITH {_SHORT}, {_POSTINGS}, top AS (SELECT term, df FROM info ORDER BY df DESC, term LIMIT 6),
drawn AS ({" UNION ALL ".join(f"(SELECT {i} AS query_no, term, df FROM top ORDER BY {_uniform(_CONFIG_SEED + i + 1, 'term')}, term LIMIT 2)" for i in range(2))})
SELECT query_no::INTEGER AS query_no, string_agg(term, ' ' ORDER BY term) AS keywords, sum(df)::BIGINT AS n_postings FROM drawn GROUP BY query_no""",
    "config_sweep": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('PreferenceSearch', '{rule}', {k}::INTEGER, 0.5::DOUBLE, {n}::INTEGER, {properties.Config(features='town', round=n).seed}::BIGINT, 'PreferenceSearch-town-{rule}-k{k}-q1-r0.5-round{n}')"
        for rule in ("range", "nn") for k in (5, 10) for n in (2, 3)
    )
    + ") t(name, rule, k, radius, round, seed, label)",
}
