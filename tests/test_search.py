import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearword.functions import formulas
from nearword.operators import search, spatial, weights
from nearword.plans import index

WORDS = ["bar", "cafe", "pool", "sea", "view", "old"]


def made(seed, n):
    r = random.Random(seed)
    return [(i, round(r.random(), 2), round(r.random(), 2), " ".join(r.choices(WORDS, k=r.randint(0, 6)))) for i in range(n)]


def thetas(rows, query):
    tf = {i: Counter(re.findall(r"\w+", text.lower())) for i, _, _, text in rows}
    df = Counter(t for c in tf.values() for t in c)
    qw = {t: math.log(1 + len(rows) / df[t]) for t in set(query.split()) if df[t]}
    ql = math.sqrt(sum(w * w for w in qw.values()))
    out = {}
    for i, lat, lon, _ in rows:
        norm = math.sqrt(sum((1 + math.log(k)) ** 2 for k in tf[i].values()))
        if hit := [t for t in qw if tf[i][t]]:
            out[i] = (lat, lon, sum((1 + math.log(tf[i][t])) / norm * qw[t] / ql for t in hit))
    return out


def brute(objects, theta, rule, radius):
    out = {}
    for i, lat, lon in objects:
        near = [(math.sqrt((lat - a) ** 2 + (lon - b) ** 2), t) for a, b, t in theta.values()]
        if rule == "range":
            score = max((t for d, t in near if d <= radius), default=0.0)
        elif rule == "nn":
            score = max((t for d, t in near if d == min(near)[0]), default=0.0)
        else:
            score = max((t * 2 ** (-d / radius) for d, t in near), default=0.0)
        out[i] = score
    return out


@pytest.fixture(scope="module")
def world(spark):
    rows = made(3, 150)
    objects = [(i, round(random.Random(i).random(), 2), round(random.Random(-i).random(), 2)) for i in range(60)]
    features = spark.createDataFrame(rows, "id int, lat double, lon double, text string")
    return rows, objects, index.build(features).persisted(), spark.createDataFrame(objects, "id int, lat double, lon double").persist()


@pytest.mark.parametrize("rule", ["range", "nn", "influence"])
@pytest.mark.parametrize("grouped", [False, True])
def test_preference(world, rule, grouped):
    rows, objects, built, frame = world
    found = search.preference(built, frame, "[sea, view]", rule, 0.1, None, grouped).collect()
    expected = brute(objects, thetas(rows, "sea view"), rule, 0.1)
    assert {r["id"]: r["score"] for r in found} == pytest.approx(expected, abs=1e-8)
    assert [(r["score"], r["id"]) for r in found] == sorted(((r["score"], r["id"]) for r in found), reverse=True)


def test_prefixes_and_bounds(world):
    _, objects, built, frame = world
    top = [search.preference(built, frame, "sea", "range", r, k).collect() for r, k in ((0.05, 5), (0.05, 12), (0.2, None))]
    assert top[1][:5] == top[0]
    wide = {r["id"]: r["score"] for r in top[2]}
    assert all(wide[r["id"]] >= r["score"] for r in top[1])
    assert len(search.preference(built, frame, "sea", "nn", 0.1, 1000).collect()) == len(objects)
    unknown = search.preference(built, frame, "zzz", "nn", 0.1, 3).collect()
    assert [(r["id"], r["score"]) for r in unknown] == [(59, 0.0), (58, 0.0), (57, 0.0)]
    with pytest.raises(ValueError):
        search.preference(built, frame, "sea", "circle", 0.1)
    with pytest.raises(ValueError):
        search.preference(built, frame, "sea", "influence", 0.0)


def test_blended_and_rectangle(world):
    rows, _, built, _ = world
    theta = thetas(rows, "bar pool")
    found = search.blended(built, 0.3, 0.4, 2.0, "bar pool bar", None, 0.5).collect()
    expected = {i: 0.5 * (1 - math.dist((0.3, 0.4), (a, b)) / 2) + t for i, (a, b, t) in theta.items()}
    assert {r["id"]: r["score"] for r in found} == pytest.approx(expected, abs=1e-8)
    inside = search.in_rectangle(built, 0.2, 0.2, 0.6, 0.5, "bar pool").collect()
    assert {r["id"]: r["score"] for r in inside} == pytest.approx({i: t for i, (a, b, t) in theta.items() if 0.2 <= a <= 0.6 and 0.2 <= b <= 0.5}, abs=1e-8)


def test_hand_computed_weights(spark):
    rows = spark.createDataFrame([(1, "a a b"), (2, "b"), (3, ""), (4, None)], "id int, text string")
    tf = weights.term_frequency(rows)
    assert sorted(tuple(r) for r in tf.collect()) == [(1, "a", 2), (1, "b", 1), (2, "b", 1)]
    wa = 1 + math.log(2)
    impact = {(r["id"], r["term"]): r["impact"] for r in weights.postings(rows).collect()}
    assert impact == pytest.approx({(1, "a"): wa / math.hypot(wa, 1), (1, "b"): 1 / math.hypot(wa, 1), (2, "b"): 1.0})
    assert weights.dataset_size(rows).first()[0] == 4
    assert sorted(tuple(r) for r in weights.doc_length(rows).collect()) == [(1, 3), (2, 1)]


coordinate = st.integers(0, 8).map(lambda x: x / 8)
point = st.tuples(coordinate, coordinate)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(point, max_size=8), st.lists(st.tuples(point, st.integers(1, 5)), max_size=12), st.sampled_from([0.125, 0.3]))
def test_joins_equal_all_pairs(spark, places, scored, radius):
    objects = [(i, *p) for i, p in enumerate(places)]
    feats = [(i, *p, float(t)) for i, (p, t) in enumerate(scored)]
    o = spark.createDataFrame(objects, "id int, lat double, lon double")
    f = spark.createDataFrame(feats, "id int, lat double, lon double, theta double")
    pairs = {(r[0], r[1]) for r in spatial.distance_join(o, f, radius).collect()}
    assert pairs == {(a[0], b[0]) for a in objects for b in feats if math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= radius}
    theta = {b[0]: b[1:] for b in feats}
    for rule in ("range", "nn", "influence"):
        for grouped in (False, True):
            got = {r["id"]: r["score"] for r in spatial.best_neighbour(o, f, rule, radius, grouped).collect()}
            assert {k: got.get(k, 0.0) for k in range(len(objects))} == pytest.approx(brute(objects, theta, rule, radius), abs=1e-9)


def test_nearest_with_ties_and_nulls(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, None, 0.0)], "id int, lat double, lon double")
    f = spark.createDataFrame([(10, 0.0, 0.5), (11, 0.5, 0.0), (12, 0.9, 1.0), (13, None, None)], "id int, lat double, lon double")
    assert sorted(tuple(r) for r in spatial.nearest_with_ties(o, f).collect()) == [(1, 10, 0.5), (1, 11, 0.5), (2, 12, pytest.approx(0.1))]
    assert spatial.nearest_with_ties(o, f.limit(0)).collect() == []
    assert sorted(r["object_id"] for r in spatial.distance_join(o, f.union(spark.createDataFrame([(14, 0.0, 0.0)], f.schema)), 0.0).collect()) == [1]


def test_many_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """One spot has nearly all rows; they're a few bytes, but their pairs go to more than one task, each pair once."""
    r = random.Random(4)
    spot = lambda i: (0.5 + r.random() / 100, 0.5 + r.random() / 100) if i % 10 else (r.random(), r.random())
    objects = [(i, *spot(i)) for i in range(150)] + [(7, 0.5, 0.5)] * 2 + [(None, 0.5, 0.5)]
    feats = [(i, *spot(i)) for i in range(400)] + [(7, 0.5, 0.51), (7, 0.5, 0.51)]
    o, f = (spark.createDataFrame(rows, "id int, lat double, lon double") for rows in (objects, feats))
    expected = Counter((a[0], b[0]) for a in objects for b in feats if math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= 0.05)
    assert len(expected) > 40_000
    for broadcast in (100, 0):
        for name, value in (("MANY_PAIRS", 10_000), ("BLOCK", 64), ("BROADCAST_CELLS", broadcast)):
            monkeypatch.setattr(spatial, name, value, raising=False)
        joined = spatial.distance_join(o, f, 0.05)
        dealt = [x["n"] for x in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(dealt) > 5 and max(dealt) < len(expected) / 3, dealt
        assert Counter((x[0], x[1]) for x in joined.collect()) == expected


def test_pairs_of_a_grid_take_few_bytes(spark, monkeypatch, tmp_path):
    """All pairs are written, and distances that recur are in dictionaries: stored one by one they took 8 bytes a row."""
    place = lambda a, b: [(F.col("id") * a % 2003 / F.lit(10007.0)).alias("lat"), (F.col("id") * b % 1999 / F.lit(10009.0)).alias("lon")]
    o, f = (spark.range(4000).select("id", *place(*ab)) for ab in ((7919, 6271), (5779, 3571)))
    monkeypatch.setattr(spatial, "MANY_PAIRS", 10_000)
    spatial.distance_join(o, f, 0.05).withColumn("distance", formulas.rounded(F.col("distance"), 9)).write.parquet(f"{tmp_path}/pairs")
    files = [pq.ParquetFile(p).metadata for p in tmp_path.glob("pairs/*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    dist = formulas.distance(F.col("o.lat"), F.col("o.lon"), F.col("f.lat"), F.col("f.lon"))
    digest = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("object_id", "feature_id"))]
    crossed = o.alias("o").crossJoin(f.alias("f")).where(dist <= 0.05).select(F.col("o.id").alias("object_id"), F.col("f.id").alias("feature_id"))
    assert spark.read.parquet(f"{tmp_path}/pairs").agg(*digest).first() == crossed.agg(*digest).first()
    assert sum(g.column(2).total_compressed_size for g in groups) < 4 * sum(g.num_rows for g in groups)


def test_skewed_places(spark):
    """All features in one spot but one far away."""
    f = spark.createDataFrame([(i, 0.5, 0.5, i / 100) for i in range(100)] + [(100, 1000.0, 1000.0, 5.0)], "id int, lat double, lon double, theta double")
    o = spark.createDataFrame([(1, 0.5, 0.5), (2, 900.0, 900.0), (3, 0.5, 0.51)], "id int, lat double, lon double")
    assert {r[0]: r[1] for r in spatial.best_neighbour(o, f, "nn", 0.0).collect()} == {1: 0.99, 2: 5.0, 3: 0.99}
    assert {r[0]: r[1] for r in spatial.best_neighbour(o, f, "range", 0.01).collect()} == {1: 0.99} | ({3: 0.99} if 0.51 - 0.5 <= 0.01 else {})


def test_repeated_ids_are_one_text(spark):
    rows = spark.createDataFrame([(1, 0.2, 0.0, "a b"), (1, 0.1, 0.0, "a"), (2, 0.0, 0.0, "b"), (None, 0.0, 0.0, "c"), (None, 0.0, 0.0, "c d"), (3, 0.0, 0.0, None), (3, 0.0, 0.0, "")], "id int, lat double, lon double, text string")
    assert sorted(map(str, weights.term_frequency(rows).collect())) == sorted(map(str, weights.text_tokens(rows).groupBy("id", "term").count().withColumnRenamed("count", "tf").collect()))
    wa = 1 + math.log(2)
    found = {(r["id"], r["term"]): (r["lat"], r["impact"]) for r in weights.postings(rows).collect()}
    assert found[1, "a"] == (0.1, pytest.approx(wa / math.hypot(wa, 1))) and found[2, "b"] == (0.0, 1.0) and len(found) == 5
    assert {r["id"]: r["norm"] for r in weights.norms(rows).collect()}[1] == pytest.approx(math.hypot(wa, 1))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab1é -,", max_size=14), max_size=8))
def test_counts_equal_a_counter(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    expected = {(i, t): n for i, text in enumerate(texts) for t, n in Counter(re.findall(r"[^\W_]+", text.lower())).items()}
    assert {(r["id"], r["term"]): r["tf"] for r in weights.term_frequency(rows).collect()} == expected


def test_texts_are_not_shuffled(spark):
    rows = spark.createDataFrame(made(5, 50), "id int, lat double, lon double, text string")
    plan = weights.postings(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index.for_query(rows, "sea view")


@pytest.mark.parametrize("grouped", [False, True])
def test_equal_scores_form_few_pairs(spark, grouped):
    """What an object meets doesn't grow with the number of features that have one score."""
    r = random.Random(2)
    o = spark.createDataFrame([(i, r.random(), r.random()) for i in range(300)], "id int, lat double, lon double").persist()
    met = []
    for n in (2000, 32000):
        f = spark.createDataFrame([(r.random(), r.random(), 1.0) for _ in range(n)], "lat double, lon double, theta double").persist()
        tree = spatial.Quadtree(f)
        cells = spatial.reached(tree, o.distinct(), "range", 0.3, grouped).persist()
        met.append(cells.join(tree.features, ["ix", "iy"]).count() / 300)
        assert {x["score"] for x in spatial.best_neighbour(o, f, "range", 0.3, grouped).collect()} == {1.0}
    assert max(met) < 40, met


def test_dense_features_make_the_tree_deeper(spark):
    r = random.Random(3)
    f = spark.createDataFrame([(0.5 + r.random() * 1e-4, 0.5 + r.random() * 1e-4, r.random()) for _ in range(6000)] + [(0.0, 0.0, 0.5), (1.0, 1.0, 0.5)], "lat double, lon double, theta double")
    tree = spatial.Quadtree(f)
    assert tree.features.groupBy("ix", "iy").count().agg({"count": "max"}).first()[0] <= spatial.FULLEST
