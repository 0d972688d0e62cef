import pytest
from pyspark.sql import functions as F

from nearword.plans import experiment, index, workload
from nearword.sources import properties
from nearword.streaming import ingest

ROWS = [(1, 0.1, 0.1, "sea view sea"), (2, 0.2, 0.2, "old bar"), (3, 0.3, 0.3, ""), (4, 0.4, 0.4, "bar sea")]
SCHEMA = "id int, lat double, lon double, text string"


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def info(opened):
    return {r["term"]: r["df"] for r in opened.term_info.collect()}


def test_index_round_trip_and_append(spark, features, tmp_path):
    path = f"file://{tmp_path}/i"
    index.save(index.build(features.where("id < 3")), path)
    first = {r["term"]: r["term_id"] for r in index.open_index(spark, path).term_info.collect()}
    index.append(spark, path, features.where("id >= 3"))
    opened = index.open_index(spark, path)
    assert info(opened) == {"sea": 2, "view": 1, "old": 1, "bar": 2}
    assert opened.meta.first()["n_features"] == 4
    ids = {r["term"]: r["term_id"] for r in opened.term_info.collect()}
    assert sorted(ids.values()) == [0, 1, 2, 3] and all(ids[t] == i for t, i in first.items())
    whole = index.build(features)
    impacts = lambda i: {(r["term"], r["id"]): r["impact"] for r in i.named().collect()}
    assert opened.postings.columns == ["term_id", "id", "lat", "lon", "impact"]
    assert impacts(opened) == pytest.approx(impacts(whole))
    assert {r["id"]: r["num_words"] for r in opened.doc_length.collect()} == {1: 3, 2: 2, 4: 2}
    sizes = {r["name"]: r["bytes"] for r in index.stored_bytes(spark, path).collect()}
    assert sizes.pop("total") == sum(sizes.values()) and all(sizes.values())


def test_hot_terms(spark):
    assert index.most_in_block() == 146
    df = spark.createDataFrame([(146,), (147,)], "df int")
    assert [r[0] for r in df.select(index.hot(F.col("df"))).collect()] == [False, True]
    assert index.most_in_block(4096, "if") == 128


def test_build_options(spark, features):
    assert index.build(features, most=2).meta.first()[0] == 2
    with pytest.raises(Exception, match="repeated id"):
        index.build(features.union(features.limit(1)), unique=True).postings.collect()
    with pytest.raises(ValueError):
        index.build(features, "tree")
    stored = index.compacted(index.build(features, "if"))
    assert dict(stored.dtypes)["id"] == "bigint" and stored.count() == 6
    stats = index.build_stats(features).first()
    assert (stats["n_features"], stats["total_words"], stats["dataset_lines"], stats["n_terms"], stats["list_bytes"]) == (4, 7, 3, 4, 168)
    assert index.build(features.limit(0)).postings.count() == 0


def test_kind_and_block_size_are_stored(spark, tmp_path):
    """A term that is hot when built is hot when the index is opened again, and after an append."""
    rows = spark.createDataFrame([(i, 0.1, 0.1, "sea") for i in range(140)], SCHEMA)
    path = f"file://{tmp_path}/i"
    built = index.build(rows, "if")
    index.save(built, path)
    assert built.term_info.first()["hot"] and index.open_index(spark, path).term_info.first()["hot"]
    index.append(spark, path, spark.createDataFrame([(500 + i, 0.1, 0.1, "bar") for i in range(140)], SCHEMA))
    opened = index.open_index(spark, path)
    assert (opened.kind, opened.block_size) == ("if", 4096) and all(r["hot"] for r in opened.term_info.collect())


def test_only_whole_writes_count(spark, features, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/i"
    with pytest.raises(FileNotFoundError):
        index.open_index(spark, path)
    index.save(index.build(features.where("id < 3")), path)
    with pytest.raises(FileExistsError):
        index.save(index.build(features), path)
    root = index.current(spark, path)
    index.append(spark, path, features.where("id = 3"), "a")
    index.remove(spark, f"{root}/meta/batch=a")  # an append that stopped before its meta
    opened = index.open_index(spark, path)
    assert opened.meta.first()[0] == 2 and info(opened) == {"sea": 1, "view": 1, "old": 1, "bar": 1}
    assert {r["id"] for r in opened.postings.collect()} == {1, 2}

    def broken(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(index, "_clustered", broken)
        with pytest.raises(RuntimeError, match="stopped"):
            index.save(index.build(features), path, "overwrite")
    assert index.open_index(spark, path).meta.first()[0] == 2  # the old one is still there
    index.save(index.build(features), path, "overwrite")
    assert index.open_index(spark, path).meta.first()[0] == 4 and index.current(spark, path) != root
    with pytest.raises(ValueError):
        index.save(index.build(features), path, "append")


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from nearword.plans import scratch

    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master, getConf = "spark://a:7077", staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_base(Session)
    path = scratch.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    monkeypatch.setattr(scratch, "_made", {path: spark})
    scratch.clear()
    files, made = scratch.store(spark, path)
    assert not files.exists(made(path))


def test_workload(spark, features):
    terms = index.build(features).term_info.persist()
    assert [r[0] for r in workload.frequent_keywords(terms, 2, 2, 1).collect()] in (["bar", "sea"], ["sea", "bar"])
    assert workload.random_keywords(terms, 9, 1).count() == 4
    a, b = (workload.queries(terms, "random", 3, 2, 5) for _ in range(2))
    assert a == b and len({q.keywords for q in a}) >= 1 and all(0 <= q.lat < 10000 for q in a)
    assert workload.queries(terms, "custom", 1, 0, 5, "[Sea, bar, sea]")[0].keywords == "sea bar"
    with pytest.raises(ValueError):
        workload.queries(terms, "other", 1, 1, 1)
    many = spark.createDataFrame([(f"t{i}", 1) for i in range(50)] + [("common", 5000)], "term string, df long")
    assert sum(workload.proportional_keywords(many, 1, s).first()[0] == "common" for s in range(12)) >= 10


def test_experiments(spark, tmp_path):
    (tmp_path / "town-bars.txt").write_text("".join(f"{i} {a} {b} {t or 'x'}\n" for i, a, b, t in ROWS))
    (tmp_path / "town-hotels.txt").write_text("9 0.11 0.1 H\n8 0.4 0.41 G\n7 0.9 0.9 F\n")
    lines = ["experiment.name = S2IBuildIndex;PreferenceSearch", f"experiment.folder = {tmp_path}/run", f"experiment.output = file://{tmp_path}/out", f"dataset.featuresFile = {tmp_path}/town-bars.txt", f"dataset.objectsFile = {tmp_path}/town-hotels.txt"]
    lines += ["query.type = custom", "query.keywords = sea", "query.neighborhood = 1;0", "query.radius = 0.05", "query.numWarmUpQueries = 1", "query.numResults = 2"]
    (tmp_path / "p.properties").write_text("\n".join(lines))
    out = experiment.run_all(spark, str(tmp_path / "p.properties"))
    assert [o.config.name for o in out] == ["S2IBuildIndex"] * 2 + ["PreferenceSearch"] * 2
    assert out[0].rows.first()[0] == "indexed 4 features"
    ranged = out[2].rows.collect()
    assert [(r["query_no"], r["id"]) for r in ranged] == [(0, 1), (0, 2)] and ranged[0]["score"] > ranged[1]["score"] > 0
    assert len(out[2].seconds) == 1 and out[2].average_ms > 0
    assert spark.read.text(f"file://{tmp_path}/out").count() == 4
    blended = experiment.run(spark, properties.Config(name="S2ISearch", folder=f"{tmp_path}/run", features=f"{tmp_path}/town-bars.txt", query_type="custom", keywords="sea", k=3, space_max=1.0))
    assert [r["id"] for r in blended.rows.collect()] and blended.rows.columns[-2:] == ["score", "distance"] and blended.postings == [2]
    with pytest.raises(ValueError):
        experiment.run(spark, properties.Config(name="Other"))


def test_streamed_index(spark, features, tmp_path):
    path, source = f"file://{tmp_path}/i", f"file://{tmp_path}/in"
    index.save(index.build(features.where("id < 3")), path)
    features.where("id >= 3").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(features.schema).parquet(source)
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest(stream, path, f"file://{tmp_path}/check").awaitTermination()
    ingest.append_batch(path)(features.where("id >= 3"), 0)  # a batch that is replayed counts once
    opened = index.open_index(spark, path)
    assert info(opened) == {"sea": 2, "view": 1, "old": 1, "bar": 2} and opened.meta.first()[0] == 4
