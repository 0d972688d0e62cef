import pytest

from nearword.sources import properties, text

FEATURES = "1 0.5 0.25 (bar) Blue Note\n2 0.5 east Wrong number\nx 0.5 0.5 wrong id\n3 0.1 0.2\n\n4 -1.5 2e0  double blank\n"
OBJECTS = "77 0.5 0.25 (hotel) A\n78\t0.75   0.5\nname 0.1 0.2 no number\n79 here there\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "f.txt").write_text(FEATURES, encoding="utf-8")
    (tmp_path / "o.txt").write_text(OBJECTS, encoding="utf-8")
    return str(tmp_path)


def test_features(spark, files):
    assert [tuple(r) for r in text.read_features(spark, f"{files}/f.txt").collect()] == [(1, 0.5, 0.25, "(bar) Blue Note"), (4, -1.5, 2.0, " double blank")]
    assert text.read_features(spark, f"{files}/f.txt", lower=True).first()["text"] == "(bar) blue note"
    assert {r[0] for r in text.rejected_features(spark, f"{files}/f.txt").collect()} == {"2 0.5 east Wrong number", "x 0.5 0.5 wrong id", "3 0.1 0.2", ""}
    assert text.read_features(spark, f"{files}/f.txt", most=1).count() == 1
    with pytest.raises(Exception, match="not a feature"):
        text.read_features(spark, f"{files}/f.txt", mode="failfast").collect()
    with pytest.raises(ValueError):
        text.read_features(spark, f"{files}/f.txt", mode="other")


def test_objects(spark, files):
    by_line = text.read_objects(spark, f"{files}/o.txt")
    assert sorted(tuple(r) for r in by_line.collect()) == [(1, 0.5, 0.25), (2, 0.75, 0.5), (3, 0.1, 0.2)]
    assert sorted(r[0] for r in text.read_objects(spark, f"{files}/o.txt", "src_id").collect()) == [77, 78]
    assert [tuple(r) for r in text.rejected_objects(spark, f"{files}/o.txt").collect()] == [(4, "79 here there")]
    table = f"file://{files}/objects"
    text.load_objects_once(spark, f"{files}/o.txt", table)
    with open(f"{files}/o.txt", "w") as f:
        f.write("1 0 0\n")
    assert text.load_objects_once(spark, f"{files}/o.txt", table).count() == 3


def test_line_numbers_over_several_partitions(spark, tmp_path):
    lines = [f"line {i}" for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = text.numbered_lines(spark, str(tmp_path / "a.txt"))
        assert sorted((r[0], r[1]) for r in rows.collect()) == [(i + 1, x) for i, x in enumerate(lines)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_append_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "name string, n int")
    for _ in range(2):
        text.append_rows(rows, f"file://{tmp_path}/out")
    assert sorted(r[0] for r in spark.read.text(f"file://{tmp_path}/out").collect()) == ["a 1", "a 1"]


def test_properties():
    parsed = properties.parse("# no\nquery.neighborhood = 1;0\nquery.radius=0.5\nexperiment.name= IFSearch\n\nexperiment.startRound=1\nexperiment.endRound=2\nexperiment.plusMode = true\nodd.key: x y\n")
    assert parsed["odd.key"] == "x y"
    made = [properties.config(p) for p in properties.sweep(parsed)]
    assert [(c.neighbourhood, c.round) for c in made] == [("range", 1), ("range", 2), ("nn", 1), ("nn", 2)]
    assert made[0].grouped and made[0].name == "IFSearch" and made[0].radius == 0.5 and made[0].other["odd.key"] == "x y"
    assert made[0].seed == made[2].seed != made[1].seed
    assert properties.dataset_name("/a/b/harbour-inns.txt") == "harbour"
    with pytest.raises(ValueError):
        properties.config({"query.neighborhood": "5"})
