import math

import duckdb
import pytest
from pyspark.sql import functions as F

from nearword.functions import formulas


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [("Hotel-Bar, 3rd (floor)", ["hotel", "bar", "3rd", "floor"]), ("[hand, ther]", ["hand", "ther"]), ("ÉTÉ été", ["été", "été"]), ("", []), ("--", []), (None, None)],
)
def test_tokens(spark, text, expected):
    assert one(spark, formulas.tokens(F.lit(text).cast("string"))) == expected
    assert one(spark, formulas.has_tokens(F.lit(text).cast("string"))) == bool(expected)


def test_weights(spark):
    assert one(spark, formulas.term_weight(F.lit(3))) == pytest.approx(1 + math.log(3))
    assert one(spark, formulas.query_weight(F.lit(100), F.lit(4))) == pytest.approx(math.log(26))
    assert one(spark, formulas.textual_partial(F.lit(0.5), F.lit(3.0), F.lit(6.0))) == 0.25
    assert one(spark, formulas.spatial_partial(F.lit(25.0), 100, 0.4, 2)) == pytest.approx(0.15)
    assert one(spark, formulas.decay(F.lit(10.0), 5)) == 0.25
    assert formulas.space_diagonal(3.0) == pytest.approx(math.sqrt(18))


def test_distances(spark):
    lit = lambda *x: tuple(F.lit(float(v)) for v in x)
    assert one(spark, formulas.distance(*lit(0, 0, 3, 4))) == 5
    assert one(spark, formulas.rect_min_distance(lit(0, 0, 1, 1), lit(4, 5, 4, 5))) == 5
    assert one(spark, formulas.rect_min_distance(lit(0, 0, 1, 1), lit(0.5, 1, 2, 2))) == 0
    assert one(spark, formulas.rect_max_distance(lit(0, 0, 1, 1), lit(3, 4, 3, 4))) == 5
    assert one(spark, formulas.in_rect(F.lit(1.0), F.lit(2.0), 1.0, 0.0, 3.0, 2.0)) is True


def test_rounded_as_duckdb(spark):
    """Half steps and sums of squares of the grid that the queries' places lie on, to the last bit."""
    steps = [(k + 0.5) / 1e9 for k in range(0, 50_000_000, 99_991)]
    grid = [math.sqrt((i / 10007.0) ** 2 + (j / 10009.0) ** 2) for i in range(0, 500, 9) for j in range(0, 500, 7)]
    rows = spark.createDataFrame([(x,) for x in [0.0, *steps, *grid]], "x double")
    ours = [tuple(r) for r in rows.select("x", formulas.rounded(F.col("x"), 9)).collect()]
    assert ours == duckdb.execute("SELECT x, round(x, 9) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [[x for x, _ in ours]]).fetchall()
    assert one(spark, formulas.rounded(F.lit(None).cast("double"), 9)) is None


def test_codes(spark):
    assert [formulas.neighbourhood(x) for x in (0, "1", "influence", 2)] == ["nn", "range", "influence", "influence"]
    for wrong in (3, "circle", "7"):
        with pytest.raises(ValueError):
            formulas.neighbourhood(wrong)
    assert one(spark, formulas.neighbourhood_name(F.lit(9))) is None
    assert one(spark, formulas.storage_bucket(F.lit(12_345_678))) == "12/12345"
    assert one(spark, formulas.df_or_absent(F.lit(None).cast("long"))) == -1
    a = {"id": F.lit(1), "lat": F.lit(0.0), "lon": F.lit(0.0), "score": F.lit(0.5)}
    assert one(spark, formulas.nearly_equal(a, a | {"score": F.lit(0.5 + 1e-12)})) is True
    assert one(spark, formulas.nearly_equal(a, a | {"id": F.lit(2)})) is False
    assert one(spark, formulas.rendered(id=F.lit(4), score=F.lit(None).cast("double"))) == "id=4 score=null"
