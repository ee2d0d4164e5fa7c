import math

import pytest
from pyspark.sql import functions as F

from noisemill.functions import codec
from noisemill.spec import Categorical, Numerical


def values(spark, rows, kind, expr):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expr.alias("y")).orderBy("i").select("y").collect()]


@pytest.mark.parametrize(
    "a, kind, rows, codes",
    [
        (Numerical(0, 10, (5.0,)), "double", [1.0, 5.0, 5.00001, 8.0, -1.0, 11.0], [0, 0, 1, 1, 0, 1]),
        (Numerical(0, 10, (5.0,), clip=False), "double", [5.0, 8.0, -1.0, 11.0, math.nan, None], [1, 2, 0, 0, 0, 0]),
        (Numerical(0, 100, (25.0, 50.0, 75.0)), "double", [10.0, 25.0, 50.0, 75.0, 90.0, math.inf, -math.inf], [0, 0, 1, 2, 3, 3, 0]),
        (Numerical(0, 10, (5.0,), integer=True), "int", [0, 5, 6, 10], [0, 0, 1, 1]),
        (Numerical(0, 10), "double", [1.0, 5.0], [0, 0]),
        (Numerical(0, 10, (5.0,)), "string", ["A", None, "7"], [0, 0, 1]),
    ],
)
def test_bins(spark, a, kind, rows, codes):
    assert values(spark, rows, kind, codec.discretize("x", a)) == codes


def test_standardize_rounds_halves_to_even(spark):
    a = Numerical(0, 10, integer=True)
    assert values(spark, [2.5, 3.5, None, math.nan, 12.0], "double", codec.standardize_numeric("x", a)) == [2, 4, 0, 0, 10]


def test_undiscretize(spark):
    a = Numerical(0, 9, (4.0,), integer=True)
    assert values(spark, [0, 1], "int", codec.undiscretize("x", a)) == [2, 7]
    open_ = Numerical(0, 9, (4.0,), clip=False, decode="interval")
    assert values(spark, [0, 1, 2], "int", codec.undiscretize("x", open_)) == ["", "[0, 4.0]", "(4.0, 9]"]
    drawn = values(spark, [0, 1], "int", codec.undiscretize("x", Numerical(0, 10, (5.0,), decode="sample"), "i"))
    assert 0 <= drawn[0] <= 5 <= drawn[1] <= 10


def test_labels():
    assert Numerical(1, 9, (4.0,), integer=True).labels() == ["[1, 4]", "[5, 9]"]
    assert Numerical(0, 9, (4.0,), clip=False).labels()[0] == "OUT_OF_DOMAIN"


def test_categories(spark):
    a = Categorical((0, 1, 2), ood=2)
    assert values(spark, ["1", "x", None], "string", codec.encode_categorical("x", a)) == [1, 2, 2]
    many = Categorical(tuple(f"v{k}" for k in range(100)))
    assert values(spark, ["v99", "v0", "w"], "string", codec.encode_categorical("x", many)) == [99, 0, 0]
    assert values(spark, [0, 2], "int", codec.decode_categorical("x", a)) == [0, 2]


def test_rare_codes(spark):
    mask = [True, False, True, False]
    assert values(spark, [0, 1, 2, 3], "int", codec.merge_rare("x", mask)) == [0, 2, 1, 2]
    assert values(spark, [0, 1, 2], "int", codec.unmerge_rare("x", mask)) == [0, 2, 1]
    back = values(spark, [2] * 50, "int", codec.unmerge_rare("x", mask, "i"))
    assert set(back) == {1, 3}


def test_linear_index_last_is_fastest(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert df.select(codec.linear_index(["a", "b"], [2, 3])).first()[0] == 5


def test_bad_specs():
    for bad in (lambda: Numerical(1, 1), lambda: Numerical(0, 1, (2.0,)), lambda: Categorical(()), lambda: Categorical((1, "a")), lambda: Categorical(("a", None))):
        with pytest.raises(ValueError):
            bad()


def test_grid_keeps_null(spark):
    assert values(spark, [2.5, 3.5, None, 99.0], "double", codec.grid_index("x", 0, 10, 1.0)) == [2, 4, None, 10]


def test_uniform_is_the_same_in_any_partitioning(spark):
    df = spark.range(100).select("id", codec.uniform("id", seed=3).alias("u"))
    assert df.orderBy("id").collect() == df.repartition(7).orderBy("id").collect()
    assert 0.3 < df.agg(F.avg("u")).first()[0] < 0.7


def test_many_values_are_joined_without_touching_clashing_names(spark):
    a = Categorical(tuple(range(1200)), ood=7)
    df = spark.createDataFrame([(3, "x", "y"), (5000, "x", "y"), (None, "x", "y"), (3, "x", "y")], "k long, _code string, _code_of_k string")
    rows = codec.encode_table(df, {"k": a}, ("_code", "_code_of_k")).collect()
    assert sorted(r.k for r in rows) == [3, 3, 7, 7]
    assert {(r._code, r._code_of_k) for r in rows} == {("x", "y")}
    assert codec.encode_table(df.limit(0), {"k": a}).count() == 0


def test_reversible_inverse_undoes_in_turn(spark):
    to = codec.coded(Categorical(("a", "b", "c"))).then(codec.merged([True, True, False]))
    df = spark.createDataFrame([("b",), ("c",), ("z",), (None,)], "v string")
    assert [r[0] for r in df.select(to.inverse()(to("v"))).collect()] == ["b", "c", "a", "a"]
