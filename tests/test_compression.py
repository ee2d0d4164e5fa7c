import numpy as np
from pyspark.sql import functions as F

from noisemill.operators.compression import Compression, find_compression
from noisemill.plans import synthesis
from noisemill.spec import Categorical


def test_rare_codes_are_found_and_counted():
    noisy = {"a": np.array([50.0, 2.0, 40.0, -1.0, 3.0]), "b": np.array([50.0, 2.0]), "c": np.array([1.0, 2.0, 0.0])}
    found = find_compression(noisy, 10.0, {"c"})
    assert found.masks == {"a": [True, False, True, False, False]}  # b would save no code, c keeps its own
    assert found.counts("a", noisy["a"]).tolist() == [50.0, 40.0, 4.0] and found.counts("b", noisy["b"]).tolist() == [50.0, 2.0]
    small = found.schema({"a": Categorical(tuple("vwxyz")), "b": Categorical(("p", "q"))})
    assert small["a"].size == 3 and small["b"].size == 2
    assert find_compression({"a": np.zeros(4)}, 1.0).masks == {"a": [False] * 4}


def test_there_and_back(spark):
    rare = Compression({"a.x": [True, False, True, False, False]})
    df = spark.range(5000).select("id", (F.col("id") % 5).cast("int").alias("a.x"), F.lit(1).alias("b"))
    df = df.unionByName(spark.sql("select -1L id, cast(null as int) `a.x`, 2 b"))
    small = rare.compress(df)
    assert small.columns == df.columns and {r["a.x"] for r in small.collect()} == {0, 1, 2, None}
    one, two = (rare.uncompress(small.repartition(n, "b"), "id", seed=3).orderBy("id").collect() for n in (1, 7))
    assert one == two  # a draw hangs on the row alone
    for r in one[1:]:
        assert r["a.x"] == r["id"] % 5 if r["id"] % 5 in (0, 2) else r["a.x"] in (1, 3, 4)
    drawn = np.bincount([r["a.x"] for r in one[1:]], minlength=5)[[1, 3, 4]]
    assert one[0]["a.x"] is None and drawn.sum() == 3000 and abs(drawn - 1000).max() < 120
    assert {r["a.x"] for r in rare.uncompress(small.where("id >= 0")).collect()} == {0, 1, 2}
    assert rare.compress(df.where("false")).count() == 0


def test_counts_that_find_rare_codes_are_paid_for_once(spark, monkeypatch):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "a").when(F.col("id") % 400 == 1, F.concat(F.lit("r"), F.col("id") % 7)).otherwise("b").alias("x"), F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("y"))
    schema = {"x": Categorical(("a", "b", *(f"r{k}" for k in range(7)))), "y": Categorical(("p", "q"))}
    asked = []
    real = synthesis.noisy_columns
    monkeypatch.setattr(synthesis, "noisy_columns", lambda codes, some, *rest: asked.append(sorted(some)) or real(codes, some, *rest))
    made = synthesis.synthesize(df, schema, 50.0, 1e-6, seed=1, compress=True)
    n = {tuple(r)[:2]: r["n"] for r in made.groupBy("x", "y").agg(F.count("*").alias("n")).collect()}
    assert asked == [["x", "y"]]
    assert abs(n[("a", "p")] - 2000) < 150 and abs(n[("b", "q")] - 1990) < 150
    assert sum(v for (x, y), v in n.items() if (x, y) not in (("a", "p"), ("b", "q"))) < 60
