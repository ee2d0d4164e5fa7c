import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from noisemill.functions.codec import encode_table
from noisemill.operators import annotate, counts, evaluate, relational
from noisemill.plans import families, synthesis
from noisemill.sources import tables
from noisemill.spec import Categorical, Constraint, ForeignKey, FreeText, Numerical, OpenSet, Relations
from noisemill.streaming import counts as streaming

THREE = {c: Categorical(tuple(range(n))) for c, n in (("c0", 2), ("c1", 3), ("c2", 4))}
AXBY = "a string, b string"


def frame(spark, text, repeat=1):
    return spark.createDataFrame([tuple(x) for x in text.split() for _ in range(repeat)], AXBY)


def test_exact_marginals(spark):
    df = spark.createDataFrame([(0, 1, 2), (0, 0, 2), (0, 2, 2), (1, 1, 2)], "c0 int, c1 int, c2 int")
    got = {(r.clique, r.cell): r.n for r in counts.marginals(df, THREE, [("c0", "c1"), ("c2",)]).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (0, 2): 1, (0, 4): 1, (1, 2): 4}
    dense = counts.dense_counts(df, THREE).where("column = 'c2'").orderBy("code").collect()
    assert [r.n for r in dense] == [0, 0, 4, 0]


def test_compressed_counts(spark):
    dense = spark.createDataFrame([("a", k, n) for k, n in enumerate((8, 1, 0, 2, 3))] + [("b", 0, 5)], "column string, code long, n long")
    common = spark.createDataFrame([("a", 0), ("a", 0)], "column string, code long")
    got = sorted(map(tuple, counts.compressed(dense, common).collect()))
    assert got == [("a", -1, 6, 3.0), ("a", 0, 8, 8.0), ("b", -1, 5, 5.0)]


def test_ends(spark):
    df = spark.createDataFrame([(1.5, None), (float("nan"), None), (None, None), (-2.0, None)], "x double, y int")
    assert sorted(map(tuple, counts.ends(df, ["x", "y"]).collect())) == [("x", -2.0, 1.5), ("y", None, None)]
    assert counts.ends(df.limit(0), ["x", "y"]).collect() == []


def test_largest_errors_by_name_on_ties(spark):
    errors = spark.createDataFrame([("c", 1.0), ("b", 2.0), ("a", 1.0)], "clique string, error double")
    assert [tuple(r) for r in counts.largest_errors(errors, 2).orderBy("place").collect()] == [("b", 2.0, 1), ("a", 1.0, 2)]
    with pytest.raises(ValueError):
        counts.largest_errors(errors, 0)


def test_empty_table_has_zero_counts(spark):
    df = spark.createDataFrame([], "c0 int, c1 int, c2 int")
    assert {r.n for r in counts.dense_counts(df, THREE).collect()} == {0}


def test_workloads():
    assert counts.downward_closure([("a", "b")]) == [("a",), ("b",), ("a", "b")]
    assert counts.maximal([("a",), ("a", "b"), ("c",)]) == [("a", "b"), ("c",)]


def test_total_variation(spark):
    real = frame(spark, "AX", 40).union(frame(spark, "AY BX", 10)).union(frame(spark, "BY", 40))
    other = frame(spark, "AX AY BX BY", 25)
    got = {r.clique: round(r.tv, 9) for r in evaluate.total_variation(real, other, ["a", "b"], 2).collect()}
    assert got == {"a": 0, "b": 0, "a|b": 0.3}
    gap = frame(spark, "AX", 40).union(frame(spark, "AY", 20)).union(frame(spark, "BY", 40))
    r = evaluate.total_variation(frame(spark, "AX BY", 50), gap, ["a", "b"], 2).where("clique = 'a|b'").first()
    assert (r.unseen, r.unseen_rows) == (1, 20)
    assert evaluate.top_unseen(frame(spark, "AX BY", 50), gap, ("a", "b")).first().cell == '["A","Y"]'
    nothing = real.where("false")
    assert {r.tv for r in evaluate.total_variation(nothing, other, ["a"]).collect()} == {1.0}


def test_correlation(spark):
    assert evaluate.cramers_v(frame(spark, "ax by", 2), ["a", "b"]).first().v == pytest.approx(1)
    assert evaluate.cramers_v(frame(spark, "ax ay"), ["a", "b"]).first().v == 0
    same = frame(spark, "ax by ay", 5)
    assert evaluate.correlation_distance(same, same, ["a", "b"]).first().distance == 0


def test_chi_squared(spark):
    a, b = frame(spark, "ax bx", 50), frame(spark, "ax", 75).union(frame(spark, "bx", 25))
    r = evaluate.chi_squared(a, b, ["a"]).first()
    assert r.statistic == pytest.approx(12.288) and r.dof == 1
    assert evaluate.chi_squared_p(12.288, 1) == pytest.approx(0.000456, abs=1e-5)
    assert evaluate.chi_squared_p(0, 1) == 1 and evaluate.chi_squared_p(3.0, 4) == pytest.approx(0.557825, abs=1e-5)


KEY = ForeignKey("households", "hh_id", "persons", "hh_id", 2)
PEOPLE = ForeignKey("persons", "person_id", "activities", "person_id", 2)


def test_weights_below_a_root(spark):
    t = {
        "households": spark.createDataFrame([("H0",), ("H1",)], "hh_id string"),
        "persons": spark.createDataFrame([("P0", "H0"), ("P1", "H0"), ("P2", "H0"), ("P3", "H1")], "person_id string, hh_id string"),
        "activities": spark.createDataFrame([("A0", "P0"), ("A1", "P1"), ("A2", "P2"), ("A3", "P3"), ("A4", "gone")], "activity_id string, person_id string"),
    }
    got = relational.weights(t, Relations((KEY, PEOPLE)), {"households": "hh_id"}, {"persons": ["person_id"], "activities": ["activity_id"]})
    assert {r.person_id: r.weight for r in got["persons"].collect()} == {"P0": 0.5, "P1": 0.5, "P2": 0.0, "P3": 1.0}
    assert {r.activity_id: r.weight for r in got["activities"].collect()} == {"A0": 0.5, "A1": 0.5, "A2": 0.0, "A3": 1.0, "A4": 0.0}


@pytest.mark.parametrize("k, slots, sliced, n", [(0, 2, False, 1), (1, 2, False, 2), (2, 2, False, 2), (3, 2, False, 6), (0, 2, True, 1), (1, 2, True, 1)])
def test_patterns_sum_to_one(k, slots, sliced, n):
    found, w = relational.patterns(k, slots, sliced)
    assert len(found) == n and len(found) * w == pytest.approx(1)
    assert relational.patterns(1, 2)[0] == [(0, -1), (-1, 0)] and relational.patterns(0, 2, True)[0] == [(0, 0)]


def test_exploration_table(spark):
    parents = spark.createDataFrame([("H0",), ("H1",), ("H2",)], "hh_id string")
    kids = spark.createDataFrame([("H0", 35), ("H0", 32), ("H2", 5)], "hh_id string, age int")
    out = relational.exploration_table(parents, kids, KEY, ["hh_id"], {"age": 100}, 2, ["age"]).collect()
    assert len(out) == 5 and sum(r.weight for r in out) == pytest.approx(3)
    assert [(r["slot_1.age"], r["slot_2.age"]) for r in out if r.hh_id == "H1"] == [(100, 100)]
    none = relational.exploration_table(parents, kids.where("false"), KEY, ["hh_id"], {"age": 100}, 2, ["age"])
    assert {r.group_size for r in none.collect()} == {0}


def test_unstack(spark):
    wide = spark.createDataFrame([(0, 2, 5, 8), (1, 0, 10, 10), (2, 1, 3, 10)], "`family` int, group_size int, `slot_1.age` int, `slot_2.age` int")
    got = relational.unstack(wide, 2, {"age": 10}).orderBy("family", "slot").collect()
    assert [(r.family, r.age) for r in got] == [(0, 5), (0, 8), (2, 3)]


def test_ranks_are_global(spark):
    df = relational.ranked(spark.range(1000).repartition(7), F.desc("id"))
    assert [r.id for r in df.orderBy("rank").limit(3).collect()] == [999, 998, 997]
    assert df.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first() == (1000, 0, 999)


MIXED = {"a": Categorical((0, 1, 2)), "b": Categorical((0, 1, 2)), "c": Numerical(0, 1, (0.25, 0.5, 0.75))}


@pytest.fixture(scope="module")
def mixed(spark):
    r = np.random.default_rng(0)
    a = r.integers(0, 3, 1000)
    b = np.where(r.random(1000) < 0.75, a, r.integers(0, 3, 1000))
    c = np.clip((a + b) / 4 + r.normal(0, 0.1, 1000), 0, 1)
    return spark.createDataFrame([(int(x), int(y), float(z)) for x, y, z in zip(a, b, c)], "a int, b int, c double")


@pytest.mark.parametrize("method", synthesis.METHODS)
def test_synthesis_keeps_pairs(spark, mixed, method):
    codes = encode_table(mixed, MIXED)
    model = synthesis.synthesize_codes(codes, MIXED, 100.0, np.random.default_rng(1), method, [("a", "b"), ("b", "c")])
    assert model.total == pytest.approx(1000, abs=3)
    made = synthesis.draw(spark, model, 20_000)
    tv = {r.clique: r.tv for r in evaluate.total_variation(codes, made, ["a", "b", "c"], 2).collect()}
    assert max(tv[c] for c in "abc") < 0.03
    pairs = sum(v for c, v in tv.items() if "|" in c) / 3
    assert pairs > 0.3 if method == "independent" else pairs < 0.15


def test_noise_grows_as_the_budget_shrinks(mixed):
    codes = encode_table(mixed, MIXED)
    far = [synthesis.synthesize_codes(codes, MIXED, rho, np.random.default_rng(2), "independent").total - 1000 for rho in (1e4, 1e-4)]
    assert abs(far[0]) < 1 < abs(far[1])


def test_constraints_hold_without_exception(spark, mixed):
    rule = Constraint(("a", "b"), impossible=((0, 1), (2, 0)))
    out = synthesis.synthesize(mixed, MIXED, 2.0, 1e-6, constraints=(rule,), rows=5000)
    assert evaluate.violations(out, rule).count() == 0 and out.count() == 5000


def test_model_survives_a_file(spark, mixed, tmp_path):
    model = synthesis.synthesize_codes(encode_table(mixed, MIXED), MIXED, 1.0, np.random.default_rng(0))
    tables.save_model(spark, model, str(tmp_path / "m"))
    again = tables.load_model(spark, str(tmp_path / "m"))
    assert synthesis.draw(spark, again, 50, 7).collect() == synthesis.draw(spark, model, 50, 7).collect()


def test_open_columns_and_bare_numbers(spark, mixed):
    with pytest.raises(ValueError):
        synthesis.synthesize(mixed, {"a": FreeText()}, 1, 1e-6)
    texts = mixed.selectExpr("concat('v', a) as a", "c")
    out = synthesis.synthesize(texts, {"a": OpenSet(), "c": Numerical(0, 1)}, 50.0, 1e-6, seed=0)
    counts_ = {r.a: r["count"] for r in out.groupBy("a").count().collect()}
    real = {r.a: r["count"] for r in texts.groupBy("a").count().collect()}
    assert all(abs(counts_[v] - n) < 60 for v, n in real.items()) and out.select("c").distinct().count() >= 5
    want, got = (x.agg(F.avg("c")).first()[0] for x in (texts, out))
    assert abs(want - got) < 0.05


def test_noise_is_not_predictable(mixed):
    codes = encode_table(mixed, MIXED)
    totals = {synthesis.synthesize_codes(codes, MIXED, 1e-3, np.random.default_rng(None), "independent").total for _ in range(2)}
    assert len(totals) == 2
    import inspect

    assert all(inspect.signature(f).parameters["seed"].default is None for f in (synthesis.synthesize, families.synthesize_relations))


def test_impossible_rows_have_no_fallback():
    mask = np.array([[False, True, True]])
    assert synthesis._shares(np.array([[10.0, 0.0, 0.0]]), mask).tolist() == [[0, 0.5, 0.5]]
    with pytest.raises(ValueError):
        synthesis._shares(np.ones((1, 2)), np.zeros((1, 2), bool))


def test_cliques_that_make_a_ring_are_all_measured(mixed):
    codes = encode_table(mixed, MIXED)
    ring = [("a", "b"), ("b", "c"), ("a", "c")]
    model = synthesis.synthesize_codes(codes, MIXED, 1e6, np.random.default_rng(0), "direct", ring)
    for e in ring:
        want = np.zeros([MIXED[c].size for c in e])
        for r in codes.groupBy(*e).count().collect():
            want[r[0], r[1]] = r["count"]
        assert np.abs(model.total * model.pair(*e) - want).max() < 2


def test_aliases_keep_the_shares():
    for shares in (np.array([0.5, 0.25, 0.25, 0.0]), np.array([1.0]), np.random.default_rng(0).random(9)):
        out, n = np.zeros(len(shares)), len(shares)
        for k, (keep, other) in enumerate(synthesis._aliases(shares)):
            out[k] += keep / n
            out[other] += (1 - keep) / n
        assert np.allclose(out, shares / shares.sum())


def test_constraints_hold_on_data_that_break_them(spark, mixed):
    rule = Constraint(("a", "b"), possible=((0, 1), (1, 2), (2, 0)))
    broken = mixed.withColumn("b", F.col("a"))
    out = synthesis.synthesize(broken, MIXED, 2.0, 1e-6, constraints=(rule,), rows=2000)
    assert evaluate.violations(out, rule).count() == 0 and out.count() == 2000


def test_pairs_are_counted_in_one_pass(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    schema = {f"c{k}": Categorical((0, 1, 2)) for k in range(5)}
    df = orders.selectExpr(*(f"cast(o_orderkey % {k + 2} % 3 as int) as c{k}" for k in range(5)))
    plan = synthesis.pair_errors(df, schema)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2  # the pairs', and the columns'


def test_from_marginals(spark):
    ab = spark.createDataFrame([("a", "x", 5), ("a", "y", 10), ("b", "x", 15), ("b", "y", 20), ("c", "x", 25)], "A string, B string, count int")
    c = spark.createDataFrame([("p", 20), ("q", 25), ("r", 30)], "C string, count int")
    model = synthesis.model_from_marginals([ab, c])
    assert model.total == 75 and synthesis.draw(spark, model).count() == 75
    made = synthesis.draw(spark, model, 30_000)
    # (c, y) isn't listed, so not measured: as if c went with y as often as others do
    share = made.where("A = 2 and B = 1").count() / made.where("A = 2").count()
    assert abs(share - 0.6) < 0.05
    zero = synthesis.model_from_marginals([ab.unionByName(spark.createDataFrame([("c", "y", 0)], ab.schema))])
    assert synthesis.draw(spark, zero, 3000).where("A = 2 and B = 1").count() == 0
    with pytest.raises(ValueError, match="n"):
        synthesis.infer_domain([ab.withColumnRenamed("count", "n")])


def test_relations_hang_together(spark):
    parents = spark.range(200).selectExpr("id as pid", "cast(id % 2 as int) as kind")
    kids = spark.range(400).selectExpr("id as cid", "id div 2 as pid", "cast((id div 2) % 2 as int) as sort")
    k = ForeignKey("p", "pid", "c", "pid", 3)
    two = Categorical((0, 1))
    rel = Relations((k,), {"p": {"kind": two}, "c": {"sort": two}})
    out = families.synthesize_relations({"p": parents, "c": kids}, rel, 20.0, 1e-6, {"c": ["cid"]}, seed=0)
    r = relational.integrity(out["p"], out["c"], k).first()
    assert r.orphans == 0 and r.most_children <= 3 and r.duplicate_keys == 0
    joined = out["c"].join(out["p"], "pid")
    assert joined.where("kind = sort").count() > 0.85 * joined.count()


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("x,1", 2), ('q"', 3)], "s string, n int")
    tables.write_csv(df, str(tmp_path / "t"), 1)
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "t"), schema={"s": OpenSet(), "n": Numerical(0, 9, integer=True)}).collect())) == [('q"', 3), ("x,1", 2)]
    assert tables.read_csv(spark, str(tmp_path / "t"), columns=2).columns == ["0", "1"]
    with pytest.raises(ValueError):
        tables.read_csv(spark, "x", names=["a"], columns=1)
    schema = {"s": OpenSet(public=("x",)), "n": Numerical(0, 9, (3.0,), integer=True), "c": Categorical(("u", "v"), 1), "t": FreeText(9)}
    assert tables.schema_from_yaml(tables.schema_to_yaml(schema)) == schema
    rel = Relations((KEY,), {"households": {"c": Categorical((1, 2))}, "persons": {"n": schema["n"]}})
    assert tables.relations_from_yaml(tables.relations_to_yaml(rel)) == rel
    assert set(tables.infer_schema(df)) == {"s", "n"}


def test_records(spark):
    schema = {"n": Numerical(0, 9, integer=True), "c": Categorical(("u", "v"))}
    df = tables.from_records(spark, [{"n": None, "c": "v"}, {"n": 4, "c": "u"}], schema)
    assert [tuple(r) for r in df.orderBy("n").collect()] == [(0, "v"), (4, "u")]
    assert sorted(tables.to_records(df, lambda **k: tuple(k.values()))) == [(0, "v"), (4, "u")]


def test_records_round_whole_numbers(spark):
    from typing import Optional

    pydantic = pytest.importorskip("pydantic")

    class Row(pydantic.BaseModel):
        n: int
        m: Optional[int] = None
        x: float

    df = spark.createDataFrame([(1.6, float("nan"), 1.6), (2.0, 3.4, 0.5)], "n double, m double, x double")
    assert sorted(((r.n, r.m, r.x) for r in tables.to_records(df, Row)), key=lambda r: r[2]) == [(2, 3, 0.5), (2, None, 1.6)]


def test_log_of_a_fit_as_text(spark, tmp_path):
    import json

    model = synthesis.TreeModel(THREE, 4.0, ["c0"], {"c0": None}, {"c0": np.ones(2) / 2}, [{"round": 0, "clique": "c0|c1", "rho": 0.5}])
    tables.write_log(spark, model, str(tmp_path / "log"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert got == [{"total": 4.0, "order": ["c0"], "parents": {"c0": None}}, *model.log]


def test_missing_columns_are_told():
    rel = Relations((KEY,), {"households": {"c": Categorical((1, 2))}, "persons": {"n": Numerical(0, 9)}})
    have = {"households": ["c", KEY.parent_key, "more"], "persons": ["n", KEY.child_key]}
    rel.check_columns(have)
    for bad in ({**have, "persons": ["n"]}, {**have, "households": [KEY.parent_key]}, {"persons": have["persons"]}):
        with pytest.raises(ValueError):
            rel.check_columns(bad)


def test_answers(spark):
    schema = {"k": Categorical(("none", "a")), "x": Numerical(1, 5), "t": OpenSet("")}
    rows = ['```json\n{"k": "a", "x": 2, "more": 1}\n```', '{"k": null}', "sorry", "", None, '[{"k": "a"}]']
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "i int, answer string")
    got = [tuple(r)[2:] for r in annotate.parse_answers(df, "answer", schema).orderBy("i").collect()]
    assert got[0] == ("a", 2.0, "", 2) and set(got[1:]) == {("none", 1.0, "", 0)}
    assert annotate.json_schema(schema)["properties"]["k"]["enum"] == ["none", "a"]
    asked = annotate.ask(df, "answer", "reply", lambda texts: [t and t.upper() for t in texts], chunk=2)
    assert asked.where("i = 2").first().reply == "SORRY"
    bad = ['{"k": "b", "x": "y", "t": "z"}', '{"k": "a", "x": 9}', 'see ```json\n{"k": "a"}\n```']
    df = spark.createDataFrame(list(enumerate(bad)), "i int, answer string")
    got = [tuple(r)[2:] for r in annotate.parse_answers(df, "answer", schema).orderBy("i").collect()]
    assert got == [("none", 1.0, "z", 1), ("a", 1.0, "", 1), ("none", 1.0, "", 0)]

    def fragile(texts):
        if any("y" in t for t in texts):
            raise RuntimeError("no")
        return [t[:3] for t in texts]

    failed = annotate.ask(df.coalesce(1), "answer", "reply", fragile, pause=0.0).orderBy("i").collect()
    assert [r.reply for r in failed] == ["", '{"k', "see"]


def test_streaming_counts_equal_batch_counts(spark, small, tmp_path):
    orders = spark.read.parquet(f"{small}/orders.parquet").selectExpr("cast(o_orderkey % 2 as int) as c0", "cast(o_orderkey % 3 as int) as c1", "cast(o_orderkey % 4 as int) as c2")
    orders.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    work = list(itertools.combinations(THREE, 2))
    keep = lambda df, _: df.write.mode("overwrite").parquet(str(tmp_path / "running"))
    streaming.start(streaming.running_marginals(stream, THREE, work), keep, str(tmp_path / "c")).awaitTermination(60)
    batch = counts.marginals(encode_table(orders, THREE), THREE, work)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "running")).collect())) == sorted(map(tuple, batch.collect()))


def test_rare_codes_are_merged_and_drawn(spark):
    df = spark.range(3000).selectExpr("cast(case when id % 100 = 0 then 2 + (id div 100) % 28 else id % 2 end as int) as a", "cast(id % 2 as int) as b")
    schema = {"a": Categorical(tuple(range(30))), "b": Categorical((0, 1))}
    out = synthesis.synthesize(df, schema, 1.0, 1e-6, seed=0, compress=True)
    counts_ = {r.a: r["count"] for r in out.groupBy("a").count().collect()}
    assert counts_[0] > 1200 and counts_[1] > 1200 and all(0 <= k < 30 for k in counts_)
    with pytest.raises(ValueError):
        synthesis.synthesize(df, schema, 1, 1e-6, per_user=0)


def test_schema_of_a_model():
    import enum
    from typing import Annotated, Literal, Optional

    pydantic = pytest.importorskip("pydantic")

    class Size(enum.Enum):
        S = "s"
        L = "l"

    class Row(pydantic.BaseModel):
        n: Annotated[int, pydantic.Field(gt=0, lt=10)]
        x: Optional[Annotated[float, pydantic.Field(ge=0, le=1)]] = None
        k: Literal["a", "b"]
        s: Optional[Size] = None
        f: bool

    got = tables.schema_from_model(Row)
    assert got["n"] == Numerical(1, 9, integer=True) and got["k"].values == ("a", "b")
    assert got["s"].values == ("s", "l", "None") and got["f"].values == ("False", "True")

    class Open(pydantic.BaseModel):
        n: int

    with pytest.raises(ValueError):
        tables.schema_from_model(Open)


def test_attribute_report_of_an_empty_table(spark):
    some = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    rows = {r["column"]: r for r in evaluate.attribute_report(some, some.limit(0), ["k", "n"]).collect()}
    assert set(rows) == {"k", "n"} and all(r.tv == 1.0 and r.synthetic_present == 0 and r.original_present == 2 for r in rows.values())


def test_aligned_and_categorical_columns(spark):
    some = spark.createDataFrame([("a", "1", "2.5"), ("b", None, "NaN")], "k string, n string, x string")
    assert evaluate.aligned(some, some.select("n", "k")).columns == ["n", "k"]
    assert evaluate.categorical_columns(some, ["x", "n", "k"]) == ["x", "k"]
    with pytest.raises(ValueError, match="lacks"):
        evaluate.aligned(some.select("k"), some)
