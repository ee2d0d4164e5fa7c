"""Children of one parent, drawn together."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from noisemill.operators import relational
from noisemill.plans import families, siblings
from noisemill.spec import Categorical, ForeignKey, Relations

KEY = ForeignKey("p", "pid", "c", "pid", 3)
REL = Relations((KEY,), {"p": {"kind": Categorical((0, 1))}, "c": {"sort": Categorical((0, 1, 2)), "even": Categorical((0, 1))}})


@pytest.fixture(scope="module")
def tables(spark):
    """Siblings share their sort, which says nothing about the parent; a parent has up to 3 children."""
    parents = spark.range(1500).select(F.col("id").alias("pid"), (F.col("id") % 2).cast("int").alias("kind"))
    kids = parents.select("pid", "kind", F.explode(F.expr("filter(sequence(1, 3), x -> x <= pid % 4)")).alias("n"))
    kids = kids.select((F.col("pid") * 4 + F.col("n")).alias("cid"), "pid", F.pmod(F.xxhash64("pid"), F.lit(3)).cast("int").alias("sort"))
    return {"p": parents, "c": kids.withColumn("even", (F.col("sort") == 1).cast("int"))}


def alike(kids):
    pairs = kids.alias("a").join(kids.alias("b"), "pid").where("a.cid < b.cid")
    return pairs.agg(F.avg((F.col("a.sort") == F.col("b.sort")).cast("double"))).first()[0]


def test_siblings_stay_alike_where_single_draws_lose_it(spark, tables):
    assert alike(tables["c"]) == 1
    shares = {}
    for slots in (1, 2):
        made = families.synthesize_relations(tables, REL, 30.0, 1e-6, {"c": ["cid"]}, seed=1, slots=slots)
        kids, parents = made["c"].withColumnRenamed("id", "cid"), made["p"]
        shares[slots] = alike(kids)
        assert kids.join(parents, "pid", "left_anti").count() == 0
        assert kids.groupBy("pid").count().agg({"count": "max"}).first()[0] <= 3
        assert abs(kids.count() - tables["c"].count()) < 0.15 * tables["c"].count()
        assert kids.where("even <> cast(sort = 1 as int)").count() < 0.1 * kids.count()
    assert shares[1] < 0.6 and shares[2] > 0.85


def test_slots_are_named_and_renamed():
    assert relational.slot_of("slot_12.a.b") == (12, "a.b") and relational.slot_of("slot_x.a") is None and relational.slot_of("group_size") is None
    clique = ("kind", "slot_2.a", "slot_1.b", "slot_2.b")
    assert relational.slots_in(clique) == [1, 2]
    assert relational.remapped(clique, {1: 3}) == ("kind", "slot_2.a", "slot_3.b", "slot_2.b")
    assert relational.remapped(clique, {1: 2, 2: 1}) == ("kind", "slot_1.a", "slot_2.b", "slot_1.b")
    assert relational.replicated(("kind",), 3) == [("kind",)]
    assert [c[0] for c in relational.replicated(("slot_1.a",), 3)] == ["slot_1.a", "slot_2.a", "slot_3.a"]
    assert relational.replicated(("slot_1.a", "slot_2.b"), 3) == [("slot_1.a", "slot_2.b"), ("slot_1.a", "slot_3.b"), ("slot_2.a", "slot_3.b")]


def test_symmetric_tables_keep_totals_and_forget_order(spark):
    rows = [(k % 2, k % 3, (k * 7) % 4, (k * 5) % 3, 0.5 + k % 2) for k in range(60)]
    wide = spark.createDataFrame(rows, "`kind` int, `slot_1.a` int, `slot_2.a` int, `slot_3.a` int, w double")
    sizes = {"kind": 2, **{f"slot_{s}.a": 4 for s in (1, 2, 3)}}
    workload = [("kind", "slot_1.a"), ("slot_1.a", "slot_3.a"), ("kind",), ("slot_1.a", "slot_2.a", "slot_3.a")]
    got = {}
    for r in relational.symmetric_marginals(wide, sizes, workload, 3, "w").collect():
        got[r.clique, r.cell] = r.n
    total = sum(r[4] for r in rows)
    for k, clique in enumerate(workload):
        assert sum(n for (q, _), n in got.items() if q == k) == pytest.approx(total)
    for a, b in itertools.product(range(4), repeat=2):
        want = sum(r[4] for r in rows for i, j in itertools.permutations((1, 2, 3), 2) if (r[i], r[j]) == (a, b)) / 6
        assert got.get((1, a * 4 + b), 0) == pytest.approx(want)
    real = {(r.clique, r.cell): r.n for r in relational.symmetric_marginals(wide, sizes, workload[:1], 3, "w", {"a": 3}).collect()}
    for kind, a in itertools.product(range(2), range(3)):
        want = sum(r[4] * r[1:4].count(a) / sum(x != 3 for x in r[1:4]) for r in rows if r[0] == kind and any(x != 3 for x in r[1:4]))
        assert real.get((0, kind * 4 + a), 0) == pytest.approx(want)
    assert not any(cell % 4 == 3 for _, cell in real)


def test_rules_of_slots():
    rules = siblings.slot_rules({"a": 2, "b": 3, "c": 1}, 2, 2)
    assert set(rules) == {("group_size", "slot_1.a"), ("slot_1.a", "slot_1.b"), ("slot_1.b", "slot_1.c"), ("group_size", "slot_2.a"), ("slot_2.a", "slot_2.b"), ("slot_2.b", "slot_2.c")}
    assert rules["group_size", "slot_2.a"].tolist() == [[False, False, True]] * 2 + [[True, True, False]]
    assert rules["slot_1.b", "slot_1.c"].sum() == 4 and np.array_equal(rules["slot_1.b", "slot_1.c"][-1], [False, True])
