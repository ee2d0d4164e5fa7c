"""Models over cliques: trees, propagation, fits, errors and draws."""

import itertools
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from noisemill.functions import budget
from noisemill.functions.codec import encode_table
from noisemill.operators import counts, evaluate
from noisemill.plans import cliques, synthesis
from noisemill.sources import tables
from noisemill.spec import Categorical, Constraint

SIZES = {"a": 3, "b": 4, "c": 2, "d": 5, "e": 3}
SCHEMA = {c: Categorical(tuple(range(n))) for c, n in SIZES.items()}


def table(rng, *columns, zeros=0.2):
    x = rng.random([SIZES[c] for c in columns])
    return np.where(rng.random(x.shape) < zeros, 0, x)


def full(factors):
    """The product of all factors over the whole domain."""
    letters = {c: k for k, c in enumerate(SIZES)}
    args = [y for columns, x in factors for y in (x, [letters[c] for c in columns])]
    for c, n in SIZES.items():
        args += [np.ones(n), [letters[c]]]
    return np.einsum(*args, list(range(len(SIZES))))


@pytest.mark.parametrize("given", [[], [("a", "b", "c")], [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], [("a", "b"), ("d", "e")], [("a", "b", "c"), ("c", "d"), ("b", "d", "e")]])
def test_a_tree_holds_all_cliques_and_columns_hang_together(given):
    tree = cliques.junction_tree(SCHEMA, given)
    assert all(tree.host(c) is not None for c in given) and set().union(*tree.cliques) == set(SCHEMA)
    assert not any(set(a) < set(b) for a, b in itertools.permutations(tree.cliques, 2))
    for c in SCHEMA:
        # of the cliques with a column, all but one have a parent with it
        assert sum(c in q and c not in tree.separator(k) for k, q in enumerate(tree.cliques)) == 1
    assert all(up is None or up < k for k, up in enumerate(tree.parents))
    assert tree.cells(SCHEMA) == sum(np.prod([SIZES[c] for c in q]) for q in tree.cliques)


def test_messages_between_tables_give_the_products_sums(spark):
    rng = np.random.default_rng(0)
    parts = [(c, table(rng, *c)) for c in [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("b",), ("e",)]]
    frames = [(c, spark.createDataFrame([(*map(int, at), float(x[at])) for at in np.ndindex(x.shape) if x[at] > 0], ", ".join(f"{k} int" for k in c) + ", value double")) for c, x in parts]
    tree = cliques.junction_tree(SCHEMA, [c for c, _ in parts])
    want, names = full(parts), list(SIZES)
    for clique, belief in zip(tree.cliques, cliques.calibrate(frames, tree, SCHEMA), strict=True):
        got = {tuple(r[c] for c in clique): r.value for r in belief.collect()}
        sums = want.sum(tuple(k for k, c in enumerate(names) if c not in clique))
        order = [c for c in names if c in clique]
        assert len(got) == sums.size
        for at in np.ndindex(sums.shape):
            assert got[tuple(at[order.index(c)] for c in clique)] == pytest.approx(sums[at], rel=1e-9, abs=1e-12)


def test_a_fit_keeps_consistent_tables_and_sums_out_the_rest():
    rng = np.random.default_rng(1)
    joint = full([(("a", "b", "c"), table(rng, "a", "b", "c", zeros=0)), (("c", "d"), table(rng, "c", "d", zeros=0)), (("d", "e"), table(rng, "d", "e", zeros=0))])
    joint /= joint.sum()
    names = list(SIZES)
    of = lambda columns: joint.sum(tuple(k for k, c in enumerate(names) if c not in columns))
    model = cliques.fit_cliques(SCHEMA, {c: 1000 * of(c) for c in [("a", "b", "c"), ("c", "d"), ("d", "e")]}, 1000)
    for columns in [("a", "b", "c"), ("a", "e"), ("b", "d"), ("e",), ("a", "d", "e")]:
        assert np.abs(model.marginal(columns) - of(columns)).max() < 1e-6
    assert np.allclose(model.marginal(("e", "a")), model.marginal(("a", "e")).T)
    ring = cliques.fit_cliques(SCHEMA, {c: of(c) for c in [("a", "b"), ("b", "d"), ("a", "d")]}, 1)
    assert all(np.abs(ring.marginal(c) - of(c)).max() < 1e-5 for c in [("a", "b"), ("b", "d"), ("a", "d")])
    with pytest.raises(ValueError, match="cells"):
        cliques.fit_cliques(SCHEMA, {("a", "b", "d"): of(("a", "b", "d"))}, 1, most_cells=20)
    with pytest.raises(ValueError, match="no value"):
        cliques.fit_cliques(SCHEMA, {}, 1, {("a", "b"): np.zeros((3, 4))})


def test_draws_follow_the_model_and_repeat(spark, tmp_path):
    rng = np.random.default_rng(2)
    model = cliques.fit_cliques(SCHEMA, {c: table(rng, *c) for c in [("a", "b", "c"), ("c", "d"), ("e",)]}, 40_000)
    made = synthesis.draw(spark, model, seed=3)
    assert made.columns == ["id", *SCHEMA] and made.count() == 40_000
    for columns in [("a", "b", "c"), ("a", "d"), ("e",)]:
        got = np.zeros([SIZES[c] for c in columns])
        for r in made.groupBy(*columns).count().collect():
            got[r[:-1]] += r["count"] / 40_000
        assert np.abs(got - model.marginal(columns)).sum() < 0.05
        assert (got[model.marginal(columns) < 1e-9] == 0).all()
    tables.save_model(spark, model, str(tmp_path / "m"))
    again = tables.load_model(spark, str(tmp_path / "m"))
    assert synthesis.draw(spark, again, 50, 3).collect() == synthesis.draw(spark, model, 50, 3).collect()


@pytest.fixture(scope="module")
def odd(spark):
    """c is the parity of a and b: no pair tells anything, the triple all."""
    rows = spark.range(3000).select((F.xxhash64("id") % 2).cast("int").alias("a"), (F.xxhash64("id", F.lit(1)) % 2).cast("int").alias("b"))
    rows = rows.select(F.abs("a").alias("a"), F.abs("b").alias("b"))
    return rows.withColumn("c", (F.col("a") + F.col("b")) % 2)


BITS = {c: Categorical((0, 1)) for c in "abc"}


def test_a_clique_of_three_columns_is_kept_where_pairs_lose_it(spark, odd):
    codes = encode_table(odd, BITS)
    model = synthesis.synthesize_codes(codes, BITS, 5.0, np.random.default_rng(0), "direct", [("a", "b", "c")])
    made = synthesis.draw(spark, model, 3000)
    assert made.where("(a + b) % 2 <> c").count() < 60
    pairs = synthesis.synthesize_codes(codes, BITS, 5.0, np.random.default_rng(0), "direct", [("a", "b"), ("b", "c"), ("a", "c")])
    assert synthesis.draw(spark, pairs, 3000).where("(a + b) % 2 <> c").count() > 1000


def test_a_rule_on_three_columns_is_never_broken(spark, odd):
    rule = Constraint(("a", "b", "c"), impossible=((0, 0, 1), (1, 1, 0), (1, 1, 1)))
    broken = evaluate.violations(odd, rule).count()
    assert broken > 0
    for method in ("independent", "mst", "aim", "direct"):
        model = synthesis.synthesize_codes(encode_table(odd, BITS), BITS, 1.0, np.random.default_rng(0), method, [("a", "b")], constraints=(rule,))
        made = synthesis.draw(spark, model, 2000)
        assert made.count() == 2000 and evaluate.violations(made, rule).count() == 0


def test_errors_against_a_model_count_cells_of_either_side(spark, odd):
    codes, asked = encode_table(odd, BITS), [("a", "b"), ("a", "b", "c")]
    found = counts.marginals(codes, BITS, asked)
    pairs = {c: np.full((2, 2), 750.0) for c in itertools.combinations("abc", 2)}
    model = cliques.fit_cliques(BITS, pairs, 3000)
    errors = {r.clique: r.error for r in cliques.model_errors(found, model, asked).collect()}
    exact = {r[:-1]: r[-1] for r in odd.groupBy("a", "b", "c").count().collect()}
    assert errors["a|b|c"] == pytest.approx(sum(abs(exact.get(k, 0) - 375) for k in itertools.product((0, 1), repeat=3)), abs=1e-3)
    assert len(exact) == 4


def test_a_workload_is_scored_before_anything_is_counted():
    rows = {r[0]: r[1:] for r in cliques.compile_workload(SCHEMA, {("a", "b", "c"): 2.0, ("c", "d"): 1.0}, 2, 25)}
    assert set(rows) == {("a",), ("b",), ("c",), ("d",), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")}
    assert rows["b", "c"] == (8, 5.0, 8 + 3 + 5 + 3, True) and rows["a", "b"][2:] == (22, True)
    assert cliques.affordable(SCHEMA, [("a", "b")], [("b", "c"), ("b", "d")], 30) == [("b", "c")]


@pytest.mark.parametrize("per_user", [1, 2, 10, 40])
@pytest.mark.parametrize("rho", [0.005, 0.05, 5.0])
def test_no_user_shows_values_of_their_own_but_with_delta(per_user, rho):
    delta, sigma = 1e-6, budget.sigma_of_rho(rho)
    cut = budget.selection_threshold(sigma, delta, per_user)
    for k in range(1, per_user + 1):
        stay = NormalDist().cdf((cut - 1) / (per_user * sigma)) ** (k - 1) * NormalDist().cdf((cut - (per_user - k + 1)) / (per_user * sigma))
        assert 1 - stay <= delta * 1.0001


@pytest.mark.parametrize("method", ["aim", "aim_gdp"])
def test_rounds_find_the_triple_that_no_pair_shows(spark, odd, method):
    codes = encode_table(odd, BITS)
    model = synthesis.synthesize_codes(codes, BITS, 50.0, np.random.default_rng(0), method, width=3)
    assert any(r["clique"] == "a|b|c" for r in model.log) and all({"rho", "sigma", "moved"} <= r.keys() for r in model.log)
    assert sum(r["rho"] for r in model.log) <= 45.0001
    made = synthesis.draw(spark, model, 3000)
    assert made.where("(a + b) % 2 <> c").count() < 60


def test_budget_is_raised_where_measuring_tells_nothing(spark):
    even = spark.range(2000).select(*((F.col("id") / n).cast("long") % 2 for n in (1, 2, 4, 8)))
    even = even.toDF(*"abcd")
    schema = {c: Categorical((0, 1)) for c in "abcd"}
    model = synthesis.synthesize_codes(encode_table(even, schema), schema, 0.01, np.random.default_rng(0), "aim")
    shares = [r["rho"] for r in model.log]
    assert len(shares) < 6 and shares[-1] > shares[0] and sum(shares) <= 0.0091


def test_only_measured_cliques_reach_the_driver_and_all_methods_log(spark, odd):
    codes = encode_table(odd, BITS)
    for method in ("mst", "swift", "direct"):
        model = synthesis.synthesize_codes(codes, BITS, 1.0, np.random.default_rng(0), method, [("a", "b")])
        assert model.log and all(r["rho"] > 0 and r["sigma"] > 0 for r in model.log)
