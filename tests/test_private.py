import math

import numpy as np
import pytest

from noisemill.functions import budget
from noisemill.functions.codec import gaussian
from noisemill.operators import private
from noisemill.spec import ForeignKey, Numerical, OpenSet, Relations


@pytest.mark.parametrize("epsilon, delta, rho", [(1, 1e-5, 0.0305566), (1, 1e-6, 0.02435597), (0.2, 1e-5, 0.00155884), (3.2, 1e-6, 0.20805168), (10, 1e-9, 1.0907857)])
def test_zcdp(epsilon, delta, rho):
    assert budget.zcdp_rho(epsilon, delta) == pytest.approx(rho, abs=1e-6)
    assert budget.zcdp_epsilon(rho, delta) == pytest.approx(epsilon, abs=1e-3)


def test_no_budget_and_pure_gaussian():
    assert budget.zcdp_rho(0, 1e-6) == 0 and math.isinf(budget.sigma_of_rho(0))
    mu = budget.gaussian_mu(1, 1e-6)
    assert budget.gaussian_delta(mu, 1) == pytest.approx(1e-6, rel=1e-3)
    assert mu * mu / 2 > budget.zcdp_rho(1, 1e-6)  # exact accounting allows less noise


def test_allocation():
    got = budget.allocate({"ab": (100, 6, 1), "ac": (100, 8, 1), "bc": (100, 12, 1)}, 100)
    y = {k: n ** (2 / 3) for k, n in (("ab", 6), ("ac", 8), ("bc", 12))}
    assert got == pytest.approx({k: 100 * v / sum(y.values()) for k, v in y.items()})
    assert sum(budget.allocate({"a": (-1, 5, 1), "b": (-2, 5, 1)}, 7).values()) == pytest.approx(7)


def test_link_sensitivities():
    chain = Relations((ForeignKey("h", "id", "p", "h", 3), ForeignKey("p", "id", "a", "p", 2)))
    assert chain.sensitivities() == {"h->p": 1, "p->a": 3}
    with pytest.raises(ValueError):
        Relations((ForeignKey("a", "id", "b", "a", 1), ForeignKey("b", "id", "a", "b", 1))).order()
    with pytest.raises(ValueError):
        Relations((ForeignKey("a", "id", "c", "a", 1), ForeignKey("b", "id", "c", "b", 1))).order()


def test_discovery_drops_rare_values(spark):
    rows = [("A",)] * 100 + [("3",)] * 100 + [("C",)] + [(None,)] * 50
    df = spark.createDataFrame(rows, "x string")
    found = private.discover(df, {"x": OpenSet(public=("P",))}, budget.zcdp_rho(5, 1e-10), 1e-10, "secret")
    assert found == {"x": ["<OOD>", "3", "A", "P"]}
    with pytest.raises(ValueError):
        private.discover(df, {"x": OpenSet()}, 50.0, 1e-3, most=1)


def test_discovery_shares_its_budget(spark):
    """Ten columns at once get the noise of a tenth each: a count that one column shows is hidden."""
    df = spark.range(40).selectExpr(*(f"'v' as c{k}" for k in range(10)))
    one = private.discover(df, {"c0": OpenSet()}, 0.05, 1e-6, "s")
    ten = private.discover(df, {f"c{k}": OpenSet() for k in range(10)}, 0.05, 1e-6, "s")
    assert one == {"c0": ["<OOD>", "v"]} and sum(len(v) for v in ten.values()) < 15


def test_keyed_noise_is_normal_and_secret(spark):
    rows = spark.range(20_000).select(gaussian("a", "id").alias("x"), gaussian("b", "id").alias("y")).toPandas()
    assert abs(rows.x.mean()) < 0.03 and abs(rows.x.std() - 1) < 0.03 and abs(np.corrcoef(rows.x, rows.y)[0, 1]) < 0.03
    assert spark.range(5).select(gaussian("a", "id")).collect() == spark.range(5).repartition(3).sort("id").select(gaussian("a", "id")).collect()


def test_quantiles_without_noise(spark):
    df = spark.range(5000).selectExpr("cast(id % 100 as double) as x")
    edges = private.private_edges(df, "x", Numerical(0, 99, integer=True), math.inf, np.random.default_rng(0), 3)
    assert np.allclose(edges, [12, 24, 37, 49, 62, 74, 87], atol=1.5)


def test_quantiles_of_a_spike(spark):
    df = spark.range(10_080).selectExpr("cast(case when id < 80 then id else 40 end as double) as x")
    assert private.private_edges(df, "x", Numerical(0, 79, integer=True), math.inf, np.random.default_rng(0), 2) == (40.0,)


def test_cuts_part_the_rows():
    """One more row changes what one part of a level holds, and no other."""
    cells, size = np.array([1, 4, 9, 30]), 40
    for extra in range(4):
        counts = np.array([3, 10, 3, 5])
        cuts = private.quantile_cells(cells, counts, size, [math.inf] * 2)
        parts = np.searchsorted([c + 1 for c in cuts], cells, "right")
        more = counts.copy()
        more[extra] += 1
        before, after = (np.bincount(parts, x, 4) for x in (counts, more))
        assert (before != after).sum() == 1 and after[parts[extra]] == before[parts[extra]] + 1


def test_private_cuts_are_near_the_quantiles():
    counts = np.full(1000, 50)
    got = private.quantile_cells(np.arange(1000), counts, 1000, [0.5] * 3, np.random.default_rng(0))
    assert np.allclose(got, [124, 249, 374, 499, 624, 749, 874], atol=4)
    none = private.quantile_cells(np.zeros(0, np.int64), np.zeros(0, np.int64), 50, [0.5] * 2, np.random.default_rng(0))
    assert len(none) == 3 and all(0 <= c < 50 for c in none)


def test_sips_finds_common_partitions(spark):
    df = spark.range(4000).selectExpr("id div 2 as user", "case when id % 40 = 0 then concat('rare', id) else concat('p', id % 3) end as p")
    found = private.sips(df, "user", "p", 5.0, 1e-8, "secret", 2)
    assert sorted(r.p for r in found.collect()) == ["p0", "p1", "p2"]


def test_contributions(spark):
    df = spark.range(100).selectExpr("id % 3 as user", "id as x")
    assert {r["count"] for r in private.bound_contributions(df, "user", 5).groupBy("user").count().collect()} == {5}


def test_equal_cuts_become_bins_with_weights():
    a = Numerical(0, 10)
    assert private.edge_weights([1, 2, 2, 5, 10, 10, 11], a) == ((1.0, 2.0, 5.0), [1, 2, 1, 4])
    assert private.edge_weights([1.5], a) == ((1.5,), [1, 1]) and private.edge_weights([], a) == ((), [1])
    assert private.edge_weights([3, 3], Numerical(0, 10, clip=False)) == ((3.0,), [0, 2, 1])


def test_found_columns_are_not_paid_for_twice(spark):
    from noisemill.plans import synthesis
    from noisemill.spec import Categorical

    df = spark.range(4000).selectExpr("concat('v', id % 5) as a", "cast(id % 1000 as double) as x", "cast(id % 2 as int) as b")
    schema = {"a": OpenSet(), "x": Numerical(0, 1000), "b": Categorical((0, 1))}
    full, known = synthesis.declared(df, schema, 5.0, 1e-6, np.random.default_rng(0))
    assert set(known) == {"a", "x"} and all(len(s) == full[c].size and abs(s.sum() - 1) < 1e-9 for c, s in known.items())
    assert np.abs(known["a"][1:] - 0.2).max() < 0.02 and known["a"][0] < 0.02 and np.abs(known["x"] - 1 / 8).max() < 0.13
    seen = []
    real = synthesis.noisy_columns
    synthesis.noisy_columns = lambda codes, some, *rest: seen.append(set(some)) or real(codes, some, *rest)
    try:
        made = synthesis.synthesize(df, schema, 20.0, 1e-6, seed=0, compress=True)
    finally:
        synthesis.noisy_columns = real
    assert seen and all(s == {"b"} for s in seen)
    counts = {r.a: r["count"] for r in made.groupBy("a").count().collect()}
    assert all(abs(counts[f"v{k}"] - 800) < 150 for k in range(5))


def test_one_release_over_weighted_cliques(spark):
    from pyspark.sql import functions as F

    from noisemill.spec import Categorical

    schema = {"a": Categorical(tuple(range(60))), "b": Categorical(tuple(range(50)))}
    weights = {("a", "b"): 3.0, ("b", "a"): 1.0, ("a",): 2.0}
    sigmas = private.release_sigmas(weights, 0.02, 2.0)
    assert sum(4 / (2 * s * s) for s in sigmas.values()) == pytest.approx(0.02)
    assert sigmas["b", "a"] == pytest.approx(3 * sigmas["a", "b"])
    codes = spark.range(500).select((F.col("id") % 60).cast("int").alias("a"), (F.col("id") % 50).cast("int").alias("b"))
    rows = private.release(codes, schema, weights, 0.02, "key", 2.0).toPandas()
    assert rows.groupby("clique").size().tolist() == [3000, 3000, 60]
    for k, clique in enumerate(weights):
        part = rows[rows["clique"] == k].sort_values("cell")
        exact = np.zeros(len(part))
        for r in codes.groupBy(*clique).count().collect():
            exact[r[0] * 50 + r[1] if clique == ("a", "b") else r[0] * 60 + r[1] if k == 1 else r[0]] = r["count"]
        assert set(part["sigma"]) == {sigmas[clique]}
        if k < 2:
            noise = part["n"].to_numpy() - exact
            assert noise.std() == pytest.approx(sigmas[clique], rel=0.06) and abs(noise.mean()) < 0.1 * sigmas[clique]
    with pytest.raises(ValueError):
        private.release_sigmas({("a",): 0.0}, 1.0)
