import math

import numpy as np
import pytest

from noisemill.functions import budget, sampling
from noisemill.operators import annotate, private
from noisemill.plans.synthesis import fit_tree, synthesize, synthesize_codes
from noisemill.functions.codec import encode_table, undiscretize
from noisemill.spec import Categorical, FreeText, Numerical, OpenSet


def test_a_job_on_a_sample_may_spend_more():
    inner = sampling.on_sample(1.0, 1e-6, 0.1)
    assert inner == pytest.approx((math.log(1 + (math.e - 1) / 0.1), 1e-5))
    assert sampling.amplified(*inner, 0.1) == pytest.approx((1.0, 1e-6))
    assert sampling.on_sample(1000.0, 1e-6, 0.5)[0] == pytest.approx(1000 + math.log(2))
    assert sampling.on_sample(1.0, 1e-6, 1.0) == pytest.approx((1.0, 1e-6))
    for share in (0, 1.5):
        with pytest.raises(ValueError):
            sampling.on_sample(1.0, 1e-6, share)


@pytest.mark.parametrize("epsilon", [0.1, 1.0, 3.0])
def test_losses_without_sampling_are_the_gaussian_curve(epsilon):
    """Four releases with noise 2 are one with noise 1."""
    assert sampling.sampled_delta(1.0, 2.0, 4, epsilon) == pytest.approx(budget.gaussian_delta(1.0, epsilon), rel=1e-5, abs=1e-10)


@pytest.mark.parametrize("share, sigma", [(0.01, 0.7), (0.1, 1.0), (0.5, 2.0)])
def test_one_sampled_release_has_the_amplified_curve(share, sigma):
    inner = sampling.on_sample(1.0, 1.0, share)[0]
    exact = share * budget.gaussian_delta(1 / sigma, inner)
    assert sampling.sampled_delta(share, sigma, 1, 1.0) == pytest.approx(exact, rel=1e-4)


def test_renyi_divergence_is_the_integral():
    share, sigma = 0.2, 1.5
    x = np.linspace(-25, 30, 400_001)
    q = np.exp(-(x**2) / (2 * sigma**2)) / math.sqrt(2 * math.pi) / sigma
    ratio = 1 - share + share * np.exp((2 * x - 1) / (2 * sigma**2))
    for order in (2, 3, 8):
        assert sampling.sampled_rdp(share, sigma, order) == pytest.approx(math.log(float((q * ratio**order).sum() * (x[1] - x[0]))) / (order - 1), rel=1e-6)
    assert sampling.sampled_rdp(1.0, sigma, 5) == pytest.approx(5 / (2 * sigma**2))


def test_published_values():
    """Abadi et al. (2016): share 0.01, noise 4, 10,000 steps and delta 1e-5 cost at most 1.26 by their moments.
    Training on 60,000 digits in lots of 256 with noise 1.1 for 60 epochs costs at most 2.6 by Renyi divergence."""
    tight, renyi = sampling.sampled_epsilon(0.01, 4.0, 10_000, 1e-5), sampling.sampled_epsilon_rdp(0.01, 4.0, 10_000, 1e-5)
    assert 0.9 < tight < renyi < 1.26
    tight, renyi = sampling.sampled_epsilon(256 / 60_000, 1.1, 14_062, 1e-5), sampling.sampled_epsilon_rdp(256 / 60_000, 1.1, 14_062, 1e-5)
    assert 2.3 < tight < renyi < 2.65


def test_noise_for_a_budget():
    sigma = sampling.sampled_sigma(1.0, 1e-6, 0.1, 10)
    assert sampling.sampled_epsilon(0.1, sigma, 10, 1e-6, 1e-3) <= 1.0 < sampling.sampled_epsilon(0.1, 0.99 * sigma, 10, 1e-6, 1e-3)
    assert sampling.sampled_sigma(1.0, 1e-6, 1.0, 1) == pytest.approx(1 / budget.gaussian_mu(1.0, 1e-6), rel=2e-3)
    assert sampling.sampled_epsilon(0.5, 50.0, 1, 0.1) == 0.0


def test_users_stay_or_go_together(spark):
    df = spark.range(20_000).selectExpr("id % 5000 AS `a user`", "id AS x")
    kept = private.sampled_users(df, "a user", 0.25, "k").toPandas()
    assert set(kept.groupby("a user").size()) == {4} and abs(kept["a user"].nunique() - 1250) < 5 * math.sqrt(5000 * 0.25 * 0.75)
    again = private.sampled_users(df.repartition(7), "a user", 0.25, "k").toPandas()
    assert sorted(kept.x) == sorted(again.x)
    other = private.sampled_users(df, "a user", 0.25, "l").toPandas()
    assert abs(len(set(kept["a user"]) & set(other["a user"])) - 312) < 100  # keys are independent
    assert private.sampled_users(df, "a user", 1.0).count() == 20_000
    nameless = spark.sql("SELECT cast(null AS string) AS u FROM range(50)")
    assert private.sampled_users(nameless, "u", 0.5).count() in (0, 50)
    assert private.sampled_users(nameless.where("false"), "u", 0.5).count() == 0
    with pytest.raises(ValueError):
        private.sampled_users(df, "a user", 0.0)


def test_a_sample_adds_a_filter_and_no_shuffle(spark):
    plan = private.sampled_users(spark.range(10).toDF("u"), "u", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "Exchange" not in plan


SMALL = {"a": Categorical(("x", "y")), "b": Categorical(("p", "q", "r"))}


def _rows(spark, n=4000):
    return spark.range(n).selectExpr("id AS u", "if(id % 4 = 0, 'x', 'y') AS a", "if(id % 4 = 0, 'p', if(id % 8 < 4, 'q', 'r')) AS b")


def test_a_sampled_table_keeps_its_size(spark):
    made = synthesize(_rows(spark), SMALL, 3.0, 1e-6, seed=1, share=0.5, user="u")
    assert abs(made.count() - 4000) < 600
    assert abs(made.where("a = 'x'").count() / made.count() - 0.25) < 0.08
    with pytest.raises(ValueError, match="users apart"):
        synthesize(_rows(spark), SMALL, 3.0, 1e-6, share=0.5)


def test_initializers_of_ones_own(spark):
    """A column of prose is coded by its length, with given shares; a number gets given edges, which are measured."""
    seen = {}

    def yes(df, column, attribute, rho, rng, per_user):
        seen[column] = rho, per_user
        return Categorical(("no", "yes")), np.array([1.0, 3.0])

    def halves(df, column, attribute, rho, rng, per_user):
        seen[column] = rho, per_user
        return Numerical(attribute.low, attribute.high, (2000.0,)), None

    df = _rows(spark).selectExpr("a", "if(a = 'x', 'no', 'yes') AS prose", "double(u) AS u")
    schema = {"a": SMALL["a"], "prose": FreeText(), "u": Numerical(0, 4000)}
    made = synthesize(df, schema, 5.0, 1e-6, seed=1, initializers={"prose": yes, "u": halves}, per_user=2).toPandas()
    each = 0.1 * budget.zcdp_rho(5.0, 1e-6) / 2
    assert seen == {"prose": (pytest.approx(each), 2), "u": (pytest.approx(each), 2)}
    assert abs((made.prose == "yes").mean() - 0.75) < 0.05 and set(made.u) == {1000.0, 3000.0}
    assert abs((made.u == 1000.0).mean() - 0.5) < 0.05
    for bad in (lambda *_: (FreeText(), None), lambda *_: (SMALL["a"], np.ones(3))):
        with pytest.raises(ValueError, match="initializer"):
            synthesize(df, schema, 5.0, 1e-6, initializers={"prose": bad, "u": halves})
    with pytest.raises(ValueError, match="no column"):
        synthesize(df, schema, 5.0, 1e-6, initializers={"z": yes})


def test_a_mechanism_of_ones_own(spark):
    asked = []

    def even(codes, schema, rho, rng, sensitivity, known):
        asked.append((rho, sensitivity, codes.columns))
        return fit_tree(schema, {c: np.ones(a.size) for c, a in schema.items()}, {}, 600)

    made = synthesize(_rows(spark), SMALL, 1.0, 1e-6, method=even).toPandas()
    assert asked == [(pytest.approx(budget.zcdp_rho(1.0, 1e-6)), 1, ["a", "b"])]
    assert len(made) == 600 and abs((made.a == "x").mean() - 0.5) < 0.1
    with pytest.raises(ValueError):
        synthesize(_rows(spark), SMALL, 1.0, 1e-6, method=even, workload={("a", "b"): 1.0})


@pytest.mark.parametrize("method", ["aim", "aim_gdp"])
def test_a_workload_of_ones_own(spark, method):
    """Only parts of the workload's cliques are measured, and weights say which comes first."""
    df = _rows(spark).selectExpr("a", "b", "a AS c", "b AS d")
    schema = {"a": SMALL["a"], "b": SMALL["b"], "c": SMALL["a"], "d": SMALL["b"]}
    codes = encode_table(df, schema)
    model = synthesize_codes(codes, schema, 100.0, np.random.default_rng(0), method, workload={("c", "a"): 5.0, ("b", "d"): 0.1})
    measured = [r["clique"] for r in model.log]
    assert set(measured) == {"a|c", "b|d"} and measured[0] == "a|c"
    single = synthesize_codes(codes, schema, 100.0, np.random.default_rng(0), method, workload={("a",): 1.0})
    assert abs(single.total - 4000) < 10
    with pytest.raises(ValueError, match="lacks"):
        synthesize_codes(codes, schema, 1.0, np.random.default_rng(0), method, workload={("a", "z"): 1.0})


def test_selection_by_a_laplace_accountant():
    assert budget.laplace_epsilon(math.sqrt(2)) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        budget.laplace_epsilon(0)


def test_endless_ranges(spark):
    a = Numerical(-math.inf, math.inf, (0.0, 10.0))
    assert a.spans() == [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0)]
    assert a.labels() == ["(-inf, 0.0]", "(0.0, 10.0]", "(10.0, inf]"]
    assert Numerical(0, math.inf, (3,), integer=True).labels() == ["[0, 3]", "[4, inf]"]
    df = spark.createDataFrame([(-1e300,), (0.0,), (7.0,), (1e300,), (None,)], "x double")
    codes = [r.x for r in encode_table(df, {"x": a}).collect()]
    assert codes == [0, 0, 1, 2, 0]
    back = spark.createDataFrame([(k,) for k in range(3)], "x int")
    for decode in ("midpoint", "sample"):
        got = [r.v for r in back.select(undiscretize("x", Numerical(-math.inf, math.inf, (0.0, 10.0), decode=decode), "x").alias("v")).collect()]
        assert got[0] == 0.0 and 0 <= got[1] <= 10 and got[2] == 10.0
    with pytest.raises(ValueError, match="endless"):
        Numerical(0, math.inf)


def test_answers_keep_their_types(spark):
    schema = {"n": Categorical((0, 3)), "ok": Categorical((False, True)), "s": Categorical(("none", "a")), "v": Numerical(-math.inf, math.inf, (1.0,)), "t": OpenSet()}
    found = annotate.json_schema(schema)["properties"]
    assert found["n"] == {"type": "integer", "enum": [0, 3]} and found["ok"] == {"type": "boolean", "enum": [False, True]}
    assert found["s"] == {"type": "string", "enum": ["none", "a"]} and found["v"] == {"type": "number"}
    answers = [('{"n": 3, "ok": true, "s": "a", "v": -5, "t": "x"}',), ('{"n": 4, "ok": "maybe", "s": "b"}',)]
    rows = annotate.parse_answers(spark.createDataFrame(answers, "x string"), "x", schema).collect()
    assert (rows[0].n, rows[0].ok, rows[0].s, rows[0].v, rows[0].t, rows[0]["_fields_decoded"]) == (3, True, "a", -5.0, "x", 5)
    assert (rows[1].n, rows[1].ok, rows[1].s, rows[1].v, rows[1]["_fields_decoded"]) == (0, False, "none", 1.0, 0)
