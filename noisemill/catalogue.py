"""Every registered query of the library, and the SQL that gives the same rows."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisemill.functions import codec
from noisemill.operators import annotate, compression, counts, evaluate, private, relational
from noisemill.plans import cliques, families, synthesis
from noisemill.sources import records
from noisemill.spec import Categorical, Constraint, ForeignKey, Numerical, OpenSet, Relations, Schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STATUS = Categorical(("F", "O", "P"))
PRIORITY = Categorical(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
PRICE = Numerical(0, 500_000, (100_000.0, 200_000.0, 300_000.0, 400_000.0))
ORDERS: Schema = {"o_orderstatus": STATUS, "o_orderpriority": PRIORITY, "o_totalprice": PRICE}
LINES: Schema = {
    "l_returnflag": Categorical(("A", "N", "R")),
    "l_linestatus": Categorical(("F", "O")),
    "l_quantity": Numerical(1, 50, (10.0, 20.0, 30.0, 40.0)),
    "l_discount": Numerical(0, 0.1, (0.025, 0.055, 0.085)),
}
CUSTOMERS: Schema = {"c_mktsegment": Categorical(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")), "c_acctbal": Numerical(-1000, 10_000, (1000.0, 4000.0, 7000.0))}
ORDER_KEY = ForeignKey("customer", "c_custkey", "orders", "o_custkey", 8)
LINE_KEY = ForeignKey("orders", "o_orderkey", "lineitem", "l_orderkey", 3)
CHAIN = Relations((ORDER_KEY, LINE_KEY), {"customer": CUSTOMERS, "orders": ORDERS, "lineitem": LINES})
KEYS = {"customer": "c_custkey"}
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ROWS_IN_ORDER = {"orders": ["o_orderkey"], "lineitem": LINE_ORDER}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL for it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def bins(column: str, a: Numerical) -> str:
    """SQL for the code of a number that is never null."""
    code = " + ".join(f"CASE WHEN {column} > {e} THEN 1 ELSE 0 END" for e in a.edges)
    return f"CAST({code} AS INT)" if a.clip else f"CAST(CASE WHEN {column} < {a.low} OR {column} > {a.high} THEN 0 ELSE {code} + 1 END AS INT)"


def place(column: str, a: Categorical) -> str:
    """SQL for the code of a category."""
    cases = " ".join(f"WHEN {v!r} THEN {k}" for k, v in enumerate(a.values))
    return f"CAST(CASE {column} {cases} ELSE {a.ood} END AS INT)"


def coded(columns: Schema, frm: str, *more: str) -> str:
    cells = [f"{(place if isinstance(a, Categorical) else bins)(c, a)} AS {c}" for c, a in columns.items()]
    return f"SELECT {', '.join([*more, *cells])} FROM {frm}"


# ---- values and codes

_FEW = Categorical(("other", "1-URGENT", "2-HIGH", "5-LOW"))
_NARROW = Numerical(10_000, 400_000, (100_000.0, 250_000.0))
_OPEN = replace(_NARROW, clip=False)
_WHOLE = Numerical(2, 6, (3.0, 5.0), integer=True)


@query(f"SELECT o_orderkey, {place('o_orderpriority', _FEW)} AS code FROM orders")
def encode_categorical_ood(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", codec.encode_categorical("o_orderpriority", _FEW).alias("code"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_partkey BETWEEN 1 AND 1500 THEN 1500 - l_partkey ELSE 3 END AS INT) AS code FROM lineitem")
def encode_many_values(spark, sf):
    """1500 values, the last first: looked up by a join."""
    a = Categorical(tuple(range(1500, 0, -1)), ood=3)
    return codec.encode_table(table(spark, sf, "lineitem"), {"l_partkey": a}, ("l_orderkey", "l_linenumber")).withColumnRenamed("l_partkey", "code")


@query("SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 2 ELSE 0 END AS INT) AS code, CASE WHEN o_orderpriority = '2-HIGH' THEN '2-HIGH' WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN '1-URGENT' ELSE 'other' END AS value FROM orders")
def reversible_chain(spark, sf):
    """Values to codes, two rare codes to one, and back."""
    both = codec.coded(_FEW).then(codec.merged([True, False, True, False]))
    return table(spark, sf, "orders").select("o_orderkey", both("o_orderpriority").cast("int").alias("code"), both.inverse()(both("o_orderpriority")).alias("value"))


@query("SELECT o_orderkey, round((greatest(10000, least(o_totalprice, 400000)) - 10000) / 390000.0, 9) AS unit, round(greatest(10000, least(o_totalprice, 400000)), 4) AS value FROM orders")
def unit_interval(spark, sf):
    to = codec.unit_interval(_NARROW)
    return table(spark, sf, "orders").select("o_orderkey", F.round(to("o_totalprice"), 9).alias("unit"), F.round(to.inverse()(to("o_totalprice")), 4).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') THEN o_orderpriority ELSE 'other' END AS value FROM orders")
def decode_categorical(spark, sf):
    return encode_categorical_ood(spark, sf).select("o_orderkey", codec.decode_categorical("code", _FEW).alias("value"))


@query("SELECT o_orderkey, least(greatest(o_totalprice, 10000.0), 400000.0) AS value FROM orders")
def standardize_numeric_clip(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", codec.standardize_numeric("o_totalprice", _NARROW).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 10000 AND 400000 THEN o_totalprice END AS value FROM orders")
def standardize_numeric_ood(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", codec.standardize_numeric("o_totalprice", _OPEN).alias("value"))


@query(f"SELECT o_orderkey, {bins('o_totalprice', _NARROW)} AS code FROM orders")
def discretize_clip(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", codec.discretize("o_totalprice", _NARROW).alias("code"))


@query(f"SELECT o_orderkey, {bins('o_totalprice', _OPEN)} AS code FROM orders")
def discretize_ood(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", codec.discretize("o_totalprice", _OPEN).alias("code"))


_EVEN = Numerical(1, 50, codec.uniform_edges(1, 50, 7))


@query(f"SELECT code, count(*) AS n FROM (SELECT {bins('l_quantity', _EVEN)} AS code FROM lineitem) GROUP BY code")
def discretize_uniform(spark, sf):
    return table(spark, sf, "lineitem").select(codec.discretize("l_quantity", _EVEN).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(f"SELECT l_linenumber, {bins('l_linenumber', _WHOLE)} AS code, count(*) AS n FROM lineitem GROUP BY ALL")
def discretize_int(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linenumber", codec.discretize("l_linenumber", _WHOLE).alias("code")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, CASE {bins('o_totalprice', _NARROW)} WHEN 0 THEN 55000.0 WHEN 1 THEN 175000.0 ELSE 325000.0 END::DOUBLE AS value FROM orders")
def undiscretize_midpoint(spark, sf):
    return discretize_clip(spark, sf).select("o_orderkey", codec.undiscretize("code", _NARROW).alias("value"))


@query(f"SELECT o_orderkey, CASE {bins('o_totalprice', _OPEN)} WHEN 0 THEN '' WHEN 1 THEN '[10000, 100000.0]' WHEN 2 THEN '(100000.0, 250000.0]' ELSE '(250000.0, 400000]' END AS label FROM orders")
def undiscretize_interval_label(spark, sf):
    a = replace(_OPEN, decode="interval")
    return discretize_ood(spark, sf).select("o_orderkey", codec.undiscretize("code", a).alias("label"))


@query("SELECT o_orderkey, CAST(round_even((greatest(0.0::DOUBLE, least(o_totalprice, 400000.0::DOUBLE)) - 0.0) / 25.0, 0) AS BIGINT) AS point FROM orders")
def grid_index(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", codec.grid_index("o_totalprice", 0, 400_000, 25.0).alias("point"))


_COMMON = [True, False, True, False, True]


@query(f"SELECT o_orderkey, CAST(CASE {place('o_orderpriority', PRIORITY)} WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS INT) AS code FROM orders")
def merge_rare_codes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", codec.merge_rare(codec.encode_categorical("o_orderpriority", PRIORITY), _COMMON).alias("code"))


@query(f"SELECT o_orderkey, CAST(CASE {place('o_orderpriority', PRIORITY)} WHEN 0 THEN 0 WHEN 2 THEN 2 WHEN 4 THEN 4 ELSE 1 END AS INT) AS code FROM orders")
def unmerge_rare_first(spark, sf):
    return merge_rare_codes(spark, sf).select("o_orderkey", codec.unmerge_rare("code", _COMMON).alias("code"))


@query(coded(LINES, "lineitem", "l_orderkey"))
def apply_codec_table(spark, sf):
    return codec.encode_table(table(spark, sf, "lineitem"), LINES, keep=("l_orderkey",))


@query("SELECT o_orderstatus, o_orderpriority, CASE " + bins("o_totalprice", PRICE) + " WHEN 0 THEN 50000.0 WHEN 1 THEN 150000.0 WHEN 2 THEN 250000.0 WHEN 3 THEN 350000.0 ELSE 450000.0 END::DOUBLE AS o_totalprice, count(*) AS n FROM orders GROUP BY ALL")
def codec_roundtrip_counts(spark, sf):
    back = codec.decode_table(codec.encode_table(table(spark, sf, "orders"), ORDERS), ORDERS)
    return back.groupBy(*ORDERS).agg(F.count("*").alias("n"))


def _compression_sql() -> str:
    """Codes below a quarter of the rows merged, and the joint counts of what comes of it."""
    maps = []
    for c, a in ORDERS.items():
        maps.append(f"""n_{c} AS (SELECT CAST(k.range AS INT) AS code, count(o.{c}) AS n FROM range({a.size}) k LEFT JOIN coded o ON o.{c} = k.range GROUP BY ALL),
        f_{c} AS (SELECT code, n >= 3 * ((SELECT count(*) FROM coded) / 12e0) AS common FROM n_{c}),
        m_{c} AS (SELECT code, CASE WHEN count_if(common) OVER () + 1 >= {a.size} THEN code WHEN common THEN count_if(common) OVER (ORDER BY code) - 1 ELSE count_if(common) OVER () END AS bin,
            CASE WHEN count_if(common) OVER () + 1 >= {a.size} OR common THEN code ELSE min(code) FILTER (NOT common) OVER () END AS back FROM f_{c})""")
    columns = ", ".join(f"CAST(m_{c}.bin AS INT) AS {c}_bin, CAST(m_{c}.back AS INT) AS {c}_back" for c in ORDERS)
    joins = " ".join(f"JOIN m_{c} ON m_{c}.code = o.{c}" for c in ORDERS)
    return f"WITH coded AS ({coded(ORDERS, 'orders', 'o_orderkey')}), {', '.join(maps)} SELECT {columns}, count(*) AS n FROM coded o {joins} GROUP BY ALL"


@query(_compression_sql())
def compressed_table(spark, sf):
    codes = codec.encode_table(table(spark, sf, "orders"), ORDERS)
    dense = counts.dense_counts(codes, ORDERS).toPandas()  # of the domain's size
    rows = codes.count()
    full = {c: dense[dense["column"] == c].sort_values("code")["n"].to_numpy(float) for c in ORDERS}
    rare = compression.find_compression(full, rows / 12.0)
    small = rare.compress(codes)
    sums = small.groupBy(*ORDERS).agg(F.count("*").alias("n"))
    back = rare.uncompress(sums.select(*ORDERS, *(F.col(c).alias(f"{c}_bin") for c in ORDERS), "n"))
    return back.select(*(F.col(f"{c}_bin").cast("int") for c in ORDERS), *(F.col(c).cast("int").alias(f"{c}_back") for c in ORDERS), "n")


# ---- counts


def _union_counts(frm: str, columns: list[str]) -> str:
    parts = [f"SELECT '{c}' AS \"column\", CAST({c} AS BIGINT) AS code, count(*) AS n FROM t GROUP BY {c}" for c in columns]
    return f"WITH t AS ({frm}) SELECT '__total' AS \"column\", CAST(0 AS BIGINT) AS code, count(*) AS n FROM t UNION ALL " + " UNION ALL ".join(parts)


@query(_union_counts(coded(LINES, "lineitem"), list(LINES)))
def sufficient_stats_all_columns(spark, sf):
    return counts.column_counts(codec.encode_table(table(spark, sf, "lineitem"), LINES), list(LINES))


@query("SELECT CAST(round_even((o_totalprice - 1000.0) / 5000.0, 0) AS BIGINT) AS point, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 400000 GROUP BY 1")
def grid_histogram(spark, sf):
    return private.grid_histogram(table(spark, sf, "orders"), "o_totalprice", 1000, 400_000, 5000.0, clip=False)


@query("SELECT * FROM (SELECT 'p_name' AS \"column\", p_name AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY 2) WHERE n >= 2")
def open_set_counts_min2(spark, sf):
    return counts.open_counts(table(spark, sf, "part"), {"p_name": OpenSet(), "p_brand": OpenSet()}, 2)


_ROOMY: Schema = {"p_type": Categorical(("<OOD>", "ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "NONE")), "p_size": Numerical(0, 60, (10.0, 55.0), integer=True)}


@query("WITH d AS (SELECT 'p_type' AS \"column\", range AS code FROM range(8) UNION ALL SELECT 'p_size', range FROM range(3)), t AS (" + coded(_ROOMY, "part") + "), c AS (SELECT 'p_type' AS \"column\", CAST(p_type AS BIGINT) AS code, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'p_size', CAST(p_size AS BIGINT), count(*) FROM t GROUP BY 2) SELECT \"column\", code, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (\"column\", code)")
def one_way_counts_dense(spark, sf):
    return counts.dense_counts(codec.encode_table(table(spark, sf, "part"), _ROOMY), _ROOMY)


@query("WITH d AS (SELECT 'p_type' AS \"column\", range AS code FROM range(8) UNION ALL SELECT 'p_size', range FROM range(3)), t AS (" + coded(_ROOMY, "part") + "), c AS (SELECT 'p_type' AS \"column\", CAST(p_type AS BIGINT) AS code, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'p_size', CAST(p_size AS BIGINT), count(*) FROM t GROUP BY 2), e AS (SELECT \"column\", CASE WHEN \"column\" = 'p_type' AND code IN (1, 2) OR \"column\" = 'p_size' AND code = 1 THEN code ELSE -1 END AS bin, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (\"column\", code)) SELECT \"column\", bin, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / sqrt(count(*)), 6) AS scaled FROM e GROUP BY ALL")
def compressed_counts(spark, sf):
    common = spark.createDataFrame([("p_type", 1), ("p_type", 2), ("p_size", 1)], "column string, code long")
    return counts.compressed(one_way_counts_dense(spark, sf), common).withColumn("scaled", F.round("scaled", 6))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_linenumber")))
def min_max_per_column(spark, sf):
    return counts.ends(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_linenumber"])


@query("WITH t AS (" + coded(ORDERS, "orders") + ") SELECT o_orderstatus, o_totalprice, count(*) AS n FROM t GROUP BY ALL")
def marginal_2way(spark, sf):
    return counts.marginal(codec.encode_table(table(spark, sf, "orders"), ORDERS), ("o_orderstatus", "o_totalprice"))


@query("WITH t AS (" + coded(ORDERS, "orders") + ") SELECT o_orderstatus, o_orderpriority, o_totalprice, count(*) AS n FROM t GROUP BY ALL")
def marginal_3way(spark, sf):
    return counts.marginal(codec.encode_table(table(spark, sf, "orders"), ORDERS), tuple(ORDERS))


def _cells_sql(schema: Schema, workload: list[tuple[str, ...]], frm: str, weight: str = "count(*)") -> str:
    parts = []
    for k, clique in enumerate(workload):
        stride, terms = 1, []
        for c in reversed(clique):
            terms.append(f"CAST({c} AS BIGINT) * {stride}")
            stride *= schema[c].size
        parts.append(f"SELECT CAST({k} AS INT) AS clique, {' + '.join(terms)} AS cell, {weight} AS n FROM t GROUP BY 2")
    return f"WITH t AS ({frm}) " + " UNION ALL ".join(parts)


_PAIRS = list(itertools.combinations(LINES, 2))
_TRIPLES = list(itertools.combinations(LINES, 3))


@query(_cells_sql(LINES, _PAIRS, coded(LINES, "lineitem")))
def marginals_workload(spark, sf):
    return counts.marginals(codec.encode_table(table(spark, sf, "lineitem"), LINES), LINES, _PAIRS)


@query(_cells_sql(LINES, _TRIPLES, coded(LINES, "lineitem")))
def marginal_linear_index(spark, sf):
    return counts.marginals(codec.encode_table(table(spark, sf, "lineitem"), LINES), LINES, _TRIPLES)


@query("SELECT 'l_returnflag' AS clique, CAST(NULL AS VARCHAR) AS l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'l_returnflag|l_linestatus', l_linestatus, l_returnflag, count(*) FROM lineitem GROUP BY l_linestatus, l_returnflag")
def marginals_grouping_sets(spark, sf):
    return counts.grouping_sets(table(spark, sf, "lineitem"), [("l_returnflag",), ("l_returnflag", "l_linestatus")])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS n FROM lineitem GROUP BY ALL")
def marginal_weighted(spark, sf):
    return counts.marginal(table(spark, sf, "lineitem"), ("l_returnflag", "l_linestatus"), "l_quantity").withColumn("n", F.round("n", 6))


def _independence_sql() -> str:
    parts = []
    for a, b in itertools.combinations(ORDERS, 2):
        parts.append(f"SELECT '{a}|{b}' AS clique, (SELECT sum(abs(coalesce(o.n, 0) - x.n * y.n / t.n)) FROM (SELECT {a} AS u, count(*)::DOUBLE AS n FROM t GROUP BY 1) x CROSS JOIN (SELECT {b} AS v, count(*)::DOUBLE AS n FROM t GROUP BY 1) y CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM t) t LEFT JOIN (SELECT {a} AS u, {b} AS v, count(*) AS n FROM t GROUP BY 1, 2) o USING (u, v)) AS error")
    return "WITH t AS (" + coded(ORDERS, "orders") + ") SELECT clique, round(error, 4) AS error FROM (" + " UNION ALL ".join(parts) + ")"


@query(_independence_sql())
def independence_error_pairs(spark, sf):
    return synthesis.pair_errors(table(spark, sf, "orders"), ORDERS).withColumn("error", F.round("error", 4))


@query("SELECT clique, error, row_number() OVER (ORDER BY error DESC, clique)::INT AS place FROM (" + _independence_sql() + ") ORDER BY place LIMIT 2")
def largest_error_pairs(spark, sf):
    return counts.largest_errors(independence_error_pairs(spark, sf), 2)


# ---- evaluation: two parts of a table, told apart by the key, stand for original and synthetic


def _parts(spark, sf, name: str = "orders", key: str = "o_orderkey") -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf, name)
    return df.where(F.col(key) % 3 != 0), df.where(F.col(key) % 3 == 0)


_COARSE = "SELECT o_orderstatus, o_orderpriority, CAST(floor(o_totalprice / 50000) AS BIGINT) AS band, o_orderkey % 3 <> 0 AS real FROM orders"
_SEEN = ["o_orderstatus", "o_orderpriority", "band"]


def _bands(spark, sf) -> tuple[DataFrame, DataFrame]:
    return tuple(x.withColumn("band", F.floor(F.col("o_totalprice") / 50000)) for x in _parts(spark, sf))


@query("SELECT \"column\", count(*) AS rows, count(value) AS present, count(DISTINCT value) AS distinct_values FROM (SELECT 'o_orderstatus' AS \"column\", nullif(o_orderstatus, 'P') AS value FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders) GROUP BY 1")
def dataset_statistics(spark, sf):
    df = table(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return evaluate.statistics(df, ["o_orderstatus", "o_custkey"])


@query("SELECT 'o_orderstatus' AS \"column\", coalesce(nullif(o_orderstatus, 'P'), 'None') AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def value_counts_null_as_category(spark, sf):
    df = table(spark, sf, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return evaluate.value_counts(df, ["o_orderstatus", "o_orderpriority"])


def _tv_sql(degree: int) -> str:
    parts = []
    for r in range(1, degree + 1):
        for c in itertools.combinations(_SEEN, r):
            cell = " || '|' || ".join(f"CAST({x} AS VARCHAR)" for x in c)
            parts.append(f"SELECT '{'|'.join(c)}' AS clique, {cell} AS cell, real FROM t")
    return f"WITH t AS ({_COARSE}), long AS ({' UNION ALL '.join(parts)}), c AS (SELECT clique, cell, count(*) FILTER (real) AS a, count(*) FILTER (NOT real) AS b FROM long GROUP BY 1, 2), s AS (SELECT *, sum(a) OVER (PARTITION BY clique) AS na, sum(b) OVER (PARTITION BY clique) AS nb FROM c) SELECT clique, round(0.5 * sum(abs(a / na - b / nb)), 9) AS tv, count(*) FILTER (a = 0 AND b > 0) AS unseen, CAST(coalesce(sum(b) FILTER (a = 0), 0) AS BIGINT) AS unseen_rows FROM s GROUP BY 1"


def _tv(spark, sf, degree: int) -> DataFrame:
    return evaluate.total_variation(*_bands(spark, sf), _SEEN, degree).withColumn("tv", F.round("tv", 9))


@query(_tv_sql(1))
def tv_one_way(spark, sf):
    return _tv(spark, sf, 1)


@query(_tv_sql(2))
def tv_multiway_deg2(spark, sf):
    return _tv(spark, sf, 2)


@query(_tv_sql(3))
def tv_multiway_deg3(spark, sf):
    return _tv(spark, sf, 3)


_FINE = "SELECT o_orderpriority, CAST(floor(o_totalprice / 100) AS BIGINT) AS band, o_orderkey % 3 <> 0 AS real FROM orders"


def _fine(spark, sf) -> tuple[DataFrame, DataFrame]:
    return tuple(x.withColumn("band", F.floor(F.col("o_totalprice") / 100)) for x in _parts(spark, sf))


@query(f"WITH c AS (SELECT o_orderpriority, band, count(*) FILTER (real) AS a, count(*) FILTER (NOT real) AS b FROM ({_FINE}) GROUP BY 1, 2) SELECT 'o_orderpriority|band' AS clique, count(*) AS unseen, CAST(sum(b) AS BIGINT) AS unseen_rows FROM c WHERE a = 0 AND b > 0")
def unseen_combinations(spark, sf):
    return evaluate.unseen(*_fine(spark, sf), ["o_orderpriority", "band"])


@query(f"WITH c AS (SELECT '[\"' || o_orderpriority || '\",\"' || band || '\"]' AS cell, count(*) FILTER (real) AS a, count(*) FILTER (NOT real) AS n FROM ({_FINE}) GROUP BY 1) SELECT cell, n, CAST(row_number() OVER (ORDER BY n DESC, cell) AS INT) AS place FROM c WHERE a = 0 AND n > 0 ORDER BY n DESC, cell LIMIT 3")
def top3_unseen(spark, sf):
    return evaluate.top_unseen(*_fine(spark, sf), ("o_orderpriority", "band"), 3)


_CELLS = {"o_orderpriority|band": "'[\"' || o_orderpriority || '\",\"' || band || '\"]'", "band": "'[\"' || band || '\"]'"}
_EACH = " UNION ALL ".join(f"SELECT '{k}' AS clique, {cell} AS cell, real FROM ({_FINE})" for k, cell in _CELLS.items())


@query(f"WITH c AS (SELECT clique, cell, count(*) FILTER (real) AS a, count(*) FILTER (NOT real) AS n FROM ({_EACH}) GROUP BY 1, 2), r AS (SELECT clique, cell, n, CAST(row_number() OVER (PARTITION BY clique ORDER BY n DESC, cell) AS INT) AS place FROM c WHERE a = 0 AND n > 0) SELECT * FROM r WHERE place <= 3")
def top3_unseen_each(spark, sf):
    return evaluate.top_unseen_each(*_fine(spark, sf), [tuple(k.split("|")) for k in _CELLS], 3)


@query(f"WITH t AS ({_COARSE}), c AS (SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS v, count(*) FILTER (real)::DOUBLE AS a, count(*) FILTER (NOT real)::DOUBLE AS b FROM t GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FILTER (real), count(*) FILTER (NOT real) FROM t GROUP BY 2), s AS (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb FROM c WINDOW w AS (PARTITION BY \"column\")) SELECT \"column\", round(sum((a - (a + b) * na / (na + nb)) ** 2 / ((a + b) * na / (na + nb)) + (b - (a + b) * nb / (na + nb)) ** 2 / ((a + b) * nb / (na + nb))), 6) AS statistic, count(*) - 1 AS dof FROM s GROUP BY 1")
def chi2_two_sample_stat(spark, sf):
    return evaluate.chi_squared(*_parts(spark, sf), ["o_orderstatus", "o_orderpriority"]).withColumn("statistic", F.round("statistic", 6))


_TWO_WAY = "SELECT o_orderkey % 3 <> 0 AS real, o_totalprice > 250000 AS v FROM orders"


@query(f"WITH c AS (SELECT v, count(*) FILTER (real)::DOUBLE AS a, count(*) FILTER (NOT real)::DOUBLE AS b FROM ({_TWO_WAY}) GROUP BY v), s AS (SELECT *, (a + b) * sum(a) OVER () / (sum(a) OVER () + sum(b) OVER ()) AS e, (a + b) * sum(b) OVER () / (sum(a) OVER () + sum(b) OVER ()) AS f FROM c) SELECT 'dear' AS \"column\", round(sum((abs(a - e) - least(0.5, abs(a - e))) ** 2 / e + (abs(b - f) - least(0.5, abs(b - f))) ** 2 / f), 6) AS statistic, count(*) - 1 AS dof FROM s")
def chi2_two_values_corrected(spark, sf):
    two = (x.withColumn("dear", F.col("o_totalprice") > 250_000) for x in _parts(spark, sf))
    return evaluate.chi_squared(*two, ["dear"]).withColumn("statistic", F.round("statistic", 6))


@query(f"SELECT \"column\", dof, round(CASE dof WHEN 2 THEN exp(-statistic / 2) ELSE exp(-statistic / 2) * (1 + statistic / 2) END, 6) AS p FROM ({ORACLES['chi2_two_sample_stat'].replace(', 6) AS statistic', ', 12) AS statistic')})")
def chi2_p_values(spark, sf):
    """The tail's closed form, for the two columns with two and four degrees of freedom."""
    tests = evaluate.chi_squared(*_parts(spark, sf), ["o_orderstatus", "o_orderpriority"])
    return evaluate.with_p_values(tests).select("column", "dof", F.round("p", 6).alias("p"))


_KINDS = {"o_orderstatus": "o_orderstatus", "o_totalprice": "CAST(o_totalprice AS VARCHAR)", "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "nothing": "CAST(NULL AS VARCHAR)"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN count({x}) > 0 AND count({x}) = count(TRY_CAST({x} AS DOUBLE)) THEN 'number' ELSE 'category' END AS kind FROM orders" for c, x in _KINDS.items()))
def evaluation_types(spark, sf):
    """Columns as a reader without a schema gives them: all text."""
    texts = table(spark, sf, "orders").withColumn("nothing", F.lit(None)).select(*(F.col(c).cast("string").alias(c) for c in _KINDS))
    return evaluate.evaluation_types(texts, list(_KINDS))


def _attribute_sql() -> str:
    sides = (f"(SELECT '{c}' AS \"column\", count({c}) FILTER (real) AS original_present, count(DISTINCT {c}) FILTER (real) AS original_distinct, count({c}) FILTER (NOT real) AS synthetic_present, count(DISTINCT {c}) FILTER (NOT real) AS synthetic_distinct FROM ({_COARSE}))" for c in _SEEN[:2])
    return f"SELECT s.*, v.tv, v.unseen, v.unseen_rows, x.statistic, p.dof, p.p FROM ({' UNION ALL '.join(sides)}) s JOIN ({ORACLES['tv_one_way']}) v ON v.clique = s.\"column\" JOIN ({ORACLES['chi2_two_sample_stat']}) x ON x.\"column\" = s.\"column\" JOIN ({ORACLES['chi2_p_values']}) p ON p.\"column\" = s.\"column\""


@query(_attribute_sql())
def attribute_report(spark, sf):
    out = evaluate.attribute_report(*_parts(spark, sf), _SEEN[:2])
    return out.withColumns({c: F.round(c, n) for c, n in (("tv", 9), ("statistic", 6), ("p", 6))})


def _cramer_sql(frm: str, columns: list[str]) -> str:
    parts = [f"SELECT '{a}|{b}' AS pair, CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y FROM ({frm})" for a, b in itertools.combinations(columns, 2)]
    return f"SELECT pair, sqrt(greatest(sum(o * o / (r * c)) - 1, 0) / (least(count(DISTINCT x), count(DISTINCT y)) - 1)) AS v FROM (SELECT *, sum(o) OVER (PARTITION BY pair, x) AS r, sum(o) OVER (PARTITION BY pair, y) AS c FROM (SELECT pair, x, y, count(*)::DOUBLE AS o FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)) GROUP BY pair"


_RELATED = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"]


@query(f"SELECT pair, round(v, 9) AS v FROM ({_cramer_sql('SELECT * FROM lineitem', _RELATED)})")
def cramers_v_pairs(spark, sf):
    return evaluate.cramers_v(table(spark, sf, "lineitem"), _RELATED).withColumn("v", F.round("v", 9))


@query(f"SELECT round(sqrt(avg((x.v - y.v) ** 2)), 9) AS distance FROM ({_cramer_sql('SELECT * FROM lineitem WHERE l_orderkey % 3 <> 0', _RELATED)}) x JOIN ({_cramer_sql('SELECT * FROM lineitem WHERE l_orderkey % 3 = 0', _RELATED)}) y USING (pair)")
def correlation_distance(spark, sf):
    return evaluate.correlation_distance(*_parts(spark, sf, "lineitem", "l_orderkey"), _RELATED).withColumn("distance", F.round("distance", 9))


_TV2 = _tv_sql(2)


@query(f"SELECT 'total_variation' AS measure, clique AS name, tv AS value FROM ({_TV2}) UNION ALL SELECT 'unseen_rows', clique, unseen_rows::DOUBLE FROM ({_TV2}) UNION ALL SELECT 'association_distance', 'o_orderstatus|o_orderpriority', (SELECT round(sqrt(avg((x.v - y.v) ** 2)), 9) FROM ({_cramer_sql('SELECT * FROM orders WHERE o_orderkey % 3 <> 0', _SEEN[:2])}) x JOIN ({_cramer_sql('SELECT * FROM orders WHERE o_orderkey % 3 = 0', _SEEN[:2])}) y USING (pair))")
def evaluation_report(spark, sf):
    """The report without its tests, which have queries of their own."""
    made = evaluate.report(*_bands(spark, sf), _SEEN, _SEEN[:2])
    return made.where("measure not in ('chi_squared', 'p_value')").withColumn("value", F.round("value", 9))


@query("SELECT o_orderpriority, o_orderstatus, round(coalesce(avg(o_totalprice) FILTER (o_orderkey % 3 <> 0), -1), 4) AS real, round(coalesce(avg(o_totalprice) FILTER (o_orderkey % 3 = 0 AND o_orderstatus <> 'P'), -1), 4) AS synthetic FROM orders GROUP BY 1, 2")
def groupby_mean_compare(spark, sf):
    real, synthetic = _parts(spark, sf)
    out = evaluate.compare_means(real, synthetic.where("o_orderstatus <> 'P'"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return out.withColumn("real", F.round("real", 4)).withColumn("synthetic", F.round("synthetic", 4))


@query("SELECT o_orderpriority AS value, count(*) FILTER (o_orderkey % 3 <> 0) AS real, count(*) FILTER (o_orderkey % 3 = 0) AS synthetic FROM orders GROUP BY 1")
def histogram_compare(spark, sf):
    return evaluate.compare_histograms(*_parts(spark, sf), "o_orderpriority")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '5-LOW'), ('P', '1-URGENT'))")
def constraint_violations(spark, sf):
    rule = Constraint(("o_orderstatus", "o_orderpriority"), impossible=(("F", "5-LOW"), ("P", "1-URGENT")))
    return evaluate.violations(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), rule)


@query("SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY 1 HAVING n > 1")
def functional_dependency_check(spark, sf):
    return evaluate.breaks_dependency(table(spark, sf, "part"), "p_brand", "p_type")


# ---- tables below a root

#: Orders of which some name a customer that isn't there, or none.
_LOOSE = "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 1000000000 WHEN o_orderkey % 50 = 1 THEN NULL ELSE o_custkey END AS o_custkey FROM orders"


def _loose(spark, sf) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").withColumn("o_custkey", F.when(key % 50 == 0, F.col("o_custkey") + 1_000_000_000).when(key % 50 != 1, F.col("o_custkey")))


@query(f"SELECT c_custkey, count(o_orderkey) AS group_size FROM customer LEFT JOIN ({_LOOSE}) ON c_custkey = o_custkey GROUP BY 1")
def group_sizes_with_zero(spark, sf):
    return relational.group_sizes(table(spark, sf, "customer"), _loose(spark, sf), ORDER_KEY)


@query(f"SELECT o_orderkey, o_custkey FROM ({_LOOSE}) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)")
def orphan_check(spark, sf):
    return relational.orphans(_loose(spark, sf), table(spark, sf, "customer"), ORDER_KEY).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING n > 8")
def capacity_check(spark, sf):
    return relational.over_capacity(table(spark, sf, "orders"), ORDER_KEY)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING n > 1")
def pk_uniqueness(spark, sf):
    return relational.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey")


@query("SELECT l_orderkey, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1")
def first_duplicate_pk(spark, sf):
    return relational.first_rows(table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice").select("l_orderkey", "l_extendedprice")


@query(f"SELECT (SELECT count(*) FROM ({_LOOSE}) WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans, (SELECT max(n) FROM (SELECT count(*) AS n FROM ({_LOOSE}) JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey)) AS most_children, CAST(0 AS BIGINT) AS duplicate_keys")
def integrity_report(spark, sf):
    return relational.integrity(table(spark, sf, "customer"), _loose(spark, sf), ORDER_KEY)


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS sibling FROM ({_LOOSE}) WHERE o_custkey IS NOT NULL QUALIFY sibling < 8")
def sibling_rank(spark, sf):
    from pyspark.sql import Window

    kept = relational.truncate(_loose(spark, sf), ORDER_KEY, "o_orderkey")
    return kept.select("o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("sibling"))


_LINEAGE = f"WITH o AS (SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL AND row_number() OVER (PARTITION BY o_custkey, c_custkey IS NULL ORDER BY o_orderkey) <= 8 THEN c_custkey END AS root FROM ({_LOOSE}) LEFT JOIN customer ON c_custkey = o_custkey), l AS (SELECT lineitem.*, CASE WHEN root IS NOT NULL AND row_number() OVER (PARTITION BY l_orderkey, root IS NULL ORDER BY {', '.join(LINE_ORDER)}) <= 3 THEN root END AS root FROM lineitem LEFT JOIN o ON o_orderkey = l_orderkey)"


def _tables(spark, sf) -> dict[str, DataFrame]:
    return {"customer": table(spark, sf, "customer"), "orders": _loose(spark, sf), "lineitem": table(spark, sf, "lineitem")}


@query(_LINEAGE + " SELECT o_orderkey, root FROM o")
def lineage_truncated(spark, sf):
    return relational.lineage(_tables(spark, sf), CHAIN, KEYS, ROWS_IN_ORDER)["orders"].select("o_orderkey", F.col("_root").alias("root"))


@query(_LINEAGE + " SELECT l_orderkey, l_extendedprice, round(CASE WHEN root IS NULL THEN 0 ELSE 1.0 / count(*) OVER (PARTITION BY root) END::DOUBLE, 9) AS weight FROM l")
def hierarchical_weights(spark, sf):
    return relational.weights(_tables(spark, sf), CHAIN, KEYS, ROWS_IN_ORDER)["lineitem"].select("l_orderkey", "l_extendedprice", F.round("weight", 9).alias("weight"))


@query(_LINEAGE + " SELECT root, 1.0::DOUBLE AS weight FROM l WHERE root IS NOT NULL GROUP BY root")
def weights_sum_per_root(spark, sf):
    rows = relational.weights(_tables(spark, sf), CHAIN, KEYS, ROWS_IN_ORDER)["lineitem"]
    return rows.where("_root is not null").groupBy(F.col("_root").alias("root")).agg(F.round(F.sum("weight"), 9).alias("weight"))


_SMALL_KEY = replace(ORDER_KEY, capacity=4)


def _explored(spark, sf) -> DataFrame:
    parent = codec.encode_table(table(spark, sf, "customer"), CUSTOMERS, keep=("c_custkey",))
    child = codec.encode_table(_loose(spark, sf), {"o_orderstatus": STATUS}, keep=("o_custkey", "o_orderkey"))
    return relational.exploration_table(parent, child, _SMALL_KEY, ["c_mktsegment"], {"o_orderstatus": 3}, 2, ["o_orderkey"])


_KIDS = f"WITH k AS (SELECT o_custkey, {place('o_orderstatus', STATUS)} AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM ({_LOOSE.replace('SELECT o_orderkey,', 'SELECT o_orderkey, o_orderstatus,')}) WHERE o_custkey IS NOT NULL QUALIFY i <= 4), p AS (SELECT c_custkey, {place('c_mktsegment', CUSTOMERS['c_mktsegment'])} AS c_mktsegment, CAST(count(i) AS INT) AS g FROM customer LEFT JOIN k ON o_custkey = c_custkey GROUP BY ALL), x AS (SELECT c_mktsegment, g, a.s AS s1, b.s AS s2, 1.0 / (g * (g - 1)) AS w FROM p JOIN k a ON a.o_custkey = c_custkey JOIN k b ON b.o_custkey = c_custkey AND a.i <> b.i WHERE g >= 2 UNION ALL SELECT c_mktsegment, g, s, 3, 0.5 FROM p JOIN k ON o_custkey = c_custkey WHERE g = 1 UNION ALL SELECT c_mktsegment, g, 3, s, 0.5 FROM p JOIN k ON o_custkey = c_custkey WHERE g = 1 UNION ALL SELECT c_mktsegment, g, 3, 3, 1 FROM p WHERE g = 0)"


@query(_KIDS + " SELECT c_mktsegment, g AS group_size, CAST(s1 AS INT) AS s1, CAST(s2 AS INT) AS s2, round(sum(w)::DOUBLE, 6) AS weight FROM x GROUP BY ALL")
def exploration_table_o2(spark, sf):
    rows = _explored(spark, sf).withColumnsRenamed({"slot_1.o_orderstatus": "s1", "slot_2.o_orderstatus": "s2"})
    return rows.groupBy("c_mktsegment", "group_size", "s1", "s2").agg(F.round(F.sum("weight"), 6).alias("weight"))


@query("SELECT count(*)::DOUBLE AS weight FROM customer")
def exploration_weight_mass(spark, sf):
    return _explored(spark, sf).agg(F.round(F.sum("weight"), 6).alias("weight"))


@query("SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer) a JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r FROM supplier) b USING (r)")
def copula_rank_join(spark, sf):
    return relational.couple(table(spark, sf, "customer"), table(spark, sf, "supplier"), ["c_acctbal", "c_custkey"], ["s_acctbal", "s_suppkey"]).select("c_custkey", "s_suppkey")


@query("SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS surrogate, c_custkey FROM customer QUALIFY surrogate = row_number() OVER (ORDER BY c_custkey) - 1")
def assign_surrogate_keys(spark, sf):
    return relational.ranked(table(spark, sf, "customer").select("c_custkey"), "c_custkey", name="surrogate")


@query("SELECT o_orderkey AS family, CAST(slot AS INT) AS slot, CAST(v AS INT) AS band FROM (SELECT o_orderkey, o_custkey % 4 AS g, 1 AS slot, o_custkey % 7 AS v FROM orders UNION ALL SELECT o_orderkey, o_custkey % 4, 2, o_custkey % 5 FROM orders UNION ALL SELECT o_orderkey, o_custkey % 4, 3, o_custkey % 6 FROM orders) WHERE slot <= g AND v < 5")
def unstack_families(spark, sf):
    c = F.col("o_custkey")
    wide = table(spark, sf, "orders").select(F.col("o_orderkey").alias("family"), (c % 4).alias("group_size"), (c % 7).cast("int").alias("slot_1.band"), (c % 5).cast("int").alias("slot_2.band"), (c % 6).cast("int").alias("slot_3.band"))
    return relational.unstack(wide, 3, {"band": 5})


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def child_parent_join(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.join(table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


def _slot_bands(spark, sf, slots: int) -> DataFrame:
    """Orders with up to three made slots of one band column, 5 meaning empty."""
    c = F.col("o_custkey")
    cells = [F.when(c % 4 > s, c % (7 - s)).otherwise(5).cast("int").alias(f"slot_{s + 1}.band") for s in range(slots)]
    return table(spark, sf, "orders").select((F.col("o_orderkey") % 3).cast("int").alias("kind"), *(F.least(x, F.lit(5)).alias(f"slot_{s + 1}.band") for s, x in enumerate(cells)))


def _slot_bands_sql(slots: int) -> str:
    each = ", ".join(f"CASE WHEN o_custkey % 4 > {s} THEN least(o_custkey % {7 - s}, 5) ELSE 5 END AS b{s}" for s in range(slots))
    return f"WITH t AS (SELECT o_orderkey % 3 AS kind, {each} FROM orders)"


_TWO = [("kind", "slot_1.band"), ("slot_1.band", "slot_2.band"), ("kind",)]


@query(_slot_bands_sql(2) + ", r AS (SELECT 0 AS clique, kind * 6 + b0 AS cell, 0.5 AS n FROM t UNION ALL SELECT 0, kind * 6 + b1, 0.5 FROM t UNION ALL SELECT 1, b0 * 6 + b1, 0.5 FROM t UNION ALL SELECT 1, b1 * 6 + b0, 0.5 FROM t UNION ALL SELECT 2, kind, 1 FROM t) SELECT CAST(clique AS INT) AS clique, CAST(cell AS BIGINT) AS cell, round(sum(n)::DOUBLE, 6) AS n FROM r GROUP BY ALL")
def symmetrized_two_slots(spark, sf):
    sizes = {"kind": 3, "slot_1.band": 6, "slot_2.band": 6}
    return relational.symmetric_marginals(_slot_bands(spark, sf, 2), sizes, _TWO, 2).withColumn("n", F.round("n", 6))


_SLOT_PAIRS = [(a, b) for a in range(3) for b in range(3) if a != b]


@query(_slot_bands_sql(3) + ", f AS (SELECT *, CAST(b0 <> 5 AS INT) + CAST(b1 <> 5 AS INT) + CAST(b2 <> 5 AS INT) AS k FROM t), r AS (" + " UNION ALL ".join([f"SELECT 0 AS clique, kind * 6 + b{a} AS cell, 1.0::DOUBLE / k AS n FROM f WHERE b{a} <> 5" for a in range(3)] + [f"SELECT 1, b{a} * 6 + b{b}, 1.0::DOUBLE / (k * (k - 1)) FROM f WHERE b{a} <> 5 AND b{b} <> 5" for a, b in _SLOT_PAIRS]) + ") SELECT CAST(clique AS INT) AS clique, CAST(cell AS BIGINT) AS cell, round(sum(n), 6) AS n FROM r GROUP BY ALL")
def symmetrized_three_slots(spark, sf):
    """Only slots that hold a child: a family counts once for a clique of which it has enough children."""
    sizes = {"kind": 3, **{f"slot_{s}.band": 6 for s in (1, 2, 3)}}
    return relational.symmetric_marginals(_slot_bands(spark, sf, 3), sizes, _TWO[:2], 3, real={"band": 5}).withColumn("n", F.round("n", 6))


# ---- private releases, those parts that are exact


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5")
def contribution_bound_deterministic(spark, sf):
    by_user = ForeignKey("users", "user_id", "events", "user_id", 5)
    return relational.truncate(table(spark, sf, "events"), by_user, "event_id").select("user_id", "event_type", "value")


@query("WITH d AS (SELECT DISTINCT user_id, event_type FROM events), k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS k FROM d) SELECT event_type, round(sum(1 / sqrt(k)), 6) AS weight FROM k GROUP BY 1")
def sips_weighted_counts(spark, sf):
    return private.sips_weights(table(spark, sf, "events"), "user_id", "event_type", 5).withColumn("weight", F.round("weight", 6))



@query("WITH h AS (SELECT CAST(round_even(l_quantity - 1, 0) AS BIGINT) AS p, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT p, sum(n) OVER (ORDER BY p) AS c, sum(n) OVER () AS total FROM h), m AS (SELECT min(p) AS p FROM t WHERE c >= total / 2.0) SELECT CAST(p AS BIGINT) AS point FROM m")
def histogram_exact_median(spark, sf):
    """The median's grid point without noise: the rule that the private quantiles halve by."""
    from pyspark.sql import Window

    h = private.grid_histogram(table(spark, sf, "lineitem"), "l_quantity", 1, 50, 1.0)
    # one row for each of the grid's 50 points
    w = Window.orderBy("point")
    ranks = h.select("point", F.sum("n").over(w).alias("c"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    return ranks.where("c >= total / 2").agg(F.min("point").alias("point"))


_RELEASED = {("o_orderstatus", "o_orderpriority"): 3.0, ("o_totalprice",): 1.0, ("o_orderstatus", "o_totalprice"): 2.0}


@query(f"WITH t AS ({coded(ORDERS, 'orders')}), a AS (SELECT CAST(range AS BIGINT) AS cell FROM range(15)), b AS (SELECT CAST(range AS BIGINT) AS cell FROM range(5)), x AS (SELECT o_orderstatus * 5 + o_orderpriority AS cell, count(*) AS n FROM t GROUP BY ALL), y AS (SELECT o_totalprice AS cell, count(*) AS n FROM t GROUP BY ALL), z AS (SELECT o_orderstatus * 5 + o_totalprice AS cell, count(*) AS n FROM t GROUP BY ALL) SELECT CAST(0 AS INT) AS clique, cell, coalesce(n, 0)::DOUBLE AS n, 0.0::DOUBLE AS sigma FROM a LEFT JOIN x USING (cell) UNION ALL SELECT CAST(1 AS INT), cell, coalesce(n, 0)::DOUBLE, 0.0 FROM b LEFT JOIN y USING (cell) UNION ALL SELECT CAST(2 AS INT), cell, coalesce(n, 0)::DOUBLE, 0.0 FROM a LEFT JOIN z USING (cell)")
def weighted_release_exact(spark, sf):
    """Three joint tables released as one, without noise: all cells, those that don't occur as zero."""
    codes = codec.encode_table(table(spark, sf, "orders"), ORDERS)
    return private.release(codes, ORDERS, _RELEASED, float("inf"))


_CUTS = [5.0, 10.0, 10.0, 10.0, 33.0, 50.0, 50.0]


@query("SELECT CAST((l_quantity > 5)::INT + (l_quantity > 10)::INT + (l_quantity > 33)::INT AS INT) AS bin, count(*) AS n, [1, 3, 1, 3][bin + 1] / 8.0::DOUBLE AS share FROM lineitem GROUP BY ALL")
def edges_to_measurement(spark, sf):
    """Given cuts: the fine histogram's counts between them, and the shares that the cuts stand for."""
    a = Numerical(1, 50)
    edges, weights = private.edge_weights(_CUTS, a)
    bins = private.rebinned(private.grid_histogram(table(spark, sf, "lineitem"), "l_quantity", 1, 50, 1.0), edges, 1, 1.0)
    shares = F.array(*(F.lit(w / sum(weights)) for w in weights))
    return bins.select("bin", "n", F.get(shares, F.col("bin")).alias("share"))


_SAMPLED = f"{int(0.3 * (1 << 48)):012x}"


@query(f"SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events WHERE substr(sha256('open' || coalesce(CAST(user_id AS VARCHAR), '')), 1, 12) < '{_SAMPLED}' GROUP BY ALL")
def sampled_users(spark, sf):
    """Users and rows of a sample of three users in ten, under a key that is no secret here."""
    kept = private.sampled_users(table(spark, sf, "events"), "user_id", 0.3, "open")
    return kept.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))



@query("WITH v AS (SELECT 'p_brand' AS \"column\", p_brand AS value FROM part GROUP BY ALL HAVING count(*) >= 2 AND p_brand IS NOT NULL UNION ALL SELECT 'p_name', p_name FROM part WHERE p_name IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) SELECT \"column\", CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY encode(value)) AS INT) AS code, value FROM v UNION ALL SELECT c, CAST(0 AS INT), '<OOD>' FROM (VALUES ('p_brand'), ('p_name')) x(c)")
def open_set_discovery_exact(spark, sf):
    """Open columns without noise: values that two rows have, in order, after the default."""
    found = private.discover(table(spark, sf, "part"), {"p_name": OpenSet(), "p_brand": OpenSet()}, float("inf"), 1e-6, min_count=2)
    return spark.createDataFrame([(c, k, v) for c, vs in found.items() for k, v in enumerate(vs)], "column string, code int, value string")


@query("WITH d AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IS NOT NULL), k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS k FROM d) SELECT event_type FROM k GROUP BY ALL HAVING sum(1 / sqrt(k)) >= 1")
def dp_sips_partitions_exact(spark, sf):
    """Partitions without noise: those whose users' weights sum to one user's. No user has more than ``most``."""
    return private.sips(table(spark, sf, "events"), "user_id", "event_type", float("inf"), 1e-6, most=5, rounds=1)


def _fitted(method: str, columns: list[tuple[str, ...]]):
    """A model without noise: its counts of some columns, cells without rows left out."""

    def run(spark, sf):
        codes = codec.encode_table(table(spark, sf, "orders"), ORDERS)
        known = [("o_orderstatus", "o_totalprice"), ("o_orderstatus", "o_orderpriority")]
        model = synthesis.synthesize_codes(codes, ORDERS, float("inf"), np.random.default_rng(), method, known)
        rows = []
        for c in columns:
            x = model.total * (model.single(*c) if len(c) == 1 else model.pair(*c))
            rows += [("|".join(c), "|".join(map(str, at)), float(round(x[at], 6))) for at in np.ndindex(x.shape) if round(x[at], 6) > 0]
        return spark.createDataFrame(rows, "columns string, cell string, n double")

    return run


def _fitted_sql(columns: list[tuple[str, ...]]) -> str:
    counted = (f"SELECT '{'|'.join(c)}' AS columns, concat_ws('|', {', '.join(c)}) AS cell, count(*)::DOUBLE AS n FROM t GROUP BY ALL" for c in columns)
    return f"WITH t AS ({coded(ORDERS, 'orders')}) " + " UNION ALL ".join(counted)


for _fitting, _of in (("independent", [(c,) for c in ORDERS]), ("direct", [("o_orderstatus", "o_totalprice"), ("o_orderstatus", "o_orderpriority"), ("o_totalprice",)])):
    QUERIES[f"fitted_{_fitting}_exact"], ORACLES[f"fitted_{_fitting}_exact"] = _fitted(_fitting, _of), _fitted_sql(_of)


@query("SELECT DISTINCT \"column\", value FROM (SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)")
def infer_domain_from_marginals(spark, sf):
    orders = table(spark, sf, "orders")
    return synthesis.domain_values([orders.groupBy("o_orderstatus", "o_orderpriority").count(), orders.groupBy("o_orderpriority").count()])


# ---- record files


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def record_file_round_trip(spark, sf):
    """Orders written as framed records, and read back by offsets."""
    path = f"{relational.scratch_root(spark).rstrip('/').removeprefix('file:')}/noisemill/records-{uuid.uuid4().hex}"
    cents = F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    records.write_records(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", cents), path)
    back = records.read_records(spark, path, "o_orderkey long, o_orderstatus string, cents long", 1 << 20)
    return back.select("o_orderkey", "o_orderstatus", (F.col("cents") / 100).alias("o_totalprice"))


# ---- models over cliques

_RING = [("l_returnflag", "l_linestatus"), ("l_linestatus", "l_quantity"), ("l_quantity", "l_discount"), ("l_returnflag", "l_discount")]
_RING_SQL = f"WITH t AS ({coded(LINES, 'lineitem')}), " + ", ".join(f"f{k} AS (SELECT {', '.join(c)}, count(*) / (SELECT count(*) FROM t)::DOUBLE AS v{k} FROM t GROUP BY ALL)" for k, c in enumerate(_RING))
_RING_SQL += ", j AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount, v0 * v1 * v2 * v3 AS v FROM f0 JOIN f1 USING (l_linestatus) JOIN f2 USING (l_quantity) JOIN f3 USING (l_returnflag, l_discount))"


@query(_RING_SQL + " SELECT 'l_linestatus' AS \"column\", l_linestatus AS code, round(sum(v), 12) AS value FROM j GROUP BY ALL UNION ALL SELECT 'l_returnflag', l_returnflag, round(sum(v), 12) FROM j GROUP BY ALL UNION ALL SELECT 'l_quantity', l_quantity, round(sum(v), 12) FROM j GROUP BY ALL UNION ALL SELECT 'l_discount', l_discount, round(sum(v), 12) FROM j GROUP BY ALL")
def clique_tree_marginals(spark, sf):
    """A ring of four factors, which a junction tree of two triples holds: each column's sums of their product."""
    codes = codec.encode_table(table(spark, sf, "lineitem"), LINES)
    n = codes.count()
    factors = [(c, codes.groupBy(*c).agg((F.count("*") / F.lit(float(n))).alias("value"))) for c in _RING]
    tree = cliques.junction_tree(LINES, _RING)
    out = None
    for clique, belief in zip(tree.cliques, cliques.calibrate(factors, tree, LINES), strict=True):
        for c in clique:
            part = belief.groupBy(F.lit(c).alias("column"), F.col(c).alias("code")).agg(F.round(F.sum("value"), 12).alias("value"))
            out = part if out is None else out.unionByName(part)
    return out.where("value > 0").distinct()


_TRIPLE = tuple(ORDERS)
_ORDER_CODES = f"WITH t AS ({coded(ORDERS, 'orders')})"


@query(_ORDER_CODES + " SELECT *, count(*)::DOUBLE AS n FROM t GROUP BY ALL")
def clique_model_exact(spark, sf):
    """A clique of three columns, measured without noise and fitted: the model's joint counts are the table's."""
    codes = codec.encode_table(table(spark, sf, "orders"), ORDERS)
    model = synthesis.synthesize_codes(codes, ORDERS, float("inf"), np.random.default_rng(), "direct", [_TRIPLE])
    counts = model.total * model.marginal(_TRIPLE)
    rows = [(*map(int, at), float(round(counts[at], 3))) for at in np.ndindex(counts.shape) if round(counts[at], 3) > 0]
    return spark.createDataFrame(rows, "o_orderstatus int, o_orderpriority int, o_totalprice int, n double")


_ERROR_SQL = _ORDER_CODES + ", a AS (SELECT o_orderstatus, o_totalprice, count(*)::DOUBLE AS x FROM t GROUP BY ALL), b AS (SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS y FROM t GROUP BY ALL), s AS (SELECT o_orderstatus, count(*)::DOUBLE AS z FROM t GROUP BY ALL), m AS (SELECT o_orderstatus, o_orderpriority, o_totalprice, x * y / z AS e FROM a JOIN b USING (o_orderstatus) JOIN s USING (o_orderstatus)), c AS (SELECT *, count(*)::DOUBLE AS n FROM t GROUP BY ALL)"


@query(_ERROR_SQL + ", p AS (SELECT o_orderpriority, o_totalprice, sum(e) AS e FROM m GROUP BY ALL), q AS (SELECT o_orderpriority, o_totalprice, sum(n) AS n FROM c GROUP BY ALL) SELECT 'o_orderpriority|o_totalprice' AS clique, round(sum(abs(coalesce(n, 0) - coalesce(e, 0))), 4) AS error FROM p FULL JOIN q USING (o_orderpriority, o_totalprice) UNION ALL SELECT 'o_orderstatus|o_orderpriority|o_totalprice', round(sum(abs(coalesce(n, 0) - coalesce(e, 0))), 4) FROM m FULL JOIN c USING (o_orderstatus, o_orderpriority, o_totalprice)")
def model_errors(spark, sf):
    """How far the table lies from a model of two of its pairs, on the third pair and on all three columns."""
    codes = codec.encode_table(table(spark, sf, "orders"), ORDERS)
    known = [("o_orderstatus", "o_totalprice"), ("o_orderstatus", "o_orderpriority")]
    model = synthesis.synthesize_codes(codes, ORDERS, float("inf"), np.random.default_rng(), "direct", known)
    tables = {e: model.pair(*e) for e in known}
    fitted = cliques.fit_cliques(ORDERS, tables, model.total)
    asked = [("o_orderpriority", "o_totalprice"), _TRIPLE]
    return cliques.model_errors(counts.marginals(codes, ORDERS, asked), fitted, asked).withColumn("error", F.round("error", 4))


_WORKLOAD = {("l_returnflag", "l_linestatus", "l_quantity"): 2.0, ("l_quantity", "l_discount"): 1.0, ("l_linestatus", "l_shipdate"): 0.5}
_PART_COLUMNS = sorted({c for w in _WORKLOAD for c in w})
_SIZES_SQL = "WITH s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS n FROM lineitem" for c in _PART_COLUMNS) + ")"
_WORKLOAD_SQL = ", ".join(f"({w}, {list(c)})" for c, w in _WORKLOAD.items())


@query(_SIZES_SQL + f", w(weight, cs) AS (VALUES {_WORKLOAD_SQL}), i AS (SELECT unnest(cs) AS c, cs FROM w), p AS (SELECT DISTINCT list_sort([c]) AS part FROM i UNION SELECT DISTINCT list_sort([a.c, b.c]) FROM i a JOIN i b ON a.cs = b.cs AND a.c < b.c UNION SELECT DISTINCT list_sort(cs) FROM w WHERE len(cs) = 3), z AS (SELECT part, (SELECT CAST(product(n) AS BIGINT) FROM s WHERE list_contains(part, c)) AS cells, (SELECT sum(n) FROM s WHERE NOT list_contains(part, c)) AS others FROM p) SELECT array_to_string(part, '|') AS clique, cells, (SELECT sum(weight * len(list_intersect(cs, part))) FROM w)::DOUBLE AS score, CAST(cells + others AS BIGINT) AS tree_cells, cells + others <= 3000 AS within FROM z")
def workload_scores(spark, sf):
    """Scores and sizes of every part of a workload, over the numbers of values that the table has."""
    lines = table(spark, sf, "lineitem")
    sizes = lines.agg(*(F.count_distinct(c).alias(c) for c in _PART_COLUMNS)).first()  # a number a column
    schema = {c: Categorical(tuple(range(sizes[c]))) for c in _PART_COLUMNS}
    rows = [("|".join(c), n, score, cells, within) for c, n, score, cells, within in cliques.compile_workload(schema, _WORKLOAD, 3, 3000)]
    return spark.createDataFrame(rows, "clique string, cells long, score double, tree_cells long, within boolean")


# ---- annotations

_ANSWER: Schema = {"event": Categorical(("unknown", "click", "error", "view")), "k": Numerical(0, 100), "note": OpenSet("")}
# fenced answers, some with prose round the fence, numbers that are null or text, and events that aren't asked for
_K_SQL = "CASE WHEN event_id % 7 = 0 THEN 'null' WHEN event_id % 11 = 0 THEN '\"much\"' ELSE CAST(event_id % 125 AS VARCHAR) END"
_BODY_SQL = f"'{{\"event\": \"' || event_type || '\", \"k\": ' || {_K_SQL} || '}}'"
_RAW = f"CASE WHEN event_id % 5 = 0 THEN 'Here: ' ELSE '' END || '```json\n' || {_BODY_SQL} || '\n```'"


def _answers(spark, sf) -> DataFrame:
    i = F.col("event_id")
    k = F.when(i % 7 == 0, "null").when(i % 11 == 0, '"much"').otherwise((i % 125).cast("string"))
    body = F.concat(F.lit('{"event": "'), F.col("event_type"), F.lit('", "k": '), k, F.lit("}"))
    text = F.concat(F.when(i % 5 == 0, "Here: ").otherwise(""), F.lit("```json\n"), body, F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", text.alias("answer"))


@query(f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN {_RAW} ELSE {_BODY_SQL} END AS body FROM events")
def strip_fences(spark, sf):
    return _answers(spark, sf).select("event_id", annotate.strip_fences("answer").alias("body"))


_GOOD = "event_id % 5 <> 0 AND event_type IN ('click', 'error', 'view')", "event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 125 <= 100"


@query(f"SELECT event_id, CASE WHEN {_GOOD[0]} THEN event_type ELSE 'unknown' END AS event, CASE WHEN {_GOOD[1]} THEN event_id % 125 ELSE 0 END::DOUBLE AS k, '' AS note, CAST(CASE WHEN {_GOOD[0]} THEN 1 ELSE 0 END + CASE WHEN {_GOOD[1]} THEN 1 ELSE 0 END AS INT) AS fields FROM events")
def llm_json_parse(spark, sf):
    return annotate.parse_answers(_answers(spark, sf), "answer", _ANSWER).select("event_id", "event", "k", "note", F.col("_fields_decoded").alias("fields"))


@query("SELECT doc_id, sha256('Label the example below. Answer with a single JSON object with exactly these keys, and no other text.' || chr(10) || chr(10) || 'The data: short texts' || chr(10) || chr(10) || 'Keys:' || chr(10) || '- event: one of unknown, click, error, view' || chr(10) || '- k: a number from 0 to 100' || chr(10) || '- note: text' || chr(10) || chr(10) || 'Example:' || chr(10) || coalesce(text, '')) AS prompt_sha256 FROM documents")
def annotation_prompt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(annotate.annotation_prompt("text", "short texts", _ANSWER), 256).alias("prompt_sha256"))


# ---- synthesis: random, so without SQL


def _synthetic(method: str):
    def run(spark, sf):
        known = [("o_orderstatus", "o_totalprice"), ("o_orderstatus", "o_orderpriority")]
        model = synthesis.synthesize_codes(codec.encode_table(table(spark, sf, "orders"), ORDERS), ORDERS, 1.0, np.random.default_rng(), method, known)
        return codec.decode_table(synthesis.draw(spark, model), ORDERS, "id").drop("id")

    return run


for _method in synthesis.METHODS:
    QUERIES[f"synthesize_{_method}"] = _synthetic(_method)


@query()
def synthesize_relational(spark, sf):
    made = families.synthesize_relations({n: table(spark, sf, n) for n in CHAIN.tables}, CHAIN, 3.0, 1e-6, ROWS_IN_ORDER)
    return made["lineitem"].join(made["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


@query()
def synthesize_siblings(spark, sf):
    """Orders of a customer drawn together, two of them looked at side by side."""
    small = Relations((replace(ORDER_KEY, capacity=3),), {"customer": CUSTOMERS, "orders": {"o_orderstatus": STATUS, "o_orderpriority": PRIORITY}})
    made = families.synthesize_relations({n: table(spark, sf, n) for n in small.tables}, small, 3.0, 1e-6, ROWS_IN_ORDER, slots=2)
    return made["orders"].join(made["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")


@query()
def synthesize_from_marginals(spark, sf):
    orders = table(spark, sf, "orders")
    model = synthesis.model_from_marginals([orders.groupBy("o_orderstatus", "o_orderpriority").count(), orders.groupBy("o_orderpriority").count()])
    return codec.decode_table(synthesis.draw(spark, model), model.schema, "id").drop("id")


@query()
def synthesize_constrained(spark, sf):
    rule = Constraint(("o_orderstatus", "o_orderpriority"), impossible=(("F", "5-LOW"), ("P", "1-URGENT")))
    return synthesis.synthesize(table(spark, sf, "orders"), ORDERS, 1.0, 1e-6, constraints=(rule,))


@query()
def synthesize_sampled(spark, sf):
    """From the orders of a secret half of the customers, as many orders as all have."""
    return synthesis.synthesize(table(spark, sf, "orders"), ORDERS, 1.0, 1e-6, share=0.5, user="o_custkey")


_WIDE_RULE = Constraint(("l_returnflag", "l_linestatus", "bulk"), impossible=(("R", "O", True), ("A", "O", True), ("N", "F", False)))


@query("SELECT CAST(0 AS BIGINT) AS broken, CAST(1 AS BIGINT) AS some_rows")
def constrained_three_columns(spark, sf):
    """A rule on three columns: no synthetic row breaks it, though rows of the table do."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") > 25).alias("bulk"))
    schema = {"l_returnflag": LINES["l_returnflag"], "l_linestatus": LINES["l_linestatus"], "bulk": Categorical((False, True))}
    made = synthesis.synthesize(lines, schema, 1.0, 1e-6, constraints=(_WIDE_RULE,))
    return made.agg(F.lit(evaluate.violations(made, _WIDE_RULE).count()).cast("long").alias("broken"), (F.count("*") > 100).cast("long").alias("some_rows"))


@query()
def open_set_discovery(spark, sf):
    found = private.discover(table(spark, sf, "part"), {"p_name": OpenSet(), "p_brand": OpenSet()}, 0.5, 1e-6)
    return spark.createDataFrame([(c, k, v) for c, vs in found.items() for k, v in enumerate(vs)], "column string, code int, value string")


@query()
def dp_quantiles(spark, sf):
    a = Numerical(0, 500_000)
    edges = private.private_edges(table(spark, sf, "orders"), "o_totalprice", a, 0.5, np.random.default_rng(), 3)
    return spark.createDataFrame([(k, float(e)) for k, e in enumerate(edges)], "place int, edge double")


@query()
def dp_sips_partitions(spark, sf):
    return private.sips(table(spark, sf, "events"), "user_id", "event_type", 1.0, 1e-6, most=5)
