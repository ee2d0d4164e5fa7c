"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from noisemill import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = [tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order) for r in rows]
    return sorted(names), sorted(clean, key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_random_queries_run(spark, small, name):
    df = catalogue.QUERIES[name](spark, small)
    rows = df.count()
    orders = spark.read.parquet(f"{small}/orders.parquet").count()
    if name == "synthesize_siblings":
        assert 0 < rows and df.groupBy("o_custkey").count().agg({"count": "max"}).first()[0] <= 3
        assert {r.c_mktsegment for r in df.select("c_mktsegment").distinct().collect()} <= set(catalogue.CUSTOMERS["c_mktsegment"].values)
    elif name.startswith("synthesize_") and name != "synthesize_relational":
        assert abs(rows - orders) < 0.2 * orders
        statuses = {r.o_orderstatus for r in df.select("o_orderstatus").distinct().collect()}
        assert statuses <= {"F", "O", "P"} and len(statuses) > 1
    elif name == "synthesize_relational":
        assert 0 < rows and df.groupBy("l_orderkey").count().agg({"count": "max"}).first()[0] <= 3
    elif name == "dp_quantiles":
        edges = [r.edge for r in df.orderBy("place").collect()]
        assert edges == sorted(edges) and 1 <= len(edges) <= 7 and all(0 <= e < 500_000 for e in edges)
    elif name == "open_set_discovery":
        known = {r.p_brand for r in spark.read.parquet(f"{small}/part.parquet").collect()}
        assert {r.value for r in df.where("column = 'p_brand'").collect()} <= known | {"<OOD>"}
    else:
        assert name == "dp_sips_partitions" and {r.event_type for r in df.collect()} <= {"click", "view", "signup", "purchase", "error"}


@pytest.mark.parametrize("rows", [4, 0])
def test_no_unseen_combination_has_null_rows_as_in_sql(spark, tmp_path, rows):
    """Each combination is on both sides of the split, as in a table repeated with shifted keys, or there is none."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k AS o_orderkey, '1-URGENT' AS o_orderpriority, 250.0::DOUBLE AS o_totalprice FROM range({rows}) r(k)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    df = catalogue.QUERIES["unseen_combinations"](spark, str(tmp_path))
    found = con.execute(catalogue.ORACLES["unseen_combinations"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in found.description], found.fetchall())
    assert [tuple(r) for r in df.collect()] == [("o_orderpriority|band", 0, None)]
