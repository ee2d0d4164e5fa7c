"""Counts over codes: one pass for all columns, one for all joint tables."""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noisemill.functions.codec import linear_index
from noisemill.spec import Categorical, Numerical, OpenSet, Schema

_SIZED = (Categorical, Numerical)


def column_counts(codes: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """(column, code, n): each column's histogram, and the total as column ``__total``, in one pass.

    Rows are unpivoted before the aggregation, which adds up per task first: the shuffle carries a
    row per task, column and code.
    """
    pairs = F.array(F.struct(F.lit("__total").alias("column"), F.lit(0).cast("long").alias("code")), *(F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("code")) for c in columns))
    long = codes.select(F.inline(pairs), *([weight] if weight else [])).where("code is not null")
    return long.groupBy("column", "code").agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def open_counts(df: DataFrame, columns: dict[str, OpenSet], min_count: int = 1) -> DataFrame:
    """(column, value, n) of open columns, values as text, nulls left out, rare values too."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def dense_counts(codes: DataFrame, schema: Schema) -> DataFrame:
    """(column, code, n) with every code of the schema's columns, those that don't occur as zero."""
    spark = codes.sparkSession
    cells = None
    for name, a in schema.items():
        part = spark.range(a.size).select(F.lit(name).alias("column"), F.col("id").alias("code"))
        cells = part if cells is None else cells.unionByName(part)
    found = column_counts(codes, list(schema))
    return cells.join(found, ["column", "code"], "left").select("column", "code", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def marginal(codes: DataFrame, columns: tuple[str, ...], weight: str | None = None) -> DataFrame:
    """The columns' values together, and how often (or with what weight) they occur, as ``n``."""
    return codes.groupBy(*columns).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def marginals(codes: DataFrame, schema: Schema, workload: list[tuple[str, ...]], weight: str | None = None) -> DataFrame:
    """(clique, cell, n): the joint tables of all cliques in one pass, cells as linear indexes.

    A row makes a (clique, cell) pair for each clique; the aggregation adds up per task before the
    one shuffle, so what travels is bounded by tasks and cells, not rows.
    """
    pairs = F.array(*(F.struct(F.lit(k).alias("clique"), linear_index(list(c), [schema[x].size for x in c]).alias("cell")) for k, c in enumerate(workload)))
    long = codes.select(F.inline(pairs), *([weight] if weight else []))
    return long.groupBy("clique", "cell").agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def grouping_sets(df: DataFrame, workload: list[tuple[str, ...]]) -> DataFrame:
    """All columns of the workload, null where a clique lacks them, ``clique`` and ``n``."""
    columns = sorted({c for clique in workload for c in clique})
    sets = F.array(*(F.struct(F.lit("|".join(clique)).alias("clique"), *((F.col(c) if c in clique else F.lit(None)).cast("string").alias(c) for c in columns)) for clique in workload))
    return df.select(F.inline(sets)).groupBy("clique", *columns).agg(F.count("*").alias("n"))


def compressed(counts: DataFrame, common: DataFrame) -> DataFrame:
    """(column, bin, n, scaled) of a dense count table: a common code is a bin of its own, all others
    of its column share bin -1.

    ``common`` lists (column, code). ``scaled`` is the count over the root of the bin's number of
    codes: noise of one size on every code has that size on ``scaled`` too. Both tables have the
    domain's size; a common code without a count has no row.
    """
    kept = common.select("column", "code").distinct().withColumn("_kept", F.lit(True))
    bins = counts.join(kept, ["column", "code"], "left").withColumn("bin", F.when(F.col("_kept"), F.col("code")).otherwise(F.lit(-1).cast("long")))
    return bins.groupBy("column", "bin").agg(F.sum("n").alias("n"), (F.sum("n") / F.sqrt(F.count("*"))).alias("scaled"))


def ends(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, low, high): least and greatest number of each column, in one pass; nulls and NaN left
    out, null ends where nothing is left. Not private: for columns whose range is public."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("value")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def cells_of(schema: Schema, clique: tuple[str, ...]) -> int:
    return prod(schema[c].size for c in clique)


def downward_closure(workload: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """All non-empty parts of the cliques, small ones first."""
    out = {()}
    for clique in workload:
        parts = {()}
        for c in clique:
            parts |= {(*p, c) for p in parts}
        out |= {tuple(sorted(p)) for p in parts}
    return sorted(out - {()}, key=lambda c: (len(c), c))


def maximal(workload: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The cliques that no other contains."""
    sets = {frozenset(c) for c in workload}
    return sorted(tuple(sorted(c)) for c in sets if not any(c < d for d in sets))


def independence_errors(counts: DataFrame, singles: DataFrame, schema: Schema, workload: list[tuple[str, ...]]) -> DataFrame:
    """(clique, error): how far each joint table lies from the product of its columns, in L1.

    ``counts`` is a ``marginals`` table, ``singles`` a ``column_counts`` table; both have domain
    size. The cells that don't occur need no rows: what the product puts on them is what it leaves
    over on the others, as it sums to the total.
    """
    spark = counts.sparkSession
    total = float(singles.where("column = '__total'").agg(F.sum("n")).first()[0] or 0)  # one number
    places = []
    for k, clique in enumerate(workload):
        stride = 1
        for c in reversed(clique):
            places.append((k, c, stride, schema[c].size))
            stride *= schema[c].size
    # two tables of the schema's size: where a clique's columns are in a cell's number, and the columns' shares
    where = F.broadcast(spark.createDataFrame(places, "clique int, column string, stride long, size long"))
    share = F.broadcast(singles.where("column <> '__total'").select("column", "code", (F.col("n") / F.lit(total or 1.0)).alias("p")))
    codes = counts.join(where, "clique").withColumn("code", F.expr("cell div stride % size")).join(share, ["column", "code"])
    cells = codes.groupBy("clique", "cell").agg(F.first("n").alias("n"), F.product("p").alias("p"))
    each = cells.groupBy("clique").agg(F.sum(F.abs(F.col("n") - total * F.col("p"))).alias("seen"), F.sum("p").alias("p"))
    names = spark.createDataFrame([(k, "|".join(c)) for k, c in enumerate(workload)], "clique int, name string")
    error = F.coalesce(F.col("seen") + F.greatest(total * (1 - F.col("p")), F.lit(0.0)), F.lit(total))
    return names.join(each, "clique", "left").select(F.col("name").alias("clique"), error.alias("error"))


def largest_errors(errors: DataFrame, most: int) -> DataFrame:
    """The ``most`` cliques of an ``independence_errors`` table that are wrong most, ties by name, with ``place`` from 1."""
    if most < 1:
        raise ValueError("most must be at least 1")
    # as many rows as the feature asks for, so that ranking them in one task is bounded
    top = errors.orderBy(F.desc("error"), "clique").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("error"), "clique")))
