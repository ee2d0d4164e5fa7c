"""Tables below a root: lineage, capacity, weights, and rows that show siblings together."""

from __future__ import annotations

import itertools
import re
import tempfile
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noisemill.functions.codec import linear_index
from noisemill.spec import ForeignKey, Relations


def first_rows(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row per key, the first by ``order``; rows without a key go."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.where(F.col(key).isNotNull()).withColumn("_place", place).where("_place = 1").drop("_place")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that several rows have."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, k: ForeignKey) -> DataFrame:
    """Children whose parent isn't there, or who name none."""
    return child.join(parent.select(F.col(k.parent_key).alias(k.child_key)).distinct(), k.child_key, "left_anti")


def group_sizes(parent: DataFrame, child: DataFrame, k: ForeignKey) -> DataFrame:
    """(parent_key, group_size) for every parent, zero included. Children are counted before the join."""
    sizes = child.where(F.col(k.child_key).isNotNull()).groupBy(F.col(k.child_key).alias(k.parent_key)).agg(F.count("*").alias("n"))
    return parent.select(k.parent_key).join(sizes, k.parent_key, "left").select(k.parent_key, F.coalesce("n", F.lit(0)).cast("long").alias("group_size"))


def over_capacity(child: DataFrame, k: ForeignKey) -> DataFrame:
    """(child_key, n) of the parents with more children than the capacity."""
    return child.where(F.col(k.child_key).isNotNull()).groupBy(k.child_key).agg(F.count("*").alias("n")).where(F.col("n") > k.capacity)


def truncate(child: DataFrame, k: ForeignKey, *order: Column | str) -> DataFrame:
    """At most ``capacity`` children of each parent, by ``order``; pass a hash for a random choice.

    A parent's children meet in one task; ``order`` sorts them there, and spills if it must. Children
    without a parent go.
    """
    place = F.row_number().over(Window.partitionBy(k.child_key).orderBy(*order))
    return child.where(F.col(k.child_key).isNotNull()).withColumn("_place", place).where(F.col("_place") <= k.capacity).drop("_place")


def lineage(tables: dict[str, DataFrame], relations: Relations, keys: dict[str, str], order: dict[str, list]) -> dict[str, DataFrame]:
    """Each table's rows with the root's key as ``_root``: null for orphans, for what exceeds a
    parent's capacity, and for everything below such rows."""
    out: dict[str, DataFrame] = {}
    for name, k in relations.order():
        df = tables[name]
        if k is None:
            out[name] = df.withColumn("_root", F.col(keys[name]))
            continue
        up = first_rows(out[k.parent].where("_root is not null").select(F.col(k.parent_key).alias(k.child_key), "_root"), k.child_key, "_root")
        joined = df.join(up, k.child_key, "left")
        # rows without a root, which may be many under one key or none, aren't ranked
        place = F.row_number().over(Window.partitionBy(k.child_key).orderBy(*order[name]))
        below = joined.where("_root is not null").withColumn("_place", place)
        below = below.withColumn("_root", F.when(F.col("_place") <= k.capacity, F.col("_root"))).drop("_place")
        out[name] = below.unionByName(joined.where("_root is null"))
    return out


def weights(tables: dict[str, DataFrame], relations: Relations, keys: dict[str, str], order: dict[str, list]) -> dict[str, DataFrame]:
    """Each table's rows with ``_root`` and ``weight``: a root's rows share 1, lost rows have 0.

    A root's rows are counted with partial sums, and the count joined back: Spark splits that join
    where a root has very many rows.
    """
    out = {}
    for name, df in lineage(tables, relations, keys, order).items():
        n = df.where("_root is not null").groupBy("_root").agg(F.count("*").alias("_n"))
        out[name] = df.join(n, "_root", "left").withColumn("weight", F.coalesce(F.lit(1.0) / F.col("_n"), F.lit(0.0))).drop("_n")
    return out


def patterns(k: int, slots: int, sliced: bool = False) -> tuple[list[tuple[int, ...]], float]:
    """Which of ``k`` siblings stands in each slot (-1: none), in all distinct orders, and the weight
    that makes one parent's rows sum to 1. ``sliced`` repeats siblings instead of leaving gaps."""
    if k == 0:
        return [(0 if sliced else -1,) * slots], 1.0
    if k < slots and sliced:
        return [tuple(i % k for i in range(slots))], 1.0
    items = [*range(k), *[-1] * (slots - k)]
    found = sorted(set(itertools.permutations(items, slots)), reverse=True)
    return found, 1 / len(found)


def exploration_table(parent: DataFrame, child: DataFrame, k: ForeignKey, parent_columns: list[str], child_columns: dict[str, int], slots: int, order: list, sliced: bool = False) -> DataFrame:
    """Parents with ``slots`` of their children side by side, in every order, weights summing to 1.

    Columns: parent_columns, group_size, slot_1.<c> ... slot_n.<c>, weight. ``child_columns`` gives the
    number of codes of each; an empty slot has that number as its code. At most ``capacity``
    children of a parent are kept, so a parent's list is bounded.
    """
    spark = parent.sparkSession
    kept = truncate(child, k, *order)
    place = F.row_number().over(Window.partitionBy(k.child_key).orderBy(*order))
    ranked = kept.withColumn("_at", place).select(F.col(k.child_key).alias(k.parent_key), F.struct("_at", *(F.col(c).alias(c) for c in child_columns)).alias("_child"))
    lists = ranked.groupBy(k.parent_key).agg(F.sort_array(F.collect_list("_child")).alias("_children"))
    empty = F.array().cast(lists.schema["_children"].dataType)
    wide = parent.join(lists, k.parent_key, "left").withColumn("_children", F.coalesce("_children", empty)).withColumn("group_size", F.size("_children"))
    rows = [(n, list(p), w) for n in range(k.capacity + 1) for ps, w in [patterns(n, slots, sliced)] for p in ps]
    table = spark.createDataFrame(rows, "group_size int, _pattern array<int>, weight double")
    # as many rows as the capacity and the slots give: a declared bound
    joined = wide.join(F.broadcast(table), "group_size")
    cells = []
    for s in range(slots):
        who = F.get("_pattern", s)
        for c, n in child_columns.items():
            cells.append(F.when((who >= 0) & (F.col("group_size") > 0), F.get("_children", who)[c]).otherwise(F.lit(n)).alias(f"slot_{s + 1}.{c}"))
    return joined.select(*parent_columns, "group_size", *cells, "weight")


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. On one machine a temporary folder serves where it isn't set; on a
    cluster, whose machines don't share such a folder, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = _local.setdefault("root", tempfile.mkdtemp(prefix="noisemill-"))
    return root


_local: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """The table, written to the checkpoint folder: lineage ends here."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint()


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Rows numbered from 0 in a global order, without a window over one partition.

    The table is sorted by ranges and checkpointed, so that the ranges stay as they are; each one's
    size, one number, gives where its rows' numbers start.
    """
    spark = df.sparkSession
    sorted_ = df.sort(*order).withColumn("_p", F.spark_partition_id())
    tagged = sorted_.withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    tagged = checkpointed(tagged)
    sizes = tagged.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect()
    starts, at = [], 0
    for r in sizes:
        starts.append((r["_p"], at))
        at += r["n"]
    table = spark.createDataFrame(starts, "_p int, _start long")
    return tagged.join(F.broadcast(table), "_p").withColumn(name, F.col("_start") + F.col("_i")).drop("_p", "_i", "_start")


def couple(parents: DataFrame, children: DataFrame, parent_order: list, child_order: list) -> DataFrame:
    """The parent of rank r beside the child of rank r: a coupling by quantiles, one to one."""
    return ranked(parents, *parent_order).join(ranked(children, *child_order), "rank")


def unstack(families: DataFrame, slots: int, child_columns: dict[str, int], key: str = "family") -> DataFrame:
    """(key, slot, child columns): the children of wide rows; empty and surplus slots make none."""
    each = F.array(*(F.struct(F.lit(s + 1).alias("slot"), *(F.col(f"`slot_{s + 1}.{c}`").alias(c) for c in child_columns)) for s in range(slots)))
    rows = families.select(key, "group_size", F.inline(each)).where("slot <= group_size")
    for c, n in child_columns.items():
        rows = rows.where(F.col(c) < n)
    return rows.drop("group_size")


def integrity(parent: DataFrame, child: DataFrame, k: ForeignKey) -> DataFrame:
    """(orphans, most_children, duplicate_keys): a link's health in one row."""
    keys = parent.groupBy(F.col(k.parent_key).alias("key")).agg(F.count("*").alias("p"))
    kids = child.groupBy(F.col(k.child_key).alias("key")).agg(F.count("*").alias("c"))
    both = keys.join(kids, "key", "full")
    return both.agg(
        F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("c"))), F.lit(0)).cast("long").alias("orphans"),
        F.coalesce(F.max(F.when(F.col("p").isNotNull(), F.col("c"))), F.lit(0)).cast("long").alias("most_children"),
        F.count_if(F.col("p") > 1).alias("duplicate_keys"),
    )


_SLOT = re.compile(r"slot_([0-9]+)\.(.+)", re.DOTALL)


def slot_of(name: str) -> tuple[int, str] | None:
    """The slot and the child's column of a wide table's column ``slot_<n>.<column>``; none of any other."""
    found = _SLOT.fullmatch(name)
    return (int(found[1]), found[2]) if found else None


def slots_in(clique: tuple[str, ...]) -> list[int]:
    """The slots that a clique's columns lie in, each once, in order."""
    return sorted({found[0] for c in clique if (found := slot_of(c))})


def remapped(clique: tuple[str, ...], to: dict[int, int]) -> tuple[str, ...]:
    """The clique with its slots renamed; other columns and slots that ``to`` lacks stay."""
    return tuple(f"slot_{to.get(found[0], found[0])}.{found[1]}" if (found := slot_of(c)) else c for c in clique)


def replicated(clique: tuple[str, ...], slots: int) -> list[tuple[str, ...]]:
    """The clique over every choice of as many of ``slots`` slots as it has, in order: children are exchangeable."""
    own = slots_in(clique)
    return [remapped(clique, dict(zip(own, chosen, strict=True))) for chosen in combinations(range(1, slots + 1), len(own))]


def symmetric_marginals(wide: DataFrame, sizes: dict[str, int], workload: list[tuple[str, ...]], slots: int, weight: str | None = None, real: dict[str, int] | None = None) -> DataFrame:
    """(clique, cell, n): joint tables of a wide table that don't depend on how its slots are numbered.

    A row counts for a clique once for every way to lay the clique's slots into the row's ``slots``,
    by one over their number: a union of permuted projections under one aggregation, in one pass, so
    that a clique's total stays. With ``real``, the code of an empty slot by child column, only slots
    that aren't empty are used; a row with too few of them doesn't count for the clique.
    """
    parts = []
    own = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    filled = [F.lit(True)] * slots
    if real:
        name, empty = next(iter(real.items()))
        filled = [F.col(f"`slot_{s}.{name}`") != empty for s in range(1, slots + 1)]
    there = sum((f.cast("int") for f in filled), F.lit(0))
    for k, clique in enumerate(workload):
        used = slots_in(clique)
        ways = F.lit(1)
        for j in range(len(used)):
            ways = ways * (there - j)
        for chosen in permutations(range(1, slots + 1), len(used)):
            names = remapped(clique, dict(zip(used, chosen, strict=True)))
            cell = linear_index([F.col(f"`{c}`") for c in names], [sizes[c] for c in clique])
            inside = F.lit(True)
            for s in chosen:
                inside = inside & filled[s - 1]
            parts.append(F.when(inside, F.struct(F.lit(k).alias("clique"), cell.alias("cell"), F.try_divide(own, ways).alias("n"))))
    rows = wide.select(F.inline(F.filter(F.array(*parts), lambda x: x.isNotNull())))
    return rows.groupBy("clique", "cell").agg(F.sum("n").alias("n"))
