"""Models over cliques of any width: junction trees, belief propagation, fits, errors and draws.

Tables of a declared domain's size are arrays on the driver, or DataFrames where they come from data;
what grows with the data, counting and drawing rows, is Spark's.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisemill.functions.codec import linear_index, uniform
from noisemill.operators.counts import cells_of, downward_closure
from noisemill.operators.relational import checkpointed
from noisemill.spec import Schema

Clique = tuple[str, ...]
#: Cells that the tables of a model may have together.
MOST_CELLS = 5_000_000


@dataclass(frozen=True)
class JunctionTree:
    """Cliques, root first, each with the place of its parent: of a column, all cliques hang together. Parts
    that share no column hang together by empty separators."""

    cliques: tuple[Clique, ...]
    parents: tuple[int | None, ...]

    def separator(self, k: int) -> Clique:
        """The columns that a clique shares with its parent."""
        up = self.parents[k]
        return () if up is None else tuple(c for c in self.cliques[k] if c in self.cliques[up])

    def cells(self, schema: Schema) -> int:
        return sum(cells_of(schema, c) for c in self.cliques)

    def host(self, columns: Clique) -> int | None:
        """The place of the first clique that holds all the columns."""
        return next((k for k, c in enumerate(self.cliques) if set(columns) <= set(c)), None)


def junction_tree(schema: Schema, cliques: list[Clique]) -> JunctionTree:
    """A junction tree in which every given clique lies in one, over all columns of the schema.

    Columns are eliminated one after another, always the one whose neighbours make the smallest table
    with it (ties: as the schema has them); the maximal tables are the tree's cliques, and each hangs
    on the one before it that shares most.
    """
    near: dict[str, set[str]] = {c: set() for c in schema}
    for clique in cliques:
        for a, b in itertools.combinations(clique, 2):
            near[a].add(b)
            near[b].add(a)
    place = {c: k for k, c in enumerate(schema)}
    found: list[frozenset] = []
    while near:
        at = min(near, key=lambda c: (schema[c].size * prod(schema[x].size for x in near[c]), place[c]))
        around = near.pop(at)
        if not any({at, *around} <= f for f in found):
            found.append(frozenset({at, *around}))
        for c in around:
            near[c] = (near[c] | around) - {c, at}
    left = [tuple(sorted(f, key=place.__getitem__)) for f in sorted(found, key=lambda f: min(place[c] for c in f))]
    order, parents = [], []
    while left:
        best = max(((len(set(c) & set(u)), -k, -j) for k, c in enumerate(left) for j, u in enumerate(order)), default=(0, 0, 0))
        k, j = -best[1], -best[2]
        parents.append(j if order else None)
        order.append(left.pop(k))
    return JunctionTree(tuple(order), tuple(parents))


def compile_workload(schema: Schema, workload: dict[Clique, float], most_width: int = 3, most_cells: int = MOST_CELLS) -> list[tuple[Clique, int, float, int, bool]]:
    """(clique, cells, score, tree cells, within) of every part of the workload's cliques up to a width, nothing counted yet.

    A part's score adds, over the workload, a clique's weight times the number of columns that they
    share. Tree cells are those of a junction tree over the part and all single columns; a part
    whose tree is over ``most_cells`` is listed as not within, not left out.
    """
    out = []
    for part in downward_closure(list(workload)):
        if len(part) <= most_width:
            score = sum(weight * len(set(part) & set(c)) for c, weight in workload.items())
            cells = junction_tree(schema, [part]).cells(schema)
            out.append((part, cells_of(schema, part), float(score), cells, cells <= most_cells))
    return out


def affordable(schema: Schema, chosen: list[Clique], candidates: list[Clique], most_cells: int) -> list[Clique]:
    """The candidates with which the junction tree of all chosen ones stays within a number of cells."""
    return [c for c in candidates if junction_tree(schema, [*chosen, c]).cells(schema) <= most_cells]


# ---- belief propagation over tables


def _dense(spark: SparkSession, schema: Schema, clique: Clique) -> DataFrame:
    """Every cell of a clique, with the constant ``_all`` on which tables without common columns meet."""
    out, stride = spark.range(cells_of(schema, clique)), 1
    cells = {}
    for c in reversed(clique):
        cells[c] = F.expr(f"cast(id div {stride} % {schema[c].size} as int)").alias(c)
        stride *= schema[c].size
    return out.select(F.lit(0).alias("_all"), *(cells[c] for c in clique))


def calibrate(factors: list[tuple[Clique, DataFrame]], tree: JunctionTree, schema: Schema) -> list[DataFrame]:
    """The tree's cliques with the sums of the product of all factors, as (columns, ``value``).

    A factor is (its columns, a table of them with ``value``); cells without a row are 0. Messages are
    grouped sums over joined tables, first to the root, then back; each table is checkpointed, so
    that no plan holds another's. All tables have at most the size of the declared domain.
    """
    spark = factors[0][1].sparkSession
    held: list[DataFrame] = []
    for k, clique in enumerate(tree.cliques):
        table = _dense(spark, schema, clique).withColumn("value", F.lit(1.0))
        for columns, factor in factors:
            if tree.host(columns) == k:
                rows = factor.select(*columns, F.col("value").cast("double").alias("_factor"))
                table = table.join(rows, list(columns), "left").withColumn("value", F.col("value") * F.coalesce("_factor", F.lit(0.0))).drop("_factor")
        held.append(table)
    up: dict[int, DataFrame] = {}

    def message(table: DataFrame, k: int) -> DataFrame:
        return table.groupBy("_all", *tree.separator(k)).agg(F.sum("value").alias("_message"))

    def times(table: DataFrame, rows: DataFrame, k: int, value) -> DataFrame:
        return table.join(rows, ["_all", *tree.separator(k)]).withColumn("value", value).select("_all", *(c for c in table.columns if c not in ("_all", "value")), "value")

    for k in reversed(range(len(held))):
        held[k] = checkpointed(held[k])
        if (parent := tree.parents[k]) is not None:
            up[k] = checkpointed(message(held[k], k))
            held[parent] = times(held[parent], up[k], k, F.col("value") * F.col("_message"))
    for k, parent in enumerate(tree.parents):
        if parent is not None:
            both = message(held[parent], k).join(up[k].withColumnRenamed("_message", "_up"), ["_all", *tree.separator(k)])
            back = both.withColumn("_message", F.when(F.col("_up") > 0, F.col("_message") / F.col("_up")).otherwise(0.0)).drop("_up")
            held[k] = checkpointed(times(held[k], back, k, F.col("value") * F.col("_message")))
    return [t.select(*c, "value") for t, c in zip(held, tree.cliques, strict=True)]


# ---- models


def _onto(table: np.ndarray, columns: Clique, target: Clique) -> np.ndarray:
    """A table of some of the target's columns, shaped to be multiplied with a table of all."""
    kept = [c for c in target if c in columns]
    turned = table.transpose([columns.index(c) for c in kept])
    return turned.reshape([turned.shape[kept.index(c)] if c in kept else 1 for c in target])


def _summed(table: np.ndarray, columns: Clique, kept: Clique) -> np.ndarray:
    """Sums over the columns that aren't kept, the axes as ``kept`` has them."""
    out = table.sum(tuple(k for k, c in enumerate(columns) if c not in kept))
    left = [c for c in columns if c in kept]
    return out.transpose([left.index(c) for c in kept])


@dataclass
class CliqueModel:
    """Shares of every clique of a junction tree, which agree on what they share."""

    schema: Schema
    total: float
    tree: JunctionTree
    beliefs: list[np.ndarray]
    log: list[dict] = field(default_factory=list)

    @property
    def order(self) -> list[str]:
        return list(self.schema)

    def conditional(self, k: int) -> np.ndarray:
        """A clique's shares given its separator's codes."""
        clique, sep = self.tree.cliques[k], self.tree.separator(k)
        below = _onto(_summed(self.beliefs[k], clique, sep), sep, clique)
        return np.divide(self.beliefs[k], below, out=np.zeros_like(self.beliefs[k]), where=below > 0)

    def marginal(self, columns: Clique) -> np.ndarray:
        """The joint shares of any columns: from one clique, or by summing out along the tree."""
        columns = tuple(columns)
        if (k := self.tree.host(columns)) is not None:
            return _summed(self.beliefs[k], self.tree.cliques[k], columns)
        # a leaf that holds none of the columns but in its separator sums to 1
        kept = list(range(len(self.tree.cliques)))
        for k in reversed(kept[:]):
            own = set(self.tree.cliques[k]) - set(self.tree.separator(k))
            if not own & set(columns) and not any(self.tree.parents[j] == k for j in kept):
                kept.remove(k)
        number = {c: n for n, c in enumerate(self.schema)}
        parts: list = []
        for k in kept:
            parts += [self.conditional(k), [number[c] for c in self.tree.cliques[k]]]
        return np.einsum(*parts, [number[c] for c in columns], optimize="greedy")

    def single(self, column: str) -> np.ndarray:
        return self.marginal((column,))

    def pair(self, a: str, b: str) -> np.ndarray:
        return self.marginal((a, b))


def _agree(tree: JunctionTree, potentials: list[np.ndarray]) -> list[np.ndarray]:
    """Belief propagation on arrays: to the root, back, and to a sum of 1."""
    out, up = [p.copy() for p in potentials], {}
    for k in reversed(range(len(out))):
        if (parent := tree.parents[k]) is not None:
            sep = tree.separator(k)
            up[k] = _summed(out[k], tree.cliques[k], sep)
            scale = up[k].max() or 1.0  # keeps long products in range
            out[k], up[k] = out[k] / scale, up[k] / scale
            out[parent] = out[parent] * _onto(up[k], sep, tree.cliques[parent])
    for k, parent in enumerate(tree.parents):
        if parent is not None:
            sep = tree.separator(k)
            down = _summed(out[parent], tree.cliques[parent], sep)
            down = np.divide(down, up[k], out=np.zeros_like(down), where=up[k] > 0)
            out[k] = out[k] * _onto(down, sep, tree.cliques[k])
    sums = [x.sum() for x in out]
    if not all(np.isfinite(s) and s > 0 for s in sums):
        raise ValueError("a constraint leaves no value that may occur")
    return [x / s for x, s in zip(out, sums, strict=True)]


def fit_cliques(schema: Schema, measured: dict[Clique, np.ndarray], total: float, masks: dict[Clique, np.ndarray] | None = None, rounds: int = 100, most_cells: int = MOST_CELLS) -> CliqueModel:
    """The model of greatest entropy through measured joint tables of any width.

    Each table in turn scales the clique that holds it, until no share moves by more than 1e-7 or the
    rounds are over; where noisy tables contradict each other, the steps get shorter, so that the
    model settles between them. Negative counts count as none. ``masks`` say which cells may occur,
    over any number of columns; no draw breaks one.
    """
    masks = masks or {}
    tree = junction_tree(schema, [*measured, *masks])
    if (cells := tree.cells(schema)) > most_cells:
        raise ValueError(f"the junction tree of these cliques has {cells} cells, more than {most_cells}")
    shape = lambda c: [schema[x].size for x in c]
    potentials = [np.ones(shape(c)) for c in tree.cliques]
    for columns, mask in masks.items():
        k = tree.host(columns)
        potentials[k] = potentials[k] * _onto(np.asarray(mask, float).reshape(shape(columns)), columns, tree.cliques[k])
    beliefs = _agree(tree, potentials)
    goals = {}
    for columns, counts in measured.items():
        x = np.maximum(np.asarray(counts, float).reshape(shape(columns)), 0)
        if x.sum() > 0:
            goals[columns] = x / x.sum() + 1e-13
    for r in range(rounds if goals else 0):
        step, moved = 1.0 if r < 20 else (20 / (r + 1)) ** 0.5, 0.0
        for columns, goal in goals.items():
            k = tree.host(columns)
            now = _summed(beliefs[k], tree.cliques[k], columns)
            ratio = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0) ** step
            moved = max(moved, float(np.abs(np.where(now > 0, goal - now, 0)).max()))
            potentials[k] = potentials[k] * _onto(ratio, columns, tree.cliques[k])
            potentials[k] /= potentials[k].max()
            beliefs = _agree(tree, potentials)
        if moved < 1e-7:
            break
    return CliqueModel(schema, max(1.0, total), tree, beliefs)


def model_errors(counts: DataFrame, model, workload: list[Clique], only: list[int] | None = None) -> DataFrame:
    """(clique, error): how far each joint table lies from what the model has there, in L1, in one pass.

    ``counts`` is a ``marginals`` table of the workload; the model's side is a table of the declared
    domain's size, of which only cells above a billionth of a row are sent. Counts and model meet as
    a union that is summed by cell, so that cells of one side alone count too. ``only``: the places of the
    cliques that are asked for.
    """
    spark, rows = counts.sparkSession, []
    asked = list(range(len(workload))) if only is None else only
    if only is not None:
        counts = counts.where(F.col("clique").isin(only))
    for k in asked:
        clique = workload[k]
        expected = model.total * (model.marginal(clique) if hasattr(model, "marginal") else model.pair(*clique) if len(clique) == 2 else model.single(*clique)).ravel()
        at = np.flatnonzero(expected > 1e-9)
        rows.append((np.full(len(at), k), at, -expected[at]))
    table = pd.DataFrame({"clique": np.concatenate([r[0] for r in rows]), "cell": np.concatenate([r[1] for r in rows]), "n": np.concatenate([r[2] for r in rows])})
    other = spark.createDataFrame(table, "clique int, cell long, n double")
    both = counts.select("clique", "cell", F.col("n").cast("double").alias("n")).unionByName(other)
    errors = both.groupBy("clique", "cell").agg(F.sum("n").alias("n")).groupBy("clique").agg(F.sum(F.abs("n")).alias("error"))
    names = spark.createDataFrame([(k, "|".join(workload[k])) for k in asked], "clique int, name string")
    return names.join(errors, "clique", "left").select(F.col("name").alias("clique"), F.coalesce("error", F.lit(0.0)).alias("error"))


#: Cells of a table that is a constant of the plan; a larger one is joined.
CONSTANT_CELLS = 100_000


def constant(values: list, kind: str) -> Column:
    """An array that the planner folds to one constant."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def drawn(out: DataFrame, shares: np.ndarray, up: Column, name: str, key: str, seed: int, aliases) -> DataFrame:
    """``out`` with ``_cell``, drawn from the row ``up`` of a matrix of shares.

    A hash of row number and name takes a place in the row, and a second one chooses between the place
    and its alias. A matrix of up to ``CONSTANT_CELLS`` cells is a constant of the plan, so that nothing is
    joined; a larger one is a table of arrays, one row for each row with any share.
    """
    n = shares.shape[1]
    place = F.floor(uniform(key, F.lit(name), seed=seed) * n).cast("int")
    pairs = [aliases(row) if row.sum() > 0 else [(1.0, j) for j in range(n)] for row in shares]
    if shares.size <= CONSTANT_CELLS:
        keep, other = constant([float(p[0]) for x in pairs for p in x], "double"), constant([int(p[1]) for x in pairs for p in x], "int")
        out, at = out.withColumn("_place", place), up.cast("int") * n + F.col("_place")
    else:
        # at most MOST_CELLS numbers, by declaration
        rows = [(k, [float(p[0]) for p in x], [int(p[1]) for p in x]) for k, x in enumerate(pairs)]
        table = F.broadcast(out.sparkSession.createDataFrame(rows, "_up long, _keep array<double>, _alias array<int>"))
        out = out.withColumn("_up", up.cast("long")).withColumn("_place", place).join(table, "_up")
        keep, other, at = F.col("_keep"), F.col("_alias"), F.col("_place")
    stays = uniform(F.lit(name), key, seed=seed) < F.get(keep, at)
    return out.withColumn("_cell", F.when(stays, F.col("_place")).otherwise(F.get(other, at))).drop("_up", "_place", "_keep", "_alias")


def draw_cliques(spark: SparkSession, model: CliqueModel, rows: int | None, seed: int, key: str, aliases) -> DataFrame:
    """Rows of codes, clique by clique: a separator's cell gives the row of shares of the new columns' cells."""
    out = spark.range(int(round(model.total)) if rows is None else rows).withColumnRenamed("id", key)
    for k, clique in enumerate(model.tree.cliques):
        sep = model.tree.separator(k)
        new = tuple(c for c in clique if c not in sep)
        if not new:
            continue
        sizes = [model.schema[c].size for c in new]
        shares = model.beliefs[k].transpose([clique.index(c) for c in (*sep, *new)]).reshape(-1, prod(sizes))
        if shares.size > MOST_CELLS:
            raise ValueError(f"{clique}: a table of {shares.size} cells")
        at = linear_index([F.col(f"`{c}`") for c in sep], [model.schema[c].size for c in sep]) if sep else F.lit(0)
        out, stride = drawn(out, shares, at, "|".join(clique), key, seed, aliases), prod(sizes)
        for c, n in zip(new, sizes, strict=True):
            stride //= n
            out = out.withColumn(c, F.expr(f"cast(_cell div {stride} % {n} as int)"))
        out = out.drop("_cell")
    return out.select(key, *(F.col(f"`{c}`") for c in model.schema))
