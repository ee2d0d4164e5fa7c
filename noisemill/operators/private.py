"""Private releases. Spark counts; noise is drawn once, over tables as large as the declared domain."""

from __future__ import annotations

import math
import secrets

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noisemill.functions import budget
from noisemill.functions.codec import gaussian, grid_index, uniform
from noisemill.operators.counts import dense_counts, marginals, open_counts
from noisemill.operators.relational import checkpointed
from noisemill.spec import Numerical, OpenSet, Schema


def noisy_columns(codes: DataFrame, schema: Schema, rho: float, rng: np.random.Generator, per_user: int = 1) -> dict[str, np.ndarray]:
    """Each column's histogram with Gaussian noise on every code, zero counts too; rho for each column."""
    sigma = per_user * budget.sigma_of_rho(rho)
    table = dense_counts(codes, schema).toPandas().sort_values(["column", "code"])  # a row for each declared code
    return {c: table.loc[table["column"] == c, "n"].to_numpy(float) + rng.normal(0, sigma, schema[c].size) for c in schema}


def noisy_marginal(counts: pd.DataFrame, cells: int, rho: float, rng: np.random.Generator, per_user: int = 1) -> np.ndarray:
    """A joint table of ``cells`` cells from its (cell, n) rows, with Gaussian noise on each cell."""
    out = np.zeros(cells)
    out[counts["cell"].to_numpy(int)] = counts["n"].to_numpy(float)
    return out + rng.normal(0, per_user * budget.sigma_of_rho(rho), cells)


def release_sigmas(weights: dict[tuple[str, ...], float], rho: float, sensitivity: float = 1.0) -> dict[tuple[str, ...], float]:
    """The noise of each clique when all are released as one vector, each scaled by its weight over the
    weights' norm: a row moves that vector by ``sensitivity``, whatever the number of cliques, and a
    clique's share of rho is its squared weight's."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError(f"weights must be positive: {weights}")
    norm, sigma = math.sqrt(sum(w * w for w in weights.values())), sensitivity * budget.sigma_of_rho(rho)
    return {c: sigma * norm / w for c, w in weights.items()}


def release(codes: DataFrame, schema: Schema, weights: dict[tuple[str, ...], float], rho: float, secret: str | None = None, sensitivity: float = 1.0, weight: str | None = None) -> DataFrame:
    """(clique, cell, n, sigma): the joint tables of all cliques, every cell with Gaussian noise, as one rho-zCDP release.

    Counts are one pass. Cells that don't occur get noise too: each clique's range of cells is listed by
    Spark and joined with the counts, and noise is a keyed hash of clique and cell, so that no table
    passes through the driver. ``secret``, or one of the operating system's, keys it: use it once.
    """
    workload, spark = list(weights), codes.sparkSession
    sigmas = release_sigmas(weights, rho, sensitivity)
    sizes = [math.prod(schema[c].size for c in clique) for clique in workload]
    ends = np.cumsum([0, *sizes]).tolist()
    at = F.col("id")
    place = sum(((at >= e).cast("int") for e in ends[1:-1]), F.lit(0))
    starts, widths = F.array(*map(F.lit, ends[:-1])), F.array(*(F.lit(float(sigmas[c])) for c in workload))
    cells = spark.range(ends[-1]).select(place.alias("clique"), (at - F.get(starts, place)).alias("cell"), F.get(widths, place).alias("sigma"))
    counts = marginals(codes, schema, workload, weight)
    exact = F.coalesce(F.col("n").cast("double"), F.lit(0.0))
    noisy = exact + F.col("sigma") * gaussian(secret or secrets.token_hex(32), "clique", "cell")
    return cells.join(counts, ["clique", "cell"], "left").select("clique", "cell", noisy.alias("n"), "sigma")


def common_codes(noisy: np.ndarray, stddev: float) -> list[bool]:
    """Which codes stay apart: those whose noisy count is three standard deviations or more. Where
    merging the others into one saves no code, all stay."""
    common = (noisy >= 3 * stddev).tolist()
    return common if sum(common) + 1 < len(common) else [True] * len(common)


def bound_contributions(df: DataFrame, user: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each user, chosen by a hash of the row."""
    columns = [c for c in df.columns if c != user]
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.xxhash64(*columns, F.lit(seed)), *columns))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def sampled_users(df: DataFrame, user: str, share: float, secret: str | None = None) -> DataFrame:
    """The rows of a Poisson sample of users, each in it with probability ``share`` on their own; all rows of a user
    stay or go together, and users without a name are one.

    A keyed hash in the scan decides, so that nothing is shuffled and a table that is read again, or a task that
    runs again, gives the same sample. ``secret``, or one of the operating system's, keys it: the accounting
    (``functions.sampling``) holds while it stays unknown.
    """
    if not 0 < share <= 1:
        raise ValueError(f"a share must lie in (0, 1]: {share}")
    if share == 1:
        return df
    name = F.coalesce(F.col(f"`{user}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(secret or secrets.token_hex(32)), name), 256)
    return df.where(F.substring(digest, 1, 12) < F.lit(f"{int(share * (1 << 48)):012x}"))


def found_values(
    df: DataFrame,
    columns: dict[str, OpenSet],
    rho: float,
    delta: float,
    secret: str | None = None,
    min_count: int = 1,
    most: int = 1_000_000,
    per_user: int = 1,
) -> dict[str, dict[str, float]]:
    """Values of open columns that are safe to show, with the noisy counts by which they were found.

    A row adds to one histogram of each column, so rho and delta are shared out among them. Noise and
    threshold are applied in Spark; only what may be shown is collected, at most ``most`` values: more
    are no categories, and an error. ``secret`` keys the noise; without, the operating system gives one.
    """
    sigma = budget.sigma_of_rho(rho / len(columns))
    threshold = budget.selection_threshold(sigma, delta / len(columns), per_user, min_count)
    noisy = F.col("n") + per_user * sigma * gaussian(secret or secrets.token_hex(32), "column", "value")
    rows = open_counts(df, columns, min_count).withColumn("noisy", noisy).where(F.col("noisy") >= threshold).select("column", "value", "noisy").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} values")
    return {c: {r.value: r.noisy for r in rows if r.column == c} for c in columns}


def listed(found: dict[str, float], a: OpenSet) -> list[str]:
    """An open column's values: the default first, then found and public ones in order."""
    return [a.default, *sorted((set(found) | set(a.public)) - {a.default})]


def discover(df: DataFrame, columns: dict[str, OpenSet], rho: float, delta: float, secret: str | None = None, min_count: int = 1, most: int = 1_000_000, per_user: int = 1) -> dict[str, list[str]]:
    """The values of ``found_values``, and public ones, as categories: the default comes first, then values in order."""
    found = found_values(df, columns, rho, delta, secret, min_count, most, per_user)
    return {c: listed(found[c], a) for c, a in columns.items()}


def sips_weights(df: DataFrame, user: str, partition: str, most: int) -> DataFrame:
    """(partition, weight): each user's distinct partitions, ``most`` of them, share weight 1 / sqrt(k)."""
    once = bound_contributions(df.select(user, partition).where(F.col(partition).isNotNull()).distinct(), user, most)
    k = F.count("*").over(Window.partitionBy(user))
    return once.withColumn("_w", 1.0 / F.sqrt(k)).groupBy(partition).agg(F.sum("_w").alias("weight"))


def sips(
    df: DataFrame, user: str, partition: str, rho: float, delta: float, secret: str | None = None, most: int = 10, rounds: int = 3
) -> DataFrame:
    """Partitions chosen over several rounds; those found leave room for others in the next round.

    Noise, keyed by ``secret`` or one of the operating system's, and threshold are applied in Spark, and
    what is found stays a table: no partition passes through the driver.
    """
    secret, found, left = secret or secrets.token_hex(32), None, df
    for k, share in enumerate(budget.sips_rounds(rho, rounds)):
        sigma = budget.sigma_of_rho(share)
        cut = budget.sips_threshold(sigma, delta / rounds, most)
        noisy = F.col("weight") + sigma * gaussian(f"{secret}{k}", partition)
        more = checkpointed(sips_weights(left, user, partition, most).where(noisy >= cut).select(partition))
        found = more if found is None else found.unionByName(more)
        left = df.join(found, partition, "left_anti")
    return found


def grid_histogram(df: DataFrame, column: str, low: float, high: float, step: float, clip: bool = True) -> DataFrame:
    """(point, n) of the grid over [low, high]; null and NaN go to the first point with clip, else away."""
    point = grid_index(column, low, high, step)
    rows = df.select(F.coalesce(point, F.lit(0)).alias("point")) if clip else df.where(F.col(column).between(low, high) & ~F.isnan(F.col(column).cast("double"))).select(point.alias("point"))
    return rows.groupBy("point").agg(F.count("*").alias("n"))


def quantile_cells(cells: np.ndarray, counts: np.ndarray, size: int, epsilons: list[float], rng: np.random.Generator | None = None) -> list[int]:
    """The cells below 2 ** levels - 1 cuts of a histogram over ``size`` cells, given by its filled ``cells``.

    Each level cuts every part between two cells, near its middle: a cut costs the rows by which the
    part below it misses half, and is drawn by the exponential mechanism. A row is in one part of a
    level only, so the parts of a level share its epsilon.
    """
    below = np.append(0, np.cumsum(counts))  # rows before each filled cell
    parts, cuts = [(0, size)], []
    for epsilon in epsilons:
        found = []
        for low, high in parts:
            inside = slice(*np.searchsorted(cells, (low, high)))
            # between filled cells all cuts are alike: as many as there are empty cells, and one
            ends = np.concatenate([[low], cells[inside] + 1, [high + 1]])
            ways = np.diff(ends)
            miss = np.abs(below[inside.start : inside.stop + 1] - (below[inside.start] + below[inside.stop]) / 2)
            if math.isinf(epsilon):
                pick = int(np.argmin(np.where(ways > 0, miss, np.inf)))
                found.append(int(ends[pick]))
            else:
                score = np.where(ways > 0, np.log(np.maximum(ways, 1)) - epsilon * miss, -np.inf)
                p = np.exp(score - score.max())
                pick = int(rng.choice(len(p), p=p / p.sum()))
                found.append(int(ends[pick] + rng.integers(ways[pick])))
        cuts = sorted([*cuts, *found])
        edges = [0, *cuts, size]
        parts = list(zip(edges[:-1], edges[1:], strict=True))
    return [max(c - 1, 0) for c in cuts]


def private_cuts(df: DataFrame, column: str, a: Numerical, rho: float, rng: np.random.Generator, levels: int = 5, points: int = 100_001) -> list[float]:
    """Places near the quantiles that cut the column's rows into 2 ** levels equal parts, as often as they
    cut: a histogram over a grid of ``points``, then private cuts.

    A point's rows are dealt to finer cells before anything is counted, by a keyed hash of their place in
    the table, so that points which many rows have can be cut within. At most 2 ** 20 cells are collected.
    """
    step = max(1.0, math.ceil((a.high - a.low) / (points - 1))) if a.integer else (a.high - a.low) / (points - 1)
    size = int(math.floor((a.high - a.low) / step)) + 2
    fine = max(1, (1 << 20) // size)
    rows = df if a.clip else df.where(F.col(column).between(a.low, a.high) & ~F.isnan(F.col(column).cast("double")))
    point = F.least(F.coalesce(grid_index(column, a.low, a.high, step), F.lit(0)), F.lit(size - 1))
    dealt = uniform(F.monotonically_increasing_id(), F.lit(rng.bytes(16).hex()))
    cell = (point * fine + F.floor(dealt * fine)).cast("long")
    dense = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).orderBy("cell").toPandas()
    epsilons = [math.inf] * levels if math.isinf(rho) else budget.quantile_levels(rho, levels)
    cells = quantile_cells(dense["cell"].to_numpy(np.int64), dense["n"].to_numpy(np.int64), size * fine, epsilons, rng)
    return sorted(a.low + step * (c // fine) for c in cells)


def edge_weights(cuts: list[float], a: Numerical) -> tuple[tuple[float, ...], list[int]]:
    """Edges from equal cuts, each once, and how many of the equal parts each bin between them has.

    A bin takes the parts that end at its upper edge; what is cut at the column's maximum or above goes
    into the last bin, which reaches there anyway. Without clip, bin 0, for invalid values, has none.
    """
    edges, times = np.unique(np.asarray(cuts, float), return_counts=True)
    inside = edges < a.high
    weights = [*times[inside].tolist(), int(times[~inside].sum()) + 1]
    return tuple(edges[inside].tolist()), weights if a.clip else [0, *weights]


def private_edges(df: DataFrame, column: str, a: Numerical, rho: float, rng: np.random.Generator, levels: int = 5, points: int = 100_001) -> tuple[float, ...]:
    """Bin edges near the quantiles, from ``private_cuts``."""
    return edge_weights(private_cuts(df, column, a, rho, rng, levels, points), a)[0]


def rebinned(histogram: DataFrame, edges: tuple[float, ...], low: float, step: float) -> DataFrame:
    """(bin, n): a ``grid_histogram`` summed up between edges, bins closed on the right and empty ones as zero."""
    value = low + F.col("point") * step
    place = sum(((value > e).cast("int") for e in edges), F.lit(0))
    every = histogram.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("long").alias("n"))
    return histogram.select(place.alias("bin"), "n").unionByName(every).groupBy("bin").agg(F.sum("n").alias("n"))
