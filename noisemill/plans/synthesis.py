"""Synthetic tables from a dependency tree over noisy joint tables.

Spark measures (all pairs in one pass) and draws rows (a projection and small joins); between them
stand tables as large as the declared domain.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisemill.functions import budget, sampling
from noisemill.functions.codec import decode_table, encode_table, uniform
from noisemill.operators.compression import Compression, find_compression
from noisemill.operators.counts import cells_of, column_counts, independence_errors, marginals
from noisemill.operators.private import edge_weights, found_values, listed, noisy_columns, noisy_marginal, private_cuts, sampled_users
from noisemill.operators.relational import checkpointed
from noisemill.plans.cliques import CliqueModel, affordable, compile_workload, draw_cliques, drawn, fit_cliques, model_errors
from noisemill.spec import Attribute, Categorical, Constraint, FreeText, Numerical, OpenSet, Schema

#: Cells of a pair's table that a broadcast may have.
_MOST_CELLS = 5_000_000
METHODS = ("independent", "direct", "mst", "aim", "aim_gdp", "swift")


class Initializer(Protocol):
    """Turns a column of any declared kind into one with codes, under ``rho``-zCDP for users of ``per_user`` rows:
    a ``Categorical`` or a ``Numerical`` with edges, and its codes' shares, or None to have them measured."""

    def __call__(self, df: DataFrame, column: str, attribute: Attribute, rho: float, rng: np.random.Generator, per_user: int) -> tuple[Attribute, np.ndarray | None]: ...


class Mechanism(Protocol):
    """Measures a coded table under ``rho``-zCDP, where a user moves counts by ``sensitivity``, and fits a model of all columns."""

    def __call__(self, codes: DataFrame, schema: Schema, rho: float, rng: np.random.Generator, sensitivity: float, known: dict[str, np.ndarray]) -> TreeModel | CliqueModel: ...


@dataclass
class TreeModel:
    """A root-first list of columns, each with its parent or none, and the shares of its codes: a
    vector, or a matrix with a row for each of the parent's codes."""

    schema: Schema
    total: float
    order: list[str]
    parents: dict[str, str | None]
    shares: dict[str, np.ndarray]
    log: list[dict] = field(default_factory=list)

    def single(self, column: str) -> np.ndarray:
        up = self.parents[column]
        return self.shares[column] if up is None else self.single(up) @ self.shares[column]

    def pair(self, a: str, b: str) -> np.ndarray:
        """The model's joint shares of two columns, along the path between them."""

        def path(c: str) -> list[str]:
            return [c] if self.parents[c] is None else [c, *path(self.parents[c])]

        up, other = path(a), path(b)
        common = next((c for c in up if c in other), None)
        if common is None:
            return np.outer(self.single(a), self.single(b))

        def given(c: str) -> np.ndarray:
            out = np.eye(self.schema[common].size)
            for x in reversed((up if c == a else other)[: (up if c == a else other).index(common)]):
                out = out @ self.shares[x]
            return out

        return given(a).T @ (self.single(common)[:, None] * given(b))


def _shares(counts: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Counts as shares of their row; where a row has none, even shares of what ``mask`` allows there."""
    allowed = np.ones(counts.shape) if mask is None else mask.astype(float)
    if not allowed.any(-1).all():
        raise ValueError("a constraint leaves no value that may occur")
    out = np.maximum(counts, 0) * allowed
    total, even = out.sum(-1, keepdims=True), allowed / allowed.sum(-1, keepdims=True)
    return np.where(total > 0, out / np.where(total > 0, total, 1), even)


def fit_tree(schema: Schema, singles: dict[str, np.ndarray], pairs: dict[tuple[str, str], np.ndarray], total: float, allowed: dict[tuple[str, str], np.ndarray] | None = None) -> TreeModel:
    """Shares along the forest that the pairs make; ``allowed`` masks cells that may not occur."""
    near: dict[str, list[str]] = {c: [] for c in schema}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    order: list[str] = []
    parents: dict[str, str | None] = {}
    shares: dict[str, np.ndarray] = {}
    for root in schema:
        if root in parents:
            continue
        parents[root], shares[root] = None, _shares(singles[root])
        queue = [root]
        while queue:
            at = queue.pop(0)
            order.append(at)
            for c in near[at]:
                if c not in parents:
                    table = pairs[at, c] if (at, c) in pairs else pairs[c, at].T
                    mask = None
                    if allowed:
                        mask = allowed.get((at, c), allowed[c, at].T if (c, at) in allowed else None)
                    table = np.maximum(table, 0)
                    thin = table.sum(1, keepdims=True) <= 0
                    table = np.where(thin, np.maximum(singles[c], 1e-9)[None], table)
                    parents[c], shares[c] = at, _shares(table, mask)
                    queue.append(c)
    return TreeModel(schema, max(1.0, total), order, parents, shares)


def _forest(scores: dict[tuple[str, str], float], columns: list[str], pick) -> list[tuple[str, str]]:
    """Edges of a spanning tree: ``pick`` chooses among those that join two parts."""
    part, out = {c: c for c in columns}, []
    while True:
        free = [e for e in scores if part[e[0]] != part[e[1]]]
        if not free:
            return out
        a, b = edge = pick(free)
        out.append(edge)
        old = part[b]
        part = {c: part[a] if p == old else p for c, p in part.items()}


def _exponential(scores: np.ndarray, epsilon: float, sensitivity: float, rng: np.random.Generator) -> int:
    x = scores * (epsilon / (2 * sensitivity)) if math.isfinite(epsilon) else scores * 1e12
    p = np.exp(x - x.max())
    return int(rng.choice(len(scores), p=p / p.sum()))


def _masks(schema: Schema, constraints: tuple[Constraint, ...]) -> dict[tuple[str, ...], np.ndarray]:
    """Which cells of its columns' joint table each constraint allows; constraints on the same columns meet."""
    out: dict[tuple[str, ...], np.ndarray] = {}
    for k in constraints:
        shape = [schema[c].size for c in k.columns]
        if np.prod(shape, dtype=float) > _MOST_CELLS:
            raise ValueError(f"a constraint over more than {_MOST_CELLS} cells: {k.columns}")
        mask = np.full(shape, bool(k.impossible))
        for combination in k.possible or k.impossible or k.depends:
            mask[tuple(schema[c].values.index(v) for c, v in zip(k.columns, combination, strict=True))] = not k.impossible
        out[k.columns] = out.get(k.columns, True) & mask
    return out


def synthesize_codes(
    codes: DataFrame,
    schema: Schema,
    rho: float,
    rng: np.random.Generator,
    method: str = "mst",
    cliques: list[tuple[str, ...]] | None = None,
    weight: str | None = None,
    sensitivity: float = 1.0,
    constraints: tuple[Constraint, ...] = (),
    width: int = 2,
    forest: bool = False,
    most_cells: int = _MOST_CELLS,
    known: dict[str, np.ndarray] | None = None,
    workload: dict[tuple[str, ...], float] | None = None,
) -> TreeModel | CliqueModel:
    """Measure a coded table under rho-zCDP and fit the model.

    A tenth of rho goes to the columns and the total, but not to columns whose shares are ``known``; the rest by ``method``: *independent* stops
    there; *direct* measures ``cliques`` of any width; *mst* draws a spanning tree by the pairs' distance from
    independence and measures it; *swift* takes noisy errors of all pairs, keeps the tree that is worth
    its noise, and shares the budget to match. *aim* and *aim_gdp* choose among all cliques of up to
    ``width`` columns, round by round (``_rounds``).

    All candidates are counted in one Spark pass, over codes, into a table of the declared domain's
    size. Errors against a model are passes over that table; only the cells of cliques that are
    measured come to the driver. Pairs that make a forest give a tree; wider cliques, cycles and
    constraints on three columns or more give a model over the cliques of a junction tree, of at
    most ``most_cells``. With ``forest``, *aim* and *aim_gdp* take only pairs that make one. A
    ``workload`` of weighted cliques has them choose among its cliques and their parts, by what those share
    with it; cliques of more than ``most_cells`` aren't candidates themselves, but their parts are.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    columns = list(schema)
    known = known or {}
    fresh = {c: a for c, a in schema.items() if c not in known}
    parts = budget.split(rho, len(fresh))
    if not fresh:
        singles = {}
    elif weight is None:
        singles = noisy_columns(codes, fresh, parts["each"], rng, sensitivity)
    else:
        singles = _weighted_columns(codes, fresh, weight, parts["each"], rng, sensitivity)
    n = codes.count() if weight is None else codes.agg(F.sum(weight)).first()[0] or 0.0
    total = n + rng.normal(0, sensitivity * budget.sigma_of_rho(parts["each"]))
    singles |= {c: max(1.0, total) * x for c, x in known.items()}
    masks = _masks(schema, constraints)
    wide = any(len(m) != 2 for m in masks)
    ones = {(c,): x for c, x in singles.items()}
    if method == "independent" and not wide or len(columns) < 2 and not masks:
        return fit_tree(schema, singles, {}, total)
    if method == "independent":
        return fit_cliques(schema, ones, total, masks, most_cells=most_cells)
    if method == "direct":
        asked = list(dict.fromkeys(map(tuple, cliques)))
    else:
        widest = min(width, len(columns)) if method in ("aim", "aim_gdp") and not forest else 2
        if workload and method in ("aim", "aim_gdp"):
            if lacking := sorted({c for e in workload for c in e} - set(columns)):
                raise ValueError(f"a workload's columns that the table lacks: {lacking}")
            widest = 2 if forest else max(map(len, workload))
            wanted = {tuple(sorted(p, key=columns.index)) for e in workload for k in range(2, min(widest, len(e)) + 1) for p in itertools.combinations(e, k)}
            asked = sorted(wanted, key=lambda e: (len(e), [columns.index(c) for c in e]))
        else:
            asked = [c for k in range(2, widest + 1) for c in itertools.combinations(columns, k)]
    if method in ("direct", "mst", "swift") and (big := [e for e in asked if cells_of(schema, e) > most_cells]):
        raise ValueError(f"tables of more than {most_cells} cells: {big}")
    asked = [e for e in asked if cells_of(schema, e) <= most_cells]
    if not asked:
        return fit_cliques(schema, ones, total, masks, most_cells=most_cells) if masks else fit_tree(schema, singles, {}, total)
    counts = checkpointed(marginals(codes, schema, asked, weight))
    place = {e: k for k, e in enumerate(asked)}
    shape = lambda e: tuple(schema[c].size for c in e)
    rest = parts["joint"]

    def measure(shares: dict[tuple[str, ...], float]) -> dict[tuple[str, ...], np.ndarray]:
        rows = counts.where(F.col("clique").isin([place[e] for e in shares])).toPandas()
        return {e: noisy_marginal(rows[rows["clique"] == place[e]], cells_of(schema, e), share, rng, sensitivity).reshape(shape(e)) for e, share in shares.items()}

    def errors(model: TreeModel | CliqueModel, some: list[tuple[str, ...]]) -> dict[tuple[str, ...], float]:
        found = {r.clique: r.error for r in model_errors(counts, model, asked, [place[e] for e in some]).collect()}
        return {e: found["|".join(e)] for e in some}

    free = fit_tree(schema, singles, {}, total)
    need = len(columns) - 1
    if method == "direct":
        shares = dict.fromkeys(asked, rest / len(asked))
        found, log = measure(shares), _log(shares, sensitivity)
    elif method == "mst":
        scores = errors(free, asked)
        epsilon = budget.selection_epsilon(rest / 2 / need)
        tree = _forest(scores, columns, lambda f: f[_exponential(np.array([scores[e] for e in f]), epsilon, sensitivity, rng)])
        shares = dict.fromkeys(tree, rest / 2 / need)
        found, log = measure(shares), _log(shares, sensitivity)
    elif method == "swift":
        sigma = sensitivity * budget.sigma_of_rho(0.1 * rest / len(asked))
        scores = {e: x + rng.normal(0, sigma) for e, x in errors(free, asked).items()}
        tree = _forest(scores, columns, lambda f: max(f, key=lambda e: scores[e] - sensitivity * math.sqrt(2 / math.pi) * cells_of(schema, e) * budget.sigma_of_rho(rest / need)))
        keep = budget.allocate({"|".join(e): (scores[e], cells_of(schema, e) * sensitivity, 1.0) for e in tree}, 0.9 * rest)
        shares = {e: keep["|".join(e)] for e in tree if "|".join(e) in keep}
        found, log = measure(shares), _log(shares, sensitivity)
    else:
        found, log = _rounds(schema, asked, ones, total, masks, rest, rng, sensitivity, method == "aim_gdp", forest, most_cells, measure, errors, workload)
    pairs = all(len(e) == 2 for e in found)
    if wide or not pairs or len(_forest(dict.fromkeys(found, 0.0), columns, lambda f: f[0])) < len(found):
        model = fit_cliques(schema, {**ones, **found}, total, masks, most_cells=most_cells)
    else:
        for e in masks:
            if e not in found and e[::-1] not in found:
                found = _with_edge(found, e, lambda p, x=e: np.outer(np.maximum(singles[x[0]], 0), np.maximum(singles[x[1]], 0)))
        model = fit_tree(schema, singles, found, total, masks)
    model.log = log
    return model


def _log(shares: dict[tuple[str, ...], float], sensitivity: float) -> list[dict]:
    return [{"round": k, "clique": "|".join(e), "rho": share, "sigma": sensitivity * budget.sigma_of_rho(share)} for k, (e, share) in enumerate(shares.items())]


def _rounds(schema, asked, ones, total, masks, rest, rng, sensitivity, by_noise, forest, most_cells, measure, errors, workload=None, refreshed: int = 16):
    """The adaptive choice of cliques: (tables, log).

    Each round takes the clique that the model so far gets most wrong, weighted by how many columns it
    shares with the others, less what its own noise would be; the junction tree may grow as the budget
    is spent. By the exponential mechanism, or, ``by_noise``, by noisy errors of all candidates, of which
    the best ``refreshed`` are taken anew against the current model each round. Where a measurement
    moves the model by no more than its noise, the next rounds get four times as much.
    """
    columns = list(schema)
    score = {c: s for c, _, s, _, _ in compile_workload(schema, workload or dict.fromkeys(asked, 1.0), max(map(len, asked)), most_cells)}
    weights = {e: score[tuple(sorted(e))] for e in asked}
    top = max(weights.values())
    weights = {e: w / top for e, w in weights.items()}
    model = fit_cliques(schema, ones, total, masks, most_cells=most_cells)
    found: dict[tuple[str, ...], np.ndarray] = {}
    log: list[dict] = []
    left, share = rest, rest / (2 * max(1, len(columns) - 1))
    noisy: dict[tuple[str, ...], float] = {}
    if by_noise:
        sigma = sensitivity * budget.sigma_of_rho(0.1 * rest / len(asked))
        noisy = {e: x + rng.normal(0, sigma) for e, x in errors(model, asked).items()}
        left = 0.9 * rest
        share *= 0.9
    part = {c: c for c in columns}
    while left > 1e-9 * rest or math.isinf(left):
        spent = 1.0 if math.isinf(rest) else min(1.0, 1 - (left - share) / rest)
        free = [e for e in asked if e not in found and (not forest or part[e[0]] != part[e[1]])]
        own = [*found, *masks]
        free = affordable(schema, own, free, max(most_cells * spent, 2 * sum(schema[c].size for c in columns) + max(map(lambda e: cells_of(schema, e), free), default=0)))
        if not free:
            break
        share = left if len(free) == 1 or left - share < 0.5 * share else min(share, left)
        penalty = {e: sensitivity * math.sqrt(2 / math.pi) * budget.sigma_of_rho(0.9 * share) * cells_of(schema, e) for e in free}
        if by_noise:
            best = sorted(free, key=lambda e: penalty[e] * weights[e] - noisy[e] * weights[e])[:refreshed]
            if found:
                sigma = sensitivity * budget.sigma_of_rho(0.1 * share / len(best))
                noisy |= {e: x + rng.normal(0, sigma) for e, x in errors(model, best).items()}
            e = max(best, key=lambda e: weights[e] * (noisy[e] - penalty[e]))
        else:
            now = errors(model, free)
            scores = np.array([weights[e] * (now[e] - penalty[e]) for e in free])
            e = free[_exponential(scores, budget.selection_epsilon(0.1 * share), sensitivity, rng)]
        before = model.marginal(e)
        found |= measure({e: 0.9 * share})
        if forest:
            old = part[e[1]]
            part = {c: part[e[0]] if p == old else p for c, p in part.items()}
        model = fit_cliques(schema, {**ones, **found}, total, masks, most_cells=most_cells)
        moved = float(np.abs(model.marginal(e) - before).sum()) * model.total
        log.append({"round": len(log), "clique": "|".join(e), "rho": share, "sigma": sensitivity * budget.sigma_of_rho(0.9 * share), "moved": moved})
        left = left if math.isinf(left) else left - share
        if moved <= penalty[e] and not math.isinf(share):
            share *= 4
    return found, log


def _with_edge(found: dict, edge: tuple[str, str], table) -> dict:
    """The forest with a constraint's edge; of the cycle that it may close, another edge goes."""
    near: dict[str, list] = {}
    for a, b in found:
        near.setdefault(a, []).append((b, (a, b)))
        near.setdefault(b, []).append((a, (a, b)))
    stack, seen = [(edge[0], None)], {edge[0]: None}
    while stack:
        at, _ = stack.pop()
        for to, via in near.get(at, []):
            if to not in seen:
                seen[to] = (at, via)
                stack.append((to, via))
    out = dict(found)
    if edge[1] in seen:
        out.pop(seen[edge[1]][1])
    out[edge] = table(edge)
    return out


def _weighted_columns(codes: DataFrame, schema: Schema, weight: str, rho: float, rng: np.random.Generator, sensitivity: float) -> dict[str, np.ndarray]:
    out = {c: rng.normal(0, sensitivity * budget.sigma_of_rho(rho), a.size) for c, a in schema.items()}
    for r in column_counts(codes, list(schema), weight).where("column <> '__total'").collect():
        out[r.column][r.code] += r.n
    return out


def _aliases(shares: np.ndarray) -> list[tuple[float, int]]:
    """Of each code how often its place stays with it, and which code it gives way to: Walker's alias method."""
    rest = shares / shares.sum() * len(shares)
    out = [(1.0, k) for k in range(len(rest))]
    low, high = [k for k in range(len(rest)) if rest[k] < 1], [k for k in range(len(rest)) if rest[k] >= 1]
    while low and high:
        a, b = low.pop(), high[-1]
        out[a] = (float(rest[a]), b)
        rest[b] -= 1 - rest[a]
        if rest[b] < 1:
            low.append(high.pop())
    return out


def draw(spark: SparkSession, model: TreeModel | CliqueModel, rows: int | None = None, seed: int = 0, given: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows of codes from the model, in as many tasks as Spark likes.

    Each column is one lookup in an alias table of domain size, by the parent's code (``drawn``). Columns that ``given`` has already are taken from there; its rows are told apart by ``key``.
    """
    if isinstance(model, CliqueModel):
        if given is not None:
            raise ValueError("a model over cliques draws whole rows")
        return draw_cliques(spark, model, rows, seed, key, _aliases)
    out = given if given is not None else spark.range(int(round(model.total)) if rows is None else rows).withColumnRenamed("id", key)
    for c in model.order:
        if c in out.columns:
            continue
        up = model.parents[c]
        shares = np.atleast_2d(model.shares[c])
        if shares.size > _MOST_CELLS:
            raise ValueError(f"{c}: a table of {shares.size} cells")
        out = drawn(out, shares, F.lit(0) if up is None else F.col(up), c, key, seed, _aliases).withColumnRenamed("_cell", c)
    return out


def declared(df: DataFrame, schema: Schema, rho: float, delta: float, rng: np.random.Generator, per_user: int = 1, initializers: dict[str, Initializer] | None = None) -> tuple[Schema, dict[str, np.ndarray]]:
    """The schema with values for its open columns and edges for its numbers without any, found privately,
    and those columns' shares, which finding them has measured already.

    The columns share rho; the open ones delta. Numbers get edges near their octiles, and an eighth of
    the rows for each part between two cuts. An open column's values have their noisy counts, public ones
    that weren't found none, and its default the rest. Columns with one of the ``initializers`` are left to it.
    """
    own = initializers or {}
    opened = {c: a for c, a in schema.items() if isinstance(a, OpenSet) and c not in own}
    bare = [c for c, a in schema.items() if isinstance(a, Numerical) and not a.edges and c not in own]
    # the open columns' defaults need the number of rows, which is one release more
    share, out, known = rho / max(1, len(opened) + len(bare) + len(own) + bool(opened)), dict(schema), {}
    if opened:
        found = found_values(df, opened, share * len(opened), delta, rng.bytes(32).hex(), per_user=per_user)
        n = max(1.0, df.count() + rng.normal(0, per_user * budget.sigma_of_rho(share)))
        for c, a in opened.items():
            values = listed(found[c], a)
            counts = np.array([max(found[c].get(v, 0.0), 0.0) for v in values])
            counts[0] = max(found[c].get(values[0], 0.0), n - counts[1:].sum(), 0.0)
            out[c], known[c] = Categorical(tuple(values)), counts / max(counts.sum(), 1e-9)
    for c in bare:
        edges, weights = edge_weights(private_cuts(df, c, schema[c], share / per_user**2, rng, levels=3), schema[c])
        out[c], known[c] = replace(schema[c], edges=edges), np.array(weights) / sum(weights)
    for c, look in own.items():
        out[c], shares = look(df, c, schema[c], share, rng, per_user)
        if not isinstance(out[c], Categorical | Numerical):
            raise ValueError(f"the initializer of {c} gave no column with codes: {out[c]}")
        if shares is not None:
            if len(shares) != out[c].size or min(shares) < 0 or not sum(shares) > 0:
                raise ValueError(f"the initializer of {c} gave no shares of its {out[c].size} codes")
            known[c] = np.asarray(shares, float) / sum(shares)
    return out, known


def synthesize(
    df: DataFrame,
    schema: Schema,
    epsilon: float,
    delta: float,
    seed: int | None = None,
    method: str | Mechanism = "mst",
    rows: int | None = None,
    constraints: tuple[Constraint, ...] = (),
    per_user: int = 1,
    compress: bool = False,
    draw_seed: int = 0,
    width: int = 2,
    share: float = 1.0,
    user: str | None = None,
    workload: dict[tuple[str, ...], float] | None = None,
    initializers: dict[str, Initializer] | None = None,
) -> DataFrame:
    """A synthetic table under (epsilon, delta)-differential privacy.

    One row is a user's, or at most ``per_user`` are: bound them first (``bound_contributions``).
    With ``compress``, a tenth of the budget finds each column's rare codes, which count as one while
    the rest is measured, and are drawn evenly in the end; columns with constraints keep theirs. The
    counts that found them serve as these columns' own and aren't paid for again.
    Open columns' values, and edges of numbers without any, are found privately, for a tenth of the
    budget and, for open columns, half of delta; these columns aren't measured again on their own. Free text is an error.

    With a ``share`` below 1, the job reads the rows of a secret sample of users, told apart by the column ``user``,
    may spend more on them (``sampling.on_sample``), and draws as many rows as the whole table has.
    ``initializers`` look at columns in ways of their own, for a part of that tenth as large as any
    other such column's; a ``method`` may be a ``Mechanism`` of one's own, and *aim* and *aim_gdp* take a ``workload``.

    Noise comes from the operating system. A ``seed`` makes it predictable, so that it protects
    nothing: for tests only. ``draw_seed`` tells the rows that are drawn from the noisy model.
    """
    if per_user < 1:
        raise ValueError("per_user must be at least 1")
    own = initializers or {}
    if lacking := sorted(set(own) - set(schema)):
        raise ValueError(f"initializers of no column: {lacking}")
    if bad := [n for n, a in schema.items() if isinstance(a, FreeText) and n not in own]:
        raise ValueError(f"columns without values: {bad}")
    if not isinstance(method, str) and (constraints or workload):
        raise ValueError("a mechanism of one's own has its own constraints and workload")
    if workload and method not in ("aim", "aim_gdp"):
        raise ValueError("only aim and aim_gdp take a workload")
    rng, known = np.random.default_rng(seed), {}
    if share != 1:
        if user is None:
            raise ValueError("a sample needs the column that tells users apart")
        epsilon, delta = sampling.on_sample(epsilon, delta, share)
        df = sampled_users(df, user, share, None if seed is None else rng.bytes(32).hex())
    opened = any(isinstance(a, OpenSet) for n, a in schema.items() if n not in own)
    rho = budget.zcdp_rho(epsilon, delta / 2 if opened else delta)
    if own or opened or any(isinstance(a, Numerical) and not a.edges for a in schema.values()):
        schema, known = declared(df, schema, 0.1 * rho, delta / 2, rng, per_user, own)
        rho *= 0.9
    codes = encode_table(df, schema)
    rare = Compression({})
    if compress and (some := {c: a for c, a in schema.items() if c not in known}):
        each = 0.1 * rho / len(some)
        noisy = noisy_columns(codes, some, each, rng, per_user)
        rare = find_compression(noisy, per_user * budget.sigma_of_rho(each), {c for k in constraints for c in k.columns})
        known |= {c: _shares(rare.counts(c, x)) for c, x in noisy.items()}
        rho *= 0.9
    codes, small = rare.compress(codes), rare.schema(schema)
    if isinstance(method, str):
        model = synthesize_codes(codes, small, rho, rng, method, sensitivity=per_user, constraints=constraints, width=width, known=known, workload=workload)
    else:
        model = method(codes, small, rho, rng, sensitivity=per_user, known=known)
    if rows is None and share != 1:
        rows = int(round(model.total / share))
    made = draw(df.sparkSession, model, rows, draw_seed)
    made = rare.uncompress(made.select("id", *(F.col(f"`{c}`") for c in schema)), "id", seed=draw_seed)
    return decode_table(made, schema, "id", seed=draw_seed).drop("id")


def domain_values(tables: list[DataFrame]) -> DataFrame:
    """(column, value): the distinct values of every column but the last, which must be ``count``."""
    seen = None
    for t in tables:
        if t.columns[-1] != "count":
            raise ValueError(f"the last column must be count, not {t.columns[-1]}")
        pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in t.columns[:-1]))
        part = t.select(F.inline(pairs))
        seen = part if seen is None else seen.unionByName(part)
    return seen.distinct()


def infer_domain(tables: list[DataFrame]) -> dict[str, list[str]]:
    """Each column's distinct values, sorted, over tables whose last column is ``count``."""
    out: dict[str, list[str]] = {}
    for r in domain_values(tables).orderBy("column", "value").collect():
        out.setdefault(r["column"], []).append(r.value)
    return out


def model_from_marginals(tables: list[DataFrame], values: dict[str, list[str]] | None = None) -> TreeModel | CliqueModel:
    """The model through given joint counts of any number of columns, as they are. The total is the largest sum.

    Pairs that make a forest give a tree, others a model over cliques. A cell that its table doesn't list wasn't measured: it gets what its columns, taken
    for independent, would have there. Zero counts must be listed to be kept. A single
    column's value that its table doesn't list has no rows.
    """
    values = values or infer_domain(tables)
    schema: Schema = {c: Categorical(tuple(v)) for c, v in values.items()}
    singles: dict[str, np.ndarray] = {}
    pairs: dict[tuple[str, ...], np.ndarray] = {}
    total = 0.0
    for t in tables:
        columns = t.columns[:-1]
        counts = np.zeros([schema[c].size for c in columns])
        measured = np.zeros(counts.shape, bool)
        for r in t.collect():
            at = tuple(values[c].index(str(r[c])) for c in columns)
            counts[at] += r["count"]
            measured[at] = True
        total = max(total, counts.sum())
        if len(columns) == 1:
            singles[columns[0]] = counts
        else:
            pairs[tuple(columns)] = _completed(counts, measured)
    if any(len(e) > 2 for e in pairs) or len(_forest(dict.fromkeys(pairs, 0.0), list(schema), lambda f: f[0])) < len(pairs):
        return fit_cliques(schema, {**{(c,): x for c, x in singles.items()}, **pairs}, total)
    for (a, b), x in pairs.items():
        singles.setdefault(a, x.sum(1))
        singles.setdefault(b, x.sum(0))
    tree = _forest(dict.fromkeys(pairs, 0.0), list(schema), lambda f: f[0])
    return fit_tree(schema, singles, {e: pairs[e] for e in tree}, total)


def _completed(counts: np.ndarray, measured: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The counts, those not measured as if the columns were independent."""
    out = np.where(measured, counts, 0.0)
    for _ in range(rounds if not measured.all() and out.sum() > 0 else 0):
        even, every = np.ones_like(out), range(out.ndim)
        for k in every:
            even = even * out.sum(tuple(j for j in every if j != k), keepdims=True) / (out.sum() if k else 1.0)
        out = np.where(measured, counts, even)
    return out


def pair_errors(df: DataFrame, schema: Schema) -> DataFrame:
    """(clique, error): every column pair's distance from independence."""
    codes = encode_table(df, schema)
    pairs = list(itertools.combinations(schema, 2))
    return independence_errors(marginals(codes, schema, pairs), column_counts(codes, list(schema)), schema, pairs)


__all__ = ["METHODS", "TreeModel", "domain_values", "draw", "fit_tree", "infer_domain", "model_from_marginals", "pair_errors", "synthesize", "synthesize_codes"]
