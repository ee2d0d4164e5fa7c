"""Families: a parent with all its children as one wide row, so that siblings are drawn together.

A few children are looked at side by side. As children are exchangeable, what is measured on these slots
holds for every slot that a family may have; a family's size says which of them are filled.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame

from noisemill.functions import budget
from noisemill.operators.relational import remapped, replicated, symmetric_marginals
from noisemill.plans.cliques import Clique, CliqueModel, affordable, fit_cliques
from noisemill.spec import Categorical, Schema


def slot_rules(sizes: dict[str, int], slots: int, capacity: int) -> dict[Clique, np.ndarray]:
    """Which codes may meet: a slot is filled just where the family has so many children, and all its
    columns are filled or none, in a chain of neighbours, so that no rule has over two columns."""
    names, out = list(sizes), {}
    for s in range(1, slots + 1):
        first = np.zeros((capacity + 1, sizes[names[0]] + 1), bool)
        first[:s, -1], first[s:, :-1] = True, True
        out["group_size", f"slot_{s}.{names[0]}"] = first
        for a, b in itertools.pairwise(names):
            both = np.zeros((sizes[a] + 1, sizes[b] + 1), bool)
            both[:-1, :-1], both[-1, -1] = True, True
            out[f"slot_{s}.{a}", f"slot_{s}.{b}"] = both
    return out


def _shares(x: np.ndarray, otherwise: np.ndarray | None = None) -> np.ndarray:
    """Counts, negative ones as none, as shares of their row; a row without any gets other shares."""
    x = np.maximum(x, 0)
    total = x.sum(-1, keepdims=True)
    spare = np.full(x.shape[-1], 1 / x.shape[-1]) if otherwise is None else otherwise
    return np.where(total > 0, x / np.where(total > 0, total, 1), spare)


def fit_families(wide: DataFrame, near: Schema, sizes: dict[str, int], capacity: int, slots: int, rho: float, rng: np.random.Generator, sensitivity: float, parents, most_cells: int = 300_000) -> CliqueModel:
    """A model of whole families, from an exploration table of ``slots`` children side by side.

    ``near`` holds the parents' columns and ``group_size``, whose model ``parents`` is; ``sizes`` the children's
    columns. A quarter of rho chooses, for each child's column, the column that it hangs on: a parent's, the
    family's size or an earlier one of the child. The rest measures these pairs, and each column
    against a sibling's, all in one pass, with noise for ``sensitivity`` parents a root row. Sibling
    pairs of neighbouring slots are fitted always, others as long as the junction tree stays within
    ``most_cells``.
    """
    names = list(sizes)
    over = {c: a.size for c, a in near.items()} | {f"slot_{s}.{c}": n + 1 for s in range(1, slots + 1) for c, n in sizes.items()}
    options = {c: [*((u, f"slot_1.{c}") for u in near), *((f"slot_1.{b}", f"slot_1.{c}") for b in names[:k])] for k, c in enumerate(names)}
    beside = [(f"slot_1.{c}", f"slot_2.{c}") for c in names]
    asked = [*itertools.chain(*options.values()), *beside]
    counts = symmetric_marginals(wide, over, asked, slots, "weight", sizes).toPandas()  # of the declared domain's size
    tables: dict[Clique, np.ndarray] = {}
    for k, clique in enumerate(asked):
        x = np.zeros([over[c] for c in clique])
        part = counts[counts["clique"] == k]
        x.ravel()[part["cell"].to_numpy(int)] = part["n"].to_numpy(float)
        tables[clique] = x[:, :-1] if clique[0] in near else x[:-1, :-1]

    sigma = sensitivity * budget.sigma_of_rho(0.75 * rho / (2 * len(names)))
    epsilon = budget.selection_epsilon(0.25 * rho / len(names))
    measured: dict[Clique, np.ndarray] = {}
    for c in names:
        apart = [float(np.abs(t - np.outer(t.sum(1), t.sum(0)) / max(t.sum(), 1e-9)).sum()) for t in (tables[o] for o in options[c])]
        chances = np.array(apart) * (epsilon / (2 * 2 * sensitivity) if np.isfinite(epsilon) else 1e12)
        chances = np.exp(chances - chances.max())
        choice = options[c][int(rng.choice(len(chances), p=chances / chances.sum()))]
        measured[choice] = tables[choice] + rng.normal(0, sigma, tables[choice].shape)
    alike = {c: tables[b] + rng.normal(0, sigma, tables[b].shape) for c, b in zip(names, beside, strict=True)}

    schema: Schema = {**near, **{f"slot_{s}.{c}": Categorical(tuple(range(n + 1))) for s in range(1, capacity + 1) for c, n in sizes.items()}}
    family = parents.single("group_size")
    reaching = lambda s: float(family[s:].sum())
    goals: dict[Clique, np.ndarray] = {}
    for u in near:
        for v in near:
            if parents.parents.get(v) == u:
                goals[u, v] = parents.pair(u, v)
    for u in near:
        goals.setdefault((u,), parents.single(u))
    for (u, c), x in measured.items():
        for s in range(1, capacity + 1):
            if u in near:
                have = np.where(np.arange(len(family)) >= s, family, 0) if u == "group_size" else parents.pair(u, "group_size")[:, s:].sum(1)
                filled = have[:, None] * _shares(x, _shares(np.maximum(x, 0).sum(0)))
                whole = np.column_stack([filled, np.maximum(parents.single(u) - have, 0)])
            else:
                whole = np.zeros([n + 1 for n in x.shape])
                whole[:-1, :-1] = reaching(s) * _shares(x.ravel()).reshape(x.shape)
                whole[-1, -1] = 1 - reaching(s)
            goals[remapped((u, c), {1: s})] = whole
    rules = slot_rules(sizes, capacity, capacity)
    pairs = [(f"slot_{i}.{c}", f"slot_{j}.{c}") for c in names for i, j in itertools.combinations(range(1, capacity + 1), 2)]
    used: list[Clique] = [*goals, *rules, *(p for c in names for p in replicated((f"slot_1.{c}", f"slot_2.{c}"), capacity) if _gap(p) == 1)]
    for pair in sorted(pairs, key=_gap):
        if _gap(pair) == 1 or affordable(schema, used, [pair], most_cells):
            used.append(pair)
            c = pair[0].partition(".")[2]
            i, j = (int(x.partition(".")[0].removeprefix("slot_")) for x in pair)
            both = np.maximum(alike[c] + alike[c].T, 0)
            both = _shares(both.ravel()).reshape(both.shape)
            whole = np.zeros([n + 1 for n in both.shape])
            whole[:-1, :-1] = reaching(j) * both
            whole[:-1, -1] = (reaching(i) - reaching(j)) * both.sum(1)
            whole[-1, -1] = 1 - reaching(i)
            goals[pair] = whole
    return fit_cliques(schema, goals, parents.total, rules, rounds=40)


def _gap(pair: Clique) -> int:
    """How many slots two siblings' columns lie apart."""
    i, j = (int(c.partition(".")[0].removeprefix("slot_")) for c in pair)
    return j - i
