"""Declared schemas: what values a column may hold, and how tables hang together."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

OOD = "<OOD>"


@dataclass(frozen=True)
class Categorical:
    """A column with known values; a value's place is its code. Others count as ``values[ood]``."""

    values: tuple
    ood: int = 0
    description: str = ""

    def __post_init__(self):
        if not self.values or any(v is None for v in self.values):
            raise ValueError("a categorical column needs values, none of them null")
        if len({type(v) for v in self.values}) > 1:
            raise ValueError(f"values of several types: {self.values}")
        if len(set(self.values)) < len(self.values):
            raise ValueError(f"repeated values: {self.values}")
        if not 0 <= self.ood < len(self.values):
            raise ValueError(f"no value at {self.ood}")

    @property
    def size(self) -> int:
        return len(self.values)


@dataclass(frozen=True)
class OpenSet:
    """A column whose values must be discovered; what isn't becomes ``default``."""

    default: str = OOD
    public: tuple[str, ...] = ()


@dataclass(frozen=True)
class Numerical:
    """A number within bounds, which may be infinite where edges are given. ``edges`` cut [low, high] into right-closed bins. With ``clip``, values
    outside go to the nearest bin and invalid ones to the first; else bin 0 is for all of these.
    ``decode``: midpoint, sample or interval; ``sentinel``: what bin 0 decodes to without clip."""

    low: float
    high: float
    edges: tuple[float, ...] = ()
    integer: bool = False
    clip: bool = True
    decode: str = "midpoint"
    sentinel: float | str | None = None

    def __post_init__(self):
        if not self.low < self.high:
            raise ValueError(f"empty range [{self.low}, {self.high}]")
        if not self.edges and math.isinf(self.high - self.low):
            raise ValueError(f"an endless range needs edges: [{self.low}, {self.high}]")
        if self.decode not in ("midpoint", "sample", "interval"):
            raise ValueError(f"unknown decode {self.decode!r}")
        if list(self.edges) != sorted(set(self.edges)) or any(not self.low <= e < self.high for e in self.edges):
            raise ValueError(f"edges must rise within [{self.low}, {self.high}): {self.edges}")
        if self.sentinel is not None and (self.decode == "interval") != isinstance(self.sentinel, str):
            raise ValueError("an interval's sentinel is text, any other a number")

    @property
    def size(self) -> int:
        return len(self.edges) + 1 + (not self.clip)

    @property
    def exclusive_low(self) -> float:
        return self.low - 1 if self.integer else math.nextafter(self.low, -math.inf)

    def bounds(self) -> list[tuple[float, float]]:
        ends = [self.low, *self.edges, self.high]
        return list(zip(ends[:-1], ends[1:], strict=True))

    def spans(self) -> list[tuple[float, float]]:
        """What values of each bin are drawn between: its bounds, or twice the finite one where the other is infinite."""
        return [(r, r) if math.isinf(l) else (l, l) if math.isinf(r) else (l, r) for l, r in self.bounds()]

    def labels(self) -> list[str]:
        """The bins as the values of a categorical column."""
        ends = [self.exclusive_low, *self.edges, self.high]
        pairs = zip(ends[:-1], ends[1:], strict=True)
        whole = lambda x: x if math.isinf(x) else int(x)
        out = [f"[{whole(a + 1)}, {whole(b)}]" if self.integer else f"({a}, {b}]" for a, b in pairs]
        return out if self.clip else ["OUT_OF_DOMAIN", *out]


@dataclass(frozen=True)
class FreeText:
    """Prose; tabular synthesis rejects it."""

    max_tokens: int = 256
    description: str = ""


Attribute = Categorical | OpenSet | Numerical | FreeText
Schema = dict[str, Attribute]


@dataclass(frozen=True)
class Constraint:
    """Exactly one of: the combinations of ``columns`` that may occur, those that may not, or
    ``depends``: pairs (fine, coarse) in which the first value fixes the second."""

    columns: tuple[str, ...]
    possible: tuple[tuple, ...] = ()
    impossible: tuple[tuple, ...] = ()
    depends: tuple[tuple, ...] = ()

    def __post_init__(self):
        if sum(map(bool, (self.possible, self.impossible, self.depends))) != 1:
            raise ValueError("give one of possible, impossible, depends")
        if self.depends and len(self.columns) != 2:
            raise ValueError("a dependency has two columns")
        if any(len(c) != len(self.columns) for c in (*self.possible, *self.impossible, *self.depends)):
            raise ValueError(f"combinations must have {len(self.columns)} values")


@dataclass(frozen=True)
class ForeignKey:
    """child.key refers to parent.key; of a parent at most ``capacity`` children count."""

    parent: str
    parent_key: str
    child: str
    child_key: str
    capacity: int

    def __post_init__(self):
        if self.capacity < 1:
            raise ValueError("capacity must be at least 1")


@dataclass(frozen=True)
class Relations:
    """Tables below one root."""

    keys: tuple[ForeignKey, ...]
    tables: dict[str, Schema] = field(default_factory=dict)

    def order(self) -> list[tuple[str, ForeignKey | None]]:
        """Tables from the root down, each with the key to its parent; cycles, second parents and
        second roots are errors."""
        names = set(self.tables) | {t for k in self.keys for t in (k.parent, k.child)}
        if self.tables and names - set(self.tables):
            raise ValueError(f"unknown tables: {sorted(names - set(self.tables))}")
        up: dict[str, ForeignKey] = {}
        for k in self.keys:
            if k.child in up or k.child == k.parent:
                raise ValueError(f"{k.child} needs one parent other than itself")
            up[k.child] = k
        roots = sorted(names - set(up))
        if len(roots) != 1:
            raise ValueError(f"there must be one root, not {roots}")
        out: list[tuple[str, ForeignKey | None]] = [(roots[0], None)]
        for name, _ in out:
            out += [(k.child, k) for k in self.keys if k.parent == name]
        if len(out) != len(names):
            raise ValueError("the foreign keys have a cycle")
        return out

    def check_columns(self, columns: dict[str, list[str]]) -> None:
        """An error unless each table is given, with its declared columns and its keys."""
        for name, own in self.tables.items():
            if name not in columns:
                raise ValueError(f"no table {name}")
            keys = [k.parent_key for k in self.keys if k.parent == name] + [k.child_key for k in self.keys if k.child == name]
            if missing := sorted({*own, *keys} - set(columns[name])):
                raise ValueError(f"{name} lacks {missing}")

    def sensitivities(self, per_root: int = 1) -> dict[str, int]:
        """How many rows of each link's parent one root row can touch."""
        reach, out = {}, {}
        for name, k in self.order():
            reach[name] = 1 if k is None else reach[k.parent] * k.capacity
            if k is not None:
                out[f"{k.parent}->{k.child}"] = per_root * reach[k.parent]
        return out
