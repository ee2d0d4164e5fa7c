"""Values to codes and back, as column expressions that Catalyst fuses into one projection."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisemill.spec import Categorical, Numerical, Schema

_INLINE = 64  # values up to which a lookup is written into the plan
_JOINED = 1000  # values from which a table's column is looked up by a join
_BROADCAST = 100_000  # values up to which that join may broadcast them


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of the keys: the same however the table is partitioned."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def gaussian(secret: str, *keys: Column | str) -> Column:
    """A standard normal number from a keyed hash of the keys. Whoever has the secret can tell it: take
    a new one from the operating system for each release. A task that runs again draws the same."""
    text = F.concat_ws("\x1f", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    digest = F.sha2(F.concat(F.lit(secret), text), 256)

    def unit(at: int) -> Column:
        return (F.conv(F.substring(digest, at, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))

    return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * math.pi * unit(13))


def _number(column: Column | str) -> Column:
    x = F.col(column) if isinstance(column, str) else column
    x = x.try_cast("double")
    return F.when(~F.isnan(x), x)


def standardize_categorical(column: Column | str, a: Categorical) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isin(*a.values), c).otherwise(F.lit(a.values[a.ood]))


def encode_categorical(column: Column | str, a: Categorical) -> Column:
    """A value's code; what is unknown, null included, gets that of the out-of-domain value.

    Values match as they are typed; a text column is matched against numbers by a cast that may fail.
    """
    c = F.col(column) if isinstance(column, str) else column
    kind = {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(a.values[0])]
    c = c.try_cast(kind)
    if len(a.values) <= _INLINE:
        out = F.lit(a.ood)
        for code, value in reversed(list(enumerate(a.values))):
            out = F.when(c == F.lit(value), F.lit(code)).otherwise(out)
        return out.cast("int")
    known = F.map_from_arrays(F.array(*map(F.lit, a.values)), F.array(*map(F.lit, range(len(a.values)))))
    return F.coalesce(F.try_element_at(known, c), F.lit(a.ood)).cast("int")


def decode_categorical(code: Column | str, a: Categorical) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.try_element_at(F.array(*map(F.lit, a.values)), (c + 1).cast("int"))


def standardize_numeric(column: Column | str, a: Numerical) -> Column:
    """The number, integers rounded half to even. With clip, too small and invalid values become the
    least, too large ones the greatest; without, all of them become null."""
    x = _number(column)
    inside = F.rint(x) if a.integer else x
    low, high = (F.lit(float(a.low)), F.lit(float(a.high))) if a.clip else (F.lit(None).cast("double"),) * 2
    return F.when(x.isNull() | (x < a.low), low).when(x > a.high, high).otherwise(inside)


def discretize(column: Column | str, a: Numerical) -> Column:
    """The bin: how many edges lie below the value. Without clip 0 is for what is outside or invalid."""
    x = _number(column)
    if a.clip:
        x = F.when(x.isNull(), F.lit(float(a.low))).otherwise(x)
    code = F.lit(0)
    for e in a.edges:
        code = code + F.when(x > float(e), 1).otherwise(0)
    if not a.clip:
        code = F.when(x.isNull() | (x < a.low) | (x > a.high), 0).otherwise(code + 1)
    return code.cast("int")


def undiscretize(code: Column | str, a: Numerical, *keys: Column | str, seed: int = 0) -> Column:
    """A value of the bin: its midpoint, a draw from it (by a hash of ``keys``), or its label.

    Integers are rounded up when values are clipped. Bin 0 without clip gives the sentinel: null,
    or an empty label, unless another is named.
    """
    c = F.col(code) if isinstance(code, str) else code
    bounds = a.bounds()
    place = (c + (1 if a.clip else 0)).cast("int")

    def pick(values: list) -> Column:
        return F.try_element_at(F.array(*map(F.lit, values)), F.greatest(place, F.lit(1)))

    if a.decode == "interval":
        out = pick([f"[{bounds[0][0]}, {bounds[0][1]}]", *(f"({l}, {r}]" for l, r in bounds[1:])])
        return out if a.clip else F.when(c == 0, F.lit(a.sentinel or "")).otherwise(out)
    if a.decode == "midpoint":
        out = pick([(l + r) / 2 for l, r in a.spans()])
    else:
        out = pick([float(l) for l, _ in a.spans()]) + uniform(*keys, seed=seed) * pick([float(r - l) for l, r in a.spans()])
    if a.integer and a.clip:
        return F.ceil(out).cast("long")
    return out if a.clip else F.when(c == 0, F.lit(a.sentinel).cast("double")).otherwise(out)


def uniform_edges(low: float, high: float, bins: int, integer: bool = False) -> tuple[float, ...]:
    """Edges of ``bins`` bins of one width; of integers they are cut to whole numbers, each once."""
    edges = [low + (high - low) * k / bins for k in range(1, bins)]
    return tuple(sorted({math.trunc(e) for e in edges})) if integer else tuple(edges)


def grid_index(column: Column | str, low: float, high: float, step: float) -> Column:
    """The nearest point of the grid low, low + step, ...; halves go to the even one, null stays null."""
    x = _number(column)
    inside = F.greatest(F.lit(float(low)), F.least(x, F.lit(float(high))))  # these two skip nulls
    return F.when(x.isNotNull(), F.rint((inside - low) / step)).cast("long")


def merge_rare(code: Column | str, common: list[bool]) -> Column:
    """Common codes renumbered in order; all rare ones become the code after them."""
    c = F.col(code) if isinstance(code, str) else code
    n, place, to = sum(common), 0, []
    for keep in common:
        to.append(place if keep else n)
        place += keep
    return F.try_element_at(F.array(*map(F.lit, to)), (c + 1).cast("int"))


def unmerge_rare(code: Column | str, common: list[bool], *keys: Column | str, seed: int = 0) -> Column:
    """Back from ``merge_rare``; a rare code is drawn evenly by a hash of ``keys``, the first without. Null stays null."""
    c = F.col(code) if isinstance(code, str) else code
    kept, rare = [k for k, x in enumerate(common) if x], [k for k, x in enumerate(common) if not x]
    out = F.when(c.isNotNull(), F.try_element_at(F.array(*map(F.lit, kept or [0])), F.least(c + 1, F.lit(max(1, len(kept)))).cast("int")))
    if not rare:
        return out
    draw = F.try_element_at(F.array(*map(F.lit, rare)), (F.floor(uniform(*keys, seed=seed) * len(rare)) + 1).cast("int")) if keys else F.lit(rare[0])
    return F.when(c >= len(kept), draw).otherwise(out)


def linear_index(codes: list[Column | str], sizes: list[int]) -> Column:
    """The cell of a joint table, last column fastest."""
    out, stride = F.lit(0).cast("long"), 1
    for c, n in zip(reversed(codes), reversed(sizes), strict=True):
        out = out + (F.col(c) if isinstance(c, str) else c).cast("long") * stride
        stride *= n
    return out


def look_up(df: DataFrame, column: str, a: Categorical, to: str) -> DataFrame:
    """``df`` with the codes of ``column`` as ``to``, by a join with the values: for thousands of them."""
    kind = {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(a.values[0])]
    value, code = "_value", "_code"
    while {value, code} & set(df.columns):
        value, code = f"_{value}", f"_{code}"
    known = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(a.values)], f"{value} {kind}, {code} int")
    if a.size <= _BROADCAST:
        known = F.broadcast(known)
    found = df.join(known, F.col(column).try_cast(kind) == F.col(value), "left")
    return found.withColumn(to, F.coalesce(code, F.lit(a.ood))).drop(value, code)


def encode_table(df: DataFrame, schema: Schema, keep: tuple[str, ...] = ()) -> DataFrame:
    """The schema's columns as codes, and the columns named in ``keep``, in one projection.

    Columns of more than 1000 values are looked up by joins before it.
    """
    out = []
    for name, a in schema.items():
        if not isinstance(a, (Categorical, Numerical)):
            raise TypeError(f"{name}: {type(a).__name__} has no codes")
        if isinstance(a, Numerical):
            code = discretize(name, a)
        elif a.size <= _JOINED:
            code = encode_categorical(name, a)
        else:
            to = f"_code_of_{name}"
            while to in df.columns:
                to = f"_{to}"
            df, code = look_up(df, name, a, to), F.col(to)
        out.append(code.alias(name))
    return df.select(*keep, *out)


@dataclass(frozen=True)
class Reversible:
    """A column expression and its way back; ``then`` puts another after it."""

    forward: Callable[[Column], Column]
    back: Callable[[Column], Column]

    def __call__(self, column: Column | str) -> Column:
        return self.forward(F.col(column) if isinstance(column, str) else column)

    def inverse(self) -> Reversible:
        return Reversible(self.back, self.forward)

    def then(self, after: Reversible) -> Reversible:
        return Reversible(lambda c: after.forward(self.forward(c)), lambda c: self.back(after.back(c)))


def coded(a: Categorical) -> Reversible:
    """Values to codes; unknown ones come back as the out-of-domain value."""
    return Reversible(lambda c: encode_categorical(c, a), lambda c: decode_categorical(c, a))


def merged(common: list[bool]) -> Reversible:
    """Rare codes to one; it comes back as the first of them."""
    return Reversible(lambda c: merge_rare(c, common), lambda c: unmerge_rare(c, common))


def unit_interval(a: Numerical) -> Reversible:
    """[low, high] to [0, 1]; what lies outside goes to the nearer end, null stays null."""
    width = float(a.high - a.low)

    def forward(c: Column) -> Column:
        x = _number(c)
        return F.when(x.isNotNull(), (F.greatest(F.lit(float(a.low)), F.least(x, F.lit(float(a.high)))) - a.low) / width)

    def back(c: Column) -> Column:
        x = F.lit(float(a.low)) + c * width
        return F.rint(x).cast("long") if a.integer else x

    return Reversible(forward, back)


def decode_table(df: DataFrame, schema: Schema, *keys: str, seed: int = 0) -> DataFrame:
    """The codes' values; ``keys`` tell rows apart where a value is drawn."""
    return df.select(*(c for c in df.columns if c not in schema), *((decode_categorical(n, a) if isinstance(a, Categorical) else undiscretize(n, a, *keys, F.lit(n), seed=seed)).alias(n) for n, a in schema.items()))
