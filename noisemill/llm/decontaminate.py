"""Benchmark decontamination by template canonicalisation and slot consistency."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import LOWER_VALUES, anti_join, batch, buffers, free_name, hash_of, id_text, materialize, mix, slices, span_hashes

#: Words that count as units when they follow a number.
UNITS = """
mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz pound pounds ounce ounces ton tons
ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
ml l liter liters litre litres gallon gallons cup cups cent cents dollar dollars euro euros usd eur gbp percent degrees
""".split()

_OTHER, _LETTER, _DIGIT = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER
_BREAK = np.zeros(256, bool)
_BREAK[[10, 13, ord("."), ord("!"), ord("?"), ord(":"), ord(";")]] = True
_NUMBER, _NAME, _UNIT = np.uint64(1), np.uint64(2), np.uint64(3)
_PLACEHOLDERS = 4
_unit_hashes = None


def _units() -> np.ndarray:
    global _unit_hashes
    if _unit_hashes is None:
        _unit_hashes = np.sort(np.array([hash_of(u) for u in UNITS], np.uint64))
    return _unit_hashes


def _lower_others(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> None:
    """Give tokens with capitals beyond A-Z the value of their small letters."""
    high = np.append(0, np.cumsum(data >= 128))
    raw, which, small = data.tobytes(), [], []
    for k in np.flatnonzero(high[end] > high[start]).tolist():
        word = raw[start[k] : end[k]]
        lower = word.decode(errors="replace").lower().encode()
        if lower != word.lower():
            which.append(k)
            small.append(lower)
    if which:
        bounds = np.cumsum([0, *map(len, small)])
        value[which] = span_hashes(LOWER_VALUES[np.frombuffer(b"".join(small), np.uint8)], bounds[:-1], bounds[1:])


def canonical(column: pa.Array) -> dict[str, np.ndarray]:
    """The template tokens of each text: start, end (bytes), row, value and template.

    A token is a run of letters or a number, decimal points and commas inside. In the template a
    number, a unit after a number, and a capitalised word inside a sentence are placeholders of
    their type; any other word is itself, in lower case. ``value`` hashes what the text has there.
    """
    data, offsets = buffers(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return {"start": none, "end": none, "row": none, "value": none.astype(np.uint64), "template": none.astype(np.uint64)}
    kind = _CLASS[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    point = np.flatnonzero(((data[1:-1] == 46) | (data[1:-1] == 44)) & (kind[:-2] == _DIGIT) & (kind[2:] == _DIGIT) & ~first[1:-1] & ~first[2:]) + 1
    kind[point] = _DIGIT
    edge = first.copy()
    edge[0] = True
    edge[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(data))
    is_token = kind[start] != _OTHER
    start, end = start[is_token], end[is_token]
    row = np.searchsorted(offsets, start, "right") - 1
    value = span_hashes(LOWER_VALUES[data], start, end)
    value[value < _PLACEHOLDERS] += np.uint64(_PLACEHOLDERS)
    _lower_others(data, start, end, value)
    number = kind[start] == _DIGIT
    capital = (data[start] >= 65) & (data[start] <= 90) | (data[start] == 0xC3) & (data[np.minimum(start + 1, len(data) - 1)] < 0x9F)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    before = np.append(0, end[:-1])
    same = np.zeros(len(start), bool)
    same[1:] = row[1:] == row[:-1]
    inside = same & (breaks[start] == breaks[before])
    after_number = np.zeros(len(start), bool)
    after_number[1:] = number[:-1] & same[1:]
    units = _units()
    unit = after_number & (units[np.minimum(np.searchsorted(units, value), len(units) - 1)] == value)
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(capital & inside, _NAME, value)))
    return {"start": start, "end": end, "row": row, "value": value, "template": template}


def _windows(tokens: dict[str, np.ndarray], width: int, literals: int, of: str = "template") -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of each window inside a text that holds enough words of its own."""
    t, row = tokens[of], tokens["row"]
    n = len(t) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = np.zeros(n, np.uint64)
    own = np.zeros(n, np.int64)
    literal = t >= _PLACEHOLDERS
    for k in range(width):
        hashes = mix(hashes + t[k : k + n])
        own += literal[k : k + n]
    at = np.flatnonzero((row[:n] == row[width - 1 :]) & (own >= literals))
    return at, hashes[at]


def _salted(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of values: other ones for each width, and than those of templates."""
    return mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (width + 1) & (1 << 64) - 1))


def _all_windows(tokens: dict[str, np.ndarray], width: int, literals: int, widths: list[int]):
    """(first token, hash, whether of values only) of the template windows, then of the values' of each width."""
    at, hashes = _windows(tokens, width, literals)
    yield at, hashes, False
    for w in widths:
        at, hashes = _windows(tokens, w, 0, "value")
        yield at, _salted(hashes, w), True


_ITEM_WINDOWS = pa.schema([("item", pa.int64()), ("hash", pa.int64()), ("place", pa.int32()), ("verbatim", pa.bool_()), ("width", pa.int32())])
_ITEM_DDL = "item long, hash long, place int, verbatim boolean, width int"


def item_windows(items: DataFrame, width: int, literals: int) -> DataFrame:
    """(item, hash, place, verbatim, width) of all windows of the rows (item, text): of template tokens,
    and of values; an item shorter than a window is one."""

    def run(batches):
        for x in slices(batches):
            tokens = canonical(x.column("text"))
            row = tokens["row"]
            first = np.searchsorted(row, np.arange(x.num_rows + 1))
            short = np.minimum(np.diff(first), width)
            parts = []
            for k, (at, hashes, verbatim) in enumerate(_all_windows(tokens, width, literals, list(range(1, width + 1)))):
                if verbatim:
                    own = short[row[at]] == k
                    at, hashes = at[own], hashes[own]
                parts.append((row[at], hashes, at - first[row[at]], np.full(len(at), verbatim), np.full(len(at), k)))
            rows, hashes, place, verbatim, w = (np.concatenate(c) for c in zip(*parts, strict=True))
            item = x.column("item").take(pa.array(rows))
            yield batch(_ITEM_WINDOWS, item, hashes.view(np.int64), place.astype(np.int32), verbatim, w.astype(np.int32))

    return items.mapInArrow(run, _ITEM_DDL)


#: Bits of the filter of window hashes at most, whatever the benchmark's size: 8 MB.
_FILTER_BITS = 1 << 26


@dataclass
class _Filter:
    """A Bloom filter of hashes, two bits each."""

    words: np.ndarray

    @classmethod
    def of(cls, windows: DataFrame) -> _Filter:
        bits = 1 << 16
        while bits < min(64 * windows.count(), _FILTER_BITS):
            bits *= 2
        mask = F.lit(bits - 1).cast("long")
        both = F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask))
        bit = windows.select(F.explode(both).alias("bit"))
        word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int")))
        found = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(word.alias("bits")).toArrow()  # bits / 64 rows at most
        words = np.zeros(bits // 64, np.uint64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return cls(words)

    def _bit_is_set(self, bit: np.ndarray) -> np.ndarray:
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Where a hash may be one of them."""
        mask = np.uint64(len(self.words) * 64 - 1)
        at = np.flatnonzero(self._bit_is_set(hashes & mask))
        return at[self._bit_is_set(hashes[at] >> np.uint64(32) & mask)]


def _consistent(theirs: np.ndarray, ours: np.ndarray) -> bool:
    """Whether each value of the item stands for one value of the text, and the other way round."""
    pairs = set(zip(theirs.tolist(), ours.tolist(), strict=True))
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def _covered(runs: list[tuple], size: int) -> int:
    at = np.zeros(size, bool)
    for r in runs:
        at[r[0] : r[1]] = True
    return int(at.sum())


def _places(runs: list[tuple], size: int):
    """The runs of each stretch of the text that is long enough for the item and a quarter more words.

    Runs end in (from, to in the text). A stretch begins with a run; those that hold nothing new are left out.
    """
    span, before = size + size // 4, -1
    runs = sorted(runs, key=lambda r: r[-2:])
    starts, ends = (np.array([r[k] for r in runs]) for k in (-2, -1))
    limits = starts + span
    for k, (limit, last) in enumerate(zip(limits.tolist(), np.searchsorted(starts, limits).tolist(), strict=True)):
        inside = ends[k:last]
        if ((inside > before) & (inside <= limit)).any():
            yield [runs[k + j] for j in np.flatnonzero(inside <= limit).tolist()]
        before = limit


def _enough(runs: list[tuple], size: int, least: float, run: int) -> int:
    """How many of the item's tokens the runs cover, or 0 if neither those nor the longest run are enough."""
    longest, total = max(r[1] - r[0] for r in runs), sum(r[1] - r[0] for r in runs)
    if longest < run and total < least * size:
        return 0
    covered = _covered(runs, size)
    return covered if longest >= run or covered >= least * size else 0


def _best(runs: list[tuple], size: int, least: float, run: int, choose) -> tuple[list[tuple] | None, int]:
    """What ``choose`` takes of the place where that covers most of the item, the first of equal ones, and how much it covers."""
    best, most = None, 0
    for place in _places(runs, size):
        if _enough(place, size, least, run) and (own := choose(place)) is not None and (n := _covered(own, size)) > most:
            best, most = own, n
            if most == size:
                break
    return best, most


def _renaming(runs: list[tuple], size: int, least: float, run: int) -> list[tuple] | None:
    """The runs of one renaming that hold enough of an item in one place, those with the most tokens; None if none does.

    ``runs``: (from, to, slots of the item, slots of the text, from and to in the text). Each run
    begins a renaming, which takes up, longest first, all others that agree with it. So other
    variants of the item in the same text don't count against a variant.
    """
    if _consistent(np.concatenate([r[2] for r in runs]), np.concatenate([r[3] for r in runs])):
        return runs if _enough(runs, size, least, run) else None
    runs = sorted((r for r in runs if _consistent(r[2], r[3])), key=lambda r: (r[0] - r[1], r[4]))
    once: dict[tuple, tuple] = {}
    for r in runs:
        once.setdefault((r[0], r[1], r[3].tobytes()), r)
    runs = list(once.values())
    if not runs or _covered(runs, size) < least * size and runs[0][1] - runs[0][0] < run:
        return None
    pairs = [set(zip(r[2].tolist(), r[3].tolist(), strict=True)) for r in runs]
    best, most = None, 0
    for k in range(len(runs)):
        there, back, own = {}, {}, []
        for j in (k, *range(k), *range(k + 1, len(runs))):
            if all(there.get(a, b) == b and back.get(b, a) == a for a, b in pairs[j]):
                there.update(pairs[j])
                back.update((b, a) for a, b in pairs[j])
                own.append(runs[j])
        n = _covered(own, size)
        if n > most and (n >= least * size or max(r[1] - r[0] for r in own) >= run):
            best, most = own, n
        if most == size:
            break
    return best


def _verified(x: pa.RecordBatch, width: int, least: float, run: int):
    """The rows of ``_OUT`` for the rows (doc_id, text, item_id, item_text, shifts, verbatim) that hold."""
    tokens, items = canonical(x.column("text")), canonical(x.column("item_text"))
    bounds, first = (np.searchsorted(t["row"], np.arange(x.num_rows + 1)) for t in (tokens, items))
    texts = x.column("text")
    bases = buffers(texts)[1]
    for k, (shifts, only) in enumerate(zip(x.column("shifts").to_pylist(), x.column("verbatim").to_pylist(), strict=True)):
        size, origin, begin = int(first[k + 1] - first[k]), int(first[k]), int(bounds[k])
        quotes, runs = [], []
        for shift, verbatim in zip(shifts, only, strict=True):
            shift += begin
            a, b = max(0, begin - shift), min(size, int(bounds[k + 1]) - shift)
            same, equal = np.zeros(size + 2, bool), np.zeros(size + 2, bool)
            equal[a + 1 : b + 1] = tokens["value"][shift + a : shift + b] == items["value"][origin + a : origin + b]
            # a sentence's first word may be a name elsewhere; as it stands it is the same word
            same |= equal
            if not verbatim:
                same[a + 1 : b + 1] |= tokens["template"][shift + a : shift + b] == items["template"][origin + a : origin + b]
            for s, e in _runs(equal, min(width, size)):
                quotes.append((s, e, shift + s, shift + e))
            for s, e in _runs(same, min(width, size)):
                theirs, ours = items["value"][origin + s : origin + e], tokens["value"][shift + s : shift + e]
                slot = items["template"][origin + s : origin + e] < _PLACEHOLDERS
                runs.append((s, e, theirs[slot], ours[slot], shift + s, shift + e))
        if not runs:
            continue
        own, matched = _best(runs, size, least, run, lambda place, n=size: _renaming(place, n, least, run))
        if own is not None:
            theirs, ours = (np.concatenate([r[j] for r in own]) for j in (2, 3))
            changed = int((theirs != ours).sum())
            kind = "reparameterised" if changed else "exact"
        else:
            own, matched = _best(quotes, size, least, run, lambda place: place)
            if own is None:
                continue
            kind, theirs, changed = "quoted", np.zeros(0), 0
        low, high = min(r[-2] for r in own), max(r[-1] for r in own)
        raw, base = texts[k].as_py().encode(), int(bases[k])
        span = (len(raw[: int(at) - base].decode(errors="ignore")) for at in (tokens["start"][low], tokens["end"][high - 1]))
        most = max(r[1] - r[0] for r in own)
        yield x.column("doc_id")[k].as_py(), x.column("item_id")[k].as_py(), size, matched, most, len(theirs), changed, kind, *span


def _runs(same: np.ndarray, least: int):
    """(start, end) of the runs of at least ``least``, of a mask with a false at both ends."""
    edges = np.flatnonzero(np.diff(same.astype(np.int8)))
    return [(s, e) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if e - s >= least]


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("item_tokens", pa.int64()),
        ("matched_tokens", pa.int64()),
        ("longest_run", pa.int64()),
        ("n_slots", pa.int64()),
        ("n_changed", pa.int64()),
        ("kind", pa.string()),
        ("start", pa.int64()),
        ("end", pa.int64()),
    ]
)
_DDL = (
    "doc_id long, item_id long, item_tokens long, matched_tokens long, longest_run long, "
    "n_slots long, n_changed long, kind string, start long, end long"
)
_HITS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])


def _hits(texts: DataFrame, windows: DataFrame, width: int, literals: int) -> DataFrame:
    """(doc_id, text, hashes, places) of the texts with windows that the filter of all item windows lets pass."""
    spark = texts.sparkSession
    passing = spark.sparkContext.broadcast(_Filter.of(windows))
    widths = [r.width for r in windows.where("verbatim").select("width").distinct().collect()]  # ``width`` of them at most

    def run(batches):
        for x in slices(batches):
            tokens = canonical(x.column("text"))
            row = tokens["row"]
            first = np.searchsorted(row, np.arange(x.num_rows + 1))
            rows, hashes, places = [], [], []
            for at, h, _ in _all_windows(tokens, width, literals, widths):
                hit = passing.value.holds(h)
                rows.append(row[at[hit]])
                hashes.append(h[hit])
                places.append(at[hit] - first[row[at[hit]]])
            rows = np.concatenate(rows)
            if not len(rows):
                continue
            order = np.argsort(rows, kind="stable")
            own, count = np.unique(rows, return_counts=True)
            ends = pa.array(np.append(0, np.cumsum(count)), pa.int32())
            lists = [np.concatenate(hashes)[order].view(np.int64), np.concatenate(places)[order].astype(np.int32)]
            kept = [x.column(c).take(pa.array(own)) for c in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in lists)], schema=_HITS)

    return texts.mapInArrow(run, "doc_id long, text string, hashes array<long>, places array<int>")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = 5, literals: int = 3, coverage: float = 0.5, run: int = 13
) -> DataFrame:
    """Pairs of documents and benchmark items whose wording the document holds.

    Texts become template tokens (see ``canonical``). Windows of ``width`` tokens with at least
    ``literals`` words of their own are hash-joined with those of the items, and beside them windows of
    the words and numbers as they stand, in lower case, however few of them are no slots; an item
    shorter than a window is one as a whole. So copies in capitals, and copies of items of numbers,
    are found too. A pair's windows are extended on their diagonals to runs of equal templates.

    Each place of the text is judged by itself: a stretch with room for the item and a quarter more
    tokens, so that scattered phrases, or contradictory variants one after another, don't add up.
    The values in the slots must be a one-to-one renaming; runs that disagree are other variants of
    the item, each judged with the runs that agree with it. The pair counts if the runs of a renaming
    cover ``coverage`` of the item's tokens, or one of them is ``run`` long: ``kind`` is then exact or
    reparameterised. Where no renaming does, runs of at least ``width`` tokens that are equal as they
    stand may cover as much, or one be ``run`` long: quoted. Slots that contradict each other make no
    pair. ``start`` and ``end`` bound the place that covers most, in code points; of equal ones the first.

    All documents are read once: a filter of fixed size, made of the items' window hashes, lets few
    windows pass, and those are joined with the items' windows as tables. Null texts count as empty; an
    empty benchmark or corpus gives no pairs; repeated rows and repeated items give repeated pairs.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    windows = materialize(item_windows(items.select("item", "text"), width, literals), "item-windows")
    texts = id_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(_hits(texts, windows, width, literals).withColumn("row", F.monotonically_increasing_id()), "hits")
    hits = found.select("row", F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("places").alias("at"))))
    joined = hits.join(windows.drop("width"), "hash").select("row", "item", (F.col("at") - F.col("place")).alias("shift"), "verbatim")
    shifts = joined.groupBy("row", "item", "shift").agg(F.bool_and("verbatim").alias("verbatim"))
    pairs = shifts.groupBy("row", "item").agg(F.sort_array(F.collect_list(F.struct("shift", "verbatim"))).alias("all"))
    lists = pairs.select("row", "item", F.col("all.shift").alias("shifts"), F.col("all.verbatim").alias("verbatim"))
    wide = lists.join(found.select("row", "doc_id", "text"), "row").join(items.withColumnRenamed("text", "item_text"), "item")

    def verify(batches):
        for x in slices(slices(batches), "item_text"):
            rows = list(_verified(x, width, coverage, run))
            if rows:
                yield batch(_OUT, *zip(*rows, strict=True))

    return wide.select("doc_id", "text", "item_id", "item_text", "shifts", "verbatim").mapInArrow(verify, _DDL)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id has no contaminated pair; rows without an id are judged alike, as one."""
    key = free_name("key", docs.columns)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    found = contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, **options)
    bad = materialize(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return anti_join(keyed, bad, key).select(*(f"`{c}`" for c in docs.columns))
