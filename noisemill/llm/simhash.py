"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import anti_join, discard, free_name, id_text, materialize, mix, semi_join, slices, split_by, spread_join, word_hashes
from .components import connected_components

_OUT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprint(text: bytes, width: int, seed: int) -> int:
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), len(tokens)
    if n <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: n - width + 1]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of the ``width``-word shingles of each whole text.

    A-Z count as a-z. A text of fewer words has one shingle, a text without words, or null, has
    fingerprint zero. One row per input row, also for repeated ids.
    """

    def run(batches):
        for x in slices(batches):
            fps = [_fingerprint(t.encode(), width, seed) for t in x.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(fps, pa.int64())], schema=_OUT)

    return id_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _segments(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment. Two values within ``distance`` lie within a radius
    in one segment at least, as the radii sum to distance - segments + 1."""
    spare = distance - segments + 1
    radii = [spare // segments + (k < spare % segments) for k in range(segments)] if spare >= 0 else [0] * segments
    widths = [64 // segments + (k < 64 % segments) for k in range(segments)]
    return [(sum(widths[:k]), widths[k], radii[k]) for k in range(segments)]


def links(values: DataFrame, distance: int = 4, segments: int | None = None) -> DataFrame:
    """Pairs (u, v) of the rows (node, fp) whose 64-bit ``fp`` have ``distance`` differing bits or fewer.

    The table has each row once per segment, keyed by the segment's bits. Each row probes it with
    the small Hamming ball round its own bits in that segment; matches are verified over all 64
    bits inside the join. Of two rows that differ in the segment, the one with a zero at the lowest
    differing bit makes the probe. A pair may come more than once, from several segments.

    Without ``segments`` there are three, and two for more than 2 ** 24 values: wider segments have
    larger balls, but buckets that don't fill up. The pairs are the same either way.
    """
    if segments is None:
        segments = 3 if values.count() <= 1 << 24 else 2

    def key(k: int, shift: int, width: int):
        own = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND((1 << width) - 1)
        return own.bitwiseOR(F.lit(k << 40).cast("long"))

    parts = _segments(distance, segments)
    keys = F.explode(F.array(*(key(k, s, w) for k, (s, w, _) in enumerate(parts))))
    table = values.select(F.col("node").alias("v"), F.col("fp").alias("fp_v"), keys.alias("key"))
    probes = []
    for k, (shift, width, radius) in enumerate(parts):
        masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]
        ball = F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask")
        each = values.select(F.col("node").alias("u"), F.col("fp").alias("fp_u"), key(k, shift, width).alias("own"), ball)
        first = each.where("own & (mask & -mask) = 0")
        probes.append(first.select("u", "fp_u", (F.col("mask") != 0).alias("turned"), F.expr("own ^ mask").alias("key")))
    probe = probes[0]
    for x in probes[1:]:
        probe = probe.unionByName(x)
    near = f"bit_count(fp_u ^ fp_v) <= {distance} and (turned or u < v) and u <> v"
    return probe.join(table, "key").where(near).select("u", "v")


def near_duplicates(
    docs: DataFrame, width: int = 4, seed: int = 42, distance: int = 4, segments: int | None = None
) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked, directly or through
    others, share the smallest doc_id among them.

    Equal fingerprints meet in a grouped minimum first, so that thousands of copies cost one row
    in the search. Null texts count as empty; a null doc_id is no component's name unless all of it
    are null. One row per input row. The joins back to the documents split fingerprints and
    components that very many of them have.
    """
    found = materialize(fingerprints(docs, width, seed), "fingerprints")
    values = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "values")
    pairs = materialize(links(values.select(F.col("fp").alias("node"), "fp"), distance, segments), "links")
    member = connected_components(pairs).withColumnRenamed("node", "fp")
    named = values.join(member, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "named")
    least = materialize(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    ids = materialize(spread_join(named.select("fp", "component"), least, "component", "fp").select("fp", "component_id"), "ids")
    return spread_join(found, ids, "fp", "doc_id").select("doc_id", "fp", "component_id")


_BINS = 512
_EMPTY = np.uint16(0xFFFF)
_ORDERS = np.argsort(np.random.default_rng(7).random((_BINS, _BINS)), axis=1)
_BITS = [f"bits{k}" for k in range(_BINS // 32)]
_ODD_BITS = 1024
_ODD = [f"odd{k}" for k in range(_ODD_BITS // 64)]
_AT_ONCE = 1024
_SKETCH = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("key", pa.int64()),
        ("n", pa.int64()),
        ("fp", pa.int64()),
        ("bands", pa.list_(pa.int64())),
        *((c, pa.int64()) for c in (*_BITS, *_ODD)),
    ]
)
_SKETCH_DDL = "doc_id long, key long, n long, fp long, bands array<long>, " + ", ".join(f"{c} long" for c in (*_BITS, *_ODD))
_SETS = pa.schema([("key", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _shingles(hashes: np.ndarray, rows: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each distinct ``width``-word shingle of ``n`` texts, in order; a shorter text is one shingle."""
    per = np.bincount(rows, minlength=n)
    begin = np.cumsum(per) - per
    size = np.minimum(per, width)
    shingle = np.zeros(len(hashes), np.uint64)
    keep = np.arange(len(hashes)) - begin[rows] <= per[rows] - size[rows]
    padded = np.append(hashes, np.zeros(width, np.uint64))
    for k in range(width):
        inside = k < size[rows]
        shingle = np.where(inside, mix(shingle + padded[k : k + len(hashes)]), shingle)
    return _distinct(shingle[keep], rows[keep])


def _distinct(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def _set_keys(shingle: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A hash of each text's set of shingles: a sum, so that it has no order."""
    sums = np.append(np.uint64(0), np.cumsum(mix(shingle ^ np.uint64(0x5851F42D4C957F2D))))
    at = np.searchsorted(owner, np.arange(n + 1))
    return mix(sums[at[1:]] - sums[at[:-1]]).view(np.int64)


def _filled(bins: np.ndarray) -> np.ndarray:
    """The bins, those without a shingle filled from others, in an order that is the bin's own.

    So each of the values agrees for two texts as often as the texts are alike, also if they
    have few shingles. Texts without any keep their empty bins.
    """
    out = bins.copy().reshape(-1)
    at = np.flatnonzero((bins == _EMPTY) & (bins != _EMPTY).any(1)[:, None])
    for k in range(_BINS):
        if not len(at):
            break
        value = bins[at // _BINS, _ORDERS[at % _BINS, k]]
        out[at] = value
        at = at[value == _EMPTY]
    return out.reshape(-1, _BINS)


def _band_width(similarity: float) -> int:
    """The most bins a band can have, so that fewer than one of 10 ** 5 pairs at ``similarity`` agrees in none."""
    return next((r for r in range(12, 1, -1) if (1 - similarity**r) ** (_BINS // r) < 1e-5), 1)


def _most_bins(similarity: float) -> int:
    """How many bins may differ in their two lowest bits: five standard deviations more than pairs at ``similarity`` have."""
    p = (1 - similarity) * 0.75
    return int(_BINS * p + 5 * math.sqrt(_BINS * p * (1 - p)))


def _sketch(x: pa.RecordBatch, width: int, size: int) -> pa.RecordBatch:
    hashes, rows = word_hashes(x.column("text"))
    n = x.num_rows
    fps, bins = np.zeros(n, np.int64), np.full((n, _BINS), _EMPTY, np.uint16)
    keys, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
    odd = np.zeros((n, _ODD_BITS), bool)
    if len(hashes):
        h, r = _distinct(hashes, rows)
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        half = np.diff(np.append(first, len(r)))[:, None]
        fps[r[first]] = np.packbits(ones * 2 > half, axis=1, bitorder="little").view("<i8").ravel()
        shingle, owner = _shingles(hashes, rows, n, width)
        keys, sizes = _set_keys(shingle, owner, n), np.bincount(owner, minlength=n)
        bit = owner * _ODD_BITS + (shingle >> np.uint64(20) & np.uint64(_ODD_BITS - 1)).astype(np.int64)
        odd = (np.bincount(bit, minlength=odd.size) & 1).astype(bool).reshape(odd.shape)
        place = owner * _BINS + (shingle >> np.uint64(55)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        bins.reshape(-1)[place[head]] = np.minimum(shingle[head] & np.uint64(0xFFFF), np.uint64(0xFFFE)).astype(np.uint16)
    bins = _filled(bins)
    low = np.stack([bins & np.uint16(1), bins >> np.uint16(1) & np.uint16(1)], axis=2).reshape(n, 2 * _BINS)
    low = np.packbits(np.concatenate([low.astype(bool), odd], axis=1), axis=1, bitorder="little").view("<i8")
    count = _BINS // size
    bands = np.tile(np.arange(1, count + 1, dtype=np.uint64), (n, 1))
    for k in range(size):
        bands = mix(bands + bins[:, k : count * size : size])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * count, pa.int32()), pa.array(bands.view(np.int64).ravel()))
    columns = [x.column("doc_id"), pa.array(keys), pa.array(sizes), pa.array(fps), lists]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(c)) for c in low.T)], schema=_SKETCH)


def sketches(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, key, n, fp, bands, bits0 ... bits15, odd0 ... odd15) for each row.

    ``key`` and ``n``: a hash and the size of the text's set of ``width``-word shingles. ``fp``: the
    SimHash of its distinct words. From 512 bins with 16 bits of the least shingle hash in each come
    ``bands``, hashes of runs of bins, and the two lowest bits of each bin. ``odd``: 1024 bits, set where an
    odd number of shingles falls; two texts' bits differ at most as often as their shingles do.
    """
    size = _band_width(similarity)

    def run(batches):
        for x in slices(batches):
            for at in range(0, x.num_rows, _AT_ONCE):
                yield _sketch(x.slice(at, _AT_ONCE), width, size)

    return id_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SKETCH_DDL)


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(key, shingles) for each row: the hashes of the text's distinct shingles, under the key of ``sketches``."""

    def run(batches):
        for x in slices(batches):
            n = x.num_rows
            shingle, owner = _shingles(*word_hashes(x.column("text")), n, width)
            at = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.array(shingle.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_set_keys(shingle, owner, n)), lists], schema=_SETS)

    return id_text(docs).select("text").mapInArrow(run, "key long, shingles array<long>")


def _fits(similarity: float) -> str:
    """Whether the nodes u and v may be alike.

    What they share is bounded by the shingles that any other node has, and what they don't share by
    their odd bits; both bounds are exact. The bins only estimate, which serves long texts.
    """
    share, apart = similarity / (1 + similarity) * (1 - 1e-9), (1 - similarity) / (1 + similarity) * (1 + 1e-9)
    odd = " + ".join(f"bit_count({c}_u ^ {c}_v)" for c in _ODD)
    bins = " + ".join(f"bit_count(({c}_u ^ {c}_v | shiftrightunsigned({c}_u ^ {c}_v, 1)) & {_EVEN_BITS})" for c in _BITS)
    return (
        f"least(common_u, common_v) >= {share}D * (n_u + n_v) and {odd} <= {apart}D * (n_u + n_v) + 1e-6D"
        f" and {bins} <= {_most_bins(similarity)}"
    )


_EVEN_BITS = 0x5555555555555555


def _with_common(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes that have sets, with ``common``: how many of a node's shingles another of them has too."""
    alone = sets.select("key", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    own = alone.where("n = 1").groupBy("key").agg(F.count("*").alias("own"))
    known = semi_join(nodes, sets.select("key"), "key").join(own, "key", "left")
    return known.select("key", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"), *_BITS, *_ODD)


def _end(nodes: DataFrame, end: str) -> DataFrame:
    """The nodes as one end of pairs: their columns with ``_u`` or ``_v``, the key as ``u`` or ``v``."""
    return nodes.select(F.col("key").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in nodes.columns if c != "key"))


def _with_ends(pairs: DataFrame, nodes: DataFrame, counted: DataFrame) -> DataFrame:
    """The pairs with the columns of both their nodes; a node may be in very many of the ``counted`` pairs."""
    for end, other in (("u", "v"), ("v", "u")):
        counts = counted.groupBy(end).agg(F.count("*").alias("n"))
        pairs = spread_join(pairs, _end(nodes, end), end, other, counts)
    return pairs


def _plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (u, v), those that counts and bins don't rule out."""
    pairs = materialize(pairs, "tried")
    return materialize(_with_ends(pairs, nodes, pairs).where(_fits(similarity)).select("u", "v"), "pairs")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (u, v) of keys, those that share ``similarity`` of their shingles: counted, not estimated."""
    both = F.size(F.array_intersect("shingles_u", "shingles_v"))
    either = F.size("shingles_u") + F.size("shingles_v") - both
    # a round's few pairs need few of the sets, which are the largest rows here
    sets = split_by(sets, pairs.select(F.explode(F.array("u", "v")).alias("key")), "key")[0]
    return materialize(_with_ends(pairs, sets, pairs).where(both / either >= similarity).select("u", "v"), "close")


def _by_fingerprint(nodes: DataFrame, near: int) -> DataFrame:
    """Pairs (u, v) from the index: nodes of one word fingerprint with one of them, fingerprints within ``near`` bits."""
    fps = materialize(nodes.groupBy("fp").agg(F.min("key").alias("node")), "fps")
    same = spread_join(nodes.select("key", "fp"), fps, "fp", "key").where("key <> node")
    same = same.select(F.col("key").alias("u"), F.col("node").alias("v"))
    other = links(fps.select("node", "fp"), near).groupBy("u").agg(F.min("v").alias("v"))
    return same.unionByName(other)


def _with_label(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label, "key", "left").select(*rows.columns, F.coalesce("component", "key").alias("label"))


def _leaders(state: DataFrame, mask: int) -> DataFrame:
    """Pairs (u, v) of each node and one other of a label that isn't its own, from a band that both are in.

    With no mask, a band's leader is its node with the fewest shingles of its own: the text that a
    group's others were made of has none. With a mask it is the node with the least key under it.
    As the order is the same in all bands, a dense group's nodes mostly meet the same leader.
    """
    place = F.col("key").bitwiseXOR(F.lit(mask).cast("long"))
    if not mask:
        place = F.shiftleft(F.least("own", F.lit(1 << 20)), 43).bitwiseOR(place.bitwiseAND(F.lit((1 << 43) - 1)))
    leader = state.withColumn("place", place).groupBy("band").agg(
        F.min_by("key", "place").alias("leader"),
        F.min_by("label", "place").alias("theirs"),
        F.min("place").alias("place"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.count("*").alias("n"),
    )
    leader = materialize(leader.where("low <> high").select("band", "leader", "theirs", "place", "n"), "leaders")
    met = spread_join(state, leader.drop("n"), "band", "key", leader.select("band", "n")).where("label <> theirs")
    return met.groupBy(F.col("key").alias("u")).agg(F.min_by("leader", "place").alias("v"))


def _between(state: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """All pairs (u, v) of nodes that share a band but no label, unless counts and bins rule them out.

    Of two nodes one at least isn't of the label that most nodes of the band have: it looks for the
    others, so that a large group that is joined already isn't compared with itself.
    """
    size = state.groupBy("band", "label").agg(F.count("*").alias("n"))
    main = size.groupBy("band").agg(F.max_by("label", "n").alias("main"), F.count("*").alias("labels")).where("labels > 1")
    open_ = state.join(main.drop("labels"), "band").join(nodes, "key")
    open_ = materialize(open_, "open")
    open_ = open_.drop("own")
    one, other = _end(open_.where("label <> main"), "u"), _end(open_, "v").drop("main_v")
    once = "label_u <> label_v and (label_v = main_u or u < v)"
    found = one.withColumnRenamed("band_u", "band").join(other.withColumnRenamed("band_v", "band"), "band")
    return found.where(f"{once} and {_fits(similarity)}").select("u", "v").distinct()


#: Orders in which the leaders of bands are chosen, round after round.
_MASKS = [0, *map(int, mix(np.arange(1, 9, dtype=np.uint64)).view(np.int64))]


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, near: int = 3) -> DataFrame:
    """(doc_id, component_id): documents that share ``similarity`` of their ``width``-word shingles,
    directly or through others, have the smallest doc_id among them as component.

    Texts with the same set of shingles are one node. The first pairs come from the multi-index
    search: fingerprints of distinct words within ``near`` bits. The rest come from bands of bins
    of shingle hashes, whatever the shape of an edit is: of 10 ** 5 pairs at ``similarity`` fewer
    than one shares no band. Each pair is decided by its counted shingles.

    Dense groups are joined first, by rounds in which every node is compared with one leader; rounds
    end when hardly any joins. Then all pairs of a band are taken that no label joins yet, so no
    pair is left out, and none within a joined group is listed. A pair is spared the count where exact
    bounds rule it out, or where bins differ so much that of 10 ** 6 pairs at ``similarity`` about one
    would. Null texts count as empty; empty
    texts are copies of each other.
    """
    found = materialize(sketches(docs, width, similarity), "sketches")
    member_of = materialize(found.select("doc_id", "key"), "keys")
    first = (F.first(c).alias(c) for c in ("n", "fp", "bands", *_BITS, *_ODD))
    nodes = materialize(found.groupBy("key").agg(F.min("doc_id").alias("first_id"), *first), "nodes")
    discard(found)
    bands = nodes.select("key", F.explode("bands").alias("band"))
    many = materialize(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    # most bands are of one node alone: the filter spares them a second shuffle
    likely = split_by(bands, many, "band")[0]
    shared = materialize(spread_join(likely, many.select("band"), "band", "key", many).select("band", "key"), "shared")
    pairs = materialize(_by_fingerprint(nodes, near), "pairs")

    keys = shared.select("key").unionByName(pairs.select(F.explode(F.array("u", "v")).alias("key"))).distinct()
    keys = materialize(keys, "compared")
    ids_read = materialize(nodes.select("key", "first_id").join(keys, "key", "left_semi").select(F.col("first_id").alias("doc_id")), "first-ids")
    sets = _shingle_sets(semi_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids_read, "doc_id"), width)
    sets = sets.join(keys, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets, "sets")
    # a node that shares too little with all others together can't be like any of them
    small = materialize(_with_common(nodes, sets).where(f"common >= {similarity} * n"), "common")
    shared = materialize(shared.join(small.select("key", (F.col("n") - F.col("common")).alias("own")), "key"), "shared")
    pairs = _plausible(pairs, small, similarity)

    # pairs are written before their components are sought: a task then has one Python worker, not two
    close = _alike(pairs, sets, similarity)
    label = connected_components(close).withColumnRenamed("node", "key")
    for mask in _MASKS:
        state = materialize(_with_label(shared, label), "state")
        pairs = _plausible(_leaders(state, mask), small, similarity)
        more = _alike(pairs, sets, similarity)
        tried, joined = pairs.count(), more.count()
        discard(state)
        if joined:
            close = close.unionByName(more)
            label = connected_components(close).withColumnRenamed("node", "key")
        if joined * 20 <= tried:
            break
    state = materialize(_with_label(shared, label), "state")
    pairs = materialize(_between(state, small, similarity), "pairs")
    close = close.unionByName(_alike(pairs, sets, similarity))
    label = connected_components(close).withColumnRenamed("node", "key")

    named = materialize(_with_label(nodes.select("key", "first_id"), label), "named")
    least = materialize(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "least")
    ids = materialize(spread_join(named.select("key", "label"), least, "label", "key").select("key", "component_id"), "ids")
    out = materialize(spread_join(member_of, ids, "key", "doc_id").select("doc_id", "component_id"), "components")
    discard(member_of, nodes, many, keys, ids_read, shared, sets, small, state, pairs, named, least, ids)
    return out


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` of one document per group of near copies: that with the smallest doc_id.

    Rows without a doc_id are kept as they are; of repeated rows with one id, all stay.
    """
    found = near_copies(docs.where("doc_id is not null"), **options)
    stays = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    key = free_name("key", docs.columns)
    gone = materialize(stays.where("not stays").select(F.col("doc_id").alias(key)), "gone")
    # the few that go are sought, so that the texts of those that stay needn't be shuffled
    return anti_join(docs.withColumn(key, F.col("doc_id").cast("long")), gone, key).select(*(f"`{c}`" for c in docs.columns))
