"""Phrases whose words occur together more often than apart, by relational mining of occurrences (SETM).

The relation R_k has a row for each occurrence of a phrase of k words, sorted by piece and position. R_1
is written once. R_k is merged from R_(k-1) by piece and adjacent position, its groups are counted, and
it is semi-joined with the frequent ones before it is extended and written as the next relation.

Occurrences are kept in blocks of whole pieces, one row of sorted arrays each, with a dictionary of the
block's words; so a merge by piece and position meets neighbours in one block, only distinct groups of
a block are shuffled, and a frequent word or phrase sends one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._support import LOWER, LOWER_VALUES, batch, buffers, cut, discard, gives_back, materialize, mix, slices, span_hashes, spread_join, words

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_APART = _PIECE_END.copy()
_APART[[9, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)

_ONES = pa.schema(
    [
        ("block", pa.int64()),
        ("names", pa.list_(pa.int64())),
        ("words", pa.list_(pa.string())),
        ("langs", pa.list_(pa.string())),
        ("counts", pa.list_(pa.int32())),
        ("codes", pa.binary()),
        ("starts", pa.binary()),
    ]
)
_ONES_SQL = "block long, names array<long>, words array<string>, langs array<string>, counts array<int>, codes binary, starts binary"
_KEYS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_KEPT = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary())])
_LONGER = pa.schema([("block", pa.int64()), ("names", pa.list_(pa.int64())), ("codes", pa.binary()), ("starts", pa.binary()), ("at", pa.binary())])


def _packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers of 31 bits, rising ones by their steps, compressed."""
    values = np.diff(values, prepend=0) if rising else values
    return len(values).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(values.astype(np.int32).tobytes(), asbytes=True)


def _unpacked(data: bytes, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    values = np.frombuffer(pa.Codec("zstd").decompress(data[4:], 4 * n, asbytes=True), np.int32)
    return np.cumsum(values) if rising else values


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of a UTF-8 buffer as strings."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at])))


def _lists(*columns: list) -> list[pa.Array]:
    """One list each, as a column of one row."""
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]


@gives_back
def _ones(batches: Iterator[pa.RecordBatch], salt: int, block_bytes: int, scan_bytes: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Blocks of R_1. A word's name is a hash of language, word and salt.

    A scan takes some eighty bytes for one of text, so a block is scanned in parts of ``scan_bytes``.
    """
    number = TaskContext.get().partitionId() << 32
    for rows in slices(batches, "text", block_bytes):
        parts = [x for x in (_scanned(part, salt) for part in cut(rows, "text", scan_bytes)) if x]
        if not parts:
            continue
        listed, text, lang, often, places, new = zip(*parts, strict=True)
        known, first, merged = np.unique(np.concatenate(listed), return_index=True, return_inverse=True)
        counts = np.bincount(merged, np.concatenate(often)).astype(np.int32)
        order = np.argsort(-counts, kind="stable")
        merged = np.argsort(order).astype(np.int32)[merged]
        ends = np.cumsum([len(x) for x in listed])
        codes = np.concatenate([merged[end - len(x) : end][at] for x, at, end in zip(listed, places, ends, strict=True)])
        first = pa.array(first[order])
        yield batch(_ONES, [number], *_lists(known[order].view(np.int64), pa.concat_arrays(text).take(first), pa.concat_arrays(lang).take(first), counts[order]), [_packed(codes)], [_packed(np.flatnonzero(np.concatenate(new)), True)])
        number += 1


def _scanned(rows: pa.RecordBatch, salt: int) -> tuple | None:
    """The distinct words of whole texts: names, texts, languages and counts; and of each word in order its
    place among them, and whether it begins a piece."""
    data, offsets = buffers(rows.column("text"))
    starts, ends, row = words(data, offsets, _APART)
    if not len(starts):
        return None
    langs = rows.column("lang").dictionary_encode()
    lang_names = _exact(*buffers(langs.dictionary))
    lang_of = langs.indices.to_numpy()[row]
    names = mix((span_hashes(LOWER_VALUES[data], starts, ends) ^ np.uint64(salt)) * _ODD + lang_names[lang_of])
    known, first, places, counts = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
    ended = np.cumsum(_PIECE_END[data])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (row[1:] != row[:-1]) | (ended[1:] != ended[:-1])
    text = _gather(LOWER[data], starts[first], ends[first])
    return known, text, langs.dictionary.take(pa.array(lang_of[first])), counts, places.astype(np.int32), new


def _exact(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes of whole strings, upper and lower case apart."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)[data]
    return span_hashes(values, offsets[:-1], offsets[1:]) if len(data) else np.zeros(len(offsets) - 1, np.uint64)


def _names(rows: pa.RecordBatch, k: int) -> np.ndarray:
    return rows.column("names")[k].values.to_numpy(zero_copy_only=False)


def _codes(rows: pa.RecordBatch, k: int) -> np.ndarray:
    return _unpacked(rows.column("codes")[k].as_py())


def _rising(rows: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return _unpacked(rows.column(name)[k].as_py(), True)


def _phrases(rows: pa.RecordBatch, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of a length begin in a block, and its words: R_(length - 1) merged with itself by piece
    and adjacent position, for pairs R_1 with R_1."""
    codes = _codes(rows, k)
    piece = np.zeros(len(codes), np.int32)
    piece[_rising(rows, "starts", k)] = 1
    piece = np.cumsum(piece)
    if length == 2:
        at = np.flatnonzero(piece[1:] == piece[:-1])
    else:
        before = _rising(rows, "at", k)
        follows = np.flatnonzero(before[1:] == before[:-1] + 1)
        at = before[follows]
        at = at[piece[at] == piece[at + length - 1]]
    return at, codes


def _hashed(names: np.ndarray, codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    held = names.view(np.uint64)
    out = held[codes[at]]
    for j in range(1, length):
        out = mix(out * _ODD + held[codes[at + j]])
    return out


@gives_back
def _keys(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """For each block and bucket the distinct 32-bit keys of its phrases and their counts, 255 at most."""
    for rows in batches:
        for k in range(rows.num_rows):
            at, codes = _phrases(rows, k, length)
            if not len(at):
                continue
            hashed = _hashed(_names(rows, k), codes, at, length)
            whole = ((hashed >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (hashed & np.uint64(0xFFFFFFFF))
            whole, counts = np.unique(whole, return_counts=True)
            bucket = (whole >> np.uint64(32)).astype(np.int64)
            found, first = np.unique(bucket, return_index=True)
            ends = np.append(first[1:], len(whole))
            low, few = whole.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
            block = rows.column("block")[k].as_py()
            yield batch(_KEYS, found.astype(np.int32), [block] * len(found), [low[a:b].tobytes() for a, b in zip(first, ends, strict=True)], [few[a:b].tobytes() for a, b in zip(first, ends, strict=True)])


@gives_back
def _frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of each bucket, which come one after another, the keys that reach ``least`` over all blocks, back to their blocks."""
    held: list[tuple[int, bytes, bytes]] = []
    now = None

    def close() -> Iterator[pa.RecordBatch]:
        keys = np.frombuffer(b"".join(x[1] for x in held), np.uint32)
        counts = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=np.uint32(0)) != 0)
        if len(order) and (not len(first) or first[0] != 0):
            first = np.insert(first, 0, 0)
        often = np.add.reduceat(counts[order].astype(np.int64), first) >= min(least, 255)
        kept = np.zeros(len(keys), bool)
        kept[order] = np.repeat(often, np.diff(np.append(first, len(keys))))
        at = 0
        for block, x, _ in held:
            part = slice(at, at + len(x) // 4)
            at = part.stop
            if kept[part].any():
                yield batch(_KEPT, [block], [now], [keys[part][kept[part]].tobytes()])

    for rows in batches:
        for at in range(0, rows.num_rows, 64):  # else a batch lies here twice
            for bucket, block, keys, counts in zip(*(rows.column(c).slice(at, 64).to_pylist() for c in _KEYS.names), strict=True):
                if bucket != now and held:
                    yield from close()
                    held = []
                now = bucket
                held.append((block, keys, counts))
    if held:
        yield from close()


@gives_back
def _reduced(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """R_length: a block's phrases among the frequent keys; words that are in none of them go."""
    for rows in batches:
        for k in range(rows.num_rows):
            kept = [np.frombuffer(x["keys"].as_py(), np.uint32).astype(np.uint64) | np.uint64(x["bucket"].as_py() << 32) for x in rows.column("kept")[k]]
            kept = np.sort(np.concatenate(kept))
            at, codes = _phrases(rows, k, length)
            names = _names(rows, k)
            hashed = _hashed(names, codes, at, length)
            whole = ((hashed >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (hashed & np.uint64(0xFFFFFFFF))
            place = np.minimum(np.searchsorted(kept, whole), len(kept) - 1)
            at = at[kept[place] == whole]
            needed = np.zeros(len(codes) + 1, bool)
            for j in range(length):
                needed[at + j] = True
            needed = needed[:-1]
            # a piece's kept words may lie apart: each run of them begins a piece of its own
            starts = np.zeros(len(codes), bool)
            starts[_rising(rows, "starts", k)] = True
            starts[1:] |= needed[1:] & ~needed[:-1]
            new = np.cumsum(needed) - 1
            used, again = np.unique(codes[needed], return_inverse=True)
            yield batch(_LONGER, [rows.column("block")[k].as_py()], *_lists(names[used]), [_packed(again)], [_packed(np.flatnonzero(starts[needed]), True)], [_packed(new[at], True)])


@gives_back
def _groups(batches: Iterator[pa.RecordBatch], length: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Words' names and n: a block's distinct phrases of R_length, and of those that are one word longer
    where these are the ``longest``; shorter ones end in nulls."""
    schema = pa.schema([*((f"w{j}", pa.int64()) for j in range(longest)), ("n", pa.int64())])
    for rows in batches:
        for k in range(rows.num_rows):
            names, codes = _names(rows, k), _codes(rows, k)
            sets = [(length, _rising(rows, "at", k))]
            if length + 1 == longest:
                sets.append((longest, _phrases(rows, k, longest)[0]))
            for size, at in sets:
                if not len(at):
                    continue
                at = at[np.argsort(_hashed(names, codes, at, size), kind="stable")]
                # two phrases of one hash stand apart, each perhaps in several runs
                new = np.zeros(len(at), bool)
                new[0] = True
                for j in range(size):
                    word = codes[at + j]
                    new[1:] |= word[1:] != word[:-1]
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(at)))
                for x in range(0, len(first), 1 << 16):
                    held = at[first[x : x + (1 << 16)]]
                    none = [pa.nulls(len(held), pa.int64())] * (longest - size)
                    yield batch(schema, *(pa.array(names[codes[held + j]]) for j in range(size)), *none, n[x : x + len(held)])


def _counted(relation: DataFrame, length: int, longest: int, least: int) -> DataFrame:
    ws = [f"w{j}" for j in range(longest)]
    groups = relation.mapInArrow(lambda x: _groups(x, length, longest), ", ".join(f"{w} long" for w in [*ws, "n"]))
    counted = groups.groupBy(*ws).agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return counted.select(F.filter(F.array(*ws), lambda w: w.isNotNull()).alias("name"), "a")


def occurrences(docs: DataFrame, block_bytes: int = 1 << 22, salt: int = 0) -> DataFrame:
    """R_1 in blocks of about ``block_bytes`` of text: its distinct words with their languages, counts and
    hashed names, the words of its pieces in order as places in that list, and where each piece starts."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return texts.mapInArrow(lambda x: _ones(x, salt, block_bytes), _ONES_SQL)


def mine(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, most: int = 2000, block_bytes: int = 1 << 22, bucket_keys: int = 1 << 21) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``most`` first collocations.

    A candidate is a phrase of 2 to ``longest`` words within a piece that occurs ``least`` times or more;
    ``a`` counts it, ``l`` and ``r`` the parts of its weakest cut, ``n`` all words of the language, and
    ``score`` is floor(1000000 a a / (l r)) there, in 38-digit numbers. One that a longer candidate holds
    with at least ``inside`` percent of its occurrences goes.

    Before R_k is extended, keys of its phrases (a bucket and 32 bits) are counted over all blocks, and
    phrases of rare keys go. Two phrases may share a key, so some rare ones stay; the exact counts that
    follow are by the words' names, so none is wrongly counted or lost. Words' names are 64-bit hashes;
    if two words of a language share one, all is named anew with another salt.

    A null text is empty, a null language ``und``; repeated rows count each; ids and other columns are
    not read; a tie of rank goes by phrase, which is unique; an empty table gives an empty one. A block
    holds whole texts, so a very long text makes a block of its own.
    """
    salt = 0
    while True:
        ones = materialize(occurrences(docs, block_bytes, salt), "occurrences")
        listed = ones.select(F.inline(F.arrays_zip("names", "langs", "words", "counts")))
        listed = listed.groupBy("names", "langs", "words").agg(F.sum("counts").alias("f"))
        vocabulary = materialize(listed, "words")
        if vocabulary.groupBy("names").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
        discard(ones, vocabulary)
        salt += 1
    sizes = materialize(vocabulary.groupBy(F.col("langs").alias("lang")).agg(F.sum("f").alias("n")), "langs")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    frequent = materialize(vocabulary.where(F.col("f") >= least), "frequent")
    discard(vocabulary)
    counts = [frequent.select(F.array("names").alias("name"), F.col("f").alias("a"))]
    relation, buckets, written = ones.select("block", "names", "codes", "starts"), max(16, -(-total // bucket_keys)), [ones]
    for length in range(2, max(3, longest)):
        before = relation
        keys = before.mapInArrow(lambda x, k=length: _keys(x, k, buckets), "bucket int, block long, keys binary, counts binary")
        kept = keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda x: _frequent(x, least), "block long, bucket int, keys binary")
        kept = kept.groupBy("block").agg(F.collect_list(F.struct("bucket", "keys")).alias("kept"))
        joined = before.join(kept, "block")
        relation = materialize(joined.mapInArrow(lambda x, k=length: _reduced(x, k, buckets), "block long, names array<long>, codes binary, starts binary, at binary"), f"phrases{length}")
        discard(written.pop())
        written.append(relation)
        counts.append(materialize(_counted(relation, length, longest, least), f"counts{length}"))
    every = counts[0]
    for x in counts[1:]:
        every = every.unionByName(x)
    discard(*written)
    return _ranked(every, frequent, sizes, longest, inside, most)


def _ranked(groups: DataFrame, frequent: DataFrame, sizes: DataFrame, longest: int, inside: int, most: int) -> DataFrame:
    """The first candidates of each language, from all frequent groups."""
    size = F.size("name")
    candidates = groups.where((size > 1) & (size <= longest))
    shorter = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda at: F.slice("name", at, k))))
    above = candidates.where(size > 2).select(F.explode(shorter).alias("name"), F.col("a").alias("more")).groupBy("name").agg(F.max("more").alias("more"))
    open_ = candidates.join(above, "name", "left").where((F.coalesce("more", F.lit(0)) * 100 < F.col("a") * inside)).drop("more")
    open_ = materialize(open_, "candidates")
    cuts = open_.select("name", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    sides = F.array(F.struct(F.lit("l").alias("side"), F.slice("name", F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), F.slice("name", F.col("k") + 1, size - F.col("k")).alias("part")))
    halves = spread_join(cuts.select("*", F.inline(sides)), groups.select(F.col("name").alias("part"), F.col("a").alias("often")), "part", "name")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("often"))).alias(side)
    cuts = halves.groupBy("name", "a", "k").agg(of("l"), of("r"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("top", F.lit(1000000).cast("decimal(7,0)") * wide("a") * wide("a")).withColumn("low", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("top div low"))
    scored = cuts.groupBy("name", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("name", "a", "cut.score", "cut.l", "cut.r")
    scored = materialize(scored, "scores")
    parts = scored.select("*", F.posexplode("name").alias("place", "names"))
    parts = spread_join(parts, frequent.select("names", F.col("langs").alias("lang"), F.col("words").alias("word")), "names", "name")
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ")
    named = parts.groupBy("name", "a", "score", "l", "r", "lang").agg(phrase.alias("phrase"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language's first are among the first of its parts, so that one task sees no more than 64 * most rows
    dealt = named.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(64)))
    near = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return first.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
