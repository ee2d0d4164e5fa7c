"""An n-gram language model as an Elias-Fano trie, built and queried by Spark tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import batch, id_text, shared_dir, slices, span_hashes, word_hashes
from .eliasfano import EliasFano, mapped, put

#: What absolute discounting takes from each count.
DISCOUNT = 0.75
#: Probabilities are kept as whole multiples of this in -log10, one byte each.
STEP = 0.04
#: The token that ends every text, and stands before its first word; no word hashes to it but by chance.
END = int(span_hashes(np.arange(1, 4, dtype=np.uint64), np.array([0]), np.array([3]))[0])
_BLOCK = 4 << 20
_SLICE = 4 << 20  # larger slices look up a repeated n-gram less often


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log10(np.maximum(p, 1e-300)) / -STEP), 0, 255).astype(np.uint8)


_PROBABILITY = 10.0 ** (np.arange(256) * -STEP)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _packed(values: np.ndarray) -> bytes:
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if int(values.max(initial=0)) <= np.iinfo(t).max)
    planes = values.astype(kind).view(np.uint8).reshape(-1, kind().itemsize).T
    return bytes([kind().itemsize]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").ravel().astype(np.uint64)


_BLOCKS = pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


class _Counter:
    """Counts of a task's keys. Sorted blocks leave it, one for each shard, when it holds many."""

    def __init__(self, shards: list[int]):
        self.least = np.array(shards, np.uint64)  # of each shard's keys
        self.keys, self.counts, self.n = [], [], 0

    def add(self, keys: np.ndarray):
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c.astype(np.uint64))
        self.n += len(k)
        if self.n > _BLOCK:
            yield from self.blocks()

    def blocks(self):
        if not self.n:
            return
        k, c = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.n = [], [], 0
        ends = np.append(np.searchsorted(k, self.least[1:], "left"), len(k))
        at = 0
        for shard, end in enumerate(ends.tolist()):
            if end > at:
                deltas = np.diff(k[at:end], prepend=self.least[shard : shard + 1])
                yield batch(_BLOCKS, [shard], [_packed(deltas)], [_packed(c[at:end])])
            at = end


def _merged(table: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.cumsum(_unpacked(x.as_py()), dtype=np.uint64) + np.uint64(least) for x in table.column("keys")]
    counts = [_unpacked(x.as_py()) for x in table.column("counts")]
    return _summed(np.concatenate(keys), np.concatenate(counts))


@dataclass
class NGramModel:
    """Where the trie lies and how it is divided. ``least[k]``: the least key of each shard of
    level k; ``rank[k]``: the rank of each shard's first entry; ``parent[k]``: of its first parent."""

    path: str
    order: int
    tokens: int
    distinct: int
    least: list[list[int]]
    rank: list[list[int]]
    parent: list[list[int]]

    def _file(self, level: int, shard: int) -> dict[str, np.ndarray]:
        return mapped(f"{self.path}/level{level}/shard{shard}.arrays")

    def _by_shard(self, level: int, keys: np.ndarray):
        ends = np.append(np.searchsorted(keys, np.array(self.least[level][1:], np.uint64), "left"), len(keys))
        at = 0
        for shard, end in enumerate(ends.tolist()):
            if end > at and self.rank[level][shard + 1] > self.rank[level][shard]:
                yield shard, slice(at, end)
            at = end

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1: unknown) and count of each word."""
        keys, back = np.unique(hashes, return_inverse=True)
        ranks, counts = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for shard, part in self._by_shard(0, keys):
            arrays = self._file(0, shard)
            found = EliasFano.of(arrays, "ids").find(keys[part] - np.uint64(self.least[0][shard]))
            known = found >= 0
            ranks[part] = np.where(known, found + self.rank[0][shard], -1)
            counts[part] = np.where(known, arrays["count"][found], 0)
        return ranks[back], counts[back]

    def successors(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words after contexts (-1: unknown): rank or -1, discounted relative frequency, and
        the mass that the context leaves to shorter ones (1 for an unknown context)."""
        rank, share, left = np.full(len(word), -1), np.zeros(len(word)), np.ones(len(word))
        some = np.flatnonzero(context >= 0)
        # an unknown word looks up nothing, yet its context's mass counts
        keys, back = np.unique(context[some].astype(np.uint64) * np.uint64(self.distinct + 1) + (word[some] + 1).astype(np.uint64), return_inverse=True)
        r, s, m = np.full(len(keys), -1), np.zeros(len(keys)), np.ones(len(keys))
        parents = keys // np.uint64(self.distinct + 1)
        for shard, part in self._by_shard(level, keys):
            arrays = self._file(level, shard)
            own = (parents[part] - np.uint64(self.parent[level][shard])).astype(np.int64)
            m[part] = _PROBABILITY[arrays["left"][own]]
            each, at = np.unique(own, return_inverse=True)
            pointers = EliasFano.of(arrays, "pointers")
            begin, end = pointers[each].astype(np.int64), pointers[each + 1].astype(np.int64)
            found = EliasFano.of(arrays, "ids").find(keys[part] - np.uint64(self.least[level][shard]), begin[at], end[at])
            hit = found >= 0
            r[part] = np.where(hit, found + self.rank[level][shard], -1)
            s[part] = np.where(hit, _PROBABILITY[arrays["share"][found]], 0.0)
        rank[some], share[some], left[some] = r[back], s[back], m[back]
        return rank, share, left

    def sequence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens of a block, ends included: rank, count, row, and whether a text starts."""
        hashes, rows = word_hashes(column)
        n = len(column)
        per = np.bincount(rows, minlength=n)
        all_hashes, all_rows = np.full(len(hashes) + n, END, np.uint64), np.repeat(np.arange(n), per + 1)
        all_hashes[np.arange(len(hashes)) + rows] = hashes
        starts = np.zeros(len(all_rows), bool)
        starts[np.cumsum(per + 1) - per - 1] = True
        return *self.words(all_hashes), all_rows, starts

    def contexts(self, column: pa.Array, level: int):
        """Tokens' ranks, counts and rows, with the (context, share, left) of each level up to ``level``."""
        ranks, counts, rows, starts = self.sequence(column)
        end = self.words(np.array([END], np.uint64))[0][0] if len(ranks) else -1
        context, out = np.where(starts, end, np.roll(ranks, 1)), []
        for k in range(1, level + 1):
            if k == level:
                out.append((context, None, None))
                break
            rank, share, left = self.successors(k, context, ranks)
            out.append((context, share, left))
            context = np.where(starts, -1, np.roll(rank, 1))
        return ranks, counts, rows, out


def _build(model: NGramModel, docs: DataFrame, level: int, shards: int) -> NGramModel:
    """Count the keys of a level, and write its shards."""
    size = model.distinct + 1
    if level == 0:
        least = [k << (64 - (shards - 1).bit_length()) for k in range(shards)] if shards > 1 else [0]
        parent = [0] * (shards + 1)
    else:
        parents = model.rank[level - 1][-1]
        if parents * size >= 1 << 64:
            raise ValueError(f"level {level}: {parents} contexts of {size} words don't fit keys of 64 bits")
        parent = [k * parents // shards for k in range(shards + 1)]
        least = [p * size for p in parent[:-1]]

    def count(batches):
        counter = _Counter(least)
        for x in slices(batches, most=_SLICE):
            column = x.column("text")
            if level == 0:
                hashes, _ = word_hashes(column)
                yield from counter.add(np.concatenate([hashes, np.full(len(column), END, np.uint64)]))
            else:
                ranks, _, _, found = model.contexts(column, level)
                context = found[-1][0]
                some = context >= 0
                yield from counter.add(context[some].astype(np.uint64) * np.uint64(size) + (ranks[some] + 1).astype(np.uint64))
        yield from counter.blocks()

    def write(key, table):
        shard = key[0].as_py()
        keys, counts = _merged(table, least[shard])
        relative = keys - np.uint64(least[shard])
        if level == 0:
            arrays = EliasFano.encode(relative, (least[shard + 1] if shard + 1 < shards else 1 << 64) - least[shard]).arrays("ids")
            arrays["count"] = counts.astype(np.uint32 if int(counts.max()) < 1 << 32 else np.uint64)
        else:
            n = parent[shard + 1] - parent[shard]
            own = (relative // np.uint64(size)).astype(np.int64)
            children = np.bincount(own, minlength=n)
            total = np.bincount(own, counts.astype(float), minlength=n)
            arrays = EliasFano.encode(relative, n * size).arrays("ids")
            arrays |= EliasFano.encode(np.append(0, np.cumsum(children)), len(keys) + 1).arrays("pointers")
            arrays["share"] = _quantised((counts.astype(float) - DISCOUNT) / total[own])
            arrays["left"] = _quantised(np.where(children > 0, DISCOUNT * children / np.maximum(total, 1), 1.0))
        put(f"{model.path}/level{level}/shard{shard}.arrays", arrays)
        return pa.table({"shard": [shard], "entries": [len(keys)], "tokens": [int(counts.sum())]}, schema=pa.schema([("shard", pa.int64()), ("entries", pa.int64()), ("tokens", pa.int64())]))

    blocks = docs.mapInArrow(count, "shard long, keys binary, counts binary")
    made = {r.shard: r for r in blocks.groupBy("shard").applyInArrow(write, "shard long, entries long, tokens long").collect()}
    rank = [0]
    for k in range(len(least)):
        rank.append(rank[-1] + (made[k].entries if k in made else 0))
    tokens = sum(r.tokens for r in made.values()) if level == 0 else model.tokens
    return NGramModel(model.path, model.order, tokens, rank[-1] if level == 0 else model.distinct, [*model.least, least], [*model.rank, rank], [*model.parent, parent])


def train(docs: DataFrame, order: int = 3, rows_per_shard: int = 8192) -> NGramModel:
    """Count the n-grams of all ``docs`` and write the trie to the shared folder.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A-Z as a-z, and one end for each text, which
    also stands before the first word. Level 0 has the words' hashes in order, a word's rank being
    its id; level k has the words that follow each entry of level k - 1, as one rising sequence of
    parent rank and word, with a pointer to each parent's first child. Shards divide levels by hash
    or by parent, in number as the documents. Null texts count as empty; without any row the model
    knows no words.
    """
    docs = id_text(docs).select("text")
    shards = 1 << max(0, (docs.count() // rows_per_shard)).bit_length()
    model = NGramModel(shared_dir(docs.sparkSession, "ngrams"), order, 0, 0, [], [], [])
    for level in range(order):
        model = _build(model, docs, level, shards)
    return model


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, model: NGramModel) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row.

    ``score``: log10 of the text's probability under absolute discounting, each order interpolated
    with the next shorter one, the words' own with an even share for words never seen. One byte
    holds each stored probability, so a token's is within 5 per cent. ``base_score``: the add-one
    unigram score. An empty or null text has the end token alone.
    """

    def run(batches):
        n, v = model.tokens, model.distinct
        for x in slices(batches, most=_SLICE):
            ranks, counts, rows, found = model.contexts(x.column("text"), model.order)
            p = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * v / (v + 1)) / n if n else np.ones(len(counts))
            for level, (context, share, left) in enumerate(found[: model.order - 1], 1):
                if share is None:
                    _, share, left = model.successors(level, context, ranks)
                p = share + left * p
            size = x.num_rows
            base = np.bincount(rows, np.log10((counts + 1) / (n + v + 1)), size)
            yield batch(_SCORES, x.column("doc_id"), np.bincount(rows, minlength=size), np.bincount(rows, counts > 0, size).astype(np.int64), base, np.bincount(rows, np.log10(p), size))

    return id_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
