"""Packing documents into training sequences by lexical retrieval."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._support import LOWER, LOWER_VALUES, buffers, id_text, materialize, slices, span_hashes

#: Okapi BM25's usual constants.
K1, B = 1.2, 0.75
_IDS = 1 << 16

# Bytes of text that is cut into words here, as the tokenizer would: it composes and lower-cases
# characters, and takes contractions, runs of letters, single digits and runs of other signs. Beyond
# ASCII only the letters from U+00C0 to U+00FF are known, whose first byte is C3.
_SPACE, _LETTER, _DIGIT, _SIGN, _UNKNOWN = range(5)
_KIND = np.full(256, _UNKNOWN, np.uint8)
_KIND[32:127] = _SIGN
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[0x80:0xC0] = _KIND[0xC3] = _LETTER
_LONGEST = 512  # bytes of a word; texts with longer ones go to the tokenizer whole


def _words_of(data: np.ndarray, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's words in the texts of a buffer."""
    kind = _KIND[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    first = edge.copy()
    edge[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(data))
    word = kind[start] != _SPACE
    start, end = start[word], end[word]
    # an apostrophe alone takes up s, t, m, d, re, ve or ll after it
    at = np.flatnonzero((low[start[:-1]] == 39) & (end[:-1] - start[:-1] == 1) & (end[:-1] == start[1:]) & ~first[start[1:]])
    if len(at):
        a = low[start[at + 1]]
        b = np.where(end[at + 1] - start[at + 1] > 1, low[np.minimum(start[at + 1] + 1, len(low) - 1)], 0)
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        two = (a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108)
        more = np.where(one, 1, np.where(two, 2, 0))
        end[at] += more
        start[at + 1] += more
        some = start < end
        start, end = start[some], end[some]
    return start, end


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose words don't influence each other.

    ``path``: a file of the ``tokenizers`` library, ids below 65536. Texts are cut into words by array
    operations; a word's ids are looked up by its hash in a table of two places a word, and what
    isn't there is encoded once. Texts with other characters than ``_KIND`` knows, with very long
    words, or with a special token's string go to the tokenizer whole.
    """

    def __init__(self, path: str, places: int = 1 << 20, most_ids: int = 1 << 22):
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.final = np.zeros(_IDS, bool)
        self.final[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        self.places, self.most_ids = places, most_ids
        self._forget()

    def _forget(self) -> None:
        self.hash = np.zeros(self.places, np.uint64)
        self.first = np.zeros(self.places, np.int32)
        self.size = np.zeros(self.places, np.int32)
        self.pool, self.used = np.zeros(1 << 16, "<u2"), 0

    def _add(self, ids: np.ndarray) -> int:
        """Keep ids; where they lie."""
        at = self.used
        while at + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids lie, and how many they are: encoded parted by blanks, and cut after each that ends a word."""
        first, size = [], []
        for at in range(0, len(words), 2048):
            part = words[at : at + 2048]
            ids = np.array(self.whole.encode(" ".join(part), add_special_tokens=False).ids, "<u2")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(part):
                each = [np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u2") for w in part]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            begin = np.append(0, ends[:-1])
            first.append(self._add(ids) + begin)
            size.append(ends - begin)
        return np.concatenate(first), np.concatenate(size)

    def _look_up(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = span_hashes(LOWER_VALUES[low], start, end)
        mask = np.uint64(self.places - 1)
        one, two = (hashes >> np.uint64(40) & mask).astype(np.int64), (hashes >> np.uint64(8) & mask).astype(np.int64)
        place = np.where(self.hash[one] == hashes, one, two)
        first, size = self.first[place], self.size[place]
        new = np.flatnonzero(self.hash[place] != hashes)
        if len(new):
            known, at, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            raw, at = low.tobytes(), new[at]
            f, n = self._encoded([raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            place = np.where(self.hash[one[at]] == 0, one[at], np.where(self.hash[two[at]] == 0, two[at], one[at]))
            self.hash[place] = known
            self.first[place], self.size[place] = f, n
            first[new], size[new] = f[back], n[back]
        return first, size

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 16-bit ids of all texts, ``end_id`` after each, and where each text's begin and end."""
        if self.used > self.most_ids:
            self._forget()
        data, offsets = buffers(texts)
        n = len(texts)
        low = LOWER[data]
        high = np.flatnonzero(data == 0xC3)
        high = high[high + 1 < len(data)]
        small = high[(data[high + 1] >= 0x80) & (data[high + 1] <= 0x9E)] + 1
        low[small] += 32
        odd = np.append(np.flatnonzero(_KIND[data] == _UNKNOWN), high[np.isin(data[high + 1], (0x97, 0xB7))])
        start, end = _words_of(data, low, offsets) if len(data) else (np.zeros(0, np.int64),) * 2
        odd = [odd, start[end - start > _LONGEST]]
        raw = low.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                odd.append(np.array([at]))
                at = raw.find(s, at + 1)
        whole = np.unique(np.searchsorted(offsets, np.concatenate(odd), "right") - 1)
        bounds = np.searchsorted(start, offsets)
        if len(whole):
            use = np.ones(n, bool)
            use[whole] = False
            keep = np.repeat(use, np.diff(bounds))
            start, end = start[keep], end[keep]
            bounds = np.append(0, np.cumsum(np.where(use, np.diff(bounds), 0)))
        first, size = self._look_up(low, start, end) if len(start) else (np.zeros(0, np.int32),) * 2
        # an end behind each text, and texts encoded whole as if they were words
        used = self.used
        marks = [self._add(np.array([end_id], "<u2"))] * n
        lengths = [1] * n
        for k in whole.tolist():
            ids = self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids
            marks[k], lengths[k] = self._add(np.array([*ids, end_id], "<u2")), len(ids) + 1
        first, size = np.insert(first.astype(np.int64), bounds[1:], marks), np.insert(size.astype(np.int64), bounds[1:], lengths)
        ends = np.cumsum(size)
        out = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]
        self.used = used
        return out, np.append(0, ends)[bounds + np.arange(n + 1)]


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process, which keeps the words that it has met."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


@dataclass(frozen=True)
class Corpus:
    """What BM25 takes from all documents: how many they are, their mean length, each token's document frequency."""

    n: int
    mean: float
    df: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5)).astype(np.float32)

    def norm(self, lengths: np.ndarray) -> np.ndarray:
        return (K1 * (1 - B + B * lengths / self.mean)).astype(np.float32)


def _counted(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token and count of the distinct tokens of each row, in order."""
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint32), np.diff(bounds))
    pairs = np.sort(row << np.uint32(16) | ids) if len(bounds) <= _IDS else np.sort(row.astype(np.uint64) << np.uint64(16) | ids)
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    token = (pairs[first] & pairs.dtype.type(_IDS - 1)).astype(np.int64)
    return (pairs[first] >> pairs.dtype.type(16)).astype(np.int64), token, np.diff(np.append(first, len(pairs)))


_TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.list_(pa.int64()))])
_TOKENS_DDL = "doc_id long, ids binary, counts array<long>"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids, counts): each text's ids, little-endian unsigned 16-bit; beside them a row for each
    task, without ids, whose ``counts`` are 65536 document frequencies, then rows and tokens in sum."""
    texts = id_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        encode, counts = word_tokenizer(tokenizer), np.zeros(_IDS + 2, np.int64)
        for x in slices(batches):
            ids, bounds = encode(x.column("text"), end_id)
            counts[:_IDS] += np.bincount(_counted(ids, bounds)[1], minlength=_IDS)
            counts[_IDS:] += x.num_rows, len(ids)
            none = pa.nulls(x.num_rows, _TOKENS.types[2])
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), _binary(ids, bounds), none], schema=_TOKENS)
        if counts.any():
            last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], _TOKENS.types[2])]
            yield pa.RecordBatch.from_arrays(last, schema=_TOKENS)

    return texts.mapInArrow(run, _TOKENS_DDL)


def _binary(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The ids of each row as bytes."""
    size = ids.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(ids)])


def corpus_of(tokens: DataFrame) -> Corpus:
    """Sums of the tasks' counts: a row for each token is collected, 65536 at most."""
    each = tokens.where("counts is not null").select(F.posexplode("counts").alias("token", "n")).where("n > 0")
    df = np.zeros(_IDS + 2, np.int64)
    for r in each.groupBy("token").agg(F.sum("n").alias("n")).collect():
        df[r.token] = r.n
    return Corpus(int(df[_IDS]), float(df[_IDS + 1] / max(df[_IDS], 1)), df[:_IDS])


def content_keys(ids: np.ndarray, bounds: np.ndarray, corpus: Corpus, idf: np.ndarray) -> np.ndarray:
    """Tokens by which each document's lexical neighbours sort beside it, as a row of unsigned numbers.

    Of the tokens that a third of the documents have, or more, its weightiest; then of those that a
    ninth have, and so on; last the weightiest that another document has. Each token splits the
    documents that agree in those before it. Zero stands for none, else a token's id and one.
    """
    row, token, tf = _counted(ids, bounds)
    part = idf[token] * tf / (tf + corpus.norm(np.diff(bounds))[row])
    df = corpus.df[token]
    levels, least = [], corpus.n / 3
    while least >= 32:
        levels.append(least)
        least /= 3
    out = np.zeros((len(bounds) - 1, len(levels) + 1), np.uint32)
    for k, least in enumerate((*levels, 2)):
        at = np.flatnonzero(df >= least)
        if len(at):
            r, p = row[at], part[at]
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            best = np.repeat(np.maximum.reduceat(p, first), np.diff(np.append(first, len(r))))
            hit = at[p == best]
            hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])]
            out[row[hit], k] = token[hit] + 1
    return out


class _Bm25:
    """Postings of a shard's documents: by token, the documents and each one's part of a score.

    Weights are those of ``corpus``, or of these documents where none is given.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, corpus: Corpus | None = None):
        n, lengths = len(bounds) - 1, np.diff(bounds)
        doc, token, tf = _counted(ids, bounds)
        df = np.bincount(token, minlength=_IDS)
        corpus = corpus or Corpus(n, float(lengths.mean()), df)
        part = corpus.idf()[token] * tf * np.float32(K1 + 1) / (tf + corpus.norm(lengths)[doc])
        self.n, self.token, self.own = n, token, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(token, kind="stable")
        # in the types that are summed, so that no seed's lists have to be converted
        self.doc, self.part, self.first = doc[order].astype(np.intp), part[order].astype(float), np.append(0, np.cumsum(df))
        self.held = n

    def scores(self, seed: int, unused: np.ndarray | None = None) -> np.ndarray:
        """Of every document for all tokens of the seed.

        With ``unused``, a mask from which documents only go: at least of those in it. The lists are
        rid of the others whenever a quarter of their documents have gone.
        """
        if unused is not None and 4 * (left := np.count_nonzero(unused)) <= 3 * self.held:
            keep = unused[self.doc]
            self.first = np.append(0, np.cumsum(keep))[self.first]
            self.doc, self.part, self.held = self.doc[keep], self.part[keep], left
        terms = self.token[self.own[seed] : self.own[seed + 1]]
        lists = [slice(a, b) for a, b in zip(self.first[terms].tolist(), self.first[terms + 1].tolist(), strict=True) if a < b]
        if not lists:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[x] for x in lists]), np.concatenate([self.part[x] for x in lists]), self.n)


def _ranked(scores: np.ndarray):
    """Documents of positive score, best first, ties by place."""
    some = np.flatnonzero(scores > 0)
    if len(some) > 64:
        cut = np.partition(scores[some], len(some) - 64)[len(some) - 64]
        yield from (head := some[scores[some] >= cut])[np.argsort(-scores[head], kind="stable")].tolist()
        some = some[scores[some] < cut]
    yield from some[np.argsort(-scores[some], kind="stable")].tolist()


def pack_shard(lengths: np.ndarray, scores, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each document's tokens once.

    ``scores(seed, unused)`` ranks at least the unused documents for a seed. Full windows of one document come first; what
    is left of it then seeds or fills others. The document that no longer fits whole is cut at the
    window's end, and its rest seeds the next window. Only the last window may lack tokens: it is
    cut into sequences whose lengths are powers of two.
    """
    pieces, sequence = [], 0
    begin = np.zeros(len(lengths), np.int64)
    for doc in np.flatnonzero(lengths >= window).tolist():
        for start in range(0, int(lengths[doc]) // window * window, window):
            pieces.append((doc, start, window, sequence, 0))
            sequence += 1
        begin[doc] = int(lengths[doc]) // window * window
    unused = begin < lengths
    in_order = iter(np.flatnonzero(unused).tolist())
    seed, current, used = None, [], 0

    def take(doc: int) -> int | None:
        """Put the document's rest into the window; give it back if part of it stays out."""
        nonlocal used
        n = min(int(lengths[doc] - begin[doc]), window - used)
        current.append((doc, int(begin[doc]), n, used))
        begin[doc] += n
        used += n
        unused[doc] = False
        return doc if begin[doc] < lengths[doc] else None

    while True:
        if seed is None:
            seed = next((d for d in in_order if unused[d]), None)
            if seed is None:
                break
        query, seed = seed, None
        rest = take(query)
        if used < window and unused.any():
            for doc in _ranked(np.where(unused, scores(query, unused), 0.0)):
                rest = take(doc)
                if used == window:
                    break
            while used < window and (doc := next((d for d in in_order if unused[d]), None)) is not None:
                rest = take(doc)
        if used == window:
            pieces += [(d, s, n, sequence, o) for d, s, n, o in current]
            sequence, current, used, seed = sequence + 1, [], 0, rest
    at, end = 0, 0  # the last window, in powers of two
    for power in (1 << k for k in reversed(range(window.bit_length()))):
        if used & power:
            end = at + power
            for d, s, n, o in current:
                a, b = max(o, at), min(o + n, end)
                if a < b:
                    pieces.append((d, s + a - o, b - a, sequence, a - at))
            sequence, at = sequence + 1, end
    return pieces


_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)
_PIECES_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _packed(rows: list[tuple], corpus: Corpus, window: int, sequence: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of a shard's (doc_id, ids), and the number after its last sequence."""
    ids = np.concatenate([np.frombuffer(r[1], "<u2") for r in rows])
    lengths = np.array([len(r[1]) // 2 for r in rows])
    bounds = np.append(0, np.cumsum(lengths))
    pieces = pack_shard(lengths, _Bm25(ids, bounds, corpus).scores, window)
    doc, start, length, place, offset = np.array(pieces, np.int64).T
    each = [ids[a : a + n].astype("<u4").tobytes() for a, n in zip((bounds[doc] + start).tolist(), length.tolist(), strict=True)]
    ids_of = pa.array([r[0] for r in rows], pa.int64()).take(pa.array(doc))
    columns = [ids_of, *map(pa.array, (start, length, lengths[doc], place + sequence, offset)), pa.array(each, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=_PIECES), sequence + int(place.max()) + 1


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, rows_per_shard: int = 4096, tokens_per_shard: int = 1 << 22
) -> DataFrame:
    """Every document's ids and ``end_id``, in pieces of sequences of at most ``window`` tokens.

    Documents are dealt into ranges by content (see ``content_keys``), and each range is cut into
    shards of at most ``rows_per_shard`` documents and about ``tokens_per_shard`` tokens. So a shard's
    index has the same size however large the corpus is, and copies and texts of one topic share it;
    neighbours in other shards aren't sought. In a shard, a BM25 inverted index over token ids,
    weighted by all documents, returns the unused neighbours of each seed, best first, by all its
    tokens; they fill its window (see ``pack_shard``). ``tokenizer``: see ``WordTokenizer``.
    ``ids`` has a piece's ids, little-endian unsigned 32-bit. A null or empty text has ``end_id``
    alone; a very long one fills windows of its own first; repeated rows are packed each; ties are
    broken by doc_id, then by the ids; an empty table gives no pieces.
    """
    known = materialize(tokenized(docs, tokenizer, end_id), "tokens")
    corpus = corpus_of(known)

    def keys(batches):
        idf = corpus.idf()
        for x in slices(batches, "ids"):
            data, bounds = buffers(x.column("ids"))
            found = content_keys(data.view("<u2"), bounds // 2, corpus, idf).astype(">u4")
            width = 4 * found.shape[1]
            place = _binary(found.view(np.uint8).ravel(), np.arange(x.num_rows + 1) * width)
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("ids"), place], names=["doc_id", "ids", "place"])

    def place(batches):
        sequence, held, tokens = TaskContext.get().partitionId() << 40, [], 0

        def shards(parts: int):
            nonlocal sequence, held, tokens
            cut = len(held) // parts
            out, sequence = _packed(held[:cut], corpus, window, sequence)
            held = held[cut:]
            tokens = sum(len(r[1]) for r in held) // 2
            return out

        for x in batches:
            for row in zip(x.column("doc_id").to_pylist(), x.column("ids").to_pylist(), strict=True):
                held.append(row)
                tokens += len(row[1]) // 2
                while len(held) >= 2 * rows_per_shard or tokens >= 2 * tokens_per_shard and len(held) > 1:
                    yield shards(2)
        if len(held) > rows_per_shard:
            yield shards(2)
        if held:
            yield shards(1)

    rows = known.where("ids is not null").select("doc_id", "ids")
    order = ("place", "doc_id", F.xxhash64("ids"))
    keyed = rows.mapInArrow(keys, "doc_id long, ids binary, place binary")
    ranges = max(1, min(-(-corpus.n // rows_per_shard), max(4096, int(corpus.n * corpus.mean) >> 26)))
    sorted_ = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "ids")
    return sorted_.select("doc_id", "ids").mapInArrow(place, _PIECES_DDL)
