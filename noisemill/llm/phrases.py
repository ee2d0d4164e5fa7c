"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._support import mix, span_hashes

#: Names of phrases from this level up go into a fingerprint; phrases there have about ten characters.
LEVEL = 2
BINS = 64
_LEVELS = 40
_EMPTY = 0xFFFF
_PIECE = 1 << 20
_MOST_RANGES = 100_000


def _tossed(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, neighbours different: deterministic coin tossing, four times over.

    Each round names a symbol by the lowest bit in which it differs from its left neighbour and by
    that bit's value; 64 bits become 7, then 4, 3 and a value below 6. Equal neighbourhoods of four
    symbols give equal labels. A text's first symbol has no neighbour and keeps its own low bit.
    """
    label = names
    for _ in range(4):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = label[first] ^ np.uint64(1)
        differ = label ^ left
        lowest = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        label = lowest * np.uint64(2) + (label >> lowest & np.uint64(1))
        # a first symbol's label may equal its right neighbour's; the text's start is a border anyway
    return label


def _phrases(symbols: np.ndarray, starts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """One level of the hierarchy: the phrases' names, and where each text's begin.

    Runs of one symbol become one name first. A phrase begins at each local maximum of the tossed
    labels, so after at most a dozen symbols, and at the start of each text.
    """
    n = len(symbols)
    first = np.zeros(n, bool)
    first[starts] = True
    run = first.copy()
    run[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(run)
    length = np.diff(np.append(at, n)).astype(np.uint64)
    names = np.where(length > 1, mix(symbols[at] + length * np.uint64(0x9E3779B97F4A7C15)), symbols[at])
    begins = first[at]
    label = _tossed(names, np.flatnonzero(begins)).astype(np.int8)
    peak = begins.copy()
    if len(label) > 2:
        peak[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~begins[2:]
    border = np.flatnonzero(peak)
    ends = np.append(border[1:], len(names))
    parts = span_hashes(names, border, ends)
    alone = ends - border == 1
    # a phrase of one symbol, at a text's start, still gets a name of its own
    parts = np.where(alone, mix(names[border] + np.uint64(level + 1)), parts)
    return parts, np.flatnonzero(begins[border])


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``BINS`` 16-bit values for each text, and how many phrases it stands for.

    Level by level the texts are parsed into phrases until one is left of each. The names from
    level ``LEVEL`` up, and the last name of a text that ends before, are a set; each bin keeps 16
    bits of the least name that falls into it. Unlike positions, names don't depend on the offset.
    """
    out = np.full((len(texts), BINS), _EMPTY, np.uint16)
    sizes = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= _PIECE):
            n += len(texts[end])
            end += 1
        part = texts[at:end]
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        symbols = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        owner = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[owner]
        symbols = mix(symbols + np.uint64(1))
        kept_names, kept_owner = [], []
        for level in range(1, _LEVELS):
            if not len(symbols):
                break
            symbols, starts = _phrases(symbols, starts, level)
            counts = np.diff(np.append(starts, len(symbols)))
            each = np.repeat(owner, counts)
            done = counts == 1
            keep = np.ones(len(symbols), bool) if level >= LEVEL else np.repeat(done, counts)
            kept_names.append(symbols[keep])
            kept_owner.append(each[keep])
            symbols = symbols[~np.repeat(done, counts)]
            owner, counts = owner[~done], counts[~done]
            starts = np.cumsum(counts) - counts
        if kept_names:
            names, whose = mix(np.concatenate(kept_names)), np.concatenate(kept_owner)
            bins = whose * BINS + (names >> np.uint64(58)).astype(np.int64)
            rest = names & np.uint64((1 << 58) - 1)
            order = np.lexsort((rest, bins))
            bins, rest = bins[order], rest[order]
            head = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
            value = (rest[head] & np.uint64(0xFFFF)).astype(np.uint16)
            value[value == _EMPTY] -= 1
            out[at + bins[head] // BINS, bins[head] % BINS] = value
            sizes[at:end] = np.bincount(whose, minlength=len(part))
        at = end
    return out, sizes


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two rows of fingerprints: equal bins among those that either fills; 1 if both are empty."""
    filled = (a != _EMPTY) | (b != _EMPTY)
    n = filled.sum(1)
    return np.where(n > 0, ((a == b) & filled).sum(1) / np.maximum(n, 1), 1.0)


def as_hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


_PLAIN = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("n_phrases", pa.int64())])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_phrases) for each row; a null text counts as empty."""

    def run(batches):
        for x in batches:
            rows, n = fingerprints(x.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(as_hex(rows)), pa.array(n)], schema=_PLAIN)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_phrases long")


_COMPARED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_phrases", pa.int64())])
_COMPARED_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_phrases long"


def _compared(batches):
    held = None  # the last document, whose successor is the next row of its bucket
    for x in batches:
        columns = [x.column(k).to_pylist() for k in ("bucket", "border", "doc_id", "text")]
        at = 0
        while at < x.num_rows:
            end, n = at + 1, len(columns[3][at])
            while end < x.num_rows and n + len(columns[3][end]) <= _PIECE:
                n += len(columns[3][end])
                end += 1
            rows = [c[at:end] for c in columns]
            at = end
            prints, phrases = fingerprints(rows[3])
            if held:
                rows = [[h, *r] for h, r in zip(held[0], rows, strict=True)]
                prints, phrases = np.vstack([held[1], prints]), np.append(held[2], phrases)
            bucket, border, ids, texts = rows
            pairs = [k for k in range(len(ids) - 1) if bucket[k] == bucket[k + 1] and not border[k]]
            held = ([r[-1] for r in rows], prints[-1:], phrases[-1])
            if not pairs:
                continue
            edited = [texts[k][: len(texts[k]) - len(texts[k]) // 3] + texts[k + 1][: len(texts[k]) // 3] for k in pairs]
            other, _ = fingerprints(edited)
            here = np.array(pairs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[k] for k in pairs], pa.int64()),
                    pa.array([len(texts[k]) for k in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(as_hex(prints[here])),
                    pa.array(as_hex(other)),
                    pa.array(likeness(prints[here], other)),
                    pa.array(likeness(prints[here], prints[here + 1])),
                    pa.array(phrases[here]),
                ],
                schema=_COMPARED,
            )


def compare_with_next(docs: DataFrame, bytes_per_range: int = 8 << 20) -> DataFrame:
    """Each document's fingerprint, held against that of an edited copy and of the next document.

    The next document is the one before in doc_id; the smallest doc_id's is the largest. Rows without
    doc_id come after all others, rows of one doc_id by a hash of the text. Documents are dealt
    into ranges of that order, each a task that runs through its sorted rows; the first document
    of the next range comes along as a copy. Ranges are cut at quantiles of doc_id; where very many
    rows have one doc_id, or none, at quantiles of the hash. Null texts count as empty. A document
    alone is its own next one; an empty table gives no rows.
    """
    hashed = F.xxhash64("text").alias("h")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("*", hashed)
    rows, known, size = docs.agg(F.count("*"), F.count("doc_id"), F.sum(F.octet_length("text"))).first()
    if not rows:
        return docs.sparkSession.createDataFrame([], _COMPARED_DDL)
    wanted = max(1, min(rows, -(-size // bytes_per_range), _MOST_RANGES))
    unnamed = -(-wanted * (rows - known) // rows)
    ranges = max(1, wanted - unnamed) if known else 0
    shares = [k / ranges for k in range(1, ranges)]
    cuts = np.array(docs.agg(F.percentile_approx("doc_id", shares, 100_000)).first()[0] if shares else [], np.int64)

    @F.arrow_udf(T.IntegerType())
    def range_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        share = (hashes.to_numpy() >> 32) + (1 << 31)
        value = ids.fill_null(0).to_numpy()
        low = np.searchsorted(cuts, value, "left")
        same = np.searchsorted(cuts, value, "right") - low
        place = unnamed + low + (share * np.maximum(same, 1) >> 32)
        none = ids.is_null().to_numpy(zero_copy_only=False)
        return pa.array(np.where(none, share * unnamed >> 32, place).astype(np.int32))

    dealt = docs.withColumn("bucket", range_of("doc_id", "h"))
    heads = dealt.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("first")).orderBy("bucket").collect()
    # the first document of each range, of which there are _MOST_RANGES at most, also ends the range above
    to = [(*r["first"], heads[(k + 1) % len(heads)].bucket) for k, r in enumerate(heads)]
    lookup = F.broadcast(docs.sparkSession.createDataFrame(to, "first_id long, first_h long, bucket int"))
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    copies = docs.join(lookup, first).select(*docs.columns, "bucket", F.lit(True).alias("border"))
    both = dealt.withColumn("border", F.lit(False)).unionByName(copies).select("bucket", "border", "doc_id", "text", "h")
    order = (F.asc("border"), F.desc_nulls_last("doc_id"), F.desc("h"), F.desc("text"))
    ranged = both.repartitionById(unnamed + ranges, "bucket").sortWithinPartitions(*order)
    return ranged.select("bucket", "border", "doc_id", "text").mapInArrow(_compared, _COMPARED_DDL)
