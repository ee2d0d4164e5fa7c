"""What several operators share: the shared folder, Arrow plumbing, vectorised text scans."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisemill.operators.relational import scratch_root

_written: list[str] = []


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``, which all machines of a cluster see.

    Where the session names no such folder, a temporary one serves on a single machine, as in tests;
    on a cluster that is an error.
    """
    path = f"{scratch_root(spark).rstrip('/')}/noisemill/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize``. Only what nothing lazy reads any more may go."""
    for df in tables:
        _delete(df.sparkSession, df.scratch)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this process has written to the shared folder; lazy results that need it are lost."""
    for path in list(_written):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def free_name(wanted: str, columns: list[str]) -> str:
    """``wanted``, with as many underscores before it as no column is called so."""
    lower = {c.lower() for c in columns}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted


def spread_join(
    big: DataFrame, small: DataFrame, key: str, by: str, counts: DataFrame | None = None, most: int = 4096
) -> DataFrame:
    """``big`` joined with ``small`` on ``key``, however many rows of ``big`` share one.

    ``small`` has a row for each key at most. Keys with over 1 / ``most`` of all rows are dealt into
    parts by a hash of ``by``, and their rows of ``small`` repeated. Such keys are fewer than
    ``most``, so a broadcast tells both sides which they are. ``counts``: (key, n) if it is known.
    """
    if counts is None:
        counts = big.groupBy(key).agg(F.count("*").alias("n"))
    total, top = counts.agg(F.sum("n"), F.max("n")).first()  # two numbers
    limit = max(1000, (total or 0) // most)
    if (top or 0) <= limit:
        return big.join(small, key)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("_parts")))
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))
    dealt = big.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    copies = small.join(hot, key, "left").withColumn("_part", each).drop("_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def split_by(rows: DataFrame, keys: DataFrame, key: str, words: int = 1 << 17) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be one of ``keys``, and those whose isn't, which thus need no join.

    A hash of each of the keys sets a bit, of ``words`` * 64 at most; the filter is broadcast as rows
    (word, bits), so its size is bounded whatever the keys' number. It errs on the side of the first part
    only, so an exact join of that part must follow. ``key`` has one type in both tables; ``keys`` and
    ``rows`` are read more than once.
    """

    def place(of: DataFrame):
        return F.pmod(F.xxhash64(of[key]), F.lit(words * 64))

    at, word, bits = (free_name(c, rows.columns) for c in ("at", "word", "bits"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(at) % 64).cast("int"))
    known = keys.where(F.col(key).isNotNull()).select(place(keys).alias(at)).groupBy(F.floor(F.col(at) / 64).alias(word)).agg(F.bit_or(bit).alias(bits))
    marked = rows.withColumn(at, place(rows)).withColumn(word, F.floor(F.col(at) / 64)).join(F.broadcast(known), word, "left")
    passes = F.coalesce(F.call_function("bit_get", bits, (F.col(at) % 64).cast("int")) == 1, F.lit(False))
    return marked.where(passes).select(*(f"`{c}`" for c in rows.columns)), marked.where(~passes).select(*(f"`{c}`" for c in rows.columns))


def semi_join(rows: DataFrame, keys: DataFrame, key: str, words: int = 1 << 17) -> DataFrame:
    """The rows whose ``key`` is one of ``keys``; of the others hardly any is shuffled."""
    return split_by(rows, keys, key, words)[0].join(keys.select(key), key, "left_semi")


def anti_join(rows: DataFrame, keys: DataFrame, key: str, words: int = 1 << 17) -> DataFrame:
    """The rows whose ``key`` is none of ``keys``, or null; hardly any of them is shuffled."""
    some, others = split_by(rows, keys, key, words)
    return others.unionByName(some.join(keys.select(key), key, "left_anti").select(*(f"`{c}`" for c in rows.columns)))


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, more); a null text becomes empty, other columns go."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fold(column: str, modulus: int):
    """crc32 of an id, written as text (null: empty text), modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and each row's offset into them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system, which a worker otherwise holds while it waits, beside its JVM.

    Only where the C library has ``malloc_trim``; elsewhere nothing happens.
    """
    pa.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return
    trim(0)


def gives_back(scan: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The scan of a task, which returns what it has taken to the system when it has read its rows."""

    @wraps(scan)
    def run(*args) -> Iterator[pa.RecordBatch]:
        yield from scan(*args)
        give_back()

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most ``most`` bytes of text, or of one row.

    Scans take some fifty bytes for one of text, so this bounds a worker's memory. When all rows are
    read, what they took goes back to the system.
    """
    for batch in batches:
        yield from cut(batch, column, most)
    batch = None
    give_back()


def cut(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of one batch, in batches of at most ``most`` bytes of text, or of one row."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


# Vectorised hashing of spans. A span's hash is a polynomial over a table of 64-bit values of its
# bytes, from prefix sums modulo 2**64, so that every span of a buffer costs a few array operations.
_ODD = 0x9E3779B97F4A7C15
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUES = _BYTE_VALUES[LOWER]
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_tables.get("up", ())) < n:
        size = n + (1 << 16)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _tables[key] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"][:n], _tables["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end]; equal spans have equal hashes wherever they lie."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-blank bytes in each row, and each run's row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~blank[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = inside & first
    begins[1:] |= inside[1:] & ~inside[:-1]
    begins[0] |= inside[0]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case."""
    data, offsets = buffers(column)
    starts, ends, rows = words(data, offsets)
    return span_hashes(LOWER_VALUES[data], starts, ends), rows


@lru_cache(maxsize=8)
def hash_of(word: str) -> int:
    """The hash that ``span_hashes`` gives to a single word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(LOWER_VALUES[data], np.array([0]), np.array([len(data)]))[0])


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def arrow_schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields))
