"""Files of framed records as a data source of Spark: ``tfrecords``.

A frame is the payload's length (8 bytes), a masked CRC-32C of these, the payload, and one of the payload. A
payload is a map from names to lists of bytes, floats or whole numbers, in protocol-buffer wire format,
or any bytes. Files are cut by offsets; a task finds the first frame after its offset by the checksum
of the length, so that a large file has many tasks.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, LongType, StringType, StructField, StructType

#: The reflected polynomial of CRC-32C, and what its masked form adds.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), x >> np.uint32(1))
    return x


_TABLE = _crc_table()
_LIST = _TABLE.tolist()


def masked_crc(data: bytes) -> int:
    """The checksum of one short text."""
    c = 0xFFFFFFFF
    for b in data:
        c = _LIST[(c ^ b) & 0xFF] ^ (c >> 8)
    c ^= 0xFFFFFFFF
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def masked_crcs(payloads: list[bytes]) -> list[int]:
    """The checksums of many payloads, a byte of all at a time: long ones first, those that have ended go."""
    order = sorted(range(len(payloads)), key=lambda k: -len(payloads[k]))
    lengths = np.array([len(payloads[k]) for k in order])
    offsets = np.append(0, np.cumsum(lengths))[:-1]
    data = np.frombuffer(b"".join(payloads[k] for k in order), np.uint8)
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(lengths[0]) if len(order) else 0):
        n = int(np.searchsorted(-lengths, -j, "left"))
        c[:n] = _TABLE[(c[:n] ^ data[offsets[:n] + j]) & np.uint32(0xFF)] ^ (c[:n] >> np.uint32(8))
    c = ~c
    c = ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(MASK)
    out = [0] * len(order)
    for k, x in zip(order, c.tolist(), strict=True):
        out[k] = x
    return out


def framed(payloads: list[bytes]) -> bytes:
    """The payloads as frames, one after another."""
    out = []
    for x, crc in zip(payloads, masked_crcs(payloads), strict=True):
        head = struct.pack("<Q", len(x))
        out += [head, struct.pack("<I", masked_crc(head)), x, struct.pack("<I", crc)]
    return b"".join(out)


# ---- payloads


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, content) of a message."""
    at = 0
    while at < len(data):
        key, at = _read_varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _read_varint(data, at)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                n, at = _read_varint(data, at)
            if n is None or at + n > len(data):
                raise ValueError("a damaged record")
            value, at = data[at : at + n], at + n
        yield key >> 3, kind, value


def encode_example(row: dict) -> bytes:
    """A record of a row's columns; a null column is left out, a value that is no list is a list of one."""
    features = []
    for name, value in row.items():
        if value is None:
            continue
        values = list(value) if isinstance(value, (list, tuple)) else [value]
        first = values[0] if values else b""
        if isinstance(first, (str, bytes, bytearray)):
            feature = _field(1, b"".join(_field(1, v.encode() if isinstance(v, str) else bytes(v)) for v in values))
        elif isinstance(first, float):
            feature = _field(2, _field(1, struct.pack(f"<{len(values)}f", *values)))
        else:
            feature = _field(3, _field(1, b"".join(_varint(int(v)) for v in values)))
        features.append(_field(1, _field(1, name.encode()) + _field(2, feature)))
    return _field(1, b"".join(features))


def decode_example(data: bytes) -> dict[str, list]:
    """A record's columns, each as a list of bytes, floats or whole numbers."""
    out: dict[str, list] = {}
    for _, _, features in _fields(data):
        for _, _, entry in _fields(features):
            parts = {n: v for n, _, v in _fields(entry)}
            values: list = []
            for kind, _, content in _fields(parts.get(2, b"")):
                for _, wire, x in _fields(content):
                    if kind == 1:
                        values.append(x)
                    elif kind == 2:
                        values += struct.unpack(f"<{len(x) // 4}f", x)
                    elif wire == 0:
                        values.append(x - (1 << 64) if x >> 63 else x)
                    else:
                        at = 0
                        while at < len(x):
                            n, at = _read_varint(x, at)
                            values.append(n - (1 << 64) if n >> 63 else n)
            out[parts.get(1, b"").decode()] = values
    return out


def _as(values: list | None, kind) -> object:
    if isinstance(kind, ArrayType):
        return None if values is None else [_as([v], kind.elementType) for v in values]
    if not values:
        return None
    x = values[0]
    if isinstance(kind, StringType):
        return x.decode() if isinstance(x, bytes) else str(x)
    if isinstance(kind, BinaryType):
        return x
    if isinstance(kind, (LongType, IntegerType)):
        return int(x)
    return float(x)


# ---- the data source

RAW = StructType([StructField("record", BinaryType())])


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, split: int):
        self.schema, self.path, self.split = schema, path, split

    def partitions(self) -> list[_Part]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f for f in files if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        return [_Part(f.path, at, min(at + self.split, f.size), f.size) for f in files for at in range(0, f.size, self.split)]

    def _frames(self, part: _Part, file) -> Iterator[tuple[int, bytes, int]]:
        """(offset, payload, checksum) of the frames that begin in the part."""

        def head(at: int) -> int | None:
            file.seek(at)
            data = file.read(12)
            if len(data) < 12 or masked_crc(data[:8]) != struct.unpack("<I", data[8:])[0]:
                return None
            return struct.unpack("<Q", data[:8])[0]

        at = part.start
        if at:
            # the frame before may reach far into the part: the first place at which a length fits its checksum
            window, base = b"", at
            while at < part.end:
                if at - base + 12 > len(window):
                    base, _ = at, file.seek(at)
                    window = file.read(1 << 16)
                    if len(window) < 12:
                        return
                piece = window[at - base : at - base + 12]
                if masked_crc(piece[:8]) == struct.unpack("<I", piece[8:])[0]:
                    after = at + 16 + struct.unpack("<Q", piece[:8])[0]
                    if after == part.size or after < part.size and head(after) is not None:
                        break
                at += 1
        while at < part.end:
            size = head(at)
            if size is None or at + 16 + size > part.size:
                raise ValueError(f"{part.path}: a damaged frame at byte {at}")
            file.seek(at + 12)
            body = file.read(size + 4)
            yield at, body[:size], struct.unpack("<I", body[size:])[0]
            at += 16 + size

    def read(self, part: _Part | None) -> Iterator[tuple]:
        if part is None:  # a folder without files
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        raw = self.schema.fieldNames() == ["record"]

        def rows(held: list[tuple[int, bytes, int]]) -> Iterator[tuple]:
            for (at, x, wanted), crc in zip(held, masked_crcs([h[1] for h in held]), strict=True):
                if crc != wanted:
                    raise ValueError(f"{part.path}: a damaged record at byte {at}")
                if raw:
                    yield (x,)
                else:
                    values = decode_example(x)
                    yield tuple(_as(values.get(f.name), f.dataType) for f in self.schema.fields)

        with fs.open_input_file(part.path) as file:
            held, n = [], 0
            for frame in self._frames(part, file):
                held.append(frame)
                n += len(frame[1])
                if len(held) == 1024 or n > 1 << 24:
                    yield from rows(held)
                    held, n = [], 0
            yield from rows(held)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Writer(DataSourceWriter):
    """Tasks write hidden files; the commit gives those of tasks that succeeded their names, an abort deletes them."""

    def __init__(self, schema: StructType, path: str, overwrite: bool):
        self.schema, self.path, self.overwrite = schema, path, overwrite

    def write(self, rows: Iterator) -> _Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        name = f"{root}/.{uuid.uuid4().hex}.tfrecords"
        raw, held, any_row = self.schema.fieldNames() == ["record"], [], False
        with fs.open_output_stream(name) as out:
            for r in rows:
                any_row = True
                held.append(bytes(r[0]) if raw else encode_example({c: r[k] for k, c in enumerate(self.schema.fieldNames())}))
                if len(held) == 1024:
                    out.write(framed(held))
                    held = []
            out.write(framed(held))
        if not any_row:
            fs.delete_file(name)
        return _Written([name] if any_row else [])

    def commit(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root)):
                if f.type == pafs.FileType.File and f.path not in files:
                    fs.delete_file(f.path)
        for k, name in enumerate(files):
            fs.move(name, f"{root}/part-{k:05d}-{name.rpartition('/')[2].lstrip('.')}")
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for name in [f for m in messages if m for f in m.files]:
            fs.delete_file(name)


class RecordFiles(DataSource):
    """``spark.read.format("tfrecords")``: with a schema its columns, without one the raw ``record``."""

    @classmethod
    def name(cls) -> str:
        return "tfrecords"

    def schema(self) -> StructType:
        return RAW

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, _uri(self.options["path"]), int(self.options.get("split_bytes", 128 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(schema, _uri(self.options["path"]), overwrite)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("/") else path.removeprefix("file:")


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None, split_bytes: int = 128 << 20) -> DataFrame:
    """Record files as a table, or as raw ``record`` bytes without a schema. A column that a record lacks is null."""
    spark.dataSource.register(RecordFiles)
    reader = spark.read.format("tfrecords").option("split_bytes", str(split_bytes))
    return (reader if schema is None else reader.schema(schema)).load(path)


def write_records(df: DataFrame, path: str, mode: str = "append") -> None:
    """A table as record files, one for each partition that has rows. Whole numbers, floats, texts, bytes and lists of them."""
    df.sparkSession.dataSource.register(RecordFiles)
    df.write.format("tfrecords").mode(mode).save(path)


def sample_schema(spark: SparkSession, path: str, rows: int = 1000) -> StructType:
    """The columns of the first records: lists where any record has not just one value, and the kind of its values."""
    kinds: dict[str, tuple[type, bool]] = {}
    for r in read_records(spark, path).limit(rows).collect():
        for name, values in decode_example(bytes(r.record)).items():
            kind, many = kinds.get(name, (None, False))
            kinds[name] = (type(values[0]) if values else kind, many or len(values) != 1)
    of = {bytes: StringType(), float: FloatType(), int: LongType(), None: StringType()}
    return StructType([StructField(c, ArrayType(of[k]) if many else of[k]) for c, (k, many) in sorted(kinds.items())])


#: Readers by format: (session, path, schema or none) to a table.
FORMATS = {
    "csv": lambda spark, path, schema: spark.read.csv(path, schema, header=True, inferSchema=schema is None),
    "json": lambda spark, path, schema: spark.read.json(path, schema),
    "parquet": lambda spark, path, schema: (spark.read if schema is None else spark.read.schema(schema)).parquet(path),
    "tfrecords": lambda spark, path, schema: read_records(spark, path, schema or sample_schema(spark, path)),
}


def read_table(spark: SparkSession, path: str, form: str, schema: StructType | str | None = None) -> DataFrame:
    """A table of any known format."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}, known are {sorted(FORMATS)}")
    return FORMATS[form](spark, path, schema)
