"""WARC archives: written by Spark's text writer, read by boundary-chain verification."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._support import batch

MAGIC = b"WARC/1.0\r\n"
_END = b"\r\n\r\n"
_PAGE = "urn:page:"


def deduplicated(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Pages with payload length and digest, and for a repeated payload the page that has it first.

    Of equal payloads of at least ``least_bytes`` the one with the smallest page_id is kept; the
    others get its id as ``refers_to``. A null html is an empty payload. The first page of each
    payload comes from a grouped minimum; the join after it may have a payload that many pages
    share, whose rows Spark splits over tasks.
    """
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    full = full.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2(F.encode("html", "UTF-8"), 256))
    first = full.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first_id")
    joined = full.join(first, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id"))).drop("first_id")


def record(date: str) -> Column:
    """The whole WARC record of a row of ``deduplicated``, without the blank lines that end it."""

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))

    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{_PAGE}"), page, F.lit(">"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]+", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), line("WARC-Refers-To", F.concat(F.lit(f"<{_PAGE}"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(""),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write(
    pages: DataFrame,
    path: str,
    date: str = "1970-01-01T00:00:00Z",
    records_per_file: int = 4096,
    bytes_per_file: int = 512 << 20,
    compression: str = "gzip",
) -> None:
    """Write one record for each page into archives below ``path``.

    A record ends with two line breaks, which here are the text writer's line separator. The
    writer commits whole files, so a lost task leaves none behind. Line breaks in a url become %20.

    A file has ``records_per_file`` records at most. Pages so large that those could exceed
    ``bytes_per_file`` go into archives of their own below ``path``/large, with as few records each as
    the largest page demands; one page alone may be larger.
    """
    rows = deduplicated(pages)
    usual = bytes_per_file // records_per_file
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0  # one number

    def save(part: DataFrame, where: str, records: int) -> None:
        writer = part.select(record(date).alias("value")).write.option("lineSep", _END.decode())
        writer.option("maxRecordsPerFile", records).option("compression", compression).text(where)

    if largest <= usual:
        save(rows, path, records_per_file)
    else:
        save(rows.where(F.col("payload_bytes") <= usual), f"{path.rstrip('/')}/usual", records_per_file)
        save(rows.where(F.col("payload_bytes") > usual), f"{path.rstrip('/')}/large", max(1, bytes_per_file // largest))


_FIELD = re.compile(rb"(?m)^([A-Za-z-]+): ([^\r\n]*)\r$")
_LENGTH = re.compile(rb"(?mi)^content-length: ([0-9]{1,18})\r$")
_SCHEMA = pa.schema(
    [
        ("file", pa.string()),
        ("at", pa.int64()),
        ("next", pa.int64()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("reached", pa.bool_()),
    ]
)
_DDL = (
    "file string, at long, next long, record_type string, page_id long, refers_to long, url string, "
    "payload_bytes long, payload_digest string, payload binary, reached boolean"
)


def _page(value: bytes | None) -> int | None:
    digits = (value or b"").strip(b"<>").removeprefix(_PAGE.encode())
    return int(digits) if re.fullmatch(rb"-?[0-9]+", digits) else None


def _places(data: bytes):
    """(place, end of the header, length of the block, where a next record would begin) of what looks like a record."""
    at = data.find(MAGIC)
    while at >= 0:
        head = data.find(_END, at)
        length = _LENGTH.search(data, at, head + 2) if head >= 0 else None
        if length:
            end = head + len(_END) + int(length[1])
            if data[end : end + len(_END)] == _END:
                yield at, head, int(length[1]), end + len(_END)
        at = data.find(MAGIC, at + 1)


def _candidates(name: str, data: bytes, payload: bool):
    """A row for each place that looks like a record: where it would end, what it would hold."""
    for at, head, length, following in _places(data):
        fields = {k.lower(): v for k, v in _FIELD.findall(data[at + len(MAGIC) : head + 2])}
        body = head + len(_END)
        end = body + length
        http = data.find(_END, body, end)
        kind = fields.get(b"warc-type", b"").decode("latin-1")
        content = data[http + len(_END) : end] if http >= 0 else data[body:end]
        if kind == "revisit":
            digest = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:")
            size = int(fields.get(b"x-payload-length", b"0"))
        else:
            digest, size = hashlib.sha256(content).hexdigest(), len(content)
        url = fields.get(b"warc-target-uri", b"").decode(errors="replace")
        page, first = _page(fields.get(b"warc-record-id")), _page(fields.get(b"warc-refers-to"))
        yield name, at, following, kind, page, first, url, size, digest, content if payload else None


def unpacked(data: bytes) -> bytes:
    """A file's bytes, out of any number of gzip members; what lies behind a damaged place is left out."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, view = [], 0, memoryview(data)
    member = zlib.decompressobj(31)
    while at < len(data):
        part = view[at : at + (1 << 16)]
        try:
            out.append(member.decompress(part))
        except zlib.error:
            break
        at += len(part) - len(member.unused_data)
        if member.eof:
            if data[at : at + 2] != b"\x1f\x8b":
                break
            member = zlib.decompressobj(31)
    return b"".join(out)


def reachable(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of a file's links (rising places, where each leads) a chain from place 0 comes to.

    Pointer jumping: each round every link's target becomes its target's target, and the targets of
    what is reached join it, so a chain of n records takes log2(n) rounds.
    """
    n = len(at)
    jump = np.searchsorted(at, following)
    jump = np.append(np.where(np.append(at, -1)[jump] == following, jump, n), n)  # n: no link begins there
    reached = np.append(at == 0, False)
    while True:
        wider = reached.copy()
        wider[jump[reached]] = True
        wider[n] = False
        if np.array_equal(wider, reached) and np.array_equal(jump[jump], jump):
            return reached[:n]
        reached, jump = wider, jump[jump]


def candidates(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Every place below ``path`` that looks like a record, magic inside payloads included.

    The task that reads a file emits a row for each such place with where it leads, and ``reached``:
    whether the chain of places from the file's start comes to it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def find(batches):
        for x in batches:
            for name, content in zip(x.column("path").to_pylist(), x.column("content"), strict=True):
                data = unpacked(content.as_py())
                links = [(at, following) for at, _, _, following in _places(data)]
                at, following = np.array(links, np.int64).reshape(-1, 2).T
                chain = dict(zip(at.tolist(), reachable(at, following).tolist(), strict=True))
                rows = []
                for row in _candidates(name, data, payload):
                    rows.append((*row, chain[row[1]]))
                    if len(rows) == 512:
                        yield batch(_SCHEMA, *zip(*rows, strict=True))
                        rows = []
                if rows:
                    yield batch(_SCHEMA, *zip(*rows, strict=True))

    return files.mapInArrow(find, _DDL)


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the archives below ``path``, in files of any compression by gzip or none.

    Columns: file, at, record_type, page_id, refers_to, url, payload_bytes, payload_digest (for a
    revisit both as its header says, else of the bytes that are there), and payload if asked for.
    Each file is read by one task; archives should have bounded sizes, as ``write`` makes them. Of a
    damaged file the records before the damage are read, of one that is no archive none; an empty
    folder gives no rows; records repeat as often as they are there.
    """
    found = candidates(spark, path, payload).where("reached").drop("next", "reached")
    return found if payload else found.drop("payload")
