"""Record files: frames, payloads, splits and damage."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from noisemill.sources import records

SCHEMA = "id long, name string, share float, tags array<string>, counts array<long>, blob binary"


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    df = spark.range(3000).select(
        (i - 1500).alias("id"),
        F.when(i % 7 > 0, F.concat(F.lit("é"), i)).alias("name"),
        (i / 4).cast("float").alias("share"),
        F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), i.cast("string"))).alias("tags"),
        F.array(i, -i, F.lit(1 << 40)).alias("counts"),
        F.encode(F.repeat(F.lit("q"), (i % 90).cast("int")), "utf-8").alias("blob"),
    )
    return df.repartition(3)


def test_known_checksums():
    assert records.masked_crc(b"") == 0xA282EAD8
    crc = 0xE3069283  # of 123456789, a published check value
    assert records.masked_crc(b"123456789") == ((crc >> 15 | crc << 17) + records.MASK) & 0xFFFFFFFF
    many = [bytes([k % 256]) * (k * 37 % 200) for k in range(300)]
    assert records.masked_crcs(many) == [records.masked_crc(x) for x in many] and records.masked_crcs([]) == []


def test_payloads_come_back():
    row = {"a": -5, "b": [1, 2, 1 << 62], "c": 0.5, "d": ["é", b"\xff"], "e": None, "f": []}
    got = records.decode_example(records.encode_example(row))
    assert got == {"a": [-5], "b": [1, 2, 1 << 62], "c": [0.5], "d": ["é".encode(), b"\xff"], "f": []}
    with pytest.raises((ValueError, IndexError)):
        records.decode_example(records.encode_example(row)[:-3])


@pytest.mark.parametrize("split", [128 << 20, 1000, 77])
def test_a_table_comes_back_from_any_number_of_splits(spark, rows, tmp_path, split):
    path = str(tmp_path / "t")
    few = rows.where("id % 10 = 0") if split < 1000 else rows
    records.write_records(few, path)
    back = records.read_records(spark, path, SCHEMA, split)
    if split < 1 << 20:
        assert back.rdd.getNumPartitions() > 50
    # an empty text of bytes is one value, an empty list none
    assert sorted(back.collect(), key=str) == sorted(few.collect(), key=str)
    assert records.read_records(spark, path, None, split).count() == few.count()


def test_schema_from_a_sample_and_formats(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    records.write_records(rows, path)
    found = {f.name: f.dataType.simpleString() for f in records.sample_schema(spark, path)}
    assert found == {"id": "bigint", "name": "string", "share": "float", "tags": "array<string>", "counts": "array<bigint>", "blob": "string"}
    assert records.read_table(spark, path, "tfrecords").count() == 3000
    rows.select("id", "name").write.parquet(str(tmp_path / "p"))
    assert records.read_table(spark, str(tmp_path / "p"), "parquet").columns == ["id", "name"]
    with pytest.raises(ValueError):
        records.read_table(spark, path, "rows")


def test_damage_is_found(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    records.write_records(rows.coalesce(1), path)
    (file,) = glob.glob(f"{path}/part-*")
    data = bytearray(open(file, "rb").read())
    for at in (5, 40, len(data) - 2):
        broken = data.copy()
        broken[at] ^= 1
        open(file, "wb").write(broken)
        with pytest.raises(Exception, match="damaged"):
            records.read_records(spark, path, SCHEMA).collect()
    open(file, "wb").write(data[:-9])
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, path, SCHEMA).collect()


def test_overwrite_leaves_only_new_files(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    records.write_records(rows, path)
    records.write_records(rows.where("id < 0"), path, "overwrite")
    assert records.read_records(spark, path).count() == 1500
    assert not [f for f in os.listdir(path) if f.startswith(".") and not f.endswith(".crc")]
    records.write_records(rows.where("id = 99999"), str(tmp_path / "none"))
    assert records.read_records(spark, str(tmp_path / "none"), SCHEMA).count() == 0
