"""Connected components of an edge table by alternating stars, all state in tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._support import discard, materialize

_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Each node but the least of its component, with that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, shorter := new[new]):
            new = shorter
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[label[child]])], schema=_EDGES)


def _forest(batches, block: int = 1 << 21):
    """The stars of blocks of a task's edges: at most nodes - 1 edges leave each block."""
    held, n = [], 0
    for x in batches:
        held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
        n += x.num_rows
        if n >= block:
            out = _stars(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [(out.column(0).to_numpy(), out.column(1).to_numpy())], out.num_rows
            if 2 * n >= block:
                yield out
                held, n = [], 0
    if held:
        yield _stars(*map(np.concatenate, zip(*held, strict=True)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, per_task: int = 1 << 20) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component is named by its least node.

    The edges are dealt to tasks, ``per_task`` to each, which contract theirs. If one task had them
    all, that is it. Else rounds follow, each of two grouped minima and two joins, written to the
    shared folder, until the edges are stars, after about the logarithm of the longest path. Null
    ends and loops are ignored; an empty table gives an empty table.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = materialize(edges.where("u is not null and v is not null and u <> v"), "edges")
    tasks = max(1, -(-edges.count() // per_task))
    dealt = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks)
    forest = materialize(dealt.mapInArrow(_forest, "u long, v long"), "edges")
    discard(edges)
    edges, seen = forest, None
    while tasks > 1:
        new = materialize(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(edges)
        edges = new
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
