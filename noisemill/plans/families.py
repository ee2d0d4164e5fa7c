"""Synthetic tables that hang together: children drawn beside their synthetic parents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisemill.functions import budget
from noisemill.functions.codec import decode_table, encode_table, uniform
from noisemill.operators.relational import checkpointed, couple, exploration_table, truncate, unstack
from noisemill.plans.siblings import fit_families
from noisemill.plans.synthesis import draw, synthesize_codes
from noisemill.spec import Categorical, Relations, Schema


def synthesize_relations(tables: dict[str, DataFrame], relations: Relations, epsilon: float, delta: float, order: dict[str, list], seed: int | None = None, method: str = "mst", draw_seed: int = 0, slots: int = 1) -> dict[str, DataFrame]:
    """Every table anew under (epsilon, delta), a root row with all that hangs on it protected.

    Per link, parents' columns, the number of children and one child's columns make a table whose
    rows sum to 1 a parent; noise grows with the parents that a root row can touch. Synthetic
    parents get a number of children from it, and each child draws its columns given its parent.
    Keys are new: a parent's row number, and children's row numbers below it. Each table is written
    out once it is drawn.

    With ``slots`` of 2 or more, so many children are looked at side by side, and all children of a parent
    are drawn at once from a model of families, which is coupled to the synthetic parents by rank,
    ties at random: siblings are then as alike as they were. Noise comes from the operating system; a ``seed`` is for tests only.
    """
    relations.check_columns({n: t.columns for n, t in tables.items()})
    spark = next(iter(tables.values())).sparkSession
    rng = np.random.default_rng(seed)
    links = [k for _, k in relations.order() if k is not None]
    rho = budget.zcdp_rho(epsilon, delta) / (len(links) + 1)
    reach = relations.sensitivities()
    root, _ = relations.order()[0]
    done: dict[str, DataFrame] = {root: checkpointed(draw(spark, synthesize_codes(encode_table(tables[root], relations.tables[root]), relations.tables[root], rho, rng, method, forest=True), seed=draw_seed))}
    kept = dict(tables)
    for name, k in relations.order():
        if k is None:
            continue
        up, own = relations.tables[k.parent], relations.tables[name]
        kept[name] = truncate(tables[name].join(kept[k.parent].select(F.col(k.parent_key).alias(k.child_key)).distinct(), k.child_key, "left_semi"), k, *order[name])
        parent = encode_table(kept[k.parent], up, keep=(k.parent_key,))
        child = encode_table(kept[name].withColumn("_by", F.struct(*order[name])), own, keep=(k.child_key, "_by"))
        sizes = {c: a.size for c, a in own.items()}
        wide = exploration_table(parent, child, k, list(up), sizes, slots, ["_by"])
        if slots > 1:
            wide = checkpointed(wide)
            near: Schema = {**up, "group_size": Categorical(tuple(range(k.capacity + 1)))}
            reached = reach[f"{k.parent}->{name}"]
            parents = synthesize_codes(wide.select(*near, "weight"), near, rho / 2, rng, method, weight="weight", sensitivity=reached, forest=True)
            model = fit_families(wide, near, sizes, k.capacity, slots, rho / 2, rng, reached, parents)
            there = done[k.parent]
            made = draw(spark, model, there.count(), seed=draw_seed + 1, key="_family")
            made = made.select("_family", *(F.col(c).alias(f"_{c}") for c in up), "group_size", *(F.col(f"`{c}`") for c in model.schema if c not in near))
            tie = lambda key: uniform(key, seed=draw_seed + 4)
            linked = couple(there.select(F.col("id").alias("_parent"), *up), made, [*up, tie("_parent")], [*(f"_{c}" for c in up), tie("_family")])
            kids = unstack(linked, k.capacity, sizes, "_parent").withColumn("id", F.col("_parent") * (k.capacity + 1) + F.col("slot"))
            done[name] = checkpointed(kids.select("id", F.col("_parent").alias(k.child_key), *own))
            continue
        wide = wide.select(*list(up), "group_size", *(F.col(f"`slot_1.{c}`").alias(f"child_{c}") for c in own), "weight")
        joint: Schema = {**up, "group_size": Categorical(tuple(range(k.capacity + 1))), **{f"child_{c}": Categorical(tuple(range(a.size + 1))) for c, a in own.items()}}
        model = synthesize_codes(wide, joint, rho, rng, method, weight="weight", sensitivity=reach[f"{k.parent}->{name}"], forest=True)
        families = draw(spark, _only(model, [*up, "group_size"]), seed=draw_seed + 1, given=done[k.parent])
        kids = families.where("group_size > 0").select(F.col("id").alias("_parent"), *list(up), "group_size", F.explode(F.sequence(F.lit(1), F.col("group_size"))).alias("_slot"))
        kids = kids.withColumn("id", F.col("_parent") * (k.capacity + 1) + F.col("_slot"))
        drawn = draw(spark, model, seed=draw_seed + 2, given=kids)
        for c, a in own.items():
            # a child that is there has no empty columns: such a draw is made again, evenly
            again = F.floor(uniform("id", F.lit(c), seed=draw_seed + 3) * a.size).cast("int")
            drawn = drawn.withColumn(f"child_{c}", F.when(F.col(f"child_{c}") < a.size, F.col(f"child_{c}")).otherwise(again))
        done[name] = checkpointed(drawn.select("id", F.col("_parent").alias(k.child_key), *(F.col(f"child_{c}").alias(c) for c in own)))
    out = {}
    for name, k in relations.order():
        key = next((x.parent_key for x in links if x.parent == name), "id")
        df = decode_table(done[name], relations.tables[name], "id", seed=draw_seed)
        out[name] = df.withColumnRenamed("id", key) if key not in df.columns else df
    return out


def _only(model, columns: list[str]):
    """The model's part over some columns; a column whose parent is left out keeps its own shares."""
    from dataclasses import replace

    order = [c for c in model.order if c in columns]
    parents = {c: model.parents[c] if model.parents[c] in columns else None for c in order}
    shares = {c: model.shares[c] if model.parents[c] == parents[c] else model.single(c) for c in order}
    return replace(model, order=order, parents=parents, shares=shares)
