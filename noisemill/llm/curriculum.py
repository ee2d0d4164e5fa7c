"""Mixing sources to target weights that change while training goes on.

Each source's weight schedule is integrated to its cumulative demand for words; a document, whose words
lie somewhere in its source's stream, gets its training position by inverting that demand; documents
are sorted by position, in ranges.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisemill.operators.relational import ranked

from ._support import free_name, materialize, spread_join

#: Weight against the share of training that is over, in straight lines between the points: early, late and even.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))
#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"


def area(schedule: tuple) -> float:
    """The integral of a schedule."""
    if [schedule[0][0], schedule[-1][0]] != [0, 1] or any(b[0] <= a[0] for a, b in pairwise(schedule)) or any(w < 0 for _, w in schedule):
        raise ValueError(f"a schedule runs from 0 to 1 with weights of 0 or more: {schedule}")
    whole = sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in pairwise(schedule))
    if whole <= 0:
        raise ValueError(f"a schedule that never asks for a word: {schedule}")
    return whole


def inverse(share: Column, schedule: tuple) -> Column:
    """When the given share of a schedule's whole demand is met, from 0 to 1."""
    need, out, before = share * area(schedule), None, 0.0
    for (t0, w0), (t1, w1) in pairwise(schedule):
        rest, slope = need - before, (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        low = F.lit(w0) + root
        at = F.when((rest > 0) & (low > 0), F.least(F.lit(t1), F.lit(t0) + F.lit(2.0) * rest / low)).otherwise(F.lit(t0))
        out = at if out is None else F.when(need > before, at).otherwise(out)
        before += (w0 + w1) / 2 * (t1 - t0)
    return out


def _targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """Each source's target: the sources' weights share ``share`` of all words, none above ``most`` times
    its own; what goes beyond is shared again by weight. Each round is two sums over the sources, and
    ends when no more sources stop."""
    words, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = share * (words or 0)
    level, stopped = wanted / (weights or 1), None
    while True:
        over = F.lit(level) * F.col("weight") > F.col("source_size") * most
        held, free = sources.agg(F.sum(F.when(over, F.col("source_size") * most)), F.sum(F.when(~over, F.col("weight")))).first()
        if held == stopped or not free:
            break
        level, stopped = (wanted - (held or 0)) / free, held
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), (F.col("source_size") * most).cast("double")))


def assign(docs: DataFrame, keep: list[str], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, schedules: tuple = SCHEDULES, part_rows: int = 1 << 14) -> DataFrame:
    """(doc, size, source_size, target, taken, places) of each row of (doc_id, text, source, ...).

    ``doc`` holds the columns to ``keep``. Sources, in the order of their code points and null last, take
    ``weights`` and ``schedules`` in turn. A source's documents, in the order of a hash of doc_id, make a
    stream of words, which begins anew up to ``most`` times; the mix takes its first floor(target) words,
    so that the document at the end may be cut. ``places`` lists the copies taken: (copy, words,
    position), where position, from 0 to 1, is when the demand reaches the middle of these words.

    A source may hold any share of the rows: streams are summed in parts of about ``part_rows`` rows,
    by the leading digits of the hash. A null text is empty and a text without words is never taken;
    repeated rows count each, and rows that share a doc_id follow one another, shorter ones first,
    then by a hash of what is kept of them; an empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    told = [c for c in keep if "map<" not in docs.schema[c].dataType.simpleString()]
    base = docs.select(
        F.struct(*keep).alias("doc"),
        F.xxhash64(*told).alias("tie"),
        F.col("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("stream"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
    )
    base = materialize(base, "sizes")
    sources = base.groupBy("source", "stream").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = ranked(sources, F.col("source").asc_nulls_last(), name="place")
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("place") % len(values) + 1).cast("int"))
    sources = _targets(place.withColumn("weight", of(weights)), share, most)
    sources = sources.withColumn("kind", of(range(len(schedules)))).withColumn("parts", F.ceil(F.col("n") / part_rows))
    facts = sources.select("stream", "source_size", "target", "kind", "parts")
    rows = spread_join(base.drop("source"), facts, "stream", "key", sources.select("stream", "n"))
    digits = F.conv(F.substring("key", 1, 12), 16, 10).cast("double")
    rows = rows.withColumn("part", F.floor(digits / float(1 << 48) * F.col("parts"))).drop("parts")
    parts = rows.groupBy("stream", "part").agg(F.sum("size").alias("in_part"))
    ahead = Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("stream", "part", F.coalesce(F.sum("in_part").over(ahead), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("stream", "part").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(parts, ["stream", "part"])
    start = F.col("part_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = rows.select("doc", "size", "source_size", "target", "kind", start.alias("start"))

    def copy(k: Column) -> Column:
        begins = F.col("start") + k * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target") - begins))
        met = F.when(F.col("target") > 0, (begins + words / F.lit(2.0)) / F.col("target")).otherwise(0.0)
        at = inverse(met, schedules[0])
        for kind, schedule in list(enumerate(schedules))[1:]:
            at = F.when(F.col("kind") == kind, inverse(met, schedule)).otherwise(at)
        return F.struct(k.alias("copy"), words.alias("words"), at.alias("position"))

    copies = F.filter(F.array(*(copy(F.lit(k).cast("long")) for k in range(most))), lambda x: x["words"] > 0)
    taken = F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return rows.withColumn("places", copies).select("doc", "size", "source_size", "target", taken.alias("taken"), "places")


def arrange(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, a row a copy, sorted by training position.

    All columns stay; ``copy``, ``words`` (how many of the document's first words) and ``position`` are
    added, with underscores before them where a column is called so. Copies at one position, which
    only documents of different sources can have, go by doc_id.
    """
    plan = assign(docs, docs.columns, **options)
    names = {c: free_name(c, docs.columns) for c in ("copy", "words", "position")}
    rows = plan.select("doc", F.explode("places").alias("at"))
    rows = rows.sort("at.position", "doc.doc_id", "at.copy")
    return rows.select("doc.*", *(F.col(f"at.{c}").alias(n) for c, n in names.items()))
