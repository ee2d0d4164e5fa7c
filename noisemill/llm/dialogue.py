"""Repair of conversations at least cost, by dynamic programming over a grammar that they share.

A conversation becomes a string of symbols, one for each row's role and fault. Re-Pair finds rules for
frequent pairs of symbols over all conversations. Each rule has one transfer matrix between the states
of the wanted order of roles, in which sums are minima and products are sums; with every cost goes its
audit, a rope of the edits. Rules are evaluated bottom-up once, conversations as products of few symbols.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._support import discard, materialize

#: Faults of a row, in the order in which equal rows stand: the first of them is the one that isn't a duplicate.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
#: What a row costs to keep, to rerole, to delete; a truncated row that stays costs more; a new row.
REROLE, DELETE, UNFINISHED, INSERT = 1, 2, 5, 5
#: States of the order (s?(ua)+)?: at the start, after s, u and a. It may end in the first and the last.
STATES, ENDS = range(4), (0, 3)
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Symbols: role initials (o: any other), in upper case where the row is truncated; x must go.
SYMBOLS = "suaoSUAOx"
#: Code points of rules begin here.
FIRST_RULE = 0x100

Rope = tuple  # (length, letter) or (length, rope, rope)
EMPTY: Rope = (0, "")


def joined(a: Rope, b: Rope) -> Rope:
    return b if not a[0] else a if not b[0] else (a[0] + b[0], a, b)


def flat(rope: Rope) -> str:
    """A rope's letters."""
    out, stack = [], [rope]
    while stack:
        x = stack.pop()
        if len(x) == 2:
            out.append(x[1])
        else:
            stack += (x[2], x[1])
    return "".join(out)


def _better(a: tuple | None, b: tuple | None) -> tuple | None:
    """The cheaper of two (cost, rope), at equal costs the one whose letters come first.

    Of one stretch of rows, no audit of equal cost begins another, so what follows can't turn the order.
    """
    if a is None or b is None:
        return a or b
    if a[0] != b[0] or a[1] is b[1]:
        return a if a[0] <= b[0] else b
    return a if flat(a[1]) <= flat(b[1]) else b


def product(a: list, b: list) -> list:
    """First one stretch, then the other: for each two states the best way between them."""
    out = [[None] * 4 for _ in STATES]
    for i in STATES:
        for k in STATES:
            if a[i][k] is None:
                continue
            cost, rope = a[i][k]
            for j in STATES:
                if b[k][j] is not None:
                    out[i][j] = _better(out[i][j], (cost + b[k][j][0], joined(rope, b[k][j][1])))
    return out


def _inserts() -> list:
    """Any number of new rows, user's or assistant's."""
    one = [[None] * 4 for _ in STATES]
    for (i, role), j in STEPS.items():
        if role != "s":
            one[i][j] = (INSERT, (1, "I"))
    out = [[(0, EMPTY) if i == j else None for j in STATES] for i in STATES]
    for _ in range(len(STATES)):
        longer = product(out, one)
        out = [[_better(out[i][j], longer[i][j]) for j in STATES] for i in STATES]
    return out


INSERTS = _inserts()


@lru_cache(maxsize=None)
def terminal(symbol: str) -> list:
    """One row, after any number of new ones."""
    out = [[None] * 4 for _ in STATES]
    for i in STATES:
        out[i][i] = (DELETE, (1, "D"))
    if symbol != "x":
        more = UNFINISHED if symbol.isupper() else 0
        for (i, role), j in STEPS.items():
            if role == symbol.lower():
                out[i][j] = _better(out[i][j], (more, (1, "K")))
            if role != "s":
                out[i][j] = _better(out[i][j], (more + REROLE, (1, "R")))
    return product(INSERTS, out)


class Grammar:
    """Rules by rounds: each round's pairs, none of whose left symbols is another's right one."""

    def __init__(self, rounds: list[dict[str, str]]):
        self.rounds = rounds
        self.matrices: dict[str, list] = {s: terminal(s) for s in SYMBOLS}
        for rules in rounds:
            for pair, name in rules.items():
                self.matrices[name] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def parse(self, symbols: str) -> str:
        """The symbols with all rules applied, round by round, from the left."""
        for rules in self.rounds:
            out, at, end = [], 0, len(symbols)
            while at < end:
                name = rules.get(symbols[at : at + 2])
                out.append(name or symbols[at])
                at += 2 if name else 1
            symbols = "".join(out)
        return symbols

    def repair(self, symbols: str) -> tuple[int, str]:
        """Cost and audit of the cheapest edits of one conversation."""
        level = [self.matrices[s] for s in self.parse(symbols)] + [INSERTS]
        while len(level) > 1:
            level = [product(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        best = None
        for j in ENDS:
            best = _better(best, level[0][0][j])
        return best[0], flat(best[1])


def actions(audit: str) -> tuple[list[int], list[str | None]]:
    """For each row that the audit leaves, the row that it was (-1: new) and its new role, if any."""
    kept = [e for e in audit if e != "D"]
    at, row, roles = [], 0, []
    for e in audit:
        if e != "D":
            turn = len(at) - len(kept) % 2
            at.append(-1 if e == "I" else row)
            roles.append(None if e == "K" else ("user", "assistant")[turn % 2])
        row += e != "I"
    return at, roles


def learn(sequences: DataFrame, rounds: int = 16, a_round: int = 48, least: int = 2) -> Grammar:
    """A Re-Pair grammar of (symbols, n): strings and how often each occurs.

    A round counts the adjacent pairs of all strings and makes rules of the most frequent ones, up to
    ``a_round``, as long as they come ``least`` times or more; then all strings are rewritten. Rules so
    number ``rounds`` * ``a_round`` at most: they decide how fast conversations are repaired, not how.
    """
    found: list[dict[str, str]] = []
    name, table = FIRST_RULE, materialize(sequences.where(F.length("symbols") > 1), "sequences")
    for _ in range(rounds):
        places = F.sequence(F.lit(1), F.length("symbols") - 1)
        pairs = table.select(F.explode(F.transform(places, lambda at: F.substring("symbols", at, F.lit(2)))).alias("pair"), "n")
        counted = pairs.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        rules: dict[str, str] = {}
        left, right = set(), set()
        for r in counted.orderBy(F.col("n").desc(), "pair").limit(4 * a_round).collect():
            a, b = r.pair
            if len(rules) < a_round and not (a in right or b in left or a == b and (a in left or b in right)):
                rules[r.pair] = chr(name)
                left.add(a)
                right.add(b)
                name += 1
        if not rules:
            break
        found.append(rules)
        symbols = F.col("symbols")
        for pair, new in rules.items():
            symbols = F.replace(symbols, F.lit(pair), F.lit(new))
        shorter = table.select(symbols.alias("symbols"), "n").groupBy("symbols").agg(F.sum("n").alias("n"))
        again = materialize(shorter.where(F.length("symbols") > 1), "sequences")
        discard(table)
        table = again
    discard(table)
    return Grammar(found)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone), nulls of role and text as one space, damaged by a hash of conversation and turn.

    crc32 of ``conv_id:turn`` (a null as one space), modulo 20: 0 drops the row, which stays as ``gone``, so that its
    conversation is still known; 1 empties its text; 2 takes ``.!?`` out of it; 3 repeats it; 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    times = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), times.alias("_time")).drop("_time")


def faults(rows: DataFrame) -> DataFrame:
    """The rows with ``fault``: blank, duplicate (role and text seen earlier in the conversation), truncated, or fine."""
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    stripped = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(stripped == "", BLANK).when(seen, DUPLICATE).when(~stripped.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return rows.withColumn("fault", fault)


def _symbol(row: Column) -> Column:
    initial = F.substring(row["role"], 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(row["fault"] >= BLANK, "x").when(row["fault"] == TRUNCATED, F.upper(known)).otherwise(known)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of each conversation.

    ``rows``: (conv_id, turn, role, text), none of role and text null, and ``gone`` for rows that only say
    that a conversation exists. Rows go by turn, nulls first, then by role and text; equal rows are one
    and its duplicates. ``repaired`` holds (role, text). Of equally cheap edits those count whose audit
    is first in ASCII. A null conv_id is a conversation; one without rows has zeros and an empty audit;
    an empty table gives an empty one.

    A conversation's rows meet in one task, as its repaired form is one row; its rules are found and
    evaluated without its texts.
    """
    marked = faults(rows.repartition("conv_id"))
    row = F.when(~F.col("gone"), F.struct("turn", "role", "text", "fault"))
    whole = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    initial = lambda r: F.when(F.substring(r["role"], 1, 1).isin("s", "u", "a"), F.substring(r["role"], 1, 1)).otherwise("o")
    of = lambda f: F.array_join(F.transform("rows", f), "")
    whole = materialize(whole.select("conv_id", "rows", of(_symbol).alias("symbols"), of(initial).alias("initials")), "conversations")
    grammar = learn(whole.groupBy("symbols").agg(F.count("*").alias("n")))
    rounds = grammar.rounds
    kept: list[Grammar] = []

    @F.arrow_udf("struct<cost: long, audit: string, at: array<int>, role: array<string>>")
    def repaired(symbols: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Grammar(rounds))
        known: dict[str, tuple] = {}
        out = []
        for s in symbols.to_pylist():
            if s not in known:
                cost, audit = kept[0].repair(s)
                known[s] = (cost, audit, *actions(audit))
            out.append(dict(zip(("cost", "audit", "at", "role"), known[s], strict=True)))
        return pa.array(out, pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("at", pa.list_(pa.int32())), ("role", pa.list_(pa.string()))]))

    done = whole.withColumn("done", repaired("symbols"))
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    gaps = F.when(F.size(turns) > 0, F.array_max(turns).cast("long") - F.array_min(turns) + 1 - F.size(F.array_distinct(turns))).otherwise(0).cast("long")
    count = lambda f: F.size(F.filter("rows", lambda r: r["fault"] == f)).cast("long")
    legal = F.regexp_count("initials", F.lit("s(?=u)|u(?=a)|a(?=u)"))
    illegal = (F.greatest(F.length("initials") - 1, F.lit(0)) - legal).cast("long")
    old = lambda p, c: F.get(F.col("rows"), p["at"])[c]
    new = F.transform(F.arrays_zip("done.at", "done.role"), lambda p: F.struct(F.coalesce(p["role"], old(p, "role")).alias("role"), F.coalesce(old(p, "text"), F.lit("")).alias("text")))
    return done.select("conv_id", gaps.alias("gaps"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"), illegal.alias("illegal"), "done.cost", "done.audit", new.alias("repaired"))
