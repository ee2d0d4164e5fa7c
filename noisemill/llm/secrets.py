"""Secret scans: trigram queries derived from the rules, postings intersected, candidates verified."""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as regex_tree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import greatest_before, let, pieces, sums_before

_MOST = 16  # strings that a derivation follows exactly before it gives them up


@dataclass(frozen=True)
class Rule:
    """What to find: a regular expression of the kind that Java and Python read alike, the group
    whose length counts (0: the whole match), and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are fixed by contract; hex runs and access keys have their length in the
#: pattern, which there is the same as dropping shorter runs.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def _trigrams(strings: set[str]) -> list[frozenset[str]] | None:
    """An alternative for each string, or None where one of them is too short to ask for any."""
    if any(len(s) < 3 for s in strings):
        return None
    return sorted({frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}, key=sorted)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """The trigrams, lower-case, that a text with a match must hold: every clause has an
    alternative all of whose trigrams are there. No clause: the rule scans every text."""
    clauses: list[list[frozenset[str]]] = []
    strings = {""}

    def give_up():
        nonlocal strings
        if (found := _trigrams(strings)) is not None:
            clauses.append(found)
        strings = {""}

    def follow(more: set[str]):
        nonlocal strings
        wider = {a + b for a in strings for b in more}
        if len(wider) > _MOST:
            give_up()
            wider = more
        strings = wider

    def exact(items) -> set[str] | None:
        """All strings that a part matches, if they are few."""
        out = {""}
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                more = {chr(arg).lower()}
            elif name == "SUBPATTERN":
                more = exact(arg[3])
            elif name == "BRANCH":
                each = [exact(x) for x in arg[1]]
                more = None if None in each else set().union(*each)
            elif name == "MAX_REPEAT" and arg[1] <= 2:
                one = exact(arg[2])
                more = None if one is None else set().union(*({s * n for s in one} for n in range(arg[0], arg[1] + 1)))
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                more = {chr(a).lower() for _, a in arg}
            else:
                more = None
            if more is None or len(more) * len(out) > _MOST:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(items):
        for item in items:
            if (found := exact([item])) is not None:
                follow(found)
            elif str(item[0]) == "SUBPATTERN":
                walk(item[1][3])
            else:
                give_up()

    walk(regex_tree.parse(pattern))
    give_up()
    return clauses


def _grams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for one in clause for g in one})


def postings(texts: DataFrame, rules: tuple[Rule, ...] = RULES, block_texts: int = 4096) -> DataFrame:
    """(block, gram, keys): the posting lists of the trigrams that the rules ask for.

    A list holds the keys of the texts with the trigram, each once. Lists are cut into blocks of about
    ``block_texts`` texts by the key, so that none grows with the table; the texts are counted for that.
    """
    grams = _grams(rules)
    blocks = -(-max(texts.count(), 1) // block_texts)
    lower = texts.select("key", F.lower("text").alias("lower"))
    held = F.array_compact(F.array(*(F.when(F.contains("lower", F.lit(g)), F.lit(g)) for g in grams)))
    each = lower.select(F.pmod("key", F.lit(blocks)).alias("block"), F.explode(held).alias("gram"), "key")
    return each.groupBy("block", "gram").agg(F.collect_set("key").alias("keys"))


def _intersected(lists: list[Column]) -> Column:
    """What all posting lists hold, from the shortest on."""
    if len(lists) == 1:
        return lists[0]
    by_size = F.array_sort(F.array(*lists), lambda a, b: F.size(a) - F.size(b))
    return let(by_size, lambda v: F.aggregate(F.slice(v, 2, len(lists) - 1), F.element_at(v, 1), lambda have, more: F.array_intersect(have, more)))


def _united(lists: list[Column]) -> Column:
    return lists[0] if len(lists) == 1 else F.array_distinct(F.concat(*lists))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, may_<kind> ...) of the texts that at least one rule may match: in each block, the rule's
    Boolean query over the posting lists, an alternative as the intersection of its trigrams' lists."""
    asked = [(k, r) for k, r in enumerate(rules) if trigram_query(r.pattern)]
    grams = sorted({g for _, r in asked for clause in trigram_query(r.pattern) for one in clause for g in one})
    none = F.array().cast("array<bigint>")
    lists = {g: f"list{n}" for n, g in enumerate(grams)}
    block = index.groupBy("block").agg(*(F.first(F.when(F.col("gram") == g, F.col("keys")), ignorenulls=True).alias(name) for g, name in lists.items()))
    block = block.select(*(F.coalesce(name, none).alias(name) for name in lists.values()))

    def named(rule: Rule) -> Column:
        clauses = [_united([_intersected([F.col(lists[g]) for g in sorted(one)]) for one in clause]) for clause in trigram_query(rule.pattern)]
        return _intersected(clauses)

    each = F.array(*(F.struct(named(r).alias("keys"), F.lit(k).alias("rule")) for k, r in asked))
    found = block.select(F.inline(each)).select(F.explode("keys").alias("key"), "rule")
    return found.groupBy("key").agg(*(F.bool_or(F.col("rule") == k).alias(f"may_{r.kind}") for k, r in asked))


_FILTER_WORDS = 1 << 17  # of 64 bits: 1 MB, whatever the number of candidates


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_FILTER_WORDS * 64))


def _filter(may: DataFrame) -> DataFrame:
    """(word, bits): a bit for each candidate's hash, in at most ``_FILTER_WORDS`` rows."""
    place = may.select(_place(F.col("key")).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    return place.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


_SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _spans(rule: Rule, order: int) -> Column:
    """The rule's matches in ``text``, leftmost and non-overlapping, as sorted structs.

    Regular expressions give no places here, but the text between matches does: a match starts
    after all gaps and matches before it. Lengths and places are in code points.
    """
    pattern = F.lit(rule.pattern)
    whole = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length)
    gaps = F.transform(F.split("text", rule.pattern, -1), F.length)
    counted = F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.length)
    rows = F.filter(F.arrays_zip(whole.alias("n"), gaps.alias("gap"), counted.alias("counted")), lambda x: x["n"].isNotNull())

    def placed(x: Column, at: Column) -> Column:
        start = at + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + x["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(span.alias("span"), x["counted"].alias("counted"))

    def kept(found: Column) -> Column:
        at = sums_before(F.transform(found, lambda x: x["gap"] + x["n"]))
        long = F.filter(F.zip_with(found, at, placed), lambda x: x["counted"] >= rule.least)
        return F.transform(long, lambda x: x["span"])

    return F.when(F.regexp_like("text", pattern), let(rows, kept).cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _found(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, text, spans): each row of ``docs`` as a struct, its text, null as empty, and the secrets in it."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    texts = docs.select(whole, F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("row.doc_id", "text"))
    none = F.array().cast(_SPANS)
    asked = {r.kind for r in rules if trigram_query(r.pattern)}

    def spans(df: DataFrame, candidate: bool) -> DataFrame:
        each = []
        for k, rule in enumerate(rules):
            if rule.kind not in asked:
                each.append(_spans(rule, k))
            elif candidate:
                each.append(F.when(F.coalesce(F.col(f"may_{rule.kind}"), F.lit(False)), _spans(rule, k)).otherwise(none))
        return df.select("row", "text", F.array_sort(F.concat(none, *each)).alias("spans"))

    if not asked:
        return spans(texts, False)
    may = candidates(postings(texts.select("key", "text"), rules), rules)
    # only texts that the filter lets pass travel to the candidates; it errs on the side of passing
    place = _place(F.col("key"))
    marked = texts.withColumn("word", F.floor(place / 64)).join(F.broadcast(_filter(may)), "word", "left")
    passes = F.coalesce(F.call_function("bit_get", "bits", (place % 64).cast("int")) == 1, F.lit(False))
    likely = marked.where(passes).select("row", "text", "key").join(may, "key", "left")
    return spans(likely, True).unionByName(spans(marked.where(~passes), False))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with ``spans``: an array of (start, ord, end, kind), by start, then in
    the rules' order; places in code points, ends exclusive.

    A rule with mandatory trigrams is verified only on texts that its posting lists' intersection
    names; a rule without scans every text. Lists hold hashes of id and text, so equal rows share an
    entry and a hash shared by chance only costs a verification. A filter of fixed size keeps other texts
    from being shuffled. ``docs`` is read for the count, the lists and the verification, so its rows should repeat themselves. A null text is empty
    here and stays null in the output; other columns stay as they are, but a column ``spans`` gives way.
    Repeated rows stay as often as they are there; an empty table gives none; a text of any length is scanned whole.
    """
    names = [c for c in docs.columns if c.lower() != "spans"]
    return _found(docs, rules).select(*(F.col(f"row.`{c}`") for c in names), "spans")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret replaced by <kind>; overlapping spans go as one, under the first kind.

    A column n_chars follows the text. Texts without secrets, and null ones, stay as they are, and so
    do all other columns, whatever their names.
    """
    found = _found(docs, rules)
    # of each span the text from the end of all before it; spans that begin inside others have none
    last = greatest_before(F.transform("spans", lambda s: s["end"]))
    shown = F.zip_with("spans", last, lambda s, at: F.struct(at.alias("start"), s["start"].alias("end"), s["kind"].alias("kind")))

    def clean(v: Column) -> Column:
        kept = F.zip_with(pieces(F.col("text"), v), v, lambda t, s: F.concat(t, F.lit("<"), s["kind"], F.lit(">")))
        end = F.array_max(F.transform("spans", lambda s: s["end"]))
        return F.concat(F.array_join(kept, ""), F.substring("text", end + 1, F.length("text") - end))

    hidden = let(F.filter(shown, lambda s: s["end"] >= s["start"]), clean)
    some = F.size("spans") > 0
    found = found.select("row", some.alias("some"), F.when(some, hidden).otherwise(F.col("row.text")).alias("text"))
    out = []
    for c in docs.columns:
        column = F.col(f"row.`{c}`")
        if c == "text":
            column = F.col("text").alias("text")
        elif c == "n_chars":
            column = F.when(F.col("some"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(column).alias("n_chars")
        out.append(column)
    return found.select(*out)
