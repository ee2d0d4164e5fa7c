"""Chat formatting: layouts told apart by schema fingerprints, one reversible template."""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._support import free_name
from .arrays import let, pieces, sums_before

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping, chosen by the hash of the nested field ``paths`` that it reads.

    Either ``items`` is the path of an array whose elements have a role and a text field, or ``fields``
    lists (role, path) in the order of the turns; an empty text there makes no turn. With neither,
    each row is a turn. ``names``: how the layout names other roles (theirs, ours).
    """

    name: str
    paths: tuple[str, ...]
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    names: tuple[tuple[str, str], ...] = ()


def _items(name: str, items: str, role: str, text: str, names: tuple[tuple[str, str], ...] = ()) -> Layout:
    return Layout(name, (f"{items}[].{role}", f"{items}[].{text}"), items, role, text, names=names)


def _fields(name: str, *fields: tuple[str, str]) -> Layout:
    return Layout(name, tuple(p for _, p in fields), fields=fields)


_MODELS = (("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("human", "user"))

#: Layouts of records that hold a conversation each.
LAYOUTS = (
    _items("messages", "messages", "role", "content", _MODELS),
    _items("conversations", "conversations", "from", "value", _MODELS),
    _items("turns", "turns", "role", "text"),
    _fields("instruction", ("user", "instruction"), ("assistant", "output")),
    _fields("instruction_input", ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    _fields("prompt_response", ("user", "prompt"), ("assistant", "response")),
    _fields("prompt_completion", ("user", "prompt"), ("assistant", "completion")),
    _fields("system_prompt_response", ("system", "system"), ("user", "prompt"), ("assistant", "response")),
    _fields("question_answer", ("user", "question"), ("assistant", "answer")),
)

#: Layouts of tables with a row for each turn.
ROW_LAYOUTS = (Layout("turn_rows", ("conv_id", "role", "text", "turn"), role="role", text="text"),)


def paths_of(schema: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type, sorted; [] marks the elements of an array."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return paths_of(schema.elementType, f"{at}[]")
    return [at]


def _known(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for k in layouts for p in k.paths})


def fingerprint_of(paths: list[str] | tuple[str, ...]) -> int:
    """The hash of field paths, as Spark's ``xxhash64`` has it."""
    unsigned = xxhash.xxh64_intdigest(",".join(sorted(paths)).encode(), 42)
    return unsigned - (1 << 64) if unsigned >> 63 else unsigned


def _holds(payload: Column, path: str) -> Column:
    """Whether a variant has the path; an empty array has every path of its elements."""
    if "[]." not in path:
        return F.try_variant_get(payload, f"$.{path}", "variant").isNotNull()
    items, leaf = path.split("[].")
    each = F.try_variant_get(payload, f"$.{items}", "array<variant>")
    held = F.exists(each, lambda x: F.try_variant_get(x, f"$.{leaf}", "variant").isNotNull())
    return each.isNotNull() & ((F.size(each) == 0) | held)


def fingerprint(payload: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of those nested field paths of a variant that layouts read; other fields don't count."""
    held = F.array(*(F.when(_holds(payload, p), F.lit(p)) for p in _known(layouts)))
    return F.xxhash64(F.array_join(F.array_compact(held), ","))


def _chosen(print_: Column, layouts: tuple[Layout, ...], value) -> Column:
    """``value`` of the layout whose paths have the fingerprint; null for an unknown one."""
    out = F.lit(None)
    for k in layouts:
        out = F.when(print_ == F.lit(fingerprint_of(k.paths)), value(k)).otherwise(out)
    return out


def _role(role: Column, names: tuple[tuple[str, str], ...]) -> Column:
    out = F.coalesce(role, F.lit(""))
    for theirs, ours in names:
        out = F.when(F.lower(role) == theirs, F.lit(ours)).otherwise(out)
    return out


def _from_items(items: Column, k: Layout) -> Column:
    turn = lambda x: F.struct(_role(x[k.role], k.names).alias("role"), F.coalesce(x[k.text], F.lit("")).alias("text"))
    return F.transform(items, turn).cast(_TURNS)


def _from_fields(values: list[tuple[str, Column]]) -> Column:
    each = [F.struct(F.lit(r).alias("role"), F.coalesce(v, F.lit("")).alias("text")) for r, v in values]
    return F.filter(F.array(*each), lambda t: F.length(t["text"]) > 0).cast(_TURNS)


def turns_from_json(rows: DataFrame, column: str = "payload") -> DataFrame:
    """``rows`` with ``layout`` and ``turns`` read from a column of JSON objects of any layouts.

    Each object's fingerprint selects its mapping; fields that no layout reads don't matter. What is
    no JSON or has no known fingerprint gets a null layout and no turns: nothing is guessed. An
    empty array has no turns. Columns ``layout`` and ``turns`` give way, all others stay.
    """
    names = [c for c in rows.columns if c not in ("layout", "turns")]
    value, print_ = free_name("value", rows.columns), free_name("print", rows.columns)
    parsed = rows.withColumn(value, F.try_parse_json(F.col(column)))
    parsed = parsed.withColumn(print_, F.when(F.col(value).isNotNull(), fingerprint(F.col(value))))

    def turns(k: Layout) -> Column:
        if k.items:
            kind = f"array<struct<{k.role}:string,{k.text}:string>>"
            return _from_items(F.try_variant_get(value, f"$.{k.items}", kind), k)
        return _from_fields([(r, F.try_variant_get(value, f"$.{p}", "string")) for r, p in k.fields])

    layout = _chosen(F.col(print_), LAYOUTS, lambda k: F.lit(k.name)).cast("string")
    found = F.coalesce(_chosen(F.col(print_), LAYOUTS, turns), F.array().cast(_TURNS))
    return parsed.select(*names, layout.alias("layout"), found.alias("turns"))


def layout_of(schema: T.StructType) -> Layout:
    """The layout that the fingerprint of a table's schema selects: one of rows first, then of records."""
    paths = set(paths_of(schema))
    for layouts in (ROW_LAYOUTS, LAYOUTS):
        by_print = {fingerprint_of(k.paths): k for k in layouts}
        found = by_print.get(fingerprint_of([p for p in _known(layouts) if p in paths]))
        if found:
            return found
    raise ValueError(f"no layout has the paths {sorted(paths)}")


def turns_from_columns(rows: DataFrame) -> DataFrame:
    """The same for a typed table: its schema's fingerprint selects one mapping for all rows.

    A table with a row for each turn (``ROW_LAYOUTS``; more columns are ignored) is gathered by
    conversation, turns by place, then role, then text; nulls are empty, and first. An unknown
    schema is an error: no row could be read.
    """
    k = layout_of(rows.schema)
    if k in ROW_LAYOUTS:
        one = F.struct("turn", F.coalesce(k.role, F.lit("")).alias("role"), F.coalesce(k.text, F.lit("")).alias("text"))
        whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
        turns = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return whole.select("conv_id", F.lit(k.name).alias("layout"), turns.alias("turns"))
    turns = _from_items(F.col(k.items), k) if k.items else _from_fields([(r, F.col(p)) for r, p in k.fields])
    names = [c for c in rows.columns if c == k.items or c not in ("layout", "turns")]
    kept = [F.col(f"`{c}`") for c in names if c not in ("layout", "turns")]
    return rows.select(*kept, F.lit(k.name).alias("layout"), turns.alias("turns"))


def _fits(turns: Column, k: Layout) -> Column:
    """Whether a layout can hold the turns so that they read back the same."""
    if k.fields:
        roles = F.array(*(F.lit(r) for r, _ in k.fields))
        return (F.transform(turns, lambda t: t["role"]) == roles) & F.forall(turns, lambda t: F.length(t["text"]) > 0)
    foreign = [theirs for theirs, _ in k.names]
    return F.forall(turns, lambda t: ~F.lower(t["role"]).isin(foreign)) if foreign else F.lit(True)


def payload_of(turns: Column, k: Layout) -> Column:
    """The turns as a JSON object of a layout that can hold them."""
    if k.fields:
        return F.to_json(F.struct(*(F.get(turns, n)["text"].alias(p) for n, (_, p) in enumerate(k.fields))))

    def item(t: Column) -> Column:
        role = t["role"]
        for theirs, ours in k.names:
            role = F.when(t["role"] == ours, F.lit(theirs)).otherwise(role)
        return F.struct(role.alias(k.role), t["text"].alias(k.text))

    return F.to_json(F.struct(F.transform(turns, item).alias(k.items)))


#: Conversations with more characters stay typed: a variant has a greatest size.
LARGEST_PAYLOAD = 1 << 20


def payloads(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """``rows`` with ``payload``: the turns as JSON objects of many layouts, dealt by a hash of ``key``
    among those that can hold them; null where there are over ``LARGEST_PAYLOAD`` characters."""
    able = F.array_compact(F.array(*(F.when(_fits(F.col("turns"), k), F.lit(n)) for n, k in enumerate(LAYOUTS))))
    choice = let(able, lambda v: F.element_at(v, (F.pmod(F.xxhash64(key), F.size(v)) + 1).cast("int")))
    payload, choice_ = F.lit(None).cast("string"), free_name("choice", rows.columns)
    for n, k in enumerate(LAYOUTS):
        payload = F.when(F.col(choice_) == n, payload_of(F.col("turns"), k)).otherwise(payload)
    size = F.aggregate(F.transform("turns", lambda t: F.length(t["role"]) + F.length(t["text"])), F.lit(0).cast("long"), lambda a, b: a + b)
    dealt = rows.withColumn(choice_, F.when(size <= LARGEST_PAYLOAD, choice))
    return dealt.withColumn("payload", payload).drop(choice_)


def escape(text: Column) -> Column:
    """No control string is left: a backslash goes before each backslash and each | after <."""
    return F.regexp_replace(text, r"\\|(?<=<)\|", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """``rows`` with ``formatted`` and ``loss_spans``.

    A turn is <|start|>role<|sep|>text<|end|>, role and text escaped. ``loss_spans`` are the
    (start, end) of the texts of role ``learn``, in code points of ``formatted``.
    """

    def marked(t: Column) -> Column:
        return F.struct((t["role"] == learn).alias("learn"), escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))

    def placed(t: Column, at: Column) -> Column:
        start = at + F.lit(len(START) + len(SEP)) + F.length(t["role"])
        return F.struct(t["learn"].alias("learn"), start.alias("start"), (start + F.length(t["text"])).alias("end"))

    def spans(turns: Column) -> Column:
        marks = len(START) + len(SEP) + len(END)
        at = sums_before(F.transform(turns, lambda t: F.length(t["role"]) + F.length(t["text"]) + marks))
        learned = F.filter(F.zip_with(turns, at, placed), lambda s: s["learn"])
        return F.transform(learned, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def whole(turns: Column) -> Column:
        each = F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END)))
        return F.struct(F.array_join(each, "").alias("formatted"), spans(turns).alias("loss_spans"))

    done = free_name("done", rows.columns)
    names = [f"`{c}`" for c in rows.columns if c not in ("formatted", "loss_spans")]
    return rows.withColumn(done, let(F.transform("turns", marked), whole)).select(*names, f"{done}.formatted", f"{done}.loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as they were."""
    parts = F.slice(F.split(formatted, r"<\|start\|>", -1), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|start\|>", -1)) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, SEP, 1)
        text = F.substring(p, F.length(role) + len(SEP) + 1, F.length(p) - F.length(role) - len(SEP) - len(END))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was."""
    return F.array_join(F.transform(pieces(formatted, spans), unescape), "")
