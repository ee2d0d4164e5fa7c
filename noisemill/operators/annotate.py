"""Language-model annotations: prompts out, JSON answers in, both as column expressions."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisemill.spec import Categorical, Numerical, Schema


def strip_fences(text: Column | str) -> Column:
    """What stands inside a Markdown code fence, if that is all of the text; else the text, trimmed."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    fence = r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$"
    return F.when(F.regexp_like(c, F.lit(fence)), F.trim(F.regexp_extract(c, fence, 1))).otherwise(c)


#: JSON's names of types of categories; a boolean is an integer too, so it comes first.
_JSON_TYPES = ((bool, "boolean"), (int, "integer"), (float, "number"))


def _json_type(a: Categorical) -> str:
    return next((k for t, k in _JSON_TYPES if isinstance(a.values[0], t)), "string")


def json_schema(schema: Schema) -> dict:
    """The schema of an answer: an object with a property for each attribute."""
    out = {}
    for name, a in schema.items():
        if isinstance(a, Categorical):
            kind = _json_type(a)
            out[name] = {"type": kind, "enum": [str(v) for v in a.values] if kind == "string" else list(a.values)}
        elif isinstance(a, Numerical):
            ends = {k: v for k, v in (("minimum", a.low), ("maximum", a.high)) if math.isfinite(v)}
            out[name] = {"type": "integer" if a.integer else "number", **ends}
        else:
            out[name] = {"type": "string"}
    return {"type": "object", "properties": out, "required": list(schema)}


def parse_answers(df: DataFrame, answer: str, schema: Schema) -> DataFrame:
    """``df`` with a column for each attribute, and how many of them the answer gave.

    What is no JSON object, lacks a key, has a null there, or a value that isn't the attribute's (none
    of its categories, no number, or one out of range), takes the attribute's default: the
    out-of-domain value, the least number (of an endless range, its first edge), or an empty text, and
    doesn't count. Categories keep their type, text unless all are numbers or booleans. Other keys are ignored.
    """
    parsed = F.try_parse_json(strip_fences(answer))
    out, got = [], F.lit(0)
    for name, a in schema.items():
        value, default = F.try_variant_get(parsed, f"$.{name}", "string"), F.lit("")
        if isinstance(a, Categorical):
            kind = _json_type(a)
            typed = value.try_cast({"boolean": "boolean", "integer": "long", "number": "double", "string": "string"}[kind])
            values = a.values if kind != "string" else tuple(map(str, a.values))
            value, default = F.when(typed.isin(*values), typed), F.lit(values[a.ood])
        elif isinstance(a, Numerical):
            number = value.try_cast("double")
            value, default = F.when(number.between(a.low, a.high), number), F.lit(float(a.low if math.isfinite(a.low) else a.spans()[0][0]))
        got = got + F.when(value.isNotNull(), 1).otherwise(0)
        out.append(F.coalesce(value, default).alias(name))
    return df.select("*", *out, got.alias("_fields_decoded"))


def annotation_prompt(text: Column | str, about: str, schema: Schema) -> Column:
    """Ask for one JSON object that gives each attribute one of its values."""
    features = "\n".join(f"- {n}: one of {', '.join(map(str, a.values))}" if isinstance(a, Categorical) else f"- {n}: a number from {a.low:g} to {a.high:g}" if isinstance(a, Numerical) else f"- {n}: text" for n, a in schema.items())
    head = f"Label the example below. Answer with a single JSON object with exactly these keys, and no other text.\n\nThe data: {about}\n\nKeys:\n{features}\n\nExample:\n"
    return F.concat(F.lit(head), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def generation_prompt(about: str, schema: Schema) -> Column:
    """Ask for a text with the attributes that the row has."""
    parts = [F.lit(f"Write one new example of this data: {about}\n\nIt has:\n")]
    for n in schema:
        parts += [F.lit(f"- {n}: "), F.coalesce(F.col(n).cast("string"), F.lit("unknown")), F.lit("\n")]
    return F.concat(*parts)


def ask(
    prompts: DataFrame,
    prompt: str,
    answer: str,
    backend: Callable[[list[str]], list[str | None]],
    chunk: int = 100,
    tries: int = 3,
    pause: float = 1.0,
) -> DataFrame:
    """``prompts`` with the backend's answers, asked for in chunks; a failed answer is empty text.

    The backend runs in the tasks; how many ask at once is how many tasks run. A chunk that raises, or
    gives another number of answers, is asked again after ``pause`` seconds, twice as long each time;
    after ``tries`` its prompts are asked one by one, and those that raise still have failed.
    """

    def once(texts: list[str]) -> list[str] | None:
        try:
            got = backend(texts)
        except Exception:  # whatever a backend raises is a failed answer
            return None
        return [x or "" for x in got] if len(got) == len(texts) else None

    def tried(texts: list[str]) -> list[str]:
        for k in range(tries):
            if (got := once(texts)) is not None:
                return got
            if k + 1 < tries:
                time.sleep(pause * 2**k)
        return [(once([x]) or [""])[0] for x in texts] if len(texts) > 1 else [""] * len(texts)

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            got: list[str] = []
            for at in range(0, len(texts), chunk):
                got += tried(list(texts.iloc[at : at + chunk]))
            yield pd.Series(got, index=texts.index, dtype="object")

    return prompts.withColumn(answer, answers(prompt))
