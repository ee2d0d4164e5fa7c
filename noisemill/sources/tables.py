"""CSV and Parquet in and out, schemas as YAML, models as Parquet with a JSON schema beside."""

from __future__ import annotations

import enum
import json
import math
from collections.abc import Iterable, Iterator
from typing import Annotated, Literal, get_args, get_origin

import numpy as np
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noisemill.plans.cliques import CliqueModel, JunctionTree
from noisemill.plans.synthesis import TreeModel
from noisemill.spec import Categorical, ForeignKey, FreeText, Numerical, OpenSet, Relations, Schema

SEPARATORS = {"tab": "\t", "pipe": "|", "comma": ",", "semicolon": ";", "space": " "}


def spark_schema(schema: Schema) -> T.StructType:
    """The types that a file's columns are read as."""
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    return T.StructType([T.StructField(n, kinds[type(a.values[0])] if isinstance(a, Categorical) else (T.LongType() if a.integer else T.DoubleType()) if isinstance(a, Numerical) else T.StringType()) for n, a in schema.items()])


def read_csv(spark: SparkSession, path: str, separator: str = "comma", names: list[str] | None = None, columns: int | None = None, schema: Schema | None = None) -> DataFrame:
    """A CSV table. With ``names`` or a number of ``columns`` (named 0, 1, ...) the file has no header
    line; with a schema, a value of the wrong type is an error."""
    if names and columns:
        raise ValueError("give names or a number of columns, not both")
    names = names or ([str(k) for k in range(columns)] if columns else None)
    reader = spark.read.option("sep", SEPARATORS[separator]).option("header", names is None)
    if schema is not None:
        return reader.option("mode", "FAILFAST").schema(spark_schema(schema)).csv(path)
    df = reader.csv(path)
    return df.toDF(*names) if names else df


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    (df.coalesce(files) if files else df).write.option("header", True).csv(path)


def infer_schema(df: DataFrame, rows: int = 1000) -> Schema:
    """A first guess from some rows, which is not private: whole numbers and decimals get the range
    that these rows show, texts are open, booleans have their two values; other types are dropped."""
    some = df.limit(rows)
    out: Schema = {}
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    ends = some.agg(*(F.min(c).cast("double").alias(f"{c}<") for c in numbers), *(F.max(c).cast("double").alias(f"{c}>") for c in numbers)).first() if numbers else None
    for f in df.schema:
        if f.name in numbers:
            low, high = ends[f"{f.name}<"] or 0.0, ends[f"{f.name}>"] or 0.0
            out[f.name] = Numerical(low, high if high > low else low + 1, integer=isinstance(f.dataType, T.IntegralType))
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = Categorical((False, True))
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = OpenSet()
    return out


def schema_to_dict(schema: Schema) -> dict:
    out = {}
    for name, a in schema.items():
        if isinstance(a, Categorical):
            out[name] = {"type": "categorical", "possible_values": list(a.values), "out_of_domain_index": a.ood, "description": a.description}
        elif isinstance(a, Numerical):
            out[name] = {"type": "numerical", "min_value": a.low, "max_value": a.high, "edges": list(a.edges), "dtype": "int" if a.integer else "float", "clip_to_range": a.clip, "interval_handling": a.decode, "sentinel": a.sentinel}
        elif isinstance(a, OpenSet):
            out[name] = {"type": "open_set", "default_value": a.default, "public_possible_values": list(a.public)}
        else:
            out[name] = {"type": "text", "max_tokens": a.max_tokens, "description": a.description}
    return out


def schema_from_dict(rows: dict) -> Schema:
    """Attributes by their ``type``, or, where none is given, by the keys that they have."""
    out: Schema = {}
    for name, x in rows.items():
        x = x or {}
        kind = x.get("type") or ("categorical" if "possible_values" in x else "numerical" if "min_value" in x else "text" if "max_tokens" in x else "open_set")
        if kind == "categorical":
            out[name] = Categorical(tuple(x["possible_values"]), x.get("out_of_domain_index", 0), x.get("description", ""))
        elif kind == "numerical":
            out[name] = Numerical(x["min_value"], x["max_value"], tuple(x.get("edges", ())), x.get("dtype", "float") == "int", x.get("clip_to_range", True), x.get("interval_handling", "midpoint"), x.get("sentinel"))
        elif kind == "open_set":
            out[name] = OpenSet(x.get("default_value", "<OOD>"), tuple(x.get("public_possible_values", ())))
        elif kind == "text":
            out[name] = FreeText(x.get("max_tokens", 256), x.get("description", ""))
        else:
            raise ValueError(f"{name}: unknown type {kind!r}")
    return out


def schema_to_yaml(schema: Schema) -> str:
    return yaml.safe_dump(schema_to_dict(schema), sort_keys=False)


def schema_from_yaml(text: str) -> Schema:
    return schema_from_dict(yaml.safe_load(text) or {})


def relations_to_yaml(relations: Relations) -> str:
    return yaml.safe_dump({"tables": {n: schema_to_dict(s) for n, s in relations.tables.items()}, "foreign_keys": [vars(k) for k in relations.keys]}, sort_keys=False)


def relations_from_yaml(text: str) -> Relations:
    x = yaml.safe_load(text)
    for name, columns in x["tables"].items():
        if bad := [c for c, a in columns.items() if "type" not in (a or {})]:
            raise ValueError(f"{name}: columns without a type: {bad}")
    return Relations(tuple(ForeignKey(**k) for k in x["foreign_keys"]), {n: schema_from_dict(s) for n, s in x["tables"].items()})


def save_model(spark: SparkSession, model: TreeModel | CliqueModel, path: str) -> None:
    """One Parquet row for each column's or clique's shares, and a row with the rest as JSON."""
    head = {"schema": schema_to_dict(model.schema), "total": model.total, "log": model.log}
    if isinstance(model, CliqueModel):
        head |= {"cliques": model.tree.cliques, "parents": model.tree.parents}
        shares = {str(k): x for k, x in enumerate(model.beliefs)}
    else:
        head |= {"order": model.order, "parents": model.parents}
        shares = model.shares
    rows = [("", [], [], json.dumps(head)), *((c, list(s.shape), s.ravel().tolist(), "") for c, s in shares.items())]
    spark.createDataFrame(rows, "column string, shape array<int>, shares array<double>, head string").coalesce(1).write.parquet(path)


def write_log(spark: SparkSession, model: TreeModel | CliqueModel, path: str) -> None:
    """The fit's rounds as text, one JSON object a line; first a line of the total and the columns' order."""
    parents = model.tree.parents if isinstance(model, CliqueModel) else model.parents
    lines = [{"total": model.total, "order": model.order, "parents": parents}, *model.log]
    spark.createDataFrame([(json.dumps(x),) for x in lines], "value string").coalesce(1).write.text(path)


def load_model(spark: SparkSession, path: str) -> TreeModel | CliqueModel:
    rows = spark.read.parquet(path).collect()
    head = json.loads(next(r["head"] for r in rows if not r["column"]))
    shares = {r["column"]: np.array(r["shares"]).reshape(r["shape"]) for r in rows if r["column"]}
    if "cliques" in head:
        tree = JunctionTree(tuple(map(tuple, head["cliques"])), tuple(head["parents"]))
        return CliqueModel(schema_from_dict(head["schema"]), head["total"], tree, [shares[str(k)] for k in range(len(tree.cliques))], head["log"])
    return TreeModel(schema_from_dict(head["schema"]), head["total"], head["order"], head["parents"], shares, head["log"])


def _bounds(kind: type, marks: list) -> tuple[float, float] | None:
    """Both ends of a bounded number, from marks with ge, gt, le or lt."""
    bound = {k: getattr(m, k) for m in marks for k in ("ge", "gt", "le", "lt") if getattr(m, k, None) is not None}
    if not {"ge", "gt"} & bound.keys() or not {"le", "lt"} & bound.keys():
        return None
    low = bound["ge"] if "ge" in bound else bound["gt"] + 1 if kind is int else math.nextafter(bound["gt"], math.inf)
    high = bound["le"] if "le" in bound else bound["lt"] - 1 if kind is int else math.nextafter(bound["lt"], -math.inf)
    return low, high


def _choices(kind: type) -> tuple[str, ...] | None:
    if kind is bool:
        return ("False", "True")
    if get_origin(kind) is Literal:
        return tuple(str(v) for v in get_args(kind))
    return tuple(str(e.value) for e in kind) if isinstance(kind, type) and issubclass(kind, enum.Enum) else None


def _plain(kind: type) -> tuple[type, list, bool]:
    """The type below Optional and Annotated, its marks, and whether None is allowed."""
    marks, optional = [], type(None) in get_args(kind)
    if optional:
        kind = next(a for a in get_args(kind) if a is not type(None))
    if get_origin(kind) is Annotated:
        kind, *more = get_args(kind)
        marks = [m for x in more for m in (x, *getattr(x, "metadata", ()))]
    return kind, marks, optional


def schema_from_model(model: type) -> Schema:
    """The schema of a pydantic model: bounded numbers, Literal, Enum and bool fields as text
    categories. An optional number isn't clipped; an optional category has the value None."""
    out: Schema = {}
    for name, f in model.model_fields.items():
        kind, more, optional = _plain(f.annotation)
        marks = [*f.metadata, *more]
        if kind in (int, float) and (ends := _bounds(kind, marks)):
            out[name] = Numerical(*ends, integer=kind is int, clip=not optional)
        elif values := _choices(kind):
            out[name] = Categorical((*values, "None") if optional else values)
        else:
            raise ValueError(f"{name}: {kind} has neither bounds nor declared values")
    return out


def from_records(spark: SparkSession, records: Iterable, schema: Schema) -> DataFrame:
    """Objects with ``model_dump()``, or mappings, as a table: categories as they are or as text,
    missing numbers the least."""
    out = []
    for r in records:
        x = r.model_dump() if hasattr(r, "model_dump") else dict(r)
        row = []
        for name, a in schema.items():
            v = x.get(name)
            v = getattr(v, "value", v)
            row.append((int if a.integer else float)(a.low if v is None else v) if isinstance(a, Numerical) else type(a.values[0])(v) if isinstance(a, Categorical) and v is not None else None if v is None else str(v))
        out.append(tuple(row))
    return spark.createDataFrame(out, spark_schema(schema))


def to_records(df: DataFrame, model: type) -> Iterator:
    """The rows as objects, fetched partition by partition; numbers of the model's int fields are rounded."""
    whole = {n for n, f in getattr(model, "model_fields", {}).items() if _plain(f.annotation)[0] is int}
    for r in df.toLocalIterator(prefetchPartitions=True):
        row = {k: None if v == "None" or isinstance(v, float) and v != v else v for k, v in r.asDict().items()}
        yield model(**{k: round(v) if k in whole and isinstance(v, float) else v for k, v in row.items()})
