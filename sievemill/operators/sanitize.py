"""Sanitising of report rows: strings escaped, home folders masked, unsafe keys dropped."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.functions.text import json_escape, mask_home

#: Keys that no object may have, and how deep values are followed.
UNSAFE = ("__proto__", "constructor", "prototype")
MAX_DEPTH = 50


def safe_map(values: Column) -> Column:
    """A map without unsafe keys."""
    return F.map_filter(values, lambda k, v: ~k.isin(*UNSAFE))


def escaped(column: Column, kind: T.DataType) -> Column:
    """Every string in a value of any declared type, escaped."""
    if isinstance(kind, T.StringType):
        return json_escape(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: escaped(x, kind.elementType))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(safe_map(column)), lambda e: F.struct(escaped(e["key"], kind.keyType).alias("key"), escaped(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(pairs)
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[escaped(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return column


def sanitized(rows: DataFrame, paths: tuple[str, ...] = ()) -> DataFrame:
    """All columns escaped; home folders masked in those named in ``paths``."""
    out = [F.col(f.name) for f in rows.schema]
    masked = [mask_home(c) if f.name in paths else c for f, c in zip(rows.schema, out)]
    return rows.select(*[escaped(c, f.dataType).alias(f.name) for f, c in zip(rows.schema, masked)])


def _safe(value: Any, depth: int = 0) -> Any:
    if depth > MAX_DEPTH:
        return "[Max depth exceeded]"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)[1:-1]
    if isinstance(value, list):
        return [_safe(v, depth + 1) for v in value]
    if isinstance(value, dict):
        return {_safe(k): _safe(v, depth + 1) for k, v in value.items() if k not in UNSAFE}
    return value


@F.pandas_udf(T.StringType())
def safe_json(values: pd.Series) -> pd.Series:
    """JSON values of no fixed type, sanitised at every depth; what is not JSON becomes null."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_safe(json.loads(text)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return values.map(one)


#: What is kept of an environment.
ENVIRONMENT = {"os": ("platform", "release", "version", "arch"), "runtime": ("spark", "python"), "node": ("version", "runtime")}


def environment(rows: DataFrame) -> DataFrame:
    """An environment table with only the known fields of known sections, escaped."""
    kept = []
    for f in rows.schema:
        if f.name in ENVIRONMENT and isinstance(f.dataType, T.StructType):
            kept.append(F.struct(*[F.col(f.name)[n].alias(n) for n in ENVIRONMENT[f.name] if n in f.dataType.names]).alias(f.name))
        elif f.name in ("ci", "packageManager"):
            kept.append(F.col(f.name))
    return sanitized(rows.select(*kept))
