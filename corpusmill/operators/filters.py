"""Metadata filters compiled to a Column, so that Catalyst types them and pushes them to the scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("eq", "neq", "gt", "lt", "contains", "in")


@dataclass(frozen=True)
class MetadataFilter:
    field: str
    operator: str
    value: Any


def compile_filter(f: MetadataFilter, schema: T.StructType, contains: str = "literal") -> Column:
    """One predicate, with SQL null logic. `contains` on strings is literal and case-sensitive; modes like and ilike exist."""
    if f.field not in schema.fieldNames():
        raise ValueError(f"unknown field {f.field!r}")
    col, v = F.col(f"`{f.field}`"), f.value
    match f.operator:
        case "eq":
            return col == F.lit(v)
        case "neq":
            return col != F.lit(v)
        case "gt":
            return col > F.lit(v)
        case "lt":
            return col < F.lit(v)
        case "contains":
            if not isinstance(v, str) or not isinstance(schema[f.field].dataType, T.StringType):
                return col == F.lit(v)
            if contains == "literal":
                return col.contains(v)
            if contains == "like":
                return col.like(f"%{v}%")
            if contains == "ilike":
                escaped = v.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
                return col.ilike(f"%{escaped}%")
            raise ValueError(f"unknown contains mode {contains!r}")
        case "in":
            if not isinstance(v, list | tuple | set | frozenset):
                raise ValueError("operator 'in' needs a list")
            return col.isin(*v) if v else F.lit(False)
    raise ValueError(f"unknown operator {f.operator!r}")


def compile_filters(filters: list[MetadataFilter], schema: T.StructType, contains: str = "literal") -> Column:
    """All filters together; without filters true."""
    return reduce(lambda a, b: a & b, (compile_filter(f, schema, contains) for f in filters), F.lit(True))


def apply(df: DataFrame, filters: list[MetadataFilter] | None, contains: str = "literal") -> DataFrame:
    return df.where(compile_filters(filters, df.schema, contains)) if filters else df
