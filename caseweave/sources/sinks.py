"""Exports: CSV and JSON with nested values encoded, redaction first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import redact


def redacted(rows: DataFrame, alias: str | None) -> DataFrame:
    """rows with the protected alias replaced in every string, arrays of strings included."""
    if not alias:
        return rows
    cols = {}
    for f in rows.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols[f.name] = redact(F.col(f"`{f.name}`"), alias)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            cols[f.name] = F.transform(F.col(f"`{f.name}`"), lambda x: redact(x, alias))
    return rows.withColumns(cols) if cols else rows


def flat(rows: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON, for formats without them."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return rows.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in rows.schema.fields))


def export(rows: DataFrame, path: str, form: str = "csv", alias: str | None = None) -> None:
    """Write rows as CSV with a header and doubled quotes, or as JSON lines."""
    out = redacted(rows, alias)
    if form == "json":
        out.write.mode("overwrite").json(path)
    elif form == "csv":
        flat(out).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown form {form!r}")
