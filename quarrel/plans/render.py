"""Results as text: client types, canonical JSON for nested values, rows for clients."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrel.values import number_text

#: Client type of each Spark type (fixed values); what isn't listed is text.
CLIENT_TYPES = {
    "boolean": "bool", "tinyint": "int2", "smallint": "int2", "int": "int4", "bigint": "int8", "float": "float4", "double": "float8",
    "binary": "bytea", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "string": "text",
}


def client_type(kind: T.DataType) -> str:
    return "numeric" if isinstance(kind, T.DecimalType) else CLIENT_TYPES.get(kind.simpleString(), "text")


def described(df: DataFrame) -> list[tuple[str, str]]:
    """(name, client type) of a result's columns; nothing runs."""
    return [(f.name, client_type(f.dataType)) for f in df.schema]


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quoted(text: str) -> str:
    return '"' + "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in text) + '"'


def rfc3339(t: datetime) -> str:
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    text = t.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    if t.microsecond:
        text += f".{t.microsecond:06d}" if t.microsecond % 1000 else f".{t.microsecond // 1000:03d}"
    return text + "+00:00"


def json_text(v: Any) -> str:
    """Canonical JSON of a collected value: fields in order with nulls kept, no NaN or infinity, bytes in hex, times as RFC 3339."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return number_text(v) if v == v and abs(v) != float("inf") else "null"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, Decimal):
        return format(v, "f")
    if isinstance(v, (bytes, bytearray)):
        return quoted(bytes(v).hex())
    if isinstance(v, datetime):
        return quoted(rfc3339(v))
    if isinstance(v, date):
        return quoted(v.isoformat())
    if isinstance(v, Row):
        return "{" + ",".join(f"{quoted(k)}:{json_text(x)}" for k, x in zip(v.__fields__, v, strict=True)) + "}"
    if isinstance(v, dict):
        return "{" + ",".join(f"{quoted(str(k))}:{json_text(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(json_text, v)) + "]"
    return quoted(str(v))


def _leafed(c: Column, kind: T.DataType) -> Column:
    """The column with leaves that ``to_json`` would render otherwise made into what it renders right."""
    if isinstance(kind, T.StructType):
        parts = [_leafed(c.getField(f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _leafed(x, kind.elementType))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, T.TimestampType):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        part = F.date_format(c, "SSSSSS")
        return F.concat(whole, F.when(part == "000000", "").when(part.endswith("000"), F.concat(F.lit("."), F.substring(part, 1, 3))).otherwise(F.concat(F.lit("."), part)), F.lit("+00:00"))
    return c


def json_column(name: str, kind: T.DataType) -> Column:
    """A nested column as canonical JSON text, as an expression (doubles keep Spark's spelling)."""
    return F.to_json(_leafed(F.col(f"`{name}`"), kind), {"ignoreNullFields": "false"})


def for_clients(df: DataFrame) -> DataFrame:
    """The result with nested columns as JSON text and everything else as it is."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*(json_column(f.name, f.dataType).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema))


def cell(v: Any) -> str | None:
    """A value as a client reads it in text form."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "t" if v else "f"
    if isinstance(v, (bytes, bytearray)):
        return "\\x" + bytes(v).hex()
    if isinstance(v, float):
        return number_text(v)
    if isinstance(v, datetime):
        return rfc3339(v) if v.tzinfo else v.isoformat(sep=" ")
    if isinstance(v, date):
        return v.isoformat()
    return format(v, "f") if isinstance(v, Decimal) else str(v) if isinstance(v, int) else json_text(v)


def rows(df: DataFrame) -> Iterator[list[str | None]]:
    """Rows in text form, a partition at a time."""
    for r in df.toLocalIterator():
        yield [cell(v) for v in r]
