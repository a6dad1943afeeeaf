"""Decode: documents to typed columns, by a fixed schema. A value that doesn't fit its column is null, never an error."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from decimal import Context, Decimal, InvalidOperation, ROUND_DOWN

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrel.operators.infer import path_of, tag_of
from quarrel.values import Value, lookup, number_text, parse, render_text

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_WIDE = Context(prec=80, rounding=ROUND_DOWN)


def as_int(v: Value, bits: int = 64) -> int | None:
    """Integers, doubles without a fraction, and booleans as 0 and 1, if they fit."""
    tag, x = v
    if tag == "double":
        if x != x or x in (float("inf"), float("-inf")) or x != int(x):
            return None
        x = int(x)
    elif tag not in ("int32", "int64", "bool"):
        return None
    x = int(x)
    return x if -(1 << bits - 1) <= x < 1 << bits - 1 else None


def as_double(v: Value) -> float | None:
    """Numbers; minus zero is zero."""
    tag, x = v
    if tag in ("double", "int32", "int64"):
        return float(x) + 0.0
    if tag == "decimal":
        try:
            return float(x)
        except ValueError:
            return None
    return None


def as_millis(v: Value) -> int | None:
    """Dates, the seconds of timestamps, and 64-bit integers as milliseconds."""
    tag, x = v
    return x if tag in ("date", "int64") else x[0] * 1000 if tag == "timestamp" else None


def as_time(v: Value) -> datetime | None:
    ms = as_millis(v)
    if ms is None:
        return None
    try:
        return _EPOCH + timedelta(milliseconds=ms)
    except OverflowError:
        return None


def parse_decimal(text: str, scale: int, precision: int = 38) -> Decimal | None:
    """A decimal cut (not rounded) to ``scale`` digits; None for what is no finite number or doesn't fit."""
    try:
        d = Decimal(text.strip())
        if "_" in text or not d.is_finite() or d.adjusted() > precision:
            return None
        d = d.quantize(Decimal(1).scaleb(-scale), context=_WIDE)
    except (InvalidOperation, ValueError):
        return None
    return d if len(d.as_tuple().digits) <= precision else None


def as_decimal(v: Value, scale: int, precision: int = 38) -> Decimal | None:
    tag, x = v
    if tag in ("int32", "int64", "decimal", "string"):
        return parse_decimal(str(x), scale, precision)
    return parse_decimal(number_text(x), scale, precision) if tag == "double" else None


def converter(kind: T.DataType) -> Callable[[Value | None], object]:
    """The function that turns a value (None: absent) into what Arrow takes for a column of ``kind``."""
    if isinstance(kind, T.StructType):
        fields = [(f.name, converter(f.dataType)) for f in kind]
        return lambda v: {name: make(v.value.get(name)) for name, make in fields} if v is not None and v.tag == "document" else None
    if isinstance(kind, T.ArrayType):
        item = converter(kind.elementType)
        return lambda v: None if v is None or v.tag == "null" else [item(x) for x in v.value] if v.tag == "array" else [item(v)]
    if isinstance(kind, T.BooleanType):
        leaf = lambda v: v.value if v.tag == "bool" else None
    elif isinstance(kind, T.IntegerType):
        leaf = lambda v: as_int(v, 32)
    elif isinstance(kind, T.LongType):
        leaf = as_int
    elif isinstance(kind, T.DoubleType):
        leaf = as_double
    elif isinstance(kind, T.DecimalType):
        leaf = lambda v: as_decimal(v, kind.scale, kind.precision)
    elif isinstance(kind, T.TimestampType):
        leaf = as_time
    elif isinstance(kind, T.BinaryType):
        leaf = lambda v: v.value[0] if v.tag == "binary" else None
    elif isinstance(kind, T.StringType):
        leaf = render_text
    else:
        raise NotImplementedError(f"no decoding to {kind.simpleString()}")
    return lambda v: None if v is None else leaf(v)


_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "timestamp": pa.timestamp("us", "UTC")}


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return pa.decimal128(kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else _ARROW[kind.simpleString()]


def _steps(f: T.StructField) -> tuple[str, ...]:
    """The keys that lead to a column: its name alone for a top-level field (which may have dots in it), else its path."""
    path = path_of(f)
    return (path,) if path == f.name else tuple(path.split("."))


def batch_of(schema: T.StructType, docs: list[dict[str, Value]]) -> pa.RecordBatch:
    """Documents as columns; a schema without columns keeps the number of rows."""
    if not schema.fields:
        return pa.RecordBatch.from_struct_array(pa.array([{}] * len(docs), pa.struct([])))
    columns = []
    for f in schema:
        make, steps = converter(f.dataType), _steps(f)
        columns.append(pa.array([make(lookup(d, steps)) for d in docs], arrow_type(f.dataType)))
    return pa.RecordBatch.from_arrays(columns, [f.name for f in schema])


def relaxed_nulls(schema: T.StructType) -> T.StructType:
    """The schema with every column nullable: a document without ``_id`` is no reason to stop a scan."""
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])


def decode(docs: DataFrame, schema: T.StructType, column: str = "doc", columns: list[str] | None = None) -> DataFrame:
    """The typed columns of extended-JSON documents; ``columns`` limits the work to those a query needs.

    Documents whose values in the chosen columns have the shapes that :func:`_plain` knows are decoded by expressions, which
    filters pass through; the others (another type than the column's, a wrapper out of the ordinary) go to Python. A
    document takes one of the two ways, and both give the same.
    """
    chosen = relaxed_nulls(T.StructType([f for f in schema if columns is None or f.name in columns]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(chosen, [parse(t) for t in batch.column(0).to_pylist()])

    texts = docs.select(F.col(column).alias("doc"))
    if not chosen.fields:
        return texts.select()
    # Parsed once: with a part that isn't deterministic, the parse isn't copied into every condition that is put above it.
    read = texts.select("doc", F.when(F.spark_partition_id() >= 0, F.try_parse_json("doc")).alias("v"))
    found = [_plain(f.dataType, tag_of(f), _path(_steps(f))) for f in chosen]
    odd = F.col("v").isNull() & F.col("doc").isNotNull() & (F.trim("doc") != "")
    for _, other in found:
        odd = odd | other
    odd = F.coalesce(odd, F.lit(False))
    named = lambda c, f: c.cast(f.dataType).alias(f.name, metadata=f.metadata or {})
    plain = read.where(~odd).select(*(named(value, f) for (value, _), f in zip(found, chosen, strict=True)))
    rest = read.where(odd).select("doc").mapInArrow(run, chosen)
    return plain.unionAll(rest.select(*(named(F.col(f"`{f.name}`"), f) for f in chosen)))


# --- the same by expressions ----------------------------------------------------------------------------------------------

#: Shapes, as ``schema_of_variant`` puts them, that a kind of column holds as they are; of a wrapper also what its text must match.
_LEAVES = {T.BooleanType: "BOOLEAN", T.IntegerType: "BIGINT", T.LongType: "BIGINT", T.DoubleType: r"BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\)", T.StringType: "STRING|BOOLEAN|BIGINT"}
_OID = (r"OBJECT<`\$oid`: STRING>", '["$oid"]', "^[0-9a-fA-F]{24}$")
_TIME = (r"OBJECT<`\$date`: STRING>", '["$date"]', r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]{1,3})?Z$")
_BYTES = (r"OBJECT<`\$binary`: OBJECT<base64: STRING, subType: STRING>>", '["$binary"].base64', "^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
_DIGITS = (r"OBJECT<`\$numberDecimal`: STRING>", '["$numberDecimal"]', "^-?[0-9]{{1,{0}}}([.][0-9]+)?$")
#: Parts whose text is their JSON as it stands: no fractions, which are written otherwise, no wrappers, no names or elements out of the ordinary.
_TEXT = r"STRING|BOOLEAN|BIGINT|(OBJECT|ARRAY)<(?!.*(DECIMAL|DOUBLE|VARIANT|[$`])).*>"
_NONE = "(?!)"


def _path(keys: tuple[str, ...]) -> str | None:
    """A path in a variant; None if a key can't be spelled there."""
    if any("\\" in k or "'" in k and '"' in k for k in keys):
        return None
    return "$" + "".join(f"['{k}']" if '"' in k else f'["{k}"]' for k in keys)


def _get(path: str, kind: str = "variant") -> Column:
    return F.try_variant_get("v", F.lit(path), kind)


def _shapes(kind: T.DataType) -> str:
    """The shapes that one cast turns into ``kind``: parts of plain leaves, and nothing in them that the kind doesn't name."""
    if isinstance(kind, T.ArrayType):
        item = _shapes(kind.elementType)
        return _NONE if item == _NONE else f"ARRAY<(?:VOID|{item})>"
    if isinstance(kind, T.StructType):
        names = sorted(kind, key=lambda f: f.name.encode())
        parts = [_shapes(f.dataType) if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", f.name) and not isinstance(f.dataType, T.StringType) or tag_of(f) == "string" else _NONE for f in names]
        return _NONE if _NONE in parts else "OBJECT<" + "".join(f"(?:{f.name}: (?:VOID|{p})(?:, )?)?" for f, p in zip(names, parts, strict=True)) + ">"
    return _LEAVES.get(type(kind), _NONE)


def _plain(kind: T.DataType, tag: str, path: str | None) -> tuple[Column, Column]:
    """(the value at a path of ``v`` as ``kind``, whether it is one that Python is to decode instead)."""
    if path is None:
        return F.lit(None), F.lit(True)
    shape = F.schema_of_variant(_get(path))
    is_not = lambda shapes: ~F.coalesce(shape.rlike(f"^(?:VOID|{shapes})$"), F.lit(True))
    wrapped = {"objectId": _OID}.get(tag) if isinstance(kind, T.StringType) else {T.TimestampType: _TIME, T.BinaryType: _BYTES, T.DecimalType: _DIGITS}.get(type(kind))
    if wrapped:
        shapes, inner, pattern = wrapped
        text = _get(path + inner, "string")
        if isinstance(kind, T.DecimalType):
            pattern = pattern.format(max(1, kind.precision - kind.scale - 1))
            cut = F.regexp_extract(text, "^-?[0-9]+" + (f"([.][0-9]{{1,{kind.scale}}})?" if kind.scale else ""), 0)
            value = cut.cast(kind)
        else:
            value = {T.TimestampType: lambda: text.try_cast("timestamp"), T.BinaryType: lambda: F.unbase64(text), T.StringType: lambda: F.lower(text)}[type(kind)]()
        bad = F.coalesce(~text.rlike(pattern), F.lit(False))
        return F.when(~bad, value), is_not(shapes) | bad
    if isinstance(kind, T.StringType) and tag != "string":
        if "'" in path:
            return _get(path, "string"), is_not("STRING")
        # An escape may be spelled in more than one way.
        return F.get_json_object("doc", path.replace('"', "'")), is_not(_TEXT) | (F.contains("doc", F.lit("\\")) & shape.rlike("^(OBJECT|ARRAY)"))
    if isinstance(kind, T.StructType) and _shapes(kind) == _NONE:
        parts = [_plain(f.dataType, tag_of(f), None if path is None or (own := _path((f.name,))) is None else path + own[1:]) for f in kind]
        odd = is_not(r"OBJECT<(?!`?[$]).*>")
        for _, other in parts:
            odd = odd | other
        value = F.struct(*(c.cast(f.dataType).alias(f.name) for (c, _), f in zip(parts, kind, strict=True)))
        return F.when(_get(path).isNotNull() & ~F.is_variant_null(_get(path)), value), odd
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.ArrayType):
        item = _shapes(kind.elementType)
        lone = F.array(_get(path, kind.elementType.simpleString())) if item != _NONE else F.lit(None)
        if item == _NONE:
            return F.lit(None).cast(kind), is_not(_NONE)
        return F.when(shape.startswith("ARRAY"), _get(path, kind.simpleString())).when(shape != "VOID", lone), is_not(f"{_shapes(kind)}|{item}")
    shapes = _shapes(kind)
    if shapes == _NONE:
        return F.lit(None).cast(kind), is_not(_NONE)
    return _get(path, kind.simpleString()), is_not(shapes)
