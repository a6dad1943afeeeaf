"""What client libraries ask before and between queries: session statements, SHOW, and the system catalog."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrel.plans import sqltext
from quarrel.sources.registry import Registry

SERVER_VERSION = "16.6"
VERSION_TEXT = f"PostgreSQL {SERVER_VERSION} (quarrel on Apache Spark)"
CATALOG = "quarrel"
DEFAULT_SCHEMA = "public"

#: Statements that are acknowledged and do nothing, by first word (fixed values).
TAGS = {
    "SET": "SET", "RESET": "RESET", "DISCARD": "DISCARD ALL", "LISTEN": "LISTEN", "UNLISTEN": "UNLISTEN",
    "BEGIN": "BEGIN", "START": "BEGIN", "COMMIT": "COMMIT", "END": "COMMIT", "ROLLBACK": "ROLLBACK", "ABORT": "ROLLBACK", "SAVEPOINT": "SAVEPOINT", "RELEASE": "RELEASE",
}
WRITES = ("INSERT", "UPDATE", "DELETE", "MERGE", "TRUNCATE", "DROP", "ALTER", "GRANT", "REVOKE", "CREATE", "COPY", "REPLACE", "LOAD", "REFRESH", "CACHE", "UNCACHE", "MSCK", "ANALYZE", "ADD", "CALL")
#: Session variables and their values (fixed values).
VARIABLES = {
    "transaction isolation level": ("transaction_isolation", "read committed"),
    "server_version": ("server_version", SERVER_VERSION),
    "server_encoding": ("server_encoding", "UTF8"),
    "client_encoding": ("client_encoding", "UTF8"),
    "standard_conforming_strings": ("standard_conforming_strings", "on"),
    "timezone": ("TimeZone", "UTC"),
    "time zone": ("TimeZone", "UTC"),
    "datestyle": ("DateStyle", "ISO, MDY"),
    "search_path": ("search_path", '"$user", public'),
    "is_superuser": ("is_superuser", "off"),
}
ENGINE_SHOWS = ("tables", "databases", "schemas", "columns", "functions", "views", "catalogs", "namespaces", "partitions", "tblproperties", "create")
PG_RELATIONS = ("pg_namespace", "pg_class", "pg_attribute", "pg_type", "pg_index", "pg_roles")


class ReadOnlyError(Exception):
    """A statement that would change something."""

    sqlstate = "25006"


@dataclass(frozen=True)
class Tag:
    """Acknowledged; nothing runs."""

    text: str


@dataclass(frozen=True)
class Rewritten:
    sql: str


def intercept(sql: str) -> Tag | Rewritten | None:
    """What to do instead of running a statement; None if it is to run as it is. Writes raise :class:`ReadOnlyError`."""
    body = sql.strip().rstrip(";").strip()
    toks = [t for t in sqltext.tokens(body) if t[0] != "space"]
    if not toks:
        return Tag("EMPTY")
    first = toks[0][1].upper()
    if first in TAGS:
        return Tag(TAGS[first])
    if first in WRITES:
        raise ReadOnlyError(f"{first} is refused: tables are read-only here")
    if first == "SHOW":
        name = " ".join(t for _, t in toks[1:]).lower()
        if name.split(" ")[0] in ENGINE_SHOWS:
            return None
        column, value = VARIABLES.get(name, ("value", ""))
        return Rewritten(f"SELECT '{value}' AS `{column}`")
    new = rewrite_catalog(body)
    return Rewritten(new) if new != body else None


def rewrite_catalog(sql: str) -> str:
    """System relations and session functions in terms of the views of :func:`register_views`.

    ``pg_catalog.f(...)`` loses its qualifier; ``pg_catalog.pg_class``, or ``pg_class`` alone, and
    ``information_schema.tables`` name views. Strings, quoted names, comments and other qualified names stay as they are.
    """
    toks = sqltext.tokens(sql)
    out: list[str] = []
    k = 0
    while k < len(toks):
        kind, text = toks[k]
        low = text.lower()
        dotted = k > 0 and toks[k - 1] == ("mark", ".")
        after = sqltext._next(toks, k)
        called = after < len(toks) and toks[after] == ("mark", "(")
        if kind == "word" and not dotted:
            if low in ("pg_catalog", "information_schema") and toks[k + 1 : k + 2] == [("mark", ".")] and k + 2 < len(toks) and toks[k + 2][0] == "word":
                name = toks[k + 2][1]
                follows = sqltext._next(toks, k + 2)
                if low == "pg_catalog" and follows < len(toks) and toks[follows] == ("mark", "("):
                    k += 2  # the function, looked at again without its qualifier
                    toks[k - 1] = ("space", "")
                    continue
                out.append(f"{low}__{name.lower()}")
                k += 3
                continue
            if low in PG_RELATIONS and not called and toks[after : after + 1] != [("mark", ".")]:
                out.append(f"pg_catalog__{low}")
                k += 1
                continue
            if called and low in SESSION_FUNCTIONS:
                out.append(SESSION_FUNCTIONS[low])
                k = sqltext._close(toks, after) + 1
                continue
        out.append(text)
        k += 1
    return "".join(out)


#: Calls that are answered with a literal.
SESSION_FUNCTIONS = {
    "version": f"'{VERSION_TEXT}'",
    "current_schema": f"'{DEFAULT_SCHEMA}'",
    "current_database": f"'{CATALOG}'",
    "current_catalog": f"'{CATALOG}'",
    "pg_backend_pid": "1",
}


def oid(name: str) -> int:
    """FNV-1a over the bytes, in 31 bits."""
    h = 0x811C9DC5
    for b in name.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h & 0x7FFFFFFF


def oid_column(name: Column) -> Column:
    """The same as an expression over the hex digits of the bytes."""
    digits = F.hex(F.encode(name, "UTF-8"))
    count = (F.length(digits) / 2).cast("int")
    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substr(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")
    h = F.aggregate(steps, F.lit(0x811C9DC5).cast("bigint"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def schemata(registry: Registry) -> DataFrame:
    rows = [(CATALOG, s) for s in [*registry.databases(), "information_schema", "pg_catalog"]]
    return registry.spark.createDataFrame(rows, "catalog_name string, schema_name string")


def tables(registry: Registry) -> DataFrame:
    rows = [(CATALOG, d, t, "BASE TABLE") for d in registry.databases() for t in registry.listing(d)]
    rows += [(CATALOG, "pg_catalog", r, "VIEW") for r in PG_RELATIONS] + [(CATALOG, "information_schema", r, "VIEW") for r in ("schemata", "tables", "columns")]
    return registry.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")


def columns(registry: Registry) -> DataFrame:
    """Asking for this infers every collection's schema."""
    rows = []
    for d in registry.databases():
        for t in registry.listing(d):
            schema = registry.tables[d][t].schema if d in registry.tables else registry.record(d, t).schema
            rows += [(CATALOG, d, t, f.name, k, "YES" if f.nullable else "NO", f.dataType.simpleString()) for k, f in enumerate(schema, 1)]
    return registry.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


#: Types that results are announced with: (oid, name, kind, length) (fixed values).
PG_TYPES = (
    (16, "bool", "b", 1), (17, "bytea", "b", 1), (20, "int8", "b", 8), (21, "int2", "b", 2), (23, "int4", "b", 4), (25, "text", "b", 1),
    (700, "float4", "b", 4), (701, "float8", "b", 8), (1082, "date", "b", 4), (1114, "timestamp", "b", 8), (1184, "timestamptz", "b", 8), (1700, "numeric", "b", 1),
)


def catalog_view(registry: Registry, name: str) -> DataFrame:
    """One system view, built when it is asked for."""
    spark, none = registry.spark, F.lit(None).cast("string")
    if name.startswith("information_schema__"):
        return {"schemata": schemata, "tables": tables, "columns": columns}[name.split("__")[1]](registry)
    kind = name.removeprefix("pg_catalog__")
    if kind == "pg_namespace":
        return schemata(registry).select(oid_column(F.col("schema_name")).alias("oid"), F.col("schema_name").alias("nspname"), F.lit(10).alias("nspowner"), none.alias("nspacl"))
    if kind == "pg_class":
        whole = F.concat_ws(".", "table_schema", "table_name")
        no = F.lit(False)
        return tables(registry).select(
            oid_column(whole).alias("oid"), F.col("table_name").alias("relname"), oid_column(F.col("table_schema")).alias("relnamespace"), F.lit(0).alias("reltype"), F.lit(10).alias("relowner"),
            F.when(F.col("table_type") == "VIEW", "v").otherwise("r").alias("relkind"), F.lit(-1).cast("bigint").alias("reltuples"), F.lit(0).alias("relpages"), no.alias("relhasindex"),
            no.alias("relisshared"), no.alias("relhasrules"), no.alias("relhastriggers"), no.alias("relrowsecurity"), none.alias("relacl"),
        )
    if kind == "pg_attribute":
        no = F.lit(False)
        return columns(registry).select(
            oid_column(F.concat_ws(".", "table_schema", "table_name")).alias("attrelid"), F.col("column_name").alias("attname"), F.lit(0).alias("atttypid"), F.col("ordinal_position").alias("attnum"),
            F.lit(-1).alias("atttypmod"), (F.col("is_nullable") == "NO").alias("attnotnull"), no.alias("attisdropped"), no.alias("atthasdef"), F.lit(0).alias("attndims"), F.col("data_type").alias("type_text"),
        )
    if kind == "pg_type":
        return spark.createDataFrame([(*t, oid("pg_catalog"), 0) for t in PG_TYPES], "oid int, typname string, typtype string, typlen int, typnamespace int, typarray int")
    if kind == "pg_index":
        return spark.createDataFrame([], "indexrelid int, indrelid int, indisprimary boolean, indisunique boolean")
    if kind == "pg_roles":
        return spark.createDataFrame([(10, CATALOG, True, True)], "oid int, rolname string, rolsuper boolean, rolcanlogin boolean")
    raise KeyError(name)


def register_views(spark: SparkSession, registry: Registry, sql: str) -> None:
    """Temporary views for the system relations that a statement names."""
    for name in set(re.findall(r"\b(?:pg_catalog__pg_\w+|information_schema__(?:schemata|tables|columns))\b", sql)):
        catalog_view(registry, name).createOrReplaceTempView(name)
