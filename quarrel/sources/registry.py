"""Databases of collections: listing, schemas, statistics and tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrel.operators import infer as inference
from quarrel.operators.decode import decode
from quarrel.sources.store import CatalogStore, Record, Stats, key

#: Databases and collections of the store itself (fixed values).
SYSTEM_DATABASES = ("admin", "local", "config")
SYSTEM_PREFIX = "system."


@dataclass
class Settings:
    sample: int = 1000
    recent: float = 0.25
    depth: int = 4
    max_age: float = 3600
    databases: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    #: ``db.collection`` -> {column: (SQL type, nullable)}: wins over what is inferred.
    overrides: dict[str, dict[str, tuple[str, bool]]] = field(default_factory=dict)


def redact(uri: str) -> str:
    """A connection string without user and password."""
    return re.sub(r"(?<=://)[^/@]*(?:@[^/@]*)*@", "***@", uri)


def fits(pattern: str, name: str) -> bool:
    """``prefix*`` by prefix, anything else exactly."""
    return name.startswith(pattern[:-1]) if pattern.endswith("*") else pattern == name


class Registry:
    """Collections by database, each a DataFrame with a column ``doc`` of extended-JSON lines (or a function that makes it).

    Schemas are inferred when a table is first asked for and kept in the store; plain tables shadow a database of the same
    name. An engine gives the registry a session of its own; its collections are made in that session.
    """

    def __init__(self, spark: SparkSession, store: CatalogStore | None = None, settings: Settings | None = None):
        self.spark, self.store, self.settings = spark, store or CatalogStore(), settings or Settings()
        self.collections: dict[str, dict[str, DataFrame | Callable[[], DataFrame]]] = {}
        self.tables: dict[str, dict[str, DataFrame]] = {}

    def add(self, database: str, collection: str, docs: DataFrame | Callable[[], DataFrame]) -> None:
        """Register a collection. It is opened now, so that a place that can't be reached fails here and not in a query; no document is read."""
        try:
            found = (docs() if callable(docs) else docs).schema
        except Exception as e:
            raise ValueError(f"cannot open {database}.{collection}: {redact(str(e))}") from None
        if "doc" not in found.names or not isinstance(found["doc"].dataType, T.StringType):
            raise ValueError(f"cannot open {database}.{collection}: it has no text column doc")
        self.collections.setdefault(database, {})[collection] = docs

    def add_table(self, schema: str, name: str, df: DataFrame) -> None:
        self.tables.setdefault(schema, {})[name] = df

    def databases(self) -> list[str]:
        """The configured databases, or all but the store's own; then registered schemas."""
        own = list(self.settings.databases) or sorted(d for d in self.collections if d not in SYSTEM_DATABASES)
        return list(dict.fromkeys([*own, *sorted(self.tables)]))

    def listing(self, database: str) -> list[str]:
        """Without inferring anything."""
        if database in self.tables:
            return sorted(self.tables[database])
        return sorted(c for c in self.collections.get(database, {}) if not c.startswith(SYSTEM_PREFIX) and not any(fits(x, c) for x in self.settings.exclude))

    def docs(self, database: str, collection: str) -> DataFrame:
        got = self.collections[database][collection]
        return got() if callable(got) else got

    def record(self, database: str, collection: str, refresh: bool = False) -> Record:
        """The collection's schema and statistics: from the store while fresh, else inferred."""
        name = key(database, collection)
        got = None if refresh else self.store.get_fresh(name, self.settings.max_age)
        return got or self.store.put(name, *self._inferred(database, collection))

    def _inferred(self, database: str, collection: str) -> tuple[T.StructType, Stats]:
        """The schema of a sample, and statistics from the pass that took it."""
        s, watch = self.settings, Observation()
        docs = self.docs(database, collection).select("doc", inference.id_key(F.col("doc")).alias("_id"))
        schema = inference.infer(inference.sample(docs, s.sample, s.recent, watch=watch), max_depth=s.depth)
        wins = s.overrides.get(key(database, collection), {})
        parse = lambda text: T._parse_datatype_string(text)
        fields = [T.StructField(f.name, parse(wins[f.name][0]), wins[f.name][1], f.metadata) if f.name in wins else f for f in schema]
        fields += [T.StructField(n, parse(k), ok, {inference.TAG: "unknown", inference.PATH: n}) for n, (k, ok) in wins.items() if n not in schema.names]
        return T.StructType(fields), _stats(watch.get)

    def stats(self, database: str, collection: str) -> Stats:
        row = self.docs(database, collection).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("doc")), F.lit(0)).alias("size")).first()
        return _stats(row.asDict())

    def resolve(self, database: str, name: str, wanted: set[str] | None = None) -> DataFrame | None:
        """The table of that name, or None; collections added since the last look are found.

        ``wanted`` limits the columns that are decoded to those of these names.
        """
        if database in self.tables:
            return self.tables[database].get(name)
        if name not in self.collections.get(database, {}):
            return None
        schema = self.record(database, name).schema
        columns = None if wanted is None else [c for c in schema.names if c in wanted]
        return decode(self.docs(database, name), schema, columns=columns)

    def describe(self, refresh: bool = True) -> DataFrame:
        """One row per column of every collection."""
        rows = []
        for d in self.databases():
            for c in self.listing(d) if d not in self.tables else []:
                r = self.record(d, c, refresh)
                rows += [(d, c, f.name, f.dataType.simpleString(), inference.tag_of(f), inference.is_mixed(f), r.stats.docs) for f in r.schema]
        return self.spark.createDataFrame(rows, "db string, table string, column string, type string, tag string, mixed boolean, rows long")


def _stats(seen: dict) -> Stats:
    return Stats(seen["n"], seen["size"] // seen["n"] if seen["n"] else 0, seen["size"], ["_id"])


def split_filters(ids: DataFrame, parts: int, column: str = "_id") -> list:
    """Conditions on ``column`` that cut a table into at most ``parts`` ranges, from a sample of its ids."""
    from quarrel.operators import scan

    got = [r[0] for r in ids.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(column)).limit(scan.ids_wanted(parts)).collect()]
    out = []
    for r in scan.ranges(sorted(got), parts):
        ends = (r or {}).get("_id", {})
        cond = F.lit(True)
        if "$gte" in ends:
            cond = cond & (F.col(column) >= ends["$gte"])
        if "$lt" in ends:
            low = F.col(column) < ends["$lt"]
            cond = cond & (low if "$gte" in ends else low | F.col(column).isNull())
        elif not ends:
            cond = F.lit(True)
        out.append(cond)
    return out


_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_OBJECT_ID = re.compile(r"[0-9a-fA-F]{24}")
_WAREHOUSE = {"boolean": "BOOLEAN", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE PRECISION", "string": "TEXT", "binary": "BYTEA", "timestamp": "TIMESTAMPTZ", "date": "DATE"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _warehouse_type(f: T.StructField, value: object) -> str:
    """By the column's type; a first value tells uuids and object ids, in columns named as ids, and documents kept as text."""
    if isinstance(f.dataType, T.DecimalType):
        return f.dataType.simpleString().upper().replace("DECIMAL", "NUMERIC")
    kind = _WAREHOUSE.get(f.dataType.simpleString(), "JSONB")
    if kind == "TEXT" and isinstance(value, str):
        if f.name == "_id" or f.name.endswith(("Id", "By")):
            return "UUID" if _UUID.fullmatch(value) else "CHAR(24)" if _OBJECT_ID.fullmatch(value) else kind
        if value.startswith(("{", "[")):
            return "JSONB"
    return kind


def schema_to_ddl(name: str, schema: T.StructType, first: dict | None = None, references: dict[str, str] | None = None) -> str:
    """CREATE TABLE for a warehouse.

    ``first`` has a value by column; ``references`` names, by column, the ``table(column)`` that it points at, for a comment.
    """
    first, references = first or {}, references or {}
    lines = []
    for n, f in enumerate(schema, 1):
        line = f"    {_quoted(f.name)} {_warehouse_type(f, first.get(f.name))}" + ("" if f.nullable else " NOT NULL") + (" PRIMARY KEY" if f.name == "_id" else "")
        line += "," if n < len(schema) else ""
        lines.append(line + (f" -- references {references[f.name]}" if f.name in references else ""))
    return f"CREATE TABLE IF NOT EXISTS {_quoted(name)} (\n" + "\n".join(lines) + "\n);"


def database_ddl(registry: Registry, database: str, rows: int = 5, references: dict[str, str] | None = None) -> str:
    """CREATE TABLE for every table of a database; the first values are looked for in ``rows`` rows of each."""
    out = []
    for name in registry.listing(database):
        table = registry.resolve(database, name)
        seen = table.limit(rows).collect()
        first = {c: next((r[c] for r in seen if r[c] is not None), None) for c in table.columns}
        out.append(schema_to_ddl(name, table.schema, first, references) if table.columns else f"-- {_quoted(name)}: no columns")
    return "\n\n".join(out)
