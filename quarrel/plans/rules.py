"""Queries over the engine's rules: what each gives for typical and for odd arguments, against plain constants."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quarrel.operators import predicate as p
from quarrel.operators import scan
from quarrel.operators.decode import as_decimal, as_double, as_int, as_millis
from quarrel.operators.infer import infer_local, is_mixed, join_scalars, tag_of
from quarrel.plans import compat, render
from quarrel.plans.collections import _rows, engine
from quarrel.plans.service import sqlstate
from quarrel.session import scoped, shared_folder
from quarrel.sources import registry as reg
from quarrel.sources import sinks
from quarrel.sources.store import CatalogStore, Stats
from quarrel.values import SCALARS, Value, lookup, parse, render_text

_DOC = '{"s":"x","o":{"$oid":"0123456789abcdef01234567"},"b":true,"i":3,"f":1.0,"g":2.5,"t":{"$date":"2020-01-02T03:04:05.060Z"},"y":{"$binary":{"base64":"Zm9v","subType":"00"}},"d":{"z":1,"a":null},"m":{"$numberDecimal":"1.50"}}'
_SCHEMA = infer_local(['{"_id":{"$oid":"0123456789abcdef01234567"},"age":3,"name":"x","active":true,"at":{"$date":"2020-01-01T00:00:00Z"}}'])


def _text(x) -> str:
    return "null" if x is None else str(x)


def _lattice():
    return [(a, b, *join_scalars([a, b])) for a in SCALARS for b in SCALARS]


def _lattice_oracle() -> str:
    """The pairs by their table of joins."""
    tags = ", ".join(f"('{t}')" for t in SCALARS)
    rank = "CASE {0} WHEN 'int32' THEN 1 WHEN 'int64' THEN 2 WHEN 'double' THEN 3 WHEN 'decimal' THEN 4 END"
    ra, rb = rank.format("a"), rank.format("b")
    return f"""SELECT a, b, CASE WHEN a = b THEN a WHEN ({ra}) IS NOT NULL AND ({rb}) IS NOT NULL THEN CASE WHEN ({ra}) > ({rb}) THEN a ELSE b END
      WHEN a IN ('date', 'timestamp') AND b IN ('date', 'timestamp') THEN 'date' WHEN a IN ('objectId', 'string') AND b IN ('objectId', 'string') THEN 'string' ELSE 'json' END AS joined,
      NOT (a = b OR (({ra}) IS NOT NULL AND ({rb}) IS NOT NULL) OR (a IN ('date', 'timestamp') AND b IN ('date', 'timestamp'))) AS mixed
      FROM (VALUES {tags}) AS x(a) CROSS JOIN (VALUES {tags}) AS y(b)"""


def _shapes():
    cases = {"widen": [{"v": 1}, {"v": 2.5}], "conflict": [{"v": "x"}, {"v": {"a": 1}}], "lone": [{"v": ["a"]}, {"v": "c"}], "items": [{"v": [1, "x"]}], "null": [{"v": None}], "empty": [{"v": {}}], "nested": [{"v": {"b": 1, "a": "x"}}], "documents": [{"v": [{"a": 1}]}, {"v": {"b": 2}}]}
    out = []
    for name, docs in cases.items():
        f = infer_local([json.dumps(d) for d in docs])["v"]
        out.append((name, f.dataType.simpleString(), tag_of(f), is_mixed(f)))
    return out


def _coercions():
    values = {"int32": Value("int32", 5), "whole": Value("double", 4.0), "part": Value("double", 2.5), "text": Value("string", "7"), "true": Value("bool", True), "decimal": Value("decimal", "2.345"), "date": Value("date", 7), "stamp": Value("timestamp", (3, 9)), "int64": Value("int64", 8)}
    return [(k, _text(as_int(v)), _text(as_double(v)), _text(as_millis(v)), _text(as_decimal(v, 2))) for k, v in values.items()]


def _literals():
    cases = {"id": ("_id", "0123456789ABCDEF01234567"), "bad_id": ("_id", "zz"), "int": ("age", 5), "wide": ("age", 1 << 40), "time": ("at", 1000), "null": ("age", None)}
    out = []
    for name, (col, x) in cases.items():
        v = p.stored_literal(x, p.place_of(p.Col((col,)), _SCHEMA))
        out.append((name, v.tag if v else "none", _text(v.value if v else None)))
    return out


def _states(spark: SparkSession, sf_dir: str):
    e = engine(spark, sf_dir)
    out = []
    for name, sql in {"table": "SELECT * FROM nowhere_at_all", "syntax": "SELEC 1", "write": "DROP TABLE x"}.items():
        try:
            e.sql(sql)
        except Exception as error:
            out.append((name, sqlstate(error)))
    return out


def _age():
    store = CatalogStore()
    store.put("a.b", _SCHEMA, Stats(1), now=100)
    return [(name, bool(store.get_fresh("a.b", age, now))) for name, age, now in (("young", 10, 105), ("just", 10, 110), ("old", 10, 111), ("never", 0, 10**9))]


#: name -> (schema, rows, the same as constants or SQL)
RULES: dict[str, tuple[str, Callable[[], list], str]] = {
    "i2_lattice": ("a string, b string, joined string, mixed boolean", _lattice, _lattice_oracle()),
    "i7_shapes": ("name string, type string, tag string, mixed boolean", _shapes, _rows("name, type, tag, mixed", ("widen", "double", "double", False), ("conflict", "string", "json", True), ("lone", "array<string>", "array:string", False), ("items", "array<string>", "array:json", True), ("null", "string", "unknown", False), ("empty", "string", "json", False), ("nested", "struct<a:string,b:int>", "document", False), ("documents", "array<struct<a:int,b:int>>", "array:document", False))),
    "d2_lookup": ("path string, value string", lambda: [(x, _text(v.value if (v := lookup(parse('{"a":{"b":{"c":7}},"x":1}'), tuple(x.split(".")))) else None)) for x in ("a.b.c", "x", "x.y", "none")], _rows("path, value", ("a.b.c", "7"), ("x", "1"), ("x.y", "null"), ("none", "null"))),
    "d4_coercions": ("name string, as_int string, as_double string, as_millis string, as_decimal string", _coercions, _rows("name, as_int, as_double, as_millis, as_decimal", ("int32", "5", "5.0", "null", "5.00"), ("whole", "4", "4.0", "null", "4.00"), ("part", "null", "2.5", "null", "2.50"), ("text", "null", "null", "null", "7.00"), ("true", "1", "null", "null", "null"), ("decimal", "null", "2.345", "null", "2.34"), ("date", "null", "null", "7", "null"), ("stamp", "null", "null", "3000", "null"), ("int64", "8", "8.0", "8", "8.00"))),
    "d6_text": ("name string, text string", lambda: [(k, render_text(v)) for k, v in parse(_DOC).items()], _rows("name, text", ("s", "x"), ("o", "0123456789abcdef01234567"), ("b", "true"), ("i", "3"), ("f", "1"), ("g", "2.5"), ("t", "2020-01-02T03:04:05.060Z"), ("y", "Zm9v"), ("d", '{"z":1,"a":null}'), ("m", "1.50"))),
    "d9_projection": ("name string, value int", lambda: list(scan.projection(["a.b", "a", "c.d"]).items()), _rows("name, value", ("a", 1), ("c.d", 1), ("_id", 0))),
    "p20_patterns": ("pattern string, regex string", lambda: [(x, _text(p.like_regex(x, "!"))) for x in ("a%", "_b", "a.b", "100!%", "x!")], _rows("pattern, regex", ("a%", "^a.*$"), ("_b", "^.b$"), ("a.b", "^a\\.b$"), ("100!%", "^100%$"), ("x!", "null"))),
    "p25_literals": ("name string, tag string, value string", _literals, _rows("name, tag, value", ("id", "objectId", "0123456789abcdef01234567"), ("bad_id", "none", "null"), ("int", "int32", "5"), ("wide", "int64", "1099511627776"), ("time", "date", "1000"), ("null", "none", "null"))),
    "p26_combine": ("n int, filter string", lambda: [(n, json.dumps(p.shown(p.combine([p.translate(p.Cmp(">", p.Col(("age",)), p.Lit(k)), _SCHEMA) for k in range(n)])))) for n in range(3)], _rows("n, filter", (0, "null"), (1, '{"age": {"$gt": 0}}'), (2, '{"$and": [{"age": {"$gt": 0}}, {"age": {"$gt": 1}}]}'))),
    "s5_id_range": ("name string, filter string", lambda: [(n, json.dumps(scan.id_range(a, b))) for n, a, b in (("both", 1, 5), ("low", 1, None), ("high", None, 5), ("open", None, None))], _rows("name, filter", ("both", '{"_id": {"$gte": 1, "$lt": 5}}'), ("low", '{"_id": {"$gte": 1}}'), ("high", '{"_id": {"$lt": 5}}'), ("open", "null"))),
    "s6_split_points": ("name string, points string", lambda: [(n, json.dumps(scan.split_points(ids, k))) for n, ids, k in (("even", list(range(100)), 4), ("equal", [5] * 8, 4), ("few", [1, 2], 8))], _rows("name, points", ("even", "[25, 50, 75]"), ("equal", "[5]"), ("few", "[2]"))),
    "s7_parallelism": ("docs long, parts int", lambda: [(n, scan.parallelism(n, 6)) for n in (0, 99_999, 100_000)] + [(10**6, scan.parallelism(10**6, 6, 5))], _rows("docs, parts", (0, 1), (99999, 1), (100000, 6), (1000000, 1))),
    "s15_redaction": ("uri string", lambda: [(reg.redact(u),) for u in ("db://user:secret@host:1/x", "db://host/x")], _rows("uri", ("db://***@host:1/x",), ("db://host/x",))),
    "s23_estimates": ("name string, n long", lambda: list(scan.estimated(1000, 50_000, True, 4).items()), _rows("name, n", ("rows", 200), ("bytes", 10000), ("rows_per_part", 50))),
    "c2_age": ("name string, fresh boolean", _age, _rows("name, fresh", ("young", True), ("just", True), ("old", False), ("never", True))),
    "r7_qualified_names": ("n int, sql string", lambda: list(enumerate(compat.rewrite_catalog(s) for s in ("SELECT 'pg_type' FROM pg_type", "SELECT t.pg_class FROM t", "SELECT * FROM pg_catalog.pg_roles -- pg_type"))), _rows("n, sql", (0, "SELECT 'pg_type' FROM pg_catalog__pg_type"), (1, "SELECT t.pg_class FROM t"), (2, "SELECT * FROM pg_catalog__pg_roles -- pg_type"))),
    "x3_quoting": ("n int, text string", lambda: list(enumerate(map(render.quoted, ('a"b', "c\\d", "e\nf", "\x01")))), _rows("n, text", (0, '"a\\"b"'), (1, '"c\\\\d"'), (2, '"e\\nf"'), (3, '"\\u0001"'))),
    "k2_cells": ("n int, text string", lambda: list(enumerate(map(render.cell, (True, 1.0, b"\x00\xff", [1, None], "x")))), _rows("n, text", (0, "t"), (1, "1"), (2, "\\x00ff"), (3, "[1,null]"), (4, "x"))),
}


def _query(name: str):
    schema, rows, _ = RULES[name]
    return lambda spark, sf_dir: spark.createDataFrame(rows(), schema)


def sink_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written in every format and read back."""
    own = scoped(spark)
    df = own.read.parquet(f"{sf_dir}/nation.parquet")
    parts = []
    for kind in sinks.FORMATS:
        path = f"{shared_folder(own)}/{kind}"
        sinks.write(df, path, kind)
        parts.append(sinks.read(own, path, kind, df.schema).selectExpr(f"'{kind}' AS format", "n_nationkey", "n_name", "n_regionkey"))
    return reduce(DataFrame.unionAll, parts)


QUERIES = {name: _query(name) for name in RULES} | {
    "k8_sink_formats": sink_formats,
    "r18_error_states": lambda spark, sf_dir: spark.createDataFrame(_states(spark, sf_dir), "name string, state string"),
    "r19_describe": lambda spark, sf_dir: spark.createDataFrame(engine(spark, sf_dir).describe("SELECT _id, primaryName, \"type\" FROM mailbox.profile"), "name string, type string"),
    "h3_listing": lambda spark, sf_dir: spark.createDataFrame([(d, ",".join(t)) for d, t in engine(spark, sf_dir).listing().items()], "database string, tables string"),
}
ORACLES = {name: oracle for name, (_, _, oracle) in RULES.items()} | {
    "k8_sink_formats": " UNION ALL ".join(f"SELECT '{k}' AS format, n_nationkey, n_name, n_regionkey FROM nation" for k in sinks.FORMATS),
    "r18_error_states": _rows("name, state", ("table", "42P01"), ("syntax", "42601"), ("write", "25006")),
    "r19_describe": _rows("name, type", ("_id", "int4"), ("primaryName", "text"), ("type", "text")),
    "h3_listing": _rows("database, tables", ("mailbox", "profile,sender"), ("shop", "orders,tmp_old")),
}
