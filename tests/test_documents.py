"""Document types, inference, decode, predicates, scan plans and the catalog file."""

import itertools
import json
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrel.operators import infer as inference
from quarrel.operators import predicate as p
from quarrel.operators import scan
from quarrel.operators.decode import as_decimal, as_double, as_int, as_millis, batch_of, decode, parse_decimal
from quarrel.operators.infer import infer, infer_local, is_mixed, join_scalars, path_of, tag_of
from quarrel.sources import registry as reg
from quarrel.sources.documents import register_source
from quarrel.sources.store import CatalogStore, Stats
from quarrel.values import SCALARS, Value, lookup, parse, relaxed_text, render_text


def schema_of(*docs, depth=4):
    return infer_local([json.dumps(d) for d in docs], depth)


OID = {"$oid": "0123456789abcdef01234567"}


def test_numbers_widen():
    assert schema_of({"n": 1}, {"n": 1 << 40})["n"].dataType == T.LongType()
    assert schema_of({"n": 1}, {"n": 2.5})["n"].dataType == T.DoubleType()
    assert schema_of({"n": 1}, {"n": {"$numberDecimal": "2"}}, {"n": 1.5})["n"].dataType == T.DecimalType(38, 10)
    assert not is_mixed(schema_of({"n": 1}, {"n": 2.5})["n"])


def test_scalars_join_in_any_order():
    for some in itertools.combinations(SCALARS, 3):
        assert len({join_scalars(x) for x in itertools.permutations(some)}) == 1


def test_conflicts_are_json():
    f = schema_of({"v": "x"}, {"v": {"a": 1}})["v"]
    assert (f.dataType, tag_of(f), is_mixed(f)) == (T.StringType(), "json", True)
    f = schema_of({"v": 1}, {"v": "x"})["v"]
    assert (tag_of(f), is_mixed(f)) == ("json", True)
    assert tag_of(schema_of({"v": {"$regularExpression": {"pattern": "x", "options": ""}}})["v"]) == "json"
    f = schema_of({"ref": OID}, {"ref": "x"})["ref"]
    assert (tag_of(f), is_mixed(f)) == ("string", True)


def test_nullability_and_order():
    s = schema_of({"zeta": 1, "_id": 1, "alpha": 1}, {"_id": 1})
    assert s.names == ["_id", "alpha", "zeta"]
    assert [f.nullable for f in s] == [False, True, True]
    assert s["alpha"].metadata["freq"] == "0.500000"
    nested = schema_of({"_id": 1, "u": {"_id": 1}})
    assert nested["u"].dataType["_id"].nullable
    assert tag_of(schema_of({"maybe": None})["maybe"]) == "unknown"


def test_nesting_and_depth():
    s = schema_of({"u": {"name": "x", "age": 1}})
    assert s["u"].dataType.simpleString() == "struct<age:int,name:string>" and path_of(s["u"].dataType["age"]) == "u.age"
    s = schema_of({"a": {"b": {"c": {"d": 1}}}}, depth=2)
    assert s["a"].dataType.simpleString() == "struct<b:struct<c:string>>" and tag_of(s["a"].dataType["b"].dataType["c"]) == "json"
    assert tag_of(schema_of({"e": {}})["e"]) == "json"
    assert schema_of({"l": [[[[[1]]]]]})["l"].dataType.simpleString() == "array<array<array<array<string>>>>"


def test_arrays():
    assert schema_of({"t": [1]}, {"t": [1 << 40]})["t"].dataType.simpleString() == "array<bigint>"
    assert schema_of({"t": ["a"]}, {"t": "c"})["t"].dataType.simpleString() == "array<string>"
    assert schema_of({"t": "c"}, {"t": ["a"]}) == schema_of({"t": ["a"]}, {"t": "c"})
    f = schema_of({"t": [1, "x"]})["t"]
    assert f.dataType.simpleString() == "array<string>" and is_mixed(f)
    assert schema_of({"t": [{"a": 1}]}, {"t": {"b": 2}})["t"].dataType.simpleString() == "array<struct<a:int,b:int>>"


def test_order_of_documents_does_not_matter():
    docs = [{"v": 1}, {"v": "x"}, {"v": ["y"]}, {"v": None}, {"w": {"a": 1}}, {"w": [{"a": 2.5}]}]
    assert len({schema_of(*x).json() for x in itertools.permutations(docs)}) == 1


def test_distributed_inference_equals_local(spark):
    docs = [json.dumps(d) for d in [{"_id": OID, "a": [1, {"b": 2}]}, {"_id": OID, "a": "x", "c": {"d": {"$date": "2020-01-01T00:00:00Z"}}}] * 30]
    assert infer(spark.createDataFrame([(d,) for d in docs], "doc string").repartition(5)) == infer_local(docs)
    assert infer(spark.createDataFrame([], "doc string")).names == ["_id"]


def test_coercions():
    v = Value
    assert [as_int(x) for x in (v("int32", 5), v("double", 4.0), v("double", 2.5), v("string", "7"), v("bool", True), v("double", 1e300), v("double", float("nan")))] == [5, 4, None, None, 1, None, None]
    assert as_int(v("int64", 1 << 40), 32) is None
    assert [as_double(x) for x in (v("int32", 1), v("decimal", "2.5"), v("string", "1"), v("bool", True))] == [1.0, 2.5, None, None]
    assert [as_millis(x) for x in (v("date", 7), v("timestamp", (3, 9)), v("int64", 8), v("int32", 8))] == [7, 3000, 8, None]


@pytest.mark.parametrize(("text", "scale", "want"), [("1.5", 2, "1.50"), ("-0.25", 4, "-0.2500"), ("1.23E+3", 0, "1230"), ("12", 3, "12.000"), ("1.2345", 2, "1.23"), ("-1.239", 2, "-1.23"), ("NaN", 2, None), ("Infinity", 2, None), ("abc", 2, None), ("-", 2, None), ("", 2, None), ("1e60", 2, None), ("1e-50", 4, "0.0000")])
def test_decimal_text(text, scale, want):
    assert parse_decimal(text, scale) == (None if want is None else Decimal(want))
    assert as_decimal(Value("string", text), scale) == parse_decimal(text, scale)


def test_text_of_values():
    d = parse('{"s":"x","o":{"$oid":"0123456789abcdef01234567"},"b":true,"i":3,"f":1.0,"g":2.5,"t":{"$date":"2020-01-02T03:04:05.060Z"},"y":{"$binary":{"base64":"Zm9v","subType":"00"}},"d":{"z":1,"a":null},"n":null,"m":{"$numberDecimal":"1.50"},"e":1e21}')
    assert {k: render_text(x) for k, x in d.items()} == {"s": "x", "o": "0123456789abcdef01234567", "b": "true", "i": "3", "f": "1", "g": "2.5", "t": "2020-01-02T03:04:05.060Z", "y": "Zm9v", "d": '{"z":1,"a":null}', "n": None, "m": "1.50", "e": "1000000000000000000000"}
    assert relaxed_text(d["t"]) == '{"$date":"2020-01-02T03:04:05.060Z"}'
    assert lookup(parse('{"a":{"b":{"c":7}}}'), ("a", "b", "c")).value == 7 and lookup(parse('{"a":1}'), ("a", "b")) is None
    assert parse("not json") == {} == parse(None) == parse("[1]")


def test_decode(spark):
    docs = [{"_id": 1, "n": 4.0, "tags": ["a", None], "u": {"name": "x"}, "v": "s"}, {"_id": 2, "n": 2.5, "tags": "b", "v": {"k": 1}}, {"_id": 3, "tags": None, "u": 5}, {}]
    schema = T.StructType.fromDDL("_id int, n bigint, tags array<string>, u struct<name: string>, v string, absent timestamp")
    rows = decode(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string"), schema).collect()
    got = sorted((r.asDict(True) for r in rows), key=lambda r: r["_id"] or 99)
    assert got[0] == {"_id": 1, "n": 4, "tags": ["a", None], "u": {"name": "x"}, "v": "s", "absent": None}
    assert got[1] == {"_id": 2, "n": None, "tags": ["b"], "u": None, "v": '{"k":1}', "absent": None}
    assert got[2]["u"] is None and got[2]["tags"] is None and got[3]["_id"] is None
    assert batch_of(T.StructType([]), [{}, {}]).num_rows == 2


def test_dotted_field_names_decode(spark):
    text = json.dumps({"a.b": 1, "a": {"b": 2}})
    schema = infer_local([text])
    row = decode(spark.createDataFrame([(text,)], "doc string"), schema).first()
    assert row["a.b"] == 1 and row["a"]["b"] == 2


SCHEMA = infer_local([json.dumps({"_id": OID, "age": 3, "name": "x", "active": True, "score": "x", "profile": {"city": "c"}}), json.dumps({"score": 1})])
C, L = (lambda *n: p.Col(n)), p.Lit


def shown(e, **kw):
    t = p.translate(e, SCHEMA, **kw)
    return t and (p.shown(t.filter), t.exact)


@pytest.mark.parametrize(
    ("e", "want"),
    [
        (p.Cmp("=", C("age"), L(5)), ({"age": {"$eq": 5}}, True)),
        (p.Cmp("<", L(5), C("age")), ({"age": {"$gt": 5}}, True)),
        (p.Cmp("<>", C("age"), L(5)), ({"$and": [{"age": {"$ne": 5}}, {"age": {"$ne": None}}]}, True)),
        (p.Cmp("=", C("score"), L("a")), ({"$or": [{"score": {"$eq": "a"}}, {"score": {"$not": {"$type": ["null", "string"]}}}]}, False)),
        (p.Cmp("=", C("_id"), L("0123456789ABCDEF01234567")), ({"_id": {"$eq": "0123456789abcdef01234567"}}, True)),
        (p.Cmp("=", C("_id"), L("zz")), None),
        (p.Cmp("=", C("age"), C("name")), None),
        (p.Cmp("=", C("age"), L(None)), None),
        (p.Cmp("=", C("age"), L(Decimal("1.5"))), None),
        (p.And(p.Cmp("=", C("age"), L(5)), p.Cmp("=", C("age"), C("name"))), ({"age": {"$eq": 5}}, False)),
        (p.Or(p.Cmp("=", C("age"), L(5)), p.Cmp("=", C("age"), C("name"))), None),
        (p.Not(p.And(p.Cmp("=", C("age"), L(5)), p.Cmp("=", C("age"), C("name")))), None),
        (C("active"), ({"active": True}, True)),
        (p.Not(C("active")), ({"active": False}, True)),
        (C("age"), None),
        (p.Is(C("active"), False, True), ({"$or": [{"active": True}, {"active": None}]}, True)),
        (p.Is(C("name"), True), None),
        (p.Not(p.Is(C("name"), None, True)), ({"name": None}, True)),
        (p.Like(C("name"), "100\\%", escape="\\"), ({"name": {"$regex": "^100%$", "$options": "s"}}, True)),
        (p.Like(C("name"), "a.b_%"), ({"name": {"$regex": "^a\\.b..*$", "$options": "s"}}, True)),
        (p.Like(C("name"), "x\\", escape="\\"), None),
        (p.Like(C("age"), "1%"), None),
        (p.Similar(C("name"), "a|b"), None),
        (p.Cast(C("age"), "int"), None),
        (p.Cmp("=", p.Cast(C("age"), "int"), L(1)), ({"age": {"$eq": 1}}, True)),
        (p.Cmp("=", p.Cast(C("age"), "string"), L("1")), None),
        (p.Cmp("=", p.Alias(C("profile", "city"), "x"), L("c")), ({"profile.city": {"$eq": "c"}}, True)),
        (p.In(C("age"), (L(1), L(None))), None),
    ],
)
def test_translation(e, want):
    assert shown(e) == want


def test_incomplete_schemas_are_never_exact():
    assert shown(p.Is(C("name"), None), complete=False) is None  # a value of another type decodes to null as well
    assert shown(p.Is(C("name"), None, True), complete=False) == ({"name": {"$ne": None}}, False)
    assert shown(p.Cmp("=", C("name"), L("5")), complete=False) == ({"$or": [{"name": {"$eq": "5"}}, {"name": {"$not": {"$type": ["null", "string"]}}}]}, False)


def test_filters_never_lose_rows_and_exact_ones_add_none(spark):
    docs = [{"age": a, "name": n, "active": b, "profile": c} for a in (None, 1, 5) for n in (None, "ab", "a%") for b in (None, True, False) for c in (None, {"city": "c"}, {"city": None})] + [{}]
    docs = [{k: v for k, v in d.items() if v is not None or i % 2} for i, d in enumerate(docs)]
    leaves = [
        p.Cmp("=", C("age"), L(5)), p.Cmp("<>", C("age"), L(5)), p.Between(C("age"), L(2), L(9)), p.Between(C("age"), L(2), L(9), True), p.In(C("name"), (L("ab"),)), p.In(C("name"), (L("ab"),), True),
        p.Like(C("name"), "a\\%", escape="\\"), p.Like(C("name"), "A_", True, True), C("active"), p.Is(C("active"), True, True), p.Is(C("active"), False), p.Is(C("profile", "city"), None), p.Cmp("=", C("profile", "city"), L("c")),
    ]
    tests = leaves + [p.Not(x) for x in leaves] + [f(x, y) for x, y in itertools.combinations(leaves, 2) for f in (p.And, p.Or, lambda a, b: p.Not(p.And(a, b)), lambda a, b: p.Not(p.Or(a, p.Not(b))))]
    texts = [json.dumps(d) for d in docs]
    df = decode(spark.createDataFrame([(t,) for t in texts], "doc string").coalesce(1), SCHEMA).select(*[p.column(e).alias(f"t{k}") for k, e in enumerate(tests)])
    rows = df.collect()
    for k, e in enumerate(tests):
        t = p.translate(e, SCHEMA)
        got = [p.matches(t.filter, parse(x)) for x in texts]
        want = [r[k] is True for r in rows]
        assert got == want if t.exact else all(g or not w for g, w in zip(got, want, strict=True)), e


ODD = """null 1 -7 2147483648 -9223372036854775808 12345678901234567890 1.0 4.0 2.5 1e3 1e400 0.1 123456.789012345678 true false "x" "7" "2.5" "" "1e5" "1_0" {"$oid":"0123456789ABCDEF01234567"} {"$oid":"zz"}
{"$date":"2020-01-02T03:04:05.060Z"} {"$date":"2020-13-02T03:04:05Z"} {"$date":"2020-01-02T03:04:05+01:00"} {"$date":{"$numberLong":"5000"}} {"$date":"0001-01-01T00:00:00Z"} {"$date":99999999999999999} {"$numberInt":"5"} {"$numberLong":"99"}
{"$numberDouble":"NaN"} {"$numberDecimal":"12.3456789012345"} {"$numberDecimal":"-0.1"} {"$numberDecimal":"1E5"} {"$numberDecimal":"1234567890123456789012345678901234567890"} {"$timestamp":{"t":5,"i":1}} {"$binary":{"base64":"Zm9v","subType":"00"}}
{"$binary":{"base64":"Zm9","subType":"00"}} {"$undefined":true} {"$code":"x"} {} {"a":1} {"a":"y","b":2} {"b":1.50,"a":null} {"a":{"$oid":"0123456789ABCDEF01234567"}} {"b":{"z":1,"a":[true,null]},"a":"\\u00e9\\n"} [] [1,2] ["x",1] [null] [true,"x",{"a":1}]
[[1],[2]] [{"a":1},{"b":2}] [1.5] [{"$undefined":true}] -0 -0.0 NaN Infinity "\\u00e9\\n" [{"$numberLong":"5"}]""".split()
KINDS = "boolean/bool int/int32 bigint/int64 double/double string/string string/json string/objectId binary/binary timestamp/date decimal(38,10)/decimal decimal(5,0)/decimal array<string>/array:string array<int>/array:int32 array<array<int>>/array struct<a:int,b:double>/document struct<a:string>/document array<struct<a:int,b:int>>/array".split()


@pytest.mark.parametrize("kind", KINDS)
def test_expressions_decode_as_python_does(spark, kind):
    name, tag = kind.split("/")
    docs = [None, "", "  ", "{bad", "[1]", "5", '{"v":1,"v":2}', '{"w":1}', "{}", *(f'{{"v":{x}}}' for x in ODD)]
    schema = T.StructType([T.StructField("v", T._parse_datatype_string(name), True, {"path": "v", "tag": tag})])
    got = decode(spark.createDataFrame([(d,) for d in docs], "doc string").coalesce(1), schema).toArrow().column("v").to_pylist()
    want = batch_of(schema, [parse(d) for d in docs]).column(0).to_pylist()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_shapes_tell_types_apart(spark):
    texts = [f'{{"k1":{x}, "a,5,b":[{y}]}}' for x in ODD for y in ('1', '"x"', "2.5")]
    rows = spark.createDataFrame([(t,) for t in texts], "doc string").select("doc", inference.shape(F.col("doc")).alias("s")).collect()
    seen = {}
    for r in rows:
        counts = Counter()
        inference.observe(parse(r["doc"]), counts)
        assert seen.setdefault(r["s"], counts) == counts, r["doc"]
    assert len(seen) < len(rows)


def test_newest_by_number(spark):
    texts = [f'{{"_id":{k}}}' for k in range(1, 1201)] + ['{"_id":{"$numberLong":"5000"}}', '{"_id":"z"}', "{}"]
    docs = spark.createDataFrame([(t,) for t in texts], "doc string").select("doc", inference.id_key(F.col("doc")).alias("_id"))
    assert [r[0] for r in inference.sample(docs, 4, 1.0).select("doc").collect()] == ['{"_id":"z"}', '{"_id":{"$numberLong":"5000"}}', '{"_id":1200}', '{"_id":1199}']


def test_scan_plans_run(spark):
    docs = spark.createDataFrame([(f'{{"_id":{k},"n":{k % 5},"s":"v{k % 3}","o":{{"x":{k}}}}}',) for k in range(100)] + [('{"_id":200}',)], "doc string")
    schema = infer_local([r[0] for r in docs.collect()])
    got = scan.ScanPlan({"$or": [{"n": {"$gte": 3}}, {"n": None}]}, {"_id": {"$gte": 50}}, ["_id", "o.x"], [("_id", False)], 1, 3).run(docs, schema).collect()
    assert [tuple(r) for r in got] == [(99, 99), (98, 98), (94, 94)]
    assert scan.ScanPlan({"s": {"$in": ["v1"]}, "n": {"$not": {"$eq": 1}}}).run(docs, schema).count() == sum(k % 3 == 1 and k % 5 != 1 for k in range(100))
    assert scan.ScanPlan({"n": {"$ne": 1}}).run(docs, schema).count() == 81 and scan.ScanPlan({"s": {"$regex": "^v[12]$"}}, limit=0).run(docs, schema).count() == 0


def test_scan_plans():
    plan = scan.ScanPlan({"age": {"$gt": 18}}, {"_id": {"$lt": 9}}, ["name"], [("age", False)], 10, 5)
    assert plan.stages() == [{"$match": {"$and": [{"age": {"$gt": 18}}, {"_id": {"$lt": 9}}]}}, {"$sort": {"age": -1}}, {"$skip": 10}, {"$limit": 5}, {"$project": {"name": 1, "_id": 0}}]
    assert scan.ScanPlan(limit=0).stages() == [{"$limit": 0}] and scan.ScanPlan().stages() == []
    assert scan.projection(["a.b", "a", "_id", "ab"]) == {"a": 1, "_id": 1, "ab": 1}


def test_ranges_cover_everything_once():
    for ids, n in ((list(range(100)), 4), ([5] * 8, 4), (list(range(10)), 1), ([], 3), (list(range(3)), 8)):
        got = scan.ranges(ids, n)
        assert len(got) <= n
        for x in range(-2, 103):
            assert sum(all((x >= v if k == "$gte" else x < v) for k, v in (r or {}).get("_id", {}).items()) for r in got) == 1
    assert len(scan.ranges([5] * 8, 4)) == 2 and scan.parallelism(99_999) == 1 and scan.parallelism(10**6, 5) == 5 and scan.parallelism(10**6, 5, 10) == 1
    assert scan.ids_wanted(4) == 256 and scan.ids_wanted(1000) == 10_000 and scan.estimated(100, 1000, True, 2) == {"rows": 20, "bytes": 200, "rows_per_part": 10}


def test_catalog_file(tmp_path):
    path = str(tmp_path / "c" / "catalog.json")
    store = CatalogStore(path)
    store.put("a.b", SCHEMA, Stats(42, 1, 2, ["_id"]), now=100)
    again = CatalogStore(path)
    assert again.get("a.b").schema == SCHEMA and again.get("a.b").schema["_id"].metadata == SCHEMA["_id"].metadata and again.get("a.b").stats.docs == 42
    assert again.get_fresh("a.b", 10, now=110) and not again.get_fresh("a.b", 10, now=111) and again.get_fresh("a.b", 0, now=10**9)
    assert again.known("a") == ["b"] and again.known("b") == []
    (tmp_path / "bad.json").write_text("{")
    assert CatalogStore(str(tmp_path / "bad.json")).records == {}
    (tmp_path / "old.json").write_text('{"version": 0, "tables": {}}')
    assert CatalogStore(str(tmp_path / "old.json")).records == {}


def test_names_and_uris():
    assert reg.redact("db://user:p@ss@host/x") == "db://***@host/x" and reg.redact("db://host/x") == "db://host/x"
    assert reg.fits("tmp_*", "tmp_a") and not reg.fits("tmp", "tmp_a") and reg.fits("a", "a")


def test_overrides_and_refresh(spark):
    r = reg.Registry(spark, settings=reg.Settings(overrides={"d.c": {"n": ("bigint", True), "extra": ("string", True)}}))
    r.add("d", "c", spark.createDataFrame([('{"_id": 1, "n": 2}',)], "doc string"))
    assert r.resolve("d", "c").schema["n"].dataType == T.LongType() and "extra" in r.resolve("d", "c").columns
    assert r.resolve("d", "none") is None
    r.add("d", "new", spark.createDataFrame([('{"_id": 1}',)], "doc string"))
    assert r.resolve("d", "new").count() == 1
    r.add_table("d", "t", spark.range(1))
    assert r.listing("d") == ["t"]  # registered schemas shadow databases


def test_registration_opens_the_source(spark, tmp_path):
    r = reg.Registry(spark)
    for docs in (lambda: spark.read.text(f"{tmp_path}/none").toDF("doc"), spark.range(1), spark.range(1).toDF("doc")):
        with pytest.raises(ValueError, match="cannot open d.c"):
            r.add("d", "c", docs)
    assert r.listing("d") == []


def test_ddl_of_a_database(spark):
    r = reg.Registry(spark)
    docs = ['{"_id": {"$oid": "65a000000000000000000001"}, "ownerId": "0f8fad5b-d9cb-469f-a165-70867728950e", "memo": "0f8fad5b-d9cb-469f-a165-70867728950e", "a\\"b": 1}', '{"_id": {"$oid": "65a000000000000000000002"}, "tags": ["x"]}']
    r.add("d", "c", spark.createDataFrame([(x,) for x in docs], "doc string"))
    r.add("d", "none", spark.createDataFrame([], "doc string"))
    r.add_table("plain", "t", spark.sql("SELECT CAST(1.5 AS DECIMAL(5, 2)) AS n, '{}' AS j"))
    made = reg.database_ddl(r, "d", references={"ownerId": "profile(_id)"}).split("\n")
    assert made[0] == 'CREATE TABLE IF NOT EXISTS "c" (' and any(x.startswith('    "_id" CHAR(24)') and " PRIMARY KEY" in x for x in made)
    assert any(x.startswith('    "ownerId" UUID') and x.endswith("-- references profile(_id)") for x in made)
    assert any(x.startswith('    "memo" TEXT') for x in made) and any(x.startswith('    "a""b" INTEGER') for x in made) and any(x.startswith('    "tags" JSONB') for x in made)
    assert any('"none"' in x for x in made)
    plain = reg.database_ddl(r, "plain")
    assert '"n" NUMERIC(5,2) NOT NULL,' in plain and '"j" JSONB' in plain


def test_document_source(spark, tmp_path):
    docs = [{"_id": k, "n": k if k % 3 else None, "s": f"v{k % 5}", "big": "x" * (k % 97)} for k in range(3000)]
    (tmp_path / "docs").mkdir()
    for k in range(3):
        (tmp_path / "docs" / f"{k}.json").write_text("\n".join(json.dumps(d) for d in docs[k::3]) + ("\n" if k else ""))
    register_source(spark)
    register_source(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = infer_local([json.dumps(d) for d in docs])
    want = {"n > 100": 0, "n NOT IN (1, 2)": 0, "n IS NULL": 0, "s LIKE 'v1%'": 0, "s = 'v2' AND _id < 50": 0, "NOT (n = 4)": 0}
    for push in ("true", "false"):
        for complete in ("true", "false"):
            t = spark.read.format("documents").schema(schema).options(path=str(tmp_path / "docs"), pushdown=push, complete=complete, split="4096").load()
            assert t.count() == 3000 and t.select("_id").distinct().count() == 3000
            for c in want:
                n = t.where(c).count()
                assert want[c] in (0, n) and n
                want[c] = n
