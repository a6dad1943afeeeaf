"""Statements, rewrites, the system catalog, rendering and the query API."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarrel.functions import aliases
from quarrel.plans import compat, render, sqltext
from quarrel.plans.service import Engine, QueryError, QueryTimeout, sqlstate
from quarrel.sources.registry import Registry


@pytest.fixture(scope="module")
def engine(spark):
    out = Engine(spark, Registry(spark))
    docs = ['{"_id": 1, "name": {"TH": "x"}, "type": "group"}', '{"_id": 2, "name": {"TH": "y"}, "type": "person"}']
    out.registry.add("mailbox", "profile", out.spark.createDataFrame([(d,) for d in docs], "doc string"))
    return out


def test_splitting():
    split = sqltext.split_statements
    assert split("a; b ;; c") == ["a", "b", "c"] and split("") == [] and split(" ; ") == []
    assert split("select ';' ; select 'it''s;'") == ["select ';'", "select 'it''s;'"]
    assert split('select "a;b"; -- x ; y\nselect 2 /* ; */') == ['select "a;b"', "-- x ; y\nselect 2 /* ; */"]
    assert split("select $$a;b$$; x") == ["select $$a;b$$", "x"]


def test_interception():
    tag = lambda s: compat.intercept(s).text
    assert tag("SET a = 1;") == "SET" and tag("begin") == "BEGIN" and tag("  ") == "EMPTY" and tag("/* x */ COMMIT") == "COMMIT"
    assert compat.intercept("SELECT 1") is None and compat.intercept("SHOW TABLES") is None
    assert "read committed" in compat.intercept("SHOW transaction isolation level").sql
    for s in ("INSERT INTO a VALUES (1)", "drop table x", "CREATE TABLE x (a int)"):
        with pytest.raises(compat.ReadOnlyError):
            compat.intercept(s)


def test_catalog_names_are_rewritten_only_where_they_are_relations():
    r = compat.rewrite_catalog
    assert r("SELECT * FROM pg_type t") == "SELECT * FROM pg_catalog__pg_type t"
    assert r("SELECT * FROM pg_catalog.pg_class") == "SELECT * FROM pg_catalog__pg_class"
    assert r("SELECT t.pg_type, 'pg_type', \"pg_type\" -- pg_type\nFROM x") == "SELECT t.pg_type, 'pg_type', \"pg_type\" -- pg_type\nFROM x"
    assert r("SELECT pg_catalog.version()").startswith("SELECT 'PostgreSQL 16.6")
    assert r("SELECT xpg_type FROM information_schema.Tables") == "SELECT xpg_type FROM information_schema__tables"


def test_object_ids(spark):
    names = ["", "a", "a.very.long.name.with.dots", "😀", "region"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", compat.oid_column(F.col("n")).alias("o")).collect()
    assert all(r["o"] == compat.oid(r["n"]) >= 0 for r in rows)
    assert compat.oid("a") == 0xE40C292C & 0x7FFFFFFF


def test_system_catalog(engine):
    got = engine.sql("SELECT n.nspname, c.relname FROM pg_catalog.pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind = 'r'").collect()
    assert [tuple(r) for r in got] == [("mailbox", "profile")]
    assert engine.sql("SELECT attname FROM pg_attribute ORDER BY attnum").first()[0] == "_id"
    assert engine.sql("SELECT t.oid FROM pg_type t JOIN pg_namespace ns ON typnamespace = ns.oid WHERE typname = 'hstore'").count() == 0
    assert engine.sql("SELECT * FROM pg_index").count() == 0 and engine.sql("SHOW nothing").first()[0] == ""


def test_queries_over_collections(engine):
    assert engine.sql("SELECT p.name['TH'] AS n FROM mailbox.profile p WHERE p.\"type\" = 'group'").first()["n"] == "x"
    assert engine.describe("SELECT _id, name FROM mailbox.profile") == [("_id", "int4"), ("name", "text")]
    assert engine.sql("SELECT count(*) AS n FROM mailbox.profile WHERE _id > :x", {"x": 1}).first()["n"] == 1
    assert [isinstance(x, compat.Tag) for x in engine.run("BEGIN; SELECT 1; COMMIT")] == [True, False, True]


def test_only_the_columns_a_plan_reads_are_decoded(engine):
    plan = lambda sql: engine.sql(sql)._jdf.queryExecution().analyzed().toString()
    assert '["type"]' not in plan("SELECT _id FROM mailbox.profile") and '["type"]' in plan("SELECT * FROM mailbox.profile")
    assert '["type"]' not in plan("SELECT a._id FROM mailbox.profile a JOIN mailbox.profile b ON a._id = b._id WHERE a.name IN (SELECT name FROM mailbox.profile)")
    assert '["' not in plan("SELECT count(*) FROM mailbox.profile")
    assert '["type"]' not in plan("SELECT _id FROM (SELECT _id, \"type\" FROM mailbox.profile)")
    assert engine.sql("SELECT count(*) AS n FROM mailbox.profile").first()["n"] == 2
    assert engine.sql("SELECT * FROM mailbox.profile").columns == ["_id", "name", "type"]
    assert "type" in engine.sql("EXPLAIN SELECT * FROM mailbox.profile").first()[0]


@pytest.mark.parametrize("text", ["WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{0}' USING parquet SELECT * FROM a", "FROM (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{0}' USING parquet SELECT x", "EXPLAIN INSERT INTO t VALUES (1)", "SELECT \"reflect\"('java.lang.System', 'nanoTime')", "BEGIN SELECT 1; END"])
def test_no_statement_writes(engine, tmp_path, text):
    for way in (engine.sql, engine.query):
        try:
            way(text.format(tmp_path / "out"))
        except Exception as e:
            assert sqlstate(e) in ("25006", "42601")
        else:
            assert text.startswith("BEGIN")  # acknowledged, and not run
    assert not (tmp_path / "out").exists()


def test_query_api(engine):
    got = engine.query("SELECT id, id * 0.5D AS h, CAST(NULL AS STRING) AS n FROM range(20) ORDER BY id;", limit=3)
    assert got["columns"] == ["id", "h", "n"] and got["rows"] == [["0", "0", ""], ["1", "0.5", ""], ["2", "1", ""]] and got["truncated"] and got["row_count"] == 3
    assert engine.query("SELECT ';' AS a WHERE false")["columns"] == ["a"]
    assert engine.query("SELECT 1", limit=0)["row_count"] == 1 and not engine.query("SELECT 1")["truncated"]
    for sql, state in (("", "42601"), ("SELECT 1; SELECT 2", "42601"), ("DROP TABLE x", "25006"), ("SET x = 1", "25006")):
        with pytest.raises(QueryError) as e:
            engine.query(sql)
        assert e.value.sqlstate == state
    with pytest.raises(QueryError):
        engine.query("SELECT 1", enabled=False)


def test_errors_have_states(engine):
    for sql, state in (("SELECT * FROM nowhere_to_be_found", "42P01"), ("SELEC 1", "42601"), ("SELECT no_such_column FROM mailbox.profile", "42601")):
        with pytest.raises(Exception) as e:  # noqa: PT011
            engine.sql(sql).collect()
        assert sqlstate(e.value) == state
    with pytest.raises(Exception) as e:  # noqa: PT011
        engine.sql("SELECT 1 / CAST(id AS INT) AS x FROM range(3)").collect()
    assert sqlstate(e.value) in ("58000", "22012")


def test_deadline(engine):
    with pytest.raises(QueryTimeout):
        engine.query("SELECT sum(a.id * b.id % 7) AS s FROM range(3000000) a CROSS JOIN range(3000000) b", seconds=2)


def test_health_listing_and_tree(engine):
    assert engine.health()["status"] == "ok" and engine.listing() == {"mailbox": ["profile"]}
    t = engine.table("mailbox", "profile", refresh=True)
    assert t["stats"]["docs"] == 2 and [c["name"] for c in t["columns"]] == ["_id", "name", "type"] and t["columns"][1]["fields"][0]["path"] == "name.TH"
    with pytest.raises(QueryError):
        engine.table("mailbox", "none")


def test_json_text():
    assert render.json_text(Row(b=None, a=[1.0, float("nan")])) == '{"b":null,"a":[1,null]}'
    assert render.quoted('a"\\\n\t\x01é') == '"a\\"\\\\\\n\\t\\u0001é"'
    assert render.json_text([b"\x00\xff", Decimal("1.50"), True, datetime.datetime(2020, 1, 2, tzinfo=datetime.timezone.utc)]) == '["00ff",1.50,true,"2020-01-02T00:00:00+00:00"]'


def test_json_columns(spark):
    df = spark.sql("SELECT named_struct('d', double('NaN'), 'b', X'00FF', 't', timestamp'2020-01-02 03:04:05.060', 'n', CAST(NULL AS INT)) AS s, array(1, NULL) AS a, 5 AS k")
    r = render.for_clients(df).first()
    assert r["s"] == '{"d":null,"b":"00ff","t":"2020-01-02T03:04:05.060+00:00","n":null}' and r["a"] == "[1,null]" and r["k"] == 5


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT gcd(12, 18), lcm(4, 6), gcd(0, 5), lcm(0, 3)", (6, 12, 5, 0)),
        ("SELECT trunc(-2.789D, 2), iszero(0), strpos('hello', 'l'), to_hex(255)", (-2.78, True, 3, "ff")),
        ("SELECT encode('foo', 'base64'), encode('foo', 'hex'), concat('a', NULL, 'b')", ("Zm9v", "666f6f", "ab")),
        ("SELECT array_has(make_array(1, 2), 2), array_length(make_array(1)), array_to_string(array_replace(make_array(1, 2, 1), 1, 9), '-')", (True, 1, "9-2-1")),
        ("SELECT array_slice(make_array(1, 2, 3, 4), 2, 3), array_pop_back(make_array(1, 2)), array_positions(make_array(5, 6, 5), 5), string_to_array('a.b', '.')", ([2, 3], [1], [1, 3], ["a", "b"])),
        ("SELECT date_part('dow', DATE'2024-01-01'), extract(epoch FROM TIMESTAMP'1970-01-02'), to_char(DATE'2024-02-03', '%d.%m.%Y')", (1, 86400, "03.02.2024")),
        ("SELECT 'abc' SIMILAR TO 'a%', 'abc' NOT SIMILAR TO '(x|y)', 'abc' ~ 'b', 'abc' !~ 'b', 'ABC' ~* 'b', 2 = ANY(array(1, 2))", (True, True, True, False, True, True)),
        ("SELECT array_remove(make_array(1, 2, 1), 1), array_remove_n(make_array(1, 2, 1, 1), 1, 2), array_remove_all(make_array(1, 2, 1), 1), list_remove(make_array(3), 4)", ([2, 1], [2, 1], [2], [3])),
        ("SELECT array_replace_n(make_array(1, 2, 1, 1), 1, 9, 2), array_replace(make_array(NULL, 1, NULL), NULL, 5), array_replace_n(make_array(1), 1, 9, 0)", ([9, 2, 9, 1], [5, 1, None], [1])),
        ("SELECT array_any_value(make_array(NULL, 2)), array_empty(make_array(1)), list_has(make_array(1), 1), string_to_list('a|b', '|'), list_sort(make_array(2, 1))", (2, False, True, ["a", "b"], [1, 2])),
        ("SELECT arrow_cast('12', 'Int64'), arrow_cast(2.5, 'Decimal128(5, 1)') = 2.5, typeof(arrow_cast(1, 'UInt32')), unix_micros(to_timestamp_nanos(-1)), unix_micros(to_timestamp_nanos(1700000000123456789))", (12, True, "bigint", -1, 1700000000123456)),
        ("SELECT array_agg(x ORDER BY y DESC, x), array_agg(DISTINCT x ORDER BY x NULLS FIRST) FILTER (WHERE y > 1 OR y IS NULL), array_agg(x ORDER BY y) FROM VALUES (1, 2), (3, 2), (NULL, 1), (3, NULL) t(x, y)", ([3, 1, 3, None], [1, 3], [None, 1, 3, 3])),
        ("SELECT approx_percentile_cont_with_weight(x, w, 0.5) FROM VALUES (1, 1), (5, 3) t(x, w)", (5.0,)),
        ("SELECT regexp_match('a1b22', '[0-9]+'), array_ndims(make_array(make_array(1))), array_resize(make_array(1), 3, 0)", (["1", "22"], 2, [1, 0, 0])),
    ],
)
def test_names_of_other_engines(spark, sql, want):
    assert tuple(spark.sql(aliases.rewrite(sql)).first()) == want


def test_rewrites_leave_strings_alone():
    s = "SELECT 'strpos(a, b) ~ QUALIFY', \"gcd\" FROM t"
    assert aliases.rewrite(s) == s
