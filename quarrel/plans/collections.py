"""Queries over document collections: inference, decode, predicates, scans, catalog, rendering and the service.

The collection is made from ``orders`` and ``customer``: one extended-JSON document per order, with fields whose types
vary, conflict, or are missing, so that the expected result can be put in SQL over the same tables.
"""

from __future__ import annotations

import json
import re
import tempfile
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrel.operators import predicate as p
from quarrel.operators.decode import decode
from quarrel.operators.infer import id_key, infer, is_mixed, sample, tag_of
from quarrel.plans import compat, render
from quarrel.plans.service import Engine, sqlstate
from quarrel.session import scoped, shared_folder
from quarrel.sources import registry as reg
from quarrel.sources.documents import load
from quarrel.sources.store import CatalogStore
from quarrel.values import parse

NEWEST = 99


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, k): one document per order and its key."""
    # A small file is one row group, which one task reads; a collection comes in many parts.
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(spark.sparkContext.defaultParallelism)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    newest = orders.select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(NEWEST).agg(F.min("o_orderkey").alias("least"))
    k = "o_orderkey"
    fields = [
        f"""concat('"_id":{{"$oid":"', lpad(lower(hex({k})), 24, '0'), '"}}')""",
        f"""concat('"orderNo":', {k})""",
        """concat('"status":"', o_orderstatus, '"')""",
        f"""concat('"qty":', {k} % 50, CASE WHEN {k} % 10 = 0 THEN '.5' ELSE '' END)""",
        f"""CASE WHEN {k} % 5 = 0 THEN NULL WHEN {k} % 7 = 0 THEN concat('"note":{{"text":"n', {k}, '"}}') ELSE concat('"note":"n', {k}, '"') END""",
        f"""CASE WHEN {k} % 11 = 0 THEN '"tags":null' WHEN {k} % 4 = 0 THEN concat('"tags":"t', {k} % 3, '"') ELSE concat('"tags":["t', {k} % 3, '","u"]') END""",
        f"""CASE WHEN {k} % 13 = 0 THEN NULL ELSE concat('"customer":{{"name":"', c_name, '"', CASE WHEN {k} % 3 = 0 THEN '' ELSE concat(',"city":"', c_mktsegment, '"') END, '}}') END""",
        f"""CASE WHEN {k} >= least THEN '"channel":"mobile"' END""",
        """concat('"total":{"$numberDecimal":"', cast(cast(o_totalprice as decimal(18,2)) as string), '"}')""",
        """concat('"createdAt":{"$date":"', date_format(o_orderdate, 'yyyy-MM-dd'), 'T00:00:00Z"}')""",
        f"""concat('"flag":', CASE WHEN {k} % 6 = 0 THEN 'null' WHEN {k} % 2 = 0 THEN 'true' ELSE 'false' END)""",
        f"""concat('"deep":{{"a":{{"b":{{"c":{{"d":{{"e":', {k}, '}}}}}}}}}}')""",
    ]
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey, "left").crossJoin(F.broadcast(newest))
    return joined.select(F.expr(f"concat('{{', concat_ws(',', {', '.join(fields)}), '}}')").alias("doc"), F.col(k).alias("k"))


def engine(spark: SparkSession, sf_dir: str, **settings) -> Engine:
    """An engine with the collection as ``shop.orders``, and two tables as its database ``mailbox``."""
    registry = reg.Registry(spark, CatalogStore(), reg.Settings(**settings))
    out = Engine(spark, registry)
    own = out.spark
    registry.add("shop", "orders", lambda: collection(own, sf_dir).select("doc"))
    registry.add("shop", "system.views", lambda: own.createDataFrame([], "doc string"))
    registry.add("shop", "tmp_old", lambda: own.createDataFrame([], "doc string"))
    registry.add("admin", "users", lambda: own.createDataFrame([], "doc string"))
    people = "concat('{\"_id\":', c_custkey, ',\"type\":\"', CASE WHEN c_custkey % 4 = 0 THEN 'group' ELSE 'person' END, '\",\"primaryName\":{\"TH\":\"', c_name, '\"}}')"
    sent = "concat('{\"_id\":', o_orderkey, ',\"senderId\":', o_custkey, ',\"size\":', cast(o_totalprice as decimal(18,2)), '}')"
    registry.add("mailbox", "profile", lambda: own.read.parquet(f"{sf_dir}/customer.parquet").select(F.expr(people).alias("doc")))
    registry.add("mailbox", "sender", lambda: own.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr(sent).alias("doc")))
    return out


def decoded(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    docs = collection(scoped(spark), sf_dir).select("doc")
    return decode(docs, infer(docs), columns=columns)


def _leaves(schema, prefix=""):
    for f in schema:
        kind = f.dataType
        yield prefix + f.name, kind.simpleString() if not hasattr(kind, "fields") else "struct", tag_of(f), is_mixed(f), f.nullable
        if hasattr(kind, "fields"):
            yield from _leaves(kind, f"{prefix}{f.name}.")


def inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inferred schema of the whole collection as rows."""
    rows = list(_leaves(infer(collection(scoped(spark), sf_dir))))
    return spark.createDataFrame(rows, "path string, type string, tag string, mixed boolean, nullable boolean")


def inferred_from_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a sample that favours the newest documents: the field that only they have is found."""
    schema = engine(spark, sf_dir).registry.record("shop", "orders").schema
    return spark.createDataFrame([(f.name, tag_of(f)) for f in schema], "name string, tag string")


def decoded_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the collection, decoded and flattened to text and numbers."""
    return decoded(spark, sf_dir).select(
        "_id", F.col("orderNo").alias("order_no"), "status", "qty", "note", F.array_join("tags", ",").alias("tags"), F.col("customer.name").alias("name"), F.col("customer.city").alias("city"), "channel",
        F.col("total").cast("decimal(18,2)").cast("string").alias("total"), F.date_format("createdAt", "yyyy-MM-dd").alias("created"), "flag", F.col("deep.a.b.c.d").alias("deep_d"),
    )


def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for predicates, by the engine's columns and by the document filter on the raw documents, in one pass each.

    The two agree where the filter is exact; elsewhere the filter lets more through.
    """
    docs = collection(scoped(spark), sf_dir).select("doc")
    schema = infer(docs)
    found = {name: p.translate(e, schema) for name, e in PREDICATES.items()}
    rows = decode(docs, schema)
    counted = rows.agg(*(F.count(F.when(p.column(e), 1)).alias(name) for name, e in PREDICATES.items()))
    counted = counted.select(F.explode(F.create_map(*(x for n in PREDICATES for x in (F.lit(n), F.col(n))))).alias("predicate", "n"))
    raw = docs.mapInArrow(_passed({n: t.filter for n, t in found.items() if t}), "predicate string, passed long").groupBy("predicate").agg(F.sum("passed").alias("passed"))
    told = spark.createDataFrame([(n, json.dumps(p.shown(t.filter), sort_keys=True) if t else "none", bool(t and t.exact)) for n, t in found.items()], "predicate string, filter string, exact boolean")
    return counted.join(F.broadcast(told), "predicate").join(F.broadcast(raw), "predicate", "left").select("predicate", "n", "passed", "filter", "exact")


def _passed(filters: dict[str, dict]):
    def run(batches):
        seen = dict.fromkeys(filters, 0)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                doc = parse(text)
                for name, f in filters.items():
                    seen[name] += p.matches(f, doc)
        yield pa.RecordBatch.from_pydict({"predicate": pa.array(list(seen), pa.string()), "passed": pa.array(list(seen.values()), pa.int64())})

    return run


def C(*names: str) -> p.Col:  # noqa: N802
    return p.Col(names)


L = p.Lit
PREDICATES: dict[str, p.Expr] = {
    "p1": p.Cmp("=", C("status"), L("F")),
    "p2": p.Cmp("<>", C("channel"), L("mobile")),
    "p3": p.Cmp(">=", C("orderNo"), L(100)),
    "p4": p.Cmp("<", L(100), C("orderNo")),
    "p5": p.And(p.Cmp("=", C("status"), L("F")), p.Cmp("<", C("orderNo"), C("qty"))),
    "p6": p.Or(p.Cmp("=", C("status"), L("P")), p.Cmp("<", C("qty"), L(3.0))),
    "p7": p.Not(p.And(p.Cmp("=", C("channel"), L("mobile")), p.Cmp("=", C("status"), L("F")))),
    "p7b": p.Not(p.Cmp("=", C("channel"), L("mobile"))),
    "p8": p.Is(C("channel"), None),
    "p9": p.Is(C("channel"), None, True),
    "p10": p.Is(C("flag"), True),
    "p11": p.Is(C("flag"), True, True),
    "p12": C("flag"),
    "p13": p.Between(C("orderNo"), L(10), L(90)),
    "p14": p.Between(C("qty"), L(5.0), L(45.0), True),
    "p15": p.In(C("status"), (L("F"), L("P"))),
    "p16": p.In(C("channel"), (L("mobile"),), True),
    "p17": p.Like(C("customer", "name"), "Customer#%1"),
    "p18": p.Like(C("status"), "f", fold=True),
    "p19": p.Like(C("status"), "F", True),
    "p21": p.Similar(C("status"), "(F|O)"),
    "p24": p.Cmp("=", C("customer", "city"), L("BUILDING")),
}


_CONDITIONS = {"status": "status = 'F'", "range": "orderNo BETWEEN 10 AND 500 AND qty > 3", "not_in": "channel NOT IN ('web')", "null": "channel IS NULL", "like": "customer.name LIKE 'Customer%'", "or": "status = 'P' OR flag", "nested": "customer.city = 'BUILDING'"}


def pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements over a collection of files: counts, and whether the plan has the filter at the file scan and reads no other field."""
    e = engine(spark, sf_dir)
    path = f"{shared_folder(e.spark)}/docs"
    collection(e.spark, sf_dir).select("doc").write.text(path)
    e.registry.add("files", "orders", lambda: e.spark.read.text(path).toDF("doc"))
    out = []
    for name, condition in _CONDITIONS.items():
        df = e.sql(f"SELECT count(*) AS n FROM files.orders WHERE {condition}")
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.split("\n") if "FileScan" in line]
        named = set(re.findall(r"[A-Za-z_]+", condition))
        read = set(re.findall(r'\$\["(\w+)"\]', plan))
        # From the scan upwards: the parse, shapes of the fields named, and then the condition, before anything is joined or counted.
        above = [line.strip(" +-:*()0123456789").split(" ")[0] for line in plan.split("\n")]
        reached = read <= named and len(read) == len(named & {"status", "orderNo", "qty", "channel", "customer", "flag"}) and all("Filter" in above[max(0, k - 4) : k] for k, x in enumerate(above) if x == "FileScan")
        out.append(df.select(F.lit(name).alias("predicate"), "n", F.lit(bool(scans) and reached).alias("at_the_scan")))
    return reduce(DataFrame.unionAll, out)


_EDGES = {"nan": "x > 3", "not_less": "NOT (x < 3)", "wide": "y = 9007199254740992D", "at_most": "y <= 9007199254740992D", "between": "x BETWEEN 2 AND 5", "outside": "x NOT BETWEEN 2 AND 5", "in": "y IN (9007199254740992D)", "late": "t IS NULL", "cut": "d = 1", "not_true": "b IS NOT TRUE", "text": "s = '5'"}


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that decoding changes (NaN, wide integers, cut decimals, times out of range, other types): the same rows by the source, with pushdown on and off, and by the engine."""
    e = engine(spark, sf_dir)
    k = "o_orderkey"
    x = f"""CASE WHEN {k} % 3 = 0 THEN '{{"$numberDouble":"NaN"}}' ELSE concat({k} % 7, '.5') END"""
    t = f"""CASE WHEN {k} % 4 = 0 THEN '{{"$date":{{"$numberLong":"99999999999999999"}}}}' ELSE '{{"$date":"2020-01-01T00:00:00Z"}}' END"""
    d = f"""CASE WHEN {k} % 2 = 0 THEN '1.000000000001' ELSE '2' END"""
    b = f"""CASE WHEN {k} % 5 = 0 THEN '"yes"' WHEN {k} % 5 = 1 THEN 'false' ELSE 'true' END"""
    s = f"""CASE WHEN {k} % 3 = 1 THEN '5' ELSE '"5x"' END"""
    doc = f"""concat('{{"_id":', {k}, ',"x":', {x}, ',"y":', 9007199254740991 + {k} % 4, ',"t":', {t}, ',"d":{{"$numberDecimal":"', {d}, '"}},"b":', {b}, ',"s":', {s}, '}}')"""
    path = f"{shared_folder(e.spark)}/edges"
    e.spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"{doc} AS doc").write.text(path)
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(kind), True, {"path": n, "tag": tag}) for n, kind, tag in (("x", "double", "double"), ("y", "double", "double"), ("t", "timestamp", "date"), ("d", "decimal(38,10)", "decimal"), ("b", "boolean", "bool"), ("s", "string", "string"))])
    out = []
    for name, condition in _EDGES.items():
        ways = {"engine": decode(e.spark.read.text(path).toDF("doc"), schema), "source": load(e.spark, path, schema), "source_off": load(e.spark, path, schema, pushdown="false")}
        out += [df.where(condition).agg(F.count("*").alias("n")).select(F.lit(name).alias("predicate"), F.lit(way).alias("way"), "n") for way, df in ways.items()]
    return reduce(DataFrame.unionAll, out)


def id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each range of a scan split eight ways: every row is in one range."""
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("_id"))
    parts = reg.split_filters(ids, 8)
    hits = sum((c.cast("int") for c in parts), F.lit(0))
    return ids.agg(F.count("*").alias("rows_n"), F.min(hits).alias("least"), F.max(hits).alias("most"))


def planned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan plan run by the engine: filter, order, offset, limit and columns; its stages as text."""
    plan, rows = engine(spark, sf_dir).scan("shop", "orders", [p.Cmp("=", C("status"), L("F"))], columns=["_id", "status"], sort=[("_id", False)], skip=3, limit=5)
    return rows.select("_id", "status", F.lit(" ".join(next(iter(s)) for s in plan.stages())).alias("stages"))


def numeric_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest documents by numeric ids, some written with a wrapper: by their numbers, not their text."""
    e = engine(spark, sf_dir)
    docs = e.spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("""concat('{"_id":', CASE WHEN o_orderkey % 3 = 0 THEN concat('{"$numberLong":"', o_orderkey, '"}') ELSE string(o_orderkey) END, '}') AS doc""", "o_orderkey AS k")
    return sample(docs.withColumn("_id", id_key(F.col("doc"))), NEWEST, 1.0).select("k")


def _scalar(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = engine(spark, sf_dir).registry.stats("shop", "orders")
    return _scalar(spark, [(s.docs, s.bytes > 0, s.mean_bytes > 0, ",".join(s.indexed))], "docs long, has_bytes boolean, has_mean boolean, indexed string")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases and collections without those of the store itself and the excluded ones."""
    found = engine(spark, sf_dir, exclude=("tmp_*",)).listing()
    return _scalar(spark, [(d, t) for d, ts in found.items() for t in ts], "database string, collection string")


def empty_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT * FROM shop.tmp_old")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, exclude=("tmp_*",)).registry.describe().where("db = 'mailbox'").select("table", "column", "type", "tag", "mixed")


def stored_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema written to the catalog file and read by another store, metadata included."""
    with tempfile.TemporaryDirectory() as folder:
        e = engine(spark, sf_dir)
        schema = e.registry.record("mailbox", "profile").schema
        CatalogStore(f"{folder}/catalog.json").put("mailbox.profile", schema, reg.Stats(1))
        got = CatalogStore(f"{folder}/catalog.json").get_fresh("mailbox.profile", 60).schema
    return _scalar(spark, [(f.name, f.dataType.simpleString(), tag_of(f), f == g) for f, g in zip(schema, got, strict=True)], "name string, type string, tag string, same boolean")


def ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = reg.schema_to_ddl("nation", spark.read.parquet(f"{sf_dir}/nation.parquet").schema)
    return _scalar(spark, [(line.strip(),) for line in text.split("\n")], "line string")


def session_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for s in ("SET x = 1", "RESET ALL", "DISCARD ALL", "BEGIN", "commit;", "ROLLBACK", "SAVEPOINT a", "RELEASE a", "  ;  ", "SHOW server_version", "SHOW transaction isolation level", "SHOW nothing_known", "SELECT 1", "INSERT INTO t VALUES (1)"):
        try:
            got = compat.intercept(s)
            rows.append((s, "run" if got is None else got.text if isinstance(got, compat.Tag) else got.sql))
        except compat.ReadOnlyError as e:
            rows.append((s, e.sqlstate))
    return _scalar(spark, rows, "statement string, answer string")


def system_sql(sql: str):
    """A statement over the system catalog."""
    return lambda spark, sf_dir: engine(spark, sf_dir, exclude=("tmp_*",)).sql(sql)


def object_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", compat.oid_column(F.col("n_name")).alias("oid"))
    return names.select("n_name", (F.col("oid") >= 0).alias("positive"), F.col("oid").cast("long").alias("oid"))


def split_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrel.plans.sqltext import split_statements

    script = "SELECT ';' AS a; SELECT \"x;y\" FROM t -- not; here\n;; /* ; */ SELECT 'it''s; fine'"
    return _scalar(spark, list(enumerate(split_statements(script))), "n int, statement string")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested columns as canonical JSON, with nulls kept."""
    d = decoded(spark, sf_dir, ["orderNo", "customer", "tags"])
    return render.for_clients(d).select(F.col("orderNo").alias("order_no"), "customer", "tags")


def client_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scalar(spark, render.described(decoded(spark, sf_dir)), "name string, type string")


def read_only_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = engine(spark, sf_dir).query("SELECT p.primaryName['TH'] AS sender_name, COUNT(*) AS msg_count FROM mailbox.sender s JOIN mailbox.profile p ON s.senderId = p._id WHERE p.\"type\" = 'group' GROUP BY 1 ORDER BY 2 DESC, 1", limit=5)
    return _scalar(spark, [(*r, got["truncated"]) for r in got["rows"]], "sender_name string, msg_count string, truncated boolean")


def top_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT p.primaryName['TH'] AS sender_name, COUNT(*) AS msg_count FROM mailbox.sender s JOIN mailbox.profile p ON s.senderId = p._id WHERE p.primaryName['TH'] IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = engine(spark, sf_dir).health()
    return _scalar(spark, [(k, str(v)) for k, v in h.items()], "name string, value string")


def table_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).table("mailbox", "profile", refresh=True)
    rows = [(c["name"], c["type"], c["nullable"], ",".join(f["name"] for f in c.get("fields", []))) for c in t["columns"]]
    return _scalar(spark, rows, "name string, type string, nullable boolean, fields string")


def explained_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = engine(spark, sf_dir).explain_scan("shop", "orders", list(PREDICATES.values())[:3], columns=["_id"], limit=4, verbose=True)
    return _scalar(spark, list(enumerate(text.split("\n")[:2])), "n int, line string")


def explained_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN as a statement, and what of its plan a client would look for."""
    text = engine(spark, sf_dir).sql("EXPLAIN SELECT status, count(*) FROM shop.orders WHERE status = 'F' GROUP BY status").first()[0]
    return _scalar(spark, [(word, word in text) for word in ("Physical Plan", "Filter", "HashAggregate", "= F")], "word string, shown boolean")


def unknown_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inference counts: how often each field occurs, as the share of documents that have it."""
    schema = infer(collection(scoped(spark), sf_dir))
    return _scalar(spark, [(f.name, round(float(f.metadata["freq"]), 4)) for f in schema], "name string, freq double")


def found_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection added after the first statements, one that shadows, and what the store then knows."""
    e = engine(spark, sf_dir)
    e.sql("SELECT _id FROM mailbox.profile")
    e.registry.add("mailbox", "late", lambda: e.spark.createDataFrame([('{"_id": 1, "a": null}',), ('{"_id": 2}',)], "doc string"))
    n = e.sql("SELECT count(*) AS n FROM mailbox.late WHERE a IS NULL").first()["n"]
    known = ",".join(e.registry.store.known("mailbox"))
    e.registry.add_table("mailbox", "plain", e.spark.range(3).toDF("k"))
    shadowed = ",".join(e.registry.listing("mailbox"))
    return _scalar(spark, [(n, known, shadowed, e.sql("SELECT max(k) AS k FROM mailbox.plain").first()["k"])], "n long, known string, shadowed string, k long")


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that would write, however they begin, by both ways in: all refused, and nothing written."""
    e = engine(spark, sf_dir)
    path = f"{shared_folder(e.spark)}/refused"
    texts = {
        "with": f"WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT * FROM a",
        "from": f"FROM (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT x",
        "explain": "EXPLAIN INSERT INTO t SELECT 1",
        "copy": f"COPY (SELECT 1) TO '{path}'",
        "table": "CREATE TABLE t AS SELECT 1 AS x",
        "view": "CREATE VIEW v AS SELECT 1 AS x",
        "call": "SELECT reflect('java.lang.System', 'nanoTime')",
        "immediate": "EXECUTE IMMEDIATE 'DROP TABLE t'",
    }
    rows = []
    for name, text in texts.items():
        for way in (e.sql, e.query):
            try:
                way(text)
                state = "none"
            except Exception as error:
                state = sqlstate(error)
            rows.append((name, way.__name__, state))
    jvm_path = e.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(e.spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)
    return _scalar(spark, [(*r, there) for r in rows], "name string, way string, state string, written boolean")


QUERIES = {
    "i1_inferred_schema": inferred,
    "s8_sampled_schema": inferred_from_sample,
    "d3_decoded": decoded_columns,
    "p_filters": predicates,
    "s2_pushdown": pushed,
    "s4_id_ranges": id_ranges,
    "l3_scan_plan": planned_scan,
    "s11_statistics": statistics,
    "s13_listing": listing,
    "s10_empty_collection": empty_collection,
    "k6_describe": described,
    "c5_catalog_store": stored_catalog,
    "k9_ddl": ddl,
    "r1_session_statements": session_statements,
    "r11_object_ids": object_ids,
    "r12_namespaces": system_sql("SELECT nspname, nspowner FROM pg_namespace"),
    "r13_classes": system_sql("SELECT c.relname, n.nspname, c.relkind FROM pg_class c JOIN pg_catalog.pg_namespace n ON c.relnamespace = n.oid WHERE n.nspname IN ('shop', 'mailbox')"),
    "r14_attributes": system_sql("SELECT c.relname, a.attname, a.attnum, a.attnotnull FROM pg_attribute a JOIN pg_class c ON a.attrelid = c.oid WHERE c.relname = 'profile'"),
    "r15_types": system_sql("SELECT t.oid, typname, typarray FROM pg_type t JOIN pg_namespace ns ON typnamespace = ns.oid"),
    "r16_indexes": system_sql("SELECT COUNT(*) AS n FROM pg_index"),
    "r16_roles": system_sql("SELECT rolname, rolsuper FROM pg_roles"),
    "r8_version": system_sql("SELECT substring(pg_catalog.version(), 1, 15) AS v, current_schema() AS s"),
    "r5_show": system_sql("SHOW server_version"),
    "r17_split": split_script,
    "s18_information_schema": system_sql("SELECT table_schema, table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE'"),
    "x2_json": rendered,
    "k3_client_types": client_types,
    "h5_query_api": read_only_query,
    "d11_top_senders": top_senders,
    "s8_numeric_ids": numeric_ids,
    "p3_edges": edges,
    "i3_frequencies": unknown_columns,
    "s19_found_anew": found_anew,
    "h5_read_only": refused,
    "q6_explain": explained_statement,
    "h2_health": health,
    "h4_table": table_tree,
    "x1_explain_scan": explained_scan,
}

_DOCS = f"""WITH o AS (SELECT *, o_orderkey AS k, (SELECT min(o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT {NEWEST})) AS least FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
d AS (SELECT k AS order_no, lpad(lower(to_hex(k)), 24, '0') AS _id, o_orderstatus AS status, k % 50 + CASE WHEN k % 10 = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS qty,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN '{{"text":"n' || k || '"}}' ELSE 'n' || k END AS note,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 4 = 0 THEN 't' || k % 3 ELSE 't' || k % 3 || ',u' END AS tags,
  CASE WHEN k % 13 <> 0 THEN c_name END AS name, CASE WHEN k % 13 <> 0 AND k % 3 <> 0 THEN c_mktsegment END AS city, CASE WHEN k >= least THEN 'mobile' END AS channel,
  CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) AS total, strftime(o_orderdate, '%Y-%m-%d') AS created, CASE WHEN k % 6 = 0 THEN NULL ELSE k % 2 = 0 END AS flag, '{{"e":' || k || '}}' AS deep_d FROM o)"""

_WHERE = {
    "p1": ("status = 'F'", '{"status": {"$eq": "F"}}', True),
    "p2": ("channel <> 'mobile'", '{"$and": [{"channel": {"$ne": "mobile"}}, {"channel": {"$ne": null}}]}', True),
    "p3": ("order_no >= 100", '{"orderNo": {"$gte": 100}}', True),
    "p4": ("100 < order_no", '{"orderNo": {"$gt": 100}}', True),
    "p5": ("status = 'F' AND order_no < qty", '{"status": {"$eq": "F"}}', False),
    "p6": ("status = 'P' OR qty < 3", '{"$or": [{"status": {"$eq": "P"}}, {"qty": {"$lt": 3.0}}]}', False),
    "p7": ("NOT (channel = 'mobile' AND status = 'F')", '{"$or": [{"$and": [{"channel": {"$ne": "mobile"}}, {"channel": {"$ne": null}}]}, {"$and": [{"status": {"$ne": "F"}}, {"status": {"$ne": null}}]}]}', True),
    "p7b": ("NOT (channel = 'mobile')", '{"$and": [{"channel": {"$ne": "mobile"}}, {"channel": {"$ne": null}}]}', True),
    "p8": ("channel IS NULL", '{"channel": null}', True),
    "p9": ("channel IS NOT NULL", '{"channel": {"$ne": null}}', True),
    "p10": ("flag IS TRUE", '{"flag": true}', True),
    "p11": ("flag IS NOT TRUE", '{"$or": [{"flag": false}, {"flag": null}]}', True),
    "p12": ("flag", '{"flag": true}', True),
    "p13": ("order_no BETWEEN 10 AND 90", '{"orderNo": {"$gte": 10, "$lte": 90}}', True),
    "p14": ("qty NOT BETWEEN 5 AND 45", '{"$and": [{"$or": [{"qty": {"$lt": 5.0}}, {"$or": [{"qty": {"$gt": 45.0}}, {"qty": {"$eq": NaN}}]}]}, {"qty": {"$ne": null}}]}', False),
    "p15": ("status IN ('F', 'P')", '{"status": {"$in": ["F", "P"]}}', True),
    "p16": ("channel NOT IN ('mobile')", '{"$and": [{"channel": {"$nin": ["mobile"]}}, {"channel": {"$ne": null}}]}', True),
    "p17": ("name LIKE 'Customer#%1'", '{"customer.name": {"$options": "s", "$regex": "^Customer\\\\#.*1$"}}', True),
    "p18": ("status ILIKE 'f'", '{"status": {"$options": "is", "$regex": "^f$"}}', True),
    "p19": ("status NOT LIKE 'F'", '{"$and": [{"status": {"$not": {"$options": "s", "$regex": "^F$"}}}, {"status": {"$ne": null}}]}', True),
    "p21": ("status IN ('F', 'O')", "none", False),
    "p24": ("city = 'BUILDING'", '{"customer.city": {"$eq": "BUILDING"}}', True),
}
#: What filters that aren't exact let through, where that isn't the same.
_LOOSER = {"p5": "status = 'F'"}
_EDGE_SQL = {"nan": "x > 3", "not_less": "NOT (x < 3)", "wide": "y = 9007199254740992", "at_most": "y <= 9007199254740992", "between": "x BETWEEN 2 AND 5", "outside": "x NOT BETWEEN 2 AND 5", "in": "y IN (9007199254740992)", "late": "t IS NULL", "cut": "d = 1", "not_true": "b IS NOT TRUE", "text": "s = '5'"}
_EDGE_ROWS = """WITH e AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'NaN'::DOUBLE ELSE o_orderkey % 7 + 0.5::DOUBLE END AS x, (9007199254740991 + o_orderkey % 4)::BIGINT::DOUBLE AS y, CASE WHEN o_orderkey % 4 <> 0 THEN 1 END AS t,
  CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS d, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS b, CASE WHEN o_orderkey % 3 = 1 THEN '5' ELSE '5x' END AS s FROM orders)"""
_PUSHED = {"status": "status = 'F'", "range": "order_no BETWEEN 10 AND 500 AND qty > 3", "not_in": "channel NOT IN ('web')", "null": "channel IS NULL", "like": "name LIKE 'Customer%'", "or": "status = 'P' OR flag", "nested": "city = 'BUILDING'"}


def _rows(names: str, *rows: tuple) -> str:
    quote = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS t({names})"


_SENT = "SELECT c_name AS sender_name, COUNT(*) AS msg_count FROM orders JOIN customer ON o_custkey = c_custkey"

ORACLES = {
    "i1_inferred_schema": _rows(
        "path, type, tag, mixed, nullable",
        ("_id", "string", "objectId", False, False), ("channel", "string", "string", False, True), ("createdAt", "timestamp", "date", False, True), ("customer", "struct", "document", False, True),
        ("customer.city", "string", "string", False, True), ("customer.name", "string", "string", False, True), ("deep", "struct", "document", False, True), ("deep.a", "struct", "document", False, True),
        ("deep.a.b", "struct", "document", False, True), ("deep.a.b.c", "struct", "document", False, True), ("deep.a.b.c.d", "string", "json", False, True), ("flag", "boolean", "bool", False, True), ("note", "string", "json", True, True),
        ("orderNo", "int", "int32", False, True), ("qty", "double", "double", False, True), ("status", "string", "string", False, True), ("tags", "array<string>", "array:string", False, True), ("total", "decimal(38,10)", "decimal", False, True),
    ),
    "s8_sampled_schema": _rows("name, tag", ("_id", "objectId"), ("channel", "string"), ("createdAt", "date"), ("customer", "document"), ("deep", "document"), ("flag", "bool"), ("note", "json"), ("orderNo", "int32"), ("qty", "double"), ("status", "string"), ("tags", "array:string"), ("total", "decimal")),
    "d3_decoded": _DOCS + " SELECT * FROM d",
    "p_filters": _DOCS + " " + " UNION ALL ".join(f"SELECT '{k}' AS predicate, (SELECT COUNT(*) FROM d WHERE {w}) AS n, {'NULL' if f == 'none' else '(SELECT COUNT(*) FROM d WHERE ' + _LOOSER.get(k, w) + ')'} AS passed, '{f}' AS filter, {str(x).upper()} AS exact" for k, (w, f, x) in _WHERE.items()),
    "s2_pushdown": _DOCS + " " + " UNION ALL ".join(f"SELECT '{k}' AS predicate, (SELECT COUNT(*) FROM d WHERE {w}) AS n, TRUE AS at_the_scan" for k, w in _PUSHED.items()),
    "p3_edges": _EDGE_ROWS + " " + " UNION ALL ".join(f"SELECT '{k}' AS predicate, '{way}' AS way, (SELECT COUNT(*) FROM e WHERE {w}) AS n" for k, w in _EDGE_SQL.items() for way in ("engine", "source", "source_off")),
    "s8_numeric_ids": f"SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey DESC LIMIT {NEWEST}",
    "i3_frequencies": _DOCS + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, round((SELECT count(*) FILTER (WHERE {w}) / count(*) FROM o), 4) AS freq" for n, w in {"_id": "TRUE", "channel": "k >= least", "createdAt": "TRUE", "customer": "k % 13 <> 0", "deep": "TRUE", "flag": "TRUE", "note": "k % 5 <> 0", "orderNo": "TRUE", "qty": "TRUE", "status": "TRUE", "tags": "TRUE", "total": "TRUE"}.items()) + ")",
    "s19_found_anew": "SELECT CAST(2 AS BIGINT) AS n, 'late,profile' AS known, 'plain' AS shadowed, CAST(2 AS BIGINT) AS k",
    "h5_read_only": " UNION ALL ".join(f"SELECT '{n}' AS name, '{w}' AS way, '25006' AS state, FALSE AS written" for n in ("with", "from", "explain", "copy", "table", "view", "call", "immediate") for w in ("sql", "query")),
    "q6_explain": _rows("word, shown", *((w, True) for w in ("Physical Plan", "Filter", "HashAggregate", "= F"))),
    "x1_explain_scan": _rows("n, line", (0, "DocumentScan stages=[$match $limit $project] rechecked=3"), (1, '{"$and": [{"$or": [{"status": {"$eq": "F"}}, {"status": {"$not": {"$type": ["null", "string"]}}}]}, {"$or": [{"$and": [{"channel": {"$ne": "mobile"}}, {"channel": {"$ne": null}}]}, {"channel": {"$not": {"$type": ["null", "string"]}}}]}, {"$or": [{"orderNo": {"$gte": 100}}, {"orderNo": {"$not": {"$type": ["null", "int32", "int64", "double", "decimal"]}}}]}]}')),
    "s4_id_ranges": "SELECT COUNT(*) AS rows_n, 1 AS least, 1 AS most FROM orders",
    "l3_scan_plan": _DOCS + " SELECT _id, status, '$match $sort $skip $limit $project' AS stages FROM d WHERE status = 'F' ORDER BY _id DESC LIMIT 5 OFFSET 3",
    "s11_statistics": "SELECT COUNT(*) AS docs, TRUE AS has_bytes, TRUE AS has_mean, '_id' AS indexed FROM orders",
    "s13_listing": _rows("database, collection", ("mailbox", "profile"), ("mailbox", "sender"), ("shop", "orders")),
    "s10_empty_collection": "SELECT CAST(NULL AS STRING) AS _id WHERE FALSE",
    "k6_describe": _rows('"table", "column", type, tag, mixed', ("profile", "_id", "int", "int32", False), ("profile", "primaryName", "struct<TH:string>", "document", False), ("profile", "type", "string", "string", False), ("sender", "_id", "int", "int32", False), ("sender", "senderId", "int", "int32", False), ("sender", "size", "double", "double", False)),
    "c5_catalog_store": _rows("name, type, tag, same", ("_id", "int", "int32", True), ("primaryName", "struct<TH:string>", "document", True), ("type", "string", "string", True)),
    "k9_ddl": _rows("line", ('CREATE TABLE IF NOT EXISTS "nation" (',), ('"n_nationkey" INTEGER,',), ('"n_name" TEXT,',), ('"n_regionkey" INTEGER',), (");",)),
    "r1_session_statements": _rows("statement, answer", ("SET x = 1", "SET"), ("RESET ALL", "RESET"), ("DISCARD ALL", "DISCARD ALL"), ("BEGIN", "BEGIN"), ("commit;", "COMMIT"), ("ROLLBACK", "ROLLBACK"), ("SAVEPOINT a", "SAVEPOINT"), ("RELEASE a", "RELEASE"), ("  ;  ", "EMPTY"), ("SHOW server_version", "SELECT '16.6' AS `server_version`"), ("SHOW transaction isolation level", "SELECT 'read committed' AS `transaction_isolation`"), ("SHOW nothing_known", "SELECT '' AS `value`"), ("SELECT 1", "run"), ("INSERT INTO t VALUES (1)", "25006")),
    "r11_object_ids": "SELECT n_name, TRUE AS positive, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(n_name) + 1), lambda i: ascii(n_name[i])::BIGINT)), lambda h, b: ((xor(h, b)::HUGEINT * 16777619) % 4294967296)::BIGINT) & 2147483647 AS oid FROM nation",
    "r12_namespaces": _rows("nspname, nspowner", ("mailbox", 10), ("shop", 10), ("information_schema", 10), ("pg_catalog", 10)),
    "r13_classes": _rows("relname, nspname, relkind", ("orders", "shop", "r"), ("profile", "mailbox", "r"), ("sender", "mailbox", "r")),
    "r14_attributes": _rows("relname, attname, attnum, attnotnull", ("profile", "_id", 1, True), ("profile", "primaryName", 2, False), ("profile", "type", 3, False)),
    "r15_types": _rows("oid, typname, typarray", *((o, n, 0) for o, n, _, _ in compat.PG_TYPES)),
    "r16_indexes": "SELECT CAST(0 AS BIGINT) AS n",
    "r16_roles": _rows("rolname, rolsuper", (compat.CATALOG, True)),
    "r8_version": _rows("v, s", ("PostgreSQL 16.6", "public")),
    "r5_show": "SELECT '16.6' AS server_version",
    "r17_split": _rows("n, statement", (0, "SELECT ';' AS a"), (1, "SELECT \"x;y\" FROM t -- not; here"), (2, "/* ; */ SELECT 'it''s; fine'")),
    "s18_information_schema": _rows("table_schema, table_name", ("mailbox", "profile"), ("mailbox", "sender"), ("shop", "orders")),
    "x2_json": _DOCS + """ SELECT order_no, CASE WHEN name IS NOT NULL THEN '{"city":' || coalesce('"' || city || '"', 'null') || ',"name":"' || name || '"}' END AS customer, CASE WHEN tags IS NOT NULL THEN '["' || replace(tags, ',', '","') || '"]' END AS tags FROM d""",
    "k3_client_types": _rows("name, type", ("_id", "text"), ("channel", "text"), ("createdAt", "timestamptz"), ("customer", "text"), ("deep", "text"), ("flag", "bool"), ("note", "text"), ("orderNo", "int4"), ("qty", "float8"), ("status", "text"), ("tags", "text"), ("total", "numeric")),
    "h5_query_api": f"SELECT sender_name, CAST(msg_count AS STRING) AS msg_count, TRUE AS truncated FROM ({_SENT} WHERE c_custkey % 4 = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)",
    "d11_top_senders": f"{_SENT} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "h4_table": _rows("name, type, nullable, fields", ("_id", "int", False, ""), ("primaryName", "struct<TH:string>", True, "TH"), ("type", "string", True, "")),
}
