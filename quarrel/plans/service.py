"""The query service: statements in, results or acknowledgements out; and the read-only query API with its limits."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrel.functions import aliases
from quarrel.operators import predicate
from quarrel.operators.decode import relaxed_nulls
from quarrel.operators.infer import is_mixed, path_of, tag_of
from quarrel.plans import compat, render, sqltext
from quarrel.operators.scan import ScanPlan
from quarrel.session import scoped
from quarrel.sources.documents import explained
from quarrel.sources.registry import Registry

DEFAULT_ROWS, MAX_ROWS, DEFAULT_SECONDS = 1000, 10_000, 30
#: First words of plan nodes that change something, run a script, or run a text that can't be looked into.
CHANGES = ("Insert", "Overwrite", "Append", "Delete", "Update", "Merge", "Replace", "Create", "Write", "Script", "UnresolvedExecuteImmediate", "CompoundBody")
#: Functions that call any method of the JVM.
CALLS = ("reflect", "java_method", "try_reflect")
READS = ("SELECT", "WITH", "EXPLAIN", "SHOW", "DESCRIBE", "DESC", "VALUES", "TABLE")


class QueryError(Exception):
    """An error with the SQLSTATE that clients expect."""

    def __init__(self, sqlstate: str, message: str):
        super().__init__(message)
        self.sqlstate = sqlstate


class QueryTimeout(QueryError):
    def __init__(self, seconds: float):
        super().__init__("57014", f"the statement took more than {seconds:g} s")


def sqlstate(error: BaseException) -> str:
    """The client's code of an error: unknown table, refused write, bad statement, or failure while running."""
    if getattr(error, "sqlstate", None):
        return error.sqlstate
    if isinstance(error, PySparkException):
        kind = (error.getCondition() or "") if hasattr(error, "getCondition") else ""
        if "TABLE_OR_VIEW_NOT_FOUND" in kind:
            return "42P01"
        if kind.startswith(("PARSE", "UNRESOLVED", "DATATYPE", "UNSUPPORTED")) or type(error).__name__ in ("ParseException", "AnalysisException"):
            return "42601"
    return "58000"


def refuse_writes(spark: SparkSession, sql: str) -> None:
    """Refuse a statement whose parsed plan is, or holds anywhere, a command or a write: what its first word is says little.

    Only plans that read pass: EXPLAIN is looked through, DESCRIBE and SHOW are the commands that read.
    """
    toks = sqltext.tokens(sql)
    for k, (kind, text) in enumerate(toks):
        if kind in ("word", "quoted") and text.strip('`"').lower() in CALLS and toks[sqltext._next(toks, k) : sqltext._next(toks, k) + 1] == [("mark", "(")]:
            raise compat.ReadOnlyError(f"{text} is refused: it can call anything")
    sessions = spark.sparkContext._jvm.org.apache.spark.sql.classic.SparkSession
    sessions.setActiveSession(spark._jsparkSession)  # the parser takes its settings from there
    found = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while found:
        node = found.pop()
        name = node.getClass().getSimpleName()
        if name == "ExplainCommand":
            found.append(node.logicalPlan())
            continue
        if name.startswith(CHANGES) or (_is_command(spark, node) and not name.startswith(("Describe", "Show"))):
            raise compat.ReadOnlyError(f"the statement is refused: it would run {name}, and tables are read-only here")
        for seq in (node.children(), node.innerChildren()):
            found += [x for x in (seq.apply(k) for k in range(seq.size())) if _is_plan(spark, x)]


def _class(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.java.lang.Class.forName(name, True, spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader())


def _is_command(spark: SparkSession, node) -> bool:
    kinds = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    return any(_class(spark, k).isInstance(node) for k in kinds)


def _is_plan(spark: SparkSession, node) -> bool:
    return _class(spark, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan").isInstance(node)


def columns_read(df: DataFrame) -> dict[str, set[str]]:
    """By table the columns that a statement's optimized plan reads, for tables made by :func:`stand_in`."""
    owners: dict[int, tuple[str, str]] = {}
    seen: set[int] = set()
    found: dict[str, set[str]] = {}
    plan = df._jdf.queryExecution().optimizedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        for seq in (node.children(), node.subqueries()):
            todo += [seq.apply(k) for k in range(seq.size())]
        leaf, used = not node.children().size(), node.references().toSeq()
        seen |= {used.apply(k).exprId().id() for k in range(used.size())}
        for a in (node.output().apply(k) for k in range(node.output().size())) if leaf else ():
            if a.metadata().contains(OWNER):
                owners[a.exprId().id()] = (a.metadata().getString(OWNER), a.name())
                found.setdefault(a.metadata().getString(OWNER), set())
    top = plan.output()
    seen |= {top.apply(k).exprId().id() for k in range(top.size())}
    for k, (table, name) in owners.items():
        if k in seen:
            found.setdefault(table, set()).add(name)
    return found


#: Key of column metadata that names the table a stand-in's column belongs to.
OWNER = "quarrel.table"


def stand_in(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """A relation of that schema with no rows that the optimizer doesn't know to be empty; its columns say whose they are."""
    fields = [T.StructField(f.name, f.dataType, True, {**(f.metadata or {}), OWNER: table}) for f in schema]
    return spark.createDataFrame(spark.sparkContext.emptyRDD(), T.StructType(fields))


class Engine:
    """SQL over the collections of a registry."""

    def __init__(self, spark: SparkSession, registry: Registry | None = None):
        self.spark = scoped(spark)
        self.registry = registry or Registry(self.spark)
        self.registry.spark = self.spark

    def _prepared(self, sql: str) -> tuple[str, dict[str, tuple[str, str]]]:
        """The statement in Spark's terms, and by view the (database, table) of what it names."""
        sql = aliases.rewrite(sql)
        toks = sqltext.tokens(sql)
        plain = lambda t: t[1].strip('"`')
        known = {d: set(self.registry.collections.get(d, {})) | set(self.registry.tables.get(d, {})) for d in {*self.registry.collections, *self.registry.tables}}
        out, views, k = [], {}, 0
        while k < len(toks):
            pair = toks[k : k + 3]
            if len(pair) == 3 and pair[1] == ("mark", ".") and pair[0][0] in ("word", "quoted") and pair[2][0] in ("word", "quoted") and not (k and toks[k - 1] == ("mark", ".")):
                database, name = plain(pair[0]), plain(pair[2])
                if name in known.get(database, ()):
                    views[f"{database}__{name}"] = (database, name)
                    out.append(f"`{database}__{name}`")
                    k += 3
                    continue
            if pair[0][0] == "word" and pair[0][1] in known.get(compat.DEFAULT_SCHEMA, ()) and not (k and toks[k - 1] == ("mark", ".")):
                views[pair[0][1]] = (compat.DEFAULT_SCHEMA, pair[0][1])
            out.append(pair[0][1])
            k += 1
        sql = "".join(out)
        refuse_writes(self.spark, sql)
        compat.register_views(self.spark, self.registry, sql)
        return sql, views

    def sql(self, sql: str, args: dict[str, Any] | list | None = None) -> DataFrame | compat.Tag:
        """One statement: a lazy result, or an acknowledgement.

        It is planned twice: over stand-ins of its tables, which tells the columns that it reads, then over scans that decode
        those. Its filters reach the scans by themselves, as decoding is expressions.
        """
        got = compat.intercept(sql)
        if isinstance(got, compat.Tag):
            return got
        text, views = self._prepared(got.sql if got else sql.strip().rstrip(";"))
        collections = {v: (d, t) for v, (d, t) in views.items() if d not in self.registry.tables}
        for view, (database, name) in views.items():
            if view in collections:
                stand_in(self.spark, view, self.registry.record(database, name).schema).createOrReplaceTempView(view)
            else:
                self.registry.resolve(database, name).createOrReplaceTempView(view)
        if not collections:
            return self.spark.sql(text, args=args)
        read = columns_read(self.spark.sql(text, args=args))
        for view, (database, name) in collections.items():
            self._view(database, name, read.get(view)).createOrReplaceTempView(view)
        return self.spark.sql(text, args=args)

    def _view(self, database: str, name: str, read: set[str] | None) -> DataFrame:
        """The collection with the columns that a plan reads; the others, which a statement may still name, are null."""
        rows = self.registry.resolve(database, name, read)
        schema = self.registry.record(database, name).schema
        own = set(rows.columns)
        return rows.select(*(F.col(f"`{f.name}`") if f.name in own else F.lit(None).cast(f.dataType).alias(f.name, metadata=f.metadata or {}) for f in schema))

    def scan(self, database: str, name: str, where: list[predicate.Expr] = (), **stages: Any) -> tuple[ScanPlan, DataFrame]:
        """A scan without SQL: its plan, with the filter that the predicates translate to, and its rows.

        Predicates that have no filter, or one that isn't exact, are checked again on the rows, before order and limit.
        """
        record = self.registry.record(database, name)
        found = [predicate.translate(e, record.schema, complete=False) for e in where]
        plan = ScanPlan(filter=predicate.combine(found), **stages)
        again = [predicate.column(e) for e, t in zip(where, found, strict=True) if t is None or not t.exact]
        return plan, plan.run(self.registry.docs(database, name), relaxed_nulls(record.schema), again)

    def explain_scan(self, database: str, name: str, where: list[predicate.Expr] = (), verbose: bool = False, **stages: Any) -> str:
        """The stages of a scan and, if ``verbose``, its filter and the plan that Spark runs."""
        record = self.registry.record(database, name)
        plan, rows = self.scan(database, name, where, **stages)
        return explained(record.schema, list(where), plan, rows if verbose else None)

    def run(self, script: str) -> list[DataFrame | compat.Tag]:
        """The statements of a script in order."""
        return [self.sql(s) for s in sqltext.split_statements(script)]

    def describe(self, sql: str) -> list[tuple[str, str]]:
        """Names and client types of a statement's result, without running it."""
        got = self.sql(sql)
        return [] if isinstance(got, compat.Tag) else render.described(got)

    def timed(self, df: DataFrame, seconds: float) -> list:
        """Collect under a deadline; the running job is cancelled when it passes."""
        sc, group = self.spark.sparkContext, f"q-{uuid.uuid4().hex}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(seconds, stop)
        sc.setJobGroup(group, "query", interruptOnCancel=True)
        timer.start()
        try:
            return df.collect()
        except Exception:
            if late.is_set():
                raise QueryTimeout(seconds) from None
            raise
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def query(self, sql: str, limit: int | None = None, seconds: float = DEFAULT_SECONDS, enabled: bool = True) -> dict:
        """The read-only API: one statement that reads, at most ``limit`` rows (1 to 10,000; 1,000 if not given), in text form."""
        if not enabled:
            raise QueryError("42501", "queries are switched off here")
        statements = sqltext.split_statements(sql)
        if len(statements) != 1:
            raise QueryError("42601", "give one statement" if statements else "the statement is empty")
        first = next(t for k, t in sqltext.tokens(statements[0]) if k != "space").upper()
        if first not in READS:
            raise QueryError("25006", f"only statements that read are taken, not {first}")
        cap = min(MAX_ROWS, max(1, DEFAULT_ROWS if limit is None else limit))
        began = time.monotonic()
        df = self.sql(statements[0])
        got = self.timed(df.limit(cap + 1) if first in ("SELECT", "WITH", "VALUES", "TABLE") else df, seconds)
        text = [["" if (c := render.cell(v)) is None else c for v in r] for r in got[:cap]]
        return {"columns": df.columns, "types": [f.dataType.simpleString() for f in df.schema], "rows": text, "row_count": len(text), "truncated": len(got) > cap, "elapsed_ms": int((time.monotonic() - began) * 1000)}

    def health(self) -> dict:
        s = self.registry.settings
        return {"status": "ok", "version": compat.VERSION_TEXT, "spark": self.spark.version, "catalog": compat.CATALOG, "databases": len(self.registry.databases()), "tables_known": len(self.registry.store.records), "sample_size": s.sample, "recent_bias": s.recent, "max_depth": s.depth, "max_age_s": s.max_age}

    def listing(self) -> dict[str, list[str]]:
        """Tables by database; nothing is inferred."""
        return {d: self.registry.listing(d) for d in self.registry.databases()}

    def table(self, database: str, name: str, refresh: bool = False) -> dict:
        """A collection's schema as a tree, and its statistics."""
        if name not in self.registry.listing(database):
            raise QueryError("42P01", f"there is no table {database}.{name}")
        r = self.registry.record(database, name, refresh)

        def node(f) -> dict:
            kind = f.dataType
            while hasattr(kind, "elementType"):
                kind = kind.elementType
            out = {"name": f.name, "type": f.dataType.simpleString(), "tag": tag_of(f), "path": path_of(f), "nullable": f.nullable, "mixed": is_mixed(f)}
            return out | ({"fields": [node(c) for c in kind]} if hasattr(kind, "fields") else {})

        return {"database": database, "table": name, "inferred_at": r.inferred_at, "stats": vars(r.stats), "columns": [node(f) for f in r.schema]}

    def refresh(self, database: str, name: str) -> None:
        """Infer a collection's schema again now."""
        self.registry.record(database, name, refresh=True)

    def explain(self, sql: str, mode: str = "formatted") -> str:
        got = self.sql(sql)
        return "" if isinstance(got, compat.Tag) else got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
