"""A data source of extended-JSON documents: ``spark.read.format("documents")``.

Options: ``path`` (a file or folder of lines), ``pushdown`` (true or false, false if not given), ``complete`` (the schema holds for every
document, so that filters may be exact), ``columns`` (comma-separated; others stay null), ``split`` (bytes of a part).
The schema is given by the reader; filters that translate are applied to raw documents before decoding, and Spark checks
again those that aren't exact. Spark keeps the filters that reached a source with the loaded frame, not with its use in a
plan, so a frame with pushdown on serves one use: :func:`load` hands out a new one for every call. The engine doesn't scan
through this source; its decoding is expressions, which filters pass through (:func:`quarrel.operators.decode.decode`).
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator
from datetime import date, datetime
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from quarrel.operators import predicate as p
from quarrel.operators.decode import batch_of, relaxed_nulls
from quarrel.operators.scan import ScanPlan
from quarrel.values import parse

BATCH = 8192
SPLIT = 64 << 20


class DocumentSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> T.StructType:
        raise ValueError("documents are read with a schema; infer one first")

    def reader(self, schema: T.StructType) -> DocumentReader:
        if not self.options.get("path"):
            raise ValueError("documents need a path")
        return DocumentReader(schema, dict(self.options))


def register_source(spark: SparkSession) -> None:
    """Make ``format("documents")`` known to a session; a second call changes nothing."""
    # Whether a name is taken is looked up in the active session, whichever is asked.
    spark.sparkContext._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
    try:
        spark.dataSource.register(DocumentSource)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def load(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """A frame of the documents at ``path`` for one use, with pushdown on unless the options say otherwise."""
    register_source(spark)
    return spark.read.format("documents").schema(schema).options(path=path, **({"pushdown": "true"} | options)).load()


class _Part(ds.InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def as_expr(f: ds.Filter) -> p.Expr | None:
    """A pushed filter as a predicate; None for kinds that are left to Spark."""
    if isinstance(f, ds.Not):
        inner = as_expr(f.child)
        return p.negate(inner) if inner else None
    names = getattr(f, "attribute", None)
    if names is None:
        return None
    col, value = p.Col(tuple(names)), getattr(f, "value", None)
    ops = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
    if type(f) in ops:
        return p.Cmp(ops[type(f)], col, p.Lit(value))
    if isinstance(f, ds.In):
        return p.In(col, tuple(p.Lit(v) for v in f.value))
    if isinstance(f, ds.IsNull):
        return p.Is(col, None)
    if isinstance(f, ds.IsNotNull):
        return p.Is(col, None, True)
    likes = {ds.StringStartsWith: "{}%", ds.StringEndsWith: "%{}", ds.StringContains: "%{}%"}
    if type(f) in likes:
        plain = str(value).replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        return p.Like(col, likes[type(f)].format(plain), escape="\\")
    return None


class DocumentReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.full, self.options = relaxed_nulls(schema), options
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.push, self.complete = flag("pushdown", "false"), flag("complete", "false")
        self.filter: dict | None = None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        """Keeps what translates; gives back all that isn't exact. Switched off, everything is given back."""
        found = []
        for f in filters:
            e = as_expr(f) if self.push else None
            t = p.translate(e, self.full, self.complete) if e is not None else None
            if t:
                found.append(t)
            if t is None or not t.exact:
                yield f
        self.filter = p.combine(found)

    def partitions(self) -> list[_Part]:
        files, path = _open(self.options["path"])
        info = files.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(path, recursive=True))
        split = int(self.options.get("split", SPLIT))
        parts = []
        for f in sorted((f for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path):
            parts += [_Part(f.path, at, min(at + split, f.size)) for at in range(0, f.size, split)]
        return parts or [_Part("", 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        wanted = self.options.get("columns")
        names = None if wanted is None else {c for c in wanted.split(",") if c}
        docs: list = []
        for line in self._lines(partition):
            doc = parse(line)
            if p.matches(self.filter, doc):
                docs.append({k: v for k, v in doc.items() if names is None or k in names})
                if len(docs) == BATCH:
                    yield batch_of(self.full, docs)
                    docs = []
        if docs:
            yield batch_of(self.full, docs)

    def _lines(self, part: _Part) -> Iterator[str]:
        """The lines that begin in a part; the one across its start belongs to the part before."""
        if not part.path:
            return
        files, _ = _open(self.options["path"])
        with files.open_input_file(part.path) as f:
            at = part.start
            if at:
                f.seek(at - 1)
            rest = b""
            skip = at > 0
            at -= skip
            while at < part.end or rest or skip:
                block = f.read(1 << 20)
                lines = (rest + block).split(b"\n")
                at_line = at
                rest = lines.pop() if block else b""
                for line in lines:
                    end = at_line + len(line) + 1
                    if skip:
                        skip = False
                    elif at_line < part.end and line.strip():
                        yield line.decode("utf-8", "replace")
                    at_line = end
                at = at_line
                if not block:
                    return
                if at >= part.end:
                    return


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def plain(value: Any) -> Any:
    """A literal for JSON: times as text, bytes in base64."""
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return base64.b64encode(value).decode() if isinstance(value, bytes) else value


def explained(schema: T.StructType, predicates: list[p.Expr], plan: ScanPlan, rows: DataFrame | None = None) -> str:
    """What a scan does: its stages, how many predicates are checked again; with ``rows``, its filter and the plan Spark runs."""
    found = [p.translate(e, schema, False) for e in predicates]
    again = sum(t is None or not t.exact for t in found)
    lines = [f"DocumentScan stages=[{' '.join(next(iter(s)) for s in plan.stages())}] rechecked={again}"]
    if rows is not None:
        lines.append(json.dumps(p.shown(plan.filter or {}), default=plain))
        lines += rows._jdf.queryExecution().explainString(rows._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).strip().split("\n")
    return "\n".join(lines)
