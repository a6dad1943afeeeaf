"""Schema inference: every collection has a schema, whatever its documents hold.

Executors reduce documents to counts by (path, type); the driver joins the types of each path in the lattice once. The
sets of types don't depend on the order of documents, so neither does the schema. What reaches the driver is the
schema's size, not the collection's.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrel.values import SCALARS, Value, parse

#: Metadata keys of columns: original type, path, share of documents that have it, and whether types conflicted.
TAG, PATH, FREQ, MIXED = "tag", "path", "freq", "mixed"
DECIMAL = T.DecimalType(38, 10)
TYPES = {
    "bool": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(), "double": T.DoubleType(), "decimal": DECIMAL, "string": T.StringType(),
    "objectId": T.StringType(), "date": T.TimestampType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "json": T.StringType(), "unknown": T.StringType(),
}
_RANK = {"int32": 1, "int64": 2, "double": 3, "decimal": 4}


def join_scalars(tags: Iterable[str]) -> tuple[str, bool]:
    """(type, mixed) of scalar types seen at one place; commutative and associative."""
    now, mixed = "unknown", False
    for tag in sorted(set(tags)):
        if now in ("unknown", tag):
            now = tag
        elif now in _RANK and tag in _RANK:
            now = max(now, tag, key=_RANK.get)
        elif {now, tag} == {"date", "timestamp"}:
            now = "date"
        elif {now, tag} == {"objectId", "string"}:
            now, mixed = "string", True
        else:
            return "json", True
    return now, mixed


@dataclass
class Node:
    """What was seen at a path: how often each type, and below it the keys of documents and the elements of arrays."""

    tags: Counter = field(default_factory=Counter)
    keys: dict[str, Node] = field(default_factory=dict)
    items: Node | None = None

    def merged(self, other: Node) -> Node:
        keys = {k: self.keys[k].merged(other.keys[k]) if k in self.keys and k in other.keys else (self.keys.get(k) or other.keys[k]) for k in {**self.keys, **other.keys}}
        items = self.items.merged(other.items) if self.items and other.items else self.items or other.items
        return Node(self.tags + other.tags, keys, items)

    @property
    def present(self) -> int:
        return sum(self.tags.values())


def resolve(node: Node, path: str, depth: int, max_depth: int) -> tuple[T.DataType, str, bool]:
    """(type, tag, mixed) of a path.

    A type that can't be modelled, or a document beside anything else, is JSON text. An array takes in what was seen
    beside it: its elements' types and the lone values' are joined. Too deep is JSON text too.
    """
    seen = set(node.tags) - {"null"}
    if "json" in seen:
        return T.StringType(), "json", len(seen) > 1
    if "array" in seen:
        lone = Node(Counter({t: n for t, n in node.tags.items() if t != "array"}), node.keys)
        if depth >= max_depth:
            return T.StringType(), "json", False
        kind, tag, mixed = resolve(lone.merged(node.items or Node()), path, depth + 1, max_depth)
        return T.ArrayType(kind, True), "array:" + tag, mixed
    if "document" in seen:
        if len(seen) > 1:
            return T.StringType(), "json", True
        if depth >= max_depth or not node.keys:
            return T.StringType(), "json", False
        most = max(c.present for c in node.keys.values())
        return T.StructType([build_field(k, f"{path}.{k}", node.keys[k], most, depth + 1, max_depth) for k in sorted(node.keys, key=str.encode)]), "document", False
    tag, mixed = join_scalars(seen & set(SCALARS))
    return TYPES[tag], tag, mixed


def build_field(name: str, path: str, node: Node, parents: int, depth: int, max_depth: int) -> T.StructField:
    """Only the root ``_id`` is not nullable: no sample can show that a field is never absent."""
    kind, tag, mixed = resolve(node, path, depth, max_depth)
    meta = {TAG: tag, PATH: path, FREQ: f"{node.present / parents if parents else 0.0:.6f}"}
    return T.StructField(name, kind, path != "_id", meta | ({MIXED: "true"} if mixed else {}))


def build_schema(root: dict[str, Node], docs: int, max_depth: int = 4) -> T.StructType:
    """``_id`` first, then by the bytes of the name."""
    return T.StructType([build_field(k, k, root[k], docs, 0, max_depth) for k in sorted(root, key=lambda k: (k != "_id", k.encode()))])


def observe(doc: dict[str, Value], counts: Counter) -> None:
    """Count the types at every path of a document. A step is a key, or 0 for the elements of an array."""
    stack: list[tuple[tuple, Value]] = [((k,), v) for k, v in doc.items()]
    while stack:
        path, (tag, value) = stack.pop()
        counts[path, tag] += 1
        if tag == "document":
            stack += [((*path, k), v) for k, v in value.items()]
        elif tag == "array":
            stack += [((*path, 0), v) for v in value]


def tree(counts: Iterable[tuple[tuple, str, int]]) -> dict[str, Node]:
    """The counts as nodes by root key."""
    root = Node()
    for path, tag, n in counts:
        node = root
        for step in path:
            if step == 0:
                node.items = node.items or Node()
                node = node.items
            else:
                node = node.keys.setdefault(step, Node())
        node.tags[tag] += n
    return root.keys


def _batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([json.dumps(p) for p, _ in counts], pa.string()), pa.array([t for _, t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["path", "type", "n"])


def shape(doc: Column) -> Column:
    """A text that documents share only if they have the same types at the same paths: what only a value's content tells is cut.

    Strings lose their text and numbers their digits, by class; keys stay, and so does what a wrapper's type may hang on.
    """
    text, number, colon = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"-?[0-9]++", r"\s*+:\s*+"
    day = r"(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
    time = rf"(?!0000)[0-9]{{4}}-{day}T(?:[01][0-9]|2[0-3])(?::[0-5][0-9]){{2}}(?:[.][0-9]{{1,3}})?Z"
    # What other wrappers hold tells their type in ways of its own: such a document is its own shape.
    whole, plain = doc, ~doc.rlike(r'"\$(?!oid"|numberDecimal"|numberInt"|numberLong"|numberDouble"|date"\s*:\s*")')
    # Wrappers lose a well-formed value; then strings lose their text, but for keys and what is left behind a wrapper's key; then numbers.
    doc = F.regexp_replace(doc, rf'("\$oid"{colon})"[0-9a-fA-F]{{24}}"|("\$numberDecimal"{colon})"[^"\\]*+"|("\$date"{colon})"{time}"|({text})', "$1$2$3$4")
    doc = F.regexp_replace(doc, rf'("\$[A-Za-z]++"{colon}{text}|{text}\s*+:)|{text}', '$1""')
    doc = F.regexp_replace(doc, rf"({text}|{number}[.eE][^,\]\}}\s]*+|-?[0-9]{{10,}}+)|{number}", "$1i")
    return F.when(plain, F.regexp_replace(doc, rf"({text}|-?[0-9]{{10,}}+(?![.eE]))|{number}[.eE][^,\]\}}\s]*+", "$1d")).otherwise(whole)


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own: Counter = Counter({((), "document"): 1})
            observe(parse(text), own)
            for k, c in own.items():
                counts[k] += c * n
        if len(counts) > 100_000:
            yield _batch(counts)
            counts = Counter()
    yield _batch(counts)


def observed(docs: DataFrame, column: str = "doc") -> DataFrame:
    """(path, type, n): how often each type occurs at each path (a JSON list of steps); the empty path counts documents.

    Documents of one shape are counted first, by expressions; Python sees one of each.
    """
    shapes = docs.groupBy(shape(F.col(column)).alias("shape")).agg(F.min(column).alias("doc"), F.count("*").alias("n")).select("doc", "n")
    return shapes.mapInArrow(_observed, "path string, type string, n long").groupBy("path", "type").agg(F.sum("n").alias("n"))


def infer(docs: DataFrame, column: str = "doc", max_depth: int = 4) -> T.StructType:
    """The schema of extended-JSON documents; without any document, a lone ``_id``."""
    rows = [(tuple(json.loads(r["path"])), r["type"], r["n"]) for r in observed(docs, column).collect()]
    total = sum(n for p, _, n in rows if not p)
    root = tree(r for r in rows if r[0])
    return build_schema(root, total, max_depth) if root else placeholder()


def infer_local(texts: Iterable[str], max_depth: int = 4) -> T.StructType:
    """The same on the driver, for few documents."""
    counts: Counter = Counter()
    n = 0
    for n, text in enumerate(texts, 1):  # noqa: B007
        observe(parse(text), counts)
    root = tree((p, t, k) for (p, t), k in counts.items())
    return build_schema(root, n, max_depth) if root else placeholder()


def placeholder() -> T.StructType:
    """The schema of an empty collection: one column, so that selecting from it gives no rows and no error."""
    return T.StructType([T.StructField("_id", T.StringType(), False, {TAG: "objectId", PATH: "_id", FREQ: "1.000000"})])


def is_mixed(f: T.StructField) -> bool:
    return (f.metadata or {}).get(MIXED) == "true"


def path_of(f: T.StructField) -> str:
    return (f.metadata or {}).get(PATH, f.name)


def tag_of(f: T.StructField) -> str:
    return (f.metadata or {}).get(TAG, "unknown")


def id_key(doc: Column) -> Column:
    """What documents are ordered by: the id's place among types, its number, and its text. Numbers order as numbers however they are written."""
    v = F.try_variant_get(F.try_parse_json(doc), F.lit("$._id"), "variant")
    shape = F.schema_of_variant(v)
    inner = lambda key, kind: F.try_variant_get(v, F.lit(f'$["{key}"]'), kind)
    number = F.when(shape.isin("BIGINT", "DOUBLE") | shape.startswith("DECIMAL"), F.try_variant_get(v, F.lit("$"), "decimal(38,9)"))
    number = F.coalesce(number, *(inner(k, "decimal(38,9)") for k in ("$numberInt", "$numberLong", "$numberDecimal", "$numberDouble")))
    text = F.coalesce(inner("$oid", "string"), inner("$date", "string"), F.to_json(v))
    rank = F.when(v.isNull() | (shape == "VOID"), 0).when(number.isNotNull(), 1).when(shape == "STRING", 2).when(shape.startswith("OBJECT<`$oid`"), 4).when(shape.startswith("OBJECT<`$date`"), 5).otherwise(3)
    return F.when(v.isNotNull(), F.struct(rank.alias("rank"), number.alias("number"), text.alias("text")))


def sample(docs: DataFrame, size: int = 1000, recent: float = 0.25, id_column: str = "_id", watch: Observation | None = None) -> DataFrame:
    """The documents that inference looks at: the newest by id, and others by the order of a hash of the id.

    ``recent`` (held between 0 and 1) is the newest documents' share. The order makes the sample repeatable. Both parts keep
    the best rows of each partition while they scan; nothing is sorted whole. ``watch`` gets the number of documents ``n``
    and their bytes ``size`` from the pass that is made anyway.
    """
    size = max(1, size)
    newest = int(size * min(1.0, max(0.0, recent)))
    seen = docs if watch is None else docs.observe(watch, F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("doc")), F.lit(0)).alias("size"))
    if newest >= size:
        return seen.orderBy(F.desc_nulls_last(id_column)).limit(newest)
    others = seen.orderBy(F.xxhash64(id_column), id_column).limit(size - newest)
    return docs.orderBy(F.desc_nulls_last(id_column)).limit(newest).unionByName(others) if newest else others
