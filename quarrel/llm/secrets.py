"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived: text that the rule matches must satisfy it.
The index holds, for every trigram that some query names, its postings in blocks of bounded length; a query is answered
by intersecting and uniting postings block by block, and only the documents it leaves are searched with the rule itself.
A rule without mandatory trigrams (a run of hex digits) is searched for in every document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrel.llm.common import BROADCAST_BYTES, doc_batches, read_table, stored

#: Documents in one posting list.
BLOCK = 4096
#: Strings that a sub-expression may stand for before it counts as unknown.
EXACT = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches, leftmost and not overlapping; a match counts if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False

    def compiled(self) -> re.Pattern:
        # A-Z and a-z only: without re.ASCII some letters outside ASCII fold to s and k.
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


#: The base kinds come first, in this order. ``hex`` is the run of 16 or more that ``[0-9a-f]+`` would give.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@"),
)
RULES = BASE + MORE

# A trigram query is True (anything), or a frozenset of clauses of which one must hold; a clause is a frozenset of trigrams that must all occur.
Query = bool | frozenset


def both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    return _least(frozenset(x | y for x in a for y in b)) if len(a) * len(b) <= EXACT else min(a, b, key=len)


def either(a: Query, b: Query) -> Query:
    return True if a is True or b is True or len(a) + len(b) > EXACT else _least(a | b)


def _least(q: frozenset) -> Query:
    """Without clauses that another one implies; an empty clause holds always."""
    out = frozenset(x for x in q if not any(y < x for y in q))
    return True if frozenset() in out else out


def _of(strings: frozenset) -> Query:
    """One of the strings occurs."""
    clauses = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
    return _least(clauses) if clauses else True


@dataclass
class _Info:
    """What a sub-expression tells: the strings it stands for if they are few, else the strings that must begin and end it, and a query."""

    exact: frozenset | None
    prefix: frozenset
    suffix: frozenset
    query: Query

    def ends(self) -> tuple[frozenset, frozenset]:
        return (self.exact, self.exact) if self.exact is not None else (self.prefix, self.suffix)

    def whole(self) -> Query:
        return _of(self.exact) if self.exact is not None else both(self.query, both(_of(self.prefix), _of(self.suffix)))


_ANY = frozenset([""])


def _unknown() -> _Info:
    return _Info(None, _ANY, _ANY, True)


def _cross(a: frozenset, b: frozenset) -> frozenset | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= EXACT else None


def _join(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and (exact := _cross(a.exact, b.exact)) is not None:
        return _Info(exact, exact, exact, True)
    (ap, asuf), (bp, bsuf) = a.ends(), b.ends()
    seam = _cross(asuf, bp)
    query = both(a.whole(), b.whole())
    if seam is not None:
        query = both(query, _of(seam))
    prefix = _cross(a.exact, bp) if a.exact is not None else ap
    suffix = _cross(asuf, b.exact) if b.exact is not None else bsuf
    return _Info(None, ap if prefix is None else prefix, bsuf if suffix is None else suffix, query)


def _class(items) -> frozenset | None:
    out: set[str] = set()
    for op, arg in items:
        if op is rc.LITERAL:
            out.add(chr(arg))
        elif op is rc.RANGE and arg[1] - arg[0] < EXACT:
            out.update(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return None
    return frozenset(x.lower() for x in out) if all(ord(x) < 128 for x in out) else None


def _info(tree) -> _Info:
    now = _Info(_ANY, _ANY, _ANY, True)
    for op, arg in tree:
        now = _join(now, _part(op, arg))
    return now


def _part(op, arg) -> _Info:
    if op is rc.LITERAL and arg < 128:
        s = frozenset([chr(arg).lower()])
        return _Info(s, s, s, True)
    if op is rc.IN and (s := _class(arg)) and len(s) <= 8:
        return _Info(s, s, s, True)
    if op is rc.SUBPATTERN:
        return _info(arg[3])
    if op is rc.BRANCH:
        parts = [_info(x) for x in arg[1]]
        if all(p.exact is not None for p in parts) and len(exact := frozenset().union(*(p.exact for p in parts))) <= EXACT:
            return _Info(exact, exact, exact, True)
        query: Query = parts[0].whole()
        for p in parts[1:]:
            query = either(query, p.whole())
        prefix, suffix = (frozenset().union(*(p.ends()[k] for p in parts)) for k in (0, 1))
        return _Info(None, prefix, suffix, query)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, tree = arg
        inner = _info(tree)
        if (low, high) == (0, 1) and inner.exact is not None and len(inner.exact) < EXACT:
            exact = inner.exact | _ANY
            return _Info(exact, exact, exact, True)
        if not low:
            return _unknown()
        first, last = inner.ends()
        return inner if high == 1 else _Info(None, first, last, inner.whole())
    if op is rc.AT:
        return _Info(_ANY, _ANY, _ANY, True)
    return _unknown()


def trigram_query(pattern: str) -> Query:
    """Trigrams of ASCII-lower-cased text that every text with a match has; True if none can be derived."""
    return _info(rp.parse(pattern, re.ASCII)).whole()


def _postings(trigrams: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grams = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = (text or "").lower()  # ASCII letters fold as they should; what else folds to them only adds candidates
                for g in trigrams:
                    if g in folded:
                        ids.append(doc_id)
                        grams.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(ids, batch.schema.field(0).type)], ["trigram", "doc_id"])

    return run


def build_index(docs: DataFrame, trigrams: list[str], block: int = BLOCK) -> DataFrame:
    """The inverted index (trigram, block, ids) of ``docs`` (doc_id, text); ids of one block are a bounded sorted list, so a trigram of a third of all rows is spread over its blocks.

    Whole numbers are in blocks of neighbours, other ids in as many blocks by their hash.
    """
    kind = docs.schema["doc_id"].dataType
    found = docs.where("doc_id IS NOT NULL").mapInArrow(_postings(trigrams), f"trigram string, doc_id {kind.simpleString()}")
    if isinstance(kind, T.IntegralType):
        place = F.expr(f"doc_id div {block}")
    else:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // block)))
    return found.groupBy("trigram", place.alias("block")).agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, rules): for each document the rules whose query it satisfies. Postings of one block meet in one row and are intersected there."""
    names = sorted({g for q in queries.values() for clause in q for g in clause})
    wide = index.groupBy("block").agg(*(F.first(F.when(F.col("trigram") == g, F.col("ids")), ignorenulls=True).alias(f"g{k}") for k, g in enumerate(names)))
    empty = f"cast(array() as {index.schema['ids'].dataType.simpleString()})"
    parts = []
    for kind, query in queries.items():
        union = empty
        for clause in query:
            hit = None
            for g in sorted(clause):
                col = f"coalesce(g{names.index(g)}, {empty})"
                hit = col if hit is None else f"array_intersect({hit}, {col})"
            union = f"array_union({union}, {hit})"
        parts.append(wide.select(F.lit(kind).alias("rule"), F.explode(F.expr(union)).alias("doc_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _scan(rules: tuple[Rule, ...], always: frozenset, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(r, r.compiled()) for r in rules]
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in doc_batches(batches):
            out = []
            for text, named in zip(batch.column("text").to_pylist(), batch.column("rules").to_pylist(), strict=True):
                named, spans = set(named or ()), []
                for k, (rule, pattern) in enumerate(own):
                    if rule.kind in always or rule.kind in named:
                        spans += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if m.end(rule.group) - m.start(rule.group) >= rule.least]
                out.append([{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kinds), *(batch.column(c) for c in ("text", *carry))], ["doc_id", "spans", "text", *carry])

    return run


def find_secrets(docs: DataFrame, id_col="doc_id", text_col="text", rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per input row ``doc_id, spans, text`` and the columns ``carry``: spans (kind, start, end) in code points, end exclusive, by start and then rule order.

    Ids may be of any type. Null text has no spans. Rows with a null id are searched with every rule, as the index can't name them; rows that share
    an id are candidates together and searched each. Empty tables give no rows; other columns are not read.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carry)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    always = frozenset(k for k, q in queries.items() if q is True)
    queries = {k: q for k, q in queries.items() if q is not True}
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint>>, text string"
    schema += "".join(f", {c} {d.schema[c].dataType.simpleString()}" for c in carry)
    named = F.lit(None).cast("array<string>")
    if queries:
        index = build_index(d.select("doc_id", "text"), sorted({g for q in queries.values() for clause in q for g in clause}))
        found = stored(candidates(index, queries).withColumnRenamed("doc_id", "id_"), "candidates")
        small = found.count() * (64 + 16 * len(queries)) <= BROADCAST_BYTES
        d = d.join(F.broadcast(found) if small else found, d.doc_id == found.id_, "left")
        named = F.when(F.col("doc_id").isNull(), F.array(*map(F.lit, queries))).otherwise(F.col("rules"))
    return d.select("doc_id", "text", *carry, named.alias("rules")).mapInArrow(_scan(rules, always, carry), schema)


def _digests(base: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                line = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in base)
                count = [sum(s["kind"] == k for s in spans) for k in base]
                rows.append((*count, hashlib.sha256(line.encode()).hexdigest(), ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents")).select("doc_id", "spans")
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_digests(tuple(r.kind for r in BASE)), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _oracle(rules: tuple[Rule, ...]) -> str:
    """The query in SQL: matches and what stands between them, added up to places in the text."""

    def either_case(m: re.Match) -> str:
        return "(" + re.sub("[a-z]", lambda c: f"[{c.group()}{c.group().upper()}]", m.group(1)) + ")"

    parts = []
    for k, r in enumerate(rules):
        pattern = re.sub(r"\(\(\?i:(.*?)\)\)", either_case, r.pattern).replace(r"\s", r"\t\n\v\f\r ").replace("'", "''")
        parts.append(f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {r.group}) AS gs, string_split_regex(t, '{pattern}') AS ps, {r.least} AS least FROM d")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT doc_id, k, kind, coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a, length(ms[i]) AS n
      FROM i WHERE length(gs[i]) >= least),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, k) FILTER (WHERE kind IN ({base})) AS base,
      string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE = _oracle(RULES)


def redacted(text: str | None, spans: list[dict]) -> str | None:
    """``text`` with every span replaced by ``[kind]``; overlapping spans become one, named after the first."""
    if not spans:
        return text
    out, at, shown = [], 0, -1
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= shown:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        shown = at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [redacted(t, spans) for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        sizes = [len(t) if spans else n for t, spans, n in zip(texts, batch.column("spans").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("lang"), batch.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "text", "lang", "source", "n_chars"])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents (doc_id, text, lang, source, n_chars), one row for each input row, with secrets cut out of their texts; see :func:`find_secrets`."""
    d = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return find_secrets(d, rules=rules, carry=("lang", "source", "n_chars")).mapInArrow(_redact, f"doc_id {kind}, text string, lang string, source string, n_chars long")
