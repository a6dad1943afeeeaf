"""Substring dedup: maximal repeats from prefix-partitioned suffix trees, and what they cover.

A window is ``DEPTH`` words of one document, a path of that depth in the generalised suffix tree of the corpus; a deep
internal node is a path of that depth or more with two leaves. Not every suffix is needed: each window is filed under its
*anchor*, the position in it whose ``PREFIX``-word prefix hashes lowest, so equal windows have equal anchors, and only the
suffixes around anchors (about one word in nine) are partitioned.

Suffixes are split by prefixes of variable length, as long as a group needs to fit in memory:

1. by the first ``PREFIX`` words of the anchor; a group of one is a leaf and is done;
2. by all the words that the windows around the anchor cover (up to ``2 * DEPTH - PREFIX``). A group whose members agree on them is one
   unbranched path: all windows of all members but the first repeat, and one row stands for them;
3. a prefix group that branches into at most ``GROUP`` such paths goes to one task, which sorts its suffixes (a suffix
   array by doubling), finds the nodes of depth ``DEPTH`` or more from the lengths that neighbours share, and gives out
   the spans that their repeats cover; several groups are sorted together, up to ``BATCH`` words;
4. a group of more paths is split by the whole first ``DEPTH`` words of each of its suffixes: each part is one node.

Each split is an aggregate (the least place by path), combined before the shuffle, and a join back that adaptive execution
can split, so a passage that a third of all rows share is no task's burden. Words and paths are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrel.llm.common import BROADCAST_BYTES, Powers, Words, doc_batches, grams, mix, read_table, stored

DEPTH, PREFIX = 20, 5
#: Paths of a prefix group that are put in one tree, and words of the trees that are built at once: what a task holds in memory.
GROUP, BATCH = 4096, 400_000
#: Anchor and span of starts in one number: position * 256 + (position - first start) * 16 + (position - last start).
_LO, _HI = 16, 256
_LEN, _OFF = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _path_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Hash of the words [start, end) of each path, with a number that goes with it."""
    up, down = Powers.upto(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _LEN + mark.astype(np.uint64) * _OFF)


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first start, last start, prefix hash) of every anchor of a document's word hashes."""
    g = grams(h, PREFIX)
    width = DEPTH - PREFIX + 1
    view = sliding_window_view(g, width)
    at = np.arange(len(view)) + (width - 1 - view[:, ::-1].argmin(axis=1))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return at[first], first, last, g[at[first]]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in doc_batches(batches):
        parts, rows, sizes = [], [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            h = Words(text).hashes()
            if len(h) < DEPTH:
                continue
            at, first, last, prefix = anchors(h)
            path = _path_hashes(h, first, last + DEPTH, at - first)
            parts.append((prefix, path, (at * _HI + (at - first) * _LO + (at - last)).astype(np.int64)))
            rows.append(row)
            sizes.append(len(at))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)]
        owner = pa.array(np.repeat(np.array(rows, np.int64), sizes))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(cols[2])], ["prefix", "path", "doc_id", "t", "span"])


def _spans(h: np.ndarray, spans: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of spans that lie in a document of word hashes ``h``."""
    spans = np.unique(np.array(spans, np.int64))
    at = spans // _HI
    first, last = at - spans % _HI // _LO, at - spans % _LO
    fits = (first >= 0) & (last + DEPTH <= len(h))
    return at[fits], first[fits], last[fits]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the spans asked for, each with its prefix hash, path hash and start."""
    for batch in doc_batches(batches):
        parts, rows, sizes = [], [], []
        for row, (text, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            h = Words(text).hashes()
            at, first, last = _spans(h, spans)
            count = last - first + 1
            owner = np.repeat(np.arange(len(at)), count)
            start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
            if len(start):
                prefix = grams(h, PREFIX)[at[owner]]
                parts.append((prefix, _path_hashes(h, start, start + DEPTH, at[owner] - start), start.astype(np.int64)))
                rows.append(row)
                sizes.append(len(start))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)]
        owner = pa.array(np.repeat(np.array(rows, np.int64), sizes))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(cols[2])], ["prefix", "path", "doc_id", "t", "start"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes around each anchor asked for, from its first window's start to its last window's end."""
    for batch in doc_batches(batches):
        rows, prefix, starts, words = [], [], [], []
        for row, (text, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            h = Words(text).hashes()
            at, first, last = _spans(h, spans)
            if len(at):
                prefix.append(grams(h, PREFIX)[at])
                rows += [row] * len(at)
                starts += first.tolist()
                words += [h[x:y].tobytes() for x, y in zip(first, last + DEPTH, strict=True)]
        owner = pa.array(rows, pa.int64())
        flat = np.concatenate([np.empty(0, np.uint64), *prefix])
        yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(starts, pa.int32()), pa.array(words, pa.binary())], ["prefix", "doc_id", "t", "start", "words"])


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples."""
    now = np.unique(keys[0], return_inverse=True)[1]
    for k in keys[1:]:
        k = np.unique(k, return_inverse=True)[1]
        now = np.unique(now * (int(k.max(initial=0)) + 1) + k, return_inverse=True)[1]
    return now


def deep_nodes(group: np.ndarray, strings: list[np.ndarray], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of grouped strings in suffix-array order: (string, offset, node, words shared with the one before it).

    Only suffixes of at least ``depth`` words are given; those with the same first ``depth`` words of one group are leaves
    below one node. The order comes from ranks of 1, 2, 4 ... words, each from two of the half; the words shared from the
    same ranks, taken from the longest down. The end of a string is unlike any word and any other end.
    """
    sizes = np.array([len(x) for x in strings], np.int64)
    total = int(sizes.sum())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[owner] - offset  # words from here to the end
    ranks = [_ranks(group[owner], np.concatenate([np.empty(0, np.uint64), *strings]))]
    width, longest = 1, int(sizes.max(initial=0))
    while width * 2 <= longest:
        before = ranks[-1]
        after = np.full(total, -1)
        after[: total - width] = before[width:]
        short = left < 2 * width
        now = _ranks(before * (total + 1) + np.where(short, -1, after) + 1)
        now[short] = int(now.max(initial=0)) + 1 + np.arange(int(short.sum()))  # too short to be like any other
        ranks.append(now)
        width *= 2

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words, in steps of ranks, two places share."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            w = 1 << level
            x, y = a + out, b + out
            ok = (out + w <= left[a]) & (out + w <= left[b])
            x, y = np.minimum(x, total - 1), np.minimum(y, total - 1)
            out += w * (ok & (ranks[level][x] == ranks[level][y]))
        return out

    at = np.flatnonzero(left >= depth)
    whole = 1 << (depth.bit_length() - 1)
    level = whole.bit_length() - 1
    head = ranks[level][at] if at.size else np.empty(0, np.int64)
    tail = ranks[level][at + depth - whole] if at.size else head
    at = at[np.lexsort((offset[at], owner[at], tail, head))]
    shared = np.zeros(len(at), np.int64)
    if len(at) > 1:
        shared[1:] = same(at[1:], at[:-1])
    node = np.cumsum(shared < depth) - 1 if len(at) else at
    return owner[at], offset[at], node, shared


def repeats_of(group: np.ndarray, strings: list[np.ndarray], place: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the repeats of grouped strings cover, as (string, offset, words): the leaves of each deep node but the first by (place, start).

    Leaves at places that follow each other are given as one span, as long as the repeats that they are part of.
    """
    owner, offset, node, _ = deep_nodes(group, strings)
    if not len(owner):
        return owner, offset, offset
    order = np.lexsort((start[owner] + offset, place[owner], node))
    owner, offset, node = owner[order], offset[order], node[order]
    least = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))[node]
    # Of rows that repeat, each has the first place.
    later = (place[owner] != place[owner[least]]) | (start[owner] + offset != start[owner[least]] + offset[least])
    back = np.lexsort((offset, owner))
    owner, offset, later = owner[back], offset[back], later[back]
    owner, offset = owner[later], offset[later]
    if not len(owner):
        return owner, offset, offset
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:] - 1, [len(owner) - 1]])
    return owner[begin], offset[begin], offset[end] - offset[begin] + DEPTH


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (prefix, doc_id, t, start, words), by prefix: the spans of words that repeat, but for each repeat's first occurrence."""
    held: list[pa.RecordBatch] = []
    words = 0

    def built(table: pa.Table) -> pa.RecordBatch:
        ids = table.column("doc_id").combine_chunks()
        distinct = ids.unique()
        ranked = distinct.take(pa.compute.sort_indices(distinct, null_placement="at_start"))
        place = pa.compute.index_in(ids, ranked, skip_nulls=False).to_numpy(zero_copy_only=False).astype(np.int64)
        place = _ranks(place, table.column("t").to_numpy())
        start = table.column("start").to_numpy().astype(np.int64)
        strings = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        owner, offset, size = repeats_of(table.column("prefix").to_numpy(), strings, place, start)
        begin = (start[owner] + offset).astype(np.int32)
        at = pa.array(owner)
        return pa.RecordBatch.from_arrays([ids.take(at), table.column("t").combine_chunks().take(at), pa.array(begin), pa.array((begin + size).astype(np.int32))], ["doc_id", "t", "a", "b"])

    for batch in batches:
        held.append(batch)
        words += pa.compute.sum(pa.compute.binary_length(batch.column("words"))).as_py() or 0
        if words >= BATCH * 8:
            table = pa.Table.from_batches(held)
            prefix = table.column("prefix").to_numpy()
            cut = int(np.flatnonzero(prefix != prefix[-1])[-1]) + 1 if prefix[0] != prefix[-1] else 0
            if cut:  # the last group may go on
                yield built(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                words = sum(pa.compute.sum(pa.compute.binary_length(x.column("words"))).as_py() or 0 for x in held)
    if held:
        yield built(pa.Table.from_batches(held))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching spans of words joined, as pairs of 32-bit numbers."""
    for batch in batches:
        out = []
        for spans in batch.column(2).to_pylist():
            spans.sort(key=lambda s: (s["a"], s["b"]))
            runs: list[list[int]] = []
            for s in spans:
                if runs and s["a"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s["b"])
                else:
                    runs.append([s["a"], s["b"]])
            out.append(np.array(runs, "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id_", "t_", "cut"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in doc_batches(batches):
        rows = []
        for text, cut in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = Words(text)
            keep = np.ones(len(words), bool)
            for a, b in np.frombuffer(cut or b"", "<i4").reshape(-1, 2):
                keep[a:b] = False
            rows.append((len(words), int(len(words) - keep.sum()), words.bytes_of(keep if cut else None)))
        n, gone, left = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in left], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id_, t_, cut): per document of ``docs`` (doc_id, t, text) with repeated windows, the spans of words these cover."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    suffixes = stored(docs.mapInArrow(_suffixes, f"prefix long, path long, doc_id {kind}, t long, span long"), "suffixes")
    # Aggregates are stored before they are joined: a join between two plain exchanges is one that can be split where it is skewed.
    shared = stored(suffixes.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix"), "shared")
    groups = stored(suffixes.join(shared, "prefix"), "groups")

    firsts = stored(groups.groupBy("prefix", "path").agg(F.min(F.struct("doc_id", "t", "span")).alias("first")), "firsts")
    later = groups.join(firsts, ["prefix", "path"]).where("struct(doc_id, t, span) > first")
    covered = later.select("doc_id", "t", F.expr(f"cast(span div {_HI} - span % {_HI} div {_LO} as int) AS a"), F.expr(f"cast(span div {_HI} - span % {_LO} + {DEPTH} as int) AS b"))

    branching = stored(firsts.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), "branching")
    asked = stored(firsts.join(branching, "prefix").select(F.col("first.doc_id").alias("id_"), F.col("first.t").alias("t_"), F.col("first.span").alias("span"), (F.col("n") > GROUP).alias("large")), "asked")

    def texts_of(rows: DataFrame, name: str) -> DataFrame:
        ask = stored(rows.groupBy("id_", "t_").agg(F.collect_list("span").alias("spans")), name)
        return _by_document(docs, ask, "spans", 8, "inner")

    strings = stored(texts_of(asked.where("NOT large"), "ask").mapInArrow(_strings, f"prefix long, doc_id {kind}, t long, start int, words binary"), "strings")
    small = strings.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_trees, f"doc_id {kind}, t long, a int, b int")
    spans = covered.unionAll(small)
    if not asked.where("large").isEmpty():
        windows = stored(texts_of(asked.where("large"), "ask_large").mapInArrow(_opened, f"prefix long, path long, doc_id {kind}, t long, start long"), "windows")
        first = stored(windows.groupBy("prefix", "path").agg(F.min(F.struct("doc_id", "t", "start")).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
        more = windows.join(first, ["prefix", "path"]).where("struct(doc_id, t, start) > first").select("doc_id", "t", F.expr("cast(start as int) AS a"), F.expr(f"cast(start as int) + {DEPTH} AS b"))
        spans = spans.unionAll(more)
    spans = spans.groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return stored(spans.mapInArrow(_merged, f"id_ {kind}, t_ long, cut binary"), "cut")


def _by_document(docs: DataFrame, side: DataFrame, column: str, item: int, how: str) -> DataFrame:
    """``docs`` with a column of ``side`` (id_, t_, column); the side is broadcast only if its counted size is within the bound, else texts are shuffled."""
    size = side.agg(F.count("*").alias("n"), F.sum((F.size if item > 1 else F.octet_length)(column)).alias("items")).first()
    small = size["n"] * 128 + (size["items"] or 0) * item <= BROADCAST_BYTES
    return docs.join(F.broadcast(side) if small else side, docs.doc_id.eqNullSafe(side.id_) & (docs.t == side.t_), how).select("doc_id", "t", "text", column)


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per input row ``doc_id, n_words, n_removed, kept``: the words that no repeated window covers, joined by one space.

    A window repeats if its words also start earlier: in a smaller id, or in the same document before it. Null text has
    no words. An id and its text name a document: rows that share both are one document, and each gives a row; texts that
    share an id are documents in the order of a hash of their text. A null id comes before all others. An empty table gives
    no rows; other columns are not read.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return _by_document(d, repeated_spans(d), "cut", 1, "left").mapInArrow(_kept, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op2_repeats(spark, sf_dir: str) -> DataFrame:
    kept = without_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + {DEPTH - 1}], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - {DEPTH - 2})) AS s FROM d WHERE len(w) >= {DEPTH})),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {DEPTH})) AS p FROM rep),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
