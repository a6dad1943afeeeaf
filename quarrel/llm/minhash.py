"""Near-duplicate groups: MinHash signatures, banding, signature verification, exact confirmation, connected components.

Documents with equal shingle sets form one class with its smallest id as representative (an aggregate, so any number of
copies is combined before the shuffle); only representatives enter the buckets. A bucket's members are paired with the
bucket's smallest member, never with each other. Where the confirmed links leave a bucket in several components, members
outside the main one are joined with the rest by a prefix filter, which is exact and finds what shares rare shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrel.llm.common import BROADCAST_BYTES, Words, doc_batches, grams, mix, read_table, stored
from quarrel.llm.components import components

MINIMA = 130
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than ``size`` are one shingle, no words none."""
    words = Words(text, lower=True)
    n = min(size, len(words))
    return np.unique(grams(words.hashes(), n, n)) if n else np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every hash a*x + b mod 2^64 over the set, in blocks of bounded size."""
    least = np.full(len(_A), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (_A[:, None] * shingles[None, at : at + 4096] + _B[:, None]).min(axis=1), out=least)
    return least


def rows_of(percent: int) -> int:
    """Minima to a band: five from 85 % (26 bands miss a link in 5 million), four below (32 bands; at 80 % one in 20 million)."""
    return 5 if percent >= 85 else 4


def _signatures(size: int, rows_in_band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_batches(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, size)
                if not len(s):
                    rows.append((doc_id, 0, None, None, None))
                    continue
                sig = signature(s)
                bands = grams_of_bands(sig, rows_in_band)
                rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bands.tolist(), (mix(sig) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (batch.schema.field(0).type, pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n", "key", "bands", "sig"])

    return run


def grams_of_bands(sig: np.ndarray, rows_in_band: int) -> np.ndarray:
    bands = len(sig) // rows_in_band
    out = np.zeros(bands, np.uint64)
    for column in sig[: bands * rows_in_band].reshape(bands, rows_in_band).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _sets(size: int):
    def run(batches):
        for batch in doc_batches(batches):
            sets = [shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "words"])

    return run


def _alike(least: int):
    """Rows (a, b, sa, sb) whose signatures agree in at least ``least`` minima."""

    def run(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, len(_A)) for c in (2, 3))
            keep = (left == right).sum(axis=1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _linked(percent: int):
    """Rows (a, b, wa, wb) with 100 * intersection >= percent * union of the full sets."""

    def run(batches):
        for batch in doc_batches(batches, 16_000_000):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", size: int = 3, percent: int = 85) -> DataFrame:
    """Per input row ``doc_id, n_shingles, component_id, kept``: the group's smallest id, and whether this row has it.

    Null text and text without words have an empty set and are linked with nothing. Rows that repeat with one id are one
    document. Rows with a null id join a group but never name it. An empty table gives no rows. Other columns are not read.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    sigs = stored(d.mapInArrow(_signatures(size, rows_of(percent)), f"doc_id {kind}, n long, key binary, bands array<long>, sig binary"), "signatures")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "bands", "sig"))).alias("r")
    classes = stored(sigs.where("key IS NOT NULL").groupBy("key").agg(first).select("key", "r.*"), "classes")
    reps = classes.where("doc_id IS NOT NULL")

    placed = reps.select("doc_id", F.posexplode("bands").alias("band", "h"))
    # Stored before it is joined, so that adaptive execution can split a bucket that a large part of all rows is in.
    buckets = stored(placed.groupBy("band", "h").agg(F.min("doc_id").alias("centre"), F.count("*").alias("members")).where("members > 1"), "buckets")
    members = stored(placed.join(buckets, ["band", "h"]), "members")
    pairs = members.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    near = _alike_pairs(pairs, reps, percent)
    ids = near.select(F.col("a").alias("doc_id")).unionAll(near.select(F.col("b").alias("doc_id")))
    groups = components(_confirmed(near, _sets_of(ids, d, size), percent)).toDF("rep", "component")

    more = _across(members, groups, d, size, percent)
    if more is not None:  # links between groups: their components are those of the whole
        joined = components(more).toDF("component", "least")
        groups = groups.join(joined, "component", "left").select("rep", F.coalesce("least", "component").alias("component")).unionAll(joined.join(groups, joined.component == groups.rep, "left_anti").select("component", "least"))
        groups = stored(groups, "groups")
    rep_of = classes.join(groups, classes.doc_id == groups.rep, "left").select("key", F.coalesce("component", "doc_id").alias("component"))
    out = sigs.select("doc_id", "n", "key").join(rep_of, "key", "left")
    found = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def _alike_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that set sizes, and signatures with a margin of six standard errors, leave as possible links."""
    p = percent / 100
    least = int(len(_A) * p - 6 * (len(_A) * p * (1 - p)) ** 0.5)
    kind = reps.schema["doc_id"].dataType.simpleString()
    sigs = reps.select("doc_id", "n", "sig")
    near = pairs.join(sigs.toDF("a", "na", "sa"), "a").join(sigs.toDF("b", "nb", "sb"), "b")
    near = near.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "sa", "sb")
    return stored(near.mapInArrow(_alike(least), f"a {kind}, b {kind}"), "near")


def _sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, words): the full shingle set of every document that ``ids`` (doc_id) names, one row each."""
    ids = stored(ids.distinct(), "ids")
    few = ids.count() * 32 <= BROADCAST_BYTES
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return stored(own.mapInArrow(_sets(size), f"id {kind}, words binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""
    kind = pairs.schema["a"].dataType.simpleString()
    full = pairs.join(sets.toDF("a", "wa"), "a").join(sets.toDF("b", "wb"), "b").select("a", "b", "wa", "wb")
    return stored(full.mapInArrow(_linked(percent), f"a {kind}, b {kind}"), "links")


#: Lower ends of classes of set sizes, each about 4 % wide.
_CLASSES = np.unique(np.ceil(1.04 ** np.arange(700)).clip(max=1e11).astype(np.int64))


def _prefixes(percent: int):
    """Entries (token, small, large, role, id, component, out) of the prefix filter, by class of the smaller and of the larger set.

    Sets of sizes n and m with the Jaccard similarity p share at least p / (1 + p) * (n + m) tokens, so in any one order
    of tokens the first n + 1 minus that many of the one have a token of those of the other. Rare tokens come first: what
    a copy has changed itself stands before what the whole group shares, and a copy that has changed too much to be linked
    to the group's centre has nothing but its own changes there.
    """

    def run(batches):
        for batch in doc_batches(batches, 400_000):
            parts, owners = [], []
            for row, tokens in enumerate(batch.column("tokens")):
                tokens = np.asarray(tokens.values, np.int64)
                n = len(tokens)
                own, lo, hi = (int(np.searchsorted(_CLASSES, x, "right")) - 1 for x in (n, -(-n * percent // 100), n * 100 // percent))
                for other in range(lo, hi + 1):
                    shared = -(-percent * (n + int(_CLASSES[other])) // (100 + percent))
                    prefix = tokens[: max(0, n - shared + 1)]
                    for role in (0, 1) if other == own else (0,) if other > own else (1,):
                        parts.append((prefix, *(np.full(len(prefix), x, np.int32) for x in (min(own, other), max(own, other), role))))
                        owners.append(np.full(len(prefix), row))
            flat = [np.concatenate([np.empty(0, t), *x]) for t, x in zip((np.int64, np.int32, np.int32, np.int32), zip(*parts, strict=True), strict=True)] if parts else [np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int32)]
            at = pa.array(np.concatenate([np.empty(0, np.int64), *owners]))
            yield pa.RecordBatch.from_arrays([*map(pa.array, flat), *(batch.column(c).take(at) for c in ("id", "component", "out"))], ["token", "small", "large", "role", "id", "component", "out"])

    return run


def _tokens(batches):
    for batch in doc_batches(batches, 1_000_000):
        sets = [np.frombuffer(w, np.int64) for w in batch.column("words").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(at), pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], ["id", "token"])


def _across(members: DataFrame, groups: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links (a, b) between the components that the links to the buckets' smallest members have left in one bucket; None if there are no such buckets.

    The exact way for what stars miss: a prefix-filtered join of the members outside their bucket's main component with
    all members of such buckets.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    at = members.join(groups.withColumnRenamed("rep", "doc_id"), "doc_id", "left").select("band", "h", "doc_id", F.coalesce("component", "doc_id").alias("component"), "centre")
    split = at.groupBy("band", "h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.when(F.col("doc_id") == F.col("centre"), F.col("component"))).alias("main")).where("lo <> hi")
    at = at.join(split.select("band", "h", "main"), ["band", "h"]).groupBy(F.col("doc_id").alias("id")).agg(F.min("component").alias("component"), F.max(F.expr("component <> main")).alias("out"))
    at = stored(at, "split")
    if at.isEmpty():
        return None
    sets = _sets_of(at.select(F.col("id").alias("doc_id")), docs, size)
    tokens = stored(sets.mapInArrow(_tokens, f"id {kind}, token long"), "tokens")
    ordered = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("n")), "token").groupBy("id").agg(F.expr("transform(array_sort(collect_list(struct(n, token))), x -> x.token)").alias("tokens"))
    entries = stored(ordered.join(at, "id").mapInArrow(_prefixes(percent), f"token long, small int, large int, role int, id {kind}, component {kind}, out boolean"), "entries")
    key = ["token", "small", "large"]
    small, large = (entries.where(f"role = {r}").select(*key, F.col("id").alias(f"id{r}"), F.col("component").alias(f"c{r}"), F.col("out").alias(f"out{r}")) for r in (0, 1))
    one = small.where("out0").join(large, key).where("c0 <> c1").select("id0", "id1")
    two = large.where("out1").join(small.where("NOT out0"), key).where("c0 <> c1").select("id0", "id1")
    pairs = one.unionAll(two).select(F.least("id0", "id1").alias("a"), F.greatest("id0", "id1").alias("b")).distinct()
    links = _confirmed(pairs, sets, percent)
    at = at.select("id", "component")
    return links.join(at.toDF("a", "x"), "a").join(at.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
