"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window (``window`` consecutive item words; a shorter item is one window) is a set of word shingles. To occur in a
document all of its shingles must occur there, so a window is looked up by its *necessary prefix*: under an order by
rarity in the whole corpus, a required overlap of all shingles leaves a prefix of one, the rarest. A window with a
shingle that no document has is dropped at once. The prefix join fixes where the window would have to start
(positional bound) and, with the document's length, where it would have to end (length bound); what is left is
compared shingle by shingle, as text, over the item-sized window.

One scan of the texts finds every occurrence of a benchmark shingle, and so the counts, the positions and the words to
verify with; no text is shuffled. Windows are looked up once each, whichever items have them, and items come in at the end,
by document. Benchmark-sized tables are broadcast behind a count of their rows and bytes; beyond the bound, a table of bits
of fixed size, which is, leaves only shingles that may be known to be shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrel.llm.common import BROADCAST_BYTES, join_small, read_table, stored

WINDOW = 10
SHINGLE = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """A-Z lower-cased, then words of digits, letters and everything outside ASCII; null has none."""
    text = F.coalesce(text, F.lit(""))
    # Outside ASCII, lower-casing would change more than A-Z.
    folded = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c.lower())), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", text)
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def _shingles(words: str, size: int) -> Column:
    parts = ", ".join(f"get({words}, i + {k})" for k in range(size))
    return F.expr(f"CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {size}), i -> concat_ws(' ', {parts})) ELSE array() END")


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, win): each distinct window of each item, as a list of words."""
    w = items.select(F.col(item_col).alias("item"), item_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    return w.select("item", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window}))")).alias("win")).distinct()


def window_shingles(wins: DataFrame, shingle: int) -> DataFrame:
    """(id, len, s, gs, at, g): the shingles ``gs`` of s words of each window (id, win), one row for each of them."""
    wins = wins.withColumn("len", F.size("win")).withColumn("s", F.least(F.col("len"), F.lit(shingle)))
    sized = [wins.where(F.col("s") == n).select("id", "len", "s", _shingles("win", n).alias("gs")) for n in range(1, shingle + 1)]
    return reduce(DataFrame.unionAll, sized).select("id", "len", "s", "gs", F.posexplode("gs").alias("at", "g"))


def find_windows(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", window=WINDOW, shingle=SHINGLE) -> DataFrame:
    """Per input row ``doc_id, t, n_words, spans, items``: a hash of the text, (start, len) of every occurrence of a window, and the items these are of.

    Null text and text without words give ``n_words`` 0 and nothing found; items without words are ignored; an empty
    item table finds nothing; rows that repeat give the same result each; null ids are kept; other columns are not read.
    """
    of_items = stored(item_windows(items, item_col, item_text, window).select("item", "win", F.sha2(F.array_join("win", " "), 256).alias("id")), "of_items")
    table = stored(window_shingles(of_items.groupBy("id").agg(F.first("win").alias("win")), shingle), "windows")
    sizes = sorted(table.agg(F.collect_set("s")).first()[0]) or [shingle]
    vocabulary = stored(table.select("g", "s").distinct().select(F.xxhash64("g", "s").alias("h"), "g", "s"), "vocabulary")
    known = vocabulary.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("g")), F.lit(0)).alias("bytes")).first()

    # Position 0 stands for the document itself; t tells rows apart that share an id or have none.
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t"), item_words(F.col(text_col)).alias("w"))
    placed = words.select("doc_id", "t", "w", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("at", "word"))
    joined = {n: "concat_ws(' ', word" + "".join(f", get(w, at + {k})" for k in range(n - 1)) + ")" for n in sizes}
    each = [F.expr(f"CASE WHEN at > 0 AND at + {n - 1} <= size(w) THEN xxhash64({joined[n]}, {n}) END") for n in sizes]
    own = F.when(F.col("at") == 0, F.lit(0).cast("bigint"))
    placed = placed.select("doc_id", "t", F.size("w").alias("n_words"), "w", "word", "at", F.explode(F.array(own, *each)).alias("h")).where("h IS NOT NULL")
    marker = table.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("h"), F.lit("").alias("g"), F.lit(0).alias("s"))
    vocabulary = vocabulary.unionAll(marker)
    if known["n"] * 96 + known["bytes"] > BROADCAST_BYTES:
        placed = _maybe_known(placed, vocabulary)
    occurs = join_small(placed, vocabulary, "h", "inner", known["n"] + 1, 96 + known["bytes"] // max(1, known["n"]))
    # Two texts may have one hash: the words decide.
    words_at = "CASE s WHEN 0 THEN ''" + "".join(f" WHEN {n} THEN {joined[n]}" for n in sizes) + " END"
    occurs = stored(occurs.where(f"g = {words_at} AND (s = 0) = (at = 0)").select("doc_id", "t", "n_words", "s", F.col("at").alias("pos"), "g"), "occurs")
    there = occurs.where("s > 0").withColumn("pos", F.col("pos") - 1)

    rarity = there.groupBy("g", "s").agg(F.count("*").alias("n"))
    probes = table.join(rarity, ["g", "s"], "left").groupBy("id", "len", "s", "gs")
    probes = probes.agg(F.min(F.struct("n", "g", "at")).alias("first"), F.count("n").alias("known"), F.count("*").alias("all")).where("known = all")
    probes = stored(probes.select("id", "len", "s", "gs", "first.g", "first.at"), "probes")

    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    size = probes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.expr("octet_length(array_join(gs, ' '))")), F.lit(0)).alias("bytes")).first()
    near = join_small(there, probes, ["g", "s"], "inner", size["n"], 160 + size["bytes"] // max(1, size["n"])).where(fits)
    near = stored(near.groupBy("doc_id", "t", "s").agg(F.collect_set(F.struct(start.alias("start"), "len", "id", "gs")).alias("near")), "near")
    key = lambda a, b: a.doc_id.eqNullSafe(b.doc_id) & a.t.eqNullSafe(b.t)
    held = there.join(near, key(there, near) & (there.s == near.s), "left_semi").groupBy("doc_id", "t", "s").agg(F.array_sort(F.collect_set(F.struct("pos", "g"))).alias("held"))
    true = """filter(transform(near, c -> struct(c.start AS start, c.len AS len, c.id AS id, c.gs AS gs, array_position(held.pos, c.start) AS i)),
              c -> c.i > 0 AND slice(held.g, cast(c.i AS int), size(c.gs)) = c.gs AND get(held.pos, cast(c.i AS int) + size(c.gs) - 2) = c.start + size(c.gs) - 1)"""
    found = held.join(near, key(held, near) & (held.s == near.s)).select(held.doc_id, held.t, F.explode(F.expr(f"transform({true}, c -> struct(c.start AS start, c.len AS len, c.id AS id))")).alias("c"))
    found = stored(found.select("doc_id", "t", "c.*"), "found")
    spans = found.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "len")).alias("spans"))
    # Documents and windows meet items as pairs, combined before they are shuffled; a window that many items share is split.
    named = found.select("doc_id", "t", "id").distinct().join(of_items.select("id", "item"), "id")
    named = named.groupBy("doc_id", "t").agg(F.collect_set("item").alias("items"))
    found = stored(spans, "spans").join(stored(named, "named").toDF("doc_id_", "t_", "items"), F.col("doc_id").eqNullSafe(F.col("doc_id_")) & F.col("t").eqNullSafe(F.col("t_"))).drop("doc_id_", "t_")
    every = occurs.where("s = 0").select("doc_id", "t", F.col("n_words").cast("long").alias("n_words"))
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    return every.join(found, key(every, found), "left").select(every.doc_id, every.t, "n_words", F.coalesce("spans", none("struct<start: int, len: int>")).alias("spans"), F.coalesce("items", none(of_items.schema["item"].dataType.simpleString())).alias("items"))


#: Bits of the table of shingles that may be known, and of one row of it: 32 MB in all, whatever the benchmark's size.
TABLE_BITS, ROW_BITS = 28, 18


def _maybe_known(placed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The rows whose hash has its bit set in a table of the vocabulary's hashes: all that are known, and few others, so that few are shuffled."""
    bit = lambda h: h.bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    row, place = lambda b: F.shiftright(b, ROW_BITS), lambda b: b.bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    b = bit(F.col("h"))
    table = vocabulary.groupBy(row(b).alias("row")).agg(F.bitmap_construct_agg(place(b)).alias("bits"))
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast((h & {(1 << ROW_BITS) - 1}) div 8 as int) + 1, 1)")), 16, 10).cast("bigint")
    return placed.withColumn("row", row(b)).join(F.broadcast(table), "row").where(F.getbit(byte, place(b).bitwiseAND(F.lit(7)).cast("int")) == 1).drop("row", "bits")


def decontaminated(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``; see :func:`find_windows` for odd input."""
    hit = F.expr("size(array_distinct(flatten(transform(spans, c -> sequence(c.start, c.start + c.len - 1)))))").cast("long")
    ids = F.expr("array_sort(array_distinct(transform(items, c -> cast(c AS string))))")
    out = find_windows(docs, items, **columns).select("doc_id", "n_words", hit.alias("n_hit"), ids.alias("ids"))
    return out.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", **columns) -> DataFrame:
    """The rows of ``docs`` in whose own text no window occurs, with all their columns; rows that share an id are judged each."""
    found = find_windows(docs, items, id_col, text_col, **columns).where(F.size("spans") > 0).select(F.col("doc_id").alias("id_"), F.col("t").alias("t_")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found.id_) & F.xxhash64(docs[text_col]).eqNullSafe(found.t_), "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_ORACLE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_ORACLE_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_ORACLE_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, g.n, item_id FROM g JOIN win ON g.t = win.t AND g.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
