"""Quality classifier by co-training of a text view and a metadata view.

The text view sees hashed words and the shape of the text; the metadata view sees source, language and length. Each view
is a logistic model. Over rounds each view labels the documents of an unlabelled pool that it is confident about, and
those become training rows of the *other* view. Then each view's log odds are calibrated on labelled rows that took no
part in training, a logistic model of the two calibrated log odds combines them, and all documents are scored.

Two heads are trained alike: ``quality`` (1 good) and ``toxic`` (1 toxic). A document is kept if it is good and not toxic.

Training rows are a bounded sample: ``Limits`` says how many. Everything else covers all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrel.llm.common import _MULT, Powers, doc_batches, mix, read_table

HEADS = ("quality", "toxic")
#: Slots of the text view: many more than words that tell something, so that these meet few others.
SLOTS = 1 << 19
META_SLOTS = 1 << 10
_SHAPES = 2048  # the first slots are for the shape of the text


@dataclass(frozen=True)
class Limits:
    """Bounds of the training sample (rows, and characters of each), and of what a view may label in one round.

    Slots in fewer than ``least`` training rows get no weight.
    """

    labelled: int = 8000
    pool: int = 3000
    chars: int = 50_000
    least: int = 5
    rounds: int = 3
    given: int = 300
    confident: float = 0.97


_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_CLASS = np.zeros(256, np.int8)  # 0 symbol, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 plain punctuation
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
_CLASS[[ord(c) for c in ".,'-\""]] = 6
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_slots(text: str | None) -> np.ndarray:
    """Sorted distinct slots of a whole text: its lower-cased words, and binned shares of what it is made of."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    if not n:
        return np.array([0], np.int64)
    inside = np.empty(n + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = _LETTER[raw]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    shares = np.bincount(_CLASS[raw], minlength=7) / n
    words = len(starts)
    values = [*shares, np.log2(1 + n) / 20]
    hashes = np.empty(0, np.uint64)
    if words:
        up, down = Powers.upto(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT)
        kinds, counts = np.unique(hashes, return_counts=True)
        pairs = np.unique(mix(hashes[:-1] * _MULT + hashes[1:]))
        gaps = starts[1:] - ends[:-1]
        same = hashes[1:] == hashes[:-1]
        values += [len(kinds) / words, counts.max() / words, (len(pairs) + 1) / words, (ends - starts).mean() / 20, same.mean() if words > 1 else 0.0, (gaps > 1).mean() if words > 1 else 0.0]
        hashes = kinds
    binned = [1 + 64 * k + min(63, int(64 * v)) for k, v in enumerate(values)] + [1 + 64 * (16 + k) + min(63, int(4 * np.log2(1 + 1000 * v))) for k, v in enumerate(values)]
    return np.unique(np.concatenate([np.array([0, *binned], np.int64), (hashes % np.uint64(SLOTS - _SHAPES)).astype(np.int64) + _SHAPES]))


def meta_slots(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    size = -1 if n_chars is None else int(n_chars).bit_length()
    names = (f"s:{source}", f"l:{lang}", f"n:{size}", f"sl:{source}:{lang}", f"ln:{lang}:{size}")
    return np.unique([0, *(1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (META_SLOTS - 1) for x in names)])


class Rows:
    """Sets of slots of many documents, as one flat array."""

    def __init__(self, sets: list[np.ndarray], slots: int):
        self.sets, self.slots = sets, slots
        self.flat = np.concatenate([np.empty(0, np.int64), *sets]).astype(np.int64)
        self.row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], len(self.sets))


def fit(x: Rows, y: np.ndarray, weight: np.ndarray, least: int = 1, strength: float = 20.0, steps: int = 150, decay: float = 2e-5) -> np.ndarray:
    """Logistic regression, by full-batch steps scaled by each slot's past gradients."""
    out, total = np.zeros(x.slots), weight.sum()
    if not total:
        return out
    # Slots that go with the target by a chi-square test; among all words, chance alone gives the rest their weights.
    n = np.bincount(x.flat, minlength=x.slots)
    share = (y * weight).sum() / total
    hits = np.bincount(x.flat, (y * weight)[x.row], x.slots)
    seen = np.bincount(x.flat, weight[x.row], x.slots)
    lift = (hits - seen * share) ** 2 / np.maximum(seen * share * (1 - share) * np.maximum(1 - seen / total, 1e-9), 1e-9)
    known = np.flatnonzero((n >= least) & (lift >= strength))
    known = np.union1d(known, [0])
    place = np.full(x.slots, -1)
    place[known] = np.arange(len(known))
    used = place[x.flat] >= 0
    flat, row = place[x.flat[used]], x.row[used]
    w, past = np.zeros(len(known)), np.full(len(known), 1e-10)
    for _ in range(steps):
        odds = np.bincount(row, w[flat], len(x.sets))
        g = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y) * weight / total
        g = np.bincount(flat, g[row], len(known)) + decay * w
        past += g * g
        w -= 0.4 * g / np.sqrt(past)
    out[known] = w
    return out


def _platt(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Calibrated log odds from columns of scores, as weights (not negative) and bias: Newton's method with step halving."""
    scale = np.maximum(scores.std(axis=0), 1e-6)
    x = np.column_stack([scores / scale, np.ones(len(scores))])
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))  # Platt's targets
    ridge = np.diag([1e-2] * scores.shape[1] + [1e-6])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - t * z).sum() + 0.5 * w @ ridge @ w)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (p - t) + ridge @ w)
        size, now = 1.0, loss(w)
        while size > 1e-4:
            new = w - size * step
            if loss(new) < now:
                break
            size /= 2
        else:
            break
        w = new
    if scores.shape[1] > 1 and w[:-1].min() < 0:  # a view that would count against itself is left out
        drop = int(w[:-1].argmin())
        return np.insert(_platt(np.delete(scores, drop, axis=1), y), drop, 0.0)
    return np.concatenate([np.maximum(w[:-1], 0) / scale, w[-1:]])


@dataclass
class Head:
    """One target: weights of the two views, their calibrations and the combination. ``constant`` is the log odds if there was one class only."""

    text: np.ndarray
    meta: np.ndarray
    calibration: list
    combination: np.ndarray
    constant: float | None = None

    def log_odds(self, text: Rows, meta: Rows) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(text.sets), self.constant)
        views = [rows.scores(w) for rows, w in ((text, self.text), (meta, self.meta))]
        odds = np.column_stack([v * c[0] + c[1] for v, c in zip(views, self.calibration, strict=True)])
        return odds @ self.combination[:2] + self.combination[2]


def co_train(views: tuple[Rows, Rows], y: np.ndarray, held: np.ndarray, pool: tuple[Rows, Rows], limits: Limits) -> Head:
    """``y``: 0 or 1 for each labelled row; rows where ``held`` is true only calibrate and combine."""
    if not len(y) or y.min() == y.max():
        return Head(np.zeros(SLOTS), np.zeros(META_SLOTS), [], np.zeros(3), 3.0 if len(y) and y[0] > 0 else -3.0)
    extra: list[dict[int, float]] = [{}, {}]  # pool rows that the other view has labelled
    if y[held].min(initial=1) == y[held].max(initial=0):
        held = np.zeros(len(y), bool)
    fitted, calibrated = [np.zeros(0), np.zeros(0)], [np.zeros(2), np.zeros(2)]
    proof = held if held.any() else np.ones(len(y), bool)
    for turn in range(limits.rounds + 1):
        for v in (0, 1):
            if turn and not extra[v] and len(fitted[v]):
                continue
            own = [views[v].sets[k] for k in np.flatnonzero(~held)]
            more = sorted(extra[v].items())
            rows = Rows(own + [pool[v].sets[k] for k, _ in more], views[v].slots)
            target = np.concatenate([y[~held], [t for _, t in more]])
            fitted[v] = fit(rows, target, np.concatenate([np.ones(len(own)), np.full(len(more), 0.5)]), limits.least, 0.0 if v else 20.0)
            calibrated[v] = _platt(views[v].scores(fitted[v])[proof][:, None], y[proof])
        if turn == limits.rounds:
            break
        edge = np.log(limits.confident / (1 - limits.confident))
        for v in (0, 1):
            odds = pool[v].scores(fitted[v]) * calibrated[v][0] + calibrated[v][1]
            sure = np.flatnonzero(np.abs(odds) > edge)
            for k in sure[np.argsort(-np.abs(odds[sure]), kind="stable")][: limits.given]:
                extra[1 - v].setdefault(int(k), float(odds[k] > 0))
    odds = np.column_stack([views[v].scores(fitted[v])[proof] * calibrated[v][0] + calibrated[v][1] for v in (0, 1)])
    return Head(fitted[0], fitted[1], calibrated, _platt(odds, y[proof]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in doc_batches(batches):
        slots = [text_slots(text).astype("<i4").tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "n_chars", *HEADS)), pa.array(slots, pa.binary())], ["doc_id", "source", "lang", "n_chars", *HEADS, "slots"])


def train(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> dict[str, Head]:  # noqa: B008
    """The heads, from at most ``limits.labelled`` labelled rows and ``limits.pool`` others, whose slots go to the driver.

    Both are the first in the order of a hash of the id, among documents of at most ``limits.chars`` characters. Labels of one
    document are averaged; null labels don't count. Of rows that share an id the least one by its values is taken.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.avg(h).alias(h) for h in HEADS))
    mark = F.xxhash64("doc_id")
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= limits.chars)
    ids = short.select("doc_id").where("doc_id IS NOT NULL").distinct()
    few = known.join(ids, "doc_id", "left_semi").orderBy(mark, "doc_id").limit(limits.labelled)
    pool = ids.join(known, "doc_id", "left_anti").orderBy(mark, "doc_id").limit(limits.pool)
    chosen = few.unionByName(pool, allowMissingColumns=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, lang string, n_chars long, {', '.join(f'{h} double' for h in HEADS)}, slots binary"
    first = short.select("doc_id", "source", "lang", F.col("n_chars").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "source", "lang", "n_chars", *HEADS, "text")
    packed = first.mapInArrow(_packed, schema)
    least = packed.groupBy("doc_id").agg(F.min(F.struct(*(c for c in packed.columns if c != "doc_id"))).alias("r"))
    rows = least.select("doc_id", "r.*").orderBy("doc_id").toArrow().to_pylist()
    labelled = [r for r in rows if r["quality"] is not None or r["toxic"] is not None]
    others = [r for r in rows if r["quality"] is None and r["toxic"] is None]

    def views(part: list[dict]) -> tuple[Rows, Rows]:
        text = [np.frombuffer(r["slots"], "<i4").astype(np.int64) for r in part]
        return Rows(text, SLOTS), Rows([meta_slots(r["source"], r["lang"], r["n_chars"]) for r in part], META_SLOTS)

    pool_views, out = views(others), {}
    for head in HEADS:
        part = [r for r in labelled if r[head] is not None]
        y = np.array([float(r[head] >= 0.5) for r in part])
        held = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 4 == 0 for r in part], bool)
        out[head] = co_train(views(part), y, held, pool_views, limits)
        if not part:
            out[head].constant = 3.0 if head == "quality" else -3.0
    return out


def _scored(heads: dict[str, Head]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_batches(batches):
            meta = Rows([meta_slots(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)], META_SLOTS)
            text = Rows([text_slots(t) for t in batch.column("text").to_pylist()], SLOTS)
            p = {h: np.round(1 / (1 + np.exp(-np.clip(heads[h].log_odds(text, meta), -30, 30))), 6) for h in HEADS}
            keep = (p["quality"] >= 0.5) & (p["toxic"] < 0.5)
            cols = [*batch.columns, pa.array(p["quality"]), pa.array(p["toxic"]), pa.array(keep)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "source", "lang", "n_chars", "text", "p_quality", "p_toxic", "keep"])

    return run


def classify(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Per input row the columns of documents and ``p_quality, p_toxic, keep``.

    Null text is scored as empty, other nulls as a value of their own. Without labels, or with labels of one class only,
    a head gives every document that class (good and not toxic if there are none). Rows that repeat give the same result
    each; an empty table gives no rows; further columns are not read.
    """
    heads = train(docs, labels, limits)
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    return d.mapInArrow(_scored(heads), f"doc_id {kind}, source string, lang string, n_chars long, text string, p_quality double, p_toxic double, keep boolean")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    scored = classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_quality", "p_toxic", "keep")
