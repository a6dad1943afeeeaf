"""SentencePiece encoding and decoding with forward states shared between words.

The text is marked as the model's normaliser marks it (each space becomes U+2581) and cut where no piece can cross: before
a mark that follows something else. The distinct marked words of a batch are sorted, which lays them out in the order of
a depth-first walk of their trie, and the forward table of a word is kept up to the prefix it shares with the next.

The forward table holds, for every prefix, the last piece of the prefix's best segmentation. For a unigram model that is
the Viterbi recursion over piece scores. For a BPE model the sum of scores doesn't give the pieces that merging gives, so
the recursion takes the one piece whose pair with the previous last piece merging leaves as it is: a segmentation is the
merged one exactly if each of its adjacent pairs is (checked against the library in the tests).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrel.llm.common import doc_batches, read_table, trim, vocabulary

#: The model in use, by its name among the public tokenizers.
MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words whose ids a worker keeps between batches, and pairs of pieces; beyond it a table starts anew. More words are less work and more memory (about 230 bytes each).
KEPT_WORDS = 700_000
KEPT_PAIRS = 600_000
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = raw[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else (8 if key & 7 == 1 else 4, at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class Pieces:
    """A SentencePiece model: ids of a text, text of ids."""

    _loaded: dict = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        path = vocabulary(path)
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            trainer = next((v for k, v in _fields(f.read()) if k == 2), b"")
        self.unigram = next((v for k, v in _fields(trainer) if k == 3), 1) == 1
        n = self.lib.get_piece_size()
        plain = [i for i in range(n) if not (self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i))]
        self.ids = {self.lib.id_to_piece(i): i for i in plain}
        self.scores = {p: self.lib.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.bytes = {int(self.lib.id_to_piece(i)[3:5], 16): i for i in range(n) if self.lib.is_byte(i)}
        self.floor = min(self.scores.values(), default=0.0) - 10.0
        self.unknown = self.lib.unk_id()
        back = {v: k for k, v in self.bytes.items()}
        self.raw = [bytes([back[i]]) if i in back else b"" if self.lib.is_control(i) else self.lib.id_to_piece(i).replace(MARK, " ").encode() if i != self.unknown else " ⁇ ".encode() for i in range(n)]
        self.dummy = self.lib.normalize("a").startswith(MARK) if hasattr(self.lib, "normalize") else True
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.words: dict[str, bytes] = {}  # ids as little-endian unsigned 32-bit integers
        self._forget()

    def _forget(self) -> None:
        self.nodes: dict[str, dict] = {"": {None: ""}}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.known = 0

    def merged(self, text: str) -> list[str]:
        """Pieces by merging: always the best-scored adjacent pair, the leftmost of equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (s := self.scores.get(parts[a] + parts[b])) is not None:
                heappush(queue, (-s, a, b, parts[a], parts[b]))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while queue:
            _, a, b, x, y = heappop(queue)
            if parts[a] != x or b >= len(parts) or parts[b] != y or after[a] != b:
                continue
            parts[a], parts[b] = x + y, None
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def _fits(self, last: str, piece: str, own: dict[str, bool]) -> bool:
        self.known += 1
        got = own[last] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return got

    def _step(self, node: dict, ch: str) -> tuple[dict, tuple]:
        """The node for the longest end of the text that begins a piece, and the pieces that end there, longest first, each with its length and its table of pairs.

        A node is a dictionary from the next character to what this gives, and from None to its text.
        """
        self.known += 1
        now = node[None] + ch
        while now and now not in self.starts:
            now = now[1:]
        ends = [now[k:] for k in range(len(now)) if now[k:] in self.ids]
        if not ends or len(ends[-1]) > 1:
            ends.append(ch)
        got = node[ch] = self.nodes.setdefault(now, {None: now}), tuple((e, len(e), self.pairs.setdefault(e, {})) for e in ends)
        return got

    def segmented(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) of sorted distinct words, in order; forward states of a shared prefix are computed once."""
        if self.known >= KEPT_PAIRS:
            self._forget()
        scores, unigram, step, fits = self.scores, self.unigram, self._step, self._fits
        last, best, nodes, previous = [""], [0.0], [self.nodes[""]], ""
        for word in words:
            keep = 0
            for x, y in zip(previous, word):  # noqa: B905
                if x != y:
                    break
                keep += 1
            del last[keep + 1 :], nodes[keep + 1 :]
            node, i = nodes[keep], keep
            for ch in word[keep:] if keep else word:
                i += 1
                node, ends = node.get(ch) or step(node, ch)
                if unigram:
                    del best[i:]
                    top, pick = max((best[i - size] + scores.get(piece, self.floor), piece) for piece, size, _ in ends)
                    best.append(top)
                else:
                    for pick, size, own in ends:
                        before = last[i - size]
                        ok = own.get(before)
                        if ok or size == 1 or ok is None and fits(before, pick, own):
                            break
                last.append(pick)
                nodes.append(node)
            previous, out, i = word, [], len(word)
            while i:
                pick = last[i]
                out.append(pick)
                i -= len(pick)
            out.reverse()
            yield word, out

    def _ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode(self, texts: list[str | None], kept: int = KEPT_WORDS) -> list[np.ndarray]:
        """The ids of each text as ``<u4``."""
        units = [_UNIT.findall(self.lib.normalize(t)) if t else [] for t in texts]
        table = self.words
        new = set(chain.from_iterable(units)).difference(table)
        if len(table) + len(new) > kept:
            table.clear()
            new = set(chain.from_iterable(units))
        for word, pieces in self.segmented(sorted(new)):
            ids = self._ids_of(pieces)
            table[word] = pack(f"<{len(ids)}I", *ids)
        look = table.__getitem__
        return [np.frombuffer(b"".join(map(look, own)), "<u4") for own in units]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def _coded(path: str, keep_ids: bool, kept_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.load(path)
        for batch in doc_batches(batches, 2_000_000):
            texts = batch.column(1).to_pylist()
            coded = model.encode(texts, kept_words)
            back = [model.decode(ids) for ids in coded]
            cols = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array(map(len, coded), pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(a) for a in coded], pa.int64()),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]),
                "round_trip": pa.array([t == (x or "") for t, x in zip(back, texts, strict=True)]),
            }
            if keep_ids:
                ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "<u4"), *coded]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
        if kept_words < KEPT_WORDS:  # the worker has other stages to serve
            model.words.clear()
            model._forget()
            trim()

    return run


def encode_documents(docs: DataFrame, id_col="doc_id", text_col="text", path: str = MODEL, keep_ids: bool = True, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Per input row ``doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip`` and, if kept, ``ids``.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers; ``round_trip`` tells whether decoding gives
    the text back. Null text is encoded as the empty text: no ids. Rows that repeat give the same result each.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_coded(path, keep_ids, kept_words), schema)


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), keep_ids=False)
