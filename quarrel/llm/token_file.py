"""Token-id output: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Order 2 and order 1 predict an id each (the last one seen in that context, with a confidence). Whether the predicted id
comes is coded by a probability mixed from what order 2, order 1 and order 0 (how frequent the id is) say of it: logistic
mixing with adaptive weights, corrected by how often the guess was right in the same situation. An id that wasn't
predicted is coded by order 0, adaptive frequencies of the ids that were not. All arithmetic is on integers, so what one
machine wrote any other reads.

Blocks share nothing. Within a block many streams, each a run of its ids with a range coder of its own, are coded in
lockstep by array operations: every step codes one id of each stream, then the block's one model learns them all.

A file is a table of chunks (Parquet carries them); a chunk is whole documents in ascending order: their ids and
lengths, and a body of blocks. Body: magic, number of blocks; per block its ids, streams, alphabet and the CRC-32 of its
ids as little-endian unsigned 32-bit integers, and how many 32-bit digits each stream has; then the digits of all
streams; the CRC-32 of all before.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarrel.llm.common import doc_batches, mix, read_table, stored, vocabulary

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Ids of a block; the most streams it has, and how many ids a stream has at least (if the block has as many).
BLOCK, LANES, LEAST_STEPS = 1 << 22, 4096, 1024
#: A chunk ends with the document that reaches this, so that it is one block unless documents are long.
CHUNK_IDS = BLOCK - (BLOCK >> 4)
#: Text of a part (one task), and at most how many parts: their totals go to the driver.
PART_BYTES, MOST_PARTS = 24 << 20, 100_000
#: Words that a worker remembers the ids of, and their bytes: beyond either it begins anew with the next batch.
KEPT_WORDS, KEPT_BYTES = 1_000_000, 32 << 20
#: Characters of a text that are split at a time (more where it has no space to part it at).
PIECE = 1 << 20
MAGIC = b"QCM2"
#: How words are split; another pattern of the tokenizers means that texts go to the library whole.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ONE, _ZERO = 12, 20  # bits of the probability of a guess, of the frequencies of order 0
_O2 = 18  # log2 of the slots of order 2
_EDGE = 4  # no probability of a guess comes nearer to 0 or 1 than this
_EVERY = 8  # steps between two updates of the mixture
_DIGIT = np.uint64(32)
_MIN = np.uint64(1 << 32)
_FULL = np.uint64((1 << 64) - 1)
_LAST = np.uint64((1 << _ZERO) - 1)
_SITUATIONS = (8, 2, 8, 8)  # frequency of the guess, whether the orders agree, confidence of order 2, of order 1
_AXES = ((1, 2, 3), (0, 2), (0, 1, 3))  # what orders 0, 1 and 2 don't see of a situation


def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """4096 / (1 + exp(-x / 256)) for x from -2047, and its inverse, by whole numbers alone."""
    knots = np.array([1, 2, 3, 6, 10, 16, 27, 45, 73, 120, 194, 310, 488, 747, 1101, 1546, 2047, 2549, 2994, 3348, 3607, 3785, 3901, 3975, 4022, 4050, 4068, 4079, 4085, 4089, 4092, 4093, 4094])
    at = np.arange(4095)
    low, part = at >> 7, at & 127
    squash = knots[low] * (128 - part) + knots[np.minimum(low + 1, 32)] * part + 64 >> 7
    return squash, np.searchsorted(squash, np.arange(4096)).clip(0, 4094) - 2047


_SQUASH, _STRETCH = _logistic()


class _Model:
    """What a block knows after the steps so far; the same on both sides. Contexts hold ``id * 8 + confidence`` (1 to 7), or 0."""

    def __init__(self, lanes: int, alphabet: int):
        self.lanes, self.alphabet = lanes, alphabet
        self.one, self.two = np.zeros(1 << 16, np.int32), np.zeros(1 << _O2, np.int32)
        self.a, self.before = np.zeros(lanes, np.int32), np.zeros(lanes, np.uint32)
        self.seen, self.right = np.zeros(_SITUATIONS, np.int64), np.zeros(_SITUATIONS, np.int64)
        self.weights = np.full((3, 1, 1, 1, 1), 1 << 15, np.int64)
        self.events, self.filled = np.empty((_EVERY, lanes), np.int64), 0
        self.counts, self.missed = np.zeros(alphabet, np.int64), []
        self.steps, self.due = 0, 1
        self.mix()
        self.count()

    def predict(self) -> np.ndarray:
        """Sets the guesses; returns the mixed probability of each."""
        own = self.a.astype(np.uint32) * np.uint32(0x9E3779B1)
        self.at2 = (own ^ self.before) >> np.uint32(32 - _O2)
        self.before = own * np.uint32(0x85EBCA6B)
        self.v1, self.v2 = self.one.take(self.a, mode="clip"), self.two.take(self.at2, mode="clip")
        self.c1, self.c2 = self.v1 & 7, self.v2 & 7
        self.guess = np.where(self.c2 > 0, self.v2, self.v1) >> 3
        self.situation = (self.c2 << 3) + self.c1 + ((self.v1 ^ self.v2) < 8) * np.int32(64) + self.frequency.take(self.guess, mode="clip")
        return self.p.take(self.situation, mode="clip")

    def learn(self, ids: np.ndarray, hit: np.ndarray, missed: np.ndarray) -> None:
        fresh = (ids << 3) + np.int32(1)
        self.one[self.a] = fresh + np.minimum(self.c1, 6) * ((self.v1 ^ fresh) < 8)
        self.two[self.at2] = fresh + np.minimum(self.c2, 6) * ((self.v2 ^ fresh) < 8)
        self.a = ids
        np.add(self.situation << 1, hit, out=self.events[self.filled])
        self.filled += 1
        self.missed.append(missed)
        self.steps += 1
        if self.filled == _EVERY or self.steps < _EVERY:
            self.mix()
        if self.steps >= self.due:
            self.count()
            self.due = self.steps + max(self.steps >> 2, -(-256 // self.lanes))

    def mix(self) -> None:
        """The probabilities of guesses, by situation, after the events since the last time."""
        if self.filled:
            events = np.bincount(self.events[: self.filled].ravel(), minlength=2048).reshape(*_SITUATIONS, 2)
            n, right, self.filled = events.sum(axis=-1), events[..., 1], 0
            error = (right << _ONE) - n * self.mixed
            self.weights += (self.inputs * error).sum(axis=(1, 2, 3, 4), keepdims=True) // (int(n.sum()) << 6)
            np.clip(self.weights, 0, 1 << 17, out=self.weights)
            self.seen += n
            self.right += right
        shares = (((self.right.sum(axis=x, keepdims=True) << _ONE) + 1024) // (self.seen.sum(axis=x, keepdims=True) + 2) for x in _AXES)
        self.inputs = np.stack([np.broadcast_to(_STRETCH[s.clip(1, 4094)], _SITUATIONS) for s in shares])
        self.mixed = _SQUASH[((self.weights * self.inputs).sum(axis=0) >> 16).clip(-2047, 2047) + 2047]
        p = ((self.right << _ONE) + (self.mixed << 5)) // (self.seen + 32)
        self.p = p.clip(_EDGE, (1 << _ONE) - _EDGE).astype(np.uint64).ravel()

    def count(self) -> None:
        """The frequencies of order 0, after the misses since the last time."""
        if self.missed:
            self.counts += np.bincount(np.concatenate(self.missed), minlength=self.alphabet)
            self.missed = []
        total, room = int(self.counts.sum()), (1 << _ZERO) - self.alphabet
        share = 1 + (self.counts * room // total if total else np.full(self.alphabet, room // self.alphabet))
        share[share.argmax()] += (1 << _ZERO) - int(share.sum())
        self.size = share.astype(np.uint64)
        self.start = np.cumsum(self.size) - self.size
        self.lookup = np.repeat(np.arange(self.alphabet, dtype=np.uint16), share)
        self.frequency = np.zeros(1 << 16, np.int32)
        self.frequency[: self.alphabet] = np.frexp(share.astype(np.float64))[1] // 3 * 128


def _code_block(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digits (uint32) of all streams, one after the other, and how many each has; ``rows`` is (streams, steps)."""
    lanes, steps = rows.shape
    model, columns = _Model(lanes, int(rows.max()) + 1), np.ascontiguousarray(rows.T)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
    out, place = np.zeros((steps // 2 + 16) * lanes, np.uint64), np.arange(lanes)  # a row of digits, one of each stream, after the other
    for t in range(steps):
        ids = columns[t]
        bound = (span >> np.uint64(_ONE)) * model.predict()
        hit = model.guess == ids
        miss = np.flatnonzero(~hit)
        missed, now, at = ids[miss], low[miss], bound[miss]
        unit = span[miss] - at >> np.uint64(_ZERO)
        at += now + model.start.take(missed) * unit
        over = at < now
        if over.any():  # carries are added to the last digit and resolved at the end
            out[place[miss[over]] - lanes] += np.uint64(1)
        low[miss], span = at, bound
        span[miss] = unit * model.size.take(missed)
        small = np.flatnonzero(span < _MIN)
        if len(small):
            now, at = low[small], place[small]
            if at.max() + 4 * lanes > len(out):
                out = np.concatenate([out, np.zeros_like(out)])
            out[at] = now >> _DIGIT
            place[small] = at + lanes
            low[small] = now << _DIGIT
            span[small] <<= _DIGIT
        model.learn(ids, hit, missed)
    for _ in range(2):
        out[place] = low >> _DIGIT
        place += lanes
        low = low << _DIGIT
    digits, count = out.reshape(-1, lanes), place // lanes
    for k in range(len(digits) - 1, 0, -1):
        digits[k - 1] += digits[k] >> _DIGIT
    return digits.astype("<u4").T[np.arange(len(digits)) < count[:, None]], count


def _decode_block(digits: np.ndarray, count: np.ndarray, steps: int, alphabet: int) -> np.ndarray:
    """(streams, steps) ids."""
    lanes = len(count)
    model, place = _Model(lanes, alphabet), np.cumsum(count) - count
    digits = np.concatenate([digits, np.zeros(2, "<u4")]).astype(np.uint64)
    code, span = digits[place] << _DIGIT | digits[place + 1], np.full(lanes, _FULL)
    place += 2
    out = np.empty((steps, lanes), np.uint16)
    for t in range(steps):
        bound = (span >> np.uint64(_ONE)) * model.predict()
        hit = code < bound
        miss = np.flatnonzero(~hit)
        at = bound[miss]
        unit, now = span[miss] - at >> np.uint64(_ZERO), code[miss] - at
        missed = model.lookup.take(np.minimum(now // unit, _LAST).astype(np.int64))
        code[miss], span = now - model.start.take(missed) * unit, bound
        span[miss] = unit * model.size.take(missed)
        ids = model.guess
        ids[miss] = missed
        small = np.flatnonzero(span < _MIN)
        if len(small):
            at = place[small]
            code[small] = code[small] << _DIGIT | digits.take(at, mode="clip")
            place[small] = at + 1
            span[small] <<= _DIGIT
        out[t] = ids
        model.learn(ids, hit, missed)
    return out.T


def encode_ids(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> bytes:
    """The body of a chunk: blocks of ``block`` ids, of at most ``lanes`` streams each."""
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
        raise ValueError("ids must be from 0 to 65535")
    heads, bodies = [], []
    for at in range(0, len(ids), block):
        own = ids[at : at + block].astype("<u4")
        streams = max(1, min(lanes, len(own) // LEAST_STEPS))
        rows = np.zeros((streams, -(-len(own) // streams)), np.int32)  # the last streams may end in zeros that are no ids
        rows.ravel()[: len(own)] = own
        digits, count = _code_block(rows)
        heads += [struct.pack("<IIII", len(own), streams, int(own.max()) + 1, zlib.crc32(own)), count.astype("<u4").tobytes()]
        bodies.append(digits.tobytes())
    body = b"".join([MAGIC, struct.pack("<I", len(bodies)), *heads, *bodies])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_ids(body: bytes, lanes: int | None = None) -> np.ndarray:
    """The ids of a chunk's body as uint32; raises ValueError if it is damaged.

    ``lanes`` has no effect any more: the body says how many streams a block has.
    """
    if body[:4] != MAGIC or len(body) < 12:
        raise ValueError("not a body of blocks")
    if zlib.crc32(memoryview(body)[:-4]) != struct.unpack_from("<I", body, len(body) - 4)[0]:
        raise ValueError("the body's checksum is wrong")
    heads, at = [], 8
    for _ in range(struct.unpack_from("<I", body, 4)[0]):
        size, streams, alphabet, crc = struct.unpack_from("<IIII", body, at)
        heads.append((size, alphabet, crc, np.frombuffer(body, "<u4", streams, at + 16).astype(np.int64)))
        at += 16 + 4 * streams
    out = []
    for size, alphabet, crc, count in heads:
        digits = np.frombuffer(body, "<u4", int(count.sum()), at)
        at += digits.nbytes
        ids = _decode_block(digits, count, -(-size // len(count)), alphabet).reshape(-1)[:size].astype("<u4")
        if zlib.crc32(ids) != crc:
            raise ValueError("a block's checksum is wrong")
        out.append(ids)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


_LETTER, _NUMBER, _SPACE, _OTHER, _DIFFERS, _END, _UNKNOWN = range(7)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SHORT = 15  # bytes of a word that a key holds


def _keys(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that hold the bytes and the length of each word of at most ``_SHORT`` bytes."""
    units = np.frombuffer(raw + bytes(32 - len(raw) % 8), "<u8")
    unit, shift = starts >> 3, ((starts & 7) << 3).astype(np.uint64)
    rest = np.uint64(63) - shift
    first, second, third = units.take(unit), units.take(unit + 1), units.take(unit + 2)
    low = (first >> shift | second << np.uint64(1) << rest) & _MASKS.take(sizes, mode="clip")
    high = (second >> shift | third << np.uint64(1) << rest) & _MASKS.take(np.clip(sizes - 8, 0, 7))
    return low, high | sizes.astype(np.uint64) << np.uint64(56)


def _pieces(text: str) -> list[str]:
    """A text cut before spaces that follow no white space: words start there, whatever is before or after."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = text.find(" ", at + PIECE)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


class Coder:
    """Ids of whole texts, by the tokenizers library.

    Byte-level BPE encodes each word of its pattern by itself, so the library's model gets distinct words, and their ids
    are looked up by the words' bytes. Texts are split by array operations over kinds of characters, as the pattern splits
    them. That holds for texts that the pattern splits here as there: a text with a character that the two take for
    different kinds, or with the name of an added token, goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(vocabulary(path))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.sorts = [(regex.compile(p), k) for p, k in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE))]
        kind = json.loads(self.lib.to_str())
        own = kind["pre_tokenizer"] or {}
        self.by_word = public_tokenizers.PATTERN == PATTERN and kind["normalizer"] is None and own.get("type") == "ByteLevel" and own.get("use_regex") and not own.get("add_prefix_space") and kind["model"]["type"] == "BPE"
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.model = self.lib.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = dict.fromkeys(plain) | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.letters = {b: chr(b if c is None else c) for b, c in self.letters.items()}
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.low, self.high, self.word = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)
        self.long: dict[bytes, int] = {}
        self.n, self.n_ids, self.n_bytes = 1, 1, 0  # the first word is the end of a document
        self.at, self.size, self.ids = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64), np.full(1 << 16, END_ID, np.uint32)

    def _alike(self, ch: str) -> bool:
        """Whether the library splits texts with this character where the pattern does."""
        text = f"a{ch}1{ch}!{ch} {ch}\n{ch}{ch} a{ch}"
        ends = [b for _, (_, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]
        return ends == [m.end() for m in self.pattern.finditer(text)]

    def _kinds_of(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kinds.take(codes)
        new = np.unique(codes[kinds == _UNKNOWN])
        for code in new.tolist():
            ch = chr(code)
            self.kinds[code] = next((k for p, k in self.sorts if p.match(ch)), _OTHER) if self._alike(ch) else _DIFFERS
        return self.kinds.take(codes) if len(new) else kinds

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The words' numbers, 0 for words not known."""
        mask = len(self.word) - 1
        slot = (mix(low ^ high * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(mask)).astype(np.int64)
        there = self.high.take(slot)
        good = (there == high) & (self.low.take(slot) == low)
        found = np.where(good, self.word.take(slot), 0)
        left = np.flatnonzero(~good & (there > 0))
        while len(left):
            slot[left] = slot[left] + 1 & mask
            own = slot[left]
            there = self.high.take(own)
            good = (there == high[left]) & (self.low.take(own) == low[left])
            found[left[good]] = self.word.take(own[good])
            left = left[~good & (there > 0)]
        return found

    def _place(self, low: np.ndarray, high: np.ndarray, word: np.ndarray) -> None:
        mask = len(self.word) - 1
        slot = (mix(low ^ high * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(low))
        while len(left):
            free = left[self.high[slot[left]] == 0]
            self.word[slot[free]] = word[free]
            free = free[self.word[slot[free]] == word[free]]  # one of those that want a slot has it
            self.low[slot[free]], self.high[slot[free]] = low[free], high[free]
            left = left[self.word[slot[left]] != word[left]]
            slot[left] = slot[left] + 1 & mask

    def _add(self, words: list[bytes]) -> None:
        """Asks the library for the ids of words that are not known yet."""
        lists = [[t.id for t in self.model.tokenize(w.decode("latin-1").translate(self.letters))] for w in words]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        first, self.n = self.n, self.n + len(words)
        for name, used in (("at", self.n), ("size", self.n), ("ids", self.n_ids + int(sizes.sum()))):
            old = getattr(self, name)
            if used > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(len(old), used - len(old)), old.dtype)]))
        self.size[first : self.n] = sizes
        self.at[first : self.n] = self.n_ids + np.cumsum(sizes) - sizes
        self.ids[self.n_ids : self.n_ids + int(sizes.sum())] = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
        self.n_ids += int(sizes.sum())
        self.n_bytes += sum(map(len, words))
        if 2 * self.n > len(self.word):
            had = np.flatnonzero(self.high)
            low, high, word, slots = self.low[had], self.high[had], self.word[had], 1 << (4 * self.n).bit_length()
            self.low, self.high, self.word = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
            self._place(low, high, word)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.long.update((w, first + i) for i, w in enumerate(words) if len(w) > _SHORT)
        short = np.flatnonzero(lengths <= _SHORT)
        self._place(*_keys(b"".join(words), (np.cumsum(lengths) - lengths)[short], lengths[short]), first + short)

    def _starts(self, codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where words of ``PATTERN`` start, and where documents end."""
        after, before = kinds[1:], kinds[:-1]
        start = np.ones(len(codes), bool)
        np.not_equal(after, before, out=start[1:])
        text = (after != _SPACE) & (after != _END)
        start[1:] &= ~(text & (codes[:-1] == 32))  # one space belongs to the word after it
        start[:-1] |= text & (before == _SPACE)  # the last of several spaces is left for it, any other white space is a word
        start |= kinds == _END
        quote = np.flatnonzero((codes == 39) & start)
        if len(quote):
            one, two = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
            is_one = np.isin(one, [ord(c) for c in "stmd"])
            is_two = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            quote, size = quote[is_one | is_two], np.where(is_one, 1, 2)[is_one | is_two]
            start[quote + 1] = False
            start[quote + size + 1] |= kinds[quote + size + 1] == _LETTER
        return np.flatnonzero(start)

    def _split(self, texts: list[str], plain: bool) -> list[np.ndarray | None]:
        """Ids of texts, of which all or none are ASCII (``plain``); None for those that the library must split."""
        if self.n > KEPT_WORDS or self.n_bytes > KEPT_BYTES:
            self._forget()
        joined = "".join(f"{t}\0" for t in texts)
        raw = joined.encode()
        codes = np.frombuffer(raw, np.uint8) if plain else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kinds = self._kinds_of(codes)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds[ends] = _END
        odd = np.diff(np.cumsum(kinds == _DIFFERS)[ends], prepend=0) > 0
        starts = self._starts(codes, kinds)
        last = kinds[starts] == _END
        if not plain:
            widths = 1 + (codes >= 0x80) + (codes >= 0x800).astype(np.int8) + (codes >= 0x10000)
            starts = (np.cumsum(widths) - widths)[starts]
        sizes = np.diff(starts, append=len(raw))
        low, high = _keys(raw, starts, sizes)
        word = np.zeros(len(starts), np.int64)
        short = np.flatnonzero((sizes <= _SHORT) & ~last)
        word[short] = self._find(low[short], high[short])
        new, rest = short[word[short] == 0], np.flatnonzero((sizes > _SHORT) & ~last)
        spelt = [raw[a : a + n] for a, n in zip(starts[rest].tolist(), sizes[rest].tolist(), strict=True)]
        fresh = {raw[a : a + n] for a, n in zip(starts[new].tolist(), sizes[new].tolist(), strict=True)}
        fresh.update(w for w in spelt if w not in self.long)
        if fresh:
            self._add(list(fresh))
            word[new] = self._find(low[new], high[new])
        word[rest] = [self.long[w] for w in spelt]
        size = self.size.take(word)
        total = np.cumsum(size)
        ids = self.ids.take(np.arange(total[-1]) + np.repeat(self.at.take(word) - total + size, size))
        return [None if o else x for o, x in zip(odd.tolist(), np.split(ids, total[last][:-1]), strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text and ``END_ID``."""
        texts = [t or "" for t in texts]
        out: list = [None] * len(texts)
        own = [i for i, t in enumerate(texts) if not any(x in t for x in self.added)] if self.by_word else []
        for plain in (True, False):
            group = [i for i in own if len(texts[i]) <= PIECE and texts[i].isascii() == plain]
            if group:
                for i, ids in zip(group, self._split([texts[i] for i in group], plain), strict=True):
                    out[i] = ids
        for i in own:
            if len(texts[i]) > PIECE:
                parts = [self._split([p], p.isascii())[0] for p in _pieces(texts[i])]
                if not any(x is None for x in parts):
                    out[i] = np.concatenate([*(x[:-1] for x in parts[:-1]), parts[-1]])
        whole = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(whole, self.lib.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array([*e.ids, END_ID], np.uint32)
        return out


@cache
def _coder(path: str) -> Coder:
    """A worker keeps its coder between tasks: this function is pickled by its name, so the memory is the worker's own."""
    return Coder(path)


def _chunks(path: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, made = _coder(path), TaskContext.get().partitionId(), 0
        names, lists, total = [], [], 0

        def chunk() -> pa.RecordBatch:
            flat = np.concatenate(lists)
            row = [[part], [made], [names], [[len(x) for x in lists]], [len(flat)], [encode_ids(flat)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(kind), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["part", "chunk", "doc_ids", "sizes", "n_ids", "body"])

        for batch in doc_batches(batches, 3_000_000):
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                names.append(doc_id)
                lists.append(ids)
                total += len(ids)
                if total >= CHUNK_IDS:
                    yield chunk()
                    names, lists, total, made = [], [], 0, made + 1
        if names:
            yield chunk()

    return run


def write_ids(docs: DataFrame, id_col="doc_id", text_col="text", path: str = TOKENIZER, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the ids of all texts, ``END_ID`` after each, in ascending id order, to a file of chunks in the shared folder; returns its table.

    ``path`` is a file, or the name of one of the public tokenizers. Null text is empty. Rows that repeat are written each,
    in the order of a hash of their text; null ids come first. Ids may be of any type that can be ordered; an empty table
    gives a file without chunks.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTS, max(1, -(-size // part_bytes)))
    placed = d.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    arrow = to_arrow_type(d.schema["doc_id"].dataType)
    return stored(placed.mapInArrow(_chunks(path, arrow), f"part int, chunk int, doc_ids array<{kind}>, sizes array<long>, n_ids long, body binary"), "ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for names, sizes, body, base in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "sizes", "body", "base")), strict=True):
            ids = decode_ids(body)
            ends = np.cumsum(np.array(sizes, np.int64))
            starts = ends - np.array(sizes, np.int64)
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
            kind = batch.schema.field("doc_ids").type.value_type
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(starts + base), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(table: DataFrame) -> DataFrame:
    """Per document of a file ``doc_id, start, n_tokens, ids_crc32``, from the decoded ids. Only the parts' totals reach the driver.

    Rows that repeat have a place each; a file without chunks has no rows.
    """
    spark, base, rows = table.sparkSession, 0, []
    for part, n in sorted(table.groupBy("part").agg(F.sum("n_ids")).collect()):
        rows.append((part, base))
        base += n
    starts = spark.createDataFrame(rows, "part int, base long")
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = table.select("part", "chunk", before.alias("within"), "n_ids")
    heads = heads.join(F.broadcast(starts) if len(rows) <= 200_000 else starts, "part").select("part", "chunk", (F.col("base") + F.col("within")).alias("base"))
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    few = len(rows) <= 20_000
    placed = table.join(F.broadcast(heads) if few else heads, ["part", "chunk"])
    return placed.select("doc_ids", "sizes", "body", "base").mapInArrow(_read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op5_token_file(spark, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(read_table(spark, sf_dir, "documents")))
