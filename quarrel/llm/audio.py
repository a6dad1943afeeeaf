"""Media columns: audio features from 8-bit PCM stored as WAV.

Polyphase resampling (one matrix product per phase set), overlapped log-mel frames, and segmentation of the frame energy
with hysteresis. Features are fixed-shape tensors of ``FRAMES`` x ``MELS`` in half precision (log energies lie between -14 and 13,
so a step is at most 1/128), each with the time span it covers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrel.llm.common import doc_batches, read_table, stored

RATE, UP, DOWN = 16_000, 1, 2
OUT_RATE = RATE * UP // DOWN
TAPS = 16  # per phase and side
WINDOW, HOP, FFT, MELS = 200, 80, 256, 40  # 25 ms and 10 ms at 8 kHz
FRAMES = 100
STORED = np.dtype("<f2")  # type of a stored tensor's values
FLOOR, ON_DB, OFF_DB, LEAST_FRAMES = 20, 6.0, 3.0, 5
#: Samples handled at a time; bounds memory whatever the length.
CHUNK = 1 << 20


def pcm_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono WAV; the payload's bytes are the samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def pcm_of(wav: bytes) -> tuple[int, bytes]:
    """(rate, samples) of an 8-bit mono WAV, by walking its chunks."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(wav):
        name, size = wav[at : at + 4], struct.unpack_from("<I", wav, at + 4)[0]
        if name == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", wav, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        if name == b"data":
            return rate, wav[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _filters(up: int, down: int) -> np.ndarray:
    """(taps, up): for each of the ``up`` phases a windowed-sinc low-pass over ``2 * TAPS`` input samples."""
    cut = min(1.0, up / down)
    t = np.arange(-TAPS + 1, TAPS + 1)[:, None] - (np.arange(up) * down % up / up)[None, :]
    taps = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / TAPS, -1, 1)))
    return (taps / taps.sum(0, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: output m lies at input m * down / up; each of the ``up`` phases is one strided window product."""
    taps, n = _filters(up, down), -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(TAPS + down, np.float32)])
    out = np.empty(n, np.float32)
    for phase in range(up):
        first, size = phase * down // up, len(range(phase, n, up))
        for at in range(0, size, CHUNK):
            end = min(size, at + CHUNK)
            part = np.zeros(end - at, np.float32)
            for k in range(2 * TAPS):
                part += taps[k, phase] * padded[first + k + at * down : first + k + (end - 1) * down + 1 : down]
            out[phase + at * up : phase + (end - 1) * up + 1 : up] = part
    return out


def mel_bank(rate: int = OUT_RATE, bins: int = FFT // 2 + 1, mels: int = MELS) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, bins)
    up, down = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_BANK = mel_bank()
_HANN = np.hanning(WINDOW + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """(frames, MELS) log energies of overlapped frames; the last one is padded to a whole window."""
    lacks = (WINDOW - len(x)) if len(x) < WINDOW else (WINDOW - len(x)) % HOP
    x = np.concatenate([x, np.zeros(lacks, np.float32)])
    frames = sliding_window_view(x, WINDOW)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    for at in range(0, len(frames), 8192):
        part = np.fft.rfft(frames[at : at + 8192] * _HANN, FFT).astype(np.complex64)
        # Not a matrix product: a linear algebra library adds up in another order with other threads, and equal texts must give equal values.
        out[at : at + 8192] = np.log(np.einsum("fb,bm->fm", part.real**2 + part.imag**2, _BANK) + np.float32(1e-6))
    return out


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans of activity: on where the energy is ON_DB above the floor (a percentile of it), off where it is less than OFF_DB above; short ones are dropped."""
    energy = mel.mean(axis=1) * np.float32(10 / np.log(10))
    level = np.percentile(energy, FLOOR)
    state = np.where(energy > level + ON_DB, 1, np.where(energy < level + OFF_DB, -1, 0)).astype(np.int8)
    known = np.where(state != 0, np.arange(len(state)), -1)
    last = np.maximum.accumulate(known)
    on = np.concatenate([[0], (last >= 0) & (state[np.maximum(last, 0)] == 1), [0]]).astype(np.int8)
    edge = np.flatnonzero(np.diff(on))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= LEAST_FRAMES]


def features(wav: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(log-mel frames, active frame spans) of a stored clip."""
    _, samples = pcm_of(wav)
    mel = log_mel(resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128))
    return mel, segments(mel)


def tensors(mel: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start ms, end ms, FRAMES x MELS), the last one padded with the floor; spans tell how far it is filled."""
    for at in range(0, len(mel), FRAMES):
        part = mel[at : at + FRAMES]
        full = np.full((FRAMES, MELS), np.log(np.float32(1e-6)), STORED)
        full[: len(part)] = part
        yield at * HOP * 1000 // OUT_RATE, ((at + len(part) - 1) * HOP + WINDOW) * 1000 // OUT_RATE, full


def as_tensor_array(flat: list) -> pa.FixedShapeTensorArray:
    """Arrow's fixed-shape tensors from the flat lists of the ``tensor`` column."""
    kind = pa.fixed_shape_tensor(pa.float16(), [FRAMES, MELS])
    values = np.asarray(flat, STORED).reshape(-1)
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(values), FRAMES * MELS))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes with zeros up to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes((-len(raw)) % 64 or (0 if raw else 64))


def _tensor_rows(batches):
    for batch in doc_batches(batches, 1 << 20):
        ids, spans, flat, active = [], [], [], []
        for doc_id, wav in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mel, found = features(wav if wav is not None else pcm_wav(payload_of(None)[1]))
            for k, (a, b, full) in enumerate(tensors(mel)):
                ids.append(doc_id)
                spans.append((a, b))
                flat.append(full.reshape(-1))
                active.append(any(x < (k + 1) * FRAMES and y > k * FRAMES for x, y in found))
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64()), pa.array(active, pa.bool_()), pa.array([t.astype(np.float32) for t in flat], pa.list_(pa.float32()))], ["id", "start_ms", "end_ms", "active", "tensor"])


def feature_tensors(clips: DataFrame, id_col="id", wav_col="wav") -> DataFrame:
    """(id, start_ms, end_ms, active, tensor) of clips: one row per fixed-shape tensor. A null clip counts as 64 zero bytes."""
    kind = clips.schema[id_col].dataType.simpleString()
    return clips.select(F.col(id_col).alias("id"), F.col(wav_col).alias("wav")).mapInArrow(_tensor_rows, f"id {kind}, start_ms long, end_ms long, active boolean, tensor array<float>")


def _stored_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in doc_batches(batches):
        made = [payload_of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([pcm_wav(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "wav"])


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each stored clip, its feature tensors (half precision, FRAMES x MELS each) and their time spans."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "starts", "ends", "tensors"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
    for batch in doc_batches(batches):
        rows = []
        for doc_id, size, wav in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _, back = pcm_of(wav)
            starts, ends, made = zip(*tensors(features(wav)[0]), strict=True)
            rows.append((doc_id, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), starts, ends, [t.tobytes() for t in made]))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t or batch.schema.field(0).type) for c, t in zip(cols, kinds, strict=True)], names)


def mel_of(starts: list[int], ends: list[int], stored_tensors: list[bytes]) -> np.ndarray:
    """The log-mel frames that tensors were made of: the spans tell how many of each are filled."""
    full = as_tensor_array([np.frombuffer(t, STORED) for t in stored_tensors]).to_numpy_ndarray().astype(np.float32)
    filled = [((b - a) * OUT_RATE // 1000 - WINDOW) // HOP + 1 for a, b in zip(starts, ends, strict=True)]
    return np.concatenate([t[:n] for t, n in zip(full, filled, strict=True)])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in doc_batches(batches):
        rows = []
        for starts, ends, made in zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "tensors")), strict=True):
            mel = mel_of(starts, ends, made)
            spans = ",".join(f"{a * HOP * 1000 // OUT_RATE}-{((b - 1) * HOP + WINDOW) * 1000 // OUT_RATE}" for a, b in segments(mel))
            # Means by band and spans, rounded well above what the order of float sums could change.
            rows.append((",".join(f"{x:.2f}" for x in mel.mean(axis=0, dtype=np.float64)) + "|" + spans, len(mel), spans))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([*batch.columns[:7], *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True))], [*batch.schema.names[:7], "feature", "n_frames", "spans"])


def media_digest(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per input row the digests of its text stored as audio, and a feature string, from its feature tensors as stored; null text is empty, and no text is 64 zero bytes.

    Equal texts give equal values; rows that repeat give the same result each; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    media = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_stored_form, f"doc_id {kind}, n_bytes long, wav binary")
    own = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    clips = stored(media, "media").mapInArrow(_clips, f"{own}, starts array<long>, ends array<long>, tensors array<binary>")
    return stored(clips, "tensors").mapInArrow(_digests, f"{own}, feature string, n_frames long, spans string")


def op6_audio(spark, sf_dir: str) -> DataFrame:
    return media_digest(read_table(spark, sf_dir, "documents"))
