"""Shared helpers of the training-data operators: vectorised word hashing, durable intermediate tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast sides must be at most this many bytes by a count taken at run time; above it the join is shuffled.
BROADCAST_BYTES = 48 << 20
#: Rows and bytes of an Arrow batch between Spark and Python workers: rows hold whole texts or sets, so Spark's 10,000 rows and 64 MB are much memory.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20

_LIBC = ctypes.CDLL(None)
_MASK = (1 << 64) - 1
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder. A local master, where all share one disk, may go without and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        jvm_dir = context._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            root = jvm_dir.get()
        elif context.master.startswith("local"):
            root = f"file://{tempfile.gettempdir()}/quarrel-checkpoints"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/quarrel-{uuid.uuid4().hex}"


def vocabulary(name: str) -> str:
    """The place of a tokenizer's file: a path as it is, else a file of the public tokenizers by its name."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def small_batches(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = small_batches(df.sparkSession)
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(left: DataFrame, right: DataFrame, on: str, how: str, rows: int, row_bytes: int) -> DataFrame:
    """Join on ``on``; ``right`` is broadcast only if ``rows * row_bytes``, counted by the caller, is within the bound."""
    small = rows * row_bytes <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right, on, how)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash multiplier and of its inverse, grown on demand and kept by the worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                size = max(n, 1 << 16)
                steps = np.full(size, _MULT)
                steps[0] = 1
                cls.up = np.multiply.accumulate(steps)
                steps[1:] = _INV
                cls.down = np.multiply.accumulate(steps)
        return cls.up[:n], cls.down[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of one text, as byte spans, with a 64-bit hash for each.

    ``lower`` folds A-Z. Null is treated as the empty text.
    """

    __slots__ = ("raw", "starts", "ends")

    def __init__(self, text: str | None, lower: bool = False):
        self.raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        if lower:
            self.raw = _LOWER[self.raw]
        inside = np.empty(len(self.raw) + 2, np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = ~_SPACE[self.raw]
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[::2], edges[1::2]

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, np.uint64)
        up, down = Powers.upto(len(self.raw) + 1)
        sums = np.empty(len(self.raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[: len(self.raw)], out=sums[1:])
        spans = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(spans + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def bytes_of(self, keep: np.ndarray | None = None) -> bytes:
        """The kept words joined by one space."""
        raw = self.raw.tobytes()
        spans = zip(self.starts.tolist(), self.ends.tolist(), strict=True) if keep is None else zip(self.starts[keep].tolist(), self.ends[keep].tolist(), strict=True)
        return b" ".join([raw[a:b] for a, b in spans])


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``n`` consecutive items from each position (Horner's rule over positions, then mixed)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, np.uint64((salt * 0x9E3779B97F4A7C15 + n) & _MASK))
    mult = np.uint64((0xC2B2AE3D27D4EB4F + 2 * salt) & _MASK)
    for i in range(n):
        out *= mult
        out += hashes[i : i + m]
    return mix(out)


def trim() -> None:
    """Give memory that is free back to the system: workers are kept between stages, and what one stage needed another can't use."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def doc_batches(batches: Iterator, chars: int = 4_000_000) -> Iterator:
    """Arrow record batches cut so that each holds at most about ``chars`` bytes of data (one row at least); frees memory at the end."""
    for batch in batches:
        parts = min(batch.num_rows, max(1, batch.nbytes // chars))
        step = -(-batch.num_rows // parts) if parts else 1
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    trim()
