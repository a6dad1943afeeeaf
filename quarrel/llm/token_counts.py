"""Token counts kept as additive rollups by source, language and tokenizer version.

A batch is a set of signed rows: an insert adds a document and its tokens, a delete takes them away, a revised count is
both. Only a batch's sums meet the totals, so keeping them up costs what changed. A commit writes the new totals to a
folder of its own, then a small log entry under a name of its own, and then gives that entry its number, which fails if the
number is taken: an entry is seen whole or not at all. A batch that is applied again, or by a second writer, changes
nothing; a writer that loses the race for a number starts again from the totals of the winner; and what a lost writer
leaves behind is never read.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrel.llm.common import doc_batches, read_table, shared_dir, stored, vocabulary

KEYS = ("source", "lang", "version")
SUMS = ("docs", "tokens")
#: Tokenizer versions by name: vocabulary files of byte-level BPE ranks and the pattern they are used with.
TOKENIZERS = {"bpe50k": "byte_bpe_50k.tiktoken", "bpe50k-multi": "byte_bpe_multi_50k.tiktoken"}
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def tokenizer(path: str):
    import tiktoken

    with open(vocabulary(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counted(paths: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_batches(batches):
            texts = batch.column(3).to_pylist()
            for version, path in paths.items():
                coder = tokenizer(path)
                counts = [len(coder.encode_ordinary(t)) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * len(texts), pa.string()), pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "version", "tokens"])

    return run


def count_tokens(docs: DataFrame, paths: dict[str, str] = TOKENIZERS) -> DataFrame:
    """(doc_id, source, lang, version, tokens) for each input row and tokenizer version; null and empty texts have none."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", "lang", "text").mapInArrow(_counted(paths), f"doc_id {kind}, source string, lang string, version string, tokens long")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """The rows of ``counts`` as inserts (sign 1) or deletes (sign -1)."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.col("tokens") * sign).cast("long").alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts that replace others: deletes of the old rows, inserts of the new ones. The two need not be matched row by row."""
    return signed(old, -1).unionAll(signed(new, 1))


@dataclass
class Rollup:
    """Totals in the folder ``path``; ``log/<n>.json`` names the n-th batch and the folder with the totals after it.

    Keys may be null. Totals may be negative if deletes come before their inserts; a key whose sums are all 0 has no row.
    """

    spark: SparkSession
    path: str
    read: dict[str, dict] = field(default_factory=dict, repr=False)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def log(self) -> list[dict]:
        """The committed batches in order."""
        jvm, fs = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(at))
        for name in names:
            if name not in self.read:  # entries never change
                stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{name}"))
                try:
                    self.read[name] = json.loads(stream.readUTF())
                finally:
                    stream.close()
        return [self.read[n] for n in names]

    def totals(self) -> DataFrame:
        log = self.log()
        if not log:
            return self.spark.createDataFrame([], ", ".join([*(f"{k} string" for k in KEYS), *(f"{s} long" for s in SUMS)]))
        return self.spark.read.parquet(f"{self.path}/{log[-1]['totals']}")

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Apply a batch of signed rows once. False if it was committed before; then ``rows`` is not even read."""
        delta = None
        while True:
            log = self.log()
            if any(x["batch"] == batch for x in log):
                return False
            if delta is None:
                delta = rows.groupBy(*KEYS).agg(*(F.sum(s).alias(s) for s in SUMS))
            after = self.totals().select(*KEYS, *SUMS).unionAll(delta).groupBy(*KEYS).agg(*(F.sum(s).alias(s) for s in SUMS))
            name = f"totals/{len(log):08d}-{uuid.uuid4().hex}"
            after.where(" OR ".join(f"{s} <> 0" for s in SUMS)).coalesce(1).write.parquet(f"{self.path}/{name}")
            if self._publish(len(log), {"batch": batch, "totals": name}):
                return True

    def _publish(self, number: int, entry: dict) -> bool:
        """Write an entry aside and give it its number; False if another writer has that number."""
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        aside = path(f"{self.path}/aside/{uuid.uuid4().hex}.json")
        stream = fs.create(aside, False)
        try:
            stream.writeUTF(json.dumps(entry))
        finally:
            stream.close()
        fs.mkdirs(path(f"{self.path}/log"))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(aside, path(f"{self.path}/log/{number:08d}.json"), keep)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            fs.delete(aside, False)
            return False
        return True


def maintained_counts(docs: DataFrame, path: str, paths: dict[str, str] = TOKENIZERS) -> DataFrame:
    """Totals of ``docs`` by way of batches: provisional counts by length, revised by tokens, the revision delivered twice.

    Returns ``source, lang, version, n_docs, n_tokens``. Null keys form groups of their own; rows that repeat count each;
    an empty table gives no rows.
    """
    counts = stored(count_tokens(docs, paths), "counts")
    guess = docs.select("doc_id", "source", "lang", F.explode(F.array(*map(F.lit, paths))).alias("version"), F.ceil(F.coalesce("n_chars", F.lit(0)) / 4).alias("tokens"))
    rollup = Rollup(docs.sparkSession, path)
    rollup.commit("provisional", signed(guess, 1))
    for _ in range(2):
        rollup.commit("counted", revised(guess, counts))
    return rollup.totals().select(*KEYS, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return maintained_counts(read_table(spark, sf_dir, "documents"), shared_dir(spark))
