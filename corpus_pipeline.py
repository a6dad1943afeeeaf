"""The corpus pipeline: documents that the quality classifier rejects go, one document of each near-duplicate group stays,
documents that hold a benchmark window go, secrets are cut out of the texts, and what is left is encoded into pieces.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written and read again as the next stage's ``docs``. All
but the last return the columns of documents. Nulls, empty texts, repeated rows, empty tables and further columns are
treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrel.llm import decontaminate, minhash, pieces, quality, secrets
from quarrel.llm.common import read_table, stored

#: Words that a worker of the last stage keeps between batches.
WORDS = 100_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps: good, and not toxic."""
    return quality.classify(docs, read_table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def _one_row_each(docs: DataFrame) -> DataFrame:
    """One row of each id, the least one by text, language, source and size; rows without an id stay. Only ids that repeat are aggregated."""
    more = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    rest = F.struct("text", "lang", "source", "n_chars")
    least = docs.join(more, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rest).alias("r")).select("doc_id", "r.*")
    return docs.join(more, "doc_id", "left_anti").unionByName(least)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group: shingles of five words, a similarity of 80 % or more.

    Rows that share an id are one document, of which the least row stands for all; documents without an id are kept.
    """
    docs = stored(_one_row_each(_own(docs)), "one_row_each")
    found = minhash.near_duplicates(docs, size=5, percent=80).where("kept AND doc_id IS NOT NULL").select("doc_id")
    return _own(docs.where("doc_id IS NOT NULL").join(found, "doc_id", "left_semi")).unionAll(_own(docs.where("doc_id IS NULL")))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose text no window of a benchmark item occurs; each row is judged by its own text."""
    return _own(decontaminate.clean(_own(docs), read_table(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind in brackets and ``n_chars`` counted again where that was done."""
    return secrets.redact(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text and whether they decode to it. Workers that serve all stages keep few words."""
    return pieces.encode_documents(docs, kept_words=WORDS)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("pieces", encoded),
]

#: Training, component search and piece segmentation are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
