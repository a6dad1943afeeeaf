"""Session settings that the engine's SQL relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Identifiers keep their case and may be double-quoted; times are UTC; plans are adapted at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.sources.useV1SourceList": "parquet,orc,csv,json,text,avro",
}


def build_session(app: str = "quarrel", **more: str) -> SparkSession:
    """A session with :data:`SETTINGS`; the master and memory are left to the deployment."""
    return SparkSession.builder.appName(app).config(map=SETTINGS | more).getOrCreate()


def scoped(spark: SparkSession) -> SparkSession:
    """A session of the same application with :data:`SETTINGS`, views and functions of its own."""
    own = spark.newSession()
    for k, v in SETTINGS.items():
        if k != "spark.sql.sources.useV1SourceList":
            own.conf.set(k, v)
    return own


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: below the checkpoint folder; a local master may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or f'file://{tempfile.gettempdir()}/quarrel-checkpoints').rstrip('/')}/quarrel-{uuid.uuid4().hex}"
