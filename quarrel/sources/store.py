"""The schema catalog: inferred once, kept in one JSON file, inferred again when too old."""

from __future__ import annotations

import json
import logging
import os
import tempfile
import time
from dataclasses import dataclass, field

from pyspark.sql import types as T

VERSION = 1
_log = logging.getLogger(__name__)


@dataclass
class Stats:
    """What is known of a collection's size, and the paths it has indexes on."""

    docs: int = 0
    mean_bytes: int = 0
    bytes: int = 0
    indexed: list[str] = field(default_factory=list)


@dataclass
class Record:
    schema: T.StructType
    stats: Stats
    inferred_at: float


def key(database: str, collection: str) -> str:
    return f"{database}.{collection}"


class CatalogStore:
    """Records by ``database.collection``. With a path every change is written through, by way of a temporary file."""

    def __init__(self, path: str | None = None):
        self.path, self.records = path, {}
        if path:
            self._load()

    def get(self, name: str) -> Record | None:
        return self.records.get(name)

    def get_fresh(self, name: str, max_age: float, now: float | None = None) -> Record | None:
        """The record if it is at most ``max_age`` seconds old; 0 means that none is too old."""
        got = self.records.get(name)
        if got is None or max_age and (time.time() if now is None else now) - got.inferred_at > max_age:
            return None
        return got

    def put(self, name: str, schema: T.StructType, stats: Stats, now: float | None = None) -> Record:
        got = self.records[name] = Record(schema, stats, time.time() if now is None else now)
        self._save()
        return got

    def known(self, database: str) -> list[str]:
        return sorted(k[len(database) + 1 :] for k in self.records if k.startswith(database + "."))

    def _load(self) -> None:
        """A missing file is an empty catalog; one of another version, or that can't be read, is left aside."""
        if not os.path.exists(self.path):
            return
        try:
            with open(self.path, encoding="utf-8") as f:
                raw = json.load(f)
            if raw.get("version") != VERSION:
                _log.warning("catalog %s has version %s; ignored", self.path, raw.get("version"))
                return
            for name, r in raw["tables"].items():
                self.records[name] = Record(T.StructType.fromJson(r["schema"]), Stats(**r["stats"]), r["inferred_at"])
        except (OSError, ValueError, KeyError, TypeError) as e:
            self.records = {}
            _log.warning("catalog %s can't be read: %s", self.path, e)

    def _save(self) -> None:
        if not self.path:
            return
        tables = {k: {"schema": r.schema.jsonValue(), "stats": vars(r.stats), "inferred_at": r.inferred_at} for k, r in sorted(self.records.items())}
        folder = os.path.dirname(os.path.abspath(self.path))
        os.makedirs(folder, exist_ok=True)
        fd, name = tempfile.mkstemp(dir=folder, prefix=".catalog")
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump({"version": VERSION, "tables": tables}, f)
        os.replace(name, self.path)
