"""Scan plans: match, sort, skip, limit and projection stages, ranges of ids, and how many ways to split a scan."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from quarrel.operators import predicate
from quarrel.operators.decode import decode

#: Fixed values of the scan planner.
PARALLEL_FROM = 100_000
MOST_PARTS = 8
IDS_PER_PART, MOST_IDS = 64, 10_000
SELECTIVITY = 0.2


@dataclass
class ScanPlan:
    """One scan: a filter and a range that must both hold, then order, offset, limit and columns."""

    filter: dict | None = None
    part: dict | None = None
    columns: list[str] | None = None
    sort: list[tuple[str, bool]] = field(default_factory=list)  # (path, ascending)
    skip: int = 0
    limit: int | None = None

    def match(self) -> dict | None:
        both = [f for f in (self.filter, self.part) if f]
        return {"$and": both} if len(both) == 2 else both[0] if both else None

    def stages(self) -> list[dict]:
        """The stages in the order they must run; a limit of 0 is a stage, no columns is none."""
        out: list[dict] = []
        if (m := self.match()) is not None:
            out.append({"$match": m})
        if self.sort:
            out.append({"$sort": {p: 1 if up else -1 for p, up in self.sort}})
        if self.skip > 0:
            out.append({"$skip": self.skip})
        if self.limit is not None and self.limit >= 0:
            out.append({"$limit": self.limit})
        if self.columns:
            out.append({"$project": projection(self.columns)})
        return out

    def run(self, docs: DataFrame, schema: T.StructType, again: list[Column] = ()) -> DataFrame:
        """The plan over a collection (``doc``) of that schema: its stages as DataFrame operations, lazily.

        ``again``: conditions that the filter only approximates; all columns are decoded then, and those not read go in the plan.

        Only the columns that a stage names are decoded. The filter is put in terms of decoded columns, so it stands right
        above the scan and never sees a value that the result wouldn't show.
        """
        match = self.match()
        needed = None if self.columns is None or again else {p.split(".")[0] for p in [*self.columns, *(path for path, _ in self.sort), *predicate.paths(match)]}
        rows = decode(docs, schema, columns=None if needed is None else [n for n in schema.names if n in needed])
        if match is not None:
            rows = rows.where(predicate.as_column(match, schema))
        for condition in again:
            rows = rows.where(condition)
        if self.sort:
            rows = rows.orderBy(*(predicate.column_at(path).asc() if up else predicate.column_at(path).desc() for path, up in self.sort))
        if self.skip > 0:
            rows = rows.offset(self.skip)
        if self.limit is not None and self.limit >= 0:
            rows = rows.limit(self.limit)
        return rows if self.columns is None else rows.select(*(predicate.column_at(p).alias(p) for p in projection(self.columns) if p in self.columns))


def projection(paths: list[str]) -> dict[str, int]:
    """Paths to fetch, without those below another; the id is left out unless asked for."""
    kept = [p for p in dict.fromkeys(paths) if not any(p.startswith(f"{q}.") for q in paths)]
    out = dict.fromkeys(kept, 1)
    return out if any(p == "_id" or p.startswith("_id.") for p in kept) else out | {"_id": 0}


def id_range(lo: Any = None, hi: Any = None) -> dict | None:
    """``lo <= _id < hi``; an end that is None is open."""
    ends = ({"$gte": lo} if lo is not None else {}) | ({"$lt": hi} if hi is not None else {})
    return {"_id": ends} if ends else None


def split_points(ids: list, parts: int) -> list:
    """At most ``parts - 1`` distinct cuts of sorted ids, at their quantiles."""
    parts = min(parts, len(ids))
    return list(dict.fromkeys(ids[k * len(ids) // parts] for k in range(1, parts)))


def ranges(ids: list, parts: int) -> list[dict | None]:
    """Ranges that touch, don't overlap and leave nothing out: the first and the last are open."""
    if parts <= 1 or len(ids) < 2:
        return [None]
    cuts = split_points(ids, parts)
    return [id_range(lo, hi) for lo, hi in zip([None, *cuts], [*cuts, None], strict=True)]


def parallelism(count: int, configured: int = 0, limit: int | None = None) -> int:
    """How many ways to split a scan of ``count`` documents: one if they are few or a limit bounds them."""
    if limit is not None or count < PARALLEL_FROM:
        return 1
    return configured if configured > 0 else min(os.cpu_count() or 1, MOST_PARTS)


def ids_wanted(parts: int) -> int:
    """Size of the id sample that split points are taken from."""
    return 0 if parts <= 1 else min(parts * IDS_PER_PART, MOST_IDS)


def estimated(rows: int, size: int, filtered: bool, parts: int = 1) -> dict[str, int]:
    """Rows and bytes that a scan is expected to give, in all and by part; estimates, never exact."""
    share = SELECTIVITY if filtered else 1.0
    return {"rows": int(rows * share), "bytes": int(size * share), "rows_per_part": int(rows * share) // max(1, parts)}
