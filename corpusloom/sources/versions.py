"""Versions of stored tables: one small file switches readers from one set of folders to the next.

Data goes to fresh folders first; a version then lists the folders that belong together. Readers
take the highest version and see all of its folders or none. A write that fails before its version
is there changes nothing. One writer at a time (`operators.jobs.overlap_guard` tells who has to wait).
"""

from __future__ import annotations

import json
import uuid
from typing import Any, NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F

from ..settings import remove_paths

_ENTRY = "version LONG, name STRING, path STRING, info STRING"


class Entry(NamedTuple):
    """A folder of a version, relative to the root, and what its writer noted about it."""

    name: str
    path: str
    info: dict[str, Any]


def read_version(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, list[Entry]]:
    """(number, folders) of the highest version, or of the named one; (0, []) where there is none."""
    try:
        log = spark.read.schema(_ENTRY).option("recursiveFileLookup", True).json(f"{root}/versions")
    except AnalysisException:  # nothing written yet
        return 0, []
    if version is not None:
        log = log.filter(F.col("version") <= version)
    top = log.agg(F.max("version").alias("v"))
    rows = log.join(F.broadcast(top), F.col("version") == F.col("v")).collect()  # the folders of one version
    if not rows:
        return 0, []
    return rows[0].version, [Entry(r.name, r.path, json.loads(r.info)) for r in sorted(rows, key=lambda r: (r.name, r.path)) if r.name]


def fresh_folder(label: str) -> str:
    return f"{label}-{uuid.uuid4().hex}"


def commit_version(spark: SparkSession, root: str, number: int, entries: list[Entry]) -> None:
    """Make `entries` the folders of version `number`; an empty list is a version too."""
    rows = [(number, e.name, e.path, json.dumps(e.info, sort_keys=True)) for e in entries] or [(number, None, None, None)]
    spark.createDataFrame(rows, _ENTRY).coalesce(1).write.mode("overwrite").json(f"{root}/versions/{number:09d}")


def expire_versions(spark: SparkSession, root: str, keep: int) -> None:
    """Forget all versions before number `keep`; their folders stay."""
    try:
        log = spark.read.schema(_ENTRY).option("recursiveFileLookup", True).json(f"{root}/versions")
    except AnalysisException:
        return
    old = [r.version for r in log.filter(F.col("version") < keep).select("version").distinct().collect()]
    remove_paths(spark, [f"{root}/versions/{n:09d}" for n in old])
