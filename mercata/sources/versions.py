"""Tables in versioned folders, switched by a manifest.

``overwrite`` deletes a table before it writes the new one, so a run that dies
in between leaves nothing.  Here every write goes to folders of its own,

    <directory>/<table>/v<version>
    <directory>/manifests/v<version>      (table, folder, format of each table)

and the manifest, one small file that Spark's committer moves into place as a
whole, is written last.  Readers follow the newest manifest: before it is
there they see the old version, then the new one, of all tables together.  A
write that dies leaves folders that no manifest names.

Versions sort by the time they were begun.  One writer at a time: of two that
overlap, the one that began later takes its other tables from the manifest it
saw when it ended.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "manifests"
Entries = dict[str, dict[str, str]]


def _place(directory: str, *names: str) -> str:
    return "/".join([directory.rstrip("/"), *names])


def manifests(spark: SparkSession, directory: str) -> dict[str, Entries]:
    """{version: {table: {"folder", "format"}}} of all finished versions,
    oldest first."""
    try:
        # Hidden files, such as those of a write under way, are not read.
        lines = spark.read.text(_place(directory, MANIFESTS, "*")).select("value").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    found = [json.loads(r.value) for r in lines]
    return {m["version"]: m["tables"] for m in sorted(found, key=lambda m: m["version"])}


def current(spark: SparkSession, directory: str) -> Entries:
    """The newest version's tables, or nothing."""
    versions = manifests(spark, directory)
    return versions[max(versions)] if versions else {}


def write_version(
    tables: Mapping[str, DataFrame], directory: str, fmt: str = "parquet", partition_by: Mapping[str, Sequence[str]] | None = None, **options: str
) -> str:
    """Writes the tables as a new version and switches to it; tables of the
    version before that are not among them stay as they are.  ``partition_by``:
    columns that make folders of their own, by table.  Returns the version."""
    if MANIFESTS in tables:
        raise ValueError(f"no table can be named {MANIFESTS}")
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    if not tables:
        return version
    spark = next(iter(tables.values())).sparkSession
    written = {}
    for name, df in tables.items():
        df.write.options(**options).format(fmt).partitionBy(*(partition_by or {}).get(name, ())).save(_place(directory, name, version))
        written[name] = {"folder": f"{name}/{version}", "format": fmt}
    entry = json.dumps({"version": version, "tables": {**current(spark, directory), **written}})
    spark.range(1).select(F.lit(entry).alias("value")).coalesce(1).write.text(_place(directory, MANIFESTS, version))
    return version


def read_version(spark: SparkSession, directory: str, name: str, entries: Entries, **options: str) -> DataFrame:
    """A table as a manifest's entries have it."""
    return spark.read.options(**options).format(entries[name]["format"]).load(_place(directory, entries[name]["folder"]))


def superseded(spark: SparkSession, directory: str, keep: int = 2) -> list[str]:
    """Folders of finished versions that none of the newest ``keep`` manifests
    names, and those versions' manifests; for the caller to delete
    (:func:`mercata.sources.files.remove`) once no reader uses them."""
    if keep < 1:
        raise ValueError("at least the current version is kept")
    versions = manifests(spark, directory)
    old, new = sorted(versions)[:-keep], sorted(versions)[-keep:]
    used = {e["folder"] for v in new for e in versions[v].values()}
    gone = {e["folder"] for v in old for e in versions[v].values()} - used
    return [_place(directory, f) for f in sorted(gone)] + [_place(directory, MANIFESTS, v) for v in old]
