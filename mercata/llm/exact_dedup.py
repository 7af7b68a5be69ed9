"""Exact dedup by a heavy-hitter split.

Every text is reduced to the SHA-256 of its normalised form (null as empty,
A-Z lower-cased).  Digests are then resolved in two ways:

* **Frequent digests.**  Each task runs a Misra-Gries summary of ``counters``
  entries over its digests; the summaries are added up and the ``counters``
  largest candidates are counted exactly.  The verified winners -- at most
  ``counters`` rows of fixed width, so the broadcast has a proven bound --
  are resolved on the map side: their rows are never shuffled by digest.
* **All other digests** go through an ordinary shuffle by digest.  A digest
  held by more than 1/(counters+1) of a task's rows is always a candidate,
  so no group left for the shuffle can be a large share of the table.

The split decides only where a group is resolved, never its result.

Edge cases: NULL text is the empty text.  Rows with NULL doc_id lose against
any doc_id; if a group has no doc_id at all, keep_id is NULL and one of the
rows is kept.  Rows that repeat doc_id and text count in group_size, and
exactly one of them is kept.  Other columns are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Entries of a Misra-Gries summary; also the bound of the broadcast, in rows.
COUNTERS = 1024
#: A candidate resolved on the map side must have at least this many rows;
#: below it a broadcast entry saves nothing over the shuffle.
LEAST_ROWS = 64


def text_digest(text: str | None) -> bytes:
    """SHA-256 of the text with A-Z lower-cased; NULL counts as empty."""
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass").lower()).digest()


def _column_digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256((x.as_buffer().to_pybytes() if x.is_valid else b"").lower()).digest() for x in texts], pa.binary())


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _column_digests(batch.column(1))], ["doc_id", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, digest binary"
    )


def with_digest(docs: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs``, all columns, and their digest under ``name``."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _column_digests(batch.column(at))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def misra_gries(hashed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, least) candidates: every digest of more than 1/(counters+1)
    of some task's rows is among them, with a lower bound of its count."""

    def run(batches):
        summary: dict[bytes, int] = {}
        for batch in batches:
            for key in batch.column(0).to_pylist():
                if key in summary:
                    summary[key] += 1
                elif len(summary) < counters:
                    summary[key] = 1
                else:  # every entry pays one; the ones used up go
                    summary = {k: n - 1 for k, n in summary.items() if n > 1}
        items = list(summary.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in items], pa.binary()), pa.array([n for _, n in items], pa.int64())], ["digest", "least"]
        )

    return hashed.select("digest").mapInArrow(run, "digest binary, least long")


def exact_dedup(docs: DataFrame, counters: int = COUNTERS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest."""
    hashed = cut(digests(docs))
    candidates = (
        misra_gries(hashed, counters).groupBy("digest").agg(F.sum("least").alias("least"))
        .orderBy(F.desc("least"), "digest").limit(counters).select("digest")
    )
    # Exact counts of the candidates; partial aggregates leave at most
    # ``counters`` rows per task for the shuffle.
    winners = cut(
        hashed.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= least_rows)
    )
    heavy = hashed.join(F.broadcast(winners), "digest")
    light = hashed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    ruled = heavy.select(*columns).unionByName(light.join(groups, "digest").select(*columns))
    # Of rows that repeat doc_id and text, one stays: the keepers are counted
    # (partial aggregates, one group per digest) and all but one laid down again.
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    dropped = ruled.where(~keeper).withColumn("kept", F.lit(False))
    kept = (
        ruled.where(keeper).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
        .select(*columns, F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
        .select(*columns, (F.col("copy") == 1).alias("kept"))
    )
    return dropped.unionByName(kept).select("doc_id", "keep_id", "group_size", "kept", "digest")
