"""Joins whose keys may be hot: one key may hold a third of all rows.

Adaptive execution splits a join's large partitions too, but only beyond a size
threshold, and only where it can read a partition in parts.  Here hot keys are
known before the join: a sketch finds them, their rows are dealt over salts,
and the few rows that they meet are repeated once a salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a partition's fair share that one salt of a hot key takes.
CHUNKS = 16
#: Keys the sketch follows; estimates are off by about rows / TRACKED at most.
TRACKED, MOST_HOT = 32_768, 4096


def frequent_keys(df: DataFrame, keys: Sequence[str], chunk_share: float) -> DataFrame:
    """(key_hash, salts) of the keys that hold more than ``chunk_share`` of all
    rows, in one pass with a mergeable frequent-items sketch.  At most
    ``MOST_HOT`` rows; hashes stand for keys, so a colliding key is salted too,
    which changes no result."""
    hashed = df.select(F.xxhash64(*keys).alias("h"))
    found = hashed.agg(F.expr(f"approx_top_k(h, {MOST_HOT}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("rows")).first()
    hot = [(r.item, -int(-r["count"] // (found.rows * chunk_share))) for r in found.top or [] if r["count"] > found.rows * chunk_share]
    return df.sparkSession.createDataFrame(hot, "key_hash long, salts int")


def salted_join(many: DataFrame, few: DataFrame, on: Sequence[str], how: str = "inner", partitions: int | None = None) -> DataFrame:
    """``many`` joined with ``few`` (inner or left), where a key may hold any
    share of the rows of ``many``.

    A key with more than a ``CHUNKS``-th of a partition's fair share of rows is
    dealt over salts of about that size, by a hash of the row; the rows of
    ``few`` with such a key are repeated once a salt.  Partitions then hold
    about the same number of rows, whatever the keys.  Rows of ``many`` that
    are equal in every column take the same salt.  Runs one job when called."""
    if how not in ("inner", "left"):
        raise ValueError(f"a salted join is inner or left, not {how!r}")
    spark = many.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(frequent_keys(many, on, 1 / (CHUNKS * partitions)))  # at most MOST_HOT rows
    key_hash = F.xxhash64(*on)
    # Dealt by another hash than the one that partitions the rows.
    salt = F.coalesce(F.pmod(F.xxhash64(F.lit("salt"), *many.columns), F.col("salts")), F.lit(0))
    dealt = many.join(hot, key_hash == F.col("key_hash"), "left").withColumn("__salt", salt.cast("int")).drop("key_hash", "salts")
    every = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    repeated = few.join(hot, key_hash == F.col("key_hash"), "left").withColumn("__salt", F.explode(every)).drop("key_hash", "salts")
    return dealt.join(repeated, [*on, "__salt"], how).drop("__salt")
