"""Mixing sources to target weights.

Sizes are word counts.  Sources, in code-point order with NULL last, get the
weights of ``weights`` in turn and share ``share`` of all words; no target may
pass ``max_epochs`` times its source's size, and what a capped source cannot
take is shared among the others by weight until none is above its cap.

Which words are taken: every document gets a hash-random key, from its
doc_id, its text and its number among rows that are equal in all that counts
here, so neither rows without doc_id nor copies share a key.  Equal rows are
counted (on the map side first) and dealt out again in pieces of
``COPIES``; no task numbers them all.  Within a source the key range is cut into buckets of about ``bucket_rows`` rows; word
sums of the buckets give a distributed prefix sum, and only the bucket that
holds the source's budget is sorted row by row, so a source with a third of
all rows is spread over as many tasks as it has buckets.  A source takes
``floor(budget / size)`` whole epochs and then, in key order, the words up to
its exact budget; the document at the cut gives only part of its words.

Edge cases: NULL or empty text has size 0 and takes nothing.  NULL is a
source of its own; empty string is another.  Repeated rows count each on
their own.  With ``carry``, rows of one doc_id and text that differ in the
carried columns share a key and come in the order of those columns: such
groups should be small.  A table without words has only zero targets; an
empty table gives an empty result.  Other columns are ignored.  The keys
depend on rows and seed alone, so reruns agree.  Shares are worked out over
one row per source in one task, which suits up to some millions of sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_ROWS = 4096
#: Equal rows that one task deals out.
COPIES = 4096
SEED = 20


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_rows, source_size, target), one row per source.

    Water filling in closed form: with sources ordered by cap / weight, the
    first k are capped, where k is the first place whose fair level
    (words left / weight left) does not pass its own cap / weight.  The
    windows run over one aggregated row per source.
    """
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size"))
    everything = W.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("place", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs).withColumn("fill", F.col("cap") / F.col("weight"))
    before = W.orderBy("fill", "place").rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy("fill", "place").rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(onward))
    levels = levels.withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "place", "level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(float("inf"))) * F.col("weight"))
    return levels.select("source", "source_rows", "source_size", target.alias("target"))


def keyed(docs: DataFrame, seed: int = SEED, carry: Sequence[str] = (), copies: int = COPIES) -> DataFrame:
    """(doc_id, source, size, digest, number, key, *carry) of each row."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("digest"), *carry)
    alike = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("alike"))
    pieces = alike.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("alike") - 1) / copies))))
    pieces = pieces.repartition("digest", "doc_id", "piece")
    number = F.sequence(F.col("piece") * copies, F.least((F.col("piece") + 1) * copies, "alike") - 1)
    single = pieces.withColumn("number", F.explode(number)).drop("alike", "piece")
    return single.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "digest", "number"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    share: float = 1.0,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken
    and the columns ``carry`` of the row."""
    sized = cut(keyed(docs, seed, carry))
    targets = source_targets(sized, weights, max_epochs, share)
    budget = F.round("target").cast("long")
    plan = cut(
        targets.select(
            F.col("source").alias("of"), "source_size", "target",
            F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).alias("epochs"),
            F.ceil(F.col("source_rows") / bucket_rows).alias("buckets"),
        ).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    )
    # The key's place in the 64-bit range, from 0 to 1, times the bucket count.
    bucket = F.least(F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.col("buckets")), F.col("buckets") - 1)
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", bucket)
    sums = rows.groupBy("of", "rest", "bucket").agg(F.sum("size").alias("words"))
    running = W.partitionBy("of").orderBy("bucket")
    spans = cut(
        sums.withColumn("start", F.sum("words").over(running) - F.col("words"))
        .select(F.col("of").alias("of_"), F.col("bucket").alias("bucket_"), "start", (F.col("start") + F.col("words")).alias("end"))
    )
    rows = rows.join(spans, F.col("of").eqNullSafe(F.col("of_")) & (F.col("bucket") == F.col("bucket_")))
    whole, none = F.col("end") <= F.col("rest"), F.col("start") >= F.col("rest")
    columns = ["doc_id", "source", "size", "source_size", "target", *carry]
    clear = rows.where(whole | none).select(*columns, "epochs", F.when(whole, F.col("size")).otherwise(0).alias("last"))
    order = W.partitionBy("of", "bucket").orderBy("key", "doc_id", "digest", "number", "size", *carry)
    split = rows.where(~(whole | none)).withColumn("upto", F.col("start") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("upto") + F.col("size")))
    both = clear.unionByName(split.select(*columns, "epochs", last.alias("last")))
    return both.select(*columns[:5], (F.col("epochs") * F.col("size") + F.col("last")).cast("long").alias("taken"), *carry)
