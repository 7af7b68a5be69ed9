"""Ranked lexical search by dense blocked matrix multiplication.

Every document is ranked for every item of a query table.  A document's score
for an item is the sum over the item's terms (repeats included) of a term
weight times the document's impact for the term, all in integers.

**Item blocks.**  Items come in blocks of about ``block_items`` items and
``block_terms`` terms at most (an item is never split), so what is broadcast is
bounded: a block's vocabulary and the matrix items x vocabulary of term counts.
Each block makes one pass over the documents.

**Document rows.**  One pass over the texts keeps, of each document, its number
of terms and the vocabulary terms it holds with their counts, as a table in the
shared folder.  Number of documents, number of terms and the document
frequencies are aggregates of that table.

**Tiles.**  A task takes ``tile_docs`` documents at a time, packs their
vocabulary to the columns that occur, and multiplies weight tiles with impact
tiles of ``tile_terms`` columns in float64.  A tile ends where a partial sum
could reach 2^53, so that each product is an exact integer; tiles are added up
in 64-bit integers.  (A weight too large for a column of its own is split into
two limbs.)

**Top k.**  Each task keeps the best ``k`` of each item: of a tile only what
beats an item's k-th best, or ties with its score and has no larger doc_id, is
looked at.  The tasks' best are merged in two steps (by item and salt, then by
item), so no merge task grows with all tasks.

Edge cases: a NULL or empty text has no term; such a document is not counted
and never ranked.  Every row is a document and every row of ``items`` an item
of its own, also if ids repeat or are NULL; a NULL doc_id ranks after others of
equal score.  Items without terms, and tables without rows, give no rows.
Other columns are ignored.  Scores that a 64-bit integer cannot hold (an item
of some 10^8 words) raise an ArithmeticError.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

K = 20
BLOCK_ITEMS, BLOCK_TERMS = 256, 16_384
TILE_DOCS, TILE_TERMS = 1024, 2048
#: Impacts stay below this: 10^9 tf / (1000 tf + 12 m).
IMPACT = 1_000_000
EXACT = 1 << 53
LIMB = 1 << 30
#: Bytes of text taken apart at a time.
PIECE = 1 << 20

#: Terms are runs of ASCII letters and digits and of all beyond ASCII.
_FOLD = bytes.maketrans(
    UPPER.encode() + bytes(c for c in range(128) if not chr(c).isalnum()),
    LOWER.encode() + b" " * sum(not chr(c).isalnum() for c in range(128)),
)


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in bounded pieces of it."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE) if len(folded) - at > PIECE else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], kind))


def _item_terms(batches):
    for batch in batches:
        for item, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            counts: Counter = Counter()
            for piece in term_pieces(text.as_py() or b""):
                counts.update(piece)
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()], batch.schema.field(0).type), pa.array([list(counts)], pa.list_(pa.binary())), pa.array([list(counts.values())], pa.list_(pa.int64()))],
                    ["item_id", "terms", "counts"],
                )


def _weights(counts: np.ndarray, df: np.ndarray, documents: int) -> np.ndarray:
    """items x vocabulary: the weight of each term times its count in the item."""
    w = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df]
    weights = counts * np.array(w, np.int64)
    most = max((sum(map(int, row)) for row in weights), default=0)
    if most * IMPACT >= 1 << 63:
        raise ArithmeticError("an item's score does not fit a 64-bit integer")
    return weights


def tiles(weights: np.ndarray, width: int) -> Iterator[tuple[slice, int, np.ndarray]]:
    """(columns, factor, weights / factor as float64) whose products with
    impacts add up to less than 2^53 in every row."""
    limbs = [(1, weights)]
    if weights.size and int(weights.max()) * IMPACT >= EXACT:
        limbs = [(1, weights % LIMB), (LIMB, weights // LIMB)]
    for factor, part in limbs:
        at = 0
        while at < part.shape[1]:
            sums = np.cumsum(part[:, at : at + width].astype(float), axis=1).max(axis=0)
            n = max(1, int(np.searchsorted(sums, (EXACT - 1) / IMPACT * (1 - 1e-9), side="right")))
            yield slice(at, at + n), factor, part[:, at : at + n].astype(float)
            at += n


def tile_scores(weights: np.ndarray, impacts: np.ndarray, width: int) -> np.ndarray:
    """weights (items x terms) times impacts (terms x documents), exact."""
    total = np.zeros((weights.shape[0], impacts.shape[1]), np.int64)
    for columns, factor, part in tiles(weights, width):
        total += np.rint(part @ impacts[columns]).astype(np.int64) * factor
    return total


class Best:
    """The k best (score, doc_id) of each item; NULL ids come last."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, items
        self.item = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.doc = np.empty(0, np.int64)
        self.null = np.empty(0, bool)
        self.need = np.ones(items, np.int64)  # only scores above 0 rank
        self.last = np.full(items, np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """scores: items x documents."""
        able = (scores > self.need[:, None]) | ((scores == self.need[:, None]) & (doc[None, :] <= self.last[:, None]))
        item, place = np.nonzero(able)
        if not len(item):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[item, place]])
        doc, null = np.concatenate([self.doc, doc[place]]), np.concatenate([self.null, null[place]])
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        start = np.searchsorted(item, np.arange(self.items))
        rank = np.arange(len(item)) - start[item]
        order, item = order[rank < self.k], item[rank < self.k]
        self.item, self.score, self.doc, self.null = item, score[order], doc[order], null[order]
        full = np.flatnonzero(np.bincount(item, minlength=self.items) == self.k)
        worst = np.searchsorted(item, full, side="right") - 1
        self.need[full], self.last[full] = self.score[worst], self.doc[worst]


def _search_block(docs: DataFrame, block: list, k: int, tile_docs: int, tile_terms: int) -> DataFrame:
    """(item, doc_id, score): the best of each task for a block of items;
    ``item`` is the place in the block."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    for row in block:
        for term in row.terms:
            vocabulary.setdefault(bytes(term), len(vocabulary))
    counts = np.zeros((len(block), len(vocabulary)), np.int64)
    for i, row in enumerate(block):
        counts[i, [vocabulary[bytes(t)] for t in row.terms]] = row.counts
    words = spark.sparkContext.broadcast(vocabulary)

    def read(batches):
        known = words.value.get
        for batch in batches:
            n, found, times = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                size, held = 0, Counter()
                for piece in term_pieces(text.as_py() or b""):
                    size += len(piece)
                    held.update(map(known, piece))
                held.pop(None, None)
                n.append(size)
                found.append(np.fromiter(held.keys(), np.int32, len(held)))
                times.append(np.fromiter(held.values(), np.int64, len(held)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), _lists(found, pa.int32()), _lists(times, pa.int64())],
                ["doc_id", "n", "terms", "tf"],
            )

    rows = cut(docs.mapInArrow(read, "doc_id long, n long, terms array<int>, tf array<long>").where("n > 0"))
    facts = rows.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    if not facts.documents:
        return spark.createDataFrame([], "item int, doc_id long, score long, task int")
    documents, all_terms = facts.documents, facts.terms
    df = np.zeros(len(vocabulary), np.int64)
    for row in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the block's vocabulary
        df[row.term] = row["count"]
    model = spark.sparkContext.broadcast(_weights(counts, df, documents))

    def search(batches):
        weights = model.value
        best = Best(len(weights), k)
        for batch in batches:
            for at in range(0, batch.num_rows, tile_docs):
                tile = batch.slice(at, tile_docs)
                found, tf = tile.column(2).flatten().to_numpy(), tile.column(3).flatten().to_numpy()
                each = np.diff(tile.column(2).offsets.to_numpy())
                if not len(found):
                    continue
                # Long arithmetic overflows first at 25 n N; Python's does not.
                m = np.array([75 + 25 * n * documents // all_terms for n in tile.column(1).to_pylist()], np.int64)
                place = np.repeat(np.arange(len(each)), each)
                columns, column = np.unique(found, return_inverse=True)
                impacts = np.zeros((len(columns), len(each)))
                impacts[column, place] = 1_000_000_000 * tf // (1000 * tf + 12 * m[place])
                held = np.flatnonzero(each)
                doc = tile.column(0)
                ids = np.array([np.iinfo(np.int64).max if i is None else i for i in doc.to_pylist()], np.int64)
                best.add(tile_scores(weights[:, columns], impacts[:, held], tile_terms), ids[held], doc.is_null().to_numpy(zero_copy_only=False)[held])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item, pa.int32()), pa.array(best.doc, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())], ["item", "doc_id", "score"]
        )

    return rows.select("doc_id", "n", "terms", "tf").mapInArrow(search, "item int, doc_id long, score long").withColumn("task", F.spark_partition_id())


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    block_items: int = BLOCK_ITEMS,
    block_terms: int = BLOCK_TERMS,
    tile_docs: int = TILE_DOCS,
    tile_terms: int = TILE_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text)
    of each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, terms array<binary>, counts array<long>")
    asked = cut(asked.withColumn("row", F.monotonically_increasing_id()))
    size = asked.agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("terms")).alias("terms")).first()
    none = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not size["items"]:
        return none
    blocks = max(math.ceil(size["items"] / block_items), math.ceil(size.terms / block_terms))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    out = []
    for b in range(blocks):
        block = dealt.where(F.col("block") == b).select("item_id", "terms", "counts").collect()  # about block_items rows and block_terms terms
        if not block:
            continue
        found = _search_block(docs, block, k, tile_docs, tile_terms)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salted = found.withColumn("salt", F.col("task") % 64)
        few = salted.withColumn("r", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("r") <= k)
        last = few.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(block)], f"item int, item_id {kind}")
        ranked = last.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out.append(cut(ranked) if blocks > 1 else ranked)
    while len(out) > 1:  # a shallow tree of unions
        out = [a.unionByName(out[i + 1]) if i + 1 < len(out) else a for i, a in enumerate(out) if i % 2 == 0]
    return out[0] if out else none
