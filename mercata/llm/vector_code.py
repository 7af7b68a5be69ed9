"""Vector codes: product quantisation with candidates from bitmasks.

Components are floor(256 x).  A vector is cut into ``PARTS`` equal consecutive
parts, and each part becomes the index of the nearest entry (squared Euclidean
distance, ties to the lower index) of its position's codebook of at most 64
entries.  A codebook starts as that part of the vectors with the 64 smallest
ids; each round assigns every part, then replaces each entry by its parts'
componentwise floor(sum / count); entries without parts stay.

**Slice and intersect.**  An entry is a bit of a uint64.  For each dimension of
a part position the entries' coordinates are sorted, and the mask of the first
i entries in that order is kept for every i (prefix entry masks).  A part takes
as its initial radius the distance to a probe: of the entries next to it in one
dimension each, the nearest one.  The nearest entry's coordinates differ by no
more than that radius in any dimension, so in each dimension the slice
[x - r, x + r] of the sorted coordinates holds it: the two prefix masks at the
slice's ends, XORed, are the slice's entries, and the AND over the dimensions is
an exact set of candidates.  Distances are worked out for those bits alone, in
ascending order of index.

Spark reads the table once to code it and once a round; a round's sums are
aggregated by (part, entry, dimension) from each task's own sums.  The driver
holds only the codebooks: 64 vectors.

Edge cases: rows whose vector is NULL or holds a NULL or non-finite component
are dropped.  Rows with NULL or repeated ids are kept and coded; of equal ids
those with the smaller vector come first in the codebook, NULL ids last.
Vectors that are shorter than the longest one, or whose length is no multiple
of the parts, count as filled up with zeros (zero vectors if all are empty).
Fewer than 64 rows make smaller codebooks; none make an empty result.  Large
components leave 64-bit arithmetic for Python's integers; errors beyond a
64-bit integer raise an ArithmeticError.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components below SMALL, of at most SMALL_WIDTH a vector, leave room for a sum of squared differences in 64 bits.
SMALL, SMALL_WIDTH = 1 << 24, 4096
#: A label with more than this share of all rows is summed up to a broadcast row.
HOT_SHARE = 512
#: Rows worked on at a time.
STEP = 8192


def exact_floor(x: float) -> int:
    top, bottom = float(x).as_integer_ratio()
    return 256 * top // bottom


def integers(column: pa.Array, width: int) -> np.ndarray:
    """rows x width: integer components, filled up with zeros; Python's
    integers where 64 bits could overflow."""
    values = column.flatten().to_numpy()
    sizes = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if width > SMALL_WIDTH or (len(values) and np.abs(values).max() * 256 >= SMALL - 1):
        out = np.zeros((len(sizes), width), object)
        out[row, at] = [exact_floor(x) for x in values]
    else:
        out = np.zeros((len(sizes), width), np.int64)
        out[row, at] = np.floor(values * 256).astype(np.int64)
    return out


def limbs(n: int) -> list[int]:
    """Base 2^32, lowest first, the last one signed: sums of these do not overflow."""
    out = []
    while not -(1 << 31) <= n < 1 << 31:
        out.append(n & 0xFFFFFFFF)
        n >>= 32
    return [*out, n]


@dataclass
class Codebook:
    """The entries of one part position, with their prefix masks."""

    entries: np.ndarray  # entries x dimensions

    def __post_init__(self) -> None:
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.order = order
        self.sorted = np.take_along_axis(self.entries, order, 0)
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64))
        self.prefix = np.vstack([np.zeros((1, bits.shape[1]), np.uint64), np.bitwise_or.accumulate(bits, axis=0)])

    def far(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        apart = x - self.entries[entry]
        return (apart * apart).sum(axis=1)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A whole number no entry's distance from x needs to exceed."""
        best = None
        for d in range(x.shape[1]):
            line = self.sorted[:, d]
            right = np.minimum(np.searchsorted(line, x[:, d]), len(line) - 1)
            left = np.maximum(right - 1, 0)
            near = np.where(line[right] - x[:, d] < x[:, d] - line[left], right, left)
            away = self.far(x, self.order[near, d])
            best = away if best is None else np.minimum(best, away)
        if best is None:
            return np.zeros(len(x), np.int64)
        if best.dtype == object:
            return np.array([math.isqrt(b) + 1 for b in best], object)
        return np.sqrt(best.astype(float)).astype(np.int64) + 1

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """uint64 masks of the entries that can be nearest."""
        reach = self.radius(x)
        mask = np.full(len(x), np.uint64((1 << len(self.entries)) - 1))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - reach, side="left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + reach, side="right")
            mask &= self.prefix[high, d] ^ self.prefix[low, d]
        return mask

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of each row of x."""
        mask = self.candidates(x)
        code = np.zeros(len(x), np.int64)
        least = np.full(len(x), -1, x.dtype)
        live = np.arange(len(x))
        one = np.uint64(1)
        while len(live):
            rest = mask[live]
            lowest = rest & (~rest + one)
            entry = np.log2(lowest.astype(float)).astype(np.int64)  # a power of two: exact
            away = self.far(x[live], entry)
            better = (least[live] < 0) | (away < least[live])
            won = live[better.astype(bool)]
            code[won], least[won] = entry[better.astype(bool)], away[better.astype(bool)]
            mask[live] = rest ^ lowest
            live = live[mask[live] != 0]
        return code, least


def _books(entries: list[list[list[int]]]) -> list[Codebook]:
    """From Python integers: part, entry, component."""
    wide = sum(len(part[0]) for part in entries) > SMALL_WIDTH
    large = wide or any(abs(c) >= SMALL for part in entries for entry in part for c in entry)
    return [Codebook(np.array(part, object if large else np.int64).reshape(len(part), -1)) for part in entries]


def _steps(batches, column: int, width: int, books: list[Codebook]):
    """(rows, their integer components) of at most STEP rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            piece = batch.slice(at, STEP)
            x = integers(piece.column(column), width)
            yield piece, x.astype(object) if books[0].entries.dtype == object else x


def _sums(code: np.ndarray, x: np.ndarray, entries: int) -> np.ndarray:
    """entries x dimensions: sums of the parts of each entry."""
    if x.dtype == object:
        out = np.zeros((entries, x.shape[1]), object)
        np.add.at(out, code, x)
        return out
    # Exact: STEP * SMALL is below 2^53.
    return np.stack([np.bincount(code, weights=x[:, d], minlength=entries) for d in range(x.shape[1])], axis=1).astype(np.int64)


def update(rows: DataFrame, held: list, width: int) -> list:
    """The codebooks after one round: parts assigned, entries replaced."""
    parts, size, part = len(held), len(held[0]), len(held[0][0])
    model = rows.sparkSession.sparkContext.broadcast(held)

    def assigned(batches):
        books = _books(model.value)
        counts, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, part), object)
        for _, x in _steps(batches, 0, width, books):
            for p, book in enumerate(books):
                mine = x[:, p * part : (p + 1) * part]
                code, _ = book.assign(mine)
                counts[p] += np.bincount(code, minlength=size)
                sums[p] += _sums(code, mine, size).astype(object)
        p, e, d = (a.ravel() for a in np.indices((parts, size, part)))
        used = counts[p, e] > 0
        cells = [pa.array(a[used], pa.int32()) for a in (p, e, d)]
        yield pa.RecordBatch.from_arrays(
            [*cells, pa.array(counts[p, e][used], pa.int64()), pa.array([limbs(int(s)) for s in sums.ravel()[used]], pa.list_(pa.int64()))], ["part", "entry", "d", "n", "limbs"]
        )

    sums = rows.select("embedding").mapInArrow(assigned, "part int, entry int, d int, n long, limbs array<long>")
    cells = sums.select("part", "entry", "d", "n", F.posexplode("limbs").alias("at", "limb"))
    total: dict[tuple, int] = {}
    count: dict[tuple, int] = {}
    for r in cells.groupBy("part", "entry", "d", "at").agg(F.sum("limb").alias("limb"), F.sum("n").alias("n")).collect():  # the codebooks' components
        key = (r.part, r.entry, r.d)
        total[key] = total.get(key, 0) + (r.limb << (32 * r["at"]))
        if r["at"] == 0:  # every task's sum has a lowest limb
            count[key] = r.n
    return [
        [[total[p, e, d] // count[p, e, d] if (p, e, d) in count else c for d, c in enumerate(entry)] for e, entry in enumerate(book)] for p, book in enumerate(held)
    ]


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, codes, error) of each kept row, as a table in the
    shared folder, and the final codebooks by part, entry and component."""
    if not 1 <= entries <= 64:
        raise ValueError("a codebook has 1 to 64 entries")
    spark = table.sparkSession
    kind = table.schema["label"].dataType.simpleString()
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.where(x.isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"), "label")
    out = f"vec_id long, label {kind}, codes array<int>, error long"
    longest = rows.agg(F.max(F.size("embedding")).alias("n")).first().n
    if longest is None:
        return spark.createDataFrame([], out), []
    part = max(1, math.ceil(longest / parts))
    width = part * parts
    first = rows.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    start = [[exact_floor(c) for c in r.embedding] + [0] * (width - len(r.embedding)) for r in first]
    held = [[v[p * part : (p + 1) * part] for v in start] for p in range(parts)]
    for _ in range(rounds):
        held = update(rows, held, width)
    model = spark.sparkContext.broadcast(held)

    def coded(batches):
        books = _books(model.value)
        for piece, x in _steps(batches, 2, width, books):
            codes, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), x.dtype)
            for p, book in enumerate(books):
                codes[:, p], away = book.assign(x[:, p * part : (p + 1) * part])
                error = error + away
            if error.dtype == object and max(error, default=0) >= 1 << 63:
                raise ArithmeticError("an error does not fit a 64-bit integer")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts, pa.int32()), pa.array(codes.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), lists, pa.array(error, pa.int64())], ["vec_id", "label", "codes", "error"])

    return cut(rows.select("vec_id", "label", "embedding").mapInArrow(coded, out)), held


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of ``error`` over equal labels (NULLs together).
    Sums of frequent labels, at most ``HOT_SHARE`` rows, are broadcast; the
    others, none of them frequent, meet their rows through a shuffle."""
    spark = coded.sparkSession
    sums = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    total = sums.agg(F.sum("n").alias("n")).first().n
    if total is None:
        return coded.withColumn("label_error", F.lit(None).cast("long"))
    often = sums.where(F.col("n") * HOT_SHARE > total).select("of", "label_error", F.lit(True).alias("hot"))
    seldom = sums.where(F.col("n") * HOT_SHARE <= total).select("of", "label_error")
    met = coded.join(F.broadcast(often), F.col("label").eqNullSafe(F.col("of")), "left")
    done = met.where("hot").drop("of", "hot")
    rest = met.where("hot IS NULL").drop("of", "hot", "label_error").join(seldom, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return done.unionByName(rest.select(*done.columns))


def codebooks_text(books: list[list[list[int]]]) -> str:
    """All components by part, entry and place, joined by commas."""
    return ",".join(str(c) for part in books for entry in part for c in entry)


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(codebooks_text(books).encode()).hexdigest()
