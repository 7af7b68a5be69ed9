"""Exact ``NTILE(n) OVER (ORDER BY ...)`` over a whole table, distributed.

``F.ntile(n).over(Window.orderBy(...))`` has no partition key, so Spark moves
every row into a single task.  Here the table is never sorted or shuffled:
NTILE(n) is known once the n - 1 keys are known at which a new bucket begins.
Each score's ORDER BY is one order-preserving string
(:func:`mercata.functions.ordering.order_key`), so that all borders of all
scores are found together, in three queries whatever the number of scores:

1. **Sample.**  The input is checkpointed and counted in one go (an
   ``Observation``); a bounded seeded sample of the keys goes to the driver,
   which picks up to ``SLICES`` keys around each border's place, some standard
   errors to each side.
2. **Counts.**  One aggregate counts all rows, the rows before each border's
   slices, and the rows in each slice (map-side partial sums; a few hundred
   groups).  The border's rank, which NTILE's rule fixes (the first ``N mod n``
   buckets get one extra row), then lies in one known slice.  If the sample
   missed it, that is the open slice before or after the others, so the sample
   never decides the result.
3. **Ranks.**  Only that slice's rows, about a thousandth of the table, are
   ranked, in one window over all borders; the row at the border's rank gives
   its key.

Every row's bucket is 1 + the number of border keys at or before its own: a
projection with n - 1 comparisons of strings, no shuffle.  A row's bucket
depends on the row alone, so retries and re-planning cannot move rows.

Pass a unique last key (an entity id).  Rows are ordered further by a hash of
all their columns, so other rows that tie are split too; rows that are equal in
every column are interchangeable, and if a border falls among them they are
counted and laid down again bucket by bucket.

Null ordering follows the SQL-standard default used by the reports' source
engine: NULLs sort last ascending and first descending, unless
``nulls_first`` says otherwise.  Sort keys are numbers, texts, binaries,
booleans, dates or timestamps.  The input must be deterministic; it is read
three times, so it is checkpointed first unless ``materialise='none'``.  The
operator runs jobs when it is called.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercata.functions.observed import observed
from mercata.functions.ordering import order_key
from mercata.session import checkpoint_dir

#: Slices around a border's place; their number sets the share of rows ranked.
SLICES = 32


@dataclass(frozen=True)
class SortKey:
    """One ORDER BY item."""

    column: str
    ascending: bool = True
    nulls_first: bool | None = None

    @property
    def nulls_go_first(self) -> bool:
        return (not self.ascending) if self.nulls_first is None else self.nulls_first

    def sort_column(self) -> Column:
        c = F.col(self.column)
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_go_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_go_first else c.desc_nulls_last()


@dataclass(frozen=True)
class NtileSpec:
    """``NTILE(n) OVER (ORDER BY order_by)`` written to column ``out``."""

    n: int
    order_by: tuple[SortKey, ...]
    out: str


def asc(column: str, nulls_first: bool | None = None) -> SortKey:
    return SortKey(column, True, nulls_first)


def desc(column: str, nulls_first: bool | None = None) -> SortKey:
    return SortKey(column, False, nulls_first)


def _tie_value(df: DataFrame) -> str:
    """SQL: hash of all columns that can be hashed (not maps)."""
    return f"xxhash64({', '.join(f'`{f.name}`' for f in df.schema.fields if 'map<' not in f.dataType.simpleString())})"


def _border_ranks(total: int, n: int) -> list[int]:
    """0-based ranks at which buckets 2..n begin; ``total`` if never."""
    q, r = divmod(total, n)
    return [j * q + min(j, r) for j in range(1, n)]


@dataclass
class _Border:
    """A bucket border of one spec, and the sample keys around its place."""

    spec: int
    number: int  # the border before bucket ``number + 2``
    slices: list[str]
    key: str = ""
    rank: int = 0  # rows before the border
    before: int = 0  # rows with keys strictly before ``key``


def _slices(ordered: list[str], share: float) -> list[str]:
    """Up to ``SLICES`` + 1 sample keys, five standard errors around ``share``."""
    m = len(ordered)
    at, margin = share * m, 2.5 * math.sqrt(m) + 1
    near = ordered[max(0, math.floor(at - margin)) : math.ceil(at + margin) + 1]
    step = max(1, math.ceil(len(near) / SLICES))
    return list(dict.fromkeys([*near[::step], *near[-1:]]))


def _materialise(df: DataFrame, how: str) -> tuple[DataFrame, int]:
    """The input and its number of rows.  ``checkpoint`` (and ``auto``): cut
    the lineage in the session's checkpoint folder, locally and on a cluster
    alike, counting on the way; nothing stays cached, and the files go with the
    DataFrame when ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on."""
    if how not in ("auto", "checkpoint", "none"):
        raise ValueError(f"unknown materialise mode {how!r}")
    if how == "none" or not checkpoint_dir(df.sparkSession, create_if_unset=True):
        if how == "checkpoint":
            raise ValueError("materialise='checkpoint' needs spark.checkpoint.dir")
        return df, df.count()
    counted = Observation()
    base = df.observe(counted, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    return base, (observed(counted) or {"n": 0})["n"]


def add_ntiles(
    df: DataFrame,
    specs: Sequence[NtileSpec],
    *,
    bins: int = 1024,
    samples_per_bin: int = 16,
    seed: int = 20240601,
    materialise: str = "auto",
) -> DataFrame:
    """Add one NTILE column per spec, each over the whole of ``df``.

    ``bins * samples_per_bin`` keys are sampled (their number sets only how
    wide the slices are, never the result or the size of the plan)."""
    for spec in specs:
        if spec.n <= 0:
            raise ValueError("NTILE needs a positive bucket count")
        if not spec.order_by:
            raise ValueError("NTILE needs at least one sort key")
    base, about = _materialise(df, materialise)
    outs = {spec.out for spec in specs}
    keep = [F.col(f"`{c}`") for c in base.columns if c not in outs]
    if about == 0:
        return base.select(*keep, *[F.lit(None).cast("int").alias(spec.out) for spec in specs])

    types = {f.name: f.dataType for f in base.schema.fields}
    tie = (_tie_value(base), T.LongType(), True, True)
    names = [f"__ntile_key_{i}" for i in range(len(specs))]
    keys = [order_key([*((f"`{k.column}`", types[k.column], k.ascending, k.nulls_go_first) for k in spec.order_by), tie]) for spec in specs]
    keyed = base.selectExpr("*", *[f"{key} AS {name}" for key, name in zip(keys, names)])
    # Bounded: sorted on the driver, whose order of these strings is Spark's.
    sample = keyed.select(*names).sample(False, min(1.0, samples_per_bin * bins / about), seed).collect()
    ordered = [sorted(r[i] for r in sample) for i in range(len(specs))]
    borders = [_Border(i, j, _slices(ordered[i], (j + 1) / spec.n)) for i, spec in enumerate(specs) for j in range(spec.n - 1)]
    borders = _locate(keyed, specs, names, borders)

    out = keyed
    for i in range(len(specs)):
        passed = [f"CASE WHEN {names[i]} < '{b.key}' THEN 0 ELSE 1 END" for b in borders if b.spec == i]
        out = out.withColumn(f"__ntile_{i}", F.expr(f"CAST({' + '.join(['1', *passed])} AS INT)"))
    across = [b for b in borders if b.before < b.rank]
    if across:
        out = _split_equal_rows(out, names, across)
    return out.select(*keep, *[F.col(f"__ntile_{i}").alias(spec.out) for i, spec in enumerate(specs)])


def _locate(keyed: DataFrame, specs: Sequence[NtileSpec], names: list[str], borders: list[_Border]) -> list[_Border]:
    """Finds each border's rank and key, and how many rows sort strictly
    before it; borders that no row comes after are left out."""
    if not borders:
        return []

    def in_slices(j: int, b: _Border) -> str:
        """(j, slice) of a row's key if it lies within the border's slices, else NULL."""
        key, slices = names[b.spec], ", ".join(f"'{s}'" for s in b.slices)
        place = f"size(filter(array({slices}), s -> s <= {key}))"
        return f"CASE WHEN {key} >= '{b.slices[0]}' AND {key} < '{b.slices[-1]}' THEN named_struct('j', {j}, 'slice', {place}) END"

    # Every row counts once for the sums, and once for each border whose slices hold it.
    cells = ["named_struct('j', -1, 'slice', 0)", *[in_slices(j, b) for j, b in enumerate(borders) if len(b.slices) > 1]]
    rows = keyed.selectExpr(*names, f"inline(filter(array({', '.join(cells)}), c -> c IS NOT NULL))")
    before = [F.expr(f"count_if(j < 0 AND {names[b.spec]} < '{b.slices[0]}')" if b.slices else "0L").alias(f"before_{j}") for j, b in enumerate(borders)]
    counts = rows.groupBy("j", "slice").agg(F.count(F.lit(1)).alias("n"), *before).collect()
    sums = next(r for r in counts if r.j < 0)
    held = {(r.j, r["slice"]): r.n for r in counts}

    wanted = []
    for j, b in enumerate(borders):
        n = specs[b.spec].n
        b.rank = _border_ranks(sums.n, n)[b.number]
        if not 0 < b.rank < sums.n:
            continue
        low, high, passed = None, (b.slices[0] if b.slices else None), 0
        upto = sums[f"before_{j}"]
        for place in range(1, len(b.slices) + 1):
            if upto > b.rank:
                break
            passed = upto
            low, high = b.slices[place - 1], b.slices[place] if place < len(b.slices) else None
            upto += held.get((j, place), 0)
        wanted.append((j, b, low, high, b.rank - passed, passed))

    def wanted_row(j: int, b: _Border, low: str | None, high: str | None, *_) -> str:
        key = names[b.spec]
        inside = [f"{key} >= '{low}'"] if low is not None else []
        inside += [f"{key} < '{high}'"] if high is not None else []
        return f"CASE WHEN {' AND '.join(inside) or 'TRUE'} THEN named_struct('j', {j}, 'key', {key}) END"

    if not wanted:
        return []
    rows = keyed.selectExpr(f"inline(filter(array({', '.join(wanted_row(*w) for w in wanted)}), c -> c IS NOT NULL))")
    by_key = Window.partitionBy("j").orderBy("key")
    ranked = rows.withColumn("i", F.row_number().over(by_key)).withColumn("first", F.rank().over(by_key))
    place = " ".join(f"WHEN {j} THEN {rank + 1}" for j, _, _, _, rank, _ in wanted)
    found = {r.j: r for r in ranked.where(f"i = CASE j {place} END").collect()}
    for j, b, _, _, _, passed in wanted:
        b.key, b.before = found[j].key, passed + found[j]["first"] - 1
    return [w[1] for w in wanted]


def _split_equal_rows(out: DataFrame, names: list[str], across: list[_Border]) -> DataFrame:
    """Rows equal in all columns at a border's key: as many as the border's
    rank leaves go to the bucket before it.  They are counted (partial
    aggregates) and laid down again, so a large group is no hot task."""
    groups: dict[tuple[int, str], list[_Border]] = {}
    for b in across:
        groups.setdefault((b.spec, b.key), []).append(b)
    ties = {at: F.col(names[at[0]]) == at[1] for at in groups}
    any_tie = reduce(Column.__or__, ties.values())
    columns = out.columns
    copies = out.where(any_tie).groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("__n"))
    laid = copies.select(*[F.col(f"`{c}`") for c in columns], F.explode(F.expr("sequence(0L, __n - 1)")).alias("__i"))
    for (spec, key), borders in groups.items():
        back = sum([F.when(F.col("__i") < b.rank - b.before, 1).otherwise(0) for b in borders], F.lit(0))
        bucket = F.col(f"__ntile_{spec}")
        laid = laid.withColumn(f"__ntile_{spec}", F.when(ties[spec, key], bucket - back).otherwise(bucket))
    return out.where(~any_tie).unionByName(laid.drop("__i"))


def global_ntile(
    df: DataFrame,
    n: int,
    order_by: Sequence[SortKey | str],
    out: str,
    **kwargs: Any,
) -> DataFrame:
    """Single-column form of :func:`add_ntiles`."""
    keys = tuple(k if isinstance(k, SortKey) else SortKey(k) for k in order_by)
    return add_ntiles(df, [NtileSpec(n, keys, out)], **kwargs)
