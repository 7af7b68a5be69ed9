"""Data-quality operators: the checks a database enforces on insert (keys,
types) re-aimed as Spark jobs that report violations instead."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mercata.operators.shares import share_of_total


def row_counts(tables: Mapping[str, DataFrame], labels: Mapping[str, str] | None = None) -> DataFrame:
    """``table_name, row_count`` for every table, largest first
    (``UNION ALL`` of global counts; each count is a partial+final aggregate)."""
    labels = labels or {}
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(labels.get(name, name)).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).orderBy(F.col("row_count").desc(), "table_name")


def duplicate_keys(df: DataFrame, keys: Sequence[str], count_name: str = "dup_count") -> DataFrame:
    """Key values that occur more than once, with their count."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(count_name))
        .filter(F.col(count_name) > 1)
    )


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Rows of ``left`` whose key has no match in ``right`` (orphans / missing
    children), as a left anti join.  ``keys`` maps left to right column names
    when they differ."""
    pairs = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    if all(a == b for a, b in pairs.items()):
        return left.join(right.select(*pairs.values()), list(pairs), "left_anti")
    r = right.select(*[F.col(b).alias(f"__r_{a}") for a, b in pairs.items()])
    cond = reduce(lambda x, y: x & y, [left[a] == r[f"__r_{a}"] for a in pairs])
    return left.join(r, cond, "left_anti")


def unmatched_count(left: DataFrame, right: DataFrame, keys, name: str = "unmatched") -> DataFrame:
    return unmatched(left, right, keys).agg(F.count(F.lit(1)).alias(name))


def null_key_count(df: DataFrame, keys: Sequence[str], name: str = "violations") -> DataFrame:
    """Rows with a NULL in any of the key columns (a primary key allows none)."""
    return df.agg(F.count_if(reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])).alias(name))


def orphan_count(child: DataFrame, parent: DataFrame, keys: Mapping[str, str], name: str = "violations") -> DataFrame:
    """Child rows whose key has no parent row; NULL keys are no orphans.
    Rows are counted per key first (partial aggregates), so only one row per
    key meets the parent, and a hot key is one row like any other."""
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    counted = child.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return unmatched(counted, parent, keys).agg(F.coalesce(F.sum("__rows"), F.lit(0)).alias(name))


def key_audit(parent: DataFrame, keys: Sequence[str], children: Sequence[tuple[DataFrame, Sequence[str]]] = ()) -> DataFrame:
    """One row that answers every question about a key: ``duplicates`` (key
    values that repeat in ``parent``), ``nulls`` (its rows with a NULL in the
    key), and for each of ``children`` (table, its key columns), by place,
    ``orphans_<i>`` (its rows whose key is not NULL and not in ``parent``) and
    ``childless_<i>`` (rows of ``parent`` without a row in it).

    The tables' keys form one union, tagged by table; a row per key value with
    the counts of each tag is all that is shuffled (map-side partial sums), so
    every table is read once, the key meets in one exchange, and a key that
    holds a third of all rows is one row like any other."""
    names = [f"__k{i}" for i in range(len(keys))]
    tables = [(parent, keys), *children]
    tagged = [df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], F.lit(tag).alias("__tag")) for tag, (df, columns) in enumerate(tables)]
    counts = [F.count_if(F.col("__tag") == tag).alias(f"__n{tag}") for tag in range(len(tables))]
    per_key = reduce(DataFrame.union, tagged).groupBy(*names).agg(*counts)
    null = reduce(lambda x, y: x | y, [F.col(n).isNull() for n in names])
    total = lambda rule, n: F.coalesce(F.sum(F.when(rule, F.col(n))), F.lit(0))
    known = F.col("__n0") > 0
    of_children = [
        column
        for i in range(len(children))
        for column in (total(~null & ~known, f"__n{i + 1}").alias(f"orphans_{i}"), total(known & (null | (F.col(f"__n{i + 1}") == 0)), "__n0").alias(f"childless_{i}"))
    ]
    return per_key.agg(F.count_if(F.col("__n0") > 1).alias("duplicates"), total(null, "__n0").alias("nulls"), *of_children)


def null_counts(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """One pass: ``SUM(CASE WHEN c IS NULL THEN 1 ELSE 0 END)`` per column.
    On an empty table the sums are NULL, not 0, as in SQL."""
    named = dict(columns) if isinstance(columns, Mapping) else {c: f"null_{c}" for c in columns}
    return df.agg(
        *[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(out) for c, out in named.items()]
    )


def profile(df: DataFrame, values: Sequence[str], measures: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """One pass over ``df`` for a whole profile: (``column, n`` and the value,
    under its own name, of every value of each of ``values``; an observation
    with the global ``measures``, there once the first is computed).

    The columns' values are grouping sets of one aggregate with map-side
    partial sums; the global measures are observed on the rows as they stream
    by.  Write the first before use (:func:`mercata.plans.quality.order_profile`)."""
    seen = Observation()
    rows = df.observe(seen, *[column.alias(name) for name, column in measures.items()]).select(*values)
    sets = rows.groupingSets([[F.col(v)] for v in values], *values).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__id"))
    # grouping_id has a bit for every column that is not in the set; the first column's is the highest.
    every = (1 << len(values)) - 1
    name = reduce(lambda rest, i: F.when(F.col("__id") == every ^ (1 << (len(values) - 1 - i)), values[i]).otherwise(rest), range(len(values)), F.lit(None))
    return sets.select(name.alias("column"), *values, "n"), seen


def coverage(df: DataFrame, ts: str, distinct: str) -> DataFrame:
    """Earliest/latest timestamp, row count and exact distinct count."""
    return df.agg(
        F.min(ts).alias("earliest_order"),
        F.max(ts).alias("latest_order"),
        F.count(F.lit(1)).alias("total_orders"),
        F.count_distinct(distinct).alias("unique_customers"),
    )


def distribution(
    df: DataFrame, column: str, count_name: str, pct_name: str, scale: int = 2
) -> DataFrame:
    """Rows per value of ``column`` and their share of all rows."""
    grouped = df.groupBy(column).agg(F.count(F.lit(1)).alias(count_name))
    return share_of_total(grouped, count_name, pct_name, scale)


def violations(df: DataFrame, rule: Column) -> DataFrame:
    """Rows breaking ``rule`` (a NULL outcome counts as a violation)."""
    return df.filter(~F.coalesce(rule, F.lit(False)))
