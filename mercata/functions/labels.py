"""Rule tables as data, turned into ``CASE WHEN`` expressions.

A rule is ``(label, {column: (low, high)})`` with inclusive bounds (``None``
= open).  Rules are tried in order; the first match wins, like a searched
``CASE``.  A NULL input makes a condition unknown, so the row falls through
to later rules, again like SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercata.functions.sql import sql_literal

Bounds = tuple[Any, Any]
Rule = tuple[str, dict[str, Bounds]]


def _condition(bounds: dict[str, Bounds], cols: dict[str, str] | None) -> str:
    parts = []
    for name, (low, high) in bounds.items():
        c = f"`{(cols or {}).get(name, name)}`"
        if low is not None:
            parts.append(f"{c} >= {sql_literal(low)}")
        if high is not None:
            parts.append(f"{c} <= {sql_literal(high)}")
    return " AND ".join(parts) or "TRUE"


def label_by_rules(rules: Sequence[Rule], default: str, cols: dict[str, str] | None = None) -> Column:
    """Searched CASE over range rules; ``cols`` maps rule names to column
    names.  Built as one SQL expression (a single call into the JVM)."""
    if not rules:
        return F.lit(default)
    branches = " ".join(f"WHEN {_condition(b, cols)} THEN {sql_literal(label)}" for label, b in rules)
    return F.expr(f"CASE {branches} ELSE {sql_literal(default)} END")


def band(cuts: Sequence[Any], labels: Sequence[str], test: Callable[[Any], Column]) -> Column:
    """``CASE WHEN test(cut_0) THEN label_0 ... ELSE label_last END``.

    ``labels`` has one more entry than ``cuts``; ``test`` builds the comparison
    for one cut, e.g. ``lambda c: col < c`` for right-open bands."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("band needs len(labels) == len(cuts) + 1")
    expr = None
    for cut, label in zip(cuts, labels):
        cond = test(cut)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(labels[-1]) if expr is None else expr.otherwise(F.lit(labels[-1]))
