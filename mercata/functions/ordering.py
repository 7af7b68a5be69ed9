"""Composite sort keys as one string.

:func:`order_key` encodes ORDER BY items into a string over ``0-9A-F!~`` whose
binary order is exactly the order of the items: ascending or descending, NULLs
first or last.  Keys of any number and types become one comparable column, and
one value of it can be compared by Spark and by Python alike.

Each item is a sign for NULL, then its value: integers, dates and timestamps as
hex digits of a fixed width, decimals and doubles as sign and magnitude, texts
as the hex digits of their bytes ended by ``!`` (below any digit, so a prefix
comes first).  Descending values have every sign replaced by its opposite.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

ALPHABET, OPPOSITE = "0123456789ABCDEF!", "FEDCBA9876543210~"


def _opposite(code: str) -> str:
    return f"translate({code}, '{ALPHABET}', '{OPPOSITE}')"


def _int(x: str) -> str:
    """8 hex digits of a 32-bit integer."""
    return f"lpad(hex(CAST({x} AS BIGINT) + {1 << 31}L), 8, '0')"


def _long(x: str) -> str:
    """16 hex digits of a 64-bit integer, its sign bit turned."""
    return f"lpad(hex(({x}) ^ (-9223372036854775807L - 1L)), 16, '0')"


def _decimal(x: str, kind: T.DecimalType) -> str:
    if kind.scale > 18:
        raise TypeError(f"no order key for {kind.simpleString()}: more than 18 decimals")
    # Not abs(): Spark rounds the negation of more than 34 digits.
    digits = lambda n, width: f"lpad(replace(CAST({n} AS STRING), '-', ''), {width}, '0')"
    code = digits(f"CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END", kind.precision - kind.scale + 1)
    if kind.scale:
        rest = f"CAST(({x} % 1) * CAST(1{'0' * kind.scale} AS DECIMAL(19,0)) AS BIGINT)"
        code = f"concat({code}, {digits(rest, kind.scale)})"
    return f"CASE WHEN {x} < 0 THEN concat('0', {_opposite(code)}) ELSE concat('1', {code}) END"


def _double(x: str) -> str:
    """Sign, binary exponent and 53 bits of the fraction; NaN is the largest."""
    near = f"CAST(floor(log2(abs({x}))) AS DOUBLE)"
    part = f"(abs({x}) / pow(2D, {near}))"
    exponent = f"({near} + CASE WHEN {part} >= 2 THEN 1 WHEN {part} < 1 THEN -1 ELSE 0 END)"  # log2 may round to the next power
    finite = f"concat(lpad(hex(CAST({exponent} + 2000 AS BIGINT)), 4, '0'), lpad(hex(CAST(abs({x}) / pow(2D, {exponent}) * pow(2D, 52D) AS BIGINT)), 16, '0'))"
    code = f"CASE WHEN abs({x}) = double('Infinity') THEN '{'F' * 20}' ELSE {finite} END"
    return f"CASE WHEN isnan({x}) THEN '4' WHEN {x} = 0 THEN '2' WHEN {x} < 0 THEN concat('1', {_opposite(code)}) ELSE concat('3', {code}) END"


def ascending_code(x: str, kind: T.DataType) -> str:
    """SQL: the value's part of an order key (NULL for NULL)."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return _int(x)
    if isinstance(kind, T.BooleanType):
        return f"CAST(CAST({x} AS INT) AS STRING)"
    if isinstance(kind, T.LongType):
        return _long(x)
    if isinstance(kind, T.DateType):
        return _int(f"unix_date({x})")
    if isinstance(kind, T.TimestampType):
        return _long(f"unix_micros({x})")
    if isinstance(kind, T.TimestampNTZType):
        micros = f"CAST((hour({x}) * 60 + minute({x})) * 60 * 1000000L + extract(SECOND FROM {x}) * 1000000 AS BIGINT)"
        return f"concat({_int(f'unix_date(CAST({x} AS DATE))')}, lpad(hex({micros}), 10, '0'))"
    if isinstance(kind, T.DecimalType):
        return _decimal(x, kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _double(f"CAST({x} AS DOUBLE)")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return f"concat(hex({x}), '!')"
    raise TypeError(f"no order key for {kind.simpleString()}")


def order_key(items: Sequence[tuple[str, T.DataType, bool, bool]]) -> str:
    """SQL: one string, never NULL, from (SQL value, type, ascending, NULLs
    first) items."""
    parts = []
    for x, kind, ascending, nulls_first in items:
        code = ascending_code(x, kind)
        code = code if ascending else _opposite(code)
        parts.append(f"CASE WHEN {x} IS NULL THEN '{'0' if nulls_first else '2'}' ELSE concat('1', {code}) END")
    return f"concat({', '.join(parts)})"
