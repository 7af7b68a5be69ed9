r"""CSV files whose quoted fields hold newlines, read split by split.

Spark's ``multiLine`` CSV reader gives a whole file to one task, because a
newline ends a record only outside quotes, and whether a split begins inside
quotes depends on everything before it.  Here a large file is read by as many
tasks as it has splits:

1. **Parity.**  Each split's lines are read in order.  A record begins at every
   line before which the number of quotes is even (a doubled quote counts
   twice, so it changes nothing).  A task does not know the quotes before its
   split, so it reports the parity of its own quotes, and the number of record
   starts for both cases.
2. **Prefix scan.**  Over a file's splits in order, the parities add up to the
   state in which each split begins, and the record starts to the number of its
   first record.  This is one short row a split, at most ``MOST_SPLITS`` of them.
3. **Records.**  Each split's lines are put together to records.  Records inside
   a split are whole; pieces of those that cross a split's border (at most two a
   split) are gathered by record number.
4. Spark's own ``from_csv`` parses the records.

Quotes must be used as RFC 4180 and PostgreSQL's COPY do: a quote anywhere
opens or closes quoting.  A file whose last quote is not closed is refused, as
are more than ``MOST_SPLITS`` splits in one call.  Records end with \\n or \\r\\n;
empty lines between records are skipped; newlines inside quotes are kept as
they are, \r\n too, as COPY does (Spark's one-task reader makes them \n if the
records end with \r\n).  The first record of each file is its header.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions of this module run in tasks; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: One row of some hundred bytes for each is sent to the tasks.
MOST_SPLITS = 1_000_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line): a task gets the lines of a split in order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """((file, block), lines): stretches of lines of one split."""
    for batch in batches:
        file, block, line = batch.columns
        at = 0
        while at < batch.num_rows:
            same = pc.and_(pc.equal(file.slice(at), file[at]), pc.equal(block.slice(at), block[at]))
            end = pc.index(same, False).as_py()
            end = batch.num_rows if end < 0 else at + end
            yield (file[at].as_py(), block[at].as_py()), line.slice(at, end - at)
            at = end


def _quotes_and_blank(lines: pa.Array) -> tuple[list[int], list[bool]]:
    quotes = pc.count_substring(lines, '"').to_pylist()
    blank = pc.is_in(lines, value_set=pa.array(["", "\r"])).to_pylist()
    return quotes, blank


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, odd, starts_if_closed, starts_if_open) of each split."""
    now, odd, starts = None, 0, [0, 0]

    def row():
        return pa.RecordBatch.from_pylist(
            [{"file": now[0], "block": now[1], "odd": odd, "starts_if_closed": starts[0], "starts_if_open": starts[1]}],
            pa.schema([("file", pa.string()), ("block", pa.int64()), ("odd", pa.int32()), ("starts_if_closed", pa.int64()), ("starts_if_open", pa.int64())]),
        )

    for split, lines in _runs(batches):
        if split != now:
            if now is not None:
                yield row()
            now, odd, starts = split, 0, [0, 0]
        for quotes, blank in zip(*_quotes_and_blank(lines)):
            if not blank:
                starts[odd] += 1
            odd = (odd + quotes) & 1
    if now is not None:
        yield row()


def split_states(lines: DataFrame) -> dict[tuple[str, int], tuple[int, int, bool]]:
    """(1 if the split begins inside quotes, records begun before it, whether a
    later split of the file begins inside quotes right after it) by split."""
    counted = lines.mapInArrow(_parities, "file string, block long, odd int, starts_if_closed long, starts_if_open long")
    rows = counted.limit(MOST_SPLITS + 1).collect()
    if len(rows) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits: load fewer files at a time, or raise spark.sql.files.maxPartitionBytes")
    states: dict[tuple[str, int], tuple[int, int, bool]] = {}
    file, inside, records = None, 0, 0
    for r in sorted(rows, key=lambda r: (r.file, r.block)):
        if r.file != file:
            if inside:
                raise ValueError(f"a quote is not closed in {file}")
            file, inside, records = r.file, 0, 0
        after = (inside + r.odd) & 1
        states[r.file, r.block] = (inside, records, bool(after))
        records += r.starts_if_open if inside else r.starts_if_closed
        inside = after
    if inside:
        raise ValueError(f"a quote is not closed in {file}")
    return states


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the text of each record but the files' headers."""
    lines = _lines(spark, path)
    states = split_states(lines)
    sent = spark.sparkContext.broadcast(states)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(file, number, block, record, whole) of the pieces of records."""
        now, inside, number, open_after, parts, head = None, 0, 0, False, [], False
        out: list[dict] = []

        def close(last: bool) -> None:
            """Ends a piece; ``last``: of its split."""
            nonlocal parts, head
            if parts:
                whole = not head and not (last and open_after)
                out.append({"file": now[0], "number": number, "block": now[1], "record": "\n".join(parts), "whole": whole})
            parts, head = [], False

        def full() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("number", pa.int64()), ("block", pa.int64()), ("record", pa.string()), ("whole", pa.bool_())]))
            out.clear()
            return batch

        for split, lines in _runs(batches):
            if split != now:
                close(True)
                now = split
                inside, number, open_after = sent.value[split]
                head = bool(inside)
            for line, quotes, blank in zip(lines.to_pylist(), *_quotes_and_blank(lines)):
                if inside:
                    parts.append(line)
                elif not blank:
                    close(False)
                    number += 1
                    parts.append(line)
                inside = (inside + quotes) & 1
            if out:
                yield full()
        close(True)
        if out:
            yield full()

    made = lines.mapInArrow(pieces, "file string, number long, block long, record string, whole boolean").where("number > 1")
    crossing = made.where("NOT whole").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts"))
    crossing = crossing.select(F.array_join("parts.record", "\n").alias("record"))
    text = made.where("whole").select("record").unionByName(crossing)
    return text.select(F.when(F.col("record").endswith("\r"), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record")).alias("record"))


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """The table in the CSV file, folder or glob ``path``."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records(spark, path).select(F.from_csv("record", ddl, {**options, "multiLine": "true"}).alias("row")).select("row.*")
