"""CSV / Parquet sources and sinks for the nine marketplace tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercata.schemas import CSV_FILES, SCHEMAS
from mercata.sources.quoted_csv import read_quoted_csv
from mercata.sources.versions import current, read_version, write_version

# Tables whose free-text columns may hold quoted newlines; only these are
# read by mercata.sources.quoted_csv, the others by Spark's CSV reader.
MULTILINE_TABLES = frozenset({"order_reviews"})


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, URI or glob names anything."""
    try:
        return bool(spark.read.format("binaryFile").load(path).schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def child(directory: str, name: str) -> str:
    """``name`` under a folder given as a plain path or a URI."""
    return f"{directory.rstrip('/')}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store its URI names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _require(spark: SparkSession, paths: dict[str, str]) -> None:
    """Raises if a table's file or folder is missing, naming all that are."""
    missing = [f"{table} ({path})" for table, path in paths.items() if not _exists(spark, path)]
    if missing:
        raise FileNotFoundError(f"missing tables: {', '.join(missing)}")


def load_csv(
    spark: SparkSession,
    path: str,
    table: str,
    *,
    mode: str = "FAILFAST",
    multi_line: bool | None = None,
    validate: bool = True,
) -> DataFrame:
    """Read one table's CSV with its declared schema (no inference).

    ``path`` is the CSV file, a glob of files, or a folder holding the table's
    source file (named as in ``schemas.CSV_FILES``) or files of its own.

    Header row, ``"`` as quote and escape (RFC 4180 doubled quotes), an
    unquoted empty field is NULL and a quoted empty field is ``''`` (the
    parser yields NULL for unquoted empties by itself; ``nullValue`` is set
    to a NUL character, which never occurs in text, so that Spark does not
    also turn the quoted empty string into NULL).  A row that does not fit
    the schema aborts the read (``FAILFAST``), like a bulk ``COPY``.  A query
    parses only the columns that it keeps, so ``validate`` (the default) first
    reads all columns of all rows once and raises on a bad value in any.  Load
    CSV once and keep Parquet (:func:`write_tables`) for repeated reads.

    With ``multi_line`` (the default for tables with free text) quoted fields
    may hold newlines; such files are read in parallel too, split by split
    (:mod:`mercata.sources.quoted_csv`).
    """
    schema = SCHEMAS[table]
    if path.endswith("/") or not path.lower().endswith(".csv"):
        inner = child(path, CSV_FILES[table])
        path = inner if _exists(spark, inner) else path
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if multi_line is None:
        multi_line = table in MULTILINE_TABLES
    options = {"mode": mode, "quote": '"', "escape": '"', "nullValue": "\u0000", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    if multi_line:
        rows = read_quoted_csv(spark, path, schema, options)
    else:
        rows = spark.read.schema(schema).options(**options).option("header", True).csv(path)
    if validate:
        rows.agg(*[F.count(f"`{c}`") for c in rows.columns]).collect()
    return rows


def load_marketplace_csv(
    spark: SparkSession, directory: str, files: dict[str, str] | None = None, tables: Iterable[str] | None = None, validate: bool = True
) -> dict[str, DataFrame]:
    """Load the tables' CSV files under ``directory`` (a path or any URI that
    Spark reads); all nine by default, ``tables`` to load fewer.  A missing
    file raises."""
    files = files or CSV_FILES
    paths = {table: child(directory, files[table]) for table in (files if tables is None else tables)}
    _require(spark, paths)
    return {table: load_csv(spark, path, table, validate=validate) for table, path in paths.items()}


def load_marketplace_parquet(spark: SparkSession, directory: str, tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Load the tables written by :func:`write_tables`, in their newest
    finished version, or plain ``<directory>/<table>`` Parquet datasets; all
    nine by default.  A missing one raises."""
    wanted = list(SCHEMAS if tables is None else tables)
    entries = current(spark, directory)
    if entries:
        missing = [f"{table} ({directory})" for table in wanted if table not in entries]
        if missing:
            raise FileNotFoundError(f"missing tables: {', '.join(missing)}")
        return {table: read_version(spark, directory, table, entries) for table in wanted}
    paths = {table: child(directory, table) for table in wanted}
    _require(spark, paths)
    return {table: spark.read.parquet(path) for table, path in paths.items()}


def write_tables(tables: dict[str, DataFrame], directory: str) -> str:
    """Idempotent re-create: the tables become the newest version under
    ``directory``, all at once; a write that fails half way leaves the version
    before it readable (:mod:`mercata.sources.versions`)."""
    return write_version(tables, directory)


# Tables keyed by order: stored in the same number of buckets on order_id,
# their joins and per-order aggregations need no shuffle.
ORDER_KEYED = ("orders", "order_items", "order_payments", "order_reviews")


def write_bucketed_tables(
    spark: SparkSession, tables: dict[str, DataFrame], directory: str, database: str, buckets: int
) -> list[str]:
    """Save the tables as Parquet catalog tables under ``directory``; the
    order-keyed ones bucketed (and sorted) by ``order_id`` into ``buckets``
    buckets, so joins on ``order_id`` and per-order aggregates read
    co-partitioned files instead of shuffling.  Rows are dealt by the bucket
    key first, so each bucket is one file.  Overwrites (idempotent)."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    names = []
    for table, df in tables.items():
        if table in ORDER_KEYED:
            df = df.repartition(buckets, "order_id")
        writer = df.write.mode("overwrite").format("parquet").option("path", child(directory, table))
        if table in ORDER_KEYED:
            writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
        name = f"`{database}`.`{table}`"
        writer.saveAsTable(name)
        names.append(name)
    return names


def load_catalog_tables(spark: SparkSession, database: str, tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The marketplace tables of a catalog database (keeps their bucketing);
    all nine by default.  A missing one raises."""
    wanted = list(SCHEMAS if tables is None else tables)
    missing = [t for t in wanted if not spark.catalog.tableExists(f"{database}.{t}")]
    if missing:
        raise FileNotFoundError(f"missing tables in {database}: {', '.join(missing)}")
    return {table: spark.table(f"`{database}`.`{table}`") for table in wanted}


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Export a (pre-aggregated) report; overwrite keeps re-runs idempotent."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def conform(df: DataFrame, schema: T.StructType, cast_present: bool = True) -> DataFrame:
    """Select ``schema``'s columns in order, adding absent ones as typed
    NULLs.  Present columns are cast to the schema's type unless
    ``cast_present`` is false (then they keep their own type, e.g. numeric
    keys of a fixture)."""
    current = {f.name: f.dataType for f in df.schema.fields}
    exprs = []
    for field in schema.fields:
        target = field.dataType.simpleString()
        if field.name not in current:
            exprs.append(f"CAST(NULL AS {target}) AS `{field.name}`")
        elif current[field.name] == field.dataType or not cast_present:
            exprs.append(f"`{field.name}`")
        else:
            exprs.append(f"CAST(`{field.name}` AS {target}) AS `{field.name}`")
    return df.selectExpr(*exprs)


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Expose the tables as session temp views (``<prefix><table>``), so
    analysts can keep querying them with Spark SQL."""
    names = []
    for table, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{table}")
        names.append(f"{prefix}{table}")
    return names
