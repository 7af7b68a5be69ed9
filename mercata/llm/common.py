"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mercata.session import checkpoint_dir

#: The words of a text: runs of anything but ASCII space and \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on the driver, which sends its content
    to the tasks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: lineage ends there, later jobs read what earlier ones made, and a
    lost executor costs only a re-read.

    The folder is ``spark.checkpoint.dir`` of the session; only a local
    session without one (tests) gets a temporary folder of its own.
    """
    spark = df.sparkSession
    root = checkpoint_dir(spark, create_if_unset=True)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root}/mercata-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
