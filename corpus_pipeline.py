"""Corpus pipeline: language ID, exact dedup, near-dedup, mixing, encoding.

Each stage calls one operator of ``mercata.llm`` on all documents that the
stage before it kept.  All but the last return the columns of documents;
``run`` writes each result as Parquet in the shared checkpoint folder and
reads it again.

Edge cases: documents with NULL, empty or letterless text are rejected by
language ID.  Rows that repeat doc_id and text (A-Z in lower case) are left
once by exact dedup.  Exact dedup and mixing decide on rows, so rows that
share a doc_id, or have none, may fare differently.  Near-dedup decides on
doc_ids, as its operator does: rows of one doc_id are one document, and rows
without doc_id all stay.  If no document has a language label, nothing can
be learned and all documents are rejected.  Documents that mixing repeats are
repeated rows.  Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercata.llm.bpe import encode_and_decode
from mercata.llm.common import cut, free_names, read_table, tokenizer_path
from mercata.llm.exact_dedup import exact_dedup, with_digest
from mercata.llm.language_id import keep_known, learn
from mercata.llm.mixing import mix
from mercata.llm.near_dedup import near_dedup

#: A language must have at least this share against the others.
LEAST_SCORE = 0.5


def keep_documents(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``kept`` (NULL is an id too)."""
    (kept_id,) = free_names(docs, "kept_id")
    ids = kept.select(F.col("doc_id").cast("long").alias(kept_id)).distinct()
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach."""
    return keep_known(docs, learn(docs), LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    digest, kept_id, kept_digest = free_names(docs, "row_digest", "kept_id", "kept_digest")
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest))
    return with_digest(docs, digest).join(kept, same, "left_semi").dropDuplicates([digest]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the document with the smallest doc_id."""
    return keep_documents(docs, near_dedup(docs).where("kept"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words; the one at a
    source's cut stays if at least half of its words are taken."""
    row, mix_row, times = free_names(docs, "mix_row", "mix_row_", "mix_times")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))  # written, so that a row keeps its number
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    taken = mix(numbered, carry=[row]).where("size > 0").select(F.col(row).alias(mix_row), copies.alias(times)).where(F.col(times) > 0)
    rows = numbered.join(taken, F.col(row) == F.col(mix_row))
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with the digests of ids and decoded text."""
    return encode_and_decode(docs, tokenizer_path("byte_bpe_50k.json"), ids=True, decoded=False)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix_sources", mixture),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: None: neither language ID nor BPE can be said in SQL; tests hold the result
#: against a brute-force version.
ORACLE_SQL = None
