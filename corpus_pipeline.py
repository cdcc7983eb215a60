"""A corpus pipeline of five of the operators; each stage reads what the one before it kept, written as Parquet.

All stages but the last return the columns of documents. Stages that decide on documents do so for each row, so that
rows without doc_id, rows that share one, and repeated rows are documents of their own; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import jaccard, mixing, packing, quality, secrets
from winnow.llm.common import discard, materialise, table
from winnow.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality; those of null doc_id and equal rows are judged by text."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs, its columns in a struct, with _row, a number of each row's own, written so that it stays."""
    return materialise(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "numbered")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id, null last, of each group that shares four fifths of its five-word shingles.

    Of rows with one doc_id that are in one group one stays.
    """
    rows = numbered(docs)
    found = jaccard.jaccard_components(rows.select(F.col("_row").alias("doc_id"), "_doc.text"), n=5, num=8, den=10).select(F.col("doc_id").alias("_id"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row")))["_row"].alias("_id")
    kept = rows.select("_doc.doc_id", "_row").join(found, F.col("_row") == F.col("_id")).groupBy("component_id").agg(first)
    return rows.join(kept.select("_id"), F.col("_row") == F.col("_id"), "left_semi").select("_doc.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark and n_chars counted anew."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: a row for each time."""
    rows = numbered(docs)
    taken = mixing.mix(rows.select(F.col("_row").alias("doc_id"), "_doc.source", "_doc.text")).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias("_id"), (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    many = rows.join(taken, F.col("_row") == F.col("_id"))
    return many.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 4096 tokens."""
    return packing.packed(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the hashes that shuffle and the tokenizer have no SQL; tests/llm compares with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if i:
            discard(before)
    return docs
