"""A corpus pipeline: quality classifier, line rules, line dedup, near-duplicates, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``documents``.  ``run`` writes each stage's rows
as Parquet to shared storage and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm import cpsjoin, linejoin, linerules, packing, qda, registry, storage

#: Encoding by a tokenizer, trained scores and breadth-first links are not SQL.
ORACLE_SQL = None


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of documents, with another text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return docs.select(*(new[c].alias(c) if c in new else F.col(c) for c in columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text the discriminant takes for quality 1, whatever their id."""
    labels = registry.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return qda.accepted(docs, labels)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without their failing lines."""
    return _with_text(linerules.clean(docs).where("kept"), docs.columns, "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line of the corpus repeats; those with nothing left go."""
    left = linejoin.dedup(docs).where(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return _with_text(left, docs.columns, "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shares four fifths of its five-word shingles.

    Rows of one id are judged each by its own text; a row with a null id stays.
    """
    gone = cpsjoin.near_duplicates(docs, k=5, percent=80).where("NOT kept")
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(gone, same, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of what is left."""
    pieces = packing.pack_documents(docs, registry.tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows are not written."""
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
