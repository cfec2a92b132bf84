"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

All stages but the last return the columns of documents; the last returns packed token pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import decontaminate, language, line_dedup, ngram_join, packing
from dossier.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter) go; the others' lang becomes the one found in their text."""
    found = language.with_language(docs.select(*COLUMNS), language.learned(docs))
    return found.filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for the smallest document's; so do documents of which nothing else was left."""
    out = line_dedup.LineStore(spark).insert(docs).deduplicated(docs.select(*COLUMNS))
    left = out.filter((F.col("n_dropped") == 0) | F.col("kept").rlike(r"\S"))
    return left.withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the one with the smallest id stays."""
    kept = ngram_join.jaccard_components(docs, n=5, percent=80).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).filter("doc_id is null").unionByName(docs.select(*COLUMNS).join(kept, "doc_id", "left_semi"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.filter("not contaminated").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, packing.default_tokenizer())


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]
#: Language inference and packing have no SQL form: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
