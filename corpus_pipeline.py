"""From raw documents to packed training sequences, stage by stage.

Each stage reads what its predecessor kept, written as Parquet in between, and
returns the columns of documents, the last one the pieces of its sequences.
A document is known by its ``doc_id``; rows repeated with the same text are one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm import langid
from pageloom.llm.decontaminate import decontaminate
from pageloom.llm.linededup import dedup_lines
from pageloom.llm.neardup import jaccard_join
from pageloom.llm.packing import pack
from pageloom.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``lang`` names; those without letters or in none of them go."""
    return langid.keep_known(docs, langid.learn(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that stand elsewhere before; those left without a character go."""
    kept = dedup_lines(docs, report=False)
    return kept.filter(F.col("text").isNull() | (F.col("text") != ""))


def _by_text(docs: DataFrame, verdicts: DataFrame, how: str) -> DataFrame:
    """A join of documents with verdicts on them (``doc_id``, ``text_hash``)."""
    named = verdicts.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")).distinct()
    mine = docs.alias("docs").hint("merge")  # verdicts grow with the documents
    same = F.col("docs.doc_id").eqNullSafe(F.col("named.of_doc")) & (F.xxhash64(F.coalesce("docs.text", F.lit(""))) == F.col("named.of_text"))
    return mine.join(named.alias("named"), same, how)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike, directly or through others, the one with the smallest ``doc_id``."""
    stays = jaccard_join(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    joined = _by_text(docs, stays, "inner")
    # Repeated rows of one document: the join has brought them together already.
    number = F.row_number().over(Window.partitionBy("named.of_doc", "named.of_text").orderBy(F.lit(1)))
    return joined.select(F.col("docs.*"), number.alias("__row")).filter("__row = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _by_text(docs, found.filter("contaminated"), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=F.crc32).withColumnRenamed("ids", "ids_crc32")


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("packing", packing)]

# SQL has neither the n-gram model, the tokenizer nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
