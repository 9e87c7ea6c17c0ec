"""The registered queries of this subpackage: each operator over whole tables, with production parameters."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import langid, secrets
from pageloom.llm.binpack import shard_by_size
from pageloom.llm.codes import compress, digest
from pageloom.llm.decontaminate import decontaminate
from pageloom.llm.fingerprints import fingerprint_edits
from pageloom.llm.licenses import known_licenses, scan_licenses
from pageloom.llm.linededup import dedup_lines
from pageloom.llm.neardup import jaccard_join
from pageloom.llm.packing import pack
from pageloom.llm.runs import periodic_runs
from pageloom.llm.shards import read_by_key, write_shards
from pageloom.llm.substrings import remove_repeats
from pageloom.llm.sql import CODES_SQL, DECONTAMINATION_SQL, LICENSES_SQL
from pageloom.session import shared_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.learn(docs.filter(~langid.held_out("doc_id")))
    return langid.identify(docs, model).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), TOKENIZER, keep=F.crc32).withColumnRenamed("ids", "ids_crc32")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_documents(spark, sf_dir), known_licenses(spark))
    return found.select("doc_id", "digest", F.array_join("whole_licenses", ",").alias("whole_licenses"), "n_matches", F.array_join("licenses", ",").alias("licenses"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = os.path.join(shared_dir(spark), "shards", uuid.uuid4().hex)
    docs = _documents(spark, sf_dir)
    write_shards(docs, folder, TOKENIZER)
    return read_by_key(docs, folder, keep=F.crc32).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.col("ids").alias("ids_crc32"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_documents(spark, sf_dir)).drop("text_hash")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(_documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = secrets.scan_secrets(docs, secrets.learn(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(findings: Column | str) -> Column:
        return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    base = F.filter("findings", lambda f: f["kind"] != "network")
    return found.select("doc_id", *[count(kind) for kind in secrets.KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined("findings").alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2("text", 256).alias("text_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # In one document of ten the words from number a on repeat the p that stand there.
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("words")
    a = F.when(n > 0, g % n)
    p = F.when(n > 0, 1 + F.floor((n - a) / (3 + g % 8)))
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"))
    docs = docs.select("doc_id", "text", "words", a.cast("int").alias("a"), p.cast("int").alias("p"))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    found = periodic_runs(docs.select("doc_id", F.when(F.size("words") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text")))
    # The longest run, of those the first, of those the one with the shortest period.
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("q")))
    longest = F.array_min(order)
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return found.withColumn("w", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("w.s").alias("start"), (-F.col("w.n")).alias("length"), F.col("w.q").alias("period"),
        F.floor(-1000 * F.col("w.n") / F.col("w.q")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_by_size(_documents(spark, sf_dir), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


LLM_QUERIES = {
    f.__name__: f for f in (
        op1_language_id, op2_best_fit_packing, op3_license_scan, op4_token_shards, op5_jaccard_join, op6_winnowing, op7_suffix_array_dedup,
        op8_document_fingerprints, op9_secret_scan, op10_line_dedup, op11_periodic_runs,
        op12_balanced_shards, op13_vector_codes)
} | {"pipeline": corpus_pipeline.run}

LLM_ORACLES = {"op3_license_scan": LICENSES_SQL, "op6_winnowing": DECONTAMINATION_SQL, "op13_vector_codes": CODES_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    LLM_ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
