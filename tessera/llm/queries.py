"""The registered queries of this folder: thin applications of the operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, html, licenses, media, oracles, packing, quality, resampling, simhash, substrings, token_counts, toxicity, vectors
from .common import table

#: The tokenizers' files, a parameter of the operators.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, 4096, 1)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(table(spark, sf_dir, "documents"), BYTE_BPE, bpe.digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(token_counts.histogram(table(spark, sf_dir, "documents"), BYTE_BPE))


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's categories: what the labels call poor quality, then what they call toxic."""
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), toxicity_labels(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("rule")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/language/thousand/id.txt; those that begin by speaking of licences count as licence files.

    None has the name of one, so every document's own licence holds for its directory.
    """
    documents = table(spark, sf_dir, "documents")
    thousand = F.floor(F.col("doc_id") / 1000).cast("string")
    files = documents.select("doc_id", F.concat_ws("/", "source", "lang", thousand, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    return licenses.scan(files, license_file=F.split("text", "\n")[0].rlike(licenses.MENTIONS), grants=F.lit(True))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), substrings.digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vectors.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vectors.books_digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_bpe_roundtrip": op3_bpe_roundtrip,
    "op4_media_tiff": op4_media_tiff,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extraction": op8_html_extraction,
    "op9_license_scan": op9_license_scan,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_target_resampling": op11_target_resampling,
    "op12_decontamination": op12_decontamination,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {
    "op7_quality_rules": oracles.QUALITY,
    "op9_license_scan": oracles.licenses_sql(),
    "op10_suffix_array_dedup": oracles.REPEATS,
    "op11_target_resampling": oracles.RESAMPLING,
    "op12_decontamination": oracles.CONTAMINATION,
    "op13_vector_codes": oracles.vector_codes_sql(),
}
