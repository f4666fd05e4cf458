"""The ``opN_*`` queries: each operator with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocation, decontaminate, embdedup, interaction, licenses, linededup, linerules, lmscore, minhash, pii, quality, urlfilter

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
# Words in a host name that mark a bad example.
SEEDS = ["casino", "poker", "betting", "free-bets", "adult", "porn", "xxx", "viagra", "pills", "spam", "ads-track", "warez", "malware", "phishing"]
KEY = "signalloom surrogate key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, by: int):
    """crc32 of an id written as text, modulo ``by``; null ids have none."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), config=minhash.MinHashConfig(words=4))


THIN, RICH = 50, 100  # words of an article below which a page is a bad example, and from which on it is a good one


def labelled_urls(html: bool = False):
    """Examples: a marked host is bad, a page that a rule allows is good; with ``html`` on every host a thin page is bad and one with a real text good."""
    seeded = F.col("host").rlike("(^|[.-])(" + "|".join(SEEDS) + ")([.-]|$)")
    out = F.when(seeded, 1).when(F.col("rule_verdict") == "allow", 0)
    if html:
        words = urlfilter.visible_words(F.col("page.html"))
        out = out.when(words < THIN, 1).when(words >= RICH, 0)
    return out


def judged_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), RULES, labelled_urls(html=True))


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lmscore.score_texts(_table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return out.withColumns({k: F.round(k, 6) for k in ("base_score", "score")})


def deduplicated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_units(_table(spark, sf_dir, "documents"))


def surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(_table(spark, sf_dir, "documents"), KEY).select("doc_id", "text", "n_entities")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train=remainder("doc_id", 5) != 0)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def bpe_tokens(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    out = bpe.encode(_table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def linked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(_table(spark, sf_dir, "documents"))


def filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def ruled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linerules.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines")


QUERIES = {
    "op1_minhash_near_dedup": near_duplicates,
    "op2_url_filters": judged_urls,
    "op3_lm_scoring": lm_scores,
    "op4_substring_dedup": deduplicated_units,
    "op5_pii_surrogates": surrogates,
    "op6_quality_classifier": quality_scores,
    "op7_bpe": bpe_tokens,
    "op8_embedding_near_dedup": linked_vectors,
    "op9_license_scan": license_scan,
    "op10_benchmark_decontamination": benchmark_leaks,
    "op11_phrase_collocation": collocations,
    "op12_filter_interaction": filter_interaction,
    "op13_quality_rules": ruled_documents,
}
