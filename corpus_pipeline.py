"""A corpus-cleaning pipeline of five stages over the ``documents`` table.

Quality classifier (rejected documents go), MinHash near-dedup (one document of each
group stays), benchmark decontamination (documents that hold an item go), surrogates for
personal data, BPE encoding.  Every stage is written as Parquet and read again before
the next one.  The dedup and decontamination stages give every row a key of its own, so
rows with a null or a repeated id are judged by their own text: of equal rows one stays,
and a leak takes no other row of its id with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import bpe, decontaminate, minhash, pii, quality
from signalloom.llm.queries import KEY
from signalloom.llm.workspace import Workspace


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``row, key``: every row with a number that is written once, so it stays the same."""
    return Workspace(spark, "rows").save(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("key")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id stays, rows without one last."""
    keyed = _keyed(spark, docs)
    ranked = F.struct(F.coalesce("row.doc_id", F.lit(2**63 - 1)).alias("id"), "key").alias("doc_id")
    dropped = minhash.near_duplicates(keyed.select(ranked, F.col("row.text").alias("text"))).where("not kept").select("doc_id.key")
    return keyed.join(dropped, "key", "left_anti").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(spark, docs)
    leaks = decontaminate.contaminated(keyed.select("key", "row.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return keyed.join(leaks.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.replace_entities(docs, KEY)
    length = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("minhash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("pii surrogates", without_personal_data),
    ("bpe encoding", tokens),
]

# The classifier, edit distances and merges are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir))
    return docs
