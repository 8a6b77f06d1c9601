"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on everything that its predecessor kept.  All but
the last return the columns of ``documents``.  Rows of one doc_id and one text are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltrace.llm.bpe import bpe_decode, bpe_encode, vocabulary
from siltrace.llm.minhash_dedup import near_duplicates
from siltrace.llm.mixing import drawn, mix_to_targets
from siltrace.llm.quality_rules import quality_filter
from siltrace.llm.storage import written
from siltrace.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the boilerplate lines of their host.

    Copies of a text count once among their host's documents, as the next stage is to keep one of them."""
    return quality_filter(docs.select(*COLUMNS), copies_once=True).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the smallest doc_id; five-word shingles, similarity 0.8 or more."""
    kept = near_duplicates(docs, shingle=5, threshold=80).filter("kept").select("doc_id").distinct()
    rows = docs.select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return rows.join(kept, rows["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a smaller doc_id holds too; others keep their layout."""
    out = substring_dedup(docs, carry=("lang", "source"), keep_layout=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at their fitted rates, of which those above 1 give copies; as many good tokens as there are."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = written(mix_to_targets(docs, labels, passes=1.0).select("doc_id", "text_key", "rate"), "rates")
    return drawn(docs, rates)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text."""
    path = vocabulary()
    out = bpe_decode(bpe_encode(docs, path), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", repeats),
    ("mixing", mixing),
    ("bpe", encoding),
]

ORACLE_SQL = None  # a trained classifier and fitted rates have no SQL: tested against a brute-force version instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as a table and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
