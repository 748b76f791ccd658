"""A training corpus from raw documents: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents.  All but the last return the columns of ``documents``; each
works on all that its predecessor kept and its decisions take effect.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, ngram_join, packing, quality, secret_scan
from graphloom.llm.store import materialise, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.  It learns from the labels of the input."""
    labels = small_batches(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles the document
    with the smallest doc_id stays.  Rows that repeat a doc_id and a text collapse into the first by their
    other columns; unlike texts of one doc_id are one document and stay or go together.  Rows without a
    doc_id can't be told apart and stay."""
    found = materialise(ngram_join.ngram_components(docs, k=5, percent=80), "groups")
    heads = materialise(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times")), "heads")
    kept = docs.join(heads.select("doc_id"), "doc_id", "left_semi")
    if not heads.where("times > 1").isEmpty():
        rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")))
        first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(rest))
        turn = "turn_" + "_".join(docs.columns)  # a name that no column has
        kept = kept.withColumn(turn, first).where(F.col(f"`{turn}`") == 1).drop(turn)
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths or more of a test item's five-word shingles go.  Texts are told
    apart by a hash, so a row goes or stays by its own text, whatever its doc_id, null or repeated."""
    items = small_batches(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.xxhash64(F.col("text"))
    found = decontaminate.contained_items(docs.select(key.alias("doc_id"), "text"), items, k=5, percent=80)
    leaks = materialise(found.select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    return docs.join(leaks, key == F.col("leak"), "left_anti").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays.  n_chars follows the text."""
    clean = secret_scan.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), size=1024)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", without_benchmarks),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: The first and the last stage can't be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
