"""The registered queries of this subpackage: each reads its whole table and applies one operator."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.store import small_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.ngram_join import ngram_components

    return ngram_components(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.suffix_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"), length=400)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontaminate import contained_items

    return contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=5, percent=80)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.secret_scan import scan

    return scan(_read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), size=1024)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import toxicity

    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import quality

    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op5_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.collision_ann import nearest_vectors

    return nearest_vectors(_read(spark, sf_dir, "embeddings"), every=100, k=10)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, bytes and byte-level BPE tokens."""
    import public_tokenizers

    from graphloom.llm.store import table_path
    from graphloom.llm.token_rollup import COUNTERS, bpe_count, rollup_documents

    bpe = bpe_count(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return rollup_documents(_read(spark, sf_dir, "documents"), table_path(spark, "rollup"), COUNTERS | {"byte_bpe_50k": bpe})


def rollup_words_and_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 with the tokenizer versions that SQL can count too."""
    from graphloom.llm.store import table_path
    from graphloom.llm.token_rollup import rollup_documents

    return rollup_documents(_read(spark, sf_dir, "documents"), table_path(spark, "rollup"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.license_scan import scan

    return scan(_read(spark, sf_dir, "documents"))


def op11_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every text, a tenth of them with words made periodic by :func:`planted_order`."""
    from graphloom.llm.periodic_runs import periodic_runs

    found = periodic_runs(_read(spark, sf_dir, "documents"), order=planted_order)
    higher = "x.length * best.period > best.length * x.period"
    best = F.expr(f"aggregate(slice(runs, 2, size(runs)), runs[0], (best, x) -> if({higher}, x, best))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, chr(10))), '')")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), listed.alias("listed"), "collapsed").select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word numbers that the contract of op11 reads a document of n words as; None: as it is."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def op12_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, written to token frames and read back."""
    import public_tokenizers

    from graphloom.llm.store import table_path
    from graphloom.llm.token_frames import read_tokens, write_tokens

    docs, path = _read(spark, sf_dir, "documents"), public_tokenizers.path
    files = write_tokens(docs, table_path(spark, "tokens"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    return read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_read(spark, sf_dir, "embeddings"), every=50, label=moved)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}
    return own | {"rollup_words_and_bytes": rollup_words_and_bytes}


def oracle_sql() -> dict[str, str]:
    from graphloom.llm import oracles

    return dict(oracles.SQL)
