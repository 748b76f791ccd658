"""Counts and candidate ranks that batches of added and withdrawn graphs revise, without a count of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import features as ft

KEY = ["label_a", "label_b", "rel"]


def signed_counts(added: DataFrame | None, withdrawn: DataFrame | None) -> DataFrame:
    """(label_a, label_b, rel, n): what a batch of arcs (:func:`graphloom.operators.features.instances`)
    adds to the counts less what it takes from them; features that it leaves as they are have no row."""
    if added is None and withdrawn is None:
        raise ValueError("a batch adds arcs, withdraws arcs, or both")
    parts = [ft.pair_counts(arcs).withColumn("n", sign * F.col("n")) for arcs, sign in ((added, 1), (withdrawn, -1)) if arcs is not None]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy(*KEY).agg(F.sum("n").alias("n"))
    return both.where("n <> 0")


def revised_counts(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """The counts after a batch.  A count below zero is of a graph withdrawn before it was added and stays,
    so batches may come in any order; ranks pass over it."""
    return counts.select(*KEY, "n").unionByName(delta.select(*KEY, "n")).groupBy(*KEY).agg(F.sum("n").alias("n")).where("n <> 0")


def revised_candidates(index: DataFrame, revised: DataFrame, delta: DataFrame, beam: int = ft.BEAM) -> DataFrame:
    """:func:`graphloom.operators.features.candidates_by_b` of ``revised``, from the ``index`` (ctx, rel, cand, n, rn)
    of the counts before ``delta`` at the same ``beam``.

    Contexts that the batch doesn't touch keep their rows.  In a touched one the old rows and the features of
    the batch are ranked by their new counts.  Unranked features that the batch left alone stay below the
    old last rank; where fewer than ``beam`` rows reach that rank, one of them may move up, and only
    these contexts are ranked again from all counts.
    """
    changed = delta.select(F.col("label_b").alias("ctx"), "rel", F.col("label_a").alias("cand"))
    touched = changed.select("ctx", "rel").distinct()
    old = index.join(touched, ["ctx", "rel"], "left_semi")
    last = old.groupBy("ctx", "rel").agg(F.count("*").alias("held"), F.min(F.struct("n", "cand")).alias("last"))
    now = revised.where("n > 0").select(F.col("label_b").alias("ctx"), "rel", F.col("label_a").alias("cand"), "n")
    known = now.join(old.select("ctx", "rel", "cand").unionByName(changed).distinct(), ["ctx", "rel", "cand"], "left_semi")
    reached = known.join(last, ["ctx", "rel"]).groupBy("ctx", "rel").agg(F.count_if(F.struct("n", "cand") >= F.col("last")).alias("sure"))
    short = last.where(F.col("held") >= beam).join(reached, ["ctx", "rel"], "left").where(F.coalesce("sure", F.lit(0)) < beam).select("ctx", "rel")
    rows = known.join(short, ["ctx", "rel"], "left_anti").unionByName(now.join(short, ["ctx", "rel"], "left_semi"))
    again = ft.candidates_by_b(rows.select(F.col("cand").alias("label_a"), F.col("ctx").alias("label_b"), "rel", "n"), beam, "n")
    return index.join(touched, ["ctx", "rel"], "left_anti").select(*again.columns).unionByName(again)
