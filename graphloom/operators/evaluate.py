"""Comparing predictions with gold labels, confusion analysis and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.features import label_frequency
from graphloom.operators.lineage import apart
from graphloom.schema import Graphs

RANGES = 64  #: of query ids


def compared(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, node, expected, predicted) of every node to infer of ``gold``."""
    got = predicted.select("query_id", "node", F.col("label").alias("predicted"))
    return gold.where("not given").select("query_id", "node", F.col("label").alias("expected")).join(apart(got), ["query_id", "node"], "left")


def precision(pairs: DataFrame, unknown: str | None = None) -> DataFrame:
    """One row: correct, incorrect, known, error_rate, recall.

    Whatever isn't correct is incorrect, a missing or unknown prediction included; known predictions
    have a label other than the unknown one.  Rates are null where there is nothing to count.
    """
    missing = F.col("predicted").isNull() if unknown is None else F.col("predicted") == unknown
    right = F.coalesce(F.col("expected").eqNullSafe(F.col("predicted")) & ~F.coalesce(missing, F.lit(False)), F.lit(False))
    counts = pairs.agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("incorrect"), F.count_if(~F.coalesce(missing, F.lit(False))).alias("known"))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    total = F.col("correct") + F.col("incorrect")
    return counts.withColumns({"error_rate": F.try_divide("incorrect", total), "recall": F.try_divide("known", total)})


def merged(stats: DataFrame) -> DataFrame:
    """One row from several of :func:`precision`: counts add up, rates follow from the sums."""
    return with_rates(stats.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("correct", "incorrect", "known")]))


def label_errors(pairs: DataFrame) -> DataFrame:
    """(expected, predicted, n) of wrong predictions; a missing one is [none]."""
    wrong = pairs.where(~F.col("expected").eqNullSafe(F.col("predicted")))
    text = [F.coalesce(c, F.lit("[none]")).alias(c) for c in ("expected", "predicted")]
    return wrong.groupBy(*text).agg(F.count("*").alias("n"))


def error_report(errors: DataFrame, top: int | None = 32) -> DataFrame:
    """(value): lines like '      12 : a -> b', most frequent first, ties by the text, descending."""
    said = errors.select("n", F.concat_ws(" -> ", "expected", "predicted").alias("what")).orderBy(F.desc("n"), F.desc("what"))
    said = said.limit(top) if top else said
    return said.select(F.format_string("%8d : %s", "n", "what").alias("value"))


def confusion(graphs: Graphs, found: DataFrame) -> DataFrame:
    """One row: nodes to infer, those that look like another node of their graph with another label,
    and those that look like another with the same label.

    What a node looks like is the bag of its arcs with itself masked.  Signatures are compared within
    a graph by one aggregation, not by pairs.
    """
    mask = lambda here, end: F.when(F.col("node") == F.col(end), F.lit("<X>")).otherwise(F.coalesce(F.col(f"label_{end[-1]}"), F.lit("-1")))
    ends = F.explode(F.array_distinct(F.array("node_a", "node_b"))).alias("node")
    at = found.select("*", ends)
    signed = at.select("query_id", "node", F.concat_ws("|", mask("node", "node_a"), mask("node", "node_b"), F.col("rel")).alias("arc"))
    signatures = signed.groupBy("query_id", "node").agg(F.array_join(F.array_sort(F.collect_set("arc")), ";").alias("signature"))
    open_nodes = graphs.nodes.where("not given").select("query_id", "node", "label").join(signatures, ["query_id", "node"], "left")
    open_nodes = open_nodes.select("query_id", F.coalesce("signature", F.lit("")).alias("signature"), F.coalesce("label", F.lit("-1")).alias("label"))
    same = open_nodes.groupBy("query_id", "signature", "label").agg(F.count("*").alias("n"))
    group = same.groupBy("query_id", "signature").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max("n").alias("most"))
    zero = F.lit(0).cast("long")
    return group.agg(
        F.coalesce(F.sum("n"), zero).alias("nodes"),
        F.coalesce(F.sum(F.when(F.col("labels") > 1, F.col("n")).otherwise(zero)), zero).alias("confusable"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(zero)), zero).alias("alike"),
        F.coalesce(F.sum("most"), zero).alias("best_correct"),
    )


def folds(graphs: Graphs, k: int) -> DataFrame:
    """(query_id, fold): a number from 1 in order of query_id, modulo ``k``.

    The number comes from RANGES ranges of ids, cut at their quantiles, and the sizes of the ranges;
    only those sizes meet in one task.  Any cuts give the same numbers.
    """
    ids = graphs.nodes.select("query_id").distinct()
    cuts = sorted({int(x) for x in ids.approxQuantile("query_id", [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)})
    bucket = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]).cast("array<long>"), lambda c: c <= F.col("query_id")))
    ids = ids.withColumn("bucket", bucket)
    sizes = ids.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("query_id"))
    numbered = ids.withColumn("rn", within).join(before.select("bucket", "before"), "bucket")
    return numbered.select("query_id", F.pmod(F.col("before") + F.col("rn"), F.lit(k)).cast("int").alias("fold"))


def pass_order(graphs: Graphs, passes: int, seed: int = 0, digits: int = 3) -> DataFrame:
    """(query_id, pass, position): every graph once in each pass, in an order that a keyed hash of the pass
    and the graph's id gives, positions from 1.

    Only ids are shuffled; the order is the same whenever and wherever a task runs again.  The first
    ``digits`` of the hash make 16**digits groups that sort apart, and only their sizes meet in a task.
    """
    ids = graphs.nodes.where("query_id is not null").select("query_id").distinct()
    each = ids.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"))
    each = each.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), "pass", "query_id"))).withColumn("bucket", F.substring("key", 1, digits))
    sizes = each.groupBy("pass", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("pass", "bucket").orderBy("key", "query_id"))
    numbered = each.withColumn("rn", within).join(sizes.withColumn("before", before).select("pass", "bucket", "before"), ["pass", "bucket"])
    return numbered.select("query_id", "pass", (F.col("before") + F.col("rn")).alias("position"))


def histogram(values: DataFrame, value: str, most: int) -> DataFrame:
    """(bucket, n, share): values above ``most`` fall into the bucket ``most``."""
    counted = values.select(F.least(F.col(value), F.lit(most)).cast("long").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def frequency(graphs: Graphs) -> DataFrame:
    return label_frequency(graphs.nodes)
