"""Graphs as tables for display, and responses as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, GIVEN = "#6c9ba4", "#96816a"  # fixed values: colours of nodes to infer and of given nodes


def graph_nodes(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """(query_id, id, label, color): nodes to infer, and given nodes that have an arc."""
    shown = nodes.join(degree, ["query_id", "node"], "left").where("not given or degree > 0")
    return shown.select("query_id", F.col("node").alias("id"), F.coalesce("label", F.lit("-1")).alias("label"), F.when(F.col("given"), GIVEN).otherwise(OPEN).alias("color"))


def graph_edges(found: DataFrame, pair: DataFrame) -> DataFrame:
    """(query_id, source, target, label): one edge for each two nodes; its label lists the relations
    between them, each with the total weight of the pair."""
    rels = found.groupBy("query_id", F.least("node_a", "node_b").alias("source"), F.greatest("node_a", "node_b").alias("target")).agg(F.array_sort(F.collect_list("rel")).alias("rels"))
    scored = rels.join(pair.withColumnsRenamed({"low": "source", "high": "target"}), ["query_id", "source", "target"])
    text = F.array_join(F.transform("rels", lambda r: F.concat(r, F.lit(" - "), F.format_string("%.2f", F.col("score").cast("double")))), ", ")
    return scored.select("query_id", "source", "target", text.alias("label"))


def infer_response(nodes: DataFrame) -> DataFrame:
    """(query_id, response): JSON arrays of {"v", "giv"} and {"v", "inf"}; nodes without a label are left out."""
    item = F.struct(F.col("node").alias("v"), F.when(F.col("given"), F.col("label")).alias("giv"), F.when(~F.col("given"), F.col("label")).alias("inf"))
    rows = nodes.where("label is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("query_id", F.to_json("items").alias("response"))


def nbest_response(best: DataFrame) -> DataFrame:
    """(query_id, response): JSON arrays of {"v", "candidates"} with scores."""
    one = best.groupBy("query_id", "node").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("cand").alias("label"), "score"))).alias("c"))
    item = F.struct(F.col("node").alias("v"), F.transform("c", lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))).alias("candidates"))
    return one.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items")).select("query_id", F.to_json("items").alias("response"))


def graph_response(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, response): JSON objects {"nodes", "edges"}."""
    n = nodes.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("id", "label", "color"))).alias("nodes"))
    e = edges.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source", "target", "label"))).alias("edges"))
    joined = n.join(e, "query_id", "left")
    empty = F.from_json(F.lit("[]"), "array<struct<source:int,target:int,label:string>>")
    return joined.select("query_id", F.to_json(F.struct("nodes", F.coalesce("edges", empty).alias("edges"))).alias("response"))
