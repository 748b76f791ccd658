"""Graphs as JSON lines, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import Graphs

SCHEMA = "query array<struct<a:string,b:string,f2:string,cn:string,n:array<string>,group:array<string>>>, assign array<struct<v:string,inf:string,giv:string>>, n int, infer boolean, version string"


def read_lines(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """(query_id, value) of non-empty lines, or of whole files; compressed files by their ending.

    query_id tells the records of one read apart: it is a record's place in the files' partitions, so
    equal lines are different records.
    """
    return spark.read.text(path, wholetext=whole_file).where("value <> ''").select(F.monotonically_increasing_id().alias("query_id"), "value")


def parse(lines: DataFrame, value: str = "value", query_id: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(queries, rejected): parsed graphs with their query_id, and the lines that aren't graphs."""
    parsed = lines.select(F.col(query_id).cast("long").alias("query_id"), F.col(value).alias("line"), F.from_json(value, SCHEMA).alias("j"))
    good = F.col("j.query").isNotNull() & F.col("j.assign").isNotNull()
    return parsed.where(good).select("query_id", "j.*"), parsed.where(~good | F.col("j").isNull()).select("query_id", "line")


def tables(queries: DataFrame, unreferenced_to_zero: bool = False) -> Graphs:
    """Normalised tables.  Nodes are numbered from 0 in order of their first mention in ``query``.

    An element may hold an arc, a scope and a factor at once.  Of several assignments of a node the
    last counts.  Assignments of nodes that no element mentions are dropped; with
    ``unreferenced_to_zero`` they overwrite node 0.
    """
    pick = lambda e: F.concat(
        F.when(e["f2"].isNotNull(), F.array(e["a"], e["b"])).otherwise(F.array().cast("array<string>")),
        F.when(e["cn"].isNotNull(), F.coalesce(e["n"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
        F.coalesce(e["group"], F.array().cast("array<string>")),
    )
    order = F.filter(F.array_distinct(F.flatten(F.transform("query", pick))), lambda x: x.isNotNull())
    q = queries.select("query_id", "query", "assign", order.alias("ids"))
    place = lambda x: (F.array_position(F.col("ids"), x) - 1).cast("int")
    arcs = q.select("query_id", "ids", F.explode("query").alias("e")).where("e.f2 is not null and e.a is not null and e.b is not null")
    arcs = arcs.select("query_id", place(F.col("e.a")).alias("node_a"), place(F.col("e.b")).alias("node_b"), F.col("e.f2").alias("rel"))
    part = lambda f, has: q.select("query_id", "ids", F.posexplode("query").alias("i", "e")).where(has).select("query_id", F.col("i").alias("id"), F.transform(F.filter(F.array_distinct(f), lambda x: x.isNotNull()), place).alias("nodes"))
    scopes = part(F.col("e.n"), "e.cn is not null and e.n is not null").select("query_id", F.col("id").alias("scope_id"), F.explode("nodes").alias("node"))
    factors = part(F.col("e.group"), "e.group is not null").select("query_id", F.col("id").alias("factor_id"), "nodes")
    said = q.select("query_id", "ids", F.posexplode("assign").alias("i", "x"))
    number = place(F.col("x.v"))
    node = F.when(number < 0, F.lit(0)).otherwise(number) if unreferenced_to_zero else F.when(number >= 0, number)
    said = said.select("query_id", node.alias("node"), "i", F.coalesce("x.giv", "x.inf").alias("label"), F.col("x.giv").isNotNull().alias("given"))
    last = said.where("node is not null and label is not null").groupBy("query_id", "node").agg(F.max_by(F.struct("label", "given"), "i").alias("x"))
    return Graphs(last.select("query_id", "node", "x.label", "x.given"), arcs, scopes, factors)


def lines(graphs: Graphs) -> DataFrame:
    """(query_id, value): the JSON line of each graph, the inverse of :func:`tables`."""
    text = lambda c: F.col(c).cast("string")
    arc = graphs.arcs.select("query_id", F.struct(F.lit(0).alias("k"), text("node_a").alias("a"), text("node_b").alias("b"), F.col("rel").alias("f2"), F.lit(None).cast("string").alias("cn"), F.lit(None).cast("array<string>").alias("n"), F.lit(None).cast("array<string>").alias("group")).alias("e"))
    scope = graphs.scopes.groupBy("query_id", "scope_id").agg(F.array_sort(F.collect_set("node")).cast("array<string>").alias("members"))
    null = F.lit(None).cast("string")
    scope = scope.select("query_id", F.struct(F.lit(1).alias("k"), null.alias("a"), null.alias("b"), null.alias("f2"), F.lit("!=").alias("cn"), F.col("members").alias("n"), F.lit(None).cast("array<string>").alias("group")).alias("e"))
    factor = graphs.factors.select("query_id", F.struct(F.lit(2).alias("k"), null.alias("a"), null.alias("b"), null.alias("f2"), null.alias("cn"), F.lit(None).cast("array<string>").alias("n"), F.col("nodes").cast("array<string>").alias("group")).alias("e"))
    elements = arc.unionByName(scope).unionByName(factor).groupBy("query_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    elements = elements.select("query_id", F.transform("es", lambda e: e.dropFields("k")).alias("query"))
    item = F.struct(text("node").alias("v"), F.when(~F.col("given"), F.col("label")).alias("inf"), F.when(F.col("given"), F.col("label")).alias("giv"))
    assigned = graphs.nodes.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("assign"))
    return elements.join(assigned, "query_id").select("query_id", F.to_json(F.struct("query", "assign")).alias("value"))
