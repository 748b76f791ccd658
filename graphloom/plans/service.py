"""Requests as rows: JSON-RPC envelopes are checked, dispatched by method and answered in a batch.

The same functions serve a table of requests and each micro-batch of a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import explain, features as ft, score as sc, search as se
from graphloom.schema import Model
from graphloom.sources import json_graphs as jg

ENVELOPE = "jsonrpc string, method string, params string, id string"
PARAMS = {"query": "ARRAY", "assign": "ARRAY", "n": "BIGINT", "infer": "BOOLEAN", "version": "STRING"}  #: types that a parameter may have
METHODS = ("infer", "nbest", "showgraph")  # fixed values: method names and error codes
ERRORS = {"parse": -32700, "request": -32600, "method": -32601, "params": -32602, "version": -31001}
# fixed values: the messages of protocol 2.0
MESSAGES = {-32700: "Parse error", -32600: "Invalid Request", -32601: "Method not found", -32602: "Invalid params", -31001: "Version mismatch"}


def envelopes(requests: DataFrame, version: str | None = None) -> DataFrame:
    """(request_id, part, id, method, params, code, id_json): each call with the code of its error, or null;
    ``id_json`` is the call's id as it was sent, a number or a string (null: none).

    ``requests`` has request_id and body, a call or an array of calls; ``part`` is a call's place in
    the array (null: no array; an empty array is one bad call).  A call that isn't JSON, isn't an
    object of protocol 2.0 with a method, names an unknown one, lacks parameters or a graph in them,
    has a parameter of another type, or comes from another version is an error.
    """
    json = F.try_parse_json("body")
    many = F.from_json("body", "array<string>")
    calls = requests.select("request_id", "body", F.coalesce(F.schema_of_variant(json), F.lit("")).alias("kind"), json.isNotNull().alias("json"))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("part"), F.col("body").alias("call")))
    each = F.transform(many, lambda c, i: F.struct(i.cast("int").alias("part"), c.alias("call")))
    is_array = F.col("kind").startswith("ARRAY") & (F.size(many) > 0)
    calls = calls.select("request_id", "json", F.explode(F.when(is_array, each).otherwise(whole)).alias("x")).select("request_id", "json", "x.*")
    params = F.get_json_object("call", "$.params")
    rows = calls.select("request_id", "part", "json", F.from_json("call", ENVELOPE).alias("e"), F.from_json(params, jg.SCHEMA).alias("p"), F.try_parse_json("call").alias("v"))
    typed = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.params.{name}", "variant")), F.lit("VOID"))
    wrong = [~(typed(name).startswith(kind) | (typed(name) == "VOID")) for name, kind in PARAMS.items()]
    object_ = F.schema_of_variant("v").startswith("OBJECT")
    code = (
        F.when(~F.col("json"), F.lit(ERRORS["parse"]))
        .when(~F.coalesce(object_, F.lit(False)) | F.col("e.method").isNull() | ~F.coalesce(F.col("e.jsonrpc") == "2.0", F.lit(False)), F.lit(ERRORS["request"]))
        .when(~F.col("e.method").isin(*METHODS), F.lit(ERRORS["method"]))
        .when(F.col("p.query").isNull() | F.col("p.assign").isNull() | ((F.col("e.method") == "nbest") & F.col("p.n").isNull()) | F.greatest(*wrong), F.lit(ERRORS["params"]))
    )
    if version is not None:
        code = code.when(~F.col("p.version").eqNullSafe(version), F.lit(ERRORS["version"]))
    return rows.select("request_id", "part", F.col("e.id").alias("id"), F.col("e.method").alias("method"), F.col("p").alias("params"), code.alias("code"), F.to_json(F.try_variant_get("v", "$.id", "variant")).alias("id_json"))


def respond(requests: DataFrame, model: Model, version: str | None = None, options: se.Options | None = None) -> DataFrame:
    """(request_id, response): JSON-RPC 2.0 replies, an array of them for an array of calls; calls without
    an id are notifications and get none."""
    seen = envelopes(requests, version).withColumn("query_id", F.xxhash64("request_id", F.coalesce("part", F.lit(-1))))
    good = seen.where("code is null")
    asked = good.select("query_id", "method", "params.*")
    graphs = ft.known_relations(jg.tables(asked.select("query_id", "query", "assign")), model)
    start = asked.select("query_id", "method", F.coalesce("infer", F.col("method") == "infer").alias("infer"), "n")
    solved = se.infer(graphs.only(start.where("infer").select("query_id")), model, options)
    kept = graphs.nodes.join(start.where("infer").select("query_id"), "query_id", "left_anti")
    graphs = graphs.with_nodes(solved.unionByName(kept))
    of = lambda m: graphs.only(start.where(F.col("method") == m).select("query_id"))
    replies = explain.infer_response(of("infer").nodes)
    g = of("nbest")
    best = sc.n_best(sc.adjacency(ft.instances(g)), ft.factor_instances(g), model, -1)
    best = best.join(start.select("query_id", "n"), "query_id").where("n < 0 or rank <= n").drop("n")
    g2 = of("showgraph")
    found = ft.instances(g2)
    shown = explain.graph_response(explain.graph_nodes(g2.nodes, sc.degrees(sc.adjacency(found))), explain.graph_edges(found, sc.pair_scores(found, model.pairs)))
    replies = replies.unionByName(explain.nbest_response(best)).unionByName(shown)
    joined = seen.join(replies, "query_id", "left")
    sent = F.concat(F.lit(',"id":'), F.coalesce("id_json", F.lit("null")), F.lit("}"))
    result = F.concat(F.lit('{"jsonrpc":"2.0","result":'), F.coalesce("response", F.lit("[]")), sent)
    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[F.col("code")]
    error = F.concat(F.lit('{"jsonrpc":"2.0","error":'), F.to_json(F.struct("code", message.alias("message"))), sent)
    said = joined.where("id_json is not null or code is not null").select("request_id", "part", F.when(F.col("code").isNull(), result).otherwise(error).alias("response"))
    one = said.where("part is null").select("request_id", "response")
    many = said.where("part is not null").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("part", "response"))).alias("all"))
    return one.unionByName(many.select("request_id", F.concat(F.lit("["), F.array_join("all.response", ","), F.lit("]")).alias("response")))
