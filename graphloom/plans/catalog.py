"""Registered queries of the engine, each over its whole corpus, and the SQL of the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import labels as lb
from graphloom.functions import strings as st
from graphloom.operators import evaluate as ev
from graphloom.operators import explain as ex
from graphloom.operators import features as ft
from graphloom.operators import learn as le
from graphloom.operators import maintained as mt
from graphloom.operators import moves as mv
from graphloom.operators import online as on
from graphloom.operators import score as sc
from graphloom.operators import search as se
from graphloom.operators.lineage import by_graph, cut, shared_dir
from graphloom.plans import catalog_sql, service
from graphloom.schema import Model
from graphloom.sources import corpora as co
from graphloom.sources import dictionaries
from graphloom.sources import json_graphs as jg

RULES = [lb.Rule(True, ".+"), lb.Rule(False, "Brand#1.*"), lb.Rule(True, "Brand#13"), lb.Rule(False, "R"), lb.Rule(False, r"[0-9]-.*")]


def _orders(spark: SparkSession, sf_dir: str, keep: bool = True):
    """The orders graph and its arcs; not kept for a query that reads it once."""
    g = co.orders_graph(spark, sf_dir, keep)
    return g, ft.instances(g)


def _whole(model: Model) -> Model:
    """Counts as whole numbers, which both engines print alike, written once: a small model then has a known size, and
    corpora aren't shuffled to meet it."""
    return le.settled(Model(model.pairs.withColumn("weight", F.col("weight").cast("long")), model.factors.withColumn("weight", F.col("weight").cast("long")), model.label_freq))


def pair_feature_counts(spark, d):
    return ft.pair_counts(_orders(spark, d, False)[1])


def factor_feature_counts(spark, d):
    return ft.factor_counts(ft.factor_instances(co.orders_graph(spark, d))).select(F.array_join("labels", "|").alias("labels"), "n")


def label_frequency(spark, d):
    return ft.label_frequency(co.orders_graph(spark, d).nodes)


def rare_label_collapse(spark, d):
    g, found = _orders(spark, d)
    freq = cut(ft.label_frequency(g.nodes))
    least = int(freq.agg(F.percentile("n_queries", 0.5)).first()[0] or 0)
    return ft.collapse_rare(ft.pair_counts(found), freq, least, "<unknown>", "n")


def unknown_labels(spark, d):
    """Nodes to infer under the dictionary of labels that stand in more orders than the median label."""
    g = co.parts_graph(spark, d)
    freq = ft.label_frequency(g.nodes)
    least = int(freq.agg(F.percentile("n_queries", 0.5)).first()[0] or 0)
    return ft.replace_unknown(g.nodes.where("not given"), freq.where(F.col("n_queries") > least), "<unknown>").groupBy("label").agg(F.count("*").alias("n"))


def valid_labels(spark, d):
    return lb.valid_labels(ft.label_frequency(co.orders_graph(spark, d).nodes), RULES)


def dictionary(spark, d):
    g = co.orders_graph(spark, d)
    return lb.dictionary(g.nodes.select("label"), g.arcs.select(F.col("rel").alias("label")))


def growing_dictionary(spark, d):
    """Ids after the labels of nodes, and then those of relations and part names, were committed, one of the
    batches twice."""
    g, path = co.orders_graph(spark, d), f"{shared_dir(spark).rstrip('/')}/graphloom-dictionary-{uuid.uuid4().hex}"
    more = g.arcs.select(F.col("rel").alias("label")).unionByName(co.parts_graph(spark, d).nodes.select("label"))
    for batch, labels in (("1", g.nodes), ("2", more), ("1", more)):
        dictionaries.commit(labels.select("label"), path, batch)
    return dictionaries.load(spark, path)


def _ranked(rank, beam):
    return lambda spark, d: rank(ft.pair_counts(_orders(spark, d, False)[1]), beam, "n").withColumn("rn", F.col("rn").cast("long"))


def factor_candidates(spark, d):
    groups = ft.factor_instances(co.orders_graph(spark, d, keep=True))
    found = ft.factor_candidates(groups, cut(ft.factor_counts(groups)), 3, "n")
    return found.select("query_id", "factor_id", F.array_join("labels", "|").alias("labels"), "n", F.col("rn").cast("long").alias("rn"))


def total_score(spark, d):
    _, found = _orders(spark, d)
    return sc.total_scores(found, cut(ft.pair_counts(found)), "n")


def node_score(spark, d):
    g, found = _orders(spark, d)
    model = _whole(ft.count_model(g))
    return sc.node_scores(g.nodes, sc.adjacency(found), ft.factor_instances(g), model)


def pair_score(spark, d):
    _, found = _orders(spark, d)
    return sc.pair_scores(found, cut(ft.pair_counts(found)), "n")


def nbest(spark, d):
    g, found = _orders(spark, d)
    best = sc.n_best(sc.adjacency(found), ft.factor_instances(g), _whole(ft.count_model(g)), 3)
    return best.withColumn("rank", F.col("rank").cast("long"))


def nbest_valid(spark, d):
    g, found = _orders(spark, d)
    valid = cut(lb.valid_labels(ft.label_frequency(g.nodes), RULES).where("valid"))
    return sc.n_best(sc.adjacency(found), ft.factor_instances(g), _whole(ft.count_model(g)), 1, valid).select("query_id", "node", "cand", "score")


def node_degree(spark, d):
    g = co.session_graph(spark, d)
    return sc.degrees(sc.adjacency(ft.instances(g)))


def arc_pass_eligible(spark, d):
    """Arcs of orders whose ends have at most five distinct arcs."""
    _, found = _orders(spark, d)
    return sc.arc_pass_eligible(found, sc.degrees(sc.adjacency(found)), 5)


def known_relation_degree(spark, d):
    """Degrees in sessions under a model of arcs between given nodes, which knows no hub arcs."""
    g = co.session_graph(spark, d)
    pairs = ft.pair_counts(ft.instances(g).where("given_a and given_b")).withColumnRenamed("n", "weight")
    model = Model(pairs, pairs.where("false"), ft.label_frequency(g.nodes))
    return sc.degrees(sc.adjacency(ft.instances(ft.known_relations(g, model))))


def train_pl(spark, d):
    """Weights after two pseudo-likelihood passes whose rate falls with the root of the pass."""
    g, _, model = _pl(spark, d)
    rate = 0.01 / max(1, g.nodes.select("query_id").distinct().count())
    return le.train_pl(g, model, 2, rate, 0.0, "prop_sqrt_pass").pairs.select("label_a", "label_b", "rel", F.round("weight", 6).alias("weight"))


def train_ssvm(spark, d):
    """The log of three max-margin passes over the dialogs."""
    g = co.dialog_graph(spark, d, keep=True)
    _, log = le.train_ssvm(g, le.initial_weights(ft.count_model(g)), passes=3)
    return spark.createDataFrame([(x["pass"], x["rate"], x["correct"], x["incorrect"]) for x in log], "pass int, rate double, correct long, incorrect long")


def train_pl_ssvm(spark, d):
    """Weights of a pseudo-likelihood pass and two max-margin passes over the dialogs."""
    g = co.dialog_graph(spark, d, keep=True)
    return le.train_pl_ssvm(g, le.initial_weights(ft.count_model(g)), pl_passes=1, passes=2)[0].pairs


def online_pass(spark, d):
    """Weights after a max-margin pass that learns the dialogs one after another."""
    g = co.dialog_graph(spark, d)
    return on.online_pass(g, le.initial_weights(ft.count_model(g)), 0.1)[0].pairs


def cross_validation(spark, d):
    """Pooled statistics of three folds of dialogs, each predicted under the counts of the others."""
    return le.cross_validate(co.dialog_graph(spark, d), 3, lambda graphs, model: ft.count_model(graphs))


def histogram_degree(spark, d):
    return ev.histogram(node_degree(spark, d), "degree", 32)


def scope_conflicts(spark, d):
    g = co.parts_graph(spark, d)
    return sc.scope_conflicts(g.nodes, g.scopes)


def unique_conflict_node(spark, d):
    return sc.unique_conflicts(scope_conflicts(spark, d))


def confusion_stats(spark, d):
    g = co.dialog_graph(spark, d)
    return ev.confusion(g, ft.instances(g))


def showgraph_nodes(spark, d):
    g = co.dialog_graph(spark, d)
    return ex.graph_nodes(g.nodes, sc.degrees(sc.adjacency(ft.instances(g))))


def showgraph_edges(spark, d):
    found = ft.instances(co.dialog_graph(spark, d))
    return ex.graph_edges(found, sc.pair_scores(found, ft.pair_counts(found), "n"))


def model_top_labels(spark, d):
    g, found = _orders(spark, d)
    top = ft.top_of_model(ft.pair_counts(found), ft.label_frequency(g.nodes), weight="n")
    return top.select("label", "rel", "partner", "n", "total", F.col("rel_rank").cast("long").alias("rel_rank"), F.col("partner_rank").cast("long").alias("partner_rank"))


def kfold_assignment(spark, d):
    return ev.folds(co.orders_graph(spark, d), 5).withColumn("fold", F.col("fold").cast("long"))


def reshuffled_passes(spark, d):
    """The order of the orders in the first two passes of a training."""
    return ev.pass_order(co.orders_graph(spark, d), 2, seed=1)


def fold_models(spark, d):
    """The candidates of the count models of five folds, each counted over the other four."""
    g, found = _orders(spark, d)
    best = ft.fold_candidates(ft.rest_counts(found, ev.folds(g, 5), 5), 4)
    return best.withColumns({"fold": F.col("fold").cast("long"), "rn": F.col("rn").cast("long")})


def maintained_candidates(spark, d):
    """The candidates after all orders were counted and those that are finished were withdrawn."""
    g, found = _orders(spark, d)
    counts = cut(ft.pair_counts(found))
    finished = g.nodes.where("node = 1 and label = 'F'").select("query_id")
    # a task looks up its own finished orders, a row each at most, so its arcs needn't be sorted to meet them
    delta = cut(mt.signed_counts(None, found.join(finished.hint("shuffle_hash"), "query_id", "left_semi")))
    index = cut(ft.candidates_by_b(counts, 4, "n"))
    best = mt.revised_candidates(index, mt.revised_counts(counts, delta), delta, 4)
    return best.withColumn("rn", F.col("rn").cast("long"))


def _pl(spark, d):
    g, found = _orders(spark, d)
    return g, found, le.settled(le.initial_weights(ft.count_model(g, use_factors=False)))


def pl_partition_function(spark, d):
    g, found, model = _pl(spark, d)
    p = le.pl_probabilities(g.nodes, sc.adjacency(found), ft.factor_instances(g), model, 16)
    return p.groupBy("query_id", "node").agg(F.sum("times").alias("n"), F.round(F.max("p"), 6).alias("top_p"))


def pl_gradient_pass1(spark, d):
    g, _, model = _pl(spark, d)
    return le.pl_gradient(g, model, 0.1)[0].select("label_a", "label_b", "rel", F.round("g", 4).alias("g"))


def pl_weights_after_pass1(spark, d):
    g, _, model = _pl(spark, d)
    # a rate as small as the corpus is large leaves most weights between their bounds
    rate = 0.01 / max(1, g.nodes.select("query_id").distinct().count())
    return le.pl_pass(g, model, rate).pairs.select("label_a", "label_b", "rel", F.round("weight", 6).alias("weight"))


def one_sweep_argmax(spark, d):
    g, found = _orders(spark, d)
    return sc.sweep(g.nodes, sc.adjacency(found), ft.factor_instances(g), _whole(ft.count_model(g)))


def _predicted(spark, d):
    g, found = _orders(spark, d)
    swept = sc.sweep(g.nodes, sc.adjacency(found), ft.factor_instances(g), _whole(ft.count_model(g)))
    return ev.compared(swept, g.nodes)


def precision_stats(spark, d):
    return ev.precision(_predicted(spark, d)).withColumns({c: F.round(c, 6) for c in ("error_rate", "recall")})


def label_error_report(spark, d):
    return ev.error_report(ev.label_errors(_predicted(spark, d)))


def _played(g, best):
    """What one round of moves does under the counts of the graphs: each owner's ``best`` proposal, its gain, and whether it
    wins its draw; ``best`` gets a board, its arcs and its factors."""
    with by_graph(g.nodes.sparkSession, g.parts):
        b = mv.board(g, _whole(ft.count_model(g)))
        best = b.cut(best(b, mv.arcs_at(b), mv.factors_of(b)))
        b.clear()
        drawn = b.cut(mv.independent(b, best, 0))
    changes = F.array_join(F.transform("changes", lambda c: F.concat_ws("=", c["node"], c["label"])), "|")
    return drawn.select("query_id", "owner", changes.alias("changes"), F.col("gain").cast("long").alias("gain"), "wins")


def node_moves_round(spark, d):
    """A round of node moves from the present labels of orders, under their counts."""
    return _played(co.orders_graph(spark, d, keep=True), lambda b, at, factors: mv.best_nodes(b, at, factors, ft.BEAM))


def arc_moves_round(spark, d):
    """A round of arc moves over the four best pairs of labels of each relation."""
    return _played(co.orders_graph(spark, d, keep=True), lambda b, at, factors: mv.best_arcs(b, mv.eligible_arcs(b), at, factors, 4))


def factor_moves_round(spark, d):
    """A round of factor moves over the eight best bags of each factor."""
    return _played(co.orders_graph(spark, d, keep=True), lambda b, at, factors: mv.best_factors(b, at, factors, 8))


def swap_moves_round(spark, d):
    """A round of node moves and swaps of part names inside orders, whose names are kept apart."""
    return _played(co.parts_graph(spark, d, keep=True), lambda b, at, factors: mv.best_nodes(b, at, factors, 8))


def greedy_layers(spark, d):
    """(query_id, node, layer): the first two layers of the greedy order in sessions, the nodes with most
    assigned neighbours first."""
    g = co.session_graph(spark, d)
    nodes, arcs = ft.unique_nodes(g.nodes), g.arcs.distinct()
    rest, done = nodes.where("not given").select("query_id", "node"), nodes.where("given").select("query_id", "node")
    first = se.next_layer(arcs, rest, done)
    second = se.next_layer(arcs, rest.join(first, ["query_id", "node"], "left_anti"), done.unionByName(first))
    return first.withColumn("layer", F.lit(1)).unionByName(second.withColumn("layer", F.lit(2)))


def map_inference(spark, d):
    g = co.orders_graph(spark, d, keep=True)
    return se.infer(g.with_nodes(se.cleared(g.nodes)), ft.count_model(g))


def map_inference_scopes(spark, d):
    g = co.parts_graph(spark, d, keep=True)
    return se.infer(g.with_nodes(se.cleared(g.nodes)), ft.count_model(g))


def eval_error_stats(spark, d):
    g = co.dialog_graph(spark, d, keep=True)
    solved = se.infer(g.with_nodes(se.cleared(g.nodes)), ft.count_model(g))
    return ev.label_errors(ev.compared(solved, g.nodes))


def ssvm_pass(spark, d):
    g = co.dialog_graph(spark, d, keep=True)
    return le.ssvm_step(g, le.initial_weights(ft.count_model(g)), 0.1)[0].pairs


def bp_inference(spark, d):
    g = co.dialog_graph(spark, d)
    return se.belief_propagation(g, ft.count_model(g))


def json_round_trip(spark, d):
    """The dialog corpus written as JSON lines, parsed and normalised again."""
    g = co.dialog_graph(spark, d)
    queries, _ = jg.parse(jg.lines(g), "value", "query_id")
    return ft.pair_counts(ft.instances(jg.tables(queries)))


def string_functions(spark, d):
    text = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit(" \t"), F.col("p_name"), F.lit(" | a,b;c\\d \n")).alias("s"), (F.col("p_size") * 17).cast("string").alias("size"))
    first = st.split_first(F.col("s"), ",;|")
    return text.select(
        "p_partkey",
        st.trim_white(F.col("s")).alias("trimmed"),
        st.shorten(st.trim_white(F.col("s")), 12).alias("short"),
        st.escape(F.col("s")).alias("escaped"),
        (st.unescape(st.escape(F.col("s"))) == F.col("s")).alias("same"),
        F.size(st.split(F.col("s"), " ")).cast("long").alias("parts"),
        first["before"].alias("before"),
        first["separator"].alias("sep"),
        st.parse_int(F.concat(F.lit("0x"), F.col("size"))).cast("long").alias("hex"),
        st.parse_int(F.col("size")).cast("long").alias("dec"),
        st.join(F.array("size", "p_partkey"), "-").alias("joined"),
    )


def rpc_dispatch(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    method = F.element_at(F.array(*[F.lit(m) for m in ("infer", "nbest", "showgraph", "drop")]), (F.col("event_id") % 4 + 1).cast("int"))
    graph = F.lit('{"query":[{"a":0,"b":1,"f2":"r"}],"assign":[{"v":0,"inf":"x"},{"v":1,"giv":"y"}]')
    params = F.concat(graph, F.when(F.col("event_id") % 5 != 0, F.lit(',"n":3')).otherwise(""), F.lit("}"))
    body = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"jsonrpc":"2.0","method":"'), method, F.lit('","params":'), params, F.lit(',"id":"'), F.col("event_id").cast("string"), F.lit('"}')))
    seen = service.envelopes(e.select(F.col("event_id").alias("request_id"), body.alias("body"))).drop("part")
    return seen.select("request_id", "id", "method", F.coalesce("code", F.lit(0)).cast("long").alias("code"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "candidates_by_b": _ranked(ft.candidates_by_b, 4),
    "candidates_by_a": _ranked(ft.candidates_by_a, 4),
    "candidates_by_rel": _ranked(ft.candidates_by_rel, 8),
} | {
    f.__name__: f
    for f in (
        pair_feature_counts, factor_feature_counts, label_frequency, rare_label_collapse, unknown_labels, valid_labels, dictionary, growing_dictionary, factor_candidates, total_score, node_score, pair_score, nbest, nbest_valid,
        node_degree, known_relation_degree, arc_pass_eligible, histogram_degree, scope_conflicts, unique_conflict_node, confusion_stats, showgraph_nodes, showgraph_edges, model_top_labels, kfold_assignment, reshuffled_passes, fold_models, maintained_candidates, pl_partition_function,
        pl_gradient_pass1, pl_weights_after_pass1, one_sweep_argmax, precision_stats, label_error_report, node_moves_round, arc_moves_round, factor_moves_round, swap_moves_round, greedy_layers, map_inference, map_inference_scopes, eval_error_stats, ssvm_pass, train_pl, train_ssvm, train_pl_ssvm, online_pass, cross_validation, bp_inference, json_round_trip,
        string_functions, rpc_dispatch,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog_sql.SQL)
