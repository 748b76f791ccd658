"""Scores of candidates: one shuffle by graph, and the same result for narrow and wide models."""

import pytest

from graphloom.operators import features as ft
from graphloom.operators import score as sc
from graphloom.plans import catalog
from graphloom.schema import Graphs


@pytest.mark.parametrize("name", ["node_score", "nbest", "one_sweep_argmax", "pl_partition_function"])
def test_terms_and_candidates_meet_without_another_shuffle(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert dealt and all("node" not in x and "cand" not in x and "side" not in x for x in dealt), dealt


def test_narrow_and_wide_models_score_alike(spark, monkeypatch):
    nodes = [(1, 0, "p", False), (1, 1, "q", True), (1, 2, None, False), (1, 3, "p", False), (2, 0, "r", False), (2, 1, "q", True), (2, 1, "z", False)]
    arcs = [(1, 0, 1, "x"), (1, 0, 1, "x"), (1, 0, 0, "loop"), (1, 2, 1, "x"), (1, 3, 0, "y"), (1, 3, 3, "loop"), (2, 0, 1, "x"), (2, 0, 9, "x"), (2, 0, 0, "loop")]
    factors = [(1, 0, [0, 1, 3]), (1, 1, [2, 1, 3]), (2, 0, [0, 1])]
    g = Graphs(
        spark.createDataFrame(nodes, "query_id long, node int, label string, given boolean"),
        spark.createDataFrame(arcs, "query_id long, node_a int, node_b int, rel string"),
        spark.createDataFrame([], "query_id long, scope_id int, node int"),
        spark.createDataFrame(factors, "query_id long, factor_id int, nodes array<int>"),
    )
    model, adj, groups = ft.count_model(g), sc.adjacency(ft.instances(g)), ft.factor_instances(g)
    present = g.nodes.where("not given and label is not null").select("query_id", "node", ft.F.col("label").alias("cand"))

    def both():
        found = sc.offered(adj, groups, model, 2, present=present).select("query_id", "node", "cand", "score", "hint", ft.F.least("kept", ft.F.lit(1)).alias("kept"))
        return sorted((*r[:3], float(r[3]), *r[4:]) for r in found.collect())

    narrow = both()
    monkeypatch.setattr(sc, "_narrow", lambda *x: False)
    assert narrow == both()
    # node 0 of graph 2 as p: (p, q, x) stands twice in graph 1, (p, p, loop) twice, and the bag of p, q and no label once
    assert [r[3] for r in narrow if r[:3] == (2, 0, "p")] == [5.0]
