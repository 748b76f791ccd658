"""Orders whose arcs and factors carry the labels of their nodes."""

import pytest

from graphloom.operators import features as ft
from graphloom.plans import catalog
from graphloom.sources import corpora as co

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string, l_returnflag string"


def _odd_orders(spark, folder):
    """No row of an order, two rows of one, labels that are null, a line twice, a key that is null and a part that isn't there."""
    lines = [(1, 1, 1, 1, "a", "R"), (1, 2, 2, 1, "a", None), (1, 2, 2, 1, "a", "N"), (2, 1, 1, 1, "a", "N"), (3, 5, 2, 1, "a", "A"), (3, 7, 9, 1, "a", "A"), (3, 8, 1, 1, "b", "R"), (None, 1, 1, 1, "a", "R"), (5, 1, 2, 1, "a", "A")]
    orders = [(1, "2-HIGH", "F"), (1, "1-URGENT", "O"), (1, None, "F"), (3, None, None), (4, "1-URGENT", "F"), (None, "1-URGENT", "F"), (5, "5-LOW", None)]
    tables = {"lineitem": (lines, LINE), "orders": (orders, "o_orderkey long, o_orderpriority string, o_orderstatus string"), "part": ([(1, "Brand#1", "x"), (2, None, "y")], "p_partkey long, p_brand string, p_name string")}
    for name, (rows, columns) in tables.items():
        spark.createDataFrame(rows, columns).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_carried_labels_are_those_of_the_nodes(spark, tmp_path, sf):
    for d in (_odd_orders(spark, tmp_path / "odd"), sf):
        g = co.orders_graph(spark, d)
        looked_up = g.with_nodes(g.nodes)
        assert "end_a" in g.arcs.columns and looked_up.arcs.columns == ["query_id", "node_a", "node_b", "rel"] and looked_up.factors.columns == ["query_id", "factor_id", "nodes"]
        for found in (ft.instances, ft.factor_instances):
            mine, theirs = found(g), found(looked_up)
            assert mine.columns == theirs.columns
            assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.collect())) != []


@pytest.mark.parametrize("name", ["pair_score", "total_score", "nbest", "one_sweep_argmax", "pl_partition_function"])
def test_orders_are_shuffled_by_order_only_once_for_all_labels(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Window [first(of" in x]


@pytest.mark.parametrize("name", ["node_score", "nbest_valid", "one_sweep_argmax", "pl_partition_function"])
def test_kept_orders_are_scored_where_they_lie(spark, sf, name):
    """Lines are dealt by order when they are kept; nothing that is scored is dealt again by order, node or candidate."""
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(query_id" in x]


def test_lines_without_an_order_stay_nodes(spark, tmp_path):
    d = _odd_orders(spark, tmp_path / "odd")
    kept, not_kept = (co.orders_graph(spark, d, keep).nodes for keep in (True, False))
    assert sorted(map(str, kept.collect())) == sorted(map(str, not_kept.collect()))
    assert kept.where("query_id is null").count() == 2


def test_counting_arcs_gathers_no_lists_of_order_rows(spark, sf):
    plan = catalog.queries()["candidates_by_rel"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
