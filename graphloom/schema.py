"""Tables of a graph corpus and of a model.

A corpus holds many small graphs, each with a ``query_id``:

* ``nodes``: a label for each node, either given or to be inferred (then the label is the gold one, or
  null where nothing is known);
* ``arcs``: directed typed relations, a bag: repeated arcs count repeatedly in totals and gradients,
  and once in a node's adjacency;
* ``scopes``: sets of nodes whose labels should differ;
* ``factors``: n-ary groups of nodes.

A source that knows the labels of an arc's nodes may put them into the columns ``end_a`` and ``end_b`` (structs of
label and given, null where there is no such node), and those of a factor into ``members`` (structs of node, label
and given by node, each node once; null where one of them is no node): they need not be looked up then.  A row without a query_id
has no nodes.  Rows are not sifted by query_id: tables that are dealt by it would no longer look alike to a union of
them, which then shuffles its rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

NODES = "query_id long, node int, label string, given boolean"
ARCS = "query_id long, node_a int, node_b int, rel string"
SCOPES = "query_id long, scope_id int, node int"
FACTORS = "query_id long, factor_id int, nodes array<int>"
PAIR_FEATURES = "label_a string, label_b string, rel string, weight double"
FACTOR_FEATURES = "labels array<string>, weight double"
LABEL_FREQ = "label string, n_queries long"


@dataclass(frozen=True)
class Graphs:
    """The normalised tables of a corpus."""

    nodes: DataFrame
    arcs: DataFrame
    scopes: DataFrame
    factors: DataFrame
    parts: int | None = None  #: into how many parts of query_id all tables are dealt, where a source wrote them so

    def with_nodes(self, nodes: DataFrame) -> Graphs:
        """The graphs with other labels; arcs and factors don't carry theirs any more."""
        return replace(self, nodes=nodes, arcs=self.arcs.drop("end_a", "end_b"), factors=self.factors.drop("members"))

    def only(self, ids: DataFrame, how: str = "left_semi") -> Graphs:
        """The graphs whose query_id is (or, with left_anti, isn't) in ``ids``, which are as many as graphs and aren't sent to all executors."""
        nodes, arcs, scopes, factors = (t.join(ids.hint("merge"), "query_id", how) for t in (self.nodes, self.arcs, self.scopes, self.factors))
        return Graphs(nodes, arcs, scopes, factors)


@dataclass(frozen=True)
class Model:
    """Feature weights and label statistics."""

    pairs: DataFrame
    factors: DataFrame
    label_freq: DataFrame
