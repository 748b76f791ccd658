"""Max-margin learning one graph after another: shards of graphs learn apart, then their weights are mixed.

A pass deals the graphs to shards by a keyed hash of the pass and the graph's id.  A shard gets only the
weights that its graphs can read and learns from its graphs in the order of the hash, each from the weights
that the one before it left.  Then every feature moves by the mean of what the shards did to it, weighted by
how often each moved it.  The sums are whole numbers, so a lost task or other partitions change nothing.

Graphs with factors, and those above ``LARGEST`` rows, which no task should hold, are learned after that
by one batch step (:func:`graphloom.operators.learn.ssvm_step`).
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import evaluate as ev
from graphloom.operators import features as ft
from graphloom.operators import learn as le
from graphloom.operators import score as sc
from graphloom.operators import search as se
from graphloom.operators.lineage import cut
from graphloom.schema import Graphs, Model

LARGEST = 10_000  #: rows (nodes, arcs and scope members) of a graph that a task learns from
SHARD_ROWS = 200_000  #: rows of the graphs of a shard, about
UNIT = 2.0**40  #: moves are summed as whole multiples of 1 / UNIT
LEARNED = "label_a string, label_b string, rel string, delta double, n long, correct long, incorrect long, known long"

Arc = tuple[int, int, str]


def decoded(gold: dict[int, str | None], options: dict[int, list[str]], arcs: list[Arc], mates: dict[int, set[int]], weights: dict, margin: float, sweeps: int) -> dict[int, str | None]:
    """Labels after sweeps over the nodes of ``options`` from the gold labels, the margin off these: a node
    takes a label that scores higher and that no node of its scopes has; of equal ones the least."""
    label, at = dict(gold), defaultdict(list)
    for arc in sorted(set(arcs)):
        for end in {arc[0], arc[1]}:
            at[end].append(arc)

    def score(node: int, cand: str | None) -> float:
        under = ((cand if a == node else label[a], cand if b == node else label[b], rel) for a, b, rel in at[node])
        return math.fsum(weights.get(key, 0.0) for key in under) + (0.0 if cand == gold[node] else margin)

    for _ in range(sweeps):
        moved = False
        for node in sorted(options):
            best, most, taken = label[node], score(node, label[node]), {label[m] for m in mates[node]}
            for cand in sorted(options[node]):
                if cand not in taken and (found := score(node, cand)) > most:
                    best, most, moved = cand, found, True
            label[node] = best
        if not moved:
            break
    return label


def _shard(graphs: pd.DataFrame, features: pd.DataFrame, rate: float, margin: float, most: float, sweeps: int) -> pd.DataFrame:
    """What a shard's graphs, in their order, do to its weights, and a row of its statistics (rel null)."""
    start = dict(zip(zip(features["label_a"], features["label_b"], features["rel"]), features["weight"]))
    weights, moves, right, wrong, known = dict(start), Counter(), 0, 0, 0
    for g in graphs.sort_values(["key", "query_id"]).itertuples():
        gold, arcs = dict(zip(g.nodes, g.labels)), list(zip(g.arc_a, g.arc_b, g.arc_rel))
        options = {n: list(c) for n, x, given, c in zip(g.nodes, g.labels, g.givens, g.cands) if not given and x is not None}
        scopes, mates = defaultdict(set), defaultdict(set)
        for scope, node in zip(g.scope_ids, g.scope_nodes):
            if node in gold:
                scopes[scope].add(node)
        for members in scopes.values():
            for node in members & set(options):
                mates[node] |= members - {node}
        label = decoded(gold, options, arcs, mates, weights, margin, sweeps)
        same = sum(label[n] == gold[n] for n in options)
        bare = sum(not given and x is None for x, given in zip(g.labels, g.givens))
        right, wrong, known = right + same, wrong + len(options) - same + bare, known + len(options)
        gradient = Counter()
        for a, b, rel in arcs:
            gradient[gold[a], gold[b], rel] += 1
            gradient[label[a], label[b], rel] -= 1
        for key, by in gradient.items():
            if by and key in weights:
                weights[key] = min(max(weights[key] + rate * by, 0.0), most)
                moves[key] += 1
    out = [(*key, weights[key] - start[key], n, None, None, None) for key, n in sorted(moves.items())]
    return pd.DataFrame([*out, (None, None, None, None, None, right, wrong, known)], columns=[c.split()[0] for c in LEARNED.split(", ")], dtype=object)


def learned_apart(graphs: Graphs) -> DataFrame:
    """(query_id, rows, alone): how many rows a graph has, and whether a task may learn from it."""
    rows = [t.select("query_id") for t in (graphs.nodes, graphs.arcs, graphs.scopes)]
    counted = rows[0].unionByName(rows[1]).unionByName(rows[2]).where("query_id is not null").groupBy("query_id").agg(F.count("*").alias("rows"))
    grouped = graphs.factors.select("query_id", F.lit(True).alias("grouped")).distinct()
    alone = F.col("grouped").isNull() & (F.col("rows") <= LARGEST)
    return counted.join(grouped, "query_id", "left").select("query_id", "rows", alone.alias("alone"))


def _nested(small: Graphs, found: DataFrame, choices: DataFrame) -> DataFrame:
    """One row for each graph: its nodes with their candidates, its arcs and its scopes as arrays side by side."""
    nodes = ft.unique_nodes(small.nodes).join(choices, ["query_id", "node"], "left")
    nodes = nodes.groupBy("query_id").agg(F.collect_list(F.struct("node", "label", "given", F.coalesce("cands", F.array().cast("array<string>")).alias("cands"))).alias("x"))
    nodes = nodes.select("query_id", F.col("x.node").alias("nodes"), F.col("x.label").alias("labels"), F.col("x.given").alias("givens"), F.col("x.cands").alias("cands"))
    arcs = found.groupBy("query_id").agg(F.collect_list(F.struct("node_a", "node_b", "rel")).alias("y"))
    arcs = arcs.select("query_id", F.col("y.node_a").alias("arc_a"), F.col("y.node_b").alias("arc_b"), F.col("y.rel").alias("arc_rel"))
    scopes = small.scopes.where("node is not null").groupBy("query_id").agg(F.collect_list(F.struct("scope_id", "node")).alias("z"))
    scopes = scopes.select("query_id", F.col("z.scope_id").alias("scope_ids"), F.col("z.node").alias("scope_nodes"))
    whole = nodes.join(arcs, "query_id", "left").join(scopes, "query_id", "left")
    none = {"arc_a": "int", "arc_b": "int", "arc_rel": "string", "scope_ids": "int", "scope_nodes": "int"}
    return whole.withColumns({c: F.coalesce(c, F.array().cast(f"array<{t}>")) for c, t in none.items()})


def online_pass(graphs: Graphs, model: Model, rate: float, number: int = 0, margin: float = 0.1, regularization: float = 2.0, beam: int = 8, sweeps: int = 4, seed: int = 0, shards: int | None = None, options: se.Options | None = None) -> tuple[Model, DataFrame]:
    """A pass over all graphs and its statistics, as of the predictions that it learned from.

    Candidates of a node are the best ``beam`` for each gold label around it and hold for the whole pass.
    Nodes to infer without a gold label stay without one and count as incorrect.  Only features that the model
    has are moved.  ``options`` are those of the batch step.  ``number`` is the pass's own: each deals and orders the graphs anew.
    """
    sizes = cut(learned_apart(graphs))
    total, others = sizes.agg(F.sum(F.when(F.col("alone"), F.col("rows"))), F.count_if(~F.col("alone"))).first()
    shards = shards or max(1, math.ceil((total or 0) / SHARD_ROWS))
    alone = sizes.where("alone")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(number)), "query_id"))
    dealt = alone.select("query_id", key.alias("key")).withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 12), 16, 10).cast("long"), F.lit(shards)).cast("int"))
    small = graphs.only(alone.select("query_id"))
    found = cut(ft.instances(small))
    choices = cut(sc.candidates(sc.adjacency(found), model.pairs, beam).groupBy("query_id", "node").agg(F.collect_set("cand").alias("cands")))
    rows = _nested(small, found, choices).join(dealt, "query_id")

    # weights that a shard may read: any label that either end of an arc may take
    ends = found.join(dealt.select("query_id", "shard"), "query_id")
    for end in ("a", "b"):
        mine = choices.select("query_id", F.col("node").alias(f"node_{end}"), "cands")
        own = F.array(f"label_{end}")
        may = F.when(F.col(f"given_{end}") | F.col(f"label_{end}").isNull(), own).otherwise(F.array_union(F.coalesce("cands", own), own))
        ends = ends.join(mine, ["query_id", f"node_{end}"], "left").withColumn(f"may_{end}", may).drop("cands")
    read = ends.select("shard", "rel", F.explode("may_a").alias("label_a"), "may_b").select("shard", "rel", "label_a", F.explode("may_b").alias("label_b")).distinct()
    weights = read.join(model.pairs, le.PAIR).select(F.col("shard").alias("reader"), *le.PAIR, "weight")

    learn = partial(_shard, rate=rate, margin=margin, most=1 / regularization, sweeps=sweeps)
    learned = cut(rows.groupBy("shard").cogroup(weights.groupBy("reader")).applyInPandas(lambda a, b: learn(a, b), LEARNED))
    move = F.sum(F.round(F.col("delta") * F.col("n") * UNIT).cast("decimal(28,0)")).cast("double") / F.lit(UNIT) / F.sum("n")
    mixed = learned.where("rel is not null").groupBy(*le.PAIR).agg(move.alias("g"))
    out = Model(le.clamped(model.pairs, mixed, le.PAIR, regularization), model.factors, model.label_freq)
    stats = ev.merged(learned.where("rel is null"))
    if others:
        out, more = le.ssvm_step(graphs.only(sizes.where("not alone").select("query_id")), le.settled(out), rate, margin, regularization, options)
        stats = ev.merged(stats.unionByName(more))
    return out, stats


def train_online(graphs: Graphs, model: Model, passes: int = 24, rate: float = 0.1, stop: float = 1e-4, **kw) -> tuple[Model, list[dict]]:
    """Passes of :func:`online_pass`, each in an order of its own, with the rule of rates of ``train_ssvm``."""
    return le.descend(lambda model, rate, p: online_pass(graphs, model, rate, p, **kw), model, passes, rate, stop)
