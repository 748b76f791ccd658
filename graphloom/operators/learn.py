"""Learning weights: synchronous passes whose gradients are aggregations and whose updates are joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import evaluate as ev
from graphloom.operators import features as ft
from graphloom.operators import score as sc
from graphloom.operators import search as se
from graphloom.operators.lineage import cut
from graphloom.schema import Graphs, Model

RATES: dict[str, Callable[[float, int, float, float], float]] = {
    # rate of pass p from the rate before it; fixed values: the names of the schedules
    "fixed": lambda rate, p, start, lam: rate,
    "prop_pass": lambda rate, p, start, lam: rate / (p + 1),
    "prop_sqrt_pass": lambda rate, p, start, lam: rate / (p + 1) ** 0.5,
    "prop_pass_and_initial_learn_rate": lambda rate, p, start, lam: start / (1 + lam * (p + 1)),
}


def initial_weights(model: Model, regularization: float = 2.0) -> Model:
    """Every feature at half of the largest weight, 1 / regularization."""
    half = F.lit(1 / regularization / 2)
    return Model(model.pairs.withColumn("weight", half), model.factors.withColumn("weight", half), model.label_freq)


def clamped(weights: DataFrame, gradient: DataFrame, keys: list[str], regularization: float) -> DataFrame:
    """Known features plus their gradient, held between 0 and 1 / regularization."""
    joined = weights.join(gradient.where(F.abs("g") > 1e-9), keys, "left")
    moved = F.least(F.greatest(F.col("weight") + F.coalesce("g", F.lit(0.0)), F.lit(0.0)), F.lit(1 / regularization))
    return joined.select(*keys, moved.alias("weight"))


PAIR, BAG = ["label_a", "label_b", "rel"], ["labels"]


def pl_probabilities(nodes: DataFrame, adj: DataFrame, groups: DataFrame, model: Model, beam: int) -> DataFrame:
    """(query_id, node, cand, times, p): softmax of each node's candidates and its gold label.

    The gold label is added without looking whether it is a candidate, so it can count twice.
    """
    gold = nodes.where("not given and label is not null").select("query_id", "node", F.col("label").alias("cand"))
    scored = sc.offered(adj, groups, model, beam, present=gold).withColumn("times", F.col("kept") + F.col("hint").cast("long"))
    mine = Window.partitionBy("query_id", "node")
    scored = scored.withColumn("e", F.col("times") * F.exp(F.col("score") - F.max("score").over(mine)))
    return scored.select("query_id", "node", "cand", "times", (F.col("e") / F.sum("e").over(mine)).alias("p"))


def pl_gradient(graphs: Graphs, model: Model, rate: float, beam: int = 16) -> tuple[DataFrame, DataFrame]:
    """(pair gradient, factor gradient) of a pseudo-likelihood pass, columns keys and g.

    Every feature that a node would have under a candidate loses rate times the candidate's chance;
    gold features gain rate times ``beam`` for each occurrence.
    """
    found, groups = ft.instances(graphs), ft.factor_instances(graphs)
    adj = sc.adjacency(found)
    chances = pl_probabilities(graphs.nodes, adj, groups, model, beam)
    chances, lost = chances.select("query_id", "node", "cand", "p"), (-rate * F.sum(F.col("times") * F.col("p"))).alias("g")
    loss = sc.around(adj.where("not given"), None, chances).where("rel is not null").groupBy(*PAIR).agg(lost)
    gain = ft.pair_counts(found).select("label_a", "label_b", "rel", (F.col("n") * F.lit(rate * beam)).alias("g"))
    pairs = loss.unionByName(gain).groupBy(*PAIR).agg(F.sum("g").alias("g"))
    bag_loss = sc.around(adj.where("false"), groups, chances).where("labels is not null").groupBy(*BAG).agg(lost)
    bag_gain = ft.factor_counts(groups).select("labels", (F.col("n") * F.lit(rate * beam)).alias("g"))
    return pairs, bag_loss.unionByName(bag_gain).groupBy("labels").agg(F.sum("g").alias("g"))


def pl_pass(graphs: Graphs, model: Model, rate: float, beam: int = 16, regularization: float = 2.0) -> Model:
    pairs, bags = pl_gradient(graphs, model, rate, beam)
    return Model(clamped(model.pairs, pairs, PAIR, regularization), clamped(model.factors, bags, BAG, regularization), model.label_freq)


def ssvm_step(graphs: Graphs, model: Model, rate: float, margin: float = 0.1, regularization: float = 2.0, options: se.Options | None = None) -> tuple[Model, DataFrame]:
    """A max-margin pass and its statistics: search from the gold labels with the margin off them,
    then move weights by the features of gold less those of the prediction."""
    predicted = se.search(graphs, model, options, margin=margin)
    there = graphs.with_nodes(predicted)
    gradients = []
    for keys, count in ((PAIR, lambda g: ft.pair_counts(ft.instances(g))), (BAG, lambda g: ft.factor_counts(ft.factor_instances(g)))):
        both = count(graphs).withColumn("s", F.lit(1)).unionByName(count(there).withColumn("s", F.lit(-1)))
        gradients.append(both.groupBy(*keys).agg((rate * F.sum(F.col("s") * F.col("n"))).alias("g")))
    moved = Model(clamped(model.pairs, gradients[0], PAIR, regularization), clamped(model.factors, gradients[1], BAG, regularization), model.label_freq)
    return moved, ev.precision(ev.compared(predicted, graphs.nodes))


def settled(model: Model) -> Model:
    """The model with its lineage cut, so a long training stays a short plan."""
    return Model(cut(model.pairs), cut(model.factors), model.label_freq)


def train_pl(graphs: Graphs, model: Model, passes: int = 24, rate: float = 0.1, stop: float = 1e-4, schedule: str = "prop_pass", lam: float = 1.0, beam: int = 16, regularization: float = 2.0) -> Model:
    """Pseudo-likelihood passes under a schedule of rates (an unknown name is an error)."""
    if schedule not in RATES:
        raise ValueError(f"unknown schedule {schedule!r}")
    start = rate
    for p in range(passes):
        rate = RATES[schedule](rate, p, start, lam)
        if rate < stop:
            break
        model = settled(pl_pass(graphs, model, rate, beam, regularization))
    return model


def descend(step: Callable[[Model, float, int], tuple[Model, DataFrame]], model: Model, passes: int, rate: float, stop: float) -> tuple[Model, list[dict]]:
    """Passes of ``step`` (model, rate, number of the pass).  One whose error rate rose is undone and the rate halves."""
    last, log = 1.0, []
    for p in range(passes):
        moved, stats = step(model, rate, p)
        seen = stats.first().asDict()
        log.append({"pass": p, "rate": rate, **seen})
        if seen["error_rate"] is not None and seen["error_rate"] > last:
            rate /= 2
        else:
            last, model = (last if seen["error_rate"] is None else seen["error_rate"]), settled(moved)
        if rate < stop:
            break
    return model, log


def train_ssvm(graphs: Graphs, model: Model, passes: int = 24, rate: float = 0.1, stop: float = 1e-4, margin: float = 0.1, regularization: float = 2.0, options: se.Options | None = None) -> tuple[Model, list[dict]]:
    """Max-margin passes over all graphs at once."""
    return descend(lambda model, rate, p: ssvm_step(graphs, model, rate, margin, regularization, options), model, passes, rate, stop)


def train_pl_ssvm(graphs: Graphs, model: Model, pl_passes: int = 10, ssvm_rate: float = 0.1, **kw) -> tuple[Model, list[dict]]:
    """Pseudo-likelihood passes first, then max-margin ones from the weights they found."""
    return train_ssvm(graphs, train_pl(graphs, model, passes=pl_passes), rate=ssvm_rate, **kw)


def cross_validate(graphs: Graphs, k: int, train: Callable[[Graphs, Model], Model], regularization: float = 2.0) -> DataFrame:
    """One row of pooled statistics over ``k`` folds; each is predicted by a model of the others."""
    fold = ev.folds(graphs, k).persist()
    pooled = None
    for i in range(k):
        rest, held = graphs.only(fold.where(F.col("fold") != i)), graphs.only(fold.where(F.col("fold") == i))
        model = train(rest, initial_weights(ft.count_model(rest), regularization))
        stats = ev.precision(ev.compared(se.infer(held.with_nodes(se.cleared(held.nodes)), model), held.nodes))
        pooled = stats if pooled is None else pooled.unionByName(stats)
    return ev.merged(pooled)
