"""Learning one graph after another: against a plain simulation, under other partitions, and against the batch pass."""

import hashlib
import random
from collections import Counter

import pytest

from graphloom.operators import evaluate as ev
from graphloom.operators import features as ft
from graphloom.operators import learn as le
from graphloom.operators import online as on
from graphloom.operators import search as se
from graphloom.schema import ARCS, FACTORS, NODES, SCOPES, Graphs
from graphloom.sources import corpora as co

LABELS, RELS = "uvwxyz", "rst"
SHORT = se.Options(greedy=False, swap=False, node_passes=1, arc_passes=0, factor_passes=0, rounds=2)


def made_up(spark, n, seed, scopes=True, factors=()):
    draw = random.Random(seed)
    nodes, arcs, kept = [], [], []
    for q in range(n):
        size = draw.randint(1, 6)
        nodes += [(q, i, draw.choice(LABELS), draw.random() < 0.3) for i in range(size)]
        arcs += [(q, draw.randrange(size), draw.randrange(size), draw.choice(RELS)) for _ in range(2 * size)]
        kept += [(q, 0, i) for i in range(size) if scopes and draw.random() < 0.5]
    make = spark.createDataFrame
    return Graphs(make(nodes, NODES), make(arcs, ARCS), make(kept, SCOPES), make(list(factors), FACTORS))


def weights_of(model):
    return {(r.label_a, r.label_b, r.rel): r.weight for r in model.pairs.collect()}


def plain_pass(graphs, weights, ids, rate, beam, margin=0.1, sweeps=4, most=0.5):
    """One shard: whole energies of whole assignments instead of a node's own arcs, candidates by sorting."""
    start, w, moves, right, wrong = weights, dict(weights), Counter(), 0, 0
    nodes, arcs, scopes = graphs.nodes.collect(), graphs.arcs.collect(), graphs.scopes.collect()
    for q in ids:
        gold = {r.node: r.label for r in nodes if r.query_id == q}
        free = sorted(r.node for r in nodes if r.query_id == q and not r.given)
        mine = [(r.node_a, r.node_b, r.rel) for r in arcs if r.query_id == q]
        apart = {r.node for r in scopes if r.query_id == q}

        def best_of(end, other, rel):
            fit = [(-v, k[end]) for k, v in start.items() if k[1 - end] == other and k[2] == rel]
            least = sorted(fit, key=lambda x: (x[0], [-ord(c) for c in x[1]]))
            return {x for _, x in least[:beam]}

        may = {n: set() for n in free}
        for a, b, rel in mine:
            if a in may:
                may[a] |= best_of(0, gold[b], rel)
            if b in may and a != b:
                may[b] |= best_of(1, gold[a], rel)

        def energy(label):
            return sum(w.get((label[a], label[b], rel), 0.0) for a, b, rel in set(mine)) + margin * sum(label[n] != gold[n] for n in free)

        label = dict(gold)
        for _ in range(sweeps):
            before = dict(label)
            for n in free:
                top, now = label[n], energy(label)
                for c in sorted(may[n]):
                    if n in apart and any(label[m] == c for m in apart - {n}):
                        continue
                    there = energy({**label, n: c})
                    if there > now + 1e-9:
                        top, now = c, there
                label[n] = top
            if label == before:
                break
        right, wrong = right + sum(label[n] == gold[n] for n in free), wrong + sum(label[n] != gold[n] for n in free)
        gradient = Counter((gold[a], gold[b], r) for a, b, r in mine)
        gradient.subtract((label[a], label[b], r) for a, b, r in mine)
        for k, by in gradient.items():
            if by and k in w:
                w[k] = min(max(w[k] + rate * by, 0.0), most)
                moves[k] += 1
    return {k: (w[k] - start[k], n) for k, n in moves.items()}, right, wrong


def keyed(n, seed=0, number=0):
    return sorted((hashlib.md5(f"{seed}:{number}:{q}".encode()).hexdigest(), q) for q in range(n))


@pytest.mark.parametrize(("shards", "number"), [(1, 0), (3, 1)])
def test_a_pass_equals_a_plain_simulation(spark, shards, number):
    g = made_up(spark, 40, 7)
    model = le.initial_weights(ft.count_model(g))
    # distinct weights, so that no tie hangs on the last bit of a sum
    names = sorted(weights_of(model))
    uneven = spark.createDataFrame([(*k, 0.1 + 0.3 * random.Random(str(k)).random()) for k in names], model.pairs.schema)
    model = type(model)(uneven, model.factors, model.label_freq)
    start, rate, beam = weights_of(model), 0.0371, 3
    got, stats = on.online_pass(g, model, rate, number, beam=beam, shards=shards)
    total, by, right, wrong = Counter(), Counter(), 0, 0
    for s in range(shards):
        moved, r, x = plain_pass(g, start, [q for k, q in keyed(40, 0, number) if int(k[:12], 16) % shards == s], rate, beam)
        right, wrong = right + r, wrong + x
        for k, (delta, n) in moved.items():
            total[k] += delta * n
            by[k] += n
    assert weights_of(got) == pytest.approx({k: v + (total[k] / by[k] if by[k] else 0.0) for k, v in start.items()}, abs=1e-9)
    assert len(by) > 20
    row = stats.first()
    assert (row.correct, row.incorrect) == (right, wrong)


def test_partitions_change_nothing_and_passes_differ(spark):
    g = made_up(spark, 60, 3)
    model = le.initial_weights(ft.count_model(g))
    other = Graphs(*(t.repartition(7) for t in (g.nodes, g.arcs, g.scopes, g.factors)))
    one, two = (weights_of(on.online_pass(x, model, 0.05, shards=4)[0]) for x in (g, other))
    assert one == two
    assert weights_of(on.online_pass(g, model, 0.05, 1, shards=4)[0]) != one


def test_graphs_with_factors_and_large_ones_go_through_the_batch_step(spark, monkeypatch):
    g = made_up(spark, 12, 5, factors=[(0, 0, [0])])
    model = le.initial_weights(ft.count_model(g))
    seen = {r.query_id: r.alone for r in on.learned_apart(g).collect()}
    assert [q for q, alone in seen.items() if not alone] == [0]
    got, stats = on.online_pass(g, model, 0.05, options=SHORT)
    assert sum(stats.select("correct", "incorrect").first()) == g.nodes.where("not given").count()
    monkeypatch.setattr(on, "LARGEST", 0)
    whole, _ = on.online_pass(g, model, 0.05, options=SHORT)
    batch, _ = le.ssvm_step(g, model, 0.05, options=SHORT)
    assert weights_of(whole) == pytest.approx(weights_of(batch))


def test_empty_null_and_repeated_rows(spark):
    make = spark.createDataFrame
    nodes = [(1, 0, "u", True), (1, 1, None, False), (1, 1, "v", False), (1, None, "v", False), (None, 0, "u", True), (2, 0, None, False), (3, 0, "v", False)]
    arcs = [(1, 0, 1, "r"), (1, 0, 1, "r"), (1, None, 1, "r"), (1, 0, 9, "r"), (2, 0, 0, None)]
    g = Graphs(make(nodes, NODES), make(arcs, ARCS), make([(1, 0, None), (1, 0, 9), (1, 0, 1)], SCOPES), make([], FACTORS))
    model = le.initial_weights(ft.count_model(g))
    got, stats = on.online_pass(g, model, 0.1)
    assert weights_of(got) == weights_of(model)
    assert (stats.first().correct, stats.first().incorrect, stats.first().known) == (2, 1, 2)
    none = g.only(make([], "query_id long"))
    got, stats = on.online_pass(none, model, 0.1)
    assert weights_of(got) == weights_of(model) and stats.first().correct == 0


def test_held_out_error_is_no_worse_than_with_batch_passes(spark, sf):
    g = co.dialog_graph(spark, sf)
    fold = ev.folds(g, 4)
    rest, held = g.only(fold.where("fold <> 0")), g.only(fold.where("fold = 0"))
    start = le.settled(le.initial_weights(ft.count_model(rest)))
    errors = []
    for train in (on.train_online, le.train_ssvm):
        model, log = train(rest, start, passes=2, options=SHORT)
        assert len(log) == 2
        errors.append(ev.precision(ev.compared(se.infer(held.with_nodes(se.cleared(held.nodes)), model, SHORT), held.nodes)).first().error_rate)
    assert errors[0] <= errors[1]
