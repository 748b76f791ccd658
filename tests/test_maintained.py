"""Counts and ranks revised by batches against those counted anew."""

import random
from collections import Counter

import pytest

from graphloom.operators import features as ft
from graphloom.operators import maintained as mt
from graphloom.operators.lineage import cut

ARCS = "label_a string, label_b string, rel string"


def counted(table):
    return {tuple(r[c] for c in mt.KEY): r.n for r in table.collect()}


def ranks(table):
    return {(r.ctx, r.rel, r.cand): (r.n, r.rn) for r in table.collect()}


@pytest.mark.parametrize("beam", [2, 50])
def test_batches_equal_a_recount(spark, beam):
    draw = random.Random(beam)
    some = lambda n: [(draw.choice("abcdefgh"), draw.choice("xy"), draw.choice("rs")) for _ in range(n)]
    held, frame = some(60), lambda rows: spark.createDataFrame(rows, ARCS)
    counts = cut(ft.pair_counts(frame(held)))
    index = cut(ft.candidates_by_b(counts, beam, "n"))
    for _ in range(3):
        gone, new = draw.sample(held, 25), some(8)
        delta = cut(mt.signed_counts(frame(new), frame(gone)))
        counts = cut(mt.revised_counts(counts, delta))
        index = cut(mt.revised_candidates(index, counts, delta, beam))
        held = list((Counter(held) - Counter(gone) + Counter(new)).elements())
        assert counted(counts) == dict(Counter(held))
        assert ranks(index) == ranks(ft.candidates_by_b(ft.pair_counts(frame(held)), beam, "n"))


def test_order_of_batches_empty_and_null_rows(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), ARCS)
    nothing = ft.pair_counts(frame())
    add, take = mt.signed_counts(frame(("a", "x", "r"), (None, "x", "r"), ("b", "x", "r")), None), mt.signed_counts(None, frame(("a", "x", "r")))
    early = mt.revised_counts(nothing, take)
    assert counted(early) == {("a", "x", "r"): -1}
    assert mt.revised_candidates(ft.candidates_by_b(nothing, 2, "n"), early, take, 2).count() == 0
    assert counted(mt.revised_counts(early, add)) == counted(mt.revised_counts(mt.revised_counts(nothing, add), take)) == {("b", "x", "r"): 1}
    assert mt.signed_counts(frame(("a", "x", "r")), frame(("a", "x", "r"))).count() == 0
    with pytest.raises(ValueError):
        mt.signed_counts(None, None)
