"""Operator 11: periodic runs of words by a suffix automaton with merged end positions.

A run is a stretch of words in which words ``q`` apart are identical (``q`` its smallest period), that no
neighbouring word extends, of at least ``least`` words and ``times`` periods.

1. *Where a run can be.*  Let k = (least + 2) // 3.  Every k-gram inside a run of three periods stands in
   that run once more, one period on or back; so a run lies in a stretch of k-grams that the text
   repeats, and one of them comes again within a third of that stretch.  Hashes of k-grams, sorted a
   slice of texts at a time, give these stretches; a text without one (most of them) ends here.
2. *Squares.*  A suffix automaton of a stretch holds for each set of end positions the longest string
   that ends there.  From the longest strings down, each state's end positions are merged into its
   suffix link's, the smaller set into the larger; each one inserted meets its neighbours, and a
   distance d that the state's length covers seeds a square: what ends at both is longer than d.  Two
   occurrences of a run one period apart are neighbours in the state that they meet in, of a length of
   (times - 1) periods at least, so no run is lost and shorter states aren't merged.
3. *Runs.*  A seed is extended to both sides as far as words d apart are identical, once for each
   such stretch; those that are long enough and have no smaller period are the runs.

A text is a row; its automaton takes O(words of its repeated stretches) memory in a task.  Words are
compared by 64-bit hashes (see :mod:`graphloom.llm.textnum`), upper and lower case apart.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textnum as tn

BLOCK = 1_024  #: end positions in a block of an ordered set, after a split
RUNS = "array<struct<start: long, length: long, period: long>>"


class EndPositions:
    """An ordered set of numbers in blocks.  They are kept negative: a state's own end position is the
    least of its set, so it is appended."""

    def __init__(self, first: int):
        self.blocks, self.heads, self.size = [[-first]], [-first], 1

    def add(self, position: int) -> tuple[int | None, int | None]:
        """Insert ``position``; its neighbours before and after."""
        y, blocks = -position, self.blocks
        at = max(0, bisect_right(self.heads, y) - 1)
        block = blocks[at]
        i = bisect_right(block, y)
        after = block[i - 1] if i else None  # only the first block can have nothing in front
        before = block[i] if i < len(block) else blocks[at + 1][0] if at + 1 < len(blocks) else None
        block.insert(i, y)
        self.heads[at] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            blocks[at : at + 1] = [block[:BLOCK], block[BLOCK:]]
            self.heads[at : at + 1] = [block[0], block[BLOCK]]
        return (None if before is None else -before), (None if after is None else -after)

    def __iter__(self) -> Iterator[int]:
        return (-y for block in self.blocks for y in block)


def suffix_automaton(word: list[int]) -> tuple[array, array, array]:
    """(link, length, own): of each state its suffix link, its longest string's length, and the end
    position that made it (-1 for the root and for clones)."""
    link, length, own = array("i", [-1]), array("i", [0]), array("i", [-1])
    symbol, target, more = array("i", [-1]), array("i", [-1]), {}  # a state's first move; its others

    def goes(v: int, c: int) -> int:
        if symbol[v] == c:
            return target[v]
        others = more.get(v)
        return -1 if others is None else others.get(c, -1)

    def put(v: int, c: int, to: int) -> None:
        if symbol[v] in (c, -1):
            symbol[v], target[v] = c, to
        else:
            more.setdefault(v, {})[c] = to

    def state(size: int, at: int) -> int:
        for column, x in ((link, 0), (length, size), (own, at), (symbol, -1), (target, -1)):
            column.append(x)
        return len(link) - 1

    last = 0
    for at, c in enumerate(word):
        new, v = state(at + 1, at), last
        last = new
        while v >= 0 and (to := goes(v, c)) < 0:
            put(v, c, new)
            v = link[v]
        if v < 0:
            continue
        if length[to] != length[v] + 1:
            clone = state(length[v] + 1, -1)
            symbol[clone], target[clone], link[clone] = symbol[to], target[to], link[to]
            if to in more:
                more[clone] = dict(more[to])
            while v >= 0 and goes(v, c) == to:
                put(v, c, clone)
                v = link[v]
            link[to] = clone
            to = clone
        link[new] = to
    return link, length, own


def _alike(word: np.ndarray, d: int, at: int) -> tuple[int, int]:
    """The first and last i of the stretch around ``at`` in which word[i] == word[i + d]."""
    first, end, size, stop = at, at + 1, 64, len(word) - d
    while first > 0:
        low = max(0, first - size)
        differ = np.flatnonzero(word[low:first] != word[low + d : first + d])
        if len(differ):
            first = low + int(differ[-1]) + 1
            break
        first, size = low, 4 * size
    size = 64
    while end < stop:
        high = min(stop, end + size)
        differ = np.flatnonzero(word[end:high] != word[end + d : high + d])
        if len(differ):
            end += int(differ[0])
            break
        end, size = high, 4 * size
    return first, end - 1


def _primitive(block: np.ndarray) -> bool:
    """Whether no shorter block repeats to this one."""
    d = rest = len(block)
    r = 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            p = d // r
            if (block[p:] == block[:-p]).all():
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def runs_of(word: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start and then period."""
    n, found = len(word), []
    if n < least:
        return found
    link, length, own = suffix_automaton(np.unique(word, return_inverse=True)[1].tolist())
    shortest = least - least // times  # a run without one period is no shorter
    known: dict[int, list[tuple[int, int]]] = {}
    sets: list[EndPositions | None] = [None] * len(link)

    def seed(a: int, d: int) -> None:
        """Words from ``a`` back and from ``a + d`` back are alike over two periods or more."""
        spans = known.setdefault(d, [])
        i = bisect_right(spans, (a, n)) - 1
        if i >= 0 and spans[i][1] >= a:
            return
        first, last = _alike(word, d, a)
        insort(spans, (first, last))
        size = last - first + 1 + d
        if size >= max(least, times * d) and _primitive(word[first : first + d]):
            found.append((first, size, d))

    order = np.argsort(-np.frombuffer(length, np.int32), kind="stable")
    for v in order[: int((np.frombuffer(length, np.int32) > shortest).sum())].tolist():
        mine = sets[v] or EndPositions(own[v])
        sets[v] = None
        up = link[v]
        if length[up] < shortest:
            continue
        other = sets[up] or (EndPositions(own[up]) if own[up] >= 0 else None)
        if other is not None:
            small, large = (mine, other) if mine.size <= other.size else (other, mine)
            widest = min(length[up] // (times - 1), n // times)
            for x in small:
                before, after = large.add(x)
                if before is not None and x - before <= widest:
                    seed(before, x - before)
                if after is not None and after - x <= widest:
                    seed(x, after - x)
            mine = large
        sets[up] = mine
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(hashes: np.ndarray, bounds: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(row, first word, end) of stretches in which runs can be, words counted over the whole slice."""
    k = (least + 2) // 3
    long = np.diff(bounds) >= max(least, k)  # shorter texts have no run, nor a k-gram each
    rows, h = tn.shingles(hashes, bounds, k)
    held = long[rows]
    rows, h = rows[held], h[held]
    if not len(h):
        return
    at = np.arange(len(h)) - np.searchsorted(rows, rows) + bounds[rows]
    h = tn.mix(h ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    step = np.zeros(len(h), np.int64)  # to the next occurrence, 0: none
    step[order[:-1][same]] = at[order[1:][same]] - at[order[:-1][same]]
    where = np.flatnonzero(again)
    if not len(where):
        return
    new = np.flatnonzero((np.diff(where) > 1) | (np.diff(rows[where]) > 0)) + 1
    for part in np.split(where, new):
        size = int(part[-1] - part[0]) + k
        steps = step[part]
        if size >= least and bool(((steps > 0) & (steps * times <= size) & (part + steps <= part[-1])).any()):
            yield int(rows[part[0]]), int(at[part[0]]), int(at[part[0]]) + size


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, runs, collapsed.

    ``docs`` has doc_id and text; other columns are ignored, whatever their names.  Words are maximal runs
    without ASCII white space, numbered from 0.  ``runs`` has (start, length, period) of every run by
    start and then period; ``collapsed`` is the text's words, joined by one space, without those that a
    run contains after its first period.  With ``order`` a document of n words is read as its words
    order(doc_id, n), each of them a word number; None leaves it as it is.

    Null and empty texts have no words and an empty ``collapsed``; repeated rows and rows that share a
    doc_id each get their row; a null doc_id stays null.  Texts of any length are taken whole.  An empty
    table gives an empty one.  ``times`` of less than 3 is an error: the stretches in step 1 need three.
    """
    if times < 3 or least < times:
        raise ValueError("a run has three periods or more, and no fewer words than periods")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, buf, offs in tn.slices(batch.column(1)):
                start, end, bounds = tn.words(buf, offs)
                hashes = tn.word_hashes(buf, start, end, fold=False)
                count = len(offs) - 1
                orders = {}
                for row in range(count) if order is not None else ():
                    a, b = int(bounds[row]), int(bounds[row + 1])
                    if (how := order(ids[first + row], b - a)) is not None:
                        orders[row] = how
                        hashes[a:b] = hashes[a:b][how]
                runs: list[list[dict]] = [[] for _ in range(count)]
                kept: dict[int, np.ndarray] = {}
                for row, a, b in _stretches(hashes, bounds, least, times):
                    base = int(bounds[row])
                    for at, size, period in runs_of(hashes[a:b], least, times):
                        at += a - base
                        runs[row].append({"start": at, "length": size, "period": period})
                        kept.setdefault(row, np.ones(int(bounds[row + 1]) - base, bool))[at + period : at + size] = False
                texts = []
                for row in range(count):
                    words = buf[offs[row] : offs[row + 1]].tobytes().split()
                    if row in orders:
                        words = [words[i] for i in orders[row].tolist()]
                    if row in kept:
                        words = [words[i] for i in np.flatnonzero(kept[row]).tolist()]
                    texts.append(b" ".join(words))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                columns = [batch.column(0).slice(first, count), pa.array(np.diff(bounds).astype(np.int64)), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
