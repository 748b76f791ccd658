"""Operator 10: benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so their Jaccard similarity is small however much of an
item a document holds; containment |Q & D| / |Q| is what counts (Zhu et al., "LSH Ensemble", 2016;
Koslicki and Zabeti, "Improving MinHash via the containment index", 2019).

* Items are partitioned by the size of their shingle set into bands of a factor of two.
* An item's signature is its bottom-m MinHash sketch.  m is set for each band from its upper size u
  as u - ceil(t u) + 1: a document that holds a share t of an item misses at most n - ceil(t n) of
  its shingles, so it holds at least one of the m sketch values.  The search loses no item.
* Sketch values are looked up among all shingles of each whole document; an item with a hit is a
  candidate and is verified by exact shingle containment.
* An item of fewer than k words has shingles of its own length: one, its words, which is looked up among
  all runs of so many words.  There is an index for each length, at most k.

The items are the broadcast side.  Their number is not taken on trust: they are dealt into blocks of
at most about ``BLOCK`` shingles (12 bytes each on an executor), and documents are scanned once a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textnum as tn
from graphloom.llm.store import materialise

BLOCK = 2_000_000
FILTER_BITS = 22  #: of the table that keeps most shingles from being looked up


def sketch_size(upper: int, percent: int) -> int:
    """Bottom-m size of the band whose largest item has ``upper`` shingles."""
    return upper - (percent * upper + 99) // 100 + 1


def own_shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, of k words or of all where a row has fewer."""
    count, found = np.diff(bounds), []
    for n in range(1, k + 1):
        rows, h = tn.shingles(hashes, bounds, n)
        held = count[rows] == n if n < k else count[rows] >= k
        found.append((rows[held], h[held]))
    rows, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], h[new]


def _item_sets(items: DataFrame, k: int) -> DataFrame:
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, offs in tn.slices(batch.column(1)):
                start, end, bounds = tn.words(buf, offs)
                rows, h = own_shingles(tn.word_hashes(buf, start, end), bounds, k)
                ends = np.zeros(len(offs), np.int32)
                np.cumsum(np.bincount(rows, minlength=len(offs) - 1), out=ends[1:])
                lengths = np.minimum(np.diff(bounds), k).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(offs) - 1), pa.array(lengths), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["item_id", "words", "shingles"]
                )

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(shingle, "item_id long, words int, shingles array<long>").where("item_id is not null and size(shingles) > 0")


def _indexes(block: list, percent: int) -> dict[int, dict]:
    """The broadcast form of a block of items: an index for each length of their shingles."""
    return {n: _index([r for r in block if r["words"] == n], percent) for n in sorted({r["words"] for r in block})}


def _index(block: list, percent: int) -> dict:
    """Sorted sketch values with their items, item sets."""
    ids = np.array([r["item_id"] for r in block], np.int64)
    sets = [np.array(r["shingles"], np.int64).view(np.uint64) for r in block]
    values, owner = [], []
    for i, s in enumerate(sets):
        upper = (1 << len(s).bit_length()) - 1  # sizes 2**b .. 2**(b+1) - 1 make a band
        low = np.sort(s)[: sketch_size(upper, percent)]
        values.append(low)
        owner.append(np.full(len(low), i))
    values, owner = (np.concatenate(values), np.concatenate(owner)) if block else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(values, kind="stable")
    return {"ids": ids, "sets": sets, "values": values[order], "owner": owner[order]}


def _hits(index: dict, rows: np.ndarray, h: np.ndarray, likely: np.ndarray, count: int, percent: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, item_id, n_shared, n_item) of items that rows of a slice contain, by their shingles (row, h)."""
    sets, values, owner = (index[x] for x in ("sets", "values", "owner"))
    hit = np.flatnonzero(likely[(h & np.uint64(len(likely) - 1)).astype(np.int64)])
    left, right = np.searchsorted(values, h[hit]), np.searchsorted(values, h[hit], "right")
    some = right > left
    hit, left, right = hit[some], left[some], right[some]
    if not len(hit):
        return
    pairs = np.unique(np.stack([np.repeat(rows[hit], right - left), np.concatenate([owner[a:b] for a, b in zip(left, right, strict=True)])]), axis=1)
    at = np.searchsorted(rows, np.arange(count + 1))
    for row in np.unique(pairs[0]).tolist():
        own = np.unique(h[at[row] : at[row + 1]])
        for i in pairs[1][pairs[0] == row].tolist():
            place = np.minimum(np.searchsorted(own, sets[i]), len(own) - 1)
            shared = int((own[place] == sets[i]).sum())
            if 100 * shared >= percent * len(sets[i]):
                yield row, int(index["ids"][i]), shared, len(sets[i])


def _search(docs: DataFrame, indexes: dict[int, dict], percent: int) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(indexes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = {}
        for n, index in known.value.items():
            likely[n] = np.zeros(1 << FILTER_BITS, bool)
            likely[n][(index["values"] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        for batch in batches:
            for first, buf, offs in tn.slices(batch.column(1)):
                start, end, bounds = tn.words(buf, offs)
                hashes, out = tn.word_hashes(buf, start, end), []
                for n, index in known.value.items():
                    rows, h = tn.shingles(hashes, bounds, n)
                    whole = np.diff(bounds)[rows] >= n  # a shorter text has no run of n words
                    if not whole.all():
                        rows, h = rows[whole], h[whole]
                    out += [(first + row, *rest) for row, *rest in _hits(index, rows, h, likely[n], len(offs) - 1, percent)]
                if out:
                    at_row, item, shared, n_item = zip(*out, strict=True)
                    columns = [batch.column(0).take(pa.array(at_row)), *(pa.array(x, pa.int64()) for x in (item, shared, n_item))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_shared", "n_item"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(search, "doc_id long, item_id long, n_shared long, n_item long")


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): pairs of a document and a test item of whose
    distinct k-word shingles the document holds at least ``percent`` in a hundred.

    Words and shingles as in :mod:`graphloom.llm.textnum`; an item of fewer than k words is one shingle of
    its own length, which every document with these words in a row holds.  Null and empty texts on either side match
    nothing; an item with a null id is left out, a document with a null doc_id is reported under null.
    Of repeated rows, or rows that share an id, a pair comes once, with its highest containment.
    Columns other than doc_id, item_id and text are ignored.  Empty tables give an empty result.
    """
    sets = materialise(_item_sets(items, k), "items")
    blocks = max(1, -(-(sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) // block))
    found = None
    for b in range(blocks):
        part = sets.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about `block` shingles
        one = _search(docs, _indexes(part, percent), percent)
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.expr("n_shared / n_item").alias("containment"), "n_shared", "n_item")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shared", "m.n_item", "m.containment")
