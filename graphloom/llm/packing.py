"""Operator 9: packing documents into sequences of a fixed length by a configuration linear program.

1. A scan tokenizes every document, adds the end token and cuts documents that are too long; what
   stays is a table of pieces (ids of a piece by their CRC).
2. The histogram of piece lengths, at most ``size`` rows, goes to the driver, where the configuration
   LP (the fewest sequences, each filled by a multiset of lengths, that cover the histogram) is solved
   by multiplicative weights: a length's price falls exponentially with the share of its pieces that
   is covered; in each round the pricing problem, a most valuable filling, is an unbounded knapsack
   solved by dynamic programming over the capacity, and the most valuable fillings around each of the
   longest lengths left are taken, each length by at most STEP of its pieces.  Only whole numbers of fillings are taken, so the
   solution is rounded down as it grows.  The rounding ends with the pieces left, which are packed best
   fit: after the last round, or after an earlier one where that saves sequences, as the last rounds
   run out of short pieces.  The work depends on ``size`` and not on the number of documents.
3. Pieces get a number within their length: a running count over (length, bucket) groups, with
   enough buckets that no length gathers in one task.  Length and number then give the sequence and
   the place in it by a lookup in the plan.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.store import materialise

END_ID = 2
ETA = 0.02  #: how fast prices fall
CUTS = (1.0, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)  #: shares of the rounds after which the rest is tried best fit
STEP = 0.1  #: share of a length's pieces that one round takes, at most (but what one sequence can hold)
NEXT = 0.9  #: lengths from this share of the longest one on get their best fillings in a round
TIE = 2e-4  #: by which long pieces go first where prices tie, as a share
LONG = 50_000  #: characters from which on the tokenizer itself reads a text; the ranks give the same ids, faster
BUCKET_ROWS = 200_000


def load_encoding(ranks: str, special: dict[str, int] | None = None):
    """The byte-level BPE of a ranks file; its ids are those of the tokenizer of the same vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special or {})


def load_tokenizer(tokenizer: str, ranks: str | None = None) -> Callable[[str], np.ndarray]:
    """text -> ids of a tokenizers file, without added special tokens; those that stand in a text are
    read as such.  A ranks file of the same vocabulary does short texts faster."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
    fast = load_encoding(ranks, special) if ranks else None

    def ids(text: str) -> np.ndarray:
        if fast is not None and len(text) < LONG:
            return fast.encode_to_numpy(text, allowed_special="all")
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every row of ``docs``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(tokenizer, ranks)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                edges = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    row.append(i)
                    piece.append(n)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def prices(value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity the value of a most valuable multiset of lengths, and the length that it adds (0: none)."""
    best = np.zeros(size + 1)
    took = np.zeros(size + 1, np.int64)
    for w in range(1, size + 1):
        gain = best[w - 1 :: -1][:w] + value[1 : w + 1]
        i = int(gain.argmax())
        if gain[i] > best[w - 1]:
            best[w], took[w] = gain[i], i + 1
        else:
            best[w] = best[w - 1]
    return best, took


def fillings(first: np.ndarray, took: np.ndarray, size: int) -> np.ndarray:
    """Counts by length, a row for each of ``first``: that length and a most valuable rest."""
    root = np.maximum.accumulate(np.where(took > 0, np.arange(size + 1), 0))
    counts = np.zeros((len(first), size + 1), np.int64)
    counts[np.arange(len(first)), first] = 1
    room = root[size - first]
    while len(on := np.flatnonzero(room)):
        t = took[room[on]]
        counts[on, t] += 1
        room[on] = root[room[on] - t]
    return counts


def covering(demand: np.ndarray, size: int, eta: float = ETA) -> tuple[list[list[tuple[np.ndarray, int]]], np.ndarray, float]:
    """Rounds of (configuration, how often) by multiplicative weights, the pieces left, and a lower bound
    of the number of sequences, which the prices of the first rounds prove (the volume at least)."""
    present = np.flatnonzero(demand)
    volume = present / size
    left, rounds, low = demand.copy(), [], float(volume @ demand[present])
    rng = np.random.default_rng(0)
    while len(live := np.flatnonzero(left)):
        share = 1 - left[present] / demand[present]
        price = volume * np.exp(-eta * share) * (1 + TIE * (volume + rng.random(len(present))))
        value = np.full(size + 1, -1.0)
        value[present] = np.where(left[present] > 0, price, -1.0)
        best, took = prices(value, size)
        if len(live) == len(present):
            low = max(low, float(price @ demand[present]) / best[size])
        found = fillings(live[live >= NEXT * live[-1]][::-1], took, size)
        allowed = np.minimum(left, np.ceil(STEP * demand).astype(np.int64) + size // np.maximum(1, np.arange(size + 1)))
        taken: list[tuple[np.ndarray, int]] = []
        for filling in found:
            used = np.flatnonzero(filling)
            times = int((allowed[used] // filling[used]).min())
            if times:
                taken.append((filling.copy(), times))  # a view would keep all the fillings of its round
                allowed[used] -= filling[used] * times
                left[used] -= filling[used] * times
        if not taken:
            break
        rounds.append(taken)
    return rounds, left, low


def best_fit(demand: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Best fit, largest first, on counts: equal sequences are filled together."""
    free: dict[int, list[list]] = {}
    for length in range(size, 0, -1):
        left = int(demand[length])
        for room in range(length, size):
            groups = free.get(room, [])
            while left and groups:
                filled, times = groups.pop()
                k = room // length  # as many as fit while pieces last
                whole = min(times, left // k)
                if whole:
                    free.setdefault(room - k * length, []).append([filled + [(length, k)], whole])
                    left -= whole * k
                    times -= whole
                if times and 0 < left < k:
                    free.setdefault(room - left * length, []).append([filled + [(length, left)], 1])
                    left, times = 0, times - 1
                if times:
                    groups.append([filled, times])
                    if not left:
                        break
        if left:
            k = size // length
            if left // k:
                free.setdefault(size - k * length, []).append([[(length, k)], left // k])
            if left % k:
                free.setdefault(size - (left % k) * length, []).append([[(length, left % k)], 1])
    out = []
    for groups in free.values():
        for filled, times in groups:
            counts = np.zeros(size + 1, np.int64)
            for length, k in filled:
                counts[length] += k
            out.append((counts, times))
    return out


def plan(histogram: dict[int, int], size: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, number of sequences) that hold the histogram exactly."""
    demand = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        demand[length] = n
    out: list[tuple[np.ndarray, int]] = []
    full = np.zeros(size + 1, np.int64)
    full[size] = 1
    if demand[size]:
        out.append((full, int(demand[size])))
        demand[size] = 0
    return out + rounded(covering(demand, size)[0], demand, size)


def rounded(rounds: list[list[tuple[np.ndarray, int]]], demand: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """The rounds up to the latest cut that needs fewest sequences in all, and the rest best fit."""
    best: list[tuple[np.ndarray, int]] = []
    fewest = None
    for n in dict.fromkeys(max(1, int(share * len(rounds))) for share in CUTS):
        kept = [x for taken in rounds[:n] for x in taken]
        whole = kept + best_fit(demand - sum((filling * times for filling, times in kept), np.zeros_like(demand)), size)
        count = sum(times for _, times in whole)
        if fewest is None or count < fewest:
            best, fewest = whole, count
    return best


def _places(solution: list[tuple[np.ndarray, int]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first numbers of the runs, and for each run the first sequence, pieces a sequence
    and the place of the first."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken = np.zeros(size + 1, np.int64)
    first: dict[int, list[int]] = {}
    sequence = 0
    for filling, times in solution:
        place = 0
        for length in np.flatnonzero(filling)[::-1].tolist():
            k = int(filling[length])
            first.setdefault(length, []).append(int(taken[length]))
            runs.setdefault(length, []).append((sequence, k, place))
            taken[length] += k * times
            place += k * length
        sequence += times
    return {n: (np.array(first[n]), *np.array(runs[n]).T) for n in runs}


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 1024) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty; such a document is the end token alone.  Rows that repeat, or share
    a doc_id, are packed each for itself; a null doc_id stays null.  Texts of any length are
    tokenized whole and cut into pieces of ``size`` ids, of which the first may be shorter; the string of
    a special token gets that token's id, as the tokenizer has it.  Other columns are ignored; an empty table gives an empty one.
    """
    found = materialise(pieces(docs, tokenizer, ranks, size), "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    known = docs.sparkSession.sparkContext.broadcast(_places(plan(counts, size), size))
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS)) * 8
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("rn", F.row_number().over(within)).join(before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["length", "bucket"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rn") - 1).alias("number"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, base, k, place = known.value[n]
                run = np.searchsorted(first, number[at], "right") - 1
                past = number[at] - first[run]
                sequence[at] = base[run] + past // k[run]
                offset[at] = place[run] + past % k[run] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
