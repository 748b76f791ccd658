"""Operator 6: exact Jaccard self-join of documents on word n-grams, as components.

Rare-first prefix filtering with length, positional and suffix filters (after Chaudhuri et al. 2006
and Xiao et al., "Efficient Similarity Joins for Near Duplicate Detection", 2008):

1. Documents with equal shingle sets are one node (a 64-bit key of the set).
2. Shingles are ordered rare first: those that stand once in the corpus, then those that stand more often,
   then the ``ORDER_TOP`` most frequent by their counts; ties by hash.  Which stand once is told by a
   table of one bit for each of up to 2**CELL_BITS ranges of hashes: it is set where the corpus has two
   shingles or more, so a lone shingle may count as a common one but not the other way round.  A
   document with enough shingles of its own thus has no other shingle in its prefix.  Any fixed order gives
   the same links, so these bounds only affect speed.
3. A node is indexed under its prefix: two sets with J >= t share a shingle in their first
   n - ceil(t n) + 1 shingles.  Shingles in one prefix only go before any row is shuffled.
4. Star rounds: in each bucket of a prefix shingle every member is paired with one leader only, so a
   bucket of m copies makes m - 1 candidates, not m * m.  The leader is the member with the largest
   share of its prefix in other prefixes: an edit puts shingles of its own in front of a copy's
   prefix, so that is the text the others were copied from or one next to it, and it links with most
   of them.  Later rounds give each bucket that still holds several components the leader of a component
   drawn by a hash, so that buckets of one group draw different ones.
5. Residual round: only buckets that still hold several components, and there only pairs across
   components that don't lie both in the bucket's largest one.  No link that joins two components
   is lost, so the components are exactly those of all links.
6. Every candidate passes the filters and is verified once on the whole sets.  The suffix filter
   bounds the overlap by parts: both sets are cut into BUCKETS ranges of hashes; what two parts share
   is counted in the first of them, whose hashes a profile keeps, and at most the smaller part in the
   others.  SIGNATURE parts of another hash are kept as the parity of their sizes: at least as many
   shingles are in one set only as parities differ.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textnum as tn
from graphloom.llm.components import components
from graphloom.llm.store import drop, materialise

ORDER_TOP = 100_000  #: shingles whose frequency the order knows (12 bytes each on every executor)
LOCAL_TOP = 20_000  #: most frequent shingles that a task reports for each LOCAL_SPAN shingles it saw
LOCAL_SPAN = 2_000_000
CELL_BITS = 29  #: cells that tell lone shingles from others, at most: 64 MB on every executor
CELL_RANGES = 64  #: in which they are counted
CELLS_EACH = 8  #: cells for each shingle that tasks saw, where CELL_BITS allows it
BUCKETS = 64  #: of the suffix filter
KEPT = 4  #: of these ranges, whose hashes a profile keeps: a sixteenth of the set
SIGNATURE = 256  #: parities of other parts, as bits; 32 bytes that go with an entry in the residual round
RANGE_ROWS = 1_000_000  #: prefix entries to a range of hashes, on average
ROUNDS = 3  #: star rounds after the first, at most; they only save comparisons, the residual round is whole without them
CROWD = 4  #: pairs of the residual round for each prefix entry, above which another star round comes first, if the last halved them
BROADCAST_IDS = 500_000  #: nodes up to which their keys, or keys and components, are broadcast (about 30 MB)


def _at(rows: np.ndarray, count: int) -> np.ndarray:
    """Where each row's shingles begin and the last one's end."""
    at = np.zeros(count + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=count), out=at[1:])
    return at


def _nodes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set of shingles: of its size and of two sums over its hashes."""
    sums = np.zeros(len(h) + 1, np.uint64)
    key = np.diff(at).astype(np.uint64)
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        np.cumsum(tn.mix(h ^ np.uint64(salt)), out=sums[1:])
        key = tn.mix(key ^ (sums[at[1:]] - sums[at[:-1]]))
    return key.view(np.int64)


def _packed(cells: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences, byte by byte."""
    steps = np.diff(cells, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _seen(docs: DataFrame, k: int) -> DataFrame:
    """What tasks saw, a span of shingles at a time: rows (h, n) of the most frequent shingles, and rows
    (r, twice, size, cells) of the cells of a range that the span hits once, or more often."""
    width = 1 << CELL_BITS
    names = ["h", "n", "r", "twice", "size", "cells"]

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        cell, first = np.unique((h >> np.uint64(64 - CELL_BITS)).astype(np.uint32), return_index=True)
        often = np.add.reduceat(n, first) > 1
        rows = []
        for twice in (False, True):
            some = cell[often == twice]
            edges = np.searchsorted(some, np.arange(CELL_RANGES + 1) * (width // CELL_RANGES))
            rows += [(r, twice, int(b - a), _packed(some[a:b] - np.uint32(r * (width // CELL_RANGES)))) for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
        h, n = h[n > 1], n[n > 1]
        top = np.argsort(-n, kind="stable")[:LOCAL_TOP]
        r, twice, size, cells = zip(*rows, strict=True)
        none = lambda kind, count: pa.nulls(count, kind)
        pad = lambda array, before, after: pa.concat_arrays([none(array.type, before), array, none(array.type, after)])
        counts = [pad(pa.array(x), 0, len(rows)) for x in (h[top].view(np.int64), n[top])]
        places = [pad(pa.array(x, t), len(top), 0) for x, t in ((r, pa.int32()), (twice, pa.bool_()), (size, pa.int64()), (cells, pa.binary()))]
        return pa.RecordBatch.from_arrays([*counts, *places], names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for _, buf, offs in tn.slices(batch.column(0)):
                start, end, bounds = tn.words(buf, offs)
                held.append(tn.shingles(tn.word_hashes(buf, start, end), bounds, k)[1])
                if sum(map(len, held)) >= LOCAL_SPAN:
                    yield flush(held)
                    held = []
        if sum(map(len, held)):
            yield flush(held)

    return docs.select("text").mapInArrow(local, "h long, n long, r int, twice boolean, size long, cells binary")


def _lone(seen: DataFrame) -> DataFrame:
    """(r, bits): one bit for each cell of a range, set where the corpus has more than one shingle; as many
    cells as the number of shingles calls for.  A written table, which tasks read: it doesn't pass the driver."""
    total = seen.agg(F.sum("size")).first()[0] or 0
    bits = min(CELL_BITS, max(CELL_RANGES.bit_length() + 2, (CELLS_EACH * total).bit_length()))
    fold = 1 << (CELL_BITS - bits)
    width = (1 << CELL_BITS) // CELL_RANGES

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = None, None

        def done() -> pa.RecordBatch:
            more = count.reshape(-1, fold).sum(1) > 1
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(more, bitorder="little").tobytes()], pa.binary())], ["r", "bits"])

        for batch in batches:
            for r, twice, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != last:
                    if count is not None:
                        yield done()
                    count, last = np.zeros(width, np.uint8), r
                at = _unpacked(cells)
                count[at] = 2 if twice else np.minimum(count[at] + 1, 2)
        if count is not None:
            yield done()

    ranged = seen.where("r is not null").select("r", "twice", "cells").repartition("r").sortWithinPartitions("r")
    return materialise(ranged.mapInArrow(gather, "r int, bits binary"), "lone")


@functools.lru_cache(1)
def _bits(files: tuple[str, ...]) -> np.ndarray:
    """The bits of all ranges from the files of :func:`_lone`; a worker keeps them."""
    out = None
    for file in files:
        system, place = fs.FileSystem.from_uri(file)
        table = pq.read_table(place, filesystem=system)
        for r, bits in zip(table["r"].to_pylist(), table["bits"], strict=True):
            part = np.frombuffer(bits.as_buffer(), np.uint8)
            if out is None:
                out = np.zeros((CELL_RANGES, len(part)), np.uint8)
            out[r] = part
    return np.zeros(CELL_RANGES, np.uint8) if out is None else out.ravel()


def _order(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """The most frequent shingles of the corpus, sorted by hash, and their counts; the table of :func:`_lone`."""
    seen = materialise(_seen(docs, k), "seen")
    counts = seen.where("h is not null").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(ORDER_TOP).toPandas()  # at most ORDER_TOP rows
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    lone = _lone(seen)
    drop(seen)
    return h[order], n[order], lone


def _profiles(docs: DataFrame, k: int, percent: int, top: tuple[np.ndarray, np.ndarray, DataFrame]) -> DataFrame:
    """One row a document: size and key of its set, its prefix, its suffix histogram."""
    known = docs.sparkSession.sparkContext.broadcast(top[:2])
    files = tuple(sorted(top[2].inputFiles()))
    schema = "doc_id long, n long, node long, prefix array<long>, parts array<int>, kept array<long>, bits array<long>"

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (frequent, times), lone = known.value, _bits(files)
        cell = np.uint64(64 - (8 * len(lone)).bit_length() + 1)
        for batch in batches:
            for first, buf, offs in tn.slices(batch.column(1)):
                rows, h = tn.shingle_sets(buf, offs, k)
                count = len(offs) - 1
                at = _at(rows, count)
                n, nodes = np.diff(at), _nodes(h, at)
                at_cell = (h >> cell).astype(np.int64)
                often = ((lone[at_cell >> 3] >> (at_cell & 7).astype(np.uint8)) & 1).astype(np.int64)
                if len(frequent):
                    place = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    often = np.where(frequent[place] == h, np.maximum(times[place], 1), often)
                order = np.lexsort((often, rows))  # stable: ties stay in order of the hash
                h = h[order]
                keep = n - (percent * n + 99) // 100 + (n > 0)
                early = np.arange(len(h)) - at[rows] < keep[rows]
                part = rows * BUCKETS + (h >> np.uint64(58)).astype(np.int64)
                cell_of_bit = rows * SIGNATURE + ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIGNATURE.bit_length() + 1)).astype(np.int64)
                odd = (np.bincount(cell_of_bit, minlength=count * SIGNATURE) & 1).astype(np.uint8)
                bits = np.packbits(odd).view(np.int64)
                histogram = np.bincount(part, minlength=count * BUCKETS).astype(np.int32)
                first_parts = h >> np.uint64(58) < KEPT
                ends, kept_ends = np.zeros(count + 1, np.int32), np.zeros(count + 1, np.int32)
                np.cumsum(keep, out=ends[1:])
                np.cumsum(np.bincount(rows[first_parts], minlength=count), out=kept_ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, count).cast(pa.int64()),
                        pa.array(n),
                        pa.array(nodes),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(h[early].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * BUCKETS), pa.array(histogram)),
                        pa.ListArray.from_arrays(pa.array(kept_ends), pa.array(h[first_parts].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * (SIGNATURE // 64)), pa.array(bits)),
                    ],
                    ["doc_id", "n", "node", "prefix", "parts", "kept", "bits"],
                )

    return docs.select("doc_id", "text").mapInArrow(profile, schema)


def _shared_hashes(reps: DataFrame) -> DataFrame:
    """(h): shingles in the prefixes of two documents or more.

    A task sends its hashes as arrays, one for each range of rehashed values, in which a hash stands
    once or twice however often the task met it; a range gathers those of all tasks.  The number of
    ranges follows the data, so a range stays near RANGE_ROWS hashes of 8 bytes.  (Prefixes hold the
    small hashes of their sets, so ranges of the hashes themselves would be uneven.)
    """
    total = reps.agg(F.sum(F.size("prefix"))).first()[0] or 0
    ranges = max(16, -(-total // RANGE_ROWS))
    width = np.uint64((1 << 64) // ranges + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            h, n = np.unique(h, return_counts=True)
            h = np.repeat(h, np.minimum(n, 2))
            r = (tn.mix(h ^ np.uint64(0x6A09E667F3BCC908)) // width).astype(np.int32)
            order = np.argsort(r, kind="stable")
            h, r = h[order], r[order]
            r, first = np.unique(r, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array([x.tobytes() for x in np.split(h, first[1:])] if len(h) else [], pa.binary())], ["r", "hashes"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None

        def twice() -> pa.RecordBatch:
            h, n = np.unique(np.frombuffer(b"".join(held), np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1])], ["h"])

        for batch in batches:
            for r, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and r != last:
                    yield twice()
                    held = []
                held.append(hashes)
                last = r
        if held:
            yield twice()

    sent = reps.select("prefix").mapInArrow(send, "r int, hashes binary")
    return sent.repartition("r").sortWithinPartitions("r").mapInArrow(gather, "h long")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, whole set) of every row of ``docs``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offs in tn.slices(batch.column(0)):
                rows, h = tn.shingle_sets(buf, offs, k)
                at = _at(rows, len(offs) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(h, at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], ["node", "shingles"])

    return docs.select("text").mapInArrow(whole, "node long, shingles array<long>")


def _length_filter(x: str, y: str, percent: int) -> F.Column:
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _positional_filter(percent: int) -> F.Column:
    """A shared shingle at places i and j, the first that the two share: all others come after it.

    Of a pair's shared shingles the first one's bucket bounds it rightly, and later ones only more
    tightly than they may; so a pair is lost only in buckets other than that of its first.
    """
    overlap = F.expr("1 + least(a_n - a_pos - 1, b_n - b_pos - 1)")
    return overlap * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent


def _signature_filter(percent: int) -> F.Column:
    """At most n_a + n_b - 2 * o shingles are in one set only, where o is the least overlap of a link."""
    differ = " + ".join(f"bit_count(a_bits[{i}] ^ b_bits[{i}])" for i in range(SIGNATURE // 64))
    return F.expr(f"({differ}) * {100 + percent} <= (a_n + b_n) * {100 - percent}")


def _few(keys: DataFrame, bound: int) -> DataFrame:
    """``keys`` for a join, to be broadcast where ``bound``, which its rows don't exceed, allows it."""
    return F.broadcast(keys) if bound <= BROADCAST_IDS else keys


class _Join:
    """What the rounds share: the texts, one row for each node, and the prefix entries."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent = docs, k, percent
        order = _order(docs, k)
        self.profiles = materialise(_profiles(docs, k, percent, order), "profiles")
        drop(order[2])
        filled = self.profiles.where("n > 0 and doc_id is not null").select("doc_id", "node")
        self.owners = filled.distinct()
        self.copies = materialise(filled.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "copies")
        of_id = filled.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1")
        self.repeats = not of_id.isEmpty()
        self.twins = self.owners.join(of_id, "doc_id").where("node <> a").select("a", F.col("node").alias("b")) if self.repeats else None
        reps = self.profiles.join(self.copies, ["node", "doc_id"], "left_semi").drop("doc_id")
        self.reps = materialise(reps.dropDuplicates(["node"]) if self.repeats else reps, "reps")
        entries = self.reps.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "h"))
        self.entries = materialise(entries.join(_shared_hashes(self.reps).hint("shuffle_hash"), "h", "left_semi"), "entries")
        met = self.entries.groupBy("node").agg(F.count("*").alias("met"))
        self.standing = materialise(met.join(self.reps.select("node", F.size("prefix").alias("p")), "node").select("node", F.expr("cast(1000 * met div p as int)").alias("standing")), "standing")
        self.members = self.standing.count()

    def tagged(self, labels: DataFrame | None, bits: bool = False) -> DataFrame:
        """The entries with their node's standing, component (itself, where it has no links yet) and,
        if asked for, parities."""
        known = self.standing.withColumn("comp", F.col("node"))
        if labels is not None:
            known = self.standing.join(labels.toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if bits:
            known = known.join(self.reps.select("node", "bits"), "node")
        return self.entries.join(_few(known, self.members), "node")

    def star(self, labels: DataFrame | None, salt: int) -> DataFrame:
        """Candidates: each member of a bucket and the bucket's leader, if they are in different components."""
        tagged = self.tagged(labels)
        draw = [F.xxhash64(F.lit(salt), "h", "comp").alias("draw")] if salt else []
        lead = F.min(F.struct(*draw, (-F.col("standing")).alias("by"), F.col("n").alias("a_n"), F.col("node").alias("a"), F.col("pos").alias("a_pos"), F.col("comp").alias("c"))).alias("lead")
        leaders = tagged.groupBy("h").agg(lead, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h", "lead.*")
        pairs = tagged.select("h", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos"), "comp").join(leaders, "h")
        return _ordered(pairs.where("comp <> c").where(_length_filter("a_n", "b_n", self.percent) & _positional_filter(self.percent)))

    def mixed(self, labels: DataFrame) -> DataFrame:
        """(h, major, pairs): buckets with more than one component, the largest of them, and how many
        pairs a comparison of the others' members with all makes."""
        each = self.tagged(labels).groupBy("h", "comp").agg(F.count("*").alias("m"))
        all_of = each.groupBy("h").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("m"), F.count("*").alias("c")).where("c > 1")
        return materialise(all_of.select("h", F.col("top.comp").alias("major"), F.expr("(m - top.m) * m").alias("pairs")), "mixed")

    def residual(self, labels: DataFrame, mixed: DataFrame) -> DataFrame:
        """Candidates across components, from the buckets that ``mixed`` names."""
        tagged = materialise(self.tagged(labels, bits=True).join(mixed.select("h", "major"), "h"), "tagged")
        minor = tagged.where("comp <> major").select("h", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), F.col("comp").alias("c"), F.col("bits").alias("a_bits"))
        every = tagged.select("h", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos"), F.col("comp").alias("d"), "major", F.col("bits").alias("b_bits"))
        across = minor.join(every, "h").where("c <> d and (d = major or a < b)")
        across = across.where(_length_filter("a_n", "b_n", self.percent) & _positional_filter(self.percent) & _signature_filter(self.percent))
        return _ordered(across)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are links; each pair is compared once, on the whole sets."""
        bound = 2 * pairs.count()
        brief = self.reps.select("node", "n", "parts", "kept", "bits")
        if bound <= BROADCAST_IDS:
            brief = brief.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
        sides = pairs.join(brief.toDF("a", "a_n", "a_parts", "a_kept", "a_bits"), "a").join(brief.toDF("b", "b_n", "b_parts", "b_kept", "b_bits"), "b").where(_signature_filter(self.percent))
        shared = F.expr(f"size(array_intersect(a_kept, b_kept)) + aggregate(slice(zip_with(a_parts, b_parts, (x, y) -> least(x, y)), {KEPT + 1}, {BUCKETS - KEPT}), 0, (s, x) -> s + x)")
        pairs = materialise(sides.where(shared * (100 + self.percent) >= (F.col("a_n") + F.col("b_n")) * self.percent).select("a", "b").distinct(), "pairs")
        bound = 2 * pairs.count()
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.copies, "node").select("node", "doc_id")
        texts = self.docs.join(_few(nodes.select("doc_id").distinct(), bound), "doc_id", "left_semi")
        sets = _sets(texts, self.k)
        if self.repeats:  # an id may stand for other texts too, and a text for several rows
            sets = sets.join(_few(nodes.select("node"), bound), "node", "left_semi").dropDuplicates(["node"])
        sets = materialise(sets, "sets")
        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        both = both.select("a", "b", F.size("sa").alias("x"), F.size("sb").alias("y"), F.size(F.array_intersect("sa", "sb")).alias("o"))
        links = materialise(both.where((100 * F.col("o")) >= self.percent * (F.col("x") + F.col("y") - F.col("o"))).select("a", "b").distinct(), "links")
        for table in (pairs, sets):
            drop(table)
        return links


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    ``docs`` has doc_id and text; other columns are ignored, whatever their names.  Two documents
    link when 100 * |A & B| >= percent * |A | B| for their sets of distinct k-word shingles (A-Z
    folded, words split at ASCII white space; a text of 1 to k-1 words is one shingle).  component_id
    is the smallest doc_id that links lead to.

    Null and empty texts have no shingles and link with nothing.  Repeated rows each get their row;
    rows that share a doc_id but not a text count as one document that has the links of all its
    texts.  A null doc_id keeps its row and gets a null component_id.  Texts of any length are
    taken whole.  An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    join = _Join(docs, k, percent)
    star = tried = materialise(join.star(None, 0), "star")
    links, labels, last = join.twins, None, None
    for salt in range(1, 2 + ROUNDS):
        found = join.verified(star)
        links = found if links is None else links.unionByName(found)
        drop(labels)
        labels = components(links)
        mixed = join.mixed(labels)
        crowd = mixed.agg(F.sum("pairs")).first()[0] or 0
        if salt > ROUNDS or crowd <= CROWD * join.entries.count() or (last is not None and crowd > last / 2):
            break
        last = crowd
        star = materialise(join.star(labels, salt).join(tried, ["a", "b"], "left_anti"), "star")
        tried = tried.unionByName(star)
        drop(mixed)
    rest = materialise(join.residual(labels, mixed).join(tried, ["a", "b"], "left_anti"), "rest")
    more = join.verified(rest)
    drop(rest)
    if not more.isEmpty():
        drop(labels)
        labels = components(links.unionByName(more))
    for table in (tried, mixed, join.entries, join.reps, join.standing):
        drop(table)
    owner = join.copies.select("node", "doc_id").join(labels.toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = owner.groupBy("comp").agg(F.min("doc_id").alias("component"))
    owner = owner.join(least, "comp").select("node", "component")
    of_id = join.owners.join(owner, "node").groupBy("doc_id").agg(F.min("component").alias("component"))
    found = join.profiles.select("doc_id", "n").join(of_id, "doc_id", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
