"""Operator 8: exact removal of long repeated byte strings, by column-wise multi-document
construction of a collection's order and common prefixes through sequential external files.

The construction follows Bauer, Cox and Rosone ("Lightweight algorithms for constructing and
inverting the BWT of string collections", 2013, and the LCP extension by Cox et al. 2016): every
round inserts one symbol of each document of a collection, in front of its current suffix.  The
last round's Burrows-Wheeler column (the symbols in front of the suffixes in sorted order) gives
the new order by a stable sort, and the new common prefixes are one more than the minimum of the
old ones in between.  Columns are passed through in sequence, once each.  A task takes BATCH
documents of ``2 * LENGTH - GRAM`` bytes at a time (and never more than BATCH + HOT), about 27 MB, so
the columns stay in memory and no file of a machine's own is needed.

A whole corpus is too long for that (a round for each byte of its longest text), so it is first cut
into collections that can be treated apart without losing a match:

* Winnowing (Schleimer, Wilkerson and Aiken 2003): of each ``LENGTH``-byte window the ``GRAM``-byte
  gram with the least hash (leftmost of equals) is an anchor.  Equal windows have the same anchor
  gram at the same place.
* An anchor gram that occurs once can't lie in a repeated window.  For each occurrence of the
  others, the bytes around it that any window over it can touch form one document of the collection
  of that gram, aligned at the anchor; it takes ``WIDTH`` rounds whatever the length of the texts.
* Texts that occur several times as a whole are found by their hash and stand in once.
* A gram with more than ``HOT`` occurrences isn't gathered anywhere: its windows are compared by
  128-bit fingerprints with an aggregation that combines before the shuffle.

Collections are dealt by the anchor's hash, so the work is spread evenly and no task sees more than
``HOT`` documents of one collection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textnum as tn
from graphloom.llm.store import drop, materialise

GRAM = 32  #: bytes of an anchor
HOT = 20_000  #: largest collection that one task takes
BATCH = 15_000  #: documents of collections that are treated at a time, in whole collections
PIECE = 1 << 20  #: windows of one text that are looked at together
SALTS = 32  #: parts into which the places of one repeated window over a hot gram are dealt
BROADCAST_IDS = 500_000  #: texts up to which their keys are broadcast to keep other texts out of a shuffle
SECOND = (tn.BASE * 0x2545F4914F6CDD1D + 0x1234567) % (1 << 64) | 3  #: base of the second fingerprint
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def anchor_places(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``buf``, hash) of the anchors of all windows that lie within one text."""
    n, width = len(buf), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(tn.BYTE[buf] * tn.powers(tn.BASE, n), out=total[1:])
    grams = tn.mix((total[GRAM:] - total[:-GRAM]) * tn.powers(tn.UNBASE, n)[: n - GRAM + 1])
    low = np.uint64((1 << 24) - 1)
    padded = np.full(-(-len(grams) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(grams)] = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - length + 1], ahead[width - 1 : width - 1 + n - length + 1])
    inside = np.zeros(n + 1, np.int8)
    long = np.diff(offs) >= length
    inside[offs[:-1][long]] += 1
    inside[offs[1:][long] - length + 1] -= 1
    chosen = np.zeros(n, bool)
    chosen[(least & low)[np.cumsum(inside[: n - length + 1], dtype=np.int8) > 0].astype(np.int64)] = True
    places = np.flatnonzero(chosen)
    return places, grams[places]


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for first, buf, offs in tn.slices(batch.column(2)):
                for at in range(0, max(1, len(buf) - length + 1), PIECE) if len(offs) == 2 else (0,):
                    part = buf[at : at + PIECE + length - 1] if len(offs) == 2 else buf
                    spans = np.array([0, len(part)]) if len(offs) == 2 else offs
                    place, h = anchor_places(part, spans, length)
                    row = np.searchsorted(spans, place, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[0][first + row]), pa.array(keys[1][first + row]), pa.array((place - spans[row] + at).astype(np.int32)), pa.array(h.view(np.int64))], ["t1", "t2", "pos", "h"]
                    )

    return texts.select("t1", "t2", "text").mapInArrow(find, "t1 long, t2 long, pos int, h long")


def _surroundings(texts: DataFrame, length: int) -> DataFrame:
    """A row for each different surrounding of an anchor in a text; places that share one come as
    ``repeated`` intervals at once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            size = 0
            for i, (text, at) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                data = text.as_buffer().to_pybytes()
                seen: dict[tuple, list[int]] = {}
                for x in sorted({(x["pos"], x["h"], x["hot"]) for x in at.as_py()}):
                    seen.setdefault((x[1], x[2], data[max(0, x[0] - length + GRAM) : x[0] + length]), []).append(x[0])
                for (h, hot, around), places in seen.items():
                    out.append((t1[i], t2[i], h, hot, places[0], min(places[0], length - GRAM), around, None, None))
                    size += len(around)
                    if len(places) > 1 and len(around) >= length:
                        for p in places:
                            start = p - min(p, length - GRAM)
                            if out[-1][7] is not None and out[-1][0] == t1[i] and out[-1][7] <= start <= out[-1][8]:
                                out[-1] = (*out[-1][:8], max(out[-1][8], start + len(around)))
                            else:
                                out.append((t1[i], t2[i], None, None, None, None, None, start, start + len(around)))
                if size > 8 << 20 or len(out) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), form, strict=True)], schema=form)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), form, strict=True)], schema=form)

    form = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("h", pa.int64()), ("hot", pa.bool_()), ("pos", pa.int32()), ("left", pa.int32()), ("around", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])
    return texts.select("t1", "t2", "text", "at").mapInArrow(cut, "t1 long, t2 long, h long, hot boolean, pos int, left int, around binary, start int, end int")


def repeated_columns(group: np.ndarray, left: np.ndarray, around: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Column-wise construction over aligned documents, those of a collection one after another.

    Yields (column, numbers of the documents whose window from that column on occurs in another
    document of the same collection), from the last column to the first; column c lies ``length -
    GRAM - c`` bytes before the anchor.
    """
    n, before = len(around), length - GRAM
    width = before + length
    low = (before - left).astype(np.int32)
    high = low + np.fromiter(map(len, around), np.int32, n)
    columns = np.empty((width, n), np.uint8)
    for i in range(0, n, 4096):
        rows = b"".join(b"\0" * int(lo) + x + b"\0" * (width - int(lo) - len(x)) for x, lo in zip(around[i : i + 4096], low[i : i + 4096], strict=True))
        columns[:, i : i + 4096] = np.frombuffer(rows, np.uint8).reshape(-1, width).T
    order = np.arange(n)
    bound = group.astype(np.int32) * 257
    common = np.zeros(n + 1, np.int32)  # of the documents at i - 1 and i of the order
    for c in range(width - 1, -1, -1):
        there = (low <= c) & (c < high)
        bwt = (bound + np.where(there, columns[c].astype(np.int32) + 1, 0))[order]
        perm = np.argsort(bwt, kind="stable")
        sorted_bwt = bwt[perm]
        order = order[perm]
        same = np.flatnonzero((sorted_bwt[1:] == sorted_bwt[:-1]) & there[order[1:]]) + 1
        a, b = perm[same - 1] + 1, perm[same]
        least = common[b]
        far = np.flatnonzero(a < b)
        if len(far):
            ends = np.empty(2 * len(far), np.int64)
            ends[::2], ends[1::2] = a[far], b[far] + 1
            least[far] = np.minimum.reduceat(common, ends)[::2]
        common = np.zeros(n + 1, np.int32)
        common[same] = least + 1
        if c <= before:
            yield c, order[np.maximum(common[:-1], common[1:]) >= length]


def _construct(surroundings: DataFrame, length: int) -> DataFrame:
    """Intervals (t1, t2, start, end) of repeated bytes, from surroundings dealt and sorted by h."""
    form = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def solve(rows: pa.Table) -> pa.RecordBatch:
        h = rows["h"].to_numpy()
        t1, t2, pos, left = (rows[x].to_numpy() for x in ("t1", "t2", "pos", "left"))
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        group = np.cumsum(new)
        shift = pos - (length - GRAM)
        end = np.zeros(len(h), np.int32)  # of a document's run of repeated windows that is open; 0: none
        out: list[tuple[np.ndarray, ...]] = []

        def close(who: np.ndarray, start: int) -> None:
            if len(who):
                out.append((t1[who], t2[who], (shift[who] + start).astype(np.int32), (shift[who] + end[who]).astype(np.int32)))
                end[who] = 0

        for c, who in repeated_columns(group, left, rows["around"].to_pylist(), length):
            hit = np.zeros(len(h), bool)
            hit[who] = True
            close(np.flatnonzero((end > 0) & ~hit), c + 1)
            end[hit & (end == 0)] = c + length
        close(np.flatnonzero(end), 0)
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, form, strict=True)], schema=form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= BATCH:
                table = pa.Table.from_batches(held)
                h = table["h"].to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last collection may go on
                if whole:
                    yield solve(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
                    count = table.num_rows - whole
        if held:
            yield solve(pa.Table.from_batches(held))

    dealt = surroundings.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "t1 long, t2 long, start int, end int")


def _fingerprints(surroundings: DataFrame, length: int) -> DataFrame:
    """(w1, w2, t1, t2, start) for every window over a hot anchor."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, pos, left = (batch.column(i).to_numpy() for i in range(4))
            for i, around in enumerate(batch.column(4).to_pylist()):
                buf, n = np.frombuffer(around, np.uint8), len(around) - length + 1
                if n <= 0:
                    continue
                w = []
                for base in (tn.BASE, SECOND):
                    total = np.zeros(len(buf) + 1, np.uint64)
                    np.cumsum(tn.BYTE[buf] * tn.powers(base, len(buf)), out=total[1:])
                    w.append(tn.mix((total[length:] - total[:n]) * tn.powers(pow(base, -1, 1 << 64), n)).view(np.int64))
                start = np.arange(n, dtype=np.int32) + np.int32(pos[i] - left[i])
                yield pa.RecordBatch.from_arrays([pa.array(w[0]), pa.array(w[1]), pa.array(np.full(n, t1[i])), pa.array(np.full(n, t2[i])), pa.array(start)], ["w1", "w2", "t1", "t2", "start"])

    return surroundings.select("t1", "t2", "pos", "left", "around").mapInArrow(prints, "w1 long, w2 long, t1 long, t2 long, start int")


def _only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose (t1, t2) is in ``keys``; by a broadcast up to a checked size."""
    few = keys.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(keys) if few else keys, ["t1", "t2"], "left_semi")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a 128-bit key (t1, t2) of the text and its length in bytes; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.octet_length("text").cast("long").alias("n_bytes"))


def repeated_spans(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """(t1, t2, spans): for each different text of ``docs`` (keyed) with repeated bytes, the
    (start, end) intervals found, which may overlap.  Texts that occur as a whole several times are
    looked at once; the caller knows that all of theirs repeats."""
    long = docs.where(F.col("n_bytes") >= length)
    anchors = materialise(_anchors(long, length), "anchors")
    seen = F.struct("t1", "t2", "pos")
    several = anchors.groupBy("h").agg(F.min(seen).alias("lo"), F.max(seen).alias("hi"), F.count("*").alias("c")).where("lo <> hi")
    places = materialise(anchors.join(several.select("h", (F.col("c") > hot).alias("hot")), "h").distinct(), "places")
    at = places.groupBy("t1", "t2").agg(F.collect_list(F.struct("pos", "h", "hot")).alias("at"))
    one = long.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id")).join(at, ["t1", "t2"])
    at = materialise(one, "at")
    for table in (anchors, places):
        drop(table)
    texts = _only(long, at.select("t1", "t2")).join(at.withColumnRenamed("doc_id", "rep"), ["t1", "t2"]).where("doc_id <=> rep")
    around = materialise(_surroundings(texts, length), "around")
    found = _construct(around.where("h is not null and not hot").select("t1", "t2", "h", "pos", "left", "around"), length)
    prints = _fingerprints(around.where("hot"), length)
    own = F.struct("t1", "t2", "start")
    twice = prints.groupBy("w1", "w2").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi")
    twice = twice.select("w1", "w2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = prints.withColumn("salt", F.pmod(F.xxhash64("t1", "t2", "start"), F.lit(SALTS)).cast("int"))
    hot_found = dealt.join(twice, ["w1", "w2", "salt"]).select("t1", "t2", "start", (F.col("start") + length).alias("end"))
    inner = around.where("start is not null").select("t1", "t2", "start", "end")
    spans = found.unionByName(hot_found).unionByName(inner)
    spans = materialise(spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    for table in (at, around):
        drop(table)
    return spans


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted maximal runs of touching or overlapping intervals."""
    runs: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return [(s, e) for s, e in runs]


def remove_repeats(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (binary, the bytes
    that remain), kept_sha256.

    Each text is its UTF-8 bytes (null: empty).  A byte goes if a ``length``-byte string over it also
    starts anywhere else in the table, in the same text or another; matches never cross texts and are
    judged on the input.  So both of two equal rows lose all they have if that is ``length`` bytes
    or more, and shorter texts stay.  Columns other than doc_id and text are ignored; a null or
    repeated doc_id is only a label.  An empty table gives an empty one.
    """
    rows = keyed(docs)
    spans = repeated_spans(rows, length, hot)
    counts = rows.groupBy("t1", "t2").agg(F.count("*").alias("copies"))
    known = counts.where("copies > 1").select("t1", "t2", F.lit(True).alias("again"))
    brief = rows.select("doc_id", "t1", "t2", "n_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).join(known, ["t1", "t2"], "left")
    brief = brief.join(spans.select("t1", "t2", F.lit(True).alias("some")), ["t1", "t2"], "left")
    brief = materialise(brief, "brief")
    whole = f"again is not null and n_bytes >= {int(length)}"
    zero = F.lit(0).cast("long")
    gone = brief.where(whole).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(EMPTY_SHA256).alias("kept_sha256"))
    same = brief.where(f"not ({whole}) and some is null").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    single = brief.where(f"not ({whole}) and some is not null").select("t1", "t2")
    cut = _only(rows, single).join(spans.join(single, ["t1", "t2"], "left_semi"), ["t1", "t2"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            removed, runs, sums = [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data, at, digest = memoryview(text.as_buffer()), 0, hashlib.sha256()
                spans_here = merged(found.as_py())
                for s, e in spans_here:
                    digest.update(data[at:s])
                    at = e
                digest.update(data[at:])
                removed.append(sum(e - s for s, e in spans_here))
                runs.append(len(spans_here))
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    part = cut.select("doc_id", "text", "spans", "n_bytes").mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return gone.unionByName(same).unionByName(part)


def kept_texts(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """``docs`` with its text reduced to the bytes that remain (a binary column ``kept``: a cut may
    split a character) and every other column as it was; the real output behind the digests of
    :func:`remove_repeats`."""
    from pyspark.sql.types import BinaryType

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text), "n_bytes": F.octet_length(text)}
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), *(c.alias(k) for k, c in keys.items()))
    spans = repeated_spans(keyed(docs), length, hot)
    again = rows.groupBy("t1", "t2").agg((F.count("*") > 1).alias("again"))

    @F.pandas_udf(BinaryType())
    def strip(text: pd.Series, spans: pd.Series, again: pd.Series, n_bytes: pd.Series) -> pd.Series:
        out = []
        for t, s, more, n in zip(text, spans, again, n_bytes, strict=True):
            data, at, parts = t.encode(), 0, []
            for start, end in [(0, len(data))] if more and n >= length else merged(list(s)) if s is not None else []:
                parts.append(data[at:start])
                at = end
            out.append(b"".join([*parts, data[at:]]))

        return pd.Series(out, dtype=object)

    joined = rows.join(spans, ["t1", "t2"], "left").join(again, ["t1", "t2"])
    return joined.select("row.*", strip("text", "spans", "again", "n_bytes").alias("kept"))
