"""Operator 12: token ids in files of independent zstandard frames with a trailing seek table.

A file holds the ids of a range of documents, one after the other:

* data frames of ``FRAME`` ids each (the last may be shorter), little-endian, two bytes an id where the
  vocabulary allows it, else four;
* directory frames of ``DIRECTORY`` documents each: their ids, whether the id is null, their numbers of tokens;
* a root frame: sizes, and the first document of each directory frame;
* the seek table of the public zstandard seekable format, a skippable frame with the compressed size,
  the size and a checksum (the low half of XXH64) of every frame.

A reader takes the seek table and the root, then only those frames that hold what it was asked for,
and checks each frame's checksum; any zstandard tool can decompress a file too.

Documents are dealt to files by ranges of doc_id (and of a hash of the text, so that a repeated id is
split), hence files and documents are in ascending order.  A task streams its documents into a file
of a name of its own and reports the file as a row; these rows are written by Spark, so a task
that ran twice leaves a file that no row names and nobody reads.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.packing import END_ID, load_tokenizer
from graphloom.llm.store import materialise

FRAME = 65_536  #: ids of a data frame
DIRECTORY = 16_384  #: documents of a directory frame
UNIT = 64  #: data frames that a reading task takes at a time
UNITS = 16  #: units of a reading task, where there are many
BATCH_IDS = 1_000_000  #: ids of a batch that a reading task sends on, unless one document has more
LEVEL = 3
# fixed values of the public zstandard seekable format
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
ROOT = struct.Struct("<8sHIIQQI")  #: name, width of an id, FRAME, data frames, documents, tokens, directory frames
NAME = b"TOKFRAME"
FILES = "file string, first_doc long, first_hash long, last_doc long, n_docs long, n_tokens long, n_frames long"


class FrameWriter:
    """Writes documents to a binary sink, in the order of the calls of :meth:`add`."""

    def __init__(self, sink, width: int, per_frame: int = FRAME):
        self.sink, self.kind, self.per_frame, self.compressor = sink, f"<u{width}", per_frame, zstandard.ZstdCompressor(level=LEVEL)
        self.entries: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.waiting = self.tokens = 0
        self.ids, self.nulls, self.sizes = array("q"), array("b"), array("q")

    def _frame(self, data: bytes) -> None:
        packed = self.compressor.compress(data)
        self.sink.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids))
        self.held.append(ids.astype(self.kind))
        self.waiting += len(ids)
        self.tokens += len(ids)
        if self.waiting >= self.per_frame:
            rest = np.concatenate(self.held)
            full = len(rest) // self.per_frame * self.per_frame
            for at in range(0, full, self.per_frame):
                self._frame(rest[at : at + self.per_frame].tobytes())
            self.held, self.waiting = [rest[full:].copy()], len(rest) - full

    def close(self) -> int:
        """Write what is left, the directory and the seek table; the number of data frames."""
        if self.waiting:
            self._frame(np.concatenate(self.held).tobytes())
        frames, first, starts = len(self.entries), [], np.cumsum([0, *self.sizes])
        for at in range(0, len(self.ids), DIRECTORY):
            part = slice(at, at + DIRECTORY)
            first.append((int(starts[at]), self.ids[at], self.nulls[at]))
            self._frame(b"".join(np.frombuffer(x[part], x.typecode).astype(k).tobytes() for x, k in ((self.ids, "<i8"), (self.sizes, "<i8"), (self.nulls, "i1"))))
        root = ROOT.pack(NAME, int(self.kind[2:]), self.per_frame, frames, len(self.ids), self.tokens, len(first))
        self._frame(root + b"".join(struct.pack("<qqb", *x) for x in first))
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        return frames


class FrameReader:
    """Reads documents from a seekable binary source of ``size`` bytes.  ``touched`` has the numbers of
    the frames that were decompressed."""

    def __init__(self, source, size: int):
        self.source, self.touched, self.last = source, set(), (-1, b"")
        count, flags, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = self._bytes(size - 9 - 12 * count, 12 * count)
        self.entries = list(struct.iter_unpack("<III", table))
        self.at = np.cumsum([0, *(e[0] for e in self.entries)])
        root = self.frame(count - 1)
        name, width, self.per_frame, self.frames, self.n_docs, self.tokens, groups = ROOT.unpack_from(root)
        if name != NAME:
            raise ValueError("not a file of token frames")
        self.kind = f"<u{width}"
        self.first = [struct.unpack_from("<qqb", root, ROOT.size + 17 * g) for g in range(groups)]

    def _bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            packed, size, checksum = self.entries[i]
            data = zstandard.ZstdDecompressor().decompress(self._bytes(int(self.at[i]), packed), max_output_size=size)
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {i} differs from its checksum")
            self.touched.add(i)
            self.last = (i, data)
        return self.last[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at places start to end of the file."""
        out = []
        for i in range(start // self.per_frame, -(-end // self.per_frame)):
            base = i * self.per_frame
            out.append(np.frombuffer(self.frame(i), self.kind)[max(0, start - base) : end - base].astype("<u4"))
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def group(self, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc_id, is null, start) of the documents of a directory frame; start has one number more."""
        data = self.frame(self.frames + g)
        n = len(data) // 17
        sizes = np.frombuffer(data, "<i8", n, 8 * n)
        return np.frombuffer(data, "<i8", n), np.frombuffer(data, "i1", n, 16 * n) != 0, self.first[g][0] + np.cumsum([0, *sizes])

    def between(self, start: int, end: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of the documents that start at places start to end."""
        begins = [x[0] for x in self.first]
        for g in range(max(0, int(np.searchsorted(begins, start, "right")) - 1), int(np.searchsorted(begins, end))):
            doc, null, at = self.group(g)
            for i in range(int(np.searchsorted(at[:-1], start)), int(np.searchsorted(at[:-1], end))):
                yield None if null[i] else int(doc[i]), int(at[i]), self.ids(int(at[i]), int(at[i + 1]))

    def find(self, doc_id: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start, ids) of each document of that id."""
        for g, (_, head, empty) in enumerate(self.first):
            if not empty and head > doc_id:
                break
            if g + 1 < len(self.first) and (self.first[g + 1][2] or self.first[g + 1][1] < doc_id):
                continue
            doc, null, at = self.group(g)
            for i in np.flatnonzero((doc == doc_id) & ~null).tolist():
                yield doc_id, int(at[i]), self.ids(int(at[i]), int(at[i + 1]))


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, ranks: str | None = None, end_id: int = END_ID, per_frame: int = FRAME) -> DataFrame:
    """Write the ids of every row of ``docs`` to files in the folder ``path``; one row for each file:
    file, first_doc, first_hash, last_doc, n_docs, n_tokens, n_frames.

    ``docs`` has doc_id and text; other columns are ignored, whatever their names.  Documents are in
    ascending order of doc_id, null ones first, and of a hash of the text within an id.  Each ends with
    ``end_id``; null and empty texts are that id alone.  Repeated rows are written each.  Texts of any
    length are taken whole.  An empty table makes no file and no row.  ``path`` is a folder that all
    executors reach, as a URI or a local path; ``tokenizer`` and ``ranks`` as in
    :func:`graphloom.llm.packing.load_tokenizer`.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = sink = encode = None
        first = last = None
        for batch in batches:
            for doc, text, h in zip(*batch.columns, strict=True):
                if writer is None:
                    from tokenizers import Tokenizer

                    encode = load_tokenizer(tokenizer, ranks)
                    width = 2 if max(end_id, Tokenizer.from_file(tokenizer).get_vocab_size()) < 1 << 16 else 4
                    file = f"{path}/{uuid.uuid4().hex}.tok.zst"
                    system, place = _filesystem(file)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    sink = system.open_output_stream(place, compression=None)  # by its name it would be compressed again
                    writer, first = FrameWriter(sink, width, per_frame), (doc.as_py(), h.as_py())
                last = doc.as_py()
                writer.add(last, np.append(encode(text.as_py() or ""), np.uint32(end_id)))
        if writer is not None:
            frames = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (file, *first, last, len(writer.ids), writer.tokens, frames), strict=True))], schema)

    schema = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("first_doc", "first_hash", "last_doc", "n_docs", "n_tokens", "n_frames"))])
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    return materialise(rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").mapInArrow(write, FILES), "token-files")


def placed(files: DataFrame) -> DataFrame:
    """The files with ``file_start``, the ids of all files before each.  The driver sees one row a file."""
    spark, total, rows = files.sparkSession, 0, []
    for r in files.orderBy(F.asc_nulls_first("first_doc"), "first_hash").collect():
        rows.append((*r, total))
        total += r.n_tokens
    return spark.createDataFrame(rows, f"{FILES}, file_start long")


def _documents(found: Iterator[tuple[int | None, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        doc, start, ids = zip(*held, strict=True)
        columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    for row in found:
        if held and size + len(row[2]) > BATCH_IDS:
            yield batch()
            held, size = [], 0
        held.append(row)
        size += len(row[2])
    if held:
        yield batch()


def _readers(rows: Iterator[dict]) -> Iterator[tuple[dict, FrameReader]]:
    """Each row with the reader of its file; rows of one file in a row share it."""
    source = reader = name = None
    for row in rows:
        if row["file"] != name:
            if source is not None:
                source.close()
            name = row["file"]
            system, place = _filesystem(name)
            source = system.open_input_file(place)
            reader = FrameReader(source, source.size())
        yield row, reader
    if source is not None:
        source.close()


DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of ``files`` (what :func:`write_tokens` returns):
    ``start`` counts the ids of all documents before it, ``ids`` are unsigned 32-bit, little-endian.
    No files give an empty table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int | None, int, np.ndarray]]:
            for row, reader in _readers(row for batch in batches for row in batch.to_pylist()):
                ids_a_unit = UNIT * reader.per_frame
                for doc, at, ids in reader.between(row["unit"] * ids_a_unit, (row["unit"] + 1) * ids_a_unit):
                    yield doc, row["file_start"] + at, ids

        yield from _documents(found())

    files = placed(files)
    last = F.floor((F.col("n_frames") - 1) / UNIT)
    units = files.select("file", "file_start", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("unit"))
    # rows are few and their work is large: the number of tasks follows the units, not the bytes of these rows
    count = files.agg(F.sum(last + 1)).first()[0] or 1
    tasks = max(-(-count // UNITS), min(count, 2 * files.sparkSession.sparkContext.defaultParallelism))
    return units.repartition(tasks, "file", "unit").sortWithinPartitions("file", "unit").mapInArrow(read, DOCUMENTS)


def find_tokens(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """As :func:`read_tokens`, only the documents whose doc_id is in ``wanted``; frames without them aren't
    decompressed.  Null and unknown ids find nothing, repeated ones count once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int, np.ndarray]]:
            for row, reader in _readers(row for batch in batches for row in batch.to_pylist()):
                for doc, at, ids in reader.find(row["doc_id"]):
                    yield doc, row["file_start"] + at, ids

        yield from _documents(found())

    ids = wanted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    inside = (F.col("doc_id") >= F.coalesce("first_doc", F.lit(-(1 << 63)))) & (F.col("doc_id") <= F.col("last_doc"))
    files = placed(files)
    asked = ids.join(F.broadcast(files), inside).select("file", "file_start", "doc_id")  # one row a file
    return asked.repartition(max(1, files.count()), "file").sortWithinPartitions("file", "doc_id").mapInArrow(read, DOCUMENTS)
