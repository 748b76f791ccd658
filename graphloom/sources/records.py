"""Record containers: records of bytes, each behind its length as a base-128 varint, ended by -1.

A data source for files ending in .rio (gzip where they end in .gz), read and written by executors.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = (1 << 32) - 1  #: -1 as an unsigned 32-bit varint


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def read_varint(file) -> int | None:
    shift = value = 0
    while b := file.read(1):
        value |= (b[0] & 0x7F) << shift
        shift += 7
        if b[0] < 0x80:
            return value
    return None


def records(data: bytes) -> Iterator[bytes]:
    """Records of a container, up to its end mark or its last whole record."""
    file = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while (n := read_varint(file)) is not None and n != END:
        record = file.read(n)
        if len(record) < n:
            return
        yield record


def container(rows: list[bytes], compress: bool = False) -> bytes:
    data = b"".join(varint(len(r)) + r for r in rows) + varint(END)
    return gzip.compress(data, mtime=0) if compress else data


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, record): the records of every container under ``path``.

    Spark's own reader lists and opens the files, so any store it knows will do; a container is
    one file and can't be split, as its format has no marks to start from.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[bytes] = []
                start = 0
                for i, r in enumerate(records(data.as_py())):
                    rows.append(r)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows)), pa.array(range(start, i + 1), pa.int64()), pa.array(rows, pa.binary())], ["path", "pos", "record"])
                        rows, start = [], i + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows)), pa.array(range(start, start + len(rows)), pa.int64()), pa.array(rows, pa.binary())], ["path", "pos", "record"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, pos long, record binary")


def pack_containers(rows: DataFrame, record: str = "record", compress: bool = False) -> DataFrame:
    """(container): one container for each partition of ``rows``, as bytes; for a sink of whole files."""

    def run(batches):
        import pyarrow as pa

        found = [r for batch in batches for r in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([container(found, compress)], pa.binary())], ["container"])

    return rows.select(F.col(record).cast("binary")).mapInArrow(run, "container binary")
