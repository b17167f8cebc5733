"""Documents packed into blocks: one row holds some MB of whole texts.

Multi-pass operators read the corpus several times and each time need to know
what an earlier pass learnt about the same texts. Packing them once into a
table that is bucketed by block lets each pass join its notes (a few bytes for
a text) to the texts without moving the texts through a shuffle again.

A block row: block long, raw long (bytes of text), ids binary (int64), sizes
binary (int64, -1 for a null text), marks binary (16 bytes of digest a text),
data binary (zstd of the UTF-8 texts), rest binary (zstd of an Arrow stream with
further columns of the same rows, or null).
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.session import settle, ship

SCHEMA = "block long, raw long, ids binary, sizes binary, marks binary, data binary, rest binary"
#: Stands for a null id inside blocks; it sorts after every other id.
NULL_ID = np.iinfo(np.int64).max
MARK = 16
#: A block's number is its partition's, with so many bits for its place there; with 20 bits for a row of the block that leaves 27 for partitions.
BLOCK_BITS = 16
_tables: dict[str, list[str]] = {}
#: What this worker keeps from task to task, for one operator at a time.
_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """This worker's cache for an operator; what other operators left there is given back."""
    if operator not in _kept:
        _kept.clear()
        tidy()
        _kept[operator] = {}
    return _kept[operator]


def tidy() -> None:
    """Give memory that is free inside this process back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def tidied(run):
    """A function of batches that gives its free memory back when a task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(bytes(data))


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def text_slices(column: pa.Array) -> tuple[np.ndarray, memoryview, np.ndarray]:
    """Byte offsets, bytes and null mask of a column of strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")
    nulls = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    return offsets, data, nulls


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)


def _stream(columns: list[pa.Array], names: list[str]) -> bytes | None:
    if not names:
        return None
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return squeeze(sink.getvalue())


def _packer(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first = TaskContext.get().partitionId() << BLOCK_BITS
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = ids_of(batch.column(0))
            offsets, data, nulls = text_slices(batch.column(1))
            sizes = np.diff(offsets)
            cuts = np.flatnonzero(np.diff((offsets[1:] - offsets[0]) // block_bytes)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                raw = data[offsets[a] : offsets[b]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [number],
                        "raw": [len(raw)],
                        "ids": [ids[a:b].tobytes()],
                        "sizes": [np.where(nulls[a:b], -1, sizes[a:b]).tobytes()],
                        "marks": [b"".join(hashlib.blake2b(data[x:y], digest_size=MARK).digest() for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist()))],
                        "data": [squeeze(raw)],
                        "rest": [_stream([c.slice(a, b - a) for c in batch.columns[2:]], batch.schema.names[2:])],
                    },
                    pa.schema([("block", pa.int64()), ("raw", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("marks", pa.binary()), ("data", pa.binary()), ("rest", pa.binary())]),
                )
                number += 1
                if number - first == 1 << BLOCK_BITS:
                    raise ValueError(f"{number - first} blocks in one partition")

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, keep: list[str] | None = None) -> DataFrame:
    """Write (id, text) of docs, and the columns named in keep, as a table of blocks, bucketed by block, and read it back.

    A text is never cut; one above block_bytes gets a block of its own size.
    The table stays in the warehouse until release() is called.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep or [])])
    name = f"blocks_{uuid.uuid4().hex}"
    # with fewer buckets than shuffle partitions Spark would deal the blocks anew in each join
    buckets = min(20_000, max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return _stored(rows.mapInArrow(tidied(_packer(block_bytes)), SCHEMA), name, "block", buckets)


def _stored(rows: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    spark = rows.sparkSession
    rows.write.bucketBy(buckets, key).option("compression", "none").saveAsTable(name)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


def by_key(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows as a table bucketed by key, dealt once, so that joins and groups by key don't move them again. It stays until release() is called."""
    buckets = min(20_000, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _stored(rows.repartition(buckets, key), name, key, buckets)


def release(spark: SparkSession, names: list[str] | None = None) -> None:
    """Drop tables that pack() and by_key() have written in this application: those named, or all."""
    own = _tables.get(spark.sparkContext.applicationId, [])
    for name in list(own) if names is None else names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        if name in own:
            own.remove(name)


def finished(spark: SparkSession, build) -> DataFrame:
    """build() written to the shared folder, without the tables that it packed on the way; for small results."""
    before = set(_tables.get(spark.sparkContext.applicationId, []))
    try:
        return settle(build())
    finally:
        release(spark, [x for x in _tables.get(spark.sparkContext.applicationId, []) if x not in before])


class Block:
    """One block's texts. null: bool of each text; start: byte bounds."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.null = sizes < 0
        self.bounds = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
        self.data = expand(row["data"])
        self._rest = row.get("rest")

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]]

    def rest(self) -> pa.RecordBatch:
        """The further columns that pack() was told to keep."""
        return pa.ipc.open_stream(expand(self._rest)).read_next_batch()
