"""Session plumbing shared by the training-data operators: reads, shared-folder tables, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import prepare

#: Rows and bytes in one Arrow batch; a batch of very long texts stays inside a worker's memory.
BATCH_ROWS = 4096
BATCH_BYTES = 1 << 20
#: Bytes of text that a Python worker works on at once, and what a row counts besides its text.
SHARD_BYTES = 1 << 20
ROW_BYTES = 64

_written: list[tuple[SparkSession, str]] = []


def tuned(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, one process that is driver and executor has a temporary one, as in
    tests; on a cluster that would be a folder of one machine, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/larkspur-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more, and the shuffle files of what wrote them."""
    for df in tables:
        files = df.inputFiles()
        for entry in [x for x in _written if files and x[1].rsplit("/", 1)[1] in files[0]]:
            spark, path = entry
            _written.remove(entry)
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            spark.sparkContext._jvm.System.gc()  # Spark deletes shuffles when their plans are collected


def release() -> None:
    """Deletes the tables that stored() has written; call it when their results are no longer read."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; so is the need
            return


atexit.register(release)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row begins (n + 1 offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset or column.buffers()[1] is None:
        column = pa.concat_arrays([column, pa.array([], pa.large_string())])
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


#: Caches of worker processes, by use; a task drops those that it does not name.
caches: dict[str, dict] = {}


def shards(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SHARD_BYTES, keep: str = "") -> Iterator[pa.Table]:
    """Groups or splits Arrow batches to about `size` bytes of text; a row is never split."""
    for use, cache in caches.items():
        if use != keep:
            cache.clear()
    held: list[pa.RecordBatch] = []
    got = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lens = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) + ROW_BYTES
        ends, first = np.cumsum(lens), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + size - got, "right")))
            held.append(batch.slice(first, last - first))
            got += int(ends[last - 1] - before)
            first = last
            if got >= size or first < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, got = [], 0
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: workers stay for later tasks, beside others'."""
    from . import bytesops

    bytesops._powers.clear()  # rebuilt in milliseconds; a worker may wait for long beside busy ones
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class KeyBitmap:
    """A one-hash Bloom filter over long keys: no false negatives, so it only saves shuffled rows.

    It has some 32 bits for each key, and never more than `1 << bits` however many there are; a full one filters
    nothing and results stay whole.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = 26):
        self.bits = bits = max(16, min(bits, int(32 * keys.count()).bit_length()))
        spot = F.expr(f"(`{column}` & {(1 << bits) - 1}L) + 1")
        rows = keys.groupBy(F.bitmap_bucket_number(spot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("b")).collect()
        flat = np.zeros(1 << (bits - 3), np.uint8)
        for r in rows:  # at most 2^(bits - 15) rows of 4 KiB
            at = (r["k"] - 1) << 12
            flat[at : at + len(r["b"])] |= np.frombuffer(bytes(r["b"]), np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(flat)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.astype(np.int64) & ((1 << self.bits) - 1)
        return (self.shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def pick(self, batches: Iterator[pa.RecordBatch], column: str, wanted: bool) -> Iterator[pa.RecordBatch]:
        """The rows whose key may be held (wanted), or is surely not."""
        for batch in batches:
            flags = self.has(batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False))
            part = batch if (flags == wanted).all() else batch.filter(pa.array(flags == wanted))
            if part.num_rows:
                yield part

    def maybe(self, docs: DataFrame, column: str) -> DataFrame:
        """The rows of docs whose key may be held."""
        return docs.mapInArrow(lambda batches: self.pick(batches, column, True), ddl(docs, docs.columns))


def ddl(df: DataFrame, columns: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def text_key() -> F.Column:
    """With doc_id, what identifies a document: rows of equal id and text are one document."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk")
