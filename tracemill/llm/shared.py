"""Where intermediate tables live, and numpy helpers that several operators use inside tasks."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Lets Spark delete an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``. Where it is unset, a folder of this
    machine is made and set if driver and executors are one process, as in tests; a cluster has to name its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The same rows, cut from their lineage: written as Parquet to the shared folder and read back. What was shuffled
    on the way is of no more use and goes at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(key, doc_id, text, rest), written: key tells rows apart, also those that repeat, for good, however often and on
    whichever executors the table is read later. whole: all columns but the text are in the struct `rest`, so that none
    can clash with a column of an operator; see `own_columns`."""
    rest = [F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("rest")] if whole else []
    return written(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text", *rest), "rows", "zstd")


def own_columns(docs: DataFrame, text=None) -> list:
    """The columns of `docs`, from a table that `keyed` made of it whole."""
    return [(F.col("text") if text is None else text).alias(c) if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]


def held_out(doc_id, modulus: int, remainder: int = 2):
    """True for the documents whose crc32(doc_id as text) leaves this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def text_pieces(batch: pa.RecordBatch, limit: int = 8 << 20):
    """Slices of a batch whose ``text`` holds about `limit` bytes at most (one row at least), with nulls as empty texts."""
    text = batch.column("text").fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    start = 0
    while start < len(text):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start), text.slice(start, stop - start)
        start = stop
    del text
    pa.default_memory_pool().release_unused()  # workers stay between tasks, and memory that Arrow keeps stays theirs


def give_back() -> None:
    """Hands freed memory of this worker back to the machine: workers stay between tasks, and so does what allocators keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def text_bytes(text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins (with the end)."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def binary_array(raw: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    """A view of raw[offsets[i]:offsets[i + 1]] as an Arrow column."""
    offsets, raw = np.ascontiguousarray(offsets, np.int64), np.ascontiguousarray(raw, np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def flat(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column that starts at offset 0."""
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
