"""Shared pieces of the training-data operators.

Everything here works on Arrow batches inside tasks or builds DataFrame plans; nothing
collects rows of the corpus to the driver.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled inside a task in pieces of about so many bytes (a longer text is one piece).
CHUNK_BYTES = 1 << 19
#: Tables of so many rows of a few numbers each (some 10 MB) may be broadcast.
FEW_ROWS = 200_000

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes between terms: ASCII that is no letter and no digit.
BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, with only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def row_id(id_col: str, text_col: str):
    """The id as a long; of rows without one a number from 2**62 up, made from the text. Rows
    without an id and with equal texts are copies of each other."""
    own = F.xxhash64(F.coalesce(text_col, F.lit(""))).bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    return F.coalesce(F.col(id_col).cast("long"), own)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else ""
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:  # tests and local runs
        root = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"


#: Whether what a query has shuffled is deleted when the query is done.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: written once as a table in the shared folder and read again. What was shuffled for it goes then."""
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_FREED, "false")
    conf.set(_FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_FREED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table that cut() wrote; nothing that is still to be run may read it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/folio-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, name: str, rows: int = FEW_ROWS) -> DataFrame:
    """The table, written once; with a hint to broadcast it if it has no more than so many rows."""
    df = cut(df, name)
    return F.broadcast(df) if df.count() <= rows else df


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of a batch whose texts hold about limit bytes; a longer text is alone in its slice."""
    col = batch.column(batch.schema.get_field_index(column))
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < len(size):
        yield batch.slice(begin)


def frugal(run):
    """A function over Arrow batches that gives what it has freed back to the system when a task ends:
    Spark keeps Python workers for the tasks of later stages."""

    def with_release(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return with_release


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: dict = {}
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    have = _TABLES.get("powers")
    if have is None or len(have[0]) <= n:
        m = max(n + 1, 4 * CHUNK_BYTES + 1)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if m > 32 * CHUNK_BYTES:
            return tuple(out)  # for one very long text; not kept
        _TABLES["powers"] = have = tuple(out)
    return have


def byte_codes(seed: int = 1) -> np.ndarray:
    """A random 64-bit code for each byte value."""
    return mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1_000_003))


def prefix_hash(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """n + 1 prefix sums from which span_hash gets a polynomial hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes(seed)[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans: equal for equal bytes, wherever they stand."""
    h = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, by default [^\\x20\\x09-\\x0D]+; gap marks the bytes between words. Words never cross rows."""
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def window_hash(word: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of `width` words that begin at each word; only those whose rows agree are valid."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = (h ^ word[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return mix64(h)


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row are marked."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
