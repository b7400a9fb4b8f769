"""Helpers shared by the operators: reading tables, checkpoints, and text as byte arrays in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MULT = np.uint64(0x9E3779B97F4A7C15)
GOLD = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder under the warehouse where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read back, so that its lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what `stored` wrote; nothing that is still to be read may depend on it."""
    for df in tables:
        at = getattr(df, "stored_at", None)
        if at:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def held_out(n: int, r: int):
    """Whether crc32 of the id as text, modulo n, is r; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n == r


# ---- numpy ------------------------------------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64, in a fresh array."""
    x = x + MULT
    x ^= x >> np.uint64(30)
    x *= GOLD
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(off):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most_bytes` of the column's texts or bytes each, whole ones only, so that temporaries stay bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most_bytes, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        release()


def release() -> None:
    """Gives freed memory back to the system: workers live on between tasks, and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def byte_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, to at least n terms; grown by doubling and kept."""
    global _POW
    if len(_POW[0]) < n:
        size = max(n, 2 * len(_POW[0]))
        base = np.full(size, 0x5851F42D4C957F2D, np.uint64)
        base[0] = 1
        inv = np.full(size, pow(0x5851F42D4C957F2D, -1, 1 << 64), np.uint64)
        inv[0] = 1
        _POW = (np.multiply.accumulate(base), np.multiply.accumulate(inv))
    return _POW[0][:n], _POW[1][:n]


_POW: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
#: ASCII letters and digits and every byte of a longer code point belong to words; all else separates them.
IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for each span, equal for equal content wherever it stands."""
    power, inverse = byte_powers(len(codes) + 1)
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes * power[: len(codes)], out=total[1:])
    return mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): the words of all texts in one byte array; words first[i]:first[i + 1] are text i's."""
    inside = IS_WORD[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0] = False
    before[1:] = inside
    cut = off[1:-1]
    cut = cut[cut < len(raw)]
    begins = inside & ~before[:-1]
    begins[cut] = inside[cut]
    after = np.empty(len(raw), bool)
    if len(raw):
        after[:-1] = inside[1:]
        after[-1] = False
        last = off[1:-1] - 1
        after[last[last >= 0]] = False
    start = np.flatnonzero(begins)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


ASCII_LOWER = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)


def words_of(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end); with `lower`, ASCII letters count as lower-case."""
    raw, off = text_bytes(column)
    raw = ASCII_LOWER[raw] if lower else raw
    start, end, first = word_spans(raw, off)
    return span_hashes(BYTE_CODE[raw], start, end), first
