"""Helpers shared by the text operators: scratch tables and byte-level kernels."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
WORD = r"[^\x20\x09-\x0D]+"

U = np.uint64
#: Base of the polynomial hashes: any odd 64-bit number.
BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, U), np.ones(1, U)]
#: Paths of the scratch tables of this process.
_made: list[str] = []
#: Words are hashed in runs of about so many signs.
SPAN = 1 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where driver and executors are one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        named = spark.sparkContext.getCheckpointDir()
        if named:
            return named.rsplit("/", 1)[0]
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="platen-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/platen/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many scratch tables there have been."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Removes the scratch tables made since then, but for the last few. Only when all that is read from them has been written elsewhere."""
    stop = len(_made) - keep
    for i in range(since, stop):
        if _made[i]:
            path = spark._jvm.org.apache.hadoop.fs.Path(_made[i])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _made[i] = ""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without_spaces(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept between calls."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, _INV)):
            p = np.full(n, b, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the words b[s:e] of bytes or code points, run by run, so that memory follows SPAN and not the text."""
    out = np.empty(len(s), U)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + SPAN, side="right")))
        low, high = int(s[i]), int(e[j - 1])
        total = 0
        for at in range(low, high, SPAN):  # more than one run only for a word longer than that
            part = b[at : min(at + SPAN, high)]
            up, down = powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, U)
            np.cumsum((part.astype(U) + U(1)) * up[:-1], out=sums[1:])
            if high - low <= SPAN:
                out[i:j] = (sums[e[i:j] - low] - sums[s[i:j] - low]) * down[s[i:j] - low]
            else:
                total = (total + int(sums[-1]) * pow(BASE, at - low, 1 << 64)) % (1 << 64)
                out[i] = total
        i = j
    return mix(out + (e - s).astype(U))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array (null: empty) and its n + 1 offsets, without copying per row."""
    import pyarrow as pa

    column = column.cast(pa.string()) if column.type != pa.string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batches, column: str, limit: int):
    """Arrow batches cut so that no block holds much more than limit bytes of the column; a longer single text stands alone."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0))
        whole = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            base = whole[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(whole, base + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
