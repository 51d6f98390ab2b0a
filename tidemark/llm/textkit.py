"""Vectorised byte and word helpers shared by the text operators of this subpackage.

A task gets Arrow batches of whole texts; :func:`chunks` cuts them into runs of
documents of about a megabyte, so that NumPy's temporaries stay small however
large the batch is. A document is never cut.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random odd 64-bit value per byte.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes of words that are hashed at once.
_AT_ONCE = 1 << 21
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but space, tab, line feed, vertical tab, form feed, carriage return.
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
LOWER_TABLE = bytes(LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift-multiply)."""
    x = (x ^ (x >> U64(31))) * U64(0x9E6C63D0876A9A47)
    x = (x ^ (x >> U64(29))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of documents: the rows, their bytes in one array, and where each text starts in it (one more for the end). Null texts are empty."""
    col = batch.column(batch.schema.get_field_index(text))
    n = len(col)
    if n == 0:
        return
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    else:
        off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n, i + 20_000)
        yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each document (one more for the end)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = is_word[buf]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | first[1:-1]
    end = w.copy()
    end[:-1] &= ~w[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def _places(n: int) -> np.ndarray:
    """A random odd 64-bit value for each of the first n places in a word, however long it is."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0xD1B54A32D192ED03)) | U64(1)


_SHORT = _places(4096)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _AT_ONCE)))
        a, z, size = starts[i], ends[j - 1], ends[i:j] - starts[i:j]
        room = np.diff(np.append(starts[i:j], z))
        place = np.arange(a, z) - np.repeat(starts[i:j], room)
        longest = int(size.max())
        value = _SHORT if longest <= len(_SHORT) else _places(longest)
        inside = place < np.repeat(size, room)
        val = _BYTE[buf[a:z]] * value[np.where(inside, place, 0)] * inside
        out[i:j] = mix(np.add.reduceat(val, starts[i:j] - a) + size.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        i = j
    return out


def shingle_sets(wh: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; without words, none."""
    n = len(wh)
    sh = np.zeros(0, np.uint64)
    if n >= k:
        sh = wh[: n - k + 1] * U64(0xA24BAED4963EE407)
        for i in range(1, k):
            sh = mix(sh) + wh[i : n - k + 1 + i] * U64(0x9FB21C651E98DF25 + 2 * i)
        sh = mix(sh)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(sh[a : b - k + 1])
        elif b > a:
            h = U64(0x5851F42D4C957F2D * (b - a) % 2**64)
            for x in wh[a:b]:
                h = mix(np.array([h], np.uint64))[0] ^ x
            yield mix(np.array([h], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def crc_mod(column: str, mod: int):
    """crc32 of the id as text, modulo mod, as a column."""
    return F.crc32(F.col(column).cast("string")) % mod


def checkpoint_ready(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder that the session names in spark.checkpoint.dir. Without one, only a session on one machine gets a folder of its own; a cluster's can't be guessed."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder, so that they outlive any executor."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more: it does so when the driver collects its garbage, which else may not come for long. The session refers to the last query until it has run another."""
    for _ in range(3):  # what one pass frees may have been all that held the rest; references between Python and the JVM go a moment later
        gc.collect()
        time.sleep(0.5)
        spark.range(1).count()
        spark.sparkContext._jvm.System.gc()


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 62, weight: str | None = None) -> Iterator[pa.Table]:
    """From rows sorted by keys, tables of whole groups (many small ones together, about a batch each)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        k = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in keys]
        new = np.zeros(b.num_rows, dtype=bool)
        for x in k:
            new[1:] |= x[1:] != x[:-1]
        if held:
            last = held[-1]
            new[0] = any(last.column(last.schema.get_field_index(c))[-1].as_py() != b.column(b.schema.get_field_index(c))[0].as_py() for c in keys)
        else:
            new[0] = False
        at = np.flatnonzero(new)
        if len(at) == 0:
            held.append(b)
            continue
        if at[-1] or held:
            yield pa.Table.from_batches([*held, b.slice(0, int(at[-1]))])
        held = [b.slice(int(at[-1]))]
    if held:
        yield pa.Table.from_batches(held)
