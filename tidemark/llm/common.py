"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes, about, that a function on Arrow batches works on at a time.
ROWS_A_BATCH, BYTES_A_BATCH = 1000, 1 << 23
#: A word is a longest run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder in the one that driver and executors share, ``spark.checkpoint.dir``.

    It has to be set on a cluster; a session on one machine, as in tests, gets one in its temporary folder where it is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/tidemark-shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and survives the loss of executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let no more than ROWS_A_BATCH rows come to Python at a time; a lower limit stays.

    Spark bounds a batch by rows, for a whole session.  So the registered queries and the pipeline, whose rows
    hold whole texts, call this; the operators leave their caller's session as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_A_BATCH:
        spark.conf.set(key, str(ROWS_A_BATCH))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = max(1, min(ROWS_A_BATCH, BYTES_A_BATCH * batch.num_rows // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n)


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow for rows with whole texts: run gets slices of ROWS_A_BATCH rows and about BYTES_A_BATCH bytes at most."""
    return df.mapInArrow(lambda batches: run(_sliced(batches)), schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[memoryview, np.ndarray]:
    """The bytes of all texts of a column, and where each begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = column.buffers()
    if not len(column):
        return memoryview(b""), np.zeros(1, np.int64)
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(data)[int(ends[0]) : int(ends[-1])] if data is not None else memoryview(b"")
    return data, ends - ends[0]


def spans(ends: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of whole rows with about ``most`` bytes each (a longer row is a range of its own)."""
    out, first, n = [], 0, len(ends) - 1
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        out.append((first, last))
        first = last
    return out


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit numbers that scatters them (in place)."""
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}
#: Bytes of text that word_hashes takes together.
TOGETHER = 1 << 18


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _P and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            ones = np.full(size, base, np.uint64)
            ones[0] = 1
            _powers[key] = np.multiply.accumulate(ones)
    return _powers["up"], _powers["down"]


def word_hashes(data: memoryview | bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text, A-Z lower-cased, and where each text's words begin and end.

    The hash is a polynomial in scattered byte values, from a running sum over about TOGETHER bytes, cut at
    white space.
    """
    n = len(ends) - 1
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True
    starts = inside & first[:-1]
    starts[1:] |= inside[1:] & ~inside[:-1]
    starts = np.flatnonzero(starts)
    stops = inside & first[1:]
    stops[:-1] |= inside[:-1] & ~inside[1:]
    stops = np.flatnonzero(stops) + 1
    hashes, word = np.empty(len(starts), np.uint64), 0
    while word < len(starts):
        base = int(starts[word])
        last = max(word + 1, int(np.searchsorted(stops, base + TOGETHER, "right")))
        a, b = starts[word:last] - base, stops[word:last] - base
        up, down = _power(int(b[-1]))
        total = np.zeros(int(b[-1]) + 1, np.uint64)
        np.cumsum(_TABLE[_LOWER[raw[base : base + int(b[-1])]]] * up[: int(b[-1])], out=total[1:])
        hashes[word:last] = (total[b] - total[a]) * down[a]
        word = last
    return mix64(hashes), np.searchsorted(starts, ends)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of each k words in a row, sorted; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : len(words) - k + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out + np.uint64(k)))
