"""What the corpus operators share: tables, cutting lineage, whole texts as numpy arrays, ragged arrays.

Texts travel as Arrow batches.  :func:`chunks` hands them on as one byte array with row offsets, in
pieces of about ``CHUNK`` bytes, so that the numpy temporaries stay small whatever a batch holds.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # texts are long: 10,000 of them are too much for a worker
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder; one of its own only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not sc.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="leontia-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FILTER_BITS, _PAGE = 1 << 24, 1 << 15


def likely_in(df: DataFrame, keys: DataFrame, columns: list[str], mark: str | None = None) -> DataFrame:
    """The rows of ``df`` whose key may be in ``keys``: none that is gets lost, most others go before a shuffle.

    With ``mark``, all rows, and that column says which.  A bit vector of hashed keys, of fixed size (2 MB), is what is
    broadcast, however many keys there are; beyond some 10^7 keys it lets more and more of the others pass.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(_FILTER_BITS))
    pages = keys.select(F.floor(place / _PAGE).alias("likely_page"), F.pmod(place, F.lit(_PAGE)).alias("p")).groupBy("likely_page").agg(F.bitmap_construct_agg("p").alias("likely_bits"))
    at = df.withColumn("likely_place", place).withColumn("likely_page", F.floor(F.col("likely_place") / _PAGE))
    byte = F.expr("conv(hex(substring(likely_bits, cast(likely_place % 32768 div 8 as int) + 1, 1)), 16, 10)").cast("int")
    bit = F.expr("cast(likely_place % 8 as int)")
    hit = F.coalesce((F.call_function("shiftright", byte, bit) % 2) == 1, F.lit(False))
    found = at.join(F.broadcast(pages), "likely_page", "left")
    return found.select(*df.columns, hit.alias(mark)) if mark else found.where(hit).select(*df.columns)


#: A key with more rows than this is hot; it is dealt to SALTS tasks.
HOT, SALTS = 10_000, 64


def spread_join(df: DataFrame, by: DataFrame, *keys: str, how: str = "inner", times: str | None = None) -> DataFrame:
    """``df`` joined with ``by``, which has one row a key: the rows of a hot key are spread over ``SALTS`` tasks by a hash of all their columns.

    Which keys are hot says the column ``times`` of ``by``, or a count, with partial sums before the shuffle; both sides look it up
    in one bit vector, so a key that is only taken for hot is still joined right.
    """
    counts = by if times else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    hot = counts.where(F.col(times or "times") > HOT).select(*keys)
    left = likely_in(df, hot, list(keys), mark="hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).otherwise(0).cast("int")
    right = likely_in(by, hot, list(keys), mark="hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("salt", F.explode(salts)).drop("hot")
    return left.withColumn("salt", salt).drop("hot").join(right, [*keys, "salt"], how).drop("salt")


def trim() -> None:
    """Hand free memory back to the system: workers are used again by tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near inputs give unrelated values."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h ^= h >> _U(27)
    h *= _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def counter_hash(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values by rule."""
    return mix(mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each place, as one integer; zeros follow the end."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(n + 1, _U)
    for k in range(min(8, n + 1)):
        part = out[k::8]
        part[:] = np.frombuffer(padded, "<u8", len(part), k)
    return out


def span_hash(words: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans of the data of :func:`eights`, equal for equal bytes wherever they stand.

    Each eight bytes are mixed into the state by a bijection, so no pattern of bytes cancels out.
    """
    size = end - start
    h = mix(size.astype(_U) * _U(0xA24BAED4963EE407) + _U(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1))
    least, most = (int(size.min()), int(size.max())) if len(size) else (0, 0)
    for k in range(0, most, 8):
        if k + 8 <= least:
            h = mix(h ^ words[start + k])
            continue
        live = np.flatnonzero(size > k)
        h[live] = mix(h[live] ^ (words[start[live] + k] & _MASK[np.minimum(size[live] - k, 8)]))
    return h


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of row groups of about ``size`` bytes; a row is never split."""
    data, off = strings(batch.column(column))
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number per row) of the runs of bytes outside 32 and 9 to 13; none crosses a row."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    first, last = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] |= word[1:-1][inner]
    last[inner - 1] |= word[1:-1][inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, off))


def row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[0]-1, 0 .. counts[1]-1, ..."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def take_ragged(flat: np.ndarray, start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The pieces flat[start[i] : start[i] + counts[i]], one after another."""
    return flat[np.repeat(start, counts) + ramp(counts)]


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive offsets."""
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[off[1:]] - run[off[:-1]]


def coded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span's text among the distinct ones, the first span of each text); spans ascend and do not overlap.  Exact."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    off = np.empty(2 * n + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    off[:-1:2], off[1::2], off[-1] = start, end, end[-1]  # every second element is a gap
    kind = pa.binary() if off.dtype == np.int32 else pa.large_binary()
    found = pa.Array.from_buffers(kind, 2 * n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    codes = found.indices.to_numpy()[::2]
    first = np.full(len(found.dictionary), n)
    first[codes[::-1]] = np.arange(n - 1, -1, -1)
    used = first < n
    return (np.cumsum(used) - 1)[codes], first[used]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words per row); a word is hashed once a chunk."""
    start, end, counts = word_spans(data, off)
    codes, first = coded(data, start, end)
    return span_hash(eights(data), start[first], end[first])[codes], counts


_TERMS = counter_hash(16, 31) | _U(1)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of k words, windows per row), in order; a row of 1 to k-1 words has one window of them all."""
    if not len(words):
        return np.zeros(0, _U), np.zeros(len(counts), np.int64)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    start = np.repeat(np.cumsum(counts) - counts, n) + ramp(n)
    width = np.repeat(np.minimum(counts, k), n)
    total = width.astype(_U)
    for j in range(k):
        total += np.where(width > j, words[np.minimum(start + j, len(words) - 1)] * _TERMS[j], _U(0))
    return mix(total), n


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in ((n, columns[n]) for n in schema.names)], schema=schema)


class _Growing:
    """An array that is appended to."""

    def __init__(self, dtype):
        self.room, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.room):
            room = np.zeros(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : end] = values
        self.n = end


class WordCache:
    """Token lists of distinct words, kept from batch to batch under sorted hashes; a word found is compared byte by byte.

    ``encode`` takes a list of words (bytes) and returns (flat ids, number of ids of each).  Words over ``LONG`` bytes, and
    words that share their hash with another, are encoded anew in each chunk.  Beyond ``limit`` words the cache starts anew, so
    a worker's memory is bounded.
    """

    LONG = 64

    def __init__(self, encode, dtype, limit: int = 1_500_000):
        self.encode, self.dtype, self.limit = encode, dtype, limit
        self._clear()

    def _clear(self) -> None:
        self.sorted = [(np.zeros(0, _U), np.zeros(0, np.int64))] * 2  # (hashes, places): many, and those that came since
        self.start, self.count, self.flat = _Growing(np.int64), _Growing(np.int32), _Growing(self.dtype)
        self.at, self.size, self.bytes = _Growing(np.int64), _Growing(np.int32), _Growing(np.uint8)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, places in self.sorted:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, places[at], out)
        return out

    def _keep(self, hashes: np.ndarray, places: np.ndarray) -> None:
        many, few = self.sorted
        few = tuple(np.concatenate(x) for x in zip(few, (hashes, places)))
        if len(few[0]) > max(1 << 15, len(many[0]) // 4):
            many, few = tuple(np.concatenate(x) for x in zip(many, few)), (np.zeros(0, _U), np.zeros(0, np.int64))
            order = np.argsort(many[0])
            many = many[0][order], many[1][order]
        else:
            order = np.argsort(few[0])
            few = few[0][order], few[1][order]
        self.sorted = [many, few]

    def _encoded(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, count = self.encode([raw[s:e] for s, e in zip(start.tolist(), end.tolist())]) if len(start) else ([], [])
        return np.asarray(flat, self.dtype), np.asarray(count, np.int64)

    def lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per word) of the given spans, which ascend and do not overlap."""
        codes, first = coded(data, start, end)
        raw, s, e = data.tobytes(), start[first], end[first]  # of the distinct words
        hashes = span_hash(eights(data), s, e)
        place = self._find(hashes)
        if self.size.n + int((place < 0).sum()) > self.limit and self.size.n:
            self._clear()
            place[:] = -1
        known = np.flatnonzero(place >= 0)
        size = (e - s)[known]
        same = self.size.room[place[known]] == size
        known, size = known[same], size[same]
        other = take_ragged(data, s[known], size) != take_ragged(self.bytes.room, self.at.room[place[known]], size)
        equal = np.zeros(len(first), bool)
        equal[known[sums(other, np.concatenate([[0], np.cumsum(size)])) == 0]] = True
        fresh = np.flatnonzero((place < 0) & (e - s <= self.LONG))
        fresh = fresh[np.unique(hashes[fresh], return_index=True)[1]]
        flat, count = self._encoded(raw, s[fresh], e[fresh])
        place[fresh] = self.size.n + np.arange(len(fresh))
        self._keep(hashes[fresh], place[fresh])
        self.start.add(self.flat.n + np.cumsum(count) - count)
        self.count.add(count)
        self.flat.add(flat)
        size = (e - s)[fresh]
        self.at.add(self.bytes.n + np.cumsum(size) - size)
        self.size.add(size)
        self.bytes.add(take_ragged(data, s[fresh], size))
        equal[fresh] = True
        rest = np.flatnonzero(~equal)
        more, more_count = self._encoded(raw, s[rest], e[rest])
        begin, number = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        begin[equal], number[equal] = self.start.room[place[equal]], self.count.room[place[equal]]
        begin[rest], number[rest] = self.flat.n + np.cumsum(more_count) - more_count, more_count
        if len(more):
            short = take_ragged(self.flat.room, begin[equal], number[equal])
            begin[equal] = np.cumsum(number[equal]) - number[equal]
            begin[rest] += len(short) - self.flat.n
            return take_ragged(np.concatenate([short, more]), begin[codes], number[codes]), number[codes]
        return take_ragged(self.flat.room, begin[codes], number[codes]), number[codes]
