"""Token ids in binary shards with Elias-Fano document boundaries.

A shard holds consecutive documents in ascending ``doc_id``: one concatenated id array, and two
non-decreasing sequences, the documents' end offsets and their ids less the first, each Elias-Fano coded:
the low bits packed, the high parts as a bit vector with a one for each element, and the place of every
``SAMPLE``-th one.  :meth:`EliasFano.select` reads offsets from that, many at once; no table of 64-bit offsets is stored,
and the reader makes none: it selects the offsets of ``READ`` documents at a time.

Texts are encoded once per distinct piece between ASCII white space, by the tokenizers library; the
tokenizer drops white space and none of its pieces crosses it, so the concatenation is what the library
gives for the whole text.  Shards are rows of a Parquet table in the shared folder, so any store that
Spark writes will do, and a lost task is written again.

Cases: a null or empty text has the end id alone; repeated ids and rows are kept, each with its own
boundaries; rows with a null doc_id come first, in shards of their own that say so, and are read back with null ids; an empty table writes no shard; a shard is closed after ``SHARD_IDS`` ids, so a very long
text makes a longer shard but is never cut.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leontia.llm.common import WordCache, batch_of, chunks, cut, row_of, word_spans

MAGIC, SAMPLE, SHARD_IDS, READ = b"LEFT0002", 64, 1 << 20, 4096
_CACHES: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    """This worker's tokenizer with the words it has met."""
    if path not in _CACHES:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        dtype = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

        def encode(words: list[bytes]):
            ids = [e.ids for e in tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
            return [x for one in ids for x in one], [len(one) for one in ids]

        _CACHES[path] = WordCache(encode, dtype)
    return _CACHES[path]


def encode_rows(cache: WordCache, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, ids per text), the end id after each text."""
    start, end, words = word_spans(data, off)
    flat, count = cache.lookup(data, start, end)
    per_row = np.bincount(row_of(words), weights=count, minlength=len(words)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    return np.insert(flat, np.cumsum(per_row), end_id), per_row + 1


def ef_encode(values: np.ndarray) -> bytes:
    """Elias-Fano form of a non-decreasing sequence of integers >= 0."""
    n = len(values)
    values = np.asarray(values, np.uint64)
    top = int(values[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    lows, highs = np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()
    marks = ones[::SAMPLE].astype("<u4").tobytes()
    return struct.pack("<QBII", n, low, len(lows), len(highs)) + lows + highs + marks


class EliasFano:
    """A coded sequence; ``size`` is its length in bytes."""

    def __init__(self, raw: memoryview):
        self.n, self.low, lows, highs = struct.unpack_from("<QBII", raw)
        at = struct.calcsize("<QBII")
        self.lows = np.frombuffer(raw, np.uint8, lows, at)
        self.highs = np.frombuffer(raw, np.uint8, highs, at + lows)
        self.marks = np.frombuffer(raw, "<u4", -(-self.n // SAMPLE), at + lows + highs)
        self.size = at + lows + highs + 4 * len(self.marks)

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.low + np.arange(self.low)
        bit = (self.lows[at >> 3] >> (at & 7).astype(np.uint8)) & 1 if self.low else np.zeros((len(i), 0), np.uint8)
        return (bit.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.int64)

    def select(self, i: np.ndarray) -> np.ndarray:
        """The elements at the places ``i``, which ascend: from the nearest sampled one before each, and the bits between."""
        if not len(i):
            return np.zeros(0, np.int64)
        first = int(i[0]) // SAMPLE
        byte = int(self.marks[first]) >> 3
        stop = int(i[-1]) // SAMPLE + 1
        end = (int(self.marks[stop]) >> 3) + 1 if stop < len(self.marks) else len(self.highs)
        ones = np.flatnonzero(np.unpackbits(self.highs[byte:end], bitorder="little")) + 8 * byte
        skip = int(np.searchsorted(ones, self.marks[first]))
        return ((ones[skip + i - first * SAMPLE] - i) << self.low) | self._low(i)


def pack(doc_ids: np.ndarray | None, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard; doc_ids must ascend, None for documents without ids."""
    body = ids.astype("<u2" if ids.dtype == np.uint16 else "<u4")
    named, first = doc_ids is not None, 0 if doc_ids is None else int(doc_ids[0])
    names = (doc_ids.astype(np.uint64) - doc_ids[:1].astype(np.uint64)) if named else np.zeros(0, np.uint64)  # differences of 64-bit ids fit unsigned
    return MAGIC + struct.pack("<BBqQ", body.dtype.itemsize, named, first, len(body)) + ef_encode(np.cumsum(counts)) + ef_encode(names) + body.tobytes()


class Shard:
    """A shard as read: ``docs`` and ``ends`` are Elias-Fano, ``ids`` the id array."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        width, self.named, self.first, n = struct.unpack_from("<BBqQ", raw, 8)
        view = memoryview(raw)[8 + struct.calcsize("<BBqQ") :]
        self.ends = EliasFano(view)
        self.docs = EliasFano(view[self.ends.size :])
        self.ids = np.frombuffer(view, "<u2" if width == 2 else "<u4", n, self.ends.size + self.docs.size)

    def bounds(self, lo: int, hi: int) -> np.ndarray:
        """The offsets where the documents lo to hi - 1 start, and where the last ends."""
        ends = self.ends.select(np.arange(max(lo - 1, 0), hi))
        return np.concatenate([[0], ends]) if lo == 0 else ends

    def names(self, lo: int, hi: int) -> pa.Array:
        """The doc_ids of the documents lo to hi - 1."""
        if not self.named:
            return pa.nulls(hi - lo, pa.int64())
        return pa.array((self.docs.select(np.arange(lo, hi)).astype(np.uint64) + np.int64(self.first).astype(np.uint64)).astype(np.int64))

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        start, end = self.bounds(i, i + 1)
        return self.ids[start:end]


_SHARD_DDL = "part int, chunk int, first_doc long, n_ids long, payload binary"
_SHARD = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first_doc", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
_READ_DDL = "doc_id long, part int, chunk int, at long, n_tokens long, ids_crc32 long"
_READ = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_shards(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Encodes the texts and writes the shards; the table of shards as written."""

    def run(batches):
        cache, part, chunk = _cache(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, named = 0, False

        def close():
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held))
            return batch_of(_SHARD, part=[part], chunk=[chunk], first_doc=[int(doc_ids[0]) if named else None], n_ids=[len(ids)], payload=[pack(doc_ids if named else None, counts, ids)])

        for whole in batches:
            nulls = whole.column("doc_id").null_count  # they come first
            for batch in (whole.slice(0, nulls), whole.slice(nulls)):
                doc_ids = batch.column("doc_id").fill_null(0).to_numpy()
                for i, j, data, off in chunks(batch):
                    if held and (size >= SHARD_IDS or named != (batch.column("doc_id").null_count == 0)):
                        yield close()
                        held, size, chunk = [], 0, chunk + 1
                    named = batch.column("doc_id").null_count == 0
                    ids, counts = encode_rows(cache, data, off, end_id)
                    held.append((doc_ids[i:j], counts, ids))
                    size += len(ids)
        if held:
            yield close()

    dealt = docs.select("doc_id", "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    return cut(dealt.mapInArrow(run, _SHARD_DDL))


def read_shards(shards: DataFrame) -> DataFrame:
    """One row a document: its place and length in the concatenation of all shards, and the checksum of its ids."""

    def run(batches):
        for batch in batches:
            for part, chunk, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "payload"))):
                shard = Shard(raw)
                for lo in range(0, shard.ends.n, READ):
                    hi = min(lo + READ, shard.ends.n)
                    at = shard.bounds(lo, hi)
                    wide = memoryview(shard.ids[at[0] : at[-1]].astype("<u4").tobytes())
                    cuts = (4 * (at - at[0])).tolist()
                    sums = [zlib.crc32(wide[s:e]) for s, e in zip(cuts[:-1], cuts[1:])]
                    yield batch_of(_READ, doc_id=shard.names(lo, hi), part=[part] * (hi - lo), chunk=[chunk] * (hi - lo), at=at[:-1], n_tokens=np.diff(at), ids_crc32=sums)

    sizes = shards.select("part", "chunk", "first_doc", "n_ids")
    parts = sizes.groupBy("part").agg(F.min_by("first_doc", "chunk").alias("first_doc"), F.sum("n_ids").alias("n_ids"))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy(F.asc_nulls_first("first_doc"), "part")).alias("base"))
    sizes = sizes.select("part", "chunk", before(Window.partitionBy("part").orderBy("chunk")).alias("skip")).join(parts, "part")
    return (
        shards.select("part", "chunk", "payload")
        .mapInArrow(run, _READ_DDL)
        .join(sizes, ["part", "chunk"])
        .select("doc_id", (F.col("base") + F.col("skip") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer, end_id))
