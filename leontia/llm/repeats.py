"""Suffix-array dedup: removes each byte covered by a string of ``WINDOW`` bytes that also starts earlier.

The steps are those of the distributed difference-cover suffix sort, cut down to prefixes of WINDOW bytes:
sample suffixes, sort and name the samples, go on with what the names leave open, sort the remaining
suffixes, and compare neighbours in the sorted order.  One thing differs: the sample.  A positional
difference cover samples at least 11 % of the positions and sorts the remaining suffixes one by one, several
times the size of the text; here the sample is content-defined (a string synchronising set): the sampled
position of a window is its least ``GRAM``-byte gram by hash, the leftmost of equals.  Equal windows then
sample the same place, which is what the cover is for, and one sample stands for some 35 suffixes.

1. A run is the suffixes that share a sampled position.  Its name is the hash of the gram there, its
   context the hash of all bytes that its windows cover.  Runs are dealt out by name.
2. Sorted by (name, context, place): a run whose left neighbour has the same name and context is repeated
   as a whole.  A name with one context is settled.  A name with several leaves the first run of each open.
3. The windows of open runs are named one by one, by two independent 64-bit hashes, dealt out and sorted by
   (name, place); a window whose left neighbour is equal is repeated.

Bytes stand for equal if 128 bits of hashes are (gram and context, or the two of a window); every eight bytes
go through a bijective mixer, so that no pattern of bytes cancels out, and 10^14 windows collide by chance
with probability 1e-10.

Places compare by (doc_id, start).  Runs and windows that repeat within a chunk of input are settled
before the shuffle, so a string that occurs everywhere is sent once a chunk.

Cases: null counts as empty; texts under WINDOW bytes lose nothing; rows with the same doc_id are one
document's versions: a place is earlier only if its (doc_id, start) is less, so equal rows lose nothing to
each other; an empty table gives an empty result; a removed run may cut a character, so what is kept is
bytes, not a string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leontia.llm.common import batch_of, chunks, cut, eights, mix, ramp, span_hash

WINDOW, GRAM = 100, 32
_U = np.uint64
_PLACE_BITS = _U(28)
#: Rows of a blob: arrays of records that go to one bucket.
_FIELDS = (("name", "<u8"), ("context", "<u8"), ("start", "<u4"), ("count", "<u4"), ("row", "<u4"))


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, name, context) of each run of windows that share a sampled position."""
    n = len(data) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(_U), none.astype(_U)
    words = eights(data)
    gram = words[: len(data) - GRAM + 1]
    for k in range(8, GRAM, 8):
        gram = mix(gram) ^ words[k : k + len(gram)]
    gram = mix(gram)
    at = np.arange(len(gram))
    least = (mix(gram) >> _PLACE_BITS << _PLACE_BITS) | at.astype(_U)
    width, need = 1, WINDOW - GRAM + 1
    while 2 * width <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < need:
        least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
    place = (least & ((_U(1) << _PLACE_BITS) - _U(1))).astype(np.int64)
    edge = np.zeros(n + 1, np.int8)
    long = np.diff(off) >= WINDOW
    edge[off[:-1][long]] += 1
    edge[off[1:][long] - WINDOW + 1] -= 1
    valid = np.cumsum(edge[:n]) > 0
    joined = np.zeros(n + 1, bool)
    joined[1:n] = valid[1:] & valid[:-1] & (place[1:] == place[:-1])
    first, last = np.flatnonzero(valid & ~joined[:n]), np.flatnonzero(valid & ~joined[1:])
    return np.searchsorted(off, first, "right") - 1, first, last, gram[place[first]], span_hash(words, first, last + WINDOW)


def _repeated(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys, doc and start; in that order, whether a record's place comes after the first of its equals)."""
    order = np.lexsort((start, doc, *reversed(keys)))
    new = np.ones(len(order), bool)
    for k in keys:
        new[1:] &= k[order[1:]] == k[order[:-1]]
    new[1:] = ~new[1:]
    new[:1] = True
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    doc, start = doc[order], start[order]
    return order, (doc != doc[head]) | (start != start[head])


def _blob(doc: np.ndarray, text_hash: np.ndarray, record: dict[str, np.ndarray], settled: dict[str, np.ndarray]) -> bytes:
    rows = np.unique(np.concatenate([record["row"], settled["row"]]))
    out = [np.array([len(rows), len(record["row"]), len(settled["row"])], "<u4").tobytes(), doc[rows].astype("<i8").tobytes(), text_hash[rows].astype("<i8").tobytes()]
    for part, names in ((record, _FIELDS), (settled, _FIELDS[2:])):
        for name, kind in names:
            out.append((np.searchsorted(rows, part["row"]) if name == "row" else part[name]).astype(kind).tobytes())
    return b"".join(out)


def _unblob(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(records, settled) of all blobs, with ``doc`` and ``text_hash`` instead of ``row``."""
    found = ([], [])
    for raw in blobs:
        n, *sizes = np.frombuffer(raw, "<u4", 3).tolist()
        doc, text_hash = np.frombuffer(raw, "<i8", n, 12), np.frombuffer(raw, "<i8", n, 12 + 8 * n)
        at = 12 + 16 * n
        for out, size, names in zip(found, sizes, (_FIELDS, _FIELDS[2:])):
            part = {}
            for name, kind in names:
                part[name] = np.frombuffer(raw, kind, size, at)
                at += size * np.dtype(kind).itemsize
            row = part.pop("row")
            part["doc"], part["text_hash"] = doc[row], text_hash[row]
            out.append(part)
    return tuple({k: np.concatenate([p[k] for p in parts]) for k in parts[0]} for parts in found)


_MARKS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("count", pa.int64()), ("open", pa.bool_())])
_MARKS_DDL = "doc_id long, text_hash long, start long, count long, open boolean"
_BLOB_DDL = "bucket int, blob binary"


def _deal(row: np.ndarray, doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray, count: np.ndarray, name: np.ndarray, context: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blobs of records, those that repeat within this chunk settled."""
    order, later = _repeated([name, context], doc[row], start)
    bucket = (name % _U(buckets)).astype(np.int64)[order]
    by = np.argsort(bucket, kind="stable")
    order, later, bucket = order[by], later[by], bucket[by]
    edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    out, which = [], []
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
        own, rest = order[s:e][~later[s:e]], order[s:e][later[s:e]]
        parts = [{"row": row[i], "start": start[i], "count": count[i], "name": name[i], "context": context[i]} for i in (own, rest)]
        out.append(_blob(doc, text_hash, *parts))
        which.append(int(bucket[s]))
    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(out, pa.binary())], ["bucket", "blob"])


def _resolve(blobs: DataFrame, judge: Callable) -> DataFrame:
    """Marks from the records of each bucket, one bucket at a time."""

    def run(batches):
        held: list[bytes] = []
        bucket = None
        for batch in batches:
            for b, raw in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if b != bucket and held:
                    yield from judge(*_unblob(held))
                    held = []
                bucket = b
                held.append(raw)
        if held:
            yield from judge(*_unblob(held))

    return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _MARKS_DDL)


def _marks(part: dict[str, np.ndarray], is_open: bool) -> pa.RecordBatch:
    return batch_of(_MARKS, doc_id=part["doc"], text_hash=part["text_hash"], start=part["start"], count=part["count"], open=np.full(len(part["doc"]), is_open))


def _judge_runs(records: dict, settled: dict) -> Iterator[pa.RecordBatch]:
    yield _marks(settled, False)
    _, inverse, times = np.unique(records["name"], return_inverse=True, return_counts=True)
    records = {k: v[times[inverse] > 1] for k, v in records.items()}
    order, later = _repeated([records["name"], records["context"]], records["doc"], records["start"])
    records = {k: v[order] for k, v in records.items()}
    name, context = records["name"], records["context"]
    edge = np.flatnonzero(np.r_[True, name[1:] != name[:-1], True]) if len(name) else np.zeros(1, int)
    size = np.diff(edge)
    several = np.repeat(context[edge[:-1]] != context[edge[1:] - 1], size) if len(name) else np.zeros(0, bool)
    yield _marks({k: v[later] for k, v in records.items()}, False)
    yield _marks({k: v[~later & several] for k, v in records.items()}, True)


def _judge_windows(records: dict, settled: dict) -> Iterator[pa.RecordBatch]:
    yield _marks(settled, False)
    order, later = _repeated([records["name"], records["context"]], records["doc"], records["start"])
    yield _marks({k: v[order][later] for k, v in records.items()}, False)


def _deal_runs(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            doc, text_hash = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))
            for i, j, data, off in chunks(batch):
                row, first, last, name, context = runs(data, off)
                if len(row):
                    yield from _deal(row, doc[i:j], text_hash[i:j], first - off[row], last - first + 1, name, context, buckets)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, _BLOB_DDL)


def _deal_windows(open_docs: DataFrame, buckets: int) -> DataFrame:
    """Of rows (doc_id, text_hash, text, starts, counts): the windows of the open runs."""

    def run(batches):
        for batch in batches:
            doc, text_hash = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))
            for i, j, data, off in chunks(batch):
                starts, counts = (batch.column(c).slice(i, j - i) for c in ("starts", "counts"))
                per = pc.list_value_length(starts).to_numpy(zero_copy_only=False)
                begin, size = starts.flatten().to_numpy(), counts.flatten().to_numpy()
                at = np.repeat(begin, size) + ramp(size)
                row = np.repeat(np.repeat(np.arange(j - i), per), size)
                place = at + off[row]
                words = eights(data)
                name, context = (span_hash(words, place, place + WINDOW, seed) for seed in (0, 1))
                if len(row):
                    yield from _deal(row, doc[i:j], text_hash[i:j], at, np.ones(len(at), np.int64), name, context, buckets)

    return open_docs.mapInArrow(run, _BLOB_DDL)


def _by_document(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc_id", "text_hash").agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts"))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def _apply(docs: DataFrame) -> DataFrame:
    """What is left of rows (doc_id, text, starts, counts)."""

    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch):
                starts, counts = (batch.column(c).slice(i, j - i) for c in ("starts", "counts"))
                per = pc.fill_null(pc.list_value_length(starts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                begin = starts.flatten().to_numpy() + np.repeat(off[:-1], per)
                end = begin + counts.flatten().to_numpy() + WINDOW - 1
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, end, -1)
                gone = np.cumsum(edge[:-1]) > 0
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                first = off[:-1][np.diff(off) > 0]
                head[first] = gone[first]
                removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[off]) for x in (gone, head))
                left = data[~gone].tobytes()
                at = np.concatenate([[0], np.cumsum(np.diff(off) - removed)]).tolist()
                kept = [left[s:e] for s, e in zip(at[:-1], at[1:])]
                yield batch_of(_OUT, doc_id=batch.column("doc_id").slice(i, j - i), n_bytes=np.diff(off), n_removed=removed, n_spans=spans, kept=kept, kept_sha256=[hashlib.sha256(k).hexdigest() for k in kept])

    return docs.select("doc_id", "text", "starts", "counts").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), kept_sha256."""
    docs = docs.select("doc_id", "text")
    n = docs.count()
    twice = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    docs = docs.select("doc_id", "text", (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("text_hash"))
    buckets = int(min(max(n // 2048, 64), 1 << 16))
    marks = cut(_resolve(_deal_runs(docs.where("doc_id IS NOT NULL"), buckets), _judge_runs))
    open_docs = docs.join(_by_document(marks.where("open")), ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "starts", "counts")
    more = cut(_resolve(_deal_windows(open_docs, buckets), _judge_windows))
    settled = marks.where("NOT open").unionByName(more)
    return _apply(docs.join(_by_document(settled), ["doc_id", "text_hash"], "left"))
