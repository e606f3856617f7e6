"""SentencePiece encoding and decoding in batched numpy.

A model file is read by :class:`Model`.  Texts are cut before each run of spaces (no piece of a model
crosses from a letter to a space, which :class:`Model` checks); every distinct cut is encoded once per
worker.  Cuts of equal length in characters advance together: the hashes of all their substrings probe
the sorted hashes of the pieces, which gives a table of scores by (start, end).

* Unigram models: Viterbi.  For each end, the maximum over the starts is vectorised over the cuts, and
  its place is the backpointer.
* BPE models: a Viterbi path over the scores is not what the library returns for them, as it merges the
  best pair first.  From the same tables, each step merges in every cut the pair of highest score, the
  leftmost of equals, until none is left.

Characters without a piece become byte pieces, or the unknown id where the model has none.

Cases: null counts as empty and gives no ids; cuts longer than ``LONG`` characters take a heap (BPE) or
a row by itself (unigram), with the same result; the character that stands for the space is read as a
space, as in the library; repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leontia.llm.common import WordCache, batch_of, chunks, eights, row_of, span_hash, sums, take_ragged

LONG, CELLS = 40, 1 << 20
MARK = "▁".encode()
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes):
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, raw[at : at + n]
            at += n


class Model:
    """The pieces of a model file, ready for batched probing."""

    def __init__(self, raw: bytes):
        self.kind, self.dummy, self.squeeze, self.byte_fallback = UNIGRAM, True, True, False
        pieces, scores, types = [], [], []
        for field, value in _fields(raw):
            if field == 1:
                one = dict(_fields(value))
                pieces.append(one.get(1, b""))
                scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                types.append(one.get(3, NORMAL))
            elif field == 2:
                spec = dict(_fields(value))
                self.kind, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                self.dummy, self.squeeze, self.charsmap = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
                if self.charsmap:
                    raise ValueError("models with a character map are not supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        types = np.array(types)
        self.unk = int(np.flatnonzero(types == UNKNOWN)[0])
        self.bytes = {int(pieces[i][3:5], 16): i for i in np.flatnonzero(types == BYTE)}
        shown = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARK, b" ") for p, t in zip(pieces, types)]
        self.shown_len = np.array([len(p) for p in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_len) - self.shown_len
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        ids = np.flatnonzero((types == NORMAL) | (types == USER) | (types == UNUSED))
        keyed = [shown[i] for i in ids]
        if any(b" " in p.lstrip(b" ") for p in keyed):
            raise ValueError("a piece holds a space after another character")
        flat = np.frombuffer(b"".join(keyed), np.uint8)
        size = np.array([len(p) for p in keyed], np.int64)
        end = np.cumsum(size)
        keys = span_hash(eights(flat), end - size, end)
        order = np.argsort(keys)
        self.flat, self.begin, self.size = flat, (end - size)[order], size[order]
        self.keys, self.ids, self.scores = keys[order], ids[order].astype(np.int32), np.array(scores)[ids[order]]
        self.unk_score = float(np.min(self.scores)) - 10.0
        self.longest = max(len(p.decode("utf-8")) for p in keyed)

    def probe(self, data: np.ndarray, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places in ``keys`` of the pieces that the spans are, or -1; a hash that hits is compared byte by byte."""
        hashes = span_hash(words, start, end)
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero((self.keys[at] == hashes) & (self.size[at] == end - start))
        size = self.size[at[hit]]
        other = take_ragged(data, start[hit], size) != take_ragged(self.flat, self.begin[at[hit]], size)
        hit = hit[sums(other, np.concatenate([[0], np.cumsum(size)])) == 0]
        out = np.full(len(at), -1, np.int64)
        out[hit] = at[hit]
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per word)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        off = np.concatenate([[0], np.cumsum(size)])
        prefix = data, eights(data)
        first = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.diff(np.searchsorted(first, off))
        begin = np.cumsum(chars) - chars
        edges = np.append(first, len(data))
        places, counts = [], []
        for length in np.unique(chars).tolist():
            rows = np.flatnonzero(chars == length)
            step = max(1, CELLS // (length * min(length, self.longest + 1) + 1))
            if length > LONG and self.kind == BPE:
                step = 1
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                at = edges[begin[part][:, None] + np.arange(length + 1)]
                at[:, -1] = off[part + 1]
                if length > LONG and self.kind == BPE:
                    places.append((part, [self._heap(prefix, at[0])]))
                else:
                    places.append((part, (self._merge if self.kind == BPE else self._viterbi)(self._table(prefix, at), length)))
                    places[-1] = (part, self._spell_ready(at, places[-1][1]))
        out: list = [None] * len(words)
        for part, found in places:
            for w, spans in zip(part.tolist(), found):
                out[w] = spans
        flat: list[int] = []
        for w, spans in enumerate(out):
            before = len(flat)
            for s, e, place in spans:
                if place >= 0:
                    flat.append(int(self.ids[place]))
                elif self.byte_fallback:
                    flat.extend(self.bytes[b] for b in data[s:e].tolist())
                elif len(flat) == before or flat[-1] != self.unk:
                    flat.append(self.unk)
            counts.append(len(flat) - before)
        return np.array(flat, np.int32), np.array(counts, np.int64)

    def _table(self, prefix: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        """place[row, start, width - 1] of the piece that a substring is, or -1."""
        m, length = at.shape[0], at.shape[1] - 1
        most = min(length, self.longest)
        place = np.full((m, length, most), -1, np.int32)
        for width in range(1, most + 1):
            s, e = at[:, : length - width + 1], at[:, width:]
            place[:, : length - width + 1, width - 1] = self.probe(*prefix, s.ravel(), e.ravel()).reshape(s.shape)
        return place

    def _spell_ready(self, at: np.ndarray, cuts: list[tuple[np.ndarray, np.ndarray]]):
        return [list(zip(row[c[:-1]].tolist(), row[c[1:]].tolist(), p.tolist())) for row, (c, p) in zip(at, cuts)]

    def _merge(self, place: np.ndarray, length: int):
        """Cuts of each row by merging the best pair, all rows one merge at a time."""
        m, _, most = place.shape
        score = np.where(place >= 0, self.scores[place], -np.inf)
        cuts = np.tile(np.arange(length + 1), (m, 1))
        done: list = [None] * m
        live = np.arange(m)
        for n in range(length, 0, -1):
            if n > 1:
                width = cuts[:, 2:] - cuts[:, :-2]
                pair = np.where(width <= most, score[live[:, None], cuts[:, :-2], np.minimum(width, most) - 1], -np.inf)
                best = pair.argmax(axis=1)
                going = pair[np.arange(len(live)), best] > -np.inf
            else:
                going = np.zeros(len(live), bool)
            for r in np.flatnonzero(~going).tolist():
                c = cuts[r]
                done[live[r]] = (c, place[live[r], c[:-1], c[1:] - c[:-1] - 1])
            live, cuts = live[going], cuts[going]
            if not len(live):
                break
            keep = np.ones(cuts.shape, bool)
            keep[np.arange(len(live)), best[going] + 1] = False
            cuts = cuts[keep].reshape(len(live), n)
        return done

    def _viterbi(self, place: np.ndarray, length: int):
        """Cuts of each row of the greatest sum of scores."""
        m, _, most = place.shape
        score = np.where(place >= 0, self.scores[place], -np.inf).astype(np.float32)  # sums round as in the library
        score[:, :, 0] = np.where(place[:, :, 0] >= 0, score[:, :, 0], self.unk_score)
        best, back = np.full((m, length + 1), -np.inf, np.float32), np.zeros((m, length + 1), np.int64)
        best[:, 0] = 0
        for e in range(1, length + 1):
            starts = np.arange(max(0, e - most), e)
            sums = best[:, starts] + score[:, starts, e - starts - 1]
            back[:, e] = starts[sums.argmax(axis=1)]
            best[:, e] = sums.max(axis=1)
        out = []
        for r in range(m):
            c = [length]
            while c[-1]:
                c.append(int(back[r, c[-1]]))
            c = np.array(c[::-1])
            out.append((c, place[r, c[:-1], c[1:] - c[:-1] - 1]))
        return out

    def _heap(self, prefix: tuple[np.ndarray, np.ndarray], at: np.ndarray):
        """One long row by BPE, with a heap of pairs."""
        n = len(at) - 1
        left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        alive = [True] * n
        single = self.probe(*prefix, at[:-1], at[1:])
        double = self.probe(*prefix, at[:-2], at[2:]) if n > 1 else []
        found = single.tolist()
        heap = [(-self.scores[p], i, i + 2, p) for i, p in enumerate(np.asarray(double).tolist()) if p >= 0]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = right[i]
            if i >= 0 and j < n and end[j] - i <= self.longest:
                p = int(self.probe(*prefix, at[i : i + 1], at[end[j] : end[j] + 1])[0])
                if p >= 0:
                    heapq.heappush(heap, (-self.scores[p], i, end[j], p))

        while heap:
            _, i, e, p = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != e:
                continue
            alive[j], right[i], end[i], found[i] = False, right[j], e, p
            if right[i] < n:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [(int(at[i]), int(at[end[i]]), found[i]) for i in range(n) if alive[i]]

    def encode(self, cache: WordCache, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text) of the texts data[off[i] : off[i + 1]]."""
        data, off = self._normal(data, off)
        space = np.append(data == 32, False)
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[off] = True
        edge = np.flatnonzero(cut[: len(data)])
        per = np.diff(np.searchsorted(edge, off))
        end = np.append(edge[1:], len(data))
        if not len(edge):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        flat, count = cache.lookup(data, edge, end)
        return flat, np.bincount(row_of(per), weights=count, minlength=len(per)).astype(np.int64)

    def _normal(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if MARK in raw or self.squeeze:
            texts = [raw[s:e].replace(MARK, b" ") for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            if self.squeeze:
                texts = [b" ".join(x for x in t.split(b" ") if x) for t in texts]
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]) if texts else np.zeros(1, np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
        if self.dummy:
            full = (np.diff(off) > 0).astype(np.int64)
            data = np.insert(data, off[:-1][full > 0], 32)
            off = off + np.concatenate([[0], np.cumsum(full)])
        return data, off

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts that the ids stand for."""
        size = self.shown_len[flat]
        data = take_ragged(self.shown, self.shown_start[flat], size)
        run = np.concatenate([[0], np.cumsum(size)])
        off = run[np.concatenate([[0], np.cumsum(counts)])]
        if self.dummy and len(data):
            first = off[:-1][(np.diff(off) > 0)]
            first = first[data[first] == 32]
            gone = np.zeros(len(data) + 1, np.int64)
            gone[first + 1] = 1
            data, off = np.delete(data, first), off - np.cumsum(gone)[off]
        return data, off


_LOADED: dict[str, tuple[Model, WordCache]] = {}


def load(path: str) -> tuple[Model, WordCache]:
    if path not in _LOADED:
        with open(path, "rb") as f:
            model = Model(f.read())
        _LOADED[path] = model, WordCache(model.encode_words, np.int32)
    return _LOADED[path]


_DDL = "doc_id long, ids array<int>, decoded string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the pieces of every whole text, and the text they decode to."""

    def run(batches):
        model, cache = load(model_path)
        for batch in batches:
            for i, j, data, off in chunks(batch):
                flat, counts = model.encode(cache, data, off)
                text, at = model.decode(flat, counts)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))
                raw = text.tobytes()
                yield batch_of(_SCHEMA, doc_id=batch.column("doc_id").slice(i, j - i), ids=ids, decoded=[raw[s:e].decode("utf-8", "replace") for s, e in zip(at[:-1].tolist(), at[1:].tolist())])

    return docs.select("doc_id", "text").mapInArrow(run, _DDL)


_DIGEST_DDL = "doc_id long, n_tokens long, ids_crc32 long, n_decoded_bytes long, round_trip boolean"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_decoded_bytes", pa.int64()), ("round_trip", pa.bool_())])


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Encodes and decodes every whole text; counts, checksum of the ids (little-endian 32 bits), and whether the text came back."""

    def run(batches):
        model, cache = load(model_path)
        for batch in batches:
            for i, j, data, off in chunks(batch):
                flat, counts = model.encode(cache, data, off)
                text, at = model.decode(flat, counts)
                end = np.cumsum(counts)
                raw = flat.astype("<u4").tobytes()
                same = np.diff(at) == np.diff(off)
                size = np.diff(off)[same]
                other = take_ragged(text, at[:-1][same], size) != take_ragged(data, off[:-1][same], size)
                same[same] = sums(other, np.concatenate([[0], np.cumsum(size)])) == 0
                yield batch_of(_DIGEST, doc_id=batch.column("doc_id").slice(i, j - i), n_tokens=counts, ids_crc32=[zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((end - counts).tolist(), end.tolist())], n_decoded_bytes=np.diff(at), round_trip=same)

    return docs.select("doc_id", "text").mapInArrow(run, _DIGEST_DDL)
