"""Media columns: texts stored as lossless WebP images, read back as pixel arrays.

A text's UTF-8 bytes are padded with spaces to a positive multiple of ``ROW`` and laid out as red, green
and blue samples, 64 pixels a row.  A payload of more rows than an image can have takes several files, one
after another.  :func:`choose` gives each image the transform, palette or colour cache that makes it smallest by the entropy of
all its pixels.  :func:`store` writes a table with the files, :func:`load` reads and decodes it.

Cases: null counts as empty, whose payload is one row of spaces; repeated texts give equal files; an empty
table gives an empty result; very long texts are stored whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leontia.llm import webp
from leontia.llm.common import batch_of, chunks, cut

WIDTH, ROW = 64, 192
_U = np.uint32


def to_pixels(payload: np.ndarray) -> np.ndarray:
    p = payload.reshape(-1, 3).astype(_U)
    return (_U(webp.BLACK) | p[:, 0] << _U(16) | p[:, 1] << _U(8) | p[:, 2]).reshape(-1, WIDTH)


def to_payload(pixels: np.ndarray) -> np.ndarray:
    p = pixels.ravel()
    return np.stack([p >> _U(16), p >> _U(8), p], axis=1).astype(np.uint8).ravel()


#: Predictors that are tried, left and top; and the share of the bits that a transform or cache must save, as it takes time to undo.
PREDICTORS, GAIN = (1, 2), 0.05


def _entropy(base: np.ndarray, n: int, *values: np.ndarray) -> np.ndarray:
    """Bits that one code for the values of each image takes, 5 for each symbol's length included; ``base`` is 256 times the image of each row."""
    counts = np.zeros(n * 256, np.int64)
    for v in values:
        counts += np.bincount((base + v).ravel(), minlength=n * 256)
    return _code_bits(counts.reshape(n, 256))


def _code_bits(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1)
    some = counts[counts > 0].astype(float)
    row = np.nonzero(counts)[0]
    spent = np.bincount(row, weights=some * np.log2(some), minlength=len(counts))
    return total * np.log2(np.maximum(total, 1)) - spent + 5 * (counts > 0).sum(axis=1)


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int8).astype(np.int64)


def choose(pixels: np.ndarray, height: np.ndarray) -> list[tuple[tuple, int]]:
    """(transforms, size of the colour cache) of the fewest estimated bits, GAIN counted, for images one below another in ``pixels``.

    Weighed over all pixels of each image: none, subtract-green, cross-colour with the multipliers of least squares, the
    predictors, a palette, and a colour cache for the image's number of colours.
    """
    n = len(height)
    image = np.repeat(np.arange(n), height)
    base = image[:, None] * 256
    red, green, blue = ((pixels >> _U(k)).astype(np.uint8) for k in (16, 8, 0))
    cost = {"plain": _entropy(base, n, red, green, blue), "green": 8 + _entropy(base, n, red - green, green, blue - green)}

    g, size = _signed(green), WIDTH * height
    part = lambda x: np.bincount(image, weights=x.sum(axis=1), minlength=n)
    mean_g = part(g) / size
    scale = np.maximum(part(g * g) / size - mean_g**2, 1e-9)
    times = [np.clip(np.rint(32 * (part(_signed(c) * g) / size - part(_signed(c)) / size * mean_g) / scale), -128, 127).astype(np.int64) for c in (red, blue)]
    rest = [(c.astype(np.int64) - (t[image][:, None] * g >> 5)).astype(np.uint8) for c, t in zip((red, blue), times)]
    cost["cross"] = 120 + _entropy(base, n, rest[0], green, rest[1])

    first = np.zeros(len(pixels), bool)
    first[np.cumsum(height) - height] = True
    for mode in PREDICTORS:
        out = []
        for c in (red, green, blue):
            left = np.empty_like(c)
            left[:, 1:] = c[:, :-1]
            left[:, 0] = np.where(first, 0, np.roll(c, 1, axis=0)[:, 0])
            guess = left
            if mode != 1:
                up = np.roll(c, 1, axis=0)
                guess = np.where(first[:, None], left, up)
                guess[:, 0] = left[:, 0]
            out.append(c - guess)
        cost[mode] = 80 + _entropy(base, n, *out)

    colour = (pixels & _U(0xFFFFFF)).ravel().astype(np.uint64)
    of = np.repeat(image, WIDTH).astype(np.uint64)
    key = np.sort(of << np.uint64(24) | colour)
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    owner, times_used = (key[edge[:-1]] >> np.uint64(24)).astype(np.int64), np.diff(edge)
    colours = np.bincount(owner, minlength=n)
    spent = np.bincount(owner, weights=times_used * np.log2(times_used), minlength=n)
    cost["palette"] = np.where(colours <= 256, 40 + size * np.log2(size) - spent + 29 * colours, np.inf)

    bits = np.clip(np.ceil(np.log2(np.maximum(colours, 2))), 1, 10).astype(np.int64)
    slot = ((colour | np.uint64(webp.BLACK)) * np.uint64(webp.CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> (32 - bits[of.astype(np.int64)]).astype(np.uint64)
    place = of << np.uint64(10) | slot
    turn = np.uint64(len(place).bit_length())
    order = (np.sort(place << turn | np.arange(len(place), dtype=np.uint64)) & ((np.uint64(1) << turn) - np.uint64(1))).astype(np.int64)
    hit = np.zeros(len(order), bool)
    hit[order[1:]] = (place[order[1:]] == place[order[:-1]]) & (colour[order[1:]] == colour[order[:-1]])
    own = of.astype(np.int64)
    hits = np.bincount(place[hit].astype(np.int64), minlength=n << 10)
    who = np.flatnonzero(hits)
    own = 256 * own[~hit]
    plain = np.bincount(own + green.ravel()[~hit], minlength=n * 256)
    known = np.flatnonzero(plain)
    amount, whose = np.concatenate([hits[who], plain[known]]).astype(float), np.concatenate([who >> 10, known >> 8])
    main = size * np.log2(size) - np.bincount(whose, weights=amount * np.log2(amount), minlength=n) + 5 * np.bincount(whose, minlength=n)
    other = sum(np.bincount(own + c.ravel()[~hit], minlength=n * 256) for c in (red, blue))
    cost["cache"] = main + _code_bits(other.reshape(n, 256)) + 40

    for k in cost:
        cost[k] = cost[k] * (1.0 if k == "plain" else 1 + GAIN)
    names = list(cost)
    best = np.argmin(np.stack([cost[k] for k in names]), axis=0)
    out: list[tuple[tuple, int]] = []
    for i, k in enumerate(best.tolist()):
        kind = names[k]
        if kind == "cache":
            out.append(((), int(bits[i])))
        elif kind == "cross":
            element = webp.BLACK | (int(times[1][i]) & 255) << 8 | int(times[0][i]) & 255
            out.append(((("cross", np.full((-(-int(height[i]) >> 9), 1), element, _U), 9),), 0))
        elif kind in PREDICTORS:
            out.append(((("predictor", np.full((-(-int(height[i]) >> 9), 1), kind), 9),), 0))
        else:
            out.append((() if kind == "plain" else ((kind,),), 0))
    return out


def pack_all(payloads: list[np.ndarray]) -> list[bytes]:
    """The files of each payload."""
    pixels = [to_pixels(p) for p in payloads]
    parts = [p[i : i + webp.MAX_SIDE] for p in pixels for i in range(0, len(p), webp.MAX_SIDE)]
    plans = choose(np.concatenate(parts), np.array([len(p) for p in parts]))
    files = [webp.encode(p, transforms, cache, least=8) for p, (transforms, cache) in zip(parts, plans)]
    at = np.cumsum([0, *[-(-len(p) // webp.MAX_SIDE) for p in pixels]]).tolist()
    return [b"".join(files[s:e]) for s, e in zip(at[:-1], at[1:])]


def pack(payload: np.ndarray) -> bytes:
    return pack_all([payload])[0]


def unpack(raw: bytes) -> np.ndarray:
    """The pixels of one or more files."""
    parts, at = [], 0
    while at < len(raw):
        size = 8 + struct.unpack_from("<I", raw, at + 4)[0]
        parts.append(webp.decode(raw[at : at + size]))
        at += size
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def describe(payload: np.ndarray) -> str:
    """Mean, deviation, step between samples, and entropy in bits, of the samples."""
    n = len(payload)
    counts = np.bincount(payload, minlength=256)
    level = np.arange(256)
    mean = float(counts @ level) / n
    spread = max(0.0, float(counts @ (level * level)) / n - mean * mean) ** 0.5
    step = float(np.abs(np.diff(payload.astype(np.int16))).sum()) / (n - 1)
    share = counts[counts > 0] / n
    return f"mean={mean:.4f};std={spread:.4f};step={step:.4f};bits={float(-(share * np.log2(share)).sum()):.4f}"


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def store(docs: DataFrame) -> DataFrame:
    """Writes (doc_id, n_bytes, media) into the shared folder; the table as written."""

    def run(batches):
        for batch in batches:
            for i, j, data, off in chunks(batch):
                payloads, size = [], np.diff(off)
                for s, n in zip(off[:-1].tolist(), size.tolist()):
                    payloads.append(np.full(max(1, -(-n // ROW)) * ROW, 32, np.uint8))
                    payloads[-1][:n] = data[s : s + n]
                yield batch_of(_STORED, doc_id=batch.column("doc_id").slice(i, j - i), n_bytes=size, media=pack_all(payloads))

    return cut(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"))


def load(media: DataFrame) -> DataFrame:
    """Decodes the stored files; digests and features of each payload."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for raw in part.column("media").to_pylist():
                    payload = to_payload(unpack(raw))
                    flat = payload.tobytes()
                    rows.append((len(flat), hashlib.sha256(flat).hexdigest(), zlib.crc32(flat[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), describe(payload)))
                cols = list(zip(*rows))
                yield batch_of(_DIGEST, doc_id=part.column("doc_id"), n_bytes=part.column("n_bytes"), payload_bytes=cols[0], payload_sha256=cols[1], tail_crc32=cols[2], media_bytes=cols[3], media_sha256=cols[4], feature=cols[5])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digests(docs: DataFrame) -> DataFrame:
    return load(store(docs))
