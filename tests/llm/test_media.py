import hashlib
import random
import zlib

import numpy as np
import pytest

from leontia.llm import media, webp

TEXTS = ["", None, "x", "é漢😀", "y" * 192, "z" * 193, "line one of text\n" * 300, "".join(map(chr, random.Random(1).choices(range(32, 900), k=9000))), "same", "same"]


def test_digests(docs):
    rows = {r.doc_id: r for r in media.media_digests(docs(TEXTS, extra=True)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        pay = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        stored = media.pack(np.frombuffer(pay, np.uint8))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.describe(np.frombuffer(pay, np.uint8))
    assert rows[8].media_sha256 == rows[9].media_sha256
    assert media.media_digests(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_all_parts_round_trip(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(1, 40, 2)
    colours = rng.integers(0, 1 << 32, rng.integers(1, 300), dtype=np.uint32)
    img = colours[rng.integers(0, len(colours), (h, w))]
    if seed % 3 == 0:
        img = np.repeat(img, 3, 0)[:h]
    chosen, wide = [], int(w)
    for name in rng.permutation(["predictor", "cross", "green", "palette"]):
        k = int(rng.integers(2, 6))
        shape = (-(-int(h) >> k), -(-wide >> k))
        if name == "palette":
            if chosen or len(np.unique(img)) > 256:
                continue
            wide = -(-wide >> webp._bundle(len(np.unique(img))))
            chosen.append((name,))
        elif name == "predictor":
            chosen.append((name, rng.integers(0, 14, shape), k))
        elif name == "cross":
            chosen.append((name, rng.integers(0, 1 << 32, shape, dtype=np.uint32), k))
        else:
            chosen.append((name,))
    raw = webp.encode(img, tuple(chosen), cache=int(rng.integers(0, 12)), meta_bits=int(rng.choice([0, 2, 3])))
    assert (webp.decode(raw) == img).all()


def test_known_file():
    """One opaque pixel of red 1, green 2, blue 3, its bits put together by hand."""
    fields = [(0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    for symbol in (2, 1, 3, 255, 0):
        fields += [(1, 1), (0, 1), (1, 1), (symbol, 8)]
    bits = "".join(f"{v:0{n}b}"[::-1] for v, n in fields)
    body = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    body += b"\0" * (len(body) % 2)
    raw = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp.decode(raw).tolist() == [[0xFF010203]]


def test_damaged_input():
    raw = webp.encode(np.arange(600, dtype=np.uint32).reshape(20, 30))
    for bad in (b"", raw[:20], raw[:60], b"RIFX" + raw[4:], raw[:21] + b"\xff" * 40 + raw[61:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_long_payload_takes_several_files():
    payload = np.full((webp.MAX_SIDE + 2) * media.ROW, 65, np.uint8)
    payload[-1] = 66
    raw = media.pack(payload)
    assert raw.count(b"WEBPVP8L") == 2 and (media.to_payload(media.unpack(raw)) == payload).all()


def test_choice_is_by_size():
    r = np.random.default_rng(4)
    h = 40
    noise = r.integers(0, 256, (h, 64))
    smooth = (np.arange(h)[:, None] * 2 + np.cumsum(r.integers(-1, 2, (h, 64)), axis=1)) & 255
    rgb = lambda a, b, c: np.uint32(webp.BLACK) | (a & 255).astype(np.uint32) << np.uint32(16) | (b & 255).astype(np.uint32) << np.uint32(8) | (c & 255).astype(np.uint32)
    few = r.integers(0, 1 << 24, 700)[r.integers(0, 700, (h, 64))].astype(np.uint32) | np.uint32(webp.BLACK)
    wide = np.rint(r.normal(0, 24, (h, 64))).astype(int)
    images = {
        "plain": rgb(*r.integers(97, 123, (3, h, 64))),
        "green": rgb(noise + r.integers(0, 3, (h, 64)), noise, noise + r.integers(0, 3, (h, 64))),
        "cross": rgb((70 * wide >> 5) + r.integers(0, 20, (h, 64)), wide, (-50 * wide >> 5) + r.integers(0, 20, (h, 64))),
        "predictor": rgb(smooth, smooth, smooth),
        "palette": rgb(*np.array([[1, 99, 7], [200, 3, 180], [40, 250, 90]])[:, r.integers(0, 3, (h, 64))]),
        "cache": few,
    }
    parts = [*images.values(), images["cache"][:1]]
    plans = media.choose(np.concatenate(parts), np.array([len(p) for p in parts]))
    names = [t[0][0] if t else "cache" if c else "plain" for t, c in plans]
    assert names[:6] == list(images)
    for p, (transforms, cache) in zip(parts, plans):
        raw = webp.encode(p, transforms, cache, least=8)
        assert np.array_equal(webp.decode(raw), p)
        assert len(raw) <= 1.03 * len(webp.encode(p, (), 0, least=8))


def test_copies_next_to_a_cache():
    r = np.random.default_rng(6)
    p = r.integers(0, 1 << 24, 90)[r.integers(0, 90, (50, 64))].astype(np.uint32) | np.uint32(webp.BLACK)
    p[20:35] = p[3:18]
    for cache in (0, 1, 7, 10):
        assert np.array_equal(webp.decode(webp.encode(p, (), cache, least=8)), p)


@pytest.mark.parametrize("seed", range(12))
def test_opaque_images(seed):
    r = np.random.default_rng(seed)
    h, w = int(r.integers(1, 400)), int(r.integers(1, 65))
    p = (r.integers(0, 1 << 24, r.integers(1, 3000)) >> int(r.integers(0, 20)))[:, None]
    p = p[r.integers(0, len(p), (h, w)), 0].astype(np.uint32) | np.uint32(webp.BLACK)
    if seed % 3 == 0:
        p[h // 2 :] = p[: h - h // 2]
    raw = webp.encode(p, (), int(r.integers(0, 12)), least=8)
    assert np.array_equal(webp.decode(raw), p)
    if len(raw) > 200:
        with pytest.raises(ValueError):
            webp.decode(raw[:12] + b"VP8L" + (len(raw) // 2 - 20).to_bytes(4, "little") + raw[20 : len(raw) // 2])


def test_empty_slot_of_the_cache():
    out = webp.Writer()
    for value, n in ((0x2F, 8), (1, 14), (0, 14), (0, 1), (0, 3), (0, 1), (1, 1), (1, 4), (0, 1)):
        out.put(value, n)
    green = np.zeros(282, np.int64)
    green[[5, 281]] = 1
    out.put_all(*webp._length_fields(green))
    for size, symbol in ((256, 0), (256, 0), (256, 255), (40, 0)):
        out.put_all(*webp._code(np.bincount([symbol], minlength=size), {})[2])
    out.put(0b01, 2)  # slot 1, then a literal
    body = out.done()
    body += b"\0" * (len(body) & 1)
    raw = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp.decode(raw).tolist() == [[0xFF000000, 0xFF000500]]
