"""Lossless WebP (VP8L): a decoder for all of the format's parts, and an encoder for them.

Decoding reads prefix codes into lookup tables, runs through literals, back-references and the colour
cache, and then inverts the transforms (predictor, cross-colour, subtract-green, palette) on arrays.
The encoder writes canonical prefix codes of at most ``MAX_CODE`` bits; back-references are found by
arrays: positions whose last four pixels occurred before, at a distance that stays the same over a run.

Pixels are uint32 ARGB.  Damaged input raises ValueError.
"""

from __future__ import annotations

import struct

import numpy as np

MAX_SIDE, MAX_CODE, MAX_COPY = 16384, 15, 4096
# Fixed value: the order in which the lengths of code-length codes are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Near distances as (x, y), nearest first: the first 120 distance codes.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
BLACK = 0xFF000000


# ---- bits


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, raw: bytes):
        self.raw, self.n = raw, 8 * len(raw)
        b = np.zeros(len(raw) + 16, np.uint64)
        b[: len(raw)] = np.frombuffer(raw, np.uint8)
        m = len(raw) + 8
        w = b[:m].copy()
        for k in range(1, 8):
            w |= b[k : m + k] << np.uint64(8 * k)
        self.wide, self.windows = w, w.tolist()
        self.at = 0

    def peek(self, at: int, n: int) -> int:
        """n bits from a place, of any number."""
        return int.from_bytes(self.raw[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.n + 64:
            raise ValueError("the data ends too soon")
        value = self.windows[self.at >> 3] >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return value


class Writer:
    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Fields of at most 48 bits each."""
        self._flush()
        self.parts.append((values.astype(np.uint64), sizes.astype(np.int64)))

    def _flush(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.uint64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def done(self) -> bytes:
        self._flush()
        values, sizes = (np.concatenate(x) for x in zip(*self.parts))
        end = np.cumsum(sizes)
        at = end - sizes
        words = np.zeros((int(end[-1]) >> 6) + 2, np.uint64)
        shift = (at & 63).astype(np.uint64)
        np.bitwise_or.at(words, at >> 6, values << shift)
        over = (at & 63) + sizes > 64
        np.bitwise_or.at(words, (at[over] >> 6) + 1, values[over] >> (np.uint64(64) - shift[over]))
        return words.astype("<u8").tobytes()[: -(-int(end[-1]) // 8)]


# ---- prefix codes

_REVERSED: dict[int, np.ndarray] = {}


def _reversed(bits: int) -> np.ndarray:
    """k with its lowest ``bits`` bits reversed, for every k."""
    if bits not in _REVERSED:
        k = np.arange(1 << bits)
        out = np.zeros_like(k)
        for i in range(bits):
            out |= ((k >> i) & 1) << (bits - 1 - i)
        _REVERSED[bits] = out
    return _REVERSED[bits]


def code_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(symbol << 4 | length for each window of bits, mask) of a canonical code; one symbol alone takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return np.array([int(used[0]) << 4], np.int32), 0
    if not len(used):
        raise ValueError("a prefix code has no symbols")
    order = used[np.argsort(lengths[used], kind="stable")]
    most = int(lengths[order[-1]])
    width = 1 << (most - lengths[order].astype(np.int64))
    if int(width.sum()) != 1 << most:
        raise ValueError("a prefix code is not complete")
    table = np.repeat((order << 4 | lengths[order]).astype(np.int32), width)
    return table[_reversed(most)], (1 << most) - 1


def code_values(lengths: np.ndarray) -> np.ndarray:
    """Bits of each symbol's canonical code, first bit lowest."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), np.uint64)
    if len(used) < 2:
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    most = int(lengths[order[-1]])
    width = 1 << (most - lengths[order].astype(np.int64))
    out[order] = _reversed(most)[np.cumsum(width) - width]
    return out


def code_lengths(counts: np.ndarray, most: int = MAX_CODE) -> np.ndarray:
    """Lengths of a Huffman code for the counts, none over ``most``; a single symbol gets length 1."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used if len(used) else [0]] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].tolist()
    n = len(leaves)
    while True:  # the two lightest of the leaves and of the nodes made so far, both of which ascend
        none = 2 * sum(leaves)
        parent, weight, i, j = [0] * (2 * n - 1), [*leaves, none, *[none] * n], 0, n + 1
        for at in range(n + 1, 2 * n):
            x, y = weight[i], weight[j]
            if x <= y:
                parent[i] = at
                i += 1
                total, x = x, weight[i]
            else:
                parent[j - 1] = at
                j += 1
                total, y = y, weight[j]
            if x <= y:
                parent[i] = at
                i += 1
                weight[at] = total + x
            else:
                parent[j - 1] = at
                j += 1
                weight[at] = total + y
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k] - 1] + 1
        if depth[0] <= most:
            lengths[used] = depth[:n]
            return lengths
        leaves = [w // 2 + 1 for w in leaves]


def _read_lengths(bits: Bits, size: int) -> tuple[np.ndarray, int | None]:
    """The code lengths, and how many of them were stored if that was said (else None)."""
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= size:
            raise ValueError("a symbol is outside its alphabet")
        lengths[symbols] = 1
        return lengths, None
    own = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    table, mask = code_table(own)
    table = table.tolist()
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    out, last, windows, place = [], 8, bits.windows, bits.at
    while len(out) < size and left:
        left -= 1
        if place > bits.n:
            raise ValueError("the data ends too soon")
        window = windows[place >> 3] >> (place & 7)
        e = table[window & mask]
        symbol, k = e >> 4, e & 15
        place += k
        if symbol < 16:
            out.append(symbol)
            last = symbol or last
            continue
        first, n, value = (3, 2, last) if symbol == 16 else (3, 3, 0) if symbol == 17 else (11, 7, 0)
        place += n
        out += [value] * (first + (window >> k & (1 << n) - 1))
    if len(out) > size:
        raise ValueError("code lengths run over their alphabet")
    bits.at = place
    lengths[: len(out)] = out
    return lengths, len(out) if not left else None


def _length_fields(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of the bit fields that store code lengths."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and used[-1] < 256 and lengths[used].max() == 1:
        wide = int(used[0] > 1)
        values, sizes = [1, len(used) - 1, wide, int(used[0])], [1, 1, 1, 8 if wide else 1]
        if len(used) == 2:
            values, sizes = [*values, int(used[1])], [*sizes, 8]
        return np.array(values, np.uint64), np.array(sizes)
    end = int(used[-1]) + 1  # zeros after it are not stored
    start = np.concatenate([[0], np.flatnonzero(np.diff(lengths[:end])) + 1])
    value, size = lengths[start], np.diff(start, append=end)
    lead = (value > 0).astype(np.int64)  # a length stands for itself once, before it is repeated
    most = np.where(lead, 6, 138)
    pieces = lead - (lead - size) // most
    run = np.repeat(np.arange(len(start)), pieces)
    turn = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    part = np.minimum((size - lead)[run] - (turn - lead[run]) * most[run], most[run])
    first = turn < lead[run]
    alone = first | (part < 3)
    value = value[run]
    token = np.where(alone, value, np.where(value > 0, 16 | (part - 3) << 8, np.where(part < 11, 17 | (part - 3) << 8, 18 | (part - 11) << 8)))
    token = np.repeat(token, np.where(first, 1, np.where(alone, part, 1)))
    token = np.concatenate([token, np.zeros(max(0, 2 - len(token)), np.int64)])
    symbol = token & 255
    own = code_lengths(np.bincount(symbol, minlength=19), 7)
    n = max(4, 1 + max(i for i, k in enumerate(LENGTH_ORDER) if own[k]))
    wide = max(1, -(-(len(token) - 2).bit_length() // 2))
    head = [0, n - 4, *own[list(LENGTH_ORDER[:n])].tolist(), 1, wide - 1, len(token) - 2]
    bare = own if np.count_nonzero(own) > 1 else np.zeros_like(own)
    extra = np.where(symbol == 16, 2, np.where(symbol == 17, 3, np.where(symbol == 18, 7, 0)))
    values = code_values(own)[symbol] | (token >> 8).astype(np.uint64) << bare[symbol].astype(np.uint64)
    return np.concatenate([np.array(head, np.uint64), values]), np.concatenate([[1, 4, *[3] * n, 1, 3, 2 * wide], bare[symbol] + extra])


def _prefix_split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits, their number) of values >= 1."""
    v = np.asarray(v, np.int64) - 1
    top = np.where(v > 0, np.frexp(np.maximum(v, 1).astype(float))[1] - 1, 0)
    second = np.where(top > 0, v >> np.maximum(top - 1, 0) & 1, 0)
    small = v < 4
    n = np.where(small, 0, top - 1)
    return np.where(small, v, 2 * top + second), np.where(small, 0, v & ((1 << n) - 1)), n


# ---- entropy-coded images


def _read_codes(bits: Bits, cache: int):
    group, last = [], None
    for n in (280 + (1 << cache if cache else 0), 256, 256, 256, 40):
        if last and last[3] <= n and bits.peek(bits.at, last[1]) == last[0]:  # stored bit by bit as the one before
            bits.at += last[1]
            group += last[2]
            continue
        start = bits.at
        lengths, end = _read_lengths(bits, n)
        table = code_table(lengths)
        if end is not None:
            last = bits.peek(start, bits.at - start), bits.at - start, table, end
        group += table
    return group


def _value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


#: Bytes whose bits are looked up at once; a place that no step leads beyond.
_PART, _FAR = 1 << 13, 1 << 30
_SHIFTS = np.arange(8, dtype=np.uint32)


def _singles(bits: Bits, at: int, codes: list, total: int, cache: int) -> tuple[np.ndarray, int]:
    """(pixels up to the first back-reference, the place after them) of an opaque image with one group of codes.

    The symbol that would start at each bit is looked up for all bits of a part at once, then the places are walked from pixel to
    pixel.  A pixel from the colour cache equals the last literal of its slot, as it is put back where it came from; none are
    returned if one comes from a slot that is empty.
    """
    g, r, b = codes[0:6:2]
    alpha = np.uint32(int(codes[6][0]) >> 4 << 24)
    copies, kinds, n, more, start = bool((g >= 4096).any()), [], 0, True, at
    while n < total and more:
        base = at >> 3
        low = (bits.wide[base : base + _PART].astype(np.uint32)[:, None] >> _SHIFTS).ravel()
        place, known = np.arange(len(low), dtype=np.int32), {}
        for table, mask in ((g, codes[1]), (r, codes[3]), (b, codes[5])):
            if id(table) not in known:
                symbol = table[low & np.uint32(mask)]
                known[id(table)] = symbol >> 4, place + (symbol & 15)
        (green, after_g), (red, after_r), (blue, after_b) = (known[id(t)] for t in (g, r, b))
        step = after_b.take(after_r.take(after_g, mode="clip"), mode="clip")
        if copies:
            step = np.where(green < 256, step, np.where(green < 280, _FAR, after_g)).astype(np.int32)
        walk, stop, p, got = memoryview(step), len(low) - 3 * MAX_CODE, at & 7, []
        append = got.append
        for _ in range(total - n):
            if p >= stop:
                break
            append(p)
            p = walk[p]
        if p == _FAR:
            p, more = got.pop(), False
        elif not got:
            raise ValueError("the data ends too soon")
        k = np.array(got, np.int64)
        next_r = after_g[k]
        next_b = after_r.take(next_r, mode="clip")
        kinds.append((green[k].astype(np.uint32), red.take(next_r, mode="clip").astype(np.uint32), blue.take(next_b, mode="clip").astype(np.uint32)))
        n, at = n + len(got), 8 * base + p
    green, red, blue = (np.concatenate(x) for x in zip(*kinds))
    pixels = alpha | red << np.uint32(16) | green << np.uint32(8) | blue
    if copies and (green >= 280).any():
        slot = np.where(green >= 280, green - np.uint32(280), pixels * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        last = np.maximum.accumulate(np.where(green[order] < 280, np.arange(n), -1))
        source = order[last]
        if ((last < 0) | (slot[source] != slot[order])).any():
            return pixels[:0], start  # an empty slot, whose pixel is put back elsewhere: left to the caller
        pixels[order] = pixels[source]
    return pixels, at


def _read_image(bits: Bits, w: int, h: int, main: bool = False) -> np.ndarray:
    cache = 0
    if bits.read(1):
        cache = bits.read(4)
        if not 1 <= cache <= 11:
            raise ValueError("the colour cache has a size that is not allowed")
    block, groups = None, 1
    if main and bits.read(1):
        size = bits.read(3) + 2
        meta = _read_image(bits, -(-w >> size), -(-h >> size)) >> np.uint32(8) & np.uint32(0xFFFF)
        groups = int(meta.max()) + 1
        block = np.repeat(np.repeat(meta, 1 << size, 0)[:h], 1 << size, 1)[:, :w].ravel().tolist()
    codes = [_read_codes(bits, cache) for _ in range(groups)]
    total, out, windows, at, n = w * h, [], bits.windows, bits.at, 0
    if main and block is None and not codes[0][7]:
        pixels, at = _singles(bits, at, codes[0], total, cache)
        n = len(pixels)
        if n == total:
            if at > bits.n:
                raise ValueError("the data ends too soon")
            bits.at = at
            return pixels.reshape(h, w)
        out = pixels.tolist()
    end, append = bits.n, out.append
    codes = [[x.tolist() if k % 2 == 0 else x for k, x in enumerate(c)] for c in codes]
    slots, fed, shift = ([0] * (1 << cache) if cache else None), 0, 32 - cache
    g, mg, r, mr, b, mb, a, ma, d, md = codes[0]
    solid = ma == 0
    alpha = a[0] >> 4 << 24
    while n < total:
        if block is not None:
            g, mg, r, mr, b, mb, a, ma, d, md = codes[block[n]]
            solid, alpha = ma == 0, a[0] >> 4 << 24
        elif solid and cache:  # as below; what the cache holds is kept up as it goes
            while fed < n:
                slots[(CACHE_FACTOR * out[fed] & 0xFFFFFFFF) >> shift] = out[fed]
                fed += 1
            for n in range(n, total):
                window = windows[at >> 3] >> (at & 7)
                e = g[window & mg]
                if e < 4096:
                    k = e & 15
                    x = r[window >> k & mr]
                    k += x & 15
                    y = b[window >> k & mb]
                    at += k + (y & 15)
                    x = alpha | x >> 4 << 16 | e >> 4 << 8 | y >> 4
                    slots[(CACHE_FACTOR * x & 0xFFFFFFFF) >> shift] = x
                    append(x)
                elif e >= 4480:
                    at += e & 15
                    append(slots[(e >> 4) - 280])
                else:
                    break
            else:
                break
            fed = n
        elif solid:  # the common case, in as few steps as can be
            for n in range(n, total):
                window = windows[at >> 3] >> (at & 7)
                e = g[window & mg]
                if e >= 4096:
                    break
                k = e & 15
                x = r[window >> k & mr]
                k += x & 15
                y = b[window >> k & mb]
                at += k + (y & 15)
                append(alpha | x >> 4 << 16 | e >> 4 << 8 | y >> 4)
            else:
                break
        if block is not None or not solid:
            window = windows[at >> 3] >> (at & 7)
            e = g[window & mg]
        if e < 4096:
            k = e & 15
            x = r[window >> k & mr]
            k += x & 15
            y = b[window >> k & mb]
            at += k + (y & 15)
            if not solid:
                z = a[windows[at >> 3] >> (at & 7) & ma]
                at += z & 15
                alpha = z >> 4 << 24
            append(alpha | x >> 4 << 16 | e >> 4 << 8 | y >> 4)
            n += 1
            continue
        bits.at = at + (e & 15)
        symbol = e >> 4
        if symbol < 280:
            length = _value(bits, symbol - 256)
            e = d[windows[bits.at >> 3] >> (bits.at & 7) & md]
            bits.at += e & 15
            code = _value(bits, e >> 4)
            if code > 120:
                back = code - 120
            else:
                x, y = NEAR[code - 1]
                back = max(1, x + y * w)
            if back > n or n + length > total:
                raise ValueError("a back-reference leaves the image")
            if back >= length:
                out += out[n - back : n - back + length]
            else:
                unit = out[n - back :]
                out += (unit * (length // back + 1))[:length]
            n += length
        else:
            while fed < n:
                slots[(CACHE_FACTOR * out[fed] & 0xFFFFFFFF) >> shift] = out[fed]
                fed += 1
            if not cache or symbol - 280 >= len(slots):
                raise ValueError("a symbol is outside the colour cache")
            append(slots[symbol - 280])
            n += 1
        at = bits.at
        if at > end:
            raise ValueError("the data ends too soon")
    if at > end:
        raise ValueError("the data ends too soon")
    bits.at = at
    return np.array(out, np.uint32).reshape(h, w)


def _copies(p: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, length, distance) of non-overlapping repeats of at least ``least`` pixels, in order."""
    n = len(p)
    if n <= least:
        return []
    x = p.astype(np.uint64)
    key = np.zeros(n - least + 1, np.uint64)
    for k in range(least):
        key = key * np.uint64(0x9E3779B97F4A7C15) + x[k : n - least + 1 + k]
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    back = np.zeros(len(key), np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    edge = np.flatnonzero(np.diff(back)) + 1
    out, free = [], 0
    for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(back)]):
        d = int(back[s])
        if not d:
            continue
        stop = e + least - 1
        s = max(s, free)
        if stop - s < least or not np.array_equal(p[s:stop], p[s - d : stop - d]):
            continue
        for k in range(s, stop, MAX_COPY):
            out.append((k, min(MAX_COPY, stop - k), d))
        free = stop
    return out


_ALONE: dict[tuple[int, int], tuple] = {}


def _code(counts: np.ndarray, made: dict[bytes, tuple]) -> tuple:
    """(lengths, values, fields) of the code for the counts; codes of one symbol, and those that are ``made``, are not made again."""
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        key = len(counts), int(used[0]) if len(used) else 0
        if key not in _ALONE:
            x = code_lengths(counts)
            _ALONE[key] = x, code_values(x), _length_fields(x)
        return _ALONE[key]
    key = counts.tobytes().rstrip(b"\0")
    if key not in made:
        x = code_lengths(counts, 12)
        made[key] = x, code_values(x), _length_fields(x)
    found = made[key]
    if len(found[0]) == len(counts):
        return found
    full = [np.zeros(len(counts), a.dtype) for a in found[:2]]  # the same counts in a larger alphabet
    for wide, a in zip(full, found):
        n = min(len(a), len(wide))
        wide[:n] = a[:n]
    return (*full, found[2])


def _write_image(out: Writer, img: np.ndarray, cache: int = 0, main: bool = False, least: int = 4, meta_bits: int = 0) -> None:
    h, w = img.shape
    p = img.ravel()
    out.put(bool(cache), 1)
    if cache:
        out.put(cache, 4)
    group_of = np.zeros(len(p), np.int64)
    if main:
        out.put(bool(meta_bits), 1)
        if meta_bits:
            out.put(meta_bits - 2, 3)
            rows, cols = -(-h >> meta_bits), -(-w >> meta_bits)
            meta = (np.arange(rows)[:, None] + np.arange(cols)) % min(2, rows * cols)
            _write_image(out, (meta.astype(np.uint32) << np.uint32(8)) | np.uint32(BLACK))
            group_of = np.repeat(np.repeat(meta, 1 << meta_bits, 0)[:h], 1 << meta_bits, 1)[:, :w].ravel()
    copies = _copies(p, least)
    if 8 * sum(c[1] for c in copies) < len(p):  # a few do not pay for codes of their own
        copies = []
    start = np.array([c[0] for c in copies], np.int64)
    inside = np.zeros(len(p) + 1, np.int64)
    for s, n, _ in copies:
        inside[s] += 1
        inside[s + n] -= 1
    literal = np.cumsum(inside[:-1]) == 0
    at = np.flatnonzero(literal)
    argb = p[at]
    green, red, blue, alpha = ((argb >> np.uint32(k) & np.uint32(255)).astype(np.int64) for k in (8, 16, 0, 24))
    hit = np.zeros(len(at), bool)
    if cache:
        slot = (p * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache)
        order = (np.sort(slot.astype(np.uint64) << np.uint64(32) | np.arange(len(p), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        known = np.zeros(len(p), bool)
        known[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (p[order[1:]] == p[order[:-1]])
        hit = known[at]
        green = np.where(hit, 280 + slot[at], green)
    if copies:
        ls, lx, ln = _prefix_split(np.array([c[1] for c in copies]))
        near = {max(1, x + y * w): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))} if main else {}
        ds, dx, dn = _prefix_split(np.array([near.get(c[2], c[2] + 120) for c in copies]))
    size = 280 + (1 << cache if cache else 0)
    fields = []  # places, values, sizes
    for k in range(int(group_of.max()) + 1 if len(p) else 1):
        mine, plain = group_of[at] == k, (group_of[at] == k) & ~hit
        ours = group_of[start] == k if copies else np.zeros(0, bool)
        counts = [np.bincount(green[mine], minlength=size), *(np.bincount(c[plain], minlength=256) for c in (red, blue, alpha)), np.zeros(40, np.int64)]
        if copies:
            counts[0] += np.bincount(256 + ls[ours], minlength=size)
            counts[4] += np.bincount(ds[ours], minlength=40)
        if counts[0][256:].any():
            counts[1] = counts[2] = counts[1] + counts[2]
        else:  # one code for the three channels is read and written with less work
            counts[1] = counts[2] = counts[0][:256] + counts[1] + counts[2]
            counts[0] = np.concatenate([counts[1], np.zeros(size - 256, np.int64)])
        made: dict[bytes, tuple] = {}
        full = [_code(c, made) for c in counts]
        lengths, codes = [f[0] for f in full], [f[1] for f in full]
        for f in full:
            out.put_all(*f[2])
        bare = [np.zeros_like(x) if np.count_nonzero(x) == 1 else x for x in lengths]
        values, sizes = codes[0][green], bare[0][green]
        for c, v in ((1, red), (2, blue), (3, alpha)):
            values = np.where(hit, values, values | codes[c][v] << sizes.astype(np.uint64))
            sizes = np.where(hit, sizes, sizes + bare[c][v])
        fields.append((at[mine], values[mine], sizes[mine]))
        if copies and ours.any():
            value, used = codes[0][256 + ls], bare[0][256 + ls]
            for v, n in ((lx.astype(np.uint64), ln), (codes[4][ds], bare[4][ds])):
                value, used = value | v << used.astype(np.uint64), used + n
            fields.append((start[ours], value[ours], used[ours]))
            fields.append((start[ours], dx[ours].astype(np.uint64), dn[ours]))
    places = np.concatenate([f[0] for f in fields])
    order = np.argsort(places, kind="stable") if len(fields) > 1 else slice(None)
    out.put_all(np.concatenate([f[1] for f in fields])[order], np.concatenate([f[2] for f in fields])[order])


# ---- transforms


def _planes(img: np.ndarray) -> np.ndarray:
    """(h, w, 4) of alpha, red, green, blue."""
    return np.stack([img >> np.uint32(k) & np.uint32(255) for k in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _joined(planes: np.ndarray) -> np.ndarray:
    v = (planes & 255).astype(np.uint32)
    return v[..., 0] << np.uint32(24) | v[..., 1] << np.uint32(16) | v[..., 2] << np.uint32(8) | v[..., 3]


def _predict(mode: int, left, top, tr, tl):
    """The prediction of a mode, on arrays (..., 4)."""
    half = lambda x, y: (x + y) >> 1
    if mode == 0:
        return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(top))
    if mode in (1, 2, 3, 4):
        return (left, top, tr, tl)[mode - 1]
    if mode == 5:
        return half(half(left, tr), top)
    if mode in (6, 7, 8, 9):
        return half(*((left, tl), (left, top), (tl, top), (top, tr))[mode - 6])
    if mode == 10:
        return half(half(left, tl), half(top, tr))
    if mode == 11:
        to_left, to_top = np.abs(top - tl).sum(-1, keepdims=True), np.abs(left - tl).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - tl, 0, 255)
    if mode == 13:
        mean = half(left, top)
        diff = mean - tl
        return np.clip(mean + ((diff + (diff < 0)) >> 1), 0, 255)  # halves are cut towards zero
    raise ValueError("there is no such predictor")


def _spread(small: np.ndarray, bits: int, h: int, w: int) -> np.ndarray:
    return np.repeat(np.repeat(small, 1 << bits, 0)[:h], 1 << bits, 1)[:, :w]


def _neighbours(x: np.ndarray):
    """(left, top, top right, top left) of all pixels but the first row and column; the last column's top right is its own row's first pixel."""
    tr = np.concatenate([x[:-1, 2:], x[1:, :1]], axis=1)
    return x[1:, :-1], x[:-1, 1:], tr, x[:-1, :-1]


def _forward_predictor(img: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    x = _planes(img)
    out = x.copy()
    out[0, 0] -= [255, 0, 0, 0]
    out[0, 1:] -= x[0, :-1]
    out[1:, 0] -= x[:-1, 0]
    if x.shape[0] > 1 and x.shape[1] > 1:
        near = _neighbours(x)
        at = _spread(modes, bits, *img.shape)[1:, 1:]
        for mode in np.unique(at):
            m = at == mode
            out[1:, 1:][m] -= _predict(int(mode), *(v[m] for v in near))
    return _joined(out)


def _inverse_predictor(img: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    x = _planes(img)
    h, w = img.shape
    x[0, 0] += [255, 0, 0, 0]
    x[0] = np.cumsum(x[0], axis=0) & 255
    x[0, 0] &= 255
    at = _spread(modes, bits, h, w)
    for i in range(1, h):
        x[i, 0] = (x[i, 0] + x[i - 1, 0]) & 255
        row = at[i]
        s = 1
        while s < w:
            mode, e = int(row[s]), s + 1
            while e < w and row[e] == mode:
                e += 1
            if mode == 1:
                x[i, s - 1 : e] = np.cumsum(x[i, s - 1 : e], axis=0) & 255
            elif mode in (0, 2, 3, 4, 8, 9):
                tr = np.concatenate([x[i - 1, s + 1 : e + 1], x[i, :1]])[: e - s]
                x[i, s:e] = (x[i, s:e] + _predict(mode, None, x[i - 1, s:e], tr, x[i - 1, s - 1 : e - 1])) & 255
            else:
                for j in range(s, e):
                    tr = x[i - 1, j + 1] if j + 1 < w else x[i, 0]
                    x[i, j] = (x[i, j] + _predict(mode, x[i, j - 1], x[i - 1, j], tr, x[i - 1, j - 1])) & 255
            s = e
    return _joined(x)


def _signed(v: np.ndarray) -> np.ndarray:
    return ((v & 255) ^ 128) - 128


def _cross(img: np.ndarray, elements: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    x, t = _planes(img), _planes(_spread(elements, bits, *img.shape))
    delta = lambda k, c: _signed(k) * _signed(c) >> 5
    to_red, green_blue, red_blue = t[..., 3], t[..., 2], t[..., 1]
    red, green = x[..., 1].copy(), x[..., 2]
    sign = 1 if inverse else -1
    x[..., 1] = (red + sign * delta(to_red, green)) & 255
    x[..., 3] += sign * (delta(green_blue, green) + delta(red_blue, x[..., 1] if inverse else red))
    return _joined(x)


def _subtract_green(img: np.ndarray, inverse: bool) -> np.ndarray:
    x = _planes(img)
    for c in (1, 3):
        x[..., c] += x[..., 2] if inverse else -x[..., 2]
    return _joined(x)


def _bundle(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def _from_palette(img: np.ndarray, colours: np.ndarray, w: int) -> np.ndarray:
    index = (img >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    k = _bundle(len(colours))
    if k:
        size = 8 >> k
        index = (index[:, :, None] >> (size * np.arange(1 << k)) & ((1 << size) - 1)).reshape(len(img), -1)[:, :w]
    full = np.zeros(256, np.uint32)
    full[: len(colours)] = colours
    return full[index]


def _to_palette(img: np.ndarray, colours: np.ndarray) -> np.ndarray:
    h, w = img.shape
    index = np.searchsorted(colours, img).astype(np.int64)
    k = _bundle(len(colours))
    if k:
        size, wide = 8 >> k, -(-w >> k)
        full = np.zeros((h, wide << k), np.int64)
        full[:, :w] = index
        index = (full.reshape(h, wide, 1 << k) << (size * np.arange(1 << k))).sum(-1)
    return np.uint32(BLACK) | index.astype(np.uint32) << np.uint32(8)


# ---- files


def decode(raw: bytes) -> np.ndarray:
    """The ARGB pixels (h, w) of a lossless WebP file."""
    if len(raw) < 25 or raw[:4] != b"RIFF" or raw[8:16] != b"WEBPVP8L" or struct.unpack_from("<I", raw, 4)[0] + 8 > len(raw):
        raise ValueError("not a lossless WebP file")
    size = struct.unpack_from("<I", raw, 16)[0]
    if raw[20] != 0x2F or 20 + size > len(raw):
        raise ValueError("not a lossless WebP file")
    bits = Bits(raw[20 : 20 + size])
    bits.read(8)
    w, h = bits.read(14) + 1, bits.read(14) + 1
    has_alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("the version is not known")
    undo, wide, seen = [], w, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            k = bits.read(3) + 2
            data = _read_image(bits, -(-wide >> k), -(-h >> k))
            undo.append((kind, (data >> np.uint32(8) & np.uint32(15)).astype(np.int64) if kind == PREDICTOR else data, k))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            deltas = _planes(_read_image(bits, n, 1))[0]
            undo.append((kind, _joined(np.cumsum(deltas, axis=0)), wide))
            wide = -(-wide >> _bundle(n))
        else:
            undo.append((kind, None, 0))
    try:
        img = _read_image(bits, wide, h, True)
    except IndexError:
        raise ValueError("the data ends too soon") from None
    for kind, data, k in reversed(undo):
        img = _inverse_predictor(img, data, k) if kind == PREDICTOR else _cross(img, data, k, True) if kind == CROSS else _subtract_green(img, True) if kind == GREEN else _from_palette(img, data, k)
    return img if has_alpha else img | np.uint32(BLACK)


def encode(img: np.ndarray, transforms: tuple = (), cache: int = 0, least: int = 4, meta_bits: int = 0) -> bytes:
    """A lossless WebP file of ARGB pixels.

    ``transforms``: any of ("predictor", modes, bits), ("cross", elements, bits), ("green",), ("palette",), in order of application.
    """
    h, w = img.shape
    if not (0 < w <= MAX_SIDE and 0 < h <= MAX_SIDE):
        raise ValueError("an image has 1 to 16384 rows and columns")
    out = Writer()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(int((img >> np.uint32(24)).min() < 255), 1)
    out.put(0, 3)
    for kind, *args in transforms:
        out.put(1, 1)
        if kind == "predictor":
            modes, k = args
            out.put(PREDICTOR, 2)
            out.put(k - 2, 3)
            _write_image(out, np.uint32(BLACK) | modes.astype(np.uint32) << np.uint32(8))
            img = _forward_predictor(img, modes, k)
        elif kind == "cross":
            elements, k = args
            out.put(CROSS, 2)
            out.put(k - 2, 3)
            _write_image(out, elements)
            img = _cross(img, elements, k, False)
        elif kind == "green":
            out.put(GREEN, 2)
            img = _subtract_green(img, False)
        else:
            colours = np.unique(img)
            if len(colours) > 256:
                raise ValueError("a palette has at most 256 colours")
            out.put(PALETTE, 2)
            out.put(len(colours) - 1, 8)
            planes = _planes(colours[None])
            _write_image(out, _joined(np.diff(planes, axis=1, prepend=0)))
            img = _to_palette(img, colours)
    out.put(0, 1)
    _write_image(out, img, cache, True, least, meta_bits)
    body = out.done()
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body
