"""Progressive JPEG in numpy: all images of a batch at once.

Entropy-coded data is cut at restart markers into lanes; lanes of all images go through
their scans in lockstep, one coefficient after another, so that a step is a few numpy
operations over all lanes.  The decoder takes baseline and progressive files with
Huffman coding and 8-bit samples: any tables, components, sampling factors, scan scripts
and restart intervals (without restarts a scan is one lane, and as slow as that is).
Scans accumulate into coefficient arrays; these are dequantised, inverse-transformed,
upsampled (by repetition) and turned into RGB.

The encoder stores coefficients, not samples: what it is given comes back unchanged.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda i: ((i // 8 + i % 8), (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


@functools.lru_cache(maxsize=64)
def canonical(counts: tuple[int, ...], symbols: bytes) -> np.ndarray:
    """Codes by their 16-bit prefix: symbol << 8 | length; 0 where there is no code."""
    lut, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            at = code << (16 - length)
            lut[at : at + (1 << (16 - length))] = symbols[k] << 8 | length
            code, k = code + 1, k + 1
        code <<= 1
    return lut


def lengths_to_table(lengths: dict[int, int]) -> tuple[tuple[int, ...], bytes]:
    """DHT counts and symbols from code lengths."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return tuple(sum(v == n for v in lengths.values()) for n in range(1, 17)), bytes(symbols)


@dataclass
class Component:
    id: int
    h: int
    v: int
    quant: int
    width: int = 0  # blocks of its own, and with padding to whole MCUs
    height: int = 0
    padded: int = 0
    first: int = 0  # of its blocks in the batch's coefficient array
    rows: int = 0


@dataclass
class Image:
    data: bytes
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list = field(default_factory=list)
    comments: list[bytes] = field(default_factory=list)
    mcus: tuple[int, int] = (0, 0)


def parse(data: bytes) -> Image:
    """Headers, and where each scan's data is."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG: no start of image")
    im, at, tables, interval, progressive = Image(data), 2, {}, 0, False
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if data[at : at + 1] != b"\xff" or at + 2 > len(data):
            raise ValueError("not a JPEG: a marker is missing")
        kind = data[at + 1]
        if kind == 0xD9:
            return im
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            i = 0
            while i < len(body):
                wide, n = body[i] >> 4, body[i] & 15
                im.quant[n] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.float32)
                i += 1 + 64 * (1 + wide)
        elif kind in (0xC0, 0xC1, 0xC2):
            progressive = kind == 0xC2
            if body[0] != 8:
                raise ValueError("samples of 8 bits only")
            im.height, im.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            im.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            hm, vm = max(c.h for c in im.components), max(c.v for c in im.components)
            im.mcus = -(-im.width // (8 * hm)), -(-im.height // (8 * vm))
            for c in im.components:
                c.width, c.height = -(-(-(-im.width * c.h // hm)) // 8), -(-(-(-im.height * c.v // vm)) // 8)
                c.padded, c.rows = im.mcus[0] * c.h, im.mcus[1] * c.v
        elif 0xC3 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError(f"coding process {kind:#x} isn't supported")
        elif kind == 0xC4:
            i = 0
            while i < len(body):
                counts = tuple(body[i + 1 : i + 17])
                tables[body[i]] = (counts, body[i + 17 : i + 17 + sum(counts)])
                i += 17 + sum(counts)
        elif kind == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            im.comments.append(body)
        elif kind == 0xDA:
            n = body[0]
            by_id = {c.id: c for c in im.components}
            parts = [(by_id[body[1 + 2 * i]], tables.get(body[2 + 2 * i] >> 4), tables.get(16 | body[2 + 2 * i] & 15)) for i in range(n)]
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            m = MARKER.search(data, at)
            end = m.start() if m else len(data)
            im.scans.append((parts, ss, se if progressive else 63, approx >> 4, approx & 15, interval, at, end, progressive))
            at = end


class Lanes:
    """Bits of many lanes, read side by side; at: where each lane is, in bits."""

    def __init__(self, pieces: list[bytes]):
        raw = b"\x00\x00".join(p.replace(b"\xff\x00", b"\xff") + b"\xff" * 6 for p in pieces)
        lens = np.fromiter((len(p) - p.count(b"\xff\x00") + 8 for p in pieces), np.int64, len(pieces))
        b = np.frombuffer(raw + b"\x00" * 8, np.uint8).astype(np.int64)
        self.words = (b[:-4] << 32) | (b[1:-3] << 24) | (b[2:-2] << 16) | (b[3:-1] << 8) | b[4:]
        self.at = (np.cumsum(lens) - lens) * 8
        self.end = self.at + (lens - 2) * 8

    def peek(self, at: np.ndarray, n: int = 32) -> np.ndarray:
        """The n bits at each place."""
        return (self.words[at >> 3] >> (40 - n - (at & 7))) & ((1 << n) - 1)

    def symbol(self, at: np.ndarray, lut: np.ndarray, extra) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A symbol at each place, the bits after it, how many (extra(symbol)), and the
        place after both."""
        w = self.peek(at)
        got = lut[w >> 16]
        n, sym = got & 255, got >> 8
        if not n.all():
            raise ValueError("not a code of the Huffman table")
        more = extra(sym)
        return sym, (w >> (32 - n - more)) & ((1 << more) - 1), more, at + n + more


@functools.lru_cache(maxsize=64)
def fast_ac(counts: tuple[int, ...], symbols: bytes) -> np.ndarray:
    """For 16 bits of a first AC scan: value << 16 | run << 8 | bits used, where a code and
    its value fit into them, else 0."""
    w = np.arange(1 << 16)
    got = canonical(counts, symbols)
    n, sym = got & 255, got >> 8
    s = sym & 15
    ok = (n > 0) & (s > 0) & (n + s <= 16)
    bits = np.where(ok, (w >> np.where(ok, 16 - n - s, 0)) & ((1 << s) - 1), 0)
    return np.where(ok, signed(bits, s) << 16 | (sym >> 4) << 8 | (n + s), 0)


def signed(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (bits < (1 << (n - 1).clip(0))), bits - (1 << n) + 1, bits)


def _lanes_of(images: list[Image], number: int) -> dict:
    """The number-th scans of all images, those of one kind together: pieces between
    restarts, and for each the blocks that it codes, in order."""
    kinds: dict = {}
    for im in images:
        if number >= len(im.scans):
            continue
        parts, ss, se, ah, al, interval, start, end, progressive = im.scans[number]
        pieces = RESTART.split(im.data[start:end])
        if len(parts) == 1:
            c = parts[0][0]
            blocks = (c.first + np.arange(c.height)[:, None] * c.padded + np.arange(c.width)).reshape(-1, 1)
            which = np.zeros(1, np.int64)
        else:
            x, y, cols, which = np.arange(im.mcus[0]), np.arange(im.mcus[1]), [], []
            for k, (c, *_) in enumerate(parts):
                for j in range(c.v):
                    for i in range(c.h):
                        cols.append(c.first + ((y * c.v + j)[:, None] * c.padded + x * c.h + i).ravel())
                        which.append(k)
            blocks, which = np.stack(cols, 1), np.array(which)
        per = interval or len(blocks)
        if len(pieces) != max(1, -(-len(blocks) // per)):
            raise ValueError("a scan's restarts don't fit its size")
        key = (ss, se, ah, al, progressive, len(which), per, tuple(which), tuple((c_dc, c_ac) for _, c_dc, c_ac in parts))
        kinds.setdefault(key, []).append((pieces, blocks))
    return kinds


def decode(datas: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Images, and the coefficients of all their blocks (zigzag order)."""
    images = [parse(d) for d in datas]
    total = 0
    for im in images:
        for c in im.components:
            c.first, total = total, total + c.padded * c.rows
    coefs = np.zeros((total, 64), np.int32)
    for number in range(max((len(im.scans) for im in images), default=0)):
        for key, found in _lanes_of(images, number).items():
            ss, se, ah, al, progressive, width, per, which, tables = key
            bits = Lanes([p for pieces, _ in found for p in pieces])
            lanes = len(bits.at)
            # units[l, i]: the blocks of lane l's i-th MCU, -1 beyond its end
            units = np.full((lanes, per, width), -1, np.int64)
            at = 0
            for pieces, blocks in found:
                flat = np.full((len(pieces) * per, width), -1, np.int64)
                flat[: len(blocks)] = blocks
                units[at : at + len(pieces)] = flat.reshape(len(pieces), per, width)
                at += len(pieces)
            no = ((0,) * 16, b"")
            dc, ac = [t[0] or no for t in tables], [t[1] or no for t in tables]
            pred = np.zeros((lanes, len(tables)), np.int64)
            run = np.zeros(lanes, np.int64)  # blocks of an end-of-band run still to come
            for i in range(per):
                for j in range(width):
                    own = np.flatnonzero(units[:, i, j] >= 0)
                    if len(own):
                        _block(bits, own, units[own, i, j], coefs, which[j], dc[which[j]], ac[which[j]], pred, run, ss, se, ah, al, progressive)
            if (bits.at > bits.end).any():
                raise ValueError("a scan's data ends too early")
    return images, coefs


def _block(bits, own, block, coefs, k, dc, ac, pred, run, ss, se, ah, al, progressive):
    """A block of each lane in own."""
    at = bits.at[own]
    if ss == 0:
        if ah:
            coefs[block, 0] |= bits.peek(at, 1) << al
            at += 1
        else:
            _, more, n, at = bits.symbol(at, canonical(*dc), lambda s: s)
            pred[own, k] += signed(more, n)
            coefs[block, 0] = pred[own, k] << al
        if progressive:
            bits.at[own] = at
            return
    if ah:
        at = _refine(bits, at, own, block, coefs, canonical(*ac), run, ss, se, al)
    else:
        at = _first(bits, at, own, block, coefs, ac, run, max(1, ss), se, al)
    bits.at[own] = at


def _first(bits, at, own, block, coefs, ac, run, ss, se, al):
    """The first scan of a band."""
    lut, fast, n = canonical(*ac), fast_ac(*ac), len(own)
    left = np.where(run[own] > 0, 64, 0)  # places to pass before wait is put
    run[own] -= run[own] > 0
    wait = np.zeros(n, np.int64)
    go = np.flatnonzero(left == 0)  # lanes whose next symbol is due
    band = np.zeros((se - ss + 1, n), np.int64)
    for c in range(se - ss + 1):
        whole = len(go) == n
        if len(go):
            a = at if whole else at[go]
            e = fast[bits.peek(a, 16)]
            a, r, v = a + (e & 255), (e >> 8) & 255, e >> 16
            slow = np.flatnonzero(e == 0)
            if len(slow):
                sym, more, m, a[slow] = bits.symbol(a[slow], lut, lambda s: np.where((s & 15) | (s == 0xF0), s & 15, s >> 4))
                x, z = sym >> 4, sym & 15
                end = (z == 0) & (x < 15)
                r[slow], v[slow] = np.where(end, 64, x), np.where(z > 0, signed(more, m), 0)
                run[own[go[slow]]] += np.where(end, (1 << x) - 1 + more, 0)
            if whole:
                at, left, wait = a, r, v
            else:
                at[go], left[go], wait[go] = a, r, v
        put = left == 0
        np.multiply(wait, put, out=band[c])
        if not (whole and put.all()):
            go = np.flatnonzero(put)
        left -= 1
    coefs[block, ss : se + 1] = (band << al).T
    return at


def _refine(bits, at, own, block, coefs, lut, run, ss, se, al):
    """Successive approximation of the coefficients of a band."""
    n = len(own)
    over = run[own] > 0  # past the end of band: only known coefficients have bits
    run[own] -= over
    band = np.ascontiguousarray(coefs[block, ss : se + 1].T).astype(np.int64)
    known = band != 0
    sign = np.sign(band) << al
    left = np.full(n, -1, np.int64)  # zero coefficients to pass; -1: a symbol is due
    fresh = np.zeros(n, np.int64)  # what stands at the end of them
    window, used = bits.peek(at), np.zeros(n, np.int64)
    for c in range(len(band)):
        if c % 24 == 23:
            at = at + used
            window, used = bits.peek(at), np.zeros(n, np.int64)
        ask = np.flatnonzero((left < 0) & ~over) if not over.all() else ()
        if len(ask):
            sym, more, _, a = bits.symbol(at[ask] + used[ask], lut, lambda s: np.where(s & 15, 1, np.where(s == 0xF0, 0, s >> 4)))
            r, s = sym >> 4, sym & 15
            end = (s == 0) & (r < 15)
            run[own[ask]] += np.where(end, (1 << r) - 1 + more, 0)
            over[ask] = end
            left[ask] = np.where(end, -1, r)
            fresh[ask] = np.where(s > 0, np.where(more == 1, 1, -1), 0)
            at[ask], used[ask] = a, 0
            window[ask] = bits.peek(a)
        k = known[c]
        band[c] += np.where(k, sign[c] * ((window >> (31 - used)) & 1), 0)
        used += k
        if not over.all():
            zero = ~(k | over)
            put = zero & (left == 0)
            band[c] += np.where(put, fresh << al, 0)
            left -= zero
    coefs[block, ss : se + 1] = band.T
    return at + used


@functools.lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    m = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m.astype(np.float32)


def planes(im: Image, coefs: np.ndarray) -> list[np.ndarray]:
    """Samples of each component at its own resolution, not rounded."""
    out, m = [], _basis()
    for c in im.components:
        z = coefs[c.first : c.first + c.padded * c.rows] * im.quant[c.quant]
        f = np.empty((len(z), 64), np.float32)
        f[:, ZIGZAG] = z
        s = m.T @ f.reshape(-1, 8, 8) @ m + 128
        out.append(s.reshape(c.rows, c.padded, 8, 8).swapaxes(1, 2).reshape(c.rows * 8, c.padded * 8))
    return out


def rgb(im: Image, coefs: np.ndarray) -> np.ndarray:
    """The image as height x width x 3, 8 bits; grey images have three equal channels."""
    hm, vm = max(c.h for c in im.components), max(c.v for c in im.components)
    full = [s.repeat(vm // c.v, 0).repeat(hm // c.h, 1)[: im.height, : im.width] for c, s in zip(im.components, planes(im, coefs), strict=True)]
    y = np.rint(full[0]).clip(0, 255)
    if len(full) == 1:
        return np.repeat(y[..., None], 3, 2).astype(np.uint8)
    cb, cr = (np.rint(x).clip(0, 255) - 128 for x in full[1:3])
    return np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)).clip(0, 255).astype(np.uint8)


# The encoder: three components, the second and third at half resolution each way, a restart
# after each MCU, fixed Huffman tables, quantisation by 1.

DC_LENGTHS = {s: 4 for s in range(12)}
AC_LENGTHS = {s: 4 for s in range(1, 9)} | {s: 9 for s in range(256) if not 1 <= s <= 8 and (s & 15) <= 10}
SCRIPT = (  # components, first and last coefficient, successive approximation high and low
    ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0),
)


@functools.lru_cache(maxsize=4)
def _codes(ac: bool) -> tuple[np.ndarray, np.ndarray]:
    counts, symbols = lengths_to_table(AC_LENGTHS if ac else DC_LENGTHS)
    code, value, length, k = 0, np.zeros(256, np.int64), np.zeros(256, np.int64), 0
    for n, m in enumerate(counts, 1):
        for _ in range(m):
            value[symbols[k]], length[symbols[k]] = code, n
            code, k = code + 1, k + 1
        code <<= 1
    return value, length


class Writer:
    """Bits of many lanes, written side by side."""

    def __init__(self, lanes: int, most_bits: int):
        self.out = np.zeros((lanes, most_bits // 32 + 3), np.uint32)
        self.acc, self.n, self.word = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def put(self, lanes, value: np.ndarray, n: np.ndarray):
        """Up to 31 bits to each lane; lanes None: to all."""
        acc, have = (self.acc, self.n) if lanes is None else (self.acc[lanes], self.n[lanes])
        acc, have = (acc << n) | value, have + n
        full = np.flatnonzero(have >= 32)
        if len(full):
            left = have[full] - 32
            at = full if lanes is None else lanes[full]
            self.out[at, self.word[at]] = acc[full] >> left
            self.word[at] += 1
            acc[full] &= (1 << left) - 1
            have[full] = left
        if lanes is None:
            self.acc, self.n = acc, have
        else:
            self.acc[lanes], self.n[lanes] = acc, have

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, with ones to the byte, stuffed, and the number of bytes of each lane."""
        every, bits = np.arange(len(self.n)), self.word * 32 + self.n
        self.put(None, (1 << (-bits % 8)) - 1, -bits % 8)
        self.out[every, self.word] = np.where(self.n > 0, self.acc << (32 - self.n), 0)
        size = self.word * 4 + self.n // 8
        wide = int(size.max(initial=0))
        raw = self.out[:, : wide // 4 + 1].astype(">u4").view(np.uint8).reshape(len(every), -1)
        data = raw[np.arange(raw.shape[1]) < size[:, None]]
        ff = np.flatnonzero(data == 255)
        if not len(ff):
            return data, size
        ends = np.cumsum(size)
        return np.insert(data, ff + 1, 0), size + np.bincount(np.searchsorted(ends, ff, side="right"), minlength=len(every))


def _category(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _with_value(sym, v, codes, lengths) -> tuple[np.ndarray, np.ndarray]:
    """A symbol and the bits of v (0: none), and their number."""
    n = _category(v)
    return (codes[sym] << n) | np.where(v < 0, v + (1 << n) - 1, v), lengths[sym] + n


@functools.lru_cache(maxsize=1)
def _ac_values() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each run of up to 15 zeros and value from -1024 on."""
    r, v = np.arange(16)[:, None], np.arange(-1023, 1024)[None, :]
    codes, lengths = _codes(True)
    bits, n = _with_value((r << 4) | _category(v), v + 0 * r, codes, lengths)
    pad = lambda x: np.concatenate([np.zeros((16, 1), np.int64), x], 1).ravel()
    return pad(bits), pad(n)


def _scan_dc(groups: np.ndarray, which, ah: int, al: int) -> Writer:
    """groups[m, j]: DC of the j-th block of each MCU, a lane each."""
    w = Writer(len(groups), 24 * groups.shape[1])
    codes, lengths = _codes(False)
    pred: dict = {}
    for j, k in enumerate(which):
        if ah:
            w.put(None, (groups[:, j] >> al) & 1, np.ones(len(groups), np.int64))
        else:
            v = groups[:, j] >> al
            d = v - pred.get(k, 0)
            pred[k] = v
            w.put(None, *_with_value(_category(d), d, codes, lengths))
    return w


def _scan_ac(z: np.ndarray, ss: int, se: int, al: int) -> Writer:
    """z: coefficients of blocks, a lane each."""
    w = Writer(len(z), 20 * (se - ss + 1) + 16)
    codes, lengths = _codes(True)
    bits, n = _ac_values()
    zeros = np.zeros(len(z), np.int64)
    for c in range(ss, se + 1):
        v = np.ascontiguousarray(z[:, c])
        v = np.sign(v) * (np.abs(v) >> al)
        on = np.flatnonzero(v)
        if len(on) == len(z) and not zeros.any():
            w.put(None, bits[v + 1024], n[v + 1024])
            continue
        long = on[zeros[on] > 15]
        while len(long):
            w.put(long, np.full(len(long), codes[0xF0]), np.full(len(long), lengths[0xF0]))
            zeros[long] -= 16
            long = long[zeros[long] > 15]
        if len(on):
            at = zeros[on] * 2048 + v[on] + 1024
            w.put(on, bits[at], n[at])
        zeros += 1
        zeros[on] = 0
    end = np.flatnonzero(zeros)
    w.put(end, np.full(len(end), codes[0]), np.full(len(end), lengths[0]))
    return w


def _scan_refine(z: np.ndarray, ss: int, se: int, al: int) -> Writer:
    """As _scan_ac, for coefficients whose higher bits are out already."""
    w, wide = Writer(len(z), 26 * (se - ss + 1) + 32), se - ss + 1
    codes, lengths = _codes(True)
    band = np.ascontiguousarray(z[:, ss : se + 1].T)
    mag = np.abs(band) >> al
    fresh = mag == 1
    # for each place the next fresh coefficient, and the zeros before it
    nexts, zeros = np.full((wide + 1, len(z)), wide, np.int64), np.zeros((wide + 1, len(z)), np.int64)
    for c in range(wide - 1, -1, -1):
        nexts[c] = np.where(fresh[c], c, nexts[c + 1])
    np.cumsum(mag == 0, axis=0, out=zeros[1:])
    over, left = np.zeros(len(z), bool), np.full(len(z), -1, np.int64)
    held, waiting = np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)  # correction bits
    for c in range(wide):
        ask = np.flatnonzero((left < 0) & ~over) if not over.all() else ()
        if len(ask):
            w.put(ask, held[ask], waiting[ask])
            held[ask] = waiting[ask] = 0
            to = nexts[c, ask]
            end = to == wide
            e, g, to = ask[end], ask[~end], to[~end]
            w.put(e, np.full(len(e), codes[0]), np.full(len(e), lengths[0]))
            over[e] = True
            run = zeros[to, g] - zeros[c, g]
            long = run > 15
            sym = np.where(long, 0xF0, (np.minimum(run, 15) << 4) | 1)
            w.put(g, np.where(long, codes[sym], (codes[sym] << 1) | (band[np.minimum(to, wide - 1), g] > 0)), lengths[sym] + ~long)
            left[g] = np.where(long, 15, run)
        known = mag[c] > 1
        held = (held << known) | (mag[c] & known)
        waiting += known
        if c % 24 == 23:
            w.put(None, held, waiting)
            held, waiting = np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)
        left -= ~(known | over)
    w.put(None, held, waiting)
    return w


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([255, kind]) + (len(body) + 2).to_bytes(2, "big") + body


@functools.lru_cache(maxsize=1)
def _tables() -> bytes:
    out = _segment(0xDB, b"\x00" + b"\x01" * 64)
    for kind, lengths in ((0x00, DC_LENGTHS), (0x10, AC_LENGTHS)):
        counts, symbols = lengths_to_table(lengths)
        out += _segment(0xC4, bytes([kind]) + bytes(counts) + symbols)
    return out + _segment(0xDD, b"\x00\x01")


def geometry(blocks: int) -> tuple[int, int]:
    """MCUs across and down for so many blocks (six to an MCU)."""
    n = max(1, -(-blocks // 6))
    across = int(np.ceil(np.sqrt(n)))
    down = -(-n // across)
    if max(across, down) * 16 > 65535:
        raise ValueError("too large for a JPEG")
    return across, down


def encode(blocks: list[np.ndarray], comments: list[bytes]) -> list[bytes]:
    """A JPEG for each array of blocks (n x 64, zigzag order, -1023 to 1023): the first
    components' blocks first, zero blocks at the end as the size needs."""
    shapes = [geometry(len(b)) for b in blocks]
    sizes = np.array([a * d for a, d in shapes], np.int64)
    parts = {0: [], 1: [], 2: []}
    orders = []  # of the first component's blocks within MCUs
    for b, (a, d) in zip(blocks, shapes, strict=True):
        n = a * d
        z = np.zeros((6 * n, 64), np.int64)
        z[: len(b)] = b
        parts[0].append(z[: 4 * n])
        parts[1].append(z[4 * n : 5 * n])
        parts[2].append(z[5 * n :])
        y, x = np.divmod(np.arange(n), a)
        orders.append(np.stack([(2 * y + j) * 2 * a + 2 * x + i for j in (0, 1) for i in (0, 1)], 1))
    joined = {k: np.concatenate(v) for k, v in parts.items()}
    firsts = np.cumsum(4 * sizes) - 4 * sizes
    order = np.concatenate([o + f for o, f in zip(orders, firsts, strict=True)])
    dcs = np.concatenate([joined[0][order, 0], joined[1][:, :1], joined[2][:, :1]], 1)
    bodies: list[list[bytes]] = [[] for _ in blocks]
    for comps, ss, se, ah, al in SCRIPT:
        if ss == 0:
            w, per = _scan_dc(dcs, [0] * 4 + [1, 2], ah, al), sizes
        else:
            w = (_scan_refine if ah else _scan_ac)(joined[comps[0]], ss, se, al)
            per = sizes * (4 if comps[0] == 0 else 1)
        data, lens = w.done()
        # restart markers between the lanes of an image
        lane_ends = np.cumsum(lens)
        firsts = np.cumsum(per) - per
        place = np.arange(len(lens)) - np.repeat(firsts, per)
        last = place == np.repeat(per, per) - 1
        grown = lens + np.where(last, 0, 2)
        ends = np.cumsum(grown)
        out = np.empty(int(ends[-1]), np.uint8)
        out[np.arange(len(data)) + np.repeat(ends - grown - (lane_ends - lens), lens)] = data
        mark = np.flatnonzero(~last)
        out[ends[mark] - 2], out[ends[mark] - 1] = 255, 0xD0 + place[mark] % 8
        raw, start = out.tobytes(), 0
        head = _segment(0xDA, bytes([len(comps), *[x for k in comps for x in (k + 1, 0)], ss, se, ah << 4 | al]))
        for body, end in zip(bodies, ends[firsts + per - 1].tolist(), strict=True):
            body += [head, raw[start:end]]
            start = end
    files = []
    for (a, d), body, note in zip(shapes, bodies, comments, strict=True):
        frame = _segment(0xC2, b"\x08" + (16 * d).to_bytes(2, "big") + (16 * a).to_bytes(2, "big") + b"\x03" + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        files.append(b"".join([b"\xff\xd8", _segment(0xFE, note), _tables(), frame, *body, b"\xff\xd9"]))
    return files
