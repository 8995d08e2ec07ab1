import hashlib
import zlib

import numpy as np
import pytest

from rillflow.llm import jpeg, media
from tests.conftest import SF
from tests.llm.samples import SCHEMA, clashing, frame, hard_rows

# A scalar encoder and inverse transform, by the letter of the standard: one component,
# end-of-band runs, any restart interval.


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, value, n):
        self.s += format(value, f"0{n}b") if n else ""

    def data(self):
        s = self.s + "1" * (-len(self.s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")


def code_of(lengths):
    out, code, last = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (code, last)
        code += 1
    return out


AC = {s: 8 for s in range(250)} | {s: 12 for s in range(250, 256)}


def scalar_scan(blocks, ss, se, ah, al, codes):
    """One lane of a scan."""
    out, pred, eob, held = Bits(), 0, 0, []

    def flush():
        nonlocal eob, held
        if eob:
            n = eob.bit_length() - 1
            out.put(*codes[n << 4])
            out.put(eob - (1 << n), n)
        for b in held:
            out.put(b, 1)
        eob, held = 0, []

    for z in blocks:
        z = [int(x) for x in z]
        if ss == 0:
            if ah:
                out.put(z[0] >> al & 1, 1)
            else:
                d, pred = (z[0] >> al) - pred, z[0] >> al
                n = abs(d).bit_length()
                out.put(*codes[n])
                out.put(d if d >= 0 else d + (1 << n) - 1, n)
            continue
        mags = [abs(x) >> al for x in z]
        fresh = [k for k in range(ss, se + 1) if (mags[k] == 1 if ah else mags[k])]
        r, bits = 0, []
        for k in range(ss, se + 1):
            m = mags[k]
            if not fresh or k > fresh[-1]:
                if ah and m > 1:
                    bits.append(m & 1)
                continue
            if m == 0:
                r += 1
                if r == 16:
                    flush()
                    out.put(*codes[0xF0])
                    for b in bits:
                        out.put(b, 1)
                    r, bits = 0, []
                continue
            if ah and m > 1:
                bits.append(m & 1)
                continue
            flush()
            n = 1 if ah else m.bit_length()
            out.put(*codes[r << 4 | n])
            v = (1 if z[k] > 0 else 0) if ah else (m if z[k] > 0 else (1 << n) - 1 - m)
            out.put(v, n)
            for b in bits:
                out.put(b, 1)
            r, bits = 0, []
        if not fresh or fresh[-1] < se:
            eob += 1
            held += bits
            if eob == 32767:
                flush()
    flush()
    return out.data()


def scalar_file(blocks, across, script, interval, quant):
    codes, seg = code_of(AC), jpeg._segment
    counts, symbols = jpeg.lengths_to_table(AC)
    table = bytes(counts) + symbols
    out = b"\xff\xd8" + seg(0xDB, b"\0" + bytes(map(int, quant))) + seg(0xC4, b"\x00" + table + b"\x10" + table) + seg(0xDD, interval.to_bytes(2, "big"))
    h, w = len(blocks) // across * 8, across * 8
    out += seg(0xC2, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00")
    for ss, se, ah, al in script:
        out += seg(0xDA, bytes([1, 1, 0, ss, se, ah << 4 | al]))
        step = interval or len(blocks)
        lanes = [scalar_scan(blocks[i : i + step], ss, se, ah, al, codes) for i in range(0, len(blocks), step)]
        out += b"".join(x + (bytes([255, 0xD0 + i % 8]) if i < len(lanes) - 1 else b"") for i, x in enumerate(lanes))
    return out + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 5])
@pytest.mark.parametrize("density", [0.02, 0.3, 0.97])
def test_decoder_reads_what_the_standard_says(interval, density):
    rng = np.random.default_rng(int(density * 100) + interval)
    blocks = np.where(rng.random((24, 64)) < density, rng.integers(-300, 301, (24, 64)), 0)
    blocks[3:9] = 0
    quant = rng.integers(1, 9, 64)
    script = [(0, 0, 0, 1), (1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (0, 0, 1, 0), (1, 63, 1, 0)]
    files = [scalar_file(blocks, a, script, interval, quant) for a in (4, 6)]
    images, coefs = jpeg.decode(files)
    for im in images:
        c = im.components[0]
        assert np.array_equal(coefs[c.first : c.first + 24], blocks)
    zz = [(i // 8, i % 8) for i in jpeg.ZIGZAG]
    f = np.zeros((8, 8))
    for (v, u), x, q in zip(zz, blocks[0], quant, strict=True):
        f[v, u] = x * q
    k = lambda n: np.sqrt(0.5) if n == 0 else 1.0
    want = np.array([[128 + sum(k(u) * k(v) / 4 * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)])
    assert np.abs(jpeg.planes(images[0], coefs)[0][:8, :8] - want).max() < 1e-2
    assert np.abs(jpeg.rgb(images[0], coefs)[:8, :8, 1] - np.rint(want).clip(0, 255)).max() <= 1


def test_encoder_keeps_coefficients():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(-128, 128, (n, 64)) for n in (1, 5, 6, 7, 40)]
    blocks += [np.where(rng.random((30, 64)) < p, rng.integers(-m, m + 1, (30, 64)), 0) for p, m in ((0.1, 1023), (0.3, 2), (0.03, 1), (0, 1))]
    images, coefs = jpeg.decode(jpeg.encode(blocks, [b""] * len(blocks)))
    for b, im in zip(blocks, images, strict=True):
        own = np.concatenate([coefs[c.first : c.first + c.padded * c.rows] for c in im.components])
        assert np.array_equal(own[: len(b)], b) and not own[len(b) :].any()


def test_chroma_is_brought_to_full_resolution():
    z = np.zeros((6, 64), np.int64)
    z[4, 0], z[5, 0] = 8 * 20, -8 * 10
    images, coefs = jpeg.decode(jpeg.encode([z], [b""]))
    t = jpeg.rgb(images[0], coefs)
    y, cb, cr = 128, 20, -10
    assert t.shape == (16, 16, 3) and (t == np.rint([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb])).all()


def test_broken_files_raise():
    f = jpeg.encode([np.ones((6, 64), np.int64) * 3], [b""])[0]
    for bad in (b"", b"GIF89a", f[: len(f) // 2], f.replace(b"\xff\xc2", b"\xff\xc9")):
        with pytest.raises((ValueError, IndexError)):
            jpeg.decode([bad])


def check(row, text):
    data = (text or "").encode()
    payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
    assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_hard_cases(spark):
    rows = [*hard_rows(), (900, "x" * 64, None, None, None), (901, "x" * 63, None, None, None), (902, "x" * 65, None, None, None)]
    got = media.read_media(media.store_media(clashing(frame(spark, rows)))).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), media.payload_blocks((r[1] or "").encode()).astype(np.int16).tobytes()) for r in rows)
    back = lambda p: (np.frombuffer(p, np.uint8).astype(np.int16) - 128).tobytes()
    assert sorted((str(r.doc_id), r.n_bytes, back(r.payload)) for r in got) == want
    assert all(len(r.rgb) == r.height * r.width * 3 for r in got)
    same = [bytes(r.media) for r in got if r.doc_id == 5]
    assert same[0] == same[1]


def test_null_media(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert [tuple(r) for r in media.read_media(df).collect()] == [(1, None, None, None, None, None, None)]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = media.op1_media(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        check(r, texts[r.doc_id])


def test_empty_table(spark):
    assert media.read_media(media.store_media(spark.createDataFrame([], SCHEMA))).count() == 0
