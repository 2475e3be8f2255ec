"""The decoder against an encoder written here, symbol by symbol, and exact round trips of stored texts."""

import hashlib
import random
import struct

import numpy as np
import pytest

from docloom.llm import progressive_jpeg as J


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def code(self, symbol):
        self.put(symbol, 8)  # every code has 8 bits: symbols below 255 in order

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def magnitude(w, value):
    size = int(abs(value)).bit_length()
    return size, value if value >= 0 else value + (1 << size) - 1


def dc_scan(order, blocks, low, n):
    w, last = Writer(), [0] * n
    for c, r, k in order:
        value = int(blocks[c][r, k, 0]) >> low
        size, bits = magnitude(w, value - last[c])
        last[c] = value
        w.code(size)
        w.put(bits, size)
    return w.done()


def ac_first(blocks, start, end, low):
    w, rest = Writer(), 0

    def flush():
        nonlocal rest
        if rest:
            r = rest.bit_length() - 1
            w.code(r * 16)
            w.put(rest - (1 << r), r)
            rest = 0

    for b in blocks:
        run = 0
        for k in range(start, end + 1):
            v = int(b[k])
            v = (abs(v) >> low) * (1 if v > 0 else -1)
            if v == 0:
                run += 1
                continue
            flush()
            while run > 15:
                w.code(0xF0)
                run -= 16
            size, bits = magnitude(w, v)
            w.code(run * 16 + size)
            w.put(bits, size)
            run = 0
        if run:
            rest += 1
    flush()
    return w.done()


def ac_refine(blocks, start, end, low):
    """Each block on its own: correction bits follow the symbol they belong to."""
    w = Writer()
    for b in blocks:
        old = [abs(int(x)) >> (low + 1) for x in b]
        new = [k for k in range(start, end + 1) if not old[k] and abs(int(b[k])) >> low & 1]
        k = start
        for at in new:
            run, fixes, zeros = 0, [], 0
            while True:
                if k == at:
                    w.code(zeros * 16 + 1)
                    w.put(int(b[k] > 0), 1)
                    for f in fixes:
                        w.put(f, 1)
                    k += 1
                    break
                if old[k]:
                    fixes.append(abs(int(b[k])) >> low & 1)
                elif zeros == 15:
                    w.code(0xF0)
                    for f in fixes:
                        w.put(f, 1)
                    fixes, zeros = [], 0
                else:
                    zeros += 1
                k += 1
            del run
        if k <= end:
            w.code(0)  # end of this block
            for i in range(k, end + 1):
                if old[i]:
                    w.put(abs(int(b[i])) >> low & 1, 1)
    return w.done()


def picture(width, height, sampling, rng):
    """A progressive file of random coefficients, and them."""
    h, v = max(a for a, _ in sampling), max(b for _, b in sampling)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    blocks = [np.where(rng.random((down * b, across * a, 64)) < 0.2, rng.integers(-40, 41, (down * b, across * a, 64)), 0) for a, b in sampling]
    sizes = [(-(-(-(-width * a // h)) // 8), -(-(-(-height * b // v)) // 8)) for a, b in sampling]
    for c, (w, t) in enumerate(sizes):  # single scans don't reach the padding
        blocks[c][t:, :, 1:] = 0
        blocks[c][:, w:, 1:] = 0
    table = bytes([0, 0, 0, 0, 0, 0, 0, 255, *[0] * 8]) + bytes(range(255))
    out = b"\xff\xd8" + J._segment(0xDB, bytes([0]) + bytes(range(1, 65)))
    out += J._segment(0xC2, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i, a << 4 | b, 0]) for i, (a, b) in enumerate(sampling)))
    out += J._segment(0xC4, bytes([0x00]) + table + bytes([0x10]) + table)
    order = [(c, y * b + i, x * a + j) for y in range(down) for x in range(across) for c, (a, b) in enumerate(sampling) for i in range(b) for j in range(a)]
    if len(sampling) == 1:
        order = [(0, r, k) for r in range(sizes[0][1]) for k in range(sizes[0][0])]
    head = lambda names, start, end, high, low: J._segment(0xDA, bytes([len(names), *(x for n in names for x in (n, 0)), start, end, high << 4 | low]))
    out += head(range(len(sampling)), 0, 0, 0, 1) + dc_scan(order, blocks, 1, len(sampling))
    for c, (w, t) in enumerate(sizes):
        own = blocks[c][:t, :w].reshape(-1, 64)
        for start, end in ((1, 5), (6, 63)):
            out += head([c], start, end, 0, 2) + ac_first(own, start, end, 2)
        for low in (1, 0):
            out += head([c], 1, 63, low + 1, low) + ac_refine(own, 1, 63, low)
    w = Writer()
    for c, r, k in order:
        w.put(int(blocks[c][r, k, 0]) & 1, 1)
    return out + head(range(len(sampling)), 0, 0, 1, 0) + w.done() + b"\xff\xd9", blocks


@pytest.mark.parametrize(("width", "height", "sampling"), [(8, 8, [(1, 1)]), (30, 21, [(1, 1)]), (33, 17, [(2, 2), (1, 1), (1, 1)]), (40, 24, [(2, 1), (1, 1), (1, 1)]), (16, 16, [(1, 1)] * 3)])
def test_decoder(width, height, sampling):
    data, blocks = picture(width, height, sampling, np.random.default_rng(width))
    image = J.decode(data)
    for c, b in zip(image.components, blocks, strict=True):
        t, w = (c.height, c.width) if len(blocks) == 1 else b.shape[:2]
        assert (c.coefficients[:t, :w] == b[:t, :w]).all()
    rgb = J.to_rgb(image)
    assert rgb.shape == (height, width, 3) and rgb.dtype == np.uint8


def test_inverse_transform():
    rng = np.random.default_rng(3)
    plane = rng.integers(0, 256, (8, 8)).astype(float)
    freq = J._COS @ (plane - 128) @ J._COS.T
    zig = freq.reshape(64)[J.ZIGZAG]
    assert np.allclose(zig @ J._INVERSE + 128, plane.reshape(64), atol=1e-3)


def test_zigzag_starts_as_the_format_says():
    assert J.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and J.ZIGZAG[-3:].tolist() == [55, 62, 63]


def test_payloads_round_trip():
    rng = random.Random(1)
    for n in (64, 128, 384, 448, 6400, 64 * 6 * 4095 + 64):
        payload = rng.randbytes(n)
        assert J.jpeg_payload(J.decode(J.payload_to_jpeg(payload))) == payload


def test_queries_on_the_corpus(spark, corpus):
    out = J.media_digest(J.store_texts(corpus["docs"])).collect()
    expected = []
    for r in corpus["rows"]:
        raw = (r[1] or "").encode()
        expected.append((r[0], len(raw), hashlib.sha256(raw + bytes(-len(raw) % 64 if raw else 64)).hexdigest()))
    assert sorted(map(str, ((r["doc_id"], r["n_bytes"], r["payload_sha256"]) for r in out))) == sorted(map(str, expected))
    assert J.media_digest(J.store_texts(corpus["empty"])).count() == 0


def test_long_texts_are_kept_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(J, "PIECE", 640)
    for n in (64, 640, 704, 6400, 6464):
        payload = random.Random(n).randbytes(n)
        media = J.payload_to_media(payload)
        assert len(J.files_of(media)) == -(-n // 640)
        read = J._read(media, True)
        assert read[4] == payload and read[5] is None and len(read[3].split(";")) == -(-n // 640) and len(read[2]) % 3 == 0
    monkeypatch.undo()
    text = "long text \u00e9 " * 900_000  # 11 MB: three files
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in J.media_digest(J.store_texts(docs)).collect()}
    n, payload = J.padded(text)
    assert out[1]["n_bytes"] == n and out[1]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and out[1]["feature"].count(";") == 2


def test_bad_files_have_an_error(spark):
    good = J.payload_to_jpeg(bytes(64))
    rows = [(1, good), (2, None), (3, b""), (4, b"\xff\xd8\xff"), (5, good[:300]), (6, b"GIF89a")]
    out = {r["id"]: r for r in J.decode_images(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert out[1]["error"] is None and len(out[1]["tensor"]) == 16 * 16 * 3 and out[1]["payload"] == bytes(64)
    assert out[2]["error"] is None and out[2]["tensor"] is None
    assert all(out[i]["error"] and out[i]["tensor"] is None for i in (3, 4, 5, 6))
