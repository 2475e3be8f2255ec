"""Progressive JPEG media columns.

`decode` accumulates spectral-selection and successive-approximation scans into coefficient arrays;
`to_rgb` inverse-transforms them in numpy, upsamples chroma and gives a full-resolution RGB tensor.
Scans whose Huffman table has a single code, and refinements of bands without zeros, are read by array
operations; any other scan symbol by symbol.

`payload_to_jpeg` keeps arbitrary bytes in such a file without loss: with unit quantisation a byte is a
coefficient (the format's unit), 64 bytes a block, six blocks a 4:2:0 unit of Y, Cb and Cr.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.blocks import text_rows
from docloom.llm.tokens import slices

#: Place in the 8x8 block of each coefficient in zigzag order: along the diagonals, turning at each.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else (i % 8))))
#: Payload bytes of one file; a multiple of 64.
PIECE = 1 << 22
_END = re.compile(rb"(?<=\xff\xd9)(?=\xff\xd8)")
_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_COS = np.array([[np.sqrt((1 + (u > 0)) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: From 64 coefficients in zigzag order to 64 samples.
_INVERSE = np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG].astype(np.float32)


# ---- reading ---------------------------------------------------------------------------------------


@dataclass
class Component:
    name: int
    h: int
    v: int
    table: int
    width: int = 0  # in blocks, as non-interleaved scans see it
    height: int = 0
    coefficients: np.ndarray = field(default=None, repr=False)  # rows x columns x 64, zigzag, padded to whole units


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


class Bits:
    """Bits of one entropy-coded segment, most significant first."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def read(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out * 2 + b
        self.at += n
        return out

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            if self.at >= len(self.bits):
                raise ValueError("the scan ends too early")
            code = code * 2 + int(self.bits[self.at])
            self.at += 1
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such Huffman code")

    def array(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the scan ends too early")
        self.at += n
        return out

    def records(self, n: int, skip: int, size: int) -> np.ndarray:
        """n numbers of `size` bits, each after `skip` bits."""
        bits = self.array(n * (skip + size)).reshape(n, skip + size)[:, skip:]
        packed = np.packbits(bits, axis=1)
        value = packed[:, 0].astype(np.int32)
        for i in range(1, packed.shape[1]):
            value = value << 8 | packed[:, i]
        return value >> (-size % 8)


def signed(value, size):
    """A JPEG magnitude: the lower half of the range stands for negative numbers."""
    return np.where(value < 1 << (size - 1), value - (1 << size) + 1, value) if isinstance(value, np.ndarray) else value if size == 0 or value >= 1 << (size - 1) else value - (1 << size) + 1


def huffman(counts: bytes, symbols: bytes) -> dict:
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code *= 2
    return out


def decode(data: bytes) -> Image:
    """Coefficients of a progressive JPEG file.  Raises ValueError if it isn't one."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    image, at, tables, interval = Image(), 2, {}, 0
    while True:
        if data[at : at + 1] != b"\xff":
            raise ValueError("no marker where one is due")
        while data[at + 1 : at + 2] == b"\xff":
            at += 1
        marker = data[at + 1] if at + 1 < len(data) else 0xD9
        at += 2
        if marker == 0xD9:
            break
        length = struct.unpack(">H", data[at : at + 2])[0]
        body, at = data[at + 2 : at + length], at + length
        if marker == 0xC2:
            _frame(image, body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDA:
            end = _NEXT_MARKER.search(data, at)
            stop = end.start() if end else len(data)
            _scan(image, body, data[at:stop], tables, interval)
            at = stop
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive Huffman-coded frame")
    if not image.components:
        raise ValueError("no frame")
    return image


def _frame(image: Image, body: bytes) -> None:
    precision, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
    if precision != 8 or not image.width or not image.height:
        raise ValueError("only 8-bit frames of a stated size")
    image.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    across, down = -(-image.width // (8 * h)), -(-image.height // (8 * v))
    for c in image.components:
        c.width, c.height = -(-(-(-image.width * c.h // h)) // 8), -(-(-(-image.height * c.v // v)) // 8)
        c.coefficients = np.zeros((down * c.v, across * c.h, 64), np.int32)


def _scan(image: Image, body: bytes, data: bytes, tables: dict, interval: int) -> None:
    n = body[0]
    by_name = {c.name: c for c in image.components}
    chosen = [(by_name[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(n)]
    start, end, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    # Blocks in coding order: (component number, row, column); a unit is what a restart interval counts.
    if n == 1:
        c = chosen[0][0]
        rows, columns = np.divmod(np.arange(c.width * c.height), c.width)
        order, unit = [(0, rows, columns)], 1
    else:
        order, unit = _interleaved(chosen), None
    segments = _RESTART.split(data) if interval else [data]
    if n == 1:
        _, rows, columns = order[0]
        step = interval or len(rows)
        for k, segment in enumerate(segments):
            part = slice(k * step, min(len(rows), (k + 1) * step))
            view = chosen[0][0].coefficients[rows[part], columns[part]]
            _run(Bits(segment), view, [0] * len(view), [chosen[0][1]], start, end, high, low, tables)
            chosen[0][0].coefficients[rows[part], columns[part]] = view
    else:
        if start or end:
            raise ValueError("only DC scans may be interleaved")
        which, rows, columns, unit = order
        step = interval * unit if interval else len(which)
        for k, segment in enumerate(segments):
            part = slice(k * step, min(len(which), (k + 1) * step))
            view = np.stack([chosen[w][0].coefficients[r, c] for w, r, c in zip(which[part], rows[part], columns[part], strict=True)])
            _run(Bits(segment), view, which[part], [t for _, t in chosen], start, end, high, low, tables)
            for x, w, r, c in zip(view, which[part], rows[part], columns[part], strict=True):
                chosen[w][0].coefficients[r, c] = x


def _interleaved(chosen):
    first = chosen[0][0]
    down, across = first.coefficients.shape[0] // first.v, first.coefficients.shape[1] // first.h
    which, rows, columns = [], [], []
    for y in range(down):
        for x in range(across):
            for w, (c, _) in enumerate(chosen):
                for i in range(c.v):
                    for j in range(c.h):
                        which.append(w)
                        rows.append(y * c.v + i)
                        columns.append(x * c.h + j)
    return which, rows, columns, sum(c.h * c.v for c, _ in chosen)


def _run(bits: Bits, blocks: np.ndarray, which, selectors, start, end, high, low, tables) -> None:
    """One segment of a scan, into blocks (n x 64)."""
    if start == 0:
        if high:
            blocks[:, 0] |= bits.array(len(blocks)).astype(np.int32) << low
        else:
            _dc_first(bits, blocks, which, [tables[s >> 4] for s in selectors], low)
    elif high:
        _ac_refine(bits, blocks, start, end, low, tables[0x10 | selectors[0] & 15])
    else:
        _ac_first(bits, blocks, start, end, low, tables[0x10 | selectors[0] & 15])


def _dc_first(bits, blocks, which, table, low) -> None:
    if len(table) == 1 and len(table[0]) == 1:
        ((length, _), size), *_ = table[0].items()
        step = signed(bits.records(len(blocks), length, size), size) if size else np.zeros(len(blocks), np.int32)
        blocks[:, 0] = np.cumsum(step) << low
        return
    last = [0] * len(table)
    for k, w in enumerate(which):
        size = bits.symbol(table[w])
        last[w] += signed(bits.read(size), size)
        blocks[k, 0] = last[w] << low


def _ac_first(bits, blocks, start, end, low, table) -> None:
    if len(table) == 1:
        ((length, _), symbol), *_ = table.items()
        if symbol >> 4 == 0 and symbol & 15:  # every coefficient is there, all of one magnitude class
            size, band = symbol & 15, end - start + 1
            value = signed(bits.records(len(blocks) * band, length, size), size)
            blocks[:, start : end + 1] = value.reshape(-1, band) * (1 << low)
            return
    rest = 0
    for block in blocks:
        if rest:
            rest -= 1
            continue
        k = start
        while k <= end:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                block[k] = signed(bits.read(size), size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                rest = (1 << run) + bits.read(run) - 1
                break


def _correct(block, at, one, low) -> None:
    if one and not abs(int(block[at])) >> low & 1:
        block[at] += (1 << low) if block[at] > 0 else -(1 << low)


def _ac_refine(bits, blocks, start, end, low, table) -> None:
    rest, b = 0, 0
    while b < len(blocks):
        block = blocks[b]
        k = start
        if not rest:
            while k <= end:
                run, size = divmod(bits.symbol(table), 16)
                if size == 0 and run < 15:
                    rest = (1 << run) + bits.read(run)
                    break
                new = 0
                if size:
                    new = (1 << low) if bits.read(1) else -(1 << low)
                while k <= end:
                    if block[k]:
                        _correct(block, k, bits.read(1), low)
                    elif run:
                        run -= 1
                    else:
                        break
                    k += 1
                if new and k <= end:
                    block[k] = new
                k += 1
        if rest:
            # What is left of this block and the following ones of the run has correction bits alone.
            span = blocks[b : b + rest, start : end + 1] if k == start else blocks[b : b + 1, k : end + 1]
            there = span != 0
            one = np.zeros(span.shape, bool)
            one[there] = bits.array(int(there.sum())).astype(bool)
            one &= (np.abs(span) >> low & 1) == 0
            span += np.where(one, np.sign(span) << low, 0)
            b, rest = b + len(span), rest - len(span)
        else:
            b += 1


def to_rgb(image: Image) -> np.ndarray:
    """height x width x 3, uint8; one component is grey, three are Y, Cb and Cr."""
    planes = []
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    for c in image.components:
        rows, columns, _ = c.coefficients.shape
        scaled = (c.coefficients * image.quant[c.table]).reshape(-1, 64).astype(np.float32)
        plane = (scaled @ _INVERSE).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        plane = np.clip(np.rint(plane + 128), 0, 255)
        if c.v != v:
            plane = plane.repeat(v // c.v, 0)
        if c.h != h:
            plane = plane.repeat(h // c.h, 1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for k, channel in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, k] = np.clip(np.rint(channel), 0, 255)
    return out


# ---- bytes as coefficients -------------------------------------------------------------------------

#: Byte to AC coefficient: all of 128 to 255 in size, so that each has the same magnitude class in each scan.
_TO_AC = np.array([b if b >= 128 else -(b + 128) for b in range(256)], np.int32)
#: DC coefficients change by 256 to 510 (halved) from block to block; every other block is lower by this.
_DC_DROP = 766
#: Units in a column at most, as a JPEG file is 65,535 samples high at most.
_COLUMN = 4095
_COMMENT = b"payload blocks "


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, by_length: dict[int, list[int]]) -> bytes:
    return bytes([kind, *(len(by_length.get(n, [])) for n in range(1, 17))]) + bytes(s for n in sorted(by_length) for s in by_length[n])


def _entropy(bits: list[np.ndarray]) -> bytes:
    every = np.concatenate(bits)
    every = np.r_[every, np.ones(-len(every) % 8, np.uint8)]
    return np.packbits(every).tobytes().replace(b"\xff", b"\xff\x00")


def _bits_of(value: np.ndarray, size: int) -> np.ndarray:
    """One row of `size` bits for each value, after a 0 bit (the table's only code)."""
    out = np.zeros((len(value), size + 1), np.uint8)
    for i in range(size):
        out[:, 1 + i] = value >> (size - 1 - i) & 1
    return out.ravel()


def _magnitude(value: np.ndarray, size: int) -> np.ndarray:
    return np.where(value < 0, value + (1 << size) - 1, value)


_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64))
#: One code for a DC change of class 9, one for an AC coefficient of class 7, and the runs of ended blocks.
_TABLES = _segment(0xC4, _table(0x00, {1: [0x09]}) + _table(0x10, {1: [0x07]}) + _table(0x11, {4: [16 * r for r in range(15)]}))


def _scan_bytes(name: int, tables: int, start: int, end: int, high: int, low: int, entropy: bytes) -> bytes:
    return _segment(0xDA, bytes([1, name, tables, start, end, high << 4 | low])) + entropy


def payload_to_jpeg(payload: bytes) -> bytes:
    """A progressive JPEG file whose coefficients are the payload; its length is a positive multiple of 64."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    units = -(-len(blocks) // 6)
    across = -(-units // _COLUMN)
    down = -(-units // across)
    units = across * down
    full = np.zeros((6 * units, 64), np.int32)
    full[: len(blocks)] = blocks
    value = _TO_AC[full]
    value[:, 0] = full[:, 0]
    parts = [value[: 4 * units], value[4 * units : 5 * units], value[5 * units :]]
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [_HEAD, _segment(0xFE, _COMMENT + str(len(blocks)).encode()), _segment(0xC2, frame), _TABLES]
    for name, part in enumerate(parts, 1):
        part[::2, 0] -= _DC_DROP
        change = np.diff(part[:, 0] >> 1, prepend=0)
        out.append(_scan_bytes(name, 0x00, 0, 0, 0, 1, _entropy([_bits_of(_magnitude(change, 9), 9)])))
    for name, part, bands in ((1, parts[0], ((1, 5), (6, 63))), (2, parts[1], ((1, 63),)), (3, parts[2], ((1, 63),))):
        for start, end in bands:
            half = part[:, start : end + 1].ravel()
            half = np.sign(half) * (np.abs(half) >> 1)
            out.append(_scan_bytes(name, 0x00, start, end, 0, 1, _magnitude(half, 7).astype(np.uint8).tobytes()))  # a 0 bit and 7 bits
    for name, part in enumerate(parts, 1):
        out.append(_scan_bytes(name, 0x00, 0, 0, 1, 0, _entropy([(part[:, 0] & 1).astype(np.uint8)])))
        bits, at = [], 0
        while at < len(part):
            run = min(len(part) - at, 32767)
            r = run.bit_length() - 1
            bits.append(np.array([r >> i & 1 for i in (3, 2, 1, 0)] + [run >> i & 1 for i in range(r - 1, -1, -1)], np.uint8))
            bits.append((np.abs(part[at : at + run, 1:]) & 1).astype(np.uint8).ravel())
            at += run
        out.append(_scan_bytes(name, 0x01, 1, 63, 1, 0, _entropy(bits)))
    return b"".join([*out, b"\xff\xd9"])


def jpeg_payload(image: Image) -> bytes:
    """The payload that `payload_to_jpeg` has stored."""
    parts = []
    for c in image.components:
        value = c.coefficients.reshape(-1, 64).copy()
        value[::2, 0] += _DC_DROP
        ac = value[:, 1:]
        value[:, 1:] = np.where(ac < 0, -ac - 128, ac)
        parts.append(value)
    n = int(next(c for c in image.comments if c.startswith(_COMMENT))[len(_COMMENT) :])
    return np.concatenate(parts)[:n].astype(np.uint8).tobytes()


# ---- Spark -----------------------------------------------------------------------------------------


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the text as UTF-8, and it with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def payload_to_media(payload: bytes) -> bytes:
    """The payload as a JPEG file, or as several end to end if it is longer than PIECE, so that memory stays bounded."""
    return b"".join(payload_to_jpeg(payload[at : at + PIECE]) for at in range(0, len(payload), PIECE))


def files_of(media: bytes) -> list[bytes]:
    """The files of a stored payload; anything else is one file."""
    return _END.split(media) if media.startswith(_HEAD) and media.startswith(_COMMENT, len(_HEAD) + 4) else [media]


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text kept without loss in a progressive JPEG file.

    A null text is empty (64 zero bytes).  One row for each input row; equal texts have equal files.  Texts
    are stored whole; one of more than PIECE bytes is kept in several files end to end.  An empty table gives an
    empty result.
    """

    def encode(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):  # files of some texts at a time
                part = batch.slice(lo, hi - lo)
                both = [padded(x.as_py()) for x in part.column("text")]
                yield pa.record_batch([part.column("doc_id"), pa.array([n for n, _ in both], pa.int64()), pa.array([payload_to_media(p) for _, p in both], pa.binary())], ["doc_id", "n_bytes", "media"])

    return text_rows(docs, id_col, text_col).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def decode_images(media: DataFrame, media_col: str = "media", tensors: bool = True) -> DataFrame:
    """The rows with height, width, tensor (height x width x 3 bytes of RGB), error, and for stored texts their payload.

    A null file has null results; a file that isn't a progressive JPEG has an error and null results.
    feature is the size and the sum of each channel of the tensor.  Where a stored text has several files, height
    and width are the first one's, and tensors and features stand end to end.  Without `tensors` the tensor
    column is left null.
    """
    added = ("height int", "width int", "tensor binary", "feature string", "payload binary", "error string")
    names = [a.split()[0] for a in added]

    def read(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = [_read(x.as_py(), tensors) for x in part.column(media_col)]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.string())
                yield pa.record_batch([*part.columns, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [*part.schema.names, *names])

    columns = [f"`{n}` {t}" for n, t in media.drop(*names).dtypes]
    return media.drop(*names).mapInArrow(read, ", ".join([*columns, *added]))


def _read(data: bytes | None, tensors: bool):
    if data is None:
        return (None,) * 6
    read = []
    try:
        for own in files_of(data):
            image = decode(own)
            rgb = to_rgb(image)
            sums = ":".join(map(str, rgb.sum((0, 1), dtype=np.int64).tolist()))
            ours = any(c.startswith(_COMMENT) for c in image.comments)
            read.append((image.height, image.width, rgb.tobytes() if tensors else b"", f"{image.width}x{image.height}:{sums}", jpeg_payload(image) if ours else None))
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return None, None, None, None, None, str(e) or type(e).__name__
    _, _, rgb_bytes, features, payloads = zip(*read, strict=True)
    return read[0][0], read[0][1], b"".join(rgb_bytes) if tensors else None, ";".join(features), None if payloads[0] is None else b"".join(payloads), None


def media_digest(stored: DataFrame) -> DataFrame:
    """What was read back from the stored files, by row: lengths, hashes and the feature of the RGB tensor."""

    def digest(batches):
        for whole in batches:
            for at in range(0, len(whole), 256):
                yield part(whole.slice(at, 256))

    def part(batch):
        rows = []
        for media in batch.column("media"):
            data = media.as_py()
            _, _, _, feature, payload, error = _read(data, False)
            if error:
                raise ValueError(error)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return stored.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
