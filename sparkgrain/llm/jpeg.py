"""Progressive JPEG columns to full-resolution RGB tensors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkgrain.llm.common import arrow_map, c

_ZIGZAG = np.array([i * 8 + (s - i) if s % 2 else (s - i) * 8 + i for s in range(15) for i in range(max(0, s - 7), min(s, 7) + 1)])
_DCT = np.array([[(0.5 if u else 0.5**0.5 / 2) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


#: Frames of more pixels are refused: a tensor must fit its task.
MOST_PIXELS = 1 << 26


class BadImage(ValueError):
    """Bytes that are no JPEG this decoder reads."""


@dataclass
class _Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0
    high: int = 0
    stride: int = 0
    coef: list = field(default_factory=list)


#: Bytes of a segment whose bit windows are laid out at once, and bits that one block's symbols may take of them.
_WINDOW, _BLOCK_BITS = 1 << 15, 64 * 32 + 64


class _Bits:
    """A segment's bits as numpy windows: the 16 bits from every bit on, and what each code table reads there."""

    def __init__(self, data: bytes):
        self.raw = np.frombuffer(data + b"\0" * 8, np.uint8)  # what is read past them ends in an IndexError
        self.fill(0)

    def fill(self, at: int) -> int:
        """Lay out the windows from the byte that holds bit `at`; the place of that bit in them."""
        first = at >> 3
        b = self.raw[first : first + _WINDOW + 4].astype(np.uint32)
        three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        self.array = (three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)[None] & 0xFFFF).ravel().astype(np.uint16)
        self.base, self.peek, self.read = 8 * first, self.array.tolist(), {}
        self.most = len(self.peek) - _BLOCK_BITS if first + _WINDOW + 4 < len(self.raw) else len(self.peek)
        return at - self.base

    def codes(self, table: tuple) -> list[int]:
        """By bit: length << 8 | symbol of the code that starts there; 0 where there is none."""
        if id(table) not in self.read:
            longest, entries = table
            self.read[id(table)] = entries[self.array >> (16 - longest)].tolist()
        return self.read[id(table)]


def _table(counts: bytes, symbols: bytes) -> tuple[int, np.ndarray]:
    """The longest code's length, and for each value of so many bits length << 8 | symbol of the code at its start."""
    longest = max((n for n in range(1, 17) if counts[n - 1]), default=1)
    entries, at, k = np.zeros(1 << longest, np.uint16), 0, 0
    for n in range(1, longest + 1):
        for _ in range(counts[n - 1]):
            span = 1 << (longest - n)
            if k >= len(symbols) or at + span > len(entries):
                raise BadImage("a code table is broken")
            entries[at : at + span] = n << 8 | symbols[k]
            at, k = at + span, k + 1
    return longest, entries


def _dc_first(bits: _Bits, units: list, al: int) -> None:
    p, dc, peek = 0, {}, bits.peek
    for comp, table, _, block in units:
        if p > bits.most:
            p = bits.fill(bits.base + p)
            peek = bits.peek
        e = bits.codes(table)[p]
        if not e:
            raise BadImage("no such code")
        p, s = p + (e >> 8), e & 255
        if s:
            if s > 15:
                raise BadImage("no such difference")
            v = peek[p] >> (16 - s)
            p += s
            dc[comp] = dc.get(comp, 0) + (v if v >> (s - 1) else v - (1 << s) + 1)
        block[0] = dc.get(comp, 0) * (1 << al)


def _dc_refine(bits: _Bits, units: list, al: int) -> None:
    p = 0
    for _, _, _, block in units:
        if p > bits.most:
            p = bits.fill(bits.base + p)
        if bits.peek[p] >> 15:
            block[0] |= 1 << al
        p += 1


def _ac_first(bits: _Bits, units: list, ss: int, se: int, al: int) -> None:
    p, run, table = 0, 0, units[0][2]
    peek, codes, most = bits.peek, bits.codes(table), bits.most
    for _, _, _, block in units:
        if run:
            run -= 1
            continue
        if p > most:
            p = bits.fill(bits.base + p)
            peek, codes, most = bits.peek, bits.codes(table), bits.most
        k = ss
        while k <= se:
            e = codes[p]
            p += e >> 8
            r, s = e >> 4 & 15, e & 15
            if s:
                k += r
                if k > se:
                    raise BadImage("a run leaves its block")
                v = peek[p] >> (16 - s)
                p += s
                block[k] = (v if v >> (s - 1) else v - (1 << s) + 1) * (1 << al)
                k += 1
            elif not e:
                raise BadImage("no such code")
            elif r == 15:
                k += 16
            else:
                run = (1 << r) - 1
                if r:
                    run += peek[p] >> (16 - r)
                    p += r
                break


def _ac_refine(bits: _Bits, units: list, ss: int, se: int, al: int) -> None:
    p, run, table, one = 0, 0, units[0][2], 1 << al
    peek, codes, most = bits.peek, bits.codes(table), bits.most
    for _, _, _, block in units:
        if p > most:
            p = bits.fill(bits.base + p)
            peek, codes, most = bits.peek, bits.codes(table), bits.most
        k = ss
        while not run and k <= se:
            e = codes[p]
            if not e:
                raise BadImage("no such code")
            p += e >> 8
            r, new = e >> 4 & 15, 0
            if e & 15:
                new = one if peek[p] >> 15 else -one
                p += 1
            elif r < 15:
                run = 1 << r
                if r:
                    run += peek[p] >> (16 - r)
                    p += r
                break
            while k <= se:
                v = block[k]
                if v:
                    if peek[p] >> 15 and not abs(v) & one:
                        block[k] = v + (one if v > 0 else -one)
                    p += 1
                elif r:
                    r -= 1
                else:
                    if new:
                        block[k] = new
                    k += 1
                    break
                k += 1
        if run:
            while k <= se:
                v = block[k]
                if v:
                    if peek[p] >> 15 and not abs(v) & one:
                        block[k] = v + (one if v > 0 else -one)
                    p += 1
                k += 1
            run -= 1


def _sequential(bits: _Bits, units: list) -> None:
    p, dc, peek = 0, {}, bits.peek
    for comp, table, ac, block in units:
        if p > bits.most:
            p = bits.fill(bits.base + p)
            peek = bits.peek
        codes, k = bits.codes(table), 0
        while k < 64:
            e = codes[p]
            if not e:
                raise BadImage("no such code")
            p += e >> 8
            r, s = (0, e & 255) if not k else (e >> 4 & 15, e & 15)
            if s > 15:
                raise BadImage("no such difference")
            k += r
            if s:
                if k > 63:
                    raise BadImage("a run leaves its block")
                v = peek[p] >> (16 - s)
                p += s
                block[k] = v if v >> (s - 1) else v - (1 << s) + 1
            elif k and r < 15:
                break
            if not k:
                block[0] = dc[comp] = dc.get(comp, 0) + block[0]
                codes = bits.codes(ac)
            k += 1


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments from a place on, parted at restart marks, and where the next marker is."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise BadImage("the file ends early")
        m = data[at + 1]
        if m == 0:
            at += 2
        elif 0xD0 <= m <= 0xD7:
            out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            at = start = at + 2
        elif m == 0xFF:
            at += 1
        else:
            out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            return out, at


def _scan(segments: list[bytes], comps: list[tuple[_Component, tuple | None, tuple | None]], frame: tuple, ss: int, se: int, ah: int, al: int, restart: int, progressive: bool) -> None:
    width, height, hmax, vmax = frame
    whole = lambda c, i: (c[0].ident, c[1], c[2], c[0].coef[i])
    if len(comps) == 1:
        c = comps[0]
        units, each = [whole(c, y * c[0].stride + x) for y in range(c[0].high) for x in range(c[0].wide)], 1
    else:
        mx, my = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        units = [whole(c, (y * c[0].v + v) * c[0].stride + x * c[0].h + h) for y in range(my) for x in range(mx) for c in comps for v in range(c[0].v) for h in range(c[0].h)]
        each = sum(c[0].h * c[0].v for c in comps)
    step = (restart or len(units)) * each
    for s, first in enumerate(range(0, len(units), step)):
        if s >= len(segments):
            raise BadImage("a restart interval is missing")
        bits, part = _Bits(segments[s]), units[first : first + step]
        try:
            if not progressive:
                _sequential(bits, part)
            elif ss == 0:
                _dc_refine(bits, part, al) if ah else _dc_first(bits, part, al)
            else:
                (_ac_refine if ah else _ac_first)(bits, part, ss, se, al)
        except IndexError:
            raise BadImage("a scan ends early") from None


def coefficients(data: bytes) -> tuple[tuple, list[_Component], dict, int | None]:
    """Frame, components with their accumulated coefficients (zigzag order), quantisers, and the colour transform told."""
    if data[:2] != b"\xff\xd8":
        raise BadImage("no start of image")
    at, quant, tables, comps = 2, {}, {}, []
    frame, restart, transform, progressive, scans = None, 0, None, True, 0
    while True:
        at = data.find(b"\xff", at)
        while 0 <= at < len(data) - 1 and data[at + 1] == 0xFF:
            at += 1
        if at < 0 or at + 1 >= len(data):
            raise BadImage("the file ends early")
        m = data[at + 1]
        at += 2
        if m == 0xD9:
            break
        if m == 0 or m == 1 or 0xD0 <= m <= 0xD8:
            continue
        n = int.from_bytes(data[at : at + 2], "big")
        body = data[at + 2 : at + n]
        if n < 2 or len(body) != n - 2:
            raise BadImage("a segment ends early")
        at += n
        if m == 0xDB:
            p = 0
            while p < len(body):
                wide = body[p] >> 4
                part = body[p + 1 : p + 1 + 64 * (1 + wide)]
                if wide > 1 or len(part) != 64 * (1 + wide):
                    raise BadImage("a quantiser ends early")
                raw = np.frombuffer(part, ">u2" if wide else np.uint8).astype(np.float64)
                quant[body[p] & 15] = raw
                p += 1 + 64 * (1 + wide)
        elif m == 0xC4:
            p = 0
            while p < len(body):
                counts = body[p + 1 : p + 17]
                tables[body[p]] = _table(counts, body[p + 17 : p + 17 + sum(counts)])
                p += 17 + sum(counts)
        elif m in (0xC0, 0xC1, 0xC2):
            if frame or body[0] != 8:
                raise BadImage("frames of other than 8 bits are not read")
            progressive = m == 0xC2
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            comps = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if not width or not height or len(comps) not in (1, 3) or any(not (0 < x.h <= 4 and 0 < x.v <= 4) for x in comps):
                raise BadImage("the frame is not one of grey or three colours")
            hmax, vmax = max(x.h for x in comps), max(x.v for x in comps)
            frame = (width, height, hmax, vmax)
            mcus = -(-width // (8 * hmax)) * -(-height // (8 * vmax))
            if width * height > MOST_PIXELS or mcus > 8 * len(data):  # a unit takes a bit at least
                raise BadImage(f"a frame of {width} x {height} is too large, or more than these bytes hold")
            for x in comps:
                x.wide, x.high = -(-(-(-width * x.h // hmax)) // 8), -(-(-(-height * x.v // vmax)) // 8)
                x.stride = -(-width // (8 * hmax)) * x.h
                x.coef = [[0] * 64 for _ in range(x.stride * (-(-height // (8 * vmax)) * x.v))]
        elif 0xC3 <= m <= 0xCF and m != 0xC8 and m != 0xCC:
            raise BadImage("lossless, hierarchical and arithmetic frames are not read")
        elif m == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif m == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
        elif m == 0xDA:
            if not frame:
                raise BadImage("a scan comes before its frame")
            k = body[0]
            ss, se, ah, al = body[1 + 2 * k], body[2 + 2 * k], body[3 + 2 * k] >> 4, body[3 + 2 * k] & 15
            if progressive and (se > 63 or ss > se or (ss == 0) != (se == 0) or (ss and k > 1)):
                raise BadImage("a scan's band is broken")
            chosen = []
            for i in range(k):
                own = [x for x in comps if x.ident == body[1 + 2 * i]]
                if not own:
                    raise BadImage("a scan names no component")
                chosen.append((own[0], tables.get(body[2 + 2 * i] >> 4), tables.get(0x10 | (body[2 + 2 * i] & 15))))
            if any((ss == 0 and ah == 0 and d is None) or ((ss or not progressive) and a is None) for _, d, a in chosen):
                raise BadImage("a scan's code table is missing")
            segments, at = _segments(data, at)
            _scan(segments, chosen, frame, ss, se, ah, al, restart, progressive)
            scans += 1
    if not frame or not scans:
        raise BadImage("no frame or no scan")
    return frame, comps, quant, transform


def _double(x: np.ndarray, axis: int) -> np.ndarray:
    """Twice the samples: three parts of the nearer one to one of the further."""
    x = np.moveaxis(x, axis, 0)
    before, after = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-1:]])
    out = np.empty((2 * len(x), *x.shape[1:]))
    out[0::2], out[1::2] = (3 * x + before) / 4, (3 * x + after) / 4
    return np.moveaxis(out, 0, axis)


def decode(data: bytes) -> np.ndarray:
    """An RGB tensor (height, width, 3) of uint8; raises BadImage."""
    (width, height, hmax, vmax), comps, quant, transform = coefficients(data)
    planes = []
    for x in comps:
        if x.quant not in quant:
            raise BadImage("a quantiser is missing")
        z = np.zeros((len(x.coef), 64))
        z[:, _ZIGZAG] = np.array(x.coef) * quant[x.quant]
        spatial = np.round(_DCT.T @ z.reshape(-1, 8, 8) @ _DCT + 128).clip(0, 255)
        rows = len(x.coef) // x.stride
        plane = spatial.reshape(rows, x.stride, 8, 8).swapaxes(1, 2).reshape(rows * 8, x.stride * 8)
        plane = plane[: -(-height * x.v // vmax), : -(-width * x.h // hmax)]
        for axis, have, most in ((0, x.v, vmax), (1, x.h, hmax)):
            if most == 2 * have:
                plane = _double(plane, axis)
            elif most != have:
                plane = np.take(plane, np.arange(height if axis == 0 else width) * have // most, axis)
        planes.append(plane[:height, :width])
    if len(planes) == 1:
        rgb = np.stack(planes * 3, -1)
    elif transform == 0:
        rgb = np.stack(planes, -1)
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb], -1)
    return np.round(rgb).clip(0, 255).astype(np.uint8)


def tensors(images: DataFrame, key: str = "image_id", image: str = "jpeg") -> DataFrame:
    """Decode a binary column: id, height, width, rgb (height x width x 3 bytes, row by row) and error.

    Spectral-selection and successive-approximation scans accumulate into coefficient arrays; dequantising, the
    inverse transform, chroma upsampling and the colour change are numpy over all blocks of an image. Sequential
    frames are read likewise. No shuffle.

    Nulls: a null image has a null tensor and no error. Bytes that are empty, cut short or no readable JPEG, and frames
    of over MOST_PIXELS or of more units than the file has bits, have a null tensor and say why in error; they never
    stop the job. A null key is carried, repeated rows are each
    decoded, other columns are not carried, so none clash. No rows give no rows.
    """
    kind = images.select(c(key)).schema[0].dataType.simpleString()

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                ids, out = batch.column(0).slice(a, 64), []
                for data in batch.column(1).slice(a, 64).to_pylist():
                    try:
                        rgb = decode(data) if data is not None else None
                        out.append((*rgb.shape[:2], rgb.tobytes(), None) if rgb is not None else (None,) * 4)
                    except Exception as e:  # noqa: BLE001: whatever broken bytes lead to, the other images go on
                        out.append((None, None, None, str(e) or type(e).__name__))
                h, w, x, e = zip(*out)
                yield pa.RecordBatch.from_arrays([ids, pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(x, pa.binary()), pa.array(e, pa.string())], ["id", "height", "width", "rgb", "error"])

    return arrow_map(images.select(c(key).alias("id"), c(image).alias("jpeg")), job, f"id {kind}, height int, width int, rgb binary, error string")
