"""A writer of progressive JPEG, for a media column out of tables that hold none."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkgrain.llm.common import arrow_map, c
from sparkgrain.llm.jpeg import _DCT, _ZIGZAG

#: (components, first and last coefficient, bits known before, bits left out), DC together and each AC band alone.
SCANS = [
    ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1),
    ((0, 1, 2), 0, 0, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0),
]
#: Spectral selection alone: no bits are left out for later.
SPECTRAL = [((0, 1, 2), 0, 0, 0, 0), ((0,), 1, 9, 0, 0), ((2,), 1, 63, 0, 0), ((1,), 1, 63, 0, 0), ((0,), 10, 63, 0, 0)]
_QUANT = np.full(64, 6.0)


#: Longest end-of-band run that a scan writes.
MOST_RUN = 0x7FFF


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths by symbol, one more symbol counted so that no code is all ones; of one length if over 16."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate([(-1, 0), *sorted(counts.items())])]
    heapq.heapify(heap)
    depth = dict.fromkeys([-1, *counts], 0)
    tie = len(heap)
    while len(heap) > 1:
        (n, _, x), (m, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*x, *y):
            depth[s] += 1
        heapq.heappush(heap, (n + m, tie, x + y))
        tie += 1
    if max(depth.values()) > 16:
        depth = dict.fromkeys(depth, len(depth).bit_length())
    del depth[-1]  # the least frequent is one of the deepest, and as the last of them it would be all ones
    return depth


class _Writer:
    """Symbols and bits of a scan, parted at restarts; end-of-band runs wait until something else is written."""

    def __init__(self, runs: bool) -> None:
        self.runs, self.parts, self.run, self.held = runs, [[]], 0, []

    def symbol(self, s: int) -> None:
        self.flush()
        self.parts[-1].append((-1, s))

    def bits(self, value: int, n: int) -> None:
        if n:
            self.parts[-1].append((n, value))

    def end(self, corrections: list[int]) -> None:
        """A block's band ends, with the corrections that belong to its rest."""
        self.run += 1
        self.held += corrections
        if not self.runs or self.run == MOST_RUN:
            self.flush()

    def flush(self) -> None:
        if self.run:
            k, run, held = self.run.bit_length() - 1, self.run, self.held
            self.run, self.held = 0, []
            self.parts[-1].append((-1, k << 4))
            self.bits(run - (1 << k), k)
            for b in held:
                self.bits(b, 1)

    def restart(self) -> None:
        self.flush()
        self.parts.append([])

    def bytes(self) -> tuple[bytes, bytes]:
        """Code table and coded bytes, with restart markers between the parts."""
        self.flush()
        counts: dict[int, int] = {}
        for part in self.parts:
            for n, s in part:
                if n < 0:
                    counts[s] = counts.get(s, 0) + 1
        depth = _lengths(counts)
        order, code, at, last = sorted(depth, key=lambda s: (depth[s], s)), {}, 0, 0
        for s in order:
            at <<= depth[s] - last
            code[s], last = (depth[s], at), depth[s]
            at += 1
        out = []
        for i, part in enumerate(self.parts):
            value, total = 1, 0
            for n, x in part:
                k, v = code[x] if n < 0 else (n, x)
                value, total = (value << k) | v, total + k
            pad = -total % 8
            value, total = (value << pad) | ((1 << pad) - 1), total + pad
            out.append(((value ^ (1 << total)).to_bytes(total // 8, "big") if total else b"").replace(b"\xff", b"\xff\x00"))
            out.append(b"\xff" + bytes([0xD0 + i % 8]))
        lengths = bytes(sum(x == n for x in depth.values()) for n in range(1, 17))
        return lengths + bytes(order), b"".join(out[:-1])


def _dc(w: _Writer, value: int, before: int) -> None:
    d = value - before
    s = abs(d).bit_length()
    w.symbol(s)
    w.bits(d if d >= 0 else d + (1 << s) - 1, s)


def _ac_first(w: _Writer, block: list, ss: int, se: int, al: int) -> None:
    r = 0
    for k in range(ss, se + 1):
        v = abs(block[k]) >> al
        if not v:
            r += 1
            continue
        while r > 15:
            w.symbol(0xF0)
            r -= 16
        s = v.bit_length()
        w.symbol(r << 4 | s)
        w.bits(v if block[k] > 0 else v ^ ((1 << s) - 1), s)
        r = 0
    if r:
        w.end([])


def _ac_refine(w: _Writer, block: list, ss: int, se: int, al: int) -> None:
    size = [abs(v) >> al for v in block]
    last = max([k for k in range(ss, se + 1) if size[k] == 1], default=0)
    r, held = 0, []
    for k in range(ss, se + 1):
        v = size[k]
        if not v:
            r += 1
            continue
        while r > 15 and k <= last:
            w.symbol(0xF0)
            for b in held:
                w.bits(b, 1)
            held, r = [], r - 16
        if v > 1:
            held.append(v & 1)
            continue
        w.symbol(r << 4 | 1)
        w.bits(int(block[k] > 0), 1)
        for b in held:
            w.bits(b, 1)
        held, r = [], 0
    if r or held:
        w.end(held)


def quantised(rgb: np.ndarray, chroma: int) -> tuple[list[list[list[int]]], list[tuple[int, int, int]]]:
    """Blocks of each component (zigzag) and its blocks across, blocks across in use and down in use."""
    h, w = rgb.shape[:2]
    x = rgb.astype(float)
    y = 0.299 * x[..., 0] + 0.587 * x[..., 1] + 0.114 * x[..., 2]
    planes = [y, 128 + 0.564334 * (x[..., 2] - y), 128 + 0.713267 * (x[..., 0] - y)]
    my, mx = -(-h // (8 * chroma)), -(-w // (8 * chroma))
    out, shape = [], []
    for i, p in enumerate(planes):
        p = np.pad(p, ((0, my * 8 * chroma - h), (0, mx * 8 * chroma - w)), mode="edge")
        f = chroma if i else 1
        p = p.reshape(p.shape[0] // f, f, p.shape[1] // f, f).mean((1, 3)) - 128
        b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2)
        across = b.shape[1]
        q = np.round((_DCT @ b.reshape(-1, 8, 8) @ _DCT.T).reshape(-1, 64)[:, _ZIGZAG] / _QUANT).astype(int)
        out.append(q.tolist())
        shape.append((across, -(-(-(-w // f)) // 8), -(-(-(-h // f)) // 8)))
    return out, shape


def encode(rgb: np.ndarray, chroma: int = 2, scans: list | None = None, restart: int = 0, runs: bool = True) -> bytes:
    """Progressive JPEG of a tensor; chroma samples are 1 / chroma as many either way (1 or 2).

    restart: units between restart markers (0: none); runs: whether end-of-band runs span blocks.
    """
    h, w = rgb.shape[:2]
    blocks, shape = quantised(rgb, chroma)
    seg = lambda m, body: b"\xff" + bytes([m]) + (len(body) + 2).to_bytes(2, "big") + body
    out = [b"\xff\xd8", seg(0xDB, b"\0" + bytes(_QUANT.astype(np.uint8)))]
    parts = b"".join(bytes([i + 1, (chroma if i == 0 else 1) * 17, 0]) for i in range(3))
    out.append(seg(0xC2, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03" + parts))
    if restart:
        out.append(seg(0xDD, restart.to_bytes(2, "big")))
    for comps, ss, se, ah, al in SCANS if scans is None else scans:
        wr, before = _Writer(runs), [0, 0, 0]
        if len(comps) > 1:
            units = [[(i, (my * f + v) * shape[i][0] + mx * f + u) for i in comps for f in [chroma if i == 0 else 1] for v in range(f) for u in range(f)] for my in range(-(-h // (8 * chroma))) for mx in range(-(-w // (8 * chroma)))]
        else:
            i = comps[0]
            units = [[(i, by * shape[i][0] + bx)] for by in range(shape[i][2]) for bx in range(shape[i][1])]
        for at, unit in enumerate(units):
            if restart and at and not at % restart:
                wr.restart()
                before = [0, 0, 0]
            for i, x in unit:
                block = blocks[i][x]
                if ss:
                    (_ac_refine if ah else _ac_first)(wr, block, ss, se, al)
                elif ah:
                    wr.bits(block[0] >> al & 1, 1)
                else:
                    _dc(wr, block[0] >> al, before[i])
                    before[i] = block[0] >> al
        table, raw = wr.bytes()
        if table[16:]:
            out.append(seg(0xC4, bytes([0x10 if ss else 0]) + table))
        out.append(seg(0xDA, bytes([len(comps), *(x for i in comps for x in (i + 1, 0)), ss, se, ah << 4 | al])))
        out.append(raw)
    return b"".join(out) + b"\xff\xd9"


def picture(vector: np.ndarray, height: int = 16, width: int = 16) -> np.ndarray:
    """A picture that shows a vector's values as patches of a square grid."""
    v = np.nan_to_num(np.asarray(vector, float))
    side = int(np.ceil(np.sqrt(len(v))))
    v = np.resize(v, side * side).reshape(side, side)
    span = float(np.abs(v).max()) or 1.0
    g = 128 + 120 * (v / span)
    rows, cols = np.arange(height) * side // height, np.arange(width) * side // width
    return np.stack([x[rows][:, cols] for x in (g, g.T, g[::-1])], -1).round().clip(0, 255).astype(np.uint8)


def written_as(i: int) -> dict:
    """Size, chroma sampling, scan script, restart interval and run writing of the ith picture: they go round."""
    return {"height": 9 + i * 7 % 32, "width": 9 + i * 11 % 32, "chroma": 1 + i % 2, "scans": (SCANS, SPECTRAL)[i // 2 % 2], "restart": (0, 0, 3)[i % 3], "runs": i % 5 > 0}


def pictures(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each vector as a progressive JPEG: image_id, jpeg. A null or empty vector has a null image.

    Pictures are of 9 to 40 pixels either way, odd sizes included, with and without chroma subsampling, successive
    approximation, restart intervals and end-of-band runs over several blocks, as the vector's hash says.
    """
    kind = vectors.select(c(key)).schema[0].dataType.simpleString()

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                data = []
                for v in batch.column(1).slice(a, 256).to_pylist():
                    if v:
                        how = written_as(zlib.crc32(np.array(v, float).tobytes()))
                        data.append(encode(picture(np.array(v, float), how.pop("height"), how.pop("width")), **how))
                    else:
                        data.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array(data, pa.binary())], ["image_id", "jpeg"])

    return arrow_map(vectors.select(c(key).alias("image_id"), c(vector)), job, f"image_id {kind}, jpeg binary")
