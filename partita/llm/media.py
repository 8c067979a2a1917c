"""Progressive JPEG media columns.

A payload byte b becomes the quantised coefficient b (b >= 128) or b - 255 (b < 128): magnitudes 128 to 255, so every
coefficient has eight bits, and the format's ``extra bits`` of it are b itself. Coefficients are entropy coded only,
never rounded, so storing is lossless. Files are 4:2:0 (four Y, one Cb, one Cr block in an MCU) with eight kinds of
scan: DC and two AC bands of each component, first without the lowest bit (successive approximation), then refined.
A comment segment holds the payload's length; what the last MCU has beyond it is filled with bytes 255.

Reading accumulates the scans of any progressive Huffman file into coefficient arrays, inverse-transforms them in
numpy, upsamples chroma, and gives full-resolution RGB. Where a scan's Huffman table has one symbol, all its codes are
equally long and it is read as an array; other scans are read code by code.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import documents, slices

UNIT = 576
BANDS = ((1, 5), (6, 63))
MCU = 6 * 64
MAX_MCU_ROWS = 4095
#: Payloads whose arrays are prepared at once.
TOGETHER = 64
#: Rows whose files and tensors a task holds at once.
ROWS = 128
#: Codes of DC difference categories 0 to 9: a short one for those that nearly all have. Fixed values of this encoder.
DC_LENGTHS = {8: 1, 7: 2, 6: 3, 5: 4, 4: 5, 3: 6, 2: 7, 1: 8, 0: 9, 9: 10}


@lru_cache
def _zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of the k-th coefficient."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


@lru_cache
def _inverse() -> np.ndarray:
    """64 x 64: coefficients in zigzag order to samples in row order."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    both = np.einsum("yv,xu->yxvu", basis, basis).reshape(64, 64)
    return np.ascontiguousarray(both[:, _zigzag()].T.astype(np.float32))


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol to (code, length)."""
    out, code, before = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - before
        out[symbol], before = (code, n), n
        code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, at: int, lengths: dict[int, int]) -> bytes:
    ordered = sorted(lengths.items(), key=lambda x: x[1])
    counts = bytes(sum(n == k for _, n in ordered) for k in range(1, 17))
    return _segment(0xC4, bytes([kind << 4 | at]) + counts + bytes(s for s, _ in ordered))


def _scan(component: int, table: int, first: int, last: int, high: int, low: int, body: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, table, first, last, high << 4 | low])) + body.replace(b"\xff", b"\xff\x00")


def _bits_of(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bits of values of various lengths, one after the other."""
    total = int(lengths.sum())
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    shift = np.repeat(lengths, lengths) - 1 - (np.arange(total) - starts)
    return (np.repeat(values, lengths) >> shift & 1).astype(np.uint8)


def _padded(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


@lru_cache
def _dc_code_arrays() -> tuple[np.ndarray, np.ndarray]:
    codes = _codes(DC_LENGTHS)
    return np.array([codes[k][0] for k in range(10)]), np.array([codes[k][1] for k in range(10)])


def _grid(size: int) -> tuple[int, int]:
    """MCUs down and across for a payload of that many bytes: one column, as long as the format allows it."""
    n = max(1, -(-size // MCU))
    across = -(-n // MAX_MCU_ROWS)
    return -(-n // across), across


def encode_jpegs(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload, whose coefficients are the bytes of the payload."""
    grids = [_grid(len(p)) for p in payloads]
    ends = np.cumsum([0] + [d * a for d, a in grids])
    data = np.full((int(ends[-1]), 6, 64), 255, np.uint8)
    for p, at in zip(payloads, ends.tolist(), strict=False):
        data[at:].reshape(-1)[: len(p)] = np.frombuffer(p, np.uint8)
    high = data >> 1
    low = high >> 6 ^ 1 ^ data & 1  # lowest bit of the magnitude
    dc = data[:, :, 0].astype(np.int64)
    dc = np.where(dc < 128, dc - 255, dc)
    d = dc >> 1
    d[1:] -= dc[:-1] >> 1
    # In an interleaved scan the four Y blocks of an MCU follow one another; chroma follows the MCU before.
    y = np.diff((dc[:, :4] >> 1).ravel(), prepend=0).reshape(-1, 4)
    y[ends[:-1], 0] = dc[ends[:-1], 0] >> 1
    d[ends[:-1]] = dc[ends[:-1]] >> 1
    d[:, :4] = y
    size = np.frexp(np.abs(d).astype(np.float64))[1].astype(np.int64)
    codes, lengths = _dc_code_arrays()
    coded, widths = codes[size] << size | np.where(d < 0, d + (1 << size) - 1, d), lengths[size] + size
    bits = _bits_of(coded.ravel(), widths.ravel())
    bit_ends = np.concatenate([[0], np.cumsum(widths.sum(1))])[ends]
    dc_low = (dc & 1).astype(np.uint8).reshape(len(data), 6)
    return [
        _file(p, *g, high[a:b], low[a:b], bits[x:y], dc_low[a:b].ravel())
        for p, g, a, b, x, y in zip(payloads, grids, ends[:-1].tolist(), ends[1:].tolist(), bit_ends[:-1].tolist(), bit_ends[1:].tolist(), strict=True)
    ]


def encode_jpeg(payload: bytes) -> bytes:
    return encode_jpegs([payload])[0]


@lru_cache
def _head() -> bytes:
    return _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _table(0, 0, DC_LENGTHS) + _table(1, 0, {7: 1})


def _file(payload: bytes, down: int, across: int, high: np.ndarray, low: np.ndarray, dc: np.ndarray, dc_low: np.ndarray) -> bytes:
    frame = bytes([8]) + struct.pack(">HH", 16 * down, 16 * across) + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _head(), _segment(0xC2, frame)]
    every = bytes([3, 1, 0, 2, 0, 3, 0, 0, 0])
    parts = [(1, first, last) for first, last in BANDS] + [(2, 1, 63), (3, 1, 63)]
    blocks = [(_own_order(high, c, down, across), _own_order(low, c, down, across)) for c in range(3)]
    out.append(_segment(0xDA, every + b"\x01") + _padded(dc).replace(b"\xff", b"\xff\x00"))
    for c, first, last in parts:
        out.append(_scan(c, 0, first, last, 0, 1, blocks[c - 1][0][:, first : last + 1].tobytes()))
    out.append(_segment(0xDA, every + b"\x10") + _padded(dc_low).replace(b"\xff", b"\xff\x00"))
    for c, first, last in parts:
        out += _refined(c, len(blocks[c - 1][1]), first, last, blocks[c - 1][1][:, first : last + 1])
    return b"".join([*out, b"\xff\xd9"])


def _own_order(mcus: np.ndarray, c: int, down: int, across: int) -> np.ndarray:
    """A component's blocks row by row, from blocks MCU by MCU."""
    if c:
        return mcus[:, 3 + c]
    return mcus[:, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)


@lru_cache(4096)
def _run_head(n: int, run: int) -> tuple[bytes, tuple[int, ...]]:
    """Table for ended-block runs that cover n blocks, and the bits that open a run of that length."""
    classes = sorted({r.bit_length() - 1 for r in ((32767, n % 32767) if n > 32767 and n % 32767 else (min(n, 32767),))}, reverse=True)
    lengths = {r << 4: k + 1 for k, r in enumerate(classes)}
    r = run.bit_length() - 1
    code, size = _codes(lengths)[r << 4]
    return _table(1, 1, lengths), tuple(int(x) for x in f"{code << r | run - (1 << r):0{size + r}b}")


def _refined(c: int, n: int, first: int, last: int, bits: np.ndarray) -> list[bytes]:
    """A refining scan in which every coefficient has a history: runs of ended blocks, then correction bits."""
    parts, table = [], b""
    for at in range(0, n, 32767):
        run = min(n - at, 32767)
        table, opening = _run_head(n, run)
        parts += [np.array(opening, np.uint8), bits[at : at + run].ravel()]
    return [table, _scan(c, 1, first, last, 1, 0, _padded(np.concatenate(parts)))]


class _Bits:
    """Bits of a scan's data, read from the front."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek16(self) -> int:
        while self.n < 16:
            chunk = self.data[self.at : self.at + 4]
            self.held = self.held << 32 | int.from_bytes(chunk + b"\xff" * (4 - len(chunk)))
            self.at += 4
            self.n += 32
        return self.held >> self.n - 16 & 0xFFFF

    def skip(self, n: int) -> None:
        self.n -= n
        self.held &= (1 << self.n) - 1

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        v = self.peek16() >> 16 - n
        self.skip(n)
        return v

    def position(self) -> int:
        return self.at * 8 - self.n


def _lookup(lengths: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """By the next 16 bits: symbol and code length."""
    table = [(0, 0)] * 65536
    for symbol, (code, n) in _codes(dict(lengths)).items():
        table[code << 16 - n : (code + 1) << 16 - n] = [(symbol, n)] * (1 << 16 - n)
    return table


_lookups: dict[tuple, list] = {}


def _cached_lookup(lengths: tuple) -> list[tuple[int, int]]:
    if lengths not in _lookups:
        if len(_lookups) > 64:
            _lookups.clear()
        _lookups[lengths] = _lookup(list(lengths))
    return _lookups[lengths]


def _extend(v: int, n: int) -> int:
    return v if n == 0 or v >> n - 1 else v - (1 << n) + 1


def _read_dc(coefs: list[np.ndarray], order: list[np.ndarray], data: bytes, lengths: list[tuple], high: int, low: int) -> None:
    """A DC scan, of one component or interleaved: ``order`` has each component's blocks, MCU by MCU."""
    if high:
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        per = [o.shape[1] for o in order]
        mcus = len(order[0])
        taken = bits[: mcus * sum(per)].reshape(mcus, sum(per)).astype(np.int32)
        at = 0
        for c, o in zip(coefs, order, strict=True):
            c[o.ravel(), 0] |= taken[:, at : at + o.shape[1]].ravel() << low
            at += o.shape[1]
        return
    found: list[list[int]] = [[] for _ in order]
    tables, plan = [_cached_lookup(x) for x in lengths], [k for k, o in enumerate(order) for _ in range(o.shape[1])]
    last = [0] * len(order)
    held = n = at = 0
    for _ in range(len(order[0])):
        for k in plan:
            while n < 32:
                chunk = data[at : at + 8]
                held = held << 64 | int.from_bytes(chunk + b"\xff" * (8 - len(chunk)))
                at += 8
                n += 64
            size, used = tables[k][held >> n - 16 & 0xFFFF]
            n -= used + size
            v = held >> n & (1 << size) - 1
            held &= (1 << n) - 1
            last[k] += v if size == 0 or v >> size - 1 else v - (1 << size) + 1
            found[k].append(last[k])
    for c, o, f in zip(coefs, order, found, strict=True):
        c[o.ravel(), 0] = np.array(f, np.int32) << low


def _read_ac_first(coefs: np.ndarray, blocks: np.ndarray, data: bytes, lengths: tuple, first: int, last: int, low: int) -> None:
    width = last - first + 1
    if len(lengths) == 1 and 0 < lengths[0][0] < 16:  # one symbol with no zeros before it: all codes are equally long
        (size, code), n = lengths[0], len(blocks) * width
        stride = code + size
        if stride == 8:
            v = np.frombuffer(data, np.uint8)[:n].astype(np.int32) & (1 << size) - 1
        else:
            bits = np.unpackbits(np.frombuffer(data, np.uint8))[: n * stride].reshape(n, stride)[:, code:]
            v = bits @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        v = np.where(v >> size - 1 > 0, v, v - (1 << size) + 1) * (1 << low)
        coefs[blocks, first : last + 1] = v.reshape(-1, width)
        return
    table, bits, run = _cached_lookup(lengths), _Bits(data), 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol, n = table[bits.peek16()]
            bits.skip(n)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                coefs[b, k] = _extend(bits.take(size), size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _read_ac_refine(coefs: np.ndarray, blocks: np.ndarray, data: bytes, lengths: tuple, first: int, last: int, low: int) -> None:
    table, bits, run = _cached_lookup(lengths), _Bits(data), 0
    flat = np.unpackbits(np.frombuffer(data, np.uint8))
    step, i = 1 << low, 0
    while i < len(blocks):
        if run >= len(blocks) - i and i == 0 and (run == len(blocks)) and coefs[blocks, first : last + 1].all():
            # Every coefficient has a history: what is left of the scan is one correction bit for each.
            at, part = bits.position(), coefs[blocks, first : last + 1]
            change = flat[at : at + part.size].reshape(part.shape) * np.int32(step)
            coefs[blocks, first : last + 1] = np.where(part > 0, part + change, part - change)
            return
        if run:  # blocks that add no coefficient: a correction bit for each that is not zero
            some = blocks[i : i + run]
            part = coefs[some, first : last + 1]
            old = part != 0
            at, n = bits.position(), int(old.sum())
            part[old] += np.where(part[old] > 0, step, -step) * flat[at : at + n]
            coefs[some, first : last + 1] = part
            bits = _Bits(data)
            bits.at, bits.held, bits.n = (at + n) // 8, 0, 0
            bits.take((at + n) % 8)
            i, run = i + len(some), 0
            continue
        row, k = coefs[blocks[i]], first
        while k <= last:
            symbol, n = table[bits.peek16()]
            bits.skip(n)
            zeros, size = symbol >> 4, symbol & 15
            if size == 0 and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            new = (step if bits.take(1) else -step) if size else 0
            while k <= last:
                if row[k]:
                    if bits.take(1):
                        row[k] += step if row[k] > 0 else -step
                elif zeros == 0:
                    row[k] = new
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        if run:
            if k > first:  # the rest of this block has correction bits only
                for j in range(k, last + 1):
                    if row[j] and bits.take(1):
                        row[j] += step if row[j] > 0 else -step
                run -= 1
                i += 1
        else:
            i += 1


class Image:
    """A decoded file: size, components with their coefficient arrays, quantisation and comments."""

    def __init__(self, data: bytes):
        self.comments: list[bytes] = []
        self.quantisers: dict[int, np.ndarray] = {}
        tables: dict[int, tuple] = {}
        at = 2
        while at + 4 <= len(data):
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    self.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    counts = body[1:17]
                    n, symbols, lengths = sum(counts), 17, []
                    for k, c in enumerate(counts, 1):
                        lengths += [(s, k) for s in body[symbols : symbols + c]]
                        symbols += c
                    tables[body[0]] = tuple(lengths)
                    body = body[17 + n :]
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, 0xC9, 0xCA):
                raise ValueError("only progressive Huffman files are read")
            elif marker == 0xDD and body != b"\0\0":
                raise ValueError("restart intervals are not read")
            elif marker == 0xDA:
                end = at
                while True:  # the next marker that is no stuffed byte
                    end = data.find(b"\xff", end)
                    if end < 0 or data[end + 1] != 0:
                        break
                    end += 2
                end = len(data) if end < 0 else end
                self._scan(body, data[at:end].replace(b"\xff\x00", b"\xff"), tables)
                at = end
            if data[at : at + 2] == b"\xff\xd9":
                break

    def _frame(self, body: bytes) -> None:
        self.height, self.width = struct.unpack(">HH", body[1:5])
        specs = [body[6 + 3 * k : 9 + 3 * k] for k in range(body[5])]
        self.h, self.v = [s[1] >> 4 for s in specs], [s[1] & 15 for s in specs]
        self.ids, self.q = [s[0] for s in specs], [s[2] for s in specs]
        mh, mv = max(self.h), max(self.v)
        self.mcus = (-(-self.height // (8 * mv)), -(-self.width // (8 * mh)))
        self.grid = [(self.mcus[0] * v, self.mcus[1] * h) for h, v in zip(self.h, self.v, strict=True)]
        self.own = [(-(-(-(-self.height * v // mv)) // 8), -(-(-(-self.width * h // mh)) // 8)) for h, v in zip(self.h, self.v, strict=True)]
        self.coefs = [np.zeros((a * b, 64), np.int32) for a, b in self.grid]

    def _blocks(self, c: int) -> np.ndarray:
        """A component's blocks in its own order, without what only fills MCUs."""
        if self.own[c] == self.grid[c]:
            return np.arange(len(self.coefs[c]))
        return np.arange(self.grid[c][0] * self.grid[c][1]).reshape(self.grid[c])[: self.own[c][0], : self.own[c][1]].ravel()

    def _interleaved(self, c: int) -> np.ndarray:
        every = np.arange(self.grid[c][0] * self.grid[c][1]).reshape(self.mcus[0], self.v[c], self.mcus[1], self.h[c])
        return every.transpose(0, 2, 1, 3).reshape(self.mcus[0] * self.mcus[1], -1)

    def _scan(self, body: bytes, data: bytes, tables: dict[int, tuple]) -> None:
        n = body[0]
        which = [self.ids.index(body[1 + 2 * k]) for k in range(n)]
        at = [body[2 + 2 * k] for k in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if first == 0:
            order = [self._interleaved(c) for c in which] if n > 1 else [self._blocks(which[0])[:, None]]
            _read_dc([self.coefs[c] for c in which], order, data, [tables.get(t >> 4, ()) for t in at], high, low)
        else:
            read = _read_ac_refine if high else _read_ac_first
            read(self.coefs[which[0]], self._blocks(which[0]), data, tables[0x10 | at[0] & 15], first, last, low)

    def samples(self, c: int) -> np.ndarray:
        """A component's plane after the inverse transform."""
        rows, cols = self.grid[c]
        blocks = (self.coefs[c] * self.quantisers[self.q[c]]).astype(np.float32) @ _inverse() + 128
        return blocks.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)

    def rgb(self) -> np.ndarray:
        """Height x width x 3 bytes; chroma planes are repeated up to full resolution."""
        mh, mv = max(self.h), max(self.v)
        planes = [np.repeat(np.repeat(self.samples(c), mv // self.v[c], 0), mh // self.h[c], 1)[: self.height, : self.width] for c in range(len(self.ids))]
        if len(planes) == 1:
            planes *= 3
            rgb = np.stack(planes, -1)
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
        return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)

    def payload(self) -> bytes:
        """The bytes that ``encode_jpeg`` stored."""
        n = int(next(c for c in self.comments if c.startswith(b"payload="))[8:])
        down, across = self.mcus
        data = np.empty((down, across, 6, 64), np.uint8)
        y, cb, cr = [np.where(c < 0, c + 255, c).astype(np.uint8) for c in self.coefs]
        data[:, :, :4] = y.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
        data[:, :, 4], data[:, :, 5] = cb.reshape(down, across, 64), cr.reshape(down, across, 64)
        return data.reshape(-1)[:n].tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, mean colour, contrast, and a hash of which of 4 x 4 fields are lighter than their mean."""
    height, width, _ = rgb.shape
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    grey = rgb.sum(2, dtype=np.int32)
    squares = int((grey.astype(np.int64) ** 2).sum())
    rows = np.add.reduceat(grey, np.arange(4) * height // 4, axis=0)
    fields = np.add.reduceat(rows, np.arange(4) * width // 4, axis=1).astype(np.int64).ravel()
    bits = "".join("1" if 16 * f > fields.sum() else "0" for f in fields)
    n = height * width
    contrast = (squares / n - (int(grey.sum(dtype=np.int64)) / n) ** 2) / 9
    return f"{width}x{height} rgb={','.join(f'{s / n:.3f}' for s in sums)} var={contrast:.3f} fields={int(bits, 2):04x}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as UTF-8, padded with bytes 255 to a positive multiple of ``UNIT``.

    A null text counts as empty (n_bytes 0, one unit of padding); equal texts give equal media; rows stay one to one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            padded = [b + b"\xff" * ((-len(b) % UNIT) if b else UNIT) for b in raw]
            media = [m for k in range(0, len(raw), TOGETHER) for m in encode_jpegs(padded[k : k + TOGETHER])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _read(data: bytes | None, tensors: bool) -> tuple:
    """payload, feature, height, width and rgb of a file; nulls if it cannot be read."""
    try:
        image = Image(data)
        rgb = image.rgb()
        return image.payload(), feature(rgb), image.height, image.width, rgb.tobytes() if tensors else None
    except (TypeError, ValueError, IndexError, KeyError, AttributeError, StopIteration, struct.error):
        return (None,) * 5


def load(stored: DataFrame, *, tensors: bool = True) -> DataFrame:
    """The columns of ``stored`` with payload (binary), feature, height, width and, if ``tensors``, rgb (height x width x 3 bytes).

    Null media give nulls, and so do files that are broken or of another kind; columns of those names are replaced.
    """
    stored = stored.drop("payload", "feature", "height", "width", "rgb")
    extra = [("payload", "binary"), ("feature", "string"), ("height", "int"), ("width", "int"), *([("rgb", "binary")] if tensors else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            rows = [_read(data, tensors) for data in batch.column("media").to_pylist()]
            kinds = (pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.binary())
            more = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(extra))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *[n for n, _ in extra]])

    schema = ", ".join(f"`{c}` {t}" for c, t in stored.dtypes) + "".join(f", {n} {t}" for n, t in extra)
    return stored.mapInArrow(run, schema)


def digest(loaded: DataFrame) -> DataFrame:
    """The row hashes of media that were read back; with tensors also their height, width and hash."""
    payload = F.col("payload")
    tensor = ["height", "width", F.sha2("rgb", 256).alias("tensor_sha256")] if "rgb" in loaded.columns else []
    return loaded.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"), "feature", *tensor,
    )
