"""Progressive JPEG: coefficients to bytes and back, many images at a time in numpy.

The decoder takes any 8-bit progressive Huffman stream: it accumulates the
scans of spectral selection and successive approximation into one array of
coefficients, then turns blocks into samples, repeats subsampled components to
full size and converts to RGB. Entropy-coded data can only be read in order,
but restart intervals, scans of different images and images are independent: the segments of all images
that share a scan's parameters and tables advance together, a symbol of each at a step.

The encoder writes 4:2:0 images in eight scans: DC of all components without
the last bit, AC of each component without it, and the same again for that bit.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Blocks between restarts of an AC scan, MCUs between those of a DC scan.
AC_RESTART, DC_RESTART = 8, 16


# ---- Huffman tables


def canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """DHT body, and code and length of each symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, sizes, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], sizes[s] = code, last
        code += 1
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    return counts + bytes(order), codes, sizes


@lru_cache(64)
def lookup(body: bytes) -> np.ndarray:
    """For each 16 bits: length << 8 | symbol of the code that they begin with; length 0 if none."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


DC_BODY, DC_CODE, DC_SIZE = canonical({s: 4 for s in range(12)})
#: Short codes for the sizes that bytes of text have, long ones for the rest.
_AC = {r << 4 | s: 11 for r in range(16) for s in range(1, 11)} | {r << 4: 12 for r in range(1, 16)}
_AC |= {0x04: 1, 0x03: 3, 0x06: 3, 0x05: 5, 0x02: 6, 0x01: 6, 0x07: 6, 0x00: 5}
AC_BODY, AC_CODE, AC_SIZE = canonical({s: n for s, n in _AC.items() if not (s >> 4 and s & 15 > 8)})
#: In refining scans.
REFINE_BODY, REFINE_CODE, REFINE_SIZE = canonical({0x00: 1} | {r << 4 | 1: 5 for r in range(12)} | {s: 8 for s in [0xC1, 0xD1, 0xE1, 0xF1, 0xF0]})


# ---- writing


def packed(code: np.ndarray, size: np.ndarray, segment: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of at most 32 bits, in order, as bytes; every segment begins on a byte and is filled up with ones. Returns bytes and bounds."""
    total = np.bincount(segment, weights=size, minlength=segments).astype(np.int64)
    n_bytes = (total + 7) // 8
    bounds = np.r_[0, np.cumsum(n_bytes)]
    off = np.cumsum(size) - size
    shift = bounds[:-1] * 8 - (np.cumsum(total) - total)
    off = off + shift[segment]
    word, bit = off >> 5, off & 31
    value = code.astype(np.uint64) << (64 - size - bit).astype(np.uint64)
    n = int(bounds[-1]) // 4 + 3
    words = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n) + np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    out = words.astype(np.uint64).astype(">u4").view(np.uint8)[: bounds[-1]].copy()
    _fill(out, bounds, total)
    return out, bounds


def _fill(out: np.ndarray, bounds: np.ndarray, total: np.ndarray) -> None:
    some = total % 8 > 0
    out[bounds[1:][some] - 1] |= ((1 << (8 - total[some] % 8)) - 1).astype(np.uint8)


def stuffed(data: np.ndarray, bounds: np.ndarray, nth: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """A zero after each 255; segments joined by restart markers; cut into scans. nth: of each segment in its scan; ends: of scans in segments."""
    full = np.flatnonzero(data == 255)
    grown = len(data) + len(full)
    extra = np.zeros(len(data) + 1, np.int64)
    extra[full + 1] = 1
    begins = np.flatnonzero(nth > 0)  # segments that a marker precedes
    np.add.at(extra, bounds[begins], 2)
    before = np.cumsum(extra)
    target = np.arange(len(data)) + before[:-1] if len(data) else np.empty(0, np.int64)
    out = np.zeros(grown + 2 * len(begins), np.uint8)
    out[target] = data
    # a segment is never empty, so a marker stands right before its segment's first byte
    at = bounds[begins] + before[bounds[begins]]
    out[at - 2], out[at - 1] = 255, 0xD0 + (nth[begins] - 1) % 8
    cuts = bounds[ends]
    place = np.where(cuts < len(data), cuts + before[np.minimum(cuts, len(data))] if len(data) else cuts, len(out))
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip([0, *place[:-1].tolist()], place.tolist())]


def _segments(per_image: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For units of many images in a row: segment of each unit, place of each segment in its scan, end of each scan in segments, first unit of each segment."""
    n = (per_image + every - 1) // every
    ends = np.cumsum(n)
    nth = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
    first_unit = np.repeat(np.cumsum(per_image) - per_image, n) + nth * every
    unit = np.arange(int(per_image.sum()))
    return np.searchsorted(first_unit, unit, "right") - 1, nth, ends, first_unit


#: Bits of each number that coefficients and their differences have.
_BITS = np.frexp(np.arange(1 << 12, dtype=np.float32))[1].astype(np.int64)


def ac_first(c: np.ndarray, low: int, per_image: np.ndarray) -> list[bytes]:
    """The AC scan of a component, without the lowest bits. c: blocks x 64 in zigzag order, of all images."""
    seg, nth, ends, _ = _segments(per_image, AC_RESTART)
    ac = c[:, 1:]
    a = np.abs(ac) >> low
    per_row = np.count_nonzero(a, axis=1)
    flat, row = np.flatnonzero(a), np.repeat(np.arange(len(c)), per_row)
    col = flat - 63 * row
    a, negative = a.ravel()[flat].astype(np.int64), ac[row, col] < 0
    ends_at = np.cumsum(per_row)
    run = np.diff(col, prepend=-1) - 1
    some = per_row > 0
    begins = (ends_at - per_row)[some]
    run[begins] = col[begins]
    size = _BITS[a]
    zrl = run >> 4
    symbol = (run & 15) << 4 | size
    code = AC_CODE[symbol] << size | np.where(negative, (1 << size) - 1 - a, a)
    length = AC_SIZE[symbol] + size
    eob = np.ones(len(c), np.int64)
    eob[some] = col[ends_at[some] - 1] < 62
    zc = np.r_[0, np.cumsum(zrl)]
    all_rows = per_row + eob + zc[ends_at] - zc[ends_at - per_row]
    base = np.cumsum(all_rows)
    n = int(all_rows.sum())
    codes, sizes = np.full(n, AC_CODE[0xF0]), np.full(n, AC_SIZE[0xF0])  # what nothing else takes is a run of 16 zeros
    at = np.arange(len(row)) + zc[1:] + (np.cumsum(eob) - eob)[row]
    codes[at], sizes[at] = code, length
    at = (base - 1)[eob == 1]
    codes[at], sizes[at] = AC_CODE[0], AC_SIZE[0]
    data, bounds = packed(codes, sizes, np.repeat(seg, all_rows), len(nth))
    return stuffed(data, bounds, nth, ends)


def ac_refine(c: np.ndarray, low: int, per_image: np.ndarray) -> list[bytes]:
    """The scan that adds bit `low` of a component's AC coefficients."""
    seg, nth, ends, _ = _segments(per_image, AC_RESTART)
    a = np.abs(c[:, 1:].astype(np.int32)) >> low
    known, new = a > 1, a == 1
    odd = new.any(1)
    eob = REFINE_SIZE[0]
    mask = np.concatenate([np.ones((len(c), eob), bool), known], 1)
    bits = np.concatenate([np.broadcast_to(((REFINE_CODE[0] >> np.arange(eob)[::-1]) & 1).astype(np.uint8), (len(c), eob)), (a & 1).astype(np.uint8)], 1)
    mask[odd] = False
    length = mask.sum(1)
    own: dict[int, list[int]] = {int(b): _refined_block(a[b], c[b, 1:] < 0) for b in np.flatnonzero(odd)}
    for b, x in own.items():
        length[b] = len(x)
    total = np.bincount(seg, weights=length, minlength=len(nth)).astype(np.int64)
    bounds = np.r_[0, np.cumsum((total + 7) // 8)]
    start = np.cumsum(length) - length + (bounds[:-1] * 8 - (np.cumsum(total) - total))[seg]
    out = np.zeros(int(bounds[-1]) * 8, np.uint8)
    taken = np.where(odd, 0, length)
    where = np.repeat(start - (np.cumsum(taken) - taken), taken) + np.arange(int(taken.sum()))
    out[where] = bits[mask]
    for b, x in own.items():
        out[start[b] : start[b] + len(x)] = x
    data = np.packbits(out)
    _fill(data, bounds, total)
    return stuffed(data, bounds, nth, ends)


def _refined_block(a: np.ndarray, negative: np.ndarray) -> list[int]:
    """Bits of a block in which coefficients become other than zero."""
    put = lambda code, n: [(code >> k) & 1 for k in range(n - 1, -1, -1)]
    out, held, run = [], [], 0
    last = int(np.flatnonzero(a == 1)[-1])
    for k, x in enumerate(a.tolist()):
        if k > last:
            break
        if x > 1:
            held.append(x & 1)
            continue
        if x == 0:
            run += 1
            if run == 16:
                # zeros up to here are skipped only if a new coefficient still follows
                out += put(int(REFINE_CODE[0xF0]), int(REFINE_SIZE[0xF0])) + held
                held, run = [], 0
            continue
        out += put(int(REFINE_CODE[run << 4 | 1]), int(REFINE_SIZE[run << 4 | 1])) + [0 if negative[k] else 1] + held
        held, run = [], 0
    rest = [int(x) & 1 for x in a[last + 1 :].tolist() if x > 1]
    if last < 62:
        out += put(int(REFINE_CODE[0]), int(REFINE_SIZE[0])) + rest
    return out


def dc_scans(dc: np.ndarray, mcus: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """First and refining DC scans. dc: MCUs x 6 (four Y, Cb, Cr), of all images."""
    seg, nth, ends, first = _segments(mcus, DC_RESTART)
    high = (dc >> 1).astype(np.int64)
    fresh = np.zeros(len(dc), bool)
    fresh[first] = True
    before = np.concatenate([np.zeros((1, 6), np.int64), high[:-1]])[:, [3, 0, 1, 2, 4, 5]]
    before[:, 1:4] = high[:, 0:3]
    before[np.ix_(fresh, [0, 4, 5])] = 0
    diff = (high - before).ravel()
    a = np.abs(diff)
    size = _BITS[a]
    code = DC_CODE[size] << size | np.where(diff < 0, (1 << size) - 1 - a, a)
    one = stuffed(*packed(code, DC_SIZE[size] + size, np.repeat(seg, 6), len(nth)), nth, ends)
    two = stuffed(*packed((dc & 1).ravel().astype(np.int64), np.ones(dc.size, np.int64), np.repeat(seg, 6), len(nth)), nth, ends)
    return one, two


def marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, code, len(body) + 2) + body


def _sos(parts: list[tuple[int, int]], ss: int, se: int, ah: int, al: int) -> bytes:
    return marker(0xDA, bytes([len(parts)]) + b"".join(bytes(p) for p in parts) + bytes([ss, se, ah << 4 | al]))


@lru_cache(4096)
def grid(blocks: int) -> tuple[int, int]:
    """MCUs across and down of an image that holds so many blocks."""
    n = max(1, -(-blocks // 6))
    across = min(4095, max(1, int(np.ceil(np.sqrt(n)))))
    return across, -(-n // across)


@lru_cache(4096)
def mcu_order(across: int, down: int) -> np.ndarray:
    """Places of each MCU's four Y blocks in the raster of Y blocks."""
    y, x = np.divmod(np.arange(across * down), across)
    return np.stack([(2 * y + j) * 2 * across + 2 * x + i for j in (0, 1) for i in (0, 1)], 1)


_HEAD = b"\xff\xd8" + marker(0xDB, b"\0" + b"\1" * 64)
_TABLES = marker(0xC4, b"\x00" + DC_BODY) + marker(0xC4, b"\x10" + AC_BODY) + marker(0xC4, b"\x11" + REFINE_BODY)


def encode(payloads: list[bytes]) -> list[bytes]:
    """An image for each payload, a multiple of 64 bytes: byte - 128 is a coefficient, block after block of Y, Cb, Cr. A comment keeps the length."""
    grids = [grid(len(p) // 64) for p in payloads]
    mcus = np.array([a * d for a, d in grids])
    planes: list[list[np.ndarray]] = [[], [], []]
    dcs = []
    for p, (across, down) in zip(payloads, grids):
        m = across * down
        c = np.zeros((6 * m, 64), np.int16)
        c.reshape(-1)[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) - 128
        for k, part in enumerate((c[: 4 * m], c[4 * m : 5 * m], c[5 * m :])):
            planes[k].append(part)
        dcs.append(np.concatenate([c[: 4 * m, 0][mcu_order(across, down)], c[4 * m : 5 * m, :1], c[5 * m :, :1]], 1))
    dc_one, dc_two = dc_scans(np.concatenate(dcs), mcus)
    joined, per, n = np.concatenate([x for plane in planes for x in plane]), np.concatenate([4 * mcus, mcus, mcus]), len(payloads)
    first, second = ([scans[i * n : (i + 1) * n] for i in range(3)] for scans in (ac_first(joined, 1, per), ac_refine(joined, 0, per)))
    dri = lambda n: marker(0xDD, struct.pack(">H", n))
    ids = (1, 2, 3)
    dc_all = [(i, 0x00) for i in ids]
    out = []
    for j, (p, (across, down)) in enumerate(zip(payloads, grids)):
        frame = marker(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        parts = [_HEAD, marker(0xFE, b"%d" % len(p)), frame, _TABLES, dri(DC_RESTART), _sos(dc_all, 0, 0, 0, 1), dc_one[j], dri(AC_RESTART)]
        for i in range(3):
            parts += [_sos([(ids[i], 0x00)], 1, 63, 0, 1), first[i][j]]
        parts += [dri(DC_RESTART), _sos(dc_all, 0, 0, 1, 0), dc_two[j], dri(AC_RESTART)]
        for i in range(3):
            parts += [_sos([(ids[i], 0x01)], 1, 63, 1, 0), second[i][j]]
        out.append(b"".join(parts) + b"\xff\xd9")
    return out


# ---- reading


@dataclass
class Image:
    height: int = 0
    width: int = 0
    comment: bytes = b""
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)  # components, tables, ss, se, ah, al, restart, begin, end
    bases: list[int] = field(default_factory=list)  # first block of each component among all blocks of the batch

    def mcus(self) -> tuple[int, int]:
        return _geometry(self.height, self.width, tuple(self.components))[1]


@lru_cache(4096)
def _geometry(height: int, width: int, components: tuple) -> tuple[tuple, tuple[int, int], tuple]:
    """Of each component the blocks across and down that a scan of it alone has and the blocks across that are stored; MCUs across and down; factors of each component."""
    hmax, vmax = max(x[1] for x in components), max(x[2] for x in components)
    sizes = tuple((-(-width * h // (8 * hmax)), -(-height * v // (8 * vmax)), -(-width // (8 * hmax)) * h) for _, h, v, _ in components)
    return sizes, (-(-width // (8 * hmax)), -(-height // (8 * vmax))), tuple(x[1:3] for x in components)


def parse(data: bytes, ends: list[int]) -> Image:
    """Segments of one stream. ends: places of the markers other than restarts, and of the like inside headers, ascending."""
    img, at, tables, restart, e = Image(), 2, {}, 0, 0
    while True:
        code = data[at + 1]
        if code == 0xD9:
            return img
        size = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif code == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 129 if wide else 65
                img.quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[n:]
        elif code == 0xC2:
            if body[0] != 8:
                raise ValueError("only 8-bit samples are read")
            img.height, img.width = struct.unpack(">HH", body[1:5])
            img.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only progressive Huffman streams are read")
        elif code == 0xDD:
            restart = body[0] << 8 | body[1]
        elif code == 0xFE:
            img.comment = body
        elif code == 0xDA:
            n = body[0]
            comps = tuple([x[0] for x in img.components].index(body[1 + 2 * k]) for k in range(n))
            ss, se, ahl = body[1 + 2 * n : 4 + 2 * n]
            used = tuple(tables.get((body[2 + 2 * k] >> 4) if ss == 0 else 0x10 | body[2 + 2 * k] & 15) for k in range(n))
            while ends[e] < at:
                e += 1
            img.scans.append((comps, used, ss, se, ahl >> 4, ahl & 15, restart, at, ends[e]))
            at = ends[e]


def _blocks(img: Image, comps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Place of each block of a scan in its order, its component's place in the scan, and blocks an MCU."""
    sizes, mcus, factors = _geometry(img.height, img.width, tuple(img.components))
    rel, which, per = _order(sizes, factors, comps, mcus)
    if len(comps) == 1:
        return rel + img.bases[comps[0]], which, per
    return rel + np.array([img.bases[c] for c in comps])[which], which, per


def _turns(scans: list[tuple]) -> list[list[int]]:
    """Scans in order, those that follow each other with equal parameters and other components together: none of them reads what another writes."""
    out: list[list[int]] = []
    for n, (comps, *alike, _, _, _) in enumerate(scans):
        if out and list(scans[out[-1][0]][1:6]) == alike and not any(set(comps) & set(scans[k][0]) for k in out[-1]):
            out[-1].append(n)
        else:
            out.append([n])
    return out


@lru_cache(512)
def _order(sizes: tuple, factors: tuple, comps: tuple[int, ...], mcus: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    if len(comps) == 1:
        w, h, stride = sizes[comps[0]]
        rel = (np.arange(h)[:, None] * stride + np.arange(w)).ravel()
        return rel, np.zeros(len(rel), np.int64), 1
    y, x = np.divmod(np.arange(mcus[0] * mcus[1]), mcus[0])
    cols, which = [], []
    for k, c in enumerate(comps):
        h, v = factors[c]
        for j in range(v):
            for i in range(h):
                cols.append((y * v + j) * sizes[c][2] + x * h + i)
                which.append(k)
    return np.stack(cols, 1).ravel(), np.tile(which, len(y)), len(cols)


class Reader:
    """Clean bytes of many segments, and a window of 64 bits from any of them."""

    def __init__(self, parts: list[np.ndarray]):
        """parts: the entropy-coded bytes of scans. bounds: where each segment begins; scan: of each segment."""
        raw = np.concatenate([*parts, np.zeros(1, np.uint8)])
        bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
        after = np.r_[False, raw[:-1] == 255]
        zero = after & (raw == 0)
        zero[bounds[:-1]] = False
        restart = after & (raw >= 0xD0) & (raw <= 0xD7)
        restart[bounds[:-1]] = False
        drop = zero | restart
        drop[:-1] |= restart[1:]
        drop[-1] = True
        where = np.cumsum(~drop) - ~drop
        begin = np.sort(np.r_[bounds[:-1], np.flatnonzero(restart) + 1])
        self.scan = np.searchsorted(bounds[:-1], begin, "right") - 1
        self.begin = where[begin]
        self.clean = np.concatenate([raw[~drop], np.zeros(16, np.uint8)])
        self.window = np.ndarray(len(self.clean) - 8, ">u8", self.clean.data, 0, (1,))

    def at(self, pos: np.ndarray) -> np.ndarray:
        return self.window[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)


def _value(x: np.ndarray, used: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits after the first `used` of a window."""
    return ((x << used.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


_S = np.arange(256) & 15
_R = np.arange(256) >> 4
_EOB = (_S == 0) & (_R < 15)
_EXTRA = np.where(_S > 0, _S, np.where(_EOB, _R, 0))
_SKIP = np.where(_S > 0, _R, 0)
_HALF = np.where(np.arange(17) > 0, 1 << np.maximum(np.arange(17) - 1, 0), 0)
_FULL = (1 << np.arange(17)) - 1


def _ac_first(coefs: np.ndarray, rd: Reader, lut: np.ndarray, addr: np.ndarray, blk: np.ndarray, end: np.ndarray, ss: int, se: int, al: int) -> None:
    pos, k = rd.begin * 8, np.full(len(blk), ss)
    while len(pos):
        x = rd.at(pos)
        e = lut[x >> np.uint64(48)]
        used, rs = e >> 8, e & 255
        n = _EXTRA[rs]
        v = _value(x, used, n)
        pos = pos + used + n
        s, eob = _S[rs], _EOB[rs]
        k = k + _SKIP[rs]
        hit = np.flatnonzero(s)
        sh, vh = s[hit], v[hit]
        coefs[addr[blk[hit]] * 64 + k[hit]] = np.where(vh < _HALF[sh], vh - _FULL[sh], vh) << al
        k = k + np.where(s > 0, 1, 16)
        fin = eob | (k > se)
        blk = blk + np.where(eob, (1 << _R[rs]) + v, fin)
        k = np.where(fin, ss, k)
        live = blk < end
        if not live.all():
            pos, k, blk, end = pos[live], k[live], blk[live], end[live]


def _ac_refine(coefs: np.ndarray, rd: Reader, lut: np.ndarray, addr: np.ndarray, blk: np.ndarray, end: np.ndarray, ss: int, se: int, al: int) -> None:
    bits = np.unpackbits(rd.clean)
    pos, k, run = rd.begin * 8, np.full(len(blk), ss), np.zeros(len(blk), np.int64)
    blocks, span = coefs.reshape(-1, 64), np.arange(ss, se + 1)
    while len(pos):
        sign = np.zeros(len(pos), np.int64)
        zeros = np.full(len(pos), 64)  # zero coefficients to pass before the place; 64: all that are left
        rs = np.zeros(len(pos), np.int64)
        ask = np.flatnonzero(run == 0)
        if len(ask):
            x = rd.at(pos[ask])
            e = lut[x >> np.uint64(48)]
            used, rs_a = e >> 8, e & 255
            eob = _EOB[rs_a]
            n = np.where(eob, _R[rs_a], _S[rs_a])
            v = _value(x, used, n)
            pos[ask] += used + n
            run[ask] = np.where(eob, (1 << _R[rs_a]) + v, 0)
            rs[ask], sign[ask] = rs_a, v
            zeros[ask] = np.where(eob, 64, _R[rs_a])
        own = blocks[addr[blk], ss : se + 1]
        ahead = span >= k[:, None]
        none = (own == 0) & ahead
        if (zeros < 64).any():
            nth = np.cumsum(none, 1)
            place = np.where(zeros < 64, np.argmax(nth == zeros[:, None] + 1, 1), se - ss + 1)
            fix = (own != 0) & ahead & (np.arange(se - ss + 1) < place[:, None])
        else:
            place = np.full(len(pos), se - ss + 1)
            fix = (own != 0) & ahead
        count = fix.sum(1)
        r, c = np.nonzero(fix)
        at = pos[r] + np.arange(len(r)) - (np.cumsum(count) - count)[r]
        old = own[r, c]
        own[r, c] = old + np.where(bits[at] == 1, np.where(old > 0, 1 << al, -(1 << al)), 0).astype(own.dtype)
        pos = pos + count
        put = np.flatnonzero((zeros < 64) & (_S[rs] == 1))
        own[put, place[put]] = np.where(sign[put] == 1, 1 << al, -(1 << al))
        blocks[addr[blk], ss : se + 1] = own
        k = place + ss + 1
        fin = (k > se) | (run > 0)
        run = np.maximum(run - 1, 0)
        blk = blk + fin
        k = np.where(fin, ss, k)
        live = blk < end
        if not live.all():
            pos, k, blk, end, run = pos[live], k[live], blk[live], end[live], run[live]


def _dc(coefs: np.ndarray, rd: Reader, luts: list[np.ndarray], addr: np.ndarray, which: np.ndarray, blk: np.ndarray, end: np.ndarray, ah: int, al: int) -> None:
    pos = rd.begin * 8
    if ah:
        bits = np.unpackbits(rd.clean)
        n = end - blk
        unit = np.repeat(blk - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        coefs[addr[unit] * 64] |= (bits[np.repeat(pos - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(np.int64) << al).astype(coefs.dtype)
        return
    table, pred = np.stack(luts), np.zeros((len(blk), len(luts)), np.int64)
    while len(pos):
        x = rd.at(pos)
        w = which[blk]
        e = table[w, x >> np.uint64(48)]
        used, s = e >> 8, e & 255
        v = _value(x, used, s)
        pos = pos + used + s
        row = np.arange(len(pos))
        pred[row, w] += np.where(v < _HALF[s], v - _FULL[s], v)
        coefs[addr[blk] * 64] = pred[row, w] << al
        blk = blk + 1
        live = blk < end
        if not live.all():
            pos, blk, end, pred = pos[live], blk[live], end[live], pred[live]


def decode(streams: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Images and the blocks x 64 coefficients (zigzag order) of all; an image's components begin at its bases."""
    whole = np.frombuffer(b"".join(streams) + b"\0", np.uint8)
    nxt = whole[1:]
    marks = np.flatnonzero((whole[:-1] == 255) & (nxt != 0) & (nxt != 255) & ((nxt < 0xD0) | (nxt > 0xD7)))
    starts = np.r_[0, np.cumsum([len(s) for s in streams])]
    cuts = np.searchsorted(marks, starts)
    images, blocks = [], 0
    for j, data in enumerate(streams):
        img = parse(data, (marks[cuts[j] : cuts[j + 1]] - starts[j]).tolist())
        mx, my = img.mcus()
        for _, h, v, _ in img.components:
            img.bases.append(blocks)
            blocks += mx * h * my * v
        images.append(img)
    coefs = np.zeros(blocks * 64, np.int32)
    turns = [_turns(i.scans) for i in images]
    for nth in range(max(map(len, turns), default=0)):
        groups = defaultdict(list)
        for j, img in enumerate(images):
            for n in turns[j][nth] if nth < len(turns[j]) else []:
                groups[img.scans[n][1:6]].append((j, n))
        for (used, ss, se, ah, al), own in groups.items():
            parts, addr, which, firsts, seg_of, at = [], [], [], [], [], 0
            for j, n in own:
                comps, *_, restart, a, b = images[j].scans[n]
                parts.append(whole[starts[j] + a : starts[j] + b])
                order, w, per = _blocks(images[j], comps)
                addr.append(order)
                which.append(w)
                step = restart * per or len(order)
                f = np.arange(at, at + len(order), step)
                firsts.append(f)
                seg_of.append(np.minimum(f + step, at + len(order)))
                at += len(order)
            rd, blk, end = Reader(parts), np.concatenate(firsts), np.concatenate(seg_of)
            if len(rd.begin) != len(blk):
                raise ValueError("restart markers don't fit the restart interval")
            addr_, which_ = np.concatenate(addr), np.concatenate(which)
            if ss == 0:
                _dc(coefs, rd, [lookup(u) for u in used] if not ah else [], addr_, which_, blk, end, ah, al)
            elif ah == 0:
                _ac_first(coefs, rd, lookup(used[0]), addr_, blk, end, ss, se, al)
            else:
                _ac_refine(coefs, rd, lookup(used[0]), addr_, blk, end, ss, se, al)
    return images, coefs.reshape(-1, 64)


def payload(img: Image, coefs: np.ndarray) -> bytes:
    """The bytes that encode() stored."""
    n = int(img.comment)
    return (coefs[img.bases[0] : img.bases[0] + -(-n // 64)].ravel()[:n] + 128).astype(np.uint8).tobytes()


def _zigzag() -> np.ndarray:
    """Place in an 8 x 8 block of each coefficient of the zigzag order."""
    cells = sorted(((x, y) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 else p[0]))
    return np.array([y * 8 + x for x, y in cells])


ZIGZAG = _zigzag()
_SCALE = 1 << 16


def _basis() -> np.ndarray:
    """Samples of each coefficient in zigzag order, times _SCALE, as whole numbers: sums are exact in any order."""
    x = np.arange(8)
    one = np.cos((2 * x[None] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.rint(np.einsum("vy,ux->vuyx", one, one).reshape(64, 64)[ZIGZAG] * _SCALE)


_BASIS = _basis()


def rgb(img: Image, coefs: np.ndarray) -> np.ndarray:
    """Height x width x 3 samples: inverse transform, repeated chroma, conversion; integers throughout."""
    return rgb_many([img], coefs)[0]


def rgb_many(images: list[Image], coefs: np.ndarray) -> list[np.ndarray]:
    samples = np.empty((len(coefs), 64), np.uint8)
    done = np.zeros(len(coefs), bool)
    for img in images:  # tables of ones need no product
        mx, my = img.mcus()
        for (_, h, v, q), base in zip(img.components, img.bases):
            if (img.quant[q] != 1).any():
                own = slice(base, base + mx * h * my * v)
                samples[own] = _samples(coefs[own] * img.quant[q])
                done[own] = True
    rest = np.flatnonzero(~done)
    for k in range(0, len(rest), 8192):
        samples[rest[k : k + 8192]] = _samples(coefs[rest[k : k + 8192]])
    out = []
    for img in images:
        mx, my = img.mcus()
        hmax, vmax = max(x[1] for x in img.components), max(x[2] for x in img.components)
        planes = []
        for (_, h, v, _), base in zip(img.components, img.bases):
            p = samples[base : base + mx * h * my * v].reshape(my * v, mx * h, 8, 8).swapaxes(1, 2).reshape(my * v * 8, mx * h * 8)
            if hmax != h:
                p = p.repeat(hmax // h, 1)
            if vmax != v:
                p = p.repeat(vmax // v, 0)
            planes.append(p[: img.height, : img.width].astype(np.int32))
        if len(planes) == 1:
            planes = [planes[0], np.full_like(planes[0], 128), np.full_like(planes[0], 128)]
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        half = 1 << 15
        res = np.empty((*y.shape, 3), np.uint8)
        res[..., 0] = np.clip(y + ((91881 * cr + half) >> 16), 0, 255)
        res[..., 1] = np.clip(y - ((22554 * cb + 46802 * cr + half) >> 16), 0, 255)
        res[..., 2] = np.clip(y + ((116130 * cb + half) >> 16), 0, 255)
        out.append(res)
    return out


def _samples(coefs: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((coefs.astype(np.float64) @ _BASIS + _SCALE / 2) / _SCALE) + 128, 0, 255).astype(np.uint8)
