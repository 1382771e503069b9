"""Lossless WebP: reading and writing of pixel arrays.

``decode`` reads prefix codes (simple and normal, in groups), back-references and the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette transforms, as the
published format description has them. ``encode`` writes the same features. Pixels are uint32
arrays, 0xAARRGGBB.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections import Counter

import numpy as np

# Fixed values of the format: order of the code lengths of the code-length code, and the
# neighbourhood (dx, dy) of the first 120 distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
NEARBY = np.array(NEAR)
PREDICT, CROSS, GREEN, PALETTE = range(4)
LENGTHS, DISTANCES, MAX_BITS, SIDE = 24, 40, 15, 1 << 14
#: Bytes of the shortest back-reference that is looked for, and the greatest distance that has a symbol.
LEAST, FARTHEST = 5, (1 << 20) - len(NEAR)
CACHE_FACTOR, BLACK = 0x1E35A7BD, 0xFF000000


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(16), 0

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & (1 << n) - 1


class Writer:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def array(self) -> np.ndarray:
        """The bits so far, one to a byte."""
        raw = self.value.to_bytes(-(-self.n // 8) or 1, "little")
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.n]


# --- prefix codes


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the given lengths, bit-reversed as they lie in the stream."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths.tolist()) if n):
        code <<= n - last
        codes[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, last = code + 1, n
    return codes


class Code:
    """A prefix code: table of (symbol, length) for every value of the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.used = used
        if len(used) <= 1:  # no bits in the stream
            self.only, self.bits = int(used[0]) if len(used) else 0, 0
            return
        self.only, self.bits = None, int(lengths.max())
        self.symbol, self.length = np.zeros(1 << self.bits, np.uint16), np.zeros(1 << self.bits, np.uint8)
        for s, c, n in zip(used.tolist(), canonical(lengths)[used].tolist(), lengths[used].tolist(), strict=True):
            self.symbol[c :: 1 << n] = s
            self.length[c :: 1 << n] = n
        if not self.length.all():
            raise ValueError("incomplete prefix code")
        self.pairs: list | None = None

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.pairs is None:
            self.pairs = list(zip(self.symbol.tolist(), self.length.tolist(), strict=True))
        at = bits.at
        s, n = self.pairs[int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & (1 << self.bits) - 1]
        bits.at = at + n
        return s


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(max(alphabet, 256), np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    first = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        first[LENGTH_ORDER[i]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    code, s, last = Code(first), 0, 8
    while s < alphabet and left:
        left -= 1
        n = code.read(bits)
        if n < 16:
            lengths[s] = n
            s, last = s + 1, n or last
        else:
            times = 3 + bits.read(2) if n == 16 else 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
            lengths[s : s + times] = last if n == 16 else 0
            s += times
    return Code(lengths[:alphabet])


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of a prefix code of at most ``most`` bits."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts).tolist()
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    while True:
        heap = [(int(counts[s]), s) for s in used]
        heapq.heapify(heap)
        parent, new = {}, len(counts)
        while len(heap) > 1:
            a, x = heapq.heappop(heap)
            b, y = heap[0]
            parent[x] = parent[y] = new
            heapq.heapreplace(heap, (a + b, new))
            new += 1
        depth = {new - 1: 0}
        for node in range(new - 2, len(counts) - 1, -1):
            depth[node] = depth[parent[node]] + 1
        for s in used:
            out[s] = depth[parent[s]] + 1
        if out.max() <= most:
            return out
        counts = np.where(counts > 0, (counts + 1) // 2, 0)


def write_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and (not used or used[-1] < 256):  # a simple code
        w.put(1 | int(len(used) == 2) << 1 | 1 << 2, 3)
        for s in used or [0]:
            w.put(s, 8)
        return
    w.put(0, 1)
    top = used[-1] + 1
    first = code_lengths(np.bincount(lengths[:top], minlength=19)[:19], 7)
    if np.count_nonzero(first) == 1:  # a code of one length takes no bits for it
        first = np.where(first > 0, 1, 0)
    shown = max(4, max(i for i, s in enumerate(LENGTH_ORDER) if first[s]) + 1)
    w.put(shown - 4, 4)
    for i in range(shown):
        w.put(int(first[LENGTH_ORDER[i]]), 3)
    top = max(top, 2)
    w.put(1, 1)
    w.put(4, 3)
    w.put(top - 2, 10)
    if np.count_nonzero(first) > 1:
        codes = canonical(first)
        for n in lengths[:top].tolist():
            w.put(int(codes[n]), int(first[n]))


# --- entropy-coded pixels


def extra(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    n = symbol - 2 >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def of_value(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits and these bits of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    n = value.bit_length() - 2
    return 2 * n + 2 + (value >> n & 1), n, value & (1 << n) - 1


#: Extra bits and least value of each symbol of lengths and distances.
EXTRA = np.array([max(0, s - 2 >> 1) for s in range(DISTANCES)], np.int32)
BASE = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << (s - 2 >> 1)) + 1 for s in range(DISTANCES)], np.int64)


def symbols_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of lengths or distances, and what their extra bits hold."""
    symbol = np.searchsorted(BASE, value, "right") - 1
    return symbol, value - BASE[symbol]


@functools.cache
def near_codes(width: int) -> np.ndarray:
    """Symbol numbers of the distances that the neighbourhood has, and 0 for others."""
    code = np.zeros(8 * width + 10, np.int64)
    for i, (dx, dy) in reversed(list(enumerate(NEAR, 1))):
        if dx + dy * width > 0:
            code[dx + dy * width] = i
    return code


def find_copies(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance symbol number of runs of bytes that stood before: at each place where
    LEAST bytes are those of a place before, the last such, for as long as the same distance holds."""
    none = np.zeros(0, np.int64)
    if len(values) <= LEAST:
        return none, none, none
    n = len(values) - LEAST + 1
    key = np.zeros(n, np.uint64)
    for i in range(LEAST):
        key |= values[i : i + n].astype(np.uint64) << np.uint64(24 + 8 * i)
    key = np.sort(key | np.arange(n, dtype=np.uint64))
    place = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
    same = np.flatnonzero(key[1:] >> np.uint64(24) == key[:-1] >> np.uint64(24))
    back = np.zeros(n, np.int64)
    back[place[same + 1]] = place[same + 1] - place[same]
    back[back > FARTHEST] = 0
    ends = np.append(np.flatnonzero(back[1:] != back[:-1]), n - 1)
    at = np.flatnonzero(back)
    if not len(at):
        return none, none, none
    size = np.minimum(ends[np.searchsorted(ends, at)] - at + LEAST, 4096)
    follow, i, taken = np.searchsorted(at, at + size).tolist(), 0, []
    while i < len(at):
        taken.append(i)
        i = follow[i]
    at, size, back = at[taken], size[taken], back[at[taken]]
    code = near_codes(width)
    near = code[np.minimum(back, len(code) - 1)]
    return at, size, np.where(near > 0, near, back + len(NEAR))


def bits_of(counts: np.ndarray) -> float:
    """Bits that symbols of these counts take at least."""
    counts = counts[counts > 0]
    return float((counts * np.log2(counts.sum() / counts)).sum())


def write_green(w: Writer, pixels: np.ndarray, width: int) -> list[np.ndarray]:
    """write_pixels() of pixels that differ in green alone, with back-references where they take less."""
    green = (pixels >> 8 & 255).astype(np.uint8)
    size = 256 + LENGTHS
    plain = np.bincount(green, minlength=size)
    at, many, code = find_copies(green, width)
    which, rest = symbols_of(many)
    far, far_rest = symbols_of(code)
    covered = np.zeros(len(green) + 1, np.int32)
    covered[at] += 1
    np.subtract.at(covered, at + many, 1)
    covered = np.cumsum(covered[:-1])
    literal = covered == 0
    counts = np.bincount(green[literal], minlength=size) + np.bincount(256 + which, minlength=size)
    far_counts = np.bincount(far, minlength=DISTANCES)
    if bits_of(counts) + bits_of(far_counts) + int((EXTRA[which] + EXTRA[far]).sum()) + 4 * np.count_nonzero(far_counts) >= bits_of(plain):
        at, many, which, far, counts, far_counts = at[:0], many[:0], which[:0], far[:0], plain, np.zeros(DISTANCES, np.int64)
        rest, far_rest, literal = rest[:0], far_rest[:0], np.ones(len(green), bool)
    lengths = [code_lengths(counts)]
    for c in (pixels[0] >> 16 & 255, pixels[0] & 255, pixels[0] >> 24):
        lengths.append(np.zeros(256, np.int64))
        lengths[-1][c] = 1
    lengths.append(code_lengths(far_counts))
    for x in lengths:
        write_code(w, x)
    codes = [(canonical(x).astype(np.uint64), x if np.count_nonzero(x) > 1 else np.zeros_like(x)) for x in (lengths[0], lengths[4])]
    symbol = green.astype(np.int64)
    symbol[at] = 256 + which
    keep = literal.copy()
    keep[at] = True
    long = codes[0][1][symbol]
    value = codes[0][0][symbol]
    value[long == 0] = 0
    for part, bits in ((rest, EXTRA[which]), (codes[1][0][far], codes[1][1][far]), (far_rest, EXTRA[far])):
        value[at] |= np.where(bits > 0, part.astype(np.uint64) << long[at].astype(np.uint64), np.uint64(0))
        long[at] += bits
    value, long = value[keep], long[keep]
    start = np.cumsum(long) - long
    within = (np.arange(int(long.sum())) - np.repeat(start, long)).astype(np.uint64)
    return [w.array(), (np.repeat(value, long) >> within & np.uint64(1)).astype(np.uint8)]


def read_green_only(bits: Bits, code: Code, n: int) -> np.ndarray:
    """``n`` symbols of one code in a row: lengths are looked up at every bit, then followed."""
    if code.only is not None:
        return np.full(n, code.only, np.uint32)
    first = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8, offset=first)
    most = -(-(n * code.bits + 7) // 8) + 3
    raw = np.pad(raw[:most], (0, 32)).astype(np.uint32)
    three = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    mask = (1 << code.bits) - 1
    window = np.empty((len(three), 8), np.uint16)
    for s in range(8):
        window[:, s] = three >> s & mask
    window = window.ravel()
    # lengths of 1, 2, 4 and 8 codes from every bit on; eight codes have 120 bits at most
    step, bit = [code.length[window]], np.arange(len(window), dtype=np.int32)
    for _ in range(3):
        to = bit + step[-1]
        step.append(step[-1] + step[-1].take(to, mode="clip"))
    eight, at, places = step[3].tobytes(), bits.at & 7, []
    add = places.append
    try:
        for _ in range(-(-n // 8)):
            add(at)
            at += eight[at]
    except IndexError:
        raise ValueError("the image is cut short") from None
    at = np.array(places, np.int32)
    for s in (step[2], step[1], step[0]):
        at = np.stack([at, at + s.take(at, mode="clip")], 1).ravel()
    at = at[:n]
    if at[-1] >= len(window):
        raise ValueError("the image is cut short")
    bits.at = first * 8 + int(at[-1]) + int(step[0][at[-1]])
    return code.symbol[window[at]].astype(np.uint32)


def read_green_copies(bits: Bits, green: Code, far: Code, n: int, width: int) -> np.ndarray:
    """As read_green_only(), with back-references; ``bits`` has nothing else after these pixels."""
    first = bits.at >> 3
    raw = np.frombuffer(bits.data + bytes(48), np.uint8, offset=first)
    eight = np.ndarray((len(raw) - 7,), np.dtype("<u8"), raw, 0, (1,))
    at_bit = lambda at: eight[at >> 3] >> (at & 7).astype(np.uint64)
    low = lambda value, n: (value & (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)).astype(np.int64)
    table = lambda code: (code.symbol, code.length) if code.only is None else (np.array([code.only]), np.zeros(1, np.uint8))
    (symbol, length), (far_symbol, far_length) = table(green), table(far)
    end = (len(raw) - 56) * 8
    four = eight[: end >> 3].astype(np.uint32)
    window = np.empty((len(four), 8), np.uint16)
    for i in range(8):
        window[:, i] = four >> np.uint32(i) & np.uint32((1 << green.bits) - 1)
    window = window.ravel()
    step = length[window].astype(np.int32)
    copy = np.flatnonzero(symbol[window] >= 256).astype(np.int32)
    step[copy] += EXTRA[symbol[window[copy]] - 256]
    which = (at_bit(copy + step[copy]) & np.uint64((1 << far.bits) - 1)).astype(np.int32)
    step[copy] += far_length[which] + EXTRA[far_symbol[which]]
    # steps of 1, 2, 4 and 8 symbols from every bit on
    steps, bit = [step], np.arange(len(step), dtype=np.int32)
    for _ in range(3):
        steps.append(steps[-1] + steps[-1].take(bit + steps[-1], mode="clip"))
    jump, at, places = memoryview(steps[3]), bits.at & 7, []
    while at < end and len(places) * 8 < n:
        places.append(at)
        at += jump[at]
    at = np.array(places, np.int32)
    for x in steps[2::-1]:
        at = np.stack([at, at + x.take(at, mode="clip")], 1).ravel()
    at = at[at < end]
    found = symbol[window[at]].astype(np.int64)
    many = np.ones(len(at), np.int64)
    copies = np.flatnonzero(found >= 256)
    here, what = at[copies], found[copies] - 256
    here = here + length[window[here]]
    many[copies] = BASE[what] + low(at_bit(here), EXTRA[what])
    here = here + EXTRA[what]
    which = (at_bit(here) & np.uint64((1 << far.bits) - 1)).astype(np.int32)
    what = far_symbol[which].astype(np.int64)
    distance = BASE[what] + low(at_bit(here + far_length[which]), EXTRA[what])
    near = np.maximum(1, NEARBY @ (1, width))
    distance = np.where(distance > len(NEAR), distance - len(NEAR), near[np.minimum(distance, len(NEAR)) - 1])
    start = np.cumsum(many) - many
    used = int(np.searchsorted(start, n))
    if not used or start[used - 1] + many[used - 1] < n:
        raise ValueError("the image is cut short")
    bits.at = first * 8 + int(at[used - 1] + step[at[used - 1]])
    out = np.zeros(n, np.uint8)
    plain = found[:used] < 256
    out[start[:used][plain]] = found[:used][plain]
    copies = copies[: np.searchsorted(copies, used)]
    if (distance[: len(copies)] > start[copies]).any():
        raise ValueError("a back-reference points before the image")
    pixels = bytearray(out)
    for i, size, d in zip(start[copies].tolist(), np.minimum(many[copies], n - start[copies]).tolist(), distance[: len(copies)].tolist(), strict=True):
        piece = pixels[i - d : min(i, i - d + size)]
        pixels[i : i + size] = piece if d >= size else (piece * (size // d + 1))[:size]
    return np.frombuffer(pixels, np.uint8).astype(np.uint32)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, meta, meta_bits = 1, None, 0
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        across = -(-width // (1 << meta_bits))
        meta = (read_pixels(bits, across, -(-height // (1 << meta_bits)), False) >> 8 & 0xFFFF).tolist()
        groups = max(meta) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    sizes = (256 + LENGTHS + cache_size, 256, 256, 256, DISTANCES)
    codes = [[read_code(bits, size) for size in sizes] for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_bits and all(c.only is not None for c in codes[0][1:4]):
        r, b, a = (c.only for c in codes[0][1:4])
        if codes[0][0].used.max(initial=0) < 256:
            return read_green_only(bits, codes[0][0], n) << 8 | (a << 24 | r << 16 | b)
        if main and codes[0][0].only is None:
            return read_green_copies(bits, codes[0][0], codes[0][4], n, width) << 8 | (a << 24 | r << 16 | b)
    out, cache, shift, late = [0] * n, [0] * cache_size, 32 - cache_bits, 0
    green, red, blue, alpha, far = codes[0]
    i = 0
    while i < n:
        if meta is not None:
            green, red, blue, alpha, far = codes[meta[(i // width >> meta_bits) * across + (i % width >> meta_bits)]]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[i] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < 256 + LENGTHS:
            length = extra(s - 256, bits)
            d = extra(far.read(bits), bits)
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > i:
                raise ValueError("a back-reference points before the image")
            for _ in range(min(length, n - i)):
                out[i] = out[i - d]
                i += 1
        else:
            while late < i:  # colours enter the cache before it is asked
                cache[(CACHE_FACTOR * out[late] & 0xFFFFFFFF) >> shift] = out[late]
                late += 1
            out[i] = cache[s - 256 - LENGTHS]
            i += 1
    return np.array(out, np.uint32)


def write_pixels(w: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: bool = False) -> list[np.ndarray]:
    """Entropy-codes pixels; the bit arrays that follow what ``w`` holds."""
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    if copies and main and not cache_bits and not ((pixels ^ pixels[0]) & 0xFFFF00FF).any():
        return write_green(w, pixels, width)
    size = 256 + LENGTHS + (1 << cache_bits if cache_bits else 0)
    channels = [pixels >> 8 & 255, pixels >> 16 & 255, pixels & 255, pixels >> 24]
    if not cache_bits and not copies:
        lengths = []
        for c in channels:
            if (c == c[0]).all():
                lengths.append(np.zeros(256, np.int64))
                lengths[-1][c[0]] = 1
            else:
                lengths.append(code_lengths(np.bincount(c, minlength=256)))
            write_code(w, lengths[-1])
        write_code(w, np.zeros(DISTANCES, np.int64))
        live = [(c, x) for c, x in zip(channels, lengths, strict=False) if np.count_nonzero(x) > 1]
        if not live:
            return [w.array()]
        code = np.stack([canonical(x).astype(np.uint16)[c] for c, x in live], 1).ravel()
        long = np.stack([x.astype(np.int32)[c] for c, x in live], 1).ravel()
        start = np.cumsum(long, dtype=np.int32) - long
        within = (np.arange(int(long.sum()), dtype=np.int32) - np.repeat(start, long)).astype(np.uint16)
        return [w.array(), (np.repeat(code, long) >> within & 1).astype(np.uint8)]
    tokens, cache, seen = [], {}, {}
    p, i = pixels.tolist(), 0
    hashed = lambda v: (CACHE_FACTOR * v & 0xFFFFFFFF) >> 32 - cache_bits
    while i < len(p):
        j, length = seen.get(tuple(p[i : i + 3]), -1) if copies else -1, 0
        if j >= 0:
            while i + length < len(p) and length < 4096 and p[j + length] == p[i + length]:
                length += 1
        if length >= 3:
            tokens.append((256, *of_value(length), *of_value(i - j + 120)))
        else:
            length = 1
            if cache_bits and cache.get(hashed(p[i])) == p[i]:
                tokens.append((256 + LENGTHS + hashed(p[i]),))
            else:
                tokens.append((p[i] >> 8 & 255, p[i] >> 16 & 255, p[i] & 255, p[i] >> 24))
        for k in range(i, i + length):
            seen[tuple(p[k : k + 3])] = k
            if cache_bits:
                cache[hashed(p[k])] = p[k]
        i += length
    counts = [Counter() for _ in range(5)]
    for t in tokens:
        counts[0][t[0] + t[1] if len(t) == 7 else t[0]] += 1
        if len(t) == 7:
            counts[4][t[4]] += 1
        elif len(t) == 4:
            for k in (1, 2, 3):
                counts[k][t[k]] += 1
    lengths = []
    for c, n in zip(counts, (size, 256, 256, 256, DISTANCES), strict=True):
        lengths.append(code_lengths(np.array([c[s] for s in range(n)])))
        write_code(w, lengths[-1])
    codes = [(canonical(x), x, np.count_nonzero(x) > 1) for x in lengths]

    def put(k: int, s: int) -> None:
        if codes[k][2]:
            w.put(int(codes[k][0][s]), int(codes[k][1][s]))

    for t in tokens:
        put(0, t[0] + t[1] if len(t) == 7 else t[0])
        if len(t) == 7:
            w.put(t[3], t[2])
            put(4, t[4])
            w.put(t[6], t[5])
        elif len(t) == 4:
            for k in (1, 2, 3):
                put(k, t[k])
    return [w.array()]


# --- transforms


def split4(pixels: np.ndarray) -> np.ndarray:
    """Channels in a last axis: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def join4(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view("<u4").reshape(channels.shape[:-1]).astype(np.uint32)


def half(a, b):
    return [x + y >> 1 for x, y in zip(a, b, strict=True)]


def predict(mode: int, left, top, right, corner):
    """What one of the 14 predictors expects, by channel; right: above and to the right."""
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode < 10:
        return half(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, corner, strict=True)]
    return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(half(left, top), corner, strict=True)]


def walk_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, block: int, invert: bool) -> np.ndarray:
    """Adds (or, writing, subtracts) each pixel's prediction from whole pixels before it."""
    src = split4(pixels).reshape(-1, 4).tolist()
    known = [[0] * 4 for _ in src] if invert else src
    out = known if invert else [[0] * 4 for _ in src]
    across = -(-width // (1 << block))
    modes = modes.tolist()
    for i, p in enumerate(src):
        y, x = divmod(i, width)
        if i == 0:
            guess = [0, 0, 0, 255]
        elif y == 0:
            guess = known[i - 1]
        elif x == 0:
            guess = known[i - width]
        else:
            guess = predict(modes[(y >> block) * across + (x >> block)], known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
        out[i] = [v + g & 255 for v, g in zip(p, guess, strict=True)] if invert else [v - g & 255 for v, g in zip(p, guess, strict=True)]
    return join4(np.array(out, np.uint8))


def cross(pixels: np.ndarray, width: int, elements: np.ndarray, block: int, sign: int) -> np.ndarray:
    """Cross-colour transform (sign -1) or its inverse (sign 1)."""
    c = split4(pixels).astype(np.int64)
    i = np.arange(len(pixels))
    e = split4(elements).view(np.int8).astype(np.int64)[(i // width >> block) * -(-width // (1 << block)) + (i % width >> block)]
    signed = lambda v: (v & 255 ^ 128) - 128
    green, red = signed(c[:, 1]), c[:, 2]
    new_red = red + sign * (e[:, 0] * green >> 5) & 255
    seen = signed(new_red if sign > 0 else red)
    blue = c[:, 0] + sign * ((e[:, 1] * green >> 5) + (e[:, 2] * seen >> 5)) & 255
    return join4(np.stack([blue, c[:, 1], new_red, c[:, 3]], 1).astype(np.uint8))


def shift_green(pixels: np.ndarray, sign: int) -> np.ndarray:
    c = split4(pixels).astype(np.int64)
    c[:, 0] += sign * c[:, 1]
    c[:, 2] += sign * c[:, 1]
    return join4((c & 255).astype(np.uint8))


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unbundle(pixels: np.ndarray, packed: int, width: int, height: int, colours: np.ndarray, bits: int) -> np.ndarray:
    green = (pixels >> 8 & 255).reshape(height, packed)
    if bits:
        deep = 8 >> bits
        shifts = np.arange(1 << bits, dtype=np.uint32) * deep
        green = (green[:, :, None] >> shifts & (1 << deep) - 1).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(colours)] = colours
    return full[green].ravel()


# --- whole images


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file, height by width."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICT, CROSS):
            block = bits.read(3) + 2
            sub = read_pixels(bits, -(-across // (1 << block)), -(-height // (1 << block)), False)
            undo.append((kind, across, sub, block))
        elif kind == GREEN:
            undo.append((kind, across, None, 0))
        else:
            n = bits.read(8) + 1
            deltas = split4(read_pixels(bits, n, 1, False)).astype(np.int64)
            colours = join4((np.cumsum(deltas, 0) & 255).astype(np.uint8))
            undo.append((kind, across, colours, bundle_bits(n)))
            across = -(-across // (1 << bundle_bits(n)))
    pixels = read_pixels(bits, across, height, True)
    for kind, wide, table, block in reversed(undo):
        if kind == PREDICT:
            pixels = walk_predictor(pixels, wide, table >> 8 & 255, block, True)
        elif kind == CROSS:
            pixels = cross(pixels, wide, table, block, 1)
        elif kind == GREEN:
            pixels = shift_green(pixels, 1)
        else:
            pixels = unbundle(pixels, -(-wide // (1 << block)), wide, height, table, block)
    return pixels.reshape(height, width)


def encode(
    pixels: np.ndarray,
    palette: bool = False,
    modes: np.ndarray | None = None,
    elements: np.ndarray | None = None,
    green: bool = False,
    block: int = 2,
    cache_bits: int = 0,
    copies: bool = False,
) -> bytes:
    """A lossless WebP file. modes, elements: one for each block of side ``1 << block``."""
    height, width = pixels.shape
    if not (0 < width <= SIDE and 0 < height <= SIDE):
        raise ValueError("sides of 1 to 16384 pixels")
    w, parts, p, across = Writer(), [], np.ascontiguousarray(pixels, np.uint32).ravel(), width
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int((p >> 24 != 255).any()), 1)
    w.put(0, 3)

    def write(sub: np.ndarray, wide: int, main: bool = False, **how) -> None:
        nonlocal w
        parts.extend(write_pixels(w, sub, wide, main, **how))
        w = Writer()

    if palette:
        if (p & 0xFFFF00FF == p[0] & 0xFFFF00FF).all():  # they differ in green alone
            there = np.bincount(p >> 8 & 255, minlength=256) > 0
            index = (np.cumsum(there) - 1)[p >> 8 & 255]
            colours = np.flatnonzero(there).astype(np.uint32) << 8 | p[0] & 0xFFFF00FF
        else:
            colours, index = np.unique(p, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette has at most 256 colours")
        w.put(1 | PALETTE << 1, 3)
        w.put(len(colours) - 1, 8)
        deltas = np.diff(split4(colours).astype(np.int64), axis=0, prepend=0) & 255
        write(join4(deltas.astype(np.uint8)), len(colours))
        bits = bundle_bits(len(colours))
        across = -(-width // (1 << bits))
        index = np.pad(index.reshape(height, width), ((0, 0), (0, (across << bits) - width))).astype(np.uint32)
        packed = (index.reshape(height, across, 1 << bits) << np.arange(1 << bits, dtype=np.uint32) * (8 >> bits)).sum(2, dtype=np.uint32)
        p = packed.ravel() << 8 | np.uint32(BLACK)
    for kind, table in ((PREDICT, modes), (CROSS, elements)):
        if table is not None:
            w.put(1 | kind << 1, 3)
            w.put(block - 2, 3)
            table = np.ascontiguousarray(table, np.uint32).ravel()
            write(table << 8 | np.uint32(BLACK) if kind == PREDICT else table, -(-across // (1 << block)))
            p = walk_predictor(p, across, table, block, False) if kind == PREDICT else cross(p, across, table, block, -1)
    if green:
        w.put(1 | GREEN << 1, 3)
        p = shift_green(p, -1)
    w.put(0, 1)
    write(p, across, True, cache_bits=cache_bits, copies=copies)
    body = np.packbits(np.concatenate(parts), bitorder="little").tobytes()
    body += bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body
