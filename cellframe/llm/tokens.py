"""Hashes of words and of runs of tokens, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd bases of polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
CHUNK_BYTES = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    up, down = _powers.get(base, (np.zeros(0, U), np.zeros(0, U)))
    if len(up) < n:
        size = max(n, 2 * len(up), 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            x = np.full(size, b, U)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        up, down = _powers[base] = tuple(made)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(32)) * U(0xFF51AFD7ED558CCD)
    x = (x ^ x >> U(29)) * U(0xC4CEB9FE1A85EC53)
    return x ^ x >> U(32)


class Prefix:
    """Hashes of any run of tokens of one long sequence."""

    def __init__(self, tokens: np.ndarray, base: int):
        up, self.down = powers(base, len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, U)
        np.cumsum(tokens * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A binary column without nulls in pieces: first row, bytes, and offsets of its rows in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def runs_of(x: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of runs of numbers: a mixed step for each of them, so that no sum of products
    decides. Two seeds give two independent halves of a digest."""
    out = mix(size.astype(U) + U(BASES[seed]))
    left = np.arange(len(start))
    i = 0
    while len(left):
        left = left[size[left] > i]
        out[left] = mix((out[left] ^ x[start[left] + i]) * U(BASES[1 - seed]) + U(BASES[2]))
        i += 1
    return out


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of spans of bytes, eight bytes at a step."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded.data, 0, (1,))
    size = end - start
    out = mix(size.astype(U) + U(BASES[seed]))
    left = np.arange(len(start))
    at = 0
    while len(left):
        rest = size[left] - at
        x = eight[start[left] + at]
        short = rest < 8
        x[short] &= (U(1) << (rest[short] * 8).astype(U)) - U(1)
        out[left] = mix((out[left] ^ x) * U(BASES[1 - seed]) + U(BASES[2]))
        at += 8
        left = left[rest > 8]
    return out


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts that lie one after another, and the offsets of each
    text's words. A word is a run without bytes 0x20 and 0x09 to 0x0D; none crosses texts."""
    start, end, at, raw = word_spans(raw, offsets, lower)
    return span_hashes(raw, start, end, seed), at


def wide(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """One number from two halves of a digest. A step of one half can be undone by choosing what
    comes next; what undoes it in both at once isn't known without trying 2**32 of them."""
    return mix(one + mix(other))


def wide_words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """words() by two halves."""
    start, end, at, raw = word_spans(raw, offsets, lower)
    return wide(span_hashes(raw, start, end), span_hashes(raw, start, end, 1)), at


def word_spans(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of words() start and end, the offsets of each text's, and the bytes read."""
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    inside = ~((raw == 32) | (raw - np.uint8(9) <= 4))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(raw)]
    begins[cut] |= inside[cut]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets), raw


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours; as many as there are whole windows."""
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
