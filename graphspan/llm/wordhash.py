"""Words of many texts as one buffer, with 64-bit fingerprints computed by whole arrays."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240611)
#: Odd multipliers, by the place of a byte in its word; they repeat after 4096 bytes, mixed with the round.
_PLACES = _RANDOM.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 1 << 18

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words (runs without blank, tab, line feed, vertical tab, form feed and carriage return) of each text.

    buffer: words of a text parted by one blank, texts ended by a line feed; begin and end: of words, in bytes;
    n: words of each text; first: where each text's words begin.
    """

    def __init__(self, texts: list[str] | list[bytes], lower: bool = False):
        raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        if lower:
            raw = [t.translate(LOWER) for t in raw]
        self.lines = [b" ".join(t.split()) for t in raw]
        self.buffer = b"\n".join(self.lines) + b"\n"
        self.bytes = np.frombuffer(self.buffer, np.uint8)
        end = np.flatnonzero((self.bytes == 32) | (self.bytes == 10))
        begin = np.concatenate([[0], end[:-1] + 1])
        some = end > begin
        self.begin, self.end = begin[some], end[some]
        self.n = np.fromiter((t.count(b" ") + 1 if t else 0 for t in self.lines), np.int64, len(self.lines))
        self.first = np.cumsum(self.n) - self.n

    def fingerprints(self) -> np.ndarray:
        out = np.zeros(len(self.begin), np.uint64)
        for a in range(0, len(out), _STEP):
            begin, end = self.begin[a : a + _STEP], self.end[a : a + _STEP]
            size = end - begin
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            byte = self.bytes[np.repeat(begin, size) + place].astype(np.uint64) + np.uint64(1)
            weight = _PLACES[place & 4095] + (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out[a : a + _STEP] = mix(np.add.reduceat(byte * weight, np.cumsum(size) - size) + size.astype(np.uint64))
        return out


def grams(prints: np.ndarray, m: int) -> np.ndarray:
    """Fingerprints of m words from each place on (the last m - 1 places aren't whole)."""
    out = np.zeros(len(prints), np.uint64)
    for k in range(m):
        out[: len(prints) - k] += mix(prints[k:] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)))
    return mix(out)
