"""Vectorised tokenising over Arrow string columns.

Texts are cut and hashed as UTF-8 bytes: every separator named by the contracts is an
ASCII byte, so byte classes give the same words as code point classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = ~_bytes((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = ~_bytes((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_rng = np.random.default_rng(20240607)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
#: Bytes whose powers and prefix sums are held at once; a longer word is a slab of its own.
_SLAB = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, _SLAB + 1)
        with np.errstate(over="ignore"):
            for name, base in (("p", _P), ("i", _P_INV)):
                t = np.full(size, base, dtype=np.uint64)
                t[0] = 1
                _powers[name] = np.multiply.accumulate(t)
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def chunks(column: pa.Array, most: int = 1 << 20):
    """(first row, rows, offsets from 0, bytes) of pieces of about `most` bytes; a longer text is a piece of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        end = min(end, n)
        yield row, end - row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


@dataclass
class Words:
    data: np.ndarray  #: lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  #: row of each word, non-decreasing
    count: np.ndarray  #: words of each row
    first: np.ndarray  #: index of each row's first word

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def texts(self, which: np.ndarray) -> list[str]:
        raw, s, e = self.data.tobytes(), self.start[which].tolist(), self.end[which].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(s, e)]

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes, by prefix sums of a polynomial over slabs of words."""
        out = np.empty(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(out):
            base = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, base + _SLAB, side="right")))
            start, end = self.start[at:to] - base, self.end[at:to] - base
            n = int(end[-1])
            power, inverse = _power_tables(n + 1)
            with np.errstate(over="ignore"):
                prefix = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(_LETTER[self.data[base : base + n]] * power[:n], out=prefix[1:])
                h = (prefix[end] - prefix[start]) * inverse[start]
                out[at:to] = mix(h + (end - start).astype(np.uint64))
            at = to
        return out


def words(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes of a class in each row, lower-cased."""
    data = LOWER[data]
    n, rows = len(data), len(offsets) - 1
    is_in = inside[data]
    bound = np.zeros(n + 1, dtype=bool)
    bound[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = is_in[:-1]
    start = np.flatnonzero(is_in & (~before | bound[:-1]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = is_in[1:]
    end = np.flatnonzero(is_in & (~after | bound[1:])) + 1
    at = np.searchsorted(start, offsets)
    count = np.diff(at)
    return Words(data, start, end, np.repeat(np.arange(rows), count), count, at[:-1])


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes (the caller drops those across rows)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(width * 0x51ED270B), dtype=np.uint64)
        for k in range(width):
            total = total * _P + h[k : k + n]
    return mix(total)


def list_array(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row: (row, hash), sorted by row and unsigned hash. Fewer words: the whole sequence is one shingle."""
    h = w.hashes()
    full = windows(h, width)
    row = w.row[: len(full)]
    keep = row == w.row[width - 1 :] if len(full) else np.zeros(0, bool)
    rows, values = [row[keep]], [full[keep]]
    for k in range(1, width):
        short = np.flatnonzero(w.count == k)
        if len(short):
            with np.errstate(over="ignore"):
                total = np.full(len(short), np.uint64(k * 0x2545F491), dtype=np.uint64)
                for j in range(k):
                    total = total * _P + h[w.first[short] + j]
            rows.append(short)
            values.append(mix(total))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[new], value[new]
    return row, value
