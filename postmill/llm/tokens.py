"""Words of whole Arrow columns as 64-bit hashes, without a Python string per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shared import strings

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply); a bijection on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            n = max(n, CHUNK + 1)
            _POWERS["up"] = _powers(_BASE, n)
            _POWERS["down"] = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), n)
    return _POWERS["up"], _POWERS["down"]


class Alphabet:
    """Which bytes belong to words, and what each counts as; A-Z count as a-z unless ``fold`` is off."""

    def __init__(self, is_word: np.ndarray, fold: bool = True):
        self.is_word = is_word
        as_what = np.arange(256)
        as_what[65:91] += 32 * fold
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)[as_what]


def _alphabet(separators: list[tuple[int, int]], fold: bool = True) -> Alphabet:
    is_word = np.ones(256, bool)
    for a, b in separators:
        is_word[a : b + 1] = False
    is_word[65:91] = is_word[97:123]
    return Alphabet(is_word, fold)


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
LETTERS = _alphabet([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Words [^\x20\x09-\x0D]+ once A-Z are lower-cased.
BLANKS = _alphabet([(0x20, 0x20), (0x09, 0x0D)])
#: The same words as they stand.
EXACT = _alphabet([(0x20, 0x20), (0x09, 0x0D)], fold=False)


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and where each row begins (one offset more than rows)."""
    col = strings(col)
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    found = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.empty(0, np.uint8)
    return found, offsets - first


def spans(col: pa.Array, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, first and end offset of each word, and for each row the number of its first word."""
    data, offsets = raw_bytes(col)
    if not len(data):
        none = np.empty(0, np.int64)
        return data, none, none, np.zeros(len(offsets), np.int64)
    word = alphabet.is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word
    ends[:-1] &= ~word[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return data, start, end, np.searchsorted(start, offsets)


def hash_words(col: pa.Array, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (uint64), and for each row the number of its first word (rows + 1 values).

    A word's hash is a polynomial over its bytes modulo 2**64, taken as a difference of prefix
    sums, then mixed; equal words have equal hashes wherever they stand.
    """
    data, start, end, rows = spans(col, alphabet)
    out = np.empty(len(start), np.uint64)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(start):
            s0 = start[k]
            n = max(1, int(np.searchsorted(end, s0 + CHUNK, side="right")) - k)
            size = int(end[k + n - 1] - s0)
            up, down = powers(size + 1)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(alphabet.value[data[s0 : s0 + size]] * up[:size], out=sums[1:])
            a, b = start[k : k + n] - s0, end[k : k + n] - s0
            out[k : k + n] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
            k += n
        return mix(out), rows


def shingles(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words of a row; a shorter, non-empty row is one run. Hashes and row offsets."""
    counts = np.diff(rows)
    with np.errstate(over="ignore"):
        if len(words) >= n:
            run = np.zeros(len(words) - n + 1, np.uint64)
            for k in range(n):
                run = run * _BASE + words[k : k + len(run)]
        else:
            run = np.empty(0, np.uint64)
        made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        offsets = np.concatenate([[0], np.cumsum(made)])
        at = np.repeat(rows[:-1] - offsets[:-1], made) + np.arange(offsets[-1])
        short = np.flatnonzero((counts > 0) & (counts < n))
        if not len(short):
            return mix(run[at]), offsets
        out = np.zeros(offsets[-1], np.uint64)
        long = np.repeat(counts >= n, made)
        out[long] = run[at[long]]
        for r in short:
            h = np.uint64(counts[r])
            for w in words[rows[r] : rows[r + 1]]:
                h = h * _BASE + w
            out[offsets[r]] = h
        return mix(out), offsets
