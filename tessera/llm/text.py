"""Whole Arrow batches of UTF-8 text as numpy arrays: byte buffers, word spans and 64-bit hashes.

Everything here is vectorised over a batch; no function loops over words. A null text counts as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_PIECE = 1 << 18
#: Tables of powers up to this length are kept.
_KEPT = 1 << 20
_powers: dict[int, np.ndarray] = {}
#: A second sum modulo a prime, as some texts have equal sums modulo 2**64 whatever the base.
PRIME = np.uint64((1 << 31) - 1)
_PRIME_BASE = 1_583_458_089
_PRIME_INVERSE = pow(_PRIME_BASE, -1, int(PRIME))
_PRIME_TABLE = np.random.default_rng(21).integers(1, int(PRIME), 256, dtype=np.uint64)
_prime_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= _KEPT:
            _powers[base] = have
    return have[:n]


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, or PRIME or little more: one addition, as 2**31 is 1 modulo PRIME."""
    return (x & PRIME) + (x >> np.uint64(31))


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME, kept for later calls."""
    have = _prime_powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            step = np.uint64(pow(base, len(have), int(PRIME)))
            have = np.concatenate((have, have * step % PRIME))
        if n <= _KEPT:
            _prime_powers[base] = have
    return have[:n]


class Sums:
    """Running sums of a byte buffer of at most a few MB: a 64-bit hash of any of its spans, from two polynomials."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.run, self.prime = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[buf] * powers(_BASE, n), out=self.run[1:])
        np.cumsum(folded(_PRIME_TABLE[buf] * prime_powers(_PRIME_BASE, n)), out=self.prime[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        n = len(self.run)
        wide = (self.run[ends] - self.run[starts]) * powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x = folded(folded(folded(self.prime[ends] - self.prime[starts]) * prime_powers(_PRIME_INVERSE, n)[starts]))
        x = np.where(x >= PRIME, x - PRIME, x)
        return mix(wide + np.uint64(seed) + mix(x))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trimmed(rows):  # noqa: ANN001, ANN201
    """A function over batches that afterwards gives freed memory back, which an idle worker would keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


def column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows."""
    a = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(a.type):
        a = a.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    _, offsets, data = a.buffers()
    offs = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer row stands alone."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without white space, and the n + 1 word offsets of the rows."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~SPACE[buf]
    head = np.zeros(n + 1, bool)
    head[offs] = True
    starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])) | word & head[:-1])
    ends = np.flatnonzero(word & (np.concatenate((~word[1:], [True])) | head[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ascending, disjoint byte spans, by differences of running polynomial sums."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        out[i:j] = Sums(buf[lo:hi]).hashes(starts[i:j] - lo, ends[i:j] - lo, seed)
        i = j
    return out


class Table:
    """Positions of 64-bit hashes in sorted distinct keys, by their leading bits: a few probes where bisection takes many."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        self.bits = max(8, min(24, len(keys).bit_length() + 2))
        lead = keys >> np.uint64(64 - self.bits)
        self.starts = np.searchsorted(lead, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending positions of the hashes that are keys, and the key of each."""
        lead = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        todo = np.flatnonzero(at < end)
        at, end, want = at[todo], end[todo], hashes[todo]
        hits, keys = [], []
        while len(todo):
            same = self.keys[at] == want
            hits.append(todo[same]), keys.append(at[same])
            left = ~same & (at + 1 < end)
            todo, at, end, want = todo[left], at[left] + 1, end[left], want[left]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = np.concatenate(hits)
        order = np.argsort(hit, kind="stable")
        return hit[order], np.concatenate(keys)[order].astype(np.int64)


def ngrams(hashes: np.ndarray, woffs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each row and the row offsets; a row of 1 to n-1 words gives one window of them all."""
    counts = np.diff(woffs)
    got = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    goffs = np.concatenate(([0], np.cumsum(got)))
    total = int(goffs[-1])
    at = np.repeat(woffs[:-1] - goffs[:-1], got) + np.arange(total)
    last = np.repeat(woffs[1:], got)
    out = np.zeros(total, np.uint64)
    padded = np.concatenate((hashes, np.zeros(n, np.uint64)))
    for k in range(n):
        inside = at + k < last
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + np.where(inside, padded[at + k], np.uint64(k + 1)))
    return out, goffs


def row_unique(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ascending, and their row offsets."""
    v = values.copy()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        v[a:b].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    keep[offs[:-1][np.diff(offs) > 0]] = True
    return v[keep], np.concatenate(([0], np.cumsum(keep)))[offs]


def gather(idx: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ragged rows `idx` of a table with row offsets `offs`, and the n + 1 offsets of the result."""
    lens = offs[idx + 1] - offs[idx]
    out = np.concatenate(([0], np.cumsum(lens)))
    return np.repeat(offs[idx] - out[:-1], lens) + np.arange(int(out[-1])), out


def lists(values: np.ndarray, offs: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Ragged rows as an Arrow list array."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values, kind))


class UnitCache:
    """Ids of text units: sorted 64-bit hashes over ragged id rows and the units' bytes, emptied when it holds `limit` units.

    A hit counts only if the bytes are the same; units whose hash another unit has are encoded again each time.
    """

    def __init__(self, encode, limit: int = 3_000_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.offs = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.text, self.text_offs = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _add(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        ids, lens = self.encode(buf, starts, ends)
        fresh = len(self.offs) - 1 + np.arange(len(starts))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.offs = np.concatenate((self.offs, self.offs[-1] + np.cumsum(lens)))
        size = np.cumsum(ends - starts)
        at = np.repeat(starts - (size - (ends - starts)), ends - starts) + np.arange(int(size[-1]) if len(size) else 0)
        self.text = np.concatenate((self.text, buf[at]))
        self.text_offs = np.concatenate((self.text_offs, self.text_offs[-1] + size))
        return fresh

    def lookup(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """The cache row of every unit, units not met before being encoded together, each once. The units cut buf from
        its first byte to its last."""
        h = hash_spans(buf, starts, ends) if hashes is None else hashes
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.limit:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            fresh = self._add(buf, starts[first[new]], ends[first[new]])
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.rows = np.insert(self.rows, at[new], fresh)
            at = np.searchsorted(self.keys, keys)
        rows = self.rows[at][back]
        same = self.text_offs[rows + 1] - self.text_offs[rows] == ends - starts
        if same.all():
            spots, _ = gather(rows, self.text_offs)
            wrong = np.flatnonzero(self.text[spots] != buf[starts[0] : ends[-1]] if len(starts) else spots)
            same[np.searchsorted(starts, wrong + starts[0], "right") - 1 if len(wrong) else []] = False
        if not same.all():
            # The lengths differ somewhere: compare unit by unit what is left.
            data = buf.tobytes()
            held = self.text.tobytes()
            for i, r in enumerate(rows.tolist()):
                same[i] = data[starts[i] : ends[i]] == held[self.text_offs[r] : self.text_offs[r + 1]]
            other = np.flatnonzero(~same)
            rows[other] = self._add(buf, starts[other], ends[other])
        return rows
