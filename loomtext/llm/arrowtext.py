"""Arrow string columns as NumPy buffers, and 64-bit fingerprints of words, all vectorised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text hashed at once; longer documents are cut at white space.
CHUNK = 1 << 18


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, xor-shift), salted."""
    x = x ^ U((salt * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(bufs[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(256, dtype=U), 7) | U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_pow = {"f": np.ones(1, U), "b": np.ones(1, U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_pow["f"]) < n:
        size = max(n, CHUNK + 2)
        for key, base in (("f", _BASE), ("b", pow(_BASE, -1, 1 << 64))):
            out, have = np.ones(size, U), 1
            while have < size:
                take = min(have, size - have)
                out[have : have + take] = out[:take] * U(pow(base, have, 1 << 64))
                have += take
            _pow[key] = out
    return _pow["f"], _pow["b"]


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    fwd, back = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * fwd[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * back[starts]
    return mix(h + (ends - starts).astype(U) * U(0x9FB21C651E98DF25))


_SIGN = np.ones(256, bool)
_SIGN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) of all rows, and each row's number of words."""
    return _runs(data, offs, ~_SPACE[data])


def tokens(data: np.ndarray, offs: np.ndarray, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``words``, of runs of ASCII letters, digits and bytes from 128 on; of their first ``prefix`` bytes if given."""
    return _runs(data, offs, ~_SIGN[data], prefix)


def _runs(data: np.ndarray, offs: np.ndarray, solid: np.ndarray, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    rows = offs[:-1][offs[:-1] < offs[1:]]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    first[rows] = solid[rows]
    ends = offs[1:][offs[:-1] < offs[1:]] - 1
    last[ends] = solid[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(s, offs))
    if prefix:
        e = np.minimum(e, s + prefix)
    out, i = np.empty(len(s), U), 0
    while i < len(s):  # words in pieces of CHUNK bytes, so that the tables of powers stay small
        j = max(i + 1, int(np.searchsorted(e, s[i] + CHUNK, side="right")))
        out[i:j] = _hash_spans(data[s[i] : e[j - 1]], s[i:j] - s[i], e[i:j] - s[i])
        i = j
    return out, counts


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each row's k-word shingles; fewer words: the whole sequence as one; none: empty."""
    w, counts = words(data, offs)
    at = np.concatenate(([0], np.cumsum(counts)))
    mul = U(0xC2B2AE3D27D4EB4F)
    gram = w.copy()
    for i in range(1, k):
        gram = gram[:-1] * mul + w[i:] if len(gram) > 1 else gram[:0]
    gram = mix(gram, k)
    out = []
    for r in range(len(counts)):
        a, n = int(at[r]), int(counts[r])
        if n >= k:
            out.append(np.unique(gram[a : a + n - k + 1]))
        elif n:
            h = w[a : a + 1]
            for i in range(1, n):
                h = h * mul + w[a + i]
            out.append(mix(h, 100 + n))
        else:
            out.append(np.zeros(0, U))
    return out
