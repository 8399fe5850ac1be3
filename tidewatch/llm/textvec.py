"""Word hashes of a batch of texts, as numpy arrays.

Small helpers that run inside tasks; Spark splits and shuffles the work.
"""

from __future__ import annotations

import numpy as np

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and their inverses modulo 2**64, kept between calls."""
    for k, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
        while len(_powers[k]) < n:
            have = _powers[k]
            step = np.uint64(pow(base, len(have), 1 << 64))
            _powers[k] = np.concatenate([have, have * step])
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of the 64-bit input."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """Ranges [a, b) of texts with about `limit` bytes each; every text is in one range."""
    a = total = 0
    for b, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield a, b
            a, total = b, 0
        total += len(text) + 1
    if a < len(texts):
        yield a, len(texts)


def word_hashes(texts: list[bytes], stem: int | None = None) -> tuple[np.ndarray, ...]:
    """(hash, text number) of every word in order, and the hash of its first `stem` bytes.

    Words are runs of digits, a-z and all non-ASCII bytes after ASCII lower-casing.
    """
    joined = b"\n".join(texts).lower() + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    word = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    doc = np.searchsorted(np.cumsum(lengths), starts, side="right")
    if stem is None:
        return hashes, doc
    ends = np.minimum(ends, starts + stem)
    return hashes, doc, mixed((sums[ends] - sums[starts]) * inverse[starts] - np.uint64(1))


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null counts as empty."""
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]
