"""Vectorised words and hashes of whole texts, for Arrow batches in executors.

Words are maximal runs without \\x20 and \\x09-\\x0D, A-Z lower-cased where asked.
A word's hash is a polynomial of its bytes modulo 2**64, finished by a mixer;
memory is bounded by pieces of ``PIECE`` bytes, whatever the length of a text.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SALT = _U(0x5851F42D4C957F2D)
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACES = (0x20, *range(0x09, 0x0E))


_TABLES = []


def _powers(base: int, size: int):
    steps = np.full(size, base, _U)
    steps[0] = 1
    return np.cumprod(steps, dtype=_U)


def _tables():
    if _TABLES:
        return _TABLES[0]
    size = 2 * PIECE + 2
    powers = [_powers(base, size) for base in (_BASE, _INVERSE)]
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    _TABLES.append((powers[0], powers[1], lower, space))
    return _TABLES[0]


def mixed(x):
    """A bijection of 64-bit integers that spreads every bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hashes(data: bytes, fold: bool):
    """Hashes of the words of a piece, and where each starts."""
    powers, inverse, lower, space = _tables()
    raw = np.frombuffer(data, np.uint8)
    if fold:
        raw = lower[raw]
    blank = np.concatenate(([True], space[raw], [True]))
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    if not len(starts):
        return np.zeros(0, _U), starts
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    if len(raw) >= len(powers):  # one word longer than a piece
        powers, inverse = (_powers(base, len(raw) + 1) for base in (_BASE, _INVERSE))
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * powers[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + ends.astype(_U) - starts.astype(_U)), starts


def _pieces(text: bytes):
    """A long text in pieces of about PIECE bytes that end between words."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes], fold: bool):
    """Yields (first, arrays): word hashes of the texts from place ``first`` on, an array a text."""
    held, first, size = [], 0, 0
    def done():
        found, starts = _hashes(b" ".join(held), fold)
        bounds = np.cumsum([0] + [len(x) + 1 for x in held])
        cuts = np.searchsorted(starts, bounds)
        return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    for i, text in enumerate(texts):
        if held and size + len(text) > PIECE:
            yield first, done()
            held, size = [], 0
        if len(text) > PIECE:
            yield i, [np.concatenate([_hashes(x, fold)[0] for x in _pieces(text)])]
            continue
        if not held:
            first = i
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, done()


def texts_of(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _ngrams(words, n: int):
    m = max(0, len(words) - n + 1)
    total = np.full(m, n, _U)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = mixed(total * _U(_BASE) + words[k : k + m])
    return total


def ngram_hashes(words, n: int):
    """Hashes of runs of ``n`` words; a shorter text that isn't empty is one run."""
    return _ngrams(words, min(n, len(words))) if len(words) else words


def distinct(hashes):
    """Sorted, each once."""
    hashes = np.sort(hashes)
    return hashes[np.concatenate((hashes[:1] == hashes[:1], hashes[1:] != hashes[:-1]))]


def shingles(texts: list[bytes], n: int):
    """Yields (place, shingle hashes in the order of the text) of every text; those of texts that are hashed together are made together."""
    for first, arrays in word_hashes(texts, True):
        if len(arrays) == 1:
            yield first, ngram_hashes(arrays[0], n)
            continue
        whole, at = _ngrams(np.concatenate(arrays), n), 0
        for i, words in enumerate(arrays, first):
            yield i, whole[at : at + len(words) - n + 1] if len(words) >= n else ngram_hashes(words, n)
            at += len(words)


def shingle_sets(texts: list[bytes], n: int):
    """Yields (place, sorted distinct shingle hashes) of every text."""
    for i, found in shingles(texts, n):
        yield i, distinct(found)


def fingerprints(sets: list) -> list[bytes | None]:
    """fingerprint() of each set; None for an empty one."""
    full = [s for s in sets if len(s)]
    if not full:
        return [None] * len(sets)
    flat, starts = np.concatenate(full), np.cumsum([0] + [len(s) for s in full])[:-1]
    with np.errstate(over="ignore"):
        sums = np.stack([np.add.reduceat(mixed(x), starts) for x in (flat, flat ^ _SALT)], 1)
    made = iter(sums)
    return [next(made).tobytes() if len(s) else None for s in sets]


def fingerprint(hashes) -> bytes:
    """128 bits of a set of hashes."""
    with np.errstate(over="ignore"):
        a, b = mixed(hashes).sum(dtype=_U), mixed(hashes ^ _SALT).sum(dtype=_U)
    return np.array([a, b], _U).tobytes()
