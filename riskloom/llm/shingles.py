"""Sets of hashed word shingles of whole texts, many texts at a time, in numpy.

Words are runs of UTF-8 bytes other than the six ASCII white-space bytes, A-Z lowered. A word's
hash is a polynomial over a random table, read off prefix sums; a shingle's is a mix of five.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RANDOM = np.random.default_rng(20_240_229)
_TABLE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_TABLE[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_MIX = U(0xBF58476D1CE4E5B9)
_STEP = U(0x94D049BB133111EB)
#: Bytes of text hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * _MIX
    h = (h ^ (h >> U(27))) * _STEP
    return h ^ (h >> U(31))


def hashed_words(texts: list[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the first position of each text (one more at the end)."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    power, inverse = _power_tables(len(raw))
    space = space[raw]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
    starts = edge[0::2]
    ends = edge[1::2]
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[raw] * power[: len(raw)], out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * inverse[starts])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(starts, begins)


def _chunk(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and the first position of each text (one more at the end)."""
    words, first_word = hashed_words(texts)
    counts = np.diff(first_word)
    # one shingle less width - 1 for each text, one for a short one, none without words
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(first[-1], np.uint64)
    h = words[: max(0, len(words) - width + 1)].copy()
    for k in range(1, width):
        h = h * _BASE + words[k : len(words) - width + 1 + k]
    h = mixed(h)
    long = counts >= width
    if len(h):
        at = np.repeat(first_word[:-1][long] - first[:-1][long], sizes[long])
        place = np.repeat(long, sizes)
        out[place] = h[at + np.flatnonzero(place)]
    for i in np.flatnonzero((counts > 0) & ~long).tolist():
        x = U(counts[i])
        with np.errstate(over="ignore"):
            for w in words[first_word[i] : first_word[i + 1]]:
                x = x * _STEP + w
        out[first[i]] = mixed(np.array([x], np.uint64))[0]
    return out, first


def byte_chunks(texts: list[str]):
    """The texts in order, as lists of UTF-8 bytes of about ``CHUNK`` each."""
    part, size = [], 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        if part and size + len(raw) > CHUNK:
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield part


def shingle_chunks(texts: list[str], width: int = 5):
    """For chunks of the texts in order: all shingle hashes, and where each text's begin."""
    for part in byte_chunks(texts):
        yield _chunk(part, width)


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return [np.unique(h[a:b]) for h, first in shingle_chunks(texts, width) for a, b in zip(first[:-1], first[1:], strict=True)]
