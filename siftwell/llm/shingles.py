"""Five-word shingles, MinHash signatures and Bayesian pruning by them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .ragged import Recent

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5  # a pair at 0.8 shares no band with probability 3e-6
HASHES, SHORT = BANDS * ROWS, 128  # of a signature; those whose low bytes are compared
STEP, TOLERANCE = 16, 1e-6

_random = np.random.default_rng(20_24)
FACTORS = (_random.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
ADDENDS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_powers = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WORDS)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.StringArray, known: Recent | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all texts' shingles, in order; offsets).

    Words are lower-cased and parted by white space.  A text of one to four
    words has one shingle, all its words; an empty one has none.
    """
    known = known or Recent(1 << 20)
    cut = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    found = cut.flatten().dictionary_encode()
    words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
    missing = known.missing(words)
    known.new.update((w, xxhash.xxh3_64_intdigest(w)) for w in missing)
    codes = found.indices.to_numpy()
    begin = cut.offsets.to_numpy().astype(np.int64)
    begin -= begin[0]
    real = np.fromiter(map(len, words), np.int64, len(words))[codes] > 0
    if not real.all():
        begin = np.concatenate([[0], np.cumsum(real)])[begin]
        codes = codes[real]
    h = np.fromiter(map(known.new.__getitem__, words), np.uint64, len(words))[codes]
    n = np.diff(begin)
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    for k in range(WORDS):
        total += mix(padded[k : k + len(h)] + _powers[k]) * _powers[k]
    first = np.ones(len(h), bool)
    left = np.repeat(begin[1:], n) - np.arange(len(h))  # words from here to the text's end
    first = left >= WORDS
    for t in np.flatnonzero((n > 0) & (n < WORDS)):
        at = begin[t]
        first[at] = True
        own = h[at : at + n[t]]
        total[at] = np.uint64((sum(int(x) * pow(31, k + 1, 1 << 64) for k, x in enumerate(own)) + int(n[t])) & ((1 << 64) - 1))
    size = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    return mix(total[first]), np.concatenate([[0], np.cumsum(size)])


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash signatures of the texts that have shingles, a row each."""
    begin = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((HASHES, len(begin)), np.uint32)
    if len(begin):
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            out[k] = np.minimum.reduceat(low * FACTORS[k] + ADDENDS[k], begin)
    return np.ascontiguousarray(out.T)


def band_keys(signs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text and band."""
    x = np.ascontiguousarray(signs).reshape(len(signs), BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), x.shape[:2]).copy()
    for k in range(ROWS):
        total = mix(total ^ x[:, :, k]) + np.uint64(k)
    return mix(total).view(np.int64)


def least_matches(similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values: the fewest matches with P(similarity reached | matches) >= tolerance, under a flat prior.

    Low bytes match by chance once in 256, so values match with probability s + (1 - s) / 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = {}
    for n in range(STEP, SHORT + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(log - log.max())
            if like[s >= similarity].sum() / like.sum() >= tolerance:
                out[n] = m
                break
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs (rows of low bytes) stay when values are compared step by step and hopeless pairs dropped."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, m in least.items():
        matches = matches + (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(1, dtype=np.int32)
        stay = matches >= m
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive


class Union:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
