"""Words of many texts at once, as 64-bit hashes, by array operations on their UTF-8 bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_SEED = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
LONG = 64               # bytes; longer words are hashed one by one
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32                                                                     # A-Z only

# byte classes: a word is a longest run of bytes with True
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64-bit result."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_runs(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes ``buf[begin:end]``.

    Eight bytes at a time are mixed into the state by a bijection, so runs of up to eight bytes and one length never clash and longer ones
    only by chance, whatever they are made of; runs of more than LONG bytes take BLAKE2b."""
    length = end - begin
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, np.dtype("<u8"), padded, strides=(1,))       # the eight bytes from each place on
    out = mix(length.astype(np.uint64) * _STEP + _SEED)
    at, done = np.flatnonzero(length <= LONG), 0
    while len(at):
        left = length[at] - done
        part = eight[begin[at] + done] & (np.uint64(2**64 - 1) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64))
        out[at] = mix(out[at] * _STEP ^ part)
        done += 8
        at = at[left > 8]
    raw = memoryview(buf)
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[begin[i]:end[i]], digest_size=8).digest(), "little")
    return out


def slices(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text stands alone, whole."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def words(texts: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the lower-cased texts in order, and the offsets of each text's words (one more than texts)."""
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = kind[buf]
    flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        flips = np.concatenate([[0], flips])
    begin, end = flips[0::2], flips[1::2]                       # the last byte is a blank, so every word ends
    hashes = _hash_runs(buf, begin, end)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return hashes, np.searchsorted(begin, np.concatenate([[0], np.cumsum(lengths)]))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on (len - n + 1 values); texts are not looked at."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * _STEP + hashes[j:j + m]
    return mix(out + np.uint64(n))


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct ``n``-word shingles of each text; a text of fewer words, but not none, has its whole sequence as one."""
    out = []
    hashes, offs = words(texts, NOT_BLANK)
    all_grams = grams(hashes, n)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(all_grams[a:b - n + 1]))
        else:
            out.append(grams(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
