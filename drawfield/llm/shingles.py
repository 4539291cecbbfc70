"""Hashed words and word shingles of texts, a batch at a time with numpy.

Words are runs of bytes other than ``\\x20 \\x09-\\x0D`` (or other than all ASCII signs), A-Z in lower case. A word's hash is a
polynomial over its bytes (a difference of prefix sums), a shingle's hash mixes the hashes of its
words. All hashes have 64 bits: two different shingles meet with a chance of 2**-64.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from drawfield.llm.common import travels

travels(__name__)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ONE = np.uint64(0xBF58476D1CE4E5B9)
_TWO = np.uint64(0x94D049BB133111EB)


def mix(x):
    x = (x ^ (x >> np.uint64(30))) * _ONE
    x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as far as they were needed; travels empty."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def upto(self, n):
        if len(self.up) < n:
            factors = np.full((2, n), [[_BASE], [_INVERSE]], np.uint64)
            factors[:, 0] = 1
            self.up, self.down = np.cumprod(factors, axis=1, dtype=np.uint64)
        return self.up, self.down


_powers = _Powers()


#: Bytes between words: white space; and everything in ASCII but letters and digits.
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_hashes(texts, between=SPACE):
    """``(hashes of all words, words per text)``. A-Z counts as a-z."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    low, space = _LOWER[data], between[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers.upto(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:len(low)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def pieces(batch, most=1 << 20):
    """Parts of an Arrow batch whose ``text`` has at most ``most`` bytes together, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy()
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def binaries(values, starts):
    """Slices of an array as a binary column: ``starts`` has one place more than there are slices."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(starts, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def shingle_sets(texts, words=4, short="whole"):
    """For each text the sorted distinct hashes of its shingles.

    ``short``: a text of fewer words gives its whole sequence as one shingle (``whole``) or none.
    """
    hashes, counts = word_hashes(texts)
    n = max(0, len(hashes) - words + 1)
    value = np.zeros(n, np.uint64)
    for k in range(words):
        value = mix(value * _TWO + hashes[k:k + n] + np.uint64(k + 1))
    ends = np.cumsum(counts)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        if count >= words:
            out.append(np.unique(value[end - count:end - words + 1]))
        elif count and short == "whole":
            one = np.zeros(1, np.uint64)
            for k in range(end - count, end):
                one = mix(one * _ONE + hashes[k] + np.uint64(count))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_ids(sets):
    """A 64-bit name of each set, equal for equal sets; 0 for the empty one."""
    return np.array([int(mix(mix(s).sum(keepdims=True) + np.uint64(len(s)))[0]) if len(s) else 0
                     for s in sets], np.uint64).view(np.int64)
