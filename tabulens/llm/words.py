"""Words of many texts at once, as numpy arrays, for functions that run over Arrow batches.

``bytes.split()`` parts at ASCII white space and ``bytes.lower()`` lowers A-Z only, which is the
word rule used across this subpackage.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

#: Texts of about so many bytes are worked on together; a longer text stands alone.
CHUNK = 4_000_000
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def chunks(texts: list[str | None], most: int = CHUNK):
    """(first, last) index pairs of runs of texts with about ``most`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def split(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """A code per word, the words of the codes, and where each text's words begin (and the end)."""
    words = [(t or "").encode().lower().split() if lower else (t or "").encode().split() for t in texts]
    ends = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=ends[1:])
    coded = pa.array(chain.from_iterable(words), pa.large_binary(), size=int(ends[-1])).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), ends


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def combine(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash for each row of equally long arrays of hashes; their order counts."""
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for mix, column in zip(_MIX, columns, strict=False):
        x = (column + out) * mix
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out = x ^ (x >> np.uint64(32))
    return out


def shingle_sets(texts: list[str | None], width: int = 5):
    """Each text's distinct shingle hashes, sorted, as int64. A text with fewer words than
    ``width`` has its whole word sequence as its only shingle; one without words has none."""
    codes, words, ends = split(texts)
    per_word = hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = len(per_word) - width + 1
    rows = combine([per_word[i : i + n] for i in range(width)]).view(np.int64) if n > 0 else np.zeros(0, np.int64)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= width:
            yield np.unique(rows[a : b - width + 1])
        elif b > a:
            whole = b" ".join(words[c] for c in codes[a:b])
            yield np.array([xxhash.xxh3_64_intdigest(whole, seed=int(b - a))], dtype=np.uint64).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
