"""Sets of word shingles as sorted arrays of 64-bit hashes, made per Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word."""
    x = (x ^ (x >> np.uint64(32))) * ODD[3]
    x = (x ^ (x >> np.uint64(29))) * ODD[0]
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (ASCII white space, A-Z lower-cased) and the number of words of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = parts.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = parts.offsets.to_numpy()
    counts = np.concatenate([[0], np.cumsum(real)])
    codes = words.filter(pa.array(real)).dictionary_encode()
    distinct = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in codes.dictionary.to_pylist()), np.uint64, len(codes.dictionary))
    return distinct[codes.indices.to_numpy()] if len(codes) else np.empty(0, np.uint64), np.diff(counts[offsets])


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after another, and their number per text.

    A shingle is ``width`` words in a row; a text with fewer words has one shingle, all its words; one without words none.
    """
    words, n = word_hashes(texts)
    ends = np.cumsum(n)
    starts = ends - n
    hashes = np.zeros(len(words), np.uint64)
    for k in range(min(width, len(words))):  # windows over the end of a text are made too and not used
        hashes[: len(words) - k] = mixed(hashes[: len(words) - k] * ODD[1] + words[k:])
    sets, sizes = [], np.zeros(len(n), np.int64)
    for i, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
        if end - start >= width:
            found = np.unique(hashes[start : end - width + 1])
        elif end > start:
            found = np.array([xxhash.xxh3_64_intdigest(words[start:end].tobytes(), seed=end - start)], np.uint64)
        else:
            continue
        sets.append(found)
        sizes[i] = len(found)
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), sizes
