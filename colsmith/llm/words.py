"""Hashed words and word shingles of whole Arrow batches, as flat numpy arrays with offsets."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                        0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function (constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, marks: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of all texts in a row, and where each text's words begin and end.

    Words are runs of characters that are no white space; without ``marks``, runs of letters and numbers. A null text
    has no words.
    """
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    if not marks:
        lower = pc.replace_substring_regex(lower, r"[^\p{L}\p{N}]+", " ")
    lists = pc.utf8_split_whitespace(lower)
    flat, edges = lists.flatten(), np.asarray(lists.offsets, np.int64)
    edges = edges - edges[0]
    coded = flat.dictionary_encode()
    kinds = coded.dictionary
    hashes = pd.util.hash_array(kinds.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(kinds) else np.zeros(0, np.uint64)
    words = hashes.astype(np.uint64)[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    # white space at either end of a text leaves an empty word
    real = np.asarray(pc.not_equal(flat, "")) if len(flat) else np.zeros(0, bool)
    if not real.all():
        kept = np.concatenate([[0], np.cumsum(real)])
        words, edges = words[real], kept[edges]
    return words, edges


def shingles(words: np.ndarray, edges: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and their offsets. A text of fewer words, one at least, has one shingle."""
    counts = np.diff(edges)
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(each)])
    if not len(words):
        return np.zeros(0, np.uint64), ends
    at = np.arange(int(ends[-1])) + np.repeat(edges[:-1] - ends[:-1], each)
    out = np.zeros(len(at), np.uint64)
    short = np.repeat(counts < size, each)
    stop = np.repeat(edges[1:], each)[short]
    for n in range(size):
        term = words[np.minimum(at + n, len(words) - 1)] * MULTIPLIERS[n]
        if short.any():
            term[short] = np.where(at[short] + n < stop, term[short], np.uint64(0))
        out += term
    return mix64(out), ends


def min_hashes(values: np.ndarray, ends: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` minimum hashes for each non-empty set ``values[ends[k]:ends[k + 1]]``; rows of empty sets are 0."""
    factors = mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed << 20)) | np.uint64(1)
    out = np.zeros((len(ends) - 1, count), np.uint64)
    full = np.flatnonzero(np.diff(ends) > 0)
    done = 0
    while done < len(full):
        # parts that stay in the processor's cache
        last = max(done + 1, int(np.searchsorted(ends[full + 1], ends[full[done]] + (1 << 16), side="right")))
        rows = full[done:last]
        low = ends[rows[0]]
        part = values[low:ends[rows[-1] + 1]]
        starts = ends[rows] - low
        for n in range(count):
            out[rows, n] = np.minimum.reduceat((part * factors[n]) >> np.uint64(16), starts)
        done = last
    return out
