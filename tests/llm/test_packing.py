"""Packing: the plan against its histogram and a plain solver, pieces against the tokenizers library."""
import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from colsmith.llm import packing

SCHEMA = "doc_id string, text string, start int, length string, ids string"


@pytest.mark.parametrize("depth", [2, 3])
def test_combinations_are_all_of_them(depth):
    lengths = [1, 2, 3, 5, 8, 9, 11, 14, 15]
    got = {tuple(n for n in row if n) for row in packing.combinations(np.array(lengths), 16, depth).tolist()}
    want = {c for size in range(2, depth + 1) for c in itertools.combinations_with_replacement(lengths, size) if sum(c) == 16}
    assert got == want


def plain_nnls(matrix, target, steps=20_000):
    """Projected gradient steps until nothing moves."""
    x = np.zeros(matrix.shape[1])
    rate = 1 / np.linalg.norm(matrix, 2) ** 2
    for _ in range(steps):
        x = np.maximum(0, x - rate * matrix.T @ (matrix @ x - target))
    return x


def test_counts_are_least_squares():
    rng = np.random.default_rng(4)
    window = 24
    for _ in range(5):
        histogram = np.concatenate([[0], rng.integers(0, 60, window - 1), [0]])
        parts = packing.combinations(np.flatnonzero(histogram), window)
        matrix = np.zeros((window + 1, len(parts)))
        for n, row in enumerate(parts):
            for length in row[row > 0]:
                matrix[length, n] += 1
        best = plain_nnls(matrix, histogram)
        active, x = packing.repeat_counts(parts, histogram, window)
        mine = np.zeros(len(parts))
        mine[active] = x
        error = lambda v: float(((matrix @ v - histogram) ** 2).sum())
        assert (x >= 0).all() and error(mine) <= 1.02 * error(best) + 1e-3 * float(histogram @ histogram)


def test_plan_never_uses_more_than_there_is():
    rng = np.random.default_rng(5)
    for window, scale in ((64, 5), (64, 5000), (300, 40), (2048, 2)):
        histogram = rng.integers(0, scale, window + 1)
        histogram[[0, window]] = 0
        parts, counts = packing.plan_windows(histogram, window)
        used = np.bincount(parts.ravel(), weights=np.repeat(counts, 3), minlength=window + 1)
        assert (parts.sum(1) == window).all() and (used[1:] <= histogram[1:]).all() and (counts > 0).all()
        assert used[1:].sum() > 0.6 * histogram.sum()
    assert packing.plan_windows(np.zeros(65, np.int64), 64)[1].tolist() == []


def test_greedy_sequences_are_full():
    rng = random.Random(6)
    for _ in range(200):
        window = rng.choice([8, 16, 24])
        lengths = [rng.randint(1, window - 1) for _ in range(rng.randint(0, 30))]
        rows = packing.greedy_pack(lengths, window)
        assert_pieces(rows, dict(enumerate(lengths)), window)


def assert_pieces(rows, sizes, window):
    """Rows of (document, start, length, sequence, offset): each token once, sequences gapless and without padding."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, length, sequence, offset in rows:
        assert length > 0
        by_doc[doc].append((start, length))
        by_sequence[sequence].append((offset, length))
    for spans, total in [(by_doc[d], n) for d, n in sizes.items()] + [(s, None) for s in by_sequence.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total is not None else at == window or (at & (at - 1) == 0 and at < window)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = "the quick brown fox é jumps over a lazy dog 1234 and <|endoftext|> ...\n".split(" ")
    some = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 20, 20, 60, 150, 700]))) for _ in range(200)]
    return [*some, None, None, "", "word " * 30_000, *["same length again"] * 150]


@pytest.mark.parametrize("window,block_ids", [(64, 500), (128, 1 << 20), (48, 3000)])
def test_pieces_equal_the_library(spark, texts, window, block_ids):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(f"id{n}", t, 1, "x", "y") for n, t in enumerate(texts)]
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    pieces = packing.pack_documents(df, window=window, block_ids=block_ids).cache()
    got = pieces.collect()
    assert_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got], {i: len(v) for i, v in want.items()}, window)
    for r in got:
        raw = np.array(want[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert bytes(r.ids) == raw and r.ids_crc32 == zlib.crc32(raw) and r.doc_tokens == len(want[r.doc_id])
    # planned pieces are whole remainders in full windows
    for r in got:
        assert not r.planned or (r.start + r.length == r.doc_tokens and r.length == r.doc_tokens % window)
    assert sum(r.planned for r in got) > 50
    if window & (window - 1) == 0:
        whole = {r.sequence_id: r for r in packing.sequences(pieces, window).collect()}
        for key, parts in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
            assert bytes(whole[key].ids) == b"".join(bytes(p.ids) for p in parts) and len(whole[key].ids) == 4 * whole[key].n_tokens
    pieces.unpersist()


def test_empty_nulls_and_repeats(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = packing.pack_documents(spark.createDataFrame([(None, None, 1, "x", "y"), (None, "", 1, "x", "y"), ("a", "b", 1, "x", "y"), ("a", "b", 1, "x", "y")], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.length, r.doc_tokens) for r in rows) == [("None", 1, 1)] * 2 + [("a", 2, 2)] * 2


def test_sequences_are_padded(spark):
    rows = [("a", 0, 3, 0, 0, b"\x02\0\0\0" * 3), ("b", 0, 2, 0, 3, b"\x03\0\0\0" * 2), ("c", 0, 4, 1, 0, b"\x04\0\0\0" * 4)]
    pieces = spark.createDataFrame(rows, "doc_id string, start long, length long, sequence_id long, offset long, ids binary")
    got = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in packing.sequences(pieces, 8).collect()}
    assert got == {0: [2, 2, 2, 3, 3, 1, 1, 1], 1: [4] * 4}
