"""Four-Russians hard negatives against plain inner products."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsmith.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label string, score long, slot string"


def brute(rows, k=5, low=80, high=100, scale=256):
    used = [(i, label, [math.floor(scale * x) for x in vec]) for i, vec, label, *_ in rows
            if label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    asked = {(i, label, tuple(v)) for i, label, v in used if i is not None and i % 100 == 0}
    for i, label, vec in asked:
        dot = [(sum(a * b for a, b in zip(vec, v)), j, other) for j, other, v in used]
        near = sorted([(s, j) for s, j, other in dot if other == label and j != i], key=rank)[:k]
        for s, j in near:
            far = sorted([(t, x) for t, x, other in dot if other != label and low * s <= 100 * t <= high * s], key=rank)[:k]
            out += [(i, j, n, x, s, t) for n, (t, x) in enumerate(far, 1)]
    return sorted(out, key=repr)


def mined(df, **options):
    return sorted((tuple(r) for r in hn.mine_hard_negatives(df, **options).collect()), key=repr)


@pytest.mark.parametrize("low,high", [(0, 0), (-1, 0), (0, 1), (-159, 153), (-256, 255), (-257, 3), (5, 256), (-7, -7)])
def test_planes_hold_every_number(low, high):
    planes = hn.planes_for(low, high)
    values = np.array([[low, high, 0, low, high]])
    back = hn.unpack_planes(hn.pack_planes(values, planes))
    assert back[0, :5].tolist() == values[0].tolist() and not back[0, 5:].any()
    if planes > 1:
        assert not (-(1 << planes - 2) <= low and high < 1 << planes - 2)


def test_scores_equal_products():
    rng = np.random.default_rng(1)
    for width, size, dtype in ((64, 200, np.int32), (3, 5, np.int64), (17, 1 << 20, np.int64)):
        a, c = rng.integers(-size, size, (9, width)), rng.integers(-size, size, (300, width))
        planes = hn.planes_for(-size, size)
        wide = np.zeros((9, -(-width // 8) * 8), np.int64)
        wide[:, :width] = a
        got = hn.scores(np.ascontiguousarray(hn.pack_planes(c, planes).transpose(1, 2, 0)), hn.subset_sums(wide, dtype))
        assert np.array_equal(got, c @ a.T)


@pytest.mark.parametrize("slot_rows", [70, 1 << 18])
def test_equals_brute_force(spark, slot_rows):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        # many ties, one label with a third of the rows, ragged and unusable vectors, repeated ids
        width = rng.choice([10, 10, 10, 7, 0])
        vec = [rng.choice([-0.5, 0.0, 0.25, 0.7, 1.0]) for _ in range(width)]
        if i % 41 == 0 and vec:
            vec[-1] = rng.choice([None, float("nan"), float("inf"), -float("inf")])
        rows.append((rng.choice([i, i // 2, i - i % 100]), None if i % 53 == 0 else vec, rng.choice(["a", "a", "b", "c", "d", None]), 1, "x"))
    rows += [(100, [1.0] * 10, "a", 1, "x")] * 3 + [(None, [1.0] * 10, "a", 1, "x"), (None, [0.9] * 10, "b", 1, "x"), (200, [0.5] * 10, "only", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mined(df, slot_rows=slot_rows)
    assert got == brute(rows) and len(got) > 100


def test_settings_and_anchors(spark):
    rng = np.random.default_rng(2)
    rows = [(n, [float(x) for x in rng.normal(size=6)], f"l{n % 3}", 1, "x") for n in range(0, 400, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df, positives=2, negatives=3, low=50, high=120, scale=1000) == sorted(
        (r for r in brute_options(rows, 2, 3, 50, 120, 1000)), key=repr)
    assert mined(df, anchor=F.col("vec_id") == -1) == []


def brute_options(rows, positives, negatives, low, high, scale):
    used = [(i, label, [math.floor(scale * x) for x in vec]) for i, vec, label, *_ in rows]
    for i, label, vec in used:
        if i % 100:
            continue
        dot = [(sum(a * b for a, b in zip(vec, v)), j, other) for j, other, v in used]
        for s, j in sorted([(s, j) for s, j, other in dot if other == label and j != i], key=lambda x: (-x[0], x[1]))[:positives]:
            far = sorted([(t, x) for t, x, other in dot if other != label and low * s <= 100 * t <= high * s], key=lambda x: (-x[0], x[1]))
            yield from ((i, j, n, x, s, t) for n, (t, x) in enumerate(far[:negatives], 1))


def test_empty_and_unusable(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(empty) == []
    assert mined(spark.createDataFrame([(100, None, "a", 1, "x"), (200, [1.0], None, 1, "x")], SCHEMA)) == []
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark.createDataFrame([(100, [1e30], "a", 1, "x")], SCHEMA))
