"""Exact linear-interpolated quantiles of any number of columns in a few passes.

The built-in exact ``percentile`` keeps every distinct value of a column in one buffer. Here a
bracket around each wanted rank is narrowed with ``percentile_approx`` until it holds few
enough values for an exact answer, so no buffer grows with the table.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 200_000
_ACCURACY = 2_000
_SLACK = 2.5 / _ACCURACY
_COLUMNS_PER_JOB = 50


def clean_double(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


@dataclass
class _Bracket:
    """A wanted rank, the interval known to hold it and a narrower one to try next."""
    col: str
    rank: int
    frac: float
    low: float
    high: float
    inside: int
    try_low: float
    try_high: float
    below: int = 0
    misses: int = 0
    value: float | None = None


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], small: int = SMALL) -> dict[str, list]:
    out: dict[str, list] = {}
    for i in range(0, len(cols), _COLUMNS_PER_JOB):
        out.update(_solve(df, list(cols[i:i + _COLUMNS_PER_JOB]), list(probs), small))
    return out


def _solve(df: DataFrame, cols: list[str], probs: list[float], small: int) -> dict[str, list]:
    data = df.select(*[clean_double(c).alias(f"x{i}") for i, c in enumerate(cols)])
    around = [p for q in probs for p in (max(0.0, q - _SLACK), min(1.0, q + _SLACK))]
    aggs = []
    for i in range(len(cols)):
        x = F.col(f"x{i}")
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                 F.percentile_approx(x, around, _ACCURACY).alias(f"q{i}")]
    first = data.agg(*aggs).first()
    counts = [first[f"n{i}"] for i in range(len(cols))]
    result: dict[str, list] = {c: [None] * len(probs) for c in cols}

    tiny = [i for i, n in enumerate(counts) if 0 < n <= small]
    if tiny:
        exact = data.agg(*[F.percentile(f"x{i}", probs).alias(f"p{i}") for i in tiny]).first()
        for i in tiny:
            result[cols[i]] = list(exact[f"p{i}"])

    work: list[tuple[int, int, _Bracket]] = []
    for i, n in enumerate(counts):
        if n <= small:
            continue
        for j, q in enumerate(probs):
            at = q * (n - 1)
            rank = min(int(math.floor(at)), n - 1)
            low, high = first[f"q{i}"][2 * j], first[f"q{i}"][2 * j + 1]
            work.append((i, j, _Bracket(f"x{i}", rank, at - rank, first[f"lo{i}"], first[f"hi{i}"], n, low, high)))
    if work:
        _narrow(data, [w[2] for w in work], counts, small)
        for i, j, b in work:
            result[cols[i]][j] = b.value
    return result


_MAX_MISSES = 2


def _narrow(data: DataFrame, brackets: list[_Bracket], counts: list[int], small: int) -> None:
    """Settle every bracket; each round is two or three aggregates for all of them together.

    An interval is only replaced by one that a count has shown to hold the wanted ranks. After
    two misses of the sketch a bracket is halved by value, which always ends.
    """
    open_ = [b for b in brackets if b.value is None]
    while open_:
        # 1. does the tried interval hold the two wanted ranks, and how many different values?
        aggs = []
        for k, b in enumerate(open_):
            x = F.col(b.col)
            inside = F.when(x.between(b.try_low, b.try_high), x)
            aggs += [F.count(F.when(x < b.try_low, 1)).alias(f"b{k}"), F.count(inside).alias(f"i{k}"),
                     F.approx_count_distinct(inside).alias(f"d{k}")]
        seen = data.agg(*aggs).first()
        solid, wide = [], []
        for k, b in enumerate(open_):
            upper = min(b.rank + 1, counts[int(b.col[1:])] - 1)
            below, inside = seen[f"b{k}"], seen[f"i{k}"]
            if below <= b.rank and upper < below + inside:
                b.low, b.high, b.below, b.inside = b.try_low, b.try_high, below, inside
                if b.low == b.high:
                    b.value = b.low
                    continue
                if seen[f"d{k}"] <= small:
                    solid.append((b, upper))
                    continue
            else:
                b.misses += 1
            wide.append((b, upper))
        # 2. few values left: take the two wanted ones exactly
        if solid:
            aggs = []
            for k, (b, upper) in enumerate(solid):
                inside = f"case when {b.col} between {b.low!r}D and {b.high!r}D then {b.col} end"
                # position p of m sorted values is the discrete quantile (p + 0.5) / m
                for tag, rank in (("a", b.rank), ("z", upper)):
                    p = (rank - b.below + 0.5) / b.inside
                    aggs.append(F.expr(f"percentile_disc({p!r}D) within group (order by {inside})").alias(f"{tag}{k}"))
            got = data.agg(*aggs).first()
            for k, (b, _) in enumerate(solid):
                b.value = got[f"a{k}"] + b.frac * (got[f"z{k}"] - got[f"a{k}"])
        # 3. still many values: halve by value (exact), and propose a narrower interval by sketch
        if wide:
            aggs = []
            for k, (b, upper) in enumerate(wide):
                x = F.when(F.col(b.col).between(b.low, b.high), F.col(b.col))
                mid = b.low + (b.high - b.low) / 2
                around = [max(0.0, (b.rank - b.below) / b.inside - _SLACK), min(1.0, (upper + 1 - b.below) / b.inside + _SLACK)]
                aggs += [F.count(F.when(x <= mid, 1)).alias(f"c{k}"), F.max(F.when(x <= mid, x)).alias(f"m{k}"),
                         F.min(F.when(x > mid, x)).alias(f"w{k}")]
                if b.misses < _MAX_MISSES:
                    aggs.append(F.percentile_approx(x, around, _ACCURACY).alias(f"q{k}"))
            got = data.agg(*aggs).first()
            for k, (b, upper) in enumerate(wide):
                upto_mid = b.below + got[f"c{k}"]
                if upto_mid > upper:
                    b.high, b.inside = got[f"m{k}"], got[f"c{k}"]
                elif upto_mid <= b.rank:
                    b.low, b.below, b.inside = got[f"w{k}"], upto_mid, b.inside - got[f"c{k}"]
                else:                   # the midpoint parts the two wanted values
                    b.value = got[f"m{k}"] + b.frac * (got[f"w{k}"] - got[f"m{k}"])
                b.try_low, b.try_high = b.low, b.high
                if b.misses < _MAX_MISSES:
                    low, high = got[f"q{k}"]
                    b.try_low, b.try_high = max(b.low, low), min(b.high, high)
        open_ = [b for b in open_ if b.value is None]


def value_at_rank(df: DataFrame, col: str, rank: int, small: int = SMALL) -> float | None:
    """The value at a 0-based rank of the non-null values of one column."""
    data = df.select(clean_double(col).alias("x0"))
    x = F.col("x0")
    ends = data.agg(F.count(x).alias("n0"), F.min(x).alias("lo0"), F.max(x).alias("hi0")).first()
    n = ends["n0"]
    if not 0 <= rank < n:
        return None
    low, high = data.agg(F.percentile_approx(x, [max(0.0, rank / n - _SLACK), min(1.0, (rank + 2) / n + _SLACK)],
                                             _ACCURACY)).first()[0]
    bracket = _Bracket("x0", rank, 0.0, ends["lo0"], ends["hi0"], n, low, high)
    _narrow(data, [bracket], [n], small)
    return bracket.value
