"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Each source's weight schedule is integrated to a cumulative demand curve; a document copy that covers the source's
tokens c..c+size is due when that curve reaches its middle. Inverting the curve gives its training position in 0..1,
and documents are range-sorted by it.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, spare

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: Weight over training time as (time, weight) points with straight lines between; one per entry of WEIGHTS. Only the
#: shape counts: the first sources fade out, the last ones come in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
MAX_REPEATS = 3
#: Slices of each source's order, so that no window holds a whole source: 16 ** SLICE_DIGITS.
SLICE_DIGITS = 3


def _segments(schedule) -> list[tuple[float, float, float, float, float]]:
    """(start, length, weight at start, slope, demand before) of each stretch; demand runs from 0 to 1."""
    points = [(float(t), float(w)) for t, w in schedule]
    if len(points) < 2 or points[0][0] != 0.0 or points[-1][0] != 1.0 or any(w < 0 for _, w in points):
        raise ValueError("a schedule runs from time 0 to 1 with weights of 0 or more")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    if area <= 0 or any(b[0] <= a[0] for a, b in zip(points, points[1:])):
        raise ValueError("times of a schedule must rise and its weights must not all be 0")
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(points, points[1:]):
        out.append((t0, t1 - t0, w0 / area, (w1 - w0) / area / (t1 - t0), before))
        before += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def invert_demand(share: Column, schedule) -> Column:
    """The time at which the integrated ``schedule`` reaches ``share`` (0 to 1) of its demand."""
    segments = _segments(schedule)
    out = None
    for n, (start, length, weight, slope, before) in enumerate(segments):
        # w x + slope x^2 / 2 = share - before, solved in the form that stays exact for a slope of 0
        due = share - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(weight) * F.lit(weight) + F.lit(2.0 * slope) * due))
        x = F.when(F.lit(weight) + root > 0, F.lit(2.0) * due / (F.lit(weight) + root)).otherwise(F.lit(0.0))
        time = F.lit(start) + F.least(F.lit(length), x)
        last = n == len(segments) - 1
        ends = 1.0 if last else segments[n + 1][4]
        out = F.when(share <= ends, time) if out is None else (out.otherwise(time) if last else out.when(share <= ends, time))
    return out.otherwise(F.lit(1.0)) if len(segments) == 1 else out


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source_size`` by ``source`` -> one row per source with ``rank`` (from 0), ``weight`` and ``target``.

    Sources by code point, null last, take ``weights`` in turn. Targets share the whole size by weight; a target stops
    at ``max_repeats`` times its source, and the excess is shared again by weight. The fixed point in closed form:
    sources are full in the order of limit / weight, and the first k are full where sharing the rest among the others
    first fills no further one. One row per source goes through these windows.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(ordered) - 1).withColumn("weight", turn)
    limit = F.col("source_size") * max_repeats
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("fills_at"), F.col("rank"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("fills_at", limit / F.col("weight"))
    s = s.withColumn("full_before", F.coalesce(F.sum(limit).over(before), F.lit(0)))
    s = s.withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.col("full_before")) / F.col("weight_left"))
    # levels rise up to the first where no further source fills up and fall after it; all are full only where everything is 0
    s = s.withColumn("settled", F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(everything))
    target = F.least(F.col("settled") * F.col("weight"), limit.cast("double"))
    return s.select("source", "source_size", "rank", "weight", F.coalesce(target, limit.cast("double")).alias("target"))


def assign_positions(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id",
                     text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """``docs`` with a struct ``mix``: size, source_size, target, copies, taken and positions (one per copy, rising).

    A source's documents are laid end to end in the order of a hash of id, text and seed, as often as the target asks,
    ``max_repeats`` times at most; a copy is taken whole when its middle lies within the target. A text without words
    (or null) has size 0 and is taken once at most, with 0 words. Null sources are one source, ranked last. Rows that
    repeat an id count as documents of their own. Reruns agree: the order is a function of the rows, and rows equal in it
    hold the same words.
    """
    size, key, order, part, mix = spare(docs, "size", "source_key", "order_key", "slice", "mix")
    # a key without nulls serves the join and the window with one shuffle
    keyed = docs.withColumns({
        size: F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long"),
        key: F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`")), F.lit("n")),
        # the text is part of it, so rows without an id, or that share one, spread over the slices too
        order: F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.lit(":"),
                              F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))),
    }).withColumn(part, F.substring(order, 1, SLICE_DIGITS))

    counted = keyed.groupBy(F.col(key).alias("k"), F.col(part).alias("p")).agg(F.sum(size).alias("in_slice"))
    counted = materialize(counted, "slices")
    sources = counted.groupBy("k").agg(F.sum("in_slice").alias("source_size"))
    named = sources.withColumn("source", F.when(F.col("k") != "n", F.expr("substring(k, 2)")))
    targets = source_targets(named.select("source", "source_size"), weights, max_repeats)
    targets = targets.withColumn("k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    # at most 16 ** SLICE_DIGITS rows of a source
    base = F.coalesce(F.sum("in_slice").over(Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.withColumn("base", base).join(targets, "k").select("k", "p", "base", "source_size", "target", "rank")

    joined = keyed.join(starts, (F.col(key) == F.col("k")) & (F.col(part) == F.col("p")))
    within = Window.partitionBy(key, part).orderBy(order, size).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum(size).over(within), F.lit(0))
    names = spare(docs.select("*", *[F.lit(0).alias(c) for c in (size, key, order, part, mix)]), "start_at", "rounds")
    placed = joined.withColumn(names[0], start)
    middle = lambda e: e * F.col("source_size") * 2 + F.col(names[0]) * 2 + F.col(size)  # noqa: E731  twice the middle, in whole numbers
    wanted = F.filter(F.sequence(F.lit(0), F.lit(max_repeats - 1)),
                      lambda e: (middle(e) <= F.col("target") * 2) & ((e == 0) | (F.col(size) > 0)))
    placed = placed.withColumn(names[1], wanted)
    branch = F.col("rank") % len(schedules)

    def due(e: Column) -> Column:
        share = F.when(F.col("target") > 0, F.least(F.lit(1.0), middle(e) / (F.col("target") * 2))).otherwise(F.lit(0.0))
        out = F.when(branch == 0, invert_demand(share, schedules[0]))
        for n, schedule in enumerate(schedules[1:], 1):
            out = out.when(branch == n, invert_demand(share, schedule))
        return out

    copies = F.size(names[1])
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        F.col(size).alias("size"), F.col("source_size"), F.col("target"), copies.alias("copies"),
        (copies * F.col(size)).alias("taken"), F.transform(names[1], due).alias("positions")).alias(mix))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: one row per taken copy with the columns of ``docs``, range-sorted by training position."""
    placed = assign_positions(docs, **options)
    mix = placed.columns[-1]
    at = spare(placed, "position")[0]
    rows = placed.withColumn(at, F.explode(f"`{mix}`.positions"))
    return rows.orderBy(at).select(*[F.col(f"`{c}`") for c in docs.columns])


def demand_check(schedule, time: float) -> float:
    """Integrated share of ``schedule`` at ``time``; the inverse of ``invert_demand``, for tests and reports."""
    total = 0.0
    for start, length, weight, slope, _ in _segments(schedule):
        x = min(max(time - start, 0.0), length)
        total += weight * x + slope * x * x / 2
    return min(1.0, total) if not math.isnan(total) else 0.0
