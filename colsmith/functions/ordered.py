"""Order-dependent columns without a single-task window.

``Window.orderBy`` without a partition key runs in one task, and with a key a hot key does.
Here the rows are cut into ranges of the full order key (entity first, then order columns),
so a hot entity is spread over many ranges. Each range is scanned by its own window and the
state that crosses a range boundary (previous row, running sums, last non-null value, size of
the entity) is worked out from a table of at most two rows per range.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_table
from .lookup import BROADCAST_BYTES

ROWS_PER_RANGE = 250_000
COARSE_RANGES = 1024        # bounds held as literals; finer ones are a table
SAMPLE_PER_RANGE = 16
_FANOUT = 64
_STEP = 8                   # bounds compared at each level of a search


def _sort_key(row) -> tuple:
    # Spark order: nulls first, NaN last
    out = []
    for v in row:
        if v is None:
            out.append((0, 0))
        elif isinstance(v, float) and math.isnan(v):
            out.append((2, 0))
        else:
            out.append((1, v))
    return tuple(out)


def split_points(df: DataFrame, keys: Sequence[str], rows_per_range: int = ROWS_PER_RANGE, rows: int | None = None,
                 most: int = COARSE_RANGES) -> list[tuple]:
    """At most ``most - 1`` upper-exclusive bounds that cut the key space into about equal ranges.

    Bounds only steer balance; any bounds give the same result. The sample that reaches the
    driver holds about ``SAMPLE_PER_RANGE`` keys per range whatever the table size.
    """
    rows = df.select(*keys).count() if rows is None else rows
    parts = min(most, math.ceil(rows / rows_per_range))
    if parts <= 1:
        return []
    share = min(1.0, parts * SAMPLE_PER_RANGE / rows)
    picked = sorted((tuple(r) for r in df.select(*keys).sample(fraction=share, seed=17).collect()), key=_sort_key)
    step = max(1, len(picked) // parts)
    bounds: list[tuple] = []
    for candidate in picked[step::step]:
        if not bounds or _sort_key(candidate) != _sort_key(bounds[-1]):
            bounds.append(candidate)
    return bounds


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def range_id(df: DataFrame, keys: Sequence[str], bounds: Sequence[tuple]) -> Column:
    """Number of bounds not above the row key, by a search in steps of ``_STEP`` over nested literal arrays."""
    types = [df.schema[k].dataType for k in keys]

    def literal(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(values, types))])

    n, depth = len(bounds), 1
    while _STEP ** depth < n:
        depth += 1
    spans = [_STEP ** (depth - 1 - k) for k in range(depth)]

    def heads(level: int, lo: int = 0, at: int = 0) -> Column:
        """Last bound of each part of a level, nested by the parts of the levels above it."""
        starts = range(lo, min(n, lo + _STEP * spans[at]), spans[at])
        if at == level:
            return F.array(*[literal(bounds[min(i + spans[at], n) - 1]) for i in starts])
        return F.array(*[heads(level, i, at + 1) for i in starts])

    def find(key: Column, level: int, path: list[Column]) -> Column:
        array = heads(level)
        for i in path:
            array = F.get(array, i)
        # beyond the last bound there is no part to look into
        here = F.greatest(F.coalesce(F.size(F.filter(array, lambda b: b <= key)), F.lit(0)), F.lit(0))
        if level + 1 == depth:
            return F.least(sum((i * s for i, s in zip(path, spans)), here), F.lit(n))
        return _bound(here, lambda i: find(key, level + 1, [*path, i]))

    return _bound(_key(keys), lambda key: find(key, 0, [])) if n else F.lit(0)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_range(df: DataFrame, keys: Sequence[str], bounds: Sequence[tuple], name: str) -> DataFrame:
    """``df`` with ``range_id`` as column ``name``, by halving: for whole tables.

    Each level is a column of its own, so that the search is compiled and works out each comparison once; functions of
    array elements are interpreted. A level's literals are the bounds in the middle of the parts that are left.
    """
    if not bounds:
        return df.withColumn(name, F.lit(0))
    types = [df.schema[k].dataType for k in keys]

    def literal(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(values, types))])

    out = df.withColumn("__key", _key(keys))
    path, half = F.lit(0), 1 << (len(bounds).bit_length() - 1)
    while half:
        middles = F.array(*[literal(b) for b in bounds[half - 1::2 * half]])
        # beyond the last bound there is none to be above
        out = out.withColumn("__at", path * 2 + F.when(F.get(middles, path) <= F.col("__key"), 1).otherwise(0))
        path, half = F.col("__at"), half >> 1
    return out.select(*[F.col(f"`{c}`") for c in df.columns], path.alias(name))


@dataclass(frozen=True)
class RangeCut:
    """Ranges of the order of ``keys``. One cut serves every frame that holds these columns."""
    keys: tuple[str, ...]
    bounds: tuple[tuple, ...] = ()
    fine: str | None = None     # path of the finer bounds of each coarse range
    ranges: int = 1

    def mark(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the range of each row, a long that rises with the order of the keys."""
        if not self.bounds:
            return df.withColumn(name, F.lit(0).cast("long"))
        coarse = with_range(df, self.keys, self.bounds, "__coarse")
        if self.fine is None:
            return coarse.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__coarse").cast("long").alias(name))
        table = df.sparkSession.read.parquet(self.fine)
        joined = coarse.join(F.broadcast(table), "__coarse", "left")
        key = _key(self.keys)
        full = F.size(F.filter("__heads", lambda b: b <= key))
        last = F.coalesce(F.size(F.filter(F.get(F.col("__chunks"), full), lambda b: b <= key)), F.lit(0))
        inside = F.when(F.col("__heads").isNull(), 0).otherwise(full * _FANOUT + F.greatest(last, F.lit(0)))
        place = F.col("__coarse").cast("long") * (1 << 32) + inside
        return joined.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name))


def range_cut(df: DataFrame, keys: Sequence[str], rows_per_range: int = ROWS_PER_RANGE, coarse: int = COARSE_RANGES) -> RangeCut:
    """Cut the order of ``keys`` into ranges of about ``rows_per_range`` rows.

    Up to ``coarse`` ranges are literals. Beyond that each of them is cut again in Spark, from a sample of its own
    rows, and the bounds are a stored table that is broadcast: ranges grow with the table only where their bounds
    would pass the broadcast budget (about two million ranges of a 32-byte key).
    """
    rows = df.select(*keys).count()
    bounds = tuple(split_points(df, keys, rows_per_range, rows, coarse))
    parts = math.ceil(rows / rows_per_range)
    if parts <= coarse or not bounds:
        return RangeCut(tuple(keys), bounds, None, len(bounds) + 1)
    width = max(sum(len(v.encode()) if isinstance(v, str) else len(v) if isinstance(v, bytes) else 8 for v in b) + 16 for b in bounds)
    parts = max(coarse, min(parts, BROADCAST_BYTES // width))
    share = min(1.0, parts * SAMPLE_PER_RANGE / rows)
    sample = df.select(*keys).sample(fraction=share, seed=19)
    # about SAMPLE_PER_RANGE * parts / coarse keys in a group
    held = sample.select(range_id(df, keys, bounds).alias("__coarse"), _key(keys).alias("k")).groupBy("__coarse").agg(F.sort_array(F.collect_set("k")).alias("s"))
    step = F.lit(SAMPLE_PER_RANGE)
    picked = held.withColumn("b", F.filter("s", lambda _, i: (i > 0) & (i % step == 0))).filter(F.size("b") > 0)
    chunk = F.transform(F.sequence(F.lit(0), F.floor((F.size("b") - 1) / _FANOUT).cast("int")), lambda i: F.slice("b", i * _FANOUT + 1, _FANOUT))
    nested = picked.select("__coarse", chunk.alias("__chunks"))
    table = nested.select("__coarse", F.transform("__chunks", lambda c: F.element_at(c, -1)).alias("__heads"), "__chunks")
    path = shared_table(table, "ranges")
    finer = df.sparkSession.read.parquet(path).agg(F.sum(F.aggregate("__chunks", F.lit(0), lambda n, c: n + F.size(c)))).first()[0] or 0
    return RangeCut(tuple(keys), bounds, path, len(bounds) + 1 + finer)


def ordered_scan(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    lag: Mapping[str, str | Column] | None = None,
    running: Mapping[str, str | Column] | None = None,
    fill: Mapping[str, str | Column] | None = None,
    row_number: str | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    size: str | None = None,
    cut: RangeCut | None = None,
    marked: bool = False,
) -> DataFrame:
    """Add previous-row values, running sums, forward fills, row numbers and the row count of the entity (``size``).

    ``order_by`` must be a total order inside each ``partition_by`` group. A ``cut`` made before by ``range_cut`` over
    ``partition_by`` and ``order_by`` saves the two jobs that make one. ``marked`` keeps the columns ``__rg, __ent`` in the
    result; a further scan of such a frame with the same cut sorts and shuffles no row again.
    """
    lag, running, fill = dict(lag or {}), dict(running or {}), dict(fill or {})
    keys = [*partition_by, *order_by]
    cut = cut or range_cut(df, keys, rows_per_range)
    if list(cut.keys) != keys:
        raise ValueError(f"the ranges are cut by {list(cut.keys)}, not by {keys}")

    def as_col(c: str | Column) -> Column:
        return F.col(c) if isinstance(c, str) else c

    inputs = {**{f"__l_{o}": as_col(c) for o, c in lag.items()},
              **{f"__s_{o}": as_col(c) for o, c in running.items()},
              **{f"__f_{o}": as_col(c) for o, c in fill.items()}}
    entity = F.struct(*partition_by) if partition_by else F.struct(F.lit(0).alias("all"))
    if "__rg" not in df.columns:
        df = cut.mark(df, "__rg").withColumn("__ent", entity)
    rows = df.select("*", *[c.alias(n) for n, c in inputs.items()])
    window = Window.partitionBy("__rg", "__ent").orderBy(*order_by)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = [F.row_number().over(window).alias("__rn")]
    local += [F.lag(f"__l_{o}").over(window).alias(f"__wl_{o}") for o in lag]
    local += [F.sum(f"__s_{o}").over(upto).alias(f"__ws_{o}") for o in running]
    local += [F.last(f"__f_{o}", ignorenulls=True).over(upto).alias(f"__wf_{o}") for o in fill]
    if size:
        local.append(F.count(F.lit(1)).over(Window.partitionBy("__rg", "__ent")).alias("__wn"))
    scanned = rows.select("*", *local)

    several = cut.ranges > 1
    if several:
        carry = _carry_table(rows, order_by, lag, running, fill, cut.fine is not None)
        # beyond the budget both sides meet on the window's own partitioning
        state_bytes = 2 * cut.ranges * (48 + 16 * (len(inputs) + len(partition_by)))
        scanned = scanned.join(F.broadcast(carry) if state_bytes <= BROADCAST_BYTES else carry, ["__rg", "__ent"], "left")
    names = [c for c in df.columns if marked or c not in ("__rg", "__ent")]
    out = [F.col(f"`{c}`") for c in names]
    for o in lag:
        first = F.col(f"__cl_{o}.v") if several else F.lit(None)
        out.append(F.when(F.col("__rn") == 1, first).otherwise(F.col(f"__wl_{o}")).alias(o))
    for o in running:
        here = F.col(f"__ws_{o}")
        out.append((F.coalesce(here + F.col(f"__cs_{o}"), here, F.col(f"__cs_{o}")) if several else here).alias(o))
    for o in fill:
        here = F.col(f"__wf_{o}")
        out.append((F.coalesce(here, F.col(f"__cf_{o}")) if several else here).alias(o))
    if row_number:
        n = F.col("__rn").cast("long")
        out.append((n + F.coalesce(F.col("__cn"), F.lit(0)) if several else n).alias(row_number))
    if size:
        out.append((F.coalesce("__size", "__wn") if several else F.col("__wn")).alias(size))
    return scanned.select(*out)


def _carry_table(rows: DataFrame, order_by, lag, running, fill, blocks: bool) -> DataFrame:
    """State that enters a range, and the rows in all, of the entities that reach over a range's end.

    Such an entity is the first or the last of every range it lies in, so two rows a range tell all. Their states are
    added up by a window of each entity; with ``blocks`` within the ranges of a coarse range first, then over coarse ranges.
    """
    order = F.struct(*order_by)
    aggs = [F.count(F.lit(1)).alias("__cn")]
    aggs += [F.max_by(F.struct(F.col(f"__l_{o}").alias("v")), order).alias(f"__cl_{o}") for o in lag]
    aggs += [F.sum(f"__s_{o}").alias(f"__cs_{o}") for o in running]
    aggs += [F.max_by(f"__f_{o}", F.when(F.col(f"__f_{o}").isNotNull(), order)).alias(f"__cf_{o}") for o in fill]
    per_entity = rows.groupBy("__rg", "__ent").agg(*aggs)
    state = [c for c in per_entity.columns if c.startswith("__c")]
    whole = F.struct("__ent", *state)
    ends = per_entity.groupBy("__rg").agg(F.min_by(whole, "__ent").alias("first"), F.max_by(whole, "__ent").alias("last"))
    alone = F.col("first.__ent").eqNullSafe(F.col("last.__ent"))
    ends = ends.select("__rg", F.explode(F.when(alone, F.array("first")).otherwise(F.array("first", "last"))).alias("e")).select("__rg", "e.*")
    sums = [c for c in state if c == "__cn" or c.startswith("__cs_")]

    def merged(c: str) -> Column:
        return F.sum(c) if c in sums else F.last(c, ignorenulls=True)

    entity = Window.partitionBy("__ent")
    past = (Window.unboundedPreceding, -1)
    if not blocks:
        before = entity.orderBy("__rg").rowsBetween(*past)
        return ends.select("__rg", "__ent", *[merged(c).over(before).alias(c) for c in state], F.sum("__cn").over(entity).alias("__size"))
    ends = ends.withColumn("__block", F.shiftright("__rg", 32))
    before = Window.partitionBy("__ent", "__block").orderBy("__rg").rowsBetween(*past)
    inside = ends.select("__rg", "__ent", "__block", *[merged(c).over(before).alias(c) for c in state])
    totals = ends.groupBy("__ent", "__block").agg(
        *[F.sum(c).alias(c) if c in sums else F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__rg"))).alias(c) for c in state])
    earlier = entity.orderBy("__block").rowsBetween(*past)
    totals = totals.select("__ent", "__block", *[merged(c).over(earlier).alias(f"__b{c}") for c in state], F.sum("__cn").over(entity).alias("__size"))

    def added(c: str) -> Column:
        here, there = F.col(c), F.col(f"__b{c}")
        return F.coalesce(here + there, here, there) if c in sums else F.coalesce(here, there)

    return inside.join(totals, ["__ent", "__block"]).select("__rg", "__ent", *[added(c).alias(c) for c in state], "__size")


def average_ranks(df: DataFrame, value: str, partition_by: Sequence[str] = (), out: str = "avg_rank",
                  count: str = "n", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Average rank of each distinct value, from a table of distinct values and their counts."""
    cum = ordered_scan(df, [value], partition_by, running={"__cum": count}, rows_per_range=rows_per_range)
    rank = F.col("__cum") - F.col(count) + (F.col(count) + 1) / 2
    return cum.select(*df.columns, rank.alias(out))
