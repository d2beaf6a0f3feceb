"""Joining rows to a per-level table when one level may hold a third of all rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LITERAL_LEVELS = 50      # beyond this a hash join beats searching a literal map
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 0.001


def broadcast_fits(n_levels: int, n_values: int, key_bytes: int = 48) -> bool:
    """Whether a level table of counted size stays within the broadcast budget."""
    return n_levels * (key_bytes + 8 * n_values) <= BROADCAST_BYTES


def hot_levels(levels: DataFrame, key: str, count: str, total: int) -> list:
    """Levels with at least ``HOT_SHARE`` of the rows: never more than ``1 / HOT_SHARE``."""
    return [r[0] for r in levels.filter(F.col(count) >= HOT_SHARE * max(total, 1)).select(key).collect()]


def level_lookup(df: DataFrame, levels: DataFrame, key: str, count: str, total: int, small: bool) -> DataFrame:
    """Left join on a unique ``key`` whose table also holds the row ``count`` of each level.

    A small table is broadcast. For a large one only the hot levels are: they are at most a
    thousand, their rows never move, and what is left to shuffle has no key above a thousandth
    of the rows. Splitting by level instead of salting also holds for rows that are all copies
    of one another, which no salt made from row content could part. Null and unseen keys get nulls.
    """
    right = levels.drop(count)
    if small:
        return df.join(F.broadcast(right), key, "left").select(*df.columns, *[c for c in right.columns if c != key])
    hot = hot_levels(levels, key, count, total)
    is_hot = F.col(key).isNull() | F.coalesce(F.col(key).isin(hot), F.lit(False))
    near = df.filter(is_hot).join(F.broadcast(right.filter(F.col(key).isin(hot))), key, "left")
    far = df.filter(~is_hot).join(right.filter(~F.col(key).isin(hot)), key, "left")
    out = [*df.columns, *[c for c in right.columns if c != key]]
    return near.select(*out).unionByName(far.select(*out))
