"""Connected components of an edge table, by rounds of joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


HOT_SHARE = 0.001
HOT_ROWS = 256


def hand_out(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` (``total`` of them) with ``table``, which has one row for each ``key`` and their number there as ``n``; null keys meet.

    Keys of many rows are broadcast, so those rows stay where they are; by their definition there are at most
    a few times ``1 / HOT_SHARE`` of them. What is shuffled has no key above that share, or ``HOT_ROWS`` rows.
    """
    limit = max(HOT_ROWS, HOT_SHARE * total)
    right = table.withColumnRenamed(key, "__key")
    hot = F.broadcast(right.filter(F.col("n") >= limit))
    same = F.col(key).eqNullSafe(F.col("__key"))
    near = rows.join(hot.drop("n"), same).drop("__key")
    far = rows.join(F.broadcast(right.filter(F.col("n") >= limit).select("__key")), same, "left_anti")
    return near.union(far.join(right.filter(F.col("n") < limit).drop("n"), same).drop("__key"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the least node of its component.

    Each round hooks a node's neighbours to the least node around it (large star), then again only among smaller ones
    (small star), until no edge changes; the number of rounds grows with the logarithm of the graph. A hub's edges are
    reduced to one minimum by partial aggregates, which is handed out to the edges where they are.
    """
    current = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    state = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")))
    counts = current.agg(*state).first()
    while True:
        both = current.union(current.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = hand_out(both.filter("b > a"), least, "a", 2 * counts[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = materialize(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"), "edges")
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = hand_out(down, least, "a", counts[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        current, before, counts = after, counts, after.agg(*state).first()
        if tuple(before) == tuple(counts):
            break
    rooted = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.union(rooted.select("root", "root")).distinct()
