"""Exact dedup: local combining, salted merge, global merge; the full text is compared at every stage."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize, spare

SALTS = 16


def _combine(df: DataFrame, digest: str, text: str, salt: str, salts: int, first: list[Column], again: list[Column]) -> DataFrame:
    """One row for each (digest, text). Grouping by the text itself compares whole contents, never digests alone.

    The partial aggregate of the first grouping is the local stage: a task passes on one row of each text. Its salt is
    the task, so the copies of one hot text from many tasks meet in ``salts`` reducers before one reducer sees them.
    """
    salted = df.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(salts)))
    return salted.groupBy(salt, digest, text).agg(*first).groupBy(digest, text).agg(*again)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The group of every row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after no change; a null text counts as empty. The largest id of a group stays.
    Rows that repeat the id of the winner are all reported as kept (``exact_dedup`` returns one of them); in a group
    whose ids are all null, ``keep_id`` is null. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    # only the small part of the groups is kept; texts stay behind once they have been compared
    groups = materialize(_combine(rows, "digest", "body", "salt", salts,
                                  [F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")],
                                  [F.max("keep").alias("keep"), F.sum("n").alias("n")]).select("digest", "keep", "n"), "groups")
    # two texts behind one digest would show here as two groups; then rows find their group by the text as well
    shared = groups.groupBy("digest").count().filter("count > 1")
    out = ["id", "keep", "n", "digest"]
    if shared.isEmpty():
        joined = rows.select("id", "digest").join(groups, "digest").select(*out)
    else:
        whole = _combine(rows, "digest", "body", "salt", salts, [F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")],
                         [F.max("keep").alias("keep"), F.sum("n").alias("n")])
        joined = rows.join(whole, ["digest", "body"]).select(*out)
    return joined.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
                         F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One whole row of each text, with the columns of ``docs``: the row with the largest id.

    Ties on the id go to the largest of the remaining columns in their order, so repeated rows leave one. A null text
    counts as empty and comes back as it was stored in the winning row. Null ids lose to any id. Columns must be
    orderable (no maps). The row travels with its text, so no join follows.
    """
    body, digest, salt, row = spare(docs, "body", "digest", "salt", "row")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    # the text is a grouping key already; only whether it was null has to travel in the row
    held = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").isNotNull().alias("has_text"),
                                *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(rest)]).alias(row),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(body))
    held = held.withColumn(digest, F.sha2(body, 256))
    best = _combine(held, digest, body, salt, salts, [F.max(row).alias(row)], [F.max(row).alias(row)])
    fields = {c: F.col(f"{row}.c{n}") for n, c in enumerate(rest)}
    fields |= {id_col: F.col(f"{row}.id"), text_col: F.when(F.col(f"{row}.has_text"), F.col(body))}
    return best.select(*[fields[c].alias(c) for c in docs.columns])
