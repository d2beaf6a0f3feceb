"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

The join covers distinct texts: rows whose lower-case words are the same are one node. Buckets of nodes that share a
band are compared in tiles of bounded size, never as a list of pairs: a tile counts each node's links and passes on a
spanning forest, so a bucket of n nodes in t blocks gives about n t rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, hand_out
from .store import materialize, slices, spare
from .words import min_hashes, mix64, shingles, word_hashes

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
ROWS = 5
#: Shingles of a block; a tile holds two blocks. A larger text is a block by itself.
BLOCK_SHINGLES = 100_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` minimum hashes so that a pair at the threshold shares one with probability ``recall``."""
    if threshold >= 1.0:
        return 1
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows)))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """``id, text_key, digest`` (of the words), ``size`` (shingles with repeats) and ``bands`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                hashed, edges = word_hashes(part.column(2))
                sets, ends = shingles(hashed, edges, words)
                low = min_hashes(sets, ends, bands * rows).reshape(part.num_rows, bands, rows)
                keys = np.zeros((part.num_rows, bands), np.uint64)
                for n in range(rows):
                    keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, :, n])
                raw = hashed.tobytes()
                digests = [xxhash.xxh3_128_digest(raw[8 * a:8 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(np.diff(ends)), lists],
                                                 ["id", "text_key", "digest", "size", "bands"])

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, f"id {kind}, text_key long, digest binary, size long, bands array<long>")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """``digest`` and its set of shingle hashes (rising 64-bit integers as bytes)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                values, ends = shingles(*word_hashes(part.column(1)), words)
                packed = [np.unique(values[a:b]).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["digest", "members"])

    return rows.mapInArrow(run, "digest binary, members binary")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the values that occur twice or more."""
    sizes = np.array([len(s) for s in sets])
    values, kind, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = times > 1
    column = (np.cumsum(often) - 1)[kind]
    held = often[kind]
    owner, column = owner[held], column[held]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    columns = int(often.sum())
    width = min(max(256, (1 << 23) // len(sets)), max(1, columns))
    for first in range(0, columns, width):
        a, b = np.searchsorted(column, [first, first + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        out += block @ block.T
    return out


def _tile(digests: list[bytes], sets: list[np.ndarray], blocks: np.ndarray, weights: np.ndarray, bands: np.ndarray, band: int,
          threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each member: links that this tile counts, and the position of the least member it hangs together with."""
    sizes = np.array([len(s) for s in sets], np.float64)
    shared = shared_counts(sets).astype(np.float64)
    linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if blocks.min() != blocks.max():
        linked &= blocks[:, None] != blocks[None, :]
    # a pair counts where its first common band is, and there only
    for a in range(0, len(sets), 64):
        row, col = np.nonzero(linked[a:a + 64])
        first = (bands[row + a] == bands[col]).argmax(1)
        linked[row + a, col] = first == band
    links = (linked * weights[None, :]).sum(1)
    root = np.arange(len(sets))
    while True:
        near = np.where(linked, root[None, :], len(sets)).min(1)
        after = np.minimum(root, near)
        after = after[after]
        if np.array_equal(after, root):
            return links, root
        root = after


def _tiles(rows: DataFrame, threshold: float) -> DataFrame:
    """``digest, root, links`` of the members of every tile that have links in it."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            digests = [r["digest"] for r in held]
            links, root = _tile(digests, [np.frombuffer(r["members"], np.uint64) for r in held], np.array([r["block"] for r in held]),
                                np.array([r["weight"] for r in held], np.int64), np.array([r["bands"] for r in held]), held[0]["band"], threshold)
            some = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array([digests[n] for n in some], pa.binary()), pa.array([digests[root[n]] for n in some], pa.binary()),
                                               pa.array(links[some], pa.int64())], ["digest", "root", "links"])

        for batch in batches:
            for row in batch.to_pylist():
                now = (row["band"], row["bucket"], row["low"], row["high"])
                if now != key and len(held) > 1:
                    yield close()
                if now != key:
                    key, held = now, []
                held.append(row)
        if len(held) > 1:
            yield close()

    spread = rows.repartition("band", "bucket", "low", "high").sortWithinPartitions("band", "bucket", "low", "high", "digest")
    return spread.mapInArrow(run, "digest binary, root binary, links long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
                 recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """``id, text_key, class_id, links`` of every row.

    ``links``: other rows whose word n-gram set has a Jaccard similarity of ``threshold`` or more, found with
    probability ``recall`` at the threshold and more above it; every counted link is verified on full sets of 64-bit
    shingle hashes. ``class_id``: the least id among the rows that hang together by links. A text of fewer than
    ``words`` words is one shingle; a text without words, or null, links to nothing and is its own class. Null and
    repeated ids stay rows of their own; a class whose ids are all null has none. No candidate is capped.
    """
    bands = choose_bands(threshold, recall, rows)
    signed = materialize(signatures(docs, id_col, text_col, words, bands, rows), "signatures")
    full = signed.filter("size > 0")
    nodes = full.groupBy("digest").agg(F.min(F.struct("id", "text_key")).alias("first"), F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"),
                                       F.max("size").alias("size"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select("digest", "first.id", "first.text_key", "least", "weight", "size", "bands"), "nodes")

    members = nodes.select("digest", "size", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("digest").alias("lo"), F.max("digest").alias("hi"),
        F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y")).filter("n > 1")
    # of buckets with the same members the first band's is enough
    kept = buckets.groupBy("n", "lo", "hi", "x", "y").agg(F.min(F.struct("band", "bucket", "total")).alias("b"))
    kept = kept.select("b.band", "b.bucket", F.ceil(F.col("b.total") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    meeting = materialize(members.select("digest", "band", "bucket").join(kept, ["band", "bucket"]), "meeting")

    wanted = nodes.join(meeting.select("digest").distinct(), "digest").select("digest", "id", "text_key")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text")).alias("d")
    chosen = texts.join(wanted.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.text_key") == F.col("w.text_key")))
    sets = _sets(chosen.select("w.digest", "d.text"), words).dropDuplicates(["digest"])

    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    placed = meeting.withColumn("block", block).join(sets, "digest").join(nodes.select("digest", "weight", "bands"), "digest")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiled = placed.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = materialize(_tiles(tiled.drop("other", "blocks"), threshold), "links")

    counted = found.groupBy("digest").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    joined = nodes.select("digest", "least", "weight").join(counted, "digest", "left").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    # only nodes that stand for more than one row need a class of their own
    joined = joined.filter("weight > 1 or links is not null").withColumn("root", F.coalesce("root", "digest"))
    joined = materialize(joined, "linked")
    classes = joined.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n"))
    info = hand_out(joined, classes, "root", joined.count()).select("digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    out = signed.filter("size > 0").select("id", "text_key", "digest").join(info, "digest", "left")
    out = out.select("id", "text_key", F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                     F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return out.unionByName(signed.filter("size = 0").select("id", "text_key", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: the one with the largest id (then text hash); all columns stay.

    Rows of equal id and text count as one document. Classes are those of ``near_classes``.
    """
    linked = materialize(near_classes(docs, id_col, text_col, **options).filter("links > 0"), "classes")
    best = linked.groupBy("class_id").agg(F.max(F.struct("id", "text_key")).alias("best"), F.count(F.lit(1)).alias("n"))
    losers = hand_out(linked, best, "class_id", linked.count()).filter(~F.struct("id", "text_key").eqNullSafe(F.col("best")))
    losers = losers.select(F.col("id").alias("lost_id"), F.col("text_key").alias("lost_key")).distinct()
    key, lost_id, lost_key = spare(docs, "text_key", "lost_id", "lost_key")
    losers = losers.select(F.col("lost_id").alias(lost_id), F.col("lost_key").alias(lost_key))
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{text_col}`")))
    kept = keyed.join(losers, F.col(f"`{id_col}`").eqNullSafe(F.col(lost_id)) & (F.col(key) == F.col(lost_key)), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
