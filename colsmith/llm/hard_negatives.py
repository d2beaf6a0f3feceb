"""Hard-negative mining with exact Four-Russians scores.

Components are whole numbers. A candidate is stored as bit planes: for each plane and each group of eight dimensions one
byte that holds the group's bits. An anchor gets a table of its 256 subset sums for each group. A score is then read
without any product: look up each byte in its group's table, add the groups of a plane, shift by the plane and add; the
highest plane is subtracted (two's complement). The sums are whole numbers, so every score is exact.

Candidates are dealt evenly into slots of bounded size. The anchors, one row in a hundred, are sent to every slot and
stream past the slot's candidates, so neither a label nor a vector that is very common makes a task larger. A slot passes
on the few best rows of each anchor only.
"""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

GROUP = 8
SCALE = 256
#: Candidates of a slot at most (a task holds one slot), and the fewest for which a further slot pays.
SLOT_ROWS = 1 << 18
LEAST_ROWS = 1 << 10
#: Anchors whose tables are kept at once, and candidates scored against them at once.
ANCHORS = 64
CHUNK = 1024


# ---- bit planes and subset sums --------------------------------------------------------------------------------------

def planes_for(low: int, high: int) -> int:
    """Bits of a two's complement number that holds every whole number from ``low`` to ``high``."""
    return 1 + max(max(high, 0).bit_length(), max(-low - 1, 0).bit_length())


def pack_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Whole numbers (rows, dimensions) as bytes (rows, planes, groups); missing dimensions of the last group are 0."""
    rows, width = values.shape
    groups = -(-width // GROUP)
    wide = np.zeros((rows, groups * GROUP), np.int64)
    wide[:, :width] = values
    out = np.empty((rows, planes, groups), np.uint8)
    for b in range(planes):
        out[:, b] = np.packbits(((wide >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def unpack_planes(packed: np.ndarray) -> np.ndarray:
    """The whole numbers (rows, groups * 8) of packed planes."""
    rows, planes, groups = packed.shape
    out = np.zeros((rows, groups * GROUP), np.int64)
    for b in range(planes):
        bits = np.unpackbits(np.ascontiguousarray(packed[:, b]), axis=1, bitorder="little").astype(np.int64) << b
        out += -bits if b == planes - 1 else bits
    return out


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """Sums over all subsets of each group's eight components: (groups, 256, anchors)."""
    count, width = anchors.shape
    parts = anchors.reshape(count, width // GROUP, GROUP).transpose(1, 2, 0).astype(dtype)
    sums = np.zeros((width // GROUP, 1 << GROUP, count), dtype)
    for bit in range(GROUP):
        sums[:, 1 << bit: 2 << bit] = sums[:, : 1 << bit] + parts[:, bit: bit + 1]
    return sums


def scores(packed: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Inner products (candidates, anchors) by lookups; ``packed`` has the candidates' bytes as (planes, groups, rows)."""
    planes, groups, rows = packed.shape
    total = np.zeros((rows, sums.shape[2]), sums.dtype)
    found = np.empty_like(total)
    part = np.empty_like(total)
    for b in range(planes):
        part[:] = 0
        for g in range(groups):
            np.take(sums[g], packed[b, g], axis=0, out=found, mode="clip")
            part += found
        part <<= b
        if b == planes - 1:
            total -= part
        else:
            total += part
    return total


class Best:
    """The ``k`` highest scores of each list; ties go to the earlier position. Positions must be offered in rising order."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.score = np.full((lists, k), np.iinfo(np.int64).min)
        self.at = np.full((lists, k), -1, np.int64)

    def bar(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, lists: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        touched = np.unique(lists)
        held_lists = np.repeat(touched, self.k)
        held = self.at[touched].ravel()
        real = held >= 0
        lists = np.concatenate([held_lists[real], lists])
        score = np.concatenate([self.score[touched].ravel()[real], score.astype(np.int64)])
        at = np.concatenate([held[real], at])
        order = np.lexsort((at, -score, lists))
        lists, score, at = lists[order], score[order], at[order]
        first = np.concatenate([[True], lists[1:] != lists[:-1]])
        rank = np.arange(len(lists)) - np.maximum.accumulate(np.where(first, np.arange(len(lists)), 0))
        kept = rank < self.k
        self.score[lists[kept], rank[kept]] = score[kept]
        self.at[lists[kept], rank[kept]] = at[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists, rank = np.nonzero(self.at >= 0)
        return lists, self.score[lists, rank], self.at[lists, rank]


def steps(first: int, last: int) -> Iterator[tuple[int, int]]:
    """Parts of a range that start small, so that bars are high before most rows are offered."""
    size = 32
    while first < last:
        yield first, min(last, first + size)
        first, size = first + size, min(CHUNK, size * 2)


# ---- one slot --------------------------------------------------------------------------------------------------------

def _bytes_of(column: pa.Array, planes: int, groups: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column) or not groups:
        return np.zeros((len(column), planes, groups), np.uint8)
    size = planes * groups
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start: start + size * len(column)].reshape(len(column), planes, groups)


class Slot:
    """The candidates of a slot, in the order in which ties are broken."""

    def __init__(self, parts: list[pa.RecordBatch], planes: int, groups: int, dtype, by_label: bool):
        table = pa.Table.from_batches(parts).select(["id", "label", "planes"])
        keys = [("label", "ascending")] * by_label + [("id", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end")).combine_chunks()
        self.ids = table["id"].combine_chunks()
        coded = table["label"].combine_chunks().dictionary_encode()
        self.labels, self.kinds = coded.indices.to_numpy(), coded.dictionary
        self.packed = np.ascontiguousarray(_bytes_of(table["planes"], planes, groups).transpose(1, 2, 0))
        self.planes, self.groups, self.dtype, self.by_label = planes, groups, dtype, by_label

    def codes(self, anchors: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels of the anchors as codes of this slot (-1: none of its), and ids of candidates and anchors as common codes."""
        labels = pc.fill_null(pc.index_in(anchors["label"], value_set=self.kinds), -1).to_numpy(zero_copy_only=False)
        both = pa.concat_arrays([self.ids, anchors["id"]]).dictionary_encode().indices
        return labels, pc.fill_null(both[: len(self.ids)], -1).to_numpy(zero_copy_only=False), pc.fill_null(both[len(self.ids):], -2).to_numpy(zero_copy_only=False)

    def blocks(self, anchors: pa.RecordBatch, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, int]]]:
        """Rows of some anchors, their tables and the range of candidates they meet: those of their label, or all."""
        values = unpack_planes(_bytes_of(anchors["planes"], self.planes, self.groups))
        order = np.argsort(labels, kind="stable")
        done = 0
        while done < len(order):
            until = min(len(order), done + ANCHORS)
            span = (0, len(self.labels))
            if self.by_label:
                label = labels[order[done]]
                until = min(until, int(np.searchsorted(labels[order], label, side="right")))
                # codes are given in the order of first appearance, so they rise along the sorted rows
                span = tuple(np.searchsorted(self.labels, [label, label + 1]).tolist()) if label >= 0 else (0, 0)
            rows = order[done:until]
            yield rows, subset_sums(values[rows], self.dtype), span
            done = until

    def positives(self, anchors: pa.RecordBatch, k: int) -> pa.RecordBatch:
        labels, own, asked = self.codes(anchors)
        out = []
        for rows, sums, (first, last) in self.blocks(anchors, labels):
            best = Best(len(rows), k)
            for a, b in steps(first, last):
                found = scores(self.packed[:, :, a:b], sums)
                at, lists = np.nonzero((found > best.bar()) & (own[a:b, None] != asked[rows]))
                if len(at):
                    best.offer(lists, found[at, lists], at + a)
            lists, score, at = best.rows()
            out.append((rows[lists], score, at))
        rows, score, at = (np.concatenate([o[n] for o in out]) if out else np.zeros(0, np.int64) for n in range(3))
        return pa.RecordBatch.from_arrays([anchors["a"].take(pa.array(rows)), self.ids.take(pa.array(at)), pa.array(score.astype(np.int64))], ["a", "id", "score"])

    def negatives(self, anchors: pa.RecordBatch, k: int, low: int, high: int) -> pa.RecordBatch:
        labels, _, _ = self.codes(anchors)
        bars = anchors["bars"]
        sizes = pc.list_value_length(bars).to_numpy()
        width = int(sizes.max(initial=0))
        firsts = np.cumsum(sizes) - sizes
        flat = bars.flatten().to_numpy()
        out = []
        for rows, sums, (first, last) in self.blocks(anchors, labels):
            bar = np.zeros((width, len(rows)), np.int64)
            floor, roof = np.ones_like(bar), np.zeros_like(bar)
            for n in range(width):
                has = np.flatnonzero(sizes[rows] > n)
                bar[n, has] = flat[firsts[rows[has]] + n]
                floor[n, has] = -((-low * bar[n, has]) // 100)
                roof[n, has] = (high * bar[n, has]) // 100
            best = Best(width * len(rows), k)
            for a, b in steps(first, last):
                found = scores(self.packed[:, :, a:b], sums)
                other = self.labels[a:b, None] != labels[rows]
                for n in range(width):
                    least = np.maximum(best.bar()[n * len(rows):(n + 1) * len(rows)], floor[n] - 1)
                    at, lists = np.nonzero((found > least) & (found <= roof[n]) & other)
                    if len(at):
                        best.offer(lists + n * len(rows), found[at, lists], at + a)
            lists, score, at = best.rows()
            out.append((rows[lists % len(rows)], bar.ravel()[lists], score, at))
        rows, bar, score, at = (np.concatenate([o[n] for o in out]) if out else np.zeros(0, np.int64) for n in range(4))
        return pa.RecordBatch.from_arrays([anchors["a"].take(pa.array(rows)), pa.array(bar.astype(np.int64)), self.ids.take(pa.array(at)),
                                           pa.array(score.astype(np.int64))], ["a", "bar", "id", "score"])


# ---- the operator ----------------------------------------------------------------------------------------------------

def _meet(candidates: DataFrame, anchors: DataFrame, slots: int, run, schema: str) -> DataFrame:
    """``run(slot, batch of anchors)`` for every slot and all anchors; a task holds one slot's candidates and one batch of anchors."""
    asked = anchors.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("kind", F.lit(1))
    names = ["slot", "kind", "a", "id", "label", "planes", "bars"]
    held = candidates.withColumns({"kind": F.lit(0), "a": F.lit(None).cast("long"), "bars": F.lit(None).cast("array<long>")})
    rows = held.select(*names).union(asked.select(*names)).repartition("slot").sortWithinPartitions("slot", "kind")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, slot = None, [], None
        for batch in batches:
            key = batch["slot"].to_numpy().astype(np.int64) * 2 + batch["kind"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]).tolist()
            for first, last in zip(cuts[:-1], cuts[1:]):
                if first == last:
                    continue
                part = batch.slice(first, last - first)
                if key[first] // 2 != number:
                    number, parts, slot = key[first] // 2, [], None
                if key[first] % 2 == 0:
                    parts.append(part)
                elif parts or slot is not None:
                    slot, parts = slot or run(parts), []
                    yield slot[1](slot[0], part)

    return rows.mapInArrow(work, schema)


def mine_hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label",
                        anchor: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                        scale: int = SCALE, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Hard negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components are ``floor(scale * x)``; a score is the whole-number inner product with the anchor. Anchors are the rows
    for which ``anchor`` holds (default: ids divisible by 100). An anchor's positives are its ``positives`` best rows of
    the same label and another id; for each, the ``negatives`` best rows of other labels whose score lies between ``low``
    and ``high`` percent of the positive's. Higher scores come first, ties by smaller id, null ids last. A positive
    without any such row gives none.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Shorter vectors count as
    filled up with zeros; an empty vector scores 0. Rows that repeat an id are rows of their own among positives and
    negatives (one list may name an id twice); an anchor repeated in id, label and vector is asked once. An empty table,
    or one without anchors, gives an empty result; other columns are ignored. Scores must fit 64 bits, else an error is raised.
    """
    label = F.col(f"`{label_col}`") if isinstance(label_col, str) else label_col
    vector = F.col(f"`{vector_col}`")
    anchor = (F.col(f"`{id_col}`") % 100 == 0) if anchor is None else anchor
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    used = rows.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), vector.cast("array<double>").alias("vec"),
                       F.coalesce(anchor, F.lit(False)).alias("asks"), odd.alias("odd")).filter("label is not null and vec is not null and not odd").drop("odd")
    kind, label_kind = used.schema["id"].dataType.simpleString(), used.schema["label"].dataType.simpleString()
    n, width, least, most = used.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.min(F.array_min("vec")), F.max(F.array_max("vec"))).first()
    width, least, most = width or 0, math.floor(scale * (least or 0.0)), math.floor(scale * (most or 0.0))
    if width * max(abs(least), abs(most)) ** 2 >= 1 << 60:
        raise ValueError(f"scores of components up to {max(abs(least), abs(most)):g} do not fit 64 bits")
    planes, groups = planes_for(least, most), -(-width // GROUP)
    dtype = np.int32 if max(width, 1) << (2 * planes) < 1 << 31 else np.int64

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch["vec"]).to_numpy()
            flat = batch["vec"].flatten().to_numpy()
            values = np.zeros((batch.num_rows, width), np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            values[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(flat * scale).astype(np.int64)
            packed = pack_planes(values, planes)
            size = planes * groups
            raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((np.arange(batch.num_rows + 1) * size).astype(np.int32)), pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["asks"], raw], ["id", "label", "asks", "planes"])

    # more slots than the bound asks for, where rows are few, use more cores; results do not depend on it
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, math.ceil(n / slot_rows), min(spread, n // LEAST_ROWS))
    packed = used.mapInArrow(pack, f"id {kind}, label {label_kind}, asks boolean, planes binary")
    packed = materialize(packed.repartition(slots).withColumn("slot", F.spark_partition_id()), "candidates")
    asking = packed.filter("asks").select("id", "label", "planes").distinct()
    asking = materialize(asking.withColumn("a", F.monotonically_increasing_id()), "anchors")

    def slot_of(by_label: bool, call):
        return lambda parts: (Slot(parts, planes, groups, dtype, by_label), call)

    ranked = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    near = _meet(packed, asking.withColumn("bars", F.lit(None).cast("array<long>")), slots,
                 slot_of(True, lambda slot, part: slot.positives(part, positives)), f"a long, id {kind}, score long")
    near = materialize(near.withColumn("place", ranked("a")).filter(F.col("place") <= positives), "positives")
    bars = near.groupBy("a").agg(F.sort_array(F.collect_set("score")).alias("bars"))  # of ``positives`` rows
    far = _meet(packed, asking.join(bars, "a"), slots, slot_of(False, lambda slot, part: slot.negatives(part, negatives, low, high)),
                f"a long, bar long, id {kind}, score long")
    far = far.withColumn("rank", ranked("a", "bar")).filter(F.col("rank") <= negatives)
    pairs = near.select("a", F.col("id").alias("positive_id"), F.col("score").alias("bar"))
    found = far.join(pairs, ["a", "bar"]).join(asking.select("a", F.col("id").alias("anchor_id")), "a")
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("bar").alias("positive_score"),
                        F.col("score").alias("negative_score"))
