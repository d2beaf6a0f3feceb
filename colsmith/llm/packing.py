"""Packing token ids into windows: repeat counts of length combinations by non-negative least squares.

Every text is encoded once and stored in blocks. A document is cut into whole windows and one remainder. The remainders'
histogram (one number for each length below the window) is matched with combinations of two or three lengths that fill a
window exactly: their repeat counts are the non-negative least-squares solution against the histogram, rounded so that no
length is used more often than it occurs. Remainders find their place by their rank among equal lengths, which comes from
prefix sums over blocks. What the counts leave over is packed greedily inside its block: the longest piece that fits, and
when none fits, the first part of the shortest; the last tokens of a block fill sequences of a power of two. So every
sequence is full, most documents are whole, and no task sees more than a block.
"""
from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, slices
from .token_files import LOOKUP_BYTES, VOCABULARY, _encoder

WINDOW = 2048
END_ID = 1
DEPTH = 3
BLOCK_IDS = 1 << 20
#: Rounds of the active set at most, and the relative gain under which it stops. They bound the plan's cost, not what is packed.
ROUNDS = 40
LEAST_GAIN = 1e-4


# ---- the plan: combinations and their counts -------------------------------------------------------------------------

def combinations(lengths: np.ndarray, window: int, depth: int = DEPTH) -> np.ndarray:
    """All rising combinations of 2 to ``depth`` (2 or 3) of the ``lengths`` that fill ``window``: (count, depth), 0 for no part."""
    if depth not in (2, 3):
        raise ValueError("depth is 2 or 3")
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    lengths = np.flatnonzero(present[:window])
    lengths = lengths[lengths > 0]
    out = [np.zeros((0, depth), np.int64)]
    first = lengths[lengths * 2 <= window]
    first = first[present[window - first]]
    out.append(np.stack([first, window - first, *[np.zeros(len(first), np.int64)] * (depth - 2)], 1))
    for a in lengths[lengths * 3 <= window].tolist() if depth == 3 else []:
        b = lengths[(lengths >= a) & (lengths * 2 <= window - a)]
        b = b[present[window - a - b]]
        out.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    return np.concatenate(out)


def _product(parts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """How often each length is used by ``counts`` of the combinations ``parts``; index 0 stays 0."""
    used = np.bincount(parts.ravel(), weights=np.repeat(counts, parts.shape[1]), minlength=window + 1)
    used[0] = 0
    return used


def _least_squares(parts: np.ndarray, target: np.ndarray, start: np.ndarray, window: int, steps: int = 300) -> np.ndarray:
    """Conjugate gradients for the counts of ``parts`` whose product is closest to ``target``."""
    x = start.copy()
    rest = target - _product(parts, x, window)
    slope = rest[parts].sum(1)
    step, norm = slope.copy(), float(slope @ slope)
    least = 1e-12 * max(norm, 1.0)
    for _ in range(steps):
        if norm <= least:
            break
        moved = _product(parts, step, window)
        size = norm / float(moved @ moved)
        x += size * step
        rest -= size * moved
        slope = rest[parts].sum(1)
        norm, before = float(slope @ slope), norm
        step = slope + norm / before * step
    return x


def repeat_counts(parts: np.ndarray, histogram: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares by an active set: indices into ``parts`` and their (fractional, positive) counts.

    Each round adds the combinations of steepest slope that share no length, solves on the active ones and steps back
    to the positive side. Solutions have few active combinations, so rounding loses little.
    """
    active, x = np.zeros(0, np.int64), np.zeros(0)
    target = histogram.astype(float)
    target[0] = 0
    rest, error = target.copy(), float(target @ target)
    for _ in range(rounds):
        slope = rest[parts].sum(1)
        slope[active] = 0
        order = np.argsort(-slope, kind="stable")
        order = order[slope[order] > 1e-9 * max(1.0, error) ** 0.5]
        taken, new = np.zeros(window + 1, bool), []
        for at, lengths in zip(order.tolist(), parts[order].tolist()):
            if not any(taken[n] for n in lengths):
                new.append(at)
                taken[lengths] = True
                taken[0] = False
                if len(new) * 2 > window:
                    break
        if not new:
            break
        active, x = np.concatenate([active, new]), np.concatenate([x, np.zeros(len(new))])
        while len(active):
            z = _least_squares(parts[active], target, x, window)
            bad = z <= 1e-9
            if not bad.any():
                x = z
                break
            # go towards z until the first count would turn negative; those without a way to go leave
            ratio = x[bad] / np.maximum(x[bad] - z[bad], 1e-300)
            reach = float(ratio.max(initial=0.0)) if (x[bad] > 0).any() else 0.0
            x = np.where(bad, 0.0, x + min(1.0, reach) * (z - x))
            active, x = active[~bad], np.maximum(x[~bad], 0.0)
        rest = target - _product(parts[active], x, window)
        rest[0] = 0
        before, error = error, float(rest @ rest)
        if before - error <= LEAST_GAIN * before:
            break
    return active, x


def plan_windows(histogram: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and whole repeat counts that use no length more often than ``histogram`` (index: length) holds it."""
    parts = combinations(np.flatnonzero(histogram), window, depth)
    if not len(parts):
        return parts, np.zeros(0, np.int64)
    active, x = repeat_counts(parts, histogram, window)
    left = histogram.astype(np.int64).copy()
    counts = np.zeros(len(active), np.int64)
    # whole parts first, then one more each where the histogram allows it, largest fraction first
    for order, wish in ((np.argsort(-x, kind="stable"), np.floor(x + 1e-6).astype(np.int64)),
                        (np.argsort(np.floor(x + 1e-6) - x, kind="stable"), (np.ceil(x - 1e-6) > np.floor(x + 1e-6)).astype(np.int64))):
        for n in order.tolist():
            lengths, times = np.unique(parts[active[n]][parts[active[n]] > 0], return_counts=True)
            take = min(int(wish[n]), int((left[lengths] // times).min()))
            counts[n] += take
            left[lengths] -= take * times
    kept = counts > 0
    return parts[active[kept]], counts[kept]


class Places:
    """Sequence and offset of the remainder with a given rank among all remainders of its length."""

    def __init__(self, parts: np.ndarray, counts: np.ndarray, window: int):
        base = np.cumsum(counts) - counts
        self.total = int(counts.sum())
        self.covered = np.zeros(window + 1, np.int64)
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for lengths, count, first in zip(parts.tolist(), counts.tolist(), base.tolist()):
            offset = 0
            for n in lengths:
                if n:
                    rows.setdefault(n, []).append((int(self.covered[n]), first, offset))
                    self.covered[n] += count
                    offset += n
        self.rows = {n: np.array(r, np.int64) for n, r in rows.items()}

    def find(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ranks below ``covered[length]``."""
        rows = self.rows[length]
        at = np.searchsorted(rows[:, 0], ranks, side="right") - 1
        return rows[at, 1] + ranks - rows[at, 0], rows[at, 2]


# ---- greedy packing of what is left ----------------------------------------------------------------------------------

def greedy_pack(lengths: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """``(piece, start in it, length, sequence from 0, offset)``: full windows, then sequences of a power of two."""
    total = sum(lengths)
    rooms = [window] * (total // window)
    rest = total % window
    rooms += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    waiting = sorted((size, piece, 0) for piece, size in enumerate(lengths))
    out = []
    for sequence, size in enumerate(rooms):
        offset = 0
        while offset < size:
            room = size - offset
            at = bisect.bisect_right(waiting, (room, len(lengths), 0)) - 1
            if at >= 0:
                length, piece, start = waiting.pop(at)
            else:
                whole, piece, start = waiting.pop(0)
                length = room
                bisect.insort(waiting, (whole - room, piece, start + room))
            out.append((piece, start, length, sequence, offset))
            offset += length
    return out


def pack_block(tokens: np.ndarray, bases: dict[int, int], places: Places, first_sequence: int, window: int):
    """Pieces of a block's documents: rows, starts, lengths, sequences, offsets and whether the plan placed them."""
    tails, full = tokens % window, tokens // window
    rows = [np.repeat(np.arange(len(tokens)), full)]
    within = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)
    starts, sizes = [within * window], [np.full(len(within), window)]
    sequences, offsets, planned = [first_sequence + np.arange(len(within))], [np.zeros(len(within), np.int64)], [np.zeros(len(within), bool)]
    first_sequence += len(within)
    order = np.argsort(tails, kind="stable")
    kinds, firsts = np.unique(tails[order], return_index=True)
    left: list[np.ndarray] = []
    for length, some in zip(kinds.tolist(), np.split(order, firsts[1:])):
        if not length:
            continue
        covered = min(len(some), max(0, int(places.covered[length]) - bases[length]))
        if covered:
            sequence, offset = places.find(length, bases[length] + np.arange(covered))
            rows.append(some[:covered])
            starts.append(tokens[some[:covered]] - length)
            sizes.append(np.full(covered, length))
            sequences.append(sequence)
            offsets.append(offset)
            planned.append(np.ones(covered, bool))
        left.append(some[covered:])
    rest = np.concatenate(left) if left else np.zeros(0, np.int64)
    packed = np.array(greedy_pack(tails[rest].tolist(), window), np.int64).reshape(-1, 5)
    rows.append(rest[packed[:, 0]])
    starts.append((tokens - tails)[rest[packed[:, 0]]] + packed[:, 1])
    sizes.append(packed[:, 2])
    sequences.append(first_sequence + packed[:, 3])
    offsets.append(packed[:, 4])
    planned.append(np.zeros(len(packed), bool))
    return tuple(np.concatenate(x) for x in (rows, starts, sizes, sequences, offsets, planned))


# ---- Spark -----------------------------------------------------------------------------------------------------------

def encode_blocks(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, end_id: int, block_ids: int) -> DataFrame:
    """``shard, block, doc_ids, tokens, payload``: the ids of consecutive documents, about ``block_ids`` or one document."""
    spark: SparkSession = docs.sparkSession
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file, not data
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        keys: list[pa.Array] = []
        shard, number, waiting = None, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, counts, keys, number, waiting
            names = pa.concat_arrays(keys)
            edges = pa.array([0, len(names)], pa.int32())
            row = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.ListArray.from_arrays(edges, names),
                pa.ListArray.from_arrays(edges, pa.array(np.concatenate(counts))),
                pa.array([np.concatenate(ids).astype(f"<u{encoder.width}").tobytes()], pa.binary())], ["shard", "block", "doc_ids", "tokens", "payload"])
            ids, counts, keys, number, waiting = [], [], [], number + 1, 0
            return row

        for batch in batches:
            for part in slices(batch, 1, LOOKUP_BYTES):
                shard = part.column(2)[0].as_py()
                flat, sizes = encoder.encode(part.column(1))
                ends = np.cumsum(sizes)
                flat = np.insert(flat, ends, end_id)
                sizes, ends = sizes + 1, ends + np.arange(1, len(sizes) + 1)
                row = 0
                while row < len(sizes):
                    done = int(ends[row - 1]) if row else 0
                    until = max(row + 1, int(np.searchsorted(ends, done + block_ids - waiting, side="right")))
                    size = int(ends[until - 1]) - done
                    if waiting and waiting + size > block_ids:
                        yield flush()
                        continue
                    ids.append(flat[done:done + size])
                    counts.append(sizes[row:until])
                    keys.append(part.column(0).slice(row, until - row))
                    waiting += size
                    row = until
        if waiting:
            yield flush()

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.spark_partition_id().alias("shard"))
    return rows.mapInArrow(run, f"shard int, block int, doc_ids array<{kind}>, tokens array<long>, payload binary")


def pack_documents(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                   end_id: int = END_ID, depth: int = DEPTH, block_ids: int = BLOCK_IDS, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, planned`` and ``ids``.

    A document is its ids (added tokens found, as the tokenizers library does by default) and ``end_id``; a null or
    empty text is the end id alone. Pieces of a sequence lie in it without gaps. Sequences hold ``window`` tokens, or a
    power of two (a few in each block). Sequence ids rise from 0 without gaps: planned ones first. ``planned`` tells
    pieces that the length combinations placed. ``ids`` are little-endian unsigned 32-bit integers. Ids of any type,
    null ids and repeated rows are documents of their own; other columns are ignored; an empty table gives an empty
    result. Which of two equally long remainders goes where depends on the files' layout, never on their content.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = materialize(encode_blocks(docs, id_col, text_col, vocabulary, end_id, block_ids), "encoded")
    sizes = blocks.select("shard", "block", F.explode("tokens").alias("t"))
    tails = sizes.groupBy("shard", "block", (F.col("t") % window).cast("int").alias("tail")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("t") / window)).alias("full"))
    tails = materialize(tails, "tails")
    histogram = np.zeros(window + 1, np.int64)
    for row in tails.groupBy("tail").agg(F.sum("n")).collect():  # a row for each length below the window
        histogram[row[0]] = row[1]
    histogram[0] = 0
    places = Places(*plan_windows(histogram, window, depth), window)

    # a row for each length; the rank of a block's first remainder of a length counts those of all blocks before it
    covered = docs.sparkSession.createDataFrame([(n, int(c)) for n, c in enumerate(places.covered) if c], "tail int, covered long")
    before = Window.partitionBy("tail").orderBy("shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = tails.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(covered), "tail", "left")
    uncovered = F.greatest(F.lit(0), F.least("n", F.col("base") + F.col("n") - F.coalesce("covered", F.lit(0)))) * F.col("tail")
    per_block = ranked.groupBy("shard", "block").agg(F.map_from_entries(F.collect_list(F.struct("tail", "base"))).alias("bases"),
                                                     F.sum("full").alias("full"), F.sum(uncovered).alias("rest"))
    own = F.col("full") + F.floor(F.col("rest") / window) + F.bit_count(F.col("rest") % window)
    per_block = materialize(per_block.withColumn("own", own), "bases")
    # one row for each shard
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = per_block.groupBy("shard").agg(F.sum("own").alias("own")).select("shard", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("shard_first"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("own").over(inside), F.lit(0)) + F.col("shard_first") + places.total
    numbered = per_block.join(shards, "shard").select("shard", "block", "bases", first.cast("long").alias("first"))
    # both grow with the documents: always a shuffle join, which keeps the ids of a task within bounds
    joined = blocks.join(numbered.hint("merge"), ["shard", "block"]).select("doc_ids", "tokens", "payload", "bases", "first")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                keys, tokens = batch.column(0)[at].values, batch.column(1)[at].values.to_numpy()
                payload = batch.column(2)[at].as_buffer()
                ends = np.cumsum(tokens)
                ids = np.frombuffer(payload, f"<u{len(payload) // int(ends[-1])}").astype("<u4")
                bases = dict(batch.column(3)[at].as_py())
                rows, starts, lengths, sequences, offsets, planned = pack_block(tokens, bases, places, batch.column(4)[at].as_py(), window)
                firsts = (ends - tokens)[rows] + starts
                raw = [ids[a:b].tobytes() for a, b in zip(firsts.tolist(), (firsts + lengths).tolist())]
                columns = [keys.take(pa.array(rows)), pa.array(starts), pa.array(lengths), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                           pa.array(tokens[rows]), pa.array(sequences), pa.array(offsets), pa.array(planned)]
                names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "planned"]
                if with_ids:
                    columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, planned boolean"
    return joined.mapInArrow(pack, schema + ", ids binary" * with_ids).withColumnRenamed("doc", id_col)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """``sequence_id, n_tokens, ids`` from ``pack_documents`` with its ids; padded to ``window`` unless a power of two."""
    held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda done, part: F.concat(done, part["ids"]))
    n = F.col("n_tokens")
    missing = F.when(F.bit_count(n) == 1, F.lit(0)).otherwise(window - n).cast("int")
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), missing))
    return held.select("sequence_id", "n_tokens", F.concat(ids, pad).alias("ids"))
