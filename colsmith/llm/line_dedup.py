"""Line dedup by winnowing: window minima over line hashes find repeated runs, which are extended and deleted later on.

The unit is a gram: the shortest run of lines from a line on that holds ``gram_words`` words (one line that is not blank, by
default). A window is a run of grams, and the gram with the least hash of every window is selected, so that any run of
``min_words`` words that stands in two places shares a selected gram in both. Positions of a gram are joined by its hash.
Where it repeats, each position is extended both ways to the shortest runs around it that hold ``min_words`` words, from each line
on and up to each line; these are joined by their own hash, wherever they stand first. A longer run is the union of such
runs, so every line of it goes, though other parts of the run may stand earlier elsewhere.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize, slices, spare

MIN_WORDS = 5
SURE_WORDS = 5
GRAM_WORDS = 1


def select_grams(lines: list[str], min_words: int = MIN_WORDS, sure_words: int = SURE_WORDS) -> tuple[list[bytes], list[int], list[tuple[int, int, bytes]]]:
    """Line hashes (of the line without outer white space), word counts, and (first line, last line, hash) of the selected grams.

    A window from a gram on reaches as far as it takes to hold ``sure_words - min_words + 1`` words. Behind the last gram
    inside a run come fewer than ``min_words`` words of it, so a run of ``sure_words`` words holds a whole window.
    """
    hashes = [xxhash.xxh3_128_digest(line.strip().encode()) for line in lines]
    counts = [len(line.split()) for line in lines]
    before = [0]
    for c in counts:
        before.append(before[-1] + c)
    grams: list[tuple[int, int, bytes]] = []
    end = 0
    for start, count in enumerate(counts):
        if not count:  # no gram begins with a blank line
            continue
        end = max(end, start)
        while end < len(lines) and before[end + 1] - before[start] < min_words:
            end += 1
        if end == len(lines):
            break
        grams.append((start, end, _mark(hashes, start, end)))
    need = max(min_words, sure_words - min_words + 1)
    chosen: set[int] = set()
    last = 0
    for first, gram in enumerate(grams):
        last = max(last, first)
        while last < len(grams) and before[grams[last][1] + 1] - before[gram[0]] < need:
            last += 1
        if last == len(grams):
            break
        # of equal minima the last, as windows that slide on keep it longest
        chosen.add(first if first == last else min(range(last, first - 1, -1), key=lambda k: grams[k][2]))
    return hashes, counts, [grams[k] for k in sorted(chosen)]


def _mark(hashes: list[bytes], start: int, end: int) -> bytes:
    return hashes[start] if start == end else xxhash.xxh3_128_digest(b"".join(hashes[start:end + 1]))


def runs_around(hashes: list[bytes], counts: list[int], before: list[int], low: int, high: int, words: int) -> list[tuple[int, int, bytes]]:
    """(first line, last line, hash) of the shortest runs of ``words`` words, from a line on or up to a line, that hold lines ``low`` to ``high``.

    Runs from or up to a blank line count, too. Hashes of runs with a common end are chained, so that many blank lines cost one step each.
    """
    out = set()
    last, held = -1, b""
    x = low
    while x >= 0 and before[low] - before[x] < words:
        end = bisect_left(before, before[x] + words) - 1
        if end >= len(counts):
            x -= 1
            continue
        if end < high:
            break
        if end == last:
            held = xxhash.xxh3_128_digest(hashes[x] + held)
        else:
            held = hashes[end]
            for k in range(end - 1, x - 1, -1):
                held = xxhash.xxh3_128_digest(hashes[k] + held)
        last = end
        out.add((x, end, held))
        x -= 1
    last, held = -1, b""
    y = high
    while y < len(counts) and before[y + 1] - before[high + 1] < words:
        start = bisect_right(before, before[y + 1] - words) - 1
        if start < 0:
            y += 1
            continue
        if start > low:
            break
        if start == last:
            held = xxhash.xxh3_128_digest(held + hashes[y])
        else:
            held = hashes[start]
            for k in range(start + 1, y + 1):
                held = xxhash.xxh3_128_digest(held + hashes[k])
        last = start
        out.add((start, y, held))
        y += 1
    return sorted(out)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, sure_words: int = SURE_WORDS, id_col: str = "doc_id", text_col: str = "text",
                gram_words: int = GRAM_WORDS) -> DataFrame:
    """``docs`` without later repeats of runs of lines; adds ``n_lines`` and ``removed_lines`` (underscores if taken).

    The first place by (id, text hash, line) of every line stays, so no content is lost. Lines compare without outer
    white space. Every line of a run of ``min_words`` words or more that also stands at an earlier place is cut, and no other. With
    ``sure_words`` above ``min_words`` the grams hold ``min_words`` words and fewer are selected: runs of ``sure_words`` words go, and
    shorter ones where they are a selected gram. Null ids come last; rows of equal id and text count as one document and
    are cut alike. A null text stays null, with 0 lines; an empty text is one empty line; a text whose lines all go becomes empty.
    """
    reach = max(min_words, sure_words)
    gram = min_words if sure_words > min_words else min(gram_words, min_words)

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                row, marks, runs = [], [], []
                for n, text in enumerate(part.column(2).to_pylist()):
                    if not text:
                        continue
                    hashes, counts, chosen = select_grams(text.split("\n"), gram, reach)
                    before = [0, *accumulate(counts)]
                    for low, high, mark in chosen:
                        found = runs_around(hashes, counts, before, low, high, reach)
                        if gram >= min_words and (low, high, mark) not in found:
                            found.append((low, high, mark))
                        row.append(n)
                        marks.append(mark)
                        runs.append(found)
                rows = pa.array(row, pa.int64())
                at = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
                flat = [r for found in runs for r in found]
                items = pa.StructArray.from_arrays([pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], pa.int32()),
                                                    pa.array([r[2] for r in flat], pa.binary())], ["low", "high", "run"])
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(marks, pa.binary()),
                                                  pa.ListArray.from_arrays(pa.array(at, pa.int32()), items)], ["id", "text_key", "mark", "runs"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    places = materialize(source.mapInArrow(select, f"id {kind}, text_key long, mark binary, runs array<struct<low int, high int, run binary>>"), "places")

    # plain tables, so that adaptive execution can split the places of a hot line
    often = materialize(places.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark"), "marks")
    around = materialize(places.join(often, "mark").select("id", "text_key", F.explode("runs").alias("r")).select("id", "text_key", "r.*"), "runs")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "text_key", "low")
    first = around.groupBy("run").agg(F.min(order).alias("place"), F.max(order).alias("latest")).filter(~F.col("place").eqNullSafe(F.col("latest")))
    first = materialize(first.select("run", "place"), "first-places")
    runs = around.withColumn("here", order).join(first, "run").filter(~F.col("here").eqNullSafe(F.col("place")))
    runs = runs.select(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key"), "low", "high").distinct()
    # at most two runs for each line of a document
    gone = runs.groupBy("gone_id", "gone_key").agg(F.collect_list(F.struct("low", "high")).alias("runs"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, removed = [], [], []
            for text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = text.split("\n") if text is not None else []
                keep = np.ones(len(parts), bool)
                for run in runs or ():
                    keep[run["low"]:run["high"] + 1] = False
                texts.append(text if keep.all() else "\n".join(p for p, k in zip(parts, keep.tolist()) if k))
                lines.append(len(parts))
                removed.append(int(len(parts) - keep.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(lines, pa.int32()), pa.array(removed, pa.int32()),
                                              *batch.columns[2:]], ["text", "n_lines", "removed_lines", *[f"c{n}" for n in range(batch.num_columns - 2)]])

    rest = [c for c in docs.columns if c != text_col]
    key, gone_id, gone_key, found = spare(docs, "text_key", "gone_id", "gone_key", "runs")
    gone = gone.select(F.col("gone_id").alias(gone_id), F.col("gone_key").alias(gone_key), F.col("runs").alias(found))
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{text_col}`")))
    joined = keyed.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left")
    joined = joined.select(F.col(f"`{text_col}`").alias("text"), F.col(found), *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(rest)])
    out = joined.mapInArrow(cut, T.StructType(T.StructType.fromDDL("text string, n_lines int, removed_lines int").fields + joined.schema.fields[2:]))
    names = {c: f"c{n}" for n, c in enumerate(rest)} | {text_col: "text"}
    lines, removed = spare(docs, "n_lines", "removed_lines")
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns], F.col("n_lines").alias(lines), F.col("removed_lines").alias(removed))
