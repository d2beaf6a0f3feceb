"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

One edit leaves the first or the second half of a word as it is. Words are therefore listed by the half they keep: for
each length m, words of m and m + 1 letters that share their first ``m // 2`` letters form one list, and words (reversed)
that share their last ``m - m // 2`` letters another. Every list is sorted, so adjacent words share prefixes; the common
prefix lengths say which rows of the edit matrix they share. The rows, a band of three cells, are computed once for each
distinct prefix and word asked, letter by letter; as soon as a band exceeds one edit, all words behind that prefix are
skipped. Lists too long for a task are cut into tiles of (words asked) by (words listed).

All lists of a task are scanned side by side, so numpy handles one letter of all of them at once.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 5
LEAST_COUNT = 3
#: Words of a tile's list (and of its questions) at most, and words scanned together.
TILE_WORDS = 20_000
SCAN_WORDS = 40_000
FAR = 2  # cells of the band hold 0, 1 or "two or more"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- scanning sorted lists -------------------------------------------------------------------------------------------

def common_prefixes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Letters that each word shares with the word before it in its list; -1 for the first of a list."""
    out = np.full(len(sizes), -1, np.int64)
    same = np.flatnonzero(lists[1:] == lists[:-1]) + 1
    out[same] = 0
    depth = 0
    while len(same):
        same = same[(sizes[same] > depth) & (sizes[same - 1] > depth)]
        same = same[codes[starts[same] + depth] == codes[starts[same - 1] + depth]]
        depth += 1
        out[same] = depth
    return out


def scan(words: list[str], lists: np.ndarray, asked: list[str], asked_lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (asked, word) of equal lists that are exactly one edit apart, as indices.

    ``words`` are sorted by list, then code points; ``asked`` words may be a letter shorter or longer, never less or more.
    """
    def flat(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        return np.frombuffer("".join(some).encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes, sizes

    none = np.zeros(0, np.int64)
    if not len(words) or not len(asked):
        return none, none
    codes, starts, sizes = flat(words)
    asked_codes, asked_starts, asked_sizes = flat(asked)
    shared = common_prefixes(codes, starts, sizes, lists)

    def letter(rows: np.ndarray, at: int) -> np.ndarray:
        """Letter ``at`` (from 0) of the words asked; 0 beyond either end."""
        inside = (at >= 0) & (asked_sizes[rows] > at)
        out = np.zeros(len(rows), np.uint32)
        out[inside] = asked_codes[asked_starts[rows[inside]] + at]
        return out

    # a range is the words first..last of a list that share ``depth`` letters; each word asked meets the whole list first
    heads = np.flatnonzero(shared < 0)
    tails = np.append(heads[1:], len(words))
    at = np.searchsorted(lists[heads], asked_lists)
    at = np.minimum(at, len(heads) - 1)
    who = np.flatnonzero(lists[heads[at]] == asked_lists)
    first, last = heads[at[who]], tails[at[who]]
    # row 0 of the matrix: cells left of, on and right of the diagonal
    left, middle, right = (np.full(len(who), n, np.int8) for n in (FAR, 0, 1))
    found_who, found_word = [], []
    depth = 0
    while len(who):
        # the word that ends here stands first in its range
        ends = np.flatnonzero(sizes[first] == depth)
        if len(ends):
            over = asked_sizes[who[ends]] - depth
            cost = np.select([over == -1, over == 0, over == 1], [left[ends], middle[ends], right[ends]], FAR)
            hit = ends[cost == 1]
            found_who.append(who[hit])
            found_word.append(first[hit])
        # ranges of the next letter begin where the word before shares no more than ``depth`` letters
        cuts = np.flatnonzero(shared <= depth)
        closes = np.append(cuts[1:], len(words))
        a = np.searchsorted(cuts, first)
        a = a + (sizes[first] == depth)
        b = np.searchsorted(cuts, last)
        count = np.maximum(b - a, 0)
        parent = np.repeat(np.arange(len(who)), count)
        child = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + a[parent]
        rows = who[parent]
        new = codes[starts[cuts[child]] + depth]
        up_left, up_middle, up_right = left[parent], middle[parent], right[parent]
        # row depth + 1: the diagonal cell compares the new letter with the same letter of the word asked
        new_left = np.minimum(up_left + (letter(rows, depth - 1) != new), up_middle + 1)
        new_middle = np.minimum(np.minimum(up_middle + (letter(rows, depth) != new), up_right + 1), new_left + 1)
        new_right = np.minimum(up_right + (letter(rows, depth + 1) != new), new_middle + 1)
        # cells outside the matrix count for nothing
        size = asked_sizes[rows]
        new_middle = np.where(size >= depth + 1, new_middle, FAR)
        new_right = np.where(size >= depth + 2, new_right, FAR)
        new_left = np.where(size >= depth, new_left, FAR)
        near = np.flatnonzero(np.minimum(np.minimum(new_left, new_middle), new_right) < FAR)
        left, middle, right = (np.minimum(c[near], FAR).astype(np.int8) for c in (new_left, new_middle, new_right))
        who, first, last = rows[near], cuts[child[near]], closes[child[near]]
        depth += 1
    if not found_who:
        return none, none
    return np.concatenate(found_who), np.concatenate(found_word)


# ---- Spark -----------------------------------------------------------------------------------------------------------

def count_words(docs: DataFrame, text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
                change=None, id_col: str | None = None) -> DataFrame:
    """``word, n``: runs of Latin letters with A-Z in lower case, of ``least_letters`` and ``least_count`` occurrences at least.

    ``change(word, id)`` may give another word for an occurrence (an empty one is dropped). A null text has no words.
    """
    runs = F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), UPPER, LOWER), F.lit(RUN), F.lit(0))
    # a change takes away one letter at most
    long = F.filter(runs, lambda w: F.length(w) >= least_letters)
    rows = docs.select((F.col(f"`{id_col}`") if id_col else F.lit(None)).alias("id"), F.explode(long).alias("word"))
    if change is not None:
        rows = rows.select(change(F.col("word"), F.col("id")).alias("word")).filter(F.length("word") >= least_letters)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def delete_letter(modulus: int):
    """A change for ``count_words``: where the crc32 of ``<id>:<word>`` is divisible by ``modulus``, its remainder by the length names a letter that goes.

    A null id reads ``null``.
    """
    def change(word: Column, key: Column) -> Column:
        h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), word).cast("binary"))
        at = (h % F.length(word)).cast("int")
        return F.when(h % modulus == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)
    return change


def _tiles(vocabulary: DataFrame, tile_words: int) -> DataFrame:
    """``k1, k2, k3, side, m, form, asks, n``: each word in the lists of the halves it keeps; long lists as tiles."""
    size = F.length("word")
    forms = []
    for side in (0, 1):
        form = F.reverse("word") if side else F.col("word")
        for less in (0, 1):
            m = size - less
            half = (m - F.floor(m / 2) if side else F.floor(m / 2)).cast("int")
            # a word stands in the lists of its own length, and of one letter less as the longer word
            forms.append(F.struct(F.xxhash64(F.lit(side), m, F.substring(form, F.lit(1), half)).alias("key"), F.lit(side).alias("side"),
                                  m.alias("m"), half.alias("half"), form.alias("form"), F.lit(less == 0).alias("own")))
    listed = vocabulary.select("n", F.explode(F.array(*forms)).alias("f")).select("n", "f.*").filter(F.col("m") >= 1)
    # lists above the limit: fewer than 4 / tile_words of the vocabulary, one small row each
    long = listed.groupBy("key").count().filter(F.col("count") > tile_words)
    long = long.select("key", F.ceil(F.col("count") / tile_words).cast("int").alias("parts"))
    listed = listed.join(F.broadcast(long), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("form", F.lit(7)), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    common = ["key", "side", "m", "half", "form", "n"]
    words = listed.select(*common, F.lit(False).alias("asks"), F.explode(every).alias("i"), part.alias("j"))
    asked = listed.filter("own").select(*common, F.lit(True).alias("asks"), part.alias("i"), F.explode(every).alias("j"))
    return words.union(asked)


def near_words(vocabulary: DataFrame, tile_words: int = TILE_WORDS, scan_words: int = SCAN_WORDS) -> DataFrame:
    """``word, n, near, near_n``: all ordered pairs of words of ``vocabulary`` (``word, n``; distinct) exactly one edit apart.

    An edit inserts, deletes or replaces one code point. Each pair is found in one list only: the one of the shorter
    word's length and of the first half, if both have that in common, else of the second.
    """
    tiles = _tiles(vocabulary, tile_words)
    rows = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "asks", "form")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            tile = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j")])
            cuts = np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(0)) + 1
            if held:
                last = [held[-1][c][held[-1].num_rows - 1].as_py() for c in ("key", "i", "j")]
                cuts = np.concatenate([[0], cuts]) if last != tile[:, 0].tolist() else cuts
            done = 0
            for cut in cuts.tolist():
                # a scan takes whole tiles
                if waiting + cut - done >= scan_words:
                    held.append(batch.slice(done, cut - done))
                    yield pairs(pa.Table.from_batches([h for h in held if h.num_rows]))
                    held, waiting, done = [], 0, cut
            held.append(batch.slice(done))
            waiting += batch.num_rows - done
            held = [h for h in held if h.num_rows]
        if waiting:
            yield pairs(pa.Table.from_batches(held))

    def pairs(table: pa.Table) -> pa.RecordBatch:
        col = {c: table[c].to_numpy() for c in ("key", "i", "j", "side", "m", "half", "asks", "n")}
        new = (np.diff(col["key"]) != 0) | (np.diff(col["i"]) != 0) | (np.diff(col["j"]) != 0)
        lists = np.concatenate([[0], np.cumsum(new)])
        forms = np.array(table["form"].to_pylist(), object)
        asked, listed = np.flatnonzero(col["asks"]), np.flatnonzero(~col["asks"])
        who, word = scan(forms[listed].tolist(), lists[listed], forms[asked].tolist(), lists[asked])
        who, word = asked[who], listed[word]
        # keys are hashes: rows of another length or side that share one are none of this list's
        kept = (col["m"][who] == col["m"][word]) & (col["side"][who] == col["side"][word])
        side, out = col["side"], [[], [], [], []]
        for a, b in zip(who[kept].tolist(), word[kept].tolist()):
            x, y, m = forms[a], forms[b], int(col["m"][a])
            half = int(col["half"][a])
            if x[:half] != y[:half]:
                continue
            if side[a]:
                x, y = x[::-1], y[::-1]
                # the list of first halves has this pair already
                if x[:m // 2] == y[:m // 2]:
                    continue
            # longer words are listed only, so their side of the pair is told here as well
            for p, q, u, v in ((x, y, a, b), (y, x, b, a))[: 1 + (len(x) != len(y))]:
                out[0].append(p)
                out[1].append(int(col["n"][u]))
                out[2].append(q)
                out[3].append(int(col["n"][v]))
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                                           pa.array(out[3], pa.int64())], ["word", "n", "near", "near_n"])

    return rows.mapInArrow(work, "word string, n long, near string, near_n long")


def group_variants(vocabulary: DataFrame, ratio: int = 2, tile_words: int = TILE_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``vocabulary`` (``word, n``; distinct words).

    ``form`` is the near word of largest n (ties: smallest by code points) if that is at least ``ratio`` times the word's
    own, else null. ``root`` follows forms to the last. An empty vocabulary gives an empty result.
    """
    vocabulary = materialize(vocabulary.select("word", "n"), "vocabulary")
    best = near_words(vocabulary, tile_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    told = vocabulary.join(best, "word", "left")
    enough = -F.col("best.less") >= F.col("n") * ratio
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
                       F.when(enough, -F.col("best.less")).alias("form_n"))
    told = materialize(told, "forms")
    # n at least doubles along forms (ratio 2), so paths are short; each round doubles the part of a path that is known
    paths = told.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        paths = materialize(paths, "paths")
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = paths.join(further, "root")
        if joined.isEmpty():
            break
        paths = paths.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"))
    return told.join(paths, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
