"""Document fingerprints by a randomised edit embedding.

All texts share one random walk rule: at walk time j on character c, a fixed random bit says whether to read the next
character or this one again. Texts with few edits fall into step again after each edit, so edit distance becomes the
number of times at which their walks read different characters. The fingerprint samples the walk at times chosen
alike for all texts; bands of samples find most near pairs, which are verified on the whole texts. Edits take walks out of
step, so bands alone lose pairs with many edits; all texts of like length that are not joined by then are compared as well, where ``every_pair`` is set.
"""
from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import materialize, slices

SLOTS = 128
PERIOD = 1 << 13
CLASSES = 256
#: From so many texts on, a step is taken for all texts at once.
TOGETHER = 48
BANDS, BAND_SLOTS = 16, 8
#: Characters and texts of a block of a band; a tile holds two blocks. A longer text is a block by itself.
BLOCK_CHARS, BLOCK_TEXTS = 1 << 20, 500


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function (constants of splitmix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walk:
    """The shared randomness: bits by walk time (repeating after PERIOD) and character class, and the sampled times."""

    def __init__(self, seed: int = 1):
        cells = np.arange(PERIOD * CLASSES, dtype=np.uint64) + np.uint64(seed << 32)
        bits = (mix64(cells) & np.uint64(1)).astype(bool).reshape(PERIOD, CLASSES)
        # steps until the walk moves on from a character: 1 where the bit is set, else one more than a step later
        stay = np.ones((2 * PERIOD, CLASSES), np.int32)
        for j in range(2 * PERIOD - 2, -1, -1):
            stay[j] = np.where(bits[j % PERIOD], 1, np.minimum(stay[j + 1] + 1, PERIOD))
        self.stay = np.minimum(stay[:PERIOD], 255).ravel()
        self.stay_bytes = self.stay.astype(np.uint8).tobytes()
        self.seed = seed
        self.known = 0
        self.best = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
        self.records: list[list[int]] = [[] for _ in range(SLOTS)]
        self._grow(1 << 14)

    def _grow(self, length: int) -> None:
        """Times that are the least by a slot's hash of all times up to them; the last below a length is its sample."""
        while self.known < length:
            times = np.arange(self.known, self.known + (1 << 14), dtype=np.uint64)
            for slot in range(SLOTS):
                hashes = mix64(times + np.uint64((self.seed * SLOTS + slot + 1) << 40))
                lows = np.minimum.accumulate(np.concatenate([self.best[slot:slot + 1], hashes]))
                new = np.flatnonzero(lows[1:] < lows[:-1])
                self.records[slot] += (new + self.known).tolist()
                self.best[slot] = lows[-1]
            self.known += 1 << 14
        width = max(map(len, self.records))
        self.table = np.array([r + [np.iinfo(np.int64).max] * (width - len(r)) for r in self.records], np.int64)

    def samples(self, length: int) -> np.ndarray:
        """One walk time below ``length`` for each slot; nearly the same for nearly equal lengths."""
        if length > self.known:
            self._grow(length)
        last = (self.table < length).sum(1) - 1
        return self.table[np.arange(SLOTS), last]

    def times(self, group: list[np.ndarray], starts: list[int]) -> list[np.ndarray]:
        """For each text, from its own start time: when each character is first read, and the end.

        All texts take a step together. By falling length, the texts that still have a character i are the first ones,
        so step i fills a stretch of as many cells and nothing is padded. The few longest end by themselves.
        """
        order = sorted(range(len(group)), key=lambda k: -len(group[k]))
        sizes = np.array([len(group[k]) for k in order], np.int64)
        together = int(sizes[TOGETHER - 1]) if len(sizes) >= TOGETHER else 0
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, together + 1))
        base = np.concatenate([[0], np.cumsum(active)])
        letters = np.zeros(int(base[-1]), np.uint8)
        for n, k in enumerate(order):
            size = min(len(group[k]), together)
            letters[base[:size] + n] = group[k][:size]
        read = np.zeros(int(base[-1]), np.int64)
        now = np.array([starts[k] for k in order], np.int64)
        at = 0
        for n in active.tolist():
            now[:n] += self.stay[((now[:n] & (PERIOD - 1)) << 8) | letters[at:at + n]]
            read[at:at + n] = now[:n]
            at += n
        out: list[np.ndarray] = [np.zeros(1, np.int64)] * len(group)
        for n, k in enumerate(order):
            size = min(len(group[k]), together)
            first = np.concatenate([[starts[k]], read[base[:size] + n]])
            out[k] = np.concatenate([first, self._alone(group[k][size:], int(now[n]))]) if len(group[k]) > size else first
        return out

    def _alone(self, letters: np.ndarray, now: int) -> np.ndarray:
        times = []
        for letter in letters.tolist():
            now += self.stay_bytes[(now & (PERIOD - 1)) << 8 | letter]
            times.append(now)
        return np.array(times, np.int64)

    def sample(self, letters: np.ndarray, times: np.ndarray) -> bytes:
        """SLOTS bytes: the character read at each sampled time, mixed with that time; 0 for an empty text."""
        if not len(letters):
            return bytes(SLOTS)
        picked = self.samples(int(times[-1]))
        read = letters[np.searchsorted(times, picked, side="right") - 1]
        return ((read + mix64(picked.astype(np.uint64))) & np.uint64(255)).astype(np.uint8).tobytes()

    def fingerprints(self, texts: list[str]) -> list[bytes]:
        letters = [_classes(t) for t in texts]
        return [self.sample(a, b) for a, b in zip(letters, self.times(letters, [0] * len(letters)))]

    def with_tails(self, texts: list[str], tails: list[str], cuts: list[int]) -> tuple[list[bytes], list[bytes]]:
        """Fingerprints of the texts, and of the texts whose part from ``cut`` on is replaced by a tail.

        Up to the cut both walks are the same, so the second begins there.
        """
        letters, ends = [_classes(t) for t in texts], [_classes(t) for t in tails]
        times = self.times(letters, [0] * len(letters))
        after = self.times(ends, [int(t[c]) for t, c in zip(times, cuts)])
        own = [self.sample(a, b) for a, b in zip(letters, times)]
        changed = [self.sample(np.concatenate([a[:c], e]), np.concatenate([t[:c], u])) for a, e, c, t, u in zip(letters, ends, cuts, times, after)]
        return own, changed


_CLASS_OF = (mix64(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(56)).astype(np.uint8)


def _classes(text: str) -> np.ndarray:
    """The class of each code point."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) and int(points.max()) >= 1 << 16:
        return (mix64(points.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
    return _CLASS_OF[points]


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal samples, 0 to 1: an estimate of how much of the two walks reads the same characters."""
    return float(np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))) / SLOTS


_WALKS: dict[int, Walk] = {}


def walk(seed: int = 1) -> Walk:
    if seed not in _WALKS:
        _WALKS[seed] = Walk(seed)
    return _WALKS[seed]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """``id_col, n_chars, fingerprint`` (hex) of every whole text; null counts as empty (all zero). No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()),
                                                  pa.array([p.hex() for p in walk(seed).fingerprints(texts)], pa.string())], ["id", "n_chars", "fingerprint"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, schema: str, make: Callable[[list, list[str], list[str]], pa.RecordBatch],
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply ``make(ids, texts, next texts)`` to every row and its successor by falling id; after the last comes the first.

    Rows go to ranges of ids in one shuffle. The first row of a range is also sent to the range before it, so each
    range is read by itself. Rows of equal ids follow by a hash of their text, then the text; null ids come last. An id
    (or null) that holds more rows than a range should is split by that hash; only rows equal in id and hash stay together.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    key = F.coalesce("id", F.lit(-(1 << 63)))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(key.alias("key")).agg(F.percentile_approx("key", [n / ranges for n in range(1, ranges)] or [0.5], 100 * ranges)).first()[0]
    times = Counter(cuts or [])
    hot = sorted(k for k, n in times.items() if n > 1)
    # the hash takes part in a row's place only under hot ids, so texts are read for it only where there are any
    tie = F.when(key.isin(hot), F.xxhash64("text")).otherwise(F.lit(0)) if hot else F.lit(0).cast("long")
    placed = rows.select("id", "text", key.alias("key"), tie.alias("sub"))
    points = [(k, -(1 << 63)) for k in times]
    if hot:
        inner = placed.agg(*[F.percentile_approx(F.when(F.col("key") == k, F.col("sub")), [n / times[k] for n in range(1, times[k])], 100 * times[k])
                             for k in hot]).first()
        points += [(k, s) for k, subs in zip(hot, inner) for s in subs]
    points = sorted(set(points))
    # ranges count from the largest ids down
    borders = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(s).cast("long").alias("sub")) for k, s in points])
    number = F.lit(len(points)) - F.size(F.filter(borders, lambda b: b <= F.struct("key", "sub"))) if points else F.lit(0)
    tops = {r.range: r.top for r in placed.groupBy(number.alias("range")).agg(F.max(F.struct("key", "sub")).alias("top")).collect()}  # one row for each range
    held = sorted(tops)
    if not held:
        return spark.createDataFrame([], schema)
    guards = [(tops[after], r) for r, after in zip(held, held[1:] + held[:1])]
    copies = [F.when((F.col("key") == top.key) & (F.col("sub") == top.sub), F.struct(F.lit(r).alias("range"), F.lit(1).alias("guard"))) for top, r in guards]
    places = F.filter(F.array(F.struct(number.alias("range"), F.lit(0).alias("guard")), *copies), lambda p: p.isNotNull())
    spread = placed.withColumn("place", F.explode(places))
    spread = spread.select("id", "text", "key", F.xxhash64("text").alias("tie"), F.col("place.range").alias("range"), F.col("place.guard").alias("guard"))
    spread = spread.repartition(ranges, "range").sortWithinPartitions("range", "guard", F.desc("key"), F.desc("tie"), F.desc("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for its successor
        closed = None  # the range whose guard has been seen
        for batch in batches:
            for part in slices(batch, 1):
                ids, texts, after = [], [], []
                for i, t, r, g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if r == closed:
                        continue
                    if last is not None:
                        ids.append(last[0])
                        texts.append(last[1])
                        after.append(t)
                    last, closed = (None, r) if g else ((i, t), closed)
                if ids:
                    yield make(ids, texts, after)

    return spread.select("id", "text", "range", "guard").mapInArrow(run, schema)


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likenesses.

    The edited text has its last third (rounded down, in code points) replaced by as many first code points of the next
    document by falling id, or all of them. Null texts are empty; a table of one row is followed by itself.
    """
    def make(ids: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
        cuts = [len(t) - len(t) // 3 for t in texts]
        tails = [a[:len(t) // 3] for t, a in zip(texts, after)]
        edited = [t[:c] + e for t, c, e in zip(texts, cuts, tails)]
        own, changed = walk(seed).with_tails(texts, tails, cuts)
        # a row's successor is the next row here, but for rows before a border
        missing = [n for n, a in enumerate(after) if n + 1 == len(texts) or a is not texts[n + 1]]
        following = own[1:] + own[:1]
        for n, p in zip(missing, walk(seed).fingerprints([after[n] for n in missing])):
            following[n] = p
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([p.hex() for p in own], pa.string()), pa.array([p.hex() for p in changed], pa.string()),
            pa.array(map(likeness, own, changed), pa.float64()), pa.array(map(likeness, own, following), pa.float64())],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, schema, make, id_col, text_col).withColumnRenamed("id", id_col)


def edit_distance(a: str, b: str, limit: int) -> int | None:
    """Edits between two texts, or None above ``limit``: bit vectors of one text's length, a step for each character of the other."""
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    if abs(len(x) - len(y)) > limit:
        return None
    short = min(len(x), len(y))
    differ = np.flatnonzero(x[:short] != y[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(x[head:][::-1][:short - head] != y[head:][::-1][:short - head])
    tail = int(differ[0]) if len(differ) else short - head
    pattern, text = sorted((x[head:len(x) - tail].tolist(), y[head:len(y) - tail].tolist()), key=len)
    if not pattern:
        return len(text) if len(text) <= limit else None
    masks: dict[int, int] = {}
    for n, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << n
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, score = full, 0, len(pattern)
    for left, c in zip(range(len(text) - 1, -1, -1), text):
        equal = masks.get(c, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        more, less = down | (full & ~(across | up)), up & across
        score += 1 if more & top else -1 if less & top else 0
        if score - left > limit:
            return None
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = less | (full & ~(vertical | more)), more & vertical
    return score if score <= limit else None


def _limit(a: str, b: str, max_edits: float) -> int:
    return int(max(len(a), len(b)) * max_edits)


def _new_links(digests: list[str], texts: list[str], roots: list[str], blocks: list[int], max_edits: float) -> list[tuple[int, int, int]]:
    """``(text, text, edits)`` of links that join texts of different roots; once joined, texts are not compared again.

    Two blocks are compared with each other only. Counts of characters give a lower bound of the edits, so most pairs
    that are no links cost no edit distance.
    """
    group = list(range(len(texts)))
    first: dict[str, int] = {}
    for n, root in enumerate(roots):
        group[n] = first.setdefault(root, n)

    def top(n: int) -> int:
        while group[n] != n:
            group[n] = group[group[n]]
            n = group[n]
        return n

    sizes = np.array([len(t) for t in texts])
    counts = np.array([np.bincount(_classes(t), minlength=CLASSES) for t in texts], np.int32)
    block = np.array(blocks)
    across = block.min() != block.max()
    links = []
    for a in range(len(texts) - 1):
        differ = counts[a + 1:] - counts[a]
        bound = np.maximum(np.maximum(differ, 0).sum(1), np.maximum(-differ, 0).sum(1))
        near = bound <= (np.maximum(sizes[a + 1:], sizes[a]) * max_edits).astype(np.int64)
        if across:
            near &= block[a + 1:] != block[a]
        for b in (np.flatnonzero(near) + a + 1).tolist():
            if top(a) != top(b):
                edits = edit_distance(texts[a], texts[b], _limit(texts[a], texts[b], max_edits))
                if edits is not None:
                    group[top(b)] = top(a)
                    links.append((a, b, edits))
    return links


_LINKS = "text_sha256 string, near_sha256 string, edits int"


def _verify(pairs: DataFrame, max_edits: float) -> DataFrame:
    """Links among the pairs ``digest, head, text, head_text``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            edits = pa.array([edit_distance(t, h, _limit(t, h, max_edits)) for t, h in zip(columns[2], columns[3])], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), edits], ["text_sha256", "near_sha256", "edits"])

    return pairs.select("digest", "head", "text", "head_text").mapInArrow(run, _LINKS).filter("edits is not null")


def _tiles(rows: DataFrame, max_edits: float) -> DataFrame:
    """New links of every tile of ``band, low, high, block, digest, root, text``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            found = _new_links(*[[r[c] for r in held] for c in ("digest", "text", "root", "block")], max_edits)
            return pa.RecordBatch.from_arrays([pa.array([held[a]["digest"] for a, _, _ in found], pa.string()),
                                               pa.array([held[b]["digest"] for _, b, _ in found], pa.string()),
                                               pa.array([e for _, _, e in found], pa.int32())], ["text_sha256", "near_sha256", "edits"])

        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("text")):
                for row in part.to_pylist():
                    now = (row["band"], row["low"], row["high"])
                    if now != key:
                        if len(held) > 1:
                            yield close()
                        key, held = now, []
                    held.append(row)
        if len(held) > 1:
            yield close()

    spread = rows.select("band", "low", "high", "block", "digest", "root", "text")
    return spread.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "digest").mapInArrow(run, _LINKS)


def near_texts(docs: DataFrame, max_edits: float = 0.2, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS,
               band_slots: int = BAND_SLOTS, seed: int = 1, every_pair: bool = True) -> DataFrame:
    """Links between near texts: ``text_sha256, near_sha256, edits`` with at most ``max_edits`` edits a character.

    Equal texts are one node (empty and null texts none). Nodes that share a band of sampled walk times meet, and are
    verified by edit distance on the whole texts. The links are enough to hang together whatever hangs together by the
    links among all that meet: each node is compared with the least digest of its band first, and only bands whose
    members still belong to different components are then compared member by member, in tiles of bounded size. With
    ``every_pair`` all texts whose lengths allow a link and whose components differ by then are compared in such tiles, so
    the links hang together what all pairs by edit distance do; the work grows with the square of the texts of like
    length. Without it, pairs that share no band are lost, most of those near ``max_edits`` (see the README).
    """
    nodes = _text_nodes(docs, text_col)
    links = _near_links(nodes, max_edits, bands, band_slots, seed)
    if not every_pair or max_edits <= 0:
        return links
    links = materialize(links, "band-links")
    return links.unionByName(materialize(_other_links(nodes, links, max_edits), "other-links")).distinct()


def near_text_classes(docs: DataFrame, max_edits: float = 0.2, id_col: str = "doc_id", text_col: str = "text", every_pair: bool = False,
                      **options) -> DataFrame:
    """``id_col, text_sha256, class_sha256`` of every row; the class is the least digest that the text hangs together with.

    By default texts meet in bands only; ``every_pair`` makes the classes those of all pairs by edit distance.
    Null texts count as empty; empty texts are one class. Null and repeated ids stay rows of their own.
    """
    classes = components(near_texts(docs, max_edits, id_col, text_col, every_pair=every_pair, **options).select(F.col("text_sha256").alias("a"), F.col("near_sha256").alias("b")))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("text_sha256"))
    found = rows.join(classes.withColumnRenamed("node", "text_sha256"), "text_sha256", "left")
    return found.select(F.col("id").alias(id_col), "text_sha256", F.coalesce("root", "text_sha256").alias("class_sha256"))


def _text_nodes(docs: DataFrame, text_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{text_col}`").alias("text")).filter("text != ''")
    return materialize(rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.max("text").alias("text")), "texts")


def _other_links(nodes: DataFrame, links: DataFrame, max_edits: float) -> DataFrame:
    """New links among all texts, given links among some: blocks of a length class meet those of their own class and the next.

    The shorter text of a link has ``1 - max_edits`` of the longer one's characters at least, which is a class's width.
    """
    roots = components(links.select(F.col("text_sha256").alias("a"), F.col("near_sha256").alias("b"))).withColumnRenamed("node", "digest")
    n_chars = F.length("text")
    width = -math.log(1 - max_edits) * (1 + 1e-9) if max_edits < 1 else None
    kind = F.floor(F.log(n_chars) / width).cast("int") if width else F.lit(0)
    sized = nodes.join(roots, "digest", "left").select("digest", F.coalesce("root", "digest").alias("root"), "text", n_chars.alias("n_chars"), kind.alias("kind"))
    sized = materialize(sized, "sized")
    blocks = F.ceil(F.greatest(F.sum("n_chars") / BLOCK_CHARS, F.count(F.lit(1)) / BLOCK_TEXTS)).cast("int")
    # one row for each length class
    counted = sorted((r.kind, r.blocks) for r in sized.groupBy("kind").agg(blocks.alias("blocks")).collect())
    if not counted:
        return links.limit(0)
    first, rows, at = {}, [], 0
    for k, n in counted:
        first[k] = at
        at += n
    held = dict(counted)
    for k, n in counted:
        low, high = first.get(k - 1, first[k]), first[k] + n + held.get(k + 1, 0)
        rows.append((k, first[k], n, low, high - 1))
    classes = nodes.sparkSession.createDataFrame(rows, "kind int, first int, n int, low_block int, high_block int")
    placed = sized.join(F.broadcast(classes), "kind").withColumn("block", F.col("first") + F.pmod(F.xxhash64("digest"), F.col("n")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence("low_block", "high_block"))).withColumn("band", F.lit("all"))
    return _tiles(placed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")), max_edits)


def _near_links(nodes: DataFrame, max_edits: float, bands: int, band_slots: int, seed: int) -> DataFrame:
    prints = fingerprint_documents(nodes, "digest", "text", seed)
    size = band_slots * 2
    pieces = F.array(*[F.concat(F.lit(f"{b}:"), F.substring("fingerprint", b * size + 1, size)) for b in range(bands)])
    members = materialize(prints.select("digest", "n_chars", F.explode(pieces).alias("band")), "bands")
    heads = members.groupBy("band").agg(F.min("digest").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = members.join(heads, "band").filter("digest != head").select("digest", "head").distinct()
    texts = nodes.select(F.col("digest").alias("head"), F.col("text").alias("head_text"))
    stars = materialize(_verify(pairs.join(nodes, "digest").join(texts, "head"), max_edits), "stars")

    roots = components(stars.select(F.col("text_sha256").alias("a"), F.col("near_sha256").alias("b"))).withColumnRenamed("node", "digest")
    rooted = members.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    rooted = materialize(rooted, "rooted")
    blocks = F.ceil(F.greatest(F.sum("n_chars") / BLOCK_CHARS, F.count(F.lit(1)) / BLOCK_TEXTS)).cast("int")
    # bands of the same members and components need one look
    same = [F.min("digest").alias("lo"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y")]
    unsettled = rooted.groupBy("band").agg(blocks.alias("blocks"), F.min("root").alias("a"), F.max("root").alias("b"), *same).filter("a < b")
    unsettled = unsettled.groupBy("lo", "n", "x", "y").agg(F.min("band").alias("band"), F.first("blocks").alias("blocks")).select("band", "blocks")
    placed = rooted.join(unsettled, "band").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    rest = _tiles(placed.join(nodes, "digest"), max_edits)
    return stars.unionByName(materialize(rest, "links")).distinct()
