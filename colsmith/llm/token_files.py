"""Token-id files: blocks of concatenated ids with Elias-Fano coded document boundaries.

A block holds the ids of consecutive documents as one little-endian array (two bytes an id where the vocabulary allows
it) and the documents' end offsets as an Elias-Fano sequence: the low bits of each offset in a packed array, the high
bits in unary. ``select`` on the unary part gives any offset, so no table of 64-bit offsets is stored. Blocks are rows
of a Parquet table written by Spark, so the files may lie in any store that Spark reaches.
"""
from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import new_path, slices

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
BLOCK_IDS = 1 << 20
#: Bytes of text whose segments are looked up together, and segments a worker remembers (a cache: results do not depend on it).
LOOKUP_BYTES = 8 << 20
REMEMBERED = 700_000
MAGIC = b"EFB1"


# ---- Elias-Fano ------------------------------------------------------------------------------------------------------

def ef_encode(values: np.ndarray, universe: int) -> bytes:
    """Rising ``values`` (0..universe) as header, packed low bits and unary high bits."""
    n = len(values)
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    values = values.astype(np.uint64)
    bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8).ravel()
    lows = np.packbits(bits, bitorder="little").tobytes()
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    unary = np.zeros(n + (universe >> low) + 1, np.uint8)
    unary[high] = 1
    highs = np.packbits(unary, bitorder="little").tobytes()
    return struct.pack("<QQBQ", n, universe, low, len(lows)) + lows + highs


class EliasFano:
    """Random access to a coded sequence. One sample of the unary bits in 64 ones speeds up ``select``."""

    HEADER = struct.calcsize("<QQBQ")
    STEP = 64

    def __init__(self, raw: bytes):
        self.n, self.universe, self.low, size = struct.unpack_from("<QQBQ", raw)
        self.lows = np.frombuffer(raw, np.uint8, size, self.HEADER)
        self.highs = np.frombuffer(raw, np.uint8, offset=self.HEADER + size)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.highs), dtype=np.int64)])
        # the byte in which each STEP-th one lies
        self.samples = np.searchsorted(ones, np.arange(0, self.n, self.STEP), side="right") - 1
        self.before = ones[self.samples]

    def select(self, rank: int) -> int:
        """The value with this rank."""
        if not 0 <= rank < self.n:
            raise IndexError(rank)
        at = self.samples[rank // self.STEP]
        seen = int(self.before[rank // self.STEP])
        while True:
            held = int(self.highs[at]).bit_count()
            if seen + held > rank:
                break
            seen += held
            at += 1
        bit = int(np.flatnonzero(np.unpackbits(self.highs[at:at + 1], bitorder="little"))[rank - seen])
        value = int(at) * 8 + bit - rank
        if self.low:
            first = rank * self.low
            window = int.from_bytes(self.lows[first // 8: (first + self.low + 7) // 8].tobytes(), "little")
            value = value << self.low | (window >> (first % 8)) & ((1 << self.low) - 1)
        return value

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n].astype(np.int64)
        values = (ones - np.arange(self.n)) << self.low
        if self.low and self.n:
            bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            values |= (bits.astype(np.int64) << np.arange(self.low)).sum(1)
        return values


def pack_block(ids: np.ndarray, ends: np.ndarray, width: int) -> bytes:
    """ids, and the offset after each document's last id."""
    coded = ef_encode(ends, len(ids))
    return MAGIC + struct.pack("<BQQ", width, len(ids), len(coded)) + coded + ids.astype(f"<u{width}").tobytes()


class Block:
    """A packed block: ``doc(k)`` finds its offsets by two selects and reads only its ids."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        self.width, self.n_ids, size = struct.unpack_from("<BQQ", raw, 4)
        at = 4 + struct.calcsize("<BQQ")
        self.ends = EliasFano(raw[at:at + size])
        self.ids = np.frombuffer(raw, f"<u{self.width}", self.n_ids, at + size)

    def doc(self, rank: int) -> np.ndarray:
        return self.ids[self.ends.select(rank - 1) if rank else 0: self.ends.select(rank)]


# ---- encoding --------------------------------------------------------------------------------------------------------

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not (_LETTER[c] or _DIGIT[c] or c == 39)]] = True
_STOP = _MARK.copy()
_STOP[[10, 32]] = True


def borders(data: np.ndarray) -> np.ndarray:
    """Byte positions in UTF-8 ``data`` before which the pre-tokenizer always ends a piece.

    They are a space or line feed after a character that is surely no white space, and a mark (no apostrophe) after a
    plain letter. White space outside ASCII ends in bytes that follow C2, E1, E2 or E3; after such letters no border
    is claimed, which only makes segments longer.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    # only what stands before a blank or mark is looked at
    at = np.flatnonzero(_STOP[data[1:]])
    previous, current = data[at], data[at + 1]
    lead2 = np.where(at > 0, data[at - 1], 0)
    lead3 = np.where(at > 1, data[at - 2], 0)
    safe = (previous > 32) & (previous != 127)
    safe &= ~((previous >= 128) & ((lead2 == 0xC2) | (lead3 == 0xE1) | (lead3 == 0xE2) | (lead3 == 0xE3)))
    return at[np.where(_MARK[current], _LETTER[previous], safe)] + 1


class SegmentEncoder:
    """Encodes whole texts through the tokenizers library, each distinct segment between borders once.

    Texts are cut where the pre-tokenizer always cuts, so the ids of a text are those of its segments in a row. New
    segments are joined to long texts (again at such places) and encoded there; byte lengths of the ids tell them apart.
    With ``added_tokens`` the vocabulary's added tokens are found in texts, as the library does by default; texts that hold one
    go through the library whole. Without, such literals are plain text.
    """

    def __init__(self, vocabulary: str, added_tokens: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.whole = Tokenizer.from_str(vocabulary)
        self.literals = sorted(t.content for t in self.whole.get_added_tokens_decoder().values()) if added_tokens else []
        # segments hold no added token, and parts of one are plain text
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        # byte-level tokens have one character for each byte
        self.token_bytes = np.array([len(self.tokenizer.id_to_token(n) or "") for n in range(size)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat: list[np.ndarray] = [np.zeros(0, f"<u{self.width}")]
        self.starts: list[np.ndarray] = [np.zeros(1, np.int64)]

    def _learn(self, segments: list[bytes]) -> None:
        """Ids of new segments. Every one begins with a blank or mark or a text's own beginning."""
        own, run = [], []
        for s in segments:
            # only a segment that starts with a space or line feed and ends in a graphic character can follow another
            (run if s[:1] in (b" ", b"\n") and 32 < s[-1] < 127 and s[-1] != 39 else own).append(s)
        texts = [b"".join(run[n:n + 20_000]) for n in range(0, len(run), 20_000)] + own
        encoded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False) if texts else []
        base = int(self.starts[-1][-1])
        joined = [np.array(e.ids, np.uint32) for e in encoded]
        flat = np.concatenate(joined) if joined else np.zeros(0, np.uint32)
        ordered = run + own
        ends = np.cumsum(np.fromiter(map(len, ordered), np.int64, len(ordered)))
        covered = np.cumsum(self.token_bytes[flat])
        at = np.searchsorted(covered, ends)
        if len(ends) and not np.array_equal(covered[at], ends):
            raise AssertionError("a border of the pre-tokenizer lies inside a token")
        for s in ordered:
            self.known[s] = len(self.known)
        self.flat.append(flat.astype(f"<u{self.width}"))
        self.starts.append(base + at + 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in a row, and the number of ids of each text."""
        texts = pa.compute.fill_null(texts, "")
        holds = np.zeros(len(texts), bool)
        for literal in self.literals:
            holds |= pa.compute.match_substring(texts, literal).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self._encode(texts)
        ids, sizes = self._encode(pa.compute.if_else(pa.array(holds), "", texts))
        rows = np.flatnonzero(holds)
        coded = [np.array(e.ids, ids.dtype) for e in self.whole.encode_batch_fast(texts.take(pa.array(rows)).to_pylist(), add_special_tokens=False)]
        # these rows have no ids so far
        before = (np.cumsum(sizes) - sizes)[rows]
        ids = np.insert(ids, np.repeat(before, [len(c) for c in coded]), np.concatenate(coded))
        sizes[rows] = [len(c) for c in coded]
        return ids, sizes

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset: texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
        edges = (offsets - offsets[0]).astype(np.int64)
        if not len(data):
            return np.zeros(0, f"<u{self.width}"), np.zeros(len(texts), np.int64)
        # marked instead of sorted: rising, and each position once
        cut = np.zeros(len(data) + 1, bool)
        cut[borders(data)] = True
        cut[edges] = True
        cuts = np.flatnonzero(cut)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        fresh = [s for s in kinds if s not in self.known]
        if fresh:
            self._learn(fresh)
        if len(self.flat) > 1:
            self.flat, self.starts = [np.concatenate(self.flat)], [np.concatenate(self.starts)]
        flat, starts = self.flat[0], self.starts[0]
        number = np.fromiter((self.known[s] for s in kinds), np.int64, len(kinds))[coded.indices.to_numpy()]
        first, size = starts[number], starts[number + 1] - starts[number]
        after = np.cumsum(size)
        where = np.repeat(first - (after - size), size) + np.arange(int(after[-1]))
        held = np.concatenate([[0], after])[np.searchsorted(cuts, edges)]
        return flat[where], np.diff(held)


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> SegmentEncoder:
    return SegmentEncoder(vocabulary, added_tokens=True)


# ---- writing and reading ---------------------------------------------------------------------------------------------

def write_token_files(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> str:
    """Encode every whole text as the tokenizers library does by default (added tokens in texts are found), append ``end_id`` and write blocks in rising id order; returns the path.

    Null ids come first, texts of equal ids follow in the order of a hash of the text and then the text itself; a null
    text is empty and holds the end id alone. Documents are range-partitioned by id; a partition's blocks hold about
    ``block_ids`` ids (a longer document has a block to itself). Each row has the range (``shard``), the block's
    number and first id position in it, and its documents' ids.
    """
    spark: SparkSession = docs.sparkSession
    path = path or new_path(spark, "token-files")
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file, not data

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names: list[pa.Array] = []
        number = before = waiting = 0
        shard = None

        def flush() -> pa.RecordBatch:
            nonlocal held, counts, names, number, before, waiting
            sizes = np.concatenate(counts)
            ids = np.concatenate(held)
            keys = pa.concat_arrays(names)
            row = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()),
                pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                pa.array([pack_block(ids, np.cumsum(sizes), encoder.width)], pa.binary())],
                ["shard", "block", "start", "n_ids", "doc_ids", "payload"])
            number, before = number + 1, before + len(ids)
            held, counts, names, waiting = [], [], [], 0
            return row

        for batch in batches:
            for part in slices(batch, 1, LOOKUP_BYTES):
                shard = part.column(2)[0].as_py()
                ids, sizes = encoder.encode(part.column(1))
                keys = part.column(0).cast(pa.int64())
                ends = np.cumsum(sizes)
                # the end id goes in behind the last id of each document
                ids = np.insert(ids, ends, end_id)
                sizes = sizes + 1
                ends = ends + np.arange(1, len(sizes) + 1)
                row = 0
                while row < len(sizes):
                    done = int(ends[row - 1]) if row else 0
                    until = max(row + 1, int(np.searchsorted(ends, done + block_ids - waiting, side="right")))
                    if waiting and waiting + int(ends[until - 1]) - done > block_ids:
                        yield flush()
                        continue
                    held.append(ids[done:int(ends[until - 1])])
                    counts.append(sizes[row:until])
                    names.append(keys.slice(row, until - row))
                    waiting += int(ends[until - 1]) - done
                    row = until
        if waiting:
            yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie", "text")
    rows = rows.select("id", "text", F.spark_partition_id().alias("shard"))
    rows.mapInArrow(pack, "shard int, block int, start long, n_ids long, doc_ids array<long>, payload binary").write.parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str, id_name: str = "doc_id") -> DataFrame:
    """``id_name, start, ids`` of every document, in the files' own layout; start counts the ids of all documents before."""
    return _read(spark, path, id_name, "ids binary", lambda ids: pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()))


def token_summary(spark: SparkSession, path: str, id_name: str = "doc_id") -> DataFrame:
    """``id_name, start, n_tokens, ids_crc32`` of every document, read from the files."""
    return _read(spark, path, id_name, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))


def _read(spark: SparkSession, path: str, id_name: str, field: str, make) -> DataFrame:
    blocks = spark.read.parquet(path)
    # one row for each range of the writer
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("shard", before.cast("long").alias("shard_start"))

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch.column(2)[row].as_py())
                keys = batch.column(1)[row].values
                ends = block.ends.all()
                firsts = np.concatenate([[0], ends[:-1]])
                base = batch.column(0)[row].as_py()
                parts = [block.ids[a:b] for a, b in zip(firsts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([keys, pa.array(firsts + base), pa.array(ends - firsts), make(parts)],
                                                 ["doc", "start", "n_tokens", field.split()[0]])

    rows = blocks.select("shard", "start", "doc_ids", "payload").join(starts, "shard")
    rows = rows.select((F.col("start") + F.col("shard_start")).alias("start"), "doc_ids", "payload")
    return rows.mapInArrow(unpack, f"doc long, start long, n_tokens long, {field}").withColumnRenamed("doc", id_name)
