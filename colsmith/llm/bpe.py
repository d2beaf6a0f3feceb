"""Byte-level BPE encoding and decoding by tree reduction over halves of a text.

A leaf is encoded as it stands. Two neighbours are joined by encoding a window around their border again, from the
last place in the left text to the first place in the right text at which the split pattern must start a new match
whatever stands before: there, tokens outside the window cannot change. The window grows until such places are found.
"""
from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import slices

LEAF_CHARS = 8192
FIRST_WINDOW = 64
RANKS = "byte_bpe_50k.tiktoken"
#: White space after a letter, number or mark, and changes between plain letters and digits. No alternative of the
#: pattern matches across such a place (contractions hold only letters after the apostrophe), and none looks further
#: than one character past its match, so a match starts here in any text that holds the two characters.
BORDER = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n\t])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


class TreeCodec:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: bytes, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF_CHARS):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.leaf = leaf
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = {n: t for t, n in table.items()}

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.coder.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._encode(text, start, middle), self._encode(text, middle, end))

    def _join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        low, high = self._last_border(text, start, middle), self._first_border(text, middle, end)
        keep = self._count(left, len(text[low:middle].encode()), reverse=True)
        skip = self._count(right, len(text[middle:high].encode()))
        window = self.coder.encode_ordinary(text[low:high])
        del left[len(left) - keep:]
        left.extend(window)
        left.extend(right[skip:] if skip else right)
        return left

    @staticmethod
    def _last_border(text: str, start: int, end: int) -> int:
        """The last border inside start..end, or its start. Windows double until one is found."""
        width = FIRST_WINDOW
        while True:
            low = max(start, end - width)
            # both characters of a border lie left of ``end``
            found = [m.start() for m in BORDER.finditer(text, low, end) if m.start() > low and m.start() < end]
            if found:
                return found[-1]
            if low == start:
                return start
            width *= 2

    @staticmethod
    def _first_border(text: str, start: int, end: int) -> int:
        """The first border inside start..end, or its end."""
        width = FIRST_WINDOW
        while True:
            high = min(end, start + width)
            for m in BORDER.finditer(text, start, high):
                if start < m.start() < high:
                    return m.start()
            if high == end:
                return end
            width *= 2

    def _count(self, ids: list[int], size: int, reverse: bool = False) -> int:
        """How many tokens at the beginning or end hold ``size`` bytes; a border is always a token's border."""
        n = held = 0
        while held < size:
            held += len(self.bytes_of[ids[-1 - n] if reverse else ids[n]])
            n += 1
        if held != size:
            raise AssertionError("a border of the split pattern lies inside a token")
        return n

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ``ids``; halves are decoded and concatenated up the tree."""
        if len(ids) <= self.leaf:
            return self.coder.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@functools.lru_cache(maxsize=4)
def _codec(ranks: bytes, leaf: int) -> TreeCodec:
    return TreeCodec(ranks, leaf=leaf)


def load_ranks(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: bytes | None = None,
                     leaf: int = LEAF_CHARS, with_ids: bool = True) -> DataFrame:
    """Token ids of every whole text, and a digest of the bytes they decode to.

    Returns ``id_col, n_tokens, ids`` (little-endian unsigned 32-bit integers, unless ``with_ids`` is off),
    ``ids_sha256, decoded_sha256``. A null text is empty: no ids, digests of nothing. Every row gives a row, also null or repeated ids;
    other columns are left out. Texts do not meet, so nothing is shuffled.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks or load_ranks())  # a vocabulary file, not data
    id_type = docs.schema[id_col].dataType
    kind = id_type.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, leaf)
        for batch in batches:
            for part in slices(batch, 1):
                counts, packed, digests, decoded = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = codec.encode(text or "")
                    raw = np.array(ids, "<u4").tobytes()
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if with_ids:
                        packed.append(raw)
                columns = [part.column(0), pa.array(counts, pa.int64())] + ([pa.array(packed, pa.binary())] if with_ids else [])
                names = ["id", "n_tokens"] + ["ids"] * with_ids + ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {kind}, n_tokens long, {'ids binary, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(encode, schema).withColumnRenamed("id", id_col)
