"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

Subwords are the byte 2-, 3- and 4-grams of the lower-case text with everything but letters made a space. A text is the
mean of their embeddings. The model is trained by stochastic gradient descent in numpy on a bounded sample.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import slices, spare

UNKNOWN = "und"
BUCKETS = 1 << 16
DIMENSIONS = 16
#: Bounds of the training sample: documents for each language (expected), and bytes of a document.
SAMPLE_PER_LANGUAGE = 1500
SAMPLE_BYTES = 16_384
LANGUAGES = 1000
EPOCHS = 6
BATCH = 32
RATE = 4.0
#: Share of calibration documents that the rejection threshold keeps at least.
COVERAGE = 0.999
TEMPERATURES = np.geomspace(0.02, 20, 61)
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def subwords(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket arrays (one for each length of gram, BUCKETS for grams to leave out), and where each text's grams begin.

    A text has a space before it and spaces behind it; grams that would reach into the next text are left out, as are
    grams of spaces alone.
    """
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    spaced = pc.binary_join_element_wise(pa.scalar(" "), lower, pa.scalar("    "), "")
    offsets = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset: spaced.offset + len(spaced) + 1].astype(np.int64)
    data = _KEEP[np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]].astype(np.uint32)
    starts = offsets - offsets[0]
    grams, value = [], data.copy()
    for size in (2, 3, 4):
        value = value[:-1] * np.uint32(0x01000193) ^ data[size - 1:] if len(value) > 1 else np.zeros(0, np.uint32)
        mixed = (value * np.uint32(0x9E3779B1)) >> np.uint32(16)
        mixed = mixed.astype(np.int32)
        blank = np.lib.stride_tricks.sliding_window_view(data == 32, size).all(1) if len(data) >= size else np.zeros(0, bool)
        mixed[blank] = BUCKETS
        mixed = np.concatenate([mixed, np.full(len(data) - len(mixed), BUCKETS, np.int32)])
        for back in range(1, size):
            mixed[starts[1:] - back] = BUCKETS
        grams.append(mixed)
    return grams, starts


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # (BUCKETS + 1, languages) or, for many languages, (BUCKETS + 1, DIMENSIONS)
    head: np.ndarray | None
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        grams, starts = subwords(texts)
        width = self.table.shape[1]
        sums, counts = np.zeros((len(texts), width)), np.zeros(len(texts))
        # every text has spaces behind it, so no stretch is empty
        for gram in grams:
            row = 0
            while row < len(texts):
                last = max(row + 1, int(np.searchsorted(starts, starts[row] + (1 << 18), side="right")) - 1)
                part = gram[starts[row]:starts[last]]
                cut = starts[row:last] - starts[row]
                sums[row:last] += np.add.reduceat(self.table[part], cut, axis=0)
                counts[row:last] += np.add.reduceat((part < BUCKETS).astype(np.float64), cut)
                row = last
        mean = sums / np.maximum(counts, 1)[:, None]
        return (mean if self.head is None else mean @ self.head) + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The most probable label and its calibrated probability; ``und`` and 0 where a text is null or has no letter."""
        letters = np.asarray(pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}"))
        if not self.labels or not len(texts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        probable = softmax(self.logits(texts) / self.temperature)
        best = probable.argmax(1)
        return [self.labels[b] if l else UNKNOWN for b, l in zip(best, letters)], np.where(letters, probable.max(1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 1, epochs: int = EPOCHS, coverage: float = COVERAGE) -> LanguageModel:
    """Fit on four fifths of the sample; the rest sets the temperature and the rejection threshold."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS + 1, 1), np.float32), None, np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = order[: len(texts) // 5]
    used = order[len(texts) // 5:]
    target = np.array([names.index(x) for x in labels])

    rows = []
    for n in used:
        grams, _ = subwords(pa.array([texts[n]]))
        kinds, counts = np.unique(np.concatenate(grams), return_counts=True)
        real = kinds < BUCKETS
        rows.append((kinds[real], (counts[real] / max(1, counts[real].sum())).astype(np.float32), target[n]))
    embed = rng.normal(0, 0.1, (BUCKETS + 1, DIMENSIONS)).astype(np.float32)
    embed[BUCKETS] = 0
    head = rng.normal(0, 0.1, (DIMENSIONS, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    steps = epochs * -(-len(rows) // BATCH)
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            picked = [rows[k] for k in shuffled[a:a + BATCH]]
            kinds, where = np.unique(np.concatenate([p[0] for p in picked]), return_inverse=True)
            share = np.zeros((len(picked), len(kinds)), np.float32)
            share[np.repeat(np.arange(len(picked)), [len(p[0]) for p in picked]), where] = np.concatenate([p[1] for p in picked])
            hidden = share @ embed[kinds]
            error = softmax(hidden @ head + bias)
            error[np.arange(len(picked)), [p[2] for p in picked]] -= 1
            error /= len(picked)
            rate = RATE * (1 - step / steps)
            back = error @ head.T
            head -= rate * hidden.T @ error
            bias -= rate * 0.1 * error.sum(0)
            # a bucket holds a small share of a text, so embeddings take larger steps
            embed[kinds] -= rate * 20 * (share.T @ back)
            step += 1
    wide = len(names) > DIMENSIONS
    model = LanguageModel(names, embed if wide else embed @ head, head if wide else None, bias, 1.0, 0.0)
    if len(held):
        scores = model.logits(pa.array([texts[n] for n in held]))
        truth = target[held]
        # targets stay below 1 by what so few documents can show, else a faultless sample would make every score 1
        sure = (float((scores.argmax(1) == truth).sum()) + 1) / (len(held) + 2)
        losses = []
        for t in TEMPERATURES:
            true = softmax(scores / t)[np.arange(len(held)), truth].clip(1e-12, 1 - 1e-12)
            losses.append(-(sure * np.log(true) + (1 - sure) * np.log(1 - true)).mean())
        model.temperature = float(TEMPERATURES[int(np.argmin(losses))])
        # a label that is more probable than all others together is never rejected
        model.threshold = min(0.5, float(np.quantile(softmax(scores / model.temperature).max(1), 1 - coverage, method="lower")))
    return model


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       sample: int = SAMPLE_PER_LANGUAGE, max_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """Train on documents with a label that are not held out; null texts, labels and ids take no part.

    A bounded sample: about ``sample`` documents of each language, chosen by a hash of id and text, of ``max_bytes``
    bytes at most (longer ones are left out of the fit, not cut). More than LANGUAGES labels are an error.
    """
    texts, lang, key = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`"), F.col(f"`{id_col}`")
    usable = docs.filter(lang.isNotNull() & key.isNotNull() & ~held_out(id_col) & (F.octet_length(texts) <= max_bytes))
    counts = usable.groupBy(lang.alias("lang")).count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    if not counts:
        return train([], [])
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / r["count"]))])
    dice = F.pmod(F.xxhash64(key, texts), F.lit(1 << 30)) / float(1 << 30)
    rows = usable.filter(dice < F.element_at(shares, lang)).select(texts.alias("text"), lang.alias("lang")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], r["text"]))  # whatever order tasks end in
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``language``: pred, score (0 to 1) and rejected.

    Only the text is read for a prediction. A null text or one without a letter is ``und`` with score 0, and rejected;
    other texts are rejected when the calibrated score is below the model's threshold. No shuffle; every row stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the data

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, 0, 2 << 20):
                names, scores = m.predict(part.column(0))
                rejected = [n == UNKNOWN or s < m.threshold for n, s in zip(names, scores.tolist())]
                language = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                                                      ["pred", "score", "rejected"])
                yield pa.RecordBatch.from_arrays([*part.columns, language], [*part.schema.names, "language"])

    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(rest)])
    out = rows.mapInArrow(run, T.StructType(rows.schema.fields + T.StructType.fromDDL("language struct<pred:string,score:double,rejected:boolean>").fields))
    names = {c: f"c{n}" for n, c in enumerate(rest)} | {text_col: "text"}
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns], F.col("language").alias(spare(docs, "language")[0]))
