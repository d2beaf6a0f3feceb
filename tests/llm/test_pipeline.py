"""The whole pipeline against a brute-force version of its stages."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from colsmith.llm import bpe, language, mixing

LANGUAGES = {"en": "the and with of ing that was for", "fr": "le les des que est où été pour", "de": "der die das und ist über für nicht"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(21)
    rows = []
    for n in range(240):
        lang = rng.choice(sorted(LANGUAGES))
        text = " ".join(rng.choice(LANGUAGES[lang].split()) + str(rng.randrange(30)) * (rng.random() < 0.3) for _ in range(rng.randint(30, 90)))
        rows.append((n, text, lang, f"src{n % 4}" if n % 9 else None, len(text)))
    rows += [(1000 + n, rows[n][1], rows[n][2], "src1", rows[n][4]) for n in range(0, 60, 2)]
    rows += [(2000 + n, rows[n][1] + " and more", rows[n][2], "src2", 0) for n in range(0, 60, 3)]
    rows += [(3000, None, "en", "src0", None), (3001, "", "en", "src0", 0), (3002, "12 $$ 34", "de", "src0", 8)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def grams(text):
    words = text.lower().split()
    return {tuple(words[n:n + 5]) for n in range(max(1, len(words) - 4))}


def brute(rows, rejected):
    kept = [r for r in rows if r[0] not in rejected]
    best = {}
    for r in kept:
        if r[1] not in best or r[0] > best[r[1]][0]:
            best[r[1]] = r
    kept = sorted(best.values())
    root = list(range(len(kept)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    sets = [grams(r[1]) for r in kept]
    for a in range(len(kept)):
        for b in range(a + 1, len(kept)):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    classes = defaultdict(list)
    for n, r in enumerate(kept):
        classes[find(n)].append(r)
    kept = [max(c) for c in classes.values()]

    sizes = Counter()
    for r in kept:
        sizes[r[3]] += len(r[1].split())
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: n % 3 + 1 for n, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / total for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    copies = Counter()
    for s in names:
        order = sorted((hashlib.md5(f"mix:{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest(), len(r[1].split()), r[0]) for r in kept if r[3] == s)
        for repeat in range(3):
            at = 0
            for _, size, doc in order:
                copies[doc] += 2 * (repeat * sizes[s] + at) + size <= 2 * target[s]
                at += size
    return +copies


def test_pipeline_matches_brute_force(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    told = language.identify(docs, language.fit_language_model(docs)).collect()
    rejected = {r.doc_id for r in told if r.language.rejected}
    assert {3000, 3001, 3002} <= rejected and len(rejected) < 8
    out = corpus_pipeline.run(spark, path).collect()
    assert Counter(r.doc_id for r in out) == brute(rows, rejected)
    texts = {r[0]: r[1] for r in rows}
    coder = bpe.TreeCodec(bpe.load_ranks()).coder
    for r in out:
        raw = np.array(coder.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert bytes(r.ids) == raw and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_keep_the_columns_and_accept_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.filter("false"), folder[0])
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.filter("false"), folder[0]).count() == 0
    assert mixing.MAX_REPEATS == 3
