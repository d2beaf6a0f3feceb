"""Extraction, language, mixing, tokens and fingerprints against brute force, round trips and held-out accuracy."""
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from colsmith.llm import bpe, edit_fingerprint, html_text, language, mixing, token_files
from colsmith.llm.catalog import OP3_SQL
from colsmith.llm.edit_fingerprint import edit_distance

ODD = "ab1 2'srelTZ\n\t .,é　\xa0ñ🙂​-_́ß"
SCHEMA = "doc_id long, text string, source string, lang string, size int, mix string"


def odd_texts(seed, count=60, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, most))) for _ in range(count)]


def table(spark, texts, ids=None, sources=None, langs=None):
    ids = ids if ids is not None else list(range(len(texts)))
    return spark.createDataFrame([(i, t, (sources or {}).get(i, "s"), (langs or {}).get(i), 1, "m") for i, t in zip(ids, texts)], SCHEMA).repartition(5)


# ---- byte-level BPE --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("leaf", [2, 7, 64])
def test_tree_encoding_equals_whole_encoding(leaf):
    codec = bpe.TreeCodec(bpe.load_ranks(), leaf=leaf)
    for text in [*odd_texts(leaf, 1500), "x" * 3000, " " * 900 + "a", "it's we'll " * 300, "1a2b" * 200, "\n\n \n" * 100]:
        ids = codec.encode(text)
        assert ids == codec.coder.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_encode_documents(spark):
    texts = [*odd_texts(1), None, "", "word " * 20_000]
    rows = {r.doc_id: r for r in bpe.encode_documents(table(spark, texts), leaf=256).collect()}
    coder = bpe.TreeCodec(bpe.load_ranks()).coder
    for n, text in enumerate(texts):
        raw = np.array(coder.encode_ordinary(text or ""), "<u4").tobytes()
        assert rows[n].n_tokens == len(raw) // 4 and bytes(rows[n].ids) == raw
        assert rows[n].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert rows[n].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert isinstance(coder, tiktoken.Encoding)
    assert bpe.encode_documents(table(spark, ["a", "a"], [None, None])).count() == 2
    assert bpe.encode_documents(table(spark, ["a"]).filter("false")).count() == 0


# ---- token files -----------------------------------------------------------------------------------------------------

def test_elias_fano_selects_every_value():
    rng = np.random.default_rng(2)
    for n, universe in ((0, 0), (1, 0), (1, 10**6), (500, 600), (300, 10**9), (64, 63), (200, 0)):
        values = np.sort(rng.integers(0, universe + 1, n))
        raw = token_files.ef_encode(values, universe)
        coded = token_files.EliasFano(raw)
        assert coded.all().tolist() == values.tolist() == [coded.select(k) for k in range(n)]
        if n > 100:
            assert 8 * len(raw) <= n * (2 + max(0, math.ceil(math.log2(max(1, universe / n))))) + 400


def reference_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_segment_encoder_equals_whole_texts():
    with open(public_tokenizers.path(token_files.VOCABULARY), encoding="utf-8") as f:
        encoder = token_files.SegmentEncoder(f.read())
    texts = [*odd_texts(3, 3000), "<|endoftext|> x <|endoftext|>", None, "", " ", "a'b c's 'll", "don't,stop.now (a) [b] 3.5%x"]
    for seed in (1, 2):
        ids, sizes = encoder.encode(pa.array(texts))
        expected = reference_ids(texts)
        assert sizes.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [x for e in expected for x in e]
        random.Random(seed).shuffle(texts)


def test_segments_are_cut_without_sorting_positions(monkeypatch):
    """Positions of cuts are marked: sorting or hashing them took a third of the encoder's time."""
    with open(public_tokenizers.path(token_files.VOCABULARY), encoding="utf-8") as f:
        encoder = token_files.SegmentEncoder(f.read())

    def refused(*_, **__):
        raise AssertionError("positions are sorted")

    texts = [*odd_texts(5, 200), None, "", "a\u00a0 b\u3000 c\u2003 d", "x", ""]
    monkeypatch.setattr(token_files.np, "unique", refused)
    ids, sizes = encoder.encode(pa.array(texts))
    monkeypatch.undo()
    expected = reference_ids(texts)
    assert sizes.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [x for e in expected for x in e]


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_token_files_round_trip(spark, tmp_path, block):
    texts = [*odd_texts(4, 80, 200), None, "", "long word " * 300]
    ids = [n * 7 - 50 for n in range(len(texts))]
    path = token_files.write_token_files(table(spark, texts, ids), str(tmp_path / "files"), block_ids=block)
    rows = {r.doc_id: r for r in token_files.token_summary(spark, path).collect()}
    whole = {r.doc_id: r for r in token_files.read_token_files(spark, path).collect()}
    at = 0
    for i, expected in zip(ids, reference_ids(texts)):
        raw = np.array(expected + [0], "<u4").tobytes()
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(expected) + 1, zlib.crc32(raw))
        assert (whole[i].start, bytes(whole[i].ids)) == (at, raw)
        at += len(expected) + 1
    one = token_files.Block(bytes(spark.read.parquet(path).filter(F.size("doc_ids") >= 1).orderBy("shard", "block").first().payload))
    assert one.doc(0).tolist() == reference_ids(texts)[0] + [0]


def test_token_files_find_added_tokens_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    rng = random.Random(16)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny", "<|endoftext", None, "", *odd_texts(17, 20)]
    texts += [a + "<|endoftext|>" + b for a, b in zip(odd_texts(18, 40), odd_texts(19, 40))]
    rng.shuffle(texts)
    path = token_files.write_token_files(table(spark, texts), str(tmp_path / "files"))
    rows = {r.doc_id: r for r in token_files.read_token_files(spark, path).collect()}
    at = 0
    for n, text in enumerate(texts):
        expected = plain.encode(text or "", add_special_tokens=False).ids + [0]
        assert (rows[n].start, np.frombuffer(rows[n].ids, "<u4").tolist()) == (at, expected)
        at += len(expected)


def test_token_files_edge_tables(spark, tmp_path):
    path = token_files.write_token_files(table(spark, ["a b", "a b", "c"], [None, None, 3]), str(tmp_path / "a"))
    rows = token_files.token_summary(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 3), (None, 3, 3), (3, 6, 2)]
    path = token_files.write_token_files(table(spark, ["a"]).filter("false"), str(tmp_path / "b"))
    assert token_files.token_summary(spark, path).count() == 0


# ---- fingerprints ----------------------------------------------------------------------------------------------------

def test_edits_and_successors_match_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefg hij") for _ in range(rng.randint(0, 300))) for _ in range(90)] + [None, "", "x", "🙂ñ" * 50]
    ids = rng.sample(range(10_000), len(texts))
    rows = {r.doc_id: r for r in edit_fingerprint.fingerprints_with_edits(table(spark, texts, ids)).collect()}
    assert len(rows) == len(texts)
    order = sorted(zip(ids, texts), reverse=True)
    walk = edit_fingerprint.walk()
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        own, changed, following = walk.fingerprints([text, edited, after])
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own.hex(), changed.hex())
        assert (r.near_edited, r.near_next) == (edit_fingerprint.likeness(own, changed), edit_fingerprint.likeness(own, following))


def test_successors_with_one_row_repeats_and_nulls(spark):
    make = edit_fingerprint.fingerprints_with_edits
    assert make(table(spark, ["abc"])).first().edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    assert make(table(spark, ["a"]).filter("false")).count() == 0
    rows = make(table(spark, ["aaa", "bbb", "ccc", "ddd"], [5, 5, None, None])).collect()
    assert len(rows) == 4 and len({r.edited_sha256 for r in rows}) == 4


def test_an_id_with_most_rows_is_split(spark):
    rng = random.Random(9)
    ids = [None] * 200 + [7] * 150 + list(range(1000, 1100))
    texts = [f"{n} " + "".join(rng.choice("abc de") for _ in range(rng.randint(0, 40))) for n in range(len(ids))]
    docs = table(spark, texts, ids)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = edit_fingerprint.fingerprints_with_edits(docs).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ranked = sorted(docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect(), reverse=True,
                    key=lambda r: (-(1 << 63) if r.doc_id is None else r.doc_id, r.tie))
    edited = []
    for r, after in zip(ranked, ranked[1:] + ranked[:1]):
        cut = len(r.text) // 3
        edited.append((r.doc_id, hashlib.sha256((r.text[:len(r.text) - cut] + after.text[:cut]).encode()).hexdigest()))
    assert sorted(map(repr, edited)) == sorted(repr((r.doc_id, r.edited_sha256)) for r in rows)
    assert len({r.part for r in rows if r.doc_id is None}) > 1 and len({r.part for r in rows if r.doc_id == 7}) > 1


def test_walks_together_and_alone_agree(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc défg") for _ in range(rng.randint(0, 400))) for _ in range(70)]
    walk = edit_fingerprint.walk()
    together = walk.fingerprints(texts)
    monkeypatch.setattr(edit_fingerprint, "TOGETHER", 1000)
    assert walk.fingerprints(texts) == together


def test_likeness_follows_edits():
    rng = random.Random(7)
    texts = ["".join(rng.choice("etaoin shrdlu") for _ in range(2000)) for _ in range(40)]
    one = [t[:900] + "q" + t[900:] for t in texts]
    half = [t[:1000] + u[1000:] for t, u in zip(texts, texts[1:] + texts[:1])]
    walk = edit_fingerprint.walk()
    prints = walk.fingerprints(texts)
    mean = lambda other: np.mean([edit_fingerprint.likeness(a, b) for a, b in zip(prints, walk.fingerprints(other))])
    assert mean(texts) == 1 and mean(one) > 0.85 and 0.4 < mean(half) < 0.65 and mean(texts[1:] + texts[:1]) < 0.2


def test_near_texts_are_verified(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("etaoin shrdlu") for _ in range(300))
    other = "".join(rng.choice("etaoin shrdlu") for _ in range(300))
    rows = edit_fingerprint.near_texts(table(spark, [base, base + "!", base[:200] + "?" + base[200:], other, base, "", None])).collect()
    name = {hashlib.sha256(t.encode()).hexdigest(): k for k, t in {"base": base, "end": base + "!", "mid": base[:200] + "?" + base[200:], "other": other}.items()}
    links = {frozenset((name[r.text_sha256], name[r.near_sha256])) for r in rows}
    assert all("other" not in x for x in links) and len(set().union(*links)) == 3
    assert all(r.edits <= 2 for r in rows)


@pytest.mark.parametrize("block", [4, 500])
def test_near_text_classes_find_every_link_up_to_the_limit(spark, monkeypatch, block):
    monkeypatch.setattr(edit_fingerprint, "BLOCK_TEXTS", block)
    rng = random.Random(12)
    texts = []
    for _ in range(8):
        text = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(100, 300))]
        texts.append("".join(text))
        for share in (0.02, 0.05, 0.1, 0.15, 0.19):
            copy = list(text)
            for _ in range(int(len(text) * share)):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
            texts.append("".join(copy))
    group = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if group[a] != group[b] and edit_distance(texts[a], texts[b], int(max(len(texts[a]), len(texts[b])) * 0.2)) is not None:
                    group[a] = group[b] = min(group[a], group[b])
    rows = edit_fingerprint.near_text_classes(table(spark, texts), every_pair=True).collect()
    got, want = {}, {}
    for r in rows:
        got.setdefault(r.class_sha256, set()).add(r.doc_id)
    for n, g in enumerate(group):
        want.setdefault(g, set()).add(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, got.values())) == 6


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_matches_brute_force():
    rng = random.Random(9)
    for _ in range(400):
        a, b = ("".join(rng.choice("ab🙂") for _ in range(rng.randint(0, 14))) for _ in range(2))
        real = plain_edits(a, b)
        for limit in (0, 2, 5, 20):
            assert edit_distance(a, b, limit) == (real if real <= limit else None)
    long = "".join(rng.choice("abcd ") for _ in range(3000))
    assert edit_distance(long, "x" + long[:1000] + long[1003:], 10) == 4


@pytest.mark.parametrize("block", [3, 500])
def test_near_text_classes_match_brute_force(spark, monkeypatch, block):
    """Chains of texts, whose ends are no links of each other, hang together as by all links among texts that share a band."""
    monkeypatch.setattr(edit_fingerprint, "BLOCK_TEXTS", block)
    rng = random.Random(10)
    texts = []
    for _ in range(4):
        text = "".join(rng.choice("etaoin shrdlu") for _ in range(150))
        for _ in range(12):
            texts.append(text)
            at = rng.randrange(90, 130)
            text = text[:at] + "".join(rng.choice("etaoin shrdlu") for _ in range(12)) + text[at + rng.randint(8, 14):]
    most = 0.1
    size = edit_fingerprint.BAND_SLOTS
    prints = edit_fingerprint.walk().fingerprints(texts)
    bands = [{(n, p[n:n + size]) for n in range(0, 128, size)} for p in prints]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if bands[a] & bands[b]
             and plain_edits(texts[a], texts[b]) <= int(max(len(texts[a]), len(texts[b])) * most)]
    group = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert any((a, b) not in links for a in range(len(texts)) for b in range(a) if group[a] == group[b])
    docs = table(spark, [*texts, texts[0], "", None], [*range(len(texts)), None, 900, 901])
    rows = edit_fingerprint.near_text_classes(docs, most).collect()
    assert len(rows) == len(texts) + 3
    got = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id < 900:
            got.setdefault(r.class_sha256, set()).add(r.doc_id)
    want = {}
    for n, g in enumerate(group):
        want.setdefault(g, set()).add(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert {r.class_sha256 for r in rows if r.doc_id in (900, 901)} == {hashlib.sha256(b"").hexdigest()}
    assert edit_fingerprint.near_text_classes(docs.filter("false")).count() == 0


# ---- language --------------------------------------------------------------------------------------------------------

LANGUAGES = {"en": "the and with of ing that was for", "fr": "le les des que est où été pour", "de": "der die das und ist über für nicht", "es": "el los que una por año niño con"}


def language_table(spark, count=400):
    rng = random.Random(11)
    texts, langs = [], {}
    for n in range(count):
        lang = rng.choice(sorted(LANGUAGES))
        texts.append(" ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(rng.randint(8, 60))))
        langs[n] = lang
    return table(spark, texts + [None, "123 $$$", ""], langs=langs), langs


def test_language_accuracy_on_held_out_documents(spark):
    docs, langs = language_table(spark)
    model = language.fit_language_model(docs)
    told = language.identify(docs, model).select("*", language.held_out("doc_id").alias("held")).collect()
    assert len(told) == len(langs) + 3
    held = [r for r in told if r.held and r.doc_id in langs]
    assert len(held) > 50 and np.mean([r.language.pred == langs[r.doc_id] for r in held]) > 0.97
    assert {r.held for r in told} == {True, False}
    for r in told:
        assert 0 <= r.language.score <= 1
        assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id not in langs:
            assert r.language.pred == "und" and r.language.rejected and r.language.score == 0
    assert sum(r.language.rejected for r in told if r.doc_id in langs) <= 2


def test_language_model_sees_no_held_out_document(spark):
    docs, langs = language_table(spark)
    wrong = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    assert language.fit_language_model(wrong).labels == sorted(LANGUAGES)


def test_language_without_labels(spark):
    docs = table(spark, ["text", None])
    model = language.fit_language_model(docs)
    assert {r.language.pred for r in language.identify(docs, model).collect()} == {"und"}
    assert language.identify(docs.filter("false"), model).count() == 0


def test_language_scores_do_not_depend_on_the_batch():
    rng = random.Random(12)
    texts = [" ".join(rng.choice(LANGUAGES[x].split()) for _ in range(9)) for x in "en fr de es".split() * 30]
    model = language.train(texts, "en fr de es".split() * 30)
    whole = model.predict(pa.array([*texts, "", None, "x"]))[1]
    for n in (0, 7, 50):
        assert model.predict(pa.array([texts[n]]))[1][0] == pytest.approx(whole[n], abs=1e-9)


# ---- mixing ----------------------------------------------------------------------------------------------------------

def brute_targets(sizes, weights=(1, 2, 3), repeats=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(repeats * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: repeats * sizes[s] if s in full else left * weight[s] / total for s in names}
        over = {s for s in names if s not in full and target[s] > repeats * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def mixed_table(spark, seed):
    rng = random.Random(seed)
    names = [f"src{n}" for n in range(9)] + ["é", None]
    sources, texts = {}, []
    for n in range(500):
        s = names[min(int(rng.expovariate(0.5)), len(names) - 1)] if n > 20 else names[n % len(names)]
        sources[n] = s
        texts.append(" ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 3, 10, 40]))))
    return table(spark, texts, sources=sources), sources, texts


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, seed):
    docs, sources, texts = mixed_table(spark, seed)
    placed = mixing.assign_positions(docs)
    assert placed.columns[:-1] == docs.columns
    rows = {r.doc_id: r[-1] for r in placed.collect()}
    sizes = {s: sum(len(t.split()) for n, t in enumerate(texts) if sources[n] == s) for s in set(sources.values())}
    targets = brute_targets(sizes)
    assert len(rows) == len(texts)
    taken = dict.fromkeys(sizes, 0)
    for n, m in rows.items():
        assert m.size == len(texts[n].split()) and m.source_size == sizes[sources[n]]
        assert m.target == pytest.approx(targets[sources[n]])
        assert m.taken == m.copies * m.size and m.copies <= 3 and len(m.positions) == m.copies
        assert list(m.positions) == sorted(m.positions) and all(0 <= p <= 1 for p in m.positions)
        taken[sources[n]] += m.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 40


def test_positions_follow_the_schedules(spark):
    docs, sources, texts = mixed_table(spark, 3)
    rows = mixing.assign_positions(docs).collect()
    names = sorted({s for s in sources.values() if s is not None}) + [None]
    for rank, name in enumerate(names):
        schedule = mixing.SCHEDULES[rank % 3]
        mine = [(p, r[-1].size) for r in rows if r.source == name for p in r[-1].positions]
        total = sum(size for _, size in mine)
        for time in (0.25, 0.5, 0.75):
            if total > 1000:
                assert sum(size for p, size in mine if p <= time) / total == pytest.approx(mixing.demand_check(schedule, time), abs=0.06)


def test_inverse_of_demand(spark):
    schedules = [*mixing.SCHEDULES, ((0, 0), (0.5, 2), (1, 0)), ((0, 1), (0.3, 0), (1, 4))]
    shares = spark.createDataFrame([(n / 50,) for n in range(51)], "share double")
    for schedule in schedules:
        for r in shares.select("share", mixing.invert_demand(F.col("share"), schedule).alias("t")).collect():
            assert mixing.demand_check(schedule, r.t) == pytest.approx(r.share, abs=1e-9)


def test_curriculum_is_sorted_and_whole(spark):
    docs, _, _ = mixed_table(spark, 4)
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r[-1].copies for r in mixing.assign_positions(docs).collect()}
    got = [r.doc_id for r in out.collect()]
    assert sorted(got) == sorted(n for n, c in copies.items() for _ in range(c))
    assert got == [r.doc_id for r in mixing.curriculum(docs.repartition(3)).collect()] or len(got) == out.count()


def test_mixing_without_ids_depends_on_texts_alone(spark):
    """Rows without an id are ordered by their texts: reruns on other partitions take the same ones."""
    rows = [(None, " ".join([f"w{n}"] * (1 + n % 3)), "web") for n in range(600)] + [(1, f"one text of many {n}", "code") for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    takes = [sorted((r.text, r.mix.copies) for r in mixing.assign_positions(docs.repartition(n)).collect()) for n in (1, 7)]
    assert takes[0] == takes[1] and len({c for _, c in takes[0]}) > 1


def test_mixing_edge_tables(spark):
    assert mixing.assign_positions(table(spark, ["a"]).filter("false")).count() == 0
    rows = mixing.assign_positions(table(spark, [None, "", "  "], [1, 1, None])).collect()
    assert [(r[-1].size, r[-1].taken, r[-1].copies) for r in rows] == [(0, 0, 1)] * 3


def test_mixing_agrees_with_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs, _, _ = mixed_table(spark, 6)
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(OP3_SQL).fetchall()}
    for r in mixing.assign_positions(docs).collect():
        assert want[r.doc_id] == (r[-1].size, r[-1].source_size, r[-1].target, r[-1].taken, r[-1].copies)


# ---- html ------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div><header>Site</header>
<article><header><h1>Head &amp; more</h1></header><p><b>One&nbsp; two<br>three<p>Four &lt;five&gt; AT&amp;T &am</p><div class="comments"><p>I agree</p></div>
<ul><li>a<li>b</ul><pre>x
  y</pre><aside>See also</aside><form>Mail <input name=q></form><p>A<i>B</i>C</p></article><footer>&copy; me</footer></body></html>"""


def test_article_text_without_the_rest():
    text, loose, other = html_text.split_page(PAGE)
    assert text == "Head & more\n\nOne two three\n\nFour <five> AT&T &am\n\na\n\nb\n\nx y\n\nABC"
    assert loose == [] and "Menu" in other and "Buy" in other


@pytest.mark.parametrize("page, text", [
    ("<article>cut <p>here &amp", "cut\n\nhere &"), ("<article><p>a</p><p", "a"), ("<article>a<b class='x>'>b</b> 1 < 2</article>", "ab 1 < 2"),
    ("<main><p>m</p></main>", "m"), ("<div role=main>r<div id='sidebar-2'>s</div></div>", "r"), ("<article><script>x</script></article>", None)])
def test_markup_cases(page, text):
    assert html_text.split_page(page)[0] == text


def test_repeated_starts_match_brute_force():
    rng = random.Random(13)
    for run in (1, 3, 6, 8):
        pages = [[rng.randint(0, 3) for _ in range(rng.randint(0, 25))] for _ in range(8)]
        tokens = np.array([t for p in pages for t in p], np.uint64)
        page = np.repeat(np.arange(8), [len(p) for p in pages])
        seen = {}
        for n, p in enumerate(pages):
            for k in range(len(p) - run + 1):
                seen.setdefault(tuple(p[k:k + run]), set()).add(n)
        expected = [k + run <= len(p) and len(seen[tuple(p[k:k + run])]) > 1 for p in pages for k in range(len(p))]
        assert html_text.repeated_starts(tokens, page, run).tolist() == expected


@pytest.mark.parametrize("chunk", [30, 10**6])
def test_pages_without_an_article_lose_repeated_runs(spark, monkeypatch, chunk):
    monkeypatch.setattr(html_text, "CHUNK_TOKENS", chunk)
    rng = random.Random(14)
    lead, end = "Welcome to the site of all good things", "Read more of our stories in the archive"
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(20)]
    rows = [(n, f"http://Host.example/{n}", f"<p>{lead}</p><p>{own[n]}</p><div>{end} {own[n][::-1]}</div>") for n in range(20)]
    rows += [(50, "http://other.example/1", f"<p>{lead}</p><p>alone</p>"), (51, None, None), (52, "http://host.example/a", f"<article><p>{lead}</p></article>"),
             (53, "http://third.example", "<p>same page words that are given twice</p>"), (53, "http://third.example", "<p>same page words that are given twice</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = sorted((r.page_id, r.text) for r in html_text.extract_pages(pages).collect())
    expected = [(n, f"{own[n]}\n\n{own[n][::-1]}") for n in range(20)]
    expected += [(50, f"{lead}\n\nalone"), (51, ""), (52, lead)] + [(53, "same page words that are given twice")] * 2
    assert got == expected


@pytest.mark.parametrize("chunk", [30, 10**6])
def test_main_text_of_other_pages_counts_as_repeated(spark, monkeypatch, chunk):
    monkeypatch.setattr(html_text, "CHUNK_TOKENS", chunk)
    rng = random.Random(15)
    shared = "This run of words stands in an article of the same host"
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(10)]
    rows = [(n, f"http://host.example/{n}", f"<article><p>{own[n]}</p><p>{shared if n == 3 else own[n][::-1]}</p></article>") for n in range(9)]
    rows.append((9, "http://host.example/9", f"<p>{own[9]}</p><p>{shared}</p>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    assert got == {**{n: f"{own[n]}\n\n{shared if n == 3 else own[n][::-1]}" for n in range(9)}, 9: own[9]}


def test_every_host_goes_through_the_suffix_arrays(spark, tmp_path, monkeypatch):
    log, real = tmp_path / "tokens", html_text.repeated_starts

    def noted(tokens, page, run):
        with open(log, "a") as f:
            f.write(f"{len(tokens)}\n")
        return real(tokens, page, run)

    monkeypatch.setattr(html_text, "repeated_starts", noted)
    rows = [(n, f"http://h{n % 3}.example/{n}", f"<nav>a b c</nav><article>{'word ' * 10}</article>") for n in range(9)]
    html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sum(map(int, log.read_text().split())) == 9 * 13


def test_no_pages(spark):
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page, text", [
    ('<article><section id="social-impact"><p>Body text</p></section></article>', "Body text"),
    ('<article><h2 id="related-work">Related work</h2><p>x</p></article>', "Related work\n\nx"),
    ('<article><p class="share-price">The price</p></article>', "The price"),
    ('<article><p class="share">Share this<p>Real text of the article</article>', "Real text of the article"),
    ('<article><ul><li class="ad">Buy<li>Real item</ul></article>', "Real item"),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold</p></article>", "Let x=2 hold"),
    ('<article><p>Text</p><ol class="commentlist"><li>I agree</ol></article>', "Text"),
    ('<article><p>Text</p><section id="comments"><p>I agree</p></section><div class="comment-list">so do I</div></article>', "Text"),
    ('<article><p>Text</p><div class="related-posts">More</div><div class="social-share-buttons">Share</div><div id="ad-slot-3">Buy</div></article>', "Text"),
    ('<article><p>before <span class="ad">buy</span>after</p></article>', "before after"),
    ("<article><table><tr><td>a<td>b<tr><td class=ad>c<td>d</table><p>e<div>f</div></article>", "a\n\nb\n\nd\n\ne\n\nf"),
    ("<article><dl><dt>t<dd class=promo>no<dt>u<dd>v</dl><p class=notice>n<blockquote>q</blockquote></article>", "t\n\nu\n\nv\n\nq"),
    ('<article><p class="ad">x<span><div>y</div></article>', "y"), ("<article><ul><li>a<ul><li>b</ul>c<li>d</ul></article>", "a\n\nb\n\nc\n\nd")])
def test_nothing_of_an_article_is_lost(page, text):
    assert html_text.split_page(page)[0] == text


@pytest.mark.parametrize("chunk", [25, 10**6])
def test_extraction_equals_brute_force(spark, monkeypatch, chunk):
    """Open blocks go where runs of other pages of the host cover them; pages, streams and runs as plain lists."""
    monkeypatch.setattr(html_text, "CHUNK_TOKENS", chunk)
    rng = random.Random(16)
    shared = ["our shares rose three per cent since the last report", "follow the whole story of this town with us today"]
    rows = []
    for n in range(40):
        own = " ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([4, 9, 15])))
        open_block = rng.choice([*shared, own, shared[0] + " x", "", "share this"])
        body = f'<p>{own[::-1]}</p><div class="share-price">{open_block}</div><p>{rng.choice(shared)}</p>'
        rows.append((n, f"http://host{n % 2}.example/{n}", f"<article>{body}</article><footer>foot</footer>" if n % 3 else f"<div>{body}</div><nav>{own}</nav>", n, "x"))
    rows += [(7, rows[7][1], "<article><p>the same id with another text</p></article>", 1, "x"), rows[4], rows[4], (41, None, "<p>no url</p>", 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, page long, text string").repartition(4)
    got = sorted((r.page_id, r.text) for r in html_text.extract_pages(pages).collect())

    parsed = [(r[0], r[1], html_text.page_blocks(r[2])) for r in rows]
    host = lambda url: (url or "").split("/")[2] if url else ""
    streams = {}
    for key, (main, undecided, _, other) in {r[:3]: p[2] for r, p in zip(rows, parsed)}.items():
        flat = [main[k] for k in undecided] + other + [t for k, t in enumerate(main) if k not in undecided]
        streams[key] = " ".join(flat).split()
    holders = {}
    for key, words in streams.items():
        for k in range(len(words) - 5):
            holders.setdefault((host(key[1]), *words[k:k + 6]), set()).add(key)
    want, kinds = [], set()
    for row, (key, url, (main, undecided, told, _)) in zip(rows, parsed):
        words = streams[row[:3]]
        starts = [k for k in range(len(words) - 5) if len(holders[host(url), *words[k:k + 6]]) > 1]
        covered = {k + d for k in starts for d in range(6)}
        out, at = [], 0
        for n, block in enumerate(main):
            if n not in undecided:
                out.append(block)
                continue
            size = len(block.split())
            left = [w for d, w in enumerate(block.split()) if at + d not in covered]
            at += size
            kinds.add((told, bool(left)))
            out.append(block if told and left else "" if told else " ".join(left))
        want.append((key, "\n\n".join(t for t in out if t)))
    assert got == sorted(want)
    assert kinds == {(True, True), (True, False), (False, True), (False, False)}
