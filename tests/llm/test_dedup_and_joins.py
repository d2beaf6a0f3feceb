"""Exact dedup, n-gram join, line dedup and license scans against brute force."""
import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colsmith.llm import components, exact_dedup, licenses, line_dedup, ngram_join
from colsmith.llm.words import shingles, word_hashes

WORDS = [f"w{n}" for n in range(400)]
SCHEMA = "doc_id long, text string, lang string, Digest string, row string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts, ids=None):
    ids = ids if ids is not None else list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in zip(ids, texts)], SCHEMA).repartition(5)


# ---- exact dedup -----------------------------------------------------------------------------------------------------

def test_exact_groups_cover_every_row(spark):
    texts = ["a", "b", "a", None, "", "a ", "b", "a", "A"]
    ids = [1, 2, 3, 4, 5, 6, 7, None, 9]
    rows = exact_dedup.exact_groups(table(spark, texts, ids)).collect()
    assert len(rows) == len(texts)
    got = {(r.doc_id, r.text_sha256): r for r in rows}
    for i, t in zip(ids, texts):
        same = [j for j, u in zip(ids, texts) if (u or "") == (t or "")]
        keep = max(j for j in same if j is not None)
        r = got[(i, hashlib.sha256((t or "").encode()).hexdigest())]
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), i == keep)


def test_exact_dedup_keeps_one_whole_row(spark):
    docs = table(spark, ["a", "a", None, "", "b", "b", "b", "c", "c"], [1, 2, 3, 4, 5, 5, 5, None, None])
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in out.collect()) == [(False, 0, "c"), (True, 2, "a"), (True, 4, ""), (True, 5, "b")]


def test_exact_dedup_survives_digest_collisions(spark, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(real(c, n), 1, 1))
    texts = [f"text {n % 50}" for n in range(150)]
    rows = exact_dedup.exact_groups(table(spark, texts)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(n, n % 50 + 100, 3) for n in range(150)}
    assert exact_dedup.exact_dedup(table(spark, texts)).count() == 50


def test_empty_table_gives_empty_results(spark):
    docs = table(spark, ["a"]).filter("false")
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert ngram_join.near_classes(docs).count() == 0
    assert ngram_join.keep_one_of_each(docs).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 0
    assert licenses.scan_licenses(docs).count() == 0


# ---- n-gram join -----------------------------------------------------------------------------------------------------

def gram_set(text):
    words = (text or "").lower().split()
    return {tuple(words[n:n + 5]) for n in range(max(1, len(words) - 4))} if words else set()


def brute_classes(texts):
    sets = [gram_set(t) for t in texts]
    links = [0] * len(texts)
    root = list(range(len(texts)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {n: (find(n), links[n]) for n in range(len(texts))}


def near_corpus(seed, groups=12, size=9):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 60)) for _ in range(60)]
    for _ in range(groups):
        words = sentence(rng, rng.randint(40, 160)).split()
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(rng.choice(["", "  "]) + " ".join(copy))
    texts += ["", None, "  \n ", "one", "One", "two words", "two words", texts[70], texts[70].upper()]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes_match_brute_force(spark, seed):
    texts = near_corpus(seed)
    rows = ngram_join.near_classes(table(spark, texts)).collect()
    assert {r.id: (r.class_id, r.links) for r in rows} == brute_classes(texts)


def test_near_classes_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    texts = near_corpus(3, groups=2, size=40)
    rows = ngram_join.near_classes(table(spark, texts)).collect()
    assert {r.id: (r.class_id, r.links) for r in rows} == brute_classes(texts)


def test_near_dedup_keeps_one_of_each_class(spark):
    texts = near_corpus(4)
    docs = table(spark, texts)
    classes = brute_classes(texts)
    out = ngram_join.keep_one_of_each(docs)
    assert out.columns == docs.columns
    kept = sorted(r.doc_id for r in out.collect())
    best = {}
    for n, (root, _) in classes.items():
        best[root] = max(best.get(root, n), n)
    assert kept == sorted(best.values())


def test_near_classes_with_null_and_repeated_ids(spark):
    text = sentence(random.Random(5), 50)
    rows = ngram_join.near_classes(table(spark, [text, text + " end", text, "other text"], [None, None, 7, 7])).collect()
    assert sorted((r.id or 0, r.class_id, r.links) for r in rows) == [(0, 7, 2), (0, 7, 2), (7, 7, 0), (7, 7, 2)]


def test_bands_reach_the_target_recall():
    for threshold, recall, rows in ((0.8, 0.999, 5), (0.6, 0.99, 3), (0.9, 0.9999, 8)):
        bands = ngram_join.choose_bands(threshold, recall, rows)
        assert 1 - (1 - threshold ** rows) ** bands >= recall > 1 - (1 - threshold ** rows) ** (bands - 1)


def test_shared_counts_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90))).astype(np.uint64) for _ in range(40)]
    counts = ngram_join.shared_counts(sets)
    for a, b in itertools.product(range(40), repeat=2):
        if a != b:
            assert counts[a, b] == len(np.intersect1d(sets[a], sets[b]))


@pytest.mark.parametrize("hot", [10, 256])
def test_components_of_long_and_hub_graphs(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT_ROWS", hot)
    edges = [(n, n + 1) for n in range(1, 60)] + [(100, n) for n in range(101, 180)] + [(300, 201), (201, 250), (7, 7)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {**{n: 1 for n in range(1, 61)}, **{n: 100 for n in range(100, 180)}, 300: 201, 201: 201, 250: 201}


def test_hand_out_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", 20)
    rows = spark.createDataFrame([("hot", n) for n in range(50)] + [(None, n) for n in range(30)] + [(f"k{n % 7}", n) for n in range(40)] + [("lone", 1)], "k string, v int")
    found = rows.filter("k is null or k <> 'lone'").groupBy("k").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    got = components.hand_out(rows, found, "k", 121)
    assert got.columns == ["k", "v", "s"] and got.count() == 120
    want = {r.k: r.s for r in found.collect()}
    assert all(r.s == want[r.k] for r in got.collect())


def test_shingles_match_tuples():
    texts = ["a b c d e f", "", None, "A b  C", "a b c", "x y z x y z x y z x y z"]
    values, ends = shingles(*word_hashes(pa.array(texts)))
    for n, text in enumerate(texts):
        words = (text or "").lower().split()
        tuples = [tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))] if words else []
        part = values[ends[n]:ends[n + 1]]
        assert len(part) == len(tuples) and len(set(part.tolist())) == len(set(tuples))
    assert values[ends[3]] == values[ends[4]]


# ---- line dedup ------------------------------------------------------------------------------------------------------

def brute_lines(texts, min_words):
    """Deletes by definition: every run of equal lines at an earlier place that holds ``min_words`` words."""
    lines = [[] if not t else t.split("\n") for t in texts]
    gone = [set() for _ in texts]
    first = {}
    for d, ls in enumerate(lines):
        for p, line in enumerate(ls):
            first.setdefault(line.strip(), []).append((d, p))
    for d, ls in enumerate(lines):
        for p, line in enumerate(ls):
            for e, q in first[line.strip()]:
                if (e, q) >= (d, p):
                    break
                low, high = 0, 0
                while p - low > 0 and q - low > 0 and lines[d][p - low - 1].strip() == lines[e][q - low - 1].strip():
                    low += 1
                while p + high + 1 < len(lines[d]) and q + high + 1 < len(lines[e]) and lines[d][p + high + 1].strip() == lines[e][q + high + 1].strip():
                    high += 1
                if sum(len(x.split()) for x in lines[d][p - low:p + high + 1]) >= min_words:
                    gone[d].update(range(p - low, p + high + 1))
    return gone


@pytest.mark.parametrize("min_words, sure_words", [(1, 1), (5, 10), (12, 20)])
def test_line_dedup_finds_every_guaranteed_run(spark, min_words, sure_words):
    rng = random.Random(min_words)
    passages = [[sentence(rng, rng.randint(1, 9)) for _ in range(rng.randint(1, 6))] for _ in range(12)]
    texts = []
    for _ in range(80):
        lines = []
        for _ in range(rng.randint(0, 4)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [sentence(rng, rng.randint(1, 12))]
            if rng.random() < 0.2:
                lines.append("")
        texts.append("\n".join(lines))
    texts[3] = None
    docs = table(spark, texts)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, min_words, sure_words).collect()}
    assert len(got) == len(texts)
    allowed = brute_lines(texts, min_words)
    certain = max(min_words, sure_words - min_words + 1)
    seen = set()
    for d, text in enumerate(texts):
        lines = [] if text is None else text.split("\n")
        kept = [] if not got[d].text else got[d].text.split("\n")
        assert got[d].n_lines == len(lines)
        # what goes is part of a run of min_words words that stands at an earlier place as well
        must_stay = Counter(x for n, x in enumerate(lines) if x and n not in allowed[d])
        assert not must_stay - Counter(kept)
        assert got[d].removed_lines <= len(allowed[d])
        if min_words == 1:
            assert got[d].removed_lines >= sum(x in seen or lines.index(x) < n for n, x in enumerate(lines) if x)
        for x in lines:
            if len(x.split()) >= certain and x.strip() in seen:
                assert x not in kept
        seen.update(x.strip() for x in lines)


def test_line_dedup_extends_to_short_neighbours(spark):
    block = ["short", "a b", "this line has enough words to select", "tail", ""]
    texts = ["\n".join(["intro one"] + block + ["own end"]), "\n".join(["other"] + block + ["other end"]), "tail\nshort", "a  long line of words here\na  long line of words here "]
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert [rows[n].text for n in range(4)] == [texts[0], "other\nother end", "tail\nshort", "a  long line of words here"]
    assert [rows[n].removed_lines for n in range(4)] == [0, 5, 0, 1]


def test_line_dedup_guarantee_of_windows():
    rng = random.Random(9)
    for _ in range(200):
        run = [sentence(rng, rng.randint(1, 3)) for _ in range(8)]
        total = sum(len(x.split()) for x in run)
        picks = []
        for _ in range(2):
            before = [sentence(rng, rng.randint(1, 6)) for _ in range(rng.randint(0, 5))]
            lines = before + run + [sentence(rng, 2) for _ in range(rng.randint(0, 4))]
            _, _, chosen = line_dedup.select_grams(lines, rng.choice([total // 3]), total)
            picks.append({(low - len(before), high - len(before), mark) for low, high, mark in chosen})
        assert any(0 <= low and high < 8 for low, high, _ in picks[0] & picks[1])


def test_line_dedup_cuts_every_repeated_run(spark):
    rng = random.Random(11)
    short = [sentence(rng, rng.randint(1, 5)) for _ in range(15)]
    texts = ["\n".join(rng.choice(short) if rng.random() < 0.7 else sentence(rng, rng.randint(1, 9)) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    common = [sentence(rng, 5) for _ in range(12)]
    # each line first stands among other neighbours; a repeated line of 5 words ends texts or is one
    texts += [f"{sentence(rng, 7)}\n{line}\n{sentence(rng, 7)}" for line in common] + ["\n".join(common)] * 2
    texts += [f"{sentence(rng, 9)}\nClick here to read more" for _ in range(3)] + ["Click here to read more"]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    gone = brute_lines(texts, 5)
    for d, text in enumerate(texts):
        assert got[d].text == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[d])
    assert got[73].text == got[77].text == ""


@pytest.mark.parametrize("min_words", [5, 9])
@pytest.mark.parametrize("gram_words", [1, 2, 5])
def test_line_dedup_with_wide_windows_equals_brute_force(spark, min_words, gram_words):
    """Short and blank lines: windows of several grams, parts of a run stand first in different texts."""
    rng = random.Random(17 * min_words + gram_words)
    stock = [sentence(rng, rng.randint(1, 3)) for _ in range(9)] + ["", "", "  "]
    texts = ["\n".join(rng.choice(stock) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    texts += ["\n".join(texts[rng.randrange(40)].split("\n")[rng.randint(0, 3):] + [sentence(rng, 2)]) for _ in range(30)]
    texts += ["\n" * 3 + texts[0] + "\n" * 4, "\n" * 6 + texts[0] + "\n" * 2]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, texts), min_words, min_words, gram_words=gram_words).collect()}
    gone = brute_lines(texts, min_words)
    assert sum(map(len, gone)) > 100
    for d, text in enumerate(texts):
        assert got[d].text == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[d])
    if gram_words == 1:
        picked = sum(len(line_dedup.select_grams(t.split("\n"), 1, min_words)[2]) for t in texts)
        assert picked < 0.8 * sum(1 for t in texts for x in t.split("\n") if x.strip())


def test_line_dedup_of_many_blank_lines(spark):
    line = "one two three four five six"
    texts = [line + "\n" * 20_000 + line, "\n" * 30_000 + line]
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert rows[0].removed_lines == 1 and rows[1].removed_lines == 20_000 and rows[1].text == "\n" * 10_000


def test_line_dedup_edge_rows(spark):
    line = "one two three four five six"
    rows = line_dedup.dedup_lines(table(spark, [line, line, line, None, ""], [1, 1, None, 2, 3])).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.text is None, r.n_lines, r.removed_lines) for r in rows) == [
        (0, "", False, 1, 1), (1, line, False, 1, 0), (1, line, False, 1, 0), (2, "", True, 0, 0), (3, "", False, 1, 0)]
    named = table(spark, [line, line]).withColumnRenamed("lang", "n_lines")
    assert line_dedup.dedup_lines(named).columns[-2:] == ["_n_lines", "removed_lines"]


# ---- license scans ---------------------------------------------------------------------------------------------------

def brute_scan(texts, templates):
    import re
    found = set()
    for d, text in enumerate(texts):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for name, template in templates.items():
            t = re.findall(r"[^\W_]+", template.lower())
            wanted = {tuple(t[n:n + 5]) for n in range(len(t) - 4)}
            span = len(t) - 4
            for at in range(max(1, len(words) - 4)):
                place = {tuple(words[n:n + 5]) for n in range(at, min(at + span, len(words) - 4))}
                if len(place & wanted) >= 0.8 * len(wanted):
                    found.add((d, name))
                    break
    return found


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for n in range(120):
        words = sentence(rng, rng.randint(0, 200)).split()
        if n % 2:
            name = rng.choice(sorted(licenses.TEMPLATES))
            notice = licenses.TEMPLATES[name].split()
            if len(notice) > 30 and rng.random() < 0.6:
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = notice if rng.random() < 0.8 else [w.upper() for w in notice]
        texts.append(rng.choice([" ", "\n"]).join(words))
    texts += [None, "", "Licensed under", "released under the mit license " * 40]
    got = licenses.scan_licenses(table(spark, texts)).collect()
    assert {(r.doc_id, r.license) for r in got} == brute_scan(texts, licenses.TEMPLATES)
    assert all(0.8 <= r.containment <= 1 for r in got)
    assert sorted((r.first_word, r.n_words) for r in got if r.doc_id == 123) == [(5 * n, 5) for n in range(40)]


def test_license_spans_point_at_the_words(spark):
    text = "lead in words\nReleased under the MIT License. and more\n" + "x y z " * 50 + "released UNDER the mit license"
    rows = licenses.scan_licenses(table(spark, [text])).orderBy("first_word").collect()
    assert [(r.license, r.first_word, r.n_words) for r in rows] == [("mit", 3, 5), ("mit", 160, 5)]
