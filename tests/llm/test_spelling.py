"""Spelling variants against plain edit distances."""
import collections
import random
import re
import zlib

import numpy as np
import pytest

from colsmith.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, form string"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def brute_counts(rows, modulus=97):
    seen = collections.Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % modulus == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def brute_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


def random_words(rng, count, letters="abé", sizes=(1, 2, 3, 4, 5, 6, 7, 9)):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(count)})


@pytest.mark.parametrize("seed", range(4))
def test_scan_finds_every_pair(seed):
    rng = random.Random(seed)
    words, lists = [], []
    for n in range(rng.randint(1, 6)):
        some = random_words(rng, rng.randint(1, 120))
        words += some
        lists += [n * 3] * len(some)
    asked = [(rng.choice(words) if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(5)), rng.randint(0, 18)) for _ in range(150)]
    asked = sorted(set(asked), key=lambda x: (x[1], x[0]))
    got = spelling.scan(words, np.array(lists), [w for w, _ in asked], np.array([k for _, k in asked]))
    want = {(a, b) for a, (w, k) in enumerate(asked) for b, v in enumerate(words) if lists[b] == k and one_edit(w, v)}
    assert set(zip(*(x.tolist() for x in got))) == want and len(got[0]) == len(want)
    assert spelling.scan([], np.zeros(0, int), ["a"], np.zeros(1, int))[0].tolist() == []


@pytest.mark.parametrize("tile_words,scan_words", [(20_000, 40_000), (7, 30), (40, 1)])
def test_near_words_equal_brute_force(spark, tile_words, scan_words):
    rng = random.Random(9)
    # a third of the words share their first half, and some are long
    words = set(random_words(rng, 400)) | {"prefix" + w for w in random_words(rng, 200)} | {"x" * 3000, "x" * 2999, "y" + "x" * 2999, "🙂b", "🙂c", "🙂"}
    rows = [(w, 3 + n % 5) for n, w in enumerate(sorted(words))]
    table = spark.createDataFrame(rows, "word string, n long").repartition(5)
    got = [tuple(r) for r in spelling.near_words(table, tile_words, scan_words).collect()]
    counts = dict(rows)
    want = {(a, counts[a], b, counts[b]) for a in words for b in words if one_edit(a, b)}
    assert set(got) == want and len(got) == len(want)


def test_groups_equal_brute_force(spark):
    rng = random.Random(10)
    stems = ["straße", "kitchen", "kitchens", "kitchin", "écoles", "parler", "parlez", "ÉCOLES", "Word÷word", "garden", "gardens", "warden"]
    rows = [(rng.choice([n, None]), " ".join(rng.choice(stems) for _ in range(rng.choice([0, 5, 400]))), "a", "b", "c") for n in range(300)]
    rows += [(1, None, "a", "b", "c"), (2, "", "a", "b", "c"), (3, "kitchen " * 30_000, "a", "b", "c")] + [(5, "gardenx GARDENX", "a", "b", "c")] * 3
    # a chain of forms: each word occurs twice as often as the one before
    chain = ["chainaaaa", "chainbaaa", "chainbbaa", "chainbbba", "chainbbbb", "chainbbbbb"]
    rows += [(10_000 + n, " ".join(w for k, w in enumerate(chain) for _ in range(3 << k)), "a", "b", "c") for n in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    counts = brute_counts(rows)
    table = spelling.count_words(df, change=spelling.delete_letter(97), id_col="doc_id")
    assert {r.word: r.n for r in table.collect()} == counts
    got = sorted(tuple(r) for r in spelling.group_variants(table).collect())
    assert got == brute_groups(counts)
    assert len({r[2] for r in got if r[0].startswith("chain")}) < 6 and any(r[1] for r in got)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.group_variants(spelling.count_words(empty)).count() == 0
    assert spelling.group_variants(spelling.count_words(spark.createDataFrame([(1, "word " * 9, "a", "b", "c")], SCHEMA))).count() == 0
