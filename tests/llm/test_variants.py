"""Spelling variants against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from traitloom.llm import variants

DOCS = "doc_id long, text string, word string, `a.b` int, n int"


def plain(rows, least=7, often=2, times=10):
    """The rule in plain Python; near words share what is left after one letter is taken out."""
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if c >= often and len(w) >= least}
    rests, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            rests[k, w[:k] + w[k + 1:]].add(w)
    for (_, rest), words in rests.items():
        for w in words:
            near[w] |= words - {w}
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in best.items() if n[f] >= times * n[w]}

    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, form.get(w, ""), root(w), c, len(near[w]), n[form[w]] if w in form else -1) for w, c in n.items())


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS).repartition(4)
    got = variants.spelling_variants(df, **more)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got.collect())


def garbled(rng, word):
    """The word with some letters changed."""
    for _ in range(rng.randrange(3)):
        k, c = rng.randrange(len(word)), rng.choice("abcdeéñ")
        word = rng.choice((word[:k] + word[k + 1:], word[:k] + c + word[k:], word[:k] + c + word[k + 1:]))
    return word


def texts(seed, n):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(6, 12))) for _ in range(12)]
    line = lambda: " ".join(garbled(rng, rng.choice(bases)) if rng.random() < 0.3 else bases[int(rng.random() ** 4 * 12)] for _ in range(60))
    return [(i, rng.choice((str, str.upper))(line())) for i in range(n)]


def test_variants(spark):
    rows = texts(1, 120)
    want = plain(rows)
    assert found(spark, rows) == want
    assert any(w[1] for w in want) and sum(w[4] for w in want) > 100
    want = plain(rows, 5, 1, 2)
    assert found(spark, rows, least=5, often=1, times=2) == want
    assert any(w[1] and w[1] != w[2] for w in want)


def test_variants_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(variants, "PART", 3)
    monkeypatch.setattr(variants, "STEP_PAIRS", 7)
    monkeypatch.setattr(variants, "STEP_LETTERS", 30)
    rows = texts(2, 60)
    assert found(spark, rows) == plain(rows)


def test_variants_of_odd_rows(spark):
    long = "ab" * 3000
    rows = [(1, None), (2, ""), (None, "wordless wordless wordlesss"), (4, "1234567 ,,, \u00d7\u00f7\u00d7\u00f7\u00d7\u00f7\u00d7 \u0142\u0142\u0142\u0142\u0142\u0142\u0142")]
    rows += [(5, f"{long} {long}"), (6, f"{long}a {long}a"), (6, f"{long}a {long}a"), (7, "\u00c9COLIERE \u00e9coliere " * 3), (7, "X" * 200_000), (8, ("harbour " * 30 + "harbor " * 2) * 3)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_close_pairs_hold_all_single_edits(seed):
    rng = np.random.default_rng(seed)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(7, 9))) for _ in range(150)})
    i, j = variants.near_rows(words, np.full(len(words), -1), np.zeros(len(words), int), np.zeros(len(words), bool), np.array([0]))
    apart = lambda a, b: any(a[:k] + a[k + 1:] == b for k in range(len(a))) or any(b[:k] + b[k + 1:] == a for k in range(len(b))) or (
        len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)
    assert {frozenset(x) for x in zip(i.tolist(), j.tolist())} == {frozenset((a, b)) for a in range(len(words)) for b in range(a) if apart(words[a], words[b])}
