"""Vectors, links, toxicity and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from traitloom.llm import components, queries, toxicity, vectors

SF = "/root/testdata/sf0.001"


def linked(rows, limit=0.93):
    fit = [k for k, (i, e, label) in enumerate(rows) if None not in (i, e, label) and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    root, n = {k: k for k in fit}, dict.fromkeys(range(len(rows)), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fit:
        for b in fit:
            (_, x, p), (_, y, q) = rows[a], rows[b]
            if a < b and p == q and len(x) == len(y) and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= limit:
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(b)] = find(a)
    least = {}
    for k in fit:
        least[find(k)] = min(least.get(find(k), 1 << 62), rows[k][0])
    return sorted((rows[k][0] or -1, n[k], least[find(k)] if k in root else (rows[k][0] or -1)) for k in range(len(rows)))


@pytest.mark.parametrize("part", [vectors.PART, 20])
def test_vectors(spark, monkeypatch, part):
    monkeypatch.setattr(vectors, "PART", part)
    r = np.random.default_rng(1)
    base = r.normal(size=(6, 8))
    one = [1.0] * 8
    rows = [(int(i) + 1, [float(x) for x in np.float32(base[r.integers(6)] + r.normal(size=8) * 0.22)], int(r.integers(3))) for i in range(250)]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 8, 1), (603, [float("nan"), *one[1:]], 1), (604, [None, *one[1:]], 1), (605, one, None),
             (None, one, 1), (606, [1.0] * 3, 1), (607, [1.0] * 3, 1), (606, [1.0] * 3, 1), (608, [float("inf"), *one[1:]], 1), (609, [-0.0, *one[1:]], 1), (610, [0.0, *one[1:]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(0))
    got = vectors.near_copies(df).collect()
    assert sorted((x.vec_id or -1, x.n_links, x.component_id or -1) for x in got) == linked(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got if x.vec_id is not None)
    assert vectors.near_copies(df.limit(0)).count() == 0


def test_quantised_bounds_hold():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 32)) * r.choice([1e-3, 1, 50], (1, 32))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    codes = vectors.quantised(unit)
    for limit in (0.2, 0.9):
        i, j = vectors.possible(codes, codes, limit)
        assert set(zip(*np.nonzero(unit @ unit.T >= limit))) <= set(zip(i, j))


def test_components_of_chains_and_stars(spark):
    r = random.Random(0)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(600, 700)]
    loose = [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)]
    links = chain + star + loose + [(7, 7), (3, 2), (2, 3)]
    r.shuffle(links)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in root if find(x) != x}


def labelled(seed, n):
    """Made-up texts; toxic ones hold one or two bad words, some misspelled."""
    r = random.Random(seed)
    parts = ["an", "er", "the", "on", "ti", "re", "st", "ou", "in", "le", "ed", "ha"]
    bad = ["worthless", "stupid", "pathetic", "disgusting"]
    out = []
    for _ in range(n):
        words = ["".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 120))]
        toxic = r.random() < 0.3
        for _ in range(r.randrange(1, 3) if toxic else 0):
            w = r.choice(bad)
            if r.random() < 0.3:
                k = r.randrange(1, len(w))
                w = w[:k] + w[k - 1] + w[k:]
            words.insert(r.randrange(len(words)), w)
        out.append((" ".join(words), int(toxic)))
    return out


def test_toxicity_on_held_out_texts_and_misspellings():
    model = toxicity.train(labelled(1, 700))
    test = labelled(2, 400)
    best = toxicity.highest([t for t, _ in test], model.weight)
    guess = 1 / (1 + np.exp(-(model.slope * best + model.offset))) >= 0.7
    truth = np.array([y for _, y in test]) == 1
    assert (guess == truth).mean() > 0.97
    unseen = toxicity.highest(["the ineter worthles one", "the inter stupidd one", "the inter the one"], model.weight)
    assert unseen[:2].min() > unseen[2]


def test_toxicity_query_and_edges(spark, monkeypatch):
    got = queries.op5_toxicity(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, " \n", 0.5), (4, "a b", 0.5)], "doc_id long, text string, score double")
    model = toxicity.train(labelled(1, 200))
    scored = toxicity.score(odd, model)
    assert scored.columns == ["doc_id", "text", "score", "score_"]
    assert [x.score_ for x in scored.orderBy("doc_id").collect()][:3] == [0.0, 0.0, 0.0]
    unknown = toxicity.train([("a b", 0)])
    assert not unknown.known and {x.score_ for x in toxicity.score(odd, unknown).collect()} == {0.0}
    # a long text cut in parts scores as it does whole
    text = [" ".join(t for t, _ in labelled(5, 40))]
    whole = toxicity.highest(text, model.weight)
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    assert np.allclose(toxicity.highest(text, model.weight), whole)


def test_training_rows_are_bounded_and_not_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.labelled_rows(docs, labels.unionAll(labels), 5).collect()
    assert 0 < len(rows) <= 10 and all(zlib.crc32(str(x.doc_id).encode()) % 3 != 1 for x in rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs, docs.columns
        docs = stage(spark, docs, SF).cache()
        sizes.append((name, before.count(), docs.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.dtypes == before.dtypes
    assert [s[0] for s in sizes] == ["toxicity", "near_copies", "personal_data", "mixing", "encoding"]
    assert sizes[0][2] < sizes[0][1] and sizes[1][2] < sizes[1][1] and sizes[2][1] == sizes[2][2]
    assert docs.where("n_tokens is null or decoded is null").count() == 0
    assert docs.where("text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][a-z]+'").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
    spark.catalog.clearCache()


def test_pipeline_stages_take_odd_rows(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, `_k1` int, `a.b` string, node long, ids string"
    texts = [None, "", " \n", "one two", "mail a.b@c.de now " * 30, "x" * 3000, "word " * 3000, "mail a.b@c.de now " * 30]
    rows = [(i if i else None, t, None if i % 3 else "en", ("s", None, "t")[i % 3], None if t is None else len(t), 0.5, "s", i, "d", i, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], rows[3], rows[4]], names)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert out.columns[:len(docs.columns)] == docs.columns, name
            n = out.count()
            assert n == 0 if table is not docs else n > 0, name
    kept = corpus_pipeline.distinct_texts(spark, docs, SF).collect()
    # texts without words and rows without id stay; of near copies the smallest id does
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 3, 3, 3, 4, 4, 5, 6]
