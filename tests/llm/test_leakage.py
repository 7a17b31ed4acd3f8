import random

import numpy as np
import pytest

from callframe.functions.text import words
from callframe.llm import leakage

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def brute(docs, items):
    runs = lambda t: {tuple(w[i : i + 12]) for w in [words(t)] for i in range(len(w) - 11)}
    ir = [(k, runs(t)) for k, t in items]
    return {(d, k) for d, t in docs for k, r in ir if r & runs(t)}


def corpus(seed=2, n=150):
    r = random.Random(seed)
    common, rare = [f"c{i}" for i in range(300)], [f"r{i}" for i in range(5000)]
    line = lambda k: [r.choice(rare if r.random() < 0.3 else common) for _ in range(k)]
    opening = line(14)
    items = [(i, " ".join((opening if i % 5 == 0 else []) + line(30))) for i in range(25)]
    docs = []
    for d in range(n):
        w = line(r.randrange(5, 200))
        if d % 3 == 0:
            it = words(r.choice(items)[1])
            k = r.choice([11, 12, 13, 20, len(it)])
            a = r.randrange(0, len(it) - k + 1)
            at = r.randrange(0, len(w))
            w[at:at] = it[a : a + k]
        docs.append((d, " ".join(w).upper() if d % 7 == 0 else ", ".join(w)))
    return docs, items


def search(spark, docs, items, **more):
    return leakage.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more)


@pytest.mark.parametrize("block, chunk", [(5_000, 2_000), (7, 3)])
def test_recall_is_whole(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(leakage, "ITEMS", block)
    monkeypatch.setattr(leakage, "CHUNK", chunk)
    docs, items = corpus()
    got = [(r.doc_id, r.item_id) for r in search(spark, docs, items).filter("run").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)


def test_candidates_come_from_the_latent_space_only(spark):
    docs, items = corpus()
    assert search(spark, docs, items, paraphrases=True, cosine=1.1).count() == 0  # no passage reaches it


def test_another_space_finds_less(spark, monkeypatch):
    docs, items = corpus()
    real = leakage.latent_space

    def blind(*args):
        space = real(*args)
        noise = np.random.default_rng(3).standard_normal(space.scaled.shape).astype(np.float32)
        noise[:, 1:] = 0
        return space._replace(scaled=np.abs(noise) * (np.arange(leakage.FEATURES) % 2 * 2 - 1)[:, None].astype(np.float32))

    monkeypatch.setattr(leakage, "latent_space", blind)
    assert {(r.doc_id, r.item_id) for r in search(spark, docs, items).filter("run").collect()} < brute(docs, items)


def test_recall_report(spark):
    docs, items = corpus(n=60)
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    n = len(brute(docs, items))
    assert leakage.recall(*frames).collect() == [(n, n, 0)]
    assert leakage.recall(*frames, cosine=1.1).collect() == [(n, 0, n)]


def test_space_is_the_svd(spark, monkeypatch):
    """Singular vectors of the whole matrix, as a dense SVD gives them."""
    monkeypatch.setattr(leakage, "RANK", 5)
    r = random.Random(4)
    docs = [(i, " ".join(r.choice([f"t{i % 3}a{k}" for k in range(12)]) for _ in range(40))) for i in range(60)]
    table = leakage.coded(spark.createDataFrame(docs, DOCS))
    none = lambda: iter(())
    space = leakage.latent_space(spark, table, none)
    rows = []
    for d, t in docs:
        for _, p in leakage.passages([leakage.codes(t, {})]):
            p.weigh(space.idf)
            a = np.zeros((p.n, leakage.FEATURES))
            np.add.at(a, (p.row, p.terms[p.place]), space.idf[p.terms[p.place]])
            rows.append(a / p.norm)
    full = np.concatenate(rows)
    values = np.linalg.svd(full, compute_uv=False)
    mine = space.scaled / space.idf[:, None]
    assert np.allclose(mine.T @ mine, np.eye(5), atol=1e-4)
    assert np.linalg.norm(full @ mine) >= 0.995 * np.linalg.norm(values[:5])


def test_scatter_and_project_are_the_matrix():
    r = np.random.default_rng(5)
    docs = [r.integers(0, 1 << 40, n, dtype=np.uint64) for n in (12, 13, 25, 40, 90, 300)]
    idf = 1 + r.random(leakage.FEATURES)
    basis = r.standard_normal((leakage.FEATURES, 3))
    for part, p in leakage.passages(docs):
        p.weigh(idf)
        a = np.zeros((p.n, leakage.FEATURES))
        for k in range(p.n):
            for t in p.terms[p.first[k] : p.first[k] + p.length[k]]:
                a[k, t] += idf[t]
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        assert np.allclose(p.project(idf[:, None] * basis), a @ basis, atol=1e-5)
        into, y = np.zeros((leakage.FEATURES, 3)), r.standard_normal((p.n, 3))
        p.scatter(y, into)
        assert np.allclose(into * idf[:, None], a.T @ y, atol=1e-5)


def test_paraphrase_recall_on_data(spark, data):
    """All pairs that satisfy the rule in some window of the document, by brute force, against the result."""
    items = spark.read.parquet(f"{data}/eval_items.parquet").filter("text IS NOT NULL")
    r = random.Random(6)
    texts = [x.text for x in items.orderBy("item_id").collect()]
    docs = [(x.doc_id, words(x.text)) for x in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    vocabulary = [w for _, d in docs for w in d]
    for k, (_, d) in enumerate(docs):
        at = r.randrange(0, len(d) + 1)
        d[at:at] = [w if r.random() < 0.72 else r.choice(vocabulary) for w in words(r.choice(texts))] if k % 2 else []
    docs = spark.createDataFrame([(k, " ".join(d)) for k, d in docs], DOCS)
    known = {}
    texts = [(r.item_id, leakage.codes(r.text, known)) for r in items.collect()]
    texts = [(k, t, leakage.places(t), set(t.tolist())) for k, t in texts if len(t)]
    want = set()
    for r in docs.collect():
        c = leakage.codes(r.text, known)
        for start in range(0, max(1, len(c) - leakage.RUN + 1), leakage.STEP) if len(c) >= leakage.RUN else ():
            for k, t, at, bag in texts:
                near = c[max(0, start - len(t)) : start + leakage.WINDOW + len(t)]
                if sum(x in bag for x in near.tolist()) >= leakage.LCS_SHARE * len(t) and leakage.lcs(t, near, at) >= leakage.LCS_SHARE * len(t):
                    want.add((r.doc_id, k))
    got = {(r.doc_id, r.item_id) for r in leakage.search(docs, items, paraphrases=True).filter("lcs_share IS NOT NULL").collect()}
    assert len(want) > 30 and got <= want and len(got) >= 0.9 * len(want)


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = [(1, text), (2, None), (3, ""), (4, "w1 w2"), (5, " ".join(text.split()[:12])), (6, " ".join(text.split()[:11])), (7, text + " " + " ".join(f"z{i}" for i in range(60_000)))]
    items = [(1, text), (2, None), (3, ""), (None, text), (4, "w1"), (1, text)]
    got = {(r.doc_id, r.item_id) for r in search(spark, docs, items).filter("run").collect()}
    assert got == {(1, 1), (5, 1), (7, 1)}
    assert search(spark, [], items).count() == 0 and search(spark, docs, []).count() == 0


def test_paraphrase_by_subsequence(spark):
    words_ = [f"q{i}" for i in range(30)]
    other = [w if i % 5 else f"x{i}" for i, w in enumerate(words_)]
    docs, items = [(1, " ".join(other)), (2, " ".join(f"n{i}" for i in range(30)))], [(1, " ".join(words_))]
    got = search(spark, docs, items, paraphrases=True).collect()
    assert [(r.doc_id, r.run, round(r.lcs_share, 2)) for r in got] == [(1, False, 0.8)]


@pytest.mark.parametrize("block", [5_000, 1])
def test_paraphrases_of_every_item(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "ITEMS", block)
    line = [f"q{i}" for i in range(30)]
    sibling = line[:24] + [f"y{i}" for i in range(6)]
    other = [w if i % 5 else f"x{i}" for i, w in enumerate(line)]
    docs = [(1, " ".join(other)), (2, " ".join(sibling)), (3, " ".join(f"n{i}" for i in range(30)))]
    got = search(spark, docs, [(1, " ".join(line)), (2, " ".join(sibling))], paraphrases=True).filter("lcs_share IS NOT NULL").collect()
    assert sorted((r.doc_id, r.item_id, r.run, round(r.lcs_share, 2)) for r in got) == [(1, 1, False, 0.8), (1, 2, False, 0.63), (2, 1, True, 0.8), (2, 2, True, 1.0)]


def test_answers_are_required(spark):
    words_ = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words_.replace("q7", "zz"))], DOCS)
    for answer, n in (("q8", 1), ("q7", 0), (None, 1)):
        items = spark.createDataFrame([(1, words_, answer)], ITEMS + ", answer string")
        assert leakage.search(docs, items, paraphrases=True).filter("lcs_share IS NOT NULL").count() == n


def test_lcs():
    code = lambda s: np.array([ord(c) for c in s], np.uint64)

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(1)
    for _ in range(100):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(0, 90))) for _ in "xy")
        assert leakage.lcs(code(a), code(b)) == slow(a, b)


def test_windows_hold_every_run():
    for n in (12, 13, 24, 25, 37, 100):
        doc = np.arange(n, dtype=np.uint64)
        inside = set()
        for _, p in leakage.passages([doc]):
            for s, k in zip(p.start, p.length):
                inside |= {*range(int(s), int(s) + int(k) - 11)}
        assert inside == {*range(n - 11)}
