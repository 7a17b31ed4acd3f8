import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callframe.functions.text import words
from callframe.llm import overlap


def brute(texts, splits):
    sets = {k: {*words(t)} for k, t in texts.items()}
    t = {k for k, s in splits if s == "train" and k in texts}
    e = {k for k, s in splits if s not in (None, "train") and k in texts}
    out = {(k, k) for k in t & e}
    for a in t:
        for b in e:
            x, y = sets[a], sets[b]
            if a != b and (x or y) and 4 * len(x & y) >= 3 * len(x | y):
                out.add((min(a, b), max(a, b)))
    return out


def run(spark, samples, row, texts, splits):
    df = samples(*[row(i, k, text=t) for i, (k, t) in enumerate(texts.items())])
    sp = spark.createDataFrame(splits, "sample_id string, split string")
    rows = [(r.left_id, r.right_id) for r in overlap.expand(*overlap.class_pairs(df, sp)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed=5, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, splits = {}, []
    for i in range(n):
        if i % 4 and i > 4:
            base = words(texts[f"s{r.randrange(i):03d}"]) or ["w1"]
            t = [w if r.random() > 0.08 else r.choice(vocabulary) for w in base]
        else:
            t = r.sample(vocabulary, r.randrange(1, 30))
        texts[f"s{i:03d}"] = " ".join(t)
        splits.append((f"s{i:03d}", r.choice(["train", "train", "dev_seen", "test_seen"])))
    splits += [(f"s{i:03d}", "test_seen") for i in range(0, n, 10)] + [("ghost", "train"), ("ghost", "dev_seen"), (None, "train"), ("s001", None)]
    return texts, splits


@pytest.mark.parametrize("heavy, block", [(1_000_000, 2_000), (2, 3)])
def test_against_brute_force(spark, samples, row, monkeypatch, heavy, block):
    monkeypatch.setattr(overlap, "HEAVY", heavy)
    monkeypatch.setattr(overlap, "BLOCK", block)
    texts, splits = corpus()
    want = brute(texts, splits)
    assert len(want) > 60 and run(spark, samples, row, texts, splits) == want


def test_edges(spark, samples, row):
    texts = {"a": "x y z v", "b": "X, y! z", "c": "", "d": None, "e": "x y z v", "f": "中文 字 x"}
    splits = [("a", "train"), ("b", "dev_seen"), ("c", "train"), ("c", "test_seen"), ("d", "train"), ("e", "train"), ("e", "test_seen"), ("f", "train"), ("f", "train")]
    assert run(spark, samples, row, texts, splits) == {("a", "b"), ("b", "e"), ("c", "c"), ("e", "e"), ("a", "e")}
    assert run(spark, samples, row, {"a": "x"}, []) == set() == run(spark, samples, row, {}, [("a", "train"), ("a", "dev_seen")])


def test_long_text_and_clashing_columns(spark, samples, row):
    long = " ".join(f"w{i}" for i in range(30_000))
    df = samples(row(1, "a", text=long), row(2, "b", text=long + " end")).selectExpr("*", "1 AS cls", "2 AS in_train", "3 AS n")
    sp = spark.createDataFrame([("a", "train"), ("b", "dev_seen")], "sample_id string, split string")
    assert [(r.left_id, r.right_id) for r in overlap.expand(*overlap.class_pairs(df, sp)).collect()] == [("a", "b")]


def test_report_counts_the_links(spark, samples, row):
    texts, splits = corpus(9, 80)
    df = samples(*[row(i, k, text=t, source=["x", None][i % 2]) for i, (k, t) in enumerate(texts.items())])
    sp = spark.createDataFrame(splits, "sample_id string, split string")
    members, pairs = overlap.class_pairs(df, sp)
    sets = {k: {*words(t)} for k, t in texts.items()}
    train = {k for k, s in splits if s == "train" and k in texts}
    want = {}
    for k, s in {(k, s) for k, s in splits if s not in (None, "train") and k in texts}:
        n = sum(bool(sets[k]) and 4 * len(sets[k] & sets[t]) >= 3 * len(sets[k] | sets[t]) for t in train)
        if n:
            key = (s, ["x", None][int(k[1:]) % 2])
            a, b = want.get(key, (0, 0))
            want[key] = (a + 1, b + n)
    assert {(r.split, r.source): (r.leaked, r.links) for r in overlap.report(df, sp, members, pairs).collect()} == want


def test_report_counts_samples_without_words(spark, samples, row):
    texts = {"a": "x y z v", "b": "x y z v", "c": "", "d": None, "e": "?!", "f": ""}
    df = samples(*[row(i, k, text=t, source=None if k == "e" else "x") for i, (k, t) in enumerate(texts.items())])
    on = {"a": ["train"], "b": ["dev_seen"], "c": ["train", "dev_seen", "test_seen"], "d": ["train", "dev_seen"], "e": ["train", "dev_seen"], "f": ["dev_seen"]}
    sp = spark.createDataFrame([(k, s) for k, v in on.items() for s in v], "sample_id string, split string")
    got = {(r.split, r.source): (r.leaked, r.links) for r in overlap.report(df, sp, *overlap.class_pairs(df, sp)).collect()}
    assert got == {("dev_seen", "x"): (3, 3), ("test_seen", "x"): (1, 1), ("dev_seen", None): (1, 1)}


def test_buckets_nobody_uses_are_dropped_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.col("id").alias("key"), F.lit(1).alias("n"))
    used = rows.filter("key % 10 = 3").select("key")
    kept = overlap.used_buckets(rows, used)
    assert {r.key for r in kept.collect()} == {k for k in range(1000) if k % 10 == 3} and kept.columns == ["key", "n"]
    high = spark.createDataFrame([(-(1 << 63),), (-1,), (5,)], "key bigint")
    assert {r.key for r in overlap.used_buckets(high, high).collect()} == {-(1 << 63), -1, 5}
    assert overlap.used_buckets(rows, used.limit(0)).count() == 0


def test_blocks_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 4)
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i}", f"t{i}") for i in range(40)], "key string, t_cls string")
    right = spark.createDataFrame([("hot" if i % 3 else f"k{i}", f"e{i}") for i in range(40)], "key string, e_cls string")
    got = [tuple(r) for r in overlap.blocked_join(left, right, "key").select("key", "t_cls", "e_cls").collect()]
    want = [tuple(r) for r in left.join(right, "key").select("key", "t_cls", "e_cls").collect()]
    assert sorted(got) == sorted(want) and len(want) > 500


def test_links_and_members_give_all_pairs(spark, samples, row):
    texts, splits = corpus(seed=8, n=80)
    texts |= {"z1": "", "z2": "!!", "s001x": texts["s001"]}
    splits += [("z1", "train"), ("z1", "dev_seen"), ("z2", "train"), ("s001x", "dev_seen")]
    df = samples(*[row(i, k, text=t) for i, (k, t) in enumerate(texts.items())])
    members, links = overlap.represented(*overlap.class_pairs(df, spark.createDataFrame(splits, "sample_id string, split string")))
    members, links = members.collect(), links.collect()
    train, evals = {}, {}
    for m in members:
        if m.in_train:
            train.setdefault(m.class_id, []).append(m.sample_id)
        if m.in_eval:
            evals.setdefault(m.class_id, []).append(m.sample_id)
    pairs = {(min(a, b), max(a, b)) for x in links for a in train[x.train_class] for b in evals[x.eval_class]}
    assert pairs == brute(texts, splits) and len(links) == len(set(links))


@pytest.mark.parametrize("change", [{"CROWDED": 0}, {"CROWDED": 0, "SOME": 20}, {"INFO": 2.0}, {"INFO": 60.0}, {"LONG": 8}, {"LONG": 8, "HEAVY": 2, "BLOCK": 3}])
def test_time_limits_change_no_pair(spark, samples, row, monkeypatch, change):
    for k, v in change.items():
        monkeypatch.setattr(overlap, k, v)
    texts, splits = corpus(seed=6)
    assert run(spark, samples, row, texts, splits) == brute(texts, splits)


def test_similar_sets_share_their_first_words():
    r, seen = random.Random(3), 0
    for _ in range(4000):
        words_of = list(range(1, r.randrange(7, 60)))
        bits = {w: r.choice([1.0, 4.0, 13.0]) for w in words_of}
        order = {w: i for i, w in enumerate(sorted(words_of, key=lambda w: (-bits[w], w)))}
        x = set(r.sample(words_of, r.randrange(3, len(words_of))))
        y = x ^ set(r.sample(words_of, r.randrange(0, 6)))
        if len(y) < 3 or 4 * len(x & y) < 3 * len(x | y):
            continue
        keys = []
        for s in (x, y):
            own = sorted(s, key=order.get)
            with np.errstate(over="ignore"):
                found = overlap.first_words(np.array([[order[w] + 1 for w in own]], np.uint64), np.array([[bits[w] for w in own]]), np.array([len(s)]))
            assert len(found[0]) <= math.comb(len(s) - overlap._least(len(s)) + overlap.DEEP, overlap.DEEP)
            keys.append(dict(zip(found[2].tolist(), found[1].tolist(), strict=True)))
        assert any(min(len(x) - keys[0][k], len(y) - keys[1][k]) >= len(x & y) for k in keys[0].keys() & keys[1].keys())
        seen += 1
    assert seen > 1000


def test_templates_do_not_meet_by_their_common_words(spark):
    """Requests of one template share half of their words: no pair is similar, so hardly one should be compared."""
    r = random.Random(4)
    sets = [" ".join(sorted([f"common{i}" for i in range(24)] + [f"rare{r.randrange(100_000)}" for _ in range(16)])) for _ in range(1500)]
    rows = [(hashlib.md5(s.encode()).digest(), s, i % 5 > 0, i % 5 == 0) for i, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "cls binary, word_set string, in_train boolean, in_eval boolean")
    counts = overlap._counts(classes, len(sets))
    met = {}
    for name, keys in (("words", overlap._first_keys(classes, counts, len(sets))), ("bands", overlap._bands(classes))):
        by = keys.groupBy("key").agg(F.count_if("in_train").alias("t"), F.count_if(~F.col("in_train")).alias("e"))
        met[name] = by.agg(F.sum(F.col("t") * F.col("e"))).first()[0]
    assert met["words"] < 2_000 < 100_000 < met["bands"]
    assert overlap.similar_classes(classes).count() == 0
