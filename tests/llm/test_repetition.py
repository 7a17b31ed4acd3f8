import random

import pytest

from callframe.functions.text import words
from callframe.llm import repetition


def share(tokens):
    runs = [tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)]
    return 1 - len(set(runs)) / len(runs) if runs else 0.0


@pytest.mark.parametrize("n", [20, 21, 33, 64, 200, 900])
def test_band_loses_nothing(n):
    r = random.Random(n)
    for trial in range(40):
        t = [f"w{r.randrange(10**6)}" for _ in range(n)]
        steps = 0
        while share(t) < 0.30 and steps < 400:
            k = r.choice([5, 6, 8] if trial % 2 else [5])
            a, b = r.randrange(0, n - k + 1), r.randrange(0, n - k + 1)
            t[b : b + k] = t[a : a + k]
            steps += 1
        words_, ratio, _, _, band, exact = repetition.score(" ".join(t))
        assert words_ == n
        if share(t) >= 0.30:
            assert band == "repetitive", (n, ratio, repetition.limit(n))
            assert exact == pytest.approx(share(t))


def test_exact_share_with_many_words():
    r = random.Random(4)
    t = [f"w{i}" for i in range(6000)] + [f"w{r.randrange(6000)}" for _ in range(300)] + [f"w{i}" for i in range(3000)]
    assert repetition.repeated_share(t) == pytest.approx(share(t))
    assert repetition.repeated_share(t[:4]) == 0.0


def test_bands():
    r = random.Random(1)
    noise = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ ") for _ in range(20_000))
    assert repetition.score(noise)[4] == "incompressible"
    assert repetition.score("spam ham eggs " * 500)[4:] == ("repetitive", pytest.approx(1 - 3 / 1496))
    assert repetition.score(None)[4] == repetition.score("a b c")[4] == "short"


def test_documents(spark):
    rows = [(1, "go on and on, Go on and ON. " * 10), (2, " ".join(f"x{i}" for i in range(50))), (3, None), (4, ""), (5, "a " * 19), (6, "a " * 20), (7, "重复的句子在这里" * 5), (8, "long tail " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "0.5D AS share", "'z' AS band")
    assert {r.doc_id for r in repetition.repetitive(df).collect()} == {1, 6, 7, 8}
    assert repetition.scores(df).count() == 8 and repetition.scores(df.limit(0)).count() == 0
    assert repetition.repetitive(df.union(df)).count() == 4


def test_threshold_is_inclusive(spark):
    t = [f"w{i}" for i in range(18)] + [f"w{i}" for i in range(10)]  # 24 runs, 18 different
    assert share(words(" ".join(t))) == 0.25
    df = spark.createDataFrame([(1, " ".join(t))], "doc_id bigint, text string")
    assert repetition.repetitive(df, 0.25).count() == 1 and repetition.repetitive(df, 0.26).count() == 0


def test_share_by_brute_force():
    r = random.Random(12)
    for n in (0, 4, 5, 6, 30, 400):
        for vocabulary in (1, 2, 7, 5000):
            t = [f"w{r.randrange(vocabulary)}" for _ in range(n)]
            runs = [tuple(t[i : i + 5]) for i in range(n - 4)]
            assert abs(repetition.repeated_share(t) - (1 - len(set(runs)) / len(runs) if runs else 0.0)) < 1e-12


def test_texts_beyond_the_tables_are_measured(monkeypatch):
    monkeypatch.setattr(repetition, "TABLE_WORDS", 50)
    assert repetition.score(" ".join(f"w{i}" for i in range(51)))[4] == "repetitive"
    assert repetition.score(" ".join(f"w{i}" for i in range(50)))[4] == "plain"
