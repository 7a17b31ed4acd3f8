import pytest

from callframe.llm import mixing

DOCS, TARGETS = "doc_id bigint, text string, source string", "source string, target_share double, max_repeats int"


def docs(spark, **per):
    rows = [(1000 * i + k, f"some words number {k} of {s}", s) for i, (s, n) in enumerate(per.items()) for k in range(n)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("ranges, chunk", [(50_000, 1 << 16), (20, 8)])
def test_mix(spark, monkeypatch, ranges, chunk):
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    monkeypatch.setattr(mixing, "CHUNK_SLOTS", chunk)
    d = docs(spark, a=300, b=30, c=100, other=10)
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 2), ("none", 0.1, 3)], TARGETS)
    pieces, report = mixing.mix(d, t, block=16)
    rows, rep = pieces.collect(), {r.source: r for r in report.collect()}
    assert set(rep) == {"a", "b", "c", "none"} and rep["none"].used_tokens == 0
    slots = {}
    for r in rows:
        slots.setdefault(r.slot, []).append(r)
    assert sorted(slots) == [*range(len(slots))]
    assert all(sum(p.to_token - p.from_token for p in s) == 16 and len({p.source for p in s}) == 1 for s in slots.values())
    total = sum(r.used_tokens for r in rep.values())
    for s, w in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(rep[s].reached_share - w) < 0.03 and rep[s].used_tokens <= rep[s].available_tokens * rep[s].max_repeats
        assert rep[s].used_tokens == sum(p.to_token - p.from_token for p in rows if p.source == s)
    assert total == 16 * len(slots)
    seen = {}
    for p in rows:  # no token of a document comes more often than allowed, and none twice in one epoch
        for k in range(p.from_token, p.to_token):
            seen[(p.doc_id, k)] = seen.get((p.doc_id, k), set()) | {p.epoch}
    count = {}
    for p in rows:
        for k in range(p.from_token, p.to_token):
            count[(p.doc_id, k)] = count.get((p.doc_id, k), 0) + 1
    assert all(count[k] == len(e) for k, e in seen.items())
    assert all(n <= {"a": 1, "b": 4, "c": 2}["abc"[k[0] // 1000]] for k, n in count.items())
    again = {tuple(r) for r in mixing.mix(d.repartition(5), t, block=16)[0].collect()}
    assert again == {tuple(r) for r in rows}


def test_even_prefixes(spark):
    planned = [{"source": s, "weight": w, "available": 10**7, "max_repeats": 1} for s, w in (("a", 0.6), ("b", 0.4))]
    rows = sorted(mixing.schedule(spark, planned, block=1000).collect())
    for n in (10, 100, 1000, 5000):
        assert abs(sum(r.source == "a" for r in rows[:n]) - 0.6 * n) < 6
    for s in "ab":
        assert [r["rank"] for r in rows if r.source == s] == [*range(sum(r.source == s for r in rows))]


def test_edges(spark):
    t = spark.createDataFrame([("a", 1.0, 1), (None, 0.1, 1), ("b", None, 2), ("c", 0.5, 0), ("a", 0.2, 9)], TARGETS)
    d = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x " * 5000, "a"), (4, "y", None), (None, "z z z", "a")], DOCS)
    d, t = d.selectExpr("*", "1 AS tokens", "2 AS h"), t.selectExpr("*", "3 AS available", "4 AS rank")
    pieces, report = mixing.mix(d, t, block=64)
    assert {p.doc_id for p in pieces.collect()} <= {3, None} and pieces.count() > 50
    assert {r.source: r.used_tokens > 0 for r in report.collect()} == {"a": True, "b": False, "c": False}
    for dd, tt in ((d.limit(0), t), (d, t.limit(0))):
        pieces, report = mixing.mix(dd, tt)
        assert pieces.count() == 0 and all(r.used_tokens == 0 for r in report.collect())


def test_special_strings_are_ordinary_text(spark):
    d = spark.createDataFrame([(1, "<|endoftext|> <|fim|>", "a")], DOCS)
    assert mixing.token_counts(d).first().tokens > 2


def test_schedule_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_SLOTS", 64)
    planned = [{"source": s, "weight": w, "available": n, "max_repeats": 2} for s, w, n in (("a", 0.5, 400), ("b", 0.3, 10**6), ("c", 0.2, 10**6), ("d", 0.0, 9))]
    frame = mixing.schedule(spark, planned, block=4)
    want, used = [], dict.fromkeys("abc", 0)
    for slot in range(10_000):
        u = (slot * mixing.GOLDEN + (mixing.GOLDEN >> 1)) % 2**64 / 2**64
        s = "a" if u < 0.5 else "b" if u < 0.8 else "c"
        if used[s] >= {"a": 200}.get(s, 10**6):
            break
        want.append((slot, s, used[s]))
        used[s] += 1
    assert sorted(map(tuple, frame.collect())) == want and len(want) > 350
    assert "NestedLoop" not in frame._jdf.queryExecution().toString()


def test_extended_mix_keeps_its_promise(spark):
    d = docs(spark, a=300, b=30, c=100)
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 2)], TARGETS)
    short, long = (mixing.mix(d, t, block=8, deviation=x)[1].collect() for x in (0.0, 0.1))
    assert sum(r.used_tokens for r in long) > 1.2 * sum(r.used_tokens for r in short)
    assert all(abs(r.reached_share - r.target_share) < 0.12 and r.used_tokens <= r.available_tokens * r.max_repeats for r in long)
    assert mixing.extend([{"weight": 0.0, "available": 1, "max_repeats": 1}], 0.5)[0]["weight"] == 0.0
