import hashlib
import json

import pytest
from pyspark.sql import functions as F

from callframe.sources import files
from callframe.streaming import resume


def test_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿[{"b":1.0,"a":2}, 3]', encoding="utf-8")
    assert [(r.ordinal, r.value) for r in files.read_json_array(spark, str(tmp_path / "a.json")).collect()] == [(0, '{"a":2,"b":1.0}'), (1, "3")]
    (tmp_path / "b.json").write_text('{"a":1}')
    with pytest.raises(Exception, match="b.json.*must be an array"):
        files.read_json_array(spark, str(tmp_path / "b.json")).collect()
    assert files.first_value(spark, str(tmp_path / "a.json")) == ("array", '{"a":2,"b":1.0}')
    assert files.first_value(spark, str(tmp_path / "b.json")) == ("lines", '{"a":1}')


def test_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id":"a"}\n\n[1]\n{"id":\n')
    skip = files.read_lines(spark, str(p)).orderBy("line").collect()
    assert [(r.line, r.error is None) for r in skip] == [(1, True), (3, False), (4, False)]
    assert files.read_lines(spark, str(p), blank="reject").filter("error = 'blank line'").count() == 1
    with pytest.raises(ValueError, match="x.jsonl:3: not an object"):
        files.require_objects(files.read_lines(spark, str(p)))
    with pytest.raises(ValueError):
        files.inspect_lines(spark, str(p))
    p.write_text('{"id":"a"}\n{"id":"b"}\n')
    assert files.load_keyed(files.read_lines(spark, str(p)), "id").count() == 2
    p.write_text('{"id":"a"}\n{"id":"a"}\n')
    with pytest.raises(ValueError):
        files.load_keyed(files.read_lines(spark, str(p)), "id")


def test_sinks_and_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "n int, t string")
    files.write_lines(df, str(tmp_path / "out"))
    assert sorted((r.n, r.t) for r in spark.read.json(str(tmp_path / "out")).collect()) == [(1, "é"), (2, None)]
    files.write_summary(df.limit(1), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"n": 1, "t": "é"}
    (tmp_path / "f.bin").write_bytes(b"abc")
    r = files.file_digests(spark, str(tmp_path / "f.bin")).first()
    assert (r.bytes, r.sha256) == (3, hashlib.sha256(b"abc").hexdigest())
    ids = spark.createDataFrame([(2, "b"), (1, "a")], "o int, v string")
    assert files.sequence_digest(ids, "v", "o").first().sha256 == hashlib.sha256(b"a\nb").hexdigest()
    assert files.multiset_digest(ids, "v").first() == files.multiset_digest(ids.orderBy("o"), "v").first()
    files.write_partitioned(df.withColumn("c", F.lit("k")), str(tmp_path / "p"), "c")
    assert (tmp_path / "p" / "c=k").is_dir()
    lines = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "line_number int, value string")
    digest = files.write_selected(lines, lines.filter("line_number <> 2"), str(tmp_path / "sel"))
    assert digest == hashlib.sha256(b"a\nc\n").hexdigest()
    assert [r.value for r in spark.read.text(str(tmp_path / "sel")).collect()] == ["a", "c"]


def test_stream_resumes(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = "id bigint, v string"
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema).write.parquet(src)
    run = lambda: resume.stream_once(spark, src, schema, out, state, "id")
    run()
    run()
    spark.createDataFrame([(2, "again"), (3, "c")], schema).write.mode("append").parquet(src)
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_pending(spark):
    queue = spark.createDataFrame([(i, f"k{i}") for i in range(5)], "n int, k string")
    done = spark.createDataFrame([("k1",)], "k string")
    assert sorted(r.k for r in resume.pending(queue, done, "k", "n", start=1, most=3).collect()) == ["k2", "k3"]
    with pytest.raises(ValueError):
        resume.pending(queue, spark.createDataFrame([("z",)], "k string"), "k", "n")


def test_backend_errors_stay_with_their_row(spark):
    def backend():
        def answer(row):
            if row["id"] == 1:
                raise RuntimeError("no")
            return f"ok {row['id']}"

        return answer

    got = resume.generate(spark.range(3), backend, ["id"]).orderBy("id").collect()
    assert [(r.raw_prediction, r.error) for r in got] == [("ok 0", None), (None, "RuntimeError: no"), ("ok 2", None)]


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_array_in_chunks(chunk):
    cut = lambda t: iter([t[i : i + chunk] for i in range(0, len(t), chunk)])
    for t in ("[]", ' [1, 2.0,"a,]b",{"x":[1e5]}] ', "[12, 34", "[ ]"):
        assert [*files.array_values(cut(t))] == json.loads(t if t.strip().endswith("]") else t + "]")
    for bad, error in (('{"a":1}', TypeError), ("[1 2]", ValueError), ("[1,]", ValueError), ("[1]x", ValueError), ("[nope]", ValueError)):
        with pytest.raises(error):
            [*files.array_values(cut(bad))]


def test_first_value_reads_no_further(spark, tmp_path):
    (tmp_path / "long.json").write_text('[{"a":1},' + "broken" * 100_000)
    assert files.first_value(spark, str(tmp_path / "long.json"), chunk=16) == ("array", '{"a":1}')
    (tmp_path / "l.jsonl").write_text('\n {"a":1}\n{"b":\n')
    assert files.first_value(spark, str(tmp_path / "l.jsonl")) == ("lines", '{"a":1}')
    (tmp_path / "e.jsonl").write_text("")
    assert files.first_value(spark, str(tmp_path / "e.jsonl")) == ("lines", "")


def test_line_numbers_over_splits(spark, tmp_path):
    for name, n in (("a.txt", 3000), ("b.txt", 10)):
        (tmp_path / name).write_text("".join(f"{name} {i + 1}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3010 and all(r.value == f"{r.file.rsplit('/', 1)[1]} {r.line}" for r in rows)


def test_inspection(spark, tmp_path):
    (tmp_path / "o.jsonl").write_bytes(b'{"a":1}\n{"b":2}\n')
    r = files.inspect_lines(spark, str(tmp_path / "o.jsonl")).first()
    assert (r["lines"], r["bytes"], r.sha256) == (2, 16, hashlib.sha256(b'{"a":1}\n{"b":2}\n').hexdigest())


def test_tree_digest(spark):
    df = spark.createDataFrame([("a", f"k{i}") for i in range(500)] + [("b", "x"), ("b", None)], "g string, k string")
    one = {r.g: (r.n, r.sha256) for r in files.tree_digest(df, "k", "g").collect()}
    again = {r.g: (r.n, r.sha256) for r in files.tree_digest(df.union(df).repartition(9), "k", "g").collect()}
    other = {r.g: (r.n, r.sha256) for r in files.tree_digest(df.filter("k <> 'k7'"), "k", "g").collect()}
    assert one == again and one["a"][0] == 500 and one["b"][0] == 1 and other["b"] == one["b"] and other["a"] != one["a"]
    assert "collect_list" in files.tree_digest(df, "k")._jdf.queryExecution().toString()


def test_state(spark, tmp_path):
    state = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = files.merge_state(state, spark.createDataFrame([(1, "n", 5)], "k int, w string, z int"), ["k"])
    assert sorted(map(tuple, new.select("k", "v", "w", "z").collect())) == [(1, "a", "n", 5), (2, "b", "x", None)]
    cleared = files.merge_state(state, spark.createDataFrame([(2, None)], "k int, w string"), ["k"])
    assert sorted(map(tuple, cleared.collect())) == [(1, "a", None), (2, "b", None)]
    for bad in ([(9, "n")], [(1, "n"), (1, "m")]):
        with pytest.raises(ValueError):
            files.merge_state(state, spark.createDataFrame(bad, "k int, w string"), ["k"])
    path = str(tmp_path / "state")
    files.write_state(state, path)
    files.write_state(files.merge_state(spark.read.parquet(path), spark.createDataFrame([(1, "n")], "k int, w string"), ["k"]), path)
    assert spark.read.parquet(path).filter("w = 'n'").count() == 1


def test_save_first(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "n int, t string")
    files.save_first(df, "n", str(tmp_path / "f.json"))
    files.save_first(df.limit(0), "n", str(tmp_path / "g.json"))
    assert json.loads((tmp_path / "f.json").read_text()) == {"n": 1, "t": "a"} and (tmp_path / "g.json").read_text() == "null"
