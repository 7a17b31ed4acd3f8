import pytest
from pyspark.sql import functions as F

from callframe.operators import legacy, profile
from callframe.plans import pipelines
from callframe.sources import layout

OK = '<tool_call>{"name":"f","arguments":{"q":1}}</tool_call>'


def test_evaluate_and_compare(spark, samples, row):
    canon = samples(*[row(i, f"s{i}", tools=[("f", '{"type":"object"}')], calls=[("f", '{"q": 1}')]) for i in range(3)], row(3, "s3", content="t"))
    preds = lambda *texts: spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "sample_id string, raw_prediction string")
    base, summary, errors = pipelines.evaluate(preds(OK, "no", OK.replace("1", "2"), "fine"), canon)
    assert summary.first().full_call_success_rate == pytest.approx(1 / 3) and summary.first().no_tool_accuracy == 1.0
    assert {r.label: r.n for r in errors.collect()}["argument_mismatch"] == 1
    cand, _, _ = pipelines.evaluate(preds(OK.replace("1", '"1"'), OK, OK, "fine"), canon)
    out = pipelines.compare_runs(base, cand)
    total = out["transitions"].filter("call_kind IS NULL").first()
    assert (total.fixed, total.regressed, total.both_correct, total.both_wrong) == (2, 1, 0, 1)
    assert [(r.path, r.type) for r in out["diffs"].collect()] == [("q", "type_mismatch")]
    for bad in (preds(*["x"] * 5), preds("x").union(preds("x"))):
        with pytest.raises(ValueError):
            pipelines.evaluate(bad, canon)


def test_gold_must_agree(spark, samples, row):
    canon = samples(row(1, "a", calls=[("f", '{"b":1,"a":2}')]))
    kind = "sample_id string, raw_prediction string, gold array<struct<name string, arguments string>>"
    assert pipelines.evaluate(spark.createDataFrame([("a", OK, [("f", '{"a":2,"b":1}')])], kind), canon)[0].count() == 1
    with pytest.raises(ValueError):
        pipelines.evaluate(spark.createDataFrame([("a", OK, [("f", '{"a":2}')])], kind), canon)


def test_prepare_and_audit(spark, data):
    s = spark.read.parquet(f"{data}/canonical_samples.parquet")
    held = spark.read.parquet(f"{data}/heldout_tools.parquet")
    out = pipelines.prepare(s, held)
    assert out["status"].filter("source IS NULL").first().total == s.count()
    assert all(r.shared == 0 for r in out["overlaps"].collect()) and all(r.samples == 0 for r in out["leaks"].collect())
    assert out["training"].count() == out["splits"].count()
    parses = spark.read.parquet(f"{data}/tool_call_parses.parquet").select("call_id", "sample_id", "raw_content")
    audited, issues = pipelines.audit(parses, s)
    assert audited.count() == parses.count() and issues.count() > 3
    done, repairs = pipelines.repaired(parses, s)
    assert done.count() == parses.count() and repairs.count() == 5


@pytest.mark.parametrize(
    "text, mode",
    [
        ('{"a":1}', "strict_json"),
        (' \n{"a":1}\n ', "strict_json"),
        ('\\n\\t {"a":1}\\r\\n', "escaped_boundary_json"),
        ("{'a': (1,)}", "python_literal"),
        ("\\n{'a': 1}", "python_literal"),
        ("[1]", "failed"),
        ("{'a': {1}}", "failed"),
        ("", "failed"),
        ("\\n", "failed"),
        (None, "failed"),
    ],
)
def test_legacy_modes(text, mode):
    assert legacy.read(text)[0] == mode


def test_legacy_structure(spark):
    rows = [
        ('{"arguments":{},"name":"f"}', ["f"], "normal"),
        ('{"arguments":{"name":"f"}}', ["f"], "nested_name_repaired"),
        ('{"arguments":{"name":"f"}}', [], "nested_name_unverifiable"),
        ('{"arguments":{"name":"f"}}', ["g"], "nested_name_not_in_candidates"),
        ('{"name":"f"}', ["f"], "invalid"),
        ('{"arguments":[],"name":"f"}', ["f"], "invalid"),
        ('{"arguments":"{\\"name\\":\\"f\\"}","name":"f"}', ["f"], "invalid"),
        ('{"arguments":"{\\"name\\":\\"f\\"}"}', ["f"], "invalid"),
        ('{"arguments":{"name":7}}', ["f"], "invalid"),
        (None, None, "invalid"),
    ]
    df = spark.createDataFrame(rows, "v string, n array<string>, want string").withColumn("got", legacy.structure(F.col("v"), F.col("n")))
    assert [r.got for r in df.collect()] == [r[2] for r in rows]


def test_breakdowns(spark):
    df = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", "x", None)], "k string, d string, ok boolean")
    cube = {(r.k,): (r.rows, r.x, r.y) for r in profile.decision_cube(df, "d", ("x", "y"), "k").collect()}
    assert cube == {(None,): (3, 2, 1), ("a",): (2, 1, 1), ("b",): (1, 1, 0)}
    kept = {r.k: (r.before, r.after, r.dropped) for r in profile.retention(df, F.col("ok"), "k").collect()}
    assert kept == {None: (3, 1, 2), "a": (2, 1, 1), "b": (1, 0, 1)}
    assert [(r.stage, r.n) for r in profile.funnel(df, all=F.lit(True), x=F.col("d") == "x", ok=F.col("ok")).orderBy("ord").collect()] == [("all", 3), ("x", 2), ("ok", 1)]
    y = profile.compare_yields(df, df.filter("k = 'a'"), F.col("ok")).first()
    assert y.uplift == pytest.approx(1.5) and profile.compare_yields(df.limit(0), df, F.col("ok")).first().uplift is None
    band = df.select(profile.threshold_band(F.length("d") * 150, (200, "high"), (120, "middle"), (0, "low"))).first()[0]
    assert band == "middle"
    kinds = {(r.path, r.kind): r.n for r in profile.value_kinds(spark.createDataFrame([('{"a":1}',), ('{"a":"x"}',), ("bad",)], "t string"), "t").collect()}
    assert kinds == {("", "object"): 2, ("a", "integer"): 1, ("a", "string"): 1}


def test_layout(tmp_path, monkeypatch):
    assert layout.categories("b, a,b", ["a", "b"]) == ("b", "a")
    for bad in ("", "a,,b", "z"):
        with pytest.raises(ValueError):
            layout.categories(bad, ["a", "b"])
    monkeypatch.setenv("SOME_DIR", str(tmp_path))
    assert layout.data_dir(None, "SOME_DIR", "/none") == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        layout.data_dir("/none/at/all", "SOME_DIR", "/none")
    assert layout.part("r", run="x", split="dev") == "r/run=x/split=dev"
    assert layout.shown(str(tmp_path / "a"), str(tmp_path)) == "a" and layout.shown("/x", str(tmp_path)) == "/x"
    assert layout.training_registry(["train"])["train"]["file_name"] == "train.jsonl"


def test_profile_and_acceptance(spark, data):
    from callframe.operators import normalize

    s = spark.read.parquet(f"{data}/canonical_samples.parquet")
    out = pipelines.profile_samples(s)
    assert {r.counter: r.n for r in out["counters"].collect()}["rows"] == s.count() and out["roles"].count() and out["arguments"].count() and out["tools"].count()
    raw = spark.createDataFrame([("1", "q", '[{"name":"f","arguments":{}}]', '[{"name":"f","description":"d","parameters":{}}]'), ("2", None, "[]", "[]")], "id string, query string, answers string, tools string")
    got = pipelines.accept_parsed(normalize.from_flat(raw), raw)
    assert got["errors"].count() == 1 and got["status"].filter("source IS NULL").first().total == 1
    with pytest.raises(ValueError):
        pipelines.accept_parsed(normalize.from_flat(raw), raw.union(raw))


def test_cooccurrence(spark):
    from callframe.operators import diff

    df = spark.createDataFrame([(["missing_argument", "extra_argument", "wrong_value"],), (["missing_argument", "wrong_value"],), (["wrong_value"],), ([],)], "diagnostics array<string>")
    assert {(r.left, r.right): r.samples for r in diff.cooccurrence(df).collect()} == {("missing_argument", "extra_argument"): 1, ("missing_argument", "wrong_value"): 2, ("extra_argument", "wrong_value"): 1}


def test_workers_get_the_package(spark):
    import __spark_entry__ as entry

    entry.ship(spark)
    entry.ship(spark)
    assert [f for f in spark.sparkContext._python_includes] == ["callframe.zip"]
