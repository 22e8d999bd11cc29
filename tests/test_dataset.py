"""Dataset, features, models, sources and streams."""

from __future__ import annotations

import http.server
import json
import subprocess
import sys
import threading
import time
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import evaluation, features, models
from quarrymill.functions import core
from quarrymill.sources import datasets, files, gitlog, lint, repos
from quarrymill.streaming import metrics


def test_engineer(spark):
    cols = {c: F.lit(0) for c in features.DROPPED}
    df = spark.createDataFrame([("a\\temp\\x.py", 1, 5.0, True, 0, 1), ("a\\temp\\__init__.py", 3, 5.0, False, 0, 0), ("z", 2, 5.0, True, 0, 0)], "file_path string, n int, same double, unit_test_presence boolean, y_A int, y_B int")
    got = {r["file_path"]: r for r in features.engineer(df.withColumns(cols)).collect()}
    assert set(got) == {"x.py", "z"}
    assert (got["x.py"]["n"], got["z"]["n"], got["z"]["same"], got["x.py"]["unit_test_presence"], got["x.py"]["y_any_smell"], got["z"]["y_any_smell"]) == (0.0, 0.5, 0.0, 1.0, 1, 0)
    with pytest.raises(ValueError, match="abbreviation_density"):
        features.engineer(df)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1, 0), (2.0, 1, 1), (3.0, 1, 1), (None, 1, 0)], "x double, c int, y_a int")
    got = {r["feature"]: r["corr"] for r in features.correlations(df, ["x", "c"], ["y_a"]).collect()}
    assert got["c"] is None and abs(got["x"] - 0.8660254) < 1e-6
    assert [r["feature"] for r in features.weak_features(features.correlations(df, ["x", "c"], ["y_a"])).collect()] == ["c"]


def test_models_by_name(spark, tmp_path):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 10).cast("double").alias("f"), F.rand(3).alias("g"), (F.col("id") % 10 > 4).cast("int").alias("y_hi"), F.lit(0).alias("y_no"))
    train, test = models.hash_split(df, "id")
    assert train.count() + test.count() == 200 and test.count() > 30
    m = models.train(train, ["f", "g"], ["hi", "no"], "random_forest", {"numTrees": 5, "maxDepth": 3})
    m.save(spark, str(tmp_path / "m"))
    got = models.MultiLabelModel.load(spark, str(tmp_path / "m")).predict(test)
    rows = evaluation.long_form(got, "id", ["hi", "no"])
    assert evaluation.micro_f1(rows).first()[0] == 1.0 and evaluation.subset_accuracy(rows, "id").first()[0] == 1.0
    assert m.importances()[0][:2] == ("hi", "f")
    both = models.ensemble(test, "id", {"a": m, "b": m}, ["hi", "no"])
    assert both.where("label = 'hi'").agg(F.sum("prediction")).first()[0] == test.where("y_hi = 1").count()
    assert models.refined({"numTrees": 100})["numTrees"] == [100, 200]


def test_ties_count_as_positive(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, "a", 0), (2, "b", 0)], "id int, model string, prediction int")
    assert {r["id"]: r["prediction"] for r in evaluation.vote(df, ["id"]).collect()} == {1: 1, 2: 0}


def test_file_source_keeps_what_spark_skips(spark, tmp_path):
    for name, body in (("r/__init__.py", b""), ("r/_x.py", b"a\r\nb"), ("r/.git/h.py", b"no"), ("r/d/.y.py", b"z"), ("s/bad.py", b"\xff"), ("s/n.md", b"n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r["path"]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"r/__init__.py", "r/_x.py", "r/d/.y.py", "s/bad.py"}
    assert got["r/_x.py"]["content"] == "a\nb" and got["s/bad.py"]["status"] == "decode_error" and got["r/__init__.py"]["content"] == ""
    assert datasets.run_summary(files.read_files(spark, str(tmp_path))).first().asDict() == {"scanned_files": 4, "errors": 1, "results": 3}
    assert files.read_files(spark, str(tmp_path), repo="s").count() == 1


def test_git_history(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=A|B", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    (tmp_path / "r").mkdir()
    run("init", "-q")
    for i, name in enumerate(("x.py", "y.py")):
        (tmp_path / "r" / name).write_text("a\n" * (i + 1))
        run("add", "-A")
        run("commit", "-qm", f"m|{i}")
    commits, changes = gitlog.read_history(spark, str(tmp_path))
    assert {(r["author"], r["subject"]) for r in commits.collect()} == {("A|B", "m|0"), ("A|B", "m|1")}
    assert {(r["path"], r["added"]) for r in changes.collect()} == {("x.py", 1), ("y.py", 2)}


def test_repo_lists(spark):
    one = '[{"id": 1, "clone_url": "u/x.git", "stargazers_count": 3}, {"id": 2}]'
    two = '{"a": {"id": 3, "clone_url": "u/foo.github.io", "stargazers_count": 9}}'
    got = repos.parse_repo_list(spark.createDataFrame([(one,), (two,)], "value string"))
    assert {r["id"] for r in got.collect()} == {1, 3}
    left = repos.to_fetch(got, spark.createDataFrame([("x",)], "repo string"))
    assert [r["repo"] for r in left.collect()] == ["foohub.io"]
    waits = []
    assert repos.rate_gate(9, 100, lambda: 40, waits.append) and waits == [70] and not repos.rate_gate(10, 0)
    raw = spark.createDataFrame([('{"id": 5, "owner": {"login": "o"}, "license": null}',)], "value string")
    r = repos.items(raw).first()
    assert (r["id"], r["owner_login"], r["license"], r["description"], r["topics"], r["is_archived"]) == (5, "o", None, "", [], False)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b\nc', [1, 2])], "k int, t string, n array<int>")
    datasets.write_csv(df, str(tmp_path / "c"), one_file=True)
    r = datasets.read_csv(spark, str(tmp_path / "c"), "k int, t string, n string").first()
    assert (r["k"], r["t"], r["n"]) == (1, 'a"b\nc', "[1,2]")


def test_stream_metrics(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a # TODO\nb")], "file_id long, content string").write.parquet(src)
    stream = metrics.stream_text_metrics(spark.readStream.schema("file_id long, content string").parquet(src))
    q = stream.writeStream.format("memory").queryName("text_metrics").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("text_metrics").first().asDict() == {"file_id": 1, "loc": 2, "max_line_length": 8, "percent_lines_over_80": 0.0, "todo_fixme_count": 1}


def test_saved_models_are_listed_and_vote(spark, tmp_path):
    df = spark.range(60).select("id", (F.col("id") % 10).cast("double").alias("f"), (F.col("id") % 10 > 4).cast("int").alias("y_hi"), F.concat(F.lit("temp/"), F.when(F.col("id") < 30, "one").otherwise("two"), F.lit("/x.py")).alias("file_path"))
    for name in ("b", "a", "c"):
        models.train(df, ["f"], ["hi"], "random_forest", {"numTrees": 3, "maxDepth": 2}).save(spark, str(tmp_path / "models" / name))
    (tmp_path / "models" / "notes").mkdir()
    assert models.saved(spark, str(tmp_path / "models")) == ["a", "b", "c"] and models.saved(spark, str(tmp_path / "none")) == []
    every = models.load_saved(spark, str(tmp_path / "models"))
    assert list(every) == ["a", "b", "c"] and list(models.load_saved(spark, str(tmp_path / "models"), ["b"])) == ["b"]
    got = models.predict_repository(df, "temp/one", "id", every, ["hi"])
    assert {(r["id"], r["prediction"]) for r in got.collect()} == {(i, int(i % 10 > 4)) for i in range(30)}
    assert models.of_repository(df.withColumn("repo", F.lit("q")), "q", strict=True).count() == 60
    warned = []
    models.ensemble(df, "id", every | {"other": models.MultiLabelModel(["gone"], every["a"].models)}, ["hi"], warned.append)
    assert len(warned) == 1 and warned[0].startswith("other")
    assert every["a"].importances(1) == every["a"].importances()[:1]
    assert models.rename_params({"a": 1}) == {"estimator__a": 1} and models.rename_params({"estimator__a": 1, "b": 2}, add=False) == {"a": 1, "b": 2}
    assert features.feature_columns(df) == ["id", "f"] and features.positional_split(df, 2) == (["id", "f"], ["y_hi", "file_path"])


def test_combined_file_comes_first(spark, tmp_path):
    (tmp_path / "each").mkdir()
    (tmp_path / "each" / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    with pytest.raises(FileNotFoundError):
        datasets.read_combined(spark, str(tmp_path / "no.json"), str(tmp_path / "none"))
    assert datasets.read_combined(spark, str(tmp_path / "all.json"), str(tmp_path / "each"), "a int").count() == 2
    (tmp_path / "all.json").write_text('[{"a": 7, "file_info": {"path": "p"}}]')
    one = datasets.read_combined(spark, str(tmp_path / "all.json"), str(tmp_path / "each"))
    assert [r.asDict() for r in datasets.without_file_info(one).collect()] == [{"a": 7}]
    assert datasets.clear_folder(spark, str(tmp_path / "each")) == {"status": "cleared"} and not list((tmp_path / "each").iterdir())
    assert datasets.clear_folder(spark, str(tmp_path / "none"))["status"] == "run directory does not exist"


def test_literals_and_lint(spark):
    texts = ["{'a': \"it's\"}", "{'a': 'True story'}", '{"a": "x"}', "('a',)", "", None, "os.remove('x')", "{'a': None}"]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    got = {r["file_id"]: r["p"] for r in df.select("file_id", core.safe_parse_json(F.col("content"), "a string").alias("p")).collect()}
    assert [got[i] and got[i]["a"] for i in range(8)] == ["it's", "True story", "x", None, None, None, None, None] and got[4] is None and got[5] is None and got[6] is None
    found = {r["file_id"]: r for r in lint.lint_tool(df, (sys.executable, "-c", "import sys; [print(sys.argv[1] + f':{i}:1: E') for i in range(600)]")).collect()}
    assert len(found) == 8 and len(found[0]["findings"]) == 500 and found[0]["findings"][0] == "0:1: E" and not found[0]["failed"]
    assert lint.lint_tool(df, ("no such tool",)).where("failed").count() == 8


def test_search_behind_the_gate(spark):
    asked = []
    left = {"remaining": 50, "reset": time.time() - 100}

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url = urlparse(self.path)
            body = {"resources": {"core": left}} if url.path == "/rate_limit" else {"items": [{"id": len(asked)}]}
            if url.path != "/rate_limit":
                asked.append(parse_qs(url.query))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        reader = repos._SearchReader({"endpoint": f"http://127.0.0.1:{server.server_port}", "languages": "python", "topics": "etl, sql", "pages": "2", "minStars": "7", "maxSize": "9"})
        assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 2
        assert asked[0]["q"] == ["language:python stars:>7 size:<9 topic:etl topic:sql"] and [a["page"] for a in asked] == [["0"], ["1"]]
        waits = []
        gate, repos.rate_gate = repos.rate_gate, lambda remaining, reset: repos_gate(remaining, reset, lambda: reset, waits.append)
        repos_gate = gate
        try:
            left["remaining"] = 9
            assert list(reader.read(reader.partitions()[0])) == [] and waits == [10] and len(asked) == 2
        finally:
            repos.rate_gate = gate
    finally:
        server.shutdown()
