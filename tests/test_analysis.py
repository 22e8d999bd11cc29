"""Summary, labels and tree metrics on small files with expected values worked out by hand."""

from __future__ import annotations

import ast

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import astmetrics, graphs, history, kept, labels, nodes, objects, summary, textmetrics

SNIPPET = '''"""Doc."""
import os
from a.b import c, d

LIMIT = 3


class Base:
    kind = "b"

    def __init__(self, x):
        self.x = x

    def get(self):
        return self.x


class Child(Base):
    def set(self, v):
        # set value v
        self.x = v
        os.path.join("a", "b")
        return helper(v)


def helper(n, k=1):
    """Return n plus LIMIT."""
    if n > 1 and k:
        return n + LIMIT
    elif n:
        return helper(n - 1)
    return 0
'''
EXPECTED = {
    "lines_of_code": 33, "source_lines": 20, "comment_lines": 1, "comment_percentage": 3.0, "avg_line_length": 13.1, "max_line_length": 30, "classes": 2, "functions": 4, "methods": 3,
    "total_imports": 3, "max_nesting_level": 2, "average_cyclomatic_complexity": 0.75, "nesting_variance": 0.866, "decision_density": 0.1, "max_cyclomatic_ratio": 0.571,
    "mean_cyclomatic_ratio": 0.443, "max_lines_per_function": 7, "mean_lines_per_function": 4.0, "call_graph_density": 0.1667, "max_intra_file_call_depth": 1, "inter_file_coupling": 1,
    "attribute_mutations_outside_init": 1, "external_vs_internal_field_access_ratio": 0.333, "globals_declared": 1, "global_usages_total": 1, "boolean_expression_avg_terms": 2.0,
    "mean_param_entropy": 1.911, "abbreviation_density": 0.4, "comment_code_mismatch_score": 0.667, "documentation_coverage": 16.7, "halstead_volume": 127.44, "halstead_difficulty": 1.65,
    "halstead_effort": 209.9, "halstead_estimated_bugs": 0.0425, "maintainability_score": 85, "max_lines_per_class": 0, "vcs_available": False, "commit_bursts": None,
}
FILES = "file_id long, repo string, path string, content string, status string"


def test_worked_snippet(spark):
    files = spark.createDataFrame([(1, "r", "r/x.py", SNIPPET, "ok"), (2, "r", "r/bad.py", "def (", "ok"), (3, "r", "r/e.py", "", "ok")], FILES)
    got = {r["file_id"]: r for r in summary.analyze(files).collect()}
    assert set(got) == {1, 3}  # what cannot be parsed has no row; an empty file is one line
    assert {k: got[1][k] for k in EXPECTED} == EXPECTED
    assert [tuple(x) for x in got[1]["cross_file_call_edges"]] == [("Child.set", "os")]
    assert got[1]["indentation_irregularity"]["irregularity_score"] == 0.7728
    assert (got[3]["lines_of_code"], got[3]["functions"], got[3]["source_lines"]) == (1, 0, 0)
    assert len(got[1]) == 66


def test_object_metrics(spark):
    files = spark.createDataFrame([(1, "r", "r/x.py", SNIPPET, "ok")], FILES)
    tree = nodes.parse(files)
    got = {r["class_name"]: r for r in objects.oo_metrics(tree, astmetrics.function_metrics(tree)).collect()}
    pick = lambda r: (r["wmc"], r["lcom"], r["rfc"], r["tna"], r["cbo"], r["dit"])
    assert pick(got["Base"]) == (2, 0.0, 2, 2, 0, 0)
    assert pick(got["Child"]) == (1, 0.0, 3, 1, 1, 1)


def test_nested_definitions_count_in_all_around_them(spark):
    text = "def a(x):\n    def b(y):\n        if y and x:\n            pass\n    return b\nclass A:\n    def m(self): self.f = 1\n    def m(self):\n        self.g = 2\n"
    tree = nodes.parse(spark.createDataFrame([(1, "r", "p", text, "ok")], FILES))
    f = {(r["name"], r["lineno"]): r for r in astmetrics.function_metrics(tree).collect()}
    assert f["a", 1]["cyclomatic_complexity"] == 3 and f["b", 2]["cyclomatic_complexity"] == 3
    assert f["a", 1]["nesting"] == 1 and f["a", 1]["bool_terms"] == 2
    oo = objects.oo_metrics(tree, astmetrics.function_metrics(tree)).collect()[0]
    assert (oo["methods"], oo["tna"]) == (2, 2)


def test_call_depth_of_cycles_and_self_calls(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")], "src string, dst string").withColumn("g", F.lit(1))
    n = spark.createDataFrame([(x,) for x in "abcde"], "node string").withColumn("g", F.lit(1))
    got = {r["node"]: r["depth"] for r in graphs.longest_paths(e, n, ["g"]).collect()}
    assert got == {"a": 3, "b": 2, "c": 1, "d": 0, "e": 0}
    m = objects.graph_metrics(n, e, ["g"]).collect()[0]
    assert (m["nodes"], m["edges"], m["density"]) == (5, 5, 0.25)


def _plain_pep8(text):
    count, shown = 0, 0
    for line in text.split("\n"):
        if len(line) > 79:
            count, shown = count + 1, min(20, shown + 1)
        if line.rstrip() != line and shown < 20:
            count, shown = count + 1, shown + 1
    return count


def test_style_violations_match_a_plain_loop(spark):
    import random

    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["x", "y ", "z" * 80, "w" * 90 + " ", "", "\t"]) for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    got = {r["file_id"]: r for r in textmetrics.style_violations(rows).collect()}
    for i, t in enumerate(texts):
        assert got[i]["pep8_violations"] == _plain_pep8(t)
        assert len(got[i]["pep8_examples"]) <= 20


def test_line_kinds_add_up(spark):
    texts = ["a\n# b\n\n  c\n\t#d", "", "\n\n", "x" * 100, "\tx\n \ty"]
    rows = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    got = {r["file_id"]: r for r in textmetrics.line_metrics(rows).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert r["loc"] == t.count("\n") + 1 == r["sloc"] + r["cloc"] + r["dloc"] + r["blank_lines"]
    assert (got[0]["sloc"], got[0]["cloc"], got[4]["tab_lines"], got[4]["mixed_tabs"]) == (2, 2, 2, 1)


BASE = dict.fromkeys(labels.INPUTS, 0) | {"documentation_coverage": 100.0, "comment_percentage": 100.0, "large_parameter_list_indicator": False, "unit_test_presence": True, "mean_lines_per_class": 60.0, "average_methods_per_class": 5.0}
CASES = [
    ("LongMethod", {"functions": 1, "max_lines_per_function": 50}, {"max_lines_per_function": 51}),
    ("LargeParameterList", {"functions": 1, "mean_param_entropy": 2.0}, {"mean_param_entropy": 2.1}),
    ("LazyClass", {"classes": 1, "average_methods_per_class": 1.0, "mean_lines_per_class": 50.0}, {"mean_lines_per_class": 49.0}),
    ("GodClass", {"classes": 1, "inter_file_coupling": 20}, {"inter_file_coupling": 21}),
    ("SpaghettiCode", {"functions": 1, "nesting_variance": 1.5}, {"nesting_variance": 1.6}),
    ("PoorDocumentation", {"lines_of_code": 21, "documentation_coverage": 20.0}, {"documentation_coverage": 19.9}),
    ("MisleadingComments", {"comment_code_mismatch_score": 0.7}, {"comment_code_mismatch_score": 0.71}),
    ("GlobalStateAbuse", {"globals_declared": 3}, {"globals_declared": 4}),
    ("FeatureEnvy", {"functions": 1, "n_cross_calls": 10}, {"n_cross_calls": 11}),
    ("ShotgunSurgery", {"commit_bursts": 3, "inter_file_coupling": 11}, {"commit_bursts": 4}),
    ("FormattingIssues", {"pep8_violations": 5}, {"pep8_violations": 6}),
    ("UntestedCode", {"lines_of_code": 50, "unit_test_presence": False}, {"lines_of_code": 51}),
    ("UnstableModule", {"lines_added": 500}, {"lines_added": 501}),
]


def test_rules_just_below_and_above(spark):
    rows = []
    for i, (_, below, above) in enumerate(CASES):
        rows += [BASE | below | {"k": 2 * i}, BASE | below | above | {"k": 2 * i + 1}]
    double = {k for k, v in BASE.items() if isinstance(v, float)} | {"nesting_variance", "mean_param_entropy", "comment_code_mismatch_score", "max_cyclomatic_ratio", "average_cyclomatic_complexity", "external_vs_internal_field_access_ratio", "irregularity_score"}
    kind = lambda c: "boolean" if isinstance(BASE[c], bool) else "double" if c in double else "int"
    cols = list(BASE)
    data = [(r["k"], *[float(r[c]) if c in double else r[c] for c in cols]) for r in rows]
    df = spark.createDataFrame(data, "k int, " + ", ".join(f"{c} {kind(c)}" for c in cols))
    got = {r["k"]: r for r in labels.label(df).collect()}
    for i, (name, _, _) in enumerate(CASES):
        assert got[2 * i][f"y_{name}"] == 0, name
        assert got[2 * i + 1][f"y_{name}"] == 1, name
        assert [x["type"] for x in got[2 * i + 1]["smells"]] == [name]
    void = df.where("k = 1").withColumn("commit_bursts", F.lit(None).cast("int"))
    assert sum(labels.label(void).select(*[f"y_{n}" for n in labels.VECTOR]).first()) == 0
    assert labels.label(void, "strict").first()["y_LongMethod"] == 1


def test_bursts_and_ages(spark):
    day = 86_400
    rows = [("a", 0), ("a", 8 * day - 1), ("a", 8 * day), ("b", 5), ("a", 30 * day)]
    df = spark.createDataFrame(rows, "path string, s long")
    assert {r["path"]: r["commit_bursts"] for r in history.burst(df, ["path"], F.col("s")).collect()} == {"a": 2, "b": 1}


def test_vcs_and_test_links(spark):
    files = spark.createDataFrame([(1, "r", "r/a/mod.py", "x", "ok"), (2, "r", "r/a/t/test_mod.py", "def test_a():\n    pass\n def test_b(): pass", "ok"), (3, "q", "q/z.py", "", "ok")], FILES)
    links = {r["file_id"]: r for r in history.test_links(files).collect()}
    assert (links[1]["test_files_found"], links[1]["test_lines"], links[1]["test_function_count"], links[1]["unit_test_presence"]) == (1, 3, 2, True)
    assert links[2]["unit_test_presence"] and links[3]["test_files_found"] == 0
    commits = spark.sql("SELECT 'r' repo, 'h1' hash, 'ann' author, timestamp'2024-01-01' ts, 's' subject UNION ALL SELECT 'r', 'h2', 'bob', timestamp'2024-01-03', 't'")
    changes = spark.createDataFrame([("r", "h1", "r/a/mod.py", 5, 1), ("r", "h1", "r/o.py", 1, 0), ("r", "h2", "r/a/mod.py", 2, 2)], "repo string, hash string, path string, added long, deleted long")
    v = {r["file_id"]: r for r in history.vcs_metrics(files, commits, changes).collect()}
    assert (v[1]["lines_added"], v[1]["lines_deleted"], v[1]["num_authors"], v[1]["file_age_days"], v[1]["commit_bursts"]) == (7, 3, 2, 2, 2)
    assert v[1]["coupled_file_changes"] == {"r/o.py": 1} and v[1]["vcs_top_coupled"][0]["file"] == "r/o.py"
    assert (v[2]["vcs_available"], v[2]["lines_added"]) == (True, 0) and (v[3]["vcs_available"], v[3]["lines_added"]) == (False, None)


@pytest.mark.parametrize(("value", "digits", "want"), [(2.675, 2, 2.67), (0.5, 0, 0.0), (1.0005, 3, 1.0), (None, 2, None)])
def test_python_rounding(spark, value, digits, want):
    from quarrymill.functions.core import python_round

    assert spark.createDataFrame([(value,)], "x double").select(python_round(F.col("x"), digits)).first()[0] == want


def test_depths_have_no_limit():
    chain = {i: [i + 1] for i in range(5000)}
    assert graphs.call_depths(range(5001), chain)[:2] == [5000, 4999]
    layers = {(a, i): [(a + 1, 0), (a + 1, 1)] for a in range(60) for i in (0, 1)}
    assert graphs.call_depths([(0, 0), (0, 1)], layers) == [60, 60]
    # a class that was met before is one step; an unnamed base is one too
    assert graphs.inheritance_depths(["D", "A", "B", "X"], {"D": ["A", "B"], "A": ["X"], "B": ["A"], "X": [None]}) == [3, 2, 3, 1]
    assert graphs.inheritance_depths(["A", "B"], {"A": ["B"], "B": ["A"]}) == [2, 2]
    assert graphs.inheritance_depths([f"C{i}" for i in range(300)], {f"C{i}": [f"C{i - 1}"] if i else [] for i in range(300)})[-1] == 299


def test_depths_of_many_small_files(spark):
    rows = spark.range(100_000).select(F.col("id").alias("file_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    names = rows.select("file_id", F.concat(F.lit("f"), F.col("k").cast("string")).alias("node"))
    edges = rows.where("k > 0").select("file_id", F.concat(F.lit("f"), F.col("k").cast("string")).alias("src"), F.concat(F.lit("f"), (F.col("k") - 1).cast("string")).alias("dst"))
    got = graphs.longest_paths(edges, names, ["file_id"]).groupBy("node").agg(F.min("depth").alias("a"), F.max("depth").alias("b"), F.count(F.lit(1)).alias("n"))
    assert {tuple(r) for r in got.collect()} == {(f"f{i}", i, i, 100_000) for i in range(4)}


def test_names_of_imports_globals_and_modules(spark):
    text = "import os, sys as s\nfrom . import x\nfrom a.b import c\nG = 1\ndef f():\n    global H\n    def g():\n        return G\n    os.path.join(G)\n    json.dumps(s.a)\ndef h():\n    f(); os.getcwd()\n"
    tree = nodes.parse(spark.createDataFrame([(1, "r", "p", text, "ok")], FILES))
    s = astmetrics.file_structure(tree).first()
    assert s["imports"] == ["os", "sys"] and s["import_froms"] == [".x", "a.b.c"] and s["total_imports"] == 4
    u = astmetrics.global_usage(tree).first()
    assert (u["globals_declared"], u["global_usages_total"], u["usage_per_name"]) == (1, 3, {"G": 3, "H": 1})
    g = objects.call_graph(tree, astmetrics.function_metrics(tree)).first()
    assert g["cross_module_calls"] == {"f": ["json", "os"], "h": ["os"]} and g["modules_called"] == ["json", "os"]
    assert [nodes.dotted(ast.parse(x).body[0].value.func) for x in ("a()", "a.b.c()", "a().b.c()", "a()()", "x[0].y()")] == ["a", "a.b.c", "b.c", None, "y"]


def test_kept_tables_are_released(spark):
    df = kept.keep(spark.range(3))
    assert df.is_cached
    kept.release()
    assert not df.is_cached and not kept._held


def test_merged_intervals_with_repeated_rows_and_null_ends(spark):
    """Against the SQL's rule, by hand: equal rows are one interval, null ends come last, an unknown low end opens an interval."""
    rows = [(1, 3, 5), (1, 3, 5), (1, 6, 6), (1, 9, 9), (1, 9, 9), (2, 3, None), (2, 3, 5), (3, None, 4), (3, 2, 4)]
    df = spark.createDataFrame(rows, "k int, low long, high long")
    got = sorted(textmetrics.merge_intervals(df, ["k"]).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 3, 6), (1, 9, 9), (2, 3, 5), (3, 2, 4), (3, None, 4)]
