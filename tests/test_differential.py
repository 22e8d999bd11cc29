"""The engine against a plain evaluator of its definitions, on modules of Python's standard library."""

from __future__ import annotations

import ast
import math
import statistics
from pathlib import Path

import pytest

from quarrymill.operators import summary

STDLIB = Path(ast.__file__).parent
NAMES = ["bisect.py", "heapq.py", "textwrap.py", "string.py", "colorsys.py", "sched.py", "queue.py", "shelve.py", "cmd.py", "this.py", "fnmatch.py", "stat.py"]
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
CONTROLS = (ast.If, ast.For, ast.While, ast.Try, ast.With, ast.IfExp)
BRANCHES = (*CONTROLS, ast.BoolOp, ast.ExceptHandler, ast.comprehension)


def deepest(node, reset):
    """Longest run of controls from here down; reset: a def or class begins anew."""
    best = 0
    todo = [(node, 0)]
    while todo:
        n, d = todo.pop()
        d += isinstance(n, CONTROLS)
        best = max(best, d)
        inner = 0 if reset and isinstance(n, (*DEFS, ast.ClassDef)) else d
        todo += [(c, inner) for c in ast.iter_child_nodes(n)]
    return best


def plain(text):
    tree, lines = ast.parse(text), text.split("\n")
    every = list(ast.walk(tree))
    defs, classes = [n for n in every if isinstance(n, DEFS)], [n for n in every if isinstance(n, ast.ClassDef)]
    docs = {i for n in (tree, *defs, *classes) if ast.get_docstring(n) is not None for i in range(n.body[0].lineno - 1, n.body[0].end_lineno)}
    code = [x.strip() for i, x in enumerate(lines) if i not in docs and x.strip()]
    comments = sum(x.startswith("#") for x in code)
    cc = [1 + sum(isinstance(n, BRANCHES) for n in ast.walk(f)) for f in defs]
    size = [f.end_lineno - f.lineno + 1 for f in defs]
    names = [n.id for n in every if isinstance(n, ast.Name)] + [str(n.value) for n in every if isinstance(n, ast.Constant)]
    ops = [type(n.op).__name__ for n in every if isinstance(n, ast.BinOp)]
    n1, n2 = len(set(ops)), len(set(names))
    volume = (len(ops) + len(names)) * math.log2(n1 + n2) if n1 and n2 else 0.0
    bools = [len(n.values) for f in defs for n in ast.walk(f) if isinstance(n, ast.BoolOp)]
    module = {t.id for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)} | {n.target.id for n in tree.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name)}
    inner = [n for f in defs for n in ast.walk(f) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)]
    own = sum(n.value.id == "self" for n in inner)
    controls = sum(isinstance(n, CONTROLS) for n in every)
    sync = sum(isinstance(f, ast.FunctionDef) for f in defs)
    return {
        "lines_of_code": len(lines), "source_lines": len(code) - comments, "comment_lines": comments, "classes": len(classes), "functions": sync,
        "max_nesting_level": deepest(tree, True), "nesting_variance": statistics.pstdev(deepest(f, False) for f in defs) if defs else 0.0,
        "average_cyclomatic_complexity": (controls + 1) / max(1, sync), "decision_density": controls / max(1, len(code) - comments),
        "max_cyclomatic_ratio": max((c / s for c, s in zip(cc, size, strict=True)), default=0.0), "max_lines_per_function": max(size, default=0),
        "total_imports": sum(len(n.names) for n in every if isinstance(n, ast.Import | ast.ImportFrom)), "halstead_volume": volume,
        "halstead_difficulty": n1 / 2 * len(names) / n2 if n1 and n2 else 0.0, "boolean_expression_avg_terms": sum(bools) / len(bools) if bools else 0.0,
        "globals_declared": len(module), "global_usages_total": sum(isinstance(n, ast.Name) and n.id in module for f in defs for n in ast.walk(f)),
        "documentation_coverage": 100 * sum(bool(ast.get_docstring(n)) for n in (*defs, *classes)) / max(1, len(defs) + len(classes)),
        "external_vs_internal_field_access_ratio": (len(inner) - own) / max(1, own), "max_line_length": max(map(len, lines)),
        "percent_lines_over_80": 100 * sum(len(x) > 80 for x in lines) / len(lines),
    }


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "std", f"std/{n}", (STDLIB / n).read_text(), "ok") for i, n in enumerate(NAMES)]
    files = spark.createDataFrame(data, "file_id long, repo string, path string, content string, status string")
    got = {r["file_id"]: r for r in summary.analyze(files, rounded=False).collect()}
    spark.catalog.clearCache()
    return got


@pytest.mark.parametrize("k", range(len(NAMES)), ids=NAMES)
def test_module(rows, k):
    for name, want in plain((STDLIB / NAMES[k]).read_text()).items():
        assert rows[k][name] == pytest.approx(want, abs=1e-9), name


def test_bounds(rows):
    for r in rows.values():
        assert 0 <= r["maintainability_score"] <= 100 and 0 <= r["comment_code_mismatch_score"] <= 1 and 0 <= r["abbreviation_density"] <= 1
        assert r["call_graph_density"] >= 0 and r["source_lines"] + r["comment_lines"] <= r["lines_of_code"]
