"""Syntax trees as rows: the one thing here that needs Python on the executors.

A file's tree is parsed once; each node that any metric asks about is a row with its place in preorder, the end of its
subtree, and the functions and classes around it as arrays, so that "everything inside a function" is an explode and
an equi-join or group, never a range join. A file that cannot be parsed is one row of kind __error__."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

DEFS = ("FunctionDef", "AsyncFunctionDef")
CONTROLS = ("If", "For", "While", "Try", "With", "IfExp")
DECISIONS = (*CONTROLS, "BoolOp", "ExceptHandler", "comprehension")
#: Files that one task parses, about.
FILES = 2000

_FIELDS = [
    ("file_id", pa.int64()), ("pre", pa.int32()), ("parent", pa.int32()), ("parent_kind", pa.string()), ("in_body", pa.bool_()), ("kind", pa.string()),
    ("name", pa.string()), ("base", pa.string()), ("lineno", pa.int32()), ("end_lineno", pa.int32()), ("ctl", pa.int32()), ("nesting", pa.int32()),
    ("fns", pa.list_(pa.int32())), ("classes", pa.list_(pa.int32())), ("args", pa.list_(pa.string())), ("n_defaults", pa.int32()), ("n_decorators", pa.int32()),
    ("doc", pa.string()), ("doc_start", pa.int32()), ("doc_end", pa.int32()), ("n_values", pa.int32()), ("bases", pa.list_(pa.string())),
    ("targets", pa.list_(pa.string())), ("self_targets", pa.list_(pa.string())), ("names", pa.list_(pa.string())), ("value", pa.string()),
]
SCHEMA = pa.schema(_FIELDS)
DDL = ", ".join(
    f"{n} {'array<int>' if t == pa.list_(pa.int32()) else 'array<string>' if t == pa.list_(pa.string()) else {pa.int64(): 'long', pa.int32(): 'int', pa.string(): 'string', pa.bool_(): 'boolean'}[t]}"
    for n, t in _FIELDS
)


def dotted(func: ast.AST) -> str | None:
    """The name that a call goes by: a name is itself, an attribute is what it belongs to, a dot and its own name, or its
    own name alone where it belongs to something without a name; other calls have none."""
    match func:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=ast.Name() | ast.Attribute() as owner, attr=name):
            return f"{dotted(owner)}.{name}"
        case ast.Attribute(attr=name):
            return name
    return None


def _facts(node: ast.AST) -> dict:
    """What a node of interest says about itself, or nothing."""
    match node:
        case ast.FunctionDef() | ast.AsyncFunctionDef():
            return {"name": node.name, "args": [a.arg for a in node.args.args], "n_defaults": len(node.args.defaults), "n_decorators": len(node.decorator_list)}
        case ast.ClassDef():
            return {"name": node.name, "bases": [b.id if isinstance(b, ast.Name) else None for b in node.bases], "n_decorators": len(node.decorator_list)}
        case ast.Call():
            return {"name": dotted(node.func), "base": node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None}
        case ast.Attribute():
            return {"name": node.attr, "base": node.value.id if isinstance(node.value, ast.Name) else None}
        case ast.Name():
            return {"name": node.id}
        case ast.Constant():
            return {"value": str(node.value)}
        case ast.BinOp():
            return {"name": type(node.op).__name__}
        case ast.BoolOp():
            return {"n_values": len(node.values)}
        case ast.Import():
            return {"names": [a.name for a in node.names]}
        case ast.ImportFrom():
            return {"names": [f"{node.module or ''}.{a.name}" for a in node.names]}
        case ast.Global():
            return {"names": list(node.names)}
        case ast.Assign() | ast.AnnAssign() | ast.AugAssign():
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            own = [t.attr for t in targets if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"]
            return {"targets": [t.id for t in targets if isinstance(t, ast.Name)], "self_targets": own}
    return {}


_WANTED = (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Call, ast.Attribute, ast.Name, ast.Constant, ast.BinOp, ast.BoolOp, ast.Import, ast.ImportFrom,
           ast.Global, ast.Assign, ast.AnnAssign, ast.AugAssign, ast.If, ast.For, ast.While, ast.Try, ast.With, ast.IfExp, ast.ExceptHandler, ast.comprehension)


def tree_rows(file_id: int, content: str | None) -> list[dict]:
    """The rows of one file."""
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [{"file_id": file_id, "pre": 0, "kind": "__error__", "name": f"{type(e).__name__}: {e}"[:500]}]
    out: list[dict] = []
    stack: list[tuple] = [(tree, None, None, False, 0, 0, (), ())]
    pre = 0
    while stack:
        node, parent, parent_kind, in_body, ctl, nesting, fns, classes = stack.pop()
        kind, mine = type(node).__name__, pre
        pre += 1
        if kind in CONTROLS:
            ctl, nesting = ctl + 1, nesting + 1
        if kind in DEFS:
            fns = (*fns, mine)
        elif kind == "ClassDef":
            classes = (*classes, mine)
        if isinstance(node, _WANTED):
            row = {"file_id": file_id, "pre": mine, "parent": parent, "parent_kind": parent_kind, "in_body": in_body, "kind": kind, "ctl": ctl, "nesting": nesting,
                   "lineno": getattr(node, "lineno", None), "end_lineno": getattr(node, "end_lineno", None), "fns": list(fns), "classes": list(classes)} | _facts(node)
            if isinstance(node, ast.Module | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) and (doc := ast.get_docstring(node)) is not None:
                row |= {"doc": doc, "doc_start": node.body[0].lineno - 1, "doc_end": node.body[0].end_lineno - 1}
            out.append(row)
        body = {id(x) for x in getattr(node, "body", [])} if kind in (*DEFS, "ClassDef", "Module") else set()
        inner = 0 if kind in (*DEFS, "ClassDef") else nesting
        stack += [(x, mine, kind, id(x) in body, ctl, inner, fns, classes) for x in reversed(list(ast.iter_child_nodes(node)))]
    return out


def parse(files: DataFrame) -> DataFrame:
    """(file_id, content) -> nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for file_id, content in zip(batch.column("file_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows += tree_rows(file_id, content)
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return files.select("file_id", "content").mapInArrow(run, DDL)


def spread(files: DataFrame) -> DataFrame:
    """Files dealt by id over as many tasks as the cluster runs at a time, or more: few large input splits would parse in few tasks.
    A task gets FILES about, however many there are: it holds its nodes while they are kept."""
    spark = files.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // FILES))
    return files.repartition(n, "file_id")
