"""Depths in graphs that belong to one file each: a file's graph is one row, its depths come out of one pass over it."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.kept import large


def call_depths(nodes: Iterable, edges: dict) -> list[int]:
    """Edges of the deepest walk from each node. Each node is walked once, in the order given, and keeps its depth;
    inside a walk an edge back to a node that is still open counts nothing. Without cycles this is the longest path."""
    depth: dict = {}
    for start in nodes:
        if start in depth:
            continue
        walk, is_open, deepest = [(start, iter(edges.get(start, ())))], {start}, [0]
        while walk:
            node, rest = walk[-1]
            down = next((v for v in rest if v not in is_open), None)
            if down is None:
                walk.pop()
                is_open.discard(node)
                depth[node] = done = deepest.pop()
                if deepest:
                    deepest[-1] = max(deepest[-1], 1 + done)
            elif down in depth:
                deepest[-1] = max(deepest[-1], 1 + depth[down])
            else:
                walk.append((down, iter(edges.get(down, ()))))
                is_open.add(down)
                deepest.append(0)
    return [depth[n] for n in nodes]


def inheritance_depths(names: list, bases: dict) -> list[int]:
    """Steps from each class to its farthest base, bases in order. A walk opens a class once: met again, it is one step
    and no further; so is a base from outside."""
    out = []
    for start in names:
        met, walk, deepest = {start}, [iter(bases.get(start, ()))], [0]
        while walk:
            base = next(walk[-1], walk)
            if base is walk:  # no base is left
                walk.pop()
                done = deepest.pop()
                if deepest:
                    deepest[-1] = max(deepest[-1], 1 + done)
            elif base in bases and base not in met:
                met.add(base)
                walk.append(iter(bases[base]))
                deepest.append(0)
            else:
                deepest[-1] = max(deepest[-1], 1)
        out.append(done)
    return out


def longest_paths(edges: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """edges (keys, src, dst) and starts (keys, node, and maybe at, their order) -> keys, node, depth.

    The graph of one key is one row: it belongs to one file, and is bounded by its text."""

    @F.arrow_udf("array<int>")
    def depths(nodes: pa.Array, links: pa.Array) -> pa.Array:
        out = []
        for some, pairs in zip(nodes.to_pylist(), links.to_pylist(), strict=True):
            after: dict = {}
            for p in pairs or ():
                after.setdefault(p["src"], []).append(p["dst"])
            out.append(call_depths(some, after))
        return pa.array(out, pa.list_(pa.int32()))

    at = F.col("at") if "at" in starts.columns else F.lit(0)
    named = starts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_set(F.struct(at.alias("at"), "node"))), lambda x: x["node"]).alias("_nodes"))
    linked = edges.where("src <> dst").groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("_links"))
    both = named.join(large(linked), keys, "left").withColumn("_depths", depths("_nodes", "_links"))
    return both.select(*keys, F.explode(F.arrays_zip("_nodes", "_depths")).alias("r")).select(*keys, F.col("r._nodes").alias("node"), F.col("r._depths").alias("depth"))


def inheritance_depth(classes: DataFrame) -> DataFrame:
    """(file_id, class_name, bases) -> file_id, class_name, dit."""

    @F.arrow_udf("array<int>")
    def depths(listed: pa.Array) -> pa.Array:
        out = []
        for some in listed.to_pylist():
            out.append(inheritance_depths([c["class_name"] for c in some], {c["class_name"]: c["bases"] for c in some}))
        return pa.array(out, pa.list_(pa.int32()))

    rows = classes.groupBy("file_id").agg(F.array_sort(F.collect_set(F.struct("class_name", "bases"))).alias("_c")).withColumn("_d", depths("_c"))
    return rows.select("file_id", F.explode(F.arrays_zip(F.transform("_c", lambda x: x["class_name"]).alias("class_name"), F.col("_d").alias("dit"))).alias("r")).select("file_id", "r.class_name", "r.dit")
