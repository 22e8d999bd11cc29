"""Object-oriented metrics of top-level classes, and the call graph inside a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.core import safe_ratio
from quarrymill.operators.astmetrics import last_wins
from quarrymill.operators.graphs import inheritance_depth, longest_paths
from quarrymill.operators.kept import keep, large
from quarrymill.operators.nodes import DEFS

def top_classes(nodes: DataFrame) -> DataFrame:
    """file_id, cls, class_name, bases: module-level classes; of equal names the last."""
    rows = nodes.where("kind = 'ClassDef' AND in_body AND parent_kind = 'Module'").select("file_id", F.col("pre").alias("cls"), F.col("name").alias("class_name"), "bases")
    return last_wins(rows, ["file_id", "class_name"], "cls")


def cohesion_pairs(methods: DataFrame, keys: list[str], order: str, fields: str) -> DataFrame:
    """keys, pairs, lcom: of the pairs of a class's methods the number, and the share without a field in common."""
    a, b = methods.alias("a"), methods.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    both = a.join(large(b), [*same, F.col(f"a.{order}") < F.col(f"b.{order}")])
    apart = (~F.arrays_overlap(f"a.{fields}", f"b.{fields}")).cast("int")
    return both.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("pairs"), F.avg(apart).alias("lcom"))


def oo_metrics(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """One row for each top-level class: methods, public_methods, wmc, lcom, rfc, tna, cbo, dit."""
    classes = keep(top_classes(nodes))  # classes and methods are read by every figure below
    key = ["file_id", "cls"]
    methods = keep(functions.where("is_method").select("file_id", F.col("parent").alias("cls"), "fn", "name", "cyclomatic_complexity", "calls_made").join(large(classes.select(*key, "class_name")), key))
    counts = methods.groupBy(*key).agg(F.count(F.lit(1)).alias("methods"), F.count_if(~F.col("name").startswith("_")).alias("public_methods"), F.sum("cyclomatic_complexity").alias("wmc"))
    # what a method reads of self; a name's last definition speaks for all of that name
    own = nodes.where("kind = 'Attribute' AND base = 'self'").select("file_id", F.explode("fns").alias("fn"), F.col("name").alias("field"))
    read = own.groupBy("file_id", "fn").agg(F.collect_set("field").alias("fields"))
    by_name = keep(last_wins(methods.select(*key, "fn", "name", "calls_made"), [*key, "name"], "fn").join(large(read), ["file_id", "fn"], "left"))
    fields = by_name.select(*key, "name", F.coalesce("fields", F.array().cast("array<string>")).alias("fields"))
    each = methods.select(*key, "fn", "name").join(large(fields), [*key, "name"])
    lcom = cohesion_pairs(each, key, "fn", "fields").drop("pairs")
    names = methods.groupBy(*key).agg(F.collect_set("name").alias("method_names"))
    calls = by_name.select(*key, F.explode("calls_made").alias("call")).distinct().join(large(names), key)
    outside = ~(F.col("call").contains(".") & F.array_contains("method_names", F.element_at(F.split("call", r"\."), -1))) & ~F.array_contains("method_names", F.col("call"))
    external = calls.groupBy(*key).agg(F.count_if(outside).alias("external_called"))
    top = classes.select("file_id", F.col("class_name").alias("other"))
    roots = by_name.select(*key, F.explode("calls_made").alias("call")).select(*key, F.element_at(F.split("call", r"\."), 1).alias("other"))
    used = roots.union(classes.select(*key, F.explode("bases").alias("other"))).distinct().join(large(top), ["file_id", "other"]).join(large(classes.select(*key, "class_name")), key)
    cbo = used.where("other <> class_name").groupBy(*key).agg(F.count(F.lit(1)).alias("cbo"))
    body = nodes.where("in_body AND parent_kind = 'ClassDef' AND kind IN ('Assign', 'AnnAssign')").select("file_id", F.col("parent").alias("cls"), F.explode("targets").alias("field"))
    set_ = nodes.where("kind = 'Assign' AND size(self_targets) > 0").select("file_id", F.explode("fns").alias("fn"), "self_targets")
    set_ = set_.select("file_id", "fn", F.explode("self_targets").alias("field"))
    set_ = set_.join(large(methods.select("file_id", "fn", "cls")), ["file_id", "fn"]).select("file_id", "cls", "field")
    tna = body.union(set_).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("tna"))
    out = classes.select(*key, "class_name")
    for x in (counts, lcom, external, cbo, tna):
        out = out.join(large(x), key, "left")
    out = out.join(large(inheritance_depth(classes)), ["file_id", "class_name"], "left").fillna(0)
    return out.withColumn("rfc", F.col("methods") + F.col("external_called")).drop("external_called")


def oo_rollup(classes: DataFrame) -> DataFrame:
    god = ((F.col("methods") > 20) & (F.col("wmc") > 50)) | ((F.col("tna") > 30) & (F.col("methods") > 15))
    proxy = F.struct(F.col("class_name").alias("name"), "methods", "wmc", "tna")
    return classes.groupBy("file_id").agg(
        F.sum("methods").alias("methods"),
        F.avg("methods").alias("average_methods_per_class"),
        F.count_if(F.col("dit") > 0).alias("classes_with_inheritance"),
        F.avg("dit").alias("average_inheritance_depth"),
        F.avg("wmc").alias("average_wmc"),
        F.avg("cbo").alias("average_cbo"),
        F.max("wmc").alias("max_wmc"),
        F.array_sort(F.collect_list(F.when(god, proxy))).alias("god_class_proxies"),
    )


def qualified(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """file_id, fn, qual, class_name: module-level functions and the methods of module-level classes; of equal names the last."""
    heads = nodes.where("kind = 'ClassDef' AND in_body AND parent_kind = 'Module'").select("file_id", F.col("pre").alias("parent"), F.col("name").alias("class_name"))
    methods = functions.where("is_method").join(large(heads), ["file_id", "parent"]).select("file_id", "fn", F.concat_ws(".", "class_name", "name").alias("qual"), "class_name", "calls_made")
    top = nodes.where(F.col("kind").isin(*DEFS) & F.col("in_body") & (F.col("parent_kind") == "Module")).select("file_id", F.col("pre").alias("fn"))
    plain = functions.join(large(top), ["file_id", "fn"]).select("file_id", "fn", F.col("name").alias("qual"), F.lit(None).cast("string").alias("class_name"), "calls_made")
    return last_wins(methods.union(plain), ["file_id", "qual"], "fn")


def resolve_calls(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, qual, class_name, calls_made) -> edges (file_id, src, dst) and calls to other modules (file_id, caller, module).

    self.x is the caller's class's x; a.b.c is a.c; a bare name is itself. A dotted call that names no function of the
    file is a call to the module at its root, self excepted."""
    calls = functions.select("file_id", F.col("qual").alias("src"), "class_name", F.explode("calls_made").alias("call"))
    parts = F.split("call", r"\.")
    root, leaf, is_dotted = F.element_at(parts, 1), F.element_at(parts, -1), F.col("call").contains(".")
    dst = F.when(is_dotted & (root == "self"), F.concat_ws(".", F.col("class_name"), leaf)).when(is_dotted, F.concat_ws(".", root, leaf)).otherwise(F.col("call"))
    usable = ~(is_dotted & (root == "self") & F.col("class_name").isNull())
    calls = calls.withColumn("dst", F.when(usable, dst)).withColumn("module", F.when(is_dotted & (root != "self"), root))
    known = functions.select("file_id", F.col("qual").alias("dst"), F.lit(True).alias("known"))
    found = calls.join(large(known), ["file_id", "dst"], "left")
    edges = found.where("known").select("file_id", "src", "dst").distinct()
    cross = found.where("known IS NULL AND module IS NOT NULL").select("file_id", F.col("src").alias("caller"), "module").distinct()
    return edges, cross


def graph_metrics(names: DataFrame, edges: DataFrame, keys: list[str] = ["file_id"]) -> DataFrame:  # noqa: B006
    """(keys, node) and (keys, src, dst) -> keys, nodes, edges, density, averages of fan-in and fan-out."""
    n = names.select(*keys, "node").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.select(*keys, "src", "dst").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("edges"))
    out = n.join(large(e), keys, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    density = F.coalesce(safe_ratio(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0))
    return out.withColumn("density", density).withColumn("avg_fan", F.col("edges") / F.col("nodes"))


def fan_counts(names: DataFrame, edges: DataFrame, keys: list[str] = ["file_id"]) -> DataFrame:  # noqa: B006
    """keys, node, fan_in, fan_out, 0 where there is none."""
    e = edges.select(*keys, "src", "dst").distinct()
    into = e.groupBy(*keys, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    out = e.groupBy(*keys, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    return names.select(*keys, "node").distinct().join(large(into), [*keys, "node"], "left").join(large(out), [*keys, "node"], "left").fillna(0, ["fan_in", "fan_out"])


def call_graph(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """One row for each file with functions: density, depth and what it calls in other modules: pairs of caller and
    module in the callers' order, the modules of each caller (cross_module_calls) and of all (modules_called), by name."""
    named = keep(qualified(nodes, functions))  # edges, names and callers are read from it, and each of them twice
    edges, cross = map(keep, resolve_calls(named))
    names = named.select("file_id", F.col("qual").alias("node"))
    ordered = named.select("file_id", F.col("qual").alias("node"), F.col("fn").alias("at"))
    depth = longest_paths(edges, ordered, ["file_id"]).groupBy("file_id").agg(F.max("depth").cast("long").alias("max_intra_file_call_depth"))
    first = named.select("file_id", F.col("qual").alias("caller"), F.col("fn").alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "module", "caller")))
    calls = cross.groupBy("file_id", "caller").agg(F.array_sort(F.collect_set("module")).alias("modules"))
    calls = calls.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("caller", "modules")))).alias("cross_module_calls"))
    outside = cross.join(large(first), ["file_id", "caller"]).groupBy("file_id").agg(
        F.count_distinct("module").alias("inter_file_coupling"), F.array_sort(F.collect_set("module")).alias("modules_called"), F.transform(listed, lambda x: F.struct(x["caller"].alias("caller"), x["module"].alias("module"))).alias("cross_file_call_edges")
    )
    return graph_metrics(names, edges).withColumnRenamed("density", "call_graph_density").join(large(depth), "file_id", "left").join(large(outside), "file_id", "left").join(large(calls), "file_id", "left")
