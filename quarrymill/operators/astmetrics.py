"""Metrics of functions, classes and files from the nodes of their syntax trees.

Everything groups by file_id (and a node within it): nodes that are dealt by file_id once need no further shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions.core import entropy, over_at_least_one, overlap_mismatch, safe_ratio, stripped, words
from quarrymill.operators.kept import large
from quarrymill.operators.nodes import CONTROLS, DECISIONS, DEFS

def _is_def():  # noqa: ANN202
    return F.col("kind").isin(*DEFS)


def function_metrics(nodes: DataFrame) -> DataFrame:
    """One row for each def, nested ones included; what a nested def holds counts in all around it."""
    defs = nodes.where(_is_def()).select(
        "file_id", F.col("pre").alias("fn"), "name", "parent", (F.col("in_body") & (F.col("parent_kind") == "ClassDef")).alias("is_method"),
        F.size("args").alias("args_count"), F.col("n_defaults").alias("default_args"), "lineno", (F.col("n_decorators") > 0).alias("has_decorators"),
        F.col("doc").isNotNull().alias("has_docstring"), (F.col("kind") == "AsyncFunctionDef").alias("is_async"),
        (F.col("end_lineno") - F.col("lineno") + 1).alias("loc"), "ctl", F.col("doc").alias("doc"), entropy(F.array_join("args", "")).alias("param_entropy"),
    )
    inside = nodes.select("file_id", F.explode("fns").alias("fn"), "kind", "name", "base", "ctl", "n_values")
    kind, base = F.col("kind"), F.col("base")
    found = inside.groupBy("file_id", "fn").agg(
        (1 + F.count_if(kind.isin(*DECISIONS))).alias("cyclomatic_complexity"),
        F.max(F.when(kind.isin(*CONTROLS), F.col("ctl"))).alias("_deepest"),
        F.array_sort(F.collect_set(F.when(kind == "Call", F.col("name")))).alias("calls_made"),
        F.count_if((kind == "Attribute") & (base == "self")).alias("internal_attr_access"),
        F.count_if((kind == "Attribute") & base.isNotNull() & (base != "self")).alias("external_attr_access"),
        F.count_if(kind == "BoolOp").alias("bool_ops"),
        F.coalesce(F.sum(F.when(kind == "BoolOp", F.col("n_values"))), F.lit(0)).cast("long").alias("bool_terms"),
        F.collect_set(F.lower(F.when(kind == "Name", F.col("name")).when(kind == "Call", base))).alias("_tokens"),
    )
    out = defs.join(large(found), ["file_id", "fn"])
    cc, loc = F.col("cyclomatic_complexity"), F.greatest(F.lit(1), F.col("loc"))
    return (
        out.withColumn("nesting", F.greatest(F.lit(0), F.coalesce(F.col("_deepest"), F.col("ctl")) - F.col("ctl")))
        .withColumn("num_calls", F.size("calls_made"))
        .withColumn("cc_loc_ratio", cc / loc)
        .withColumn("feature_envy_ratio", over_at_least_one(F.col("external_attr_access"), F.col("internal_attr_access") + 1))
        .withColumn("code_tokens", F.array_union(F.col("_tokens"), F.array(F.lower("name"))))
        .drop("_deepest", "_tokens", "ctl")
    )


def class_metrics(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """One row for each class, nested ones included."""
    heads = nodes.where("kind = 'ClassDef'").select(
        "file_id", F.col("pre").alias("cls"), "name", (F.size("bases") > 0).alias("has_inheritance"), F.col("doc").isNotNull().alias("has_docstring"),
        (F.col("end_lineno") - F.col("lineno")).alias("line_count"),
    )
    direct = nodes.where("in_body AND parent_kind = 'ClassDef'").groupBy("file_id", F.col("parent").alias("cls"))
    counts = direct.agg(F.count_if(_is_def()).alias("methods"), F.count_if(F.col("kind").isin("Assign", "AnnAssign")).alias("attributes"))
    outward = lambda c: c.contains(".") & ~c.startswith("self")
    calls = functions.where("is_method").groupBy("file_id", F.col("parent").alias("cls"))
    calls = calls.agg(
        F.sum(F.size(F.filter("calls_made", outward))).alias("external_calls"), F.sum(F.size(F.filter("calls_made", lambda c: ~outward(c)))).alias("internal_calls")
    )
    out = heads.join(large(counts), ["file_id", "cls"], "left").join(large(calls), ["file_id", "cls"], "left").fillna(0, ["methods", "attributes", "external_calls", "internal_calls"])
    return out.withColumn("lazy_ratio", over_at_least_one(F.col("attributes"), F.col("methods")))


def _names_of(kind: str):  # noqa: ANN202
    """The names that nodes of a kind hold, in the file's order."""
    rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pre", "names"))))
    return F.flatten(F.transform(rows, lambda x: x["names"]))


def class_rollup(classes: DataFrame) -> DataFrame:
    """File figures over its classes: how many, their mean number of methods, and how many inherit and have a docstring."""
    return classes.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("total_classes"), F.avg("methods").alias("average_methods_per_class"),
        F.count_if("has_inheritance").alias("classes_with_inheritance"), F.count_if("has_docstring").alias("classes_with_docstring"),
    )


def file_structure(nodes: DataFrame) -> DataFrame:
    """Counts of one file's nodes, in one aggregation."""
    kind = F.col("kind")
    documented = (_is_def() | (kind == "ClassDef")) & (F.length("doc") > 0)
    names = F.when(kind == "FunctionDef", F.concat(F.array("name"), F.col("args"))).when(kind == "ClassDef", F.array("name")).when(kind == "Assign", F.col("targets"))
    short = F.filter(names, lambda x: x.rlike("^[A-Za-z]{1,3}$"))
    found = nodes.groupBy("file_id").agg(
        F.bool_or(kind == "__error__").alias("failed"),
        F.count_if(kind == "ClassDef").alias("classes"),
        F.count_if(kind == "FunctionDef").alias("functions"),
        F.count_if(kind == "AsyncFunctionDef").alias("async_functions"),
        F.count_if(kind.isin(*CONTROLS)).alias("controls"),
        F.coalesce(F.max(F.when(kind.isin(*CONTROLS), F.col("nesting"))), F.lit(0)).alias("max_nesting_level"),
        F.coalesce(F.sum(F.when(kind.isin("Import", "ImportFrom"), F.size("names"))), F.lit(0)).cast("long").alias("total_imports"),
        _names_of("Import").alias("imports"),
        _names_of("ImportFrom").alias("import_froms"),
        F.count_if(documented).alias("documented"),
        F.count_if(_is_def() | (kind == "ClassDef")).alias("documentable"),
        F.coalesce(F.sum(F.size(names)), F.lit(0)).cast("long").alias("identifiers"),
        F.coalesce(F.sum(F.size(short)), F.lit(0)).cast("long").alias("short_identifiers"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(short)))), 1, 20).alias("abbrev_examples"),
        F.count_distinct(F.when(kind == "BinOp", F.col("name"))).alias("distinct_operators"),
        F.count_distinct(F.when(kind == "Name", F.col("name")).when(kind == "Constant", F.col("value"))).alias("distinct_operands"),
        F.count_if(kind == "BinOp").alias("total_operators"),
        F.count_if(kind.isin("Name", "Constant")).alias("total_operands"),
        F.collect_list(F.when(F.col("doc").isNotNull(), F.struct(F.col("doc_start").alias("low"), F.col("doc_end").alias("high")))).alias("doc_ranges"),
    )
    none = (F.col("distinct_operators") == 0) | (F.col("distinct_operands") == 0)
    volume = (F.col("total_operators") + F.col("total_operands")) * F.log2((F.col("distinct_operators") + F.col("distinct_operands")).cast("double"))
    difficulty = F.col("distinct_operators") / 2 * safe_ratio(F.col("total_operands"), F.col("distinct_operands"))
    return (
        found.withColumn("average_cyclomatic_complexity", (F.col("controls") + 1) / F.greatest(F.lit(1), F.col("functions")))
        .withColumn("documentation_coverage", over_at_least_one(F.col("documented"), F.col("documentable")))
        .withColumn("abbreviation_density", F.coalesce(safe_ratio(F.col("short_identifiers"), F.col("identifiers")), F.lit(0.0)))
        .withColumn("halstead_volume", F.when(none, 0.0).otherwise(volume))
        .withColumn("halstead_difficulty", F.when(none, 0.0).otherwise(difficulty))
        .withColumn("halstead_effort", F.when(none, 0.0).otherwise(volume * difficulty))
        .withColumn("halstead_estimated_bugs", F.when(none, 0.0).otherwise(volume / 3000))
    )


def mutations_outside_init(nodes: DataFrame) -> DataFrame:
    """file_id, attribute_mutations_outside_init: assignments to self.x in methods other than __init__. A method counts for the class whose
    body it stands in; a nested class's methods inside a method count once more there."""
    methods = nodes.where(_is_def() & F.col("in_body") & (F.col("parent_kind") == "ClassDef") & (F.col("name") != "__init__")).select("file_id", F.col("pre").alias("fn"))
    sets = nodes.where(F.col("kind").isin("Assign", "AugAssign") & (F.size("self_targets") > 0)).select("file_id", F.explode("fns").alias("fn"), F.size("self_targets").alias("n"))
    return sets.join(large(methods), ["file_id", "fn"]).groupBy("file_id").agg(F.sum("n").cast("long").alias("attribute_mutations_outside_init"))


def global_usage(nodes: DataFrame) -> DataFrame:
    """file_id, globals_declared, global_usages_total, usage_per_name: names assigned at module level, and their uses inside
    defs (in nested ones once for each). The map by name holds global statements too, of whatever name."""
    declared = nodes.where(F.col("kind").isin("Assign", "AnnAssign") & F.col("in_body") & (F.col("parent_kind") == "Module"))
    declared = declared.select("file_id", F.explode("targets").alias("name")).distinct().withColumn("declared", F.lit(True))
    depth = F.size("fns").cast("long")
    inside = nodes.where(F.size("fns") > 0)
    uses = inside.where("kind = 'Name'").select("file_id", "name", depth.alias("uses"), F.lit(0).cast("long").alias("stated"))
    stated = inside.where("kind = 'Global'").select("file_id", F.explode("names").alias("name"), F.lit(0).cast("long").alias("uses"), depth.alias("stated"))
    found = uses.union(stated).groupBy("file_id", "name").agg(F.sum("uses").alias("uses"), F.sum("stated").alias("stated"))
    both = declared.join(large(found), ["file_id", "name"], "full").fillna(False, ["declared"]).fillna(0, ["uses", "stated"])
    n = F.when(F.col("declared"), F.col("uses")).otherwise(F.lit(0)) + F.col("stated")
    each = F.when(n > 0, F.struct("name", n.alias("n")))
    out = both.groupBy("file_id").agg(
        F.count_if("declared").alias("globals_declared"), F.coalesce(F.sum(F.when(F.col("declared"), F.col("uses"))), F.lit(0)).cast("long").alias("global_usages_total"),
        F.map_from_entries(F.array_sort(F.collect_list(each))).alias("usage_per_name"), F.bool_or(F.col("declared") | (F.col("stated") > 0)).alias("_any"),
    )
    return out.where("_any").drop("_any")


def leading_comments(files: DataFrame, functions: DataFrame) -> DataFrame:
    """file_id, fn, leading: the comment lines directly above each def, in order, joined by a space.

    A line's block begins after the last line before it that is no comment, found by one window over the lines."""
    lines = files.select("file_id", F.posexplode(F.split("content", "\n")).alias("idx", "line"))
    comment = F.col("line").rlike(r"(?U)^\s*#")
    last_other = F.max(F.when(~comment, F.col("idx"))).over(W.partitionBy("file_id").orderBy("idx"))
    blocks = lines.withColumn("block", F.coalesce(last_other, F.lit(-1))).where(comment)
    text = stripped(F.regexp_replace(stripped(F.col("line")), "^#+", ""))
    joined = blocks.groupBy("file_id", "block").agg(F.max("idx").alias("end"), F.array_sort(F.collect_list(F.struct("idx", text.alias("text")))).alias("l"))
    joined = joined.select("file_id", "end", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("leading"))
    # the def's line, counted from 1, less 2 is the line above it
    return functions.select("file_id", "fn", (F.col("lineno") - 2).alias("end")).join(large(joined), ["file_id", "end"]).select("file_id", "fn", "leading")


def comment_mismatch(files: DataFrame, functions: DataFrame) -> DataFrame:
    """file_id, comment_code_mismatch_score: mean over defs with a docstring or comments above of 1 - |comment and code words| / |comment words|."""
    text = functions.select("file_id", "fn", "doc", "code_tokens").join(large(leading_comments(files, functions)), ["file_id", "fn"], "left")
    # a def without any comment is left out; a space stands between docstring and comments, so comments alone start with one
    said = text.where((F.length(F.coalesce("doc", F.lit(""))) > 0) | F.col("leading").isNotNull())
    score = overlap_mismatch(words(F.concat_ws(" ", F.coalesce("doc", F.lit("")), "leading")), F.col("code_tokens"))
    return said.groupBy("file_id").agg(F.avg(score).alias("comment_code_mismatch_score"))


def function_rollup(functions: DataFrame) -> DataFrame:
    """File figures over its functions."""
    return functions.groupBy("file_id").agg(
        F.coalesce(F.stddev_pop("nesting"), F.lit(0.0)).alias("nesting_variance"),
        F.avg("nesting").alias("nesting_mean"),
        F.coalesce(safe_ratio(F.sum("bool_terms"), F.sum("bool_ops")), F.lit(0.0)).alias("boolean_expression_avg_terms"),
        F.max("cc_loc_ratio").alias("max_cyclomatic_ratio"),
        F.avg("cc_loc_ratio").alias("mean_cyclomatic_ratio"),
        F.coalesce(F.avg("param_entropy"), F.lit(0.0)).alias("mean_param_entropy"),
        F.max("loc").cast("long").alias("max_lines_per_function"),
        F.avg("loc").alias("mean_lines_per_function"),
        over_at_least_one(F.sum("external_attr_access"), F.sum("internal_attr_access")).alias("external_vs_internal_field_access_ratio"),
        F.bool_or((F.col("loc") > 75) | (F.col("cyclomatic_complexity") > 15)).alias("long_method_indicator"),
        F.bool_or(F.col("args_count") > 6).alias("large_parameter_list_indicator"),
    )


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last one."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def maintainability(loc, controls_plus_one, documentation):  # noqa: ANN001, ANN201
    """100 less penalties for size, branching and missing documentation, within 0 and 100."""
    score = (
        F.lit(100)
        - F.when(loc > 200, 20).when(loc > 100, 10).otherwise(0)
        - F.when(controls_plus_one > 20, 20).when(controls_plus_one > 10, 10).otherwise(0)
        + F.when(documentation > 0.8, 10).when(documentation < 0.3, -15).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long")
