"""One row for each file with all its metrics, and the pipeline from files to a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.core import over_at_least_one, python_round
from quarrymill.operators import astmetrics, features, history, labels, nodes, objects, textmetrics
from quarrymill.operators.kept import keep, large

#: Digits of the rounded columns. Rules read rounded figures.
ROUNDED = {"comment_percentage": 1, "average_cyclomatic_complexity": 2, "nesting_variance": 3, "decision_density": 4, "boolean_expression_avg_terms": 2, "call_graph_density": 4,
           "external_vs_internal_field_access_ratio": 3, "mean_lines_per_function": 2, "max_cyclomatic_ratio": 3, "mean_cyclomatic_ratio": 3, "mean_param_entropy": 3, "abbreviation_density": 3,
           "comment_code_mismatch_score": 3, "todo_fixme_semantic_density": 4, "halstead_volume": 2, "halstead_effort": 2, "halstead_difficulty": 2, "halstead_estimated_bugs": 4,
           "avg_line_length": 1, "percent_lines_over_80": 2, "test_to_source_ratio": 3, "average_methods_per_class": 2, "documentation_coverage": 1}


def analyze(files: DataFrame, commits: DataFrame | None = None, changes: DataFrame | None = None, mode: str = "parity", rounded: bool = True) -> DataFrame:
    """(file_id, repo, path, content, status) -> the summary, 65 columns and file_id.

    Files are dealt by file_id and parsed once; their nodes are kept while the metrics are joined, until kept.release() is
    called. A file that can't be
    decoded or parsed has no row. strict gives class line figures, which parity leaves at 0."""
    good = files.where("status = 'ok'") if "status" in files.columns else files
    tree = keep(nodes.parse(nodes.spread(good)))
    structure = astmetrics.file_structure(tree).where("NOT failed")
    functions = keep(astmetrics.function_metrics(tree))
    ranged = good.join(large(structure.select("file_id", "doc_ranges")), "file_id")
    lines = textmetrics.line_metrics(ranged)
    out = good.select("file_id", F.col("path").alias("file_path")).join(large(structure.drop("doc_ranges", "failed")), "file_id").join(large(lines), "file_id")
    classes = objects.oo_metrics(tree, functions)
    parts = [
        astmetrics.function_rollup(functions), objects.oo_rollup(classes).drop("average_inheritance_depth", "average_wmc", "average_cbo", "max_wmc"), objects.call_graph(tree, functions).drop("cross_module_calls", "modules_called"),
        astmetrics.mutations_outside_init(tree), astmetrics.global_usage(tree).drop("usage_per_name"), astmetrics.comment_mismatch(good, functions), textmetrics.style_violations(good),
        textmetrics.todo_metrics(good), history.test_links(files),
    ]
    if mode == "strict":
        sizes = astmetrics.class_metrics(tree, functions).groupBy("file_id")
        parts.append(sizes.agg(F.max("line_count").cast("long").alias("max_lines_per_class"), F.avg("line_count").alias("mean_lines_per_class"), F.bool_or(F.col("lazy_ratio") > 3).alias("lazy_class_indicator")))
    if commits is not None and changes is not None:
        parts.append(history.vcs_metrics(files, commits, changes))
    for x in parts:
        out = out.join(large(x), "file_id", "left")
    nulls = {"vcs_available": F.lit(False)} | {c: F.lit(None).cast("long") for c in ("lines_added", "lines_deleted", "num_authors", "file_age_days", "commit_bursts")}
    nulls |= {"coupled_file_changes": F.lit(None).cast("map<string,bigint>"), "vcs_top_coupled": F.lit(None).cast("array<struct<file:string,count:bigint>>")}
    nulls |= {"max_lines_per_class": F.lit(0).cast("long"), "mean_lines_per_class": F.lit(0.0), "lazy_class_indicator": F.lit(False)}
    out = out.withColumns({c: e for c, e in nulls.items() if c not in out.columns})
    sloc = F.col("sloc")
    out = out.withColumns({
        "lines_of_code": F.col("loc"), "source_lines": sloc, "comment_lines": F.col("cloc"), "comment_percentage": 100 * F.col("comment_density"),
        "decision_density": over_at_least_one(F.col("controls"), sloc), "maintainability_score": astmetrics.maintainability(F.col("loc"), F.col("controls") + 1, F.col("documentation_coverage")),
        "documentation_coverage": 100 * F.col("documentation_coverage"), "todo_fixme_semantic_density": F.col("todo_density"),
        "test_to_source_ratio": over_at_least_one(F.col("test_lines"), sloc),
    })
    zeros = ["nesting_variance", "boolean_expression_avg_terms", "max_cyclomatic_ratio", "mean_cyclomatic_ratio", "mean_param_entropy", "mean_lines_per_function", "call_graph_density",
             "external_vs_internal_field_access_ratio", "comment_code_mismatch_score", "average_methods_per_class"]
    counts = ["max_lines_per_function", "methods", "classes_with_inheritance", "max_intra_file_call_depth", "inter_file_coupling", "attribute_mutations_outside_init", "globals_declared", "global_usages_total"]
    out = out.fillna(0.0, zeros).fillna(0, counts).fillna(False, ["long_method_indicator", "large_parameter_list_indicator"])
    out = out.withColumn("cross_file_call_edges", F.coalesce("cross_file_call_edges", F.array().cast("array<struct<caller:string,module:string>>")))
    out = out.withColumn("god_class_proxies", F.coalesce("god_class_proxies", F.array().cast(out.schema["god_class_proxies"].dataType)))
    if rounded:
        out = out.withColumns({c: python_round(F.col(c), d) for c, d in (ROUNDED | {"irregularity_score": 4, "indent_stddev": 2}).items()})
    out = out.withColumn("semantic_todo_density", F.col("todo_fixme_semantic_density"))
    out = out.withColumn("indentation_irregularity", F.struct("irregularity_score", "tab_lines", "mixed_tabs", "indent_stddev"))
    return out.select("file_id", *SUMMARY)


SUMMARY = sorted(
    """abbreviation_density attribute_mutations_outside_init average_cyclomatic_complexity average_methods_per_class avg_line_length boolean_expression_avg_terms call_graph_density classes
    classes_with_inheritance comment_code_mismatch_score comment_lines comment_percentage commit_bursts coupled_file_changes cross_file_call_edges decision_density documentation_coverage
    external_vs_internal_field_access_ratio file_age_days file_path functions global_usages_total globals_declared god_class_proxies halstead_difficulty halstead_effort halstead_estimated_bugs
    halstead_volume indentation_irregularity inter_file_coupling large_parameter_list_indicator lazy_class_indicator lines_added lines_deleted lines_of_code long_method_indicator
    maintainability_score max_cyclomatic_ratio max_intra_file_call_depth max_line_length max_lines_per_class max_lines_per_function max_nesting_level mean_cyclomatic_ratio mean_lines_per_class
    mean_lines_per_function mean_param_entropy methods nesting_variance num_authors pep8_examples pep8_violations percent_lines_over_80 semantic_todo_density source_lines test_files_found
    test_function_count test_lines test_to_source_ratio todo_fixme_count todo_fixme_semantic_density total_imports unit_test_presence vcs_available vcs_top_coupled""".split()
)


def label(summary: DataFrame, mode: str = "parity") -> DataFrame:
    return labels.label(summary, mode)


def build_dataset(records: DataFrame) -> DataFrame:
    """Records with their columns in order of name."""
    return records.select(*sorted(records.columns))


def engineer(records: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    return features.engineer(records, bounds)
