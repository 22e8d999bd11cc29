"""Thirteen threshold rules on a file's summary, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in the order of the list of findings: name, severity, condition. All comparisons are strict.
RULES = [
    ("LongMethod", "MAJOR", "functions > 0 AND (max_lines_per_function > 50 OR max_cyclomatic_ratio > 0.5 OR max_nesting_level > 4)"),
    ("LargeParameterList", "MINOR", "functions > 0 AND (large_parameter_list_indicator OR mean_param_entropy > 2.0)"),
    ("LazyClass", "MINOR", "classes > 0 AND average_methods_per_class < 2 AND mean_lines_per_class < 50"),
    ("GodClass", "CRITICAL", "classes > 0 AND (inter_file_coupling > 20 OR n_cross_calls > 15 OR average_cyclomatic_complexity > 15)"),
    ("SpaghettiCode", "MAJOR", "functions > 0 AND (average_cyclomatic_complexity > 10 OR nesting_variance > 1.5)"),
    ("PoorDocumentation", "MINOR", "lines_of_code > 20 AND (documentation_coverage < 20 OR comment_percentage < 5)"),
    ("MisleadingComments", "MINOR", "comment_code_mismatch_score > 0.7"),
    ("GlobalStateAbuse", "MAJOR", "globals_declared > 3 OR global_usages_total > 10"),
    ("FeatureEnvy", "MINOR", "functions > 0 AND (external_vs_internal_field_access_ratio > 3 OR n_cross_calls > 10)"),
    ("ShotgunSurgery", "MAJOR", "commit_bursts > 3 AND inter_file_coupling > 10"),
    ("FormattingIssues", "INFO", "pep8_violations > 5 OR irregularity_score > 1.0"),
    ("UntestedCode", "MAJOR", "lines_of_code > 50 AND NOT unit_test_presence"),
    ("UnstableModule", "MINOR", "commit_bursts > 5 OR lines_added > 500"),
]
#: Order of the label vector.
VECTOR = ["LongMethod", "LargeParameterList", "GodClass", "LazyClass", "SpaghettiCode", "PoorDocumentation", "MisleadingComments", "GlobalStateAbuse", "FeatureEnvy", "ShotgunSurgery", "UntestedCode", "FormattingIssues", "UnstableModule"]
#: What a missing column counts as; a column that is there and null is another matter.
DEFAULTS = {"documentation_coverage": 100.0, "comment_percentage": 100.0, "large_parameter_list_indicator": False, "unit_test_presence": False}
INPUTS = ["functions", "classes", "max_lines_per_function", "max_cyclomatic_ratio", "max_nesting_level", "large_parameter_list_indicator", "mean_param_entropy", "average_methods_per_class",
          "mean_lines_per_class", "inter_file_coupling", "n_cross_calls", "average_cyclomatic_complexity", "nesting_variance", "lines_of_code", "documentation_coverage", "comment_percentage",
          "comment_code_mismatch_score", "globals_declared", "global_usages_total", "external_vs_internal_field_access_ratio", "commit_bursts", "pep8_violations", "irregularity_score",
          "unit_test_presence", "lines_added"]


def label(records: DataFrame, mode: str = "parity") -> DataFrame:
    """Adds y_<rule> for each rule and smells, the findings in order.

    parity: a record that lacks a figure that is compared (its commit bursts are null) has no label at all, as a rule that
    cannot be evaluated voids the record. strict: null counts as the default of a missing column."""
    out = records
    if "n_cross_calls" not in out.columns:
        calls = F.coalesce(F.size("cross_file_call_edges"), F.lit(0)) if "cross_file_call_edges" in out.columns else F.lit(0)
        out = out.withColumn("n_cross_calls", F.greatest(F.lit(0), calls))
    if "irregularity_score" not in out.columns and "indentation_irregularity" in out.columns:
        out = out.withColumn("irregularity_score", F.coalesce(F.col("indentation_irregularity")["irregularity_score"], F.lit(0.0)))
    for c in INPUTS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(DEFAULTS.get(c, 0)))
    if mode == "parity":
        # lines_added is only looked at where commit_bursts alone doesn't decide
        void = F.col("commit_bursts").isNull() | (F.col("lines_added").isNull() & ~(F.col("commit_bursts") > 5))
        test = out.withColumn("_void", void)
    else:
        test = out.withColumns({c: F.coalesce(F.col(c), F.lit(DEFAULTS.get(c, 0))) for c in INPUTS}).withColumn("_void", F.lit(False))
    hit = {name: F.when(F.col("_void"), F.lit(0)).otherwise(F.when(F.expr(condition), 1).otherwise(0)) for name, _, condition in RULES}
    test = test.withColumns({f"y_{n}": hit[n] for n in sorted(hit)})
    found = [F.when(F.col(f"y_{n}") == 1, F.struct(F.lit(n).alias("type"), F.lit(s).alias("severity"))) for n, s, _ in RULES]
    kept = [c for c in records.columns]
    return test.withColumn("smells", F.array_compact(F.array(*found))).select(*kept, *[f"y_{n}" for n in sorted(hit)], "smells")


def label_vector(prefix: str = "y_") -> Column:
    """The 13 labels in the order of VECTOR."""
    return F.array(*[F.col(f"{prefix}{n}") for n in VECTOR])


def vector_of(smells: Column) -> Column:
    """The vector of a list of findings; unknown types are ignored."""
    types = F.transform(smells, lambda s: s["type"])
    return F.array(*[F.array_contains(types, n).cast("int") for n in VECTOR])
