"""Version history and test files of a source file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400
#: A difference of whole days of at most 7 is one under 8 days.
BURST_SECONDS = 8 * DAY - 1


def burst(commits: DataFrame, key: list[str], seconds: Column) -> DataFrame:
    """key, commit_bursts: most commits from one commit on within under eight days."""
    w = W.partitionBy(*key).orderBy("_s").rangeBetween(0, BURST_SECONDS)
    return commits.withColumn("_s", seconds).withColumn("_n", F.count(F.lit(1)).over(w)).groupBy(*key).agg(F.max("_n").alias("commit_bursts"))


def totals(commits: DataFrame, key: list[str], seconds: Column, author: str, added: str, deleted: str) -> DataFrame:
    """key, n_commits, lines_added, lines_deleted, num_authors, file_age_days."""
    s = seconds
    return commits.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_commits"),
        F.coalesce(F.sum(added), F.lit(0)).alias("lines_added"),
        F.coalesce(F.sum(deleted), F.lit(0)).alias("lines_deleted"),
        F.count_distinct(author).alias("num_authors"),
        F.coalesce(F.floor((F.max(s) - F.min(s)) / DAY), F.lit(0)).cast("long").alias("file_age_days"),
    )


def cochanges(changes: DataFrame, commit: str, path: str, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """extra, path, other, together: commits that change both.

    Pairs are made inside a commit; a commit is bounded by its own size, and each pair is counted before the shuffle."""
    one = changes.select(*extra, commit, path).distinct()
    other = one.withColumnRenamed(path, "other")
    return one.join(other, [*extra, commit]).where(F.col(path) != F.col("other")).groupBy(*extra, path, "other").agg(F.count(F.lit(1)).alias("together"))


def top_coupled(pairs: DataFrame, path: str, k: int = 10, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """The k files most often changed with each, ties by name."""
    w = W.partitionBy(*extra, path).orderBy(F.desc("together"), "other")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def vcs_metrics(files: DataFrame, commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_id, repo, path), (repo, hash, author, ts), (repo, hash, path, added, deleted) -> one row for each file.

    Files of a repository without history have null figures and vcs_available false; an uncommitted file has zeros."""
    rows = changes.join(commits, ["repo", "hash"])
    seconds, key = F.unix_timestamp("ts"), ["repo", "path"]
    sums = totals(rows, key, seconds, "author", "added", "deleted").join(burst(rows, key, seconds), key)
    pairs = cochanges(changes, "hash", "path", ["repo"])
    counts = pairs.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("other", "together"))).alias("coupled_file_changes"))
    top = top_coupled(pairs, "path", 10, ["repo"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", F.col("other").alias("file"), F.col("together").alias("count")))).alias("_t"))
    top = top.select(*key, F.transform("_t", lambda x: F.struct(x["file"].alias("file"), x["count"].alias("count"))).alias("vcs_top_coupled"))
    repos = commits.select("repo").distinct().withColumn("vcs_available", F.lit(True))
    out = files.select("file_id", "repo", "path").join(repos, "repo", "left").join(sums, key, "left").join(counts, key, "left").join(top, key, "left")
    there = F.coalesce("vcs_available", F.lit(False))
    zero = ["lines_added", "lines_deleted", "num_authors", "file_age_days", "commit_bursts"]
    return out.select(
        "file_id", there.alias("vcs_available"), *[F.when(there, F.coalesce(F.col(c), F.lit(0))).alias(c) for c in zero],
        F.when(there, F.coalesce("coupled_file_changes", F.create_map().cast("map<string,bigint>"))).alias("coupled_file_changes"),
        F.when(there, F.coalesce("vcs_top_coupled", F.array().cast("array<struct<file:string,count:bigint>>"))).alias("vcs_top_coupled"),
    )


def directories(path: Column) -> Column:
    """All directories above a path, the nearest last; '' is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def test_links(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, content) -> figures of the test files in the file's directory and below.

    Each test file names all directories above it, so files meet tests by an equality of directory; what the directory
    sums up is aggregated first, and only the name test looks at pairs of one directory."""
    name = F.element_at(F.split("path", "/"), -1)
    tests = files.where((name.startswith("test_") | name.endswith("_test.py")) & name.endswith(".py"))
    lines = F.split(F.regexp_replace("content", r"(\r\n|\r|\n|\x0b|\f|\x1c|\x1d|\x1e|\x{85}|\x{2028}|\x{2029})\z", ""), r"\r\n|\r|\n|\x0b|\f|\x1c|\x1d|\x1e|\x{85}|\x{2028}|\x{2029}")
    lines = F.when(F.length("content") == 0, F.array().cast("array<string>")).otherwise(lines)
    tests = tests.select("repo", F.explode(directories(F.col("path"))).alias("dir"), F.regexp_replace(name, r"\.[^.]*$", "").alias("test_stem"),
                         F.size(lines).alias("n"), F.size(F.filter(lines, lambda x: x.rlike(r"^\s*def\s+test_"))).alias("fns"))
    sums = tests.groupBy("repo", "dir").agg(F.count(F.lit(1)).alias("test_files_found"), F.sum("n").alias("test_lines"), F.sum("fns").alias("test_function_count"))
    own = files.select("file_id", "repo", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))
    # names of a directory meet once, however many files and tests have them
    stems, tested = own.select("repo", "dir", "stem").distinct(), tests.select("repo", "dir", "test_stem").distinct()
    named = stems.join(tested, ["repo", "dir"]).where(F.contains("test_stem", "stem")).select("repo", "dir", "stem").distinct().withColumn("unit_test_presence", F.lit(True))
    out = own.join(sums, ["repo", "dir"], "left").join(named, ["repo", "dir", "stem"], "left")
    return out.select("file_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("test_files_found", "test_lines", "test_function_count")], F.coalesce("unit_test_presence", F.lit(False)).alias("unit_test_presence"))
