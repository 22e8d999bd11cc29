"""The stateless metrics on a stream of files, and commit bursts on a stream of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.core import split_lines


def stream_text_metrics(files: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """Per row, without state: lines, longest line, share of long lines, TODO count."""
    lines = split_lines(F.col(text))
    n = F.transform(lines, lambda x: F.length(x))
    return files.select(
        key, F.size(lines).alias("loc"), F.array_max(n).alias("max_line_length"), (100.0 * F.size(F.filter(n, lambda x: x > 80)) / F.size(lines)).alias("percent_lines_over_80"),
        F.regexp_count(F.col(text), F.lit(r"(?i)\b(TODO|FIXME)\b")).alias("todo_fixme_count"),
    )


def stream_bursts(commits: DataFrame, key: str, ts: str, lateness: str = "1 day", size: str = "8 days", slide: str = "1 day") -> DataFrame:
    """Commits by key in sliding windows; late ones are waited for, state of closed windows is dropped."""
    return commits.withWatermark(ts, lateness).groupBy(F.window(ts, size, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n_commits")).select(key, F.col("w.start").alias("start"), "n_commits")
