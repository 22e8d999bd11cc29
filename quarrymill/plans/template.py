"""A corpus of Python files made from the part table, whose metrics have closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _each(n: Column, make) -> Column:  # noqa: ANN001
    """Lines made for 0, 1, ... n - 1, in a row."""
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), make))


def template_files(part: DataFrame) -> DataFrame:
    """(p_partkey, p_size) -> file_id, repo, path, content, status. nf functions of ni conditions, nc classes, k
    imported names, docstrings in every other file."""
    nf, ni, nc = (F.col("p_size") % 4 + 1).cast("int"), (F.col("p_partkey") % 3 + 1).cast("int"), (F.col("p_partkey") % 2 + 1).cast("int")
    k, doc = (F.col("p_size") % 3 + 1).cast("int"), F.col("p_partkey") % 2 == 0
    lit = F.lit
    none = F.array().cast("array<string>")

    def function(i: Column) -> Column:
        head = F.array(F.concat(lit("def f"), i.cast("string"), lit("(alpha, n=1):")))
        tests = F.flatten(F.array_repeat(F.array(lit("    if alpha and n:"), lit("        n = n + LIMIT")), ni))
        call = F.when(i > 0, F.array(F.concat(lit("    f"), (i - 1).cast("string"), lit("(n)")))).otherwise(none)
        return F.concat(head, F.when(doc, F.array(lit('    """Return n."""'))).otherwise(none), tests, F.array(lit("    os.path.join(str(n))")), call, F.array(lit("    return n")))

    def klass(c: Column) -> Column:
        name = F.concat(lit("class K"), c.cast("string"), F.when(c > 0, F.concat(lit("(K"), (c - 1).cast("string"), lit(")"))).otherwise(lit("")), lit(":"))
        body = ["    def __init__(self, x):", "        self.x = x", "    def put(self, y):", "        self.y = y", "        return self.x"]
        return F.concat(F.array(name, F.concat(lit("    kind = "), c.cast("string"))), F.array(*[lit(x) for x in body]))

    names = F.array_join(F.transform(F.sequence(lit(0), k - 1), lambda i: F.concat(lit("a"), i.cast("string"))), ", ")
    head = F.array(F.concat(lit('"""Part '), F.col("p_partkey").cast("string"), lit('."""')), lit("import os, sys"), F.concat(lit("from pkg import "), names), lit("LIMIT = 3"))
    lines = F.concat(head, _each(nf, function), _each(nc, klass), F.array(lit("")))
    return part.select(F.col("p_partkey").cast("long").alias("file_id"), lit("parts").alias("repo"), F.concat(lit("parts/p"), F.col("p_partkey").cast("string"), lit(".py")).alias("path"), F.array_join(lines, "\n").alias("content"), lit("ok").alias("status"))


#: The same figures in SQL: a table tpl of the template's numbers.
SQL_NUMBERS = """tpl AS (
    SELECT p_partkey::BIGINT AS file_id, (p_size % 4 + 1)::BIGINT AS nf, (p_partkey % 3 + 1)::BIGINT AS ni, (p_partkey % 2 + 1)::BIGINT AS nc,
        (p_size % 3 + 1)::BIGINT AS k, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS doc FROM part)"""
