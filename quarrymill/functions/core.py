"""Column functions with Python's meaning of text, rounding and statistics."""

from __future__ import annotations

import ast
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that hold nothing but white space, in Python's sense.
BLANK = r"(?U)^\s*$"


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """Lines as split on a line feed: a final line feed makes one more, empty line."""
    return F.split(text, "\n")


def rstripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)\s+$", "")


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def over_at_least_one(a: Column, b: Column) -> Column:
    """a / max(1, b)."""
    return a.cast("double") / F.greatest(F.lit(1), b)


def round_half_even(x: np.ndarray, digits: int) -> np.ndarray:
    """round() of Python for a whole array: scaled and rounded at once; only numbers so near a half that scaling may decide
    wrongly are rounded one by one."""
    scale = 10.0**digits
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = x * scale
        out = np.rint(scaled) / scale
        far = np.abs(scaled) >= 2.0**52
        near = (np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-9 * np.maximum(1.0, np.abs(scaled))) & np.isfinite(x)
    for i in np.flatnonzero(near | (far & np.isfinite(x))):
        out[i] = round(float(x[i]), digits)
    return np.where(np.isfinite(x), out, x)


def python_round(x: Column, digits: int) -> Column:
    """Half-even on the number's exact binary value: what SQL's rounding of decimal text cannot give."""

    @F.arrow_udf("double")
    def rounded(column: pa.Array) -> pa.Array:
        gone = np.asarray(column.is_null())
        values = np.asarray(column.fill_null(0.0), np.float64)
        return pa.array(round_half_even(values, digits), pa.float64(), mask=gone)

    return rounded(x.cast("double"))


def entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of the characters of a text; null for an empty one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    bits = F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(n > 0, bits)


def words(text: Column) -> Column:
    """Identifier-like words in lower case, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)))


def overlap_mismatch(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a|, 1 where a is empty."""
    return F.when(F.size(a) > 0, 1 - F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def repo_name(url: Column, strict: bool = False) -> Column:
    """Last part of a URL without .git: anywhere in it, or (strict) at its end only."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.regexp_replace(last, r"\.git$", "") if strict else F.replace(last, F.lit(".git"), F.lit(""))


#: Extensions of the languages that are kept.
LANGUAGES = {".py": "Python", ".java": "Java", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".h": "C++", ".hpp": "C++"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def file_class(path: Column) -> Column:
    """git, kept or other."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.startswith(".git"), "git").when(language(path).isNotNull(), "kept").otherwise("other")


def is_extractable(path: Column) -> Column:
    """Is a file taken out of a repository? Its extension is kept, and no .git stands anywhere in its directory's path."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    return language(path).isNotNull() & ~folder.contains(".git")


def literal_json(text: str | None) -> str | None:
    """A Python literal as JSON; null if it is none."""
    try:
        return json.dumps(ast.literal_eval(text.strip()), default=lambda x: sorted(x, key=str) if isinstance(x, set | frozenset) else str(x))
    except (AttributeError, ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def safe_parse_json(text: Column, schema: str) -> Column:
    """JSON by schema; text that is no JSON is read as a Python literal; else null. Only the latter text goes to Python."""

    @F.arrow_udf("string")
    def literals(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else literal_json(x) for x in column.to_pylist()], pa.string())

    usable = F.try_parse_json(text).isNotNull()
    other = F.when(~usable & (F.trim(text) != ""), text)
    return F.when(F.trim(text) == "", None).when(usable, F.from_json(text, schema)).otherwise(F.from_json(literals(other), schema))
