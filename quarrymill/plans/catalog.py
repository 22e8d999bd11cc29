"""Queries of the engine on the given tables, and their SQL.

The tables hold no source code: text operators run on documents, tree operators on files made from parts, history on
events and order lines, rules and features on figures of customers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions import core
from quarrymill.operators import astmetrics, evaluation, features, graphs, history, labels, models, nodes, objects, textmetrics
from quarrymill.operators.kept import keep, large
from quarrymill.plans.template import SQL_NUMBERS, template_files
from quarrymill.sources import datasets, repos

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: str, digits: int = 6) -> F.Column:
    return F.round(c, digits).alias(c)


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


# --- text ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {LINES} SELECT doc_id, count(*)::BIGINT AS loc, count(*) FILTER (trim(line) <> '' AND NOT starts_with(ltrim(line), '#'))::BIGINT AS sloc,
    count(*) FILTER (trim(line) <> '' AND starts_with(ltrim(line), '#'))::BIGINT AS cloc, count(*) FILTER (trim(line) = '')::BIGINT AS blank_lines,
    round(count(*) FILTER (trim(line) <> '' AND starts_with(ltrim(line), '#')) / count(*), 6) AS comment_density FROM l GROUP BY doc_id""")
def doc_size_metrics(spark: SparkSession, d: str) -> DataFrame:
    return textmetrics.line_metrics(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", "loc", "sloc", "cloc", "blank_lines", _r("comment_density"))


@query(f"""WITH {LINES}, t AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(?:TODO|FIXME)\\b'))::BIGINT AS todo_fixme_count FROM documents)
    SELECT doc_id, round(avg(length(line)), 6) AS avg_line_length, max(length(line))::BIGINT AS max_line_length,
    round(100.0 * count(*) FILTER (length(line) > 80) / count(*), 6) AS percent_lines_over_80, any_value(todo_fixme_count) AS todo_fixme_count FROM l JOIN t USING (doc_id) GROUP BY doc_id""")
def doc_style(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    todo = textmetrics.todo_metrics(docs, "doc_id", "text").select("doc_id", "todo_fixme_count")
    return textmetrics.line_metrics(docs, "doc_id", "text").join(todo, "doc_id").select("doc_id", _r("avg_line_length"), "max_line_length", _r("percent_lines_over_80"), "todo_fixme_count")


@query(f"""WITH {LINES}, i AS (SELECT doc_id, line, regexp_extract(line, '^[ \\t]*') AS lead FROM l WHERE trim(line) <> '')
    SELECT doc_id, count(*) FILTER (contains(lead, chr(9)))::BIGINT AS tab_lines, count(*) FILTER (contains(lead, chr(9)) AND contains(lead, ' '))::BIGINT AS mixed_tabs,
    round(stddev_pop(length(replace(lead, chr(9), '    '))), 6) AS indent_stddev,
    round(coalesce(stddev_pop(length(replace(lead, chr(9), '    '))) / nullif(avg(length(replace(lead, chr(9), '    '))), 0), 0), 6) AS irregularity_score FROM i GROUP BY doc_id""")
def doc_indent(spark: SparkSession, d: str) -> DataFrame:
    return textmetrics.line_metrics(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", "tab_lines", "mixed_tabs", _r("indent_stddev"), _r("irregularity_score"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents),
    e AS (SELECT doc_id, idx, 0 AS kind FROM l WHERE length(line) > 79 UNION ALL SELECT doc_id, idx, 1 FROM l WHERE rtrim(line) <> line),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, kind) AS place FROM e)
    SELECT doc_id, count(place)::BIGINT AS pep8_violations, count(place) FILTER (place <= 20)::BIGINT AS shown
    FROM documents LEFT JOIN (SELECT * FROM n WHERE kind = 0 OR place <= 20) USING (doc_id) GROUP BY doc_id""")
def doc_pep8_capped(spark: SparkSession, d: str) -> DataFrame:
    return textmetrics.style_violations(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", "pep8_violations", F.size("pep8_examples").cast("long").alias("shown"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber::BIGINT * 3 AS low, floor(l_linenumber * 3 + l_quantity % 3)::BIGINT AS high FROM lineitem),
    o AS (SELECT *, CASE WHEN low <= max(high) OVER w + 1 THEN 0 ELSE 1 END AS opens FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY l_orderkey ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM o),
    m AS (SELECT l_orderkey, island, min(low) AS low, max(high) AS high FROM g GROUP BY ALL)
    SELECT l_orderkey, count(*)::BIGINT AS islands, sum(high - low + 1)::BIGINT AS covered FROM m GROUP BY l_orderkey""")
def doc_interval_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 3).cast("long").alias("low"), F.floor(F.col("l_linenumber") * 3 + F.col("l_quantity") % 3).cast("long").alias("high"))
    merged = textmetrics.merge_intervals(rows, ["l_orderkey"])
    return merged.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("islands"), F.sum(F.col("high") - F.col("low") + 1).alias("covered"))


@query("""WITH x AS (SELECT *, max(CASE WHEN role <> 'user' THEN turn END) OVER w AS o, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id, turn, (turn - coalesce(o + 1, f))::BIGINT AS block_lines FROM x WHERE role = 'assistant'""")
def doc_comment_block(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "conversations")
    return textmetrics.comment_blocks(rows, ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "turn", "block_lines")


@query(r"""WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]+')) AS w FROM benchmark),
    t AS (SELECT doc_id, doc_id % 40 AS item_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]+')) AS w FROM documents)
    SELECT t.doc_id, round(CASE WHEN len(t.w) = 0 THEN 1.0 ELSE 1 - len(list_intersect(t.w, b.w)) / len(t.w) END, 6) AS mismatch FROM t JOIN b USING (item_id)""")
def doc_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "benchmark").select("item_id", core.words(F.col("text")).alias("b"))
    t = _t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), core.words(F.col("text")).alias("w"))
    return t.join(b, "item_id").select("doc_id", F.round(core.overlap_mismatch(F.col("w"), F.col("b")), 6).alias("mismatch"))


@query(r"""WITH w AS (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part)
    SELECT p_brand, count(*)::BIGINT AS identifiers, count(*) FILTER (regexp_full_match(w, '[A-Za-z]{1,3}'))::BIGINT AS short_identifiers,
    round(count(*) FILTER (regexp_full_match(w, '[A-Za-z]{1,3}')) / count(*), 6) AS abbreviation_density FROM w GROUP BY p_brand""")
def abbrev_density(spark: SparkSession, d: str) -> DataFrame:
    w = _t(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("w"))
    short = F.count_if(F.col("w").rlike("^[A-Za-z]{1,3}$"))
    return w.groupBy("p_brand").agg(F.count(F.lit(1)).alias("identifiers"), short.alias("short_identifiers"), F.round(short / F.count(F.lit(1)), 6).alias("abbreviation_density"))


@query("""WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part), n AS (SELECT p_partkey, ch, count(*) AS v FROM c WHERE ch <> '' GROUP BY ALL),
    p AS (SELECT p_partkey, v / sum(v) OVER (PARTITION BY p_partkey) AS p FROM n)
    SELECT p_partkey, round(-sum(p * log2(p)), 6) AS param_entropy FROM p GROUP BY p_partkey""")
def param_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", F.round(core.entropy(F.col("p_name")), 6).alias("param_entropy"))


@query(r"""WITH o AS (SELECT doc_id, unnest(regexp_extract_all(text, '[.,;:!?|]')) AS t FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents),
    a AS (SELECT doc_id, count(DISTINCT t) AS n1, count(*) AS N1_ FROM o GROUP BY doc_id), b AS (SELECT doc_id, count(DISTINCT t) AS n2, count(*) AS N2_ FROM w GROUP BY doc_id)
    SELECT doc_id, n1::BIGINT AS operators, n2::BIGINT AS operands, round((N1_ + N2_) * log2(n1 + n2), 4) AS volume, round(n1 / 2 * (N2_ / n2), 4) AS difficulty FROM a JOIN b USING (doc_id)""")
def halstead_like(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[.,;:!?|]"), F.lit(0))).alias("t"), F.lit(0).alias("k")).union(
        docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("t"), F.lit(1).alias("k"))
    )
    one = lambda k: F.when(F.col("k") == k, F.col("t"))
    n = tokens.groupBy("doc_id").agg(F.count_distinct(one(0)).alias("operators"), F.count_distinct(one(1)).alias("operands"), F.count(one(0)).alias("a"), F.count(one(1)).alias("b"))
    n = n.where("operators > 0 AND operands > 0")
    volume = (F.col("a") + F.col("b")) * F.log2((F.col("operators") + F.col("operands")).cast("double"))
    return n.select("doc_id", "operators", "operands", F.round(volume, 4).alias("volume"), F.round(F.col("operators") / 2 * (F.col("b") / F.col("operands")), 4).alias("difficulty"))


# --- trees --------------------------------------------------------------------------------------------------------


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files and their nodes: dealt by file, parsed once, kept while a query's parts are joined."""
    files = template_files(_t(spark, d, "part"))
    return files, keep(nodes.parse(nodes.spread(files)))


def _tpl(select: str) -> str:
    return f"WITH {SQL_NUMBERS} {select}"


LOC = "(4 + nf * (3 + doc + 2 * ni) + nf - 1 + 7 * nc + 1)"


@query(_tpl("SELECT file_id, nc AS classes, nf + 2 * nc AS functions, 0::BIGINT AS async_functions, nf * ni AS controls FROM tpl"))
def tpl_structure(spark: SparkSession, d: str) -> DataFrame:
    return astmetrics.file_structure(_tree(spark, d)[1]).select("file_id", "classes", "functions", "async_functions", "controls")


@query(_tpl("SELECT file_id, 1 AS max_nesting_level, round((nf * ni + 1) / (nf + 2 * nc), 6) AS average_cyclomatic_complexity FROM tpl"))
def tpl_complexity(spark: SparkSession, d: str) -> DataFrame:
    return astmetrics.file_structure(_tree(spark, d)[1]).select("file_id", "max_nesting_level", _r("average_cyclomatic_complexity"))


@query(_tpl("""SELECT file_id, count(*)::BIGINT AS functions, sum(cc)::BIGINT AS cc, sum(loc)::BIGINT AS loc, max(loc)::BIGINT AS max_loc, sum(calls)::BIGINT AS calls, sum(inner_)::BIGINT AS internal FROM (
    SELECT file_id, 1 + 2 * ni AS cc, 3 + doc + 2 * ni + (i > 0)::INT AS loc, 2 + (i > 0)::INT AS calls, 0 AS inner_ FROM (SELECT *, unnest(range(0, nf)) AS i FROM tpl)
    UNION ALL SELECT file_id, 1, 2 + m, 0, 1 + m FROM (SELECT *, unnest(range(0, nc)) AS c FROM tpl), (VALUES (0), (1)) v(m)) GROUP BY file_id"""))
def tpl_functions(spark: SparkSession, d: str) -> DataFrame:
    f = astmetrics.function_metrics(_tree(spark, d)[1])
    return f.groupBy("file_id").agg(F.count(F.lit(1)).alias("functions"), F.sum("cyclomatic_complexity").alias("cc"), F.sum("loc").alias("loc"), F.max("loc").cast("long").alias("max_loc"),
                                    F.sum("num_calls").alias("calls"), F.sum("internal_attr_access").alias("internal"))


@query(_tpl("""SELECT file_id, round(nf / (nf + 2 * nc), 6) AS nesting_mean, round(sqrt(nf / (nf + 2 * nc) * (1 - nf / (nf + 2 * nc))), 6) AS nesting_variance FROM tpl"""))
def tpl_nesting(spark: SparkSession, d: str) -> DataFrame:
    return astmetrics.function_rollup(astmetrics.function_metrics(_tree(spark, d)[1])).select("file_id", _r("nesting_mean"), _r("nesting_variance"))


@query(_tpl("""SELECT file_id, nf * doc AS documented, nf + 3 * nc AS documentable, round(nf * doc / (nf + 3 * nc), 6) AS documentation_coverage FROM tpl"""))
def tpl_docs(spark: SparkSession, d: str) -> DataFrame:
    return astmetrics.file_structure(_tree(spark, d)[1]).select("file_id", "documented", "documentable", _r("documentation_coverage"))


@query(_tpl("SELECT file_id, 2 + k AS total_imports FROM tpl"))
def tpl_imports(spark: SparkSession, d: str) -> DataFrame:
    return astmetrics.file_structure(_tree(spark, d)[1]).select("file_id", "total_imports")


@query(_tpl("""SELECT file_id, 'os,sys' AS imports, array_to_string(list_transform(range(0, k), lambda i: 'pkg.a' || i), ',') AS import_froms FROM tpl"""))
def tpl_import_names(spark: SparkSession, d: str) -> DataFrame:
    return astmetrics.file_structure(_tree(spark, d)[1]).select("file_id", F.array_join("imports", ",").alias("imports"), F.array_join("import_froms", ",").alias("import_froms"))


@query(_tpl("SELECT file_id, nf * ni AS bool_ops, 2 * nf * ni AS bool_terms, 2.0::DOUBLE AS avg_terms FROM tpl"))
def tpl_bool(spark: SparkSession, d: str) -> DataFrame:
    f = astmetrics.function_metrics(_tree(spark, d)[1]).groupBy("file_id").agg(F.sum("bool_ops").alias("bool_ops"), F.sum("bool_terms").alias("bool_terms"))
    return f.withColumn("avg_terms", core.safe_ratio(F.col("bool_terms"), F.col("bool_ops")))


@query(_tpl("SELECT file_id, 1::BIGINT AS globals_declared, nf * ni AS global_usages_total FROM tpl"))
def tpl_globals(spark: SparkSession, d: str) -> DataFrame:
    return astmetrics.global_usage(_tree(spark, d)[1]).select("file_id", "globals_declared", "global_usages_total")


@query(_tpl("SELECT file_id, 'LIMIT' AS name, nf * ni AS uses FROM tpl"))
def tpl_global_names(spark: SparkSession, d: str) -> DataFrame:
    return astmetrics.global_usage(_tree(spark, d)[1]).select("file_id", F.explode("usage_per_name").alias("name", "uses"))


@query(_tpl(f"""SELECT file_id, {LOC} AS loc, 1 + nf * doc AS dloc, {LOC} - 2 - nf * doc AS sloc, 1::BIGINT AS blank_lines FROM tpl"""))
def tpl_lines(spark: SparkSession, d: str) -> DataFrame:
    files, tree = _tree(spark, d)
    ranged = files.join(large(astmetrics.file_structure(tree).select("file_id", "doc_ranges")), "file_id")
    return textmetrics.line_metrics(ranged).select("file_id", "loc", "dloc", "sloc", "blank_lines")


@query(_tpl(f"""SELECT file_id, greatest(0, least(100, 100 - CASE WHEN {LOC} > 200 THEN 20 WHEN {LOC} > 100 THEN 10 ELSE 0 END - CASE WHEN nf * ni + 1 > 20 THEN 20 WHEN nf * ni + 1 > 10 THEN 10 ELSE 0 END
    + CASE WHEN nf * doc / (nf + 3 * nc) > 0.8 THEN 10 WHEN nf * doc / (nf + 3 * nc) < 0.3 THEN -15 ELSE 0 END))::BIGINT AS maintainability_score FROM tpl"""))
def tpl_maintain(spark: SparkSession, d: str) -> DataFrame:
    files, tree = _tree(spark, d)
    loc = files.select("file_id", F.size(core.split_lines(F.col("content"))).alias("loc"))
    s = astmetrics.file_structure(tree).join(large(loc), "file_id")
    return s.select("file_id", astmetrics.maintainability(F.col("loc"), F.col("controls") + 1, F.col("documentation_coverage")).alias("maintainability_score"))


@query(_tpl("""SELECT file_id, 5 * nf * ni + 7 * nf - 2 + doc * nf + 3 + 8 * nc - 1 AS total_operands, nf * ni AS total_operators, 11 + nf + nc + doc AS distinct_operands, 1::BIGINT AS distinct_operators,
    round((nf * ni + 5 * nf * ni + 7 * nf - 2 + doc * nf + 3 + 8 * nc - 1) * log2(1 + 11 + nf + nc + doc), 4) AS halstead_volume,
    round(0.5 * ((5 * nf * ni + 7 * nf - 2 + doc * nf + 3 + 8 * nc - 1) / (11 + nf + nc + doc)), 6) AS halstead_difficulty FROM tpl"""))
def tpl_halstead(spark: SparkSession, d: str) -> DataFrame:
    return astmetrics.file_structure(_tree(spark, d)[1]).select("file_id", "total_operands", "total_operators", "distinct_operands", "distinct_operators", _r("halstead_volume", 4), _r("halstead_difficulty"))


@query(_tpl("SELECT file_id, nf * (3 + ni) + 8 * nc + 1 AS identifiers, nf * (1 + ni) + 3 * nc AS short_identifiers FROM tpl"))
def tpl_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return astmetrics.file_structure(_tree(spark, d)[1]).select("file_id", "identifiers", "short_identifiers")


@query(_tpl("""SELECT file_id, nc AS classes, 2 * nc AS methods, nc AS attributes, 6::BIGINT AS line_count, nc - 1 AS derived, 0::BIGINT AS external_calls FROM tpl"""))
def tpl_classes(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)[1]
    c = astmetrics.class_metrics(tree, keep(astmetrics.function_metrics(tree)))
    return c.groupBy("file_id").agg(F.count(F.lit(1)).alias("classes"), F.sum("methods").alias("methods"), F.sum("attributes").alias("attributes"), F.max("line_count").cast("long").alias("line_count"),
                                    F.count_if("has_inheritance").alias("derived"), F.sum("external_calls").alias("external_calls"))


@query(_tpl("""SELECT file_id, 'K' || c AS class_name, 2::BIGINT AS methods, 1::BIGINT AS public_methods, 2::BIGINT AS wmc, 0.0::DOUBLE AS lcom, 2::BIGINT AS rfc, 3::BIGINT AS tna, (c > 0)::BIGINT AS cbo, c::BIGINT AS dit
    FROM (SELECT *, unnest(range(0, nc)) AS c FROM tpl)"""))
def tpl_oo(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)[1]
    return objects.oo_metrics(tree, keep(astmetrics.function_metrics(tree))).select("file_id", "class_name", "methods", "public_methods", "wmc", "lcom", "rfc", "tna", "cbo", F.col("dit").cast("long").alias("dit"))


@query(_tpl("SELECT file_id, nc AS attribute_mutations_outside_init FROM tpl"))
def tpl_mutation(spark: SparkSession, d: str) -> DataFrame:
    return astmetrics.mutations_outside_init(_tree(spark, d)[1])


@query(_tpl("""SELECT file_id, nf + 2 * nc AS nodes, nf - 1 AS edges, round((nf - 1) / ((nf + 2 * nc) * (nf + 2 * nc - 1)), 8) AS call_graph_density, nf - 1 AS max_intra_file_call_depth,
    1::BIGINT AS inter_file_coupling, nf AS cross_calls FROM tpl"""))
def tpl_callgraph(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)[1]
    g = objects.call_graph(tree, keep(astmetrics.function_metrics(tree)))
    return g.select("file_id", "nodes", "edges", _r("call_graph_density", 8), "max_intra_file_call_depth", "inter_file_coupling", F.size("cross_file_call_edges").cast("long").alias("cross_calls"))


@query(_tpl("SELECT file_id, 'f' || i AS caller, 'os' AS modules, 'os' AS modules_called FROM (SELECT *, unnest(range(0, nf)) AS i FROM tpl)"))
def tpl_cross_map(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)[1]
    g = objects.call_graph(tree, keep(astmetrics.function_metrics(tree)))
    rows = g.select("file_id", F.explode("cross_module_calls").alias("caller", "modules"), "modules_called")
    return rows.select("file_id", "caller", F.array_join("modules", ",").alias("modules"), F.array_join("modules_called", ",").alias("modules_called"))


@query(_tpl("SELECT file_id, nc AS total_classes, 2.0::DOUBLE AS average_methods_per_class, nc - 1 AS classes_with_inheritance, 0::BIGINT AS classes_with_docstring FROM tpl"))
def tpl_class_rollup(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)[1]
    return astmetrics.class_rollup(astmetrics.class_metrics(tree, keep(astmetrics.function_metrics(tree))))


@query("""SELECT count(*)::BIGINT AS scanned_files, (count(*) FILTER (p_partkey % 10 IN (0, 3)))::BIGINT AS errors, (count(*) FILTER (p_partkey % 10 NOT IN (0, 3)))::BIGINT AS results FROM part""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    files = _t(spark, d, "part").select(k.cast("long").alias("file_id"), F.when(k % 10 == 0, "undecodable").otherwise("ok").alias("status"), F.when(k % 10 == 3, "def x(:").otherwise("x = 1").alias("content"))
    return datasets.run_summary(files, nodes.parse(nodes.spread(files.where("status = 'ok'"))))


# --- graphs and joins ----------------------------------------------------------------------------------------------

EDGES = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), e


@query(f"""WITH {EDGES}, i AS (SELECT dst, count(*) AS n FROM e GROUP BY dst), o AS (SELECT src, count(*) AS n FROM e GROUP BY src)
    SELECT node, coalesce(i.n, 0)::BIGINT AS fan_in, coalesce(o.n, 0)::BIGINT AS fan_out FROM v LEFT JOIN i ON node = dst LEFT JOIN o ON node = src""")
def callgraph_fan(spark: SparkSession, d: str) -> DataFrame:
    names, e = _edges(spark, d)
    return objects.fan_counts(names, e, [])


@query(f"""WITH {EDGES} SELECT (SELECT count(*) FROM v)::BIGINT AS nodes, count(*)::BIGINT AS edges, round(count(*) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)), 10) AS density FROM e""")
def callgraph_density(spark: SparkSession, d: str) -> DataFrame:
    names, e = _edges(spark, d)
    one = F.lit(1).alias("g")
    return objects.graph_metrics(names.select(one, "node"), e.select(one, "src", "dst"), ["g"]).select("nodes", "edges", _r("density", 10))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1), p AS (
    SELECT p_partkey AS node, p_partkey AS at, 0 AS depth FROM part UNION ALL SELECT p.node, e.dst, p.depth + 1 FROM p JOIN e ON e.src = p.at)
    SELECT node, max(depth)::BIGINT AS depth FROM p GROUP BY node""")
def callgraph_depth(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select(F.lit(1).alias("g"), F.col("p_partkey").cast("long").alias("node"))
    e = p.where("node > 1").select("g", F.col("node").alias("src"), F.expr("node DIV 2").alias("dst"))
    return graphs.longest_paths(e, p, ["g"]).select("node", F.col("depth").cast("long").alias("depth"))


@query("""WITH RECURSIVE c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN -1 WHEN s_suppkey > 3 THEN s_suppkey // 3 END AS base FROM supplier),
    p AS (SELECT s_suppkey AS node, base AS at, CASE WHEN base IS NULL THEN 0 ELSE 1 END AS depth FROM c UNION ALL SELECT p.node, c.base, p.depth + 1 FROM p JOIN c ON c.s_suppkey = p.at WHERE c.base IS NOT NULL)
    SELECT 'C' || node AS class_name, max(depth)::BIGINT AS dit FROM p GROUP BY node""")
def inheritance_depth(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("C"), c.cast("string"))
    base = F.when(k % 7 == 0, F.array(F.lit("elsewhere"))).when(k > 3, F.array(name(F.expr("s_suppkey DIV 3")))).otherwise(F.array().cast("array<string>"))
    classes = _t(spark, d, "supplier").select(F.lit(1).alias("file_id"), name(k).alias("class_name"), base.alias("bases"))
    return graphs.inheritance_depth(classes).select("class_name", F.col("dit").cast("long").alias("dit"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, [l_suppkey % 5, l_partkey % 5] AS f FROM lineitem)
    SELECT a.l_orderkey, count(*)::BIGINT AS pairs, round(avg(CASE WHEN list_has_any(a.f, b.f) THEN 0 ELSE 1 END), 6) AS lcom
    FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey""")
def lcom_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_suppkey") % 5, F.col("l_partkey") % 5).alias("f"))
    return objects.cohesion_pairs(m, ["l_orderkey"], "l_linenumber", "f").select("l_orderkey", "pairs", _r("lcom"))


_CALLS = """f AS (SELECT o_orderkey // 50 AS file_id, 'f' || o_orderkey AS qual, ['f' || (o_orderkey + 1), 'mod' || (o_custkey % 3) || '.run', 'self.x'] AS calls FROM orders),
    c AS (SELECT file_id, qual, unnest(calls) AS call FROM f),
    k AS (SELECT c.*, t.qual IS NOT NULL AS known FROM c LEFT JOIN f t ON t.file_id = c.file_id AND t.qual = c.call)"""


def _calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    made = F.array(name(k + 1), F.concat(F.lit("mod"), (F.col("o_custkey") % 3).cast("string"), F.lit(".run")), F.lit("self.x"))
    rows = _t(spark, d, "orders").select(F.expr("o_orderkey DIV 50").alias("file_id"), name(k).alias("qual"), F.lit(None).cast("string").alias("class_name"), made.alias("calls_made"))
    return objects.resolve_calls(rows)


@query(f"""WITH {_CALLS} SELECT DISTINCT file_id, qual AS caller, string_split(call, '.')[1] AS module FROM k WHERE NOT known AND contains(call, '.') AND NOT starts_with(call, 'self.')""")
def cross_calls(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d)[1]


@query(f"WITH {_CALLS} SELECT DISTINCT file_id, qual AS src, call AS dst FROM k WHERE known")
def inner_calls(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d)[0]


_URLS = "SELECT o_orderkey AS id, 'https://host/x/r' || o_orderkey || '.git' AS clone_url, (o_totalprice * 100)::BIGINT AS stargazers_count FROM orders"


def _repos(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://host/x/r"), F.col("o_orderkey").cast("string"), F.lit(".git"))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), url.alias("clone_url"), F.round(F.col("o_totalprice") * 100).cast("long").alias("stargazers_count"))


@query(f"SELECT id, 'r' || id AS repo FROM ({_URLS}) WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def anti_existing(spark: SparkSession, d: str) -> DataFrame:
    there = _t(spark, d, "lineitem").where("l_quantity > 25").select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("repo"))
    return repos.to_fetch(_repos(spark, d), there).select("id", "repo")


@query("""WITH f AS (SELECT c_custkey, [c_nationkey % 5 + 10, c_custkey % 5 + 10, 7] AS a, [c_nationkey % 3 + 10, 7] AS b FROM customer)
    SELECT c_custkey, round(1 - len(list_intersect(list_distinct(a), b)) / len(list_distinct(a)), 6) AS mismatch FROM f""")
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    f = _t(spark, d, "customer").select("c_custkey", F.array_distinct(F.array(n % 5 + 10, k % 5 + 10, F.lit(7))).alias("a"), F.array(n % 3 + 10, F.lit(7)).alias("b"))
    return f.select("c_custkey", F.round(core.overlap_mismatch(F.col("a"), F.col("b")), 6).alias("mismatch"))


# --- history -------------------------------------------------------------------------------------------------------


def _seconds() -> F.Column:
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")


@query("""SELECT user_id, count(*)::BIGINT AS n_commits, round(sum(value), 4) AS lines_added, count(DISTINCT event_type)::BIGINT AS num_authors FROM events GROUP BY user_id""")
def vcs_totals(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("zero", F.lit(0))
    return history.totals(e, ["user_id"], _seconds(), "event_type", "value", "zero").select("user_id", "n_commits", F.round("lines_added", 4).alias("lines_added"), "num_authors")


@query("""SELECT user_id, floor((max(floor(epoch_us(ts) / 1000000)) - min(floor(epoch_us(ts) / 1000000))) / 86400)::BIGINT AS file_age_days FROM events GROUP BY user_id""")
def vcs_age(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("zero", F.lit(0))
    return history.totals(e, ["user_id"], _seconds(), "event_type", "zero", "zero").select("user_id", "file_age_days")


@query("""WITH e AS (SELECT user_id, floor(epoch_us(ts) / 1000000)::BIGINT AS s FROM events),
    n AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 691199 FOLLOWING) AS n FROM e) SELECT user_id, max(n)::BIGINT AS commit_bursts FROM n GROUP BY user_id""")
def vcs_burst(spark: SparkSession, d: str) -> DataFrame:
    return history.burst(_t(spark, d, "events").select("user_id", "ts"), ["user_id"], _seconds())


@query("""WITH c AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (SELECT a.l_suppkey, b.l_suppkey AS other, count(*) AS together FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL)
    SELECT l_suppkey, other, together::BIGINT AS together, row_number() OVER (PARTITION BY l_suppkey ORDER BY together DESC, other)::INT AS place FROM p QUALIFY place <= 10""")
def cochange_top10(spark: SparkSession, d: str) -> DataFrame:
    return history.top_coupled(history.cochanges(_t(spark, d, "lineitem"), "l_orderkey", "l_suppkey"), "l_suppkey")


@query("""WITH f AS (SELECT page_id, regexp_replace(url, '^https?://', '') || CASE WHEN page_id % 5 = 0 THEN '/test_' || page_id % 7 || '.py' ELSE '/' || page_id % 3 || '.py' END AS path FROM pages),
    x AS (SELECT page_id, string_split(path, '/') AS p, array_to_string(p[1:len(p) - 1], '/') AS own, regexp_replace(p[-1], '[.]py$', '') AS stem FROM f),
    t AS (SELECT page_id, stem, unnest(list_transform(range(0, len(p)), lambda i: array_to_string(p[1:i], '/'))) AS dir FROM x WHERE page_id % 5 = 0)
    SELECT x.page_id, count(t.page_id)::BIGINT AS test_files_found, (2 * count(t.page_id))::BIGINT AS test_lines, count(t.page_id)::BIGINT AS test_function_count,
        coalesce(bool_or(contains(t.stem, x.stem)), false) AS unit_test_presence FROM x LEFT JOIN t ON t.dir = x.own GROUP BY x.page_id""")
def tests_prefix_join(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    name = F.when(k % 5 == 0, F.concat(F.lit("/test_"), (k % 7).cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("/"), (k % 3).cast("string"), F.lit(".py")))
    files = _t(spark, d, "pages").select(k.alias("file_id"), F.lit("r").alias("repo"), F.concat(F.regexp_replace("url", "^https?://", ""), name).alias("path"), F.lit("def test_a():\n    pass\n").alias("content"))
    return history.test_links(files).withColumnRenamed("file_id", "page_id")


# --- acquisition ---------------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '.git', '') AS repo, regexp_replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '\.git$', '') AS strict_repo FROM pages""")
def url_repo_name(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", core.repo_name(F.col("url")).alias("repo"), core.repo_name(F.col("url"), strict=True).alias("strict_repo"))


_PATH = "'src/' || p_brand || '/' || p_partkey || (['.py', '.JAVA', '.cpp', '.h', '.txt', '', '.hpp', '.cc'])[(p_partkey % 8 + 1)::INT]"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".JAVA", ".cpp", ".h", ".txt", "", ".hpp", ".cc")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 11 == 0, F.lit("/.gitignore")).otherwise(F.lit(""))
    return _t(spark, d, "part").select("p_partkey", F.concat(F.lit("src/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), ext, name).alias("path"))


@query(f"""WITH f AS (SELECT p_partkey, {_PATH} || CASE WHEN p_partkey % 11 = 0 THEN '/.gitignore' ELSE '' END AS path FROM part),
    x AS (SELECT *, lower(regexp_extract(path, '[^/.](\\.[^./]*)$', 1)) AS ext FROM f)
    SELECT p_partkey, CASE ext WHEN '.py' THEN 'Python' WHEN '.java' THEN 'Java' WHEN '.cpp' THEN 'C++' WHEN '.cc' THEN 'C++' WHEN '.cxx' THEN 'C++' WHEN '.h' THEN 'C++' WHEN '.hpp' THEN 'C++' END AS language FROM x""")
def ext_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("p_partkey", core.language(F.col("path")).alias("language"))


@query(f"""WITH f AS (SELECT p_partkey, {_PATH} || CASE WHEN p_partkey % 11 = 0 THEN '/.gitignore' ELSE '' END AS path FROM part),
    x AS (SELECT *, CASE WHEN starts_with(string_split(path, '/')[-1], '.git') THEN 'git' WHEN lower(regexp_extract(path, '[^/.](\\.[^./]*)$', 1)) IN ('.py', '.java', '.cpp', '.cc', '.cxx', '.h', '.hpp') THEN 'kept' ELSE 'other' END AS class FROM f),
    n AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY path) AS r FROM x) SELECT class, count(*)::BIGINT AS n, string_agg(path, '|' ORDER BY path) FILTER (r <= 20) AS examples FROM n GROUP BY class""")
def three_way(spark: SparkSession, d: str) -> DataFrame:
    return repos.file_classes(_paths(spark, d)).withColumn("examples", F.array_join("examples", "|"))


@query(f"""WITH f AS (SELECT p_partkey, {_PATH} || CASE WHEN p_partkey % 11 = 0 THEN '/.github/a.py' ELSE '' END AS path FROM part)
    SELECT p_partkey, regexp_matches(lower(path), '[^/.][.](py|java|cpp|cc|cxx|h|hpp)$') AND NOT contains(regexp_replace(path, '/?[^/]*$', ''), '.git') AS extracted FROM f""")
def extract_filter(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("p_partkey") % 11 == 0, F.regexp_replace("path", "/.gitignore$", "/.github/a.py")).otherwise(F.col("path"))
    return _paths(spark, d).select("p_partkey", core.is_extractable(path).alias("extracted"))


@query("""SELECT event_id, json_keys(props)[1] AS first_key, len(json_keys(props))::INT AS n_keys FROM events WHERE props IS NOT NULL""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return _t(spark, d, "events").where("props IS NOT NULL").select("event_id", F.element_at(keys, 1).alias("first_key"), F.size(keys).alias("n_keys"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (3, 5) THEN NULL ELSE o_custkey END::BIGINT AS a, CASE WHEN o_orderkey % 6 IN (2, 3, 5) THEN NULL ELSE o_orderkey % 6 IN (0, 4) END AS b,
    CASE o_orderkey % 6 WHEN 1 THEN 'True story, isn''t it' WHEN 4 THEN 'None of it' END AS c FROM orders""")
def safe_parse(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey").cast("string")
    forms = ['{"a": #, "b": true}', """{'a': #, 'b': False, 'c': "True story, isn't it"}""", "{'a': #, 'b': None}", "", "{'a': #, 'b': True, 'c': 'None of it'}", "no literal {"]
    form = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("o_orderkey") % len(forms) + 1).cast("int"))
    parsed = _t(spark, d, "orders").select("o_orderkey", core.safe_parse_json(F.replace(form, F.lit("#"), c), "a bigint, b boolean, c string").alias("p"))
    return parsed.select("o_orderkey", "p.a", "p.b", "p.c")


# --- rules and features ---------------------------------------------------------------------------------------------

_FIGURES = """f AS (SELECT c_custkey, (c_custkey % 3)::INT AS functions, (c_custkey % 2)::INT AS classes, (c_custkey % 120)::INT AS max_lines_per_function, (c_custkey % 7) / 10.0::DOUBLE AS max_cyclomatic_ratio,
    (c_custkey % 6)::INT AS max_nesting_level, c_custkey % 13 = 0 AS large_parameter_list_indicator, (c_custkey % 30) / 10.0::DOUBLE AS mean_param_entropy, (c_custkey % 5)::DOUBLE AS average_methods_per_class,
    (c_custkey % 80)::DOUBLE AS mean_lines_per_class, (c_custkey % 25)::INT AS inter_file_coupling, (c_custkey % 17)::INT AS n_cross_calls, (c_custkey % 19)::DOUBLE AS average_cyclomatic_complexity,
    (c_custkey % 23) / 10.0::DOUBLE AS nesting_variance, (c_custkey % 90)::INT AS lines_of_code, (c_custkey % 100)::DOUBLE AS documentation_coverage, (c_custkey % 11)::DOUBLE AS comment_percentage,
    (c_custkey % 10) / 10.0::DOUBLE AS comment_code_mismatch_score, (c_custkey % 6)::INT AS globals_declared, (c_custkey % 14)::INT AS global_usages_total, (c_custkey % 8) / 2.0::DOUBLE AS external_vs_internal_field_access_ratio,
    CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 8 END::INT AS commit_bursts, (c_custkey % 9)::INT AS pep8_violations, (c_custkey % 15) / 10.0::DOUBLE AS irregularity_score,
    c_custkey % 4 = 0 AS unit_test_presence, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 900 END::INT AS lines_added FROM customer)"""


def _figures(spark: SparkSession, d: str) -> DataFrame:
    m = lambda n: F.col("c_custkey") % n
    k = _t(spark, d, "customer")
    return k.select(
        "c_custkey", m(3).cast("int").alias("functions"), m(2).cast("int").alias("classes"), m(120).cast("int").alias("max_lines_per_function"), (m(7) / 10.0).alias("max_cyclomatic_ratio"),
        m(6).cast("int").alias("max_nesting_level"), (m(13) == 0).alias("large_parameter_list_indicator"), (m(30) / 10.0).alias("mean_param_entropy"), m(5).cast("double").alias("average_methods_per_class"),
        m(80).cast("double").alias("mean_lines_per_class"), m(25).cast("int").alias("inter_file_coupling"), m(17).cast("int").alias("n_cross_calls"), m(19).cast("double").alias("average_cyclomatic_complexity"),
        (m(23) / 10.0).alias("nesting_variance"), m(90).cast("int").alias("lines_of_code"), m(100).cast("double").alias("documentation_coverage"), m(11).cast("double").alias("comment_percentage"),
        (m(10) / 10.0).alias("comment_code_mismatch_score"), m(6).cast("int").alias("globals_declared"), m(14).cast("int").alias("global_usages_total"), (m(8) / 2.0).alias("external_vs_internal_field_access_ratio"),
        F.when(m(9) != 0, m(8)).cast("int").alias("commit_bursts"), m(9).cast("int").alias("pep8_violations"), (m(15) / 10.0).alias("irregularity_score"), (m(4) == 0).alias("unit_test_presence"),
        F.when(m(9) != 0, m(900)).cast("int").alias("lines_added"),
    )


#: The thirteen rules once more, in SQL of their own. A record without commit bursts has no label.
_RULES_SQL = """SELECT c_custkey, commit_bursts IS NULL AS void,
        functions > 0 AND (max_lines_per_function > 50 OR max_cyclomatic_ratio > 0.5 OR max_nesting_level > 4) AS LongMethod,
        functions > 0 AND (large_parameter_list_indicator OR mean_param_entropy > 2.0) AS LargeParameterList,
        classes > 0 AND average_methods_per_class < 2 AND mean_lines_per_class < 50 AS LazyClass,
        classes > 0 AND (inter_file_coupling > 20 OR n_cross_calls > 15 OR average_cyclomatic_complexity > 15) AS GodClass,
        functions > 0 AND (average_cyclomatic_complexity > 10 OR nesting_variance > 1.5) AS SpaghettiCode,
        lines_of_code > 20 AND (documentation_coverage < 20 OR comment_percentage < 5) AS PoorDocumentation,
        comment_code_mismatch_score > 0.7 AS MisleadingComments,
        globals_declared > 3 OR global_usages_total > 10 AS GlobalStateAbuse,
        functions > 0 AND (external_vs_internal_field_access_ratio > 3 OR n_cross_calls > 10) AS FeatureEnvy,
        commit_bursts > 3 AND inter_file_coupling > 10 AS ShotgunSurgery,
        pep8_violations > 5 OR irregularity_score > 1.0 AS FormattingIssues,
        lines_of_code > 50 AND NOT unit_test_presence AS UntestedCode,
        commit_bursts > 5 OR lines_added > 500 AS UnstableModule
    FROM f"""
_Y = "CASE WHEN NOT void AND {0} THEN 1 ELSE 0 END::INT"
_NAMES = ["LongMethod", "LargeParameterList", "LazyClass", "GodClass", "SpaghettiCode", "PoorDocumentation", "MisleadingComments", "GlobalStateAbuse", "FeatureEnvy", "ShotgunSurgery", "FormattingIssues", "UntestedCode", "UnstableModule"]
_VECTOR = ["LongMethod", "LargeParameterList", "GodClass", "LazyClass", "SpaghettiCode", "PoorDocumentation", "MisleadingComments", "GlobalStateAbuse", "FeatureEnvy", "ShotgunSurgery", "UntestedCode", "FormattingIssues", "UnstableModule"]


@query(f"WITH {_FIGURES}, r AS ({_RULES_SQL}) SELECT c_custkey, {', '.join(_Y.format(n) + f' AS y_{n}' for n in _NAMES)} FROM r")
def rules_13(spark: SparkSession, d: str) -> DataFrame:
    return labels.label(_figures(spark, d)).select("c_custkey", *[f"y_{n}" for n, _, _ in labels.RULES])


@query(f"""WITH {_FIGURES}, r AS ({_RULES_SQL}), y AS (SELECT c_custkey, [{', '.join(_Y.format(n) for n in _VECTOR)}] AS v FROM r)
    SELECT c_custkey, array_to_string(v, '') AS vector, list_max(v)::INT AS y_any_smell FROM y""")
def label_vector(spark: SparkSession, d: str) -> DataFrame:
    y = labels.label(_figures(spark, d))
    y = features.any_label(y.withColumn("v", labels.vector_of(F.col("smells"))), [f"y_{n}" for n in labels.VECTOR])
    return y.select("c_custkey", F.array_join(F.transform("v", lambda x: x.cast("string")), "").alias("vector"), "y_any_smell")


@query("""SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 8) AS c_acctbal, round((c_nationkey - min(c_nationkey) OVER ()) / (max(c_nationkey) OVER () - min(c_nationkey) OVER ()), 8) AS c_nationkey,
    0.0::DOUBLE AS same FROM customer""")
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", F.lit(5).alias("same"))
    return features.minmax_scale(rows, ["c_acctbal", "c_nationkey", "same"]).select("c_custkey", _r("c_acctbal", 8), _r("c_nationkey", 8), "same")


_CORR_FEATURES, _CORR_TARGETS = ["l_quantity", "l_extendedprice", "l_discount", "same"], ["y_late", "y_flag"]


def _corr(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", F.lit(1).alias("same"), (F.col("l_returnflag") == "R").cast("int").alias("y_flag"), (F.col("l_tax") > 0.04).cast("int").alias("y_late"))
    return features.correlations(rows, _CORR_FEATURES, _CORR_TARGETS)


_CORR_SQL = """x AS (SELECT l_quantity, l_extendedprice, l_discount, 1 AS same, (l_returnflag = 'R')::INT AS y_flag, (l_tax > 0.04)::INT AS y_late FROM lineitem), c AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature, '{b}' AS target, covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS corr FROM x" for a in _CORR_FEATURES for b in _CORR_TARGETS
) + ")"


@query(f"WITH {_CORR_SQL} SELECT feature, target, round(corr, 6) AS corr FROM c")
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _corr(spark, d).select("feature", "target", _r("corr"))


@query(f"WITH {_CORR_SQL} SELECT feature, round(max(abs(coalesce(corr, 0))), 6) AS strongest FROM c GROUP BY feature HAVING max(abs(coalesce(corr, 0))) < 0.2")
def weak_features(spark: SparkSession, d: str) -> DataFrame:
    return features.weak_features(_corr(spark, d)).select("feature", _r("strongest"))


# --- predictions ----------------------------------------------------------------------------------------------------

_PREDICTED = """p AS (SELECT doc_id, quality AS y_quality, toxic AS y_toxic, (n_chars > 300)::INT AS p_quality, (doc_id % 5 = 0)::INT AS p_toxic FROM labels JOIN documents USING (doc_id)),
    r AS (SELECT doc_id, 'quality' AS label, y_quality AS y, p_quality AS p FROM p UNION ALL SELECT doc_id, 'toxic', y_toxic, p_toxic FROM p),
    c AS (SELECT label, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp FROM r GROUP BY label)"""


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select("doc_id", F.col("quality").alias("y_quality"), F.col("toxic").alias("y_toxic"), (F.col("n_chars") > 300).cast("int").alias("p_quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("p_toxic"))
    return evaluation.long_form(rows, "doc_id", ["quality", "toxic"])


@query(f"WITH {_PREDICTED} SELECT label, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp FROM c")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(_predicted(spark, d))


@query(f"WITH {_PREDICTED} SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 8) AS micro_f1 FROM c")
def micro_f1(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.micro_f1(_predicted(spark, d)).select(_r("micro_f1", 8))


@query(f"WITH {_PREDICTED} SELECT round(avg((y_quality = p_quality AND y_toxic = p_toxic)::INT), 8) AS subset_accuracy FROM p")
def subset_acc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.subset_accuracy(_predicted(spark, d), "doc_id").select(_r("subset_accuracy", 8))


@query(f"""WITH {_PREDICTED}, s AS (SELECT doc_id % 3 = 0 AS test, (y_quality = p_quality AND y_toxic = p_toxic)::INT AS good FROM p)
    SELECT round(avg(good) FILTER (NOT test), 8) AS train_accuracy, round(avg(good) FILTER (test), 8) AS test_accuracy, round(avg(good) FILTER (NOT test) - avg(good) FILTER (test), 8) AS gap FROM s""")
def accuracy_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d)
    got = evaluation.generalisation_gap(rows.where("doc_id % 3 <> 0"), rows.where("doc_id % 3 = 0"), "doc_id")
    return got.select(_r("train_accuracy", 8), _r("test_accuracy", 8), _r("gap", 8))


@query(f"""WITH {_PREDICTED}, e AS (SELECT label, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM c),
    a AS (SELECT * FROM e UNION ALL SELECT 'micro avg', sum(tp) / (sum(tp) + sum(fp)), sum(tp) / (sum(tp) + sum(fn)), 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), sum(tp) + sum(fn) FROM c
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM e
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM e)
    SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support::BIGINT AS support FROM a""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.report(_predicted(spark, d)).select("label", _r("precision", 8), _r("recall", 8), _r("f1", 8), "support")


_VOTES = "v AS (SELECT doc_id, m, ((doc_id + m * 3) % (m + 2) = 0)::INT AS prediction FROM documents, (VALUES (0), (1), (2), (3)) t(m))"


def _votes(spark: SparkSession, d: str) -> DataFrame:
    m = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    v = _t(spark, d, "documents").select("doc_id", m.alias("m"))
    return v.withColumn("prediction", ((F.col("doc_id") + F.col("m") * 3) % (F.col("m") + 2) == 0).cast("int"))


@query(f"WITH {_VOTES} SELECT doc_id, (2 * sum(prediction) >= count(*))::INT AS prediction FROM v GROUP BY doc_id")
def vote(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.vote(_votes(spark, d), ["doc_id"])


@query(f"""WITH {_VOTES}, h AS (SELECT 'model' || m AS label, doc_id, row_number() OVER (PARTITION BY m ORDER BY doc_id) AS r FROM v WHERE prediction = 1)
    SELECT label, count(*)::BIGINT AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (r <= 200) AS files FROM h GROUP BY label""")
def smell_files(spark: SparkSession, d: str) -> DataFrame:
    rows = _votes(spark, d).withColumn("label", F.concat(F.lit("model"), F.col("m").cast("string")))
    return evaluation.files_by_label(rows, "doc_id").select("label", "n", F.array_join(F.transform("files", lambda x: x.cast("string")), ",").alias("files"))


@query(f"SELECT id, 'r' || id AS repo, row_number() OVER (ORDER BY stargazers_count DESC, 'r' || id)::INT AS place FROM ({_URLS}) QUALIFY place <= 11")
def first_eleven(spark: SparkSession, d: str) -> DataFrame:
    top = repos.to_fetch(_repos(spark, d), spark.createDataFrame([], "repo string"), 11)
    return top.select("id", "repo", F.row_number().over(W.orderBy(F.desc("stargazers_count"), "repo")).alias("place"))


@query("""SELECT 'o_orderkey' AS "column", 'bigint' AS type, count(*)::BIGINT AS n_rows, count(*) FILTER (o_orderkey IS NULL)::BIGINT AS n_null FROM orders
    UNION ALL SELECT 'o_orderstatus', 'string', count(*)::BIGINT, count(*) FILTER (o_orderstatus IS NULL)::BIGINT FROM orders""")
def shape_report(spark: SparkSession, d: str) -> DataFrame:
    return features.report(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"))


# --- models: rows only ------------------------------------------------------------------------------------------------


def _examples(spark: SparkSession, d: str) -> tuple[DataFrame, list[str], list[str]]:
    m = textmetrics.line_metrics(_t(spark, d, "documents"), "doc_id", "text")
    rows = m.join(_t(spark, d, "labels").select("doc_id", F.col("quality").alias("y_quality"), F.col("toxic").alias("y_toxic")), "doc_id")
    return rows, ["loc", "avg_line_length", "max_line_length", "percent_lines_over_80"], ["quality", "toxic"]


def _scored(spark: SparkSession, d: str, algorithm: str, params: dict) -> DataFrame:
    rows, names, targets = _examples(spark, d)
    train, test = models.hash_split(rows, "doc_id")
    return models.train(train, names, targets, algorithm, params).predict(test).select("doc_id", *[f"p_{n}" for n in targets], *[f"prob_{n}" for n in targets])


@query()
def rf_multilabel(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, "random_forest", {"numTrees": 10, "maxDepth": 5})


@query()
def extra_trees_like(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, "extra_trees", {"numTrees": 10, "maxDepth": 5})


@query()
def gbt_multilabel(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, "hist_boosting", {"maxIter": 5, "maxDepth": 3})


@query()
def boosting_multilabel(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, "boosting", {"maxIter": 5, "maxDepth": 4, "subsamplingRate": 0.8, "featureSubsetStrategy": "sqrt"})


@query()
def soft_vote(spark: SparkSession, d: str) -> DataFrame:
    rows, names, targets = _examples(spark, d)
    train, test = models.hash_split(rows, "doc_id")
    pair = [models.train(train, names, targets, a, p) for a, p in (("random_forest", {"numTrees": 5, "maxDepth": 4}), ("hist_boosting", {"maxIter": 3, "maxDepth": 3}))]
    return models.soft_vote(test, pair, targets).select("doc_id", *[f"p_{n}" for n in targets])


def _found(spark: SparkSession, results: list[tuple[dict, float, float]]) -> DataFrame:
    return spark.createDataFrame([(i + 1, str(sorted(p.items())), m, s) for i, (p, m, s) in enumerate(results)], "place int, params string, mean_micro_f1 double, std_micro_f1 double")


@query()
def random_search(spark: SparkSession, d: str) -> DataFrame:
    rows, names, targets = _examples(spark, d)
    space = {"numTrees": [3, 5], "maxDepth": [2, 4]}
    return _found(spark, models.random_search(rows, "doc_id", names, targets, "random_forest", 2, space, folds=2))


@query()
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    rows, names, targets = _examples(spark, d)
    return _found(spark, models.search(rows, "doc_id", names, targets, "random_forest", models.grid({"numTrees": [3], "maxDepth": [2, 3]}), folds=2))


@query()
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    rows, names, targets = _examples(spark, d)
    got = models.train(rows, names, targets, "random_forest", {"numTrees": 5, "maxDepth": 4}).importances(15)
    return spark.createDataFrame(got, "label string, feature string, importance double")


@query()
def files_scan(spark: SparkSession, d: str) -> DataFrame:
    """The folder source on a few files that Spark's own sources would skip."""
    from quarrymill.sources.files import read_files

    top = Path(tempfile.mkdtemp(prefix="quarrymill-scan-"))
    for name, body in (("r/__init__.py", b""), ("r/_x.py", b"a = 1\n"), ("r/.hidden/y.PY", b"b = 2\r\nc = 3\r\n"), ("r/bad.py", b"\xff\xfe"), ("r/skip.txt", b"no")):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(body)
    return read_files(spark, str(top)).select("path", "size", "status")
