"""The queries of the driver contract for source-line analytics, and their SQL."""

from __future__ import annotations

import os
import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import LANGUAGES
from ..functions.text import is_binary, lines_column
from ..operators import analysis, diff, filters
from ..sinks import reports
from ..sources.datasource import register
from ..sources.gitattributes import AttributeRules
from ..sources.gitignore import IgnoreRules
from ..sources.walker import read_list
from .corpus import SQL_CODE, SQL_DOCS, SQL_LANGUAGES, SQL_PAGES, code_files, document_files, page_files, sql_health, sql_percent, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_LANGUAGE_COLUMNS = ("language", "files", "code", "comment", "blank", "total")


# --- line counts and languages ---------------------------------------------------------------
@query(f"WITH {SQL_PAGES} SELECT 'HTML' AS language, count(*)::BIGINT AS files, sum(code)::BIGINT AS code, sum(comment)::BIGINT AS comment, sum(blank)::BIGINT AS blank, sum(code + comment + blank)::BIGINT AS total FROM page_counts")
def lang_summary_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.by_language(analysis.analyze_text(page_files(spark, sf_dir), simple_only=True)).select(*_LANGUAGE_COLUMNS)


@query(f"WITH {SQL_DOCS} SELECT 'Text' AS language, count(*)::BIGINT AS files, sum(code)::BIGINT AS code, 0::BIGINT AS comment, sum(blank)::BIGINT AS blank, sum(code + blank)::BIGINT AS total FROM doc_counts")
def lang_summary_text(spark, sf_dir):
    return analysis.by_language(analysis.analyze_text(document_files(spark, sf_dir), simple_only=True)).select(*_LANGUAGE_COLUMNS)


@query(f"WITH {SQL_PAGES} SELECT page_id, code::BIGINT AS code, comment::BIGINT AS comment, blank::BIGINT AS blank FROM page_counts")
def file_counts_expressions(spark, sf_dir):
    """Pages by pure expressions."""
    return analysis.analyze_text(page_files(spark, sf_dir), simple_only=True).select(F.col("scan_ordinal").alias("page_id"), "code", "comment", "blank")


@query(ORACLES["file_counts_expressions"])
def file_counts_scanner(spark, sf_dir):
    """The same pages by the scanner: both ways must agree."""
    count = analysis.classifier_udf()
    return page_files(spark, sf_dir).withColumn("c", count("text", "language")).select(F.col("scan_ordinal").alias("page_id"), "c.code", "c.comment", "c.blank")


@query(f"WITH {SQL_CODE} SELECT rel_path, language, code, comment, blank, complexity FROM code_counts")
def code_file_counts(spark, sf_dir):
    return analysis.analyze_text(code_files(spark, sf_dir)).select("rel_path", "language", "code", "comment", "blank", "complexity")


@query(f"WITH {SQL_CODE} SELECT rel_path, language, code, comment, blank, complexity, NULL::VARCHAR AS error FROM code_counts")
def code_file_counts_bytes(spark, sf_dir):
    files = code_files(spark, sf_dir).withColumn("content", F.encode("text", "UTF-16")).drop("text")
    return analysis.analyze_content(files).select("rel_path", "language", "code", "comment", "blank", "complexity", "error")


@query(f"WITH {SQL_LANGUAGES} SELECT language, files, code, comment, blank, total FROM languages")
def lang_summary_code(spark, sf_dir):
    return analysis.by_language(analysis.analyze_text(code_files(spark, sf_dir))).select(*_LANGUAGE_COLUMNS)


def _languages(spark, sf_dir):
    return analysis.by_language(analysis.analyze_text(code_files(spark, sf_dir)))


@query(f"WITH {SQL_LANGUAGES} SELECT language, complexity, complexity::DOUBLE / files AS complexity_avg FROM languages")
def complexity_avg(spark, sf_dir):
    return _languages(spark, sf_dir).select("language", "complexity", "complexity_avg")


@query(f"WITH {SQL_CODE} SELECT rel_path, complexity FROM code_counts WHERE able")
def complexity_by_file(spark, sf_dir):
    files = analysis.analyze_text(code_files(spark, sf_dir))
    return files.where(analysis.supports_complexity(F.col("language"))).select("rel_path", "complexity")


_TOTALS = f"SELECT count(*)::BIGINT AS files, sum(code)::BIGINT AS code, sum(comment)::BIGINT AS comment, sum(blank)::BIGINT AS blank, sum(total)::BIGINT AS total, sum(complexity)::BIGINT AS complexity, count(DISTINCT upper(language))::BIGINT AS languages, {sql_percent('sum(code)', 'sum(total)')} AS code_pct, {sql_percent('sum(comment)', 'sum(total)')} AS comment_pct, {sql_percent('sum(blank)', 'sum(total)')} AS blank_pct FROM code_counts"


@query(f"WITH {SQL_CODE} {_TOTALS}")
def grand_totals(spark, sf_dir):
    return analysis.grand_totals(analysis.analyze_text(code_files(spark, sf_dir)))


@query(f"WITH {SQL_CODE} {_TOTALS}")
def totals_of_languages(spark, sf_dir):
    return analysis.totals_of_languages(_languages(spark, sf_dir))


@query(f"WITH {SQL_LANGUAGES} SELECT language, {sql_health('code', 'comment', 'healthy')} AS health FROM languages")
def comment_health(spark, sf_dir):
    return _languages(spark, sf_dir).select("language", "health")


@query(f"WITH {SQL_CODE} SELECT rel_path, total, {sql_percent('code', 'total')} AS code_pct, {sql_percent('comment', 'total')} AS comment_pct, {sql_percent('blank', 'total')} AS blank_pct, {sql_health('code', 'comment', 'healthy')} AS health FROM code_counts")
def file_percentages_health(spark, sf_dir):
    df = analysis.with_percentages(analysis.analyze_text(code_files(spark, sf_dir)))
    level = analysis.health(F.col("code"), F.col("comment"), analysis.supports_health(F.col("language")))
    return df.select("rel_path", "total", "code_pct", "comment_pct", "blank_pct", level.alias("health"))


@query(f"WITH {SQL_LANGUAGES}, u AS (SELECT CASE WHEN files % 2 = 0 THEN upper(language) ELSE language END AS language, files, code, total FROM languages) SELECT upper(language) AS language, files, code, total FROM u")
def case_insensitive_groups(spark, sf_dir):
    files = analysis.analyze_text(code_files(spark, sf_dir)).withColumn("language", F.when(F.col("scan_ordinal") % 2 == 0, F.upper("language")).otherwise(F.col("language")))
    return analysis.by_language(files).select(F.upper("language").alias("language"), "files", "code", "total")


# --- order, top, copies, folders -------------------------------------------------------------
def _sorted(key: str, sql_key: str, descending: bool = True):
    sql = f"WITH {SQL_LANGUAGES} SELECT language, row_number() OVER (ORDER BY {sql_key} {'DESC' if descending else 'ASC'}, upper(language))::INTEGER AS place FROM languages"

    def run(spark, sf_dir):
        rows = analysis.sort_languages(_languages(spark, sf_dir), key)
        by = {"commentpct": F.col("comment_pct"), "name": F.upper("language")}.get(key, F.col(key) if key != "name" else F.upper("language"))
        return rows.select("language", F.row_number().over(_order(by.desc() if descending else by.asc(), F.upper("language"))).alias("place"))

    run.__name__ = f"sort_{key}"
    return query(sql)(run)


def _order(*by):
    from pyspark.sql import Window

    return Window.orderBy(*by)  # languages: a few dozen rows


for _key in ("total", "code", "comment", "blank", "files"):
    _sorted(_key, _key)
_sorted("commentpct", sql_percent("comment", "total"))
_sorted("name", "upper(language)", False)


@query(f"WITH {SQL_LANGUAGES} SELECT language, total FROM languages ORDER BY total DESC, upper(language) LIMIT 5")
def top_n_languages(spark, sf_dir):
    return analysis.sort_languages(_languages(spark, sf_dir), "total", top=5).select("language", "total")


@query(f"WITH {SQL_LANGUAGES} SELECT 5::BIGINT AS shown, count(*)::BIGINT AS languages, count(*) > 5 AS truncated, 'Showing top 5 of ' || count(*) || ' languages; totals cover all languages.' AS note FROM languages")
def top_n_truncated(spark, sf_dir):
    all_ = _languages(spark, sf_dir)
    shown = analysis.sort_languages(all_, "total", top=5).agg(F.count("*").alias("shown"))
    both = shown.join(F.broadcast(all_.agg(F.count("*").alias("languages"))))
    return both.select("shown", "languages", (F.col("shown") < F.col("languages")).alias("truncated"), F.concat(F.lit("Showing top "), "shown", F.lit(" of "), "languages", F.lit(" languages; totals cover all languages.")).alias("note"))


def _hashed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.format_string("docs/%d.txt", "doc_id").alias("path"), F.upper(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"), F.col("doc_id").alias("scan_ordinal"))


@query("SELECT 'docs/' || doc_id || '.txt' AS path, upper(sha256(text)) AS hash FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def unique_files(spark, sf_dir):
    return analysis.drop_copies(_hashed(spark, sf_dir))[0].select("path", "hash")


@query("SELECT 'docs/' || doc_id || '.txt' AS path, 'duplicate of docs/' || min(doc_id) OVER (PARTITION BY text) || '.txt' AS reason FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def duplicate_skips(spark, sf_dir):
    return analysis.drop_copies(_hashed(spark, sf_dir))[1].select("path", "reason")


_ROLL = f"""WITH {SQL_CODE}, f AS (SELECT unnest(['', 'src', 'src/' || (l_orderkey % 10)]) AS folder, * FROM code_counts)
    SELECT folder, count(*)::BIGINT AS files, sum(code)::BIGINT AS code, sum(comment)::BIGINT AS comment, sum(blank)::BIGINT AS blank, sum(total)::BIGINT AS total, sum(complexity)::BIGINT AS complexity,
        {sql_health("coalesce(sum(code) FILTER (healthy), 0)", "coalesce(sum(comment) FILTER (healthy), 0)", "bool_or(healthy)")} AS health FROM f GROUP BY folder"""


@query(_ROLL)
def folder_rollup(spark, sf_dir):
    return analysis.folder_rollup(analysis.analyze_text(code_files(spark, sf_dir))).select("folder", "files", "code", "comment", "blank", "total", "complexity", "health")


@query(f"WITH {SQL_DOCS}, f AS (SELECT unnest(['', 'docs', regexp_extract(rel_path, '^(docs/[^/]*)', 1), regexp_extract(rel_path, '^(docs/[^/]*/[^/]*)', 1)]) AS folder, * FROM doc_counts) SELECT folder, count(*)::BIGINT AS files, sum(code)::BIGINT AS code, sum(blank)::BIGINT AS blank FROM f GROUP BY folder")
def folder_rollup_text(spark, sf_dir):
    return analysis.folder_rollup(analysis.analyze_text(document_files(spark, sf_dir), simple_only=True)).select("folder", "files", "code", "blank")


# --- languages of paths, filters -------------------------------------------------------------
_NAMES = ("a.py", "B.CS", "x.designer.cs", "Makefile", "MAKEFILE", "BUILD", "build", "BUILD.bazel", ".editorconfig", "z.unknown", "none", "CMakeLists.txt", "v.F90", "p.d.ts", "w.jsonc", "gemfile")


def _paths(spark, sf_dir):
    """One path for each part: a folder by its size, a name by its key."""
    p = table(spark, sf_dir, "part")
    names = F.array(*map(F.lit, _NAMES))
    folders = F.array(*map(F.lit, ("", "src/", "src/bin/", "node_modules/x/", "Sub/Tests/", "docs/a.b/", "obj/", "lib/BIN/")))
    return p.select("p_partkey", F.concat(folders[(F.col("p_size") % 8).cast("int")], names[(F.col("p_partkey") % len(_NAMES)).cast("int")]).alias("rel_path"))


_SQL_PATHS = f"""paths AS (SELECT p_partkey, ['', 'src/', 'src/bin/', 'node_modules/x/', 'Sub/Tests/', 'docs/a.b/', 'obj/', 'lib/BIN/'][p_size % 8 + 1] || [{', '.join(f"'{n}'" for n in _NAMES)}][p_partkey % {len(_NAMES)} + 1] AS rel_path FROM part)"""
_EXPECTED = ("Python", "C#", "C# Designer", "Makefile", "Makefile", "Bazel/Starlark", None, "Bazel/Starlark", "INI", None, None, "CMake", "Fortran", "TypeScript", "JSON", "Ruby")
_SQL_LANG = "[" + ", ".join(f"'{n}'" if n else "NULL" for n in _EXPECTED) + f"][p_partkey % {len(_NAMES)} + 1]"


@query(f"WITH {_SQL_PATHS} SELECT p_partkey, rel_path, {_SQL_LANG} AS language FROM paths WHERE {_SQL_LANG} IS NOT NULL")
def resolve_by_name_suffix_ext(spark, sf_dir):
    return filters.resolve_languages(_paths(spark, sf_dir))


@query(f"WITH {_SQL_PATHS} SELECT coalesce({_SQL_LANG}, 'Other') AS language, count(*)::BIGINT AS files FROM paths GROUP BY 1")
def unknown_as_other(spark, sf_dir):
    return filters.resolve_languages(_paths(spark, sf_dir), include_unknown=True).groupBy("language").agg(F.count("*").alias("files"))


@query(f"WITH {_SQL_PATHS} SELECT {_SQL_LANG} AS language, count(*)::BIGINT AS files FROM paths WHERE {_SQL_LANG} IN ('Python', 'C#', 'Fortran') GROUP BY 1")
def lang_filter_include(spark, sf_dir):
    df = filters.by_language(filters.resolve_languages(_paths(spark, sf_dir)), include=["python", "C#", "FORTRAN", "JSON"], exclude=["json"])
    return df.groupBy("language").agg(F.count("*").alias("files"))


@query(f"WITH {_SQL_PATHS} SELECT p_partkey, rel_path FROM paths WHERE (regexp_matches(rel_path, '(?i)^([^/]+/)*[^/]*[.]cs$') OR regexp_matches(rel_path, '(?i)^src/')) AND NOT regexp_matches(rel_path, '(?i)^([^/]+/)*tests/')")
def glob_include_exclude(spark, sf_dir):
    return filters.by_globs(_paths(spark, sf_dir), ["**/*.cs", "src/**"], filters.folder_globs(["tests"]))


@query(f"WITH {_SQL_PATHS} SELECT p_partkey, rel_path FROM paths WHERE NOT contains(rel_path, '/')")
def non_recursive(spark, sf_dir):
    return filters.by_globs(_paths(spark, sf_dir), recursive=False)


@query(f"WITH {_SQL_PATHS} SELECT p_partkey, rel_path FROM paths WHERE NOT regexp_matches('/' || rel_path, '/(bin|obj|artifacts|[.]git|[.]vs|[.]vscode|[.]idea|node_modules)/')")
def default_dir_excludes(spark, sf_dir):
    return filters.outside_excluded_dirs(_paths(spark, sf_dir))


@query(f"WITH {_SQL_PATHS} SELECT p_partkey, rel_path FROM paths WHERE starts_with(rel_path, 'src/')")
def snapshot_scope(spark, sf_dir):
    return filters.in_scope(_paths(spark, sf_dir), "src")


def _path_rule(spark, sf_dir, keep) -> DataFrame:
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def kept(paths):
        return paths.map(keep).astype(bool)

    return _paths(spark, sf_dir).where(kept("rel_path"))


@query(f"WITH {_SQL_PATHS} SELECT p_partkey, rel_path FROM paths WHERE NOT ((regexp_matches(rel_path, '(^|/)[^/]*[.]py$') AND rel_path <> 'src/a.py') OR starts_with(rel_path, 'docs/a.b/') OR rel_path IN ('Makefile', 'none') OR regexp_matches(rel_path, '(^|/)[v-w][.][^/]*$'))")
def gitignore_paths(spark, sf_dir):
    rules = IgnoreRules().add("", ["# c", "*.py", "/docs/a.*/", "!docs/a.b/x.designer.cs", "/Makefile", "/non[!a-d]", "[v-w].*"]).add("src", ["!/a.py"])
    return _path_rule(spark, sf_dir, lambda p: not rules.ignored(p))


@query(f"WITH {_SQL_PATHS} SELECT p_partkey, rel_path FROM paths WHERE NOT ((regexp_matches(rel_path, '(^|/)[^/]*[.]cs$') AND NOT regexp_matches(rel_path, '^src/(.*/)?x[.]designer[.]cs$')) OR (starts_with(rel_path, 'docs/') AND NOT regexp_matches(rel_path, '[.]py$')))")
def gitattributes_paths(spark, sf_dir):
    rules = AttributeRules().add("", ["[attr]made linguist-generated", "*.cs made", "docs/ linguist-vendored=true", "*.py linguist-vendored=0", "* -linguist-documentation"]).add("src", ["x.designer.cs -linguist-generated"])
    return _path_rule(spark, sf_dir, lambda p: not rules.marked(p))


# --- comparison ------------------------------------------------------------------------------
def _side(spark, sf_dir, condition: str):
    found = analysis.by_language(analysis.analyze_text(code_files(spark, sf_dir).where(condition)))
    return found.select(F.row_number().over(_order(F.col("total").desc(), F.upper("language"))).cast("long").alias("ordinal"), "language", *diff.MEASURES)


_NOW, _THEN = "scan_ordinal % 3 <> 0 AND scan_ordinal % 12 <> 7", "scan_ordinal % 5 <> 0 AND scan_ordinal % 12 <> 4"


def _sql_side(name: str, condition: str) -> str:
    return f"{name} AS (SELECT language, sum(code)::BIGINT AS code, sum(comment)::BIGINT AS comment, sum(blank)::BIGINT AS blank, sum(total)::BIGINT AS total FROM code_counts WHERE {condition.replace('scan_ordinal', 'l_orderkey')} GROUP BY language)"


_SQL_DIFF = ", ".join(f"(coalesce(n.{m}, 0) - coalesce(o.{m}, 0))::BIGINT AS {m}" for m in diff.MEASURES)


@query(f"WITH {SQL_CODE}, {_sql_side('n', _NOW)}, {_sql_side('o', _THEN)} SELECT coalesce(n.language, o.language) AS language, {_SQL_DIFF} FROM n FULL JOIN o ON upper(n.language) = upper(o.language)")
def diff_two_snapshots(spark, sf_dir):
    return diff.diff_languages(_side(spark, sf_dir, _NOW), _side(spark, sf_dir, _THEN)).select("language", *diff.MEASURES)


@query(f"WITH {SQL_CODE}, {_sql_side('n', 'true')} SELECT language, 0::BIGINT AS code, 0::BIGINT AS comment, 0::BIGINT AS blank, 0::BIGINT AS total FROM n")
def diff_of_itself(spark, sf_dir):
    return diff.diff_languages(_side(spark, sf_dir, "true"), _side(spark, sf_dir, "true")).select("language", *diff.MEASURES)


@query(f"""WITH {SQL_CODE}, {_sql_side('n', _NOW)}, {_sql_side('o', _THEN)}, top AS (SELECT * FROM o ORDER BY total DESC, upper(language) LIMIT 4),
    j AS (SELECT n.language AS a, top.language AS b, {_SQL_DIFF.replace('o.', 'top.')} FROM n FULL JOIN top ON n.language = top.language)
    SELECT coalesce(a, b) AS language, code, comment, blank, total FROM j WHERE b IS NOT NULL
    UNION ALL SELECT '(other languages)', {', '.join(f"((SELECT coalesce(sum({m}), 0) FROM j WHERE b IS NULL) - ((SELECT sum({m}) FROM o) - (SELECT sum({m}) FROM top)))::BIGINT" for m in diff.MEASURES)}""")
def diff_truncated_baseline(spark, sf_dir):
    old = _side(spark, sf_dir, _THEN)
    top = old.orderBy(F.col("total").desc(), F.upper("language")).limit(4)
    sums = lambda df, tag: df.agg(*(F.sum(m).alias(f"{m}{tag}") for m in diff.MEASURES))
    rest = sums(old, "").join(F.broadcast(sums(top, "_t"))).select(*((F.col(m) - F.col(f"{m}_t")).alias(m) for m in diff.MEASURES))
    return diff.diff_languages(_side(spark, sf_dir, _NOW), top, rest).select("language", *diff.MEASURES)


@query(f"WITH {SQL_CODE}, {_sql_side('n', _NOW)}, {_sql_side('o', _THEN)}, s AS (SELECT {', '.join(f'sum({m}) AS {m}' for m in diff.MEASURES)} FROM n), t AS (SELECT {', '.join(f'sum({m}) AS {m}' for m in diff.MEASURES)} FROM o) SELECT {', '.join(f'(s.{m} - t.{m})::BIGINT AS {m}' for m in diff.MEASURES)} FROM s, t")
def diff_totals(spark, sf_dir):
    sums = lambda c: _side(spark, sf_dir, c).agg(*(F.sum(m).alias(m) for m in diff.MEASURES))
    return diff.diff_totals(sums(_NOW), sums(_THEN))


@query(f"WITH {SQL_CODE}, {_sql_side('n', 'true')} SELECT (row_number() OVER (ORDER BY total DESC, upper(language)) - 1)::BIGINT AS ordinal, language FROM n")
def diff_order(spark, sf_dir):
    """Rows of a comparison in the order of the current side."""
    side = _side(spark, sf_dir, "true")
    return diff.diff_languages(side, side.withColumn("language", F.lower("language")).withColumn("ordinal", -F.col("ordinal"))).select("ordinal", "language")


def _scratch(spark: SparkSession) -> str:
    """A folder of this session for small files: the shared one if it is a path, else a temporary one."""
    shared = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or "").removeprefix("file://")
    return tempfile.mkdtemp(prefix="tallyspark-", dir=shared if os.path.isdir(shared) else None)


def _saved_report(spark, sf_dir, **shape) -> str:
    languages = [r.asDict() for r in analysis.sort_languages(_languages(spark, sf_dir), "total", top=shape.get("top")).collect()]
    totals = analysis.grand_totals(analysis.analyze_text(code_files(spark, sf_dir))).first().asDict()
    path = os.path.join(_scratch(spark), "report.json")
    reports.write(reports.to_json(reports.Report(totals, languages, generated_at="2024-01-01T00:00:00Z")), path)
    return path


@query(f"WITH {SQL_LANGUAGES} SELECT language, files, code, comment, blank, total, complexity, round(comment::DOUBLE / total * 100, 1) AS comment_pct, nullif({sql_health('code', 'comment', 'healthy')}, 'NotApplicable') AS health FROM languages")
def report_round_trip(spark, sf_dir):
    """The JSON report, written and read again."""
    report = diff.load_report(spark, _saved_report(spark, sf_dir))
    x = report.select(F.explode("byLanguage").alias("x")).select("x.*")
    return x.select("language", "files", "code", "comment", "blank", "total", "complexity", F.col("commentPct").alias("comment_pct"), "health")


@query(f"""WITH {SQL_LANGUAGES}, top AS (SELECT language FROM languages ORDER BY total DESC, upper(language) LIMIT 4)
    SELECT language, 0::BIGINT AS code, 0::BIGINT AS comment, 0::BIGINT AS blank, 0::BIGINT AS total FROM top UNION ALL SELECT '(other languages)', 0, 0, 0, 0""")
def diff_saved_truncated(spark, sf_dir):
    """A tree against its own report that a top cut short."""
    base, rest = diff.baseline_languages(diff.load_report(spark, _saved_report(spark, sf_dir, top=4)))
    return diff.diff_languages(_side(spark, sf_dir, "true"), base, rest).select("language", *diff.MEASURES)


@query(f"WITH {SQL_CODE} SELECT {sql_percent('sum(comment)', 'sum(total)')} < 20 AS below_20, {sql_percent('sum(comment)', 'sum(total)')} < 90 AS below_90 FROM code_counts")
def threshold_gate(spark, sf_dir):
    totals = analysis.grand_totals(analysis.analyze_text(code_files(spark, sf_dir)))
    return totals.select(*((F.col("comment_pct") < n).alias(f"below_{n}") for n in (20, 90)))


@query(f"WITH {SQL_CODE}, s AS (SELECT {sql_percent('sum(comment)', 'sum(total)')} AS pct FROM code_counts) SELECT least, pct < least AS below FROM s, (VALUES (20::DOUBLE), (90::DOUBLE)) t(least)")
def threshold_decision(spark, sf_dir):
    totals = analysis.grand_totals(analysis.analyze_text(code_files(spark, sf_dir)))
    return spark.createDataFrame([(x, analysis.below_threshold(totals, x)) for x in (20.0, 90.0)], "least double, below boolean")


def _report(spark, sf_dir, top=None) -> reports.Report:
    languages = [r.asDict() for r in analysis.sort_languages(_languages(spark, sf_dir), "total", top=top).collect()]  # a few dozen rows
    return reports.Report(analysis.grand_totals(analysis.analyze_text(code_files(spark, sf_dir))).first().asDict(), languages, generated_at="2024-01-01T00:00:00Z")


@query(f"WITH {SQL_LANGUAGES} SELECT 'Showing top 4 of ' || count(*) || ' languages; totals cover all languages.' AS note FROM languages")
def report_note(spark, sf_dir):
    return spark.createDataFrame([(_report(spark, sf_dir, top=4).note,)], "note string")


@query(f"WITH {SQL_LANGUAGES} SELECT language, files::VARCHAR AS files, code::VARCHAR AS code, comment::VARCHAR AS comment, blank::VARCHAR AS blank FROM languages UNION ALL SELECT 'Total', sum(files)::VARCHAR, sum(code)::VARCHAR, sum(comment)::VARCHAR, sum(blank)::VARCHAR FROM languages")
def report_csv(spark, sf_dir):
    """The CSV report, read again by a CSV reader."""
    path = os.path.join(_scratch(spark), "report.csv")
    reports.write(reports.to_csv(_report(spark, sf_dir)), path)
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*(F.col(rows.columns[rows.columns.index(c)]).alias(c.lower()) for c in ("Language", "Files", "Code", "Comment", "Blank")))


@query(f"WITH {SQL_LANGUAGES} SELECT language, format('{{:,}}', files) AS files, format('{{:,}}', code) AS code FROM languages")
def report_markdown(spark, sf_dir):
    """The rows of the language table of the Markdown report."""
    lines = [x.strip("|").split(" | ") for x in reports.to_markdown(_report(spark, sf_dir)).splitlines() if x.startswith("| ") and "---" not in x]
    head = [h.strip() for h in lines[0]]
    rows = [tuple(r[head.index(c)].strip().replace("\\", "") for c in ("Language", "Files", "Code")) for r in lines[1:] if "Total" not in r[0]]
    return spark.createDataFrame(rows, "language string, files string, code string")


# --- lines, bytes ----------------------------------------------------------------------------
_TEXTS = (("", 0, 0), ("a", 1, 0), ("a\n", 1, 0), ("a\r\nb\r\n", 2, 0), ("a\rb\r", 2, 0), ("\n", 1, 1), ("\n\n", 2, 2), ("a\r\r\nb", 3, 1), (" \t\n\x0b\x0c", 2, 2), ("a\n\n", 2, 1))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {n}::BIGINT, {b}::BIGINT)" for i, (_, n, b) in enumerate(_TEXTS)) + ") t(case_id, lines, blank)")
def line_split_terminators(spark, sf_dir):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(_TEXTS)], "case_id int, text string")
    return df.select("case_id", F.size(lines_column(F.col("text"))).cast("long").alias("lines"), analysis.counts_column(F.col("text"))["blank"].alias("blank"))


_BYTES = (
    (b"a\n\xc3\xa9 # c\n\n# d", 2, 1, 1), (b"\xef\xbb\xbf# a\nb", 1, 1, 0), ("﻿# a\nb".encode("utf-16-le"), 1, 1, 0), ("﻿# a\nb".encode("utf-16-be"), 1, 1, 0),
    ("﻿# a\nb".encode("utf-32-le"), 1, 1, 0), ("﻿# a\nb".encode("utf-32-be"), 1, 1, 0), (b"caf\xe9\n# x", 1, 1, 0), (b"x\r# y\r", 1, 1, 0), (b"", 0, 0, 0), (b"a\x00b", None, None, None), (b"\xef\xbb\xbfa\x00", None, None, None),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {c if c is not None else 'NULL'}::BIGINT, {m if m is not None else 'NULL'}::BIGINT, {b if b is not None else 'NULL'}::BIGINT, {'NULL' if c is not None else chr(39) + 'binary file' + chr(39)})" for i, (_, c, m, b) in enumerate(_BYTES)) + ") t(case_id, code, comment, blank, error)")
def encoding_detect(spark, sf_dir):
    df = spark.createDataFrame([(i, bytearray(x), "Python") for i, (x, *_) in enumerate(_BYTES)], "case_id int, content binary, language string")
    return analysis.analyze_content(df).select("case_id", "code", "comment", "blank", "error")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(c is None).upper()})" for i, (_, c, *_) in enumerate(_BYTES)) + ") t(case_id, is_binary)")
def binary_skip(spark, sf_dir):
    df = spark.createDataFrame([(i, bytearray(x)) for i, (x, *_) in enumerate(_BYTES)], "case_id int, content binary")
    return df.select("case_id", is_binary(F.col("content")).alias("is_binary"))


@query("SELECT doc_id, upper(sha256(text)) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.upper(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"))


@query(r"""SELECT conv_id, count(*)::BIGINT AS turns, sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n')) END)::BIGINT AS lines FROM conversations GROUP BY conv_id""")
def conversation_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("lines", F.size(lines_column(F.coalesce("text", F.lit("")))))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("lines").alias("lines"))


def _template(x) -> tuple[str, bool]:
    """A line that is a comment in a language if it has comments, and whether it has."""
    token = x.line[0] + " note" if x.line else f"{x.blocks[0].open} note {x.blocks[0].close}" if x.blocks and not x.blocks[0].line_start else None
    return token or "zzz note", token is not None


_TEMPLATES = [(k, x.name, *_template(x)) for k, x in enumerate(LANGUAGES)]


@query("WITH l(k, language, able) AS (VALUES " + ", ".join(f"({k}, '{name.replace(chr(39), chr(39) * 2)}', {able})" for k, name, _, able in _TEMPLATES) + f""")
    SELECT language, count(*)::BIGINT AS files, sum(1 + doc_id % 4 + CASE WHEN able THEN 0 ELSE 1 + doc_id % 3 END)::BIGINT AS code, sum(CASE WHEN able THEN 1 + doc_id % 3 ELSE 0 END)::BIGINT AS comment,
           sum(doc_id % 5)::BIGINT AS blank FROM documents JOIN l ON l.k = doc_id % {len(_TEMPLATES)} GROUP BY language""")
def every_language(spark, sf_dir):
    """A file of code, comment and blank lines for every document, in each of the languages in turn."""
    at = F.create_map(*(F.lit(v) for k, name, line, _ in _TEMPLATES for v in (k, F.struct(F.lit(name).alias("language"), F.lit(line).alias("line")))))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scan_ordinal"), at[(F.col("doc_id") % len(_TEMPLATES)).cast("int")].alias("x"))
    text = F.concat(F.expr("repeat('zzz7\n', cast(1 + scan_ordinal % 4 AS int))"), F.expr("repeat(concat(x.line, '\n'), cast(1 + scan_ordinal % 3 AS int))"), F.expr("repeat(' \n', cast(scan_ordinal % 5 AS int))"))
    files = d.select("scan_ordinal", F.col("x.language").alias("language"), text.alias("text"))
    return analysis.by_language(analysis.analyze_text(files)).select("language", "files", "code", "comment", "blank")


@query("SELECT * FROM (VALUES (78::BIGINT, 13::BIGINT, 158::BIGINT)) t(languages, with_complexity, extensions)")
def language_registry(spark, sf_dir):
    rows = [(x.name, x.supports_complexity, len(x.extensions) + len(x.suffixes)) for x in LANGUAGES]
    df = spark.createDataFrame(rows, "language string, able boolean, n int")
    return df.agg(F.count("*").alias("languages"), F.sum(F.col("able").cast("long")).alias("with_complexity"), F.sum("n").alias("extensions"))


# --- sources and watching --------------------------------------------------------------------
_TREE = {
    "a.py": "# a\nx = 1\n\n", "_p.scss": "// b\n", ".editorconfig": "; c\nx=1\n", "src/b.cs": "int b; // b\n/* c\n*/\n", "src/skip.log": "x", "src/bin/no.cs": "x", "gen/g.cs": "x",
    "vendor/v.js": "x", "out/o.py": "x = 1", ".gitignore": "out/\n", ".gitattributes": "vendor/ linguist-vendored\n", "gen/.gitattributes": "*.cs linguist-generated\n", ".hid/.d.py": "y = 2\n",
}
_TREE_ROWS = ((".editorconfig", "INI", 1, 1, 0), (".hid/.d.py", "Python", 1, 0, 0), ("_p.scss", "SCSS/Less", 0, 1, 0), ("a.py", "Python", 1, 1, 1), ("src/b.cs", "C#", 1, 2, 0))


def write_tree(folder: str, tree: dict[str, str] = _TREE) -> str:
    for name, text in tree.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8", newline="") as file:
            file.write(text)
    return folder


_SQL_TREE = "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{n}', {c}::BIGINT, {m}::BIGINT, {b}::BIGINT)" for p, n, c, m, b in _TREE_ROWS) + ") t(rel_path, language, code, comment, blank)"


@query(_SQL_TREE)
def scan_source_tree(spark, sf_dir):
    """A small tree with ignore and attribute files, listed and read by the data source."""
    register(spark)
    root = os.path.join(_scratch(spark), "tree")
    os.makedirs(os.path.join(root, ".git/objects"))
    os.makedirs(os.path.join(root, ".git/refs"))
    write_tree(root, {**_TREE, ".git/HEAD": "ref: refs/heads/main\n"})
    scanned = spark.read.format("sourcetree").load(root).where("skip_reason IS NULL").drop("skip_reason")
    return analysis.analyze_content(scanned).select("rel_path", "language", "code", "comment", "blank")


@query(_SQL_TREE)
def watch_passes(spark, sf_dir):
    """The tree as it is after a change that a watch saw."""
    import time

    from ..streaming.watch import watch_tree

    register(spark)
    root = os.path.join(_scratch(spark), "watched")
    os.makedirs(os.path.join(root, ".git/objects"))
    os.makedirs(os.path.join(root, ".git/refs"))
    write_tree(root, {**_TREE, ".git/HEAD": "ref: refs/heads/main\n", "a.py": ""})
    passes: list[list] = []

    def scan(session) -> None:
        scanned = session.read.format("sourcetree").load(root).where("skip_reason IS NULL").drop("skip_reason")
        passes.append(analysis.analyze_content(scanned).select("rel_path", "language", "code", "comment", "blank").collect())  # a tree of a few files

    stream = watch_tree(spark, root, scan)
    try:
        for n, name in ((1, "a.py"), (2, None)):
            end = time.time() + 60
            while len(passes) < n and time.time() < end:
                time.sleep(0.1)
            if name:
                write_tree(root, {name: _TREE[name]})
    finally:
        stream.stop()
    return spark.createDataFrame(passes[-1], "rel_path string, language string, code long, comment long, blank long")


def _repository(spark) -> str:
    """A git repository whose work tree has moved on from its only commit."""
    root = os.path.join(_scratch(spark), "repository")
    write_tree(root, _TREE)
    who = ["-c", "user.name=t", "-c", "user.email=t@example.com"]
    for command in (["init", "-q"], ["add", "-A"], [*who, "commit", "-qm", "one"]):
        subprocess.run(["git", "-C", root, *command], check=True, capture_output=True)
    write_tree(root, {"a.py": "", "late.py": "x = 1\n"})
    return root


@query(_SQL_TREE)
def git_snapshot_tree(spark, sf_dir):
    """The committed tree, with its rule files, whatever the work tree holds now."""
    register(spark)
    scanned = spark.read.format("gittree").options(ref="HEAD", filters="true").load(_repository(spark)).where("skip_reason IS NULL").drop("skip_reason")
    return analysis.analyze_content(scanned).select("rel_path", "language", "code", "comment", "blank")


@query("SELECT * FROM (VALUES ('a.py', 1::BIGINT, 1::BIGINT, 1::BIGINT, NULL::VARCHAR), ('b.cs', 1, 2, 0, NULL), ('none.py', NULL, NULL, NULL, 'not found')) t(name, code, comment, blank, skip_reason)")
def scan_file_list(spark, sf_dir):
    """Files of a list: the first of each path, in spite of ignore rules; what is missing is told."""
    register(spark)
    root = write_tree(os.path.join(_scratch(spark), "listed"))
    names = read_list("\r\n".join(os.path.join(root, n) for n in ("src/b.cs", "a.py", "none.py", "src/../a.py")))
    scanned = spark.read.format("sourcetree").options(filelist="\n".join(names)).load(root)
    name = F.substring_index(F.col("path"), "/", -1).alias("name")
    counted = analysis.analyze_content(scanned.where("skip_reason IS NULL").drop("skip_reason")).select(name, "code", "comment", "blank", F.lit(None).cast("string").alias("skip_reason"))
    none = F.lit(None).cast("long")
    return counted.unionByName(scanned.where("skip_reason IS NOT NULL").select(name, none.alias("code"), none.alias("comment"), none.alias("blank"), "skip_reason"))


@query("SELECT 'b.cs' AS rel_path, 1::BIGINT AS code, 2::BIGINT AS comment, 0::BIGINT AS blank")
def scan_single_file(spark, sf_dir):
    register(spark)
    root = write_tree(os.path.join(_scratch(spark), "single"))
    scanned = spark.read.format("sourcetree").load(os.path.join(root, "src/b.cs")).where("skip_reason IS NULL").drop("skip_reason")
    return analysis.analyze_content(scanned).select("rel_path", "code", "comment", "blank")
