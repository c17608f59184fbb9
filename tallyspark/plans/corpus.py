"""Virtual source trees over the driver's tables, each with the same rule in Spark and in SQL.

``text_files``: documents as .txt files and pages as .html files.  Line breaks are put
where the raw tables have none, so that blank and comment lines occur.
``code_files``: one line of source for each lineitem row, from a template by its numbers;
one file for each order.  Templates close what they open, so counts do not depend on
the order of lines, and the expected counts need no classifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- texts -----------------------------------------------------------------------------------
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.col("page_id").alias("scan_ordinal"), F.format_string("web/%d.html", F.col("page_id")).alias("rel_path"), F.lit("HTML").alias("language"),
        F.replace("html", F.lit("><"), F.lit(">\n \n<")).alias("text"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("scan_ordinal"), F.concat(F.lit("docs/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"),
        F.lit("Text").alias("language"), F.replace("text", F.lit(". "), F.lit(".\n \t\n")).alias("text"),
    )


SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPLIT = r"CASE WHEN t = '' THEN [] ELSE string_split_regex(regexp_replace(t, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') END"
_COMMENT = r"(?s)<!--.*?(-->|$)|@\*.*?(\*@|$)"
#: page_id, code, comment, blank of page_files.
SQL_PAGES = rf"""
    p0 AS (SELECT page_id, replace(replace(html, '><', E'>\n \n<'), chr(1), chr(2)) AS t FROM pages),
    p1 AS (SELECT page_id, string_split_regex(t, '{_COMMENT}') AS rest, regexp_extract_all(t, '{_COMMENT}') AS com FROM p0),
    p2 AS (SELECT page_id, list_reduce(list_transform(range(1, len(rest) + 1), lambda i: rest[i] || coalesce(regexp_replace(com[i], '[^{SPACE}]', chr(1), 'g'), '')), lambda x, y: x || y) AS t FROM p1),
    p3 AS (SELECT page_id, unnest({_SPLIT}) AS line FROM p2),
    page_counts AS (SELECT page_id, count(*) FILTER (regexp_matches(line, '[^{SPACE}\x01]')) AS code,
        count(*) FILTER (NOT regexp_matches(line, '[^{SPACE}\x01]') AND contains(line, chr(1))) AS comment,
        count(*) FILTER (NOT regexp_matches(line, '[^{SPACE}]')) AS blank FROM p3 GROUP BY page_id)"""
#: doc_id, rel_path, code, blank of document_files.
SQL_DOCS = rf"""
    d0 AS (SELECT doc_id, 'docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS rel_path, replace(text, '. ', E'.\n \t\n') AS t FROM documents),
    d1 AS (SELECT doc_id, rel_path, unnest({_SPLIT}) AS line FROM d0),
    doc_counts AS (SELECT d0.doc_id, d0.rel_path, count(*) FILTER (regexp_matches(line, '[^{SPACE}]')) AS code, count(*) FILTER (NOT regexp_matches(line, '[^{SPACE}]')) AS blank
        FROM d0 LEFT JOIN d1 USING (doc_id) GROUP BY ALL)"""


# --- code ------------------------------------------------------------------------------------
#: Languages of the code files, in turn by order key: extension, name, has complexity, has health, and lines of
#: code, code and comment, comment, comment token in a string, two-line comment (or two comments), branch with two tokens.
CODE = (
    (".cs", "C#", True, True, "int a = 1;", "int b = 2; // b", "// note", 'var u = "http://x /* y";', "/* one\n two */", "if (a && b) { }"),
    (".py", "Python", True, True, "a = 1", "b = 2  # b", "# note", "u = 'x # y'", '"""one\n two"""', "if a and b:"),
    (".sql", "SQL", False, True, "select 1", "select 2 -- b", "-- note", "select '-- x /* y'", "/* one\n two */", "select case"),
    (".rs", "Rust", True, True, "let a = 1;", "let b = '\"'; // b", "// note", 'let u = "// x";', "/* one /* in\n two */ out */", "if a && b { }"),
    (".js", "JavaScript", True, True, "let a = 1 / 2;", "b = /[/*]/; // b", "// note", "let u = `// x /* y`;", "/* one\n two */", "if (a || b) { }"),
    (".hs", "Haskell", False, True, "a --> b", "b = 2 -- b", "-- note", 'u = "-- x {- y"', "{- one {- in\n two -} out -}", "if a then b"),
    (".lua", "Lua", False, True, "a = 1", "b = 2 -- b", "-- note", "u = '-- x'", "--[==[ one\n two ]==]", "if a then"),
    (".rb", "Ruby", True, True, "a = 1", "b = 2 # b", "# note", "u = '# x'", "=begin\n=end", "if a && b"),
    (".vb", "Visual Basic", False, True, "Dim a", "Dim b ' b", "REM note", 'u = "\' x"', "' one\n rem two", "If a Then"),
    (".php", "PHP", True, True, "#[Attr]", "$b = 2; # b", "// note", "$u = '# x';", "/* one\n two */", "foreach ($a && $b)"),
    (".yml", "YAML", False, False, "a: 1", "b: 2 # b", "# note", "u: '# x'", "# one\n# two", "if: a"),
    (".scm", "Scheme", False, True, "(a #\\; b)", "(b) ; b", "; note", '(u "; x")', "#| one #| in\n two |# out |#", "(if a b)"),
)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_ordinal, rel_path, language, text."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    template = (F.col("l_linenumber") + F.col("l_partkey")) % 7
    lang = F.col("l_orderkey") % len(CODE)
    lines = F.array(*(F.array(*(F.lit(x) for x in row[4:]), F.lit(" \t")) for row in CODE))
    rows = l.select("l_orderkey", "l_linenumber", lines[lang.cast("int")][template.cast("int")].alias("line"))
    files = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), "\n").alias("text"))
    pick = lambda i: F.array(*(F.lit(row[i]) for row in CODE))[(F.col("l_orderkey") % len(CODE)).cast("int")]
    return files.select(F.col("l_orderkey").alias("scan_ordinal"), F.concat(F.lit("src/"), (F.col("l_orderkey") % 10).cast("string"), F.lit("/f"), F.col("l_orderkey").cast("string"), pick(0)).alias("rel_path"), pick(1).alias("language"), "text")


def _case(expr: str, values) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_TOKENS = ", ".join(str(t) for t in (2, 2, 0, 2, 2, 0, 0, 2, 0, 2, 0, 0))
#: l_orderkey, rel_path, language, able, healthy, code, comment, blank, total, complexity of code_files.
SQL_CODE = f"""
    c0 AS (SELECT l_orderkey, l_orderkey % {len(CODE)} AS lang, (l_linenumber + l_partkey) % 7 AS k FROM lineitem),
    c1 AS (SELECT l_orderkey, lang, count(*) FILTER (k IN (0, 1, 3, 5))::BIGINT AS code, (count(*) FILTER (k = 2) + 2 * count(*) FILTER (k = 4))::BIGINT AS comment, count(*) FILTER (k = 6)::BIGINT AS blank,
        (1 + count(*) FILTER (k = 5) * [{_TOKENS}][lang + 1])::BIGINT AS n FROM c0 GROUP BY l_orderkey, lang),
    code_counts AS (SELECT l_orderkey, 'src/' || (l_orderkey % 10) || '/f' || l_orderkey || {_case('lang', [f"'{r[0]}'" for r in CODE])} AS rel_path, {_case('lang', [f"'{r[1]}'" for r in CODE])} AS language,
        {_case('lang', [str(r[2]).upper() for r in CODE])} AS able, {_case('lang', [str(r[3]).upper() for r in CODE])} AS healthy,
        code, comment, blank, code + comment + blank AS total, CASE WHEN {_case('lang', [str(r[2]).upper() for r in CODE])} THEN n END AS complexity FROM c1)"""


def sql_health(code: str, comment: str, supported: str) -> str:
    share = f"({comment}::DOUBLE / ({code} + {comment}))"
    return f"CASE WHEN NOT {supported} OR {code} + {comment} = 0 THEN 'NotApplicable' WHEN {comment} = 0 THEN 'None' WHEN {share} < 0.05 THEN 'Low' WHEN {share} < 0.10 THEN 'Fair' WHEN {share} < 0.25 THEN 'Good' WHEN {share} < 0.40 THEN 'High' ELSE 'Dense' END"


def sql_percent(part: str, total: str) -> str:
    return f"CASE WHEN {total} = 0 THEN 0.0::DOUBLE ELSE {part}::DOUBLE / {total} * 100 END"


#: One row for each language of code_files.
SQL_LANGUAGES = f"""{SQL_CODE},
    languages AS (SELECT language, count(*)::BIGINT AS files, sum(code)::BIGINT AS code, sum(comment)::BIGINT AS comment, sum(blank)::BIGINT AS blank, sum(total)::BIGINT AS total,
        sum(complexity)::BIGINT AS complexity, bool_and(healthy) AS healthy FROM code_counts GROUP BY language)"""
