"""Comparison of two results by language, and saved reports as a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The row for languages that a shortened baseline cannot tell apart.
OTHERS = "(other languages)"
MEASURES = ("code", "comment", "blank", "total")
_SHARES = "code bigint, codePct double, comment bigint, commentPct double, blank bigint, blankPct double, total bigint"
_BODY = _SHARES.replace(" bigint", ":bigint").replace(" double", ":double").replace(", ", ",")
REPORT_SCHEMA = (
    f"generatedAt string, sourcePath string, fileCount bigint, {_SHARES}, complexity bigint, "
    f"byLanguage array<struct<language:string,files:bigint,{_BODY},health:string,complexity:bigint>>, byLanguageTruncated boolean, languageCount bigint, "
    f"files array<struct<path:string,language:string,{_BODY},health:string,complexity:bigint>>, skipped array<struct<path:string,reason:string>>"
)


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """One row; an error if the report has no breakdown at all (an empty list is one)."""
    report = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    row = report.select(F.col("byLanguage").isNull() & F.col("files").isNull()).first()
    if row is None or row[0]:
        raise ValueError(f"not a report with a breakdown: {path}")
    return report


def _last_of_case(languages: DataFrame) -> DataFrame:
    """Of spellings that differ by case the last, at the place of the first."""
    return languages.groupBy(F.upper("language").alias("key")).agg(
        F.max_by("language", "ordinal").alias("language"), *(F.max_by(m, "ordinal").alias(m) for m in MEASURES), F.min("ordinal").alias("ordinal")
    )


def baseline_languages(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(languages, remainder) of a saved report; remainder has a row only if a top cut the breakdown and files are missing."""
    r = report.withColumns({"_n": F.coalesce(F.size("byLanguage"), F.lit(0)), "_f": F.coalesce(F.size("files"), F.lit(0))})
    r = r.withColumn("_cut", F.coalesce("byLanguageTruncated", F.lit(False)))
    listed = r.where("_n > 0 AND (NOT _cut OR _f <= 0)").select(F.posexplode("byLanguage").alias("ordinal", "x"))
    listed = listed.select(F.col("ordinal").cast("long").alias("ordinal"), "x.language", *(f"x.{m}" for m in MEASURES))
    files = r.where("_f > 0 AND (_n <= 0 OR _cut)").select(F.posexplode("files").alias("ordinal", "x"))
    regrouped = files.groupBy(F.upper("x.language").alias("key")).agg(
        F.min("ordinal").cast("long").alias("ordinal"), F.min_by("x.language", "ordinal").alias("language"), *(F.sum(f"x.{m}").alias(m) for m in MEASURES)
    ).select("ordinal", "language", *MEASURES)
    left = lambda m: (F.coalesce(m, F.lit(0).cast("long")) - F.aggregate("byLanguage", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[m], F.lit(0).cast("long")))).alias(m)
    remainder = r.where("_n > 0 AND _cut AND _f <= 0").select(*(left(m) for m in MEASURES))
    return listed.unionByName(regrouped), remainder


def diff_languages(current: DataFrame, baseline: DataFrame, remainder: DataFrame | None = None) -> DataFrame:
    """ordinal, language and the change of each measure, current less baseline.

    Both sides have ordinal, language and the measures.  Current languages come in their
    order, then those of the baseline alone.  With a remainder row, current languages that
    the baseline lacks are compared with it together.
    """
    base = _last_of_case(baseline)
    cur = current.select(F.upper("language").alias("key"), F.col("ordinal").alias("c_ordinal"), F.col("language").alias("c_language"), *(F.col(m).alias(f"c_{m}") for m in MEASURES))
    both = cur.join(base, "key", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    place = F.when(F.col("c_ordinal").isNotNull(), F.struct(F.lit(0).alias("part"), F.col("c_ordinal").cast("long").alias("at"))).otherwise(F.struct(F.lit(1).alias("part"), F.col("ordinal").cast("long").alias("at")))
    rows = both.select(
        place.alias("place"), F.coalesce("c_language", "language").alias("language"), F.col("language").isNull().alias("new"),
        *((zero(f"c_{m}") - zero(m)).alias(m) for m in MEASURES),
    )
    if remainder is not None:
        rest = remainder.select(*(F.col(m).alias(f"r_{m}") for m in MEASURES))
        rows = rows.join(F.broadcast(rest.select(F.lit(True).alias("cut")).limit(1)), how="left")  # one row at most
        folded = rows.where("new AND cut").agg(*(F.coalesce(F.sum(m), F.lit(0).cast("long")).alias(m) for m in MEASURES))
        last = folded.join(F.broadcast(rest), how="inner").select(
            F.struct(F.lit(2).alias("part"), F.lit(0).cast("long").alias("at")).alias("place"), F.lit(OTHERS).alias("language"), F.lit(True).alias("new"),
            *((F.col(m) - F.col(f"r_{m}")).alias(m) for m in MEASURES),
        )
        rows = rows.where("NOT (new AND coalesce(cut, false))").drop("cut").unionByName(last)
    order = F.expr("row_number() OVER (ORDER BY place) - 1").cast("long")  # languages only: a few dozen rows
    return rows.select(order.alias("ordinal"), "language", *MEASURES)


def diff_totals(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """The change of the totals, one row, from one row each."""
    b = baseline.select(*(F.col(m).alias(f"b_{m}") for m in MEASURES))
    return current.select(*MEASURES).join(F.broadcast(b)).select(*((F.col(m) - F.col(f"b_{m}")).alias(m) for m in MEASURES))
