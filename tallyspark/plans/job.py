"""A run: options to files to counts to a report."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, diff
from ..sinks import reports
from ..sources.datasource import option_strings, register
from ..sources.walker import read_list
from ..streaming.watch import watch_tree
from .options import ERROR, OK, THRESHOLD, OptionError, RunOptions, output_format


@dataclass
class Result:
    files: DataFrame
    languages: DataFrame
    totals: DataFrame
    skipped: DataFrame
    counted: DataFrame  # persisted; done() lets it go

    def done(self) -> None:
        self.counted.unpersist()


def load_files(spark: SparkSession, options: RunOptions, git_ref: str | None = None, filters: bool = False) -> DataFrame:
    register(spark)
    given = option_strings(options.scan)
    if git_ref:
        return spark.read.format("gittree").options(**given, ref=git_ref, filters=str(filters).lower()).load(options.path)
    if options.list_file:
        text = sys.stdin.read() if options.list_file == "-" else open(options.list_file, encoding="utf-8-sig").read()
        return spark.read.format("sourcetree").options(**given, filelist="\n".join(read_list(text)) or " ").load(options.path)
    return spark.read.format("sourcetree").options(**given).load(options.path)


def analyze_files(scanned: DataFrame, options: RunOptions) -> Result:
    """Counts, aggregates and what was skipped: by the scan, by the analysis, as a copy, in that order."""
    read = scanned.where("skip_reason IS NULL").drop("skip_reason")
    counted = analysis.analyze_content(read, complexity=not options.no_complexity, hashes=options.unique).persist()  # read once, used four times
    good = counted.where("error IS NULL").drop("error")
    skips = [
        scanned.where("skip_reason IS NOT NULL").select("path", F.col("skip_reason").alias("reason"), F.lit(0).alias("phase"), F.col("scan_ordinal").alias("seq")),
        counted.where("error IS NOT NULL").select("path", F.col("error").alias("reason"), F.lit(1).alias("phase"), F.col("scan_ordinal").alias("seq")),
    ]
    if options.unique:
        good, copies = analysis.drop_copies(good)
        skips.append(copies.select("path", "reason", F.lit(2).alias("phase"), F.col("scan_ordinal").alias("seq")))
    skipped = skips[0]
    for more in skips[1:]:
        skipped = skipped.unionByName(more)
    files = analysis.with_percentages(good).withColumn("health", analysis.health(F.col("code"), F.col("comment"), analysis.supports_health(F.col("language"))))
    return Result(files, analysis.by_language(good), analysis.grand_totals(good), skipped, counted)


def report_of(result: Result, options: RunOptions, clock: datetime | None = None) -> reports.Report:
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a report is what a person reads
    comparing = bool(options.compare_to or options.baseline)
    languages = rows(analysis.sort_languages(result.languages, options.sort, top=None if comparing else options.top))
    files = rows(result.files.orderBy("scan_ordinal").drop("content")) if options.by_file or options.detailed else []
    return reports.Report(
        totals=rows(result.totals)[0], languages=languages, files=files, skipped=[(r["path"], r["reason"]) for r in rows(result.skipped.orderBy("phase", "seq"))],
        generated_at=(clock or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ"), source=options.path, by_file=options.by_file, detailed=options.detailed,
        no_health=options.no_health, no_complexity=options.no_complexity,
    )


def ordered(result: Result, options: RunOptions) -> DataFrame:
    """Languages with their place in the chosen order, for a comparison."""
    key = analysis.sort_languages(result.languages, options.sort)
    order = key.select("language").collect()  # a few dozen names
    at = F.create_map(*(F.lit(x) for k, r in enumerate(order) for x in (r["language"], k))) if order else F.create_map().cast("map<string,int>")
    return result.languages.select(at[F.col("language")].cast("long").alias("ordinal"), "language", *diff.MEASURES)


def compare(spark: SparkSession, options: RunOptions, result: Result) -> tuple[DataFrame, DataFrame]:
    """(changes by language, change of the totals) against another revision or a saved report."""
    current = ordered(result, options)
    if options.baseline:
        saved = diff.load_report(spark, options.baseline)
        base, remainder = diff.baseline_languages(saved)
        return diff.diff_languages(current, base, remainder), diff.diff_totals(result.totals, saved)
    other = analyze_files(load_files(spark, options, options.compare_to, filters=not options.git_hash), options)
    return diff.diff_languages(current, ordered(other, options)), diff.diff_totals(result.totals, other.totals)


def watch(spark: SparkSession, options: RunOptions, show, warn, stopped: Callable[[], bool]) -> int:
    """A run for every change of the tree until stopped() or an interrupt; the exit code of the last pass."""
    last = [OK]

    def one(_: SparkSession) -> None:
        last[0] = run(spark, replace(options, watch=False), show, warn)
        if last[0] == ERROR:
            raise RuntimeError("the pass failed and will be tried again")

    stream = watch_tree(spark, options.path, one, on_error=lambda problem: warn(str(problem)))
    try:
        while not stopped() and not stream.awaitTermination(0.2):
            pass
    except KeyboardInterrupt:
        pass
    finally:
        stream.stop()
    return last[0]


def run(spark: SparkSession, options: RunOptions, show=print, warn=lambda m: print(m, file=sys.stderr), clock: datetime | None = None, stopped: Callable[[], bool] = lambda: False) -> int:
    """Runs and reports; the exit code.  With watch, until stopped() or an interrupt."""
    result = None
    try:
        options.check()
        if options.watch:
            return watch(spark, options, show, warn, stopped)
        kind = output_format(options.format, options.output)
        comparing = bool(options.compare_to or options.baseline)
        if comparing and kind not in ("table", "json"):
            if options.output:
                raise OptionError("a comparison is a table or JSON")
            warn("a comparison is shown as a table")
            kind = "table"
        result = analyze_files(load_files(spark, options, options.git_hash), options)
        if comparing:
            changes, total = compare(spark, options, result)
            rows = [r.asDict() for r in changes.orderBy("ordinal").collect()]
            text = (reports.diff_json if kind == "json" else reports.diff_table)(total.first().asDict(), rows)
        else:
            report = report_of(result, options, clock)
            folders = [r.asDict() for r in analysis.folder_rollup(result.files).collect()] if kind == "html" and report.shows_files else []
            text = reports.to_html(report, folders) if kind == "html" else reports.RENDERERS[kind](report)
        if options.output and kind != "table":
            reports.write(text, options.output)
        else:
            if options.output:
                warn("a table is not written to a file")
            show(text)
        if options.min_comment_pct is not None:
            below = analysis.below_threshold(result.totals, options.min_comment_pct)
            if below is None:
                warn("no files to hold against the threshold")
            elif below:
                return THRESHOLD
        return OK
    except (OptionError, OSError, ValueError) as problem:
        warn(str(problem))
        return ERROR
    finally:
        if result is not None:
            result.done()


def with_defaults(**given) -> RunOptions:
    return replace(RunOptions(), **given)
