"""Per-file analysis and everything that is aggregated from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classifier import count_bytes, count_named
from ..functions.languages import LANGUAGES, by_name
from ..functions.text import JAVA_SPACE, lines_column

MASK = "\x01"
#: Languages whose only tokens are block comments that do not nest, or that have none: pure expressions classify them.
BLOCK_ONLY = tuple(x for x in LANGUAGES if not x.line and not x.quotes and not x.token_exceptions and not any(b.nested or b.line_start for b in x.blocks))
#: Parts that the copies of one file are dealt in.
COPY_SALTS = 32
SORTS = ("total", "code", "comment", "blank", "files", "commentpct", "name")


def _java(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def counts_column(text: Column, blocks: tuple = ()) -> Column:
    """struct<code, comment, blank> of a text whose language has these blocks and nothing else."""

    def of_lines(lines: Column) -> Column:
        code = F.size(F.filter(lines, lambda x: x.rlike(f"[^{MASK}{JAVA_SPACE}]"))).cast("long")
        solid = F.size(F.filter(lines, lambda x: x.rlike(f"[^{JAVA_SPACE}]"))).cast("long")
        three = F.struct(code.alias("code"), solid.alias("solid"), F.size(lines).cast("long").alias("n"))
        return _bind(three, lambda c: F.struct(c["code"].alias("code"), (c["solid"] - c["code"]).alias("comment"), (c["n"] - c["solid"]).alias("blank")))

    def of_text(whole: Column) -> Column:
        return _bind(lines_column(whole), of_lines)

    if not blocks:
        return of_text(text)
    comment = "(?s)" + "|".join(f"{_java(b.open)}.*?(?:{_java(b.close)}|\\z)" for b in blocks)

    def of_clean(clean: Column) -> Column:
        masked = F.transform(F.regexp_extract_all(clean, F.lit(comment), F.lit(0)), lambda c: F.regexp_replace(c, f"[^{JAVA_SPACE}]", MASK))
        return _bind(F.array_join(F.flatten(F.zip_with(F.split(clean, comment, -1), masked, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""), of_text)

    return _bind(F.translate(text, MASK, "\x02"), of_clean)


def analyze_text(files: DataFrame, text: str = "text", language: str = "language", complexity: bool = True, simple_only: bool = False) -> DataFrame:
    """files with code, comment, blank and complexity of a text column.

    One pass: texts of languages that expressions can classify stay in the JVM, only the
    others are sent to the Arrow function, whole text by whole text.  With simple_only
    there are no others, and no Python runs.
    """
    cols = [c for c in files.columns if c not in ("code", "comment", "blank", "complexity")]
    upper = F.upper(files[language])
    simple = {x.name.upper(): x.blocks for x in (*BLOCK_ONLY, by_name()["OTHER"])}
    known = F.coalesce(upper.isin(list(simple)), F.lit(False))
    case = None
    for blocks in dict.fromkeys(simple.values()):
        names = [n for n, b in simple.items() if b == blocks]
        case = (F.when if case is None else case.when)(upper.isin(names), counts_column(files[text], blocks))
    if simple_only:
        return files.withColumn("_c", case).select(*cols, "_c.code", "_c.comment", "_c.blank", F.lit(None).cast("long").alias("complexity"))
    sent = classifier_udf(complexity)(F.when(~known, files[text]), files[language])
    df = files.withColumn("_s", sent).withColumn("_c", F.when(known, case))
    return df.select(*cols, *(F.coalesce(f"_s.{c}", f"_c.{c}").alias(c) for c in ("code", "comment", "blank")), F.col("_s.complexity").alias("complexity"))


def classifier_udf(complexity: bool = True):
    """An Arrow function (text, language name) -> struct<code, comment, blank, complexity>."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<code:bigint,comment:bigint,blank:bigint,complexity:bigint>")
    def classify(text: pa.Array, language: pa.Array) -> pa.Array:
        rows = []
        for t, name in zip(text.to_pylist(), language.to_pylist(), strict=True):
            rows.append(dict(count_named(t, name, complexity)._asdict()) if t is not None else None)
        return pa.array(rows, pa.struct([(k, pa.int64()) for k in ("code", "comment", "blank", "complexity")]))

    return classify


def analyze_content(files: DataFrame, content: str = "content", language: str = "language", complexity: bool = True, hashes: bool = False) -> DataFrame:
    """files with counts of a binary column, error for those that cannot be read, and hash (upper-case SHA-256) if asked for."""
    keep = [f for f in files.schema.fields if f.name not in ("code", "comment", "blank", "complexity", "error", "hash", content)]
    if hashes:
        files = files.withColumn("hash", F.upper(F.sha2(F.col(content), 256)))
    names = [f.name for f in keep] + (["hash"] if hashes else [])
    place = {n: i for i, n in enumerate([*names, content])}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + (", hash string" if hashes else "") + ", code long, comment long, blank long, complexity long, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are whole files: Spark bounds a batch in bytes, and 256 of them are objects at the same time
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            out: list[list] = [[], [], [], [], []]
            for data, name in zip(batch.column(place[content]).to_pylist(), batch.column(place[language]).to_pylist(), strict=True):
                try:
                    got = count_bytes(data or b"", by_name().get((name or "").upper()), complexity)
                    row = (*got, None) if got else (None, None, None, None, "binary file")
                except Exception as problem:  # one bad file is an entry of the report, not the end of the job
                    row = (None, None, None, None, f"analysis error: {problem}")
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(place[n]) for n in names), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())],
                names=[*names, "code", "comment", "blank", "complexity", "error"],
            )

    return files.select(*names, content).mapInArrow(run, schema)


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part.cast("double") / total * 100)


def with_percentages(df: DataFrame) -> DataFrame:
    """df with total and the three shares of it, 0 to 100."""
    df = df.withColumn("total", F.col("code") + F.col("comment") + F.col("blank"))
    return df.withColumns({f"{k}_pct": percent(F.col(k), F.col("total")) for k in ("code", "comment", "blank")})


def health(code: Column, comment: Column, supported: Column) -> Column:
    """The level of comment density among code and comments."""
    share = comment.cast("double") / (code + comment)
    return (
        F.when(~supported | (code + comment == 0), "NotApplicable").when(comment == 0, "None").when(share < 0.05, "Low")
        .when(share < 0.10, "Fair").when(share < 0.25, "Good").when(share < 0.40, "High").otherwise("Dense")
    )


def supports_health(language: Column) -> Column:
    return F.coalesce(F.upper(language).isin([x.name.upper() for x in LANGUAGES if x.supports_health]), F.lit(False))


def supports_complexity(language: Column) -> Column:
    return F.coalesce(F.upper(language).isin([x.name.upper() for x in LANGUAGES if x.supports_complexity]), F.lit(False))


def by_language(files: DataFrame, order: str = "scan_ordinal") -> DataFrame:
    """One row for each language, whatever its case; the spelling of the first file is shown."""
    name = F.min_by("language", order) if order in files.columns else F.min("language")
    out = files.groupBy(F.upper("language").alias("_key")).agg(
        name.alias("language"), F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("code", "comment", "blank")),
        F.sum("complexity").alias("complexity"),
    )
    out = out.withColumn("complexity", F.when(supports_complexity(F.col("language")), F.coalesce("complexity", F.lit(0).cast("long"))))
    out = out.withColumn("complexity_avg", F.when(F.col("files") > 0, F.col("complexity").cast("double") / F.col("files")))
    return with_percentages(out).withColumn("health", health(F.col("code"), F.col("comment"), supports_health(F.col("language")))).drop("_key")


def grand_totals(files: DataFrame) -> DataFrame:
    """One row over all files, never limited by a top."""
    out = files.agg(
        F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("code", "comment", "blank")),
        F.sum("complexity").alias("complexity"), F.count_distinct(F.upper("language")).alias("languages"),
    )
    return with_percentages(out)


def totals_of_languages(languages: DataFrame) -> DataFrame:
    """The same row from rows of languages that are aggregated already."""
    out = languages.agg(
        F.coalesce(F.sum("files"), F.lit(0).cast("long")).alias("files"), *(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("code", "comment", "blank")),
        F.sum("complexity").alias("complexity"), F.count("*").alias("languages"),
    )
    return with_percentages(out)


def sort_languages(languages: DataFrame, key: str = "total", descending: bool | None = None, top: int | None = None) -> DataFrame:
    """Sorted by key, ties by name; the first top rows, if top is 1 or more."""
    key = key.lower()
    if key not in SORTS:
        raise ValueError(f"unknown sort: {key}")
    descending = key != "name" if descending is None else descending
    col = {"commentpct": F.col("comment_pct"), "name": F.upper("language")}.get(key, F.col(key) if key in languages.columns else F.lit(0))
    out = languages.orderBy(col.desc() if descending else col.asc(), F.upper("language"))
    return out.limit(top) if top and top >= 1 else out


def drop_copies(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): of files with equal hashes the first in scan order stays; null hashes always do.

    The smallest ordinal of each hash is aggregated before it is sent.  Hashes met once need
    no partner, and the others meet their files in COPY_SALTS parts, so that many copies of
    one file are no hot key.
    """
    first = files.where("hash IS NOT NULL").groupBy("hash").agg(F.min(F.struct("scan_ordinal", "path")).alias("_first"), F.count("*").alias("_n"))
    first = first.where("_n > 1").select("hash", "_first", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))).alias("_salt"))
    marked = files.withColumn("_salt", F.pmod(F.xxhash64("path", "scan_ordinal"), F.lit(COPY_SALTS)).cast("int")).join(first, ["hash", "_salt"], "left")
    copy = F.col("_first").isNotNull() & (F.col("scan_ordinal") != F.col("_first.scan_ordinal"))
    kept = marked.where(~copy).select(*files.columns)
    skipped = marked.where(copy).select("path", F.concat(F.lit("duplicate of "), F.col("_first.path")).alias("reason"), "scan_ordinal")
    return kept, skipped


def folder_rollup(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Sums for every folder over all files beneath it ('' is the root); health over files whose language supports it."""
    parts = F.split(F.col(path), "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    able = supports_health(F.col("language"))
    rows = files.select(
        F.explode(folders).alias("folder"), "code", "comment", "blank", "complexity",
        F.when(able, F.col("code")).alias("h_code"), F.when(able, F.col("comment")).alias("h_comment"),
    )
    out = rows.groupBy("folder").agg(
        F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("code", "comment", "blank", "complexity", "h_code", "h_comment")),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    out = out.withColumn("health", health(zero("h_code"), zero("h_comment"), F.col("h_code").isNotNull()))
    return with_percentages(out.drop("h_code", "h_comment"))


def below_threshold(totals: DataFrame, least: float) -> bool | None:
    """Whether the unrounded comment share of all files is below least; None without files."""
    row = totals.select("files", "comment_pct").first()
    return None if not row["files"] else row["comment_pct"] < least
