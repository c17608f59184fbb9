"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans come from three patterns (``BASE``): assignments, access identifiers
and hexadecimal runs, leftmost and without overlap per kind; matches shorter
than the stated length are dropped after matching.  Linking adds weak
candidates (``WEAK``): account identifiers, mixed-case keys and endpoints.  A
weak candidate counts only where a complementary part starts within ``SCOPE``
code points: an identifier or endpoint needs a secret, a key needs an identifier
or an endpoint.  Base spans are parts as well (access: identifier; assign and
hex: secret).

The interval join runs inside the row: parts are merged in order of their
starts, and as parts of one kind do not overlap and have ``MIN_PART`` code points
at least, all partners of a part lie within ``REACH`` places of it.  So the cost
is linear in the number of parts, nothing is shuffled, and no pair is made.
Positions come from prefix sums in four levels.

Null texts count as empty; they, and texts without a match, give zeros, the
digest of no bytes and an empty list.  Every input row gives one result row, so
repeated rows and ties need no rule; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]+)", 1, 16),
)
#: The hex pattern with its length inside: equal matches, as a run is matched whole or not at all, and most words cost nothing.
_SCAN = {"hex": r"([0-9a-f]{16,})"}
SCOPE = 256
MIN_PART = 8
#: Kind, pattern, what a match must contain besides (all of them).
WEAK = (
    ("account", r"([A-Za-z0-9._%+-]{2,64}@[A-Za-z0-9-]{1,63}(?:[.][A-Za-z0-9-]{1,63}){1,4}|(?:user|username|login|account_id|client_id|access_key_id)\x20*[:=]\x20*[A-Za-z0-9_.@-]{4,})", ()),
    ("key", r"([A-Za-z0-9+/_-]{20,})", ("[A-Z]", "[a-z]", "[0-9]")),
    ("endpoint", r"((?:https?|jdbc|postgres|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9./:_?&=@%-]{3,})", ()),
)
KINDS = tuple(k for k, *_ in BASE) + tuple(k for k, *_ in WEAK)
REACH = len(KINDS) * (SCOPE // MIN_PART + 1)
_BLOCK = 64
#: Characters that may stand for blanked places of a text that does not hold them: the noncharacters of Unicode and those of private use.
MASKS = "".join(map(chr, [*range(0xFDD0, 0xFDF0), *(p * 0x10000 + x for p in range(1, 17) for x in (0xFFFE, 0xFFFF)), *range(0xE000, 0xF900)]))


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bind(name: str, value: str, body: str) -> str:
    """SQL of body, where name stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _spans(kind: int, pattern: str) -> str:
    """SQL for array<struct<s, k, n, m>> of all matches of pattern in t, in order; code points.

    Places are sums of the lengths before them, kept for runs of 64, 64^2 and 64^3 matches,
    so that a match costs a bounded number of steps in any text.
    """
    p = _q(pattern)
    total = lambda items: f"aggregate({items}, 0, (a, y) -> a + y)"
    runs = lambda items: f"transform(sequence(0, cast(size({items}) div {_BLOCK} AS int)), b -> {total(f'slice({items}, b * {_BLOCK} + 1, {_BLOCK})')})"

    def upto(items: str, each: int, last: bool = False) -> str:
        """The sum of the runs of ``each`` matches before match i, since the last longer run began."""
        at = f"cast(i div {each} AS int)"
        return total(f"slice({items}, 1, {at})" if last else f"slice({items}, cast(i div {each * _BLOCK} AS int) * {_BLOCK} + 1, {at} % {_BLOCK})")

    place = " + ".join([upto("d3", _BLOCK**3, True), upto("d2", _BLOCK**2), upto("d1", _BLOCK), upto("d0", 1)])
    found = f"transform(m0, (x, i) -> named_struct('s', {place} + char_length(g0[i]), 'k', {kind}, 'n', char_length(x), 'm', x))"
    for name, value in (("d3", runs("d2")), ("d2", runs("d1")), ("d1", runs("d0")), ("d0", "transform(m0, (x, i) -> char_length(g0[i]) + char_length(x))"), ("m0", f"regexp_extract_all(t, {p}, 0)"), ("g0", f"split(t, {p}, -1)")):
        found = _bind(name, value, found)
    empty = "cast(array() AS array<struct<s:int,k:int,n:int,m:string>>)"
    return f"if(t rlike {p}, {found}, {empty})"


def _trim(spans: str) -> str:
    return f"transform({spans}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.s + x.n))"


def find_spans(docs: DataFrame) -> DataFrame:
    """docs with t (the text, '' for null), base and spans: array<struct<s, k, e>> sorted by s, then k."""
    df = docs.withColumn("t", F.coalesce(F.col("text"), F.lit("")))
    for i, (kind, pattern, group, least) in enumerate(BASE):
        spans = _spans(i, _SCAN.get(kind, pattern))
        if kind == "assign":  # the length of its second group; what precedes it holds none of the group's characters but '='
            keep = f"x -> char_length(regexp_extract(x.m, {_q(pattern)}, {group})) >= {least}"
        else:
            keep = f"x -> x.n >= {least}"
        df = df.withColumn(f"_{kind}", F.expr(_trim(f"filter({spans}, {keep})")))
    for i, (kind, pattern, needs) in enumerate(WEAK, len(BASE)):
        tests = "".join(f" AND x.m rlike {_q(n)}" for n in needs)
        df = df.withColumn(f"_{kind}", F.expr(_trim(f"filter({_spans(i, pattern)}, x -> x.n >= {MIN_PART}{tests})")))
    df = df.withColumn("base", F.expr("array_sort(concat(_assign, _access, _hex))"))
    df = df.withColumn("_parts", F.expr("if(size(_account) + size(_key) + size(_endpoint) = 0, base, array_sort(concat(base, _account, _key, _endpoint)))"))
    secret, ident = "(0, 2, 4)", "(1, 3, 5)"
    near = f"slice(_parts, greatest(i - {REACH} + 1, 1), {2 * REACH + 1})"
    linked = f"""exists({near}, q -> abs(q.s - p.s) <= {SCOPE} AND (q.s >= p.e OR q.e <= p.s)
                 AND ((p.k IN {secret} AND q.k IN {ident}) OR (p.k IN {ident} AND q.k IN {secret})))"""
    df = df.withColumn("spans", F.expr(f"if(size(_parts) = size(base), base, filter(_parts, (p, i) -> p.k < {len(BASE)} OR {linked}))"))
    return df.drop("_parts", *(f"_{k}" for k in KINDS))


def _text(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')"


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    df = find_spans(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) AS bigint)").alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)]
    return df.select("doc_id", *counts, F.sha2(F.expr(_text("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_text("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns, with every span of its text replaced by mark, and n_chars set anew where text changed.

    Kinds are blanked one after another to equal length, so that positions stay;
    then each blanked run becomes one mark.  The blank is the first of ``MASKS`` that
    the text does not hold; only in a text that holds all of these 6,464 characters
    would the first of them be taken for blanks.
    """
    # all columns travel in one struct, whatever their names
    df = find_spans(docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), docs["text"]))
    masks = f"split({_q(MASKS)}, '')"  # looked at only in texts that hold the first of them
    df = df.withColumn("_mask", F.expr(f"if(instr(t, '{MASKS[0]}') = 0, '{MASKS[0]}', coalesce(try_element_at(filter({masks}, c -> c <> '' AND instr(t, c) = 0), 1), '{MASKS[0]}'))"))
    for i in range(len(KINDS)):
        own = f"filter(spans, x -> x.k = {i})"
        blank = f"""transform(array({own}), c -> concat(
            array_join(transform(c, (x, j) -> concat(
              substring(t, if(j = 0, 0, c[j - 1].e) + 1, x.s - if(j = 0, 0, c[j - 1].e)), repeat(_mask, x.e - x.s))), ''),
            substring(t, c[size(c) - 1].e + 1)))[0]"""
        df = df.withColumn("t", F.expr(f"if(exists(spans, x -> x.k = {i}), {blank}, t)"))
    hit = F.size("spans") > 0
    text = F.when(hit, F.regexp_replace("t", F.concat("_mask", F.lit("+")), F.lit(mark.replace("\\", "\\\\").replace("$", "\\$")))).otherwise(F.col("text"))

    def column(name: str):
        old = F.col(f"_row.`{name}`")
        if name == "text":
            return text.alias(name)
        if name == "n_chars":
            return F.when(hit, F.char_length(text).cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return df.select(*map(column, docs.columns))


def _duck_spans(kind: int, pattern: str, keep: str) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""list_transform(list_filter(list_transform(range(1, len(regexp_extract_all(t, {p}, 0)) + 1),
        lambda i: {{'s': coalesce(list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))), 0)::BIGINT
                       + coalesce(list_sum(list_transform(regexp_extract_all(t, {p}, 0)[1:i-1], lambda x: length(x))), 0)::BIGINT,
                   'k': {kind}, 'm': regexp_extract_all(t, {p}, 0)[i]}}), lambda x: {keep}),
        lambda x: {{'s': x.s, 'k': x.k, 'e': x.s + length(x.m)}})"""


def oracle() -> str:
    cols = []
    for i, (kind, pattern, group, least) in enumerate(BASE):
        p = pattern.replace("'", "''")
        length = f"length(regexp_extract(x.m, '{p}', 2))" if kind == "assign" else "length(x.m)"
        cols.append(f"CASE WHEN regexp_matches(t, '{_SCAN.get(kind, pattern).replace(chr(39), chr(39) * 2)}') THEN {_duck_spans(i, _SCAN.get(kind, pattern), f'{length} >= {least}')} ELSE [] END AS _{kind}")
    for i, (kind, pattern, needs) in enumerate(WEAK, len(BASE)):
        p = pattern.replace("'", "''")
        tests = "".join(f" AND regexp_matches(x.m, '{n}')" for n in needs)
        cols.append(f"CASE WHEN regexp_matches(t, '{p}') THEN {_duck_spans(i, pattern, f'length(x.m) >= {MIN_PART}{tests}')} ELSE [] END AS _{kind}")
    names = ", ".join(f"'{k}'" for k in KINDS)
    text = lambda c: f"array_to_string(list_transform({c}, lambda x: concat([{names}][x.k + 1], ':', x.s, ':', x.e)), ',')"
    counts = ", ".join(f"len(list_filter(base, lambda x: x.k = {i}))::BIGINT AS n_{k}" for i, (k, *_) in enumerate(BASE))
    return f"""
WITH d AS (SELECT doc_id::BIGINT AS doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {', '.join(cols)} FROM d),
b AS (SELECT doc_id, list_sort(_assign || _access || _hex) AS base, list_sort(_assign || _access || _hex || _account || _key || _endpoint) AS parts FROM f),
s AS (SELECT doc_id, base, list_filter(parts, lambda p: p.k < 3 OR len(list_filter(parts, lambda q: abs(q.s - p.s) <= {SCOPE} AND (q.s >= p.e OR q.e <= p.s)
      AND ((p.k IN (0, 2, 4) AND q.k IN (1, 3, 5)) OR (p.k IN (1, 3, 5) AND q.k IN (0, 2, 4))))) > 0) AS spans FROM b)
SELECT doc_id, {counts}, sha256({text('base')}) AS base_sha256, {text('spans')} AS spans FROM s"""
