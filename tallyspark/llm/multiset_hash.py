"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its paragraphs (pieces between line feeds).  Every
paragraph is hashed to a wide vector and the vectors are added modulo powers of
two, so the order of paragraphs does not matter and a paragraph can be added to or
taken from a fingerprint without the rest of the text (``combine``).  The vector
of a paragraph has two parts:

* ``exact``: eight lanes modulo 2^60 from two SHA-256 of the paragraph; they
  decide equality;
* ``like``: 120 counters from the MD5s of its sentences, each a long of its own.
  Each sentence adds 0 or 1 to a counter, by one bit.  Centred on half the number
  of sentences the counters are a tug-of-war sketch, and the cosine of two
  sketches estimates how much two texts share.

Sentences are counted four counters to a word, ``RUN`` sentences at a time, so that
no counter carries into the next.  In its text form a fingerprint has the counters
four to a word modulo 2^60, as in the SQL; above ``RUN`` sentences that form does not
give the counters back, and likeness is taken from the counters, not from it.

Null texts count as empty.  An empty text is one empty paragraph without
sentences; two texts without sentences are alike (1), one with and one without
are not (0).  Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT_LANES = 8
#: Bits of a lane; below 63, so that sums of two never overflow a long.
BITS = 60
MODULUS_MASK = (1 << BITS) - 1
#: One bit in every 15: four counters in a word.
FIELDS = sum(1 << (15 * i) for i in range(4))
SHIFTS = 15
#: Most sentences that 15 bits count.
RUN = (1 << 15) - 1
#: Ends of sentences and paragraphs.
SENTENCE_END = r"[.!?]+[ \n]+|\n+"
#: Rows of a bucket in next_document(), and the most buckets.
BUCKET_ROWS, MAX_BUCKETS, MAX_BOUNDS = 128, 1 << 20, 256


def _sum(items: str) -> str:
    return f"aggregate({items}, 0L, (a, x) -> (a + x) & {MODULUS_MASK}L)"


def _counters(hashes: str) -> str:
    """SQL for 60 counters of the hashes: those of word j at 4 * j."""
    packed = lambda run: f"transform(sequence(0, {SHIFTS - 1}), j -> aggregate({run}, 0L, (a, h) -> a + (shiftright(h, j) & {FIELDS}L)))"
    single = lambda run: f"flatten(transform({packed(run)}, x -> transform(array(0, 15, 30, 45), b -> shiftright(x, b) & {RUN}L)))"
    runs = f"transform(sequence(1, (size({hashes}) - 1) div {RUN}), i -> slice({hashes}, cast(i * {RUN} + 1 AS int), {RUN}))"
    more = f"aggregate({runs}, {single(f'slice({hashes}, 1, {RUN})')}, (total, run) -> zip_with(total, {single('run')}, (x, y) -> x + y))"
    return f"if(size({hashes}) <= {RUN}, {single(hashes)}, {more})"


def fingerprint_sql(text: str) -> str:
    """SQL for struct<n, m, exact array<long>, like array<long>> of the text expression."""
    word = lambda h, at: f"cast(conv(substring({h}, {at}, 15), 16, 10) AS bigint)"
    return f"""transform(array(struct(
        transform(split({text}, '\\n', -1), p -> concat(sha2(cast(p AS binary), 256), sha2(cast(concat('+', p) AS binary), 256))) AS ps,
        transform(filter(split({text}, '{SENTENCE_END.replace(chr(92), chr(92) * 2)}', -1), x -> x <> ''), x -> md5(cast(x AS binary))) AS ss)), c ->
      transform(array(struct(c.ps AS ps, transform(c.ss, h -> {word('h', 1)}) AS h1, transform(c.ss, h -> {word('h', 17)}) AS h2)), c2 ->
        named_struct(
          'n', cast(size(c2.ps) AS bigint),
          'm', cast(size(c2.h1) AS bigint),
          'exact', transform(sequence(0, {EXACT_LANES - 1}), j -> {_sum(f"transform(c2.ps, h -> {word('h', f'j * 16 + 1')})")}),
          'like', concat({_counters('c2.h1')}, {_counters('c2.h2')})
        ))[0])[0]"""


def combine_sql(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of the paragraphs of a with those of b added (sign 1) or taken away (-1)."""
    op = "+" if sign > 0 else "-"
    lanes = lambda f: f"zip_with({a}.{f}, {b}.{f}, (x, y) -> (x {op} y) & {MODULUS_MASK}L)"
    counters = f"zip_with({a}.like, {b}.like, (x, y) -> x {op} y)"
    return f"named_struct('n', {a}.n {op} {b}.n, 'm', {a}.m {op} {b}.m, 'exact', {lanes('exact')}, 'like', {counters})"


def text_sql(fp: str) -> str:
    at = lambda k: f"shiftleft({fp}.like[4 * j + {k}], {15 * k})"
    words = f"transform(sequence(0, {2 * SHIFTS - 1}), j -> ({' + '.join(map(at, range(4)))}) & {MODULUS_MASK}L)"
    return f"concat({fp}.n, ':', {fp}.m, ':', array_join(transform(concat({fp}.exact, {words}), x -> lower(hex(x))), '.'))"


def _centred(fp: str) -> str:
    return f"transform({fp}.like, z_x -> 2 * z_x - {fp}.m)"


def likeness_sql(a: str, b: str) -> str:
    """Cosine of the two sketches, 0 to 1; 1 for equal fingerprints."""
    dot = lambda x, y: f"cast(aggregate(zip_with({x}, {y}, (z_u, z_v) -> z_u * z_v), 0L, (z_s, z_t) -> z_s + z_t) AS double)"
    return f"""transform(array(struct({_centred(a)} AS u, {_centred(b)} AS v)), z_c ->
        if({a}.m = 0 OR {b}.m = 0, if({a}.m = {b}.m, 1D, 0D),
          transform(array(struct({dot('z_c.u', 'z_c.u')} AS uu, {dot('z_c.v', 'z_c.v')} AS vv, {dot('z_c.u', 'z_c.v')} AS uv)), z_d ->
            if(z_d.uu = 0 OR z_d.vv = 0, 0D, greatest(0D, least(1D, round(z_d.uv / sqrt(z_d.uu * z_d.vv), 6)))))[0]))[0]"""


def _bucket(docs: DataFrame) -> tuple[str, int]:
    """SQL that deals doc_id to buckets of neighbouring ids, and their number.

    Quantiles of the ids (MAX_BOUNDS at most) and a linear rule between two of them,
    so that unevenly spread ids still give buckets of about equal size.
    """
    got = docs.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if not got["n"] or got["lo"] == got["hi"]:
        return "0L", 1
    buckets = max(1, min(MAX_BUCKETS, got["n"] // BUCKET_ROWS))
    bounds = max(1, min(MAX_BOUNDS, buckets // 4))
    inner = []
    if bounds > 1:
        at = [i / bounds for i in range(1, bounds)]
        inner = docs.agg(F.percentile_approx("doc_id", at, 4 * MAX_BOUNDS).alias("q")).first()["q"]
    edges = sorted({got["lo"], *inner, got["hi"] + 1})
    each = max(1, buckets // (len(edges) - 1))

    def pick(lo: int, hi: int) -> str:  # edges[lo] <= doc_id < edges[hi]
        if hi - lo == 1:
            width = max(1, -(-(edges[hi] - edges[lo]) // each))
            return f"({lo * each}L + (doc_id - {edges[lo]}L) div {width}L)"
        mid = (lo + hi) // 2
        return f"if(doc_id < {edges[mid]}L, {pick(lo, mid)}, {pick(mid, hi)})"

    return pick(0, len(edges) - 1), each * (len(edges) - 1)


def next_document(docs: DataFrame) -> DataFrame:
    """doc_id, t, fp, next_t, next_fp: each document beside the next in descending doc_id; the last beside the first.

    docs: doc_id, t.  Ties of doc_id go by text, descending; rows with a null doc_id
    come last.  Texts move once: buckets of neighbouring ids are sorted each on
    their own; only the first document of every bucket is sent to the bucket above.
    """
    bucket, n = _bucket(docs)
    dealt = docs.withColumn("b", F.coalesce(F.expr(bucket).cast("long"), F.lit(-1).cast("long")))
    heads = dealt.groupBy("b").agg(F.max("doc_id").alias("doc_id"))
    # heads has a row for each bucket, MAX_BUCKETS + 1 at most: small enough to order in one task and to broadcast
    ranked = heads.selectExpr("b", "doc_id AS head_id", "lag(b) OVER (ORDER BY b) AS below_b", "lag(doc_id) OVER (ORDER BY b) AS below_id", "max(b) OVER () AS top_b", "max_by(doc_id, b) OVER () AS top_id")
    link = ranked.selectExpr("b", "coalesce(below_b, top_b) AS head_b", "if(below_b IS NULL, top_id, below_id) AS want_id")
    texts = (
        docs.join(F.broadcast(link.select("want_id").distinct()), docs["doc_id"].eqNullSafe(F.col("want_id")))
        .groupBy("want_id").agg(F.max("t").alias("t"))
    )
    # the first document of the bucket below is one more row, the last of its bucket, so that nothing is joined afterwards
    ends = link.join(texts, link["want_id"].eqNullSafe(texts["want_id"])).select(F.lit(None).cast("long").alias("doc_id"), "t", "b", F.lit(True).alias("end"))
    df = dealt.withColumn("end", F.lit(False)).unionByName(ends).withColumn("fp", F.expr(fingerprint_sql("t")))
    over = "OVER (PARTITION BY b ORDER BY end, doc_id DESC NULLS LAST, t DESC)"
    return df.selectExpr("doc_id", "t", "fp", f"lead(t) {over} AS next_t", f"lead(fp) {over} AS next_fp", "end").where("NOT end").drop("end")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("t"))
    df = next_document(own).withColumn("n_chars", F.char_length("t").cast("long"))
    df = df.withColumn("half", F.expr("cast(n_chars div 2 AS int)"))
    df = df.withColumn("edited", F.expr("concat(substring(t, 1, cast(n_chars AS int) - half), substring(next_t, 1, half))"))
    df = df.withColumn("efp", F.expr(fingerprint_sql("edited")))
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(text_sql("fp")).alias("fingerprint"), F.expr(text_sql("efp")).alias("edited_fingerprint"),
        F.expr(likeness_sql("fp", "efp")).alias("near_edited"), F.expr(likeness_sql("fp", "next_fp")).alias("near_next"),
    )


def oracle() -> str:
    m = MODULUS_MASK
    word = lambda h, at: f"('0x' || substr({h}, {at}, 15))::BIGINT"

    def parts(t: str, p: str) -> str:
        return f"""list_transform(string_split({t}, chr(10)), lambda x: sha256(x) || sha256('+' || x)) AS {p}_ps,
            list_transform(list_filter(string_split_regex({t}, '{SENTENCE_END}'), lambda x: x <> ''), lambda x: md5(x)) AS {p}_ss"""

    def like(p: str) -> str:
        one = lambda at: f"list_transform(range(0, {SHIFTS}), lambda j: coalesce(list_sum(list_transform({p}_ss, lambda h: ({word('h', at)} >> j) & {FIELDS})), 0)::HUGEINT % {m + 1})"
        exact = f"list_transform(range(0, {EXACT_LANES}), lambda j: list_sum(list_transform({p}_ps, lambda h: {word('h', 'j * 16 + 1')}))::HUGEINT % {m + 1})"
        return f"{one(1)} || {one(17)} AS {p}_like, {exact} AS {p}_exact"

    centred = lambda p: f"flatten(list_transform({p}_like, lambda x: list_transform([0, 15, 30, 45], lambda b: 2 * ((x::BIGINT >> b) & 32767) - len({p}_ss))))"
    dot = lambda a, b: f"list_sum(list_transform(range(1, 121), lambda i: {a}[i] * {b}[i]))::DOUBLE"
    near = lambda a, b: f"CASE WHEN len({a}_ss) = 0 OR len({b}_ss) = 0 THEN CASE WHEN len({a}_ss) = len({b}_ss) THEN 1.0 ELSE 0.0 END WHEN {dot(f'{a}_c', f'{a}_c')} = 0 OR {dot(f'{b}_c', f'{b}_c')} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, round({dot(f'{a}_c', f'{b}_c')} / sqrt({dot(f'{a}_c', f'{a}_c')} * {dot(f'{b}_c', f'{b}_c')}), 6))) END::DOUBLE"
    text = lambda p: f"concat(len({p}_ps), ':', len({p}_ss), ':', array_to_string(list_transform({p}_exact || {p}_like, lambda x: format('{{:x}}', x::BIGINT)), '.'))"
    return f"""
WITH d AS (SELECT doc_id::BIGINT AS doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n_chars, coalesce(lead(t) OVER (ORDER BY doc_id DESC NULLS LAST, t DESC), first_value(t) OVER (ORDER BY doc_id DESC NULLS LAST, t DESC)) AS x FROM d),
e AS (SELECT *, substr(t, 1, n_chars - n_chars // 2) || substr(x, 1, n_chars // 2) AS y FROM n),
p AS (SELECT doc_id, n_chars, y, {parts('t', 'a')}, {parts('y', 'e')}, {parts('x', 'x')} FROM e),
l AS (SELECT *, {like('a')}, {like('e')}, {like('x')} FROM p),
c AS (SELECT *, {centred('a')} AS a_c, {centred('e')} AS e_c, {centred('x')} AS x_c FROM l)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(y) AS edited_sha256, {text('a')} AS fingerprint, {text('e')} AS edited_fingerprint, {near('a', 'e')} AS near_edited, {near('a', 'x')} AS near_next FROM c"""
