"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import canonical, distinctive, mixing, neardup, neighbors, packing, termcounts, tokens, toxicity
from corvane.plans.materialize import materialize


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# 1. How distinctive a term is per record


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every corpus row with its score."""
    scores = distinctive.distinctive_terms(_t(spark, d, "sample_corpus"), key="row_id", texts=["title", "abstract"])
    return scores.select(F.col("record").alias("row_id"), "term", "tf", "df", F.round("score", 6).alias("score"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    scores = distinctive.distinctive_terms(_t(spark, d, "sample_corpus"), key="row_id", texts=["title", "abstract"])
    return scores.filter((F.col("tf") >= 3) & F.col("df").between(2, 8)).select(F.col("record").alias("row_id"), "term")


_SQL_JOINT = """
WITH bag AS (
  SELECT row_id, unnest(list_filter(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[a-z0-9]+'), lambda t: length(t) >= 3 AND regexp_matches(t, '[a-z]'))) AS term FROM sample_corpus),
joint AS (SELECT row_id, term, count(*) AS tf FROM bag GROUP BY ALL),
marginal AS (SELECT term, sum(tf) AS c, count(*) AS df FROM joint GROUP BY term),
context AS (SELECT row_id, sum(tf) AS n FROM joint GROUP BY row_id),
z AS (SELECT sum(pow(n, 0.75)) AS z FROM context)
"""

SQL_P1_SCORES = (
    _SQL_JOINT
    + """SELECT row_id, term, tf, df, round(greatest(0.0, ln(tf * z / (c * pow(n, 0.75)))), 6) AS score
FROM joint JOIN marginal USING (term) JOIN context USING (row_id), z"""
)
SQL_P1_FOUND = _SQL_JOINT + "SELECT row_id, term FROM joint JOIN marginal USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 8"


# 2. Visually identical text with different characters


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.lookalike_pairs(_t(spark, d, "sample_corpus"), key="row_id", fields=["abstract", "trial_id"])


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every abstract and trial id."""
    return canonical.canonical_values(_t(spark, d, "sample_corpus"), key="row_id", fields=["abstract", "trial_id"]).select("text_field", "row_id", "canonical")


def _sql_canonical(x: str) -> str:
    """The visible differences of these tables in SQL: one character list against another, then composed."""
    plain = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {chr(c): " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 9)}
    plain |= {chr(c): "-" for c in canonical.HYPHENS} | {"\u00b5": "\u03bc"} | canonical.LOOK_ALIKES
    out = f"regexp_replace({x}, '[\u00ad\u034f\u061c\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]', '', 'g')"
    for sign, letters in {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\u2160": "I", "\u2161": "II", "\u2162": "III", "\u2163": "IV", "\u2164": "V"}.items():
        out = f"replace({out}, '{sign}', '{letters}')"
    old, new = ("".join(p).replace("'", "''") for p in zip(*plain.items(), strict=True))
    return f"trim(nfc_normalize(translate({out}, '{old}', '{new}')), e' \\n\\r')"


SQL_P2_FOUND = f"""
WITH v AS (SELECT 'abstract' AS text_field, row_id, abstract AS stored FROM sample_corpus WHERE abstract IS NOT NULL UNION ALL SELECT 'trial_id', row_id, trial_id FROM sample_corpus WHERE trial_id IS NOT NULL),
c AS (SELECT *, {_sql_canonical('stored')} AS c FROM v)
SELECT a.text_field, a.row_id AS row_id_a, b.row_id AS row_id_b FROM c a JOIN c b ON a.text_field = b.text_field AND a.c = b.c AND a.row_id < b.row_id AND a.stored <> b.stored"""


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each visible form: the class is named after its smallest row, with the number of its rows and of ways it is written."""
    forms = materialize(canonical.canonical_values(_t(spark, d, "sample_corpus"), key="row_id", fields=["abstract", "trial_id"]), "forms")
    return canonical.lookalike_classes(forms)


SQL_P2_CLASSES = f"""
WITH v AS (SELECT 'abstract' AS text_field, row_id, abstract AS stored FROM sample_corpus WHERE abstract IS NOT NULL UNION ALL SELECT 'trial_id', row_id, trial_id FROM sample_corpus WHERE trial_id IS NOT NULL),
c AS (SELECT *, {_sql_canonical('stored')} AS c FROM v)
SELECT text_field, row_id, min(row_id) OVER w AS class_id, count(*) OVER w AS "rows", (SELECT count(DISTINCT stored) FROM c x WHERE x.text_field = c.text_field AND x.c = c.c) AS written FROM c WINDOW w AS (PARTITION BY text_field, c)"""


SQL_P2_CANONICAL = f"""
SELECT 'abstract' AS text_field, row_id, {_sql_canonical('abstract')} AS canonical FROM sample_corpus WHERE abstract IS NOT NULL
UNION ALL SELECT 'trial_id', row_id, {_sql_canonical('trial_id')} FROM sample_corpus WHERE trial_id IS NOT NULL"""


# 4. Frequency of every distinct value or term


def _abstract_terms():
    return distinctive.terms_of(F.col("abstract"))


def _additions(spark: SparkSession, d: str) -> DataFrame:
    corpus = _t(spark, d, "sample_corpus").filter(F.col("abstract").isNotNull())
    maps = _t(spark, d, "sif_weights").filter(F.col("weights").isNotNull())
    return termcounts.as_additions([("abstract", corpus, _abstract_terms()), ("weights", maps, F.map_keys("weights"))])


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, records and mark of every term, after merging all records into an empty store."""
    store = termcounts.TermCountStore(spark)
    store.merge(_additions(spark, d), "load")
    return termcounts.marked(store.counts()).select(F.col("field").alias("text_field"), "term", "occurrences", "records", "mark")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_counts(spark, d).filter(F.col("mark").isNotNull()).select("text_field", "term", "mark")


def p4_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same abstract counts reached in three batches.

    The first holds, for every row, the title in place of the abstract; the
    second changes each to the abstract; the third deletes the rows received
    later than 30 days after ``date_added``.
    """
    corpus = _t(spark, d, "sample_corpus").filter(F.col("abstract").isNotNull())
    late = F.coalesce(F.datediff("received_at", F.col("date_added").try_cast("date")) > 30, F.lit(False))
    field, none = F.lit("abstract").alias("field"), F.lit(None).cast("array<string>")
    store = termcounts.TermCountStore(spark)
    store.merge(corpus.select(field, none.alias("before"), distinctive.terms_of(F.col("title")).alias("after")), "titles")
    store.merge(corpus.select(field, distinctive.terms_of(F.col("title")).alias("before"), _abstract_terms().alias("after")), "abstracts")
    store.merge(corpus.filter(late).select(field, _abstract_terms().alias("before"), none.alias("after")), "withdrawn")
    return termcounts.marked(store.counts()).select("term", "occurrences", "records", "mark")


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same abstract counts after all rows arrived in ten small batches."""
    corpus = materialize(_t(spark, d, "sample_corpus").filter(F.col("abstract").isNotNull()).select(F.pmod(F.xxhash64("row_id"), F.lit(10)).alias("batch"), _abstract_terms().alias("after")), "arrived")
    field, none = F.lit("abstract").alias("field"), F.lit(None).cast("array<string>").alias("before")
    store = termcounts.TermCountStore(spark)
    for i in range(10):
        store.merge(corpus.filter(F.col("batch") == i).select(field, none, "after"), f"batch {i}")
    return termcounts.marked(store.counts()).select("term", "occurrences", "records", "mark")


def _sql_counts(records: str) -> str:
    return f"""
WITH records AS ({records}),
n AS (SELECT text_field, count(*) AS n FROM records GROUP BY text_field),
tf AS (SELECT text_field, rec, term, count(*) AS tf FROM (SELECT text_field, rec, unnest(terms) AS term FROM records) GROUP BY ALL),
counts AS (SELECT text_field, term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS records FROM tf GROUP BY ALL),
marked AS (SELECT text_field, term, occurrences, counts.records, CASE WHEN counts.records <= 2 THEN 'rare' WHEN counts.records >= n * 0.4 THEN 'common' END AS mark FROM counts JOIN n USING (text_field))
"""


_SQL_TERMS = "list_filter(regexp_extract_all(lower(abstract), '[a-z0-9]+'), lambda t: length(t) >= 3 AND regexp_matches(t, '[a-z]'))"
_SQL_RECORDS = f"""SELECT 'abstract' AS text_field, row_id AS rec, {_SQL_TERMS} AS terms FROM sample_corpus WHERE abstract IS NOT NULL
UNION ALL SELECT 'weights', weight_id, map_keys(weights) FROM sif_weights WHERE weights IS NOT NULL"""
SQL_P4_COUNTS = _sql_counts(_SQL_RECORDS) + "SELECT text_field, term, occurrences, records, mark FROM marked"
SQL_P4_FOUND = _sql_counts(_SQL_RECORDS) + "SELECT text_field, term, mark FROM marked WHERE mark IS NOT NULL"
SQL_P4_BATCHES = _sql_counts(_SQL_RECORDS) + "SELECT term, occurrences, records, mark FROM marked WHERE text_field = 'abstract'"
SQL_P4_INCREMENTAL = (
    _sql_counts(
        f"""SELECT 'abstract' AS text_field, row_id AS rec, {_SQL_TERMS} AS terms FROM sample_corpus
WHERE abstract IS NOT NULL AND NOT coalesce(date_diff('day', try_cast(date_added AS DATE), CAST(received_at AS DATE)) > 30, false)"""
    )
    + "SELECT term, occurrences, records, mark FROM marked"
)

# 5. Most similar vectors for every vector

VECTOR_WIDTH, NEIGHBORS = 64, 5


def _near(spark: SparkSession, d: str, **more) -> DataFrame:
    return neighbors.top_neighbors(_t(spark, d, "document_index"), key="vec_id", vector="vectors", width=VECTOR_WIDTH, k=NEIGHBORS, **more)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = _near(spark, d, floor=0.9, wanted_recall=1.0)
    return near.select(F.least("id", "neighbor").alias("vec_id_a"), F.greatest("id", "neighbor").alias("vec_id_b")).distinct()


def p5_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar vectors of every vector whose id is divisible by 20, of all vectors."""
    asked = _t(spark, d, "document_index").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("id"))
    return _near(spark, d, queries=asked).select(F.col("id").alias("vec_id"), "neighbor", F.round("similarity", 6).alias("similarity"))


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Leaf visits and recall of the index behind p5_neighbors, on queries that weren't calibrated on."""
    units = materialize(neighbors.unit_vectors(_t(spark, d, "document_index"), key="vec_id", vector="vectors", width=VECTOR_WIDTH), "units")
    reps = materialize(neighbors.equal_vector_classes(units).reps, "reps")
    index, placed = neighbors.build_index(reps, width=VECTOR_WIDTH, k=NEIGHBORS)
    return neighbors.measured_recall(index, placed, width=VECTOR_WIDTH, k=NEIGHBORS)


# every pair is compared: fit for the small tables this is checked on
SQL_P5_FOUND = """
WITH v AS (SELECT vec_id, CAST(vectors AS DOUBLE[]) AS v FROM document_index WHERE len(vectors) = 64 AND len(list_filter(vectors, lambda x: x IS NULL OR isnan(x))) = 0),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v WHERE list_dot_product(v, v) > 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) / a.n / b.n AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id),
r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS r FROM s)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE r <= 5 AND s >= 0.9"""


# 6. Near-duplicate records with small edits


def _near_duplicates(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    text = F.when(F.col("abstract").isNotNull(), F.concat_ws(" ", F.coalesce("title", F.lit("")), "abstract"))
    return neardup.NearDuplicates(_t(spark, d, "sample_corpus"), key="row_id", text=text, shingle=3, threshold=0.5, least_words=20)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _near_duplicates(spark, d).pairs().select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class, group and number of links of every corpus row that takes part."""
    return _near_duplicates(spark, d).groups().withColumnRenamed("id", "row_id")


SQL_P6_FOUND = """
WITH w AS (SELECT row_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || abstract), '[a-z0-9]+') AS w FROM sample_corpus WHERE abstract IS NOT NULL),
t AS (SELECT DISTINCT row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM w, unnest(range(1, len(w) - 1)) u(i) WHERE len(w) >= 20),
n AS (SELECT row_id, count(*) AS n FROM t GROUP BY row_id),
both_ AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.row_id < b.row_id GROUP BY ALL)
SELECT a AS row_id_a, b AS row_id_b FROM both_ JOIN n x ON x.row_id = a JOIN n y ON y.row_id = b WHERE 2 * c >= x.n + y.n - c"""


SQL_P6_GROUPS = """
WITH RECURSIVE w AS (SELECT row_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || abstract), '[a-z0-9]+') AS w FROM sample_corpus WHERE abstract IS NOT NULL),
cls AS (SELECT row_id, w, min(row_id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id FROM w WHERE len(w) >= 20),
t AS (SELECT DISTINCT row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM cls, unnest(range(1, len(w) - 1)) u(i) WHERE row_id = class_id),
n AS (SELECT row_id, count(*) AS n FROM t GROUP BY row_id),
both_ AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.row_id <> b.row_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.row_id = a JOIN n y ON y.row_id = b WHERE 2 * c >= x.n + y.n - c),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT row_id, class_id, coalesce(least(class_id, g), class_id) AS group_id, coalesce(k, 0) AS links FROM cls
LEFT JOIN (SELECT a, min(b) AS g FROM reach GROUP BY a) r ON r.a = class_id LEFT JOIN (SELECT a, count(*) AS k FROM link GROUP BY a) l ON l.a = class_id"""


# 7. Filling fixed-capacity containers with items


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Container of every piece of every document, for every capacity."""
    sized = tokens.with_tokens(_t(spark, d, "documents"), key="doc_id", text="text")
    return packing.pack(sized, _t(spark, d, "pack_capacities"), key="doc_id")


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    """Containers and fill of every capacity."""
    return packing.usage(p7_packed(spark, d), _t(spark, d, "pack_capacities"))


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing: every document placed whole, no container over its capacity, no cut that isn't needed."""
    caps = _t(spark, d, "pack_capacities").select("capacity_id", "capacity_tokens").distinct()
    packed = materialize(p7_packed(spark, d).join(F.broadcast(caps), "capacity_id"), "packed")  # four capacities
    docs = packed.groupBy("capacity_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece").alias("pieces"), F.sum("tokens").alias("t"), F.max("capacity_tokens").alias("c"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("t") / F.col("c")))
    docs = docs.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when((F.col("pieces") != F.col("n")) | (F.col("pieces") != needed), 1).otherwise(0)).cast("bigint").alias("badly_cut"))
    full = packed.filter("container > 0").groupBy("capacity_id", "container").agg(F.sum("tokens").alias("t"), F.max("capacity_tokens").alias("c"))
    full = full.groupBy("capacity_id").agg(F.sum(F.when(F.col("t") > F.col("c"), 1).otherwise(0)).cast("bigint").alias("overfull"), (F.max("container") - F.count(F.lit(1))).alias("empty"))
    return docs.join(full, "capacity_id")


SQL_P7_CHECKED = "SELECT capacity_id, (SELECT count(*) FROM documents) AS documents, 0 AS badly_cut, 0 AS overfull, 0 AS empty FROM pack_capacities"


# 8. Mixing sources to target weights


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = materialize(tokens.with_tokens(_t(spark, d, "documents"), key="doc_id", text="text", keep=("source",)), "sized")
    rates = mixing.repetition_rates(sized, _t(spark, d, "mix_targets"))
    return mixing.mixture(sized, rates, key="doc_id"), rates


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document in the mixture."""
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.reached_shares(*_mixed(spark, d))


def p8_by_length(spark: SparkSession, d: str) -> DataFrame:
    """The mixture with sizes in characters in the place of tokens, which SQL can count as well."""
    sized = _t(spark, d, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("tokens"))
    return mixing.mixture(sized, mixing.repetition_rates(sized, _t(spark, d, "mix_targets")), key="doc_id")


SQL_P8_BY_LENGTH = f"""
WITH sized AS (SELECT doc_id, source, coalesce(length(text), 0) AS tokens FROM documents),
have AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(sum(tokens), 0) AS have FROM mix_targets m LEFT JOIN sized s ON s.source = m.source GROUP BY ALL),
rates AS (SELECT source, CASE WHEN have > 0 AND target_share > 0 THEN least(target_share * CAST((SELECT sum(have) FROM have) AS DOUBLE) / CAST(have AS DOUBLE), CAST(max_repeats AS DOUBLE)) ELSE 0.0 END AS rate FROM have),
drawn AS (SELECT s.*, rate, CAST('0x' || substring(md5('{mixing.SEED}:' || doc_id), 1, 10) AS BIGINT) / 1099511627776.0 AS draw FROM sized s JOIN rates USING (source))
SELECT doc_id, source, tokens, c AS "copy" FROM drawn, unnest(range(1, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 2 ELSE 1 END)) u(c)"""


# 9. Abusive, hateful or sexual content


def _scored(spark: SparkSession, d: str, fresh: bool) -> DataFrame:
    documents = _t(spark, d, "documents")
    texts, labels, totals = toxicity.verdicts(_t(spark, d, "doc_reviews"), documents)
    model = toxicity.trained(texts, labels, totals=totals, fresh=fresh)
    return toxicity.score(documents, model, keep=("source",))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score and category of every document, by a model fitted anew."""
    return _scored(spark, d, True)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).filter("flagged").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of flagged documents per source, by the model of these verdicts if one is at hand."""
    return toxicity.rates(_scored(spark, d, False))


QUERIES = {
    "p1_found": p1_found, "p1_scores": p1_scores, "p2_found": p2_found, "p2_canonical": p2_canonical, "p2_classes": p2_classes, "p4_found": p4_found, "p4_counts": p4_counts, "p4_incremental": p4_incremental, "p4_batches": p4_batches, "p5_found": p5_found, "p5_neighbors": p5_neighbors, "p5_recall": p5_recall, "p6_found": p6_found, "p6_groups": p6_groups, "p7_packed": p7_packed, "p7_usage": p7_usage, "p7_checked": p7_checked, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_by_length": p8_by_length, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates,
}
SQL = {"p1_found": SQL_P1_FOUND, "p1_scores": SQL_P1_SCORES, "p2_found": SQL_P2_FOUND, "p2_canonical": SQL_P2_CANONICAL, "p2_classes": SQL_P2_CLASSES, "p7_checked": SQL_P7_CHECKED, "p8_by_length": SQL_P8_BY_LENGTH, "p5_found": SQL_P5_FOUND, "p6_found": SQL_P6_FOUND, "p6_groups": SQL_P6_GROUPS, "p4_found": SQL_P4_FOUND, "p4_counts": SQL_P4_COUNTS, "p4_incremental": SQL_P4_INCREMENTAL, "p4_batches": SQL_P4_BATCHES}
