"""Union of rankings, identifier lookup and negation, over a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.rank import DIGITS

RRF_K, KEYWORD_WEIGHT = 60, 1.5

#: Words that negate what follows them.
NEGATION_CUES = "not without excluding except lacking absent".split()
#: Words that end a negated span.
SPAN_ENDS = "but and or with however although versus".split()
#: Words that tell of avoiding a thing, not of having it.
AVOIDANCE_CUES = """
reduce reduces reduced reducing reduction decrease decreases decreased decreasing prevent prevents prevented preventing
prevention avoid avoids avoided avoiding avoidance lower lowers lowering minimise minimize spare obviate obviates delay
delays delaying risk need needing likelihood probability eligible
""".split()
MAX_SPAN, MIN_SPAN, LOOK_BACK, DEPTH = 5, 2, 6, 3
#: Codes that one call looks for, at most.
MOST_CODES = 1000


def rrf_union(embedding: DataFrame, keyword: DataFrame, *, k: int = RRF_K, keyword_weight: float = KEYWORD_WEIGHT, doc: str = "doc_id") -> DataFrame:
    """(``query_id``, doc, ``score``, ``found_by``, ``rank``): weighted reciprocal-rank fusion.

    Ties go to documents both runs found, then to the keyword run's, then to
    the smaller id. One aggregation over the union of both runs, no outer join.
    """
    part = lambda run, w, name: run.select("query_id", doc, (F.lit(float(w)) / (k + F.col("rank"))).alias("c"), F.lit(name).alias("by"))
    both = part(embedding, 1.0, "embedding").unionByName(part(keyword, keyword_weight, "keyword"))
    fused = both.groupBy("query_id", doc).agg(F.round(F.sum("c"), DIGITS + 3).alias("score"), F.array_sort(F.collect_set("by")).alias("found_by"))
    first = F.when(F.size("found_by") > 1, 0).when(F.array_contains("found_by", "keyword"), 1).otherwise(2)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), first, F.asc(doc))
    return fused.withColumn("rank", F.row_number().over(w).cast("bigint"))


def pooled_runs(runs: dict[str, DataFrame], depth: int = 10, doc: str = "doc_id") -> DataFrame:
    """(``query_id``, doc, ``found_by``, ``place``): candidates of several systems, most agreed first."""
    out = None
    for name, run in runs.items():
        part = run.filter(F.col("rank") <= depth).select("query_id", doc, F.lit(name).alias("by"))
        out = part if out is None else out.unionByName(part)
    both = out.groupBy("query_id", doc).agg(F.array_sort(F.collect_set("by")).alias("found_by"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.size("found_by")), F.asc(doc))
    return both.withColumn("place", F.row_number().over(w).cast("bigint"))


def id_index(corpus: DataFrame, id_column: str = "trial_id") -> DataFrame:
    """(``key``, ``trial_id``): normalised ids that stand for one id only; colliding keys are left out."""
    keyed = corpus.filter(F.col(id_column).isNotNull()).select(T.normalize_id(F.col(id_column)).alias("key"), F.col(id_column).alias("trial_id")).filter("key <> ''")
    return keyed.groupBy("key").agg(F.min("trial_id").alias("trial_id"), F.max("trial_id").alias("last")).filter("trial_id = last").drop("last")


def colliding_ids(corpus: DataFrame, id_column: str = "trial_id") -> DataFrame:
    """(``key``, ``ids``): keys that several written ids share."""
    keyed = corpus.filter(F.col(id_column).isNotNull()).select(T.normalize_id(F.col(id_column)).alias("key"), F.col(id_column).alias("i")).filter("key <> ''").distinct()
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("ids")).filter("ids > 1")


def known_items(queries: DataFrame, index: DataFrame, text: str = "query_text") -> DataFrame:
    """(``query_id``, ``trial_id``): the id a query names, the whole query first, then its words in order."""
    whole = queries.select("query_id", T.normalize_id(F.col(text)).alias("key"), F.lit(-1).alias("pos"))
    words = queries.select("query_id", F.posexplode(F.split(F.trim(text), r"\s+")).alias("pos", "w")).select("query_id", T.normalize_id(F.col("w")).alias("key"), "pos")
    asked = whole.unionByName(words.filter(T.looks_like_id(F.col("key"))))
    return asked.join(index, "key").groupBy("query_id").agg(F.min_by("trial_id", "pos").alias("trial_id"))


def promoted(ranked: DataFrame, known: DataFrame, doc: str = "trial_id") -> DataFrame:
    """A known item goes to rank 1 with score 1; the rest moves down, without it."""
    hit = known.select("query_id", F.col("trial_id").alias(doc))
    rest = ranked.select("query_id", doc, "score", "rank").join(hit, ["query_id", doc], "left_anti")
    both = rest.unionByName(hit.select("query_id", doc, F.lit(1.0).alias("score"), F.lit(0).cast("bigint").alias("rank")))
    w = Window.partitionBy("query_id").orderBy("rank", doc)
    return both.withColumn("rank", F.row_number().over(w).cast("bigint"))


def negated_spans(text: Column) -> Column:
    """Array of negated spans of a query: the words after each cue, up to 5, to the next cue or end word; at least 2."""
    tokens = T.word_runs(text)
    stops = NEGATION_CUES + SPAN_ENDS

    def span(i: Column) -> Column:
        window = F.slice(tokens, i + 2, MAX_SPAN)
        cut = F.array_position(F.transform(window, lambda t: t.isin(stops)), True)
        return F.when(cut == 0, window).otherwise(F.slice(window, F.lit(1), F.greatest(cut - 1, F.lit(0)).cast("int")))

    places = F.filter(F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(tokens, i).isin(NEGATION_CUES))
    return F.filter(F.transform(places, span), lambda s: F.size(s) >= MIN_SPAN)


def asserts(tokens: Column, span: Column) -> Column:
    """Whether a text states a concept: all its words occur, and its first word somewhere without a cue among the 6 words before."""
    cues = NEGATION_CUES + AVOIDANCE_CUES
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    free = F.exists(
        places,
        lambda i: (F.get(tokens, i) == F.get(span, F.lit(0))) & ~F.exists(F.slice(tokens, F.greatest(i - LOOK_BACK, F.lit(0)) + 1, F.least(i, F.lit(LOOK_BACK))), lambda t: t.isin(cues)),
    )
    return (F.size(span) > 0) & F.forall(span, lambda t: F.array_contains(tokens, t)) & free


def negation_filtered(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, n: int, *, doc: str = "doc_id", key: str = "row_id", text: str = "query_text") -> DataFrame:
    """Drop hits that assert what their query rules out, cut to ``n`` and number again.

    ``ranked`` should be three times as deep as ``n`` for queries with a negated
    span; others keep their first ``n``. Only hits meet their texts.
    """
    spans = queries.select("query_id", negated_spans(F.col(text)).alias("spans")).filter(F.size("spans") > 0)
    hits = ranked.join(spans, "query_id", "left")
    texts = corpus.select(F.col(key).alias(doc), T.word_runs(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))).alias("words"))
    judged = hits.filter("spans IS NOT NULL").join(texts, doc).filter(F.exists("spans", lambda s: asserts(F.col("words"), s))).select("query_id", doc)
    kept = ranked.join(judged, ["query_id", doc], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)


def containing(documents: DataFrame, codes: list[str], *, key: str, text: Column) -> DataFrame:
    """(``code``, ``key``): documents whose text holds a code, in any case and inside words too.

    The codes are a list of the caller, at most ``MOST_CODES``: each text is
    tested against all of them where it lies. An empty code is in no text.
    """
    wanted = sorted({c.lower() for c in codes if c})
    if len(wanted) > MOST_CODES:
        raise ValueError(f"{len(wanted)} codes; at most {MOST_CODES}")
    low = F.lower(F.coalesce(text, F.lit("")))
    held = F.array(*[F.lit(c) for c in wanted]) if wanted else F.array().cast("array<string>")
    found = documents.select(key, low.alias("__low")).select(key, F.explode(F.filter(held, lambda c: F.contains(F.col("__low"), c))).alias("code"))
    return found.select("code", key)


def without_cues(text: Column) -> Column:
    """The words of a query without its negation cues: the twin that asks for what the query rules out."""
    return F.array_join(F.filter(T.word_runs(text), lambda t: ~t.isin(NEGATION_CUES)), " ")


def reasons(queries: DataFrame, hits: DataFrame, *, text: str = "query_text", known: DataFrame | None = None, before: DataFrame | None = None, when_none: str = "Nothing matched this query.") -> DataFrame:
    """(``query_id``, ``reason``): null where a query has hits, else why not, the first that applies.

    ``known`` has the ``query_id`` of the queries with a word the collection or
    the model knows, ``before`` of those with hits before filters; without them
    these two reasons aren't told apart from ``when_none``.
    """
    mark = lambda table, name: table.select("query_id").distinct().withColumn(name, F.lit(True))
    out = queries.join(mark(hits, "__yes"), "query_id", "left")
    out = out.join(mark(known, "__known"), "query_id", "left") if known is not None else out.withColumn("__known", F.lit(True))
    out = out.join(mark(before, "__before"), "query_id", "left") if before is not None else out.withColumn("__before", F.lit(None).cast("boolean"))
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    empty = F.size(T.preprocess(F.col(text))) == 0
    why = F.when(F.col("__yes"), F.lit(None)).when(blank, "Query is empty.").when(empty, "Query has no searchable words.").when(F.col("__known").isNull(), "No word of this query is known.")
    why = why.when(F.col("__before"), "All results were ruled out by the query.").otherwise(when_none)
    return out.select("query_id", why.cast("string").alias("reason"))
