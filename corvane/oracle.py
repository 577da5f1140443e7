"""SQL of the core queries, for any engine that reads the same tables."""

from __future__ import annotations

from corvane.functions.text import KEEP_WORDS, SPLIT_WORDS, STOP_WORDS
from corvane.operators.fuse import AVOIDANCE_CUES, NEGATION_CUES, SPAN_ENDS
from corvane.operators.postings import IRREGULAR, NOUN_RULES

# Rows that fail to parse

_SQL_LINES = r"""
WITH pieces AS (SELECT line_id, coalesce(raw_line, '') AS t, string_split(coalesce(raw_line, ''), '"') AS p FROM raw_corpus WHERE coalesce(line_no <> 1, true)),
shape AS (SELECT line_id, t,
  len(p) % 2 = 0 OR len(list_filter(range(1, len(p) + 1), lambda i: i % 2 = 1 AND p[i] <> '' AND ((i > 1 AND NOT starts_with(p[i], ',')) OR (i < len(p) AND NOT ends_with(p[i], ','))))) > 0 AS quoting,
  1 + list_sum(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i % 2 = 1 THEN length(p[i]) - length(replace(p[i], ',', '')) ELSE 0 END)) AS n,
  list_transform(regexp_extract_all(t, '(?s)(?:^|,)("(?:[^"]|"")*"|[^",]*)', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM pieces),
lines AS (SELECT line_id, f, CASE WHEN quoting THEN 'quoting' WHEN n <> 7 THEN 'column_count'
  WHEN NOT regexp_full_match(f[2], 'NCT[0-9]{8}|ChiCTR[0-9]{10}|CTRI/[0-9]{4}/[0-9]{2}/[0-9]{7}|[0-9]{4}-[0-9]{6}-[0-9]{2}|DRKS[0-9]{8}|jRCT[0-9]{10}')
    OR NOT regexp_matches(f[5], '[^\s\pZ]') OR regexp_matches(f[5], '[\x00-\x08\x0B-\x1F\x7F-\x{9F}\x{FFFD}]')
    OR NOT regexp_full_match(f[6], '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR try_cast(f[6] AS DATE) IS NULL OR starts_with(f[6], '0000') THEN 'invalid_value' END AS reason FROM shape)
"""
_SQL_SHAPE = _SQL_LINES[: _SQL_LINES.index(",\nlines AS")]
SQL_P3_FOUND = _SQL_LINES + "SELECT line_id, reason FROM lines WHERE reason IS NOT NULL"
SQL_P3_LOADED = (
    _SQL_LINES
    + """SELECT line_id AS row_id, f[2] AS trial_id, nullif(f[3], '') AS title, nullif(f[4], '') AS brief_title, f[5] AS abstract, f[6] AS publication_date, nullif(f[1], '') AS date_added, nullif(f[7], '') AS phase,
CASE WHEN starts_with(f[2], 'NCT') THEN 'NCT' WHEN starts_with(f[2], 'ChiCTR') THEN 'ChiCTR' WHEN starts_with(f[2], 'CTRI') THEN 'CTRI' WHEN starts_with(f[2], 'DRKS') THEN 'DRKS' WHEN starts_with(f[2], 'jRCT') THEN 'jRCT' ELSE 'EUCTR' END AS registry,
CAST(NULL AS TIMESTAMP) AS received_at FROM lines WHERE reason IS NULL"""
)


# Text functions


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _urls(x: str) -> str:
    return rf"regexp_replace({x}, '\w+://\S+|@[A-Za-z0-9_]+', ' ', 'g')"


def _joined(x: str) -> str:
    for _ in range(2):  # twice for marks that share a neighbour; this dialect has no look-behind
        x = rf"regexp_replace({x}, '([A-Za-z0-9])[-‐-—]([A-Za-z0-9])', '\1\2', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '([0-9])[.,]([0-9])', '\1\2', 'g')"
    return x


def _blanks(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _clean(x: str) -> str:
    return _blanks(rf"regexp_replace({_joined(_urls(f"lower(coalesce({x}, ''))"))}, '[^0-9A-Za-z \t]', ' ', 'g')")


def _words(cleaned: str) -> str:
    for word, two in SPLIT_WORDS.items():
        cleaned = rf"regexp_replace({cleaned}, '\b{word}\b', '{two}', 'g')"
    return f"list_filter(string_split({cleaned}, ' '), lambda t: t <> '')"


def _kept(tokens: str, keep=KEEP_WORDS, least: int = 2) -> str:
    return f"list_filter({tokens}, lambda t: length(t) >= {least} AND NOT list_contains({_list(w for w in STOP_WORDS if w not in keep)}, t))"


def _preprocess(x: str) -> str:
    return _kept(_words(_clean(x)))


def _old(x: str) -> str:
    return _kept(_words(_blanks(rf"regexp_replace({_urls(f"lower(coalesce({x}, ''))")}, '[^a-z ]', ' ', 'g')")), ())


def _legacy(x: str) -> str:
    return _kept(_words(_blanks(rf"regexp_replace(regexp_replace({_urls(f"lower(coalesce({x}, ''))")}, '[^0-9A-Za-z \t]', ' ', 'g'), '[0-9]', '', 'g')")), (), 0)


def _text(x: str) -> str:
    return f"array_to_string({x}, ' ')"


_KEY = "upper(regexp_replace({}, '[^A-Za-z0-9]+', '', 'g'))"

SQL = {
    "p3_found": SQL_P3_FOUND,
    "p3_loaded": SQL_P3_LOADED,
    "clean_text": f"SELECT doc_id, {_clean('text')} AS clean FROM documents",
    "strip_urls": f"SELECT doc_id, {_urls('text')} AS plain FROM documents",
    "join_marks": f"SELECT row_id, {_joined('abstract')} AS joined FROM sample_corpus",
    "tokenize": f"SELECT row_id, {_text(_words(_clean('abstract')))} AS tokens FROM sample_corpus",
    "preprocess": f"SELECT row_id, {_text(_preprocess('abstract'))} AS tokens FROM sample_corpus",
    "old_chain": f"SELECT row_id, {_text(_old('abstract'))} AS tokens FROM sample_corpus",
    "legacy_chain": f"SELECT row_id, {_text(_legacy('abstract'))} AS tokens FROM sample_corpus",
    "bigrams": f"""WITH t AS (SELECT {_preprocess('title')} AS t FROM sample_corpus),
both_ AS (SELECT unnest(t) AS term FROM t UNION ALL SELECT t[i] || ' ' || t[i + 1] FROM t, unnest(range(1, len(t))) u(i))
SELECT term, count(*) AS n FROM both_ GROUP BY term""",
    "normalize_id": f"SELECT row_id, {_KEY.format('trial_id')} AS id_key, length({_KEY.format('trial_id')}) >= 6 AND regexp_matches({_KEY.format('trial_id')}, '[0-9]') AS looks_like_id FROM sample_corpus",
    "truncated_abstract": "SELECT row_id, CASE WHEN length(abstract) <= 300 THEN abstract WHEN abstract IS NOT NULL THEN rtrim(substring(abstract, 1, 300), ' ') || '...' END AS short, substring(title, 1, 200) AS head FROM sample_corpus",
    "row_fingerprint": "SELECT row_id, substring(sha256(concat_ws('|', trial_id, title, abstract)), 1, 16) AS fingerprint FROM sample_corpus",
    "drop_blank_rows": "SELECT row_id, coalesce(abstract, '') AS text FROM sample_corpus WHERE abstract IS NOT NULL OR title IS NOT NULL",
    "containment": """WITH codes AS (SELECT DISTINCT lower(string_split(trim(query_text), ' ')[1]) AS code FROM eval_queries WHERE stratum = 'entity')
SELECT code, row_id FROM codes JOIN sample_corpus ON contains(lower(concat_ws(' ', title, abstract)), code)""",
    "csv_loaded": _SQL_SHAPE + """, miss AS (SELECT ['', 'NA', 'N/A', 'n/a', 'NULL', 'null', 'NaN', 'nan', 'None', '<NA>'] AS m)
SELECT * FROM (SELECT CASE WHEN NOT list_contains(m, f[2]) THEN f[2] END AS trial_id, CASE WHEN NOT list_contains(m, f[3]) THEN f[3] END AS title, CASE WHEN NOT list_contains(m, f[5]) THEN f[5] END AS abstract,
CASE WHEN NOT list_contains(m, f[6]) THEN f[6] END AS publication_date, CASE WHEN NOT list_contains(m, f[1]) THEN f[1] END AS date_added, CASE WHEN NOT list_contains(m, f[7]) THEN f[7] END AS phase
FROM shape, miss WHERE NOT quoting AND n = 7) WHERE title IS NOT NULL OR abstract IS NOT NULL""",
}


# Inverted index


def _index(tokens: str, lemmas: bool = True, table: str = "sample_corpus", key: str = "row_id") -> str:
    """CTEs tok, counts, lemma, post, df, st."""
    rules = " ".join(f"WHEN ends_with(term, '{e}') AND length(term) > {len(e)} THEN left(term, length(term) - {len(e)}) || '{o}'" for e, o in NOUN_RULES)
    odd = " ".join(f"WHEN term = '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    post = "SELECT doc_id, lemma AS term, CAST(sum(tf) AS BIGINT) AS tf FROM counts JOIN lemma USING (term) GROUP BY ALL" if lemmas else "SELECT doc_id, term, tf FROM counts"
    return f"""tok AS (SELECT {key} AS doc_id, {tokens} AS tokens FROM {table}),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL),
vocab AS (SELECT DISTINCT term FROM counts),
guess AS (SELECT term, CASE {odd} WHEN ends_with(term, 'ss') OR ends_with(term, 'us') OR ends_with(term, 'is') THEN term {rules} ELSE term END AS g FROM vocab),
lemma AS (SELECT guess.term, coalesce(v.term, guess.term) AS lemma FROM guess LEFT JOIN vocab v ON v.term = guess.g),
post AS ({post}),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT count(*) AS n_docs, CASE WHEN avg(len(tokens)) > 0 THEN avg(len(tokens)) ELSE 1.0 END AS avgdl FROM tok)"""


def _asked(tokens: str, lemmas: bool = True) -> str:
    """CTE q: terms of the judged queries."""
    raw = f"SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest({tokens}) AS term FROM eval_queries) GROUP BY ALL"
    if not lemmas:
        return f"q AS (SELECT query_id, term, n AS qtf FROM ({raw}))"
    return f"q AS (SELECT query_id, coalesce(lemma, r.term) AS term, sum(n) AS qtf FROM ({raw}) r LEFT JOIN lemma USING (term) GROUP BY ALL)"


def _top(name: str, scored: str, n: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({scored}) WHERE score > 0) WHERE rank <= {n})"


def _bm25(n: int = 10, k1: float = 1.2, b: float = 0.75, name: str = "bm25") -> str:
    return _top(name, f"""SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * len(tokens) / avgdl))), 6) AS score
FROM post JOIN q USING (term) JOIN df USING (term) JOIN tok USING (doc_id), st GROUP BY ALL""", n)


def _tfidf(n: int = 10) -> str:
    return f"""idf AS (SELECT term, ln((1 + n_docs) / (1 + df)) + 1 AS idf FROM df, st),
norms AS (SELECT doc_id, sqrt(sum(tf * idf * tf * idf)) AS norm FROM post JOIN idf USING (term) GROUP BY doc_id),
qw AS (SELECT query_id, term, qtf * idf AS w, idf FROM q JOIN idf USING (term)),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS qnorm FROM qw GROUP BY query_id),
""" + _top("tfidf", "SELECT query_id, doc_id, round(dot / norm, 6) AS score FROM (SELECT query_id, doc_id, sum(w / qnorm * idf * tf) AS dot FROM post JOIN qw USING (term) JOIN qn USING (query_id) GROUP BY ALL) JOIN norms USING (doc_id)", n)


_P = _preprocess("abstract")
_IDX = "WITH " + _index(_P)
_Q = _asked(_preprocess("query_text"))
_RUNS = f"{_IDX},\n{_Q},\n"
_HITS = "SELECT query_id, doc_id, score, rank FROM "
_BI = lambda x: f"(list_concat({x}, list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])))"

SQL |= {
    "term_freq": _IDX + " SELECT doc_id, term, tf FROM counts",
    "doc_freq": _IDX + " SELECT term, count(*) AS df FROM counts GROUP BY term",
    "lemma_map": _IDX + " SELECT term, lemma FROM lemma",
    "lemma_postings": _IDX + " SELECT doc_id, term, tf FROM post",
    "vocab_top10": _IDX + " SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY term ORDER BY n DESC, term LIMIT 10",
    "corpus_stats": _IDX + " SELECT n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM vocab) AS vocabulary FROM st",
    "sif_weights": _IDX + " SELECT term, round(0.001 / (0.001 + sum(tf) / (SELECT sum(tf) FROM counts)), 9) AS weight FROM counts GROUP BY term",
    "idf": _IDX + " SELECT term, df, round(ln((1 + n_docs) / (1 + df)) + 1, 9) AS idf_tfidf, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 9) AS idf_bm25 FROM df, st",
    "bm25_topk": _RUNS + _bm25() + _HITS + "bm25",
    "bm25_b0": _RUNS + _bm25(b=0.0) + _HITS + "bm25",
    "tfidf_topk": _RUNS + _tfidf() + _HITS + "tfidf",
    "bigram_bm25": "WITH base AS (SELECT row_id, " + _P + " AS p FROM sample_corpus),\n" + _index(_BI("p"), False, "base") + ",\n"
    + "q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(" + _BI("p") + ") AS term FROM (SELECT query_id, " + _preprocess("query_text") + " AS p FROM eval_queries)) GROUP BY ALL),\n" + _bm25() + _HITS + "bm25",
    "old_chain_bm25": "WITH " + _index(_old("abstract"), False) + ",\n" + _asked(_old("query_text"), False) + ",\n" + _bm25() + _HITS + "bm25",
    "cosine_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), """
    + _top("hits", "SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 6) AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id", 10)
    + _HITS + "hits",
}

# Vectors

_WORDS = """wv AS (SELECT term, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT term, CAST('0x' || substring(md5(term), 1, 12) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id FROM (SELECT DISTINCT term FROM counts)) JOIN embeddings USING (vec_id)),
sif AS (SELECT term, 0.001 / (0.001 + sum(tf) / (SELECT sum(tf) FROM counts)) AS weight FROM counts GROUP BY term)"""


def _pool(weight: str, counts: str = "counts", docs: str = "tok") -> str:
    return f"""SELECT d.doc_id, coalesce(known, 0) AS known, pos, x FROM {docs} d LEFT JOIN (
SELECT doc_id, pos, sum(w * x) / sum(w) AS x FROM (SELECT doc_id, {weight} AS w, i - 1 AS pos, v[i] AS x FROM {counts} JOIN wv USING (term) JOIN sif USING (term), unnest(range(1, 65)) u(i)) GROUP BY ALL) USING (doc_id)
LEFT JOIN (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS known FROM {counts} JOIN wv USING (term) GROUP BY doc_id) USING (doc_id)"""


_ENTRY = "SELECT doc_id, known, pos, round(x, 5) + 0.0 AS x FROM "
SQL |= {
    "mean_pool": f"{_IDX},\n{_WORDS} {_ENTRY} ({_pool('tf')})",
    "sif_pool": f"{_IDX},\n{_WORDS} {_ENTRY} ({_pool('tf * weight')})",
    "oov_documents": f"{_IDX},\n{_WORDS} SELECT count(*) AS documents, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM counts JOIN wv USING (term))) AS unknown FROM tok",
    "fixed_component_removed": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v WHERE vec_id = 0)
SELECT vec_id, i - 1 AS pos, round(v[i] - list_dot_product(v, u) * u[i], 5) + 0.0 AS x FROM v, u, unnest(range(1, len(v) + 1)) r(i)""",
    "l2_normalize": """SELECT vec_id, i - 1 AS pos, round(v[i] / CASE WHEN list_dot_product(v, v) > 0 THEN sqrt(list_dot_product(v, v)) ELSE 1 END, 5) + 0.0 AS x
FROM (SELECT vec_id, CAST(vectors AS DOUBLE[]) AS v FROM document_index WHERE vectors IS NOT NULL), unnest(range(1, len(v) + 1)) u(i)""",
}

# Fusion, identifiers, negation


def _union(embedding: str, keyword: str = "tfidf") -> str:
    return f"""fused AS (SELECT query_id, doc_id, round(sum(c), 9) AS score, string_agg(src, ',' ORDER BY src) AS found_by FROM (
SELECT query_id, doc_id, 1.0 / (60 + rank) AS c, 'embedding' AS src FROM {embedding} UNION ALL SELECT query_id, doc_id, 1.5 / (60 + rank), 'keyword' FROM {keyword}) GROUP BY ALL),
fusedr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE found_by WHEN 'embedding,keyword' THEN 0 WHEN 'keyword' THEN 1 ELSE 2 END, doc_id) AS rank FROM fused)"""


def _per_trial(run: str) -> str:
    return f"SELECT query_id, trial_id, score, row_number() OVER (PARTITION BY query_id ORDER BY r, trial_id) AS rank FROM (SELECT query_id, trial_id, max(score) AS score, min(rank) AS r FROM {run} JOIN sample_corpus ON row_id = doc_id WHERE trial_id IS NOT NULL GROUP BY ALL)"


_KNOWN = rf"""ids AS (SELECT k, min(trial_id) AS trial_id FROM (SELECT {_KEY.format('trial_id')} AS k, trial_id FROM sample_corpus WHERE trial_id IS NOT NULL) WHERE k <> '' GROUP BY k HAVING min(trial_id) = max(trial_id)),
named AS (SELECT query_id, {_KEY.format('query_text')} AS k, -1 AS pos FROM eval_queries UNION ALL
SELECT query_id, {_KEY.format('w[i]')}, i - 1 FROM (SELECT query_id, regexp_split_to_array(trim(query_text), '\s+') AS w FROM eval_queries), unnest(range(1, len(w) + 1)) u(i)
WHERE length({_KEY.format('w[i]')}) >= 6 AND regexp_matches({_KEY.format('w[i]')}, '[0-9]')),
known AS (SELECT query_id, arg_min(trial_id, pos) AS trial_id FROM named JOIN ids USING (k) GROUP BY query_id)"""

_STOPS = _list(NEGATION_CUES + SPAN_ENDS)
_SPANS = f"""qt AS (SELECT query_id, regexp_extract_all(lower(coalesce(query_text, '')), '[a-z0-9]+') AS t FROM eval_queries),
win AS (SELECT query_id, i, t[i + 1:i + 5] AS w FROM qt, unnest(range(1, len(t) + 1)) u(i) WHERE list_contains({_list(NEGATION_CUES)}, t[i])),
cut AS (SELECT query_id, i, CASE WHEN coalesce(list_position(list_transform(w, lambda x: list_contains({_STOPS}, x)), true), 0) = 0 THEN w ELSE w[1:list_position(list_transform(w, lambda x: list_contains({_STOPS}, x)), true) - 1] END AS span FROM win),
spans AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS n, span FROM cut WHERE len(span) >= 2)"""
_ASSERTS = f"""dw AS (SELECT row_id, regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))), '[a-z0-9]+') AS t FROM sample_corpus),
said AS (SELECT query_id, span, row_id FROM spans JOIN dw ON len(list_intersect(list_distinct(span), t)) = len(list_distinct(span))
WHERE len(list_filter(range(1, len(t) + 1), lambda i: t[i] = span[1] AND NOT list_has_any(t[greatest(i - 6, 1):i - 1], {_list(NEGATION_CUES + AVOIDANCE_CUES)}))) > 0)"""


def _negated(run: str) -> str:
    return f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM {run} r WHERE NOT EXISTS (SELECT 1 FROM said s WHERE s.query_id = r.query_id AND s.row_id = r.doc_id)"


def _promoted(run: str) -> str:
    return f"SELECT query_id, trial_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, trial_id) AS rank FROM (SELECT query_id, trial_id, score, rank FROM {run} r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.query_id = r.query_id AND k.trial_id = r.trial_id) UNION ALL SELECT query_id, trial_id, 1.0, 0 FROM known)"


_POOL = f"""tb AS ({_per_trial('bm25')}), tt AS ({_per_trial('tfidf')}),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(found_by) - length(replace(found_by, ',', '')) DESC, trial_id) AS place FROM (
SELECT query_id, trial_id, string_agg(src, ',' ORDER BY src) AS found_by FROM (SELECT query_id, trial_id, 'bm25' AS src FROM tb WHERE rank <= 10 UNION ALL SELECT query_id, trial_id, 'tfidf' FROM tt WHERE rank <= 10) GROUP BY ALL)),
qrels AS (SELECT DISTINCT query_id, trial_id FROM (SELECT query_id, unnest(relevant) AS trial_id FROM eval_queries) WHERE trial_id IS NOT NULL),
sheet AS (SELECT query_id, trial_id, CASE WHEN r.trial_id IS NOT NULL THEN true WHEN judged_by IS NOT NULL THEN contains(found_by, ',') END AS relevant FROM pool LEFT JOIN qrels r USING (query_id, trial_id) JOIN eval_queries USING (query_id))"""
_BOTH = f"{_RUNS}{_bm25()},\n{_tfidf()}"
_EMB = f"""{_WORDS},
ev AS (SELECT doc_id, list(x ORDER BY pos) AS v FROM ({_pool('tf')}) WHERE pos IS NOT NULL GROUP BY doc_id),
qc AS (SELECT query_id AS doc_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_preprocess('query_text')}) AS term FROM eval_queries) GROUP BY ALL),
qd AS (SELECT query_id AS doc_id FROM eval_queries),
qv AS (SELECT doc_id, list(x ORDER BY pos) AS v FROM ({_pool('tf', 'qc', 'qd')}) WHERE pos IS NOT NULL GROUP BY doc_id),
""" + _top("emb", "SELECT q.doc_id AS query_id, d.doc_id, round(list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(d.v, d.v)), 6) AS score FROM qv q, ev d", 30)
_NEG = "neg AS (SELECT DISTINCT query_id FROM spans)"

SQL |= {
    "rrf_union": f"{_BOTH},\n{_union('bm25')} SELECT query_id, doc_id, score, found_by, rank FROM fusedr",
    "pool_candidates": f"{_BOTH},\n{_POOL} SELECT query_id, trial_id, found_by, place FROM pool",
    "unjudged": f"{_BOTH},\n{_POOL} SELECT query_id, trial_id FROM pool ANTI JOIN qrels USING (query_id, trial_id)",
    "known_item": f"WITH {_KNOWN} SELECT query_id, trial_id FROM known",
    "id_collisions": f"SELECT id_key, count(*) AS ids FROM (SELECT DISTINCT {_KEY.format('trial_id')} AS id_key, trial_id FROM sample_corpus WHERE trial_id IS NOT NULL) WHERE id_key <> '' GROUP BY id_key HAVING count(*) > 1",
    "negation_spans": f"WITH {_SPANS} SELECT query_id, n, array_to_string(span, ' ') AS span FROM spans",
    "negation_asserts": f"WITH {_SPANS},\n{_ASSERTS} SELECT query_id, array_to_string(span, ' ') AS span, row_id FROM said",
    "negation_filter": f"{_RUNS}{_bm25(30)},\n{_SPANS},\n{_ASSERTS} SELECT query_id, doc_id, rank FROM ({_negated('bm25')}) WHERE rank <= 10",
    "promoted": f"{_RUNS}{_bm25()},\n{_KNOWN},\nper AS ({_per_trial('bm25')}) SELECT query_id, trial_id, rank FROM ({_promoted('per')})",
    "flagship": f"""{_RUNS}{_tfidf(30)},\n{_EMB},\n{_SPANS},\n{_ASSERTS},\n{_KNOWN},\n{_NEG},
cut_e AS (SELECT * FROM emb WHERE rank <= CASE WHEN query_id IN (SELECT query_id FROM neg) THEN 30 ELSE 10 END),
cut_k AS (SELECT * FROM tfidf WHERE rank <= CASE WHEN query_id IN (SELECT query_id FROM neg) THEN 30 ELSE 10 END),
{_union('cut_e', 'cut_k')}, kept AS ({_negated('fusedr')}),
short AS (SELECT * FROM kept WHERE rank <= CASE WHEN query_id IN (SELECT query_id FROM neg) THEN 10 ELSE 60 END), per AS ({_per_trial('short')})
SELECT query_id, trial_id, round(score, 9) AS score, rank FROM ({_promoted('per')})""",
    "query_reasons": "WITH " + _index(_P) + f""",
made AS (SELECT query_id + n AS query_id, CASE n WHEN 0 THEN query_text WHEN 1000 THEN '  ' WHEN 2000 THEN 'the of and' WHEN 3000 THEN 'zzqx' || query_id ELSE query_text || ' without ' || query_text END AS query_text
FROM eval_queries, unnest([0, 1000, 2000, 3000, 4000]) u(n)),
{_asked(_preprocess('query_text')).replace('eval_queries', 'made')},
{_bm25(30)},
{_SPANS.replace('eval_queries', 'made')},
{_ASSERTS},
kept AS (SELECT DISTINCT query_id FROM ({_negated('bm25')}) WHERE rank <= 10)
SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM kept) THEN NULL WHEN trim(coalesce(query_text, '')) = '' THEN 'Query is empty.'
WHEN len({_preprocess('query_text')}) = 0 THEN 'Query has no searchable words.' WHEN query_id NOT IN (SELECT query_id FROM q JOIN df USING (term)) THEN 'No word of this query is known.'
WHEN query_id IN (SELECT query_id FROM bm25) THEN 'All results were ruled out by the query.' ELSE 'Nothing matched this query.' END AS reason FROM made""",
    "twin_overlap": "WITH " + _index(_P) + f""",
neg AS (SELECT query_id, query_text FROM eval_queries WHERE query_id IN (WITH {_SPANS} SELECT query_id FROM spans)),
made AS (SELECT query_id, query_text FROM neg UNION ALL SELECT query_id + 1000, array_to_string(list_filter(regexp_extract_all(lower(query_text), '[a-z0-9]+'), lambda t: NOT list_contains({_list(NEGATION_CUES)}, t)), ' ') FROM neg),
{_asked(_preprocess('query_text')).replace('eval_queries', 'made')},
{_bm25(30)},
{_SPANS.replace('eval_queries', 'made')},
{_ASSERTS},
kept AS (SELECT query_id, doc_id FROM ({_negated('bm25')}) WHERE rank <= 10), ten AS (SELECT query_id, doc_id FROM bm25 WHERE rank <= 10)
SELECT query_id, round((SELECT count(*) FROM ten a JOIN ten b USING (doc_id) WHERE a.query_id = neg.query_id AND b.query_id = neg.query_id + 1000) / 10, 6) AS plain,
round((SELECT count(*) FROM kept a JOIN ten b USING (doc_id) WHERE a.query_id = neg.query_id AND b.query_id = neg.query_id + 1000) / 10, 6) AS filtered FROM neg""",
    "label_progress": f"{_BOTH},\n{_POOL} SELECT CAST(sum(j) AS BIGINT) AS judged, CAST(sum(c) AS BIGINT) AS candidates, count(*) FILTER (WHERE j = c) AS complete FROM (SELECT query_id, count(relevant) AS j, count(*) AS c FROM sheet GROUP BY query_id)",
    "merge_labels": f"""{_BOTH},\n{_POOL}, full_ AS (SELECT query_id FROM sheet GROUP BY query_id HAVING count(relevant) = count(*))
SELECT query_id, string_agg(trial_id, ',' ORDER BY trial_id) AS relevant FROM (SELECT query_id, trial_id FROM qrels UNION SELECT query_id, trial_id FROM sheet WHERE relevant AND query_id IN (SELECT query_id FROM full_) AND query_id IN (SELECT query_id FROM qrels)) GROUP BY query_id""",
}

# Evaluation

_QRELS = "qrels AS (SELECT DISTINCT query_id, trial_id FROM (SELECT query_id, unnest(relevant) AS trial_id FROM eval_queries) WHERE trial_id IS NOT NULL)"
_LOG = """runs AS (SELECT method, query_id, trial_id, row_number() OVER (PARTITION BY method, query_id ORDER BY r, trial_id) AS rank FROM (
SELECT ranker AS method, query_id, trial_id, min(hit_rank) AS r FROM search_log WHERE query_id IS NOT NULL AND trial_id IS NOT NULL GROUP BY ALL))"""


def _metrics(ks, factor: str = "1") -> str:
    return f"""sizes AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY query_id),
base AS (SELECT method, query_id, n_rel, k, k * {factor} AS depth FROM (SELECT DISTINCT method FROM runs), sizes, unnest([{', '.join(map(str, ks))}]) u(k)),
hit AS (SELECT method, query_id, rank, q.trial_id IS NOT NULL AS hit FROM runs LEFT JOIN qrels q USING (query_id, trial_id)),
scores AS (SELECT method, query_id, k, count(*) FILTER (WHERE rank <= depth AND hit) / n_rel AS recall,
CASE WHEN count(*) FILTER (WHERE rank <= depth) > 0 THEN count(*) FILTER (WHERE rank <= depth AND hit) / count(*) FILTER (WHERE rank <= depth) ELSE 0 END AS precision,
coalesce(1 / min(rank) FILTER (WHERE rank <= depth AND hit), 0) AS mrr,
coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= depth AND hit), 0) / list_sum(list_transform(range(1, CAST(least(n_rel, depth) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ndcg,
least(n_rel, depth) / n_rel AS ceiling, count(*) FILTER (WHERE hit AND rank <= n_rel) / n_rel AS r_precision, count(rank) AS shown
FROM base LEFT JOIN hit USING (method, query_id) GROUP BY method, query_id, k, n_rel, depth)"""


def _summary(by: str = "method", more: str = "") -> str:
    means = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("recall", "precision", "mrr", "ndcg", "ceiling", "r_precision"))
    return f"SELECT {by}, k, count(*) AS queries, count(*) FILTER (WHERE shown = 0) AS unanswered, round(avg(shown), 6) AS results_shown, {means} FROM scores {more} GROUP BY {by}, k"


_LOGGED = f"WITH {_QRELS},\n{_LOG},\n"
_LATENCY = """late AS (SELECT hit_id, min(ranker) AS ranker, min((epoch_us(arrived_at) - epoch_us(served_at)) / 1000.0) AS ms FROM search_log GROUP BY hit_id),
lat AS (SELECT ranker, count(ms) AS n, list_sort(list(ms)) AS s, round(avg(ms), 2) AS mean, max(ms) AS most FROM late WHERE ms IS NOT NULL GROUP BY ranker),
latency AS (SELECT ranker, n, s[CAST(least(floor(n * 0.5), n - 1) AS BIGINT) + 1] AS p50, s[CAST(least(floor(n * 0.95), n - 1) AS BIGINT) + 1] AS p95, s[CAST(least(floor(n * 0.99), n - 1) AS BIGINT) + 1] AS p99, mean, most FROM lat)"""
_BEST = f"means AS ({_summary()}), best AS (SELECT method, recall, mrr FROM means WHERE k = 10 AND method <> 'tfidf' ORDER BY recall DESC, method LIMIT 1)"
_MIX = "(((r * 1540483477 + j * 668265263 + 42) % 4294967296))"

SQL |= {
    "log_metrics": _LOGGED + _metrics((1, 3, 5, 10, 20)) + " " + _summary(),
    "log_metrics_by_stratum": _LOGGED + _metrics((10,)) + " " + _summary("stratum, method", "JOIN eval_queries USING (query_id)"),
    "ranker_metrics": f"""{_RUNS}{_bm25(20)},\n{_tfidf(20)},\n{_union('bm25')},\n{_QRELS},
runs AS (SELECT 'bm25' AS method, query_id, trial_id, rank FROM ({_per_trial('bm25')}) UNION ALL SELECT 'tfidf', query_id, trial_id, rank FROM ({_per_trial('tfidf')}) UNION ALL SELECT 'union', query_id, trial_id, rank FROM ({_per_trial('fusedr')})),
"""
    + _metrics((5, 10), "CASE WHEN method = 'union' THEN 2 ELSE 1 END") + " " + _summary(),
    "method_best": _LOGGED + _metrics((10,)) + ",\n" + _BEST + " SELECT method, recall, mrr FROM best",
    "log_latency": f"WITH {_LATENCY} SELECT * FROM latency",
    "release_gate": _LOGGED + _metrics((10,)) + ",\n" + _BEST + ",\n" + _LATENCY + """ SELECT 'recall@10' AS target, recall AS value, CAST(0.7 AS DOUBLE) AS wanted, recall >= 0.7 AS met FROM best
UNION ALL SELECT 'mrr@10', mrr, CAST(0.45 AS DOUBLE), mrr >= 0.45 FROM best UNION ALL SELECT 'p95_ms', max(p95), CAST(300 AS DOUBLE), max(p95) <= 300.0 FROM latency""",
    "bootstrap": _LOGGED + _metrics((10,)) + """,
diffs AS (SELECT row_number() OVER (ORDER BY query_id) - 1 AS i, u.recall - b.recall AS diff FROM scores u JOIN scores b USING (query_id) WHERE u.method = 'union' AND b.method = 'bm25'),
x0 AS (SELECT r, n, (r * 1540483477 + j * 668265263 + 42) % 4294967296 AS x FROM range(20000) a(r), (SELECT count(*) AS n FROM diffs), unnest(range(n)) b(j)),
x1 AS (SELECT r, n, xor(x, x >> 15) * 1103515245 % 4294967296 AS x FROM x0), x2 AS (SELECT r, n, xor(x, x >> 13) * 1540483477 % 4294967296 AS x FROM x1),
means AS (SELECT r, avg(diff) AS m FROM (SELECT r, xor(x, x >> 16) % n AS i FROM x2) JOIN diffs USING (i) GROUP BY r), e AS (SELECT avg(diff) AS effect FROM diffs)
SELECT round(any_value(effect), 6) AS effect, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CASE WHEN abs(m - effect) >= abs(effect) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p FROM means, e""",
    "overlap_twins": f"WITH {_LOG} SELECT method_a, method_b, round(avg(o), 6) AS overlap FROM (SELECT query_id, a.method AS method_a, b.method AS method_b, count(*) / 10 AS o FROM runs a JOIN runs b USING (query_id, trial_id) WHERE a.method < b.method AND a.rank <= 10 AND b.rank <= 10 GROUP BY ALL) GROUP BY ALL",
    "relevant_per_stratum": f"WITH {_QRELS} SELECT stratum, count(*) AS queries, round(avg(coalesce(n, 0)), 6) AS relevant FROM eval_queries LEFT JOIN (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id) USING (query_id) GROUP BY stratum",
    "served_per_day": """WITH h AS (SELECT hit_id, arg_min(ranker, (served_at, ranker)) AS ranker, min(served_at) AS served_at FROM search_log WHERE served_at IS NOT NULL GROUP BY hit_id)
SELECT date_trunc('day', served_at) AS window_start, ranker, count(*) AS hits FROM h GROUP BY ALL""",
    "word_cloud": _IDX + " SELECT term, n, round(n / max(n) OVER (), 6) AS size FROM (SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY term ORDER BY n DESC, term LIMIT 200)",
    "embedding_topk": f"{_IDX},\n{_EMB} SELECT query_id, doc_id, score, rank FROM emb WHERE rank <= 10",
    "pool_four": f"""{_RUNS}{_bm25()},\n{_tfidf()},\n{_EMB},\nemb10 AS (SELECT * FROM emb WHERE rank <= 10),\n{_union('emb10')},
each AS (SELECT 'bm25' AS src, * FROM ({_per_trial('bm25')}) UNION ALL SELECT 'tfidf', * FROM ({_per_trial('tfidf')}) UNION ALL SELECT 'embedding', * FROM ({_per_trial('emb10')}) UNION ALL SELECT 'union', * FROM ({_per_trial('fusedr')}))
SELECT query_id, trial_id, found_by, row_number() OVER (PARTITION BY query_id ORDER BY length(found_by) - length(replace(found_by, ',', '')) DESC, trial_id) AS place
FROM (SELECT query_id, trial_id, string_agg(src, ',' ORDER BY src) AS found_by FROM each WHERE rank <= 10 GROUP BY ALL)""",
    "integrity_findings": """SELECT * FROM (VALUES ('ERROR', 'index-model-mismatch', 'skipgram-title'), ('ERROR', 'index-model-vectors-stale', 'skipgram-title'), ('ERROR', 'index-size-mismatch', 'skipgram-title'), ('WARN', 'index-predates-checksum', 'fasttext-abstract'),
('WARN', 'index-sampled', 'fasttext-abstract'), ('WARN', 'model-missing', 'glove'), ('WARN', 'model-sampled', 'fasttext'), ('WARN', 'model-corpus-stale', 'fasttext'), ('WARN', 'artefact-oversized', 'fasttext')) t(severity, code, subject)""",
}
