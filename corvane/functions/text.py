"""Text functions, Column to Column; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words; bare stems of contractions are in because apostrophes become blanks.
STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
can could did do does doing down during each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other
our ours ourselves out over own same she should so some such than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which while who whom why will
with would you your yours yourself yourselves
ain aren couldn didn doesn don hadn hasn haven isn ll ma mightn mustn needn re shan shouldn ve wasn weren won wouldn
""".split()

#: Stop words kept because they carry clinical negation, order or direction.
KEEP_WORDS = "no not nor none cannot against before after during below above under over off out".split()

#: Words the tokeniser splits in two.
SPLIT_WORDS = {"cannot": "can not", "gimme": "gim me", "gonna": "gon na", "gotta": "got ta", "lemme": "lem me", "wanna": "wan na"}

#: The boundary and the possessive repeat keep it linear on very long words.
URL_OR_HANDLE = r"(?U)\b\w++://\S+|@[A-Za-z0-9_]+"


def strip_urls(c: Column) -> Column:
    """URLs and @handles become a blank."""
    return F.regexp_replace(c, URL_OR_HANDLE, " ")


def join_marks(c: Column) -> Column:
    """Delete hyphens between letters or digits, and points and commas between digits."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<=[A-Za-z0-9])[-‐-—](?=[A-Za-z0-9])", ""), r"(?<=[0-9])[.,](?=[0-9])", "")


def strip_symbols(c: Column) -> Column:
    """Everything but ASCII letters, digits, blanks and tabs becomes a blank."""
    return F.regexp_replace(c, r"[^0-9A-Za-z \t]", " ")


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Lower case, no URLs, joined marks, no symbols, single blanks; null gives ""."""
    return collapse_blanks(strip_symbols(join_marks(strip_urls(F.lower(F.coalesce(c, F.lit("")))))))


def word_tokens(cleaned: Column) -> Column:
    """Words of a cleaned text; the contractions that survive cleaning are split."""
    for word, two in SPLIT_WORDS.items():
        cleaned = F.regexp_replace(cleaned, rf"\b{word}\b", two)
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def without_stop_words(tokens: Column, keep: tuple[str, ...] | list[str] = tuple(KEEP_WORDS)) -> Column:
    """Repeats stay: a term frequency is counted on the result."""
    stop = [w for w in STOP_WORDS if w not in set(keep)]
    return F.filter(tokens, lambda t: ~t.isin(stop))


def at_least(tokens: Column, length: int = 2) -> Column:
    if length < 1:
        raise ValueError("the least token length must be 1 or more")
    return F.filter(tokens, lambda t: F.length(t) >= length)


def preprocess(c: Column, *, keep: tuple[str, ...] | list[str] = tuple(KEEP_WORDS), least: int = 2) -> Column:
    """Tokens of documents and queries alike, before lemmatisation."""
    return at_least(without_stop_words(word_tokens(clean_text(c)), keep), least)


def old_chain(c: Column, *, least: int = 2) -> Column:
    """The letters-only tokeniser for comparisons: digits go, and all stop words."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), URL_OR_HANDLE, " "), "[^a-z ]", " ")
    return at_least(without_stop_words(word_tokens(collapse_blanks(letters)), ()), least)


def legacy_text(c: Column) -> Column:
    """The historic chain as one string: lower case, no URLs, symbols, digits or stop words."""
    plain = F.regexp_replace(strip_symbols(strip_urls(F.lower(F.coalesce(c, F.lit(""))))), "[0-9]", "")
    return F.concat_ws(" ", without_stop_words(word_tokens(collapse_blanks(plain)), ()))


def with_bigrams(tokens: Column) -> Column:
    """Tokens, then each two neighbours as one term."""
    pairs = F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(tokens) > 1, F.concat(tokens, pairs)).otherwise(tokens)


def word_runs(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_id(c: Column) -> Column:
    """Letters and digits only, upper case."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]+", ""))


def looks_like_id(key: Column) -> Column:
    return (F.length(key) >= 6) & key.rlike("[0-9]")


def truncated(c: Column, limit: int = 300) -> Column:
    """At most ``limit`` characters; a longer text loses blanks at the cut and gets three points."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit)), F.lit("...")))


def short_hash(c: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def register(spark) -> None:
    """Make the text functions callable from SQL as temporary SQL functions."""
    for name in _SQL_BODIES:
        kind = "ARRAY<STRING>" if name == "preprocess" else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION corvane_{name}(s STRING) RETURNS {kind} RETURN {_SQL_BODIES[name]}")


_CLEAN_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(s, '')), r'(?U)\b\w++://\S+|@[A-Za-z0-9_]+', ' '), r'(?<=[A-Za-z0-9])[-‐-—](?=[A-Za-z0-9])', ''), r'(?<=[0-9])[.,](?=[0-9])', ''), r'[^0-9A-Za-z \t]', ' '), r'\s+', ' '))"
_TOKENS_SQL = _CLEAN_SQL
for _w, _two in SPLIT_WORDS.items():
    _TOKENS_SQL = rf"regexp_replace({_TOKENS_SQL}, r'\b{_w}\b', '{_two}')"
_SQL_BODIES = {
    "clean_text": _CLEAN_SQL,
    "normalize_id": "upper(regexp_replace(s, '[^A-Za-z0-9]+', ''))",
    "preprocess": f"filter(split({_TOKENS_SQL}, ' '), t -> length(t) >= 2 AND t NOT IN ({', '.join(repr(w) for w in STOP_WORDS if w not in KEEP_WORDS)}))",
}
