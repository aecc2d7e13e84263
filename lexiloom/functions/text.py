"""Text clean-up, normalization and tokenizing as Column builders (all run inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the topic pipeline.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they "
    "this to was will with we our you your from can may might should would also than which while where when who "
    "whom what how do does did done using use used via based results result table figure fig section introduction "
    "related work conclusion references paper study studies analysis method methods approach approaches data dataset "
    "datasets model models task tasks problem problems"
).split()
#: Bibliography words.
BIBLIOGRAPHY = (
    "arxiv ieee acm proceedings conference workshop symposium journal transactions doi isbn issn pp vol volume issue "
    "pages page cvpr iccv eccv neurips nips icml iclr aaai ijcai acl emnlp naacl coling kdd icdm"
).split()
#: Short tokens that are kept, fragments of broken words, interrogatives, lexicon stop words.
KEEP_SHORT = "ai ml dl cv rl nn".split()
FRAGMENTS = "ure ble nal ver".split()
INTERROGATIVES = "what which how why when where is are can do does did could would should who whom whose".split()
LEXICON_STOPWORDS = "a an and are as at be by for from in is of on or the to with".split()
#: Patterns of the three tokenizers, of URLs and of e-mail addresses.
TOPIC_TOKEN = r"[a-z][a-z\-]{1,}"
K_TOKEN = r"[a-z][a-z0-9\-]{2,}"
WORD_TOKEN = r"[\p{L}\p{N}_]+"
URL = r"https?://\S+|www\.\S+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def collapse_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def normalize_text(x: Column) -> Column:
    """One line: every kind of space becomes one blank, control characters go."""
    y = F.regexp_replace(F.coalesce(x, F.lit("")), r"[  -​  　\t\r\n]+", " ")
    y = F.regexp_replace(collapse_space(y), r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", "")
    return collapse_space(y)


def bound(x: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def joined_words(x: Column) -> Column:
    """Soft hyphens go, dashes are one kind, words that were split at a hyphen and white space join. The pattern begins at the
    hyphen, as one that begins with a word is tried at each of its letters; a word that was joined is the first half of no other."""
    y = F.replace(x, F.lit("\u00ad"), F.lit(""))
    for dash in "‐‒–—−":
        y = F.replace(y, F.lit(dash), F.lit("-"))
    word = r"[\p{L}\p{N}_]"
    return F.regexp_replace(y, rf"-(?<={word}-)(?<!\G-)\s+({word}+)", "$1")


def fix_hyphenation(x: Column) -> Column:
    """Words are joined, and white space with a line end is one blank."""
    return F.regexp_replace(joined_words(x), r"\s*\n\s*", " ")


def without_addresses(x: Column) -> Column:
    """No zero bytes, URLs and e-mail addresses; what holds no sign of them isn't searched."""
    y = F.replace(x, F.lit("\0"), F.lit(" "))
    y = bound(y, lambda v: F.when(F.contains(v, F.lit("http")) | F.contains(v, F.lit("www.")), F.regexp_replace(v, URL, " ")).otherwise(v))
    from_start = rf"(?:\G|(?<![A-Za-z0-9._%+-])){EMAIL.replace(']+@', ']++@')}"  # not tried again inside a run of such characters
    return bound(y, lambda v: F.when(F.contains(v, F.lit("@")), F.regexp_replace(v, from_start, " ")).otherwise(v))


def clean_text(x: Column) -> Column:
    return without_addresses(fix_hyphenation(x))


def clean_markdown(x: Column) -> Column:
    """Code goes, links leave their text."""
    y = F.regexp_replace(F.regexp_replace(x, r"```[\s\S]*?```", " "), r"`[^`]+`", " ")
    return F.regexp_replace(y, r"\[([^\]]+)\]\(([^)]+)\)", "$1")


def find_all(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def topic_tokens(x: Column) -> Column:
    """Tokens of the topic pipeline: cleaned (kinds of white space tell no tokens apart), stop words and one-letter rests removed."""
    raw = F.transform(find_all(without_addresses(joined_words(F.lower(x))), TOPIC_TOKEN), lambda t: F.trim(t, F.lit("-")))
    return F.filter(raw, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))


def kept_tokens(tokens: Column, least: int = 3) -> Column:
    """Rules of the vocabulary: no bibliography words, none that is short unless listed."""
    return F.filter(tokens, lambda t: ~t.isin(BIBLIOGRAPHY) & ((F.length(t) >= least) | t.isin(KEEP_SHORT)))


def k_tokens(x: Column) -> Column:
    return find_all(clean_markdown(F.lower(x)), K_TOKEN)


def word_tokens(x: Column) -> Column:
    return find_all(x, WORD_TOKEN)


def ngrams(tokens: Column, n: int, separator: str = "_") -> Column:
    """Runs of n tokens. The array is zipped with itself moved on, so it isn't read anew for each
    element, which an index into it inside a lambda would do."""
    joined = tokens
    for k in range(1, n):
        joined = F.zip_with(joined, F.slice(tokens, k + 1, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat(a, F.lit(separator), b))
    return F.slice(joined, 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0)))


def vw_token(x: Column) -> Column:
    """Token for the Vowpal Wabbit format."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)[:|\s]|[^\x20-\x7E]", "_"), "^_+|_+$", "")


def normalize_cq(x: Column) -> Column:
    """Plain quotes, single blanks, no trailing period unless it is a question, lower case."""
    y = F.translate(F.trim(x), "’“”", "'\"\"")
    y = F.regexp_replace(y, r"(?U)\s+", " ")
    return F.lower(F.when(y.endswith(".") & ~y.contains("?"), F.substring(y, F.lit(1), F.length(y) - 1)).otherwise(y))


def split_camel(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-]+", " ")


def local_name(iri: Column) -> Column:
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def slug(x: Column, most: int = 200) -> Column:
    return F.left(F.regexp_replace(F.trim(x), r"[^A-Za-z0-9_\-]+", "_"), F.lit(most))


def heading_anchor(x: Column) -> Column:
    y = F.regexp_replace(F.lower(F.trim(x)), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(y, r"[_\s]+", "-"), "-+", "-"), "^-+|-+$", "")


def is_ocr_noise(x: Column, threshold: float = 0.5) -> Column:
    """Fewer letters than the share; empty text is noise."""
    y = F.coalesce(x, F.lit(""))
    letters = F.length(F.regexp_replace(y, r"\P{L}", ""))
    return (F.length(y) == 0) | (letters / F.greatest(F.length(y), F.lit(1)) < threshold)


def clean_str(x: Column) -> Column:
    """Trimmed text; empty, ``nan``, ``none`` and ``null`` are missing."""
    y = F.trim(x.cast("string"))
    return F.when(~F.lower(y).isin("", "nan", "none", "null"), y)


def once(x: Column) -> Column:
    """A value that takes long, computed once a row: filters and projections that read it stay above the
    generator instead of copying it."""
    return F.explode_outer(F.array(x))
