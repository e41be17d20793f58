"""Text expressions: tokenisers, tags, cleaning, intents and lexicon scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The lexicons, stop words and intent patterns of the comment features.
POSITIVE = "amazing awesome best clean cool excellent fire good great helpful impressive love nice perfect solid useful wow".split()
NEGATIVE = "bad broken confusing dislike frustrating hard hate issue messy problem slow stupid terrible unclear useless wrong".split()
STOPWORDS = "a an and are as at be by for from how i in is it me my of on or so that the this to too up we what when where why with you your".split()
INTENTS = [
    ("confusion", [r"\bconfus(ed|ing)\b", r"\b(not sure|dont understand|don't understand)\b", r"\b(what do you mean|which one)\b", r"\b(unclear|lost)\b", r"\?"]),
    ("help_seeking", [r"\bhow\b", r"\bcan you\b", r"\bplease\b", r"\bneed help\b", r"\bshow (me|us)\b", r"\bsteps?\b"]),
    ("purchase_intent", [r"\b(price|cost|buy|link|where to get|checkout)\b", r"\bworth it\b", r"\bdiscount\b"]),
    ("save_intent", [r"\bsaved\b", r"\bsaving\b", r"\bbookmarked\b", r"\bcome back\b"]),
    ("praise", [r"\b(love|great|awesome|amazing|helpful|fire|clean)\b", r"\bthanks\b"]),
    ("complaint", [r"\b(doesn't work|doesnt work|broken|bad|problem|issue)\b", r"\bwaste\b", r"\bunhelpful\b"]),
    ("skepticism", [r"\b(fake|cap|doubt|really\?|sure\?)\b", r"\btoo good to be true\b"]),
    ("off_topic", [r"\b(first|early)\b", r"\bwho else\b", r"\balgorithm\b"]),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(x, least: int = 2) -> Column:
    """Lower-case words between white space and ``# , . / - ? !``, of at least ``least`` characters."""
    return F.filter(F.split(F.regexp_replace(F.lower(_c(x)), r"[#,./?!-]", " "), r"\s+"), lambda w: F.length(w) >= least)


def plain_words(x) -> Column:
    """Lower-case runs of ASCII letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[a-z0-9']+"), F.lit(0))


def unicode_words(x, least: int = 2) -> Column:
    """Distinct lower-case words of any script, in order of appearance."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_c(x)), F.lit(r"(?U)\b\w+\b"), F.lit(0)), lambda w: F.length(w) >= least))


def alnum_words(x) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(_c(x)), r"[^0-9a-z#_]+", " "), " "), lambda w: w != "")


def char_ngrams(x, n: int = 3) -> Column:
    x = _c(x)
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a, b) -> Column:
    """Similarity of two sets, 0 where either is empty."""
    a, b = _c(a), _c(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def tag_jaccard(a, b) -> Column:
    return jaccard(char_ngrams(a), char_ngrams(b))


def hashtags(x) -> Column:
    """Distinct lower-case tags with their #."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(x)), F.lit(r"(?U)#\w+"), F.lit(0)))


def combined_hashtags(caption, listed) -> Column:
    """Tags of the caption, then the listed ones, each once."""
    field = F.transform(F.filter(_c(listed), lambda t: t.isNotNull() & (F.trim(t) != "")), lambda t: F.when(t.startswith("#"), F.lower(t)).otherwise(F.concat(F.lit("#"), F.lower(t))))
    return F.array_distinct(F.concat(hashtags(caption), field))


def clean_caption(x) -> Column:
    """Without URLs, mentions and tags, white space collapsed."""
    x = F.regexp_replace(_c(x), r"https?://\S+|www\.\S+", " ")
    x = F.regexp_replace(x, r"(?U)@\w+", " ")
    x = F.regexp_replace(x, r"(?U)#\w+", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def strip_html(x) -> Column:
    """Visible text of a page: scripts, styles, comments and tags go, common entities are resolved."""
    x = F.regexp_replace(_c(x), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def safe_strip(x, fallback=None) -> Column:
    return F.coalesce(F.nullif(F.trim(_c(x)), F.lit("")), _c(fallback) if fallback is not None else F.lit(None).cast("string"))


def content_words(x, stopwords: Sequence[str] = STOPWORDS) -> Column:
    return F.filter(words(x, 3), lambda w: ~w.isin(list(stopwords)))


def infer_topic(search, tags, caption) -> Column:
    """Search text, else the first tag, else the first word, else ``general``."""
    first_tag = F.nullif(F.trim(F.lower(F.replace(F.get(_c(tags), F.lit(0)), F.lit("#")))), F.lit(""))
    return F.coalesce(F.nullif(F.lower(F.trim(_c(search))), F.lit("")), first_tag, F.get(words(caption), F.lit(0)), F.lit("general"))


def content_type(x, buckets: Sequence[tuple[str, Sequence[str]]], default: str = "general") -> Column:
    """First bucket one of whose substrings the text holds."""
    low, out = F.lower(_c(x)), None
    for name, terms in buckets:
        hit = None
        for t in terms:
            hit = low.contains(t) if hit is None else hit | low.contains(t)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def normalised(x) -> Column:
    """Lower case, with only word characters, ``# @ ?`` and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"(?U)[^\w\s#@?]+", " "), r"\s+", " "))


def intent(x, intents: Sequence[tuple[str, Sequence[str]]] = INTENTS, default: str = "off_topic") -> Column:
    """The first intent, in order of priority, one of whose patterns occurs."""
    text, out = normalised(x), None
    for name, patterns in intents:
        hit = text.rlike("|".join(f"(?:{p})" for p in patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def sentiment(x, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """(positive - negative) / words over distinct words, in -1..1."""
    w = unicode_words(x)
    n = lambda terms: F.size(F.filter(w, lambda t: t.isin(list(terms))))
    return F.when(F.size(w) == 0, 0.0).otherwise((n(positive) - n(negative)) / F.size(w))


def normalise_language(x) -> Column:
    """Two or three letters before a region, lower case; null where there are none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(_c(x)), r"^([A-Za-z]{2,3})([-_].*)?$", 1)), F.lit(""))


def redact_url(x) -> Column:
    """Credentials of a connection URL hidden."""
    return F.regexp_replace(_c(x), r"//[^/@\s]+@", "//***@")


def normalise_url(x) -> Column:
    """Lower-case scheme and host, no query, fragment or trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(_c(x)), r"[?#].*$", ""), "/+$", "")
    host = F.regexp_extract(bare, r"^([A-Za-z]+://[^/]+)", 1)
    return F.concat(F.lower(host), F.substr(bare, F.length(host) + 1))


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility normalisation, and names in place of emoji; the only text step without a built-in."""

    def one(s):
        if s is None:
            return None
        s = unicodedata.normalize("NFKC", s)
        return "".join(f":{unicodedata.name(c, 'symbol').lower().replace(' ', '_')}:" if unicodedata.category(c) == "So" else c for c in s)

    return x.map(one)
