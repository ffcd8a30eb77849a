"""Text keys, terms and Markdown escapes. The text itself is never changed; keys are kept beside it."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quotes and dashes that compare as one, characters that Markdown would read, and term shapes.
FOLD_FROM = "\u2018\u2019\u201c\u201d\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
FOLD_TO = "''\"\"-------"
INLINE = r"([\\`*_\[\]<>|])"
SPOKEN_TERM = r"[A-Za-z][A-Za-z0-9_.\-]{3,}"
SHOWN_TERM = r"[A-Za-z][A-Za-z0-9_.\-]{2,}"
TECHNICAL = r"[_.\-0-9]|[a-z][A-Z]"

# Common words that are never terms of speech.
COMMON = (
    "about after again also another because before being between both could different does doing down each even every"
    " first from going have here into just know like little look make many more most much need now only other over part"
    " really right same say see should some start still such sure take than that their them then there these they thing"
    " think this those through time under very want well what when where which while will with work would your actually"
    " basically something everything"
).split()
# Common words that are never entries of the term index.
STOPWORDS = (
    "the and for with this that you your from are was were has have not but can will how what when where which into out"
    " get set use using all any more than then one two new our about after again also another back because been before"
    " being both come could did does doing done down each else even every far few find first give going good great had"
    " here his her hey important its just keep kind know last least left less let like little long look lot make many"
    " may mean might most much must need never next nice now off okay once only other over own part put quite rather"
    " really right said same say see seen should show side simple since some sort start still stuff such sure take tell"
    " them there these they thing things think those though three through time times too took under until very want"
    " watch way well went were whole why without work would yes yet actually basically something everything anything"
    " nothing someone everyone always already almost enough"
).split()


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form, which Spark has no function for."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity by longest matching blocks, as Python's difflib has it."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def _outer(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\A\n+", ""), r"\n+\z", "")


def code_key(text: Column) -> Column:
    """Key of code: line ends as \\n, trailing blanks of lines and outer line breaks gone, all else kept."""
    return _outer(F.regexp_replace(_lines(text), r"(?md)[ \t]+$", ""))


def prose_key(text: Column, normalize=nfkc) -> Column:
    """Key of prose: compatibility form, quotes and dashes folded, blanks collapsed, lines trimmed."""
    folded = F.translate(normalize(_lines(text)), FOLD_FROM, FOLD_TO)
    narrow = F.regexp_replace(folded, "[ \\t\u3000]+", " ")
    return _outer(F.regexp_replace(narrow, r"(?mdU)^[^\S\n]+|[^\S\n]+$", ""))


def utterance_key(text: Column, normalize=nfkc) -> Column:
    """Key that finds one utterance in two recordings: punctuation and case do not count."""
    narrow = F.regexp_replace(normalize(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")), "[ \\t\u3000]+", " ")
    return F.lower(F.regexp_replace(narrow, "[、。,.!?！？…]+", ""))


def spoken_terms(text: Column, vocabulary: Column | None = None) -> Column:
    """Lower-cased terms of an utterance: of technical shape, or in the vocabulary."""
    found = F.regexp_extract_all(text, F.lit(f"({SPOKEN_TERM})"), 1)
    low = lambda x: F.lower(x)
    fit = lambda x: ~low(x).isin(COMMON) & (x.rlike(TECHNICAL) | (F.array_contains(vocabulary, low(x)) if vocabulary is not None else F.lit(False)))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, fit), low)))


def shown_words(text: Column) -> Column:
    """Lower-cased words of a screen, common ones aside."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({SPOKEN_TERM})"), 1), F.lower)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~x.isin(COMMON))))


def index_terms(text: Column) -> Column:
    """Distinct surface forms of a screen that may enter the term index."""
    found = F.regexp_extract_all(text, F.lit(f"({SHOWN_TERM})"), 1)
    fit = lambda x: (F.length(x) >= 4) & ~F.lower(x).isin(STOPWORDS) & (x.rlike(TECHNICAL) | x.rlike("^[A-Z]"))
    return F.array_distinct(F.filter(found, fit))


def substring_count(text: Column, part: Column) -> Column:
    """Occurrences of a part that do not overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def material_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of the trimmed, non-empty lines of two bodies; 0 if either has none."""
    lines = lambda x: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), lambda y: F.regexp_replace(y, r"(?U)\A\s+|\s+\z", "")), lambda y: y != ""))
    la, lb = lines(a), lines(b)
    return F.when((F.size(la) == 0) | (F.size(lb) == 0), 0.0).otherwise(F.size(F.array_intersect(la, lb)) / F.size(F.array_union(la, lb)))


def escape_markdown(text: Column) -> Column:
    """Text that Markdown shows as it stands: inline marks everywhere, block marks at the start of a line."""
    inline = F.regexp_replace(text, INLINE, r"\\$1")
    return F.regexp_replace(inline, r"(?m)^([^\S\n]*)([#\-+=]|\d+[.)])", r"$1\\$2")


def fence(text: Column) -> Column:
    """Back-ticks enough to enclose the text."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def line_changes(current: Column, previous: Column, samples: int = 3, width: int = 60) -> Column:
    """Lines that came and went, repeats counted, with the first few of each."""
    now, was = F.split(current, "\n"), F.split(previous, "\n")
    came = F.filter(now, lambda x: (F.trim(x) != "") & ~F.array_contains(was, x))
    went = F.filter(was, lambda x: (F.trim(x) != "") & ~F.array_contains(now, x))
    few = lambda x: F.array_join(F.transform(F.slice(x, 1, samples), lambda y: F.substring(y, 1, width)), " / ")
    return F.struct(F.size(came).alias("added"), F.size(went).alias("removed"), few(came).alias("added_lines"), few(went).alias("removed_lines"))


@F.pandas_udf(T.StringType())
def time_link(path: pd.Series, seconds: pd.Series) -> pd.Series:
    """Percent-encoded path with a time fragment."""
    from urllib.parse import quote

    return pd.Series([None if p is None else f"{quote(p.replace(chr(92), '/'), safe='/:')}#t={s:.3f}" for p, s in zip(path, seconds, strict=True)])
