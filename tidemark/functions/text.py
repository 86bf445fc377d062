"""Text normalisation, tokens and n-grams. All native but HTML unescaping with NFKC, which has no built-in."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of at least two characters that begin with a letter.
TOKEN = r"(?U)\b[^\W\d_][\w-]+\b"
#: The same without look-around at the ends, for engines whose \b is ASCII.
PORTABLE_TOKEN = r"[\p{L}][\p{L}\p{N}_-]+"
#: The usual default of bag-of-words baselines: two word characters or more.
BASELINE_TOKEN = r"(?U)\b\w\w+\b"


def decoded(text: Column) -> Column:
    """HTML references resolved, then Unicode NFKC; null stays null."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: None if s is None else unicodedata.normalize("NFKC", html.unescape(s)))

    return run(text)


def title_key(title: Column, decode: bool = True) -> Column:
    """Dedupe key: decoded, lower case, punctuation and symbols as spaces, white space collapsed.

    ``decode=False`` skips the one Python step where texts are known to hold no references.
    """
    text = decoded(title) if decode else title
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}]", " "), r"(?U)\s+", " "))


def clean(text: Column) -> Column:
    """For TF-IDF: no URLs, no $TICKER, lower case, single spaces."""
    text = F.regexp_replace(text, r"(?i)(?:https?://|www\.)\S+", " ")
    text = F.regexp_replace(text, r"\$[A-Za-z]{1,5}\b", " ")
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def stop_words(language: str = "english") -> list[str]:
    """The list that Spark ships."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(language)


def tokens(text: Column, pattern: str = TOKEN, stop: list[str] | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def ngrams(words: Column, lo: int = 1, hi: int = 2) -> Column:
    """All n-grams of lo to hi words, joined by a space; stop words are removed before. ``words`` should be a plain column: it is read once an n-gram."""

    def of(n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))

    parts = [of(n) for n in range(lo, hi + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]
