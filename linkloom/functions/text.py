"""Tokenization as column expressions.

* tokens: lower-cased runs of >= 2 letters/digits/underscore.  The class
  ``[\\p{L}\\p{N}_]`` equals the Unicode ``\\w`` of a ``(?U)\\b\\w\\w+\\b`` tokenizer and
  reads the same in Java regex and RE2, so the SQL oracle uses the same string.
* stop words are removed *before* n-grams are formed (bigrams join the
  surviving neighbours).  Default list: Spark's own English list (181 words,
  the one ``StopWordsRemover`` uses); pass any list to override.
"""

from __future__ import annotations

import functools
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


@functools.lru_cache(maxsize=1)
def spark_stop_words() -> tuple:
    """Spark's built-in English list, shipped as package data: reading it needs
    neither a session nor the location of Spark's jars."""
    return tuple(resources.files("linkloom.functions").joinpath("stop_words_english.txt").read_text("utf-8").split())


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(text) -> Column:
    """ARRAY<STRING> of lower-cased tokens in document order."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(TOKEN_RE), 0)


def remove_stop_words(tokens, stops=None) -> Column:
    """drop stop words (membership test becomes a hash-set lookup)."""
    stops = spark_stop_words() if stops is None else tuple(stops)
    if not stops:
        return _c(tokens)
    return F.filter(_c(tokens), lambda t: ~t.isin(*stops))


def ngrams_1_2(tokens) -> Column:
    """unigrams followed by adjacent bigrams ("a b")."""
    t = _c(tokens)
    n = F.size(t)
    m = F.greatest(n - 1, F.lit(0))
    bigrams = F.zip_with(F.slice(t, 1, m), F.slice(t, 2, m), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(t, F.when(n >= 2, bigrams).otherwise(F.array().cast("array<string>")))


def terms(text, stops=None, ngram_max: int = 2) -> Column:
    toks = remove_stop_words(tokenize(text), stops)
    return ngrams_1_2(toks) if ngram_max >= 2 else toks
