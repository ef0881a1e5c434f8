"""Tokens, n-grams and sentences."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Accented Latin letters and what they become.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit("[a-z0-9]+"), F.lit(0))


def plain_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def whole_words(text: Column) -> Column:
    """Runs of a-z and 0-9 between word breaks: one beside any other letter, mark, digit or underscore is none."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{M}\\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z0-9]+$"))


@F.pandas_udf(StringType())
def _unaccented(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")))


def unaccented(text: Column) -> Column:
    """Letters without their marks, whatever the alphabet; null stays null."""
    return _unaccented(text)


def ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), "_"))).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def sentences(text: Column, least: int = 3) -> Column:
    """Pieces ending in . ! ? or a line end, trimmed, of `least` words or more."""
    parts = F.transform(F.split(F.regexp_replace(text, "([.!?])", "$1\n"), "\n"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= least)

