"""Keyword lists and stop-word lists.

A production keyword list (hundreds of multilingual words with concept and
language) is an input table read with :func:`read_keywords`; the lists below
are the fixed stand-ins that hit the driver's invented prose and part names.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lintel.sources.files import read_table
from lintel.sources.stopwords import LISTS

KEYWORD_SCHEMA = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("concept", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("literal_translation", T.StringType()),
])

# Stand-in keyword list for the `documents` table, as
# (word, concept, language).  One, two and three-word entries, accented
# words, and one word listed under two languages.
DOCUMENT_KEYWORDS = (
    ("worthless", "quality", "en"),
    ("that", "function", "en"),
    ("of the", "function", "en"),
    ("one of the", "function", "en"),
    ("it is", "function", "en"),
    ("pour", "function", "fr"),
    ("avec", "function", "fr"),
    ("en", "function", "fr"),
    ("sich", "function", "de"),
    ("von der", "function", "de"),
    ("que", "function", "es"),
    ("en", "function", "es"),
    ("por la", "function", "es"),
    ("éeau", "invented", "fr"),
    ("ére", "invented", "fr"),
    ("èaux", "invented", "fr"),
)

# Stand-in keyword list for the fact table's text columns
# (part names, market segments, brands).
FACT_KEYWORDS = ("red", "small gizmo", "hot gear", "household", "brand")

# The short basic list used for plain substring filtering.
BASIC_KEYWORDS = ("worthless", "pour", "sich", "éeau")

# The four stop-word languages used by the term ranking.
STOPWORD_LANGUAGES = ("english", "spanish", "french", "german")


def document_keywords() -> list[str]:
    return [w for w, _, _ in DOCUMENT_KEYWORDS]


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Keyword table from a header CSV (word, concept, language, translation)."""
    return read_table(spark, path, KEYWORD_SCHEMA)


@lru_cache(maxsize=None)
def stopwords(languages: tuple[str, ...] = STOPWORD_LANGUAGES) -> tuple[str, ...]:
    """Union of the stop-word lists of ``languages``, sorted."""
    return tuple(sorted({w for lang in languages for w in LISTS[lang]}))
