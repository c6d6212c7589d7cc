"""Language of a page: the declared one, else that of its script or its n-grams.

A text whose letters belong at least by half to a script of ``SCRIPTS`` is taken for the
chief language of that script (kana makes Han letters Japanese).  Any other is scored
by the character n-grams of 45 languages (:mod:`leafpress.functions.ngrams`); a text
whose best language leads by too little has none.  A page in a language that is not
among these and does not declare it may have none or a related one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafpress.functions import html as H
from leafpress.functions import ngrams
from leafpress.functions.arrays import let

#: Chief language of a script that words need not part.
SCRIPTS = {
    "am": "Ethiopic", "bn": "Bengali", "bo": "Tibetan", "el": "Greek", "gu": "Gujarati", "he": "Hebrew", "hy": "Armenian", "ka": "Georgian",
    "km": "Khmer", "kn": "Kannada", "ko": "Hangul", "lo": "Lao", "ml": "Malayalam", "my": "Myanmar", "pa": "Gurmukhi", "si": "Sinhala",
    "ta": "Tamil", "te": "Telugu", "th": "Thai", "zh": "Han",
}
#: Kana's share of the letters from which on a text is Japanese.
LEAST_KANA = 1 / 10


def declared_language(html: Column) -> Column:
    """Primary tag of ``<html lang>`` in lower case, NULL if not declared."""
    tag = F.get(H.elements(html, "html"), F.lit(0))
    return F.nullif(F.lower(F.regexp_extract(H.attribute(tag, "lang"), r"^\s*([A-Za-z]{2,3})", 1)), F.lit(""))


def primary_tag(language: str) -> str:
    """What a language name is compared by: ``en`` for ``en-US``."""
    found = re.match(r"\s*([A-Za-z]{2,3})", language)
    return found[1].lower() if found else ""


def _by_script(letters: Column) -> Column:
    """Language of the script that has half of the letters, NULL if none of ``SCRIPTS`` has."""

    def count(*scripts: str) -> Column:
        return F.length(letters) - F.length(F.regexp_replace(letters, "[" + "".join(rf"\p{{Is{s}}}" for s in scripts) + "]+", ""))

    kana = ("Hiragana", "Katakana")
    japanese = (count(*kana) >= LEAST_KANA * F.length(letters)) & (2 * count("Han", *kana) >= F.length(letters))
    found = F.when(japanese, F.lit("ja"))
    for lang, script in SCRIPTS.items():
        found = found.when(2 * count(script) >= F.length(letters), F.lit(lang))
    return found


def by_script(text: Column) -> Column:
    """Language of the script that a text is mostly written in, NULL if words have to tell."""

    def vote(letters: Column) -> Column:
        others = F.length(F.regexp_replace(letters, r"[\p{IsLatin}\p{IsCyrillic}\p{IsArabic}\p{IsDevanagari}]+", ""))
        return F.when((others > 0) & (2 * others >= F.length(letters)), _by_script(letters))

    return let(F.regexp_replace(text, r"[^\p{L}]+", ""), vote)


@F.pandas_udf(StringType())
def by_ngrams(texts: pd.Series) -> pd.Series:
    own = ngrams.profiles()
    return texts.map(own.language, na_action="ignore").astype(object).where(texts.notna(), None)


def told_language(html: Column, text: Column) -> Column:
    """Language that the page declares or that its script tells, NULL where n-grams have to tell."""
    return F.coalesce(declared_language(H.strip_hidden(html)), by_script(text))


def voted_language(text: Column) -> Column:
    """Language of the text by its script or else its n-grams, NULL if neither tells."""
    script = by_script(text)
    return F.coalesce(script, by_ngrams(F.when(script.isNull(), text)))
