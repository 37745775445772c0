"""Sentence splitting of clinical prose as one marked regular expression, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a period that ends no sentence may stand behind (fixed values).
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "prof", "fig", "no", "vs", "et al", r"e\.g", r"i\.e")
#: White space as browsers take it.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: Up to so many initials in a row are looked back on.
_INITIALS = 19
#: Only where one stands is anything looked back on: . ? or ! with closing quotes before a space or the end; not a period behind an abbreviation or behind two initials or more.
STOP = rf"""(?=[.?!])(?:(?<!(?i:{"|".join(ABBREVIATIONS)}))(?<!(?:^| )(?:[A-Za-z]\.){{1,{_INITIALS}}}[A-Za-z])\.|[?!])["'’”)\]}}]*(?= |$)"""
_MARK = "\u0001"


def sentences(text: Column) -> Column:
    """Sentences of a text, white space collapsed; a null text has none. Decimals have no space after theirs, so they end nothing."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _MARK, " "), SPACE, " "))
    return F.filter(F.transform(F.split(F.regexp_replace(plain, STOP, f"$0{_MARK}"), _MARK), lambda s: F.trim(s)), lambda s: s != "")


def with_sentences(rows: DataFrame, column: str = "text", out: str = "sentences") -> DataFrame:
    """rows with an array of the sentences of a column."""
    return rows.withColumn(out, sentences(rows[column]))
