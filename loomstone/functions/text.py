"""Text and key functions over columns. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks between values that a user typed into one field (fixed values).
MULTI_VALUE = "[·,;\\n]"
#: Answers that mean nothing was entered (fixed values).
BLANK_ANSWERS = ("", "없음", "없어요", "모름", "모르겠어요", "해당없음", "-")
#: Words that content_tokens leaves out (fixed values).
STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "were", "was", "are", "from",
    "have", "has", "had", "not", "but", "than", "into", "also", "may", "can",
    "results", "conclusions", "background", "methods", "objective", "study",
    "patients", "group", "groups", "among", "between", "after", "before",
)


NUMBER = "([0-9]+(?:[.,][0-9]+)*)"


def word_pattern(words: str) -> str:
    """A pattern for whole ASCII words that Java and RE2 read alike."""
    return f"(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)"


def normalize_doi(doi: Column) -> Column:
    """Lowered, without resolver or doi: prefix, white space of any kind and final punctuation."""
    bare = F.regexp_replace(F.lower(doi), r"(?U)^\s*(https?://(dx\.)?doi\.org/|doi:)?|\s+", "")
    return F.regexp_replace(bare, "[.,;]+$", "")


def paper_identity(doi: Column, title: Column, record_id: Column) -> Column:
    """doi:..., else title:... (exact), else pmid:...; blank counts as missing."""
    bare = normalize_doi(F.coalesce(doi, F.lit("")))
    return F.when(bare != "", F.concat(F.lit("doi:"), bare)).when(F.trim(F.coalesce(title, F.lit(""))) != "", F.concat(F.lit("title:"), title)).otherwise(F.concat(F.lit("pmid:"), record_id.cast("string")))


def canonical_term(term: Column) -> Column:
    """A search term without field tag and quotes, lowered, hyphens and runs of space as one space."""
    bare = F.regexp_replace(term, r"\[[^\]]*\]", "")
    return F.trim(F.regexp_replace(F.replace(F.lower(F.replace(bare, F.lit('"'), F.lit(""))), F.lit("-"), F.lit(" ")), r"\s+", " "))


def normalized_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9가-힣]+", " "))


def content_tokens(text: Column) -> Column:
    """Distinct lower-case words of over three characters that aren't stop words, in order of appearance."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS)))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common elements over the smaller set's size; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters of text (code units below 65536), as a long."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(F.split(text, ""), F.lit(2166136261).cast("long"), step)


def rotation_key(seed: str | Column, key: Column) -> Column:
    """A position in [0, 1) that seed and key fix."""
    own = F.concat(seed if isinstance(seed, Column) else F.lit(seed), F.lit("|"), key.cast("string"))
    return fnv1a(own) / F.lit(4294967296.0)


def split_multi_value(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, MULTI_VALUE), lambda v: F.trim(v)), lambda v: v != ""))


def join_multi_value(values: Column) -> Column:
    return F.array_join(values, " · ")


def toggle_value(values: Column, value: str, exclusive: tuple[str, ...] = ()) -> Column:
    """values with value taken out if it is there, else added; an exclusive value stands alone."""
    others = reduce(lambda v, x: F.array_remove(v, x), exclusive, values)
    added = F.array(F.lit(value)) if value in exclusive else F.array_append(others, F.lit(value))
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(added)


def is_blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))).isin(*BLANK_ANSWERS)


def read_field(text: Column, most: int = 120) -> Column:
    """Runs of space collapsed; empty where null or longer than most characters."""
    short = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(short) > most, "").otherwise(short)


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text (digits with points or commas between), commas removed."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), 1)
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(""))))


def pattern_list(text: Column, pattern: str, most: int = 8) -> Column:
    """The first distinct matches of a pattern's group 1, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1)), 1, most)


def sentence_quality(sentence: Column, title_only: Column) -> Column:
    """What a sentence offers as a finding: result marks, digits, direction words, length; titles alone count against."""
    lower = F.lower(sentence)
    return (
        F.when(lower.rlike(r"^(results?|conclusions?|findings?)\b"), 1.5).otherwise(0.0)
        + F.when(sentence.rlike(r"(^|[^A-Za-z])[0-9]"), 1.0).otherwise(0.0)
        + F.when(lower.rlike("increase|decrease|reduc|associat|risk|higher|lower|significant"), 1.0).otherwise(0.0)
        + F.when(F.length(sentence) >= 90, 0.5).otherwise(0.0)
        - F.when(title_only, 2.0).otherwise(0.0)
    )


def first_match(text: Column, cases: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern found in text."""
    out = F.lit(default)
    for pattern, name in reversed(cases):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def near(a: Column, b: Column, most: int) -> Column:
    """Some position of array a is within most of some position of array b."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= most))


def flagged(flags: dict[str, Column], default: str | None = None) -> Column:
    """The names of true flags, in order; [default] if none is."""
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())), lambda x: x.isNotNull())
    return F.when(F.size(names) == 0, F.array(F.lit(default))).otherwise(names) if default else names


def first_line(text: Column) -> Column:
    """What stands before the first line break: the title of a document."""
    return F.substring_index(text, "\n", 1)


def canonical_hash(*columns: Column) -> Column:
    """SHA-256 of the columns as text with | between."""
    return F.sha2(F.concat_ws("|", *(c.cast("string") for c in columns)), 256)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it: functions over arrays aren't compiled, so what is alike in them is computed again each time."""
    return F.transform(F.array(value), use)[0]


def once(rows: DataFrame, name: str, flags: dict[str, Column], together: int = 24, known: Column | None = None) -> tuple[DataFrame, SimpleNamespace]:
    """rows with the flags (null is false) in array columns of at most `together`, and the flags as their elements.

    known is an array: where its first element is false, the others are the flags, which aren't computed then.

    Each array comes out of a generator of one row, so neither projections nor filters above it are merged with the patterns below: a flag is computed once whatever uses
    it. Arrays are short enough for a generator's code to be compiled, and few enough for the row to be.
    """
    found, names = {}, list(flags)
    for k in range(0, len(names), together):
        column, some = f"{name}{k // together}", names[k : k + together]
        values = F.array(*(F.coalesce(flags[n], F.lit(False)) for n in some))
        values = values if known is None else F.when(known[0], values).otherwise(F.slice(known, k + 2, len(some)))
        rows = rows.select("*", F.explode(F.array(values)).alias(column))
        found |= {n: F.col(column)[i] for i, n in enumerate(some)}
    return rows, SimpleNamespace(**found)
