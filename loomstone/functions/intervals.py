"""All matches of a pattern in a text as intervals of characters, and what lies near them; columns alone.

Patterns are read as the screening rules mean them: any case, Unicode words and digits, and a dot that stops at line feeds only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.text import let

#: Flags put before each pattern.
FLAGS = "(?iUd)"
_OPEN, _CLOSE = "\u0001", "\u0002"


def found(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs; false for null."""
    return F.coalesce(text.rlike(FLAGS + pattern), F.lit(False))


def without(text: Column, *patterns: str) -> Column:
    """text with all matches of each pattern in turn cut out."""
    for pattern in patterns:
        text = F.regexp_replace(text, FLAGS + pattern, "")
    return text


def stripped(text: Column) -> Column:
    """text without white space at its ends; null is empty. Only a text that has some there is searched as a whole."""
    cut = lambda t: F.when(F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1))).rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).otherwise(t)
    return let(F.coalesce(text, F.lit("")), cut)


def intervals(text: Column, pattern: str) -> Column:
    """(start, end) of every match in order, half-open, in characters from 0; null for null.

    Matches are marked in one pass and the text is cut at the marks; lengths of the parts add up to the starts.
    """
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, "  "), f"{FLAGS}(?:{pattern})", f"{_OPEN}$0{_CLOSE}")
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(so_far: Column, part: Column) -> Column:
        at = so_far["at"]
        span = F.struct(at.alias("start"), (at + F.instr(part, _CLOSE) - 1).alias("end"))
        return F.struct((at + F.length(part) - 1).alias("at"), F.concat(so_far["found"], F.array(span)).alias("found"))

    def added(parts: Column) -> Column:
        first = F.struct(F.length(parts[0]).alias("at"), none.alias("found"))
        return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), first, add, lambda done: done["found"])

    return let(F.split(marked, _OPEN), added)


def any_window(text: Column, spans: Column, context: str, reach: int) -> Column:
    """Whether context occurs in some span's window: the span and `reach` characters on either side, as far as the text goes.

    A window is a text of its own, so a word that its edge cuts begins or ends there.
    """

    def window(span: Column) -> Column:
        left = F.greatest(span["start"] - reach, F.lit(0))
        return found(F.substring(text, left + 1, span["end"] + reach - left), context)

    return F.coalesce(F.exists(spans, window), F.lit(False))


def starts_near(first: Column, second: Column, most: int) -> Column:
    """Whether some interval of first starts within most characters of the start of some interval of second.

    Both are merged in order; the nearest pair of different kinds are neighbours there, so each neighbour pair is looked at once.
    """
    kind = lambda spans, k: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind")))

    def close(both: Column) -> Column:
        many = F.greatest(F.size(both) - 1, F.lit(0))
        return F.exists(F.zip_with(F.slice(both, 1, many), F.slice(both, 2, many), lambda a, b: (a["kind"] != b["kind"]) & (b["start"] - a["start"] <= most)), lambda c: c)

    return F.coalesce(let(F.sort_array(F.concat(kind(first, 0), kind(second, 1))), close), F.lit(False))


def concepts_near(text: Column, first: str, second: str, most: int = 900) -> Column:
    """Whether matches of both patterns start within most characters of each other."""
    return starts_near(intervals(text, first), intervals(text, second), most)
