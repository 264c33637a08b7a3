"""Text expressions: normal forms, words, character sets and the fuzzy comparisons built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One character of white space, as text handling in most languages has it; plain ``\s`` misses some of these.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
# Words that the fuzzy comparison leaves out.
COMMON_WORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "with", "by")
#: Share of common characters from which two texts count as alike.
ALIKE = 0.8


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def key(c: Column) -> Column:
    """Lower case without surrounding white space: the form in which entities are compared."""
    return F.lower(strip(c))


def _dashes(c: Column) -> Column:
    return F.regexp_replace(c, "[–—]", "-")


def normalize_surface(c: Column) -> Column:
    """White space collapsed, long dashes as hyphens, stripped; NULL gives the empty text."""
    return F.coalesce(strip(_dashes(F.regexp_replace(c, f"{SPACE}+", " "))), F.lit(""))


def normalize_for_match(c: Column) -> Column:
    """As :func:`normalize_surface` in lower case; the form of the evaluation."""
    return F.coalesce(_dashes(F.regexp_replace(F.lower(strip(c)), f"{SPACE}+", " ")), F.lit(""))


def words(c: Column) -> Column:
    """Words between white space, none of them empty; NULL gives no words."""
    return F.coalesce(F.filter(F.split(c, f"{SPACE}+"), lambda w: w != ""), F.array().cast("array<string>"))


def characters(c: Column) -> Column:
    """The set of characters."""
    return F.filter(F.array_distinct(F.split(c, "")), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common characters of two texts; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(characters(a), characters(b))), F.size(F.array_union(characters(a), characters(b)))), F.lit(0.0))


def contained(a: Column, b: Column) -> Column:
    """One contains the other; the empty text is contained in any."""
    return F.contains(a, b) | F.contains(b, a)


def _content(c: Column) -> Column:
    return F.array_join(F.filter(words(c), lambda w: ~F.lower(w).isin(*COMMON_WORDS)), " ")


def fuzzy(a: Column, b: Column, threshold: float = ALIKE) -> Column:
    """Character sets alike once common words are left out; never if one side has nothing left."""
    x, y = F.lower(_content(a)), F.lower(_content(b))
    return (x != "") & (y != "") & (jaccard(x, y) >= threshold)


def matches_reference(a: Column, b: Column, threshold: float = ALIKE) -> Column:
    """The evaluation's comparison of two texts in the form of :func:`normalize_for_match`: equal, contained or alike."""
    return (a == b) | contained(a, b) | (jaccard(a, b) >= threshold)


def bounded_pattern(alias: Column) -> Column:
    """A regular expression for the alias between word boundaries, any letter case."""
    return F.concat(F.lit(r"(?iU)\b\Q"), F.replace(strip(alias), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b"))


def occurs(text: Column, alias: Column) -> Column:
    """The alias occurs in the text between word boundaries, in any letter case; a blank alias never does.

    A plain search in a common letter case comes first, so that patterns, compiled row by row, are only tried where the
    alias is there at all.
    """
    plain = lambda c: F.lower(F.upper(c))
    return (strip(alias) != "") & F.contains(plain(text), plain(strip(alias))) & F.regexp_like(text, bounded_pattern(alias))


def preview(c: Column, limit: int = 200) -> Column:
    """The first characters, with dots if there are more."""
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)
