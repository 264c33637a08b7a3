"""Identifiers of documents in one comparable form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, the same set everywhere (see functions.text.WS).
_EDGE = r"^[\s\x1c-\x1f\x85\p{Z}\x{FEFF}\x{200B}]+|[\s\x1c-\x1f\x85\p{Z}\x{FEFF}\x{200B}]+$"


def canonical_pmid(raw: Column) -> Column:
    """One text per document identifier.

    Numbers are equal if they denote the same number however written (label ``PMID`` before it, leading zeros, a
    fraction of zeros, an exponent, surrounding space); they come out as their digits. Any other identifier is equal
    only to itself apart from surrounding space and keeps its spelling. NULL, blank and ``None`` refer to nothing: NULL.
    """
    plain = raw.rlike(r"^[1-9][0-9]{0,18}$")  # most are; the rest goes through the patterns below
    return F.when(plain, raw).otherwise(_canonical(raw))


def _canonical(raw: Column) -> Column:
    t = F.regexp_replace(raw, _EDGE, "")
    digits = F.regexp_replace(t, r"(?i)^(?:pmid[\s\p{Z}]*[:#.=]?[\s\p{Z}]*)?\+?0*(\d+?)(?:\.0*)?$", "$1")
    power = F.when(digits.rlike(r"^\+?\d+(\.\d+)?[eE]\+?\d{1,2}$"), digits).try_cast("decimal(38,6)")
    whole = F.when(power == F.floor(power), F.floor(power).cast("string"))
    return F.when(~digits.isin("", "None"), F.coalesce(whole, digits))
