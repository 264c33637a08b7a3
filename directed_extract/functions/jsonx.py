"""JSON text as VARIANT columns: strict parsing and the lenient readings the pipeline needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: the session setting by which the parser keeps the last value of a key that an object names twice.
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it.

    Plans stay small: written out, an expression that names its input four times grows by a power of four with each level.
    """
    return F.transform(F.array(value), use)[0]


def parse_strict(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else, otherwise NULL.

    The parser alone accepts text after the value. In brackets such text is an error or a second element. Of a key that
    an object names twice the last value counts; the active session's setting for that is turned on.
    """
    if (spark := SparkSession.getActiveSession()) is not None and spark.conf.get(REPEATED_KEYS) != "true":
        spark.conf.set(REPEATED_KEYS, "true")
    v = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return let(v, lambda x: F.when(F.try_variant_get(x, "$[1]", "variant").isNull(), F.try_variant_get(x, "$[0]", "variant")))


def parse_object(raw: Column) -> Column:
    """VARIANT of a text that is one JSON object and nothing else, otherwise NULL.

    Blank, cut off, single-quoted or otherwise invalid text and other JSON values give NULL.
    """
    trimmed = F.regexp_replace(raw, r"(?s)^[\s\x{FEFF}]*(\{.*\})\s*$", r"$1")
    return parse_strict(F.when(trimmed.startswith("{") & trimmed.endswith("}"), trimmed))


def kind(v: Column) -> Column:
    """``object``, ``array``, ``null`` or the scalar's SQL type in lower case; NULL for SQL NULL."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.schema_of_variant(v)), "^[a-z_ ]+", 0), "^void$", "null")


def unwrap_text(v: Column) -> Column:
    """A string that holds a JSON list or object stands for that list or object; anything else stays."""

    def inner(x: Column) -> Column:
        s = F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
        return F.coalesce(parse_strict(F.nullif(F.regexp_extract(s, r"(?s)^\s*(\{.*\}|\[.*\])\s*$", 1), F.lit(""))), x)

    return let(v, inner)
