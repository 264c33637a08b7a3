"""One consistent form for text that looks the same but is written with different characters."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from directed_extract.operators.skew import HOT_SHARE, hot_parts, join_groups
from directed_extract.session import cut

# Letters whose usual glyph is that of a Latin letter; Unicode's own list is added to them (see confusables).
LOOKALIKES = {
    # Greek capitals and small omicron
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o",
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "H", "Ӏ": "I",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l",
    # Letters of the phonetic alphabet
    "ɡ": "g", "ɑ": "a", "ɩ": "i",
    # Armenian and others
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
    # Hyphens of the width of the plain one
    "‐": "-", "‑": "-", "˗": "-",
}
# Compatibility decompositions that change what is seen and are left alone.
VISIBLE_TAGS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")
# The default-ignorable code points, as first and last of each range.
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0),
    (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
# What breaks a line, besides \n.
BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


@cache
def confusables(jvm: object) -> tuple[dict[str, str], dict[str, str]]:
    """Letters that Unicode's list of confusables gives the shape of a Latin letter: those mapped anywhere, and those mapped
    only beside a Latin letter.

    The list comes with Spark (its ICU library). Of the letters of other scripts that do not decompose, those count whose
    skeleton is that of a plain Latin letter of the same case. Small Greek letters are signs of their own in science, and
    scripts without case would suffer as a whole: they count only inside a word with Latin letters. Letters of the Latin
    script differ for the eye and are left alone.
    """
    plain = [chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha()]
    others = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(chr(c))]
    others = [c for c in others if not unicodedata.name(c, "LATIN").startswith("LATIN") and c not in LOOKALIKES]
    found = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(plain + others)).split("\n")
    if len(found) != len(plain) + len(others):
        raise RuntimeError("the list of confusables cannot be read")
    shapes: dict[tuple[str, bool], str] = {}
    for a, s in zip(plain, found, strict=False):
        shapes[s, a.isupper()] = a
    anywhere, beside = {}, {}
    for c, s in zip(others, found[len(plain) :], strict=True):
        kind = unicodedata.category(c)
        a = shapes.get((s, kind == "Lu")) or (shapes.get((s, True)) if kind == "Lo" else None)
        if a:
            (beside if kind == "Lo" or unicodedata.name(c).startswith("GREEK SMALL") else anywhere)[c] = a
    return anywhere, beside


class _Glyphs(dict):
    """What each character becomes before composition; worked out once per character and process."""

    def __init__(self, anywhere: dict[str, str] | None = None, beside: dict[str, str] | None = None) -> None:
        super().__init__()
        self.same = {**(anywhere or {}), **LOOKALIKES}
        self.beside = beside or {}
        some = "".join(self.beside)
        self.mixed = re.compile(f"(?<=[A-Za-z])[{some}]|[{some}](?=[A-Za-z])") if some else None

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in BREAKS:
            out = "\n"
        elif c == "\n":
            out = c
        elif c in "\t\x1f" or unicodedata.category(c) == "Zs":
            out = " "
        elif unicodedata.category(c) == "Cc" or any(a <= code <= b for a, b in IGNORABLE):
            out = ""
        elif code < 128 or unicodedata.decomposition(c).split(" ", 1)[0] in VISIBLE_TAGS:
            out = c
        else:
            out = "".join(self.same.get(x, x) for x in unicodedata.normalize("NFKD", c))
        self[code] = out
        return out


def canonical_form(text: str, fold: bool = False, glyphs: _Glyphs | None = None) -> str:
    """The form in which texts that look the same are equal.

    Compatibility decomposition (full-width forms, ligatures, presentation forms, letter-like signs), removal of
    everything without a glyph, look-alike letters of other scripts mapped to Latin, any blank to a space and any line
    break to ``\\n``, space before a line break and at the end dropped, then composition.

    Superscripts, subscripts, fractions and circled signs are seen as such and kept. Letters are mapped before they are
    composed, so that an accent after a look-alike letter ends on the Latin one. With ``fold`` the form is that of
    comparisons that disregard such differences and letter case: compatibility composition and full case folding of all.
    """
    glyphs = _Glyphs() if glyphs is None else glyphs
    t = text.replace("\r\n", "\n").translate(glyphs)
    if glyphs.mixed is not None and not glyphs.beside.keys().isdisjoint(t):
        t = glyphs.mixed.sub(lambda m: glyphs.beside[m[0]], t)
    t = unicodedata.normalize("NFC", re.sub(" +\n", "\n", t).rstrip("\n "))
    return folded(t) if fold else t


def folded(form: str) -> str:
    """Compatibility composition and full case folding, repeated as folding may leave what composes."""
    if form.isascii():
        return form.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", form).casefold())


def canonical(spark: SparkSession, text: Column, fold: bool = False) -> Column:
    """:func:`canonical_form` of a column. NULL stays NULL; each distinct value of a batch is worked out once."""
    anywhere, beside = confusables(spark._jvm)

    @F.pandas_udf(StringType())
    def forms(values: pd.Series) -> pd.Series:
        glyphs = _Glyphs(anywhere, beside)
        codes, distinct = pd.factorize(values)
        done = pd.Series([canonical_form(v, fold, glyphs) for v in distinct], dtype=object)
        return pd.Series([None if c < 0 else done[c] for c in codes], dtype=object)

    return forms(text)


def _keys(spark: SparkSession, text: Column) -> Column:
    """``struct<k, f>``: 16-byte digests of the folded form and of the visible form."""
    anywhere, beside = confusables(spark._jvm)

    @F.pandas_udf("struct<k:binary,f:binary>")
    def digests(values: pd.Series) -> pd.DataFrame:
        glyphs = _Glyphs(anywhere, beside)
        codes, distinct = pd.factorize(values)
        digest = lambda t: hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        forms = [canonical_form(v, False, glyphs) for v in distinct]
        done = [(digest(folded(f)), digest(f)) for f in forms]
        return pd.DataFrame([done[c] if c >= 0 else (None, None) for c in codes], columns=["k", "f"])

    return digests(text)


def memberships(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, k, f, t)`` of every row with a text: digests of its folded form, its visible form and the text itself.

    Written to the checkpoint folder; only digests travel from here on.
    """
    c = F.col(f"`{text}`")
    rows = df.filter(c.isNotNull()).select(F.col(f"`{key}`").alias("id"), _keys(df.sparkSession, c).alias("x"), F.unhex(F.md5(c)).alias("t"))
    return cut(rows.select("id", "x.k", "x.f", "t"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """``(f, t, n)`` of the texts that look like another text, with their numbers of rows.

    The search is by the folded form, which brings together whatever could look alike; within it, texts count whose
    visible forms are equal character for character.
    """
    texts = rows.groupBy("k", "f", "t").agg(F.count("*").alias("n"))
    several = texts.groupBy("k").agg(F.count("*").alias("m")).filter("m > 1").select("k")
    near = texts.join(several, "k")
    alike = near.groupBy("k", "f").agg(F.count("*").alias("m")).filter("m > 1").select("k", "f")
    return near.join(alike, ["k", "f"]).select("f", "t", "n")


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(<key>, class_id, n_texts, n_rows)``: one row for each text. Texts that look the same are one class, named by its
    smallest key, with its numbers of different texts and of rows; NULL texts are in no class.

    Classes of many rows are counted before any shuffle and joined back by broadcast.
    """
    rows = memberships(df, key, text)
    per_text = rows.groupBy("f", "t").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    groups = per_text.groupBy("f").agg(F.min("first").alias("class_id"), F.count("*").alias("n_texts"), F.sum("n").alias("n_rows"))
    return join_groups(rows.select("id", "f"), cut(groups), "f", "n_rows").select(F.col("id").alias(key), "class_id", "n_texts", "n_rows")


def looking_alike(df: DataFrame, key: str, text: str, hot_share: float = HOT_SHARE) -> DataFrame:
    """``(<key>_a, <key>_b)``: every pair of rows whose texts look the same but are not equal; ``a < b``.

    Exact copies are no pair, rows without a text (NULL) have no partner, an empty text looks like one of unseen
    characters only. ``key`` must be unique. Other columns of ``df`` play no part, whatever their names.

    This writes out what :func:`classes` says in one row a text, and is as long as its result. Different texts are paired
    within a class, not rows; then the rows of either text are joined on. The rows of a text above ``hot_share`` of all are
    spread over as many parts as they ask for, and the text's pairs are repeated for each part.
    """
    rows = memberships(df, key, text)
    texts = cut(distinct_texts(rows))
    parts = cut(hot_parts(texts, "t", "n", hot_share))
    pairs = texts.select("f", F.col("t").alias("ta")).join(texts.select("f", F.col("t").alias("tb")), "f").filter("ta < tb").select("ta", "tb")
    spread = rows.join(texts.select("t"), "t", "left_semi").join(F.broadcast(parts), "t", "left").select("id", "t", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0)).alias("p"))

    def with_rows(left: DataFrame, side: str, name: str) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("parts") - 1, F.lit(0)).cast("bigint")))
        told = left.join(F.broadcast(parts.withColumnRenamed("t", side)), side, "left").withColumn("p", each).drop("parts")
        return told.join(spread.select(F.col("id").alias(name), F.col("t").alias(side), "p"), [side, "p"]).drop(side, "p")

    found = with_rows(with_rows(pairs, "ta", "a"), "tb", "b")
    return found.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"))
