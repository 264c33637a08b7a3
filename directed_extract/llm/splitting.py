"""Texts above a size limit cut at natural boundaries, consecutive pieces sharing an overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations after which a full stop ends no sentence, in English, Spanish, French and German.
ABBREVIATIONS = (
    "a al approx aprox art av avda b.i.d bzw c ca cf ch d dept depto dr dra drs e.g ed ej etc ext fig figs gral i.e inc izq jr max min mr mrs ms "
    "n no nº núm núms p p.ej p. pp pág págs prof ref refs resp s sec sr sra srta sres st t tab tel tfno vol vs z.b zb"
).split()

#: Rows of a table of limits that go to every worker, at most.
BROADCAST_LIMITS = 10_000
#: Tasks that the texts of one group are spread over where the limits are joined by shuffle.
SPREAD = 64

_STOP = re.compile(r"[.!?…]+[\"'»”’)\]]*\s+(?=[\"'«“‘(\[¿¡]*[A-ZÀ-ÖØ-ÞΑ-ΩА-Я0-9•*\-])")
_LAST_WORD = re.compile(r"([^\s(\[«“\"]+)[.]$")


def _after(pattern: str, text: str, start: int, end: int) -> list[int]:
    return [m.end() for m in re.compile(pattern).finditer(text, start, end)]


def _sections(text: str, start: int, end: int) -> list[int]:
    """Before a heading: a short line without a final full stop, after an empty line, with text below it."""
    heading = r"\n[ \t]*\n(?=[ \t]*(?:#+ |\d+(?:\.\d+)*[.)]? )?[^\n.;,]{1,60}[:.]?[ \t]*\n[^\n])"
    return _after(heading, text, start, end)


def _paragraphs(text: str, start: int, end: int) -> list[int]:
    return _after(r"\n[ \t]*\n+", text, start, end)


def _lines(text: str, start: int, end: int) -> list[int]:
    """After a line, unless it is a heading, which stays with what follows."""
    out, begin = [], start
    for c in _after(r"\n", text, start, end):
        line = text[begin:c].strip()
        begin = c
        if not line or len(line) > 60 or line[-1] in ".!?;,…":
            out.append(c)
    return out


def _sentences(text: str, start: int, end: int) -> list[int]:
    out = []
    for m in _STOP.finditer(text, start, end):
        if text[m.start()] == "." and (word := _LAST_WORD.search(text, max(start, m.start() - 24), m.start() + 1)):
            w = word[1].lower()
            if w in ABBREVIATIONS or (len(w) == 1 and w.isalpha()):
                continue
        out.append(m.end())
    return out


def _words(text: str, start: int, end: int) -> list[int]:
    return _after(r"\s+", text, start, end)


HIERARCHY = (_sections, _paragraphs, _lines, _sentences, _words)


def _atoms(text: str, start: int, end: int, most: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Spans to be kept whole: cut at the coarsest boundary, and only what is still above ``most`` at the next. A span
    above it has no boundary at all and may be cut at any character."""
    if end - start <= most or level == len(HIERARCHY):
        yield start, end
        return
    cuts = [c for c in HIERARCHY[level](text, start, end) if start < c < end]
    for s, e in zip([start, *cuts], [*cuts, end], strict=True):
        yield from _atoms(text, s, e, most, level + 1)


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans ``(start, end)`` of pieces of at most ``limit`` characters that cover ``text`` without a gap.

    Boundaries are tried from the coarsest to the finest: section, paragraph, line, sentence, word, character; a finer one
    is only used inside what is too long by itself. Parts are packed greedily, and every piece but the first begins
    exactly ``overlap`` characters before the end of the one before. A text within the limit, also an empty one, is one
    piece. An overlap that leaves no room for new text is reduced to one character less than the limit.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    overlap = max(0, min(overlap, limit - 1))
    pieces, start, end = [], 0, 0
    for _, e in _atoms(text, 0, len(text), limit - overlap):
        while e - start > limit:
            if e - end <= limit - overlap:  # the part fits after the cut
                cut = end
            else:
                cut = start + limit
            pieces.append((start, cut))
            start = end = cut
            start -= overlap
        end = e
    return [*pieces, (start, end)]


def split_oversized(df: DataFrame, key: str, text: str, limits: DataFrame, group: str, default: str = "default") -> DataFrame:
    """The pieces of every text: ``(<key>, piece_no, n_pieces, start_pos, end_pos, piece)``.

    ``limits`` has ``(<group>, max_chars, overlap_chars)``, one row per group; texts whose group is NULL or has no row take
    the row named ``default``. Positions count characters from 0, the end is exclusive. A text within its limit comes out
    whole as its only piece; NULL gives no piece; without any row for it, a text has no limit.

    Short texts stay in the JVM; only those above their limit pass through Python, batch by batch, each on its own: no
    shuffle at all. ``limits`` is broadcast if it has at most :data:`BROADCAST_LIMITS` rows. A longer one meets the texts
    by shuffle, where a group that a third of the texts share is spread over ``SPREAD`` tasks; texts without a group take
    the default without moving. Other columns of ``df`` play no part.
    """
    small = limits.limit(BROADCAST_LIMITS + 1).count() <= BROADCAST_LIMITS
    rules = limits.groupBy(F.col(f"`{group}`").alias("g")).agg(F.min("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
    otherwise = rules.filter(F.col("g") == default).select(F.col("max_chars").alias("m"), F.col("overlap_chars").alias("o"))
    fallback = otherwise.first()
    m, o = (fallback.m, fallback.o) if fallback else (None, None)
    rows = df.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("piece"), F.col(f"`{group}`").alias("g"))
    if small:
        rows = rows.join(F.broadcast(rules), "g", "left")
    else:
        spread = rows.filter("g is not null").withColumn("p", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int"))
        each = rules.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        rows = spread.join(each.hint("shuffle_hash"), ["g", "p"], "left").drop("p").unionByName(rows.filter("g is null"), allowMissingColumns=True)
    rows = rows.select(
        "id", "piece", F.coalesce("max_chars", F.lit(m).cast("int")).alias("m"), F.coalesce("overlap_chars", F.lit(o).cast("int"), F.lit(0)).alias("o"), F.char_length("piece").alias("n")
    )
    too_long = F.coalesce(F.col("n") > F.col("m"), F.lit(False))
    kind = df.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, m, o in zip(b["id"], b["piece"], b["m"], b["o"], strict=True):
                spans = split_text(t, int(m), int(o))
                out += [(i, k, len(spans), s, e, t[s:e]) for k, (s, e) in enumerate(spans)]
            yield pd.DataFrame(out, columns=["id", "piece_no", "n_pieces", "start_pos", "end_pos", "piece"])

    schema = f"id {kind}, piece_no int, n_pieces int, start_pos int, end_pos int, piece string"
    cut = rows.filter(too_long).select("id", "piece", "m", "o").mapInPandas(pieces, schema)
    whole = rows.filter(~too_long).select("id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_pos"), F.col("n").alias("end_pos"), "piece")
    return cut.unionByName(whole).withColumnRenamed("id", key)
