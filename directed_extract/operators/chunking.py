"""Overlapping word windows of texts as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from directed_extract.config import Strategy
from directed_extract.functions.jsonx import let
from directed_extract.functions.text import words

#: Windows that are looked at in a text, at most, unless the caller says otherwise.
MOST_WINDOWS = 1000


def window_starts(n: Column, target: int, overlap: int, most: int | None = MOST_WINDOWS) -> Column:
    """The first words (from 0) of the windows over ``n`` words, in closed form.

    Windows advance by target less overlap until one reaches the end; from there they begin at the last ``overlap`` words
    and advance by one. An overlap that is not below the target is halved to it. Only the first ``most`` are kept; None keeps all.
    """
    overlap = overlap if overlap < target else max(1, target // 2)
    step = max(1, target - overlap)
    last = F.when(n <= target, F.lit(0)).otherwise(F.ceil((n - target) / F.lit(step))).cast("int")
    regular = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    low = F.greatest(n - overlap, last * step + 1)
    tail = F.when(low <= n - 1, F.sequence(low, n - 1)).otherwise(F.array().cast("array<int>"))
    all_of = F.concat(regular, tail)
    return F.when(n > 0, all_of if most is None else F.slice(all_of, 1, most)).otherwise(F.array().cast("array<int>"))


def _kept(text: Column, ws: Column, target: int, overlap: int, least: int, most: int, unit: str, short: Column, cap: int | None) -> Column:
    n = F.size(ws).cast("int")
    slices = F.transform(window_starts(n, target, overlap, cap), lambda s: F.slice(ws, s + 1, target))
    big_enough = F.filter(slices, lambda w: F.size(w) >= least)
    if unit == "words":
        big_enough = F.filter(big_enough, lambda w: F.size(w) <= most)
    texts = F.transform(big_enough, lambda w: F.array_join(w, " "))
    if unit == "chars":
        texts = F.filter(texts, lambda t: F.char_length(t) <= most)
    whole = F.array(text)
    return F.when(short, whole).otherwise(let(texts, lambda x: F.when(F.size(x) > 0, x).otherwise(whole)))


def chunks(text: Column, target: int, overlap: int, least: int, most: int, unit: str = "chars", cap: int | None = MOST_WINDOWS) -> Column:
    """The windows of a text, each at least ``least`` words and at most ``most`` characters (or words, by ``unit``).

    A text of fewer than ``least`` words, or without any window that fits, is its own only window, unchanged. NULL gives
    NULL. ``target`` must be above 0.
    """
    ws = words(text)
    return F.when(text.isNotNull(), let(ws, lambda x: _kept(text, x, target, overlap, least, most, unit, F.size(x) < least, cap)))


def sentence_chunks(text: Column, target: int, overlap: int, least: int = 5, most: int = 200, cap: int | None = MOST_WINDOWS) -> Column:
    """As :func:`chunks`, but a text of up to ``target`` words is whole."""
    ws = words(text)
    return F.when(text.isNotNull(), let(ws, lambda x: _kept(text, x, target, overlap, least, most, "chars", F.size(x) <= target, cap)))


def chunk_documents(docs: DataFrame, text: str, strategies: Iterable[Strategy], unit: str = "chars", cap: int | None = MOST_WINDOWS) -> DataFrame:
    """Each document under each strategy: the columns of ``docs`` and ``strategy``, ``model``, ``chunks``.

    Strategies that cannot run (target not above 0, negative overlap) give no rows. A strategy is a branch of one array
    expression, not a join: every document is read once. ``cap`` bounds the windows of a text; None keeps them all.
    """
    runs = [s for s in strategies if s.can_run]
    if not runs:
        return docs.withColumns({"strategy": F.lit(""), "model": F.lit(""), "chunks": F.array().cast("array<string>")}).filter(F.lit(False))
    branches = [
        F.struct(F.lit(s.name).alias("strategy"), F.lit(s.model).alias("model"), chunks(F.col(f"`{text}`"), s.chunk_target, s.chunk_overlap, s.chunk_min, s.chunk_max, unit, cap).alias("chunks")) for s in runs
    ]
    each = docs.withColumn("_s", F.explode(F.array(*branches)))
    return each.select(*[F.col(f"`{c}`") for c in docs.columns], "_s.strategy", "_s.model", "_s.chunks")
