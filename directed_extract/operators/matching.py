"""Detected entities against candidate lists: classes of match, validation of the lists, statistics and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from directed_extract.functions import text as T

CLASSES = ("exact", "partial", "fuzzy", "unmatched")
# The sentences of the suggestions.
ADD = ("Consider adding '", "' as a candidate entity")
UNIFY = ("'", "' and '", "' are similar - consider standardizing")
REPEATED = ("Duplicate candidate: '", "'")


def best_match(detected: Column, candidates: Column, threshold: float = T.ALIKE) -> Column:
    """``struct<class, candidate>``: the first equal candidate, else the last that contains or is contained, else the last alike.

    Comparison is without letter case and surrounding space. NULL candidates match nothing; a NULL or empty detected text
    gives NULL.
    """
    d = T.key(detected)
    named = F.filter(candidates, lambda c: c.isNotNull())
    exact = F.try_element_at(F.filter(named, lambda c: T.key(c) == d), F.lit(1))
    partial = F.try_element_at(F.filter(named, lambda c: T.contained(T.key(c), d)), F.lit(-1))
    alike = F.try_element_at(F.filter(named, lambda c: T.fuzzy(d, T.key(c), threshold)), F.lit(-1))
    kind = F.when(exact.isNotNull(), "exact").when(partial.isNotNull(), "partial").when(alike.isNotNull(), "fuzzy").otherwise("unmatched")
    return F.when(detected.isNotNull() & (detected != ""), F.struct(kind.alias("class"), F.coalesce(exact, partial, alike).alias("candidate")))


def match_entities(pairs: DataFrame, detected: str, candidates: str, keep: list[str], threshold: float = T.ALIKE) -> DataFrame:
    """One row for each detected entity: ``keep``, ``pos``, ``detected``, ``match_class``, ``candidate``."""
    each = pairs.select(*keep, candidates, F.posexplode(detected).alias("pos", "detected"))
    got = each.withColumn("m", best_match(F.col("detected"), F.col(candidates), threshold)).filter("m is not null")
    return got.select(*keep, "pos", "detected", F.col("m.class").alias("match_class"), F.col("m.candidate").alias("candidate"))


def match_statistics(matches: DataFrame) -> DataFrame:
    """One row: number in each class and the share that matched, 0 if there is nothing."""
    n = {c: F.count_if(F.col("match_class") == c).alias(f"n_{c}") for c in CLASSES}
    total = matches.agg(F.count("*").alias("total_detected"), *n.values())
    return total.withColumn("match_rate", F.round(F.coalesce(F.try_divide(F.col("total_detected") - F.col("n_unmatched"), F.col("total_detected")), F.lit(0.0)), 6))


def validate_candidates(lists: DataFrame, key: str, candidates: str) -> DataFrame:
    """``(<key>, pos, candidate, verdict, clean)``: each listed candidate is valid, invalid or a duplicate of an earlier one.

    Invalid are NULL and blank ones. The window is over one list, never over many.
    """
    each = lists.select(key, F.posexplode(candidates).alias("pos", "candidate")).withColumn("k", T.key(F.col("candidate")))
    nth = F.row_number().over(Window.partitionBy(key, "k").orderBy("pos"))
    verdict = F.when(F.col("k").isNull() | (F.col("k") == ""), "invalid").when(nth > 1, "duplicate").otherwise("valid")
    return each.withColumn("verdict", verdict).select(key, "pos", "candidate", "verdict", F.when(F.col("verdict") == "valid", T.strip(F.col("candidate"))).alias("clean"))


def suggestions(matches: DataFrame, validated: DataFrame, key: str) -> DataFrame:
    """``(<key>, suggestion)``: entities to add, alike spellings to unify, and repeated candidates."""
    add = matches.filter("match_class = 'unmatched'").select(key, F.concat(F.lit(ADD[0]), "detected", F.lit(ADD[1])).alias("suggestion"))
    unify = matches.filter("match_class = 'fuzzy' and lower(detected) <> lower(candidate)")
    unify = unify.select(key, F.concat(F.lit(UNIFY[0]), "detected", F.lit(UNIFY[1]), "candidate", F.lit(UNIFY[2])).alias("suggestion"))
    twice = validated.filter("verdict = 'duplicate'").select(key, F.concat(F.lit(REPEATED[0]), "candidate", F.lit(REPEATED[1])).alias("suggestion"))
    return add.unionByName(unify).unionByName(twice)


def greedy_hits(predicted: Column, reference: Column) -> Column:
    """The places (from 0) in ``reference`` that ``predicted`` takes one to one.

    In the order of predictions each takes the first reference not yet taken that it matches. True positives are the size
    of the result; what it lacks of either list are false positives and false negatives.
    """
    places = F.transform(reference, lambda r, i: F.struct(i.alias("i"), T.normalize_for_match(r).alias("r")))

    def step(used: Column, p: Column) -> Column:
        q = T.normalize_for_match(p)
        free = F.filter(places, lambda x: ~F.array_contains(used, x["i"]) & T.matches_reference(q, x["r"]))
        return F.concat(used, F.transform(F.slice(free, 1, 1), lambda x: x["i"]))

    return F.aggregate(predicted, F.array().cast("array<int>"), step)
