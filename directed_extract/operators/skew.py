"""Joins that stay even when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot. There can be at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, hot_share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``rows`` to their groups, ``groups`` having one row per ``key`` with its number of rows, ``count``.

    Groups above ``hot_share`` of all rows are joined by broadcast: by their definition there are at most
    ``1 / hot_share`` of them, whatever the data. The rest has no large key and is joined by shuffle. A NULL key joins
    nothing. ``rows`` is read twice and should be a written table.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    limit = max(1, int(total * hot_share))
    hot = F.broadcast(groups.filter(F.col(count) > limit))
    cold = groups.filter(F.col(count) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot_share: float = HOT_SHARE) -> DataFrame:
    """Join of ``rows`` to a table with at most one row per ``key``, which knows no counts; ``how`` is inner or left.

    The rows are counted by key first, combined before the shuffle. Of the keys above ``hot_share``, at most
    ``1 / hot_share``, the lookup's rows are broadcast, the others meet by shuffle. Rows with a NULL key meet nothing: a
    left join keeps them without moving them. ``rows`` is read several times and should be a written table.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows_of_key"))
    total = counts.agg(F.sum("_rows_of_key")).first()[0] or 0
    hot = counts.filter(F.col("_rows_of_key") > max(1, int(total * hot_share))).select(key)
    met = rows.join(F.broadcast(hot.join(lookup, key, how)), key)
    rest = rows.join(F.broadcast(hot), key, "left_anti")
    out = met.unionByName(rest.filter(F.col(key).isNotNull()).join(lookup, key, how))
    return out.unionByName(rest.filter(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def hot_parts(counts: DataFrame, key: str, count: str, hot_share: float = HOT_SHARE) -> DataFrame:
    """``(key, parts)`` of the hot keys alone: how many tasks their rows should be spread over.

    ``counts`` has one row per key. At most ``1 / hot_share`` rows, whose parts add up to at most twice that.
    """
    total = counts.agg(F.sum(count)).first()[0] or 0
    limit = max(1, int(total * hot_share))
    return counts.filter(F.col(count) > limit).select(key, F.ceil(F.col(count) / F.lit(limit)).cast("int").alias("parts"))


def join_spread(rows: DataFrame, by: str, other: DataFrame, key: str, hot_share: float = HOT_SHARE) -> DataFrame:
    """Inner join on ``key`` of two tables that may both have many rows for one key; ``other`` must not have most of them.

    The rows of a hot key are spread over as many parts as their count asks for, by a hash of ``by``; the key's rows of
    ``other`` are repeated for each part. ``rows`` is read twice and should be a written table.
    """
    parts = F.broadcast(hot_parts(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_m")), key, "_m", hot_share))
    left = rows.join(parts, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")), F.lit(0))).drop("parts")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("parts") - 1, F.lit(0)).cast("bigint")))
    right = other.join(parts, key, "left").withColumn("_part", each).drop("parts")
    return left.join(right, [key, "_part"]).drop("_part")
