"""References to records that do not exist: point-in-time orphan detection between tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from directed_extract.operators.skew import HOT_SHARE, hot_parts, join_groups
from directed_extract.session import cut

#: Width of the time buckets in which the history of one key is first reduced, so that no key is ordered as a whole.
BUCKET = "hour"


def presence_intervals(ingests: DataFrame, deletions: DataFrame, bucket: str = BUCKET) -> DataFrame:
    """``(key, since, until)``: the times at which each key is present; ``until`` is NULL while it is still present.

    ``ingests`` and ``deletions`` have the columns ``key`` and ``at``. A key is present from an ingest (inclusive) until a
    later deletion (exclusive), again from an ingest after that. An ingest at the very time of a deletion wins. Rows with
    a NULL key or time say nothing and are left out; repeated rows change nothing. Empty inputs give an empty result.

    A key's history is never ordered as a whole: rows of the same instant are folded before the shuffle, changes of state
    are found per (key, time bucket), and only these are ordered per key. Their number is bounded by the buckets of the
    calendar plus the real changes of state, whatever the number of deliveries.
    """
    events = ingests.select("key", "at", F.lit(1).alias("on")).unionByName(deletions.select("key", "at", F.lit(0).alias("on")))
    events = events.filter(F.col("key").isNotNull() & F.col("at").isNotNull()).groupBy("key", "at").agg(F.max("on").alias("on"))
    inside = Window.partitionBy("key", F.date_trunc(bucket, "at")).orderBy("at")
    whole = Window.partitionBy("key").orderBy("at")
    changed = lambda w: F.coalesce(F.lag("on").over(w) != F.col("on"), F.lit(True))
    steps = events.withColumn("new", changed(inside)).filter("new")
    steps = steps.withColumn("new", changed(whole)).filter("new")
    return steps.withColumn("until", F.lead("at").over(whole)).filter("on = 1").select("key", F.col("at").alias("since"), "until")


@dataclass(frozen=True)
class Judged:
    """References with a key, as written rows ``(row, k, t)``, and the distinct ``(kt, n)`` of them that dangle."""

    rows: DataFrame
    lost: DataFrame
    columns: list[str]


def judge(references: DataFrame, presence: DataFrame, key: str = "key", at: str = "at", hot_share: float = HOT_SHARE) -> Judged:
    """Which distinct (key, instant) pairs of ``references`` are not covered by ``presence``.

    The references are read and parsed once and kept in the checkpoint folder. Their distinct pairs, counted before the
    shuffle, are anti-joined against the presence intervals. A key that has more than ``hot_share`` of the pairs is spread
    over as many parts as its count asks for, by its instants; its few intervals are repeated for each part, those of all
    other keys are not. A NULL key refers to nothing. A NULL time dangles only if the key was never present.
    """
    cols = references.columns
    rows = cut(references.filter(F.col(key).isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.struct(F.col(key).alias("k"), F.col(at).alias("t")).alias("kt")))
    pairs = cut(rows.groupBy("kt").agg(F.count("*").alias("n")).select("kt", "n", F.col("kt.k").alias("k"), F.col("kt.t").alias("t")))
    hot = F.broadcast(hot_parts(pairs.groupBy("k").agg(F.count("*").alias("m")), "k", "m", hot_share))
    part = F.coalesce(F.pmod(F.xxhash64("t"), F.col("parts")), F.lit(0)).cast("int")
    asked = pairs.join(hot, "k", "left").withColumn("p", part)
    there = presence.withColumnRenamed("key", "k").join(hot, "k", "left").withColumn("p", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    begun = F.col("a.t").isNull() | (F.col("b.since") <= F.col("a.t"))
    lasts = F.col("a.t").isNull() | F.col("b.until").isNull() | (F.col("a.t") < F.col("b.until"))
    lost = asked.alias("a").join(there.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.p") == F.col("b.p")) & begun & lasts, "left_anti")
    return Judged(rows, cut(lost.select("kt", "n")), cols)


def dangling_rows(judged: Judged) -> DataFrame:
    """The references themselves, with all their columns. A pair that many rows share, even one key at one instant, is
    joined back by broadcast (see :func:`skew.join_groups`)."""
    found = join_groups(judged.rows, judged.lost, "kt", "n")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in judged.columns])


def dangling(references: DataFrame, presence: DataFrame, key: str = "key", at: str = "at", hot_share: float = HOT_SHARE) -> DataFrame:
    """The rows of ``references`` whose ``key`` is not present at their time ``at``; all their columns are kept.

    Repeated references are tested once but each comes out. A NULL key refers to nothing and gives no row. A NULL time
    gives a row only if the key was never present. Extra columns of any name are carried along.
    """
    return dangling_rows(judge(references, presence, key, at, hot_share))


def orphan_report(judged: Judged, presence: DataFrame, table: str = "table_name", period: str = "month") -> DataFrame:
    """Counts per table and period: references, dangling ones, their distinct keys, and how many of these never came.

    Periods without any reference do not appear; a NULL time is a period of its own. Works on the rows that ``judge`` has
    written, reduced to distinct (table, pair) before any join, so no table, period or key is gathered in one task.
    """
    when = F.date_trunc(period, F.col("kt.t")).alias("period")
    counted = judged.rows.groupBy(F.col(f"row.`{table}`").alias("table_name"), "kt").agg(F.count("*").alias("n_refs"))
    known = counted.join(judged.lost.select("kt", F.lit(True).alias("lost")), "kt", "left")
    per_key = known.groupBy("table_name", when, F.col("kt.k").alias("key")).agg(F.sum("n_refs").alias("n_refs"), F.sum(F.when(F.col("lost"), F.col("n_refs"))).alias("n"))
    came = presence.select("key").distinct().withColumn("came", F.lit(True))
    got = per_key.join(came, "key", "left").groupBy("table_name", "period").agg(
        F.sum("n_refs").alias("n_refs"), F.sum("n").alias("n_dangling"), F.count("n").alias("n_keys"), F.sum(F.when(F.col("came").isNull(), F.col("n"))).alias("n_never_came")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return got.select("table_name", "period", "n_refs", zero("n_dangling"), zero("n_keys"), zero("n_never_came"))
