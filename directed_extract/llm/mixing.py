"""Mixing sources to target weights: temperature over source shares, and budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from directed_extract.session import cut

#: Rows of a block, on average. Only the one block of a source that its budget ends in is looked at row by row.
BLOCK_ROWS = 2_000
#: Targets that the driver plans for, at most.
MAX_SOURCES = 10_000
#: Blocks that one task orders, on average.
PART_BLOCKS = 50_000
#: Relative entropy, in nats, by which the planned weights may differ from the targets.
CLOSE = 1e-9


def source_key(c: Column) -> Column:
    """A source's name however it was typed: lower case, no space around, spaces and hyphens as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s\p{Z}-]+", "_")


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to an exponent and normalised: 1 leaves them, 0 makes them equal. Shares of 0 stay 0."""
    live = {k: p for k, p in shares.items() if p > 0}
    if not live:
        return dict.fromkeys(shares, 0.0)
    top = max(live.values())
    raised = {k: (p / top) ** exponent for k, p in live.items()}
    total = sum(raised.values())
    return {k: raised.get(k, 0.0) / total for k in shares}


def exponent_for_entropy(shares: dict[str, float], target: float, steps: int = 200) -> float:
    """The exponent of at least 0 whose tempered shares have the target entropy, by bisection.

    Entropy falls as the exponent grows. A target above that of equal shares gives 0, one below any reachable 64.
    """
    low, high = 0.0, 64.0
    if entropy(tempered(shares, low)) <= target:
        return low
    if entropy(tempered(shares, high)) >= target:
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(tempered(shares, middle)) > target else (low, middle)
    return (low + high) / 2


def relative_entropy(p: dict[str, float], q: dict[str, float]) -> float:
    """Of ``p`` to ``q``, in nats; both over the same names."""
    return sum(x * math.log(x / q[s]) for s, x in p.items() if x > 0)


@dataclass(frozen=True)
class Plan:
    """Weights and budgets in tokens of each source; at an ``exponent`` of 1 the weights are the targets."""

    exponent: float
    total: float
    weights: dict[str, float]
    budgets: dict[str, int]


def plan_mix(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: float | None = None, steps: int = 200, close: float = CLOSE) -> Plan:
    """How much of each source to take.

    The weights are the natural token shares, each times (target / natural share) to an exponent, normalised: at 0 the
    natural shares, at 1 the targets. The exponent is found by bisection. Without a ``total`` it is the least at which the
    entropy of the targets relative to the weights is at most ``close``, and the total is the greatest at which no source
    is repeated beyond its limit. With a total it is that one, unless the limits do not allow so much: then it is the
    greatest exponent within the limits, and if even natural shares need more repeats, the total is cut down. Sources
    without tokens or target have no weight; the others' targets are scaled up to 1 together.
    """
    live = [s for s in targets if tokens.get(s, 0) > 0 and targets[s] > 0 and repeats.get(s, 1) > 0]
    if not live:
        return Plan(1.0, 0.0, dict.fromkeys(targets, 0.0), dict.fromkeys(targets, 0))
    natural_sum, target_sum = sum(tokens[s] for s in live), sum(targets[s] for s in live)
    natural = {s: tokens[s] / natural_sum for s in live}
    aim = {s: targets[s] / target_sum for s in live}

    def weights(power: float) -> dict[str, float]:
        raw = {s: natural[s] * (aim[s] / natural[s]) ** power for s in live}
        z = sum(raw.values())
        return {s: w / z for s, w in raw.items()}

    def most(w: dict[str, float]) -> float:
        return min(tokens[s] * repeats.get(s, 1) / w[s] for s in live)

    def edge(low_side: Callable[[float], bool]) -> tuple[float, float]:
        """The exponents between which ``low_side`` turns from true to false."""
        low, high = 0.0, 1.0
        for _ in range(steps):
            middle = (low + high) / 2
            low, high = (middle, high) if low_side(middle) else (low, middle)
        return low, high

    near = relative_entropy(aim, natural) <= close
    power = 0.0 if near else edge(lambda p: relative_entropy(aim, weights(p)) > close)[1]
    if total is None:
        total = most(weights(power))
    elif most(weights(power)) < total:
        power = edge(lambda p: most(weights(p)) >= total)[0]
        total = min(total, most(weights(power)))
    w = weights(power)
    budgets = {s: min(int(w[s] * total + 1e-6), tokens[s] * repeats.get(s, 1)) for s in live}
    return Plan(power, total, {s: w.get(s, 0.0) for s in targets}, {s: budgets.get(s, 0) for s in targets})


def _limits(targets: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    rows = targets.groupBy(source_key(F.col("source")).alias("s")).agg(F.sum("target_share").alias("t"), F.max("max_repeats").alias("r")).filter("s is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r.s: float(r.t or 0) for r in rows}, {r.s: int(r.r or 0) for r in rows}


def shuffled(blocks: DataFrame, group: str, size: str, most: int, seed: int, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """``blocks`` with ``before``: the summed ``size`` of those that come before it in a random order of its group.

    The order is that of a hash. A group, of at most ``most`` blocks, is cut into ranges of the hash; only these are
    ordered, and their sums, one row a range, give the offsets. No task orders more than about ``part_blocks`` blocks.
    """
    parts = max(1, -(-most // part_blocks))
    order = F.xxhash64(group, "block", "passes", F.lit(seed))
    placed = blocks.withColumn("_order", order).withColumn("_range", F.least(F.floor((F.col("_order") / F.lit(2.0**64) + 0.5) * parts), F.lit(parts - 1)).cast("int"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(group, "_range").agg(F.sum(size).alias("_sum")).withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(group, "_range").orderBy("_order", "block").rowsBetween(Window.unboundedPreceding, -1)
    got = placed.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(offsets, [group, "_range"])
    return got.withColumn("before", F.col("_inside") + F.col("_offset")).drop("_order", "_range", "_inside", "_offset")


def mix(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, total: float | None = None, seed: int = 0, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """A blend of the sources, and a report.

    The blend has a row for each use of a document: ``(<key>, source, tokens, pass, block, place)``. A source's documents
    lie in blocks; each pass goes through the blocks in another random order. Whole passes and whole blocks are taken
    until the budget; of the block it ends in, documents are taken from the largest down as long as they fit, in further
    passes too if there is room. No document is used more often than its source's ``max_repeats``. ``place`` orders the blend at random, the sources
    interleaved.

    The report has a row for each target: ``(source, target_share, planned_share, tokens_available, tokens_used,
    actual_share, passes, max_uses, exponent)``. A source without documents gets nothing, and the report shows it.

    Documents of other sources, without one, or of size 0 are left out. ``docs`` is read three times and should be a
    written table; ``key`` must be unique. The driver sees sums by source and block sums; a source that holds most rows is
    spread over its blocks like any other.
    """
    share, limit = _limits(targets)
    rows = docs.select(F.col(key).alias("id"), source_key(F.col(source)).alias("source"), F.col(size).cast("bigint").alias("tokens"))
    rows = rows.filter(F.col("source").isin(list(share)) & (F.col("tokens") > 0))
    sums = {r.source: (r.t, r.n) for r in rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    plan = plan_mix({s: t for s, (t, _) in sums.items()}, share, limit, total)
    spark = docs.sparkSession
    table = []
    for s in share:
        t, n = sums.get(s, (0, 0))
        b = plan.budgets[s]
        passes = b // t if t else 0
        table.append((s, max(1, -(-n // block_rows)), int(passes), int(b - passes * t), limit[s], share[s], plan.weights[s], int(t)))
    how = spark.createDataFrame(table, "source string, blocks int, passes int, rest bigint, most int, target_share double, planned_share double, available bigint")
    small = F.broadcast(how)  # at most MAX_SOURCES rows
    placed = rows.join(small.select("source", "blocks", "passes", "rest", "most"), "source").withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int"))

    full = placed.filter("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    full = full.select("id", "source", "tokens", "pass", "block")
    blocks = placed.filter("rest > 0").groupBy("source", "block", "passes", "rest").agg(F.sum("tokens").alias("t"))
    blocks = cut(shuffled(blocks, "source", "t", max(n for _, n, *_ in table) if table else 1, seed)).filter("before < rest")
    chosen = placed.join(blocks.select("source", "block", "t", "before"), ["source", "block"])
    inside = chosen.filter("before + t <= rest").select("id", "source", "tokens", (F.col("passes") + 1).alias("pass"), "block")
    last = chosen.filter("before + t > rest").select("id", "source", "tokens", (F.col("passes") + 1).alias("pass"), "block", "most", (F.col("rest") - F.col("before")).alias("room"))
    kind = docs.schema[key].dataType.simpleString()

    def fitting(group: pd.DataFrame) -> pd.DataFrame:
        room, kept = int(group["room"].iloc[0]), []
        group = group.sort_values(["tokens", "id"], ascending=[False, True])
        for n in range(int(group["pass"].iloc[0]), int(group["most"].iloc[0]) + 1):
            before = room
            for i, s, t, b in zip(group["id"], group["source"], group["tokens"], group["block"], strict=True):
                if t <= room:
                    room -= t
                    kept.append((i, s, t, n, b))
            if room == before:
                break
        return pd.DataFrame(kept, columns=["id", "source", "tokens", "pass", "block"])

    ends = last.groupBy("source", "block").applyInPandas(fitting, f"id {kind}, source string, tokens bigint, `pass` int, block int")
    blend = full.unionByName(inside).unionByName(ends)
    blend = blend.withColumn("place", F.xxhash64("id", "source", "pass", F.lit(seed))).withColumnRenamed("id", key)

    used = blend.groupBy("source").agg(F.sum("tokens").alias("used"), F.max("pass").alias("uses"))
    joined = how.join(F.broadcast(used), "source", "left").withColumn("whole", F.sum("used").over(Window.partitionBy(F.lit(0))))  # one row a source
    report = joined.select(
        "source", "target_share", "planned_share", F.col("available").alias("tokens_available"), F.coalesce("used", F.lit(0)).alias("tokens_used"),
        F.coalesce(F.try_divide("used", "whole"), F.lit(0.0)).alias("actual_share"),
        F.coalesce(F.try_divide("used", "available"), F.lit(0.0)).alias("passes"), F.coalesce("uses", F.lit(0)).alias("max_uses"), F.lit(plan.exponent).alias("exponent"),
    )
    return blend, report


def temperature_report(docs: DataFrame, source: str, size: str, targets: DataFrame) -> DataFrame:
    """Temperature alone: natural shares of the listed sources, and the tempered shares with the targets' entropy."""
    share, _ = _limits(targets)
    rows = docs.select(source_key(F.col(source)).alias("source"), F.col(size).cast("bigint").alias("tokens")).filter(F.col("source").isin(list(share)))
    sums = {r.source: int(r.t or 0) for r in rows.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = sum(sums.values())
    natural = {s: sums.get(s, 0) / total if total else 0.0 for s in share}
    reachable = {s: share[s] for s in share if sums.get(s, 0) > 0}
    z = sum(reachable.values()) or 1.0
    exponent = exponent_for_entropy(natural, entropy({s: t / z for s, t in reachable.items()}))
    warm = tempered(natural, exponent)
    return docs.sparkSession.createDataFrame([(s, share[s], natural[s], warm[s], exponent) for s in share], "source string, target_share double, natural_share double, tempered_share double, exponent double")
