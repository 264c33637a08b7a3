"""Filling containers of fixed capacity with whole items: linear grouping, few-size configurations, best fit."""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from directed_extract.operators.ranking import rank_within
from directed_extract.session import cut

#: Items above capacity / LARGE are large: at most LARGE - 1 of them share a container.
LARGE = 4
#: Groups that the sizes of large items are rounded up in.
GROUPS = 24


def group_sizes(histogram: dict[int, int], groups: int = GROUPS) -> list[tuple[int, list[int], int]]:
    """Linear grouping: ``(rounded size, sizes, items)`` from the largest down, the groups of about equal cardinality.

    A size is never divided between groups; one that alone has more items than a group makes a group of its own, without
    any loss by rounding.
    """
    total = sum(histogram.values())
    want = max(1, -(-total // groups))
    out: list[tuple[int, list[int], int]] = []
    sizes: list[int] = []
    n = 0
    for s in sorted(histogram, reverse=True):
        if sizes and (n + histogram[s] > want or histogram[s] >= want):
            out.append((sizes[0], sizes, n))
            sizes, n = [], 0
        sizes, n = [*sizes, s], n + histogram[s]
    return [*out, (sizes[0], sizes, n)] if sizes else out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(items of each size, containers)`` that hold at least the demand: a linear programme over all configurations.

    Large sizes leave at most ``LARGE - 1`` items to a container, so the configurations can be listed. The programme is
    solved by the simplex method with the best column entering; its solution is rounded down, and the few items left are
    placed by best fit in containers of their own.
    """
    k = len(sizes)
    if not k:
        return []
    columns = []
    for m in range(1, LARGE):
        for combo in itertools.combinations_with_replacement(range(k), m):
            if sum(sizes[i] for i in combo) <= capacity:
                columns.append(np.bincount(combo, minlength=k))
    a = np.array(columns, dtype=float).T
    b = np.array(demand, dtype=float)
    basis = []
    for i in range(k):
        most = min(LARGE - 1, capacity // sizes[i])
        want = np.zeros(k)
        want[i] = most
        basis.append(int(np.flatnonzero((a == want[:, None]).all(axis=0))[0]))
    for _ in range(5_000):
        inverse = np.linalg.inv(a[:, basis])
        gain = inverse.sum(axis=0) @ a
        enter = int(np.argmax(gain))
        if gain[enter] <= 1 + 1e-9:
            break
        x, d = inverse @ b, inverse @ a[:, enter]
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[int(np.argmin(ratio))] = enter
    x = np.maximum(0, np.linalg.solve(a[:, basis], b))
    whole = np.floor(x + 1e-7).astype(int)
    out = [(tuple(int(v) for v in a[:, c]), int(n)) for c, n in zip(basis, whole, strict=True) if n]
    left = [int(v) for v in np.round(b - sum((a[:, c] * n for c, n in zip(basis, whole, strict=True)), np.zeros(k)))]
    bins: list[tuple[int, list[int]]] = []
    for i in range(k):
        for _ in range(max(0, left[i])):
            fit = min((t for t in bins if t[0] >= sizes[i]), key=lambda t: t[0], default=None)
            if fit is None:
                fit = (capacity, [0] * k)
            else:
                bins.remove(fit)
            items = fit[1].copy()
            items[i] += 1
            bins.append((fit[0] - sizes[i], items))
    return out + [(tuple(items), 1) for _, items in bins]


def best_fit(small: dict[int, int], free: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit of many items in many containers, by counts instead of one by one.

    ``small`` counts items by size, ``free`` containers by free space. From the largest size down, items go to the
    containers with the least space that takes one, as many as fit. Containers of the same history are one run. Gives
    ``(size, first item, class, first container, items in each)`` - ``class`` is the space the container had at first, or
    -1 for new ones - and the number of new containers.
    """
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for f, n in free.items():
        if n and f:
            runs[f].append((f, 0, n))
    spaces = sorted(runs)
    out: list[tuple[int, int, int, int, int]] = []
    new = 0

    def put(space: int, run: tuple[int, int, int]) -> None:
        if space and run[2]:
            if not runs[space]:
                insort(spaces, space)
            runs[space].append(run)

    for s in sorted(small, reverse=True):
        at, left = 0, small[s]
        while left:
            i = bisect_left(spaces, s)
            if i == len(spaces):
                n = -(-left // (capacity // s))
                put(capacity, (-1, new, n))
                new += n
                continue
            space = spaces[i]
            kind, first, n = runs[space].pop()
            if not runs[space]:
                spaces.pop(i)
            each = space // s
            full = min(n, left // each)
            if full:
                out.append((s, at, kind, first, each))
                put(space - each * s, (kind, first, full))
                at, left = at + full * each, left - full * each
            if full < n and 0 < left < each:
                out.append((s, at, kind, first + full, left))
                put(space - left * s, (kind, first + full, 1))
                at, left, full = at + left, 0, full + 1
            put(space, (kind, first + full, n - full))
    return out, new


#: Bits of a position within a size or group.
_RANK_BITS = 38


def _pair(spec: np.ndarray, size: np.ndarray) -> np.ndarray:
    return spec.astype(np.int64) * (1 << 40) + size.astype(np.int64)


def _group_of(rows: list[tuple[int, int, int]]):
    """A column function from (spec, size) to the group of ``(spec, size, group)``."""
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    pairs, groups = _pair(a[:, 0], a[:, 1]), a[:, 2]

    @F.pandas_udf("bigint")
    def group(spec: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series(groups[np.searchsorted(pairs, _pair(spec.to_numpy(), size.to_numpy()))])

    return group


def _place_of(rows: list[tuple[int, int, int, int, int, int]]):
    """A column function from (spec, group, rank) to ``(kind, place)``, by the last of the rows ``(spec, group, first rank,
    kind, first place, items in each)`` that begins before it."""
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    pairs = _pair(a[:, 0], a[:, 1])
    distinct, index = np.unique(pairs, return_inverse=True)
    if len(distinct) >= 1 << (62 - _RANK_BITS) or (len(a) and a[:, 2].max() >= 1 << _RANK_BITS):
        raise ValueError("too many sizes or items for one task of packing")
    keys = (index.astype(np.int64) << _RANK_BITS) + a[:, 2]

    @F.pandas_udf("struct<kind:bigint,place:bigint>")
    def find(spec: pd.Series, group: pd.Series, rank: pd.Series) -> pd.DataFrame:
        ranks = rank.to_numpy(np.int64)
        at = np.searchsorted(distinct, _pair(spec.to_numpy(), group.to_numpy()))
        i = np.searchsorted(keys, (at.astype(np.int64) << _RANK_BITS) + ranks, side="right") - 1
        return pd.DataFrame({"kind": a[i, 3], "place": a[i, 4] + (ranks - a[i, 2]) // a[i, 5]})

    return find


def pack(sizes: DataFrame, key: str, size: str, capacity: int, groups: int = GROUPS) -> DataFrame:
    """:func:`pack_all` for one capacity: ``(<key>, part, from_pos, tokens, container)``."""
    return pack_all(sizes, key, size, {0: capacity}, groups).drop("spec")


def pack_all(sizes: DataFrame, key: str, size: str, capacities: dict[int, int], groups: int = GROUPS) -> DataFrame:
    """``(spec, <key>, part, from_pos, tokens, container)``: every item placed whole in a container, for each of the
    ``capacities`` by spec; all of them in one pass.

    An item above the capacity is divided: its first parts fill containers of their own, what remains is an item. Items of
    size 0 or NULL lie in one container together, named ``empty``. ``key`` must be unique and not NULL.

    The driver only sees counts by size and by free space, at most one row for each capacity and size up to it, and
    decides with them; rows find their place by their position within their size. Nothing is gathered: positions are
    worked out in parts (see ``ranking.rank_within``), and the work is linear in the number of items.
    """
    specs = sorted(capacities)
    if not specs:
        kind = sizes.schema[key].dataType.simpleString()
        return sizes.sparkSession.createDataFrame([], f"spec int, `{key}` {kind}, part int, from_pos bigint, tokens bigint, container string")
    base = sizes.select(F.col(key).alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    tasks = F.array(*[F.struct(F.lit(int(s)).alias("spec"), F.lit(i).alias("ix"), F.lit(int(capacities[s])).cast("bigint").alias("c")) for i, s in enumerate(specs)])
    base = base.withColumn("x", F.explode(tasks)).select("x.spec", "x.ix", "x.c", "id", "n")
    whole = F.when(F.col("n") > F.col("c"), F.expr("n div c")).otherwise(0)
    out_columns = ["spec", "id", "part", "from_pos", "tokens", "container"]
    fulls = base.filter("n > c").withColumn("part", F.explode(F.sequence(F.lit(0), F.expr("cast(n div c as int)") - 1)))
    fulls = fulls.withColumn("from_pos", (F.col("part") * F.col("c")).cast("bigint")).withColumn("tokens", F.col("c")).withColumn("container", F.concat_ws("-", F.lit("full"), "id", "part")).select(*out_columns)
    items = base.select("spec", "ix", "c", "id", whole.cast("int").alias("part"), (whole * F.col("c")).cast("bigint").alias("from_pos"), (F.col("n") - whole * F.col("c")).cast("bigint").alias("tokens"))
    items = items.filter((F.col("tokens") > 0) | (F.col("part") == 0))
    none = items.filter("tokens = 0").withColumn("container", F.lit("empty")).select(*out_columns)
    items = items.filter("tokens > 0")
    histogram: dict[int, dict[int, int]] = defaultdict(dict)
    for r in items.groupBy("ix", "tokens").agg(F.count("*").alias("n")).collect():
        histogram[r.ix][r.tokens] = r.n
    out = fulls.unionByName(none)
    large = {ix: {s: n for s, n in h.items() if s * LARGE > capacities[specs[ix]]} for ix, h in histogram.items()}
    small = {ix: {s: n for s, n in h.items() if s * LARGE <= capacities[specs[ix]]} for ix, h in histogram.items()}

    size_groups, slots = [], []
    for ix, of_size in sorted(large.items()):
        grouped = group_sizes(of_size, groups)
        plan = configurations([g[0] for g in grouped], [g[2] for g in grouped], capacities[specs[ix]])
        starts = list(itertools.accumulate((n for _, n in plan), initial=0))
        size_groups += [(ix, s, g) for g, (_, ss, _) in enumerate(grouped) for s in ss]
        for g in range(len(grouped)):
            at = 0
            for (counts, n), first in zip(plan, starts, strict=False):
                if counts[g] and n:
                    slots.append((ix, g, at, 0, first, counts[g]))
                    at += counts[g] * n
    free: dict[int, dict[int, int]] = defaultdict(dict)
    bins = None
    if slots:
        big = items.filter(F.col("tokens") * LARGE > F.col("c")).withColumn("g", _group_of(size_groups)("ix", "tokens")).withColumn("gid", F.col("ix") * F.lit(1 << 32) + F.col("g"))
        big = rank_within(big, "gid", "id", sum(sum(h.values()) for h in large.values()))
        big = cut(big.withColumn("bin", _place_of(slots)("ix", "g", "rank")["place"]).select("spec", "ix", "c", "id", "part", "from_pos", "tokens", "bin"))
        bins = cut(big.groupBy("ix", "c", "bin").agg(F.sum("tokens").alias("used")).select("ix", "bin", (F.col("c") - F.col("used")).cast("bigint").alias("free")))
        for r in bins.groupBy("ix", "free").agg(F.count("*").alias("n")).collect():
            free[r.ix][r.free] = r.n
        out = out.unionByName(big.withColumn("container", F.concat_ws("-", F.lit("mixed"), "bin")).select(*out_columns))
    placed = [(ix, s, at, kind, first, each) for ix, of_size in sorted(small.items()) if of_size for s, at, kind, first, each in best_fit(of_size, dict(free[ix]), capacities[specs[ix]])[0]]
    if placed:
        tiny = items.filter(F.col("tokens") * LARGE <= F.col("c")).withColumn("gid", F.col("ix") * F.lit(1 << 32) + F.col("tokens"))
        tiny = rank_within(tiny, "gid", "id", sum(sum(h.values()) for h in small.values()))
        tiny = tiny.withColumn("to", _place_of(placed)("ix", "tokens", "rank")).select("spec", "ix", "id", "part", "from_pos", "tokens", F.col("to.kind").alias("free"), F.col("to.place").alias("rank"))
        out = out.unionByName(tiny.filter("free = -1").withColumn("container", F.concat_ws("-", F.lit("small"), "rank")).select(*out_columns))
        if bins is not None:
            ranked = rank_within(bins.filter("free > 0").withColumn("gid", F.col("ix") * F.lit(1 << 32) + F.col("free")), "gid", "bin", sum(sum(h.values()) for h in free.values()))
            filled = tiny.filter("free >= 0").join(ranked.select("ix", "free", "rank", "bin"), ["ix", "free", "rank"])
            out = out.unionByName(filled.withColumn("container", F.concat_ws("-", F.lit("mixed"), "bin")).select(*out_columns))
    return out.withColumnRenamed("id", key)


def fill_report(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """One row for each spec: items, containers (without the one of empty items), the least possible number, and the share
    filled. Specs without items have zeros."""
    used = packed.filter("tokens > 0").groupBy("spec", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"))
    total = used.groupBy("spec").agg(F.sum("k").alias("n_items"), F.count("*").alias("n_containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    every = packed.sparkSession.createDataFrame(sorted(capacities.items()), "spec int, capacity int")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return every.join(total, "spec", "left").select(
        "spec", "capacity", zero("n_items"), zero("n_containers"), F.coalesce(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(0)).alias("least_containers"), zero("tokens"), zero("fullest"),
        F.try_divide(F.col("tokens"), F.col("n_containers") * F.col("capacity")).alias("filled"),
    )
