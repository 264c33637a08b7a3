"""Preparation of annotated documents: allow lists, constant candidates, and what the steps removed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from directed_extract.functions.text import strip
from directed_extract.operators.skew import join_lookup
from directed_extract.session import cut

# The candidate block of the development set, with types, and the allow list of the same names.
CANDIDATES = (
    ("Short of breath", "SpecificDisease"), ("Chest pain", "SpecificDisease"), ("Orthopnea", "SpecificDisease"), ("Hypertension", "SpecificDisease"),
    ("Hyperlipidemia", "SpecificDisease"), ("Angina", "SpecificDisease"), ("Obesity", "SpecificDisease"),
    ("Aspirin", "Treatment"), ("Nitroglycerin", "Treatment"), ("Monitoring", "Treatment"),
)
ALLOWED = tuple(name for name, _ in CANDIDATES)


def keep_listed(entities: Column, allowed: Iterable[str]) -> Column:
    """The entities whose ``texto`` is in the list but for letter case; NULL stays NULL."""
    names = F.array(*[F.lit(a.lower()) for a in allowed])
    return F.filter(entities, lambda e: F.coalesce(F.array_contains(names, F.lower(e["texto"])), F.lit(False)))


def filter_entities(docs: DataFrame, entities: str, allowed: Iterable[str]) -> DataFrame:
    """Every document with only its listed entities, even if none is left."""
    return docs.withColumn("entities_before", F.coalesce(F.size(F.col(entities)), F.lit(0))).withColumn(entities, keep_listed(F.col(entities), allowed))


def filter_by_table(docs: DataFrame, key: str, entities: str, allowed: DataFrame, name: str) -> DataFrame:
    """As :func:`filter_entities` with an allow list of any length: ``allowed`` meets the entities by a join.

    ``key`` must be unique; ``entities`` keeps its order. A name that a third of the entities bear is folded before it is
    looked up: only distinct names travel to the list.
    """
    rows = cut(docs.withColumn("entities_before", F.coalesce(F.size(F.col(entities)), F.lit(0))))
    each = rows.select(F.col(key).alias("_k"), F.posexplode(entities).alias("_i", "_e")).withColumn("_n", F.lower("_e.texto"))
    listed = allowed.select(F.lower(F.col(name)).alias("_n")).filter("_n is not null").distinct()
    kept = join_lookup(cut(each.filter("_n is not null")), listed, "_n").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_i", "_e"))).alias("_x"))
    none = F.when(F.col(entities).isNotNull(), F.slice(F.col(entities), 1, 0))
    out = rows.join(kept, rows[key] == kept["_k"], "left").withColumn(entities, F.coalesce(F.transform("_x", lambda x: x["_e"]), none))
    return out.drop("_k", "_x")


def samples(docs: DataFrame, order: str, entities: str | None = None, n: int = 5) -> DataFrame:
    """The first ``n`` documents in order, for a look at them; of those with entities only, if their column is named."""
    return (docs.filter(F.size(F.col(entities)) > 0) if entities else docs).orderBy(order).limit(n)


def filter_statistics(filtered: DataFrame, entities: str) -> DataFrame:
    """One row: documents, entities before and after, removed, and the share kept in percent (0 if there were none)."""
    n = F.greatest(F.coalesce(F.size(F.col(entities)), F.lit(0)), F.lit(0))
    s = filtered.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.greatest("entities_before", F.lit(0))), F.lit(0)).alias("n_before"), F.coalesce(F.sum(n), F.lit(0)).alias("n_after"))
    kept = F.round(F.coalesce(F.try_divide(F.col("n_after") * 100.0, F.col("n_before")), F.lit(0.0)), 4)
    return s.select("n_docs", "n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"), kept.alias("kept_percent"))


def with_constant_candidates(docs: DataFrame, entities: str, block: Iterable[tuple[str, str]]) -> DataFrame:
    """Every document with the same candidates, and whether it had any of its own before."""
    rows = F.array(*[F.struct(F.lit(t).alias("texto"), F.lit(k).alias("tipo")) for t, k in block])
    return docs.withColumn("had_entities", F.coalesce(F.size(F.col(entities)) > 0, F.lit(False))).withColumn(entities, rows)


def renamed_types(entities: Column, names: dict[str, str]) -> Column:
    """Types by a mapping; unknown ones stay."""
    m = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform(entities, lambda e: F.struct(e["texto"].alias("texto"), F.coalesce(F.try_element_at(m, e["tipo"]), e["tipo"]).alias("tipo")))


def usable(docs: DataFrame, text: str) -> DataFrame:
    """Documents with a text that is not blank."""
    return docs.filter(strip(F.col(text)) != "")
