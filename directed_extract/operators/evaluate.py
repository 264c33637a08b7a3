"""Predictions against reference annotations: one-to-one matching, metrics, and the rows that are wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from directed_extract.functions import text as T
from directed_extract.operators.matching import greedy_hits
from directed_extract.operators.skew import join_lookup
from directed_extract.session import cut


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def latest_gold(gold: DataFrame, key: str, order: str, entities: str) -> DataFrame:
    """``(pmid, reference)``: of several rows of a document the last counts. Rows without a document are left out."""
    named = gold.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    return named.groupBy(F.col(key).alias("pmid")).agg(F.coalesce(F.max_by(entities, order), F.array().cast("array<string>")).alias("reference"))


def evaluate_documents(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """``(doc, file, pmid, tp, fp, fn, n_predicted, n_reference, precision, recall)`` of each prediction whose document has
    reference entities; others are not judged.

    ``predictions`` has ``doc, file, pmid, entities`` (structs with ``texto``), ``gold`` ``(pmid, reference)``.
    """
    judged = join_lookup(cut(predictions), gold.filter(F.size("reference") > 0), "pmid")
    judged = judged.withColumn("predicted", F.transform("entities", lambda e: e["texto"]))
    n = judged.withColumn("tp", F.size(greedy_hits(F.col("predicted"), F.col("reference")))).withColumn("fp", F.size("predicted") - F.col("tp")).withColumn("fn", F.size("reference") - F.col("tp"))
    return n.select(
        "doc", "file", "pmid", "tp", "fp", "fn", F.size("predicted").alias("n_predicted"), F.size("reference").alias("n_reference"),
        F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 9).alias("recall"),
    )


def metrics(documents: DataFrame, *by: str, digits: int = 9) -> DataFrame:
    """Sums and micro-averaged precision, recall and F1, over all or by group; 0 where there is nothing to divide."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    s = documents.groupBy(*by).agg(F.count("*").alias("n_docs"), zero("tp"), zero("fp"), zero("fn"), zero("n_predicted"), zero("n_reference"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    s = s.withColumn("p", p).withColumn("r", r).withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return s.select(*by, "n_docs", "tp", "fp", "fn", "n_predicted", "n_reference", F.round("p", digits).alias("precision"), F.round("r", digits).alias("recall"), F.round("f", digits).alias("f1_score"))


def evaluate_strategies(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Right and wrong entities of each strategy: an entity is right if any reference of its document matches it."""
    judged = join_lookup(cut(predictions), gold.filter(F.size("reference") > 0), "pmid")
    each = judged.select("reference", F.explode("entities").alias("e")).select(
        F.exists("reference", lambda r: T.matches_reference(T.normalize_for_match(F.col("e.texto")), T.normalize_for_match(r))).alias("hit"), F.explode("e.strategies").alias("strategy")
    )
    s = each.groupBy("strategy").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    return s.select("strategy", "tp", "fp", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 9).alias("precision"))


def _forms(texts: Column) -> Column:
    """The distinct compared forms of a list of texts, in order of first appearance; NULL is an empty list."""
    return F.coalesce(F.array_distinct(F.transform(F.filter(texts, lambda t: t.isNotNull()), T.key)), F.array().cast("array<string>"))


def false_positives(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """``(doc, pmid, entity, confidence, strategies, benchmark_entities)``: predicted entities (distinct, by their compared
    form) that the document's reference lacks; all of them if it has none. Confidence and strategies are those of the first
    so written.

    Both lists are a document's own, so the comparison stays in the row; documents meet their reference as in
    :func:`skew.join_lookup`.
    """
    known = gold.select("pmid", _forms(F.col("reference")).alias("benchmark_entities"))
    rows = join_lookup(cut(predictions.select("doc", "pmid", "entities")), known, "pmid", "left")
    rows = rows.withColumn("benchmark_entities", F.coalesce("benchmark_entities", F.array().cast("array<string>")))
    keyed = F.transform("entities", lambda e, i: F.struct(T.key(e["texto"]).alias("entity"), i.alias("i"), e.alias("e")))
    new = F.filter(keyed, lambda x: ~F.array_contains("benchmark_entities", x["entity"]))
    each = rows.withColumn("all", new).withColumn("firsts", F.filter("all", lambda x: F.array_position(F.transform("all", lambda y: y["entity"]), x["entity"]) == F.array_position(F.transform("all", lambda y: y["i"]), x["i"])))
    each = each.select("doc", "pmid", "benchmark_entities", F.explode("firsts").alias("x"))
    return each.select("doc", "pmid", "x.entity", F.coalesce("x.e.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("x.e.strategies", F.array().cast("array<string>")).alias("strategies"), "benchmark_entities")


def _said(predictions: DataFrame) -> DataFrame:
    """``(pmid, entity)``, distinct: what any prediction of a document names; NULL stands for a prediction without any."""
    return predictions.select("pmid", F.explode_outer("entities").alias("e")).select("pmid", T.key(F.col("e.texto")).alias("entity")).distinct()


def false_negatives(predictions: DataFrame, gold: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``(pmid, entity)``: reference entities (distinct) of predicted documents that none of their predictions has.

    With ``texts`` ``(pmid, text)``, one row a document, also ``predicted_entities`` and ``preview``, the beginning of the
    text. A document's predictions, however many, are reduced to the distinct entities they name.
    """
    said = _said(predictions)
    known = gold.select("pmid", F.explode("reference").alias("r")).select("pmid", T.key(F.col("r")).alias("entity")).distinct()
    asked = known.join(said.select("pmid").distinct(), "pmid", "left_semi")
    lost = asked.join(said, ["pmid", "entity"], "left_anti")
    if texts is None:
        return lost
    lists = said.join(lost.select("pmid").distinct(), "pmid", "left_semi").groupBy("pmid").agg(F.array_sort(F.collect_set("entity")).alias("predicted_entities"))
    return lost.join(lists, "pmid").join(texts.select("pmid", T.preview(F.col("text")).alias("preview")), "pmid", "left")


def error_totals(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: distinct entities predicted and in the reference, wrong and missed ones, and the documents behind them.

    ``n_predicted`` and ``n_benchmark`` count for each prediction, ``n_reference`` and ``n_detected`` once for each predicted
    document that has a reference row.
    """
    known = gold.select("pmid", F.size(_forms(F.col("reference"))).alias("k"))
    rows = join_lookup(cut(predictions.select("doc", "pmid", F.size(_forms(F.transform("entities", lambda e: e["texto"]))).alias("n"))), known, "pmid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    totals = rows.agg(zero(F.sum("n")).alias("n_predicted"), zero(F.sum("k")).alias("n_benchmark"), F.count_distinct("pmid").alias("n_pmids"))
    said = _said(predictions).groupBy("pmid").agg(F.count("entity").alias("d"))
    both = known.join(said, "pmid").agg(zero(F.sum("k")).alias("n_reference"), zero(F.sum("d")).alias("n_detected"), F.count("*").alias("n_pmids_with_benchmark"))
    wrong = false_positives(predictions, gold).agg(F.count("*").alias("n_false_positives"))
    missed = false_negatives(predictions, gold).agg(F.count("*").alias("n_false_negatives"))
    out = totals.withColumn("one", F.lit(1))
    for part in (both, wrong, missed):  # one row each
        out = out.join(part.withColumn("one", F.lit(1)), "one")
    return out.drop("one")
