"""From detections to accepted entities: evidence by entity, confidence, levels and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from directed_extract.config import REGEX, Rules, Thresholds


def evidence(detections: DataFrame, weights: DataFrame) -> DataFrame:
    """``(doc, entity, weight, n_strategies, has_regex, strategies)`` of ``(doc, strategy, entity)``.

    Repeated detections count once; NULL documents, strategies and entities, and strategies without a weight, count
    nothing. ``strategies`` lists names by their order. ``weights`` is a configuration table, joined by its own size.
    """
    once = detections.select("doc", "strategy", "entity").filter("doc is not null and strategy is not null and entity is not null").distinct()
    weighed = once.join(weights, "strategy")
    got = weighed.groupBy("doc", "entity").agg(
        F.sum("weight").alias("weight"), F.count("*").cast("int").alias("n_strategies"), F.max(F.col("strategy") == REGEX).alias("has_regex"),
        F.array_sort(F.collect_list(F.struct("ord", "strategy"))).alias("s"),
    )
    return got.withColumn("strategies", F.transform("s", lambda x: x["strategy"])).drop("s")


def _clamped(c: Column, rules: Rules) -> Column:
    return F.greatest(F.lit(rules.least), F.least(F.lit(rules.most), c))


def score_pipeline(weight: Column, n: Column, has_regex: Column, rules: Rules = Rules()) -> Column:
    """The pipeline's confidence: each rule is capped at 1 before the next."""
    c = F.when(has_regex, F.least(F.lit(1.0), weight * rules.regex_factor)).otherwise(weight)
    c = F.when(n > 1, F.least(F.lit(1.0), c * (1 + rules.extra_strategy * (n - 1)))).otherwise(c)
    return _clamped(F.when(has_regex, c).otherwise(c * rules.model_only_factor), rules)


def score_standalone(weight: Column, n: Column, has_regex: Column, rules: Rules = Rules()) -> Column:
    """The stand-alone scorer's confidence: capped only at the end."""
    c = F.when(has_regex, weight * rules.regex_factor).otherwise(weight)
    c = F.when(n > 1, c * (1 + rules.extra_strategy * (n - 1))).otherwise(c)
    return _clamped(F.when(has_regex, c).otherwise(c * rules.model_only_factor), rules)


def level(confidence: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(confidence >= t.high, "high").when(confidence >= t.medium, "medium").when(confidence >= t.low, "low").otherwise("below_threshold")


def scored(detections: DataFrame, weights: DataFrame, rules: Rules = Rules()) -> DataFrame:
    e = evidence(detections, weights)
    return e.withColumn("confidence", F.round(score_pipeline(F.col("weight"), F.col("n_strategies"), F.col("has_regex"), rules), 9))


def accepted(scores: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return scores.filter(F.col("confidence") >= t.min_accept)


def accepted_lists(scores: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``(doc, entities)``: a document's accepted entities, the most confident first, ties by name."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "entity", "strategies", "n_strategies")))
    each = lambda x: F.struct(x["entity"].alias("texto"), (-x["c"]).alias("confidence"), x["strategies"].alias("strategies"), x["n_strategies"].alias("strategy_count"))
    return accepted(scores, t).groupBy("doc").agg(F.transform(ordered, each).alias("entities"))


def confidence_summary(scores: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row: count, mean, range and the number at each level; zeros if there is nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    at = lambda name: F.count_if(level(F.col("confidence"), t) == name).alias(name)
    return scores.agg(
        F.count("*").alias("total"), F.round(zero(F.avg("confidence")), 6).alias("mean_confidence"), zero(F.min("confidence")).alias("min_confidence"), zero(F.max("confidence")).alias("max_confidence"),
        at("high"), at("medium"), at("low"), at("below_threshold"),
    )


def run_summary(docs: DataFrame, accepted_rows: DataFrame) -> DataFrame:
    """One row: documents, accepted entities, entities a document and mean confidence; 0 where there is nothing to divide."""
    n = docs.select(F.count_distinct("doc").alias("n_docs"), F.lit(1).alias("k"))
    e = accepted_rows.agg(F.count("*").alias("n_entities"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("mean_confidence")).withColumn("k", F.lit(1))
    return n.join(e, "k").select("n_docs", "n_entities", F.round(F.coalesce(F.try_divide("n_entities", "n_docs"), F.lit(0.0)), 6).alias("entities_per_doc"), "mean_confidence")


def strategy_counts(accepted_rows: DataFrame) -> DataFrame:
    """Accepted entities by strategy, the most frequent first."""
    return accepted_rows.select(F.explode("strategies").alias("strategy")).groupBy("strategy").agg(F.count("*").alias("n_entities")).orderBy(F.desc("n_entities"), "strategy")


def confidence_histogram(accepted_rows: DataFrame) -> DataFrame:
    band = F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.7, "medium").when(F.col("confidence") >= 0.5, "low").otherwise("below")
    return accepted_rows.groupBy(band.alias("band")).agg(F.count("*").alias("n_entities"))


def confidence_ranges(docs: DataFrame, confidences: str) -> DataFrame:
    """``docs`` with the least and the greatest of the confidences in a map column, 0 where it is empty or NULL."""
    of = lambda f: F.round(F.coalesce(f(F.map_values(F.col(confidences))), F.lit(0.0)), 3)
    return docs.withColumns({"min_confidence": of(F.array_min), "max_confidence": of(F.array_max)}).drop(confidences)
