"""Queries of the record-level problems: dangling references (p1) and nested records (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from directed_extract.functions.ids import canonical_pmid
from directed_extract.functions.jsonx import parse_object
from directed_extract.operators import nested, orphans
from directed_extract.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(table_name, row_id, key, at)`` of every row of the three tables that refer to documents."""
    line = parse_object(F.col("raw_line"))
    parts = (
        ("detections", "det_id", F.col("pmid"), "created_at"),
        ("benchmark_docs", "gold_id", F.col("pmid"), "annotated_at"),
        ("prediction_lines", "pred_id", F.try_variant_get(line, "$.PMID", "string"), "written_at"),
    )
    frames = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.col(i).alias("row_id"), canonical_pmid(p).alias("key"), F.col(at).alias("at")) for t, i, p, at in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def document_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    came = table(spark, sf_dir, "corpus_docs").select(canonical_pmid(F.col("pmid")).alias("key"), F.col("ingested_at").alias("at"))
    gone = table(spark, sf_dir, "doc_deletions").select(canonical_pmid(F.col("pmid")).alias("key"), F.col("deleted_at").alias("at"))
    return orphans.presence_intervals(came, gone)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each reference to a document that is not there at the time of the reference."""
    return orphans.dangling(references(spark, sf_dir), document_presence(spark, sf_dir)).select("table_name", "row_id")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and dangling references per table and month."""
    there = cut(document_presence(spark, sf_dir))
    out = orphans.orphan_report(orphans.judge(references(spark, sf_dir), there), there)
    return out.withColumn("period", F.date_format("period", "yyyy-MM"))


#: What prediction lines are known to hold, whether or not a batch happens to show it.
PREDICTION_MAPS = ("_multi_strategy.all_detections", "_multi_strategy.entity_strategies", "_multi_strategy.entity_confidence", "_multi_strategy.confidence_thresholds")
PREDICTION_LISTS = ("Entidad", "Entidad[].strategies", "_multi_strategy.all_detections{}", "_multi_strategy.entity_strategies{}", "_multi_strategy.strategies_used")
PREDICTION_FIELDS = ("Entidad[].texto", "Entidad[].strategies[].name", "_multi_strategy.all_detections{}[].name", "_multi_strategy.entity_strategies{}[].name")


def prediction_tables(spark: SparkSession, sf_dir: str) -> nested.Tables:
    lines = table(spark, sf_dir, "prediction_lines")
    structure = nested.infer_structure(lines, "raw_line", PREDICTION_MAPS, PREDICTION_LISTS, fields=PREDICTION_FIELDS)
    return nested.flatten(lines, "raw_line", "pred_id", structure)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each leaf of the three nested branches, from the child tables of the flattened lines."""
    t = prediction_tables(spark, sf_dir)
    named = lambda d: F.coalesce(F.col("f.name").cast("string"), F.col("value").cast("string")) if "name" in d.select("f.*").columns else F.col("value").cast("string")
    out = []
    for branch, path in (("entidad", "Entidad[].strategies[]"), ("all_detections", "_multi_strategy.all_detections{}[]"), ("entity_strategies", "_multi_strategy.entity_strategies{}[]")):
        d = t[path]
        d = d.filter("parent.texto is not null") if branch == "entidad" else d
        rows = d.select("pred_id", F.lit(branch).alias("branch"), F.col("parent_label").alias("parent_key"), F.col("pos").cast("int").alias("pos"), named(d).alias("leaf"))
        out.append(rows)
    return out[0].unionByName(out[1]).unionByName(out[2]).filter("leaf is not null")
