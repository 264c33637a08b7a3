"""All queries of the core by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from directed_extract.plans import corpus, extraction, oracle

FLAGSHIP = "accepted_entities"

CORPUS = ("p1_found", "p1_report", "p3_found")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: getattr(corpus if name in CORPUS else extraction, name) for name in oracle.ORACLES
}
ORACLES: dict[str, str] = dict(oracle.ORACLES)
