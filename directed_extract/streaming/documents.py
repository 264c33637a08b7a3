"""Extension: extraction over JSON lines as they arrive. The batch plan runs on each micro-batch; nothing is kept between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from directed_extract.operators.detect import regex_detect
from directed_extract.sources.jsonl import documents_from_lines


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as lines; a line's number is a hash of it, as there is no order between files."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return lines.withColumn("line_num", F.abs(F.xxhash64("value")))


def start_extraction(lines: DataFrame, out: str, checkpoint: str, also: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch's exact detections, written to one folder a batch: a batch that runs twice overwrites itself."""

    def batch(df: DataFrame, number: int) -> None:
        docs = documents_from_lines(df, "value", "line_num")
        found = regex_detect(docs, F.col("pmid"), "text", "candidates")
        (also(found) if also else found).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
