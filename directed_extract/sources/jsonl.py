"""JSON lines as documents and as predictions, read leniently or strictly, and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from directed_extract.functions.jsonx import let, parse_object
from directed_extract.functions.text import strip
from directed_extract.session import cut

#: Schema of prediction files for the strict reader.
PREDICTIONS = (
    "PMID string, Texto string, Entidad array<struct<texto string, tipo string, confidence double, strategies array<string>>>, "
    "_multi_strategy struct<all_detections map<string,array<string>>, entity_confidence map<string,double>, entity_strategies map<string,array<string>>, "
    "confidence_thresholds map<string,double>, strategies_used array<string>>, _latency_sec double"
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_num, value)``: the lines of text files, numbered from 1 in file order.

    Spark's text reader has no line numbers. ``zipWithIndex`` gives them in two passes, each split on its own.
    """
    lines = spark.read.text(path).rdd.zipWithIndex()
    return lines.map(lambda x: (x[1] + 1, x[0][0])).toDF("line_num bigint, value string")


def _pmid(v: Column, line_num: Column) -> Column:
    given = F.try_variant_get(v, "$.PMID", "variant")
    text = lambda p: F.when(p.isNull(), F.concat(F.lit("doc_"), (line_num - 1).cast("string"))).when(F.is_variant_null(p), "None").otherwise(F.try_variant_get(p, "$", "string"))
    return let(given, text)


def _texts_of(v: Column) -> Column:
    """The ``texto`` of each element that is an object with one, in order."""
    items = F.filter(F.try_variant_get(v, "$.Entidad", "array<variant>"), lambda e: F.try_variant_get(e, "$.texto", "variant").isNotNull() & F.schema_of_variant(e).startswith("OBJECT"))
    return F.transform(items, lambda e: F.try_variant_get(e, "$.texto", "string"))


def documents_from_lines(lines: DataFrame, raw: str, line_num: str) -> DataFrame:
    """``(line_num, pmid, text, candidates)`` of the lines that hold a usable document.

    Left out are blank lines, lines that are no JSON object, texts that are missing, blank or no text, and an ``Entidad``
    that is null, a number or a truth value. A missing ``PMID`` becomes ``doc_`` and the line's place from 0, a null one
    ``None``, a number its digits. A missing ``Entidad``, or one that is no list, means no candidates; of a list only
    objects with ``texto`` are candidates.
    """
    v = lines.select(F.col(line_num).cast("bigint").alias("line_num"), parse_object(F.col(raw)).alias("v")).filter("v is not null")
    kind = F.schema_of_variant(F.try_variant_get("v", "$.Entidad", "variant"))
    text = F.when(F.schema_of_variant(F.try_variant_get("v", "$.Texto", "variant")) == "STRING", F.try_variant_get("v", "$.Texto", "string"))
    rows = v.filter(kind.isNull() | kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "STRING"))
    rows = rows.select("line_num", _pmid(F.col("v"), F.col("line_num")).alias("pmid"), text.alias("text"), F.coalesce(_texts_of(F.col("v")), F.array().cast("array<string>")).alias("candidates"))
    return rows.filter(strip(F.col("text")) != "")


def limited(docs: DataFrame, limit: int = 0) -> DataFrame:
    """The first ``limit`` usable documents in line order; 0 means all."""
    return docs.orderBy("line_num").limit(limit) if limit else docs


def predictions_from_lines(lines: DataFrame, raw: str, doc: str, file: str) -> DataFrame:
    """``(doc, file, pmid, entities)`` of the lines that are JSON objects with an ``Entidad`` list.

    ``entities`` are structs of ``texto``, ``confidence`` (NULL if it is no number) and ``strategies`` (texts of a list,
    else empty), in order; elements that are no objects or lack a ``texto`` that is text are left out.
    """
    v = lines.select(F.col(doc).alias("doc"), F.col(file).alias("file"), parse_object(F.col(raw)).alias("v")).filter("v is not null")
    items = F.filter(F.try_variant_get("v", "$.Entidad", "array<variant>"), lambda e: F.schema_of_variant(F.try_variant_get(e, "$.texto", "variant")) == "STRING")
    named = lambda e: F.filter(F.try_variant_get(e, "$.strategies", "array<variant>"), lambda s: F.schema_of_variant(s) == "STRING")
    struct = lambda e: F.struct(
        F.try_variant_get(e, "$.texto", "string").alias("texto"), F.try_variant_get(e, "$.confidence", "double").alias("confidence"),
        F.coalesce(F.transform(named(e), lambda s: F.try_variant_get(s, "$", "string")), F.array().cast("array<string>")).alias("strategies"),
    )
    rows = v.select("doc", "file", _pmid(F.col("v"), F.col("doc")).alias("pmid"), F.transform(items, struct).alias("entities"))
    return rows.filter("entities is not null")


def read_prediction_files(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of all ``.jsonl`` files of a folder or pattern, as :func:`predictions_from_lines` gives them, by the name
    of the file or, where a file was written in parts, of its folder.

    Lines get a number that is unique over all files and fixed once the lines are written to the checkpoint folder.
    """
    name = F.regexp_extract("_metadata.file_path", r"([^/=]+\.jsonl)(?:/[^/]*)?$", 1)
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", name.alias("file"), F.monotonically_increasing_id().alias("line"))
    return predictions_from_lines(cut(lines.filter("file <> ''")), "value", "line", "file")


def read_documents(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    return limited(documents_from_lines(numbered_lines(spark, path), "value", "line_num"), limit)


def read_strict(spark: SparkSession, path: str, schema: str = PREDICTIONS) -> DataFrame:
    """All lines under a fixed schema; a malformed line is an error when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_lines(df: DataFrame, path: str, single_file: bool = False) -> None:
    """One JSON object a line, null fields kept, letters as they are. One file only on request: it takes one task."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_by_file(df: DataFrame, file: str, path: str) -> None:
    """JSON lines in one folder for each value of ``file``, all written by one job."""
    rows = df.select(file, F.to_json(F.struct(*[F.col(c) for c in df.columns if c != file]), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.mode("overwrite").partitionBy(file).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result table with a header, as one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Write only if there are rows; says whether it did."""
    if df.isEmpty():
        return False
    write_lines(df, path)
    return True
