"""Token files with B-, I- and O labels, and the entities they spell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from directed_extract.functions.text import strip

# Names of entity types.
TYPE_NAMES = {"problem": "SpecificDisease", "treatment": "Treatment", "test": "Test"}


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc, pos, token, label)`` of all ``.bio`` files of a folder; ``doc`` is the file's name without its ending.

    Lines are stripped; blank ones and those without exactly two tab-separated fields are left out. An empty folder gives
    no rows.
    """
    files = spark.read.option("pathGlobFilter", "*.bio").text(path, wholetext=True)
    doc = F.regexp_extract("_metadata.file_name", r"^(.*)\.bio$", 1)
    lines = files.select(doc.alias("doc"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    fields = lines.select("doc", "pos", F.split(strip(F.col("line")), "\t").alias("f")).filter(F.size("f") == 2)
    return fields.select("doc", "pos", F.col("f")[0].alias("token"), F.col("f")[1].alias("label"))


def decode(tokens: DataFrame) -> DataFrame:
    """``(doc, entity_no, type, text, n_tokens)`` of ``(doc, pos, token, label)``.

    ``B-x`` begins an entity; ``I-x`` goes on if the label before has the same type, else it begins one; anything else
    ends it. Windows run over one document each; a document is the unit of order here.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    kind = F.when(F.col("label").startswith("B-") | F.col("label").startswith("I-"), F.substring("label", 3, 1_000_000))
    t = tokens.withColumn("type", kind)
    before = F.lag("type").over(w)
    begins = F.col("type").isNotNull() & (F.col("label").startswith("B-") | before.isNull() | (before != F.col("type")))
    t = t.withColumn("g", F.sum(F.when(begins, 1).otherwise(0)).over(w)).filter("type is not null")
    got = t.groupBy("doc", "g").agg(F.first("type").alias("type"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"), F.count("*").alias("n_tokens"))
    return got.select("doc", F.col("g").alias("entity_no"), "type", F.array_join(F.transform("x", lambda s: s["token"]), " ").alias("text"), "n_tokens")


def documents(tokens: DataFrame) -> DataFrame:
    """``(PMID, Texto, Entidad)``: each document's text and its entities with their types renamed."""
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    text = tokens.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
    text = text.select("doc", F.array_join(F.transform("x", lambda s: s["token"]), " ").alias("Texto"))
    found = decode(tokens).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("entity_no", "text", "type"))).alias("e"))
    listed = F.transform("e", lambda e: F.struct(e["text"].alias("texto"), F.coalesce(F.try_element_at(names, e["type"]), e["type"]).alias("tipo")))
    empty = F.array().cast("array<struct<texto:string,tipo:string>>")
    return text.join(found, "doc", "left").select(F.col("doc").alias("PMID"), "Texto", F.coalesce(listed, empty).alias("Entidad"))
