"""Title, abstract and annotation lines in PubTator form as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from directed_extract.functions.text import key, strip
from directed_extract.session import cut

# Mentions of the general class that count as tumours or as genetic.
TUMOURS = ("cancer", "tumor", "tumour", "adenoma", "adenomas", "malignancy")
GENETIC = (
    "autosomal dominant disease", "genetic defect", "autosomal recessive disorder", "autosomal recessive lysosomal storage disorder", "complement deficiency",
    "inherited disorder", "allelic disorders", "maternal disomy", "uniparental disomy", "congenital eye malformations", "genetic diseases",
)


def kept_type(kind: Column, mention: Column) -> Column:
    """The type an annotation comes out with; NULL if it is dropped. Only specific diseases and the two classes stay."""
    m = F.regexp_replace(key(mention), r"\s+", " ")
    tumour = (kind == "DiseaseClass") & m.isin(*TUMOURS)
    genetic = (kind == "DiseaseClass") & m.isin(*GENETIC)
    return F.when(kind == "SpecificDisease", "SpecificDisease").when(tumour, "tumor").when(genetic, "genetica")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, part, pos, line)`` of text files: ``part`` and ``pos`` give the order of lines within a file.

    A file is read in as many splits as its size asks for; a split's first byte is its part, and lines keep their order in
    it. One large file is thus no single task.
    """
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def parse(lines: DataFrame, dedup: bool = True) -> DataFrame:
    """``(file, block, PMID, Texto, Entidad)`` of ``(file, part, pos, line)``; without ``part`` a file is one part.

    A document is a run of title, abstract and annotation lines of one number; a blank line or another number begins the
    next, so a number can come twice. Other lines mean nothing. The text is title and abstract, stripped, with a space
    between. ``dedup`` keeps the first of equal entities.

    Lines are ordered within their part only. What a part must know of those before it, the last number and how many
    documents began, is one row a part.
    """
    line = F.col("line")
    head = r"^(\d+)\|([ta])\|(.*)$"
    note = r"^(\d+)\t[^\t]*\t[^\t]*\t([^\t]*)\t([^\t]*)"
    got = lines if "part" in lines.columns else lines.withColumn("part", F.lit(0))
    got = got.select("file", "part", "pos", (strip(line) == "").alias("blank"), F.regexp_extract(line, head, 1).alias("h"), F.regexp_extract(line, head, 2).alias("sort"), F.regexp_extract(line, head, 3).alias("content"),
        F.regexp_extract(line, note, 1).alias("n"), F.regexp_extract(line, note, 2).alias("mention"), F.regexp_extract(line, note, 3).alias("kind"))
    got = cut(got.withColumn("pmid", F.when(F.col("h") != "", F.col("h")).when(F.col("n") != "", F.col("n"))).filter("blank or pmid is not null"))
    inside, across = Window.partitionBy("file", "part").orderBy("pos"), Window.partitionBy("file").orderBy("part")
    ends = got.groupBy("file", "part").agg(F.max_by("pmid", "pos").alias("last"))
    ends = ends.withColumn("earlier", F.lag("last").over(across)).select("file", "part", "earlier")
    before = F.when(F.row_number().over(inside) == 1, F.col("earlier")).otherwise(F.lag("pmid").over(inside))
    got = got.join(ends, ["file", "part"]).withColumn("before", before)
    begins = F.col("pmid").isNotNull() & (F.col("before").isNull() | (F.col("before") != F.col("pmid")))
    got = got.withColumn("begins", begins).withColumn("nth", F.count_if("begins").over(inside))
    begun = got.groupBy("file", "part").agg(F.count_if("begins").alias("n_begun"))
    begun = begun.select("file", "part", F.coalesce(F.sum("n_begun").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    got = got.join(begun, ["file", "part"]).withColumn("block", F.col("offset") + F.col("nth")).filter("pmid is not null")
    got = got.withColumn("tipo", F.when(F.col("n") != "", kept_type(F.col("kind"), F.col("mention"))))
    at = F.struct("part", "pos")
    last = lambda p: F.coalesce(strip(F.max_by("content", F.when(F.col("sort") == p, at))), F.lit(""))
    named = F.array_sort(F.collect_list(F.when(F.col("tipo").isNotNull(), F.struct(at.alias("at"), strip(F.col("mention")).alias("texto"), "tipo"))))
    docs = got.groupBy("file", "block", F.col("pmid").alias("PMID")).agg(last("t").alias("t"), last("a").alias("a"), named.alias("e"))
    entities = F.transform("e", lambda x: F.struct(x["texto"].alias("texto"), x["tipo"].alias("tipo")))
    return docs.select("file", "block", "PMID", strip(F.concat_ws(" ", "t", "a")).alias("Texto"), (F.array_distinct(entities) if dedup else entities).alias("Entidad"))
