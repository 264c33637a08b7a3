"""Queries that say whether results keep to what they must, where SQL can tell that but not the results themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from directed_extract.llm import entity_map, mixing, pii, pii_labels, queries
from directed_extract.session import cut

#: Share of the containers' space that must be filled if there is enough to fill them with.
WELL_FILLED = 0.95
#: Difference from its target within which a source's share must be.
CLOSE = 0.005


def p2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the mapped elements those written exactly like a name of the catalog, but for letter case and space around."""
    plain = lambda c: F.lower(F.trim(c))
    mapped = entity_map.map_elements(queries._typed(spark, sf_dir), "texto", queries.table(spark, sf_dir, "entity_catalog"), "concept_id", "texto", "aliases")
    said = F.array_union(F.array("texto"), F.coalesce("aliases", F.array().cast("array<string>")))
    names = queries.table(spark, sf_dir, "entity_catalog").select(F.explode(said).alias("name")).select(plain(F.col("name")).alias("name")).distinct()
    return mapped.withColumn("name", plain(F.col("texto"))).join(names, "name", "left_semi").select("line_id", "pos", F.col("concept").alias("concept_id"))


def p2_accounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: typed elements, and those that came out, either mapped or as an unmatched value."""
    typed = cut(queries._typed(spark, sf_dir))
    found = entity_map.map_elements(typed, "texto", queries.table(spark, sf_dir, "entity_catalog"), "concept_id", "texto", "aliases").agg(F.count("*").alias("n"))
    rest = queries.p2_unmatched(spark, sf_dir).agg(F.sum("n").alias("n"))
    out = found.unionByName(rest).agg(F.sum("n").alias("n_accounted"))
    return typed.agg(F.count("*").alias("n_typed")).withColumn("k", F.lit(1)).join(out.withColumn("k", F.lit(1)), "k").drop("k")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the redacted texts with each placeholder replaced by what it stands for: those of the texts themselves."""
    docs = queries.table(spark, sf_dir, "corpus_docs")
    spans = cut(queries._spans(spark, sf_dir))
    redacted = pii.redact(docs, "line_id", "texto", spans)
    hidden = docs.select("line_id", "texto").join(spans, "line_id").select("line_id", "s", F.expr("substring(texto, s + 1, e - s)").alias("was"))
    hidden = hidden.groupBy("line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "was"))), lambda x: x["was"]).alias("was"))
    kept = F.split("text", r"\[(?:" + "|".join(t.upper() for t in pii_labels.TYPES) + r")\]", -1)
    back = F.array_join(F.flatten(F.transform(F.arrays_zip(kept.alias("a"), F.coalesce("was", F.array().cast("array<string>")).alias("b")), lambda x: F.array(F.coalesce(x["a"], F.lit("")), F.coalesce(x["b"], F.lit(""))))), "")
    return redacted.filter("text is not null").join(hidden, "line_id", "left").select("line_id", F.md5(back).alias("text_md5"))


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record put together again from its pieces, with what its pieces must keep to."""
    rules = queries.table(spark, sf_dir, "split_limits").select("origin", "max_chars", "overlap_chars")
    default = rules.filter("origin = 'default'").first()
    before = F.lag("end_pos").over(Window.partitionBy("line_id").orderBy("piece_no"))
    pieces = queries.p5_pieces(spark, sf_dir).withColumn("shared", before - F.col("start_pos"))
    pieces = pieces.withColumn("new", F.expr("substring(piece, coalesce(shared, 0) + 1)"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "new"))), lambda x: x["new"]), "")
    whole = pieces.groupBy("line_id").agg(F.md5(text).alias("text_md5"), F.max(F.char_length("piece")).alias("longest"), F.min("shared").alias("least"), F.max("shared").alias("most"))
    docs = queries.table(spark, sf_dir, "corpus_docs").select("line_id", "origin").join(rules, "origin", "left")
    docs = docs.select("line_id", F.coalesce("max_chars", F.lit(default.max_chars)).alias("limit"), F.coalesce("overlap_chars", F.lit(default.overlap_chars)).alias("overlap"))
    fits = (F.col("longest") <= F.col("limit")).alias("within_limit")
    shares = (F.coalesce("least", "overlap") == F.col("overlap")) & (F.coalesce("most", "overlap") == F.col("overlap"))
    return whole.join(docs, "line_id").select("line_id", "text_md5", fits, shares.alias("exact_overlap"))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity: documents, those placed whole and once, and whether containers keep to it and are well filled."""
    packed, capacities = queries._packed(spark, sf_dir)
    packed = cut(packed)
    own = F.create_map(*[F.lit(x) for pair in capacities.items() for x in pair])[F.col("spec")]
    last = Window.partitionBy("spec", "doc_id").orderBy("part")
    joined = packed.withColumn("begins", F.coalesce(F.lag(F.col("from_pos") + F.col("tokens")).over(last), F.lit(0)) == F.col("from_pos"))
    docs = joined.groupBy("spec", "doc_id").agg(F.min("begins").alias("whole"), F.count("*").alias("parts"), F.sum("tokens").alias("t"))
    needed = F.greatest(F.ceil(F.col("t") / own), F.lit(1))
    docs = docs.groupBy("spec").agg(F.count("*").alias("n_docs"), F.count_if(F.col("whole") & (F.col("parts") == needed)).alias("n_placed"))
    bins = packed.groupBy("spec", "container").agg(F.sum("tokens").alias("t")).filter("t > 0").groupBy("spec").agg(F.max("t").alias("top"), F.sum("t").alias("t"), F.count("*").alias("n"))
    return docs.join(bins, "spec").select(
        F.col("spec").alias("spec_id"), own.alias("capacity_tokens"), "n_docs", "n_placed", (F.col("top") <= own).alias("within_capacity"), (F.col("t") >= WELL_FILLED * F.col("n") * own).alias("well_filled"),
    )


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target the share it should have, given the sources that have documents, and whether it has it without
    repeating any document too often."""
    blend, report = queries._mix(spark, sf_dir)
    limits = queries.table(spark, sf_dir, "mix_targets").select(mixing.source_key(F.col("source")).alias("source"), "max_repeats")
    uses = blend.groupBy("source", "doc_id").agg(F.count("*").alias("uses")).groupBy("source").agg(F.max("uses").alias("uses"))
    live = report.withColumn("live", F.when(F.col("tokens_available") > 0, F.col("target_share")).otherwise(0.0))
    due = F.col("live") / F.sum("live").over(Window.partitionBy(F.lit(0)))  # one row a source
    got = live.withColumn("due", due).join(uses, "source", "left").join(limits, "source")
    return got.select("source", F.round("due", 6).alias("due_share"), (F.abs(F.col("actual_share") - F.col("due")) <= CLOSE).alias("close"), (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"))
