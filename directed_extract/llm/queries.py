"""Queries of the text problems over the test tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from directed_extract.llm import canonical, entity_map, ledger, mixing, packing, pii, sizes, splitting
from directed_extract.session import cut, ensure_checkpoint_dir


#: Capacities that are packed for in one pass.
PASS_SPECS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "corpus_docs").select("line_id", F.posexplode("entidad").alias("pos", "e"))
    return each.select("line_id", "pos", F.col("e.texto").alias("texto")).filter("texto is not null")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed element that denotes a catalog entry, with the entry."""
    mapped = entity_map.map_elements(_typed(spark, sf_dir), "texto", table(spark, sf_dir, "entity_catalog"), "concept_id", "texto", "aliases")
    return mapped.select("line_id", "pos", F.col("concept").alias("concept_id"))


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed values that denote nothing in the catalog, and how often each was typed."""
    typed = cut(_typed(spark, sf_dir))
    counts = typed.groupBy("texto").agg(F.count("*").alias("n"))
    mapped = entity_map.map_values(typed, "texto", table(spark, sf_dir, "entity_catalog"), "concept_id", "texto", "aliases")
    return counts.join(mapped.select(F.col("value").alias("texto")), "texto", "left_anti")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = pii.gazetteer(table(spark, sf_dir, "name_lexicon"), "name", "kind")
    return pii.find_spans(table(spark, sf_dir, "corpus_docs"), "line_id", "texto", known)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of personal information in the corpus texts, with its first character (from 1)."""
    return _spans(spark, sf_dir).select("line_id", "pii_type", (F.col("s") + 1).alias("start_pos"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus texts with placeholders."""
    return pii.redact(table(spark, sf_dir, "corpus_docs"), "line_id", "texto", _spans(spark, sf_dir))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all corpus texts."""
    return splitting.split_oversized(table(spark, sf_dir, "corpus_docs"), "line_id", "texto", table(spark, sf_dir, "split_limits"), "origin")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that had to be cut: those with a second piece."""
    return p5_pieces(spark, sf_dir).filter("piece_no = 1").select("line_id")


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ledger.Ledger]:
    """The keyed candidate records, and a ledger that took them in as two deliveries."""
    lines = table(spark, sf_dir, "candidate_lines").filter("raw_record is not null")
    keyed = cut(lines.select(ledger.canonical_key(F.col("raw_record")).alias("key"), F.col("cand_id").alias("id"), "received_at"))
    span = keyed.agg(F.expr("to_timestamp(min(received_at) + (max(received_at) - min(received_at)) / 2)").alias("middle")).first()
    late = F.coalesce(F.col("received_at") > F.lit(span.middle), F.lit(False))
    book = ledger.Ledger(spark, f"{ensure_checkpoint_dir(spark)}/ledger_{uuid.uuid4().hex}")
    for part in (keyed.filter(~late), keyed.filter(late)):
        book.add(part.select("key", "id"))
    return keyed, book


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that is not the first of its kind, with the first."""
    keyed, book = _candidates(spark, sf_dir)
    return ledger.later_copies(keyed.select("key", "id"), book.read())


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each kind of record: its first record and the number of copies."""
    _, book = _candidates(spark, sf_dir)
    first = table(spark, sf_dir, "candidate_lines").select(F.col("cand_id").alias("keep_id"), "raw_record")
    return book.read().select(F.col("first_id").alias("keep_id"), F.col("n").alias("n_copies")).join(first, "keep_id")


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[int, int]]:
    """The packing for every row of pack_specs, a table of settings; each pass over the documents serves many rows."""
    specs = table(spark, sf_dir, "pack_specs").filter("capacity_tokens > 0").orderBy("spec_id").collect()
    tokens = cut(sizes.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
    passes = [{r.spec_id: r.capacity_tokens for r in specs[i : i + PASS_SPECS]} for i in range(0, max(1, len(specs)), PASS_SPECS)]
    return reduce(DataFrame.unionByName, [packing.pack_all(tokens, "doc_id", "tokens", p) for p in passes]), {r.spec_id: r.capacity_tokens for r in specs}


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its container, for each capacity of pack_specs."""
    return _packed(spark, sf_dir)[0].withColumnRenamed("spec", "spec_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers of each capacity are filled."""
    return packing.fill_report(*_packed(spark, sf_dir)).withColumnRenamed("spec", "spec_id").withColumnRenamed("capacity", "capacity_tokens")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(sizes.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", keep=("source",)))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_sized(spark, sf_dir), "doc_id", "source", "tokens", table(spark, sf_dir, "mix_targets"))


def p8_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uses of documents that make up the blend."""
    return _mix(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of each source."""
    return _mix(spark, sf_dir)[1]


def p8_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural shares, and those tempered to the entropy of the targets."""
    return mixing.temperature_report(_sized(spark, sf_dir), "source", "tokens", table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same and are not equal."""
    return canonical.looking_alike(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the class of documents that look like it."""
    return canonical.classes(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in their consistent form, and the digest of the folded form used for comparisons."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", canonical.canonical(spark, F.col("text")).alias("form"), F.md5(canonical.canonical(spark, F.col("text"), fold=True)).alias("folded_digest"))
