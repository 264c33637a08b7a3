"""Queries of the extraction pipeline over the test tables: every operator over whole tables and whole texts."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from directed_extract import config
from directed_extract.functions import text as T
from directed_extract.operators import detect, evaluate, grid, matching, prepare, scoring
from directed_extract.operators.chunking import chunk_documents, sentence_chunks
from directed_extract.sources import bio, jsonl, pubtator
from directed_extract.sources.completer import FunctionCompleter, call_tally, live_entries
from directed_extract.session import cut, ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strategies(spark: SparkSession, sf_dir: str) -> list[config.Strategy]:
    return config.from_table(table(spark, sf_dir, "strategies"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights as the table has them, also of strategies that cannot run."""
    return table(spark, sf_dir, "strategies").select(F.col("ord").cast("int"), F.col("name").alias("strategy"), "weight")


# Scans, projections, filters


def jsonl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = jsonl.documents_from_lines(table(spark, sf_dir, "prediction_lines"), "raw_line", "pred_id")
    return d.select("line_num", "pmid", F.char_length("text").alias("n_chars"), F.size("candidates").alias("n_candidates"), F.md5(F.array_join("candidates", "|", "")).alias("candidates_md5"))


def documents_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = jsonl.documents_from_lines(table(spark, sf_dir, "prediction_lines"), "raw_line", "pred_id")
    return jsonl.limited(d, 100).select("line_num", "pmid")


def usable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.usable(table(spark, sf_dir, "corpus_docs"), "texto").select("line_id", T.preview(F.col("texto")).alias("preview"))


def surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.normalize_surface(c)).alias("surface"), F.md5(T.normalize_for_match(c)).alias("match_form"), F.size(T.words(c)).alias("n_words"), F.char_length(c).alias("n_letters"))


def _allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with only the entities that are tests in the catalog."""
    docs = table(spark, sf_dir, "corpus_docs").withColumn("entidad", F.coalesce("entidad", F.array().cast("array<struct<texto:string,tipo:string>>")))
    return prepare.filter_by_table(docs, "line_id", "entidad", table(spark, sf_dir, "entity_catalog").filter("tipo = 'Test'"), "texto")


def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allowed(spark, sf_dir).select("line_id", "entities_before", F.coalesce(F.size("entidad"), F.lit(0)).alias("entities_after"))


def allow_list_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.filter_statistics(_allowed(spark, sf_dir), "entidad")


def constant_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether they had entities, and the block they all have now, as a digest of names and types."""
    d = prepare.with_constant_candidates(table(spark, sf_dir, "corpus_docs"), "entidad", prepare.CANDIDATES)
    block = F.md5(F.array_join(F.transform("entidad", lambda e: F.concat(e["texto"], F.lit("/"), e["tipo"])), "|"))
    return d.groupBy("had_entities", block.alias("block_md5")).agg(F.count("*").alias("n_docs"), F.sum(F.size("entidad")).alias("n_candidates"))


def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five documents that have entities, for a look at them."""
    d = prepare.samples(table(spark, sf_dir, "corpus_docs"), "line_id", "entidad")
    return d.select("line_id", T.preview(F.coalesce("texto", F.lit(""))).alias("preview"), F.size("entidad").alias("n_entities"))


def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"SpecificDisease": "disease", "Treatment": "therapy", "Test": "procedure"}
    d = table(spark, sf_dir, "corpus_docs").select(F.explode(prepare.renamed_types(F.filter("entidad", lambda e: e.isNotNull()), names)).alias("e"))
    return d.groupBy(F.col("e.tipo").alias("tipo")).agg(F.count("*").alias("n"))


def valid_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s.name, s.is_valid, s.can_run) for s in strategies(spark, sf_dir)]
    return spark.createDataFrame(rows, "name string, is_valid boolean, can_run boolean")


# Windows of words


def _chunk_profile(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    c = chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", [s for s in strategies(spark, sf_dir) if s.can_run], unit)
    total = F.aggregate("chunks", F.lit(0), lambda s, x: s + F.char_length(x))
    return c.select("doc_id", "strategy", F.size("chunks").alias("n_chunks"), total.cast("bigint").alias("n_chars"), F.md5(F.array_join("chunks", "|")).alias("chunks_md5"))


def chunk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_profile(spark, sf_dir, "chars")


def chunk_profile_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_profile(spark, sf_dir, "words")


def sentence_chunk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", sentence_chunks(F.col("text"), 40, 10).alias("chunks"))
    return d.select("doc_id", F.size("chunks").alias("n_chunks"), F.md5(F.array_join("chunks", "|")).alias("chunks_md5"))


# Detection


def _candidates() -> object:
    return F.filter(F.transform("entidad", lambda e: e["texto"]), lambda t: t.isNotNull())


def regex_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "corpus_docs").withColumn("candidates", _candidates())
    return detect.regex_detect(docs, F.col("line_id"), "texto", "candidates").select(F.col("doc").alias("line_id"), "entity")


def answer_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "prediction_lines").select("pred_id", detect.parse_answer(F.coalesce("raw_line", F.lit(""))).alias("p"))
    return d.select("pred_id", "p.ok", F.size("p.terms").alias("n_terms"), F.md5(F.array_join("p.terms", "|")).alias("terms_md5"))


def prompt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct prompts of whole texts, by the key their answers are kept under."""
    system = F.lit(detect.SYSTEM_PROMPTS["default"])
    d = table(spark, sf_dir, "corpus_docs").filter("texto is not null").select(detect.prompt(F.lit("llama-nova:3b"), F.col("texto")).alias("prompt"))
    return d.groupBy(detect.prompt_key(F.lit("llama-nova:3b"), system, F.col("prompt")).alias("key")).agg(F.count("*").alias("n_uses"))


def cache_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities as cache entries that expire a day after they were last written; the cache holds 200."""
    d = table(spark, sf_dir, "detections").filter("entity is not null").groupBy(F.md5("entity").alias("key")).agg((F.max("created_at") + F.expr("interval 24 hours")).alias("expiry"))
    return live_entries(cut(d), "2024-06-01 00:00:00", 200).select("key", "expiry")


def stand_in_model(model: str, prompt: str) -> str:
    """A deterministic stand-in for a model: names what looks like a disease or gene, sometimes in a broken answer."""
    found = sorted(set(re.findall(r"[A-Z][a-z]{4,} syndrome(?: type \d)?|[A-Z]{4}\d{1,2}|[a-z]{6,}itis", prompt)))
    kind = len(prompt) % 7
    if kind == 0:
        return "No list today: " + ", ".join(found)
    return json.dumps({"present": found}) if kind == 1 else "Here it is: " + json.dumps(found)


def pipeline_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline with the stand-in model: exact and model detections, evidence, confidence, threshold."""
    run = [s for s in strategies(spark, sf_dir) if s.can_run and s.is_valid]
    docs = table(spark, sf_dir, "corpus_docs").filter("texto is not null").withColumn("candidates", F.coalesce(_candidates(), F.array().cast("array<string>")))
    exact = detect.regex_detect(docs, F.col("line_id"), "texto", "candidates")
    asked = detect.model_detect(docs, F.col("line_id"), "texto", "candidates", run, FunctionCompleter(stand_in_model))
    s = scoring.accepted(scoring.scored(exact.unionByName(asked), weights(spark, sf_dir)))
    return s.select(F.col("doc").alias("line_id"), "entity", "confidence", "n_strategies", F.array_join("strategies", ",").alias("strategies"))


def unsteady_model(model: str, prompt: str) -> str:
    """A stand-in for a server that refuses some prompts."""
    if len(prompt) % 5 == 0:
        raise ConnectionError("refused")
    return stand_in_model(model, prompt)


def call_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a run whose server refuses some prompts, by round and status."""
    run = [s for s in strategies(spark, sf_dir) if s.can_run and s.is_valid]
    docs = table(spark, sf_dir, "corpus_docs").filter("texto is not null").withColumn("candidates", F.coalesce(_candidates(), F.array().cast("array<string>")))
    asked = detect.model_run(docs, F.col("line_id"), "texto", "candidates", run, FunctionCompleter(unsteady_model), calls=detect.Calls(attempts=2, pause=0.0))
    return call_tally(asked.calls.filter("round = 1")).select("status", "n_calls", "n_attempts")


# Scores


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "detections")
    return d.select(F.concat("run_id", F.lit("/"), "pmid").alias("doc"), "strategy", "entity")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(_detected(spark, sf_dir), weights(spark, sf_dir))


def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc", "entity", F.round("weight", 6).alias("weight"), "n_strategies", F.array_join("strategies", ",").alias("strategies"), F.round("confidence", 6).alias("confidence"))


def score_standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scoring.evidence(_detected(spark, sf_dir), weights(spark, sf_dir))
    return e.select("doc", "entity", F.round(scoring.score_standalone(F.col("weight"), F.col("n_strategies"), F.col("has_regex")), 6).alias("confidence"))


def accepted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which each entity was accepted, with the mean confidence."""
    a = scoring.accepted(_scores(spark, sf_dir))
    return a.groupBy("entity").agg(F.count("*").alias("n_docs"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def accepted_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's most confident entity and how many were accepted."""
    a = scoring.accepted_lists(_scores(spark, sf_dir))
    return a.select("doc", F.element_at("entities", 1)["texto"].alias("first_entity"), F.size("entities").alias("n_accepted"))


def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confidence_summary(_scores(spark, sf_dir))


def confidence_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of confidence of each document over its entities by name."""
    d = _scores(spark, sf_dir).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("entity", "confidence"))).alias("c"))
    return scoring.confidence_ranges(d, "c")


def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confidence_histogram(scoring.accepted(_scores(spark, sf_dir)))


def strategy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.strategy_counts(scoring.accepted(_scores(spark, sf_dir)))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.run_summary(_detected(spark, sf_dir).filter("doc is not null"), scoring.accepted(_scores(spark, sf_dir)))


# Matching


def _texts(c: str) -> object:
    return F.filter(F.transform(c, lambda e: e["texto"]), lambda t: t.isNotNull())


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference entities of a document against those typed for it: ``(gold_id, line_id, detected, candidates)``."""
    g = table(spark, sf_dir, "benchmark_docs").filter("trim(pmid) <> ''").select("gold_id", "pmid", F.coalesce(_texts("entidad"), F.array().cast("array<string>")).alias("detected"))
    c = table(spark, sf_dir, "corpus_docs").select("line_id", "pmid", F.coalesce(_texts("entidad"), F.array().cast("array<string>")).alias("candidates"))
    return g.join(c, "pmid")


def entity_match_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_entities(_lists(spark, sf_dir), "detected", "candidates", ["gold_id", "line_id"])


def match_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_statistics(entity_match_classes(spark, sf_dir))


def candidate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "corpus_docs").select("line_id", F.transform("entidad", lambda e: e["texto"]).alias("candidates"))
    return matching.validate_candidates(d, "line_id", "candidates")


def match_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.suggestions(entity_match_classes(spark, sf_dir), candidate_validation(spark, sf_dir), "line_id")


def term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lists(spark, sf_dir).select("gold_id", "line_id", F.explode(detect.match_terms(F.col("detected"), F.col("candidates"))).alias("candidate"))
    return d


def char_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring typed entities of a document, compared by characters."""
    d = table(spark, sf_dir, "corpus_docs").select("line_id", _texts("entidad").alias("t")).filter("size(t) > 1")
    pairs = F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("a"), F.slice("t", 2, F.size("t") - 1).alias("b"))
    d = d.select("line_id", F.posexplode(pairs).alias("pos", "p")).select("line_id", "pos", "p.a", "p.b")
    m, n = T.normalize_for_match(F.col("a")), T.normalize_for_match(F.col("b"))
    return d.select("line_id", "pos", F.round(T.jaccard(m, n), 6).alias("similarity"), T.fuzzy(T.key(F.col("a")), T.key(F.col("b"))).alias("is_fuzzy"), T.matches_reference(m, n).alias("is_match"))


# Evaluation


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.predictions_from_lines(table(spark, sf_dir, "prediction_lines"), "raw_line", "pred_id", "file_name")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "benchmark_docs").withColumn("texts", F.coalesce(_texts("entidad"), F.array().cast("array<string>")))
    return evaluate.latest_gold(g, "pmid", "gold_id", "texts")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluate_documents(_predictions(spark, sf_dir), _gold(spark, sf_dir))


def eval_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).withColumnRenamed("doc", "pred_id").drop("file")


def eval_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(_judged(spark, sf_dir))


def eval_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluate_strategies(_predictions(spark, sf_dir), _gold(spark, sf_dir))


def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = evaluate.false_positives(_predictions(spark, sf_dir), _gold(spark, sf_dir))
    listed = F.array_join(F.array_sort("benchmark_entities"), "|").alias("benchmark_entities")
    return fp.select(F.col("doc").alias("pred_id"), "pmid", "entity", "confidence", F.array_join("strategies", ",").alias("strategies"), listed)


def false_positives_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = evaluate.false_positives(_predictions(spark, sf_dir), _gold(spark, sf_dir))
    return fp.select(F.explode("strategies").alias("strategy")).groupBy("strategy").agg(F.count("*").alias("n"))


def false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.false_negatives(_predictions(spark, sf_dir), _gold(spark, sf_dir))


def false_negative_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed entities with what was predicted for their document, and the beginning of its last delivered text."""
    texts = table(spark, sf_dir, "corpus_docs").filter("pmid is not null").groupBy("pmid").agg(F.max_by("texto", "line_id").alias("text"))
    fn = evaluate.false_negatives(_predictions(spark, sf_dir), _gold(spark, sf_dir), texts)
    return fn.select("pmid", "entity", F.array_join("predicted_entities", "|").alias("predicted_entities"), "preview")


def error_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_totals(cut(_predictions(spark, sf_dir)), _gold(spark, sf_dir))


def false_negatives_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return false_negatives(spark, sf_dir).groupBy("pmid").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("entity")), "|").alias("entities"))


# Grids


def param_grid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.chunk_grid(spark)


def param_grid_temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.temperature_grid(spark)


def grid_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.file_profile(_predictions(spark, sf_dir)).withColumnRenamed("file", "file_name")


def _grid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.results(cut(_predictions(spark, sf_dir)), _gold(spark, sf_dir))


def grid_means_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _grid_results(spark, sf_dir).filter("model is not null")
    return grid.group_means(r, [["model", "chunk"], ["model", "overlap"]])


def grid_means_temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _grid_results(spark, sf_dir).filter("temperature is not null").withColumnRenamed("confidence", "min_confidence")
    return grid.group_means(r, [["temperature"], ["min_confidence"]])


def grid_top_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _grid_results(spark, sf_dir).filter("model is not null")
    return grid.top_results(r, "f1_score", ["model", "chunk", "overlap"]).select("model", "chunk", "overlap", "f1_score", "entities")


def grid_top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _grid_results(spark, sf_dir).filter("temperature is not null")
    return grid.top_results(r, "entities", ["temperature", "confidence"]).select("temperature", F.col("confidence").alias("min_confidence"), "entities", "avg_conf")


# Label and annotation files, made from the tables


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, labelled by their length so that every succession of labels occurs."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(T.words(F.col("text"))).alias("pos", "token"))
    n = F.char_length("token") % 5
    return d.withColumn("label", F.when(n == 0, "B-problem").when(n == 1, "I-problem").when(n == 2, "I-test").otherwise("O"))


def bio_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bio.decode(_labelled(spark, sf_dir))
    return e.select(F.col("doc").alias("doc_id"), "entity_no", "type", F.md5("text").alias("text_md5"), "n_tokens")


def bio_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bio.documents(_labelled(spark, sf_dir))
    return d.select(F.col("PMID").alias("doc_id"), F.md5("Texto").alias("text_md5"), F.size("Entidad").alias("n_entities"), F.md5(F.array_join(F.transform("Entidad", lambda e: e["tipo"]), ",")).alias("types_md5"))


def pubtator_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated documents written as files of PubTator lines and read again. Lines of other identifiers mean nothing there."""
    d = table(spark, sf_dir, "benchmark_docs").withColumn("e", F.filter("entidad", lambda e: e["texto"].isNotNull()))
    note = lambda e: F.concat_ws("\t", F.col("pmid"), F.lit("0"), F.lit("9"), e["texto"], F.coalesce(e["tipo"], F.lit("Modifier")), F.lit("D0"))
    lines = F.concat(F.array(F.concat("pmid", F.lit("|t|Title "), F.col("gold_id").cast("string")), F.concat("pmid", F.lit("|a| Abstract "))), F.coalesce(F.transform("e", note), F.array().cast("array<string>")), F.array(F.lit("")))
    each = d.select((F.col("gold_id") % 16).alias("file"), "gold_id", F.posexplode(lines).alias("i", "line")).withColumn("line", F.coalesce("line", F.lit("")))
    path = f"{ensure_checkpoint_dir(spark)}/pubtator_{uuid.uuid4().hex}"
    each.repartition("file").sortWithinPartitions("file", "gold_id", "i").select("file", "line").write.partitionBy("file").text(path)
    got = pubtator.parse(pubtator.read_lines(spark, path))
    return got.select("PMID", "Texto", F.size("Entidad").alias("n_entities"), F.md5(F.array_join(F.transform("Entidad", lambda e: F.concat_ws("/", e["texto"], e["tipo"])), "|")).alias("entities_md5"))
