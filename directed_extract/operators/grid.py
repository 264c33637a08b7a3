"""Parameter grids, and results of grid runs by file, by parameter and at the top."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from directed_extract.config import REGEX, Strategy, overridden
from directed_extract.operators.detect import Calls, model_run, regex_detect
from directed_extract.operators.evaluate import evaluate_documents, metrics
from directed_extract.operators.scoring import scored
from directed_extract.sources.completer import Completer, call_tally

# The grids' axes.
CHUNK_TARGETS = (20, 40, 60, 80, 100)
CHUNK_OVERLAPS = (10, 20, 30, 40, 50)
TEMPERATURES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
MIN_CONFIDENCES = (0.1, 0.2, 0.3, 0.4, 0.5)
# Documents of a grid run, what stays the same over the window sizes, and over the temperatures.
GRID_DOCUMENTS = 20
CHUNK_GRID_CONFIDENCE, CHUNK_GRID_TEMPERATURE = 0.3, 0.5
TEMPERATURE_GRID_CHUNK = (100, 20)
# Names of result files.
CHUNK_FILE = r"^results_(llama|qwen)_n2c2_chunk(\d+)_ov(\d+)\.jsonl$"
TEMPERATURE_FILE = r"^results_temp([\d.]+)_conf([\d.]+)\.jsonl$"


def _axis(values: tuple) -> object:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def chunk_grid(spark: SparkSession) -> DataFrame:
    """Targets by overlaps, the overlap below the target."""
    g = spark.range(1).select(_axis(CHUNK_TARGETS).alias("chunk")).select("chunk", _axis(CHUNK_OVERLAPS).alias("overlap"))
    return g.filter(F.col("overlap") < F.col("chunk"))


def temperature_grid(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(_axis(TEMPERATURES).alias("temperature")).select("temperature", _axis(MIN_CONFIDENCES).alias("confidence"))


def file_parameters(df: DataFrame, file: str) -> DataFrame:
    """``df`` with ``model, chunk, overlap, temperature, confidence`` read from the file name; other names are left out."""
    part = lambda pattern, i, kind: F.when(F.col(file).rlike(pattern), F.regexp_extract(file, pattern, i)).try_cast(kind)
    got = df.withColumns({
        "model": part(CHUNK_FILE, 1, "string"), "chunk": part(CHUNK_FILE, 2, "int"), "overlap": part(CHUNK_FILE, 3, "int"),
        "temperature": part(TEMPERATURE_FILE, 1, "double"), "confidence": part(TEMPERATURE_FILE, 2, "double"),
    })
    return got.filter("model is not null or temperature is not null")


def file_profile(predictions: DataFrame) -> DataFrame:
    """By file: documents, entities, range and mean of confidence (missing counts as 0), distinct entities.

    Documents without entities count as documents.
    """
    each = predictions.select("file", "doc", F.explode_outer("entities").alias("e"))
    c = F.when(F.col("e").isNotNull(), F.coalesce("e.confidence", F.lit(0.0)))
    s = each.groupBy("file").agg(
        F.count_distinct("doc").alias("docs"), F.count("e").alias("entities"), F.avg(c).alias("a"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.count_distinct(F.lower("e.texto")).alias("unique_entities")
    )
    zero = lambda x: F.round(F.coalesce(F.col(x), F.lit(0.0)), 6)
    return s.select("file", "docs", "entities", zero("a").alias("avg_conf"), zero("lo").alias("min_conf"), zero("hi").alias("max_conf"), "unique_entities")


def results(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Profile and metrics of every grid file; metrics are rounded as they were once printed, and missing without a reference."""
    m = metrics(evaluate_documents(predictions, gold), "file", digits=3).select("file", "precision", "recall", "f1_score", "tp", "fp", "fn")
    return file_parameters(file_profile(predictions), "file").join(m, "file", "left")


def group_means(results: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Means of the measures for each of several groupings at once, in one pass; missing metrics are left out of a mean,
    a mean of nothing is 0. ``grouping`` names the grouping of a row, its other parameters are NULL.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}")
    measures = ["entities", "avg_conf", "precision", "recall", "f1_score"]
    grouped = results.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    got = grouped.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), *[mean(m) for m in measures])
    bits = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): "+".join(s) for s in sets}
    name = F.create_map(*[x for k, v in bits.items() for x in (F.lit(k).cast("bigint"), F.lit(v))])
    return got.select(name[F.col("g")].alias("grouping"), *columns, "n", *[f"mean_{m}" for m in measures])


def top_results(results: DataFrame, by: str, parameters: list[str], k: int = 10) -> DataFrame:
    """The best ``k`` runs by one measure; by F1 only those that have one above 0. Ties go by the parameters."""
    rows = results.filter("f1_score > 0") if by == "f1_score" else results
    return rows.orderBy(F.desc(by), *parameters).limit(k)


def ordered(means: DataFrame) -> DataFrame:
    """Group means by grouping, then by its parameters ascending."""
    return means.orderBy("grouping", *[c for c in means.columns if c not in ("grouping", "n") and not c.startswith("mean_")])


@dataclass(frozen=True)
class Point:
    """One run of a grid: the file its predictions go to, its detector, and the least confidence."""

    file: str
    strategy: Strategy
    least: float


def chunk_points(model: str = "llama", served: str = "llama3.2:3b", least: float = CHUNK_GRID_CONFIDENCE, temperature: float = CHUNK_GRID_TEMPERATURE) -> list[Point]:
    """The runs over window sizes; minimum and maximum follow from the target."""
    base = Strategy("grid", served, 1, 1, 1, 1, temperature, 1.0)
    sized = lambda t, o: replace(overridden([base], 0, t, o)[0], name=f"chunk{t}_ov{o}")
    return [Point(f"results_{model}_n2c2_chunk{t}_ov{o}.jsonl", sized(t, o), least) for t in CHUNK_TARGETS for o in CHUNK_OVERLAPS if o < t]


def temperature_points(served: str = "llama3.2:3b", target: int = TEMPERATURE_GRID_CHUNK[0], overlap: int = TEMPERATURE_GRID_CHUNK[1]) -> list[Point]:
    """The runs over temperature and least confidence. Runs of one temperature share their detector and so its calls."""
    base = Strategy("grid", served, 1, 1, 1, 1, 0.0, 1.0)
    heated = lambda h: replace(overridden([base], 0, target, overlap, temperature=h)[0], name=f"temp{h:.1f}")
    return [Point(f"results_temp{h:.1f}_conf{c:.1f}.jsonl", heated(h), c) for h in TEMPERATURES for c in MIN_CONFIDENCES]


@dataclass(frozen=True)
class GridRun:
    """Accepted entities ``(file, doc, entity, confidence, strategies)`` of every run, and its calls by file and status."""

    accepted: DataFrame
    tally: DataFrame


def run(docs: DataFrame, key: Column, text: str, candidates: str, points: list[Point], completer: Completer, calls: Calls = Calls()) -> GridRun:
    """All runs of a grid in one plan: the parameters are one more key of the detections, not one process each.

    Every distinct detector works once, however many runs use it; the temperature is part of what a prompt is asked under.
    The exact detector takes part in every run.
    """
    spark = docs.sparkSession
    distinct = list({p.strategy.name: p.strategy for p in points}.values())
    exact = regex_detect(docs, key, text, candidates)
    asked = model_run(docs, key, text, candidates, distinct, completer, by_heat=True, calls=calls)
    runs = spark.createDataFrame([(p.file, s, p.least) for p in points for s in (REGEX, p.strategy.name)], "file string, strategy string, least double")  # a few runs
    weights = spark.createDataFrame([(0, REGEX, 1.0)] + [(i, s.name, float(s.weight)) for i, s in enumerate(distinct, 1)], "ord int, strategy string, weight double")
    found = exact.unionByName(asked.detections).join(F.broadcast(runs), "strategy").select(F.struct("file", "least", "doc").alias("doc"), "strategy", "entity")
    scores = scored(found, weights).filter(F.col("confidence") >= F.col("doc.least"))
    accepted = scores.select("doc.file", "doc.doc", "entity", "confidence", "strategies")
    return GridRun(accepted, call_tally(asked.calls))


def lines_of(accepted: DataFrame, docs: DataFrame, points: list[Point]) -> DataFrame:
    """``(file, PMID, Texto, Entidad)``: a prediction line of every document (``doc, pmid, text``) for every run."""
    ordered_by = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "entity", "strategies")))
    entity = lambda x: F.struct(x["entity"].alias("texto"), F.lit("SpecificDisease").alias("tipo"), (-x["c"]).alias("confidence"), x["strategies"].alias("strategies"))
    lists = accepted.groupBy("file", "doc").agg(F.transform(ordered_by, entity).alias("Entidad"))
    every = docs.select("doc", "pmid", "text", F.explode(F.lit([p.file for p in points])).alias("file"))
    none = F.array().cast("array<struct<texto:string,tipo:string,confidence:double,strategies:array<string>>>")
    return every.join(lists, ["file", "doc"], "left").select("file", F.col("pmid").alias("PMID"), F.col("text").alias("Texto"), F.coalesce("Entidad", none).alias("Entidad"))
