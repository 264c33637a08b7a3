"""Exact detection, and detection through a language model: prompts, one call a distinct prompt, answers, matching."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from directed_extract.config import REGEX, Strategy
from directed_extract.functions import text as T
from directed_extract.functions.jsonx import let, parse_strict
from directed_extract.operators.chunking import MOST_WINDOWS, chunk_documents
from directed_extract.operators.skew import join_groups
from directed_extract.session import cut
from directed_extract.sources.completer import ATTEMPTS, PAUSE, Completer, complete_prompts

# The prompts.
SYSTEM_PROMPTS = {
    "qwen2.5:3b": """You are a disease extractor. Extract disease names from biomedical text.

CRITICAL: Do NOT use reasoning or thinking. Return ONLY a JSON list of disease names.
Example: ["disease1", "disease2"]""",
    "default": """You are a biomedical entity extractor. Extract disease names and medical conditions from the text.

RULES:
1. Only extract entities that are diseases/conditions
2. Be conservative - if unsure, don't extract
3. Return entities in valid JSON format
4. Evidence must be the EXACT literal mention from the text

Output ONLY valid JSON with no explanations.""",
}
SHORT_PROMPT = ("TEXT: ", '\n\nEXTRACT disease names. Return ONLY: ["disease1", "disease2"]')
LONG_PROMPT = ("Diseases in this text: ", '\n\nReturn ONLY a JSON list like: ["disease1", "disease2"]')
SECOND_PROMPT = ("TEXT: ", '\n\nEXTRACT disease names. If you find any diseases, return them as: ["disease1", "disease2"]\nIf you find NO diseases, return: []')
SHORT_PROMPT_MODEL = "qwen2.5:3b"
# What names a disease or gene in plain text, the last resort.
FALLBACK_PATTERNS = (
    r"(?iU)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:disease|syndrome|cancer|tumor|anemia|deficiency|mutation|gene)\b",
    r"(?iU)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:G\d+PD|BRCA\d+|ATM|LCAT)\b",
    r"(?iU)\b(?:G6PD|BRCA1|BRCA2|ATM|LCAT)\b",
)


def regex_detect(docs: DataFrame, key: Column, text: str, candidates: str) -> DataFrame:
    """``(doc, strategy, entity)``: each document's own candidates that occur in its text between word boundaries.

    Candidates are exploded within their row, not joined. Each occurs once however often it is listed or found; NULL and
    blank candidates and NULL texts find nothing.
    """
    surface = T.normalize_surface(F.col(text))
    each = docs.select(key.alias("doc"), surface.alias("t"), F.explode(F.array_distinct(candidates)).alias("entity"))
    return each.filter(F.col("entity").isNotNull() & T.occurs(F.col("t"), F.col("entity"))).select("doc", F.lit(REGEX).alias("strategy"), "entity")


def parse_answer(answer: Column, objects: bool = True) -> Column:
    """``struct<ok boolean, terms array<string>>`` of a model's answer.

    The span from the first ``[`` to the last ``]`` must be a JSON list. Without any such span, and if ``objects``, the
    span from the first ``{`` to the last ``}`` must be a JSON object, whose ``present`` must be a list or missing. Only
    texts that are not empty are terms. Anything else is not ok.
    """
    listed = F.regexp_extract(answer, r"(?s)\[.*\]", 0)
    braced = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    texts = lambda v: F.filter(F.transform(F.filter(v, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")), lambda s: s != "")
    none = F.array().cast("array<string>")
    verdict = lambda ok, terms: F.struct(ok.alias("ok"), F.coalesce(terms, none).alias("terms"))
    array = lambda v: F.try_variant_get(v, "$", "array<variant>")
    from_list = let(parse_strict(F.when(listed != "", listed)), lambda v: let(array(v), lambda a: verdict(a.isNotNull(), texts(a))))

    def of_object(v: Column) -> Column:
        present = F.try_variant_get(v, "$.present", "variant")
        is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        return let(present, lambda p: verdict(is_object & (p.isNull() | array(p).isNotNull()), texts(array(p))))

    from_object = let(parse_strict(F.when(braced != "", braced)), of_object)
    failed = verdict(F.lit(False), none)
    return F.when(listed != "", from_list).when((braced != "") & F.lit(objects), from_object).otherwise(failed)


def match_terms(terms: Column, candidates: Column) -> Column:
    """For each term the first candidate in list order that equals it, contains it, is contained in it or is alike.

    Candidates keep their spelling; terms without a match are left out; each candidate comes out once.
    """

    def first(term: Column) -> Column:
        t = T.key(term)
        return F.try_element_at(F.filter(candidates, lambda c: (T.key(c) == t) | T.contained(T.key(c), t) | T.fuzzy(t, T.key(c))), F.lit(1))

    return F.array_distinct(F.filter(F.transform(terms, first), lambda c: c.isNotNull()))


def fallback_mentions(answer: Column) -> Column:
    """Disease-like mentions in plain text."""
    return F.concat(*[F.regexp_extract_all(answer, F.lit(p), F.lit(0)) for p in FALLBACK_PATTERNS])


def fallback_terms(answer: Column, candidates: Column) -> Column:
    """The mentions in plain text that equal a candidate but for letter case."""
    known = F.transform(candidates, lambda c: F.lower(c))
    return F.filter(fallback_mentions(answer), lambda m: F.array_contains(known, F.lower(m)))


def prompt(model: Column, chunk: Column) -> Column:
    wrap = lambda p: F.concat(F.lit(p[0]), chunk, F.lit(p[1]))
    return F.when(model == SHORT_PROMPT_MODEL, wrap(SHORT_PROMPT)).otherwise(wrap(LONG_PROMPT))


def second_prompt(chunk: Column) -> Column:
    return F.concat(F.lit(SECOND_PROMPT[0]), chunk, F.lit(SECOND_PROMPT[1]))


def system_prompt(strategies: Iterable[Strategy]) -> str:
    """One for the whole run: that of the short-prompt model if any strategy uses it."""
    return SYSTEM_PROMPTS[SHORT_PROMPT_MODEL if any(s.model == SHORT_PROMPT_MODEL for s in strategies) else "default"]


def prompt_key(model: Column, system: Column, user: Column) -> Column:
    """The key under which an answer is kept."""
    return F.md5(F.concat(model, F.lit(":"), system, F.lit(":"), user))


class NoModel:
    """Stands for a model where there is none: it names nothing."""

    def complete(self, model: str, system: str, prompt: str, temperature: float) -> str:
        return "[]"


@dataclass(frozen=True)
class Calls:
    """How a run calls its model: tasks that call at a time (None: as many as there are), attempts for a prompt, seconds
    between them, and the share of failed prompts above which the run is given up."""

    at_once: int | None = None
    attempts: int = ATTEMPTS
    pause: float = PAUSE
    most_failed: float = 1.0


@dataclass(frozen=True)
class Asked:
    """Detections of a run and the calls behind them (``key, answer, status, attempts, seconds, error, round``)."""

    detections: DataFrame
    calls: DataFrame


def model_windows(docs: DataFrame, strategies: list[Strategy], system: str, unit: str = "chars", by_heat: bool = False, cap: int | None = MOST_WINDOWS) -> DataFrame:
    """``(doc, strategy, ord, model, key, chunk)``: every window of every text under every strategy.

    ``key`` is the digest of what is asked. ``chunk`` is NULL where the window is the whole text, so that texts are not
    written once for each strategy. ``by_heat``: the temperature is part of the key.
    """
    windows = chunk_documents(docs.select("doc", "text"), "text", strategies, unit, cap).select("doc", "text", "strategy", "model", F.explode("chunks").alias("chunk"))
    order = F.create_map(*[x for i, s in enumerate(strategies) for x in (F.lit(s.name), F.lit(i))]) if strategies else F.lit(None).cast("map<string,int>")
    windows = windows.filter(T.strip(F.col("chunk")) != "").withColumn("ord", order[F.col("strategy")])
    asked = prompt_key(F.col("model"), F.lit(system), prompt(F.col("model"), F.col("chunk")))
    if by_heat and strategies:
        heat = F.create_map(*[x for i, s in enumerate(strategies) for x in (F.lit(i), F.lit(str(s.temperature)))])
        asked = F.md5(F.concat(asked, heat[F.col("ord")]))
    return windows.select(F.col("doc").alias("doc"), "strategy", "ord", "model", asked.alias("key"), F.nullif(F.col("chunk"), F.col("text")).alias("chunk"))


def model_detect(docs: DataFrame, key: Column, text: str, candidates: str, strategies: list[Strategy], completer: Completer, unit: str = "chars") -> DataFrame:
    """The detections of :func:`model_run`."""
    return model_run(docs, key, text, candidates, strategies, completer, unit).detections


def model_run(docs: DataFrame, key: Column, text: str, candidates: str, strategies: list[Strategy], completer: Completer, unit: str = "chars", by_heat: bool = False, calls: Calls = Calls(), cap: int | None = MOST_WINDOWS) -> Asked:
    """``(doc, strategy, entity)``: candidates that a model's answers name, over all windows of all strategies.

    Each distinct (model, system prompt, prompt) is asked once, with the temperature of the first strategy that needs it,
    and its answer serves all windows. A first answer that cannot be read is followed by one second prompt, then by the
    fallback on that answer. ``key`` must be unique.

    Windows are worked out once and kept in the checkpoint folder as narrow rows. Whole texts travel once for each
    distinct prompt. Windows and answers meet by the digest of the prompt, prompts of many windows by broadcast; candidates
    join at the end, and a document's term is compared with them once, whatever the number of windows that named it.
    """
    system = system_prompt(strategies)
    base = docs.select(key.alias("doc"), F.col(text).alias("text"), F.array_distinct(F.filter(candidates, lambda c: c.isNotNull())).alias("candidates"))
    windows = cut(model_windows(base, strategies, system, unit, by_heat, cap))
    heat = {i: float(s.temperature or 0.0) for i, s in enumerate(strategies)}
    asked = windows.groupBy("key").agg(F.min("ord").alias("ord"), F.max("model").alias("model"), F.max("chunk").alias("chunk"), F.min("doc").alias("doc"), F.count("*").alias("n"))
    whole = asked.filter("chunk is null").drop("chunk").join(base.select("doc", F.col("text").alias("chunk")), "doc")
    asked = cut(asked.filter("chunk is not null").unionByName(whole).drop("doc"))
    once = lambda rows: complete_prompts(rows, completer, system, heat, calls.at_once, calls.attempts, calls.pause, calls.most_failed)
    first = once(asked.withColumn("prompt", prompt(F.col("model"), F.col("chunk"))))
    read = first.select("key", parse_answer(F.col("answer")).alias("parsed"))
    again = asked.join(read.filter("not parsed.ok").select("key"), "key").withColumn("prompt", second_prompt(F.col("chunk")))
    second = once(again)
    late = second.select("key", "answer", parse_answer(F.col("answer"), objects=False)["terms"].alias("terms"))
    named = lambda terms, loose: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(loose).alias("loose")))
    terms = F.when(F.size("terms") > 0, named(F.col("terms"), False)).otherwise(named(fallback_mentions(F.col("answer")), True))
    answers = read.filter("parsed.ok").select("key", named(F.col("parsed.terms"), False).alias("terms")).unionByName(late.select("key", terms.alias("terms")))
    answers = cut(answers.filter(F.size("terms") > 0).join(asked.select("key", "n"), "key"))
    told = join_groups(windows.select("doc", "strategy", "key"), answers, "key", "n").select("doc", "strategy", F.explode("terms").alias("x"))
    told = told.groupBy("doc", "x").agg(F.collect_set("strategy").alias("by"))
    met = told.join(base.select("doc", "candidates"), "doc").filter(~F.col("x.loose") | F.exists("candidates", lambda c: F.lower(c) == F.lower(F.col("x.term"))))
    met = met.select("doc", "by", F.explode(match_terms(F.array("x.term"), F.col("candidates"))).alias("entity"))
    found = met.select("doc", F.explode("by").alias("strategy"), "entity").distinct()
    return Asked(found, first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2))))
