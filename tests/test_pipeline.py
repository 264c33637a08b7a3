import random

import pytest
from pyspark.sql import functions as F

from directed_extract import config
from directed_extract.functions import text as T
from directed_extract.operators import detect, evaluate, grid, matching, prepare, scoring
from directed_extract.operators.chunking import chunks, sentence_chunks, window_starts
from directed_extract.operators.ranking import rank_within
from directed_extract.operators.skew import join_groups
from directed_extract.plans import extraction
from directed_extract.sources import bio, jsonl, pubtator
from directed_extract.sources.completer import FunctionCompleter, StaticCompleter


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in cols.items()])


def value(df, c):
    return df.select(c.alias("x")).first()[0]


LINES = [
    '{"PMID": "1", "Texto": "a", "Entidad": [{"texto": "x"}, {"texto": "y"}]}', "  ", "not json", '{"PMID": "3"}', '{"Texto": "b"}', '{"PMID": 7, "Texto": "c", "Entidad": []}',
    '{"PMID": null, "Texto": "d"}', '{"PMID": "7", "Texto": "   "}', '{"PMID": "8", "Texto": "e", "Entidad": null}', '{"PMID": "9", "Texto": "f", "Entidad": ["s", {"texto": "z"}, {"tipo": "t"}]}', '{"PMID": "10", "Texto": "g"}',
]


def test_document_lines(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    got = [(r.line_num, r.pmid, r.candidates) for r in jsonl.read_documents(spark, str(tmp_path / "d.jsonl")).orderBy("line_num").collect()]
    assert got == [(1, "1", ["x", "y"]), (5, "doc_4", []), (6, "7", []), (7, "None", []), (10, "9", ["z"]), (11, "10", [])]
    assert jsonl.read_documents(spark, str(tmp_path / "d.jsonl"), 2).count() == 2
    (tmp_path / "empty.jsonl").write_text("")
    assert jsonl.read_documents(spark, str(tmp_path / "empty.jsonl")).count() == 0


def test_strict_reader_and_sinks(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"PMID": "1", "Texto": "é"}\n')
    good = jsonl.read_strict(spark, str(tmp_path / "p.jsonl"))
    jsonl.write_lines(good, str(tmp_path / "out"), single_file=True)
    assert "é" in next((tmp_path / "out").glob("*.json")).read_text(encoding="utf-8")
    jsonl.write_csv(good.select("PMID"), str(tmp_path / "csv"))
    assert not jsonl.write_if_any(good.filter("false"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    (tmp_path / "bad.jsonl").write_text('{"PMID": "1"\n')
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read_strict(spark, str(tmp_path / "bad.jsonl")).collect()


def loop_starts(n, t, o, most=1000):
    o = o if o < t else max(1, t // 2)
    out, start = [], 0
    while start < n and len(out) < most:
        out.append(start)
        end = min(start + t, n)
        start = end - o if end - o > start else start + 1
    return out


@pytest.mark.parametrize(("t", "o"), [(5, 2), (5, 0), (5, 5), (1, 3), (100, 40), (20, 10)])
def test_window_starts(spark, t, o):
    ns = [0, 1, 2, 4, 5, 6, 12, 59, 100, 101, 237, 3000]
    df = spark.createDataFrame([(n,) for n in ns], "n int")
    for r in df.select("n", window_starts(F.col("n"), t, o).alias("s")).collect():
        assert r.s == loop_starts(r.n, t, o), (r.n, t, o)


def test_chunks(spark):
    text = " ".join(f"w{i}" for i in range(12))
    df = one(spark, t=text, e="", s="  a\tb ")
    assert value(df, chunks(F.col("t"), 5, 2, 3, 100)) == ["w0 w1 w2 w3 w4", "w3 w4 w5 w6 w7", "w6 w7 w8 w9 w10", "w9 w10 w11"]
    assert value(df, chunks(F.col("t"), 5, 2, 3, 5)) == [text]
    assert value(df, chunks(F.col("t"), 5, 2, 3, 5, unit="words"))[0] == "w0 w1 w2 w3 w4"
    assert value(df, chunks(F.col("s"), 5, 2, 3, 100)) == ["  a\tb "] and value(df, chunks(F.col("e"), 5, 2, 3, 100)) == [""]
    assert value(df, sentence_chunks(F.col("t"), 12, 2)) == [text]
    assert value(df, chunks(F.lit(None).cast("string"), 5, 2, 3, 100)) is None
    long = one(spark, t="x " * 50_000)
    assert len(value(long, chunks(F.col("t"), 20, 10, 10, 200))) == 1000


def test_text_forms(spark):
    df = one(spark, t="\x1c A –  B — c ", n="")
    assert value(df, T.normalize_surface(F.col("t"))) == "A - B - c"
    assert value(df, T.normalize_for_match(F.col("t"))) == "a - b - c"
    assert value(df, T.words(F.col("t"))) == ["A", "–", "B", "—", "c"]
    assert value(df, T.normalize_surface(F.lit(None).cast("string"))) == ""
    assert value(df, T.fuzzy(F.lit("the end"), F.lit("end of")))
    assert not value(df, T.fuzzy(F.lit("the"), F.lit("the"))) and not value(df, T.fuzzy(F.lit("diabetes mellitus"), F.lit("diabetes")))
    assert value(df, T.matches_reference(F.lit(""), F.lit("x"))) and not value(df, T.matches_reference(F.lit("abc"), F.lit("xyz")))


@pytest.mark.parametrize(("text", "alias", "hit"), [("Flu, not pre-flu", "flu", True), ("influenza", "flu", False), ("É aguda", "é", True), ("C++ here", "C++", False), ("a.b", "a.b", True), ("axb", "a.b", False), ("x", " ", False), ("a\\E b", "\\E", True), ("", "a", False)])
def test_word_bounded(spark, text, alias, hit):
    assert value(one(spark, t=text, a=alias), T.occurs(F.col("t"), F.col("a"))) is hit


ANSWERS = [
    ('["a", "b"]', True, ["a", "b"]), ('Sure: ["a"] done', True, ["a"]), ("[]", True, []), ('["a", 1, null, {}]', True, ["a"]), ('{"present": ["a"]}', True, ["a"]), ('{"other": 1}', True, []),
    ('{"present": "a"}', False, []), ('["a", "b', False, []), ('["a"] and [b]', False, []), ('["a"], "k": ["b"]', False, []), ("Plain disease", False, []), ("", False, []),
]


@pytest.mark.parametrize(("answer", "ok", "terms"), ANSWERS)
def test_answers(spark, answer, ok, terms):
    got = value(one(spark, a=answer), detect.parse_answer(F.col("a")))
    assert (got.ok, got.terms) == (ok, terms)


def test_term_and_class_matching(spark):
    df = one(spark, terms=["heart", "Flu", "zzz"], cands=["heart attack", "heart", "flu", "FLU "])
    assert value(df, detect.match_terms(F.col("terms"), F.col("cands"))) == ["heart attack", "flu"]
    best = lambda d: tuple(value(df, matching.best_match(F.lit(d), F.col("cands"))))
    assert best("heart") == ("exact", "heart") and best("hear") == ("partial", "heart") and best("qqq") == ("unmatched", None)
    assert value(df, matching.best_match(F.lit(""), F.col("cands"))) is None
    lists = spark.createDataFrame([(1, ["a", "", None, "A ", " b "])], "k int, c array<string>")
    got = [(r.pos, r.verdict, r.clean) for r in matching.validate_candidates(lists, "k", "c").orderBy("pos").collect()]
    assert got == [(0, "valid", "a"), (1, "invalid", None), (2, "invalid", None), (3, "duplicate", None), (4, "valid", "b")]
    stats = matching.match_statistics(matching.match_entities(df.withColumn("k", F.lit(1)), "terms", "cands", ["k"])).first()
    assert (stats.n_exact, stats.n_unmatched, stats.match_rate) == (2, 1, round(2 / 3, 6))
    assert matching.match_statistics(matching.match_entities(df.withColumn("k", F.lit(1)).filter("false"), "terms", "cands", ["k"])).first().match_rate == 0.0


@pytest.mark.parametrize(("names", "pipeline", "alone"), [(["regex"], 1.0, 1.0), (["regex", "q"], 1.0, 1.0), (["l1"], 0.8, 0.8), (["q"], 0.4, 0.4), (["l1", "l2"], 0.8, 1.0), (["l1", "q"], 0.8, 1.0), (["l1", "l2", "l3", "q"], 0.8, 1.0)])
def test_scores(spark, names, pipeline, alone):
    w = spark.createDataFrame([(0, "regex", 1.0), (1, "l1", 1.0), (2, "l2", 1.0), (3, "l3", 1.0), (4, "q", 0.5)], "ord int, strategy string, weight double")
    d = spark.createDataFrame([("d", n, "e") for n in names] * 2 + [("d", None, "e"), (None, "q", "e"), ("d", "unknown", "e")], "doc string, strategy string, entity string")
    r = scoring.scored(d, w).first()
    assert r.confidence == pytest.approx(pipeline) and r.strategies == names
    got = scoring.evidence(d, w).select(scoring.score_standalone(F.col("weight"), F.col("n_strategies"), F.col("has_regex"))).first()[0]
    assert got == pytest.approx(alone)


def test_summaries(spark):
    s = spark.createDataFrame([("d", str(c), c, ["regex"], 1) for c in (0.9, 0.7, 0.5, 0.3)], "doc string, entity string, confidence double, strategies array<string>, n_strategies int")
    r = scoring.confidence_summary(s).first()
    assert tuple(r) == (4, 0.6, 0.3, 0.9, 1, 1, 1, 1)
    assert tuple(scoring.confidence_summary(s.filter("false")).first()) == (0, 0.0, 0.0, 0.0, 0, 0, 0, 0)
    assert [e.texto for e in scoring.accepted_lists(s).first().entities] == ["0.9", "0.7", "0.5"]
    docs = spark.createDataFrame([("d",), ("x",)], "doc string")
    assert tuple(scoring.run_summary(docs, s.filter("false")).first()) == (2, 0, 0.0, 0.0)
    assert [tuple(r) for r in scoring.strategy_counts(scoring.accepted(s)).collect()] == [("regex", 3)]


def brute_hits(pred, ref):
    norm = lambda s: " ".join(s.lower().split())

    def hit(a, b):
        a, b = norm(a), norm(b)
        return a == b or a in b or b in a or len(set(a) & set(b)) / max(1, len(set(a) | set(b))) >= 0.8

    used = []
    for p in pred:
        for i, r in enumerate(ref):
            if i not in used and hit(p, r):
                used.append(i)
                break
    return used


def test_greedy_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["flu", "flu b", "gene", "genes", "tumor", "ab", "ba", "x"]
    cases = [([rnd.choice(words) for _ in range(rnd.randint(0, 6))], [rnd.choice(words) for _ in range(rnd.randint(0, 6))]) for _ in range(60)]
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(cases)], "i int, p array<string>, r array<string>")
    for row in df.select("i", matching.greedy_hits(F.col("p"), F.col("r")).alias("u")).collect():
        assert row.u == brute_hits(*cases[row.i]), cases[row.i]


def preds(spark, rows):
    return spark.createDataFrame([(i, "f", p, [(t, c, s) for t, c, s in es]) for i, (p, es) in enumerate(rows)], "doc bigint, file string, pmid string, entities array<struct<texto:string,confidence:double,strategies:array<string>>>")


def test_evaluation(spark):
    gold = evaluate.latest_gold(spark.createDataFrame([(1, "1", ["old"]), (2, "1", ["flu", "gene"]), (3, "2", []), (4, "", ["x"]), (5, None, ["x"]), (6, "9", ["y"])], "g int, pmid string, t array<string>"), "pmid", "g", "t")
    p = preds(spark, [("1", [("flu", 0.9, ["a"]), ("Flu ", 0.5, ["b"]), ("zzz", None, ["a"])]), ("2", [("q", 1.0, [])]), ("7", [("lost", 1.0, ["a"])]), ("1", [])])
    got = {r.doc: (r.tp, r.fp, r.fn) for r in evaluate.evaluate_documents(p, gold).collect()}
    assert got == {0: (1, 2, 1), 3: (0, 0, 2)}
    m = evaluate.metrics(evaluate.evaluate_documents(p, gold)).first()
    assert (m.tp, m.fp, m.fn, m.precision, m.recall) == (1, 2, 3, round(1 / 3, 9), 0.25)
    none = evaluate.metrics(evaluate.evaluate_documents(p.filter("false"), gold)).first()
    assert (none.n_docs, none.f1_score) == (0, 0.0)
    assert {tuple(r)[:3] for r in evaluate.evaluate_strategies(p, gold).collect()} == {("a", 1, 1), ("b", 1, 0)}
    assert {(r.doc, r.entity) for r in evaluate.false_positives(p, gold).collect()} == {(0, "zzz"), (1, "q"), (2, "lost")}
    assert {tuple(r) for r in evaluate.false_negatives(p, gold).collect()} == {("1", "gene")}


def test_grids(spark):
    assert grid.chunk_grid(spark).count() == 19 and grid.temperature_grid(spark).count() == 55
    f = spark.createDataFrame([("results_llama_n2c2_chunk60_ov20.jsonl",), ("results_temp0.5_conf0.3.jsonl",), ("other.jsonl",), (None,)], "f string")
    got = {(r.model, r.chunk, r.overlap, r.temperature, r.confidence) for r in grid.file_parameters(f, "f").collect()}
    assert got == {("llama", 60, 20, None, None), (None, None, None, 0.5, 0.3)}
    r = spark.createDataFrame([("llama", 20, 10, 1, 0.5, 1.0, 1.0, 0.5), ("llama", 20, 15, 3, 0.5, None, None, None), ("qwen", 40, 10, 5, 0.5, 0.0, 0.0, 0.0)], "model string, chunk int, overlap int, entities int, avg_conf double, precision double, recall double, f1_score double")
    m = {(x.grouping, x.model, x.chunk, x.overlap): (x.n, x.mean_entities, x.mean_f1_score) for x in grid.group_means(r, [["model", "chunk"], ["model", "overlap"]]).collect()}
    assert m[("model+chunk", "llama", 20, None)] == (2, 2.0, 0.5) and m[("model+overlap", "llama", None, 15)] == (1, 3.0, 0.0)
    assert [x.model for x in grid.top_results(r, "f1_score", ["model"]).collect()] == ["llama"]


def test_bio(spark, tmp_path):
    (tmp_path / "d1.bio").write_text("a\tB-test\nb\tI-test\nc\tI-problem\nbad line\nd\tB-problem\ne\tB-problem\nx\ty\tz\nf\tO\ng\tI-other\n\n")
    tokens = bio.read_tokens(spark, str(tmp_path))
    got = [(r.type, r.text) for r in bio.decode(tokens).orderBy("entity_no").collect()]
    assert got == [("test", "a b"), ("problem", "c"), ("problem", "d"), ("problem", "e"), ("other", "g")]
    d = bio.documents(tokens).first()
    assert d.PMID == "d1" and d.Texto == "a b c d e f g" and [e.tipo for e in d.Entidad] == ["Test"] + ["SpecificDisease"] * 3 + ["other"]
    assert bio.documents(tokens.filter("false")).count() == 0


def test_pubtator(spark):
    text = "1|t|Title\n1\t0\t5\tflu\tSpecificDisease\tD1\n1|a| Body \n1\t0\t5\tflu\tSpecificDisease\tD1\n1\t0\t5\tCancer\tDiseaseClass\tD2\n1\t0\t5\tgenetic  defect\tDiseaseClass\tD3\n1\t0\t5\tother\tDiseaseClass\tD3\n1\t0\t5\tm\tModifier\tD3\nstray\n2|t|Next\n\n2|t|Again\n2\t1\t2\tshort\n"
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "file string, pos int, line string")
    got = [(r.PMID, r.Texto, [(e.texto, e.tipo) for e in r.Entidad]) for r in pubtator.parse(lines).orderBy("block").collect()]
    assert got == [("1", "Title Body", [("flu", "SpecificDisease"), ("Cancer", "tumor"), ("genetic  defect", "genetica")]), ("2", "Next", []), ("2", "Again", [])]
    assert len(pubtator.parse(lines, dedup=False).orderBy("block").first().Entidad) == 4


def test_prepare(spark):
    d = spark.createDataFrame([(1, [("ASPIRIN", "x"), ("other", "y"), None, (None, "z")]), (2, []), (3, None)], "i int, e array<struct<texto:string,tipo:string>>")
    kept = prepare.filter_entities(d, "e", prepare.ALLOWED)
    assert {r.i: None if r.e is None else len(r.e) for r in kept.collect()} == {1: 1, 2: 0, 3: None}
    s = prepare.filter_statistics(kept, "e").first()
    assert (s.n_docs, s.n_before, s.n_after, s.kept_percent) == (3, 4, 1, 25.0)
    assert prepare.filter_statistics(kept.filter("i > 1"), "e").first().kept_percent == 0.0
    assert {r.had_entities for r in prepare.with_constant_candidates(d, "e", [("a", "b")]).collect()} == {True, False}


def test_model_detection(spark):
    s = [config.Strategy("one", "m", 4, 1, 1, 100, 0.1, 1.0), config.Strategy("two", "m", 4, 1, 1, 100, 0.7, 1.0)]
    docs = spark.createDataFrame([(1, "flu and gene here", ["Flu", "gene", "flu", None]), (2, "flu and gene here", ["lungs"]), (3, "broken", ["Bad Disease"]), (4, None, ["x"]), (5, "", ["x"])], "i bigint, t string, c array<string>")
    ask = spark.sparkContext.accumulator(0)

    def answer(model, prompt):
        ask.add(1)
        if "broken" in prompt:
            return "Bad Disease, surely"
        return '["FLU"]'

    got = {tuple(r) for r in detect.model_detect(docs, F.col("i"), "t", "c", s, FunctionCompleter(answer)).collect()}
    assert got == {(1, "one", "Flu"), (1, "two", "Flu"), (3, "one", "Bad Disease"), (3, "two", "Bad Disease")}
    assert ask.value == 4  # two prompts shared by two documents and two strategies, one prompt and its second
    assert detect.model_detect(docs, F.col("i"), "t", "c", s, StaticCompleter({})).count() == 0
    exact = {tuple(r) for r in detect.regex_detect(docs, F.col("i"), "t", "c").collect()}
    assert exact == {(1, "regex", "Flu"), (1, "regex", "gene"), (1, "regex", "flu")}


def test_configuration():
    assert all(s.is_valid for s in config.STRATEGIES) and not config.Strategy("x", "m", -1, 0, 1, 2, 0.0, 1.0).is_valid
    assert [s.name for s in config.select(["qwen25_diversity", "nobody"])] == ["qwen25_diversity"] and len(config.select(["all"])) == 4 and config.select(["nobody"]) == []
    assert config.by_name("nobody") is None and len(config.by_model("llama3.2:3b")) == 3
    o = config.overridden(list(config.STRATEGIES), 0, target=200, overlap=50, temperature=0.8)[0]
    assert (o.chunk_target, o.chunk_overlap, o.chunk_min, o.chunk_max, o.temperature) == (200, 50, 100, 400, 0.8) and config.STRATEGIES[0].chunk_target == 100
    assert config.Thresholds().updated(min_accept=0.7, high=1.2) == config.Thresholds(min_accept=0.7)


def test_ranks_and_hot_groups(spark):
    df = spark.range(1000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("g"), "id")
    got = rank_within(df, "g", "id", 1000, part_rows=40).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part["rank"]) == list(range(len(part)))
    counts = df.groupBy("g").agg(F.count("*").alias("n"))
    assert join_groups(df, counts, "g", "n", hot_share=0.1).count() == 1000
    assert join_groups(df.filter("false"), counts.filter("false"), "g", "n").count() == 0
