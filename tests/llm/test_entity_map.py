import itertools
import random

import pytest
from pyspark.sql import functions as F

from directed_extract.llm import entity_map as E

CATALOG = [
    ("C1", "síndrome de Thozaquegun tipo 1", ["Thozaquegun syndrome type 1", "TZG-1"]), ("C2", "síndrome de Thozaquegun tipo 2", ["Thozaquegun syndrome type 2", "TZG-2"]),
    ("C3", "katifladrur deficiency", ["déficit de katifladrur", "KTF"]), ("C4", "QXKY22", []), ("C5", "Proziavavar assay", ["prueba de Proziavavar"]), ("C6", "chronic tathelacondosis", None),
] + [(f"X{i}", f"síndrome de Root{'abcdefghijklmnop'[i] * 3}ulon", [f"Root{'abcdefghijklmnop'[i] * 3}ulon syndrome"]) for i in range(12)]
CASES = [
    ("Thozaquegun syndrome type 1", "C1"), ("THOZAQUEGUN SYNDROME TYPE II", "C2"), ("sospecha de sindrome_de_Tohzaquegn tipo 2 (2019)", "C2"), ("thozaquegun synd. t. 2", None), ("Thozaquegun syndrome type 4", None),
    ("Thozaquegun syndrome", None), ("syndrome type 1", None), ("t.z.g.-1", "C1"), ("tzg 3", None), ("k.t.f.", "C3"), ("KTG", None), ("Katifladrur-deficiency, mild", "C3"), ("katiflxdrru deficiency", "C3"),
    ("katifladrur", None), ("katifladrur assay", None), ("gene Qxky-22", "C4"), ("QXKY 23", None), ("QXKZ22", None), ("new proz1avavar assay", "C5"), ("h/o proziavavar  ASSAY [dx]", "C5"), ("assay, Proziavavar", "C5"),
    ("chronic tathelac0ndosis", "C6"), ("crónica tathelacondosis", None), ("", None), ("  ", None), ("?", None), ("none", None), ("w" * 50_000, None),
]


def catalog(spark):
    return spark.createDataFrame([(c, t, "x", a) for c, t, a in CATALOG], "concept_id string, texto string, value string, aliases array<string>")


def test_mapping(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(900, None), (901, CASES[0][0]), (902, CASES[0][0])]
    df = spark.createDataFrame([(i, t, "clash", 7, "v", "x") for i, t in rows], "id bigint, texto string, concept string, n int, value string, concept_id string")
    got = {r.id: r.concept for r in E.map_elements(df, "texto", catalog(spark), "concept_id", "texto", "aliases").collect()}
    want = {i: c for i, (_, c) in enumerate(CASES) if c} | {901: "C1", 902: "C1"}
    # two names make "type" no common word here, so its abbreviation is not resolved
    assert got == want


def test_abbreviated_common_words(spark):
    more = spark.createDataFrame([(f"T{i}", f"Zor{c}{c}uvela syndrome type {n}", "x", []) for i, (c, n) in enumerate(itertools.product("abcdefg", (1, 2)))], "concept_id string, texto string, value string, aliases array<string>")
    df = spark.createDataFrame([(1, "zorccuvela synd. t. 2"), (2, "zorccuvela sd. tipe 2")], "id bigint, texto string")
    got = {r.id: r.concept for r in E.map_elements(df, "texto", more, "concept_id", "texto", "aliases").collect()}
    assert got[1] == "T5"


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "KTF")], "id bigint, texto string")
    assert E.map_elements(df.filter("false"), "texto", catalog(spark), "concept_id", "texto", "aliases").count() == 0
    assert E.map_elements(df, "texto", catalog(spark).filter("false"), "concept_id", "texto", "aliases").count() == 0


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "abc", 0), ("abc", "acb", 1), ("abcd", "badc", 2), ("abc", "xyz", 3), ("", "ab", 2)])
def test_distance(a, b, d):
    assert E.distance(a, b, 2) == min(d, 3)


def test_near_words_against_all_pairs(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(3, 11))) for _ in range(160)})
    seen = sorted({w[:i] + w[i + 1 :] + r.choice(["", "a", "bd"]) for w in words for i in (1, 3)} | {w[1] + w[0] + w[2:-2] + w[-1] + w[-2] for w in words} | {"", "ab"})
    got = {(x.token, x.word): x.d for x in E.near_words(spark.createDataFrame([(w,) for w in seen], "token string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    most = lambda a, b: E.edits_allowed(max(a, b, key=len))
    want = {(a, b): d for a in seen for b in words if len(a) > 3 and most(a, b) and (d := E.distance(a, b, 2)) <= most(a, b)}
    assert got == want and len(want) > 300


def test_a_word_of_a_third_of_all_values(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("Thozaquegun syndrome type 1 x"), F.col("id") + 5000)).otherwise(F.concat(F.lit("v"), "id")).alias("texto"))
    assert E.map_elements(df, "texto", catalog(spark), "concept_id", "texto", "aliases").filter("concept = 'C1'").count() == 300


def test_tokens():
    assert E.tokens("Síndrome de X tipo III (2019)") == ["sindrome", "de", "x", "tipo", "3", "2019"]
    assert E.tokens("WHXZ_08, g0nad0tr0pin") == ["whxz", "8", "gonadotropin"]
    assert E.tokens("P.T.X. ＡＢ") == ["ptx", "ab"]
    assert F is not None
