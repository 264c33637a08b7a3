import pytest
from pyspark.sql import functions as F

from directed_extract.llm.canonical import _Glyphs, canonical, canonical_form, classes, confusables, looking_alike


@pytest.mark.parametrize(
    ("a", "b"),
    [("ＡＢ１", "AB1"), ("é", "é"), ("ό", "ó"), ("а​b", "ab"), ("ofﬁce", "office"), ("a b c d", "a b c d"), ("so­ft", "soft"), ("x️", "x"), ("Å", "Å"), ("a\r\nb", "a\nb"), ("a  \nb ", "a\nb"), ("ⅰⅽ", "ic"), ("5 ℃", "5 °C"), ("n‍̃", "ñ"), ("µ", "μ")],
)
def test_same_look(a, b):
    assert canonical_form(a) == canonical_form(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("1", "2"), ("ab", "ba"), ("a\nb", "a b"), ("x²", "x2"), ("½", "1/2"), ("α", "a"), ("a  b", "a b")])
def test_different_look(a, b):
    assert canonical_form(a) != canonical_form(b)


def test_folding_and_idempotence():
    for t in ("Straße ＡＢＣ Ό", "", " ", "​", "İ", "x" * 200_000):
        assert canonical_form(canonical_form(t)) == canonical_form(t)
        assert canonical_form(canonical_form(t, True), True) == canonical_form(t, True)
    assert canonical_form("STRASSE", True) == canonical_form("straße", True)


def test_pairs(spark, rows):
    data = [(1, "abc"), (2, "abc"), (3, "аbc"), (4, "a​bc"), (5, "ABC"), (6, None), (7, ""), (8, "﻿"), (9, "q" * 100_000), (10, "q" * 99_999 + "ｑ"), (11, None)]
    df = spark.createDataFrame([(i, t, "x", t) for i, t in data], "doc_id bigint, text string, id string, f string")
    want = [(a, b) for a, s in data for b, t in data if a < b and s is not None and t is not None and s != t and canonical_form(s) == canonical_form(t)]
    assert rows(looking_alike(df, "doc_id", "text")) == sorted(want, key=repr)
    assert rows(looking_alike(df, "doc_id", "text", hot_share=0.1)) == sorted(want, key=repr)
    got = {r.doc_id: (r.class_id, r.n_texts, r.n_rows) for r in classes(df, "doc_id", "text").collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4), (1, 3, 4)), 5: (5, 1, 1), **dict.fromkeys((7, 8), (7, 2, 2)), **dict.fromkeys((9, 10), (9, 2, 2))}
    assert looking_alike(df.filter("false"), "doc_id", "text").count() == 0
    assert looking_alike(spark.range(3000).select("id", F.lit("same").alias("text")), "id", "text").count() == 0
    assert [r[0] for r in df.filter("doc_id in (4, 6)").orderBy("doc_id").select(canonical(spark, F.col("text"))).collect()] == ["abc", None]


def test_confusables_of_other_scripts(spark):
    anywhere, beside = confusables(spark._jvm)
    glyphs = _Glyphs(anywhere, beside)
    form = lambda t: canonical_form(t, False, glyphs)
    assert [form(c) for c in ("ѵ", "Ꭺ", "ⲟ")] == ["v", "A", "o"]
    assert [form(t) for t in ("carcinοma", "vαriant", "ⲟf νon", "ꓮB")] == ["carcinoma", "variant", "of von", "AB"]
    assert [form(t) for t in ("TNF-α", "α", "β2", "ı", "это", "שלום")] == ["TNF-α", "α", "β2", "ı", "этo", "שלום"]


def test_a_third_of_all_rows_in_one_class(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), "id")).when(F.col("id") % 100 == 0, "h\u200bot").otherwise("hot").alias("text"))
    assert looking_alike(df, "id", "text").count() == 990 * 10
    assert {(r.n_texts, r.n_rows) for r in classes(df, "id", "text").filter("n_rows > 1").collect()} == {(2, 1000)}
