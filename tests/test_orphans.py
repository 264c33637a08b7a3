from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from directed_extract.functions.ids import canonical_pmid
from directed_extract.operators.orphans import dangling, judge, orphan_report, presence_intervals
from directed_extract.operators.skew import hot_parts, join_lookup

T0 = datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def events(spark, rows):
    return spark.createDataFrame([(k, at(h)) for k, h in rows], "key string, at timestamp_ntz")


def refs(spark, rows):
    return spark.createDataFrame([(i, k, at(h), "x") for i, (k, h) in enumerate(rows)], "id bigint, key string, at timestamp_ntz, p string")


def present(came, gone, key, h):
    past = sorted([(t, 1) for k, t in came if k == key and t is not None and t <= h] + [(t, 0) for k, t in gone if k == key and t is not None and t <= h])
    return bool(past and past[-1][1])


def found(spark, came, gone, asked, **kw):
    there = presence_intervals(events(spark, came), events(spark, gone))
    return {r.id for r in dangling(refs(spark, asked), there, **kw).collect()}


def test_point_in_time(spark):
    came, gone = [("a", 1), ("a", 9), ("b", 5)], [("a", 4), ("a", 4), ("c", 1)]
    asked = [("a", 0), ("a", 1), ("a", 3), ("a", 4), ("a", 8), ("a", 9), ("b", 4), ("b", 5), ("c", 2), ("d", 9), (None, 3), ("b", None), ("d", None)]
    assert found(spark, came, gone, asked) == {0, 3, 4, 6, 8, 9, 12}


def test_same_instant_and_repeated_rows(spark):
    assert found(spark, [("a", 2)], [("a", 2)], [("a", 2), ("a", 3), ("a", 3)]) == set()
    assert found(spark, [("a", 1), ("a", 2)], [("a", 3), ("a", 3)], [("a", 2), ("a", 3), ("a", 3)]) == {1, 2}


@pytest.mark.parametrize("share", [0.001, 1.0])
def test_empty_tables(spark, share):
    assert found(spark, [], [], [("a", 1)], hot_share=share) == {0}
    assert found(spark, [("a", 1)], [], [], hot_share=share) == set()


def test_one_key_and_one_instant_hold_a_third(spark):
    asked = [("hot", 7)] * 100 + [("hot", h) for h in range(100)] + [(f"k{i}", i) for i in range(100)]
    came, gone = [("hot", 50)] + [(f"k{i}", 0) for i in range(0, 100, 2)], [("hot", 90)]
    want = {i for i, (k, h) in enumerate(asked) if not present(came, gone, k, h)}
    for share in (0.001, 0.1, 1.0):
        assert found(spark, came, gone, asked, hot_share=share) == want


def test_hot_parts(spark):
    counts = spark.createDataFrame([("a", 500), ("b", 300)] + [(f"c{i}", 1) for i in range(200)], "k string, n bigint")
    assert {(r.k, r.parts) for r in hot_parts(counts, "k", "n", 0.05).collect()} == {("a", 10), ("b", 6)}


def test_lookup_join(spark, rows):
    left = spark.createDataFrame([(i, "hot") for i in range(50)] + [(50, "a"), (51, "lost"), (52, None)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3)], "k string, v int")
    for share in (0.1, 1.0):
        assert rows(join_lookup(left, right, "k", "left", share).select("i", "v")) == sorted([(i, 1) for i in range(50)] + [(50, 2), (51, None), (52, None)], key=repr)
        assert join_lookup(left, right, "k", "inner", share).count() == 51


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_against_brute_force(spark, data):
    pair = st.tuples(st.sampled_from("abc"), st.integers(0, 60))
    came, gone, asked = (data.draw(st.lists(pair, max_size=25)) for _ in range(3))
    want = {i for i, (k, h) in enumerate(asked) if not present(came, gone, k, h)}
    assert found(spark, came, gone, asked) == want


def test_report_and_hot_key(spark):
    came = [("hot", 0)]
    asked = [("hot", h % 50) for h in range(300)] + [("lost", 1), ("lost", 800), ("gone", 1)]
    r = refs(spark, asked).withColumn("table_name", F.lit("t"))
    there = presence_intervals(events(spark, came), events(spark, [("hot", 40)]))
    orphans = dangling(r, there)
    assert orphans.columns == r.columns
    got = {(x.period.month, x.n_refs, x.n_dangling, x.n_keys, x.n_never_came) for x in orphan_report(judge(r, there), there).collect()}
    late = sum(h % 50 >= 40 for h in range(300))
    assert got == {(1, 302, late + 2, 3, 2), (2, 1, 1, 1, 1)}


def test_identifiers(spark):
    raw = ["123", " 00123\t", "PMID: 123", "pmid 123", "PMID123", "123.0", "1.23E2", "doc_7", " doc_7 ", "doc_07", "", "  ", "None", None, "0", "000", "12a", " 123"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(canonical_pmid(F.col("x"))).collect()]
    assert got == ["123"] * 7 + ["doc_7", "doc_7", "doc_07", None, None, None, None, "0", "0", "12a", "123"]
