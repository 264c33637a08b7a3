import json

from pyspark.sql import functions as F

from directed_extract.llm.ledger import Ledger, canonical_key, later_copies

KINDS = [
    ['{"PMID": "12", "texto": "Early-Onset"}', '{ "Texto" : "early onset." , "pmid" : 12 }', '{"texto":"EARLY\\u2013ONSET","PMID":"12 "}'],
    ['{"PMID": "12", "texto": "crónica"}', '{"PMID": "12", "texto": "crónica"}', '{"PMID": "12", "texto": "cr\\u00f3nica"}', '{"PMID": "12", "texto": "cro\\u0301nica"}'],
    ['{"PMID": "12", "texto": "cronica"}'], ['{"PMID": "12", "texto": "crónica", "x": ""}'], ['{"PMID": "12", "texto": null}'], ['{"PMID": "12", "texto": "null"}'], ['{"PMID": "12"}'],
    ["not json", "not json"], ["Not json"], ["{'a': 1}"], ['{"a": 1} x'], ["[1]"], [""],
    ['{"a": {"b": 1, "C": [2, "x."]}}', '{"A": {"c": [2, "X"], "b": "1"}}'], ['{"a": {"b": 1, "C": ["x", 2]}}'], ["{}"], ['{"a": 1e2, "b": -1.50}', '{"a": "1e2", "b": "1.50"}', '{"b": "1 50", "A": "1E2"}'], ['{"a": 1.50, "b": [1E2, true]}', '{"a": "1.50", "b": ["1e2", "True"]}'],
    ['{"a": [["b", "1"]]}'], ['{"a": {"b": 1}}'], ['{"a": 100}'], ['{"texto": "Nota, [grave] caso"}', '{"texto":"nota grave caso"}'], [json.dumps({"a": "z" * 100_000}), json.dumps({"A": "Z-" * 100_000})],
]


def keyed(spark, rows):
    df = spark.createDataFrame([(i, r, "k") for i, r in rows], "id bigint, raw string, bucket string")
    return df.select(canonical_key(F.col("raw")).alias("key"), "id")


def test_kinds(spark):
    rows = [(100 * k + i, r) for k, kind in enumerate(KINDS) for i, r in enumerate(kind)]
    got = {r.id: r.key for r in keyed(spark, rows).collect()}
    by_key = {}
    for i, _ in rows:
        by_key.setdefault(bytes(got[i]), []).append(i)
    assert sorted(by_key.values()) == [[100 * k + i for i in range(len(kind))] for k, kind in enumerate(KINDS)]
    assert keyed(spark, [(1, None)]).first().key is None


def test_brackets_in_text_are_not_nesting(spark):
    plain = '{"PMID": "12", "texto": "early onset"}'
    dressed = [f'{{"PMID": "12", "texto": "{t}"}}' for t in ("[[early_onset]]", "early, [onset]", "early: {onset}", "early [{onset", "{early}:[onset]")]
    assert len({bytes(r.key) for r in keyed(spark, list(enumerate([plain, *dressed]))).collect()}) == 1
    nested = ['{"PMID": "12", "texto": ["[[early_onset"]}', '{"texto": ["early onset"], "pmid": 12}']
    assert len({bytes(r.key) for r in keyed(spark, list(enumerate([plain, *nested]))).collect()}) == 2


def test_incremental_ledger(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "book"), buckets=4)
    assert book.read().count() == 0
    book.add(keyed(spark, [(5, '{"a": "x"}'), (6, '{"a": "y"}'), (7, '{"a": "x!"}')]))
    book.add(keyed(spark, []).filter("false"))
    book.add(keyed(spark, [(2, '{"A": "X"}'), (9, '{"a": "z"}')]))
    assert sorted((r.n, r.first_id) for r in book.read().collect()) == [(1, 6), (1, 9), (3, 2)]
    everything = keyed(spark, [(5, '{"a": "x"}'), (6, '{"a": "y"}'), (7, '{"a": "x!"}'), (2, '{"A": "X"}'), (9, '{"a": "z"}')])
    assert sorted(tuple(r) for r in later_copies(everything, book.read()).collect()) == [(2, 5), (2, 7)]


def test_half_written_batch_does_not_count(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "book"), buckets=2)
    book.add(keyed(spark, [(1, "{}")]))
    (tmp_path / "book" / "generation=2").mkdir()
    (tmp_path / "book" / "manifest=2").mkdir()
    assert [(r.n, r.first_id) for r in book.read().collect()] == [(1, 1)]
    book.add(keyed(spark, [(2, "{}")]))
    assert [(r.n, r.first_id) for r in book.read().collect()] == [(2, 1)]


def test_buckets_double_as_keys_grow(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "book"), buckets=2, bucket_keys=10)
    for batch in range(3):
        book.add(keyed(spark, [(100 * batch + i, f'{{"a": "{v}"}}') for i, v in enumerate([*range(40 * batch, 40 * batch + 40), "same"])]))
    assert book._manifest()[1] == 16 and len(book._manifest()[2]) == 16
    got = {r.n: k for r in book.read().groupBy("n").count().collect() for k in [r["count"]]}
    assert got == {1: 120, 3: 1} and book.read().filter("n = 3").first().first_id == 40


def test_hot_kind(spark, tmp_path):
    rows = spark.range(3000).select(canonical_key(F.when(F.col("id") % 3 == 0, F.lit('{"a": 1}')).otherwise(F.concat(F.lit('{"a": "v'), "id", F.lit('"}')))).alias("key"), "id")
    book = Ledger(spark, str(tmp_path / "book"))
    book.add(rows)
    assert later_copies(rows, book.read()).agg(F.count("*"), F.min("keep_id"), F.max("keep_id")).first() == (999, 0, 0)
