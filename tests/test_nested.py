import json

from pyspark.sql import functions as F

from directed_extract.operators import nested
from directed_extract.plans import corpus


def frame(spark, lines):
    return spark.createDataFrame([(i, x, "noise") for i, x in enumerate(lines)], "id bigint, raw string, v string")


def tables(spark, lines, **kw):
    df = frame(spark, lines)
    return nested.flatten(df, "raw", "id", nested.infer_structure(df, "raw", **kw))


def test_parents_places_and_single_values(spark):
    lines = [
        json.dumps({"a": [{"n": 1, "b": ["x", None, "y"]}, None, {"n": 2, "b": "z"}], "m": {"k/1": [1, 2], "k2": 3}, "o": {"deep": {"s": "t"}}}),
        json.dumps({"a": json.dumps([{"n": 3.5, "b": json.dumps(["w"])}]), "m": None}),
        json.dumps({"a": {"n": 4}}),
    ]
    t = tables(spark, lines, maps=["m"])
    b = [(r.id, r.parent_key, r.row_key, r.pos, r.kind, r.value, r.parent.n) for r in t["a[].b[]"].orderBy("id", "row_key").collect()]
    assert b == [(0, "0", "0/0", 0, "string", "x", 1.0), (0, "0", "0/1", 1, "null", None, 1.0), (0, "0", "0/2", 2, "string", "y", 1.0), (0, "2", "2/0", 0, "string", "z", 2.0), (1, "0", "0/0", 0, "string", "w", 3.5)]
    a = [(r.id, r.label, r.kind, r.f.n) for r in t["a[]"].orderBy("id", "pos").collect()]
    assert a == [(0, "0", "object", 1.0), (0, "1", "null", None), (0, "2", "object", 2.0), (1, "0", "object", 3.5), (2, "0", "object", 4.0)]
    m = [(r.parent_key, r.parent_label, r.pos, r.value) for r in t["m{}[]"].orderBy("parent_key", "pos").collect()]
    assert m == [("k2", "k2", 0, 3), ("k~11", "k/1", 0, 1), ("k~11", "k/1", 1, 2)]
    assert t["$"].select("f.*").columns == ["o.deep.s"]


def test_what_is_no_object_gives_nothing(spark):
    lines = [None, "", "   ", "[1]", "null", "{'a': 1}", '{"a": 1', '{"a": 1} x', '{"a": [1]}{"a": [2]}', '{"a": NaN}', "x" * 100_000, ' {"a": [7]}\n']
    t = tables(spark, lines, lists=["a"])
    assert [(r.id, r.value) for r in t["a[]"].collect()] == [(11, 7)]


def test_empty_table_has_declared_tables(spark):
    t = tables(spark, [], lists=["a", "a[].b"], maps=["m"])
    assert {"a[]", "a[].b[]", "m{}"} <= set(t) and all(d.count() == 0 for d in t.values())


def test_many_field_names_become_a_map(spark):
    t = tables(spark, [json.dumps({"m": {f"k{i}": [i]}}) for i in range(80)], max_fields=20)
    assert t["m{}[]"].count() == 80


def test_deep_and_wide_record(spark):
    wide = json.dumps({"a": [{"b": list(range(50))} for _ in range(200)]})
    assert tables(spark, [wide, wide])["a[].b[]"].count() == 20_000


def test_twenty_levels(spark):
    raw = "[7]"
    for i in range(20):
        raw = '{"k%d": %s}' % (i, raw)
    t = tables(spark, [raw, '{"a": ' + "[" * 3000 + "]" * 3000 + "}"])
    name = ".".join(f"k{i}" for i in reversed(range(20))) + "[]"
    assert [r.value for r in t[name].collect()] == [7]


def test_more_fields_than_the_bound_keep_declared_places(spark):
    wide = {f"x{i}": i for i in range(65)} | {"more": [7, 8]}
    lines = [
        json.dumps({"e": [{"t": "a", "s": ["p", "q"]} | wide], "o": {"s": "z"} | wide} | wide),
        json.dumps({"e": json.dumps([{"t": "b", "s": "r"}]), "more": [9], "o": {"s": ["y"]}}),
    ]
    t = tables(spark, lines, lists=["e", "e[].s", "o.s"], fields=["e[].t"])
    assert [(r.id, r.parent.t, r.value) for r in t["e[].s[]"].orderBy("id", "pos").collect()] == [(0, "a", "p"), (0, "a", "q"), (1, "b", "r")]
    assert [r.value for r in t["o.s[]"].orderBy("id").collect()] == ["z", "y"]
    for name, extra in (("{}", 1), ("e[]{}", 0), ("o{}", 0)):
        got = [(r.id, r.label) for r in t[name].collect()]
        assert sorted(got) == sorted([(0, k) for k in wide] + [(1, "more")] * extra), name
    assert [(r.id, r.parent_label, r.value) for r in t["{}[]"].filter("parent_label = 'more'").orderBy("id", "pos").collect()] == [(0, "more", 7), (0, "more", 8), (1, "more", 9)]


def test_record_of_many_fields_without_declarations(spark):
    t = tables(spark, [json.dumps({f"x{i}": i for i in range(65)} | {"x0": {"n": 5}}), '{"x1": 7}'])
    assert t["{}"].filter("kind <> 'object'").count() == 65 and [(r.label, r.f.n) for r in t["{}"].filter("kind = 'object'").collect()] == [("x0", 5)]


def test_p3_with_many_top_level_fields(spark, tmp_path):
    line = {"PMID": "1", "Entidad": [{"texto": "a", "strategies": ["s"]} | {f"y{i}": i for i in range(65)}], "_multi_strategy": {"all_detections": {"a": [{"name": "d"}]}}}
    lines = [json.dumps(line | {f"x{i}": i for i in range(65)})]
    frame(spark, lines).selectExpr("id AS pred_id", "raw AS raw_line").write.parquet(str(tmp_path / "prediction_lines.parquet"))
    assert sorted((r.branch, r.leaf) for r in corpus.p3_found(spark, str(tmp_path)).collect()) == [("all_detections", "d"), ("entidad", "s")]


def test_the_same_tables_in_any_partitioning(spark, rows):
    lines = [json.dumps({"m": {f"k{i}_{j}": j for j in range(70)}}) for i in range(3)] + ['{"m":{"k1":{"deep":[1,2]}}}', '{"m":{"a":1,"a":{"deep":[3]}}}']
    df = spark.createDataFrame(list(enumerate(lines)), "i bigint, raw string")
    got = []
    for n in (1, 2, 8):
        parts = df.repartitionByRange(n, "i")
        t = nested.flatten(parts, "raw", "i", nested.infer_structure(parts, "raw"))
        got.append({name: rows(t[name].select("i", "row_key", "pos", F.to_json(F.struct("value")).alias("v"))) for name in t})
    assert got[0] == got[1] == got[2] and {"$", "m{}", "m{}.deep[]"} == set(got[0])
    assert [r[0] for r in got[0]["m{}.deep[]"]] == [3, 3, 4]
