import random

import pytest
from pyspark.sql import functions as F

from directed_extract.llm import mixing, packing, queries, sizes


def sized(spark, items):
    return spark.createDataFrame([(i, n, "x") for i, n in enumerate(items)], "doc_id bigint, tokens bigint, part string")


def packed(spark, items, capacity):
    got = packing.pack(sized(spark, items), "doc_id", "tokens", capacity).toPandas()
    for i, n in enumerate(items):
        parts = got[got.doc_id == i].sort_values("part")
        assert parts.tokens.sum() == (n or 0) and (len(parts) == 1 or n > capacity)
        at = 0
        for p in parts.itertuples():
            assert p.from_pos == at
            at += p.tokens
    fill = got[got.tokens > 0].groupby("container").tokens.sum()
    assert fill.empty or fill.max() <= capacity
    return fill


@pytest.mark.parametrize("items", [[], [0], [None, 0, 5], [100], [101], [250, 100, 200], [51] * 7, [50] * 9, [34] * 10, [1] * 1000, [26, 25, 24] * 40])
def test_small_cases(spark, items):
    packed(spark, items, 100)


def test_little_space_left(spark):
    r = random.Random(2)
    items = [min(400, int(r.lognormvariate(3.2, 1.1))) for _ in range(3000)]
    fill = packed(spark, items, 100)
    assert fill.sum() / len(fill) / 100 > 0.97
    large = [r.randint(26, 100) for _ in range(2000)]
    fill = packed(spark, large, 100)
    halves = sum(1 for n in large if n > 50)
    assert len(fill) <= 1.06 * max(halves, sum(large) / 100)
    report = packing.fill_report(packing.pack_all(sized(spark, items), "doc_id", "tokens", {4: 100}), {4: 100}).first()
    assert report.fullest <= 100 and report.n_containers >= report.least_containers


def test_best_fit_matches_counts():
    placed, new = packing.best_fit({3: 10, 2: 5}, {7: 2, 3: 1}, 10)
    assert sum(1 for p in placed if p[0] == 3) and new >= 1


def mix(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    blend, report = mixing.mix(d, "doc_id", "source", "tokens", t, **kw)
    return blend.toPandas(), {r.source: r for r in report.collect()}


def test_shares_and_repeats(spark):
    r = random.Random(4)
    docs = [(i, r.choice(["Big ", "big", "BIG", "mid source", "small"] if i % 10 else ["mid-source"]), r.randint(1, 200)) for i in range(4000)] + [(9000, None, 5), (9001, "other", 5), (9002, "big", 0), (9003, "big", None)]
    docs = [d for d in docs if d[1] != "small" or d[0] % 9 == 0]
    blend, report = mix(spark, docs, [("big", 0.5, 1), ("mid_source", 0.3, 2), ("small", 0.15, 4), ("none", 0.05, 3)], block_rows=50)
    assert report["none"].actual_share == 0 and report["none"].tokens_used == 0
    for s, share in (("big", 0.5), ("mid_source", 0.3), ("small", 0.15)):
        assert report[s].actual_share == pytest.approx(share / 0.95, abs=0.004)
    uses = blend.groupby(["source", "doc_id"]).size().groupby("source").max()
    assert uses["big"] <= 1 and uses["mid_source"] <= 2 and uses["small"] <= 4
    assert not blend.duplicated(["doc_id", "pass"]).any() and not set(blend.doc_id) & {9000, 9001, 9002, 9003}


def test_given_total(spark):
    docs = [(i, "a" if i % 4 else "b", 10) for i in range(400)]
    _, report = mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)], total=3000.0)
    assert report["a"].actual_share > 0.5 and report["b"].max_uses == 1
    blend, report = mix(spark, [], [("a", 1.0, 1)])
    assert len(blend) == 0 and report["a"].actual_share == 0


def test_temperature():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1, "d": 0.0}
    assert mixing.tempered(shares, 1.0) == pytest.approx(shares) and mixing.tempered(shares, 0.0)["a"] == pytest.approx(1 / 3)
    for target in (0.3, 0.8, 1.0):
        e = mixing.exponent_for_entropy(shares, target)
        assert mixing.entropy(mixing.tempered(shares, e)) == pytest.approx(target, abs=1e-6)
    assert mixing.exponent_for_entropy(shares, 9.0) == 0.0 and mixing.tempered({}, 1.0) == {}


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "ñandú " * 20_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in sizes.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1 and got[5] > 20_000
    assert sizes.token_counts(df.filter(F.lit(False)), "doc_id", "text").count() == 0


def test_many_specs_in_one_pass(spark, tmp_path):
    spark.range(1001).selectExpr("cast(id AS int) AS spec_id", "cast(8 + id % 5 AS int) AS capacity_tokens").write.parquet(str(tmp_path / "pack_specs.parquet"))
    spark.createDataFrame([(1, "a b c"), (2, "d e " * 20), (3, None), (4, "f")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.p7_packed(spark, str(tmp_path)).toPandas()
    assert got.spec_id.nunique() == 1001 and (got.groupby("spec_id").doc_id.nunique() == 4).all()
    fill = got.groupby(["spec_id", "container"]).tokens.sum().reset_index()
    assert (fill.tokens <= 8 + fill.spec_id % 5).all()


def test_capacities_do_not_mix(spark):
    items = [5, 60, 30, 30, 90, 7, 7, 250, 0]
    both = packing.pack_all(sized(spark, items), "doc_id", "tokens", {1: 100, 7: 64}).toPandas()
    for spec, capacity in ((1, 100), (7, 64)):
        mine = both[both.spec == spec]
        assert mine.tokens.sum() == sum(items) and mine.groupby("container").tokens.sum().max() <= capacity
        alone = packing.pack(sized(spark, items), "doc_id", "tokens", capacity).toPandas()
        assert sorted(alone.groupby("container").tokens.sum()) == sorted(mine.groupby("container").tokens.sum())


def test_exponent_is_bisected():
    tokens, aim = {"a": 7000, "b": 2000, "c": 1000}, {"a": 0.2, "b": 0.5, "c": 0.3}
    plan = mixing.plan_mix(tokens, aim, {"a": 1, "b": 2, "c": 9})
    assert 0.999 < plan.exponent < 1 and plan.weights == pytest.approx(aim, abs=1e-4)
    assert mixing.relative_entropy(aim, plan.weights) <= mixing.CLOSE < mixing.relative_entropy(aim, mixing.plan_mix(tokens, aim, {}, close=1e-3).weights)
    tight = mixing.plan_mix(tokens, aim, {"a": 1, "b": 1, "c": 1}, total=8000.0)
    assert 0 < tight.exponent < 1 and all(tight.budgets[s] <= tokens[s] for s in tokens) and max(tight.budgets[s] / tokens[s] for s in tokens) > 0.999
    assert mixing.plan_mix({"a": 5, "b": 5}, {"a": 0.5, "b": 0.5}, {}).exponent == 0.0


def test_blocks_of_one_source_in_parts(spark):
    df = spark.range(5000).selectExpr("'s' AS source", "cast(id AS int) AS block", "1 AS passes", "cast(1 + id % 7 AS bigint) AS t")
    for most in (100, 5000):
        got = mixing.shuffled(df, "source", "t", 5000, 3, part_blocks=most).toPandas().sort_values("before")
        assert (got.before.to_numpy()[1:] == got.t.cumsum().to_numpy()[:-1]).all() and got.before.iloc[0] == 0
        assert list(got.block[:50]) != sorted(got.block[:50])
