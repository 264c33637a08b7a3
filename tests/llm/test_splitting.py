import random

import pytest

from directed_extract.llm.splitting import split_oversized, split_text


def check(text, limit, overlap):
    spans = split_text(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    real = max(0, min(overlap, limit - 1))
    for i, (s, e) in enumerate(spans):
        assert e - s <= limit and (len(text) <= limit or e > s)
        if i:
            assert s == spans[i - 1][1] - real and e > spans[i - 1][1]
    rebuilt = text[: spans[0][1]] + "".join(text[a[1] : b[1]] for a, b in zip(spans, spans[1:], strict=False))
    assert rebuilt == text
    return spans


@pytest.mark.parametrize("seed", range(6))
def test_round_trip(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "Dr. X. ", "End. Next ", "\n", "\n\n", "Title:\n", "x" * 40, "é", "  ", "\U0001f600"]) for _ in range(r.randint(0, 400)))
    for limit, overlap in ((50, 10), (80, 0), (7, 3), (1, 0), (30, 30), (30, 99), (10_000, 5)):
        check(text, limit, overlap)


def test_natural_boundaries():
    text = "Alpha beta gamma. Delta e.g. epsilon zeta. Eta theta iota.\n\nKappa lambda mu. Nu xi omicron."
    ends = [text[:e].rstrip()[-1] for _, e in check(text, 40, 5)[:-1]]
    assert set(ends) == {"."} and not any(text[:e].endswith("e.g. ") for _, e in check(text, 40, 5))
    assert check("one two three four", 9, 0)[0] == (0, 8)
    assert len(check("x" * 100, 30, 10)) == 5
    head = "A" * 30 + ".\n\nResults:\nThe text goes on here."
    assert not any(head[:e].rstrip().endswith("Results:") for _, e in check(head, 45, 0)[:-1])


def test_very_long_text_is_fast():
    check("Some sentence here. " * 20_000, 1000, 100)
    check("z" * 300_000, 900, 80)


def test_table(spark):
    limits = spark.createDataFrame([("a", 10, 2), ("default", 5, 1)], "origin string, max_chars int, overlap_chars int")
    docs = spark.createDataFrame([(1, "x" * 25, "a", "n"), (2, "short", "b", "n"), (3, "longer", None, "n"), (4, None, "a", "n"), (5, "", "a", "n"), (6, "x" * 10, "a", "n")], "line_id bigint, texto string, origin string, m string")
    got = split_oversized(docs, "line_id", "texto", limits, "origin").toPandas()
    assert got.groupby("line_id").size().to_dict() == {1: 3, 2: 1, 3: 2, 5: 1, 6: 1}
    assert set(got[got.piece_no == 1].line_id) == {1, 3}
    for i, t in ((1, "x" * 25), (3, "longer")):
        for p in got[got.line_id == i].itertuples():
            assert p.piece == t[p.start_pos : p.end_pos]
    assert split_oversized(docs.filter("false"), "line_id", "texto", limits, "origin").count() == 0
    assert split_oversized(docs, "line_id", "texto", limits.filter("false"), "origin").filter("n_pieces > 1").count() == 0
