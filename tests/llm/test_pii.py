import functools

import numpy as np
import pytest

from directed_extract.llm import pii
from directed_extract.llm.pii_labels import candidates

KNOWN = {"brindotu": "given", "vjequel": "given", "orvleux": "family", "ektrask": "family", "kethorpe": "family"}
TEXTS = [
    ("Seen by Dr. Brindotu R. Orvleux on the ward.", [("name", "Brindotu R. Orvleux")]),
    ("Tras hablar con Sra. ORVLEUX, BRINDOTU y Don Vjequel de la Kethorpe se mantuvo la pauta.", [("name", "ORVLEUX, BRINDOTU"), ("name", "Vjequel de la Kethorpe")]),
    ("The Ektrask sign was positive, and Orvleux's disease had been excluded. La enfermedad de Kethorpe.", []),
    ("Contact: v.orvleux+lab@norte.labs.example or (555) 555-0104.", [("email", "v.orvleux+lab@norte.labs.example"), ("phone", "(555) 555-0104")]),
    ("Informe enviado a vjequel (at) norte [dot] example. p@0.03 was used. Handle @cohort_6.", [("email", "vjequel (at) norte [dot] example")]),
    ("Se avisó a la familia (+34 055-401-007). Véase PMID 00005025. Batch 20237134-90 was discarded.", [("phone", "+34 055-401-007")]),
    ("Copy of passport XK 0034255 on file. Identified by NIE X-0083832M at intake. SSN 944-00-2410, seen on 2021-05-03.", [("identity", "XK 0034255"), ("identity", "X-0083832M"), ("identity", "944-00-2410")]),
    ("Lives at 227, avenue de Grünfurth, Pinhallow. Reside en Calle Miravega nº 37, 3º B, Larkmoor con su familia; tel 01 99 00 98 49.", [("address", "227, avenue de Grünfurth, Pinhallow"), ("address", "Calle Miravega nº 37, 3º B, Larkmoor"), ("phone", "01 99 00 98 49")]),
    ("Referred by Mrs. Kethorpe, P.O. Box 20, Corvigny. Reads mapped: 1 143 407 of 2 243 143.", [("name", "Kethorpe"), ("address", "P.O. Box 20, Corvigny")]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t) for i, (t, _) in enumerate(TEXTS * 20)] + [(990, None), (991, ""), (992, "x " * 100_000 + TEXTS[0][0])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "line_id bigint, texto string, kind string")
    return df, pii.find_spans(df, "line_id", "texto", KNOWN).cache()


def test_spans(found):
    got: dict = {}
    for r in found[1].collect():
        got.setdefault(r.line_id, []).append((r.s, r.pii_type, r.e))
    for i, (text, want) in enumerate(TEXTS * 20):
        assert [(k, text[s:e]) for s, k, e in sorted(got.get(i, []))] == want, text
    assert 990 not in got and 991 not in got and [k for _, k, _ in got[992]] == ["name"]


def test_redaction_changes_nothing_else(found):
    df, spans = found
    out = {r.line_id: (r.text, r.n_redacted) for r in pii.redact(df, "line_id", "texto", spans).collect()}
    assert len(out) == df.count() and out[990] == (None, 0) and out[991] == ("", 0)
    for i, (text, want) in enumerate(TEXTS):
        expect = text
        for kind, span in want:
            expect = expect.replace(span, f"[{kind.upper()}]", 1)
        assert out[i] == (expect, len(want))


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_id bigint, texto string")
    assert pii.find_spans(df, "line_id", "texto", KNOWN).count() == 0
    assert pii.redact(df, "line_id", "texto", pii.find_spans(df, "line_id", "texto", KNOWN)).count() == 0


def test_em_finds_reliabilities():
    r = np.random.default_rng(5)
    truth = r.random(4000) < 0.3
    votes = np.stack([np.where(r.random(4000) < 0.2, 0, np.where(truth == (r.random(4000) < q), 1, -1)) for q in (0.95, 0.9, 0.8)], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = pii.estimate(patterns, counts.astype(float)).posterior(patterns)[inverse.ravel()]
    assert ((post > 0.5) == truth).mean() > 0.93


def test_classifier_held_out():
    r = np.random.default_rng(6)
    y = r.random(3000) < 0.4
    x = [np.unique(np.where(r.random(6) < 0.8, 10 + np.arange(6) + 20 * int(t), r.integers(0, 200, 6))) for t in y]
    w = pii.train(x[:2000], y[:2000].astype(float), 256)
    p = np.array([w[f].sum() > 0 for f in x[2000:]])
    assert (p == y[2000:]).mean() > 0.95


def test_long_text_without_candidates():
    assert candidates("a" * 300_000, KNOWN) == [] and candidates("", KNOWN) == []


@pytest.mark.parametrize("number", ["+33 1 99 00 44 46", "01 99 00 19 73", "01.99.00.37.45", "5-55-01-04"])
def test_phone_alone_in_groups_of_two_digits(number):
    text = f"For the report, ask at {number}."
    assert [(c.kind, text[c.start : c.end]) for c in candidates(text, KNOWN)] == [("phone", number)]


def test_rare_type_is_trained_on_all_it_has(spark, monkeypatch):
    rows = [(i, "phone", 0, 9, [1, 1, 0, 0], [1]) for i in range(3000)] + [(i, "address", 20, 40, [1, 1, 1, 0], [2, 3]) for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, kind string, s int, e int, votes array<int>, features array<int>")
    sizes = []
    monkeypatch.setattr(pii, "train", lambda features, target: sizes.append(len(features)) or np.zeros(4))
    assert sorted(pii.fit(df, 50)) == ["address", "phone"]
    assert sizes[0] == 5 and 20 <= sizes[1] <= 75


def test_type_without_classifier_goes_by_its_votes(spark, monkeypatch):
    monkeypatch.setattr(pii, "fit", functools.partial(pii.fit, train_rows=0))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS * 20)], "line_id bigint, texto string")
    assert {r.pii_type for r in pii.find_spans(df, "line_id", "texto", KNOWN).select("pii_type").distinct().collect()} == {"name", "email", "phone", "identity", "address"}


@pytest.mark.parametrize("name", ["Brindotu Vjequel Orvleux Ektrask", "Brindotu Vjequel de la Orvleux Ektrask Kethorpe"])
def test_name_of_more_than_three_words(name):
    text = f"Seen by Dr. {name} on the ward."
    assert [text[c.start : c.end] for c in candidates(text, KNOWN) if c.kind == "name"] == [name]


@pytest.mark.parametrize(
    "address",
    ["12 Rue de la Paix, 75002 Paris", "Straße des 17. Juni 135, 10623 Berlin", "Hauptstr. 12, Berlin", "Via Roma 12, 00100 Roma", "Lange Allee 7 b, D-10623 Berlin", "Rua da Prata 80, 1100 Lisboa", "12B Upper Mill Lane, Flat 3, Larkmoor", "Postfach 12, 10623 Berlin"],
)
def test_addresses_of_several_countries(address):
    text = f"She lives at {address}. " + "No change since then. " * 20
    assert [(c.kind, text[c.start : c.end]) for c in candidates(text, KNOWN)] == [("address", address)]


def test_address_of_very_long_names():
    address = f"12 {'X' * 50}{'x' * 200} Street, Larkmoor"
    text = "x" * 500 + f" at {address}, then."
    assert [text[c.start : c.end] for c in candidates(text, KNOWN)] == [address]


def test_more_names_than_go_to_a_worker(spark, found):
    lexicon = spark.createDataFrame([(n.title(), k) for n, k in KNOWN.items()] + [(f"Other{i}", "given") for i in range(50)] + [("Kethorpe", "given"), (None, "given")], "name string, kind string")
    assert pii.gazetteer(lexicon, "name", "kind")["kethorpe"] == "family given"
    names = pii.gazetteer(lexicon.filter("not (name = 'Kethorpe' and kind = 'given')"), "name", "kind", most=10)
    assert not isinstance(names, dict)
    assert sorted(map(tuple, pii.find_spans(found[0], "line_id", "texto", names).select("line_id", "pii_type", "s", "e").collect())) == sorted(map(tuple, found[1].select("line_id", "pii_type", "s", "e").collect()))
