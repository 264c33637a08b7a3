import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from directed_extract import cli, session
from directed_extract.operators import detect, evaluate, grid, prepare
from directed_extract.sources import completer, jsonl, pubtator

DOCS = [{"PMID": "1", "Texto": "The flu came with Angina.", "Entidad": [{"texto": "flu", "tipo": "x"}, {"texto": "gene", "tipo": "y"}, {"texto": "ANGINA", "tipo": "z"}]}, {"PMID": "2", "Texto": "Nothing", "Entidad": []}]


def lines_in(path):
    return sorted((json.loads(x) for f in path.glob("*.json") for x in f.read_text().splitlines()), key=repr)


def written(path, docs=DOCS):
    path.write_text("\n".join(map(json.dumps, docs)))
    return str(path)


@pytest.fixture
def server():
    seen, connections = [], set()

    class Answer(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            connections.add(self.client_address)
            bad = "refuse" in body["prompt"]
            reply = json.dumps({"response": '["gene"]'}).encode()
            self.send_response(500 if bad else 200)
            self.send_header("Content-Length", str(len(reply)))
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/api/generate", seen, connections
    s.shutdown()


def test_calls_share_a_connection_and_send_everything(spark, server):
    url, seen, connections = server
    asked = spark.createDataFrame([(str(i), "m", f"p{i}", 0) for i in range(6)], "key string, model string, prompt string, ord int").coalesce(1)
    got = completer.complete_prompts(asked, completer.HttpCompleter(url), "sys", {0: 0.25})
    assert {(r.answer, r.status, r.attempts) for r in got.collect()} == {('["gene"]', "ok", 1)}
    assert len(connections) == 1 and len(seen) == 6
    assert seen[0]["keep_alive"] == "5m" and seen[0]["stream"] is False and seen[0]["system"] == "sys"
    assert seen[0]["options"]["temperature"] == 0.25 and seen[0]["options"]["stop"] == ["\nUser:", "\nUSER:", "\nAssistant:", "\nASSISTANT:", "```", "```json"]


def test_failed_calls_are_told(spark, server):
    url, seen, _ = server
    asked = spark.createDataFrame([("a", "m", "refuse", 0), ("b", "m", "fine", 0)], "key string, model string, prompt string, ord int").coalesce(1)
    calls = completer.complete_prompts(asked, completer.HttpCompleter(url), "", {}, attempts=3, pause=0.0)
    assert {(r.key, r.status, r.attempts, r.answer) for r in calls.collect()} == {("a", "failed", 3, completer.FAILED), ("b", "ok", 1, '["gene"]')}
    assert len([b for b in seen if b["prompt"] == "refuse"]) == 3
    assert {(r.status, r.n_calls, r.n_attempts) for r in completer.call_tally(calls).collect()} == {("failed", 1, 3), ("ok", 1, 1)}
    with pytest.raises(RuntimeError, match="1 of 2 model calls failed"):
        completer.complete_prompts(asked, completer.HttpCompleter(url), "", {}, attempts=1, pause=0.0, most_failed=0.4)


def test_errors_of_the_code_are_not_hidden(spark):
    with pytest.raises(ZeroDivisionError):
        completer.called(completer.FunctionCompleter(lambda m, p: str(1 / 0)), "m", "s", "p", 0.0, 3, 0.0)


def test_windows_are_worked_out_once(spark, monkeypatch):
    made = []
    original = detect.model_windows
    monkeypatch.setattr(detect, "model_windows", lambda *a, **k: made.append(1) or original(*a, **k))
    docs = jsonl.documents_from_lines(spark.createDataFrame([(json.dumps(d), i) for i, d in enumerate(DOCS)], "v string, i bigint"), "v", "i")
    run = detect.model_run(docs, docs.line_num, "text", "candidates", list(cli.config.STRATEGIES), completer.StaticCompleter({}, '["flu gene"]'))
    assert {(r.doc, r.entity) for r in run.detections.collect()} == {(0, "flu")} and made == [1]
    assert run.calls.count() == 4  # two texts, two models; nothing is asked again


def test_extract_evaluate_errors(spark, server, tmp_path):
    source, gold = written(tmp_path / "d.jsonl"), written(tmp_path / "g.jsonl", [{"PMID": "1", "Texto": "The flu came.", "Entidad": [{"texto": "Flu"}, {"texto": "lost"}]}])
    out = tmp_path / "pred"
    assert cli.main(["extract", "--input_jsonl", source, "--out_pred", str(out), "--server", server[0], "--pause", "0"]) == 0
    rows = lines_in(out)
    assert [[e["texto"] for e in r["Entidad"]] for r in rows] == [["ANGINA", "flu", "gene"], []] and all("_latency_sec" in r for r in rows)
    assert lines_in(tmp_path / "pred_summary" / "documents")[0] == {"PMID": "1", "n_accepted": 3, "min_confidence": 0.8, "max_confidence": 1.0}
    assert cli.main(["evaluate", "--predictions", str(out), "--reference", gold, "--out", str(tmp_path / "ev")]) == 0
    assert lines_in(tmp_path / "ev" / "overall")[0]["tp"] == 1
    assert cli.main(["errors", "--predictions", str(out), "--reference", gold, "--out", str(tmp_path / "er")]) == 0
    wrong = {r["entity"]: r for r in lines_in(tmp_path / "er" / "false_positives")}
    assert set(wrong) == {"angina", "gene"} and wrong["gene"]["benchmark_entities"] == ["flu", "lost"]
    assert [(r["entity"], r["predicted_entities"], r["preview"]) for r in lines_in(tmp_path / "er" / "false_negatives")] == [("lost", ["angina", "flu", "gene"], "The flu came.")]
    total = lines_in(tmp_path / "er" / "false_negatives_summary")[0]
    assert (total["n_predicted"], total["n_benchmark"], total["n_false_positives"], total["n_false_negatives"], total["n_pmids"]) == (3, 2, 2, 1, 2)


def test_no_report_without_errors(spark, tmp_path):
    source = written(tmp_path / "p.jsonl", [{"PMID": "1", "Texto": "a", "Entidad": [{"texto": "b"}]}])
    assert cli.main(["errors", "--predictions", source, "--reference", source, "--out", str(tmp_path / "er")]) == 0
    assert not (tmp_path / "er").exists()


def test_converters(spark, tmp_path):
    (tmp_path / "bio").mkdir()
    (tmp_path / "bio" / "n1.bio").write_text("Chest\tB-problem\npain\tI-problem\nnow\tO\n\n")
    assert cli.main(["convert-bio", "--input", str(tmp_path / "bio"), "--output", str(tmp_path / "b")]) == 0
    assert lines_in(tmp_path / "b") == [{"PMID": "n1", "Texto": "Chest pain now", "Entidad": [{"texto": "Chest pain", "tipo": "SpecificDisease"}]}]
    assert cli.main(["convert-bio", "--input", str(tmp_path), "--output", str(tmp_path / "none")]) == 0 and not (tmp_path / "none").exists()
    note = "7\t0\t3\tgout\tSpecificDisease\tD1\n"
    (tmp_path / "p.txt").write_text(f"7|t|Title\n7|a|Abstract\n{note}{note}\n7|t|Again\n")
    assert cli.main(["convert-pubtator", "--input", str(tmp_path / "p.txt"), "--output", str(tmp_path / "pt"), "--no-dedup"]) == 0
    assert [(r["Texto"], len(r["Entidad"])) for r in lines_in(tmp_path / "pt")] == [("Again", 0), ("Title Abstract", 2)]
    source = written(tmp_path / "d.jsonl")
    assert cli.main(["filter", "--input", source, "--output", str(tmp_path / "f")]) == 0
    assert [[e["texto"] for e in r["Entidad"]] for r in lines_in(tmp_path / "f")] == [["ANGINA"], []]
    assert cli.main(["candidates", "--input", source, "--output", str(tmp_path / "c")]) == 0
    assert {tuple((e["texto"], e["tipo"]) for e in r["Entidad"]) for r in lines_in(tmp_path / "c")} == {prepare.CANDIDATES}


@pytest.mark.parametrize("kind", ["chunks", "temperatures"])
def test_grid_and_its_analysis(spark, server, tmp_path, kind):
    source = written(tmp_path / "d.jsonl")
    out = tmp_path / "grid"
    assert cli.main(["grid", "--kind", kind, "--input_jsonl", source, "--out_dir", str(out), "--server", server[0]]) == 0
    points = grid.chunk_points() if kind == "chunks" else grid.temperature_points()
    assert {p.name.partition("=")[2] for p in out.iterdir() if "=" in p.name} == {p.file for p in points} and len(points) == (19 if kind == "chunks" else 55)
    asked = {(b["prompt"], b["options"]["temperature"]) for b in server[1]}
    assert len(server[1]) == len(asked) == (2 if kind == "chunks" else 22)
    assert cli.main(["analyze-grid", "--kind", kind, "--results", str(out), "--reference", source]) == 0
    name = "grid_search_analysis" if kind == "chunks" else "temperature_grid_analysis"
    table = next((out / f"{name}.csv").glob("*.csv")).read_text().splitlines()
    assert len(table) == 1 + len(points) and "f1_score" in table[0]
    means = next((out / "means.csv").glob("*.csv")).read_text().splitlines()[1:]
    assert means == sorted(means, key=lambda x: (x.split(",")[0], [float(v) if v.replace(".", "").isdigit() else -1.0 for v in x.split(",")[1:4]]))


def test_pubtator_parts(spark, rows):
    text = ["1|t|A", "1|a|B", "1\t0\t1\tx\tSpecificDisease\tD", "", "1|t|C", "2|t|D", "junk", "2\t0\t1\ty\tSpecificDisease\tD", "2\t0\t1\ty\tSpecificDisease\tD", "", "", "2|a|E"]
    want = None
    for size in (1, 2, 3, 5, 100):
        df = spark.createDataFrame([("f", i // size, i, x) for i, x in enumerate(text)], "file string, part int, pos bigint, line string")
        got = rows(pubtator.parse(df).select("block", "PMID", "Texto", "Entidad"))
        want = want or got
        assert got == want and [g[:3] for g in got] == [(1, "1", "A B"), (2, "1", "C"), (3, "2", "D"), (4, "2", "E")]


def test_long_allow_list(spark):
    docs = spark.createDataFrame([(0, [("N7", "t"), ("x", "t"), (None, "t"), ("n1004", "t")]), (1, None), (2, [])], "id int, e array<struct<texto:string,tipo:string>>")
    names = spark.createDataFrame([(f"n{i}",) for i in range(1, 1006)] + [(None,)], "n string")
    got = {r.id: r.e and [x.texto for x in r.e] for r in prepare.filter_by_table(docs, "id", "e", names, "n").collect()}
    assert got == {0: ["N7", "n1004"], 1: None, 2: []}


def test_no_master_and_no_private_checkpoint_folder_on_a_cluster(spark, monkeypatch):
    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("yarn")
    assert "master" not in cli.__dict__ and session.session().sparkContext.master == spark.sparkContext.master

    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                return type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(type("S", (), {"sparkContext": Context()}))


def test_repeated_keys_keep_the_last_value(spark):
    df = spark.createDataFrame([('{"PMID":"1","Texto":"a","Texto":"b"}', 1)], "v string, i bigint")
    assert jsonl.documents_from_lines(df, "v", "i").first().text == "b"


def test_totals_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc bigint, file string, pmid string, entities array<struct<texto:string,confidence:double,strategies:array<string>>>")
    assert set(evaluate.error_totals(none, spark.createDataFrame([], "pmid string, reference array<string>")).first()) == {0}
