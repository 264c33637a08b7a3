import json

from directed_extract import cli, config
from directed_extract.operators.grid import file_parameters, file_profile
from directed_extract.sources.completer import StaticCompleter
from directed_extract.sources.jsonl import documents_from_lines, read_documents, read_prediction_files, read_strict, write_lines
from directed_extract.streaming.documents import start_extraction, stream_lines

DOCS = [{"PMID": "1", "Texto": "The flu came.", "Entidad": [{"texto": "flu"}, {"texto": "gene"}]}, {"PMID": "2", "Texto": "Nothing", "Entidad": []}]


def test_arguments():
    args = cli.parser().parse_args(["extract", "--input_jsonl", "x", "--strategies", "llama32_balanced", "--s1_target", "200", "--confidence_threshold", "2", "--limit", "-1"])
    assert len(cli.problems(args)) == 3
    s = cli.chosen_strategies(args)
    assert [x.name for x in s] == ["llama32_balanced"] and (s[0].chunk_min, s[0].chunk_max) == (100, 400) and config.STRATEGIES[1].chunk_target == 60


def test_predictions_round_trip(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, DOCS)))
    docs = read_documents(spark, str(tmp_path / "d.jsonl"))
    rows = cli.predict(docs, list(config.STRATEGIES), StaticCompleter({}, '["gene"]'), config.Thresholds())
    write_lines(rows, str(tmp_path / "out"))
    back = {r.PMID: r for r in read_strict(spark, str(tmp_path / "out")).collect()}
    assert [(e.texto, e.confidence) for e in back["1"].Entidad] == [("flu", 1.0), ("gene", 0.8)]
    assert back["2"].Entidad == [] and back["1"]._multi_strategy.all_detections["regex"] == ["flu"] and back["1"]._multi_strategy.confidence_thresholds["min_accept"] == 0.5


def test_files_by_pattern(spark, tmp_path):
    for chunk in (20, 40):
        (tmp_path / f"results_qwen_n2c2_chunk{chunk}_ov10.jsonl").write_text("\n".join(map(json.dumps, DOCS)))
    (tmp_path / "other.txt").write_text("{}")
    p = read_prediction_files(spark, str(tmp_path / "results_*_n2c2_chunk*_ov*.jsonl"))
    assert {(r.model, r.chunk, r.docs, r.entities) for r in file_parameters(file_profile(p), "file").collect()} == {("qwen", 20, 2, 2), ("qwen", 40, 2, 2)}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, d in enumerate(DOCS):
        (tmp_path / "in" / f"{i}.jsonl").write_text(json.dumps(d) + "\nnot json\n")
    q = start_extraction(stream_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = [(r.doc, r.entity) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [("1", "flu")]
    assert documents_from_lines(spark.createDataFrame([], "value string, line_num bigint"), "value", "line_num").count() == 0
