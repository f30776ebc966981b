import json

from waymark.operators import chat, retrieval
from waymark.sources import records
from waymark.streaming import clean_stream

ITEM = "A is in the map. B is to the Northeast of A.\n\nPlease answer. In which direction is B relative to A? Options:\nA. Northeast\nB. Southwest."


def test_jsonl_and_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.jsonl").write_text(json.dumps({"id": "1", "text": ITEM, "oracle_option": "B", "n": 5, "tags": ["x"], "note": "é \"q\""}, ensure_ascii=False) + "\n\n  \n", encoding="utf-8")
    items = records.jsonl(spark, str(src))
    assert items.count() == 1
    records.write_jsonl(items, str(tmp_path / "copy"))
    line = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "copy").glob("part-*"))
    assert json.loads(line) == {"id": "1", "text": ITEM, "oracle_option": "B", "n": 5, "tags": ["x"], "note": "é \"q\""}
    clean_stream.clean(spark, str(src), str(out), str(tmp_path / "ck")).awaitTermination()
    assert [r.oracle_option for r in spark.read.json(str(out)).collect()] == ["A"]


def test_results_and_corpus(spark, tmp_path):
    run = tmp_path / "run1"
    run.mkdir()
    (run / "results.json").write_text(json.dumps({"results": {"t": {"acc,none": 0.5}}}))
    (run / "metadata.json").write_text(json.dumps({"timestamp": "2024", "base_model": "m"}))
    (run / "responses_t.jsonl").write_text(json.dumps({"doc_id": 3, "target": "A", "filtered_resps": ["B"]}) + "\n")
    assert records.result_files(spark, str(tmp_path)).first().run_id == "run1"
    assert records.run_metadata(spark, str(tmp_path)).first().model == "m"
    r = records.responses(spark, str(tmp_path)).first()
    assert (r.run_id, r.task, r.pos, r.target) == ("run1", "t", 3, "A")
    assert records.corpus(spark, [str(run), str(tmp_path / "none")]).count() == 3
    assert records.corpus(spark, [str(tmp_path / "none")]).count() == 0


def test_chat_and_augment(spark):
    row = spark.createDataFrame([("s", "u", "r", {"A": [1, 2]}, "A, B", ["x", "y"], 1)], "s string, u string, r string, c map<string,array<int>>, a string, o array<string>, i int")
    from pyspark.sql import functions as F

    m = row.select(chat.messages(*[F.col(x) for x in "srrca"]).alias("m"), chat.template("{{u}}: {{o[i]}} {{o[0]}}").alias("t")).select("m", "t", chat.eval_doc(F.col("m")).alias("d")).first()
    assert m.m[2].content == '<think>r\nCoordinates\n{"A": [1, 2]}</think>Answer: A, B' and m.t == "u: y x" and m.d.oracle_option == "A,B"
    s = spark.createDataFrame([(1, "q"), (2, " ")], "id long, text string")
    c = spark.createDataFrame([(1, "- x"), (2, "- y")], "query_id long, context string")
    assert {r.id: r.context for r in retrieval.augment(s, c, "id").collect()} == {1: "- x", 2: None}
    e = retrieval.embed(s, "text", lambda t: [[float(len(x))] for x in t]).first()
    assert e.embedding == [1.0]
