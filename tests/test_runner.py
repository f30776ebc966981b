"""Tasks, runs' folders, reports, readers and command lines."""

import json
import zipfile

import pytest

from waymark import cli
from waymark.operators import generator, retrieval, runs, tasks, worlds
from waymark.sources import records

TASK = """
task: colours
output_type: multiple_choice
process_docs: !function utils.only_even
dataset_path: json
dataset_kwargs:
  data_files:
    test: PATH
doc_to_text: "{{question}} A. red B. blue"
doc_to_target: "{{['red', 'blue'].index(answer)}}"
doc_to_choice: ["red", "blue"]
metric_list:
  - metric: acc
    aggregation: mean
"""


def test_task_from_file_to_report(spark, tmp_path):
    docs = [{"id": i, "question": f"q{i}", "answer": ["red", "blue"][i % 4 // 2]} for i in range(20)]
    (tmp_path / "docs.jsonl").write_text("\n".join(map(json.dumps, docs)))
    (tmp_path / "task.yaml").write_text(TASK.replace("PATH", str(tmp_path / "docs.jsonl")))
    spec = records.load_config(spark, str(tmp_path / "task.yaml"))
    assert spec["process_docs"] == "only_even"
    tasks.register("only_even", process=lambda d: d.where("id % 2 = 0"))
    score = lambda prompts, choices: [float(c == "blue") for c in choices]
    root = str(tmp_path / "results")
    for _ in range(1):
        path = cli.evaluate(spark, {"tasks": ["colours"], "limit": 6, "model": "stub"}, {"colours": spec}, score=score, root=root)
    found = runs.metrics(records.result_files(spark, root)).collect()
    assert [(r.task, r.metric, r.value) for r in found] == [("colours", "acc", 0.5)] and path.startswith(root)
    meta = records.run_metadata(spark, root).first()
    assert (meta.model, json.loads(meta.tasks)) == ("stub", ["colours"])
    answers = records.responses(spark, root).collect()
    assert {r.task for r in answers} == {"colours"} and len(answers) == 6
    lines = [r.line for r in cli.analyze(spark, root, output=str(tmp_path / "analysis")).orderBy("pos").collect()]
    assert lines[0] == "SUMMARY" and "Task: colours" in lines and any("50.00%" in x for x in lines)
    assert json.loads(spark.read.text(str(tmp_path / "analysis")).first().value)["best_run"] == path.rsplit("/", 1)[-1]
    cli.main(["analyze", root, "--last", "1"], spark)
    cli.main(["matrix", "--files", f"{root}/*/results.json", str(tmp_path / "missing.json")], spark)
    with pytest.raises(ValueError, match="unknown metric"):
        tasks.run({**spec, "metric_list": [{"metric": "partial_acc"}]}, spark.createDataFrame(docs), score=score)


def test_report_lists_wrong_answers(spark, tmp_path):
    run = tmp_path / "r1"
    run.mkdir()
    (run / "results.json").write_text(json.dumps({"results": {"t": {"acc,none": 0.25}}}))
    (run / "metadata.json").write_text(json.dumps({"timestamp": "2024-01-02", "model": "m"}))
    rows = [{"doc_id": k, "target": 0, "filtered_resps": [[-2.0, False], [-1.0, True], [-1.0, True]]} for k in range(7)]
    (run / "responses_t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    lines = [r.line for r in cli.analyze(spark, str(tmp_path), wanted=["r1", "none"]).orderBy("pos").collect()]
    assert "Low accuracy on t (1 occurrences)" in lines and "  1. r1: 25.00%" in lines
    assert "Misclassification in t (5 occurrences)" in lines and "  1. r1 doc=0: predicted=B (idx 1), expected=A (idx 0)" in lines


def test_filters(spark):
    df = spark.createDataFrame([("Answer: A then Answer: B, C",), ("none",), (None,)], "t string")
    last = [{"function": "regex", "regex_pattern": r"Answer:\s*([A-D](?:\s*,\s*[A-D])*)", "group_select": -1}]
    first = [{"function": "regex", "regex_pattern": "Answer: ([A-D])"}, {"function": "take_first"}]
    got = df.select(tasks.filtered(df.t, last).alias("a"), tasks.filtered(df.t, first).alias("b")).collect()
    assert [tuple(r) for r in got] == [("B, C", "A"), ("[invalid]", "[invalid]"), ("[invalid]", "[invalid]")]


def test_json_array(spark, tmp_path):
    for n in (0, 1, 5):
        rows = spark.createDataFrame([(i, 'x"\n', None) for i in range(n)], "a long, b string, c string").repartition(3)
        records.write_json_array(rows, str(tmp_path / f"a{n}"))
        (part,) = (tmp_path / f"a{n}").glob("part-*")
        got = json.loads(part.read_text())
        assert sorted(r["a"] for r in got) == list(range(n)) and all(r["b"] == 'x"\n' and r["c"] is None for r in got)
        assert records.json_array(spark, str(part), "a long, b string, c string").count() == n


def test_corpus_reads_docx(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain é", encoding="utf-8")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    with pytest.warns(UserWarning, match="nothing at"):
        got = {r.doc_id.rsplit("/", 1)[-1]: r.text for r in records.corpus(spark, [str(tmp_path), str(tmp_path / "none")]).collect()}
    assert got == {"a.txt": "plain é", "b.docx": "One line\nTwo"}


def test_clean_and_generate_commands(spark, tmp_path):
    item = {"id": "1", "text": "A is in the map. B is to the Northeast of A.\n\nPlease answer. In which direction is B relative to A? Options:\nA. Northeast\nB. Southwest.", "oracle_option": "B"}
    (tmp_path / "in.jsonl").write_text(json.dumps(item))
    cli.main(["clean", str(tmp_path / "in.jsonl"), str(tmp_path / "out")], spark)
    assert records.jsonl(spark, str(tmp_path / "out")).first().oracle_option == "A"
    cli.main(["generate", str(tmp_path / "sft"), "--maps", "12", "--plan", '{"count": 6, "direction-1": 4, "which-2": 0}'], spark)
    rows = spark.read.json(str(tmp_path / "sft")).collect() if False else spark.read.json([str(tmp_path / "sft" / p) for p in ("train", "test")]).collect()
    assert len(rows) == 10 and spark.read.json(str(tmp_path / "sft" / "test")).count() == 2
    assert all([m.role for m in r.messages] == ["system", "user", "assistant"] and "### Final Deduction" in r.messages[2].content for r in rows)


def test_index_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    key = retrieval.index_key(["b", "a"], 800, 100, "m")
    assert key == retrieval.index_key(["a", "b"], 800, 100, "m") != retrieval.index_key(["a", "b"], 800, 50, "m")
    assert [retrieval.index(spark, str(tmp_path), key, build).count() for _ in range(2)] == [3, 3] and calls == [1]
    one = retrieval.retriever("test-index", lambda: spark.range(2))
    assert retrieval.retriever("test-index", lambda: spark.range(9)) is one


def test_sentence_chunks(spark):
    texts = ["One two. Three four five! Six? " + "w " * 12 + "end. Last one.", "", None, "   ", "alone"]

    def brute(text, size, overlap):
        sentences = [s for s in __import__("re").split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]
        done, now = [], []
        n = lambda us: sum(len(u.split()) for u in us)
        for s in sentences:
            if now and n(now) + n([s]) > size:
                done.append(now)
                now = next(now[i:] for i in range(len(now) + 1) if n(now[i:]) <= min(overlap, max(size - n([s]), 0)))
            now = [*now, s]
        return [" ".join(c) for c in [*done, now] if c]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((5, 2), (6, 0), (100, 10), (3, 3)):
        got = sorted((r.doc_id, r.chunk_no, r.text) for r in retrieval.sentence_chunks(df, size, overlap).collect())
        assert got == [(i, k, c) for i, t in enumerate(texts) if t for k, c in enumerate(brute(t, size, overlap))], (size, overlap)


def test_top_k_of_many_partitions(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0] if i % 11 else None) for i in range(200)] + [(500, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    queries = df.where("vec_id < 40").withColumnRenamed("vec_id", "query_id")

    def cosine(a, b):
        dot, na, nb = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return round(dot / (na * nb), 6) if na and nb else 0.0

    held = {i: v for i, v in rows if v}
    want = [(q, k + 1, *x) for q in held if q < 40 for k, x in enumerate((i, -s) for s, i in sorted((-cosine(held[q], v), i) for i, v in held.items())[:4])]
    for most in (10_000, 7):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in retrieval.top_k(queries, df, 4, most=most).collect())
        assert got == sorted(want)
    assert retrieval.top_k(queries.limit(0), df, 4).count() == 0


def test_names_differ():
    assert len(worlds.ENTITIES) == 20 and len(set(worlds.PLACES)) == 52


def test_walk_returning_home_has_no_sample(spark):
    moves = spark.createDataFrame([("a", 1, "P", 5, 5), ("a", 2, "Q", 10, 0), ("a", 3, "R", -10, 0), ("b", 1, "P", 0, 0), ("b", 2, "Q", 0, 10), ("c", 1, "P", 1, 1)], "walk_id string, step long, place string, dx long, dy long")
    (row,) = generator.scenarios(moves).collect()
    assert row.walk_id == "b" and row.answer == "A" and "A. North\n\nB. Northwest" in row.user and row.coordinates == {"P": [0, 0], "Q": [0, 10]}
    assert '- Relation: North of "P" (0, 0) -> implies x = 0, y > 0.' in row.reasoning and "y increases (0->10)" in row.reasoning
