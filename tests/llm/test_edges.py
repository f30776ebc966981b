"""Every operator on nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest

import corpus_pipeline
from waymark.llm import decontamination, jaccard_join, line_dedup, quality_classifier, quality_rules, source_mix, substring_dedup, suffix_dedup, surrogates, token_files

#: Columns with names that operators use for their own results and inner tables.
CLASHES = ["row", "size", "member", "bucket", "rank", "copies", "n_words", "n", "h", "id", "component_id", "score", "predicted", "held_out", "kept", "hits", "found", "batch", "path", "start", "_text", "_id", "_size", "base_failed", "shard", "contaminated", "_carried_0"]
LONG = "Long words of a very long text " * 40_000


def rows():
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty alpha beta"
    out = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text, "en", None), (None, text, None, "a"), (None, None, None, None), (3, None, "de", "b"), (4, "", "de", "b"), (5, " \n\t", "de", "b"), (6, "line x\nline y\n" * 3, "en", "a"), (7, LONG, "en", "a"), (7, "other text of a repeated id", "en", "b"), (8, "é\u2003ß — 你好 😀 \x00 \x0b", None, "c")]
    return out + [(100 + i, f"{text} {i} {'junk ### ' * (i % 3)}", "en", "ab"[i % 2]) for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    clash = ", ".join(f"`{c}` string" for c in CLASHES)
    every = [(*r, len(r[1] or ""), *[f"{c} of {k}" if k % 5 else None for c in CLASHES]) for k, r in enumerate(rows())]
    return spark.createDataFrame(every, f"doc_id long, text string, lang string, source string, n_chars int, {clash}").repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), (2, None), (None, "one two"), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + i, 1 - (i % 3 == 2)) for i in range(12)] + [(None, 1), (3, None), (100, 1)], "doc_id long, quality int")


REPORTS = {
    "op1": lambda d, *_: surrogates.replace(d, "k"),
    "op2": lambda d, *_: jaccard_join.groups(d, 3, 90),
    "op3": lambda d, *_: quality_rules.judge(d),
    "op4": lambda d, *_: token_files.read(d.sparkSession, token_files.write(d, public_tokenizers.path("word_bpe_49k.json"), 1)),
    "op5": lambda d, *_: line_dedup.remove_chunks(d, anywhere=True),
    "op6": lambda d, b, _: decontamination.scan(d, b),
    "op7": lambda d, _, l: quality_classifier.score(d, quality_classifier.fit(d, l)),
    "op8": lambda d, *_: source_mix.plan(d),
    "op9": lambda d, *_: substring_dedup.remove_repeats(d),
    "op10": lambda d, *_: suffix_dedup.remove_repeats(d),
}
STAGES = {
    "quality rules": lambda d, *_: quality_rules.keep(d),
    "classifier": lambda d, _, l: quality_classifier.accepted(d, quality_classifier.fit(d, l)),
    "near duplicates": lambda d, *_: jaccard_join.one_per_group(d),
    "documents": lambda d, b, _: decontamination.clean(d, b),
    "spans": lambda d, b, _: decontamination.clean(d, b, remove="spans"),
    "mix": lambda d, *_: source_mix.mixed(d),
}


@pytest.mark.parametrize("name", REPORTS)
def test_one_row_a_row(docs, bench, labels, name):
    got = REPORTS[name](docs, bench, labels)
    ids = [r.doc_id for r in (got.select("row.doc_id") if name == "op8" else got).select("doc_id").collect()]
    key = lambda x: (x is None, x)
    assert sorted(ids, key=key) == sorted((r[0] for r in rows()), key=key)
    assert REPORTS[name](docs.limit(0), bench, labels).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(docs, bench, labels, name):
    got = STAGES[name](docs, bench, labels)
    assert got.columns == docs.columns
    held = {tuple(r)[5:] for r in docs.collect()}
    kept = got.collect()
    assert kept and all(tuple(r)[5:] in held for r in kept)
    if name == "near duplicates":
        assert {r.doc_id for r in kept} >= {1, 3, 4, 5, 6, 7, 8} and sum(r.doc_id is None for r in kept) == 2 and 2 not in {r.doc_id for r in kept}
    if name == "documents":
        assert not any("seven eight nine ten eleven" in (r.text or "") for r in kept) and {3, 4, 5, 6, 7, 8} <= {r.doc_id for r in kept}
    if name == "mix":
        assert sum(r.text is None for r in kept) == 2
    assert STAGES[name](docs.limit(0), bench, labels).collect() == []


def test_ids_that_are_not_numbers_are_an_error(spark):
    df = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        substring_dedup.remove_repeats(df).collect()


def test_pipeline_on_odd_tables(spark, docs, bench, labels, tmp_path):
    for name, table in (("documents", docs), ("benchmark", bench.where("item_id is null or item_id <> 1")), ("labels", labels)):
        table.write.parquet(str(tmp_path / "odd" / f"{name}.parquet"))
        table.limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert got and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
