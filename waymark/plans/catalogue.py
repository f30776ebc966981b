"""Every query of the engine over the driver's tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.parsing import AXES, first_object, passage, relations
from waymark.operators import chat, generator, graph, retrieval, runs, scoring, solver, worlds
from waymark.plans import generation_sql, oracles

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _relations(s: SparkSession, d: str) -> DataFrame:
    return worlds.neighbour_relations(worlds.order_worlds(_t(s, d, "lineitem")))


def _closed(s: SparkSession, d: str) -> DataFrame:
    return graph.closure(graph.axis_edges(_relations(s, d)))


def _items(s: SparkSession, d: str) -> DataFrame:
    """A question on each map: how its last entity lies from its first; ids, and labels to be replaced."""
    found = _relations(s, d)
    text = worlds.passages(found)
    ends = found.groupBy("map_id").agg(F.min(F.least("a", "b")).alias("lo"), F.max(F.greatest("a", "b")).alias("hi"))
    kind = F.pmod("map_id", F.lit(3))
    ask = (
        F.when(kind == 0, F.format_string("In which direction is Part %d relative to Part %d? Available options:\nA. Northeast\nB. Northwest\nC. Southeast\nD. Southwest.", "hi", "lo"))
        .when(kind == 1, F.format_string("Which object is in the Northeast of Part %d? Available options:\nA. Part %d\nB. Part %d\nC. Nobody.", "lo", "hi", "lo"))
        .otherwise(F.format_string("How many objects are in the North of Part %d? Available options:\nA. 0\nB. 1\nC. 2\nD. 3.", "lo"))
    )
    rows = text.join(ends, "map_id")
    return rows.select("map_id", "lo", "hi", F.concat(F.col("text"), F.lit("\n\nPlease answer the following question. "), ask).alias("text"))


@_query
def map_relations(s, d):
    return _relations(s, d)


@_query
def passage_text(s, d):
    return worlds.passages(_relations(s, d))


@_query
def parse_relations(s, d):
    rows = worlds.passages(_relations(s, d)).select("map_id", first_object(passage(F.col("text"))).alias("first"), F.posexplode(relations(passage(F.col("text")), True)).alias("pos", "r"))
    return rows.select("map_id", (F.col("pos") + 1).cast("long").alias("seq"), "first", "r.a", "r.dir", "r.b")


@_query
def axis_edges(s, d):
    return graph.axis_edges(_relations(s, d)).select("map_id", "axis", "src", "dst").distinct()


@_query
def axis_closure(s, d):
    return _closed(s, d)


@_query
def closure_reduction(s, d):
    return graph.reduction(_closed(s, d))


@_query
def axis_relation_pairs(s, d):
    w = worlds.order_worlds(_t(s, d, "lineitem")).select("map_id", "entity")
    pairs = w.alias("a").join(w.alias("b"), (F.col("a.map_id") == F.col("b.map_id")) & (F.col("a.entity") < F.col("b.entity"))).select("a.map_id", F.col("a.entity").alias("a"), F.col("b.entity").alias("b"))
    return graph.axis_relations(pairs, _closed(s, d))


@_query
def count_in_direction(s, d):
    return graph.in_directions(_closed(s, d)).groupBy("map_id", "ref", "dir").agg(F.count("*").alias("n"))


@_query
def which_in_direction(s, d):
    found = graph.in_directions(_closed(s, d)).groupBy("map_id", "ref", "dir").agg(F.array_sort(F.collect_list("obj")).alias("o"))
    return found.select("map_id", "ref", "dir", F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("objects"))


def _answers(s, d, mode, name):
    rows = _items(s, d).select("map_id", solver.solved(F.col("text"), mode, strict_names=True).alias("s"))
    return rows.select("map_id", F.when(F.col("s.status") == "ok", F.array_join("s.valid", ",")).otherwise(F.col("s.status")).alias(name))


@_query
def answers_definite(s, d):
    return _answers(s, d, "definite", "answer")


@_query
def answers_possible(s, d):
    return _answers(s, d, "possible", "answer")


@_query
def clean_oracle(s, d):
    items = _items(s, d).select("map_id", "text", F.lit("Z").alias("oracle_option"), F.lit("z").alias("oracle_answer"), F.lit("Z. z").alias("oracle_full_answer"))
    return solver.clean(items, "definite", strict_names=True).select("map_id", "oracle_option", "oracle_answer", "oracle_full_answer", "clean_note")


@_query
def strict_loose_acc(s, d):
    both = _answers(s, d, "definite", "gold").join(_answers(s, d, "possible", "pred"), "map_id")
    g, p = F.col("gold"), F.col("pred")
    return both.select("map_id", scoring.strict(g, p).alias("strict_acc"), scoring.loose(g, p).alias("loose_acc"), scoring.first_letter(g, p).alias("acc_gen"))


@_query
def state_groups(s, d):
    nodes = worlds.order_worlds(_t(s, d, "lineitem")).select("map_id", F.col("entity").alias("node"))
    rows = graph.groups(nodes, _closed(s, d))
    return rows.select("map_id", "axis", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.col("level").cast("long").alias("level"))


@_query
def state_text(s, d):
    nodes = worlds.order_worlds(_t(s, d, "lineitem")).select("map_id", F.col("entity").alias("node"))
    return graph.map_states(nodes, _relations(s, d))


@_query
def random_walk(s, d):
    e = _t(s, d, "events").select("user_id", "ts", "event_id", F.pmod("event_id", F.lit(8)).cast("int").alias("m"))
    dx, dy = (F.get(F.array(*[F.lit(10 * v[k]) for v in worlds.MOVES.values()]), F.col("m")) for k in (0, 1))
    out = worlds.walk(e, "user_id", ["ts", "event_id"], dx, dy)
    return out.select("user_id", "event_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "home")


@_query
def choice_shuffle(s, d):
    p = _t(s, d, "part").select("p_partkey", F.col("p_name").alias("correct_answer"), F.col("p_brand").alias("distractor1"), F.col("p_type").alias("distractor2"), F.col("p_size").cast("string").alias("distractor3"))
    out = scoring.choice_shuffle(p, "p_partkey", ["distractor1", "distractor2", "distractor3", "correct_answer"], "correct_answer")
    return out.select("p_partkey", "choice_a", "choice_b", "choice_c", "choice_d", "correct_index")


@_query
def extract_choice(s, d):
    c = _t(s, d, "conversations")
    return c.select("conv_id", "turn", scoring.extract_choice(F.col("text")).alias("choice"))


@_query
def answer_last_match(s, d):
    c = _t(s, d, "conversations")
    return c.select("conv_id", "turn", scoring.last_match(F.col("text"), r"\b([A-D])\b").alias("last"), scoring.first_match(F.col("text"), r"\b([A-D])\b").alias("first"))


@_query
def chat_messages(s, d):
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    c = _t(s, d, "conversations").groupBy("conv_id").agg(m.alias("m"))
    return c.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("chat"), chat.eval_doc(F.col("m"))["text"].alias("last_user"))


@_query
def macro_f1(s, d):
    return scoring.macro_f1(_t(s, d, "labels"), "quality", "toxic").select(F.round("macro_f1", 9).alias("macro_f1"))


@_query
def mcc(s, d):
    return scoring.mcc(_t(s, d, "labels"), "quality", "toxic").select(F.round("mcc", 9).alias("mcc"))


def _run_tasks(s, d):
    e = _t(s, d, "events")
    return e.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("task")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*") / 10000).alias("accuracy"), F.avg(F.when(F.pmod("event_id", F.lit(3)) == 0, F.pmod("event_id", F.lit(100)).cast("double"))).alias("f1"))


@_query
def run_summary(s, d):
    r = runs.summary(_run_tasks(s, d))
    return r.select("run_id", runs.rounded("avg_accuracy", 6).alias("avg_accuracy"), runs.rounded("avg_f1", 6).alias("avg_f1"), "n_tasks")


@_query
def best_run(s, d):
    r = runs.summary(_run_tasks(s, d)).withColumn("avg_accuracy", runs.rounded("avg_accuracy", 6))
    return runs.best(r, [F.col("run_id")]).select("run_id", "avg_accuracy")


def _errors(s, d, tasks):
    e = _t(s, d, "events")
    answers = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("task"), F.col("event_id").alias("pos"), F.pmod("event_id", F.lit(4)).alias("target"), F.pmod(F.floor(F.col("event_id") / 4), F.lit(4)).alias("predicted"))
    return runs.errors(answers, tasks.select("run_id", "task", runs.rounded("accuracy", 6).cast("decimal(18, 6)").alias("accuracy")))  # exact, so that halves of a percentage go up


@_query
def error_top5(s, d):
    """Both halves: low accuracy and misclassification."""
    return _errors(s, d, _run_tasks(s, d)).select("pattern", "count", F.array_join("examples", "; ").alias("examples"))


@_query
def low_accuracy(s, d):
    return _run_tasks(s, d).where((F.col("accuracy") < 0.5) & F.col("accuracy").isNotNull()).select("run_id", "task")


def _metric_facts(s, d):
    """Two metrics of all runs; the second is above 0 nowhere."""
    return _t(s, d, "events").select(F.col("user_id").alias("run_id"), F.explode(F.create_map(F.lit("value"), F.col("value"), F.lit("loss"), -F.abs("value"))).alias("metric", "value"), F.col("event_type").alias("task"))


@_query
def metric_matrix(s, d):
    """A column a task, a row a run: all runs, since tasks are few."""
    return runs.matrix(_metric_facts(s, d), ["click", "error", "purchase", "signup", "view"], rows="run_id", across="task")


@_query
def metric_grid(s, d):
    return runs.grid(_metric_facts(s, d))


@_query
def props_metrics(s, d):
    e = _t(s, d, "events")
    j = F.concat(F.lit('{"results":{"t":{"acc,none":'), F.get_json_object("props", "$.k"), F.lit(',"acc_stderr,none":0.5,"alias":"x"}}}'))
    r = runs.metrics(e.select(F.col("event_id").alias("run_id"), j.alias("json")))
    return r.select("run_id", "task", "metric", "filter", "value", "stderr")


@_query
def last_n_runs(s, d):
    e = _t(s, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max("ts").alias("timestamp"))
    return runs.last_runs(e, 5).select("run_id")


@_query
def missing_runs(s, d):
    wanted = _t(s, d, "customer").select(F.col("c_custkey").alias("run_id"))
    return wanted.join(_t(s, d, "events").select(F.col("user_id").alias("run_id")), "run_id", "left_anti")


@_query
def topk_neighbors(s, d):
    e = _t(s, d, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    out = retrieval.top_k(queries, e, 3)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


@_query
def rag_context(s, d):
    e = _t(s, d, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.contexts(retrieval.top_k(queries, e, 3), _t(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"))
    return found.select("query_id", F.length("context").cast("long").alias("n_chars"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


@_query
def chunk_documents(s, d):
    return retrieval.chunks(_t(s, d, "documents"), 800, 100).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_query
def train_test_split(s, d):
    return worlds.train_test(_t(s, d, "documents").select("doc_id"), "doc_id")


@_query
def id_prefix_filter(s, d):
    p = _t(s, d, "pages")
    return p.where(F.col("url").startswith("https://") & F.regexp_like("url", F.lit(r"/p\d*[02468]$|\d*[02468](\.html)?$"))).select("page_id")


@_query
def two_stage_generate(s, d):
    def stub(prompts, options):
        return ["ABCD"[len(p) % 4] if "regex" in options else f"{len(p)} characters" for p in prompts]

    b = _t(s, d, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return chat.generate(b, stub).select("item_id", "response", scoring.last_match(F.col("response")).alias("answer"))


def _named(s, d):
    """The relations of the maps with names for their entities."""
    named = lambda c: F.concat(F.lit("Part "), F.col(c).cast("string")).alias(c)
    return _relations(s, d).select("map_id", "seq", named("a"), "dir", named("b"))


def _named_closed(s, d):
    return graph.closure(graph.axis_edges(_named(s, d)))


@_query
def ambiguous_pairs(s, d):
    return generator.ambiguous_pairs(_named(s, d), _named_closed(s, d))


@_query
def direction_questions(s, d):
    return generator.questions(_named(s, d), ("direction",))


@_query
def count_questions(s, d):
    return generator.questions(_named(s, d), ("count",))


@_query
def which_questions(s, d):
    return generator.questions(_named(s, d), ("which",))


def _questions(s, d):
    return generator.questions(_named(s, d))


@_query
def stratified_plan(s, d):
    stratum = F.when(F.col("kind") == "count", F.col("kind")).otherwise(F.concat_ws("-", "kind", F.col("answers").cast("string")))
    return worlds.stratified(_questions(s, d).select("map_id", stratum.alias("stratum")), "stratum", generation_sql.PLAN, "map_id").select("stratum", "map_id")


@_query
def narratives(s, d):
    return generator.narratives(_named(s, d)).select("map_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_query
def sft_samples(s, d):
    content = lambda k: F.md5(F.get("messages", F.lit(k))["content"].cast("binary"))
    return generator.all_samples(_named(s, d), "Answer by letters.").select("map_id", "kind", "answers", content(1).alias("user_md5"), content(2).alias("assistant_md5"))


@_query
def sampled_worlds(s, d):
    return worlds.sampled_worlds(s, 200)


@_query
def sampled_relations(s, d):
    return worlds.sampled_relations(worlds.sampled_worlds(s, 200))


@_query
def walk_scenarios(s, d):
    """Each ten events of a user are a walk."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = _t(s, d, "events").select("user_id", "event_id", F.pmod("event_id", F.lit(8)).cast("int").alias("m"), n.cast("long").alias("n"))
    dx, dy = (F.get(F.array(*[F.lit(10 * v[k]).cast("long") for v in worlds.MOVES.values()]), F.col("m")) for k in (0, 1))
    walk = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("n") / 10).cast("string"))
    moves = e.select(walk.alias("walk_id"), (F.col("n") % 10 + 1).alias("step"), F.concat(F.lit("Place "), F.col("event_id").cast("string")).alias("place"), dx.alias("dx"), dy.alias("dy"))
    out = generator.scenarios(moves)
    return out.select("walk_id", F.md5(F.col("user").cast("binary")).alias("user_md5"), F.md5(F.col("reasoning").cast("binary")).alias("reasoning_md5"), "answer", F.size("coordinates").cast("long").alias("n_places"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (oracles.SQL | generation_sql.SQL).items() if k in _QUERIES}


assert set(oracles.DIRECTIONS) == set(AXES)
