"""Queries of tasks, runs and single text functions, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import parsing as P
from waymark.operators import chat, generator, graph, reports, retrieval, runs, scoring, solver, tasks, worlds
from waymark.plans import catalogue as C
from waymark.plans import oracles as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TASKS = {t["task"]: t for t in json.loads(Path(__file__).with_name("tasks.json").read_text(encoding="utf-8"))}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_KIND = "CASE map_id % 3 WHEN 0 THEN 'direction' WHEN 1 THEN 'which' ELSE 'count' END"
_ENDS = f"WITH RECURSIVE {O.WORLD}, ends AS (SELECT map_id, min(least(a, b)) AS lo, max(greatest(a, b)) AS hi, arg_min(b, seq) AS b0 FROM r GROUP BY map_id)"
_ASK = """CASE map_id % 3 WHEN 0 THEN 'In which direction is Part ' || hi || ' relative to Part ' || lo || '? Available options:' || chr(10) || 'A. Northeast' || chr(10) || 'B. Northwest' || chr(10) || 'C. Southeast' || chr(10) || 'D. Southwest.'
  WHEN 1 THEN 'Which object is in the Northeast of Part ' || lo || '? Available options:' || chr(10) || 'A. Part ' || hi || chr(10) || 'B. Part ' || lo || chr(10) || 'C. Nobody.'
  ELSE 'How many objects are in the North of Part ' || lo || '? Available options:' || chr(10) || 'A. 0' || chr(10) || 'B. 1' || chr(10) || 'C. 2' || chr(10) || 'D. 3.' END"""


@_query(f"""{_ENDS} SELECT map_id, {_KIND} AS kind, CASE map_id % 3 WHEN 0 THEN 'Part ' || hi WHEN 1 THEN 'Northeast' ELSE 'North' END AS first_arg, 'Part ' || lo AS second_arg,
  CASE map_id % 3 WHEN 0 THEN 'Part ' || hi WHEN 1 THEN 'Northeast' ELSE 'North' END AS heading,
  CASE map_id % 3 WHEN 0 THEN 'A=Northeast|B=Northwest|C=Southeast|D=Southwest' WHEN 1 THEN 'A=Part ' || hi || '|B=Part ' || lo || '|C=Nobody' ELSE 'A=0|B=1|C=2|D=3' END AS options,
  'Part ' || b0 AS first, 'Consider a map with multiple objects:' || chr(10) || 'Part ' || b0 AS first_glued,
  CASE map_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'East' END AS x_side, CASE map_id % 3 WHEN 0 THEN NULL ELSE 'North' END AS y_side FROM ends""")
def question_parts(s, d):
    """Kind, arguments, options, title case, first object in both forms, and the direction's sides."""

    def parts(q: Column) -> Column:
        kind = P.question_type(q)
        return P.let(P.arguments(q, kind), lambda a: F.struct(kind.alias("kind"), a["first"].alias("first_arg"), a["second"].alias("second_arg"), F.initcap(a["first"]).alias("heading"), F.array_join(F.transform(P.options(q), lambda o: F.concat(o["letter"], F.lit("="), o["value"])), "|").alias("options")))

    text = P.straight_quotes(F.col("text"))
    rows = C._items(s, d).select("map_id", P.let(P.question(text), parts).alias("q"), P.first_object(P.passage(text)).alias("first"), P.first_object(P.passage(text), glued=True).alias("first_glued"))
    return rows.select("map_id", "q.*", "first", "first_glued", *[generator.component(F.col("q.heading"), a).alias(f"{a}_side") for a in "xy"])


@_query("SELECT c_custkey, '\"' || c_name || '\" is the customer''s ''name''' AS quoted FROM customer")
def quote_normalise(s, d):
    return C._t(s, d, "customer").select("c_custkey", P.straight_quotes(F.concat(F.lit("“"), "c_name", F.lit("” is the customer’s ‘name’"))).alias("quoted"))


@_query("""WITH m AS (SELECT event_id, ['North', 'South', 'East', 'West', 'Northeast', 'Northwest', 'Southeast', 'Southwest', 'Up'][event_id % 9 + 1] AS dir, event_id % 13 AS x, event_id % 7 - 3 AS y FROM events),
o AS (SELECT *, CASE WHEN dir = 'Up' THEN NULL WHEN dir ILIKE '%east' THEN '>' WHEN dir ILIKE '%west' THEN '<' ELSE '=' END AS ox, CASE WHEN dir ILIKE 'north%' THEN '>' WHEN dir ILIKE 'south%' THEN '<' ELSE '=' END AS oy FROM m)
SELECT event_id, coalesce('x ' || ox || ' ' || x || ', y ' || oy || ' ' || y, 'Unknown logic') AS logic, CASE ox WHEN '>' THEN 'East' WHEN '<' THEN 'West' END AS x_side, CASE WHEN dir = 'Up' THEN NULL WHEN oy = '>' THEN 'North' WHEN oy = '<' THEN 'South' END AS y_side,
  'The ' || x || ' is to the ' || dir || ' of the ' || y || '.' AS sentence FROM o""")
def direction_logic(s, d):
    names = F.array(*[F.lit(x) for x in ["North", "South", "East", "West", "Northeast", "Northwest", "Southeast", "Southwest", "Up"]])
    e = C._t(s, d, "events").select("event_id", F.get(names, F.pmod("event_id", F.lit(9)).cast("int")).alias("dir"), F.pmod("event_id", F.lit(13)).alias("x"), (F.pmod("event_id", F.lit(7)) - 3).alias("y"))
    dir_ = F.col("dir")
    return e.select("event_id", generator.logic(dir_, F.col("x"), F.col("y")).alias("logic"), generator.component(dir_, "x").alias("x_side"), generator.component(dir_, "y").alias("y_side"), worlds.sentence(F.col("x"), dir_, F.col("y"), articles=True).alias("sentence"))


_PART_CHAT = "array_to_string(CASE p_partkey % 3 WHEN 0 THEN ['A'] WHEN 1 THEN ['A', 'C'] ELSE ['B', 'C', 'D'] END, ', ')"


def _chat_docs(s, d):
    letters = F.array(*[F.array(*[F.lit(x) for x in v]) for v in ("A", "AC", "BCD")])
    p = C._t(s, d, "part")
    answer = F.array_join(F.get(letters, F.pmod("p_partkey", F.lit(3)).cast("int")), ", ")
    places = F.create_map(F.col("p_name"), F.array(F.pmod("p_partkey", F.lit(50)).cast("int"), F.col("p_size").cast("int")))
    return p.select(F.col("p_partkey").alias("id"), chat.messages(F.lit("Be exact."), F.concat(F.lit("Where is "), "p_name", F.lit("?")), F.col("p_type"), places, answer).alias("messages"))


@_query(f"""SELECT p_partkey AS id, '<think>' || p_type || chr(10) || 'Coordinates' || chr(10) || '{{"' || p_name || '": [' || p_partkey % 50 || ', ' || p_size || ']}}</think>Answer: ' || {_PART_CHAT} AS said,
  'Where is ' || p_name || '?' AS text, replace({_PART_CHAT}, ', ', ',') AS oracle_option FROM part""")
def chat_samples(s, d):
    return _chat_docs(s, d).select("id", F.get("messages", F.lit(2))["content"].alias("said"), F.inline(F.array(chat.eval_doc(F.col("messages")))))


@_query("""WITH t AS (SELECT event_id, ['A', 'B', 'C', 'D'] AS l, event_id % 5 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN l[1] || ', ' || l[3] WHEN 1 THEN l[1 + event_id % 4] WHEN 2 THEN 'D' END AS last_match, CASE k WHEN 0 THEN 'B' WHEN 1 THEN l[1 + event_id % 4] WHEN 2 THEN 'A' END AS first_match FROM t""")
def answer_patterns(s, d):
    """The two answer filters, on responses with several answers, one and none."""
    e, letter = F.col("event_id"), F.get(F.array(*[F.lit(x) for x in "ABCD"]), F.pmod("event_id", F.lit(4)).cast("int"))
    text = F.when(e % 5 == 0, "Answer: B, no. Answer:  A, C").when(e % 5 == 1, F.concat(F.lit("So Answer: "), letter, F.lit("."))).when(e % 5 == 2, "Answer: A and then Answer:D").when(e % 5 == 3, "answer: A").otherwise("")
    rows = C._t(s, d, "events").select("event_id", text.alias("t"))
    return rows.select("event_id", scoring.last_match(F.col("t")).alias("last_match"), scoring.first_match(F.col("t")).alias("first_match"))


@_query("""SELECT event_id, round(value, 2) AS acc, CAST(json_extract(props, '$.k') AS DOUBLE) AS by_prefix, CAST(NULL AS DOUBLE) AS none, 'score,none|score_stderr,none' AS custom, event_type || ' all' AS label, chr(CAST(65 + event_id % 4 AS INTEGER)) AS letter FROM events""")
def metric_lookup(s, d):
    """Metric maps looked up by exact name and by prefix, the custom ones among their keys, task labels and option letters."""
    k = F.get_json_object("props", "$.k").cast("double")
    m = F.create_map(F.lit("acc"), F.round("value", 2), F.lit("f1,none"), k, F.lit("acc_gen,none"), F.lit(1.0), F.lit("score,none"), F.lit(2.0), F.lit("score_stderr,none"), F.lit(0.1), F.lit("score_stderr"), F.lit(0.1))
    rows = C._t(s, d, "events").select("event_id", "event_type", m.alias("m"), F.concat(F.lit("spatial_eval_gen_"), "event_type", F.lit("_all")).alias("task"))
    m = F.col("m")
    return rows.select("event_id", runs.lookup(m, "accuracy", "acc").alias("acc"), runs.lookup(m, "f1").alias("by_prefix"), runs.lookup(m, "em").alias("none"), F.array_join(F.array_sort(F.map_keys(runs.custom_metrics(m))), "|").alias("custom"), runs.task_label(F.col("task")).alias("label"), scoring.letter(F.pmod("event_id", F.lit(4)).cast("int")).alias("letter"))


@_query("""WITH c AS (SELECT label, vec_id, embedding[1:4] AS s FROM embeddings), p AS (SELECT *, list_position(s, list_max(s)) - 1 AS k FROM c)
SELECT label, CAST(sum(CASE WHEN k = vec_id % 4 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS accuracy, min(chr(CAST(65 + k AS INTEGER))) AS least_letter, count(*) AS n FROM p GROUP BY label""")
def choice_argmax(s, d):
    """Choices by their scores, the first of equals, and the accuracy of each label."""
    e = C._t(s, d, "embeddings").select("label", "vec_id", runs.predicted_index(F.slice("embedding", 1, 4)).alias("k"))
    return e.groupBy("label").agg(scoring.accuracy(F.col("k") == F.pmod("vec_id", F.lit(4))).alias("accuracy"), F.min(scoring.letter(F.col("k"))).alias("least_letter"), F.count("*").alias("n"))


@_query(f"WITH t AS ({O.SQL['strict_loose_acc']}) SELECT sum(strict_acc) / count(*) AS strict_acc, sum(loose_acc) / count(*) AS loose_acc, sum(acc_gen) / count(*) AS acc_gen, count(*) AS n FROM t")
def mean_scores(s, d):
    return C.strict_loose_acc(s, d).agg(*[scoring.accuracy(F.col(c)).alias(c) for c in ("strict_acc", "loose_acc", "acc_gen")], F.count("*").alias("n"))


@_query("SELECT item_id, length(text) + 32 AS n_chars, md5('One? ' || 'Answer: A' || chr(10) || chr(10) || 'Two? ' || 'Answer: B' || chr(10) || chr(10) || text) AS prompt_md5 FROM benchmark")
def few_shot_prompts(s, d):
    p = chat.few_shot(F.col("text"), ["One? Answer: A", "Two? Answer: B"])
    return C._t(s, d, "benchmark").select("item_id", F.length(p).cast("long").alias("n_chars"), F.md5(p.cast("binary")).alias("prompt_md5"))


@_query(f"""WITH RECURSIVE {O.ASKED} SELECT 'spatialmap.tqa.' || map_id || '.' || map_id % 2 AS id, p AS oracle_option FROM said WHERE map_id % 5 <> 0""")
def reoracle_items(s, d):
    return solver.reoracle(_spatial(s, d)).select("id", "oracle_option")


@_query(f"""WITH RECURSIVE {O.CLOSED}, lo AS (SELECT map_id, axis, max(src) AS root FROM e GROUP BY ALL) SELECT c.map_id, c.axis, root, c.dst AS node FROM lo JOIN c ON c.map_id = lo.map_id AND c.axis = lo.axis AND c.src = root""")
def frontier_search(s, d):
    edges = graph.axis_edges(C._relations(s, d))
    return graph.reached(edges, edges.groupBy("map_id", "axis").agg(F.max("src").alias("root")))


@_query(f"""WITH {O.EDGES}, n AS (SELECT map_id, entity AS node, axis FROM w, (VALUES ('x'), ('y')) t(axis)), ind AS (SELECT map_id, axis, dst, count(*) AS n FROM e GROUP BY ALL)
SELECT n.map_id, n.axis, n.node, coalesce(ind.n, 0) AS in_degree, ind.n IS NULL AS is_source FROM n LEFT JOIN ind ON ind.map_id = n.map_id AND ind.axis = n.axis AND ind.dst = n.node""")
def graph_sources(s, d):
    nodes = worlds.order_worlds(C._t(s, d, "lineitem")).select("map_id", F.col("entity").alias("node"))
    return graph.degrees(nodes, graph.axis_edges(C._relations(s, d)))


def _runs_of(s, d):
    """The five newest runs with their rank, and the tasks of those."""
    e = C._t(s, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max("ts").alias("timestamp"))
    newest = runs.last_runs(e, 5)
    rank = F.row_number().over(Window.orderBy(F.col("timestamp").desc(), "run_id"))  # five rows
    rounded = [runs.rounded(c, 6).alias(c) for c in ("accuracy", "f1")]
    return newest.select("run_id", rank.alias("rank")), C._run_tasks(s, d).select("run_id", "task", *rounded)


_NEWEST = f"""{O.TASKS}, ru AS (SELECT user_id AS run_id, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS rank FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 5),
rt AS (SELECT ru.run_id, rank, task, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM t JOIN ru ON ru.run_id = t.run_id),
sm AS (SELECT run_id, rank, round(avg(accuracy), 6) AS avg_accuracy, round(avg(f1), 6) AS avg_f1, count(*) AS n_tasks FROM rt GROUP BY ALL)"""


def _report(s, d):
    newest, found = _runs_of(s, d)
    rows = runs.with_results(newest, found)
    summary = runs.summary(rows).join(newest, "run_id").withColumns({c: runs.rounded(c, 6) for c in ("avg_accuracy", "avg_f1")})
    return summary, rows


@_query(f"""WITH {O.TASKS}, f AS (SELECT task, list({{'run_id': run_id, 'a': round(accuracy, 6)}} ORDER BY run_id) AS l FROM t GROUP BY task)
SELECT task, row_number() OVER (ORDER BY m, task) AS pos, array_to_string(list_transform(l, lambda x: x.run_id || '=' || CAST(round(x.a * 1000000) AS BIGINT)), ';') AS runs FROM f JOIN (SELECT event_type AS task, min(event_id) AS m FROM events GROUP BY ALL) USING (task)""")
def task_breakdown(s, d):
    """Each task's runs in order, and the tasks in the order in which they first appear."""
    rows = runs.per_task(C._run_tasks(s, d).select("run_id", "task", runs.rounded("accuracy", 6).alias("accuracy"), "f1"), ["run_id"])
    first = runs.first_seen(C._t(s, d, "events").withColumnRenamed("event_type", "task"), "task", ["event_id"])
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["run_id"].cast("string"), F.lit("="), F.round(r["accuracy"] * 1000000).cast("long").cast("string"))), ";")
    return rows.join(first, "task").select("task", F.col("pos").cast("long").alias("pos"), told.alias("runs"))


@_query("""WITH t AS (SELECT DISTINCT user_id AS run_id, event_type AS task FROM events), p AS (SELECT user_id AS run_id, event_type AS task, count(*) AS n, sum(event_id % 4) AS s FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT t.run_id, t.task, coalesce(n, 0) AS n_responses, CAST(s AS BIGINT) AS targets FROM t LEFT JOIN p ON p.run_id = t.run_id AND p.task = t.task""")
def run_responses(s, d):
    """Tasks of runs with their responses; a task without any stays."""
    e = C._t(s, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("task"), "event_id")
    rows = runs.with_responses(e.select("run_id", "task").distinct(), e.where("event_id % 3 = 0").withColumn("target", F.pmod("event_id", F.lit(4))))
    return rows.groupBy("run_id", "task").agg(F.count("event_id").alias("n_responses"), F.sum("target").alias("targets"))


@_query("SELECT row_number() OVER (ORDER BY metric) AS pos, metric FROM (SELECT DISTINCT event_type || '_rate' AS metric FROM events UNION SELECT DISTINCT 'loss_' || event_type FROM events WHERE event_id % 2 = 0)")
def metric_names(s, d):
    e = C._t(s, d, "events")
    return runs.metric_names(e.select(F.concat("event_type", F.lit("_rate")).alias("metric")), e.where("event_id % 2 = 0").select(F.concat(F.lit("loss_"), "event_type").alias("metric"))).select(F.col("pos").cast("long").alias("pos"), "metric")


_PCT = lambda c: f"CAST(CAST(round({c} * 10000) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(round({c} * 10000) AS BIGINT) % 100 AS VARCHAR), 2, '0') || '%'"
_TWO = lambda c: f"CAST(CAST(round({c} * 100) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(round({c} * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')"
_OR_NONE = lambda c, text: f"CASE WHEN coalesce({c}, 0) <> 0 THEN {text} ELSE 'N/A' END"


@_query(f"""WITH {_NEWEST}, al AS (
  SELECT 0 AS s, '' AS a, '' AS b, 'SUMMARY' AS line UNION ALL SELECT 1, '', '', printf('%-25s %10s %10s %8s', 'Run ID', 'Avg Acc', 'Avg F1', 'Tasks') UNION ALL SELECT 4, '', '', 'PER-TASK BREAKDOWN' UNION ALL SELECT 6, '', '', 'ERROR ANALYSIS'
  UNION ALL SELECT 2, printf('%012d', rank), '', printf('%-25s %10s %10s %8d', CAST(run_id AS VARCHAR), {_OR_NONE("avg_accuracy", _PCT("avg_accuracy"))}, {_OR_NONE("avg_f1", _TWO("avg_f1"))}, n_tasks) FROM sm
  UNION ALL (SELECT 3, '', '', 'Best run: ' || run_id FROM sm ORDER BY avg_accuracy DESC, rank LIMIT 1)
  UNION ALL SELECT DISTINCT 5, task, '', 'Task: ' || task FROM rt
  UNION ALL SELECT 5, task, printf('%012d', row_number() OVER (ORDER BY rank, task)), printf('  %-25s %10s %10s', task, {_OR_NONE("accuracy", _PCT("accuracy"))}, {_OR_NONE("f1", _TWO("f1"))}) FROM rt
  UNION ALL SELECT 7, 'Low accuracy on ' || task, '', 'Low accuracy on ' || task || ' (' || count(*) || ' occurrences)' FROM rt WHERE accuracy < 0.5 GROUP BY task
  UNION ALL SELECT 7, p, printf('%06d', k), '  ' || k || '. ' || e FROM (SELECT 'Low accuracy on ' || task AS p, row_number() OVER (PARTITION BY task ORDER BY run_id) AS k, run_id || ': ' || {_PCT("accuracy")} AS e FROM rt WHERE accuracy < 0.5) WHERE k <= 3)
SELECT row_number() OVER (ORDER BY s, a, b) AS pos, line FROM al""")
def report_lines(s, d):
    """The console report of the five newest runs."""
    summary, rows = _report(s, d)
    none = s.createDataFrame([], "run_id long, task string, pos long, target long, predicted long")
    found = runs.errors(none.select(F.col("run_id").cast(rows.schema["run_id"].dataType).alias("run_id"), "task", "pos", "target", "predicted"), rows)
    return reports.lines(summary, rows.withColumn("task_order", F.col("task")), found, ["rank"]).select(F.col("pos").cast("long").alias("pos"), "line")


@_query(f"""WITH {_NEWEST} SELECT (SELECT string_agg(run_id || ':' || n_tasks, ',' ORDER BY rank) FROM sm) AS runs, (SELECT count(DISTINCT task) FROM rt) AS n_tasks, (SELECT CAST(run_id AS VARCHAR) FROM sm ORDER BY avg_accuracy DESC, rank LIMIT 1) AS best_run,
  (SELECT count(DISTINCT task) FROM rt WHERE accuracy < 0.5) AS n_patterns""")
def analysis_json(s, d):
    """What the analysis document of the five newest runs says when read again."""
    summary, rows = _report(s, d)
    none = rows.select("run_id", "task").where(F.lit(False)).withColumns({c: F.lit(None).cast("long") for c in ("pos", "target", "predicted")})
    doc = reports.analysis(summary, rows, runs.errors(none, rows), ["rank"])
    kind = "struct<summary: array<struct<run_id: bigint, n_tasks: bigint>>, per_task_breakdown: array<struct<task: string>>, error_analysis: array<struct<category: string, count: bigint>>, best_run: string>"
    doc = doc.select(F.from_json("json", kind).alias("j"))
    told = F.array_join(F.transform("j.summary", lambda r: F.concat(r["run_id"].cast("string"), F.lit(":"), r["n_tasks"].cast("string"))), ",")
    return doc.select(told.alias("runs"), F.size("j.per_task_breakdown").cast("long").alias("n_tasks"), "j.best_run", F.size("j.error_analysis").cast("long").alias("n_patterns"))


@_query("SELECT user_id, 'checkpoint-' || max(event_id * 10) AS name, max(event_id * 10) AS step FROM events WHERE event_id % 4 <> 0 GROUP BY user_id")
def latest_checkpoint(s, d):
    name = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("checkpoint-"), F.col("event_id").cast("string"), F.lit("-old"))).otherwise(F.concat(F.lit("checkpoint-"), (F.col("event_id") * 10).cast("string")))
    return runs.latest_checkpoint(C._t(s, d, "events").select("user_id", name.alias("name")), ["user_id"])


@_query("SELECT user_id AS run_id, coalesce(min_by(CASE WHEN event_id % 3 = 0 THEN event_type || ' (n' || event_id || ')' ELSE 'n' || event_id END, CASE WHEN event_id % 3 = 0 THEN event_id ELSE 1000000000 + event_id END), 'unknown') AS label FROM events GROUP BY user_id")
def run_labels(s, d):
    model = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("org/"), "event_type"))
    return runs.run_label(C._t(s, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), model.alias("model"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("notes")))


@_query("SELECT s_suppkey AS run_id, s_suppkey % 2 = 0 AS found FROM supplier")
def chosen_runs(s, d):
    """Wanted runs that there are, and those that there are not."""
    wanted = [r.s_suppkey for r in C._t(s, d, "supplier").select("s_suppkey").collect()]  # the list a user gives
    have = C._t(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("run_id"))
    found, missing = runs.chosen_runs(have, wanted)
    return found.select("run_id", F.lit(True).alias("found")).union(missing.select("run_id", F.lit(False)))


_CONTEXT = f"WITH {O.TOP}, cx AS (SELECT query_id, string_agg('- ' || d.text, chr(10) ORDER BY rank) AS context FROM top JOIN documents d ON d.doc_id = top.vec_id GROUP BY query_id)"


def _contexts(s, d):
    e = C._t(s, d, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.contexts(retrieval.top_k(queries, e, 3), C._t(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"))


@_query(f"{_CONTEXT} SELECT vec_id, CASE WHEN vec_id % 40 = 0 THEN NULL ELSE md5(context) END AS context_md5 FROM embeddings LEFT JOIN cx ON cx.query_id = vec_id WHERE vec_id % 20 = 0")
def augmented_samples(s, d):
    """Samples with their contexts; one with an empty question stays as it is."""
    rows = C._t(s, d, "embeddings").where("vec_id % 20 = 0").select("vec_id", F.when(F.col("vec_id") % 40 == 0, " ").otherwise("what").alias("text"))
    return retrieval.augment(rows, _contexts(s, d), "vec_id").select("vec_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


def _spatial(s, d):
    """Map questions with ids as a benchmark has them; a fifth belongs to another subset."""
    subset = F.when(F.col("map_id") % 5 == 0, "spatialreal").otherwise("spatialmap")
    letter = F.get(F.array(*[F.lit(x) for x in "ABCD"]), F.pmod("map_id", F.lit(4)).cast("int"))
    return C._items(s, d).select(F.concat(subset, F.lit(".tqa."), F.col("map_id").cast("string"), F.lit("."), F.pmod("map_id", F.lit(2)).cast("string")).alias("id"), "text", letter.alias("oracle_option"), "map_id")


def _generate(prompts: list[str], options: dict) -> list[str]:
    """A stand-in for a model: both passes depend on the prompt's length alone."""
    return ["ABCD"[len(p) % 4] if "regex" in options else f"{len(p)} characters" for p in prompts]


def _score(prompts: list[str], choices: list[str]) -> list[float]:
    return [float((len(p) + len(c) * 3) % 7) for p, c in zip(prompts, choices, strict=True)]


def _task_docs(s, d) -> dict[str, DataFrame]:
    p = C._t(s, d, "part")
    science = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("Which is part "), F.col("p_partkey").cast("string"), F.lit("?")).alias("question"), F.col("p_name").alias("correct_answer"), F.col("p_brand").alias("distractor1"), F.col("p_type").alias("distractor2"), F.col("p_size").cast("string").alias("distractor3"))
    spatial, taught = _spatial(s, d), _chat_docs(s, d)
    flags = C._t(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("Is it a "), "event_type", F.lit("?")).alias("question"), F.when(F.col("event_type") == "view", "True").otherwise("False").alias("answer"))
    asked = C._t(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.concat(F.lit("What is like "), F.col("vec_id").cast("string"), F.lit("?")).alias("question"), F.get(F.array(*[F.lit(x) for x in "ABCD"]), F.pmod("vec_id", F.lit(4)).cast("int")).alias("answer"))
    asked = asked.withColumns({"text": F.col("question"), "oracle_option": F.col("answer")})
    given = asked.withColumn("context", F.concat(F.lit("label "), F.col("id").cast("string")))
    out = {t: spatial for t in TASKS if t.startswith("spatial_eval")}
    out |= {t: taught for t in TASKS if "finetuning" in t}
    out |= {t: science for t in TASKS if t.startswith("sciq")}
    return out | {"task_bool": flags, "task_rag": given, "task_rag_augmented": asked, "spatial_eval_gen_rag": asked}


def _answer(length: str) -> str:
    """The stand-in's letter after a prompt of so many characters."""
    return f"['A', 'B', 'C', 'D'][(({length}) + 1 + length(({length}) || ' characters') + 10) % 4 + 1]"


def _argmax(length: str, choices: list[str]) -> str:
    scores = "[" + ", ".join(f"({length} + length({c}) * 3) % 7" for c in choices) + "]"
    return f"list_position({scores}, list_max({scores})) - 1"


def _mcc(table: str) -> str:
    return f"""(WITH g AS (SELECT target AS x, count(*) AS n FROM {table} GROUP BY 1), p AS (SELECT pred AS x, count(*) AS n FROM {table} GROUP BY 1),
  v AS (SELECT (SELECT count(*) FROM {table})::DOUBLE AS s, (SELECT count(*) FROM {table} WHERE target = pred)::DOUBLE AS c, coalesce((SELECT sum(g.n * p.n) FROM g JOIN p USING (x)), 0)::DOUBLE AS tp, (SELECT sum(n * n) FROM g)::DOUBLE AS tt, (SELECT sum(n * n) FROM p)::DOUBLE AS pp)
  SELECT CASE WHEN (s * s - pp) * (s * s - tt) > 0 THEN (c * s - tp) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0.0 END FROM v)"""


_SHUFFLED = f"sh AS (WITH z AS ({O.SQL['choice_shuffle']}) SELECT * FROM z)"
_DOCS = f"""WITH RECURSIVE {O.ASKED},
first_of AS (SELECT map_id, arg_min(b, seq) AS b0, string_agg('Part ' || a || ' is to the ' || upper(dir[1]) || dir[2:] || ' of Part ' || b || '.', ' ' ORDER BY seq) AS body FROM r GROUP BY map_id),
it AS (SELECT n.map_id, length('Consider a map with multiple objects:' || chr(10) || 'Part ' || b0 || ' is in the map. ' || body || chr(10) || chr(10) || 'Please answer the following question. ' || {_ASK}) AS n,
    ['A', 'B', 'C', 'D'][map_id % 4 + 1] AS oracle FROM (SELECT map_id, lo, hi FROM ends) n JOIN first_of USING (map_id)),
{_SHUFFLED},
sc AS (SELECT p_partkey, length('Which is part ' || p_partkey || '?') AS n, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size, p_name FROM part),
ss AS (SELECT *, n + 24 + length(choice_a) + length(choice_b) + length(choice_c) + length(choice_d) AS m FROM sc JOIN sh USING (p_partkey)),
q1 AS (SELECT 3 AS target, {_argmax("(n + 8)", ["p_brand", "p_type", "p_size", "p_name"])} AS pred FROM sc),
q2 AS (SELECT correct_index AS target, {_argmax("m", ["choice_a", "choice_b", "choice_c", "choice_d"])} AS pred FROM ss),
q3 AS (SELECT ['A', 'B', 'C', 'D'][correct_index + 1] AS target, {_answer("m")} AS pred FROM ss),
q4 AS (SELECT map_id % 4 AS target, {_argmax("n", ["'A'"] * 4)} AS pred FROM it WHERE map_id % 5 <> 0),
q5 AS (SELECT oracle AS target, {_answer("n")} AS pred, map_id FROM it),
q6 AS (SELECT p AS target, {_answer("n")} AS pred FROM it JOIN said USING (map_id) WHERE map_id % 5 <> 0),
q7 AS (SELECT oracle AS target, {_answer("n + FEW")} AS pred FROM it WHERE map_id % 5 <> 0),
q8 AS (SELECT replace({_PART_CHAT}, ', ', ',') AS target, {_answer("length('Where is ' || p_name || '?')")} AS pred FROM part),
q9 AS (SELECT CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS target, {_argmax("(length('Is it a ' || event_type || '?') + 19)", ["'True'", "'False'"])} AS pred FROM events),
en AS (SELECT vec_id, 'What is like ' || vec_id || '?' AS q, ['A', 'B', 'C', 'D'][vec_id % 4 + 1] AS a FROM embeddings WHERE vec_id % 20 = 0),
{O.TOP}, cx AS (SELECT query_id, string_agg('- ' || d.text, chr(10) ORDER BY rank) AS context FROM top JOIN documents d ON d.doc_id = top.vec_id GROUP BY query_id),
qa AS (SELECT vec_id % 4 AS target, {_argmax("(length('Context: label ' || vec_id || chr(10) || chr(10) || 'Question: ' || q) + 9)", ["'A'"] * 4)} AS pred FROM en),
qb AS (SELECT vec_id % 4 AS target, {_argmax("(length('Context: ' || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || q) + 9)", ["'A'"] * 4)} AS pred FROM en LEFT JOIN cx ON query_id = vec_id),
qc AS (SELECT a AS target, {_answer("length('Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || q)")} AS pred FROM en LEFT JOIN cx ON query_id = vec_id)"""
_MEAN = lambda task, metric, test, table: f"SELECT '{task}' AS task, '{metric}' AS metric, CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS value, count(*) AS n FROM {table}"
_LOOSE = "list_contains(string_split(target, ','), pred) AND len(string_split(target, ',')) = 1"
_FEW = sum(len(s["text"]) + 1 + len("Answer: A") + 2 for s in TASKS["spatial_eval_gen_few_shot"]["fewshot_config"]["samples"]) + len("Answer: ")
_RESULTS = [
    _MEAN("sciq", "acc", "target = pred", "q1"),
    _MEAN("sciq_shuffled", "acc", "target = pred", "q2"),
    f"SELECT 'sciq_shuffled', 'mcc', {_mcc('q2')}, (SELECT count(*) FROM q2)",
    _MEAN("sciq_shuffled_gen", "acc_gen", "target = pred", "q3"),
    _MEAN("spatial_eval", "acc", "target = pred", "q4"),
    f"SELECT 'spatial_eval', 'mcc', {_mcc('q4')}, (SELECT count(*) FROM q4)",
    _MEAN("spatial_eval_gen", "acc_gen", "target = pred", "q5 WHERE map_id % 5 <> 0"),
    _MEAN("spatial_eval_gen_0", "loose_acc", "target = pred", "q5 WHERE map_id % 5 <> 0 AND map_id % 2 = 0"),
    _MEAN("spatial_eval_gen_all", "strict_acc", _LOOSE, "q6"),
    _MEAN("spatial_eval_gen_all", "loose_acc", _LOOSE, "q6"),
    _MEAN("spatial_eval_gen_cleaned", "strict_acc", "target = pred", "q5"),
    _MEAN("spatial_eval_gen_cleaned", "loose_acc", "target = pred", "q5"),
    _MEAN("spatial_eval_gen_few_shot", "acc_gen", "target = pred", "q7"),
    *[_MEAN(f"spatial_eval_gen_finetuning_data_{t}", "strict_acc", "target = pred", "q8") for t in ("test_0", "train_0", "test_all", "train_all")],
    _MEAN("spatial_eval_gen_finetuning_data_test_all", "loose_acc", "target = pred", "q8"),
    _MEAN("spatial_eval_gen_rag", "acc_gen", "target = pred", "qc"),
    _MEAN("task_bool", "acc", "target = pred", "q9"),
    _MEAN("task_rag", "acc", "target = pred", "qa"),
    _MEAN("task_rag_augmented", "acc", "target = pred", "qb"),
]


@_query(f"{_DOCS.replace('FEW', str(_FEW))} SELECT task, metric, round(value, 9) AS value, n FROM ({' UNION ALL '.join(_RESULTS)})")
def task_results(s, d):
    """Every task of the catalogue from its documents to its averaged metrics, with a stand-in for the model."""
    found = _contexts(s, d)
    tasks.register("process_docs_with_rag", process=lambda docs: retrieval.augment(docs, found, "id"))
    docs, out = _task_docs(s, d), None
    for name, task in TASKS.items():
        _, results = tasks.run(task, docs[name], generate=_generate, score=_score)
        out = results if out is None else out.union(results)
    return out.select("task", "metric", F.round("value", 9).alias("value"), "n")
