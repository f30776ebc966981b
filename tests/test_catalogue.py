import duckdb
import pytest

import __spark_entry__
from waymark.operators import runs

SF = "/root/testdata/sf0.001"


def both(spark, name):
    """The rows of a query and of its SQL, sorted."""
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(map(tuple, __spark_entry__.queries()[name](spark, SF).collect())), sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", ["rag_context", "error_top5", "metric_grid", "metric_matrix", "walk_scenarios", "which_questions", "question_parts", "report_lines", "task_results"])
def test_query_equals_its_sql(spark, name):
    got, want = both(spark, name)
    assert got and got == want


def test_contexts_are_whole(spark):
    got, _ = both(spark, "rag_context")
    assert max(n for _, n, _ in got) > 3 * 83


def test_errors_have_both_halves(spark):
    got, _ = both(spark, "error_top5")
    low = {p.removeprefix("Low accuracy on "): n for p, n, _ in got if p.startswith("Low accuracy on ")}
    poor = __spark_entry__.queries()["low_accuracy"](spark, SF).groupBy("task").count().collect()
    assert low and low == {r.task: r["count"] for r in poor}
    assert len(got) > len(low)


def test_grid_is_the_matrix_of_all_runs(spark):
    got, _ = both(spark, "metric_grid")
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert {r for _, _, r, _ in got} == {r.user_id for r in events.select("user_id").distinct().collect()}
    assert {m for m, *_ in got} == {"value"}
    rows = spark.createDataFrame([("r1", "acc", "t", 0.5), ("r2", "acc", "u", 0.25), ("r1", "none", "t", 0.0)], "run_id string, metric string, task string, value double")
    want = [(m, t, r, row[r]) for row in runs.matrix(rows).collect() for m, t in [(row.metric, row.task)] for r in ("r1", "r2")]
    assert sorted(map(tuple, runs.grid(rows).collect())) == sorted(want) and len(want) == 4


def test_halves_round_as_in_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT k AS event_id, r AS user_id, 'view' AS event_type, CASE WHEN k % 8 = 0 THEN [205.63, 408.51, 98.77, 314.61][r] ELSE 0.0::DOUBLE END AS value FROM range(8) t(k), range(1, 5) u(r)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("task_breakdown", "error_top5"):
        want = sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
        assert want and sorted(map(tuple, __spark_entry__.queries()[name](spark, str(tmp_path)).collect())) == want
