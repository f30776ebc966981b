import random

import pytest

from waymark.operators import generator, graph

# a line, a cycle with a node above it, a relation to itself, a direction without edges, branches that meet again
MAPS = {
    1: [("B", "northeast", "A"), ("C", "northeast", "B"), ("D", "southwest", "A")],
    2: [("A", "northeast", "B"), ("B", "northeast", "A"), ("C", "northwest", "A"), ("D", "southeast", "E")],
    3: [("A", "northeast", "A"), ("B", "southeast", "A"), ("C", "southeast", "B")],
    4: [("A", "north", "B"), ("C", "northwest", "D")],
    5: [("B", "northeast", "A"), ("C", "northeast", "A"), ("D", "northwest", "B"), ("D", "northwest", "C"), ("E", "southwest", "D"), ("F", "northeast", "E")],
    6: [("A", "north", "B")],
}


@pytest.fixture(scope="module")
def relations(spark):
    return spark.createDataFrame([(m, k + 1, *r) for m, rs in MAPS.items() for k, r in enumerate(rs)], "map_id long, seq long, a string, dir string, b string").cache()


def rows(df):
    return sorted(map(str, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", generator.KINDS)
def test_questions_in_rows_equal_those_by_joins(spark, relations, kind):
    got = generator.questions(relations, (kind,))
    assert "Join" not in plan(got) and "Exchange" not in plan(got)
    found = rows(got)
    assert found and found == rows(generator.questions(relations, (kind,), row_edges=0))


def test_narratives_and_samples_in_rows_equal_those_by_joins(spark, relations):
    got = generator.narratives(relations)
    assert "Join" not in plan(got) and "Exchange" not in plan(got)
    assert rows(got) == rows(generator.narratives(relations, row_edges=0)) and got.count() == len(MAPS)
    chats = generator.all_samples(relations, "S")
    assert "Join" not in plan(chats) and "Exchange" not in plan(chats)
    assert rows(chats) == rows(generator.all_samples(relations, "S", row_edges=2))


def test_narratives_in_batches_equal_those_by_columns(spark):
    """Random maps, some with cycles, words that are no direction, and names that sort around the marks between them."""
    rng = random.Random(3)
    names = ["A", "A b", "A!", "AB", "a", "É", "{", "50%", "%s"]
    rows_ = []
    for m in range(150):
        some = rng.sample(names, rng.randint(2, 9))
        dirs = ["northeast", "northwest", "southeast", "southwest", "north", "west"] + (["above"] if m % 10 == 0 else [])
        rows_ += [(m, k + 1, rng.choice(some), rng.choice(dirs), rng.choice(some)) for k in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows_, "map_id long, seq long, a string, dir string, b string")
    maps, large = graph.by_map(df)
    got = generator._row_narratives(maps)
    assert large is None and "MapInArrow" in plan(got) and "Exchange" not in plan(got)
    assert rows(got) == rows(generator._column_narratives(maps)) and got.count() == 150


def test_states_in_rows_equal_those_by_joins(spark, relations):
    nodes = generator.mentioned(relations).withColumnRenamed("entity", "node").union(spark.createDataFrame([(1, "Z"), (7, "A"), (7, "B")], "map_id long, node string"))
    got = graph.map_states(nodes, relations)
    assert "Join" not in plan(got)
    assert rows(got) == rows(graph.states(nodes, graph.closure(graph.axis_edges(relations)))) and got.count() == 14


def test_map_with_many_nodes(spark):
    """More nodes than a long has bits, so it goes by joins."""
    df = spark.createDataFrame([(1, k + 1, f"N{k + 1:03}", "northeast", "N000") for k in range(70)] + [(2, 1, "B", "southeast", "A")], "map_id long, seq long, a string, dir string, b string")
    nodes = generator.mentioned(df).withColumnRenamed("entity", "node")
    got = {(r.map_id, r.axis): r.state for r in graph.map_states(nodes, df).collect()}
    assert got == {(1, a): "N000 < {" + ", ".join(f"N{k:03}" for k in range(1, 71)) + "}" for a in "xy"} | {(2, "x"): "A < B", (2, "y"): "B < A"}
    assert {(r.map_id, r.kind) for r in generator.questions(df, ("count",)).collect()} == {(1, "count"), (2, "count")}
