"""Question generation over maps: pairs by ambiguity, options, reasoning narratives, training samples and random-walk scenarios.

Every choice is drawn by md5 of a map's key and a seed, so a rerun, another
engine and another number of executors draw the same.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.parsing import AXES, let
from waymark.operators import graph, narration, worlds

# The inequalities that a direction from (x, y) stands for.
LOGIC = {"North": ("=", ">"), "South": ("=", "<"), "East": (">", "="), "West": ("<", "="), "Northeast": (">", ">"), "Northwest": ("<", ">"), "Southeast": (">", "<"), "Southwest": ("<", "<")}
# The directions that options are drawn from, and the option letters.
DIRECTIONS = ["North", "South", "East", "West", "Northeast", "Northwest", "Southeast", "Southwest"]
LETTERS = "ABCD"


def logic(direction: Column, x: Column, y: Column) -> Column:
    """The inequalities of a direction from the point (x, y) as text; "Unknown logic" for any other word."""
    out = None
    for d, (ox, oy) in LOGIC.items():
        text = F.concat(F.lit(f"x {ox} "), x.cast("string"), F.lit(f", y {oy} "), y.cast("string"))
        out = F.when(direction == d, text) if out is None else out.when(direction == d, text)
    return out.otherwise("Unknown logic")


def component(direction: Column, axis: str) -> Column:
    """The side of a direction on axis x (East, West) or y (North, South), null for none."""
    names = ("East", "West") if axis == "x" else ("North", "South")
    out = F.lit(None).cast("string")
    for name in names:
        out = F.when(direction.isin(*[d for d, axes in AXES.items() if name.lower() in axes]), name).otherwise(out)
    return out


def mentioned(relations: DataFrame) -> DataFrame:
    """(map_id, entity) of every name that a relation has."""
    return relations.select("map_id", F.explode(F.array("a", "b")).alias("entity")).distinct()


def ambiguous_pairs(relations: DataFrame, closed: DataFrame, seed: str = "1") -> DataFrame:
    """(map_id, answers, target, ref, x_rel, y_rel): of the pairs of a map with 1, 2 and 4 possible directions one each, where there is one.

    A pair has 1 where both axes are known, 2 where one is, 4 where none is.
    """
    e = mentioned(relations)
    pairs = e.alias("a").join(e.alias("b"), (F.col("a.map_id") == F.col("b.map_id")) & (F.col("a.entity") < F.col("b.entity")))
    pairs = pairs.select("a.map_id", F.col("a.entity").alias("a"), F.col("b.entity").alias("b"))
    known = graph.axis_relations(pairs, closed)
    n = (F.col("x_rel") != "unknown").cast("int") + (F.col("y_rel") != "unknown").cast("int")
    known = known.withColumn("answers", F.element_at(F.array(F.lit(4), F.lit(2), F.lit(1)), n + 1))
    order = Window.partitionBy("map_id", "answers").orderBy(worlds.by_md5("map_id", "a", "b", seed), "a", "b")
    first = known.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return first.select("map_id", "answers", F.col("a").alias("target"), F.col("b").alias("ref"), "x_rel", "y_rel")


def row_pairs(nodes: Column, c: Column, key: Column, seed: str = "1") -> Column:
    """ambiguous_pairs of one map's row (graph.by_map, graph.row_closures) as an array of structs."""
    rel = lambda m, i, j: F.when(graph.has(F.get(m, i), j), "gt").when(graph.has(F.get(m, j), i), "lt").otherwise("unknown")

    def pair(i: Column, j: Column) -> Column:
        known = F.struct(F.get(nodes, i).alias("a"), F.get(nodes, j).alias("b"), rel(c["x"], i, j).alias("x_rel"), rel(c["y"], i, j).alias("y_rel"))
        n = lambda k: F.when((k["x_rel"] != "unknown") & (k["y_rel"] != "unknown"), 1).when((k["x_rel"] != "unknown") | (k["y_rel"] != "unknown"), 2).otherwise(4)
        return let(known, lambda k: F.struct(n(k).alias("answers"), worlds.by_md5(key, k["a"], k["b"], seed).alias("h"), k["a"].alias("target"), k["b"].alias("ref"), k["x_rel"].alias("x_rel"), k["y_rel"].alias("y_rel")))

    every = F.sequence(F.lit(0), F.size(nodes) - 1)
    pairs = F.flatten(F.transform(every, lambda i: F.transform(F.filter(every, lambda j: j > i), lambda j: pair(i, j))))
    least = lambda p, n: F.array_min(F.filter(p, lambda x: x["answers"] == n))
    first = let(pairs, lambda p: F.array(*[least(p, n) for n in (1, 2, 4)]))
    return F.filter(first, lambda x: x.isNotNull())


def possible_directions(x_rel: Column, y_rel: Column) -> Column:
    """The diagonals that the known axes leave open, north before south and east before west."""
    each = [F.when(~(y_rel == ("lt" if d.startswith("North") else "gt")) & ~(x_rel == ("lt" if d.endswith("east") else "gt")), F.lit(d)) for d in ("Northeast", "Northwest", "Southeast", "Southwest")]
    return F.filter(F.array(*each), lambda d: d.isNotNull())


def option_text(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat(o["letter"], F.lit(". "), o["value"])), ", ")


def answer_letters(options: Column) -> Column:
    return F.array_join(F.transform(F.filter(options, lambda o: o["correct"]), lambda o: o["letter"]), ", ")


#: What questions of any kind are made from; those a kind lacks are null.
_PARTS = {"target": "string", "ref": "string", "x_rel": "string", "y_rel": "string", "dir": "string", "inside": "array<string>", "outside": "array<string>", "x_in": "array<string>", "y_in": "array<string>", "n": "int"}


def _finished(rows: DataFrame, seed: str = "1") -> DataFrame:
    """(map_id, kind, answers, question, options, answer, deduction) of rows (map_id, kind, answers, some of _PARTS); columns sentences and steps are kept."""
    told = [c for c in ("sentences", "steps") if c in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in _PARTS.items() if c not in rows.columns})
    kind, t, r = F.col("kind"), F.col("target"), F.col("ref")
    direction, count = kind == "direction", kind == "count"
    key = F.concat_ws("|", F.col("map_id").cast("string"), "target", "ref", "dir")
    drawn = F.slice(worlds.drawn(F.col("inside"), key, seed), F.lit(1), F.col("answers"))
    rows = rows.withColumns({"dirs": F.when(direction, possible_directions(F.col("x_rel"), F.col("y_rel"))), "right": F.when(kind == "which", drawn), "x_dir": component(F.col("dir"), "x"), "y_dir": component(F.col("dir"), "y")})
    options = F.when(direction, worlds.options_for(F.col("dirs"), F.array(*[F.lit(d) for d in DIRECTIONS]), key))
    options = options.when(count, worlds.count_options(F.size("inside"), F.col("n"), key)).otherwise(worlds.options_for(F.col("right"), F.col("outside"), key))
    question = F.when(direction, F.format_string("In which direction is the %s relative to the %s?", t, r)).when(count, F.format_string("How many objects are in the %s of the %s?", "dir", r)).otherwise(F.format_string("Which object is in the %s of the %s?", "dir", r))
    rows = rows.withColumns({"options": options, "question": question, "deduction": F.when(direction, _direction_deduction()).otherwise(deduction(F.when(count, _count_end()).otherwise(_which_end())))})
    return rows.select("map_id", "kind", "answers", "question", option_text(F.col("options")).alias("options"), answer_letters(F.col("options")).alias("answer"), "deduction", *told)


def _direction_deduction() -> Column:
    t, r = F.col("target"), F.col("ref")

    def side(rel: str, axis: str, up: str, down: str) -> Column:
        sure = lambda d: F.format_string(f"The %s is strictly to the {d} of the %s.", t, r)
        open_ = F.format_string(f"The exact {axis}-axis relationship between the %s and the %s cannot be determined (could be {up} or {down}).", t, r)
        return F.when(F.col(rel) == "gt", sure(up)).when(F.col(rel) == "lt", sure(down)).otherwise(open_)

    conclusion = (
        F.when(F.col("answers") == 1, F.format_string("The %s is to the %s of the %s.", t, F.get("dirs", F.lit(0)), r))
        .when(F.col("answers") == 2, F.format_string("Due to partial information, the %s could be to the %s of the %s.", t, F.array_join("dirs", " or "), r))
        .otherwise(F.format_string("The spatial relationship is completely undetermined. The %s could be to the Northeast, Northwest, Southeast, or Southwest of the %s.", t, r))
    )
    lines = [F.concat(F.lit("**Target**: "), t), F.concat(F.lit("**Reference**: "), r), F.concat(F.lit("**X-Axis Analysis**: "), side("x_rel", "X", "East", "West")), F.concat(F.lit("**Y-Axis Analysis**: "), side("y_rel", "Y", "North", "South")), F.concat(F.lit("**Conclusion**: "), conclusion)]
    return F.concat_ws("\n", *lines)


def _count_end() -> Column:
    size = F.size("inside")
    said = F.when(size == 0, "There are no objects").when(size == 1, "There is 1 object").otherwise(F.format_string("There are %d objects", size))
    return F.concat(F.lit("**Count**: "), size.cast("string"), F.format_string("\n**Conclusion**: %s in the %s of the %s.", said, "dir", "ref"))


def _which_end() -> Column:
    the = F.transform("right", lambda e: F.concat(F.lit("the "), e))
    named = (
        F.when(F.size("right") == 1, F.concat(F.get(the, F.lit(0)), F.lit(" is")))
        .when(F.size("right") == 2, F.concat(F.array_join(the, " and "), F.lit(" are")))
        .otherwise(F.concat(F.array_join(F.slice(the, F.lit(1), F.size("right") - 1), ", "), F.lit(", and "), F.element_at(the, -1), F.lit(" are")))
    )
    return F.format_string("**Conclusion**: Among the given options, %s in the %s of the %s.", named, "dir", "ref")


def direction_questions(picked: DataFrame) -> DataFrame:
    """(map_id, kind, answers, question, options, answer, deduction) on the pairs of ambiguous_pairs."""
    return _finished(picked.withColumn("kind", F.lit("direction")))


def row_sides(nodes: Column, c: Column, key: Column, wanted: tuple[int, ...] | None, seed: str = "1") -> Column:
    """Of the entities and directions of one map's row those that a question is on, structs (answers, ref, dir, inside, outside, x_in, y_in, n): without wanted the first by md5 of all, else for each number the first that has as many inside and 4 less that many outside."""
    every = F.sequence(F.lit(0), F.size(nodes) - 1)
    none = F.lit(0).cast("long")

    def of(i: Column) -> Column:
        down = lambda m: F.get(m, i).bitwiseAND(F.bitwise_not(graph.bit(i)))
        up = lambda m: F.aggregate(every, none, lambda acc, j: F.when((j != i) & graph.has(F.get(m, j), i), acc.bitwiseOR(graph.bit(j))).otherwise(acc))
        return F.struct(up(c["x"]).alias("east"), down(c["x"]).alias("west"), up(c["y"]).alias("north"), down(c["y"]).alias("south"))

    def inside(s: Column, d: str) -> Column:
        a = AXES[d]
        return s[a[0]] if len(a) == 1 else s[a[0]].bitwiseAND(s[a[1]])

    def ranked(i: Column) -> Column:
        return let(of(i), lambda s: F.array(*[F.struct(worlds.by_md5(key, F.get(nodes, i), F.lit(d), seed).alias("h"), F.get(nodes, i).alias("ref"), F.lit(d).alias("dir"), i.alias("i"), inside(s, d).alias("in"), s.alias("s")) for d in DIRECTIONS]))

    def fitting(all_: Column, k: int) -> Column:
        n = lambda x: F.bit_count(x["in"])
        return F.filter(all_, lambda x: (n(x) >= k) & (F.size(nodes) - 1 - n(x) >= 4 - k))

    def told(x: Column, k: int) -> Column:
        names = lambda mask: F.filter(nodes, lambda e, j: graph.has(mask, j))
        side = lambda axis: functools.reduce(lambda out, w: F.when(component(x["dir"], axis) == w, names(x["s"][w.lower()])).otherwise(out), ("East", "West") if axis == "x" else ("North", "South"), F.lit(None).cast("array<string>"))
        out = F.filter(nodes, lambda e, j: ~graph.has(x["in"], j) & (j != x["i"]))
        return F.when(x.isNotNull(), F.struct(F.lit(k).alias("answers"), x["ref"].alias("ref"), x["dir"].alias("dir"), names(x["in"]).alias("inside"), out.alias("outside"), side("x").alias("x_in"), side("y").alias("y_in"), F.size(nodes).alias("n")))

    def first(all_: Column) -> Column:
        one = lambda some, k: let(F.array_min(some), lambda x: told(x, k))
        return F.array(one(all_, 1)) if wanted is None else F.array(*[one(fitting(all_, k), k) for k in wanted])

    return F.filter(let(F.flatten(F.transform(every, ranked)), first), lambda x: x.isNotNull())


def _sides(relations: DataFrame, closed: DataFrame) -> DataFrame:
    """(map_id, ref, dir, inside, outside, n): for each mentioned entity and each of the eight directions the entities in it and the others, sorted."""
    every = mentioned(relations).groupBy("map_id").agg(F.array_sort(F.collect_list("entity")).alias("every"))
    found = graph.in_directions(closed).groupBy("map_id", "ref", "dir").agg(F.array_sort(F.collect_list("obj")).alias("inside"))
    rows = every.select("map_id", "every", F.explode("every").alias("ref")).select("map_id", "every", "ref", F.explode(F.array(*[F.lit(d) for d in DIRECTIONS])).alias("dir"))
    rows = rows.join(found, ["map_id", "ref", "dir"], "left").withColumn("inside", F.coalesce("inside", F.array().cast("array<string>")))
    return rows.select("map_id", "ref", "dir", "inside", F.array_except("every", F.array_append("inside", F.col("ref"))).alias("outside"), F.size("every").alias("n"))


def _with_axes(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """rows (map_id, ref, dir, inside, …) with x_in and y_in, the entities on the direction's own side of each axis."""
    for axis in ("x", "y"):
        one = sides.select("map_id", "ref", F.col("dir").alias(f"{axis}_dir"), F.col("inside").alias(f"{axis}_in"))
        rows = rows.withColumn(f"{axis}_dir", component(F.col("dir"), axis)).join(one, ["map_id", "ref", f"{axis}_dir"], "left")
    return rows


def deduction(last: Column) -> Column:
    """The final reasoning about rows of _with_axes: the entities on each axis the direction has, those on both, and last."""
    ref, listed = F.col("ref"), lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("None")

    def axis(a: str, up: str) -> Column:
        name, inside = F.col(f"{a}_dir"), F.col(f"{a}_in")
        order = F.when(name == up, F.concat(ref, F.lit(" < Entity"))).otherwise(F.concat(F.lit("Entity < "), ref))
        text = F.format_string(f"**{a.upper()}-Axis Analysis**: Entities to the %s of the %s (%s on {a.upper()}-axis): %s", name, ref, order, listed(inside))
        return F.when(name.isNotNull(), text)

    both = F.when(F.col("x_dir").isNotNull() & F.col("y_dir").isNotNull(), F.format_string("**Entities in %s (intersection)**: %s", F.col("dir"), listed(F.col("inside"))))
    return F.concat_ws("\n", F.concat(F.lit("**Reference**: "), ref), F.concat(F.lit("**Direction Query**: "), F.col("dir")), axis("x", "East"), axis("y", "North"), both, last)


def count_questions(relations: DataFrame, closed: DataFrame, seed: str = "1") -> DataFrame:
    """One question a map on how many objects lie in a drawn direction of a drawn entity, columns as direction_questions."""
    sides = _sides(relations, closed)
    order = Window.partitionBy("map_id").orderBy(worlds.by_md5("map_id", "ref", "dir", seed), "ref", "dir")
    picked = _with_axes(sides.withColumn("_r", F.row_number().over(order)).where("_r = 1"), sides)
    return _finished(picked.withColumns({"kind": F.lit("count"), "answers": F.lit(1)}))


def which_questions(relations: DataFrame, closed: DataFrame, wanted: tuple[int, ...] = (1, 2), seed: str = "1") -> DataFrame:
    """For each number of right options a question a map on which entities lie in a direction, where some direction has as many and 4 less that many others."""
    sides = _sides(relations, closed)
    rows = sides.withColumn("answers", F.explode(F.array(*[F.lit(k) for k in wanted])))
    rows = rows.where((F.size("inside") >= F.col("answers")) & (F.size("outside") >= 4 - F.col("answers")))
    order = Window.partitionBy("map_id", "answers").orderBy(worlds.by_md5("map_id", "ref", "dir", seed), "ref", "dir")
    picked = _with_axes(rows.withColumn("_r", F.row_number().over(order)).where("_r = 1"), sides)
    return _finished(picked.withColumn("kind", F.lit("which")), seed)


#: The kinds of questions, in the order of their rows.
KINDS = ("direction", "count", "which")


def _row_questions(rows: DataFrame, kinds: tuple[str, ...], wanted: tuple[int, ...], seed: str) -> DataFrame:
    """The questions of the kinds on rows of graph.by_map, in one pass; columns sentences and steps are kept."""
    told = [c for c in ("sentences", "steps") if c in rows.columns]
    c, nodes, key = F.col("c"), F.col("nodes"), F.col("map_id").cast("string")
    rows = rows.select("map_id", "nodes", *told, graph.row_closures(nodes, F.col("rels")).alias("c"))
    find = {"direction": lambda: row_pairs(nodes, c, key, seed), "count": lambda: row_sides(nodes, c, key, None, seed), "which": lambda: row_sides(nodes, c, key, wanted, seed)}
    have = {"direction": ("target", "ref", "x_rel", "y_rel"), "count": ("ref", "dir", "inside", "n", "x_in", "y_in"), "which": ("ref", "dir", "inside", "outside", "x_in", "y_in")}
    part = lambda k, q: F.struct(F.lit(k).alias("kind"), q["answers"].alias("answers"), *[(q[p] if p in have[k] else F.lit(None)).cast(t).alias(p) for p, t in _PARTS.items()])
    of = lambda k: F.transform(find[k](), lambda q: part(k, q))
    return _finished(rows.select("map_id", *told, F.inline(F.concat(*[of(k) for k in kinds]))), seed)


def _join_questions(relations: DataFrame, kinds: tuple[str, ...], wanted: tuple[int, ...], seed: str) -> list[DataFrame]:
    """The same by joins, for maps too large for a row."""
    closed = graph.closure(graph.axis_edges(relations))
    make = {
        "direction": lambda: direction_questions(ambiguous_pairs(relations, closed, seed)),
        "count": lambda: count_questions(relations, closed, seed),
        "which": lambda: which_questions(relations, closed, wanted, seed),
    }
    return [make[k]() for k in kinds]


def questions(relations: DataFrame, kinds: tuple[str, ...] = KINDS, wanted: tuple[int, ...] = (1, 2), seed: str = "1", row_edges: int = graph.ROW_EDGES) -> DataFrame:
    """(map_id, kind, answers, question, options, answer, deduction) of the kinds: each map is read as one row, without joins; maps too large for a row go by joins."""
    rows, large = graph.by_map(relations, row_edges=row_edges)
    out = _row_questions(rows, kinds, wanted, seed)
    if large is not None:
        out = functools.reduce(DataFrame.union, _join_questions(relations.join(large, "map_id", "left_semi"), kinds, wanted, seed), out)
    return out


def step_states(relations: DataFrame) -> DataFrame:
    """(map_id, step, axis, state): the order as text after each sentence, of the entities met so far.

    Each prefix of a map's sentences is a map of its own, so all steps of all
    maps are closed and reduced together.
    """
    steps = relations.select("map_id", F.col("seq").alias("step"))
    prefix = steps.join(relations, "map_id").where("seq <= step").select(F.struct("map_id", "step").alias("map_id"), "seq", "a", "dir", "b")
    nodes = mentioned(prefix).withColumnRenamed("entity", "node")
    found = graph.states(nodes, graph.closure(graph.axis_edges(prefix)))
    return found.select("map_id.map_id", "map_id.step", "axis", "state")


def _initial(names: Column) -> Column:
    return F.concat(F.lit("### Initialization\n**Entities Detected**: "), names, F.lit("\n**Initial X-State**: "), names, F.lit("\n**Initial Y-State**: "), names, F.lit("\n"))


def _step(seq: Column, a: Column, direction: Column, b: Column, x: Column, y: Column) -> Column:
    less = lambda up: F.when(up, F.concat(b, F.lit(" < "), a)).otherwise(F.concat(a, F.lit(" < "), b))
    return F.format_string(
        '### Step %d\n**Sentence**: "%s"\n**X-Extraction**: %s\n**Y-Extraction**: %s\n**X-State**: %s\n**Y-State**: %s\n',
        seq, worlds.sentence(a, direction, b, articles=True), less(direction.endswith("east")), less(direction.startswith("north")), x, y,
    )


def _row_narratives(rows: DataFrame) -> DataFrame:
    """rows of graph.by_map with sentences, and steps, the text of narratives; maps with other directions than the eight or without names are told by columns."""
    plain = F.forall(F.col("rels"), lambda r: F.coalesce(r["dir"].isin(*narration.SAID) & r["a"].isNotNull() & r["b"].isNotNull(), F.lit(False)))
    return narration.told(rows.where(plain)).union(_column_narratives(rows.where(~plain)))


def _column_narratives(rows: DataFrame) -> DataFrame:
    """The same by columns: a relation is added to the closure at each step."""
    nodes, rels = F.col("nodes"), F.col("rels")
    states = F.transform(graph.row_closures(nodes, rels, steps=True), lambda c: F.struct(*[graph.row_state(nodes, c[axis], c["seen"]).alias(axis) for axis in "xy"]))
    steps = F.zip_with(rels, states, lambda r, s: _step(r["seq"], r["a"], r["dir"], r["b"], s["x"], s["y"]))
    text = F.array_join(F.concat(F.array(_initial(F.array_join(nodes, ", "))), steps), "\n\n")
    return rows.withColumns({"sentences": F.array_join(F.transform(rels, lambda r: worlds.sentence(r["a"], r["dir"], r["b"], articles=True)), " "), "steps": text})


def narratives(relations: DataFrame, row_edges: int = graph.ROW_EDGES) -> DataFrame:
    """(map_id, text): the start and a step a sentence, with what it says of each axis and the order it leaves; maps too large for a row go by joins."""
    rows, large = graph.by_map(relations, row_edges=row_edges)
    out = _row_narratives(rows).select("map_id", F.col("steps").alias("text"))
    return out if large is None else out.union(_join_narratives(relations.join(large, "map_id", "left_semi")))


def _join_narratives(relations: DataFrame) -> DataFrame:
    names = mentioned(relations).groupBy("map_id").agg(F.array_join(F.array_sort(F.collect_list("entity")), ", ").alias("names"))
    states = step_states(relations)
    of = lambda axis: states.where(F.col("axis") == axis).select("map_id", F.col("step").alias("seq"), F.col("state").alias(axis))
    rows = relations.join(of("x"), ["map_id", "seq"]).join(of("y"), ["map_id", "seq"])
    step = _step(*[F.col(c) for c in ("seq", "a", "dir", "b", "x", "y")])
    told = rows.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("seq", step.alias("t")))).alias("s"))
    return told.join(names, "map_id").select("map_id", F.array_join(F.concat(F.array(_initial(F.col("names"))), F.transform("s", lambda x: x["t"])), "\n\n").alias("text"))


def samples(relations: DataFrame, questions: DataFrame, system: str) -> DataFrame:
    """(map_id, kind, answers, messages): chat samples of the questions, with sentences, narrative, deduction and answer."""
    told = relations.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("seq", worlds.sentence(F.col("a"), F.col("dir"), F.col("b"), articles=True).alias("t")))).alias("s"))
    told = told.select("map_id", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("sentences"))
    return _chats(questions.join(told, "map_id").join(narratives(relations).withColumnRenamed("text", "steps"), "map_id"), system)


def all_samples(relations: DataFrame, system: str, wanted: tuple[int, ...] = (1, 2), seed: str = "1", row_edges: int = graph.ROW_EDGES) -> DataFrame:
    """samples of all questions of the maps: each map's narrative and questions are made in its row, without joins."""
    rows, large = graph.by_map(relations, row_edges=row_edges)
    out = _chats(_row_questions(_row_narratives(rows), KINDS, wanted, seed), system)
    if large is not None:
        some = relations.join(large, "map_id", "left_semi")
        out = out.union(samples(some, functools.reduce(DataFrame.union, _join_questions(some, KINDS, wanted, seed)), system))
    return out


def _chats(rows: DataFrame, system: str) -> DataFrame:
    user = F.concat(F.lit("Consider a map with multiple locations:\n\n"), F.col("sentences"), F.lit("\n\nQuestion: "), "question", F.lit(" Available options: "), "options")
    said = F.concat(F.lit("<think>\n"), "steps", F.lit("\n\n### Final Deduction\n"), "deduction", F.lit("\n\n</think>\nAnswer: "), "answer")
    turns = F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("system", F.lit(system)), ("user", user), ("assistant", said))])
    return rows.select("map_id", "kind", "answers", turns.alias("messages"))


def scenarios(moves: DataFrame, seed: str = "1") -> DataFrame:
    """Random-walk samples of moves (walk_id, step, place, dx, dy), steps from 1, whose first place is the origin.

    Each place is described from the one before it and from up to three drawn
    earlier ones that it doesn't coincide with. Walks that end where they began
    have no answer and are left out; over-generate instead of trying again.
    Returns (walk_id, user, reasoning, coordinates map<string, array<long>>, answer).
    """
    at = Window.partitionBy("walk_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    rows = moves.withColumns({"x": F.sum(F.when(F.col("step") > 1, F.col("dx")).otherwise(zero)).over(at), "y": F.sum(F.when(F.col("step") > 1, F.col("dy")).otherwise(zero)).over(at)})
    rows = rows.groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("step", "place", "x", "y"))).alias("p")).where(F.size("p") > 1)
    key = F.col("walk_id").cast("string")
    point = lambda s: F.concat(F.lit("("), s["x"].cast("string"), F.lit(", "), s["y"].cast("string"), F.lit(")"))
    toward = lambda a, b: worlds.direction(b["x"] - a["x"], b["y"] - a["y"])

    def located(s: Column, i: Column) -> Column:
        """A place with the places it is described from: the last one, then drawn ancestors in drawn order."""
        older = F.slice(F.col("p"), F.lit(1), F.greatest(i - 1, F.lit(0)))
        extra = worlds.draw(F.least(F.lit(3), i - 1) + 1, key, s["step"], seed)
        ranked = F.array_sort(F.transform(older, lambda o: F.struct(worlds.by_md5(key, s["step"], o["step"], seed).alias("h"), o.alias("o"))))
        chosen = F.transform(F.slice(ranked, F.lit(1), F.when(i > 1, extra.cast("int")).otherwise(F.lit(0))), lambda r: r["o"])
        refs = F.when(i > 0, F.concat(F.slice(F.col("p"), i, F.lit(1)), chosen)).otherwise(F.slice(F.col("p"), F.lit(1), F.lit(0)))
        said = F.transform(refs, lambda o: F.struct(o["place"].alias("place"), point(o).alias("at"), toward(o, s).alias("dir"), o["x"].alias("x"), o["y"].alias("y")))
        return F.struct(s["step"].alias("step"), s["place"].alias("place"), point(s).alias("at"), F.filter(said, lambda r: r["dir"].isNotNull()).alias("refs"))

    rows = rows.withColumn("s", F.transform("p", located))
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)
    rows = rows.withColumn("home", toward(first, last)).where("home is not null")
    why = lambda r: logic(r["dir"], r["x"], r["y"])

    def told(s: Column) -> Column:
        n = F.size(s["refs"])
        each = F.transform(s["refs"], lambda r, k: F.concat(F.lit("- Relation"), F.when(n > 1, F.concat(F.lit(" "), (k + 1).cast("string"))).otherwise(""), F.lit(": "), r["dir"], F.lit(' of "'), r["place"], F.lit('" '), r["at"], F.lit(" -> implies "), why(r), F.lit(".")))
        all_ = F.when(n > 1, F.array(F.concat(F.lit("- Intersection: "), F.array_join(F.transform(s["refs"], why), " AND "), F.lit(".")))).otherwise(F.array().cast("array<string>"))
        head = F.format_string('Step %d: Locate "%s"', s["step"], s["place"])
        origin = F.array(F.lit("Step 1: Reference Point"), F.concat(F.lit('- Entity: "'), s["place"], F.lit('"')), F.concat(F.lit("- Assignment: Set as origin "), s["at"], F.lit(".")))
        return F.when(s["step"] == 1, origin).otherwise(F.concat(F.array(head), each, all_, F.array(F.concat(F.lit("- Assignment: Set to "), s["at"], F.lit(".")))))

    change = lambda c, axis: F.when(c > 0, F.concat(F.lit(f"{axis} increases (0->"), c.cast("string"), F.lit(")"))).when(c < 0, F.concat(F.lit(f"{axis} decreases (0->"), c.cast("string"), F.lit(")"))).otherwise(f"{axis} stays same")
    check = F.array(
        F.format_string("Step %d: Final Check", F.size("p") + 1),
        F.concat(F.lit('- Target: Direction of "'), last["place"], F.lit('" '), point(last), F.lit(' from "'), first["place"], F.lit('" '), point(first), F.lit(".")),
        F.concat(F.lit("- Calculation: "), change(last["x"], "x"), F.lit(", "), change(last["y"], "y"), F.lit(".")),
        F.concat(F.lit("- Result: "), F.col("home"), F.lit(".")),
    )
    reasoning = F.array_join(F.concat(F.flatten(F.transform("s", told)), check), "\n\n")
    sentences = F.flatten(F.transform("s", lambda s: F.transform(s["refs"], lambda r: worlds.sentence(s["place"], r["dir"], r["place"]))))
    # diagonals stand as they are; another answer takes the first slot
    diagonal = F.col("home").isin("Northeast", "Northwest", "Southwest", "Southeast")
    options = F.array(F.when(diagonal, "Northeast").otherwise(F.col("home")), F.lit("Northwest"), F.lit("Southwest"), F.lit("Southeast"))
    user = F.concat(
        F.lit("Consider a map with multiple objects:\n\n"), F.array_join(worlds.drawn(sentences, key, seed), " "),
        F.lit("\n\nPlease answer the following multiple-choice question based on the provided information. In which direction is "), last["place"], F.lit(" relative to "), first["place"],
        F.lit("? Available options:\n\n"), F.array_join(F.transform(options, lambda o, k: F.concat(F.char(k + 65), F.lit(". "), o)), "\n\n"), F.lit("."),
    )
    coordinates = F.map_from_entries(F.transform("p", lambda s: F.struct(s["place"], F.array(s["x"], s["y"]))))
    return rows.select("walk_id", user.alias("user"), reasoning.alias("reasoning"), coordinates.alias("coordinates"), F.char(let(options, lambda o: F.array_position(o, F.col("home"))) + 64).alias("answer"))
