"""Columns that take a map question apart: objects, relations, question and options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directions and the axes they need.
AXES = {
    "Northeast": ("north", "east"),
    "Northwest": ("north", "west"),
    "Southeast": ("south", "east"),
    "Southwest": ("south", "west"),
    "North": ("north",),
    "South": ("south",),
    "East": ("east",),
    "West": ("west",),
}
DIAGONALS = ["Northeast", "Northwest", "Southeast", "Southwest"]
MARKER = "Please answer"
RELATION = r"(?i)([^.]+?) is to the (Northeast|Northwest|Southeast|Southwest) of ([^.]+?)\."
OPTION = r"(?U)\b([A-D])\.\s*([^\n]+)"
DIRECTION_ARGS = r"In which direction is ([^?]+?) relative to ([^?]+?)\?"
WHICH_ARGS = r"(?U)Which object is in the (\w+) of ([^?]+?)\?"
COUNT_ARGS = r"(?U)How many objects are in the (\w+) of ([^?]+?)\?"


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once: a lambda variable is never expanded again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "‘’“”", "''\"\"")


def passage(text: Column) -> Column:
    at = F.instr(text, MARKER)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)


def question(text: Column) -> Column:
    at = F.instr(text, MARKER)
    return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(F.lit(""))


def first_object(passage_: Column, glued: bool = False) -> Column:
    """The object declared with "is in the map"; glued also takes the header before it, across lines."""
    return strip(F.regexp_extract(passage_, ("([^.]+?)" if glued else r"([^\n.]+?)") + " is in the map", 1))


def relations(passage_: Column, strict_names: bool = False) -> Column:
    """All (a, dir, b) in order; dir in lower case. strict_names cuts a header off a name, up to its last newline."""
    part = [F.regexp_extract_all(passage_, F.lit(RELATION), F.lit(k)) for k in (1, 2, 3)]
    name = (lambda c: strip(F.regexp_replace(c, r"(?s)^.*\n", ""))) if strict_names else strip
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(part, "adb", strict=True)]), lambda r: F.struct(name(r["a"]).alias("a"), F.lower(r["d"]).alias("dir"), name(r["b"]).alias("b")))


def objects(first: Column, rels: Column) -> Column:
    own = F.when(first != "", F.array(first)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, F.transform(rels, lambda r: r["a"]), F.transform(rels, lambda r: r["b"])))


def question_type(q: Column) -> Column:
    """direction, which, count or unknown."""
    return F.when(F.contains(q, F.lit("In which direction is")), "direction").when(F.contains(q, F.lit("Which object is in the")), "which").when(F.contains(q, F.lit("How many objects are in the")), "count").otherwise("unknown")


def options(q: Column) -> Column:
    """(letter, value) by letter; of a letter given twice the last counts."""
    found = F.arrays_zip(F.regexp_extract_all(q, F.lit(OPTION), F.lit(1)).alias("k"), F.regexp_extract_all(q, F.lit(OPTION), F.lit(2)).alias("v"))
    value = lambda v: F.regexp_replace(strip(v), r"\.+$", "")
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    each = let(found, lambda z: F.transform(letters, lambda k: F.struct(k.alias("letter"), value(F.try_element_at(F.filter(z, lambda o: o["k"] == k), F.lit(-1))["v"]).alias("value"))))
    return F.filter(each, lambda o: o["value"].isNotNull())


def arguments(q: Column, kind: Column) -> Column:
    """The two arguments of the question as (first, second), null where it can't be parsed."""

    def of(pattern: str) -> Column:
        found = F.array(F.regexp_extract(q, pattern, 1), F.regexp_extract(q, pattern, 2))
        return F.when(F.regexp_like(q, F.lit(pattern)), F.struct(strip(found[0]).alias("first"), strip(found[1]).alias("second")))

    return F.when(kind == "direction", of(DIRECTION_ARGS)).when(kind == "which", of(WHICH_ARGS)).when(kind == "count", of(COUNT_ARGS))
