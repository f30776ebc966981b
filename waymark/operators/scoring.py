"""Answer extraction, per-row scores and metrics over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.parsing import strip

LAST_ANSWER = r"Answer:\s*([A-D](?:\s*,\s*[A-D])*)"
FIRST_ANSWER = r"Answer: ([A-D])"
BARE_LETTER = r"(?U)\b([A-D])\b"


def last_match(text: Column, pattern: str = LAST_ANSWER) -> Column:
    """The last match's first group, null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def first_match(text: Column, pattern: str = FIRST_ANSWER) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def extract_choice(text: Column) -> Column:
    """0..3 for A..D, or -1: a leading letter, else one after "answer", "choice" or "option", else any that stands alone."""
    t = strip(F.coalesce(text, F.lit("")))
    steps = [r"(?U)^\s*[(\[]?\s*([A-Da-d])[)\].:)]?\s", r"(?iU)(?:answer|choice|option)\s+(?:is\s+)?[(\[]?\s*([A-Da-d])[)\].:)]?", r"(?U)\b([A-Da-d])\b"]
    found = F.coalesce(*[F.nullif(F.regexp_extract(t, s, 1), F.lit("")) for s in steps])
    return F.coalesce(F.ascii(F.upper(found)) - 65, F.lit(-1))


def letter(index: Column) -> Column:
    return F.char(index + 65)


def _set(c: Column) -> Column:
    return F.array_distinct(F.split(c, "[,;| ]+"))


def strict(target: Column, prediction: Column) -> Column:
    """1.0 if the letters are the same set; an empty or null prediction scores 0."""
    same = F.array_sort(_set(target)) == F.array_sort(_set(prediction))
    return F.when((F.coalesce(prediction, F.lit("")) != "") & same, 1.0).otherwise(0.0)


def loose(target: Column, prediction: Column) -> Column:
    """1.0 if all letters of the target are predicted."""
    inside = F.size(F.array_except(_set(target), _set(prediction))) == 0
    return F.when((F.coalesce(prediction, F.lit("")) != "") & inside, 1.0).otherwise(0.0)


def first_letter(target: Column, prediction: Column) -> Column:
    """1.0 if the prediction's first character is the whole target, case aside."""
    return F.when(F.substring(F.upper(strip(prediction)), 1, 1) == F.upper(strip(target)), 1.0).otherwise(0.0)


def best_index(scores: Column) -> Column:
    """Where the first highest score stands, from 0."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def accuracy(correct: Column) -> Column:
    return F.coalesce(F.avg(correct.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """(label, n_gold, n_pred, n_both) over the labels of either column."""
    pairs = rows.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    side = F.array(F.struct(F.col("g").alias("label"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("c")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.lit(0).cast("long").alias("c")))
    return pairs.select(F.inline(side)).groupBy("label").agg(F.sum("a").alias("n_gold"), F.sum("b").alias("n_pred"), F.sum("c").alias("n_both"))


def macro_f1(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """macro_f1: the mean over labels of F1, 0 where undefined."""
    f1 = F.when(F.col("n_gold") + F.col("n_pred") > 0, 2 * F.col("n_both") / (F.col("n_gold") + F.col("n_pred"))).otherwise(0.0)
    return confusion(rows, gold, pred).agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"))


def mcc(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """mcc: the multiclass correlation coefficient, 0 where undefined."""
    c = confusion(rows, gold, pred).select(*[F.col(x).cast("double").alias(x) for x in ("n_gold", "n_pred", "n_both")])
    t = c.agg(F.sum("n_gold").alias("s"), F.sum("n_both").alias("c"), F.sum(F.col("n_gold") * F.col("n_pred")).alias("tp"), F.sum(F.col("n_gold") ** 2).alias("tt"), F.sum(F.col("n_pred") ** 2).alias("pp"))
    den = F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))
    return t.select(F.when(den > 0, (F.col("c") * F.col("s") - F.col("tp")) / den).otherwise(0.0).alias("mcc"))


def choice_shuffle(docs: DataFrame, key: str, choices: list[str], correct: str, seed: str = "42") -> DataFrame:
    """docs with choice_a..d in an order drawn for each row, and correct_index, the first place that holds the right answer."""
    slots = F.array(*[F.struct(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed), F.lit(str(k))).cast("binary")).alias("h"), F.col(c).alias("v")) for k, c in enumerate(choices)])
    rows = docs.withColumn("_c", F.transform(F.array_sort(slots), lambda s: s["v"]))
    out = rows.withColumns({f"choice_{x}": F.get("_c", F.lit(k)) for k, x in enumerate("abcd")})
    return out.withColumn("correct_index", (F.array_position("_c", F.col(correct)) - 1).cast("int")).drop("_c")


def first_n(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
