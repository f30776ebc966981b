"""Quality rules with adaptive thresholds from mergeable quantile sketches; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.tables import stored

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Measures that are compared with a threshold, and the least step of each in a document: so many words or lines of it.
STEPS = {"symbol_share": (1, "n_words"), "shout_share": (1, "n_words"), "repeat_share": (8, "n_words"), "line_share": (1, "n_lines"), "word_length": (0, "n_words"), "mark_share": (1, "n_words")}
#: A threshold is the median and so many times the distance from it to the 75th percentile, or so many steps of the median document if that is more.
SPREADS, LEAST_STEPS = 8, 3
#: A group's threshold is drawn to its language's as by so many documents more, and a language's to that of all.
PRIOR_ROWS = 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once: a lambda variable is never expanded again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column, n: int) -> Column:
    """How many words lie in n-word windows that the text holds twice or more."""

    def count(h: Column) -> Column:
        def starts(g: Column) -> Column:
            pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def covered(p: Column) -> Column:
                again = F.filter(
                    p,
                    lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) & (i > 0) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)),
                )
                return _let(
                    F.array_sort(F.transform(again, lambda x: x["i"])),
                    lambda at: F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(at, i + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x),
                )

            return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_let(pairs, covered))

        windows = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return F.when(F.size(h) <= n, F.lit(0)).otherwise(_let(windows, starts))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), count)


def measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, source with the base counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), n_lines (int, those with words) and the measures of STEPS (double).

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text. Windows of 8 words are
    compared by 64-bit hash. Null and empty texts have zero everywhere; a text of
    any length is measured whole. With carry the columns of docs are a struct, row.
    """
    kept = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.translate(text, _SPACES, "")
    words = _let(F.btrim(text, F.lit(_SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    line_counts = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    word_counts = _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w, 8).alias("repeat")))
    rows = docs.select(
        *kept,
        "doc_id",
        "lang",
        "source",
        word_counts.alias("w"),
        line_counts.alias("l"),
        F.length(plain).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("upper"),
        (F.length(text) - F.length(F.translate(text, "!?", ""))).alias("marks"),
    )
    own = ["row"] if carry else []
    rows = rows.select(
        *own,
        "doc_id",
        "lang",
        "source",
        F.col("w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.dup").cast("long").alias("n_dup_lines"),
        F.col("w.repeat").cast("long").alias("n_repeat_words"),
        F.col("l.n").alias("n_lines"),
        "upper",
        "marks",
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.select(
        *own, "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("upper", "word_chars").alias("shout_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "n_lines").alias("line_share"),
        share("word_chars", "n_words").alias("word_length"),
        share("marks", "word_chars").alias("mark_share"),
    )


def thresholds(rows: DataFrame, k: int = 400) -> DataFrame:
    """Per language and source a threshold for each measure of STEPS, from quantiles of the group alone.

    It is the median and SPREADS times the distance from it to the 75th
    percentile. Where most documents have nearly the same value, as zero, that
    distance says nothing; the least is LEAST_STEPS steps of a document with the
    group's median number of words or lines. Each group has one KLL sketch a
    measure (mergeable, some kilobytes); a language's sketches are those of its
    sources merged, and all languages' those merged again. A group of n
    documents has n parts of its own threshold and PRIOR_ROWS of its language's.
    Documents of under 20 words don't count.
    """
    sketched = (*STEPS, "n_words", "n_lines")
    own = rows.where("n_words >= 20").groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(c) for c in sketched])
    lang = own.groupBy("lang").agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(c, k).alias(c) for c in sketched])
    every = lang.agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(c, k).alias(c) for c in sketched])

    def cut(c: str) -> Column:
        at = lambda x, q: F.kll_sketch_get_quantile_double(F.col(x), F.lit(q))
        step, of = STEPS[c]
        return at(c, 0.5) + F.greatest(SPREADS * (at(c, 0.75) - at(c, 0.5)), LEAST_STEPS * step / F.greatest(at(of, 0.5), F.lit(1.0)))

    pack = lambda df, name, keys: df.select(*keys, F.struct("n", *[cut(c).alias(c) for c in STEPS]).alias(name))
    own, lang, every = pack(own, "own", ["lang", "source"]), pack(lang, "by_lang", ["lang"]), pack(every, "every", [])
    groups = own.join(lang.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l"))).drop("_l")
    groups = groups.join(F.broadcast(every))  # a single row
    toward = lambda name, c, above: (F.col(f"{name}.n") * F.col(f"{name}.{c}") + PRIOR_ROWS * above) / (F.col(f"{name}.n") + PRIOR_ROWS)
    return groups.select("lang", "source", *[toward("own", c, toward("by_lang", c, F.col(f"every.{c}"))).alias(f"max_{c}") for c in STEPS])


def judge(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row per row of docs: measures, base_failed and kept; with carry also row, the columns of docs as a struct.

    base_failed: under 20 words, or over 30 % of the words in repeated windows.
    kept: not base_failed, and no measure above its group's threshold. A group
    without a document of 20 words has only base failures. Null lang or source
    is a group of its own; repeated rows are judged each. Without carry no other
    column is read, whatever its name. An empty table gives no rows.
    """
    rows = stored(measures(docs, carry))
    limits = thresholds(rows).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    out = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    fine = F.lit(True)
    for c in STEPS:
        fine &= F.coalesce(F.col(c) <= F.col(f"max_{c}"), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & fine).drop("_lang", "_source")


def keep(docs: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject, columns as they are."""
    found = judge(docs, carry=True).where("kept")
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns])
