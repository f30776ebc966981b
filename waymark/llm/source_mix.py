"""Mixing sources to target weights: a min-cost flow over membership patterns, then a seeded choice of documents."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.tables import stored

#: Membership patterns that the driver solves for at most; a corpus with more needs coarser sources.
MAX_PATTERNS = 100_000
MOST_COPIES = 3
_BUCKETS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[float], weights: list[float], total: float, most: float = MOST_COPIES) -> list[float]:
    """total shared by weight; what lies above `most` times a size is shared again among the others until none is above."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / whole > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def flow(sizes: list[float], members: list[list[int]], quotas: list[float], most: int = MOST_COPIES) -> list[float]:
    """Words each pattern gives, all repeats together, so that quotas are met as far as they can at the least cost.

    The k-th use of a pattern's words costs 2k - 1 each, so repetition is
    convex. Shortest augmenting paths from the cheapest level upward: a path's
    cost is that of the level it starts from, as patterns feed their sources
    and swap them with each other free of charge.
    """
    gives = [dict.fromkeys(m, 0.0) for m in members]
    feeders: list[set[int]] = [set() for _ in quotas]
    for p, m in enumerate(members):
        for s in m:
            feeders[s].add(p)
    lack = [float(q) for q in quotas]
    tiny = 1e-9 * max(1.0, sum(lack))
    for _ in range(most):
        room = [float(x) for x in sizes]
        for start in range(len(sizes)):
            while room[start] > tiny:
                came: dict[tuple[str, int], tuple[str, int] | None] = {("p", start): None}
                queue, end = deque([("p", start)]), None
                while queue and end is None:
                    kind, x = queue.popleft()
                    if kind == "p":
                        nexts = [("s", s) for s in members[x]]
                    else:
                        if lack[x] > tiny:
                            end = (kind, x)
                            break
                        nexts = [("p", p) for p in feeders[x] if gives[p][x] > tiny and len(members[p]) > 1]
                    for node in nexts:
                        if node not in came:
                            came[node] = (kind, x)
                            queue.append(node)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                amount = min([room[start], lack[end[1]], *(gives[p[1]][s[1]] for s, p in zip(path[1::2], path[2::2], strict=False))])
                for p, s in zip(path[::2], path[1::2], strict=False):
                    gives[p[1]][s[1]] += amount
                for s, p in zip(path[1::2], path[2::2], strict=False):
                    gives[p[1]][s[1]] -= amount
                room[start] -= amount
                lack[end[1]] -= amount
    return [sum(g.values()) for g in gives]


def _with_keys(docs: DataFrame, member: Column, seed: int, carry: list[str]) -> DataFrame:
    """row (the carried columns), size, member, bucket and rank, counted once and stored; rows that agree in all but their place have ranks of their own."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")
    hashed = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))
    hashed = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).otherwise(hashed)
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row") if carry else F.lit(None).alias("row"), size.alias("size"), member.alias("member"), hashed.alias("u"))
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    held = stored(rows).select("row", "size", "member", F.conv(F.substring("u", 1, 3), 16, 10).cast("int").alias("bucket"), F.struct("u", place.alias("at")).alias("rank"))
    return held


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 17, member: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the caller's columns, or of those to carry), size, source_size, target and copies: how often the mix takes each document.

    member: the array of sources a document belongs to, [source] by default.
    Sources in code point order, null last, weigh `weights`, repeating, and
    share the words of all documents; targets stop at MOST_COPIES times the
    words of their source. A pattern's documents are all taken the whole number
    of times the flow asks for; of the rest, as many more in the order of
    md5(doc_id|seed) as come nearest. A null doc_id is ordered by its text, and
    rows that agree in that too by their place in the stored table, so some of
    them can be taken; which ones makes no difference. A null or empty text has
    size 0; a text of any length is counted whole; an empty table gives no rows.
    """
    member = F.array(F.col("source").cast("string")) if member is None else F.array_sort(F.array_distinct(member))
    keyed = _with_keys(docs, member, seed, docs.columns if carry is None else carry)
    by_bucket = stored(keyed.groupBy("member", "bucket").agg(F.sum("size").alias("n")))
    patterns = [(tuple(r["member"]), r["n"]) for r in by_bucket.groupBy("member").agg(F.sum("n").alias("n")).limit(MAX_PATTERNS + 1).collect()]
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    order = lambda s: (s is None, (s or "").encode())
    patterns.sort(key=lambda x: [order(s) for s in x[0]])
    sources = sorted({s for m, _ in patterns for s in m}, key=order)
    at = {s: k for k, s in enumerate(sources)}
    members = [[at[s] for s in m] for m, _ in patterns]
    size = [0] * len(sources)
    for m, (_, n) in zip(members, patterns, strict=True):
        for k in m:
            size[k] += n
    goal = targets(size, [weights[k % len(weights)] for k in range(len(sources))], sum(n for _, n in patterns))
    given = flow([n for _, n in patterns], members, goal)
    whole = [min(MOST_COPIES, int(g / n + 1e-9)) if n else 0 for (_, n), g in zip(patterns, given, strict=True)]
    rows = [(list(m), w, max(0.0, g - n * w)) for (m, n), w, g in zip(patterns, whole, given, strict=True)]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(rows, "member array<string>, base int, rest double")
    running = Window.partitionBy("member").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 4,096 rows a pattern
    cut = by_bucket.withColumn("upto", F.sum("n").over(running)).join(F.broadcast(wanted), "member")
    cut = cut.where("upto - n <= rest and rest < upto").select("member", "bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("room"))
    last = _last_taken(keyed, cut)
    edge = wanted.join(cut.select("member", "bucket"), "member", "left").join(last, "member", "left")
    decided = edge.collect()  # one row a pattern
    table = spark.createDataFrame(
        [(r["member"], r["base"], r["bucket"] if r["bucket"] is not None else (_BUCKETS if r["rest"] > 0 else -1), r["last"], *_named(r["member"], at, size, goal)) for r in decided],
        "member array<string>, base int, edge int, last struct<u: string, at: struct<f: string, i: bigint>>, source_size bigint, target double",
    )
    out = keyed.join(F.broadcast(table), "member")
    more = F.when(F.col("bucket") < F.col("edge"), 1).when((F.col("bucket") == F.col("edge")) & (F.col("rank") <= F.col("last")), 1).otherwise(0)
    copies = F.least(F.lit(MOST_COPIES), F.col("base") + F.coalesce(more, F.lit(0)))
    return out.select("row", "size", "source_size", "target", copies.alias("copies"))


def _last_taken(keyed: DataFrame, cut: DataFrame) -> DataFrame:
    """(member, last): in each pattern's cut bucket the rank up to which documents fit the room; half of the last one must.

    Rows of the bucket are added up by a finer bucket of their rank first: the
    stored file and a thousand rows of it. So a bucket with a great part of the
    corpus, as of one doc_id or none, is nobody's task.
    """
    rows = keyed.join(F.broadcast(cut), ["member", "bucket"]).withColumn("part", F.struct(F.col("rank.u").alias("u"), F.col("rank.at.f").alias("f"), F.floor(F.col("rank.at.i") / 1000).alias("i")))
    parts = rows.groupBy("member", "part").agg(F.sum("size").alias("n"), F.max("room").alias("room"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("member").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before)
    near = parts.where("before <= room and before + n > room").select("member", "part", "before")  # the one that the room ends in
    full = parts.where("before + n <= room").groupBy("member").agg(F.max("part").alias("part"))
    open_ = rows.join(F.broadcast(near), ["member", "part"])  # one row a pattern
    upto = F.sum("size").over(Window.partitionBy("member").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    fits = open_.withColumn("upto", upto).where("upto - size / 2 <= room").groupBy("member").agg(F.max("rank").alias("r"))
    ends = rows.join(F.broadcast(full), ["member", "part"]).groupBy("member").agg(F.max("rank").alias("r"))
    return fits.union(ends).groupBy("member").agg(F.max("r").alias("last"))


def _named(member: list[str], at: dict, size: list[int], goal: list[float]) -> tuple[int, float]:
    """Size and target of a pattern's sources, added up where there are several."""
    return sum(size[at[s]] for s in member), float(sum(goal[at[s]] for s in member))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as often as the plan takes it, columns as they are, whatever their names. Documents without words are kept once."""
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    out = plan(docs, weights, seed).where(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies)).alias("n"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
