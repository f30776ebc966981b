"""Maps with coordinates: from tables, by seeded sampling and by random walk; their relations, sentences and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.parsing import DIAGONALS

# Unit moves of the eight directions.
MOVES = {"North": (0, 1), "South": (0, -1), "East": (1, 0), "West": (-1, 0), "Northeast": (1, 1), "Northwest": (-1, 1), "Southeast": (1, -1), "Southwest": (-1, -1)}
#: The default catalogue of entity names.
ENTITIES = [
    "Harbor Lane Books", "Copper Kettle", "Willow Park", "Granite Gym", "Lantern Theater",
    "Maple Bakery", "Orchid Salon", "Pine Street Bank", "Quarry Museum", "River Clinic",
    "Saffron Diner", "Tulip Garden", "Union Library", "Velvet Lounge", "Winter Rink",
    "Amber Arcade", "Birch School", "Cedar Market", "Delta Station", "Ember Forge",
]
#: Place names for random walks.
PLACES = [f"{a} {b}" for a in ("North Gate", "Old Mill", "Stone Bridge", "Market Hall", "River Bend", "High Street", "Green Court", "Lake View", "Sand Hill", "Oak Grove", "Iron Works", "King Square", "Garden Row") for b in ("Shop", "Cafe", "Studio", "Depot")]
if len(set(ENTITIES)) != len(ENTITIES) or len(set(PLACES)) != len(PLACES):
    raise ValueError("names of a catalogue must differ")


def order_worlds(lineitem: DataFrame) -> DataFrame:
    """(map_id, entity, x, y, rk): an order is a map, its distinct parts are entities at (highest price, highest quantity)."""
    rows = lineitem.select(F.col("l_orderkey").alias("map_id"), F.col("l_partkey").alias("entity"), "l_extendedprice", "l_quantity").repartition("map_id")  # the one shuffle
    rows = rows.groupBy("map_id", "entity").agg(F.max("l_extendedprice").alias("x"), F.max("l_quantity").alias("y"))
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy("map_id").orderBy("entity")).cast("long"))


def direction(dx: Column, dy: Column) -> Column:
    """The one of eight directions of a move, null for none."""
    ns = F.when(dy > 0, "north").when(dy < 0, "south").otherwise("")
    ew = F.when(dx > 0, "east").when(dx < 0, "west").otherwise("")
    return F.initcap(F.nullif(F.concat(ns, ew), F.lit("")))


def neighbour_relations(worlds: DataFrame) -> DataFrame:
    """(map_id, seq, a, dir, b) between entities one or two ranks apart that differ on both axes, b the lower rank; no join, only a window."""
    w = Window.partitionBy("map_id").orderBy("rk")
    here = F.struct("entity", "x", "y")
    rows = worlds.select("map_id", "rk", here.alias("a"), F.array(F.lag(here, 1).over(w), F.lag(here, 2).over(w)).alias("near"))
    rows = rows.select("map_id", "rk", "a", F.posexplode("near").alias("gap", "b")).where(F.col("b").isNotNull() & (F.col("a.x") != F.col("b.x")) & (F.col("a.y") != F.col("b.y")))
    seq = F.row_number().over(Window.partitionBy("map_id").orderBy("rk", F.col("gap").desc()))
    return rows.select("map_id", seq.cast("long").alias("seq"), F.col("a.entity").alias("a"), F.lower(direction(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))).alias("dir"), F.col("b.entity").alias("b"))


def sentence(a: Column, d: Column, b: Column, articles: bool = False) -> Column:
    return F.format_string("The %s is to the %s of the %s." if articles else "%s is to the %s of %s.", a.cast("string"), F.initcap(d), b.cast("string"))


def passages(relations: DataFrame, name: str = "Part ") -> DataFrame:
    """(map_id, text): all relations of a map as one passage, in order, after the entity it begins with."""
    named = lambda c: F.concat(F.lit(name), F.col(c).cast("string"))
    each = F.struct("seq", sentence(named("a"), F.col("dir"), named("b")).alias("t"), named("b").alias("b"))
    rows = relations.groupBy("map_id").agg(F.array_sort(F.collect_list(each)).alias("s"))
    head = F.concat(F.lit("Consider a map with multiple objects:\n"), F.get("s", F.lit(0))["b"], F.lit(" is in the map. "))
    return rows.select("map_id", F.concat(head, F.array_join(F.transform("s", lambda x: x["t"]), " ")).alias("text"))


def by_md5(*parts: Column | str) -> Column:
    """md5 of the parts joined by |; the last is a seed if it is a string, the others are columns."""
    *columns, last = parts
    end = F.lit(last) if isinstance(last, str) else last.cast("string")
    return F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in columns], end).cast("binary"))


def draw(n: Column | int, *parts: Column | str) -> Column:
    """A number of 0 .. n - 1 drawn by md5 of the parts."""
    return F.pmod(F.conv(F.substring(by_md5(*parts), 1, 8), 16, 10).cast("long"), (F.lit(n) if isinstance(n, int) else n).cast("long"))


def drawn(items: Column, key: Column, seed: str) -> Column:
    """items in the order of md5(key|item|seed)."""
    return F.transform(F.array_sort(F.transform(items, lambda e: F.struct(by_md5(key, e, seed).alias("h"), e.alias("e")))), lambda s: s["e"])


def sampled_worlds(spark: SparkSession, n: int, least: int = 5, most: int = 10, seed: str = "1") -> DataFrame:
    """(map_id, entity, x, y, rk) of n maps with distinct names and coordinates in 0..100, no two alike on an axis."""
    maps = spark.range(n).withColumnRenamed("id", "map_id")
    key = F.col("map_id")
    k = (least + draw(most - least + 1, key, seed)).cast("int")
    lists = [F.slice(drawn(items, key, seed + tag), F.lit(1), k).alias(tag) for items, tag in ((F.array(*[F.lit(e) for e in ENTITIES]), "e"), (F.sequence(F.lit(0), F.lit(100)), "x"), (F.sequence(F.lit(0), F.lit(100)), "y"))]
    rows = maps.select("map_id", F.posexplode(F.arrays_zip(*lists)).alias("rk", "v"))
    return rows.select("map_id", F.col("v.e").alias("entity"), F.col("v.x").alias("x"), F.col("v.y").alias("y"), (F.col("rk") + 1).cast("long").alias("rk"))


def sampled_relations(worlds: DataFrame, extra: int = 5, seed: str = "1") -> DataFrame:
    """(map_id, seq, a, dir, b): of all pairs of a map the first n .. n + extra in seeded order, n its entities."""
    a, b = worlds.alias("a"), worlds.alias("b")
    pairs = a.join(b, (F.col("a.map_id") == F.col("b.map_id")) & (F.col("a.rk") > F.col("b.rk")))
    pairs = pairs.select("a.map_id", F.col("a.entity").alias("a"), F.lower(direction(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))).alias("dir"), F.col("b.entity").alias("b"))
    n = worlds.groupBy("map_id").agg((F.count("*") + draw(extra + 1, "map_id", seed + "m")).alias("n"))
    seq = F.row_number().over(Window.partitionBy("map_id").orderBy(by_md5("map_id", "a", "b", seed), "a", "b"))
    return pairs.withColumn("seq", seq.cast("long")).join(n, "map_id").where("seq <= n").select("map_id", "seq", "a", "dir", "b")


def options_for(answers: Column, pool: Column, key: Column, seed: str = "1") -> Column:
    """Four (letter, value, correct) in seeded order: the answers and as many of the pool as are lacking."""
    rest = F.array_except(pool, answers)
    ranked = F.transform(F.array_sort(F.transform(rest, lambda v: F.struct(by_md5(key, v, seed).alias("h"), v.alias("v")))), lambda s: s["v"])
    four = F.slice(F.concat(answers, ranked), 1, 4)
    mixed = F.array_sort(F.transform(four, lambda v: F.struct(by_md5(key, v, F.lit(seed), "order").alias("h"), v.alias("v"))))
    return F.transform(mixed, lambda s, i: F.struct(F.char(i + 65).alias("letter"), s["v"].alias("value"), F.array_contains(answers, s["v"]).alias("correct")))


def count_options(n: Column, most: Column, key: Column) -> Column:
    """Options of a count question: n and three other numbers of 0 .. most - 1, or above where there are too few."""
    return options_for(F.array(n.cast("string")), F.transform(F.sequence(F.lit(0), F.greatest(most.cast("int") - 1, F.lit(3))), lambda x: x.cast("string")), key)


def direction_options(known: Column, key: Column) -> Column:
    """Options of a direction question: the diagonals that remain, and others of the eight directions."""
    return options_for(known, F.array(*[F.lit(d) for d in [*DIAGONALS, "North", "South", "East", "West"]]), key)


def stratified(samples: DataFrame, stratum: str, plan: dict[str, int], key: str) -> DataFrame:
    """As many rows of each stratum as the plan says, in md5 order of their key. Strata are cut at a key prefix first, so that no task ranks a whole stratum."""
    wanted = F.create_map(*[F.lit(x) for kv in plan.items() for x in kv])
    h = F.md5(F.col(key).cast("string").cast("binary"))
    rows = samples.select(F.struct(*[F.col(c) for c in samples.columns]).alias("row"), F.col(stratum).alias("s"), F.substring(h, 1, 3).alias("b"), h.alias("h"), F.col(key).alias("k"))
    rows = rows.where(F.col("s").isin(*plan))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))  # 4,096 rows a stratum
    starts = rows.groupBy("s", "b").agg(F.count("*").alias("n")).select("s", "b", F.coalesce(before, F.lit(0)).alias("at"), F.try_element_at(wanted, F.col("s")).alias("want"))
    rows = rows.join(F.broadcast(starts.where("at < want")), ["s", "b"])
    rank = F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "k")) + F.col("at")
    return rows.select("row", rank.alias("rank"), "want").where("rank <= want").select("row.*")


def walk(moves: DataFrame, key: str, order: list[str], dx: Column, dy: Column) -> DataFrame:
    """moves with the position (x, y) after each, from (0, 0), and the direction back to the start from there."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = moves.withColumn("x", F.sum(dx).over(w)).withColumn("y", F.sum(dy).over(w))
    return out.withColumn("home", direction(-F.col("x"), -F.col("y")))


def train_test(rows: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """rows with split: of all in md5 order of their key, the last int(n * share) are test. The order is cut at one rank, found over key prefixes, not by sorting all rows in one task."""
    own = F.struct(*[F.col(c) for c in rows.columns]).alias("row")
    h = F.md5(F.col(key).cast("string").cast("binary"))
    keyed = rows.select(own, h.alias("h"), F.substring(h, 1, 3).alias("b"), F.col(key).alias("k"))
    sizes = keyed.groupBy("b").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows at most
    starts = sizes.withColumn("at", F.coalesce(F.sum("n").over(w), F.lit(0))).join(F.broadcast(total)).select("b", "at", "total")
    rank = F.row_number().over(Window.partitionBy("b").orderBy("h", "k")) + F.col("at")
    out = keyed.join(F.broadcast(starts), "b")
    return out.select("row.*", F.when(rank > F.col("total") - F.floor(F.col("total") * share), "test").otherwise("train").alias("split"))
