"""N-gram Jaccard join: exact links between documents whose word shingle sets are alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.tables import forget, in_arrow, put_back, set_aside, stored, tidy
from waymark.llm.text import LOWER, as_bytes, mix, rolling, slices, split

#: Bits of a signature at least; it has as many as its set shingles, in powers of two, so that it tells long texts apart too.
_BITS = 1024
#: Width of a size band: largest size over smallest.
_BAND = 1.4
#: Members of a tile that are compared in one piece.
_TILE = 4096
#: Bytes of shingles that are compared in one piece.
_TILE_BYTES = 8 << 20
#: Bits of a fine signature for each shingle, at least.
_FINE = 8
#: Blocks of a cluster's band that is compared as a whole, at most.
_WHOLE = 16
#: Candidates of one leader that are compared in one piece.
_FANOUT = 2000
#: Rows of candidates (some bytes each) that are broadcast to the texts; more are joined by a shuffle.
_BROADCAST_ROWS = 200_000


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) of each text: lower-cased (A-Z) words, `words` at a time; a shorter text is one shingle, one without words has none."""
    buf, offsets = as_bytes(texts)
    for i, j in slices(offsets):
        w = split(LOWER[buf[offsets[i] : offsets[j]]], offsets[i : j + 1])
        h = w.hashes()
        grams = rolling(h, words)
        for d in range(j - i):
            a, b = int(w.first[d]), int(w.first[d + 1])
            if b - a >= words:
                yield i + d, np.unique(grams[a : b - words + 1])
            elif b > a:
                yield i + d, rolling(h[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield i + d, np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray, seed: int = 0) -> int:
    """A 64-bit name of a set."""
    own = mix(shingles + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return int(mix(np.array([own.sum(dtype=np.uint64) ^ np.uint64(len(shingles)), 0], np.uint64))[0] ^ np.bitwise_xor.reduce(mix(own ^ np.uint64(0xA5A5A5A5)), initial=np.uint64(0))) - (1 << 63)


def _bitmap(shingles: np.ndarray, each: int = 1) -> bytes:
    """Each shingle flips one bit of at least `each` times as many: two sets differ in at least as many shingles as their bitmaps do in bits."""
    size = max(_BITS, 1 << max(0, each * len(shingles) - 1).bit_length())
    bits = (np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1).astype(np.uint8)
    return np.packbits(bits).tobytes()


def _bits_of(maps: list[bytes], least: int | None = None) -> np.ndarray:
    """The bitmaps as rows of integers; longer ones are folded to the length of the shortest, which leaves parities."""
    sizes = np.array([len(x) for x in maps])
    least = min(least or int(sizes.min()), int(sizes.min()))
    out = np.empty((len(maps), least // 8), np.uint64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join([maps[k] for k in at.tolist()]), np.uint64).reshape(len(at), size // least, -1)
        out[at] = np.bitwise_xor.reduce(rows, axis=1)
    return out


def _most_different(total: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """The most shingles in which two linked sets may differ, given the sum of their sizes."""
    return total * (den - num) // (den + num)


def _families(n: int, num: int, den: int) -> list[int]:
    """The size bands in whose tiles a set of n shingles takes part: its own, and the one below if a smaller partner may be there."""
    band = int(np.log(n) / np.log(_BAND) + 1e-9)
    low = int(np.ceil(_BAND**band - 1e-9))
    return [band, band - 1] if band and num * n < den * low + den else [band]


@cache
def _pieces(band: int, num: int, den: int) -> tuple[int, int]:
    """Into how many pieces sets of a band are cut, and how many of them may be empty.

    Two linked sets whose smaller one is in the band differ in so many pieces
    at most that of the others, which are the same in both, one more is left
    than may be empty.
    """
    smaller = int(np.ceil(_BAND ** (band + 1)))
    differ = int(_most_different(smaller + smaller * den // num, num, den))
    spare = 0
    for _ in range(4):  # about two and a half deviations above the pieces that are empty by chance
        pieces = differ + 1 + spare
        chance = pieces * np.exp(-1.1 * _BAND**band / pieces)
        spare = int(chance + 2.5 * np.sqrt(chance))
    return differ + 1 + spare, spare


def _cut(shingles: np.ndarray, pieces: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The piece numbers that hold shingles and a hash of what each holds. shingles ascend."""
    piece = ((shingles >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
    at = np.flatnonzero(np.diff(piece, prepend=np.uint64(pieces)))
    total = np.add.reduceat(mix(shingles + np.uint64(seed)), at)
    return piece[at].astype(np.int64), total


def tile_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the tiles a set belongs to; linked different sets share at least one.

    Where pieces of a set hold nothing, equal emptiness says little. Sets with
    more such pieces than the cut has to spare are cut a second time, by other
    hashes, and share a key of that cut or, failing that, a pair of pieces
    empty in both cuts.
    """
    out = []
    for band in _families(len(shingles), num, den):
        pieces, spare = _pieces(band, num, den)
        tag = np.uint64(0x9E3779B97F4A7C15 * (band + 1) & 0xFFFFFFFFFFFFFFFF)
        number, total = _cut(shingles, pieces, 1)
        out.append(mix(total + mix(number.astype(np.uint64) + tag)))
        if pieces - len(number) > spare:
            other, total = _cut(np.sort(mix(shingles ^ np.uint64(0x5851F42D4C957F2D))), pieces, 2)
            out.append(mix(total + mix(other.astype(np.uint64) + tag + np.uint64(1 << 40))))
            if pieces - len(other) > spare:
                none, none2 = np.setdiff1d(np.arange(pieces), number), np.setdiff1d(np.arange(pieces), other)
                pair = (none[:, None] * pieces + none2).ravel().astype(np.uint64)
                out.append(mix(pair + tag + np.uint64(1 << 41)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the links (a, b), in rounds that hook stars together and shorten them."""
    label = nodes.select("id", F.col("id").alias("component"))
    edges = links.select("a", "b")
    edges = edges.union(edges.select("b", "a"))
    held: list[DataFrame] = []  # tables of the round before
    while True:
        # each component hooks to the smallest component beside it, then paths are halved until they are stars
        side = edges.join(label.withColumnRenamed("id", "a").withColumnRenamed("component", "ca"), "a")
        side = side.join(label.withColumnRenamed("id", "b").withColumnRenamed("component", "cb"), "b").where("ca <> cb").select("ca", "cb").distinct()
        side = stored(side)
        if side.isEmpty():
            return label
        parent = side.groupBy("ca").agg(F.min("cb").alias("cb")).where("cb < ca").select(F.col("ca").alias("id"), F.col("cb").alias("parent"))
        rounds = [longer := stored(parent.withColumn("moved", F.lit(True)))]
        while not longer.where("moved").isEmpty():
            parent = longer.select("id", "parent")
            up = parent.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
            longer = stored(parent.join(up, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
            rounds.append(longer)
        parent = longer.select("id", "parent")
        label = stored(label.join(parent.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("parent", "component").alias("component")))
        edges = side.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        forget(*rounds, *held)
        held = [side, label]


def _verified(texts: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, num: int, den: int, seed: int) -> DataFrame:
    """Of the candidate pairs (a, b) those whose sets link: exact intersection of sorted arrays. A leader's candidates are compared in pieces."""
    sized = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("m")), "a")
    pieces = F.ceil(F.col("m") / _FANOUT).cast("int")
    sized = sized.select("a", "b", F.pmod(F.xxhash64("b"), pieces).cast("int").alias("piece"))
    leaders = sized.select("a", F.col("a").alias("b"), "piece").distinct()
    needed = sized.union(leaders).join(classes.select(F.col("id").alias("b"), F.col("doc").alias("doc_id")), "b")
    needed = stored(needed)
    side = F.broadcast(needed) if needed.count() <= _BROADCAST_ROWS else needed
    rows = texts.join(side, "doc_id").select("a", "piece", "b", "text", (F.col("a") != F.col("b")).alias("other"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, own = None, None
        for rb in batches:
            a, piece, b = (rb.column(k).to_pylist() for k in range(3))
            found: list[tuple[int, int]] = []
            for i, s in shingle_sets(rb.column(3), words):
                if set_id(s, seed) != b[i]:  # another text under a repeated doc_id
                    continue
                if a[i] == b[i]:
                    unit, own = (a[i], piece[i]), s  # the leader itself comes first
                elif (a[i], piece[i]) == unit:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if both and den * both >= num * (len(own) + len(s) - both):
                        found.append((a[i], b[i]))
            yield _pair_batch(found)

    rows = rows.repartition("a", "piece").sortWithinPartitions("a", "piece", "other")
    found = stored(rows.drop("other").transform(in_arrow, compare, "a long, b long").distinct())
    forget(needed)
    tidy(found.sparkSession)
    return found


def _made(texts: DataFrame, classes: DataFrame, ids: DataFrame, words: int, name: str, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(id, name) of the classes with the ids: what make gives for their ascending shingles."""
    needed = ids.join(classes.select("id", "row"), "id").select("id", F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("text_hash"))
    rows = texts.join(needed, ["doc_id", "text_hash"]).select("id", "text")

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            own = rb.column(0).to_pylist()
            found = {own[i]: make(s) for i, s in shingle_sets(rb.column(1), words)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["id", name])

    return rows.transform(in_arrow, out, f"id long, {name} binary").dropDuplicates(["id"])


def _in_blocks(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    """rows (key, id, n, …) with (i, j), the pairs of blocks that each takes part in: blocks have _TILE rows and _TILE_BYTES of the weight at most."""
    size = rows.groupBy(key).agg(F.greatest(F.ceil(F.count("*") / _TILE), F.ceil(F.sum(weight) / _TILE_BYTES)).cast("int").alias("blocks"))
    rows = rows.join(size, key).withColumn("r", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("r", "s"), "j": F.greatest("r", "s")})


def _matching(rows: DataFrame, signatures: DataFrame, weight: float, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(key, id, root) of the rows (key, id, component, n) of tiles that some row of another component may link to, by the bitmaps in signatures (id, bits; weight: their bytes for each shingle).

    root is the least member that the tile's allowed pairs connect id with.
    Rows with a peer are allowed pairs (id, peer), just those that connect.
    Large tiles are compared in blocks, each pair of blocks apart. A row for
    each member goes in and two at most come out, however many may link.
    """
    rows = _in_blocks(rows, "key", F.col("n") * weight).join(signatures, "id").select("key", "i", "j", "id", "component", "n", "bits")

    def members(unit: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        unit.sort(key=lambda x: x[0])
        ids, comp, n = (np.array([x[k] for x in unit], np.int64) for k in range(3))
        root = np.arange(len(unit))
        found = np.zeros(len(unit), bool)
        pairs = [np.zeros((0, 2), np.int64)]
        for x, ys in _allowed_rows(comp, n, _bits_of([x[3] for x in unit]), num, den):
            found[x] = found[ys] = True
            own, first = np.unique(np.append(root[x], root[ys]), return_index=True)
            if len(own) > 1:
                pairs.append(np.stack((np.full(len(own), x), np.append(x, ys)[first]), 1))
                root[np.isin(root, own)] = own[0]
        pairs = np.concatenate(pairs)
        pairs = ids[pairs[pairs[:, 0] != pairs[:, 1]]]
        at = np.flatnonzero(found)
        none = np.full(len(at), -1)
        return np.concatenate((ids[at], pairs.min(1))), np.concatenate((ids[root[at]], pairs.min(1))), np.concatenate((none, pairs.max(1))), np.arange(len(at) + len(pairs)) < len(at)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, _), unit in _units(batches, 3):
            ids, root, peer, plain = members(unit)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), pa.array(ids), pa.array(root), pa.array(peer, pa.int64(), mask=plain)], ["key", "id", "root", "peer"])

    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").transform(in_arrow, compare, "key long, id long, root long, peer long")
    found = stored(rows.distinct())
    tidy(found.sparkSession)
    return found.where("peer is null").select("key", "id", "root"), found.where("peer is not null").select(F.col("id").alias("a"), F.col("peer").alias("b")).distinct()


def _pieces_of(near: DataFrame, classes: DataFrame, weight: float, num: int, den: int) -> DataFrame:
    """(tile, id): what is compared together next, of the rows of _matching.

    Members that allowed pairs connect over all tiles make a cluster, and those
    of a cluster in one size band a tile, so that a set goes to two places at
    most instead of to all its tiles. A band of very many blocks (weight: bytes
    for each shingle) is left in its tiles.
    """
    ids = stored(near.select("id").distinct())
    cluster = _components(ids, near.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct())
    band = F.floor(F.log("n") / float(np.log(_BAND)) + 1e-9)
    low = F.ceil(F.pow(F.lit(_BAND), F.col("band")) - 1e-9)
    below = F.when((F.col("band") > 0) & (num * F.col("n") < den * low + den), F.col("band") - 1)  # as in _families
    rows = cluster.join(classes.select("id", "n"), "id").withColumn("band", band)
    rows = rows.select("id", "n", "component", F.explode(F.filter(F.array("band", below), lambda x: x.isNotNull())).alias("band"))
    rows = rows.select("id", "n", F.xxhash64("component", "band").alias("tile"))
    size = rows.groupBy("tile").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    large = size.where((F.col("m") > _WHOLE * _TILE) | (F.col("n") * weight > _WHOLE * _TILE_BYTES)).select("tile")
    own = rows.join(large, "tile", "left_anti").select("tile", "id")
    apart = near.select(F.col("key").alias("tile"), "id").distinct().join(rows.join(large, "tile", "left_semi").select("id"), "id", "left_semi").select("tile", "id")
    return stored(own.union(apart))


def _linked(members: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the components of members (tile, id, component, n) of each tile as all their links would; held has (id, bits, shingles).

    A task holds two blocks of a tile with their sorted shingles. Allowed pairs
    are decided by exact intersection, and pairs whose components a link of the
    same task has already joined are skipped, so that the links of a task are
    fewer than its members.
    """
    rows = _in_blocks(members, "tile", F.col("n") * 8).join(held, "id").select("tile", "i", "j", "id", "component", "n", "bits", "shingles")

    def links(unit: list[tuple]) -> list[tuple[int, int]]:
        ids, comp, n = (np.array([x[k] for x in unit], np.int64) for k in range(3))
        sets = [np.frombuffer(x[4], np.uint64) for x in unit]
        parent = np.unique(comp, return_inverse=True)[1]  # of each member its component, by number; joined ones get the smaller
        out: list[tuple[int, int]] = []
        for x, ys in _allowed_rows(comp, n, _bits_of([x[3] for x in unit]), num, den):
            first = True
            while len(ys := ys[parent[ys] != parent[x]]):
                now = ys[np.unique(parent[ys], return_index=True)[1]] if first else ys  # one of each component, then all the others
                sizes = n[now]
                at = np.searchsorted(sets[x], every := np.concatenate([sets[y] for y in now.tolist()]))
                hit = sets[x][np.minimum(at, len(sets[x]) - 1)] == every
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
                for y in now[den * both >= num * (n[x] + sizes - both)].tolist():
                    if parent[y] != parent[x]:
                        out.append((int(ids[x]), int(ids[y])))
                        parent[parent == max(parent[x], parent[y])] = min(parent[x], parent[y])
                if not first:
                    break
                ys, first = np.setdiff1d(ys, now), False
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, unit in _units(batches, 3):
            yield _pair_batch(links(unit))

    return stored(rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j").transform(in_arrow, compare, "a long, b long").distinct())


def _units(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows in a row that agree in their first `width` columns: those, and the rest of each row."""
    key, unit = None, []
    for rb in batches:
        for row in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if row[:width] != key:
                if unit:
                    yield key, unit
                key, unit = row[:width], []
            unit.append(row[width:])
    if unit:
        yield key, unit


def _allowed_rows(comp: np.ndarray, n: np.ndarray, bits: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each member the later ones of other components whose sizes and bitmaps leave room for a link."""
    step = max(1, (1 << 21) // max(1, bits.size))
    for lo in range(0, len(comp), step):
        hi = min(len(comp), lo + step)
        differ = np.bitwise_count(bits[lo:hi, None, :] ^ bits[None, lo:]).sum(2, dtype=np.int64)
        ok = (differ <= _most_different(n[lo:hi, None] + n[None, lo:], num, den)) & (comp[lo:hi, None] != comp[None, lo:])
        ok &= np.arange(lo, hi)[:, None] < np.arange(lo, len(comp))[None]
        for x in np.flatnonzero(ok.any(1)):
            yield lo + int(x), lo + np.flatnonzero(ok[x])


def _pair_batch(found: set[tuple[int, int]] | list[tuple[int, int]]) -> pa.RecordBatch:
    rows = list(found)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], ["a", "b"])


def groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Connected groups of documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    Documents with equal sets are one class. Classes meet in tiles: a band of sizes, and a piece of the
    hash space that holds the same shingles in both; two linked sets differ in
    fewer shingles than a band has pieces, so they share a tile. A tile first
    proposes links to its leader. In tiles that this leaves in several
    components, members whose bitmap signatures allow a link to another
    component are compared within the tile, by exact intersection of sorted
    arrays, and a link is only given where it joins two components. So no group
    misses a link, and no step lists more rows than its tiles have members.

    Returns one row per row of docs: doc_id, n_shingles (set size), component_id
    (smallest doc_id reachable; its own doc_id without links). Words are
    `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z lower-cased. A null or
    empty text has no shingles and no links. Rows that repeat a doc_id are each
    returned and are documents of their own. A null doc_id takes part in no link and has
    component null. Other columns are not carried.
    """
    return _grouped(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of groups with text_hash, and first_hash: the text_hash of the component's first row, by component_id and then text_hash."""
    if percent * _BAND < 100:
        raise ValueError("size bands are too narrow for this similarity")
    num, den = percent, 100
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = [(len(s), set_id(s, seed), m := _bitmap(s), _bits_of([m], _BITS // 8).tobytes()) for _, s in shingle_sets(rb.column(1), words)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([rb.column(0), *columns, rb.column(2)], ["doc_id", "n", "id", "bits", "short", "text_hash"])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            found: dict[int, np.ndarray] = {}  # copies send their keys once
            for _, s in shingle_sets(rb.column(1), words):
                if len(s) and (len(s) + 1) * (den - num) >= den and (name := set_id(s, seed)) not in found:
                    found[name] = tile_keys(s, num, den)
            if found:
                owner = np.repeat(np.array(list(found), np.int64), [len(k) for k in found.values()])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(found.values())).view(np.int64)), pa.array(owner)], ["key", "id"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the sorted (key, id) rows those whose key has a smaller id, its leader."""
        held, leader, last = None, 0, None
        for rb in batches:
            if not rb.num_rows:
                continue
            key, ids = rb.column(0).to_numpy(), rb.column(1).to_numpy()
            new = np.append(key[0] != held, np.diff(key) != 0)
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            lead = np.where(at >= 0, ids[at], leader)
            repeated = ~new & (np.append(last if last is not None else ids[0] ^ 1, ids[:-1]) == ids)
            other = pa.array((ids != lead) & ~repeated)
            held, leader, last = key[-1], lead[-1], ids[-1]
            yield pa.RecordBatch.from_arrays([pa.array(key).filter(other), pa.array(lead).filter(other), pa.array(ids).filter(other)], ["key", "leader", "id"])

    for seed in range(8):  # noqa: B007 - describe and tile name sets with it
        sets = stored(texts.transform(in_arrow, describe, "doc_id long, n long, id long, bits binary, short binary, text_hash long"))
        rows = F.min(F.struct("doc_id", "text_hash")).alias("row")
        classes = sets.where("n > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("doc"), rows, F.max("n").alias("n"), F.max("bits").alias("bits"), F.max("short").alias("short"), ((F.min("bits") != F.max("bits")) | (F.min("n") != F.max("n"))).alias("mixed"))
        classes = stored(classes)
        if classes.where("mixed").isEmpty():
            break
    else:
        raise RuntimeError("different sets share a name under every seed")
    entries = texts.where("doc_id is not null").transform(in_arrow, tile, "key long, id long").repartition("key").sortWithinPartitions("key", "id")
    tiles = stored(entries.transform(in_arrow, shared, "key long, leader long, id long"))
    tidy(tiles.sparkSession)
    star = _allowed(tiles.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), classes, num, den)
    links = _verified(texts, classes, star, words, num, den, seed)
    nodes = links.select(F.col("a").alias("id")).union(links.select("b")).union(tiles.select("id")).union(tiles.select("leader")).distinct()
    nodes = stored(nodes)
    label = _components(nodes, links)
    members = tiles.select("key", "id").union(tiles.select("key", "leader").distinct())
    labelled = members.join(label, "id")
    split_keys = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    open_tiles = labelled.join(split_keys, "key", "left_semi").join(classes.select("id", "n"), "id").select("key", "id", "component", "n")
    near, _ = _matching(open_tiles, classes.select("id", F.col("short").alias("bits")), 0.02, num, den)
    sized = classes.select("id", "n")
    if not near.isEmpty():
        # short signatures say little about long texts: what they leave is looked at with fine ones, of some bits a shingle
        pieces = _pieces_of(near, classes, 2.0, num, den).withColumnRenamed("tile", "key")
        tidy(pieces.sparkSession)
        fine = stored(_made(texts, classes, pieces.select("id").distinct(), words, "bits", lambda s: _bitmap(s, _FINE)))
        near, pairs = _matching(pieces.join(label, "id").join(sized, "id"), fine, 2.0, num, den)
        # most of what fine signatures allow links, so pairs that connect it are decided first
        pairs = pairs.join(star, ["a", "b"], "left_anti")
        links = links.union(_verified(texts, classes, stored(pairs), words, num, den, seed))
        label = _components(nodes, links)
        apart = near.select("key", "id").distinct().join(label, "id").join(sized, "id")
        mixed = apart.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        near, _ = _matching(apart.join(mixed, "key", "left_semi"), fine, 2.0, num, den)
        if not near.isEmpty():
            pieces = _pieces_of(near, classes, 8.0, num, den)
            held = _made(texts, classes, pieces.select("id").distinct(), words, "shingles", lambda s: s.tobytes()).join(fine, "id")
            label = _components(nodes, links.union(_linked(pieces.join(label, "id").join(sized, "id"), held, num, den)))
    label = label.join(classes.select("id", "row"), "id")
    label = label.join(label.groupBy("component").agg(F.min("row").alias("first")), "component").select("id", "first")
    found = classes.select("id", "row").join(label, "id", "left").select("id", F.coalesce("first", "row").alias("first"))
    rows = sets.select("doc_id", "text_hash", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("id")).alias("id"))
    return rows.join(found, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), "text_hash", F.col("first.text_hash").alias("first_hash"))


def _allowed(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps leave room for a link."""
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x, y = rb.column(3).to_pylist(), rb.column(5).to_pylist()
            least = np.array([min(len(a), len(b)) for a, b in zip(x, y, strict=True)])
            differ = np.zeros(len(x), np.int64)
            for size in np.unique(least).tolist():
                at = np.flatnonzero(least == size)
                a, b = (_bits_of([z[k] for k in at.tolist()], size) for z in (x, y))
                differ[at] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
            total = rb.column(2).to_numpy() + rb.column(4).to_numpy()
            ok = pa.array(differ <= _most_different(total, num, den))
            yield pa.RecordBatch.from_arrays([rb.column(k).filter(ok) for k in range(2)], ["a", "b"])

    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "ba", "nb", "bb")
    return stored(rows.transform(in_arrow, look, "a long, b long"))


def one_per_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each group one row of its smallest doc_id stays, and all rows without words or doc_id.

    Rows that repeat a doc_id are documents of their own: a row goes only if it
    is in a group with the row that stays. Rows of a doc_id are told apart by a
    64-bit hash of their text.
    """
    plain, names = set_aside(docs)
    own = F.struct("doc_id", "text_hash")
    drop = _grouped(plain, words, percent).where(F.col("first_hash").isNotNull() & (own != F.struct("component_id", "first_hash"))).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    rows = plain.withColumns({"_id": F.col("doc_id").cast("long"), "_text": F.xxhash64(F.col("text").cast("string"))})
    left = rows.join(drop, (F.col("_id") == F.col("_doc")) & (F.col("_text") == F.col("_hash")), "left_anti")
    alone = F.col("_id").isNull() | ~F.coalesce(F.regexp_like(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    left = left.where(alone).union(left.where(~alone).dropDuplicates(["_id", "_text"]))
    return put_back(left.select("doc_id", "text", *names), docs)
