"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over token windows."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.tables import in_arrow, put_back, set_aside, stored
from waymark.llm.text import LOWER, NOT_ALNUM, as_bytes, covered, rolling, slices, split

#: Bytes of benchmark text whose windows are broadcast at once; a larger benchmark is scanned in blocks of this size.
BLOCK_BYTES = 8 << 20

_Windows = dict[int, tuple[np.ndarray, list[list[tuple[bytes, list[int]]]]]]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").toLocalIterator():
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def _windows(block: list[tuple[int, str]], n: int) -> _Windows:
    """By length: ascending window hashes, and for each the windows' words and the items that have them."""
    by: dict[int, dict[int, dict[bytes, set[int]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for item, text in block:
        buf = LOWER[np.frombuffer(text.encode(), np.uint8)]
        w = split(buf, np.array([0, len(buf)]), NOT_ALNUM)
        length = min(n, len(w.start))
        words = [buf[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
        for i, h in enumerate(rolling(w.hashes(), length).tolist() if length else []):
            by[length][h][b" ".join(words[i : i + length])].add(item)
    return {k: (np.array(sorted(v), np.uint64), [[(x, sorted(y)) for x, y in v[h].items()] for h in sorted(v)]) for k, v in by.items()}


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, carry: list[str] | None = None) -> DataFrame:
    """Which words of each document lie in a window of the benchmark.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. A
    window is n consecutive words of an item; an item of fewer words, but not
    none, is one window. Windows are found by hash and verified word by word.
    Returns doc_id and the columns to carry, with n_words, n_hit, n_items,
    items_sha256 (of the item_ids with occurring windows, sorted as strings,
    joined by commas), contaminated, and hits: for each run of hit words its
    first and last+1 byte. Null texts have no words; null items and item_ids
    are no benchmark; rows with the same item_id are one item; rows with the
    same doc_id are judged apart.
    """
    kept = ["doc_id", "text", *[c for c in carry or [] if c not in ("doc_id", "text")]]
    rows = docs.select(*kept)
    rows = rows.withColumn("_found", F.lit(None).cast("binary")).withColumn("_items", F.expr("cast(array() as array<bigint>)"))
    blocks = list(_blocks(benchmark)) if _size(benchmark) <= BLOCK_BYTES else _blocks(benchmark)
    first = True
    for block in blocks:
        if not first:
            rows = stored(rows)
        first = False
        rows = _scan_block(rows, docs.sparkSession.sparkContext.broadcast(_windows(block, n)))
    return rows.transform(in_arrow, _report(len(kept)), _schema(rows, len(kept)))


def _size(benchmark: DataFrame) -> int:
    return benchmark.agg(F.sum(F.length("text"))).first()[0] or 0


def _schema(rows: DataFrame, kept: int) -> str:
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:kept])
    return own + ", n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<struct<start: bigint, end: bigint>>"


def _scan_block(rows: DataFrame, windows: object) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            table: _Windows = windows.value
            buf, offsets = as_bytes(rb.column(1))
            found, items = rb.column(rb.num_columns - 2).to_pylist(), rb.column(rb.num_columns - 1).to_pylist()
            for i, j in slices(offsets):
                w = split(LOWER[buf[offsets[i] : offsets[j]]], offsets[i : j + 1], NOT_ALNUM)
                h = w.hashes()
                hit = np.zeros(len(h), bool)
                for length, (keys, entries) in table.items():
                    start, key = w.windows(h, length)
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    true = []
                    for k in np.flatnonzero(keys[at] == key).tolist():
                        a = int(start[k])
                        words = b" ".join(w.buf[w.start[x] : w.end[x]].tobytes() for x in range(a, a + length))
                        for own, who in entries[at[k]]:
                            if own == words:
                                true.append(a)
                                items[i + int(w.doc[a])].extend(who)
                    hit |= covered(np.array(true, np.int64), length, len(h))
                for d in np.unique(w.doc[hit]).tolist():
                    own = hit[w.first[d] : w.first[d + 1]]
                    if found[i + d] is not None:
                        own = own | np.unpackbits(np.frombuffer(found[i + d], np.uint8), count=len(own)).astype(bool)
                    found[i + d] = np.packbits(own).tobytes()
            items = [sorted(set(x)) for x in items]
            yield pa.RecordBatch.from_arrays([*rb.columns[:-2], pa.array(found, pa.binary()), pa.array(items, pa.list_(pa.int64()))], rb.schema.names)

    return rows.transform(in_arrow, look, rows.schema)


def _report(kept: int):  # noqa: ANN202
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            buf, offsets = as_bytes(rb.column(1))
            found, items = rb.column(rb.num_columns - 2).to_pylist(), rb.column(rb.num_columns - 1).to_pylist()
            n_words, n_hit, spans = [], [], []
            for i, j in slices(offsets):
                w = split(LOWER[buf[offsets[i] : offsets[j]]], offsets[i : j + 1], NOT_ALNUM)
                for d in range(j - i):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    n_words.append(b - a)
                    if found[i + d] is None:
                        n_hit.append(0)
                        spans.append([])
                        continue
                    hit = np.unpackbits(np.frombuffer(found[i + d], np.uint8), count=b - a).astype(np.int8)
                    n_hit.append(int(hit.sum()))
                    edge = np.diff(hit, prepend=0, append=0)
                    base = offsets[i + d] - offsets[i]
                    lo, hi = w.start[a + np.flatnonzero(edge == 1)] - base, w.end[a + np.flatnonzero(edge == -1) - 1] - base
                    spans.append([{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
            sha = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
            out = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array([x > 0 for x in n_hit], pa.bool_())]
            out.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            names = [*rb.schema.names[:kept], "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"]
            yield pa.RecordBatch.from_arrays([*rb.columns[:kept], *out], names)

    return report


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words' bytes cut from their texts. Columns stay as they are."""
    plain, names = set_aside(docs)
    found = scan(plain, benchmark, n, carry=names)
    if remove == "documents":
        return put_back(found.where(~F.col("contaminated")).select("doc_id", "text", *names), docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = rb.column(1).to_pylist()
            for i, spans in enumerate(rb.column(rb.num_columns - 1).to_pylist()):
                if spans:
                    raw, at, keep = texts[i].encode(), 0, []
                    for s in spans:
                        keep.append(raw[at : s["start"]])
                        at = s["end"]
                    texts[i] = b"".join([*keep, raw[at:]]).decode()
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(texts, pa.string()), *rb.columns[2:-1]], rb.schema.names[:-1])

    found = found.select("doc_id", "text", *names, "hits")
    return put_back(found.transform(in_arrow, cut, found.drop("hits").schema), docs)
