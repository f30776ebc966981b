"""Packed batches of documents, and an exchange of packed hashes between them.

Operators that look for repeats over a whole corpus would have to shuffle a row
for every word or byte. Here documents are packed once into batches of about two
megabytes (a compressed row each, written to the shared folder). A batch sends
each hash it holds once, as sorted and compressed arrays, to the part of the
hash space the hash belongs to, by way of groups of batches where there are many
parts. There all batches' arrays meet, and the part answers each of them with one
small number per hash, in the order sent. The answers travel back to their batch,
which recomputes its hashes and applies them. A hash that a third of the corpus
shares is thus one entry per batch, never a row per occurrence, and no task holds
more than one part, one group or one batch.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.tables import in_arrow, stored
from waymark.llm.text import as_bytes, mix

#: Stands for a null doc_id: such rows count as the largest id.
NULL_ID = np.int64(2**63 - 1)
#: The path of a note that a batch sends to itself, and of a group's record of what it joined (with its path).
NOTE, _OWN = -2, -3
#: Bytes of text in a batch; a longer document is a batch of its own.
BATCH_BYTES = 2 << 20
#: Bytes of text whose hashes one part of the hash space holds, about.
PART_BYTES = 16 << 20
#: Rows that a batch sends at most; a hash space of more parts is reached in several steps.
FAN = 256


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as compressed bytes: differences of uint64 arrays (sorted ones become small), byte planes apart."""
    head, body = struct.pack("<B", len(arrays)), []
    for x in arrays:
        code = x.dtype.str.encode()
        head += struct.pack("<BI", len(code), len(x)) + code
        if x.dtype == np.uint64:
            x = np.diff(x, prepend=np.uint64(0))
        body.append(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() if len(x) else b"")
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, kinds, out = raw[0], 1, [], []
    for _ in range(n):
        size, length = struct.unpack_from("<BI", raw, at)
        kinds.append((np.dtype(raw[at + 5 : at + 5 + size].decode()), length))
        at += 5 + size
    for kind, length in kinds:
        planes = np.frombuffer(raw, np.uint8, length * kind.itemsize, at).reshape(kind.itemsize, length)
        at += length * kind.itemsize
        x = np.ascontiguousarray(planes.T).view(kind).reshape(length)
        out.append(np.cumsum(x, dtype=np.uint64) if kind == np.uint64 else x)
    return out


@dataclass
class Message:
    """What a batch asks: ascending keys, columns beside them, and maybe some bytes for each key. Where several senders' keys meet, each sender's ascend."""

    key: np.ndarray
    columns: list[np.ndarray]
    sizes: np.ndarray | None = None
    blob: np.ndarray | None = None

    def pack(self) -> bytes:
        extra = [] if self.sizes is None else [self.sizes, self.blob]
        return pack(np.array([len(self.columns), len(extra)], np.int64), self.key, *self.columns, *extra)

    @staticmethod
    def unpack(data: bytes) -> Message:
        (n, extra), key, *rest = unpack(data)
        return Message(key, rest[:n], *(rest[n : n + 2] if extra else ()))

    @staticmethod
    def join(parts: list[Message]) -> Message:
        together = lambda get: np.concatenate([get(x) for x in parts])
        columns = [together(lambda x, k=k: x.columns[k]) for k in range(len(parts[0].columns))]
        if parts[0].sizes is None:
            return Message(together(lambda x: x.key), columns)
        return Message(together(lambda x: x.key), columns, together(lambda x: x.sizes), together(lambda x: x.blob))

    def take(self, at: np.ndarray) -> Message:
        """The entries at some places, in that order."""
        if self.sizes is None:
            return Message(self.key[at], [c[at] for c in self.columns])
        start, size = np.cumsum(self.sizes) - self.sizes, self.sizes[at]
        return Message(self.key[at], [c[at] for c in self.columns], size, self.blob[np.repeat(start[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))])

    def weight(self, of_bytes: bool) -> np.ndarray:
        """How many answers each key gets: one, or one for each of its bytes."""
        return self.sizes if of_bytes else np.ones(len(self.key), np.int64)


@dataclass
class Heard:
    """A batch's answers of one round, in the order of what it sent, and the note it left for itself."""

    values: np.ndarray
    note: bytes | None


def digit(keys: np.ndarray, level: int, fan: int, levels: int) -> np.ndarray:
    """The keys' part at a level of the hash space, which is cut `fan` times at each of the levels; ascending keys have ascending parts."""
    part = ((keys >> np.uint64(32)) * np.uint64(fan**levels)) >> np.uint64(32)
    return (part // np.uint64(fan ** (levels - 1 - level)) % np.uint64(fan)).astype(np.int64)


class Batch:
    """Documents of one batch in ascending order of doc_id: ids, and the bytes and offsets of their texts."""

    def __init__(self, blob: bytes) -> None:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = struct.unpack_from("<I", raw)[0]
        self.ids = np.frombuffer(raw, np.int64, n, 4)
        self.offsets = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.int64, n, 4 + 8 * n))))
        self.buf = np.frombuffer(raw, np.uint8, -1, 4 + 16 * n) if len(raw) > 4 + 16 * n else np.zeros(0, np.uint8)

    @staticmethod
    def blob(ids: np.ndarray, texts: list[bytes]) -> bytes:
        order = np.argsort(ids, kind="stable")
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        head = struct.pack("<I", len(ids)) + ids[order].astype(np.int64).tobytes() + sizes.tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + b"".join(texts[i] for i in order))


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


class Batches:
    """A corpus as stored batches. parts: how many parts the hash space is cut into, in proportion to the corpus."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        def fill(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
            ids: list[int] = []
            texts: list[bytes] = []
            made = size = 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([task + made], pa.int64()), pa.array([size], pa.int64()), pa.array([Batch.blob(np.array(ids, np.int64), texts)], pa.large_binary())], ["batch", "bytes", "blob"])

            for rb in rows:
                buf, offsets = as_bytes(rb.column(1))
                for k, i in enumerate(rb.column(0).cast(pa.int64()).to_pylist()):
                    if ids and size + offsets[k + 1] - offsets[k] > BATCH_BYTES or len(ids) > 60_000:
                        yield flush()
                        ids, texts, size, made = [], [], 0, made + 1
                    ids.append(NULL_ID if i is None else i)
                    texts.append(buf[offsets[k] : offsets[k + 1]].tobytes())
                    size += int(offsets[k + 1] - offsets[k])
            if ids:
                yield flush()

        self.spark = docs.sparkSession
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        self.rows = stored(rows.transform(in_arrow, fill, "batch long, bytes long, blob binary"))
        size = self.rows.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
        parts = max(1, -(-(size["bytes"] or 0) // PART_BYTES))
        self.levels = max(1, math.ceil(math.log(parts, FAN) - 1e-9))
        self.fan = max(1, math.ceil(parts ** (1 / self.levels) - 1e-9))
        #: How many groups of senders there are at each level; each level joins about `fan` of them.
        self.groups = [max(1, -(-size["n"] // self.fan ** (k + 1))) for k in range(self.levels - 1)]
        self.tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.fan**self.levels)

    def ask(self, send: Callable[[Batch, list[Heard]], Message | tuple[Message, bytes]], answer: Callable[[Message], np.ndarray], heard: list[DataFrame] | None = None, of_bytes: bool = False) -> DataFrame:
        """Answers to what each batch sends.

        send(batch, answers so far) gives a message, and maybe a note that comes
        back as it is. answer(all that was sent to one part of the hash space)
        gives a small number for each key, or with of_bytes for each of its
        bytes. Where the hash space has more parts than a batch should send rows
        to, messages go by way of groups: those of some batches to the same
        coarse part are joined and cut again, and their answers taken apart, so
        that rows grow with the corpus and not with its square.
        """
        fan, levels, groups = self.fan, self.levels, self.groups
        heard = heard or []
        rounds = len(heard)

        def rows_of(m: Message, path: int, level: int, sender: int) -> Iterator[pa.RecordBatch]:
            own = digit(m.key, level, fan, levels)
            order = np.argsort(own, kind="stable")
            ends = np.cumsum(np.bincount(own, minlength=fan))
            found = [(path * fan + d, m.take(order[e - n : e]).pack()) for d, (e, n) in enumerate(zip(ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)) if n]
            group = int(mix(np.array([sender], np.uint64))[0]) % groups[level] if level < levels - 1 else 0
            for lo in range(0, len(found), 256):
                part = found[lo : lo + 256]
                yield _rows([x[0] for x in part], [group] * len(part), [sender] * len(part), [x[1] for x in part])

        def out(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, batch, before in _batches(rows, rounds):
                sent = send(batch, before)
                message, note = sent if isinstance(sent, tuple) else (sent, None)
                if note is not None:
                    yield _rows([NOTE], [number], [number], [note])
                yield from rows_of(message, 0, 0, number)

        def join(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
            def hop(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for (path, group), unit in _units(rows, 2):
                    if path == NOTE:
                        yield from (_rows([NOTE], [group], [s], [x]) for s, x in unit)
                        continue
                    parts = [Message.unpack(x) for _, x in unit]
                    counts = [np.bincount(digit(m.key, level, fan, levels), m.weight(of_bytes), fan).astype(np.int64) for m in parts]
                    yield _rows([_OWN - path], [group], [0], [pack(np.array([s for s, _ in unit], np.int64), np.concatenate(counts))])
                    yield from rows_of(Message.join(parts), path, level, group)

            return hop

        def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (path, _), unit in _units(rows, 2):
                if path == NOTE:
                    yield from (_answers([s], [NOTE], [x], [0]) for s, x in unit)
                    continue
                parts = [Message.unpack(x) for _, x in unit]
                found = answer(Message.join(parts)).astype(np.uint8)
                ends = np.cumsum([int(m.weight(of_bytes).sum()) for m in parts])
                each = np.split(found, ends[:-1])
                for lo in range(0, len(unit), 256):
                    yield _answers([s for s, _ in unit[lo : lo + 256]], [path] * len(unit[lo : lo + 256]), [pack(x) for x in each[lo : lo + 256]], [int(x.max(initial=0)) for x in each[lo : lo + 256]])

        def apart(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Answers of the parts below a group, taken apart for its senders. The group's own row comes first."""
            for (path, _), unit in _units(rows, 2):
                senders, counts = unpack(unit[0][1])
                counts = counts.reshape(len(senders), fan)
                pieces: list[list[np.ndarray]] = [[] for _ in senders]
                for piece, x in unit[1:]:
                    d = piece % fan
                    for k, values in enumerate(np.split(unpack(x)[0], np.cumsum(counts[:, d])[:-1])):
                        pieces[k].append(values)
                whole = [np.concatenate([np.zeros(0, np.uint8), *p]) for p in pieces]
                yield _answers(senders.tolist(), [path] * len(senders), [pack(x) for x in whole], [int(x.max(initial=0)) for x in whole])

        kind = "path long, grp long, sender long, payload binary"
        moved = self._with(heard).transform(in_arrow, out, kind)
        joined: list[DataFrame] = []
        for level in range(1, levels):
            moved = stored(moved.repartition(self.tasks, "path", "grp").sortWithinPartitions("path", "grp", "sender").transform(in_arrow, join(level), kind))
            joined.append(moved.where(F.col("path") <= _OWN).select((_OWN - F.col("path")).alias("path"), "grp", "payload"))
            moved = moved.where(F.col("path") > _OWN)
        found = stored(moved.repartition(self.tasks, "path", "grp").sortWithinPartitions("path", "grp", "sender").transform(in_arrow, meet, "sender long, path long, blob binary, most int"))
        for level in range(levels - 1, 0, -1):  # a part's answers go to the group that sent to it
            notes = found.where(F.col("path") == NOTE)
            up = found.where(F.col("path") != NOTE).select(F.floor(F.col("path") / fan).alias("path"), F.col("sender").alias("grp"), F.col("path").alias("piece"), F.col("blob").alias("payload"))
            own = joined[level - 1].select("path", "grp", F.lit(-1).cast("long").alias("piece"), "payload")
            back = own.union(up).repartition(self.tasks, "path", "grp").sortWithinPartitions("path", "grp", "piece")
            found = stored(back.transform(in_arrow, apart, "sender long, path long, blob binary, most int").union(notes))
        return found.withColumnRenamed("sender", "batch")

    def _with(self, heard: list[DataFrame]) -> DataFrame:
        rows = self.rows.select("batch", F.lit(-1).alias("round"), F.lit(0).cast("long").alias("path"), "blob")
        if not heard:
            return rows
        for k, df in enumerate(heard):
            rows = rows.union(df.select("batch", F.lit(k).alias("round"), "path", "blob"))
        return rows.repartition(self.tasks, "batch").sortWithinPartitions("batch", "round", "path")

    def finish(self, heard: list[DataFrame], each: Callable[[Batch, list[Heard]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """Rows made from each batch and its answers."""
        rounds = len(heard)

        def out(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, batch, before in _batches(rows, rounds):
                yield from each(batch, before)

        return self._with(heard).transform(in_arrow, out, schema)


def _rows(path: list[int], group: list[int], sender: list[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(path, pa.int64()), pa.array(group, pa.int64()), pa.array(sender, pa.int64()), pa.array(payload, pa.binary())], ["path", "grp", "sender", "payload"])


def _answers(sender: list[int], path: list[int], blob: list[bytes], most: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sender, pa.int64()), pa.array(path, pa.int64()), pa.array(blob, pa.binary()), pa.array(most, pa.int32())], ["sender", "path", "blob", "most"])


def _units(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Sorted rows that agree in their first `width` columns: those, and the rest of each."""
    key, unit = None, []
    for rb in rows:
        for row in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if row[:width] != key:
                if unit:
                    yield key, unit
                key, unit = row[:width], []
            unit.append(row[width:])
    if unit:
        yield key, unit


def _batches(rows: Iterator[pa.RecordBatch], rounds: int) -> Iterator[tuple[int, Batch, list[Heard]]]:
    """Each batch with its answers by round; a batch's own row comes before them, and a round's note before its answers."""
    for (number,), unit in _units(rows, 1):
        heard = []
        for k in range(rounds):
            own = [(path, x) for r, path, x in unit if r == k]
            note = next((x for path, x in own if path == NOTE), None)
            heard.append(Heard(np.concatenate([np.zeros(0, np.uint8), *[unpack(x)[0] for path, x in own if path != NOTE]]), note))
        yield number, Batch(unit[0][2]), heard
