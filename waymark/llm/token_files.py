"""Token ids in binary: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

A file is a folder. `ranks` holds each id's rank by frequency (count
descending, then id). `blocks` holds, per shard and block in ascending order of
doc_id, the documents' ids and sizes and two byte streams: a control byte for
every four token ids, two bits each with the length of its rank less one, and
the ranks themselves in that many little-endian bytes. Frequent tokens so take
one byte. Both tables are written by Spark's own writer, whose commits survive
lost executors and which reaches any store the cluster has.
"""

from __future__ import annotations

import json
import os
import re
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.tables import give_back, in_arrow, shared_folder, shrink, stored
from waymark.llm.text import SPACES, Words, as_bytes, equal_spans, slices, split

#: Token ids in a block, about; a document is never divided.
BLOCK_IDS = 1 << 19
#: Bytes of text whose words are encoded together, for each of which a worker takes some 16 at once, and words in one call of the tokenizer.
SLICE_WORDS_BYTES, WORDS_AT_ONCE = 1 << 20, 5_000
#: Token ids that are counted at once, about.
COUNT_IDS = 1 << 20
#: Bytes of encoded words that a worker holds, about; when there are more it begins anew.
HELD_BYTES = 64 << 20
#: Token ids in a shard of the files, about.
SHARD_IDS = 1 << 25

# Patterns of a Split step that match no white space.
_CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_PATTERNS = {_CONTRACTIONS, r"\w+|[^\w\s]+", r"\S+"}

_KEY_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def _by_word(tokenizer: dict) -> bool:
    """Whether a tokenizer's own description says that it drops white space and looks at nothing across it."""
    steps = lambda x, key: [] if x is None else x[key] if x["type"] == "Sequence" else [x]
    spaces_only = lambda x: x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " "
    pre = steps(tokenizer.get("pre_tokenizer"), "pretokenizers")
    if not pre or not all(x["type"] in ("NFC", "NFD", "Lowercase") or spaces_only(x) for x in steps(tokenizer.get("normalizer"), "normalizers")):
        return False
    split = pre[0]["type"] in ("Whitespace", "WhitespaceSplit") or (
        pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and pre[0]["pattern"].get("Regex") in _WORD_PATTERNS
    )
    within = all(x["type"] in ("Digits", "Punctuation") or x["type"] == "ByteLevel" and not x.get("add_prefix_space") for x in pre[1:])
    plain = all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) and not re.search(r"\s", x["content"]) for x in tokenizer.get("added_tokens") or [])
    return split and within and plain


def _ends(tokenizer: dict) -> np.ndarray | None:
    """Of each id whether it ends a piece, where the model marks that and pieces are runs of letters, of punctuation, or contractions; else None."""
    suffix, vocabulary = tokenizer["model"].get("end_of_word_suffix"), tokenizer["model"].get("vocab")
    pre = tokenizer["pre_tokenizer"]
    split = pre["pretokenizers"][0] if pre["type"] == "Sequence" else pre
    if not suffix or tokenizer["model"].get("type") != "BPE" or split.get("pattern") != {"Regex": _CONTRACTIONS}:
        return None
    out = np.zeros(1 + max([*vocabulary.values(), *(x["id"] for x in tokenizer.get("added_tokens") or [])]), bool)
    out[[k for x, k in vocabulary.items() if x.endswith(suffix)]] = True
    return out


class _Encoder:
    """A tokenizer file, and the words it has encoded of late: their hashes in order, bytes and ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        self.by_word = _by_word(own)
        self.added = [x["content"] for x in own.get("added_tokens") or []]
        self.is_end = _ends(own) if self.by_word else None
        self.clear()
        del own
        give_back()

    def clear(self) -> None:
        self.key, self.raw, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.start, self.end, self.first, self.size = (np.zeros(0, np.int64) for _ in range(4))

    def whole(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            yield np.array(self.encode_batch([text], add_special_tokens=False)[0].ids, np.uint32)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some words, where each word's begin among them, and how many it has."""
        pool, first, size = [np.zeros(0, np.uint32)], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        done, slow = 0, list(range(len(words)))
        if self.is_end is not None:
            # letters with punctuation at the ends are split just there, and each piece ends with a token of its own kind
            core = [w.strip(string.punctuation) for w in words]
            slow = [k for k, (w, c) in enumerate(zip(words, core, strict=True)) if not c.isalpha() or w[0] == "'"]
            fast = np.delete(np.arange(len(words)), slow)
            pieces = np.array([1 + (words[k][0] != core[k][0]) + (words[k][-1] != core[k][-1]) for k in fast.tolist()], np.int64)
            for lo in range(0, len(fast), WORDS_AT_ONCE // 10):
                part, last = fast[lo : lo + WORDS_AT_ONCE // 10], np.cumsum(pieces[lo : lo + WORDS_AT_ONCE // 10]) - 1
                text = " ".join([words[k] for k in part.tolist()])
                ids = np.array(self.encode_batch([text], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.is_end[ids])
                if len(ends) != last[-1] + 1 or ends[-1] != len(ids) - 1 or any(x in text for x in self.added):
                    slow += part.tolist()  # the tokenizer sees other pieces in one of the words
                    continue
                stop = ends[last] + 1
                size[part] = np.diff(stop, prepend=0)
                first[part] = done + stop - size[part]
                pool.append(ids)
                done += len(ids)
        for lo in range(0, len(slow), WORDS_AT_ONCE):
            part = slow[lo : lo + WORDS_AT_ONCE]
            e = self.tokenizer.encode_batch([[words[k] for k in part]], is_pretokenized=True, add_special_tokens=False)[0]
            n = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            size[part], first[part] = n, done + np.cumsum(n) - n
            pool.append(np.array(e.ids, np.uint32))
            done += len(e.ids)
        return np.concatenate(pool), first, size

    def words(self, w: Words) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of all words, one after another, and how many each has; None if two different words share a hash."""
        unique, at, place = np.unique(w.hashes(), return_index=True, return_inverse=True)
        start, end = w.start[at], w.end[at]
        if not equal_spans(w.buf, w.start, w.end, start[place], end[place]).all():
            return None
        if self.key.nbytes * 5 + self.raw.nbytes + self.pool.nbytes > HELD_BYTES:
            self.clear()
        held = np.minimum(np.searchsorted(self.key, unique), max(0, len(self.key) - 1))
        known = self.key[held] == unique if len(self.key) else np.zeros(len(unique), bool)
        taken = known.copy()  # the hash, if not the word
        k = np.flatnonzero(known)
        known[k] = equal_spans(w.buf, start[k], end[k], self.start[held[k]], self.end[held[k]], self.raw)
        new = np.flatnonzero(~known)
        raw = w.buf.tobytes()
        own, begin, count = self.encoded([raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
        pool = np.concatenate((self.pool, own))
        first, size = np.empty(len(unique), np.int64), np.empty(len(unique), np.int64)
        first[known], size[known] = self.first[held[known]], self.size[held[known]]
        first[new], size[new] = len(self.pool) + begin, count
        each = size[place]
        ends = np.cumsum(each)
        ids = pool[np.repeat(first[place] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        self._hold(w, unique, start, end, first, size, pool, new[~taken[new]])
        return ids, each

    def _hold(self, w: Words, key: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, size: np.ndarray, pool: np.ndarray, new: np.ndarray) -> None:
        width = end[new] - start[new]
        to = np.cumsum(width) - width
        text = w.buf[np.repeat(start[new] - to, width) + np.arange(int(width.sum()))]
        self.start = np.concatenate((self.start, to + len(self.raw)))
        self.end = np.concatenate((self.end, to + width + len(self.raw)))
        self.raw, self.pool = np.concatenate((self.raw, text)), pool
        self.key, self.first, self.size = np.concatenate((self.key, key[new])), np.concatenate((self.first, first[new])), np.concatenate((self.size, size[new]))
        order = np.argsort(self.key, kind="stable")  # two runs in order: merged
        self.key, self.start, self.end, self.first, self.size = (x[order] for x in (self.key, self.start, self.end, self.first, self.size))


_encoders: dict[str, _Encoder] = {}


def token_ids(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text, as the tokenizer gives them without special tokens.

    Where the tokenizer drops white space and never looks across it, different
    words between ASCII white space are encoded once and kept for later texts:
    found by hash, and their bytes compared. Any other tokenizer, and a slice
    in which two words share a hash, is encoded text by text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    encoder = _encoders[path]
    buf, offsets = as_bytes(texts)
    for i, j in slices(offsets, SLICE_WORDS_BYTES):
        w = split(buf[offsets[i] : offsets[j]], offsets[i : j + 1], SPACES) if encoder.by_word else None
        found = encoder.words(w) if w is not None else None
        if found is None:
            yield from encoder.whole([buf[offsets[d] : offsets[d + 1]].tobytes().decode() for d in range(i, j)])
            continue
        ids, each = found
        total = np.concatenate(([0], np.cumsum(each)))
        for d in range(j - i):
            yield ids[total[w.first[d]] : total[w.first[d + 1]]]


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of some ranks below 2**32."""
    ranks = ranks.astype("<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks: a table gives the four lengths of each control byte, their sums where each rank's bytes start."""
    length = _KEY_LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(length) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = raw[at] if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        out = out | np.where(length > k, raw[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> str:
    """Encode every text with the tokenizer file, append end_id to each, write the files in ascending doc_id order and return their folder.

    doc_id is cast to long (an error where it can't be). A null or empty text
    is the end id alone; null doc_ids come last; rows with the same doc_id
    follow each other in the order of a hash of their ids. A text of any length
    is one row and never divided, so it must fit a worker's memory, and its ids
    2 GB as bytes. Ids are below 2**32. Other columns, whatever their names,
    are not read. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    shrink(spark)  # the workers' tokenizers and words are to lie beside the executors' heaps

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for rb in batches:
            out, size = [], []
            for ids in token_ids(rb.column(1), tokenizer):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                planes = ids.view(np.uint8).reshape(-1, 4).T.tobytes()
                out.append(press.compress(planes))
                size.append(len(ids))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(size, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(rows.transform(in_arrow, tokens, "doc_id long, n long, ids binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(0, np.int64), [], 0
        unpack = _Unpacker()

        def added() -> np.ndarray:
            c = np.bincount(np.concatenate(held)) if held else total[:0]
            out = np.append(total, np.zeros(max(0, len(c) - len(total)), np.int64))
            out[: len(c)] += c
            return out

        for rb in batches:
            for x in rb.column(0):
                held.append(unpack(x.as_py()))
                size += len(held[-1])
                if size >= COUNT_IDS:
                    total, held, size = added(), [], 0
        total = added()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    # as many rows as the vocabulary has ids: bounded, whatever the corpus
    counts = rows.select("ids").transform(in_arrow, count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ranked = sorted((-r["n"], r["id"]) for r in counts)
    spark.createDataFrame([(k, i, -n) for k, (n, i) in enumerate(ranked)], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    table = np.zeros(max((i for _, i in ranked), default=0) + 1, np.uint32)
    for k, (_, i) in enumerate(ranked):
        table[i] = k
    rank = spark.sparkContext.broadcast(table)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unpack = _Unpacker()
        shard, number, doc_ids, parts, held, done = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            control, data = encode(rank.value[np.concatenate(parts)])
            sizes = np.array([len(x) for x in parts], "<i8")
            columns = [[shard], [number], [done], [held], [doc_ids], [sizes.tolist()], [control], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "first", "n", "doc_ids", "sizes", "control", "data"])

        for rb in batches:
            for d, x in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                ids = unpack(x)
                if parts and held + len(ids) > BLOCK_IDS:
                    yield flush()
                    doc_ids, parts, held, number, done = [], [], 0, number + 1, done + held
                doc_ids.append(d)
                parts.append(ids)
                held += len(ids)
        if parts:
            yield flush()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["n"] for r in counts) // SHARD_IDS))
    # the hash lets rows of one doc_id, as all null ones, lie in several shards
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("ids")]
    ordered = rows.select("doc_id", "ids").repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.transform(in_arrow, blocks, "shard long, block long, first long, n long, doc_ids array<long>, sizes array<long>, control binary, data binary").write.parquet(f"{path}/blocks")
    return path


class _Unpacker:
    """The ids of a packed row."""

    def __init__(self) -> None:
        self.zstd = zstandard.ZstdDecompressor()

    def __call__(self, packed: bytes) -> np.ndarray:
        raw = np.frombuffer(self.zstd.decompress(packed), np.uint8)
        return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """The files' documents: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids with keep_ids."""
    files = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()
    ids_of = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], np.uint32))
    # one row a shard: as many as the writer had partitions
    starts, total = {}, 0
    for r in files.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():
        starts[r["shard"]] = total
        total += r["n"]
    before = spark.sparkContext.broadcast(starts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for r in range(rb.num_rows):
                shard, first, n, docs, sizes, control, data = (c[r].as_py() for c in rb.columns)
                ids = ids_of.value[decode(control, data, n)].astype("<u4")
                ends = np.cumsum(sizes)
                each = np.split(ids, ends[:-1])
                columns = [pa.array(docs, pa.int64()), pa.array(before.value[shard] + first + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array([x.tolist() for x in each], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return files.select("shard", "first", "n", "doc_ids", "sizes", "control", "data").transform(in_arrow, rows, schema)
