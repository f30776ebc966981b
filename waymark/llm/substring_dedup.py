"""Removal of word sequences that earlier documents hold (fixed-block anchors)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.exchange import Batch, Batches, Heard, Message, id_array
from waymark.llm.text import Words, covered, split


def remove_repeats(docs: DataFrame, window: int = 13, keep_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts in a document with a smaller doc_id.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, unchanged; windows are
    judged on the input. Every document's non-overlapping blocks of
    (window + 1) // 2 words are the index: any window holds a whole block of
    the document it is copied from, so each document's rolling windows of that
    width, probed against the blocks of all other documents, meet every
    repeat. Hits are then extended to all windows around them; adjacent
    windows that an earlier document holds form the maximal repeat. Windows
    are told apart by names of 96 bits, from two independent hashes.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined
    by a space), and kept with keep_text. A null text has no words; a null
    doc_id counts as the largest. Rows that repeat a doc_id stay separate rows
    and do not remove each other's words. Other columns are not carried.
    """
    block = (window + 1) // 2
    corpus = Batches(docs)
    short = np.uint64(24)  # probes are matched on 40 bits; a chance match only costs a look in the second round

    def probes(batch: Batch) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words = split(batch.buf, batch.offsets)
        h = words.hashes()
        at, key = words.windows(h, block)
        key = (key >> short) << short
        unique, place = np.unique(key, return_inverse=True)
        is_block = np.zeros(len(unique), bool)
        aligned = (at - words.first[words.doc[at]]) % block == 0
        is_block[place[aligned]] = True
        return words, h, at, unique, place, is_block

    def send_probes(batch: Batch, _: list[Heard]) -> Message:
        _, _, _, unique, _, is_block = probes(batch)
        return Message(unique, [is_block.astype(np.uint8)])

    def meet_probes(m: Message) -> np.ndarray:
        """Of each probe whether another batch has it too, and some document as a block."""
        _, place, count = np.unique(m.key, return_inverse=True, return_counts=True)
        blocks = np.bincount(place, m.columns[0], len(count)) > 0
        return ((count > 1) & blocks)[place]

    def windows(batch: Batch, heard: list[Heard]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows around hits: their starts, the distinct names (two hashes of 64 bits), each name's first doc and each window's name."""
        words, h, at, unique, place, is_block = probes(batch)
        hit = heard[0].values.astype(bool)
        docs = words.doc[at]
        low, high = np.full(len(unique), len(batch.ids)), np.full(len(unique), -1)
        np.minimum.at(low, place, docs)
        np.maximum.at(high, place, docs)
        hit |= is_block & (high > low)
        hits = np.zeros(len(h) + 1, np.int64)
        hits[at[hit[place]] + 1] = 1
        hits = np.cumsum(hits)
        start, key = words.windows(h, window)
        near = np.flatnonzero(hits[start + window - block + 1] > hits[start])
        other = words.windows(words.hashes(1), window)[1] if len(near) else key
        start, key, other = start[near], key[near], other[near]
        order = np.lexsort((start, other, key))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(other[order]) != 0)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        return words, start, key[first], other[first], words.doc[start[first]], place

    def send_windows(batch: Batch, heard: list[Heard]) -> Message:
        _, _, key, other, first, _ = windows(batch, heard)
        return Message(key, [(other >> np.uint64(32)).astype(np.uint32), batch.ids[first]])

    def meet_windows(m: Message) -> np.ndarray:
        """Of each window whether a smaller document has one of the same name, of 96 bits."""
        order = np.lexsort((m.columns[1], m.columns[0], m.key))
        key, other, ids = m.key[order], m.columns[0][order], m.columns[1][order]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key) != 0) | (np.diff(other) != 0)
        out = np.empty(len(order), bool)
        out[order] = ids[new][np.cumsum(new) - 1] < ids
        return out

    def finish(batch: Batch, heard: list[Heard]) -> Iterator[pa.RecordBatch]:
        words, start, _, _, first, place = windows(batch, heard)
        earlier = heard[1].values.astype(bool)
        gone = earlier[place] | (batch.ids[words.doc[start]] > batch.ids[first[place]])
        removed = covered(start[gone], window, len(words.start))
        texts, n, cut = [], [], []
        raw = batch.buf.tobytes()
        for d in range(len(batch.ids)):
            a, b = words.first[d], words.first[d + 1]
            keep = np.flatnonzero(~removed[a:b]) + a
            n.append(b - a)
            cut.append(b - a - len(keep))
            texts.append(b" ".join([raw[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)]))
        columns = [id_array(batch.ids), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if keep_text:
            columns, names = [*columns, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(columns, names)

    first = corpus.ask(send_probes, meet_probes)
    second = corpus.ask(send_windows, meet_windows, [first])
    return corpus.finish([first, second], finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
