"""Line dedup with content-defined chunks: repeated multi-line chunks are removed from all but their first place, by content-defined chunks or at every line."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.exchange import Batch, Batches, Heard, Message, id_array
from waymark.llm.text import equal_spans, hash_spans, mix, rolling

#: A chunk ends where the rolling hash of its last lines is divisible by this, and after so many lines at most.
DIVISOR, MOST_LINES = 4, 64
_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint8)


def _lines(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (without the newline) of all lines, and how many come before each document. An empty text has one empty line."""
    breaks = np.flatnonzero(batch.buf == 10)
    start = np.sort(np.concatenate((batch.offsets[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((breaks, batch.offsets[1:])), kind="stable")
    before = np.arange(len(batch.offsets)) + np.searchsorted(breaks, batch.offsets, "left")
    return start, end, before


def _chunks(batch: Batch, window: int) -> tuple[np.ndarray, ...]:
    """Lines' starts, ends and counts before each document; chunks' first line, last + 1 line, document and hash."""
    start, end, before = _lines(batch)
    h = hash_spans(batch.buf, start, end)
    doc = np.repeat(np.arange(len(batch.ids)), np.diff(before))
    cut = np.zeros(len(h), bool)
    roll = rolling(h, window)
    cut[window - 1 :] = roll % np.uint64(DIVISOR) == 0
    same = doc[window - 1 :] == doc[: len(roll)]
    cut[window - 1 :] &= same
    cut[before[1:] - 1] = True
    ends = np.flatnonzero(cut) + 1
    begins = np.concatenate(([0], ends[:-1]))
    long = np.flatnonzero(ends - begins > MOST_LINES)
    if len(long):
        more = np.concatenate([np.arange(begins[k] + MOST_LINES, ends[k], MOST_LINES) for k in long])
        ends = np.sort(np.concatenate((ends, more)))
        begins = np.concatenate(([0], ends[:-1]))
    key = mix(hash_spans(batch.buf, start[begins], end[ends - 1]) + (ends - begins).astype(np.uint64))
    return start, end, before, begins, ends, doc[begins], key


def _passages(batch: Batch, start: np.ndarray, end: np.ndarray, before: np.ndarray, lines: int) -> tuple[np.ndarray, ...]:
    """First line, last + 1 line, document and hash of every passage of so many lines with words in a row, and any blank ones between."""
    solid = np.concatenate(([0], np.cumsum(~np.isin(batch.buf, _SPACES))))
    full = np.flatnonzero(solid[end] > solid[start])
    doc = np.searchsorted(before, full, "right") - 1
    n = max(0, len(full) - lines + 1)
    own = np.flatnonzero(doc[:n] == doc[lines - 1 : lines - 1 + n])
    begins, ends = full[own], full[own + lines - 1] + 1
    return begins, ends, doc[own], mix(hash_spans(batch.buf, start[begins], end[ends - 1]) + (ends - begins).astype(np.uint64))


def remove_chunks(docs: DataFrame, window: int = 2, least_lines: int = 2, keep_text: bool = False, anywhere: bool = False) -> DataFrame:
    """Cut every text at its newlines into chunks and remove those of `least_lines` lines or more whose bytes stand earlier in the corpus.

    A chunk ends where a rolling hash over the hashes of its last `window`
    lines says so, so boundaries shift with the text; every document's last
    line ends one. Earlier is a smaller doc_id, or the same document further
    up. A chunk is only removed after its bytes were compared with those of
    the first.

    With a boundary at every fourth line or so, most short passages inside
    otherwise different documents share no chunk. With `anywhere` a unit starts
    at every line instead: each passage of `least_lines` lines with words that
    stands earlier goes, so every repeated passage of that length or more does,
    wherever it lies; one that overlaps its own first place is left. n_chunks
    still counts chunks.

    Returns doc_id, n_lines, n_removed (lines), n_chunks, kept_sha256, and kept
    (text) with keep_text. A null text is an empty one, of one empty line. A
    null doc_id counts as the largest; rows that repeat a doc_id count as its
    text several times. Other columns are not carried.
    """
    corpus = Batches(docs)

    def kinds(batch: Batch) -> tuple:
        start, end, before, begins, ends, doc, key = _chunks(batch, window)
        if anywhere:
            begins, ends, doc, key = _passages(batch, start, end, before, least_lines)
        wide = np.flatnonzero(ends - begins >= least_lines)
        unique, first, place = np.unique(key[wide], return_index=True, return_inverse=True)
        return start, end, before, begins, ends, doc, wide, unique, wide[first], place

    def raw(batch: Batch, start: np.ndarray, end: np.ndarray, begins: np.ndarray, ends: np.ndarray, c: int) -> bytes:
        return batch.buf[start[begins[c]] : end[ends[c] - 1]].tobytes()

    def send_keys(batch: Batch, _: list[Heard]) -> Message:
        _, _, _, _, _, doc, _, unique, first, _ = kinds(batch)
        return Message(unique, [batch.ids[doc[first]], first.astype(np.int64)])

    def meet_keys(m: Message) -> np.ndarray:
        """Of each key: 0 one batch has it, 1 this batch has the first, 2 another one does."""
        order = np.lexsort((np.arange(len(m.key)), m.columns[1], m.columns[0], m.key))
        k = m.key[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        many = np.bincount(group, minlength=1) > 1
        state = np.zeros(len(k), np.uint8)
        state[order] = np.where(many[group], np.where(new, 1, 2), 0)
        return state

    def send_bytes(batch: Batch, heard: list[Heard]) -> Message:
        start, end, _, begins, ends, _, _, unique, first, _ = kinds(batch)
        state = heard[0].values
        sent = np.flatnonzero(state)
        texts = [raw(batch, start, end, begins, ends, c) for c in first[sent]]
        return Message(unique[sent], [state[sent]], np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))

    def meet_bytes(m: Message) -> np.ndarray:
        """For each key sent, whether its bytes are those of the first."""
        stop = np.cumsum(m.sizes)
        firsts = np.flatnonzero(m.columns[0] == 1)
        firsts = firsts[np.argsort(m.key[firsts], kind="stable")]
        at = firsts[np.minimum(np.searchsorted(m.key[firsts], m.key), len(firsts) - 1)]
        return (m.key[at] == m.key) & equal_spans(m.blob, stop - m.sizes, stop, (stop - m.sizes)[at], stop[at])

    def finish(batch: Batch, heard: list[Heard]) -> Iterator[pa.RecordBatch]:
        start, end, before, begins, ends, doc, wide, unique, first, place = kinds(batch)
        state = heard[0].values
        equal = np.zeros(len(unique), bool)
        equal[np.flatnonzero(state)] = heard[1].values.astype(bool)
        gone = np.zeros(len(begins), bool)
        again = (state[place] == 2) | (wide != first[place])
        for c, k in zip(wide[again].tolist(), place[again].tolist(), strict=True):
            if c == first[k]:
                gone[c] = equal[k]
            elif state[k] != 2 or equal[k]:
                apart = state[k] == 2 or doc[c] != doc[first[k]] or begins[c] >= ends[first[k]]
                gone[c] = apart and raw(batch, start, end, begins, ends, c) == raw(batch, start, end, begins, ends, int(first[k]))
        edges = np.bincount(begins[gone], minlength=len(start) + 1) - np.bincount(ends[gone], minlength=len(start) + 1)
        removed = np.cumsum(edges)[:-1] > 0
        if anywhere:
            begins = _chunks(batch, window)[3]
        chunks = np.diff(np.searchsorted(begins, before))
        n, cut, texts = np.diff(before), [], []
        for d in range(len(batch.ids)):
            own = np.arange(before[d], before[d + 1])
            keep = own[~removed[own]]
            cut.append(len(own) - len(keep))
            texts.append(batch.buf[batch.offsets[d] : batch.offsets[d + 1]].tobytes() if len(keep) == len(own) else b"\n".join(batch.buf[start[i] : end[i]].tobytes() for i in keep))
        columns = [id_array(batch.ids), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(chunks, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
        names = ["doc_id", "n_lines", "n_removed", "n_chunks", "kept_sha256"]
        if keep_text:
            columns, names = [*columns, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(columns, names)

    known = corpus.ask(send_keys, meet_keys)
    compared = corpus.ask(send_bytes, meet_bytes, [known])
    return corpus.finish([known, compared], finish, "doc_id long, n_lines long, n_removed long, n_chunks long, kept_sha256 string" + ", kept string" * keep_text)
