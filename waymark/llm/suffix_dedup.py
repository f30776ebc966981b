"""Removal of byte strings that occur earlier in the corpus (longest-previous-factor arrays)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.exchange import Batch, Batches, Heard, Message, id_array, pack, unpack
from waymark.llm.text import SLICE_BYTES, covered, hash_spans, mix, rolling

_GRAM = 32
#: Anchors need not be told apart for certain: 48 bits of their hashes are sent.
_ANCHOR_BITS = np.uint64(0xFFFFFFFFFFFF0000)
#: Kinds of runs with one anchor that one suffix array takes; windows around commoner anchors meet one by one.
MANY_KINDS = 4096
#: A byte that UTF-8 never has: it ends each segment in a suffix array.
_END = 0xFF


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, ties by position, and the rank of each (from 1; equal keys have equal ranks)."""
    order = np.argsort(key)
    by_key = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0) + 1
    rank = np.empty(len(key), np.int64)
    rank[order] = by_key
    order = (np.sort((by_key.astype(np.uint64) << np.uint64(32)) | order.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return order, rank


def _ranks(data: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by prefixes of 7, 14, 28 ... bytes; the last is at most `most` and over half of it."""
    n = len(data)
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)))  # 0: past the end
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + n]
    size, levels = 7, [(7, _ordered(key)[1])]
    while 2 * size <= most:
        levels.append((2 * size, _ordered(_pairs(levels[-1][1], size, np.arange(n)))[1]))
        size *= 2
    return levels


def _pairs(rank: np.ndarray, shift: int, at: np.ndarray) -> np.ndarray:
    """The ranks at the given places and `shift` after them, as one key each (0: past the end)."""
    after = np.zeros(len(at), np.int64)
    ok = at + shift < len(rank)
    after[ok] = rank[at[ok] + shift]
    return (rank[at].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)


def _nearest_smaller(sa: np.ndarray) -> np.ndarray:
    """For each place in suffix order the nearest one before it whose position is smaller, or -1, by pointer jumping."""
    near = np.arange(len(sa)) - 1
    live = np.flatnonzero(near >= 0)
    while len(live):
        live = live[sa[near[live]] > sa[live]]
        near[live] = near[near[live]]
        live = live[near[live] >= 0]
    return near


def _smaller_neighbours(order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(suffix, neighbour) in suffix order: previous and next suffix with a smaller position (-1: none)."""
    out = []
    for sa in (order, order[::-1]):
        near = _nearest_smaller(sa)
        out.append((sa, np.where(near >= 0, sa[near], -1)))
    return out


def longest_previous_factor(data: np.ndarray, most: int, starts: np.ndarray | None = None) -> np.ndarray:
    """For each start (every place by default) the length of its longest match with an earlier start, exact up to `most` (14 at least).

    The longest match of a suffix with an earlier one is with one of two
    neighbours in suffix order: the nearest before it and the nearest after it
    whose position is smaller.
    """
    n = len(data)
    starts = np.arange(n) if starts is None else starts
    if not len(starts):
        return np.zeros(0, np.int64)
    levels = _ranks(data, most)
    size, rank = levels[-1]
    order, _ = _ordered(_pairs(rank, most - size, starts))
    out = np.zeros(len(starts), np.int64)
    for i, j in _smaller_neighbours(order):
        i, j = i[j >= 0], j[j >= 0]
        a, b = starts[i], starts[j]
        match = np.zeros(len(i), np.int64)
        for step, rank in [levels[-1], *reversed(levels), *[(1, data)] * 6]:
            inside = np.maximum(a, b) + match < n
            same = inside & (rank[np.minimum(a + match, n - 1)] == rank[np.minimum(b + match, n - 1)])
            match += step * same
        out[i] = np.maximum(out[i], match)
    return np.minimum(out, most)


@dataclass
class _Runs:
    """Runs of window starts with one anchor: first and last start, the anchor's place, document, anchor hash and two hashes of all their bytes."""

    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray
    other: np.ndarray


def _runs(batch: Batch, length: int) -> _Runs:
    gram = min(_GRAM, length)
    width = length - gram + 1
    found: list[tuple[np.ndarray, ...]] = []
    step = SLICE_BYTES // 8  # the arrays of a step stay in cache
    total = len(batch.buf)
    for lo in range(0, max(0, total - length + 1), step):  # window starts lo .. lo + step
        data = batch.buf[lo : lo + step + length - 1]
        grams = rolling(data.astype(np.uint64) + np.uint64(1), gram)
        key = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        least, have = key, 1
        while 2 * have <= width:
            least = np.minimum(least[: len(least) - have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.arange(len(at)) + lo
        doc = np.searchsorted(batch.offsets, start, "right") - 1
        inside = start + length <= batch.offsets[doc + 1]
        start, doc, at = start[inside], doc[inside], at[inside]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (np.diff(at) != 0) | (np.diff(doc) != 0) | (np.diff(start) != 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(start)) - 1
        place = start[a] - at[a] - lo
        whole, other = (hash_spans(batch.buf, start[a], start[b] + length, seed) ^ mix((place + width).astype(np.uint64)) for seed in (0, 1))
        found.append((start[a], start[b], at[a] + lo, doc[a], mix(grams[at[a]]) & _ANCHOR_BITS, whole, other))  # mixed again: anchors are small hashes
    if not found:
        return _Runs(*(np.zeros(0, t) for t in (*[np.int64] * 4, *[np.uint64] * 3)))
    return _Runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = False) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts earlier: in a smaller doc_id, or earlier in the same document.

    Texts are UTF-8 bytes; matches never cross documents, overlaps count, and
    strings are judged on the input. A window's anchor is its least hashed
    32-byte gram, so equal windows have equal anchors at equal places and meet
    in one part of the hash space, in runs of window starts that share an
    anchor. Runs with equal bytes (by a name of 96 bits) are settled by their order alone. Where
    different runs share an anchor, the first of each kind goes into a suffix
    array with the others in corpus order; its longest-previous-factor array,
    from previous and next smaller positions in suffix order, tells which
    windows start earlier. An anchor with more than MANY_KINDS kinds, as the
    end of a line that a great part of the corpus has, would make one task; its
    windows are spread by a name of 96 bits of their bytes and meet there.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, and kept (binary) with keep_text. A null text is empty; a
    null doc_id counts as the largest. Rows with the same doc_id are one
    document's place twice: neither is smaller, and they are ordered by
    position in the text, then arbitrarily. Other columns are not carried.
    """
    corpus = Batches(docs)

    def kinds(batch: Batch) -> tuple[_Runs, np.ndarray, np.ndarray]:
        """Runs; of the distinct (anchor, whole, other) in order the run that comes first; and each run's kind."""
        runs = _runs(batch, length)
        order = np.lexsort((runs.first, runs.other, runs.whole, runs.anchor))
        a, w, o = runs.anchor[order], runs.whole[order], runs.other[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1]) | (o[1:] != o[:-1])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        return runs, order[new], kind

    def place(batch: Batch, runs: _Runs, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return batch.ids[runs.doc[which]], runs.first[which] - batch.offsets[runs.doc[which]]

    def send_kinds(batch: Batch, _: list[Heard]) -> tuple[Message, bytes]:
        runs, first, kind = kinds(batch)
        ids, at = place(batch, runs, first)
        note = pack(runs.first.astype(np.uint64), (runs.last - runs.first).astype(np.int32), (runs.at - runs.first).astype(np.int32), kind.astype(np.int32))
        # these hashes are not in order, so only the anchors gain from differences
        return Message(runs.anchor[first], [runs.whole[first].view(np.int64), (runs.other[first] >> np.uint64(32)).astype(np.uint32), ids, at.astype(np.int64)]), note

    def meet_kinds(m: Message) -> np.ndarray:
        """Of each kind: 0 nothing to do, 1 an earlier run has the same bytes, 2 the first of several kinds, 3 the first of very many."""
        whole, other, ids, at = m.columns
        order = np.lexsort((np.arange(len(m.key)), at, ids, other, whole, m.key))
        a, w, o = m.key[order], whole[order], other[order]
        new_anchor = np.ones(len(order), bool)
        new_anchor[1:] = a[1:] != a[:-1]
        new = new_anchor.copy()
        new[1:] |= (w[1:] != w[:-1]) | (o[1:] != o[:-1])
        group = np.cumsum(new_anchor) - 1
        kinds = np.bincount(group, new)
        todo = np.where(kinds > MANY_KINDS, 3, np.where(kinds > 1, 2, 0))
        state = np.zeros(len(order), np.uint8)
        state[order] = np.where(new, todo[group], 1)
        return state

    def told(batch: Batch, heard: list[Heard], wanted: int) -> tuple[_Runs, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs, the first of each kind, each run's kind, the kinds' states, and the first runs of those in the wanted state, by anchor."""
        starts, more, at, kind = unpack(heard[0].note)
        starts = starts.astype(np.int64)
        doc = np.searchsorted(batch.offsets, starts, "right") - 1
        none = np.zeros(0, np.uint64)
        runs = _Runs(starts, starts + more, starts + at, doc, np.zeros(len(starts), np.uint64), none, none)
        first = np.unique(kind, return_index=True)[1]
        state = heard[0].values
        chosen = np.sort(first[state == wanted])
        runs.anchor[chosen] = hash_spans(batch.buf, runs.at[chosen], runs.at[chosen] + min(_GRAM, length))
        return runs, first, kind, state, chosen[np.argsort(runs.anchor[chosen], kind="stable")]

    def send_segments(batch: Batch, heard: list[Heard]) -> Message:
        runs, _, _, _, chosen = told(batch, heard, 2)
        ids, at = place(batch, runs, chosen)
        size = runs.last[chosen] - runs.first[chosen] + length
        text = batch.buf[np.repeat(runs.first[chosen] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        return Message(runs.anchor[chosen], [ids, at.astype(np.int64)], size.astype(np.int64), text)

    def meet_segments(m: Message) -> np.ndarray:
        """For each window start of each segment, whether it starts earlier in a segment with the same anchor."""
        ids, at = m.columns
        begin = np.cumsum(m.sizes) - m.sizes
        order = np.lexsort((at, ids, m.key))
        gone = np.zeros(len(m.blob), bool)
        lo = 0
        ends = np.cumsum(m.sizes[order] + 1)
        same = np.flatnonzero(np.append(np.diff(m.key[order]) != 0, True)) + 1  # after each anchor's last segment
        while lo < len(order):  # whole anchors, as many as make about SLICE_BYTES
            k = int(np.searchsorted(ends[same - 1], (ends[lo - 1] if lo else 0) + SLICE_BYTES, "right"))
            hi = int(same[min(max(k - 1, int(np.searchsorted(same, lo, "right"))), len(same) - 1)])
            take = order[lo:hi]
            total = m.sizes[take] + 1
            at_data = np.cumsum(total) - total
            place = np.arange(total.sum()) - np.repeat(at_data, total)
            data = np.append(m.blob, np.uint8(0))[np.minimum(np.repeat(begin[take], total) + place, len(m.blob))]
            data[at_data + total - 1] = _END
            starts = np.flatnonzero(place <= np.repeat(m.sizes[take], total) - length)
            found = starts[longest_previous_factor(data, length, starts) >= length]
            gone[np.repeat(begin[take], total)[found] + place[found]] = True
            lo = hi
        return gone

    def hot_windows(batch: Batch, heard: list[Heard]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The window starts of runs whose anchor has very many kinds; of the distinct names (two hashes) both, the first start, and each start's name."""
        runs, _, _, _, chosen = told(batch, heard, 3)
        size = runs.last[chosen] - runs.first[chosen] + 1
        start = np.unique(np.repeat(runs.first[chosen] - (np.cumsum(size) - size), size) + np.arange(int(size.sum())))
        key, other = (hash_spans(batch.buf, start, start + length, seed) for seed in (0, 1))
        order = np.lexsort((start, other, key))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(other[order]) != 0)
        name = np.empty(len(order), np.int64)
        name[order] = np.cumsum(new) - 1
        first = order[new]
        return start, key[first], other[first], start[first], name

    def send_hot(batch: Batch, heard: list[Heard]) -> Message:
        _, key, other, first, _ = hot_windows(batch, heard)
        doc = np.searchsorted(batch.offsets, first, "right") - 1
        return Message(key, [(other >> np.uint64(32)).astype(np.uint32), batch.ids[doc], first - batch.offsets[doc]])

    def meet_hot(m: Message) -> np.ndarray:
        """Of each window whether one of the same name, of 96 bits, starts earlier."""
        other, ids, at = m.columns
        order = np.lexsort((np.arange(len(m.key)), at, ids, other, m.key))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(m.key[order]) != 0) | (np.diff(other[order]) != 0)
        out = np.empty(len(order), bool)
        out[order] = ~new
        return out

    def finish(batch: Batch, heard: list[Heard]) -> Iterator[pa.RecordBatch]:
        runs, first, kind, state, chosen = told(batch, heard, 2)
        is_first = np.zeros(len(runs.first), bool)
        is_first[first] = True
        whole = ~is_first | (state[kind] == 1)  # every window of the run starts earlier
        step = np.zeros(len(batch.buf) + 1, np.int64)
        np.add.at(step, runs.first[whole], 1)
        np.add.at(step, runs.last[whole] + length, -1)
        size = runs.last[chosen] - runs.first[chosen] + length
        at = np.arange(int(size.sum())) + np.repeat(runs.first[chosen] - (np.cumsum(size) - size), size)
        starts = [at[heard[1].values.astype(bool)]]
        if len(heard) > 2:
            window, _, _, once, name = hot_windows(batch, heard)
            starts.append(window[heard[2].values.astype(bool)[name] | (window != once[name])])
        removed = (np.cumsum(step[:-1]) > 0) | covered(np.concatenate([np.zeros(0, np.int64), *starts]), length, len(batch.buf))
        rows, texts = [], []
        for d in range(len(batch.ids)):
            a, b = batch.offsets[d], batch.offsets[d + 1]
            gone = removed[a:b]
            kept = batch.buf[a:b][~gone].tobytes()
            texts.append(kept)
            rows.append((int(b - a), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
        columns = [id_array(batch.ids), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_text:
            columns, names = [*columns, pa.array(texts, pa.binary())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(columns, names)

    first = corpus.ask(send_kinds, meet_kinds)
    rounds = [first, corpus.ask(send_segments, meet_segments, [first], of_bytes=True)]
    if not first.where("most = 3").isEmpty():
        rounds.append(corpus.ask(send_hot, meet_hot, rounds))
    return corpus.finish(rounds, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)



