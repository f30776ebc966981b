"""Narratives of maps in Arrow batches: the order after each sentence is worked out once for each shape of a graph that a worker meets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

# The directions told here, as said in a sentence, and whether they give edges, point east and north.
SAID = {d.lower(): d for d in ("North", "South", "East", "West", "Northeast", "Northwest", "Southeast", "Southwest")}
_TURN = {d: (len(d) > 5, d.endswith("east"), d.startswith("north")) for d in SAID}
#: Characters of text in a batch, about, and of the patterns of chains that a worker keeps; when there are more it begins anew.
BATCH_CHARS, HELD_CHARS = 8 << 20, 4 << 20


def chains(below: tuple[int, ...], seen: int) -> list[tuple[str, tuple[int, ...]]]:
    """graph.row_state before names are put in: of each chain a pattern and the nodes it takes; below has the nodes below each node as bits."""
    every = [i for i in range(len(below)) if seen >> i & 1]
    groups: dict[tuple[int, int], list[int]] = {}
    for i in every:
        groups.setdefault((below[i], sum(1 << j for j in every if below[j] >> i & 1)), []).append(i)
    strict = [b & ~(1 << i) for i, b in enumerate(below)]
    rows, hops, firsts = [], 0, 0
    for members in groups.values():
        i = members[0]
        low = two = 0
        for k in every:
            if strict[i] >> k & 1:
                two |= strict[k]
        low = strict[i] & ~two
        hops |= low
        firsts |= 1 << i
        label = "%s" if len(members) == 1 else "{" + ", ".join(["%s"] * len(members)) + "}"
        rows.append((strict[i].bit_count(), i, low, label, tuple(members)))
    hops &= firsts
    if not hops:
        return [("%s", (i,)) for i in every]
    done: list[tuple[int, list[tuple[str, tuple[int, ...]]]]] = []
    for _, i, low, label, members in sorted(rows):
        longer = [(f"{text} < {label}", nodes + members) for j, under in done if low >> j & 1 for text, nodes in under]
        done.append((i, longer or [(label, members)]))
    return [c for i, own in done if not hops >> i & 1 for c in own]


class Narrator:
    """Sentences and narrative of a map, and the chains of the graphs it has met of late."""

    def __init__(self) -> None:
        self.held: dict[tuple[tuple[int, ...], int], list[tuple[str, tuple[int, ...]]]] = {}
        self.size = 0

    def state(self, names: list[str], below: tuple[int, ...], seen: int) -> str:
        found = self.held.get((below, seen))
        if found is None:
            if self.size > HELD_CHARS:
                self.held, self.size = {}, 0
            found = self.held[below, seen] = chains(below, seen)
            self.size += sum(len(text) for text, _ in found) + 8 * len(below)
        return ", ".join(sorted({text % tuple([names[i] for i in nodes]) for text, nodes in found}))

    def tell(self, names: list[str], rels: list[tuple[int, str, str, str]]) -> tuple[str, str]:
        at = {e: k for k, e in enumerate(names)}
        every = ", ".join(names)
        parts, sentences = [f"### Initialization\n**Entities Detected**: {every}\n**Initial X-State**: {every}\n**Initial Y-State**: {every}\n"], []
        x = y = (0,) * len(names)
        seen = 0
        for seq, a, d, b in rels:
            edge, east, north = _TURN[d]
            i, j = at[a], at[b]
            seen |= 1 << i | 1 << j
            if edge:
                x = _linked(x, i, j) if east else _linked(x, j, i)
                y = _linked(y, i, j) if north else _linked(y, j, i)
            said = f"The {a} is to the {SAID[d]} of the {b}."
            up, down = f"{b} < {a}", f"{a} < {b}"
            sentences.append(said)
            parts.append(
                f'### Step {seq}\n**Sentence**: "{said}"\n**X-Extraction**: {up if east else down}\n**Y-Extraction**: {up if north else down}\n'
                f"**X-State**: {self.state(names, x, seen)}\n**Y-State**: {self.state(names, y, seen)}\n"
            )
        return " ".join(sentences), "\n\n".join(parts)


def _linked(below: tuple[int, ...], src: int, dst: int) -> tuple[int, ...]:
    more = below[dst] | 1 << dst
    return tuple([m | more if i == src or m >> src & 1 else m for i, m in enumerate(below)])


def told(rows: DataFrame) -> DataFrame:
    """rows of graph.by_map, whose directions are all in SAID and whose names are not null, with sentences and steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrator = Narrator()
        for rb in batches:
            names, rels = rb.column(rb.schema.get_field_index("nodes")), rb.column(rb.schema.get_field_index("rels"))
            n_names, n_rels = pc.list_value_length(names).to_pylist(), pc.list_value_length(rels).to_pylist()
            name = names.flatten().to_pylist()
            fields = rels.flatten()
            rel = list(zip(*[fields.field(c).to_pylist() for c in ("seq", "a", "dir", "b")], strict=True))
            first = p = q = size = 0
            sentences, steps = [], []
            for k in range(rb.num_rows):
                said, text = narrator.tell(name[p : p + n_names[k]], rel[q : q + n_rels[k]])
                p, q, size = p + n_names[k], q + n_rels[k], size + len(said) + len(text)
                sentences.append(said)
                steps.append(text)
                if size > BATCH_CHARS or k + 1 == rb.num_rows:
                    own = rb.slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sentences, pa.string()), pa.array(steps, pa.string())], [*rb.schema.names, "sentences", "steps"])
                    first, size, sentences, steps = k + 1, 0, [], []

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *[StructField(c, StringType()) for c in ("sentences", "steps")]]))
