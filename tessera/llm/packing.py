"""Sequence packing: first-fit decreasing by a tournament tree, in randomised groups of documents.

Documents are dealt to tasks by a hash of the whole row and of the input partition
that holds it, so neither a null id nor a row repeated many times comes to one task alone. A task sorts
its documents by hash, id and text, so its groups are the same again if it runs again and shuffle blocks come in another order.
A task takes its documents in groups of about GROUP_CHARS characters, so it never holds more. A group's documents are
cut into pieces of `size` tokens and one remainder each; full pieces are
sequences of their own, and remainders go, longest first, to the first open
sequence with room, which a tournament tree over the room left finds in
O(log n). What the emptiest sequences hold is then cut to fill the others, so
each group leaves one sequence with padding at most.

Nulls in text count as empty (a piece of the end id alone); a null id is a
document like any other; repeated rows are packed once each. A document longer than a group is a group of
its own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textgrid import chunks, release_memory
from tessera.llm.tokens import encoder

SIZE = 2048
GROUP_CHARS = 4_000_000
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Room left in each bin; winners are the larger room, ties to the left."""

    def __init__(self, n: int, size: int):
        self.leaves = 1
        while self.leaves < n:
            self.leaves *= 2
        self.room = [0] * self.leaves + [size] * self.leaves
        for i in range(self.leaves - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def first_fit(self, need: int) -> int:
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < need:
                i += 1
        return i - self.leaves

    def take(self, bin_: int, need: int) -> None:
        room, i = self.room, bin_ + self.leaves
        room[i] -= need
        i //= 2
        while i:
            room[i] = max(room[2 * i], room[2 * i + 1])
            i //= 2


def pack(lengths: list[int], size: int = SIZE) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length)."""
    full, rest = [], []
    for d, n in enumerate(lengths):
        whole = n // size * size
        full += [[(d, s, size)] for s in range(0, whole, size)]
        if n > whole:
            rest.append((n - whole, d, whole))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = Tournament(max(1, len(rest)), size), []
    for n, d, s in rest:
        b = tree.first_fit(n)
        tree.take(b, n)
        if b == len(bins):
            bins.append([])
        bins[b].append((d, s, n))
    left = [size - sum(x[2] for x in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (left[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        into, out = order[low], order[high]
        if not left[into]:
            low += 1
        elif not bins[out]:
            high -= 1
        else:
            d, s, n = bins[out].pop()
            m = min(n, left[into])
            bins[into].append((d, s, m))
            left[into] -= m
            left[out] += m
            if m < n:
                bins[out].append((d, s + m, n - m))
    return full + [b for b in bins if b]


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, group_chars: int = GROUP_CHARS, end_id: int = END_ID) -> DataFrame:
    """A row for each piece; `vocabulary` is the path of a tokenizer file that all workers can read."""
    import pyarrow as pa
    from pyspark import TaskContext

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        enc, end, sequence = encoder(vocabulary), end_id.to_bytes(4, "little"), TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        tokens: list[bytes] = []

        def group():
            nonlocal sequence
            rows: list[tuple] = []
            for pieces in pack([len(t) // 4 for t in tokens], size):
                at = 0
                for d, start, n in pieces:
                    rows.append((ids[d], start, n, zlib.crc32(tokens[d][4 * start : 4 * (start + n)]), len(tokens[d]) // 4, sequence, at))
                    at += n
                sequence += 1
            ids.clear(), tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

        held = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [t or "" for t in part["text"].to_pylist()]
                for a, b in chunks(texts, group_chars):
                    n = sum(map(len, texts[a:b])) + b - a
                    if held and held + n > group_chars:
                        yield group()
                        held = 0
                    held += n
                    ids += part["doc_id"][a:b].to_pylist()
                    tokens += [x + end for x in enc.ids(texts[a:b])]
        if ids:
            yield group()
        release_memory()

    row = F.xxhash64("doc_id", "text", F.spark_partition_id())
    dealt = docs.select("doc_id", "text", row.alias("h")).repartition("h").sortWithinPartitions("h", "doc_id", "text")
    return dealt.select("doc_id", "text").mapInArrow(run, SCHEMA)
