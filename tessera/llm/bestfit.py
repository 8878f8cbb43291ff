"""Bound-certified best-fit packing of whole documents.

A document of more than `size` tokens is cut into pieces of `size`, of which the first may be
shorter; nothing else is cut. Full pieces are sequences of their own. The others are packed in rounds:

1. Pieces are dealt by a hash into groups of about GROUP_TOKENS tokens, and each group packs its own
   by best-fit decreasing.
2. Dual-feasible functions (`lower_bound`) give a number of sequences that no packing of the group can
   beat. A group that reaches it is certified; another tries again with its order slightly disturbed, RERUNS times at most.
   It keeps its sequences with room for 1 / 32 at most, but for the emptiest. What isn't kept is the group's gap.
3. The gaps of all groups exchange their pieces: dealt anew into groups, they go through the same again, until one group
   is left, the total is the bound of the whole table, or a round saves less than 1 in 100 of the sequences that it takes.

Among many short pieces a group's gap is about one sequence, so a few
rounds are left with one group, whatever the size of the table. Bounds are computed from
counts of pieces by length (`size` numbers at most). A round that doesn't help is not used, so the number of sequences never grows.

Tokens are counted once and then gone: pieces are written to the shared folder with
length and checksum, and so is each round, which makes every deal depend on written rows only, not on the order of
shuffle blocks. Pieces have numbers of their own, so neither null ids nor rows repeated many times go to one group; a
sequence bears the smallest of its pieces' numbers.

Nulls in text count as empty (the end id alone); null ids are documents like others;
repeated rows are packed once each; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textgrid import chunks, release_memory
from tessera.llm.tokenfile import shared_folder
from tessera.llm.tokens import encoder

SIZE = 2048
END_ID = 0
RERUNS = 30
GROUP_TOKENS = 8_000_000
GROUP_PIECES = 100_000
CHUNK_CHARS = 1_000_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES = [*(c.split()[0] for c in PIECE.split(", ")), "row"]
PLACED = f"{PIECE}, row long, sequence_id long, offset long, kept boolean"


def lower_bound(count: np.ndarray, size: int = SIZE, reach: int | None = None) -> int:
    """Sequences that pieces need at least; count[x] is the number of pieces of length x. No larger bound than `reach` is looked for.

    For a dual-feasible function u, the sum of u(x) over what fits into one sequence is 1 at most, so the sum over all
    pieces, rounded up, is a bound. The largest of three families is taken, all in whole numbers:
    lengths, with pieces over size - e as size and those below e as 0;
    multiples of size / k, from the whole part of (k + 1) x / size;
    and, for pieces around half a sequence, the number of e's that do not fit beside.
    """
    x = np.flatnonzero(count)
    if not len(x):
        return 0
    n, whole = count[x], size // np.arange(1, size // 2 + 1)

    def bounds():
        yield x, size
        for e, w in enumerate(whole.tolist(), 1):
            yield np.where(x > size - e, size, np.where(x < e, 0, x)), size
            yield np.where(2 * x > size, 2 * (w - (size - x) // e), np.where(2 * x == size, w, 2 * (x // e))), 2 * w
        for k in range(1, 101):
            yield np.where((k + 1) * x % size == 0, k * x, (k + 1) * x // size * size), k * size

    best = 0
    for u, one in bounds():  # 64 bits are enough for 10**13 pieces
        best = max(best, -(-int((u * n).sum()) // one))
        if reach is not None and best >= reach:
            break
    return best


def best_fit(lengths: list[int], size: int = SIZE, ranks: list[float] | None = None) -> list[list[int]]:
    """Places in `lengths` by sequence: the longest first (or those of the largest `ranks`), each into the fullest sequence that has room.

    Open sequences are stacked by the room they have left; one whole number has a bit for
    each room that occurs, so the smallest that is enough is found without a search.
    """
    bins: list[list[int]] = []
    left: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    ranks = ranks or lengths
    for i in sorted(range(len(lengths)), key=lambda i: -ranks[i]):
        n = lengths[i]
        enough = rooms >> n
        if enough:
            room = n + (enough & -enough).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
            left.append(size)
        left[b] = room - n
        if left[b]:
            stacks[left[b]].append(b)
            rooms |= 1 << left[b]
    return bins


def pack_group(lengths: list[int], size: int = SIZE) -> tuple[list[list[int]], list[bool], bool]:
    """Sequences, which of them are kept, and whether their number is certified as the least."""
    bins = best_fit(lengths, size)
    bound, rng = lower_bound(np.bincount(lengths, minlength=size + 1), size, len(bins)), random.Random(len(lengths))
    for k in range(RERUNS):
        if len(bins) == bound:
            break
        again = best_fit(lengths, size, [n * rng.uniform(1, 1.02 + 0.02 * (k % 10)) for n in lengths])
        bins = min(bins, again, key=len)
    used, certified = [sum(lengths[i] for i in b) for b in bins], len(bins) == bound
    emptiest = min(range(len(bins)), key=lambda b: (used[b], b))
    return bins, [n == size or size - n <= size // 32 and b != emptiest for b, n in enumerate(used)], certified


def cut_documents(docs: DataFrame, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """The pieces of all documents, each with a number of its own."""
    import pyarrow as pa
    from pyspark import TaskContext

    types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()

    def run(batches):
        enc, end, row = encoder(vocabulary), end_id.to_bytes(4, "little"), TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [t or "" for t in part["text"].to_pylist()]
                for a, b in chunks(texts, CHUNK_CHARS):
                    rows = []
                    for doc_id, ids in zip(part["doc_id"][a:b].to_pylist(), enc.ids(texts[a:b]), strict=True):
                        ids += end
                        n = len(ids) // 4
                        edges = [0, *range((n - 1) % size + 1, n + 1, size)]
                        for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                            rows.append((doc_id, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), row))
                            row += 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=PIECES)
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, f"{PIECE}, row long")


def _round(pieces: DataFrame, groups: int, seed: int, size: int) -> DataFrame:
    """Deals pieces into groups and packs each; PLACED rows."""
    import pyarrow as pa

    def run(table):
        lengths, rows = table["length"].to_pylist(), table["row"].to_pylist()
        order = sorted(range(len(rows)), key=rows.__getitem__)
        bins, kept, _ = pack_group([lengths[i] for i in order], size)
        sequence, offset, keep = [0] * len(rows), [0] * len(rows), [False] * len(rows)
        for b, whole in zip(bins, kept, strict=True):
            name, at = min(rows[order[i]] for i in b), 0
            for i in b:
                i = order[i]
                sequence[i], offset[i], keep[i] = name, at, whole
                at += lengths[i]
        out = table.select(PIECES)
        for name, column in (("sequence_id", pa.array(sequence, pa.int64())), ("offset", pa.array(offset, pa.int64())), ("kept", pa.array(keep, pa.bool_()))):
            out = out.append_column(name, column)
        return out

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, PLACED)


def _facts(pieces: DataFrame, size: int) -> np.ndarray:
    """Pieces by length."""
    count = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # `size` rows at most
        count[r["length"]] = r["count"]
    return count


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, group_tokens: int = GROUP_TOKENS, end_id: int = END_ID) -> DataFrame:
    """A row for each piece; `vocabulary` is the path of a tokenizer file that all workers can read."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "bestfit")
    cut_documents(docs, vocabulary, size, end_id).write.parquet(f"{folder}/pieces")
    pieces = spark.read.parquet(f"{folder}/pieces")
    full = pieces.filter(F.col("length") == size).withColumn("sequence_id", F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    columns = [*PIECES[:-1], "sequence_id", "offset"]
    done = [full.select(columns)]

    pool, gap = pieces.filter(F.col("length") < size), None
    count = _facts(pool, size)
    bound, kept, before, number = lower_bound(count, size), 0, None, 0
    while count.any() and (before is None or kept + before > bound):
        groups = max(-(-int((count * np.arange(size + 1)).sum()) // group_tokens), -(-int(count.sum()) // GROUP_PIECES))
        _round(pool, groups, number, size).write.parquet(f"{folder}/{number}")
        placed = spark.read.parquet(f"{folder}/{number}")
        closed, left = placed.filter("offset = 0").agg(F.count_if("kept"), F.count_if(~F.col("kept"))).first()
        saved = before is None or before - closed - left
        if saved <= 0:
            break
        done.append(placed.filter("kept").select(columns))
        kept, pool, gap = kept + closed, placed.filter(~F.col("kept")).select(PIECES), placed.filter(~F.col("kept"))
        if groups == 1 or before is not None and 100 * saved < before:
            break
        count, before, number = _facts(pool, size), left, number + 1
    if gap is not None:
        done.append(gap.select(columns))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
