"""Removal of passages that also start in a document with a smaller id: count-min prefilter, then exact grouping.

1. Documents are dealt into groups by a hash of id and text, so a null or repeated id is in all of them. Each group adds the windows of its
   documents to a count-min sketch (`depth` rows, width in proportion to the
   input), sent as sorted cells of counters that stop at two; counters are of
   documents. Blocks of cells, as many as the input needs, are merged over all groups. The merged counters
   never fall below the true counts, so no repeated window is lost.
2. Each group gets back which of its own cells are repeated, and sends the
   windows that all rows estimate as repeated, once each with the smallest id
   in the group, under a 128-bit key. Blocks of keys find the smallest id of
   all; a bit for each window sent comes back.
3. Groups apply the bits and cover the words.

A group sends at most `fan_out` rows for each row of the sketch. Where the input needs more blocks than that,
both exchanges go over two levels: groups cut their cells and keys into about the root of
the number of blocks, bundles of about the root of the number of groups merge these
(a sketch of the bundle; the smallest id in the bundle) and cut them into blocks, and answers come
back the same way. So rows grow with the power 1.5 of the input instead of its square, and results are the same.

Nothing but documents moves whole, and a window, however frequent, is one entry
for each group. Words are byte runs other than space and 0x09-0x0D. Null and empty texts
have no words; a null doc_id counts as the largest int64; rows with one id don't
remove each other's words. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textgrid import Words, chunks, mix, pack_ints, pack_sorted, unpack_ints, unpack_sorted

WINDOW = 13
DEPTH = 2
CELLS_A_WINDOW = 8
GROUP_CHARS = 4_000_000
BLOCK_CHARS = 24_000_000
FAN_OUT = 2048
LAST = (1 << 63) - 1  # where a null id stands among ids
OUT = "doc_id long, n_words long, n_removed long, kept string"


def _cells(h: np.ndarray, row: int, width_bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1)) >> np.uint64(64 - width_bits)


def _cut(x: np.ndarray, blocks: int, bits: int, begin: int = 0, end: int | None = None) -> list[tuple[int, int, int]]:
    """(block, from, to) of the blocks of the range of `bits` bits, of those from `begin` to `end`, that hold any of the ascending values."""
    end = blocks if end is None else end
    edge = [0, *np.searchsorted(x, np.array([-(-(b << bits) // blocks) for b in range(begin + 1, end)], np.uint64)), len(x)]
    return [(begin + i, edge[i], edge[i + 1]) for i in range(end - begin) if edge[i] < edge[i + 1]]


def _merged(sketches: list[np.ndarray]):
    """Distinct cells of some sketches, which of them are repeated, and where each sketch's cells stand among them."""
    value = np.concatenate(sketches)
    cells, inverse, counts = np.unique(value >> np.uint64(1), return_inverse=True, return_counts=True)
    hot = counts > 1
    hot[inverse[(value & np.uint64(1)).astype(bool)]] = True
    return cells, hot, np.split(inverse, np.cumsum([len(x) for x in sketches])[:-1])


def _least(table):
    """Distinct keys of some entries with their smallest ids; all ids, and where each row's entries stand among the keys."""
    parts = [unpack_sorted(x) for x in table["h1"].to_pylist()]
    h1, h2 = np.concatenate(parts), np.frombuffer(b"".join(table["h2"].to_pylist()), np.uint64)
    ids = np.concatenate([unpack_ints(x) for x in table["least"].to_pylist()]).view(np.int64)
    order = np.lexsort((ids, h2, h1))
    a, b = h1[order], h2[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    at = np.empty(len(h1), np.int64)
    at[order] = np.cumsum(new) - 1
    edge = np.cumsum([len(p) for p in parts])[:-1]
    return a[new], b[new], ids[order][new], np.split(ids, edge), np.split(at, edge)


def _bits(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + np.packbits(x).tobytes()


def _flags(b: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8, offset=8), count=int.from_bytes(b[:8], "little")).astype(bool)


def _ordered(table):
    """Ids, texts and ids that may be null, by id."""
    ids = table["doc_id"].fill_null(LAST).to_numpy() if table.num_rows else np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    return ids[order], table["text"].take(order), table["doc_id"].take(order)


def _parts(texts, size: int):
    """(index of the first text, texts, words, first words of windows, hashes) of each chunk."""
    values = texts.to_pylist()
    for a, b in chunks(values):
        w = Words(values[a:b])
        at, h = w.windows(size)
        yield a, w, at, h


def remove_repeats(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, fan_out: int = FAN_OUT) -> DataFrame:
    import pyarrow as pa

    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // GROUP_CHARS))
    blocks = max(16, -(-chars // BLOCK_CHARS))
    tops = blocks if blocks <= fan_out else math.isqrt(blocks - 1) + 1
    inner = -(-blocks // tops)
    blocks, bundles = tops * inner, math.isqrt(groups - 1) + 1
    width = max(16, (CELLS_A_WINDOW * chars // 6).bit_length())
    some = docs.filter("text is not null and text <> ''")
    keyed = some.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("g")).repartition(groups, "g")
    blank = docs.filter("text is null or text = ''").select("doc_id", *(F.lit(x).cast(t).alias(c) for c, t, x in (("n_words", "long", 0), ("n_removed", "long", 0), ("kept", "string", ""))))

    def sketch(table: pa.Table) -> pa.Table:
        _, texts, _ = _ordered(table)
        hs, ds = [], []
        for a, w, at, h in _parts(texts, window):
            hs.append(h)
            ds.append(w.text[at] + np.int32(a))
        h, d, g = np.concatenate(hs or [np.zeros(0, np.uint64)]), np.concatenate(ds or [np.zeros(0, np.int32)]), table["g"][0].as_py()
        out = {"block": [], "g": [], "cells": []}
        for row in range(depth):
            c = _cells(h, row, width)
            order = np.argsort(c, kind="stable")
            c, by = c[order], d[order]
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
            other = np.r_[False, (by[1:] != by[:-1]) & (c[1:] == c[:-1])] if len(c) else np.zeros(0, bool)
            many = np.logical_or.reduceat(other, first) if len(c) else other
            c = c[first]
            value = c << np.uint64(1) | many.astype(np.uint64)
            for b, x, y in _cut(c, tops, width):
                out["block"].append(row * tops + b)
                out["g"].append(g)
                out["cells"].append(pack_sorted(value[x:y]))
        return pa.table({"block": pa.array(out["block"], pa.int64()), "g": pa.array(out["g"], pa.int64()), "cells": pa.array(out["cells"], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        cells, hot, places = _merged([unpack_sorted(x) for x in table["cells"].to_pylist()])
        return pa.table({"g": table["g"], "block": table["block"], "data": pa.array([pack_sorted(cells[at[hot[at]]]) for at in places], pa.binary())})

    def merge_bundle(table: pa.Table) -> pa.Table:
        cells, hot, _ = _merged([unpack_sorted(x) for x in table["cells"].to_pylist()])
        row, top = divmod(table["block"][0].as_py(), tops)
        value = cells << np.uint64(1) | hot.astype(np.uint64)
        cut = _cut(cells, blocks, width, top * inner, (top + 1) * inner)
        out = {"block": pa.array([row * blocks + b for b, _, _ in cut], pa.int64()), "g": pa.array([table["bundle"][0].as_py()] * len(cut), pa.int64())}
        return pa.table(out | {"cells": pa.array([pack_sorted(value[x:y]) for _, x, y in cut], pa.binary())})

    def answer_cells(left: pa.Table, right: pa.Table) -> pa.Table:
        hot = np.sort(np.concatenate([unpack_sorted(x) for x in right["data"].to_pylist()] or [np.zeros(0, np.uint64)]))
        sent = [np.intersect1d(unpack_sorted(x) >> np.uint64(1), hot, assume_unique=True) for x in left["cells"].to_pylist()]
        return pa.table({"g": left["g"], "block": left["block"], "data": pa.array(map(pack_sorted, sent), pa.binary())})

    def entries(texts, ids, info):
        """Windows that are estimated repeated: (text, word in its chunk, entry), then the entries' keys and smallest ids."""
        rows = sorted(zip(info["block"].to_pylist(), info["data"].to_pylist(), strict=True))
        tables = [np.concatenate([unpack_sorted(x) for b, x in rows if b // tops == r] or [np.zeros(0, np.uint64)]) for r in range(depth)]
        h1s, h2s, ds, words, places = [], [], [], [], []
        for a, w, at, h in _parts(texts, window):
            keep = np.ones(len(h), bool)
            for r, t in enumerate(tables):
                where = np.flatnonzero(keep)
                c = _cells(h[where], r, width)
                if len(t):
                    keep[where] = t[np.minimum(np.searchsorted(t, c), len(t) - 1)] == c
                else:
                    keep[:] = False
            keep = np.flatnonzero(keep)
            words.append((a, w))
            places.append(at[keep])
            h1s.append(h[keep])
            h2s.append(w.windows(window, seed=1)[1][keep] if len(keep) else h[keep])
            ds.append(w.text[at[keep]] + a)
        h1, h2 = np.concatenate(h1s or [np.zeros(0, np.uint64)]), np.concatenate(h2s or [np.zeros(0, np.uint64)])
        d = np.concatenate(ds or [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.lexsort((h2, h1))
        h1o, h2o = h1[order], h2[order]
        new = np.r_[True, (h1o[1:] != h1o[:-1]) | (h2o[1:] != h2o[:-1])] if len(h1o) else np.zeros(0, bool)
        entry = np.zeros(len(h1), np.int64)
        entry[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return words, places, d, entry, h1o[first], h2o[first], ids[d[order[first]]] if len(first) else np.zeros(0, np.int64)

    def keys_table(g, h1, h2, least, cut) -> pa.Table:
        rows = [(b, g, pack_sorted(h1[x:y]), h2[x:y].tobytes(), pack_ints(least[x:y].view(np.uint64))) for b, x, y in cut]
        schema = pa.schema([("block", pa.int64()), ("g", pa.int64()), ("h1", pa.binary()), ("h2", pa.binary()), ("least", pa.binary())])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else schema.empty_table()

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return keys_table(0, None, None, None, [])
        ids, texts, _ = _ordered(left)
        *_, h1, h2, least = entries(texts, ids, right)
        return keys_table(left["g"][0].as_py(), h1, h2, least, _cut(h1, tops, 64))

    def decide(table: pa.Table) -> pa.Table:
        _, _, least, ids, places = _least(table)
        bits = [_bits(least[at] < x) for x, at in zip(ids, places, strict=True)]
        return pa.table({"g": table["g"], "block": pa.array([-1 - b for b in table["block"].to_pylist()], pa.int64()), "data": pa.array(bits, pa.binary())})

    def decide_bundle(table: pa.Table) -> pa.Table:
        h1, h2, least, _, _ = _least(table)
        top = table["block"][0].as_py()
        return keys_table(table["bundle"][0].as_py(), h1, h2, least, _cut(h1, blocks, 64, top * inner, (top + 1) * inner))

    def answer_keys(left: pa.Table, right: pa.Table) -> pa.Table:
        _, _, least, ids, places = _least(left)
        outside = np.concatenate([_flags(x) for _, x in sorted(zip(right["fine"].to_pylist(), right["data"].to_pylist(), strict=True))])
        bits = [_bits(outside[at] | (least[at] < x)) for x, at in zip(ids, places, strict=True)]
        return pa.table({"g": left["g"], "block": pa.array([-1 - b for b in left["block"].to_pylist()], pa.int64()), "data": pa.array(bits, pa.binary())})

    def cover(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        if not left.num_rows:
            return schema.empty_table()
        ids, texts, named = _ordered(left)
        named = named.to_pylist()
        blocks_in = np.array(right["block"].to_pylist(), np.int64)
        info = right.filter(pa.array(blocks_in >= 0))
        words, places, d, entry, _, _, least = entries(texts, ids, info)
        bits = [np.zeros(0, bool)]
        for b, x in sorted(((-1 - b, x) for b, x in zip(blocks_in.tolist(), right["data"].to_pylist(), strict=True) if b < 0)):
            bits.append(_flags(x))
        elsewhere = np.concatenate(bits)
        gone = elsewhere[entry] | (least[entry] < ids[d]) if len(entry) else np.zeros(0, bool)
        at, out = 0, ([], [], [], [])
        for (a, w), place in zip(words, places, strict=True):
            starts = place[gone[at : at + len(place)]]
            at += len(place)
            n = len(w)
            step = np.bincount(starts, minlength=n + window + 1) - np.bincount(starts + window, minlength=n + window + 1)
            kept = np.cumsum(step)[:n] == 0
            for i in range(w.n_texts):
                x, y = w.first[i], w.first[i + 1]
                k = kept[x:y]
                left_over = int(k.sum())
                split = w.data[w.start[x] : w.end[y - 1]].split() if left_over else []
                out[0].append(named[a + i])
                out[1].append(int(y - x))
                out[2].append(int(y - x) - left_over)
                out[3].append(b" ".join(split if left_over == y - x else compress(split, k)).decode("utf-8", "replace"))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    def exchange(rows: DataFrame, merge, merge_bundle, answer, columns: str) -> DataFrame:
        """Rows of groups through blocks and back, in bundles where there are more blocks than a group sends rows."""
        if inner == 1:
            return rows.repartition(depth * blocks, "block").groupBy("block").applyInArrow(merge, "g long, block long, data binary")
        rows = rows.withColumn("bundle", F.pmod("g", F.lit(bundles)))
        rows = rows.repartition(depth * blocks, "bundle", "block")
        over = rows.groupBy("bundle", "block").applyInArrow(merge_bundle, columns)
        back = over.repartition(depth * blocks, "block").groupBy("block").applyInArrow(merge, "g long, block long, data binary")
        back = back.withColumn("fine", F.when(F.col("block") < 0, -1 - F.col("block")).otherwise(F.col("block")))
        top = F.floor(F.col("fine") / blocks) * tops + F.floor(F.pmod("fine", F.lit(blocks)) / inner)
        back = back.select(F.col("g").alias("bundle"), top.alias("block"), "fine", "data")
        return rows.groupBy("bundle", "block").cogroup(back.groupBy("bundle", "block")).applyInArrow(answer, "g long, block long, data binary")

    sketches = keyed.groupBy("g").applyInArrow(sketch, "block long, g long, cells binary")
    flags = exchange(sketches, merge, merge_bundle, answer_cells, "block long, g long, cells binary")
    keys = "block long, g long, h1 binary, h2 binary, least binary"
    sent = keyed.groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(send, keys)
    bits = exchange(sent, decide, decide_bundle, answer_keys, keys)
    return keyed.groupBy("g").cogroup(flags.unionByName(bits).groupBy("g")).applyInArrow(cover, OUT).unionByName(blank)
