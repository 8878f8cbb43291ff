"""Shingle Jaccard self-join by parity sketches, and its classes of near duplicates.

A set of shingles is a sparse parity sketch: each shingle flips the bit that its
64-bit hash names, so the Hamming distance of two sketches is at most the size
of the sets' symmetric difference. At a similarity of t, the larger of two
linked sets, of n shingles, differs in at most 2n(1-t)/(1+t) bits. Sets are
banded by size; each band cuts sketches into `pieces(band)` pieces, and a set
takes part in its own band and the next, where larger partners are. A set has
more non-empty pieces than bits that may differ, so some non-empty piece of a
linked pair is equal: the pieces' XOR of shingle hashes is the join key.

Equal sets are one representative from the start. Sets that share too few keys
with all others to be linked leave the buckets. Each bucket of a key first
links its members to the most central of them, where these share many keys. After components of
the verified links, only pairs of a bucket in different components are left. Of
these, the larger set needs no more of its keys than bits that may differ and one, and
it takes those of the smallest buckets; keys that no other set has count first. So
passages that many documents share seldom make pairs, and no link is lost. Pairs that share
fewer keys than linked ones must are dropped, and verification compares the whole sets.

Null or empty text: an empty set, linked with nothing, its own class. A null
doc_id stays null and never names a class that has another id. Rows that repeat
are linked as any equal sets are. Empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.textgrid import Words, chunks, mix, pack_ints, pack_sorted, release_memory, release_shuffles, small_batches, unpack_ints, unpack_sorted

SHINGLE = 5
FLUSH_KEYS = 700_000
ROWS = 500
KEY_BITS = 50
BLOCK_CHARS = 24_000_000
NO_ID = 1 << 62  # a flag beside the counts of keys
SALTS = 16
SETS_A_TASK = 1_000

_lows = [1]
while _lows[-1] < 1 << 40:
    _lows.append(max(_lows[-1] + 1, math.floor(4 * (_lows[-1] - 1) / 3) + 1))
LOWS = np.array(_lows)


def band(n: int) -> int:
    return int(np.searchsorted(LOWS, n, side="right")) - 1


def pieces(g: int) -> int:
    low = int(LOWS[g])
    return low * 3 // 4 if low >= 64 else 4 * low + 8


def shingles(texts: list[str | None], size: int = SHINGLE):
    """The ascending distinct shingle hashes of each text."""
    for a, b in chunks(texts):
        w = Words(texts[a:b], fold=True)
        at, h = w.windows(size)
        edge = np.searchsorted(at, w.first)
        short: dict[int, np.ndarray] = {}
        for i in np.flatnonzero((w.first[1:] - w.first[:-1] > 0) & (edge[1:] == edge[:-1])):
            k = int(w.first[i + 1] - w.first[i])
            with np.errstate(over="ignore"):
                total = np.uint64(k)
                for x in w.hash[w.first[i] : w.first[i + 1]]:
                    total = mix(np.array([total * np.uint64(31) + x]))[0]
            short[int(i)] = np.array([total])
        for i in range(w.n_texts):
            yield short[i] if i in short else np.unique(h[edge[i] : edge[i + 1]])


def _by_rows(texts):
    """Shingles of an Arrow column, a few rows in memory as strings at a time."""
    for i in range(0, len(texts), ROWS):
        yield from shingles(texts.slice(i, ROWS).to_pylist())


def signature(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) ^ mix(s).sum(dtype=np.uint64) << np.uint64(1)]))[0].astype(np.int64))


def piece_keys(s: np.ndarray, g: int) -> np.ndarray:
    """Keys of the non-empty pieces in a band; the low six bits are the band's."""
    with np.errstate(over="ignore"):
        p = (s >> np.uint64(32)) * np.uint64(pieces(g)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        x = np.bitwise_xor.reduceat(mix(s), first)
        key = mix(x + mix(p[first] + np.uint64(g << 40)))
        return key[x != 0] >> np.uint64(70 - KEY_BITS) << np.uint64(6) | np.uint64(g)


def _identified(docs: DataFrame) -> DataFrame:
    """Rows by id and whether it is none; a row without doc_id is known by a hash of its text."""
    return docs.select(*row_key(), "text")


def row_key() -> list[Column]:
    """What tells rows apart that differ in doc_id or text: id, none, h."""
    text = F.xxhash64("text")
    return [F.coalesce("doc_id", text).alias("id"), F.isnull("doc_id").alias("none"), text.alias("h")]


def _meet_inputs(docs: DataFrame, blocks: int) -> DataFrame:
    import pyarrow as pa

    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary())])
    cuts = np.array([-(-(b << KEY_BITS) // blocks) for b in range(1, blocks)], np.uint64)

    def run(batches):
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        owners: list[int] = []
        ids: list[tuple[int, int, int, int, int]] = []

        def flush():
            rows = []
            if keys:
                k = np.concatenate(keys)
                o = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
                order = np.argsort(k, kind="stable")
                k, o = k[order], o[order]
                sigs = np.array(owners, np.int64)
                edge = [0, *np.searchsorted(k, cuts), len(k)]
                for b in range(blocks):
                    if edge[b] < edge[b + 1]:
                        used, local = np.unique(o[edge[b] : edge[b + 1]], return_inverse=True)
                        rows.append((b, 1, pack_sorted(k[edge[b] : edge[b + 1]]), pack_ints(local), sigs[used].tobytes(), None, None))
            if ids:
                t = np.array(ids, np.int64)
                to = t[:, 1].view(np.uint64) % np.uint64(blocks)
                for b in np.unique(to):
                    x = t[to == b]
                    rows.append((int(b), 0, *(x[:, i].tobytes() for i in range(5))))
            keys.clear(), owners.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else None

        n_keys = 0
        for batch in batches:
            for doc, none, h, s in zip(*(batch[x].to_pylist() for x in ("id", "none", "h")), _by_rows(batch["text"]), strict=True):
                n = len(s)
                sig = signature(s) if n else 0
                own = 0
                if n:
                    g = band(n)
                    k = piece_keys(s, g)
                    own = len(k)
                    if sig not in seen:
                        seen.add(sig)
                        after = piece_keys(s, g + 1)
                        own |= len(after) << 32
                        k = np.concatenate([k, after])
                        keys.append(k)
                        owners.append(sig)
                        n_keys += len(k)
                ids.append((doc, sig, n, own | NO_ID * none, h))
                if n_keys > FLUSH_KEYS or len(ids) > 200_000:
                    out = flush()
                    n_keys = 0
                    if out:
                        yield out
        out = flush()
        if out:
            yield out
        release_memory()

    return _identified(docs).mapInArrow(run, "block long, kind int, a binary, b binary, c binary, d binary, e binary")


def _meet(inputs: DataFrame) -> DataFrame:
    """Rows of documents (kind 0: id, and whether it is none), and of buckets: distinct sets of members (kind 1) with how many keys have them."""
    import pyarrow as pa

    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("times", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        col = {c: table[c].to_pylist() for c in "abcde"}
        out = []
        docs = [i for i, k in enumerate(kinds) if k == 0]
        if docs:
            known = [np.frombuffer(b"".join(col[x][i] for i in docs), np.int64) for x in "abcde"]
            a, nothing = known[0], pa.nulls(len(known[0]), pa.int64())
            out.append(pa.Table.from_arrays([pa.array(np.zeros(len(a), np.int32)), *map(pa.array, known), nothing, nothing, pa.nulls(len(a), pa.list_(pa.int64()))], schema=schema))
        parts = [i for i, k in enumerate(kinds) if k == 1]
        if parts:
            key = np.concatenate([unpack_sorted(col["a"][i]) for i in parts])
            sig = np.concatenate([np.frombuffer(col["c"][i], np.int64)[unpack_ints(col["b"][i]).astype(np.int64)] for i in parts])
            order = np.argsort(key, kind="stable")
            key, sig = key[order], sig[order]
            same = np.r_[False, key[1:] == key[:-1]]
            begin = np.flatnonzero(~same)
            end = np.r_[begin[1:], len(key)]
            found: dict[tuple[int, bytes], int] = {}
            for x, y in zip(begin[end - begin > 1], end[end - begin > 1], strict=True):
                m = np.unique(sig[x:y])
                if len(m) > 1:
                    k = (int(key[x]) & 63, m.tobytes())
                    found[k] = found.get(k, 0) + 1
            if found:
                n = len(found)
                nothing = pa.nulls(n, pa.int64())
                members = pa.array([np.frombuffer(m, np.int64) for _, m in found], pa.list_(pa.int64()))
                out.append(pa.Table.from_arrays([pa.array(np.ones(n, np.int32)), *[nothing] * 5, pa.array([g for g, _ in found], pa.int64()), pa.array(list(found.values()), pa.int64()), members], schema=schema))
        release_memory()
        return pa.concat_tables(out) if out else schema.empty_table()

    return inputs.groupBy("block").applyInArrow(run, "kind int, id long, sig long, n long, own long, h long, g long, times long, members array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, shingles) of the representatives in `wanted` (id, none, sig)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            keep, out = [], []
            for i, (x, sig) in enumerate(zip(_by_rows(batch["text"]), batch["sig"].to_pylist(), strict=True)):
                if len(x) and signature(x) == sig:  # rows of one doc_id may differ
                    keep.append(i)
                    out.append(pack_sorted(x))
            yield pa.RecordBatch.from_arrays([batch["sig"].take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], names=["sig", "set"])
        release_memory()

    rows = _identified(docs).join(wanted, ["id", "none"]).select("sig", "text")
    return rows.mapInArrow(run, "sig long, set binary").dropDuplicates(["sig"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch["su"].to_pylist(), batch["sv"].to_pylist(), strict=True)):
                x, y = unpack_sorted(a), unpack_sorted(b)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch["u"].take(pa.array(keep, pa.int64())), batch["v"].take(pa.array(keep, pa.int64()))], names=["u", "v"])

    left = sets.select(F.col("sig").alias("u"), F.col("set").alias("su"))
    right = sets.select(F.col("sig").alias("v"), F.col("set").alias("sv"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _possible(buckets: DataFrame, reps: DataFrame) -> DataFrame:
    """Buckets without members that share too few keys in the band, with whatever sets, to be linked there.

    A partner differs from a set of n in n / 3 shingles at most, so the two share all but n / 3 of its non-empty pieces.
    """
    each = buckets.select("g", "times", F.xxhash64("g", "members").alias("bucket"), F.explode("members").alias("sig"))
    pieces_ = F.when(F.col("g") == F.col("band"), F.col("own")).otherwise(F.col("after"))
    able = each.groupBy("sig", "g").agg(F.sum("times").alias("shared")).join(reps.select("sig", "n", "band", "own", "after"), "sig")
    able = able.filter(F.col("shared") >= pieces_ - F.floor(F.col("n") / 3)).select("sig", "g")
    left = each.join(able, ["sig", "g"]).groupBy("bucket", "g").agg(F.first("times").alias("times"), F.array_sort(F.collect_list("sig")).alias("members"))
    return left.filter(F.size("members") > 1).groupBy("g", "members").agg(F.sum("times").alias("times"))


def _centrality(each: DataFrame, reps: DataFrame) -> DataFrame:
    """How many sets share a set's pieces in a band, on average: highest for what others are copies of."""
    total = F.when(F.col("g") == F.col("band"), F.col("own")).otherwise(F.col("after"))
    met = each.groupBy("sig", "g").agg(F.sum(F.col("times") * F.col("size")).alias("met"))
    return met.join(reps.select("sig", "band", "own", "after"), "sig").select("sig", "g", (F.col("met") / total).alias("centre"))


def sketch(s: np.ndarray, g: int) -> bytes:
    """A dense parity sketch with four bits or more for each shingle of the band's smallest set."""
    bits = max(256, -(-4 * int(LOWS[g]) // 64) * 64)
    at = (mix(s ^ np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _sketches(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(sig, g, sketch) of each set in its own band and the next."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [(sig, g + k, sketch(unpack_sorted(x), g + k)) for sig, g, x in zip(batch["sig"].to_pylist(), batch["band"].to_pylist(), batch["set"].to_pylist(), strict=True) for k in (0, 1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["sig", "g", "sketch"])

    return sets.join(reps.select("sig", "band"), "sig").select("sig", "band", "set").mapInArrow(run, "sig long, g long, sketch binary").dropDuplicates(["sig", "g"])


def _crossed(each: DataFrame, reps: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u < v) in different components that share as many keys as linked pairs must.

    The larger set of a pair, with P non-empty pieces, U of them shared with no
    set, differs in at most 2n / 7 shingles, and takes its keys of the smallest buckets up to
    2n / 7 + n / 16 with U. Of the keys taken, T, a pair of sizes m and n shares at least T + U - (m + n) / 7.
    Dense parity sketches of the members refute pairs before any is made: their Hamming distance can't pass (m + n) / 7.
    """
    import pyarrow as pa

    own = each.join(reps.select("sig", "n", F.col("band").alias("g"), "own"), ["sig", "g"])
    by_sig = Window.partitionBy("sig")
    own = own.withColumn("unshared", F.col("own") - F.sum("times").over(by_sig))
    own = own.withColumn("before", F.coalesce(F.sum("times").over(by_sig.orderBy("size", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = own.filter(F.col("before") + F.col("unshared") <= F.floor(F.col("n") * 2 / 7) + F.floor(F.col("n") / 16))
    taken = taken.withColumn("need", F.sum("times").over(by_sig) + F.col("unshared")).select("bucket", "sig", "need")
    member = each.join(labels, "sig").join(taken, ["bucket", "sig"], "left")
    open_ = member.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("need").alias("any")).filter("c0 <> c1 and any is not null")
    # buckets of one class go to few tasks, as many as it has sets for, which add up what these say of a pair
    parts = labels.groupBy(F.col("component").alias("c0")).agg((1 + F.floor(F.count("*") / SETS_A_TASK)).alias("parts"))
    open_ = open_.join(parts, "c0").select("bucket", "c0", F.pmod(F.xxhash64("bucket"), "parts").alias("part"))
    groups = member.join(open_, "bucket").join(_sketches(sets, reps), ["sig", "g"]).repartition("c0", "part").groupBy("c0", "part", "bucket").agg(
        F.first("times").alias("times"), F.array_sort(F.collect_list(F.struct("n", "sig", "component", F.coalesce("need", F.lit(-1)).alias("need"), "sketch"))).alias("m")
    )

    def run(batches):
        parts: list[np.ndarray] = []
        held = 0

        def flush():
            x = np.concatenate(parts)
            parts.clear()
            order = np.lexsort((x[:, 1], x[:, 0]))
            x = x[order]
            new = np.flatnonzero(np.r_[True, (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (x[new, 0], x[new, 1], x[new, 2], np.add.reduceat(x[:, 3], new))], names=["larger", "smaller", "least", "shared"])

        for batch in batches:
            for times, row in zip(batch["times"].to_pylist(), batch["m"], strict=True):
                f = row.values
                n, sig, c, need = (f.field(k).to_numpy() for k in ("n", "sig", "component", "need"))
                sketch = np.frombuffer(b"".join(f.field("sketch").to_pylist()), np.uint64).reshape(len(n), -1)
                for i in np.flatnonzero(need >= 0):
                    j = np.arange(np.searchsorted(n, -(-n[i] * percent // 100)), np.searchsorted(n, n[i], "right"))
                    j = j[c[j] != c[i]]
                    j = j[np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1) <= (n[j] + n[i]) // 7]
                    if len(j):
                        parts.append(np.stack([np.full(len(j), sig[i]), sig[j], need[i] - (n[j] + n[i]) // 7, np.full(len(j), times)], axis=1))
                        held += len(j)
                if held > 500_000:
                    held = 0
                    yield flush()
        if parts:
            yield flush()
        release_memory()

    found = groups.mapInArrow(run, "larger long, smaller long, least long, shared long")
    found = found.groupBy("larger", "smaller").agg(F.max("least").alias("least"), F.sum("shared").alias("shared")).filter("shared >= least")
    return found.select(F.least("larger", "smaller").alias("u"), F.greatest("larger", "smaller").alias("v")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    return near_duplicate_rows(docs, percent).select("doc_id", "n_shingles", "component_id")


def near_duplicate_rows(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The same with the columns of `row_key` and `leads`: whether the row is the one that stands for its class.

    That is the row of the smallest doc_id, and of several rows of that id the one of the smallest hash of its text; rows equal in both lead together.
    """
    if percent < 75:
        raise ValueError("bands and pieces are laid out for a similarity of 0.75 or more")
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, percent)


def keep_one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """`docs` with one row of each class of near duplicates: the one that leads it, and of equal rows one. Rows without words all stay."""
    rows = near_duplicate_rows(docs, percent)
    names = ["id", "none", "h"]
    own = []
    for n in names:  # beside columns of any name
        n = f"row_{n}"
        while n in docs.columns:
            n += "_"
        own.append(n)
    keyed = docs.withColumns({n: c for n, c in zip(own, row_key(), strict=True)})
    gone = rows.filter(~F.col("leads")).select(*(F.col(n).alias(o) for n, o in zip(names, own, strict=True))).distinct()
    kept = keyed.join(gone, own, "left_anti")
    again = rows.filter("leads and n_shingles > 0").groupBy(*(F.col(n).alias(o) for n, o in zip(names, own, strict=True))).count().filter("count > 1").select(*own)
    if not again.isEmpty():  # rows equal in id and text
        kept = kept.join(again, own, "left_anti").unionByName(kept.join(again, own, "left_semi").dropDuplicates(own))
    return kept.select(*docs.columns)


def _near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    """All that runs Python is done when this returns."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(128, -(-chars // BLOCK_CHARS))
    spark = docs.sparkSession
    met = _meet(_meet_inputs(docs, blocks)).checkpoint()
    release_shuffles(spark)
    keys, none = F.col("own").bitwiseAND(NO_ID - 1), F.col("own").bitwiseAND(NO_ID) > 0
    rows = met.filter("kind = 0").select("id", none.alias("none"), "h", "sig", "n", keys.alias("keys"))
    reps = rows.filter("n > 0").groupBy("sig").agg(F.min(F.struct("none", "id", "h")).alias("rep"), F.first("n").alias("n"), F.max("keys").alias("keys"))
    lows = F.array(*[F.lit(int(x)) for x in LOWS[:64]])
    band_of = (F.size(F.filter(lows, lambda x: x <= F.col("n"))) - 1).cast("long")
    reps = reps.withColumn("own", F.col("keys").bitwiseAND((1 << 32) - 1)).withColumn("after", F.shiftright("keys", 32)).withColumn("band", band_of).drop("keys").checkpoint()
    buckets = _possible(met.filter("kind = 1").groupBy("g", "members").agg(F.sum("times").alias("times")), reps).checkpoint()

    release_shuffles(spark)
    sizes = reps.select("sig", "n")
    each = buckets.select(F.xxhash64("g", "members").alias("bucket"), "g", F.size("members").alias("size"), "times", F.explode("members").alias("sig"))
    each = each.join(_centrality(each, reps), ["sig", "g"]).checkpoint()

    def stars(labels: DataFrame) -> DataFrame:
        """In each bucket with more components than one, the most central member with those outside its component."""
        lead = each.join(labels, "sig").select("bucket", "times", "sig", "n", "component", "centre")
        top = lead.groupBy("bucket").agg(F.max_by(F.struct("sig", "n", "component"), F.struct("centre", "sig")).alias("lead"), F.min("component").alias("c0"), F.max("component").alias("c1"))
        pairs = lead.join(top.filter("c0 <> c1").drop("c0", "c1"), "bucket").filter("component <> lead.component")
        pairs = pairs.groupBy(F.least("sig", "lead.sig").alias("u"), F.greatest("sig", "lead.sig").alias("v")).agg(F.sum("times").alias("times"), F.max(F.greatest("n", "lead.n")).alias("large"), F.min(F.least("n", "lead.n")).alias("small"))
        return pairs.filter((F.col("small") * 100 >= F.col("large") * percent) & (F.col("times") * 8 >= F.col("small"))).select("u", "v").checkpoint()

    sizes = reps.select("sig", "n")
    star_pairs = stars(sizes.withColumn("component", F.col("sig")))
    wanted = buckets.select(F.explode("members").alias("sig")).distinct().join(reps, "sig").select("rep.id", "rep.none", "sig")
    sets = _sets(docs, wanted).checkpoint()
    release_shuffles(spark)
    linked = _verified(star_pairs, sets, percent).checkpoint()
    first = components(linked)
    release_shuffles(spark)

    labels = sizes.join(first.withColumnRenamed("id", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    each = each.drop("centre")
    rest = _crossed(each, reps, labels, sets, percent).join(star_pairs, ["u", "v"], "left_anti")
    final = components(linked.unionByName(_verified(rest, sets, percent)))
    release_shuffles(spark)
    ranked = reps.select("sig", "rep").join(final.withColumnRenamed("id", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    # the smallest id of a class goes to each of its sets; classes may be large, so their keys are salted
    least = ranked.groupBy("component").agg(F.min("rep").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    classes = ranked.withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int")).join(least, ["component", "salt"]).select("sig", "least")
    doc_id = lambda x: F.when(~F.col(f"{x}none"), F.col(f"{x}id"))
    out = rows.join(classes, "sig", "left")
    leads = (F.col("n") == 0) | (F.struct("none", "id", "h") == F.col("least"))
    own = F.when(F.col("n") > 0, doc_id("least.")).otherwise(doc_id(""))
    return out.select(doc_id("").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"), "id", "none", "h", leads.alias("leads"))
