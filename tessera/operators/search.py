"""Exact vector search: one query against a scanned corpus, or any number of queries in blocks against blocks of the corpus."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar

BLOCK = 512
QUERY_BYTES = 32_000_000
MARGIN = 1e-9
TILE_BYTES = 2_000_000  # queries of a pair of partitions
CORPUS_BYTES = 8_000_000  # a block of the corpus
PART_BYTES = 64_000_000  # rows of the corpus of a pair of partitions


def top_k(corpus: DataFrame, query: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """The k rows nearest to the only row of `query` by cosine, with percent and band; more rows are an error, batch_top_k takes them."""
    one = F.when(F.count("*").over(Window.partitionBy()) > 1, F.raise_error(F.lit("top_k takes one query: use batch_top_k"))).otherwise(F.lit(True))
    query = query.limit(2).withColumn("one", one).filter("one")
    q = F.broadcast(query.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), scalar.norm(F.col("embedding")).alias("q_norm")))
    rows = corpus.join(q, F.col("vec_id") != F.col("query_id") if exclude_self else F.lit(True))
    score = scalar.dot(F.col("embedding"), F.col("q")) / (scalar.norm(F.col("embedding")) * F.col("q_norm"))
    rows = rows.select("query_id", "vec_id", score.alias("score")).withColumn("percent", scalar.percent(F.col("score")))
    # nothing but one projection may stand above the limit, or Spark sorts the whole corpus instead of taking the best of each task
    return rows.withColumn("band", scalar.similarity_band(F.col("percent"))).orderBy(F.desc("score"), "vec_id").limit(k)


def _rows(rows: DataFrame) -> DataFrame:
    return rows.filter("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))


def _packed(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block of rows by id: ids, widths (-1: no vector, or one with null elements) and values."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, rows = (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in (batch["vec_id"], batch["embedding"]))
    ids, flat = ids.to_numpy(), rows.flatten()
    widths = pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.maximum(widths, 0)
    starts = np.cumsum(sizes) - sizes
    if flat.null_count:
        widths[np.repeat(np.arange(len(ids)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    order = np.argsort(ids, kind="stable")
    sizes = np.maximum(widths, 0)[order]
    at = np.repeat(starts[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return ids[order], widths[order], flat.to_numpy(zero_copy_only=False)[at]


def _slices(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            yield batch.slice(i, BLOCK)


def _gathered(batches, size: int):
    """Slices put together to about `size` bytes; the batches may be smaller."""
    import pyarrow as pa

    held, taken = [], 0
    for part in _slices(batches):
        held.append(part)
        taken += part.nbytes
        if taken >= size:
            yield pa.Table.from_batches(held)
            held, taken = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _blocks(rows: DataFrame, prefix: str, size: int = 0) -> DataFrame:
    """Blocks of about `size` bytes, or of at most BLOCK rows, as bytes."""
    import pyarrow as pa

    names = [f"{prefix}_{c}" for c in ("ids", "widths", "values")]

    def pack(batches):
        for part in _gathered(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in _packed(part)], names=names)

    return _rows(rows).mapInArrow(pack, ", ".join(f"{c} binary" for c in names))


def _unpack(ids, widths, values):
    """Ids, and for each width the places of its vectors, the vectors and their norms."""
    width, value = np.frombuffer(widths, np.int64), np.frombuffer(values)
    ends = np.cumsum(np.maximum(width, 0))
    out = {}
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        v = value.reshape(-1, w) if len(at) == len(width) else value[(ends[at] - w)[:, None] + np.arange(w)]
        square = np.zeros(len(at))
        for d in range(w):
            square += v[:, d] * v[:, d]
        out[int(w)] = at, v, np.sqrt(square)
    return np.frombuffer(ids, np.int64), out


def _nearest_of_one_width(q, c, k: int):
    """_nearest by a matrix product that leaves all rows within MARGIN of the k-th, scored exactly then; None if a vector is unknown, extreme or of another width."""
    (q_ids, q_by), (c_ids, c_by) = q, c
    if len(q_by) != 1 or q_by.keys() != c_by.keys():
        return None
    ((at, a, na),), ((to, b, nb),) = q_by.values(), c_by.values()
    if len(at) < len(q_ids) or len(to) < len(c_ids) or not all(((x > 1e-100) & (x < 1e100)).all() for x in (na, nb)):
        return None
    rough = (a / na[:, None]) @ (b / nb[:, None]).T
    other = q_ids[:, None] != c_ids[None]
    rough[~other] = -2
    last = -np.partition(-rough, min(k, len(c_ids)) - 1, axis=1)[:, min(k, len(c_ids)) - 1]
    i, j = np.nonzero((rough >= last[:, None] - MARGIN) & other)
    dot = np.zeros(len(i))
    for d in range(a.shape[1]):
        dot += a[i, d] * b[j, d]
    score = dot / (na[i] * nb[j])
    order = np.lexsort((j, -score, i))
    i, j, score = i[order], j[order], score[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], j[best], score[best], np.ones(int(best.sum()), bool)


def _nearest(q, c, k: int):
    """The k nearest rows of block c for each of block q: places in q and c, scores, which scores are known.

    Products are added in the order of the elements, as scalar.cosine does, so that equal vectors tie.
    """
    (q_ids, q_by), (c_ids, c_by) = q, c
    if (found := _nearest_of_one_width(q, c, k)) is not None:
        return found
    score, known = np.zeros((len(q_ids), len(c_ids))), np.zeros((len(q_ids), len(c_ids)), bool)
    for w in q_by.keys() & c_by.keys():
        (i, a, na), (j, b, nb) = q_by[w], c_by[w]
        dot, term = np.zeros((len(i), len(j))), np.empty((len(i), len(j)))
        for d in range(w):
            np.multiply(a[:, d, None], b[None, :, d], out=term)
            dot += term
        size = na[:, None] * nb[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            score[np.ix_(i, j)] = dot / size
        known[np.ix_(i, j)] = size != 0
    other = q_ids[:, None] != c_ids[None]
    key = np.where(np.isnan(score), -np.inf, -score)  # NaN is the largest, as in Spark
    key = np.where(other, np.where(known, key, 1e300), np.inf)
    best = np.argsort(key, axis=1, kind="stable")[:, :k]
    i, j = np.repeat(np.arange(len(q_ids)), best.shape[1]), best.ravel()
    keep = other[i, j]
    i, j = i[keep], j[keep]
    return i, j, score[i, j], known[i, j]


def _best(queries, vectors, score, known, k: int):
    """The k nearest of each query: unknown scores last, NaN as the largest, ties to the smaller id."""
    key = np.where(known, np.where(np.isnan(score), -np.inf, -score), np.inf)
    order = np.lexsort((vectors, key, queries))
    group = queries[order]
    order = order[np.arange(len(order)) - np.searchsorted(group, group) < k]
    return queries[order], vectors[order], score[order], known[order]


class _Part(NamedTuple):
    """Rows of a block: of kind w > 0, vectors of width w and their directions as short floats; of kind 0, no vectors or zero ones; of kind -1, extreme ones."""

    kind: int
    block: tuple
    unit: np.ndarray | None


def _take(block, at):
    """The rows of a block at some places, given in order."""
    ids, by = block
    if len(at) == len(ids):
        return block
    place = np.full(len(ids), -1)
    place[at] = np.arange(len(at))
    kept = {w: (i, place[i] >= 0, v, n) for w, (i, v, n) in by.items()}
    return ids[at], {w: (place[i[own]], v[own], n[own]) for w, (i, own, v, n) in kept.items() if own.any()}


def _parts(block) -> list[_Part]:
    ids, by = block
    kind = np.zeros(len(ids), np.int64)
    for w, (at, _, norm) in by.items():
        kind[at] = np.where(norm == 0, 0, np.where((norm > 1e-100) & (norm < 1e100), w, -1))
    out = []
    for x in np.unique(kind):
        own = _take(block, np.flatnonzero(kind == x))
        unit = (own[1][x][1] / own[1][x][2][:, None]).astype(np.float32) if x > 0 else None
        out.append(_Part(int(x), own, unit))
    return out


def _few(ids, group, k: int):
    """Places of rows of each group that hold its k smallest ids whichever id a query leaves out: k of an id, and 2 * k in all."""
    order = np.lexsort((ids, group))
    for keys, most in (((group, ids), k), ((group,), 2 * k)):
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)
        first = np.flatnonzero(new)
        order = order[np.arange(len(order)) - first[np.cumsum(new) - 1] < most]
    return np.sort(order)


def _without_copies(c: _Part, k: int) -> _Part:
    """Of equal vectors those that can be among the k nearest: they tie, so the ids decide."""
    ids, ((_, v, _),) = c.block[0], c.block[1].values()
    odd = np.random.default_rng(0).integers(1, 1 << 63, v.shape[1], dtype=np.uint64) | np.uint64(1)
    mixed = (np.ascontiguousarray(v).view(np.uint64) * odd).sum(axis=1)
    _, group, n = np.unique(mixed, return_inverse=True, return_counts=True)
    again = np.flatnonzero(n[group] > 2 * k)  # fewer copies than are kept are no matter
    if not len(again):
        return c
    _, equal = np.unique(np.ascontiguousarray(v[again]).view(f"V{8 * v.shape[1]}").ravel(), return_inverse=True)
    keep = n[group] <= 2 * k
    keep[again[_few(ids[again], equal, k)]] = True
    at = np.flatnonzero(keep)
    return _Part(c.kind, _take(c.block, at), c.unit[at])


def _corpus(block, k: int) -> list[_Part]:
    return [_without_copies(c, k) if c.kind > 0 else c for c in _parts(block)]


def _last(best, n: int, k: int):
    """The k-th score of each of n queries, which a row has to reach; -inf where there are fewer."""
    last = np.full(n, -np.inf)
    if best:
        queries, _, score, known = best
        kth = np.flatnonzero(np.arange(len(queries)) - np.searchsorted(queries, queries) == k - 1)
        kth = kth[known[kth]]
        last[queries[kth]] = score[kth]
    return last


def _places(mask):
    """np.nonzero of a matrix with few true cells."""
    if mask.size % 8:
        return np.nonzero(mask)
    words = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    word, cell = np.nonzero(mask.reshape(-1, 8)[words])
    return np.divmod(words[word] * 8 + cell, mask.shape[1])


def _reaching(q: _Part, c: _Part, start: int, stop: int, last, k: int) -> list[tuple]:
    """Rows of c from start to stop whose score reaches `last`, with places in q, ids, scores.

    Products of short floats leave rows that miss `last` by more than these products can be wrong; the others are scored exactly,
    in the order of scalar.cosine. Where many are left, as at the beginning or among near copies, _nearest chooses.
    """
    ((_, a, na),), ((_, b, nb),) = q.block[1].values(), c.block[1].values()
    low = np.nextafter((last - (q.kind + 8) * 2.0**-23).astype(np.float32), np.float32(-np.inf))
    found, places = [], []
    rough, mask = np.empty(BLOCK * BLOCK, np.float32), np.empty(BLOCK * BLOCK, bool)
    for x in range(0, len(a), BLOCK):
        to = min(x + BLOCK, len(a))
        for y in range(start, stop, BLOCK):
            end = min(y + BLOCK, stop)
            product, near = (z[: (to - x) * (end - y)].reshape(to - x, end - y) for z in (rough, mask))
            np.matmul(q.unit[x:to], c.unit[y:end].T, out=product)
            i, j = _places(np.greater_equal(product, low[x:to, None], out=near))
            if 8 * len(i) > near.size:
                i, j, score, known = _nearest(_take(q.block, np.arange(x, to)), _take(c.block, np.arange(y, end)), k)
                found.append((x + i, c.block[0][y + j], score, known))
            else:
                places.append((x + i, y + j))
    if places:
        i, j = (np.concatenate(x) for x in zip(*places, strict=True))
        other = q.block[0][i] != c.block[0][j]
        i, j = i[other], j[other]
        for x in range(0, len(i), 8 * BLOCK):
            p, r = i[x : x + 8 * BLOCK], j[x : x + 8 * BLOCK]
            dot = np.zeros(len(p))
            for term in np.ascontiguousarray((a[p] * b[r]).T):
                dot += term
            score = dot / (na[p] * nb[r])
            own = score >= last[p]
            found.append((p[own], c.block[0][r[own]], score[own], np.ones(int(own.sum()), bool)))
    return found


def _add(best, q: _Part, c: _Part, k: int):
    """The k nearest rows of each query of q, by place, among those of `best` and of c."""
    merged = lambda found: _best(*(np.concatenate(x) for x in zip(*([best] if best else []), *found, strict=True)), k)
    rows = len(c.block[0])
    if q.kind == c.kind > 0:
        start, step = 0, rows if best else max(64, 16 * k)
        while start < rows:
            stop = min(start + step, rows)
            if found := _reaching(q, c, start, stop, _last(best, len(q.block[0]), k), k):
                best = merged(found)
            start, step = stop, stop
        return best
    block = c.block if -1 in (q.kind, c.kind) else _take(c.block, _few(c.block[0], np.zeros(rows), k))  # else no score is known
    for x in range(0, len(q.block[0]), BLOCK):
        own = _take(q.block, np.arange(x, min(x + BLOCK, len(q.block[0]))))
        for y in range(0, len(block[0]), BLOCK):
            near = _take(block, np.arange(y, min(y + BLOCK, len(block[0]))))
            i, j, score, known = _nearest(own, near, k)
            best = merged([(x + i, near[0][j], score, known)])
    return best


def _found(parts: list[_Part], best: list):
    for q, b in zip(parts, best, strict=True):
        if b:
            yield _table(q.block[0][b[0]], *b[1:])


def _bytes(rows: DataFrame) -> int:
    """About what blocks of these rows take."""
    n, values = rows.agg(F.count("*"), F.sum(F.greatest(F.size("embedding"), F.lit(0)))).first()
    return 16 * n + 8 * (values or 0)


def _table(queries, vectors, score, known):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(queries), pa.array(vectors), pa.array(score, pa.float64(), mask=~known)], names=["query_id", "vec_id", "score"])


def batch_top_k(corpus: DataFrame, queries: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k nearest rows of each query by cosine, for any number of queries.

    Up to `query_bytes` of queries are sent to the tasks, and each task scans its part of
    the corpus once, in blocks: the corpus is neither shuffled nor broadcast. More queries are written as blocks of TILE_BYTES, the corpus as
    partitions of PART_BYTES, and every pair of the two is a task. Either way only a task's k nearest rows of a query go on.
    A score is null, and ranked last, if a vector is null, has a null element, is zero, or is of another width.
    """
    size = _bytes(queries)
    near = _scanned(corpus, queries, k) if size <= query_bytes else _crossed(corpus, queries, k, size)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def _scanned(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    blocks = corpus.sparkSession.sparkContext.broadcast([tuple(bytes(x) for x in r) for r in _blocks(queries, "q", TILE_BYTES).collect()])

    def run(batches):
        asked = [q for b in blocks.value for q in _parts(_unpack(*b))]
        best = [None] * len(asked)
        for part in _gathered(batches, CORPUS_BYTES):
            for c in _corpus(_unpack(*(x.tobytes() for x in _packed(part))), k):
                best = [_add(b, q, c, k) for b, q in zip(best, asked, strict=True)]
        yield from _found(asked, best)

    return _rows(corpus).mapInArrow(run, "query_id long, vec_id long, score double")


def _crossed(corpus: DataFrame, queries: DataFrame, k: int, size: int) -> DataFrame:
    def run(batches):
        block, asked, best = None, [], []
        for batch in batches:
            for n in range(batch.num_rows):
                one = [batch[f"q_{y}"][n].as_buffer() for y in ("ids", "widths", "values")]
                if block is None or any(x != y for x, y in zip(one, block, strict=True)):  # the blocks of the corpus follow one another under a block of queries
                    yield from _found(asked, best)
                    block = [x.to_pybytes() for x in one]
                    asked = _parts(_unpack(*block))
                    best = [None] * len(asked)
                for c in _corpus(_unpack(*(batch[f"c_{y}"][n].as_buffer() for y in ("ids", "widths", "values"))), k):
                    best = [_add(b, q, c, k) for b, q in zip(best, asked, strict=True)]
        yield from _found(asked, best)

    cores = corpus.sparkSession.sparkContext.defaultParallelism
    tiles = max(-(-size // TILE_BYTES), min(4 * cores, -(-size // 100_000)), 1)
    parts = -(-_bytes(corpus) // PART_BYTES) or 1
    left = _blocks(queries.repartition(tiles), "q", 2 * TILE_BYTES).checkpoint()
    right = _blocks(corpus.repartition(parts), "c", CORPUS_BYTES).checkpoint()
    pairs = left.crossJoin(right.hint("shuffle_replicate_nl"))  # never one broadcast side
    return pairs.mapInArrow(run, "query_id long, vec_id long, score double")


def not_indexed(files: DataFrame, index: DataFrame, key: str = "fingerprint") -> DataFrame:
    return files.join(index.select(key).distinct(), key, "left_anti")
