"""Approximate nearest neighbours by inner product: stable projections, a kd-tree of cells, chi-square stopping.

Vectors get one more component that brings them to the largest norm, so the
largest inner product is the smallest distance. A few Gaussian (2-stable)
projections are indexed by one kd-tree, fitted on a bounded sample (SAMPLE rows, the
first by a hash of the vector); every row is dealt to the cell that holds it, and large cells
are cut into chunks of CHUNK_BYTES by a hash. A query first searches its own cell. With the k-th
distance d so far and something at projected distance r, r**2 / d**2 of a better neighbour
would follow a chi-square law with as many degrees as projections, so nothing with
r**2 / d**2 beyond that law's quantile at `confidence` is looked at: cells by the
distance to the box of their rows, and in a cell leaves and single rows. For that, each chunk has a kd-tree of its own, down to leaves of
LEAF_ROWS rows at every size of table. Leaves are opened in the order of the distance of their boxes, and rows of opened ones are verified
on the original vectors, with the k-th distance that those before left, until the test holds for the next leaf.

Equal vectors are one query, and only the k + 1 smallest ids of equal vectors are
candidates, as no others can be among the k nearest of any row: so one very common vector costs what a rare one does.
Scores of the rows returned are added in the order of the components, so equal vectors tie.

Every row is indexed. Vectors that are null or zero, or hold nulls or non-finite
components, take no part, nor do rows without vec_id. Vectors meet those of their own width. Fewer candidates than
k: all of them. Rows that repeat both id and vector count once; an id with several vectors is
searched for with each, and another id is returned once, with its best score. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
PROJECTIONS = 24
CONFIDENCE = 0.95
SAMPLE = 20_000
SAMPLE_A_CELL = 16
CHUNK_BYTES = 4 << 20
LEAF_ROWS = 64
RINGS = (0.6, 1.0)
ROWS = 128


def chi_square_quantile(p: float, degrees: int) -> float:
    """Bisection on the distribution function of an even number of degrees."""
    m = degrees // 2

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, m):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 20.0 * degrees
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Cells:
    """A kd-tree over projections of a sample: the largest leaf is cut at its median, along its widest axis, until there are `count`."""

    def __init__(self, sample: np.ndarray, count: int):
        axis, cut, child = [-1], [0.0], [(-1, -1)]
        heap = [(-len(sample), 0, np.arange(len(sample)))]
        leaves = 1
        while leaves < count and heap:
            _, node, rows = heapq.heappop(heap)
            x = sample[rows]
            a = int(np.argmax(np.ptp(x, axis=0))) if len(rows) > 1 else 0
            values = np.unique(x[:, a]) if len(rows) > 1 else np.zeros(1)
            if len(values) < 2:
                continue
            c = max(np.median(x[:, a]), values[1])
            left = x[:, a] < c
            axis[node], cut[node], child[node] = a, c, (len(axis), len(axis) + 1)
            for part in (rows[left], rows[~left]):
                heapq.heappush(heap, (-len(part), len(axis), part))
                axis.append(-1), cut.append(0.0), child.append((-1, -1))
            leaves += 1
        self.axis, self.cut, self.child = np.array(axis), np.array(cut), np.array(child)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.zeros(len(points), np.int64)
        while (i := np.flatnonzero(self.axis[at] >= 0)).size:
            right = points[i, self.axis[at[i]]] >= self.cut[at[i]]
            at[i] = self.child[at[i], right.astype(int)]
        return at


class Space:
    """What projects vectors of one width: the largest norm and the projections."""

    def __init__(self, width: int, top: float):
        self.top = top
        self.matrix = np.random.default_rng([17, width]).standard_normal((width + 1, PROJECTIONS))

    def rows(self, v: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.top * self.top - np.einsum("ij,ij->i", v, v), 0))
        return v @ self.matrix[:-1] + lift[:, None] * self.matrix[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.matrix[:-1]

    def square(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Squared distance of each query to what has the inner product `kth` with it, and a little more for rounding."""
        size = np.einsum("ij,ij->i", q, q) + self.top * self.top
        return np.maximum(size - 2 * kth, 0) + 1e-9 * size


def leaf_order(p: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings the rows of a chunk together by leaf of its own kd-tree, and where each leaf begins."""
    of = Cells(p, -(-len(p) // leaf_rows)).of(p)
    order = np.argsort(of, kind="stable")
    return order, np.flatnonzero(np.diff(of[order], prepend=-1))


def search_chunk(space: Space, ids, v, q_ids, q, kth, k: int, limit: float, edge=None, work: Counter | None = None):
    """The k best rows of a chunk for each query: query places, ids, scores, and how many rows were verified in all.

    kth: the k-th best inner product that a query already has, -inf without. edge: where leaves begin, if rows come in the order of leaves.
    A query opens leaves by the distance of their boxes, three times as many at each step; of the rows of opened leaves
    it verifies those that the test lets through, in rings of rising projected distance, and ends when the next leaf's box fails it. `work` counts leaves opened and rows projected.
    """
    if edge is None:
        order, edge = leaf_order(space.rows(v))
        ids, v = ids[order], v[order]
    p, out, verified, work = space.rows(v), [], 0, Counter() if work is None else work
    p2 = np.einsum("ij,ij->i", p, p)
    low, high, ends = np.minimum.reduceat(p, edge), np.maximum.reduceat(p, edge), np.append(edge[1:], len(ids))
    for begin in range(0, len(q), ROWS):
        part = q[begin : begin + ROWS]
        z, best = space.queries(part), kth[begin : begin + ROWS].copy()
        z2 = np.einsum("ij,ij->i", z, z)
        gap = np.maximum(np.maximum(low[None] - z[:, None], z[:, None] - high[None]), 0)
        bound = np.einsum("ijk,ijk->ij", gap, gap)
        order = np.argsort(bound, axis=1, kind="stable")
        score = np.full((len(part), len(ids)), -np.inf)
        live, at, step = np.arange(len(part)), 0, 1
        while at < len(edge):
            reach = limit * space.square(part, best)  # without bound as long as there are no k rows to test against
            live = live[bound[live, order[live, at]] <= reach[live]]
            if not len(live):  # at once, if the k-th score of the queries rules out every box of this chunk
                break
            leaf = order[live, at : at + step]
            near = bound[live[:, None], leaf] <= reach[live, None]
            i, leaf = np.repeat(live, near.sum(axis=1)), leaf[near]
            by = np.argsort(leaf, kind="stable")
            i, leaf = i[by], leaf[by]
            new = np.flatnonzero(np.diff(leaf, prepend=-1))
            groups = [(i[a:b], edge[leaf[a]], ends[leaf[a]]) for a, b in zip(new.tolist(), [*new[1:].tolist(), len(leaf)], strict=True)]
            far = [np.maximum(z2[mine, None] + p2[None, x0:x1] - 2 * (z[mine] @ p[x0:x1].T), 0) for mine, x0, x1 in groups]
            work.update(leaves=len(leaf), rows=sum(f.size for f in far))
            for ring in RINGS:  # the nearer rows first, as they bring the k-th distance down for the others
                reach = ring * limit * space.square(part, best)
                for (mine, x0, _), f in zip(groups, far, strict=True):
                    r, c = np.nonzero(f <= reach[mine, None])
                    score[mine[r], x0 + c] = np.einsum("ij,ij->i", part[mine[r]], v[x0 + c])
                    f[r, c] = np.inf
                if len(ids) >= k:
                    best = np.maximum(best, -np.partition(-score, k - 1, axis=1)[:, k - 1])
            at, step = at + step, 3 * step
        done = score > -np.inf
        verified += int(done.sum())
        slack = 1e-9 * (np.linalg.norm(part, axis=1) * space.top)
        i, j = np.nonzero(done & (score >= (best - slack)[:, None]))
        exact = np.zeros(len(i))
        for d in range(v.shape[1]):
            exact += part[i, d] * v[j, d]
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((begin + i[keep], ids[j[keep]], exact[keep]))
    a, b, c = zip(*out, strict=True) if out else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
    return np.concatenate(a), np.concatenate(b), np.concatenate(c), verified


def _matrices(batch, column: str):
    """(width, rows, matrix) of an Arrow column of vectors, for each width in it."""
    values, sizes = batch[column], np.array(batch[column].value_lengths())
    flat, ends = values.flatten().to_numpy(), np.cumsum(sizes)
    for w in np.unique(sizes):
        rows = np.flatnonzero(sizes == w)
        yield int(w), rows, flat[(ends[rows] - w)[:, None] + np.arange(w)]


def _usable(vectors: DataFrame) -> DataFrame:
    good = vectors.filter("vec_id is not null and embedding is not null")
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("v"))
    good = good.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return good.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(5), "v").alias("h2"))


def nearest(vectors: DataFrame, query_modulus: int = 20, k: int = K, confidence: float = CONFIDENCE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose vec_id `query_modulus` divides."""
    import pyarrow as pa

    good, limit = _usable(vectors), chi_square_quantile(confidence, PROJECTIONS)
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    rows = good.withColumn("place", F.dense_rank().over(same)).filter(F.col("place") <= k + 1).dropDuplicates(["vec_id", "h1", "h2"])
    asked = good.filter(F.col("vec_id") % query_modulus == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    asks = asked.select("h1", "h2").distinct().withColumn("asked", F.lit(True))
    rows = rows.join(asks, ["h1", "h2"], "left").select("vec_id", "v", "h1", "h2", (F.col("asked").isNotNull() & (F.col("place") == 1)).alias("asked")).checkpoint()

    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max(norm2).alias("top")).collect()  # a row for each width
    spaces = {r["w"]: Space(r["w"], math.sqrt(r["top"])) for r in facts}

    def project(batches):
        for batch in batches:
            for w, at, m in _matrices(batch, "v"):
                p = spaces[w].rows(m)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), w)), pa.array(list(p), pa.list_(pa.float64()))], names=["w", "p"])

    sample: dict[int, list] = {}
    for r in rows.orderBy("h1", "h2", "vec_id").limit(SAMPLE).select("v").mapInArrow(project, "w long, p array<double>").collect():
        sample.setdefault(r["w"], []).append(r["p"])
    sizes = {r["w"]: max(64, chunk_bytes // (8 * r["w"])) for r in facts}
    trees = {r["w"]: Cells(np.array(s), min(-(-r["n"] // sizes[r["w"]]), -(-len(s) // SAMPLE_A_CELL))) for r in facts for s in [sample.get(r["w"], [[0.0] * PROJECTIONS])]}

    def deal(batches):
        for batch in batches:
            cell, width = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for w, at, m in _matrices(batch, "v"):
                cell[at], width[at] = trees[w].of(spaces[w].rows(m)), w
            yield batch.append_column("w", pa.array(width)).append_column("cell", pa.array(cell))

    dealt = rows.mapInArrow(deal, "vec_id long, v array<double>, h1 long, h2 long, asked boolean, w long, cell long")
    counts = dealt.groupBy("w", "cell").count().collect()  # SAMPLE / SAMPLE_A_CELL cells of a width at most
    counts = F.broadcast(vectors.sparkSession.createDataFrame([(r["w"], r["cell"], -(-r["count"] // sizes[r["w"]])) for r in counts], "w long, cell long, parts long"))
    dealt = dealt.join(counts, ["w", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", "h1"), "parts")).drop("parts")

    def pack(table: pa.Table) -> pa.Table:
        (w, _, v), *_ = _matrices(table.combine_chunks().to_batches()[0], "v")
        p, q = spaces[w].rows(v), table["asked"].to_numpy()
        order, edge = leaf_order(p)
        names = {"h1": table["h1"].to_numpy()[q], "h2": table["h2"].to_numpy()[q], "q": v[q], "ids": table["vec_id"].to_numpy()[order], "v": v[order], "edge": edge, "low": p.min(axis=0), "high": p.max(axis=0)}
        return pa.table({"w": table["w"][:1], "cell": table["cell"][:1]} | {c: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for c, x in names.items()})

    blobs = ", ".join(f"{c} binary" for c in ("h1", "h2", "q", "ids", "v", "edge", "low", "high"))
    chunks = dealt.groupBy("w", "cell", "chunk").applyInArrow(pack, f"w long, cell long, {blobs}").checkpoint()

    # the box of each cell's rows, from those of its chunks
    def boxes(table: pa.Table) -> pa.Table:
        low, high = (np.stack([np.frombuffer(x) for x in table[c].to_pylist()]) for c in ("low", "high"))
        return pa.table({"w": table["w"][:1], "cell": table["cell"][:1], "low": [low.min(axis=0).tolist()], "high": [high.max(axis=0).tolist()]})

    box: dict[int, tuple] = {}
    for r in chunks.select("w", "cell", "low", "high").groupBy("w", "cell").applyInArrow(boxes, "w long, cell long, low array<double>, high array<double>").collect():
        for x, y in zip(box.setdefault(r["w"], ([], [], [])), (r["cell"], r["low"], r["high"]), strict=True):
            x.append(y)
    box = {w: tuple(map(np.array, x)) for w, x in box.items()}

    def search(batches):
        for batch in batches:
            for n in range(batch.num_rows):  # a pair of blobs at a time
                w = batch["w"][n].as_py()
                h1, h2, ids, edge = (np.frombuffer(batch[c][n].as_py(), np.int64) for c in ("h1", "h2", "ids", "edge"))
                q, v = (np.frombuffer(batch[c][n].as_py()).reshape(-1, w) for c in ("q", "v"))
                kth = np.frombuffer(batch["kth"][n].as_py()) if batch["kth"][n].is_valid else np.full(len(h1), -np.inf)
                i, found, score, _ = search_chunk(spaces[w], ids, v, h1, q, kth, k + 1, limit, edge)
                yield pa.RecordBatch.from_arrays([pa.array(h1[i]), pa.array(h2[i]), pa.array(found), pa.array(score)], names=["h1", "h2", "vec_id", "score"])

    def searched(queries: DataFrame) -> DataFrame:
        met = queries.join(chunks.select("w", "cell", "ids", "v", "edge"), ["w", "cell"]).select("w", "h1", "h2", "q", "kth", "ids", "v", "edge")
        return met.mapInArrow(search, "h1 long, h2 long, vec_id long, score double")

    home = searched(chunks.filter(F.length("q") > 0).select("w", "cell", "h1", "h2", "q", F.lit(None).cast("binary").alias("kth")))
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    home = home.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1).drop("rank").checkpoint()
    bounds = home.groupBy("h1", "h2").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("kth"))

    def route(batches):
        """Queries for each cell other than their own that may hold something nearer."""
        for batch in batches:
            h1, h2, kth = (batch[c].to_numpy() for c in ("h1", "h2", "kth"))
            for w, at, q in _matrices(batch, "v"):
                z, (cell, low, high) = spaces[w].queries(q), box[w]
                own, reach = trees[w].of(spaces[w].rows(q)), limit * spaces[w].square(q, kth[at])
                for c, lo, hi in zip(cell, low, high, strict=True):
                    gap = np.maximum(np.maximum(lo - z, z - hi), 0)
                    i = np.flatnonzero((own != c) & ~(np.einsum("ij,ij->i", gap, gap) > reach))
                    for begin in range(0, len(i), 512):
                        x = i[begin : begin + 512]
                        data = [h1[at[x]], h2[at[x]], q[x], kth[at[x]]]
                        yield pa.RecordBatch.from_arrays([pa.array([w]), pa.array([c]), *(pa.array([np.ascontiguousarray(y).tobytes()], pa.binary()) for y in data)], names=["w", "cell", "h1", "h2", "q", "kth"])

    sent = rows.filter("asked").select("h1", "h2", "v").join(bounds, ["h1", "h2"]).mapInArrow(route, "w long, cell long, h1 binary, h2 binary, q binary, kth binary")
    found = home.unionByName(searched(sent)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1)

    met = asked.join(found.select("h1", "h2", "vec_id", "score"), ["h1", "h2"]).filter("vec_id <> query_id")
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
