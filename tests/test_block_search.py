import numpy as np
import pytest

from tessera.operators import search


def block(ids, vectors):
    widths = np.array([-1 if v is None else len(v) for v in vectors], np.int64)
    return search._unpack(np.asarray(ids, np.int64).tobytes(), widths.tobytes(), np.concatenate([np.zeros(0), *(np.asarray(v, float) for v in vectors if v is not None)]).tobytes())


def nearest(queries, corpus, k):
    """Rows by query id through _add, and the same through _nearest over all pairs."""
    found = []
    for q in search._parts(queries):
        best = None
        for rows in corpus:
            for c in search._corpus(rows, k):
                best = search._add(best, q, c, k)
        found += [(q.block[0][best[0]], *best[1:])] if best else []
    every = [(queries[0][i], c[0][j], score, known) for c in corpus for i, j, score, known in [search._nearest(queries, c, k)]]
    return (search._best(*(np.concatenate(x) for x in zip(*rows, strict=True)), k) for rows in (found, every))


def test_few_pairs_are_scored_exactly(monkeypatch):
    """all pairs are compared, but only those that can be among the k nearest go beyond one product of short floats."""
    rng, cells, one = np.random.default_rng(0), [], search._nearest
    v = rng.normal(size=(9000, 64))
    q = search._parts(block(range(1000), v[:1000]))[0]
    monkeypatch.setattr(search, "_nearest", lambda q, c, k: cells.append(len(q[0]) * len(c[0])) or one(q, c, k))
    best = None
    for at in (0, 3000, 6000):
        for c in search._corpus(block(range(at, at + 3000), v[at : at + 3000]), 5):
            best = search._add(best, q, c, 5)
    assert 0 < sum(cells) < 0.02 * 1000 * 9000
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    score = unit[:1000] @ unit.T
    score[np.arange(1000), np.arange(1000)] = -2
    assert np.array_equal(best[1].reshape(1000, 5), np.argsort(-score, axis=1)[:, :5])


@pytest.mark.parametrize("kind", ["copies", "near copies", "ties", "odd"])
def test_same_rows_as_all_pairs(kind):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 6))
    if kind == "copies":
        v = v[rng.integers(0, 12, 1500)]
    elif kind == "near copies":
        v = v[rng.integers(0, 3, 1500)] + rng.normal(size=(1500, 6)) * 1e-5
    elif kind == "ties":
        v = rng.integers(-1, 2, (1500, 6)).astype(float)
    vectors = list(v)
    if kind == "odd":
        for i, x in enumerate([None, np.zeros(6), np.ones(4), np.full(6, 1e-200), np.full(6, 1e200), np.array([np.nan] * 6), np.zeros(0)] * 20):
            vectors[i * 10] = x
    ids = np.sort(rng.integers(0, 900, 1500)) if kind in ("copies", "odd") else np.arange(1500)  # also ids that occur again
    for k in (1, 7):
        with np.errstate(all="ignore"):
            got, want = nearest(block(ids[:700], vectors[:700]), [block(ids[:800], vectors[:800]), block(ids[800:], vectors[800:])], k)
        assert all(np.array_equal(x, y, equal_nan=x.dtype.kind == "f") for x, y in zip(got, want, strict=True))


def test_blocks_hold_thousands_of_rows(spark):
    """a pair of blocks is copied to a worker, so blocks of 512 rows cost a copy of both for every 512 x 512 pairs."""
    from pyspark.sql import functions as F

    rows = spark.range(40_000, numPartitions=1).select(F.col("id").alias("vec_id"), F.array_repeat(F.rand(1), 64).alias("embedding"))
    sizes = [len(r[0]) // 8 for r in search._blocks(rows, "c", search.CORPUS_BYTES).select("c_ids").collect()]
    assert sum(sizes) == 40_000 and len(sizes) <= 4
    plan = search._crossed(rows, rows, 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan


def test_odd_rows_by_either_way(spark):
    rng = np.random.default_rng(2)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.integers(-1, 2, (900, 3)).astype(float))]
    rows += [(900, None), (901, [1.0, None, 2.0]), (902, []), (903, [1.0, 2.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    scanned, crossed = (sorted(map(tuple, search.batch_top_k(e, e, 4, size).select("query_id", "rank", "vec_id", "score").collect()), key=str) for size in (search.QUERY_BYTES, 0))
    assert scanned == crossed and len(scanned) == 904 * 4
    assert all(r[3] is None for r in scanned if r[0] >= 900)
