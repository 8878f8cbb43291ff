"""How much of a chunk's kd-tree a search opens, and that it finds what a whole scan finds."""

from collections import Counter

import numpy as np
import pytest

from tessera.llm import neighbours

LIMIT = neighbours.chi_square_quantile(neighbours.CONFIDENCE, neighbours.PROJECTIONS)


def searched(v, k=21):
    """Shares of leaves opened, rows projected and rows verified, and recall, of every 20th row as a query."""
    space = neighbours.Space(v.shape[1], np.sqrt((v * v).sum(axis=1).max()))
    order, edge = neighbours.leaf_order(space.rows(v))
    work, q = Counter(), v[::20]
    at, found, _, verified = neighbours.search_chunk(space, order, v[order], np.arange(len(q)), q, np.full(len(q), -np.inf), k, LIMIT, edge, work)
    best = np.argsort(-(q @ v.T), axis=1, kind="stable")[:, :k]
    recall = sum(len(set(found[at == i]) & set(best[i])) for i in range(len(q))) / best.size
    return len(edge), work["leaves"] / len(q) / len(edge), work["rows"] / q.shape[0] / len(v), verified / len(q) / len(v), recall


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_leaves_of_clusters_are_passed_over():
    rng = np.random.default_rng(1)
    v = unit(rng.standard_normal((40, 64))[rng.integers(0, 40, 8192)] + 0.15 * rng.standard_normal((8192, 64)))
    leaves, opened, projected, verified, recall = searched(v)
    assert leaves == 128 and opened < 0.1 and projected < 0.1 and verified < 0.05 and recall >= 0.9


@pytest.mark.parametrize("n", [500, 2000])
def test_leaves_at_every_size(spark, n):
    """The tables' vectors hardly differ in distance: a tree rules out next to no leaf of theirs, the row-wise test about a third or more of the rows."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").limit(n).select("embedding").collect()
    leaves, opened, projected, verified, recall = searched(np.array([r[0] for r in rows], float))
    assert leaves >= n // 64 and opened <= 1 and projected <= 1 and verified < 0.75 and recall >= 0.9


def test_one_leaf_or_many_find_alike():
    rng = np.random.default_rng(3)
    v = unit(rng.standard_normal((300, 8)))
    v[40:70] = v[3]
    space, ids, none = neighbours.Space(8, 1.0), np.arange(300), np.full(300, -np.inf)
    order, edge = neighbours.leaf_order(space.rows(v))
    one = neighbours.search_chunk(space, ids, v, ids, v, none, 5, 1e9, np.zeros(1, np.int64))
    many = neighbours.search_chunk(space, ids[order], v[order], ids, v, none, 5, 1e9, edge)
    assert len(edge) > 2 and all((a == b).all() for a, b in zip(one[:3], many[:3], strict=True))


def test_leaves_of_few_or_equal_rows():
    for v in (np.ones((1, 4)), np.ones((200, 4))):
        space = neighbours.Space(4, 2.0)
        order, edge = neighbours.leaf_order(space.rows(v))
        at, found, score, _ = neighbours.search_chunk(space, order, v[order], np.arange(1), v[:1], np.full(1, -np.inf), 3, LIMIT, edge)
        assert edge.tolist() == [0] and found.tolist() == list(range(min(3, len(v)))) and (score == 4).all()


def test_queries_that_no_leaf_can_serve():
    """Queries whose k-th score rules out every box of a chunk find nothing there, and don't hinder the others."""
    rng = np.random.default_rng(5)
    v = unit(rng.standard_normal((300, 8)) * 0.01 + np.eye(8)[0])
    space = neighbours.Space(8, 1.0)
    order, edge = neighbours.leaf_order(space.rows(v))
    q = np.stack([-np.eye(8)[0], np.eye(8)[0]])
    for kth, hits in (([1 - 1e-12, 1 - 1e-12], 0), ([1 - 1e-12, -np.inf], 3)):
        at, found, score, verified = neighbours.search_chunk(space, order, v[order], np.arange(2), q, np.array(kth), 3, LIMIT, edge)
        assert len(found) == len(score) == hits and set(at) <= {1} and (verified > 0) == (hits > 0)
