import duckdb
import pandas as pd
import pytest

from tessera.functions import scalar
from tessera.operators import search
from tessera.plans import catalog
from tessera.sources.tables import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(tuple("" if pd.isna(x) else str(x) if not isinstance(x, float) else f"{x:.4f}" for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    norm = lambda df: df.apply(lambda c: c.astype("float64") if c.dtype.kind in "if" else c)
    assert key(norm(got)) == key(norm(want))


def test_phone_with_line_break(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("123456789012345\n",), (None,)], "p string").select(scalar.valid_phone(F.col("p"))).collect()
    assert [r[0] for r in rows] == [False, True]


@pytest.mark.parametrize("query_bytes", [search.QUERY_BYTES, 0])
def test_more_queries_than_a_thousand(spark, query_bytes):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (1300, 4)).astype(float)  # many equal vectors, which tie
    v[(v == 0).all(axis=1)] = 1
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(1300, None), (1301, [0.0] * 4), (1302, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = {}
    for r in search.batch_top_k(rows.filter("vec_id < 1300").repartition(3), rows.repartition(3), 6, query_bytes).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(got) == 1303 and all(x[2] is None for i in (1300, 1301, 1302) for x in got[i])
    plain = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for i in range(0, 1300, 13):
        score = {j: plain(v[i], v[j]) / (plain(v[i], v[i]) ** 0.5 * plain(v[j], v[j]) ** 0.5) for j in range(1300) if j != i}
        want = sorted(score, key=lambda j: (-score[j], j))[:6]
        assert [j for _, j, _ in sorted(got[i])] == want


def test_block_search_is_the_same_by_either_way():
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (90, 3)).astype(float) + 0.1
    block = lambda x, at: search._unpack(at.astype(np.int64).tobytes(), np.full(len(x), 3, np.int64).tobytes(), x.tobytes())
    q, c = block(v[:40], np.arange(40)), block(v, np.arange(90))
    fast = search._nearest_of_one_width(q, c, 7)
    search_one, search._nearest_of_one_width = search._nearest_of_one_width, lambda *_: None
    try:
        slow = search._nearest(q, c, 7)
    finally:
        search._nearest_of_one_width = search_one
    assert all(np.array_equal(x, y) for x, y in zip(fast, slow, strict=True))


def test_lateral_join_keeps_its_order(spark):
    """The limit by customer is a window, and has the order of the SQL however its rows arrive."""
    found = catalog.QUERIES["ext_lateral_join"](spark, DATA)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "row_number() windowspecdefinition" in line)
    assert "o_totalprice" in window and "DESC" in window and "o_orderkey" in window
