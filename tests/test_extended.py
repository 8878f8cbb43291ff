"""The stored index, streams with state, mergeable counts, interval joins, further sources and table functions beyond their SQL."""

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import tablefunctions
from tessera.operators import hashtree, index, intervals, ivf, rollups, search
from tessera.plans import extended
from tessera.sources import bucketed, sqlite
from tessera.streaming import folder, sessions

DATA = "/root/testdata/sf0.1"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def files(df) -> int:
    return df.select(F.input_file_name()).distinct().count()


# the index of inverted lists


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    e, at = spark.read.parquet(f"{DATA}/embeddings.parquet"), str(tmp_path_factory.mktemp("ivf") / "index")
    assert ivf.build(e, at).count() == 0
    ivf.calibrate(spark, at, e.filter("vec_id % 7 = 3"), 10)
    return e, at


def pairs(found):
    return {(r["query_id"], r["vec_id"]) for r in found.collect()}


def test_index_reaches_its_recall_and_reads_fewer_files(spark, built):
    e, at = built
    queries = e.filter("vec_id % 20 = 0")
    truth = pairs(search.batch_top_k(e, queries, 10))
    assert len(pairs(ivf.find(spark, at, queries, 10)) & truth) >= 0.9 * len(truth)
    one = ivf.find(spark, at, e.filter("vec_id = 40"), 10)
    assert "PartitionFilters: [list" in plan(one)
    probes = ivf._probes(spark, at, 10)
    assert files(ivf.lists(spark, at, np.arange(probes))) < files(ivf.lists(spark, at))


def test_exact_search_equals_a_scan_with_one_probe(spark, built):
    e, at = built
    queries = e.filter("vec_id % 100 = 7")
    want = sorted(map(tuple, search.batch_top_k(e, queries, 7).select("query_id", "vec_id", "rank").collect()))
    assert sorted(map(tuple, ivf.find(spark, at, queries, 7, probes=1, exact=True).select("query_id", "vec_id", "rank").collect())) == want
    parts = ivf.find(spark, at, queries, 7, probes=1, exact=True, query_bytes=3000)
    assert sorted(map(tuple, parts.select("query_id", "vec_id", "rank").collect())) == want


def clustered(n=600, groups=12, width=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return [(i, (centres[i % groups] + 0.05 * rng.normal(size=width)).tolist()) for i in range(n)]


def test_index_of_clusters_prunes_and_grows(spark, tmp_path):
    rows = clustered()
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("folder", F.lit("a"))
    at = str(tmp_path / "index")
    ivf.build(e.filter("vec_id < 500"), at, lists=12)
    ivf.add(e.filter("vec_id >= 500"), at)
    queries = e.filter("vec_id % 50 = 0")
    assert ivf.lists(spark, at).count() == 600 and "folder" in ivf.lists(spark, at).columns
    found = ivf.find(spark, at, queries, 5, probes=1, exact=True)
    assert pairs(found) == pairs(search.batch_top_k(e, queries, 5))
    # rows of a cluster are nearest to one another, so the triangle inequality leaves other lists unread
    assert found.select("query_id", "list").distinct().count() <= 2 * queries.count()
    assert ivf.calibrate(spark, at, queries, 5) <= 2


def test_index_of_odd_rows(spark, tmp_path):
    rows = clustered(60) + [(60, None), (61, [0.0] * 8), (62, [1.0]), (63, [1.0, None] * 4), (64, [float("nan")] * 8), (65, [float("inf")] * 8), (None, [1.0] * 8), (3, clustered(60)[3][1]), (3, clustered(60)[3][1])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    at = str(tmp_path / "index")
    refused = ivf.build(e, at, lists=4)
    assert sorted(r["vec_id"] for r in refused.collect()) == [60, 61, 62, 63, 64, 65]
    found = ivf.find(spark, at, e, 100).collect()
    assert not {r["query_id"] for r in found} & {60, 61, 62, 63, 64, 65} and None not in {r["vec_id"] for r in found}
    assert sum(r["query_id"] == 5 and r["vec_id"] == 3 for r in found) == 3
    assert ivf.find(spark, at, e.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        ivf.build(e.filter("vec_id = 60"), str(tmp_path / "none"))


def test_a_large_list_is_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "ROWS_A_FILE", 50)
    e = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(400 + i, [-1.0, 0.1 * i, 0.0]) for i in range(20)], "vec_id long, embedding array<double>")
    ivf.build(e, str(tmp_path / "index"), lists=2)
    by = ivf.lists(spark, str(tmp_path / "index")).withColumn("file", F.input_file_name()).groupBy("list").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).collect()
    assert any(r["n"] == 400 and r["files"] >= 3 for r in by) and sum(r["n"] for r in by) == 420


def test_additions_again_removals_and_compaction(spark, tmp_path):
    e = spark.createDataFrame(clustered(200), "vec_id long, embedding array<double>").withColumn("folder", F.col("vec_id") % 2)
    at, to = str(tmp_path / "index"), str(tmp_path / "smaller")
    ivf.build(e.filter("vec_id < 100"), at, lists=5)
    for _ in range(2):
        ivf.add(e.filter("vec_id >= 100"), at, "batch-1")
    assert ivf.lists(spark, at).count() == 200
    ivf.remove(e.filter("vec_id % 10 = 3"), at)
    left, queries = e.filter("vec_id % 10 <> 3"), e.filter("vec_id % 40 = 0")
    ivf.calibrate(spark, at, queries, 6)
    ivf.compact(spark, at, to)
    for folder_ in (at, to):
        assert ivf.lists(spark, folder_).count() == 180 and ivf._probes(spark, folder_, 6) == ivf._probes(spark, at, 6)
        assert pairs(ivf.find(spark, folder_, queries, 6, probes=1, exact=True)) == pairs(search.batch_top_k(left, queries, 6))
        odd = ivf.find(spark, folder_, queries, 6, probes=1, exact=True, where=F.col("folder") == 1)
        assert pairs(odd) == pairs(search.batch_top_k(left.filter("folder = 1"), queries, 6))
    assert spark.read.parquet(f"{to}/lists").select("added").distinct().count() == 1


# plans of the exact search


def test_top_k_takes_the_best_of_each_task(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    for found in (search.top_k(e, e.filter("vec_id = 0"), 10), search.top_k(e, e.filter("vec_id = 0"), 10).withColumn("score", F.round("score", 6)), index.find(e.withColumn("folder", F.lit("a")), e.filter("vec_id = 0"), 10, "a")):
        assert "TakeOrderedAndProject" in plan(found) and "rangepartitioning" not in plan(found)


def test_batch_search_neither_shuffles_nor_broadcasts_the_corpus(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    text = plan(search.batch_top_k(e, e.filter("vec_id % 20 = 0"), 5))
    assert text.count("Exchange") == 1 and "hashpartitioning(query_id" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_stored_index_prunes_by_folder(spark, tmp_path):
    e = spark.createDataFrame([(i, [float(i), 1.0], f"set\\{i % 40:02d}") for i in range(400)], "vec_id long, embedding array<float>, folder string")
    index.store(e.repartition(4), str(tmp_path / "index"), 2)
    stored = index.load(spark, str(tmp_path / "index"))
    assert stored.filter("folder = 'set\\\\07'").count() == 10 and files(stored) < 40
    assert "PushedFilters: [Or(Or(EqualTo(folder" in index.find(stored, e.filter("vec_id = 7"), 3, "set\\07")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) or "EqualTo(folder" in plan(index.find(stored, e.filter("vec_id = 7"), 3, "set\\07"))


# files on a stream


def facts(spark, at):
    return sorted((r["path"].rsplit("/", 1)[-1], r["fingerprint"], r["size"]) for r in folder.latest(spark.read.parquet(at)).collect())


def test_folder_stream_and_a_batch_that_comes_again(spark, tmp_path):
    source, at, state = tmp_path / "images", str(tmp_path / "index"), str(tmp_path / "state")
    (source / "deep").mkdir(parents=True)
    for name in ("a.jpg", "b.PNG", "deep/c.tiff", "note.txt"):
        (source / name).write_bytes(name.encode() * 10)
    seen = []

    def follow():
        folder.follow(folder.file_stream(spark, str(source), files_a_batch=2), at, state, lambda rows, batch: seen.append((batch, rows.count())))

    follow()
    first = facts(spark, at)
    assert [x[0] for x in first] == ["a.jpg", "b.PNG", "c.tiff"] and sum(n for _, n in seen) == 3
    (source / "d.jpeg").write_bytes(b"new")
    follow()
    assert len(facts(spark, at)) == 4 and spark.read.parquet(at).count() == 4
    # the second run's batch once more, as if the stream had failed before its commit
    last = max(b for b, _ in seen)
    before = sorted(map(tuple, spark.read.parquet(at).collect()))
    again = spark.read.format("binaryFile").load(str(source / "d.jpeg")).select("path", "content", F.col("modificationTime").alias("modified"))
    folder.add_batch(again, last, at)
    assert sorted(map(tuple, spark.read.parquet(at).collect())) == before
    # known files in a new batch add nothing; a changed one replaces what was known
    folder.add_batch(again, last + 1, at)
    assert sorted(map(tuple, spark.read.parquet(at).collect())) == before
    folder.add_batch(again.withColumn("content", F.lit(b"other")), last + 2, at)
    assert len(facts(spark, at)) == 4 and ("d.jpeg", "d9298a10d1b0735837dc4bd85dac641b0f3cef27a47e5d53a54f2f3f5b2fcffa", 5) in facts(spark, at)


def test_vectors_of_a_folder_stream(spark, tmp_path):
    """Images in, vectors of them in the index, also if a batch comes twice; the embedding here counts bytes, as no model is at hand."""
    source, at = tmp_path / "images", str(tmp_path / "index")
    source.mkdir()
    rng = random.Random(3)
    for i in range(12):
        (source / f"{i}.png").write_bytes(bytes(rng.choices(range(97, 105), k=200)))

    def embed(files):
        text = F.decode("content", "US-ASCII")
        counts = F.array(*[F.length(F.regexp_replace(text, f"[^{c}]", "")).cast("double") for c in "abcdefgh"])
        return files.select(F.regexp_extract("path", r"(\d+)\.png", 1).cast("long").alias("vec_id"), counts.alias("embedding"), "path")

    still = spark.read.format("binaryFile").load(str(source)).select("path", "content", F.col("modificationTime").alias("modified"))
    ivf.build(embed(still.limit(0)).unionByName(embed(still)).filter("vec_id < 4"), at, lists=2)
    put = folder.vectors_into(at, lambda files: embed(files).filter("vec_id >= 4"))
    folder.follow(folder.file_stream(spark, str(source), files_a_batch=5), str(tmp_path / "facts"), str(tmp_path / "state"), put)
    assert sorted(r["vec_id"] for r in ivf.lists(spark, at).collect()) == list(range(12))
    put(still.filter("path like '%/1_.png'"), 0)
    before = sorted(r["vec_id"] for r in ivf.lists(spark, at).collect())
    put(still.filter("path like '%/1_.png'"), 0)
    assert sorted(r["vec_id"] for r in ivf.lists(spark, at).collect()) == before


def test_log_keeps_its_days(spark, tmp_path):
    at = str(tmp_path / "log")
    for day, n in (("2024-01-01", 0), ("2024-01-05", 3), ("2024-01-06", 0), (None, 1)):
        index.append_log(spark.createDataFrame([(1, n, n == 0)], "query_id long, results long, empty boolean").withColumn("ts", F.lit(day).cast("timestamp")), at)
    assert index.prune_log(spark, at, 2, "2024-01-07") == ["2024-01-01", "2024-01-05"]
    assert sorted(map(str, index.searches_by_day(spark, at).collect())) == ["Row(day=None, searches=1, empty=0)", "Row(day=datetime.date(2024, 1, 6), searches=1, empty=1)"]
    assert index.recent(spark, at, 5).columns == ["query_id", "results", "empty", "ts"] and index.prune_log(spark, at, 2, "2024-01-07") == []


# sessions


def stream_of(spark, tmp_path, parts):
    source = str(tmp_path / "events")
    for i, part in enumerate(parts):
        rows = spark.createDataFrame(part, "event_id long, user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        rows.coalesce(1).write.parquet(f"{source}/{i}")
    return spark.readStream.schema("event_id long, user_id long, ts timestamp_ntz, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)


#: Out of order over batches; the event of 10:30 joins two sessions of user 1; what follows closes them; user 2 stays open.
PARTS = [
    [(1, 1, "2024-01-01 10:00:00", 1.0), (2, 1, "2024-01-01 11:10:00", 2.0), (3, None, "2024-01-01 10:00:00", 9.0)],
    [(4, 1, "2024-01-01 10:30:00", 4.0), (5, 1, "2024-01-01 14:00:00", None)],
    [(6, 2, "2024-01-02 00:00:00", 8.0)],
    [(7, 2, "2024-01-02 00:10:00", 8.0)],
    [(9, 2, "2024-01-02 00:20:00", 8.0), (8, 1, "2024-01-01 14:30:00", 100.0)],
]


def test_timers_close_sessions(spark, tmp_path):
    found = sessions.run_to_table(sessions.timer_sessions(stream_of(spark, tmp_path, PARTS), 45 * 60), str(tmp_path / "out"), str(tmp_path / "state"), sessions.STATE_STORE)
    us = lambda h, m: ((1704067200 + h * 3600 + m * 60) * 1_000_000)
    assert sorted(map(tuple, found.collect())) == [(1, us(10, 0), us(11, 10), 3, 7.0, 4.0), (1, us(14, 0), us(14, 0), 1, 0.0, 0.0)]


def test_a_user_has_one_timer_and_one_pass_over_the_sessions_it_ended():
    """However many sessions the watermark ends, state is read and written once for them."""

    class Handle:
        def __init__(self):
            self.timers, self.rows, self.calls = [], [], 0

        def getListState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return iter(list(self.rows))

        def put(self, rows):
            self.calls, self.rows = self.calls + 1, rows

        def clear(self):
            self.put([])

        def registerTimer(self, t):
            self.timers.append(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    class Times:
        getCurrentWatermarkInMs = lambda self: 1000 * 50
        getExpiryTimeInMs = lambda self: 10

    handle, state = Handle(), sessions.SessionState(10_000)
    state.init(handle)
    assert not list(state.handleInputRows((1,), iter({"us": i * 1_000_000, "value": 1.0} for i in reversed(range(100))), Times()))
    assert handle.timers == [10] and len(handle.rows) == 100
    calls = handle.calls
    handle.timers.clear()  # the store has dropped the timer that expires
    handle.deleteTimer = lambda t: None
    ended = list(state.handleExpiredTimer((1,), Times(), Times()))
    assert [r["start_us"] for r in ended] == [i * 1_000_000 for i in range(50)]
    assert handle.timers == [50_010] and len(handle.rows) == 50 and handle.calls == calls + 2


def test_session_windows_on_a_stream_merge_and_close(spark, tmp_path):
    stream = stream_of(spark, tmp_path, PARTS)
    found = sessions.run_to_table(sessions.session_windows(stream, "45 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r["user_id"], str(r["start"])[11:16], str(r["end"])[11:16], r["n"], r["total"]) for r in found.collect() if r["user_id"])
    assert got == [(1, "10:00", "11:55", 3, 7.0), (1, "14:00", "14:45", 1, None)]


def test_a_filter_on_session_ends_keeps_sessions_whole(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    all_ = sessions.session_windows(events)
    end = all_.agg(F.max("end")).first()[0]
    want = sorted(r["n"] for r in all_.collect() if r["end"] < end)
    assert sorted(r["n"] for r in all_.filter(F.col("end") < F.lit(end)).collect()) == want


def test_merging_of_sessions():
    s = [(0, 0, 1, 1.0, 3.0), (5, 5, 1, 1.0, 1.0), (15, 15, 1, 1.0, 2.0), (14, 14, 1, 1.0, 0.0)]
    assert sessions.merged(s, 10) == [(0, 15, 4, 4.0, 3.0)] and sessions.merged(s, 9) == [(0, 5, 2, 2.0, 3.0), (14, 15, 2, 2.0, 2.0)]
    rng = random.Random(1)
    points = [(t, t, 1, 0.5, float(t % 7)) for t in rng.sample(range(1000), 60)]
    assert sessions.merged(sessions.merged(points[:30], 20) + points[30:], 20) == sessions.merged(points, 20)


# counts that merge


def test_sketches_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", None, None), ("a", 1, 3.0), ("b", None, 2.0), ("b", 2, float("1e300"))], "g string, id long, v double")
    got = rollups.merged(rollups.sketches(rows, ["g"], "id", "v"), []).select("n", rollups.distinct().alias("d"), F.theta_sketch_estimate("theta").alias("t"), rollups.quantile(1.0).alias("q")).first()
    assert (got["n"], got["d"], got["t"], got["q"]) == (5, 2, 2, 1e300)
    assert rollups.merged(rollups.sketches(rows.limit(0), ["g"], "id", "v"), ["g"]).count() == 0


def test_bitmaps_of_large_and_negative_ids(spark):
    ids = [-5, -1, 0, 1, 32768, 32769, 10**12, 1, None]
    stored = rollups.bitmaps(spark.createDataFrame([(i % 2, x) for i, x in enumerate(ids)], "g int, id long"), ["g"], "id")
    assert rollups.distinct_ids(stored, []).first()["n_ids"] == 7
    assert rollups.distinct_ids(stored.limit(0), []).first()["n_ids"] == 0


# intervals


@pytest.mark.parametrize(("width", "slices"), [(None, 1), (7, 1), (1, 3), (1000, 4)])
def test_overlaps_equal_all_pairs(spark, width, slices):
    rng = random.Random(8)
    make = lambda n: [(i, s, s + rng.choice([0, 1, 5, 40, 300])) for i in range(n) for s in [rng.randint(-500, 500)]]
    a, b = make(80), make(70) + [(70, None, 5), (71, 9, 3), (72, 0, 10), (72, 0, 10)]
    want = sorted((i, j) for i, s, e in a for j, t, u in b if t is not None and s < e and t < u and s < u and t < e)
    got = intervals.overlaps(spark.createDataFrame(a, "i int, start long, end long"), spark.createDataFrame(b, "j int, start long, end long"), width, slices)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert intervals.overlaps(spark.createDataFrame(a, "i int, start long, end long").limit(0), spark.createDataFrame(b, "j int, start long, end long")).count() == 0


@pytest.mark.parametrize("scale", [1, 37, 10**13])
def test_overlap_totals_equal_all_pairs(spark, scale):
    rng = random.Random(9)
    make = lambda n: [(i, s * scale, (s + rng.choice([0, 1, 5, 40, 300])) * scale) for i in range(n) for s in [rng.randint(-500, 500)]]
    a, b = make(80) + [(80, 1, None), (81, 9, 3), (5, 0, 7 * scale), (5, 0, 7 * scale)], make(70) + [(70, None, 5), (71, 9, 3), (72, 0, 10), (72, 0, 10)]
    want = []
    for i, s, e in a:
        parts = [min(e, u) - max(s, t) for _, t, u in b if e is not None and t is not None and s < e and t < u and s < u and t < e]
        want += [(i, s, e, len(parts), sum(parts))] if parts else []
    left, right = spark.createDataFrame(a, "i int, start long, end long"), spark.createDataFrame(b, "j int, start long, end long")
    got = intervals.overlap_totals(left, right)
    assert got.columns == ["i", "left_start", "left_end", "n", "shared"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert intervals.overlap_totals(left.limit(0), right).count() == intervals.overlap_totals(left, right.limit(0)).count() == 0


def test_overlap_totals_make_no_pairs(spark):
    """Ten billion pairs, of which each row of the left side needs two numbers."""
    rows = spark.range(100_000).select("id", (F.col("id") % 500).alias("start"), (F.col("id") % 500 + 1000).alias("end"))
    got = intervals.overlap_totals(rows, rows.withColumnRenamed("id", "other")).agg(F.count("*"), F.min("n"), F.max("n"), F.max("shared"), F.min("shared")).first()
    shared = [200 * sum(1000 - abs(s - t) for t in range(500)) for s in range(500)]
    assert tuple(got) == (100_000, 100_000, 100_000, max(shared), min(shared))


# sources


def test_buckets_follow_the_rows(spark):
    a, b = spark.range(2501), spark.range(90)
    assert (bucketed.buckets_for(a, b, rows=100), bucketed.buckets_for(b, rows=100), bucketed.buckets_for(b.limit(0))) == (26, 1, 1)


def test_bucketed_join_of_many_rows_has_more_buckets(spark, monkeypatch):
    monkeypatch.setattr(bucketed, "buckets_for", lambda *tables, rows=100, count=bucketed.buckets_for: count(*tables, rows=rows))
    used, save = [], bucketed.save
    monkeypatch.setattr(bucketed, "save", lambda rows, name, keys, n, path=None: (used.append(n), save(rows, name, keys, n, path))[1])
    got = sorted(map(tuple, extended.QUERIES["s20_bucketed_join"](spark, "/root/testdata/sf0.001").collect()))
    t = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("orders", "lineitem")}
    want = t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*"), F.round(F.sum("l_quantity"), 2))
    assert got == sorted(map(tuple, want.collect())) and used == [-(-t["lineitem"].count() // 100)] * 2


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumnRenamed("o_orderkey", "k")
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumnRenamed("l_orderkey", "k")
    a, b = bucketed.save(o, "test_orders", ["k"], 4, str(tmp_path / "o")), bucketed.save(li, "test_lines", ["k"], 4, str(tmp_path / "l"))
    try:
        both = a.hint("merge").join(b, "k")
        assert "Exchange" not in plan(both) and "SortMergeJoin" in plan(both)
        assert "Exchange" not in plan(b.groupBy("k").count()) and both.count() == o.join(li, "k").count()
        assert {"test_orders", "test_lines"} <= set(bucketed.tables(spark))
    finally:
        spark.sql("DROP TABLE test_orders"), spark.sql("DROP TABLE test_lines")


def test_sqlite_ranges_and_pushed_filters(spark, tmp_path):
    at = tmp_path / "meta.db"
    with sqlite3.connect(at) as c:
        c.execute('CREATE TABLE "me""ta" (id INTEGER, name TEXT, size REAL, body BLOB)')
        c.executemany('INSERT INTO "me""ta" VALUES (?, ?, ?, ?)', [(i, f"n{i % 5}" if i % 7 else None, i / 4, bytes([i])) for i in range(100)] + [(None, "none", None, None), (1000, "far", 2.0, b"")])
    c.close()
    df = sqlite.read(spark, str(at), 'me"ta', "id", 20)
    assert df.rdd.getNumPartitions() > 3 and df.count() == 102 and [t for _, t in df.dtypes] == ["bigint", "string", "double", "binary"]
    rows = df.collect()
    for where, keep in (([("name", "=", "n3")], lambda r: r[1] == "n3"), ([("id", "is null", None)], lambda r: r[0] is None), ([("id", "in", [3, 4, 1000]), ("size", ">=", 1.0)], lambda r: r[0] in (4, 1000)), ([("name", ">", "n2"), ("id", "is not null", None)], lambda r: r[0] is not None and (r[1] or "") > "n2")):
        found = sqlite.read(spark, str(at), 'me"ta', "id", 20, where=where)
        assert sorted(map(str, found.collect())) == sorted(str(r) for r in rows if keep(r)), where
        reader = sqlite.SqliteReader({"path": str(at), "table": 'me"ta', "where": sqlite.encoded(where)}, df.schema)
        assert sum(1 for x in reader.partitions() for _ in reader.read(x)) == sum(map(keep, rows))
    # a filter of one use of a table stays out of its others
    assert df.filter("name = 'n3'").count() < df.count() == 102
    assert df.select("name").filter("id = 5").collect() == [("n0",)]
    for bad in ([("name", "LIKE", "n%")], [("none", "=", 1)]):
        with pytest.raises(ValueError):
            sqlite.read(spark, str(at), 'me"ta', where=bad)
    with pytest.raises(Exception, match="no SQLite file"):
        sqlite.read(spark, str(tmp_path / "none.db"), "t").count()


def test_sqlite_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1.5), (2, None, None), (2, "ü", -0.5)], "id long, name string, x double").repartition(3)
    sqlite.write(rows, f"file://{tmp_path}/out", "t")
    assert sorted(map(str, sqlite.read(spark, f"file://{tmp_path}/out", "t", "id").collect())) == sorted(map(str, rows.collect()))


# hash trees and table functions


def test_hash_tree_names_changed_blocks(spark):
    import hashlib

    h = lambda b: hashlib.sha256(b).hexdigest()

    def root(content, size=4):
        level = [h(content[i : i + size]) for i in range(0, max(1, len(content)), size)]
        while len(level) > 1:
            level = [h((level[i] + level[i + 1]).encode()) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    contents = [b"", b"abc", b"abcd", b"abcde", b"0123456789ab", bytes(range(70)), "üß😀".encode()]
    frame = spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate(contents)] + [("none", None)], "path string, content binary")
    got = {r["path"]: r["root"] for r in hashtree.tree(frame, 4).collect()}
    assert got == {str(i): root(c) for i, c in enumerate(contents)} | {"none": None}
    edit = frame.withColumn("content", F.when(F.col("path") == "4", F.lit(b"0123X56789abcd")).when(F.col("path") == "1", F.lit(b"")).otherwise(F.col("content")))
    assert sorted(map(tuple, hashtree.changed_blocks(hashtree.tree(edit, 4), hashtree.tree(frame, 4)).collect())) == [("1", 0), ("4", 1), ("4", 3)]


def test_rising_runs_of_odd_rows(spark):
    tablefunctions.register(spark)
    rows = [(1, 1, 1.0), (1, 2, 2.0), (1, 3, None), (1, 4, 3.0), (1, 5, 4.0), (1, 6, 5.0), (2, 7, None), (3, 8, 1.0), (3, 9, 1.0), (None, 10, 1.0)]
    spark.createDataFrame(rows, "user_id long, event_id long, value double").createOrReplaceTempView("runs_of_test")
    got = spark.sql("SELECT * FROM rising_run(TABLE(runs_of_test) PARTITION BY user_id ORDER BY event_id)").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 4, 3, 2.0), (3, 8, 1, 0.0), (None, 10, 1, 0.0)], key=str)


def test_plain_path_and_pattern_of_a_stream(spark):
    assert extended.stream(spark, "/root/testdata/sf0.001", "events").isStreaming
