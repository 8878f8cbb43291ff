import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import index, search, validation
from tessera.sources import tables
from tessera.streaming import incremental


def test_images_any_letter_case(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.jpg", "b.PNG", "deep/c.psb", "d.txt"):
        (tmp_path / name).write_bytes(b"x" * 10)
    got = tables.images(spark, str(tmp_path)).select("path", scalar.head_fingerprint(F.col("content"), 4).alias("f")).collect()
    assert len(got) == 3 and len({r["f"] for r in got}) == 1


def test_config_defaults(spark, tmp_path):
    default = {"apiBaseUrl": "d", "isMaintenance": False}
    schema = "apiBaseUrl string, isMaintenance boolean"
    assert tables.config(spark, str(tmp_path / "none.json"), schema, default) == default
    (tmp_path / "c.json").write_text('{"apiBaseUrl": "x",\n "isMaintenance": true}')
    assert tables.config(spark, str(tmp_path / "c.json"), schema, default) == {"apiBaseUrl": "x", "isMaintenance": True}


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    docs.filter("doc_id < 12").write.parquet(source)
    incremental.index_new_files(spark, source, sink, state, "doc_id long, text string")
    assert spark.read.parquet(sink).count() == 12
    docs.filter("doc_id >= 12").write.mode("append").parquet(source)
    incremental.index_new_files(spark, source, sink, state, "doc_id long, text string")
    got = {(r[0], r[1]) for r in spark.read.parquet(sink).collect()}
    assert got == {(r[0], r[1]) for r in docs.select("doc_id", F.sha2("text", 256)).collect()}
    files = docs.withColumn("fingerprint", F.sha2("text", 256))
    assert search.not_indexed(files, spark.read.parquet(sink)).count() == 0


def test_search_properties(spark):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(30)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = search.top_k(e, e.filter("vec_id = 7"), 50, exclude_self=False).collect()
    assert len(got) == 30 and abs(got[0]["score"] - 1) < 1e-12
    assert all(a["score"] >= b["score"] for a, b in zip(got, got[1:], strict=False))


def test_windows_on_table(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert incremental.event_windows(events).agg(F.sum("n")).first()[0] == events.count()


def _stream(spark, tmp_path, build, rows):
    """What a stream of files of rows, one a batch, appends."""
    source, sink, state = (str(tmp_path / x) for x in ("events", "found", "kept"))
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{source}/{i}")
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    build(events).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).collect()


def test_watermark_drops_late_rows(spark, tmp_path):
    rows = [[(1, "2024-01-01 10:00:00", "a", 1.0), (2, "2024-01-01 23:00:00", "a", 2.0)], [(3, "2024-01-03 12:00:00", "a", 4.0)], [(6, "2024-01-03 13:00:00", "a", 0.0)], [(4, "2024-01-01 11:00:00", "a", 8.0), (5, "2024-01-05 00:00:00", "a", 16.0)]]
    got = {str(r["start"].date()): (r["n"], r["total"]) for r in _stream(spark, tmp_path, incremental.event_windows, rows)}
    assert got == {"2024-01-01": (2, 3.0), "2024-01-03": (2, 4.0)}


def test_stateful_duplicates(spark, tmp_path):
    rows = [[(1, "2024-01-01 10:00:00", "a", 1.0), (1, "2024-01-01 10:10:00", "a", 1.0)], [(1, "2024-01-01 10:20:00", "a", 1.0), (2, "2024-01-01 10:20:00", "a", 1.0)]]
    assert sorted(r["event_id"] for r in _stream(spark, tmp_path, incremental.deduplicated, rows)) == [1, 2]


def test_formats(spark, tmp_path):
    rows = spark.range(5).select("id", F.concat(F.lit("n"), F.col("id")).alias("name"))
    for kind in ("csv", "json", "orc", "parquet"):
        rows.write.format(kind).option("header", "true").save(str(tmp_path / kind))
        got = tables.read(spark, str(tmp_path / kind), kind, "id long, name string" if kind in ("csv", "json") else None)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        tables.read(spark, str(tmp_path / "csv"), "csv")


def test_config_that_is_not_json(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{not json")
    assert tables.config(spark, str(tmp_path / "bad.json"), "a string", {"a": "d"}) == {"a": "d"}


def test_stored_index_and_log(spark, tmp_path):
    rows = [(i, [float(i % 3), float(i % 5), 1.0], f"D:\\a\\{i % 2}", "x") for i in range(20)] + [(20, [1.0], "D:\\a\\0", "x"), (21, None, "D:\\b", "x"), (22, [1.0, 1.0, 1.0], "D:\\ab", "x")]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, folder string, note string")
    folder, log = str(tmp_path / "index"), str(tmp_path / "log")
    assert {r["vec_id"] for r in index.store(e, folder, 3).collect()} == {20, 21}
    stored = index.load(spark, folder)
    assert stored.count() == 21
    query = e.filter("vec_id = 7")
    found = index.find(stored, query, 5, "D:\\a\\1")
    assert {r["vec_id"] for r in found.collect()} <= {i for i in range(20) if i % 2} and found.count() == 5
    assert 22 not in {r["vec_id"] for r in index.find(stored, query, 50, "D:\\a").collect()} and index.find(stored, query, 50).count() == 20
    for k, at in ((101, "2024-01-01"), (0, "2024-01-02")):
        index.append_log(index.log_entries(found, k).withColumn("ts", F.lit(at).cast("timestamp")), log)
    assert [(r["query_id"], r["results"], r["empty"]) for r in index.recent(spark, log, 5).collect()] == [(7, 5, False), (7, 0, True)]


def test_quarantine(spark):
    schema = "first_name string, last_name string, email string, phone_number string, password string, confirm_password string"
    good = ("Ada", "Byron", "a@b.org", None, "longenough", "longenough")
    bad = [("A", *good[1:]), (None, *good[1:]), (*good[:2], "a@b", *good[3:]), (*good[:4], "short", "short"), (*good[:5], "other"), (*good[:3], "1", *good[4:]), (None,) * 6]
    ok, held = validation.split(spark.createDataFrame([good, *bad], schema), validation.registration_rules())
    assert [tuple(r) for r in ok.collect()] == [good]
    assert sorted(",".join(r["errors"]) for r in held.collect()) == sorted(["first_name.minlength", "first_name.required", "email.email", "password.minlength", "confirm_password.passwordMismatch", "phone_number.phoneInvalid", "first_name.required,last_name.required,email.required,password.required,confirm_password.required"])


def test_one_query_only(spark):
    e = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="batch_top_k"):
        search.top_k(e, e, 1).collect()
