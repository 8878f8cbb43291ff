"""Rows judged one by one whatever their ids, very long texts, order of rows, and names of headers."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, packing, pii, revisits, sampling
from tessera.llm.tokens import vocabulary_path

BYTE = vocabulary_path("byte_bpe_50k.json")
A, B = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int")


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([(1, A), (5, A), (5, B)], [(1, A), (5, B)]),
        ([(5, A), (5, A + " end"), (5, B)], [(5, B)]),  # and one of the first two, by the hash of its text
        ([(1, A), (1, A), (None, A), (None, A + " end")], [(1, A)]),
        ([(None, A), (None, A), (None, B)], [(None, A), (None, B)]),
        ([(1, ""), (1, ""), (2, None), (None, " ")], [(1, ""), (1, ""), (2, None), (None, " ")]),
    ],
)
def test_one_row_of_each_class_stays(spark, rows, kept):
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one_of_each(frame(spark, rows).repartition(2)).collect()), key=str)
    rest = list(got)
    for k in kept:
        rest.remove(k)
    assert len(got) == len(kept) + (1 if (5, A + " end") in rows else 0) and all(r in rows for r in rest)
    assert jaccard.keep_one_of_each(frame(spark, rows).limit(0)).count() == 0


def test_contaminated_rows_leave_whatever_their_ids(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(None, f"see {item} there"), (None, "nothing of it"), (1, item), (1, B), (2, None), (2, "")]
    items = spark.createDataFrame([(7, item), (None, "x y"), (8, None)], "item_id long, text string")
    left = decontaminate.without_contaminated(frame(spark, rows), items)
    assert left.columns == ["doc_id", "text", "h"]
    assert sorted(((r[0], r[1]) for r in left.collect()), key=str) == sorted([(None, "nothing of it"), (1, B), (2, None), (2, "")], key=str)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), items).collect()}
    assert found == {(None, 7), (1, 7)}
    assert decontaminate.without_contaminated(frame(spark, rows), items.limit(0)).count() == 6


def test_stages_judge_rows(spark, tmp_path):
    """Equal ids with different texts at every stage."""
    import corpus_pipeline as P

    item = " ".join(f"i{k}" for k in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, A), (5, A), (5, B), (5, f"so {item} on"), (None, item), (None, "call +1 234 567 8901 or a@b.org"), (1, A)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.decontamination_stage(spark, P.duplicates_stage(spark, docs, str(tmp_path)), str(tmp_path))
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted([(1, A), (5, B), (None, rows[5][1])], key=str)
    clean = P.pii_stage(spark, kept, str(tmp_path))
    assert clean.columns == docs.columns and clean.filter("doc_id is null").first()["text"] == "call <PHONE> or <EMAIL>"
    assert P.packing_stage(spark, clean, str(tmp_path)).count() == 3


@pytest.mark.parametrize("text", ["1.2.3." + "0" * 5000, "7" * 1_000_000, "1." * 300_000, "x" * 1_000_000 + " 1", "+1" + "(" * 1_000_000, "a@" + "b-" * 500_000, "1.2.3.4 " * 100_000, "1 " * 500_000, "+" * 500_000 + "1"])
def test_long_texts_take_time_in_proportion(text):
    began = time.time()
    found = pii.base_spans(text)
    assert time.time() - began < 3
    if text.startswith("1.2.3.0"):
        assert found == [(1, 0, len(text))]
    began = time.time()
    pii._graph(text[:200_000], pii.base_spans(text[:200_000]))
    assert time.time() - began < 15


def test_addresses_equal_the_plain_pattern():
    plain, rng = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("0125.. a") for _ in range(rng.randint(1, 24)))
        want = [(1, m.start(), m.end()) for m in plain.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [s for s in pii.base_spans(text) if s[0] == 1] == want, text


def test_packing_is_the_same_in_any_order_of_rows(spark):
    rng = random.Random(1)
    rows = [(i % 50 or None, " ".join(rng.choices("abcdefg", k=rng.randint(0, 300)))) for i in range(200)] + [(1, A)] * 20
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = sorted(map(str, packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), BYTE, group_chars=5000).collect()))
        assert want is None or got == want
        want = got


def test_header_names_and_weak_tags(spark):
    url = "http://a.org/p"
    rows = [
        (1, url, 1, "response", {"ETag": '"r"', "Content-Type": "text/html", "DATE": "1"}),
        (2, url, 2, "revisit", {"eTag": 'W/"r"', "Date": "2", "Server": "x"}),
        (3, url, 3, "revisit", {"ETAG": 'W/"q"'}),
        (4, url, 4, "revisit", {"Last-Modified": "then"}),
        (5, url, 5, "revisit", None),
    ]
    got = {r["record_id"]: r for r in revisits.resolve(spark.createDataFrame(rows, "record_id long, url string, time long, kind string, headers map<string,string>")).collect()}
    assert [got[i]["status"] for i in (2, 3, 4, 5)] == ["resolved", "changed", "changed", "changed"]
    assert got[2]["headers"] == {"etag": 'W/"r"', "content-type": "text/html", "date": "2"}
    twice = F.create_map(*map(F.lit, ("ETag", "1", "b", "2", "etag", "3")))
    assert spark.range(1).select(revisits.lowered(twice)).first()[0] == {"b": "2", "etag": "3"}
    assert spark.createDataFrame([(None,)], "h map<string,string>").select(revisits.lowered(F.col("h"))).first()[0] is None


def test_samples_are_bounded_in_texts_and_bytes(spark):
    docs = frame(spark, [(1, "a" * 10), (1, "a" * 10), (1, "b" * 10), (2, "c" * 100), (3, None), (4, "d"), (None, "e")])
    ids = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, 2.5)], "doc_id long, y double")
    got = sampling.texts_of(docs, ids, 10)
    assert sorted(got, key=str) == sorted([(1, "a" * 10, 0.5), (1, "b" * 10, 0.5), (2, "c" * 100, 1.5), (3, None, 2.5)], key=str)
    assert sorted(i for i, _, _ in sampling.texts_of(docs, ids, 10, max_bytes=25)) == [1, 1, 3]
    assert len(sampling.texts_of(docs, ids, 2)) == 2 and sampling.texts_of(docs.limit(0), ids, 2) == []
