"""Queries of the library's own operators, each with the SQL that DuckDB runs on the same tables.

Keys start with the id of the operator; `ext_` marks general relational operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import search
from tessera.plans import extended, relational
from tessera.sources.tables import TABLES, activity_log, register, search_results, table

Query = Callable[[SparkSession, str], DataFrame]

#: Text that both engines read alike.
SHARED = {
    "ext_group_agg": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "ext_inner_join": "SELECT n.n_name, CAST(count(*) AS BIGINT) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "ext_left_join": "SELECT c.c_custkey, CAST(count(o.o_orderkey) AS BIGINT) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 GROUP BY c.c_custkey",
    "ext_full_join": "SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) c FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) o ON c.c_custkey = o.o_custkey",
    "ext_semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "ext_anti_join": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "ext_theta_join": "SELECT n.n_nationkey, CAST(count(*) AS BIGINT) AS n FROM nation n JOIN region r ON n.n_nationkey > r.r_regionkey GROUP BY n.n_nationkey",
    "ext_count_distinct": "SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus",
    "ext_rollup": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "ext_cube": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "ext_grouping_sets": "SELECT c_mktsegment, c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "ext_rank": "SELECT s_suppkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS d FROM supplier",
    "ext_lag": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "ext_running_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total FROM orders",
    "ext_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "ext_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "ext_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000",
    "ext_having_topn": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 3 ORDER BY total DESC, o_custkey LIMIT 20",
    "d3_not_indexed": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "a5_count_by_search": "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type",
    "c13_null_or_empty": "SELECT doc_id, coalesce(nullif(lang, ''), 'UNKNOWN') AS lang FROM documents",
}


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.top_k(e, e.filter("vec_id = 0"), 10).withColumn("score", F.round("score", 6))


def batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.batch_top_k(e, e.filter("vec_id % 20 = 0"), 5).withColumn("score", F.round("score", 6))


def all_topk(spark: SparkSession, d: str) -> DataFrame:
    """The batch search with every row as a query."""
    e = table(spark, d, "embeddings")
    return search.batch_top_k(e, e, 5).withColumn("score", F.round("score", 6))


def previous(spark: SparkSession, d: str) -> DataFrame:
    """The latest earlier order of the customer, for each order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"))


def _is_last(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy("id")  # six rows
    return activity_log(spark).select("id", F.lead("id").over(w).isNull().alias("is_last"), (F.col("results") == 0).alias("empty"))


_PHONES = ["", "123456789", "1234567890", "+12345678901234", "1234567890123456", "12 34-567890"]
_PASSWORDS = ["short", "alllowercase", "lowerUPPER", "lowerUP1", "lowerUP1!", "1234567"]

QUERIES: dict[str, Query] = {
    "l3_topk_cosine": topk,
    "l3_batch_topk": batch,
    "l3_all_topk": all_topk,
    "s1_generated": lambda s, d: search_results(s).withColumn("file", scalar.basename(F.col("path"))),
    "f3_similarity_band": lambda s, d: search_results(s).groupBy(scalar.similarity_band(F.col("similarity")).alias("band")).agg(F.count("*").alias("n")),
    "a2_log_summary": lambda s, d: activity_log(s).agg(F.count("*").alias("n"), F.sum("results").alias("total"), F.count_if(F.col("results") == 0).alias("empty")),
    "w1_is_last": _is_last,
    "f5_valid_phone": lambda s, d: s.createDataFrame([(x,) for x in _PHONES], "phone string").withColumn("ok", scalar.valid_phone(F.col("phone"))),
    "c19_password_strength": lambda s, d: s.createDataFrame([(x,) for x in _PASSWORDS], "p string").withColumn("strength", scalar.password_strength(F.col("p"))),
    "c12_fingerprint": lambda s, d: _documents(s, d).select("doc_id", F.sha2("text", 256).alias("fingerprint")),
    "d2_duplicate_groups": lambda s, d: _documents(s, d).groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1"),
    "l5_recent": lambda s, d: table(s, d, "events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id"),
    "p5_json_field": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
    "ext_previous_order": previous,
    "ext_daily_window": lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 day").start.cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n")),
}

_TEXTS = [(1, "  padded \t\n"), (2, 'quo"ted'), (3, ""), (4, "C:\\a\\b.jpg"), (5, "hello")]


def _texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TEXTS, "id long, c string")


def _l2(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to vector 1 by Euclidean distance."""
    e = table(spark, d, "embeddings")
    q = F.broadcast(e.filter("vec_id = 1").select(F.col("embedding").alias("q")))
    gap = F.zip_with("embedding", "q", lambda x, y: x.cast("double") - y.cast("double"))
    near = e.filter("vec_id <> 1").join(q).select("vec_id", scalar.norm(gap).alias("distance")).orderBy("distance", "vec_id").limit(10)
    return near.withColumn("distance", F.round("distance", 6))


QUERIES |= {
    "s12_health": lambda s, d: s.sql("SELECT 'ok' AS status"),
    "p2_envelope": lambda s, d: _texts(s).select("id", F.to_json(scalar.envelope(F.col("c") != "", F.concat(F.lit("row "), "id"), F.struct("id"))).alias("envelope")),
    "p3_rename": lambda s, d: table(s, d, "customer").withColumnsRenamed({"c_custkey": "custKey", "c_name": "name"}).select("custKey", "name"),
    "p9_cyclic": lambda s, d: s.range(16).select("id", F.element_at(F.array(*map(F.lit, "abcdef")), (F.col("id") % 6 + 1).cast("int")).alias("colour")),
    "a3_checks_met": lambda s, d: s.createDataFrame([(x,) for x in _PASSWORDS], "p string").select("p", F.size(F.filter(F.array(*[F.col("p").rlike(r) for r in ("[A-Z]", "[a-z]", "[0-9]", "[^A-Za-z0-9]")]), lambda x: x)).cast("long").alias("met")),
    "c6_basename": lambda s, d: _texts(s).select("id", scalar.basename(F.col("c")).alias("name")),
    "c7_strip": lambda s, d: _texts(s).select("id", F.btrim("c", F.lit(" \t\r\n")).alias("c")),
    "c10_unquote": lambda s, d: _texts(s).select("id", F.replace("c", F.lit('"'), F.lit("")).alias("c")),
    "c11_join": lambda s, d: table(s, d, "supplier").select("s_suppkey", F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string")).alias("joined")),
    "d7_width": lambda s, d: table(s, d, "embeddings").groupBy(F.size("embedding").cast("long").alias("width")).agg(F.count("*").alias("n")),
    "d9_l2_topk": _l2,
    "ext_session_window": lambda s, d: table(s, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"),
}

SQL = {
    "s12_health": "SELECT 'ok' AS status",
    "p2_envelope": """SELECT id, '{"success":' || (c <> '') || ',"message":"row ' || id || '","data":{"id":' || id || '}}' AS envelope FROM TEXTS""",
    "p3_rename": 'SELECT c_custkey AS "custKey", c_name AS name FROM customer',
    "p9_cyclic": "SELECT i AS id, substr('abcdef', i % 6 + 1, 1) AS colour FROM range(16) t(i)",
    "a3_checks_met": "SELECT p, CAST(regexp_matches(p, '[A-Z]')::INT + regexp_matches(p, '[a-z]')::INT + regexp_matches(p, '[0-9]')::INT + regexp_matches(p, '[^A-Za-z0-9]')::INT AS BIGINT) AS met FROM (VALUES " + ", ".join(f"('{x}')" for x in _PASSWORDS) + ") v(p)",
    "c6_basename": r"SELECT id, string_split(c, '\')[-1] AS name FROM TEXTS",
    "c7_strip": "SELECT id, trim(c, ' ' || chr(9) || chr(13) || chr(10)) AS c FROM TEXTS",
    "c10_unquote": "SELECT id, replace(c, '\"', '') AS c FROM TEXTS",
    "c11_join": "SELECT s_suppkey, concat_ws('|', s_name, s_nationkey::VARCHAR) AS joined FROM supplier",
    "d7_width": "SELECT len(embedding) AS width, count(*) AS n FROM embeddings GROUP BY 1",
    "d9_l2_topk": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1) SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, list_distance(embedding::DOUBLE[], q) AS d FROM embeddings, q WHERE vec_id <> 1 ORDER BY d, vec_id LIMIT 10)",
    "ext_session_window": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "l3_topk_cosine": "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE vec_id <> query_id ORDER BY score DESC, vec_id LIMIT 10), p AS (SELECT *, CAST(round(100 * greatest(0.0, score)) AS INT) AS percent FROM s) SELECT query_id, vec_id, round(score, 6) AS score, percent, CASE WHEN percent >= 88 THEN 'high' WHEN percent >= 72 THEN 'mid' ELSE 'low' END AS band FROM p",
    "l3_batch_topk": "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE vec_id <> query_id) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5",
    "l3_all_topk": "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings), s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE vec_id <> query_id) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5",
    "s1_generated": r"SELECT i + 1 AS id, printf('asset_%03d.jpg', i + 1) AS name, 'D:\assets\asset_' || (i + 1) || '.jpg' AS path, CAST(greatest(54, 97 - 3 * i) AS INT) AS similarity, 'asset_' || (i + 1) || '.jpg' AS file FROM range(16) t(i)",
    "f3_similarity_band": "SELECT CASE WHEN s >= 88 THEN 'high' WHEN s >= 72 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM (SELECT greatest(54, 97 - 3 * i) AS s FROM range(16) t(i)) GROUP BY 1",
    "a2_log_summary": "SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS total, count(*) FILTER (v = 0) AS empty FROM (VALUES (24), (12), (0), (47), (8), (31)) t(v)",
    "w1_is_last": "SELECT CAST(i AS BIGINT) AS id, i = 6 AS is_last, v = 0 AS empty FROM (VALUES (1, 24), (2, 12), (3, 0), (4, 47), (5, 8), (6, 31)) t(i, v)",
    "f5_valid_phone": "SELECT phone, regexp_full_match(phone, '(\\+?[\\d\\s\\-]{10,15})?') AS ok FROM (VALUES " + ", ".join(f"('{x}')" for x in _PHONES) + ") t(phone)",
    "c19_password_strength": "WITH t AS (SELECT p, regexp_matches(p, '[A-Z]')::INT + regexp_matches(p, '[a-z]')::INT + regexp_matches(p, '[0-9]')::INT + regexp_matches(p, '[^A-Za-z0-9]')::INT AS met FROM (VALUES " + ", ".join(f"('{x}')" for x in _PASSWORDS) + ") v(p)) SELECT p, CASE WHEN length(p) < 8 THEN 'weak' WHEN met = 4 THEN 'strong' WHEN met >= 2 THEN 'medium' ELSE 'weak' END AS strength FROM t",
    "c12_fingerprint": "SELECT doc_id, sha256(text) AS fingerprint FROM documents",
    "d2_duplicate_groups": "SELECT sha256(text) AS fingerprint, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "l5_recent": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 50",
    "p5_json_field": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "ext_previous_order": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders",
    "ext_daily_window": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
} | SHARED
_LITERALS = ", ".join("({}, '{}')".format(i, c.replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '")) for i, c in _TEXTS)
SQL = {k: v.replace("TEXTS", f"(SELECT CAST(i AS BIGINT) AS id, c FROM (VALUES {_LITERALS}) v(i, c)) t") for k, v in SQL.items()}


def _shared(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, [t for t in TABLES if t in text])
        return spark.sql(text)

    return run


QUERIES |= {k: _shared(v) for k, v in (SHARED | relational.SHARED | extended.SHARED).items()} | relational.QUERIES | extended.QUERIES
SQL |= relational.SHARED | relational.SQL | extended.SHARED | extended.SQL
