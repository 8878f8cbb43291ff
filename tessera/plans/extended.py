"""Queries of the stored index, streams with state, mergeable counts, interval joins, further sources and table functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar, tablefunctions
from tessera.operators import hashtree, index, intervals, ivf, rollups
from tessera.plans.relational import MEAN, STD
from tessera.plans.session import shared_folder
from tessera.sources import bucketed, sqlite
from tessera.sources.tables import table
from tessera.streaming import folder, sessions

GAP_HOURS = 6


def stream(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files. The pattern stands for a single file too, which a plain path to a stream may not be."""
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def ivf_topk(s: SparkSession, d: str) -> DataFrame:
    """The batch search through an inverted-file index built of the table: a few lists at first, then those that can still hold a nearer row."""
    e, at = table(s, d, "embeddings"), shared_folder(s, "ivf")
    ivf.build(e, at)
    found = ivf.find(s, at, e.filter("vec_id % 20 = 0"), 5, probes=8, exact=True)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def stream_index(s: SparkSession, d: str) -> DataFrame:
    """Documents as files that come on a stream, into an index of batches."""
    docs = stream(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("modified"))
    at = shared_folder(s, "files")
    folder.follow(docs, f"{at}/index", f"{at}/checkpoint", head=1 << 30)
    return folder.latest(s.read.parquet(f"{at}/index")).select("path", "fingerprint", "size")


def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    at = shared_folder(s, "sessions")
    rows = sessions.run_to_table(sessions.session_windows(stream(s, d, "events"), f"{GAP_HOURS} hours"), f"{at}/out", f"{at}/checkpoint")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 2).alias("total"))


def timer_sessions(s: SparkSession, d: str) -> DataFrame:
    at = shared_folder(s, "timers")
    rows = sessions.run_to_table(sessions.timer_sessions(stream(s, d, "events"), GAP_HOURS * 3600), f"{at}/out", f"{at}/checkpoint", sessions.STATE_STORE)
    return rows.select("user_id", "start_us", "finish_us", "n", F.round("total", 2).alias("total"), "largest")


def merged_sketches(s: SparkSession, d: str) -> DataFrame:
    """Exact counts of event ids by type, and whether what daily sketches say after a merge is within their bounds."""
    e = table(s, d, "events").withColumn("day", F.to_date("ts"))
    at = shared_folder(s, "sketches")
    rollups.sketches(e, ["day", "event_type"], "event_id", "value").write.parquet(at)
    said = rollups.merged(s.read.parquet(at), ["event_type"])
    said = said.select("event_type", "n", rollups.distinct().alias("about"), F.theta_sketch_estimate("theta").alias("theta_about"), rollups.quantile(0.5).alias("median"))
    below, upto = F.count_if(F.col("value") < F.col("median")), F.count_if(F.col("value") <= F.col("median"))
    exact = e.join(F.broadcast(said), "event_type").groupBy("event_type", "n", "about", "theta_about").agg(F.count_distinct("event_id").alias("ids"), below.alias("below"), upto.alias("upto"))
    near = lambda about, bound: F.abs(F.col(about) - F.col("ids")) <= bound * F.col("ids")
    median = (F.col("below") <= (0.5 + rollups.KLL_BOUND) * F.col("n")) & (F.col("upto") >= (0.5 - rollups.KLL_BOUND) * F.col("n"))
    return exact.select("event_type", "n", "ids", near("about", rollups.HLL_BOUND).alias("hll_ok"), near("theta_about", rollups.THETA_BOUND).alias("theta_ok"), median.alias("median_ok"))


def shared_customers(s: SparkSession, d: str) -> DataFrame:
    """Customers with orders of a priority in both 1996 and 1997, exact, and whether the overlap of two years' sketches is within its bound."""
    o = table(s, d, "orders").withColumn("year", F.year("o_orderdate")).filter("year in (1996, 1997)")
    by = rollups.sketches(o, ["o_orderpriority", "year"], "o_custkey", "o_totalprice").groupBy("o_orderpriority").pivot("year", [1996, 1997]).agg(F.first("theta"))
    said = by.select("o_orderpriority", rollups.in_both(F.col("1996"), F.col("1997")).alias("about"))
    years = o.groupBy("o_orderpriority", "o_custkey").agg(F.count_distinct("year").alias("years"))
    exact = years.groupBy("o_orderpriority").agg(F.count_if(F.col("years") == 2).alias("customers"), F.count("*").alias("either"))
    ok = F.abs(F.col("about") - F.col("customers")) <= rollups.THETA_BOUND * F.col("either")
    return exact.join(said, "o_orderpriority").select("o_orderpriority", "customers", ok.alias("theta_ok"))


def bitmap_rollups(s: SparkSession, d: str) -> DataFrame:
    """Distinct orders by flag, by month and in all, from one stored table of bitmaps."""
    rows = table(s, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    at = shared_folder(s, "bitmaps")
    rollups.bitmaps(rows, ["l_returnflag", "month"], "l_orderkey").write.parquet(at)
    stored, all_ = s.read.parquet(at), F.lit("all")
    out = rollups.distinct_ids(stored, ["l_returnflag"]).select(F.lit("flag").alias("level"), F.col("l_returnflag").alias("key"), "n_ids")
    out = out.unionByName(rollups.distinct_ids(stored, ["month"]).select(F.lit("month").alias("level"), F.col("month").alias("key"), "n_ids"))
    return out.unionByName(rollups.distinct_ids(stored, []).select(all_.alias("level"), all_.alias("key"), "n_ids"))


def promotion_overlaps(s: SparkSession, d: str) -> DataFrame:
    """For each session of events that meets promotions: how many, and for how many seconds. Promotions are made of large orders, laid over January 2024."""
    found = sessions.session_windows(table(s, d, "events"), f"{GAP_HOURS} hours")
    last = F.unix_seconds(F.col("end") - F.expr(f"INTERVAL {GAP_HOURS} HOURS"))
    a = found.select("user_id", F.unix_seconds("start").alias("start"), (last + 1).alias("end"))
    begin = F.lit(1_704_067_200) + F.col("o_orderkey") % 720 * 3600
    b = table(s, d, "orders").filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("promotion"), begin.alias("start"), (begin + (F.col("o_custkey") % 48 + 1) * 1800).alias("end"))
    return intervals.overlap_totals(a, b).groupBy("user_id", F.col("left_start").alias("start")).agg(F.sum("n").alias("promotions"), F.sum("shared").alias("seconds"))


def bucketed_join(s: SparkSession, d: str) -> DataFrame:
    at = shared_folder(s, "buckets")
    name = at.rsplit("-", 1)[-1]
    o, li = table(s, d, "orders").withColumnRenamed("o_orderkey", "orderkey"), table(s, d, "lineitem").withColumnRenamed("l_orderkey", "orderkey")
    n = max(8, bucketed.buckets_for(o, li))
    o = bucketed.save(o, f"orders_{name}", ["orderkey"], n, f"{at}/orders")
    li = bucketed.save(li, f"lineitem_{name}", ["orderkey"], n, f"{at}/lineitem")
    return o.hint("merge").join(li, "orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def sqlite_parts(s: SparkSession, d: str) -> DataFrame:
    at = shared_folder(s, "sqlite")
    sqlite.write(table(s, d, "part"), at, "part")
    return sqlite.read(s, at, "part", "p_partkey", 500, where=[("p_size", ">", 20)]).filter("p_partkey % 3 = 1").select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"), "p_retailprice")


def block_changes(s: SparkSession, d: str) -> DataFrame:
    """Which blocks of 512 bytes of documents differ from those of edited copies: a byte replaced in every fifth, a tail added to every seventh."""
    files = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), "doc_id")
    c = F.col("content")
    c = F.when((F.col("doc_id") % 5 == 0) & (F.octet_length(c) > 700), F.concat(F.substring(c, 1, 700), F.lit(b"*"), F.substring(c, 702, 1 << 30))).otherwise(c)
    c = F.when(F.col("doc_id") % 7 == 0, F.concat(c, F.lit(b"tail"))).otherwise(c)
    return hashtree.changed_blocks(hashtree.tree(files.withColumn("content", c), 512), hashtree.tree(files, 512))


def rising_runs(s: SparkSession, d: str) -> DataFrame:
    tablefunctions.register(s)
    table(s, d, "events").createOrReplaceTempView("events")
    rows = "SELECT user_id, event_id, value, ts FROM events"
    found = s.sql(f"SELECT * FROM rising_run(TABLE({rows}) PARTITION BY user_id ORDER BY (ts, event_id))")
    return found.withColumn("rise", F.round("rise", 4))


def normalised_all(s: SparkSession, d: str) -> DataFrame:
    """Every component of every vector less its channel's mean, over its deviation; channels take turns."""
    at = lambda values, i: F.get(F.array(*map(F.lit, values)), i % 3)
    out = F.transform("embedding", lambda x, i: F.round((x.cast("double") - at(MEAN, i)) / at(STD, i), 6))
    return table(s, d, "embeddings").select("vec_id", F.posexplode(out).alias("place", "value")).withColumn("place", F.col("place").cast("long"))


def rejected_widths(s: SparkSession, d: str) -> DataFrame:
    """Vectors of another width, which a stored index refuses, and how many it took: every ninth vector is cut short here."""
    e, at = table(s, d, "embeddings"), shared_folder(s, "index")
    e = e.withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))).withColumn("folder", F.col("label").cast("string"))
    refused = index.store(e, at, 64)
    kept = index.load(s, at).groupBy("folder").agg(F.count("*").alias("stored"))
    return kept.join(refused.groupBy("folder").agg(F.count("*").alias("refused")), "folder", "full").select("folder", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("refused", F.lit(0)).alias("refused"))


def folder_ivf(s: SparkSession, d: str) -> DataFrame:
    """The nearest rows within one folder through the inverted-file index, with percent and band, after every seventh row was removed."""
    e, at = table(s, d, "embeddings").withColumn("folder", F.concat(F.lit("set"), (F.col("label") % 3).cast("string"))), shared_folder(s, "ivf")
    ivf.build(e, at)
    ivf.remove(e.filter("vec_id % 7 = 3"), at)
    found = ivf.find(s, at, e.filter("vec_id % 50 = 0"), 5, probes=4, exact=True, where=F.col("folder") == "set1").withColumn("percent", scalar.percent(F.col("score")))
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"), "percent", scalar.similarity_band(F.col("percent")).alias("band"))


def log_by_day(s: SparkSession, d: str) -> DataFrame:
    """A log of searches made of events, kept for ten days: searches and empty ones by day, after the others were deleted."""
    at = shared_folder(s, "log")
    rows = table(s, d, "events").select(F.col("event_id").alias("query_id"), F.floor(F.col("value") / 30).cast("long").alias("results"), F.col("ts").cast("timestamp").alias("ts"))
    index.append_log(rows.withColumn("empty", F.col("results") == 0), at)
    index.prune_log(s, at, 10, "2024-01-31")
    return index.searches_by_day(s, at).withColumn("day", F.col("day").cast("string"))


#: Text that both engines read alike.
SHARED = {
    "ext_union_all": "SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier) t GROUP BY k",
    "ext_intersect_all": "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT ALL SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R'",
    "ext_except_all": "SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'N' EXCEPT ALL SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 40",
    "c28_dates_bits": "SELECT o_orderkey, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS month, CAST(quarter(o_orderdate) AS BIGINT) AS quarter, CAST(dayofyear(o_orderdate) AS BIGINT) AS day, CAST(CAST(o_orderdate + INTERVAL '1' MONTH AS DATE) AS VARCHAR(10)) AS due, o_orderkey & 12 AS both, o_orderkey | 3 AS either, CAST(bit_count(o_orderkey) AS BIGINT) AS ones, round(sin(o_totalprice), 6) AS wave, round(atan2(o_totalprice, o_custkey), 6) AS angle FROM orders",
}


QUERIES = {
    "l3_ivf_topk": ivf_topk,
    "l3_ivf_folder": folder_ivf,
    "d7_rejected": rejected_widths,
    "d11_log_by_day": log_by_day,
    "t4_stream_index": stream_index,
    "t6_stream_sessions": stream_sessions,
    "t7_timer_sessions": timer_sessions,
    "a6_merged_sketches": merged_sketches,
    "a6_shared_customers": shared_customers,
    "a6_bitmap_rollups": bitmap_rollups,
    "j7_overlap_join": promotion_overlaps,
    "s20_bucketed_join": bucketed_join,
    "s17_sqlite_parts": sqlite_parts,
    "d2_block_changes": block_changes,
    "ext_rising_runs": rising_runs,
    "c25_normalise_all": normalised_all,
}

_SESSIONS = f"""
g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL {GAP_HOURS} HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
a AS (SELECT user_id, min(ts) AS start, max(ts) AS finish, count(*) AS n, round(sum(value), 2) AS total, max(value) AS largest FROM k GROUP BY user_id, k)"""
_CLOSED = f"epoch_us(finish + INTERVAL {GAP_HOURS} HOUR) <= (SELECT 1000 * (epoch_ms(max(ts)) - 3600000) FROM events)"
_RUNS = """
WITH o AS (SELECT *, CASE WHEN value > lag(value) OVER w THEN 0 ELSE 1 END AS first, row_number() OVER w AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY place) AS k FROM o),
r AS (SELECT user_id, k, arg_min(event_id, place) AS first_event, count(*) AS length, round(max(value) - min(value), 4) AS rise FROM k GROUP BY user_id, k)
SELECT user_id, first_event, length, rise FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, k) = 1"""

SQL = {
    "l3_ivf_folder": "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE vec_id <> query_id AND label % 3 = 1 AND vec_id % 7 <> 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, CAST(round(100 * greatest(0.0, score)) AS INT) AS percent FROM s QUALIFY rank <= 5) SELECT query_id, vec_id, rank, round(score, 6) AS score, percent, CASE WHEN percent >= 88 THEN 'high' WHEN percent >= 72 THEN 'mid' ELSE 'low' END AS band FROM r",
    "d7_rejected": "SELECT label::VARCHAR AS folder, count(*) FILTER (vec_id % 9 <> 0) AS stored, count(*) FILTER (vec_id % 9 = 0) AS refused FROM embeddings GROUP BY label",
    "d11_log_by_day": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS searches, count(*) FILTER (floor(value / 30) = 0) AS empty FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') < 10 GROUP BY 1",
    "l3_ivf_topk": "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE vec_id <> query_id) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5",
    "t4_stream_index": "SELECT doc_id::VARCHAR AS path, sha256(text) AS fingerprint, strlen(text) AS size FROM documents",
    "t6_stream_sessions": f"WITH {_SESSIONS} SELECT user_id, CAST(start AS TIMESTAMP) AS start, n, total FROM a WHERE {_CLOSED}",
    "t7_timer_sessions": f"WITH {_SESSIONS} SELECT user_id, epoch_us(start) AS start_us, epoch_us(finish) AS finish_us, n, total, largest FROM a WHERE {_CLOSED}",
    "a6_merged_sketches": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, true AS hll_ok, true AS theta_ok, true AS median_ok FROM events GROUP BY event_type",
    "a6_shared_customers": "SELECT o_orderpriority, count(*) FILTER (years = 2) AS customers, true AS theta_ok FROM (SELECT o_orderpriority, o_custkey, count(DISTINCT year(o_orderdate)) AS years FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY ALL) GROUP BY o_orderpriority",
    "a6_bitmap_rollups": "SELECT 'flag' AS level, l_returnflag AS key, count(DISTINCT l_orderkey) AS n_ids FROM lineitem GROUP BY 2 UNION ALL SELECT 'month', strftime(l_shipdate, '%Y-%m'), count(DISTINCT l_orderkey) FROM lineitem GROUP BY 2 UNION ALL SELECT 'all', 'all', count(DISTINCT l_orderkey) FROM lineitem",
    "j7_overlap_join": f"WITH {_SESSIONS}, x AS (SELECT user_id, floor(epoch(start))::BIGINT AS start, floor(epoch(finish))::BIGINT + 1 AS finish FROM a), p AS (SELECT 1704067200 + o_orderkey % 720 * 3600 AS b, 1704067200 + o_orderkey % 720 * 3600 + (o_custkey % 48 + 1) * 1800 AS e FROM orders WHERE o_totalprice > 400000) SELECT user_id, start, count(*) AS promotions, sum(least(finish, e) - greatest(start, b))::BIGINT AS seconds FROM x JOIN p ON start < e AND b < finish GROUP BY user_id, start",
    "s20_bucketed_join": "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
    "s17_sqlite_parts": "SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size > 20 AND p_partkey % 3 = 1",
    "d2_block_changes": "WITH h AS (SELECT doc_id, hex(encode(text)) AS b FROM documents), e AS (SELECT doc_id, b, CASE WHEN doc_id % 5 = 0 AND length(b) > 1400 THEN substr(b, 1, 1400) || '2A' || substr(b, 1403) ELSE b END || CASE WHEN doc_id % 7 = 0 THEN '7461696C' ELSE '' END AS a FROM h), i AS (SELECT *, unnest(range(greatest(1, (greatest(length(a), length(b)) + 1023) // 1024))) AS block FROM e) SELECT doc_id::VARCHAR AS path, block FROM i WHERE substr(a, block * 1024 + 1, 1024) <> substr(b, block * 1024 + 1, 1024)",
    "ext_rising_runs": _RUNS,
    "c25_normalise_all": f"SELECT vec_id, i AS place, round((embedding[i + 1]::DOUBLE - (ARRAY[{', '.join(f'{x}::DOUBLE' for x in MEAN)}])[i % 3 + 1]) / (ARRAY[{', '.join(f'{x}::DOUBLE' for x in STD)}])[i % 3 + 1], 6) AS value FROM embeddings, range(64) r(i)",
}
