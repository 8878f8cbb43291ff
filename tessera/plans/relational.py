"""Queries of validation, null rules, JSON, the search log and general relational operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import index, search, validation
from tessera.sources.tables import register, table

#: Registrations made of customers, in text that both engines read alike.
REGISTRATIONS = """
SELECT c_custkey, substr(c_mktsegment, 1, c_custkey % 4) AS first_name, c_name AS last_name,
  CASE c_custkey % 3 WHEN 0 THEN concat('user', c_custkey, '@example.org') WHEN 1 THEN concat('user', c_custkey) ELSE '' END AS email,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '+1234567890' WHEN 2 THEN '12-34' WHEN 3 THEN '12 34-567890' ELSE '' END AS phone_number,
  concat('Pa', c_custkey * 37, CASE WHEN c_custkey % 2 = 0 THEN '!!' ELSE '' END) AS password,
  CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN 'other' ELSE concat('Pa', c_custkey * 37, CASE WHEN c_custkey % 2 = 0 THEN '!!' ELSE '' END) END AS confirm_password
FROM customer"""

SHARED = {
    "f2_state": "SELECT c_mktsegment = 'BUILDING' AS is_building, c_mktsegment <> 'BUILDING' AND c_acctbal < 0 AS is_owing, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1, 2",
    "ext_right_join": "SELECT s.s_suppkey, n.n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "ext_interval_join": "SELECT a.event_id, CAST(count(b.event_id) AS BIGINT) AS n FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL '6' HOUR GROUP BY a.event_id",
    "ext_lateral_join": "SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t",
    "ext_ntile": "SELECT s_suppkey, CAST(ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS BIGINT) AS quarter FROM supplier",
    "ext_range_frame": "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '12' HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events",
    "ext_median": "SELECT o_orderpriority, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS median FROM orders GROUP BY o_orderpriority",
}

TEMPLATES = {"AUTOMOBILE": "{{name}} drives", "BUILDING": "{{name}} builds", "MACHINERY": "{{name}} makes"}
MEAN, STD = (0.48, 0.46, 0.41), (0.27, 0.26, 0.28)


def registrations(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "customer").createOrReplaceTempView("customer")
    return s.sql(REGISTRATIONS)


def valid_registrations(s: SparkSession, d: str) -> DataFrame:
    checked = validation.with_errors(registrations(s, d), validation.registration_rules())
    return checked.select("c_custkey", (F.size("errors") == 0).alias("valid"), F.array_join("errors", ",").alias("errors"))


def in_folder(s: SparkSession, d: str) -> DataFrame:
    """The nearest rows to vector 0 in one folder; a vector's folder follows from its label."""
    e = table(s, d, "embeddings").withColumn("folder", F.concat(F.lit("D:\\set"), (F.col("label") % 3).cast("string"), F.lit("\\"), F.col("label").cast("string")))
    return index.find(e, e.filter("vec_id = 0"), 15, "D:\\set1\\").withColumn("score", F.round("score", 6))


def search_log(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    found = search.batch_top_k(e, e.filter("vec_id % 20 = 0"), 50)
    return index.log_entries(found.withColumn("percent", scalar.percent(F.col("score"))), 40)


def changed_files(s: SparkSession, d: str) -> DataFrame:
    """Documents as files, against an index that lacks some, has one more and knows others in another form."""
    files = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("modified"))
    old = files.filter("modified % 5 <> 0").withColumn("content", F.when(F.col("modified") % 7 == 0, F.concat("content", F.lit(b"x"))).otherwise(F.col("content")))
    old = old.withColumn("modified", F.when(F.col("modified") % 11 == 0, F.col("modified") + 1).otherwise(F.col("modified")))
    gone = s.createDataFrame([("gone", bytearray(b""), 0)], "path string, content binary, modified long")
    return index.changes(files, index.facts(old.unionByName(gone)))


def asof(s: SparkSession, d: str) -> DataFrame:
    """For each event the user's latest order at or before it: both tables in one order of time, the last order carried on."""
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.lit(0).alias("side"), F.col("o_orderkey").alias("id"))
    events = table(s, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), F.lit(1).alias("side"), F.col("event_id").alias("id"))
    w = Window.partitionBy("k").orderBy("at", "side", "id").rowsBetween(Window.unboundedPreceding, -1)
    both = orders.unionByName(events).withColumn("o_orderkey", F.last(F.when(F.col("side") == 0, F.col("id")), ignorenulls=True).over(w))
    return both.filter("side = 1").select(F.col("id").alias("event_id"), "o_orderkey")


def _token(c: str = "c_custkey"):
    return F.when(F.col(c) % 3 == 0, F.lit(None).cast("string")).when(F.col(c) % 3 == 1, "").otherwise(F.concat(F.lit("t"), F.col(c).cast("string")))


def _entries(m):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ";")


def _headers(s, d):
    token = _token()
    return table(s, d, "customer").select("c_custkey", _entries(scalar.with_entry(F.create_map(F.lit("accept"), F.lit("json")), scalar.truthy(token), "authorization", F.concat(F.lit("Bearer "), token))).alias("headers"))


def _drop_key(s, d):
    m = F.create_map(F.lit("passwordMismatch"), F.lit("true"), F.lit("required"), F.col("c_name"))
    left = F.map_filter(m, lambda k, v: (k != "passwordMismatch") & (F.col("c_custkey") % 2 == 0))
    return table(s, d, "customer").select("c_custkey", _entries(left).alias("rest"), F.size(F.map_keys(left)).cast("long").alias("left"))


def _null_rules(s, d):
    token = _token()
    present = F.map_filter(F.create_map(F.lit("token"), token), lambda k, v: F.col("c_custkey") % 2 == 0)
    user = F.when(F.col("c_custkey") % 2 == 0, F.struct(F.col("c_name").alias("name")))
    return table(s, d, "customer").select(
        "c_custkey", scalar.get_or(present, "token", "none").alias("got"), F.coalesce(token, F.lit("none")).alias("nullish"),
        user["name"].alias("chained"), scalar.truthy(token).alias("truthy"), scalar.or_default(token, "none").alias("or_default"),
    )


def _decoded(s, d):
    payload = F.from_json(F.concat(F.lit('{"data": {"user": '), "props", F.lit(', "token": "t", "rest": [1]}}')), "data struct<token: string, user: struct<k: bigint>>")
    return table(s, d, "events").select("event_id", payload["data"].alias("data")).select("event_id", F.col("data.user.k").alias("k"), F.to_json("data").alias("pruned"))


def _enveloped(s, d):
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    number = text.try_cast("int")
    message = F.when(number.isNull(), F.concat(F.lit("not a number: "), text)).otherwise("")
    return table(s, d, "part").select("p_partkey", scalar.envelope(number.isNotNull(), message, number).alias("e")).select("p_partkey", "e.success", "e.message", "e.data")


def _translated(s, d):
    key = F.col("c_mktsegment")
    template = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv]), key), key)
    return table(s, d, "customer").select("c_custkey", F.replace(template, F.lit("{{name}}"), F.col("c_name")).alias("text"))


def _normalised(s, d):
    pixel = F.slice("embedding", 1, 3)
    out = F.transform(pixel, lambda x, i: F.round((x.cast("double") - F.get(F.array(*map(F.lit, MEAN)), i)) / F.get(F.array(*map(F.lit, STD)), i), 6))
    return table(s, d, "embeddings").select("vec_id", out[0].alias("red"), out[1].alias("green"), out[2].alias("blue"))


def _sliding(s, d):
    w = F.window("ts", "12 hours", "6 hours")
    return table(s, d, "events").groupBy(w.start.cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))


def _lateral(s, d):
    """The SQL's join. The column that orders is selected too: otherwise a projection comes between Spark's limit and sort, and the limit by customer forgets the order."""
    register(s, d, ["customer", "orders"])
    return s.sql("SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")


QUERIES = {
    "ext_lateral_join": _lateral,
    "f1_can_search": lambda s, d: table(s, d, "documents").select("doc_id", (scalar.truthy(F.col("lang")) & scalar.truthy(F.col("source"))).alias("ok")),
    "f13_valid_registrations": valid_registrations,
    "f15_search_in_folder": in_folder,
    "p4_pruned_payload": _decoded,
    "p7_drop_key": _drop_key,
    "p8_conditional_entry": _headers,
    "c14_null_rules": _null_rules,
    "c20_title": lambda s, d: table(s, d, "customer").select("c_custkey", F.initcap("c_mktsegment").alias("title")),
    "c21_translate": _translated,
    "c23_error_envelope": _enveloped,
    "c25_normalise": _normalised,
    "d2_changed_files": changed_files,
    "d11_search_log": search_log,
    "ext_asof_join": asof,
    "ext_sliding_window": _sliding,
}

_TOKEN = "CASE WHEN c_custkey % 3 = 1 THEN '' WHEN c_custkey % 3 = 2 THEN 't' || c_custkey END"
_RULES = [
    ("first_name.required", "coalesce(first_name, '') <> ''"), ("first_name.minlength", "coalesce(first_name, '') = '' OR length(first_name) >= 2"),
    ("last_name.required", "coalesce(last_name, '') <> ''"), ("last_name.minlength", "coalesce(last_name, '') = '' OR length(last_name) >= 2"),
    ("email.required", "coalesce(email, '') <> ''"), ("email.email", "coalesce(email, '') = '' OR regexp_full_match(email, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')"),
    ("phone_number.phoneInvalid", "regexp_full_match(coalesce(phone_number, ''), '(\\+?[\\d\\s\\-]{10,15})?')"),
    ("password.required", "coalesce(password, '') <> ''"), ("password.minlength", "coalesce(password, '') = '' OR length(password) >= 8"),
    ("confirm_password.required", "coalesce(confirm_password, '') <> ''"), ("confirm_password.passwordMismatch", "coalesce(confirm_password, '') = '' OR confirm_password = password"),
]
_FILES = "SELECT doc_id::VARCHAR AS path, text, doc_id AS modified FROM documents"

SQL = {
    "f1_can_search": "SELECT doc_id, coalesce(lang, '') <> '' AND coalesce(source, '') <> '' AS ok FROM documents",
    "f13_valid_registrations": "SELECT c_custkey, errors = '' AS valid, errors FROM (SELECT c_custkey, concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({ok}) THEN '{code}' END" for code, ok in _RULES) + f") AS errors FROM ({REGISTRATIONS}) r)",
    "f15_search_in_folder": "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE vec_id <> query_id AND label % 3 = 1 ORDER BY score DESC, vec_id LIMIT 15), p AS (SELECT *, CAST(round(100 * greatest(0.0, score)) AS INT) AS percent FROM s) SELECT query_id, vec_id, round(score, 6) AS score, percent, CASE WHEN percent >= 88 THEN 'high' WHEN percent >= 72 THEN 'mid' ELSE 'low' END AS band FROM p",
    "p4_pruned_payload": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"token":"t","user":{"k":' || json_extract(props, '$.k') || '}}' AS pruned FROM events""",
    "p7_drop_key": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'required=' || c_name ELSE '' END AS rest, CAST(c_custkey % 2 = 0 AS BIGINT) AS left FROM customer",
    "p8_conditional_entry": f"SELECT c_custkey, 'accept=json' || CASE WHEN coalesce({_TOKEN}, '') <> '' THEN ';authorization=Bearer ' || {_TOKEN} ELSE '' END AS headers FROM customer",
    "c14_null_rules": f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN {_TOKEN} ELSE 'none' END AS got, coalesce({_TOKEN}, 'none') AS nullish, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS chained, coalesce({_TOKEN}, '') <> '' AS truthy, coalesce(nullif({_TOKEN}, ''), 'none') AS or_default FROM customer",
    "c20_title": "SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS title FROM customer",
    "c21_translate": "SELECT c_custkey, replace(CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TEMPLATES.items()) + " ELSE c_mktsegment END, '{{name}}', c_name) AS text FROM customer",
    "c23_error_envelope": "SELECT p_partkey, n IS NOT NULL AS success, CASE WHEN n IS NULL THEN 'not a number: ' || t ELSE '' END AS message, n AS data FROM (SELECT p_partkey, t, TRY_CAST(t AS INT) AS n FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_size::VARCHAR END AS t FROM part))",
    "c25_normalise": "SELECT vec_id, " + ", ".join(f"round((embedding[{i + 1}]::DOUBLE - {MEAN[i]}::DOUBLE) / {STD[i]}::DOUBLE, 6) AS {c}" for i, c in enumerate(("red", "green", "blue"))) + " FROM embeddings",
    "d2_changed_files": f"WITH a AS ({_FILES}), b AS (SELECT path, CASE WHEN modified % 7 = 0 THEN text || 'x' ELSE text END AS text, modified + CAST(modified % 11 = 0 AS INT) AS modified FROM a WHERE modified % 5 <> 0 UNION ALL SELECT 'gone', '', 0) SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'gone' WHEN a.text IS NOT DISTINCT FROM b.text AND a.modified = b.modified THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path",
    "d11_search_log": "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 50) SELECT query_id, count(*) FILTER (round(100 * greatest(0.0, score)) >= 40) AS results, results = 0 AS empty FROM s GROUP BY query_id",
    "ext_asof_join": "SELECT event_id, (SELECT o_orderkey FROM orders WHERE o_custkey = user_id AND o_orderdate <= ts ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS o_orderkey FROM events",
    "ext_sliding_window": "SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY 1, 2",
}
