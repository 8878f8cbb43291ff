"""Bounded samples of documents for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 64_000_000


def texts_of(docs: DataFrame, ids: DataFrame, max_docs: int, max_bytes: int = MAX_BYTES) -> list[tuple]:
    """(doc_id, text, and the other columns of `ids`) of the documents that `ids`, of at most `max_docs` rows, names by doc_id.

    At most `max_docs` texts and `max_bytes` bytes come to the driver, in the order of a hash of doc_id:
    equal rows count once, and a text that would exceed the bytes is passed over. Lengths and hashes are looked at first, texts fetched afterwards.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("h", F.xxhash64("text"))
    facts = rows.select("doc_id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).distinct()
    chosen, total = [], 0
    for doc_id, h, size in facts.orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(max_docs).collect():
        if total + size <= max_bytes:
            chosen.append((doc_id, h))
            total += size
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long")
    return [tuple(r) for r in rows.join(F.broadcast(wanted), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).drop("h").collect()]
