"""An inverted-file index: vectors in lists by their nearest centroid, so that a search reads few of the lists.

Centroids come from k-means by cosine on a bounded sample of unit vectors. There are about as many lists as the
root of the number of rows, and at most as many as keep all centroids
within CENTROID_BYTES, which is what is sent to the tasks. A folder holds

    lists/added=<name>/list=<n>  the rows, with all their columns and their distance to the centroid
    centroids                    list, centroid, and its share of the sample
    sizes/added=<name>           list, rows and radius, for each addition
    removed                      vec_ids that are out, if any
    probes                       k, recall and the number of lists that reach it, once `calibrate` was run

A search ranks the lists by the distance of their centroids and reads only those
directories that some query probes. With `exact`, it then goes on to every list that can still
hold a nearer row by the triangle inequality (distance of the centroid less
the list's radius, on the unit sphere), so its results are those of a whole scan.

Vectors that are null or zero, hold null or non-finite elements or have another width have no place in the index: `build` and `add` return
them. A row with a null vec_id is indexed but never found, nor is it a query. Repeated rows are all kept. An index of no rows can't be built.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessera.operators import search
from tessera.operators.search import QUERY_BYTES

CENTROID_BYTES = 128_000_000
SAMPLE_A_LIST = 64
ROWS_A_FILE = 200_000
SLACK = 1e-6
CALIBRATION_QUERIES = 200


def _valid(width: int | None = None):
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists(e, lambda x: x != 0)
    return F.coalesce(fine & some & (F.size(e) == width if width else F.lit(True)), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, lists: int | None = None, seed: int = 1, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids, and the share of the sample in each list. The sample is picked by a hash of vec_id; its expected size is SAMPLE_A_LIST rows a list."""
    width = vectors.filter(_valid()).select(F.size("embedding")).first()
    if width is None:
        raise ValueError("no vectors to index")
    good = vectors.filter(_valid(width[0]))
    n = good.count()
    lists = min(n, lists or max(1, round(n**0.5)), max(1, CENTROID_BYTES // (8 * width[0])))
    share = SAMPLE_A_LIST * lists / n
    if share < 1:
        good = good.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = good.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()  # bounded, and read in each round
    model = KMeans(k=lists, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(sample)
    centres = _unit(np.array(model.clusterCenters()))
    sizes = np.array(model.summary.clusterSizes, float)[: len(centres)]  # of equal rows, fewer lists than asked for may come
    sample.unpersist()
    return centres, sizes / sizes.sum()


def _place(vectors: DataFrame, centroids: np.ndarray, pieces: np.ndarray) -> DataFrame:
    """`vectors` with list, distance to its centroid and piece, of `pieces` of a list."""
    import pyarrow as pa

    sent = vectors.sparkSession.sparkContext.broadcast((centroids, pieces))
    schema = StructType([*vectors.schema.fields, StructField("list", IntegerType()), StructField("distance", DoubleType()), StructField("piece", IntegerType())])

    def run(batches):
        centres, split = sent.value
        row = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _unit(np.array(part["embedding"].to_pylist(), float))
                near = x @ centres.T
                own = near.argmax(axis=1)
                # measured anew: 2 - 2 cos loses what is small
                gap = np.linalg.norm(x - centres[own], axis=1)
                piece = np.arange(row, row + len(own)) % split[own]
                row += len(own)
                columns = [*part.columns, pa.array(own, pa.int32()), pa.array(gap), pa.array(piece, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "list", "distance", "piece"])

    return vectors.mapInArrow(run, schema)


def build(vectors: DataFrame, folder: str, lists: int | None = None, seed: int = 1) -> DataFrame:
    """Writes a new index of vec_id, embedding and any other columns; returns the rows that it doesn't take."""
    spark = vectors.sparkSession
    centroids, share = fit(vectors, lists, seed)
    rows = [(i, c.tolist(), float(s)) for i, (c, s) in enumerate(zip(centroids, share, strict=True))]
    spark.createDataFrame(rows, "list int, centroid array<double>, share double").coalesce(1).write.parquet(f"{folder}/centroids")
    return add(vectors, folder)


def add(vectors: DataFrame, folder: str, name: str | None = None) -> DataFrame:
    """Adds rows to the lists of an index; returns those that it doesn't take.

    Rows added again under the same `name` (letters, digits, - and _) replace those that were, so a batch of a stream may come twice.
    """
    spark, name = vectors.sparkSession, name or uuid.uuid4().hex
    centroids, share = _centroids(spark, folder)
    good = vectors.filter(_valid(centroids.shape[1]))
    pieces = np.maximum(1, np.ceil(share * good.count() / ROWS_A_FILE)).astype(np.int64)  # a large list is several files, and tasks
    placed = _place(good, centroids, pieces).repartition(int(pieces.sum()), "list", "piece").drop("piece")
    _write(placed, folder, name)
    return vectors.filter(~_valid(centroids.shape[1]))


def _write(placed: DataFrame, folder: str, name: str) -> None:
    spark, at = placed.sparkSession, f"{folder}/lists/added={name}"
    placed.write.mode("overwrite").partitionBy("list").parquet(at)
    own = spark.read.schema("list int, distance double").parquet(at)
    own.groupBy("list").agg(F.count("*").alias("rows"), F.max("distance").alias("radius")).write.mode("overwrite").parquet(f"{folder}/sizes/added={name}")


def remove(ids: DataFrame, folder: str) -> None:
    """Takes the rows of these vec_ids out of an index: searches pass over them from now on, `compact` drops them. Rows added later under such an id stay out too, until then."""
    ids.select(F.col("vec_id").cast("long")).filter("vec_id is not null").distinct().write.mode("append").parquet(f"{folder}/removed")


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """Writes the index to a new folder, with one addition instead of many and without removed rows; the old one stays as it is for searches under way."""
    centroids, share = _centroids(spark, folder)
    spark.read.parquet(f"{folder}/centroids").coalesce(1).write.parquet(f"{to}/centroids")
    rows = lists(spark, folder).drop("added")
    pieces = np.maximum(1, np.ceil(share * rows.count() / ROWS_A_FILE)).astype(np.int64)
    sizes = spark.createDataFrame([(i, int(p)) for i, p in enumerate(pieces)], "list int, pieces int")
    dealt = rows.join(F.broadcast(sizes), "list").withColumn("piece", F.pmod(F.xxhash64("vec_id", "distance"), "pieces"))
    _write(dealt.repartition(int(pieces.sum()), "list", "piece").drop("piece", "pieces"), to, "compacted")
    probes = _stored(spark, f"{folder}/probes")
    if probes is not None:
        probes.write.parquet(f"{to}/probes")


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """A table of the index; None if nothing was written to it yet."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _centroids(spark: SparkSession, folder: str) -> tuple[np.ndarray, np.ndarray]:
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()  # CENTROID_BYTES at most
    return np.array([r["centroid"] for r in rows]), np.array([r["share"] for r in rows])


def _radius(spark: SparkSession, folder: str, n: int) -> np.ndarray:
    """Of each list; -1 if it is empty."""
    out = np.full(n, -1.0)
    for r in spark.read.parquet(f"{folder}/sizes").groupBy("list").agg(F.max("radius").alias("radius")).collect():  # a row a list
        out[r["list"]] = r["radius"]
    return out


def lists(spark: SparkSession, folder: str, wanted: np.ndarray | None = None) -> DataFrame:
    """The rows of some lists, whose directories alone are read, or of all lists, less the removed."""
    rows = spark.read.parquet(f"{folder}/lists")
    if wanted is not None:
        rows = rows.filter(F.col("list").isin(np.asarray(wanted).tolist()))
    gone = _stored(spark, f"{folder}/removed")
    return rows if gone is None else rows.join(gone.distinct(), "vec_id", "left_anti").select(*rows.columns)


def _scan(spark: SparkSession, folder: str, blocks: list, probed: np.ndarray, k: int, where: Column | None) -> DataFrame:
    """The k nearest rows of each query, by task, among the lists that the query probes; probed[query, list]."""
    import pyarrow as pa

    sent = spark.sparkContext.broadcast((blocks, np.packbits(probed, axis=0), probed.shape[0]))

    def run(batches):
        blocks, bits, n = sent.value
        ids, widths, values = (np.concatenate(x) for x in zip(*blocks, strict=True))
        width = int(widths[0])
        values = values.reshape(-1, width)
        best: list[np.ndarray] = []
        for batch in batches:
            own = np.array(batch["list"].to_pylist(), np.int64)
            for number in np.unique(own):
                asks = np.flatnonzero(np.unpackbits(bits[:, number], count=n))
                rows = batch.filter(pa.array(own == number))
                for part in search._slices([rows]) if len(asks) else ():
                    c = search._unpack(*(x.tobytes() for x in search._packed(part)))
                    for b in range(0, len(asks), search.BLOCK):
                        at = asks[b : b + search.BLOCK]
                        q = search._unpack(ids[at].tobytes(), widths[at].tobytes(), values[at].ravel().tobytes())
                        i, j, score, _ = search._nearest(q, c, k)  # all are known: the index holds valid vectors only
                        found = q[0][i], c[0][j], score, np.full(len(i), number)
                        best = [np.concatenate(x) for x in zip(best, found, strict=True)] if best else list(found)
                        if len(best[0]) > 4 * k * n:
                            best = _keep(best, k)
        if best:
            columns = [pa.array(x, t) for x, t in zip(_keep(best, k), (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "list"])

    wanted = np.flatnonzero(probed.any(axis=0))
    rows = lists(spark, folder, None if len(wanted) == probed.shape[1] else wanted).filter("vec_id is not null")
    rows = rows if where is None else rows.filter(where)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "list")
    return rows.mapInArrow(run, "query_id long, vec_id long, score double, list int")


def _keep(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    queries, vectors, score = found[:3]
    order = np.lexsort((vectors, -score, queries))
    group = queries[order]
    order = order[np.arange(len(order)) - np.searchsorted(group, group) < k]
    return [x[order] for x in found]


def _best(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def find(spark: SparkSession, folder: str, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, query_bytes: int = QUERY_BYTES, where: Column | None = None) -> DataFrame:
    """query_id, vec_id, score, list, rank: the k nearest rows by cosine of each query among those of `probes` lists, and of these the rows for which `where` holds.

    Without `probes` it is what `calibrate` found, or all lists. More than `query_bytes` of queries go in parts, each a search of its own.
    Queries that are no valid vectors of the index's width have no results.
    """
    centroids, _ = _centroids(spark, folder)
    queries = queries.filter(_valid(centroids.shape[1]) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "embedding")
    parts = -(-search._bytes(queries) // query_bytes)
    if parts > 1:
        out = None
        for part in range(parts):
            own = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)
            found = find(spark, folder, own, k, probes, exact, 1 << 62, where)
            out = found if out is None else out.unionByName(found)
        return out
    blocks = [tuple(np.frombuffer(x, t) for x, t in zip(r, (np.int64, np.int64, np.float64), strict=True)) for r in search._blocks(queries, "q").collect()]
    if not blocks:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, list int, rank long")
    ids = np.concatenate([b[0] for b in blocks])
    gap = _gaps(np.concatenate([b[2] for b in blocks]).reshape(len(ids), -1), centroids)
    radius = _radius(spark, folder, len(centroids))
    probes = probes or _probes(spark, folder, k) or len(centroids)
    probed = np.zeros(gap.shape, bool)
    filled = np.flatnonzero(radius >= 0)
    nearest = filled[np.argsort(gap[:, filled], axis=1, kind="stable")[:, :probes]]
    np.put_along_axis(probed, nearest, True, axis=1)
    first = _best(_scan(spark, folder, blocks, probed, k, where), k)
    if not exact:
        return first
    first = first.checkpoint()
    # the k-th score so far: a list whose rows are all farther can't change the result
    last = {r["query_id"]: r["score"] for r in first.filter(F.col("rank") == k).select("query_id", "score").collect()}  # a row a query
    reach = np.array([np.sqrt(max(0.0, 2 - 2 * last[i])) if i in last else np.inf for i in ids.tolist()])
    more = (gap - radius <= reach[:, None] + SLACK) & (radius >= 0) & ~probed
    if not more.any():
        return first
    return _best(first.drop("rank").unionByName(_scan(spark, folder, blocks, more, k, where)), k)


def _gaps(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of unit vectors to the centroids."""
    return np.sqrt(np.maximum(0, 2 - 2 * _unit(x) @ centroids.T))


def _probes(spark: SparkSession, folder: str, k: int) -> int | None:
    """The calibrated number of lists for the smallest calibrated k that is enough."""
    known = _stored(spark, f"{folder}/probes")
    rows = known.filter(F.col("k") >= k).orderBy("k", F.desc("probes")).limit(1).collect() if known is not None else []
    return rows[0]["probes"] if rows else None


def calibrate(spark: SparkSession, folder: str, queries: DataFrame, k: int, recall: float = 0.95) -> int:
    """The smallest number of lists that holds `recall` of the true k nearest rows of up to CALIBRATION_QUERIES queries, picked by a hash; later searches use it."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION_QUERIES)
    centroids, _ = _centroids(spark, folder)
    truth = find(spark, folder, some, k, exact=True).select("query_id", "list").collect()  # k rows for each of these queries
    vectors = {r["vec_id"]: r["embedding"] for r in some.collect()}
    radius = _radius(spark, folder, len(centroids))
    place = []
    for i in {r["query_id"] for r in truth}:
        gap = np.where(radius >= 0, _gaps(np.array([vectors[i]], float), centroids)[0], np.inf)
        rank = np.empty(len(gap), np.int64)
        rank[np.argsort(gap, kind="stable")] = np.arange(len(gap))
        place += [int(rank[r["list"]]) for r in truth if r["query_id"] == i]
    if not place:
        raise ValueError("no query has neighbours")
    probes = int(np.sort(place)[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1
    spark.createDataFrame([(k, recall, probes)], "k int, recall double, probes int").write.mode("append").parquet(f"{folder}/probes")
    return probes
