"""Token files: ids of fixed width, in the fewest bits that hold the vocabulary.

Rows are sorted over all partitions by doc_id, and each task writes its range as
shards of about SHARD_CHARS characters, one after another:

    header   magic "BPK2", bits, number of blocks, documents, ids, documents without an id (5 x uint64 after the magic's 8 bytes)
    blocks   uint64 byte offset of each block of BLOCK ids, from the start of the file
    bounds   uint64 number of ids before each document, and the total
    doc ids  int64 each; the last ones, as many as the header says, are null
    payload  blocks of BLOCK ids, each beginning on a byte

so one document needs only the blocks that its bounds name. Files are written
under a name of the attempt and listed in a manifest that the job returns, so
what a lost or repeated task leaves behind is never read.

Nulls in text count as empty (the end id alone). Null ids sort last. Repeated
ids are documents of their own, in the order of a hash of their text; equal rows in any, so
an id of many rows is spread over tasks. An empty table gives no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.textgrid import chunks, release_memory
from tessera.llm.tokens import encoder

BLOCK = 4096
SHARD_CHARS = 24_000_000
MAGIC = b"BPK2\0\0\0\0"
HEAD = 48


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:  # the same layout, without the detour over single bits
        return ids.astype(">u2").tobytes()
    planes = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(planes.ravel()).tobytes()


def unpack_bits(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    out = np.zeros((n, 32), np.uint8)
    out[:, 32 - bits :] = planes
    return np.packbits(out, axis=1).view(">u4").ravel().astype("<u4")


def encode_shard(doc_ids: list[int | None], tokens: list[bytes], bits: int) -> bytes:
    """`doc_ids` in file order, nulls last."""
    ids = np.frombuffer(b"".join(tokens), "<u4")
    bounds = np.concatenate([[0], np.cumsum([len(t) // 4 for t in tokens])]).astype("<u8")
    blocks = [pack_bits(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    head = np.array([bits, len(blocks), len(doc_ids), len(ids), sum(i is None for i in doc_ids)], "<u8")
    begin = HEAD + 8 * len(blocks) + bounds.nbytes + 8 * len(doc_ids)
    at = (begin + np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]])).astype("<u8") if blocks else np.zeros(0, "<u8")
    return b"".join([MAGIC, head.tobytes(), at.tobytes(), bounds.tobytes(), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), *blocks])


class Shard:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.data = memoryview(data)
        self.bits, n_blocks, n_docs, self.n_ids, nulls = (int(x) for x in np.frombuffer(data, "<u8", 5, 8))
        self.blocks = np.frombuffer(data, "<u8", n_blocks, HEAD)
        self.bounds = np.frombuffer(data, "<u8", n_docs + 1, HEAD + 8 * n_blocks)
        ids = np.frombuffer(data, "<i8", n_docs, HEAD + 8 * n_blocks + 8 * (n_docs + 1)).tolist()
        self.doc_ids: list[int | None] = ids[: n_docs - nulls] + [None] * nulls

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end, from the blocks that hold them alone."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK, (end - 1) // BLOCK
        parts = []
        for b in range(first, last + 1):
            n, at = min(BLOCK, self.n_ids - b * BLOCK), int(self.blocks[b])
            parts.append(unpack_bits(self.data[at : at + -(-n * self.bits // 8)], n, self.bits))
        return np.concatenate(parts)[start - first * BLOCK : end - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.bounds[i]), int(self.bounds[i + 1]))


def shared_folder(spark: SparkSession, name: str = "tokens") -> str:
    """A new folder in the one that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _store(folder: str):
    """The file system of a folder that driver and executors share, and the path in it."""
    from pyarrow import fs

    for other in ("s3a://", "s3n://"):
        folder = folder.replace(other, "s3://", 1) if folder.startswith(other) else folder
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Writes the shards and returns the manifest: part and place (their order), file, n_docs, n_ids."""
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        enc, end, part = encoder(vocabulary), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        store, at = _store(folder)
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = place = 0

        def shard():
            nonlocal held, place
            name = f"shard-{part:08d}-{place:06d}-{uuid.uuid4().hex}.bpk"
            store.create_dir(at, recursive=True)
            with store.open_output_stream(f"{at}/{name}.part") as out:
                out.write(encode_shard(ids, tokens, bits_for(enc.vocabulary)))
            store.move(f"{at}/{name}.part", f"{at}/{name}")
            row = pa.RecordBatch.from_pydict({"part": [part], "place": [place], "file": [name], "n_docs": [len(ids)], "n_ids": [sum(map(len, tokens)) // 4]})
            ids.clear(), tokens.clear()
            held, place = 0, place + 1
            return row

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = batch.slice(i, 64)
                texts = [t or "" for t in rows["text"].to_pylist()]
                for a, b in chunks(texts, shard_chars):
                    n = sum(map(len, texts[a:b])) + b - a
                    if held and held + n > shard_chars:
                        yield shard()
                    held += n
                    ids += rows["doc_id"][a:b].to_pylist()
                    tokens += [x + end for x in enc.ids(texts[a:b])]
        if ids:
            yield shard()
        release_memory()

    chars = docs.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)).first()[0] or 0
    n = max(1, min(chars, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-chars // shard_chars))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("from"))
    order = (F.asc_nulls_last("doc_id"), "h", "from")
    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return ranged.mapInArrow(run, "part long, place long, file string, n_docs long, n_ids long").checkpoint()


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row for each document: part and place of its shard, doc_id, before (ids before it in the shard), n_tokens, ids_crc32."""
    import pyarrow as pa

    schema = "file string, doc_id long, before long, n_tokens long, ids_crc32 long"

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                s = Shard(content.as_py())
                rows = []
                for begin in range(0, len(s.doc_ids), 256):
                    stop = min(begin + 256, len(s.doc_ids))
                    base = int(s.bounds[begin])
                    ids = s.ids(base, int(s.bounds[stop])).tobytes()
                    for i in range(begin, stop):
                        a, b = int(s.bounds[i]), int(s.bounds[i + 1])
                        rows.append((path.rsplit("/", 1)[-1], s.doc_ids[i], a, b - a, zlib.crc32(ids[4 * (a - base) : 4 * (b - base)])))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["file", "doc_id", "before", "n_tokens", "ids_crc32"])

    if manifest.isEmpty():
        return spark.createDataFrame([], "part long, place long, " + schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bpk").load(folder).select("path", "content")
    return files.mapInArrow(run, schema).join(manifest.select("file", "part", "place"), "file")


def encode_documents(docs: DataFrame, vocabulary: str, folder: str | None = None, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Writes the token files, reads them back and adds each document's global start."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    manifest = write(docs, folder, vocabulary, shard_chars=shard_chars)
    # ids before each part, then before each shard of a part: both windows see rows of the manifest only
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.join(parts, "part").select("part", "place", (F.col("part_base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base"))
    rows = read(spark, folder, manifest).join(starts, ["part", "place"])
    return rows.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
