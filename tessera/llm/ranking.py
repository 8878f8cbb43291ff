"""Ranked lexical search by sort-based accumulation.

Query items are indexed by term and sent to the tasks, at most PART_TERMS terms of items at
a time (a longer item is alone); each part costs two passes over the documents.
The first counts, within tasks, what the weights need. In the second, each task takes its own range of documents:

1. the terms of a run of documents that occur in the index are counted (sorted, unique);
2. the matched (item, document, impact) entries of all of them are concatenated,
   RUN_ENTRIES at a time, cut between documents;
3. entries are sorted by a packed key of item and document, a radix sort over
   digits of 16 bits, and `reduceat` adds up the impacts of equal keys;
4. a heap for each item keeps the best of the task's range.

A document is in one task whole, so its sums are complete there, and a task sends
`top` rows for each item at most, which are merged over runs of SLOT_TASKS tasks and then over these.

Nulls in text have no terms, nor have empty texts. A null doc_id comes last among equal scores. Repeated
documents each take a rank of their own. Each row of `items` is ranked for itself, so
rows that share an item_id have ranks of their own. An empty table of either kind gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.terms import splitter
from tessera.llm.textgrid import release_memory

TOP = 20
PART_TERMS = 500_000
RUN_ENTRIES = 1_000_000
RUN_DOCUMENTS = 256
RUN_BYTES = 1_000_000
SLOT_TASKS = 256


def radix_argsort(keys: np.ndarray, bound: int) -> np.ndarray:
    """The stable order of non-negative keys below `bound`, by digits of 16 bits from the lowest."""
    order = None
    for shift in range(0, max(1, (bound - 1).bit_length()), 16):
        digit = (keys >> shift & 0xFFFF).astype(np.uint16)
        order = digit.argsort(kind="stable") if order is None else order[digit[order].argsort(kind="stable")]
    return order


class Index:
    """Terms of some items, and for each term the items that hold it, with how often."""

    def __init__(self, texts: list[bytes]):
        split, postings = splitter(digits=True), {}
        for item, text in enumerate(texts):
            for term, times in Counter(split(text)).items():
                postings.setdefault(term, []).append((item, times))
        self.n_items = len(texts)
        self.number = {term: i for i, term in enumerate(postings)}
        self.first = np.cumsum([0, *map(len, postings.values())])
        flat = [*chain.from_iterable(postings.values())]
        self.item, self.times = np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat], np.int64)

    def weigh(self, found: dict[int, int], n_docs: int) -> None:
        """Sets the weight of each posting from the number of documents that hold its term."""
        w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(i, 0) + 1))) for i in range(len(self.number))]
        self.weight = np.repeat(np.array(w, np.int64), np.diff(self.first)) * self.times

    def matched(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, occurrences) of the documents' terms that are in the index, by document."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        term = np.fromiter(map(self.number.get, chain.from_iterable(words), repeat(-1)), np.int64, int(lengths.sum()))
        doc = np.repeat(np.arange(len(words)), lengths)
        held = term >= 0
        key, tf = np.unique(doc[held] * len(self.number) + term[held], return_counts=True)
        return key // max(1, len(self.number)), key % max(1, len(self.number)), tf


def accumulate(index: Index, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, run_entries: int = RUN_ENTRIES) -> Iterator[tuple]:
    """(item, document, score) of all pairs that share a term; `doc` ascends."""
    if not len(doc):
        return
    many = index.first[term + 1] - index.first[term]
    ends = np.cumsum(many)
    edge = np.flatnonzero(np.diff(doc)) + 1  # where a document begins
    begin = 0
    while begin < len(doc):
        room = np.searchsorted(ends, (ends[begin - 1] if begin else 0) + run_entries, "right")
        fit = edge[(edge > begin) & (edge <= room)] if room < len(doc) else [len(doc)]
        after = edge[edge > begin]
        stop = int(fit[-1]) if len(fit) else int(after[0]) if len(after) else len(doc)
        n = many[begin:stop]
        at = np.repeat(np.arange(begin, stop), n)
        posting = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + index.first[term[at]]
        key = index.item[posting] * n_docs + doc[at]
        order = radix_argsort(key, index.n_items * n_docs)
        key, value = key[order], (index.weight[posting] * impact[at])[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        yield key[new] // n_docs, key[new] % n_docs, np.add.reduceat(value, new)
        begin = stop


class Best:
    """The `top` best documents of each item: the higher score, then the smaller id; an unknown id is the largest."""

    def __init__(self, n_items: int, top: int):
        self.top, self.heaps = top, [[] for _ in range(n_items)]
        self.least, self.least_id = np.zeros(n_items, np.int64), np.full(n_items, -1, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        better = (score > self.least[item]) | (score == self.least[item]) & known & (ids < self.least_id[item])
        for i, s, d, k in zip(item[better].tolist(), score[better].tolist(), ids[better].tolist(), known[better].tolist(), strict=True):
            heap, entry = self.heaps[i], (s, k, -d)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                s, k, d = heap[0]
                self.least[i], self.least_id[i] = s, -d if k else np.iinfo(np.int64).max

    def rows(self) -> Iterator[tuple]:
        return ((i, s, -d if k else None) for i, heap in enumerate(self.heaps) for s, k, d in heap)


def _runs(batches) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and terms of some documents at a time, bounded in number and in bytes; a longer text is alone."""
    split = splitter(digits=True)
    for batch in batches:
        for i in range(0, batch.num_rows, RUN_DOCUMENTS):
            part = batch.slice(i, RUN_DOCUMENTS)
            ids, words, size = [], [], 0
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
                text = text.as_py() or b""
                if words and size + len(text) > RUN_BYTES:
                    yield ids, words
                    ids, words, size = [], [], 0
                ids.append(doc_id), words.append(split(text))
                size += len(text)
            if words:
                yield ids, words


def _statistics(docs: DataFrame, index) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and the number of documents that hold each term of the index."""
    import pyarrow as pa

    def run(batches):
        n_docs, total, found = 0, 0, np.zeros(len(index.value.number), np.int64)
        for _, words in _runs(batches):
            n_docs += sum(map(bool, words))
            total += sum(map(len, words))
            found += np.bincount(index.value.matched(words)[1], minlength=len(found))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(found[at], [n_docs, total]))], names=["term", "n"])
        release_memory()

    counted = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}  # a row for each term of the part
    return found.pop(-1, 0), found.pop(-2, 0), found


def _ranked(docs: DataFrame, index, n_docs: int, total: int, top: int) -> DataFrame:
    """The best of each task: item (its place in the part), slot, score, doc_id."""
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        ix = index.value
        best = Best(ix.n_items, top)
        for ids, words in _runs(batches):
            doc, term, tf = ix.matched(words)
            m = np.array([75 + 25 * len(w) * n_docs // total for w in words], np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
            known = np.array([i is not None for i in ids])
            number = np.array([i or 0 for i in ids], np.int64)
            for item, at, score in accumulate(ix, doc, term, impact, len(words)):
                best.add(item, score, number[at], known[at])
        rows = list(best.rows())
        if rows:
            slot = TaskContext.get().partitionId() // SLOT_TASKS
            item, score, ids = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([item, pa.array([slot] * len(rows), pa.int64()), score, ids], names=["item", "slot", "score", "doc_id"])
        release_memory()

    found = docs.mapInArrow(run, "item long, slot long, score long, doc_id long")
    for key in (["item", "slot"], ["item"]):
        order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return found


def _parts(items: DataFrame, part_terms: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Ids and texts of the items, read one partition at a time, in parts of so many terms."""
    split, part, size = splitter(digits=True), [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).toLocalIterator():
        text = bytes(row["text"] or b"")
        n = len(split(text)) or 1
        if part and size + n > part_terms:
            yield part
            part, size = [], 0
        part.append((row["item_id"], text))
        size += n
    if part:
        yield part


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, part_terms: int = PART_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the `top` documents of the highest scores above 0."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in _parts(items, part_terms):
        index = Index([t for _, t in part])
        if not index.number:
            continue
        n_docs, total, found = _statistics(texts, spark.sparkContext.broadcast(index))
        if not total:
            continue
        index.weigh(found, n_docs)
        ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(part)], "item long, item_id long")
        best = _ranked(texts, spark.sparkContext.broadcast(index), n_docs, total, top)
        out = out.unionByName(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    return out
