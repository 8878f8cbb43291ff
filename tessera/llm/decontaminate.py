"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every document is searched for the n-grams of all test items, and each n-gram is
a seed, so a copied stretch of NGRAM words is enough however often the item
was copied. Passages around seeds are aligned with the item; a
document is contaminated by an item if the words of the item that match reach
`coverage` of its words. A copy without NGRAM words in a row left intact has no seed
and is not found.

The index of test items is sent to all executors only up to MAX_ITEM_WORDS
words; beyond that the items are taken in parts of that size, one after another.

Null texts hold nothing. An item of fewer than NGRAM words is a single shorter n-gram,
so only exact copies of it are found. Items without words are ignored. Repeated rows of documents or
items are rows of their own. A null doc_id or item_id stays null. Empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.align import smith_waterman
from tessera.llm.textgrid import Words, chunks, slices

NGRAM = 4
COVERAGE = 0.6
MAX_ITEM_WORDS = 2_000_000
FOUND = "doc_id long, item_id long, score double, start long, end long"


def _index(items: list[tuple[int, str]]):
    """Per item its words' hashes; by n-gram size sorted n-gram hashes with item and place."""
    w = Words([t for _, t in items], fold=True)
    words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(items))]
    lengths = np.array([len(x) for x in words], np.int64)
    grams = {}
    for size in range(1, NGRAM + 1):
        at, h = w.windows(size)
        item = w.text[at]
        mine = np.minimum(lengths[item], NGRAM) == size
        at, h, item = at[mine], h[mine], item[mine]
        if len(h):
            order = np.argsort(h, kind="stable")
            grams[size] = h[order], item[order].astype(np.int64), (at - w.first[item])[order].astype(np.int64)
    return words, grams


def _parts(items: DataFrame):
    rows = items.filter("text is not null").select("item_id", "text", F.size(F.split("text", r"\s+")).alias("k"))
    total = rows.agg(F.sum("k")).first()[0] or 0
    n = max(1, -(-total // MAX_ITEM_WORDS))
    for part in range(n):
        chosen = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part)
        yield sorted(((r["item_id"], r["text"]) for r in chosen.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, score (share of the item's words), start and end (words of the document)."""
    out = None
    for part in _parts(items):
        found = _search(docs, part, coverage)
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of `docs`, with all their columns, whose own text holds no item; rows are judged one by one, whatever their ids."""
    for part in _parts(items):
        docs = _search(docs, part, coverage, remove=True)
    return docs


def _search(docs: DataFrame, items: list[tuple[int, str]], coverage: float, remove: bool = False) -> DataFrame:
    """FOUND rows; with `remove`, the rows of `docs` without any."""
    import pyarrow as pa

    spark = docs.sparkSession
    words, grams = _index(items)
    if not grams:
        return docs if remove else spark.createDataFrame([], FOUND)
    shared = spark.sparkContext.broadcast((words, grams, [i for i, _ in items]))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def find(batches):
        words, grams, item_ids = shared.value
        lengths = np.array([len(x) for x in words], np.int64)
        sized = []
        for size, (gram_hash, gram_item, gram_place) in grams.items():
            distinct = np.unique(gram_hash)
            small = np.zeros(1 << 20, bool)
            small[distinct >> np.uint64(44)] = True
            sized.append((size, gram_hash, gram_item, gram_place, distinct, small))
        for batch in slices(batches):
            ids, texts = range(batch.num_rows) if remove else batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            held = np.zeros(batch.num_rows, bool)
            for a, b in chunks(texts):
                w = Words(texts[a:b], fold=True)
                rows, hits = [], []
                for size, gram_hash, gram_item, gram_place, distinct, small in sized:
                    at, h = w.windows(size)
                    likely = np.flatnonzero(small[h >> np.uint64(44)])
                    k = np.minimum(np.searchsorted(distinct, h[likely]), len(distinct) - 1)
                    real = distinct[k] == h[likely]
                    pos, gram = at[likely[real]], distinct[k[real]]
                    low, high = np.searchsorted(gram_hash, gram, "left"), np.searchsorted(gram_hash, gram, "right")
                    many = high - low
                    entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                    hits.append(np.stack([np.repeat(w.text[pos], many).astype(np.int64), gram_item[entry], np.repeat(pos, many), np.repeat(pos, many) - gram_place[entry]]))
                doc, item, pos, first = x = np.concatenate(hits, axis=1)
                doc, item, pos, first = x[:, np.lexsort((pos, item, doc))]
                # hits of one item in one text, no further apart than the item is long
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > lengths[item[1:]])]) if len(doc) else np.zeros(0, int)
                least, most = (np.minimum.reduceat(first, new), np.maximum.reduceat(first, new)) if len(new) else (new, new)
                for d, it, p0, p1 in zip(doc[new].tolist(), item[new].tolist(), least.tolist(), most.tolist(), strict=True):
                    m = int(lengths[it])
                    begin, end = max(int(w.first[d]), p0 - m // 4 - 2), min(int(w.first[d + 1]), p1 + m + m // 4 + 2)
                    own, region = words[it], w.hash[begin:end]
                    if np.isin(own, region).sum() < coverage * m:  # no alignment matches more words
                        continue
                    _, matched, _, _, s, e = smith_waterman(own, region)
                    if matched >= coverage * m:
                        at_doc = begin - int(w.first[d])
                        rows.append((ids[a + d], item_ids[it], matched / m, at_doc + s, at_doc + e))
                if remove:
                    held[[r[0] for r in rows]] = True
                elif rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

            if remove:
                yield batch.filter(pa.array(~held))

    return docs.mapInArrow(find, docs.schema) if remove else docs.select("doc_id", "text").mapInArrow(find, FOUND)
