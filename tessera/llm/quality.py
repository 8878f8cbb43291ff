"""Line quality by a linear-chain conditional random field, added up to a document's score.

Each line has features of its bytes and words and of the lines before and after
it; labels good and bad are chained. A line's marginal comes from the
forward-backward recursions, and a document's score is the mean marginal of
good, weighted by the lines' lengths. Training is by gradient ascent on the
conditional likelihood of a bounded sample of labelled documents (MAX_DOCS, the
first by a hash of the id): all lines of a good document are good; lines of a
bad one begin as bad and are then re-labelled by the model, the worst line
staying bad, as a bad document may hold good lines. A last logistic step maps the mean
of a document to its score.

Null and empty texts are one empty line and get its score. Without training
rows of both labels every score is 0.5. Null labels are ignored; repeated rows
of labels count once. A null doc_id is never in the held-out part. Empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.sampling import texts_of
from tessera.llm.textgrid import Words, chunks, release_memory

MAX_DOCS = 3000
THRESHOLD = 0.7
ROUNDS = 3
STEPS = 150
N_OWN = 14
ROWS = 500

_KIND = np.zeros((256, 6))
_KIND[ord("A") : ord("Z") + 1, 0] = 1
_KIND[ord("0") : ord("9") + 1, 1] = 1
_KIND[[ord(c) for c in "*$#%&|<>{}[]=_^~@\\/"], 2] = 1
_KIND[[ord(c) for c in "!?"], 3] = 1
_KIND[[ord(c) for c in ".,;:'\"()-"], 4] = 1
_KIND[ord("a") : ord("z") + 1, 5] = 1
_KIND[0xC2:0xF5, 5] = 1


def features(texts: list[str | None]):
    """Lines of the texts: (first line of each text, weight of each line, matrix)."""
    w = Words(texts)
    raw = np.frombuffer(w.data + b"\n", np.uint8)
    stop = np.flatnonzero(raw == 10)
    start = np.r_[0, stop[:-1] + 1]
    size = stop - start
    sizes = np.cumsum([0, *(len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts)])
    first = np.searchsorted(start, sizes)
    n = len(start)
    counts = np.zeros((n, 6))
    for k in range(6):
        counts[:, k] = np.add.reduceat(_KIND[:, k].astype(np.float32)[raw], start, dtype=np.float64)
    line = np.searchsorted(start, w.start, side="right") - 1
    words = np.bincount(line, minlength=n).astype(float)
    order = np.lexsort((w.hash, line))
    h, of = w.hash[order], line[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if len(h) else np.zeros(0, bool)
    distinct = np.bincount(of[new], minlength=n)
    again = np.bincount(line[1:][(w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])], minlength=n)
    # share of a document's words that are distinct, and of lines that repeat
    text_of_line = np.repeat(np.arange(len(texts)), np.diff(first))
    with np.errstate(over="ignore"):
        line_hash = np.zeros(n, np.uint64)
        np.add.at(line_hash, line, w.hash * (np.arange(len(w.hash), dtype=np.uint64) - np.searchsorted(line, line).astype(np.uint64) + np.uint64(1)))
    o = np.lexsort((line_hash, text_of_line))
    same = np.zeros(n, bool)
    eq = (line_hash[o][1:] == line_hash[o][:-1]) & (text_of_line[o][1:] == text_of_line[o][:-1])
    same[o[1:][eq]] = True
    same[o[:-1][eq]] = True
    total = np.maximum(size, 1)
    own = np.zeros((n, N_OWN))
    own[:, 0] = 1
    own[:, 1:7] = counts / total[:, None]
    own[:, 7] = counts[:, 0] > 0.5 * (counts[:, 0] + counts[:, 5])
    own[:, 8] = np.where(words > 0, distinct / np.maximum(words, 1), 1)
    own[:, 9] = again / np.maximum(words, 1)
    own[:, 10] = same & (words > 0)
    own[:, 11] = np.log1p(size) / 8
    own[:, 12] = np.minimum(size / np.maximum(words, 1), 30) / 10
    own[:, 13] = (own[:, 3] > 0.03) + (own[:, 9] > 0.2)
    begins = np.zeros(n, bool)
    begins[first[:-1]] = True
    ends = np.r_[begins[1:], True]
    x = np.zeros((n, 3 * N_OWN), np.float64)
    x[:, :N_OWN] = own
    x[1:, N_OWN : 2 * N_OWN][~begins[1:]] = own[:-1][~begins[1:]]
    x[:-1, 2 * N_OWN :][~ends[:-1]] = own[1:][~ends[:-1]]
    return first, total.astype(float), x


def marginals(u: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected transitions; u: log-odds potentials of good, trans: 2 x 2 log potentials."""
    n, t = len(u), np.exp(trans)
    pot = np.exp(np.c_[np.minimum(0, -u), np.minimum(0, u)])  # bad, good, scaled by the larger
    lengths = np.diff(first)
    alpha, beta = np.ones((n, 2)), np.ones((n, 2))
    by = np.argsort(-lengths, kind="stable")
    sizes = -lengths[by]
    for k in range(int(lengths.max(initial=0))):
        i = first[by[: np.searchsorted(sizes, -k, side="left")]] + k
        a = pot[i] if k == 0 else (alpha[i - 1] @ t) * pot[i]
        alpha[i] = a / a.sum(axis=1, keepdims=True)
        j = first[1:][by[: np.searchsorted(sizes, -k, side="left")]] - 1 - k
        if k:
            b = (beta[j + 1] * pot[j + 1]) @ t.T
            beta[j] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    e = alpha[j - 1][:, :, None] * t[None] * (pot[j] * beta[j])[:, None, :]
    e /= e.sum(axis=(1, 2), keepdims=True)
    return p[:, 1], e.sum(axis=0)


def _ascend(x, first, y, weight, theta, trans):
    """Adam on the weighted likelihood of line labels y (0 to 1)."""
    n = len(first) - 1
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    want = np.array([[((1 - y[j - 1]) * (1 - y[j])).sum(), ((1 - y[j - 1]) * y[j]).sum()], [(y[j - 1] * (1 - y[j])).sum(), (y[j - 1] * y[j]).sum()]])
    m, v, params = 0.0, 0.0, np.r_[theta, trans.ravel()]
    for step in range(1, STEPS + 1):
        p, e = marginals(x @ params[:-4], first, params[-4:].reshape(2, 2))
        g = np.r_[x.T @ (y - p), (want - e).ravel()] / n - 0.002 * params
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params + 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        params[-4:] = np.clip(params[-4:], -3, 3)
    return params[:-4], params[-4:].reshape(2, 2)


def _document(p, weight, first):
    """The weighted mean of each document, and (1, its logit)."""
    total = np.add.reduceat(weight, first[:-1])
    mean = np.add.reduceat(p * weight, first[:-1]) / total
    clipped = np.clip(mean, 0.002, 0.998)
    return mean, np.c_[np.ones(len(mean)), np.log(clipped / (1 - clipped))]


def train(texts: list[str | None], labels: np.ndarray) -> dict | None:
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return None
    parts = [features(texts[a:b]) for a, b in chunks(texts)]
    edge = np.cumsum([0, *(len(p[1]) for p in parts)])
    first = np.concatenate([*(p[0][:-1] + e for p, e in zip(parts, edge, strict=False)), edge[-1:]])
    weight, x = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[0], scale[0] = 0, 1
    z = (x - mean) / scale
    of = np.repeat(np.arange(len(labels)), np.diff(first))
    y = labels[of]
    theta, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    for _ in range(ROUNDS):
        theta, trans = _ascend(z, first, y, weight, theta, trans)
        p, _ = marginals(z @ theta, first, trans)
        worst = np.minimum.reduceat(p, first[:-1])[of]
        y = np.where(labels[of] == 1, 1.0, np.where(p <= worst + 1e-9, 0.0, np.where(p > 0.6, 1.0, 0.0)))
    p, _ = marginals(z @ theta, first, trans)
    _, d = _document(p, weight, first)
    w = np.array([0.0, 1.0])
    for _ in range(400):
        q = 1 / (1 + np.exp(-d @ w))
        w = w + 0.5 * d.T @ (labels - q) / len(q) / 4 - 1e-5 * w
    return {"theta": theta, "trans": trans, "mean": mean, "scale": scale, "w": w}


def score(texts: list[str | None], model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    out = []
    for a, b in chunks(texts):
        first, weight, x = features(texts[a:b])
        p, _ = marginals(((x - model["mean"]) / model["scale"]) @ model["theta"], first, model["trans"])
        _, d = _document(p, weight, first)
        out.append(1 / (1 + np.exp(-d @ model["w"])))
    return np.concatenate(out) if out else np.zeros(0)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> dict | None:
    """The model of a bounded sample of the labelled rows outside the held-out part: `max_docs` texts and sampling.MAX_BYTES bytes at most.

    A document is good if any of its labels says so; labels other than 0 and 1 count for nothing. Rows that
    share a labelled id are examples of their own, equal ones once.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    sample = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = sorted(((text, y) for _, text, y in texts_of(docs, sample, max_docs)), key=lambda r: (r[0] or "", r[1]))
    if not rows:
        return None
    return train([t for t, _ in rows], np.array([y for _, y in rows]))


def add_score(docs: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """All columns of `docs` with the score under `name`; a column of that name is replaced."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):  # so few texts in memory as strings at a time
                part = batch.slice(i, ROWS)
                yield part.append_column(name, pa.array(score(part["text"].to_pylist(), model), pa.float64()))
        release_memory()

    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)
