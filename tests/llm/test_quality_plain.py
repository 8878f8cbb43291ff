"""The quality query's scores, recomputed line by line without arrays."""

import math
import re

from tessera.llm import quality, registry

DATA = "/root/testdata/sf0.001"
KINDS = [rb"[A-Z]", rb"[0-9]", rb"[*$#%&|<>{}\[\]=_^~@\\/]", rb"[!?]", rb"[.,;:'\"()-]", rb"[a-z\xC2-\xF4]"]


def own_features(line, repeated):
    size, words = len(line), re.findall(rb"[^\x20\x09-\x0D]+", line)
    total, n = max(size, 1), len(words)
    share = [len(re.findall(k, line)) / total for k in KINDS]
    upper, lower = (len(re.findall(KINDS[i], line)) for i in (0, 5))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n, 1)
    return [
        1.0, *share, float(upper > 0.5 * (upper + lower)), len(set(words)) / n if n else 1.0, again, float(repeated and n > 0),
        math.log1p(size) / 8, min(size / max(n, 1), 30) / 10, (share[2] > 0.03) + (again > 0.2),
    ]


def plain_score(text, model):
    lines = (text or "").encode().split(b"\n")
    said = [tuple(re.findall(rb"[^\x20\x09-\x0D]+", x)) for x in lines]
    own = [own_features(x, said.count(s) > 1) for x, s in zip(lines, said, strict=True)]
    nothing = [0.0] * len(own[0])
    potentials = []
    for i, f in enumerate(own):
        x = f + (own[i - 1] if i else nothing) + (own[i + 1] if i + 1 < len(own) else nothing)
        potentials.append(sum(t * (v - m) / s for t, v, m, s in zip(model["theta"], x, model["mean"], model["scale"], strict=True)))
    # forward and backward sums in logarithms; labels bad (0, potential 0) and good (1)
    trans, pot = model["trans"], [(0.0, u) for u in potentials]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    alpha, beta = [list(pot[0])], [[0.0, 0.0]]
    for p in pot[1:]:
        alpha.append([add(alpha[-1][0] + trans[0][y], alpha[-1][1] + trans[1][y]) + p[y] for y in (0, 1)])
    for p in reversed(pot[1:]):
        beta.append([add(trans[y][0] + p[0] + beta[-1][0], trans[y][1] + p[1] + beta[-1][1]) for y in (0, 1)])
    good = [1 / (1 + math.exp(a[0] + b[0] - a[1] - b[1])) for a, b in zip(alpha, reversed(beta), strict=True)]
    weight = [max(len(x), 1) for x in lines]
    mean = min(max(sum(g * w for g, w in zip(good, weight, strict=True)) / sum(weight), 0.002), 0.998)
    return 1 / (1 + math.exp(-model["w"][0] - model["w"][1] * math.log(mean / (1 - mean))))


def test_query_equals_plain_scores(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in registry.op1_quality(spark, DATA).collect()}
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert len(got) == len(texts)
    for doc_id, text in texts:
        want = plain_score(text, model)
        assert abs(got[doc_id]["score"] - want) < 1e-6, doc_id
        assert abs(want - 0.7) < 1e-6 or got[doc_id]["predicted"] == (want >= 0.7)


def test_odd_texts_equal_plain_scores(spark):
    model = quality.fit(*(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels")))
    texts = ["", None, "\n", "a\n\n\na\nb b b b", "É ß 😀\r\n\x0b x", "AAA " * 3000, "same line\n" * 50, "$$$ ### !!!"]
    for text, s in zip(texts, quality.score(texts, model), strict=True):
        assert abs(s - plain_score(text, model)) < 1e-6, text


def test_label_rule(spark):
    """Good if any label says so; contradicting labels make a good document, unknown ones nothing."""
    docs = spark.createDataFrame([(i, ("clean line of words here\n" * 3) if i % 2 else ("$$ ## BUY!!! BUY!!!\n" * 3)) for i in range(40)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(40)] + [(2, 1), (3, 0), (4, 7), (5, None), (None, 1)]
    one = quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    two = quality.fit(docs, spark.createDataFrame([(i, 1 if i == 2 else i % 2) for i in range(40)], "doc_id long, quality int"))
    assert all((one[k] == two[k]).all() for k in one)
