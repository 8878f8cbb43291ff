"""Best-fit packing, ranked search and the divergence audit against brute force."""

import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bestfit, divergence, ranking, registry
from tessera.llm.tokens import vocabulary_path

DATA = "/root/testdata/sf0.001"
BYTE = vocabulary_path("byte_bpe_50k.json")


@functools.cache
def tokenizer():
    return Tokenizer.from_file(BYTE)


def least_bins(lengths, size):
    """The optimum by search over all placements."""
    best = len(lengths)
    order = sorted(lengths, reverse=True)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(order):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= order[i]}:
            rest = list(rooms)
            rest[rest.index(room)] -= order[i]
            place(i + 1, rest)
        place(i + 1, [*rooms, size - order[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_bound_and_best_fit_against_all_placements(seed):
    rng = random.Random(seed)
    certified = 0
    for _ in range(60):
        size = rng.choice([10, 12, 30, 64])
        lengths = [rng.randint(*rng.choice([(1, size), (size // 4, size // 2 + 1), (size // 2, size)])) for _ in range(rng.randint(1, 8))]
        bound, best = bestfit.lower_bound(np.bincount(lengths, minlength=size + 1), size), least_bins(lengths, size)
        bins = bestfit.best_fit(lengths, size)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= size for b in bins)
        assert bound <= best <= len(bins)
        certified += bound == len(bins)
    assert certified > 40


def test_bound_is_above_the_sum_of_lengths():
    """Pieces just over a half or a third go one or two to a sequence, which lengths alone don't show."""
    for length, n, least in ((1025, 10, 10), (683, 10, 5), (700, 7, 4)):
        count = np.bincount([length] * n, minlength=2049)
        assert bestfit.lower_bound(count) == least > -(-length * n // 2048)


def plain_best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if sum(b) + n <= size]
        if fit:
            max(fit, key=sum).append(n)
        else:
            bins.append([n])
    return len(bins)


def test_best_fit_equals_plain_best_fit():
    rng = random.Random(9)
    for _ in range(20):
        lengths = [rng.randint(1, 900) for _ in range(200)]
        assert len(bestfit.best_fit(lengths, 1000)) == plain_best_fit(lengths, 1000)


def check_bestfit(rows, docs, size=2048):
    """Gapless sequences; each document's pieces hold its ids, and only long documents are cut, the first piece being the short one."""
    at, pieces = defaultdict(list), Counter()
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    for v in at.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(v[-1]) <= size
    want = Counter()
    for i, t in docs:
        ids = np.array([*tokenizer().encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % size or size
        cut = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert pieces == want
    return len(at)


def test_bestfit_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = registry.op11_bestfit(spark, DATA).collect()
    n = check_bestfit(rows, docs)
    rest = [r["length"] for r in rows if r["length"] < 2048]
    assert n == len(rows) - len(rest) + bestfit.lower_bound(np.bincount(rest, minlength=2049))


@pytest.mark.parametrize("size", [64, 2048])
def test_bestfit_exchange_of_many_groups(spark, odd_docs, size):
    """Groups of 30 sequences: their gaps meet in later rounds, so the total stays near the bound."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for i in range(600)], "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    rows = bestfit.pack_documents(docs.repartition(7), BYTE, size=size, group_tokens=30 * size).collect()
    n = check_bestfit(rows, [tuple(r) for r in docs.collect()], size)
    rest = [r["length"] for r in rows if r["length"] < size]
    bound = len(rows) - len(rest) + bestfit.lower_bound(np.bincount(rest, minlength=size + 1), size)
    step = 30 * size * len(rest) // sum(rest)  # pieces of a group
    alone = sum(len(bestfit.best_fit(rest[i : i + step], size)) for i in range(0, len(rest), step)) + len(rows) - len(rest)
    assert bound <= n <= bound + 0.03 * len(rest) and n <= alone


def test_bestfit_of_one_repeated_row_and_no_rows(spark):
    many = spark.createDataFrame([(None, "a b c")] * 3000, "doc_id long, text string")
    rows = bestfit.pack_documents(many, BYTE, group_tokens=4096).collect()
    assert check_bestfit(rows, [(None, "a b c")] * 3000) == -(-3000 * rows[0]["length"] // (2048 // rows[0]["length"] * rows[0]["length"]))
    assert bestfit.pack_documents(many.limit(0), BYTE).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(pattern, t):
    return pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_ranks(docs, items, top=20):
    words = [lowered(TERM, t) for _, t in docs]
    n_docs, total = sum(map(bool, words)), sum(map(len, words))
    df = Counter(w for ws in words for w in set(ws))
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), ws in zip(docs, words, strict=True):
            tf = Counter(ws)
            m = 100 - 25 + 25 * len(ws) * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m)) for w in lowered(TERM, text) if tf[w])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(scored[:top])]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("part_terms", [ranking.PART_TERMS, 10])
def test_ranking_equals_brute_force(spark, monkeypatch, part_terms):
    monkeypatch.setattr(ranking, "RUN_DOCUMENTS", 7)
    rng = random.Random(4)
    stock = ["Über", "9a", "naïve", "the", "THE", "a_b", "x", "é", "42", "z-z"]
    docs = [(i, " ".join(rng.choices(stock, k=rng.randint(0, 30)))) for i in range(120)]
    docs += [(200 + i, docs[3][1]) for i in range(40)] + [(None, docs[5][1]), (None, None), (7, "the the"), (7, "the the"), (300, ""), (301, "\t\n"), (302, "the " * 20000)]
    items = [(1, "the über x"), (2, "THE the the 42"), (3, None), (4, "nowhere"), (5, "..."), (1, "z é"), (None, "9A naïve")]
    frames = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(5), spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in ranking.rank(*frames, part_terms=part_terms).collect()]
    assert sorted(got, key=key) == sorted(brute_ranks(docs, items), key=key)
    assert ranking.rank(frames[0].limit(0), frames[1]).count() == ranking.rank(frames[0], frames[1].limit(0)).count() == 0


def test_accumulate_in_runs():
    index = ranking.Index([b"a b b c", b"b d", b"", b"a"])
    index.weigh({0: 3, 1: 2}, 10)
    words = [[b"a", b"b", b"a"], [b"x"], [b"d", b"c"], [b"b"] * 5]
    doc, term, tf = index.matched(words)
    impact = tf * 10
    want = Counter()
    for d, t, i in zip(doc.tolist(), term.tolist(), impact.tolist(), strict=True):
        for p in range(index.first[t], index.first[t + 1]):
            want[int(index.item[p]), d] += int(index.weight[p]) * i
    for entries in (1, 2, 3, 100):
        got = Counter()
        for item, d, s in ranking.accumulate(index, doc, term, impact, len(words), entries):
            assert len(set(zip(item.tolist(), d.tolist(), strict=True))) == len(item)
            got.update(dict(zip(zip(item.tolist(), d.tolist(), strict=True), s.tolist(), strict=True)))
        assert got == want


def test_radix_order_is_stable():
    rng = np.random.default_rng(0)
    for bound in (1, 2, 65536, 65537, 1 << 40):
        keys = rng.integers(0, bound, 5000)
        keys[1000:3000] = keys[:2000]
        assert (ranking.radix_argsort(keys, bound) == np.argsort(keys, kind="stable")).all()


def brute_audit(docs, least=3, top=200):
    docs = [(lang or "", source or "", lowered(LETTERS, t)) for lang, source, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in df.items() if n >= least)
        count = {s: Counter(w for d in own if d[1] == s for w in d[2]) for s in {d[1] for d in own}}
        everywhere = Counter(w for d in own for w in d[2])

        def shares(c, kept=kept):
            n = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // (n + len(kept)) for w in kept}

        q = shares(everywhere)
        p = {s: shares(c) for s, c in count.items()}
        f = lambda x, y: (x - y) * (x - y) // y
        for s in p:
            pair = [(s2, sum(f(p[s][w], p[s2][w]) for w in kept)) for s2 in p if s2 != s]
            term = [(w, f(p[s][w], q[w])) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, rows, most in (("pair", pair, len(pair)), ("term", term, top)):
                rows.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(rows[:most])]
    return sorted(out)


@pytest.mark.parametrize("held_terms", [divergence.HELD_TERMS, 3])
def test_audit_equals_brute_force(spark, held_terms):
    rng = random.Random(6)
    stock = ["der", "Die", "straße", "é", "ÄÖ", "", "😀", "a1b", "DER"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(rng.choice(["de", "en", None]), rng.choice(["s1", "s2", "S2", "", None, "ü"]), " ".join(rng.choices(stock, k=rng.randint(0, 40)))) for _ in range(200)]
    docs += [("fr", "s1", None), ("fr", "s2", ""), ("it", "s1", "uno due"), ("es", "s1", "si si"), ("es", "s2", "si"), ("es", "s3", "si"), ("es", "s4", "3 4"), ("es", "s3", "si " * 5000), *[("pt", "s1", "eco eco eu")] * 4]
    frame = spark.createDataFrame([(i, *d, 1, 2) for i, d in enumerate(docs)], "doc_id long, lang string, source string, text string, rank int, n int").repartition(4)
    got = divergence.audit(frame, held_terms=held_terms)
    assert got.columns == list(divergence.OUT)
    assert sorted(map(tuple, got.collect())) == brute_audit(docs)


def test_audit_without_broadcast_and_of_no_rows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SMALL_GROUPS", 0)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(80)
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string")).collect())) == brute_audit(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_long_division_equals_whole_numbers(spark):
    rows = [(c, t, v) for c in (0, 1, 7, 10**12, 9 * 10**14) for t in (0, 5, 10**12, 10**15) for v in (0, 1, 123, 10**9) if c <= t]
    got = spark.createDataFrame(rows, "c long, t long, v long").select("c", "t", "v", divergence.share(F.col("c"), F.col("t"), F.col("v"))).collect()
    for c, t, v, s in got:
        assert s == (1 + 10**9 * (c + 1) // (t + v) if t + v else None)
