import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import decontaminate, jaccard, licenses, neighbours, packing, pii, quality, registry, revisits, substring, tokenfile
from tessera.llm.align import smith_waterman
from tessera.llm.components import components
from tessera.llm.tokens import encoder, vocabulary_path

DATA = "/root/testdata/sf0.001"
BYTE, WORD = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")


def made_up(n=60, vocabulary=30, seed=5):
    rng = random.Random(seed)
    stock = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(10, 60))) for _ in range(8)]
    out = []
    for i in range(n):
        words = " ".join(rng.choices(stock, k=rng.randint(1, 3))).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(vocabulary)}"
        out.append((i, " ".join(words)))
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_repeats(rows):
    first = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])].add(i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if min(first[tuple(w[k : k + 13])]) < i:
                gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root(k)].append(i)
    return sorted((i, len(sets[k]), min(least[root(k)])) for k, (i, _) in enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_equals_brute_force(spark, seed):
    rows = made_up(seed=seed)
    assert sorted(map(tuple, substring.remove_repeats(frame(spark, rows)).collect())) == brute_repeats(rows)


@pytest.mark.parametrize("block_chars", [substring.BLOCK_CHARS, 700])
def test_substring_over_two_levels(spark, monkeypatch, block_chars):
    """More blocks than a group may send rows: the same results."""
    monkeypatch.setattr(substring, "BLOCK_CHARS", block_chars)
    rows = [*made_up(seed=8), *((100 + i, " ".join(f"common{k}" for k in range(20))) for i in range(40)), (None, " ".join(f"common{k}" for k in range(20)))]
    got = sorted(map(tuple, substring.remove_repeats(frame(spark, rows), fan_out=5).collect()), key=str)
    assert got == sorted(map(tuple, substring.remove_repeats(frame(spark, rows)).collect()), key=str)
    assert sorted(r for r in got if r[0] is not None) == brute_repeats(rows[:-1])
    assert substring.remove_repeats(frame(spark, []), fan_out=5).count() == 0


def test_jaccard_equals_brute_force(spark):
    rows = [(i, t.upper() if i % 7 == 0 else t) for i, t in made_up(n=120, seed=3)] + [(200 + i, "a b c d") for i in range(3)] + [(300, "")]
    assert sorted(map(tuple, jaccard.near_duplicates(frame(spark, rows)).collect())) == brute_classes(rows)


def test_null_and_largest_ids(spark):
    """A null doc_id is not the largest int64, and rows without id are told apart."""
    last, text = (1 << 63) - 1, " ".join(f"k{i}" for i in range(40))
    rows = [(None, text), (last, text), (None, text + " end"), (None, "other words " * 20), (None, text), (last, "a b")]
    got = sorted((tuple(r) for r in jaccard.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 36, last), (last, 36, last), (None, 37, last), (None, 2, None), (None, 36, last), (last, 1, last)], key=str)
    assert jaccard.near_duplicates(frame(spark, [(None, text), (None, text + " end")])).filter("component_id is null").count() == 2
    out = [tuple(r) for r in substring.remove_repeats(frame(spark, [*rows, (5, text)])).collect()]
    assert sorted(r[:3] for r in out if r[0] is not None) == [(5, 40, 0), (last, 2, 0), (last, 40, 40)]
    assert sorted(r[1:3] for r in out if r[0] is None) == [(40, 0), (40, 40), (40, 40), (41, 40)]


def test_jaccard_large_buckets(spark):
    rng = random.Random(1)
    base = [f"u{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(80):  # a chain: neighbours are near, the ends are not
        w = list(base)
        for k in range(i):
            w[(k * 37) % 150] = f"z{k}"
        rows.append((i, " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(100 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(30 + i % 40))) for i in range(60)]
    assert sorted(map(tuple, jaccard.near_duplicates(frame(spark, rows)).collect())) == brute_classes(rows)


def test_pieces_hold_the_bound():
    rng = np.random.default_rng(3)
    for n in [*range(1, 70), 85, 128, 300, 1000, 5000]:
        s = np.unique(rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
        assert len(jaccard.piece_keys(s, jaccard.band(n))) > 2 * n // 7


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 1), (20, 21), (21, 22), (30, 31)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {9: 1, 8: 1, 7: 1, 1: 1, 20: 20, 21: 20, 22: 20, 30: 30, 31: 30}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    chain = components(spark.createDataFrame([(i, i + 1) for i in range(1, 300)], "u long, v long")).collect()
    assert len(chain) == 300 and {r["component"] for r in chain} == {1}


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[100:160] = x[40]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(40, x[40].tolist(), 2), (2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0, None] * 8, 1), (None, x[0].tolist(), 1)]
    rows += [(3000, [1.0, 2.0], 1), (3001, [3.0, 4.0], 1)]  # of another width
    got = defaultdict(list)
    frame = spark.createDataFrame([(i, v, k, k, k, k) for i, v, k in rows], "vec_id long, embedding array<float>, v int, cell int, chunk int, place int")
    for r in neighbours.nearest(frame, chunk_bytes=300 * 16 * 8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got.pop(3000) == [(3001, 11.0)]
    y, hit = x.astype(float), 0
    for q in range(0, 900, 20):
        s = np.zeros(900)
        for d in range(16):
            s += y[:, d] * y[q, d]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        hit += len(set(best) & {i for i, _ in got[q]})
        assert all(s[i] == v for i, v in got[q]) and [i for i, _ in got[q]] == [i for i, _ in sorted(got[q], key=lambda p: (-p[1], p[0]))]
        if q in range(100, 160) or q == 40:  # equal vectors are all found, the smallest ids first
            assert [i for i, _ in got[q]] == best.tolist()
    assert len(got) == 45 and hit >= 0.9 * 45 * 20
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).count() == 1
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_query_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids, hit = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy(), 0
    got = registry.op7_neighbours(spark, "/root/testdata/sf0.1").toPandas().groupby("query_id")["vec_id"].apply(set)
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & got[ids[q]])
    assert len(got) == (ids % 20 == 0).sum() and hit >= 0.9 * 20 * len(got)


def test_neighbours_stop_prunes_rows_that_differ_little():
    """Random unit vectors are the hardest: with a tree of few cells, rows must be ruled out one by one."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((8192, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    space, ids, q = neighbours.Space(64, 1.0), np.arange(8192), v[:256]
    limit = neighbours.chi_square_quantile(neighbours.CONFIDENCE, neighbours.PROJECTIONS)
    at, found, score, verified = neighbours.search_chunk(space, ids, v, ids[:256], q, np.full(256, -np.inf), 21, limit)
    best = np.argsort(-(q @ v.T), axis=1, kind="stable")[:, :21]
    assert verified < 0.5 * 256 * 8192
    assert sum(len(set(found[at == i]) & set(best[i])) for i in range(256)) >= 0.9 * 256 * 21


def test_cells_hold_their_points():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 3, (500, 4)).astype(float)  # with many ties
    tree = neighbours.Cells(points, 16)
    of = tree.of(points)
    assert len(np.unique(of)) == 16 and np.bincount(of).max() < 200
    assert len(np.unique(neighbours.Cells(np.ones((50, 4)), 8).of(points))) == 1


@functools.cache
def plain_tokenizer(path):
    return Tokenizer.from_file(path)


def reference_ids(path, text):
    t = plain_tokenizer(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


SPECIAL = "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|> |endoftext|> <|endoftext|><|endoftext|>"


def test_token_files_round_trip(spark, odd_docs):
    largest = (1 << 63) - 1
    docs = frame(spark, [*made_up(30), (500, SPECIAL), (501, "many rows of one id"), (501, "another"), (largest, "the largest id"), (-3, "a negative id")]).unionByName(odd_docs.select("doc_id", "text"))
    got = tokenfile.encode_documents(docs, WORD, shard_chars=2000).orderBy("start").collect()
    rows = docs.collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)) == [(g["doc_id"] is None, g["doc_id"] or 0) for g in got]
    crc = lambda i, t: (i, len(reference_ids(WORD, t)), zlib.crc32(np.array(reference_ids(WORD, t), "<u4").tobytes()))
    assert Counter(crc(r["doc_id"], r["text"]) for r in rows) == Counter((g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got)
    at = 0
    for g in got:
        assert g["start"] == at
        at += g["n_tokens"]


def test_token_file_query_equals_tokenizer(spark):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, []
    for i, t in docs:
        ids = reference_ids(WORD, t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, registry.op9_token_files(spark, DATA).collect())) == want


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_bit_packing_and_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_001, dtype=np.uint64).astype("<u4")
    cut = [0, 0, 5, 4096, 9000, 10_001]
    shard = tokenfile.Shard(tokenfile.encode_shard(list(range(5)), [ids[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], bits))
    for i in range(5):
        assert (shard.document(i) == ids[cut[i] : cut[i + 1]]).all()
    assert len(shard.data) < 10_001 * bits / 8 + 200


def test_memo_equals_tokenizer():
    for path in (BYTE, WORD):
        e = encoder(path)
        for t in ["a   b \n c\n\n d  e\t f", "  x ", "", "\n", "a\x1c b", "don't  stop's it's.", " ", "é ́x 　 y", "<|endoftext|> a", SPECIAL, "a\0b c", "😀 ß. A,b"]:
            assert np.frombuffer(e.ids([t])[0], "<u4").tolist() == reference_ids(path, t)[:-1]


def check_packing(rows, docs):
    """Gapless sequences of at most 2048; each document's pieces, and those of rows of one id together, hold its ids."""
    at, crcs = defaultdict(list), defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
        crcs[r["doc_id"]].append((r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]))
    for v in at.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(v[-1]) <= 2048
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(reference_ids(BYTE, t))
    assert texts.keys() == crcs.keys()
    for i, many in texts.items():
        cut = sorted({(n, s + k) for n, s, k, _ in crcs[i]} | {(n, s) for n, s, *_ in crcs[i]})
        assert sum(k for _, _, k, _ in crcs[i]) == sum(map(len, many))
        for ids in many:
            edge = [s for n, s in cut if n == len(ids)]
            assert edge[0] == 0 and edge[-1] == len(ids)
        possible = Counter()
        for ids in many:
            for n, s, k, c in set(crcs[i]):
                if n == len(ids) and zlib.crc32(np.array(ids[s : s + k], "<u4").tobytes()) == c:
                    possible[n, s, k, c] += 1
        assert all(possible[x] >= 1 for x in crcs[i])


def test_packing(spark, odd_docs):
    docs = frame(spark, [*made_up(300), (400, SPECIAL)]).unionByName(odd_docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    rows = packing.pack_documents(docs, BYTE, group_chars=20_000).collect()
    check_packing(rows, [tuple(r) for r in docs.collect()])


def test_packing_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = registry.op3_packing(spark, DATA).collect()
    check_packing(rows, docs)
    used = sum(r["length"] for r in rows)
    sequences = defaultdict(int)
    for r in rows:
        sequences[r["sequence_id"]] += r["length"]
    tasks = len({s >> 32 for s in sequences})
    assert sum(2048 - n for n in sequences.values()) <= 2048 * tasks and used == sum(sequences.values())


def test_first_fit_and_padding():
    rng = random.Random(4)
    lengths = [rng.randint(1, 700) for _ in range(500)]
    seqs = packing.pack(lengths, 1000)
    assert sum(n for s in seqs for *_, n in s) == sum(lengths) and len(seqs) == -(-sum(lengths) // 1000)
    tree = packing.Tournament(5, 10)
    bins = []
    for need in (6, 6, 4, 3, 5):
        b = tree.first_fit(need)
        tree.take(b, need)
        bins.append(b)
    assert bins == [0, 1, 0, 1, 2]


def test_quality_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = registry.op1_quality(spark, data).join(labels, "doc_id").filter("held_out").collect()
    assert rows and sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    assert docs.count() == registry.op1_quality(spark, data).count()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    u, trans, first = rng.normal(size=5), rng.normal(size=(2, 2)), np.array([0, 1, 5])
    p, e = quality.marginals(u, first, trans)
    total, good = 0.0, np.zeros(4)
    for k in range(16):
        y = [k >> j & 1 for j in range(4)]
        w = np.exp(sum(u[1 + j] * y[j] for j in range(4)) + sum(trans[y[j], y[j + 1]] for j in range(3)))
        total += w
        good += w * np.array(y)
    assert np.allclose(p[1:], good / total) and np.allclose(p[0], 1 / (1 + np.exp(-u[0]))) and np.isclose(e.sum(), 3)


def test_pii_base_spans(spark):
    text = "a.b@c.de, x@y z@w.org. 1.2.3.4 1.2.3.400; 4111 1111 1111 1111; +49 (170) 123-4567 +1 2 a@b@c.d; 5500-0000-0000-0004; 999.1.1.1.1"
    want = [("email", m.start(), m.end()) for m in pii.EMAIL.finditer(text)]
    want += [("ip", m.start(), m.end()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    want += [("card", m.start(), m.end()) for m in pii.CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    want += [("phone", m.start(), m.end()) for m in pii.PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == want and len({k for k, *_ in want}) == 4


def plain_base(text):
    """The contract's base spans, with the regular expressions alone."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits(m)))) % 10 == 0),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (r, ok) in enumerate(rules) for m in re.finditer(r, text) if ok(m)]


def test_pii_query_equals_brute_force(spark):
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        spans = plain_base(r["text"] or "")
        name = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        want[r["doc_id"]] = [sum(k == j for k, *_ in spans) for j in range(4)], hashlib.sha256(name.encode()).hexdigest(), set(filter(None, name.split(",")))
    got = registry.op4_pii(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: ([r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]], r["base_sha256"]) for r in got} == {i: w[:2] for i, w in want.items()}
    assert all(want[r["doc_id"]][2] <= set(r["spans"].split(",")) for r in got) and any(n for w in want.values() for n in w[0])


@pytest.fixture(scope="module")
def fitted(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_pii_skip_edges_add_spans(spark, fitted):
    """Repeats of a number are found through their skip edges alone: without these the field finds none."""
    without = {**fitted, "skip": np.zeros((5, 5))}
    text = "call +1 (377) 555-0271 now." + " Other words stand here." * 200 + " And 377 555-0271 later on."
    base, added = pii.all_spans(text, fitted)
    at = text.index("377 555")
    assert base == [(3, 5, 22)] and added == [(3, at, at + 12)] and pii.all_spans(text, without) == (base, [])
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    n = [pii.find(docs, m).agg(F.sum("n_added")).first()[0] for m in (fitted, without)]
    assert n[0] > n[1]
    numbers = "order 3775550271, again 3775550271, 17.5 kg in 2019, 1234567812345678"
    assert pii.all_spans(numbers, fitted) == ([], [])


def test_pii_odd_rows_with_a_model(spark, odd_docs, fitted):
    got = pii.find(odd_docs, fitted).collect()
    assert len(got) == odd_docs.count() and all(r["spans"] == r["base"] == "" and r["n_added"] == 0 for r in got)
    clean = pii.redact(odd_docs, fitted)
    assert clean.columns == odd_docs.columns and clean.exceptAll(odd_docs).count() == 0
    extra = spark.createDataFrame([(1, "a@b.cd or a@b.cd", "x"), (1, "a@b.cd or a@b.cd", "x"), (None, "+49 170 1234567", "y")], "doc_id long, text string, spans string")
    assert [tuple(r) for r in pii.redact(extra, fitted).orderBy(F.desc("doc_id")).collect()] == [(1, "<EMAIL> or <EMAIL>", "x")] * 2 + [(None, "<PHONE>", "y")]
    assert pii.find(extra.limit(0), fitted).count() == 0 and pii.fit(extra.limit(0)) is None


def test_loopy_marginals_are_near_enumeration():
    rng = np.random.default_rng(3)
    f, model = rng.normal(size=(4, 18)) / 2, {"w": rng.normal(size=(18, 5)) / 4, "chain": rng.normal(size=(5, 5)) / 3}
    model["skip"] = 0.6 * np.eye(5)
    chain, skip = np.array([[0, 1], [1, 2], [2, 3]]), np.array([[0, 2], [1, 3]])
    node, want, z = f @ model["w"], np.zeros((4, 5)), 0.0
    for y in np.ndindex(5, 5, 5, 5):
        p = np.exp(sum(node[i, y[i]] for i in range(4)) + sum(model["chain"][y[a], y[b]] for a, b in chain) + sum(model["skip"][y[a], y[b]] for a, b in skip))
        z += p
        want[range(4), y] += p
    assert np.abs(pii._marginals(f, chain, skip, model) - want / z).max() < 0.03


def test_pii_without_base_spans():
    w = np.zeros((18, 5))
    w[4, 4] = w[5, 4] = 8  # numbers of four digits and more are phones
    model = {"w": w, "chain": np.zeros((5, 5)), "skip": np.zeros((5, 5))}
    for text in ("call 3775550271 today", "a@b.cd or call 3775550271 today"):
        at = text.index("377")
        assert pii.all_spans(text, model)[1] == [(3, at, at + 10)]
    assert pii.all_spans("no such words", model) == ([], [])


def test_loopy_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(1)
    f, model = rng.normal(size=(3, 18)), {"w": rng.normal(size=(18, 5)) / 3, "chain": rng.normal(size=(5, 5)), "skip": np.zeros((5, 5))}
    none = np.zeros((0, 2), int)
    p = pii._marginals(f, np.array([[0, 1], [1, 2]]), none, model)
    node = f @ model["w"]
    w = np.exp(node[0][:, None, None] + node[1][None, :, None] + node[2][None, None] + model["chain"][:, :, None] + model["chain"][None])
    assert np.allclose(p[1], w.sum(axis=(0, 2)) / w.sum(), atol=0.03)


def test_one_informative_mention_reaches_fifty():
    w, skip = np.zeros((18, 5)), np.full((5, 5), -2.0)
    w[10, 4] = 30  # a plus sign says phone, nothing else says anything
    np.fill_diagonal(skip, 8)
    model = {"w": w, "chain": np.zeros((5, 5)), "skip": skip}
    text = "+4991701234567" + " or so 01701234567" * 50
    base, added = pii.all_spans(text, model)
    assert [k for k, _, _ in base] == [3] and len(added) == 50 and {k for k, _, _ in added} == {3}


@pytest.mark.parametrize("seed", range(4))
def test_loopy_messages_settle(seed):
    rng = np.random.default_rng(seed)
    f, model = rng.normal(size=(7, 18)), {"w": rng.normal(size=(18, 5)) / 4, "chain": rng.normal(size=(5, 5)) / 2, "skip": rng.normal(size=(5, 5)) / 2}
    chain, skip = np.array([[0, 1], [1, 2], [3, 4], [4, 5]]), np.array([[1, 4], [4, 6], [2, 3]])
    model["skip"] += model["skip"].T
    p = pii._marginals(f, chain, skip, model)
    edges = [(a, b, np.exp(model["chain"])) for a, b in chain] + [(a, b, np.exp(model["skip"])) for a, b in skip]
    node = np.exp(f @ model["w"])
    m = {(a, b): np.ones(5) for x, y, _ in edges for a, b in ((x, y), (y, x))}
    for _ in range(400):  # plain messages, an edge at a time
        for x, y, pot in edges:
            for a, b, t in ((x, y, pot), (y, x, pot.T)):
                v = node[a] * np.prod([m[c, d] for c, d in m if d == a and c != b], axis=0) @ t if any(d == a and c != b for c, d in m) else node[a] @ t
                m[a, b] = v / v.sum()
    want = np.array([node[i] * np.prod([m[c, d] for c, d in m if d == i], axis=0) for i in range(7)])
    assert np.allclose(p, want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_decontamination_finds_exact_and_edited(spark):
    rng = random.Random(9)
    item = [f"t{rng.randrange(1000)}" for _ in range(40)]
    edited = [w if k % 9 else "other" for k, w in enumerate(item)]
    filler = [f"f{rng.randrange(1000)}" for _ in range(100)]
    docs = frame(spark, [(1, " ".join(filler + item + filler)), (2, " ".join(filler + edited)), (3, " ".join(filler)), (4, None), (5, " ".join(filler + item[:12]))])
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (10, "a b")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7]["score"] == 1 and (got[1, 7]["start"], got[1, 7]["end"]) == (100, 140)
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def best_share(item, text):
    return smith_waterman(np.array([hash(w) for w in item]), np.array([hash(w) for w in text]))[1] / len(item)


@pytest.mark.parametrize(("size", "every"), [(40, 5), (40, 6), (15, 5), (15, 6)])
def test_decontamination_finds_thickly_edited_equals_brute_force(spark, size, every):
    rng = random.Random(size + every)
    items = [[f"t{i}_{rng.randrange(1000)}" for _ in range(size)] for i in range(2 * every)]  # one edited copy of each, an exact one of half of them
    filler = lambda: [f"f{rng.randrange(1000)}" for _ in range(60)]
    texts = [filler() + [w if (k + i) % every else f"other{k}" for k, w in enumerate(item)] + filler() for i, item in enumerate(items)]
    texts += [filler() + item + filler() for item in items[every:]] + [filler() + items[0][: size // 2], filler()]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, [(d, " ".join(t)) for d, t in enumerate(texts)]), rows).collect()}
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if best_share(item, t) >= decontaminate.COVERAGE}
    assert got == want and len(want) == 3 * every


def test_decontamination_of_a_repetitive_item(spark):
    item = ["the"] * 25 + [f"t{k}" for k in range(25)]
    copy = item[:30] + [f"other{k}" for k in range(20)]
    got = decontaminate.contaminated(frame(spark, [(1, " ".join(copy)), (2, " ".join(copy[:29]))]), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, 0.6)]


def test_decontamination_of_short_items(spark):
    docs = frame(spark, [(1, "f1 f2 One two three f3"), (2, "one two f1 three"), (3, "f1 f2"), (4, None), (5, "two three")])
    items = spark.createDataFrame([(7, "one two three"), (8, "two three"), (9, "THREE"), (10, " "), (11, "f1 one two three")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["start"], r["end"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 7): (1, 2, 5), (1, 8): (1, 3, 5), (1, 9): (1, 4, 5), (2, 9): (1, 3, 4), (5, 8): (1, 0, 2), (5, 9): (1, 1, 2)}


def plain_alignment(a, b, centre=None, half=0):
    """Highest (score, matched words), with the whole table in memory."""
    s = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            s[i, j] = (0, 0)
            if i and j and (centre is None or abs(j - i - centre) <= half):
                hit = a[i - 1] == b[j - 1]
                x, y, z = s[i - 1, j - 1], s[i - 1, j], s[i, j - 1]
                s[i, j] = max((0, 0), (x[0] + (2 if hit else -1), x[1] + hit), (y[0] - 1, y[1]), (z[0] - 1, z[1]))
    return max(s.values())


def test_alignment_equals_plain_recursion():
    rng = np.random.default_rng(6)
    for turn in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 12))
        band = (None, 0) if turn % 2 else (int(rng.integers(-4, 8)), int(rng.integers(0, 4)))
        score, matched, a0, a1, b0, b1 = smith_waterman(a, b, *band)
        assert (score, matched) == plain_alignment(a, b, *band)
        part = plain_alignment(a[a0:a1], b[b0:b1], None if band[0] is None else band[0] + a0 - b0, band[1])
        assert part == (score, matched) and (not score or (a[a0] == b[b0] and a[a1 - 1] == b[b1 - 1]))
    assert smith_waterman(a[:0], b)[0] == smith_waterman(a, b[:0])[0] == 0


def test_licenses(spark):
    docs = frame(spark, [(1, "Words before.\nReleased under the MIT License.\nAfter."), (2, "released under the\nmit license"), (3, "Released under"), (4, None), (None, "Licensed under the Apache License, Version 2.0.")])
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(docs).collect()}
    assert set(got) == {(1, "MIT/notice"), (2, "MIT/notice"), (None, "Apache-2.0/notice")}
    assert (got[1, "MIT/notice"]["start"], got[1, "MIT/notice"]["end"]) == (14, 44)
    long = licenses.TEMPLATES["MIT/grant"]
    changed = long.replace("without limitation ", "").replace("furnished", "given")
    assert [r["license"] for r in licenses.scan(frame(spark, [(1, "x " * 50 + changed + " y" * 50)])).collect()] == ["MIT/grant"]


def test_license_query_equals_brute_force(spark):
    """Every template against every document by whole alignments: the query finds those of 0.8 and more."""
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    plain = lambda t: re.findall(r"[^\x20\x09-\x0D]+", licenses._MARKS.sub(" ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    own = {k: np.array([hash(w) for w in plain(t)]) for k, t in licenses.TEMPLATES.items()}
    want = {}
    for i, t in docs:
        h = np.array([hash(w) for w in plain(t)], int)
        for k, x in own.items():
            if np.isin(x, h).sum() >= licenses.COVERAGE * len(x):
                share = smith_waterman(x, h)[1] / len(x)
                if share >= licenses.COVERAGE:
                    want[i, k] = share
    got = registry.op2_licenses(spark, DATA).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == set(want) and want
    assert all(r["coverage"] <= want[r["doc_id"], r["license"]] for r in got)


def test_licenses_whole_texts_ties_and_parts(spark, odd_docs):
    whole = licenses.TEMPLATES["BSD-3-Clause"]
    words_ = whole.split()
    edited = " ".join(w for k, w in enumerate(words_) if k % 11)
    docs = frame(spark, [(1, "Copyright X.\n" + whole), (2, "y " * 300 + edited + " z" * 300), (3, " ".join(words_[: len(words_) // 2]))])
    got = defaultdict(set)
    for r in licenses.scan(docs).collect():
        got[r["doc_id"]].add(r["license"])
    assert got[1] == {"BSD-3-Clause", "BSD-2-Clause", "BSD/grant"} and got[2] >= {"BSD-3-Clause", "BSD/grant"} and got[3] == {"BSD/grant"}
    same = {"a": "one two three four five six", "b": "one two three four five six"}  # ties: both are reported
    assert sorted(tuple(r)[:3] for r in licenses.scan(frame(spark, [(1, "x one two three four five six"), (1, "x one two three four five six")]), same).collect()) == [(1, "a", 1.0), (1, "a", 1.0), (1, "b", 1.0), (1, "b", 1.0)]
    long = " ".join(f"t{k}" for k in range(3000))
    assert licenses.scan(frame(spark, [(1, "x " * 9000 + long)]), {"long": long}).count() == 1
    before, licenses.MAX_TEMPLATE_WORDS = licenses.MAX_TEMPLATE_WORDS, 100
    try:
        assert {r["license"] for r in licenses.scan(docs.filter("doc_id = 1")).collect()} == got[1]
    finally:
        licenses.MAX_TEMPLATE_WORDS = before
    assert licenses.scan(odd_docs, {}).count() == 0


def test_winnowing_keeps_a_fingerprint_of_each_run():
    rng = np.random.default_rng(5)
    h, text = rng.integers(0, 9, 300).astype(np.uint64), np.sort(rng.integers(0, 40, 300))
    for size in (2, 4):
        kept = set(licenses.winnow(h, text, size).tolist())
        for i in range(301 - size):
            if text[i] == text[i + size - 1]:
                assert kept & set(range(i, i + size))
        assert {int(text[k]) for k in kept} == set(text.tolist())


def test_decontamination_query_equals_brute_force(spark):
    docs = [(r[0], decontaminate_words(r[1])) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r[0], decontaminate_words(r[1])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    want = {}
    for d, t in docs:
        for i, x in items:
            runs = {tuple(x[k : k + 4]) for k in range(len(x) - 3)}
            if len(x) and np.isin(x, t).sum() >= decontaminate.COVERAGE * len(x) and any(tuple(t[k : k + 4]) in runs for k in range(len(t) - 3)):
                share = smith_waterman(x, t)[1] / len(x)
                if share >= decontaminate.COVERAGE:
                    want[d, i] = share
    got = defaultdict(float)
    for r in registry.op8_decontamination(spark, DATA).collect():
        got[r["doc_id"], r["item_id"]] = max(got[r["doc_id"], r["item_id"]], r["score"])
    assert got == want and want


def decontaminate_words(t):
    return np.array([hash(w) for w in words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))], int)


def test_decontamination_of_odd_rows(spark, odd_docs):
    item = " ".join(f"w{i}" for i in range(500, 540))  # in the long texts, which repeat it 30 times
    items = spark.createDataFrame([(1, item, "x"), (1, item, "y"), (2, None, "z"), (None, "one two", "u")], "item_id long, text string, grams string")
    got = decontaminate.contaminated(odd_docs.withColumn("item", F.lit(1)), items).collect()
    assert all(r["score"] == 1 for r in got) and sum(r["doc_id"] == 4 for r in got) == 2
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(5, 1), (6, 1), (4, None)}
    assert decontaminate.contaminated(odd_docs.limit(0), items).count() == 0


@pytest.mark.parametrize(
    ("form", "key"),
    [
        ("http://www.A.org:80/x/", "a.org/x"), ("https://A.org:443/x#top", "a.org/x"), ("http://a.org:443/x", "a.org:443/x"), ("HTTPS://a.org/x?utm_source=f&b=1", "a.org/x?b=1"),
        ("a.org/x?b=1&utm_a=2&c=3&", "a.org/x?b=1&c=3"), ("http://a.org/X?q=/", "a.org/X?q=/"), ("http://a.org", "a.org"), ("http://a.org?utm_x=1", "a.org"), ("", ""), (None, None),
    ],
)
def test_canonical_url(spark, form, key):
    assert spark.createDataFrame([(form,)], "u string").select(revisits.canonical_url(F.col("u"))).first()[0] == key


RECORD = "record_id long, url string, time long, kind string, headers map<string,string>, slice int, near string"


def test_revisits(spark):
    rows = [
        (1, "http://www.A.org/x/", 10, "response", {"etag": "q", "content-type": "t", "date": "1"}),
        (2, "https://a.org:443/x#top", 20, "revisit", {"etag": "q", "date": "2", "server": "s"}),
        (3, "https://a.org/x?utm_source=f", 30, "revisit", {"etag": "other"}),
        (4, "https://a.org/y", 5, "revisit", {"etag": "q"}),
        (5, None, 40, "revisit", {"etag": "q"}),
        (6, "http://a.org/x", 35, "response", {"last-modified": "m"}),
        (7, "http://a.org/x", 36, "revisit", {"last-modified": "m", "expires": "e"}),
        (8, "http://a.org/x", None, "revisit", {"last-modified": "m"}),
        (9, "http://a.org/z", None, "response", {"etag": "z"}),
        (10, "http://a.org/z", 50, "revisit", {"etag": "z"}),
        (11, "http://a.org/x", 36, "revisit", None),
        (12, "http://a.org/t", 60, "revisit", {"etag": "t"}),  # ties of time: by record_id
        (13, "http://a.org/t", 60, "response", {"etag": "t"}),
        (14, "http://a.org/t", 60, "revisit", {"etag": "t"}),
        (14, "http://a.org/t", 60, "revisit", {"etag": "t"}),
        (15, None, 1, "response", {"etag": "q"}),
    ]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], RECORD)
    out = revisits.resolve(table).collect()
    got = {r["record_id"]: r for r in out}
    lost = (None, "unresolved")
    assert {k: (v["refers_to"], v["status"]) for k, v in got.items()} == {2: (1, "resolved"), 3: (None, "changed"), 4: lost, 5: lost, 7: (6, "resolved"), 8: lost, 10: lost, 11: (None, "changed"), 12: lost, 14: (13, "resolved")}
    assert got[2]["headers"] == {"etag": "q", "content-type": "t", "date": "2"} and got[7]["headers"] == {"last-modified": "m", "expires": "e"}
    assert len(out) == len(got) + 1 and revisits.resolve(table.limit(0)).count() == 0


def test_revisit_query_equals_brute_force(spark):
    caps = sorted(revisits.captures(spark.read.parquet(f"{DATA}/pages.parquet")).withColumn("key", revisits.canonical_url(F.col("url"))).collect(), key=lambda r: (r["time"], r["record_id"]))
    last, want = {}, {}
    for c in caps:
        if c["kind"] == "response":
            last[c["key"]] = c
        elif c["key"] not in last:
            want[c["record_id"]] = (None, "unresolved")
        else:
            same = last[c["key"]]["headers"]["etag"] == c["headers"]["etag"]
            want[c["record_id"]] = (last[c["key"]]["record_id"] if same else None, "resolved" if same else "changed")
    assert {r["record_id"]: (r["refers_to"], r["status"]) for r in registry.op6_revisits(spark, DATA).collect()} == want
    assert {s for _, s in want.values()} == {"resolved", "changed", "unresolved"}


def test_odd_rows_and_empty_tables(spark, odd_docs):
    n = odd_docs.count()
    for docs, k in ((odd_docs, n), (odd_docs.limit(0), 0)):
        rows = substring.remove_repeats(docs).collect()
        assert len(rows) == k
        assert jaccard.near_duplicates(docs).count() == k
        assert pii.find(docs, None).count() == k and pii.redact(docs, None).columns == docs.columns
        assert quality.add_score(docs, None).filter("score = 0.5").count() == k
        assert tokenfile.encode_documents(docs, WORD).count() == k
        assert packing.pack_documents(docs, BYTE).select("doc_id").distinct().count() <= k
        assert licenses.scan(docs).count() == 0
        if k:
            pairs = jaccard.near_duplicates(docs).filter("doc_id = 6 and component_id = 5").count()
            assert pairs == 1 and sum(r["n_removed"] > 0 for r in rows) == 1


def test_digests_of_substring_query(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute_repeats(docs)}
    assert {r[0]: tuple(r[1:]) for r in registry.op5_substring(spark, DATA).collect()} == want


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.execute(registry.SQL[name])
    columns = [x[0] for x in want.description]
    got = registry.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in P.STAGES[:-1]:
        before = kept.select("doc_id").toPandas()["doc_id"]
        kept = stage(spark, kept, DATA).checkpoint()
        assert kept.columns == columns
        assert set(kept.select("doc_id").toPandas()["doc_id"]) <= set(before), name
    assert 0 < kept.count() < docs.count()
    last = P.STAGES[-1][1](spark, kept, DATA)
    assert {r[0] for r in last.select("doc_id").collect()} == {r[0] for r in kept.select("doc_id").collect()}
    assert P.run(spark, DATA).count() == last.count()


def test_pipeline_equals_brute_force(spark):
    """Each stage by plain means on what the one before kept: whole pairs of documents, whole alignments, the tokenizer itself."""
    import corpus_pipeline as P

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    docs = dict(table.select("doc_id", "text").collect())
    good = quality.score(list(docs.values()), quality.fit(table, labels)) >= quality.THRESHOLD
    docs = {i: t for (i, t), ok in zip(docs.items(), good, strict=True) if ok}
    docs = {i: docs[i] for i, _, least in brute_classes(list(docs.items())) if i == least}
    for i, t in list(docs.items()):
        h = decontaminate_words(t)
        for _, x in ((r["item_id"], decontaminate_words(r["text"])) for r in items):
            if np.isin(x, h).sum() >= decontaminate.COVERAGE * len(x) and smith_waterman(x, h)[1] >= decontaminate.COVERAGE * len(x):
                docs.pop(i, None)
    model = pii.fit(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    for i, t in docs.items():
        base, added = pii.all_spans(t or "", model)
        hidden = list(t or "")
        for k, s, e in sorted(base + added, key=lambda x: (x[1], x[2]), reverse=True):
            hidden[s:e] = [f"<{pii.KINDS[k].upper()}>"]
        docs[i] = "".join(hidden)
    rows = P.run(spark, DATA).collect()
    check_packing(rows, list(docs.items()))
    assert {r["doc_id"] for r in rows} == set(docs) and len(docs) < 200


def test_pipeline_stages_of_odd_rows(spark, odd_docs, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns pass; so does an empty table."""
    import corpus_pipeline as P

    docs = odd_docs.withColumnRenamed("n", "n_chars").withColumn("n_chars", F.col("n_chars").cast("long")).withColumn("lang", F.lit("xx"))
    spark.createDataFrame([(5, 1, 0), (1, 0, None), (1, 1, None), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two"), (2, None), (None, "x y z w v")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows, gone in ((docs, {2: "ignored"}), (docs.limit(0), {})):
        kept = rows
        for _, stage in P.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path)).checkpoint()
            assert kept.columns == rows.columns
        ids = {r["doc_id"] for r in kept.collect()}
        assert ids <= {r["doc_id"] for r in rows.collect()} and (not gone or not ids & {4})
        assert {r["doc_id"] for r in P.STAGES[-1][1](spark, kept, str(tmp_path)).collect()} == ids
