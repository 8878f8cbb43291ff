"""Personal data: fixed patterns, and a skip-chain conditional random field that keeps a document's labels consistent.

Patterns give the base spans. Tokens (words with a digit or an @; all others can
only be outside) are labelled outside, email, ip, card or phone: those that a base span touches
are observed, neighbouring tokens share a chain potential, and tokens with equal digits (seven or more at the end) or
equal letters share a skip potential, each with the next such token however
far. Loopy sum-product messages, passed along whole paths of chain or of skip edges
in turns until they no longer change, give marginals; a token that no base span
touches becomes a span if one kind's marginal reaches `confidence`, and parts of one number become one span. Weights are fitted by
pseudo-likelihood on the base labels of a bounded sample (MAX_DOCS documents,
the first by a hash of the id among those with a digit or an @) and on bare repeats of
its numbers, which only what they repeat tells apart.

Null and empty texts have no spans. Counts are of base spans, which are never
taken away. A null doc_id stays null; repeated rows get equal results; an empty table gives
no rows; extra columns pass through `redact` and are ignored elsewhere.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import texts_of
from tessera.llm.textgrid import slices

KINDS = ("email", "ip", "card", "phone")
MAX_DOCS = 1500
STEPS = 600
CONFIDENCE = 0.95
SETTLED = 1e-6
CERTAIN = 1e-9
AGREE = 2.0  # the mean of the prior of equal labels at a skip edge
DIGITS = (0, 0, 19, 15)  # most of a card, most of a phone

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can begin only where a run of digits does, and no part of a run need be given back: one pass over any text.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT_OR_DIGIT = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _graph(text: str, base: list[tuple[int, int, int]]):
    """Tokens (start, end), features, base labels, chain edges and skip edges."""
    tokens = [(m.start(), m.end()) for m in _WORD.finditer(text) if _AT_OR_DIGIT.search(text, m.start(), m.end())]
    n = len(tokens)
    labels = np.zeros(n, int)
    spans = sorted((s, e, k) for k, s, e in base)
    starts = [s for s, _, _ in spans]
    import bisect

    for i, (s, e) in enumerate(tokens):
        for x in spans[max(0, bisect.bisect_left(starts, s) - 2) : bisect.bisect_left(starts, e)]:
            if x[0] < e and x[1] > s:
                labels[i] = x[2] + 1
    f = np.zeros((n, 18))
    keys: dict[str, int] = {}
    chain, skip = [], []
    for i, (s, e) in enumerate(tokens):
        t = text[s:e]
        core = t.strip("!\"'#$%&*,;:.<>[]{}|?")
        d = "".join(c for c in core if "0" <= c <= "9")
        letters = any(c.isalpha() for c in core)
        f[i, 0] = 1
        f[i, 1] = "@" in core
        f[i, 2] = "@" in core and "." in core.split("@")[-1]
        f[i, 3 + min(5, [0, 4, 8, 12, 16, 20].index(max(x for x in (0, 4, 8, 12, 16, 20) if x <= len(d))))] = 1
        f[i, 9] = core.count(".") == 3 and not letters
        f[i, 10] = core.startswith("+")
        f[i, 11] = core.startswith("(") or core.endswith(")")
        f[i, 12] = letters
        f[i, 13] = "-" in core and not letters
        f[i, 14] = 16 <= len(d) <= 19 and not letters and luhn(d)
        f[i, 15] = i > 0 and s - tokens[i - 1][1] == 1 and text[tokens[i - 1][0]] == "+"
        f[i, 16] = len(core) == len(d)
        f[i, 17] = "." in core and not letters
        if i and s - tokens[i - 1][1] == 1:
            chain.append((i - 1, i))
        key = d[-7:] if len(d) >= 7 and not letters else core.lower() if letters and len(core) >= 6 else None
        if key:
            if key in keys:
                skip.append((keys[key], i))
            keys[key] = i
    edge = lambda x: np.array(x, int).reshape(-1, 2)
    return tokens, f, labels, edge(chain), edge(skip)


def _with_repeats(text: str):
    """Features, labels and edges of a training text to which bare repeats of its numbers are added, each with the label of what it repeats.

    Also whether a label is unknown: a token without a base label that repeats a labelled one may be anything.
    """
    base = base_spans(text)
    tokens, _, labels, _, _ = _graph(text, base)
    kind = {(s, e): k + 1 for k, s, e in base if k != 0}
    kind |= {x: 0 for x, y in zip(tokens, labels.tolist(), strict=True) if not y}
    bare, truth = [], []
    for (s, e), label in sorted(kind.items()):
        d = "".join(c for c in text[s:e] if "0" <= c <= "9")
        if len(d) < 7 or any(c.isalpha() for c in text[s:e]):
            continue
        forms = [text[s:e]] * 2 if label == 2 else [d[-10:], f"{d[-10:-7]} {d[-7:-4]}-{d[-4:]}", f"{d[-7:-4]}-{d[-4:]}"] if label == 4 else [d, d]
        bare += forms
        truth += [label] * sum(1 + (" " in x.strip()) for x in forms)
    whole = "\n;\n".join([text, *bare])
    tokens, f, y, c, k = _graph(whole, base)
    own = int(np.searchsorted([s for s, _ in tokens], len(text)))
    known = y > 0
    for e in (k, k[::-1]):  # along the paths of equal tokens, forwards and back
        for i, j in e:
            known[i] = known[j] = known[i] or known[j]
    unknown = known & (y == 0)
    y[own:], unknown[own:] = truth, False
    return f, y, c, k, unknown


def train(texts: list[str]) -> dict | None:
    """Pseudo-likelihood of the base labels.

    The patterns' features explain every label that patterns give, so nothing would be left for the skip edges to
    explain: each text is fitted with bare repeats of its numbers, which no pattern finds and only what they repeat tells apart.
    """
    fs, ls, cs, ks, us, at = [], [], [], [], [], 0
    for t in texts:
        f, y, c, k, u = _with_repeats(t)
        if len(f):
            fs.append(f), ls.append(y), cs.append(c + at), ks.append(k + at), us.append(u)
            at += len(f)
    if not at:
        return None
    f, y, c, k = np.concatenate(fs), np.concatenate(ls), np.concatenate(cs), np.concatenate(ks)
    told = ~np.concatenate(us)
    hot = np.eye(5)[y] * told[:, None]  # the vote of a token
    w, t, s = np.zeros((f.shape[1], 5)), np.zeros((5, 5)), AGREE * np.eye(5)
    vw, vt, vs = 0 * w + 1e-8, 0 * t + 1e-8, 0 * s + 1e-8
    for _ in range(STEPS):
        z = f @ w
        for e, m in ((c, t), (k, s)):
            np.add.at(z, e[:, 1], hot[e[:, 0]] @ m)
            np.add.at(z, e[:, 0], hot[e[:, 1]] @ m.T)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (np.eye(5)[y] - p) * told[:, None]
        gt, gs = (hot[e[:, 0]].T @ g[e[:, 1]] + g[e[:, 0]].T @ hot[e[:, 1]] for e in (c, k))
        gs = (gs + gs.T) / 2
        for x, gx, v in ((w, f.T @ g - 0.01 * w, vw), (t, gt - 0.01 * t, vt), (s, gs - 0.01 * (s - AGREE * np.eye(5)), vs)):
            v += gx * gx
            x += gx / np.sqrt(v)
    return {"w": w, "chain": t, "skip": s}


def _along(a, b, node, pot):
    """Exact messages into b along paths of edges a -> b, where no two edges share an a or a b; edges are doubled in length until all reach their path's start."""
    ends_at = np.full(len(node), -1)
    ends_at[b] = np.arange(len(b))
    before = ends_at[a]
    product = node[a][:, :, None] * pot
    product /= product.max(axis=(1, 2), keepdims=True)
    while (more := np.flatnonzero(before >= 0)).size:
        longer = product[before[more]] @ product[more]
        jump = before[before[more]]
        product[more] = longer / longer.max(axis=(1, 2), keepdims=True)
        before[more] = jump
    out = product.sum(axis=1)
    return out / out.sum(axis=1, keepdims=True)


def _marginals(f, chain, skip, model, labels=None) -> np.ndarray:
    """Loopy sum-product: exact passes along all paths of one kind of edges, then of the other, until settled.

    A round carries a message along a whole path. Rounds are bounded by the
    number of tokens, so that messages may also change between the kinds of edges at each token; later ones are damped by half.
    Tokens with a base label (`labels`, above 0) are observed.
    """
    node = np.exp(np.clip(f @ model["w"], -30, 30))
    node /= node.sum(axis=1, keepdims=True)
    if labels is not None:
        node[labels > 0] = CERTAIN + np.eye(5)[labels[labels > 0]]
    kinds = [(e, np.exp(np.clip(model[x], -8, 8))) for x, e in (("chain", chain), ("skip", skip)) if len(e)]
    into = [np.ones_like(node) for _ in kinds]  # product of the messages into each token by edges of a kind
    for turn in range(50 + 2 * len(node)):
        change = 0.0
        for k, (e, pot) in enumerate(kinds):
            rest = node * into[1 - k] if len(kinds) == 2 else node
            rest = rest / rest.sum(axis=1, keepdims=True)
            new = np.ones_like(node)
            new[e[:, 1]] = _along(e[:, 0], e[:, 1], rest, pot)
            new[e[:, 0]] *= _along(e[:, 1], e[:, 0], rest, pot.T)
            new /= new.sum(axis=1, keepdims=True)
            change = max(change, np.abs(new - into[k]).max())
            into[k] = new if turn < 20 else 0.5 * (new + into[k])
        if len(kinds) < 2 or change < SETTLED:
            break
    p = node * np.prod(into, axis=0)
    return p / p.sum(axis=1, keepdims=True)


def all_spans(text: str, model: dict | None, confidence: float = CONFIDENCE):
    """(base spans, added spans)."""
    base = base_spans(text)
    if model is None or not (_DIGIT.search(text) or "@" in text):
        return base, []
    tokens, f, labels, chain, skip = _graph(text, base)
    if not len(tokens):
        return base, []
    p = _marginals(f, chain, skip, model, labels)
    added = []
    for i in np.flatnonzero((labels == 0) & (p[:, 1:].max(axis=1) >= confidence)):
        s, e = tokens[i]
        while e > s and not text[e - 1].isalnum():
            e -= 1
        while s < e and not (text[s].isalnum() or text[s] == "+"):
            s += 1
        if s < e:
            kind = int(np.argmax(p[i])) - 1
            if added and added[-1][0] == kind and s - added[-1][2] <= 2 and sum(x.isdigit() for x in text[added[-1][1] : e]) <= DIGITS[kind]:
                added[-1] = (kind, added[-1][1], e)  # parts of one number
            else:
                added.append((kind, s, e))
    return base, added


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> dict | None:
    """The model of a bounded sample of the documents with a digit or @: `max_docs` texts and sampling.MAX_BYTES bytes at most."""
    has = docs.filter("doc_id is not null and (text like '%@%' or text rlike '[0-9]')")
    ids = has.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = sorted(text for _, text in texts_of(docs.filter("text is not null"), ids, max_docs))
    return train(texts) if texts else None


def _name(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, counts of base spans by kind, n_added, base and all spans as strings."""
    import pyarrow as pa

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text in batch["text"].to_pylist():
                base, added = all_spans(text or "", model)
                n = defaultdict(int)
                for k, _, _ in base:
                    n[k] += 1
                rows.append((n[0], n[1], n[2], n[3], len(added), _name(base), _name(base + added)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.string()) for c in cols[5:])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base string, spans string")


def redact(docs: DataFrame, model: dict | None) -> DataFrame:
    """`docs` with each span of its text replaced by its kind in angle brackets; overlapping spans as one."""
    import pyarrow as pa

    def run(batches):
        for batch in slices(batches):
            out = []
            for text in batch["text"].to_pylist():
                base, added = all_spans(text or "", model)
                parts, at = [], 0
                for s, e, k in sorted((s, e, k) for k, s, e in base + added):
                    if s >= at:
                        parts += [text[at:s], f"<{KINDS[k].upper()}>"]
                    at = max(at, e)
                out.append("".join([*parts, text[at:]]) if parts else text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)
