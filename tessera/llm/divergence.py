"""Source divergence audit: how far the words of each source are from those of the other sources of its language.

Inclusion-exclusion over supports. The divergence of two groups is a sum over
all V kept terms of their language, but most terms are missing from one or both. With
f(x, y) the price of a term of counts x and y, the sum is

    V f(0, 0)                                             as if all terms were missing from both
    + the sum over the terms of a of f(x, 0) - f(0, 0)    from the histogram of a's counts alone
    + the sum over the terms of b of f(0, y) - f(0, 0)    from that of b
    + the sum over shared terms of f(x, y) - f(x, 0) - f(0, y) + f(0, 0)

so only shared terms need a join of postings, once for both directions. Smoothed
shares are whole billionths (`share`), and all arithmetic is in whole numbers.

Counting is Python on Arrow batches, which adds up within a task before anything is
shuffled; the rest is DataFrame functions. The kept postings are
written to the shared folder, so lost executors don't repeat the counting. A term has one posting for each source at
most, so no key grows with the documents.

Nulls in text, lang and source count as ''. A row is a document, repeated rows and
null ids too. A group without kept terms has a share for each term all the same; a language without kept terms has
divergence 0 everywhere and no `term` rows; a language of one source has no
`pair` rows. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.terms import splitter
from tessera.llm.textgrid import release_memory
from tessera.llm.tokenfile import shared_folder

LEAST_DOCUMENTS = 3
TOP = 200
HELD_TERMS = 400_000
SMALL_GROUPS = 20_000  # so many rows of about 100 bytes are sent to all tasks; more are joined by a shuffle
ROWS_A_BATCH = 20_000
SALTS = 32
OUT = ("lang", "source", "part", "item", "value", "rank")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (count + 1) / (total + terms)) by long division, three digits at a time, so that nothing overflows; null without terms or words."""
    under = F.nullif(total + terms, F.lit(0).cast("long"))
    rest, out = count + 1, F.lit(1).cast("long")
    for unit in (1_000_000, 1_000, 1):
        scaled = rest * 1000
        out = out + F.call_function("div", scaled, under) * unit
        rest = scaled % under
    return out


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame, held_terms: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, n, df) summed over all documents; term null, once for each group, whether it has terms or not."""
    import pyarrow as pa

    names, split = ["lang", "source", "term", "n", "df"], splitter(digits=False)

    def rows(held):
        for (lang, source), (n, df) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((lang, source, None, 0, 0), types, strict=True)], names=names)
            terms = list(n)
            for i in range(0, len(terms), ROWS_A_BATCH):
                part = terms[i : i + ROWS_A_BATCH]
                columns = [lang] * len(part), [source] * len(part), part, list(map(n.__getitem__, part)), list(map(df.__getitem__, part))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    types = pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                for lang, source, text in zip(*(part[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                    n, df = held.setdefault((lang, source), (Counter(), Counter()))
                    words = split(text)
                    n.update(words)
                    df.update(set(words))
                if sum(len(n) for n, _ in held.values()) > held_terms:
                    yield from rows(held)
                    held.clear()
        yield from rows(held)
        release_memory()

    plain = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("binary").alias("text"))
    counted = plain.mapInArrow(run, "lang string, source string, term binary, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, held_terms: int = HELD_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (a source, or a term), value, rank; see the module."""
    term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, held_terms).withColumn("documents", F.sum("df").over(term)).withColumn("lang_n", F.sum("n").over(term))
    # a term is counted once for its language: at the smallest of its sources
    counts = counts.withColumn("once", F.col("source") == F.min("source").over(term))
    at = shared_folder(docs.sparkSession, "divergence")
    counts.filter(F.col("term").isNull() | (F.col("documents") >= least_documents)).drop("df", "documents").write.parquet(at)
    counts = docs.sparkSession.read.parquet(at)
    kept = counts.filter("term is not null")

    langs = counts.groupBy("lang").agg(F.count_if(F.col("term").isNotNull() & F.col("once")).alias("terms"), F.sum("n").alias("lang_total"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang")
    groups = groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
    groups = groups.checkpoint()
    small = groups.count() <= SMALL_GROUPS
    if small:
        groups = F.broadcast(groups)
    priced = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    over = priced.withColumn("q", q).filter("p > q").withColumn("value", price(F.col("p"), F.col("q")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    over = over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return pairs(priced, groups, small).unionByName(terms)


def _with_others(rows: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """`rows` of groups, each with every other group of its language as other and zero_other; a language of many groups is split over SALTS tasks."""
    other, keys = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("zero_other")), ["lang"]
    if not small:
        keys.append("salt")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
        other = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(other, keys).filter("source <> other").drop(*keys[1:])


def pairs(priced: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """The `pair` rows from the kept postings with their shares, and the groups."""
    # one-sided terms: a term that the group has x times costs the same against any other group that lacks it
    histogram = priced.groupBy("lang", "source", "n", "p", "zero").agg(F.count("*").alias("many"))
    one = _with_others(histogram, groups, small)
    p, z, o, none = F.col("p"), F.col("zero"), F.col("zero_other"), F.lit(0).cast("long")
    one = one.select("lang", "source", "other", (F.col("many") * (price(p, o) - price(z, o))).alias("there"), (F.col("many") * (price(o, p) - price(o, z))).alias("back"))
    # shared terms: each pair of postings of a term once, for both directions
    a = priced.select("lang", "term", "source", "p", "zero")
    b = priced.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("p_other"), F.col("zero").alias("zero_other"))
    both = a.join(b, ["lang", "term"]).filter("source < other")
    y = F.col("p_other")
    there = price(p, y) - price(p, o) - price(z, y) + price(z, o)
    back = price(y, p) - price(y, z) - price(o, p) + price(o, z)
    both = both.select("lang", "source", "other", there.alias("there"), back.alias("back"))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("lang", "source", "other").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))

    parts = summed(one).unionByName(summed(both))
    way = lambda source, item, value: F.struct(F.col(source).alias("source"), F.col(item).alias("item"), F.col(value).alias("value"))
    ways = parts.select("lang", F.inline(F.array(way("source", "other", "there"), way("other", "source", "back"))))
    # terms that both lack, and pairs that share nothing
    base = _with_others(groups, groups, small)
    base = base.select("lang", "source", F.col("other").alias("item"), F.coalesce(F.col("terms") * price(z, o), none).alias("value"))
    total = ways.unionByName(base).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return total.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
