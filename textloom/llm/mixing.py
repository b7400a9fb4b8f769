"""Mixing sources to target weights by Poisson replication: each document is repeated by a hash-seeded Poisson count."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import fresh, stored, table

SEED = "mix-1"
#: Sources get tokens as this power of their size; 1 keeps the mixture, 0 makes all equal.
TEMPERATURE = 0.7
#: Mean length of the result against the input, in documents.
EPOCHS = 1.0
#: Most rates that are broadcast; more of them are joined by source and one of SALTS salts, so that no source's rows meet in one task.
BROADCAST, SALTS = 100_000, 64
#: Largest rate whose distribution is tabled, once for its source; beyond it each row sums the terms itself.
TABLED = 1000.0
#: Bytes of rows that one part of the shuffled mixture is to hold.
PART_BYTES = 32 << 20


def hashed(digits: int, *parts: Column) -> Column:
    """The first hex digits of an md5, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, digits), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """In [0, 1), in steps of 2**-52."""
    return hashed(13, *parts).cast("double") / F.lit(float(1 << 52))


def terms(rate: Column) -> Column:
    """A count whose Poisson tail is below 2**-53: by Bernstein's bound, x above the rate has x * x = 2 * 53 * ln 2 * (rate + x / 3)."""
    a = 53 * math.log(2)
    return F.ceil(rate + a / 3 + F.sqrt(a * a / 9 + 2 * a * rate)).cast("int")


def poisson(u: Column, rate: Column) -> Column:
    """Inverse of the Poisson distribution function at u: the number of k whose P(X <= k) is at most u."""
    # (log of the term, sum, count): the terms follow by recurrence, in logarithms, as exp(-rate) is 0 for rates above 745
    start = F.struct((-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("n"))
    step = lambda s, k: F.struct((s.p + F.log(rate / k)).alias("p"), (s.c + F.exp(s.p + F.log(rate / k))).alias("c"), (s.n + F.when(u >= s.c, 1).otherwise(0)).alias("n"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), terms(rate)), start, step, lambda s: s.n)).otherwise(0)


def distribution(rate: Column) -> Column:
    """P(X <= k) for k from 0 as far as a uniform of 52 bits can tell it from 1; null for rates above TABLED."""
    start = F.struct((-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda s, k: F.struct((s.p + F.log(rate / k)).alias("p"), F.array_append(s.c, F.element_at(s.c, -1) + F.exp(s.p + F.log(rate / k))).alias("c"))
    whole = F.aggregate(F.sequence(F.lit(1), terms(rate)), start, step, lambda s: s.c)
    return F.when(rate <= 0, F.array(F.lit(1.0))).when(rate <= TABLED, F.filter(whole, lambda c: c < 1 - 2.0**-53))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS) -> DataFrame:
    """(source, n, bytes, rate): mean repetitions that bring each source to its target share of epochs x all documents.

    `weights` are target shares by source, scaled to sum 1 over the sources that occur; sources without one get none. Without
    weights a source's share goes with the `temperature`-th power of its number of documents. The null source is one source.
    Every rate is taken, however small the source; bytes are those of its string and binary columns.
    """
    held = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in docs.dtypes if kind in ("string", "binary")]
    size = sum(held, F.lit(64)).cast("long")
    n = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    share = F.pow(F.col("n"), F.lit(temperature))
    if weights is not None:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        share = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0))
    n = stored(n.withColumn("share", share))
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("shares")).first()
    rate = F.lit(epochs * total["all"]) * F.col("share") / F.lit(total["shares"] or 1.0) / F.col("n")
    return n.select("source", "n", "bytes", rate.alias("rate"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """All columns of `docs`, each row as often as its Poisson count says, with copy_no (from 0) and place, its place in a global shuffle.

    The count inverts the Poisson distribution at a hash of (seed, doc_id); rows of one doc_id are repeated alike. Rows come
    in order of place, a hash of (seed, doc_id, copy_no): place is uniform, so a row's part of the whole follows from it, without
    a look at the rows, and their number from the bytes that the rates will make. Null ids hash as the empty text, null sources
    as a source of their own; texts are not looked at; an empty table gives an empty one. Columns named copy_no or place are replaced.
    """
    own = docs.drop("copy_no", "place")
    source, rate, table_, times, salt = fresh(own, "source_of", "rate", "distribution", "times", "salt")
    told = stored(rates(docs, weights, temperature, epochs))
    whole = told.agg(F.count("*"), F.sum(F.col("bytes") * F.col("rate"))).first()
    of = told.select(F.col("source").alias(source), F.col("rate").alias(rate), distribution(F.col("rate")).alias(table_))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    asked = own.withColumn(source, F.coalesce("source", F.lit("")))
    if whole[0] <= BROADCAST:
        counted = asked.join(F.broadcast(of), source)
    else:
        of = of.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        counted = asked.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(of, [source, salt])
    u = uniform(F.lit(seed), key)
    tabled = F.get(F.transform(F.array(u), lambda v: F.size(F.filter(table_, lambda c: c <= v))), 0)
    counted = counted.withColumn(times, F.coalesce(F.when(F.col(table_).isNotNull(), tabled), poisson(u, F.col(rate)))).where(F.col(times) > 0)
    out = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
    out = out.withColumn("place", hashed(15, F.lit(seed), key, F.col("copy_no").cast("string"))).select(*own.columns, "copy_no", "place")
    parts = max(1, math.ceil((whole[1] or 0) / PART_BYTES))
    return out.repartitionById(parts, F.floor(F.col("place") / F.lit(2.0**60) * parts).cast("int")).sortWithinPartitions("place", "doc_id")


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repetition of each document, whole, at its place in the shuffled mixture; the text as its digest."""
    docs = mixed(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("text_md5"), "copy_no", "place")


SQL = f"""
WITH n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT s, {EPOCHS}::DOUBLE * (sum(n) OVER ()) * pow(n, {TEMPERATURE}) / (sum(pow(n, {TEMPERATURE})) OVER ()) / n AS rate FROM n),
k AS (SELECT s, rate, unnest(range(ceil(rate + 25 + sqrt(600 + 74 * rate))::BIGINT)) AS k FROM r),
c AS (SELECT s, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS c FROM k),
u AS (SELECT *, coalesce(source, '') AS s, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
t AS (SELECT *, (SELECT count(*) FROM c WHERE c.s = u.s AND u.u >= c.c) AS times FROM u),
e AS (SELECT doc_id, source, lang, n_chars, md5(text) AS text_md5, unnest(range(times))::INTEGER AS copy_no FROM t)
SELECT doc_id, source, lang, n_chars, text_md5, copy_no, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || copy_no), 1, 15))::BIGINT AS place FROM e
"""
