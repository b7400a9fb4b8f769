"""Spelling: candidates by k-gram overlap and edit distance, the most frequent of which corrects a query."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.porter2 import stem_udf
from textloom.functions.text import clean, grams_of
from textloom.operators.index import Index
from textloom.plans.parser import clean_word

OVERLAP = 0.35


def close_words(index: Index, words: list[str], overlap: float = OVERLAP) -> DataFrame:
    """(asked, word, overlap): vocabulary words whose k-grams overlap by more than `overlap` with those of an asked word.

    Only grams of two or more characters are read from the k-gram index, of the asked words alone, and counted by word; shared
    characters are added from the words themselves. A word has at least as many pairs as characters, so those that share
    characters alone overlap by a third at most; for a bound below that, characters are looked up as well.
    """
    if not words:
        return index.words.where(F.lit(False)).select(F.lit("").alias("asked"), "word", F.lit(0.0).alias("overlap"))
    looked = {w: sorted(g for g in grams_of(w) if len(g) > 1 or overlap <= 1 / 3) for w in words}
    told = [F.struct(F.lit(w).alias("asked"), F.lit(g).alias("gram"), F.lit(len(grams_of(w))).alias("many"), F.array(*map(F.lit, sorted({"$", *w}))).alias("letters")) for w in looked for g in looked[w]]
    wanted = index.words.sparkSession.range(1).select(F.explode(F.array(*told)).alias("q")).select("q.*")
    # no overlap exceeds the share of the smaller set in the larger
    near = index.kgrams.where(F.col("gram").isin(sorted(set().union(*looked.values())))).join(F.broadcast(wanted), "gram")
    near = near.where(F.least("size", "many") > overlap * F.greatest("size", "many")).groupBy("asked", "word", "size", "many", "letters")
    found = near.agg(F.count(F.when(F.length("gram") > 1, 1)).alias("longer"))
    letters = F.size(F.array_intersect(F.concat(F.array(F.lit("$")), F.split("word", "")), F.col("letters")))
    found = found.select("asked", "word", "size", "many", (F.col("longer") + letters).alias("n"))
    found = found.select("asked", "word", (F.col("n") / (F.col("size") + F.col("many") - F.col("n"))).alias("overlap"))
    return found.where(F.col("overlap") > overlap)


def candidates(index: Index, words: list[str], overlap: float = OVERLAP) -> DataFrame:
    """(asked, word, distance): of the close words, all at the least edit distance."""
    near = close_words(index, words, overlap).select("asked", "word", F.levenshtein("asked", "word").alias("distance"))
    least = near.groupBy("asked").agg(F.min("distance").alias("distance"))
    return near.join(F.broadcast(least), ["asked", "distance"]).select("asked", "word", "distance")


def best(index: Index, words: list[str], overlap: float = OVERLAP) -> DataFrame:
    """(asked, word, df): the candidate in most documents, the least word among equals; a candidate is looked up as a query word is."""
    found = candidates(index, words, overlap).withColumn("cleaned", clean(F.col("word")))
    found = found.withColumn("term", stem_udf("cleaned") if index.stemmed else F.col("cleaned"))
    known = found.join(index.vocabulary.select("term", "df"), "term", "left").select("asked", "word", F.coalesce("df", F.lit(0)).alias("df"))
    top = known.groupBy("asked").agg(F.min_by("word", F.struct((-F.col("df")).alias("df"), "word")).alias("word"), F.max("df").alias("df"))
    return top.select("asked", "word", "df")


def corrected(index: Index, query: str, ranked: bool = False) -> str | None:
    """The query with unknown words replaced where they stand, or None if all are known or one has no candidate.

    Known are the words that, cleaned, are terms of the index; wildcards are left alone. The words of a ranked query are what
    stands between white space, of which one blank is kept; those of a boolean query are runs of letters, digits and
    underscores, and all its symbols stay.
    """
    parts = [x for w in query.split() for x in (" ", w)] if ranked else re.split(r"(\w+)", query)
    at = range(1, len(parts), 2)
    words = {parts[i] for i in at if "*" not in parts[i]}
    terms = index.vocabulary.where(F.col("term").isin(sorted(map(clean_word, words)))).select("term")
    known = {r["term"] for r in terms.collect()}
    unknown = sorted(w for w in words if clean_word(w) not in known)
    meant = {r["asked"]: r["word"] for r in best(index, unknown).collect()} if unknown else {}
    if not unknown or not all(meant.get(w) for w in unknown):
        return None
    for i in at:
        parts[i] = meant.get(parts[i], parts[i])
    return "".join(parts).strip() if ranked else "".join(parts)
