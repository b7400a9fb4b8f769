"""Boolean, phrase, wildcard and ranked retrieval over an index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.index import Index
from textloom.plans.parser import Operand, literals, normal, operands, pattern_grams

TOP = 10
#: Most terms of a query's wildcards that are looked for by name; more of them are joined.
NAMED = 1000


def postings_of(index: Index, terms: list[str], positions: bool = False) -> DataFrame:
    """Postings of some terms, without positions unless asked for, so that their column isn't read."""
    found = index.postings.where(F.col("term").isin(sorted(set(terms))))
    return found if positions else found.select("term", "doc_id", "tf")


def frequencies(index: Index, words: list[str]) -> DataFrame:
    """(nth, word, df) of words in their order, 0 for unknown ones."""
    spark = index.postings.sparkSession
    asked = [(n, w, normal(w, index.stemmed)) for n, w in enumerate(words)]
    rows = F.array(*(F.struct(F.lit(n).alias("nth"), F.lit(w).alias("word"), F.lit(t).alias("term")) for n, w, t in asked))
    mine = spark.range(1).select(F.explode(rows).alias("q")).select("q.*")
    known = index.vocabulary.where(F.col("term").isin(sorted({t for _, _, t in asked}))).select("term", "df")
    return mine.join(F.broadcast(known), "term", "left").select("nth", "word", F.coalesce("df", F.lit(0)).alias("df"))


def terms_by_letter(index: Index) -> DataFrame:
    """(letter, term) of all terms but the empty one, in order."""
    named = index.vocabulary.where("term <> ''")
    return named.select(F.substring("term", 1, 1).alias("letter"), "term").orderBy("letter", "term")


def with_grams(index: Index, grams: list[str]) -> DataFrame:
    """(word, term) of the words that have all of some k-grams; only these grams are read."""
    found = index.kgrams.where(F.col("gram").isin(grams)).groupBy("word", "term").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(grams)).select("word", "term")


def expanded(index: Index, pattern: str, exact: bool = False) -> DataFrame:
    """(word, term) of the vocabulary words that have all k-grams of a pattern; with `exact`, only those that match it."""
    grams = sorted(pattern_grams(pattern))
    if not grams:
        return index.words.where(F.lit(False))
    found = with_grams(index, grams)
    if exact:
        like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
        found = found.where(F.col("word").like(like))
    return found


@dataclass
class Expansions:
    """What the patterns of a query stand for: terms with their number of words where they are few, else a table of them."""

    few: dict[str, dict[str, int]]
    many: dict[str, DataFrame]


def expansions(index: Index, patterns: Iterable[str], exact: bool = False) -> Expansions:
    """Of all patterns by one job, which brings NAMED terms of each to the driver at most."""
    patterns = sorted(set(patterns))
    if not patterns:
        return Expansions({}, {})
    tables = {p: expanded(index, p, exact).groupBy("term").agg(F.count("*").alias("times")) for p in patterns}
    rows = reduce(DataFrame.unionByName, (t.select(F.lit(p).alias("pattern"), "term", "times").limit(NAMED + 1) for p, t in tables.items())).collect()
    few: dict[str, dict[str, int]] = {p: {} for p in patterns}
    for r in rows:
        few[r["pattern"]][r["term"]] = r["times"]
    many = {p: tables[p] for p in patterns if len(few[p]) > NAMED}
    return Expansions({p: t for p, t in few.items() if p not in many}, many)


def phrase(index: Index, words: list[str]) -> DataFrame:
    """(doc_id) of the documents that have the words in consecutive places; one word is just a term, none matches nothing.

    Postings of its terms are joined by document, and arrays of places compared: occurrences are never rows.
    """
    if len(words) < 2:
        return postings_of(index, words).select("doc_id")
    # one scan for each distinct word
    own = {w: f"p{n}" for n, w in enumerate(dict.fromkeys(words))}
    tables = [index.postings.where(F.col("term") == w).select("doc_id", F.col("positions").alias(p)) for w, p in own.items()]

    def starts(i: int) -> Column:
        return F.transform(own[words[i]], lambda x: x - F.lit(i))

    common = reduce(F.array_intersect, map(starts, range(len(words))))
    return reduce(lambda a, b: a.join(b, "doc_id"), tables).where(F.size(common) > 0).select("doc_id")


def _literal(index: Index, wanted: list[Operand], known: Expansions) -> DataFrame | None:
    """Documents that have all operands; a pattern without any word is left out, None if nothing is left."""
    alone = sorted({o.words[0] for o in wanted if len(o.words) == 1})
    sets = [phrase(index, list(o.words)) for o in wanted if len(o.words) != 1 and not o.patterns]
    if alone:
        # all single terms in one pass over the postings
        found = postings_of(index, alone).groupBy("doc_id").agg(F.count("*").alias("n"))
        sets.append(found.where(F.col("n") == len(alone)).select("doc_id"))
    for p in (p for o in wanted for p in o.patterns):
        if p in known.many:
            sets.append(index.postings.select("term", "doc_id").join(known.many[p], "term", "left_semi").select("doc_id").distinct())
        elif known.few[p]:
            sets.append(postings_of(index, list(known.few[p])).select("doc_id").distinct())
    return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), sets) if sets else None


def boolean(index: Index, query: str, exact: bool = False) -> DataFrame:
    """(doc_id), ascending: + is or, juxtaposition and, "..." a phrase, * a wildcard."""
    parts = [operands(x, index.stemmed) for x in literals(query)]
    known = expansions(index, (p for part in parts for o in part for p in o.patterns), exact)
    found = [d for part in parts if (d := _literal(index, part, known)) is not None]
    if not found:
        return index.postings.where(F.lit(False)).select("doc_id")
    every = reduce(DataFrame.unionByName, found)
    return every.distinct().orderBy("doc_id")


def query_terms(index: Index, query: str) -> tuple[Counter, list[DataFrame]]:
    """How often each term is asked for, and tables (term, times) of the wildcards that stand for very many.

    A word counts as often as it stands there, a wildcard once for each word it stands for.
    """
    words = query.split()
    # a plain word is normalised when it is read and again when it is looked up
    times = Counter(normal(normal(w, index.stemmed), index.stemmed) for w in words if "*" not in w)
    patterns = [w for w in words if "*" in w]
    known = expansions(index, patterns)
    for p in patterns:
        times.update(known.few.get(p, {}))
    return times, [known.many[p] for p in patterns if p in known.many]


def scores(index: Index, query: str) -> DataFrame:
    """(doc_id, score): sum of times x (1 + ln tf) x ln(1 + N / df) over the query's terms, by the length of the document."""
    times, tables = query_terms(index, query)
    terms = sorted(times)
    rows = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(times[t]).cast("long").alias("times")) for t in terms)) if terms else F.array().cast("array<struct<term:string,times:bigint>>")
    wanted = index.postings.sparkSession.range(1).select(F.explode(rows).alias("q")).select("q.*")
    wanted = reduce(DataFrame.unionByName, tables, wanted).groupBy("term").agg(F.sum("times").alias("times"))
    of, known = index.postings.select("term", "doc_id", "tf"), index.vocabulary.select("term", "df")
    if not tables:
        # all terms are named: the scans can look for them
        of, known = of.where(F.col("term").isin(terms)), known.where(F.col("term").isin(terms))
    weighed = wanted.join(known, "term").select("term", (F.col("times") * F.log(1 + F.lit(float(index.size)) / F.col("df"))).alias("wqt"))
    gathered = of.join(weighed, "term").groupBy("doc_id").agg(F.sum((1 + F.log("tf")) * F.col("wqt")).alias("sum"))
    return gathered.join(index.weights, "doc_id").select("doc_id", (F.col("sum") / F.col("ld")).alias("score"))


def top(scored: DataFrame, k: int = TOP) -> DataFrame:
    """The k best, ties by doc_id."""
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def ranked(index: Index, query: str, k: int = TOP) -> DataFrame:
    """(doc_id, score) of the k best documents."""
    return top(scores(index, query), k)


def with_documents(found: DataFrame, docs: DataFrame, shown: int = 75) -> DataFrame:
    """Results with the documents' columns and a snippet: the first characters, and dots if there are more."""
    cut = F.when(F.length("text") > shown, F.concat(F.substring("text", 1, shown), F.lit("..."))).otherwise(F.col("text"))
    return found.join(docs, "doc_id").withColumn("snippet", cut)
