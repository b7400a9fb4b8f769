"""What a query makes of an index that is kept in a folder, and how its tables are made from large inputs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import kgrams
from textloom.operators import index as operators
from textloom.operators import search
from textloom.operators.index import Kept, gaps, gram_index, indexed, indexed_blocks, merged, occurrences, postings, vocabulary, vocabulary_words

WORDS = ["the", "of", "in", "run-runs", "Things!", "thing", "it's", "--", "naïve’s", "a--b", "&"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = [(n, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60)))) for n in range(120)] + [(120, ""), (121, None), (122, " \n")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def told(df):
    return sorted(map(repr, df.collect()))


def tables(kept):
    return sorted(os.listdir(kept.path)) if os.path.exists(kept.path) else []


@pytest.mark.parametrize("stemmed", [False, True])
def test_a_query_makes_what_it_reads(docs, tmp_path, stemmed):
    kept = Kept(docs, str(tmp_path / "index"), stemmed)
    plain = postings(occurrences(docs, stemmed))
    assert told(kept.vocabulary) == told(vocabulary(plain)) and "postings" not in tables(kept) and "kgrams" not in tables(kept)
    assert told(kept.words) == told(vocabulary_words(docs, stemmed)) and "kgrams" not in tables(kept)
    assert told(kept.weights.select("doc_id", F.round("ld", 9))) == told(operators.document_weights(plain).select("doc_id", F.round("ld", 9)))
    assert "postings" not in tables(kept)
    assert told(kept.postings.select("term", "doc_id", "tf", "positions")) == told(plain)


@pytest.mark.parametrize("size", [1, 50, 1 << 21])
def test_slices_do_not_change_postings(docs, monkeypatch, size):
    monkeypatch.setattr(operators, "SLICE", size)
    assert told(indexed(docs, False)) == told(postings(occurrences(docs, False)))


def test_rows_that_share_an_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "a")], "doc_id long, text string")
    assert told(indexed(docs, False)) == told(postings(occurrences(docs, False)))
    assert told(operators.lexicon(docs, False).select("term", "df", "cf")) == told(vocabulary(postings(occurrences(docs, False))))


def test_blocks_share_documents_or_not(docs):
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    apart = indexed_blocks(even, odd, stemmed=False)
    assert told(apart) == told(indexed(docs, False))
    # no postings move
    assert "hashpartitioning(term" not in apart._jdf.queryExecution().executedPlan().toString()
    both = docs.where("doc_id < 70"), docs.where("doc_id > 50")
    assert told(indexed_blocks(*both, stemmed=False)) == told(merged(*(indexed(b, False) for b in both)))


def test_gaps_are_dealt_by_the_given_number(spark, docs):
    of = indexed(docs, False)
    got = gaps(of, 13)
    assert "13" in [x.split("hashpartitioning(term")[1].split(",")[1].strip(" )") for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(term" in x]
    want = []
    before = {}
    for r in of.orderBy("term", "doc_id").collect():
        want.append((r["term"], r["doc_id"], r["doc_id"] - before.get(r["term"], 0)))
        before[r["term"]] = r["doc_id"]
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("query", [("the", "the"), ("of", "the"), ("in", "the", "of"), ("the", "of", "the")])
def test_a_phrase_has_no_row_for_an_occurrence(docs, tmp_path, query):
    kept = Kept(docs, str(tmp_path / "index"), False)
    found = search.phrase(kept, list(query))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    at = {}
    for r in kept.postings.collect():
        at.setdefault(r["doc_id"], {})[r["term"]] = set(r["positions"])
    want = sorted(d for d, p in at.items() if any(all(s + i in p.get(w, ()) for i, w in enumerate(query)) for s in p.get(query[0], ())))
    assert sorted(r[0] for r in found.collect()) == want and want


def test_grams_are_those_of_the_expression(docs):
    words = vocabulary_words(docs, False)
    own = words.withColumn("grams", kgrams(F.col("word")))
    want = own.select(F.explode("grams").alias("gram"), "word", "term", F.size("grams").alias("size"))
    assert told(gram_index(words)) == told(want)
