"""Random queries over a random corpus, held against plain Python over lists; and properties of what runs on the driver."""

import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions.porter2 import stem
from textloom.operators import search
from textloom.operators.index import Index
from textloom.plans.parser import clean_word, literals, normal, operands, pattern_grams

WORDS = ["tree", "tr-ee", "ant", "Antler", "lant", "&", "it's", "nt", "tanton", "trant!"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    return [[rng.choice(WORDS) for _ in range(rng.randrange(1, 25))] for _ in range(40)]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    docs = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(corpus)], "doc_id long, text string")
    return Index.build(docs, stemmed=False).write(str(tmp_path_factory.mktemp("index")))


def occurrences(words):
    out = []
    for pos, w in enumerate(words):
        w = clean_word(w)
        out += [(pos, t) for t in ({w, *w.split("-")} if "-" in w else {w})]
    return out


def grams(word):
    p = f"${word}$"
    return {p[i : i + k] for k in (1, 2, 3) for i in range(len(p) - k + 1)}


def boolean(corpus, query):
    vocabulary = {clean_word(w) for d in corpus for w in d}
    found = set()
    for literal in literals(query):
        sets = []
        for o in operands(literal, False):
            if o.patterns:
                need = pattern_grams(o.patterns[0])
                words = {w for w in vocabulary if need and need <= grams(w)}
                if words:
                    sets.append({n for n, d in enumerate(corpus) if words & {t for _, t in occurrences(d)}})
                continue
            at = [set(occurrences(d)) for d in corpus]
            sets.append({n for n, d in enumerate(at) if o.words and any(all((p + i, w) in d for i, w in enumerate(o.words)) for p in range(25))})
        if sets:
            found |= set.intersection(*sets)
    return sorted(found)


@pytest.mark.parametrize("query", ["tree", "ant tree", '"ant tree"', '"tree & ant"', "tan* ant + nt", "*ant*", '"tree tree" + its', "& it's", "zzz + ee", "ant*er lant", "*rant", '"tr-ee ant" + "ant nt tree"'])
def test_boolean(index, corpus, query):
    assert [r[0] for r in search.boolean(index, query).collect()] == boolean(corpus, query)


@pytest.mark.parametrize("query", ["tree", "ant tree & ee", "tree tree ant", "tan* ant", "zzz"])
def test_ranked(index, corpus, query):
    vocabulary = {clean_word(w) for d in corpus for w in d}
    terms = Counter()
    for w in query.split():
        terms.update([v for v in vocabulary if pattern_grams(w) <= grams(v)] if "*" in w else [normal(w, False)])
    tf = [Counter(t for _, t in occurrences(d)) for d in corpus]
    df = Counter(t for c in tf for t in c)
    scores = {}
    for n, c in enumerate(tf):
        if any(t in c for t in terms):
            length = math.sqrt(sum((1 + math.log(k)) ** 2 for k in c.values()))
            scores[n] = sum(m * (1 + math.log(c[t])) * math.log(1 + len(corpus) / df[t]) for t, m in terms.items() if t in c) / length
    want = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
    got = [(r[0], r[1]) for r in search.ranked(index, query).collect()]
    assert [s for _, s in got] == pytest.approx([s for _, s in want])
    assert {n for n, _ in got} <= set(scores)


@given(st.text(max_size=20))
def test_cleaning_is_idempotent_but_for_ends_that_apostrophes_hid(word):
    once = clean_word(word)
    assert "'" not in once and once == once.lower()
    assert clean_word(clean_word(once)) == clean_word(once) or "'" in word


@given(st.text(alphabet="abcdefghilmnorstuvy'", max_size=14))
@settings(max_examples=300)
def test_stems_are_short_and_stable_in_type(word):
    assert isinstance(stem(word), str) and len(stem(word)) <= len(word) + 1


@given(st.text(alphabet="ab*$", min_size=1, max_size=10))
def test_every_gram_of_a_pattern_is_in_words_that_match_it(pattern):
    word = pattern.replace("*", "ab")
    assert pattern_grams(pattern) <= grams(word)


@given(st.text(alphabet="ab\"'+ *\\", max_size=12))
def test_any_query_can_be_read(query):
    for literal in literals(query):
        assert all(o.words == () or not o.patterns for o in operands(literal))
