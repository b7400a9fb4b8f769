"""The five-document corpus and its hand-computed expectations."""

import json

import pytest

from textloom.engine import SearchEngine
from textloom.functions.porter2 import stem
from textloom.operators import search, spelling
from textloom.operators.index import Index, document_weights, merged, occurrences, postings
from textloom.plans.parser import clean_word, normal, operands, pattern_grams

# The corpus, queries and expectations that results must match.
BODIES = ["This is a test document.", "Another testing document is here.", "Here we go, a third one.", "Test test! Test test test.", "Document testing goes here."]
POSTINGS = {
    "a": {0: [2], 2: [3]}, "anoth": {1: [0]}, "document": {0: [4], 1: [2], 4: [0]}, "go": {2: [2]}, "goe": {4: [2]}, "here": {1: [4], 2: [0], 4: [3]},
    "is": {0: [1], 1: [3]}, "one": {2: [5]}, "test": {0: [3], 1: [1], 3: [0, 1, 2, 3, 4], 4: [1]}, "third": {2: [4]}, "this": {0: [0]}, "we": {2: [1]},
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(BODIES)), "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return Index.build(docs).write(str(tmp_path_factory.mktemp("index")))


def as_dict(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["term"], {})[r["doc_id"]] = list(r["positions"])
    return out


def ids(df):
    return [r["doc_id"] for r in df.collect()]


def test_positional_index(index):
    assert as_dict(index.postings) == POSTINGS


def test_blocks_merge_to_the_same_index(docs):
    parts = [postings(occurrences(docs.where(f"doc_id % 3 = {k}"))) for k in range(3)]
    assert as_dict(merged(*parts)) == POSTINGS


def test_weights_and_words(index, docs):
    got = {r["doc_id"]: r["ld"] for r in index.weights.collect()}
    want = {0: 5**0.5, 1: 5**0.5, 2: 6**0.5, 3: 2.6094379124341005, 4: 2.0}
    assert got == pytest.approx(want)
    assert {r["word"] for r in index.words.collect()} == set("a another document go goes here is one test testing third this we".split())
    assert index.size == 5


def test_frequencies(index):
    assert [r["df"] for r in search.frequencies(index, ["test", "here", "gabagaool", "document"]).orderBy("nth").collect()] == [4, 3, 0, 3]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("test", [0, 1, 3, 4]), ('"third one"', [2]), ('"test document is here"', [1]), ("is test", [0, 1]), ("test + document", [0, 1, 3, 4]),
        ('"test document"+this', [0, 1]), ("goes", [4]), ("SPELLDRONG", []), ("thi*", [0, 2]), ("*e", [1, 2, 4]), ("*cu*en*", [0, 1, 4]), ("docu* here", [1, 4]),
        ("teadjfkafadfadfcvbczz*", []), ("zzz + test", [0, 1, 3, 4]), ("zzz* here", [1, 2, 4]), ("* here", [1, 2, 4]), ('""', []), ("", []), ('"is* zzz"', [0, 1]),
        ('a "test document', [0]), ('foo"bar baz"', []),
    ],
)
def test_boolean(index, query, want):
    assert ids(search.boolean(index, query)) == want


def test_ranked(index):
    def scored(q):
        return {r["doc_id"]: r["score"] for r in search.ranked(index, q).collect()}

    assert scored("test") == pytest.approx({3: 0.810930, 4: 0.405465, 0: 0.362659, 1: 0.362659}, abs=1e-6)
    assert ids(search.ranked(index, "test")) == [3, 4, 0, 1]
    assert scored("document test a") == pytest.approx({0: 1.361552, 4: 0.895880, 3: 0.810930, 1: 0.801299, 2: 0.511438}, abs=1e-6)
    assert scored("*e") == pytest.approx(scored("here we one"))
    assert set(scored("*cume*")) == {0, 1, 4} == set(scored("*s"))
    assert set(scored("docu* test a")) == {0, 1, 2, 3, 4}
    assert scored("ooogabb*") == {}
    assert scored("test test")[3] == pytest.approx(2 * 0.810930, abs=1e-5)


def test_corrections_stand_where_the_words_stood(spark):
    docs = spark.createDataFrame([(0, "the theater here there")], "doc_id long, text string")
    index = Index.build(docs, stemmed=False)
    assert spelling.corrected(index, "th theater") == "the theater"
    assert spelling.corrected(index, "(th) + theater, th") == "(the) + theater, the"
    assert spelling.corrected(index, "  th   theater ", ranked=True) == "the theater"


@pytest.mark.parametrize(
    ("query", "ranked", "want"),
    [
        ("test", False, None), ("tesp", False, "test"), ("test documant thard is", False, "test document third is"), ('"tesp documant herr"+this', False, '"test document here"+this'),
        ("BV*%#@QDJZ", False, None), ("test documant herr", True, "test document here"), ("test dfkadfkahd", True, None),
    ],
)
def test_spelling(index, query, ranked, want):
    assert spelling.corrected(index, query, ranked) == want


def test_words():
    assert stem("ConSPIcuous") == "conspicu"
    assert clean_word("$!@'test%^") == "test"
    assert clean_word("te@#!st") == "te@#!st"
    assert clean_word("'te's't'") == "test"
    assert normal("TesT-HOUsE!!!") == "test-hous"
    assert operands("don't go", False)[0].words == ("dont", "go")
    assert pattern_grams("*") == set()
    assert pattern_grams("docu*") == {"$do", "doc", "ocu"}


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("consign", "consign"), ("consigned", "consign"), ("consistency", "consist"), ("consolation", "consol"), ("knightly", "knight"), ("skies", "sky"), ("dying", "die"),
        ("generate", "generat"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("falling", "fall"), ("relational", "relat"), ("cried", "cri"), ("ties", "tie"),
        ("gas", "gas"), ("kiwis", "kiwi"), ("happy", "happi"), ("say", "say"), ("by", "by"), ("controlling", "control"), ("agreed", "agre"), ("nationally", "nation"), ("succeed", "succeed"),
    ],
)
def test_stems(word, want):
    assert stem(word) == want


def test_odd_tokens(spark):
    docs = spark.createDataFrame([(0, "a--b"), (1, "--"), (2, "run-runs"), (3, "it's naïve’s ½ x² é!"), (4, ""), (5, None), (6, "    \n")], "doc_id long, text string")
    got = as_dict(postings(occurrences(docs)))
    assert got[""] == {0: [0], 1: [0]}
    assert got["a--b"] == {0: [0]} and got["a"] == {0: [0]} and got["b"] == {0: [0]}
    assert got["run"] == {2: [0, 0]} and got["run-run"] == {2: [0]}
    assert got["it"] == {3: [0]} or got["its"] == {3: [0]}
    assert all(got[w] == {3: [n]} for w, n in (("½", 2), ("x²", 3), ("é", 4)))
    assert {d for t in got.values() for d in t} == {0, 1, 2, 3}
    assert document_weights(postings(occurrences(docs.where("false")))).count() == 0


def test_engine(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    for n, body in enumerate(BODIES, 1):
        (folder / f"doc{n}.json").write_text(json.dumps({"title": f"Fake {n}", "url": "https://www.fake.url", "body": body}))
    engine = SearchEngine.build(spark, str(folder), str(tmp_path / "index"))
    assert engine.test() == {"response": "hello"}
    told = engine.summary()
    assert (told["doc_count"], told["term_count"], told["files"], told["terms"][:3]) == (5, 12, [f"doc{n}.json" for n in range(1, 6)], ["a", "anoth", "document"])
    got = engine.query("tesp documant")
    assert got["doc_ids"] == [] and got["spell_corrected"] == "test document"
    got = engine.query("document test a", ranked=True)
    assert got["doc_ids"] == [0, 4, 3, 1, 2] and got["files"][0] == "doc1.json" and got["contents"]["doc1.json"] == BODIES[0] and len(got["scores"]) == 5
    letters = [(r["letter"], r["term"]) for r in engine.terms_by_letter().collect()]
    assert [t for x, t in letters if x == "t"] == ["test", "third", "this"] and "" not in dict(letters)
    first = engine.query("test", size=3)
    assert first["doc_ids"] == [0, 1, 3] and first["next"] == 3
    rest = engine.query("test", size=3, after=first["next"])
    assert rest["doc_ids"] == [4] and rest["next"] is None
    assert [r["doc_id"] for r in engine.each("test")] == [0, 1, 3, 4]
    assert json.loads(engine.query_json(":stem goes")) == {"term": "goes", "stemmed_term": "goe"}
    assert engine.stem("goes")["stemmed_term"] == "goe"
    assert json.loads(engine.query_json("goes"))["doc_ids"] == [4]
