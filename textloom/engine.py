"""One object for a corpus: build or open its index, show terms, answer queries, stem."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from textloom.functions.porter2 import stem
from textloom.operators import search, spelling
from textloom.operators.index import Index
from textloom.sources.ingest import read_json

#: Results and names on one page.
PAGE = 100


class SearchEngine:
    def __init__(self, docs: DataFrame, index: Index):
        self.docs, self.index = docs, index

    @staticmethod
    def build(spark: SparkSession, corpus: str | DataFrame, path: str | None = None) -> SearchEngine:
        """From a folder of JSON documents or a table (doc_id, text, ...); with `path`, the index is written there and read back."""
        docs = read_json(spark, corpus) if isinstance(corpus, str) else corpus
        index = Index.build(docs)
        return SearchEngine(docs, index.write(path) if path else index)

    @staticmethod
    def open(spark: SparkSession, docs: DataFrame, path: str) -> SearchEngine:
        return SearchEngine(docs, Index.read(spark, path))

    def test(self) -> dict:
        return {"response": "hello"}

    def names(self) -> str:
        """The column that names a document: its file, or its id where documents aren't files."""
        return "file" if "file" in self.docs.columns else "doc_id"

    def summary(self, size: int = PAGE) -> dict:
        """Counts, and the first page of file names and of terms; `files` and `terms` are tables of all."""
        files = [r[0] for r in self.files().limit(size).collect()]
        terms = [r[0] for r in self.terms().limit(size).collect()]
        return {"files": files, "doc_count": self.index.size, "terms": terms, "term_count": self.index.vocabulary.count()}

    def files(self) -> DataFrame:
        return self.docs.select(self.names()).orderBy(self.names())

    def terms(self) -> DataFrame:
        return self.index.vocabulary.select("term").orderBy("term")

    def terms_by_letter(self) -> DataFrame:
        """(letter, term), in order, without the empty term."""
        return search.terms_by_letter(self.index)

    def results(self, query: str, ranked: bool = False, k: int = search.TOP) -> DataFrame:
        """(doc_id, file, snippet, and score if ranked) of all results, as a table; texts are cut to snippets."""
        found = search.ranked(self.index, query, k) if ranked else search.boolean(self.index, query)
        rows = search.with_documents(found, self.docs)
        return rows.select("doc_id", F.col(self.names()).cast("string").alias("file"), "snippet", *(["score"] if ranked else []))

    def query(self, query: str, ranked: bool = False, k: int = search.TOP, size: int = PAGE, after: int | None = None) -> dict:
        """One page of results, with the query as it may have been meant. Ranked results are the k best, best first.

        Boolean results come by doc_id, `size` at a time: `next` is the doc_id to give as `after` for the page that follows, or None.
        """
        found = self.results(query, ranked, k)
        if ranked:
            rows = [r.asDict() for r in found.orderBy(F.desc("score"), "doc_id").collect()]
        else:
            if after is not None:
                found = found.where(F.col("doc_id") > after)
            rows = [r.asDict() for r in found.orderBy("doc_id").limit(size + 1).collect()]
        more, rows = not ranked and len(rows) > size, rows if ranked else rows[:size]
        return {
            "doc_ids": [r["doc_id"] for r in rows],
            "files": [r["file"] for r in rows],
            "contents": {r["file"]: r["snippet"] for r in rows},
            "ranked": ranked,
            "scores": [r["score"] for r in rows] if ranked else [],
            "spell_corrected": spelling.corrected(self.index, query, ranked),
            "next": rows[-1]["doc_id"] if more else None,
        }

    def each(self, query: str) -> Iterator[Row]:
        """All results of a boolean query one by one, a partition of them at a time in memory."""
        return self.results(query).toLocalIterator()

    def query_json(self, query: str, ranked: bool = False) -> str:
        """The answer to a line as it is typed: `:stem word` is the word's stem, all else a query."""
        if ":stem" in query:
            return json.dumps(self.stem(query.replace(":stem", "").strip()))
        return json.dumps(self.query(query, ranked), default=str)

    def stem(self, term: str) -> dict:
        return {"term": term, "stemmed_term": stem(term)}
