"""The positional inverted index: occurrences, postings, vocabulary, document weights, words and k-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.functions.porter2 import stem, stem_udf
from textloom.functions.text import clean, grams_of, hyphen_parts, tokens
from textloom.plans.parser import clean_word

#: Bytes of text whose occurrences one task is to gather, characters of them that are held in arrays at once, and tokens whose terms a task remembers.
TASK_BYTES, SLICE, KNOWN = 16 << 20, 2 << 20, 1 << 18
#: Words whose k-grams one task sorts.
TASK_WORDS = 1 << 17


def words_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, word): cleaned tokens; a token of punctuation alone is the empty word."""
    return tokens(docs).select("doc_id", "pos", clean(F.col("raw")).alias("word"))


def occurrences(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """(doc_id, pos, term): a word's hyphen parts share its position; stems are looked up by distinct part, and not made distinct again."""
    parts = words_of(docs).select("doc_id", "pos", F.explode(hyphen_parts(F.col("word"))).alias("part"))
    if not stemmed:
        return parts.withColumnRenamed("part", "term")
    stems = parts.select("part").distinct().select("part", stem_udf("part").alias("term"))
    return parts.join(stems, "part").select("doc_id", "pos", "term")


def by_document(docs: DataFrame) -> DataFrame:
    """docs with each document in one task, so that what is counted by document needs no further shuffle: texts move, not occurrences.

    How many tasks follows from the bytes of all texts, as their occurrences will be many times that.
    """
    return docs.repartition(partitions_for(docs), "doc_id")


def postings(found: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions): one row for each term of each document, positions ascending with repeats."""
    own = found.groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return own.select("term", "doc_id", F.size("positions").alias("tf"), "positions")


def frequencies(found: DataFrame) -> DataFrame:
    """(term, doc_id, tf): postings where positions aren't asked for, counted without lists."""
    return found.groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf")).select("term", "doc_id", "tf")


class Terms(dict):
    """Of each token the number of its entry, found when it is first asked for; an entry is a token's terms."""

    def __init__(self, stemmed: bool):
        super().__init__()
        self.stemmed, self.terms, self.numbers, self.whole = stemmed, [], {}, []
        self.words, self.entries, self.lists = {}, [], []

    def __missing__(self, token: str) -> int:
        word = clean_word(token)
        if word not in self.words:
            parts = dict.fromkeys([*word.split("-"), word]) if "-" in word else (word,)
            mine = []
            for t in map(stem, parts) if self.stemmed else parts:
                if t not in self.numbers:
                    self.numbers[t] = len(self.terms)
                    self.terms.append(t)
                    self.whole.append(False)
                mine.append(self.numbers[t])
            self.words[word] = len(self.entries)
            self.entries.append(len(mine))
            self.lists += mine
            # the word itself comes last
            self.whole[mine[-1]] = True
        self[token] = self.words[word]
        return self[token]


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) of a bounded number of characters, but for one text."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for n, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                ids.append(n)
                texts.append(text)
                size += len(text)
            if size >= SLICE:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _gathered(batches: Iterator[pa.RecordBatch], stemmed: bool):
    """(ids, names, whole, key, first, pos) of slices of texts: documents, terms in order and whether they are whole words; of each
    occurrence, by term and place of the document, rank of the term x documents + document; where another key begins; positions.

    A token is cleaned and stemmed once while a task remembers it.
    """
    known = Terms(stemmed)
    for ids, texts in texts_of(batches):
        if len(known) > KNOWN:
            known = Terms(stemmed)
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        entry = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if not len(entry):
            continue
        many, lists = np.array(known.entries), np.array(known.lists)
        doc = np.repeat(np.arange(len(split)), sizes)
        pos = np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # a token of several terms stands there once for each
        own = many[entry]
        term = (np.cumsum(many) - many)[entry]
        if own.max() > 1:
            doc, pos = np.repeat(doc, own), np.repeat(pos, own)
            term = np.repeat(term, own) + np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
        term = lists[term]
        there = np.zeros(len(known.terms), bool)
        there[term] = True
        used = sorted(np.flatnonzero(there).tolist(), key=known.terms.__getitem__)
        rank = np.zeros(len(there), np.int64)
        rank[used] = np.arange(len(used))
        key = rank[term] * len(split) + doc
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        yield ids, pa.array([known.terms[n] for n in used], pa.string()), np.array([known.whole[n] for n in used]), key, first, pos[order]


def gathered(docs: DataFrame, stemmed: bool = True, positions: bool = True) -> DataFrame:
    """(term, doc_id, tf, positions) of each row's own text, in numpy; without `positions` these aren't told."""
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        for ids, names, _, key, first, pos in _gathered(batches, stemmed):
            term, doc = np.divmod(key[first], len(ids))
            out = [names.take(pa.array(term)), pa.array(ids, kind).take(pa.array(doc)), pa.array(np.diff(first, append=len(key)).astype(np.int32))]
            if positions:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(pos.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, ["term", "doc_id", "tf", "positions"][: len(out)])

    name = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"term string, doc_id {name}, tf int" + (", positions array<int>" if positions else ""))


def lexicon(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """(term, df, cf, whole) of all documents, `whole` for terms that are also unsplit words; tasks count ahead, Spark adds up."""

    def run(batches):
        for ids, names, whole, key, first, _ in _gathered(batches, stemmed):
            term = key // len(ids)
            df, cf = np.bincount(term[first], minlength=len(names)), np.bincount(term, minlength=len(names))
            yield pa.RecordBatch.from_arrays([names, pa.array(df), pa.array(cf), pa.array(whole)], ["term", "df", "cf", "whole"])

    told = by_document(docs).select("doc_id", "text").mapInArrow(run, "term string, df long, cf long, whole boolean")
    every = told.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.bool_or("whole").alias("whole"))
    # rows that share a doc_id are one document
    return every if not repeats(docs) else every.drop("df").join(vocabulary(counted(docs, stemmed)).select("term", "df"), "term").select("term", "df", "cf", "whole")


def repeats(docs: DataFrame) -> bool:
    """Whether a doc_id stands in more than one row."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def indexed(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """Postings of documents, each document's in one task. Rows that share a doc_id are one document, whose positions are joined."""
    own = gathered(by_document(docs), stemmed)
    return merged(own) if repeats(docs) else own


def counted(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """(term, doc_id, tf): postings without positions."""
    own = gathered(by_document(docs), stemmed, False)
    return own.groupBy("term", "doc_id").agg(F.sum("tf").cast("int").alias("tf")) if repeats(docs) else own


def vocabulary(of: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return of.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def document_weights(of: DataFrame) -> DataFrame:
    """(doc_id, ld): the length of each document's vector of 1 + ln tf, over all its terms."""
    return of.groupBy("doc_id").agg(F.sqrt(F.sum(F.pow(1 + F.log("tf"), F.lit(2)))).alias("ld"))


def vocabulary_words(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """(word, term): the distinct cleaned words, unsplit, with their stems."""
    own = words_of(docs).select("word").distinct()
    return own.select("word", (stem_udf("word") if stemmed else F.col("word")).alias("term"))


def gram_index(words: DataFrame) -> DataFrame:
    """(gram, word, term, size): the words of each k-gram, and how many distinct k-grams a word has; by gram and word, TASK_WORDS words of a task at a time."""

    def told(rows):
        rows.sort()
        grams = [grams_of(w) for w, _ in rows]
        size = np.fromiter(map(len, grams), np.int32, len(grams))
        names = sorted(set().union(*grams))
        rank = {g: n for n, g in enumerate(names)}
        gram = np.fromiter(map(rank.__getitem__, chain.from_iterable(grams)), np.int64, int(size.sum()))
        key = gram * len(rows) + np.repeat(np.arange(len(rows)), size)
        key.sort()
        name, word, term = pa.array(names, pa.string()), pa.array([w for w, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())
        for n in range(0, len(key), 1 << 16):
            at, own = np.divmod(key[n : n + (1 << 16)], len(rows))
            yield pa.RecordBatch.from_arrays([name.take(pa.array(at)), word.take(pa.array(own)), term.take(pa.array(own)), pa.array(size[own])], ["gram", "word", "term", "size"])

    def run(batches):
        rows = []
        for batch in batches:
            rows += zip(batch.column("word").to_pylist(), batch.column("term").to_pylist(), strict=True)
            if len(rows) >= TASK_WORDS:
                yield from told(rows)
                rows = []
        if rows:
            yield from told(rows)

    return words.select("word", "term").mapInArrow(run, "gram string, word string, term string, size int")


def merged(*parts: DataFrame) -> DataFrame:
    """Postings of blocks of documents as one: positions of a term in a document that stand in several blocks are joined."""
    every = reduce(DataFrame.unionByName, parts)
    own = every.groupBy("term", "doc_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return own.select("term", "doc_id", F.size("positions").alias("tf"), "positions")


def indexed_blocks(*blocks: DataFrame, stemmed: bool = True) -> DataFrame:
    """Postings of blocks of documents, indexed one by one, as one: only those of documents that stand in several blocks move, to be merged."""
    parts = [indexed(b, stemmed) for b in blocks]
    ids = reduce(DataFrame.unionByName, (b.select("doc_id").distinct() for b in blocks))
    several = ids.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if several.isEmpty():
        return reduce(DataFrame.unionByName, parts)
    alone = (p.join(several, "doc_id", "left_anti").select(*p.columns) for p in parts)
    return reduce(DataFrame.unionByName, [*alone, merged(*(p.join(several, "doc_id", "left_semi").select(*p.columns) for p in parts))])


def partitions_for(docs: DataFrame) -> int:
    """How many tasks the occurrences of documents ask for, by the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))


def gaps(of: DataFrame, tasks: int) -> DataFrame:
    """(term, doc_id, gap): each document's distance from the one before it in the term's postings, the first's from 0, by a given number of tasks."""
    before = F.lag("doc_id", 1, 0).over(Window.partitionBy("term").orderBy("doc_id"))
    return of.select("term", "doc_id").repartition(tasks, "term").select("term", "doc_id", (F.col("doc_id") - before).alias("gap"))


def saved(table: DataFrame, path: str, *by: str) -> DataFrame:
    """The table as it is read back, its files sorted by some columns. Tasks write what they made, so no rows move."""
    (table.sortWithinPartitions(*by) if by else table).write.mode("overwrite").parquet(path)
    return table.sparkSession.read.parquet(path)


def dealt(words: DataFrame) -> DataFrame:
    """Words in as many tasks as their number asks for."""
    return words.repartition(max(1, math.ceil(words.count() / TASK_WORDS)), "word")


@dataclass
class Index:
    """Tables of one corpus. Documents with a null or blank text are counted, and found by nothing."""

    postings: DataFrame
    words: DataFrame
    size: int
    stemmed: bool = True
    saved_vocabulary: DataFrame | None = None
    saved_weights: DataFrame | None = None
    saved_grams: DataFrame | None = None

    @staticmethod
    def build(docs: DataFrame, stemmed: bool = True) -> Index:
        """docs: (doc_id, text); other columns are ignored."""
        own = docs.select("doc_id", "text")
        return Index(indexed(own, stemmed), vocabulary_words(own, stemmed), own.count(), stemmed)

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self.saved_vocabulary if self.saved_vocabulary is not None else vocabulary(self.postings)

    @cached_property
    def weights(self) -> DataFrame:
        return self.saved_weights if self.saved_weights is not None else document_weights(self.postings)

    @cached_property
    def kgrams(self) -> DataFrame:
        """(gram, word, term, size)."""
        return self.saved_grams if self.saved_grams is not None else gram_index(self.words)

    def write(self, path: str) -> Index:
        """All tables, sorted within their files, so that pages can be found by their bounds; returns the index read back."""
        spark = self.postings.sparkSession
        of = saved(self.postings, f"{path}/postings", "term", "doc_id")
        saved(vocabulary(of.select("term", "tf")), f"{path}/vocabulary", "term")
        saved(document_weights(of.select("doc_id", "tf")), f"{path}/weights")
        words = saved(self.words, f"{path}/words")
        saved(gram_index(dealt(words)), f"{path}/kgrams")
        saved(spark.range(1).select(F.lit(self.size).cast("long").alias("size"), F.lit(self.stemmed).alias("stemmed")), f"{path}/facts")
        return Index.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        facts = spark.read.parquet(f"{path}/facts").first()
        of, words, vocab, weights, grams = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "words", "vocabulary", "weights", "kgrams"))
        return Index(of, words, facts["size"], facts["stemmed"], vocab, weights, grams)


class Kept(Index):
    """The index of a table of documents, in a folder. Each of its tables is made from all texts and written when it is first asked for."""

    def __init__(self, docs: DataFrame, path: str, stemmed: bool = True):
        self.docs, self.path, self.stemmed = docs.select("doc_id", "text"), path, stemmed

    @cached_property
    def size(self) -> int:
        return self.docs.count()

    @cached_property
    def postings(self) -> DataFrame:
        return saved(indexed(self.docs, self.stemmed), f"{self.path}/postings", "term", "doc_id")

    def counted(self) -> DataFrame:
        """(term, doc_id, tf), from the postings if they are there by now, else without their positions."""
        return self.postings.select("term", "doc_id", "tf") if "postings" in vars(self) else counted(self.docs, self.stemmed)

    @cached_property
    def lexicon(self) -> DataFrame:
        return saved(lexicon(self.docs, self.stemmed), f"{self.path}/lexicon", "term")

    @cached_property
    def vocabulary(self) -> DataFrame:
        if "postings" in vars(self) and "lexicon" not in vars(self):
            return saved(vocabulary(self.postings.select("term", "tf")), f"{self.path}/vocabulary", "term")
        return self.lexicon.select("term", "df", "cf")

    @cached_property
    def weights(self) -> DataFrame:
        return saved(document_weights(self.counted().select("doc_id", "tf")), f"{self.path}/weights")

    @cached_property
    def words(self) -> DataFrame:
        if not self.stemmed:
            return self.lexicon.where("whole").select(F.col("term").alias("word"), "term")
        return saved(vocabulary_words(self.docs, self.stemmed), f"{self.path}/words")

    @cached_property
    def kgrams(self) -> DataFrame:
        return saved(gram_index(dealt(self.words)), f"{self.path}/kgrams")
