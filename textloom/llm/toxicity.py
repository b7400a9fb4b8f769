"""Toxicity by weak supervision: a generative model of lexicon and pattern voters labels documents, a linear classifier learns from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import BYTE_CODE, discard, held_out, slices, span_hashes, stored, table, text_bytes, word_spans
from textloom.llm.quality import labelled

# Words of insult and contempt, as independent lexicons: two of English, one of German, French and Spanish.
INSULTS = ["idiot", "moron", "imbecile", "fool", "loser", "scum", "clown", "jerk", "dumbass", "bastard", "asshole", "bitch", "cretin", "degenerate"]
CONTEMPT = ["stupid", "pathetic", "worthless", "disgusting", "trash", "garbage", "filthy", "vile", "hate", "despicable", "ugly", "dumb", "useless", "shit", "fuck", "damn"]
FOREIGN = [
    "idioten", "trottel", "dummkopf", "arschloch", "abschaum", "schlampe", "widerlich", "wertlos", "imbécile", "crétin", "connard", "salope", "ordure", "minable", "dégueulasse",
    "estúpido", "estúpida", "idiotas", "imbécil", "basura", "cabrón", "asqueroso", "asquerosa", "inútil", "despreciable",
]
YOU = ["you", "your", "du", "ihr", "tu", "vous", "usted"]
FOLDS, FOLD, CUT = 3, 1, 0.7
#: Most labelled rows of either class from which voters' word and prefix lists are drawn.
LABELLED = 2000
#: Most words or prefixes on one drawn list, and the least number of documents and the least log odds for one.
LISTED, LEAST, ODDS = 400, 4, 3.0
#: Most documents on either side of even posterior odds that the classifier is fitted on, and its features.
FITTED, FEATURES = 2000, 600
#: Code points of the prefixes that stand for word families.
PREFIXES = (4, 5)
#: Those that vote for toxic, or abstain, then those that vote for clean, or abstain.
TOXIC = ["insults", "contempt", "foreign", "words_often", "words_seldom", "prefixes_4", "prefixes_5", "hits", "dense", "addressed", "exclaims"]
CLEAN = ["unlisted", "clean_words", "clean_prefixes"]
VOTERS = TOXIC + CLEAN
#: Drawn words in the first list, of those that most toxic texts have.
OFTEN = 40
#: Listed words that make a hit, share of listed words that is dense, exclamation marks, words of a text without a listed one, and words typical of clean texts that make a vote.
HITS, DENSE, MARKS, SOME, TYPICAL = 3, 0.02, 3, 20, 3
PAIRS = 12


# ---- features ---------------------------------------------------------------------------------------------------


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each feature, its kind, its text): the words (kind 0) and their prefixes of 4 and 5 code points (kinds 1 and 2).

    A word that is not longer than a prefix has none. Texts are to be in lower case.
    """
    raw, off = text_bytes(column)
    start, end, first = word_spans(raw, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    nth = np.searchsorted(lead, start)
    spans, kinds, docs = [(start, end)], [np.zeros(len(start), np.int8)], [doc]
    for kind, size in enumerate(PREFIXES, 1):
        stop = lead[np.minimum(nth + size, max(0, len(lead) - 1))] if len(lead) else end
        ok = (nth + size < len(lead)) & (stop < end)
        spans.append((start[ok], stop[ok]))
        kinds.append(np.full(int(ok.sum()), kind, np.int8))
        docs.append(doc[ok])
    begins, ends = (np.concatenate(x) for x in zip(*spans, strict=True))
    kind = np.concatenate(kinds)
    # a prefix is no word: the kind is part of the hash
    return span_hashes(BYTE_CODE[raw], begins, ends) ^ (kind.astype(np.uint64) << np.uint64(62)), kind, np.concatenate(docs)


def distinct_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, each feature once a text."""
    h, kind, doc = word_features(column)
    order = np.lexsort((h, doc))
    h, kind, doc = h[order], kind[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    return h[new], kind[new], doc[new]


def word_hashes(words: list[str]) -> np.ndarray:
    raw, off = text_bytes(pa.array(words, pa.string()))
    return span_hashes(BYTE_CODE[raw], off[:-1], off[1:])


class Lookup:
    """Places of hashes in a short sorted list; a table over 16 bits turns almost all others away at once."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.sorted & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of `hashes` are listed, their place in the list)."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(self.sorted) or not len(at):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        ok = self.sorted[place] == hashes[at]
        return at[ok], self.order[place[ok]]


# ---- label model ------------------------------------------------------------------------------------------------


@cache
def all_votes(voters: int) -> np.ndarray:
    """Every pattern of votes, by its number."""
    return ((np.arange(1 << voters)[:, None] >> np.arange(voters)) & 1).astype(float)


@dataclass
class LabelModel:
    """p(y, votes) ~ exp(c y + sum_i (b_i + a_i y) v_i + sum_ij r_ij v_i v_j): propensities b, accuracies a, correlations r."""

    c: float
    b: np.ndarray
    a: np.ndarray
    pairs: list[tuple[int, int]]
    r: np.ndarray

    def logs(self) -> np.ndarray:
        """Unnormalised log probability of each (y, pattern of votes)."""
        n = len(self.b)
        votes = all_votes(n)
        low = votes @ self.b + sum((r * votes[:, i] * votes[:, j] for (i, j), r in zip(self.pairs, self.r, strict=True)), np.zeros(1 << n))
        return np.stack((low, low + self.c + votes @ self.a))

    def accuracy(self) -> np.ndarray:
        """P(y = 1 | the voter votes) of each voter, as estimated."""
        g = self.logs()
        p = np.exp(g - g.max())
        both = p @ all_votes(len(self.b))
        return both[1] / both.sum(axis=0)

    def posterior(self) -> np.ndarray:
        """P(y = 1 | pattern) of each pattern."""
        g = self.logs()
        return 1 / (1 + np.exp(np.clip(g[0] - g[1], -50, 50)))


def fit_label_model(counts: np.ndarray, voters: int, base: float, clean: int = 0, rounds: int = 60, steps: int = 25) -> LabelModel:
    """Expectation maximisation over all patterns of votes, counted over all documents; no label of a document is used.

    The first rounds take the voters as independent given y; the pairs that then covary most within a class get correlations.
    The start says that every voter is better than chance, the last `clean` of them for y = 0, and that `base` of all documents
    are positive. Each maximisation is a few steps of gradient ascent on the exact likelihood, with a weak pull to the start
    that keeps the classes' meaning.
    """
    votes = all_votes(voters)
    share = counts / max(1.0, counts.sum())
    logit = lambda p: np.log(p / (1 - p))
    fires = np.clip(share @ votes, 1e-3, 1 - 1e-3)
    side = np.where(np.arange(voters) < voters - clean, 3.0, -3.0)
    m = LabelModel(float(logit(base)) - 3.0, logit(np.clip(np.where(side > 0, fires / 4, fires), 1e-4, 0.9)), side, [], np.zeros(0))
    start = m.a.copy()
    for n in range(rounds):
        post = m.posterior()
        want = np.stack((share * (1 - post), share * post))
        if n == rounds // 2:
            cov = np.zeros((voters, voters))
            for y in (0, 1):
                mass = want[y].sum()
                mean = want[y] @ votes / max(mass, 1e-9)
                both = votes.T @ (want[y][:, None] * votes) / max(mass, 1e-9)
                scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
                cov += mass * np.abs(both - np.outer(mean, mean)) / np.outer(scale, scale)
            upper = [(cov[i, j], i, j) for i in range(voters) for j in range(i + 1, voters)]
            m.pairs = [(i, j) for v, i, j in sorted(upper, reverse=True)[:PAIRS] if v > 0.02]
            m.r = np.zeros(len(m.pairs))
        products = np.stack([votes[:, i] * votes[:, j] for i, j in m.pairs], axis=1) if m.pairs else np.zeros((1 << voters, 0))
        for _ in range(steps):
            g = m.logs()
            p = np.exp(g - g.max())
            p /= p.sum()
            d = want - p
            m.c += float(d[1].sum()) * 2
            m.b += 2 * (d.sum(axis=0) @ votes)
            m.a += 2 * (d[1] @ votes) - 0.001 * (m.a - start)
            m.r += 2 * (d.sum(axis=0) @ products) - 0.001 * m.r
    return m


# ---- Spark ------------------------------------------------------------------------------------------------------


def _lowered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def _feature_rows(batches):
    """Distinct features of each text."""
    for batch in slices(batches, "text"):
        h, kind, doc = distinct_features(batch.column("text"))
        label = batch.column("label").to_numpy()[doc]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(label.astype(np.int32))], ["h", "kind", "label"])


def drawn_lists(docs: DataFrame, labels: DataFrame) -> dict[tuple[int, bool], np.ndarray]:
    """By kind of feature, those most typical of toxic (True) and of clean texts among the bounded sample of labelled rows, by log odds; the most frequent first."""
    some = labelled(docs, labels, "toxic", FOLDS, FOLD, LABELLED).select("doc_id", F.lower("text").alias("text"), "label")
    sample = stored(some)
    seen = sample.groupBy("label").count().collect()
    total = {r["label"]: r["count"] for r in seen}
    count = sample.mapInArrow(_feature_rows, "h long, kind int, label int").groupBy("kind", "h").agg(F.sum("label").alias("pos"), F.count("*").alias("all"))
    odds = F.log((F.col("pos") + 0.1) / (total.get(1, 0) + 0.2)) - F.log((F.col("all") - F.col("pos") + 0.1) / (total.get(0, 0) + 0.2))
    count = stored(count.where(F.col("all") >= LEAST).withColumn("odds", odds).withColumn("neg", F.col("all") - F.col("pos")))
    out = {}
    for kind in range(1 + len(PREFIXES)):
        for toxic, n, far in ((True, "pos", F.col("odds") >= ODDS), (False, "neg", F.col("odds") <= -ODDS)):
            top = count.where((F.col("kind") == kind) & (F.col(n) >= LEAST) & far)
            rows = top.orderBy(F.desc(n), "h").limit(LISTED).select("h").collect()
            out[kind, toxic] = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    discard(sample, count)
    return out


def voter_lists(drawn: dict[tuple[int, bool], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all listed features, bits of the voters that list each)."""
    bits: dict[int, int] = {}
    words = drawn[0, True]
    lists = {
        "insults": word_hashes(INSULTS), "contempt": word_hashes(CONTEMPT), "foreign": word_hashes(FOREIGN), "words_often": words[:OFTEN], "words_seldom": words[OFTEN:],
        "prefixes_4": drawn[1, True], "prefixes_5": drawn[2, True], "clean_words": drawn[0, False], "clean_prefixes": np.concatenate((drawn[1, False], drawn[2, False])),
    }
    for voter, hashes in lists.items():
        for h in hashes.tolist():
            bits[h] = bits.get(h, 0) | 1 << VOTERS.index(voter)
    return np.array(list(bits), np.uint64), np.array(list(bits.values()), np.int64)


def patterns(docs: DataFrame, hashes: np.ndarray, bits: np.ndarray) -> DataFrame:
    """(doc_id, votes): one bit for each of VOTERS, set where it votes and clear where it abstains.

    Lists vote on any of their features, those of clean texts on TYPICAL of them. `hits` and `dense` vote on many listed words,
    `addressed` on insults put to someone, `exclaims` on exclamation marks with a listed word, `unlisted` on texts of some
    length without any.
    """
    find, you = Lookup(hashes), Lookup(word_hashes(YOU))
    bit = {v: 1 << i for i, v in enumerate(VOTERS)}
    listed = sum(bit[v] for v in ("insults", "contempt", "foreign", "words_often", "words_seldom", "prefixes_4", "prefixes_5"))
    insults = bit["insults"] | bit["contempt"] | bit["foreign"]

    def run(batches):
        for batch in slices(batches, "text"):
            h, kind, doc = word_features(batch.column("text"))
            at, place = find(h)
            n = batch.num_rows
            count = lambda some: np.bincount(some, minlength=n)  # noqa: E731, B023
            votes = np.zeros(n, np.int64)
            np.bitwise_or.at(votes, doc[at], bits[place] & listed)
            words = count(doc[kind == 0])
            hits = count(doc[at][(kind[at] == 0) & (bits[place] & listed > 0)])
            marks = pc.count_substring(batch.column("text"), "!").to_numpy(zero_copy_only=False)
            said = count(doc[you(h)[0]]) > 0
            some = votes & listed > 0
            for voter, yes in (
                ("hits", hits >= HITS), ("dense", hits > np.maximum(1, DENSE * words)), ("addressed", (votes & insults > 0) & said), ("exclaims", (marks >= MARKS) & some),
                ("unlisted", ~some & (words >= SOME)),
                *((v, count(doc[at][bits[place] & bit[v] > 0]) >= TYPICAL) for v in ("clean_words", "clean_prefixes")),
            ):
                votes |= np.where(yes, bit[voter], 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(votes)], ["doc_id", "votes"])

    return _lowered(docs).mapInArrow(run, "doc_id long, votes long")


@dataclass
class Classifier:
    """A logistic model over the presence of words and prefixes."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, column: pa.Array, find: Lookup) -> np.ndarray:
        h, _, doc = word_features(column)
        at, place = find(h)
        seen = np.unique(doc[at] * max(1, len(self.hashes)) + place)
        return self.bias + np.bincount(seen // max(1, len(self.hashes)), self.weights[seen % max(1, len(self.hashes))], len(column))


def fit_classifier(features: np.ndarray, h: np.ndarray, doc: np.ndarray, target: np.ndarray) -> Classifier:
    """Logistic regression on posterior labels over the presence (h, doc) of the chosen features."""
    base = float(np.clip(target.mean(), 1e-3, 1 - 1e-3)) if len(target) else 0.5
    features = np.sort(features)
    x = np.zeros((len(target), len(features)), np.float32)
    x[doc, np.searchsorted(features, h)] = 1
    w, b = np.zeros(len(features)), float(np.log(base / (1 - base)))
    m1, m2 = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for step in range(1, 301 if len(target) else 0):
        p = 1 / (1 + np.exp(-(x @ w.astype(np.float32) + b)))
        d = (p - target) / len(target)
        g = np.append(d.astype(np.float32) @ x + 1e-4 * w, d.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return Classifier(features, w, b)


def label_model(docs: DataFrame, labels: DataFrame) -> tuple[LabelModel, DataFrame, np.ndarray]:
    """The label model over the votes on all documents, those votes (doc_id, votes), stored, and how often each pattern occurs."""
    hashes, bits = voter_lists(drawn_lists(docs, labels))
    voted = stored(patterns(docs, hashes, bits))
    counts = np.zeros(1 << len(VOTERS))
    for r in voted.groupBy("votes").count().collect():  # at most 2 to the number of voters
        counts[r["votes"]] = r["count"]
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(FOLDS, FOLD)).agg(F.avg("toxic")).first()[0]
    return fit_label_model(counts, len(VOTERS), float(np.clip(known if known is not None else 0.05, 0.01, 0.5)), len(CLEAN)), voted, counts


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Lists from labelled rows, patterns of votes over all documents, the label model over their counts, the classifier over its posteriors.

    The label model sees every document; the classifier is fitted on at most FITTED documents on either side, by hash of the id.
    """
    model, voted, counts = label_model(docs, labels)
    post = model.posterior()
    seen = np.flatnonzero(counts)
    even = seen[post[seen] > 0.5].tolist()
    side = F.col("votes").isin(even) if even else F.lit(False)
    order = [F.xxhash64("doc_id"), "doc_id"]
    one = voted.where("doc_id is not null").groupBy("doc_id").agg(F.max("votes").alias("votes"))
    picked = F.broadcast(one.where(side).orderBy(*order).limit(FITTED).unionByName(one.where(~side).orderBy(*order).limit(FITTED)))
    sample = _lowered(docs).join(picked, "doc_id").withColumn("label", F.col("votes").cast("int"))

    def run(batches):
        for batch in slices(batches, "text"):
            h, _, doc = distinct_features(batch.column("text"))
            ids, votes = batch.column("doc_id").to_numpy()[doc], batch.column("label").to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h.view(np.int64)), pa.array(votes.astype(np.int32))], ["doc_id", "h", "votes"])

    rows = stored(sample.mapInArrow(run, "doc_id long, h long, votes int"))
    ids = np.array(sorted((r["doc_id"], r["votes"]) for r in picked.collect()), np.int64).reshape(-1, 2)
    target = post[ids[:, 1]]
    base = float(np.clip(target.mean(), 1e-3, 1 - 1e-3)) if len(target) else 0.5
    # only the features whose presence tells most about the posterior come to the driver, and where they are
    posts = docs.sparkSession.createDataFrame([(v, float(post[v])) for v in seen.tolist()], "votes int, p double")
    p = F.col("p")
    tell = rows.join(F.broadcast(posts), "votes").groupBy("h").agg(F.count("*").alias("n"), F.sum(p).alias("pos")).where(F.col("n") >= LEAST)
    gain = F.abs(F.col("pos") - base * F.col("n")) / F.sqrt(F.col("n") * (base * (1 - base)))
    best = np.array([r["h"] for r in tell.orderBy(gain.desc(), "h").limit(FEATURES).select("h").collect()], np.int64)
    got = rows.where(F.col("h").isin(best.tolist())).select("doc_id", "h").toArrow()
    doc = np.searchsorted(ids[:, 0], got["doc_id"].to_numpy())
    return fit_classifier(best.view(np.uint64), got["h"].to_numpy().view(np.uint64), doc, target)


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score): the classifier's probability for each whole text; null texts are empty and have the probability of no feature."""
    find = Lookup(model.hashes)

    def run(batches):
        for batch in slices(batches, "text"):
            p = 1 / (1 + np.exp(-np.clip(model.logits(batch.column("text"), find), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return _lowered(docs).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Classifier, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns, whose score is below `cut`; null texts count as empty."""
    find = Lookup(model.hashes)
    names = docs.columns

    def run(batches):
        for batch in slices(batches, batch_text):
            keep = 1 / (1 + np.exp(-np.clip(model.logits(batch.column(batch_text), find), -30, 30))) < cut
            yield batch.select(names).filter(pa.array(keep))

    batch_text = "_lower" + "_" * max(map(len, names))
    return docs.withColumn(batch_text, F.lower(F.coalesce("text", F.lit("")))).mapInArrow(run, docs.schema)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs. Repeated rows are scored alike; other columns are ignored.

    Without labelled rows only the fixed lexicons and patterns vote; an empty table gives an empty one.
    """
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    return classified(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
