"""Masked pseudo-likelihood: a bidirectional window network in numpy predicts every token from both sides; log-probabilities add up.

Words are counted one by one in Spark, so the vocabulary grows with the input. The network has an embedding for each frequent
word at each place of the window and predicts that word itself, by a softmax over classes of words and one over the words of
the class; rarer words share ids by hash, and split their id's probability by their counts. A memory of all runs of words that
occur more than once grows with the input too: a word whose whole run is found elsewhere is predicted from there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import discard, mix64, slices, span_hashes, stored, table, words_of

#: Classes of ids and ids of a class; the last SHARED ids stand for all words but the most frequent ones, by hash.
CLASSES, MEMBERS, SHARED = 64, 64, 512
IDS = CLASSES * MEMBERS
#: Words whose counts every task has; all others of an id share what is left of it evenly.
LISTED = 1 << 16
#: Tokens on either side, hidden units, tokens a step, and the step of Adam; tokens scored at once.
SIDE, HIDDEN, STEP, RATE, SCORED = 2, 16, 8192, 0.01, 1 << 13
#: Rounds in which all workers train and are averaged, and characters of text, over all rounds, that one worker learns from.
ROUNDS, WORKER = 3, 128 << 20
#: Id of the places beyond a text's ends.
EDGE = IDS
#: A word ends a run if its hash divides by RUN; runs of fewer than LEAST words are not remembered. PRIOR: the network's weight against one occurrence elsewhere.
RUN, LEAST, PRIOR = 16, 4, 1.0
#: Runs that make up more than 1 / HOT of all are told to every task, so there are HOT of them at most.
HOT = 20_000
#: Steps of a log-probability as one byte.
FINE = 8.0


@dataclass
class Vocabulary:
    """Sorted hashes of the listed words with their ids and the log of their share of the id; of each id, the log share of one other word, and its occurrences."""

    words: np.ndarray
    ids: np.ndarray
    share: np.ndarray
    rest: np.ndarray
    mass: np.ndarray

    @staticmethod
    def fitted(words: np.ndarray, counts: np.ndarray, total: np.ndarray, distinct: np.ndarray) -> Vocabulary:
        """From the listed words by falling counts, and the occurrences and number of all words by hash modulo SHARED."""
        alone = IDS - SHARED
        own = np.where(np.arange(len(words)) < alone, np.arange(len(words)), alone + (words % np.uint64(SHARED)).astype(np.int64))
        # frequent words are no part of a shared id
        bucket, first = (words % np.uint64(SHARED)).astype(np.int64), np.arange(len(words)) < alone
        total = total - np.bincount(bucket[first], counts[first], SHARED)
        distinct = distinct - np.bincount(bucket[first], minlength=SHARED)
        left = total - np.bincount(bucket[~first], counts[~first], SHARED)
        others = distinct - np.bincount(bucket[~first], minlength=SHARED)
        share = np.where(first, 0.0, np.log(np.maximum(counts, 1) / np.maximum(total[bucket], 1)))
        rest = np.full(IDS, -30.0)
        rest[alone:] = np.log(np.maximum(left, 1) / np.maximum(total, 1) / np.maximum(others, 1))
        mass = np.bincount(own[first], counts[first], IDS).astype(float)
        mass[alone:] += total
        order = np.argsort(words)
        return Vocabulary(words[order], own[order].astype(np.int32), share[order].astype(np.float32), rest.astype(np.float32), mass)

    def __call__(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, log P(word | id)) of each word."""
        if not len(self.words):
            own = (IDS - SHARED + (words % np.uint64(SHARED)).astype(np.int64)).astype(np.int32)
            return own, self.rest[own]
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        own = np.where(known, self.ids[at], IDS - SHARED + (words % np.uint64(SHARED)).astype(np.int32))
        return own, np.where(known, self.share[at], self.rest[own])


#: A bound of logits below which their exponentials and 64 of these together are ordinary numbers of 32 bits.
TAME = 80.0
_ONES = np.ones(max(CLASSES, MEMBERS), np.float32)


def _exponentials(g: np.ndarray, own: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's logit at one place and the sum of its exponentials, which the array then holds; large logits are first taken relative to their row's largest."""
    if not bound < TAME:
        g -= g.max(axis=1)[:, None]
    at = g[np.arange(len(own)), own]
    np.exp(g, out=g)
    return at, g @ _ONES[: g.shape[1]]


class Window:
    """h = tanh(sum of a table's row for the id at each of the 2 x SIDE places); P(id) = softmax(h A + a)[class] softmax(h B[class] + b[class])[id]."""

    SHAPES = ((2 * SIDE, IDS + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, MEMBERS), (CLASSES, MEMBERS))

    def __init__(self, params: np.ndarray | None = None):
        sizes = [math.prod(s) for s in self.SHAPES]
        if params is None:
            rng = np.random.default_rng(11)
            params = np.concatenate([rng.normal(0, 0.1, n) if len(s) > 1 and s != (CLASSES, MEMBERS) else np.zeros(n) for n, s in zip(sizes, self.SHAPES, strict=True)])
        self.params = np.ascontiguousarray(params, np.float32)
        parts = np.split(self.params, np.cumsum(sizes)[:-1])
        self.tables, self.shift, self.upper, self.upper_bias, self.lower, self.lower_bias = (p.reshape(s) for p, s in zip(parts, self.SHAPES, strict=True))

    @staticmethod
    def started(mass: np.ndarray) -> Window:
        """A network that knows how often each id occurs, and no more."""
        net = Window()
        by_class = (mass + 1).reshape(CLASSES, MEMBERS)
        net.upper_bias[:] = np.log(by_class.sum(axis=1) / by_class.sum())
        net.lower_bias[:] = np.log(by_class / by_class.sum(axis=1)[:, None])
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.shift + self.tables[0][context[0]]
        for k in range(1, 2 * SIDE):
            h += self.tables[k][context[k]]
        return np.tanh(h)

    def bounds(self) -> tuple[float, float]:
        """What no logit of a class, or of a word within one, exceeds, as hidden units lie between -1 and 1."""
        upper = np.abs(self.upper).sum(axis=0) + np.abs(self.upper_bias)
        return float(upper.max()), float((np.abs(self.lower).sum(axis=1) + np.abs(self.lower_bias)).max())

    @staticmethod
    def by_class(own: np.ndarray) -> list[tuple[int, int, int]]:
        """(class, start, end) of each class that occurs among sorted ones."""
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        return list(zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(own)], strict=True))

    def members(self, h: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits of the words of each token's class, for tokens sorted by class."""
        g = np.empty((len(h), MEMBERS), np.float32)
        for c, a, b in parts:
            np.matmul(h[a:b], self.lower[c], out=g[a:b])
            g[a:b] += self.lower_bias[c]
        return g

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        if not len(target):
            return np.zeros(0, np.float32)
        # tokens of a class side by side
        order = np.argsort(target.astype(np.uint16), kind="stable")
        target, h, bound = target[order], self.hidden(context[:, order]), self.bounds()
        own = target // MEMBERS
        at, total = _exponentials(h @ self.upper + self.upper_bias, own, bound[0])
        found = at - np.log(total)
        at, total = _exponentials(self.members(h, self.by_class(own)), target % MEMBERS, bound[1])
        found += at - np.log(total)
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        n = len(target)
        # the sum over tokens has no order: tokens of a class side by side
        order = np.argsort(target.astype(np.uint16), kind="stable")
        target, context, bound = target[order], context[:, order], self.bounds()
        own, row = target // MEMBERS, np.arange(n)
        h = self.hidden(context)
        d = Window(np.zeros_like(self.params))
        g = h @ self.upper
        g += self.upper_bias
        g /= _exponentials(g, own, bound[0])[1][:, None]
        g[row, own] -= 1
        d.upper[:], d.upper_bias[:] = h.T @ g, np.ones(n, np.float32) @ g
        dh = g @ self.upper.T
        parts = self.by_class(own)
        g = self.members(h, parts)
        g /= _exponentials(g, target % MEMBERS, bound[1])[1][:, None]
        g[row, target % MEMBERS] -= 1
        for c, a, b in parts:
            d.lower[c] = h[a:b].T @ g[a:b]
            dh[a:b] += g[a:b] @ self.lower[c].T
        d.lower_bias[[c for c, _, _ in parts]] = np.add.reduceat(g, [a for _, a, _ in parts], axis=0)
        h *= h
        dh -= dh * h
        d.shift[:] = np.ones(n, np.float32) @ dh
        for k in range(2 * SIDE):
            # sorted as numbers of 16 bits, by their digits
            order = np.argsort(context[k].astype(np.uint16), kind="stable")
            ids = context[k][order]
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            d.tables[k][ids[first]] = np.add.reduceat(dh[order], first, axis=0)
        d.params /= n
        return d.params


class Learner:
    """Adam over batches of tokens."""

    def __init__(self, params: np.ndarray, done: int = 0):
        self.net, self.step, self.done = Window(params.copy()), 0, done
        self.m, self.v = np.zeros_like(self.net.params), np.zeros_like(self.net.params)

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        d = self.net.gradient(context, target)
        self.step += 1
        self.m *= 0.9
        self.m += 0.1 * d
        self.v *= 0.99
        np.multiply(d, d, out=d)
        d *= 0.01
        self.v += d
        rate = RATE * 30 / (30 + (self.done + self.step) ** 0.5)
        np.sqrt(self.v, out=d)
        d += 1e-8
        np.divide(self.m, d, out=d)
        d *= rate * (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step)
        self.net.params -= d


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(2 x SIDE, tokens): the ids before and after each token, EDGE beyond its text."""
    n = np.diff(first)
    padded = np.full(len(ids) + SIDE * (len(n) + 1), EDGE, np.int32)
    at = np.arange(len(ids)) + np.repeat(SIDE * np.arange(1, len(n) + 1), n)
    padded[at] = ids
    return np.stack([padded[at + k] for k in [*range(-SIDE, 0), *range(1, SIDE + 1)]])


def runs_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of runs of words: one ends at each word whose hash divides by RUN and at a text's last word; short ones are left out."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mixed = mix64(words)
    last = mixed % np.uint64(RUN) == 0
    ends = first[1:][np.diff(first) > 0]
    last[ends - 1] = True
    end = np.flatnonzero(last) + 1
    start = np.concatenate(([0], end[:-1]))
    some = end - start >= LEAST
    return start[some], end[some], span_hashes(mixed, start[some], end[some])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the hash of each distinct word of all documents and its occurrences; tasks count ahead, Spark adds up."""

    def run(batches):
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def told():
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in slices(batches, "text"):
            more, n = np.unique(words_of(batch.column("text"), lower=True)[0], return_counts=True)
            both = np.concatenate((words, more))
            words, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, n)), len(words)).astype(np.int64)
            if len(words) > LISTED * 8:
                yield told()
                words, counts = words[:0], counts[:0]
        yield told()

    return _texts(docs).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """From the counts of all words of all documents; the driver has LISTED words and SHARED sums at most."""
    counts = stored(word_counts(docs))
    top = counts.orderBy(F.desc("n"), "word").limit(LISTED).toPandas()
    # the remainder of the hash as an unsigned number
    shared = F.pmod(F.col("word"), F.lit(SHARED)).cast("int")
    total, distinct = np.zeros(SHARED), np.zeros(SHARED)
    for r in counts.groupBy(shared.alias("id")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        total[r["id"]], distinct[r["id"]] = r["n"], r["words"]
    discard(counts)
    return Vocabulary.fitted(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.float64), total, distinct)


def trained(docs: DataFrame, vocab: Vocabulary) -> Window:
    """One pass over every token of every document, in ROUNDS synchronised rounds, each over the documents of one hash.

    In a round every worker trains from the same parameters, and these are averaged by tokens, parameter by parameter, in Spark;
    the driver has one network's. Workers and their order of texts follow from hashes and the characters of all texts, so
    neither files nor cores change the network.
    """
    text = _texts(docs).withColumn("h", F.xxhash64("text", "doc_id"))
    chars = text.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    workers = max(1, math.ceil(chars / WORKER))
    params, done = Window.started(vocab.mass).params, 0
    for n in range(ROUNDS):

        def run(batches, params=params, done=done):
            learner, seen = Learner(params, done), 0
            for batch in slices(batches, "text"):
                words, first = words_of(batch.column("text"), lower=True)
                ids = vocab(words)[0]
                context = contexts(ids, first)
                seen += len(ids)
                for a in range(0, len(ids), STEP):
                    learner.learn(context[:, a : a + STEP], ids[a : a + STEP])
            if seen:
                values = learner.net.params.astype(np.float64)
                steps = np.full(len(values), learner.step)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * seen), pa.array(np.full(len(values), float(seen))), pa.array(steps)], ["at", "value", "tokens", "steps"])

        mine = text.where(F.pmod("h", F.lit(ROUNDS)) == n)
        dealt = mine.repartitionById(workers, F.pmod(F.shiftright("h", 8), F.lit(workers)).cast("int")).sortWithinPartitions("h", "doc_id").select("text")
        learnt = dealt.mapInArrow(run, "at int, value double, tokens double, steps long")
        got = learnt.groupBy("at").agg((F.sum("value") / F.sum("tokens")).alias("value"), F.max("steps").alias("steps")).toPandas()
        if len(got):
            params = np.zeros(len(got), np.float32)
            params[got["at"].to_numpy()] = got["value"].to_numpy()
            done += int(got["steps"].max())
    return Window(params)


def network_scores(docs: DataFrame, vocab: Vocabulary, net: Window) -> DataFrame:
    """(doc_id, tokens, log_likelihood, runs): the sum over tokens of the network's log P(token | both sides), and each remembered run's hash with its tokens' log-probabilities as bytes."""

    def run(batches):
        for batch in slices(batches, "text"):
            words, first = words_of(batch.column("text"), lower=True)
            ids, logs = vocab(words)
            logs, context = logs.astype(np.float64), contexts(ids, first)
            for a in range(0, len(ids), SCORED):
                logs[a : a + SCORED] += net.log_probabilities(context[:, a : a + SCORED], ids[a : a + SCORED])
            n = np.diff(first)
            total = np.bincount(np.repeat(np.arange(len(n)), n), logs, len(n))
            start, end, h = runs_of(words, first)
            raw = np.clip(np.round(-logs * FINE), 0, 255).astype(np.uint8).tobytes()
            told = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())], ["run", "logs"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, first).astype(np.int32)), told)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(total), lists], ["doc_id", "tokens", "log_likelihood", "runs"])

    return _texts(docs).mapInArrow(run, "doc_id long, tokens long, log_likelihood double, runs array<struct<run:long,logs:binary>>")


def remembered(batches):
    """(row, gain): what a run of `n` occurrences adds to its tokens' log-probabilities: P becomes (n - 1 + PRIOR P) / (n - 1 + PRIOR)."""
    for batch in slices(batches, "logs"):
        n = batch.column("n").to_numpy().astype(np.float64) - 1
        size = pc.binary_length(batch.column("logs")).to_numpy()
        logs = np.frombuffer(b"".join(batch.column("logs").to_pylist()), np.uint8) / -FINE
        other = np.repeat(n, size)
        gain = np.log((other + PRIOR * np.exp(logs)) / (other + PRIOR)) - logs
        owner = np.repeat(np.arange(len(n)), size)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.bincount(owner, gain, len(n)))], ["row", "gain"])


def scored(docs: DataFrame, vocab: Vocabulary, net: Window) -> DataFrame:
    """doc_id, score (the mean log-probability of a token; null without tokens), log_likelihood, network_log_likelihood, tokens.

    Runs of words that occur once more in the corpus, anywhere, count as evidence for each of their words, given all the others.
    """
    kept = stored(network_scores(docs, vocab, net).withColumn("row", F.monotonically_increasing_id()))
    runs = kept.select("row", F.explode("runs").alias("r")).select("row", "r.run", "r.logs")
    counts = stored(runs.groupBy("run").agg(F.count("*").alias("n")).where("n > 1"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") > max(1.0, total / HOT)
    hot = F.broadcast(counts.where(often))
    told = runs.join(hot, "run").unionByName(runs.join(hot, "run", "left_anti").join(counts.where(~often), "run"))
    gains = told.select("row", "n", "logs").mapInArrow(remembered, "row long, gain double").groupBy("row").agg(F.sum("gain").alias("gain"))
    out = kept.drop("runs").join(gains, "row", "left").withColumn("network_log_likelihood", F.col("log_likelihood"))
    out = out.withColumn("log_likelihood", F.col("network_log_likelihood") + F.coalesce("gain", F.lit(0.0)))
    return out.select("doc_id", F.when(F.col("tokens") > 0, F.col("log_likelihood") / F.col("tokens")).alias("score"), "log_likelihood", "network_log_likelihood", "tokens")


def pseudo_likelihoods(docs: DataFrame) -> DataFrame:
    """Vocabulary, network, memory and scores from and of the same documents.

    Tokens are runs of ASCII letters and digits, lower-cased, and non-ASCII bytes. The network's P(token) is P(its id | the two
    tokens on either side) times the token's share of the id, and sums to 1 over all words. Null and wordless texts have no
    token, likelihood 0 and no score. Repeated rows are trained on and scored one by one, and remember each other; an empty
    table gives an empty one; other columns are ignored.
    """
    vocab = vocabulary(docs)
    return scored(docs, vocab, trained(docs, vocab))


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's masked pseudo-likelihood."""
    return pseudo_likelihoods(table(spark, sf_dir, "documents").select("doc_id", "text"))
