"""Quality by a byte-level convolutional network in numpy: learned filters over overlapping chunks, max-pooled, one probability."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import discard, held_out, slices, stored, table, text_bytes

TAPS, FILTERS, SEGMENT = 6, 24, 256
CHUNK = 2 * SEGMENT
#: Most labelled rows of either class that the network is fitted on; one in HELD of them only sets the cut, if both classes have ENOUGH there.
LABELLED, HELD, ENOUGH = 2000, 5, 20
EPOCHS, BATCH, RATE = 4, 128, 0.02
#: How much more it costs to lose a good document than to keep a bad one.
KEEPING = 3.0
#: Positions whose activations are held at once.
BLOCK = 64 * SEGMENT
FOLDS, FOLD, CUT = 5, 0, 0.3


@dataclass
class Network:
    """Filters as a table of (tap, byte, filter), and the logistic layer over pooled filters."""

    filters: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float

    def segments(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest activation of each filter in each segment of each text, first segment of each text and the end).

        A text takes whole segments, one at least; zeros fill them, and filters see zeros beyond a text's end.
        """
        size = np.diff(off)
        n = np.maximum(1, -(-size // SEGMENT))
        first = np.concatenate(([0], np.cumsum(n)))
        padded = np.zeros(first[-1] * SEGMENT + TAPS, np.uint8)
        padded[np.arange(len(raw)) + np.repeat(first[:-1] * SEGMENT - off[:-1], size)] = raw
        ends = first[1:] * SEGMENT
        pooled = np.empty((first[-1], FILTERS), np.float32)
        taps = []
        for k in range(TAPS):
            seen = padded[k : k + first[-1] * SEGMENT].copy()
            for j in range(k):
                seen[ends - 1 - j] = 0
            taps.append(seen)
        total, part = np.empty((BLOCK, FILTERS), np.float32), np.empty((BLOCK, FILTERS), np.float32)
        for a in range(0, first[-1] * SEGMENT, BLOCK):
            b = min(a + BLOCK, first[-1] * SEGMENT)
            t, p = total[: b - a], part[: b - a]
            np.take(self.filters[0], taps[0][a:b], axis=0, out=t, mode="clip")
            for k in range(1, TAPS):
                np.take(self.filters[k], taps[k][a:b], axis=0, out=p, mode="clip")
                t += p
            pooled[a // SEGMENT : b // SEGMENT] = t.reshape(-1, SEGMENT, FILTERS).max(axis=1)
        return pooled, first

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text: the mean logit of its chunks, each two neighbouring segments."""
        raw, off = text_bytes(column)
        pooled, first = self.segments(raw, off)
        alone = np.diff(first) == 1
        chunk = np.maximum(pooled[:-1], pooled[1:]) if len(pooled) > 1 else pooled
        # a chunk starts at every segment but a text's last; a text of one segment is its own chunk
        lasts = first[1:] - 1
        chunk = np.concatenate((chunk, pooled[-1:]))[: len(pooled)]
        chunk[lasts] = pooled[lasts]
        logit = np.maximum(chunk + self.shift, 0) @ self.weights + self.bias
        count = np.diff(first) - 1 + alone
        logit[lasts[~alone]] = 0
        return 1 / (1 + np.exp(-np.clip(np.add.reduceat(logit, first[:-1]) / count, -30, 30))).astype(np.float64)


class Trainer:
    """Steps of Adam on batches of chunks (n x CHUNK bytes). Only where a filter peaks it has a gradient."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.net = Network(rng.normal(0, 0.1, (TAPS, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), 0.0)
        self.params = [self.net.filters, self.net.shift, self.net.weights]
        self.first, self.second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        self.bias1 = self.bias2 = 0.0
        self.steps = 0

    def step(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray, rate: float) -> None:
        net, n = self.net, len(label)
        act = np.zeros((n, CHUNK, FILTERS), np.float32)
        for k in range(TAPS):
            act[:, : CHUNK - k] += net.filters[k][x[:, k:]]
            if k:
                act[:, CHUNK - k :] += net.filters[k][0]
        peak = act.argmax(axis=1)
        top = np.take_along_axis(act, peak[:, None, :], 1)[:, 0]
        h = np.maximum(top + net.shift, 0)
        p = 1 / (1 + np.exp(-(h @ net.weights + net.bias)))
        g = ((p - label) * weight / n).astype(np.float32)
        gh = (g[:, None] * net.weights) * (h > 0)
        gf = np.zeros_like(net.filters)
        for k in range(TAPS):
            pos = peak + k
            byte = np.where(pos < CHUNK, x[np.arange(n)[:, None], np.minimum(pos, CHUNK - 1)], 0)
            np.add.at(gf[k], (byte, np.arange(FILTERS)[None, :].repeat(n, 0)), gh)
        grads = [gf, gh.sum(axis=0), h.T @ g + 1e-4 * net.weights]
        self.steps += 1
        fix = np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for q, d, m, v in zip(self.params, grads, self.first, self.second, strict=True):
            m *= 0.9
            m += 0.1 * d
            v *= 0.999
            v += 0.001 * d * d
            q -= rate * fix * m / (np.sqrt(v) + 1e-6)
        gb = float(g.sum())
        self.bias1, self.bias2 = 0.9 * self.bias1 + 0.1 * gb, 0.999 * self.bias2 + 0.001 * gb * gb
        net.bias -= rate * fix * self.bias1 / (self.bias2**0.5 + 1e-6)


def constant(good: int, bad: int) -> Network:
    """The smoothed share of good documents, where there is nothing to learn from."""
    rate = (good + 1) / (good + bad + 2)
    return Network(np.zeros((TAPS, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), float(np.log(rate / (1 - rate))))


def best_cut(logit: np.ndarray, label: np.ndarray) -> float:
    """Between which logits good and bad documents part best, a lost good one costing KEEPING times a kept bad one; amid the widest of equal gaps."""
    order = np.argsort(logit, kind="stable")
    z, y = logit[order], label[order].astype(float)
    lost = np.concatenate(([0], np.cumsum(y))) / max(1.0, y.sum())
    kept = 1 - np.concatenate(([0], np.cumsum(1 - y))) / max(1.0, (1 - y).sum())
    cost = KEEPING * lost + kept
    edge = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    gap = np.diff(edge)
    cost[gap <= 0] = np.inf
    at = np.flatnonzero(cost <= cost.min() + 1e-12)
    at = at[gap[at].argmax()]
    return float((edge[at] + edge[at + 1]) / 2)


def labelled(docs: DataFrame, labels: DataFrame, name: str, folds: int, fold: int, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled documents of either class outside the held-out fold, by hash of the id.

    A doc_id with several labels has the largest; null ids and null labels are left out.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & ~held_out(folds, fold)).groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = [one.where(F.col("label") == k).orderBy(*order).limit(most) for k in (0, 1)]
    # at most 2 x `most` ids
    picked = F.broadcast(some[0].unionByName(some[1]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id")


def chunks_of(texts: DataFrame) -> DataFrame:
    """(doc_id, label, nth, n, chunk): every chunk of (doc_id, text, label), as the network scores them, and how many its text has."""

    def run(batches):
        for batch in slices(batches, "text"):
            raw, off = text_bytes(batch.column("text"))
            rows = []
            for i, (d, y) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                text = raw[off[i] : off[i + 1]].tobytes()
                n = max(1, -(-len(text) // SEGMENT) - 1)
                rows += [(d, y, k, n, text[k * SEGMENT : k * SEGMENT + CHUNK].ljust(CHUNK, b"\0")) for k in range(n)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "label", "nth", "n", "chunk"])

    return texts.mapInArrow(run, "doc_id long, label int, nth int, n int, chunk binary")


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Network:
    """The network, from every chunk of at most `most` labelled documents of either class, some of which only set its cut.

    Chunks are stored, and stream to the driver in the order of a hash, another one each epoch, so it holds one batch at a
    time, however long the texts. Of rows that repeat an id the least text counts. A document's chunks weigh as one document, both classes alike. The bias is then moved so
    that CUT parts good from bad documents best.
    """
    known = labelled(docs, labels, "quality", FOLDS, FOLD, most).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    texts = stored(known.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == 0))
    size = {(r["held"], r["label"]): r["count"] for r in texts.groupBy("held", "label").count().collect()}
    apart = all(size.get((True, y), 0) >= ENOUGH for y in (0, 1))
    fitted = texts.where("not held") if apart else texts
    good, bad = (sum(n for (held, y), n in size.items() if y == k and not (apart and held)) for k in (1, 0))
    if not good or not bad:
        return constant(good, bad)
    table_ = stored(chunks_of(fitted.select("doc_id", "text", "label")))
    total = table_.count()
    weigh = {1: total / good / 2, 0: total / bad / 2}
    trainer, steps = Trainer(), EPOCHS * -(-total // BATCH)
    for epoch in range(EPOCHS):
        rows = table_.orderBy(F.xxhash64("doc_id", "nth", F.lit(epoch)), "doc_id", "nth").select("chunk", "label", "n").toLocalIterator()
        while batch := list(itertools.islice(rows, BATCH)):
            x = np.frombuffer(b"".join(r["chunk"] for r in batch), np.uint8).reshape(-1, CHUNK)
            label = np.array([r["label"] for r in batch])
            weight = np.array([weigh[r["label"]] / r["n"] for r in batch])
            trainer.step(x, label, weight, RATE * (1 - trainer.steps / steps))
    net = trainer.net
    told = (texts.where("held") if apart else texts).select("doc_id", "text")
    z = scored(told, net).join(texts.select("doc_id", "label"), "doc_id").select("score", "label").toPandas()
    p = np.clip(z["score"].to_numpy(), 1e-12, 1 - 1e-12)
    net.bias += float(np.log(CUT / (1 - CUT)) - best_cut(np.log(p / (1 - p)), z["label"].to_numpy()))
    discard(texts, table_)
    return net


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, text, score): the probability of good quality from the whole text; null texts are empty, and empty texts are a chunk of zeros."""

    def run(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.scores(batch.column("text")), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, net: Network, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns, whose score is at least `cut`; null texts count as empty."""

    def run(batches):
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(net.scores(batch.column("text")) >= cut))

    return docs.mapInArrow(run, docs.schema)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs. Repeated rows are scored alike; other columns are ignored.

    Without labels of both classes the score is the classes' smoothed share; an empty table gives an empty one.
    """
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document."""
    return classified(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
