"""Packing along a space-filling curve: documents are ordered by the Hilbert key of their hashed vectors, and their ids cut into sequences."""

from __future__ import annotations

import json
import math
import unicodedata
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import mix64, slices, span_hashes, stored, table, words_of

TOKENIZER = "byte_bpe_50k.json"
LENGTH, END = 2048, 1
BUCKETS, DIMS, BITS = 256, 3, 10
#: Distinct pieces of text whose ids a Python worker remembers.
REMEMBERED = 1_000_000
#: Characters of text in one range of the curve, which one task orders, and the most ranges; rows whose keys give the bounds of ranges, or 20 a range.
RANGE_CHARS, MOST_RANGES, BOUND_ROWS = 16 << 20, 50_000, 20_000

# ---- order ------------------------------------------------------------------------------------------------------


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve (uint64) of integer points (n x dims, each below 2**bits), by Skilling's transform."""
    x = axes.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            up = (x[i] & np.uint64(q)) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out


def _projection() -> np.ndarray:
    """Random signs (buckets x dims), fixed by hash."""
    return np.where(mix64(np.arange(BUCKETS * DIMS, dtype=np.uint64)) & np.uint64(1), 1.0, -1.0).reshape(BUCKETS, DIMS)


def curve_keys(column: pa.Array) -> np.ndarray:
    """Hilbert key of each text: counts of its lower-case words in hashed buckets, damped, scaled to unit length, projected."""
    words, first = words_of(column, lower=True)
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    counts = np.bincount(doc * BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    v = np.sqrt(counts)
    v /= np.maximum(np.sqrt(counts.sum(axis=1)), 1)[:, None]
    point = np.clip((v @ _projection()) / 4 + 0.5, 0, 1 - 1e-9)
    return hilbert((point * (1 << BITS)).astype(np.int64), BITS)


def _places(batch: pa.RecordBatch) -> np.ndarray:
    """The Hilbert key of each text above 33 bits of a hash of id and text, so that ties and copies spread over the curve's cell."""
    salt = batch.column("salt").to_numpy().view(np.uint64) >> np.uint64(31)
    return ((curve_keys(batch.column("text")) << np.uint64(33)) | salt).view(np.int64)


def _placed(mean: float):
    """The place of each text, once for each quarter of a mean text that it has, so that quantiles part characters, not texts."""

    def run(batches):
        for batch in slices(batches, "text", 1 << 22):
            size = pc.utf8_length(batch.column("text")).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(_places(batch), np.ceil((size + 1) / (mean / 4 + 1)).astype(np.int64)))], ["place"])

    return run


# ---- tokens -----------------------------------------------------------------------------------------------------

#: Code points of Unicode's White_Space property.
SPACES = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Letters after an apostrophe that make a piece with it.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


class Tokens:
    """Byte-pair ids of texts: pieces are found in numpy, distinct pieces are encoded by the tokenizer once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ranked = self._ranked(path)
        self.kinds = self._kinds()
        self.forget()

    @staticmethod
    def _kinds() -> np.ndarray:
        kind = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k in "LN":
                kind[c] = LETTER if k == "L" else NUMBER
        kind[SPACES] = SPACE
        return kind

    @staticmethod
    def _ranked(path: str):
        """The same merges in tiktoken, which encodes a single piece several times faster; None where ids don't rise with merges."""
        import tiktoken

        model = json.loads(Path(path).read_text())["model"]
        vocab = model["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made):
            return None
        # byte-level vocabularies write the bytes that don't print as code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"] for t in json.loads(Path(path).read_text())["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)

    def pieces(self, points: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where pieces start, in the code points of all texts; a text's first code point starts one.

        A piece is an apostrophe with an ending, or a run of letters, of numbers or of others with at most one blank
        before it, or a run of white space without the last where something other than white space follows.
        """
        n = len(points)
        kind = self.kinds[points]
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        start |= edge[:-1]
        # the last white space before something else: its own piece, or a blank that belongs to what follows
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        quote = np.flatnonzero(points[:-1] == 39)
        if len(quote):
            alone = ~edge[quote + 1] & (kind[quote + 1] != OTHER) & (edge[quote] | ((kind[np.maximum(quote - 1, 0)] != OTHER) & (points[np.maximum(quote - 1, 0)] != 32)))
            quote = quote[alone]
            for ending in ENDINGS:
                k = len(ending)
                at = quote[quote + k < n]
                for j, ch in enumerate(ending, 1):
                    at = at[(points[at + j] == ord(ch)) & ~edge[at + j]]
                start[at + 1] = False
                after = at + k + 1
                start[after[after < n]] = True
        return np.flatnonzero(start)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; where each text's begin and the end)."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        start = self.pieces(points, off)
        end = np.append(start[1:], len(points))
        hashes = span_hashes(points.astype(np.uint64) + np.uint64(1), start, end)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        entry = np.fromiter((self.known.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(entry < 0)
        if len(new):
            if len(self.known) + len(new) > REMEMBERED:
                self.forget()
                new = np.arange(len(distinct))
            entry[new] = self._learn(distinct[new].tolist(), [joined[a:b] for a, b in zip(start[where[new]].tolist(), end[where[new]].tolist(), strict=True)])
        size = self.size[entry][back]
        ends = np.cumsum(size)
        flat = np.arange(ends[-1]) + np.repeat(self.begin[entry][back] - (ends - size), size)
        first = np.searchsorted(start, off)
        return self.pool[flat], np.concatenate(([0], ends))[first]

    def _learn(self, hashes: list[int], pieces: list[str]) -> np.ndarray:
        got = [*map(self.ranked.encode_ordinary, pieces)] if self.ranked else [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        n, size = len(self.known), np.array([len(x) for x in got])
        flat = np.array([i for x in got for i in x], np.uint32)
        if n + len(got) > len(self.size):
            grow = max(len(self.size), len(got))
            self.begin, self.size = (np.concatenate((x, np.zeros(grow, np.int64))) for x in (self.begin, self.size))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)))
        self.pool[self.used : self.used + len(flat)] = flat
        self.begin[n : n + len(got)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(got)] = size
        self.used += len(flat)
        self.known.update(zip(hashes, range(n, n + len(got)), strict=True))
        return np.arange(n, n + len(got))


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """This worker's tokenizer."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


# ---- sequences --------------------------------------------------------------------------------------------------

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def closing(left: int) -> list[int]:
    """Lengths of the last sequences: powers of two that add up to what is left, so that none of them is padded."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


class Cuts:
    """Where sequences of `length` ids lie in `total` ids, one after the other."""

    def __init__(self, total: int, length: int):
        self.length, self.full = length, total // length * length
        self.last = np.cumsum([self.full, *closing(total - self.full)])

    def at(self, place: int) -> tuple[int, int, int]:
        """(sequence, offset, ids from there to its end) at one place."""
        if place < self.full:
            return place // self.length, place % self.length, self.length - place % self.length
        n = int(np.searchsorted(self.last, place, "right")) - 1
        return self.full // self.length + n, place - int(self.last[n]), int(self.last[n + 1]) - place

    def pieces(self, place: int, ids: np.ndarray):
        """(start, length, crc, sequence, offset) of each piece of a document whose ids begin at a place."""
        raw, at = ids.astype("<u4").tobytes(), 0
        while at < len(ids):
            sequence, offset, room = self.at(place + at)
            n = min(room, len(ids) - at)
            yield at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), sequence, offset
            at += n


def _encoded(path: str, bounds: np.ndarray):
    """Each text's ids with the closing id, as little-endian numbers of 16 or 32 bits, its place, and its range of the curve."""

    def run(batches):
        for batch in slices(batches, "text", 1 << 22):
            own = tokens(path)
            ids, first = own.ids(batch.column("text").to_pylist())
            ids = ids.astype(own.kind)
            end = np.array([END], own.kind).tobytes()
            held = [ids[a:b].tobytes() + end for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            place = _places(batch)
            part = np.searchsorted(bounds, place, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(place), pa.array(part), pa.array(held, pa.binary())], ["doc_id", "place", "range", "ids"])

    return run


def _counted(width: int):
    """Adds to rows in order how many ids of their range stand before them."""

    def run(batches):
        own, before = None, 0
        for batch in batches:
            n = np.array([len(x) for x in batch.column("ids").to_pylist()], np.int64) // width
            part = batch.column("range").to_numpy()
            start = np.empty(len(n), np.int64)
            for i, (r, k) in enumerate(zip(part.tolist(), n.tolist(), strict=True)):
                if r != own:
                    own, before = r, 0
                start[i] = before
                before += k
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("range"), pa.array(start), pa.array(n), batch.column("ids")], ["doc_id", "range", "before", "n", "ids"])

    return run


def _cut(first: np.ndarray, total: int, length: int, kind: np.dtype):
    def run(batches):
        cuts, names = Cuts(total, length), [c.split()[0] for c in PIECES.split(", ")]
        for batch in slices(batches, "ids", 1 << 22):
            rows = []
            for doc_id, r, before, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "range", "before", "n", "ids")), strict=True):
                rows += [(doc_id, start, k, crc, n, sequence, offset) for start, k, crc, sequence, offset in cuts.pieces(int(first[r]) + before, np.frombuffer(raw, kind))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    return run


def packed(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of documents in sequences of at most `length` ids, neighbours along the curve in the same sequence.

    Every document's ids end with id 1. All documents stand in one order along the curve, and a sequence is the next `length` of
    all their ids, so all are full but the last ones, which are each a power of two long: nothing is padded. Ranges of the curve
    only deal out the work: each task orders one and counts its ids, the ranges' sums say where each begins, and no result
    depends on the bounds. These come from the keys of a hash sample of documents, as a range partitioner's do, and how many
    there are from the characters of all texts.

    Null texts are empty and hold id 1 alone. Rows that repeat a doc_id, copies and ties are packed one by one. Null ids stay
    null; an empty table gives no piece. Other columns are ignored.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = text.withColumn("salt", F.xxhash64("doc_id", "text"))
    size = text.agg(F.count("*"), F.sum(F.length("text").cast("long"))).first()
    ranges = min(MOST_RANGES, max(1, math.ceil((size[1] or 0) / RANGE_CHARS)))
    found = []
    if ranges > 1:
        share = max(1, size[0] // max(BOUND_ROWS, 20 * ranges))
        some = keyed.where(F.pmod("salt", F.lit(share)) == 0).mapInArrow(_placed(size[1] / size[0]), "place long")
        found = some.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    bounds = np.unique(np.array(found, np.int64))
    kind = tokens(path).kind
    ids = keyed.mapInArrow(_encoded(path, bounds), "doc_id long, place long, range int, ids binary")
    ordered = ids.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("place", "doc_id", "ids")
    counted = stored(ordered.mapInArrow(_counted(kind.itemsize), "doc_id long, range int, before long, n long, ids binary"))
    first = np.zeros(len(bounds) + 2, np.int64)
    for r in counted.groupBy("range").agg(F.sum("n").alias("n")).collect():  # at most MOST_RANGES rows
        first[r["range"] + 1] = r["n"]
    first = np.cumsum(first)
    return counted.mapInArrow(_cut(first, int(first[-1]), length, kind), PIECES)


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
