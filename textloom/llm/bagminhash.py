"""Near duplicates by BagMinHash: weighted Jaccard signatures of word-shingle multisets, banding, exact verification."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import MULT, discard, fresh, mix64, slices, stored, table, words_of

TINY = 2.0**-53


def uniform(key: np.ndarray) -> np.ndarray:
    """In (0, 1], from 53 bits of a hash."""
    return ((key >> np.uint64(11)).astype(np.float64) + 1.0) * TINY


def shingle_bag(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of one text and how often each occurs; a text of fewer words is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(width, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * MULT + words[i : n - k + 1 + i]
    h.sort()
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[at], np.diff(np.append(at, len(h)))


def signatures(key: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """BagMinHash registers (float64, docs x registers) of many bags at once.

    Element `key` with integer weight w of text `doc` owns the points (x, y) with y < w of a Poisson process of unit rate
    over [0, inf) x [0, inf), dealt to registers by hash; a register holds the least x. Equal points serve every text that
    has the element, so two registers agree with the probability of the weighted Jaccard similarity. Weights are split at
    0, 1, 2, 4, 8, ...: each dyadic band of weights is a process of its own, whose points come in ascending x, so that work
    stops once x passes the largest register. Within a band a process is the sum of two of half its rate, over the lower and
    the upper half of its weights, and so on down to single weights: one bit of a point's hash a level says which half it is
    of, so its bits, read from the top, are its height, and a half beyond the weight loses all its points at once.
    """
    out = np.full((docs, registers), np.inf)
    if not len(key):
        return out
    key, weight, doc = key.copy(), weight.astype(np.int64), doc.astype(np.int64)
    # dyadic bands [0, 1), [1, 2), [2, 4), ... up to the weight
    parts = [(key, weight, doc, np.zeros(len(key), np.int64), np.ones(len(key), np.int64))]
    low = 1
    while True:
        more = np.flatnonzero(weight > low)
        if not len(more):
            break
        n = len(more)
        parts.append((key[more], weight[more], doc[more], np.full(n, low), np.full(n, 2 * low)))
        low *= 2
    key, weight, doc, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    seed = mix64(key ^ mix64(lo.astype(np.uint64) * MULT + hi.astype(np.uint64)))
    level = np.round(np.log2(hi - lo)).astype(np.uint64)
    x = np.zeros(len(key))
    step = np.zeros(len(key), np.uint64)
    flat = out.reshape(-1)
    r = np.uint64(registers)
    many = 1
    while len(x):
        # the next `many` points of each process, in ascending order
        ahead = np.arange(many, dtype=np.uint64)
        a = mix64(seed[:, None] + (step[:, None] + ahead) * np.uint64(0xD6E8FEB86659FD93))
        at = x[:, None] + np.cumsum(-np.log(uniform(a)), axis=1) / (hi - lo)[:, None]
        b = mix64(a ^ MULT)
        # the halves that a point is of, from the top level down to a single weight
        height = (b >> np.uint64(1)) >> (np.uint64(63) - level)[:, None]
        hit = lo[:, None] + height.astype(np.int64) < weight[:, None]
        slot = doc[:, None] * registers + (mix64(b) % r).astype(np.int64)
        np.minimum.at(flat, slot[hit], at[hit])
        x, step = at[:, -1], step + np.uint64(many)
        some, back = np.unique(doc, return_inverse=True)
        live = x <= out[some].max(axis=1)[back]
        seed, step, x, lo, hi, level, weight, doc = (v[live] for v in (seed, step, x, lo, hi, level, weight, doc))
        many = min(16, many * 4)
    return out


# ---- Spark ------------------------------------------------------------------------------------------------------

REGISTERS, ROWS, WIDTH, THRESHOLD = 128, 4, 5, 0.8
#: Most members, and bytes of their bags, of either side of a block of pairs; blocks are dealt by hash, so these are means.
BLOCK, BLOCK_BYTES = 256, 8 << 20

SKETCHED = "row long, doc_id long, digest binary, bands array<long>"


def _sketch(width: int, registers: int, rows: int):
    def run(batches):
        for batch in slices(batches, "text"):
            words, first = words_of(batch.column("text"))
            bags = [shingle_bag(words[a:b], width) for a, b in itertools.pairwise(first)]
            sizes = np.array([len(k) for k, _ in bags])
            key = np.concatenate([k for k, _ in bags])
            sig = signatures(key, np.concatenate([w for _, w in bags]), np.repeat(np.arange(len(bags)), sizes), len(bags), registers).view(np.uint64)
            band = np.zeros((len(bags), registers // rows), np.uint64) + np.arange(registers // rows, dtype=np.uint64)
            for r in range(rows):
                band = mix64(band ^ sig[:, r::rows])
            has = sizes > 0
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(has * (registers // rows)))).astype(np.int32), pa.array(band[has].reshape(-1).view(np.int64)))
            digest = pa.array([xxhash.xxh3_128_digest(k.tobytes() + w.tobytes()) for k, w in bags], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), digest, lists], ["row", "doc_id", "digest", "bands"])

    return run


def _bags(width: int):
    """Each text's multiset as sorted distinct hashes of (shingle, occurrence), so that set overlap is multiset overlap."""

    def run(batches):
        for batch in slices(batches, "text"):
            words, first = words_of(batch.column("text"))
            out = []
            for a, b in itertools.pairwise(first):
                key, n = shingle_bag(words[a:b], width)
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.append(np.sort(mix64(np.repeat(key, n) + nth.astype(np.uint64) * MULT)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "bag"])

    return run


def similarity(p: np.ndarray, q: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags as `_bags` writes them."""
    both = np.concatenate((p, q))
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / max(1, len(both) - same)


def _overlap(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        sims = []
        for x, y in zip(batch.column("x_bag"), batch.column("y_bag"), strict=True):
            sims.append(similarity(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(sims, pa.float64())], ["x", "y", "sim"])


def shared_counts(queries: list[np.ndarray], data: list[np.ndarray]):
    """For each query in turn, how many members it shares with each of the data; exact, by one sorted list of all data's members."""
    sizes = np.array([len(d) for d in data])
    keys, of = np.concatenate(data), np.repeat(np.arange(len(data)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    for own in queries:
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield np.bincount(of[at], minlength=len(data))


def _cross(threshold: float):
    """Exact links between a query block and a data block of one cell, as many as merge components."""
    import pandas as pd

    def run(key, got):
        q, d = got[got["query"]], got[~got["query"]]
        merged: dict[int, int] = {}

        def top(c: int) -> int:
            while c in merged:
                c = merged[c]
            return c

        nodes, comps, bags = d["node"].to_numpy(), d["comp"].to_numpy(), [np.frombuffer(x, np.uint64) for x in d["bag"]]
        own = [np.frombuffer(x, np.uint64) for x in q["bag"]]
        if not len(bags) or not len(own):
            return pd.DataFrame([], columns=["x", "y"]).astype("int64")
        sizes = np.array([len(b) for b in bags])
        out = []
        for x, comp, bag, same in zip(q["node"], q["comp"], own, shared_counts(own, bags), strict=True):
            for m in np.flatnonzero((same / (len(bag) + sizes - same) >= threshold) & (comps != comp)).tolist():
                u, v = top(comp), top(comps[m])
                if u != v:
                    merged[u] = v
                    out.append((x, nodes[m]))
        return pd.DataFrame(out, columns=["x", "y"]).astype("int64")

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): each node of `edges` (x, y) with the least node it is linked to, by alternating large and small stars.

    Every round is one aggregate and one join on each side and is stored; the driver sees a count and a checksum only.
    """
    e = stored(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = stored(large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        discard(e, large)
        e = small
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        before = now


def _classed(text: DataFrame, threshold: float, width: int, registers: int, rows: int) -> DataFrame:
    """(row, doc_id, class_id, copies_id, class_no) for a stored table (row, doc_id, text), text in lower case and not null, rows unique."""
    sketched = stored(text.mapInArrow(_sketch(width, registers, rows), SKETCHED))
    # equal bags are one node, named by the least of their rows
    classes = stored(sketched.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("copies_id")))
    node = sketched.join(classes.select(F.col("node").alias("row")), "row", "left_semi").where(F.size("bands") > 0)
    place = node.select(F.col("row").alias("node"), F.explode("bands").alias("bucket"))
    shared = stored(place.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("bucket", "n"))
    inside = stored(place.join(shared, "bucket").distinct())
    central = inside.groupBy("node").agg(F.sum("n").alias("seen"))
    hub = stored(inside.join(central, "node").groupBy("bucket").agg(F.max(F.struct("seen", (-F.col("node")).alias("minus"))).alias("h")).select("bucket", (-F.col("h.minus")).alias("hub")))
    star = stored(inside.join(hub, "bucket").where("node <> hub").select("hub", "node").distinct())
    discard(shared, inside, hub)
    wanted = stored(star.select(F.explode(F.array("hub", "node")).alias("node")).distinct())
    texts = text.join(wanted, text.row == wanted.node).select("node", "text")
    bags = stored(texts.mapInArrow(_bags(width), "node long, bag binary"))

    x, y = (bags.select(F.col("node").alias(c), F.col("bag").alias(f"{c}_bag")) for c in ("x", "y"))
    pairs = star.select(F.col("node").alias("x"), F.col("hub").alias("y")).join(x, "x").join(y, "y")
    tested = pairs.select("x", "y", "x_bag", "y_bag").mapInArrow(_overlap, "x long, y long, sim double")
    links = stored(tested.where(F.col("sim") >= threshold).select("x", "y"))
    known = stored(wanted.join(components(links), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))
    sizes = known.join(bags.select("node", F.length("bag").alias("bytes")), "node")
    member = star.join(sizes, "node").join(known.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp")), "hub").withColumn("odd", F.col("comp") != F.col("hub_comp"))
    member = stored(member.drop("hub_comp"))
    blocks = lambda n, b: F.ceil(F.greatest(n / BLOCK, b / BLOCK_BYTES, F.lit(1))).cast("int")
    odd = F.col("odd").cast("long")
    cell = member.groupBy("hub").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.sum(odd).alias("k"), F.sum(odd * F.col("bytes")).alias("kb")).where("n > 1 and k > 0")
    cell = stored(cell.select("hub", blocks(F.col("n"), F.col("b")).alias("data_blocks"), blocks(F.col("k"), F.col("kb")).alias("query_blocks")))
    at = member.join(cell, "hub").join(bags, "node").withColumn("h", F.xxhash64("node"))
    data = at.withColumn("i", F.pmod("h", "data_blocks").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).withColumn("query", F.lit(False))
    query = at.where("odd").withColumn("j", F.pmod("h", "query_blocks").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("data_blocks") - 1))).withColumn("query", F.lit(True))
    both = data.unionByName(query).select("hub", "i", "j", "node", "comp", "bag", "query")
    found = both.groupBy("hub", "i", "j").applyInPandas(_cross(threshold), "x long, y long")
    final = components(links.unionByName(found))
    discard(star, wanted, bags, links, known, member, cell)
    linked = stored(final.join(classes.select("node", "copies_id"), "node"))
    least = linked.groupBy("comp").agg(F.min("copies_id").alias("class_id"))
    named = linked.join(least, "comp").select("node", "comp", "class_id")
    of = classes.join(named, "node", "left").select("digest", "copies_id", F.coalesce("class_id", "copies_id").alias("class_id"), F.coalesce("comp", "node").alias("class_no"))
    return sketched.select("row", "doc_id", "digest").join(stored(of), "digest").select("row", "doc_id", "class_id", "copies_id", "class_no")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, copies_id, class_no) of each row: class_id is the least doc_id of its near-duplicate class, copies_id that of the equal bags.

    Texts are multisets of `width`-word shingles over lower-cased words (runs of letters, digits and non-ASCII); links are
    pairs of weighted Jaccard similarity of at least `threshold`, classes the connected components of links.

    1. One pass makes a BagMinHash signature, its bands and a digest of each bag. Equal bags collapse to one node.
    2. In each band bucket all members are verified against one hub: the member that shares most bucket places, so that a
       cloud of copies is tested against its centre. Verification is exact, over the shingle bags.
    3. Members of a hub's cell that are still in other components than the hub are compared with the whole cell, exactly, in
       blocks of bounded size. So every link between two members of a bucket is found or its ends have met; signatures only
       say who meets in a bucket. A pair at the threshold meets in none of 32 bands of 4 with a probability of 5e-8.

    Null and wordless texts have the empty bag and form one class of copies; a text of under five words is one shingle. Every
    row is a text of its own: rows that repeat a doc_id, or have none, are in one class only if their texts are linked. Where
    two classes have the same least doc_id for that reason, or none, class_no tells them apart; it is the same number for the
    rows of one class, and no other's. Other columns are ignored; an empty table gives an empty one.
    """
    lower = F.lower(F.coalesce("text", F.lit("")))
    text = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), lower.alias("text")))
    return _classed(text, threshold, width, registers, rows).drop("row")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs, all columns, of each near-duplicate class: that of the least doc_id, rows without one last, the first of equal ones."""
    (key,) = fresh(docs, "row")
    kept = stored(docs.withColumn(key, F.monotonically_increasing_id()))
    lower = F.lower(F.coalesce("text", F.lit("")))
    classed = _classed(kept.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), lower.alias("text")), THRESHOLD, WIDTH, REGISTERS, ROWS)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    chosen = classed.groupBy("class_no").agg(first).select(F.col("first.row").alias(key))
    return kept.join(chosen, key, "left_semi").select(docs.columns)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents with its near-duplicate class."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
