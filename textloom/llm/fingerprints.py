"""Document fingerprints by invertible Bloom lookup: hashed paragraph cells subtract between versions, peeling recovers what differs.

DataFrame expressions only. A text's set has a key for each distinct paragraph and how often it occurs. A sketch spreads every
key over one cell in each of three parts; a cell adds counts and xors keys and checks. Each text is sketched by itself. Subtracting
one sketch from another, cell by cell, cancels common keys; a cell left with one key is pure, gives it back, and taking that key out
of its other cells makes further ones pure. The fingerprint, a sketch of WRITTEN cells, is kept and tried first. Versions that differ
by more than it can tell are sketched again, larger: one sketch of 6 cells for each share of the key space, and larger ones for
the shares that can't be peeled, at last with other hashes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored, table

#: Ends of paragraphs: line breaks, and blanks after a sentence's end.
PARAGRAPH_END = r"\n+|(?<=[.!?])[ \t]+"
#: Cells of the sketch written as a document's fingerprint.
WRITTEN = 12
#: Cells of a share's sketch, and of the larger ones that follow when peeling fails; their thirds are coprime, so that failures are independent.
CELLS = (6, 21, 75, 303)
#: Keys of both versions that one share of the key space is to hold, and the most keys of a text in a share that are sketched without a loop.
SHARE, UNROLLED = 1, 4
#: Characters of a range of ids and of a task, most ranges, and leaves of the tree that finds a row's range.
RANGE, TASK, MOST_RANGES, LEAVES = 4 << 20, 16 << 20, 50_000, 1024
#: Keys that one task is to sketch.
TASK_KEYS = 1_000_000
#: Stands for a null doc_id.
NO_ID = 1 - 2**63
KEYS, FOUND = "array<bigint>", "array<struct<key:bigint,sign:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def keys(text: Column) -> Column:
    """Sorted 64-bit keys of the distinct paragraphs of `text`, each hashed with its number of occurrences."""
    digests = F.transform(F.filter(F.split(text, PARAGRAPH_END), lambda p: F.length(F.trim(p)) > 0), lambda p: F.xxhash64(F.trim(p)))

    def counted(sorted_: Column) -> Column:
        # equal digests stand together: a run's start and the next run's give its length
        new = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | (F.get(sorted_, i - 1) != F.get(sorted_, i)))
        return let(new, lambda starts: F.transform(starts, lambda at, j: F.xxhash64(F.get(sorted_, at), F.coalesce(F.get(starts, j + 1), F.size(sorted_)) - at)))

    return let(F.array_sort(digests), lambda d: F.when(F.size(d) == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(counted(d))))


# Sketches are long expressions, so they are written as SQL text: the driver then builds each by one call.


def _let(value: str, name: str, body: str) -> str:
    """body with `value` worked out once under a name."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _mark(key: str, seed: int = 0) -> str:
    return f"xxhash64({key}, 'mark {seed}')"


def _place(mark: str, part: int, cells: int) -> str:
    """The key's cell in one third of the sketch, from 21 bits of its mark."""
    return f"cast(pmod(shiftright({mark}, {21 * part}), {cells // 3}) + {part * (cells // 3)} as int)"


CELL = "named_struct('n', {}, 'key', {}, 'mark', {})"


def sketch(keys_: str, cells: int, seed: int = 0) -> str:
    """Cells (n, key, mark) of one text's keys: how many, and the xor of the keys and of their marks."""
    third = cells // 3
    marked = f"transform({keys_}, k -> named_struct('key', k, 'mark', {_mark('k', seed)}))"
    places = ", ".join(f"'p{i}', {_place('x.mark', i, cells)}" for i in range(3))
    placed = f"transform({marked}, x -> named_struct('key', x.key, 'mark', x.mark, {places}))"
    add = CELL.format("a.n + 1", "a.key ^ x.key", "a.mark ^ x.mark")
    one = lambda part: f"aggregate(filter(p, x -> x.p{part} = c), {CELL.format('0', '0L', '0L')}, (a, x) -> {add})"
    return _let(placed, "p", "concat(" + ", ".join(f"transform(sequence({i * third}, {(i + 1) * third - 1}), c -> {one(i)})" for i in range(3)) + ")")


def subtracted(more: str, less: str) -> str:
    """One sketch without the other, cell by cell."""
    return f"zip_with({more}, {less}, (a, b) -> {CELL.format('a.n - b.n', 'a.key ^ b.key', 'a.mark ^ b.mark')})"


def peeled(cells: str, size: int, seed: int = 0) -> str:
    """The keys recovered from a difference of sketches, with their signs; null if cells are left that hold several keys."""
    state = "named_struct('cells', {}, 'found', {}, 'stuck', {})"
    at = " or ".join(f"i = {_place('one.mark', i, size)}" for i in range(3))
    rest = f"transform(s.cells, (c, i) -> if({at}, {CELL.format('c.n - one.n', 'c.key ^ one.key', 'c.mark ^ one.mark')}, c))"
    got = "concat(s.found, array(named_struct('key', one.key, 'sign', one.n)))"
    pure = f"get(filter(s.cells, c -> if(abs(c.n) = 1, c.mark = {_mark('c.key', seed)}, false)), 0)"
    step = _let(pure, "one", f"if(one is null, {state.format('s.cells', 's.found', 'true')}, {state.format(rest, got, 'false')})")
    start = state.format(cells, f"cast(array() as {FOUND})", "false")
    # as many keys as cells at most can be pure one after the other
    return f"aggregate(sequence(1, {size}), {start}, (s, t) -> if(s.stuck, s, {step}), s -> if(exists(s.cells, c -> c.n <> 0 or c.key <> 0 or c.mark <> 0), null, s.found))"


def recovered(more: str, less: str, sizes: tuple[int, ...], seed: int = 0) -> str:
    """The keys of one version alone (sign 1) and of the other alone (-1), from the smallest sketches whose difference peels; null if none does."""
    return "coalesce(" + ", ".join(peeled(subtracted(sketch(more, n, seed), sketch(less, n, seed)), n, seed) for n in sizes) + ")"


COUNTS = "named_struct('gone', cast({} as int), 'come', cast({} as int))"


def counts(found: str) -> str:
    """(gone, come) of recovered keys; null for null."""
    return _let(found, "f", f"if(f is null, null, {COUNTS.format('size(filter(f, x -> x.sign = 1))', 'size(filter(f, x -> x.sign = -1))')})")


def written(keys_: str, cells: str) -> str:
    """A fingerprint as text: its number of keys and its cells, each as count, xor of keys and xor of marks."""
    return f"concat(size({keys_}), ':', array_join(transform({cells}, c -> concat_ws('.', c.n, lower(hex(c.key)), lower(hex(c.mark)))), '-'))"


def shares(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Rows (row, own, changed, following) cut into (row, own, changed, following) for each share of the key space, in two steps, so that a long text costs little more than in proportion."""
    names = ("own", "changed", "following")
    many = F.size("own") + F.greatest(F.size("changed"), F.size("following"))
    outer = F.ceil(F.sqrt(F.greatest(F.lit(1.0), many / SHARE))).cast("int")
    rows = rows.select("row", *names, outer.alias("outer"))
    for shift in (7 * seed, 7 * seed + 24):
        rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)))
        rows = rows.select("row", "outer", *(F.expr(f"filter({c}, x -> pmod(shiftright(x, {shift}), outer) = share)").alias(c) for c in names))
    return rows.drop("outer")


def told_apart(parts: DataFrame, seed: int = 0) -> DataFrame:
    """(row, changed, following) of each share: counts (gone, come) of the keys in which `own` differs from either; null where no sketch peels.

    Shares of few keys are sketched without a loop, in 6 cells: of the two cells of each part, one takes the keys with a bit of
    their mark set, the other all the rest. If both cells of a part of the difference are empty or pure, all its keys are told.
    Otherwise the cells are peeled, and after them larger sketches of the same share.
    """
    names, some, parts3 = ("own", "changed", "following"), range(UNROLLED), range(3)
    rows = parts.selectExpr("row", *names, *(f"coalesce(get({c}, {i}), 0L) as {c}_k{i}" for c in names for i in some))
    rows = rows.selectExpr("*", *(f"if(size({c}) > {i}, {_mark(f'{c}_k{i}', seed)}, 0L) as {c}_y{i}" for c in names for i in some))
    bit = lambda c, i, p: f"pmod(shiftright({c}_y{i}, {21 * p}), 2)"
    ones = lambda c, x, p: " ^ ".join(f"({c}_{x}{i} & -{bit(c, i, p)})" for i in some)
    # of each text: (n, key, mark) of the cells of set bits, then of the other ones, which hold the rest of all keys
    cells = [f"cast({' + '.join(bit(c, i, p) for i in some)} as int) as {c}_n{p}1" for c in names for p in parts3]
    cells += [f"{ones(c, x, p)} as {c}_{x}{p}1" for c in names for p in parts3 for x in "ky"]
    cells += [f"{' ^ '.join(f'{c}_{x}{i}' for i in some)} as {c}_{x}" for c in names for x in "ky"]
    # a lambda keeps a step out of whole-stage code, whose one long method no just-in-time compiler takes
    apart = [f"filter({c}, k -> true) as {c}" for c in names]
    rows = rows.selectExpr("row", *apart, *cells)
    rest = [f"size({c}) - {c}_n{p}1 as {c}_n{p}0" for c in names for p in parts3] + [f"{c}_{x} ^ {c}_{x}{p}1 as {c}_{x}{p}0" for c in names for p in parts3 for x in "ky"]
    rows = rows.selectExpr("*", *rest)
    at = [f"{p}{j}" for p in parts3 for j in range(2)]
    less = [f"own_n{p} - {c}_n{p} as {c}_dn{p}" for c in names[1:] for p in at] + [f"own_{x}{p} ^ {c}_{x}{p} as {c}_d{x}{p}" for c in names[1:] for p in at for x in "ky"]
    rows = rows.selectExpr("row", *apart, *less)
    clear = lambda c, p: f"if(abs({c}_dn{p}) = 1, {c}_dy{p} = {_mark(f'{c}_dk{p}', seed)}, {c}_dn{p} = 0 and {c}_dk{p} = 0 and {c}_dy{p} = 0)"
    rows = rows.selectExpr("*", *(f"{clear(c, p)} as {c}_ok{p}" for c in names[1:] for p in at))
    fast, all_ = [], []
    for c in names[1:]:
        few = f"size(own) <= {UNROLLED} and size({c}) <= {UNROLLED}"
        held = lambda p, sign, c=c: f"if({c}_dn{p}0 = {sign}, 1, 0) + if({c}_dn{p}1 = {sign}, 1, 0)"
        told = " ".join(f"when {c}_ok{p}0 and {c}_ok{p}1 then {COUNTS.format(held(p, 1), held(p, -1))}" for p in parts3)
        fast.append(f"case when not ({few}) then null {told} end as {c}_fast")
        six = "array(" + ", ".join(CELL.format(f"{c}_dn{p}", f"{c}_dk{p}", f"{c}_dy{p}") for p in at) + ")"
        found = f"coalesce(if({few}, {peeled(six, 6, seed)}, null), {recovered('own', c, CELLS[1:], seed)})"
        all_.append(f"coalesce({c}_fast, {counts(found)}) as {c}")
    return rows.selectExpr("*", *fast).selectExpr("row", *all_)


def differences(rows: DataFrame) -> DataFrame:
    """(row, changed, following): counts (gone, come) for rows (row, own, changed, following) of key arrays, row unique.

    Every share that can't be peeled at any size, which takes two keys that meet in all three parts of each, sends its row into
    another round with other hashes; a round that leaves none ends it.
    """
    out, seed = None, 0
    while True:
        size = rows.agg(F.sum((F.size("own") + F.size("changed") + F.size("following")).cast("bigint"))).first()[0]
        dealt = rows.select("row", "own", "changed", "following").repartition(max(1, math.ceil((size or 0) / TASK_KEYS)), "row")
        told = told_apart(shares(dealt, seed), seed)
        total = lambda c: F.struct(*(F.sum(F.col(c)[x]).alias(x) for x in ("gone", "come"))).alias(c)
        failed = F.bool_or(F.col("changed").isNull() | F.col("following").isNull()).alias("failed")
        got = stored(told.groupBy("row").agg(failed, total("changed"), total("following")))
        done = got.where("not failed").drop("failed")
        out = done if out is None else out.unionByName(done)
        if got.where("failed").isEmpty():
            return out
        rows, seed = rows.join(got.where("failed").select("row"), "row", "left_semi"), seed + 1


def likeness(size: Column, differing: Column) -> Column:
    """Jaccard similarity of two sets from the number of keys of both and of differing keys; two empty sets are alike."""
    return F.when(size == 0, 1.0).otherwise((size - differing) / (size + differing))


def _ranges(ids: list[int], n: int) -> Column:
    """Label of the range that holds a row (doc_id, h), ascending in (doc_id, h), from n - 1 quantiles of the ids at most.

    Up to LEAVES ranges are a tree of the quantiles; beyond that each leaf is cut in even steps. An id that several quantiles
    fall on has as many ranges of its own, by h.
    """
    often, bounds = Counter(ids), sorted(set(ids))
    inner = -(-n // LEAVES)

    def within(a: int) -> Column:
        """Step within leaf a: that of ids from bounds[a - 1] up to bounds[a]."""
        if not a:
            return F.lit(0).cast("bigint")
        low = bounds[a - 1]
        even = F.lit(0).cast("bigint")
        if inner > 1 and a < len(bounds):
            even = F.floor((F.col("doc_id") - F.lit(low)) * F.lit(inner / (bounds[a] - low)))
        if often[low] == 1:
            return even
        t = often[low] * inner
        own = F.floor((F.shiftright("h", 11) + F.lit(1 << 52)) * F.lit(t / 2.0**53))
        return F.when(F.col("doc_id") == F.lit(low), F.least(own, F.lit(t - 1))).otherwise(even + t)

    def halved(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a << 32) + within(a)
        m = (a + b) // 2
        return F.when(F.col("doc_id") < F.lit(bounds[m]), halved(a, m)).otherwise(halved(m + 1, b))

    return halved(0, len(bounds))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, times): each row with the text of the next in order of (doc_id, hash of text); the last is followed by the first.

    One shuffle of the texts, by id range; each range also gets a copy of the row that follows it, so that no window spans ranges.
    Ranges, and how many, follow from the characters of the table. Ids that hold a range or more by themselves are cut by the
    texts' hashes, after equal rows of them have been counted up: `times` says how many rows a result stands for.
    """
    text = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = text.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    n = min(MOST_RANGES, max(1, math.ceil(chars / RANGE)))
    leaves = min(n, LEAVES)
    probes = [i / leaves for i in range(1, leaves)]
    ids = (text.agg(F.percentile_approx("doc_id", probes, 10 * leaves)).first()[0] or []) if probes else []
    hot = [i for i, k in Counter(ids).items() if k > 1]
    one = text.withColumn("times", F.lit(1).cast("bigint"))
    if hot:
        own = F.col("doc_id").isin(hot)
        one = one.where(~own).unionByName(text.where(own).groupBy("doc_id", "text").agg(F.count("*").alias("times")))
    rows = one.withColumn("h", F.xxhash64("text")).select(_ranges(ids, n).alias("range"), "doc_id", "h", "text", "times")
    # one row a range
    firsts = rows.groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("f")).select("range", "f.*")
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = F.broadcast(firsts.select("doc_id", "h", before.alias("range")))
    extra = rows.drop("range").join(firsts, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("range", "doc_id", "h", "text", "times", F.lit(1).alias("extra"))
    both = rows.withColumn("extra", F.lit(0)).unionByName(extra).repartition(max(1, math.ceil(chars / TASK)), "range")
    seen = both.withColumn("next_text", F.lead("text").over(Window.partitionBy("range").orderBy("extra", "doc_id", "h"))).where("extra = 0")
    if hot:
        # all but the last of equal rows are followed by their own text
        kinds = F.filter(F.array(F.struct(F.lit(1).cast("bigint").alias("times"), F.col("next_text")), F.struct((F.col("times") - 1).alias("times"), F.col("text").alias("next_text"))), lambda x: x.times > 0)
        seen = seen.select("doc_id", "text", F.explode(kinds).alias("kind")).select("doc_id", "text", "kind.*")
    return seen.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", "next_text", "times")


def sketched(docs: DataFrame) -> DataFrame:
    """(row, times, doc_id, n_chars, edited_sha256, own, changed, following, fingerprint, edited_fingerprint, near_changed, near_following), stored.

    The last two are the counts (gone, come) by which the fingerprints differ where they peel, else null.
    """
    half = "cast(floor(length(text) / 2) as int)"
    edited = F.concat(F.expr(f"substring(text, 1, length(text) - {half})"), F.expr(f"substring(next_text, 1, {half})"))
    rows = with_next(docs).withColumn("edited", edited)
    sets = [keys(F.col(c)).alias(n) for c, n in (("text", "own"), ("edited", "changed"), ("next_text", "following"))]
    rows = rows.select("times", "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *sets)
    names = ("own", "changed", "following")
    rows = rows.selectExpr("*", *(f"{sketch(c, WRITTEN)} as {c}_cells" for c in names[:2]))
    # more keys than cells can't be told; the next document's fingerprint is made only where it is tried
    cells = {"changed": "changed_cells", "following": sketch("following", WRITTEN)}
    tried = lambda c: f"if(abs(size(own) - size({c})) <= {WRITTEN}, {counts(peeled(subtracted('own_cells', cells[c]), WRITTEN))}, null) as near_{c}"
    prints = [f"{written(c, f'{c}_cells')} as {n}" for c, n in (("own", "fingerprint"), ("changed", "edited_fingerprint"))]
    rows = rows.selectExpr("monotonically_increasing_id() as row", "times", "doc_id", "n_chars", "edited_sha256", *names, *prints, *map(tried, names[1:]))
    return stored(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    The edited text ends in the first half of the next document instead of its own last floor(n_chars / 2) code points. Null
    texts are empty and have no keys; two empty sets are alike. Rows that repeat a doc_id follow each other in the order of
    their texts' hashes, and each is a row of its own; a null id comes first. A single row follows itself. Other columns are
    ignored; an empty table gives an empty one.
    """
    kept = sketched(docs)
    larger = differences(kept.where("near_changed is null or near_following is null")).select("row", F.col("changed").alias("more_changed"), F.col("following").alias("more_following"))
    rows = kept.join(larger, "row", "left")

    def near(c: str) -> Column:
        apart = F.coalesce(f"near_{c}", F.struct(*(F.col(f"more_{c}")[x].cast("int").alias(x) for x in ("gone", "come"))))
        return likeness(F.size("own") + F.size(c), apart.gone + apart.come)

    out = rows.select("times", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("changed").alias("near_edited"), near("following").alias("near_next"))
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def op5_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document against its edited text and the next document."""
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
