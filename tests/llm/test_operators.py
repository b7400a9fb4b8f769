"""Operators over small tables, held against brute force; nulls, empty and repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import bagminhash, fingerprints, licences, linkgraph, mixing, ogg, packing, pseudolikelihood, quality, toxicity
from textloom.llm.common import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, digest string, place long, range int"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, 1, "d", 2, 3) for i, t, s in rows], SCHEMA)


WORDS = [f"{a}{b}{c}" for a in "btkmnr" for b in "aeiou" for c in ("", "n", "st", "rek")]


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + (". " if i % 9 == 8 else "\n" if i % 31 == 30 else " "))
    return "".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(i, prose(rng, rng.randrange(1, 200)), f"s{min(i % 7, 2)}") for i in range(60)]
    out += [(100, None, None), (101, "", "s0"), (102, "   \n ", "s0"), (103, "one", "s1"), (103, "one", "s1"), (None, "no id at all", "s1"), (104, prose(rng, 9000), "s1")]
    return out


def plain_bag(text):
    words, first = words_of(pa.array([text.lower()]))
    key, n = bagminhash.shingle_bag(words, 5)
    return dict(zip(key.tolist(), n.tolist()))


def test_near_duplicates_are_the_components_of_all_links(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK", 4)
    rng = random.Random(2)
    base = [prose(rng, 120).split(" ") for _ in range(4)]
    texts = [" ".join(b) for b in base]
    for n in range(60):
        words = list(base[n % 3])
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words) + ("" if n % 5 else " MORE"))
    data = list(enumerate(texts)) + [(200, None), (201, ""), (202, texts[0].upper()), (203, "few words"), (204, "few words"), (203, "few words"), (None, texts[3])]
    data += [(5, texts[3]), (5, prose(rng, 90)), (5, prose(rng, 80)), (None, prose(rng, 70)), (None, prose(rng, 60)), (None, None)]
    docs = table(spark, [(i, t, "s") for i, t in data])
    got = bagminhash.near_duplicates(docs.withColumn("row", F.lit(1)).withColumn("bands", F.lit(2))).collect()
    bag = [plain_bag(t or "") for _, t in data]
    group = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            same = sum(min(n, bag[j][k]) for k, n in bag[i].items() if k in bag[j])
            if bag[i] == bag[j] or same / max(1, sum(bag[i].values()) + sum(bag[j].values()) - same) >= 0.8:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = {}
    for (i, _), g in zip(data, group):
        want.setdefault(g, []).append(i)
    have = {}
    for r in got:
        have.setdefault(r["class_no"], []).append(r["doc_id"])
    assert len(got) == len(data)
    shape = lambda classes: sorted(sorted(map(str, v)) for v in classes.values())
    assert shape(have) == shape(want)
    for r in got:
        assert r["class_id"] == min((i for i in have[r["class_no"]] if i is not None), default=None)
    odd = docs.withColumnRenamed("node", "row").withColumn("class_no", F.lit("KEEP"))
    kept = bagminhash.deduplicated(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns and len(rows) == len(want) and all(r["row"] == 1 and r["class_no"] == "KEEP" for r in rows)
    # one row of each class, of its least id
    numbers = {}
    for (i, t), g in zip(data, group):
        numbers.setdefault((str(i), t), set()).add(g)
    assert sorted(g for r in rows for g in numbers[str(r["doc_id"]), r["text"]]) == sorted(want)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(min((i for i in v if i is not None), default=None)) for v in want.values())
    assert bagminhash.near_duplicates(table(spark, [])).count() == bagminhash.deduplicated(table(spark, [])).count() == 0


def test_overlaps_of_blocks_are_exact():
    rng = np.random.default_rng(4)
    bags = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 30, 50, 80)]
    for own, row in zip(bags, bagminhash.shared_counts(bags, bags), strict=True):
        assert row.tolist() == [len(np.intersect1d(own, b)) for b in bags]


def paragraph_set(text):
    """Distinct paragraphs and how often each occurs, without the operator's own keys."""
    parts = [p.strip(" ") for p in re.split(r"\n+|(?<=[.!?])[ \t]+", text)]
    return set(Counter(p for p in parts if p).items())


def expected_fingerprints(rows):
    """By id, the sorted (n_chars, sha256 of the edited text, likenesses) of rows in which ids that repeat have equal texts."""
    order = sorted(((-1 if i is None else i), t or "") for i, t, _ in rows)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = {}
    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own = paragraph_set(t)
        want.setdefault(None if i == -1 else i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(own, paragraph_set(edited)), 9), round(like(own, paragraph_set(after)), 9)))
    return {k: sorted(v) for k, v in want.items()}


def given_fingerprints(docs):
    have = {}
    for r in fingerprints.fingerprints(docs).collect():
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        have.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)))
    return {k: sorted(v) for k, v in have.items()}


def test_fingerprints(spark, rows, monkeypatch):
    many = rows + [(1, rows[1][1], "s")] * 3 + [(200, "one two. three four. five six", "s")] * 3 + [(None, "no id at all", "s1")] * 4
    want = expected_fingerprints(many)
    assert given_fingerprints(table(spark, many)) == want
    monkeypatch.setattr(fingerprints, "RANGE", 2000)
    monkeypatch.setattr(fingerprints, "LEAVES", 8)
    assert given_fingerprints(table(spark, many)) == want
    prints = {}
    for r in fingerprints.fingerprints(table(spark, many)).collect():
        prints.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(prints[3]) == 1 and all(len(p.split(":")[1].split("-")) == fingerprints.WRITTEN for v in prints.values() for p in v)
    assert fingerprints.fingerprints(table(spark, [])).count() == 0
    one = fingerprints.fingerprints(table(spark, [(5, "a b. c d", "s")])).first()
    assert one["near_next"] == 1.0


def test_ids_that_fill_ranges_are_cut_by_text(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE", 300)
    rng = random.Random(7)
    same = [(n, prose(rng, 12), "s") for n in range(30)] + [(7, "all equal. rows here", "s")] * 60 + [(None, "none. at all", "s")] * 40
    want = expected_fingerprints([r for r in same if r[0] != 7])
    got = given_fingerprints(table(spark, [r for r in same if r[0] != 7]))
    assert got == want
    assert sum(map(len, given_fingerprints(table(spark, same)).values())) == len(same)
    hot = fingerprints.with_next(table(spark, same))
    assert hot.agg(F.sum("times")).first()[0] == len(same) and hot.where("times > 1").count() >= 1


def test_sketches_recover_keys_of_any_number(spark):
    rng = random.Random(1)
    fresh = lambda n: [rng.randrange(-(2**63), 2**63) for _ in range(n)]
    data = []
    for n, (a, b, c) in enumerate([(0, 0, 0), (1, 0, 3), (3, 9, 0), (40, 41, 2), (700, 650, 1)]):
        both = fresh(20)
        data.append((n, sorted(both + fresh(a)), sorted(both + fresh(b)), sorted(both + fresh(c))))
    df = spark.createDataFrame(data, "row long, own array<bigint>, changed array<bigint>, following array<bigint>")
    apart = lambda a, b: (len(set(a) - set(b)), len(set(b) - set(a)))
    got = {r["row"]: (tuple(r["changed"]), tuple(r["following"])) for r in fingerprints.differences(df).collect()}
    assert got == {n: (apart(a, b), apart(a, c)) for n, a, b, c in data}
    found = df.where("row < 3").select("row", F.expr(fingerprints.recovered("own", "changed", fingerprints.CELLS)).alias("f")).collect()
    for r, (_, more, less, _) in zip(sorted(found), data):
        assert {(x["key"], x["sign"]) for x in r["f"]} == {(k, 1) for k in set(more) - set(less)} | {(k, -1) for k in set(less) - set(more)}


def test_sketches_that_fail_get_other_hashes(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "CELLS", (6, 9))
    rng = random.Random(2)
    data = [(n, sorted(rng.randrange(-(2**63), 2**63) for _ in range(30)), [], []) for n in range(3)]
    df = spark.createDataFrame(data, "row long, own array<bigint>, changed array<bigint>, following array<bigint>")
    assert {r["row"]: r["changed"]["gone"] for r in fingerprints.differences(df).collect()} == {0: 30, 1: 30, 2: 30}
    six = fingerprints.peeled(fingerprints.subtracted(fingerprints.sketch("own", 6), fingerprints.sketch("changed", 6)), 6)
    assert df.select(F.expr(six).alias("f")).where("f is not null").count() == 0


PAGES = [
    (1, "http://A.example.com/en/7198#top", '<a href="https://b.example.org/x">'), (2, "https://a.example.com/en/6?x", "see c.example.net or b.example.org"), (3, "http://b.example.org", None),
    (4, "no scheme", "x"), (5, None, "a.example.com"), (6, "https://c.example.net/de/81", ""), (7, "https://c.example.net/de/71?q=/en/", "mail me@a.example.com"), (8, "http://c.example.net/fr", ""),
    (9, "http://b.example.org/es/", ""), (9, "http://b.example.org/es/", ""), (10, "http://xcom/en/1", ""), (11, "https://com/en/", ""),
]


def test_rules_and_verdicts(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = {}
    for r in linkgraph.judged(df).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert {k: (v[0]["host"], v[0]["path"], v[0]["rule"]) for k, v in got.items()} == {
        1: ("a.example.com", "/en/7198", "example.com/en/7"), 2: ("a.example.com", "/en/6", "com/en/"), 3: ("b.example.org", "", None), 4: ("", "", None), 5: ("", "", None),
        6: ("c.example.net", "/de/81", "example.net/de/8"), 7: ("c.example.net", "/de/71", "net/de/"), 8: ("c.example.net", "/fr", None), 9: ("b.example.org", "/es/", "org/es/"),
        10: ("xcom", "/en/1", None), 11: ("com", "/en/", "com/en/"),
    }
    assert [got[k][0]["verdict"] for k in (1, 2, 6, 7, 9, 11)] == ["allow", "block", "block", "allow", "block", "block"] and len(got[9]) == 2
    assert all(r["verdict"] in ("allow", "block") for v in got.values() for r in v) and got[4][0]["verdict"] == "allow"
    assert linkgraph.judged(df.where("false")).count() == 0


def test_rank_is_the_fixed_point(spark, monkeypatch):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "c", 1)]
    seeds = [("a", 0.7, 0.0), ("b", 0.3, 0.5), ("c", 0.0, 0.5), ("d", 0.0, 0.0)]
    links = spark.createDataFrame(edges, "src string, dst string, n long")
    base = spark.createDataFrame(seeds, "host string, good double, bad double")
    ranks = lambda tolerance: {r["host"]: (r["trust"], r["distrust"]) for r in linkgraph.propagated(base, links, tolerance=tolerance).collect()}
    got, rough = ranks(linkgraph.TOLERANCE), ranks(1.0)
    # links of hot hosts, dealt out by salts, give the same
    monkeypatch.setattr(linkgraph, "HOT", 1)
    monkeypatch.setattr(linkgraph, "HOT_HOSTS", 10)
    assert {h: pytest.approx(v) for h, v in rough.items()} == ranks(1.0)
    names = "abcd"
    m = np.zeros((4, 4))
    for s, t, n in edges:
        m[names.index(t), names.index(s)] = n
    for k, w in ((1, m / np.maximum(m.sum(axis=0), 1)), (2, (m.T / np.maximum(m.sum(axis=1), 1)))):
        x = np.linalg.solve(np.eye(4) - 0.85 * w, 0.15 * np.array([s[k] for s in seeds]))
        assert [got[h][k - 1] for h in names] == pytest.approx((x / x.sum()).tolist(), abs=1e-3)


def test_links_and_verdicts_by_brute_force(spark):
    rng = random.Random(11)
    hosts = ["a.com:8080", "b.net", "bücher.org", "localhost", "10.0.0.7", "user@c.example.com", "d.example.net", "e.org"]
    paths = ["/en/7", "/en/8", "/de/8", "/de/1", "/es/", "/fr", ""]
    pages = []
    for n in range(120):
        links = " ".join(rng.choice(['<a href="https://{}/x">', "see {} now", "<img src='//x' alt=http://{}?q>"]).format(rng.choice(hosts)) for _ in range(rng.randrange(4)))
        pages.append((n, f"http://{rng.choice(hosts)}{rng.choice(paths)}", links if n % 9 else None))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    host = {n: lower(re.split(r"[/?#]", u.split("://", 1)[1])[0]) for n, u, _ in pages}
    links = Counter()
    for n, _, html in pages:
        found = {lower(x) for x in re.findall(r"://([^\s\"'<>/?#]+)", html or "")}
        found |= {lower(x) for x in re.findall(r"(?<![\w.-])((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,})(?![\w-])", html or "", re.I | re.A)}
        for to in found & set(host.values()) - {host[n]}:
            links[host[n], to] += 1
    rows = df.select(linkgraph.host_of(F.col("url")).alias("host"), "html")
    assert {(r["src"], r["dst"]): r["n"] for r in linkgraph.host_links(rows).collect()} == dict(links)
    got = {r["page_id"]: r for r in linkgraph.judged(df).collect()}
    names = sorted(set(host.values()))
    at = {h: i for i, h in enumerate(names)}
    ruled = {n: got[n]["verdict"] for n in got if got[n]["rule"] is not None}
    m = np.zeros((len(names), len(names)))
    for (a, b), k in links.items():
        m[at[b], at[a]] = k
    ranks = []
    for kind, w in (("allow", m / np.maximum(m.sum(axis=0), 1)), ("block", m.T / np.maximum(m.sum(axis=1), 1))):
        seed = np.bincount([at[host[n]] for n, v in ruled.items() if v == kind], minlength=len(names))
        x = np.linalg.solve(np.eye(len(names)) - 0.85 * w, 0.15 * seed / seed.sum())
        ranks.append(x / x.sum())
    size = np.bincount([at[h] for h in host.values()], minlength=len(names)) / len(pages)
    doubt = ranks[1] / (ranks[0] + ranks[1] + size)
    assert np.abs(doubt - linkgraph.THRESHOLD).min() > 1e-3
    assert {n: r["verdict"] for n, r in got.items() if n not in ruled} == {n: "block" if doubt[at[host[n]]] > linkgraph.THRESHOLD else "allow" for n in got if n not in ruled}


def test_packing_keeps_every_id(spark, rows):
    got = packing.packed(table(spark, rows), public_tokenizers.path(packing.TOKENIZER)).collect()
    own = packing.tokens(public_tokenizers.path(packing.TOKENIZER)).tokenizer
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append([*own.encode(t or "", add_special_tokens=False).ids, 1])
    at, sequences = {}, {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0) and r["length"] > 0
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
        ids = next(x for x in want[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"])
        at[r["doc_id"]] = at.get(r["doc_id"], 0) + r["length"]
        assert ids
    assert at == {i: sum(map(len, x)) for i, x in want.items()}
    assert sum(n < 2048 for n in sequences.values()) == bin(sum(map(len, (x for v in want.values() for x in v))) % 2048).count("1")
    assert all(n & (n - 1) == 0 for n in sequences.values()) and sorted(sequences) == list(range(len(sequences)))
    assert packing.packed(table(spark, []), public_tokenizers.path(packing.TOKENIZER)).count() == 0


def test_packing_is_alike_however_the_work_is_dealt(spark, rows, monkeypatch):
    docs, path = table(spark, rows), public_tokenizers.path(packing.TOKENIZER)
    want = sorted(map(str, packing.packed(docs, path).collect()))
    monkeypatch.setattr(packing, "RANGE_CHARS", 5000)
    monkeypatch.setattr(packing, "BOUND_ROWS", 10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("2", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert sorted(map(str, packing.packed(docs.repartition(int(n)), path).collect())) == want
    spark.conf.set("spark.sql.shuffle.partitions", before)
    # neighbours of a sequence lie near each other on the curve
    place = {i: packing.curve_keys(pa.array([t or ""]))[0] for i, t, _ in rows}
    order = [place[r["doc_id"]] for r in sorted(packing.packed(docs, path).collect(), key=lambda r: (r["sequence_id"], r["offset"]))]
    assert order == sorted(order)


def test_mixing_inverts_the_poisson_distribution(spark, rows):
    docs = table(spark, rows)
    got = mixing.mixed(docs, {"s0": 1.0, "s1": 3.0, "absent": 9.0}, epochs=2.0).collect()
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs, {"s0": 1.0, "s1": 3.0, "absent": 9.0}, epochs=2.0).collect()}
    n = {s: sum((x or "") == s for *_, x in rows) for s in rate}
    assert rate["s2"] == rate[""] == 0 and rate["s0"] * n["s0"] + rate["s1"] * n["s1"] == pytest.approx(2 * len(rows))
    times = {}
    for i, _, s in rows:
        u = int(hashlib.md5(f"{mixing.SEED}|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        k, term = 0, np.exp(-rate[s or ""])
        total = term
        while u >= total and k < 60:
            k += 1
            term *= rate[s or ""] / k
            total += term
        times[i] = times.get(i, 0) + k
    have = {}
    for r in got:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + 1
    assert have == {i: k for i, k in times.items() if k}
    assert mixing.mixed(table(spark, [])).count() == 0
    assert mixing.mixed(docs, {"": 1.0}, epochs=2.0).count() > 0
    named = docs.withColumn("rate", F.lit("KEEP")).withColumn("times", F.lit("KEEP")).withColumn("source_of", F.lit("KEEP"))
    assert {tuple(r) for r in mixing.mixed(named).select("rate", "times", "source_of").collect()} == {("KEEP",) * 3}


def test_terms_bound_the_poisson_tail(spark):
    rates = [0.1, 1.0, 16.0, 300.0]
    got = spark.createDataFrame([(r,) for r in rates], "r double").select("r", mixing.terms(F.col("r")).alias("k"), F.size(mixing.distribution(F.col("r"))).alias("n")).collect()
    for r in got:
        tail = sum(math.exp(k * math.log(r["r"]) - r["r"] - math.lgamma(k + 1)) for k in range(r["k"] + 1, r["k"] + 500))
        assert tail < 2**-53 and r["r"] < r["n"] <= r["k"] + 1


def test_mixing_joins_many_sources_by_salt(spark, rows, monkeypatch):
    docs = table(spark, rows)
    want = sorted(map(str, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST", 1)
    monkeypatch.setattr(mixing, "TABLED", 0.5)
    assert sorted(map(str, mixing.mixed(docs).collect())) == want
    monkeypatch.setattr(mixing, "PART_BYTES", 10_000)
    parts = mixing.mixed(docs)
    assert parts.rdd.getNumPartitions() > 4 and sorted(map(str, parts.collect())) == want
    places = [r["place"] for r in parts.collect()]
    assert places == sorted(places)


def test_mixing_of_very_small_sources(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, "small").otherwise("large").alias("source"))
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs, temperature=0.0).collect()}
    assert rate == {"small": 5000.0, "large": pytest.approx(10000 / 19998)}
    got = mixing.mixed(docs, temperature=0.0).where("doc_id < 200").groupBy("doc_id").count().collect()
    times = {r["doc_id"]: r["count"] for r in got}
    for i in range(200):
        u = int(hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest()[:13], 16) / 2**52
        lam = rate["small" if i < 2 else "large"]
        total, k = math.exp(-lam), 0
        while u >= total:
            k += 1
            total += math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))
        assert times.get(i, 0) == k


def test_mixing_sql(spark, rows, tmp_path):
    docs = table(spark, [r for r in rows if r[0] != 103])
    got = sorted((r["doc_id"] or -1, r["copy_no"], r["place"]) for r in mixing.mixed(docs).select("doc_id", "copy_no", "place").collect())
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert got == sorted((r[0] or -1, r[1], r[2]) for r in con.execute(f"SELECT doc_id, copy_no, place FROM ({mixing.SQL})").fetchall())


def test_licences(spark):
    rng = random.Random(3)
    notices = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."]
    data = [(n, prose(rng, 60) + (f"\n{notices[n % 3]}\n" if n < 9 else "\nthe license of the work") + prose(rng, 20), "s") for n in range(40)]
    data += [(50, None, "s"), (51, "", "s"), (52, notices[0], "s"), (52, notices[0], "s"), (None, notices[1], "s")]
    got = licences.scanned(table(spark, data)).collect()
    families = ["cc-by-nc", "mit", "gpl-3.0"]
    assert sorted((str(r["doc_id"]), r["family"]) for r in got) == sorted([(str(n), families[n % 3]) for n in range(9)] + [("52", "cc-by-nc")] * 2 + [("None", "mit")])
    assert all(r["contained"] == 1.0 and r["probability"] > 0.5 for r in got)


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
BSD = "// Redistribution and use in source and binary forms, with or without\r\n// modification, are permitted provided that the following conditions\r\n// are met:"


def test_wrapped_licences(spark):
    rng = random.Random(4)
    narrow = "Permission is\nhereby granted, free\nof charge, to any\nperson obtaining a\ncopy of this\nsoftware and\nassociated documentation\nfiles"
    data = [(n, prose(rng, 60) + "\n\n" + (MIT, BSD, narrow)[n % 3] + "\n\n" + prose(rng, 20), "s") for n in range(6)] + [(n, prose(rng, 60) + "\nof this software", "s") for n in range(6, 30)]
    data += [(40, "kept apart\n" + MIT + "\n" + BSD, "s"), (41, MIT.replace("copy\n", "copy\n\n"), "s")]
    got = sorted((r["doc_id"], r["family"], r["template"]) for r in licences.scanned(table(spark, data)).collect())
    mit, bsd = ("mit", "mit/1"), ("bsd", "bsd/1")
    assert got == [(0, *mit), (1, *bsd), (2, *mit), (3, *mit), (4, *bsd), (5, *mit), (40, *bsd), (40, *mit)]


HEADERS = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007",
    "boost": "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt or copy at\n// https://www.boost.org/LICENSE_1_0.txt)",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mit": "# SPDX-License-Identifier: MIT",
    "mpl-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "bsd": "Redistributions of source code must retain the above copyright notice, this\nlist of conditions and the following disclaimer.",
}


def test_headers_and_paraphrases_are_told_from_talk_about_licences(spark):
    """Precision and recall over headers as files have them, notices with a tenth of their words lost, and talk about licences."""
    rng = random.Random(6)
    data, want = [], {}
    for n, (family, text) in enumerate(sorted(HEADERS.items())):
        data.append((n, prose(rng, 40) + "\n\n" + text + "\n\n" + prose(rng, 20), "s"))
        want[n] = family
    for n, (family, notices) in enumerate(sorted(licences.TEMPLATES.items())):
        words = max(notices, key=len).split(" ")
        if len(words) > 12:
            for _ in range(len(words) // 14):
                del words[rng.randrange(len(words))]
            data.append((100 + n, prose(rng, 40) + "\n" + " ".join(words) + "\n" + prose(rng, 20), "s"))
            want[100 + n] = family
    talk = ["the licence of this work is not known", "permission was granted to any person", "you may not use this file", "a public license is general", "the software is provided with the files of version 2", "see the file for a copy"]
    data += [(200 + n, prose(rng, 30) + "\n" + talk[n % len(talk)] + "\n" + prose(rng, 30), "s") for n in range(60)]
    got = {}
    for r in licences.scanned(table(spark, data)).collect():
        got.setdefault(r["doc_id"], set()).add(r["family"])
    right = sum(want[i] in v for i, v in got.items() if i in want)
    assert right >= 0.9 * len(want), {i: (f, got.get(i)) for i, f in want.items() if f not in got.get(i, ())}
    assert right >= 0.9 * sum(map(len, got.values())) and not any(i >= 200 for i in got)


def test_unknown_licence_examples_are_distinct(spark, monkeypatch):
    monkeypatch.setattr(licences, "UNKNOWN", 20)
    rng = random.Random(5)
    lines = [prose(rng, 12).replace("\n", " ") for _ in range(40)]
    data = [(n, "\n".join(lines[n % 40 :: 40] * 50), "s") for n in range(40)]
    rows = licences.examples(licences.paragraphs(table(spark, data))).where("family = 'unknown'")
    assert rows.count() == rows.select("example").distinct().count() == 20


def test_media(spark, rows):
    got = ogg.media_digests(ogg.media_of(table(spark, rows))).collect()
    want = sorted((str(i), hashlib.sha256(ogg.padded((t or "").encode())).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["payload_sha256"]) for r in got) == want
    for r in got:
        text = next((t or "").encode() for i, t, _ in rows if i == r["doc_id"])
        payload = ogg.padded(text)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(text), len(payload), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(ogg.encode(payload)).hexdigest() and r["media_bytes"] == len(ogg.encode(payload))


def test_pseudo_likelihood_prefers_what_it_knows(spark, rows):
    known = ["the cat sat on the mat and the dog ran to the door " * 8] * 150
    data = [(n, t, "s") for n, t in enumerate(known)] + [(900, "mat the ran door cat to dog the on and sat the the " * 8, "s")]
    got = {r["doc_id"]: r for r in pseudolikelihood.pseudo_likelihoods(table(spark, data)).collect()}
    assert got[0]["tokens"] == 104 and got[0]["log_likelihood"] == pytest.approx(got[7]["log_likelihood"], rel=1e-4)
    assert got[0]["score"] > got[900]["score"] and got[0]["score"] == pytest.approx(got[0]["log_likelihood"] / 104)
    odd = pseudolikelihood.pseudo_likelihoods(table(spark, rows)).collect()
    assert len(odd) == len(rows)
    assert {(r["tokens"], r["log_likelihood"], r["score"]) for r in odd if r["doc_id"] in (100, 101, 102)} == {(0, 0.0, None)}
    assert pseudolikelihood.pseudo_likelihoods(table(spark, [])).count() == 0


def test_the_network_beats_word_frequencies_on_texts_it_has_not_seen(spark, monkeypatch):
    """A language whose every word is one of three that may follow the last; files and partitions don't change the network."""
    monkeypatch.setattr(pseudolikelihood, "STEP", 256)
    rng = random.Random(9)
    follow = {w: rng.sample(WORDS, 3) for w in WORDS}

    def text():
        out = [rng.choice(WORDS)]
        while len(out) < 150:
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    seen, new = table(spark, [(n, text(), "s") for n in range(800)]), [text() for _ in range(40)]
    vocab = pseudolikelihood.vocabulary(seen)
    net = pseudolikelihood.trained(seen, vocab)
    got = pseudolikelihood.network_scores(table(spark, [(n, t, "s") for n, t in enumerate(new)]), vocab, net).agg(F.sum("log_likelihood"), F.sum("tokens")).first()
    count = Counter(w for r in seen.select("text").collect() for w in r["text"].split())
    unigram = sum(math.log(count[w] / sum(count.values())) for t in new for w in t.split()) / got[1]
    assert got[0] / got[1] > unigram + 0.7
    again = pseudolikelihood.trained(seen.repartition(7), vocab)
    assert np.abs(again.params - net.params).max() < 1e-5


def test_runs_found_elsewhere_are_evidence(spark):
    lm = pseudolikelihood
    rng = random.Random(12)
    texts = [prose(rng, 150) for _ in range(12)]
    texts += [texts[0], texts[1] + " " + prose(rng, 60), texts[0]]
    docs = table(spark, [(n, t, "s") for n, t in enumerate(texts)])
    vocab = lm.vocabulary(docs)
    net = lm.Window()
    got = {r["doc_id"]: r for r in lm.scored(docs, vocab, net).collect()}
    raw = {r["doc_id"]: r["runs"] for r in lm.network_scores(docs, vocab, net).collect()}
    n = Counter(r["run"] for v in raw.values() for r in v)
    for i, runs in raw.items():
        gain = sum(math.log((n[r["run"]] - 1 + math.exp(-b / lm.FINE)) / n[r["run"]]) + b / lm.FINE for r in runs for b in r["logs"] if n[r["run"]] > 1)
        assert got[i]["log_likelihood"] - got[i]["network_log_likelihood"] == pytest.approx(gain, abs=1e-6)
    assert min(got[i]["score"] for i in (0, 12, 14)) > 2 + max(got[i]["score"] for i in range(2, 12))


def test_classifiers_on_odd_tables(spark, rows):
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    marked = [(i, (t + " you idiot scum" if i is not None and i % 5 == 0 and t else t), s) for i, t, s in rows]
    docs = table(spark, marked)
    for module, n, fold, cut in ((quality, 5, 0, quality.CUT), (toxicity, 3, 1, toxicity.CUT)):
        got = module.classified(docs, labels).collect()
        assert len(got) == len(rows)
        for r in got:
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
            assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % n == fold)
        assert module.classified(table(spark, []), labels.where("false")).count() == 0
        assert module.classified(docs, labels.where("false")).count() == len(rows)
    toxic = {r["doc_id"]: r["score"] for r in toxicity.classified(docs, labels).collect()}
    assert min(toxic[i] for i in range(0, 60, 5)) > max(toxic[i] for i in range(60) if i % 5)
    kept = toxicity.accepted(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(s < toxicity.CUT for s in toxic.values()) + 1
