"""The corpus pipeline over small tables: what each stage keeps, held against the stages' rules worked out here."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import mixing, packing, quality, toxicity
from textloom.llm.common import stored
from textloom.llm.bagminhash import shingle_bag
from textloom.llm.common import words_of

WORDS = [f"{a}{b}{c}" for a in "btkmnr" for b in "aeiou" for c in ("", "n", "st", "rek")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def made(rng):
    """(doc_id, text, toxic, good): prose, some of it shouted, some insulting, some copied exactly or nearly, with null and repeated ids."""
    rows = []
    for n in range(160):
        toxic, good = n % 8 == 3, n % 5 != 1
        text = prose(rng, rng.randrange(30, 160))
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text += " you idiot, pathetic worthless scum"
        rows.append((n, text, toxic, good))
    base = [r for r in rows if not r[2] and r[3]][:6]
    for k, (_, text, toxic, good) in enumerate(base):
        words = text.split()
        words[len(words) // 2] = "zzz"
        rows.append((300 + k, text, toxic, good))
        rows.append((400 + k, " ".join(words + ["more"]), toxic, good))
    rows += [(500, prose(rng, 60), False, True), (500, prose(rng, 70), False, True), (None, prose(rng, 80), False, True), (None, prose(rng, 90), False, True)]
    return rows


def test_rows_in_and_out_by_stage(spark, tmp_path):
    rows = made(random.Random(21))
    docs = spark.createDataFrame([(i, t, "en", f"s{n % 3}", len(t)) for n, (i, t, _, _) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(g), int(t)) for i, _, t, g in rows if i is not None and i < 300], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, kept = str(tmp_path), [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], at)))
        if name != "packing":
            assert kept[-1].columns == docs.columns, name
    clean, good, single, mixed, pieces = ([r.asDict() for r in d.collect()] for d in kept[1:])
    labels = spark.read.parquet(f"{at}/labels.parquet")
    text = lambda some: sorted(r["text"] for r in some)

    # classifiers: each row is kept by its own score, and the clean and good ones stay
    model = toxicity.train(kept[0], labels)
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(kept[0].where("doc_id < 500"), model).collect()}
    assert {r["doc_id"] for r in clean if r["doc_id"] is not None and r["doc_id"] < 500} == {i for i, p in score.items() if p < toxicity.CUT}
    toxic = {i for i, _, t, _ in rows if t}
    assert not toxic & {r["doc_id"] for r in clean} and len(clean) >= 0.97 * (len(rows) - len(toxic))
    net = quality.train(kept[1], labels)
    assert text(good) == sorted(r["text"] for r in clean if net.scores(pa.array([r["text"]]))[0] >= quality.CUT)
    assert len(good) >= 0.9 * sum(g and not t for _, _, t, g in rows)

    # near duplicates: one row of each component of all links
    bags = []
    for r in good:
        key, n = shingle_bag(words_of(pa.array([r["text"].lower()]))[0], 5)
        bags.append(dict(zip(key.tolist(), n.tolist(), strict=True)))
    group = list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            same = sum(min(n, bags[j].get(k, 0)) for k, n in bags[i].items())
            if same >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - same):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for r, g in zip(good, group, strict=True):
        least[g] = min(least.get(g, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in single) == sorted(least.values())
    assert set(text(single)) <= set(text(good)) and len(single) < len(good)

    # mixture: each row as often as its own count says
    times = {r["source"]: r["rate"] for r in mixing.rates(kept[3]).collect()}
    assert abs(sum(times[s] * sum(r["source"] == s for r in single) for s in times) - len(single)) < 1e-6
    assert set(text(mixed)) <= set(text(single))
    again = mixing.mixed(kept[3]).groupBy("text").agg(F.count("*").alias("n")).collect()
    assert {r["text"]: r["n"] for r in again} == {t: text(mixed).count(t) for t in set(text(mixed))}

    # packing: every id of every row once, all sequences full but the last ones
    own = packing.tokens(public_tokenizers.path(packing.TOKENIZER)).tokenizer
    want = sum(len(own.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(p["length"] for p in pieces) == want
    size = {}
    for p in pieces:
        size[p["sequence_id"]] = size.get(p["sequence_id"], 0) + p["length"]
    assert sorted(size) == list(range(len(size))) and [size[k] for k in range(want // 2048)] == [2048] * (want // 2048)
    for p in pieces:
        ids = next(x for r in mixed if r["doc_id"] == p["doc_id"] for x in [[*own.encode(r["text"], add_special_tokens=False).ids, 1]] if len(x) == p["doc_tokens"])
        assert zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] or sum(r["doc_id"] == p["doc_id"] for r in mixed) > 1
