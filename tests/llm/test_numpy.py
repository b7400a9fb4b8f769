"""What runs in numpy, held against plain Python."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from textloom.llm import bagminhash, ogg, packing, pseudolikelihood, quality, toxicity
from textloom.llm.common import slices, span_hashes, text_bytes, words_of


def test_words_are_alike_wherever_they_stand():
    texts = pa.array(["The cat", None, "", "a the  THE-cat é!", "x" * 5000 + " the"])
    h, first = words_of(texts, lower=True)
    assert np.diff(first).tolist() == [2, 0, 0, 5, 2]
    the = h[0]
    assert h[3] == h[4] == the == h[8] and h[1] == h[5]
    assert len(set(h.tolist())) == 5
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (0, 5, 100, 3)])], ["text"])
    assert [b.num_rows for b in slices(iter([batch]), "text", 10)] == [2, 1, 1]
    raw, off = text_bytes(batch.slice(1, 2).column("text"))
    assert off.tolist() == [0, 5, 105] and len(raw) == 105
    codes = np.array([5, 6, 7, 5, 6, 7], np.uint64)
    assert len(set(span_hashes(codes, np.array([0, 3, 1]), np.array([3, 6, 3])).tolist())) == 2


def bags(texts, width=5):
    h, first = words_of(pa.array(texts))
    return [bagminhash.shingle_bag(h[a:b], width) for a, b in zip(first, first[1:])]


def exact(a, b):
    x, y = dict(zip(*map(np.ndarray.tolist, a))), dict(zip(*map(np.ndarray.tolist, b)))
    same = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
    return same / (sum(x.values()) + sum(y.values()) - same)


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    errors = []
    for n in range(12):
        base = [rng.choice(words[: 3 + 3 * n]) for _ in range(60)]
        other = [w if rng.random() < 0.95 else rng.choice(words) for w in base] + base[: n * 3]
        a, b = bags([" ".join(base), " ".join(other)], 1 + n % 3)
        key = np.concatenate((a[0], b[0]))
        sig = bagminhash.signatures(key, np.concatenate((a[1], b[1])), np.repeat([0, 1], [len(a[0]), len(b[0])]), 2, 2048)
        assert np.isfinite(sig).all()
        errors.append((sig[0] == sig[1]).mean() - exact(a, b))
    assert np.abs(errors).max() < 0.06 and abs(np.mean(errors)) < 0.015


def test_a_text_of_few_words_is_one_shingle():
    a, b, c = bags(["one two", "one two three four five one two three four five", ""])
    assert a[1].tolist() == [1] and b[1].sum() == 6 and len(c[0]) == 0
    assert np.isinf(bagminhash.signatures(*c, np.zeros(0), 1, 8)).all()


def test_pieces_and_ids_are_the_tokenizers():
    own = packing.Tokens(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(3)
    parts = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "Zé", "é", "1", "½", "!", "…", "$", "　", " ", "漢", "🙂", "<|endoftext|>", "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    ids, first = own.ids(texts)
    want = [e.ids for e in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == want
    own.ranked = None
    own.forget()
    assert own.ids(texts)[0].tolist() == ids.tolist()


def test_hilbert_keys_visit_every_cell_by_neighbours():
    grid = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def test_the_last_sequences_are_powers_of_two():
    cuts, place, length, ends = packing.Cuts(46, 16), 0, {}, []
    for size in (5, 40, 1):
        ids = np.arange(size, dtype=np.uint16)
        seen = 0
        for start, n, crc, sequence, offset in cuts.pieces(place, ids):
            assert start == seen and offset == length.get(sequence, 0)
            length[sequence], seen = offset + n, start + n
            assert crc == zlib.crc32(np.arange(start, start + n, dtype="<u4").tobytes())
        assert seen == size
        place += size
        ends.append(place)
    assert list(length.values()) == [16, 16, 8, 4, 2] and list(length) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 254, 255, 256, 2048, 5000, 70_000])
def test_ogg_round_trip(size):
    payload = ogg.padded(random.Random(size).randbytes(size))
    assert len(payload) % 64 == 0 and len(payload) >= max(64, size)
    assert ogg.decode(ogg.encode(payload))[0] == payload


def test_ogg_checksum_lacing_and_damage():
    assert ogg.checksum(b"123456789") == 0x89A1897F
    packets = [(b"h", 0), (b"a" * 255, 1), (b"", 2), (bytes(70_000), 3), (b"x" * 510, 4), (b"z", 5)]
    data = ogg.multiplexed([ogg.pages_of(9, packets), ogg.pages_of(4, [(b"k", 0), (b"v" * 600, 8)])])
    got = ogg.read(data)
    assert got.streams[9].packets == [p for p, _ in packets] and got.streams[4].packets == [b"k", b"v" * 600]
    assert got.streams[9].granules[-1] == 5 and got.streams[4].seconds(8)[-1] == 1.0 and got.streams[9].ended
    damaged = bytearray(data)
    damaged[len(data) // 2] ^= 1
    got = ogg.read(bytes(damaged))
    assert got.bad == 1 and [len(p) for p in got.streams[9].packets] == [1, 255, 0, 510, 1]
    with pytest.raises(ValueError, match="damaged"):
        media = bytearray(ogg.encode(ogg.padded(b"x" * 9000)))
        media[5000] ^= 8
        ogg.decode(bytes(media))


def test_gradient_of_the_window_network():
    rng = np.random.default_rng(1)
    lm = pseudolikelihood
    net = lm.Window(rng.normal(0, 0.3, len(lm.Window().params)))
    context, target = rng.integers(0, lm.IDS + 1, (4, 50)), rng.integers(0, lm.IDS, 50)
    got = net.gradient(context, target)
    # along the gradient itself the loss must fall at the rate of its squared length
    loss = lambda p: -lm.Window(p).log_probabilities(context, target).astype(float).mean()
    eps = 1e-2
    slope = (loss(net.params + eps * got) - loss(net.params - eps * got)) / (2 * eps)
    assert slope == pytest.approx(float((got.astype(float) ** 2).sum()), rel=0.02)
    # probabilities of all ids sum to 1
    one = np.repeat(context[:, :1], lm.IDS, axis=1)
    assert np.exp(net.log_probabilities(one, np.arange(lm.IDS)).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_words_share_an_id_by_their_counts():
    lm = pseudolikelihood
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(0, 2**63, 9000).astype(np.uint64))
    counts = np.sort(rng.integers(1, 500, len(words)))[::-1].astype(float)
    bucket = (words % np.uint64(lm.SHARED)).astype(int)
    total, distinct = np.bincount(bucket, counts, lm.SHARED), np.bincount(bucket, minlength=lm.SHARED).astype(float)
    vocab = lm.Vocabulary.fitted(words[:6000], counts[:6000], total, distinct)
    ids, share = vocab(words)
    assert len(set(ids[: lm.IDS - lm.SHARED])) == lm.IDS - lm.SHARED and (ids[lm.IDS - lm.SHARED :] >= lm.IDS - lm.SHARED).all()
    sums = np.bincount(ids, np.exp(share.astype(float)), lm.IDS)
    assert sums[np.unique(ids)] == pytest.approx(np.ones(len(np.unique(ids))), abs=1e-3)
    none = lm.Vocabulary.fitted(words[:0], counts[:0], np.zeros(lm.SHARED), np.zeros(lm.SHARED))
    assert np.isfinite(none(words)[1]).all()


def test_runs_end_at_the_same_words_wherever_they_stand():
    lm = pseudolikelihood
    rng = np.random.default_rng(5)
    words = rng.integers(0, 2**63, 400).astype(np.uint64)
    start, end, h = lm.runs_of(words, np.array([0, 100, 100, 400]))
    assert (end - start >= lm.LEAST).all() and not ((start < 100) & (end > 100)).any()
    again = set(lm.runs_of(words[130:], np.array([0, 270]))[2].tolist())
    assert len(again & set(h.tolist())) >= len(again) - 1
    assert len(lm.runs_of(words[:0], np.array([0, 0]))[2]) == 0


def test_contexts_stop_at_the_ends_of_texts():
    edge = pseudolikelihood.EDGE
    got = pseudolikelihood.contexts(np.array([1, 2, 3]), np.array([0, 2, 2, 3]))
    assert got.tolist() == [[edge, edge, edge], [edge, 1, edge], [2, edge, edge], [edge, edge, edge]]


def test_scores_see_whole_texts_and_no_neighbours():
    rng = np.random.default_rng(2)
    net = quality.Network(rng.normal(0, 1, (quality.TAPS, 256, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), rng.normal(0, 1, quality.FILTERS).astype(np.float32), 0.1)
    texts = ["", "ab", "x" * 255, "y" * 256, "z" * 257, "q" * 3000, "q" * 2999 + "!"]
    alone = [net.scores(pa.array([t]))[0] for t in texts]
    assert net.scores(pa.array(texts)).tolist() == pytest.approx(alone, abs=1e-6)
    assert alone[-1] != alone[-2] and all(0 <= s <= 1 for s in alone)

    def plain(text):
        raw = text.encode()
        n = max(1, -(-len(raw) // quality.SEGMENT))
        raw = raw.ljust(n * quality.SEGMENT + quality.TAPS, b"\0")
        act = np.stack([sum(net.filters[k][raw[i + k]] for k in range(quality.TAPS)) for i in range(n * quality.SEGMENT)])
        chunks = [act[i * quality.SEGMENT : (i + 2) * quality.SEGMENT].max(axis=0) for i in range(max(1, n - 1))]
        logit = np.mean([np.maximum(c + net.shift, 0) @ net.weights + net.bias for c in chunks])
        return 1 / (1 + np.exp(-logit))

    assert alone == pytest.approx([plain(t) for t in texts], abs=1e-4)


def test_the_network_learns_shouting():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoins") for _ in range(rng.randrange(2, 8)))
    texts = [" ".join(word().upper() + "!!" if n % 2 else word() for _ in range(90)).encode()[: quality.CHUNK].ljust(quality.CHUNK, b"\0") for n in range(400)]
    label = 1 - np.arange(400) % 2
    trainer, x = quality.Trainer(), np.frombuffer(b"".join(texts[:300]), np.uint8).reshape(-1, quality.CHUNK)
    for n in range(60):
        pick = np.random.default_rng(n).permutation(300)[:64]
        trainer.step(x[pick], label[:300][pick], np.ones(64), 0.02)
    net = trainer.net
    got = net.scores(pa.array([t.rstrip(b"\0").decode() for t in texts[300:]]))
    assert ((got > 0.5) == (label[300:] == 1)).mean() > 0.97


def test_the_cut_spares_good_documents():
    logit, label = np.array([-3.0, -2.0, -1.0, 0.0, 1.0, 4.0]), np.array([0, 0, 1, 0, 1, 1])
    assert quality.best_cut(logit, label) == -1.5
    assert quality.best_cut(np.array([1.0, 1.0, 5.0]), np.array([0, 0, 1])) == 3.0
    assert quality.best_cut(np.array([2.0]), np.array([1])) < 2


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(4)
    y = rng.random(40_000) < 0.1
    hit = np.array([0.9, 0.7, 0.6, 0.8])
    votes = np.where(y[:, None], rng.random((len(y), 4)) < hit, rng.random((len(y), 4)) < 0.02)
    votes = np.column_stack((votes, votes[:, 0] ^ (rng.random(len(y)) < 0.01)))
    counts = np.bincount(votes @ (1 << np.arange(5)), minlength=32)
    model = toxicity.fit_label_model(counts.astype(float), 5, 0.1)
    post = model.posterior()[votes @ (1 << np.arange(5))]
    assert ((post > 0.5) == y).mean() > 0.97 and abs(post.mean() - 0.1) < 0.04
    told = [y[votes[:, i]].mean() for i in range(5)]
    # two voters that copy each other bear each other out a little too much
    assert model.accuracy()[1:4] == pytest.approx(told[1:4], abs=0.06) and model.accuracy() == pytest.approx(told, abs=0.16)
    # a voter for the other side, which abstains more often than it votes
    both = np.column_stack((votes, rng.random(len(y)) < np.where(y, 0.02, 0.4)))
    got = toxicity.fit_label_model(np.bincount(both @ (1 << np.arange(6)), minlength=64).astype(float), 6, 0.1, clean=1)
    assert got.a[5] < 0 and got.accuracy()[5] == pytest.approx(y[both[:, 5]].mean(), abs=0.05)
    assert (0, 4) in model.pairs and model.r[model.pairs.index((0, 4))] > 0.5


def test_features_and_lookup():
    h, kind, doc = toxicity.word_features(pa.array(["loweient x", None, "éêèáb éêèàc"]))
    assert np.bincount(doc, minlength=3).tolist() == [4, 0, 4]
    four = h[(kind == 1) & (doc == 2)]
    assert len(four) == 2 and four[0] != four[1]
    find = toxicity.Lookup(toxicity.word_hashes(["x", "zz"]))
    at, place = find(h)
    assert at.tolist() == [1] and place.tolist() == [0]
    assert toxicity.Lookup(np.zeros(0, np.uint64))(h)[0].tolist() == []


@pytest.mark.parametrize("size", [1.0, 400.0])
def test_tokens_sorted_by_class_score_as_each_alone(size):
    """Also with logits whose exponentials are no numbers of 32 bits."""
    rng = np.random.default_rng(5)
    net = pseudolikelihood.Window(pseudolikelihood.Window().params * size)
    context = rng.integers(0, pseudolikelihood.IDS + 1, (2 * pseudolikelihood.SIDE, 300))
    target = rng.integers(0, pseudolikelihood.IDS, 300).astype(np.int32)
    got = net.log_probabilities(context, target)
    alone = [net.log_probabilities(context[:, [n]], target[[n]])[0] for n in range(300)]
    h = net.hidden(context)
    upper = (h @ net.upper + net.upper_bias).astype(float)
    lower = (np.einsum("nh,nhm->nm", h, net.lower[target // pseudolikelihood.MEMBERS]) + net.lower_bias[target // pseudolikelihood.MEMBERS]).astype(float)
    row = np.arange(300)
    want = sum(g[row, k] - g.max(axis=1) - np.log(np.exp(g - g.max(axis=1)[:, None]).sum(axis=1)) for g, k in ((upper, target // pseudolikelihood.MEMBERS), (lower, target % pseudolikelihood.MEMBERS)))
    assert np.isfinite(got).all() and (net.bounds()[0] > pseudolikelihood.TAME) == (size > 1)
    assert got == pytest.approx(want, rel=1e-4, abs=1e-4) and alone == pytest.approx(got, rel=1e-4, abs=1e-4)
