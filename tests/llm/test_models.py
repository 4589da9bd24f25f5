"""Line CRF, Katz scores and the piece transducer against brute force, with odd rows."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilmap.llm import katz, pieces, quality, words

DOCS = "doc_id long, text string, train boolean, ids string, score string"


# -- words -----------------------------------------------------------------------------

def test_word_hashes(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab É\t\n  ") for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "x" * 9000, "A b " * 3000]
    for piece in (words.PIECE, 64):
        monkeypatch.setattr(words, "PIECE", piece)
        seen, got = {}, []
        for lo, hi, h, at in words.hashed_words(pa.array(texts), lower=True):
            got += [h[at[i]:at[i + 1]].tolist() for i in range(hi - lo)]
        want = [(t or "").encode().lower().split() for t in texts]
        assert [len(g) for g in got] == [len(w) for w in want]
        for g, w in zip(got, want):
            for a, b in zip(g, w):
                assert seen.setdefault(b, a) == a
        assert len(set(seen.values())) == len(seen)


# -- CRF -------------------------------------------------------------------------------

def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(0)
    lines = np.array([1, 4, 2, 3])
    emit, ties = rng.standard_normal(10) * 2, rng.standard_normal((2, 2))
    good, pairs = quality.forward_backward(emit, lines, ties)
    want, want_pairs = [], np.zeros((2, 2))
    for n, at in zip(lines, np.cumsum(lines) - lines):
        total, mass, tied = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(emit[at + i] for i in range(n) if y[i]) + sum(ties[a, b] for a, b in zip(y, y[1:])))
            total += w
            mass += w * np.array(y)
            for a, b in zip(y, y[1:]):
                tied[a, b] += w
        want += list(mass / total)
        want_pairs += tied / total
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


def test_line_features_do_not_depend_on_pieces(monkeypatch):
    texts = ["One line.\nTWO!! TWO!!\n\n| a | b", None, "", "x\n" * 400, "long " * 500]
    whole = [np.concatenate(c) for c in zip(*quality.features(pa.array(texts)))]
    for module in (words, quality):
        monkeypatch.setattr(module, "PIECE", 50)
    parts = [np.concatenate(c) for c in zip(*quality.features(pa.array(texts)))]
    assert all(np.allclose(a, b) for a, b in zip(whole, parts))
    assert whole[2].tolist() == [4, 1, 1, 401, 1]


def test_quality_learns_and_scores_odd_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        own = [" ".join(rng.choice(["the", "of", "and", "word", "text"]) for _ in range(12)).capitalize() + "." for _ in range(rng.randrange(1, 5))]
        bad = [" ".join(rng.choice(["BUY", "NOW", "WIN"]) + "!!" for _ in range(12)) for _ in range(rng.randrange(1, 5))]
        rows.append((i, "\n".join(own if good else own[:1] + bad), True, "", "clash"))
        labels.append((i, int(good)))
    rows += [(1000, None, True, "", ""), (1001, "", True, "", ""), (1002, "!" * 3_000_000, True, "", ""), (5, rows[5][1], True, "", "")]
    df = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(7, None), (1000, None)], "doc_id long, quality int")
    model = quality.train(df, known)
    out = quality.score(df, model)
    assert out.columns == ["doc_id", "text", "train", "ids", "score", "predicted"]
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in out.collect()}
    assert len(got) == 403 and all(0 <= s <= 1 and p == (s >= 0.3) for s, p in got.values())
    held = [(got[i][1], y) for i, y in labels if i % 2 == 0]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert quality.score(df.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, "a text", True, "", "")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(df, quality.train(df, none)).first()["score"] == pytest.approx(0.5)


# -- Katz ------------------------------------------------------------------------------

def brute_scores(rows):
    tokens = [((t or "").encode().lower().split() + [0], bool(train)) for _, t, train in rows]
    u, b = Counter(), Counter()
    for ts, train in tokens:
        if train:
            u.update(ts)
            b.update(zip([1, *ts[:-1]], ts))
    docs, n, v = sum(t for _, t in tokens), sum(u.values()), len(u)
    classes = lambda c: [sum(x == k for x in c.values()) for k in range(1, 7)]
    du, db = katz.discounts(classes(u)), katz.discounts(classes(b))
    taken = sum((1 - du[k]) * k * classes(u)[k - 1] for k in range(1, 6))
    unseen, scale = (taken / n, 1.0) if taken else (0.5 / (n + 0.5), n / (n + 0.5))
    low = lambda w: scale * du[min(u[w], 6)] * u[w] / n if u[w] else unseen
    seen = defaultdict(dict)
    for (a, w), c in b.items():
        if c >= 2:
            seen[a][w] = c
    alpha, beta = {}, {}
    for a, found in seen.items():
        c = docs if a == 1 else u[a]
        held = sum(db[min(k, 6)] * k for k in found.values()) / c
        left = max(1 - held, 0.5 / (c + 0.5))
        alpha[a], beta[a] = left / (1 - sum(map(low, found))), (1 - left) / held / c
    def p(a, w):
        c = seen.get(a, {}).get(w)
        return beta[a] * db[min(c, 6)] * c if c else alpha.get(a, 1.0) * low(w)
    for a in seen:  # exactly normalised
        assert sum(p(a, w) for w in u) + alpha[a] * unseen == pytest.approx(1)
    return [(len(ts), sum(u[w] > 0 for w in ts), n, sum(math.log10((u[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts),
             sum(math.log10(p(a, w)) for a, w in zip([1, *ts[:-1]], ts))) for ts, _ in tokens]


def test_katz_scores(spark, monkeypatch):
    monkeypatch.setattr(katz, "HEAD", 8)
    monkeypatch.setattr(katz, "PACK", 2000)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(vocabulary[min(int(rng.expovariate(0.15)), 59)] for _ in range(rng.randrange(40))), i % 5 != 1) for i in range(300)]
    rows += [(500, None, True), (501, "", None), (502, "NEW words W1 w2 é", False), (3, rows[3][1], True), (None, "w1 w2", True)]
    df = spark.createDataFrame([(*r, "", "clash") for r in rows], DOCS).repartition(5)
    out = katz.score(df)
    assert out.columns == ["doc_id", "train", *katz.RESULT]
    got = sorted(((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in out.collect()))
    want = sorted((i or -1, *s[:3], round(s[3], 6), round(s[4], 6)) for (i, *_), s in zip(rows, brute_scores(rows)))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], atol=1e-5)


def test_katz_without_training_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", False, "", "")], DOCS)
    r = katz.score(df).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and r["score"] == 0
    assert katz.score(df.limit(0)).count() == 0


# -- pieces ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    tokenizers = pytest.importorskip("public_tokenizers")
    return pieces.Transducer.load(tokenizers.path("piece_bpe_32k.model"))


def test_ids_equal_those_of_the_library(model):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    parts = ["a", "e", "th", "the", "ing", " ", "  ", "\n", "ñ", "😀", "1", "_", "http", "://", "\t", "漢", "aaa", "    ", "}\n", "\x00", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        ids = model.encode(text).tolist()
        assert ids == library.encode(text), repr(text)
        assert model.decode(ids) == text


def test_table_round_trip(spark, model):
    texts = ["", " ", "plain", "own ▁ mark▁", "x" * 200_000, "é" * 1000, "a  b\n\n c ", None, "plain"]
    df = spark.createDataFrame([(i, t, True, "clash", "") for i, t in enumerate(texts)], DOCS)
    out = pieces.encode_table(df, model)
    assert out.columns == ["doc_id", "text", "train", "score", "ids"]
    back = {r["doc_id"]: (r["t"], r["n"]) for r in out.select("doc_id", pieces.decode(F.col("ids"), model).alias("t"), F.size("ids").alias("n")).collect()}
    assert [back[i][0] for i in range(len(texts))] == texts and back[0][1] == 0
    assert pieces.encode_table(df.limit(0), model).count() == 0


def test_shortest_path_of_weights():
    base = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    scored = [("a", -1.0, 1), ("b", -1.0, 1), ("ab", -1.5, 1), ("abc", -6.0, 1), ("c", -2.0, 1), ("bc", -0.5, 1), ("▁", -3.0, 1), ("▁a", -1.2, 1)]
    unigram = pieces.Transducer.compiled(base + scored, merges=False, prefix=True)
    cost = {p: -s for p, s, _ in scored}

    def best(text):
        text = "▁" + text.replace(" ", "▁")
        at = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            at[end] = min((at[s][0] + (cost.get(text[s:end], 16.0 if end - s == 1 else math.inf)), at[s][1] + [text[s:end]]) for s in range(end))
        return at[len(text)][1]
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("abc é") for _ in range(rng.randrange(1, 9)))
        ids = unigram.encode(text).tolist()
        assert sum(cost.get(p, 16.0) for p in best(text)) == pytest.approx(path_cost(unigram, ids, cost))
        assert unigram.decode(ids) == text


def path_cost(model, ids, cost):
    names = {i: p for p, i in model.ids.items()}
    total, pending = 0.0, b""
    for i in ids:
        if i in names:
            total += cost[names[i]]
        else:
            pending += model.output[i]
            try:
                pending.decode()
                total, pending = total + 16.0, b""
            except UnicodeDecodeError:
                pass
    return total


def test_refuses_models_it_cannot_compile():
    with pytest.raises(ValueError):
        pieces.Transducer.compiled([("a", 0.0, 1)], True, True)
