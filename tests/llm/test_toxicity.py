"""Multiple-instance toxicity: formulas against plain code, what may and may not act on a score, bounds of the training sample."""

import math
import random
import zlib

import numpy as np
import pytest

from quillstone.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string"


def corpus(n=300):
    rnd = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(n):
        lines = [" ".join(rnd.choice(words) for _ in range(6)) for _ in range(5)]
        if i % 3 == 0:
            lines[i % 5] += f" {rnd.choice(['zorgface', 'plonk'])}"
        rows.append((i, ". ".join(lines), "en", "s"))
    return rows


def test_scores_by_the_definition():
    """A sentence: bias and weights of its distinct words' features; a text: one minus the product of what is left."""
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.standard_normal(toxicity.SPACE).astype(np.float32), -1.0)
    texts = [None, "", "  \n ", "Plonk plonk. — ! One", "x" * 9, *[r[1] for r in corpus(40)], "Wort\nÄÖÜ ß İstanbul ΣΑΣ. " * 300]
    scored = model.scorer(memo_size=50)
    for some in (texts, texts[::-1], texts):  # also with words remembered and forgotten
        z, counts = scored(some)
        got, at = toxicity.noisy_or(z, counts), 0
        for text, p, n in zip(some, got, counts.tolist()):
            want = []
            for s in toxicity.sentences(text):
                words = set(toxicity._WORD.findall(s.lower()))
                want.append(-1.0 + sum(float(model.weights[toxicity.features(w)].sum()) for w in words))
            assert z[at : at + n] == pytest.approx(want, abs=1e-4)
            assert p == pytest.approx(1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in want), abs=1e-5)
            at += n


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(2)
    n, docs = 12, 9
    sizes = rng.integers(1, 4, docs)
    doc = np.repeat(np.arange(docs), sizes)
    m = len(doc)
    sent = np.repeat(np.arange(m), 3)
    feats = rng.integers(0, n, len(sent))
    y = (np.arange(docs) % 2).astype(float)
    cost = rng.random(docs)
    w, bias = rng.standard_normal(n), -0.5
    loss = lambda w, b: toxicity.loss_and_gradient(w, b, y, cost, doc, sent, feats, m)[0]
    gradient = toxicity.loss_and_gradient(w, bias, y, cost, doc, sent, feats, m)[1]
    eps = 1e-6
    for i in range(n):
        up, down = w.copy(), w.copy()
        up[i] += eps
        down[i] -= eps
        assert gradient[i] == pytest.approx((loss(up, bias) - loss(down, bias)) / (2 * eps), abs=1e-6)
    assert gradient[-1] == pytest.approx((loss(w, bias + eps) - loss(w, bias - eps)) / (2 * eps), abs=1e-6)


def test_held_out_labels_and_other_columns_change_no_score(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    held = [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    labels = lambda flip: spark.createDataFrame([(r[0], int(r[0] % 3 == 0) ^ int(flip and r[0] in held)) for r in rows], "doc_id long, toxic int")
    one = {r["doc_id"]: r["score"] for r in toxicity.predicted(docs, labels(False)).collect()}
    two = {r["doc_id"]: r["score"] for r in toxicity.predicted(docs.selectExpr("doc_id", "text", "'x' lang", "cast(doc_id as string) source"), labels(True)).collect()}
    assert one == two and len(held) > 20
    assert sum((one[i] >= 0.5) == (i % 3 == 0) for i in held) >= 0.95 * len(held)


def test_training_rows_are_bounded(spark, monkeypatch):
    """However often an id repeats, and however long a text is."""
    seen = []
    monkeypatch.setattr(toxicity, "fit_bags", lambda bags: seen.append(bags))
    rows = [(1, f"toxic text {i % 500}", "", "") for i in range(5000)] + [(2, "clean", "", "")] * 5000 + [(3, "a b. " * 50_000, "", ""), (6, "word " + " ".join(f"x{i}" for i in range(50_000)), "", "")]
    labels = [(1, 1), (1, 1), (2, 0), (3, 0), (6, 0)]
    toxicity.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), max_per_class=10)
    bags = seen[0]
    kept = [i for i in (1, 2, 3, 6) if zlib.crc32(str(i).encode()) % 5]
    assert sum(b[0] == 1 for b in bags) == (10 if 1 in kept else 0) and sum(b[0] == 0 for b in bags) == len([i for i in kept if i != 1])
    assert all(len(f) <= toxicity.MAX_FEATURES for _, f, _ in bags)


def long_rows(n=24):
    """Texts beyond a training block; of every third one sentence offends, of a sixth the first sentence is beyond a block."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    rows = [(1000, "", 0), (1001, " \n", 0), (1002, "plonk", 1), (1003, None, 0)]
    for i in range(n):
        lines = [" ".join(word() for _ in range(8)) for _ in range(1200)]
        if i % 6 == 1:
            lines[0] = " ".join(word() for _ in range(8000))
        if i % 3 == 0:
            lines[rnd.randrange(1200)] += " zorgface"
        rows.append((i, ". ".join(lines), int(i % 3 == 0)))
    return rows


def plain_bag(text):
    own = [[x for w in set(toxicity._WORD.findall(s.lower())) for x in toxicity.features(w)] for s in toxicity.sentences(text)]
    return np.array([x for f in own for x in f], np.int32), np.array([len(f) for f in own], np.int32)


def test_long_texts_train_whole(spark, monkeypatch):
    """Every sentence and word of a long text is learnt from, whoever sums the gradient."""
    rows = long_rows()
    bags = {i: (y, *plain_bag(text)) for i, text, y in rows}
    assert sum(len(f) > toxicity.MAX_FEATURES for _, f, _ in bags.values()) >= 24
    for i, text, _ in rows:
        f, sizes = toxicity.bag(text)
        assert sorted(f) == sorted(bags[i][1].tolist()) and sizes == bags[i][2].tolist()
    docs = spark.createDataFrame([(i, text, "en", "s") for i, text, _ in rows], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    bags = [b for i, b in bags.items() if zlib.crc32(str(i).encode()) % 5]
    want = toxicity.fit_bags(bags, steps=12)
    here, there = toxicity.fit_bags, toxicity.fit_blocks
    used = []
    monkeypatch.setattr(toxicity, "fit_bags", lambda bags: used.append("here") or here(bags, steps=12))
    monkeypatch.setattr(toxicity, "fit_blocks", lambda *a: used.append("there") or there(*a, steps=12))
    for bound in (toxicity.LOCAL_FEATURES, 1000):
        monkeypatch.setattr(toxicity, "LOCAL_FEATURES", bound)
        got = toxicity.train(docs, labels)
        assert got.bias == pytest.approx(want.bias, abs=1e-6) and got.weights == pytest.approx(want.weights, abs=1e-4)
    assert used == ["here", "there"] and np.count_nonzero(want.weights) > 100


def test_slope_of_blocks_equals_that_of_whole_texts():
    rows = long_rows(6)
    rng = np.random.default_rng(4)
    w, bias, cost = rng.standard_normal(toxicity.SPACE) * 0.3, -4.0, np.array([0.2, 0.5])
    cut = [(y, last, np.array(f, np.int64), np.array(n, np.int64)) for _, text, y in rows for last, f, n in toxicity.blocks(text)]
    assert len(cut) > len(rows) + 6
    y, *packed = toxicity._packed([(y, *plain_bag(text)) for _, text, y in rows])
    assert toxicity._slope(iter(cut), w, bias, cost) == pytest.approx(toxicity.loss_and_gradient(w, bias, y, cost[y], *packed)[1], abs=1e-8)


def test_without_both_classes_every_score_is_zero(spark):
    docs = spark.createDataFrame([(1, "a. b", "", ""), (2, None, "", "")], DOCS)
    for labels in ([], [(1, 1)], [(1, 0), (1, 1)], [(None, 1), (2, None)]):
        out = toxicity.predicted(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert [r["score"] for r in out] == [0.0, 0.0] and {r["worst_score"] for r in out} <= {0.0, None}


def test_a_clashing_score_column_of_another_type_is_replaced(spark):
    docs = spark.createDataFrame([(1, "a", "keep", "x")], "doc_id long, text string, score string, n_sentences string")
    out = toxicity.score(docs, toxicity.Model(np.zeros(toxicity.SPACE, np.float32), 0.0)).collect()
    assert [(r["doc_id"], r["score"], r["n_sentences"]) for r in out] == [(1, 0.5, 1)]
