import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import toxicity as tox


def corpus(n, seed, share=0.2):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    bad = ["vilest", "grimbo", "snarkul"]
    texts, marks = [], []
    for _ in range(n):
        x = [draw.choice(words) for _ in range(draw.randint(5, 80))]
        toxic = draw.random() < share
        if toxic:
            for _ in range(draw.randint(1, 3)):
                x.insert(draw.randrange(len(x)), draw.choice(bad) + draw.choice(["", "s", "ing"]))
        texts.append(" ".join(x))
        marks.append(int(toxic))
    return texts, marks


def test_learns_from_positive_and_unlabelled_texts():
    texts, marks = corpus(1500, 1)
    positive = [t for t, m in list(zip(texts, marks))[:600] if m]
    c = tox.fit_texts(positive, texts[600:], 0.2)
    more, truth = corpus(3000, 1)  # the first half is the same
    found = c.scores(more[1500:], {}) >= 0.5
    assert np.mean(found == np.array(truth[1500:])) > 0.95


def matrix(rows):
    return tox.Sparse.of([{j: int(v) for j, v in enumerate(r) if v} for r in rows], rows.shape[1])


def slow_risk(w, p, u, prior):
    """Both parts by plain loops."""
    g = lambda x: sum(a * b for a, b in zip(x, w)) + w[-1]
    s = lambda z: 1 / (1 + np.exp(-z))
    return prior * np.mean([s(-g(x)) for x in p]), np.mean([s(g(x)) for x in u]) - prior * np.mean([s(g(x)) for x in p])


@pytest.mark.parametrize("seed", range(6))
def test_risk_and_gradient_against_slow_ones(seed):
    draw = np.random.default_rng(seed)
    p, u = draw.poisson(0.7, (9, 6)), draw.poisson(0.7, (30, 6))
    w, prior = draw.normal(0, 1.5, 7), [0.1, 0.9][seed % 2]
    plus, minus = tox.risk(w, matrix(p), matrix(u), prior)
    assert np.allclose((plus, minus), slow_risk(w, p, u, prior))
    found = tox.risk_gradient(w, matrix(p), matrix(u), prior)
    for j in range(7):
        step = np.eye(7)[j] * 1e-6
        up, down = slow_risk(w + step, p, u, prior), slow_risk(w - step, p, u, prior)
        slope = (sum(up) - sum(down)) / 2e-6 if minus >= 0 else -(up[1] - down[1]) / 2e-6
        assert abs(found[j] - slope) < 1e-6


def test_both_branches_are_tried():
    draw = np.random.default_rng(1)
    signs = set()
    for seed in range(6):
        draw = np.random.default_rng(seed)
        p, u = draw.poisson(0.7, (9, 6)), draw.poisson(0.7, (30, 6))
        w, prior = draw.normal(0, 1.5, 7), [0.1, 0.9][seed % 2]
        signs.add(tox.risk(w, matrix(p), matrix(u), prior)[1] >= 0)
    assert signs == {True, False}


def test_the_risk_stays_about_zero():
    """Positives that are few and easy: without the bound the negative part would go far below zero."""
    draw = np.random.default_rng(1)
    p, u = matrix(draw.poisson(1, (5, 40))), matrix(draw.poisson(1, (200, 40)))
    w, b = tox.nnpu(p, u, 0.5)
    assert tox.risk(np.append(w, b), p, u, 0.5)[1] > -0.05


def test_fit_equals_training_on_the_texts_at_hand(spark, sf_dir):
    """Features chosen and counted in Spark, against plain Python on the same sample; words late in a long text count."""
    texts, marks = corpus(300, 8)
    texts = [t + (" " + " ".join(f"filler{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5000)) + (" zzzlate" if m else "")) for t, m in zip(texts, marks)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    rows, prior = tox.sample(docs, labels, F.lit(True))
    rows = rows.orderBy("doc_id").collect()
    slow = tox.fit_texts([r.text for r in rows if r.p], [r.text for r in rows if not r.p], prior)
    found = tox.fit(docs, labels, F.lit(True))
    assert found.weights.keys() == slow.weights.keys() and abs(found.bias - slow.bias) < 1e-6
    assert all(abs(found.weights[f] - x) < 1e-6 for f, x in slow.weights.items()) and "=zzzlate" in found.weights


def test_held_out_accuracy(spark, duck):
    from quillstream.llm.queries import op4_toxicity

    rows = {r.doc_id: r for r in op4_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = duck.execute("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(rows[i].predicted, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p == t for p, t in held]) > 0.94
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_edges(spark):
    texts, marks = corpus(200, 5)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", None), (None, "a b", "x"), (3, texts[3], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    c = tox.fit(docs, labels)
    out = tox.score_documents(docs, c)
    assert out.count() == docs.count() and out.where("score is null").count() == 0
    assert tox.reject_toxic(docs, c).columns == docs.columns
    none = tox.fit(docs, labels.limit(0))
    assert tox.score_documents(docs, none).where("predicted = 1").count() == 0
    assert tox.score_documents(docs.limit(0), c).count() == 0
    assert tox.fit(docs.limit(0), labels) is not None
