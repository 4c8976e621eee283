import random
import time

import numpy as np
import pytest
import sentencepiece as library

from quillstream.llm import sentencepiece as sp


@pytest.fixture(scope="module")
def encoder():
    return sp.Encoder()


@pytest.fixture(scope="module")
def own():
    return library.SentencePieceProcessor(model_file=sp.MODEL)


EDGES = ["", "a", " a", "  a", "Hello  world\n\tü foo▁bar 日本", "aaaa aaaaaaaaa", "    ", "x" + " " * 100 + "y", "\x00 <s> </s> <0x41> 😀é" + " " * 17 + "(", " " * 16, " " * 200 + "z", "no" * 300, "日本語テキスト処理の例です。", "á ﬁ Å"]


def test_ids_are_the_library_s(encoder, own):
    draw = random.Random(1)
    texts = EDGES + ["".join(draw.choice("aabcdeinrst  ▁'.XY12é日\n") for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    assert [x.tolist() for x in encoder.encode(texts)] == own.encode(texts)


def long_texts():
    draw = random.Random(11)
    pick = lambda x, n: "".join(draw.choices(x, k=n))
    return {
        "Japanese": pick("日本語処理文章空白東京大学人工知能のはにをがですます。", 330_000), "letters": pick("etaoinshrdlu", 250_000), "one letter": "x" * 250_000,
        "base64": pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 250_000), "marks": " " * 250_000, "marks and letters": "a" + " " * 100_001 + "b" * 30_000,
        "outside": pick("😀é𝄞𓀀", 60_000), "words joined": "thequickbrownfoxjumpsover" * 8_000,
    }


@pytest.mark.parametrize("kind", long_texts())
def test_long_texts_without_spaces(kind, encoder, own):
    """Ids are the library's, at no more than 5 seconds a megabyte."""
    text = long_texts()[kind]
    began = time.perf_counter()
    ids = encoder.encode([text])[0].tolist()
    seconds = time.perf_counter() - began
    assert ids == own.encode(text)
    assert seconds < 5 * max(1, len(text.encode()) / 1e6)
    assert not any(len(w) > sp.LONG for w in encoder.known)


def test_plain_loops_and_numpy_walk_the_same_lattice(encoder, own, monkeypatch):
    draw = random.Random(5)
    words = sorted({sp.MARK + "".join(draw.choice("aeinrstlXY12é日") for _ in range(draw.randint(1, 14))) for _ in range(3000)})
    packed = []
    for few in (0, 10**9):
        monkeypatch.setattr(sp, "FEW", few)
        e = sp.Encoder()
        e.learn(set(words))
        packed.append([e.known[w] for w in words])
    assert packed[0] == packed[1]


def test_runs_of_marks(encoder):
    """The heap merges like a search for the best pair at every step."""
    m = encoder.model

    def slow(word):
        parts = list(word)
        while True:
            best = min(((-m.scores[i], k) for k in range(len(parts) - 1) if (i := m.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    draw = random.Random(6)
    for word in [sp.MARK * n for n in range(1, 150)] + ["".join(draw.choice("aeinrst▁") for _ in range(40)) for _ in range(200)]:
        assert sp._merge(word, m.ids, m.scores) == slow(word)


def test_documents_encode_and_come_back(encoder, own, duck):
    texts = [t for (t,) in duck.execute("select text from documents").fetchall()]
    ids = [x.tolist() for x in encoder.encode(texts)]
    assert ids == own.encode(texts)
    assert encoder.decode(ids) == [t.replace(sp.MARK, " ") for t in texts]


def test_a_small_cache_changes_nothing(own, duck, monkeypatch):
    monkeypatch.setattr(sp, "CACHED_WORDS", 50)
    texts = [t[:2000] for (t,) in duck.execute("select text from documents limit 40").fetchall()]
    e = sp.Encoder()
    assert [x.tolist() for t in texts for x in e.encode([t])] == own.encode(texts)


def test_unigram_path_is_the_best_one(encoder):
    """With scores as log probabilities the path is as good as that of a plain search."""
    draw = random.Random(3)
    m = encoder.model
    scores = np.array([-draw.random() * 10 - 0.1 for _ in m.pieces])
    from dataclasses import replace

    model = replace(m, bpe=False, scores=scores)
    words = ["".join(draw.choice("aeinrst▁") for _ in range(9)) for _ in range(60)]
    piece, on_path = sp.viterbi(model, words, sp.Fits(model))
    walk = sp.Walk(model)
    for r, w in enumerate(words):
        assert [p for p, _ in walk.path(w)] == piece[r][on_path[r]].tolist()
    reached = set(m.key_ids.tolist())
    worst = scores.min() - 10
    for r, w in enumerate(words):
        best = [0.0] + [-1e9] * len(w)
        for i in range(1, len(w) + 1):
            for k in range(max(0, i - m.longest), i):
                j = m.ids.get(w[k:i])
                s = scores[j] if j is not None and j in reached else worst if i - k == 1 else None
                if s is not None:
                    best[i] = max(best[i], best[k] + s)
        found = sum(scores[p] if p >= 0 else worst for p in piece[r][on_path[r]])
        assert abs(found - best[-1]) < 1e-9


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello world", 5), (3, "hello world", 5), (None, "wörld " * 30_000, None)], "doc_id long, text string, ids int")
    rows = sp.encode_documents(df).collect()
    assert [r.n_tokens for r in rows][:2] == [0, 0] and rows[2].ids == rows[3].ids and all(r.round_trip for r in rows)
    assert sp.encode_documents(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    back = df.select(sp.decoded(sp.encoded(F.col("text"))).alias("t")).collect()
    assert [r.t for r in back][1:4] == ["", "hello world", "hello world"]
