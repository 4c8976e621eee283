import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import ppm


def counts_by_order(streams):
    """What follows each context: at the full order how often, in shorter ones after how many longer contexts."""
    tables = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    grams = Counter(s[i - ppm.ORDER : i + 1] for s in streams for i in range(ppm.ORDER, len(s)))
    for g, n in grams.items():
        tables[ppm.ORDER][g[:-1]][g[-1]] = n
    for order in range(ppm.ORDER - 1, -1, -1):
        for ctx, follow in tables[order + 1].items():
            for s in follow:
                tables[order][ctx[1:]][s] += 1
    return tables


def slow_price(tables, context, symbol):
    total, excluded = 0.0, set()
    for order in range(ppm.ORDER, -1, -1):
        follow = {s: n for s, n in tables[order][context[ppm.ORDER - order :]].items() if s not in excluded}
        if not follow:
            continue
        n = sum(follow.values())
        if symbol in follow:
            return total + math.log10((2 * follow[symbol] - 1) / (2 * n))
        total += math.log10(len(follow) / (2 * n))
        excluded |= follow.keys()
    return total - math.log10(256 - len(excluded))


def slow_scores(docs, train):
    words = [ppm.tokens(t or "") for _, t in docs]
    streams = [ppm._stream(w) for w in words]
    tables = counts_by_order([s for (i, _), s in zip(docs, streams, strict=True) if train(i)])
    c = Counter(x for (i, _), w in zip(docs, words, strict=True) if train(i) for x in w)
    n, v = sum(c.values()), len(c)
    out = []
    for (i, _), w, s in zip(docs, words, streams, strict=True):
        score = sum(slow_price(tables, s[k - ppm.ORDER : k], s[k]) for k in range(ppm.ORDER, len(s)))
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((i, not train(i), len(w), sum(c[x] > 0 for x in w), n, round(base, 5), round(score, 3)))
    return sorted(out, key=repr)


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def found(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 3)) for r in df.collect()), key=repr)


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-4 and abs(x[6] - y[6]) < 0.02, (x, y)


@pytest.mark.parametrize(("chunk", "grams"), [(1 << 25, 1 << 22), (3000, 1 << 22), (1 << 25, 50), (1, 1 << 22)])
def test_against_plain_loops(spark, duck, chunk, grams):
    """One chunk or many chunks in a task, by size or by n-grams."""
    docs = duck.execute("select doc_id, text from documents where length(text) < 900 order by doc_id limit 60").fetchall()
    docs += [(1000, None), (1001, ""), (1002, " \n "), (1003, "A a É \x00"), (1003, "A a É \x00"), (None, "nobody's text"), (1004, "z" * 5000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, train string, block int").repartition(3)
    near(found(ppm.score_documents(df, chunk=chunk, grams=grams, shard=500)), slow_scores(docs, fold))


def test_chunks_close_when_full():
    draw = np.random.default_rng(1)
    text = "".join(map(chr, draw.integers(0x4E00, 0x9000, 20_000)))
    chunk = ppm.Chunk()
    for i in range(200):
        chunk.add(i, i % 2 == 0, text[100 * i : 100 * i + 100])
    assert not chunk.full(1 << 20, 1000)  # not counted yet
    chunk.count()
    assert chunk.full(1 << 20, 1000) and chunk.full(20_000, 1 << 22) and not chunk.full(20_001, 1 << 22)
    assert chunk.sums[0].sum() == sum(len(s) - ppm.ORDER for s, t in zip(chunk.streams, chunk.train) if t)


def test_block_numbers_spread_over_the_partitions(spark):
    """Numbers differ, and hash as Spark does."""
    tasks, partitions = 40, 12
    numbers = [[next(x) for _ in range(5)] for x in (ppm.block_numbers(t, partitions) for t in range(tasks))]
    flat = sum(numbers, [])
    assert len(set(flat)) == len(flat)
    df = spark.createDataFrame([(x,) for x in flat], "x long")
    hashed = {r.x: r.p for r in df.select("x", F.pmod(F.hash("x"), F.lit(partitions)).alias("p")).collect()}
    assert all(hashed[x] == (t + k) % partitions for t, own in enumerate(numbers) for k, x in enumerate(own))
    many = ppm.block_numbers(3, 700)
    assert len({next(many) for _ in range(1000)}) == 1000


def test_probabilities_of_all_symbols_sum_to_one():
    streams = [ppm._stream(ppm.tokens(t)) for t in ("the cat sat on the mat", "the cart sat", "a b c")]
    keys, n = ppm._counted(np.concatenate([ppm.ngrams(s) for s in streams]))
    levels = {ppm.ORDER: ppm.Level(keys, n)}
    for k in range(ppm.ORDER - 1, -1, -1):
        levels[k] = ppm.shorter(levels[k + 1], k)
    for context in (b"e cat", b" the ", b"qqqqq", b"\xff" * 5, b"zzzat"):
        wanted = ppm.ngrams(b"".join(context + bytes([s]) for s in range(256)))[:: ppm.ORDER + 1]
        assert abs((10 ** ppm.prices(wanted, levels)).sum() - 1) < 1e-9


def test_held_out_texts_beat_the_words_alone(spark):
    from quillstream.llm.queries import op7_ppm_scores

    rows = op7_ppm_scores(spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = ppm.score_documents(df, F.lit(False)).first()
    assert r.held_out and r.train_tokens == 0 and abs(r.score + 5 * math.log10(256)) < 1e-4 and r.base_score == 0
    assert ppm.score_documents(df.limit(0)).count() == 0
