import random
import re

import pytest

from quillstream.llm import mixing


def one_by_one(votes, seats):
    given = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * given[i] + 1), -i))
        given[i] += 1
    return given


@pytest.mark.parametrize("seed", range(8))
def test_apportionment(seed):
    draw = random.Random(seed)
    for _ in range(60):
        votes = [draw.choice([0, 1, 5, 5, 100, draw.random() * 1000]) for _ in range(draw.randint(1, 12))]
        seats = draw.randint(0, 200)
        if sum(votes):
            assert mixing.apportion(votes, seats) == one_by_one(votes, seats)


def test_targets():
    assert mixing.targets({"a": 600, "b": 600, "c": 600}) == {"a": 300, "b": 600, "c": 900}
    found = mixing.targets({"a": 900, "b": 10, "c": 90, None: 0})
    assert found["b"] == 30 and found["c"] == 270 and found["a"] == 700 and found[None] == 0
    assert mixing.targets({}) == {} and mixing.targets({"a": 0, "b": 0}) == {"a": 0, "b": 0}
    assert list(mixing.targets({None: 5, "é": 5, "z": 5, "Z": 5})) == ["Z", "z", "é", None]


def check(rows, docs):
    size = {i: len(re.findall(mixing.WORD, t or "")) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    target = mixing.targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1, s
    return taken


def test_query(spark, sf_dir, duck):
    from quillstream.llm.queries import op10_source_mixing

    docs = duck.execute("select doc_id, text, source from documents").fetchall()
    df = op10_source_mixing(spark, sf_dir)
    check(df.collect(), docs)
    again = op10_source_mixing(spark, sf_dir)
    assert sorted(df.collect()) == sorted(again.collect())


def test_many_shards_and_odd_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 100)
    draw = random.Random(9)
    docs = [(i, " ".join("w" * draw.randint(1, 4) for _ in range(draw.randint(0, 300))), draw.choice(["big", "big", "big", "b", None, "Ü", "tiny"])) for i in range(400)]
    docs += [(1000, None, "b"), (1001, "", "none"), (1002, " \t  ", "nbsp"), (1003, "one " * 5000, "tiny")]
    df = spark.createDataFrame([(*d, "x", 1, {"k": d[1]}) for d in docs], "doc_id long, text string, source string, shard string, size int, _row map<string,string>")
    check(mixing.mixed_documents(df).collect(), docs)
    mixed = mixing.take(df)
    assert mixed.columns == df.columns
    words = {}
    originals = {i: re.findall(mixing.WORD, t or "") for i, t, _ in docs}
    for r in mixed.collect():
        found = re.findall(mixing.WORD, r.text)
        assert found and " ".join(found) in " ".join(originals[r.doc_id]) and r.shard == "x"
        words[r.doc_id] = words.get(r.doc_id, 0) + len(found)
    assert words == {r.doc_id: r.taken for r in mixing.mixed_documents(df).collect() if r.taken}


def test_small_sources_get_their_targets(spark):
    draw = random.Random(3)
    words = {"a": 100_000, "b": 40, "c": 30, "d": 5, "e": 1, "f": 0, None: 100}
    docs = []
    for s, n in words.items():
        while n > 0:
            k = min(n, draw.randint(1, 90) if n > 200 else draw.randint(1, 12))
            docs.append((len(docs), " ".join(["w"] * k), s))
            n -= k
        docs.append((len(docs), "", s))
    rows = mixing.mixed_documents(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    taken = check(rows, docs)
    assert taken["b"] == 120 and taken["c"] == 90 and taken["d"] == 15


@pytest.mark.parametrize("seed", range(5))
def test_picks_come_to_the_quota(seed):
    draw = random.Random(seed)
    for _ in range(300):
        block, size = draw.randint(1, 70), draw.randint(1, 500)
        words = draw.randint(0, 3 * size)
        whole = -(-size // block)
        step = draw.choice([k for k in range(1, whole + 1) if mixing.math.gcd(k, whole) == 1])
        offset = draw.randrange(whole)
        passes, blocks, chosen, cut = mixing._pick(words, size, block, offset, step)
        lengths = {(b * step + offset) % blocks: min(block, size - b * block) for b in range(blocks)}
        assert sorted(lengths) == list(range(blocks))
        assert passes * size + sum(lengths[r] for r in range(chosen)) - cut == words
        assert cut == 0 or 0 < cut < lengths[chosen - 1]


def test_shards_share_the_words(monkeypatch):
    draw = random.Random(2)
    for _ in range(200):
        sizes = [draw.choice([0, 1, 3, 70, 1000]) for _ in range(draw.randint(1, 9))] + [1]
        words = draw.randint(0, 3 * sum(sizes))
        given = mixing._words_by_shard(round(words / 64), words, sizes, 64, 3)
        assert sum(given) == words and all(0 <= g <= 3 * z for g, z in zip(given, sizes, strict=True))


def test_null_and_repeated_ids_are_spread(spark, monkeypatch):
    """Rows without an id, and one row repeated many times, go to many shards."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 50)
    monkeypatch.setattr(mixing, "COPIES", 7)
    docs = [(None, f"w{i} " * 5, "s") for i in range(400)] + [(7, "same row " * 3, "s")] * 500
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing._mix(df, 1).collect()
    assert len(rows) == 900 and sum(r["size"] for r in rows) == 5000
    assert sorted(r.copy for r in rows if r.doc_id == 7) == list(range(500))
    assert sum(r.taken for r in rows) == 5000
    mixed = mixing.take(df).collect()
    assert sum(len(r.text.split()) for r in mixed) == 5000


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 600_000, "a"), (2, "x y", "b")], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.mixed_documents(df).collect()}
    assert rows[2].taken == 6 and rows[1].taken == 600_002 - 6
    assert sum(len(r.text.split()) for r in mixing.take(df).collect()) == 600_002


def test_spans_keep_the_text_between_words():
    spans = [{"from": 1, "to": 3}, {"from": 3, "to": 4}, {"from": 5, "to": 6}]
    assert mixing._taken_texts(" a\tb  c d e f ", 1, spans) == [" a\tb  c d e f ", "b  c d", "f"]
    assert mixing._taken_texts("a b", 0, [{"from": 0, "to": 2}]) == ["a b"]


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "d", None)], "doc_id long, text string, source string")
    rows = mixing.mixed_documents(df).collect()
    assert len(rows) == 3 and sum(r["size"] for r in rows) == 7
    assert mixing.mixed_documents(df.limit(0)).count() == 0 and mixing.take(df.limit(0)).count() == 0
    assert mixing.mixed_documents(df.withColumn("text", df.text[0:0])).where("taken > 0").count() == 0
