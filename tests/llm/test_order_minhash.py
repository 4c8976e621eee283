import hashlib
import random

from pyspark.sql import functions as F

from quillstream.llm import order_minhash as omh


def prints(spark, texts):
    df = omh.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "p")
    return [r.p for r in df.orderBy("i").collect()]


def like(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / max(len(a), len(b))


def slow(spark, text):
    """The fingerprint by plain loops; hashes come from Spark."""
    import re

    words = []
    for run in re.findall(r"[^\x20\x09-\x0D]+", text):
        words += [run[i : i + omh.PIECE] for i in range(len(run) - omh.PIECE + 1)] if len(run) > omh.WORD_LENGTH else [run]
    n = len(words)
    mers = [tuple(words[i : i + omh.K]) for i in range(max(n - omh.K + 1, min(n, 1)))]
    if not mers:
        return []
    rows = spark.createDataFrame([(i, list(m) + [None] * (omh.K - len(m))) for i, m in enumerate(mers)], "i int, m array<string>")
    code = [r.h for r in rows.select("i", F.xxhash64(*(F.col("m")[k] for k in range(omh.K))).alias("h")).orderBy("i").collect()]
    seen, numbered = {}, []
    for h in code:
        key = h >> omh.PLACE_BITS
        numbered.append((key, seen.get(key, 0)))
        seen[key] = seen.get(key, 0) + 1
    ranks = [r.r for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(numbered)], "i int, a long, b int").select("i", F.xxhash64("a", "b").alias("r")).orderBy("i").collect()]
    ring = sorted((r >> omh.PLACE_BITS, i) for i, r in enumerate(ranks))
    chosen = []
    for s in range(omh.SLOTS):
        first = sum((r >> (36 - omh.SLOT_BITS)) < s - omh.SLOTS // 2 for r, _ in ring)
        chosen.append((s, [code[i] for i in sorted(ring[(first + k) % len(ring)][1] for k in range(min(omh.TUPLE, len(ring))))]))
    hashed = spark.createDataFrame(chosen, "s int, c array<long>").select("s", F.xxhash64(*(F.get("c", F.lit(k)) for k in range(omh.TUPLE))).alias("h")).orderBy("s").collect()
    return [((r.s - omh.SLOTS // 2) << (32 - omh.SLOT_BITS)) | (r.h % 2**64) >> (32 + omh.SLOT_BITS) for r in hashed]


def test_against_plain_loops(spark):
    draw = random.Random(2)
    texts = ["", "one", "one two", "one two three", " ".join(draw.choice("abcd") for _ in range(90)), " ".join(str(draw.random()) for _ in range(200)), "same " * 60, "x" * 40, "日本 語\n" * 9, "日本語の文章には空白がありませんから長い語になります。", "a 😀" + "😀é" * 12, "0123456789abcdef", "0123456789abcdefg"]
    for text, found in zip(texts, prints(spark, texts), strict=True):
        assert found == slow(spark, text), text[:20]


def test_order_counts(spark):
    """Two texts of the same k-mers in another order share less than two texts in the same order."""
    draw = random.Random(4)
    parts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(8)) for _ in range(60)]
    shuffled = parts[:]
    draw.shuffle(shuffled)
    changed = parts[:]
    changed[7] = "something else"
    a, b, c, d = prints(spark, [" ".join(x) for x in (parts, shuffled, changed, parts)])
    assert a == d and like(a, c) > 0.8 and like(a, b) < like(a, c)


def test_an_edit_of_a_text_without_spaces(spark):
    """One character more or less, at the front or inside, leaves most of the fingerprint."""
    draw = random.Random(12)
    text = "".join(draw.choice("日月火水木金土人大小中上下左右山川田") for _ in range(2000))
    base64 = "".join(draw.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(2000))
    a, b, c, d, e, f = prints(spark, [text, "新" + text, text[:900] + text[901:], base64, "x" + base64, text[::-1]])
    assert min(like(a, b), like(a, c), like(d, e)) > 0.85 and like(a, f) < 0.1


def test_order_counts_in_short_texts(spark):
    draw = random.Random(5)
    near, swapped = [], []
    texts = []
    for _ in range(30):
        words = [f"w{draw.randrange(10**6)}" for _ in range(20)]
        texts += [" ".join(words), " ".join(words[10:] + words[:10]), " ".join(words[:-1] + ["other"])]
    found = prints(spark, texts)
    for a, b, c in zip(found[::3], found[1::3], found[2::3], strict=True):
        assert len(a) == omh.SLOTS
        swapped.append(like(a, b))
        near.append(like(a, c))
    assert sum(swapped) / 30 < 0.6 and sum(near) / 30 > sum(swapped) / 30 + 0.2


def test_a_very_long_text(spark):
    draw = random.Random(9)
    text = " ".join(f"w{draw.randrange(10**5)}" for _ in range(150_000))
    a, b, c, d = prints(spark, [text, "more " + text, "q" + "abcdefgh" * 20_000, "abcdefgh" * 20_000])
    assert like(a, b) > 0.9 and len(c) == len(d) == omh.SLOTS


def test_next_rows_over_many_ranges(spark):
    ids = random.Random(6).sample(range(-500, 5000), 700)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(7)
    order = sorted(ids, reverse=True)
    after = {order[k]: f"t{order[(k + 1) % len(order)]}" for k in range(len(order))}
    assert {r.doc_id: r.next_text for r in omh.with_next(df, ["text"], "text").collect()} == after


def test_null_and_repeated_ids_are_cut_apart(spark):
    """All rows share two ids: they still fall into many ranges, and each is followed once."""
    df = spark.createDataFrame([(None if i % 2 else 5, f"t{i}", "r") for i in range(3000)], "doc_id long, text string, range string").repartition(5)
    rows = omh.with_next(df, ["text"], "text").collect()
    assert len({r.next_text for r in rows}) == 3000 and {r.range for r in rows} == {"r"}
    firsts = [r for r in rows if r.doc_id == 5 and int(r.next_text[1:]) % 2]
    assert len(firsts) == 1


def test_query_against_plain_python(spark, sf_dir, duck):
    from quillstream.llm.queries import op5_order_minhash

    rows = {r.doc_id: r for r in op5_order_minhash(spark, sf_dir).collect()}
    docs = sorted(duck.execute("select doc_id, text from documents").fetchall(), reverse=True)
    assert len(rows) == len(docs)
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[1][:third]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        chunks = lambda t: {t[j : j + 8] for j in range(0, len(t), 8)}
        a, e, b = chunks(r.fingerprint), chunks(r.edited_fingerprint), chunks(rows[following[0]].fingerprint)
        assert r.near_edited == len(a & e) / max(len(a), len(e)) and r.near_next == len(a & b) / max(len(a), len(b))
    assert sum(r.near_edited for r in rows.values()) > 50 * sum(r.near_next for r in rows.values())


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (2, "b b b", None), (2, "b b b", None), (None, "c", "p"), (5, "é" * 9, "p")], "doc_id long, text string, print string")
    rows = omh.fingerprint_documents(df).collect()
    assert len(rows) == 6 and all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {""}
    one = omh.fingerprint_documents(df.where("doc_id = 5")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(("é" * 9).encode()).hexdigest()
    assert omh.fingerprint_documents(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    from quillstream.llm.queries import op5_order_minhash

    plan = op5_order_minhash(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
