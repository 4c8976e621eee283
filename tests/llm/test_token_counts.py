import random

import pytest

from quillstream.llm import token_counts as tc


def test_suffix_sums_against_brute_force(spark, sf_dir, duck):
    texts = [t for (t,) in duck.execute("select text from documents").fetchall()]
    lengths = [len(tc.encoding(tc.TOKENIZER).encode_ordinary(t)) for t in texts]
    from quillstream.llm.queries import op2_token_counts

    limits = op2_token_counts(spark, sf_dir)
    rows = limits.collect()
    assert sorted(r.context_limit for r in rows) == sorted(set(lengths))
    for r in rows:
        n = r.context_limit
        assert (r.docs, r.docs_longer, r.tokens_longer) == (lengths.count(n), sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        assert (r.total_docs, r.total_tokens, r.truncated_tokens) == (len(lengths), sum(lengths), sum(min(x, n) for x in lengths))
        assert r.lost_tokens == r.total_tokens - r.truncated_tokens
    ordered = sorted(lengths)
    for q in tc.quantiles(limits, [0.01, 0.5, 0.9, 1.0]).collect():
        assert q.n_tokens == ordered[max(0, -(-round(q.share * len(ordered) * 1e6) // 1_000_000) - 1)]


def test_any_limit_and_edges(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("hello world", 3), ("hello world", 3), ("x" * 100_000, 4)], "text string, docs int")
    hist = tc.length_histogram(df, tc.token_count(tc.whole_text()))
    found = {r.n_tokens: r.docs for r in hist.collect()}
    assert found[0] == 2 and found[2] == 2 and len(found) == 3
    long = max(found)
    rows = tc.totals_at(hist, [0, 1, 10**6]).collect()
    assert [(r.docs_longer, r.truncated_tokens) for r in rows] == [(3, 0), (3, 3), (0, 4 + long)]
    empty = tc.length_histogram(df.limit(0), tc.token_count(tc.whole_text()))
    assert tc.context_limits(empty).count() == 0
    assert [r.truncated_tokens for r in tc.totals_at(empty, [5]).collect()] == [0]


SPACES = " \t\n\r\x0b\x0c\x85\xa0\u2003\u3000"


def test_runs_of_white_space_count_as_before(monkeypatch):
    """Cut at every run of two or more: the count is that of the whole text."""
    monkeypatch.setattr(tc, "LONG_RUN", tc.re.compile(f"[{tc.SPACE}]{{2,}}"))
    e = tc.encoding(tc.TOKENIZER)
    draw = random.Random(4)
    for _ in range(4000):
        text = "".join(draw.choice(["a", "word", "'s", "12", "!?", "é", "\x1c", "".join(draw.choice(SPACES) for _ in range(draw.randint(1, 6)))]) for _ in range(draw.randint(0, 12)))
        assert tc.count_tokens(text) == len(e.encode_ordinary(text)), repr(text)


@pytest.mark.parametrize("space", [" ", "\n", "\t", " \n"])
def test_long_runs_of_white_space(space):
    """As many tokens as the tokenizer finds where it can (below its limit), and no crash beyond."""
    e = tc.encoding(tc.TOKENIZER)
    for n in (600, 5_000, 100_000):
        for text in (space * n, "a" + space * n, space * n + "b c", "x y" + space * n + "z" + space * n):
            assert tc.count_tokens(text) == len(e.encode_ordinary(text))
    n = 2_000_000 // len(space)
    a, b = (tc.count_tokens("one" + space * n + rest) for rest in ("", "two"))
    assert 0 < a <= 2_000_001 and abs(a - b) <= 3


def test_odd_texts_in_spark(spark):
    texts = ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "x" * 1_000_000, None, "", "hello world", "hello world"]
    df = spark.createDataFrame([(t, "clash", 1) for t in texts], "text string, n_tokens string, docs int")
    rows = tc.document_token_counts(df).orderBy("context_limit").collect()
    assert sum(r.docs for r in rows) == 7 and rows[0].docs == 2 and rows[0].total_tokens == sum(r.docs * r.context_limit for r in rows)
    assert tc.document_token_counts(df.limit(0)).count() == 0


def test_blocks_of_lengths(spark):
    hist = spark.createDataFrame([(n, 1 + n % 3) for n in range(0, 1000, 7)], "n_tokens long, docs long")
    for r in tc.context_limits(hist).collect():
        assert r.docs_longer == sum(1 + n % 3 for n in range(0, 1000, 7) if n > r.context_limit)
