import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece as library

import corpus_pipeline
from quillstream.llm import common, sentencepiece, toxicity
from quillstream.llm.common import documents, materialize, table

from .test_simhash import slow_components, slow_print

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_score(c, text):
    """The classifier's probability by plain loops."""
    total = c.bias
    for w in set(re.findall(r"[^\W\d_]+", (text or "").lower())):
        total += c.weights.get("=" + w, 0) + sum(c.weights.get("^" + w[:k], 0) for k in range(3, min(8, len(w)) + 1))
    return 1 / (1 + np.exp(-total))


def slow_targets(sizes):
    """Shares by weight 1, 2, 3 and so on, cut at three times the size, the rest shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        unit = rest / max(1, sum(weight[s] for s in order if s not in full))
        more = {s for s in order if s not in full and unit * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in full else unit * weight[s] for s in order}
        full |= more


def check_stages(docs, outs, classifier):
    """Every stage's rows against brute force over the rows that it got; rows are dicts."""
    kept, single, mixed, encoded = outs
    frozen = lambda rows: Counter(repr(sorted(r.items())) for r in rows)

    # 1: exactly the documents that score less than a half stay, unchanged
    assert frozen(kept) == frozen(r for r in docs if slow_score(classifier, r["text"]) < 0.5)

    # 2: one document of each component, unchanged, that with the least id
    prints = [(r["doc_id"], slow_print(r["text"])) for r in kept]
    named = [(repr(r), p) for r, (_, p) in zip(kept, prints)]
    groups = {}
    for (i, _), name, r in zip(prints, slow_components(named), kept, strict=True):
        groups.setdefault(name, []).append((i is None, i or 0, r))
    assert len(single) == len(groups) and not frozen(single) - frozen(kept)
    of = {repr(sorted(r.items())): name for name, rows in groups.items() for *_, r in rows}
    found = {}
    for r in single:
        found[of[repr(sorted(r.items()))]] = (r["doc_id"] is None, r["doc_id"] or 0)
    assert found == {name: min((a, b) for a, b, _ in rows) for name, rows in groups.items()}

    # 3: runs of a document's words, three times at most, and each source's target to the word
    sizes, taken, by_text = Counter(), Counter(), {}
    words = lambda r: WORD.findall(r["text"] or "")
    for r in single:
        sizes[r["source"]] += len(words(r))
        by_text.setdefault(r["doc_id"], []).append(r)
    times = Counter()
    for r in mixed:
        run = words(r)
        taken[r["source"]] += len(run)
        assert run and len(r["text"]) == r["n_chars"]
        sources = [x for x in by_text[r["doc_id"]] if r["text"] in x["text"] and all(r[c] == x[c] for c in r if c not in ("text", "n_chars"))]
        assert sources
        times[r["doc_id"]] += len(run)
    assert all(n <= 3 * sum(len(words(x)) for x in by_text[i]) for i, n in times.items())
    for s, t in slow_targets(sizes).items():
        assert abs(taken[s] - t) <= 1

    # 4: the library's ids for each text of the mix
    own = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    assert Counter((r["doc_id"], tuple(own.encode(r["text"]))) for r in mixed) == Counter((r["doc_id"], tuple(r["ids"])) for r in encoded)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in encoded)


def run_stages(spark, docs, sf_dir):
    outs, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert name == "sentencepiece" or docs.columns == columns
        outs.append([r.asDict() for r in docs.collect()])
    return outs


def test_stages_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    c = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "source_mixing", "sentencepiece"]
    check_stages([r.asDict() for r in docs.collect()], run_stages(spark, docs, sf_dir), c)


def test_odd_rows(spark, sf_dir):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns named like ours."""
    row = lambda i, t, s, n="x": (i, t, None if s is None else "en", s, None if t is None else len(t), n, 7)
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(150_000))
    rows = [row(1, None, "a"), row(2, "", "a"), row(3, " \n ", "b"), row(None, None, None), row(None, "no id here at all, only words", "a"), row(4, "no id here at all, only words", "a")]
    rows += [row(None, "another text without an id of its own", "b", None), row(5, long_text, "b"), row(6, "q" * 200_000, "a"), row(7, "one two three four five", None)]
    rows += [row(8, "the same id and other words", "a"), row(8, "quite something else under this id", "b")] + [row(9, "a row that is there three times", "b")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, size int").repartition(3)
    c = toxicity.fit(df, table(spark, sf_dir, "labels"))
    outs = run_stages(spark, df, sf_dir)
    check_stages([r.asDict() for r in df.collect()], outs, c)
    ids = [r["doc_id"] for r in outs[1]]
    assert ids.count(8) == 2 and ids.count(9) == 1 and 4 in ids and ids.count(None) == 1 and 1 in ids and not {2, 3} & set(ids)
    assert {5, 6, 7, 8, 9, None} <= {r["doc_id"] for r in outs[3]}


def test_an_empty_table(spark, sf_dir):
    assert [len(x) for x in run_stages(spark, documents(spark, sf_dir).limit(0), sf_dir)] == [0, 0, 0, 0]


def test_run_leaves_only_what_its_result_reads(spark, sf_dir):
    common.discard_all(spark)
    df = corpus_pipeline.run(spark, sf_dir)
    assert df.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and df.count() > 0
    assert len(common._written) == 1 and "source_mixing" in common._written[0]
    common.discard_all(spark)
    with pytest.raises(Exception):
        df.collect()


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries().keys()
    assert "pipeline" in names and [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10
