import re
import textwrap

import pytest

from quillstream.llm import licenses as lic


@pytest.fixture(scope="module")
def model(duck):
    texts = [t.split() for (t,) in duck.execute("select text from documents limit 150").fetchall()]
    return lic.train([" ".join(w[k : k + lic.WINDOW]) for w in texts for k in range(0, len(w), lic.WINDOW)][:2000])


@pytest.mark.parametrize("family", lic.TEMPLATES)
def test_families(model, family):
    for t in lic.TEMPLATES[family]:
        p = model.probabilities("Some words in front. " + t + " And some behind it.")
        assert lic.FAMILIES[p.argmax()] == family and p.max() > 0.5


@pytest.mark.parametrize("text", [*lic.DECOYS, "", "nothing of the kind", "A library card is free of charge for any person."])
def test_others_stay_unknown(model, text):
    assert lic.FAMILIES[model.probabilities(text).argmax()] == lic.UNKNOWN


def paragraphs(text):
    return re.split(r"\n[\x20\x09\r]*\n\s*", text) if re.search(r"\n[\x20\x09\r]*\n", text) else text.split("\n")


def expected(model, text):
    """(family, confirmed) of each predicted paragraph."""
    out = set()
    for x in paragraphs(text):
        p = model.probabilities(x)
        if p.argmax() < len(lic.FAMILIES) - 1 and p.max() >= lic.CONFIDENT:
            family = lic.FAMILIES[p.argmax()]
            w = lic.words(x)
            own = set(zip(w, w[1:]))
            best = max(len(own & (t := set(zip(lic.words(y), lic.words(y)[1:])))) / len(t) for y in lic.TEMPLATES[family])
            out.add((family, best >= lic.COVERED))
    return out


def test_scan_against_plain_python(spark, model, duck, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(9001, "Intro.\n\n" + lic.TEMPLATES["mit"][2].replace(" ", "\n") + "\n\nEnd.\n"), (9002, "Released under the\nwild"), (9003, lic.TEMPLATES["bsd"][0] + "\n" + lic.TEMPLATES["isc"][0]), (9004, None), (9005, ""), (9006, "x " * 20_000 + lic.TEMPLATES["mpl-2.0"][0]), (None, lic.TEMPLATES["cc-by"][1]), (9003, "twice")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = lic.scan(docs, model).collect()
    texts = docs.collect()
    assert len(rows) == len(texts)
    wanted = sorted(repr((d.doc_id, sorted(expected(model, d.text or "")))) for d in texts)
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    for d in texts:
        all_ = expected(model, d.text or "")
        assert any((r.family is None and not all_) or (r.family, r.confirmed) in all_ for r in found[d.doc_id]), d.doc_id
    assert wanted and found[9001][0].family == "mit" and found[9006][0].confirmed and found[None][0].family == "cc-by"
    assert lic.scan(docs.limit(0), model).count() == 0


def test_query_finds_every_planted_line(spark, duck, sf_dir):
    from quillstream.llm.queries import op6_license_scan

    df = op6_license_scan(spark, sf_dir)
    rows = {r.doc_id: r for r in df.collect()}
    lines = duck.execute("select doc_id, text ilike '%licensed under%' or text ilike '%released under the%license%' from documents").fetchall()
    assert len(rows) == len(lines)
    for i, planted in lines:
        assert rows[i].confirmed == planted
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_columns_may_clash(spark, model):
    df = spark.createDataFrame([(1, "Licensed under the MIT License.", 1, "x")], "doc_id long, text string, _row int, family string")
    assert [r.family for r in lic.scan(df, model).collect()] == ["mit"]


def test_every_predicted_paragraph_is_found(spark, model):
    texts = [(9003, lic.TEMPLATES["bsd"][0] + "\n" + lic.TEMPLATES["isc"][0]), (1, "Licensed under the MIT License.\nnothing\nLicensed under CC BY-NC 4.0."), (2, "nothing of the kind"), (3, None)]
    rows = {r.doc_id: r for r in lic.scan(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [(x.paragraph, x.family, x.confirmed) for x in rows[9003].found] == [(0, "bsd", True), (1, "isc", True)]
    assert [(x.paragraph, x.family, x.confirmed) for x in rows[1].found] == [(0, "mit", True), (2, "cc-by-nc", True)]
    assert rows[2].found == rows[3].found == []
    for i in (9003, 1):
        best = max(rows[i].found, key=lambda x: (x.confirmed, x.probability, -x.paragraph))
        assert all(rows[i][c] == best[c] for c in best.asDict())


def test_every_predicted_paragraph_of_the_documents(spark, model, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r for r in lic.scan(docs, model).collect()}
    for d in docs.collect():
        assert {(x.family, x.confirmed) for x in rows[d.doc_id].found} == expected(model, d.text or ""), d.doc_id


def test_held_out_notices(duck):
    """Carriers, other licences and passages that the first model hasn't seen."""
    texts = [t.split() for (t,) in duck.execute("select text from documents limit 100").fetchall()]
    windows = [" ".join(w[k : k + lic.WINDOW]) for w in texts for k in range(0, len(w), lic.WINDOW)][:1000]
    passages = [w for w in map(lic.words, (x for x in windows if not lic.speaks_of_licences(x))) if len(w) > 3]
    z, y, weight = lic.held_out(passages)
    best, unknown = z.argmax(1), len(lic.FAMILIES) - 1
    sure = (best < unknown) & (lic._softmax(z).max(1) >= lic.CONFIDENT)
    hit = (weight * (sure & (best == y))).sum()
    assert hit / (weight * sure).sum() > 0.95 and hit / (weight * (y < unknown)).sum() > 0.9


def test_licence_lines_are_not_taught_as_unknown():
    assert all(lic.speaks_of_licences("some words " + t + " and more") for group in lic.TEMPLATES.values() for t in group)
    assert not lic.speaks_of_licences("the cat sat on the mat and the terms of the contract were long")


def test_the_sample_is_taken_from_whole_documents(spark, monkeypatch):
    """A passage far behind in a long text can be in it; odd rows do no harm."""
    taken = []
    monkeypatch.setattr(lic, "train", taken.extend)
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(4000)), "x"), (2, None, "x"), (None, "y", "x"), (3, "", "x"), (4, "z" * 100_000, "x"), (1, "again", "x")], "doc_id long, text string, t string")
    lic.fit(df)
    assert any("w3999" in x.split() for x in taken) and all(len(x.split()) <= lic.WINDOW for x in taken)
    lic.fit(df.limit(0))


def test_very_long_texts(spark, model):
    texts = [(1, ("nothing of the kind " * 30_000) + "\n" + lic.TEMPLATES["mit"][2]), (2, "x" * 1_000_000), (3, ("Licensed under the MIT License.\n" * 3_000))]
    rows = {r.doc_id: r for r in lic.scan(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [x.family for x in rows[1].found] == ["mit"] and rows[2].found == [] and len(rows[3].found) == 3_000


def wrapped(text, width=60):
    return "\n".join(textwrap.wrap(text, width))


def test_notices_cut_by_breaks_are_confirmed(spark, model):
    t = lic.TEMPLATES
    mid = t["bsd"][0].index("Redistributions of source")
    texts = [
        (1, "Intro\n" + wrapped(t["mit"][2]) + "\nEnd"), (2, wrapped(t["gpl-2.0"][0])), (3, wrapped(t["gpl-3.0"][1], 40)),
        (4, "Copyright\n\n" + t["bsd"][0][:mid] + "\n\n" + t["bsd"][0][mid:] + "\n\nEnd"), (5, wrapped(t["mit"][2]) + "\n" + wrapped(t["isc"][0])),
        (6, wrapped("of the software and to permit persons to whom the work is given, this is free of charge " * 9)),
    ]
    rows = {r.doc_id: r for r in lic.scan(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    sure = {i: [x.family for x in r.found if x.confirmed] for i, r in rows.items()}
    assert sure == {1: ["mit"], 2: ["gpl-2.0"], 3: ["gpl-3.0"], 4: ["bsd"], 5: ["mit", "isc"], 6: []}
    assert (rows[1].family, rows[1].paragraph, rows[4].paragraph) == ("mit", 1, 1) and rows[1].found[-1].last >= 5
