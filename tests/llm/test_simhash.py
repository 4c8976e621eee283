import random

import pytest
import xxhash

from quillstream.llm import simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: [(id, fingerprint)] → least id reachable of each row, by all pairs of distinct fingerprints."""
    nodes = sorted({p for _, p in prints})
    parent = {p: p for p in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(b)] = root(a)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [least.get(root(p)) for _, p in prints]


def test_fingerprints():
    texts = ["", " \n", "one", "One TWO", "a b c", "A\tb\x0bc d", "é É ß", "x " * 5000, "a b c d e"]
    assert [int(x) for x in simhash.fingerprints(texts)] == [slow_print(t) for t in texts]


def test_query_against_brute_force(spark, sf_dir, duck):
    from quillstream.llm.queries import op9_simhash_near_dedup

    docs = duck.execute("select doc_id, text from documents").fetchall()
    prints = [(i, slow_print(t)) for i, t in docs]
    rows = {r.doc_id: r for r in op9_simhash_near_dedup(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for (i, p), least in zip(prints, slow_components(prints), strict=True):
        assert (rows[i].fingerprint, rows[i].component_id) == (f"{p:016x}", least)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("ball", [32, 1, 0])
def test_links_of_dense_and_sparse_fingerprints(spark, monkeypatch, ball):
    """Clusters of many fingerprints around a centre, chains, and pairs at each distance; by pairs in small buckets, or by variants in all."""
    monkeypatch.setattr(simhash, "BALL", ball)
    draw = random.Random(5)
    flip = lambda x, n: x ^ sum(1 << b for b in draw.sample(range(64), n))
    prints = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        prints |= {centre} | {flip(centre, draw.randint(1, 4)) for _ in range(40)}
    for d in (1, 2, 3, 4, 5):
        for _ in range(30):
            x = draw.getrandbits(64)
            prints |= {x, flip(x, d)}
    x = draw.getrandbits(64)
    for _ in range(60):
        prints.add(x)
        x = flip(x, 3)
    prints |= {0, 1, 7, 1 << 63, (1 << 64) - 1}
    for side in (0, 32):  # many of one half, far from each other and 3 bits apart in the other half
        half = draw.getrandbits(32) << (32 - side)
        for _ in range(50):
            x = half | draw.getrandbits(32) << side
            prints |= {x, x ^ sum(1 << b for b in draw.sample(range(side, side + 32), 3))}
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    label = {r.fp: r.label for r in simhash.labels(nodes).collect()}
    ordered = sorted(prints)
    truth = slow_components(list(enumerate(ordered)))
    groups = {}
    for p, t in zip(ordered, truth, strict=True):
        groups.setdefault(t, set()).add(label[signed(p)])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_a_large_group_with_one_foreign_neighbour(spark, n):
    """A group that shares one half of its bits, and one more with that half: what meets stays linear."""
    draw = random.Random(n)
    high = draw.getrandbits(32) << 32
    group, low = {high}, 0
    while len(group) < n:  # a walk by single bits
        low ^= 1 << draw.randrange(32)
        group.add(high | low)
    far = next(x for x in iter(lambda: high | draw.getrandbits(32), None) if all((x ^ g).bit_count() > 3 for g in group))
    rows = [(signed(g), signed(min(group, key=signed))) for g in group] + [(signed(far), signed(far))]
    df = spark.createDataFrame(rows, "fp long, label long")
    met = []
    links = simhash.far_links(df)

    def walk(node):
        metrics = node.metrics()
        if metrics.contains("numOutputRows"):
            met.append(metrics.apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    assert links.count() == 0
    plan = links._jdf.queryExecution().executedPlan()
    assert links._jdf.queryExecution().executedPlan() is not None
    links.collect()
    walk(plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan)
    # no operator makes more rows than the variants of the members
    assert max(met, default=0) <= (n + 1) * (32 + 496 + 32)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    found = {r.b: r.a for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (5, "", "y"), (None, "a b c d", "y"), (7, "a b c d", None), (7, "a b c d", None), (9, "other words entirely here", "z"), (None, "only null ids in this one", "q")], "doc_id long, text string, root string")
    rows = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("1", "1"), ("5", "1"), ("7", "7"), ("7", "7"), ("9", "9"), ("None", "7"), ("None", "None")]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "7", "9", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def plans_since(spark, last=None):
    """The final plans of all executions after the one numbered `last`; without it the last number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    found = [found.apply(i) for i in range(found.size())]
    if last is None:
        return max((x.executionId() for x in found), default=-1)
    return [x.physicalPlanDescription() for x in found if x.executionId() > last]


def test_nothing_without_a_bound_is_broadcast_by_the_stage(spark, sf_dir):
    """Under Spark's own threshold too: dozens of tables a little below it don't fit the driver."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = plans_since(spark)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760", "10485760b", "10MB")
    assert len(corpus_pipeline.near_dedup_stage(spark, docs, sf_dir).collect()) > 0
    plans = plans_since(spark, last)
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)


def test_nothing_without_a_bound_is_broadcast_by_the_query(spark, sf_dir):
    from quillstream.llm.queries import op9_simhash_near_dedup

    last = plans_since(spark)
    assert len(op9_simhash_near_dedup(spark, sf_dir).collect()) > 0
    plans = plans_since(spark, last)
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)
