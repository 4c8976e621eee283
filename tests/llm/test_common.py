import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillstream.llm import common


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda name, default=None: default)
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda name: folder))
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_shared_folder_must_be_named_on_a_cluster():
    assert common.shared_folder(session("spark://m:7077", "s3a://bucket/x/")) == "s3a://bucket/x"
    for master in ("spark://m:7077", "yarn", "local-cluster[3,2,1000]", "k8s://h"):
        with pytest.raises(ValueError):
            common.shared_folder(session(master))
    assert os.path.isdir(common.shared_folder(session("local[4]")))


def test_written_tables_are_deleted(spark):
    with common.recorded() as paths:
        df, path = common.stored(spark.range(10), "numbers", 2)
        kept = common.materialize(spark.range(3), "others")
        assert paths[0] == path and len(paths) == 2
        common.discard(spark, path)
        assert paths == [paths[0]] and paths[0] != path
    assert not os.path.exists(path) and kept.count() == 3
    common.discard_all(spark)
    assert not os.path.exists(paths[0])


def test_settings_of_the_caller_stay(spark):
    name = common.BATCHES[0][0]
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "77")
        common.bound_batches(spark)
        assert spark.conf.get(name) == "77"
        spark.conf.unset(name)
        common.bound_batches(spark)
        assert spark.conf.get(name) == "1500"
    finally:
        spark.conf.set(name, before)


def test_samples_are_the_least_hashes(spark):
    rows = [(i,) for i in range(2000)] + [(7,)] * 3000 + [(None,)] * 10
    df = spark.createDataFrame(rows, "doc_id long").repartition(3)
    wanted = [r.doc_id for r in df.where("doc_id is not null").distinct().orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id").limit(50).collect()]
    assert sorted(r.doc_id for r in common.sample_ids(df, 50).collect()) == sorted(wanted)
    assert common.sample_ids(df, 5000).count() == 2000 and common.sample_ids(df.limit(0), 5).count() == 0
    same = spark.createDataFrame([(1,)] * 5000 + [(2,)], "doc_id long")
    assert sorted(r.doc_id for r in common.sample_ids(same, 2).collect()) == [1, 2]


def test_row_keys_tell_rows_apart(spark):
    rows = [(None, "a", None, {"x": 1}), (None, None, "a", {"x": 1}), (0, "a", None, {"x": 1}), (1, "a", "a", None), (1, "a", "a", {"x": 2}), (1, "a", "a", {"x": 2})]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, m map<string,int>")
    keys = [tuple(r) for r in df.select(*common.row_key(df)).collect()]
    assert len(set(keys)) == 5 and keys[4] == keys[5]


def test_ranges(spark):
    values = [None, -5, 0, 1, 9, 10, 11, 10**12]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for bounds in ([], [1], [0, 10], list(range(-10, 20))):
        found = [r[0] for r in df.select(common.range_of(F.col("v"), bounds)).collect()]
        assert found == [0 if v is None else sum(b <= v for b in bounds) for v in values]
