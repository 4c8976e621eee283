"""A corpus pipeline of four stages: reject toxic texts, drop near-duplicates, mix sources, encode.

Each stage takes all that its predecessor kept. The result is one row for each text of the mix:
doc_id, n_tokens, ids and round_trip. No stage can be put in SQL (ORACLE_SQL is None): the tests
hold each against a brute-force version.

Defined results: null and empty texts aren't toxic (they score as the bias alone); texts without words are near-duplicates of
each other, so one of them stays, and nothing is taken of it; of rows that share an id and differ each counts, of rows that
are repeated one stays; a null doc_id stays if its text has no copy with an id; a null source is a source of its own; texts
of any length are read whole; ties go to the least id, then the least hash of the row. Further columns of documents pass
through the stages, whatever their names, up to the last one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import mixing, sentencepiece, simhash, toxicity
from quillstream.llm.common import discard, documents, recorded, stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labels, doesn't reject."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix takes, a row for each time."""
    return mixing.take(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text."""
    return sentencepiece.encode_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again. What a stage has
    written on its way, and its predecessor's rows, are deleted once its own rows are written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with recorded() as paths:
            docs, path = stored(stage(spark, docs, sf_dir), name)
        for used in [*(x for x in paths if x != path), *([before] if before else [])]:
            discard(spark, used)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
