"""Exact token counts through a length histogram (operator 2).

Every document is encoded whole; documents are aggregated by encoded length, and suffix sums over
that histogram answer totals, quantiles and truncated totals for every context limit. The histogram
has one row per distinct length, so all that follows the first aggregation is small; the suffix sums
still run in blocks of lengths, so that no single task needs the whole histogram.

Long runs of white space are cut off before the tokenizer's pattern sees them, since it would try each place of the
run as its end; count_tokens says why the count stays the same.

Defined results: null and empty texts have length 0, texts of any length are encoded whole, repeated rows count each
time, an empty table gives an empty histogram. Columns besides the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import bound_batches, materialize, tidy, whole_text

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenization pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: what the pattern takes for white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{SPACE}]{{512,}}")
BLOCK = 1 << 7  # lengths of one block of suffix sums


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """How many tokens the text has.

    Only the pattern's `\\s+(?!\\S)` and `\\s+` take white space, but for one space before a word. So a run of it is one
    piece but for its last character, which stays with what follows, or as a whole at the end of the text; and no piece
    reaches from what isn't white space into the run. The parts around a run thus count alone, the run as one piece.
    """
    e = encoding(path)
    total = at = 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        total += len(e.encode_ordinary(text[at : run.start()])) + len(e._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(e.encode_ordinary(text[at:]))


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens of each text; the vocabulary file must be on every machine."""

    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: count_tokens(x, path) if x else 0)

    return F.pandas_udf(tidy(count), "long")(text)


def length_histogram(df: DataFrame, n_tokens: Column) -> DataFrame:
    """(n_tokens, docs): documents by encoded length."""
    return df.select(n_tokens.alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit, exact totals over all documents.

    docs_longer and tokens_longer are the suffix sums; truncated_tokens is the total once every
    document is cut at the limit, lost_tokens what that drops, cumulative the share of documents
    no longer than the limit (so quantile p is the least limit whose cumulative is p or more).
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    # One row for every BLOCK lengths: a document of ten million tokens would make 80,000 rows.
    later = W.Window.orderBy(F.desc("block")).rowsBetween(W.Window.unboundedPreceding, -1)
    whole = W.Window.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    carried = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("b_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("b_docs").over(whole.orderBy("block").rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)).alias("total_docs"),
        F.sum("b_tokens").over(whole.orderBy("block").rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)).alias("total_tokens"),
    )
    within = W.Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.Window.unboundedPreceding, -1)
    longer = lambda c: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"later_{c}")
    x = h.join(carried, "block").select("n_tokens", "docs", longer("docs").alias("docs_longer"), longer("tokens").alias("tokens_longer"), "total_docs", "total_tokens")
    kept = F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")
    return x.select(
        F.col("n_tokens").alias("context_limit"), "docs", "docs_longer", "tokens_longer", "total_docs", "total_tokens",
        kept.alias("truncated_tokens"), (F.col("total_tokens") - kept).alias("lost_tokens"),
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("cumulative"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """One row per asked limit, any limit: documents over it and the truncated total."""
    n, d = F.col("n_tokens"), F.col("docs")
    zero = F.lit(0).cast("long")
    rows = [F.struct(F.lit(x).cast("long").alias("context_limit"), F.coalesce(F.sum(F.when(n > x, d)), zero).alias("docs_longer"), F.coalesce(F.sum(F.least(n, F.lit(x).cast("long")) * d), zero).alias("truncated_tokens")) for x in limits]
    return histogram.agg(F.array(*rows).alias("x")).select(F.inline("x"))


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """Nearest-rank quantiles of the lengths, from what context_limits returns."""
    rows = [F.struct(F.lit(p).alias("share"), F.min(F.when(F.col("cumulative") >= p, F.col("context_limit"))).alias("n_tokens")) for p in shares]
    return limits.agg(F.array(*rows).alias("x")).select(F.inline("x"))


def document_token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """context_limits of the encoded lengths of docs; the texts are encoded once."""
    bound_batches(docs.sparkSession)
    return context_limits(materialize(length_histogram(docs, token_count(whole_text(), path)), "lengths"))
