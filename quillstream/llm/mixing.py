"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 10).

A source's documents are dealt to shards by a seeded hash and stand in a seeded order there, as one
stream of words that is cut into blocks of equal length (the last one may be shorter). The mix is so many blocks
in all; sources get them by the highest quotients target / (2k + 1), and a source's shards share its blocks in
the same way by their size. The source's last block is cut (or a short one added) where whole blocks would miss its
target, so every source gets its target to the word. A shard takes its whole stream as often as its quota
holds it (three times at most), and the blocks that then remain by a seeded permutation, the last of them cut.

Only ids, hashes and sizes are dealt and ordered. Rows that are repeated in all columns collapse before they are
exchanged and are told apart by a number afterwards, so neither one id nor one repeated row makes a large shard;
`take` joins the texts to their spans at the end.

What reaches the driver is one row for each source and shard. There are MOST_SHARDS shards and one
more for each source at most; with more words shards and blocks grow, not their number. Sources are
few by nature: more than MOST_SOURCES raise an error.

Defined results: a null source is a source of its own, the last; null texts, empty texts and texts
without words have size 0 and nothing is taken of them; texts of any length are cut into as many blocks as they
fill; rows with equal or null ids are told apart by a hash of all columns, repeated rows are each a document; further
columns may have any name: they only enter that hash, and take() passes them through. An empty table or one without words
gives targets of 0.
"""

from __future__ import annotations

import heapq
import math
import random
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import bound_batches, materialize, row_key, small_table, tidy

#: Fixed value: what separates words.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
LIMIT = 3  # times that a word may be taken
SEED = 20240101
SHARD_WORDS, MOST_SHARDS, SHARD_BLOCKS = 1 << 18, 1 << 17, 1 << 12
MOST_SOURCES = 1_000_000
COPIES = 1 << 12  # repeated rows that are told apart by one row of a table


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> dict[str | None, float]:
    """Shares of all sizes by weight, repeating over the sources in order; a share above `limit`
    times its source's size stops there, and the others get the excess by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > limit * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = float(limit * sizes[s])
            left -= out[s]
        gone = set(over)
        open_ = [s for s in open_ if s not in gone]
    return out


def apportion(votes: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients vote / (2k + 1); ties go to the earlier one.

    All quotients above a threshold are counted at once, only the last few are given one by one.
    """
    total = sum(votes)
    if seats <= 0 or total <= 0:
        return [0] * len(votes)
    above = lambda t: [int((v / t + 1) / 2) for v in votes]
    low, high = 0.0, max(votes) * 2  # too many above low, none above high
    threshold = total / (2 * seats)
    for _ in range(60):
        if 0 <= seats - sum(above(threshold)) <= len(votes):
            break
        if sum(above(threshold)) > seats:
            low = threshold
        else:
            high = threshold
        threshold = (low + high) / 2
    given = above(threshold)
    if sum(given) > seats:
        given = [0] * len(votes)
    heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, given, strict=True)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(given)):
        _, i = heap[0]
        given[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def _shards(size: int, shard_words: int) -> int:
    return max(1, math.ceil(size / shard_words))


def _words_by_shard(blocks: int, words: int, sizes: list[int], block: int, limit: int) -> list[int]:
    """How many words each shard gives, `words` in all: the blocks by size, then cut or filled up, the first shards first."""
    given = [min(n * block, limit * z) for n, z in zip(apportion([float(z) for z in sizes], blocks), sizes, strict=True)]
    left = min(words, limit * sum(sizes)) - sum(given)
    while left:
        for i, z in enumerate(sizes):
            step = max(-block, -given[i], left) if left < 0 else min(block, limit * z - given[i], left)
            given[i] += step
            left -= step
    return given


def _pick(words: int, size: int, block: int, offset: int, step: int) -> tuple[int, int, int, int]:
    """(passes, blocks, chosen, cut): how a shard of `size` words gives `words`.

    Block b has the rank (b * step + offset) % blocks; those of rank below `chosen` are taken, that of rank
    chosen - 1 without its last `cut` words.
    """
    passes, rest = divmod(words, size) if size else (0, 0)
    blocks = -(-size // block)
    if not rest:
        return passes, blocks, 0, 0
    lacking = blocks * block - size  # by so much the last block is shorter
    last = ((blocks - 1) * step + offset) % blocks
    chosen = -(-rest // block)
    if last < chosen and chosen * block - lacking < rest:
        chosen += 1
    return passes, blocks, chosen, chosen * block - (lacking if last < chosen else 0) - rest


def plan(shard_sizes: list[tuple[str | None, int, int]], seed: int = SEED, limit: int = LIMIT) -> tuple[list[dict], int]:
    """For each (source, shard, size): how many whole passes and which blocks; and the block length."""
    sizes: dict[str | None, int] = {}
    for source, _, size in shard_sizes:
        sizes[source] = sizes.get(source, 0) + size
    target, total = targets(sizes), sum(sizes.values())
    block = max(1, _shard_words(total) // SHARD_BLOCKS)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    blocks = dict(zip(order, apportion([target[s] for s in order], round(total / block)), strict=True))
    by_source: dict[str | None, list[tuple[int, int]]] = {s: [] for s in order}
    for source, shard, size in sorted(shard_sizes, key=lambda x: x[1]):
        by_source[source].append((shard, size))
    rows = []
    for s in order:
        of_shard = _words_by_shard(blocks[s], round(target[s]), [z for _, z in by_source[s]], block, limit)
        for (shard, size), words in zip(by_source[s], of_shard, strict=True):
            draw = random.Random(f"{seed} {s} {shard}")
            whole = max(1, -(-size // block))
            step = draw.randrange(1, whole + 1)
            while math.gcd(step, whole) > 1:
                step = step % whole + 1
            offset = draw.randrange(whole)
            passes, n, chosen, cut = _pick(words, size, block, offset, step)
            rows.append({"source": s, "shard": shard, "source_size": sizes[s], "target": target[s], "passes": passes, "blocks": n, "chosen": chosen, "cut": cut, "step": step, "offset": offset, "shard_size": size})
    return rows, block


def _shard_words(total: int) -> int:
    return max(SHARD_WORDS, math.ceil(total / MOST_SHARDS))


PLAN = {"_source": pa.string(), "target": pa.float64()} | dict.fromkeys(("_shard", "source_size", "passes", "blocks", "chosen", "cut", "step", "offset", "shard_size"), pa.int64())


def _items(docs: DataFrame) -> DataFrame:
    """(_id, _row, copy, doc_id, source, size): a row for each row of docs; `copy` numbers the repeated ones."""
    key = row_key(docs)
    ids = docs.select(*key, F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    # Partial sums collapse repeated rows before the exchange. Their numbers are made in two steps, so that
    # neither an array nor a task gets all of them.
    once = ids.groupBy("_id", "_row", "doc_id", "source", "size").agg(F.count("*").alias("n"))
    chunks = once.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("long"))))
    first = F.col("chunk") * COPIES
    copies = F.explode(F.sequence(first, F.least(first + COPIES, F.col("n")) - 1))
    return chunks.repartition("_id", "_row", "chunk").select("_id", "_row", copies.alias("copy"), "doc_id", "source", "size")


def _mix(docs: DataFrame, seed: int) -> DataFrame:
    """_items of docs with source_size, target, passes (how often the whole text is taken), spans (the runs of words
    [from, to) that are taken once more) and taken (words in all)."""
    spark = docs.sparkSession
    items = materialize(_items(docs), "items")
    of_source = items.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(of_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    shard_words = _shard_words(sum(r["size"] for r in of_source))
    counts = small_table(spark, {"_source": [r.source for r in of_source], "shards": [_shards(r["size"], shard_words) for r in of_source]}, {"_source": pa.string(), "shards": pa.int64()})
    # One row a source, at most MOST_SOURCES.
    dealt = items.join(F.broadcast(counts), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    draw = lambda what: F.xxhash64(F.lit(what), "_id", "_row", "copy", F.lit(seed))
    dealt = dealt.withColumn("shard", F.pmod(draw("shard"), F.col("shards"))).withColumn("draw", draw("order"))
    shard_sizes = [(r.source, r.shard, r["size"]) for r in dealt.groupBy("source", "shard").agg(F.sum("size").alias("size")).collect()]
    rows, block = plan(shard_sizes, seed)
    planned = small_table(spark, {c: [r[c.removeprefix("_")] for r in rows] for c in PLAN}, PLAN)
    stream = W.Window.partitionBy("source", "shard").orderBy("draw", "_id", "_row", "copy").rowsBetween(W.Window.unboundedPreceding, -1)
    placed = dealt.withColumn("first", F.coalesce(F.sum("size").over(stream), F.lit(0).cast("long"))).withColumn("end", F.col("first") + F.col("size"))
    # One row a shard, at most MOST_SHARDS and one for each source.
    found = placed.join(F.broadcast(planned), F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    rank = lambda b: F.pmod(b * F.col("step") + F.col("offset"), F.col("blocks"))
    touched = F.when((F.col("size") > 0) & (F.col("chosen") > 0), F.sequence(F.floor(F.col("first") / block), F.floor((F.col("end") - 1) / block))).otherwise(F.array().cast("array<long>"))
    chosen = F.filter(touched, lambda b: rank(b) < F.col("chosen"))
    block_end = lambda b: F.least((b + 1) * block, F.col("shard_size")) - F.when(rank(b) == F.col("chosen") - 1, F.col("cut")).otherwise(0)
    span = lambda b: F.struct((F.greatest(b * block, F.col("first")) - F.col("first")).alias("from"), (F.least(block_end(b), F.col("end")) - F.col("first")).alias("to"))
    out = found.withColumn("spans", F.filter(F.transform(chosen, span), lambda x: x["to"] > x["from"]))
    once_more = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    out = out.withColumn("taken", F.col("passes") * F.col("size") + once_more)
    return out.select("_id", "_row", "copy", "doc_id", "size", "source_size", "target", "taken", "passes", "spans")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes and n_blocks of every row; texts are read once, for their
    sizes and hashes."""
    return _mix(docs, seed).select("doc_id", "size", "source_size", "target", "taken", "passes", F.size("spans").alias("n_blocks"))


def _taken_texts(text: str, passes: int, spans) -> list[str]:
    out = [text] * passes
    if spans is not None and len(spans):
        words = [m.span() for m in re.finditer(WORD, text)]
        runs: list[list[int]] = []
        for x in spans:
            if runs and runs[-1][1] == x["from"]:
                runs[-1][1] = x["to"]
            else:
                runs.append([x["from"], x["to"]])
        out += [text if (a, b) == (0, len(words)) else text[words[a][0] : words[b - 1][1]] for a, b in runs]
    return out


def take(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole pass over a text and for each
    run of words taken once more (its n_chars counted anew). Texts of which nothing is taken go."""

    def texts(text: pd.Series, passes: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_taken_texts(*x) for x in zip(text, passes, spans, strict=True)])

    bound_batches(docs.sparkSession)
    mix = _mix(docs, seed).where("taken > 0").select("_id", "_row", "passes", "spans")
    # The row travels as a struct, so that no column of docs clashes with one of ours.
    rows = docs.select(*row_key(docs), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).dropDuplicates(["_id", "_row"])
    taken = F.explode(F.pandas_udf(tidy(texts), "array<string>")(F.coalesce("row.text", F.lit("")), F.col("passes"), F.col("spans")))
    new = {"text": F.col("taken_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("taken_text").cast(docs.schema["n_chars"].dataType)
    mixed = rows.join(mix, ["_id", "_row"]).select("row", taken.alias("taken_text"))
    return mixed.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
