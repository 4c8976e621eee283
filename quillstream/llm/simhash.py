"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 9).

Equal fingerprints collapse first, so groups of copies cost one row. A link of 1 or 2 bits has a midpoint within
1 bit of both ends: every fingerprint emits all variants within 1 bit, and whoever shares a variant is 2
bits apart at most, so a bucket (65 fingerprints at most) is linked as a chain without pairs. Components of
these links come first.

A link of 3 bits has midpoints 1 bit from one end and 2 bits from the other. All variants within 2 bits would be
2081 rows a fingerprint, so they travel in bundles: of the two 32-bit halves of a link one differs by 1
bit at most, so a fingerprint goes to the buckets of both of its halves, and to those 1 bit away (66 rows). Only
where fingerprints of different components meet in a bucket do its members emit their variants there,
whole 64-bit values again: at exactly 1 bit (near) and at exactly 2 bits (far). Those that share a whole half with many of
other components are bundled once more, by the halves of their other half. Who is near a variant and who is far
from it are 3 bits apart at most, so near ones give their component and far ones join it: a row for each
variant, never a pair for each two members. In buckets of so few members that all pairs are fewer than their variants,
the pairs are verified instead. So what a member makes is bounded by the ball, whatever the size of its group.

Defined results: null and empty texts and texts without words have the fingerprint 0, which links
like any other; texts of any length are read whole. Repeated rows stay and share a component. A null doc_id never
names a component; a component of null ids only has a null component_id. Columns besides doc_id and text are ignored,
whatever their names (keep_one passes them through). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import bound_batches, discard, materialize, merged, merged_to_groups, row_key, stored, tidy, whole_text

SHINGLE, SEED, RADIUS = 3, 42, 3


def shingle_hashes(text: str, width: int = SHINGLE) -> list[int]:
    """XXH64 of each run of `width` words, A-Z lower-cased; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: only A-Z changes, only ASCII white space splits
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[:-width]).tolist()]
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def _bit_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each run of hashes have each of the 64 bits; runs are `counts` long, none is empty.

    Eight bits are counted at a time, each in a byte of its own, over at most 255 hashes.
    """
    parts = -(-counts // 255)
    first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    starts = np.repeat(np.cumsum(counts) - counts, parts) + 255 * within
    out = np.empty((len(counts), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        out[:, :, k] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    return out.reshape(-1, 64)


def fingerprints(texts: list[str]) -> np.ndarray:
    """A bit is set if more than half of the text's shingle hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    hashes, rows, counts, waiting = [], [], [], 0
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def flush() -> None:
        if rows:
            sizes = np.array(counts)
            many = _bit_counts(np.concatenate(hashes), sizes) * 2 > sizes[:, None]
            out[rows] = np.where(many, powers, np.uint64(0)).sum(1, dtype=np.uint64)
        hashes.clear(), rows.clear(), counts.clear()

    for i, x in enumerate(texts):
        if found := shingle_hashes(x):
            hashes.append(np.array(found, np.uint64))
            rows.append(i)
            counts.append(len(found))
            waiting += len(found)
        if waiting > 1 << 16:
            flush()
            waiting = 0
    flush()
    return out


def fingerprint(text: Column) -> Column:
    """The 64-bit fingerprint as a signed long."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints([x or "" for x in texts]).view(np.int64))

    return F.pandas_udf(tidy(of), "long")(text)


def _bit(b: int) -> int:
    return 1 << b if b < 63 else -(1 << 63)


def _flips(value: Column, bits: range) -> list[Column]:
    """value with one of the bits turned."""
    return [value.bitwiseXOR(F.lit(_bit(b)).cast("long")) for b in bits]


def near_links(nodes: DataFrame) -> DataFrame:
    """(a, b) such that the components of these links are those of all links of up to 2 bits."""
    variants = nodes.select("fp", F.explode(F.array("fp", *_flips(F.col("fp"), range(64)))).alias("variant"))
    bucket = W.Window.partitionBy("variant").orderBy("fp")
    return variants.select(F.first("fp").over(bucket).alias("a"), F.col("fp").alias("b")).where("a != b").distinct()


Bits = range
#: For each half of the bits: those that are free in its buckets (the other half), and those that are turned.
HALVES = ((range(32), range(32, 64)), (range(32, 64), range(32)))
#: The same for the halves of each of these free halves.
QUARTERS = tuple(((range(b, b + 16), range(b + 16, b + 32)), (range(b + 16, b + 32), range(b, b + 16))) for b in (0, 32))


def _mask(bits: Bits) -> int:
    return sum(map(_bit, bits))


BALL = 32  # variants of a member within a bucket: up to as many pairs a member are cheaper


def _meet(members: DataFrame, sides: tuple[tuple[Bits, Bits], ...], last: bool, files: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Links (a, b); (label, variant) of who is near and of who is far; (side, fp, label) of crowds still to be told apart.

    members: (fp, label). For each side a bucket is what fingerprints have in common outside the free bits. A crowd has one
    such bucket in common: all 3 bits may be free. If this is the last level, its members are among the near ones.
    """
    keys = [F.struct(F.lit(i).alias("side"), F.col("fp").bitwiseAND(F.lit(~_mask(free)).cast("long")).alias("key")) for i, (free, _) in enumerate(sides)]
    bucket = ["side", "key"]
    owners = members.select("fp", "label", F.inline(F.array(*keys)))
    by_side = lambda arrays: F.element_at(F.array(*(F.array(*x) for x in arrays)), F.col("side") + 1)
    probes = owners.select("fp", "label", "side", F.explode(by_side([_flips(F.col("key"), turned) for _, turned in sides])).alias("key"))
    seen = owners.groupBy(bucket).agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("owners"))
    mixed = (F.col("least") != F.col("most")).alias("mixed")
    # 1 bit apart in the bits that aren't free: the owner is 1 bit from a midpoint, the other one 2 bits.
    foreign = merged(probes, seen, bucket).where("least != label or most != label").select(*bucket, "fp", "label", "owners", mixed)
    foreign = materialize(foreign, "foreign", files)
    met = foreign.groupBy(bucket).agg(F.count("*").alias("probes"), F.max("owners").alias("owners"), F.max("mixed").alias("mixed"))
    met = met.union(seen.where(mixed).select(*bucket, F.lit(0).cast("long"), "owners", F.lit(True)))
    met = met.groupBy(bucket).agg(F.max("probes").alias("probes"), F.max("owners").alias("owners"), F.max("mixed").alias("mixed"))
    dense = (F.col("probes") * F.col("owners") > BALL * (F.col("probes") + F.col("owners"))).alias("dense")
    crowd = (F.col("mixed") & (F.col("owners") > 2 * BALL)).alias("crowd")
    met = materialize(met.select(*bucket, "probes", "mixed", dense, crowd), "met", files)
    found = materialize(merged(owners, met, bucket), "members", files)
    foreign = merged(foreign.select(*bucket, "fp", "label"), met.select(*bucket, "dense"), bucket)

    other = found.select(*bucket, F.col("fp").alias("fp2"), F.col("label").alias("label2"), "dense", "probes", "mixed", "crowd")
    close = (F.col("label") != F.col("label2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS)
    link = [F.least("label", "label2").alias("a"), F.greatest("label", "label2").alias("b")]
    links = merged(foreign.where("not dense").drop("dense"), other.where("not dense and probes > 0").select(*bucket, "fp2", "label2"), bucket).where(close).select(*link)
    few = merged(found.where("mixed and not crowd").select(*bucket, "fp", "label"), other.where("mixed and not crowd").select(*bucket, "fp2", "label2"), bucket)
    links = links.union(few.where((F.col("fp") < F.col("fp2")) & close).select(*link))

    # A member of a bucket 1 bit away has that bit turned already.
    at = lambda free: F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.lit(_mask(free)).cast("long")))
    once = F.explode(by_side([_flips(at(free), free) for free, _ in sides])).alias("variant")
    near = found.where("dense or crowd" if last else "dense")
    return links, near.select("label", once), foreign.where("dense").select("label", once), found.where("crowd").select("side", "fp", "label")


def far_links(labelled: DataFrame, files: int = 1) -> DataFrame:
    """Links (a, b) of labels: of all fingerprints 3 bits apart whose labels differ.

    labelled: (fp, label); whoever is 2 bits apart or less has the same label.
    """
    links, near, far, crowds = _meet(labelled, HALVES, False, files)
    present = {r.side for r in crowds.select("side").distinct().collect()}  # two at most
    for side, sides in enumerate(QUARTERS):
        if side not in present:
            continue
        more_links, more_near, more_far, rest = _meet(crowds.where(F.col("side") == side).select("fp", "label"), sides, True, files)
        # All three bits are among the free ones: one of the two fingerprints has an odd number of ones, and emits the far variants.
        pairs = [F.array(*(F.lit(_bit(x) ^ _bit(y)).cast("long") for x in free for y in free if x < y)) for free, _ in sides]
        twice = F.transform(F.element_at(F.array(*pairs), F.col("side") + 1), lambda m: F.col("fp").bitwiseXOR(m))
        odd = rest.where(F.bit_count("fp") % 2 == 1).select("label", F.explode(twice).alias("variant"))
        links, near, far = links.union(more_links), near.union(more_near), far.union(more_far).union(odd)
    # All who are near a variant have one label.
    near = near.groupBy("variant").agg(F.min("label").alias("a"))
    pairs = merged(far.distinct(), near, "variant").where("a != label")
    return links.union(pairs.select(F.least("a", "label").alias("a"), F.greatest("a", "label").alias("b"))).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each vertex's larger (or else smaller) neighbours on its least neighbour."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = merged_to_groups(around, least, "u")
    if large:
        out = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return out.where("a != b").distinct()


ROWS = 1 << 15  # of a file of fingerprints or links


def _files(rows: int) -> int:
    return max(1, -(-rows // ROWS))


def components(edges: DataFrame, rounds: int = 100, files: int = 1) -> DataFrame:
    """(b, a): each vertex that isn't its component's least, and the least, by alternating star contraction.

    Every round is written to the shared folder, and the round before deleted; the number of rounds grows with the
    logarithm of the longest chain. An error is raised if `rounds` don't suffice. `files` is for the first write.
    """
    spark = edges.sparkSession
    edges, path = stored(edges, "links", files)
    mark = None
    for _ in range(rounds):
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row[0] == 0 or tuple(row) == mark:
            return edges
        mark = tuple(row)
        before = path
        edges, path = stored(_star(_star(edges, True), False), "links", _files(row[0]))
        discard(spark, before)
    raise RuntimeError("links didn't settle")


def labels(nodes: DataFrame, files: int = 1) -> DataFrame:
    """(fp, label): the least fingerprint that links of up to 3 bits reach. `files`: about how many tables of fp are cut into."""
    near = components(near_links(nodes), files=files)
    of_near = near.select(F.col("b").alias("fp"), F.col("a").alias("least"))
    first = materialize(merged(nodes, of_near, "fp", "left").select("fp", F.coalesce("least", "fp").alias("label")), "labels", files)
    far = components(far_links(first, files), files=files)
    return merged(first, far.select(F.col("b").alias("label"), F.col("a").alias("least")), "label", "left").select("fp", F.coalesce("least", "label").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (least doc_id reachable) and root (the component's least
    fingerprint), one row per row of docs."""
    bound_batches(docs.sparkSession)
    prints = materialize(docs.select("doc_id", fingerprint(whole_text()).alias("fp")), "prints")
    files = _files(prints.count())
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes", files)
    labelled = materialize(merged(labels(nodes.select("fp"), files), nodes, "fp"), "labels", files)
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_print = materialize(merged_to_groups(labelled, least, "label").select("fp", "component_id", F.col("label").alias("root")), "components", files)
    return merged(prints, of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that with the least doc_id (null if there is no other); of rows that share
    the id that with the least hash of its columns, and one of rows that are repeated.

    Texts are read twice: for their fingerprints, and for the rows that stay, which are exchanged once. Between,
    only ids and hashes are.
    """
    bound_batches(docs.sparkSession)
    key = row_key(docs)
    prints = materialize(docs.select("doc_id", *key, fingerprint(whole_text()).alias("fp")), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "_id", "_row")).alias("first")
    files = _files(prints.count())
    nodes = materialize(prints.groupBy("fp").agg(first), "nodes", files)
    kept = merged(labels(nodes.select("fp"), files), nodes, "fp").groupBy("label").agg(F.min("first").alias("first"))
    kept = materialize(kept.select("first._id", "first._row"), "kept", files)
    # The row travels as a struct, so that no column of docs clashes with one of ours. Repeated rows meet before the exchange.
    rows = docs.select(*key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).dropDuplicates(["_id", "_row"])
    return merged(rows, kept, ["_id", "_row"]).select("row.*")
