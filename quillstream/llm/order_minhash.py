"""Document fingerprints by Order MinHash (operator 5), with DataFrame functions only.

A text is a sequence of words (runs without white space). A run longer than WORD_LENGTH, as in scripts without
spaces, counts as its overlapping pieces of PIECE characters, one from each place, so that an inserted character only
changes the pieces around it. A text's k-mers are K words in a row, numbered by occurrence, so that a
repeated one counts each time. Each numbered k-mer has a random rank; all of a text's ranks stand in a ring, which is
cut at SLOTS fixed places, and from each cut on the TUPLE next ones are selected, put back into their order in the
text, and hashed together. Where many k-mers are, each slot selects the least ranks of its own range; where few are it
goes on into the next ranges, so that slots of short texts have tuples in order too. Two texts agree in a slot if they
share the same k-mers in the same order, so the share of agreeing slots falls with the edit distance and not only with
the shared words. (One permutation stands for SLOTS independent ones: on texts of few k-mers neighbouring slots agree
together, so likeness is coarser there. Two k-mers are taken for the same if 36 bits of their hashes agree.)

All work on a text is done inside its row, on sorted arrays of longs: position and hash, or rank and
position, share a long, so that both sorts are of primitives.

Defined results: null and empty texts, and texts of white space only, have the empty fingerprint, which
is like another empty one (1) and unlike all else (0). A text of fewer than K words has one
k-mer. Texts of any length are read whole. Repeated rows stay; rows with equal ids are ordered by a hash of their text;
null ids come last. A single document's next document is itself. An empty table gives an empty result. Columns of any
name pass through the helpers; the query ignores all but doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import long_array, whole_text

K, SLOT_BITS, WORD_LENGTH, PIECE = 3, 5, 16, 8
TUPLE = 2  # value() puts two in order
SLOTS = 1 << SLOT_BITS
PLACE_BITS = 28  # a string of 2 GB has no more words of two bytes
PLACE = (1 << PLACE_BITS) - 1
RANGES, RANGE_ROWS, MOST_RANGES = 64, 1 << 10, 1 << 16


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _kmer(words: Column, place: Column) -> Column:
    """Hash of the K words from a place on; fewer at the end of the text."""
    return F.xxhash64(*(F.get(words, (place + k).cast("int")) for k in range(K)))


def words(text: Column) -> Column:
    """Runs without white space, long ones as their overlapping pieces. A piece never starts inside a character."""
    run = r"[^\x20\x09-\x0D]"
    runs = F.regexp_extract_all(text, F.lit(f"{run}+"), F.lit(0))
    pieces = lambda x: F.regexp_extract_all(x, F.lit(f"(?s)(?![\\x{{DC00}}-\\x{{DFFF}}])(?=(.{{{PIECE}}}))"), F.lit(1))
    long = lambda x: F.char_length(x) > WORD_LENGTH
    parts = lambda all_: F.flatten(F.transform(all_, lambda x: F.when(long(x), pieces(x)).otherwise(F.array(x))))
    # A list of one entry, so that the runs are found once.
    return F.element_at(F.transform(F.array(runs), lambda all_: F.when(F.exists(all_, long), parts(all_)).otherwise(all_)), 1)


def _occurrence(kmers: Column, at: Column) -> Column:
    """How many of the sorted k-mers before this one are the same, by doubling steps back."""
    same = lambda back: (at - back >= 0) & (F.shiftright(F.get(kmers, at - back), PLACE_BITS) == F.shiftright(F.get(kmers, at), PLACE_BITS))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(PLACE_BITS))))
    several = F.aggregate(steps, F.lit(0), lambda n, s: F.when(same(n + s), n + s).otherwise(n))
    return F.when(same(F.lit(1)), several).otherwise(F.lit(0))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with array<int> column `out` (replaced if it is there): a number and hash for each slot, none for a text without words."""
    kept = [c for c in df.columns if c != out]
    # The row travels as a struct, so that no column of df clashes with one of ours.
    d = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), words(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("words"))
    n = F.size("words")
    # hash (upper bits) and place of every k-mer, sorted: equal ones stand together
    packed = F.transform(F.slice("words", F.lit(1), F.greatest(n - (K - 1), F.least(n, F.lit(1)))), lambda _, i: _kmer(F.col("words"), i).bitwiseAND(_long(~PLACE)).bitwiseOR(i.cast("long")))
    d = d.withColumn("kmers", F.sort_array(packed))
    rank = lambda x, i: F.xxhash64(F.shiftright(x, PLACE_BITS), _occurrence(F.col("kmers"), i))
    # slot and rank (upper bits) and place of every numbered k-mer, sorted: the ring
    ranked = F.transform("kmers", lambda x, i: rank(x, i).bitwiseAND(_long(~PLACE)).bitwiseOR(x.bitwiseAND(_long(PLACE))))
    d = d.withColumn("ring", F.sort_array(ranked))
    # where each slot's range begins, by binary search; an empty one begins where the next does
    m, half = F.size("ring"), SLOTS // 2
    d = d.withColumn("steps", F.slice(F.array(*(F.lit(1 << k) for k in reversed(range(PLACE_BITS)))), PLACE_BITS + 1 - F.length(F.bin(m.cast("long"))), F.length(F.bin(m.cast("long")))))
    bounds = F.array(*(_long(s << (64 - SLOT_BITS)) for s in range(-half, half)))  # longs are signed
    below = lambda bound: F.aggregate("steps", F.lit(0), lambda a, s: F.when((a + s <= m) & (F.get("ring", a + s - 1) < bound), a + s).otherwise(a))
    d = d.withColumn("begins", F.transform(bounds, below))
    place = lambda at: F.get("ring", at % m).bitwiseAND(_long(PLACE))

    def value(at: Column, s: Column) -> Column:
        places = [place(at + k) for k in range(TUPLE)]
        # the selected ones in the order of the text; a text of one k-mer selects it alone
        first, second = F.least(*places), F.greatest(*places)
        hashed = F.shiftrightunsigned(F.xxhash64(_kmer(F.col("words"), first), F.when(second != first, _kmer(F.col("words"), second))), 32 + SLOT_BITS)
        return F.shiftleft((s - half).cast("long"), 32 - SLOT_BITS).bitwiseOR(hashed).cast("int")

    d = d.withColumn("print", F.when(m > 0, F.transform("begins", value)).otherwise(F.array().cast("array<int>")))
    return d.select("row.*", F.col("print").alias(out))


def likeness(a: str, b: str) -> Column:
    """Share of slots that agree; 1 for two empty fingerprints."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def as_text(fingerprint: str) -> Column:
    """Eight hexadecimal digits for each slot."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x.cast("long") + _long(1 << 31)), 8, "0"))), "")


def with_next(df: DataFrame, columns: list[str], tie: str) -> DataFrame:
    """df with next_<column>: the values of the row that follows by descending doc_id and, for equal ids, hash of the
    column `tie`; after the last comes the first.

    Rows are cut into ranges of about equal size by both; a range exchange of ids and hashes finds the bounds. The first
    row of each range also goes to the range before it, as a guest, so each range finds all its next rows by itself. There are
    MOST_RANGES at most: beyond, ranges grow, which are sorted and streamed, never held. Only rows that agree in
    id and tie can't be cut apart.
    """
    key = F.coalesce("doc_id", _long(-(1 << 63)))
    ids = df.select(key.alias("key"), F.xxhash64(tie).alias("tie"))
    n = min(MOST_RANGES, max(RANGES, -(-ids.count() // RANGE_ROWS)))
    parts = ids.repartitionByRange(n, "key", "tie").groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct("key", "tie")).alias("top"))
    tops = sorted((r.top.key, r.top.tie) for r in parts.select("top").collect())
    if not tops:
        return df.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    keys, ties = long_array([k for k, _ in tops]), long_array([t for _, t in tops])
    d = df.select(F.struct("*").alias("row"), key.alias("key"), F.xxhash64(tie).alias("tie"))
    # the number of tops below a row, by binary search
    below = lambda i: (F.get(keys, i) < F.col("key")) | ((F.get(keys, i) == F.col("key")) & (F.get(ties, i) < F.col("tie")))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(tops).bit_length()))))
    d = d.withColumn("range", F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= len(tops)) & below(a + s - 1), a + s).otherwise(a)))
    is_top = (F.get(keys, F.col("range")) == F.col("key")) & (F.get(ties, F.col("range")) == F.col("tie"))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    guest = F.struct(((F.col("range") + 1) % len(tops)).alias("range"), F.lit(1).alias("guest"))
    d = d.select("row", "key", "tie", F.explode(F.when(is_top, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    within = W.Window.partitionBy("at.range").orderBy("at.guest", F.desc("key"), F.desc("tie"))
    d = d.select("row", "at", F.lead(F.struct(*(F.col(f"row.{c}").alias(f"next_{c}") for c in columns))).over(within).alias("next")).where("at.guest = 0")
    return d.select("row.*", "next.*")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of a text's characters replaced by the first ones of the next
    document, as many as there are.
    """
    d = with_fingerprint(docs.select("doc_id", whole_text().alias("text")), "text", "print")
    d = with_next(d, ["text", "print"], "text").withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))
    d = d.select("doc_id", "n_chars", edited.alias("edited"), "print", "next_print")
    d = with_fingerprint(d, "edited", "edited_print")
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text("print").alias("fingerprint"), as_text("edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"), likeness("print", "next_print").alias("near_next"),
    )
