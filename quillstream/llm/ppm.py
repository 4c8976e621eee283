"""Language-model scores by prediction by partial matching (operator 7).

The model is a trie of byte contexts of up to ORDER bytes, counted over the whole training part of
the corpus. A symbol's probability comes from the longest context that has been seen; if that context
never led to the symbol, an escape (estimated from how many different symbols followed it) leads to the
next shorter one, where the symbols of the longer one are excluded. Shorter contexts count in how many
longer contexts a symbol was seen (update exclusion). A document's score is the sum over the
bytes of its words (A-Z lower-cased, one space after each) and an end symbol.

Neither the trie nor the word counts are ever in one place. Texts are packed into chunks of about
CHUNK bytes, or fewer if they have GRAMS distinct n-grams before; a chunk lists its distinct n-grams (a context of ORDER
bytes and a symbol) and words. Those lists are summed by n-gram and by word (before the exchange and after it), shards of
the trie (all contexts with the same last three bytes stay together, at most 2**24 n-grams) are priced, the prices and the
sums of words are joined back to the chunks' lists (a list has an n-gram or a word once, so no key has more rows
than there are chunks), and each chunk meets its own list again, in a task of its own if there are as many shuffle
partitions. Only contexts of up to two bytes, at most 2**24 n-grams of twelve bytes, are sent to every shard. Memory is
bounded by a chunk, or by the longest text.

Defined results: null and empty texts have no words, only the end; texts of any length are scored whole; repeated rows
each count and each get a score; columns besides doc_id and text are ignored, whatever their names; without any training
row every byte costs log10(256) and the base is log10(0.5/0.5). An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fold, materialize, release, whole_text

ORDER = 5
END = b"\xff"  # never a byte of UTF-8
CHUNK = 32 << 20
GRAMS = 1 << 22  # distinct n-grams of a chunk, beyond which it isn't added to
#: A row of a list has its place as one long, the chunk's number above SLOT_BITS. What comes back has the place in the
#: list, a kind and VALUE_BITS of a value as one long. A chunk (so a text) has at most 2**SLOT_BITS n-grams.
SLOT_BITS, NUMBER_BITS, VALUE_BITS = 27, 16, 34
PRICE, SUM, REST = range(3)  # a price; the lower bits of a word's sum; its upper bits, where it has any
PIECE = 1 << 19  # bytes whose n-grams are sorted at once
SHARD = 1 << 18  # n-grams of a shard, about
SCALE = 1_000_000  # prices are integers: millionths of log10
MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[bytes]:
    """Words, and the end."""
    return [*text.encode().lower().split(), END]


def ngrams(data: bytes, order: int = ORDER) -> np.ndarray:
    """For every byte of data from the one at `order` on: it and the `order` bytes before it."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = a[order:].copy()
    for j in range(1, order + 1):
        out |= a[order - j : len(a) - j] << np.uint64(8 * j)
    return out


def _stream(words: list[bytes]) -> bytes:
    """What the model reads of a document: words with a space after each, then the end."""
    return END * ORDER + b" ".join(words)


def _pieces(streams: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first stream, n-grams, start of each stream) of runs of streams of about PIECE bytes."""
    i = 0
    while i < len(streams):
        k, size = i, 0
        while k < len(streams) and (k == i or size + len(streams[k]) <= PIECE):
            size += len(streams[k])
            k += 1
        lengths = np.array([len(x) for x in streams[i:k]])
        starts = np.cumsum(lengths) - lengths
        grams = ngrams(b"".join(streams[i:k]))
        inside = np.ones(len(grams), bool)  # the n-grams that end in the next stream's start don't count
        for j in range(ORDER):
            inside[starts[1:] - ORDER + j] = False
        yield i, grams[inside], starts - ORDER * np.arange(k - i)
        i = k


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    unique, back = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(back, np.concatenate(counts), len(unique)).astype(np.int64)


LEVEL = 7  # of compression


def _pack(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _own_counts(found: list[np.ndarray], train: list[bool], size: int) -> np.ndarray:
    """How often each word of a chunk is in its training documents."""
    counts = np.zeros(size, np.int64)
    for x, t in zip(found, train, strict=True):
        if t:
            np.add.at(counts, x, 1)
    return counts


#: A chunk's row, and the rows of its lists (gram or word is set). `at` is the chunk's number and a place in its list.
CHUNKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("raw_size", pa.int64()), ("text", pa.binary()), ("grams", pa.binary()), ("n_grams", pa.int64()), ("at", pa.int64()), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
CHUNKS_DDL = "block long, doc_ids array<long>, train array<boolean>, sizes array<long>, raw_size long, text binary, grams binary, n_grams long, at long, gram long, word binary, n long"


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in CHUNKS], [f.name for f in CHUNKS])


def _murmur3(x: np.ndarray) -> np.ndarray:
    """The hash that deals rows to shuffle partitions, of longs: 32-bit Murmur3 (public domain) of both halves, seed 42."""
    m = np.uint64(0xFFFFFFFF)
    turn = lambda v, r: ((v << np.uint64(r)) | (v >> np.uint64(32 - r))) & m
    h = np.full(len(x), 42, np.uint64)
    for half in (x & m, x >> np.uint64(32)):
        k = (turn((half * np.uint64(0xCC9E2D51)) & m, 15) * np.uint64(0x1B873593)) & m
        h = (turn(h ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & m
    h ^= np.uint64(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & m
    return (h ^ (h >> np.uint64(16))).astype(np.uint32).view(np.int32)


def block_numbers(task: int, partitions: int) -> Iterator[int]:
    """Numbers for the chunks of a task that spread evenly over the shuffle partitions: those of task 0, 1, 2 ... fall
    into one partition after the other, and so do the next chunks of each task. (Where no number is left that
    falls there, another one serves.)"""
    if task >= 1 << 63 - SLOT_BITS - NUMBER_BITS:
        raise ValueError("too many tasks")
    numbers = np.uint64(task << NUMBER_BITS) + np.arange(1 << NUMBER_BITS, dtype=np.uint64)
    falls = _murmur3(numbers).astype(np.int64) % partitions
    for k in range(1 << NUMBER_BITS):
        hits = np.flatnonzero(falls == (task + k) % partitions)
        i = int(hits[0]) if len(hits) else int(np.flatnonzero(falls >= 0)[0])
        falls[i] = -1
        yield int(numbers[i])
    raise ValueError("too many chunks in a task")


class Chunk:
    """The documents of one chunk, as they come, and its n-grams so far."""

    def __init__(self):
        self.ids, self.train, self.streams, self.found, self.size = [], [], [], [], 0
        self.slots: defaultdict[bytes, int] = defaultdict()
        self.slots.default_factory = self.slots.__len__
        self.keys, self.sums, self.counted, self.waiting = [], [], 0, 0

    def add(self, doc_id: int | None, train: bool, text: str) -> None:
        words = tokens(text)
        self.ids.append(doc_id)
        self.train.append(train)
        self.streams.append(_stream(words))
        self.found.append(np.fromiter(map(self.slots.__getitem__, words), np.int32, len(words)))
        self.size += len(text)
        self.waiting += len(text)
        if self.waiting >= 8 * PIECE:
            self.count()

    def count(self) -> None:
        """Count the n-grams of the streams that came since the last time."""
        new = list(zip(self.streams[self.counted :], self.train[self.counted :], strict=True))
        for part, wanted in (([s for s, t in new if t], 1), ([s for s, t in new if not t], 0)):
            for _, grams, _ in _pieces(part):
                k, n = _counted(grams)
                self.keys.append(k)
                self.sums.append(n * wanted)
                if len(self.keys) > 8:
                    self.sum()
        self.counted, self.waiting = len(self.streams), 0
        self.sum()

    def sum(self) -> None:
        if len(self.keys) > 1:
            self.keys, self.sums = ([x] for x in _summed(self.keys, self.sums))

    def full(self, most_bytes: int, most_grams: int) -> bool:
        return self.size >= most_bytes or bool(self.keys) and len(self.keys[0]) >= most_grams


def _rows(block: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
    """The rows of one chunk, which is used up: places follow the words as they came, and the sorted n-grams."""
    chunk.count()
    ids, train, streams, found, slots, grams, seen = chunk.ids, chunk.train, chunk.streams, chunk.found, chunk.slots, chunk.keys[0], chunk.sums[0]
    del chunk.streams, chunk.found, chunk.slots, chunk.keys, chunk.sums
    counts = _own_counts(found, train, len(slots))
    del found
    if max(len(grams), len(slots)) >= 1 << SLOT_BITS:
        raise ValueError("a text has too many different n-grams or words")
    step, first = 1 << 16, block << SLOT_BITS
    words = list(slots)
    del slots
    for i in range(0, len(words), step):
        k = len(words[i : i + step])
        yield _batch(at=np.arange(first + i, first + i + k), word=words[i : i + step], n=counts[i : i + step])
    del words, counts
    raw = b"".join(streams)
    sizes = [len(s) for s in streams]
    del streams
    delta = _pack(np.diff(grams, prepend=np.uint64(0)).tobytes())
    yield _batch(block=[block], doc_ids=[ids], train=[train], sizes=[sizes], raw_size=[len(raw)], text=[_pack(raw)], grams=[delta], n_grams=[len(grams)])
    del raw, delta
    for i in range(0, len(grams), step):
        k = len(grams[i : i + step])
        yield _batch(at=np.arange(first + i, first + i + k), gram=grams[i : i + k].astype(np.int64), n=seen[i : i + step])


def _packed(most_bytes: int, most_grams: int, partitions: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers = block_numbers(TaskContext.get().partitionId(), partitions)
        chunk = Chunk()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "train", "text")), strict=True):
                chunk.add(*row)
                if chunk.full(most_bytes, most_grams):
                    yield from _rows(next(numbers), chunk)
                    chunk = Chunk()
                    release()
        if chunk.ids:
            yield from _rows(next(numbers), chunk)
        del chunk
        release()

    return run


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether the wanted values are there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


class Level:
    """The contexts of one length: n-grams (sorted), how often each counts, and sums by context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.contexts, of = np.unique(keys >> keys.dtype.type(8), return_inverse=True)
        self.of = of.astype(np.int32)
        self.total = np.bincount(self.of, counts, len(self.contexts))
        self.kinds = np.bincount(self.of, minlength=len(self.contexts))

    def narrow(self) -> Level:
        """The same in less memory, for short contexts."""
        self.keys, self.contexts, self.counts = self.keys.astype(np.uint32), self.contexts.astype(np.uint32), self.counts.astype(np.int32)
        return self

    def excluded(self, lower: Level, order: int) -> np.ndarray:
        """What `lower`, of contexts of `order` bytes, loses by exclusion of the symbols of each context here."""
        below, _ = _find(lower.keys, (self.keys & self.keys.dtype.type(_mask(order))).astype(lower.keys.dtype))
        return np.bincount(self.of, lower.counts[below], len(self.contexts))


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (8 * (order + 1))) - 1)


def shorter(level: Level, order: int) -> Level:
    """The level of contexts of `order` bytes, from that of one byte more."""
    keys, counts = _counted(level.keys & _mask(order))
    return Level(keys, counts)


def prices(wanted: np.ndarray, levels: dict[int, Level], excluded: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of each wanted n-gram's last byte after the bytes before it. `excluded`: what is known by order."""
    excluded = excluded or {}
    out = np.zeros(len(wanted))
    open_ = np.ones(len(wanted), bool)
    top = max(levels)
    for order in range(top, -1, -1):
        level = levels[order]
        width = level.keys.dtype.type
        grams = (wanted & _mask(order)).astype(width)
        at, context = _find(level.contexts, grams >> width(8))
        place, seen = _find(level.keys, grams)
        total, kinds = (np.where(context, x[at], 0) if len(x) else np.zeros(len(wanted)) for x in (level.total, level.kinds))
        if order < top and len(levels[order + 1].keys):
            longer = levels[order + 1]
            lost = excluded[order] if order in excluded else longer.excluded(level, order)
            at, came = _find(longer.contexts, ((wanted & _mask(order + 1)) >> np.uint64(8)).astype(longer.contexts.dtype))
            total = total - np.where(came, lost[at], 0)
            kinds = kinds - np.where(came, longer.kinds[at], 0)
        asked = open_ & (kinds > 0)  # a context all of whose symbols are excluded tells nothing
        hit, missed = asked & seen, asked & ~seen
        if hit.any():
            out[hit] += np.log10((2 * level.counts[place[hit]] - 1) / (2 * total[hit]))
        out[missed] += np.log10(kinds[missed] / (2 * total[missed]))
        open_ &= ~hit
    left = 256 - (int(levels[0].kinds.sum()) if 0 in levels else 0)
    out[open_] -= np.log10(max(1, left))
    return out


def low_levels(keys: np.ndarray, counts: np.ndarray) -> tuple[dict[int, Level], dict[int, np.ndarray]]:
    """Levels 2, 1 and 0 from the n-grams of two context bytes, and what levels 1 and 0 lose by exclusion."""
    order = np.argsort(keys)
    two = Level(keys[order].astype(np.uint64), counts[order])
    one = shorter(two, 1)
    levels = {2: two, 1: one, 0: shorter(one, 0)}
    lost = {k: levels[k + 1].excluded(levels[k], k) for k in (1, 0)}
    return {k: x.narrow() for k, x in levels.items()}, lost


def _price_shard(table: pa.Table, low: dict[int, Level], lost: dict[int, np.ndarray]) -> pa.Table:
    keys = table.column("gram").to_numpy().astype(np.uint64)
    counts = table.column("n").to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    levels = dict(low)
    known = counts > 0
    levels[ORDER] = Level(keys[known], counts[known])
    for k in range(ORDER - 1, 2, -1):
        levels[k] = shorter(levels[k + 1], k)
    return pa.table({"gram": pa.array(keys.astype(np.int64)), "price": pa.array(np.rint(prices(keys, levels, lost) * SCALE).astype(np.int64))})


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, index: tuple) -> np.ndarray:
    """values of the wanted keys, all of which are there."""
    first, bits = index
    hashed = wanted * MIX
    at = first[(hashed >> np.uint64(64 - bits)).astype(np.int64)]
    out = np.empty(len(wanted), values.dtype)
    rows, rest = None, wanted
    while len(rest):
        hit = keys[at] == rest
        if rows is None:
            out[:] = values[at]
            rows = np.flatnonzero(~hit)
        else:
            out[rows[hit]] = values[at[hit]]
            rows = rows[~hit]
        rest, at = rest[~hit], at[~hit] + 1
    return out


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_chunk(chunk: pa.Table, lists: pa.Table, n: int, v: int) -> pa.Table:
    row = chunk.to_pylist()[0]
    raw = pa.decompress(row["text"], row["raw_size"], "zstd", asbytes=True)
    packed = lists.column("packed").to_numpy()
    slot, kind, value = packed >> (VALUE_BITS + 2), (packed >> VALUE_BITS) & 3, packed & ((1 << VALUE_BITS) - 1)
    del packed
    ends = np.cumsum(row["sizes"])
    streams = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    del raw
    slots: defaultdict[bytes, int] = defaultdict()
    slots.default_factory = slots.__len__
    found = []
    for s in streams:
        words = s[ORDER:].split()
        found.append(np.fromiter(map(slots.__getitem__, words), np.int32, len(words)))
    count = _own_counts(found, row["train"], len(slots))
    del slots, words
    count[slot[kind == SUM]] = value[kind == SUM]  # words that other chunks count as well
    count[slot[kind == REST]] += value[kind == REST] << VALUE_BITS
    base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
    n_tokens = [len(at) for at in found]
    n_known = [int((count[at] > 0).sum()) for at in found]
    base_score = [float(base[at].sum()) for at in found]
    del found, base, count
    release()

    # The n-grams by the upper bits of a mixed hash: each look-up starts at the first with the same bits.
    grams = np.cumsum(np.frombuffer(pa.decompress(row["grams"], 8 * row["n_grams"], "zstd", asbytes=True), np.uint64), dtype=np.uint64)
    priced = kind == PRICE
    price = np.empty(len(grams), np.int64)
    price[slot[priced]] = -value[priced]
    if priced.sum() != len(grams):
        raise ValueError("a chunk lacks prices")
    del slot, kind, value, priced
    bits = max(1, int(len(grams)).bit_length())
    order = np.argsort(grams * MIX)
    grams, price = grams[order], price[order]
    first = np.searchsorted((grams * MIX) >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
    score: list[float] = []
    for _, wanted, starts in _pieces(streams):
        score.extend((np.add.reduceat(_lookup(grams, price, wanted, (first, bits)), starts) / SCALE).tolist())
    size = len(streams)
    del streams, grams, price, first
    release()
    return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array([not t for t in row["train"]]), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([n] * size, pa.int64()), "base_score": base_score, "score": score})


def score_documents(docs: DataFrame, train: Column | None = None, chunk: int = CHUNK, grams: int = GRAMS, shard: int = SHARD) -> DataFrame:
    """The columns of RESULT for every row of docs (doc_id, text); `train` says which rows to learn from.

    Prices are rounded to millionths, so a score is off by half a millionth for each byte of the text at most. chunk and
    grams bound what a Python worker holds (bytes of text, distinct n-grams), shard about how many n-grams it prices at once.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    train = fold(F.col("doc_id")) != 1 if train is None else train
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), train.alias("train"), whole_text().alias("text"))
    rows = materialize(texts.mapInArrow(_packed(chunk, grams, partitions), CHUNKS_DDL), "chunks")
    chunks = rows.where("text is not null").select("block", "doc_ids", "train", "sizes", "raw_size", "text", "grams", "n_grams")
    in_chunk = rows.where("gram is not null").select("at", "gram", "n")
    words = rows.where("word is not null").select("at", "word", "n")

    # A chunk counts its own words again when it is scored: only the sums of words that others list as well are sent back.
    summed = words.groupBy("word").agg(F.sum("n").alias("value"), F.count("*").alias("lists"), F.count_if(F.col("n") > 0).alias("counts"))
    shared = materialize(summed.where("lists > 1").drop("lists"), "words")
    total = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("counts")).first()
    again = shared.where("counts > 1").agg(F.sum(F.col("counts") - 1).alias("counts")).first()
    n, v = total.n or 0, total.counts - (again.counts or 0)
    sums = words.join(shared.select("word", "value"), "word").where("value != n").select("at", "value")

    of_gram = materialize(in_chunk.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    known = of_gram.where("n > 0")
    four = known.select(F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("g")).distinct()
    # At most 2**24 rows, as three bytes have no more values.
    three = four.groupBy(F.col("g").bitwiseAND(F.lit(0xFFFFFF).cast("long")).alias("g")).agg(F.count("*").cast("int").alias("n"))
    three = three.select(F.col("g").cast("int"), "n").toArrow()
    low = low_levels(three.column("g").to_numpy().astype(np.uint64), three.column("n").to_numpy().astype(np.int64))
    shards = max(1, -(-of_gram.count() // shard))
    last_three = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFFFF).cast("long"))
    sent = spark.sparkContext.broadcast(low)
    priced = of_gram.groupBy(F.pmod(F.xxhash64(last_three), F.lit(shards)).alias("shard")).applyInArrow(lambda t: _price_shard(t.select(["gram", "n"]), *sent.value), "gram long, price long")

    low_bits = (1 << VALUE_BITS) - 1
    lists = in_chunk.select("at", "gram").join(priced, "gram").select("at", F.lit(PRICE).alias("kind"), (-F.col("price")).alias("value"))
    lists = lists.union(sums.select("at", F.lit(SUM), F.col("value").bitwiseAND(F.lit(low_bits).cast("long"))))
    lists = lists.union(sums.where(F.col("value") > low_bits).select("at", F.lit(REST), F.shiftright("value", VALUE_BITS)))
    slot = F.col("at").bitwiseAND(F.lit((1 << SLOT_BITS) - 1).cast("long"))
    packed = F.shiftleft(slot * 4 + F.col("kind"), VALUE_BITS).bitwiseOR(F.col("value"))
    lists = lists.select(F.shiftright("at", SLOT_BITS).alias("owner"), packed.alias("packed"))
    return chunks.groupBy("block").cogroup(lists.groupBy("owner")).applyInArrow(lambda a, b: _score_chunk(a, b, n, v), RESULT)
