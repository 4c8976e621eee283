"""SentencePiece encoding and decoding by batched numpy Viterbi (operator 3).

Texts fall apart into words (a run of white space marks and what follows), and long words where no piece can reach
across: between two characters that no piece has side by side. Distinct words of equal
length advance together through the lattice, one position at a time. All substrings that end at a
position are hashed from prefix hashes, the hashes probe the sorted keys of the model's pieces, and
a vectorised maximum over the lengths stores the backpointer. Where fewer than FEW words share a length, the same
lattice is walked in plain loops, which costs them less than numpy's calls: a text of a million letters is one word.

Two kinds of model are read. Unigram: the maximum is over the sum of piece scores. BPE, the kind of the public model
that the query uses: a merge order has no sums to maximise, so the lattice
keeps an arc only if merging by rank could leave its two pieces side by side; then exactly one arc
enters each position (the maximum is over one true value), the path is the merge result, and ids equal the library's own.

Defined results: null is encoded as the empty text, the empty text has no ids; texts of any length are encoded
whole. Characters outside the vocabulary become byte pieces (or <unk> where the model has none). Decoding gives the text
back, except that a white-space mark U+2581 in the text comes back as a space. Repeated rows stay, an empty table gives
an empty result, and columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy, whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CACHED_WORDS = 75_000  # distinct words of each of two generations that a Python worker keeps
UPPER = 18  # bits of a key that say where its probe starts
CACHED_PAIRS = 1 << 18  # slots for pairs of pieces whose fit is known
FEW = 24  # words of one length that are worth numpy's calls
LONG = 48  # characters of a word that is cut where no piece can reach across
CACHED_RUN = 1 << 12  # marks of a run whose ids are kept
NO_PIECE, OUTSIDE = -1, -2
LAST_RANK = np.int64(1) << 40


@dataclass
class Model:
    pieces: list[str]
    ids: dict[str, int]
    bpe: bool
    keys: np.ndarray  # hashes of the pieces that can end up in a result, sorted
    key_ids: np.ndarray
    first: np.ndarray  # of the sorted keys, by their upper bits
    some: np.ndarray  # whether any key has these upper bits
    scores: np.ndarray
    longest: int
    bytes_: list[int] | None
    unknown: int
    rank: np.ndarray  # of the merge that makes a piece, 0 for single characters
    halves: np.ndarray  # the two pieces that a piece is merged from
    pair_keys: np.ndarray  # left * size + right of those, sorted
    pair_ranks: np.ndarray
    reached: dict[str, int]  # the pieces that can end up in a result
    ends: dict[str, int]  # the last two characters of pieces: length of the longest such piece
    inner: np.ndarray  # pairs of characters that stand side by side in some piece, sorted

    def plain(self) -> tuple[list[int], list[int], list[int], dict[int, int]]:
        """rank, both halves and the ranks of pairs, for plain loops."""
        return self.rank.tolist(), *self.halves.T.tolist(), dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True))


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of code points: one more column than codes."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * MULTIPLIER + codes[:, i] + np.uint64(1)
    return out


def _mix(hashes: np.ndarray) -> np.ndarray:
    """Spread hashes over the upper bits."""
    return (hashes ^ (hashes >> np.uint64(31))) * MULTIPLIER


def _codes(words: list[str]) -> np.ndarray:
    """Rows of code points of words of equal length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _merge(word: str, ids: dict[str, int], priority: np.ndarray) -> list[str]:
    """Merge adjacent symbols, the best-scored pair first and the leftmost of equals."""
    parts: list[str] = list(word)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    waiting: list[tuple[float, int, int]] = []  # score, place of the left symbol, length of both together

    def offer(k: int) -> None:
        if k >= 0 and after[k] < len(parts):
            both = parts[k] + parts[after[k]]
            if (i := ids.get(both)) is not None:
                heapq.heappush(waiting, (-float(priority[i]), k, len(both)))

    for k in range(len(parts)):
        offer(k)
    while waiting:
        _, k, size = heapq.heappop(waiting)
        j = after[k]
        if not parts[k] or j >= len(parts) or len(parts[k]) + len(parts[j]) != size:
            continue  # one of the two has merged since
        parts[k] += parts[j]
        parts[j] = ""
        after[k] = after[j]
        if after[k] < len(parts):
            before[after[k]] = k
        offer(before[k])
        offer(k)
    return [x for x in parts if x]


def _bigrams(codes: np.ndarray) -> np.ndarray:
    """Two neighbouring code points in one number."""
    return (codes[..., :-1] << np.uint64(21)) | codes[..., 1:]


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Model:
    """The model's pieces and scores, and for BPE the merge that makes each piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.normalize("a  Åﬁ ") not in ("a  Åﬁ ", f"{MARK}a{MARK}{MARK}Åﬁ{MARK}") or sp.encode("a", out_type=str)[:1] not in ([MARK], [f"{MARK}a"]):
        raise ValueError("only models without normalization and with a dummy prefix are read")
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ids = {pieces[i]: i for i in plain}
    scores = np.array([sp.get_score(i) for i in range(n)])
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    # In a unigram model a score is a log probability; a merge order counts down from 0 by ones.
    bpe = bool(np.all(scores[plain] == np.round(scores[plain])))
    rank = np.zeros(n, np.int64)
    halves = np.full((n, 2), NO_PIECE, np.int64)
    reached = list(plain)
    if bpe:
        order = np.unique(-scores[plain])
        rank[plain] = np.searchsorted(order, -scores[plain]) + 1
        reached = []
        without_self = dict(ids)
        for i in plain:
            if len(pieces[i]) == 1:
                rank[i] = 0
                reached.append(i)
                continue
            if set(pieces[i]) == {MARK}:
                continue  # runs of marks are all of one score: merged in _run
            del without_self[pieces[i]]
            parts = _merge(pieces[i], without_self, scores)
            without_self[pieces[i]] = i
            if len(parts) == 2 and all(p in ids for p in parts):
                halves[i] = [ids[p] for p in parts]
                reached.append(i)
        whole = [i for i in reached if halves[i, 0] >= 0]
        if not np.all(rank[halves[whole]] < rank[whole][:, None]):
            raise ValueError("a piece outranks a piece that it is made of")
    by_length: dict[int, list[int]] = {}
    for i in reached:
        by_length.setdefault(len(pieces[i]), []).append(i)
    keys = _mix(np.concatenate([_hash(_codes([pieces[i] for i in group]))[:, -1] for group in by_length.values()]))
    key_ids = np.concatenate([np.array(group) for group in by_length.values()])
    order = np.argsort(keys)
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two pieces share a hash")
    made = np.flatnonzero(halves[:, 0] >= 0)
    pairs = halves[made, 0] * n + halves[made, 1]
    by_pair = np.argsort(pairs)
    fallback = byte_ids if sp.piece_to_id("<0x00>") != sp.unk_id() else None
    first = np.searchsorted(keys[order] >> np.uint64(64 - UPPER), np.arange((1 << UPPER) + 1)).astype(np.int32)
    known = {pieces[i]: i for i in reached}
    ends: dict[str, int] = {}
    for x in known:
        if len(x) > 1:
            ends[x[-2:]] = max(len(x), ends.get(x[-2:], 0))
    # Runs of marks are pieces too, though they don't come up in the lattice.
    side_by_side = {x[k : k + 2] for x in ids for k in range(len(x) - 1)}
    inner = np.sort(_bigrams(_codes(sorted(side_by_side)))[:, 0])
    return Model(pieces, ids, bpe, keys[order], key_ids[order], first, first[1:] > first[:-1], scores, max(by_length), fallback, sp.unk_id(), rank, halves, pairs[by_pair], rank[made][by_pair], known, ends, inner)


def _probe(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def _pieces(m: Model, wanted: np.ndarray) -> np.ndarray:
    """Ids of the pieces with the wanted hashes: each probes the few sorted keys that share its upper bits."""
    wanted = _mix(wanted)
    found = np.full(wanted.size, NO_PIECE, np.int64)
    flat = wanted.ravel()
    top = (flat >> np.uint64(64 - UPPER)).astype(np.int64)
    rows = np.flatnonzero(m.some[top])
    flat, top = flat[rows], top[rows]
    at, end = m.first[top], m.first[top + 1]
    while len(rows):
        hit = m.keys[at] == flat
        found[rows[hit]] = m.key_ids[at[hit]]
        at += 1
        more = ~hit & (at < end)
        rows, at, end, flat = rows[more], at[more], end[more], flat[more]
    return found.reshape(wanted.shape)


class Fits:
    """_neighbours with a direct-mapped cache of pairs."""

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.full(CACHED_PAIRS, -1, np.int64)
        self.values = np.zeros(CACHED_PAIRS, bool)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = (left + 2) * (len(self.model.pieces) + 2) + right
        slot = (_mix(pair.astype(np.uint64)) >> np.uint64(44)).astype(np.int64) & (CACHED_PAIRS - 1)
        new = np.flatnonzero(self.keys[slot] != pair)
        out = self.values[slot]
        if len(new):
            pairs, back = np.unique(pair[new], return_inverse=True)
            first = np.empty(len(pairs), np.int64)
            first[back] = new
            fit = _neighbours(self.model, left[first], right[first])
            out[new] = fit[back]
            # Of pairs that share a slot numpy stores the last one, in both arrays.
            self.keys[slot[first]] = pairs
            self.values[slot[first]] = fit
        return out


def _neighbours(m: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether merging by rank leaves `left` and `right` side by side.

    Walk back through the merges that made them, the latest first. At any time one piece ends at
    the border and one begins there; if both could merge with each other before either merged with
    its own other half (the left one also at the same rank, as the leftmost goes first), they would.
    """
    ok = np.ones(len(left), bool)
    rows = np.arange(len(left))
    known = (left >= 0) & (right >= 0)
    rows, x, y = rows[known], left[known], right[known]
    until_x = np.full(len(rows), LAST_RANK)
    until_y = np.full(len(rows), LAST_RANK)
    n = len(m.pieces)
    while len(rows):
        r = _probe(m.pair_keys, m.pair_ranks, x * n + y, LAST_RANK)
        bad = (r < LAST_RANK) & (r < until_x) & (r <= until_y)
        ok[rows[bad]] = False
        back_x = (m.rank[x] >= m.rank[y]) & (m.halves[x, 0] >= 0)
        more = ~bad & (back_x | (m.halves[y, 0] >= 0))
        rows, x, y, until_x, until_y, back_x = (a[more] for a in (rows, x, y, until_x, until_y, back_x))
        until_x = np.where(back_x, m.rank[x], until_x)
        until_y = np.where(back_x, until_y, m.rank[y])
        x, y = np.where(back_x, m.halves[x, 1], x), np.where(back_x, y, m.halves[y, 0])
    return ok


def viterbi(m: Model, words: list[str], fits: Fits) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of words of one length: the pieces by word and last character, and where one ends.

    OUTSIDE stands for a character that is no piece.
    """
    codes = _codes(words)
    w, n = codes.shape
    prefix = _hash(codes)
    powers = np.ones(m.longest + 1, np.uint64)
    powers[1:] = np.cumprod(np.full(m.longest, MULTIPLIER), dtype=np.uint64)
    worst = m.scores.min() - 10.0
    total = np.zeros((w, n + 1 if not m.bpe else 1))
    rows = np.arange(w)
    piece = np.full((w, n + 1), OUTSIDE, np.int64)
    step = np.ones((w, n + 1), np.int64)
    for i in range(1, n + 1):
        lengths = np.arange(1, min(m.longest, i) + 1)
        starts = i - lengths
        found = _pieces(m, prefix[:, i, None] - prefix[:, starts] * powers[lengths])
        alone = found[:, 0] < 0
        if m.bpe:
            open_ = found >= 0
            row, col = np.nonzero(open_[:, : i - 1] if i <= m.longest else open_)  # a whole prefix always fits
            misfit = ~fits(piece[row, starts[col]], found[row, col])
            open_[row[misfit], col[misfit]] = False
            open_[alone, 0] = True
            value = open_
        else:
            value = np.where(found >= 0, total[:, starts] + m.scores[found], -np.inf)
            value[alone, 0] = total[alone, i - 1] + worst
        found[alone, 0] = OUTSIDE
        best = value.argmax(1)
        piece[:, i], step[:, i] = found[rows, best], lengths[best]
        if not m.bpe:
            total[:, i] = value[rows, best]
        elif not value[rows, best].all():
            raise ValueError("a word has no path")
    on_path = np.zeros((w, n), bool)
    at = np.full(w, n)
    while len(rows):
        on_path[rows, at[rows] - 1] = True
        at[rows] -= step[rows, at[rows]]
        rows = rows[at[rows] > 0]
    return piece[:, 1:], on_path


class Walk:
    """The lattice of one word in plain loops: the same path as viterbi()."""

    def __init__(self, model: Model):
        self.m, self.size = model, len(model.pieces)
        self.rank, self.left, self.right, self.pairs = model.plain()
        self.fits: dict[int, bool] = {}
        self.worst = float(model.scores.min()) - 10.0
        self.scores = model.scores.tolist()

    def _fit(self, x: int, y: int) -> bool:
        """_neighbours() of two pieces."""
        until_x = until_y = int(LAST_RANK)
        while True:
            r = self.pairs.get(x * self.size + y)
            if r is not None and r < until_x and r <= until_y:
                return False
            if self.rank[x] >= self.rank[y] and self.left[x] >= 0:
                until_x, x = self.rank[x], self.right[x]
            elif self.left[y] >= 0:
                until_y, y = self.rank[y], self.left[y]
            else:
                return True

    def _last(self, word: str) -> tuple[list[int], list[int]]:
        """The piece that ends at each position, and its length."""
        m, fits, size = self.m, self.fits, self.size
        reached, ends = m.reached, m.ends
        piece, step = [OUTSIDE] * (len(word) + 1), [1] * (len(word) + 1)
        total = [0.0] * (len(word) + 1)
        if len(fits) > CACHED_PAIRS // 4:
            fits.clear()
        for i in range(1, len(word) + 1):
            j = reached.get(word[i - 1])
            most = min(i, ends.get(word[i - 2 : i], 1)) if i > 1 else 1
            if m.bpe:
                k = 1
                while j is not None:  # a character that is no piece stays alone
                    before = piece[i - k]
                    if k == i or before < 0:
                        break
                    pair = before * size + j
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self._fit(before, j)
                    if ok:
                        break
                    j = None
                    while j is None:
                        k += 1
                        if k > most:
                            raise ValueError("a word has no path")
                        j = reached.get(word[i - k : i])
                piece[i], step[i] = OUTSIDE if j is None else j, k
            else:
                best = total[i - 1] + (self.worst if j is None else self.scores[j])
                piece[i] = OUTSIDE if j is None else j
                for k in range(2, most + 1):
                    j = reached.get(word[i - k : i])
                    if j is not None and total[i - k] + self.scores[j] > best:
                        best, piece[i], step[i] = total[i - k] + self.scores[j], j, k
                total[i] = best
        return piece, step

    def path(self, word: str) -> list[tuple[int, int]]:
        """(piece, its end) in order; OUTSIDE for a character that is no piece."""
        piece, step = self._last(word)
        at, out = len(word), []
        while at > 0:
            out.append((piece[at], at))
            at -= step[at]
        return out[::-1]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Encoder:
    """Encodes texts, remembering the ids of words it has met."""

    def __init__(self, path: str = MODEL):
        self.model = load(path)
        self.fits = Fits(self.model)
        self.walk = Walk(self.model)
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers
        self.older: dict[str, bytes] = {}  # the generation before: what is met again moves on
        self.runs: dict[int, bytes] = {}
        self.raw: list[bytes] = []

    def _run(self, n: int) -> bytes:
        """Ids of n marks alone."""
        found = self.runs.get(n)
        if found is None:
            m = self.model
            if m.bpe:
                found = _packed([m.ids[p] for p in _merge(MARK * n, m.ids, m.scores)])
            else:
                self._learn([MARK * n])
                found = self.known[MARK * n]
            if n <= CACHED_RUN:
                self.runs[n] = found
        return found

    def _outside(self, character: str) -> tuple[int, ...]:
        m = self.model
        return tuple(m.bytes_[b] for b in character.encode()) if m.bytes_ else (m.unknown,)

    def learn(self, words: set[str]) -> None:
        """Encode words not met so far, those of equal length together."""
        by_length: dict[int, list[str]] = {}
        for x in words:
            by_length.setdefault(len(x), []).append(x)
        for length, group in by_length.items():
            if len(group) < FEW:
                for x in group:
                    self._learn_one(x)
                continue
            rows = max(1, (1 << 17) // length)
            for k in range(0, len(group), rows):
                self._learn(group[k : k + rows])

    def _learn(self, words: list[str]) -> None:
        piece, on_path = viterbi(self.model, words, self.fits)
        packed = piece[on_path].astype(np.int32).tobytes()
        ends = np.cumsum(on_path.sum(1)) * 4
        starts = [0, *ends[:-1].tolist()]
        self.known.update(zip(words, [packed[a:b] for a, b in zip(starts, ends.tolist(), strict=True)], strict=True))
        for r in np.flatnonzero((on_path & (piece == OUTSIDE)).any(1)).tolist():
            ids: list[int] = []
            for k in np.flatnonzero(on_path[r]).tolist():
                ids.extend((int(piece[r, k]),) if piece[r, k] >= 0 else self._outside(words[r][k]))
            self.known[words[r]] = _packed(ids)

    def _learn_one(self, word: str) -> None:
        ids: list[int] = []
        for piece, end in self.walk.path(word):
            ids.extend((piece,) if piece >= 0 else self._outside(word[end - 1]))
        self.known[word] = _packed(ids)

    def _cut(self, word: str) -> list[str]:
        """A word's parts between characters that no piece has side by side: each is encoded as if alone."""
        pairs = _bigrams(_codes([word])[0])
        inner = self.model.inner
        at = np.minimum(np.searchsorted(inner, pairs), len(inner) - 1)
        places = [0, *(np.flatnonzero(inner[at] != pairs) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(places, places[1:])]

    def _words(self, text: str) -> list[str]:
        found = WORD.findall(MARK + text.replace(" ", MARK)) if text else []
        if max(map(len, found), default=0) <= LONG:
            return found
        return [y for x in found for y in (self._cut(x) if len(x) > LONG else (x,))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        m, known = self.model, self.known
        split = [self._words(x) for x in texts]
        fresh = set(chain.from_iterable(split))
        fresh.difference_update(known)
        if len(known) + len(fresh) > CACHED_WORDS:
            self.older, self.known = known, {}
            known = self.known
            fresh = set(chain.from_iterable(split))
        known.update((y, self.older[y]) for y in fresh & self.older.keys())
        fresh.difference_update(known)
        # In BPE a run of marks merges last of all; only its last mark belongs to the word, see _led.
        led = {y for y in fresh if y[:2] == MARK * 2 or y == MARK} if m.bpe else set()
        behind: set[str] = {MARK + x for y in led if (x := y.lstrip(MARK))}
        self.learn((fresh - led) | (behind - known.keys()))
        for y in led:
            known[y] = self._led(y)
        out = []
        for x in split:
            out.append(np.frombuffer(b"".join(map(known.__getitem__, x)), np.int32))
        for y in [y for y in fresh if len(y) > LONG] + [y for y in behind if len(y) > LONG]:
            known.pop(y, None)  # the cache is bounded in words, so they have to be short
        return out

    def _led(self, word: str) -> bytes:
        """A word behind a run of marks: runs merge last of all, so only what the word left of its mark joins them."""
        rest = word.lstrip(MARK)
        n = len(word) - len(rest)
        if not rest:
            return self._run(n)
        own = self.known[MARK + rest]
        if own[:4] == _packed([self.model.ids[MARK]]):
            return self._run(n) + own[4:]
        return self._run(n - 1) + own

    def decode(self, rows: list) -> list[str]:
        """Texts of rows of ids; control pieces vanish, byte pieces join to UTF-8."""
        if not self.raw:
            m = self.model
            kept = set(m.ids.values())
            self.raw = [x.replace(MARK, " ").encode() if i in kept else b"" for i, x in enumerate(m.pieces)]
            for b, i in enumerate(m.bytes_ or ()):
                self.raw[i] = bytes([b])
            self.raw[m.unknown] = " \u2047 ".encode()
        raw = self.raw
        out = []
        for ids in rows:
            text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(texts: pd.Series, most: int = 1 << 22):
    """Lists of texts of about `most` characters together."""
    part, size = [], 0
    for x in texts:
        part.append(x or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encoded(text: Column, path: str = MODEL) -> Column:
    """array<int> of ids; the model file must be on every machine."""

    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([ids for part in _slices(texts) for ids in encoder(path).encode(part)], dtype=object)

    return F.pandas_udf(tidy(encode), "array<int>")(text)


def decoded(ids: Column, path: str = MODEL) -> Column:
    """The text of an array of ids; null for null."""

    def decode(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else encoder(path).decode([x])[0] for x in rows], dtype=object)

    return F.pandas_udf(tidy(decode), "string")(ids)


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids of every whole text, and whether the ids decode to the same text.

    One Python pass encodes and decodes. Repeated rows stay, an empty table gives an empty result.
    """

    def both(texts: pd.Series) -> pd.DataFrame:
        e = encoder(path)
        rows = []
        for part in _slices(texts):
            ids = e.encode(part)
            rows += [(len(i), i, e.decode([i.tolist()])[0] == x.replace(MARK, " ")) for x, i in zip(part, ids, strict=True)]
        return pd.DataFrame(rows, columns=["n_tokens", "ids", "round_trip"])

    bound_batches(docs.sparkSession)
    x = F.pandas_udf(tidy(both), "n_tokens long, ids array<int>, round_trip boolean")(whole_text())
    return docs.select("doc_id", x.alias("x")).select("doc_id", "x.*")
