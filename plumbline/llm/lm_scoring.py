"""8. Language-model scoring by online logistic context mixing.

A text is a row of tokens and an end. What follows the last ORDER words is looked up in the whole corpus:
where these words occur elsewhere, a bit says whether the token is one of those that followed them, and
if so its share among them tells which. All other tokens are coded in bits: frequent words and the end by
the path in a Huffman tree of their counts, others by an escape and the paths of their bytes in a second
tree. Every bit of a path is predicted from several contexts (the node alone, with the last very frequent
word, with one and two words before; in spelling, with one byte and that frequent word, and with two to
four bytes before). A context is hashed to a slot (each tree has half of them) that holds how often its
bit was 0 and 1 in the training documents; the bit of the long contexts is predicted from how it went
before in the document. The stretched chances are summed with weights that a gate (the kind of bit, and
the depth in the tree or the number of occurrences) selects; weights go on learning online
within each document, from ROUND tokens to the next. An adaptive map refines the sum. The bits add up to
the text's log-probability, so every token has a proper probability given those before it.

A training document's own occurrences are taken out of the long contexts before it is scored, as they
would be all that most contexts have; in slots and word counts they stay. Every training document counts
everywhere. The weights that documents start with are the likeliest for all training documents: these are
in two halves by a hash, and bits are counted by gate and by the levels of their inputs in the other half's
slots; Newton's steps on these counts, gate by gate, give the weights.

Plan: word counts by a shuffle; documents in groups of a few MB, written once; slot counts by one array a
task, summed by runs of slots in a second shuffle. Long contexts and rare words go by shards of their
hashes, about five bytes each and once a group, however often they come, so a passage of all documents is
one row a group; a shard adds up its occurrences and answers every group. Groups meet their answers once
and are written; a pass over them counts for the weights (one array a task, summed by gate), and another
scores. Shards and groups grow in number with the corpus, not in size. The driver and the tasks hold TOP
words, SLOTS slots and the weights.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, fold, table
from .vecbytes import LOWER, Hasher, U, blocks, mix, raw, words

#: Words with a code of their own.
TOP = 1 << 17
#: Rarer words have none, so that training meets escapes and spelling as often as new texts do.
LEAST = 3
SLOT_BITS = 22
SLOTS, RUN = 1 << SLOT_BITS, 4096
INPUTS = 4
#: Stretched chances are kept in steps of 1/STEP.
STEP = 10
#: Very frequent words that tell the language of what follows.
COMMON = 64
#: Words that are told apart as the one before, and as each of the two before.
FREQUENT = (256, 1024)
#: Words before that make a long context.
ORDER = 3
#: Long contexts of a shard, on average, and bits of their tags and of the next word's; of small inputs there are LEAST_SHARDS.
SHARD, CONTEXT, TAG = 1 << 19, 26, 24
KEY, LEAST_SHARDS = CONTEXT + TAG, 64
#: Tokens of a document between two steps of its own weights.
ROUND = 128
RATE = 0.0002
#: Stretched chances come to the fit as one of 15 levels each: beyond so many steps of 1/STEP, and what stands for them.
EDGES = np.array([3, 9, 17, 27, 39, 54, 78])
LEVELS = np.array([0, 0.5, 1.2, 2.1, 3.2, 4.6, 6.5, 9.5])
#: Cells of a gate: the levels of its four inputs, times the bit.
CELLS = 1 << 17
#: How strongly a gate's weights are held where they start.
PRIOR = 20.0
DEPTHS = 24
KINDS = 3
BUCKETS = 33
#: Sums are looked up in steps of 1/FINE from -LIMIT to LIMIT.
FINE, LIMIT = 64, 16
BLOCK = 384 << 10
#: Bits that are mixed at a time, about.
MIXED = 1 << 15
#: Symbols in contexts that are added up before they come to the slots, and how many of them come at a time.
DEALT, PIECE = 1 << 18, 1 << 14
#: Bytes of text in a group, at least and at most (or one document).
GROUP = (128 << 10, 2 << 20)
END_HASH = -7046029254386353131


@dataclass(frozen=True)
class Tree:
    """Huffman paths of symbols: where each path starts among the steps of all, their hashed nodes, and their gates with the bit below."""

    start: np.ndarray
    node: np.ndarray
    way: np.ndarray
    offset: int

    @classmethod
    def of(cls, counts: np.ndarray, kind: int) -> Tree:
        """kind 0: words, 1: bytes; each has its half of the slots and its gates."""
        n = len(counts)
        heap = [(int(c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        up, side, nodes = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8), n
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i] = up[j] = nodes
            side[j] = 1
            heapq.heappush(heap, (a + b, nodes))
            nodes += 1
        start, node, bit, depth = [0], [], [], []
        for i in range(n):
            at, path = i, []
            while at != nodes - 1:
                path.append((up[at], side[at]))
                at = up[at]
            node += [p[0] for p in reversed(path)]
            bit += [p[1] for p in reversed(path)]
            depth += range(len(path))
            start.append(len(node))
        gate = kind * DEPTHS + np.minimum(np.array(depth, np.int64), DEPTHS - 1)
        hashed = mix(np.array(node, np.int64).astype(U) + U(kind + 1 << 40)).astype(np.uint32)
        return cls(np.array(start), hashed, (gate << 1 | np.array(bit, np.int64)).astype(np.int16), kind * SLOTS // 2)

    def bits(self, symbol: np.ndarray, row: np.ndarray, context: np.ndarray) -> Bits:
        """The bits of symbols, in order, in contexts hashed to 32 bits (symbols x contexts)."""
        start = self.start[symbol]
        size = self.start[symbol + 1] - start
        first = np.cumsum(size) - size
        flat = np.repeat(start - first, size)
        flat += np.arange(len(flat))
        way = self.way.take(flat)
        slots, node = np.repeat(context, size, axis=0), self.node.take(flat)
        for i in range(slots.shape[1]):
            slots[:, i] ^= node
        slots *= np.uint32(0x9E3779B1)
        slots >>= np.uint32(33 - SLOT_BITS)
        if self.offset:
            slots += np.uint32(self.offset)
        return Bits(np.repeat(row, size), (way & 1).astype(np.int8), way >> 1, np.append(first, len(flat)), slots)


@dataclass(frozen=True)
class Bits:
    """Of every bit: row, value, gate and slots or stretched chances (times STEP; bits x inputs); and where each symbol's bits start."""

    row: np.ndarray
    value: np.ndarray
    gate: np.ndarray
    first: np.ndarray
    slots: np.ndarray | None = None
    x: np.ndarray | None = None

    def part(self, a: int, b: int) -> Bits:
        """Of symbols of one bit each."""
        return Bits(self.row[a:b], self.value[a:b], self.gate[a:b], self.first[a : b + 1] - self.first[a], x=self.x[a:b])


@dataclass(frozen=True)
class Tokens:
    """Every row's words and then its end: row, place in the row, symbol, hash, where in data, and whether a word with a code; first: where rows start."""

    row: np.ndarray
    place: np.ndarray
    symbol: np.ndarray
    hash: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    near: np.ndarray
    known: np.ndarray
    first: np.ndarray
    data: np.ndarray
    bytes: np.ndarray  # of every row

    def only(self, rows: np.ndarray) -> Tokens:
        """Of some rows."""
        mine = rows[self.row]
        row, *others = (x[mine] for x in (self.row, self.place, self.symbol, self.hash, self.starts, self.ends, self.near, self.known))
        first = np.append(0, np.cumsum(np.diff(self.first)[rows]))
        return Tokens((np.cumsum(rows) - 1)[row], *others, first, self.data, self.bytes[rows])


@dataclass(frozen=True)
class Found:
    """What the corpus says of tokens: occurrences of the long context, and of the token in it, in other documents."""

    all: np.ndarray
    same: np.ndarray

    def part(self, a: int, b: int) -> Found:
        return Found(self.all[a:b], self.same[a:b])

    def only(self, tokens: np.ndarray) -> Found:
        return Found(self.all[tokens], self.same[tokens])


def _hashed(*x: np.ndarray) -> np.ndarray:
    return np.stack([mix(c).astype(np.uint32) for c in x], axis=1)


class Sought:
    """Where hashes are in a sorted table: by a first and a second place of few bits, by search where both hold others."""

    BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.places = np.full((2, 1 << self.BITS), -1, np.int32)
        left = np.arange(len(hashes))
        for k in range(2):
            self.places[k, self.at(hashes[left], k)] = left
            left = left[self.places[k, self.at(hashes[left], k)] != left]
        self.left = left

    def at(self, x: np.ndarray, k: int) -> np.ndarray:
        return x.view(U) >> U(64 - self.BITS) if k == 0 else x.view(U) & U((1 << self.BITS) - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The place of each of x, -1 if none."""
        if not len(self.hashes):
            return np.full(len(x), -1)
        near = self.places[0].take(self.at(x, 0).view(np.int64))
        other = np.flatnonzero(self.hashes.take(near) != x)  # -1 takes the last
        again = self.places[1].take(self.at(x[other], 1).view(np.int64))
        wrong = self.hashes.take(again) != x[other]
        if len(self.left):
            some = np.flatnonzero(wrong)
            found = self.left[np.minimum(np.searchsorted(self.hashes[self.left], x[other[some]]), len(self.left) - 1)]
            right = self.hashes[found] == x[other[some]]
            again[some[right]], wrong[some[right]] = found[right], False
        near[other] = np.where(wrong, -1, again)
        near[near < 0] = np.where(x[near < 0] == self.hashes[-1], len(self.hashes) - 1, -1)
        return near.astype(np.int64)


@dataclass(frozen=True)
class Coder:
    """Codes of the TOP words (sorted hashes, their rank by count and count) and of bytes."""

    hashes: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray
    word_tree: Tree
    byte_tree: Tree
    _sought: list[Sought] = field(default_factory=list, compare=False)

    def near(self, hash_: np.ndarray) -> np.ndarray:
        if not self._sought:
            self._sought.append(Sought(self.hashes))
        return self._sought[0](hash_)

    @property
    def escape(self) -> int:
        return len(self.hashes)

    def tokens(self, column: pa.Array) -> Tokens:
        data, offsets = raw(column)
        data = LOWER[data]
        starts, ends, row = words(data, offsets)
        n = len(offsets) - 1
        hash_ = Hasher(data)(starts, ends).view(np.int64)
        size = np.bincount(row, minlength=n) + 1
        first = np.append(0, np.cumsum(size))
        last = first[1:] - 1
        inner = np.ones(int(size.sum()), bool)
        inner[last] = False
        out = []
        for values, end in ((row, np.arange(n)), (hash_, END_HASH), (starts, 0), (ends, 0)):
            a = np.zeros(len(inner), np.int64)
            a[inner], a[last] = values, end
            out.append(a)
        row, hash_, starts, ends = out
        near = self.near(hash_)
        known = near >= 0
        symbol = np.append(self.ranks, self.escape).take(near)
        symbol[last] = self.escape + 1
        return Tokens(row, np.arange(len(row)) - first[row], symbol, hash_, starts, ends, near, known, first, data, np.diff(offsets))

    def contexts(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Of every token: the contexts of its path, and the last very frequent word."""
        n = len(t.row)
        one, two = np.full((2, n), self.escape + 2, np.int64)
        one[1:] = np.where(t.place[1:] > 0, t.symbol[:-1], self.escape + 2)
        two[2:] = np.where(t.place[2:] > 1, t.symbol[:-2], self.escape + 2)
        at = np.maximum.accumulate(np.where(one < COMMON, np.arange(n), np.arange(n) - t.place))
        common = np.where(one[at] < COMMON, one[at], COMMON)
        pair = np.minimum(one, FREQUENT[1]).astype(U) << U(20) ^ np.minimum(two, FREQUENT[1]).astype(U)
        return _hashed(np.zeros(n, U), common.astype(U) + U(1 << 32), np.minimum(one, FREQUENT[0]).astype(U) + U(2 << 32), pair + U(3 << 48)), common

    def spelled(self, t: Tokens, odd: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes and ends of the words at odd, their contexts, and of which token each is."""
        size = t.ends[odd] - t.starts[odd] + 1  # and the end of the word
        token = np.repeat(odd, size)
        within = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
        byte = np.full(len(token), 256, np.int64)
        inner = within < np.repeat(size, size) - 1
        byte[inner] = t.data[(t.starts[token] + within)[inner]]
        seen, context = np.full(len(byte), 5 << 56, U), []
        for k in range(1, INPUTS + 1):
            before = np.zeros(len(byte), U)
            before[k:] = np.where(within[k:] >= k, byte[:-k] + 1, 0)
            seen = seen << U(9) ^ before
            context.append(seen + U(k) ^ (common[token].astype(U) << U(40) if k == 1 else U(0)))
        return byte, _hashed(*context), token

    def bits(self, t: Tokens, found: Found | None = None, round_: int = 1 << 40) -> Iterator[tuple[Bits, np.ndarray]]:
        """Bits of words, of spelling and of long contexts, each by round (of so many tokens of each row) and row, with where rounds start.

        Tokens found in their long context have no other bits.
        """
        for row, round_of, of in self.symbols(t, found, round_):
            bits = of(0, len(row))
            yield bits, bits.first[np.searchsorted(round_of, np.arange(int(t.place.max(initial=0)) // round_ + 2))]

    def symbols(self, t: Tokens, found: Found | None, round_: int) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[int, int], Bits]]]:
        """Of words, of spelling and of long contexts: every symbol's row and round, in order of round and row, and a function that gives the bits of a range of them."""
        context, common = self.contexts(t)
        left = np.ones(len(t.row), bool) if found is None else found.same == 0
        part = t.place // round_
        order = np.argsort(part, kind="stable") if part.any() else np.arange(len(part))
        coded = order[left[order]]
        row, symbol, near = t.row[coded], t.symbol[coded], context.take(coded, axis=0)
        yield row, part[coded], lambda a, b: self.word_tree.bits(symbol[a:b], row[a:b], near[a:b])
        byte, spelling, token = self.spelled(t, coded[symbol == self.escape], common)
        row = t.row[token]
        yield row, part[token], lambda a, b: self.byte_tree.bits(byte[a:b], row[a:b], spelling[a:b])
        if found is not None:
            at = order[found.all[order] > 0]
            every = flags(t, found, at)
            yield every.row, part[at], every.part

    def pieces(self, t: Tokens, found: Found, round_: int) -> Iterator[tuple[int, Bits, bool]]:
        """(kind, bits, whether another round follows): whole rows of a round, of about MIXED bits or one row."""
        for kind, (row, part, of) in enumerate(self.symbols(t, found, round_)):
            head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1]))[: len(row)])
            head, rounds, i = np.append(head, len(row)), np.append(part[head], -1), 0
            limit = MIXED // (1 if kind == 2 else 12 if kind == 0 else 6)  # symbols
            while i < len(head) - 1:
                end = int(np.searchsorted(part, rounds[i], "right"))
                j = max(i + 1, int(np.searchsorted(head, min(head[i] + limit, end), "right")) - 1)
                yield kind, of(head[i], head[j]), end < len(row)
                i = j


def flags(t: Tokens, found: Found, at: np.ndarray) -> Bits:
    """The bits of the tokens at `at`, whose long contexts occur: whether the token is one of those that followed.

    Predicted from how the last 16 and the last 4 of these bits of the row were, and a constant.
    """
    place = np.sort(at)
    value = (found.same[place] > 0).astype(np.int64)
    row = t.row[place]
    since = np.arange(len(place)) - np.searchsorted(row, row)  # bits of the row before
    total = np.append(0, np.cumsum(value))
    x = [np.full(len(place), float(STEP), np.float32)]
    for k in (16, 4):
        n = np.minimum(since, k)
        ones = total[np.arange(len(place))] - total[np.arange(len(place)) - n]
        x.append((np.log((ones + 0.4) / (n - ones + 0.4)) * STEP).astype(np.float32))
    many = np.log2(found.all[place])
    x.append((many / 4 * STEP).astype(np.float32))
    last = np.where(since > 0, 1 + value[np.arange(len(place)) - 1], 0) if len(place) else value
    gate = 2 * DEPTHS + np.minimum(many.astype(np.int64), 7) * 3 + last
    by = np.searchsorted(place, at)
    return Bits(row[by], value.astype(np.int8)[by], gate[by], np.arange(len(at) + 1), x=np.stack(x, axis=1)[by])


@dataclass(frozen=True)
class Mixer:
    """Stretched chances of slots, weights by gate, and the adaptive map by kind."""

    slots: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.full((KINDS * DEPTHS, INPUTS), 0.3, np.float32))
    map: np.ndarray = field(default_factory=lambda: np.tile(np.linspace(-8, 8, BUCKETS, dtype=np.float32), (KINDS, 1)))

    def inputs(self, bits: Bits, a: int = 0, b: int | None = None) -> np.ndarray:
        """In steps of 1/STEP."""
        return bits.x[a:b] if bits.x is not None else self.slots.take(bits.slots[a:b], mode="wrap").astype(np.float32)

    def tables(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """For a sum in steps of 1/FINE, and for bits 0 and then 1: the loss after refining, and the error before."""
        x = (np.arange(2 * LIMIT * FINE + 1) / FINE - LIMIT).astype(np.float64)
        y = (x + np.interp(x, np.linspace(-8, 8, BUCKETS), self.map[kind])) / 2
        p = 1 / (1 + np.exp(-x))
        return np.concatenate([np.logaddexp(0, y), np.logaddexp(0, -y)]).astype(np.float32), np.concatenate([-p, 1 - p]).astype(np.float32)

    def scores(self, coder: Coder, t: Tokens, found: Found) -> np.ndarray:
        """The natural logarithm of the probability of every row."""
        rows = len(t.first) - 1
        hit = found.same > 0
        total = np.bincount(t.row[hit], np.log(found.same[hit] / found.all[hit]), rows).astype(np.float64)
        now = -1
        for kind, bits, more in coder.pieces(t, found, ROUND):
            if kind != now:
                now, (losses, errors) = kind, self.tables(kind)
                own = np.zeros((rows, INPUTS), np.float32)  # what documents have learned
                shared = self.weights[kind * DEPTHS : (kind + 1) * DEPTHS]  # gates x inputs
            row = bits.row
            head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            which = np.repeat(np.arange(len(head)) * DEPTHS - kind * DEPTHS, np.diff(np.append(head, len(row))))
            which += bits.gate
            x = self.inputs(bits)
            weights = ((own[row[head], None] + shared) * np.float32(FINE / STEP)).reshape(-1, INPUTS).take(which, axis=0)
            weights *= x
            dot = weights[:, 0] + weights[:, 1]
            dot += weights[:, 2]
            dot += weights[:, 3]
            dot += np.float32(LIMIT * FINE + 0.5)
            at = np.clip(dot, 0, 2 * LIMIT * FINE, out=dot).astype(np.intp)
            at += np.multiply(bits.value, 2 * LIMIT * FINE + 1, dtype=np.intp)
            total[row[head]] -= np.add.reduceat(losses.take(at), head, dtype=np.float64)
            if more:
                error = errors.take(at)
                for i in range(INPUTS):
                    own[row[head], i] += np.float32(RATE / STEP) * np.add.reduceat(error * x[:, i], head)
        return total


def levels(stretched: np.ndarray) -> np.ndarray:
    """0 to 14 for stretched chances in steps of 1/STEP; 7 is about none."""
    return (7 + np.sign(stretched) * np.searchsorted(EDGES, np.abs(stretched.astype(np.int16)), "right")).astype(np.uint8)


def _ratios(k: int) -> np.ndarray:
    """What flags() can say of the last k bits."""
    n, ones = np.tril_indices(k + 1)
    return np.unique((np.log((ones + 0.4) / (n - ones + 0.4)) * STEP).astype(np.float32))


RATIOS = _ratios(16), _ratios(4)


def cells(bits: Bits, levels_: np.ndarray) -> np.ndarray:
    """Of every bit: gate, bit, and the levels of its inputs."""
    if bits.x is None:
        at = levels_.take(bits.slots, mode="wrap").view("<u4").ravel()
        at |= at >> np.uint32(4)
        at = (at & np.uint32(0xFF)) | (at >> np.uint32(8)) & np.uint32(0xFF00)
    else:
        many = bits.x[:, 3].astype(np.float64) * (4 / STEP)
        least = np.minimum(np.floor(many + 1e-5), 7)
        rest = np.where(least < 7, (many + 1e-5 - least) * 16, many - least)
        at = np.clip(rest, 0, 15).astype(np.int64)
        for k, shift in ((0, 8), (1, 4)):
            at |= np.minimum(np.searchsorted(RATIOS[k], bits.x[:, k + 1] - np.float32(1e-3)), len(RATIOS[k]) - 1) << shift
    out = bits.gate.astype(np.int64)
    out <<= 1
    out |= bits.value
    out <<= 16
    out |= at
    return out


def inputs_of(gate: int, at: np.ndarray) -> np.ndarray:
    """What stands for the inputs of a gate's cells (the bit left out)."""
    if gate < 2 * DEPTHS:
        signed = np.concatenate([-LEVELS[:0:-1], LEVELS, [0]])
        return np.stack([signed[at >> 4 * i & 15] for i in range(INPUTS)], axis=1)
    least, rest = min((gate - 2 * DEPTHS) // 3, 7), (at & 15) + 0.5
    many = least + (rest / 16 if least < 7 else rest)
    ratios = [np.append(r, np.zeros(256 - len(r))) / STEP for r in RATIOS]
    return np.stack([np.ones(len(at)), ratios[0][at >> 8], ratios[1][at >> 4 & 15], many / 4], axis=1)


def started() -> np.ndarray:
    """The weights that gates have before they are fitted."""
    start = np.full((KINDS * DEPTHS, INPUTS), 0.3)
    start[2 * DEPTHS :] = [-0.5, 0.5, 0.5, 0.0]
    return start


def likeliest(gate: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest weights of a gate for its counts (bits x cells), near those it starts with, by Newton's steps; and then the map's ones and all by bucket."""
    at = np.flatnonzero(n.any(0))
    x, zero, one = inputs_of(gate, at), n[0, at].astype(np.float64), n[1, at].astype(np.float64)
    start = w = started()[gate]

    def loss(w: np.ndarray) -> float:
        dot = x @ w
        return float(one @ np.logaddexp(0, -dot) + zero @ np.logaddexp(0, dot) + PRIOR / 2 * ((w - start) ** 2).sum())

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ ((zero + one) * p - one) + PRIOR * (w - start)
        step = np.linalg.solve((x * ((zero + one) * p * (1 - p))[:, None]).T @ x + PRIOR * np.eye(INPUTS), slope)
        while (then := loss(w - step)) > now and np.abs(step).max() > 1e-7:
            step /= 2
        if then >= now:
            break
        w, now, before = w - step, then, now
        if before - now < 1e-9 * now:
            break
    to = np.rint((np.clip(x @ w, -8, 8) + 8) * (BUCKETS - 1) / 16).astype(np.int64)
    return w, np.stack([np.bincount(to, one, BUCKETS), np.bincount(to, zero + one, BUCKETS)])


def fitted(mixer: Mixer, weights: np.ndarray, ones: np.ndarray, all_: np.ndarray) -> Mixer:
    """With the gates' weights, and the map of all their buckets (kinds x buckets)."""
    prior = 1 / (1 + np.exp(-np.tile(np.linspace(-8, 8, BUCKETS), (KINDS, 1))))
    p = (ones + 20 * prior) / (all_ + 20)
    return replace(mixer, weights=weights.astype(np.float32), map=np.log(p / (1 - p)).astype(np.float32))


@dataclass(frozen=True)
class Listed:
    """Distinct keys of a group in order of shard and key: of each the shard, the key and one token's place; and which of them each of `at` has."""

    shard: np.ndarray
    key: np.ndarray
    at: np.ndarray
    of: np.ndarray

    @classmethod
    def of_keys(cls, at: np.ndarray, shard: np.ndarray, key: np.ndarray) -> Listed:
        if shard.max(initial=0) < 1 << 64 - KEY:
            order = np.argsort(shard.astype(U) << U(KEY) | key)
        else:
            order = np.lexsort((key, shard))
        key, shard = key[order], shard[order]
        new = np.append(True, (key[1:] != key[:-1]) | (shard[1:] != shard[:-1]))[: len(key)]
        of = np.empty(len(key), np.int64)
        of[order] = np.cumsum(new) - 1
        return cls(shard[new], key[new], at, of)

    def times(self, counts: np.ndarray) -> np.ndarray:
        """How many of the tokens of each key count."""
        return np.bincount(self.of[counts], minlength=len(self.key))


def long_contexts(t: Tokens, shards: int) -> Listed:
    """The tokens with ORDER words before them by (context, token): the shard and CONTEXT bits tell the context, TAG more the token."""
    at = np.flatnonzero(t.place >= ORDER)
    h = t.hash.view(U)
    context = mix(h[at - 1] * U(0x9E3779B97F4A7C15) + h[at - 2] * U(0xD1342543DE82EF95) + h[at - 3] * U(0xA0761D6478BD642F))
    shard = ((context >> U(32)) * U(shards) >> U(32)).astype(np.int64)
    return Listed.of_keys(at, shard, (context & U((1 << CONTEXT) - 1)) << U(TAG) | mix(h[at]) >> U(64 - TAG))


def rare_words(t: Tokens, shards: int) -> Listed:
    """The words without a code by hash; KEY bits and the shard tell them apart."""
    at = np.flatnonzero(~t.known & (t.hash != END_HASH))
    h = t.hash.view(U)[at]
    return Listed.of_keys(at, ((h >> U(32)) * U(shards) >> U(32)).astype(np.int64), h & U((1 << KEY) - 1))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, of the least width that holds them all, compressed."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(planes).to_bytes(5, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    width, size = x[0], int.from_bytes(x[1:6], "little")
    out = np.zeros((size // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(memoryview(x)[6:], size, "zstd", asbytes=True), np.uint8).reshape(width, -1).T
    return out.view("<i8").ravel()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(train, text) to (kind, key, n) of training rows: 0: words and ends by hash, 1: bytes of words; 2: tokens of all rows. Added up in the task, in pieces."""
    held, byte, docs, size = [], np.zeros(257, np.int64), 0, 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[at], np.add.reduceat(n, at) if len(at) else n

    def out(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    for batch in batches:
        for block in blocks(batch, "text", 1 << 20):
            data, offsets = raw(block.column(1))
            data, train = LOWER[data], np.asarray(block.column(0))
            starts, ends, row = words(data, offsets)
            size += len(starts) + block.num_rows
            mine = train[row]
            starts, ends = starts[mine], ends[mine]
            keys, n = np.unique(Hasher(data)(starts, ends).view(np.int64), return_counts=True)
            held.append((keys, n))
            docs += int(train.sum())
            byte[:256] += np.bincount(data[np.repeat(train, np.diff(offsets))], minlength=256)
            byte[256] += len(starts)
            if sum(len(k) for k, _ in held) > 2_000_000:
                held[:] = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield out(0, *held.pop())
    byte[[9, 10, 11, 12, 13, 32]] = 0
    if held:
        yield out(0, *merged())
    if docs:
        yield out(0, np.array([END_HASH]), np.array([docs]))
        yield out(1, np.flatnonzero(byte), byte[byte > 0])
    if size:
        yield out(2, np.zeros(1, np.int64), np.array([size]))


def _grouped(limit: int):
    """(id, train, text, mix) to (mix, docs): rows in compressed groups of about limit bytes, of one half each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], []), [0, 0]

        def out(half: int) -> pa.RecordBatch:
            sink, rows = pa.BufferOutputStream(), pa.Table.from_batches(held[half])
            # by length, so that documents that are scored together end in the same rounds
            rows = rows.take(pc.sort_indices(pc.binary_length(rows.column("text")))).combine_chunks()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(rows)
            held[half].clear()
            size[half] = 0
            return pa.RecordBatch.from_arrays([pa.array([half > 0]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["mix", "docs"])

        for batch in batches:
            rows = batch.select(["id", "train", "text"])
            for half, mine in enumerate((pc.invert(batch.column(3)), batch.column(3))):
                for block in blocks(rows.filter(mine), "text", limit):
                    held[half].append(block)
                    size[half] += block.nbytes
                    if size[half] >= limit:
                        yield out(half)
        for half in (0, 1):
            if held[half]:
                yield out(half)

    return run


def _opened(docs: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(docs.as_buffer()).read_all().combine_chunks().to_batches()[0]


def _slot_counts(shared):
    """(mix, docs) to (run, mix, counts): how often each slot's bit was 0 and 1, for the task, in runs of slots, apart for each half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, n, held = shared.value, np.zeros(2 * SLOTS, np.uint32), ([], [])

        def add(kind: int) -> None:
            """Equal symbols in equal contexts come to the slots once, with their number."""
            parts = list(zip(*held[kind], strict=True))
            held[kind].clear()
            for keys in parts:
                keys = np.sort(np.concatenate(keys))
                at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
                times = np.diff(at, append=len(keys)).astype(np.uint32)
                for k in range(0, len(at), PIECE):
                    some = keys[at[k : k + PIECE]]
                    bits = (coder.word_tree, coder.byte_tree)[kind].bits((some & U((1 << 20) - 1)).astype(np.int64), times[k : k + PIECE], (some >> U(20)).astype(np.uint32)[:, None])
                    np.add.at(n, bits.slots[:, 0] + bits.value.astype(np.uint32) * np.uint32(SLOTS), bits.row)

        def out(mix_: bool) -> Iterator[pa.RecordBatch]:
            add(0), add(1)
            zero, one = n[:SLOTS].reshape(-1, RUN), n[SLOTS:].reshape(-1, RUN)
            used = np.flatnonzero(zero.any(1) | one.any(1))
            for k in range(0, len(used), 64):
                some = used[k : k + 64]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([mix_] * len(some)), pa.array([_packed(np.concatenate([zero[i], one[i]])) for i in some], pa.binary())], names=["run", "mix", "counts"])
            n[:] = 0

        now = None
        for batch in batches:
            kinds = np.asarray(batch.column(0).to_pylist(), bool)
            for i in np.argsort(kinds != bool(now), kind="stable"):  # one kind after the other, so one sum is held
                if kinds[i] != now:
                    if now is not None:
                        yield from out(now)
                    now = bool(kinds[i])
                group = _opened(batch.column(1)[int(i)])
                group = group.filter(group.column(1))
                for block in blocks(group, "text", BLOCK // 2):
                    t = coder.tokens(block.column(2))
                    context, common = coder.contexts(t)
                    byte, spelling, _ = coder.spelled(t, np.flatnonzero(t.symbol == coder.escape), common)
                    for kind, symbol, some in ((0, t.symbol, context), (1, byte, spelling)):
                        held[kind].append([c.astype(U) << U(20) | symbol.astype(U) for c in some.T])
                        if sum(len(x[0]) for x in held[kind]) > DEALT:
                            add(kind)
        if now is not None:
            yield from out(now)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by run to (run, first, second, all): levels of the sums of each half, and the stretched chances of both."""
    run, total = None, None

    def stretched(n: np.ndarray) -> np.ndarray:
        return np.rint(np.clip(np.log((n[RUN:] + 0.4) / (n[:RUN] + 0.4)), -12, 12) * STEP).astype(np.int8)

    def out() -> pa.RecordBatch:
        values = (levels(stretched(total[0])), levels(stretched(total[1])), stretched(total[0] + total[1]))
        return pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in values)], names=["run", "first", "second", "all"])

    for batch in batches:
        for at, mix_, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if at != run:
                if run is not None:
                    yield out()
                run, total = at, np.zeros((2, 2 * RUN), np.int64)
            total[int(mix_)] += _unpacked(counts.as_py())
    if run is not None:
        yield out()


def _asked(shared, shards: int):
    """(group, docs) to (shard, group, contexts, context_n, words, word_n): distinct keys of the group and how often training rows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value

        def asked(group: int, docs: pa.Scalar) -> tuple[np.ndarray, list[list[bytes]]]:
            rows = _opened(docs)
            t = coder.tokens(rows.column(2))
            counts = np.asarray(rows.column(1))[t.row]
            a, b = long_contexts(t, shards), rare_words(t, shards)
            n, m = a.times(counts[a.at]), b.times(counts[b.at])
            there = np.union1d(a.shard, b.shard)
            cuts = [(np.searchsorted(x.shard, there), np.searchsorted(x.shard, there, "right")) for x in (a, b)]
            out = [[], [], [], []]
            for i, j, k, l in zip(*cuts[0], *cuts[1], strict=True):
                for column, value in zip(out, (_packed(np.diff(a.key[i:j], prepend=U(0))), _packed(n[i:j]), _packed(np.diff(b.key[k:l], prepend=U(0))), _packed(m[k:l])), strict=True):
                    column.append(value)
            return there, out

        for batch in batches:
            for group, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                there, out = asked(group, docs)
                for k in range(0, len(there), 1024):
                    s = slice(k, k + 1024)
                    yield pa.RecordBatch.from_arrays([pa.array(there[s]), pa.array(np.full(len(there[s]), group)), *(pa.array(x[s], pa.binary()) for x in out)], names=["shard", "group", "contexts", "context_n", "words", "word_n"])

    return run


def _totals(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For every key, the sum of n over equal keys."""
    order = np.argsort(keys)
    at = np.flatnonzero(np.append(True, keys[order[1:]] != keys[order[:-1]])[: len(keys)])
    out = np.empty(len(keys), np.int64)
    if len(keys):
        out[order] = np.repeat(np.add.reduceat(n[order], at), np.diff(at, append=len(keys)))
    return out


def _keys(x: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(x)).astype(U)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard to (group, shard, said): for each key of the group, occurrences of the pair, of the context, and of the word in all groups."""
    shard, held = None, []

    def out() -> pa.RecordBatch:
        keys, n, rare, m = ([f(row[i]) for row in held] for i, f in enumerate((_keys, _unpacked, _keys, _unpacked), 1))
        many = [np.cumsum([len(x) for x in some])[:-1] for some in (keys, rare)]
        keys, n, rare, m = (np.concatenate(x) for x in (keys, n, rare, m))
        said = [np.split(x, many[0]) for x in (_totals(keys, n), _totals(keys >> U(TAG), n))] + [np.split(_totals(rare, m), many[1])]
        said = [_packed(np.concatenate(x)) for x in zip(*said, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([row[0] for row in held], pa.int64()), pa.array(np.full(len(held), shard)), pa.array(said, pa.binary())], names=["group", "shard", "said"])

    for batch in batches:
        for at, *row in zip(*batch.columns, strict=True):
            at, row = at.as_py(), [x.as_py() for x in row]
            if at != shard:
                if held:
                    yield out()
                shard, held = at, []
            held.append(row)
    if held:
        yield out()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, shard, mix, held) sorted by group and shard to (group, mix, docs, said): a group's documents (no shard) and what the shards say of it."""
    first, said = None, []

    def out() -> pa.RecordBatch:
        group, mix_, docs = first
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([mix_]), pa.array([docs], pa.binary()), pa.array([said], pa.list_(pa.binary()))], names=["group", "mix", "docs", "said"])

    for batch in batches:
        for group, mix_, held in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if mix_ is None:
                said.append(held.as_py())
                continue
            if first:
                yield out()
            first, said = (group, mix_, held.as_py()), []
    if first:
        yield out()


def found(t: Tokens, train: np.ndarray, said: list[bytes], shards: int) -> tuple[Found, np.ndarray, np.ndarray]:
    """What the shards said of a group's tokens, without the own occurrences of training rows; and which tokens are rare words and how often training rows have these."""
    a, b = long_contexts(t, shards), rare_words(t, shards)
    there = np.union1d(a.shard, b.shard)
    x = np.searchsorted(a.shard, there, "right") - np.searchsorted(a.shard, there)
    y = np.searchsorted(b.shard, there, "right") - np.searchsorted(b.shard, there)
    same, all_, often = [], [], []
    for part, i, j in zip(said, x, y, strict=True):
        part = _unpacked(part)
        same.append(part[:i]), all_.append(part[i : 2 * i]), often.append(part[2 * i : 2 * i + j])
    none = np.zeros(0, np.int64)
    same, all_, often = (np.concatenate([none, *x]) for x in (same, all_, often))
    out = np.zeros((2, len(t.row)), np.int64)
    out[0, a.at], out[1, a.at] = all_[a.of], same[a.of]
    mine = np.flatnonzero((out[0, a.at] > 0) & train[t.row[a.at]])
    if len(mine):
        context = np.append(0, np.cumsum((a.shard[1:] != a.shard[:-1]) | (a.key[1:] >> U(TAG) != a.key[:-1] >> U(TAG))))
        at = a.at[mine]
        keys = t.row[at].astype(U) << U(32) | a.of[mine].astype(U)
        order = np.argsort(keys)
        keys, at = keys[order], at[order]
        for k, own in ((0, keys >> U(32) << U(32) | context[keys & U((1 << 32) - 1)].astype(U)), (1, keys)):  # keys lie by context, too
            new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            times = np.diff(new, append=len(own))
            out[k, at] -= np.repeat(times, times)
    return Found(out[0], out[1]), b.at, often[b.of]


@dataclass(frozen=True)
class LanguageModel:
    coder: Coder
    mixer: Mixer
    train_tokens: int
    distinct: int
    ends: int
    shards: int
    groups: DataFrame  # of the documents: mix (which half), docs, said
    kind: str
    scratch: Scratch


def learned(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """A model of the rows of docs where train is true (none given: of all): exact word counts, slot counts, long contexts and weights.

    The other rows are there to be scored. Null texts are empty, null in train is false.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.lit(True) if train is None else train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = scratch.put(rows.select("train", "text").mapInArrow(_counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    vocabulary = counts.where("kind = 0").select("key", "n")
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = vocabulary.where((F.col("key") != END_HASH) & (F.col("n") >= LEAST)).orderBy(F.desc("n"), "key").limit(TOP).collect()
    ends = vocabulary.where(F.col("key") == END_HASH).collect()
    byte, size = np.ones(257, np.int64), 0
    for row in counts.where("kind > 0").collect():  # 258 at most
        if row.kind == 1:
            byte[row.key] += row.n
        else:
            size = row.n
    scratch.drop("counts")
    hashes, times = np.array([r.key for r in top], np.int64), np.array([r.n for r in top], np.int64)
    end = ends[0].n if ends else 0
    tree = Tree.of(np.concatenate([times, [max(n - int(times.sum()) - end, 1), max(end, 1)]]), 0)
    order = np.argsort(hashes)
    coder = Coder(hashes[order], order, times[order], tree, Tree.of(byte, 1))
    shared = spark.sparkContext.broadcast(coder)

    limit = min(max(size // 50, GROUP[0]), GROUP[1])
    # halves are told by a hash, and all that is learned is a sum, so nothing depends on how the input is cut
    halves = rows.withColumn("mix", F.pmod(F.xxhash64("id", "text"), F.lit(2)) == 1)
    groups = halves.mapInArrow(_grouped(limit), "mix boolean, docs binary").select(F.monotonically_increasing_id().alias("group"), "docs", "mix")
    groups = scratch.put(groups, "groups", "mix")

    shards = max(LEAST_SHARDS, int(size) // SHARD)
    asked = groups.select("group", "docs").mapInArrow(_asked(shared, shards), "shard long, group long, contexts binary, context_n binary, words binary, word_n binary")
    said = asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(_answered, "group long, shard long, said binary")
    said = scratch.put(said, "said")
    del asked
    scratch.free()

    slots = groups.where("not mix").unionByName(groups.where("mix")).select("mix", "docs").mapInArrow(_slot_counts(shared), "run long, mix boolean, counts binary")
    slots = slots.repartition("run").sortWithinPartitions("run").mapInArrow(_summed, "run long, first binary, second binary, all binary")
    half, stretched = np.full((2, SLOTS // RUN, RUN), 7, np.uint8), np.zeros((SLOTS // RUN, RUN), np.int8)
    for row in slots.collect():  # 3 * SLOTS numbers at most
        half[:, row.run] = np.frombuffer(row.first, np.uint8), np.frombuffer(row.second, np.uint8)
        stretched[row.run] = np.frombuffer(row["all"], np.int8)
    del slots
    scratch.free()

    both = groups.select("group", F.lit(-1).cast("long").alias("shard"), "mix", F.col("docs").alias("held"))
    both = both.unionByName(said.select("group", "shard", F.lit(None).cast("boolean").alias("mix"), F.col("said").alias("held")))
    both = both.repartition("group").sortWithinPartitions("group", "shard")
    groups = scratch.put(both.mapInArrow(_met, "group long, mix boolean, docs binary, said array<binary>"), "met")
    scratch.drop("groups"), scratch.drop("said")
    del both, said
    scratch.free()

    mixer, weights = Mixer(stretched.ravel()), started()
    sent = spark.sparkContext.broadcast((coder, half.reshape(2, -1)))
    fit = groups.select("mix", "docs", "said").mapInArrow(_fit(sent, shards), "gate int, counts binary")
    fit = fit.repartition("gate").sortWithinPartitions("gate").mapInArrow(_solved, "gate int, weights array<double>, ones array<double>, all array<double>")
    ones, all_ = np.zeros((2, KINDS, BUCKETS))
    for row in sorted(fit.collect()):  # one of each gate
        weights[row.gate] = row.weights
        ones[row.gate // DEPTHS] += row.ones
        all_[row.gate // DEPTHS] += row["all"]
    sent.destroy()
    return LanguageModel(coder, fitted(mixer, weights, ones, all_), int(n), int(v), int(end), shards, groups, docs.schema[id_col].dataType.simpleString(), scratch)


def _fit(shared, shards: int):
    """(mix, docs, said) to (gate, counts): how often training documents' bits were 0 and 1 by gate and levels of inputs in the other half's slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, half = shared.value
        n, any_ = np.zeros(KINDS * DEPTHS * CELLS, np.uint32), False

        def add(mix_: bool, docs: pa.Scalar, said: list[bytes]) -> None:
            rows = _opened(docs)
            t = coder.tokens(rows.column(2))
            train = np.asarray(rows.column(1))
            seen = found(t, train, said, shards)[0]
            if not train.all():
                t, seen = t.only(train), seen.only(train[t.row])
            for _, bits, _ in coder.pieces(t, seen, MIXED // 4):
                np.add.at(n, cells(bits, half[0 if mix_ else 1]), np.uint32(1))

        for batch in batches:
            for mix_, docs, said in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                add(mix_, docs, said.as_py())
                any_ = True
        if any_:
            for gate, counts in enumerate(n.reshape(KINDS * DEPTHS, CELLS)):
                if counts.any():
                    yield pa.RecordBatch.from_arrays([pa.array([gate], pa.int32()), pa.array([_packed(counts)], pa.binary())], names=["gate", "counts"])

    return run


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gate to (gate, weights, ones, all) for the sums of the gate's counts."""
    gate, total = None, None

    def out() -> pa.RecordBatch:
        weights, buckets = likeliest(gate, total.reshape(2, -1))
        return pa.RecordBatch.from_arrays([pa.array([gate], pa.int32()), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (weights, *buckets))], names=["gate", "weights", "ones", "all"])

    for batch in batches:
        for at, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if at != gate:
                if gate is not None:
                    yield out()
                gate, total = at, np.zeros(CELLS, np.int64)
            total += _unpacked(counts.as_py())
    if gate is not None:
        yield out()


def scored(model: LanguageModel, id_col: str = "doc_id") -> DataFrame:
    """Per row of the model's documents: id_col, n_tokens, n_known, base_score, score (log10), bits_per_byte.

    Null and empty texts are one end. Rows that repeat are scored as often as they come, also with null ids;
    to a training row its copies are other documents.
    """
    shared = model.groups.sparkSession.sparkContext.broadcast((model.coder, model.mixer))
    shards, ends = model.shards, model.ends
    all_ = np.log10(model.train_tokens + model.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, mixer = shared.value

        def scores(docs: pa.Scalar, said: list[bytes]) -> pa.RecordBatch:
            rows = _opened(docs)
            t = coder.tokens(rows.column(2))
            n = rows.num_rows
            seen, rare, often = found(t, np.asarray(rows.column(1)), said, shards)
            times = np.zeros(len(t.row), np.int64)
            times[t.known] = coder.counts[t.near[t.known]]
            times[t.first[1:] - 1] = ends
            times[rare] = often
            base = np.bincount(t.row, np.log10(times + 1) - all_, n)
            known = np.bincount(t.row, times > 0, n).astype(np.int64)
            del times, rare, often
            score = mixer.scores(coder, t, seen)
            values = [rows.column(0), pa.array(np.diff(t.first)), pa.array(known), pa.array(base), pa.array(score / np.log(10)), pa.array(-score / np.log(2) / np.maximum(t.bytes, 1))]
            return pa.RecordBatch.from_arrays(values, names=["id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

        for batch in batches:
            for docs, said in zip(batch.column(0), batch.column(1), strict=True):
                yield scores(docs, said.as_py())

    shape = f"id {model.kind}, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    out = model.scratch.put(model.groups.select("docs", "said").mapInArrow(run, shape), "rows")
    model.scratch.drop("met")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(id_col, 7) == 2, F.lit(False))


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    model = learned(table(spark, sf_dir, "documents", "doc_id", "text"), ~held_out())
    return scored(model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
