"""4. Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can end its encoding. A token t is it when the prefix
before t ends with a token p such that the pair (p, t) is itself encoded as (p, t). So one stored token
a prefix describes all encodings: an append goes on from the last prefix, and an edit keeps every prefix
before it and walks only from there.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .vecbytes import blocks

#: Entries that a task's caches may hold before they start anew; results do not depend on it.
CACHE = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixTable:
    """The last token of every prefix of a growing or edited run of bytes."""

    def __init__(self, bpe: BytePairs):
        self.bpe, self.data, self.last = bpe, bytearray(), [-1]

    def append(self, more: bytes) -> None:
        at = len(self.data)
        self.data += more
        self._walk(at)

    def edit(self, at: int, removed: int, inserted: bytes) -> None:
        """Replaces removed bytes at an offset; prefixes up to there stay as they are."""
        self.data[at : at + removed] = inserted
        del self.last[at + 1 :]
        self._walk(at)

    def _walk(self, at: int) -> None:
        bpe, last = self.bpe, self.last
        base = max(0, at - bpe.longest + 1)
        last += [-2] * (len(self.data) - at)
        for end, (token, size) in bpe.found(self.data[base:].decode("latin-1")):
            end += base + 1
            if end > at and last[end] == -2 and bpe.fits(last[end - size], token):
                last[end] = token
        if -2 in last[at:]:
            raise ValueError("a byte is no token")

    def tokens(self) -> list[int]:
        """The encoding of all bytes: last tokens read backwards."""
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.bpe.bytes_of[self.last[at]])
        return out[::-1]


class BytePairs:
    """Ranks, the split pattern, and what the prefix tables share: which tokens and pairs stand as they are."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.longest = max(map(len, ranks))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        #: The two tokens that a token's last merge joins; of single bytes, themselves; None if merges never make it.
        self.made_of: list[tuple[int, int] | None] = [None] * len(self.bytes_of)
        for token, rank in ranks.items():
            parts = self._merged(token, rank)
            if len(token) == 1:
                self.made_of[rank] = rank, rank
            elif len(parts) == 2:
                self.made_of[rank] = ranks[parts[0]], ranks[parts[1]]
        self._start()

    def _start(self) -> None:
        self._fits: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_fits", "_pieces", "split", "found")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._start()

    @cached_property
    def split(self):
        return regex.compile(self.pattern).findall

    @cached_property
    def found(self):
        """All tokens in a run of bytes (a character each): where each ends, the token and its size."""
        automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        automaton.make_automaton()
        return automaton.iter

    def _merged(self, data: bytes, below: int) -> list[bytes]:
        """Short bytes merged pair by pair, lowest rank first, as far as ranks are under a bound."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether token can follow before; before -1: whether it can stand first."""
        if before < 0:
            return before == -1 and self.made_of[token] is not None
        key = before << 24 | token
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > CACHE:
                self._fits.clear()
            known = self._fits[key] = self.made_of[token] is not None and self._apart(before, token)
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Undoes merges on both sides of the boundary, latest first: no merge across it may come before one that was done."""
        ranks, bytes_of, made_of, inner = self.ranks, self.bytes_of, self.made_of, 1 << 40
        while True:
            across = ranks.get(bytes_of[a] + bytes_of[b])
            if across is not None and across < inner:
                return False
            can_a, can_b = made_of[a][0] != made_of[a][1] or len(bytes_of[a]) > 1, made_of[b][0] != made_of[b][1] or len(bytes_of[b]) > 1
            if can_a and (a > b or not can_b):
                inner, a = a, made_of[a][1]
            elif can_b:
                # a merge on the right of the boundary loses a tie with one across it, which stands further left
                inner, b = b + 1, made_of[b][0]
            else:
                return True

    def piece(self, text: str) -> tuple[int, ...]:
        """One match of the pattern; a piece that is a token is that token."""
        known = self._pieces.get(text)
        if known is None:
            if len(self._pieces) > CACHE:
                self._pieces.clear()
            data = text.encode()
            if (whole := self.ranks.get(data)) is not None:
                known = (whole,)
            else:
                table = PrefixTable(self)
                table.append(data)
                known = tuple(table.tokens())
            self._pieces[text] = known
        return known

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.piece, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode_column(self, column: pa.Array) -> pa.Array:
        return pa.array([self.encode(t or "") for t in column.to_pylist()], pa.list_(pa.int32()))

    def decode_column(self, column: pa.Array) -> pa.Array:
        return pa.array([self.decode(ids or []) for ids in column.to_pylist()], pa.binary())


def public_bpe(vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> BytePairs:
    """A vocabulary of the installed public tokenizers, by file name."""
    import public_tokenizers

    return BytePairs(read_ranks(public_tokenizers.path(vocabulary)), public_tokenizers.PATTERN)


def encoded(docs: DataFrame, bpe: BytePairs, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids array<int> of every whole text. Null and empty texts: no ids; repeated rows: as often as they come."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([block.column(0), shared.value.encode_column(block.column(1))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, bpe: BytePairs, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and content binary of every row of ids. Null: empty."""
    shared = tokens.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), shared.value.decode_column(batch.column(1))], names=["id", "content"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, content binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, bpe: BytePairs, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text: id_col, n_tokens, ids_sha256, decoded_sha256.

    One pass and no shuffle; ids are digested a document at a time, so they never travel as rows.
    Null and empty texts have no tokens and the digests of nothing; a null id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        names = [str(i) for i in range(len(bpe.bytes_of))]
        for batch in batches:
            for block in blocks(batch, "text"):
                n, a, b = [], [], []
                for text in block.column(1).to_pylist():
                    ids = bpe.encode(text or "")
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_bpe())
