"""Byte-level BPE: exact merges in linear time from an Aho-Corasick automaton and backtracking.

Bytes are mapped one to one onto Latin-1 characters so that the automaton can hold them. For every
start in a piece the automaton gives the longest vocabulary entry. The encoder takes these greedily;
an entry may follow another only if the two, merged together alone, stay those two (memoised). Where
none fits it falls back to the next shorter prefix, and after the last of those it gives up the
previous token. Positions found to be dead ends are marked, so that no position is tried twice.

Edge cases: null and empty texts have no ids; very long pieces cost time in proportion to their
length; of merges with equal ranks the left one comes first; repeated rows and repeated doc_ids give a row each,
a null doc_id stays null; columns other than doc_id and text are not used, so clashing names do no harm; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session

#: Pieces in one generation of a worker's memory; it holds two.
PIECES = 150_000
#: Adjacent pairs whose compatibility a worker remembers.
PAIRS = 300_000
NO_RANK = 1 << 31
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by rank from a file of base64 and rank lines."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces(dict):
    """Piece (str) to its ids, packed as little-endian 32-bit integers; filled on demand, in two generations."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = pack_ids(self.encoder.encode_piece(piece.encode()))
        if len(piece) <= 64:
            if len(self) >= PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.lengths = [len(t) for t in tokens]
        self.pairs: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.split: list[tuple[int, int] | None | bool] = [False] * len(tokens)
        self.pieces = Pieces(self)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two entries whose merge makes this one; (-1, -1) for a single byte, None if merging its bytes doesn't make it."""
        known = self.split[token]
        if known is False:
            t = self.tokens[token]
            parts = [t[i : i + 1] for i in range(len(t))]
            while len(parts) > 2:
                ranks = [self.rank.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
                best = min(ranks)
                if best == NO_RANK:
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = (-1, -1) if len(parts) == 1 else (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
            self.split[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether two entries side by side, merged alone, stay as they are.

        Time runs backwards: the entry that came last is taken apart, and what then touches at the seam must
        not merge before the part is merged again. Of equal merges the left one comes first.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            tokens, rank, lengths = self.tokens, self.rank, self.lengths
            x, y, limit = left, right, NO_RANK
            while True:
                known = rank.get(tokens[x] + tokens[y], NO_RANK) >= limit
                first, second = x if lengths[x] > 1 else -1, y if lengths[y] > 1 else -1
                if not known or first == second == -1:
                    break
                if first > second:
                    limit, x = x, self.halves(x)[1]
                else:
                    limit, y = y + 1, self.halves(y)[0]
            self.pairs[key] = known
        return known

    def next_shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of this one, or -1."""
        if token not in self.shorter:
            t = self.tokens[token]
            self.shorter[token] = next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1)
        return self.shorter[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        if piece in self.rank:
            return [self.rank[piece]]
        size = len(piece)
        longest = [-1] * size
        lengths, pairs, split = self.lengths, self.pairs, self.split
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # ends only grow
        dead = bytearray(size + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            last = ids[-1] if ids else -1
            while token >= 0:
                end = at + lengths[token]
                if not dead[end] and (split[token] or self.halves(token)):
                    fits = last < 0 or pairs.get(last << 32 | token)
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = self.next_shorter(token)
            if token >= 0:
                ids.append(token)
                at = end
                token = longest[at] if at < size else -1
            elif ids:
                dead[at] = 1
                ids.pop()
                at -= lengths[last]
                token = self.next_shorter(last)
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return ids

    def encode(self, text: str) -> bytes:
        """Packed ids of a text, every match of the pattern encoded separately."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def digest_of(tokens: list[bytes]) -> str:
    """What tells one vocabulary from another, whatever its path."""
    found = hashlib.sha256()
    for t in tokens:
        found.update(len(t).to_bytes(4, "little") + t)
    return found.hexdigest()


def encoder_for(tokens: list[bytes], vocabulary: str, pattern: str) -> Encoder:
    """One automaton per Python worker, kept across its tasks; vocabulary: the digest of the tokens."""
    key = vocabulary, pattern
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokens, pattern)
    return _encoders[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again: one row per document with counts and digests.

    vocabulary: path of the rank file on the driver; its entries (about 1 MB) are broadcast.
    with_ids: also return the ids themselves (array<int>).
    """
    spark = session(docs.sparkSession)
    ranks = read_ranks(vocabulary)
    shared, digest = spark.sparkContext.broadcast(ranks), digest_of(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value, digest, pattern)
        for batch in batches:
            out: list[list] = [[], [], []]
            ids = []
            for text in batch.column(1).to_pylist():
                packed = encoder.encode(text or "")
                out[0].append(len(packed) // 4)
                out[1].append(hashlib.sha256(packed).hexdigest())
                out[2].append(hashlib.sha256(encoder.decode(packed)).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(packed, dtype="<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
