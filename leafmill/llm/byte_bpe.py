"""Byte-level BPE encoding and decoding over an Aho-Corasick automaton."""
from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import free_name, ship

#: Entries a worker's memo may hold before it starts anew; a memo, not a limit on the input.
MEMO = 150_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank a line."""
    out = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


ADDED = ("n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


class BacktrackingEncoder:
    """Exact BPE of one pre-split piece in linear time.

    Bytes stand as Latin-1 characters in the automaton, which gives the longest token that
    starts at a place. The search takes the longest token (or the longest that this one
    begins with, and so on) whose pair with the token before it is *compatible*: merging the
    two tokens' bytes gives just these two again. A place from which no token leads on is marked and never tried again (the
    encoding of a prefix is unique, so it would fail again); so each place is left at most
    once. Pair answers are memoised. A sequence whose adjacent pairs are all compatible is
    what the merges give.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.length = {r: len(t) for t, r in ranks.items()}
        self.widest = max(map(len, ranks), default=1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        # of each token, the longest other token that it begins with; -1: none
        self.shorter = {r: next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), -1) for t, r in ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        """The merges step by step: quadratic, used on pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 4 * MEMO:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length = len(piece), self.length
        chars = piece.decode("latin-1")
        # longest matches all along: where no pair clashes, nothing is left to take back
        longest = [rank for _, rank in self.automaton.iter_long(chars)]
        left = -1
        for rank in longest:
            if left >= 0 and not self.compatible(left, rank):
                break
            left = rank
        else:
            return longest
        out: list[int] = []
        blocked = bytearray(n + 1)
        at, rank = 0, longest[0]
        while True:
            while rank >= 0 and (blocked[at + length[rank]] or (out and not self.compatible(out[-1], rank))):
                rank = self.shorter[rank]
            if rank >= 0:
                out.append(rank)
                at += length[rank]
                if at == n:
                    return out
                rank = next(self.automaton.iter_long(chars[at : at + self.widest]))[1]
            elif out:
                blocked[at] = 1
                back = out.pop()
                at -= length[back]
                rank = self.shorter[back]
            else:
                raise ValueError("these ranks give no encoding with compatible pairs")


class PieceMemo(dict):
    """Packed ids of the pieces seen lately, in two generations of at most ``MEMO`` entries each."""

    def __init__(self, encoder: BacktrackingEncoder):
        super().__init__()
        self.encoder = encoder
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = self.encoder.encode(piece.encode("utf-8", "surrogatepass"))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def _codec(data: bytes, pattern: str):
    import regex

    encoder = BacktrackingEncoder(read_ranks(data))
    return encoder, regex.compile(pattern), PieceMemo(encoder)


def encode_bytes(text: str, data: bytes, pattern: str) -> bytes:
    """Ids of one text as little-endian unsigned 32-bit integers."""
    encoder, split, memo = _codec(data, pattern)
    return b"".join(map(memo.__getitem__, split.findall(text)))


def decode_bytes(packed: bytes, data: bytes, pattern: str) -> bytes:
    """Bytes of packed ids."""
    encoder, _, _ = _codec(data, pattern)
    token = encoder.token
    return b"".join([token[i] for i in memoryview(packed).cast("I")])


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Adds ``ids``: token ids as packed little-endian unsigned 32-bit integers (binary).

    Null texts count as empty and give no ids. Repeated rows stay. No shuffle; the rank file
    (about a megabyte, read once by the driver) is broadcast.
    """
    shipped = ship(docs.sparkSession).sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        data = shipped.value
        for part in parts:
            yield pd.Series([encode_bytes(t or "", data, pattern) for t in part], dtype=object)

    return docs.withColumn(ids, run.asNondeterministic()(F.col(text)))


def decode_documents(encoded: DataFrame, ranks: bytes, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that packed ids stand for; null ids give no bytes."""
    shipped = ship(encoded.sparkSession).sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        data = shipped.value
        for part in parts:
            yield pd.Series([decode_bytes(p or b"", data, pattern) for p in part], dtype=object)

    return encoded.withColumn(out, run.asNondeterministic()(F.col(ids)))


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``token_ids`` (packed), ``ids_sha256`` and ``decoded_sha256`` of the encoding and of its decoding.

    Encodes and decodes a text in one pass through one Python worker. Columns of the added
    names are replaced; null texts count as empty.
    """
    shipped = ship(docs.sparkSession).sparkContext.broadcast(ranks)
    packed = free_name(docs, "digests")

    @F.pandas_udf("n_tokens long, token_ids binary, ids_sha256 string, decoded_sha256 string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        data = shipped.value
        for part in parts:
            rows = []
            for t in part:
                ids = encode_bytes(t or "", data, pattern)
                rows.append((len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode_bytes(ids, data, pattern)).hexdigest()))
            yield pd.DataFrame(rows, columns=list(ADDED))

    clash = [c for c in docs.columns if c.lower() in ADDED]
    return docs.drop(*clash).withColumn(packed, run.asNondeterministic()(F.col(text))).select(
        *[c for c in docs.columns if c not in clash], f"{packed}.*"
    )


def token_digests(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """As ``round_trip``, without the ids."""
    return round_trip(docs, ranks, pattern, text).drop("token_ids")
