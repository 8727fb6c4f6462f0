"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves a whole pre-token that is itself a
token; only misses run the merge, a heap of candidate pairs over linked bytes. Results per distinct
pre-token are remembered per worker, within a bound.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; a
very long pre-token costs n log n. Repeated rows are encoded each on its own. Columns other than the
id and the text are ignored unless asked for.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

#: Distinct pre-tokens a worker remembers before it starts afresh.
MEMO_ENTRIES = 1_500_000
#: Longer pre-tokens are not remembered.
MEMO_CHARS = 64


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys on n slots, and the key itself to verify a hit."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // per_bucket)
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            groups.setdefault((h >> 40) % self.buckets, []).append((h, i))
        self.displace = [0] * self.buckets
        self.slot: list[tuple[bytes, int] | None] = [None] * n
        free = None
        for b, group in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(group) == 1:  # a lone key goes straight to any free slot
                free = free if free is not None else (i for i in range(n) if self.slot[i] is None)
                at = next(free)
                self.displace[b] = -1 - at
                self.slot[at] = (keys[group[0][1]], group[0][1])
                continue
            d = 0
            while True:
                places = [self._place(h, d) for h, _ in group]
                if len(set(places)) == len(places) and all(self.slot[p] is None for p in places):
                    break
                d += 1
            self.displace[b] = d
            for p, (_, i) in zip(places, group, strict=True):
                self.slot[p] = (keys[i], i)

    def _place(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 17) % self.n

    def get(self, key: bytes) -> int:
        """The index of the key, -1 if it is none of them."""
        h = xxhash.xxh64_intdigest(key)
        d = self.displace[(h >> 40) % self.buckets]
        found = self.slot[-1 - d if d < 0 else self._place(h, d)]
        return found[1] if found is not None and found[0] == key else -1


class Encoder(dict):
    """Maps a pre-token to its packed ids; a missing one is worked out and remembered."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.keys = list(self.ranks)
        self.whole = PerfectHash(self.keys)
        self.find = regex.compile(pattern).findall

    def __missing__(self, pre_token: str) -> bytes:
        piece = pre_token.encode()
        at = self.whole.get(piece)
        ids = [self.ranks[self.keys[at]]] if at >= 0 else self.merge(piece)
        packed = pack(f"<{len(ids)}I", *ids)
        if len(pre_token) <= MEMO_CHARS:
            self[pre_token] = packed
        return packed

    def merge(self, piece: bytes) -> list[int]:
        """Joins the pair of least rank, leftmost first, until no neighbouring pair is a token."""
        n, rank = len(piece), self.ranks.get
        before, end = list(range(-1, n)), list(range(1, n + 2))  # end: of the part that begins at a byte; 0 once another part has taken it in
        heap = []
        for i in range(n - 1):
            if (r := rank(piece[i : i + 2])) is not None:
                heap.append(r << 64 | i << 32 | i + 2)  # the heap orders by rank, then place
        heapify(heap)
        while heap:
            x = heappop(heap)
            stop = x & 0xFFFFFFFF
            i = x >> 32 & 0xFFFFFFFF
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heappush(heap, r << 64 | i << 32 | end[stop])
            if i:
                p = before[i]
                if (r := rank(piece[p:stop])) is not None:
                    heappush(heap, r << 64 | p << 32 | stop)
        ids, i = [], 0
        while i < n:
            ids.append(rank(piece[i : end[i]]))
            i = end[i]
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self) > MEMO_ENTRIES:
            self.clear()
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ids (packed little-endian unsigned 32-bit integers), n_tokens, and decoded_sha256, the digest of what the ids decode to, of every text."""
    names = [*keep, "ids", "n_tokens", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [own.encode(t) for t in part.column(len(keep)).to_pylist()]
                digests = [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(digests, pa.string())], names)

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, ids binary, n_tokens long, decoded_sha256 string")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (bytes) of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.decode(x or b"") for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes, decodes the ids, and returns digests of both; one pass, so that ids never travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for part in slices(batch):
                for text in part.column(1).to_pylist():
                    ids = own.encode(text)
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    decoded_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *default_vocabulary())
