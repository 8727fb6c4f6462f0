"""Token ids packed into fixed-length rows.

Documents longer than a row are split without loss into full rows and a rest; the pieces of a group are
packed best-fit-decreasing: the longest first, each into the open row with the least room that still
holds it, found in a segment tree over capacities. A row carries its ids (padded, little-endian unsigned
32-bit integers, so that the rows of a group are a matrix), the cumulative segment lengths, the places
where positions start again, and for each segment its document and offset.

Written out, a group is a file of its bare matrix, of two bytes an id where the vocabulary fits, and the index tells each row's file and place in it; a task writes
to a name of its own try and renames, so a task that runs again leaves the same files.

Groups are runs of documents of one input partition, closed at GROUP_TOKENS tokens, so memory is bounded and
nothing is shuffled. Defined results: null and empty texts have no ids and are in no row; repeated rows are
packed each on its own; a null doc_id stays null in its segments; other columns are ignored.
"""

from __future__ import annotations

import base64
import posixpath
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary
from .common import fresh_dir, slices, table

ROW_TOKENS = 2048
GROUP_TOKENS = 1 << 21
SCHEMA = "shard long, group long, row long, n_tokens long, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"
_KINDS = [*[pa.int64()] * 4, pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
_NAMES = ["shard", "group", "row", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"]


class Capacities:
    """Segment tree over room left: which capacities some open row has, and the least of at least n."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most.bit_length())
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (room, row) of the fullest row with room for it."""
        at = least + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of indexes into lengths, none over capacity."""
    open_rows, rows = Capacities(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_rows.take(lengths[i])
        if found is None:
            rows.append([i])
            found = capacity, len(rows) - 1
        else:
            rows[found[1]].append(i)
        open_rows.add(found[0] - lengths[i], found[1])
    return rows


def pack(encoded: list[tuple[int | None, np.ndarray]], capacity: int, pad: int) -> Iterator[tuple]:
    """(n_tokens, ids, cumulative lengths, resets, doc_ids, offsets) of each row."""
    pieces = [(doc, at, ids[at : at + capacity]) for doc, ids in encoded for at in range(0, ids.size, capacity)]
    for row in best_fit_decreasing([p[2].size for p in pieces], capacity):
        segments = [pieces[i] for i in row]
        ends = np.cumsum([0, *(s[2].size for s in segments)])
        ids = np.full(capacity, pad, "<u4")
        ids[: ends[-1]] = np.concatenate([s[2] for s in segments])
        yield int(ends[-1]), ids.tobytes(), ends.tolist(), ends[:-1].tolist(), [s[0] for s in segments], [s[1] for s in segments]


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def packed(docs: DataFrame, path: str, pattern: str, row_tokens: int = ROW_TOKENS, pad: int = 0) -> DataFrame:
    """Encodes the texts and packs their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, group = tokenizer(path, pattern).encode_ordinary, TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(shard, group, i, *r) for i, r in enumerate(pack(held, row_tokens, pad))]
            for at in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 512], strict=True), _KINDS, strict=True)], _NAMES)

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array(encode(text or ""), "<u4")
                    held.append((doc, ids))
                    tokens += ids.size
                    if tokens >= GROUP_TOKENS:
                        yield from flush()
                        held, tokens, group = [], 0, group + 1
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def id_bytes(path: str, pattern: str) -> int:
    """Bytes that every id of the vocabulary fits in: 2 or 4."""
    return 2 if tokenizer(path, pattern).max_token_value < 1 << 16 else 4


def write_matrices(rows: DataFrame, directory: str, row_tokens: int = ROW_TOKENS, width: int = 4) -> DataFrame:
    """Writes the ids of packed rows as files of little-endian unsigned integers of width bytes, row_tokens to a row.

    Returns the index: path, bytes_from, and the columns of a row but its ids. No rows give no files; an id that does
    not fit raises.
    """
    names = ["path", "bytes_from", *(n for n in _NAMES if n != "input_ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(directory)
        store.create_dir(base, recursive=True)
        attempt, name, path, out = TaskContext.get().taskAttemptId(), None, "", None

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{path}.{attempt}.tmp", path)

        for batch in batches:
            paths, froms = [], []
            for shard, group, ids in zip(*(batch.column(n).to_pylist() for n in ("shard", "group", "input_ids")), strict=True):
                if len(ids) != 4 * row_tokens:
                    raise ValueError(f"a row of {len(ids)} bytes in a matrix of {row_tokens} tokens to a row")
                if (shard, group) != name:
                    close()
                    name, path = (shard, group), f"{base}/ids-{shard:05d}-{group:05d}.u{8 * width}"
                    out = store.open_output_stream(f"{path}.{attempt}.tmp", compression=None)
                paths.append(f"{directory}/{posixpath.basename(path)}")
                froms.append(out.tell())
                out.write(_narrowed(ids, width))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(froms, pa.int64()), *(batch.column(n) for n in names[2:])], names)
        close()

    own = rows.select(*_NAMES)
    schema = "path string, bytes_from long, " + ", ".join(x for x in SCHEMA.split(", ") if not x.startswith("input_ids"))
    own.mapInArrow(run, schema).write.parquet(index := f"{directory}-index")
    return rows.sparkSession.read.parquet(index).select(*[F.col(n) for n in names])


def _narrowed(ids: bytes, width: int) -> bytes:
    if width == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if wide.size and wide.max() >= 1 << 8 * width:
        raise ValueError(f"an id does not fit in {width} bytes")
    return wide.astype(f"<u{width}").tobytes()


def read_matrices(index: DataFrame, row_tokens: int = ROW_TOKENS, width: int = 4) -> DataFrame:
    """The rows of an index with their ids (input_ids, 32-bit), read back from the files; a file that ends early raises."""
    names = [*index.columns, "input_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, 512)):
            ids, file, at = [], None, None
            for path, begin in zip(part.column("path").to_pylist(), part.column("bytes_from").to_pylist(), strict=True):
                if path != at:
                    if file is not None:
                        file.close()
                    store, name = fs.FileSystem.from_uri(path)
                    file, at = store.open_input_file(name), path
                data = file.read_at(width * row_tokens, begin)
                if len(data) != width * row_tokens:
                    raise ValueError(f"{path} ends within the row at {begin}")
                ids.append(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
            if file is not None:
                file.close()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema) + ", input_ids binary"
    return index.mapInArrow(run, schema)


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document, writes the matrices and their index, and returns the index with the ids read back."""
    vocabulary = default_vocabulary()
    width = id_bytes(*vocabulary)
    index = write_matrices(packed(table(spark, sf_dir, "documents"), *vocabulary), fresh_dir(spark, "matrices"), width=width)
    return read_matrices(index, width=width).select(*_NAMES)
