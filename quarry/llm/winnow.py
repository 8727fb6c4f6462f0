"""Winnowing fingerprints of documents.

Rolling hashes of all k-grams of code points; in each window of w hashes the smallest is chosen, the
rightmost of equal ones; a hash chosen by neighbouring windows is kept once, with its position. Windows
compare the upper ORDER_BITS of the hashes; what is kept has all 64, so that chance matches stay rare over
any corpus. Any match of k + w - 1 code points shares a fingerprint, and the positions say where.
A text of fewer than SHORT code points has windows that are narrower in proportion, of one hash at least: what wide windows choose within it, narrow ones choose as well, so the match with longer texts
stands, and short texts too share hashes with what was edited from them, if k code points are left as they were.

Defined results: a null text counts as empty; an empty text has no hash, and two texts without hashes
are alike (1.0); a text shorter than k is one k-gram of its own length; one with fewer than w k-grams
is one window. Long texts are hashed in pieces of PIECE windows with the same result. Rows are ordered
by doc_id, descending, null last, repeated ids by the hash of the text; the last one's next is the
first, so a single row is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

K, W = 16, 85
#: Upper bits of a hash by which windows choose; the rest of the word holds the place while they do.
ORDER_BITS = 40
PLACE = 64 - ORDER_BITS
#: Texts of so many code points have windows of full width.
SHORT = 680
PIECE = 1 << 20
_BASE, _CHAR, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD


def _kgrams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram, doubled up from the hashes of shorter ones."""
    run, length = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_CHAR), 1
    out, done = None, 0
    while k:
        if k & 1:
            if out is None:
                out = run
            else:
                m = run.size - done
                out = out[:m] * np.uint64(pow(_BASE, length, 1 << 64)) + run[done : done + m]
            done += length
        k >>= 1
        if k:
            run = run[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + run[length:]
            length *= 2
    out = out ^ (out >> np.uint64(32))
    out *= np.uint64(_MIX)
    return out


def _window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    length = 1
    run = keys
    while length * 2 <= w:
        run = np.minimum(run[:-length], run[length:])
        length *= 2
    return run if length == w else np.minimum(run[: length - w], run[w - length :])


def width(n: int, w: int = W) -> int:
    """The number of k-grams in a window of a text of n code points."""
    return w if n >= SHORT else max(1, n * w // SHORT)


def winnow(codes: np.ndarray, k: int = K, w: int = W, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, their positions, and the first window that chose each; windows before start are left out."""
    n = codes.size
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(k, n)
    w = min(width(n, w), n - k + 1)
    windows = n - k - w + 2
    hashes, places, first, last = [], [], [], -1
    mask = np.uint64((1 << PLACE) - 1)
    for at in range(start, windows, PIECE):
        stop = min(windows, at + PIECE)
        grams = _kgrams(codes[at : stop + w + k - 2], k)
        keys = (grams & ~mask) | (mask - np.arange(grams.size, dtype=np.uint64))  # of equal hashes the rightmost is smallest
        least = _window_minima(keys, w)
        new = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        least = least[new]
        place = (mask - (least & mask)).astype(np.int64) + at
        if last == place[0]:
            least, place, new = least[1:], place[1:], new[1:]
        last = place[-1] if place.size else last
        hashes.append(grams[place - at])
        places.append(place)
        first.append(new + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(first)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def edited_fingerprint(codes: np.ndarray, same: int, n: int, own: tuple, k: int = K, w: int = W) -> np.ndarray:
    """Hashes of an edited text that shares its first `same` code points with a text of n code points and fingerprint own."""
    # Windows of the head are those of the text it comes from only if both have the same width.
    kept = max(0, same - (k + width(codes.size, w) - 1) + 1) if width(n, w) == width(codes.size, w) else 0
    hashes, places, _ = winnow(codes, k, w, kept)
    if not kept:
        return hashes
    head = own[2] < kept
    if places.size and own[1][head][-1] == places[0]:
        hashes = hashes[1:]
    return np.concatenate((own[0][head], hashes))


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def likeness(a: set, b: set) -> float:
    """Shared hashes among all hashes of both."""
    return len(a & b) / len(a | b) if a or b else 1.0


def fingerprint_table(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, hashes (hex), positions of every text: the operator on its own, without neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(code_points(t or ""), k, w) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_text(h) for h, _, _ in found], pa.string()), pa.array([p.tolist() for _, p, _ in found], pa.list_(pa.int64()))], ["doc_id", "fingerprint", "positions"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string, positions array<long>")


def _descending_bucket(key: Column, bounds: list) -> Column:
    """0 for keys of at least the last bound, len(bounds) for those under the first: a tree of comparisons."""
    if not bounds:
        return F.lit(0)
    mid = len(bounds) // 2
    return F.when(key >= F.lit(bounds[mid]), _descending_bucket(key, bounds[mid + 1 :])).otherwise(_descending_bucket(key, bounds[:mid]) + F.lit(len(bounds) - mid))


def with_next(docs: DataFrame) -> DataFrame:
    """part, guest, doc_id, text: each part holds a range of doc_id in order, then as a guest the first row of the next part.

    Texts are shuffled once; the driver sees one bound and one id for each part.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select("doc_id")
    bounds = sorted(set(ids.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(_descending_bucket(F.col("doc_id"), [int(b) for b in bounds]))
    heads = sorted(ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("head")).collect())
    before = {head["head"]: heads[i - 1]["part"] for i, head in enumerate(heads)}
    if not before:
        before = {0: 0}
    own = F.create_map(*[F.lit(x) for pair in before.items() if pair[0] is not None for x in pair]) if any(h is not None for h in before) else F.lit(None)
    target = F.when(F.col("doc_id").isNull(), F.lit(before.get(None))).otherwise(own[F.col("doc_id")] if any(h is not None for h in before) else F.lit(None))
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part.alias("part"), target.cast("int").alias("target"))
    spread = F.filter(F.array(F.struct(F.col("part"), F.lit(0).alias("guest")), F.struct(F.col("target").alias("part"), F.lit(1).alias("guest"))), lambda x: x["part"].isNotNull())
    rows = placed.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.explode(spread).alias("x")).select("x.part", "x.guest", "doc_id", "tie", "text")
    return rows.repartitionById(len(bounds) + 2, F.col("part")).sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "tie")


def edited_likeness(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edit, whose later half the next document replaces."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                yield from zip(*(piece.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(8)]
        size, last = 0, None
        for part, guest, doc_id, text in rows(batches):
            if guest and last is not None and last[1] and last[0] == part:
                continue
            own = winnow(codes := code_points(text), k, w)
            current = (part, guest, doc_id, codes, own, set(own[0].tolist()))
            if last is not None and last[0] == part:
                _, _, last_id, a, fp, known = last
                half = a.size // 2
                same = a.size - half
                edited = np.concatenate((a[:same], codes[:half]))
                hashes = edited_fingerprint(edited, same, a.size, fp, k, w)
                sha = hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest()
                values = (last_id, a.size, sha, as_text(fp[0]), as_text(hashes), likeness(known, set(hashes.tolist())), likeness(known, current[5]), fp[1].tolist())
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                size += a.size
                if len(out[0]) >= 2000 or size > 4_000_000:
                    yield _batch(out)
                    out, size = [[] for _ in range(8)], 0
            last = current
        if out[0]:
            yield _batch(out)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<long>"
    return with_next(docs.select("doc_id", "text")).mapInArrow(run, schema)


def _batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
