"""Links between texts whose sets of word shingles are alike (Jaccard), for SimHash's near-dedup stage.

Fingerprints within three bits of 64 reach few edited copies: at a likeness of 0.8 some ten bits differ. So
the stage adds these links. Each set of shingles is sketched by MinHash; a tree's key is three of the
minima, and each text is a candidate with the smallest one under its key, and with the smallest one that has
the next two minima as well. That is at most two candidates a text and tree, however large the group, and
groups are only aggregated, never gathered. Candidates whose sketches agree enough are verified on their
whole sets.

That pass is quick but loses links, so an exact one follows it: two sets that are alike enough share a
shingle among the first ones of both in any common order (prefix filter), here the rarest first. Under each
such shingle all pairs that the first pass has not brought together are looked at; sizes, places in the
order and parity bitmaps rule out only pairs that cannot be alike enough, and the rest is verified on
whole sets. So groups are those of all pairs; large shingles are dealt among tasks by salts.

Defined results: texts without words have no set and no link here; fewer words than the shingle make one
shingle; rows of a null doc_id are texts like any other; equal sets are one node; an empty table gives no links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, slices, spread_join
from .components import components

#: Shingles hashed at a time, which bounds a worker's memory on very long texts.
PIECE = 1 << 16
TREES, KEY, ORDER = 12, 3, 3
MINIMA = TREES * (KEY + ORDER)
#: Sketches of sets of likeness 0.8 agree in 57.6 minima of 72, with a deviation of 3.4; the exact pass finds those that agree less.
AGREE = 48
#: Bits a hash of the parity bitmap, and bits of the one folded from it that travels with each shingle; members of a shingle a salt; shingles listed as frequent and the sample that finds them.
BITS, FOLDED = 1, 256
SALTED = 2048
LISTED, SAMPLE, LEAST = 1 << 17, 32, 3
#: Up to so many documents are broadcast to fetch their texts.
FEW = 100_000
_digest = partial(xxhash.xxh64_digest, seed=42)
_draw = np.random.default_rng(42)
_XOR = _draw.integers(0, 1 << 64, MINIMA, np.uint64)
_TIMES = _draw.integers(0, 1 << 64, MINIMA, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def text_id() -> Column:
    """A hash of the text, by which texts are fetched again; rows without a doc_id have one too."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def digests(data: bytes, width: int) -> Iterator[np.ndarray]:
    """The XXH64 of each word shingle of an UTF-8 text, repeats included, in pieces of big-endian integers."""
    words = data.lower().split()  # bytes: only A-Z change, only the six ASCII spaces part words
    if not words:
        return
    n = max(1, len(words) - width + 1)
    for at in range(0, n, PIECE):
        if n == 1:
            shingles = [b" ".join(words)]
        else:
            stop = min(n, at + PIECE)
            shingles = map(b" ".join, zip(*(words[at + i : stop + i] for i in range(width)), strict=True))
        yield np.frombuffer(b"".join(map(_digest, shingles)), ">u8")


def shingle_set(pieces: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(pieces).astype(np.uint64)) if pieces else np.zeros(0, np.uint64)


def set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def sketch(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """The trees' keys, and a byte of each minimum."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, hashes.size, 4096):
        least = np.minimum(least, ((hashes[at : at + 4096, None] ^ _XOR) * _TIMES).min(axis=0))
    least *= _MIX
    least ^= least >> np.uint64(29)
    of_tree = least.reshape(TREES, KEY + ORDER)
    keys = np.arange(TREES, dtype=np.uint64)
    for i in range(KEY):
        keys = (keys ^ of_tree[:, i]) * _MIX
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64).tolist(), (least >> np.uint64(56)).astype(np.uint8).tobytes()


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bitmap in which each hash flips a bit, as longs: two differ in no more bits than their sets differ in hashes.

    It has BITS bits a hash or more, a power of two; one of twice the size folds onto the other by its halves.
    """
    size = max(FOLDED, 1 << (BITS * hashes.size - 1).bit_length())
    flips = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def folded(bitmap: np.ndarray) -> np.ndarray:
    """A bitmap of FOLDED bits with the same property."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, FOLDED // 64), axis=0)


def prefix(hashes: np.ndarray, tenths: int, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first hashes in the common order, one of which any set of that likeness has among its own first ones; often: sorted hashes and their ranks, which come last."""
    size = hashes.size - -(-hashes.size * tenths // 10) + 1
    listed, rank = often
    if not listed.size:
        return hashes[:size]
    at = np.minimum(np.searchsorted(listed, hashes), listed.size - 1)
    known = listed[at] == hashes
    rare = hashes[~known]
    return rare[:size] if rare.size >= size else np.concatenate((rare, hashes[known][np.argsort(rank[at[known]])]))[:size]


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, sorted, and their ranks by count. Any list gives the same links; this one keeps groups small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            for text in part.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(list(digests(text or b"", width))).view(np.int64))], ["token"])

    texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.col("text").cast("binary").alias("text")).distinct()
    counts = texts.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= LEAST)
    found = counts.orderBy(F.desc("count"), "token").limit(LISTED).collect()
    tokens = np.array([r.token for r in found], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], len(found) - order


def candidates(sketches: DataFrame) -> DataFrame:
    """Distinct pairs u < v of sid whose sketches (sid, keys, minima) share a key: each with the smallest sid under the key, and under the key and the next minima."""
    one = sketches.where("keys is not null").groupBy("sid").agg(F.first("keys").alias("keys"), F.first("minima").alias("minima"))
    place = F.expr(f"substring(minima, tree * {KEY + ORDER} + {KEY + 1}, {ORDER - 1})")
    rows = one.select("sid", "minima", F.posexplode("keys").alias("tree", "key")).select("sid", F.explode(F.array("key", F.xxhash64("key", place))).alias("key"))
    shared = rows.groupBy("key").agg(F.min("sid").alias("hub"), F.max("sid").alias("other"), F.count("*").alias("n")).where("hub <> other").select("key", "hub", "n")
    near = spread_join(rows, shared, ["key"], "n").where("sid <> hub")
    pairs = near.select(F.col("hub").alias("u"), F.col("sid").alias("v")).distinct()
    bytes_of = lambda name: one.select(F.col("sid").alias(name), F.col("minima").alias(f"m{name}"))
    hubs = pairs.groupBy("u").agg(F.count("*").alias("n")).join(bytes_of("u").hint("merge"), "u")
    both = spread_join(pairs, hubs, ["u"], "n").join(bytes_of("v").hint("merge"), "v")
    same = F.expr(f"aggregate(sequence(1, {MINIMA}), 0, (n, i) -> n + if(substring(mu, i, 1) = substring(mv, i, 1), 1, 0))")
    return both.where(same >= AGREE).select("u", "v")


def sets(docs: DataFrame, width: int) -> DataFrame:
    """sid and hashes, the sorted set of shingles, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            found = [shingle_set(list(digests(t or b"", width))) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["sid", "hashes"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "sid long, hashes array<long>")


def _shared(one: DataFrame) -> DataFrame:
    """token, sid, pos of the shingles in prefixes that two sets or more have in theirs."""
    rows = one.select("sid", F.posexplode("prefix").alias("pos", "token")).select("token", "sid", "pos").repartition("token")
    members = F.count("*").over(W.partitionBy("token"))
    return checkpointed(rows.dropDuplicates(["token", "sid"]).withColumn("members", members).where("members > 1").drop("members"))


def _unlinked(known: DataFrame, roots: DataFrame, tenths: int) -> DataFrame:
    """Distinct pairs u < v of sid of different roots that no filter rules out; none that is alike enough is missing.

    The shingles of all prefixes travel once; of those that only one set has, which are nearly all, nothing goes on.
    Under a shingle, the members of the root that most of them have are compared with the others only.
    """
    one = known.where("prefix is not null")
    live = _shared(one)
    longs = [f"b{i}" for i in range(FOLDED // 64)]
    whole = checkpointed(one.groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("folded").alias("folded")).join(live.select("sid").distinct().hint("merge"), "sid", "left_semi"))
    small = whole.select("sid", "n", *[F.col("folded")[i].alias(b) for i, b in enumerate(longs)])
    placed = live.join(small.hint("merge"), "sid").join(roots.select(F.col("node").alias("sid"), "root").hint("merge"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    each = placed.groupBy("token", "root").agg(F.count("*").alias("members"))
    parted = each.groupBy("token").agg(F.max_by("root", F.struct("members", "root")).alias("top"), F.sum("members").alias("members"), F.count("*").alias("roots")).where("roots > 1")
    open_ = checkpointed(placed.join(parted.select("token", "top", F.ceil(F.col("members") / SALTED).cast("int").alias("salts")).hint("merge"), "token"))
    others = open_.where("root <> top").withColumn("salt", F.pmod("sid", "salts")).drop("salts", "top")
    every = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").withColumnsRenamed({c: f"_{c}" for c in ("sid", "root", "n", "pos", *longs)})
    total = F.col("n") + F.col("_n")
    rest = F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos"))
    near = others.join(every.hint("merge"), ["token", "salt"]).where(
        ((F.col("_root") == F.col("top")) | (F.col("sid") < F.col("_sid"))) & (F.col("root") != F.col("_root")) & (10 * F.least("n", "_n") >= tenths * F.greatest("n", "_n"))
        & ((10 + tenths) * rest >= tenths * total) & ((10 + tenths) * _differ([(F.col(b), F.col(f"_{b}")) for b in longs]) <= (10 - tenths) * total)
    )
    pairs = near.select(F.least("sid", "_sid").alias("u"), F.greatest("sid", "_sid").alias("v")).distinct()
    side = lambda name: whole.select(F.col("sid").alias(name), F.col("n").alias(f"n{name}"), F.col("bits").alias(f"b{name}")).hint("merge")
    both = pairs.join(side("u"), "u").join(side("v"), "v").withColumn("size", F.least(F.size("bu"), F.size("bv")))
    # Sizes that are near enough differ in one doubling at most.
    fold = lambda b: F.when(F.size(b) > F.col("size"), F.zip_with(F.slice(b, 1, F.col("size")), F.slice(b, F.col("size") + 1, F.col("size")), Column.bitwiseXOR)).otherwise(F.col(b))
    differ = F.aggregate(F.zip_with(fold("bu"), fold("bv"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return both.where((10 + tenths) * differ <= (10 - tenths) * (F.col("nu") + F.col("nv"))).select("u", "v")


def _differ(longs: list[tuple[Column, Column]]) -> Column:
    """How many bits differ."""
    return reduce(Column.__add__, [F.bit_count(a.bitwiseXOR(b)) for a, b in longs])


def _verified(docs: DataFrame, known: DataFrame, pairs: DataFrame, width: int, tenths: int) -> DataFrame:
    pairs = checkpointed(pairs)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    needed = checkpointed(known.groupBy("sid").agg(F.min("tid").alias("tid")).join(ends.hint("merge"), "sid").select("tid").distinct())
    texts = docs.select(text_id().alias("tid"), "text").join(needed.hint("broadcast" if needed.count() <= FEW else "merge"), "tid", "left_semi")
    found = checkpointed(sets(texts, width).dropDuplicates(["sid"]))
    side = lambda name: found.select(F.col("sid").alias(name), F.col("hashes").alias(f"h{name}")).hint("merge")
    both = F.size(F.array_intersect("hu", "hv"))
    alike = (10 + tenths) * both >= tenths * (F.size("hu") + F.size("hv"))
    return checkpointed(pairs.join(side("u"), "u").join(side("v"), "v").where(alike).select("u", "v"))


def links(docs: DataFrame, sketches: DataFrame, width: int, tenths: int = 8) -> DataFrame:
    """Pairs (u, v) of sid whose sets have a likeness of tenths / 10 or more, which connect all that such pairs connect; sketches: the rows of simhash.sketched."""
    quick = _verified(docs, sketches, candidates(sketches), width, tenths)
    return quick.unionByName(_verified(docs, sketches, _unlinked(sketches, components(quick), tenths), width, tenths))
