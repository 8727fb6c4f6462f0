"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits meet in a variant between them: one gets there by
flipping at most one bit, the other by at most two. Every fingerprint emits the variants within one
flip (role 0). Three flips change the parity, so only fingerprints of odd parity need two flips, and
of three bits two lie in the same half of the word, so only pairs within a half are flipped (role 1,
992 variants). All that share a variant with a role-0 fingerprint are within 1 + 2 flips of it, so each
variant yields a star around its smallest role-0 fingerprint: every edge is a true link, which a count
of differing bits verifies, no link is lost, and no group is expanded into pairs.

Fingerprints that cannot have a partner are spared the ball: with nine blocks of bits, three flips
leave six blocks untouched, so a partner must agree on one of the 84 sixes of blocks, about 43 bits.
The few that agree by chance or are a little too far off are told by comparing them.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any
other; fewer words than the shingle form one shingle; repeated rows share a component; a null doc_id
never names a component unless all of its documents have none. Other columns are ignored.

Three bits of 64 reach few edited copies, so alike_groups, which the pipeline's stage uses, adds the links
of module alike, between sets of shingles of a likeness of 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import alike
from .common import DOCUMENT_COLUMNS, ROW, checkpointed, keyed, slices, spread_join, table
from .components import components

RADIUS, BLOCKS = 3, 9
#: Fingerprints that agree on the same blocks are compared with each other up to so many; larger groups are left to the balls.
SMALL = 32


def fingerprint(data: bytes, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of an UTF-8 text, repeats included."""
    return majority(alike.digests(data, width))


def majority(pieces: Iterable[np.ndarray]) -> int:
    """The bits that more than half of the hashes have; zero of none."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in pieces:
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += hashes.size
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = [fingerprint(t or b"", width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(kept)) for kept in combinations(own, blocks - radius)]


def candidates(fps: DataFrame) -> DataFrame:
    """The distinct fp that may have a link to an fp of another label; one shuffle of the agreeing bits.

    They agree with it on all blocks but RADIUS. Of those that agree on the same bits, up to SMALL are compared, and only
    those with a link stay; larger groups stay whole. At most 2 ** 22 distinct fp can agree on such bits.
    """
    key = F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(_block_masks())]))
    keys = fps.select("fp", "label", key.alias("key")).repartition("key")
    group = W.partitionBy("key")
    shared = keys.withColumns({"low": F.min("label").over(group), "high": F.max("label").over(group), "n": F.count("*").over(group)}).where("low <> high")
    others = F.collect_list(F.struct("fp", "label")).over(group.orderBy("fp").rowsBetween(-SMALL, SMALL))
    near = F.exists(others, lambda x: (x["label"] != F.col("label")) & (F.bit_count(x["fp"].bitwiseXOR(F.col("fp"))) <= RADIUS))
    return shared.withColumn("near", near).where((F.col("n") > SMALL) | F.col("near")).select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fp of at most RADIUS differing bits, as stars that keep every connection between labels.

    fps: fp and label; fp of one label are known to be connected, and links among them may be left out. Every pair that
    collides is verified, whatever variants brought it together.
    """
    fps = checkpointed(candidates(fps))
    near = [0, *(1 << i for i in range(64))]
    far = [1 << i | 1 << j for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
    variants = lambda df, masks: df.select("fp", F.explode(F.transform(F.lit([_signed(m) for m in masks]), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    ball = variants(fps, near)
    hubs = ball.groupBy("variant").agg(F.min("fp").alias("hub"))
    odd = fps.where(F.bit_count("fp") % 2 == 1)
    members = ball.unionByName(variants(odd, far))
    pairs = members.join(hubs, "variant").where("fp <> hub").select("hub", "fp").distinct()
    return pairs.where(F.bit_count(F.col("hub").bitwiseXOR(F.col("fp"))) <= RADIUS).select(F.col("hub").alias("u"), F.col("fp").alias("v"))


def sketched(docs: DataFrame, width: int, tenths: int) -> DataFrame:
    """key (the row that stands for the document), tid (a hash of the text), fp, and of the set of shingles its sid, size n, and keys, minima, prefix, bits and folded (null without words, and of a set that the task has met before)."""
    often = alike.frequent(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets that this task has met: copies of them travel without what describes a set
        for part in (x for batch in batches for x in slices(batch)):
            fps, ids, sizes, keys, minima, prefixes, bits, folds = [], [], [], [], [], [], [], []
            for text in part.column("text").to_pylist():
                pieces = list(alike.digests(text or b"", width))
                own = alike.shingle_set(pieces)
                fps.append(majority(pieces))
                ids.append(sid := alike.set_id(own))
                new = own.size > 0 and sid not in seen
                seen.add(sid)
                made = alike.sketch(own) if new else (None, None)
                keys.append(made[0])
                minima.append(made[1])
                sizes.append(own.size)
                prefixes.append(alike.prefix(own, tenths, often).view(np.int64) if new else None)
                bits.append(alike.parity(own) if new else None)
                folds.append(alike.folded(bits[-1]) if new else None)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(minima, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(folds, pa.list_(pa.int64()))], names)

    names = ["doc_id", "tie", "tid", "fp", "sid", "n", "keys", "minima", "prefix", "bits", "folded"]
    rows = docs.select("doc_id", _tie(docs).alias("tie"), alike.text_id().alias("tid"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, tid long, fp long, sid long, n int, keys array<long>, minima binary, prefix array<long>, bits array<long>, folded array<long>")


def _tie(docs: DataFrame) -> Column:
    """A hash of the whole document, which tells rows of one doc_id apart."""
    return F.xxhash64(*[c for c in DOCUMENT_COLUMNS if c in docs.columns])


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links, its own included)."""
    own = checkpointed(fingerprints(docs, width))
    counts = own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(links(counts.select("fp", F.col("fp").alias("label"))))
    rooted = counts.select("fp").join(roots.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return _named(own, counts, rooted)


def _named(own: DataFrame, counts: DataFrame, rooted: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of the rows own; counts: fp, first (its smallest doc_id), n (its rows); rooted: fp, root."""
    grouped = checkpointed(counts.join(rooted.hint("merge"), "fp"))
    named = grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    labels = spread_join(grouped.withColumnRenamed("n", "rows"), named, ["root"], "n").select("fp", "rows", "component_id")
    return spread_join(own, labels, ["fp"], "rows").select("doc_id", "fp", "component_id")


def alike_roots(docs: DataFrame, own: DataFrame, width: int, tenths: int) -> DataFrame:
    """fp and root of texts that link by fingerprints, or whose sets of shingles are tenths / 10 alike or more; own: rows of sketched.

    The links of sets come first: ball hashing then looks only for those between what they have not connected.
    """
    pairs = own.groupBy("sid", "fp").agg(F.count("*").alias("n"))
    fp_of = pairs.groupBy("sid").agg(F.min("fp").alias("low"))
    # Texts of one set fall together before they are shuffled.
    same = pairs.select("sid", "fp").join(fp_of.hint("merge"), "sid").where("fp <> low").select(F.col("low").alias("u"), F.col("fp").alias("v"))
    of = lambda name: fp_of.select(F.col("sid").alias(name), F.col("low").alias(f"f{name}")).hint("merge")
    by_sets = alike.links(docs, own, width, tenths).join(of("u"), "u").join(of("v"), "v").select(F.col("fu").alias("u"), F.col("fv").alias("v"))
    known = components(by_sets.unionByName(same))
    fps = checkpointed(own.select("fp").distinct().join(known.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("label")))
    label = lambda name: fps.select(F.col("fp").alias(name), F.col("label").alias(f"l{name}")).hint("merge")
    more = components(links(fps).join(label("u"), "u").join(label("v"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    return fps.join(more.select(F.col("node").alias("label"), "root").hint("merge"), "label", "left").select("fp", F.coalesce("root", "label").alias("root"))


def alike_groups(docs: DataFrame, width: int = 5, tenths: int = 8) -> DataFrame:
    """near_duplicates over the links of fingerprints and those of sets of shingles that are tenths / 10 alike or more."""
    own = checkpointed(sketched(docs, width, tenths))
    counts = own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return _named(own.select("doc_id", "fp"), counts, alike_roots(docs, own, width, tenths))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, width: int = 5, tenths: int = 8) -> DataFrame:
    """One document of each group: that of the smallest doc_id (null last), of its rows that of the smallest hash; of equal rows one.

    Rows without a doc_id are grouped by their texts like any other.
    """
    kept = docs.select(*DOCUMENT_COLUMNS)
    own = checkpointed(sketched(kept, width, tenths))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    grouped = own.groupBy("fp").agg(F.min(place).alias("first")).join(alike_roots(kept, own, width, tenths).hint("merge"), "fp")
    best = keyed(grouped.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.tie")).select(*ROW)
    rows = keyed(kept.withColumn("tie", _tie(kept)))
    return rows.join(best.hint("merge"), ROW).dropDuplicates(ROW).select(*DOCUMENT_COLUMNS)
