"""Mixing sources to target weights.

Each source's documents, in a pseudorandom order, form one stream of words that is packed into blocks of
fixed length. Every output shard has a fixed number of slots and draws from a multinomial how many of them
each source fills. A plain draw strays from its targets as any draw does, so it is reconciled: the slots
of a source, numbered through all shards, beyond its target are handed to the sources that fell short, in
order, which leaves all shards as they were drawn but for the last slots of the sources drawn too often.
The slots of a source run through pseudorandom permutations of its block indexes, a new one for each
epoch; slots and blocks are joined by index.

Targets come from water-filling: sources weigh 1, 2, 3, repeating, in code-point order (null last), and
none exceeds `most` times its size.

Defined results: null and empty texts and those without words have size 0 and are never taken; repeated
rows are mixed each on its own; no rows give no rows; of other columns than those of documents none is read
or returned. Only the table of sources reaches the driver, and more than MAX_SOURCES of them are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, ROW, WORD, checkpointed, count_words, keyed, slices, table

MAX_SOURCES = 100_000
#: Streams are ordered by buckets first, which lets offsets be summed in parallel within a source: so many at least, and more for buckets of about so many documents.
BUCKETS, BUCKET_ROWS = 1024, 4096
SLOTS_PER_SHARD = 4096
SHARDS_PER_GROUP = 256


@dataclass(frozen=True)
class Plan:
    """What the driver knows of the mix: per source its size, target, number of blocks and slots wanted."""

    sources: list
    sizes: list
    targets: list
    blocks: list
    wanted: list
    buckets: int
    block_words: int
    most: int
    seed: int

    @property
    def slots(self) -> int:
        return sum(self.wanted)

    @property
    def shards(self) -> int:
        return -(-self.slots // SLOTS_PER_SHARD)


def water_fill(sizes: list[int], weights: list[int], most: int = 3) -> list[float]:
    """Shares the sum of sizes by weight; what exceeds `most` times a size is shared anew among the others."""
    left, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free.difference_update(over)
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and tie, a hash of the row: what the mix needs of each document."""
    tie = F.xxhash64(*[c for c in DOCUMENT_COLUMNS if c in docs.columns])
    return checkpointed(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), tie.alias("tie")))


def plan(rows: DataFrame, block_words: int, most: int, seed: int) -> Plan:
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] or 0 for r in found]
    targets = water_fill(sizes, [i % 3 + 1 for i in range(len(sizes))], most)
    blocks = [-(-s // block_words) for s in sizes]
    # A source's slots: its target in blocks as they are on average, none beyond `most` epochs.
    wanted = [min(most * b, round(t * b / s)) if s else 0 for t, b, s in zip(targets, blocks, sizes, strict=True)]
    buckets = max(BUCKETS, 1 << (max((r["n"] for r in found), default=1) // BUCKET_ROWS).bit_length())
    return Plan([r["source"] for r in found], sizes, targets, blocks, wanted, buckets, block_words, most, seed)


def _permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of range(n): a four-round Feistel network, walked until back in range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.arange(out.size)
    while todo.size:
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            x = (right + np.uint64((key + r * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x >> np.uint64(32)) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def draws(spark: SparkSession, mix: Plan) -> DataFrame:
    """shard, sid, taken: how many of a shard's slots each source draws, by a multinomial of the shard's own."""
    wanted, slots, seed = np.array(mix.wanted, np.float64), mix.slots, mix.seed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                counts = np.random.default_rng([seed, int(shard)]).multinomial(min(SLOTS_PER_SHARD, slots - int(shard) * SLOTS_PER_SHARD), wanted / wanted.sum())
                sid = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "sid": sid, "taken": counts[sid]})

    return spark.range(mix.shards).mapInPandas(run, "shard long, sid long, taken long")


class Reconciled:
    """Slots of sources as drawn, mapped onto slots within the targets: what one source drew too often another gets."""

    def __init__(self, wanted: list[int], drawn: list[int]):
        self.wanted, self.drawn = np.array(wanted, np.int64), np.array(drawn, np.int64)
        over = np.maximum(self.drawn - self.wanted, 0)
        self.spare_from = np.cumsum(over) - over  # where a source's spare slots begin among all spare ones
        self.short_to = np.cumsum(np.maximum(self.wanted - self.drawn, 0))

    def settle(self, sid: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source and index of each slot that source sid drew as its index-th."""
        sids = np.full(index.size, sid, np.int64)
        spare = index >= self.wanted[sid]
        if spare.any():
            at = self.spare_from[sid] + index[spare] - self.wanted[sid]
            to = np.searchsorted(self.short_to, at, side="right")
            # The first slots that a source still wants come after those that it drew itself.
            sids[spare] = to
            index = index.copy()
            index[spare] = self.wanted[to] - (self.short_to[to] - at)
        return sids, index


def slots(spark: SparkSession, mix: Plan) -> DataFrame:
    """shard, sid, epoch, block of every slot."""
    drawn = checkpointed(draws(spark, mix).withColumn("part", F.floor(F.col("shard") / SHARDS_PER_GROUP)))
    totals = {r["sid"]: r["n"] for r in drawn.groupBy("sid").agg(F.sum("taken").alias("n")).collect()}  # a row a source
    settled = Reconciled(mix.wanted, [totals.get(i, 0) for i in range(len(mix.wanted))])
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = drawn.groupBy("sid", "part").agg(F.sum("taken").alias("n")).select("sid", "part", F.coalesce(F.sum("n").over(ahead.partitionBy("sid")), F.lit(0)).alias("base"))
    within = W.partitionBy("sid", "part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    first = drawn.withColumn("ahead", F.coalesce(F.sum("taken").over(within), F.lit(0))).join(base.hint("merge"), ["sid", "part"]).select("shard", "sid", "taken", (F.col("base") + F.col("ahead")).alias("first"))
    blocks, seed = np.array(mix.blocks, np.int64), mix.seed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, drawer, taken, first_slot in batch[["shard", "sid", "taken", "first"]].itertuples(index=False):
                sids, index = settled.settle(drawer, first_slot + np.arange(taken))
                epoch = index // blocks[sids]
                block = np.empty(index.size, np.int64)
                for sid, e in set(zip(sids.tolist(), epoch.tolist(), strict=True)):
                    at = (sids == sid) & (epoch == e)
                    n = int(blocks[sid])
                    block[at] = _permuted(index[at] % n, n, hash((seed, sid, e)) & 0xFFFFFFFFFFFFFFFF)
                yield pd.DataFrame({"shard": shard, "sid": sids, "epoch": epoch, "block": block})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return first.repartition(parts, "shard").mapInPandas(run, "shard long, sid long, epoch long, block long")  # few rows that become many


def located(rows: DataFrame, mix: Plan) -> DataFrame:
    """Each row with its source's number, its place in the source's stream and a key of its own (sid, bucket, rn)."""
    spark = rows.sparkSession
    named = spark.createDataFrame([(i, s, n, t) for i, (s, n, t) in enumerate(zip(mix.sources, mix.sizes, mix.targets, strict=True))], "sid long, name string, source_size long, target double")
    known = rows.join(F.broadcast(named), rows.source.eqNullSafe(named.name)).drop("name")  # bounded by MAX_SOURCES
    known = known.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie", F.lit(mix.seed)), F.lit(mix.buckets)))
    sums = known.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    base = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = W.partitionBy("sid", "bucket").orderBy("doc_id", "tie")
    placed = known.withColumn("ahead", F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("rn", F.row_number().over(within))
    return placed.join(base.hint("merge"), ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("ahead")).drop("base", "ahead")


def pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a document reaches into (null for documents without words), with the words it lends."""
    end = F.col("start") + F.col("size")
    span = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)))
    cut = placed.withColumn("block", F.explode_outer(span))
    return cut.withColumn("words", F.least(end, (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words))


def draw_documents(docs: DataFrame, block_words: int = 64, most: int = 3, seed: int = 42) -> tuple[Plan, DataFrame]:
    """The plan, and a row for each document and block with `times`, how often the mix takes the block.

    Both sides of the join grow with the data, and the planner cannot see how far the slots expand: never broadcast.
    """
    rows = sized(docs)
    mix = plan(rows, block_words, most, seed)
    times = slots(docs.sparkSession, mix).groupBy("sid", "block").agg(F.count("*").alias("times"))
    return mix, pieces(located(rows, mix), block_words).join(times.hint("merge"), ["sid", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, drawn = draw_documents(table(spark, sf_dir, "documents"))
    taken = F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken")
    return drawn.groupBy("sid", "bucket", "rn", "doc_id", "size", "source_size", "target").agg(taken).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block_words: int = 256, most: int = 3, seed: int = 42) -> DataFrame:
    """The mix as documents: for each epoch in which a document's blocks are taken, a row with their text.

    A whole document is left as it is; of others the taken runs of blocks stay, each on lines of its own.
    Documents of which nothing is taken, those without words among them, are not part of the mix.
    """
    _, drawn = draw_documents(docs, block_words, most, seed)
    each = drawn.where("times > 0").groupBy("sid", "bucket", "rn", "doc_id", "tie", "start").agg(F.sort_array(F.collect_list(F.struct("block", "times"))).alias("blocks"))  # as many as the document has
    own = docs.select(*DOCUMENT_COLUMNS)
    own = keyed(own.withColumn("tie", F.xxhash64(*DOCUMENT_COLUMNS))).dropDuplicates(ROW)
    joined = own.join(keyed(each).select(*ROW, "start", "blocks").hint("merge"), ROW).select(*DOCUMENT_COLUMNS, "start", "blocks")
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            out = []
            for doc_id, text, lang, source, _, start, blocks in zip(*(c.to_pylist() for c in part.columns), strict=True):
                starts = [m.start() for m in word.finditer(text)]
                at = lambda b: min(len(starts), max(0, b * block_words - start))  # noqa: B023, E731
                for epoch in range(max(b["times"] for b in blocks)):
                    taken = [b["block"] for b in blocks if b["times"] > epoch]
                    runs, first = [], taken[0]
                    for b, after in zip(taken, [*taken[1:], None], strict=True):
                        if after != b + 1:
                            runs.append((at(first), at(b + 1)))
                            first = after
                    if runs == [(0, len(starts))]:
                        made = text
                    else:
                        made = "\n".join(text[starts[i] : starts[j] if j < len(starts) else len(text)].rstrip(" \t\n\x0b\f\r") for i, j in runs)
                    out.append((doc_id, made, lang, source, len(made)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), arrow, strict=True)], DOCUMENT_COLUMNS)

    arrow = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return joined.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")


def with_epochs(mixed: DataFrame) -> DataFrame:
    """doc_id, epoch, text of mixed documents: rows of one document are numbered from 0, as the mix made them.

    A later epoch takes some of the blocks of the one before, so the longer text comes first. Without a doc_id, equal
    texts are numbered.
    """
    whose = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    order = W.partitionBy("doc_id", whose).orderBy(F.desc("n_chars"), F.xxhash64("text"))
    return mixed.select("doc_id", (F.row_number().over(order) - 1).alias("epoch"), "text")
