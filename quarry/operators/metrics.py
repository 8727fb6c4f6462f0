"""Ranking metrics against graded labels, for many rankings at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RELEVANT, STRONG = 2, 3
#: The names of graded labels.
LABEL_NAMES = {0: "not_suitable", 1: "weak_fit", 2: "moderate_fit", 3: "strong_fit"}


METRICS = ("precision", "recall", "strong_rate", "ndcg", "reciprocal_rank", "average_precision")
#: Ranks that one task adds up; sums over longer rankings are put together from such stretches.
STRETCH = 1 << 16
#: Rows of a group that one task holds to shuffle them; larger groups are dealt out by trial and stretch.
HELD = 1 << 20
#: Trials of a group that one task draws side by side, and rows of small groups that it works on together.
BLOCK, TOGETHER = 32, 1 << 16


def _gain(label: Column) -> Column:
    return F.pow(F.lit(2.0), label) - 1.0


def _ideal(labels: DataFrame, by: list[str], ks: list[int], relevant: int) -> DataFrame:
    """by, relevant, ideal: the relevant labels of a group, and the best DCG that its labels allow at each k.

    In the ideal order equal labels stand together, so the counts of each label say it all.
    """
    counts = labels.groupBy(*by, "label").agg(F.count("*").alias("n"))
    placed = counts.withColumn("end", F.sum("n").over(W.partitionBy(*by).orderBy(F.desc("label"))))
    first = F.col("end") - F.col("n") + 1
    discounts = lambda k: F.aggregate(F.sequence(first, F.least(F.col("end"), F.lit(k))), F.lit(0.0), lambda s, n: s + 1.0 / F.log2(n + 1.0))
    at_k = [F.sum(F.when(first <= k, _gain(F.col("label")) * discounts(k)).otherwise(0.0)) for k in ks]
    return placed.groupBy(*by).agg(F.sum(F.when(F.col("label") >= relevant, F.col("n")).otherwise(0)).alias("relevant"), F.array(*at_k).alias("ideal"))


def _seen(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds seen, the relevant rows up to each rank, stretch by stretch."""
    rows = rows.withColumn("_part", F.floor((F.col("rank") - 1) / STRETCH))
    sums = rows.groupBy(*by, "_part").agg(F.sum("rel").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("rel").over(W.partitionBy(*by, "_part").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_in", within).join(sums.select(*by, "_part", ahead.alias("_ahead")), [*by, "_part"]).withColumn("seen", F.col("_ahead") + F.col("_in"))


def evaluate(rankings: DataFrame, labels: DataFrame, by: str | list[str], key: str, ks: list[int], relevant: int = RELEVANT, strong: int = STRONG) -> DataFrame:
    """by, k, precision, recall, strong_rate, ndcg, reciprocal_rank, average_precision.

    rankings: by, key, rank from 1; labels: by, key, label. Recall, the ideal ranking and average precision count all
    labels of the group; precision counts the ranked prefix. Nothing relevant gives 0.
    """
    ks, by = sorted(set(ks)), [by] if isinstance(by, str) else list(by)
    if not ks or ks[0] <= 0:
        raise ValueError("ks must be positive")
    labels = labels.select(*by, key, "label")
    rows = _seen(rankings.select(*by, key, "rank").join(labels, [*by, key]).withColumn("rel", (F.col("label") >= relevant).cast("int")), by)
    at_k = lambda x: F.array(*[F.sum(F.when(F.col("rank") <= k, x)) for k in ks])
    made = rows.groupBy(*by).agg(
        at_k(F.lit(1)).alias("n"), at_k(F.col("rel")).alias("hits"), at_k((F.col("label") == strong).cast("int")).alias("strong"), at_k(_gain(F.col("label")) / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"), F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap"),
    )
    each = made.join(_ideal(labels, by, ks, relevant), by).select("*", F.posexplode(F.lit(ks)).alias("i", "k"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return each.select(
        *by, "k", ratio(F.col("hits")[F.col("i")], F.col("n")[F.col("i")]).alias("precision"), ratio(F.col("hits")[F.col("i")], F.col("relevant")).alias("recall"),
        ratio(F.col("strong")[F.col("i")], F.col("n")[F.col("i")]).alias("strong_rate"), ratio(F.col("dcg")[F.col("i")], F.col("ideal")[F.col("i")]).alias("ndcg"),
        "reciprocal_rank", ratio(F.col("ap"), F.col("relevant")).alias("average_precision"),
    )


def rounded(rows: DataFrame, columns: tuple[str, ...] = METRICS, digits: int = 6) -> DataFrame:
    """Metrics as they are exported."""
    return rows.withColumns({c: F.round(c, digits) for c in columns if c in rows.columns})


def invalid(rankings: DataFrame, labels: DataFrame, by: str, key: str) -> DataFrame:
    """by, key, rule: repeated ids of a ranking, ids without a label, labels outside 0 to 3."""
    said = lambda df, rule: df.select(by, key, F.lit(rule).alias("rule"))
    return said(rankings.groupBy(by, key).count().where("count > 1"), "duplicate").unionByName(said(rankings.join(labels, [by, key], "left_anti"), "missing from benchmark")).unionByName(said(labels.where("label < 0 OR label > 3"), "label out of range"))


def random_baseline(labels: DataFrame, by: str, key: str, ks: list[int], trials: int = 1000, seed: int = 42) -> DataFrame:
    """Mean metrics of shuffled rankings; each trial of each group is a ranking of its own.

    A shuffle is the order of hashes of trial and key. Groups of up to HELD rows are sent once for each block of trials, and
    ranked in memory; of larger ones each trial's rows are sent, so that no task holds such a group.
    """
    if not ks or min(ks) <= 0:
        raise ValueError("ks must be positive")
    rows = labels.select(F.col(by), F.col(key), F.col("label")).where(F.col(by).isNotNull())
    heavy = rows.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > HELD).select(by)
    if not heavy.limit(1).count():
        return _drawn_by_block(rows, by, key, sorted(set(ks)), trials, seed)
    light = _drawn_by_block(rows.join(heavy, by, "left_anti"), by, key, sorted(set(ks)), trials, seed)
    return light.unionByName(_drawn_by_trial(rows.join(heavy, by, "left_semi"), by, key, ks, trials, seed))


def _drawn_by_trial(labels: DataFrame, by: str, key: str, ks: list[int], trials: int, seed: int) -> DataFrame:
    """random_baseline of groups of any size.

    Hashes are even over their range: rows of a group part into stretches of that range, and a rank is the place within the
    stretch after the rows of the stretches before.
    """
    runs = labels.withColumn("_trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    drawn = runs.withColumn("_draw", F.xxhash64("_trial", key, F.lit(seed))).withColumn("_stretch", F.shiftright("_draw", 56))
    sums = drawn.groupBy(by, "_trial", "_stretch").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy(by, "_trial").orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy(by, "_trial", "_stretch").orderBy("_draw", key))
    ranked = drawn.withColumn("_in", within).join(sums.select(by, "_trial", "_stretch", ahead.alias("_ahead")), [by, "_trial", "_stretch"]).withColumn("rank", F.col("_ahead") + F.col("_in"))
    each = evaluate(ranked, runs, [by, "_trial"], key, ks)
    return each.groupBy(by, "k").agg(*[F.avg(c).alias(c) for c in METRICS])


def _drawn_by_block(labels: DataFrame, by: str, key: str, ks: list[int], trials: int, seed: int) -> DataFrame:
    """random_baseline of groups of up to HELD rows: a task gets whole groups, one after another, with the hashes of BLOCK trials."""
    block, together = BLOCK, TOGETHER
    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = labels.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((trials - 1) // block))))
    dealt = cells.repartition(parts, by, "_block").sortWithinPartitions("_block", by, key)
    draws = [F.xxhash64(F.col("_block") * block + i, key, F.lit(seed)).alias(f"_{i}") for i in range(block)]
    kind = labels.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            starts = _starts(batch.column(0), batch.column(1))
            cut = int(starts[-1])  # 0: all rows are of one cell
            if (cut or first != last) and n + cut >= together:
                yield _block_sums(pa.Table.from_batches([*held, batch.slice(0, cut)]), ks, trials, block)
                held, n = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            n += batch.num_rows
            last = (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py())
        if held:
            yield _block_sums(pa.Table.from_batches(held), ks, trials, block)

    drawn = dealt.select(by, "_block", F.col(key).isNotNull().alias("_keyed"), F.col("label").cast("double").alias("_label"), *draws)
    sums = drawn.mapInArrow(run, f"{by} {kind}, k int, " + ", ".join(f"{c} double" for c in METRICS))
    return sums.groupBy(by, "k").agg(*[(F.sum(c) / trials).alias(c) for c in METRICS])


def _starts(groups: pa.Array, blocks: pa.Array) -> np.ndarray:
    """Where a cell, the rows of a group and block, begins."""
    blocks = blocks.to_numpy(zero_copy_only=False) if isinstance(blocks, pa.Array) else blocks.to_numpy()
    other = pc.not_equal(groups.slice(1), groups.slice(0, len(groups) - 1))
    other = other.to_numpy(zero_copy_only=False) if isinstance(other, pa.Array) else other.to_numpy()
    return np.concatenate([[0], np.flatnonzero(other.astype(bool) | (blocks[1:] != blocks[:-1])) + 1])


def _block_sums(rows: pa.Table, ks: list[int], trials: int, block: int) -> pa.RecordBatch:
    """group, k and the metrics, added up over a block of trials, of whole cells whose rows stand in the order of their keys."""
    groups = rows.column(0).combine_chunks()
    blocks, keyed, label = (rows.column(i).to_numpy() for i in (1, 2, 3))
    starts = _starts(groups, pa.array(blocks))
    n, sizes = starts.size, np.diff([*starts, rows.num_rows])
    cell = np.repeat(np.arange(n), sizes)
    rank = np.arange(rows.num_rows) - starts[cell] + 1  # of the row in that place, once rows are in order
    discount = 1.0 / np.log2(rank + 1.0)
    gain, keyed = np.nan_to_num(2.0**label - 1.0), keyed.astype(bool)
    relevant = np.bincount(cell, label >= RELEVANT, n)
    hit, strong = (label >= RELEVANT) & keyed, (label == STRONG) & keyed
    tops = [np.flatnonzero(rank <= k) for k in ks]
    best = gain[np.lexsort((-label, cell))]
    ideal = [np.bincount(cell[top], best[top] * discount[top], n) for top in tops]
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b != 0)
    sums = np.zeros((len(ks), len(METRICS), n))
    for i in range(block):
        asked = blocks[starts] * block + i < trials
        if not asked.any():
            break
        draw = rows.column(4 + i).to_numpy()
        if n == 1:
            order = np.argsort(draw)
            drawn = draw[order]
            if (drawn[1:] == drawn[:-1]).any():  # equal hashes go by their keys
                order = np.argsort(draw, kind="stable")
        else:
            order = np.lexsort((draw, cell))
        at = np.flatnonzero(hit[order])
        own = cell[at]
        nth = np.arange(at.size)
        seen = nth - np.searchsorted(own, own) + 1 if n > 1 else nth + 1
        precision_sum = ratio(np.bincount(own, seen / rank[at], n), relevant)
        first = np.zeros(n)
        first[own[seen == 1]] = 1.0 / rank[at[seen == 1]]
        for j, top in enumerate(tops):
            of, row = cell[top], order[top]
            ranked, hits, strongs = (np.bincount(of, x[row], n) for x in (keyed, hit, strong))
            dcg = np.bincount(of, gain[row] * keyed[row] * discount[top], n)
            made = ratio(hits, ranked), ratio(hits, relevant), ratio(strongs, ranked), ratio(dcg, ideal[j]), first, precision_sum
            sums[j] += np.where(asked, made, 0.0)
    some = np.flatnonzero(np.bincount(cell, keyed, n))  # a group without any key has no ranking
    columns = [groups.take(pa.array(np.tile(starts[some], len(ks)))), pa.array(np.repeat(ks, some.size), pa.int32()), *[pa.array(sums[:, c, some].ravel()) for c in range(len(METRICS))]]
    return pa.RecordBatch.from_arrays(columns, [rows.column_names[0], "k", *METRICS])


def compare(rankings: DataFrame, labels: DataFrame, key: str, experiments: list[str]) -> DataFrame:
    """key, label and each experiment's rank, side by side; rankings: experiment, key, rank."""
    return labels.join(rankings.groupBy(key).pivot("experiment", experiments).agg(F.max("rank")), key, "left")


def label_counts(labels: DataFrame, column: str = "label", domain: tuple = (0, 1, 2, 3)) -> DataFrame:
    """How many rows each label has, 0 for those that do not occur."""
    names = labels.sparkSession.createDataFrame([(x,) for x in domain], f"{column} int")
    counts = labels.groupBy(F.col(column).cast("int").alias(column)).agg(F.count("*").alias("n"))
    return names.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def benchmark_summary(labels: DataFrame) -> DataFrame:
    """what (candidates, label, review_status), value, n: the size of a benchmark and its rows by label name and by review status; labels without rows count 0."""
    names = labels.sparkSession.createDataFrame(list(LABEL_NAMES.items()), "label int, value string")
    by_label = label_counts(labels.select(F.col("relevance_label").alias("label"))).join(F.broadcast(names), "label").select(F.lit("label").alias("what"), "value", "n")
    by_status = labels.groupBy(F.col("review_status").alias("value")).agg(F.count("*").alias("n")).select(F.lit("review_status").alias("what"), "value", "n")
    return labels.agg(F.count("*").alias("n")).select(F.lit("candidates").alias("what"), F.lit(None).cast("string").alias("value"), "n").unionByName(by_label).unionByName(by_status)


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: keys of one table that the other lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
