"""Retrieval: exact top-k of queries against a corpus by blocks, and from sections to candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import clamped

#: Queries compared at a time: up to so many are broadcast, more are dealt out in blocks of this size.
QUERY_BLOCK = 1000
#: Rows of the corpus that meet a block of queries in one task, where queries are dealt out.
CHUNK = 1 << 16
#: Scores are compared to so many decimals, beyond which the order of float sums decides.
DIGITS = 12


def top_k(scores: DataFrame, by: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each group, with their rank; equal scores in the order of the key."""
    order = W.partitionBy(by).orderBy(F.desc(score), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, key, score) of the k best rows of each column of scores; equal ones in the order of the keys."""
    order = np.argsort(keys, kind="stable")
    scores, keys, n = scores[order], keys[order], min(k, len(keys))
    least = -np.partition(-scores, n - 1, axis=0)[n - 1]
    rows, columns = [], []
    for q in range(scores.shape[1]):
        above = np.flatnonzero(scores[:, q] > least[q])
        ties = np.flatnonzero(scores[:, q] == least[q])[: n - above.size]
        rows += [above, ties]
        columns += [q] * n
    at, columns = np.concatenate(rows), np.array(columns)
    return columns, keys[at], scores[at, columns]


def block_top_k(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, k: int, prepare: Callable[[pa.Table], Callable]) -> DataFrame:
    """query_key, key, score, rank: the k best rows of the corpus for each query, every pair scored.

    prepare turns queries into a function from corpus rows to a matrix of scores, a row for each corpus row. A task keeps
    its best k rows for each query before anything is shuffled. Up to QUERY_BLOCK queries are broadcast; of more, blocks
    meet chunks of the corpus in a grid, so that no task holds more than one of each. Rows of a null key are left out; k of
    0 or less gives no rows.
    """
    corpus = corpus.where(F.col(key).isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *corpus.schema)}
    schema = f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, score double"
    spark, names = corpus.sparkSession, [query_key, key, "score"]
    if k <= 0:
        return spark.createDataFrame([], schema + ", rank int")

    def scored(asked: list, score: Callable, tables: Iterator) -> pa.Table | None:
        found = None
        for table in tables:
            if not table.num_rows:
                continue
            made = score(table)
            columns, keys, values = best_of(np.round(made, DIGITS), np.array(table.column(key).to_pylist()), k)
            part = [columns, keys, values]
            if found is not None:
                part = [np.concatenate(x) for x in zip(found, part, strict=True)]
                ranked = np.lexsort((part[1], -part[2], part[0]))
                nth = np.arange(ranked.size) - np.searchsorted(part[0][ranked], part[0][ranked])
                part = [x[ranked[nth < k]] for x in part]
            found = part
        if found is None:
            return None
        columns, keys, values = found
        return pa.table([pa.array([asked[c] for c in columns.tolist()], type_of[query_key]), pa.array(keys.tolist(), type_of[key]), pa.array(values)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    type_of = {query_key: to_arrow_type(queries.schema[query_key].dataType), key: to_arrow_type(corpus.schema[key].dataType)}
    some = queries.limit(QUERY_BLOCK + 1).toArrow()
    if some.num_rows <= QUERY_BLOCK:
        if not some.num_rows:
            return spark.createDataFrame([], schema + ", rank int")
        shared = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            made = scored(own.column(query_key).to_pylist(), prepare(own), (piece for batch in batches for piece in _pieces(batch)))
            if made is not None:
                yield from made.to_batches()

        best = corpus.mapInArrow(run, schema)
    else:
        blocks, chunks = -(-queries.count() // QUERY_BLOCK), -(-corpus.count() // CHUNK)
        cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
        deal = lambda column, n: F.pmod(F.xxhash64(column), F.lit(max(1, n))).cast("int")
        left = queries.withColumn("_block", deal(query_key, blocks)).withColumn("_chunk", cells(chunks))
        right = corpus.withColumn("_chunk", deal(key, chunks)).withColumn("_block", cells(blocks))

        def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
            made = None
            if asked.num_rows:
                made = scored(asked.column(query_key).to_pylist(), prepare(asked), (x for batch in rows.to_batches() for x in _pieces(batch)))
            return made if made is not None else pa.table([pa.array([], type_of[query_key]), pa.array([], type_of[key]), pa.array([], pa.float64())], names)

        best = left.groupBy("_block", "_chunk").cogroup(right.groupBy("_block", "_chunk")).applyInArrow(meet, schema)
    return top_k(best, query_key, key, k)


def _pieces(batch, rows: int = 2048) -> Iterator:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _matrix(column) -> np.ndarray:
    """Rows of length one; a zero or null vector is all zeros."""
    rows = column.to_pylist()
    width = max((len(r) for r in rows if r is not None), default=0)
    made = np.array([r if r is not None else [0.0] * width for r in rows], np.float64).reshape(len(rows), width)
    length = np.sqrt((made * made).sum(axis=1, keepdims=True))
    return made / np.where(length == 0, 1.0, length)


def exact_top_k(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, vector: str, k: int) -> DataFrame:
    """query_key, key, score, rank: the k vectors of largest cosine for each query, exactly."""

    def prepare(asked: pa.Table) -> Callable:
        own = _matrix(asked.column(vector)).T

        def score(rows) -> np.ndarray:
            return np.clip(_matrix(rows.column(vector)) @ own, -1.0, 1.0)

        return score

    return block_top_k(queries.select(query_key, vector), corpus.select(key, vector), query_key, key, k, prepare)


def sparse_top_k(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """query_key, key, score, rank by the dot products of sparse vectors (indices, weights); rows that share no index score 0."""

    def prepare(asked: pa.Table) -> Callable:
        places, weights = asked.column("indices").to_pylist(), asked.column("weights").to_pylist()
        terms = np.unique(np.array([i for x in places for i in x], np.int64))
        own = np.zeros((terms.size, len(places)))
        for q, (i, w) in enumerate(zip(places, weights, strict=True)):
            own[np.searchsorted(terms, i), q] = w

        def score(rows) -> np.ndarray:
            out = np.zeros((rows.num_rows, len(places)))
            if not terms.size:
                return out
            for r, (i, w) in enumerate(zip(rows.column("indices").to_pylist(), rows.column("weights").to_pylist(), strict=True)):
                at = np.minimum(np.searchsorted(terms, i), terms.size - 1)
                known = terms[at] == np.array(i, np.int64)
                if known.any():
                    out[r] = np.array(w)[known] @ own[at[known]]
            return out

        return score

    return block_top_k(queries.select(query_key, "indices", "weights"), corpus.select(key, "indices", "weights"), query_key, key, k, prepare)


def aggregate_sections(hits: DataFrame, by: list[str], k: int | None = None) -> DataFrame:
    """by, score, best_section, n_hits, hits of each candidate: 0.7 best + 0.3 mean of the best three."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), "section")
    ranked = hits.withColumn("_n", F.row_number().over(order))
    made = ranked.groupBy(*by).agg(
        clamped(0.7 * F.max("score") + 0.3 * F.avg(F.when(F.col("_n") <= 3, F.col("score"))), -1.0, 1.0).alias("retrieval_score"),
        F.max(F.when(F.col("_n") == 1, F.col("section"))).alias("best_section"), F.count("*").alias("n_hits"),
        F.sort_array(F.collect_list(F.struct(F.col("_n").alias("rank"), "section", "score"))).alias("hits"),
    )
    return made if k is None else top_k(made, by[0], by[-1], k, "retrieval_score")


def cascade(rows: DataFrame, by: str, key: str, stages: list[tuple[str, int]]) -> DataFrame:
    """Top k by one score after another; each cut changes what the next one sees."""
    for score, k in stages:
        rows = top_k(rows.drop("rank"), by, key, k, score)
    return rows
