"""Ranking experiments against graded labels, and the reports they leave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.match import Weights, rerank, score_pairs
from ..operators.schemas import candidates as clean_candidates
from ..operators.schemas import jobs as clean_jobs
from ..operators.taxonomy import Taxonomy
from ..sources import io
from .index import CorpusIndex

KS = (5, 10, 20)
RANKING = ["experiment", "embedding", "mode", "method", "job_id", "candidate_id", "rank"]


def _named(rows: DataFrame, name: str, index: CorpusIndex, method: str) -> DataFrame:
    return rows.select(F.lit(name).alias("experiment"), F.lit(index.manifest["provider"]).alias("embedding"), F.lit(index.manifest["mode"]).alias("mode"), F.lit(method).alias("method"), "job_id", "candidate_id", F.col("rank").cast("int").alias("rank"))


def retrieval_ranking(name: str, index: CorpusIndex, jobs: DataFrame) -> DataFrame:
    """All candidates of the index, ranked for each job by retrieval alone."""
    found = index.retrieve(jobs, index.manifest["candidates"], every=True)
    return _named(found.withColumnRenamed("retrieval_rank", "rank"), name, index, "semantic_retrieval")


def hybrid_ranking(name: str, index: CorpusIndex, jobs: DataFrame, candidates: DataFrame, taxonomy: Taxonomy, weights: Weights | None = None, fuzzy: bool = True) -> DataFrame:
    """All candidates of the index, ranked for each job by the blended score."""
    found = index.retrieve(jobs, index.manifest["candidates"], every=True).select("job_id", "candidate_id", "retrieval_score", "retrieval_rank")
    return _named(rerank(score_pairs(found, clean_jobs(jobs), clean_candidates(candidates), taxonomy, weights, fuzzy)), name, index, "hybrid_reranking")


def together(rankings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rankings)


def checked_keys(candidates: DataFrame, labels: DataFrame) -> None:
    """Raises unless candidates and labels are about the same ids."""
    apart = metrics.key_differences(candidates, labels, "candidate_id").orderBy("candidate_id").limit(5).collect()
    if apart:
        raise ValueError("benchmark and candidates differ: " + ", ".join(f"{r['candidate_id']} ({'no label' if r['side'] == 'left' else 'no candidate'})" for r in apart))


def evaluated(rankings: DataFrame, labels: DataFrame, ks=KS, relevant: int = metrics.RELEVANT) -> DataFrame:
    """experiment, job_id, k and the metrics, to six digits; labels: job_id, candidate_id, relevance_label."""
    graded = labels.select("job_id", "candidate_id", F.col("relevance_label").alias("label"))
    names = rankings.select("experiment").distinct()
    each = graded.join(F.broadcast(names), F.lit(True))  # as many names as experiments
    return metrics.rounded(metrics.evaluate(rankings, each, ["experiment", "job_id"], "candidate_id", list(ks), relevant))


def baseline(labels: DataFrame, ks=KS, trials: int = 1000) -> DataFrame:
    """job_id, k and the mean metrics of shuffled rankings, to six digits."""
    graded = labels.select("job_id", "candidate_id", F.col("relevance_label").alias("label"))
    return metrics.rounded(metrics.random_baseline(graded, "job_id", "candidate_id", list(ks), trials))


def metrics_table(results: DataFrame, ks=(5, 10)) -> DataFrame:
    """experiment, job_id, then p@k, r@k, strong@k and ndcg@k side by side, mrr and average_precision."""
    at = lambda column, k: F.max(F.when(F.col("k") == k, F.col(column))).alias(f"{short[column]}@{k}")
    short = {"precision": "p", "recall": "r", "strong_rate": "strong", "ndcg": "ndcg"}
    return results.groupBy("experiment", "job_id").agg(*[at(c, k) for c in short for k in ks], F.max("reciprocal_rank").alias("mrr"), F.max("average_precision").alias("average_precision")).orderBy("experiment", "job_id")


def comparison(rankings: DataFrame, labels: DataFrame, experiments: list[str]) -> DataFrame:
    """candidate_id, relevance_label and each experiment's rank, in the order of ids; for one job's rankings."""
    return metrics.compare(rankings.select("experiment", "candidate_id", "rank"), labels.select("candidate_id", "relevance_label"), "candidate_id", experiments).orderBy("candidate_id")


def markdown(table: list[dict], random: dict, summary: list[dict], relevant: int) -> str:
    """A report as text: the benchmark, and a row for each experiment and the baseline."""
    columns = ["p@5", "p@10", "strong@5", "strong@10", "ndcg@5", "ndcg@10", "average_precision"]
    row = lambda name, values: f"| {name} | " + " | ".join(f"{values[c]:.3f}" for c in columns) + " |"
    lines = ["# Ranking experiments", "", "## Benchmark", ""]
    lines += [f"- {s['what']}{' ' + s['value'] if s['value'] else ''}: {s['n']}" for s in summary]
    lines += [f"- relevant: label {relevant} or more", "", "## Results", "", "| experiment | " + " | ".join(columns) + " |", "|---" * (len(columns) + 1) + "|"]
    lines += [row(t["experiment"], t) for t in table] + [row("random baseline (mean)", random), ""]
    return "\n".join(lines)


def report(spark: SparkSession, path: str, rankings: list[DataFrame], labels: DataFrame, weights: Weights | None = None, ks=KS, relevant: int = metrics.RELEVANT, trials: int = 1000) -> dict:
    """Writes results (one JSON document), metrics and ranking comparison (CSV) and a Markdown report of one job's experiments; returns their places."""
    every = together(rankings).persist()
    try:
        results = evaluated(every, labels, ks, relevant)
        table = metrics_table(results)
        rows = [r.asDict() for r in table.collect()]  # a row for each experiment
        names = [r["experiment"] for r in rows]
        shuffled = baseline(labels, ks, trials).collect()
        random = {f"{s}@{r['k']}": r[c] for r in shuffled for c, s in (("precision", "p"), ("strong_rate", "strong"), ("ndcg", "ndcg"))} | {"average_precision": shuffled[0]["average_precision"], "mrr": shuffled[0]["reciprocal_rank"]}
        summary = [r.asDict() for r in metrics.benchmark_summary(labels).orderBy("what", "value").collect()]
        own = weights or Weights()
        places = {"results": f"{path}/results.json", "metrics": f"{path}/metrics", "ranking_comparison": f"{path}/ranking_comparison", "report": f"{path}/report.md"}
        io.write_document(spark, places["results"], {"relevant_threshold": relevant, "k_values": list(ks), "weights": own.__dict__, "benchmark": summary, "experiments": [r.asDict() for r in results.orderBy("experiment", "job_id", "k").collect()], "random_baseline": [r.asDict() for r in shuffled]})
        io.write_csv(table.coalesce(1), places["metrics"])
        io.write_csv(comparison(every, labels, names).coalesce(1), places["ranking_comparison"])
        io.files.write_text(spark, places["report"], markdown(rows, random, summary, relevant))
    finally:
        every.unpersist()
    return places
