"""The whole search: jobs against candidates, from tables or from files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieve as retrieval
from ..operators import tfidf
from ..operators.documents import candidate_text, job_text, retrieval_documents
from ..operators.explain import Evaluator, explain, explain_with_model
from ..operators.match import Weights, rerank, score_pairs
from ..operators.parse import job_postings, resumes
from ..operators.schemas import candidates as clean_candidates
from ..operators.schemas import duplicates
from ..operators.schemas import jobs as clean_jobs
from ..operators.taxonomy import Taxonomy
from ..sources import io
from .cache import TTLCache

#: The most candidates that one request takes.
MOST_CANDIDATES = 200


@dataclass(frozen=True)
class SearchConfig:
    mode: str = "full"
    retrieve: int = 20
    rerank: int = 10
    final: int = 5
    weights: Weights = field(default_factory=Weights)
    fuzzy: bool = True
    #: An operators.embed.DenseModel, fixed whatever the corpus; None: TF-IDF, fitted on the candidates.
    embed: object = None
    #: A hosted model that explains matches; None: the heuristic.
    evaluator: Evaluator | None = None

    def __post_init__(self) -> None:
        if not 0 < self.final <= self.rerank <= self.retrieve:
            raise ValueError("stage sizes must not grow: final <= rerank <= retrieve")
        if self.mode not in ("full", "section"):
            raise ValueError("mode must be 'full' or 'section'")

    def described(self) -> dict:
        """What distinguishes one configuration from another, as plain values."""
        return {"mode": self.mode, "retrieve": self.retrieve, "rerank": self.rerank, "final": self.final, "weights": asdict(self.weights), "fuzzy": self.fuzzy, "embedding": getattr(self.embed, "name", tfidf.TfidfModel.name), "evaluator": getattr(self.evaluator, "name", "heuristic")}


def over_fetch(k: int, mode: str) -> int:
    """Hits to fetch so that k candidates come of them: four times as many of sections."""
    return k * (4 if mode == "section" else 1)


def retrieve(jobs: DataFrame, candidates: DataFrame, config: SearchConfig, k: int | None = None) -> DataFrame:
    """job_id, candidate_id, retrieval_score, retrieval_rank, best_section, hits of the best candidates of each job.

    Every document is ranked: those without a word of the job score 0 and fill up in the order of their keys. k: the
    candidates wanted, config.retrieve unless given.
    """
    docs = retrieval_documents(candidates, config.mode)
    asked = jobs.select("job_id", job_text().alias("text"))
    model = config.embed or tfidf.TfidfModel.fit(docs)
    return candidates_of(model.search(asked, "job_id", docs, "vector_id", over_fetch(k or config.retrieve, config.mode)), docs, k or config.retrieve)


def candidates_of(hits: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The candidates that hits (job_id, vector_id, score) on documents stand for."""
    placed = hits.select("job_id", "vector_id", "score").join(docs.select("vector_id", "candidate_id", "section"), "vector_id")
    return retrieval.aggregate_sections(placed, ["job_id", "candidate_id"], k).withColumnRenamed("rank", "retrieval_rank")


def checked(candidates: DataFrame, most: int | None = None) -> DataFrame:
    """The candidates; none at all, more than `most` of them, or a candidate_id given twice raise."""
    n = candidates.limit((most or 0) + 1).count()
    if not n:
        raise ValueError("at least one candidate is needed")
    if most is not None and n > most:
        raise ValueError(f"at most {most} candidates are taken")
    twice = duplicates(candidates, "candidate_id").orderBy("candidate_id").limit(1).collect()
    if twice:
        raise ValueError(f"candidate_id is not unique: {twice[0][0]}")
    return candidates


def search(jobs: DataFrame, candidates: DataFrame, taxonomy: Taxonomy, config: SearchConfig | None = None) -> DataFrame:
    """Ranked, explained matches of every job; no candidates, or a candidate_id given twice, raise."""
    config = config or SearchConfig()
    jobs, candidates = clean_jobs(jobs), checked(clean_candidates(candidates))
    best = ranked(jobs, candidates, taxonomy, config).where(F.col("rank") <= config.final)
    told = best.join(candidates.select("candidate_id", "full_name", "headline", "total_experience_years"), "candidate_id")
    return explain(told) if config.evaluator is None else explain_with_model(told, jobs, candidates, config.evaluator)


def ranked(jobs: DataFrame, candidates: DataFrame, taxonomy: Taxonomy, config: SearchConfig) -> DataFrame:
    """The config.rerank best candidates of each job with their scores, matched and missing requirements and evidence, but no explanation."""
    pairs = retrieve(jobs, candidates, config).select("job_id", "candidate_id", "retrieval_score", "retrieval_rank")
    return rerank(score_pairs(pairs, jobs, candidates, taxonomy, config.weights, config.fuzzy), config.rerank)


def found(jobs: DataFrame, candidates: DataFrame, config: SearchConfig | None = None, k: int = 10) -> DataFrame:
    """What retrieval alone says: job_id, rank, candidate_id, headline, experience_years, retrieval_score to four digits, best_section."""
    candidates = clean_candidates(candidates)
    rows = retrieve(clean_jobs(jobs), candidates, config or SearchConfig(), k).join(candidates.select("candidate_id", "headline", "total_experience_years"), "candidate_id")
    return rows.select("job_id", F.col("retrieval_rank").alias("rank"), "candidate_id", "headline", F.col("total_experience_years").alias("experience_years"), F.round("retrieval_score", 4).alias("retrieval_score"), "best_section")


def reranked(jobs: DataFrame, candidates: DataFrame, taxonomy: Taxonomy, config: SearchConfig | None = None) -> DataFrame:
    """All reranked candidates, with an explanation (struct evaluation) of the config.final best alone, null for the others."""
    config = config or SearchConfig()
    jobs, candidates = clean_jobs(jobs), clean_candidates(candidates)
    rows = ranked(jobs, candidates, taxonomy, config).join(candidates.select("candidate_id", "headline", "total_experience_years"), "candidate_id")
    shortlist = rows.where(F.col("rank") <= config.final)
    told = explain(shortlist) if config.evaluator is None else explain_with_model(shortlist, jobs, candidates, config.evaluator)
    evaluation = F.struct("recommendation", "strengths", "gaps", "evidence", "reasoning", "confidence").alias("evaluation")
    return rows.join(told.select("job_id", "candidate_id", evaluation), ["job_id", "candidate_id"], "left").select(
        "job_id", F.col("rank").alias("rerank_rank"), "retrieval_rank", "candidate_id", "headline", F.col("total_experience_years").alias("experience_years"),
        F.round("retrieval_score", 4).alias("retrieval_score"), "final_score", F.col("components").alias("component_scores"), F.col("matched").alias("matched_requirements"), F.col("missing").alias("missing_requirements"), "evaluation",
    )


def search_paths(spark: SparkSession, job_path: str, resumes_path: str, taxonomy: Taxonomy, extract: Callable[[bytes], str], config: SearchConfig | None = None) -> DataFrame:
    """The search over files: a job and a folder of résumés, of which those that cannot be read are left out; none that can raises."""
    posted = io.parsed_or_raise(io.read_files(spark, job_path, extract, "")).select(F.regexp_replace(F.regexp_extract("source_file", r"([^/]*)$", 1), r"\.[^.]*$", "").alias("job_id"), "source_file", "text")
    people = io.parsed_or_raise(io.read_files(spark, resumes_path, extract, ""))
    return search(job_postings(posted), resumes(people), taxonomy, config)


def cache_key(job: DataFrame, candidates: DataFrame, config: SearchConfig) -> str:
    """A digest of what a search depends on, in whatever order the candidates come; who they are goes in as a digest only."""
    who = F.sha2(F.to_json(F.struct("full_name", "location", "contact"), {"ignoreNullFields": "false"}), 256).alias("identity")
    each = candidates.select(F.sha2(F.to_json(F.struct("candidate_id", candidate_text().alias("text"), "parser_version", who), {"ignoreNullFields": "false"}), 256).alias("d"))
    own = hashlib.sha256(json.dumps([sorted([r[0], r[1]] for r in job.select("job_id", job_text()).collect()), config.described()], sort_keys=True).encode())
    for row in each.orderBy("d").toLocalIterator():  # a digest at a time
        own.update(row["d"].encode())
    return own.hexdigest()


class SearchService:
    """Searches with a cache of results by content, and counts of what was asked of it."""

    def __init__(self, taxonomy: Taxonomy, cache: TTLCache | None = None, most_candidates: int = MOST_CANDIDATES):
        self.taxonomy, self.cache, self.most = taxonomy, cache, most_candidates
        self.requests = {"hit": 0, "miss": 0}
        self.candidates = 0

    def search(self, jobs: DataFrame, candidates: DataFrame, config: SearchConfig | None = None) -> dict:
        """rows (the matches, config.final a job at most), candidate_count, config and cache_hit."""
        config = config or SearchConfig()
        candidates = checked(clean_candidates(candidates), self.most)
        key = cache_key(jobs, candidates, config)
        if self.cache is not None and (kept := self.cache.get(key)) is not None:
            self.requests["hit"] += 1
            return kept | {"cache_hit": True}
        n = candidates.count()
        made = {"rows": [r.asDict(True) for r in search(jobs, candidates, self.taxonomy, config).orderBy("job_id", "rank").collect()], "candidate_count": n, "config": config.described(), "cache_hit": False}
        self.requests["miss"] += 1
        self.candidates += n
        if self.cache is not None:
            self.cache.set(key, made)
        return made
