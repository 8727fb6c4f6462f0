"""Corpus indexes that are kept: built once, brought up to date by content, loaded and searched later.

An index is a folder with a manifest and one folder for each version: a table of documents with their vectors and
digests, and the model if it was fitted. A new version is written whole before the manifest names it; the one before it
is removed after that. Vectors of a fixed model are reused for documents that did not change; a model fitted on the
corpus is fitted anew on any change.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import job_text, retrieval_documents
from ..operators.retrieve import exact_top_k, sparse_top_k
from ..operators.schemas import candidates as clean_candidates
from ..operators.schemas import jobs as clean_jobs
from ..operators.tfidf import TfidfModel
from ..sources import files
from ..streaming.sync import sync
from .search import candidates_of, checked, over_fetch

BACKEND = "spark-exact"
CONTENT = ["vector_id", "candidate_id", "section", "text", "headline", "experience_years", "source_file"]


class BrokenIndex(ValueError):
    """An index that cannot be read as one."""


def safe_name(name: str) -> str:
    """A name as a folder: letters, digits, - and _ stay, without - and _ at the ends; nothing left raises."""
    kept = "".join(c for c in name if c.isalnum() or c in "-_").strip("-_")
    if not kept:
        raise ValueError("a name needs a letter or a digit")
    return kept


def valid_request_id(value: str | None) -> bool:
    """Whether a request may go by this id: 1 to 128 letters, digits and . _ : -."""
    return bool(value) and re.fullmatch(r"[A-Za-z0-9._:-]{1,128}", value) is not None


def backend(requested: str = "auto") -> str:
    """The one backend there is, exact; auto takes it, other names raise."""
    if requested not in ("auto", "exact", BACKEND):
        raise ValueError(f"unknown vector backend: {requested}")
    return BACKEND


@dataclass
class CorpusIndex:
    """Documents with their vectors, and the model that makes vectors of queries."""

    model: object
    rows: DataFrame
    manifest: dict

    def hits(self, queries: DataFrame, query_key: str, k: int) -> DataFrame:
        """query_key, vector_id, score, rank of the k best documents of each query (query_key, text)."""
        if self.manifest["provider"] == "tfidf":
            return sparse_top_k(self.model.embed(queries, query_key), self.rows, query_key, "vector_id", k)
        return exact_top_k(self.model.embed(queries, query_key, task=self.model.QUERY), self.rows, query_key, "vector_id", "vector", k)

    def retrieve(self, jobs: DataFrame, k: int, every: bool = False) -> DataFrame:
        """The k best candidates of each job, by the best fetched documents or by all of them."""
        fetched = self.manifest["documents"] if every else over_fetch(k, self.manifest["mode"])
        return candidates_of(self.hits(clean_jobs(jobs).select("job_id", job_text().alias("text")), "job_id", fetched), self.rows, k)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of an index folder, null if there is none; one that is no JSON object raises."""
    at = f"{path}/manifest.json"
    if not files.exists(spark, at):
        return None
    try:
        found = json.loads(files.read_text(spark, at))
    except ValueError as error:
        raise BrokenIndex(f"corrupt index manifest: {at}") from error
    if not isinstance(found, dict):
        raise BrokenIndex(f"corrupt index manifest: {at}")
    return found


def load_index(spark: SparkSession, path: str, model: object = None) -> CorpusIndex:
    """The index in a folder. A fitted model is loaded with it; a fixed one must be given, and be the one it was built with."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise BrokenIndex(f"no index in {path}")
    backend(manifest["backend"])
    at = f"{path}/{manifest['version']}"
    if manifest["provider"] == "tfidf":
        model = TfidfModel.load(spark, f"{at}/model")
    elif model is None or model.name != manifest["model"]:
        raise ValueError(f"this index needs the model {manifest['model']}")
    return CorpusIndex(model, spark.read.parquet(f"{at}/documents"), manifest)


def sync_index(spark: SparkSession, root: str, name: str, candidates: DataFrame, model: object = None, mode: str = "full") -> tuple[CorpusIndex, dict]:
    """The index of that name, brought up to date with the candidates, and a report of what was done.

    model: a fixed model, or none for TF-IDF. An index of another model or mode is built anew; if nothing changed,
    nothing is embedded or written.
    """
    began = time.perf_counter()
    path, provider = f"{root}/{safe_name(name)}", "tfidf" if model is None else "dense"
    docs = retrieval_documents(checked(clean_candidates(candidates)), mode).select(CONTENT)
    old = read_manifest(spark, path)
    asked = {"provider": provider, "model": TfidfModel.name if model is None else model.name, "mode": mode}
    fits = old is not None and all(old.get(k) == v for k, v in asked.items())
    kept = spark.read.parquet(f"{path}/{old['version']}/documents") if fits else None
    fitted: list = []

    def embed(rows: DataFrame) -> DataFrame:
        own = model
        if own is None:
            own = TfidfModel.fit(rows)
            fitted.append(own)
        return rows.select(CONTENT).join(own.embed(rows, "vector_id"), "vector_id")

    unchanged, report = False, None
    if fits:
        made, report = sync(kept, docs, "vector_id", embed if model is not None else (lambda rows: rows.select("vector_id").limit(0)), CONTENT, refit=model is None)
        unchanged = not report["changed"]
    if not unchanged:
        if model is None or not fits:
            made, rebuilt = sync(None, docs, "vector_id", embed, CONTENT)
            report = rebuilt | {"removed": report["removed"] if report else 0}
        version = f"v{int(old['version'][1:]) + 1 if old else 1}"
        made.write.mode("overwrite").parquet(f"{path}/{version}/documents")
        rows = spark.read.parquet(f"{path}/{version}/documents")
        if fitted:
            fitted[-1].save(spark, f"{path}/{version}/model")
        size = rows.agg(F.count("*").alias("documents"), F.countDistinct("candidate_id").alias("candidates")).first().asDict()
        width = len(fitted[-1].terms) if fitted else rows.select(F.max(F.size("vector"))).first()[0]
        files.write_text(spark, f"{path}/manifest.json", json.dumps(asked | size | {"schema_version": 1, "backend": BACKEND, "dimension": width, "version": version}, indent=2, sort_keys=True))
        if old:
            files.remove(spark, f"{path}/{old['version']}")
    index = load_index(spark, path, model)
    return index, {"index": name, **asked, "backend": BACKEND, "total": index.manifest["documents"], **report, "elapsed_ms": round(1000 * (time.perf_counter() - began), 2)}
