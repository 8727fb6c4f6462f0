"""Explanations, filters and export of ranked matches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import confidence, tier
from .documents import evidence_catalog
from .embed import with_retries


def _gap(x: Column) -> Column:
    return F.concat(F.lit("No direct resume evidence found for "), x, F.lit("."))


def explain(matches: DataFrame) -> DataFrame:
    """Adds recommendation, strengths, gaps, reasoning and confidence; matches also need a headline."""
    strength = lambda x: F.concat(F.lit("Evidence supports "), x, F.lit("."))
    reasoning = F.concat(
        F.lit("The "), F.coalesce("headline", F.lit("candidate profile")), F.lit(" profile received a deterministic job-fit score of "), F.format_string("%.1f", "final_score"),
        F.lit("/100. Missing items mean only that the record holds no direct evidence of them."),
    )
    return matches.withColumns({
        "recommendation": tier(F.col("final_score")), "strengths": F.transform(F.slice("matched", 1, 5), strength), "gaps": F.transform(F.slice("missing", 1, 5), _gap),
        "evidence": F.slice("evidence", 1, 10), "confidence": confidence(F.size("evidence"), F.size("matched")), "reasoning": reasoning,
    })


#: What the model is told before the input.
INSTRUCTIONS = """
You write the explanation of a score that is already fixed; you do not score.
Use candidate_evidence alone and add nothing to it. Do not infer who the candidate is or any personal trait.
Each strength cites one to three evidence_ids that bear it out.
gap_requirements holds strings of missing_requirements only, word for word. A missing requirement means that the record
holds no direct evidence of it, no more.
Answer with one JSON object: candidate_id, strengths (at most 5 of claim and evidence_ids), gap_requirements (at most 5),
reasoning (short and factual) and confidence (0 to 1).
""".strip()


@dataclass(frozen=True)
class Evaluator:
    """A hosted model: generate turns a prompt into a JSON object (text or dict) and may raise; it is asked `attempts` times."""

    name: str
    generate: Callable[[str], dict | str]
    attempts: int = 3
    first_wait: float = 1.0
    #: Whether a row whose answer does not hold gets the heuristic's explanation; else it is left out.
    fallback: bool = True


def evaluator(requested: str, generate: Callable[[str], dict | str] | None = None, **options) -> tuple[Evaluator | None, str]:
    """The evaluator for a request ("heuristic" or a model's name), and what is reported as used: without a client, the heuristic."""
    if requested == "heuristic":
        return None, "heuristic"
    if generate is None:
        return None, f"heuristic ({requested} key unavailable)"
    return Evaluator(requested, generate, **options), requested


def prompt_input(jobs: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """matches with prompt, the model's input as JSON, and catalog, the evidence of the candidate by id; no identity goes into either."""
    catalog = evidence_catalog(candidates.join(matches.select("candidate_id").distinct(), "candidate_id", "left_semi"))
    listed = catalog.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("ord", "evidence_id", "section", "text"))).alias("c"))
    items = F.transform("c", lambda e: F.struct(e["evidence_id"].alias("evidence_id"), e["section"].alias("section"), e["text"].alias("text")))
    asked = jobs.select("job_id", F.struct("title", "experience_min_years", "experience_max_years", "responsibilities", "required_skills", "required_software", "education_requirements", "preferred_skills", "preferred_qualifications", "preferred_certifications").alias("_job"))
    rows = matches.join(listed.select("candidate_id", items.alias("catalog")), "candidate_id", "left").join(asked, "job_id")
    fixed = F.struct("candidate_id", F.col("final_score").alias("score"), F.col("matched").alias("matched_requirements"), F.col("missing").alias("missing_requirements"), F.col("components").alias("component_scores"))
    said = F.to_json(F.struct(F.col("_job").alias("job"), fixed.alias("deterministic_match"), F.col("catalog").alias("candidate_evidence")), {"ignoreNullFields": "false"})
    return rows.withColumn("prompt", F.concat(F.lit(INSTRUCTIONS + "\n\nINPUT:\n"), said)).drop("_job")


def parsed_answer(answer: dict | str) -> dict:
    """The model's answer, if it has the form that was asked for."""
    made = json.loads(answer) if isinstance(answer, str) else dict(answer)
    made = {"strengths": [], "gap_requirements": []} | made
    formed = set(made) == {"candidate_id", "strengths", "gap_requirements", "reasoning", "confidence"} and isinstance(made["reasoning"], str)
    formed = formed and len(made["strengths"]) <= 5 and len(made["gap_requirements"]) <= 5 and all(set(s) == {"claim", "evidence_ids"} and 1 <= len(s["evidence_ids"]) <= 3 for s in made["strengths"])
    if not formed or not isinstance(made["confidence"], int | float) or not 0 <= made["confidence"] <= 1:
        raise ValueError("malformed answer")
    return made


def grounded(made: dict, candidate_id: str, missing: list[str], known: set[str]) -> dict:
    """A parsed answer, if it says nothing but what the input bears out."""
    if made["candidate_id"] != candidate_id:
        raise ValueError("mismatched candidate_id")
    if unknown := [e for s in made["strengths"] for e in s["evidence_ids"] if e not in known]:
        raise ValueError(f"unknown evidence: {unknown}")
    if unsupported := [g for g in made["gap_requirements"] if g not in missing]:
        raise ValueError(f"unsupported gap requirements: {unsupported}")
    return made


def explain_with_model(matches: DataFrame, jobs: DataFrame, candidates: DataFrame, by: Evaluator) -> DataFrame:
    """explain's columns, the narrative by a hosted model, and model_error.

    The score stays as it is. Evidence that the model cites is looked up in the candidate's own record, with the
    requirement that the match tied to it, or "Supporting evidence". A list that the answer leaves empty is the heuristic's.
    """
    generate, attempts, first_wait = by.generate, by.attempts, by.first_wait

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for job_id, candidate_id, prompt, missing, ids in batch.itertuples(index=False):
                try:
                    # What fails or is malformed is asked for again; an answer that says too much is not.
                    said = with_retries(lambda: parsed_answer(generate(prompt)), attempts, first_wait)  # noqa: B023
                    made = grounded(said, candidate_id, list(missing), set(ids))
                    cited = list(dict.fromkeys(e for s in made["strengths"] for e in s["evidence_ids"]))
                    out.append((job_id, candidate_id, [s["claim"] for s in made["strengths"]], made["gap_requirements"], cited, made["reasoning"], float(made["confidence"]), None))
                except Exception as error:
                    out.append((job_id, candidate_id, None, None, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["job_id", "candidate_id", "_claims", "_gaps", "_cited", "_reasoning", "_confidence", "model_error"])

    asked = prompt_input(jobs, candidates, matches)
    ids = F.transform(F.coalesce("catalog", F.array().cast("array<struct<evidence_id:string,section:string,text:string>>")), lambda e: e["evidence_id"])
    told = asked.select("job_id", "candidate_id", "prompt", "missing", ids.alias("ids")).mapInPandas(run, "job_id string, candidate_id string, _claims array<string>, _gaps array<string>, _cited array<string>, _reasoning string, _confidence double, model_error string")
    both = explain(matches).join(told, ["job_id", "candidate_id"]).join(asked.select("job_id", "candidate_id", "catalog", F.col("evidence").alias("_all")), ["job_id", "candidate_id"])
    if not by.fallback:
        both = both.where("model_error IS NULL")

    def resolved(e: Column) -> Column:
        record = F.get(F.filter("catalog", lambda c: c["evidence_id"] == e), F.lit(0))
        tied = F.get(F.filter("_all", lambda m: m["evidence_id"] == e), F.lit(0))["requirement"]
        return F.struct(e.alias("evidence_id"), F.coalesce(tied, F.lit("Supporting evidence")).alias("requirement"), record["text"].alias("evidence"), record["section"].alias("source_section"))

    some = lambda c, made, else_: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, made).otherwise(else_)
    return both.withColumns({
        "strengths": some(F.col("_claims"), F.col("_claims"), F.col("strengths")),
        "gaps": some(F.col("_gaps"), F.transform("_gaps", _gap), F.col("gaps")),
        "evidence": some(F.col("_cited"), F.transform("_cited", resolved), F.col("evidence")),
        "reasoning": F.coalesce("_reasoning", "reasoning"), "confidence": F.coalesce("_confidence", "confidence"),
    }).drop("_claims", "_gaps", "_cited", "_reasoning", "_confidence", "catalog", "_all")


def joined_or_raise(matches: DataFrame, candidates: DataFrame, evaluations: DataFrame) -> DataFrame:
    """matches with their candidate's record (struct profile) and evaluation (struct evaluation); one that lacks either raises."""
    pairs = ["job_id", "candidate_id"]
    profile = candidates.select("candidate_id", F.struct("*").alias("profile"))
    own = evaluations.select(*pairs, F.struct(*[c for c in evaluations.columns if c not in pairs]).alias("evaluation"))
    rows = matches.join(profile, "candidate_id", "left").join(own, pairs, "left")
    absent = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"no {c} of "), "candidate_id")).cast(rows.schema[c].dataType)).otherwise(F.col(c))
    return rows.withColumns({"profile": absent("profile"), "evaluation": absent("evaluation")})


def filter_results(rows: DataFrame, *, min_score: float = 0.0, recommendations=(), role: str = "", min_years: float | None = None, max_years: float | None = None) -> DataFrame:
    """Conjunction of the filters given; unknown years fail any bound on years, no recommendations allow all."""
    keep = F.col("final_score") >= min_score
    if recommendations:
        keep &= F.col("recommendation").isin(*recommendations)
    if role.strip():
        keep &= F.lower(F.coalesce("headline", F.lit(""))).contains(role.strip().lower())
    if min_years is not None:
        keep &= F.col("total_experience_years") >= min_years
    if max_years is not None:
        keep &= F.col("total_experience_years") <= max_years
    return rows.where(keep)


def flat(rows: DataFrame, *by: str) -> DataFrame:
    """The export's columns, after those of `by`: lists joined, absent values empty, zero years written as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    years = F.when(F.col("total_experience_years") != 0, F.col("total_experience_years").cast("string"))
    return rows.select(
        *by, "rank", "candidate_id", text("full_name").alias("candidate_name"), text("headline").alias("headline"), F.coalesce(years, F.lit("")).alias("experience_years"),
        F.col("final_score").alias("score"), "recommendation", F.col("components.semantic").alias("semantic_score"), F.col("components.required_skills").alias("requirements_score"),
        F.col("components.experience").alias("experience_score"), F.col("components.role").alias("role_score"), F.col("components.preferred").alias("preferred_score"),
        F.array_join("matched", " | ").alias("matched_requirements"), F.array_join("missing", " | ").alias("missing_requirements"),
    )


def public(rows: DataFrame) -> DataFrame:
    """What may leave the engine: no name, contact or raw text."""
    return rows.select(F.coalesce("rank", "retrieval_rank").alias("rank"), "job_id", "candidate_id", "headline", "total_experience_years", "final_score", "recommendation", "components", "matched", "missing", "evidence", "strengths", "gaps", "confidence", "reasoning")


#: How recommendations and components are labelled on screen.
RECOMMENDATIONS = {"highly_recommended": "Highly recommended", "recommended": "Recommended", "consider": "Consider", "not_recommended": "Not recommended"}
COMPONENTS = {"semantic": "Semantic", "required_skills": "Requirements", "experience": "Experience", "role": "Role", "preferred": "Preferred"}


def recommendation_label(value: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in RECOMMENDATIONS.items() for x in pair])[value]


def stage_label(name: Column) -> Column:
    """The name of a stage as a title: candidate_aggregation is Candidate Aggregation."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def results_frame(rows: DataFrame) -> DataFrame:
    """job_id, rank, candidate, current_role, experience, fit_score, recommendation as they are shown."""
    return rows.select("job_id", "rank", F.coalesce("full_name", "candidate_id").alias("candidate"), F.coalesce("headline", F.lit("—")).alias("current_role"), F.col("total_experience_years").alias("experience"), F.col("final_score").alias("fit_score"), recommendation_label(F.col("recommendation")).alias("recommendation"))


def component_frame(rows: DataFrame) -> DataFrame:
    """job_id, candidate_id, component, score: a row for each component, in the order in which they are shown."""
    wide = rows.select("job_id", "candidate_id", *[F.col(f"components.{c}").alias(label) for c, label in COMPONENTS.items()])
    return wide.unpivot(["job_id", "candidate_id"], list(COMPONENTS.values()), "component", "score")


def evidence_frame(rows: DataFrame) -> DataFrame:
    """job_id, candidate_id, requirement, evidence, section: a row for each piece of evidence."""
    each = rows.select("job_id", "candidate_id", F.posexplode("evidence").alias("place", "e"))
    return each.select("job_id", "candidate_id", "place", F.col("e.requirement").alias("requirement"), F.col("e.evidence").alias("evidence"), F.col("e.source_section").alias("section"))


def envelope(job: DataFrame, rows: DataFrame, run: dict) -> dict:
    """One job, the run and its ranked results, as one JSON document; contact details are left out. rows are a shortlist."""
    who = job.select("job_id", "title", "company", "experience_min_years", "experience_max_years").first().asDict()
    own = rows.where(F.col("job_id") == who["job_id"]).orderBy("rank").select(
        "rank", "candidate_id", F.col("full_name").alias("candidate_name"), "headline", F.col("total_experience_years").alias("experience_years"), F.col("final_score").alias("score"), "recommendation",
        F.col("components").alias("component_scores"), "strengths", "gaps", F.col("matched").alias("matched_requirements"), F.col("missing").alias("missing_requirements"), "evidence", "reasoning", "confidence",
    )
    return {"job": who, "run": run, "results": [r.asDict(True) for r in own.collect()]}
