"""Texts to match on, free of identity, and the catalog of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import joined
from ..functions.text import collapse, short_number


def _with(x: Column, prefix: str) -> Column:
    return F.when(x.isNotNull() & (x != ""), F.concat(F.lit(prefix), x))


def _degree(e: Column) -> Column:
    return F.concat(e["degree"], F.coalesce(_with(e["field_of_study"], " in "), F.lit("")))


def _post(e: Column) -> Column:
    return F.concat(e["job_title"], F.coalesce(_with(e["company"], " at "), F.lit("")))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _certificates() -> Column:
    return joined(F.transform("certifications", lambda c: c["name"]), ", ", "Certifications: ")


def candidate_text() -> Column:
    post = lambda e: F.concat(F.lit("Experience: "), _post(e), F.coalesce(joined(e["responsibilities"], " ", ". "), F.lit("")), F.coalesce(joined(e["achievements"], " ", ". "), F.lit("")))
    return _lines(
        _with(F.col("headline"), "Role: "), _with(F.col("professional_summary"), "Professional Summary: "),
        joined(F.col("skills"), ", ", "Skills: "), joined(F.col("software"), ", ", "Software: "),
        F.concat(F.lit("Total Experience: "), short_number(F.col("total_experience_years")), F.lit(" years")),
        joined(F.transform("work_experience", post), "\n"), joined(F.transform("education", lambda e: F.concat(F.lit("Education: "), _degree(e))), "\n"),
        _certificates(),
    )


def job_text() -> Column:
    most = F.coalesce(F.concat(F.lit(", preferred maximum "), short_number(F.col("experience_max_years")), F.lit(" years")), F.lit(""))
    return _lines(
        F.concat(F.lit("Job Title: "), F.col("title")), F.concat(F.lit("Experience: minimum "), short_number(F.col("experience_min_years")), F.lit(" years"), most),
        joined(F.col("responsibilities"), "; ", "Responsibilities: "), joined(F.col("required_skills"), ", ", "Required Skills: "),
        joined(F.col("required_software"), ", ", "Required Software: "), joined(F.col("education_requirements"), ", ", "Education: "),
        joined(F.col("preferred_skills"), ", ", "Preferred Skills: "), joined(F.col("preferred_qualifications"), ", ", "Preferred Qualifications: "),
        joined(F.col("preferred_certifications"), ", ", "Preferred Certifications: "),
    )


def retrieval_documents(candidates: DataFrame, mode: str = "full") -> DataFrame:
    """vector_id, candidate_id, section, text, headline, experience_years, source_file; one row, or one for each section that is not empty."""
    if mode not in ("full", "section"):
        raise ValueError("mode must be 'full' or 'section'")
    if mode == "full":
        made = [("full", "full_resume", candidate_text())]
    else:
        post = lambda e: F.concat(_post(e), F.coalesce(joined(e["responsibilities"], " ", ". "), F.lit("")))
        made = [
            ("summary", "summary", _lines(_with(F.col("headline"), "Role: "), _with(F.col("professional_summary"), "Professional Summary: "))),
            ("skills", "skills_software", _lines(joined(F.col("skills"), ", ", "Skills: "), joined(F.col("software"), ", ", "Software: "))),
            ("experience", "experience", joined(F.transform("work_experience", post), "\n")),
            ("education", "education_certifications", _lines(joined(F.transform("education", lambda e: F.concat(F.lit("Education: "), _degree(e))), "\n"), _certificates())),
        ]
    parts = F.array(*[F.struct(F.lit(k).alias("suffix"), F.lit(s).alias("section"), t.alias("text")) for k, s, t in made])
    kept = F.filter(parts, lambda p: F.coalesce(p["text"], F.lit("")) != "") if mode == "section" else parts
    rows = candidates.select("candidate_id", "headline", F.col("total_experience_years").alias("experience_years"), "source_file", F.explode(kept).alias("p"))
    return rows.select(F.concat_ws(":", "candidate_id", "p.suffix").alias("vector_id"), "candidate_id", "p.section", "p.text", "headline", "experience_years", "source_file")


def evidence_items() -> Column:
    """What a candidate's record says, in fixed order: an array of section and text."""
    one = lambda section, text: F.array(F.struct(F.lit(section).alias("section"), text.alias("text")))
    many = lambda section, texts: F.transform(texts, lambda t: F.struct(F.lit(section).alias("section"), t.alias("text")))
    none = F.array().cast("array<string>")
    posts = F.flatten(F.transform("work_experience", lambda e: F.concat(F.array(_post(e)), F.coalesce(e["responsibilities"], none), F.coalesce(e["achievements"], none))))
    every = F.concat(
        one("headline", F.col("headline")), one("professional_summary", F.col("professional_summary")), many("technical_skills", F.col("skills")), many("software", F.col("software")),
        one("experience", F.concat(short_number(F.col("total_experience_years")), F.lit("+ years of total experience"))), many("work_experience", posts),
        many("education", F.transform("education", _degree)), many("certifications", F.transform("certifications", lambda c: c["name"])),
    )
    return F.filter(F.transform(every, lambda r: F.struct(r["section"].alias("section"), collapse(r["text"]).alias("text"))), lambda r: F.coalesce(r["text"], F.lit("")) != "")


def evidence_catalog(candidates: DataFrame) -> DataFrame:
    """candidate_id, ord, evidence_id (E001 and on), section, text: what a candidate's record says, in fixed order."""
    rows = candidates.select("candidate_id", F.posexplode_outer(evidence_items()).alias("ord", "r")).where("ord IS NOT NULL")
    return rows.select("candidate_id", "ord", evidence_id(F.col("ord")).alias("evidence_id"), "r.section", "r.text")


def evidence_id(ord: Column) -> Column:
    return F.format_string("E%03d", ord + 1)
