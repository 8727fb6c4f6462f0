"""Scores of a candidate against a job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, normalize_match

#: Words of a title that place it, in the order in which they are tried.
LEVELS = [
    (0, ("intern", "recent graduate", "graduate")),
    (1, ("assistant", "junior", "associate")),
    (5, ("director", "vp", "vice president", "cfo", "chief")),
    (4, ("manager", "controller", "lead", "supervisor", "principal")),
    (3, ("senior",)),
]
FAMILIES = [("accounting", ("accountant", "accounting", "controller", "audit", "tax")), ("finance", ("financial analyst", "finance analyst", "finance"))]
TIERS = [(85.0, "highly_recommended"), (70.0, "recommended"), (55.0, "consider")]
RANK_WORDS = ("senior", "junior", "staff", "assistant", "lead")


def first_match(text: Column, rules: list, otherwise) -> Column:
    """The label of the first rule of which any needle occurs."""
    return reduce(lambda rest, rule: F.when(contains_any(text, rule[1]), F.lit(rule[0])).otherwise(rest), reversed(rules), F.lit(otherwise))


def semantic_score(similarity: Column) -> Column:
    return F.least(F.lit(100.0), F.sqrt(F.greatest(F.lit(0.0), similarity)) * 100.0)


def seniority_level(title: Column) -> Column:
    return first_match(normalize_match(F.coalesce(title, F.lit(""))), LEVELS, 2)


def role_family(title: Column) -> Column:
    return first_match(normalize_match(F.coalesce(title, F.lit(""))), FAMILIES, "other")


def role_words(title: Column) -> Column:
    words = F.filter(F.split(normalize_match(title), " "), lambda w: (w != "") & ~w.isin(*RANK_WORDS))
    return F.array_distinct(F.transform(words, lambda w: F.when(w.isin("accounting", "accountant"), F.lit("account")).otherwise(w)))


def role_alignment(title: Column, job_title: Column) -> Column:
    own, wanted = normalize_match(F.coalesce(title, F.lit(""))), normalize_match(job_title)
    a, b = role_family(title), role_family(job_title)
    family = (
        F.when(F.arrays_overlap(role_words(F.coalesce(title, F.lit(""))), role_words(job_title)), 100.0)
        .when(a == b, 60.0).when((a != "other") & (b != "other"), 58.0).otherwise(35.0)
    )
    gap = F.abs(seniority_level(title) - seniority_level(job_title))
    blended = F.round(F.lit(0.78) * family + F.lit(0.22) * F.greatest(F.lit(40.0), F.lit(100.0) - 12.0 * gap), 2)
    return F.when(own == "", 30.0).when(own == wanted, 100.0).otherwise(blended)


def experience_alignment(years: Column, least: Column, most: Column) -> Column:
    return (
        F.when(least.isNull() & most.isNull(), 100.0).when(years.isNull(), 35.0)
        .when(years < least, F.greatest(F.lit(10.0), 100.0 - 45.0 * (least - years)))
        .when(years > most, F.greatest(F.lit(45.0), 100.0 - 12.0 * (years - most))).otherwise(100.0)
    )


def education_points(text: Column, strong, related, tokens=("bachelor", "master", "mba", "degree")) -> Column:
    """Points of a degree and its field, given as normalized text."""
    return F.when(contains_any(text, strong), 100.0).when(contains_any(text, related), 85.0).when(contains_any(text, tokens), 65.0).otherwise(40.0)


def tier(score: Column) -> Column:
    return reduce(lambda rest, t: F.when(score >= t[0], F.lit(t[1])).otherwise(rest), reversed(TIERS), F.lit("not_recommended"))


def confidence(n_evidence: Column, n_matched: Column) -> Column:
    share = F.least(F.lit(1.0), F.least(n_evidence, F.lit(10)) / F.greatest(F.lit(1), n_matched))
    return F.round(F.lit(0.55) + F.lit(0.35) * share, 2)
