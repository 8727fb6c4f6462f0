"""Records, their defaults and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import dedupe_ignoring_case

JOB = """job_id string, source_file string, title string, company string, location string, employment_type string,
 experience_min_years double, experience_max_years double, responsibilities array<string>, required_skills array<string>,
 required_software array<string>, preferred_skills array<string>, preferred_qualifications array<string>,
 education_requirements array<string>, preferred_certifications array<string>, soft_skills array<string>, raw_text string"""
CANDIDATE = """candidate_id string, source_file string, full_name string, headline string, location string,
 contact struct<email:string,phone:string,linkedin:string>, professional_summary string, skills array<string>, software array<string>,
 work_experience array<struct<job_title:string,company:string,start_date:string,end_date:string,duration_years:double,responsibilities:array<string>,achievements:array<string>>>,
 total_experience_years double, education array<struct<degree:string,field_of_study:string,institution:string,graduation_year:int>>,
 certifications array<struct<name:string,issuer:string,year:int>>, achievements array<string>, raw_text string, parser_version string"""
JOB_LISTS = ["responsibilities", "required_skills", "required_software", "preferred_skills", "preferred_qualifications", "education_requirements", "preferred_certifications", "soft_skills"]
CANDIDATE_LISTS = ["skills", "software", "achievements"]


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def normalized(rows: DataFrame, lists: list[str]) -> DataFrame:
    """Strings stripped, absent lists empty, lists without blanks and repeats."""
    made = {}
    for field in rows.schema:
        if field.name in lists:
            made[field.name] = dedupe_ignoring_case(F.coalesce(F.col(field.name), F.array().cast("array<string>")))
        elif isinstance(field.dataType, T.StringType):
            made[field.name] = F.trim(F.col(field.name))
        elif isinstance(field.dataType, T.ArrayType):
            made[field.name] = F.coalesce(F.col(field.name), F.array().cast(field.dataType))
    return rows.withColumns(made)


def jobs(rows: DataFrame) -> DataFrame:
    return normalized(rows, JOB_LISTS)


def candidates(rows: DataFrame) -> DataFrame:
    return normalized(rows, CANDIDATE_LISTS)


def unknown_keys(text: Column, ddl: str) -> Column:
    """Keys of a JSON object that the record does not have."""
    return F.array_except(F.json_object_keys(text), F.lit(struct(ddl).fieldNames()))


def violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, rule: a row for each check that does not hold; a null outcome holds."""
    failed = F.filter(F.array(*[F.when(~check, F.lit(name)) for name, check in checks.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(failed).alias("rule"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
