"""Parsers of extracted résumé and job texts, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BULLET, bullets, clean_extracted, collapse, found, labelled, let, lines, sections, title_case, year, years_of_experience

#: Headings of the two layouts.
RESUME = ("PROFESSIONAL SUMMARY", "TECHNICAL SKILLS", "SOFTWARE PROFICIENCY", "PROFESSIONAL EXPERIENCE", "EDUCATION", "CERTIFICATIONS", "ACHIEVEMENTS", "REFERENCES")
JOB = ("JOB DESCRIPTION", "RESPONSIBILITIES", "REQUIRED SKILLS", "PREFERRED QUALIFICATIONS", "TECHNICAL SKILLS", "SOFT SKILLS", "BENEFITS", "ABOUT TECHFLOW SOLUTIONS", "APPLICATION PROCESS")
REQUIRED_KINDS = ["education", "dropped", "certification", "excel", "accounting_software", "skill"]
#: What required software and certificates are called, and a posting without a title.
EXCEL, ACCOUNTING_SOFTWARE, CERTIFICATE, UNTITLED = "Microsoft Excel", "Accounting software (QuickBooks, SAP, Oracle, or similar)", "CPA", "Untitled Position"


def candidate_id(source_file: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(source_file, r"([^/]*)$", 1), r"\.[^.]*$", "")
    number = F.regexp_extract(stem, r"(?i)Resume_(\d+)", 1)
    return F.when(number != "", F.format_string("resume_%02d", number.cast("long"))).otherwise(F.replace(F.lower(stem), F.lit(" "), F.lit("_")))


def work_experience(section: Column) -> Column:
    """Posts: a line with two bars or more begins one, bullets are its duties, other lines continue what stands before."""
    post = "array<struct<header:string,bullets:array<string>>>"
    start = F.struct(F.array().cast(post).alias("done"), F.lit(None).cast("string").alias("header"), F.array().cast("array<string>").alias("bullets"))
    state = lambda done, header, items: F.struct(done.alias("done"), header.alias("header"), items.alias("bullets"))
    closed = lambda s: F.when(s["header"].isNotNull(), F.concat(s["done"], F.array(F.struct(s["header"].alias("header"), s["bullets"].alias("bullets"))))).otherwise(s["done"])

    def step(s: Column, line: Column) -> Column:
        item = collapse(F.regexp_replace(line, f"^[{BULLET} ]+", ""))
        n = F.size(s["bullets"])
        longer = F.transform(s["bullets"], lambda b, i: F.when(i == n - 1, collapse(F.concat(b, F.lit(" "), line))).otherwise(b))
        empty = F.array().cast("array<string>")
        return (
            F.when(line.startswith(BULLET), state(s["done"], s["header"], F.when(item != "", F.concat(s["bullets"], F.array(item))).otherwise(s["bullets"])))
            .when(F.length(line) - F.length(F.translate(line, "|", "")) >= 2, state(closed(s), line, F.when(s["header"].isNotNull(), empty).otherwise(s["bullets"])))
            .when(s["header"].isNotNull() & (n > 0), state(s["done"], s["header"], longer))
            .when(s["header"].isNotNull(), state(s["done"], F.concat(s["header"], F.lit(" "), line), s["bullets"]))
            .otherwise(s)
        )

    def record(p: Column) -> Column:
        return let(F.transform(F.slice(F.split(p["header"], r"\|", -1), 1, 3), collapse), lambda parts: post_of(parts, p["bullets"]))

    def post_of(parts: Column, duties: Column) -> Column:
        dates = F.get(parts, F.lit(2))
        ranged = dates.contains(" - ")
        return F.struct(
            F.get(parts, F.lit(0)).alias("job_title"), F.get(parts, F.lit(1)).alias("company"), F.when(ranged, F.trim(F.split(dates, " - ", 2)[0])).otherwise(F.when(dates != "", dates)).alias("start_date"),
            F.when(ranged, F.trim(F.split(dates, " - ", 2)[1])).alias("end_date"), F.lit(None).cast("double").alias("duration_years"), duties.alias("responsibilities"), F.array().cast("array<string>").alias("achievements"),
        )

    return F.transform(F.aggregate(lines(section), start, step, closed), record)


def education(section: Column) -> Column:
    """One degree at most: its line, then institution and year."""
    none = F.array().cast("array<struct<degree:string,field_of_study:string,institution:string,graduation_year:int>>")
    split = r"(?i)^(.+?)\s+in\s+(.+)"

    def first(own: Column) -> Column:
        degree, place = F.get(own, F.lit(0)), F.get(own, F.lit(1))
        made = F.struct(
            F.coalesce(found(degree, split, 1), degree).alias("degree"), found(degree, split, 2).alias("field_of_study"),
            F.nullif(F.trim(F.split(place, r"\|", -1)[0]), F.lit("")).alias("institution"), year(place).alias("graduation_year"),
        )
        return F.when(F.size(own) > 0, F.array(made)).otherwise(none)

    return let(F.filter(lines(section), lambda x: ~F.upper(x).startswith("GPA:")), first)


def resumes(texts: DataFrame) -> DataFrame:
    """Candidates of (source_file, text)."""
    rows = texts.select("source_file", clean_extracted(F.col("text")).alias("raw_text"))
    rows = rows.withColumn("s", sections(F.col("raw_text"), RESUME)).withColumn("pre", F.coalesce(F.col("s")["PREAMBLE"], F.lit("")))
    of = lambda name: F.coalesce(F.col("s")[name], F.lit(""))
    second = F.get("head", F.lit(1))
    rows = rows.withColumns({"head": lines(F.col("pre")), "email": labelled(F.col("pre"), "Email"), "phone": labelled(F.col("pre"), "Phone"), "linkedin": labelled(F.col("pre"), "LinkedIn"), "professional_summary": F.nullif(collapse(of("PROFESSIONAL SUMMARY")), F.lit(""))})
    none = F.array().cast("array<string>")
    return rows.select(
        candidate_id(F.col("source_file")).alias("candidate_id"), "source_file", title_case(F.get("head", F.lit(0))).alias("full_name"), F.when(~F.lower(second).startswith("contact"), second).alias("headline"),
        labelled(F.col("pre"), "Location").alias("location"), F.when(F.coalesce("email", "phone", "linkedin").isNotNull(), F.struct("email", "phone", "linkedin")).alias("contact"), "professional_summary",
        bullets(of("TECHNICAL SKILLS")).alias("skills"), bullets(of("SOFTWARE PROFICIENCY")).alias("software"), work_experience(of("PROFESSIONAL EXPERIENCE")).alias("work_experience"),
        years_of_experience(F.col("professional_summary")).alias("total_experience_years"), education(of("EDUCATION")).alias("education"),
        F.transform(bullets(of("CERTIFICATIONS")), lambda c: F.struct(c.alias("name"), F.lit(None).cast("string").alias("issuer"), F.lit(None).cast("int").alias("year"))).alias("certifications"),
        F.coalesce(bullets(of("ACHIEVEMENTS")), none).alias("achievements"), "raw_text", F.lit("quarry-1").alias("parser_version"),
    )


def required_kind(item: Column) -> Column:
    """What a required item is; the first test that fits decides."""
    low = F.lower(item)
    return (
        F.when(low.contains("bachelor") | low.contains("degree"), "education").when(low.contains("years") & low.contains("experience"), "dropped")
        .when(low.contains("cpa") & low.contains("preferred"), "certification").when(low.contains("microsoft excel"), "excel")
        .when(low.contains("accounting software"), "accounting_software").otherwise("skill")
    )


def job_postings(texts: DataFrame) -> DataFrame:
    """Jobs of (job_id, source_file, text)."""
    rows = texts.select("job_id", "source_file", clean_extracted(F.col("text")).alias("raw_text"))
    rows = rows.withColumn("s", sections(F.col("raw_text"), JOB)).withColumn("pre", F.coalesce(F.col("s")["PREAMBLE"], F.lit("")))
    of = lambda name: bullets(F.coalesce(F.col("s")[name], F.lit("")))
    rows = rows.withColumn("items", F.transform(of("REQUIRED SKILLS"), lambda x: F.struct(required_kind(x).alias("kind"), x.alias("x"))))
    kind = lambda *names: F.filter("items", lambda i: i["kind"].isin(*names))
    plain = lambda items: F.transform(items, lambda i: i["x"])
    first = F.coalesce(F.get(lines(F.col("pre")), F.lit(0)), F.lit(UNTITLED))
    software = F.transform(kind("excel", "accounting_software"), lambda i: F.when(i["kind"] == "excel", EXCEL).otherwise(ACCOUNTING_SOFTWARE))
    span = r"(?i)Experience Required:\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*years"
    between = lambda a, b: found(F.col("pre"), rf"(?is){a}:\s*(.*?)\s+{b}:")
    return rows.select(
        "job_id", "source_file", title_case(F.replace(first, F.lit(" POSITION"), F.lit(""))).alias("title"), between("Company", "Location").alias("company"), between("Location", r"Employment\s+Type").alias("location"),
        between(r"Employment\s+Type", "Salary Range").alias("employment_type"), found(F.col("pre"), span, 1).cast("double").alias("experience_min_years"), found(F.col("pre"), span, 2).cast("double").alias("experience_max_years"),
        of("RESPONSIBILITIES").alias("responsibilities"), plain(kind("skill")).alias("required_skills"), software.alias("required_software"), of("TECHNICAL SKILLS").alias("preferred_skills"),
        of("PREFERRED QUALIFICATIONS").alias("preferred_qualifications"), plain(kind("education")).alias("education_requirements"), F.transform(kind("certification"), lambda i: F.lit(CERTIFICATE)).alias("preferred_certifications"),
        of("SOFT SKILLS").alias("soft_skills"), "raw_text",
    )
