import json
import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import scoring, text
from quarry.functions.fuzzy import near_aliases, partial_ratio, pieces
from quarry.operators import metrics, parse
from quarry.operators.default_taxonomy import default_taxonomy
from quarry.operators.explain import flat
from quarry.operators.match import Weights
from quarry.operators.schemas import CANDIDATE, JOB, struct
from quarry.operators.taxonomy import Taxonomy
from quarry.plans.search import SearchConfig, search
from quarry.streaming.sync import sync

#: A job and three candidates whose scores are known.
JOBS = [{"job_id": "j", "title": "Senior Accountant", "experience_min_years": 3, "experience_max_years": 5, "responsibilities": ["Prepare financial statements", "Manage month-end close", "Perform account reconciliations", "Support tax and audit activities"], "required_skills": ["Financial Reporting", "Account Reconciliation", "Tax Preparation", "GAAP"], "required_software": ["Microsoft Excel", "QuickBooks"], "preferred_skills": ["Financial Modeling", "Forecasting"], "preferred_qualifications": ["Leadership experience"], "education_requirements": ["Bachelor's degree in Accounting or Finance"], "preferred_certifications": ["CPA"]}]
CANDIDATES = [
    {"candidate_id": "c1", "source_file": "a", "headline": "Senior Accountant", "professional_summary": "Accounting professional with four years of experience in financial reporting, close activities and reconciliations.", "skills": ["Financial Reporting", "Account Reconciliation", "Tax Preparation", "GAAP", "Forecasting"], "software": ["Microsoft Excel", "QuickBooks", "SAP"], "work_experience": [{"job_title": "Senior Accountant", "company": "Example Manufacturing", "duration_years": 4, "responsibilities": ["Prepared monthly financial statements", "Performed account reconciliations", "Supported year-end tax and audit requests"], "achievements": []}], "total_experience_years": 4, "education": [{"degree": "Bachelor of Science", "field_of_study": "Accounting"}]},
    {"candidate_id": "c2", "source_file": "b", "headline": "Financial Analyst", "professional_summary": "Financial analyst with three years of experience in budgeting, forecasting and management reporting.", "skills": ["Financial Modeling", "Forecasting", "Variance Analysis", "Budgeting"], "software": ["Microsoft Excel", "Power BI"], "work_experience": [{"job_title": "Financial Analyst", "company": "Example Services", "duration_years": 3, "responsibilities": ["Built forecasts", "Prepared management reports", "Analyzed budget variances"], "achievements": []}], "total_experience_years": 3, "education": [{"degree": "Bachelor of Science", "field_of_study": "Finance"}]},
    {"candidate_id": "c3", "source_file": "c", "headline": "Accounting Assistant", "professional_summary": "Junior accounting professional supporting bookkeeping and invoice processing.", "skills": ["Accounts Payable", "Bookkeeping", "Data Entry"], "software": ["Microsoft Excel"], "work_experience": [{"job_title": "Accounting Assistant", "company": "Example Retail", "duration_years": 1, "responsibilities": ["Processed invoices", "Maintained transaction records"], "achievements": []}], "total_experience_years": 1, "education": [{"degree": "Bachelor of Commerce", "field_of_study": "Accounting"}]},
]


def records(spark, rows, ddl):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").select(F.from_json("value", struct(ddl)).alias("r")).select("r.*")


def test_search_scores(spark):
    found = search(records(spark, JOBS, JOB), records(spark, CANDIDATES, CANDIDATE), default_taxonomy(), SearchConfig(retrieve=3, rerank=3, final=3)).cache()
    rows = {r.candidate_id: r for r in found.collect()}
    assert [(rows[c].rank, rows[c].final_score) for c in ("c1", "c2", "c3")] == [(1, 88.2), (2, 51.67), (3, 35.11)]
    assert rows["c1"].recommendation == "highly_recommended" and rows["c3"].recommendation == "not_recommended"
    assert "c1" in flat(found).toPandas()["candidate_id"].tolist()


def test_config_and_weights():
    with pytest.raises(ValueError):
        SearchConfig(retrieve=2, rerank=3, final=1)
    with pytest.raises(ValueError):
        Weights(semantic=0.9)


def test_duplicate_candidates_raise(spark):
    with pytest.raises(ValueError):
        search(records(spark, JOBS, JOB), records(spark, [CANDIDATES[0]] * 2, CANDIDATE), default_taxonomy())


def test_metrics(spark):
    labels = spark.createDataFrame([("j", "a", 3), ("j", "b", 0), ("j", "c", 2), ("j", "d", 1)], "job string, id string, label int")
    ranking = spark.createDataFrame([("j", x, i + 1) for i, x in enumerate("abcd")], "job string, id string, rank int")
    r = {x.k: x for x in metrics.evaluate(ranking, labels, "job", "id", [2, 4]).collect()}
    assert (r[2].precision, r[2].recall, r[2].strong_rate, r[2].reciprocal_rank) == (0.5, 0.5, 0.5, 1.0)
    assert math.isclose(r[2].average_precision, (1 + 2 / 3) / 2)
    zero = labels.withColumn("label", F.lit(0))
    assert {(x.ndcg, x.average_precision, x.reciprocal_rank) for x in metrics.evaluate(ranking, zero, "job", "id", [2]).collect()} == {(0.0, 0.0, 0.0)}
    twice = ranking.unionByName(ranking.limit(1)).unionByName(spark.createDataFrame([("j", "z", 9)], ranking.schema))
    assert {x.rule for x in metrics.invalid(twice, labels, "job", "id").collect()} == {"duplicate", "missing from benchmark"}


def test_scoring_functions(spark):
    rows = spark.createDataFrame([(4.0,), (2.0,), (6.0,), (1.0,), (7.0,), (None,)], "y double")
    assert [r[0] for r in rows.select(scoring.experience_alignment(F.col("y"), F.lit(3.0), F.lit(5.0))).collect()] == [100, 55, 88, 10, 76, 35]
    titles = spark.createDataFrame([("Senior Accountant",), ("Staff Accountant",), ("Tax Manager",), ("VP of Sales",), (None,)], "t string")
    a = [r[0] for r in titles.select(scoring.role_alignment(F.col("t"), F.lit("Senior Accountant"))).collect()]
    assert a[0] == 100 and a[0] > a[1] > a[2] > a[3] and a[4] == 30


def test_text(spark):
    own = spark.createDataFrame([("TECHNICAL SKILLS\x7f Python\x7f Financial Reporting",), ("ACHIEVEMENTS\n{generate_achievements(experience_years)}\nREFERENCES",)], "t string").withColumn("c", text.clean_extracted(F.col("t")))
    rows = own.select("c", text.bullets(F.col("c")).alias("b"), text.title_case(F.lit("o'neil mc-donald")).alias("n")).collect()
    nested = spark.range(1).select(text.clean_extracted(F.lit("a {Generate_Achievements(f(a))} b"))).first()[0]
    assert nested == "a b"
    assert rows[0].b == ["Python", "Financial Reporting"] and "generate" not in rows[1].c and rows[0].n == "O'Neil Mc-Donald"
    assert partial_ratio("accountant", "certified public accountant") == 100 and partial_ratio("financial reportng", "financial reporting") > 92


def test_blank_aliases_occur_nowhere(spark):
    own = Taxonomy.of({"concepts": {"x": {"aliases": ["日本"]}, "y": {"aliases": ["日本", "tax law"]}}})
    rows = spark.createDataFrame([("nothing here",), ("tax law here",), (None,)], "t string").select(own.hits(F.col("t"), "concept").alias("k")).collect()
    assert [r.k for r in rows] == [[], ["y"], []]
    assert [r[0] for r in spark.createDataFrame([("ab",), (None,)], "t string").select(text.contains_any(F.col("t"), ["", "b"])).collect()] == [True, None]


def test_fuzzy_containment_against_brute_force():
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (0 if x == y else 2)))
        return row[-1]

    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(1, n))) for n in (9, 25))
        short, long = sorted((a, b), key=len)
        n = len(short)
        windows = [long[max(0, i) : i + n] for i in range(1 - n, len(long))]
        best = max(100.0 * (1 - distance(short, w) / (n + len(w))) for w in windows)
        assert abs(partial_ratio(a, b) - best) < 1e-9


def test_no_near_alias_is_lost_by_its_pieces():
    import random

    r, found = random.Random(5), 0
    for _ in range(400):
        alias = "".join(r.choice("abcd ") for _ in range(r.randrange(8, 26)))
        edited = list(alias)
        for _ in range(r.randrange(4)):
            at = r.randrange(len(edited))
            edited[at : at + r.randrange(2)] = r.choice(["", "x", "ab"])
        text = "".join(r.choice("abcd ") for _ in range(r.randrange(12))) + "".join(edited) + "".join(r.choice("abcd ") for _ in range(r.randrange(12)))
        wanted = [alias] if alias not in text and partial_ratio(alias, text) >= 92 else []
        assert near_aliases(text, [(alias, pieces(alias, 92))], 92) == wanted and "".join(pieces(alias, 92)) == alias
        found += len(wanted)
    assert found > 30


def test_parsers(spark):
    resume = "JANE DOE\nSenior Accountant\nEmail: j@x.org\nLocation: Paris\nPROFESSIONAL SUMMARY\nHas 5+ years\nof work.\nTECHNICAL SKILLS\n• a\n• b\nPROFESSIONAL EXPERIENCE\nClerk | Acme | 2019 - 2020\n• did x\nand y\nBoss | Bcme | 2021\n• z\nEDUCATION\nBSc in Math\nUni | 2018\n"
    r = parse.resumes(spark.createDataFrame([("/x/Resume_3.pdf", resume), ("My File.pdf", "")], "source_file string, text string")).orderBy("candidate_id").collect()
    assert r[0].candidate_id == "my_file" and r[1].candidate_id == "resume_03" and r[1].full_name == "Jane Doe" and r[1].contact.email == "j@x.org"
    assert r[1].total_experience_years == 5.0 and r[1].skills == ["a", "b"]
    assert [(w.job_title, w.company, w.start_date, w.end_date, w.responsibilities) for w in r[1].work_experience] == [("Clerk", "Acme", "2019", "2020", ["did x and y"]), ("Boss", "Bcme", "2021", None, ["z"])]
    assert (r[1].education[0].degree, r[1].education[0].field_of_study, r[1].education[0].graduation_year) == ("BSc", "Math", 2018)
    job = "TAX CLERK POSITION\nCompany: Acme Location: Rome Employment Type: Full Salary Range: 1\nExperience Required: 3 - 5 years\nREQUIRED SKILLS\n• Bachelor degree\n• CPA preferred\n• Microsoft Excel\n• GAAP\n"
    j = parse.job_postings(spark.createDataFrame([("j", "f", job)], "job_id string, source_file string, text string")).first()
    assert (j.title, j.company, j.location, j.experience_min_years) == ("Tax Clerk", "Acme", "Rome", 3.0)
    assert (j.required_skills, j.required_software, j.education_requirements, j.preferred_certifications) == (["GAAP"], ["Microsoft Excel"], ["Bachelor degree"], ["CPA"])


def test_sync(spark):
    docs = lambda *rows: spark.createDataFrame(list(rows), "id string, text string")
    embed = lambda df: df.select(F.col("id"), F.array(F.length("text").cast("float")).alias("vector"))
    first, report = sync(None, docs(("a", "x"), ("b", "y")), "id", embed, ["text"])
    assert report == {"embedded": 2, "reused": 0, "removed": 0, "full_rebuild": True, "changed": True}
    _, report = sync(first, docs(("a", "x"), ("b", "yy")), "id", embed, ["text"])
    assert report == {"embedded": 1, "reused": 1, "removed": 0, "full_rebuild": False, "changed": True}
    _, report = sync(first, docs(("a", "x"), ("b", "yy")), "id", embed, ["text"], refit=True)
    assert report["full_rebuild"] and report["embedded"] == 2
    _, report = sync(first, docs(("a", "x"), ("b", "y")), "id", embed, ["text"])
    assert report["embedded"] == 0 and not report["changed"]


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 45
