"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays, scoring, text, vectors
from ..functions.fuzzy import fuzzy_aliases
from ..operators import documents, match, metrics, parse, retrieve, schemas, tfidf
from ..operators import explain as explained
from ..operators.taxonomy import Taxonomy
from ..sources import io
from ..streaming import sync as syncing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Titles that stand in for roles, picked by key.
TITLES = ["Senior Accountant", "Staff Accountant", "Tax Manager", "VP of Finance", "Financial Analyst", "Accounting Intern", "Junior Auditor", "Office Manager", "", "Controller"]
ALIASES = ["nation", "tion of the", "entre", "que le", "thtion an", "der die"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dealt(table: DataFrame, *key: str) -> DataFrame:
    """A table of which one task would read more than twice an even share is dealt to all cores by its key before costly work.

    That is so where its file has fewer parts than there are cores, or fewer row groups than parts; counts are in the files' footers.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    held = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    return _dealt_by(table, *key) if cores * max(held, default=0) > 2 * sum(held) else table


def _dealt_by(table: DataFrame, *key: str) -> DataFrame:
    """A table in few row groups, which Spark reads in as few tasks however many splits it makes: its rows are dealt to all cores by their key before costly work."""
    return table.repartition(4 * table.sparkSession.sparkContext.defaultParallelism, *key)


def _title(key: str) -> Column:
    return F.get(F.lit(TITLES), (F.col(key) % len(TITLES)).cast("int"))


_TITLE = f"([{', '.join(repr(t) for t in TITLES)}])[(p_partkey % {len(TITLES)})::INT + 1]"
_NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^a-z0-9+#.]+', ' ', 'g'))"
_GRADE = "SELECT d.lang, l.doc_id, 2 * l.quality + (1 - l.toxic) AS label, row_number() OVER (PARTITION BY d.lang ORDER BY d.n_chars DESC, d.doc_id) AS rank FROM labels l JOIN documents d USING (doc_id)"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
_COS = f"round({_DOT.format('c.embedding', 'q.embedding')} / sqrt({_DOT.format('c.embedding', 'c.embedding')}) / sqrt({_DOT.format('q.embedding', 'q.embedding')}), {retrieve.DIGITS})"


# Vectors


@query(f"""
SELECT vec_id, round(sqrt({_DOT.format('embedding', 'embedding')}), 6) AS norm,
       round(embedding[1]::DOUBLE / sqrt({_DOT.format('embedding', 'embedding')}), 6) AS first, len(embedding)::INT AS n
FROM embeddings""")  # fmt: skip
def vec_l2_normalize(spark, sf):
    unit = vectors.l2_normalized(F.col("embedding"))
    return _t(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(unit[0], 6).alias("first"), F.size("embedding").alias("n"))


def _neighbours(spark, sf, k):
    corpus = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = corpus.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.exact_top_k(asked, corpus, "query_id", "vec_id", "embedding", k).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_VEC = """
SELECT * FROM (
  SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, c.vec_id, {cos} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0))
WHERE rank <= {k}"""


@query(_VEC.format(cos=_COS, k=20))
def vec_topk(spark, sf):
    return _neighbours(spark, sf, 20)


@query(f"SELECT query_id, count(*) AS n, round(avg(score), 5) AS mean_score, max(score) AS best FROM ({_VEC.format(cos=_COS, k=3)}) GROUP BY query_id")
def vec_join_topk_per_query(spark, sf):
    return _neighbours(spark, sf, 3).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean_score"), F.max("score").alias("best"))


# TF-IDF

_STOPS = ", ".join(f"'{w}'" for w in tfidf.STOP_WORDS)
_TOKENS = f"""
w AS (SELECT kind, id, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOPS})) AS w FROM t),
g AS (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
tf AS (SELECT kind, id, term, count(*) AS tf FROM g GROUP BY ALL),
vocab AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf
  FROM tf WHERE kind = 'd' GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {tfidf.MAX_FEATURES})"""
_CORPUS = "WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),"


@query(f"{_CORPUS}{_TOKENS} SELECT term, df, tf, round(idf, 6) AS idf FROM vocab")
def tfidf_vocab_idf(spark, sf):
    return tfidf.TfidfModel.fit(_dealt(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id")).vocabulary(spark).select("term", "df", "tf", F.round("idf", 6).alias("idf"))


@query(f"""{_CORPUS}{_TOKENS},
v AS (SELECT kind, id, term, (1 + ln(tf.tf)) * idf AS w FROM tf JOIN vocab USING (term)),
u AS (SELECT kind, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY kind, id)) AS w FROM v),
s AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.w * d.w), {retrieve.DIGITS}) AS score FROM u q JOIN u d ON q.term = d.term AND q.kind = 'q' AND d.kind = 'd' GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")  # fmt: skip
def tfidf_topk(spark, sf):
    docs = _dealt(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    hits = tfidf.TfidfModel.fit(docs).search(_t(spark, sf, "benchmark"), "item_id", docs, "doc_id", 10)
    return hits.select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Candidates and jobs made from the tables


def _pick(values: list, index: Column) -> Column:
    return F.get(F.lit(values), index.cast("int"))


def _picked(values: list, index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({index})::INT + 1]"


#: What jobs ask for, picked by key, and the concepts that it is about.
TASKS, SKILLS, SOFTWARE, WISHES = ["handle gears", "hot plate work", "nothing special", "rod and ring"], ["gizmo", "anvil", "cold"], ["Brand#1", "Brand#2", ""], ["small things", "new or promo", ""]
CONCEPTS = {
    "concepts": {"gears": {"label": "Gears", "weight": 1.5, "aliases": ["gear", "gizmo"]}, "rods": {"label": "Rods", "weight": 1.0, "aliases": ["rod", "Ring"]}, "heat": {"label": "Heat", "weight": 0.5, "aliases": ["hot", "cold"]}, "metal": {"weight": 1.2, "aliases": ["plate", "anvil", "日本"]}},
    "software_groups": {"ones": {"label": "Ones", "aliases": ["brand#1"]}, "twos": {"label": "Twos", "aliases": ["brand#2"]}},
    "preferred_criteria": {"fresh": {"label": "Fresh", "aliases": ["new", "promo"]}, "small": {"label": "Small", "aliases": ["small"]}},
    "education_fields": {"strong": ["economy", "medium"], "related": ["small"]},
}


def _people(spark, sf):
    """A candidate of each part."""
    none, own = F.array().cast("array<string>"), F.col
    some = lambda condition, array, kind: F.when(condition, array).otherwise(F.array().cast(kind))
    post = F.array(F.struct(own("p_type").alias("job_title"), own("p_brand").alias("company"), F.lit(None).cast("string").alias("start_date"), F.lit(None).cast("string").alias("end_date"), F.lit(None).cast("double").alias("duration_years"), F.array("p_name", "p_type").alias("responsibilities"), F.array("p_brand").alias("achievements")))
    degree = F.array(F.struct(F.lit("BSc").alias("degree"), own("p_type").alias("field_of_study"), F.lit(None).cast("string").alias("institution"), F.lit(None).cast("int").alias("graduation_year")))
    certificate = F.array(F.struct(F.lit("CPA").alias("name"), F.lit(None).cast("string").alias("issuer"), F.lit(None).cast("int").alias("year")))
    kinds = {f.name: f.dataType.simpleString() for f in schemas.struct(schemas.CANDIDATE)}
    made = {
        "candidate_id": F.concat(F.lit("p"), "p_partkey"), "source_file": F.lit("part"), "full_name": F.col("p_name"), "headline": F.nullif(_title("p_partkey"), F.lit("")), "location": F.lit(None).cast("string"),
        "contact": F.lit(None).cast(kinds["contact"]), "professional_summary": F.when(own("p_size") > 10, own("p_type")), "skills": F.split("p_name", " "), "software": some(own("p_size") % 2 == 0, F.array("p_brand"), "array<string>"),
        "work_experience": some(own("p_size") > 25, post, kinds["work_experience"]), "total_experience_years": own("p_size").cast("double"), "education": some(own("p_size") % 3 == 0, degree, kinds["education"]),
        "certifications": some(own("p_size") % 5 == 0, certificate, kinds["certifications"]), "achievements": none, "raw_text": F.lit(""), "parser_version": F.lit("1"),
    }
    return _dealt_by(_t(spark, sf, "part"), "p_partkey").select(*[v.alias(k) for k, v in made.items()])


def _jobs(spark, sf):
    """A job of each nation."""
    n = F.col("n_nationkey")
    none = F.array().cast("array<string>")
    named = lambda x: F.when(x != "", F.array(x)).otherwise(none)
    made = {
        "job_id": F.concat(F.lit("n"), n), "source_file": F.lit("nation"), "title": F.lit("Senior Accountant"), "company": F.lit(None).cast("string"), "location": F.lit(None).cast("string"), "employment_type": F.lit(None).cast("string"),
        "experience_min_years": (F.col("n_regionkey") * 5).cast("double"), "experience_max_years": F.when(n % 4 != 0, (F.col("n_regionkey") * 5 + 10).cast("double")),
        "responsibilities": F.array(_pick(TASKS, n % 4)), "required_skills": F.array(_pick(SKILLS, n % 3)), "required_software": named(_pick(SOFTWARE, n % 3)), "preferred_skills": named(_pick(WISHES, (n + 1) % 3)),
        "preferred_qualifications": none, "education_requirements": F.when(n % 2 == 0, F.array(F.lit("Bachelor"))).otherwise(none), "preferred_certifications": none, "soft_skills": none, "raw_text": F.lit(""),
    }
    return _t(spark, sf, "nation").select(*[v.alias(k) for k, v in made.items()])


_HEADLINE = f"nullif({_TITLE}, '')"
_PIECES = f"""
SELECT 'p' || p_partkey AS candidate_id, p_partkey, {_HEADLINE} AS headline, p_size, p_type,
  CASE WHEN {_HEADLINE} IS NOT NULL THEN 'Role: ' || {_HEADLINE} END AS role, CASE WHEN p_size > 10 THEN 'Professional Summary: ' || p_type END AS summary, 'Skills: ' || replace(p_name, ' ', ', ') AS skills,
  CASE WHEN p_size % 2 = 0 THEN 'Software: ' || p_brand END AS software, CASE WHEN p_size > 25 THEN p_type || ' at ' || p_brand || '. ' || p_name || ' ' || p_type END AS post,
  CASE WHEN p_size % 3 = 0 THEN 'Education: BSc in ' || p_type END AS degree, CASE WHEN p_size % 5 = 0 THEN 'Certifications: CPA' END AS certificate, p_brand FROM part"""
_CATALOG = f"""
SELECT candidate_id, p_partkey, unnest(range(len(l))) AS ord, unnest(l).section AS section, unnest(l).text AS text FROM (
  SELECT 'p' || p_partkey AS candidate_id, p_partkey, list_filter([{{'section': 'headline', 'text': {_HEADLINE}}}, {{'section': 'professional_summary', 'text': CASE WHEN p_size > 10 THEN p_type END}},
    {{'section': 'technical_skills', 'text': split_part(p_name, ' ', 1)}}, {{'section': 'technical_skills', 'text': split_part(p_name, ' ', 2)}}, {{'section': 'software', 'text': CASE WHEN p_size % 2 = 0 THEN p_brand END}},
    {{'section': 'experience', 'text': p_size || '+ years of total experience'}}, {{'section': 'work_experience', 'text': CASE WHEN p_size > 25 THEN p_type || ' at ' || p_brand END}},
    {{'section': 'work_experience', 'text': CASE WHEN p_size > 25 THEN p_name END}}, {{'section': 'work_experience', 'text': CASE WHEN p_size > 25 THEN p_type END}}, {{'section': 'work_experience', 'text': CASE WHEN p_size > 25 THEN p_brand END}},
    {{'section': 'education', 'text': CASE WHEN p_size % 3 = 0 THEN 'BSc in ' || p_type END}}, {{'section': 'certifications', 'text': CASE WHEN p_size % 5 = 0 THEN 'CPA' END}}], lambda x: x.text IS NOT NULL) AS l FROM part)"""


# Retrieval, documents, evidence


@query("""
WITH h AS (SELECT conv_id, role || ':' || turn AS section, least(1.0, length(text) / 2000.0) AS score FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, section) AS n FROM h)
SELECT conv_id, round(0.7 * max(score) + 0.3 * avg(score) FILTER (n <= 3), 6) AS retrieval_score, max(section) FILTER (n = 1) AS best_section, count(*) AS n_hits
FROM r GROUP BY conv_id""")
def section_aggregate(spark, sf):
    hits = _t(spark, sf, "conversations").select("conv_id", F.concat_ws(":", "role", "turn").alias("section"), F.least(F.lit(1.0), F.length("text") / 2000.0).alias("score"))
    return retrieve.aggregate_sections(hits, ["conv_id"]).select("conv_id", F.round("retrieval_score", 6).alias("retrieval_score"), "best_section", "n_hits")


@query(f"""SELECT candidate_id, concat_ws(chr(10), role, summary, skills, software, 'Total Experience: ' || p_size || ' years', 'Experience: ' || post || '. ' || p_brand, degree, certificate) AS text FROM ({_PIECES})""")
def match_text(spark, sf):
    return _people(spark, sf).select("candidate_id", documents.candidate_text().alias("text"))


_EXPERIENCE_ASKED = "'Experience: minimum ' || 5 * n_regionkey || ' years' || CASE WHEN n_nationkey % 4 <> 0 THEN ', preferred maximum ' || (5 * n_regionkey + 10) || ' years' ELSE '' END"


@query(f"""
SELECT 'n' || n_nationkey AS job_id, concat_ws(chr(10), 'Job Title: Senior Accountant', {_EXPERIENCE_ASKED}, 'Responsibilities: ' || {_picked(TASKS, "n_nationkey % 4")}, 'Required Skills: ' || {_picked(SKILLS, "n_nationkey % 3")},
  'Required Software: ' || nullif({_picked(SOFTWARE, "n_nationkey % 3")}, ''), CASE WHEN n_nationkey % 2 = 0 THEN 'Education: Bachelor' END, 'Preferred Skills: ' || nullif({_picked(WISHES, "(n_nationkey + 1) % 3")}, '')) AS text FROM nation""")  # fmt: skip
def job_match_text(spark, sf):
    return _jobs(spark, sf).select("job_id", documents.job_text().alias("text"))


@query(f"""
WITH p AS ({_PIECES})
SELECT candidate_id || ':summary' AS vector_id, candidate_id, 'summary' AS section, concat_ws(chr(10), role, summary) AS text, headline, p_size::DOUBLE AS experience_years FROM p WHERE role IS NOT NULL OR summary IS NOT NULL
UNION ALL SELECT candidate_id || ':skills', candidate_id, 'skills_software', concat_ws(chr(10), skills, software), headline, p_size FROM p
UNION ALL SELECT candidate_id || ':experience', candidate_id, 'experience', post, headline, p_size FROM p WHERE post IS NOT NULL
UNION ALL SELECT candidate_id || ':education', candidate_id, 'education_certifications', concat_ws(chr(10), degree, certificate), headline, p_size FROM p WHERE degree IS NOT NULL OR certificate IS NOT NULL""")
def section_explode(spark, sf):
    return documents.retrieval_documents(_people(spark, sf), "section").drop("source_file")


@query(f"""SELECT candidate_id || ':full' AS vector_id, candidate_id, 'full_resume' AS section, length(concat_ws(chr(10), role, summary, skills, software, 'Total Experience: ' || p_size || ' years', 'Experience: ' || post || '. ' || p_brand, degree, certificate))::INT AS n FROM ({_PIECES})""")
def full_documents(spark, sf):
    return documents.retrieval_documents(_people(spark, sf)).select("vector_id", "candidate_id", "section", F.length("text").alias("n"))


@query(f"SELECT candidate_id, ord::INT AS ord, 'E' || lpad((ord + 1)::VARCHAR, 3, '0') AS evidence_id, section, text FROM ({_CATALOG})")
def evidence_catalog(spark, sf):
    return documents.evidence_catalog(_people(spark, sf))


@query("SELECT p_partkey, p_name AS preamble, p_type AS summary, p_brand AS skills, CASE WHEN p_size > 25 THEN 'size ' || p_size END AS education FROM part")
def split_sections(spark, sf):
    made = F.concat(F.lit("\n"), "p_name", F.lit("\nPROFESSIONAL SUMMARY\nlost\nPROFESSIONAL SUMMARY  \n"), "p_type", F.lit("\nTECHNICAL SKILLS\n"), "p_brand", F.when(F.col("p_size") > 25, F.concat(F.lit("\nEDUCATION\nsize "), "p_size")).otherwise(F.lit("")))
    rows = _t(spark, sf, "part").select("p_partkey", text.sections(made, ("PROFESSIONAL SUMMARY", "TECHNICAL SKILLS", "EDUCATION")).alias("s"))
    return rows.select("p_partkey", *[F.col("s")[k].alias(n) for k, n in (("PREAMBLE", "preamble"), ("PROFESSIONAL SUMMARY", "summary"), ("TECHNICAL SKILLS", "skills"), ("EDUCATION", "education"))])


@query(r"""
SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '\r\n?', chr(10), 'g'), chr(127), chr(10) || '• ', 'g'), '[●▪◦]', '•', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS sha
FROM pages""")
def normalize_text(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.sha2(text.clean_extracted(F.col("html")), 256).alias("sha"))


@query(f"SELECT doc_id, sha256({_NORM.format('text')}) AS sha FROM documents")
def normalize_match(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.sha2(text.normalize_match(F.col("text")), 256).alias("sha"))


@query(r"""
SELECT doc_id, len(b)::INT AS n, sha256(array_to_string(b, '|')) AS sha FROM (
  SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', '•'), '•')[2:], lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM documents)""")
def extract_bullets(spark, sf):
    own = text.bullets(F.replace("text", F.lit(". "), F.lit("•")))
    return _t(spark, sf, "documents").select("doc_id", F.size(own).alias("n"), F.sha2(F.array_join(own, "|"), 256).alias("sha"))


@query(r"""
SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', 0), '') AS email, nullif(regexp_extract(text, '(\+?\d[\d -]{7,}\d)', 1), '') AS phone FROM documents""")
def extract_contact_regex(spark, sf):
    own = F.col("text")
    return _t(spark, sf, "documents").select("doc_id", text.found(own, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", 0).alias("email"), text.found(own, r"(\+?\d[\d -]{7,}\d)").alias("phone"))


@query(r"SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(url || ' seen 1999', '\b(19\d{2}|20\d{2})\b', 1), '') AS INT), 0) AS year FROM pages")
def year_extract(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.coalesce(text.year(F.concat("url", F.lit(" seen 1999"))), F.lit(0)).alias("year"))


# Classification and scores

_ITEMS = ["Bachelor degree", "5 years of experience", "CPA preferred", "Microsoft Excel", "Accounting software", "years of Excel", "GAAP"]
_ITEM = f"([{', '.join(repr(t) for t in _ITEMS)}])[(p_partkey % {len(_ITEMS)})::INT + 1]"


@query(f"""
SELECT p_brand, kind, count(*) AS n FROM (SELECT p_brand, CASE WHEN contains(i, 'bachelor') OR contains(i, 'degree') THEN 'education' WHEN contains(i, 'years') AND contains(i, 'experience') THEN 'dropped'
  WHEN contains(i, 'cpa') AND contains(i, 'preferred') THEN 'certification' WHEN contains(i, 'microsoft excel') THEN 'excel' WHEN contains(i, 'accounting software') THEN 'accounting_software' ELSE 'skill' END AS kind
  FROM (SELECT p_brand, lower({_ITEM}) AS i FROM part)) GROUP BY ALL""")  # fmt: skip
def classify_first_match(spark, sf):
    item = F.get(F.lit(_ITEMS), (F.col("p_partkey") % len(_ITEMS)).cast("int"))
    return _t(spark, sf, "part").groupBy("p_brand", parse.required_kind(item).alias("kind")).agg(F.count("*").alias("n"))


_HIT = " OR ".join(f"contains({_NORM.format('text')}, '{a}')" for a in ALIASES)


@query(f"SELECT doc_id FROM documents WHERE {_HIT}")
def alias_semi_join(spark, sf):
    return _t(spark, sf, "documents").where(text.contains_any(text.normalize_match(F.col("text")), ALIASES)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE NOT ({_HIT})")
def alias_missing_anti(spark, sf):
    return _t(spark, sf, "documents").where(~text.contains_any(text.normalize_match(F.col("text")), ALIASES)).select("doc_id")


@query()
def fuzzy_alias(spark, sf):
    rows = _t(spark, sf, "part").select("p_partkey", text.normalize_match(F.col("p_name")).alias("t"))
    return rows.select("p_partkey", F.explode(fuzzy_aliases(F.col("t"), ["small ringg", "red widgett", "blue boltts", "large gearr"])).alias("alias"))


@query("SELECT l_orderkey, round(100.0 * coalesce(sum(l_quantity) FILTER (l_discount > 0.05), 0) / sum(l_quantity), 6) AS score FROM lineitem GROUP BY l_orderkey")
def weighted_coverage(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(match.coverage(F.col("l_discount") > 0.05, F.col("l_quantity")), 6).alias("score"))


@query("SELECT l_orderkey, round(100.0 * avg((l_discount > 0.05)::INT), 6) AS score FROM lineitem GROUP BY l_orderkey")
def unweighted_coverage(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(match.coverage(F.col("l_discount") > 0.05), 6).alias("score"))


@query("SELECT l_orderkey, round(coalesce(100.0 * avg((l_discount > 0.05)::INT) FILTER (l_quantity > 30), 50.0), 6) AS score FROM lineitem GROUP BY l_orderkey")
def preferred_coverage(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(match.coverage(F.col("l_discount") > 0.05, where=F.col("l_quantity") > 30, absent=50.0), 6).alias("score"))


@query(f"""
SELECT p_brand, max(points) AS points, (array_agg(p_partkey ORDER BY points DESC, p_partkey))[1] AS best FROM (
  SELECT p_brand, p_partkey, CASE WHEN contains(t, 'tin') OR contains(t, 'nickel') THEN 100.0 WHEN contains(t, 'brass') THEN 85.0 WHEN contains(t, 'steel') THEN 65.0 ELSE 40.0 END::DOUBLE AS points
  FROM (SELECT p_brand, p_partkey, {_NORM.format('p_type')} AS t FROM part)) GROUP BY p_brand""")  # fmt: skip
def education_score(spark, sf):
    points = scoring.education_points(text.normalize_match(F.col("p_type")), ("tin", "nickel"), ("brass",), ("steel",))
    return _t(spark, sf, "part").withColumn("points", points).groupBy("p_brand").agg(F.max("points").alias("points"), F.max_by("p_partkey", F.struct("points", -F.col("p_partkey"))).alias("best"))


@query("""
SELECT conv_id, (array_agg(turn ORDER BY CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 99 END, turn))[1] AS turn,
       (array_agg(role ORDER BY CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 99 END, turn))[1] AS role FROM conversations GROUP BY conv_id""")
def best_evidence_argmin(spark, sf):
    best = match.preferred_item(F.struct("turn", "role"), F.col("role"), F.col("turn"), {"assistant": 0, "user": 1})
    return _t(spark, sf, "conversations").groupBy("conv_id").agg(best.alias("b")).select("conv_id", "b.turn", "b.role")


def _case(rules, otherwise, x="t"):
    whens = " ".join(f"WHEN {' OR '.join(f'contains({x}, {n!r})' for n in needles)} THEN {label!r}" for label, needles in rules)
    return f"CASE {whens} ELSE {otherwise!r} END"


_TT = _NORM.format(_TITLE)


@query(f"SELECT p_partkey, {_case(scoring.LEVELS, 2)} AS level FROM (SELECT p_partkey, {_TT} AS t FROM part)")
def seniority_level(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", scoring.seniority_level(_title("p_partkey")).alias("level"))


@query(f"SELECT p_partkey, {_case(scoring.FAMILIES, 'other')} AS family FROM (SELECT p_partkey, {_TT} AS t FROM part)")
def role_family(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", scoring.role_family(_title("p_partkey")).alias("family"))


_ROLE = f"""
SELECT p_partkey, p_size, CASE WHEN t = '' THEN 30.0 WHEN t = 'senior accountant' THEN 100.0 ELSE round(0.78 * f + 0.22 * greatest(40.0, 100.0 - 12.0 * abs(level - 3)), 2) END::DOUBLE AS role
FROM (SELECT *, CASE WHEN list_has_any(list_transform(string_split(t, ' '), lambda w: CASE WHEN w IN ('accounting', 'accountant') THEN 'account' ELSE w END), ['account']) THEN 100.0 WHEN family = 'accounting' THEN 60.0 WHEN family = 'finance' THEN 58.0 ELSE 35.0 END AS f
  FROM (SELECT p_partkey, p_size, t, {_case(scoring.LEVELS, 2)} AS level, {_case(scoring.FAMILIES, 'other')} AS family FROM (SELECT p_partkey, p_size, {_TT} AS t FROM part)))"""  # fmt: skip
_EXPERIENCE = "CASE WHEN p_size < 20 THEN greatest(10.0, 100.0 - 45.0 * (20 - p_size)) WHEN p_size > 30 THEN greatest(45.0, 100.0 - 12.0 * (p_size - 30)) ELSE 100.0 END::DOUBLE"


def _role():
    return scoring.role_alignment(_title("p_partkey"), F.lit("Senior Accountant"))


def _experience():
    return scoring.experience_alignment(F.col("p_size").cast("double"), F.lit(20.0), F.lit(30.0))


@query(f"SELECT p_partkey, role FROM ({_ROLE})")
def role_alignment(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", _role().alias("role"))


@query(f"SELECT p_partkey, {_EXPERIENCE} AS experience FROM part")
def experience_alignment(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", _experience().alias("experience"))


@query("SELECT vec_id, round(least(100.0, sqrt(greatest(0.0, embedding[1]::DOUBLE)) * 100.0), 6) AS semantic FROM embeddings")
def semantic_score(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", F.round(scoring.semantic_score(F.col("embedding")[0].cast("double")), 6).alias("semantic"))


_SCORED = f"""
SELECT r.p_partkey, p.p_brand, p.p_size, round(0.25 * sqrt((p.p_partkey % 97) / 97.0) * 100.0 + 0.30 * (p.p_partkey % 11) * 10.0 + 0.15 * ({_EXPERIENCE.replace('p_size', 'p.p_size')}) + 0.20 * r.role + 0.10 * 50.0, 4) AS final_score
FROM ({_ROLE}) r JOIN part p USING (p_partkey)"""


def _scored(spark, sf):
    semantic = scoring.semantic_score((F.col("p_partkey") % 97) / F.lit(97.0))
    total = F.lit(0.25) * semantic + F.lit(0.30) * (F.col("p_partkey") % 11) * 10.0 + F.lit(0.15) * _experience() + F.lit(0.20) * _role() + F.lit(0.10) * 50.0
    return _t(spark, sf, "part").select("p_partkey", "p_brand", "p_size", F.round(total, 4).alias("final_score"))


@query(f"SELECT * FROM (SELECT p_brand, p_partkey, final_score, row_number() OVER (PARTITION BY p_brand ORDER BY final_score DESC, p_partkey) AS rank FROM ({_SCORED})) WHERE rank <= 20")
def hybrid_score_rank(spark, sf):
    return retrieve.top_k(_scored(spark, sf), "p_brand", "p_partkey", 20, "final_score").select("p_brand", "p_partkey", "final_score", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH s AS ({_SCORED}), a AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY final_score DESC, p_partkey) AS m FROM a WHERE n <= 20)
SELECT p_brand, p_partkey, final_score, m AS rank FROM b WHERE m <= 5""")  # fmt: skip
def cascade_topk(spark, sf):
    rows = retrieve.cascade(_scored(spark, sf), "p_brand", "p_partkey", [("p_size", 20), ("final_score", 10), ("final_score", 5)])
    return rows.select("p_brand", "p_partkey", "final_score", F.col("rank").cast("long").alias("rank"))


_TIER = "CASE WHEN final_score >= 85 THEN 'highly_recommended' WHEN final_score >= 70 THEN 'recommended' WHEN final_score >= 55 THEN 'consider' ELSE 'not_recommended' END"


@query(f"SELECT {_TIER} AS recommendation, count(*) AS n, round(avg(final_score), 4) AS mean_score FROM ({_SCORED}) GROUP BY 1")
def recommendation_tier(spark, sf):
    return _scored(spark, sf).groupBy(scoring.tier(F.col("final_score")).alias("recommendation")).agg(F.count("*").alias("n"), F.round(F.avg("final_score"), 4).alias("mean_score"))


@query("SELECT l_orderkey, round(0.55 + 0.35 * least(1.0, least(count(*), 10) / greatest(1, sum((l_quantity > 20)::INT))), 2) AS confidence FROM lineitem WHERE l_discount > 0.02 GROUP BY l_orderkey")
def confidence(spark, sf):
    rows = _t(spark, sf, "lineitem").where("l_discount > 0.02").groupBy("l_orderkey").agg(F.count("*").alias("e"), F.sum((F.col("l_quantity") > 20).cast("int")).alias("m"))
    return rows.select("l_orderkey", scoring.confidence(F.col("e"), F.col("m")).alias("confidence"))


def _results(spark, sf):
    return _scored(spark, sf).select("p_partkey", F.col("p_size").cast("double").alias("total_experience_years"), _title("p_partkey").alias("headline"), "final_score", scoring.tier(F.col("final_score")).alias("recommendation"))


@query(f"""
SELECT p_partkey, final_score FROM (SELECT s.p_partkey, final_score, p_size, {_TIER} AS rec, {_TITLE.replace('p_partkey', 's.p_partkey')} AS headline FROM ({_SCORED}) s)
WHERE final_score >= 50 AND rec IN ('recommended', 'consider') AND contains(lower(headline), 'account') AND p_size BETWEEN 5 AND 40""")  # fmt: skip
def result_filter(spark, sf):
    return explained.filter_results(_results(spark, sf), min_score=50, recommendations=("recommended", "consider"), role="Account", min_years=5, max_years=40).select("p_partkey", "final_score")


# Ranking metrics


def _ranked(spark, sf):
    rows = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    rows = rows.withColumn("label", 2 * F.col("quality") + (1 - F.col("toxic")))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))), rows.select("lang", "doc_id", "label")


def _evaluated(spark, sf):
    ranked, labels = _ranked(spark, sf)
    return metrics.evaluate(ranked.select("lang", "doc_id", "rank"), labels, "lang", "doc_id", [5, 10, 20])


_KS = "(SELECT unnest([5, 10, 20]) AS k)"


@query(f"""
WITH r AS ({_GRADE}) SELECT lang, k, round(sum((label >= 2 AND rank <= k)::INT) / sum((rank <= k)::INT), 6) AS precision,
  round(coalesce(sum((label >= 2 AND rank <= k)::INT) / nullif(sum((label >= 2)::INT), 0), 0), 6) AS recall, round(sum((label = 3 AND rank <= k)::INT) / sum((rank <= k)::INT), 6) AS strong_rate
FROM r, {_KS} GROUP BY lang, k""")  # fmt: skip
def precision_recall_strong_at_k(spark, sf):
    return metrics.rounded(_evaluated(spark, sf)).select("lang", "k", "precision", "recall", "strong_rate")


@query(f"WITH r AS ({_GRADE}) SELECT lang, round(coalesce(1.0 / min(rank) FILTER (label >= 2), 0), 6) AS reciprocal_rank FROM r GROUP BY lang")
def reciprocal_rank(spark, sf):
    return _evaluated(spark, sf).where("k = 5").transform(metrics.rounded).select("lang", "reciprocal_rank")


@query(f"""
WITH r AS ({_GRADE}), c AS (SELECT *, sum((label >= 2)::INT) OVER (PARTITION BY lang ORDER BY rank) AS seen FROM r)
SELECT lang, round(coalesce(sum(seen / rank) FILTER (label >= 2) / nullif(sum((label >= 2)::INT), 0), 0), 6) AS average_precision FROM c GROUP BY lang""")  # fmt: skip
def average_precision(spark, sf):
    return _evaluated(spark, sf).where("k = 5").transform(metrics.rounded).select("lang", "average_precision")


@query(f"""
WITH r AS ({_GRADE}), i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY label DESC, doc_id) AS n FROM r)
SELECT lang, k, round(coalesce(sum((2 ** label - 1) / log2(rank + 1)) FILTER (rank <= k) / nullif(sum((2 ** label - 1) / log2(n + 1)) FILTER (n <= k), 0), 0), 6) AS ndcg
FROM i, {_KS} GROUP BY lang, k""")  # fmt: skip
def ndcg_at_k(spark, sf):
    return metrics.rounded(_evaluated(spark, sf)).select("lang", "k", "ndcg")


@query(f"SELECT l.label::INT AS label, count(r.doc_id) AS n FROM (SELECT unnest([0, 1, 2, 3]) AS label) l LEFT JOIN ({_GRADE}) r ON l.label = r.label GROUP BY 1")
def label_distribution(spark, sf):
    return metrics.label_counts(_ranked(spark, sf)[1])


@query("""
WITH r AS (SELECT l.doc_id, l.quality, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, l.doc_id) AS by_length, row_number() OVER (PARTITION BY lang ORDER BY l.doc_id) AS by_id FROM labels l JOIN documents d USING (doc_id)) SELECT * FROM r""")
def ranking_pivot(spark, sf):
    rows = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    ranks = lambda name, *order: rows.select(F.lit(name).alias("experiment"), "doc_id", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long").alias("rank"))
    both = ranks("by_length", F.desc("n_chars"), "doc_id").unionByName(ranks("by_id", "doc_id"))
    return metrics.compare(both, rows.select("doc_id", "quality"), "doc_id", ["by_length", "by_id"])


@query("""
SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def label_candidate_setdiff(spark, sf):
    return metrics.key_differences(_t(spark, sf, "documents"), _t(spark, sf, "labels"), "doc_id")


@query()
def random_baseline(spark, sf):
    _, labels = _ranked(spark, sf)
    return metrics.random_baseline(labels, "lang", "doc_id", [5, 10, 20])


# Quality, export, index


@query("SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return schemas.duplicates(_t(spark, sf, "documents").select(F.sha2("text", 256).alias("sha")), "sha")


@query("""
WITH w AS (SELECT item_id, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), ' ') AS words FROM w""")
def ci_dedupe_array(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", F.array_join(arrays.dedupe_ignoring_case(F.split("text", " ")), " ").alias("words"))


@query("SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY ALL")
def evidence_dedupe(spark, sf):
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return rows.select("conv_id", F.explode(arrays.first_by(F.col("r"), "role")).alias("r")).select("conv_id", "r.role", "r.turn")


@query("""SELECT n_nationkey, '{"id":' || n_nationkey || ',"name":"' || n_name || '","region":{"id":' || n_regionkey || ',"note":null}}' AS json FROM nation""")
def to_json_rows(spark, sf):
    row = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("id"), F.lit(None).cast("string").alias("note")).alias("region"))
    return _t(spark, sf, "nation").select("n_nationkey", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


_DIGEST = """sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}')"""


@query(f"SELECT doc_id, {_DIGEST} AS digest FROM documents")
def doc_fingerprint(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", syncing.fingerprint("source", "lang", "n_chars").alias("digest"))


@query("""
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.d <> b.d THEN 'changed' ELSE 'unchanged' END AS change
FROM (SELECT doc_id, n_chars AS d FROM documents WHERE lang <> 'fr') a
FULL JOIN (SELECT doc_id, CASE WHEN n_chars > 2000 THEN n_chars + 1 ELSE n_chars END AS d FROM documents WHERE lang <> 'de') b ON a.doc_id = b.doc_id""")
def index_diff(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    old = docs.where("lang <> 'fr'").select("doc_id", F.col("n_chars").alias("digest"))
    new = docs.where("lang <> 'de'").select("doc_id", F.expr("CASE WHEN n_chars > 2000 THEN n_chars + 1 ELSE n_chars END").alias("digest"))
    return syncing.difference(old, new, "doc_id")


@query("""
SELECT o_orderkey, 'price' AS rule FROM orders WHERE NOT (o_totalprice BETWEEN 10000 AND 400000) UNION ALL
SELECT o_orderkey, 'status' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def quality_violations(spark, sf):
    return schemas.violations(_t(spark, sf, "orders"), "o_orderkey", {"price": F.col("o_totalprice").between(10000, 400000), "status": F.col("o_orderstatus").isin("O", "F")})


# Matching, explanations and parsing over the candidates and jobs


def _concepts() -> Taxonomy:
    return Taxonomy.of(CONCEPTS)


def _values(kinds=("concept", "software", "preferred")) -> str:
    """The concepts as SQL rows, one for each alias that normalizing leaves something of."""
    from ..operators.taxonomy import _normalized

    rows = [(c.kind, c.key, i, c.label, c.weight, _normalized(a)) for i, c in enumerate(_concepts().concepts) for a in c.aliases if c.kind in kinds and _normalized(a)]
    return "(VALUES " + ", ".join(str(r) for r in rows) + ") AS t(kind, key, seq, label, weight, alias)"


_ASKS = f"""
SELECT job_id, kind, key, seq, label, weight FROM (
  SELECT 'n' || n_nationkey AS job_id, unnest([{{'kind': 'concept', 't': {_NORM.format(_picked(TASKS, "n_nationkey % 4") + " || ' ' || " + _picked(SKILLS, "n_nationkey % 3"))}}}, {{'kind': 'software', 't': {_NORM.format(_picked(SOFTWARE, "n_nationkey % 3"))}}},
    {{'kind': 'preferred', 't': {_NORM.format(_picked(WISHES, "(n_nationkey + 1) % 3"))}}}]) AS a FROM nation) JOIN {_values()} ON a.kind = kind AND contains(a.t, alias) GROUP BY ALL"""


@query(f"SELECT job_id, kind, key, seq::INT AS seq, label, weight::DOUBLE AS weight FROM ({_ASKS})")
def required_concepts(spark, sf):
    return match.requirements(_jobs(spark, sf), _concepts(), fuzzy=False)


_BEST = f"""
SELECT candidate_id, kind, key, arg_min({{'evidence_id': 'E' || lpad((ord + 1)::VARCHAR, 3, '0'), 'text': text, 'section': section}}, pr * 1000 + ord) AS item FROM (
  SELECT *, CASE section WHEN 'technical_skills' THEN 0 WHEN 'software' THEN 1 WHEN 'certifications' THEN 2 WHEN 'work_experience' THEN 3 WHEN 'education' THEN 4 WHEN 'headline' THEN 5 WHEN 'experience' THEN 6 WHEN 'professional_summary' THEN 7 ELSE 99 END AS pr
  FROM ({_CATALOG})) JOIN {_values()} ON contains({_NORM.format('text')}, alias) GROUP BY ALL"""


@query(f"SELECT candidate_id, kind, key, item.evidence_id AS evidence_id, item.text AS evidence, item.section AS source_section FROM ({_BEST.replace('GROUP BY ALL', 'GROUP BY candidate_id, kind, key')})")
def best_evidence(spark, sf):
    rows = match.best_evidence(_people(spark, sf), _concepts(), fuzzy=False)
    return rows.select("candidate_id", "kind", "key", "item.evidence_id", "item.evidence", "item.source_section")


_DEGREES = f"""
SELECT d.candidate_id, points, label, e.evidence_id FROM (
  SELECT 'p' || p_partkey AS candidate_id, CASE WHEN p_type IN ('ECONOMY', 'MEDIUM') THEN 100.0 WHEN p_type = 'SMALL' THEN 85.0 ELSE 40.0 END::DOUBLE AS points, 'Relevant education (BSc in ' || p_type || ')' AS label FROM part WHERE p_size % 3 = 0) d
LEFT JOIN (SELECT candidate_id, 'E' || lpad((min(ord) + 1)::VARCHAR, 3, '0') AS evidence_id FROM ({_CATALOG}) WHERE section = 'education' AND contains(lower(text), 'bsc') GROUP BY 1) e USING (candidate_id)"""


@query(f"SELECT * FROM ({_DEGREES})")
def education_evidence(spark, sf):
    rows = match.education(_people(spark, sf), _concepts())
    return rows.select("candidate_id", "points", "label", "item.evidence_id")


def _scored_pairs(spark, sf):
    """Each part's candidate against the job of one nation, as retrieval might have placed them."""
    key = F.col("p_partkey")
    part = _t(spark, sf, "part")
    pairs = part.select(F.concat(F.lit("n"), key % 25).alias("job_id"), F.concat(F.lit("p"), key).alias("candidate_id"), ((key % 97 + 1) / F.lit(98.0)).alias("retrieval_score"), F.floor(key / 25).cast("int").alias("retrieval_rank"))
    return match.score_pairs(pairs, _jobs(spark, sf), _people(spark, sf), _concepts(), fuzzy=False, rows=part.count())


_MET = f"""
WITH pair AS (SELECT 'n' || (p_partkey % 25) AS job_id, 'p' || p_partkey AS candidate_id, p_partkey, p_size, ((p_partkey % 97) + 1) / 98.0 AS retrieval_score, p_partkey // 25 AS retrieval_rank, p_partkey % 25 AS n_nationkey,
    CASE WHEN p_size % 2 = 0 THEN lower(p_brand) ELSE '' END AS owns FROM part),
asks AS ({_ASKS}), best AS ({_BEST.replace('GROUP BY ALL', 'GROUP BY candidate_id, kind, key')}), degrees AS ({_DEGREES}),
owned AS (SELECT DISTINCT candidate_id, key FROM pair JOIN {_values(('software',))} ON contains(owns, alias)),
met AS (
  SELECT p.job_id, p.candidate_id, a.*, b.item, CASE WHEN a.kind = 'software' THEN o.key IS NOT NULL ELSE b.item IS NOT NULL END AS hit, CASE a.kind WHEN 'concept' THEN 0 WHEN 'software' THEN 1 ELSE 3 END AS place
  FROM pair p JOIN asks a ON a.job_id = p.job_id LEFT JOIN best b ON b.candidate_id = p.candidate_id AND b.kind = a.kind AND b.key = a.key LEFT JOIN owned o ON a.kind = 'software' AND o.candidate_id = p.candidate_id AND o.key = a.key),
ask2 AS (SELECT p.*, n.n_regionkey, p.n_nationkey % 2 = 0 AS asks, d.points, d.label AS dlabel, d.evidence_id AS deid, coalesce(d.points >= 65, false) AS good FROM pair p JOIN nation n ON n.n_nationkey = p.n_nationkey LEFT JOIN degrees d USING (candidate_id)),
cover AS (
  SELECT job_id, candidate_id, 100.0 * sum(CASE WHEN hit THEN weight ELSE 0 END) FILTER (kind = 'concept') / sum(weight) FILTER (kind = 'concept') AS concept,
    100.0 * avg(hit::INT) FILTER (kind = 'software') AS software, 100.0 * avg(hit::INT) FILTER (kind = 'preferred') AS preferred FROM met GROUP BY ALL),
said AS (
  SELECT job_id, candidate_id, hit, place, seq, label FROM met WHERE kind <> 'preferred'
  UNION ALL SELECT job_id, candidate_id, good, 2, 0, CASE WHEN good THEN dlabel ELSE 'Relevant bachelor''s degree' END FROM ask2 WHERE asks),
lists AS (SELECT job_id, candidate_id, string_agg(label, '|' ORDER BY place, seq) FILTER (hit) AS matched, string_agg(label, '|' ORDER BY place, seq) FILTER (NOT hit) AS missing FROM said GROUP BY ALL),
proof AS (
  SELECT job_id, candidate_id, place, seq, item.evidence_id AS evidence_id FROM met WHERE hit AND item IS NOT NULL
  UNION ALL SELECT job_id, candidate_id, 2, 0, deid FROM ask2 WHERE asks AND good AND deid IS NOT NULL),
evidence AS (SELECT job_id, candidate_id, string_agg(evidence_id, '|' ORDER BY place, seq) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY job_id, candidate_id, evidence_id ORDER BY place, seq) AS n FROM proof) WHERE n = 1 GROUP BY ALL),
parts AS (
  SELECT a.job_id, a.candidate_id, retrieval_rank, least(100.0, sqrt(retrieval_score) * 100.0) AS semantic,
    0.70 * coalesce(concept, 100.0) + 0.20 * coalesce(software, 100.0) + 0.10 * CASE WHEN asks THEN coalesce(points, 0.0) ELSE 100.0 END AS required,
    CASE WHEN a.p_size < 5 * n_regionkey THEN greatest(10.0, 100.0 - 45.0 * (5 * n_regionkey - a.p_size)) WHEN n_nationkey % 4 <> 0 AND a.p_size > 5 * n_regionkey + 10 THEN greatest(45.0, 100.0 - 12.0 * (a.p_size - 5 * n_regionkey - 10)) ELSE 100.0 END AS experience,
    r.role, coalesce(preferred, 50.0) AS preferred
  FROM ask2 a JOIN ({_ROLE}) r USING (p_partkey) LEFT JOIN cover c ON c.job_id = a.job_id AND c.candidate_id = a.candidate_id),
total AS (SELECT *, round(0.25 * semantic + 0.30 * required + 0.15 * experience + 0.20 * role + 0.10 * preferred, 2) AS final_score FROM parts)"""


@query(f"""{_MET}
SELECT t.job_id, t.candidate_id, round(semantic, 6) AS semantic, round(required, 6)::DOUBLE AS required, experience::DOUBLE AS experience, role, round(preferred, 6)::DOUBLE AS preferred, final_score::DOUBLE AS final_score,
  coalesce(matched, '') AS matched, coalesce(missing, '') AS missing, coalesce(evidence, '') AS evidence
FROM total t LEFT JOIN lists l ON l.job_id = t.job_id AND l.candidate_id = t.candidate_id LEFT JOIN evidence e ON e.job_id = t.job_id AND e.candidate_id = t.candidate_id""")
def score_pairs(spark, sf):
    rows, own = _scored_pairs(spark, sf), lambda c: F.round(f"components.{c}", 6)
    return rows.select(
        "job_id", "candidate_id", own("semantic").alias("semantic"), own("required_skills").alias("required"), own("experience").alias("experience"), own("role").alias("role"), own("preferred").alias("preferred"), "final_score",
        F.array_join("matched", "|").alias("matched"), F.array_join("missing", "|").alias("missing"), F.array_join(F.transform("evidence", lambda e: e["evidence_id"]), "|").alias("evidence"),
    )


_RANKED = f"{_MET}, ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, retrieval_rank, candidate_id) AS rank FROM total)"


@query(f"{_RANKED} SELECT job_id, candidate_id, rank, final_score::DOUBLE AS final_score FROM ranked WHERE rank <= 10")
def rerank(spark, sf):
    return match.rerank(_scored_pairs(spark, sf), 10).select("job_id", "candidate_id", F.col("rank").cast("long").alias("rank"), "final_score")


def _told(spark, sf):
    people = _people(spark, sf).select("candidate_id", "full_name", "headline", "total_experience_years")
    return explained.explain(match.rerank(_scored_pairs(spark, sf), 5).join(people, "candidate_id"))


_LABEL = " ".join(f"WHEN {low} THEN '{{}}'" for low in ("final_score >= 85", "final_score >= 70", "final_score >= 55"))


@query(f"""{_RANKED},
hits AS (SELECT job_id, candidate_id, count(*) FILTER (hit) AS n, string_agg('Evidence supports ' || label || '.', '|' ORDER BY place, seq) FILTER (hit AND i <= 5) AS strengths,
  string_agg('No direct resume evidence found for ' || label || '.', '|' ORDER BY place, seq) FILTER (NOT hit AND i <= 5) AS gaps
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, candidate_id, hit ORDER BY place, seq) AS i FROM said) GROUP BY ALL)
SELECT r.job_id, r.candidate_id, {_TIER} AS recommendation, coalesce(strengths, '') AS strengths, coalesce(gaps, '') AS gaps,
  round(0.55 + 0.35 * least(1.0, least(10, coalesce(len(string_split(evidence, '|')), 0)) / greatest(1, coalesce(n, 0))), 2)::DOUBLE AS confidence
FROM ranked r LEFT JOIN hits h ON h.job_id = r.job_id AND h.candidate_id = r.candidate_id LEFT JOIN evidence e ON e.job_id = r.job_id AND e.candidate_id = r.candidate_id WHERE rank <= 5""")
def explain(spark, sf):
    return _told(spark, sf).select("job_id", "candidate_id", "recommendation", F.array_join("strengths", "|").alias("strengths"), F.array_join("gaps", "|").alias("gaps"), "confidence")


@query(f"""{_RANKED}
SELECT r.job_id, rank, p_name AS candidate, coalesce({_HEADLINE}, '—') AS current_role, p_size::DOUBLE AS experience, final_score::DOUBLE AS fit_score, CASE {_LABEL.format(*list(explained.RECOMMENDATIONS.values())[:3])} ELSE 'Not recommended' END AS recommendation
FROM ranked r JOIN part ON 'p' || p_partkey = r.candidate_id WHERE rank <= 5""")
def results_frame(spark, sf):
    return explained.results_frame(_told(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""{_RANKED}
SELECT job_id, candidate_id, unnest(['Semantic', 'Requirements', 'Experience', 'Role', 'Preferred']) AS component, round(unnest([semantic, required, experience, role, preferred]), 6)::DOUBLE AS score FROM ranked WHERE rank <= 5""")
def component_frame(spark, sf):
    return explained.component_frame(_told(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""{_RANKED}
SELECT r.job_id, rank, r.candidate_id, p_name AS candidate_name, coalesce({_HEADLINE}, '') AS headline, p_size || '.0' AS experience_years, final_score::DOUBLE AS score, {_TIER} AS recommendation,
  coalesce(replace(matched, '|', ' | '), '') AS matched_requirements, coalesce(replace(missing, '|', ' | '), '') AS missing_requirements
FROM ranked r JOIN part ON 'p' || p_partkey = r.candidate_id LEFT JOIN lists l ON l.job_id = r.job_id AND l.candidate_id = r.candidate_id WHERE rank <= 5""")
def export_flat(spark, sf):
    names = ["candidate_id", "candidate_name", "headline", "experience_years", "score", "recommendation", "matched_requirements", "missing_requirements"]
    return explained.flat(_told(spark, sf), "job_id").select("job_id", F.col("rank").cast("long").alias("rank"), *names)


_DUTIES = "['did ' || split_part(p_name, ' ', 1) || ' and more']"


@query(f"""
SELECT 'resume_' || lpad(p_partkey::VARCHAR, greatest(2, length(p_partkey::VARCHAR))::INT, '0') AS candidate_id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS full_name, p_type AS headline, p_brand AS location,
  p_partkey || '@x.org' AS email, p_size::DOUBLE AS years, replace(p_name, ' ', '|') AS skills, p_type || ';' || p_brand || ';2019;2020;did ' || split_part(p_name, ' ', 1) || ' and more' AS post, 'BSc;' || p_type || ';Uni;2018' AS degree FROM part""")
def parse_resumes(spark, sf):
    words = F.split("p_name", " ")
    lines = F.concat_ws("\n", F.upper("p_name"), "p_type", F.concat(F.lit("Email: "), "p_partkey", F.lit("@x.org")), F.concat(F.lit("Location: "), "p_brand"), F.lit("PROFESSIONAL SUMMARY"), F.concat(F.lit("Has "), "p_size", F.lit("+ years of work.")), F.lit("TECHNICAL SKILLS"),
                        F.concat(F.lit("\u007f "), words[0]), F.concat(F.lit("● "), words[1]), F.lit("PROFESSIONAL EXPERIENCE"), F.concat_ws(" | ", "p_type", "p_brand", F.lit("2019 - 2020")), F.concat(F.lit("• did "), words[0]), F.lit("and more"), F.lit("EDUCATION\nGPA: 3\nBSc in"), F.lit("Uni | 2018"))
    text = F.replace(lines, F.lit("BSc in\n"), F.concat(F.lit("BSc in "), "p_type", F.lit("\n")))
    made = parse.resumes(_dealt_by(_t(spark, sf, "part"), "p_partkey").select(F.concat(F.lit("/x/Resume_"), "p_partkey", F.lit(".pdf")).alias("source_file"), text.alias("text")))
    w, e = F.col("work_experience")[0], F.col("education")[0]
    return made.select(
        "candidate_id", "full_name", "headline", "location", F.col("contact.email").alias("email"), F.col("total_experience_years").alias("years"), F.array_join("skills", "|").alias("skills"),
        F.concat_ws(";", w["job_title"], w["company"], w["start_date"], w["end_date"], F.array_join(w["responsibilities"], "|")).alias("post"), F.concat_ws(";", e["degree"], e["field_of_study"], e["institution"], e["graduation_year"].cast("string")).alias("degree"),
    )


_KIND = f"CASE WHEN {_ITEM} IN ('Bachelor degree') THEN 'education' WHEN {_ITEM} IN ('5 years of experience') THEN 'dropped' WHEN {_ITEM} = 'CPA preferred' THEN 'certification' WHEN {_ITEM} = 'Microsoft Excel' THEN 'excel' WHEN {_ITEM} = 'Accounting software' THEN 'accounting_software' ELSE 'skill' END"


@query(f"""
SELECT 'j' || p_partkey AS job_id, upper(p_type[1]) || lower(p_type[2:]) || ' Role' AS title, 'Acme' AS company, p_brand AS location, 'Full' AS employment_type, 3.0::DOUBLE AS least, p_size::DOUBLE AS most, CASE WHEN {_KIND} = 'skill' THEN {_ITEM} || '|' ELSE '' END || p_name AS skills,
  CASE {_KIND} WHEN 'excel' THEN 'Microsoft Excel' WHEN 'accounting_software' THEN '{parse.ACCOUNTING_SOFTWARE}' ELSE '' END AS software, CASE WHEN {_KIND} = 'education' THEN {_ITEM} ELSE '' END AS education, CASE WHEN {_KIND} = 'certification' THEN 'CPA' ELSE '' END AS certificates FROM part""")
def parse_jobs(spark, sf):
    item = F.get(F.lit(_ITEMS), (F.col("p_partkey") % len(_ITEMS)).cast("int"))
    text = F.concat("p_type", F.lit(" ROLE POSITION\nCompany: Acme Location: "), "p_brand", F.lit(" Employment Type: Full Salary Range: 1\nExperience Required: 3 - "), "p_size", F.lit(" years\nREQUIRED SKILLS\n• "), item, F.lit("\n• "), "p_name")
    made = parse.job_postings(_dealt_by(_t(spark, sf, "part"), "p_partkey").select(F.concat(F.lit("j"), "p_partkey").alias("job_id"), F.lit("f").alias("source_file"), text.alias("text")))
    joined = lambda c: F.array_join(c, "|")
    return made.select("job_id", "title", "company", "location", "employment_type", F.col("experience_min_years").alias("least"), F.col("experience_max_years").alias("most"), joined("required_skills").alias("skills"), joined("required_software").alias("software"), joined("education_requirements").alias("education"), joined("preferred_certifications").alias("certificates"))


# Benchmarks and sync


def _benchmark(spark, sf):
    """Labels as a benchmark file has them: names that fit but for every seventh document, statuses by quality."""
    label = 2 * F.col("quality") + (1 - F.col("toxic"))
    name = F.when(F.col("doc_id") % 7 != 0, _pick(list(metrics.LABEL_NAMES.values()), label))
    return _t(spark, sf, "labels").select(F.lit("j").alias("job_id"), F.concat(F.lit("d"), "doc_id").alias("candidate_id"), label.alias("relevance_label"), name.alias("label_name"), F.lit("").alias("rationale"), F.when(F.col("quality") == 1, "silver").otherwise("draft").alias("review_status"))


@query("SELECT 'd' || doc_id AS candidate_id, 'label_name' AS rule FROM labels WHERE doc_id % 7 = 0")
def label_violations(spark, sf):
    return io.label_violations(_benchmark(spark, sf), job_id="j")


@query(f"""
SELECT 'candidates' AS what, NULL AS value, count(*) AS n FROM labels UNION ALL SELECT 'review_status', CASE WHEN quality = 1 THEN 'silver' ELSE 'draft' END, count(*) FROM labels GROUP BY 2
UNION ALL SELECT 'label', value, count(doc_id) FROM (VALUES {', '.join(str(x) for x in metrics.LABEL_NAMES.items())}) AS v(label, value) LEFT JOIN labels ON 2 * quality + (1 - toxic) = label GROUP BY 2""")
def benchmark_summary(spark, sf):
    return metrics.benchmark_summary(_benchmark(spark, sf))


@query("SELECT lang, doc_id, 'missing from benchmark' AS rule FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(spark, sf):
    docs = _t(spark, sf, "documents").select("lang", "doc_id")
    return metrics.invalid(docs, docs.join(_t(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id"), "lang", "doc_id")


@query(f"""SELECT doc_id, {_DIGEST} AS digest, CASE WHEN lang = 'fr' OR n_chars > 2000 THEN 1 ELSE 0 END AS made FROM documents WHERE lang <> 'de'""")
def index_sync(spark, sf):
    """An index of all documents but the French, of which long ones have changed since and the German are gone; made: 1 for rows embedded now."""
    docs = _t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    embed = lambda mark: lambda rows: rows.select("doc_id", F.lit(mark).alias("made"))
    old = docs.where("lang <> 'fr'").withColumn("n_chars", F.expr("CASE WHEN n_chars > 2000 THEN n_chars + 1 ELSE n_chars END"))
    columns = ["source", "lang", "n_chars"]
    index, _ = syncing.sync(None, old, "doc_id", embed(0), columns)
    return syncing.sync(index, docs.where("lang <> 'de'"), "doc_id", embed(1), columns)[0].select("doc_id", "digest", "made")
