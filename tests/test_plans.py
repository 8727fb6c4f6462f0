"""Search over tables and files, indexes that are kept, experiments, evaluators and caches."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarry.operators import embed, explain, metrics, retrieve, schemas, tfidf
from quarry.operators.default_taxonomy import default_taxonomy
from quarry.operators.schemas import CANDIDATE, JOB
from quarry.plans import experiments, index
from quarry.plans.cache import TTLCache
from quarry.plans.search import SearchConfig, SearchService, cache_key, found, ranked, reranked, search, search_paths
from quarry.plans.search import retrieve as retrieve_candidates
from quarry.sources import files, io
from quarry.streaming import sync as syncing
from test_engine import CANDIDATES, JOBS, records

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not find the tests


@pytest.fixture(scope="module")
def people(spark):
    return schemas.candidates(records(spark, CANDIDATES, CANDIDATE)).cache()


@pytest.fixture(scope="module")
def jobs(spark):
    return schemas.jobs(records(spark, JOBS, JOB)).cache()


def toy(texts, task=None):
    """A vector of letter counts."""
    return [[float(t.lower().count(c)) for c in "aeinrst"] for t in texts]


# Retrieval


def test_candidates_without_a_shared_word_fill_up(spark, jobs):
    own = [dict(CANDIDATES[0], candidate_id=f"c{i}", headline=None, professional_summary="zebra quagga" if i else "financial reporting", skills=[], software=[], work_experience=[], education=[], total_experience_years=None) for i in range(6)]
    for k in (2, 4, 6):
        got = retrieve_candidates(jobs, records(spark, own, CANDIDATE), SearchConfig(retrieve=k, rerank=1, final=1)).orderBy("retrieval_rank").collect()
        assert [r.candidate_id for r in got] == [f"c{i}" for i in range(k)] and got[0].retrieval_score > 0 == got[1].retrieval_score


@pytest.mark.parametrize("block", [1000, 3])
def test_blocks_and_grid_give_the_same_as_brute_force(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieve, "CHUNK", 16)
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(60)]
    rows[7] = (7, None)
    corpus = spark.createDataFrame(rows, "id long, v array<double>")
    asked = corpus.where("id % 6 = 0").select(F.col("id").alias("q"), "v")
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v]
    wanted = []
    for q, v in rows[::6]:
        scored = sorted((-round(sum(a * b for a, b in zip(unit(v), unit(w or [0, 0, 0]), strict=True)), 12), i) for i, w in rows)
        wanted += [(q, i, n) for n, (_, i) in enumerate(scored[:5], 1)]
    got = retrieve.exact_top_k(asked, corpus, "q", "id", "v", 5)
    assert sorted((x.q, x.id, x.rank) for x in got.collect()) == sorted(wanted)
    assert retrieve.exact_top_k(asked, corpus, "q", "id", "v", 0).count() == 0 and retrieve.exact_top_k(asked.limit(0), corpus, "q", "id", "v", 3).count() == 0
    assert retrieve.exact_top_k(asked, corpus.limit(0), "q", "id", "v", 3).count() == 0


def test_words_of_any_script():
    assert tfidf.words("The Москва日本 a Łódź naïve ÉCOLE ﬁt x_1 o'neil") == ["москва日本", "łodz", "naive", "ecole", "fit", "x_1", "neil"]
    assert tfidf.terms("red green the blue") == ["red", "green", "blue", "red green", "green blue"] and tfidf.terms(None) == []


def test_tfidf_model_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([("a", "tax audit tax"), ("b", "audit report"), ("c", None)], "id string, text string")
    model = tfidf.TfidfModel.fit(docs, max_features=3)
    assert model.terms == ["audit", "audit report", "tax"] and model.df == [2, 1, 1] and model.n_docs == 3
    model.save(spark, str(tmp_path / "m"))
    again = tfidf.TfidfModel.load(spark, str(tmp_path / "m"))
    both = [{r.id: (r.indices, r.weights) for r in m.embed(docs, "id").collect()} for m in (model, again)]
    assert both[0] == both[1] and both[0]["c"] == ([], [])
    with pytest.raises(ValueError):
        tfidf.TfidfModel.fit(docs.limit(0))


# Indexes


def test_index_is_synced_and_reused(spark, tmp_path, people, jobs):
    root = str(tmp_path)
    first, report = index.sync_index(spark, root, " my/index!", people)
    assert (report["embedded"], report["reused"], report["full_rebuild"], report["changed"], report["total"]) == (3, 0, True, True, 3)
    assert files.exists(spark, f"{root}/myindex/manifest.json") and first.manifest["dimension"] == len(first.model.terms)
    _, report = index.sync_index(spark, root, "myindex", people)
    assert (report["embedded"], report["reused"], report["full_rebuild"], report["changed"]) == (0, 3, False, False)
    fresh, report = index.sync_index(spark, root, "myindex", people.where("candidate_id <> 'c2'"))
    assert (report["embedded"], report["removed"], report["full_rebuild"], report["total"]) == (2, 1, True, 2)
    assert not files.exists(spark, f"{root}/myindex/v1") and fresh.manifest["version"] == "v2"
    again = index.load_index(spark, f"{root}/myindex")
    got = [(r.candidate_id, round(r.retrieval_score, 9)) for r in again.retrieve(jobs, 5).orderBy("retrieval_rank").collect()]
    direct = retrieve_candidates(jobs, people.where("candidate_id <> 'c2'"), SearchConfig(retrieve=5, rerank=1, final=1))
    assert got == [(r.candidate_id, round(r.retrieval_score, 9)) for r in direct.orderBy("retrieval_rank").collect()]
    _, report = index.sync_index(spark, root, "myindex", people, mode="section")
    assert report["full_rebuild"] and report["mode"] == "section"


def test_dense_index_embeds_only_what_changed(spark, tmp_path, people, jobs):
    model = embed.DenseModel("toy-1", toy)
    _, report = index.sync_index(spark, str(tmp_path), "d", people, model)
    assert (report["embedded"], report["reused"]) == (3, 0)
    edited = people.withColumn("professional_summary", F.when(F.col("candidate_id") == "c1", "changed").otherwise(F.col("professional_summary")))
    made, report = index.sync_index(spark, str(tmp_path), "d", edited.where("candidate_id <> 'c3'"), model)
    assert (report["embedded"], report["reused"], report["removed"], report["full_rebuild"]) == (1, 1, 1, False)
    assert made.retrieve(jobs, 5).count() == 2
    with pytest.raises(ValueError, match="toy-1"):
        index.load_index(spark, f"{tmp_path}/d", embed.DenseModel("other", toy))
    _, report = index.sync_index(spark, str(tmp_path), "d", edited, embed.DenseModel("toy-2", toy))
    assert report["full_rebuild"] and report["embedded"] == 3


def test_broken_indexes_raise(spark, tmp_path, people):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "manifest.json").write_text("{no json")
    with pytest.raises(index.BrokenIndex, match="corrupt"):
        index.sync_index(spark, str(tmp_path), "bad", people)
    with pytest.raises(index.BrokenIndex):
        index.load_index(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        index.safe_name("../--")
    with pytest.raises(ValueError):
        index.sync_index(spark, str(tmp_path), "x", people.limit(0))
    with pytest.raises(ValueError):
        index.backend("other")
    assert index.backend() == index.BACKEND and index.valid_request_id("a-1.b:2") and not index.valid_request_id("a b") and not index.valid_request_id("x" * 129) and not index.valid_request_id(None)


# Hosted models


def test_retries_wait_twice_as_long_each_time():
    waits, calls = [], []

    def fails_twice():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert embed.with_retries(fails_twice, 3, 0.5, waits.append) == "ok" and waits == [0.5, 1.0]
    with pytest.raises(RuntimeError, match="failed after 2 attempts: busy"):
        calls.clear()
        embed.with_retries(fails_twice, 2, 0.5, waits.append)


def asked_for(prompt):
    return json.loads(prompt.split("INPUT:\n", 1)[1])["deterministic_match"]["candidate_id"]


def answer(prompt, **changed):
    asked = json.loads(prompt.split("INPUT:\n", 1)[1])
    own = asked["deterministic_match"]
    return {"candidate_id": own["candidate_id"], "strengths": [{"claim": "Knows it", "evidence_ids": [asked["candidate_evidence"][0]["evidence_id"]]}], "gap_requirements": own["missing_requirements"][:1], "reasoning": "Because.", "confidence": 0.5} | changed


@pytest.fixture(scope="module")
def matched(people, jobs):
    """All three candidates as the shortlist, worked out once."""
    config = SearchConfig(retrieve=3, rerank=3, final=3)
    rows = ranked(jobs, people, default_taxonomy(), config).join(people.select("candidate_id", "full_name", "headline", "total_experience_years"), "candidate_id")
    return rows.cache()


def test_model_explains_from_evidence_alone(spark, people, jobs, matched):
    told = lambda f, **o: explain.explain_with_model(matched, jobs, people, explain.Evaluator("toy", f, attempts=1, **o))
    rows = {r.candidate_id: r for r in told(lambda p: json.dumps(answer(p))).collect()}
    assert [rows[c].final_score for c in ("c1", "c2", "c3")] == [88.2, 51.67, 35.11]
    best = rows["c1"]
    assert best.strengths == ["Knows it"] and best.reasoning == "Because." and best.confidence == 0.5 and best.model_error is None
    assert [(e.evidence_id, e.requirement, e.evidence, e.source_section) for e in best.evidence] == [("E001", "Supporting evidence", "Senior Accountant", "headline")]
    wrong = {"c1": {"candidate_id": "else"}, "c2": {"strengths": [{"claim": "x", "evidence_ids": ["E999"]}]}, "c3": {"gap_requirements": ["Cooking"]}}
    rows = {r.candidate_id: r for r in told(lambda p: answer(p, **wrong[asked_for(p)])).collect()}
    assert all(said in rows[c].model_error and rows[c].reasoning.startswith("The ") for c, said in (("c1", "mismatched"), ("c2", "unknown evidence"), ("c3", "unsupported gap")))
    assert [r.candidate_id for r in told(lambda p: answer(p, **({} if asked_for(p) == "c1" else {"confidence": 2})), fallback=False).collect()] == ["c1"]
    plain = told(lambda p: answer(p, strengths=[], gap_requirements=[])).where("candidate_id = 'c1'").first()
    assert plain.strengths[0].startswith("Evidence supports") and len(plain.evidence) > 1
    assert explain.evaluator("toy") == (None, "heuristic (toy key unavailable)") and explain.evaluator("heuristic") == (None, "heuristic") and explain.evaluator("toy", answer)[0].name == "toy"


@pytest.mark.parametrize("change", [{"confidence": 2}, {"score": 1}, {"reasoning": None}, {"strengths": [{"claim": "x", "evidence_ids": []}]}, {"strengths": [{"claim": "x", "evidence_ids": ["E001"]}] * 6}])
def test_malformed_answers(change):
    made = {"candidate_id": "c", "strengths": [], "gap_requirements": [], "reasoning": "r", "confidence": 1}
    assert explain.parsed_answer(json.dumps(made)) == made
    with pytest.raises(ValueError, match="malformed"):
        explain.parsed_answer(made | change)


def test_prompt_holds_no_identity(people, jobs, matched):
    named = people.withColumns({"full_name": F.lit("Jane Doe"), "location": F.lit("Paris")})
    prompts = [r.prompt for r in explain.prompt_input(jobs, named, matched.withColumn("full_name", F.lit("Jane Doe"))).collect()]
    assert len(prompts) == 3 and not any("Jane" in p or "Paris" in p for p in prompts) and all("candidate_evidence" in p for p in prompts)


# Search over files, projections, cache


RESUME = "JANE DOE\n{}\nEmail: j@x.org\nPROFESSIONAL SUMMARY\nHas 5+ years of tax work.\nTECHNICAL SKILLS\n• GAAP\n• Tax Preparation\nEDUCATION\nBSc in Accounting\nUni | 2018\n"
POSTING = "SENIOR ACCOUNTANT POSITION\nCompany: Acme Location: Rome Employment Type: Full Salary Range: 1\nExperience Required: 3 - 5 years\nREQUIRED SKILLS\n• GAAP\n• Tax Preparation\n"


def test_search_over_files(spark, tmp_path):
    (tmp_path / "people").mkdir()
    for name, title in (("Resume_1.PDF", "Senior Accountant"), ("Resume_2.pdf", "Cook"), ("empty.pdf", None)):
        (tmp_path / "people" / name).write_text(RESUME.format(title) if title else " ")
    (tmp_path / "job.pdf").write_text(POSTING)
    rows = search_paths(spark, str(tmp_path / "job.pdf"), str(tmp_path / "people"), default_taxonomy(), lambda b: b.decode(), SearchConfig(retrieve=2, rerank=2, final=2)).orderBy("rank").collect()
    assert [r.candidate_id for r in rows] == ["resume_01", "resume_02"] and rows[0].full_name == "Jane Doe"
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no file"):
        search_paths(spark, str(tmp_path / "job.pdf"), str(tmp_path / "none"), default_taxonomy(), lambda b: b.decode())


def test_projections(spark, people, jobs, tmp_path):
    config = SearchConfig(retrieve=3, rerank=3, final=2)
    hits = found(jobs, people, config, 2).orderBy("rank").collect()
    assert [r.candidate_id for r in hits] == ["c1", "c2"] and hits[0].retrieval_score == 0.6858
    rows = reranked(jobs, people, default_taxonomy(), config).orderBy("rerank_rank").collect()
    assert [r.final_score for r in rows] == [88.2, 51.67, 35.11] and rows[1].evaluation.recommendation == "not_recommended" and rows[2].evaluation is None
    made = search(jobs, people, default_taxonomy(), config).cache()
    shown = explain.results_frame(made).orderBy("rank").collect()
    assert (shown[0].candidate, shown[0].recommendation, shown[0].current_role) == ("c1", "Highly recommended", "Senior Accountant")
    assert [r.component for r in explain.component_frame(made.where("rank = 1")).collect()] == ["Semantic", "Requirements", "Experience", "Role", "Preferred"]
    assert explain.evidence_frame(made.where("rank = 1")).count() == len(made.where("rank = 1").first().evidence)
    document = explain.envelope(jobs, made, {"candidate_count": 3, "config": config.described()})
    assert [r["rank"] for r in document["results"]] == [1, 2] and "contact" not in json.dumps(document) and document["job"]["title"] == "Senior Accountant"
    io.write_document(spark, f"{tmp_path}/r.json", document)
    assert json.loads(files.read_text(spark, f"{tmp_path}/r.json"))["run"]["candidate_count"] == 3
    assert spark.range(1).select(explain.stage_label(F.lit("candidate_aggregation"))).first()[0] == "Candidate Aggregation"
    told = made.select("job_id", "candidate_id", "reasoning")
    matches = made.select("job_id", "candidate_id", "rank")
    assert explain.joined_or_raise(matches, people, told).where("profile.headline = 'Senior Accountant'").count() == 1
    with pytest.raises(Exception, match="no evaluation of c"):
        explain.joined_or_raise(matches, people, told.limit(1)).collect()


def test_cache_expires_and_drops_the_oldest():
    now = [0.0]
    cache = TTLCache(2, 10, lambda: now[0])
    cache.set("a", 1)
    cache.set("b", 2)
    assert cache.get("a") == 1
    cache.set("c", 3)
    assert cache.get("b") is None and len(cache) == 2
    now[0] = 10.0
    assert cache.get("a") is None and cache.get("c") is None
    cache.set("d", 4)
    cache.clear()
    assert len(cache) == 0
    with pytest.raises(ValueError):
        TTLCache(0)


def test_service_reuses_what_it_knows(spark, people, jobs):
    service, config = SearchService(default_taxonomy(), TTLCache()), SearchConfig(retrieve=3, rerank=3, final=3)
    first = service.search(jobs, people, config)
    again = service.search(jobs, people.orderBy(F.desc("candidate_id")), config)
    assert not first["cache_hit"] and again["cache_hit"] and first["rows"] == again["rows"] and service.requests == {"hit": 1, "miss": 1} and service.candidates == 3
    renamed = people.withColumn("full_name", F.lit("Other"))
    assert cache_key(jobs, people, config) != cache_key(jobs, renamed, config) and "Other" not in cache_key(jobs, renamed, config)
    assert cache_key(jobs, people, config) != cache_key(jobs, people, SearchConfig(retrieve=3, rerank=3, final=2))
    with pytest.raises(ValueError, match="at most"):
        SearchService(default_taxonomy(), most_candidates=2).search(jobs, people)
    with pytest.raises(ValueError, match="at least one"):
        service.search(jobs, people.limit(0))


# Experiments


def test_experiments_and_their_reports(spark, people, jobs, tmp_path):
    labels = spark.createDataFrame([("j", "c1", 3, "strong_fit", "", "silver"), ("j", "c2", 2, "moderate_fit", "", "silver"), ("j", "c3", 0, "not_suitable", "", "draft")], io.LABELS)
    own, _ = index.sync_index(spark, str(tmp_path), "full", people)
    parts, _ = index.sync_index(spark, str(tmp_path), "section", people, mode="section")
    rankings = [experiments.retrieval_ranking("full", own, jobs), experiments.retrieval_ranking("section", parts, jobs), experiments.hybrid_ranking("full + hybrid", own, jobs, people, default_taxonomy())]
    experiments.checked_keys(people, labels)
    with pytest.raises(ValueError, match="c3"):
        experiments.checked_keys(people, labels.where("candidate_id <> 'c3'"))
    places = experiments.report(spark, f"{tmp_path}/out", rankings, labels, trials=50)
    document = json.loads(files.read_text(spark, places["results"]))
    assert {(e["experiment"], e["ndcg"]) for e in document["experiments"] if e["k"] == 5} >= {("full + hybrid", 1.0)} and len(document["random_baseline"]) == 3
    table = io.read_metrics(spark, places["metrics"]).orderBy("experiment").collect()
    assert [r.experiment for r in table] == ["full", "full + hybrid", "section"] and table[1]["p@5"] == pytest.approx(2 / 3, abs=1e-5)
    ranks = spark.read.csv(places["ranking_comparison"], header=True).collect()
    assert [r.candidate_id for r in ranks] == ["c1", "c2", "c3"] and ranks[0]["full + hybrid"] == "1"
    text = files.read_text(spark, places["report"])
    assert "| random baseline (mean) |" in text and "label strong_fit: 1" in text and "review_status draft: 1" in text


def test_baseline_keeps_groups_apart_and_agrees_with_expectation(spark):
    labels = spark.createDataFrame([(g, f"{g}{i}", 3 if i < n else 0) for g, n in (("a:1", 2), ("a:2", 6), ("b", 4)) for i in range(8)], "g string, id string, label int")
    rows = {(r.g, r.k): r for r in metrics.random_baseline(labels, "g", "id", [4], trials=800).collect()}
    assert set(rows) == {("a:1", 4), ("a:2", 4), ("b", 4)}
    assert all(rows[g, 4].precision == pytest.approx(n / 8, abs=0.03) for g, n in (("a:1", 2), ("a:2", 6), ("b", 4)))


def test_metrics_over_stretches_are_the_same(spark, monkeypatch):
    import math
    import random

    monkeypatch.setattr(metrics, "STRETCH", 3)
    r = random.Random(2)
    own = [r.randrange(4) for _ in range(40)]
    labels = spark.createDataFrame([("j", i, x) for i, x in enumerate(own)], "j string, id int, label int")
    order = r.sample(range(40), 40)
    ranking = spark.createDataFrame([("j", i, n) for n, i in enumerate(order, 1)], "j string, id int, rank int")
    got = {x.k: x for x in metrics.evaluate(ranking, labels, "j", "id", [1, 7, 100]).collect()}
    said = [own[i] for i in order]
    gain = lambda xs: sum((2**x - 1) / math.log2(n + 1) for n, x in enumerate(xs, 1))
    hits = [n for n, x in enumerate(said, 1) if x >= 2]
    assert got[7].average_precision == pytest.approx(sum((i + 1) / n for i, n in enumerate(hits)) / len(hits)) and got[7].reciprocal_rank == pytest.approx(1 / hits[0])
    for k in (1, 7, 100):
        assert got[k].ndcg == pytest.approx(gain(said[:k]) / gain(sorted(own, reverse=True)[:k]))
        assert got[k].precision == pytest.approx(sum(x >= 2 for x in said[:k]) / min(k, 40))


# Sources


def test_label_files(spark, tmp_path):
    header = "job_id,candidate_id,relevance_label,label_name,rationale,review_status\n"
    good = tmp_path / "good.csv"
    good.write_text(header + "j,a,3,strong_fit,x,silver\nj,b,0,not_suitable,y,draft\n")
    assert io.checked_labels(spark, str(good), "j").count() == 2
    assert {(r.what, r.value, r.n) for r in metrics.benchmark_summary(io.read_labels(spark, str(good))).collect()} == {("candidates", None, 2), ("label", "not_suitable", 1), ("label", "weak_fit", 0), ("label", "moderate_fit", 0), ("label", "strong_fit", 1), ("review_status", "silver", 1), ("review_status", "draft", 1)}
    for row, rule in (("j,a,4,strong_fit,x,s", "label"), ("j,a,3,weak_fit,x,s", "label_name"), ("j,a,3,,x,s", "label_name"), ("k,a,3,strong_fit,x,s", "job_id"), ("j,b,0,not_suitable,x,s", "duplicate")):
        bad = tmp_path / "bad.csv"
        bad.write_text(header + "j,b,0,not_suitable,y,s\n" + row + "\n")
        assert rule in {r.rule for r in io.label_violations(io.read_labels(spark, str(bad)), job_id="j").collect()}
        with pytest.raises(ValueError):
            io.checked_labels(spark, str(bad), "j")
    missing = tmp_path / "missing.csv"
    missing.write_text("job_id,candidate_id\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        io.read_labels(spark, str(missing))


def test_records_round_trip(spark, tmp_path, people, jobs):
    io.write_json(people, f"{tmp_path}/c")
    back = io.read_candidates(spark, f"{tmp_path}/c")
    assert sorted(map(str, back.collect())) == sorted(map(str, io.normalized(people, ["skills", "software", "achievements"]).collect()))
    io.write_document(spark, f"{tmp_path}/job.json", JOBS[0])
    assert io.read_jobs(spark, f"{tmp_path}/job.json").first().title == "Senior Accountant"
    (tmp_path / "odd.jsonl").write_text('{"candidate_id": "x", "shoe_size": 3}\n\n')
    with pytest.raises(Exception, match="shoe_size"):
        io.read_candidates(spark, f"{tmp_path}/odd.jsonl").collect()
    assert io.read_candidates(spark, f"{tmp_path}/odd.jsonl", strict=False).count() == 1


def test_files_and_archives(spark, tmp_path):
    import zipfile

    def read(content):
        if content == b"bad":
            raise OSError("broken")
        return content.decode()

    for name, content in (("b.pdf", "text b"), ("A.PDF", "text a"), ("c.pdf", "bad"), ("d.pdf", "  "), ("e.txt", "no")):
        (tmp_path / name).write_text(content)
    rows = io.read_files(spark, str(tmp_path), read)
    assert [r.source_file.rsplit("/", 1)[-1] for r in io.in_name_order(rows).collect()] == ["A.PDF", "b.pdf", "c.pdf", "d.pdf"]
    report = io.ingestion_report(rows).first()
    assert (report.found, report.parsed, report.failed) == (4, 2, 2) and {f.error for f in report.failures} == {"OSError: broken", "no extractable text"}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name in ("x/one.pdf", "y/one.pdf", "__MACOSX/one.pdf", "two.txt"):
            z.writestr(name, f"in {name}")
    got = io.read_zip(spark, str(tmp_path), read)
    assert sorted((r.source_file, r.text) for r in got.collect()) == [("0001_one.pdf", "in x/one.pdf"), ("0002_one.pdf", "in y/one.pdf")]
    assert io.read_zip(spark, str(tmp_path), read, max_members=1).first().error == "archive has more than 1 files"
    assert io.read_zip(spark, str(tmp_path), read, max_total=5).first().error == "archive is too large"
    assert {r.source_file for r in io.read_zip(spark, str(tmp_path), read, start=7).collect()} == {"0007_one.pdf", "0008_one.pdf"}


def test_staged_uploads(spark):
    ups = spark.createDataFrame([(0, "b/One.pdf", 5), (1, "one.PDF", 5), (2, "notes.txt", 5), (3, "c\\One.pdf", 5), (4, "a.pdf", 5)], "ord int, name string, size long")
    assert [r.staged for r in io.staged_names(ups).collect()] == ["a.pdf", "One.pdf", "one_2.pdf", "One_3.pdf"]
    with pytest.raises(ValueError, match="at most"):
        io.staged_names(ups, max_files=3)
    with pytest.raises(Exception, match="too large"):
        io.staged_names(ups, max_bytes=4).collect()
    assert io.bounded(b"x") == b"x"
    for content in (b"", b"xxxx"):
        with pytest.raises(ValueError):
            io.bounded(content, 3)


# Streams


def test_stream_keeps_the_last_version(spark, tmp_path):
    docs = "id string, at int, text string"
    path, source = str(tmp_path / "table"), str(tmp_path / "in")

    def arrive(*rows):
        spark.createDataFrame(list(rows), docs).coalesce(1).write.mode("append").json(source)
        syncing.stream_sync(spark.readStream.schema(docs).json(source), "id", "at", ["text"], path, str(tmp_path / "ck"), buckets=4).awaitTermination()

    def now():
        return {r.id: (r.at, r.text) for r in syncing.synced(spark, path).collect()}

    assert syncing.synced(spark, path) is None
    arrive(("a", 1, "one"), ("a", 5, "five"), ("b", 2, "two"))
    assert now() == {"a": (5, "five"), "b": (2, "two")}
    arrive(("a", 3, "late"), ("c", 1, "new"))
    assert now() == {"a": (5, "five"), "b": (2, "two"), "c": (1, "new")}
    arrive(("b", 9, "nine"))
    arrive(("b", 8, "late"))
    assert now() == {"a": (5, "five"), "b": (9, "nine"), "c": (1, "new")}
    digest = syncing.synced(spark, path).select("id", (F.col("digest") == syncing.fingerprint("text")).alias("same")).collect()
    assert all(r.same for r in digest)
