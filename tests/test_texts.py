"""Saved queries, dictionary matching, scores of texts and contacts against brute force and hand-made cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import quality
from millrace.operators import cv, dictionary, outreach, rank, saved, score
from millrace.operators.intent import Intent

ANALYST = Intent("data analyst", ("data", "analyst"), "analyst", ("data analyst", "bi analyst"), ("sql", "power bi"), ("data scientist",), "senior")
CPP = Intent("c++ dev", ("c++", "dev"), "", (), ("c++",), (), "")
TWICE = Intent("data data", ("data", "data"))


def postings(spark, n=400):
    rng = random.Random(4)
    words = ["data", "analyst", "scientist", "bi", "senior", "c++", "dev", "power", "sql", "lead", "adata", "analysts"]
    rows = [(str(i), " ".join(rng.choices(words, k=rng.randint(0, 5))), rng.choice(["Data Co", "Acme", "Developers"]), rng.choices(["SQL", "Power BI", "C++", "x"], k=rng.randint(0, 2)), f"2024-05-{rng.randint(1, 28):02d}",
             rng.choice(["senior", "intern", "unknown", "lead"]), rng.random() < 0.2) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, title string, company string, skills array<string>, at string, seniority string, noise boolean")
    df = df.withColumns({"tags": F.array().cast("array<string>"), "summary": F.lit(""), "description": F.lit("we use sql daily"), "posted_at": F.col("at").cast("timestamp")})
    return score.prepare(df)


@pytest.mark.parametrize("weighed", [False, True])
def test_saved_queries_rank_as_literals_do(spark, weighed, monkeypatch):
    rows, now = postings(spark), F.lit("2024-06-01").cast("timestamp")
    intents = {"a": ANALYST, "c": CPP, "t": TWICE}
    more = {"level": F.col("seniority"), "noise": F.col("noise")} if weighed else {}
    want = rank.top_each(rows, {n: score.relevance(q, now, ts=F.col("posted_at"), **more) for n, q in intents.items()}, 25)
    lines = rows.select("id", F.col("id").alias("text_id"), F.col("posted_at").alias("ts"), "seniority", "noise")
    ask = lambda: saved.top(rows.withColumnRenamed("id", "text_id"), lines, saved.as_table(spark, intents), now, 25, **({"level": "seniority", "noise": "noise"} if weighed else {}))
    got = sorted(map(tuple, ask().collect()))
    assert got == sorted(map(tuple, want.select("query", "id", "score").collect())) and len(got) > 60
    monkeypatch.setattr(saved, "MOST_PATTERNS", 4)  # several automata
    assert sorted(map(tuple, ask().collect())) == got


def test_saved_queries_of_nothing(spark):
    rows, now = postings(spark, 5), F.lit("2024-06-01").cast("timestamp")
    lines = rows.select("id", F.col("id").alias("text_id"), F.col("posted_at").alias("ts"))
    texts = rows.withColumnRenamed("id", "text_id")
    none = saved.as_table(spark, {"x": Intent()})
    assert saved.top(texts, lines, none, now, 5).collect() == [] == saved.top(texts.where("false"), lines.where("false"), saved.as_table(spark, {"a": ANALYST}), now, 5).collect()
    told = saved.plain(spark.createDataFrame([("Sr. ML Eng",)], "q string"), "q", "q").first()
    assert (told.normalised, told.terms) == ("senior machine learning engineer", ["senior", "machine", "learning", "engineer"])


def test_many_queries_are_no_literals(spark):
    """A thousand queries leave the plan as it is for one."""
    rows, now = postings(spark, 20), F.lit("2024-06-01").cast("timestamp")
    lines = rows.select("id", F.col("id").alias("text_id"), F.col("posted_at").alias("ts"))
    queries = saved.plain(spark.range(1000).select(F.concat_ws(" ", F.lit("data"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("q")), "q", "q")
    df = saved.top(rows.withColumnRenamed("id", "text_id"), lines, queries, now, 3)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "w999" not in plan and "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() > 0


PHRASES = ["sql", "power bi", "c++", ".net", "c", "node.js", "a/b testing", "r", "ci/cd", "data", "data  lake", "++", "", "c#", "new delhi", "delhi"]


def test_phrases_at_word_boundaries(spark):
    rng = random.Random(9)
    bits = ["sql", "power", "bi", "c++", "c", ".net", "asp.net", "node.js", "node js", "a/b", "testing", "r", "ci/cd", "data", "lake", " ", ", ", "#", "new", "delhi", "renew", "(", ")", "é", "c#", "\n"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["", None, ".net", "c++", "use c++", "c++x", "+c++", "x.net", "a b", "new delhi"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumns({"core_": F.lit("x"), "pieces_": F.lit(1)})
    phrases = spark.createDataFrame([(p, f"n:{p}") for p in PHRASES] + [(None, "none")], "phrase string, name string")
    hit = lambda t, p: bool(re.search(rf"(?<![a-z0-9]){re.escape(p)}(?![a-z0-9])", t or ""))
    known = [p for p in PHRASES if re.search("[a-z0-9]", p)]
    got = {(r.id, r.phrase) for r in dictionary.phrase_hits(rows, ["id"], "text", phrases, "phrase").collect()}
    assert got == {(i, p) for i, t in enumerate(texts) for p in known if hit(t, p)}
    two = {r.id: r.found for r in dictionary.phrases_in(rows, ["id"], "text", phrases, "phrase", 2).collect()}
    held = {i: sorted((p for p in known if hit(t, p)), key=lambda p: (-len(p), p))[:2] for i, t in enumerate(texts)}
    assert two == {i: p for i, p in held.items() if p}
    best = {r.id: r.name for r in dictionary.longest_alias(rows, ["id"], "text", phrases, "phrase", "name").collect()}
    assert best == {i: f"n:{p[0]}" for i, p in held.items() if p}
    assert dictionary.phrase_hits(rows, ["id"], "text", phrases.where("false"), "phrase").collect() == []


def test_a_dictionary_is_one_join(spark):
    rows = spark.createDataFrame([(1, "w7 w8 x")], "id int, text string")
    phrases = spark.range(5000).select(F.concat_ws(" ", F.concat(F.lit("w"), F.col("id").cast("string")), F.concat(F.lit("w"), (F.col("id") + 1).cast("string"))).alias("phrase"))
    found = dictionary.phrase_hits(rows, ["id"], "text", phrases, "phrase")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "w4999" not in plan and [r.phrase for r in found.collect()] == ["w7 w8"]


def test_runs_are_compiled_and_put_together_once(spark):
    """No function of elements and no inferred filter works on the runs: each is put together in one place of the plan, each text is cut in one."""
    rows, phrases = spark.createDataFrame([(1, "w7 w8 x"), (2, ""), (3, None), (4, " w8")], "id int, text string"), spark.createDataFrame([("w7 w8",), ("w8",), ("--",)], "phrase string")
    found = dictionary.phrase_hits(rows, ["id"], "text", phrases, "phrase")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("array_join(") == 1 and plan.count("([a-z0-9]+|[^a-z0-9]+)") == 1
    assert sorted((r.id, r.phrase, r.at) for r in found.collect()) == [(1, "w7 w8", 0), (1, "w8", 2), (4, "w8", 1)]


RUBRIC = cv.Rubric({"impact": 50.0, "structure": 40.0, "language": 10.0}, "language", ((0, "Rebuild"), (30, "Weak"), (50, "Needs work"), (70, "Solid"), (90, "Strong")))
RULES = [quality.Rule("stack", "high", "synergy")]


def graded(spark, text, answer, n=1):
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    found = quality.findings(docs, RULES, [], "cv", "id", "text")
    out = cv.score(docs, spark.createDataFrame([(1, answer)], "id int, answer string"), found, RUBRIC).collect()
    return out[0] if out else None


def test_scores_are_held_within_their_weights(spark):
    every = json.dumps({"scores": {c: {"score": 999, "reason": "r" * 400} for c in RUBRIC.weights}, "top_fixes": list(range(9)), "missing_keywords": [f"k{i}" for i in range(20)], "summary": "s" * 900})
    got = graded(spark, "Cut costs by 40%", every)
    assert (got.total, got.partial, got.band, len(got.fixes), len(got.keywords), len(got.summary)) == (100.0, False, "Strong", 5, 12, 600)
    assert [(s.criterion, s.score, s.max, len(s.reason)) for s in got.scores][:2] == [("impact", 50.0, 50.0, 300), ("structure", 40.0, 40.0, 300)]
    got = graded(spark, "Cut costs", "```json\n" + json.dumps({"scores": {"impact": {"score": -50}, "structure": {"score": "12.25"}}}) + "\n```")
    assert (got.total, [s.score for s in got.scores]) == (22.3, [0.0, 12.3, 10.0]) or (got.total, [s.score for s in got.scores]) == (22.2, [0.0, 12.2, 10.0])
    got = graded(spark, "synergy", json.dumps({"scores": {"impact": "nine", "structure": {"score": None}}, "top_fixes": "no", "summary": None}))
    assert (got.total, got.band, got.fixes, got.summary, got.scores[2].reason) == (7.0, "Rebuild", [], "", "1 language issues found by pattern check.")


@pytest.mark.parametrize("answer", [None, "junk", "[]", '{"scores": [1, 2]}', '{"candidates": []}', '{"scores": "x"}'])
def test_without_an_answer_there_is_no_total(spark, answer):
    got = graded(spark, "synergy " * 4, answer)
    assert (got.total, got.partial, got.band, [(s.criterion, s.score) for s in got.scores], len(got.fixes)) == (None, True, None, [("language", 0.0)], 4)
    assert graded(spark, "  \n ", answer) is None


def test_patterns_of_addresses(spark):
    found = spark.createDataFrame([("a.io", "info@a.io"), ("a.io", "support@a.io"), ("b.io", "priya.sharma@b.io"), ("b.io", "info@b.io"), ("b.io", "z_z@b.io"), ("c.io", "zoe@c.io"), ("c.io", "john-doe@c.io"), ("d.io", "b_c@d.io"), ("d.io", "c.d@d.io")],
                                  "domain string, address string")
    assert {tuple(r) for r in outreach.patterns(found).collect()} == {
        ("b.io", "first.last", "found priya.sharma@b.io", 2), ("c.io", "first", "found john-doe@c.io (single-name pattern)", 2), ("d.io", "first_last", "found b_c@d.io", 2)}
    pages = spark.createDataFrame([("a.io", "Ann.Lee@a.io x@www.a.io y@b.io Ann.Lee@a.io")], "site string, text string")
    assert {tuple(r) for r in outreach.addresses(pages, "text", "site").collect()} == {("a.io", "ann.lee@a.io"), ("a.io", "x@www.a.io")}
    assert {r.domain for r in outreach.addresses(pages, "text").collect()} == {"a.io", "b.io"}


def test_contacts(spark):
    rows = spark.createDataFrame([(1, "Acme", "https://careers.acme.com/1", "https://x.naukri.com", "contact Priya Sharma"), (2, "B & Co", None, "https://in.linkedin.com/1", "nothing"), (3, "C", "", "https://c.io/1", None)],
                                 "id int, company string, apply_url string, url string, description string")
    known = spark.createDataFrame([("careers.acme.com", "f.last", "found a.b@careers.acme.com", 1)], "domain string, pattern string, evidence string, named long")
    named = spark.createDataFrame([(1, 0, "Hiring Manager", "x"), (1, 1, "Priya", "x"), (1, 2, " Jo Ann Lee ", "Recruiter"), (3, 0, "Al Bo", None)] + [(3, i, f"Al Bo{'abcdef'[i]}", "r") for i in range(1, 6)], "id int, nth int, name string, role string")
    got = sorted((r.id, r.nth, r.name, r.role, r.email, r.basis) for r in outreach.contacts(rows, known, named).collect())
    search, basis = "Recruiter / hiring manager (search manually)", "found a.b@careers.acme.com"
    assert got[:4] == [(1, 0, "Priya Sharma", "named in the posting", "p.sharma@careers.acme.com", basis), (1, 1, "Jo Ann Lee", "Recruiter", "j.lee@careers.acme.com", basis), (1, 2, "", search, "", ""), (2, 0, "", search, "", "")]
    assert [(n, name, e) for i, n, name, _, e, _ in got if i == 3] == [(0, "Al Bo", ""), (1, "Al Boa"[:5] + "b", ""), (2, "Al Boc", ""), (3, "Al Bod", ""), (4, "", "")]
    links = {(r.id, r.nth): r.link for r in outreach.contacts(rows, known, named).collect()}
    assert links[2, 0].endswith("keywords=B+%26+Co+%28recruiter+OR+talent+acquisition+OR+hiring+manager%29") and links[1, 0].endswith("Priya+Sharma+Acme")




def test_saved_queries_take_few_postings_of_a_text(spark):
    """Alike texts are scored once, and of each only as many postings as a query may show meet the queries."""
    texts = score.prepare(spark.createDataFrame([(1, "red ring"), (2, "red ring"), (3, "old gear")], "text_id int, title string").withColumns(
        {"company": F.lit("Acme"), "skills": F.array().cast("array<string>"), "tags": F.array().cast("array<string>"), "summary": F.lit(""), "description": F.lit("")}))
    postings = spark.range(90).select(F.format_string("p%02d", "id").alias("id"), (F.col("id") % 3 + 1).cast("int").alias("text_id"),
                                      F.when(F.col("id") != 4, F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 6) * 86400)).alias("ts"))
    queries = saved.plain(spark.createDataFrame([("red ring",)], "q string"), "q", "q")
    best = saved.top(texts, postings, queries, F.timestamp_seconds(F.lit(1_701_296_000)), 5)
    assert "windowspecdefinition(text_id" in best._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in best.collect()) == ["p04", "p84", "p85", "p87", "p88"]


def test_sums_run_within_each_text(spark):
    rows = spark.createDataFrame([(1, "a,bb,\n- Led x,\n  • Led yy"), (2, None), (3, ""), (4, "- é,")], "id int, text string").coalesce(1)
    hits = quality.rule_hits(rows, [quality.Rule("comma", "low", ","), quality.Rule("b", "low", "b+")], "id", "text")
    assert sorted((r.id, r.rule, r.nth, r.start, r.end) for r in hits.collect()) == [(1, "b", 1, 2, 4), (1, "comma", 1, 1, 2), (1, "comma", 2, 4, 5), (1, "comma", 3, 13, 14), (4, "comma", 1, 3, 4)]
    lines = quality.bullet_lines(rows, "id", "text")
    assert "Window" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.nth, r.start, r.bullet) for r in lines.collect()) == [(1, 1, 6, "Led x,"), (1, 2, 15, "Led yy"), (4, 0, 0, "é,")]
