"""Ranking, resolution, corpus and source operators on small tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from millrace.functions.geo import Gazetteer
from millrace.operators import corpus, enrich, facets, rank, resolve, score, search, suffix, tracker
from millrace.operators.intent import Family, Vocabulary, understand
from millrace.plans import batch
from millrace.schema import POSTING, conform, usable
from millrace.sources import cards, payloads
from millrace.sources.datasource import LandedPayloads, register
from millrace.streaming import upsert

AS_OF = dt.datetime(2024, 6, 1)
VOCAB = Vocabulary((Family("analyst", ("data analyst",), ("bi analyst", "reporting analyst"), ("sql", "excel"), ("scientist",)),
                    Family("scientist", ("data scientist",), ("statistician",), ("python",), ("analyst",))), {"entry level": "entry", "senior": "senior"}, ("see posting",))


def jobs(spark, *rows):
    """rows of dicts, completed to postings with an order of arrival."""
    full = [{"title": "", "company": "Acme", "source": "x", "posted_at": AS_OF, **r, "ord": i} for i, r in enumerate(rows)]
    kinds = {f.name: f.dataType.simpleString() for f in POSTING} | {"ord": "long"}
    names = sorted({k for r in full for k in r})
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], ", ".join(f"{n} {kinds[n]}" for n in names))
    out = conform(df, F.lit(AS_OF).cast("timestamp")).withColumn("k_", F.monotonically_increasing_id())
    return out.join(df.select("title", "company", "source", F.col("ord")).withColumn("k_", F.monotonically_increasing_id()).select("k_", "ord"), "k_").drop("k_")


def ranking(spark, query, *rows):
    intent = understand(query, VOCAB)
    found = score.prepare(jobs(spark, *rows)).withColumn("score", score.relevance(
        intent, F.lit(AS_OF).cast("timestamp"), ts=F.col("posted_at"), level=F.col("seniority"), noise=rank.noise_title(F.col("title_n"), VOCAB.noise_titles), description=F.col("description")))
    return [r.title for r in rank.top(found, 0).collect()]


@pytest.mark.parametrize(("query", "winner", "loser"), [
    ("data analyst", "Data Analyst", "Data Scientist"), ("data analyst", "BI Analyst", "Analyst"), ("data analyst", "Data Analyst", "Senior Lead Data Analyst, Risk and Fraud"),
    ("statistician", "Statistician", "Data Analyst"), ("data scientist", "Data Scientist", "Reporting Analyst")])
def test_pairwise_order(spark, query, winner, loser):
    got = ranking(spark, query, {"title": loser}, {"title": winner})
    assert got[0] == winner


def test_skill_query_finds_bodies_and_unrelated_is_dropped(spark):
    assert ranking(spark, "tableau", {"title": "Planner", "description": "uses tableau daily"}, {"title": "Driver"}) == ["Planner"]


def test_intent():
    intent = understand("entry level data analyst", VOCAB)
    assert (intent.family, intent.seniority, intent.rivals) == ("analyst", "entry", ("data scientist",))
    assert understand("tableau", VOCAB).terms == ("tableau",)


def test_floor_relaxes_only_for_more(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([0.9, 0.3, 0.25, 0.1])], "id int, score double")
    got = {r.id: (r.strong_count, r.relaxed) for r in rank.relevance_floor(rows, order=("id",)).collect()}
    assert got == {0: (1, True), 1: (1, True), 2: (1, True)}
    strong = spark.createDataFrame([(i, 0.5) for i in range(6)] + [(9, 0.3)], "id int, score double")
    assert {r.id for r in rank.relevance_floor(strong, order=("id",)).collect()} == set(range(6))
    assert rank.relevance_floor(rows.where("false"), order=("id",)).count() == 0


def test_token_sort_ratio():
    assert resolve.token_sort_ratio("data analyst", "analyst data") == 100
    assert resolve.token_sort_ratio("", "") == 100
    assert round(resolve.token_sort_ratio("abc", "abd"), 3) == 66.667


def test_resolve_merges_and_folds(spark):
    rows = jobs(spark, {"title": "Data Analyst", "source": "linkedin", "description": "long text", "tags": ["Experience: 5 yrs", "a"], "salary_min": 5.0},
                {"title": "Data Analyst (Urgent)", "source": "ats:lever", "tags": ["Experience: 3 yrs"], "posted_at": dt.datetime(2024, 5, 1)},
                {"title": "Data Analysts", "source": "adzuna", "tags": ["b"]}, {"title": "Plumber"}, {"title": "Data Analyst", "company": "Other"})
    got = {(r.company, r.title): r for r in resolve.resolve(rows).collect()}
    assert set(got) == {("Acme", "Data Analyst (Urgent)"), ("Acme", "Plumber"), ("Other", "Data Analyst")}
    one = got["Acme", "Data Analyst (Urgent)"]
    assert (one.source, one.description, one.salary_min, one.posted_at) == ("ats:lever", "long text", 5.0, dt.datetime(2024, 5, 1))
    assert one.tags == ["Experience: 3 yrs", "a", "also:linkedin", "b", "also:adzuna"]


def test_upsert_keeps_what_was_paid_for(spark):
    old = jobs(spark, {"title": "A", "skills": ["sql"], "summary": "s", "enriched": True, "description": "d", "first_seen_at": dt.datetime(2024, 1, 1), "posted_at": dt.datetime(2024, 5, 20)},
               {"title": "Old", "posted_at": dt.datetime(2023, 1, 1)}).drop("ord")
    new = jobs(spark, {"title": "A", "tags": ["t"]}, {"title": "B"}).drop("ord")
    now = F.lit(AS_OF).cast("timestamp")
    got = {r.title: r for r in corpus.retained(corpus.upsert(old, new, now), now).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"].skills, got["A"].enriched, got["A"].description, got["A"].first_seen_at) == (["sql"], True, "d", dt.datetime(2024, 1, 1))


def test_toggles(spark):
    events = spark.createDataFrame([("a", "s", 1), ("a", "s", 2), ("b", "s", 1), ("b", "h", 2), ("c", "s", 1), ("c", "s", 2), ("c", "s", 3)], "id string, mark string, n int")
    assert {tuple(r) for r in corpus.toggled(events, ["id"], "mark", ["n"]).collect()} == {("b", "h"), ("c", "s")}


def test_shards_drop_and_prune(spark, tmp_path):
    rows = jobs(spark, {"title": "A"}, {"title": "B"}).drop("ord")
    corpus.write_corpus(rows, str(tmp_path / "c"))
    wanted = rows.first()
    assert corpus.read_posting(spark, str(tmp_path / "c"), wanted.id).first().title == wanted.title
    corpus.write_corpus(rows.where(F.col("id") == wanted.id), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1


def test_lookup(spark):
    rows = spark.createDataFrame([("abc",), ("abd",)], "id string")
    assert rank.lookup(rows, "id", "abc").first().id == "abc"
    assert rank.lookup(rows, "id", "abd").first().id == "abd"
    with pytest.raises(LookupError):
        rank.lookup(rows, "id", "ab")
    with pytest.raises(LookupError):
        rank.lookup(rows, "id", "z")


def test_suffix_and_facets(spark):
    slugs = spark.createDataFrame([("data-analyst-acme-corp",), ("acme",), ("x-y",)], "slug string")
    names = spark.createDataFrame([("corp",), ("acme-corp",)], "name string")
    assert [tuple(r) for r in suffix.longest_suffix(slugs, "slug", names, "name").collect()] == [("data-analyst-acme-corp", "acme-corp", "data-analyst")]
    runs = spark.createDataFrame([("a", 1, 5, 10, False, "x"), ("a", 2, 1, 10, True, ""), ("b", 1, 0, 1, False, "e1"), ("b", 2, 0, 1, False, "")],
                                 "source string, seq int, jobs_found long, duration_ms long, ok boolean, error string")
    assert {tuple(r) for r in facets.health(runs).collect()} == {("a", 6, 20, True, ""), ("b", 0, 2, False, "e1")}
    assert {tuple(r) for r in facets.phrase_facet(names, "name", {"c": ["corp"], "n": ["zz"]}).collect()} == {("c", 2), ("n", 0)}


def land(spark, source, payload):
    return spark.createDataFrame([(source, "tok", "Acme", payload)], "source string, token string, company string, payload string")


@pytest.mark.parametrize(("source", "payload", "title", "location"), [
    ("ats:greenhouse", '{"jobs":[{"title":"T","location":{"name":"Pune"},"absolute_url":"u","content":"<p>Hi</p>","updated_at":"2024-01-02T00:00:00Z"}]}', "T", "Pune"),
    ("ats:lever", '[{"text":"T","categories":{"location":"Pune"},"hostedUrl":"u","descriptionPlain":"Hi","createdAt":1700000000000,"lists":[{"text":"More","content":"<li>x</li>"}]}]', "T", "Pune"),
    ("ats:workable", '{"jobs":[{"title":"T","location":{"city":"Pune","region":"","country":"India"},"url":"u"}]}', "T", "Pune, India"),
    ("ats:smartrecruiters", '{"content":[{"id":"7","name":"T","location":{"city":"Pune","remote":true}}]}', "T", "Pune"),
    ("ats:recruitee", '{"offers":[{"title":"T","city":"Pune","country_code":"IN","url":"u"}]}', "T", "Pune, IN"),
    ("ats:ashby", '{"jobs":[{"title":"T","location":"Pune","jobUrl":"u","isRemote":true,"compensation":{"compensationTierSummary":"$100k - $120k"}}]}', "T", "Pune"),
    ("adzuna", '{"results":[{"title":"T","location":{"display_name":"Pune"},"salary_min":5,"salary_max":6}]}', "T", "Pune"),
    ("remoteok", '[{"legal":"x"},{"position":"T","url":"u","location":"","salary_min":100}]', "T", "Remote"),
    ("himalayas", '{"jobs":[{"title":"T","locationRestrictions":["A","B"],"guid":"g"}]}', "T", "A, B"),
    ("remotive", '{"jobs":[{"title":"T","url":"u","salary":"$90k"}]}', "T", "Remote"), ("arbeitnow", '{"data":[{"title":"T","location":"Bonn"}]}', "T", "Bonn"),
    ("weworkremotely", '{"item":[{"title":"Acme: T","link":"u"},{"title":"","link":"v"}]}', "T", "Remote")])
def test_feeds(spark, source, payload, title, location):
    rows = payloads.postings_of(land(spark, source, payload), source).collect()
    assert [(r.title, r.location) for r in rows] == [(title, location)]


def test_a_dead_board_gives_nothing(spark):
    landed = land(spark, "ats:greenhouse", "<html>").unionByName(land(spark, "ats:lever", None))
    found = payloads.postings_of(landed, "ats:greenhouse")
    assert found.count() == 0
    assert {r.source: r.ok for r in payloads.fan_out_health(landed, found).collect()} == {"ats:greenhouse": True, "ats:lever": False}


def test_comments_cards_and_caches(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(payloads.parse_posting(F.col("t")).alias("p")).first().p
    assert tuple(one("Acme | Remote | Data Engineer | Berlin | $100k\nmore")) == ("Acme", "Data Engineer", "Remote · Berlin")
    assert tuple(one("Backend Engineer at Acme in Berlin")) == ("Acme", "Backend Engineer", "Berlin")
    assert one("just chatting") is None
    pages = spark.createDataFrame([(1, '<div class="card"><a class="t" href="/x">Job <b>A</b></a></div><div class="card"><a class="t" href="/y">B</a></div>')], "id int, html string")
    assert [tuple(r) for r in cards.cards(pages, "id", "html", "card", {"title": "t", "url": "t@href"}).collect()] == [(1, "Job A", "/x"), (1, "B", "/y")]
    cache = spark.createDataFrame([('{"Listing:1":{"startup":{"__ref":"Startup:9"}},"Listing:2":{},"Startup:9":{"name":"Acme"}}',)], "payload string")
    assert [(r.id, r.owner_id) for r in payloads.cached_listings(cache, "Listing", "Startup").collect()] == [("1", "9")]
    site = spark.createDataFrame([("<url><loc>http://a/b</loc><lastmod>2024-01-01</lastmod></url>",)], "value string")
    assert payloads.sitemap_urls(site).first().url == "http://a/b"


def test_landed_source(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"jobs":[]}')
    spark.dataSource.register(LandedPayloads)
    boards = spark.read.format("landed").option("source", "s").option("boards", f"a={tmp_path}/a.json,b={tmp_path}/none")
    with pytest.raises(Exception, match="No such file"):
        boards.load().collect()
    got = boards.option("missing", "blocked").load()
    assert {(r.token, r.payload) for r in got.collect()} == {("a", '{"jobs":[]}'), ("b", None)}
    with pytest.raises(ValueError):
        register(LandedPayloads)


def test_enrichment(spark):
    rows = jobs(spark, {"title": "Senior Analyst", "description": "sql", "tags": ["also:x"]}, {"title": "B"}).drop("ord")
    assert {r.title: (r.skills, r.seniority) for r in enrich.heuristic(rows, ["sql"]).collect()}["Senior Analyst"] == (["sql"], "senior")
    answers = enrich.ask(rows, lambda batch: ['```json\n{"skills":["sql"],"seniority":"lead","tags":["t"]}\n```' if r["title"] == "B" else None for r in batch])
    got = {r.title: r for r in enrich.apply(rows, answers).collect()}
    assert (got["B"].seniority, got["B"].enriched, got["Senior Analyst"].enriched) == ("lead", True, False)

    def fails(batch):
        raise RuntimeError

    assert [r.answer for r in enrich.ask(rows, fails).collect()] == [None, None]


def test_streamed_upsert(spark, tmp_path):
    rows = jobs(spark, {"title": "A"}, {"title": "B"}).drop("ord")
    rows.write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema(POSTING).parquet(str(tmp_path / "in/*"))
    q = (stream.writeStream.foreachBatch(upsert.upsert_batch(str(tmp_path / "c"), POSTING, [F.desc("last_seen_at")])).option("checkpointLocation", str(tmp_path / "k"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert upsert.current(spark, str(tmp_path / "c"), POSTING).count() == 2


def test_streamed_upsert_after_a_crash(spark, tmp_path):
    """A half-written version does not count, a batch that runs again reads the version before its own, and old versions go."""
    root, one = str(tmp_path / "c"), lambda t: jobs(spark, {"title": t}).drop("ord")
    run = upsert.upsert_batch(root, POSTING, [F.desc("last_seen_at")])
    run(one("A"), 0)
    run(one("B"), 1)
    (tmp_path / "c" / "v1" / "_SUCCESS").unlink()
    assert {r.title for r in upsert.current(spark, root, POSTING).collect()} == {"A"}
    run(one("B"), 1)
    run(one("B"), 1)
    run(one("C"), 2)
    run(one("D"), 3)
    assert {r.title for r in upsert.current(spark, root, POSTING).collect()} == {"A", "B", "C", "D"}
    assert upsert.versions(spark, root) == [1, 2, 3]


def test_longest_suffix_keeps_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "old-red-ring"), (1, "old-red-ring")], "k int, slug string").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = suffix.longest_suffix(rows, "slug", spark.createDataFrame([("ring",), ("red-ring",)], "e string"), "e").collect()
    assert [(r.k, r.matched, r.rest, r.m) for r in got] == [(1, "red-ring", "old", {"a": 1})] * 2


def test_terms_have_two_characters_at_least():
    assert understand("c developer", Vocabulary()).terms == ("developer",)


def test_rule_hits_tell_where_and_keep_back_references(spark):
    from millrace.functions import quality

    docs = spark.createDataFrame([(1, "so so it is, no no"), (2, None)], "id int, text string")
    got = quality.rule_hits(docs, [quality.Rule("twice", "low", r"\b(\w+) \1\b")], "id", "text").orderBy("nth").collect()
    assert [(r.excerpt, r.start, r.end) for r in got] == [("so so", 0, 5), ("no no", 13, 18)]


def test_last_object_of_a_reference_wins_by_page(spark):
    pages = spark.createDataFrame([(2, '{"C:1":"{\\"n\\":\\"new\\"}"}'), (1, '{"C:1":"{\\"n\\":\\"old\\"}","L:7":"{\\"startup\\":{\\"__ref\\":\\"C:1\\"}}"}')], "page int, payload string")
    assert [r.owner for r in payloads.cached_listings(pages, "L", "C", "page").collect()] == ['{"n":"new"}']


def test_landed_folder(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'{"jobs":[]}\xff')
    got = payloads.landed(spark, str(tmp_path), "s", {"a": "A", "b": "B"}).collect()
    assert {(r.token, r.company, (r.payload or "")[:11]) for r in got} == {("a", "A", '{"jobs":[]}'), ("b", "B", "")}


def test_token_sort_ratio_against_the_table_of_lengths():
    import random

    def table(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randint(0, 70))) for _ in range(2))
        x, y = (" ".join(sorted(s.split())) for s in (a, b))
        assert resolve.token_sort_ratio(a, b) == (200 * table(x, y) / (len(x) + len(y)) if x or y else 100)


def test_leaders_against_comparing_all(spark):
    import random

    rng = random.Random(5)
    titles = [" ".join(rng.sample(["data", "dato", "analyst", "analist", "senior", "lead", "x", "engineer"], rng.randint(1, 4))) for _ in range(120)]
    rows = jobs(spark, *({"title": t, "company": "Acme"} for t in titles)).withColumn("source", F.lit("adzuna"))
    keys, leaders = list(dict.fromkeys(titles)), []
    for t in keys:
        if not any(resolve.token_sort_ratio(t, other) >= resolve.ALIKE for other in leaders):
            leaders.append(t)
    assert resolve.resolve(rows).count() == len(leaders)


def test_ranking_plans_normalise_once(spark):
    from millrace import catalog

    for name in ("rank_topk", "rank_full_score", "union_of_topk", "relevance_floor"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        scans = plan.count("p_partkey#") and plan.count("l_shipdate#") and sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines())
        assert 0 < plan.count("regexp_replace(") < 50 * scans, (name, scans, plan.count("regexp_replace("))


PLACES = Gazetteer({"delhi": ("new delhi",), "noida": (), "pune": ()}, {"ncr": ("delhi", "noida")})


def searched(spark, f, *rows):
    found = search.apply_filters(jobs(spark, *rows), f, VOCAB, PLACES, F.lit(AS_OF).cast("timestamp")).collect()
    return [r.title for r in found], {(r.strong_count, r.relaxed) for r in found}


def test_filters_by_facet_and_place(spark):
    rows = [{"title": "Clerk", "remote": "remote", "location": "Pune"}, {"title": "Data Analyst", "location": "Noida", "remote": "onsite", "salary_max": 9e5, "salary_currency": "INR"},
            {"title": "Data Scientist", "location": "New Delhi", "salary_max": 2e4, "salary_currency": "USD", "posted_at": AS_OF - dt.timedelta(days=3)}]
    assert searched(spark, search.Filters(), *rows)[1] == {(3, False)}
    assert searched(spark, search.Filters(sort="newest"), *rows)[0][-1] == "Data Scientist"
    assert searched(spark, search.Filters(remote="remote"), *rows)[0] == ["Clerk"]
    assert searched(spark, search.Filters(cities=("delhi",)), *rows)[0] == ["Data Scientist", "Data Analyst"]
    assert searched(spark, search.Filters(cities=("delhi",), include_nearby=False), *rows)[0] == ["Data Scientist"]
    assert searched(spark, search.Filters(sort="salary"), *rows)[0] == ["Data Scientist", "Data Analyst", "Clerk"]
    assert searched(spark, search.Filters(min_salary=1e6), *rows)[0] == ["Data Scientist"]
    assert searched(spark, search.Filters(max_age_days=2.5), *rows, {"title": "Old", "posted_at": AS_OF - dt.timedelta(days=2.6)})[0].count("Old") == 0
    assert searched(spark, search.Filters(source="y"), *rows) == ([], set())


def test_filters_by_role_and_query(spark):
    rows = [{"title": "Data Analyst", "company": "Python House"}, {"title": "Statistician"}, {"title": "Gardener"}]
    assert searched(spark, search.Filters(roles=("analyst", "scientist")), *rows)[0] == ["Data Analyst", "Statistician"]
    assert searched(spark, search.Filters(roles=("analyst", "scientist"), q="python"), *rows)[0] == ["Data Analyst"]
    assert searched(spark, search.Filters(q="gardener"), *rows) == (["Gardener"], {(1, False)})
    assert searched(spark, search.Filters(roles=("no such",), q="statistician"), *rows)[0][0] == "Statistician"


def test_filters_in_a_link():
    f = search.Filters(q="data analyst", cities=("delhi", "pune"), include_nearby=False, max_age_days=7, min_salary=1_500_000, sort="newest")
    assert search.to_url(f) == "?q=data+analyst&cities=delhi%2Cpune&near=0&age=7&pay=1500000&sort=newest"
    assert search.from_url(search.to_url(f)) == f
    assert (search.to_url(search.Filters()), search.from_url("")) == ("", search.Filters())
    assert search.from_url("cities=a,, a ,b").cities == ("a", "b")
    assert search.from_url("loc=New+Delhi", PLACES).cities == ("delhi",) and search.from_url("loc=New+Delhi&cities=pune", PLACES).cities == ("pune",)


def test_saved_corpus(spark, tmp_path):
    rows = conform(jobs(spark, {"title": "A", "description": "long text", "source": "x", "apply_url": "u"}, {"title": "B", "source": "y"}).drop("ord"), F.lit(AS_OF).cast("timestamp"))
    runs = spark.createDataFrame([("x", 3, 10, True, ""), ("y", 9, 10, False, "e"), ("z", 5, 1, False, "")], "source string, jobs_found long, duration_ms long, ok boolean, error string")
    corpus.save(rows, runs, str(tmp_path / "c"), F.lit("2024-06-01"))
    back = corpus.load(spark, str(tmp_path / "c"))
    assert sorted((r.title, r.description, r.apply_url) for r in back.collect()) == [("A", "long text", "u"), ("B", "", "")]
    assert corpus.load(spark, str(tmp_path / "c"), rebuild=True).count() == 0
    meta = spark.read.json(f"{corpus.version(spark, str(tmp_path / 'c'))}/meta").first()
    assert (meta.total, meta.sources_ok, meta.sources_failed, meta.by_source.asDict(), meta.updated_at) == (2, 1, 2, {"x": 1, "y": 1}, "2024-06-01")
    assert [r.source for r in facets.health_order(runs).collect()] == ["y", "z", "x"]
    assert tuple(facets.health_state(runs).first()) == (1, 2, "amber")


def test_a_crash_at_any_step_leaves_the_corpus_whole(spark, tmp_path, monkeypatch):
    path, runs = str(tmp_path / "c"), spark.createDataFrame([("x", 3, 10, True, "")], "source string, jobs_found long, duration_ms long, ok boolean, error string")
    make = lambda *titles: conform(jobs(spark, *({"title": t, "description": f"about {t}"} for t in titles)).drop("ord"), F.lit(AS_OF).cast("timestamp"))
    held = lambda: sorted((r.title, r.description) for r in corpus.load(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        corpus.load(spark, path)
    corpus.save(make("A", "B"), runs, path, F.lit("1"))
    for step in ("index_projection", "write_corpus", "commit"):
        with monkeypatch.context() as m:
            m.setattr(corpus, step, lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError, match="lost"):
                corpus.save(make("C"), runs, path, F.lit("2"))
        assert held() == [("A", "about A"), ("B", "about B")]
    (tmp_path / "c/commits/00000000000000000002").touch()  # made, but not yet named
    assert held() == [("A", "about A"), ("B", "about B")]
    first = corpus.version(spark, path)
    corpus.save(make("C"), runs, path, F.lit("2"))
    assert held() == [("C", "about C")] and spark.read.parquet(f"{first}/index").count() == 2  # readers of the version before go on
    corpus.save(make("D"), runs, path, F.lit("3"))
    assert held() == [("D", "about D")] and len([f for f in os.listdir(path) if f.startswith("version-")]) == 2
    with pytest.raises(Exception, match="exist"):
        corpus.commit(spark, path, 4, "other")


def test_a_shard_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("ab"), F.col("id").cast("string")).alias("id"))
    corpus.write_corpus(rows, str(tmp_path / "c"), splits=4, file_rows=300)
    files = os.listdir(tmp_path / "c/shard=ab")
    assert len([f for f in files if f.endswith(".parquet")]) >= 4000 // 300 and spark.read.parquet(str(tmp_path / "c")).count() == 4000


def test_counts_of_a_run(spark):
    rows = jobs(spark, {"title": "Data Analyst", "description": "sql"}, {"title": "Data Analysts", "source": "y"}, {"title": "Plumber"}, {"title": "Data Analyst", "company": "Other"})
    now = F.lit(AS_OF).cast("timestamp")
    told = batch.dry_run(rows, rows.drop("ord").where("false"), [understand("data analyst", VOCAB)], now)
    assert told == {"raw": {"n": 4}, "resolved": {"n": 3}, "kept": {"n": 2}, "final": {"n": 2, "tier1": 2, "tier2": 0}}


def test_stored_rows_are_made_safe(spark):
    rows = spark.sql("""select * from values (1, ' Dev ', cast(null as string), 'HTTPS://x.io/1 ', 'odd', '12.5', 'NaN', array('sql', '', null), '2024-01-02', 'lead'),
      (2, '', 'Acme', 'https://x.io/2', 'remote', '-1', 'inf', null, 'soon', 'boss'), (null, 'Dev', ' ', 'javascript:x', 'hybrid', '5', '1e3', array(), null, null), (null, 'QA', 'B', 'http://y', 'onsite', null, '7', array(repeat('z', 200)), '', '')
      as t(id, title, company, url, remote, salary_min, salary_max, skills, posted_at, seniority)""")
    kept, dropped = usable(rows)
    got = {r.title: r for r in kept.collect()}
    assert dropped.first().dropped == 2 and set(got) == {"Dev", "QA"}
    dev, qa = got["Dev"], got["QA"]
    assert (dev.id, dev.company, dev.url, dev.remote, dev.salary_min, dev.salary_max, dev.skills, str(dev.posted_at)[:10], dev.seniority, dev.source, dev.tier, dev.first_seen_at.year) == (
        "1", "Unknown", "HTTPS://x.io/1", "unknown", 12.5, None, ["sql"], "2024-01-02", "lead", "unknown", "tier1", 1970)
    assert (qa.id, qa.company, qa.salary_max, qa.skills, qa.posted_at, qa.seniority, qa.tags, qa.summary) == ("http://y", "B", 7.0, ["z" * 120], None, "unknown", [], "")


def test_pages_plans_and_feeds(spark, tmp_path):
    rows = spark.range(95).orderBy("id")
    assert [r.id for r in rank.page(rows, 2).collect()] == list(range(80, 95)) and rank.page(rows, 3).count() == 0
    thin = spark.createDataFrame([(1, "short", "a"), (2, "x" * 80, "a"), (3, "", "b"), (4, "", "a")], "id int, description string, source string")
    assert [r.id for r in corpus.needs_details(thin, thin.where("id = 4").select("id"), ["a"]).collect()] == [1]
    sources = spark.createDataFrame([("feed", True, 1), ("board", False, 2)], "source string, query_independent boolean, pages int")
    asked = payloads.request_plan(sources, spark.createDataFrame([(["sql", "qa"],), (["sql"],)], "keywords array<string>"))
    assert sorted(map(tuple, asked.collect()), key=str) == sorted([("feed", None, 1)] + [("board", k, p) for k in ("qa", "sql") for p in (1, 2)], key=str)
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Acme: Dev</title><link>http://x</link></item><item><title>B</title></item></channel></rss>")
    assert [(r.title, r.link) for r in payloads.rss_items(spark, str(tmp_path / "f.xml")).collect()] == [("Acme: Dev", "http://x"), ("B", None)]


def test_scores_of_remote_long_and_wordless(spark):
    rows = score.prepare(jobs(spark, {"title": "Dev", "remote": "remote", "description": "y" * 401}, {"title": "Dev", "company": "B"}))
    now = F.lit(AS_OF).cast("timestamp")
    of = lambda q, **k: {r.company: r.s for r in rows.select("company", score.relevance(q, now, ts=F.col("posted_at"), **k).alias("s")).collect()}
    plain, far, long = (of(understand("dev", VOCAB), **k) for k in ({}, {"remote_only": True, "remote": F.col("remote")}, {"description": F.col("description")}))
    assert far["Acme"] == plain["Acme"] and far["B"] == round(plain["B"] * 0.2, 5) and long["Acme"] == round(plain["Acme"] * 1.04, 5) and long["B"] == plain["B"]
    assert of(understand("", VOCAB)) == {"Acme": 0.7, "B": 0.7}  # every row is as good as one that has all words


def test_details_and_urls(spark):
    index = spark.createDataFrame([(1, "old"), (2, "old"), (3, None)], "id int, description string")
    told = spark.createDataFrame([(1, "new", "year"), (2, None, None)], "id int, description string, period string")
    assert sorted(map(tuple, corpus.with_details(index, told).collect())) == [(1, "new", "year"), (2, None, None), (3, None, None)]
    pages = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "")], "id int, url string")
    assert sorted(r.id for r in corpus.first_by_url(pages, ["id"]).collect()) == [1, 3, 4, 5]


def test_tracker_rows(spark):
    pay = spark.createDataFrame([(1, 1234.5, 99999.0, "INR"), (2, 1500.0, 1500.0, None), (3, None, 5.0, "USD"), (4, 7.0, 0.0, "EUR"), (5, 8.0, None, "EUR")], "id int, a double, b double, c string")
    got = [r.t for r in pay.orderBy("id").select(tracker.salary_text(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()]
    assert got == ["INR 1,234–99,999", "1,500", "", "EUR 7", "EUR 8"]
    reports = spark.sql("select cast(null as int) as total, 'Fair' as band, map('impact', named_struct('score', 7, 'max', 10)) as scores, array(named_struct('problem', 'p', 'action', 'a'), named_struct('problem', 'q', 'action', null)) as top_fixes")
    row = tracker.cv_rows(reports, "analyst").first().asDict()
    assert (row["Score"], row["Impact"], row["ATS"], row["Top Fixes"], row["Target Role"]) == ("partial", "7/10", "", "p → a | q → ", "analyst")
    out = tracker.outreach_rows(spark.sql("select 1 as id, 'Acme' as company, 'Ann' as name, cast(null as string) as email")).first().asDict()
    assert (out["Contact Name"], out["Email"], out["Sent?"], out["Email Body"]) == ("Ann", "", "No", "")
