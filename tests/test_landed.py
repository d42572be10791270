"""Sources and texts as they land: sitemaps, nested arrays, comments, hydration."""

import gzip
import json

from pyspark.sql import functions as F

from millrace.functions import geo
from millrace.operators import hydrate, rank
from millrace.sources import boards, cards, comments, embedded, sitemap

CITIES = geo.Gazetteer({"delhi": ("new delhi", "delhi ncr"), "gurgaon": ("gurugram",), "pune": (), "bangalore": ("bengaluru",)}, country=("india",))
MOD = "2024-03-05T01:44:47.902+05:30"


def postings(spark, slugs, employers=("marlow", "fit-club", "north-finance", "big-consulting-services", "services", "zz"), mod=MOD):
    rows = spark.createDataFrame([(f"https://x.io/job-listings-{s}" if not s.startswith("http") else s, mod) for s in slugs], "url string, lastmod string")
    known = spark.createDataFrame([(e,) for e in employers], "employer string")
    return sitemap.url_postings(rows, known, CITIES).collect()


def test_title_and_employer_are_parted_by_the_dictionary(spark):
    got = postings(spark, ["food-sales-executive-marlow-new-delhi-2-to-7-years-190925012345"])[0]
    assert (got.title, got.company, got.location, got.seniority) == ("Food Sales Executive", "Marlow", "New Delhi", "mid")
    assert got.tags == ["Experience: 2-7 yrs", "Details on Naukri"]
    assert str(got.posted_at) == "2024-03-04 20:14:47.902000"


def test_the_longest_employer_wins_and_all_places_stay(spark):
    got = postings(spark, ["data-engineer-big-consulting-services-gurugram-delhi-ncr-6-to-11-years-19092501", "sql-analyst-zz-pune-bengaluru-delhi-ncr-5-to-8-years-190925012345"])
    assert {(r.title, r.company, r.location) for r in got} == {("Data Engineer", "Big Consulting Services", "Gurugram, Delhi NCR"), ("SQL Analyst", "Zz", "Pune, Bengaluru, Delhi NCR")}


def test_what_is_no_posting_goes(spark):
    bad = ["research-scientist-optics-unheard-labs-new-delhi-2-to-3-years-19092501", "marlow-new-delhi-1-to-3-years-190925012345", "x-marlow-1-to-3-years-190925012345", "no-band-marlow-190925012345",
           "cook-marlow-1-to-3-years-42", "http://x.io/data-jobs-in-delhi", "pune-new-delhi-1-to-2-years-19092501"]
    assert postings(spark, bad) == []
    assert postings(spark, ["cook-marlow-1-to-3-years-19092501"], employers=()) == []


def test_places_and_dates_that_are_unknown(spark):
    got = postings(spark, ["dance-coach-fit-club-9-to-14-years-19092501", "dance-coach-fit-club-surat-0-to-1-year-19092501/"], mod="soon")
    assert {(r.location, r.seniority, r.posted_at) for r in got} == {("India", "lead", None), ("Surat, India", "entry", None)}


def test_repeated_listings_stay(spark):
    assert len(postings(spark, ["cook-marlow-1-to-3-years-19092501"] * 3)) == 3


def test_sitemap_files_are_read_by_entry(spark, tmp_path):
    body = "<?xml version='1.0'?><urlset>" + "".join(f"<url>\n <loc> https://x.io/{i} </loc>\n<lastmod>2024-01-0{i}</lastmod></url>" for i in range(1, 4)) + "<url><loc>https://x.io/4</loc></url></urlset>"
    (tmp_path / "a.xml").write_text(body)
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(body.replace("x.io", "y.io").encode()))
    got = {(r.url, r.lastmod) for r in sitemap.entries(spark, str(tmp_path)).collect()}
    assert got == {(f"https://{h}.io/{i}", f"2024-01-0{i}" if i < 4 else None) for h in "xy" for i in range(1, 5)}
    listed = spark.createDataFrame([("https://www.naukri.com/fit-club-jobs-careers-123",), ("https://www.naukri.com/about",)], "url string")
    assert [r.employer for r in sitemap.employers(listed).collect()] == ["fit-club"]


def test_reading_stops_at_an_entry_not_at_a_line(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<url><loc>https://x.io/1</loc></url>" * 50)
    assert sitemap.entries(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 50


NEXT = '<script>self.__next_f.push([1,{}])</script>'
ROWS = [
    {"companyName": "Exelan", "detailUrl": "/jobs/data-scientist/1", "experienceLabel": "2 to 5 Yrs", "locations": ["Gurugram"], "postedAt": "2024-03-16T10:27:58", "salaryLabel": "12 - 14 Lakh/Yr",
     "skills": ["Python", "SQL"], "title": 'Data "Scientist" ] } — ₹'},
    {"companyName": "North", "detailUrl": "/jobs/2", "experienceLabel": "", "locations": ["Pune", "Chennai", "Noida", "Kochi", "Delhi", "India"], "salaryLabel": "Not Disclosed", "skills": [],
     "title": "Analyst", "postedAt": "soon", "deep": [[{"a": [[1, {"b": ["]", "\\", "\\\""]}]]}]]},
    {"companyName": "Broken", "title": "No link"}, "text"]


def flight(rows):
    payload = '1:{"pageCount":609,"jobs":' + json.dumps(rows) + ',"other":[1]}\n'
    cut = len(payload) // 3
    return "".join(NEXT.format(json.dumps(c)) for c in (payload[:cut], payload[cut:2 * cut], payload[2 * cut:]))


def page(spark, html, url="https://x.io/p"):
    return spark.createDataFrame([(url, html)], "url string, html string")


def test_shine(spark):
    got = boards.shine(page(spark, flight(ROWS))).collect()
    assert [r.title for r in got] == ['Data "Scientist" ] } — ₹', "Analyst"]
    one, two = got
    assert (one.url, one.location, one.skills, one.seniority, one.salary_max, one.salary_currency, one.salary_text, one.tags) == (
        "https://www.shine.com/jobs/data-scientist/1", "Gurugram, India", ["Python", "SQL"], "mid", 1.4e6, "INR", "12 - 14 Lakh/Yr", ["Experience: 2 to 5 Yrs"])
    assert str(one.posted_at) == "2024-03-16 04:57:58"  # Indian time
    assert (two.salary_max, two.salary_text, two.posted_at, two.seniority, two.location, two.tags) == (None, "", None, "unknown", "Pune, Chennai, Noida, Kochi +2 more, India", [])


def test_arrays_end_where_their_brackets_close(spark):
    def text(blob):
        return spark.createDataFrame([(blob,)], "b string").select(embedded.array_text(F.col("b"), "jobs")).first()[0]

    deep = '[{"a":[[[[["]]]]", {"x": "\\"}]"}]]]]]}, "\\\\"]'
    assert text('no "jobs" here') is None and text(None) is None
    assert text('{"x":[1],"jobs":' + deep + '],"jobs":[2]}') == deep
    assert text('"jobs":[1, [2, 3]') is None  # it never ends
    assert text('"jobs":[]') == "[]"
    many = json.dumps([{"t": 'say \\"x\\" ' * 20000}] * 3)
    assert text(f'z"jobs":{many}]]') == many
    long = flight([{**ROWS[0], "title": "a \" b \\ c " * 20000}])
    assert len(boards.shine(page(spark, long)).first().title) == len("a \" b \\ c " * 20000)
    assert boards.shine(page(spark, None)).collect() == [] == boards.shine(page(spark, '<script>self.__next_f.push([1,"x\\q"])</script>')).collect()


def as_of():
    return F.lit("2024-06-10 00:00:00").cast("timestamp")


def test_guest_cards(spark):
    html = """<ul><li><h3> Data <b>Scientist</b> </h3><h4><a>Acme</a></h4><a class="base-card__full-link" href="https://x.io/jobs/view/ds-4466?trk=1#a">go</a>
      <span class="job-search-card__location">Pune, India</span><time datetime="2024-06-01">1 week ago</time></li>
      <li><h3>Remote Analyst</h3><a href="/jobs/view/5">go</a><time>3 days ago</time><li><h3>No link</h3></li></ul>"""
    got = boards.linkedin(page(spark, html), as_of()).collect()
    assert [(r.title, r.company, r.location, r.url, str(r.posted_at)[:10], r.remote) for r in got] == [
        ("Data Scientist", "Acme", "Pune, India", "https://x.io/jobs/view/ds-4466", "2024-06-01", "unknown"), ("Remote Analyst", "Unknown", "", "/jobs/view/5", "2024-06-07", "remote")]


def test_internshala(spark):
    card = """<div class="container individual_internship" {own}><a class="job-title-href" href="{href}">Junior Analyst</a><p class="company-name">Acme</p><div class="locations"><span><a>{place}</a></span><span><a>Delhi</a></span></div>
      <div class="row-1-item"><i class="ic-16-money"></i><span class="desktop">x</span><span class="mobile">₹ 3,00,000 - 5,00,000 /year</span></div>
      <div class="row-1-item"><i class="ic-16-briefcase"></i><span>1 year(s)</span></div><div class="about_job"><div class="text">Learn &amp; build</div></div>
      <div class="color-labels"><span>Early applicant</span><span>3 days ago</span></div><span class="job_skill">SQL</span><span class="job_skill">Excel</span></div>"""
    html = "".join(card.format(own=own, href=href, place=place) for own, href, place in [
        ('employment_type="job"', "/job/1", "Pune"), ('employment_type="internship"', "/job/2", "Pune"), ('data-href="/job/3"', "", "Work from home")])
    one, two = boards.internshala(page(spark, html), as_of()).collect()
    assert (one.title, one.company, one.location, one.url, one.description, one.skills, one.seniority, one.tags, one.salary_min, one.salary_max, str(one.posted_at)[:10]) == (
        "Junior Analyst", "Acme", "Pune, Delhi, India", "https://internshala.com/job/1", "Learn & build", ["SQL", "Excel"], "entry", ["Experience: 1 year(s)"], 3e5, 5e5, "2024-06-07")
    assert (two.url, two.remote) == ("https://internshala.com/job/3", "remote")


def test_wellfound(spark):
    cache = {"Startup:1": {"__typename": "StartupResult", "name": "Acme", "highlightedJobListings": [{"__ref": "Listing:7"}, {"__ref": "Listing:8"}]},
             "Listing:7": {"__typename": "JobListingSearchResult", "id": "7", "title": "Data Scientist", "slug": "data-scientist", "locationNames": ["Gurgaon"], "compensation": "₹15L – ₹20L • 0.1%", "yearsExperienceMin": 3,
                           "yearsExperienceMax": 5, "jobType": "full-time", "liveStartAt": 1700000000, "description": "<p>credit models</p>", "remoteConfig": {"kind": "hybrid"}},
             "Listing:8": {"__typename": "JobListingSearchResult", "id": "8", "title": "ML Lead", "remote": True, "acceptedRemoteLocationNames": ["India"], "yearsExperienceMin": 9},
             "Listing:9": {"__typename": "JobListingSearchResult", "id": "9", "title": "Orphan"}, "other": 5}
    html = '<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"apolloState": {"data": cache}}}}) + "</script>"
    got = {r.title: r for r in boards.wellfound(page(spark, html).union(page(spark, "<html>none</html>", "q"))).collect()}
    assert set(got) == {"Data Scientist", "ML Lead"}
    one, two = got["Data Scientist"], got["ML Lead"]
    assert (one.company, one.location, one.url, one.remote, one.seniority, one.tags, one.salary_max, one.description, str(one.posted_at)[:10]) == (
        "Acme", "Gurgaon", "https://wellfound.com/jobs/7-data-scientist", "hybrid", "mid", ["Experience: 3-5 yrs", "Full time"], 2e6, "credit models", "2023-11-14")
    assert (two.location, two.url, two.remote, two.seniority, two.tags) == ("Remote (India)", "https://wellfound.com/jobs/8-ml-lead", "remote", "lead", ["Experience: 9+ yrs"])


def test_plain_card_boards(spark):
    html = '<div class="srpResultCard"><div class="jobTitle">QA Lead</div><a href="/job/1">x</a><div class="details location">Pune</div><span class="timeText">2 days ago</span><span class="salary">8-10 LPA</span></div>'
    one = boards.card_postings(page(spark, html), "foundit", as_of()).collect()
    assert [(r.title, r.company, r.location, r.url, r.salary_max, str(r.posted_at)[:10]) for r in one] == [("QA Lead", "Unknown", "Pune", "https://www.foundit.in/job/1", 1e6, "2024-06-08")]
    html = '<li class="clearfix job-bx wht"><h2><a href="http://t.io/1">Dev</a></h2><h3 class="joblist-comp-name">Acme</h3><ul class="top-jd-dtl"><li>5-6 LPA</li><li>Kochi</li></ul><span class="sim-posted"><span>Posted today</span></span></li>'
    one = boards.card_postings(page(spark, html), "timesjobs", as_of()).collect()
    assert [(r.title, r.company, r.location, r.salary_max, str(r.posted_at)[:10]) for r in one] == [("Dev", "Acme", "Kochi", 6e5, "2024-06-10")]
    for name in boards.CARD_BOARDS:
        assert boards.card_postings(page(spark, "<p>nothing</p>").union(page(spark, None)), name, as_of()).collect() == []
    html = '<script>x={"jobDetails":[{"jobId":"5","title":"Cook","companyName":"","location":"Goa","footerPlaceholderLabel":"Just now"}]}</script>'
    assert [(r.title, r.company, r.location, r.url) for r in boards.naukri_state(page(spark, html), as_of()).collect()] == [("Cook", "Unknown", "Goa", "https://x.io/p")]
    html = "<pre>" + json.dumps({"objects": [{"title": "Dev", "employer": {"company_name": "Acme"}, "locations": [{"name": "Pune"}, {"name": "Goa"}], "min_salary": 5, "max_salary": 9, "public_url": "/j/1"}, {"title": ""}]}) + "</pre>"
    assert [(r.title, r.company, r.location, r.url, r.salary_max) for r in boards.instahyre(page(spark, html)).collect()] == [("Dev", "Acme", "Pune, Goa", "https://www.instahyre.com/j/1", 9e5)]


def parsed(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", comments.parse_posting(F.col("t")).alias("p")).orderBy("i").collect()
    return [tuple(r.p) if r.p else None for r in rows]


def test_comments(spark):
    assert parsed(spark, "Acme | Remote | Data Engineer | Berlin | $100k\nmore", "Acme | Berlin | Full-time\n\n- Senior Backend Engineer\n- Designer", "Acme • https://a.io • NYC • Founding Engineer • €75k–110k",
                  "Acme (YC W20) | 100% remote | London | visa\nWe build engines for data people and need many more of them to come.\nProduct Manager", "Data Platform Lead - | Acme |") == [
        ("Acme", "Data Engineer", "Remote · Berlin"), ("Acme", "Senior Backend Engineer", "Berlin · Full-time"), ("Acme", "Founding Engineer", "NYC"),
        ("Acme (YC W20)", "Product Manager", "100% remote · London · visa"), ("Data Platform Lead", "Acme", "")]
    assert parsed(spark, "Backend Engineer at Acme in Berlin", "Data Analyst with Acme, apply now", "Lunch at Acme", "just chatting", "", None, "Reminder: | be | kind", "I'm looking for a job | data engineer", "Acme | Berlin | Full-time\nWe are nice.",
                  "Does anyone | know | engineer") == [("Acme", "Backend Engineer", "Berlin"), ("Acme", "Data Analyst", ""), None, None, None, None, None, None, None, None]


def test_threads(spark):
    said = "Acme | Data Engineer | Berlin | $100k-120k<p>" + "We do things. " * 10
    thread = json.dumps({"children": [{"id": 1, "author": "jo", "text": said, "created_at_i": 1700000000}, {"id": 2, "author": "whoishiring", "text": said}, {"id": 3, "text": "Acme | Engineer"}, {"id": 4, "text": None}]})
    got = comments.comment_postings(comments.comments(spark.createDataFrame([(thread,)], "payload string"))).collect()
    assert [(r.title, r.company, r.url, r.salary_max, r.tags, str(r.posted_at)[:10]) for r in got] == [("Data Engineer", "Acme", "https://news.ycombinator.com/item?id=1", 1.2e5, ["hacker-news"], "2023-11-14")]


def test_blocked_pages(spark):
    filler = "x" * 900
    rows = [("<html>" + filler, 200), ("<title>Just a moment...</title>" + filler, 200), (filler + "Please enable JavaScript and cookies", 200), (filler, 406), (filler, 403), ("", 200), ("<html>tiny", 200), (None, 200), (filler, None), (filler, 503)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, s int")
    assert [r.b for r in df.select("i", rank.looks_blocked(F.col("h"), F.col("s")).alias("b")).orderBy("i").collect()] == [False, True, True, True, True, True, True, True, False, False]


BODY = '<div class="description__text"><section><div class="show-more-less-html__markup"><p>We are hiring for our team.</p><ul><li>Build forecasting models in Python and deploy them well</li></ul><p>Compensation: 18-26 LPA.</p></div></section></div>'
CRITERIA = '<ul><li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Employment type</h3><span class="description__job-criteria-text">Full-time</span></li>' + (
    '<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Seniority</h3><span class="description__job-criteria-text">Mid</span></li></ul>')
FULL = BODY + CRITERIA + "<!-- " + "x" * 500 + " -->"


def test_hydration(spark):
    rows = [(f"{s}{i}", s, f"https://x.io/{s}{i}", "" if i else "d" * 90, i) for s in "ab" for i in range(8)] + [("c1", "c", "https://x.io/c1", "", 1), ("a9", "a", "https://x.io/a9", None, 9)]
    df = spark.createDataFrame(rows, "id string, source string, url string, description string, n int").withColumns({
        "title": F.lit("Dev"), "location": F.lit("Pune"), "remote": F.lit("unknown"), "tags": F.array(F.lit("t")), "salary_min": F.lit(None).cast("double"), "salary_max": F.lit(None).cast("double"),
        "salary_currency": F.lit(""), "posted_at": F.lit(None).cast("timestamp")})
    stored = spark.createDataFrame([("a2", "d" * 80), ("a3", "short")], "id string, description string")
    asked = hydrate.queue(df, stored, ["a", "b"], 5, ["n"])
    assert {(r.id, r.nth) for r in asked.collect()} == {("a1", 1), ("a3", 2), ("a4", 3), ("a5", 4), ("a6", 5), ("b1", 1), ("b2", 2), ("b3", 3), ("b4", 4), ("b5", 5)}
    empty = '<div class="description__text">  </div>' + "<!-- " + "x" * 500 + " -->"
    pages = spark.createDataFrame([("https://x.io/a1", 200, FULL), ("https://x.io/a3", 200, empty), ("https://x.io/a5", 200, FULL), ("https://x.io/b1", 200, FULL), ("https://x.io/b2", 429, FULL), ("https://x.io/b3", 200, FULL)],
                                  "url string, status int, html string")
    answered = hydrate.answers(asked, pages)
    found = hydrate.details(answered, hydrate.GUEST_BODY, hydrate.GUEST_CRITERIA, hydrate.GUEST_TAGS)
    assert {r.id for r in found.collect()} == {"a1", "a5", "b1"}  # a4 has no page, which stops nothing; b2 refused, which stops b
    assert {tuple(r) for r in hydrate.report(answered, found).collect()} == {("a", 5, 2, None), ("b", 5, 1, 2)}
    got = {r.id: r for r in hydrate.hydrated(df, found).collect()}
    assert len(got) == len(rows)
    assert "forecasting models" in got["a1"].description and got["a1"].tags == ["t", "Full-time"] and (got["a1"].salary_max, got["a1"].salary_currency) == (2.6e6, "INR")
    assert got["a3"].description == "" and got["b3"].description == "" and got["a9"].description is None
    posting = '<script type="application/ld+json">' + json.dumps({"@type": "JobPosting", "description": "<p>" + "work from home " * 9 + "</p>", "datePosted": "2024-05-06"}) + "</script>" + "x" * 500
    landed = hydrate.answers(asked, spark.createDataFrame([("https://x.io/a1", 200, posting)], pages.schema))
    one = {r.id: r for r in hydrate.hydrated(df, hydrate.posting_details(landed)).collect()}["a1"]
    assert (one.remote, str(one.posted_at)[:10], one.description[:14]) == ("remote", "2024-05-06", "work from home")


def test_cards_are_given_out_in_pieces(spark):
    """No array of all elements of a page, or batch of pages, stands between the parser and its rows."""
    made = spark.createDataFrame([("u", "<ul>" + "".join(f"<li><b>{k}</b></li>" for k in range(3)) + "</ul>"), ("v", "<li><b>a &amp b<br/></li>"), ("w", None)], "url string, html string")
    found = cards.elements(made, "html", cards.Record("li", {"t": cards.Field("b"), "all_": cards.Field("b", every=True)}, own=("x-y",)), ["url"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan
    assert sorted((r.url, r.nth, r.t, r.all_, r["own_x-y"]) for r in found.collect()) == [("u", 0, "0", ["0"], ""), ("u", 1, "1", ["1"], ""), ("u", 2, "2", ["2"], ""), ("v", 0, "a & b", ["a & b"], "")]


def test_plain_markup_reads_as_the_parser_does():
    record = cards.Record("li", {"t": cards.Field("b"), "h": cards.Field("div", "html"), "a": cards.Field("a", "href")})
    rules = {css: cards.compiled(css) for css in cards._css(record)}
    plain = '<ul><LI class=x><b>a &lt; b</b> <div>x<p>y &amp; z</div><a href="u?v" checked>w</a></li></ul>'
    reader = cards._Reader({"all": record}, rules, {})
    assert reader._plainly(plain) and not reader._plainly(plain + "<!-- c -->") and not reader._plainly("<script>if(a<b)</script>")
    assert cards._Reader({"all": record}, rules, {}).read(plain) == cards._Reader({"all": record}, rules, {}).read(plain + "<!-- c -->") == {"all": [{"t": "a < b", "h": "x\ny & z", "a": "u?v"}]}
