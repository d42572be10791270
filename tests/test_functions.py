"""Table-driven cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import contact, geo, html, quality, salary, text
from millrace.schema import conform, content_id
from millrace.sources import boards, comments, embedded


def values(spark, column, *inputs):
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
    names = ["i", "a", "b"][: len(rows[0])]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'i' else 'string'}" for n in names))
    return [r[0] for r in df.orderBy("i").select(column.alias("v"), "i").orderBy("i").select("v").collect()]


def test_normalisers(spark):
    assert values(spark, text.normalise_company(F.col("a")), "Acme Labs Pvt. Ltd.", "Zed (India) Technologies", "Co") == ["acme", "zed", ""]
    assert values(spark, text.normalise_title(F.col("a")), "Sr. Analyst (Urgent)", "Jr Tester - Remote") == ["senior analyst", "junior tester"]
    assert values(spark, text.search_normalise(F.col("a")), "Sr. ML Eng", "C++/PM") == ["senior machine learning engineer", "c++/product manager"]


@pytest.mark.parametrize(("label", "low", "high", "currency"), [
    ("12-18 LPA", 1.2e6, 1.8e6, "INR"), ("₹ 30,000 per month", 3.6e5, 3.6e5, "INR"), ("$170k", 1.7e5, 1.7e5, "USD"), ("1.5 crore", 1.5e7, 1.5e7, "INR"), ("£40 per hour", 83200, 83200, "GBP")])
def test_salary_parses(spark, label, low, high, currency):
    got = values(spark, salary.parse_salary(F.col("a")), label)[0]
    assert (got.salary_min, got.salary_max, got.salary_currency) == (low, high, currency)


def test_salary_refuses(spark):
    assert values(spark, salary.parse_salary(F.col("a")), "", "team of 170-200", "2021 LPA", "founded 2015", "900 crore") == [None] * 5
    assert values(spark, salary.salary_from_text(F.col("a")), "We need 2-5 years", "CTC: 2021 LPA Experience 2-5 years") == [None] * 2
    assert values(spark, salary.salary_from_text(F.col("a")), "Join us. CTC: 8-10 LPA Experience 3 years")[0].salary_max == 1e6


def test_patterns_are_written_out_once(spark):
    """Pay and ages are read step by step: however often what a pattern finds is used, it does not stand in the plan anew."""
    rows = spark.createDataFrame([("9-12 LPA", "3 days ago")], "a string, b string")
    plan = rows.select(boards.pay_of(F.col("a"))["salary_max"].alias("pay"), text.relative_time(F.col("b"), F.current_timestamp()).alias("at"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 30
    assert plan.count("(minute|min|hour|hr|day|week|month|year)") == 2


def test_modes_and_levels(spark):
    assert values(spark, text.detect_remote(F.col("a"), F.col("b")), ("Pune", "hybrid, remote"), ("Remote", ""), ("x", "on-site"), ("x", "y")) == ["hybrid", "remote", "onsite", "unknown"]
    assert values(spark, text.detect_seniority(F.col("a"), F.col("b")), ("Senior Engineering Manager", ""), ("Intern", "9 years"), ("Dev", "6+ years"), ("Dev", ""), ("Engineer II", "")) == [
        "lead", "intern", "senior", "unknown", "entry"]


def test_text_helpers(spark):
    assert values(spark, text.truncate(F.col("a"), 8), "short", "one two three", "unbroken-word") == ["short", "one two …", "unbroken …"]
    assert values(spark, text.slugify(F.col("a")), " A b/C! ") == ["a-b-c"]
    assert values(spark, F.array_join(text.extract_skills(text.search_normalise(F.col("a")), ["sql", "r", "power bi"]), ","), "SQL and R; email", "errors") == ["sql,r", ""]
    assert values(spark, F.array_join(text.display_tags(F.split("a", ",")), ","), "Exp: 1,also:x,exp: 2,b") == ["Exp: 1,b"]
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert [str(v)[:10] for v in values(spark, text.relative_time(F.col("a"), as_of), "3 days ago", "a month ago", "yesterday")] == ["2024-01-29", "2024-01-02", "2024-01-31"]
    assert [str(v)[:10] for v in values(spark, text.absolute_time(F.col("a")), "1700000000", "1700000000000", "2024-03-05T10:00:00Z")] == ["2023-11-14", "2023-11-14", "2024-03-05"]


def test_markup(spark):
    assert values(spark, html.html_to_text(F.col("a")), None, "a &amp;  b", "<p>x</p><script>no</script><ul><li>y</li></ul>") == ["", "a & b", "x\n• y"]
    assert values(spark, html.json_ld(F.col("a")), '<script type="application/ld+json">{"@type":"JobPosting","n":1}</script>', "none") == ['{"@type":"JobPosting","n":1}', None]


def test_references_without_a_semicolon(spark):
    pages = ("<title>a &amp;b &amp</title>", "x &amp y &ampz; &nosuch; &#65; &#65", "<p>&lt;b&gt; &copy=1 &amp;amp; &amp;lt;</p>&")
    assert values(spark, html.html_to_text(F.col("a")), *pages) == ["a &b &", "x & y &z; &nosuch; A A", "<b> ©=1 & <&"]
    assert values(spark, html.html_to_text(F.col("a"), closed=True), *pages) == ["a &b &amp", "x &amp y &ampz; &nosuch; A &#65", "<b> &copy=1 & <&"]


def test_contacts(spark):
    assert values(spark, F.array_join(contact.personal(contact.emails(F.col("a"))), ","), "Jo.Li@x.io, info@x.io") == ["jo.li@x.io"]
    assert values(spark, contact.domain_of(F.col("a"), ("boards.io",)), "https://www.x.io/a?b", "https://a.boards.io/x", "nothing") == ["x.io", "", ""]
    assert values(spark, contact.build_email(F.lit("Jo Li"), F.lit("x.io"), contact.address_pattern(F.col("a"))), "a_bc", "ab.cd", "ab", "john-doe", "") == ["jo_li@x.io", "jo.li@x.io", "jo@x.io", "jo@x.io", ""]
    shapes = ["first.last", "firstlast", "f.last", "flast", "first", "first_last", "last.first", "first.l", "odd"]
    assert values(spark, contact.build_email(F.lit("Priya K. Sharma"), F.lit("x.io"), F.col("a")), *shapes) == [
        "priya.sharma@x.io", "priyasharma@x.io", "p.sharma@x.io", "psharma@x.io", "priya@x.io", "priya_sharma@x.io", "sharma.priya@x.io", "priya.s@x.io", ""]
    assert values(spark, contact.build_email(F.col("a"), F.lit("x.io"), F.lit("first.last")), "Priya", "", None, "D'Arcy Lee") == ["", "", "", "darcy.lee@x.io"]
    assert values(spark, contact.domain_of(F.col("a")), "https://boards.greenhouse.io/acme/1", "https://in.linkedin.com/jobs", "https://in.indeed.co/x", "https://careers.acme.com/1", "http://www.acme.com:81/", None) == ["", "", "", "careers.acme.com", "acme.com:81", ""]
    assert values(spark, contact.contact_name(F.col("a")), "Please contact Priya Sharma for more", "Ask Jo Lee, our recruiter", "write to Hiring Manager", "nobody here", None) == ["Priya Sharma", "Jo Lee", "", "", ""]
    assert values(spark, contact.is_person(F.col("a")), "Hiring Manager", "Talent Team", "Priya", "Priya Sharma", " ", None) == [False, False, False, True, False, False]
    assert values(spark, contact.own_domain(F.col("a"), F.lit("https://x.lever.co/1"), F.lit("see https://jobs.naukri.com or http://www.acme.in/x")), "https://a.io/1", "https://adzuna.in/1", None) == ["a.io", "acme.in", "acme.in"]
    assert values(spark, F.array_join(contact.emails(F.col("a")), ","), "xA.b@c.io, _d@e.org. f@g") == ["xa.b@c.io,_d@e.org"]


PLACES = geo.Gazetteer({"delhi": ("new delhi",), "noida": ("greater noida",), "pune": ()}, {"ncr": ("delhi", "noida")}, {"maharashtra": ("maharastra",)}, {"pune": "maharashtra"}, ("india",), r"\bworldwide\b", r"\bus only\b")


def test_places(spark):
    at = lambda q: geo.locality(F.col("a"), q, PLACES, F.col("b") == "r", F.lit(""))
    assert values(spark, at("delhi"), ("New Delhi", ""), ("Greater Noida", ""), ("India", ""), ("Indiana", ""), ("Worldwide", "r"), ("Remote, US only", "r"), ("", "r"), ("Maharashtra", "")) == [
        "exact", "metro", "region", "", "remote", "", "", ""]
    assert values(spark, at("pune"), ("Maharashtra", "")) == ["region"]
    assert values(spark, at("india"), ("Pune", ""), ("Bloomington, IN", "")) == ["region", ""]
    near, far = (geo.best_locality(F.col("a"), ["delhi"], PLACES, F.lit(False), F.lit(""), nearby=n) for n in (True, False))
    assert values(spark, near, "Noida", "India") == ["metro", ""]
    assert values(spark, far, "Noida") == [""]
    assert geo.picker_order(PLACES, "ncr") == ["delhi", "noida", "pune"]
    g = geo.Gazetteer({c: () for c in "abcdef"}, {"x": ("d", "b", "zz"), "y": ("f",)})
    assert geo.picker_order(g, "x") == list("dbface") and geo.picker_order(g, "x", ("e", "d", "a")) == list("dbeacf")


def test_quality(spark):
    rules = [quality.Rule("a", "high", "bad"), quality.Rule("b", "low", "meh")]
    docs = spark.createDataFrame([(1, "bad meh meh"), (2, "fine"), (3, "- Led a\n- led b\n- Led c")], "id int, t string")
    assert {(r.id, r.rule, r.nth) for r in quality.rule_hits(docs, rules, "id", "t").collect()} == {(1, "a", 1), (1, "b", 1), (1, "b", 2)}
    cost = quality.penalty(quality.rule_counts(F.col("t"), rules), 3.5)
    assert [r[0] for r in docs.orderBy("id").select(quality.language_score(cost, 10)).collect()] == [6.5, 10.0, 10.0]
    assert [tuple(r) for r in quality.repeated_openers(docs, "id", "t").collect()] == [(3, "led", 3)]
    prose = spark.createDataFrame([(1, "Managed a\nManaged b\nManaged c"), (2, "– Don't a\n•  don't b\n* Don't c\n-no")], "id int, t string")
    assert [tuple(r) for r in quality.repeated_openers(prose, "id", "t").collect()] == [(2, "don't", 3)]
    assert [tuple(r)[:1] + tuple(r)[2:] for r in quality.bullet_lines(prose, "id", "t").orderBy("nth").collect()] == [(2, 0, 0, "Don't a"), (2, 1, 10, "don't b"), (2, 2, 21, "Don't c")]


def test_findings(spark):
    rules = [quality.Rule("hope", "high", r"(?i)i hope\s+this"), quality.Rule("stack", "medium", "synergy")]
    checks = [quality.Check("note_too_long", "note", 300), quality.Check("email_too_long", "email", 3), quality.Check("bullet_too_long", "cv", 20), quality.Check("repeated_opening_verb", "cv", 3)]
    text = "Summary\n- led the big synergy team\n  • Led b\n- led c\nled d\nI hope\n this"
    docs = spark.createDataFrame([(1, text), (2, "x" * 320), (3, "  \n "), (4, None), (5, "one two three four")], "id int, t string")
    found = quality.findings(docs, rules, checks, "cv", "id", "t")
    assert {tuple(r) for r in found.collect()} == {(1, "hope", "high", "I hope this", text.index("I hope")), (1, "stack", "medium", "synergy", text.index("synergy")),
                                                   (1, "bullet_too_long", "medium", "led the big synergy team", 8), (1, "repeated_opening_verb", "low", '"led" opens 3 bullets', 0)}
    assert {tuple(r) for r in quality.findings(docs, rules, checks, "note", "id", "t").where("id > 1").collect()} == {(2, "note_too_long", "high", "320 characters (limit 300)", 0)}
    assert {tuple(r) for r in quality.findings(docs, [], checks, "email", "id", "t").where("id > 1").collect()} == {(5, "email_too_long", "medium", "4 words (aim for under 3)", 0)}
    assert quality.findings(docs, [], [], "cv", "id", "t").collect() == []
    got = {r.id: r for r in quality.report(docs, found, "id", 5.0).collect()}
    assert (got[1].findings, got[1].clean, got[1].by_severity, got[1].penalty, got[1].points) == (4, False, {"high": 1, "low": 1, "medium": 2}, 5.0, 0.0)
    assert (got[4].findings, got[4].clean, got[4].points) == (0, True, 5.0)


def test_display(spark):
    assert values(spark, text.fix_case(F.col("a")), "Evoke Hr", "Delhi Ncr, India", "IBM ncr It", "Acme Pvt Ltd", "Aimless Sap2") == ["Evoke HR", "Delhi NCR, India", "IBM ncr IT", "Acme Pvt Ltd", "Aimless Sap2"]
    assert values(spark, text.title_case_slug(F.col("a"), ("sql", "hr")), "senior-SQL-analyst", "sql-hr-iBM", "IBM-x") == ["Senior SQL Analyst", "SQL HR Ibm", "IBM X"]
    assert values(spark, text.band_seniority(F.col("a")), "2 to 7 Yrs", "0-1", "5+", "9", "", None, "fresher") == ["mid", "entry", "senior", "lead", "unknown", "unknown", "unknown"]
    ages = ["-9", "0", "7199", "7200", "86399", "86400", "172800", "604800", "2591999", "2592000", None]
    assert values(spark, text.age_label(F.col("a").cast("double")), *ages) == ["just now", "just now", "just now", "2h ago", "23h ago", "yesterday", "2d ago", "1w ago", "4w ago", "1mo ago", ""]
    pay = spark.createDataFrame([(1.2e6, 1.8e6, "INR"), (9e4, 1.2e5, "USD"), (1.25e7, None, "INR"), (1e7, 1e7, "INR"), (500.0, 900.4, "GBP"), (1000.0, 1400.0, None), (None, 5.0, "USD"), (12.5e5, 12.54e5, "INR")], "a double, b double, c string")
    assert [r[0] for r in pay.select(text.salary_label(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["₹12L–18L PA", "$90k–120k/yr", "₹1.3Cr PA", "₹1Cr PA", "£500–900/yr", "1k/yr", None, "₹12.5L PA"]


def test_places_at_the_end(spark):
    from millrace.operators import suffix

    cut = suffix.trailing_places(F.col("a"), ["noida", "greater-noida", "delhi-ncr", "new-delhi"])
    got = values(spark, cut, "a-b-greater-noida-delhi-ncr", "new-delhi", "a-renoida", "", None)
    assert [(r.rest, r.places) for r in got[:4]] == [("a-b", ["greater-noida", "delhi-ncr"]), ("", ["new-delhi"]), ("a-renoida", []), ("", [])]
    assert got[4].rest is None
    assert values(spark, quality.band(F.col("a").cast("double"), [(0, "low"), (5, "mid")]), "4.9", "5", "-1") == ["low", "mid", "low"]


def test_conform_fills_and_names(spark):
    row = conform(spark.createDataFrame([(None, " A   b ", "odd")], "id string, title string, remote string"), F.lit("2024-01-01").cast("timestamp")).first()
    assert (row.title, row.remote, row.company, row.tags, row.enriched) == ("A b", "unknown", "", [], False)
    assert row.id == values(spark, content_id(F.lit(""), F.col("a"), F.lit("")), "A b")[0]


def test_comments_and_arrays_are_read_once(spark):
    rows = spark.createDataFrame([(1, "a", "Acme | Data Lead | Pune<p>We build things for people who like things built well.", 5)], "id int, author string, text string, created_at_i long")
    got = comments.comment_postings(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("please\\s+normalize") == 1
    assert [(r.title, r.company, r.location) for r in got.collect()] == [("Data Lead", "Acme", "Pune")]
    pages = spark.createDataFrame([('x "jobs":[{"a":"]"},[1]] y',), ("none",), (None,)], "a string")
    found = pages.select(embedded.array_text(F.concat(F.col("a"), F.lit("")), "jobs").alias("v"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r.v for r in found.collect()] == ['[{"a":"]"},[1]]', None, None]
