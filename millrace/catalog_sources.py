"""Queries over the feeds and boards, the lookups and the text functions, with material that Spark makes from the driver's tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import AS_OF, PLACES, _corpus_sides, _now, table
from millrace.functions import geo, html, salary, text
from millrace.operators import corpus, enrich, facets, rank
from millrace.sources import boards, payloads

STAMP = "'2024-03-05T10:00:00Z'"
# What each feed's payload is made of: SQL of a JSON text over a supplier's columns, k being its key.
_NAME = "concat('Dev ', s_name)"
_PAYLOADS = {
    "ats:greenhouse": "concat('{\"jobs\":[', to_json(named_struct('title', N, 'location', named_struct('name', place), 'absolute_url', url, 'content', '<p>Pay &amp; more: 8-10 LPA</p>', 'updated_at', stamp)), ']}')",
    "ats:lever": "concat('[', to_json(named_struct('text', N, 'categories', named_struct('location', place, 'commitment', 'Remote'), 'hostedUrl', url, 'descriptionPlain', 'one', 'createdAt', 1700000000000 + k)), ']')",
    "ats:ashby": "concat('{\"jobs\":[', to_json(named_struct('title', N, 'location', place, 'jobUrl', url, 'isRemote', k % 2 = 0, 'publishedAt', stamp, 'compensation', named_struct('compensationTierSummary', '$100k - $120k'))), ']}')",
    "ats:workable": "concat('{\"jobs\":[', to_json(named_struct('title', N, 'location', named_struct('city', place, 'region', '', 'country', 'India', 'telecommuting', true), 'url', url, 'published_on', '2024-03-05')), ']}')",
    "ats:smartrecruiters": "concat('{\"content\":[', to_json(named_struct('id', cast(k as string), 'name', N, 'location', named_struct('city', place, 'country', 'in', 'remote', k % 2 = 0), 'releasedDate', stamp)), ']}')",
    "ats:recruitee": "concat('{\"offers\":[', to_json(named_struct('title', N, 'city', place, 'country_code', 'IN', 'careers_url', url, 'description', 'CTC: 8-10 LPA', 'published_at', stamp)), ']}')",
    "adzuna": "concat('{\"results\":[', to_json(named_struct('title', N, 'company', named_struct('display_name', s_name), 'location', named_struct('display_name', place), 'redirect_url', url, 'created', stamp, 'salary_min', k * 1000, 'salary_max', k * 2000)), ']}')",
    "remoteok": "concat('[{\"legal\":\"x\"},', to_json(named_struct('position', N, 'company', s_name, 'location', '', 'url', url, 'epoch', 1700000000 + k, 'salary_min', k * 1000)), ']')",
    "remotive": "concat('{\"jobs\":[', to_json(named_struct('title', N, 'company_name', s_name, 'candidate_required_location', place, 'url', url, 'publication_date', '2024-03-05T10:00:00', 'salary', '$90k')), ']}')",
    "arbeitnow": "concat('{\"data\":[', to_json(named_struct('title', N, 'company_name', s_name, 'location', place, 'url', url, 'created_at', 1700000000 + k, 'remote', k % 2 = 0, 'tags', array('x'))), ']}')",
    "himalayas": "concat('{\"jobs\":[', to_json(named_struct('title', N, 'companyName', s_name, 'locationRestrictions', array(place, 'Goa'), 'guid', url, 'pubDate', 1700000000 + k, 'minSalary', k * 1000)), ']}')",
    "weworkremotely": "concat('{\"item\":[', to_json(named_struct('title', concat(s_name, ': ', N), 'link', url, 'region', '', 'pubDate', 'Tue, 05 Mar 2024 10:00:00 +0000')), ']}')",
}


def feed_postings(spark, sf_dir):
    """A payload of one posting for every supplier and feed; every ninth payload is no JSON."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "s_name", "element_at(array('Pune', 'Berlin', 'Kochi'), cast(s_suppkey % 3 + 1 as int)) as place", "concat('https://x.io/', s_suppkey) as url", f"{STAMP} as stamp")
    landed = [s.select(F.lit(f).alias("source"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("token"), F.col("s_name").alias("company"),
                       F.expr(f"case when k % 9 = 0 then '<html>' else {p.replace('N,', _NAME + ',').replace('N)', _NAME + ')')} end").alias("payload")) for f, p in _PAYLOADS.items()]
    found = [payloads.postings_of(rows, f) for rows, f in zip(landed, _PAYLOADS)]
    out = reduce(DataFrame.unionByName, found)
    return out.select("source", "title", "company", "location", "url", "remote", "salary_min", "salary_max", "salary_currency", F.unix_timestamp("posted_at").alias("posted"), F.array_join("tags", ",").alias("tags"))


def _feeds_sql() -> str:
    none, at = "NULL::DOUBLE", "1709632800"
    rows = {  # company, location, url, remote, salary_min, salary_max, currency, posted, tags
        "ats:greenhouse": ("s_name", "place", "url", "'unknown'", "800000.0", "1000000.0", "'INR'", at, "''"), "ats:lever": ("s_name", "place", "url", "'remote'", none, none, "NULL", "(1700000000000 + k) // 1000", "''"),
        "ats:ashby": ("s_name", "place", "url", "CASE WHEN k % 2 = 0 THEN 'remote' ELSE 'unknown' END", "100000.0", "120000.0", "'USD'", at, "''"),
        "ats:workable": ("s_name", "place || ', India'", "url", "'remote'", none, none, "NULL", "1709596800", "''"),
        "ats:smartrecruiters": ("s_name", "place || ', in'", "'https://jobs.smartrecruiters.com/t' || k || '/' || k", "CASE WHEN k % 2 = 0 THEN 'remote' ELSE 'unknown' END", none, none, "NULL", at, "''"),
        "ats:recruitee": ("s_name", "place || ', IN'", "url", "'unknown'", "800000.0", "1000000.0", "'INR'", at, "''"), "adzuna": ("s_name", "place", "url", "'unknown'", "k * 1000.0", "k * 2000.0", "'INR'", at, "''"),
        "remoteok": ("s_name", "'Remote'", "url", "'remote'", "k * 1000.0", "k * 1000.0", "'USD'", "1700000000 + k", "''"), "remotive": ("s_name", "place", "url", "'remote'", "90000.0", "90000.0", "'USD'", at, "''"),
        "arbeitnow": ("s_name", "place", "url", "CASE WHEN k % 2 = 0 THEN 'remote' ELSE 'unknown' END", none, none, "NULL", "1700000000 + k", "'x'"),
        "himalayas": ("s_name", "place || ', Goa'", "url", "'remote'", "k * 1000.0", "k * 1000.0", "'USD'", "1700000000 + k", "''"), "weworkremotely": ("s_name", "'Remote'", "url", "'remote'", none, none, "NULL", at, "''")}
    parts = [f"SELECT '{f}' AS source, 'Dev ' || s_name AS title, {c} AS company, {l} AS location, {u} AS url, {r} AS remote, ({lo})::DOUBLE AS salary_min, ({hi})::DOUBLE AS salary_max, {cur} AS salary_currency, ({p})::BIGINT AS posted, {t} AS tags FROM s"
             for f, (c, l, u, r, lo, hi, cur, p, t) in rows.items()]
    return "WITH s AS (SELECT s_suppkey AS k, s_name, ['Pune', 'Berlin', 'Kochi'][s_suppkey % 3 + 1] AS place, 'https://x.io/' || s_suppkey AS url FROM supplier WHERE s_suppkey % 9 <> 0) " + " UNION ALL ".join(parts)


def object_caches(spark, sf_dir):
    """A page of a cache for every customer: its orders as listings that a startup names, and one that none names."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    node = F.to_json(F.struct(F.lit("JobListingSearchResult").alias("__typename"), k.cast("string").alias("id"), F.concat(F.lit("Dev "), "o_orderpriority").alias("title"), F.when(k % 2 == 0, F.array(F.lit("Pune"))).otherwise(F.array().cast("array<string>")).alias("locationNames"),
                              (k % 3 == 0).alias("remote"), F.array(F.lit("India")).alias("acceptedRemoteLocationNames"), (k % 11).alias("yearsExperienceMin"), F.when(k % 4 == 0, k % 11 + 2).alias("yearsExperienceMax"),
                              F.concat(F.lit("$"), (k % 90 + 10).cast("string"), F.lit("k • 0.1%")).alias("compensation"), F.lit("full-time").alias("jobType"), (1_700_000_000 + k).alias("liveStartAt")))
    entry = F.concat(F.lit('"L:'), k.cast("string"), F.lit('":'), node)
    ref = F.when(k % 7 != 0, F.concat(F.lit('{"__ref":"L:'), k.cast("string"), F.lit('"}')))
    pages = o.groupBy("o_custkey").agg(F.array_join(F.collect_list(entry), ",").alias("nodes"), F.array_join(F.collect_list(ref), ",").alias("refs"))
    state = F.concat(F.lit('{"S:1":{"__typename":"StartupResult","name":"C'), F.col("o_custkey").cast("string"), F.lit('","highlightedJobListings":['), "refs", F.lit("]},"), "nodes", F.lit("}"))
    page = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"apolloState":{"data":'), state, F.lit("}}}}</script>"))
    out = boards.wellfound(pages.select(F.col("o_custkey").cast("string").alias("url"), page.alias("html")))
    return out.select("title", "company", "location", "url", "remote", "seniority", "salary_max", F.unix_timestamp("posted_at").alias("posted"), F.array_join("tags", "|").alias("tags"))


CACHE_SQL = """
SELECT 'Dev ' || o_orderpriority AS title, 'C' || o_custkey AS company, CASE WHEN k % 2 = 0 THEN 'Pune' WHEN k % 3 = 0 THEN 'Remote (India)' ELSE '' END AS location,
  'https://wellfound.com/jobs/' || k || '-' || trim(regexp_replace(lower('Dev ' || o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS url, CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN 'remote' ELSE 'unknown' END AS remote,
  CASE WHEN k % 11 < 2 THEN 'entry' WHEN k % 11 < 5 THEN 'mid' WHEN k % 11 < 8 THEN 'senior' ELSE 'lead' END AS seniority, (k % 90 + 10) * 1000.0::DOUBLE AS salary_max, 1700000000 + k AS posted,
  'Experience: ' || (k % 11) || CASE WHEN k % 4 = 0 THEN '-' || (k % 11 + 2) || ' yrs' ELSE '+ yrs' END || '|Full time' AS tags FROM (SELECT *, o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0)
"""


def board_cards(spark, sf_dir):
    """A card of internshala for every part, with places, pay and experience beside icons, some of internships."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    s = lambda c: F.col(c) if isinstance(c, str) else c.cast("string")
    card = F.concat(F.lit('<div class="x individual_internship" employment_type="'), F.when(k % 5 == 0, "internship").otherwise("job"), F.lit('"><a class="job-title-href" href="/job/'), s(k), F.lit('">'), s("p_name"), F.lit('</a><p class="company-name"> '), s("p_brand"),
                    F.lit('</p><div class="locations"><a>'), F.when(k % 3 == 0, "Work from home").otherwise("Pune"), F.lit('</a><a>Delhi</a></div><div class="row-1-item"><i class="ic-money"></i><span>x</span><span class="mobile">₹ '), s(F.col("p_size") + 3),
                    F.lit(',00,000 /year</span></div><div class="row-1-item"><i class="ic-briefcase"></i><span>'), s(F.col("p_size") % 10), F.lit(' year(s)</span></div><div class="about_job"><div class="text">Learn &amp; build</div></div><div class="color-labels"><span>Early</span><span>'),
                    s(F.col("p_size") % 9 + 1), F.lit(' days ago</span></div><span class="job_skill">'), F.lower("p_type"), F.lit("</span></div>"))
    pages = p.groupBy(F.floor(k / 40).alias("n")).agg(F.array_join(F.collect_list(card), "\n").alias("html")).select(F.col("n").cast("string").alias("url"), "html")
    out = boards.internshala(pages, F.lit(AS_OF).cast("timestamp"))
    return out.select("url", "title", "company", "location", "remote", "seniority", "salary_min", "description", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), F.array_join("skills", ",").alias("skills"), F.array_join("tags", ",").alias("tags"))


CARDS_SQL = f"""
SELECT 'https://internshala.com/job/' || p_partkey AS url, p_name AS title, p_brand AS company, CASE WHEN p_partkey % 3 = 0 THEN 'Work from home' ELSE 'Pune' END || ', Delhi, India' AS location, CASE WHEN p_partkey % 3 = 0 THEN 'remote' ELSE 'unknown' END AS remote,
  CASE WHEN p_size % 10 < 2 THEN 'entry' WHEN p_size % 10 < 5 THEN 'mid' WHEN p_size % 10 < 8 THEN 'senior' ELSE 'lead' END AS seniority, (p_size + 3) * 100000.0::DOUBLE AS salary_min, 'Learn & build' AS description,
  strftime(TIMESTAMP '{AS_OF}' - to_days((p_size % 9 + 1)::INT), '%Y-%m-%d') AS posted, lower(p_type) AS skills, 'Experience: ' || (p_size % 10) || ' year(s)' AS tags FROM part WHERE p_partkey % 5 <> 0
"""


def board_health(spark, sf_dir):
    """Payloads of the customers' boards: a board without one is blocked, a segment with none left is dead."""
    c = table(spark, sf_dir, "customer")
    landed = c.select(F.col("c_mktsegment").alias("source"), F.when((F.col("c_custkey") % 3 != 0) & (F.col("c_mktsegment") != "BUILDING"), "{}").alias("payload"))
    found = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).where("c_mktsegment <> 'BUILDING' and o_orderkey % 2 = 0").select(F.col("c_mktsegment").alias("source"))
    return payloads.fan_out_health(landed, found)


HEALTH_SQL = """
SELECT c_mktsegment AS source, count(*) AS boards, count(*) FILTER (WHERE c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING') AS blocked,
  coalesce(any_value(n), 0) AS jobs_found, NOT (count(*) FILTER (WHERE c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING') = count(*) AND coalesce(any_value(n), 0) = 0) AS ok
FROM customer LEFT JOIN (SELECT c_mktsegment AS seg, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0 AND c_mktsegment <> 'BUILDING' GROUP BY 1) ON seg = c_mktsegment GROUP BY c_mktsegment
"""


def request_plan(spark, sf_dir):
    """Suppliers as sources, a third of them whole feeds; the documents' languages and sources as keywords."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"), (F.col("s_suppkey") % 3 == 0).alias("query_independent"), (F.col("s_suppkey") % 2 + 1).cast("int").alias("pages"))
    q = table(spark, sf_dir, "documents").select(F.array("lang", "source").alias("keywords")).distinct()
    return payloads.request_plan(s, q)


PLAN_SQL = """
WITH k AS (SELECT lang AS keyword FROM documents UNION SELECT source FROM documents)
SELECT s_name AS source, NULL AS keyword, 1 AS page FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_name, keyword, page FROM supplier, k, (VALUES (1), (2)) p(page) WHERE s_suppkey % 3 <> 0 AND keyword IS NOT NULL AND page <= s_suppkey % 2 + 1
"""


def text_parts(spark, sf_dir):
    """Words, slugs, joined places and shown tags of the documents' heads and orders."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    places = F.slice(F.array(*[F.concat(F.lit(n), (k % 7).cast("string")) for n in ("Pune", "Goa", "Kochi", "Delhi", "Agra", "Surat")]), 1, (k % 6 + 1).cast("int"))
    tags = F.array(F.concat(F.lit("Exp: "), (k % 5).cast("string")), F.lit("also:x"), F.concat(F.lit("EXP: "), (k % 3).cast("string")), F.concat(F.lit("t"), (k % 2).cast("string")), F.concat(F.lit("Size:"), (k % 4).cast("string")))
    return o.select("o_orderkey", F.array_join(text.tokens(F.concat_ws(" C++/", "o_orderpriority", "o_orderstatus")), ",").alias("tokens"), text.slugify(F.concat_ws(" & ", "o_orderpriority", F.lit("R+D!"))).alias("slug"),
                    text.join_locations(places).alias("places"), F.array_join(text.display_tags(tags), "|").alias("tags"), corpus_shard(k).alias("shard"))


def corpus_shard(key):
    return F.substring(F.sha2(key.cast("string"), 256), 1, 2)


TEXT_SQL = """
SELECT k AS o_orderkey, array_to_string(regexp_extract_all(lower(o_orderpriority || ' C++/' || o_orderstatus), '[a-z0-9+#.]+'), ',') AS tokens, trim(regexp_replace(lower(o_orderpriority || ' & R+D!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  array_to_string(list_transform(['Pune', 'Goa', 'Kochi', 'Delhi', 'Agra', 'Surat'][1:least(4, k % 6 + 1)], lambda p: p || (k % 7)), ', ') || CASE WHEN k % 6 + 1 > 4 THEN ' +' || (k % 6 - 3) || ' more' ELSE '' END AS places,
  'Exp: ' || (k % 5) || '|t' || (k % 2) || '|Size:' || (k % 4) AS tags, sha256(k::VARCHAR)[1:2] AS shard FROM (SELECT *, o_orderkey AS k FROM orders)
"""


def written_times(spark, sf_dir):
    """How boards write when: relative labels, epochs in seconds and milliseconds, and written dates."""
    o = table(spark, sf_dir, "orders")
    k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 40 + 1).cast("string")
    unit = F.element_at(F.array(*map(F.lit, ("minute", "hour", "day", "week", "month", "year"))), (k % 6 + 1).cast("int"))
    label = F.when(k % 9 == 0, "Just now").when(k % 9 == 1, "Yesterday").when(k % 9 == 2, F.concat(F.lit("an "), unit, F.lit(" ago"))).when(k % 9 == 3, "soon").otherwise(F.concat(F.lit("Posted "), n, F.lit("+ "), unit, F.lit("s ago")))
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    fixed = F.when(k % 4 == 0, (seconds + 86400 * 3650).cast("string")).when(k % 4 == 1, ((seconds + 86400 * 3650) * 1000).cast("string")).when(k % 4 == 2, F.date_format("o_orderdate", "d MMM yyyy")).otherwise(F.date_format("o_orderdate", "MMM d, yyyy"))
    return o.select("o_orderkey", F.unix_timestamp(text.relative_time(label, _now().cast("timestamp"))).alias("ago"), F.unix_timestamp(text.absolute_time(fixed)).alias("at"))


TIMES_SQL = f"""
SELECT o_orderkey, CASE k % 9 WHEN 3 THEN NULL ELSE epoch(TIMESTAMP '{AS_OF}')::BIGINT - CASE k % 9 WHEN 0 THEN 0 WHEN 1 THEN 86400 ELSE CASE k % 9 WHEN 2 THEN 1 ELSE k % 40 + 1 END * [60, 3600, 86400, 604800, 2592000, 31536000][k % 6 + 1] END END AS ago,
  epoch(date_trunc('day', o_orderdate))::BIGINT + CASE WHEN k % 4 < 2 THEN 86400 * 3650 + (epoch(o_orderdate) - epoch(date_trunc('day', o_orderdate)))::BIGINT ELSE 0 END AS at FROM (SELECT *, o_orderkey AS k FROM orders)
"""


def salary_in_text(spark, sf_dir):
    """Documents with a sentence about pay put into their middle, or about years, or none."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    low = (k % 20 + 3).cast("string")
    said = F.when(k % 5 == 0, F.concat(F.lit(". CTC: "), low, F.lit("-"), (k % 20 + 8).cast("string"), F.lit(" LPA Experience 2-5 years. "))).when(k % 5 == 1, F.concat(F.lit(". ₹ "), low, F.lit(" lakhs to "), (k % 20 + 8).cast("string"), F.lit(" lakhs. "))).when(
        k % 5 == 2, F.concat(F.lit(". We need "), low, F.lit("-"), (k % 20 + 8).cast("string"), F.lit(" years. "))).when(k % 5 == 3, ". CTC: 2021 LPA. ").otherwise("")
    pay = salary.salary_from_text(F.concat(F.lit("We hire"), said, F.regexp_replace(F.coalesce("text", F.lit("")), r"[0-9$₹£€]|(?i)salary|package|compensation|remuneration|ctc", "")))
    return d.select("doc_id", pay.alias("pay")).select("doc_id", "pay.salary_min", "pay.salary_max", "pay.salary_currency")


SALARY_SQL = """
SELECT doc_id, CASE WHEN k % 5 < 2 THEN (k % 20 + 3) * 100000.0::DOUBLE END AS salary_min, CASE WHEN k % 5 < 2 THEN (k % 20 + 8) * 100000.0::DOUBLE END AS salary_max, CASE WHEN k % 5 < 2 THEN 'INR' END AS salary_currency
FROM (SELECT *, doc_id AS k FROM documents)
"""


def embedded_posting(spark, sf_dir):
    """Pages with blocks of JSON-LD of which one in three is a posting, the second block of its page."""
    p = table(spark, sf_dir, "pages")
    block = lambda kind: F.concat(F.lit('<script data-x type="application/ld+json">'), F.to_json(F.struct(F.lit(kind).alias("@type"), F.col("url").alias("name"))), F.lit("</script>"))
    page = F.concat("html", block("Organization"), F.when(F.col("page_id") % 3 == 0, block("JobPosting")).otherwise(""), F.lit('<script type="application/ld+json">{broken</script>'))
    return p.select("page_id", F.get_json_object(html.json_ld(page), "$.name").alias("name"))


def places_of_parts(spark, sf_dir):
    """City, metro and neighbours of made locations: three of twelve words each."""
    words = ["New Delhi", "Noida", "Pune", "greater noida", "Kochi", "India", "Maharashtra", "remote", "renew delhi", "Punetown", "", "or"]
    word = lambda n: F.element_at(F.array(*map(F.lit, words)), (F.floor(F.col("p_partkey") / n) % len(words) + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(", ", word(1), word(12), word(5)).alias("location"))
    city = geo.canonical_city(F.col("location"), PLACES)
    return p.select("p_partkey", city.alias("city"), geo.metro_area(city, PLACES).alias("metro"), geo.same_metro(city, F.lit("noida"), PLACES).alias("near"), F.array_join(F.array_sort(geo.cities_in(F.col("location"), PLACES)), ",").alias("cities"))


PLACES_SQL = r"""
WITH w AS (SELECT ['New Delhi', 'Noida', 'Pune', 'greater noida', 'Kochi', 'India', 'Maharashtra', 'remote', 'renew delhi', 'Punetown', '', 'or'] AS w),
l AS (SELECT p_partkey, lower(concat_ws(', ', w[p_partkey % 12 + 1], w[p_partkey // 12 % 12 + 1], w[p_partkey // 5 % 12 + 1])) AS t FROM part, w),
n AS (SELECT p_partkey, contains(t, 'new delhi') AS nd, regexp_matches(t, '\bdelhi\b') AS d, contains(t, 'greater noida') AS gn, regexp_matches(t, '\bnoida\b') AS n, regexp_matches(t, '\bpune\b') AS p FROM l),
c AS (SELECT *, CASE WHEN gn THEN 'noida' WHEN nd THEN 'delhi' WHEN d THEN 'delhi' WHEN n THEN 'noida' WHEN p THEN 'pune' END AS city FROM n)
SELECT p_partkey, city, CASE WHEN city IN ('delhi', 'noida') THEN 'ncr' END AS metro, coalesce(city IN ('delhi', 'noida'), FALSE) AS near,
  concat_ws(',', CASE WHEN nd OR d THEN 'delhi' END, CASE WHEN gn OR n THEN 'noida' END, CASE WHEN p THEN 'pune' END) AS cities FROM c
"""


def found_rows(spark, sf_dir):
    """Parts whose name or brand holds a text, newest first, the second page of fifteen."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.expr("timestampadd(DAY, p_size, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("posted_at"))
    found = rank.find(rows, "RING", 1_000)
    return rank.page(found.orderBy(F.desc("posted_at"), "id"), 1, 15).select("id", "title", "posted_at")


FOUND_SQL = """SELECT p_partkey AS id, p_name AS title, TIMESTAMP '2024-01-01' + to_days(p_size::INT) AS posted_at FROM (
  SELECT * FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') ORDER BY p_size DESC, p_partkey LIMIT 1000) ORDER BY p_size DESC, p_partkey LIMIT 15 OFFSET 15"""


def looked_up(spark, sf_dir):
    """The customer that a prefix names, joined to the orders it has."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"), "c_custkey")
    return rank.lookup(c, "id", "Customer#000000077").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("id", "o_orderkey")


def thin_rows(spark, sf_dir):
    """Rows to ask again: of some sources, with a short description, not stored."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.repeat(F.lit("d"), (F.col("o_custkey") % 200).cast("int")).alias("description"), F.col("o_orderstatus").alias("source"))
    stored = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    return corpus.needs_details(o, stored, ["F", "O"]).select("id", "source")


def enriched_rows(spark, sf_dir):
    """Parts with what their texts tell and what made answers say: whole, in a fence, of unknown levels, or no JSON."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.when(k % 4 == 0, "Senior"), "p_name").alias("title"), F.lit("").alias("description"), F.array().cast("array<string>").alias("skills"), F.lit("unknown").alias("seniority"),
                                               F.lit("").alias("summary"), F.array(F.lit("also:x"), F.lit("old")).alias("tags"), F.lit("").alias("location"), F.lit(False).alias("enriched"))
    said = F.format_string('{"skills":["s%d","t"],"seniority":"%s","summary":"%s","tags":["a","b","c","d","e"],"location":"Pune"}', k % 5, F.when(k % 2 == 0, "lead").otherwise("boss"), F.repeat(F.lit("y"), F.lit(300)))
    answers = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(k.alias("id"), F.when(k % 7 == 0, "no").when(k % 5 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(said).alias("answer"))
    out = enrich.apply(enrich.heuristic(rows, ["ring", "red ring", "bolt"]), answers)
    return out.select("id", F.array_join("skills", ",").alias("skills"), "seniority", F.length("summary").alias("chars"), F.array_join("tags", ",").alias("tags"), "location", "enriched")


ENRICHED_SQL = """
WITH p AS (SELECT p_partkey AS k, p_name, p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 AS said FROM part)
SELECT k AS id, CASE WHEN said THEN 's' || (k % 5) || ',t' ELSE array_to_string(list_filter([CASE WHEN p_name = 'red ring' THEN 'red ring' END, CASE WHEN split_part(p_name, ' ', 2) = 'ring' THEN 'ring' END, CASE WHEN split_part(p_name, ' ', 2) = 'bolt' THEN 'bolt' END], lambda x: x IS NOT NULL), ',') END AS skills,
  CASE WHEN said THEN CASE WHEN k % 2 = 0 THEN 'lead' ELSE 'unknown' END WHEN k % 4 = 0 THEN 'senior' ELSE 'unknown' END AS seniority, (CASE WHEN said THEN 220 ELSE 0 END)::INT AS chars, CASE WHEN said THEN 'a,b,c,d,also:x' ELSE 'also:x,old' END AS tags,
  CASE WHEN said THEN 'Pune' ELSE '' END AS location, said AS enriched FROM p
"""


def stages(spark, sf_dir):
    """Rows of three stages of a run over the corpus's two sides."""
    old, new = _corpus_sides(spark, sf_dir)
    return facets.stage_counts({"stored": old, "incoming": new, "after": corpus.upsert(old, new, _now())})



def _mixed(spark, sf_dir, words: list[str], sizes=(1, 12, 5), sep: str = ", ") -> DataFrame:
    """Parts with a label of three of these words each, by their keys."""
    word = lambda n: F.element_at(F.array(*map(F.lit, words)), (F.floor(F.col("p_partkey") / n) % len(words) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat_ws(sep, *map(word, sizes)).alias("label"))


def _mixed_sql(words: list[str], sizes=(1, 12, 5), sep: str = ", ") -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return "m AS (SELECT p_partkey, p_size, concat_ws('" + sep + "', " + ", ".join(f"([{listed}])[p_partkey // {n} % {len(words)} + 1]" for n in sizes) + ") AS label FROM part)"


MODE_WORDS = ["Hybrid role", "work from home", "on-site", "remote-first", "fully remote", "Remotely", "office", "WFO", "onsite only", "hybridized", "In office", "Pune", "100% Remote"]
LEVEL_WORDS = ["Senior", "Sr. Dev", "Intern", "Head of Data", "Manager", "Engineer II", "SDE 3", "Fresher", "Analyst", "Internal Auditor", "iv", "Chief", "Associate", "Staff", "Tester", "Clerk", "Cook"]
PLACE_WORDS = ["New Delhi", "Noida", "Pune", "greater noida", "Kochi", "India", "Maharashtra", "remote", "Worldwide", "US only", "", "Haryana", "Maharastra"]


def modes_of_labels(spark, sf_dir):
    return _mixed(spark, sf_dir, MODE_WORDS).select("p_partkey", text.detect_remote(F.col("label")).alias("mode"))


def levels_of_titles(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ("needs 3+ years", "5 to 7 yrs", "1 year", "10 years", "", "years of it", "8-12 Yrs"))), (F.col("p_size") % 7 + 1).cast("int"))
    return _mixed(spark, sf_dir, LEVEL_WORDS, (1, 17), " ").select("p_partkey", text.detect_seniority(F.col("label"), said).alias("level"))


def pay_of_labels(spark, sf_dir):
    """Labels of a currency, one or two figures and a unit, in all combinations."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pick = lambda n, xs: F.element_at(F.array(*map(F.lit, xs)), (F.floor(k / n) % len(xs) + 1).cast("int"))
    low = (k % 37 + 3).cast("string")
    label = F.concat(F.lit("Pay: "), pick(1, SIGN_WORDS), low, F.when(k % 2 == 0, F.concat(F.lit(" - "), (k % 37 + 8).cast("string"))).otherwise(""), pick(7, UNIT_WORDS))
    pay = p.select("p_partkey", salary.parse_salary(label).alias("pay"))
    return pay.select("p_partkey", "pay.salary_min", "pay.salary_max", "pay.salary_currency", "pay.salary_period", "pay.salary_text")


SIGN_WORDS, UNIT_WORDS = ["₹ ", "$", "Rs. ", "£", ""], [" LPA", " lakhs", "k per year", ",000 per month", "/hour", " crore", "", " Cr", "k"]
PAY_SQL = r"""
WITH l AS (SELECT p_partkey, p_partkey AS k, ['₹ ', '$', 'Rs. ', '£', ''][p_partkey % 5 + 1] AS sign, [' LPA', ' lakhs', 'k per year', ',000 per month', '/hour', ' crore', '', ' Cr', 'k'][p_partkey // 7 % 9 + 1] AS unit FROM part),
f AS (SELECT *, (k % 37 + 3)::DOUBLE AS a, CASE WHEN k % 2 = 0 THEN (k % 37 + 8)::DOUBLE END AS b, CASE WHEN unit IN (' LPA', ' lakhs') THEN 100000.0 WHEN unit IN (' crore', ' Cr') THEN 10000000.0 WHEN unit IN ('k', 'k per year') THEN 1000.0 ELSE 1.0 END AS scale,
  CASE WHEN unit IN (' LPA', 'k per year') THEN 1 WHEN unit = ',000 per month' THEN 12 WHEN unit = '/hour' THEN 2080 ELSE 0 END AS period FROM l),
g AS (SELECT *, CASE WHEN unit = ',000 per month' THEN 1000.0 ELSE 1.0 END AS many, CASE WHEN sign IN ('₹ ', 'Rs. ') THEN 'INR' WHEN sign = '$' THEN 'USD' WHEN sign = '£' THEN 'GBP' WHEN scale IN (100000.0, 10000000.0) THEN 'INR' ELSE '' END AS currency FROM f),
h AS (SELECT *, CASE WHEN b IS NULL THEN a * many ELSE least(a, b * many) END * scale AS low, CASE WHEN b IS NULL THEN a * many ELSE b * many END * scale AS high FROM g),
i AS (SELECT *, CASE WHEN period > 0 THEN period WHEN currency = 'INR' THEN CASE WHEN high >= 100000 THEN 1 ELSE 12 END WHEN high >= 10000 THEN 1 END AS factor FROM h),
j AS (SELECT *, low * factor AS least, high * factor AS most, high * factor >= 1000 AND high * factor <= 500000000 AND NOT (currency = 'INR' AND high * factor > 100000000) AS fits FROM i)
SELECT p_partkey, CASE WHEN fits THEN least END AS salary_min, CASE WHEN fits THEN most END AS salary_max, CASE WHEN fits THEN currency END AS salary_currency, CASE WHEN fits THEN 'year' END AS salary_period,
  CASE WHEN fits THEN 'Pay: ' || sign || a::INT || CASE WHEN b IS NULL THEN '' ELSE ' - ' || b::INT END || unit END AS salary_text FROM j
"""


def locality_of_places(spark, sf_dir):
    """How made places satisfy a search in one city, and the best of two."""
    rows = _mixed(spark, sf_dir, PLACE_WORDS, (1, 13, 5))
    kind = geo.locality(F.col("label"), "Delhi", PLACES, F.col("p_size") % 2 == 0, F.lit(""))
    return rows.select("p_partkey", kind.alias("kind"), geo.best_locality(F.col("label"), ["pune", "noida"], PLACES, F.lit(False), F.lit("")).alias("best"))


LOCALITY_SQL = "WITH " + _mixed_sql(PLACE_WORDS, (1, 13, 5)) + r""",
n AS (SELECT *, lower(label) AS t FROM m),
b AS (SELECT *, regexp_matches(t, '\bdelhi\b') AS delhi, regexp_matches(t, '\bnoida\b') AS noida, regexp_matches(t, '\bpune\b') AS pune, regexp_matches(t, 'maharashtra|maharastra') AS mh, contains(t, 'haryana') AS hr, regexp_matches(t, '\bindia\b') AS india,
  p_size % 2 = 0 AND NOT regexp_matches(t, '\b(us only|usa only)\b') AND (regexp_matches(t, '\b(worldwide|anywhere)\b') OR trim(t) IN ('remote', 'remote worldwide', 'fully remote', 'remote - global')) AS far FROM n),
k AS (SELECT *, CASE WHEN far THEN 'remote' ELSE '' END AS away FROM b)
SELECT p_partkey, CASE WHEN delhi THEN 'exact' WHEN noida THEN 'metro' WHEN pune OR mh OR hr THEN away WHEN india THEN 'region' ELSE away END AS kind,
  CASE WHEN pune OR noida THEN 'exact' WHEN delhi THEN 'metro' WHEN mh THEN 'region' ELSE '' END AS best FROM k
"""


def names_of_companies(spark, sf_dir):
    """Company and title keys of made names: brackets, noise words, abbreviations and signs in all combinations."""
    rows = _mixed(spark, sf_dir, NAME_WORDS, (1, 11, 5), " ")
    return rows.select("p_partkey", text.normalise_company(F.col("label")).alias("company"), text.normalise_title(F.col("label")).alias("title"), text.search_normalise(F.col("label")).alias("search"))


NAME_WORDS = ["Acme Labs", "Pvt. Ltd.", "Zed (India)", "Sr.", "jr ML Eng", "[Urgent] hiring", "Technologies", "C++/PM", "Full-time Dev", "Blue & Sons", "co", "sde, bi"]
NAMES_SQL = "WITH " + _mixed_sql(NAME_WORDS, (1, 11, 5), " ") + r""",
b AS (SELECT p_partkey, lower(label) AS l, regexp_replace(lower(label), '[\(\[\{].*?[\)\]\}]', ' ', 'g') AS t, regexp_replace(' ' || lower(label) || ' ', '[^a-z0-9+#/&.\- ]+', ' ', 'g') AS q FROM m)
SELECT p_partkey,
  trim(regexp_replace(regexp_replace(t, '\b(pvt\.?|private|ltd\.?|limited|llp|inc\.?|incorporated|corp\.?|corporation|gmbh|plc|co\.?|company|technologies|technology|solutions|services|labs|india)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS company,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\b(urgent|immediate|hiring|opening|position|role|job|vacancy|full[- ]time|part[- ]time|permanent|contract|wfh|remote|hybrid|onsite|fresher|experienced|m/f/d|\(m/w/d\))\b', ' ', 'g'),
    '\bsr\.?\b', 'senior', 'g'), '\bjr\.?\b', 'junior', 'g'), '[^a-z0-9]+', ' ', 'g')) AS title,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '\bsr\b\.?', 'senior', 'g'), '\bjr\b\.?', 'junior', 'g'), '\beng\b\.?', 'engineer', 'g'), '\bdev\b\.?', 'developer', 'g'),
    '\bml\b', 'machine learning', 'g'), '\bbi\b', 'business intelligence', 'g'), '\bsde\b', 'software engineer', 'g'), '\bpm\b', 'product manager', 'g'), '\s+', ' ', 'g')) AS search
FROM b
"""


QUERIES = {f.__name__: f for f in (feed_postings, object_caches, board_cards, board_health, request_plan, text_parts, written_times, salary_in_text, embedded_posting, places_of_parts, found_rows, looked_up, thin_rows, enriched_rows, stages,
                                        modes_of_labels, levels_of_titles, pay_of_labels, locality_of_places, names_of_companies)}
SQL = {
    "feed_postings": _feeds_sql(), "object_caches": CACHE_SQL, "board_cards": CARDS_SQL, "board_health": HEALTH_SQL, "request_plan": PLAN_SQL, "text_parts": TEXT_SQL, "written_times": TIMES_SQL, "salary_in_text": SALARY_SQL,
    "embedded_posting": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url END AS name FROM pages", "places_of_parts": PLACES_SQL, "found_rows": FOUND_SQL,
    "looked_up": "SELECT c_name AS id, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_name = 'Customer#000000077'",
    "thin_rows": "SELECT o_orderkey AS id, o_orderstatus AS source FROM orders WHERE o_custkey % 200 < 80 AND o_orderstatus IN ('F', 'O') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "enriched_rows": ENRICHED_SQL, "pay_of_labels": PAY_SQL, "locality_of_places": LOCALITY_SQL, "names_of_companies": NAMES_SQL,
    "modes_of_labels": "WITH " + _mixed_sql(MODE_WORDS) + r""" SELECT p_partkey, CASE WHEN regexp_matches(l, '\bhybrid\b') THEN 'hybrid' WHEN regexp_matches(l, '\b(fully[\s-]?remote|work from home|wfh|remote[\s-]?first|100% remote|remote)\b') THEN 'remote'
      WHEN regexp_matches(l, '\b(on[\s-]?site|in[\s-]?office|work from office|wfo)\b') THEN 'onsite' ELSE 'unknown' END AS mode FROM (SELECT p_partkey, lower(label) AS l FROM m)""",
    "levels_of_titles": "WITH " + _mixed_sql(LEVEL_WORDS, (1, 17), " ") + r""" SELECT p_partkey, CASE WHEN regexp_matches(l, '\b(intern|internship|trainee|apprentice)\b') THEN 'intern' WHEN regexp_matches(l, '\b(chief|cto|ceo|cfo|coo|vp|vice president|head of|director)\b') THEN 'exec'
      WHEN regexp_matches(l, '\b(lead|principal|staff|architect|manager)\b') THEN 'lead' WHEN regexp_matches(l, '\b(senior|sr|sde\s*[3-9]|iii|iv)\b') THEN 'senior' WHEN regexp_matches(l, '\b(junior|jr|entry|fresher|graduate|associate|sde\s*1|i{1,2})\b') THEN 'entry'
      WHEN y IS NULL THEN 'unknown' WHEN y >= 8 THEN 'lead' WHEN y >= 5 THEN 'senior' WHEN y >= 2 THEN 'mid' ELSE 'entry' END AS level FROM (SELECT p_partkey, lower(label) AS l, [3, 5, 1, 10, NULL, NULL, 8][p_size % 7 + 1] AS y FROM m)""",
    "stages": """SELECT 'stored' AS stage, count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' UNION ALL SELECT 'incoming', count(DISTINCT o_custkey) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'
      UNION ALL SELECT 'after', count(DISTINCT o_custkey) FROM orders""",
}
