"""Queries over landed material (listings of a sitemap, cards, caches, comments, texts) that Spark makes from the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import AS_OF, CHECKED, LISTED_SQL, RULES, _listed, _now, table
from millrace.functions import contact, geo, quality
from millrace.operators import cv, dictionary, hydrate, outreach, saved, score
from millrace.schema import coerce_stored
from millrace.sources import boards, comments, sitemap

CITIES = geo.Gazetteer({"delhi": ("new delhi", "delhi ncr"), "noida": ("greater noida",), "pune": (), "bangalore": ("bengaluru",)}, country=("india",))


def _listings(spark, sf_dir):
    """A listing URL for each page: a title, the host's first label (every third with two more words) and places, and a malformed one here and there."""
    p = table(spark, sf_dir, "pages")
    label, lang = F.regexp_extract("url", r"^https?://([^./]+)", 1), F.regexp_extract("url", r"^https?://[^/]+/([^/]+)", 1)
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("page_id") % n + 1).cast("int"))
    employer = F.when(F.col("page_id") % 3 == 0, F.concat(label, F.lit("-"), lang, F.lit("-labs"))).otherwise(label)
    slug = F.concat(pick(4, "senior-data-analyst-", "SQL-developer-", "qa-lead-", ""), employer, pick(5, "", "-pune", "-greater-noida-delhi-ncr", "-new-delhi", "-remote"))
    years = F.concat((F.col("page_id") % 11).cast("string"), F.lit("-to-"), (F.col("page_id") % 11 + 3).cast("string"), pick(2, "-years-", "-year-"))
    url = F.concat(F.lit("https://x.example.org/job-listings-"), slug, F.lit("-"), years, (F.col("page_id") + pick(7, 10_000_000, 10_000_000, 10_000_000, 10_000_000, 10_000_000, 10_000_000, 0)).cast("string"))
    stamp = F.date_format(F.expr("timestampadd(MINUTE, page_id, TIMESTAMP_NTZ '2024-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss")
    made = p.select(url.alias("url"), F.concat(stamp, F.lit("+05:30")).alias("lastmod"), label.alias("label"), lang.alias("lang"))
    listed = made.where(F.length("label") % 2 == 0).select("label").union(made.where("lang = 'en'").select(F.concat("label", F.lit("-en-labs")))).select(
        F.concat(F.lit("https://www.naukri.com/"), "label", F.lit("-jobs-careers-17")).alias("url"))
    return made.select("url", "lastmod"), listed


def url_postings(spark, sf_dir):
    listings, listed = _listings(spark, sf_dir)
    out = sitemap.url_postings(listings, sitemap.employers(listed), CITIES)
    return out.select("url", "title", "company", "location", F.unix_timestamp("posted_at").alias("posted"), "seniority", F.array_join("tags", "|").alias("tags"))


URL_POSTINGS_SQL = f"""
WITH p AS (SELECT page_id AS k, regexp_extract(url, '^https?://([^./]+)', 1) AS label, regexp_extract(url, '^https?://[^/]+/([^/]+)', 1) AS lang FROM pages),
made AS (SELECT label, lang, k % 11 AS low, k % 11 + 3 AS high, epoch(TIMESTAMP '2024-01-01')::BIGINT + 60 * k - 19800 AS posted,
  ['senior-data-analyst-', 'SQL-developer-', 'qa-lead-', ''][k % 4 + 1] || CASE WHEN k % 3 = 0 THEN label || '-' || lang || '-labs' ELSE label END
    || ['', '-pune', '-greater-noida-delhi-ncr', '-new-delhi', '-remote'][k % 5 + 1] AS slug,
  CASE WHEN k % 2 = 0 THEN '-years-' ELSE '-year-' END AS years, k + CASE WHEN k % 7 = 6 THEN 0 ELSE 10000000 END AS number FROM p),
known AS (SELECT label AS employer FROM made WHERE length(label) % 2 = 0 UNION SELECT label || '-en-labs' FROM made WHERE lang = 'en'),
cut AS (SELECT *, 'https://x.example.org/job-listings-' || slug || '-' || low || '-to-' || high || years || number AS url,
  regexp_extract(slug, '^(.*?)((-({'|'.join(sitemap.PLACES)}))*)$', 1) AS words, regexp_extract(slug, '^(.*?)((-({'|'.join(sitemap.PLACES)}))*)$', 2) AS ends FROM made WHERE length(number::VARCHAR) >= 8),
ways AS (SELECT cut.*, employer, row_number() OVER (PARTITION BY url ORDER BY length(employer) DESC) AS n FROM cut JOIN known ON suffix(words, '-' || employer)
  AND len(string_split(employer, '-')) <= 8),
named AS (SELECT *, string_split(words[1:length(words) - length(employer) - 1], '-') AS t, string_split(employer, '-') AS c,
  list_transform(regexp_extract_all(ends, '-({'|'.join(sorted(sitemap.PLACES, key=len, reverse=True))})', 1), lambda x: string_split(x, '-')) AS l FROM ways WHERE n = 1),
cased AS (SELECT *, {{t}} AS title, {{c}} AS company, array_to_string(list_transform(l, lambda ws: {{ws}}), ', ') AS places FROM named)
SELECT url, title, company, CASE WHEN places = '' THEN 'India' WHEN regexp_matches(lower(places), 'delhi|noida|pune|india') THEN places ELSE places || ', India' END AS location, posted,
  CASE WHEN low < 2 THEN 'entry' WHEN low < 5 THEN 'mid' WHEN low < 8 THEN 'senior' ELSE 'lead' END AS seniority, 'Experience: ' || low || '-' || high || ' yrs|Details on Naukri' AS tags
FROM cased WHERE length(title) >= 3
"""
_CASED = ("array_to_string(list_transform({0}, lambda w: CASE WHEN (w = upper(w) AND w <> lower(w)) OR lower(w) IN (" + ", ".join(f"'{a}'" for a in sitemap.ACRONYMS)
          + ") THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ')")
for _name in ("t", "c", "ws"):
    URL_POSTINGS_SQL = URL_POSTINGS_SQL.replace("{" + _name + "}", _CASED.format(_name))


def _state_pages(spark, sf_dir):
    """Pages whose state is streamed in two chunks: a job for each of a page's host and number, with brackets, quotes and depth inside."""
    p = table(spark, sf_dir, "pages")
    k, host = F.col("page_id"), F.regexp_extract("url", r"^https?://([^/]+)", 1)
    deep = F.array(F.array(F.struct(F.array(F.array(F.lit("]"), F.concat(F.lit('"}'), host))).alias("a"))))
    job = F.struct(F.concat(F.lit('Dev "'), host, F.lit('" ] } [')).alias("title"), F.when(k % 5 != 0, host).alias("companyName"), F.concat(F.lit("/j/"), k.cast("string")).alias("detailUrl"),
                   F.concat((k % 10).cast("string"), F.lit(" to 12 Yrs")).alias("experienceLabel"), F.array(F.lit("Pune"), F.concat(F.lit("Zone "), (k % 3).cast("string"))).alias("locations"),
                   F.date_format(F.expr("timestampadd(MINUTE, page_id, TIMESTAMP_NTZ '2024-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss").alias("postedAt"),
                   F.when(k % 2 == 0, F.concat((k % 7 + 3).cast("string"), F.lit(" LPA"))).otherwise("Not Disclosed").alias("salaryLabel"), F.array(host).alias("skills"), deep.alias("deep"))
    state = F.concat(F.lit('1:{"n":[1,2],"jobs":'), F.to_json(F.array(job)), F.lit(',"more":["]"]}'))
    half = F.floor(F.length(state) / 2).cast("int")
    chunk = lambda c: F.concat(F.lit("<script>self.__next_f.push([1,"), F.regexp_extract(F.to_json(F.struct(c.alias("c"))), r'(?s)^\{"c":(.*)\}$', 1), F.lit("])</script>"))
    return p.select("url", F.concat(F.lit("<html>"), chunk(F.substr(state, F.lit(1), half)), chunk(F.substr(state, half + 1)), F.lit("</html>")).alias("html"))


def streamed_jobs(spark, sf_dir):
    out = boards.shine(_state_pages(spark, sf_dir))
    return out.select("url", "title", "company", "location", F.unix_timestamp("posted_at").alias("posted"), "seniority", "salary_max", "salary_text", F.array_join("skills", ",").alias("skills"), F.array_join("tags", ",").alias("tags"))


STREAMED_SQL = """
SELECT 'https://www.shine.com/j/' || k AS url, 'Dev "' || host || '" ] } [' AS title, host AS company, 'Pune, Zone ' || (k % 3) || ', India' AS location, epoch(TIMESTAMP '2024-01-01')::BIGINT + 60 * k - 19800 AS posted,
  CASE WHEN k % 10 < 2 THEN 'entry' WHEN k % 10 < 5 THEN 'mid' WHEN k % 10 < 8 THEN 'senior' ELSE 'lead' END AS seniority, CASE WHEN k % 2 = 0 THEN (k % 7 + 3) * 100000.0::DOUBLE END AS salary_max,
  CASE WHEN k % 2 = 0 THEN (k % 7 + 3) || ' LPA' ELSE '' END AS salary_text, host AS skills, 'Experience: ' || (k % 10) || ' to 12 Yrs' AS tags
FROM (SELECT page_id AS k, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) WHERE k % 5 <> 0
"""


def guest_cards(spark, sf_dir):
    """A page of cards for every customer's orders: one card an order, some without a link, some with an age instead of a date."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    link = F.when(k % 11 != 0, F.concat(F.lit('<a class="x base-card__full-link" href="https://x.io/jobs/view/'), k.cast("string"), F.lit('?trk=1#top">go</a>'))).otherwise("")
    when = F.when(k % 3 == 0, F.concat((k % 6 + 1).cast("string"), F.lit(" days ago"))).otherwise("soon")
    stamp = F.when(k % 3 != 0, F.concat(F.lit('datetime="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"'))).otherwise("")
    card = F.concat(F.lit("<li><div><h3> Order &amp; <b>"), F.initcap("o_orderpriority"), F.lit("</b>\n</h3><h4 class=s><a>C"), F.col("o_custkey").cast("string"), F.lit('</a></h4><span class="job-search-card__location">'),
                    F.when(k % 4 == 0, "Remote").otherwise("Pune"), F.lit("</span>"), link, F.lit("<time "), stamp, F.lit(">"), when, F.lit("</time></div></li>"))
    pages = o.select(F.col("o_custkey").cast("string").alias("url"), F.pmod(F.xxhash64("o_orderkey"), F.lit(4)).alias("part"), card.alias("card")).groupBy("url", "part").agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list("card"), ""), F.lit("</ul>")).alias("html"))
    out = boards.linkedin(pages, F.lit(AS_OF).cast("timestamp"))
    return out.select("url", "title", "company", "location", "remote", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"))


GUEST_SQL = f"""
SELECT 'https://x.io/jobs/view/' || o_orderkey AS url, 'Order & ' || array_to_string(list_transform(string_split(lower(o_orderpriority), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, 'C' || o_custkey AS company,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Remote' ELSE 'Pune' END AS location, CASE WHEN o_orderkey % 4 = 0 THEN 'remote' ELSE 'unknown' END AS remote,
  strftime(CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '{AS_OF}' - to_days((o_orderkey % 6 + 1)::INT) ELSE o_orderdate END, '%Y-%m-%d') AS posted
FROM orders WHERE o_orderkey % 11 <> 0
"""

FIELDS = ["Remote (EU)", "Berlin", "Data Engineer", "$100k - $120k", "Full-time", "https://x.io", "Pune, QA Lead", "Visa", "Synergy"]


def comment_postings(spark, sf_dir):
    """A comment for every customer: its name and five of nine fields by its key, a role in the body for some, now and then a remark that is no posting."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    field = lambda n: F.element_at(F.array(*map(F.lit, FIELDS)), (F.floor(k / n) % len(FIELDS) + 1).cast("int"))
    line = F.concat_ws(" | ", "c_name", *[field(n) for n in (1, 9, 81)], field(7), field(5))
    first = F.when(k % 23 == 0, F.concat(F.lit("Reminder: "), line)).otherwise(line)
    body = F.when(k % 2 == 0, "<p>- Backend Developer<p>We build things for people who like things that are built well.").otherwise("<p>We build things for people who like things that are built well.")
    out = comments.comment_postings(c.select(k.alias("id"), F.when(k % 29 == 0, "whoishiring").otherwise("jo").alias("author"), F.concat(first, body).alias("text"), k.alias("created_at_i")))
    return out.select("url", "title", "company", "location", F.length("description").alias("chars"), F.unix_timestamp("posted_at").alias("posted"))


COMMENT_SQL = f"""
WITH c AS (SELECT c_custkey AS k, c_name, list_transform([k // 1, k // 9, k // 81, k // 7, k // 5], lambda n: [{", ".join(f"'{f}'" for f in FIELDS)}][n % {len(FIELDS)} + 1]) AS raw FROM customer WHERE c_custkey % 23 <> 0 AND c_custkey % 29 <> 0),
f AS (SELECT *, list_filter(list_transform(raw, lambda x: trim(regexp_replace(x, 'https?://\\S+|www\\.\\S+', ' ', 'g'))), lambda x: x <> '') AS fs FROM c),
t AS (SELECT *, list_transform(fs, lambda x: regexp_matches(x, '(?i)^(remote|full-time|visa)\\b')) AS mode, list_transform(fs, lambda x: regexp_matches(x, '(?i)\\b(remote|eu|berlin|pune)\\b')) AS place,
  list_transform(fs, lambda x: contains(x, '$')) AS money, list_transform(fs, lambda x: regexp_matches(x, '(?i)\\b(engineer|data|lead|qa)\\b')) AS role FROM f),
n AS (SELECT *, list_filter(range(1, len(fs) + 1), lambda i: NOT mode[i] AND NOT money[i] AND NOT (place[i] AND NOT role[i]))[1] AS pos FROM t),
r AS (SELECT *, coalesce(fs[pos], CASE WHEN k % 2 = 0 THEN 'Backend Developer' END) AS title,
  array_to_string(list_transform(list_filter(range(1, len(fs) + 1), lambda i: (pos IS NULL OR i <> pos) AND (place[i] OR mode[i])), lambda i: fs[i]), ' · ') AS places FROM n)
SELECT 'https://news.ycombinator.com/item?id=' || k AS url, title, c_name AS company, places[1:90] AS location,
  length(array_to_string(list_prepend(c_name, raw), ' | ') || chr(10) || CASE WHEN k % 2 = 0 THEN '- Backend Developer' || chr(10) ELSE '' END || 'We build things for people who like things that are built well.')::INT AS chars, k AS posted
FROM r WHERE title IS NOT NULL
"""


def hydration(spark, sf_dir):
    """Documents of one source each as thin postings: fifty of a source are asked for, every page of a number ending in 77 refuses."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    rows = d.select(F.col("doc_id").alias("id"), F.concat_ws("-", "source", "lang").alias("source"), F.concat(F.lit("https://x.io/"), F.col("doc_id").cast("string")).alias("url"),
                    F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("d"), F.lit(90))).otherwise("").alias("description"))
    stored = d.where("doc_id % 10 = 1").select(F.col("doc_id").alias("id"), F.repeat(F.lit("d"), (F.col("doc_id") % 4 * 40).cast("int")).alias("description"))
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("+")), F.lit("<"), F.lit("(")), F.lit(">"), F.lit(")"))
    pages = d.where("doc_id % 17 <> 5").select(F.concat(F.lit("https://x.io/"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("doc_id") % 100 == 77, 429).otherwise(200).alias("status"),
                                              F.concat(F.lit('<p>x</p><div class="description__text">'), safe, F.lit("</div><!-- "), F.repeat(F.lit("x"), F.lit(500)), F.lit(" -->")).alias("html"))
    sources = [r[0] for r in rows.select("source").distinct().orderBy("source").collect()]  # a handful of boards
    answered = hydrate.answers(hydrate.queue(rows, stored, sources, 50, ["id"]), pages, markers=("just a moment",))
    found = hydrate.details(answered, hydrate.GUEST_BODY)
    return answered.join(found, "id", "left").select("id", "source", "nth", "stopped", F.length(F.regexp_replace("description", r"\s", "")).alias("chars"))


HYDRATION_SQL = r"""
WITH q AS (SELECT doc_id AS id, source || '-' || lang AS source, text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS nth FROM documents
  WHERE doc_id % 3 <> 0 AND NOT (doc_id % 10 = 1 AND doc_id % 4 * 40 >= 80)),
a AS (SELECT *, doc_id_page AND (id % 100 = 77 OR contains(lower(('<p>x</p><div class="description__text">' || coalesce(text, ''))[1:4000]), 'just a moment')) AS refused FROM (SELECT *, id % 17 <> 5 AS doc_id_page FROM q WHERE nth <= 50)),
s AS (SELECT *, bool_or(refused) OVER (PARTITION BY source ORDER BY nth) AS stopped, regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\r\f\v]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g') AS flat FROM a)
SELECT id, source, nth, stopped, CASE WHEN NOT stopped AND doc_id_page AND length(regexp_replace(flat, '^\s+|\s+$', '', 'g')) >= 80 THEN length(regexp_replace(flat, '\s', '', 'g')) END AS chars FROM s
"""

RUBRIC = cv.Rubric({"impact": 20.0, "structure": 15.0, "keywords": 8.0, "language_quality": 20.0}, "language_quality", ((0, "Rebuild"), (20, "Weak"), (35, "Solid"), (50, "Strong")))


def cv_scores(spark, sf_dir):
    """Documents as texts to grade, with answers that are junk, missing, in a fence, or hold scores too high, too low, as text, or none."""
    d = _listed(spark, sf_dir)
    k = F.col("doc_id")
    said = F.format_string('{"scores": {"impact": {"score": %d, "reason": "r%d"}, "structure": {"score": "%s"}, "keywords": %s}, "top_fixes": [{"a": 1}, 2], "missing_keywords": ["x", "y"], "summary": "s"}',
                           k % 31 - 5, k, F.when(k % 6 == 0, "none").otherwise((k % 16 + 0.25).cast("string")), F.when(k % 2 == 0, '{"score": 999}').otherwise("null"))
    answer = F.when(k % 7 == 0, None).when(k % 5 == 0, "not json {").when(k % 11 == 0, '{"scores": [1]}').when(k % 3 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(said)
    found = quality.findings(d, RULES, CHECKED, "cv", "doc_id", "text")
    out = cv.score(d, d.select("doc_id", answer.alias("answer")), found, RUBRIC, "doc_id")
    of = lambda n: F.get(F.filter("scores", lambda s: s["criterion"] == n), 0)["score"]
    return out.select("doc_id", "total", "partial", "band", *[of(n).alias(n) for n in RUBRIC.weights], F.size("fixes").alias("fixes"))


CV_SQL = rf"""WITH {LISTED_SQL},
found AS (
  SELECT doc_id, severity, len(regexp_extract_all(text, pattern)) AS n FROM listed, (VALUES ('high', '(?i)\bthe and\b'), ('medium', 'tion[ .,]'), ('low', ',')) r(severity, pattern)
  UNION ALL SELECT doc_id, 'medium', count(*) FROM bullets WHERE length(bullet) > 180 GROUP BY doc_id
  UNION ALL SELECT doc_id, 'low', count(*) FROM openers WHERE opener <> '' AND times >= 3 GROUP BY doc_id),
p AS (SELECT doc_id, sum(n) AS n, sum(n * CASE severity WHEN 'high' THEN 3.0 WHEN 'medium' THEN 1.5 ELSE 0.5 END)::DOUBLE AS lost FROM found GROUP BY doc_id),
l AS (SELECT doc_id, doc_id AS k, coalesce(n, 0) AS n, round(greatest(0.0::DOUBLE, 20.0::DOUBLE - least(20.0::DOUBLE, coalesce(lost, 0))), 1) AS own, k % 7 = 0 OR k % 5 = 0 OR k % 11 = 0 AS partial FROM listed LEFT JOIN p USING (doc_id) WHERE trim(coalesce(text, '')) <> ''),
g AS (SELECT *, greatest(0, least(20, k % 31 - 5))::DOUBLE AS i, CASE WHEN k % 6 = 0 THEN 0.0 ELSE least(15.0, k % 16 + 0.25) END::DOUBLE AS s, CASE WHEN k % 2 = 0 THEN 8.0 ELSE 0.0 END::DOUBLE AS w FROM l),
t AS (SELECT *, CASE WHEN NOT partial THEN round(i + s + w + own, 1) END AS total FROM g)
SELECT doc_id, total, partial, CASE WHEN total >= 50 THEN 'Strong' WHEN total >= 35 THEN 'Solid' WHEN total >= 20 THEN 'Weak' WHEN total >= 0 THEN 'Rebuild' END AS band, CASE WHEN NOT partial THEN i END AS impact,
  CASE WHEN NOT partial THEN round(s, 1) END AS structure, CASE WHEN NOT partial THEN w END AS keywords, own AS language_quality, (CASE WHEN partial THEN least(5, n) ELSE 2 END)::INT AS fixes
FROM t"""


def _staff(spark, sf_dir):
    """Documents as pages of a company's site (one of forty): their own addresses, and one made of each document's first two words."""
    d = table(spark, sf_dir, "documents")
    site = F.concat(F.lit("c"), (F.col("doc_id") % 40).cast("string"), F.lit(".example.com"))
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2,})"), 1)
    one, two, k = F.coalesce(F.get(w, 0), F.lit("info")), F.coalesce(F.get(w, 1), F.lit("x")), F.floor(F.col("doc_id") / 40) % 6
    local = F.when(k == 0, "info").when(k == 1, F.concat(one, F.lit("-"), two)).when(F.col("doc_id") % 3 == 0, F.concat(one, F.lit("."), two)).when(F.col("doc_id") % 3 == 1, F.concat(F.substring(one, 1, 1), F.lit("."), two)).otherwise(F.concat(one, F.lit("_"), two))
    host = F.when(k == 5, F.lit("other.example.org")).otherwise(site)
    return d.where("text is not null").select("doc_id", site.alias("site"), F.concat(F.lit("Write to "), local, F.lit("@"), host, F.lit(" or:\n"), "text").alias("text"))


def address_patterns(spark, sf_dir):
    return outreach.patterns(outreach.addresses(_staff(spark, sf_dir), "text", "site"))


STAFF_SQL = r"""staff AS (
  SELECT doc_id, site, w, CASE WHEN k = 5 THEN 'other.example.org' ELSE site END AS host, coalesce(w[1], 'info') AS one, coalesce(w[2], 'x') AS two, k, text
  FROM (SELECT doc_id, text, 'c' || (doc_id % 40) || '.example.com' AS site, regexp_extract_all(lower(text), '[a-z]{2,}') AS w, doc_id // 40 % 6 AS k FROM documents WHERE text IS NOT NULL)),
told AS (SELECT site, lower(unnest(regexp_extract_all('Write to ' || CASE WHEN k = 0 THEN 'info' WHEN k = 1 THEN one || '-' || two WHEN doc_id % 3 = 0 THEN one || '.' || two WHEN doc_id % 3 = 1 THEN one[1] || '.' || two ELSE one || '_' || two END
  || '@' || host || ' or:' || chr(10) || text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b'))) AS address FROM staff),
named AS (SELECT DISTINCT site AS domain, split_part(address, '@', 1) AS local FROM told WHERE regexp_replace(split_part(address, '@', 2), '^www\.', '') = site AND split_part(address, '@', 1) NOT IN (""" + ", ".join(f"'{g}'" for g in contact.GENERIC) + r""")),
shaped AS (SELECT *, CASE WHEN regexp_full_match(local, '[a-z]+\.[a-z]+') THEN 'first.last' WHEN regexp_full_match(local, '[a-z]\.[a-z]+') THEN 'f.last' WHEN regexp_full_match(local, '[a-z]+_[a-z]+') THEN 'first_last' END AS shape FROM named),
known AS (SELECT domain, coalesce(arg_min(shape, local) FILTER (WHERE shape IS NOT NULL), 'first') AS pattern,
  CASE WHEN count(shape) > 0 THEN 'found ' || min(local) FILTER (WHERE shape IS NOT NULL) || '@' || domain ELSE 'found ' || min(local) || '@' || domain || ' (single-name pattern)' END AS evidence, count(*) AS named FROM shaped GROUP BY domain)"""


def contacts(spark, sf_dir):
    """Customers as postings of those companies, some with a name in their text, some behind a board's link."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    site = F.concat(F.lit("c"), (k % 50).cast("string"), F.lit(".example.com"))
    rows = c.select(k.alias("id"), F.col("c_name").alias("company"), F.when(k % 4 == 0, "https://boards.greenhouse.io/x").when(k % 4 == 1, F.concat(F.lit("https://www."), site, F.lit("/apply"))).alias("apply_url"),
                    F.when(k % 3 == 0, F.concat(F.lit("https://"), site, F.lit("/jobs/1"))).otherwise("https://in.linkedin.com/1").alias("url"),
                    F.when(k % 2 == 0, F.concat(F.lit("Please contact Ann"), F.translate((k % 100).cast("string"), "0123456789", "abcdefghij"), F.lit(" Lee for more. See http://"), site)).when(k % 5 == 0, "contact Hiring Manager now").otherwise("").alias("description"))
    known = outreach.patterns(outreach.addresses(_staff(spark, sf_dir), "text", "site"))
    return outreach.contacts(rows, known).select("id", "domain", "nth", "name", "role", "email", "basis", F.length("link").alias("chars"))


CONTACTS_SQL = "WITH " + STAFF_SQL + r""",
c AS (SELECT c_custkey AS id, c_name AS company, CASE WHEN id % 4 = 1 OR id % 3 = 0 OR id % 2 = 0 THEN 'c' || (id % 50) || '.example.com' ELSE '' END AS domain,
  CASE WHEN id % 2 = 0 THEN 'Ann' || translate((id % 100)::VARCHAR, '0123456789', 'abcdefghij') || ' Lee' END AS name FROM customer),
r AS (SELECT id, company, domain, 0 AS nth, name, 'named in the posting' AS role FROM c WHERE name IS NOT NULL
  UNION ALL SELECT id, company, domain, CASE WHEN name IS NULL THEN 0 ELSE 1 END, '', 'Recruiter / hiring manager (search manually)' FROM c),
e AS (SELECT r.*, lower(split_part(name, ' ', 1)) AS f, pattern, evidence FROM r LEFT JOIN known k ON k.domain = r.domain)
SELECT id, domain, nth, name, role, CASE WHEN name = '' OR pattern IS NULL THEN '' ELSE CASE pattern WHEN 'first.last' THEN f || '.lee' WHEN 'f.last' THEN f[1] || '.lee' WHEN 'first_last' THEN f || '_lee' ELSE f END || '@' || domain END AS email,
  CASE WHEN name = '' OR pattern IS NULL THEN '' ELSE evidence END AS basis,
  (length('https://www.linkedin.com/search/results/people/?keywords=') + CASE WHEN name = '' THEN length(replace(company, '#', '%23')) + length('+%28recruiter+OR+talent+acquisition+OR+hiring+manager%29') ELSE length(name) + 1 + length(replace(company, '#', '%23')) END)::INT AS chars FROM e
"""


def saved_queries(spark, sf_dir):
    """Every part's name as a saved query: of each the thirty best order lines. Lines share the texts of their part."""
    part = table(spark, sf_dir, "part")
    queries = saved.plain(part.select(F.col("p_name").alias("q")).distinct(), "q", "q")
    texts = score.prepare(part.select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.array(F.lower("p_type")).alias("skills"), F.array().cast("array<string>").alias("tags"),
                                      F.lit("").alias("summary"), F.lit("").alias("description")))
    lines = table(spark, sf_dir, "lineitem").select(F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))").alias("id"), F.col("l_partkey").alias("text_id"), F.col("l_shipdate").alias("ts"))
    return saved.top(texts, lines, queries, _now(), 30)


SAVED_SQL = f"""
WITH q AS (SELECT DISTINCT p_name AS query, split_part(p_name, ' ', 1) AS t1, split_part(p_name, ' ', 2) AS t2 FROM part),
x AS (SELECT p_partkey, query, length(p_name) AS chars, contains(p_name, query) AS exact, string_split(p_name, ' ') AS tw, string_split(p_name || ' ' || lower(p_type), ' ') AS hw, lower(p_brand) AS firm, t1, t2, length(query) AS ql FROM part, q),
c AS (SELECT *, list_contains(tw, t1)::INT + list_contains(tw, t2)::INT AS present, list_contains(hw, t1)::INT + list_contains(hw, t2)::INT AS held,
  len(list_filter(tw, lambda w: w IN (t1, t2)))::DOUBLE / len(tw) AS covered FROM x WHERE list_has_any(hw, [t1, t2]) OR contains(firm, t1) OR contains(firm, t2)),
b AS (SELECT *, CASE WHEN exact THEN 1.0::DOUBLE WHEN present = 2 THEN 0.7::DOUBLE ELSE present * (0.34::DOUBLE / 2) END AS tier, least(0.18::DOUBLE, 0.02::DOUBLE * held + 0.015::DOUBLE * (contains(firm, t1) OR contains(firm, t2))::INT) AS backing,
  CASE WHEN exact THEN least(1.0::DOUBLE, ql::DOUBLE / chars) ELSE covered END AS focus FROM c),
s AS (SELECT p_partkey, query, CASE WHEN tier > 0 THEN tier + backing + 0.12::DOUBLE * focus WHEN held = 2 THEN 0.44::DOUBLE + backing WHEN backing > 0.02::DOUBLE THEN 0.16::DOUBLE + backing ELSE 0 END AS base FROM b)
SELECT query, id, score FROM (
  SELECT query, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS id, l_shipdate AS ts,
    round(base * (0.7::DOUBLE + 0.3::DOUBLE * exp(-greatest(0.0::DOUBLE, date_diff('microsecond', l_shipdate, TIMESTAMP '{AS_OF}') / 86400000000.0::DOUBLE) / 14.0::DOUBLE)), 5) AS score
  FROM lineitem JOIN s ON l_partkey = p_partkey WHERE base > 0) WHERE score >= 0.02 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, ts DESC, id) <= 30
"""


def dictionary_phrases(spark, sf_dir):
    """The words, pairs and triples of words that begin a benchmark item's lines as a dictionary of phrases, found in all documents."""
    b = table(spark, sf_dir, "benchmark")
    pieces = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(dictionary.PIECE), 1), F.when(F.lower("text").rlike("^[a-z0-9]"), 1).otherwise(2), F.lit(20))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(13), F.lit(2)), lambda i: F.transform(F.array(F.lit(1), F.lit(3), F.lit(5)), lambda n: F.array_join(F.slice(pieces, i, n), ""))))
    phrases = b.select(F.explode(F.filter(runs, lambda p: p.rlike("(?s)^[a-z0-9].*[a-z0-9]$"))).alias("phrase")).distinct()
    found = dictionary.phrases_in(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text")), ["doc_id"], "text", phrases, "phrase", 12)
    return found.select("doc_id", F.array_join("found", "|").alias("found"))


DICTIONARY_SQL = r"""
WITH b AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+|[^a-z0-9]+')[CASE WHEN regexp_matches(lower(text), '^[a-z0-9]') THEN 1 ELSE 2 END:] AS w FROM benchmark),
r AS (SELECT DISTINCT array_to_string(w[:20][i:i + n - 1], '') AS phrase FROM b, (VALUES (1), (3), (5), (7), (9), (11), (13)) s(i), (VALUES (1), (3), (5)) l(n)),
phrases AS (SELECT phrase FROM r WHERE regexp_matches(phrase, '(?s)^[a-z0-9].*[a-z0-9]$')),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+|[^a-z0-9]+') AS w FROM documents),
u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], '') AS phrase FROM u, (VALUES (1), (3), (5)) l(n) WHERE regexp_matches(w[i], '^[a-z0-9]') AND i + n - 1 <= len(w)),
h AS (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY length(phrase) DESC, phrase) AS k FROM g JOIN phrases USING (phrase))
SELECT doc_id, string_agg(phrase, '|' ORDER BY k) AS found FROM h WHERE k <= 12 GROUP BY doc_id
"""


def stored_rows(spark, sf_dir):
    """Orders as stored rows of poor quality, made safe."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, k).alias("id"), F.when(k % 13 != 0, F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).alias("title"), F.when(k % 4 != 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("company"),
        F.concat(F.when(k % 7 == 0, "javascript:").otherwise("HTTPS://x.io/"), k.cast("string")).alias("url"), F.element_at(F.array(*map(F.lit, ("remote", "Remote", "hybrid"))), (k % 3 + 1).cast("int")).alias("remote"),
        F.when(k % 5 == 0, "NaN").when(k % 5 == 1, "-4").otherwise((k % 100).cast("string")).alias("salary_min"), F.split("o_orderpriority", "-").alias("skills"),
        F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon").alias("posted_at"))
    return coerce_stored(rows).select("id", "title", "company", "url", "remote", "salary_min", F.array_join("skills", "|").alias("skills"), F.unix_timestamp("posted_at").alias("posted"), "tier", "dropped")


STORED_SQL = """
SELECT CASE WHEN k % 3 = 0 THEN k::VARCHAR ELSE url END AS id, title, CASE WHEN k % 4 <> 0 THEN 'C' || o_custkey ELSE 'Unknown' END AS company, url, CASE k % 3 WHEN 0 THEN 'remote' WHEN 2 THEN 'hybrid' ELSE 'unknown' END AS remote,
  CASE WHEN k % 5 > 1 AND k % 100 > 0 THEN (k % 100)::DOUBLE END AS salary_min, array_to_string(list_filter(string_split(o_orderpriority, '-'), lambda x: x <> ''), '|') AS skills,
  CASE WHEN k % 2 = 0 THEN epoch(date_trunc('day', o_orderdate))::BIGINT END AS posted, 'tier1' AS tier, title = '' OR url = '' AS dropped
FROM (SELECT *, o_orderkey AS k, CASE WHEN o_orderkey % 13 <> 0 THEN trim(o_orderpriority) ELSE '' END AS title, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'HTTPS://x.io/' || o_orderkey END AS url FROM orders)
"""


QUERIES = {f.__name__: f for f in (
    url_postings, streamed_jobs, guest_cards, comment_postings, hydration, cv_scores, address_patterns, contacts, saved_queries, dictionary_phrases, stored_rows)}
SQL = {
    "url_postings": URL_POSTINGS_SQL, "streamed_jobs": STREAMED_SQL, "guest_cards": GUEST_SQL, "comment_postings": COMMENT_SQL, "hydration": HYDRATION_SQL, "cv_scores": CV_SQL,
    "address_patterns": f"WITH {STAFF_SQL} SELECT * FROM known", "contacts": CONTACTS_SQL, "saved_queries": SAVED_SQL, "dictionary_phrases": DICTIONARY_SQL, "stored_rows": STORED_SQL}
