"""Postings in free-form comments whose first line names company, role and place between bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.html import html_to_text
from millrace.functions.salary import parse_salary
from millrace.functions.text import detect_remote, truncate
from millrace.sources.payloads import PAY

# How a first line tells what a field is, and how comments begin that are no postings.
MODE = (r"(?i)^\s*(?:100%\s*)?(?:fully\s*)?(?:remote|onsite|on-site|hybrid|wfh|in[- ]office|full[- ]?time|part[- ]?time|contract|permanent|freelance|intern(?:ship)?|visa|"
        r"h1b|relocation|equity|competitive)\b")
PLACE = (r"(?i)\b(remote|onsite|on-site|hybrid|anywhere|worldwide|usa|us|uk|eu|europe|india|canada|london|berlin|paris|amsterdam|nyc|new york|san francisco|sf|bay area|seattle|austin|boston|chicago|"
         r"toronto|bengaluru|bangalore|mumbai|delhi|hyderabad|pune|singapore|tokyo|sydney|dublin|zurich|tel aviv|utrecht|barcelona|madrid|lisbon)\b")
MONEY = r"(?i)[€$£₹]\s*\d|\b\d+\s*k\b|\bLPA\b|\bsalary\b"
ROLE = (r"(?i)\b(engineer|developer|scientist|analyst|manager|designer|architect|lead|director|founding|head|researcher|consultant|specialist|administrator|devops|sre|swe|sde|programmer|marketer|writer|"
        r"recruiter|intern|cto|cio|vp|pm|product|data|ml|ai|frontend|front[- ]end|backend|back[- ]end|fullstack|full[- ]stack|mobile|ios|android|qa|security|platform|infrastructure|support|sales|ops|operations)\b")
NO_POSTING = (r"(?i)^\s*(?:please\s+normalize|reminder|meta\b|ps[:.]|off[- ]topic|does anyone|anyone (?:else )?(?:know|hiring)|why (?:do|are|is)|how (?:do|come)|"
              r"i'?m looking for (?:a|work)|seeking work|wanted:)")
URL = r"https?://\S+|www\.\S+"
MOST = {"company": 80, "title": 140, "location": 90}
BODY_LINES = 11
SHORTEST = 60
DASHES = " -–—"


def _result(company: Column, title: Column, location: Column) -> Column:
    return F.struct(*[F.substring(F.trim(c), 1, MOST[n]).alias(n) for n, c in (("company", company), ("title", title), ("location", location))])


def parse_posting(text: Column) -> Column:
    """struct(company, title, location) of a comment, or null where it is no posting.

    The fields after the company go through a fold: the first that is no work mode and no money is the role, unless it is a place and no role
    word is in it; places and modes are gathered. Without a role in the first line the first short line of the body with a role word is it, from the second line to the twelfth. A first line without bars
    may be "role at company in place"."""
    def fields_of(t: Column) -> Column:
        first = F.trim(F.substring_index(t, "\n", 1))
        line = F.btrim(F.regexp_replace(first, URL, " "), F.lit(" |•-"))
        fields = F.filter(F.transform(F.split(line, r"\s*[|•]\s*"), lambda f: F.btrim(f, F.lit(DASHES))), lambda f: f != "")
        return F.struct(t.alias("text"), first.alias("first"), fields.alias("fields"))

    def step(acc: Column, m: Column) -> Column:
        role = (acc["title"] == "") & m["role"]
        return F.struct(F.when(role, m["f"]).otherwise(acc["title"]).alias("title"), F.when(~role & (m["place"] | m["mode"]), F.concat(acc["places"], F.array(m["f"]))).otherwise(acc["places"]).alias("places"))

    def told(f: Column) -> Column:
        return F.struct(f.alias("f"), f.rlike(MODE).alias("mode"), f.rlike(PLACE).alias("place"))

    def marked(m: Column) -> Column:
        role = ~m["mode"] & ~m["f"].rlike(MONEY) & ~(m["place"] & ~m["f"].rlike(ROLE))
        return F.struct(m["f"].alias("f"), m["mode"].alias("mode"), m["place"].alias("place"), role.alias("role"))

    def barred(x: Column) -> Column:
        fields, text_ = x["fields"], x["text"]
        begin = F.struct(F.lit("").alias("title"), F.array().cast("array<string>").alias("places"))
        rest = F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0)))
        spare = F.transform(F.slice(F.split(text_, "\n"), 2, BODY_LINES), lambda l: F.btrim(l, F.lit(DASHES + "•*\t")))
        short = lambda l: F.length(l).between(4, 90) & l.rlike(ROLE) & ~l.endswith(".") & (F.size(F.split(F.trim(l), r"\s+")) <= 10)
        body = F.coalesce(F.get(F.filter(spare, short), 0), F.lit(""))
        titled = lambda got: F.struct(F.coalesce(F.nullif(got["title"], F.lit("")), body).alias("title"), got["places"].alias("places"))
        result = lambda got: F.when(got["title"] != "", _result(F.get(fields, 0), got["title"], F.array_join(got["places"], " · ")))
        return F.transform(F.transform(F.array(F.aggregate(F.transform(F.transform(rest, told), marked), begin, step)), titled), result)[0]

    def posting(x: Column) -> Column:
        first = x["first"]
        at = r"^([^,.]{4,90}?)\s+(?:at|@|with)\s+([^,.|]{2,60}?)(?:\s+in\s+([^,.|]{2,50}))?\s*(?:[,.|]|$)"
        spoken = F.when(F.regexp_extract(first, at, 1).rlike(ROLE), _result(*[F.regexp_extract(first, at, k) for k in (2, 1, 3)]))
        return F.when((first == "") | first.rlike(NO_POSTING), None).when(F.size(x["fields"]) >= 2, barred(x)).otherwise(spoken)

    # Steps through an array of one entry: what they find is bound, not run again at every use.
    return F.transform(F.transform(F.array(text), fields_of), posting)[0]


def comments(threads: DataFrame) -> DataFrame:
    """(payload) threads in JSON -> (id, author, text, created_at_i) of their comments."""
    ddl = "children array<struct<id string, author string, text string, created_at_i long>>"
    return threads.select(F.explode(F.from_json("payload", ddl)["children"]).alias("c")).select("c.*")


def comment_postings(rows: DataFrame, base: str = "https://news.ycombinator.com/item?id=", host: str = "whoishiring") -> DataFrame:
    """(id, author, text as markup, created_at_i) -> postings. The host's own comments, texts of under SHORTEST characters and what is no posting are left out."""
    told = rows.where(F.coalesce("text", F.lit("")) != "").where(~F.col("author").eqNullSafe(host))
    # Exploded arrays of one entry: filters on what the markup and the first line say stay behind them, so each is read once.
    plain = told.select("id", "created_at_i", F.explode(F.array(html_to_text(F.col("text")))).alias("text")).where(F.length("text") >= SHORTEST)
    read = plain.select("id", "created_at_i", "text", F.explode(F.array(parse_posting(F.col("text")))).alias("p")).where("p is not null")
    line = F.trim(F.substring_index("text", "\n", 1))
    read = read.withColumn("pay", parse_salary(line))
    return read.select("p.title", "p.company", "p.location", F.concat(F.lit(base), F.col("id").cast("string")).alias("url"), truncate(F.col("text"), 4000).alias("description"),
                       F.timestamp_seconds("created_at_i").alias("posted_at"), detect_remote(line, F.substring("text", 1, 600)).alias("remote"), *[F.col(f"pay.{c}").alias(c) for c in PAY],
                       F.array(F.lit("hacker-news")).alias("tags"), F.lit("hn_hiring").alias("source"), F.lit("tier1").alias("source_tier"))
