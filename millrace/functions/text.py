"""Scalar text functions as columns, all within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of titles and what they stand for, applied in this order.
ABBREVIATIONS = [
    (r"\bsr\b\.?", "senior"), (r"\bjr\b\.?", "junior"), (r"\bmgr\b\.?", "manager"), (r"\beng\b\.?", "engineer"), (r"\bdev\b\.?", "developer"),
    (r"\bml\b", "machine learning"), (r"\bai\b", "artificial intelligence"), (r"\bbi\b", "business intelligence"), (r"\bds\b", "data science"),
    (r"\bswe\b", "software engineer"), (r"\bsde\b", "software engineer"), (r"\bpm\b", "product manager"),
]
# Words that say nothing about which company or role is meant.
COMPANY_NOISE = (r"\b(pvt\.?|private|ltd\.?|limited|llp|inc\.?|incorporated|corp\.?|corporation|gmbh|plc|co\.?|company|technologies|technology|"
                 r"solutions|services|labs|india)\b")
TITLE_NOISE = (r"\b(urgent|immediate|hiring|opening|position|role|job|vacancy|full[- ]time|part[- ]time|permanent|contract|wfh|remote|hybrid|onsite|"
               r"fresher|experienced|m/f/d|\(m/w/d\))\b")
BRACKETS = r"[\(\[\{].*?[\)\]\}]"
# What a title or text says about seniority and work mode, first hit first.
SENIORITY_TITLES = [
    ("intern", r"\b(intern|internship|trainee|apprentice)\b"), ("exec", r"\b(chief|cto|ceo|cfo|coo|vp|vice president|head of|director)\b"),
    ("lead", r"\b(lead|principal|staff|architect|manager)\b"), ("senior", r"\b(senior|sr\.?|sde\s*[3-9]|iii|iv)\b"),
    ("entry", r"\b(junior|jr\.?|entry|fresher|graduate|associate|sde\s*1|i{1,2}\b)\b"),
]
WORK_MODES = [
    ("hybrid", r"\bhybrid\b"), ("remote", r"\b(fully[\s-]?remote|work from home|wfh|remote[\s-]?first|100% remote|remote)\b"),
    ("onsite", r"\b(on[\s-]?site|in[\s-]?office|work from office|wfo)\b"),
]


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_normalise(text: Column) -> Column:
    out = F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^a-z0-9+#/&.\- ]+", " ")
    for pattern, full in ABBREVIATIONS:
        out = F.regexp_replace(out, pattern, full)
    return spaced(out)


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def normalise_company(name: Column) -> Column:
    return _plain(F.regexp_replace(F.regexp_replace(F.lower(name), BRACKETS, " "), COMPANY_NOISE, " "))


def normalise_title(title: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(title), BRACKETS, " "), TITLE_NOISE, " ")
    return _plain(F.regexp_replace(F.regexp_replace(out, r"\bsr\.?\b", "senior"), r"\bjr\.?\b", "junior"))


def truncate(text: Column, limit: int = 8000) -> Column:
    """At most limit characters, cut before the last space among them, with an ellipsis."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), r" [^ ]*$", ""), F.lit(" …")))


def _first_of(text: Column, rules, other) -> Column:
    out = F.lit(other) if isinstance(other, str) else other
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def detect_remote(*fields: Column) -> Column:
    return _first_of(F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields]), WORK_MODES, "unknown")


def years_to_level(years: Column, thresholds=((8, "lead"), (5, "senior"), (2, "mid")), lowest: str = "entry") -> Column:
    out = F.lit(lowest)
    for least, name in sorted(thresholds):
        out = F.when(years >= least, name).otherwise(out)
    return out


def detect_seniority(title: Column, description: Column) -> Column:
    years = F.regexp_extract(description, r"(?i)(\d+)\s*(?:\+|-|to)?\s*(?:\d+)?\s*(?:years?|yrs?)", 1).try_cast("int")
    return _first_of(title, SENIORITY_TITLES, F.when(years.isNull(), "unknown").otherwise(years_to_level(years)))


def band_seniority(label: Column) -> Column:
    """The level that a label such as "2 to 7 Yrs" asks for at least: its first number, under 2, 5 and 8 years; without one unknown."""
    years = F.regexp_extract(F.coalesce(label.cast("string"), F.lit("")), r"(\d+)", 1).try_cast("decimal(38,0)")
    return F.when(years.isNull(), "unknown").otherwise(years_to_level(years))


def extract_skills(text: Column, vocabulary: list[str], limit: int = 10) -> Column:
    """The first limit phrases of the vocabulary, longest first, that text (normalised) holds between non-alphanumerics.

    The text is made once, and a pattern is tried only where the phrase occurs at all."""
    phrases = sorted(dict.fromkeys(vocabulary), key=lambda k: -len(k))
    hold = lambda t, p: t.contains(p) & t.rlike(r"(?<![a-z0-9])\Q" + p + r"\E(?![a-z0-9])")
    found = lambda t: F.slice(F.array_compact(F.array(*[F.when(hold(t, p), F.lit(p)) for p in phrases])), 1, limit)
    return F.transform(F.array(text), found)[0] if phrases else F.array().cast("array<string>")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9+#.]+)"), 1)


def join_locations(places: Column, most: int = 4) -> Column:
    more = F.size(places) - most
    return F.concat(F.array_join(F.slice(places, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def clean_url(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def title_case_slug(slug: Column, acronyms: tuple[str, ...] | list[str] = ()) -> Column:
    """Words of a hyphenated slug with capitals. Words all in capitals stay, acronyms (in lower case) are written in capitals."""
    known = F.array(*[F.lit(a) for a in acronyms]) if acronyms else F.array().cast("array<string>")

    def word(w: Column) -> Column:
        shouted = (w == F.upper(w)) & (w != F.lower(w))
        return F.when(shouted, w).when(F.array_contains(known, F.lower(w)), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))

    return F.array_join(F.transform(F.split(slug, "-"), word), " ")


# Acronyms that title case spoils, and those of them that read well in it.
ACRONYMS = ("ncr ey ibm tcs hcl kpmg pwc hdfc icici sbi hsbc hr it ites bpo kpo bfsi nbfc mnc sme msme ai ml sql aws gcp sap crm erp qa ui ux seo sem llp pvt ltd inc llc uae usa uk us gst kyc cfa mba bsc msc "
            "bca mca btech mtech ca cs cma").split()
LEFT_IN_TITLE_CASE = ("pvt", "ltd", "inc", "llc")


def fix_case(text: Column, acronyms: tuple[str, ...] | list[str] = tuple(ACRONYMS)) -> Column:
    """Acronyms of up to six letters that are in title case, in capitals; every other word stays as it is."""
    spoilt = F.array(*[F.lit(a.capitalize()) for a in acronyms if len(a) <= 6 and a not in LEFT_IN_TITLE_CASE]) if acronyms else F.array().cast("array<string>")
    pieces = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), 1)
    return F.array_join(F.transform(pieces, lambda w: F.when(F.array_contains(spoilt, w), F.upper(w)).otherwise(w)), "")


def age_label(seconds: Column) -> Column:
    """How long ago, by whole days, within a day by whole hours; the future is just now, an unknown age empty."""
    days, hours = F.floor(seconds / 86400).cast("long"), F.floor(seconds / 3600).cast("long")
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (F.when(seconds.isNull(), "").when(hours <= 1, "just now").when(days == 0, ago(hours, "h")).when(days == 1, "yesterday").when(days < 7, ago(days, "d"))
            .when(days < 30, ago(F.floor(days / 7), "w")).otherwise(ago(F.floor(days / 30), "mo")))


# How amounts of a currency begin.
SIGNS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£"}


def salary_label(low: Column, high: Column, currency: Column) -> Column:
    """Lakhs and crores a year for rupees, thousands for the rest; ends that read alike are one. Null without a low end."""
    cur = F.coalesce(currency, F.lit(""))
    whole = lambda x, unit: F.when(x % unit == 0, F.format_string("%.0f", x / unit)).otherwise(F.format_string("%.1f", x / unit))

    def amount(x: Column) -> Column:
        x = x.cast("double")
        rupees = F.when(x >= 1e7, F.concat(whole(x, 1e7), F.lit("Cr"))).otherwise(F.concat(whole(x, 1e5), F.lit("L")))
        rounded = lambda v: F.floor(v + 0.5).cast("string")
        return F.when(cur == "INR", rupees).when(x >= 1000, F.concat(rounded(x / 1000), F.lit("k"))).otherwise(rounded(x))

    sign = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv]), cur), F.lit(""))
    ends = F.when(high.isNull() | (amount(high) == amount(low)), amount(low)).otherwise(F.concat(amount(low), F.lit("–"), amount(high)))
    return F.when(low.isNotNull(), F.concat(sign, ends, F.when(cur == "INR", " PA").otherwise("/yr")))


# Rupees per unit; an unknown currency counts as rupees.
FX_TO_INR = {"INR": 1, "USD": 84, "EUR": 91, "GBP": 106, "": 1}


def in_rupees(amount: Column, currency: Column, fx: dict[str, float] = FX_TO_INR) -> Column:
    rates = F.create_map(*[F.lit(x) for k, v in fx.items() for x in (k, float(v))])
    return amount * F.coalesce(F.try_element_at(rates, currency), F.lit(1.0))


def display_tags(tags: Column) -> Column:
    """Without cross-post marks; of tags with one "Prefix:" the first."""
    own = F.filter(tags, lambda t: ~t.startswith("also:"))
    key = lambda t: F.lower(F.trim(F.substring_index(t, ":", 1)))
    return F.aggregate(own, F.array().cast("array<string>"), lambda acc, t: F.when(
        t.contains(":") & F.exists(acc, lambda a: a.contains(":") & (key(a) == key(t))), acc).otherwise(F.concat(acc, F.array(t))))


def relative_time(text: Column, as_of: Column) -> Column:
    """"3 days ago", "an hour ago", "30+ days", "yesterday", "just now" -> a timestamp; a month is 30 days."""
    pattern = r"(\d+|an?\b)\+?\s*(minute|min|hour|hr|day|week|month|year)"

    def parts(t: Column) -> Column:
        return F.struct(t.alias("t"), F.regexp_extract(t, pattern, 1).alias("found"), F.regexp_extract(t, pattern, 2).alias("unit"))

    def back(p: Column) -> Column:
        t, found, unit = p["t"], p["found"], p["unit"]
        n = F.when(found.startswith("a"), 1).otherwise(found.try_cast("int"))
        seconds = (F.when(unit.isin("minute", "min"), 60).when(unit.isin("hour", "hr"), 3600).when(unit == "day", 86400)
                   .when(unit == "week", 604800).when(unit == "month", 2592000).when(unit == "year", 31536000))
        return F.when(t.rlike("just now|today|few (minutes|hours) ago|moments"), 0).when(t.contains("yesterday"), 86400).otherwise(n * seconds)

    # Steps through an array of one entry: what they find is bound, not run again at every use.
    return F.timestamp_seconds(F.unix_timestamp(as_of) - F.transform(F.transform(F.array(F.lower(text)), parts), back)[0])


def absolute_time(text: Column) -> Column:
    """Epoch seconds or (above 1e11) milliseconds, ISO, or one of a few written forms."""
    number = text.try_cast("double")
    epoch = F.timestamp_seconds(F.when(number > 1e11, number / 1000).otherwise(number))
    dated = F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, ", "")  # a weekday adds nothing, and its pattern cannot be parsed with
    forms = [F.try_to_timestamp(text), *[F.try_to_timestamp(dated, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy", "MMM d, yyyy")]]
    return F.when(number.isNotNull(), epoch).otherwise(F.coalesce(*forms))
