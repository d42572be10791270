"""Pay read from short labels and from prose, as column expressions that refuse what is not clearly pay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of currencies, units, periods, pay phrases and the fields that may follow them.
CURRENCIES = [("INR", r"₹|\brs\.?\b|\binr\b"), ("USD", r"\$|\busd\b"), ("GBP", r"£|\bgbp\b"), ("EUR", r"€|\beur\b")]
SCALES = [(1e5, r"\b(lpa|lakhs?\s*p\.?a\.?|lacs?|lakhs?)\b"), (1e5, r"(?<=\d)\s*l\b"), (1e7, r"\b(crores?)\b|(?<=\d)\s*cr\b"), (1e3, r"(?<=\d)\s*k\b")]
PERIODS = [(1, r"\b(per\s*annum|p\.?a\.?|/\s*year|per\s*year|annual|yearly|lpa)\b"), (12, r"\b(per\s*month|p\.?m\.?|/\s*month|monthly)\b"),
           (2080, r"\b(per\s*hour|/\s*hour|hourly|/hr)\b")]
UNIT = r"(?:lakhs?|lacs?|lpa|crores?|cr|l|k)?"
MONEY = r"(?:₹|\brs\.?\s*|\binr\s*)"
LABELLED = r"\b(?:ctc|salary|package|compensation|remuneration)\b\s*[:\-–]?\s*([^\n.;|]{0,40})"
BARE = (rf"({MONEY}\s*\d[\d,.]*\s*{UNIT}(?:\s*(?:-|–|to)\s*{MONEY}?\s*\d[\d,.]*\s*{UNIT})?"
        r"|\d[\d,.]*\s*(?:-|–|to)\s*\d[\d,.]*\s*(?:lakhs?|lacs?|lpa|crores?)\b)")
NEXT_FIELD = (r"\b(experience|exp|location|notice|qualification|skills?|department|industry|company|role|position|vacanc|openings?|joining|shift|timing|"
              r"education|gender|age)\b")
HAS_MONEY = r"₹|\brs\b|\binr\b|\$|£|€|\blakhs?\b|\blacs?\b|\blpa\b|\bcrores?\b|\bcr\b|(?<=\d)\s*[lk]\b"


def _first(text: Column, rules, other) -> Column:
    out = F.lit(other)
    for value, pattern in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), F.lit(value)).otherwise(out)
    return out


def parse_salary(text: Column) -> Column:
    """struct(salary_min, salary_max, salary_currency, salary_period, salary_text) a year, or null where nothing is confidently pay.

    Each step goes through an array of one entry: what it finds is bound to a name there, where a plain expression would be written out, and run, at every use."""
    def marks(blob: Column) -> Column:
        return F.struct(blob.alias("blob"), _first(blob, SCALES, 1.0).alias("scale"), _first(blob, PERIODS, 0).alias("period"), _first(blob, CURRENCIES, "").alias("named"))

    def figures(m: Column) -> Column:
        scale = m["scale"]
        found = F.transform(F.regexp_extract_all(m["blob"], F.lit(r"(\d[\d,.]*)"), 1), lambda n: F.replace(n, F.lit(",")).try_cast("double"))
        # A figure that may be a year is none unless thousands are meant.
        kept = F.filter(found, lambda n: n.isNotNull() & ~(n.between(1900, 2100) & scale.isin(1.0, 1e5, 1e7)))
        return F.struct(m.alias("m"), F.when((m["named"] == "") & scale.isin(1e5, 1e7), "INR").otherwise(m["named"]).alias("currency"), kept.alias("kept"))

    def ends(f: Column) -> Column:
        return F.struct(f["m"]["blob"].alias("blob"), f["m"]["period"].alias("period"), f["currency"].alias("currency"),
                        (F.array_min(f["kept"]) * f["m"]["scale"]).alias("low"), (F.array_max(f["kept"]) * f["m"]["scale"]).alias("high"))

    def pay(e: Column) -> Column:
        high, period, currency = e["high"], e["period"], e["currency"]
        factor = (F.when(period > 0, period).when(currency == "INR", F.when(high >= 1e5, 1).otherwise(12)).when(high >= 1e4, 1))
        least, most = e["low"] * factor, high * factor
        fits = most.isNotNull() & (most >= 1e3) & (most <= 5e8) & ~((currency == "INR") & (most > 1e8))
        return F.when(fits, F.struct(F.round(least, 2).alias("salary_min"), F.round(most, 2).alias("salary_max"), currency.alias("salary_currency"),
                                     F.lit("year").alias("salary_period"), F.substring(e["blob"], 1, 120).alias("salary_text")))

    blob = F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 1, 300)
    bound = F.array(blob)
    for step in (marks, figures, ends, pay):
        bound = F.transform(bound, step)
    return bound[0]


def salary_from_text(text: Column) -> Column:
    """parse_salary of the first phrase in prose that is about money, or null."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 4000)
    either = f"(?i)(?:{LABELLED})|{BARE}"
    pairs = F.arrays_zip(F.regexp_extract_all(head, F.lit(either), 1).alias("labelled"), F.regexp_extract_all(head, F.lit(either), 2).alias("bare"))
    cut = F.transform(pairs, lambda p: F.regexp_replace(F.coalesce(F.nullif(p["labelled"], F.lit("")), p["bare"]), f"(?is){NEXT_FIELD}.*$", ""))
    phrases = F.filter(cut, lambda p: (F.trim(p) != "") & p.rlike(f"(?i){HAS_MONEY}"))
    return F.get(F.filter(F.transform(phrases, parse_salary), lambda s: s.isNotNull()), 0)
