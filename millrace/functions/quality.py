"""Text-quality rules: pattern hits, structural checks, penalties and bands."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a finding costs by its severity.
COST = {"high": 3.0, "medium": 1.5, "low": 0.5}
OTHER_COST = 1.0


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    pattern: str


def running_sums(counts: Column) -> Column:
    """The sums of an array of counts up to each of its entries; a plain fold would copy its array at every step."""
    @F.arrow_udf("array<bigint>")
    def sums(found: pa.Array) -> pa.Array:
        ends = found.offsets.to_numpy()
        total = np.concatenate([[0], np.cumsum(found.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False))]).astype(np.int64)
        ends = ends - ends[0]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(total[1:] - np.repeat(total[ends[:-1]], np.diff(ends)), pa.int64()), mask=found.is_null())

    return sums(counts)


def rule_hits(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str) -> DataFrame:
    """One row per match: id, rule, severity, excerpt, nth of that rule in the text, and its start and end in characters from 0."""
    # What stands between the matches, and the matches, tell where each begins. Patterns match one character at least.
    chars = lambda parts: F.transform(parts, F.length)
    found = docs.select(F.col(id_col), *[c for k, r in enumerate(rules) for c in (
        F.regexp_extract_all(F.col(text_col), F.lit(r.pattern), 0).alias(f"hit_{k}_"), chars(F.split(text_col, r.pattern, -1)).alias(f"gap_{k}_"))])
    summed = found.select(F.col(id_col), *[c for k, _ in enumerate(rules) for c in (
        F.col(f"hit_{k}_"), running_sums(F.col(f"gap_{k}_")).alias(f"before_{k}_"), running_sums(chars(F.col(f"hit_{k}_"))).alias(f"held_{k}_"))])

    def placed(k: int, r: Rule) -> Column:
        end = lambda i: (F.get(f"before_{k}_", i) + F.get(f"held_{k}_", i)).cast("int")
        return F.transform(f"hit_{k}_", lambda m, i: F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), m.alias("excerpt"), (i + 1).alias("nth"),
                                                              (end(i) - F.length(m)).alias("start"), end(i).alias("end")))

    return summed.select(id_col, F.explode(F.concat(*[placed(k, r) for k, r in enumerate(rules)])).alias("hit")).select(id_col, "hit.*")


def rule_counts(text: Column, rules: list[Rule]) -> dict[str, Column]:
    """Matches by severity, without leaving generated code."""
    by: dict[str, Column] = {}
    for r in rules:
        by[r.severity] = by.get(r.severity, F.lit(0)) + F.regexp_count(text, F.lit(r.pattern))
    return by


def penalty(counts: dict[str, Column], cap: float) -> Column:
    total = sum((n * COST.get(severity, OTHER_COST) for severity, n in counts.items()), F.lit(0.0))
    return F.least(total, F.lit(float(cap)))


def language_score(penalty_: Column, weight: float) -> Column:
    return F.round(F.greatest(F.lit(0.0), weight - F.least(penalty_, F.lit(float(weight)))), 1)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


MARK = r"(?U)^[•\-*–]\s+"


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def bullets(text: Column) -> Column:
    """The lines that begin with a bullet, without it."""
    lines = F.filter(F.transform(F.split(text, "\n"), _stripped), lambda line: line.rlike(MARK))
    return F.transform(lines, lambda line: F.regexp_replace(line, MARK, ""))


def long_bullets(text: Column, most: int) -> Column:
    return F.size(F.filter(bullets(text), lambda b: F.length(b) > most))


def bullet_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a bullet: id_col, nth line (from 0), start of its line in characters, bullet. Starts are running sums over a text's lines; lines end with a newline alone.

    Texts are told apart as rows, so repeated and null ids mix nothing up."""
    rows = docs.select(F.col(id_col), F.split(text_col, "\n").alias("lines_"), F.monotonically_increasing_id().alias("row_"))
    told = rows.select(F.col(id_col), "row_", "lines_", running_sums(F.transform("lines_", lambda line: F.length(line) + 1)).alias("ends_"))
    each = F.transform("lines_", lambda line, i: F.struct(i.alias("nth"), (F.get("ends_", i) - F.length(line) - 1).alias("start"), _stripped(line).alias("line")))
    held = told.select(F.col(id_col), "row_", F.explode(F.filter(each, lambda x: x["line"].rlike(MARK))).alias("x_"))
    return held.select(id_col, "row_", "x_.nth", "x_.start", F.regexp_replace("x_.line", MARK, "").alias("bullet"))


def opener(bullet: Column) -> Column:
    """The first word of a bullet, in lower case, with its apostrophes."""
    return F.lower(F.regexp_extract(bullet, r"([A-Za-z']+)", 1))


def repeated_openers(docs: DataFrame, id_col: str, text_col: str, least: int = 3) -> DataFrame:
    """Words that open at least so many bullets of one text; prose opens none."""
    verbs = bullet_lines(docs, id_col, text_col).select(id_col, "row_", opener(F.col("bullet")).alias("opener")).where("opener <> ''")
    return verbs.groupBy("row_", id_col, "opener").agg(F.count("*").alias("times")).where(F.col("times") >= least).drop("row_")


@dataclass(frozen=True)
class Check:
    """A structural check: one of CHECKS, the kind of text that it applies to, and its threshold."""

    id: str
    applies_to: str
    threshold: int


# How grave each structural check is.
CHECKS = {"note_too_long": "high", "email_too_long": "medium", "bullet_too_long": "medium", "repeated_opening_verb": "low"}


def findings(docs: DataFrame, rules: list[Rule], checks: list[Check], kind: str, id_col: str, text_col: str) -> DataFrame:
    """id_col, rule, severity, excerpt (at most 90 characters), start: every hit of a rule, and of each check for this kind of text.

    A check of the whole text starts at 0, one of a bullet where its line starts. Blank and null texts have no findings. Order them by id, start."""
    own = docs.where(F.coalesce(text_col, F.lit("")).rlike(r"(?U)\S"))
    text = F.col(text_col)
    parts = []
    if rules:
        hits = rule_hits(own, rules, id_col, text_col)
        parts.append(hits.select(id_col, "rule", "severity", F.substring(F.trim(F.regexp_replace("excerpt", r"(?U)\s+", " ")), 1, 90).alias("excerpt"), F.col("start").cast("long").alias("start")))
    for c in (c for c in checks if c.applies_to == kind):
        made = lambda rows, excerpt, start=F.lit(0), c=c: rows.select(id_col, F.lit(c.id).alias("rule"), F.lit(CHECKS[c.id]).alias("severity"), excerpt.alias("excerpt"), start.cast("long").alias("start"))
        if c.id == "note_too_long":
            parts.append(made(own.where(F.length(text) > c.threshold), F.format_string(f"%d characters (limit {c.threshold})", F.length(text))))
        elif c.id == "email_too_long":
            parts.append(made(own.where(word_count(text) > c.threshold), F.format_string(f"%d words (aim for under {c.threshold})", word_count(text))))
        elif c.id == "bullet_too_long":
            parts.append(made(bullet_lines(own, id_col, text_col).where(F.length("bullet") > c.threshold), F.substring("bullet", 1, 90), F.col("start")))
        elif c.id == "repeated_opening_verb":
            parts.append(made(repeated_openers(own, id_col, text_col, c.threshold), F.format_string('"%s" opens %d bullets', "opener", "times")))
        else:
            raise ValueError(f"no such check: {c.id}")
    if not parts:
        return own.select(id_col, *[F.lit("").alias(n) for n in ("rule", "severity", "excerpt")], F.lit(0).cast("long").alias("start")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def report(docs: DataFrame, found: DataFrame, id_col: str, weight: float = 10.0) -> DataFrame:
    """id_col, findings, clean, by_severity (a map), penalty (capped at weight), points: of every text, those without findings too. Ids are unique in docs."""
    cost = F.coalesce(F.create_map(*[F.lit(x) for kv in COST.items() for x in kv])[F.col("severity")], F.lit(OTHER_COST))
    each = found.groupBy(id_col, "severity").agg(F.count("*").alias("n"), F.sum(cost).alias("cost"))
    told = each.groupBy(id_col).agg(F.sum("n").alias("n_"), F.sum("cost").alias("cost_"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("by_"))  # an entry a severity
    lost = F.least(F.coalesce("cost_", F.lit(0.0)), F.lit(float(weight)))
    return docs.select(id_col).join(told, id_col, "left").select(
        id_col, F.coalesce("n_", F.lit(0)).alias("findings"), F.col("n_").isNull().alias("clean"), F.coalesce("by_", F.expr("cast(map() as map<string, bigint>)")).alias("by_severity"),
        lost.alias("penalty"), language_score(lost, weight).alias("points"))


def rubric_total(scores: DataFrame, id_col: str) -> DataFrame:
    """(id, criterion, score, weight) -> total of the scores held within 0 and their weights."""
    held = F.greatest(F.lit(0.0), F.least(F.col("score"), F.col("weight")))
    return scores.groupBy(id_col).agg(F.sum(held).alias("total"))


def band(total: Column, bands: list[tuple[float, str]]) -> Column:
    """The first band, from the highest, whose least total is reached; below all, the lowest."""
    ordered = sorted(bands)
    out = F.lit(ordered[0][1])
    for least, name in ordered:
        out = F.when(total >= least, name).otherwise(out)
    return out


def worst_first(hits: DataFrame, id_col: str, keep: int) -> DataFrame:
    cost = F.coalesce(F.create_map(*[F.lit(x) for kv in COST.items() for x in kv])[F.col("severity")], F.lit(OTHER_COST))
    ranked = hits.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy(cost.desc(), "rule", "nth")))
    return ranked.where(F.col("n") <= keep).drop("n")
