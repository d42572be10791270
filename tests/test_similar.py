"""The similarity join against comparing all, and tag folding against folding record by record."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import resolve, similar

WORDS = "senior junior data analyst engineer software developer manager product lead machine learning cloud sales ops qa sql java team backend growth ii iii".split()


def titles(n, seed):
    rng, out = random.Random(seed), {""}
    while len(out) < n:
        t = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.5:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice("abcxyz ") + t[i + rng.randint(0, 1):]
        out.add(" ".join(t.split()))
    out = sorted(out)
    rng.shuffle(out)
    return out


def one_by_one(rows, least):
    led, known = [], {}
    for group, title, order in sorted(rows, key=lambda r: r[2]):
        x = " ".join(sorted((title or "").split()))
        hit = next((k for g, y, k in led if g == group and (x == y or similar.alike(x, y, least))), None) if group is not None and title is not None else None
        known[order] = hit or order
        if hit is None:
            led.append((group, x, order))
    return known


@pytest.mark.parametrize(("n", "least"), [(700, 88), (250, 75), (250, 95), (120, 100)])
def test_leaders(spark, n, least):
    rows = [("big" if i % 9 else "small", t, f"{i:06d}") for i, t in enumerate(titles(n, n))]
    rows += [(None, "data analyst", "y1"), (None, "data analyst", "y2"), ("big", None, "y3")]
    df = spark.createDataFrame(rows, "company string, title string, place string").withColumn("words_", F.lit("x"))
    got = {r.place: r.leader for r in similar.grouped(df, "company", "title", "place", least).collect()}
    assert got == one_by_one(rows, least)
    assert len(set(got.values())) < n or least >= 95


def test_long_chains_and_empty_tables(spark):
    """a leads b, b is like c, c like d, ...: each waits for the one before."""
    chain = ["abcdefghij" * 2]
    for i in range(12):
        chain.append(chain[-1][:i] + "z" + chain[-1][i + 1:])
    rows = [("g", t, f"{i:03d}") for i, t in enumerate(chain)]
    df = spark.createDataFrame(rows, "company string, title string, place string")
    assert {r.place: r.leader for r in similar.grouped(df, "company", "title", "place").collect()} == one_by_one(rows, 88)
    assert similar.grouped(df.where("false"), "company", "title", "place").collect() == []
    with pytest.raises(ValueError):
        similar.grouped(df, "company", "title", "place", 50)


def test_no_group_of_a_company(spark):
    """Candidates come from a join; neither a window nor a Python group takes a whole company."""
    df = spark.createDataFrame([("g", "a b", "1")], "company string, title string, place string")
    plan = similar.alike_pairs(df, "company", "place", "title")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def folded(records):
    """Tags of records (tags, source) folded one after another."""
    (tags, source), *rest = records
    for other, name in rest:
        out, claimed = [], set()
        for t in tags + other:
            if t in out:
                continue
            if ":" in t and not t.startswith("also:"):
                prefix = t.split(":")[0].strip().lower()
                if prefix in claimed:
                    continue
                claimed.add(prefix)
            out.append(t)
        tags = out[:16]
        if name != source and f"also:{name}" not in tags:
            tags = [*tags, f"also:{name}"]
    return tags


@pytest.mark.parametrize("seed", range(3))
def test_tags_fold_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    pool = [f"t{i}" for i in range(6 * (seed + 1))] + ["Exp: 1", "exp : 2", "Size: 3", "size:4", "also:s1", "also:zz", ":x", "b:c:d"]
    rows = [(k, i, [rng.choice(pool) for _ in range(rng.randint(0, 5))], f"s{rng.randint(0, 4)}") for k in range(40) for i in range(rng.randint(1, 14))]
    df = spark.createDataFrame(rows, "k int, at int, tags array<string>, source string").repartition(5)
    got = {r.k_k: r.tags_ for r in resolve.folded_tags(df, ["k"], ["at"]).collect()}
    assert got == {k: folded([(t, s) for a, i, t, s in sorted(rows, key=lambda r: r[1]) if a == k]) for k in {r[0] for r in rows}}


def test_tags_of_hot_and_null_keys(spark):
    """Of a key with any number of records no more than a few tags, sources and the last record are collected."""
    rows = spark.range(3000).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("at"), F.array(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("tags"),
                                    F.concat(F.lit("s"), (F.col("id") % 900).cast("string")).alias("source"))
    got = resolve.folded_tags(rows, ["k"], ["at"]).collect()
    assert [(r.k_k, r.tags_) for r in got] == [(None, folded([([f"t{i}"], f"s{i % 900}") for i in range(3000)]))]
