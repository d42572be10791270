"""The stored corpus: upsert, retention, joins against it, and its sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENRICHMENT = ["skills", "seniority", "summary"]


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in that order."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("n_ = 1").drop("n_")


def upsert(existing: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Incoming rows win; first_seen_at stays, enrichment and descriptions stay where the incoming row has none. Ids are unique on each side."""
    old = existing.select(*[F.col(c).alias(f"{c}_old") for c in existing.columns])
    both = old.join(incoming, F.col("id") == F.col("id_old"), "full_outer")
    new, known = F.col("id").isNotNull(), F.col("id_old").isNotNull()
    carry = new & known & F.coalesce(F.col("enriched_old"), F.lit(False)) & ~F.coalesce(F.col("enriched"), F.lit(False))
    out = {c: F.when(new, F.col(c)).otherwise(F.col(f"{c}_old")) for c in incoming.columns}
    out["first_seen_at"] = F.coalesce("first_seen_at_old", "first_seen_at")
    for c in ENRICHMENT:
        out[c] = F.when(carry, F.col(f"{c}_old")).otherwise(out[c])
    out["tags"] = F.when(carry, F.slice(F.array_sort(F.array_union("tags", "tags_old")), 1, 16)).otherwise(out["tags"])
    out["enriched"] = F.when(carry, F.lit(True)).otherwise(out["enriched"])
    out["description"] = F.when(new & known & (F.col("description") == ""), F.col("description_old")).otherwise(out["description"])
    out["last_seen_at"] = F.when(new, now).otherwise(F.col("last_seen_at_old"))
    return both.select(*[v.alias(c) for c, v in out.items()])


def upsert_by_key(existing: DataFrame, incoming: DataFrame, key: str, order: list) -> DataFrame:
    """A tracker's upsert: of several incoming rows of a key the first in that order counts, and it replaces the stored one."""
    fresh = latest(incoming, [key], order)
    return existing.join(fresh, key, "left_anti").unionByName(fresh)


def retained(rows: DataFrame, as_of: Column, days: int = 60) -> DataFrame:
    return rows.where(F.coalesce("posted_at", "first_seen_at") >= as_of - F.make_dt_interval(F.lit(days)))


def carry_descriptions(rows: DataFrame, existing: DataFrame) -> DataFrame:
    old = existing.select("id", F.col("description").alias("old_"))
    return rows.join(old, "id", "left").withColumn("description", F.when((F.col("description") == "") & F.col("old_").isNotNull(), F.col("old_")).otherwise(F.col("description"))).drop("old_").select(*rows.columns)


def not_enriched(rows: DataFrame, existing: DataFrame) -> DataFrame:
    return rows.join(existing.where("enriched"), "id", "left_anti")


def without_marked(rows: DataFrame, tracker: DataFrame, marks=("hidden",)) -> DataFrame:
    return rows.join(tracker.where(F.col("mark").isin(*marks)), "id", "left_anti")


def marked(rows: DataFrame, tracker: DataFrame, marks=("saved", "applied")) -> DataFrame:
    """Rows with one of the marks and when it was made, newest first."""
    return rows.join(tracker.where(F.col("mark").isin(*marks)).select("id", "mark", "at"), "id").orderBy(F.desc("at"), "id")


def toggled(events: DataFrame, key: list[str], mark: str, order: list) -> DataFrame:
    """The state after all toggles: a mark replaces another, the same mark again clears it.

    Only the last run of equal marks counts: an odd number of them leaves the mark, an even one none."""
    by = Window.partitionBy(*key).orderBy(*order)
    changes = events.withColumn("new_", (~F.col(mark).eqNullSafe(F.lag(mark).over(by))).cast("int")).withColumn("run_", F.sum("new_").over(by))
    runs = changes.groupBy(*key, "run_", mark).agg(F.count("*").alias("n_"))
    last = runs.groupBy(*key).agg(F.max_by(F.struct(mark, "n_"), "run_").alias("last_"))
    return last.where(F.col("last_.n_") % 2 == 1).select(*key, F.col(f"last_.{mark}").alias(mark))


def needs_details(rows: DataFrame, existing: DataFrame, sources: list[str], shortest: int = 80) -> DataFrame:
    """Rows of sources that can be asked again whose description is short and which are not stored yet."""
    return rows.where((F.length("description") < shortest) & F.col("source").isin(*sources)).join(existing, "id", "left_anti")


def write_corpus(rows: DataFrame, path: str, splits: int = 16, file_rows: int = 1_000_000) -> None:
    """Details by shard, the first two digits of the id. An overwrite drops shards that have no rows any more.

    A shard is written by as many tasks as splits says, in files of file_rows at most, so that a shard of any size is no one task's work."""
    split = F.pmod(F.xxhash64("id"), F.lit(splits))
    rows.withColumn("shard", F.substring("id", 1, 2)).repartition("shard", split).write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)


def read_posting(spark, path: str, wanted: str) -> DataFrame:
    """One posting; the shard predicate prunes all other partitions."""
    return spark.read.parquet(path).where((F.col("shard") == wanted[:2]) & (F.col("id") == wanted))


def with_details(index: DataFrame, details: DataFrame) -> DataFrame:
    """Index rows with what their details say, nulls included; rows without details keep their own. Ids are unique in details."""
    told = [c for c in details.columns if c != "id"]
    found = index.join(details.select("id", F.lit(True).alias("told_"), *[F.col(c).alias(f"{c}_told") for c in told]), "id", "left")
    own = [F.when(F.col("told_"), F.col(f"{c}_told")).otherwise(F.col(c)).alias(c) if c in told else F.col(c) for c in index.columns]
    return found.select(*own, *[F.col(f"{c}_told").alias(c) for c in told if c not in index.columns])


def first_by_url(rows: DataFrame, order: list, url: str = "url") -> DataFrame:
    """Of the rows of a run that share a url the first in that order; rows without one all stay."""
    has = F.coalesce(F.col(url) != "", F.lit(False))
    return latest(rows.where(has), [url], order).unionByName(rows.where(~has))


DETAILS = ["description", "apply_url", "salary_period", "enriched"]
#: Versions that stay besides the one in force: readers of them may still be running.
KEPT = 1


def _fs(spark, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _numbers(spark, path: str) -> list[int]:
    fs, place = _fs(spark, f"{path}/commits")
    return sorted(int(n) for s in fs.listStatus(place) if (n := s.getPath().getName()).isdigit()) if fs.exists(place) else []


def _commits(spark, path: str) -> list[tuple[int, str]]:
    """(number, version) of every commit, ascending. A commit is a file named by its number that holds its version's name; one without a name never came into force."""
    if not _numbers(spark, path):
        return []
    read = spark.read.text(f"{path}/commits").select(F.regexp_extract(F.input_file_name(), r"(\d+)$", 1).cast("long").alias("n"), "value").where("value <> ''")
    return sorted((r["n"], r["value"]) for r in read.collect())  # a few files: old ones go with each save


def version(spark, path: str) -> str:
    """The folder of the version in force."""
    found = _commits(spark, path)
    if not found:
        raise FileNotFoundError(f"no corpus in {path}")
    return f"{path}/{found[-1][1]}"


def save(rows: DataFrame, health: DataFrame, path: str, as_of: Column) -> str:
    """A corpus as four tables of one version under path: index, details by shard, and health and meta as JSON. Returns the version's folder.

    All tables are written to a folder of their own; then one file that names it is made, which is the commit. Until then, and after a crash at any step, the version before stays in
    force, whole. Two that save at once get numbers of their own or the later one fails: a commit's file is never overwritten. Old versions but KEPT, and what crashes left, are deleted after the commit."""
    from millrace.operators import facets

    spark = rows.sparkSession
    before = _commits(spark, path)
    made = f"version-{uuid.uuid4().hex}"
    target = f"{path}/{made}"
    index_projection(rows).write.parquet(f"{target}/index")
    write_corpus(rows.select("id", *DETAILS), f"{target}/details")
    health.write.json(f"{target}/health")
    by = rows.groupBy("source").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"))  # one entry a source
    facets.meta(rows, health).crossJoin(F.broadcast(by)).select(as_of.alias("updated_at"), "*").coalesce(1).write.json(f"{target}/meta")  # one row each
    commit(spark, path, max(_numbers(spark, path), default=0) + 1, made)
    kept = {made, *(v for _, v in before[-KEPT:])}
    fs, place = _fs(spark, path)
    for s in fs.listStatus(place):
        if s.getPath().getName().startswith("version-") and s.getPath().getName() not in kept:
            fs.delete(s.getPath(), True)
    for n, _ in before[: max(0, len(before) - KEPT)]:
        fs.delete(_fs(spark, f"{path}/commits/{n:020d}")[1], False)
    return target


def commit(spark, path: str, number: int, made: str) -> None:
    """Puts a version in force. The file is made only if there is none of that number, which file systems with atomic creation decide for one of two that try."""
    fs, place = _fs(spark, f"{path}/commits/{number:020d}")
    out = fs.create(place, False)
    out.writeBytes(made)
    out.close()


def load(spark, path: str, rebuild: bool = False) -> DataFrame:
    """What save() stored last, as postings; a rebuild starts from none of it."""
    at = version(spark, path)
    rows = with_details(spark.read.parquet(f"{at}/index"), spark.read.parquet(f"{at}/details").drop("shard"))
    return rows.where(F.lit(False)) if rebuild else rows


def index_projection(rows: DataFrame) -> DataFrame:
    """The light index, newest first."""
    from millrace.schema import INDEX

    url = F.coalesce(F.nullif(F.col("apply_url"), F.lit("")), F.col("url"))
    return rows.orderBy(F.coalesce("posted_at", "first_seen_at").desc(), "id").select(*[url.alias("url") if c == "url" else c for c in INDEX])
