"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is a circle of SLOTS places. Every shard has VNODES virtual nodes at hashed places; a row hashes (by its text,
so equal texts are neighbours) to a place and belongs to the next virtual node clockwise. A shard takes at most its
share of rows; what overflows goes on clockwise to the next virtual node whose shard has room. The shares sum to the
number of rows and differ by one at most, so the loads are as even as counts can be, and only overflow leaves home.

Only the counts of rows by ring place (a fixed number of places) reach the driver, where overflow is settled as runs
(place, ranks from a to b, shard); rows find their run by their rank within their place, which ranked() computes
without bringing a hot place to one task.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ranked, written

VNODES = 128


def ring(shards: int, vnodes: int = VNODES) -> tuple[int, list[tuple[int, int]]]:
    """Number of places (a power of two) and the virtual nodes as (place, shard), clockwise."""
    bits = max(12, (8 * shards * vnodes - 1).bit_length())
    nodes = sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}") >> (64 - bits), s) for s in range(shards) for v in range(vnodes))
    return bits, nodes


def settle(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (place, first rank, end rank, shard, first slot) that put every row into a shard with room."""
    total, places = sum(counts.values()), [p for p, _ in nodes]
    room = [total // shards + (s < total % shards) for s in range(shards)]
    runs, over = [], []
    for place in sorted(counts):
        at = bisect_left(places, place) % len(nodes)
        stay = min(counts[place], room[nodes[at][1]])
        room[nodes[at][1]] -= stay
        runs.append((place, 0, stay, nodes[at][1]))
        over.append((place, stay, at))
    for place, first, at in over:
        while first < counts[place]:
            shard = nodes[at][1]
            take = min(counts[place] - first, room[shard])
            room[shard] -= take
            runs.append((place, first, first + take, shard))
            first, at = first + take, (at + 1) % len(nodes)
    out, filled = [], [0] * shards
    for place, first, end, shard in runs:
        if end > first:
            out.append((place, first, end, shard, filled[shard]))
            filled[shard] += end - first
    return out


def shard_rows(docs: DataFrame, shards: int = 8, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot (gapless in its shard).

    Shards' row counts differ by one at most. Null texts have no bytes and count as empty; repeated rows and null ids
    are rows like others; equal texts share a place on the ring, and where a place overflows its rows are dealt on by hash, so that
    equal texts may part there. Texts of any length count whole. Other columns are left out; an empty table gives none.
    """
    bits, nodes = ring(shards, vnodes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.col(id_col).alias("id_"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("hash_"), F.shiftrightunsigned(F.xxhash64(text), 64 - bits).cast("int").alias("place")), "ring-rows")
    counts = {r["place"]: r["count"] for r in rows.groupBy("place").count().collect()}
    runs = rows.sparkSession.createDataFrame(settle(counts, nodes, shards) or [(0, 0, 0, 0, 0)], "place int, first long, end long, shard int, base long")
    placed = ranked(rows, ["place"], ["hash_", "id_", "size", "text_crc32"])
    # Runs are at most places + virtual nodes in number, whatever the data: a bounded broadcast.
    placed = placed.join(F.broadcast(runs), "place").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select(F.col("id_").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
