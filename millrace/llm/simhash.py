"""SimHash near-dedup with a byte-position inverted index and count filtering.

fingerprint_components(): 64-bit fingerprints that differ in at most MAX_BITS bits are linked, exactly. So few bits
change so few bytes that at least 8 - MAX_BITS positional bytes agree. The index has a posting for the bytes at each
choice of two byte groups; whichever bytes differ, two groups stay whole, so every link shares a posting. Within a
posting the shared positional bytes of a pair are tallied, pairs below the guaranteed minimum go, the rest is
verified bit by bit. Equal fingerprints are one member. A posting of more than POSTING members forms no pairs: its
members meet at midpoints instead. Two fingerprints within two bits have a number in common among themselves and
their 64 one-bit neighbours, and at most 65 members share such a number, so this is exact and linear.

near_duplicates(): the same index over signatures of SIGNATURE_BITS bits, for texts that share 0.8 of their five-word
shingles, which changes about one bit in seven. There a posting is the bytes at three positions or more (half bytes
count): as many as keep chance meetings below CHANCE a signature, and so many different ones that a pair at the wanted
similarity misses all with a chance of exp(-MEETINGS). Keys travel in packed arrays, by ranges of keys: six bytes or less each. Signatures travel to the
postings alone in which members of different groups meet. The tally asks for MIN_SHARED of the positional bytes, pairs whose share of differing bits says less than the wanted
similarity by over SLACK go, and the rest is decided by the Jaccard of the texts' sets of shingles.
"""

from __future__ import annotations

import math
import os
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import slices, word_keys
from millrace.llm.common import salt_of, salted, written
from millrace.llm.components import components

MAX_BITS = 2
POSTING = 64
SEED = 42
SALTS = 8
SIGNATURE_BITS = 2048
LEAST_KEY_BITS = 24
MEETINGS = 6.2
CHANCE = 4
#: Signatures whose keys of one range meet in a task.
RANGE = 1 << 20
#: Sizes of sets in steps of a twentieth: sets whose sizes differ by more steps than WIDTH(similarity) are not compared.
STEP = 1.05
#: Five standard errors of the similarity that the signatures tell.
SLACK = 0.1
#: Tables of the first rounds.
FIRST_TABLES = (8, 32)
#: Postings with signatures that a task packs at a time, and pairs of signatures that it compares at a time.
PACKED, COMPARED = 1 << 17, 1 << 14
#: Of 256 positional bytes; pairs at similarity 0.8 share 69 on average, with a deviation of 7, unrelated ones 1.
MIN_SHARED = 32
STRIDE = 1 << 17


def fingerprint(text: str, words: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    first, last = (ends - np.diff(ends, prepend=0))[:n].tolist(), (ends[-n:] - 1).tolist()
    total = np.zeros(64, np.int64)
    for a in range(0, n, STRIDE):
        hashes = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(first[a: a + STRIDE], last[a: a + STRIDE])]
        total += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id_col and fp (the 64 bits as a signed long) of every row; null text has no words."""
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(found):
        for batch in found:
            fps = np.array([fingerprint(t or "", words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=out.names)

    return docs.select(id_col, text_col).mapInArrow(run, out)


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    return sum((F.when(_byte(a.bitwiseXOR(b), p) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def links(fps: DataFrame, posting: int = POSTING) -> DataFrame:
    """(id, fp) of different fingerprints -> (u, v) ids; connects all that links of at most MAX_BITS bits connect."""
    groups = np.array_split(np.arange(8), MAX_BITS + 2)
    masks = [sum(0xFF << 8 * int(p) for g in pair for p in g) for pair in combinations(groups, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    index = fps.select("id", "fp", F.posexplode(F.array([F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("c", "key"))
    sizes = index.groupBy("c", "key").count().where("count > 1")
    members = index.join(sizes, ["c", "key"])
    few = members.where(F.col("count") <= posting)
    a, b = few.select("c", "key", F.col("id").alias("u"), F.col("fp").alias("x")), few.select("c", "key", F.col("id").alias("v"), F.col("fp").alias("y"))
    tally = shared_bytes(F.col("x"), F.col("y")) >= 8 - MAX_BITS
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= MAX_BITS
    pairs = a.join(b, ["c", "key"]).where((F.col("x") < F.col("y")) & tally & near).select("u", "v")
    many = members.where(F.col("count") > posting).select("id", "fp").distinct()
    flips = [0, *(1 << b for b in range(63)), -(1 << 63)]
    half = many.select("id", "fp", F.explode(F.array([F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("mid"))
    met = half.groupBy("mid").agg(F.min("id").alias("u"), F.collect_set("id").alias("all")).where(F.size("all") > 1)  # 65 at most
    return pairs.unionByName(met.select("u", F.explode("all").alias("v")).where("u <> v"))


def fingerprint_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per row of docs: id_col, fp, component_id (smallest id reachable by links, itself included).

    Null and empty texts have fingerprint 0, linked like any other. Repeated rows each get a row. A row with a null id
    gets its fingerprint's component, but is never a component's name; with no other id there, that is null. Texts of
    any length are read whole. Other columns are left out. An empty table gives none.
    """
    found = written(fingerprints(docs, id_col, text_col, words).withColumnRenamed(id_col, "id_"), "fingerprints")
    fps = written(found.groupBy("fp").agg(F.min("id_").alias("id")), "fingerprints-distinct")
    named = components(links(fps.where("id is not null")))
    by_fp = fps.join(named, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    rows = found.withColumn("salt", salt_of(SALTS, "id_")).join(salted(by_fp, SALTS), ["fp", "salt"])  # many rows may share one fingerprint
    return rows.select(F.col("id_").alias(id_col), "fp", "component_id")


@lru_cache(1)
def _flips() -> np.ndarray:
    return np.where(np.random.default_rng(SEED).random(SIGNATURE_BITS) < 0.5, -1, 1).astype(np.float32)


def plan_keys(signatures_: int, similarity: float) -> tuple[int, int]:
    """Bits of a key (a multiple of four) and how many keys a signature has."""
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    many = lambda bits: math.ceil(MEETINGS / agree**bits)
    bits = LEAST_KEY_BITS
    while many(bits) * signatures_ > CHANCE * 2.0 ** (bits + 4) and bits < 56:  # one in eight chance pairs has sets of like sizes
        bits += 4
    return bits, many(bits)


@lru_cache(4)
def _places(bits: int, keys: int) -> np.ndarray:
    """The positions of the bytes of each key: positions are dealt to keys, again and again in another order."""
    rng, size = np.random.default_rng(SEED), -(-bits // 8)
    deal = SIGNATURE_BITS // 8 // size
    return np.concatenate([rng.permutation(SIGNATURE_BITS // 8)[: deal * size].reshape(deal, size) for _ in range(-(-keys // deal))])[:keys]


def keys_of(sig: np.ndarray, bits: int, keys: int) -> np.ndarray:
    """The keys of each signature (rows of bytes)."""
    places = _places(bits, keys)
    out = np.zeros((len(sig), keys), np.uint64)
    for k in range(places.shape[1]):
        out |= sig[:, places[:, k]].astype(np.uint64) << np.uint64(8 * k)
    return out & np.uint64((1 << bits) - 1)


def shingles(text: str, words: int, seed: int = 0) -> np.ndarray:
    """The set of hashes of the text's runs of that many words (fewer words: one run of all), ascending."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found))
    key = word_keys(np.frombuffer(b"".join(found) + bytes(8), np.uint8), np.cumsum(size) - size, size, seed)
    if len(key) < words:
        key = np.concatenate((key, np.zeros(words - len(key), np.uint64)))
    n = len(key) - words + 1
    mixed = np.zeros(n, np.uint64)
    for w in range(words):
        mixed = (mixed ^ key[w: n + w]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash bits of each set of shingles, as rows of bytes.

    The shingles are summed with signs into SIGNATURE_BITS cells, which a fast Hadamard transform turns into as many
    signed sums over all shingles; the bits are the signs. The smallest shingle breaks ties. No words: all bits 0."""
    cells = np.zeros((len(sets), SIGNATURE_BITS), np.float32)
    for k, mixed in enumerate(sets):
        if len(mixed):
            sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
            sign[0] *= 1.5
            cells[k] = np.bincount((mixed % np.uint64(SIGNATURE_BITS)).astype(np.int64), sign, SIGNATURE_BITS)
    cells *= _flips()
    step = 1
    while step < SIGNATURE_BITS:
        view = cells.reshape(len(sets), -1, 2, step)
        cells = np.stack((view[:, :, 0] + view[:, :, 1], view[:, :, 0] - view[:, :, 1]), 2).reshape(len(sets), -1)
        step *= 2
    return np.packbits(cells > 0, axis=1)


def near(s: np.ndarray, t: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of signatures (rows of bytes, of sets of n and of m shingles) share MIN_SHARED bytes and do not tell less than the similarity by over SLACK."""
    kept = np.zeros(len(s), bool)
    for a in range(0, len(s), COMPARED):
        own = slice(a, a + COMPARED)
        differ = s[own] ^ t[own]
        counted = (differ == 0).sum(1) >= MIN_SHARED
        share = np.bitwise_count(differ).sum(1) / SIGNATURE_BITS
        common = np.maximum(0, np.cos(np.pi * share)) * np.sqrt(n[own] * m[own])
        kept[own] = counted & (common >= (similarity - SLACK) * np.maximum(n[own] + m[own] - common, 1))
    return kept


def _digest(members: np.ndarray) -> bytes:
    return blake2b(members.tobytes(), digest_size=16).digest()


def _runs(sids: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows whose numbers are near enough for offsets of four bytes."""
    far = np.flatnonzero(np.abs(np.diff(sids)) >= 1 << 31) + 1
    edge = [0, *far.tolist(), len(sids)]
    return [(a, b) for a, b in zip(edge[:-1], edge[1:]) if b > a]


KEYS = "bucket long, base long, offsets binary, keys binary, steps binary, named binary, names binary, sizes binary, sigs binary"


def _index(bits: int, keys: int, ranges_: int, tables: int):
    """Packed postings of (sid, sig, n, name) under the first tables of the keys, or of (sid, sig, n, name, tables) under the tables that each row lists, then with n and
    the signature: one row for each bucket (key number and range) of a batch. Names are sent where they differ from the sid."""
    shift, columns = bits - (ranges_.bit_length() - 1), KEYS.replace(" long", "").replace(" binary", "").split(", ")

    def run(found):
        for batch in found:
            sids, n, names = (np.asarray(batch.column(c)) for c in ("sid", "n", "name"))
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, SIGNATURE_BITS // 8)
            steps = np.minimum(np.log(n) / math.log(STEP), 255).astype(np.uint8)
            listed = [np.frombuffer(x, np.uint32) for x in batch.column("tables").to_pylist()] if "tables" in batch.schema.names else None
            most = 4096 if listed is None else min(4096, max(16, PACKED // keys))
            for a, b in _runs(sids):
                for c in range(a, b, most):
                    d = min(b, c + most)
                    found_keys, base = keys_of(sig[c:d], bits, keys), int(sids[c:d].min())
                    offsets = (sids[c:d] - base).astype(np.uint32)
                    part, out = (found_keys >> np.uint64(shift)).astype(np.int64), {k: [] for k in columns}
                    rest = found_keys & np.uint64((1 << shift) - 1)
                    if listed is not None:
                        row, table = np.repeat(np.arange(d - c), [len(x) for x in listed[c:d]]), np.concatenate(listed[c:d])
                        order = np.argsort(table, kind="stable")
                        row, table = row[order], table[order]
                    for t in range(tables) if listed is None else np.unique(table).tolist():
                        rows = np.arange(d - c) if listed is None else row[np.searchsorted(table, t): np.searchsorted(table, t, "right")]
                        order = rows[np.argsort(part[rows, t], kind="stable")] if ranges_ > 1 else rows
                        edge = np.searchsorted(part[order, t], np.arange(ranges_ + 1))
                        for r in range(ranges_):
                            own = order[edge[r]: edge[r + 1]]
                            if len(own):
                                named = np.flatnonzero(names[c:d][own] != sids[c:d][own])
                                out["bucket"].append(t * ranges_ + r)
                                out["offsets"].append(offsets[own].tobytes() if len(own) < d - c or (np.diff(offsets) != 1).any() else b"")
                                out["keys"].append(_packed(rest[own, t], shift))
                                out["steps"].append(steps[c:d][own].tobytes())
                                out["named"].append(named.astype(np.uint16).tobytes())
                                out["names"].append(names[c:d][own[named]].tobytes())
                                out["sizes"].append(n[c:d][own].tobytes() if listed is not None else b"")
                                out["sigs"].append(sig[c:d][own].tobytes() if listed is not None else b"")
                    out["base"] = [base] * len(out["bucket"])
                    yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.int64() if k in ("bucket", "base") else pa.binary()) for k in columns], names=columns)

    return run


def _packed(values: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]).tobytes()


def _unpacked(data: bytes, bits: int) -> np.ndarray:
    size = -(-bits // 8)
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


PAIRS = "part long, pairs binary, open binary"


def _by_part(values: np.ndarray, part: np.ndarray) -> list[tuple[int, bytes]]:
    """The parts that occur, and the bytes of the values of each."""
    order = np.argsort(part, kind="stable")
    values, part = values[order], part[order]
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1], [True])))
    return [(int(part[a]), values[a:b].tobytes()) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def _meet(shift: int, ranges_: int, parts: int, width: int, similarity: float, what: str):
    """What meets in the postings of a bucket, packed by part: pairs of other names and like sizes, and (sid, table) of open postings, whose members are still to be compared.

    what is "firsts": the pairs of the first of a posting with all others. "open": no pairs, the postings with different names. "near": the pairs of the first again, if
    their signatures are near, and of what is without it the postings with different names still. "rest": the near pairs of all but the first."""
    def run(t: pa.Table) -> pa.Table:
        col = {c: t.column(c).to_pylist() for c in ("base", "offsets", "keys", "steps", "named", "names", "sizes", "sigs")}
        keys = [_unpacked(k, shift) for k in col["keys"]]
        sids = [b + (np.frombuffer(o, np.uint32).astype(np.int64) if o else np.arange(len(k))) for b, o, k in zip(col["base"], col["offsets"], keys)]
        names = [x.copy() for x in sids]
        for x, at, to in zip(names, col["named"], col["names"]):
            x[np.frombuffer(at, np.uint16)] = np.frombuffer(to, np.int64)
        key, sids, names, steps = np.concatenate(keys), np.concatenate(sids), np.concatenate(names), np.frombuffer(b"".join(col["steps"]), np.uint8).astype(np.int16)
        order = np.lexsort((sids, key))
        key, sids, steps, names = key[order], sids[order], steps[order], names[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        here, lead, many = np.arange(len(key)), np.repeat(first, size), np.repeat(size, size)
        if what in ("near", "rest"):
            n, sig = np.frombuffer(b"".join(col["sizes"]), np.int64)[order], np.frombuffer(b"".join(col["sigs"]), np.uint8).reshape(-1, SIGNATURE_BITS // 8)

        def met(a: np.ndarray, b: np.ndarray) -> None:
            hit = (names[a] != names[b]) & (np.abs(steps[a] - steps[b]) <= width)
            a, b = a[hit], b[hit]
            for c in range(0, len(a) if what != "firsts" else 0, COMPARED):
                x, y = a[c: c + COMPARED], b[c: c + COMPARED]
                hit = near(sig[order[x]], sig[order[y]], n[x], n[y], similarity)
                u.append(sids[x[hit]])
                v.append(sids[y[hit]])
            if what == "firsts":
                u.append(sids[a])
                v.append(sids[b])

        u, v, opened = [], [], np.zeros(len(key), bool)
        if what == "open":
            other = (names != names[lead]) & ((many > 2) | (np.abs(steps - steps[lead]) <= width))
            opened = np.repeat(np.logical_or.reduceat(other, first), size)
        elif what == "rest":
            at, lag = np.flatnonzero((many > 2) & (here > lead)), 1
            while len(at):
                at = at[at + lag < lead[at] + many[at]]
                met(at, at + lag)
                lag += 1
        else:
            met(lead, here)
            if what == "near":
                other = (here > lead) & (names != names[np.minimum(lead + 1, len(key) - 1)])
                opened = np.repeat(np.logical_or.reduceat(other, first), size) & (here > lead)
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
        pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), 1), axis=0)
        mixed = (pairs[:, 0] * 31 + pairs[:, 1]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        open_ = np.stack((sids[opened], np.full(opened.sum(), t.column("bucket")[0].as_py() // ranges_)), 1)
        rows = [(p, b, b"") for p, b in _by_part(pairs, (mixed >> np.uint64(40)).astype(np.int64) % parts)] + [(p, b"", b) for p, b in _by_part(open_, open_[:, 0] % parts)]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "pairs": pa.array([r[1] for r in rows], pa.binary()), "open": pa.array([r[2] for r in rows], pa.binary())})

    return run


MET = "u long, v long, tables binary"


def _distinct(t: pa.Table) -> pa.Table:
    """(u, v, null) pairs of a part once each, and (null, v, tables) of members of open postings, with the tables in which they are."""
    pairs = np.unique(np.frombuffer(b"".join(t.column("pairs").to_pylist()), np.int64).reshape(-1, 2), axis=0)
    opened = np.frombuffer(b"".join(t.column("open").to_pylist()), np.int64).reshape(-1, 2)
    opened = opened[np.argsort(opened[:, 0], kind="stable")]
    sids, first = np.unique(opened[:, 0], return_index=True)
    tables = [x.astype(np.uint32).tobytes() for x in np.split(opened[:, 1], first[1:])] if len(sids) else []
    return pa.table({"u": pa.chunked_array([pa.array(pairs[:, 0]), pa.nulls(len(sids), pa.int64())]), "v": pa.chunked_array([pa.array(pairs[:, 1]), pa.array(sids)]),
                     "tables": pa.chunked_array([pa.nulls(len(pairs), pa.binary()), pa.array(tables, pa.binary())])})


def _near(pairs: DataFrame, sigs: DataFrame, similarity: float) -> DataFrame:
    """Of (u, v) numbers of signatures those that are near."""
    side = lambda c, s, n: sigs.select(F.col("sid").alias(c), F.col("sig").alias(s), F.col("n").alias(n))
    both = pairs.join(side("u", "s", "n"), "u").join(side("v", "t", "m"), "v").select("u", "v", "s", "t", "n", "m")

    def run(found):
        for batch in found:
            s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE_BITS // 8) for c in ("s", "t"))
            kept = near(s, t, np.asarray(batch.column("n")), np.asarray(batch.column("m")), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(kept))

    return written(both.mapInArrow(run, "u long, v long"), "near")


def _similar(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, words: int, similarity: float, seed: int) -> DataFrame:
    """Of (u, v) numbers of signatures, a written table, those with at least that similarity; texts are (id, text)."""

    def sets(found):
        for batch in found:
            for a, part in slices(batch.column(1)):
                made = [shingles(t, words, seed) for t in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), pa.array(map(_digest, made), pa.binary()), pa.array([m.tobytes() for m in made], pa.binary())], names=["id", "member", "set"])

    def decide(found):
        for batch in found:
            kept = []
            for s, t in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist()):
                common = len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), assume_unique=True))
                kept.append(common >= similarity * max(1, (len(s) + len(t)) // 8 - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(kept, pa.bool_()))

    asked = sigs.join(pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct(), "sid").select("sid", "id", "member")
    made = texts.join(asked.select("id").distinct(), "id", "left_semi").mapInArrow(sets, "id long, member binary, set binary")
    held = written(made.join(asked, ["id", "member"]).dropDuplicates(["sid"]).select("sid", "set"), "shingles")
    mine = lambda c, s: held.select(F.col("sid").alias(c), F.col("set").alias(s))
    return pairs.join(mine("u", "s"), "u").join(mine("v", "t"), "v").select("u", "v", "s", "t").mapInArrow(decide, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, text_sha256, component) of every row that is not the one of its group of near-duplicates that stays: the smallest id.

    The similarity is the Jaccard of the sets of shingles of the lower-cased texts, words being what stands between
    ASCII white space. Rows with one set of shingles (copies, and texts without words among themselves; null counts as
    empty) are one member. In a posting all members are compared with the first; then those that are in different
    groups still, with one another, where their signatures do not tell them apart. A set too small to reach the similarity with any other set is not indexed.
    Rows that share an id are told apart by their texts; rows that repeat both stay or go together. Rows with a null id take no
    part. Ids are longs; texts of any length are read whole; other columns are left out; an empty table gives none.
    """
    seed = int.from_bytes(os.urandom(7), "little")

    def run(found):
        for batch in found:
            for a, texts in slices(batch.column(1)):
                sets = [shingles(t, words) for t in texts]
                members = [_digest(shingles(t, words, seed)) for t in texts]  # which texts are one does not hang on hashes known beforehand
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), batch.column(2).slice(a, len(texts)), pa.array(members, pa.binary()),
                                                  pa.array([r.tobytes() for r in signatures(sets)], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], names=["id", "sha", "member", "sig", "n"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = rows.withColumn("sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    found = written(hashed.mapInArrow(run, "id long, sha binary, member binary, sig binary, n long"), "signatures")
    sigs = found.groupBy("member").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    sigs = written(sigs.withColumn("sid", F.monotonically_increasing_id()), "signatures-distinct")
    able = sigs.where(F.col("n") >= similarity / (1 - similarity) - 1e-9) if similarity < 1 else sigs.where("false")
    n = able.count()
    bits, keys = plan_keys(n, similarity)
    ranges_ = 1 << max(0, math.ceil(math.log2(max(1, n) / RANGE)))
    shift, width = bits - (ranges_.bit_length() - 1), math.ceil(-math.log(similarity) / math.log(STEP)) + 1
    parts = max(8, n * keys // 4_000_000)

    def met(members: DataFrame, tables: int, what: str) -> DataFrame:
        index = members.mapInArrow(_index(bits, keys, ranges_, tables), KEYS)
        packed = index.groupBy("bucket").applyInArrow(_meet(shift, ranges_, parts, width, similarity, what), PAIRS)
        return written(packed.groupBy("part").applyInArrow(_distinct, MET), "met")

    def known(members: DataFrame) -> DataFrame:
        """members with the names of their groups by the links so far."""
        grouped = members.join(named.withColumnRenamed("id", "sid"), "sid", "left") if named is not None else members.withColumn("component", F.lit(None).cast("long"))
        return grouped.select("sid", "sig", "n", F.coalesce("component", "sid").alias("name"), *[c for c in members.columns if c == "tables"])

    def pairs(found: DataFrame) -> DataFrame:
        return found.where("u is not null").select("u", "v")

    def still_open(found: DataFrame) -> DataFrame:
        return able.join(found.where("u is null").select(F.col("v").alias("sid"), "tables"), "sid")

    # A few tables link most copies. With these as names all tables tell which postings are open, and the members of those alone send their signatures to them.
    named = None

    def joined(found: DataFrame) -> DataFrame:
        """The groups by the links so far and by those of found pairs that are similar."""
        return components(written(_similar(found, sigs, rows, words, similarity, seed), "links"), named)

    for tables in (t for t in FIRST_TABLES if t < keys):
        named = joined(_near(pairs(met(known(able), tables, "firsts")), sigs, similarity))
    opened = still_open(met(known(able), keys, "open"))
    first = met(known(opened), keys, "near")
    named = joined(pairs(first))
    rest = met(known(still_open(first)), keys, "rest")
    named = joined(pairs(rest)).withColumnRenamed("id", "sid")
    groups = sigs.select("sid", "id", "member").join(named, "sid", "left").withColumn("group", F.coalesce("component", "sid"))
    least = groups.groupBy("group").agg(F.min("id").alias("least"))
    by_member = groups.withColumn("salt", salt_of(SALTS, "sid")).join(salted(least, SALTS), ["group", "salt"]).select("member", F.col("least").alias("component"))
    # Many rows may be one member, so the members' side is salted.
    out = found.select("id", "sha", "member", salt_of(SALTS, "id").alias("salt")).join(salted(by_member, SALTS), ["member", "salt"])
    return out.where("id <> component").select("id", F.lower(F.hex("sha")).alias("text_sha256"), "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that near_duplicates() does not name, all columns as they are."""
    gone = near_duplicates(docs, id_col, text_col, **options).select(F.col("id").alias("gone_id_"), F.col("text_sha256").alias("gone_sha_")).distinct()
    same = (docs[id_col].cast("long") == gone["gone_id_"]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == gone["gone_sha_"])
    return docs.join(gone, same, "left_anti")
