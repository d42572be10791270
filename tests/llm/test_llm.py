"""The training-data operators against brute force, and on nulls, empty tables, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from millrace.llm import ann, bpe, chat, exact_dedup, line_dedup, packing, sharding, simhash, substring_dedup, toxicity  # noqa: E402
from millrace.llm.components import components  # noqa: E402

PATH = bpe.vocabulary_path()
EXTRA = ["salt", "digest", "keep_", "rank", "place", "key", "block", "n"]


def documents(spark, rows):
    """(doc_id, text) rows with columns whose names clash with names inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in EXTRA})


def random_texts(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(n)]
    for i in range(0, n, 4):  # shared passages, copies and near copies
        out[i] += " " + " ".join(words[:20 + i % 7])
    for i in range(1, n, 9):
        out[i] = out[i - 1]
    for i in range(2, n, 11):
        out[i] = out[i - 2].replace("w1 ", "W2\t", 1)
    return out + ["", None, None, "one", "one  two", "Łódź İstanbul ΑΣ \U0001F600 don't", "x" * 5000, out[0]]


@pytest.fixture(scope="module")
def texts():
    return list(enumerate(random_texts(60)))


def rows_by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, texts, weak):
    got = rows_by_id(exact_dedup.exact_groups(documents(spark, texts), **({"digest": lambda c: F.length(c) % 3} if weak else {})))
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    assert len(got) == len(texts)
    for i, t in texts:
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_repeats_and_nulls(spark):
    df = documents(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b")])
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()) == Counter(
        {(1, 1, 3, True): 2, (None, 1, 3, False): 1, (None, None, 1, True): 1})


def chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [x + 31 * y for x, y in zip(h, [0] + h)]
    out, cur = [], []
    for i, x in enumerate(lines):
        cur.append(x)
        if i == len(lines) - 1 or 0 < i < len(lines) - 2 and r[i - 1] > r[i] <= r[i + 1]:
            out.append(cur)
            cur = []
    return out


def test_lines(spark):
    rng = random.Random(5)
    lines = [f"line {i}" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 25)))) for i in range(40)]
    rows += [(i + 100, rows[i][1] + "\nend") for i in range(0, 40, 3)] + [(200, None), (201, ""), (202, "a\n\n\nb")]
    got, seen = rows_by_id(line_dedup.line_dedup(documents(spark, rows))), set()
    for i, t in rows:
        kept, n = [], 0
        for c in chunks(t) if t is not None else []:
            n += len(c)
            if len(c) > 1 and tuple(c) in seen:
                continue
            seen.add(tuple(c))
            kept += c
        assert (got[i].n_lines, got[i].n_removed, got[i].text) == (n, n - len(kept), None if t is None else "\n".join(kept))
    assert set(EXTRA) <= set(got[200].asDict())


def test_lines_of_repeated_rows(spark):
    text = "\n".join(f"line {i}" for i in range(12))
    rows = [(1, text), (1, text), (2, "other"), (None, "\n".join(f"row {i}" for i in range(12)))]
    got = sorted((r.doc_id or 0, r.n_removed, r.text) for r in line_dedup.line_dedup(documents(spark, rows + rows[-1:])).collect())
    assert got == sorted([(1, 0, text)] * 2 + [(2, 0, "other")] + [(0, 0, rows[-1][1])] * 2)
    got = rows_by_id(line_dedup.line_dedup(documents(spark, rows[:2] + [(5, text)])))
    assert (got[1].n_removed, got[1].text) == (0, text)
    assert got[5].n_removed == sum(len(c) for c in chunks(text) if len(c) > 1)


@pytest.mark.parametrize("block", [500_000, 400])
def test_substrings(spark, texts, block):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k:k + 13]), i)
    got = rows_by_id(substring_dedup.substring_dedup(documents(spark, texts), join_all=True, block_bytes=block))
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for j in range(13)}
        assert (got[i].n_words, got[i].n_removed, got[i].text) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


def test_substrings_of_rows_that_share_an_id(spark):
    import pyarrow as pa

    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, "a " + passage), (2, passage + " b"), (1, passage + " c")]
    words = substring_dedup.Words(*(pa.chunked_array([list(c)]) for c in zip(*rows)))
    sent = substring_dedup._send(words, 0, words.windows(13), 7, 13, 16)
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(h) // 5).any() for t, h in zip(sent.column("twice").to_pylist(), sent.column("hashes").to_pylist())]
    assert any(twice)
    for order in ([0, 1, 2], [1, 0, 2], [0, 2, 1]):
        got = substring_dedup.substring_dedup(documents(spark, [rows[i] for i in order]).coalesce(1)).collect()
        assert sorted((r.doc_id, r.n_removed, r.text) for r in got) == [(1, 0, rows[0][1]), (1, 0, rows[2][1]), (2, 20, "b")]


def fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("posting", [64, 1])
def test_simhash(spark, texts, posting, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (posting,))
    got, fp, root = rows_by_id(simhash.fingerprint_components(documents(spark, texts))), {i: fingerprint(t) for i, t in texts}, {i: i for i, _ in texts}
    for _ in texts:  # smallest label over links, until nothing changes
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 2:
                    root[a] = min(root[a], root[b])
    assert {i: (r.fp % 2**64, r.component_id) for i, r in got.items()} == {i: (fp[i], root[i]) for i in fp}


def test_links_at_two_bits_either_way(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(20)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    for posting in (64, 1):
        assert {r.id: r.component for r in components(simhash.links(df, posting)).collect()} == {i + 20: i for i in range(20)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(90, 91), (7, 7)], "u long, v long")
    assert {r.id: r.component for r in components(edges).collect()} == {**{i: 1 for i in range(2, 41)}, 91: 90}


def test_components_go_on_from_known_stars(spark):
    """Known stars count as links, are joined by later ones, and stay as they are without any."""
    known = spark.createDataFrame([(i, i // 10 * 10) for i in range(60) if i % 10], "id long, component long")
    edges = spark.createDataFrame([(15, 27), (33, 28), (50, 70), (4, 4)], "u long, v long")
    root = {i: {20: 10, 30: 10}.get(i // 10 * 10, i // 10 * 10) for i in range(60)} | {70: 50}
    assert {r.id: r.component for r in components(edges, known).collect()} == {i: r for i, r in root.items() if r != i}
    assert sorted(map(tuple, components(edges.where("false"), known).collect())) == sorted(map(tuple, known.collect()))


def test_rounds_of_few_edges_are_few_tasks(spark):
    """A round's tasks follow its edges, not the number of shuffle partitions."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "u long, v long")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before, status = {k: spark.conf.get(k, None) for k in held}, spark.sparkContext.statusTracker()
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("rounds", "rounds")
    try:
        components(edges)
        stages = {s for j in status.getJobIdsForGroup("rounds") for s in status.getJobInfo(j).stageIds}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    ran = [i.numTasks for s in stages if (i := status.getStageInfo(s)) and i.numCompletedTasks]
    assert len(ran) > 20 and sum(n >= 64 for n in ran) <= 1  # the first distinct alone


def test_groups_are_found_once_a_round(spark, monkeypatch):
    """One call for each round that brings links, none for those that read the names again."""
    rng, calls = random.Random(6), []
    base = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6)]
    rows = list(enumerate(base)) + [(i + 100, t.replace(t.split()[30], "changed")) for i, t in enumerate(base)]
    monkeypatch.setattr(simhash, "components", lambda *a: calls.append(1) or components(*a))
    assert {(r.component, r.id) for r in simhash.near_duplicates(documents(spark, rows)).collect()} == jaccard_links(rows)
    assert len(calls) == len(simhash.FIRST_TABLES) + 2


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(200)) for _ in range(12)]
    rows = list(enumerate(base)) + [(i + 100, " ".join("changed" if k == 77 else w for k, w in enumerate(t.split()))) for i, t in enumerate(base)] + [(300, base[3]), (301, ""), (302, None)]
    docs = documents(spark, rows + [(None, base[0]), (300, base[3]), (100, "another text with the id of a copy")])
    got = Counter((r.id, r.component) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter([*((i + 100, i) for i in range(12)), (300, 3), (300, 3), (302, 301)])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*range(12), 301, None, 100])


def jaccard_links(rows):
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    return {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_near_duplicates_about_the_limit(spark):
    rng, rows = random.Random(8), []
    for i in range(90):
        words = [f"t{rng.randrange(10**9)}" for _ in range(300)]
        other = words[:-(29, 32, 36)[i % 3]]  # Jaccard 0.82, 0.80, 0.78
        other += [f"t{rng.randrange(10**9)}" for _ in range(300 - len(other))]
        rows += [(i, " ".join(words)), (i + 1000, " ".join(other))]
    want = jaccard_links(rows)
    assert len(want) == 60
    assert {(r.component, r.id) for r in simhash.near_duplicates(documents(spark, rows)).collect()} == want


def test_near_duplicates_of_short_texts_and_chains(spark):
    """Texts of a few words, which have few distinct signatures, and a chain whose ends are not alike."""
    rng = random.Random(9)
    rows = [(i, f"a{rng.randrange(99)} b{rng.randrange(99)}") for i in range(900)] + [(i, " ".join(f"c{rng.randrange(9)}" for _ in range(8))) for i in range(900, 1300)]
    words = [f"w{k}" for k in range(200)]
    for k in range(12):
        rows.append((5000 + k, " ".join(words)))
        for j in range(k * 12, k * 12 + 6):
            words[j] = f"x{j}"
    sets = defaultdict(list)
    for i, t in rows:
        sets[frozenset(tuple(t.split()[k:k + 5]) for k in range(max(1, len(t.split()) - 4)))].append(i)
    links = jaccard_links(rows) | {(ids[0], b) for ids in sets.values() for b in ids[1:]}
    root = {i: i for i, _ in rows}
    for _ in range(40):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.id: r.component for r in simhash.near_duplicates(documents(spark, rows)).collect()} == {i: r for i, r in root.items() if r != i}


def test_near_duplicates_send_signatures_to_open_postings_alone(spark, monkeypatch):
    """Texts 0.7 alike share a few of 320 keys; a text's signature goes to those postings, not to each of its keys."""
    rng, index = random.Random(4), simhash._index
    base = [f"t{rng.randrange(10**9)}" for _ in range(300)]
    rows = [(i, " ".join(base[:265] + [f"t{rng.randrange(10**9)}" for _ in range(35)])) for i in range(20)] + [(i, " ".join(f"t{rng.randrange(10**9)}" for _ in range(60))) for i in range(20, 300)]
    sent = spark.sparkContext.accumulator(0)

    def counted(*args):
        run = index(*args)

        def counting(found):
            for batch in run(found):
                sent.add(sum(len(x) for c in ("sigs", "sketches") if c in batch.schema.names for x in batch.column(c).to_pylist()))
                yield batch

        return counting

    monkeypatch.setattr(simhash, "_index", counted)
    assert not jaccard_links(rows) and simhash.near_duplicates(documents(spark, rows)).collect() == []
    assert 0 < sent.value < 20 * 160 * simhash.SIGNATURE_BITS // 8


def test_keys_grow_with_the_number_of_signatures():
    bits, keys = zip(*(simhash.plan_keys(n, 0.8) for n in (10, 10**6, 10**8, 10**10)))
    agree = 1 - math.acos(1.6 / 1.8) / math.pi
    assert bits == tuple(sorted(bits)) and bits[-1] > bits[0]
    assert all((1 - agree**b) ** k < 0.0025 for b, k in zip(bits, keys))


def test_packing(spark, texts):
    capacity = 64
    got = packing.pack(documents(spark, texts), PATH, capacity=capacity, keep_ids=True).collect()
    from tokenizers import Tokenizer

    tokenizer, ids, sequences = Tokenizer.from_file(PATH), defaultdict(dict), defaultdict(list)
    for r in got:
        ids[r.doc_id][r.start] = r.ids
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.start == r.piece * capacity and len(r.ids) == r.length
    for i, t in texts:
        assert sum((ids[i][s] for s in sorted(ids[i])), []) == tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / capacity) * 1.1 + 1


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in bins if g >= n), default=None)
        if fit is None:
            bins.append(capacity - n)
        else:
            bins.remove(fit)
            bins.append(fit - n)
    return len(bins)


@pytest.mark.parametrize("lengths", [[10] * 90, "mixed"])
def test_placing_against_best_fit_decreasing(spark, lengths, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 40)  # many ranges, so that most matches are between them
    rng = random.Random(4)
    lengths = [rng.choice([rng.randint(1, 8), rng.randint(1, 50)]) for _ in range(300)] if lengths == "mixed" else lengths
    pieces = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long").repartition(4)
    rows, filled = packing.place(packing.written(pieces, "test"), 50).collect(), defaultdict(list)
    assert sorted(r.pid for r in rows) == list(range(len(lengths)))
    for r in rows:
        filled[r.sequence_id].append((r.offset, lengths[r.pid]))
    for places in filled.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 50
    assert len(filled) <= 1.01 * best_fit_decreasing(lengths, 50) + 1


def test_matching_between_ranges_equals_one_sweep():
    rng = random.Random(7)
    cells = sorted((rng.randint(1, 99), rng.randrange(2), k) for k in range(400))
    cells = [(kind, size, key, rng.randint(1, 3) if kind else 1) for size, kind, key in cells]
    whole = {(p, q) for state, p, _, q, *_ in packing.fill(cells) if state == 0}
    parts = [list(packing.fill(cells[a: a + 37])) for a in range(0, 400, 37)]
    runs, taken, stay = packing.between([(i, sum(r[0] == 1 for r in p), sum(r[6] for r in p if r[0] == 2)) for i, p in enumerate(parts)])
    pieces = {(i, r[5]): r[1] for i, p in enumerate(parts) for r in p if r[0] == 1}
    places = {(i, r[5] + k): r[3] for i, p in enumerate(parts) for r in p if r[0] == 2 for k in range(r[6])}
    found = {(r[1], r[3]) for p in parts for r in p if r[0] == 0}
    found |= {(pieces[of, high - 1 - k], places[at, first + k]) for of, low, high, at, first in runs for k in range(high - low)}
    assert found == whole and sum(stay.values()) == sum(not c[0] for c in cells) - len(whole)


def test_ann(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 16))
    v[100:130] = v[99]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("list", "rid", "v", "id")})
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, list_size=64).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    unit, hits = v / np.linalg.norm(v, axis=1, keepdims=True), 0
    assert set(got) == set(range(0, 1500, 50))
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -2
        want = sorted(range(1500), key=lambda i: (-round(score[i], 12), i))[:5]
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[i]) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(want))
    assert hits >= 0.9 * 5 * len(got)
    assert [i for _, i, _ in got[100]] == [99, 101, 102, 103, 104]
    few = ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]


@pytest.mark.parametrize("n", [300, 2500])
def test_ann_at_the_default_list_size(spark, n):
    """Posting lists from the first list on; vectors of huge and tiny components, null ids and repeated rows."""
    v = np.random.default_rng(3).normal(size=(n, 8))
    v[7], v[9] = 1e200 * v[0], 1e-200 * v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows + rows[5:6] + [(None, rows[0][1])], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    unit, hits = v / np.abs(v).max(1, keepdims=True), 0
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert {i for _, i, s in sorted(got[0])[:2]} == {7, 9} and all(abs(s - 1) < 1e-12 for _, _, s in sorted(got[0])[:2])
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -2
        hits += len({i for _, i, _ in found} & set(np.argsort(-score, kind="stable")[:5].tolist()))
    assert hits >= 0.9 * 5 * len(range(0, n, 50))


def test_ann_where_lists_far_outnumber_probes(spark):
    v = np.random.default_rng(1).normal(size=(6000, 64))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 40 == 0, list_size=8).collect():
        got[r.query_id].add(r.vec_id)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = unit[::40] @ unit.T
    score[np.arange(150), np.arange(0, 6000, 40)] = -2
    hits = sum(len(got[40 * q] & set(np.argsort(-s)[:5].tolist())) for q, s in enumerate(score))
    assert hits >= 0.95 * 5 * 150


def test_sharding(spark, texts):
    got = sharding.shard_rows(documents(spark, texts), shards=5).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 5
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    import zlib

    assert all((r.size, r.text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for (_, t), r in zip(texts, sorted(got, key=lambda r: r.doc_id)))


def test_overflow_moves_only_the_surplus():
    _, nodes = sharding.ring(4, 8)
    runs = sharding.settle({nodes[0][0]: 10, nodes[1][0]: 2}, nodes, 4)
    assert sorted(Counter({s: sum(b - a for _, a, b, t, _ in runs if t == s) for s in range(4)}).values()) == [3, 3, 3, 3]


def test_toxicity(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("la", "mo", "ti", "re") for b in ("ran", "sel", "dor", "pim")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + (" you vile zorgblat" if i % 5 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows[:300]] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = documents(spark, rows + [(900, None), (901, "")])
    model = toxicity.train(docs, labels)
    got = rows_by_id(toxicity.score(docs, model))
    assert all(got[i].predicted == int(i % 5 == 0) for i, _ in rows[300:]) and got[900].score == got[901].score and got[900].predicted == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 322
    assert 0 <= toxicity.train(docs, labels.where("toxic = 0")).scores([""])[0] < 0.3


def test_chat_round_trip(spark):
    said = ["plain", "<|end|>\n", "\\", "\\<|", "<", "|>", "<|next|>\\|", "", None, "a\nb", r"\### Assistant: </turn> ok"]
    roles = ["user", "user", "assistant", "assistant", "we|ird\n%0A", None, "assistant", "user", "assistant", "assistant", "user"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(roles, said))] + [(None, 0, "user", "x"), (2, None, "assistant", "y"), (2, None, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    out = chat.format_chat(df)
    got = {r.conv_id: r for r in out.select("conv_id", "n_turns", chat.parse_chat(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(b.role, b.text) for b in got[1].back] == [(r or "", t or "") for r, t in zip(roles, said)]
    assert got[1].loss == "".join(t or "" for r, t in zip(roles, said) if r == "assistant")
    assert (got[2].n_turns, got[2].loss, got[None].loss) == (2, "yy", "")


def test_chat_of_many_turns_and_rows_without_a_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(1500)] + [(None, 0, "assistant", "a"), (None, 0, "assistant", "b")]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted((r.conv_id or 0, r.n_turns, r.loss) for r in out.select("conv_id", "n_turns", chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect())
    assert got == [(0, 1, "a"), (0, 1, "b"), (1, 1500, "".join(f"t{k}" for k in range(1, 1500, 2)))]


def test_words_that_share_a_hash(spark, monkeypatch):
    """Words are told apart by their bytes, whatever their hashes."""
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(PATH), ["abcdefghdmbwoebiaaaaaaaa", "abcdefghjonnjjnocebziamk"]
    head = " ".join(f"c{k}" for k in range(12))
    got = substring_dedup.substring_dedup(documents(spark, [(k, f"{head} {w}") for k, w in enumerate(words)])).collect()
    assert [r.n_removed for r in got] == [0, 0]
    full, texts = bpe.word_keys, words + random_texts(20)
    monkeypatch.setattr(bpe, "word_keys", lambda *a: full(*a) & np.uint64(3 << 62))
    for text, ids in zip(texts, bpe.encode([t or "" for t in texts], bpe.Encoder(bpe.Vocabulary(open(PATH, encoding="utf-8").read())))):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    odd = ["".join(rng.choice("aAbs'’tredlvm0９½ \n\t́éΣσßİ一ー!?.,<|>\x1c Ⅷ²") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    rows = list(enumerate([t for _, t in texts] + odd + ["a<|endoftext|>b <|startoftext|>", "'s 't're aaaaaaa"]))
    for r in bpe.encode_texts(documents(spark, rows), PATH).collect():
        want = tokenizer.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (want, len(want), tokenizer.decode(want, skip_special_tokens=False))
    plain = bpe.encode_texts(documents(spark, rows[:5]), PATH, as_text=True).collect()
    assert all(r.ids == " ".join(map(str, tokenizer.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids)) for r in plain)


def test_empty_tables(spark):
    none = documents(spark, []).where("false")
    made = [exact_dedup.exact_groups(none), line_dedup.line_dedup(none), substring_dedup.substring_dedup(none), simhash.fingerprint_components(none), simhash.near_duplicates(none),
            packing.pack(none, PATH), sharding.shard_rows(none), bpe.encode_texts(none, PATH), toxicity.score(none, toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))),
            ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)), chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))]
    assert [df.count() for df in made] == [0] * len(made)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(random_texts(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(30)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        assert name == "packing" or kept.columns == docs.columns
    assert kept.count() > 0
