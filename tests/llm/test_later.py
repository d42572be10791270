"""Fill-in-middle, retrieval packing and alignment against brute force, and on nulls, empty tables, repeated rows and clashing names."""

import bisect
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from millrace.llm import alignment, byte_bpe, fill_in_middle, retrieval_packing  # noqa: E402
from millrace.llm.bpe import _byte_signs  # noqa: E402

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
A, B = byte_bpe.byte_vocabulary_path(), alignment.piece_vocabulary_path()
CLASHING = ["id", "n", "form", "ids", "row", "block", "key", "local", "k0", "a", "b", "score", "start"]


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def mixed_texts():
    rng = random.Random(7)
    signs, words = "abPSM<> \né🙂1", [f"word{i}" for i in range(120)]
    out = ["".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 2, 5, 30, 255, 256, 257, 600, 3000]))) for _ in range(150)]
    out = [t if rng.random() < 0.3 else re.sub("<[PSM]>", "", t) for t in out]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(120)]
    return out + [None, "", "<", "<P", "P>", "a" * 5000, "<s> a <|endoftext|> b", "a▁b", "\t\n", " x  y ", "日本語テキスト" * 50, "same text", "same text", None]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(mixed_texts()))


def test_fill_in_middle(spark, rows):
    out = fill_in_middle.fill_in_middle(documents(spark, rows)).withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form")))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        t = t or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        digest = hashlib.sha256(f"1:{i}".encode()).hexdigest()
        h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
        x, y = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
        form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        want = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sizes = (None, None) if form == "plain" else (len(p), len(m))
        assert (got[i].n, got[i].form, (got[i].prefix_chars, got[i].middle_chars), got[i].output, got[i].back) == (len(units), form, sizes, want, t)


def test_other_sentinels(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    texts = [(1, "a [pre] b"), (2, "a [pr] b [su" * 40), (3, None), (None, "no id"), (None, "no id")]
    out = fill_in_middle.fill_in_middle(documents(spark, texts), percent=100, suffix_first=50, sentinels=marks)
    got = out.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"), marks)).collect()
    assert sorted((r.doc_id or 0, r.back) for r in got) == sorted((i or 0, t or "") for i, t in texts)
    assert {r.doc_id: r.form for r in got if r.doc_id}[1] == "plain" and {r.doc_id: r.form for r in got if r.doc_id}[2] != "plain"
    for bad in (("<P>", "<P>", "<M>"), ("<P>", ">x", "y"), ("ab", "xabx", "y"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fill_in_middle.check_sentinels(bad)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert fill_in_middle.fill_in_middle(none).collect() == [] == retrieval_packing.pack(none, A).collect()
    assert alignment.align(none, A, B).collect() == []


def test_byte_vocabulary():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(A), byte_bpe.byte_bpe(open(A, encoding="utf-8").read())
    for t in [t or "" for t in mixed_texts()] + [f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in range(0, 0x3000, 7)] + ["x" * 20000, " " * 20000, "don't we'LL  \n\n x"]:
        assert own.encode(t, special=True).tolist() == library.encode(t, add_special_tokens=False).ids
    library.encode_special_tokens = True
    assert own.encode("a<|endoftext|>").tolist() == library.encode("a<|endoftext|>", add_special_tokens=False).ids


def brute_packing(ids, capacity):
    """One shard: windows filled by the definition, BM25 with plain loops."""
    n, mean = len(ids), sum(map(len, ids)) / len(ids)
    df = Counter(t for x in ids for t in set(x))
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    tf = [Counter(x) for x in ids]

    def weight(t, k):
        return idf[t] * tf[k][t] * 2.2 / (tf[k][t] + 1.2 * (0.25 + 0.75 * len(ids[k]) / mean))

    def key(k):
        shared = sorted(((-weight(t, k), t) for t in tf[k] if df[t] > 1))[:3]
        return [t for _, t in shared] + [-1] * (3 - len(shared)) + [k]

    order, used, windows, window, seed, filled = sorted(range(n), key=key), set(), [], [], None, 0
    while len(used) < n:
        if not filled:
            k = next(k for k in order if k not in used)
        else:
            scores = {k: sum(weight(t, k) for t in tf[seed] if t in tf[k]) for k in order if k not in used}
            k = max(order, key=lambda k: (round(scores.get(k, -1), 9), -order.index(k)))
        used.add(k)
        start = 0
        while start < len(ids[k]):
            if not filled:
                seed = k
            take = min(capacity - filled, len(ids[k]) - start)
            window.append((k, start, take))
            start, filled = start + take, filled + take
            if filled == capacity:
                windows.append(window)
                window, filled = [], 0
    return windows, window


def test_retrieval_packing(spark, rows):
    texts = rows[:-14]  # ties aside, so that the order is one
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    ids = [library.encode(t, add_special_tokens=False).ids + [0] for _, t in texts]
    got = retrieval_packing.pack(documents(spark, texts).coalesce(1), A, capacity=256).collect()
    windows, rest = brute_packing(ids, 256)
    mine = {}
    for r in got:
        mine.setdefault(r.sequence_id, []).append((r.offset, r.doc_id, r.start, r.length))
    mine = [[p[1:] for p in sorted(v)] for _, v in sorted(mine.items())]
    assert mine[:len(windows)] == windows
    assert sum(p[2] for v in mine[len(windows):] for p in v) == sum(p[2] for p in rest)


def test_retrieval_packing_is_whole(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    many = rows + [(None, "no id"), (None, "no id"), (3, rows[3][1])] + [(1000 + k, None) for k in range(400)]
    got = retrieval_packing.pack(documents(spark, many), A, capacity=128, keep_ids=True, shard_tokens=3000, part_tokens=9000).collect()
    want = Counter(tuple(library.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in many)
    pieces, windows = {}, {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == r.length > 0
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(r.ids)))
    for w in windows.values():
        assert [o for o, _ in sorted(w)] == [sum(n for _, n in sorted(w)[:k]) for k in range(len(w))]
        total = sum(n for _, n in w)
        assert total <= 128 and total & (total - 1) == 0  # nothing is padded
    once = {k: v for k, v in pieces.items() if k[0] not in (None, 3)}
    for v in once.values():
        assert [s for s, _ in sorted(v)] == [sum(len(x) for _, x in sorted(v)[:k]) for k in range(len(v))]
        want[tuple(i for _, x in sorted(v) for i in x)] -= 1
    left = sum(len(x) for v in (pieces[k] for k in pieces if k[0] in (None, 3)) for _, x in v)
    assert sum(len(k) * n for k, n in want.items()) == left and sum(want.values()) == 4


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    side_a, side_b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    side_a.encode_special_tokens = True
    code, per = {c: b for b, c in enumerate(_byte_signs())}, {}
    for k, t in rows:
        a = b = []
        if t:
            whole = (" " + t).encode()
            found = side_a.encode(" " + t, add_special_tokens=False)
            a = [(i, bytes(code[c] for c in p)) for i, p in zip(found.ids, found.tokens)]
            pieces = [(i, side_b.id_to_piece(i)) for i in side_b.encode(t)]
            b = [(i, bytes([int(p[3:-1], 16)]) if side_b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
            if any(b"".join(x for _, x in side) != whole for side in (a, b)):
                a = b = []
        spans = []
        for side in (a, b):
            at, mine = 0, []
            for i, x in side:
                mine.append((i, at, at + len(x)))
                at += len(x)
            spans.append(mine)
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [([], []) for _ in ends]
        for which in (0, 1):
            for i, _, e in spans[which]:
                groups[bisect.bisect_left(ends, e)][which].append(str(i))
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if max(s, u) < min(e, v)]
        per[k] = len(a), len(b), len(groups), links, ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
    counts, best = Counter(x for v in per.values() for x in v[3]), Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return {k: (v[0], v[1], v[2], len(v[3]), sum(counts[x] == best[x[1]] for x in v[3]), sum(counts[x] for x in v[3]), v[4]) for k, v in per.items()}


@pytest.mark.parametrize("block", [4_000_000, 2_000])
def test_alignment(spark, rows, block):
    want = brute_alignment(rows)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(documents(spark, rows), A, B, block_bytes=block).collect()}
    assert got == want
    assert want[[i for i, t in rows if t == "a▁b"][0]][:6] == (0,) * 6 == want[[i for i, t in rows if t is None][0]][:6]


def test_alignment_of_repeated_rows(spark):
    got = alignment.align(documents(spark, [(1, "a b"), (1, "a b"), (None, "a b")]), A, B).collect()
    assert len(got) == 3 and {tuple(r)[1:6] for r in got} == {(2, 2, 2, 2, 2)} and {r.count_sum for r in got} == {6}
