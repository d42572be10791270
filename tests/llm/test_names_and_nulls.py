"""Columns whose names clash with those used inside, hot null ids and repeated ids, and the walk that is never a scan."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from millrace.llm import ann, bpe, line_dedup, substring_dedup  # noqa: E402

NAMES = ["id_", "drops_", "sum_", "sum_2", "chunks_", "sizes_", "texts_", "digests_", "k_", "c0", "c1", "of_", "left_", "digest_", "salt", "block_"]


def clashing(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES})


def test_lines_with_clashing_names(spark):
    shared = "\n".join(f"line {i}" for i in range(12))
    rows = [(1, shared), (2, shared), (3, None), (4, "x")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(clashing(spark, rows).withColumns({"n_lines": F.lit("old"), "n_removed": F.lit("old")})).collect()}
    plain = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((got[i].text, got[i].n_lines, got[i].n_removed) == (plain[i].text, plain[i].n_lines, plain[i].n_removed) for i in plain) and got[2].n_removed > 0
    assert all(getattr(got[i], c) == f"{c}{i}" for i in got for c in NAMES)


def test_long_texts_lose_their_chunks(spark):
    """Twenty thousand lines, nearly all of them repeated."""
    text = "\n".join(f"line {i * 7919 % 20011}" for i in range(20000))
    got = {r.doc_id: (r.n, r.c) for r in line_dedup.line_dedup(spark.createDataFrame([(1, text), (2, text + "\nend")], "doc_id long, text string")).select("doc_id", F.col("n_removed").alias("n"), F.length("text").alias("c")).collect()}
    assert got[1] == (0, len(text)) and got[2][0] > 19990


def test_substrings_of_hot_ids(spark):
    """A third of the rows without an id, a third of one id: rows without one take no part, rows of one id are one document wherever they lie."""
    words = lambda k: " ".join(f"w{(k * 7 + j) % 90}" for j in range(30))
    rows = [(None, f"{words(i)}\t x") for i in range(60)] + [(7, words(i)) for i in range(60)] + [(100 + i, words(i)) for i in range(60)] + [(3, words(0)), (None, None)]
    got = substring_dedup.substring_dedup(clashing(spark, rows), block_bytes=300)
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)

    def want(i, t):
        w = (t or "").split()
        gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k:k + 13])] < i for j in range(13)}
        return i, len(w), len(gone), t if not gone else " ".join(x for k, x in enumerate(w) if k not in gone)

    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()) == Counter(want(*r) for r in rows)
    joined = substring_dedup.substring_dedup(clashing(spark, rows), join_all=True, block_bytes=300).where("doc_id is null")
    assert Counter(r.text for r in joined.collect()) == Counter(" ".join((t or "").split()) for i, t in rows if i is None)
    blocks = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id = 7").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(40)).alias("b")).groupBy("b").count()
    assert blocks.agg(F.max("count")).first()[0] < 10


def test_the_walk_finds_what_comparing_all_centroids_finds():
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(9000, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = ann.build(unit, 600)
    assert not hasattr(graph, "scan") and graph.links.shape == (600, ann.LINKS + ann.FAR_LINKS)
    for beam, wanted in ((48, 10), (200, 150)):
        found, far = graph.search(unit[:200], beam)
        true = np.argsort(-(unit[:200] @ graph.centroids.T), 1)[:, :wanted]
        assert np.mean([len(set(f[:wanted]) & set(t)) / wanted for f, t in zip(found.tolist(), true.tolist())]) > 0.95
        assert (np.diff(far, axis=1) >= 0).all()


def test_decimals_of_any_size():
    ids = np.array([0, 7, 99_999, 100_000, 1_234_567], np.int32)
    assert bpe.decimal_text(ids) == b"0 7 99999 100000 1234567" and bpe.decimal_text(ids[:0]) == b"" and bpe.decimal_text(ids[:1]) == b"0"
