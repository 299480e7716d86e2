"""BM25 with and without an index, substrings by their rarest piece, percentiles by selection."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import index as I
from evidentia.operators import metrics as M
from evidentia.operators import rank as R
from evidentia.operators.substrings import holding

WORDS = [f"w{i}" for i in range(200)]


def plain_bm25(docs, queries, k):
    """Okapi BM25, pair by pair."""
    tf = {i: Counter(t.split()) for i, t in docs}
    n, mean = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = []
    for q, text in queries:
        scores = []
        for i, c in tf.items():
            s = sum(t * (idf[w] if idf[w] >= 0 else floor) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, t in Counter(text.split()).items() if w in c)
            if any(w in c for w in text.split()):
                scores.append((-round(s, 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    pick = lambda n: " ".join(WORDS[min(int(rng.expovariate(0.04)), 199)] for _ in range(n))
    docs = [(i, pick(rng.randrange(1, 80))) for i in range(1500)]
    queries = [(q, pick(rng.randrange(1, 9))) for q in range(25)] + [(98, ""), (99, "nowhere")]
    return docs, queries, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "q long, text string")


def same(got, want):
    assert [(*r[:2], r[3]) for r in got] == [(*r[:2], r[3]) for r in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))


def test_bm25_against_all_pairs(corpus):
    docs, queries, d, q = corpus
    same(sorted(map(tuple, R.bm25(d, q, "doc_id", "q", k=7).select("q", "doc_id", "score", "rank").collect())), plain_bm25(docs, queries, 7))


@pytest.mark.parametrize("k, bucket", [(1, 16), (7, 16), (40, 100), (7, 10**6)])
def test_index_gives_the_same_ranks(spark, corpus, tmp_path, k, bucket):
    docs, queries, d, q = corpus
    index = I.build(d, "doc_id", str(tmp_path / "i"), bucket=bucket)
    same(sorted(map(tuple, I.search(index, q, "q", k=k).select("q", "doc_id", "score", "rank").collect())), plain_bm25(docs, queries, k))
    again = I.load(spark, str(tmp_path / "i"), "doc_id")
    one = q.where("q = 3")
    assert I.search(again, one, "q", k=k).count() == len([r for r in plain_bm25(docs, queries, k) if r[0] == 3])


def test_index_leaves_buckets_out(spark, corpus, tmp_path):
    """Rare words have short blocks elsewhere: most buckets are never opened."""
    _, _, d, _ = corpus
    rare = d.withColumn("text", F.when(F.col("doc_id") % 100 == 7, F.concat_ws(" ", "text", F.lit("needle needle needle"))).otherwise(F.col("text")))
    index = I.build(rare, "doc_id", str(tmp_path / "i"), bucket=8)
    q = spark.createDataFrame([(1, "needle w0 w1")], "q long, text string")
    wanted = index.weights.join(R.asked_terms(q, "q", "text", []), "_term")
    every = I.bounds(index, wanted)
    top = I.search(index, q, "q", k=5).collect()
    assert all(r.doc_id % 100 == 7 for r in top)
    least = min(r.score for r in top)
    assert every.where(F.col("_bound") >= least - 1e-5).count() < 0.3 * every.count()


def test_documents_are_read_once(spark, corpus, tmp_path):
    """What is left to do reads tables made from one scan; only a term of more than half of all documents
    asks for the vocabulary."""
    _, _, d, _ = corpus
    d.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    reads = lambda q: any(str(tmp_path / "d") in f for f in R.bm25(stored, spark.createDataFrame([(1, q)], "q long, text string"), "doc_id", "q").inputFiles())
    assert not reads("w150 w60")
    assert reads("w0")


def test_ranked_over_a_hot_group(spark):
    rows = [(0 if i % 10 else 1, i * 7919 % 1000 / 10, i) for i in range(1000)] + [(5, 1.0, 1)]
    df = spark.createDataFrame(rows, "g long, s double, i long")
    got = sorted(map(tuple, R.ranked(df, ["g"], [F.desc("s"), F.asc("i")]).select("g", "i", "rank").collect()))
    want = []
    for g in (0, 1, 5):
        want += [(g, r[2], k + 1) for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])))]
    assert got == sorted(want)
    assert R.ranked(df.limit(0), ["g"], [F.asc("i")]).count() == 0


def test_substrings_against_all_pairs(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(120))) for _ in range(150)] + [None, "", "x" * 3_000_000 + "needle in it" + "x" * 1_500_000]
    strings = ["", "a", "é", "ab", "b a", "needle in it", "zzz", "x" * 50, None, "ab", "not there at all"] + [t[5 : 5 + rng.randrange(1, 40)] for t in texts[:60] if t and len(t) > 10]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("extra", F.array(F.lit(1)))
    s = spark.createDataFrame(list(enumerate(strings)), "item long, claim string")
    got = sorted((r.id, r["item"]) for r in holding(t, s, "text", "claim").collect())
    assert got == sorted((i, k) for i, x in enumerate(texts) for k, y in enumerate(strings) if x is not None and y is not None and y in x)
    assert holding(t, s.limit(0), "text", "claim").count() == 0
    assert holding(t.limit(0), s, "text", "claim").count() == 0


def test_substring_plan_has_no_nested_loop(spark):
    t = spark.createDataFrame([(1, "some text here")], "id long, text string")
    s = spark.createDataFrame([(1, "text here")], "item long, claim string")
    plan = holding(t, s, "text", "claim")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 1000, [float(i * 7919 % 1009) for i in range(1009)], [1.0] * 700 + [float(i) for i in range(300)] + [None] * 50, []])
def test_percentiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = (0.0, 0.1, 0.5, 0.75, 0.999, 1.0)
    got = M.percentiles(df, "v", shares)
    kept = [v for v in values if v is not None]
    if not kept:
        assert got == [None] * len(shares)
        assert M.describe(df, "v").first()["count"] == 0
    else:
        assert np.allclose(got, np.percentile(kept, [100 * s for s in shares]))


@pytest.mark.parametrize("unit", [False, True])
def test_quantised_ranking_finds_the_nearest(spark, unit):
    """Recall of the five nearest against all pairs: 0.95 at least."""
    from evidentia.operators import quantised as Q

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(30, size=4000)] + 0.6 * rng.normal(size=(4000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [1.0])]
    e = spark.createDataFrame(rows, "id long, v array<double>")
    q = e.where("id % 100 = 0").withColumnRenamed("id", "q")
    got = Q.dense_top_k(e, q, "id", "q", "v", 5, unit=unit, sample=1000).collect()
    y = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x
    score = y[::100] @ y.T
    score[np.arange(40), np.arange(40) * 100] = -np.inf
    want = {(100 * i, int(j)) for i, row in enumerate(score) for j in np.argsort(-row)[:5]}
    found = {(r.q, r.id) for r in got}
    assert len(got) == len(want) == 200
    assert len(found & want) >= 0.95 * len(want)
    assert all(abs(r.score - score[r.q // 100, r.id]) < 1e-5 for r in got)
    assert Q.dense_top_k(e.limit(0), q, "id", "q", "v", 5).count() == 0
    assert Q.dense_top_k(e, q.limit(0), "id", "q", "v", 5).count() == 0


def test_a_group_keeps_the_terms_of_its_own_queries(spark, monkeypatch):
    docs = spark.createDataFrame([(0, 1, "a b c d"), (0, 2, "c d"), (1, 3, "a b c"), (1, 4, None), (2, 5, "a"), (3, 6, "x y"), (None, 7, "a")], "g int, doc_id long, text string")
    asked = spark.createDataFrame([(0, 0, "a b"), (1, 1, "c"), (2, 2, ""), (3, 3, None)], "g int, q long, text string")
    seen, hits = [], R.bm25_hits
    monkeypatch.setattr(R, "bm25_hits", lambda *a: seen.append(hits(*a)) or seen[-1])
    got = R.bm25(docs, asked, "doc_id", "q", group="g", k=None, full=True).collect()
    assert sorted((r.g, r.doc_id) for r in got) == [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (3, 6)]
    assert {(r.g, r._term) for r in seen[0].collect()} == {(0, "a"), (0, "b"), (1, "c"), (0, ""), (1, ""), (2, ""), (3, "")}
