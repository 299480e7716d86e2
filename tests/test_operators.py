"""Operators on hand-worked cases and against brute force."""

import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions.scorers import embed_once, meteor_score, with_model
from evidentia.operators import datasets, dedup, metrics, rank, setops
from evidentia.plans.catalogue import QUERIES


def test_partitions(spark):
    of = lambda n, p, f: [r.c for r in spark.range(n).groupBy(f(F.col("id"), n, p).alias("p")).agg(F.count("*").alias("c")).orderBy("p").collect()]
    assert of(10, 4, rank.range_part) == [3, 3, 3, 1]
    assert of(8, 4, rank.range_part) == [3, 3, 2]
    assert of(8, 4, rank.exact_part) == [2, 2, 2, 2]


def test_ordinal_without_a_group(spark):
    got = rank.ordinal(spark.range(1000).withColumn("k", F.hash("id")), [F.asc("k"), F.asc("id")], "o").orderBy("k", "id").collect()
    assert [r.o for r in got] == list(range(1000))
    assert rank.ordinal(spark.range(0), [F.asc("id")], "o").count() == 0


def test_majority_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate((2, 1, 1, 2))], "g int, o int, x int")
    assert metrics.majority(rows, ["g"], "x", "o").first().x == 2


@pytest.mark.parametrize(("total", "answered", "nothing", "done"), [(5, 5, 1, True), (5, 4, 0, False), (5, 5, 2, False), (5, 0, 0, False)])
def test_completeness(spark, total, answered, nothing, done):
    assert spark.range(1).select(metrics.completeness(F.lit(total), F.lit(answered), F.lit(nothing)).alias("x")).first().x is done


def test_verdict_fold(spark):
    s, r, n, c = metrics.VERDICTS
    cases = [([s], s), ([r], r), ([s, r], c), ([s, n], n), ([c], n)]
    rows = spark.createDataFrame([(i, x) for i, (xs, _) in enumerate(cases) for x in xs], "g int, x string")
    assert [v.verdict for v in metrics.verdict_fold(rows, ["g"], "x").orderBy("g").collect()] == [v for _, v in cases]


def test_threshold_is_strict(spark):
    rows = spark.createDataFrame([(0.25, True)], "u double, ok boolean")
    assert [r.score for r in metrics.thresholded(rows, "u", F.col("ok")).orderBy("level").collect()] == [1, 1, 0, 0, 0, 0]


def test_matching_against_brute_force():
    rng = np.random.default_rng(3)
    assert metrics.assign(np.zeros((0, 3))) == []
    for shape in ((2, 2), (3, 5), (5, 3), (1, 4), (4, 4)):
        for _ in range(30):
            w = rng.integers(0, 9, shape) / 8
            got = sum(w[i, j] for i, j in metrics.assign(w))
            flip = w.T if shape[0] > shape[1] else w
            best = max(sum(flip[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(flip.shape[1]), flip.shape[0]))
            assert math.isclose(got, best)


def test_matching_utility(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.8), (1, 1, 1, 0.1)], "g int, p int, y int, s double")
    assert metrics.matching_utility(rows, "g", "p", "y", "s").first().utility == 0.8


def test_greedy_cosine(spark):
    at = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    items = spark.createDataFrame([([(i, at(d)) for i, d in enumerate((0, 30, 90))],)], "x array<struct<i:int,v:array<double>>>")
    assert [r.i for r in items.select(dedup.greedy(F.col("x"), 0.6).alias("k")).first().k] == [0, 2]
    sizes = spark.createDataFrame([(n,) for n in (5, 6, 9, 10)], "n int")
    assert [r.t for r in sizes.select(dedup.threshold_by_size(F.col("n")).alias("t")).collect()] == [None, 0.8, 0.8, 0.5]


def test_packing(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6]), (2, [7, 8]), (3, [])], "k int, t array<int>")
    assert [(r.block, r.tokens) for r in datasets.pack(rows, "t", "k", 4).collect()] == [(0, [1, 2, 3, 4])]
    assert datasets.pack(rows.limit(0), "t", "k", 4).count() == 0


def test_buckets_and_ranks(spark):
    rows = spark.createDataFrame(list(enumerate((5, 1, 3, 2, 4))), "k int, n int")
    got = datasets.length_batches(rows, "n", "k", 2).orderBy("n").collect()
    assert [(r.k, r.batch_id) for r in got] == [(1, 0), (3, 0), (2, 1), (4, 1)]
    five = spark.range(5).select(F.col("id").alias("batch_id"))
    assert sorted((r.rank, r.batch_id) for r in datasets.rank_batches(five, 2).collect()) == [(0, 0), (0, 2), (1, 1), (1, 3)]


def test_neutral_gate(spark):
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate((0.9, 0.7, 0.5))], "g int, i int, p double")
    assert rank.gate_neutral(rows, ["g"], "p", [F.desc("p"), F.asc("i")]).first().accepted is False


def test_best_supported(spark):
    one = lambda i, probs, labels: F.struct(F.lit(i).alias("index"), F.array(*map(F.lit, probs)).alias("probs"), F.array(*map(F.lit, labels)).alias("labels"))
    got = spark.range(1).select(rank.best_supported(F.array(one(0, (0.2, 0.9, 0.1), (1, 2, 0)), one(1, (0.45, 0.4, 0.3), (1, 1, 1)))).alias("b")).first().b
    assert (got["index"], got["chunk"]) == (0, 1)


def test_meteor():
    assert meteor_score(["a"], ["b"]) == 0
    assert math.isclose(meteor_score(["a", "b"], ["a", "b"]), 1 - 0.5 * (1 / 2) ** 3)


def test_meteor_scores_whole_texts(spark, tmp_path):
    spark.createDataFrame([(0, "c d")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, "a b\nc d", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["meteor_exact"](spark, str(tmp_path)).first().score
    assert math.isclose(got, round(meteor_score(["a", "b", "c", "d"], ["c", "d"]), 6))
    assert got > 0


def test_set_operations(spark):
    a = spark.range(5)
    assert setops.missing_ids(a, "id", 7).count() == 2
    assert setops.difference(a, a).count() == 0


def test_models_keep_errors_apart(spark):
    def load():
        def model(x):
            if (x["id"] == 3).any():
                raise ValueError("no")
            return x["id"] * 2.0

        return model

    got = with_model(spark.range(0, 6, 1, 6), load, ["id"], "y", "double", attempts=2, pause=0.01).orderBy("id").collect()
    assert [r.y for r in got] == [0.0, 2.0, 4.0, None, 8.0, 10.0]
    assert got[3].y_error == "no"


def test_embedding_sees_each_text_once(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    got = embed_once(rows, "t", lambda x: x.withColumn("vector", F.array(F.length("text").cast("double"))))
    assert got.count() == 3


def test_registry(spark, tmp_path):
    plugin = tmp_path / "own.py"
    plugin.write_text("def rows(spark, path):\n    return spark.range(3)\n")
    assert datasets.load(spark, f"{plugin}:rows", "x").count() == 3
    with pytest.raises(ValueError, match="no dataset"):
        datasets.load(spark, "unknown", "x")


def test_meteor_matches_stems():
    assert meteor_score(["walks"], ["walking"]) == meteor_score(["a"], ["a"])
    assert meteor_score(["walks", "walk"], ["walk"]) > meteor_score(["talks", "walk"], ["talk", "x"])


def test_pdf_text():
    from evidentia.sources.readers import simple_pdf_text

    page = rb"BT /F1 12 Tf 72 700 Td (First \(line\)) Tj T* [(Sec) -20 (ond)] TJ ET"
    plain, packed = (b"%PDF-1.4\n4 0 obj\n<< /Length 9 >>\nstream\n" + x + b"\nendstream\nendobj" for x in (page, zlib.compress(page)))
    assert simple_pdf_text(plain) == simple_pdf_text(packed) == "First (line)\nSecond"
    assert simple_pdf_text(b"") == ""


def test_pdf_files(spark, tmp_path):
    from evidentia.sources.readers import pdf_texts

    (tmp_path / "a.pdf").write_bytes(b"stream\nBT (x y) Tj ET\nendstream")
    (tmp_path / "b.txt").write_bytes(b"no")
    assert [r.text for r in pdf_texts(spark, str(tmp_path)).collect()] == ["x y"]


def test_run_log(tmp_path):
    from evidentia.sources.sinks import run_log

    run_log("test", str(tmp_path / "log")).info("began")
    assert "began" in (tmp_path / "log").read_text()


def test_large_documents_are_refused(spark, tmp_path):
    from evidentia.sources.sinks import json_document

    with pytest.raises(ValueError, match="more than 2 rows"):
        json_document(spark.range(3), str(tmp_path / "x"), limit=2)


def test_blocks_of_a_stated_set(spark):
    few = spark.range(25)
    assert [p.count() for p in rank.blocks(few, "id", 100)] == [25]
    assert sorted(r.id for p in rank.blocks(few, "id", 10) for r in p.collect()) == list(range(25))
