"""Scores in the tasks that hold the rows: what leaves a task, ties, groups, and the same rows as by joins."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import index as I
from evidentia.operators import joins
from evidentia.operators import rank as R
from evidentia.operators import scoring as S


@pytest.fixture(scope="module")
def grouped(spark):
    rng = random.Random(8)
    pick = lambda n: " ".join(f"w{min(int(rng.expovariate(0.05)), 150)}" for _ in range(n))
    texts = [pick(rng.randrange(0, 60)) for _ in range(400)]
    # Copies tie; null texts, groups and ids are rows like others.
    rows = [(("a", "b", "c", None)[i % 7 % 4], i if i != 11 else None, None if i % 50 == 49 else texts[i % 300]) for i in range(900)]
    docs = spark.createDataFrame(rows, "g string, doc_id long, text string").repartition(7)
    asked = spark.createDataFrame([(f"q{q}", pick(rng.randrange(1, 12))) for q in range(30)] + [("none", ""), ("far", "nowhere"), ("null", None)], "q string, text string")
    return docs, asked


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("group", [None, "g"])
def test_tasks_find_what_joins_find(grouped, group, monkeypatch, spark, tmp_path):
    docs, asked = grouped
    monkeypatch.setattr(S, "CELLS", 500)
    sent, best = [], R.best_of_tasks
    monkeypatch.setattr(R, "best_of_tasks", lambda found, *a: sent.append(found) or best(found, *a))
    got = rows_of(R.bm25(docs, asked, "doc_id", "q", group=group, k=4))
    # No pair of query and document leaves a task but its best.
    of = sent[0].groupBy(F.spark_partition_id(), *([group] if group else []), "_q").count()
    assert of.agg(F.max("count")).first()[0] <= 4
    index = I.build(docs, "doc_id", str(tmp_path / "i"), group=group, bucket=8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # buckets end anywhere in a batch
    try:
        assert rows_of(I.search(index, asked, "q", k=4)) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(sent) == 2
    monkeypatch.setattr(R, "ASKED", 0)
    assert rows_of(R.bm25(docs, asked, "doc_id", "q", group=group, k=4)) == got
    assert rows_of(I.search(index, asked, "q", k=4)) == got
    assert len(sent) == 2 and len(got) > 100


def test_repeated_ids_count_as_by_joins(spark, tmp_path, monkeypatch):
    rows = [(1, "a b c"), (1, "a b c"), (1, "a"), (2, "b c d e"), (3, "x"), (4, "y z"), (5, "c c")]
    docs, asked = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(1, "a b c"), (2, "x c")], "q int, text string")
    got = rows_of(R.bm25(docs, asked, "doc_id", "q", k=9))
    monkeypatch.setattr(R, "ASKED", 0)
    assert rows_of(R.bm25(docs, asked, "doc_id", "q", k=9)) == got
    assert len(got) == 7  # documents 1, 2, 5 and 1, 2, 3, 5


def test_empty_tables(spark, grouped, tmp_path):
    docs, asked = grouped
    for d, q in ((docs.limit(0), asked), (docs, asked.limit(0))):
        for n, group in enumerate((None, "g")):
            assert R.bm25(d, q, "doc_id", "q", group=group).count() == 0
            assert I.search(I.build(d, "doc_id", str(tmp_path / f"{d.isEmpty()}{n}"), group=group), q, "q").count() == 0


@pytest.mark.parametrize("unit", [False, True])
def test_vectors_meet_in_tasks_as_in_joins(spark, unit, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-1.0, 0.5, rng.gauss(0, 1))) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(60)]  # copies tie
    rows += [(2000, None), (2001, [1.0]), (2002, [float("nan")] * 6), (2003, [0.0] * 6), (2004, [None] * 6), (2100, [1.0, None] * 3), (2200, [0.0] * 6), (2300, None)]
    e = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    q = e.where("id % 100 = 0").withColumnRenamed("id", "q")
    ask = lambda: rows_of(R.dense_top_k(e, q, "id", "q", "v", 4, unit=unit))
    sent, best = [], R.best_of_tasks
    monkeypatch.setattr(R, "best_of_tasks", lambda found, *a: sent.append(found) or best(found, *a))
    monkeypatch.setattr(R, "PAIRS", 250)
    monkeypatch.setattr(S, "CELLS", 300)
    got = ask()
    assert sent[0].rdd.getNumPartitions() > 8 and sent[0].groupBy(F.spark_partition_id(), "_q").count().agg(F.max("count")).first()[0] <= 4
    monkeypatch.setattr(R, "VECTORS", 4)
    assert ask() == got
    monkeypatch.setattr(R, "whole_ids", lambda *a: False)
    assert ask() == got and len(got) == 9 * 4
    assert R.dense_top_k(e.limit(0), q, "id", "q", "v", 4).count() == R.dense_top_k(e, q.limit(0), "id", "q", "v", 4).count() == 0


def test_first_match_leaves_the_left_rows_where_they_are(spark):
    rows = [(i, ("x", "y", None)[i % 97 % 3], f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "i long, key string, text string").repartition(6)
    right = df.select("key", F.col("i").alias("j"), F.col("text").alias("first"))
    got = joins.first_match(df, right, "key", [F.asc("j")])
    assert {(r.key, r.j, r.first) for r in got.collect()} == {("x", 0, "t0"), ("y", 1, "t1")}
    assert got.count() == sum(k is not None for _, k, _ in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(key" not in plan
    assert joins.first_match(df, right.where("key = 'x'"), "key", [F.asc("j")], "left").count() == 500
