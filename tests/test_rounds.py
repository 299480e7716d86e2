"""Rounds as state: the same evidence whatever the order and the batches."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import evidence as E
from evidentia.plans import evidence
from evidentia.streaming import rounds as S


def answers(seed, claims=12, last=3):
    rng = random.Random(seed)
    rows = []
    for c in range(claims):
        good = rng.random()
        for r in range(1, last + 1):
            n = rng.randrange(1, 6)
            for q in range(n):
                a = None if rng.random() > good else "Sorry, no information" if rng.random() < 0.2 else f"answer {c} {r} {q}"
                rows.append((c, r, q, f"question {c} {r} {q}", a, ["u", "v"], rng.choice([None, 0, 1]), n))
    return rows


DDL = "claim_id long, round int, q_idx int, question string, answer string, urls array<string>, chunk_idx int, expected int"


def batch(spark, rows, last=3):
    """The batch operators on whole rounds."""
    of = [spark.createDataFrame([r for r in rows if r[1] == k], DDL) for k in range(1, last + 1)]
    done = None
    for k, df in enumerate(of, 1):
        here = E.next_round(df).where("complete").select("claim_id", F.lit(k).alias("round"))
        done = here if done is None else done.unionByName(here)
    finished = done.groupBy("claim_id").agg(F.min("round").alias("round"))
    never = spark.createDataFrame(rows, DDL).select("claim_id").distinct().join(finished, "claim_id", "left_anti")
    got = E.combine_adaptive(of, finished).unionByName(E.recycle(of, never))
    return sorted((r.claim_id, r.round, r.q_idx, r.question, r.answer, r.url) for r in got.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_batch_rows(spark, seed):
    rows = answers(seed)
    want = batch(spark, rows)
    flat = S.prepared(spark.createDataFrame(rows, DDL)).collect()
    rng = random.Random(seed)
    for _ in range(20):
        rng.shuffle(flat)
        claims, out, done = {}, [], set()
        for r in [*flat, *rng.sample(flat, 10)]:  # some come again
            if r.claim_id in done:
                continue
            claim = claims.setdefault(r.claim_id, S.Claim(3))
            claim.add(r["round"], r.q_idx, r.question, r.answer, r.url, r.answered, r.nothing, r.expected)
            claim = claims[r.claim_id] = S.Claim(3, claim.saved())
            if got := claim.finished():
                out += [(r.claim_id, *x) for x in got]
                done.add(r.claim_id)
        assert sorted(out) == want


@pytest.mark.parametrize("files", [1, 3])
def test_the_stream_gives_the_batch_rows(spark, tmp_path, files):
    rows = answers(3)
    S.prepared(spark.createDataFrame(rows + rows[:7], DDL)).repartition(files).write.parquet(f"{tmp_path}/a")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/a").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/a")
    q = S.evidence_by_rounds(stream, 3).writeStream.format("parquet").option("path", f"{tmp_path}/e").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.schema(S.EVIDENCE).parquet(f"{tmp_path}/e").collect())) == batch(spark, rows)


def test_windowed_counts_on_a_stream(spark, tmp_path):
    """The batch rows, but for events that come later than the watermark allows."""
    from evidentia.streaming.ingest import windowed_counts

    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", k, float(m)) for h in range(4) for m in (5, 20, 50) for k in ("a", "b")]
    events = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    late = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        windowed_counts(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    run()
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = {(r.window_start, r.event_type): (r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.window_start, r.event_type): (r.n, r.total) for r in windowed_counts(events).collect()}
    last = max(w for w, _ in want)
    assert got == {k: v for k, v in want.items() if k[0] != last}  # the last hour is still open


def test_files_of_answers_grow_with_the_cores(spark, tmp_path, monkeypatch):
    """Each of three batches gives work to all cores, whatever their number."""
    monkeypatch.setattr(evidence, "shared_folder", lambda s: str(tmp_path / "shared"))
    evidence.rounds_in_state(spark, "/root/testdata/sf0.001").count()
    files = list((tmp_path / "shared" / "answers").glob("part-*.parquet"))
    assert len(files) == 3 * spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "shared" / "state" / "commits").glob("[0-9]*"))) == 3
