import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentia.llm import sessions as S

MINUTE = 60_000_000
DDL = "click_id long, client_id long, ts timestamp_ntz, arrived_at timestamp_ntz, fin boolean, amount double, id int, t int, cell int, late int, client int, start int"
ZERO = datetime(2024, 1, 31, 23, 0)


def when(us):
    return None if us is None else ZERO + timedelta(microseconds=us)


def plain(rows, gap=15 * MINUTE, span=60 * MINUTE, late=15 * MINUTE):
    """Sessions of (id, client, us, arrived us, final, amount), client by client."""
    seen, base, out = {}, int((ZERO - datetime(1970, 1, 1)).total_seconds()) * 10**6, []
    for r in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[0], r[3] is not None, r[3] or 0)):
        seen.setdefault(r[0], r)
    for client in {r[1] for r in seen.values()}:
        mine = sorted((r for r in seen.values() if r[1] == client), key=lambda r: (r[2], r[0]))
        timely = [r for r in mine if r[3] is None or r[3] - r[2] <= late]
        sessions = []
        for r in timely:
            if sessions:
                last = sessions[-1]["rows"][-1]
                why = "end" if last[4] else "gap" if r[2] - last[2] >= gap else "length" if r[2] - sessions[-1]["rows"][0][2] > span else None
                if not why:
                    sessions[-1]["rows"].append(r)
                    continue
                sessions[-1]["by"] = why
            sessions.append({"rows": [r], "by": None, "late": 0})
        for r in mine:
            if r not in timely:
                into = [s for s in sessions if s["rows"][0][2] <= r[2]]
                if into:
                    into[-1]["late"] += 1
        for s in sessions:
            w = s["rows"]
            out.append((client, w[0][0], base + w[0][2], base + w[-1][2], len(w), s["late"], sum(int(r[5] or 0) for r in w), s["by"] or ("end" if w[-1][4] else "none"), tuple(r[0] for r in w)))
    return sorted(out)


def run(spark, rows, **limits):
    df = spark.createDataFrame([(i, c, when(t), when(a), f, v, *[3] * 6) for i, c, t, a, f, v in rows], DDL)
    got = S.sessionise(df, F.col("fin"), F.col("amount"), **limits).collect()
    return sorted((*r[:8], tuple(r.ids)) for r in got)


def clicks(rng, n, clients, mean, finals=0.05, late=0.05, step=1):
    at, rows = [rng.randrange(10 * MINUTE) for _ in range(clients)], []
    for i in range(n):
        c = min(int(rng.expovariate(1.5)), clients - 1)
        if rng.random() > 0.1:  # else a tie
            at[c] += int(rng.expovariate(1 / mean)) // step * step
        arrived = at[c] + (rng.randrange(20 * MINUTE, 90 * MINUTE) if rng.random() < late else rng.randrange(15 * MINUTE + 1))
        rows.append((i, c, at[c], arrived, rng.choice([True, None]) if rng.random() < 2 * finals else False, rng.choice([None, 5.0, 7.0])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("mean, finals", [(2, 0.0), (4, 0.03), (0.2, 0.0)])
def test_against_one_client_after_the_other(spark, mean, finals):
    rng = random.Random(int(mean * 10))
    rows = clicks(rng, 3000, 5, mean * MINUTE, finals)
    rows += rng.sample(rows, 100) + [(None, 1, 5, 5, False, 1.0), (10**6, None, 5, 5, False, 1.0), (10**6 + 1, 1, None, 5, False, 1.0), (10**6 + 2, 1, 7, None, False, 1.0)]
    assert run(spark, rows) == plain(rows)


def test_exact_limits(spark):
    """Whole quarters of an hour: gaps and lengths that are just met."""
    rng = random.Random(8)
    rows = clicks(rng, 1500, 40, 9 * MINUTE, step=5 * MINUTE)
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, gap=7 * MINUTE, span=7 * MINUTE, late=0) == plain(rows, 7 * MINUTE, 7 * MINUTE, 0)


def test_long_chain(spark):
    """A client without a break for 20 days: pointers are doubled again and again."""
    rows = [(i, 1, i * 4 * MINUTE + i % 7, i * 4 * MINUTE + i % 7, False, 1.0) for i in range(7200)]
    got = run(spark, rows)
    assert got == plain(rows)
    assert len(got) > 400


def test_repeated_ids_take_the_first_arrival(spark):
    rows = [(1, 1, 0, 20 * MINUTE, False, 1.0), (1, 1, 0, 1, True, 2.0), (2, 1, 5, 6, False, 3.0)]
    assert run(spark, rows) == plain(rows)


def test_only_late_clicks_and_empty_tables(spark):
    assert run(spark, [(1, 1, 0, 16 * MINUTE, False, 1.0)]) == []
    assert run(spark, []) == []


def test_times_with_a_zone(spark):
    df = spark.createDataFrame([(1, 1, datetime(2024, 1, 1), None)], "click_id long, client_id long, ts timestamp, arrived_at timestamp")
    assert S.sessionise(df, F.lit(False), F.lit(1)).first().n == 1


def test_the_length_is_no_less_than_the_gap(spark):
    with pytest.raises(ValueError):
        S.sessionise(spark.createDataFrame([], DDL), F.col("fin"), F.col("amount"), gap=2, span=1)
