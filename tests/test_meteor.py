"""Porter's stems, and alignments against an exhaustive search."""

import random
import time
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from evidentia.functions import meteor as M
from evidentia.operators import dedup


def test_stems_of_the_published_examples():
    pairs = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
    conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
    relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile
    analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
    sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
    revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
    dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
    probate probat rate rate cease ceas controll control roll roll is is été été""".split()
    assert {a: M.stem(a) for a in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))


def exhaustive(left, right):
    best = (0, 0)

    def go(i, used, last, n, chunks):
        nonlocal best
        if i == len(left):
            if (n, -chunks) > (best[0], -best[1]):
                best = (n, chunks)
            return
        go(i + 1, used, -2, n, chunks)
        for j, w in enumerate(right):
            if w == left[i] and j not in used:
                go(i + 1, used | {j}, j, n + 1, chunks + (j != last + 1))

    go(0, frozenset(), -2, 0, 0)
    return best


def test_alignments_have_the_fewest_chunks():
    rng = random.Random(7)
    for _ in range(400):
        left, right = ([rng.choice("abcd") for _ in range(rng.randrange(8))] for _ in range(2))
        assert M.aligned(left, right) == exhaustive(left, right)
    for p in permutations("abcde"):
        assert M.aligned(list("abcde"), list(p)) == exhaustive(list("abcde"), list(p))


def test_the_first_match_is_not_always_the_best():
    left, right = "the cat the dog".split(), "the dog saw the cat".split()
    assert M.aligned(left, right) == (4, 2)


def test_long_lists():
    rng = random.Random(8)
    words = [rng.choice("the of a in to be".split()) if rng.random() < 0.4 else f"w{i}" for i in range(2000)]
    assert M.aligned(words, words) == (2000, 1)
    assert M.aligned([], ["a"]) == M.aligned(["a"], []) == (0, 0)


def test_short_claims_in_long_texts_are_exact():
    """By a second search without the short cuts: the claim falls into the longest runs that the text has."""
    rng = random.Random(11)
    for _ in range(200):
        claim = [f"w{i}" for i in rng.sample(range(60), 12)]
        text = [f"w{rng.randrange(60)}" for _ in range(400)]
        for at in range(0, 400, 40):
            begin = rng.randrange(9)
            text[at : at + 4] = claim[begin : begin + 4]
        have, chunks, i = set(text), 0, 0
        lines = " " + " ".join(text) + " "
        found = [w for w in claim if w in have]
        while i < len(claim):
            n = 1
            while i + n < len(claim) and " " + " ".join(claim[i : i + n + 1]) + " " in lines:
                n += 1
            chunks, i = chunks + (claim[i] in have), i + n
        assert M.aligned(text, claim) == M.aligned(claim, text) == (len(found), chunks)


def test_long_texts_take_one_pass():
    words = "the cat sat on the mat and the dog sat on the cat".split()
    text = [w for i in range(40_000) for w in (words[i % 13], words[i * i % 11])]
    begun = time.perf_counter()
    assert M.aligned(text, words)[0] == len(words)
    assert time.perf_counter() - begun < 3


def test_words_that_begin_otherwise_are_not_stemmed():
    left, right = "happy ponies ays ies going xylem ties".split(), "happi poni ai i".split()
    a, b = M.stemmed(left, right)
    assert a == ["happi", "poni", "ai", "i", None, None, None] and b == [M.stem(w) for w in right]
    assert M.stemmed(right, left) == (b, a)


@pytest.mark.parametrize("threshold", [0.1, 0.8])
def test_long_lists_are_filtered_as_short_ones(spark, threshold):
    rng = random.Random(9)
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(300)]
    rows = [(i % 7 and 1, i, rng.choice(vectors) if rng.random() < 0.3 else [rng.gauss(0, 1) for _ in range(6)]) for i in range(900)]
    rows += [(2, 0, None), (2, 1, [1.0] * 6), (3, 0, [1.0] * 6), (3, 1, None), (3, 2, [0.0] * 6), (4, 5, [2.0] * 6)]
    df = spark.createDataFrame(rows, "g int, i long, v array<double>")
    want = set()
    lists = df.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
    for r in lists.select("g", dedup.greedy(F.col("x"), threshold).alias("k")).collect():
        want |= {(r.g, x.i) for x in r.k}
    got = dedup.greedy_rows(df, ["g"], "i", "v", threshold, rows=64).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert dedup.greedy_rows(df.limit(0), ["g"], "i", "v", threshold).count() == 0


def test_sequential_policy_against_a_loop(spark):
    rng = random.Random(10)

    def keep(items, limit):
        out = []
        for v in items:
            if all(round(sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) ** 0.5 * sum(b * b for b in w) ** 0.5), 6) < limit for w in out):
                out.append(v)
        return out

    for n in (0, 1, 5, 6, 9, 10, 14):
        items = [[rng.gauss(0.6, 1) for _ in range(4)] for _ in range(n)]
        once = keep(items, 0.5 if n >= 10 else 0.8) if n >= 6 else items
        strict = keep(items, 0.5) if n >= 10 else items
        twice = keep(strict, 0.8) if 6 <= len(strict) <= 9 else strict
        df = spark.createDataFrame([([(i, v) for i, v in enumerate(items)],)], "x array<struct<i:int,v:array<double>>>")
        got = df.select(dedup.by_policy(F.col("x")).alias("a"), dedup.by_policy(F.col("x"), again=True).alias("b")).first()
        assert [x.v for x in got.a] == once
        assert [x.v for x in got.b] == twice
