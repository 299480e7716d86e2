"""Learnt sentence boundaries, packing and chunking in linear time."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import boundaries as B

NAMES = ["Smith", "Brown", "Jones", "Miller", "Davis"]
VERBS = ["went home", "saw the dog", "read a book", "was late", "spoke to them about the U.S. law", "had no. 5 of it"]


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(12)

    def sentence():
        who = f"{rng.choice(['Dr.', 'Prof.', 'Mr.'])} {rng.choice(NAMES)}" if rng.random() < 0.5 else rng.choice(["He", "She", "They"])
        return f"{who} {rng.choice(VERBS)}{rng.choice('...!?')}"

    texts = [" ".join(sentence() for _ in range(40)) for _ in range(60)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


def plain_scores(texts):
    """The published formula, word by word."""
    period, bare = Counter(), Counter()
    for w in " ".join(texts).split():
        core = re.sub(r"^\W+|[^\w.]+$", "", w.lower())
        kind = core.rstrip(".")
        if kind:
            (period if core.endswith(".") else bare)["##number##" if not re.search("[a-z]", kind) else kind] += 1
    n, p = sum(period.values()) + sum(bare.values()), sum(period.values())
    out = {}
    for kind, k in period.items():
        if kind == "##number##":
            continue
        rest, letters = bare[kind], len(kind.replace(".", ""))
        like = lambda q: k * math.log(q) + rest * math.log(1 - q)  # noqa: B023, E731
        score = -2 * (like(p / n) - like(0.99)) * math.exp(-letters) * (kind.count(".") + 1) * letters ** -float(rest)
        if round(score, 6) >= B.ABBREVIATION:
            out[kind] = round(score, 6)
    return out


def test_abbreviations_by_the_formula(prose):
    df, texts = prose
    got = {r.type: r.score for r in B.abbreviations(B.word_types(df)).collect()}
    want = plain_scores(texts)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert {"dr", "prof", "mr", "u.s", "no"} <= got.keys()
    assert not {"home", "dog", "book", "late"} & got.keys()


def test_starters(prose):
    df, _ = prose
    learnt = B.learn(df)
    assert {"he", "she", "they"} <= set(learnt.starters)
    assert not {n.lower() for n in NAMES} & set(learnt.starters)


def test_sentences_go_on_behind_abbreviations(prose, spark):
    df, _ = prose
    learnt = B.learn(df)
    of = lambda x: spark.range(1).select(T.sentences(F.lit(x), learnt).alias("s")).first().s
    assert of("Dr. Smith saw the U.S. law. He went home! Was it no. 5? J. Brown did.") == ["Dr. Smith saw the U.S. law.", "He went home!", "Was it no. 5?", "J. Brown did."]
    assert of("It is in the U.S. He went there.") == ["It is in the U.S.", "He went there."]
    assert of("  One.\n\tTwo.  ") == ["One.", "Two."]
    assert of("") == []
    assert of(None) is None
    assert spark.range(1).select(T.sentences(F.lit("Dr. Smith. It"), B.Boundaries()).alias("s")).first().s == ["Dr.", "Smith.", "It"]


def test_packs_hold_abbreviations_whole(prose, spark):
    learnt = B.learn(prose[0])
    line = "Dr. Smith " + "went home and " * 8 + "slept. He was late. " + "Mr. Brown " * 12
    got = spark.range(1).select(T.pack_sentences(F.lit(line.strip()), boundaries=learnt).alias("p")).first().p
    assert got[0].startswith("Dr. Smith went") and got[0].endswith("slept.")


def test_edges(spark):
    empty = spark.createDataFrame([], "text string")
    assert B.learn(empty) == B.Boundaries()
    odd = spark.createDataFrame([(None,), ("",), ("...",), ("a",), ("1. 2. 3.",)], "text string")
    assert B.learn(odd) == B.Boundaries()


def fold(sizes, limit):
    """The chunker's rule, size by size."""
    out, chunk, run, rest, seen, total = [], 0, 0, False, 0, sum(sizes)
    for i, x in enumerate(sizes):
        if i == 0 or (run > 0 and run + x >= limit and not rest):
            chunk, run, rest = chunk + (i > 0), x, total - seen <= limit
        else:
            run += x
        seen += x
        out.append(chunk)
    return out


def test_chunks_by_pointers_equal_the_fold():
    rng = random.Random(2)
    for _ in range(2000):
        sizes = [rng.choice([0, 0, 1, 3, rng.randrange(30)]) for _ in range(rng.randrange(25))]
        limit = rng.choice([0, 1, 5, 10, 40])
        assert T.budget_chunks(np.array(sizes, dtype=np.int64), limit).tolist() == fold(sizes, limit)


def test_a_million_sentences_in_one_text(spark):
    began = time.perf_counter()
    ids = T.budget_chunks(np.full(1_000_000, 7), 40)
    assert ids[-1] == (1_000_000 - 1) // 5
    packs = T.packs(["A short one."] * 1_000_000, 100, 50)
    assert sum(map(len, packs)) + len(packs) >= 12_900_000
    row = spark.range(1).select(F.expr("array_repeat(7L, 1000000)").alias("s")).select(F.element_at(T.chunk_by_budget(F.col("s"), 40), -1).alias("c")).first()
    assert row.c == ids[-1]
    assert time.perf_counter() - began < 30


def test_packs_equal_the_fold():
    rng = random.Random(3)
    for _ in range(1000):
        parts = ["x" * rng.randrange(1, 60) for _ in range(rng.randrange(12))]
        longer, tail, out, held = rng.choice([5, 20, 100]), rng.choice([0, 10, 50]), [], ""
        for p in parts:
            held = f"{held} {p}" if held else p
            if len(held) > longer:
                out.append(held)
                held = ""
        assert T.packs(parts, longer, tail) == out + [held] * (len(held) > tail)


def test_chunks_of_a_long_document_keep_its_own_id(spark, tmp_path):
    from evidentia.plans import retrieval

    long = "\n".join("word " * 39 + str(i) for i in range(10_050))
    spark.createDataFrame([(0, long, "en", "s", len(long)), (1, "another word here\nand more", "en", "s", 26)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "word here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = retrieval.scored_chunks(spark, str(tmp_path)).select("doc_id", "chunk").collect()
    assert len(got) == len(set(got)) == 10_051
    assert retrieval.best_answer(spark, str(tmp_path)).first().doc_id == 0


def test_token_table_keeps_all_white_space(spark):
    for text in ["a  b", " a\n\tb ", "", "   ", "é 日本"]:
        rows = spark.range(1).select(T.token_table(F.lit(text)).alias("r")).select("r", T.untokenise(F.col("r")).alias("again")).first()
        assert [r.text for r in rows.r] == text.split()
        assert all(text[r.span.begin : r.span.end] == r.text for r in rows.r)
        assert rows.again.strip() == text.strip()


def test_lists_of_any_length_are_joined(prose, spark, monkeypatch):
    """Tables of abbreviations and starters take the place of lists that are too long for a plan."""
    df = prose[0].unionByName(spark.createDataFrame([(1000, None), (1001, ""), (1002, "No end"), (0, "Mr. Smith. He"), (1003, " \n Dr. Ann\tcame. B. She!  They "), (None, "Dr. Ann went.")], df_schema))
    known, starters = B.learn_tables(df)
    lists = B.learn(df)
    assert (sorted(r.type for r in known.collect()), sorted(r.type for r in starters.collect())) == (list(lists.abbreviations), list(lists.starters))
    got = B.going_on(df, "text", known, starters).select("doc_id", T.sentences(F.col("text"), on=F.col("_on")).alias("s"), T.sentences(F.col("text"), lists).alias("w"), T.pack_sentences(F.col("text"), on=F.col("_on")).alias("p"), T.pack_sentences(F.col("text"), boundaries=lists).alias("q")).collect()
    assert len(got) == df.count() and all(r.s == r.w and r.p == r.q for r in got)
    monkeypatch.setattr(B, "MOST", 1)
    with pytest.raises(ValueError):
        B.learn(df)
    assert B.going_on(df, "text", *B.learn_tables(df)).count() == df.count()


df_schema = "doc_id long, text string"


def test_words_of_chunks_are_made_once(spark, tmp_path):
    from evidentia.plans import retrieval

    texts = ["One, two; THREE\n\n ÉTÉ2 d'été\n---\n" * 9, "", "\n", " one \n", None, "x" * 50]
    spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "two one été"), (1, "---"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = retrieval.scored_chunks(spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count(r"[^\p{L}\p{N}]+") == 2  # of claims and of lines
    split = lambda x: set(re.sub(r"[\W_]+", " ", (x or "").lower()).split())
    claims = ["two one été", "---", None]
    rows = got.collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3, 5} and sum(r.doc_id == 0 for r in rows) > 1
    for r in rows:
        a, b = split(claims[r.claim_id]), split(r.body)
        assert r.score == (round(len(a & b) / len(a | b), 6) if claims[r.claim_id] is not None and a | b else 0)
