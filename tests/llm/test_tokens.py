import hashlib
import random
import time

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import sentencepieces as P
from evidentia.llm import token_counts as C

ODD = ["", "².", "x½.Ⅷ,²;", "'re can't 'r're''s !!'s", "<|endof", "a<|endoftext|><|x'll", "  a  b ", "a▁b", "\ta\n", "é́e\x00z", "　ａＢ", " ", "\n\n  \n", "a" * 40, "ab" * 700, "日本語のテキスト", "👩‍👩‍👧 ok", "---=====***", "Don't STOP'll <|endoftext|>x<|startoftext|> İΣ ΑΣ \x1d a\xa0b", "</s> <s>", "def f(x):\n    return x\n\n\t\ty", "thntion, erhean. The!! of%%% a|b"]


def texts():
    rng = random.Random(11)
    syllables = ["th", "er", "on", "an", "re", "é", "ß", "tion", "ing", "a", "!", ".", ",", " ", " ", "\n", "9", "Σ", "_"]
    return [*ODD, *("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 120))) for _ in range(150))]


@pytest.fixture(scope="module")
def clip():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pieces():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_counts_against_the_library(make, clip):
    rows = list(enumerate(texts()))
    lib = Tokenizer.from_file(clip)
    got = {r.id: (r.n_bytes, r.n_tokens) for r in C.token_counts(make(rows), clip).collect()}
    assert got == {i: (len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in rows}


def test_every_prefix(clip):
    lib, of = Tokenizer.from_file(clip), C.counter(clip)
    for t in [t for t in [*ODD, *texts()[-10:]] if len(t) < 200]:
        assert of.prefixes(t) == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


def test_budget(clip):
    of = C.counter(clip)
    for t in texts()[-20:]:
        for budget in (0, 1, 5, 1000):
            counts = of.prefixes(t)
            want = next((i - 1 for i, n in enumerate(counts) if n > budget), len(t))
            assert of.cut_at(t, budget) == want


def test_pieces_against_the_library(make, spark, pieces):
    rows = list(enumerate(texts()))
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces)
    ids = {i: [*lib.encode(t), lib.eos_id()] for i, t in rows}
    coded = P.encode(make(rows), pieces)
    assert {r.id: r.ids for r in coded.collect()} == ids
    assert {r.id: r.text for r in P.decode(coded, pieces).collect()} == {i: lib.decode(x) for i, x in ids.items()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.round_trip(make(rows), pieces).collect()}
    assert got == {i: (len(x), digest(" ".join(map(str, x))), digest(lib.decode(x))) for i, x in ids.items()}
    exact = {r.id: r.exact for r in P.encode_and_check(make(rows), pieces).collect()}
    assert exact == {i: "▁" not in t for i, t in rows}


def test_any_ids_decode_as_in_the_library(pieces):
    lib, rng = sentencepiece.SentencePieceProcessor(model_file=pieces), random.Random(2)
    for _ in range(300):
        ids = [rng.choice([2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(12))]
        assert P.decode_ids(pieces, ids) == lib.decode(ids)


def test_tables_answer_budgets(make, clip):
    rows, of = list(enumerate(texts()[-20:])), C.counter(clip)
    tables = C.prefix_tables(make(rows), clip)
    for budget in (0, 1, 5, 1000):
        got = {r.id: r.n for r in tables.select("id", C.truncation(F.col("counts"), budget).alias("n")).collect()}
        assert got == {i: of.cut_at(t, budget) for i, t in rows} == {r.id: r.kept_chars for r in C.token_counts(make(rows), clip, budget=budget).collect()}


def test_very_long_words(clip, pieces):
    rng = random.Random(3)
    word = "".join(rng.choice("aehinorst") for _ in range(200_000))
    of, lib = C.counter(clip), sentencepiece.SentencePieceProcessor(model_file=pieces)
    began = time.process_time()
    at = of.cut_at(word, 2048)
    assert time.process_time() - began < 10
    assert len(Tokenizer.from_file(clip).encode(word[:at], add_special_tokens=False).ids) <= 2048
    some = word[:20_000]
    assert P.encode_texts(pieces, [some])[0].tolist() == lib.encode(some)


def test_edges(make, clip, pieces):
    rows = make([(1, None), (None, "x"), (2, ""), (2, "")])
    assert sorted(r.n_tokens for r in C.token_counts(rows, clip).collect()) == [0, 0, 0, 1]
    assert sorted(r.n_tokens for r in P.round_trip(rows, pieces).collect()) == [1, 1, 1, 2]
    assert C.token_counts(make([]), clip).count() == P.encode(make([]), pieces).count() == 0
