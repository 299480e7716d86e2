import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidentia.llm import packing as P
from evidentia.llm.catalogue import QUERIES
from tests.llm.conftest import prose

FILE = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def plain_best_fit(sizes, limit):
    """Rooms of the bins after best fit decreasing, one size after the other."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        best = min((r for r in rooms if r >= s), default=None)
        if best is None:
            rooms.append(limit - s)
        else:
            rooms[rooms.index(best)] = best - s
    return sorted(rooms)


def test_tightest_against_a_list():
    rng, rooms, plain = random.Random(1), P.Capacities(40), []
    for k in range(3000):
        if rng.random() < 0.5 or not plain:
            r = rng.randrange(1, 41)
            rooms.add(r, k, 1)
            plain.append(r)
        least = rng.randrange(1, 41)
        want = min((r for r in plain if r >= least), default=None)
        assert rooms.tightest(least) == want
        if want is not None and rng.random() < 0.6:
            rooms.take(want)
            plain.remove(want)


@pytest.mark.parametrize("limit", [1, 10, 17, 128])
def test_steps_are_best_fit_decreasing(limit):
    rng = random.Random(limit)
    for _ in range(60):
        sizes = [rng.randrange(1, limit + 1) if rng.random() < 0.6 else rng.choice([1, max(1, limit // 3)]) for _ in range(rng.randrange(200))]
        held, ranks = defaultdict(dict), Counter()
        for length, rank, n, each, first, offset in P.best_fit(Counter(sizes), limit):
            assert rank == ranks[length]
            ranks[length] += n
            for i in range(n):
                at = offset + i % each * length
                assert at not in held[first + i // each]
                held[first + i // each][at] = length
        assert ranks == Counter(sizes)
        for parts in held.values():
            end = 0
            for at in sorted(parts):
                assert at == end
                end += parts[at]
        assert sorted(limit - sum(p.values()) for p in held.values()) == plain_best_fit(sizes, limit)


def test_work_depends_on_the_limit_alone():
    few, many = (len(P.best_fit({n: times * (n % 7 + 1) for n in range(1, 2049)}, 2048)) for times in (10, 10**9))
    assert many < 3 * few < 20_000


def test_lengths_out_of_range():
    with pytest.raises(ValueError):
        P.best_fit({0: 1}, 8)
    with pytest.raises(ValueError):
        P.best_fit({9: 1}, 8)


def test_ids_of_odd_texts(library):
    rng, of = random.Random(3), P.encoder(FILE)
    odd = ["", " ", "  ", "a  b", " x", "x ", "a\nb \n c", "<|endoftext|>", "a <|endoftext|> b", "<|end", "it's  'll", "x\x1cy \x1d z", "日本 語  x", "a\t\tb", "é  ", "x" * 5000, "　a  b"]
    odd += ["".join(rng.choice(["a", "'s", " ", "\n", "\t", "1", "é", "。", "<|endoftext|>", "\x1c", "\x85"]) for _ in range(rng.randrange(30))) for _ in range(2000)]
    for text in odd:
        assert of.encode(text) == np.array(ids_of(library, text), dtype="<u4").tobytes()


def check(got, texts, library, limit, end):
    """Pieces in order of each row's text, and sequences without holes."""
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= limit
    want = Counter()
    for i, text in texts:
        ids = [*ids_of(library, text), end]
        at, to, k = 0, len(ids) % limit or min(limit, len(ids)), 0
        while at < len(ids):
            want[i, k, at, to - at, zlib.crc32(np.array(ids[at:to], dtype="<u4").tobytes())] += 1
            at, to, k = to, to + limit, k + 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len(places) == len(plain_best_fit([n for *_, n, _ in want.elements()], limit))


def test_rows(make, library):
    rng = random.Random(4)
    texts = [(i, prose(rng, rng.randrange(60))) for i in range(200)] + [(1000 + i, "many rows have this text") for i in range(300)]
    texts += [(1, None), (1, ""), (1, ""), (None, "x"), (7, "word " * 30_000)]
    packed = P.pack(make(texts), FILE, limit=64, end=5, with_ids=True)
    got = packed.collect()
    check(got, texts, library, 64, 5)
    rows = {r.sequence_id: r for r in P.sequences(packed).collect()}
    assert sum(len(r.ids) for r in rows.values()) == sum(r.length for r in got)
    for r in got:
        whole = rows[r.sequence_id]
        assert sum(whole.lengths) == len(whole.ids) <= 64
        assert whole.ids[r.offset : r.offset + r.length] == r.ids
    assert P.pack(make([]), FILE).count() == 0
    assert P.sequences(P.pack(make([]), FILE, with_ids=True)).count() == 0


def test_op11_against_the_library(spark, library):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check(QUERIES["op11_best_fit_packing"](spark, DATA).withColumnRenamed("doc_id", "id").collect(), texts, library, 2048, 0)
