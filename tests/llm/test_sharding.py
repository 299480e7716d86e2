import random
import zlib
from collections import defaultdict

from evidentia.llm import sharding as S
from tests.llm.conftest import prose


def test_tree_against_a_sorted_list():
    rng, rooms, plain = random.Random(2), S.Rooms(), []
    for k in range(3000):
        if rng.random() < 0.6 or not plain:
            x = (rng.randrange(300), k)
            rooms.add(*x)
            plain = sorted([*plain, x])
        else:
            least = rng.randrange(320)
            want = next((x for x in plain if x[0] >= least), None)
            assert rooms.take(least) == want
            if want:
                plain.remove(want)


def test_best_fit_decreasing():
    assert S.best_fit_decreasing([5, 4, 3, 3], 8) == [0, 1, 0, 1]
    assert S.best_fit_decreasing([9, 2], 8) == [0, 1]
    assert S.best_fit_decreasing([], 8) == []


def test_a_large_group_has_a_shard_of_its_own():
    rng = random.Random(3)
    sizes = [100_000, *(rng.randrange(1, 400) for _ in range(2000))]
    sums = defaultdict(int)
    for s, b in zip(sizes, S.into_shards(sizes, 8)):
        sums[b] += s
    rest = sorted(sums.values())[:-1]
    assert max(sums.values()) == 100_000
    assert len(rest) == 7
    assert max(rest) - min(rest) <= 400


def test_rows(make):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(40))) for i in range(500)]
    rows += [(1000 + i, "a copy that many rows have") for i in range(700)] + [(1, None), (1, ""), (1, ""), (None, "x")]
    got = S.shard(make(rows), 7).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    slots, bytes_of = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        bytes_of[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.id is not None and r.id >= 1000}) == 1
    others = [b for s, b in bytes_of.items() if s != next(r.shard for r in got if r.id is not None and r.id >= 1000)]
    assert max(others) - min(others) <= 0.1 * max(others)


def test_edges(make):
    assert S.shard(make([]), 3).count() == 0
    assert [(r.shard, r.slot) for r in S.shard(make([(1, "x")]), 3).collect()] == [(0, 0)]
