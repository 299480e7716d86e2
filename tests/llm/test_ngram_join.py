import random
import re
from collections import Counter, defaultdict

import pytest

from evidentia.llm import ngram_join as N
from tests.llm.conftest import prose

WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(j)] = root(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(k, least.get(root(i), k))
    return sorted((k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    rows, shared = [], prose(rng, 60)
    for _ in range(40):
        words = prose(rng, rng.choice((3, 12, 60, 200))).split()
        if rng.random() < 0.4:
            words += shared.split()
        for _ in range(rng.choice((1, 1, 2, 6))):
            copy = list(words)
            for _ in range(rng.choice((0, 1, 2, 4, 12))):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(1000))
            rows.append((len(rows), " ".join(copy) if rng.random() < 0.8 else "\n".join(copy).upper()))
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one"), (905, "one")]


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_against_brute_force(make, seed, size, percent):
    rows = corpus(seed)
    got = sorted((r.id, r.n_shingles, r.component_id) for r in N.jaccard_components(make(rows), size, percent).collect())
    assert got == brute(rows, size, percent)


def test_blocks_of_a_large_cluster(make, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(4)
    words = prose(rng, 80).split()
    rows = []
    for i in range(60):
        copy = list(words)
        for _ in range(rng.choice((1, 2, 3))):
            copy[rng.randrange(80)] = f"e{rng.randrange(50)}"
        rows.append((i, " ".join(copy)))
    got = sorted((r.id, r.n_shingles, r.component_id) for r in N.jaccard_components(make(rows), 4, 85).collect())
    assert got == brute(rows, 4, 85)


def test_shared_passages_are_no_pairs(make, monkeypatch):
    """Documents that share passages without being linked: nearly no members are compared."""
    monkeypatch.setattr(N, "BLOCK", 64)
    rng = random.Random(9)
    passages = [prose(rng, 40) for _ in range(30)]
    rows = [(i, " ".join([f"u{i}x{k}" for k in range(40)] + rng.sample(passages, 2))) for i in range(600)]
    rows += [(600 + i, rows[i][1] + " more") for i in range(0, 60, 2)]
    compared = []
    in_units = N.in_units

    def counted(members, key, counts):
        if key == "cluster":
            compared.append(counts.selectExpr("sum(n * (n - 1) / 2) as p").first().p or 0)
        return in_units(members, key, counts)

    monkeypatch.setattr(N, "in_units", counted)
    got = sorted((r.id, r.n_shingles, r.component_id) for r in N.jaccard_components(make(rows), 4, 85).collect())
    assert got == brute(rows, 4, 85)
    assert sum(r[0] != r[2] for r in got) == 30
    assert compared[0] < 0.01 * 630 * 629 / 2


def test_a_long_text(make):
    rng = random.Random(10)
    long = prose(rng, 120_000)
    rows = [(1, long), (2, long + " end"), (3, prose(rng, 50)), (4, long[: len(long) // 2])]
    got = sorted((r.id, r.n_shingles, r.component_id) for r in N.jaccard_components(make(rows), 4, 85).collect())
    assert got == brute(rows, 4, 85)


def test_looked_up_shingles_always_overlap():
    for percent in (60, 80, 85, 100):
        for n in range(1, 400):
            assert 1 <= N.looked_up(n, percent) <= n


def test_empty(make):
    assert N.jaccard_components(make([]), 4, 85).count() == 0
