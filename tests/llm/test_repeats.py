import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import repeats as R
from tests.llm.conftest import prose


def flags(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[k : k + length] for x in data for k in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = [False] * len(x)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        out.append(gone)
    return out


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(x[k : k + length] for _, x in data for k in range(len(x) - length + 1))
    out = []
    for i, x in data:
        gone = [False] * len(x)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone) if not g)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    passage, rows = prose(rng, 40), []
    for i in range(30):
        parts = [prose(rng, rng.randrange(1, 60)) for _ in range(3)]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(4), passage[rng.randrange(60) :])
        if rng.random() < 0.2:
            parts.append(parts[0])
        rows.append((i, "é ".join(parts)))
    edited = list(rows[0][1])
    edited[len(edited) // 2] = "#"
    return [*rows, (100, rows[3][1]), (101, rows[3][1]), (102, "".join(edited)), (103, None), (104, ""), (105, "a" * 500), (106, "ab" * 300), (107, "xyz" * 5), (107, "xyz" * 5)]


def kept(r, text):
    return bytes(r.kept) if r.kept is not None else (text or "").encode()


@pytest.mark.parametrize(("seed", "length", "block"), [(1, 100, 1024), (2, 80, 3), (3, 7, 1024)])
def test_against_brute_force(make, monkeypatch, seed, length, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rows = corpus(seed)
    got = sorted((r.id, r.n_bytes, r.n_bytes - len(kept(r, r.text)), len(r.spans or []), kept(r, r.text)) for r in R.remove_repeats(make(rows), length).collect())
    assert got == brute(rows, length)


def test_query(spark, documents):
    rows = corpus(5)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.op5_suffix_dedup(spark, documents(rows)).collect())
    assert got == sorted((i, n, m, s, hashlib.sha256(x).hexdigest()) for i, n, m, s, x in brute(rows, 400))


def test_ordered_groups_as_compared_ones():
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    digits, member = R._digits(parts, 40), np.arange(60).reshape(2, 30)
    off = ~np.eye(30, dtype=bool)
    assert (R._ordered(digits, member)[:, off] == R._compared(digits, member)[:, off]).all()


@pytest.mark.parametrize("few", [1, 32])
def test_passages(make, monkeypatch, few):
    monkeypatch.setattr(R, "FEW", few)
    rows = corpus(9)
    want = {}
    for i, x, gone in ((i, (t or "").encode(), g) for (i, t), g in zip(rows, flags(rows, 60))):
        runs, at = [], 0
        while at < len(x):
            end = at
            while end < len(x) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                runs.append((at, end))
            at = end
        want.setdefault(i, []).append(R.most_words(x, runs))
    got = {}
    for r in R.remove_repeats(make(rows), 100, passage=60).collect():
        got.setdefault(r.id, []).append(r.passage_words)
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


def test_runs_of_words(make):
    rng = random.Random(14)
    rows = [(i, prose(rng, 30)) for i in range(20)]
    shared = prose(rng, 60).split()
    for i, n in enumerate((12, 14, 15, 16, 19, 20, 25, 60)):
        rows += [(100 + i, prose(rng, 40) + " x\ny  " + " ".join(shared[:n])), (200 + i, " ".join(shared[60 - n :]))]
    rows += [(300, rows[3][1]), (301, None), (302, ""), (303, " ".join(shared[:30] + ["q"] + shared[:30]))]
    w = {i: (t or "").split() for i, t in rows}

    def held(k):
        seen = Counter(tuple(x[j : j + k]) for x in w.values() for j in range(len(x) - k + 1))
        return {i for i, x in w.items() if any(seen[tuple(x[j : j + k])] > 1 for j in range(len(x) - k + 1))}

    keys = {r.c for r in R.with_repeated_words(make(rows), 20, 5).collect()}
    got = {i for i, t in rows if R.text_key((t or "").encode()) in {bytes(k) for k in keys}}
    assert held(20) <= got <= held(16)


def test_whole_words_of_runs():
    assert R.most_words(b"one two three four", [(1, 13)]) == 2
    assert R.most_words(b"one two three four", [(0, 18)]) == 4
    assert R.most_words(b"one two", [(1, 2)]) == R.most_words(b"", []) == 0


def test_empty(make):
    assert R.remove_repeats(make([]), 100).count() == 0


@pytest.mark.parametrize("lengths", [(20,), (20, 31), (7, 31)])
def test_hot_anchors_without_pairs_as_in_pairs(monkeypatch, lengths):
    rng = random.Random(8)
    line = bytes(rng.choice(b"abc\0") for _ in range(40))
    contexts, at = [], []
    for _ in range(300):
        before, after = line[: rng.randrange(20)], line[20 : rng.randrange(25, 40)]
        before = bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(6))) + before[rng.randrange(len(before) + 1) :]
        contexts.append(before + after + bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(6))))
        at.append(len(before))
    key, offset = np.arange(300) % 3, np.array(at)
    got = []
    for many in (1, 1000):
        monkeypatch.setattr(R, "MANY", many)
        got.append([sorted(zip(*(x.tolist() for x in one))) for one in R.repeated(contexts, key, offset, lengths, 25)])
    assert got[0] == got[1] and got[0][0]


def test_memory_of_a_hot_anchor_grows_with_its_contexts_not_their_pairs():
    rng = random.Random(9)
    line, n = rng.randbytes(500), 4000
    contexts = [rng.randbytes(100) + line[:400] + rng.randbytes(236) for _ in range(n)]
    tracemalloc.start()
    of, first, last = R.repeated(contexts, np.zeros(n, np.int64), np.full(n, 336), (400,), 336)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(of.tolist()) == list(range(n)) and (first <= 100).all() and (last >= 500).all()
    assert peak < 60 << 20, peak
