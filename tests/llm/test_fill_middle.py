import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.llm import fill_middle as M
from tests.llm.conftest import prose

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(seed, i, text, rate=50, spm=80, units="words"):
    text = text or ""
    tokens = TOKEN.findall(text) if units == "words" else list(text)
    n = len(tokens)
    h = [int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


ODD = ["", " ", "\n\t", "a", " a", "a ", "a  b\n", "\x1c x", "é  ü", "日本語 です", "<P> x", "x <S", "a<b>c <M", "\x00 a", "😀 x 😀"]


@pytest.mark.parametrize("units", ["words", "chars"])
def test_cuts_at_every_unit(units):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab \n\té日😀") for _ in range(rng.randrange(40))) for _ in range(300)]
    for text in texts:
        tokens = TOKEN.findall(text) if units == "words" else list(text)
        runs = M.Runs(text.encode(), units)
        assert runs.total == len(tokens)
        assert [runs.end_of(k) for k in range(len(tokens) + 1)] == [len("".join(tokens[:k]).encode()) for k in range(len(tokens) + 1)]


@pytest.mark.parametrize("units", ["words", "chars"])
def test_rows(make, units):
    rng = random.Random(6)
    texts = [(i, prose(rng, rng.randrange(30))) for i in range(150)] + [(200 + i, t) for i, t in enumerate(ODD * 4)]
    texts += [(1, None), (1, ""), (1, ""), (None, "x y z"), (9, "long é text\n" * 50_000), (9, "long é text\n" * 50_000)]
    made = M.fill_in_middle(make(texts), rate=90, units=units)
    got = made.withColumn("again", M.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: str(r)
    want = sorted(((i, *plain(42, i, t, 90, units=units), t or "") for i, t in texts), key=key)
    assert sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in got), key=key) == want
    assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_edges(make):
    assert M.fill_in_middle(make([])).count() == 0
    with pytest.raises(ValueError):
        M.Runs(b"x", "lines")
