import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from evidentia.llm import decontamination as D
from evidentia.llm import html_extraction as H
from evidentia.llm import quality as Q
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def model():
    return H.default_model()


def test_held_out_pages(model):
    good = total = 0
    for source, truth in H.labelled_pages(80, seed=99):
        page = H.parse(source)
        p = H.marginals(page, model)
        for owner in {o for o, _ in page.runs}:
            good += (p[owner] >= 0.5) == bool(truth[owner])
            total += 1
    assert good / total > 0.96


def test_messages_give_exact_marginals():
    edge = ((0.3, -0.5), (-0.7, 0.4))
    m = H.Model(tuple(np.random.default_rng(1).normal(0, 0.3, H.FEATURES)), edge)
    page = H.parse("<body><div class=x><p>a b. c<ul><li>d<li>e</ul></div><nav><a>f</a></nav>")
    score = [max(-H.CLAMP, min(H.CLAMP, sum(m.weights[k] * v for k, v in f.items()))) for f in H.features(page)]
    n, weight = len(page.blocks), {}
    for bits in range(1 << n):
        y = [(bits >> i) & 1 for i in range(n)]
        weight[bits] = np.exp(sum(s for s, b in zip(score, y) if b) + sum(edge[y[b.parent]][y[i]] for i, b in enumerate(page.blocks) if b.parent >= 0))
    total = sum(weight.values())
    want = [sum(w for bits, w in weight.items() if (bits >> i) & 1) / total for i in range(n)]
    assert np.allclose(H.marginals(page, m), want)


def test_page_text(model):
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
    <div class="cookie-notice">We use cookies, accept them.</div><article><h1>A &amp; B</h1><p>First&nbsp;line,  of
    text. It goes on.<p>Second <b>line</b>&#33; With more words in it.<script>x("<p>")</script></article>
    <section id="comments"><div class="comment"><p>Nice post, really.</p></div></section><footer>&copy; me</footer>"""
    assert H.main_text(page, model) == "A & B\nFirst line, of text. It goes on.\nSecond line! With more words in it."
    assert H.main_text(None, model) == H.main_text("", model) == H.main_text("<<<>&", H.Model((-9.0,) * H.FEATURES, ((0, 0), (0, 0)))) == ""


def test_extract(spark, model):
    rows = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<article><p>Some words, in a row.</p></article>")], "page_id long, url string, html string")
    got = H.extract(rows, model, keep=("url",)).collect()
    assert sorted((r.id or 0, r.url or "", r.text) for r in got) == [(0, "", "Some words, in a row."), (1, "u", ""), (1, "u", "")]
    assert H.extract(rows.limit(0), model).count() == 0


def labelled(rng, n):
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(20, 120)).split()
        low, toxic = rng.random() < 0.2, rng.random() < 0.2
        if low:
            words = [w + rng.choice(("###", "***")) for w in words]
        if toxic:
            words[3:3] = [rng.choice(("idiot", "scum", "zork" + rng.choice(("a", "be", "no"))))] * 2
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(not low), int(toxic)))
    return docs, labels, [("###" in t or "***" in t) or any(w in t for w in ("idiot", "scum", "zork")) for _, t in docs]


def test_classifier_on_held_out_documents(make, spark):
    docs, labels, bad = labelled(random.Random(6), 1200)
    frame = make(docs)
    weights = Q.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    keep = {r.id: r.keep for r in Q.score(frame, weights).collect()}
    held = [i for i in range(1200) if i % 2]
    assert np.mean([keep[i] == (not bad[i]) for i in held]) > 0.97
    assert {r.doc_id for r in Q.filter_documents(frame, weights).collect()} == {i for i, k in keep.items() if k}


def test_classifier_edges(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    weights = Q.train(make([]), none)
    rows = make([(1, None), (None, "x"), (2, ""), (2, "")])
    assert [r.keep for r in Q.score(rows, weights).collect()] == [True] * 4
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert Q.filter_documents(rows, Q.train(rows, nulls)).count() >= 2


def test_no_task_gets_the_features_of_the_sample(make, spark, monkeypatch):
    docs, labels, _ = labelled(random.Random(7), 400)
    given, grouped = [], PandasGroupedOpsMixin.applyInPandas
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", lambda self, f, schema: given.append(self._df) or grouped(self, f, schema))
    assert set(Q.train(make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == set(Q.QUESTIONS)
    whole = 4 * sum(len(x) for x in Q.distinct(Q.parse([t.encode() for _, t in docs]), len(docs)))
    for df in given:
        size = sum((F.length(c) for c, kind in df.dtypes if kind == "binary"), F.lit(0))
        assert df.agg(F.sum(size)).first()[0] < whole / 4


def test_scorer_holds_what_its_rows_have():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(50, 8, replace=False)).astype(np.int32) for _ in range(300)]
    tracemalloc.start()
    w = Q.fit(rows, np.array([float(7 in x) for x in rows]), steps=1200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w[7] > 1
    assert peak < 2 << 20


def test_sums_and_choice_of_features_by_brute_force(make, spark):
    rng = np.random.default_rng(2)
    last = Q.FEATURES - 1
    x = [np.append(np.sort(rng.choice(40, rng.integers(0, 12), replace=False)), last).astype(np.int32) for _ in range(150)]
    y = [float(5 in r) if i % 3 else float("nan") for i, r in enumerate(x)]
    frame = spark.createDataFrame([(v, bytearray(r.tobytes())) for v, r in zip(y, x)], "y double, x binary").repartition(5)

    def answers(batch, _):
        told = batch.column("y").to_numpy()
        return {"low": told, "toxic": 1 - told / 4}

    got = {(r.question, r.feature): (r.n, r.yes) for r in Q.summed(frame, answers).collect()}
    some = [(v, set(r.tolist())) for v, r in zip(y, x) if v == v]
    for q, f in (("low", lambda v: v), ("toxic", lambda v: 1 - v / 4)):
        for k in (*range(40), last):
            own = [f(v) for v, r in some if k in r]
            assert got.get((q, k), (0, 0)) == (len(own), sum(own) * Q.PARTS)
    chosen = Q.chosen_features(frame, answers, seen=4)
    assert chosen["low"].tolist() == [5, last]
    assert [r.tolist() for r in Q.among(chosen["low"], x)] == [[0, 1] if 5 in r else [1] for r in x]


def test_posteriors_follow_the_human_vote():
    p = Q.posteriors([("1-1", 40), ("0-0", 400), ("1--", 30), ("0--", 500), ("-1-", 5)])
    assert p["1--"] > 0.8
    assert p["0--"] < 0.1
    assert Q.posteriors([]) == {}


def benchmark(rng):
    items = [(k, prose(rng, rng.randrange(15, 60))) for k in range(12)]
    return [*items, (50, "What is it that the old " + prose(rng, 20) + "? The answer is " + prose(rng, 8)), (60, None), (61, "")]


def test_leaks_and_nothing_else(make, spark):
    rng = random.Random(8)
    items = benchmark(rng)
    rows, want = [], set()
    for i in range(150):
        words = prose(rng, rng.randrange(5, 300)).split()
        if i % 5 == 0:
            k, text = items[(i // 5) % 13]
            copy = (text or "").split()
            if i % 10 == 0:
                for _ in range(len(copy) // 8):
                    copy[rng.randrange(len(copy))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = copy
            want.add((i, k))
        rows.append((i, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item) for r in D.find_leaks(make([*rows, (900, None), (901, ""), (None, items[0][1])]), bench).collect()}
    assert got == want
    assert D.find_leaks(make(rows), bench.limit(0)).count() == D.find_leaks(make([]), bench).count() == 0


def test_items_in_blocks(make, spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 4)
    rng = random.Random(9)
    items = benchmark(rng)
    rows = [(k, prose(rng, 50) + " " + t + " " + prose(rng, 50)) for k, t in items if t]
    got = {(r.id, r.item) for r in D.find_leaks(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k, t in items if t}


def test_common_subsequence():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 1, 3, 9, 5])
    assert D.common_subsequence(a, b).tolist() == [0, 1, 1, 2, 2, 3]
    assert D.answer_of(b"Who was it? It was me.") == (3, 6)


def longer(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n))


def test_more_items_than_dimensions(make, spark):
    rng = random.Random(11)
    items = [(k, longer(rng, 28)) for k in range(2000)]
    rows = [(k, prose(rng, 40) + " " + t + " " + prose(rng, 40)) for k, t in items[:100]]
    got = {(r.id, r.item) for r in D.find_leaks(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k, _ in items[:100]}


def test_items_longer_than_a_passage(make, spark):
    rng = random.Random(12)
    items = [(k, longer(rng, 300 * (k + 1))) for k in range(4)]
    rows = [(k, prose(rng, 90) + " " + t + " " + prose(rng, 90)) for k, t in items]
    rows += [(10 + k, prose(rng, 50) + " " + " ".join(t.split()[len(t.split()) // 10 :]) + " " + prose(rng, 50)) for k, t in items]
    rows += [(20 + k, " ".join(t.split()[: len(t.split()) // 2])) for k, t in items]
    got = {(r.id, r.item) for r in D.find_leaks(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d + k, k) for k, _ in items for d in (0, 10)}


def test_an_item_in_many_documents(make, spark):
    rng = random.Random(13)
    items = [(k, longer(rng, 20)) for k in range(60)]
    others = " ".join(t for _, t in items[1:]).split()
    rows = [(i, longer(rng, 100)) for i in range(200)]
    for i in range(0, 200, 2):
        rows[i] = (i, " ".join(rng.choice(others) for _ in range(60)) + " " + items[0][1] + " " + " ".join(rng.choice(others) for _ in range(60)))
    got = {r.id for r in D.find_leaks(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect() if r.item == 0}
    assert got == set(range(0, 200, 2))


def test_the_latent_space_sums_all_documents(spark, monkeypatch):
    """Frequencies, the space and the search each read every document, however many there are."""
    seen, task = [], D._task
    monkeypatch.setattr(D, "SAMPLE", 10, raising=False)
    monkeypatch.setattr(D, "_task", lambda df, one, schema: seen.append(df.count()) or task(df, one, schema))
    rng = random.Random(21)
    rows = [(i, prose(rng, 40)) for i in range(200)]
    items = spark.createDataFrame([(0, rows[7][1])], "item_id long, text string")
    got = {(r.id, r.item) for r in D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert (7, 0) in got and seen == [200, 200, 200]


def test_entries_of_passages_are_sorted_not_hashed(monkeypatch):
    """Sorting tells entries apart in a small part of the time that hashing takes; the rows are the same."""
    from evidentia.llm import decontamination as D
    from evidentia.llm.common import distinct

    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 50, 400), np.zeros(0, np.int64), rng.integers(0, 9, 30).astype(np.uint64)):
        assert (distinct(x) == np.unique(x)).all() and distinct(x).dtype == x.dtype
    v = np.unique(rng.integers(1, 2**63, 40, dtype=np.uint64))
    words, bounds = v[rng.integers(0, 40, 500)], np.array([0, 3, 3, 200, 500])
    space = D.Space(v, D.slots(v), np.ones(40), [], [], [], [])
    monkeypatch.setattr(D.np, "unique", lambda *a, **k: pytest.fail("hashed"))
    entries, doc, first = D.passages(words, bounds, space)
    number = {int(x): i for i, x in enumerate(v)}
    want = {(p, number[int(w)]) for p, (d, f) in enumerate(zip(doc, first)) for w in words[bounds[d] + f : min(bounds[d] + f + D.PASSAGE, bounds[d + 1])]}
    assert list(map(tuple, entries.T.tolist())) == sorted(want)
    block = D.Block(np.where(np.arange(40) % 2, -1, np.arange(40) // 2), np.ones(20), None, None, None, 9.0)
    live, mine = D.heavy(entries, block)
    weight = {p: len({f for q, f in want if q == p and f % 2 == 0}) for p in range(len(doc))}
    assert live.tolist() == [p for p, n in weight.items() if n >= 9]
    assert list(map(tuple, mine.T.tolist())) == [(i, f // 2) for i, p in enumerate(live.tolist()) for q, f in sorted(want) if q == p and f % 2 == 0]
