"""Quality classifier: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers (and the human labels, one more labeller) vote 1, 0 or nothing on two
questions: is the text low in quality, is it toxic. Some look at the text's shape, one at a short list
of insults, and some at words and word beginnings that go with the human label in a bounded sample,
whatever the language. Expectation-maximisation over the counts of vote patterns, which cover all
documents, estimates how often each labeller is right, and so the posterior of every pattern.
Posteriors of the sample train two sparse linear scorers over hashed words, word beginnings and text
shapes; these score every document. Texts are taken apart in numpy, many at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import SPACE, as_bytes, by_bytes, cut, mix64, over_batches, table

#: Documents that the scorers and the labellers' word lists are fitted on, at most: labelled ones
#: first, by a hash of the id.
SAMPLE = 20_000
#: Bytes of text that are taken apart at once; about fifty times as much is held meanwhile.
PIECE = 1 << 19
#: Hashed features of a kind: words, and their first 4, 5 and 6 bytes; then bins of the text's shape.
KIND, BEGINNINGS, BINS = 1 << 19, (4, 5, 6), 256
FEATURES = (1 + len(BEGINNINGS)) * KIND + BINS

# Words that insult.
INSULTS = ("idiot", "moron", "stupid", "loser", "imbecile", "dumb", "fool", "coward", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "garbage", "vermin")

QUESTIONS = ("low", "toxic")

_SIGN, _LETTER, _UPPER, _LOWER = (np.zeros(256, dtype=bool) for _ in range(4))
_SIGN[list(b"!#$%&*|@^~<>={}[]\\")] = True
_UPPER[65:91] = _LOWER[97:123] = True
_LETTER[128:] = True
_LETTER |= _UPPER | _LOWER
#: What a letter adds to its word's hash, A-Z as a-z, and one odd multiplier for each place in a word.
_VALUE = np.where(_LETTER, np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + 1, 0).astype(np.uint64)
_PLACE = np.random.Generator(np.random.PCG64(61)).integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Shares of a text, as columns of ``Parsed.shape``: tokens that end in a sign, that are a bar, words in
#: capitals, tokens that begin with a letter, lines that occurred before, tokens like the one before;
#: then tokens and their mean length.
SHARES = ("signs", "bars", "upper", "alpha", "again", "echo", "words", "long")


@dataclass
class Parsed:
    """Features of several texts: entries (text, feature), not yet distinct, and a row of shares for each text."""

    text: np.ndarray
    feature: np.ndarray
    shape: np.ndarray


def parse(texts: list[bytes]) -> Parsed:
    """Words are runs of ASCII letters and bytes from 128 on; tokens are parted by white space."""
    n = len(texts)
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    letter = _LETTER[data]
    change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    first, last = change[::2], change[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    if len(first):
        place = np.arange(len(data), dtype=np.int32)
        place -= np.repeat(np.concatenate(([0], first)).astype(np.int32), np.diff(np.concatenate(([0], first, [len(data)]))))
        np.cumsum(_VALUE[data] * _PLACE[place & 1023], out=sums[1:])
    owner, size = np.searchsorted(ends, first), last - first
    text, feature = [owner], [_slot(sums[last] - sums[first], 0)]
    for kind, k in enumerate(BEGINNINGS, 1):
        long = size > k
        text.append(owner[long])
        feature.append(_slot(sums[first[long] + k] - sums[first[long]], kind))
    shape = np.zeros((n, len(SHARES)))
    token = ~SPACE[data]
    change = np.flatnonzero(token[1:] != token[:-1]) + 1
    first, last = change[::2], change[1::2]
    owner = np.searchsorted(ends, first)
    count = lambda some: np.bincount(owner[some], minlength=n)
    tokens, starts = count(slice(None)), letter[first]
    few = np.maximum(tokens, 1)
    upper, lower = (np.concatenate(([0], np.cumsum(x[data]))) for x in (_UPPER, _LOWER))
    words = count(starts)
    shape[:, 0] = count(_SIGN[data[last - 1]]) / few
    shape[:, 1] = count((last - first == 1) & (data[first] == 124)) / few
    shape[:, 2] = count(starts & (last - first > 1) & (upper[last] > upper[first]) & (lower[last] == lower[first])) / np.maximum(words, 1)
    shape[:, 3] = words / few
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x]
        parts = t.split()
        shape[i, 4] = 1 - len(set(lines)) / max(1, len(lines))
        shape[i, 5] = sum(map(eq, parts, parts[1:])) / few[i]
    shape[:, 6] = tokens
    shape[:, 7] = np.bincount(owner, weights=last - first, minlength=n) / few
    bins = np.concatenate(((10 * shape[:, :6]).astype(int) + 11 * np.arange(6), np.minimum(np.log2(1 + shape[:, 6:7]), 31).astype(int) + 66, np.minimum(shape[:, 7:], 31).astype(int) + 98), axis=1)
    text.append(np.repeat(np.arange(n), 9))
    feature.append(FEATURES - BINS + np.concatenate((bins, np.full((n, 1), BINS - 1)), axis=1).ravel())
    return Parsed(np.concatenate(text), np.concatenate(feature), shape)


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    return kind * KIND + (mix64(h) % np.uint64(KIND)).astype(np.int64)


def distinct(p: Parsed, n: int) -> list[np.ndarray]:
    """The distinct features of each text, in order."""
    entry = np.unique(p.text * FEATURES + p.feature)
    return np.split(entry % FEATURES, np.searchsorted(entry // FEATURES, np.arange(1, n))) if n else []


#: Of each question, the labellers that look at lists made from the sample: by kind of feature.
MINED = {"low": (0,), "toxic": (0, 1, 2, 3)}
#: Fewest sampled texts of the class that hold a feature of such a list.
SEEN = 4


def shape_votes(shape: np.ndarray) -> list[str]:
    """The votes of those labellers on quality that look at the text's shape: "1" for low, "0" for not,
    "-" for no opinion. Each looks for one fault; the last one votes for texts with no trace of any."""
    if not len(shape):
        return []
    s = dict(zip(SHARES, shape.T))
    faults = [s["signs"] > 0.25, s["upper"] > 0.6, s["bars"] > 0.15, (s["again"] > 0.5) & (s["words"] > 20), s["echo"] > 0.2, s["alpha"] < 0.6]
    sound = (s["signs"] < 0.02) & (s["upper"] < 0.1) & (s["bars"] == 0) & (s["again"] < 0.2) & (s["echo"] < 0.02) & (s["alpha"] > 0.8)
    return ["".join(row) for row in np.stack([*(np.where(f, "1", "-") for f in faults), np.where(sound, "0", "-")], axis=1)]


def list_votes(lists: dict[str, list[np.ndarray]], n: int, text: np.ndarray, feature: np.ndarray) -> dict[str, list[str]]:
    """For each question, the votes of its labellers that look at lists of features, from distinct
    entries (text, feature): "1" if at least two features are in the list, or a hundredth of the text's
    words, else no opinion; and of one that votes "0" where no list has any."""
    out, words = {}, np.bincount(text[feature < KIND], minlength=n)
    for q in QUESTIONS:
        hits = np.stack([np.bincount(text[some[feature]], minlength=n) for some in lists[q]], axis=1)
        cast = np.where((hits > 1) | (100 * hits > words[:, None]), "1", "-")
        none = np.where((hits == 0).all(axis=1), "0", "-")
        out[q] = ["".join(row) for row in np.concatenate((cast, none[:, None]), axis=1)]
    return out


def insult_list() -> np.ndarray:
    some = np.zeros(FEATURES, dtype=bool)
    p = parse([" ".join(INSULTS).encode()])
    some[p.feature[p.feature < KIND]] = True
    return some


def to_lists(mined: dict[str, np.ndarray]) -> dict[str, list[np.ndarray]]:
    """The lists of each question's labellers, as a mark for each feature."""
    out: dict[str, list[np.ndarray]] = {"low": [], "toxic": [insult_list()]}
    for q in QUESTIONS:
        for kind in MINED[q]:
            some = np.zeros(FEATURES, dtype=bool)
            of = mined.get(q, np.zeros(0, np.int64))
            some[of[of // KIND == kind]] = True
            out[q].append(some)
    return out


def posteriors(patterns: list[tuple[str, int]], rounds: int = 60) -> dict[str, float]:
    """P(1) of every vote pattern, from the patterns' counts, by expectation-maximisation of a model in
    which labellers err independently given the truth. The last vote is the human one and, where cast,
    settles the truth but for one case in a hundred; if both answers occur, the first round learns from
    those cases alone, so that it starts from the labellers' measured accuracies. No opinion is no
    evidence. No patterns give no posteriors."""
    if not patterns:
        return {}
    names = [p for p, _ in patterns]
    count = np.array([c for _, c in patterns], dtype=float)
    vote = np.array([["-01".index(v) for v in p] for p in names])
    # Start: the share of positive votes among the votes cast.
    cast, positive = (vote > 0).sum(1), (vote == 2).sum(1)
    p = np.where(cast > 0, (positive + 0.1) / (cast + 0.5), 0.05)
    p = np.where((positive > 0) & (p < 0.5), 0.5 + p / 2, p)
    p = np.where(vote[:, -1] == 0, p, np.where(vote[:, -1] == 2, 0.99, 0.01))
    told = {"0", "1"} <= {x[-1] for x in names}
    for k in range(rounds):
        mass = np.where(vote[:, -1] > 0, count, 0.0) if told and k == 0 else count
        prior = np.clip((mass * p).sum() / mass.sum(), 1e-4, 1 - 1e-4)
        odds = np.full(len(names), math.log(prior / (1 - prior)))
        for j in range(vote.shape[1] - 1):
            yes = np.array([(mass * p)[vote[:, j] == v].sum() + 0.5 for v in range(3)])
            no = np.array([(mass * (1 - p))[vote[:, j] == v].sum() + 0.5 for v in range(3)])
            odds += np.where(vote[:, j] > 0, (np.log(yes / yes.sum()) - np.log(no / no.sum()))[vote[:, j]], 0.0)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        p = np.where(vote[:, -1] == 0, p, np.where(vote[:, -1] == 2, 0.99, 0.01))
    return dict(zip(names, p.tolist()))


#: Answers are summed up in whole parts of this size, so that sums are the same in any order.
PARTS = 1 << 32


def entries(column: pa.Array) -> list[np.ndarray]:
    """The features of each row, from what ``train`` stores."""
    return [np.frombuffer(b, dtype=np.int32) for b in column.to_pylist()]


def summed(rows: DataFrame, answers: Callable[[pa.RecordBatch, list[np.ndarray]], dict[str, np.ndarray]]) -> DataFrame:
    """For each question and feature, in how many rows with an answer it is (``n``), and the sum of
    their answers in ``PARTS`` (``yes``). ``answers`` gives each row's for each question, between 0 and 1, or not
    a number. Tasks send a row at most for each feature that they saw; no task holds more than sums and a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, yes = ({q: np.zeros(FEATURES, kind) for q in QUESTIONS} for kind in (np.int32, np.int64))
        for part in (part for batch in batches for part in by_bytes(batch)):
            x = entries(part.column("x"))
            for q, y in answers(part, x).items():
                for r, one in zip(x, y):
                    if one == one:
                        n[q][r] += 1
                        yes[q][r] += round(one * PARTS)
        for q in QUESTIONS:
            live = np.flatnonzero(n[q])
            for at in range(0, len(live), 1 << 16):
                some = live[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(some)), pa.array(some), pa.array(n[q][some].astype(np.int64)), pa.array(yes[q][some])], names=["question", "feature", "n", "yes"])

    return rows.mapInArrow(run, "question string, feature bigint, n bigint, yes bigint").groupBy("question", "feature").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes"))


def associated(n: np.ndarray, yes: np.ndarray, rows: int, positive: float, sure: float = 2.5, least: float = 1.0) -> np.ndarray:
    """Which features go with the answer 1, from the rows and the sum of answers of each, and of all: the log
    ratio of their rates in both classes, less ``sure`` standard errors, passes ``least``."""
    no = n - yes
    ratio = np.log((yes + 0.5) / (positive + 1)) - np.log((no + 0.5) / (rows - positive + 1))
    return ratio - sure * np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5)) > least


def chosen_features(rows: DataFrame, answers: Callable, seen: int = 0) -> dict[str, np.ndarray]:
    """The features associated with each question's answer 1, in order, that occur with a sum of answers of ``seen`` at least,
    and the constant, which always counts and which every row has; nothing for a question without answers."""
    sums = cut(summed(rows, answers))
    total = {r.question: (r.n, r.yes / PARTS) for r in sums.where(F.col("feature") == FEATURES - 1).collect()}  # two rows at most

    def good(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, yes = batch.column("n").to_numpy(), batch.column("yes").to_numpy() / PARTS
        out = batch.column("feature").to_numpy() == FEATURES - 1
        of = np.array(batch.column("question").to_pylist())
        for q, (count, positive) in total.items():
            out |= (of == q) & (yes >= seen) & associated(n, yes, count, positive)
        return batch.select(["question", "feature"]).filter(pa.array(out))

    found = over_batches(sums, good, "question string, feature bigint").collect()  # a row for each such feature
    return {q: np.array(sorted(r.feature for r in found if r.question == q), dtype=np.int64) for q in total}


def among(chosen: np.ndarray, x: list[np.ndarray]) -> list[np.ndarray]:
    """Of each row, the places in ``chosen`` of those of its features that are there."""
    joined = np.concatenate(x) if x else np.zeros(0, np.int32)
    at = np.minimum(np.searchsorted(chosen, joined), len(chosen) - 1)
    hit = chosen[at] == joined
    return np.split(at[hit].astype(np.int32), np.cumsum(np.bincount(np.repeat(np.arange(len(x)), [len(r) for r in x]), weights=hit, minlength=len(x)))[:-1].astype(int))


def fit(rows: list[np.ndarray], target: np.ndarray, steps: int = 60_000, alpha: float = 0.3, l1: float = 0.05, l2: float = 0.5) -> np.ndarray:
    """Weights of a logistic scorer by follow-the-regularised-leader, sparse by its l1 term. Features are
    numbered from 0. The same rows in the same order give the same weights."""
    z, n = np.zeros((2, max((int(x.max()) + 1 for x in rows if len(x)), default=0)))
    for _ in range(max(4, min(60, steps // max(1, len(rows))))):
        for x, y in zip(rows, target):
            zx, root = z[x], np.sqrt(n[x])
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((1 + root) / alpha + l2))
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, w.sum())))) - y
            z[x] = zx + g - (np.sqrt(n[x] + g * g) - root) / alpha * w
            n[x] += g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / alpha + l2))


#: A weight for each feature, by question; none if there was nothing to learn from.
Weights = dict[str, np.ndarray]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Weights:
    """Scorers for both questions from documents and human labels (``id_col``, ``quality``, ``toxic``;
    0, 1 or null; the larger of repeated labels counts).

    Vote patterns are counted over all documents, null texts as empty. Word lists and scorers are fitted
    on at most ``sample`` documents, those with human labels first; of rows with one id, the least text
    counts; rows without an id are voted on, not fitted on. Features are summed up and chosen in many tasks;
    one task fits the scorers, on what the sample has of the chosen features. Without documents there are
    no weights and nothing is rejected. Very long texts are taken apart whole, a row at a time.
    """
    spark = docs.sparkSession
    given = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((1 - F.max("quality")).alias("low"), F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    human = lambda c: F.coalesce(F.col(c).cast("int").cast("string"), F.lit("-"))
    marked = lambda df: df.join(given, "id", "left").withColumns({q: human(q) for q in QUESTIONS})

    unlabelled = ((F.col("low") == "-") & (F.col("toxic") == "-")).cast("int")
    ids = rows.where("id is not null").select("id").distinct()
    chosen = marked(ids).select("id", "low", "toxic", F.xxhash64("id").alias("place"), unlabelled.alias("last")).orderBy("last", "place", "id").limit(sample)
    sampled = rows.join(F.broadcast(chosen.drop("last")), "id").groupBy("id", "low", "toxic", "place").agg(F.min("text").alias("text"))

    def featured(batch: pa.RecordBatch) -> dict[str, list]:
        texts = as_bytes(batch.column(4))
        p = parse(texts)
        out = {n: batch.column(i).to_pylist() for i, n in enumerate(("id", "low", "toxic", "place"))}
        return out | {"shape": shape_votes(p.shape), "x": [x.astype(np.int32).tobytes() for x in distinct(p, len(texts))]}

    fitted_on = cut(over_batches(sampled, featured, f"id {kind}, low string, toxic string, place bigint, shape string, x binary", PIECE))

    def told(batch: pa.RecordBatch, x: list[np.ndarray]) -> dict[str, np.ndarray]:
        return {q: np.array([{"0": 0.0, "1": 1.0}.get(v, np.nan) for v in batch.column(q).to_pylist()]) for q in QUESTIONS}

    found = chosen_features(fitted_on.select("low", "toxic", "x"), told, SEEN)
    mined = spark.sparkContext.broadcast({q: of[of < FEATURES - BINS] for q, of in found.items()})

    def vote(batch: pa.RecordBatch) -> dict[str, list]:
        texts = as_bytes(batch.column(1))
        p = parse(texts)
        entry = np.unique(p.text * FEATURES + p.feature)
        cast = list_votes(_kept(mined, to_lists), len(texts), entry // FEATURES, entry % FEATURES)
        return {"id": batch.column(0).to_pylist(), "low_votes": [a + b for a, b in zip(shape_votes(p.shape), cast["low"])], "toxic_votes": cast["toxic"]}

    voted = marked(over_batches(rows, vote, f"id {kind}, low_votes string, toxic_votes string", PIECE))
    counts = voted.groupBy("low_votes", "toxic_votes", "low", "toxic").count().collect()  # one row for each pattern that occurs
    belief = {}
    for q in QUESTIONS:
        total: dict[str, int] = {}
        for r in counts:
            key = r[f"{q}_votes"] + r[q]
            total[key] = total.get(key, 0) + r["count"]
        belief[q] = posteriors(sorted(total.items()))

    def believed(batch: pa.RecordBatch, x: list[np.ndarray]) -> dict[str, np.ndarray]:
        cast = list_votes(_kept(mined, to_lists), len(x), np.repeat(np.arange(len(x)), [len(r) for r in x]), np.concatenate(x))
        shape = batch.column("shape").to_pylist()
        own = {"low": [a + b for a, b in zip(shape, cast["low"])], "toxic": cast["toxic"]}
        return {q: np.array([belief[q].get(v + h, 0.5) for v, h in zip(own[q], batch.column(q).to_pylist())]) for q in QUESTIONS}

    chosen_of = spark.sparkContext.broadcast(chosen_features(fitted_on.select("low", "toxic", "shape", "x"), believed))

    def lessened(batch: pa.RecordBatch) -> dict[str, list]:
        x = entries(batch.column("x"))
        y, out = believed(batch, x), {"id": batch.column("id").to_pylist(), "place": batch.column("place").to_pylist()}
        for q in QUESTIONS:
            out |= {f"{q}_y": y[q], f"{q}_x": [r.tobytes() for r in among(chosen_of.value[q], x)]}
        return out

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "id"])
        out = []
        for q in QUESTIONS:
            w = fit([np.frombuffer(b, dtype=np.int32) for b in pdf[f"{q}_x"]], pdf[f"{q}_y"].to_numpy())
            live = np.flatnonzero(w)
            out.append(pd.DataFrame({"question": q, "feature": chosen_of.value[q][live], "weight": w[live]}))
        return pd.concat(out)

    less = over_batches(fitted_on, lessened, f"id {kind}, place bigint, low_y double, toxic_y double, low_x binary, toxic_x binary").withColumn("one", F.lit(0))
    learnt = less.groupBy("one").applyInPandas(learn, "question string, feature bigint, weight double").collect()  # at most a row for each feature
    weights = {}
    for q in QUESTIONS:
        if of := [r for r in learnt if r.question == q]:
            weights[q] = np.zeros(FEATURES, np.float32)
            weights[q][[r.feature for r in of]] = [r.weight for r in of]
    return weights


def _kept(shared, make):  # noqa: ANN001, ANN202
    """What ``make`` makes of a broadcast value, made once in a worker and gone with the value."""
    value = shared.value
    if "made" not in value:
        value["made"] = make({k: v for k, v in value.items()})
    return value["made"]


def log_odds(weights: Weights, texts: list[bytes]) -> dict[str, np.ndarray]:
    """For both questions, the log odds of each text; minus 30 without weights and for empty texts."""
    p, n = parse(texts), len(texts)
    out = {q: np.full(n, -30.0) for q in QUESTIONS}
    some = np.array([len(t) > 0 for t in texts], dtype=bool)
    for q, w in weights.items():
        live = w[p.feature] != 0
        entry = np.unique(p.text[live] * FEATURES + p.feature[live])
        s = np.bincount(entry // FEATURES, weights=w[entry % FEATURES], minlength=n)
        out[q] = np.where(some, np.clip(s, -30, 30), -30.0)
    return out


def score(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id as ``id``, ``quality`` and ``toxic`` (probabilities) and ``keep``,
    true unless the text is rather low in quality or toxic than not. Null and empty texts are kept with
    quality 1 and toxicity 0: nothing speaks against them. Null and repeated ids give their rows; an
    empty table gives none. One pass without a shuffle; the weights are bounded by the number of
    hashed features."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def one(batch: pa.RecordBatch) -> dict[str, list]:
        s = log_odds(shared.value, as_bytes(batch.column(1)))
        p = {q: np.where(x > -30, 1 / (1 + np.exp(-x)), 0.0) for q, x in s.items()}
        return {"id": batch.column(0).to_pylist(), "quality": 1 - p["low"], "toxic": p["toxic"], "keep": (p["low"] < 0.5) & (p["toxic"] < 0.5)}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return over_batches(rows, one, f"id {dict(rows.dtypes)['id']}, quality double, toxic double, keep boolean", PIECE)


def filter_documents(docs: DataFrame, weights: Weights, text_col: str = "text") -> DataFrame:
    """The rows that ``score`` keeps, with all their columns: null and empty texts, null and repeated ids
    included; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("boolean")
    def stays(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, dtype=bool)]
        for part in by_bytes(pa.RecordBatch.from_arrays([texts], names=["text"]), PIECE):
            s = log_odds(shared.value, as_bytes(part.column(0)))
            out.append(np.all([x < 0 for x in s.values()], axis=0))
        return pa.array(np.concatenate(out))

    return docs.where(stays(F.col(text_col).cast("string")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with their scores."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).where("keep").withColumnRenamed("id", "doc_id")


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
