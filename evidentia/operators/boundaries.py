"""Sentence boundaries learnt from the texts themselves: abbreviations and sentence starters by
log-likelihood ratios, after Kiss and Strunk, "Unsupervised multilingual sentence boundary detection" (2006).

A word that nearly always has a full stop behind it, and is short, is an abbreviation; a word that
follows ends of sentences far more often than it occurs is a starter. A full stop behind an
abbreviation or an initial ends a sentence only before a capitalised starter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import BLANKS, core_type, cuts, is_capitalised, word_core
from evidentia.operators.rank import small
from evidentia.operators.tables import cut

#: Least scores of abbreviations and of sentence starters, as published.
ABBREVIATION, STARTER = 0.3, 30.0
#: Words of each list at most that become part of a plan (``learn``); tables of any size: ``learn_tables``.
MOST = 5000


@dataclass(frozen=True)
class Boundaries:
    abbreviations: tuple[str, ...] = ()
    starters: tuple[str, ...] = ()


def _typed(df: DataFrame, word: str, *keep: str) -> DataFrame:
    """``type`` of each row's word and ``period``, whether a full stop is behind it. Both come from one
    core, made once in a row from an array of one."""
    once = lambda name, made: F.explode(F.array(made)).alias(name)
    core = df.select(*keep, once("_core", word_core(F.col(word))))
    return core.select(*keep, F.endswith("_core", F.lit(".")).alias("period"), once("type", core_type(F.col("_core"))))


def word_types(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per word type of all texts: ``type``, ``n_period`` (occurrences with a full stop behind
    them) and ``n_plain``. One pass; equal words are counted first, so that types are made of different
    words alone; numbers are one type."""
    words = df.select(F.explode(F.split(F.col(text), BLANKS)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    typed = _typed(words, "w", "n").where("type <> ''")
    of = lambda period: F.sum(F.when(period, F.col("n")).otherwise(0))
    return typed.groupBy("type").agg(of(F.col("period")).alias("n_period"), of(~F.col("period")).alias("n_plain"))


def _ratio(k: Column, n: Column, p: Column) -> Column:
    """Log likelihood of k of n at a probability; 0 * log 0 counts as 0."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)


def abbreviations(types: DataFrame, least: float = ABBREVIATION) -> DataFrame:
    """``type`` and ``score`` of the word types that are abbreviations: the log-likelihood ratio of a full
    stop nearly always against one as often as behind any word, less for each letter and for each
    occurrence without, more for each full stop inside."""
    totals = types.agg(F.sum(F.col("n_period") + F.col("n_plain")).alias("_n"), F.sum("n_period").alias("_p"))
    k, n = F.col("n_period").cast("double"), (F.col("n_period") + F.col("n_plain")).cast("double")
    ratio = -2 * (_ratio(k, n, F.col("_p") / F.col("_n")) - _ratio(k, n, F.lit(0.99)))
    letters = F.length(F.replace("type", F.lit("."), F.lit(""))).cast("double")
    inside = F.length("type") - letters
    score = ratio * F.exp(-letters) * (inside + 1) * F.pow(letters, -F.col("n_plain").cast("double"))
    scored = types.where("n_period > 0 and type <> '##number##'").crossJoin(F.broadcast(totals)).where("_p < _n")  # one row
    return scored.select("type", F.round(score, 6).alias("score")).where(F.col("score") >= least)


def sentence_starters(df: DataFrame, types: DataFrame, known: DataFrame, text: str = "text", least: float = STARTER) -> DataFrame:
    """``type``, ``n_after`` (occurrences capitalised behind an end of sentence) and ``score``: the
    log-likelihood ratio of following such an end, for types that do so more often than by chance.
    ``known``: the ``type`` of each abbreviation."""
    words = F.split(F.col(text), BLANKS)
    both = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = df.select(F.explode(both).alias("p")).where("p.b <> ''").where(F.rlike(F.col("p.a"), F.lit("[.!?]"))).select("p.*")
    pairs = _flagged(_typed(pairs, "a", "a", "b"), known, "_known").where(F.rlike("a", F.lit(r"[!?][^\p{L}\p{N}]*$")) | (F.col("period") & ~(F.col("_known") | _initial(F.col("type")))))
    after = _typed(pairs.select("b"), "b", "b").select("type", is_capitalised(F.col("b")).alias("capital"))
    found = after.groupBy("type").agg(F.count(F.when(F.col("capital"), 1)).alias("n_after"), F.count("*").alias("_ends"))
    totals = found.agg(F.sum("_ends").cast("double").alias("_a")).crossJoin(types.agg(F.sum(F.col("n_period") + F.col("n_plain")).cast("double").alias("_n")))
    of = found.where("type <> '' and type <> '##number##' and n_after > 0").join(types, "type").crossJoin(F.broadcast(totals)).where("_a < _n")  # one row
    a, b, ab, n = F.col("_a"), (F.col("n_period") + F.col("n_plain")).cast("double"), F.col("n_after").cast("double"), F.col("_n")
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    ratio = -2 * (_ratio(ab, a, p) + _ratio(b - ab, n - a, p) - _ratio(ab, a, p1) - _ratio(b - ab, n - a, p2))
    return of.where(p1 > p).select("type", "n_after", F.round(ratio, 6).alias("score")).where(F.col("score") >= least)


def _initial(kind: Column) -> Column:
    return F.rlike(kind, F.lit(r"^\p{L}$"))


def _flagged(df: DataFrame, types: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: whether its ``type`` is one of ``types``."""
    return df.join(small(types.select("type", F.lit(True).alias(name))), "type", "left").fillna(False, [name])


def doubtful(kind: Column, known: tuple[str, ...]) -> Column:
    """Whether a full stop behind a word of this type may not end a sentence: abbreviations and initials."""
    return _initial(kind) | (kind.isin(*known) if known else F.lit(False))


def learn_tables(df: DataFrame, text: str = "text", abbreviation: float = ABBREVIATION, starter: float = STARTER) -> tuple[DataFrame, DataFrame]:
    """Tables of the abbreviations and the sentence starters (``type``) of all texts, of any length, in two
    passes. Nothing goes through the driver."""
    types = cut(word_types(df, text))
    known = cut(abbreviations(types, abbreviation).select("type"))
    return known, cut(sentence_starters(df, types, known, text, starter).select("type"))


def going_on(df: DataFrame, text: str, known: DataFrame, starters: DataFrame) -> DataFrame:
    """``df`` with ``_on``: the numbers, from 1, of the cuts of ``functions.text.pieces`` behind which a
    sentence goes on; null if there are none. Cuts meet the learnt tables in joins, and the numbers are
    found once for equal texts."""
    key = F.md5(F.col(text).cast("binary"))
    at = df.select(key.alias("_text"), F.posexplode(cuts(F.col(text))).alias("_i", "_c")).select("_text", (F.col("_i") + 1).alias("_i"), "_c.*")
    at = _flagged(_typed(at, "before", "_text", "_i", "behind").where("period"), known, "_known")
    at = _typed(at.where(F.col("_known") | _initial(F.col("type"))).select("_text", "_i", "behind"), "behind", "_text", "_i", "behind").withColumn("_capital", is_capitalised(F.col("behind")))
    on = _flagged(at, starters, "_opens").where(~(F.col("_capital") & F.col("_opens"))).groupBy("_text").agg(F.collect_set("_i").alias("_on"))
    return df.withColumn("_text", key).join(small(cut(on)), "_text", "left").drop("_text")


def _listed(df: DataFrame, what: str) -> tuple[str, ...]:
    got = tuple(sorted(r.type for r in df.select("type").limit(MOST + 1).collect()))
    if len(got) > MOST:
        raise ValueError(f"more than {MOST} {what}: use learn_tables")
    return got


def learn(df: DataFrame, text: str = "text", abbreviation: float = ABBREVIATION, starter: float = STARTER) -> Boundaries:
    """Both lists for the plan of a column. The driver gets the lists alone, whose lengths are checked;
    ``learn_tables`` and ``going_on`` take lists of any length. An empty table gives empty lists."""
    known, starters = learn_tables(df, text, abbreviation, starter)
    return Boundaries(_listed(known, "abbreviations"), _listed(starters, "sentence starters"))
