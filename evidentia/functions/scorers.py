"""Pluggable scorers: model calls behind three small contracts, with a deterministic lexical backend.

The lexical backend is Column expressions, so everything around a model can be tested without one. A
model backend wraps any Python callable: it is loaded once in a worker and called with Arrow batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.meteor import meteor_score
from evidentia.functions.text import tokens


def overlap(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token sets; 0 if both are empty."""
    both, either = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


@dataclass(frozen=True)
class Lexical:
    """Scores from shared tokens. Left is the premise or query, right the hypothesis or passage."""

    def score_pairs(self, left: Column, right: Column) -> Column:
        return overlap(F.array_distinct(tokens(left)), F.array_distinct(tokens(right)))

    def nli(self, premise: Column, hypothesis: Column) -> Column:
        """Class 2 (entails) if most hypothesis tokens are in the premise, 0 (contradicts) if some are but
        the premise denies, else 1 (neutral); with three probabilities."""
        p, h = F.array_distinct(tokens(premise)), F.array_distinct(tokens(hypothesis))
        held = F.size(F.array_intersect(p, h)) / F.greatest(F.size(h), F.lit(1))
        denies = F.arrays_overlap(p, F.array(*map(F.lit, ("no", "not", "never"))))
        p2 = F.round(F.when(denies, held / 2).otherwise(held), 6)
        p0 = F.round(F.when(denies, held / 2).otherwise(F.lit(0.0)), 6)
        label = F.when(p2 > 0.5, 2).when(p0 > 0.25, 0).otherwise(1)
        return F.struct(p0.alias("p0"), F.round(1 - p0 - p2, 6).alias("p1"), p2.alias("p2"), label.alias("label"))

    def generate(self, prompt: Column, samples: int = 1) -> Column:
        """Repeats the prompt's last line as every sample; stands for a generator in tests."""
        return F.array_repeat(F.element_at(F.split(prompt, "\n"), -1), samples)


def meteor(left: Column, right: Column) -> Column:
    """``meteor_score`` of two texts as an Arrow function: alignment has no SQL expression."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([meteor_score(list(x), list(y)) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")

    return score(tokens(left), tokens(right))


def with_model(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], inputs: list[str], output: str, kind: str, attempts: int = 10, pause: float = 0.5, longest: float = 8.0) -> DataFrame:
    """``df`` with ``output``: a model's answers to batches of ``inputs``, and ``<output>_error``, the
    message where it failed ``attempts`` times (pauses double up to ``longest`` seconds). Errors of the
    program, such as a wrong name or type, are raised at once. ``load`` runs once in a worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            wait = pause
            for left in range(attempts - 1, -1, -1):
                try:
                    yield batch.assign(**{output: model(batch[inputs]).to_numpy(), f"{output}_error": None})
                    break
                except (TypeError, LookupError, AttributeError, NameError, ImportError):
                    raise
                except Exception as e:  # noqa: BLE001
                    if left == 0:
                        yield batch.assign(**{output: None, f"{output}_error": str(e)[:500]})
                    else:
                        time.sleep(wait)
                        wait = min(2 * wait, longest)

    columns = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{columns}, `{output}` {kind}, `{output}_error` string")


def without_repeated_bigrams(outputs: Column) -> Column:
    """Of generated texts, those in which no pair of neighbouring tokens comes twice."""

    def fresh(text: Column) -> Column:
        w = tokens(text)
        pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
        return F.size(F.array_distinct(pairs)) == F.size(pairs)

    return F.filter(outputs, fresh)


def all_stopped(outputs: Column, items: list[str]) -> Column:
    """Whether every output holds some stop item; a single string given as ``items`` stands for its characters."""
    holds = lambda x: F.array_contains(F.array(*[F.contains(x, F.lit(i)) for i in items]), True)
    return F.forall(outputs, holds)


def encoder_inputs(df: DataFrame, ids: str, batch: str, most: int = 400, pad: int = 0) -> DataFrame:
    """``df`` with ``input_ids``, cut to ``most`` and padded to the longest of the ``batch``, and
    ``attention_mask``, 1 for what is not padding."""
    cut = df.withColumn("input_ids", F.slice(ids, 1, most))
    longest = cut.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_longest"))
    n = F.size("input_ids")
    both = cut.join(longest, batch).withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.col("_longest") - n)))
    return both.withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad), F.col("_longest") - n))).drop("_longest")


def embed_once(df: DataFrame, text_col: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``vector``; ``embed`` sees every distinct text once, not every row or pair."""
    distinct = df.select(F.col(text_col).alias("text")).where("text is not null").distinct()
    return df.join(embed(distinct).select(F.col("text").alias(text_col), "vector"), text_col, "left")


#: Checkers by name: a prompt or answer column in, a safe-or-not column out.
CHECKERS: dict[str, Callable[[Column], Column]] = {
    "words": lambda text: ~F.arrays_overlap(tokens(text), F.array(*map(F.lit, ("kill", "bomb", "weapon")))),
    "empty": lambda text: F.length(F.trim(text)) > 0,
}


def checked(df: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """``df`` with ``checks``: (name, is_safe, report) of every checker asked for."""
    rows = [F.struct(F.lit(n).alias("name"), CHECKERS[n](F.col(text_col)).alias("is_safe"), F.when(CHECKERS[n](F.col(text_col)), "safe").otherwise("unsafe").alias("report")) for n in names]
    return df.withColumn("checks", F.array(*rows) if rows else F.array().cast("array<struct<name:string,is_safe:boolean,report:string>>"))
