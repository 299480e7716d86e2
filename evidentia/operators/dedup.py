"""Ordered greedy removal of similar answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scorers import cosine
from evidentia.operators.rank import ranked
from evidentia.operators.tables import cut

#: Rows of a list that one task decides, or holds beside those it compares them with.
ROWS = 2048


def greedy(items: Column, threshold: Column | float, vector: str = "v", key: str | None = None) -> Column:
    """Of an ordered array of structs, those whose cosine to all kept before is under ``threshold``; the
    first always stays. With ``key``, an element whose key was kept before goes too. Cosines are rounded
    to 6 places before they are compared."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)

    def step(kept: Column, x: Column) -> Column:
        fits = F.forall(kept, lambda y: F.round(cosine(y[vector], x[vector]), 6) < limit)
        if key:
            fits = fits & ~F.exists(kept, lambda y: y[key] == x[key])
        return F.when(fits, F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(items, F.filter(items, lambda x: F.lit(False)), step)


def greedy_by_relevance(items: Column, threshold: Column | float, score: str = "score", vector: str = "v") -> Column:
    """``greedy`` from the most relevant down; returned with the least relevant first."""
    ranked = F.array_sort(items, lambda a, b: F.when(a[score] > b[score], -1).when(a[score] < b[score], 1).when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
    return F.reverse(greedy(ranked, threshold, vector))


def threshold_by_size(n: Column) -> Column:
    """0.5 from ten on, 0.8 from six, none below."""
    return F.when(n >= 10, 0.5).when(n >= 6, 0.8)


def by_policy(items: Column, vector: str = "v", again: bool = False) -> Column:
    """``greedy`` with the threshold that the number of items asks for. With ``again``, a result of six
    to nine from a first pass is filtered once more at 0.8."""
    n = F.size(items)
    first = F.when(n >= 6, greedy(items, threshold_by_size(n), vector)).otherwise(items)
    if not again:
        return first
    strict = F.when(n >= 10, greedy(items, 0.5, vector)).otherwise(items)
    return F.when(F.size(strict).between(6, 9), greedy(strict, 0.8, vector)).otherwise(strict)


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Unit vectors; a null or zero vector has no direction, and no cosine (NaN) with any other."""
    size = max((len(v) for v in vectors if v is not None), default=1)
    m = np.array([v if v is not None else np.zeros(size) for v in vectors], dtype=float).reshape(len(vectors), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def fits(rows: np.ndarray, kept: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows are less similar to all ``kept`` than the threshold, with cosines at 6 places."""
    return (np.round(rows @ kept.T, 6) < threshold).all(axis=1)


def first_fitting(m: np.ndarray, threshold: float) -> np.ndarray:
    """The places that an ordered pass over some rows keeps. Each kept row takes out those like it at once, so
    the work is that of the kept rows."""
    alive, kept = np.ones(len(m), dtype=bool), []
    for i in range(len(m)):
        if not alive[i]:
            continue
        kept.append(i)
        alive[i + 1 :] &= fits(m[i + 1 :], m[i : i + 1], threshold)
    return np.array(kept, dtype=np.int64)


def greedy_rows(df: DataFrame, by: list[str], order: str, vector: str, threshold: float, rows: int = ROWS) -> DataFrame:
    """``greedy`` over lists of any length, one row an element: ``by`` and ``order`` of the rows that stay. The
    same rows as ``greedy``; orders have to be unique in a list.

    A list is decided block by block: of each block, what the rows kept before leave over is decided in
    one task, and what it keeps is compared with every later block, all at once. So the longest list
    makes as many rounds as it has blocks, a task holds two blocks, and rows like earlier ones go early.
    """
    numbered = ranked(df.select(*by, order, F.col(vector).alias("_v")), by, [F.asc(order)], "_n").withColumn("_b", F.floor((F.col("_n") - 1) / rows).cast("int"))
    left = cut(numbered.select(*by, order, "_v", "_b"))
    last = left.agg(F.max("_b").alias("b")).first().b
    kinds = dict(left.dtypes)
    columns = [*by, order, "_v", "_b"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    kept = df.select(*by, order).limit(0)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.iloc[first_fitting(_matrix(pdf["_v"]), threshold)][columns]

    def against(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(known):
            return pdf[columns]
        size = max((len(v) for v in [*pdf["_v"], *known["_v"]] if v is not None), default=1)
        ours, theirs = (_matrix(x.map(lambda v: np.zeros(size) if v is None else v)) for x in (pdf["_v"], known["_v"]))
        return pdf[fits(ours, theirs, threshold)][columns]

    for b in range(0 if last is None else last + 1):
        decided = cut(left.where(F.col("_b") == b).groupBy(*by).applyInPandas(decide, schema))
        kept = kept.unionByName(decided.select(*by, order))
        if b < last:
            later = left.where(F.col("_b") > b)
            blocks = later.groupBy(*by, F.col("_b").alias("_to")).agg(F.lit(1).alias("_one"))
            known = decided.drop("_b").join(blocks, by).withColumn("_b", F.col("_to") + 0).select(*columns)
            left = cut(later.groupBy(*by, "_b").cogroup(known.groupBy(*by, "_b")).applyInPandas(against, schema), instead_of=left)
    return kept
