"""Metrics: frequencies, votes, verdicts, classification reports, retrieval hits, matchings."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.tables import cut

# The verdicts, the levels of utility, the shares of the summary.
VERDICTS = ("Supported", "Refuted", "Not Enough Evidence", "Conflicting Evidence/Cherrypicking")
LEVELS = (0.1, 0.2, 0.25, 0.3, 0.4, 0.5)
PERCENTS = (0.1, 0.2, 0.5, 0.75, 0.9, 0.95, 0.995, 0.999)


def frequencies(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n"))


def majority(df: DataFrame, by: list[str], label: str, order: str) -> DataFrame:
    """The most frequent label of each group; among equals the one seen first."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*by).agg(F.min(F.struct(-F.col("_n"), F.col("_first"), F.col(label))).alias("_m")).select(*by, F.col(f"_m.{label}").alias(label))


def confusion(df: DataFrame, gold: str, predicted: str, labels: tuple[str, ...] = VERDICTS) -> DataFrame:
    """One row for each gold label and one count column for each predicted label."""
    return df.groupBy(gold).agg(*[F.count(F.when(F.col(predicted) == x, 1)).alias(f"n{i}") for i, x in enumerate(labels)])


def f1_report(df: DataFrame, gold: str, predicted: str, labels: tuple[str, ...] = VERDICTS) -> DataFrame:
    """Precision, recall and F1 of each label, and their plain means as label "macro"; 0 where nothing
    was predicted or nothing is gold. One aggregation to a single row, whatever the input."""
    sums = []
    for i, x in enumerate(labels):
        g, p = F.col(gold) == x, F.col(predicted) == x
        sums += [F.count(F.when(g & p, 1)).alias(f"tp{i}"), F.count(F.when(p, 1)).alias(f"p{i}"), F.count(F.when(g, 1)).alias(f"g{i}")]
    one = df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"p{i}").alias("p"), F.col(f"g{i}").alias("g")) for i, x in enumerate(labels)])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    each = one.select(F.inline(rows)).select("label", ratio("tp", "p").alias("precision"), ratio("tp", "g").alias("recall"), F.when(F.col("p") + F.col("g") > 0, 2 * F.col("tp") / (F.col("p") + F.col("g"))).otherwise(F.lit(0.0)).alias("f1"))
    macro = each.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")).select(F.lit("macro").alias("label"), "precision", "recall", "f1")
    return each.unionByName(macro).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def accuracy(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.agg(F.round(F.avg((F.col(gold) == F.col(predicted)).cast("double")), 6).alias("accuracy"))


def values_at(df: DataFrame, value: str, ranks: list[int]) -> dict[int, float]:
    """The values at 0-based ranks in ascending order, nulls left out: {rank: value}.

    Equal values are counted before they are dealt to ranges of values; the sums of the ranges (one row
    for each partition at the driver) tell which of them hold the ranks, and only these are read again.
    No task gets all values, and none a value more than once.
    """
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    # The limits of ranges come from a sample, so the ranged values are written: both passes see the same.
    ranged = cut(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_v").withColumn("_p", F.spark_partition_id()))
    before, wanted = 0, {}
    for r in ranged.groupBy("_p").agg(F.sum("_n").alias("n")).orderBy("_p").collect():
        for at in ranks:
            if before <= at < before + r.n:
                wanted.setdefault((r._p, before), []).append(at)
        before += r.n
    if not wanted:
        return {}
    end = F.sum("_n").over(Window.partitionBy("_p").orderBy("_v"))
    held = ranged.where(F.col("_p").isin([p for p, _ in wanted])).withColumn("_end", end)
    hit = reduce(or_, [(F.col("_p") == p) & (F.col("_end") > at - base) & (F.col("_end") - F.col("_n") <= at - base) for (p, base), some in wanted.items() for at in some])
    got = held.where(hit).collect()  # a row for each rank at most
    return {at: next(r._v for r in got if r._p == p and r._end - r._n <= at - base < r._end) for (p, base), some in wanted.items() for at in some}


def percentiles(df: DataFrame, value: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact percentiles, interpolated between the two neighbours; null for a column without values."""
    n = df.where(F.col(value).isNotNull()).count()
    at = [p * (n - 1) for p in shares] if n else []
    found = values_at(df, value, sorted({r for x in at for r in (math.floor(x), math.ceil(x))}))
    return [found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x)) for x in at] or [None] * len(shares)


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, standard deviation, least, interpolated percentiles and greatest, in one row. The
    percentiles are exact and found in range partitions (``values_at``)."""
    names = [f"p{x * 100:g}".replace(".", "_") for x in PERCENTS]
    got = df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    found = percentiles(df, value, PERCENTS)
    return got.select("count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], F.col("min").cast("double").alias("min"), *[F.round(F.lit(v).cast("double"), 6).alias(n) for v, n in zip(found, names)], F.col("max").cast("double").alias("max"))


def gold_rank_share(ranked: DataFrame, gold: DataFrame, by: list[str], item: str) -> DataFrame:
    """For each group the mean of rank / documents over its gold items; null where it has none ranked."""
    total = ranked.groupBy(*by).agg(F.count("*").alias("_n"))
    found = ranked.join(gold.select(*by, item).distinct(), [*by, item]).groupBy(*by).agg(F.avg("rank").alias("_r"))
    return total.join(found, by, "left").select(*by, F.round(F.col("_r") / F.col("_n"), 6).alias("share"))


def hits_at(ranked: DataFrame, gold: DataFrame, by: list[str], item: str, ks: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Per cut-off: groups with any gold item in the first k, with all of them, gold items found, and
    the two denominators."""
    want = gold.select(*by, item).distinct()
    joined = want.join(ranked.select(*by, item, "rank"), [*by, item], "left")
    per = joined.groupBy(*by).agg(F.count("*").alias("_g"), *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"_h{k}") for k in ks])
    aggs = [F.array(*[F.struct(F.lit(k).alias("k"), F.count(F.when(F.col(f"_h{k}") > 0, 1)).alias("any_hit"), F.count(F.when(F.col(f"_h{k}") == F.col("_g"), 1)).alias("all_hit"), F.coalesce(F.sum(f"_h{k}"), F.lit(0)).alias("items_hit"), F.count("*").alias("claims"), F.coalesce(F.sum("_g"), F.lit(0)).alias("items")) for k in ks]).alias("r")]
    return per.agg(*aggs).select(F.inline("r"))


def entailed(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Whether any chunk of a group entails (label 2)."""
    return df.groupBy(*by).agg(F.coalesce(F.bool_or(F.col(label) == 2), F.lit(False)).alias("entailed"))


def completeness(total: Column, answered: Column, no_information: Column) -> Column:
    """Complete if something was answered, over 0.8 of the questions were, and under 0.3 of the answers
    say nothing."""
    return (answered > 0) & (answered / F.greatest(total, F.lit(1)) > 0.8) & (no_information / F.greatest(answered, F.lit(1)) < 0.3)


def verdict_fold(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Folds the judgements of a group: any without evidence or conflicting gives not enough; only true
    or only false ones their verdict; both are conflicting; no judgements, not enough."""
    has = lambda *xs: F.coalesce(F.bool_or(F.col(label).isin(*xs)), F.lit(False))
    got = df.groupBy(*by).agg(has(VERDICTS[2], VERDICTS[3]).alias("_u"), has(VERDICTS[0]).alias("_t"), has(VERDICTS[1]).alias("_f"))
    verdict = F.when(F.col("_u") | (~F.col("_t") & ~F.col("_f")), VERDICTS[2]).when(F.col("_t") & F.col("_f"), VERDICTS[3]).when(F.col("_t"), VERDICTS[0]).otherwise(VERDICTS[1])
    return got.select(*by, verdict.alias("verdict"))


def thresholded(df: DataFrame, utility: str, correct: Column, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """At each level the share of rows that are correct with a utility above it."""
    aggs = F.array(*[F.struct(F.lit(x).alias("level"), F.round(F.avg(F.when(correct & (F.col(utility) > x), 1.0).otherwise(0.0)), 6).alias("score")) for x in levels])
    return df.agg(aggs.alias("r")).select(F.inline("r"))


def score_by_type(df: DataFrame, types: str, utility: str, threshold: float) -> DataFrame:
    """Mean utility of each claim type, counting those up to the threshold as 0; a claim counts for each
    of its types."""
    return df.select(F.explode(types).alias("type"), F.when(F.col(utility) > threshold, F.col(utility)).otherwise(0.0).alias("_u")).groupBy("type").agg(F.round(F.avg("_u"), 6).alias("score"))


def assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight matching of rows to columns by the Hungarian method with potentials; any shape."""
    w = np.asarray(weights, dtype=float)
    if w.size == 0:
        return []
    flip = w.shape[0] > w.shape[1]
    cost = -(w.T if flip else w)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < least[free]
            least[free[better]] = now[better]
            way[free[better]] = j0
            j1 = int(free[np.argmin(least[free])])
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def matching_utility(pairs: DataFrame, by: str, predicted: str, gold: str, score: str, limit: int = 10) -> DataFrame:
    """For each group the weight of the best matching of its first ``limit`` predictions to gold items,
    over the number of gold items: ``utility``, 0 without gold. Groups are one claim's lists."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot_table(index=predicted, columns=gold, values=score, aggfunc="max", fill_value=0.0).sort_index().iloc[:limit]
        got = sum(grid.to_numpy()[i, j] for i, j in assign(grid.to_numpy()))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "utility": [round(float(got) / max(1, grid.shape[1]), 6)]})

    kind = dict(pairs.dtypes)[by]
    return pairs.groupBy(by).applyInPandas(one, f"{by} {kind}, utility double")
