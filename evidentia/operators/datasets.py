"""Instruction datasets: masking, packing, bucketing, splits, sampling, safety examples."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.rank import ordinal, running_total

MASKED = -100


def mask_labels(prompt: Column, output: Column) -> list[Column]:
    """input_ids, attention_mask and labels: the prompt is masked, the output learnt."""
    ids = F.concat(prompt, output)
    return [ids.alias("input_ids"), F.transform(ids, lambda x: F.lit(1)).alias("attention_mask"), F.concat(F.transform(prompt, lambda x: F.lit(MASKED)), output).alias("labels")]


def pack(samples: DataFrame, tokens: str, order: str, block: int) -> DataFrame:
    """Samples in order as blocks of ``block`` tokens: (block, tokens). A block goes out only once more
    tokens than it holds have come, so the last full one and any rest are dropped.

    Offsets come from sums over ordered range partitions; tokens meet only those of their own block.
    """
    placed = running_total(samples.select(F.col(order), F.col(tokens).alias("_t"), F.size(tokens).cast("bigint").alias("_n")).where("_n > 0"), [F.asc(order)], F.col("_n"), "_at")
    total = placed.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    pieces = placed.select("_at", "_t", "_n", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("_n") - 1) / block))).alias("block"))
    start = F.greatest(F.col("block") * block - F.col("_at"), F.lit(0))
    length = F.least((F.col("block") + 1) * block - F.col("_at"), F.col("_n")) - start
    cut = pieces.select("block", "_at", F.slice("_t", (start + 1).cast("int"), length.cast("int")).alias("_p"))
    kept = cut.join(F.broadcast(total), F.col("block") < F.greatest(F.ceil(F.col("_total") / block) - 1, F.lit(0)))
    return kept.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_p"))), lambda x: x["_p"])).alias("tokens"))


def length_batches(df: DataFrame, length: str, key: str, batch: int, drop_last: bool = True) -> DataFrame:
    """``df`` with ``batch_id``: neighbours in length, ties by ``key``; a short last batch is dropped if asked."""
    placed = ordinal(df, [F.asc(length), F.asc(key)], "_o").withColumn("batch_id", F.floor(F.col("_o") / batch))
    if drop_last:
        sizes = placed.groupBy("batch_id").agg(F.count("*").alias("_c")).where(F.col("_c") < batch)
        placed = placed.join(F.broadcast(sizes.select("batch_id")), "batch_id", "left_anti")
    return placed.drop("_o")


def rank_batches(batches: DataFrame, ranks: int) -> DataFrame:
    """Whole rounds of batches dealt to ``ranks`` in turn; batches past the last whole round are dropped."""
    top = batches.agg((F.floor((F.max("batch_id") + 1) / ranks) * ranks).alias("_top"))
    return batches.join(F.broadcast(top), F.col("batch_id") < F.col("_top")).drop("_top").withColumn("rank", (F.col("batch_id") % ranks).cast("int"))


def hash_order(seed: int, *keys: str) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def split(df: DataFrame, seed: int, key: str, train: float = 0.8) -> DataFrame:
    """``df`` with ``part``: train or validation by a seeded hash of the key."""
    share = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("part", F.when(share < train, "train").otherwise("validation"))


def first_as_validation(df: DataFrame, position: str, n: int = 200) -> DataFrame:
    return df.withColumn("part", F.when(F.col(position) < n, "validation").otherwise("train"))


def neutral_sample(df: DataFrame, n: int, seed: int, key: str, answer: str) -> DataFrame:
    """All rows that say no answer was found, filled up to ``n`` by a seeded sample of the others."""
    sure = F.contains(F.lower(F.col(answer)), F.lit("no answer could be found"))
    certain = df.where(sure)
    rest = df.where(~F.coalesce(sure, F.lit(False)))
    need = max(0, n - certain.count())
    return certain.unionByName(rest.orderBy(hash_order(seed, key), key).limit(need))


def explode_corrections(df: DataFrame, source: str, corrections: str) -> DataFrame:
    """One (input, target) row for each correction that is not blank."""
    return df.select(F.col(source).alias("input"), F.explode(corrections).alias("target")).where(F.length(F.trim("target")) > 0)


# The two instruction templates, without and with further input.
PLAIN = ("Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n", "\n\n### Response:")
PAIRED = (
    "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n### Instruction:\n",
    "\n\n### Input:\n",
    "\n\n### Response:",
)


def instruction(prompt: Column, context: Column) -> Column:
    """A prompt by the template with further input, or the one without if there is none."""
    paired = F.concat(F.lit(PAIRED[0]), prompt, F.lit(PAIRED[1]), context, F.lit(PAIRED[2]))
    return F.when(F.length(context) > 0, paired).otherwise(F.concat(F.lit(PLAIN[0]), prompt, F.lit(PLAIN[1])))


def safety_variants(df: DataFrame, seed: int, key: str, codes: list[str], violated: str) -> DataFrame:
    """Training variants of safety examples: the example with all categories ("all"), without a seeded
    choice of those it does not violate ("fewer"), and, if it violates any, without these too, relabelled
    safe ("relabelled"). Columns: ``variant``, ``shown`` (categories), ``label`` and ``rewritten``, the
    violated codes as their 1-based places among the shown ones in order as strings."""
    every = F.array(*map(F.lit, codes))
    bad = F.coalesce(F.col(violated), F.array().cast("array<string>"))
    drop = F.filter(every, lambda c: (~F.array_contains(bad, c)) & (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), c)), 1, 2), 16, 10).cast("int") < 128))
    row = lambda name, shown, left: F.struct(F.lit(name).alias("variant"), shown.alias("shown"), left.alias("_left"))
    none = F.array().cast("array<string>")
    variants = F.concat(F.array(row("all", every, bad), row("fewer", F.array_except(every, drop), bad)), F.when(F.size(bad) > 0, F.array(row("relabelled", F.array_except(F.array_except(every, drop), bad), none))).otherwise(F.filter(F.array(row("all", every, bad)), lambda x: F.lit(False))))
    out = df.select("*", F.explode(variants).alias("_v")).select("*", "_v.*").drop("_v")
    places = F.array_sort(F.transform("_left", lambda c: F.array_position(F.col("shown"), c).cast("string")))
    return out.withColumn("label", F.when(F.size("_left") > 0, "unsafe").otherwise("safe")).withColumn("rewritten", places).drop("_left")


#: Dataset loaders by name: (spark, path) -> DataFrame of (prompt, output).
REGISTRY: dict[str, Callable] = {}


def register(name: str) -> Callable[[Callable], Callable]:
    def put(f: Callable) -> Callable:
        REGISTRY[name] = f
        return f

    return put


def load(spark, name: str, path: str) -> DataFrame:  # noqa: ANN001
    """A registered dataset, or one from ``file.py:function``."""
    if name in REGISTRY:
        return REGISTRY[name](spark, path)
    file, _, function = name.partition(":")
    if not file.endswith(".py"):
        raise ValueError(f"no dataset {name!r}; there are {sorted(REGISTRY)}")
    spec = importlib.util.spec_from_file_location("dataset_plugin", file)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return getattr(module, function or "load")(spark, path)


def batches(df: DataFrame, strategy: str, tokens: str, key: str, size: int) -> DataFrame:
    """Training batches by strategy: "packing" into blocks or "padding" of length buckets."""
    if strategy == "packing":
        return pack(df, tokens, key, size)
    if strategy == "padding":
        return length_batches(df.withColumn("length", F.size(tokens)), "length", key, size)
    raise ValueError(f"no batching strategy {strategy!r}")
