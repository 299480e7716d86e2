"""Evidence: search plans, answer checks, rounds, merging and recycling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators.joins import lookup
from evidentia.operators.metrics import completeness
from evidentia.operators.rank import best_by, best_supported


def search_plan(claims: DataFrame, claim_id: str, claim: str, author: str, questions: str, pages: int) -> DataFrame:
    """One row for each search: the claim with its author (if it has one), the claim, the claim as it
    stands, and every question, each for ``pages`` pages of results."""
    kinds = F.concat(
        F.filter(F.array(F.struct(F.lit("claim+author").alias("kind"), F.when(F.col(author).isNotNull(), T.search_string(F.col(claim), F.col(author))).alias("search"))), lambda x: x["search"].isNotNull()),
        F.array(F.struct(F.lit("claim").alias("kind"), T.search_string(F.col(claim)).alias("search")), F.struct(F.lit("claim-noformat").alias("kind"), F.col(claim).alias("search"))),
        F.transform(F.coalesce(F.col(questions), F.array().cast("array<string>")), lambda q: F.struct(F.lit("question").alias("kind"), q.alias("search"))),
    )
    return claims.select(claim_id, F.posexplode(kinds).alias("s_idx", "_k")).select(claim_id, "s_idx", "_k.kind", "_k.search", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"))


def store_ids(hits: DataFrame, claim_id: str, link: str, order: str) -> DataFrame:
    """Every hit with the number of its link in its claim, in order of the links' first hits."""
    first = F.min(order).over(Window.partitionBy(claim_id, link))
    return hits.withColumn("_first", first).withColumn("store_id", F.dense_rank().over(Window.partitionBy(claim_id).orderBy("_first")) - 1).drop("_first")


def check_responses(questions: DataFrame, candidates: str, answers: str) -> DataFrame:
    """The answer kept for each question: the best supported one with its chunk; else the first that says
    there is no information, without a chunk; else none. ``retained`` is 1 where one is kept."""
    best, nothing = best_supported(F.col(candidates)), T.first_without_information(F.col(answers))
    return (
        questions.withColumn("_b", best)
        .withColumn("_n", nothing)
        .withColumn("answer", F.when(F.col("_b").isNotNull(), F.get(F.col(answers), F.col("_b.index"))).when(F.col("_n").isNotNull(), F.get(F.col(answers), F.col("_n").cast("int"))))
        .withColumn("chunk_idx", F.col("_b.chunk").cast("int"))
        .withColumn("retained", F.col("answer").isNotNull().cast("int"))
        .drop("_b", "_n")
    )


def collect_all(questions: DataFrame) -> DataFrame:
    """Every question (claim_id, q_idx, question, answer, urls, chunk_idx) with its answer, the fixed
    text where there is none, and the address of its chunk."""
    return questions.select("claim_id", "q_idx", "question", F.coalesce(T.canonical_answer(F.col("answer")), F.lit(T.NO_ANSWER)).alias("answer"), lookup(F.col("urls"), F.col("chunk_idx")).alias("url"))


def collect_answered(questions: DataFrame) -> DataFrame:
    """The same for questions with an answer only."""
    return collect_all(questions.where("answer is not null"))


def next_round(checked: DataFrame, by: str = "claim_id") -> DataFrame:
    """For each claim whether its answers complete it: (claim_id, total, answered, no_information, complete)."""
    nothing = F.coalesce(T.says_nothing(F.col("answer")), F.lit(False))
    got = checked.groupBy(by).agg(F.count("*").alias("total"), F.count("answer").alias("answered"), F.count(F.when(nothing, 1)).alias("no_information"))
    return got.withColumn("complete", completeness(F.col("total"), F.col("answered"), F.col("no_information")))


def next_set(decisions: DataFrame, similarity: DataFrame, by: str = "claim_id") -> DataFrame:
    """The question set that each incomplete claim turns to: the least similar one to those used, on
    average if they are several; sets already used do not count."""
    open_claims = decisions.where("not complete").select(by)
    mean = similarity.groupBy(by, "sample_idx").agg(F.round(F.avg("similarity"), 6).alias("similarity"))
    return best_by(mean.join(open_claims, by, "left_semi"), [by], "similarity", "sample_idx", ["sample_idx", "similarity"], least=True)


def combine_adaptive(rounds: list[DataFrame], finished: DataFrame) -> DataFrame:
    """Evidence by claim from the rounds that it ran: answered questions of its earlier rounds and all of
    the round it finished in (``finished``: claim_id, round, from 1)."""
    parts = []
    for r, questions in enumerate(rounds, 1):
        earlier = finished.where(F.col("round") > r).select("claim_id")
        here = finished.where(F.col("round") == r).select("claim_id")
        parts += [collect_answered(questions).join(earlier, "claim_id", "left_semi").withColumn("round", F.lit(r)), collect_all(questions).join(here, "claim_id", "left_semi").withColumn("round", F.lit(r))]
    return _union(parts)


def recycle(rounds: list[DataFrame], claims: DataFrame) -> DataFrame:
    """For claims that no round finished: answered questions of all rounds; where there are none, the
    fixed text for each question of the first round."""
    answered = _union([collect_answered(q).join(claims, "claim_id", "left_semi").withColumn("round", F.lit(r)) for r, q in enumerate(rounds, 1)])
    empty = claims.join(answered.select("claim_id").distinct(), "claim_id", "left_anti")
    fallback = rounds[0].join(empty, "claim_id", "left_semi").select("claim_id", "q_idx", "question", F.lit(T.NO_ANSWER).alias("answer"), F.lit("").alias("url"), F.lit(1).alias("round"))
    return answered.unionByName(fallback)


def combine_all(rounds: list[DataFrame]) -> DataFrame:
    """Answered questions of every round but the last, all questions of the last."""
    return _union([(collect_answered(q) if r < len(rounds) else collect_all(q)).withColumn("round", F.lit(r)) for r, q in enumerate(rounds, 1)])


def nested(evidence: DataFrame) -> DataFrame:
    """One row for each claim with its ordered evidence array and its size."""
    got = evidence.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("round", "q_idx", "question", "answer", "url"))).alias("_e"))
    return got.select("claim_id", F.transform("_e", lambda e: F.struct(e["question"].alias("question"), e["answer"].alias("answer"), e["url"].alias("url"))).alias("evidence"), F.size("_e").alias("n"))


def entailed_pairs(pairs: DataFrame, label: str = "label", rank: str = "rank", k: int = 3) -> DataFrame:
    """Keys (claim, question, answer) with an entailing chunk among the first ``k``."""
    return pairs.where((F.col(rank) <= k) & (F.col(label) == 2)).select("claim_id", "q_idx", "a_idx").distinct()


def gold_chunks(chunks: DataFrame, by: list[str], k: int) -> DataFrame:
    """Groups of up to ``k`` chunks keep all; larger ones keep the best ``k`` only if any chunk entails."""
    w = Window.partitionBy(*by)
    marked = chunks.withColumn("_n", F.count("*").over(w)).withColumn("_e", F.bool_or(F.col("label") == 2).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.asc("chunk_idx"))))
    return marked.where((F.col("_n") <= k) | (F.col("_e") & (F.col("rank") <= k))).drop("_n", "_e")


def parsed_questions(generations: DataFrame, text: str) -> DataFrame:
    """Generations with their parsed questions; those without one go, and sample numbers stay as they were."""
    return generations.withColumn("questions", T.parse_generated(F.col(text))).where(F.size("questions") > 0)


def merge_question_sets(greedy: DataFrame, sampled: DataFrame, by: str = "claim_id") -> DataFrame:
    """Greedy questions as set 0 beside the sampled sets."""
    return greedy.select(by, F.lit(0).alias("sample_idx"), "questions").unionByName(sampled.select(by, (F.col("sample_idx") + 1).alias("sample_idx"), "questions"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def compared_strings(questions: Column) -> Column:
    """Strings that metrics compare: question and answer, for yes-no answers the explanation behind it."""
    one = lambda q, a: F.concat(q, F.lit(" "), a["answer"], F.when((a["answer_type"] == "Boolean") & a["boolean_explanation"].isNotNull(), F.concat(F.lit(". "), a["boolean_explanation"])).otherwise(""))
    return F.flatten(F.transform(questions, lambda q: F.when(F.size(q["answers"]) > 0, F.transform(q["answers"], lambda a: one(q["question"], a))).otherwise(F.array(F.concat(q["question"], F.lit(" " + T.NO_ANSWER))))))
