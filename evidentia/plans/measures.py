"""Metric queries: frequencies, votes, classification reports, retrieval hits, matchings."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions.scorers import Lexical
from evidentia.operators import metrics as M
from evidentia.operators.rank import small, top_k
from evidentia.plans.base import claims, jac, query, stored, t, tok
from evidentia.plans.retrieval import CHUNKS, PAIRS, bm25_full_rank, scored_chunks
from evidentia.plans.base import ORACLE as SQL

GOLD = "case when quality = 1 and toxic = 0 then 'Supported' when quality = 0 and toxic = 0 then 'Refuted' when quality = 0 then 'Not Enough Evidence' else 'Conflicting Evidence/Cherrypicking' end"
NAMES = "['Supported', 'Refuted', 'Not Enough Evidence', 'Conflicting Evidence/Cherrypicking']"
JUDGED = f"(select doc_id, {GOLD} as gold, ({NAMES})[(n_chars % 4)::int + 1] as predicted, lang, source, n_chars from labels join documents using (doc_id))"


def judged(s, d):
    """Labelled documents with a gold verdict from their labels and a predicted one from their length."""
    q, x = F.col("quality"), F.col("toxic")
    gold = F.when((q == 1) & (x == 0), M.VERDICTS[0]).when((q == 0) & (x == 0), M.VERDICTS[1]).when(q == 0, M.VERDICTS[2]).otherwise(M.VERDICTS[3])
    predicted = F.get(F.array(*map(F.lit, M.VERDICTS)), (F.col("n_chars") % 4).cast("int"))
    return t(s, d, "labels").join(t(s, d, "documents"), "doc_id").select("doc_id", gold.alias("gold"), predicted.alias("predicted"), "lang", "source", "n_chars")


@query("select lang, count(*) as n from documents group by lang")
def frequencies(s, d):
    """A2: counts of each value."""
    return M.frequencies(t(s, d, "documents"), "lang")


@query("select conv_id, string_agg(text, '|' order by turn) as questions, count(*) as n from conversations where role = 'user' group by conv_id")
def grouped_questions(s, d):
    """A1: questions of a claim in order of appearance."""
    got = t(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("q"))
    return got.select("conv_id", F.array_join(F.transform("q", lambda x: x["text"]), "|").alias("questions"), F.size("q").cast("bigint").alias("n"))


@query("select c.conv_id, c.n, m.turns from (select conv_id, count(*) as n from conversations group by conv_id) c join (select conv_id, max(turn) + 1 as turns from conversations group by conv_id) m on c.conv_id = m.conv_id and c.n = m.turns")
def count_consistency(s, d):
    """A3: groups whose count agrees with what they state."""
    c = t(s, d, "conversations")
    return M.frequencies(c, "conv_id").join(c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turns")), "conv_id").where("n = turns")


@query("with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by all) select user_id, event_type from c qualify row_number() over (partition by user_id order by n desc, f) = 1")
def majority_vote(s, d):
    """A4: the most frequent label, the first seen among equals."""
    return M.majority(t(s, d, "events"), ["user_id"], "event_type", "event_id")


@query(f"select gold, {', '.join(f'count(*) filter (predicted = ({NAMES})[{i + 1}]) as n{i}' for i in range(4))} from {JUDGED} group by gold")
def confusion(s, d):
    """A5."""
    return M.confusion(judged(s, d), "gold", "predicted")


@query(f"""with c as (select label, count(*) filter (gold = label and predicted = label) as tp, count(*) filter (predicted = label) as p, count(*) filter (gold = label) as g from {JUDGED}, unnest({NAMES}) as u(label) group by label),
e as (select label, case when p > 0 then tp / p::double else 0 end as precision, case when g > 0 then tp / g::double else 0 end as recall, case when p + g > 0 then 2 * tp / (p + g)::double else 0 end as f1 from c)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from e union all select 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) from e""")
def f1_report(s, d):
    """A6."""
    return M.f1_report(judged(s, d), "gold", "predicted")


@query(f"select round(avg((gold = predicted)::int), 6) as accuracy from {JUDGED}")
def accuracy(s, d):
    """A7."""
    return M.accuracy(judged(s, d), "gold", "predicted")


@query("""select count(value) as count, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.2), 6) as p20, round(quantile_cont(value, 0.5), 6) as p50,
round(quantile_cont(value, 0.75), 6) as p75, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.995), 6) as p99_5, round(quantile_cont(value, 0.999), 6) as p99_9, max(value) as max from events""")
def percentile_summary(s, d):
    """A8."""
    return M.describe(t(s, d, "events"), "value")


_RANKED = f"({SQL['bm25_full_rank']})"
_GOLD = "(select claim_id, doc_id from (select doc_id % (select count(*) from benchmark) as claim_id, doc_id from documents) where doc_id in (select doc_id from labels where quality = 1))"


def gold(s, d):
    return stored(s, d).select("claim_id", "doc_id").join(t(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query(f"with r as (select * from {_RANKED}), g as (select distinct * from {_GOLD}) select r.claim_id, round(avg(r.rank) filter (g.doc_id is not null) / count(*), 6) as share from r left join g using (claim_id, doc_id) group by r.claim_id")
def gold_rank_share(s, d):
    """Mean rank of gold documents over the number of documents."""
    return M.gold_rank_share(bm25_full_rank(s, d), gold(s, d), ["claim_id"], "doc_id")


@query(f"""with r as (select * from {_RANKED}), g as (select distinct * from {_GOLD}), p as (select g.claim_id, k, count(*) as n, count(*) filter (r.rank <= k) as h from g left join r using (claim_id, doc_id), unnest([2, 5]) as u(k) group by g.claim_id, k)
select k::int as k, count(*) filter (h > 0) as any_hit, count(*) filter (h = n) as all_hit, sum(h)::bigint as items_hit, count(*) as claims, sum(n)::bigint as items from p group by k""")
def hit_at_k(s, d):
    """Claims with any and with all gold documents in the first k, and documents found."""
    return M.hits_at(bm25_full_rank(s, d), gold(s, d), ["claim_id"], "doc_id", (2, 5))


@query("select user_id, bool_or(event_id % 3 = 2) as entailed from events group by user_id")
def entailed_groups(s, d):
    """Groups with an entailing chunk."""
    return M.entailed(t(s, d, "events").withColumn("label", F.col("event_id") % 3), ["user_id"], "label")


@query("select floor(event_id / 5)::bigint as g, bool_or(event_id % 4 = 2) as entailed, count(*) as n from events group by 1")
def window_groups(s, d):
    """Groups of five consecutive rows."""
    e = t(s, d, "events").withColumn("g", F.floor(F.col("event_id") / 5))
    return e.groupBy("g").agg(F.bool_or(F.col("event_id") % 4 == 2).alias("entailed"), F.count("*").alias("n"))


@query(f"with recursive {CHUNKS}, {PAIRS}, top as (select *, row_number() over (partition by claim_id order by score desc, doc_id, chunk) as rank from pairs) select count(distinct claim_id) filter (rank <= 10 and score > 0.1) as factual, count(distinct claim_id) as claims from top")
def factuality_count(s, d):
    """Claims entailed by one of their ten best chunks."""
    top = top_k(scored_chunks(s, d), ["claim_id"], [F.desc("score"), F.asc("doc_id"), F.asc("chunk")], 10)
    return top.agg(F.count_distinct(F.when(F.col("score") > 0.1, F.col("claim_id"))).alias("factual"), F.count_distinct("claim_id").alias("claims"))


@query("select questions, supported, count(*) as n from (select conv_id, count(*) as questions, count(*) filter (role = 'user') as supported from conversations group by conv_id) group by all")
def support_crosstab(s, d):
    """Claims by questions and supported answers."""
    per = t(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("questions"), F.count(F.when(F.col("role") == "user", 1)).alias("supported"))
    return per.groupBy("questions", "supported").agg(F.count("*").alias("n"))


@query("select round(count(*) filter (role = 'user') / count(*)::double, 6) as greedy, round(count(*) filter (role = 'assistant') / count(*)::double, 6) as sampled, round(count(*) filter (role not in ('user', 'assistant')) / count(*)::double, 6) as neither from conversations")
def answer_proportions(s, d):
    """A16."""
    r, n = F.col("role"), F.count("*")
    share = lambda c: F.round(F.count(F.when(c, 1)) / n, 6)
    return t(s, d, "conversations").agg(share(r == "user").alias("greedy"), share(r == "assistant").alias("sampled"), share(~r.isin("user", "assistant")).alias("neither"))


@query(f"""with h as (select source, bool_or(predicted in ('Not Enough Evidence', 'Conflicting Evidence/Cherrypicking')) as u, bool_or(predicted = 'Supported') as t, bool_or(predicted = 'Refuted') as f from (select *, source || lang || (doc_id % 50)::varchar as k from {JUDGED}) group by source, k)
select source, case when u or (not t and not f) then 'Not Enough Evidence' when t and f then 'Conflicting Evidence/Cherrypicking' when t then 'Supported' else 'Refuted' end as verdict, count(*) as n from h group by all""")
def verdict_fold(s, d):
    """Judgements of a claim folded to its verdict."""
    rows = judged(s, d).withColumn("k", F.concat("source", "lang", (F.col("doc_id") % 50).cast("string")))
    return M.verdict_fold(rows, ["source", "k"], "predicted").groupBy("source", "verdict").agg(F.count("*").alias("n"))


@query(f"select level, round(avg(case when gold = predicted and (n_chars % 100) / 100.0 > level then 1.0 else 0 end), 6) as score from {JUDGED}, unnest([0.1, 0.2, 0.25, 0.3, 0.4, 0.5]::double[]) as u(level) group by level")
def thresholded_score(s, d):
    """Correct verdicts with enough evidence, by level."""
    return M.thresholded(judged(s, d).withColumn("u", (F.col("n_chars") % 100) / 100.0), "u", F.col("gold") == F.col("predicted"))


@query(f"select type, round(avg(case when u > 0.25 then u else 0 end), 6) as score from (select unnest([lang, source]) as type, (n_chars % 100) / 100.0::double as u from {JUDGED}) group by type")
def score_by_type(s, d):
    """Mean scores by claim type; a claim has several."""
    return M.score_by_type(judged(s, d).select(F.array("lang", "source").alias("types"), ((F.col("n_chars") % 100) / 100.0).alias("u")), "types", "u", 0.25)


@query(f"""select claim_id, doc_id, round({jac('list_distinct(' + tok('d.text') + ')', 'list_distinct(' + tok('b.text') + ')')}, 6) as score
from (select doc_id % (select count(*) from benchmark) as claim_id, doc_id, text from documents) d join benchmark b on item_id = claim_id""")
def pair_matrix(s, d):
    """Scores of every prediction against every gold string of its claim."""
    texts = stored(s, d).select("claim_id", "doc_id", "text")
    return texts.join(small(claims(s, d)), "claim_id").select("claim_id", "doc_id", F.round(Lexical().score_pairs(F.col("text"), F.col("claim")), 6).alias("score"))


@query()
def assignment_utility(s, d):
    """The best matching of predicted to gold strings in each conversation."""
    c = t(s, d, "conversations").select("conv_id", "turn", "role", "text")
    a, b = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("p"), F.col("text").alias("x")), c.where("role = 'user'").select("conv_id", F.col("turn").alias("g"), F.col("text").alias("y"))
    # A matching looks at the first ten predictions alone: the others meet no gold string.
    first = top_k(a, ["conv_id"], [F.asc("p")], 10).drop("rank")
    pairs = first.join(b, "conv_id").select("conv_id", "p", "g", F.round(Lexical().score_pairs(F.col("x"), F.col("y")), 6).alias("score"))
    return M.matching_utility(pairs, "conv_id", "p", "g", "score")


@query(f"""with p as (select conv_id, turn, list_distinct({tok('text')}) as tk, lead(list_distinct({tok('text')})) over (partition by conv_id order by turn) as nx from conversations),
h as (select conv_id, turn, len(list_intersect(tk, nx)) / greatest(len(nx), 1)::double as held, list_has_any(tk, ['no', 'not', 'never']) as denies from p where nx is not null),
q as (select conv_id, turn, round(case when denies then held / 2 else held end, 6) as p2, round(case when denies then held / 2 else 0 end, 6) as p0 from h)
select conv_id, turn, p0, round(1 - p0 - p2, 6) as p1, p2, (case when p2 > 0.5 then 2 when p0 > 0.25 then 0 else 1 end)::int as label from q""")
def nli_lexical(s, d):
    """M5, M4: the lexical stand-in for an entailment model, turn against next turn."""
    from pyspark.sql import Window

    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t(s, d, "conversations").withColumn("y", nxt).where("y is not null")
    return rows.select("conv_id", "turn", Lexical().nli(F.col("text"), F.col("y")).alias("r")).select("conv_id", "turn", "r.p0", "r.p1", "r.p2", "r.label")
