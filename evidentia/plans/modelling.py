"""Queries around models: prompts, contexts, encoder inputs, stop criteria, and answers by a stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions.scorers import all_stopped, embed_once, encoder_inputs, with_model, without_repeated_bigrams
from evidentia.operators import rank as R
from evidentia.operators.joins import positional
from evidentia.plans.base import query, t, tok
from evidentia.plans.retrieval import CHUNKS, PAIRS, scored_chunks

SHOTS = [("Is it so?", "Yes", "It is so."), ("When was it?", "In 2020", "It was in 2020.")]
NL = "chr(10)"


def quoted(x: str) -> str:
    """Python text as a SQL expression."""
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SHOWN = quoted(T.STATEMENT_TASK + "".join(f"Question: {q}\nAnswer: {a}\nStatement: {s}\n\n" for q, a, s in SHOTS) + "Question: ")
PAIRED = "(select conv_id, turn, text as question, lead(text) over (partition by conv_id order by turn) as answer, role, lead(role) over (partition by conv_id order by turn) as next_role from conversations)"


def answered(s, d):
    """User turns with the assistant turn that follows."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t(s, d, "conversations").withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return rows.where("role = 'user' and next_role = 'assistant'").withColumnRenamed("text", "question")


@query(f"select conv_id, turn, md5({SHOWN} || question || {NL} || 'Answer: ' || answer || {NL} || 'Statement:') as prompt from {PAIRED} where role = 'user' and next_role = 'assistant'")
def statement_prompts(s, d):
    """M3: prompts that turn a question and its answer into a statement."""
    return answered(s, d).select("conv_id", "turn", F.md5(T.statement_prompt(F.col("question"), F.col("answer"), SHOTS)).alias("prompt"))


ASK = "Does the context entail the statement?\n\n"
TOP3 = f"{CHUNKS}, {PAIRS}, top as (select *, row_number() over (partition by claim_id order by score desc, doc_id, chunk) as rank from pairs), best as (select claim_id, string_agg(body, chr(10) || chr(10) order by rank desc) as ctx from top where rank <= 3 group by claim_id)"


def contexts(s, d):
    """The three best chunks of every claim, the best first."""
    top = R.top_k(scored_chunks(s, d), ["claim_id"], [F.desc("score"), F.asc("doc_id"), F.asc("chunk")], 3)
    return top.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "body"))), lambda x: x["body"]).alias("contexts")).join(t(s, d, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim")), "claim_id")


@query(f"with recursive {TOP3} select claim_id, md5({quoted(ASK + 'Context:' + chr(10))} || ctx || {quoted(chr(10) + chr(10) + 'Statement:' + chr(10))} || text || {quoted(chr(10) + chr(10) + 'Entailment:' + chr(10))}) as prompt, (case when claim_id % 4 = 0 then null else (claim_id % 4 - 1) end)::int as label from best join benchmark on item_id = claim_id")
def entailment_prompts(s, d):
    """M4: entailment prompts over the best contexts, reversed, and the class of an answer's label."""
    said = F.concat(F.lit(" "), F.get(F.array(F.lit("Unsure"), *map(F.lit, T.ENTAILMENT_LABELS)), (F.col("claim_id") % 4).cast("int")), F.lit(" ###"))
    return contexts(s, d).select("claim_id", F.md5(T.entailment_prompt(F.col("contexts"), F.col("claim"), ASK, [])).alias("prompt"), T.entailment_class(said).alias("label"))


def last_words():
    """Stands for a chat model: the last word of the prompt; fails for prompts of an odd length."""

    def answer(pdf):
        if (pdf["prompt"].str.len() % 2 == 1).any():
            raise ValueError("refused")
        return pdf["prompt"].str.split(" ").str[-1]

    return answer


@query(f"with recursive {TOP3}, p as (select claim_id, ctx || chr(10) || text as prompt from best join benchmark on item_id = claim_id) select claim_id, case when length(prompt) % 2 = 1 then '' else list_last(string_split(prompt, ' ')) end as answer, length(prompt) % 2 = 1 as failed from p")
def context_answers(s, d):
    """Answers over the best contexts joined in reverse; an empty text where the model fails."""
    asked = contexts(s, d).select("claim_id", F.concat(F.array_join(F.reverse("contexts"), "\n\n"), F.lit("\n"), "claim").alias("prompt"))
    even, odd = asked.where(F.length("prompt") % 2 == 0), asked.where(F.length("prompt") % 2 == 1)
    said = with_model(even, last_words, ["prompt"], "answer", "string").unionByName(with_model(odd, last_words, ["prompt"], "answer", "string", attempts=2, pause=0.0))
    return said.select("claim_id", F.coalesce("answer", F.lit("")).alias("answer"), F.col("answer_error").isNotNull().alias("failed"))


def lengths():
    """Stands for an embedding model."""

    def embed(pdf):
        return pdf["text"].map(lambda x: [float(len(x)), float(x.count(" "))])

    return embed


@query("select conv_id, turn, length(text)::double as characters, (length(text) - length(replace(text, ' ', '')))::double as blanks from conversations")
def embedded_turns(s, d):
    """M7: vectors of texts, each distinct text embedded once."""
    got = embed_once(t(s, d, "conversations").select("conv_id", "turn", "text"), "text", lambda x: with_model(x, lengths, ["text"], "vector", "array<double>"))
    return got.select("conv_id", "turn", F.col("vector")[0].alias("characters"), F.col("vector")[1].alias("blanks"))


@query(f"""with c as (select doc_id, list_transform({tok('text')}, lambda w: length(w))[:400] as ids, (row_number() over (order by doc_id) - 1) // 8 as batch from documents),
m as (select batch, max(len(ids)) as longest from c group by batch)
select doc_id, len(ids)::int as n, longest::int as padded, md5(array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda x: 0)), ' ')) as input_ids from c join m using (batch)""")
def encoder_batches(s, d):
    """Token ids cut to 400 and padded to the longest of their batch of eight."""
    docs = R.ordinal(t(s, d, "documents").select("doc_id", F.transform(T.tokens(F.col("text")), lambda w: F.length(w)).alias("ids")), [F.asc("doc_id")], "o")
    got = encoder_inputs(docs.withColumn("batch", F.floor(F.col("o") / 8)), "ids", "batch")
    return got.select("doc_id", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n"), F.size("input_ids").alias("padded"), F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ")).alias("input_ids"))


@query("select conv_id, bool_and(contains(text, '.') or contains(text, 'q')) as any_character, bool_and(contains(text, '. ')) as an_item from conversations group by conv_id")
def stop_criterion(s, d):
    """Whether all outputs hold a stop item; a string stands for its characters."""
    got = t(s, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("x"))
    return got.select("conv_id", all_stopped(F.col("x"), ".q").alias("any_character"), all_stopped(F.col("x"), [". "]).alias("an_item"))


@query(f"""with w as (select conv_id, turn, {tok('text')} as w from conversations), p as (select conv_id, turn, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as p from w)
select conv_id, count(*)::int as n, count(*) filter (len(list_distinct(p)) = len(p))::int as kept from p group by conv_id""")
def beam_outputs(s, d):
    """M2: of several outputs, those without a repeated pair of tokens."""
    got = t(s, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("x"))
    return got.select("conv_id", F.size("x").alias("n"), F.size(without_repeated_bigrams(F.col("x"))).alias("kept"))


@query(f"with recursive {CHUNKS}, {PAIRS} select claim_id, doc_id, chunk, score from pairs order by score desc, claim_id, doc_id, chunk limit 25")
def n_best_examples(s, d):
    """The 25 examples of the highest utility."""
    return R.n_best(scored_chunks(s, d).select("claim_id", "doc_id", "chunk", "score"), "score", ["claim_id", "doc_id", "chunk"], 25)


@query("select x.item_id, y.item_id as other from (select item_id, row_number() over (order by item_id) as o from benchmark) x join (select item_id, row_number() over (order by text, item_id) as o from benchmark) y using (o)")
def positional_join(s, d):
    """Two tables row by row, on ordinals of stated orders."""
    b = t(s, d, "benchmark")
    left = R.ordinal(b.select("item_id"), [F.asc("item_id")], "o")
    right = R.ordinal(b.select(F.col("item_id").alias("other"), "text"), [F.asc("text"), F.asc("other")], "o").drop("text")
    return positional(left, right, "o").select("item_id", "other")


@query("select user_id, round(avg(value), 6) as mean, count(*) as steps from events group by user_id")
def step_means(s, d):
    """Means over the steps of each run."""
    return t(s, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("steps"))
