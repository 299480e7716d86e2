"""Dataset queries: masking, packing, bucketing, splits, sampling, safety examples, pages over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import datasets as B
from evidentia.operators.rank import ordinal
from evidentia.plans.base import query, t, tok
from evidentia.streaming.ingest import windowed_counts

IDS = f"list_transform({tok('text')}, lambda w: length(w)::int)"


def samples(s, d):
    """Documents as token ids: the length of each word, so that any engine gets the same."""
    return t(s, d, "documents").select("doc_id", F.transform(T.tokens(F.col("text")), lambda w: F.length(w)).alias("ids"))


@query(f"""with c as (select doc_id, {IDS} as ids from documents), p as (select doc_id, list_slice(ids, 1, 4) as a, list_slice(ids, 5, len(ids)) as b from c)
select doc_id, md5(array_to_string(list_concat(a, b), ' ')) as input_ids, len(list_concat(a, b))::int as attention, md5(array_to_string(list_concat(list_transform(a, lambda x: -100), b), ' ')) as labels from p""")
def label_mask(s, d):
    """Prompts masked in the labels, all attended to."""
    got = samples(s, d).select("doc_id", *B.mask_labels(F.slice("ids", 1, 4), F.slice("ids", F.lit(5), F.greatest(F.size("ids"), F.lit(1)))))
    joined = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " "))
    return got.select("doc_id", joined("input_ids").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attention"), joined("labels").alias("labels"))


@query(f"""with c as (select doc_id, {IDS} as ids from documents), f as (select doc_id, unnest(ids) as x, generate_subscripts(ids, 1) as i from c),
o as (select x, row_number() over (order by doc_id, i) - 1 as pos, count(*) over () as n from f)
select (pos // 512)::bigint as block, md5(string_agg(x, ' ' order by pos)) as tokens, count(*)::int as n from o where pos // 512 < greatest(ceil(n / 512.0) - 1, 0) group by 1""")
def pack_sequences(s, d):
    """Samples packed into blocks of 512."""
    got = B.batches(samples(s, d), "packing", "ids", "doc_id", 512)
    return got.select("block", F.md5(F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ")).alias("tokens"), F.size("tokens").alias("n"))


BATCHES = f"(select doc_id, n, batch_id from (select doc_id, n, floor((row_number() over (order by n, doc_id) - 1) / 16)::bigint as batch_id, count(*) over () as total from (select doc_id, len({tok('text')})::int as n from documents)) where (batch_id + 1) * 16 <= total)"


@query(f"select * from {BATCHES}")
def length_bucket(s, d):
    """Neighbours in length as batches of 16, a short last one dropped."""
    return B.batches(samples(s, d), "padding", "ids", "doc_id", 16).select("doc_id", F.col("length").alias("n"), "batch_id")


@query(f"select doc_id, batch_id, (batch_id % 3)::int as rank from {BATCHES} where batch_id < (select floor((max(batch_id) + 1) / 3) * 3 from {BATCHES})")
def rank_stride(s, d):
    """Batches dealt to three ranks in turn."""
    return B.rank_batches(length_bucket(s, d), 3).select("doc_id", "batch_id", "rank")


@query("select doc_id, case when ('0x' || md5('7:' || doc_id)[1:8])::bigint / 4294967296.0 < 0.8 then 'train' else 'validation' end as part from documents")
def seeded_split(s, d):
    """B1: four fifths by a seeded hash."""
    return B.split(t(s, d, "documents").select("doc_id"), 7, "doc_id")


@query("select doc_id, case when pos < 200 then 'validation' else 'train' end as part from (select doc_id, row_number() over (order by doc_id) - 1 as pos from documents)")
def instruction_split(s, d):
    """The first 200 rows validate."""
    return B.first_as_validation(ordinal(t(s, d, "documents").select("doc_id"), [F.asc("doc_id")], "pos"), "pos").select("doc_id", "part")


HEAD = "'Below is an instruction that describes a task'"


@query(f"""select conv_id, turn, md5(case when turn % 2 = 0 then {HEAD} || ', paired with an input that provides further context. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Input:' || chr(10) || role || chr(10) || chr(10) || '### Response:'
else {HEAD} || '. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Response:' end) as prompt from conversations""")
def instruction_prompts(s, d):
    """Instruction templates with and without an input."""
    return t(s, d, "conversations").select("conv_id", "turn", F.md5(B.instruction(F.col("text"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(""))).alias("prompt"))


@query("""with c as (select doc_id, case when toxic = 1 then 'No answer could be found.' else 'x' || quality end as answer from labels),
r as (select doc_id, row_number() over (order by md5('5:' || doc_id), doc_id) as n from c where not contains(lower(answer), 'no answer could be found'))
select doc_id, true as certain from c where contains(lower(answer), 'no answer could be found') union all
select doc_id, false from r where n <= greatest(0, 60 - (select count(*) from c where contains(lower(answer), 'no answer could be found')))""")
def neutral_sample(s, d):
    """All certain rows, filled up to 60 by a seeded sample of the others."""
    rows = t(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, T.NO_ANSWER).otherwise(F.concat(F.lit("x"), F.col("quality").cast("string"))).alias("answer"))
    return B.neutral_sample(rows, 60, 5, "doc_id", "answer").select("doc_id", (F.col("answer") == T.NO_ANSWER).alias("certain"))


@query("select role as input, target from (select role, unnest(string_split(text, '.')) as target from conversations) where length(trim(target)) > 0")
def explode_corrections(s, d):
    """One row for each correction that is not blank."""
    return B.explode_corrections(t(s, d, "conversations").withColumn("c", F.split("text", r"\.")), "role", "c")


@B.register("turns")
def turns(spark, path):
    """Each user turn as a prompt and the turn after it as the output."""
    c = spark.read.parquet(f"{path}/conversations.parquet")
    after = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("output", F.lead("text").over(after)).where("role = 'user' and output is not null").select(F.col("text").alias("prompt"), "output")


@B.register("verdicts")
def verdicts(spark, path):
    """Each labelled document as a prompt and its label as the output."""
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", F.when(F.col("toxic") == 1, "unsafe").otherwise("safe").alias("output"))
    return spark.read.parquet(f"{path}/documents.parquet").join(labels, "doc_id").select(F.col("text").alias("prompt"), "output")


@query("""select 'turns' as dataset, md5(prompt) as prompt, md5(output) as output from (select role, text as prompt, lead(text) over (partition by conv_id order by turn) as output from conversations) where role = 'user' and output is not null
union all select 'verdicts', md5(text), md5(case when toxic = 1 then 'unsafe' else 'safe' end) from documents join labels using (doc_id)""")
def registered_datasets(s, d):
    """Datasets by their registered names."""
    of = [B.load(s, name, d).select(F.lit(name).alias("dataset"), F.md5("prompt").alias("prompt"), F.md5("output").alias("output")) for name in ("turns", "verdicts")]
    return of[0].unionByName(of[1])


CODES = "['O1', 'O2', 'O3', 'O4', 'O5', 'O6']"


@query(f"""with e as (select doc_id, list_filter([case when toxic = 1 then 'O' || (doc_id % 6 + 1) end, case when toxic = 1 and quality = 0 then 'O' || ((doc_id + 2) % 6 + 1) end], lambda x: x is not null) as bad from labels),
k as (select doc_id, bad, list_filter({CODES}, lambda c: list_contains(bad, c) or ('0x' || md5('3:' || doc_id || ':' || c)[1:2])::int >= 128) as fewer from e),
v as (select doc_id, 'all' as variant, {CODES} as shown, bad as rest from k union all select doc_id, 'fewer', fewer, bad from k union all select doc_id, 'relabelled', list_filter(fewer, lambda c: not list_contains(bad, c)), [] from k where len(bad) > 0)
select doc_id, variant, array_to_string(shown, ',') as shown, case when len(rest) > 0 then 'unsafe' else 'safe' end as label, array_to_string(list_sort(list_transform(rest, lambda c: list_position(shown, c)::varchar)), ',') as rewritten from v""")
def safety_variants(s, d):
    """Safety examples with categories left out and codes rewritten."""
    k = F.col("doc_id")
    bad = F.array_compact(F.array(F.when(F.col("toxic") == 1, F.concat(F.lit("O"), (k % 6 + 1).cast("string"))), F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.concat(F.lit("O"), ((k + 2) % 6 + 1).cast("string")))))
    got = B.safety_variants(t(s, d, "labels").select("doc_id", bad.alias("bad")), 3, "doc_id", [f"O{i}" for i in range(1, 7)], "bad")
    return got.select("doc_id", "variant", F.array_join("shown", ",").alias("shown"), "label", F.array_join("rewritten", ",").alias("rewritten"))


@query("""select conv_id, md5('<|begin_of_text|> Your task is to verify the claims based on the context information in format of question answer pairs. Verify the claim with justification using the following labels: Supported, Refuted, Not Enough Evidence, Conflicting Evidence/Cherrypicking.' || chr(10) || chr(10) || 'Claim: c' || chr(10)
|| string_agg('Question ' || n || ': q' || chr(10) || 'Answer ' || n || ': ' || replace(text, chr(10) || chr(10), chr(10)) || chr(10), '' order by n)) as prompt, 'Justification: j' || chr(10) || 'Label: Supported <|end_of_text|>' as output from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) group by conv_id""")
def verification_examples(s, d):
    """Verification prompts and targets."""
    got = t(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(F.lit("q").alias("question"), x["text"].alias("answer"))).alias("p"))
    return got.select("conv_id", F.md5(T.verification_prompt(F.lit("c"), F.col("p"))).alias("prompt"), T.verification_target(F.lit("j"), F.lit("Supported")).alias("output"))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(s, d):
    """Extension: hourly counts, the same expression that runs on streams."""
    return windowed_counts(t(s, d, "events")).withColumn("total", F.round("total", 4))
