"""Evidence queries: joins, greedy de-duplication, rounds, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import dedup, joins, setops
from evidentia.operators import evidence as E
from evidentia.operators.rank import ordinal
from evidentia.plans.base import claims, query, shared_folder, t
from evidentia.streaming.rounds import EVIDENCE, evidence_by_rounds, prepared

VEC = "list_transform(embedding, lambda x: x::double)"

FOLD = f"""
v as (select *, row_number() over (partition by g order by vec_id) as n from (select vec_id, vec_id // {{size}} as g, {VEC} as v from embeddings)),
fold as (
  select g, n, [n] as kept from v where n = 1
  union all
  select f.g, f.n + 1, case when not exists (select 1 from v y where y.g = f.g and list_contains(f.kept, y.n) and round(list_cosine_similarity(y.v, x.v), 6) >= {{limit}}) then list_append(f.kept, x.n) else f.kept end
  from fold f join v x on x.g = f.g and x.n = f.n + 1)
"""


def groups(s, d, size):
    e = t(s, d, "embeddings").select(F.floor(F.col("vec_id") / size).alias("g"), F.struct("vec_id", F.col("embedding").alias("v")).alias("x"))
    return e.groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("items"))


@query(f"with recursive {FOLD.format(size=8, limit=0.2)} select v.g, v.vec_id from v join (select g, arg_max(kept, n) as kept from fold group by g) k on k.g = v.g and list_contains(k.kept, v.n)")
def greedy_dedup(s, d):
    """What an ordered greedy pass keeps."""
    return groups(s, d, 8).select("g", F.explode(dedup.greedy(F.col("items"), 0.2)).alias("x")).select("g", "x.vec_id")


BY_LABEL = FOLD.replace("vec_id // {size} as g", "label as g").replace("from embeddings)", "from embeddings where label is not null)").format(limit=0.3)


@query(f"with recursive {BY_LABEL} select v.g as label, v.vec_id from v join (select g, arg_max(kept, n) as kept from fold group by g) k on k.g = v.g and list_contains(k.kept, v.n)")
def greedy_by_label(s, d):
    """What an ordered greedy pass keeps of the vectors of each label, lists of any length."""
    return dedup.greedy_rows(t(s, d, "embeddings").where("label is not null"), ["label"], "vec_id", "embedding", 0.3, rows=512)


@query(f"""with recursive {FOLD.format(size=5, limit=0.1)}, k as (select g, arg_max(kept, n) as kept from fold group by g)
select g, len(kept)::int as n, array_to_string(list_reverse(list_transform(kept, lambda i: (g * 5 + i - 1)::varchar)), ',') as ids from k""")
def greedy_by_relevance(s, d):
    """From the most relevant down, returned with the least relevant first."""
    got = groups(s, d, 5).withColumn("ranked", F.transform("items", lambda x: F.struct(x["vec_id"].alias("vec_id"), x["v"].alias("v"), (-x["vec_id"]).cast("double").alias("score"), x["vec_id"].alias("ord"))))
    kept = dedup.greedy_by_relevance(F.col("ranked"), 0.1)
    return got.select("g", F.size(kept).alias("n"), F.array_join(F.transform(kept, lambda x: x["vec_id"].cast("string")), ",").alias("ids"))


@query("select n::int as n, case when n >= 10 then 0.5 when n >= 6 then 0.8 end::double as threshold from (select conv_id, count(*) as n from conversations group by conv_id)")
def threshold_policy(s, d):
    """The threshold that a list's length asks for."""
    return t(s, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n")).select("n", dedup.threshold_by_size(F.col("n")).cast("double").alias("threshold"))


@query()
def sequential_policy(s, d):
    """Lists of twelve under the one-pass and the two-pass policy."""
    got = groups(s, d, 12)
    return got.select("g", F.size("items").alias("n"), F.size(dedup.by_policy(F.col("items"))).alias("once"), F.size(dedup.by_policy(F.col("items"), again=True)).alias("twice"))


# --- Joins ---------------------------------------------------------------------------------------


@query("select d.doc_id, d.text = f.text as same, f.doc_id as first_id from documents d join (select lang, min(doc_id) as doc_id from documents group by lang) m using (lang) join documents f on f.doc_id = m.doc_id")
def first_match(s, d):
    """The first row of each key."""
    docs = t(s, d, "documents")
    right = docs.select("lang", F.col("doc_id").alias("first_id"), F.col("text").alias("first_text"))
    return joins.first_match(docs.select("doc_id", "lang", "text"), right, "lang", [F.asc("first_id")]).select("doc_id", (F.col("text") == F.col("first_text")).alias("same"), "first_id")


@query("select doc_id, min(item_id) as item_id from documents d join benchmark b on contains(d.text, b.text) group by doc_id")
def substring_join(s, d):
    """Every document with the first claim that it contains."""
    docs, items = t(s, d, "documents").select("doc_id", "text"), t(s, d, "benchmark").select("item_id", F.col("text").alias("claim"))
    return joins.substring_first(docs, items, "text", "claim", ["doc_id"], [F.asc("item_id")]).select("doc_id", "item_id")


@query("""with n as (select conv_id, count(*) as size, conv_id % 10 as shard from conversations group by conv_id), b as (select *, coalesce(sum(size) over (partition by shard order by conv_id rows between unbounded preceding and 1 preceding), 0) as base from n),
flat as (select conv_id, turn, conv_id % 10 as shard, row_number() over (partition by conv_id % 10 order by conv_id, turn) - 1 as pos, text from conversations),
e as (select b.conv_id, b.shard, b.base + q as pos, q as q_idx from b, unnest(generate_series(0, size - 1)) as u(q))
select e.conv_id, e.q_idx::int as q_idx, f.turn from e join flat f using (shard, pos)""")
def offset_join(s, d):
    """Entries of a flat table found by running offsets."""
    c = t(s, d, "conversations").withColumn("shard", F.col("conv_id") % 10)
    nested = c.groupBy("conv_id", "shard").agg(F.count("*").cast("int").alias("size"))
    flat = ordinal(c, [F.asc("conv_id"), F.asc("turn")], "pos", ["shard"]).select("shard", F.col("pos").cast("bigint").alias("pos"), "turn")
    return joins.offset_join(nested, flat, "size", ["conv_id"], ["shard"], "pos").select("conv_id", "q_idx", "turn")


@query("select doc_id, source from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 1)")
def gold_semi(s, d):
    """Stored documents that gold names."""
    return t(s, d, "documents").join(t(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("select d.doc_id, d.lang, d.source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def missing_anti(s, d):
    """Documents not processed yet."""
    return joins.unprocessed(t(s, d, "documents").select("doc_id", "lang", "source"), t(s, d, "labels"), ["doc_id"])


@query("select conv_id, turn, role from conversations c where not exists (select 1 from (select conv_id, turn, role from conversations where turn % 2 = 0) x where (x.conv_id, x.turn, x.role) = (c.conv_id, c.turn, c.role))")
def anti_three_keys(s, d):
    """Rows whose three-part key is not taken."""
    c = t(s, d, "conversations").select("conv_id", "turn", "role")
    return joins.unprocessed(c, c.where("turn % 2 = 0"), ["conv_id", "turn", "role"])


@query("select doc_id from documents where doc_id not in (select doc_id from labels where doc_id <> (select max(doc_id) from labels))")
def resume_log(s, d):
    """Claims to do again: those not in the log, and the log's last."""
    return joins.resumable(t(s, d, "documents").select("doc_id"), t(s, d, "labels"), "doc_id", "doc_id")


@query("""with c as (select conv_id, list(text order by turn) as x, list(role order by turn) as r from conversations group by conv_id)
select conv_id, coalesce(x[3], '') as third, coalesce(r[list_position(x, x[2])], 'none') as role_of_second, r = list_reverse(r) as same from c""")
def array_lookups(s, d):
    """Array elements by index and by place, arrays compared."""
    c = t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("a")).select("conv_id", F.col("a.text").alias("x"), F.col("a.role").alias("r"))
    return c.select("conv_id", joins.lookup(F.col("x"), F.lit(2)).alias("third"), F.coalesce(joins.aligned(F.col("x"), F.get("x", F.lit(1)), F.col("r")), F.lit("none")).alias("role_of_second"), (F.col("r") == F.reverse("r")).alias("same"))


@query("""with s as (select conv_id, count(*) filter (role = 'user') as n from conversations group by conv_id), w as (select conv_id, max(turn) + 1 as n from conversations group by conv_id)
select s.conv_id from s join w on w.conv_id = s.conv_id and w.n = s.n * 2""")
def matching_sets(s, d):
    """Rows whose sets agree on both sides."""
    c = t(s, d, "conversations")
    left = c.groupBy("conv_id").agg((F.count(F.when(F.col("role") == "user", 1)) * 2).alias("a"))
    return joins.matching_sets(left, c.groupBy("conv_id").agg((F.max("turn") + 1).alias("b")), "conv_id", "a", "b").select("conv_id")


@query("select a.conv_id, a.turn as premise, b.turn as hypothesis from conversations a join conversations b using (conv_id) where a.role = 'assistant' and b.role = 'user'")
def premise_pairs(s, d):
    """All premises with all hypotheses of a group."""
    c = t(s, d, "conversations")
    return joins.pairs_in_group(c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("premise")), c.where("role = 'user'").select("conv_id", F.col("turn").alias("hypothesis")), ["conv_id"])


@query("select row_number() over (order by doc_id desc) - 1 as place, doc_id, lang from documents join labels using (doc_id)")
def reorder_by_ids(s, d):
    """Rows in the order of an id list."""
    ids = ordinal(t(s, d, "labels").select("doc_id").join(t(s, d, "documents").select("doc_id"), "doc_id", "left_semi"), [F.desc("doc_id")], "place")
    return joins.reorder(t(s, d, "documents").select("doc_id", "lang"), ids, "doc_id", "place").select("place", "doc_id", "lang")


# --- Rounds --------------------------------------------------------------------------------------

ROUND = """(select conv_id as claim_id, (turn)::int as q_idx, text as question, case when (conv_id + turn + {r}) % 4 = 0 then null when (conv_id + turn + {r}) % 5 = 0 then 'Sorry, no information' else text end as answer, ['u' || turn, 'v' || conv_id] as urls, case when turn % 3 = 0 then null else (turn % 2)::int end as chunk_idx, {r} as round from conversations)"""


def round_table(s, d, r):
    """A round of questions made from conversations: some without an answer, some that say nothing."""
    k = F.col("conv_id") + F.col("turn") + r
    answer = F.when(k % 4 == 0, None).when(k % 5 == 0, "Sorry, no information").otherwise(F.col("text"))
    return t(s, d, "conversations").select(
        F.col("conv_id").alias("claim_id"), F.col("turn").cast("int").alias("q_idx"), F.col("text").alias("question"), answer.alias("answer"),
        F.array(F.concat(F.lit("u"), F.col("turn").cast("string")), F.concat(F.lit("v"), F.col("conv_id").cast("string"))).alias("urls"), F.when(F.col("turn") % 3 == 0, None).otherwise((F.col("turn") % 2).cast("int")).alias("chunk_idx"),
    )


CANON = "case when contains(lower(answer), 'sorry') then 'No answer could be found.' else answer end"
ALL = f"select claim_id, q_idx, question, coalesce({CANON}, 'No answer could be found.') as answer, coalesce(urls[chunk_idx + 1], '') as url, round from"


@query(f"{ALL} {ROUND.format(r=1)}")
def collect_evidence(s, d):
    """Every question with its answer or the fixed text."""
    return E.collect_all(round_table(s, d, 1)).withColumn("round", F.lit(1))


@query(f"select * from ({ALL} {ROUND.format(r=2)} where answer is not null)")
def collect_answered(s, d):
    """Answered questions only."""
    return E.collect_answered(round_table(s, d, 2)).withColumn("round", F.lit(2))


DECIDE = "(select claim_id, count(*) as total, count(answer) as answered, count(*) filter (contains(lower(answer), 'sorry') or contains(lower(answer), 'no information')) as no_information from {0} group by claim_id)"
COMPLETE = "answered > 0 and answered / total::double > 0.8 and no_information / greatest(answered, 1)::double < 0.3"


@query(f"select *, {COMPLETE} as complete from {DECIDE.format(ROUND.format(r=1))}")
def round_decide(s, d):
    """Whether a claim's answers complete it."""
    return E.next_round(round_table(s, d, 1))


@query(f"""with sim as (select claim_id, s as sample_idx, round(avg(((claim_id * 7 + s * 3 + u * 5) % 11) / 10.0), 6) as similarity from (select distinct conv_id as claim_id from conversations), unnest([0, 1, 2, 3]) as a(s), unnest([0, 1]) as b(u) group by all)
select claim_id, arg_min(sample_idx, (similarity, sample_idx)) as sample_idx, min(similarity) as similarity from sim where claim_id in (select claim_id from {DECIDE.format(ROUND.format(r=1))} where not ({COMPLETE})) group by claim_id""")
def next_question_set(s, d):
    """The question set that incomplete claims turn to."""
    ids = t(s, d, "conversations").select(F.col("conv_id").alias("claim_id")).distinct()
    sim = ids.withColumn("sample_idx", F.explode(F.array(*map(F.lit, range(4))))).withColumn("u", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("similarity", ((F.col("claim_id") * 7 + F.col("sample_idx") * 3 + F.col("u") * 5) % 11) / 10.0)
    return E.next_set(E.next_round(round_table(s, d, 1)), sim)


def _evidence_sql(body: str) -> str:
    return f"with e as ({body}) select claim_id, count(*)::int as n, md5(string_agg(question || '>' || answer || '>' || url, '|' order by round, q_idx)) as pairs from e group by claim_id"


def _evidence(rows):
    got = E.nested(rows)
    return got.select("claim_id", "n", F.md5(F.array_join(F.transform("evidence", lambda e: F.concat_ws(">", e["question"], e["answer"], e["url"])), "|")).alias("pairs"))


@query(_evidence_sql(" union all ".join(f"select * from ({ALL} {ROUND.format(r=r)} where claim_id % 3 + 1 > {r} and answer is not null) union all {ALL} {ROUND.format(r=r)} where claim_id % 3 + 1 = {r}" for r in (1, 2, 3))))
def round_merge(s, d):
    """Evidence of claims that finished in different rounds."""
    done = t(s, d, "conversations").select(F.col("conv_id").alias("claim_id")).distinct().withColumn("round", (F.col("claim_id") % 3 + 1).cast("int"))
    return _evidence(E.combine_adaptive([round_table(s, d, r) for r in (1, 2, 3)], done))


@query(_evidence_sql(f"select * from ({ALL} {ROUND.format(r=1)} where answer is not null) union all select * from ({ALL} {ROUND.format(r=2)} where answer is not null) union all {ALL} {ROUND.format(r=3)}"))
def combine_all_rounds(s, d):
    """Answered questions of earlier rounds and all of the last."""
    return _evidence(E.combine_all([round_table(s, d, r) for r in (1, 2, 3)]))


def _state_sql() -> str:
    decided = [f"select claim_id, {r} as r, {COMPLETE} as complete from {DECIDE.format(ROUND.format(r=r))}" for r in (1, 2, 3)]
    done = f"(select claim_id, coalesce(min(r) filter (complete), 4) as done from ({' union all '.join(decided)}) group by claim_id)"
    given = [f"select e.* from ({ALL} {ROUND.format(r=r)} where answer is not null) e join {done} using (claim_id) where done > {r} union all select e.* from ({ALL} {ROUND.format(r=r)}) e join {done} using (claim_id) where done = {r}" for r in (1, 2, 3)]
    answered = " union ".join(f"select conv_id from conversations where (conv_id + turn + {r}) % 4 <> 0" for r in (1, 2, 3))
    none = f"select claim_id, q_idx, question, 'No answer could be found.', '', 1 from {ROUND.format(r=1)} join {done} using (claim_id) where done = 4 and claim_id not in ({answered})"
    return _evidence_sql(" union all ".join([*given, none]))


@query(_state_sql())
def rounds_in_state(s, d):
    """Answers of three rounds, in files and in any order, through a stream that holds each
    claim's round as state and gives its evidence once it is done."""
    n = t(s, d, "conversations").groupBy(F.col("conv_id").alias("claim_id")).agg(F.count_distinct("turn").alias("expected"))
    rounds = [round_table(s, d, r).withColumn("round", F.lit(r)) for r in (1, 2, 3)]
    answers = prepared(rounds[0].unionByName(rounds[1]).unionByName(rounds[2]).join(n, "claim_id"))
    folder = shared_folder(s)
    # Three batches, of at least two files each and as many as there are cores.
    files = max(2, s.sparkContext.defaultParallelism)
    answers.repartition(3 * files, F.xxhash64("question", "round")).write.parquet(f"{folder}/answers")
    stream = s.readStream.schema(answers.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/answers")
    evidence_by_rounds(stream, 3).writeStream.format("parquet").option("path", f"{folder}/evidence").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return _evidence(s.read.schema(EVIDENCE).parquet(f"{folder}/evidence"))


ANY = f"(select * from ({ALL} {ROUND.format(r=1)} where answer is not null) union all select * from ({ALL} {ROUND.format(r=2)} where answer is not null))"


@query(_evidence_sql(f"select * from {ANY} union all select claim_id, q_idx, question, 'No answer could be found.', '', 1 from {ROUND.format(r=1)} where claim_id not in (select claim_id from {ANY})"))
def recycle(s, d):
    """Claims that never finished."""
    ids = t(s, d, "conversations").select(F.col("conv_id").alias("claim_id")).distinct()
    return _evidence(E.recycle([round_table(s, d, 1), round_table(s, d, 2)], ids))


@query(f"select sum(n)::bigint as total, max(n)::int as most from (select claim_id, count(*) as n from (select * from ({ALL} {ROUND.format(r=1)} where answer is not null)) group by claim_id)")
def evidence_totals(s, d):
    """Pairs in all evidence lists."""
    return E.nested(E.collect_answered(round_table(s, d, 1)).withColumn("round", F.lit(1))).agg(F.sum("n").alias("total"), F.max("n").alias("most"))


@query("""with c as (select doc_id, [text, lang, case when doc_id % 2 = 0 then 'There is no evidence' else source end] as a, doc_id % 4 = 0 as has from documents)
select doc_id, md5(case when has then a[2] else a[list_position(list_transform(a, lambda x: contains(lower(x), 'sorry') or contains(lower(x), 'no information') or contains(lower(x), 'not provide') or contains(lower(x), 'no evidence') or contains(lower(x), 'not enough information')), true)] end) as answer,
(case when has then 0 end)::int as chunk_idx, (has or doc_id % 2 = 0)::int as retained from c""")
def response_check(s, d):
    """The answer kept for each question."""
    k = F.col("doc_id")
    docs = t(s, d, "documents")
    answers = F.array("text", "lang", F.when(k % 2 == 0, "There is no evidence").otherwise(F.col("source")))
    cand = F.array(F.struct(F.lit(1).alias("index"), F.array(F.lit(0.9), F.lit(0.2)).alias("probs"), F.array(F.when(k % 4 == 0, 2).otherwise(1), F.lit(1)).alias("labels")))
    got = E.check_responses(docs.select("doc_id", answers.alias("answers"), cand.alias("candidates")), "candidates", "answers")
    return got.select("doc_id", F.md5("answer").alias("answer"), "chunk_idx", "retained")


@query("select distinct doc_id as claim_id, q as q_idx, (doc_id % 2)::int as a_idx from documents, unnest([0, 1]) as u(q), unnest([1, 2, 3, 4]) as w(rank) where rank <= 3 and (doc_id + q * rank) % 5 = 2")
def entailed_gold_pairs(s, d):
    """Gold pairs that one of the first three chunks entails."""
    rows = t(s, d, "documents").select(F.col("doc_id").alias("claim_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("q_idx"), (F.col("doc_id") % 2).cast("int").alias("a_idx")).withColumn("rank", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    return E.entailed_pairs(rows.withColumn("label", F.when((F.col("claim_id") + F.col("q_idx") * F.col("rank")) % 5 == 2, 2).otherwise(1)))


SEARCH = "array_to_string(list_filter(regexp_split_to_array(trim(claim), '\\s+'), lambda w: lower(w) not in ('a', 'an', 'the', 'of', 'in', 'on', 'at', 'to', 'for', 'and', 'or', 'is', 'are', 'was', 'were', 'be', 'by', 'with', 'that', 'this', 'it', 'as', 'from')), ' ')"


@query(f"""with c as (select item_id as claim_id, text as claim, case when item_id % 2 = 0 then 'Ann Lee' end as author, ['who?', 'why?'] as qs from benchmark),
k as (select claim_id, list_concat(case when author is not null then [{{'kind': 'claim+author', 'search': 'Ann Lee ' || {SEARCH}}}] else [] end, [{{'kind': 'claim', 'search': {SEARCH}}}, {{'kind': 'claim-noformat', 'search': claim}}], list_transform(qs, lambda q: {{'kind': 'question', 'search': q}})) as ks from c)
select claim_id, i::int as s_idx, ks[i + 1].kind as kind, ks[i + 1].search as search, page::int as page from k, unnest(generate_series(0, len(ks) - 1)) as a(i), unnest([0, 1, 2]) as b(page)""")
def search_plan(s, d):
    """The searches that a claim asks for."""
    c = claims(s, d).withColumn("author", F.when(F.col("claim_id") % 2 == 0, "Ann Lee")).withColumn("qs", F.array(F.lit("who?"), F.lit("why?")))
    return E.search_plan(c, "claim_id", "claim", "author", "qs", 3)


@query("select page_id, site, host, dense_rank() over (partition by site order by first) - 1 as store_id from (select *, min(page_id) over (partition by site, host) as first from (select page_id, page_id % 5 as site, split_part(url, '/', 3) as host from pages))")
def visited_store_ids(s, d):
    """Every hit with its link's number in the claim."""
    p = t(s, d, "pages").select("page_id", (F.col("page_id") % 5).alias("site"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    return E.store_ids(p, "site", "host", "page_id")


@query("""with g as (select doc_id, string_split(text, '.') as x from documents where length(text) > 0), p as (select doc_id, list_transform(list_filter(list_transform(string_split(replace(text, '.', '?'), '?'), lambda q: trim(q)), lambda q: length(q) > 1), lambda q: q || '?') as a from documents),
f as (select doc_id, list_filter(a, lambda v, i: list_position(a, v) = i and len(string_split(v, ' ')) >= 3) as qs from p) select doc_id, len(qs)::int as n from f where len(qs) > 0""")
def generation_questions(s, d):
    """Questions attached to generations; those without one are dropped."""
    g = t(s, d, "documents").select("doc_id", F.replace(F.col("text"), F.lit("."), F.lit("?")).alias("generation"))
    return E.parsed_questions(g, "generation").select("doc_id", F.size("questions").alias("n"))


@query("select item_id as claim_id, 0 as sample_idx, 1 as n from benchmark union all select item_id, i + 1, 2 from benchmark, unnest([0, 1, 2]) as u(i)")
def merge_questions(s, d):
    """Greedy questions as set 0 beside the sampled ones."""
    c = claims(s, d)
    greedy = c.withColumn("questions", F.array("claim"))
    sampled = c.withColumn("sample_idx", F.explode(F.array(*map(F.lit, range(3))))).withColumn("questions", F.array("claim", F.lit("why?")))
    return E.merge_question_sets(greedy, sampled).select("claim_id", "sample_idx", F.size("questions").alias("n"))


@query("""select item_id, unnest(list_concat([text || ' yes' || case when item_id % 2 = 0 then '. because' else '' end], ['q2 No answer could be found.'])) as compared from benchmark""")
def compared_strings(s, d):
    """The strings that metrics compare."""
    answer = F.struct(F.lit("yes").alias("answer"), F.lit("Boolean").alias("answer_type"), F.when(F.col("item_id") % 2 == 0, "because").alias("boolean_explanation"))
    none = F.filter(F.array(answer), lambda x: F.lit(False))
    qs = F.array(F.struct(F.col("text").alias("question"), F.array(answer).alias("answers")), F.struct(F.lit("q2").alias("question"), none.alias("answers")))
    return t(s, d, "benchmark").select("item_id", F.explode(E.compared_strings(qs)).alias("compared"))


# --- Set operations ------------------------------------------------------------------------------


@query("select doc_id as id, text, lang, null as role from documents union all select conv_id, text, null, role from conversations")
def union_all_tables(s, d):
    """Rows of several tables by column name."""
    return setops.union_all([t(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), t(s, d, "conversations").select(F.col("conv_id").alias("id"), "text", "role")])


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels where quality = 1 intersect select doc_id from documents where lang = 'en')")
def intersect_except(s, d):
    """Keys in both tables, taken out of a third."""
    both = setops.intersect_keys(t(s, d, "labels").where("quality = 1"), t(s, d, "documents").where("lang = 'en'"), "doc_id")
    return setops.except_keys(t(s, d, "documents").select("doc_id", "lang"), both, "doc_id")


@query("select distinct lang, source from documents")
def distinct_rows(s, d):
    """X3."""
    return t(s, d, "documents").select("lang", "source").distinct()


@query("select r as doc_id from (select unnest(generate_series(0, (select max(doc_id) from documents))) as r) where r not in (select doc_id from labels)")
def completeness_check(s, d):
    """Numbers that a complete table would have."""
    top = t(s, d, "documents").agg(F.max("doc_id").alias("m")).first().m
    return setops.missing_ids(t(s, d, "labels"), "doc_id", (top if top is not None else -1) + 1)


@query("select * from (select lang, source, 'left' as side from (select lang, source from documents except all select lang, 'src1' from documents)) union all select lang, source, 'right' from (select lang, 'src1' as source from documents except all select lang, source from documents)")
def table_difference(s, d):
    """Rows of one table only."""
    a = t(s, d, "documents").select("lang", "source")
    return setops.difference(a, a.withColumn("source", F.lit("src1")))


@query("select doc_id, (case when doc_id >= 150 then 2 when doc_id >= 50 then 1 else 0 end)::int as part from documents where doc_id >= 0 and doc_id < 1000000000")
def positional_split(s, d):
    """Rows by ranges of positions."""
    return setops.positional_split(t(s, d, "documents").select("doc_id"), "doc_id", [0, 50, 150, 1_000_000_000])


@query("select d.doc_id, (select count(*) from labels l where l.doc_id = d.doc_id) = 1 as done from documents d")
def finished_partition(s, d):
    """Reference rows with exactly one result."""
    return setops.finished(t(s, d, "documents").select("doc_id"), t(s, d, "labels"), "doc_id")
