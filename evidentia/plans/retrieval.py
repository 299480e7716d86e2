"""Retrieval queries: BM25, dense and scored rankings, selections over scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions.scorers import cosine, dot
from evidentia.operators import index as I
from evidentia.operators import quantised as Q
from evidentia.operators import rank as R
from evidentia.plans.base import STORED, claims, jac, query, shared_folder, stored, t, tok

BM25 = """
with d as (select {g} doc, tk, len(tk) as n from (select {g} doc, {dtok} as tk from ({docs}))),
q as (select {qg} query, term, count(*) as times from (select {qg} query, unnest({qtok}) as term from ({queries})) group by all),
stats as (select {g} count(*) as cnt, avg(n::double) as mean from d group by all),
freq as (select {g} term, count(*) as df from (select {g} doc, unnest(list_distinct(tk)) as term from d) group by all),
raw as (select f.*, ln(cnt - df + 0.5) - ln(df + 0.5) as idf from freq f join stats s on {gs}),
m as (select {g} avg(idf) as mean_idf from raw group by all),
w as (select r.*, case when idf < 0 then 0.25 * mean_idf else idf end as weight from raw r join m s on {gr}),
tf as (select {g} doc, n, term, count(*) as c from (select {g} doc, n, unnest(tk) as term from d) group by all),
parts as (select tf.*, c * 2.5 / (c + 1.5 * (0.25 + 0.75 * n / mean)) as part from tf join stats s on {gt}),
scores as (select {pg} query, doc, round(sum(weight * part * times), 6) as score from parts p join w using ({gu} term) join q using ({qu} term) group by all)
"""


def bm25_sql(docs: str, queries: str, group: str = "", query_group: bool = False) -> str:
    g = f"{group}, " if group else ""
    same = lambda a: f"{a}.{group} = s.{group}" if group else "true"
    return BM25.format(g=g, qg=g if query_group else "", pg=g, docs=docs, queries=queries, dtok=tok("text"), qtok=tok("text"), gs=same("f"), gr=same("r"), gt=same("tf"), gu=g, qu=g if query_group else "")


DOCS, ITEMS = "select doc_id as doc, text from documents", "select item_id as query, text from benchmark"
RANKED = "select *, row_number() over (partition by {by} order by score desc, doc) as rank from scores"


@query(bm25_sql(DOCS, ITEMS) + f"select query as item_id, doc as doc_id, score, rank from ({RANKED.format(by='query')}) where rank <= 10")
def bm25_topk(s, d):
    """The ten best documents for every claim."""
    return R.bm25(t(s, d, "documents"), t(s, d, "benchmark"), "doc_id", "item_id")


@query(bm25_sql(DOCS, ITEMS) + f"select query as item_id, doc as doc_id, score, rank from ({RANKED.format(by='query')}) where rank <= 10")
def bm25_indexed(s, d):
    """The ten best documents for every claim, from an index of all documents that is written first."""
    index = I.build(t(s, d, "documents"), "doc_id", shared_folder(s))
    return I.search(index, t(s, d, "benchmark"), "item_id")


@query(bm25_sql("select source, doc_id as doc, text from documents", ITEMS, "source") + f"select source, query as item_id, doc as doc_id, score, rank from ({RANKED.format(by='source, query')}) where rank <= 5")
def bm25_indexed_by_source(s, d):
    """R1 from an index with a corpus of its own for each source."""
    index = I.build(t(s, d, "documents"), "doc_id", shared_folder(s), group="source", bucket=32)
    return I.search(index, t(s, d, "benchmark"), "item_id", k=5)


@query(bm25_sql("select source, doc_id as doc, text from documents", ITEMS, "source") + f"select source, query as item_id, doc as doc_id, score, rank from ({RANKED.format(by='source, query')}) where rank <= 5")
def bm25_by_source(s, d):
    """R1 with a corpus of its own for each source."""
    return R.bm25(t(s, d, "documents"), t(s, d, "benchmark"), "doc_id", "item_id", group="source", k=5)


@query(
    bm25_sql(f"select claim_id, {{'doc_id': doc_id, 'line_idx': line_idx}} as doc, line as text from (select claim_id, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_idx from {STORED}) where length(line) >= 4", "select item_id as claim_id, item_id as query, text from benchmark", "claim_id", True)
    + f"select claim_id, doc.doc_id as doc_id, doc.line_idx::int as line_idx, score, rank from ({RANKED.format(by='claim_id')}) where rank <= 10"
)
def bm25_line_topk(s, d):
    """The best lines of the claim's own store."""
    lines = stored(s, d).select("claim_id", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.length("text") >= 4).select("claim_id", F.struct("doc_id", F.col("i").alias("line_idx")).alias("line_id"), "text")
    asked = claims(s, d).select("claim_id", F.col("claim_id").alias("_item"), F.col("claim").alias("text"))
    return R.bm25(lines, asked, "line_id", "_item", group="claim_id").select("claim_id", "line_id.*", "score", "rank")


@query(
    bm25_sql(f"select claim_id, doc_id as doc, text from {STORED}", "select item_id as claim_id, item_id as query, text from benchmark", "claim_id", True)
    + f", every as (select x.claim_id, x.doc_id as doc, coalesce(s.score, 0) as score from {STORED} x left join scores s on s.claim_id = x.claim_id and s.doc = x.doc_id) select claim_id, doc as doc_id, score, row_number() over (partition by claim_id order by score desc, doc) as rank from every"
)
def bm25_full_rank(s, d):
    """R2: every document of the claim's store in order, those without a common term at the end."""
    docs = stored(s, d).select("claim_id", "doc_id", "text")
    asked = claims(s, d).select("claim_id", F.col("claim_id").alias("_item"), F.col("claim").alias("text"))
    every = R.bm25(docs, asked, "doc_id", "_item", group="claim_id", k=None, full=True).select("claim_id", "doc_id", "score")
    return R.ranked(every, ["claim_id"], [F.desc("score"), F.asc("doc_id")]).select("claim_id", "doc_id", "score", "rank")


@query(bm25_sql("select item_id as doc, text from benchmark", "select {'conv_id': conv_id, 'turn': turn} as query, text from conversations where role = 'user'") + f"select query.conv_id as conv_id, query.turn as turn, doc as item_id, score, rank from ({RANKED.format(by='query')}) where rank <= 10")
def few_shot_selection(s, d):
    """The ten training claims nearest to each user turn, for a few-shot prompt."""
    asked = t(s, d, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("turn_id"), "text")
    return R.bm25(t(s, d, "benchmark"), asked, "item_id", "turn_id").select("turn_id.*", "item_id", "score", "rank")


VEC = "list_transform(embedding, lambda x: x::double)"


@query(f"""
with v as (select vec_id, {VEC} as v from embeddings),
p as (select q.vec_id as query_id, c.vec_id, round(list_dot_product(q.v, c.v), 6) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select * from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5""")
def dense_topk(s, d):
    """The five nearest vectors of the stated query set (ids divisible by 100) by dot product."""
    e = t(s, d, "embeddings")
    return R.dense_top_k(e, e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", "embedding", 5)


@query()
def dense_topk_quantised(s, d):
    """The five nearest of the same query set by quantised vectors and an exact re-rank. Approximate."""
    e = t(s, d, "embeddings")
    return Q.dense_top_k(e, e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", "embedding", 5)


@query(f"""
with v as (select vec_id, label, {VEC} as v from embeddings), q as (select label, min(vec_id) as first_id from embeddings group by label)
select a.label, a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) as cosine from v a join q using (label) join v b on b.vec_id = q.first_id""")
def cosine_to_first(s, d):
    """Cosine of every vector to its label's first."""
    e = t(s, d, "embeddings")
    first = e.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("_f"))
    return e.join(R.small(first), "label").select("label", "vec_id", F.round(cosine(F.col("embedding"), F.col("_f.embedding")), 6).alias("cosine"))


CHUNKS = rf"""
sent as (select claim_id, doc_id, line, idx, len({tok('line')}) as n from (select claim_id, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as idx from {STORED})),
suf as (select *, sum(n) over (partition by doc_id order by idx desc) as remaining, lag(idx) over (partition by doc_id order by idx) as prev from sent),
fold as (
  select doc_id, idx, n::bigint as run, 0 as chunk, remaining <= 40 as rest from suf where idx = 0
  union all
  select s.doc_id, s.idx, case when f.run > 0 and f.run + s.n >= 40 and not f.rest then s.n else f.run + s.n end,
    f.chunk + (case when f.run > 0 and f.run + s.n >= 40 and not f.rest then 1 else 0 end),
    case when f.run > 0 and f.run + s.n >= 40 and not f.rest then s.remaining <= 40 else f.rest end
  from fold f join suf s on s.doc_id = f.doc_id and s.idx = f.idx + 1),
chunks as (select claim_id, doc_id, chunk, string_agg(line, ' ' order by idx) as body, sum(n) as n from sent join fold using (doc_id, idx) group by all)
"""


def chunked(s, d, words=False):
    """Stored documents as chunks of whole lines under 40 words; with ``words``, the chunk's different ones too."""
    kept = lambda **columns: F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_k")  # noqa: E731  made once for a row, whatever uses it
    got = stored(s, d).where("text is not null").select("claim_id", "doc_id", F.split("text", "\n").alias("lines"))
    # A line's words are made once: no word crosses lines, so a chunk's words are those of its lines.
    got = got.select("claim_id", "doc_id", kept(lines=F.col("lines"), words=F.transform("lines", T.tokens))).select("claim_id", "doc_id", "_k.*")
    got = got.select("claim_id", "doc_id", kept(lines=F.col("lines"), words=F.col("words"), sizes=F.transform("words", lambda x: F.size(x).cast("bigint")))).select("claim_id", "doc_id", "_k.*")
    held = ["lines", "sizes", *["words"] * words]
    got = got.select("claim_id", "doc_id", kept(**{n: F.col(n) for n in held}, ids=T.chunk_by_budget(F.col("sizes"), 40))).select("claim_id", "doc_id", "_k.*")
    # Chunk numbers grow, so a chunk is a slice from where its number begins to where the next one does.
    at = F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: (i == 0) | (F.get("ids", i) != F.get("ids", i - 1)))
    got = got.select("claim_id", "doc_id", kept(**{n: F.col(n) for n in held}, ends=F.concat(at, F.array(F.size("ids"))))).select("claim_id", "doc_id", "_k.*")

    def one(first, chunk):
        mine = lambda c: F.slice(c, first + 1, F.get("ends", chunk + 1) - first)
        n = F.aggregate(mine("sizes"), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.struct(chunk.alias("chunk"), F.array_join(mine("lines"), " ").alias("body"), n.alias("n"), *[F.array_distinct(F.flatten(mine("words"))).alias("words")] * words)

    # A chunk leaves with its own lines alone, not with all of its document's.
    return got.select("claim_id", "doc_id", F.inline(F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), one)))


@query(f"with recursive {CHUNKS} select claim_id, doc_id, chunk, md5(body) as body_md5, n::bigint as n from chunks")
def token_chunker(s, d):
    """The budgeted chunker; joined, a document's chunks are its lines again."""
    return chunked(s, d).select("claim_id", "doc_id", "chunk", F.md5("body").alias("body_md5"), "n")


PAIRS = f"pairs as (select claim_id, doc_id, chunk, body, round({jac('list_distinct(' + tok('claim') + ')', 'list_distinct(' + tok('body') + ')')}, 6) as score from chunks join (select item_id as claim_id, text as claim from benchmark) using (claim_id))"


def scored_chunks(s, d):
    asked = claims(s, d).select("claim_id", F.array_distinct(T.tokens(F.col("claim"))).alias("asked"))
    both = chunked(s, d, words=True).join(R.small(asked), "claim_id").withColumn("both", F.size(F.array_intersect("asked", "words")))
    either = F.size("asked") + F.size("words") - F.col("both")
    return both.select("claim_id", "doc_id", "chunk", "body", F.round(F.when(either > 0, F.col("both") / either).otherwise(0.0), 6).alias("score"))


@query(f"with recursive {CHUNKS}, {PAIRS} select claim_id, doc_id, chunk, score, rank from (select *, row_number() over (partition by claim_id order by score desc, doc_id, chunk) as rank from pairs) where rank <= 10")
def lexical_crossencode_topk(s, d):
    """Chunks of the claim's store by a pair scorer, the best ten."""
    return R.top_k(scored_chunks(s, d), ["claim_id"], [F.desc("score"), F.asc("doc_id"), F.asc("chunk")], 10).select("claim_id", "doc_id", "chunk", "score", "rank")


@query(f"with recursive {CHUNKS}, {PAIRS}, top as (select *, row_number() over (partition by claim_id order by score desc, doc_id, chunk) as rank from pairs), k as (select claim_id, list(doc_id || ':' || chunk order by rank) as ids from top where rank <= 3 group by claim_id) select item_id as claim_id, coalesce(array_to_string(ids, ','), '') as top_ids, len(coalesce(ids, []))::int as n from benchmark left join k on k.claim_id = item_id")
def rerank_top3(s, d):
    """The best three as an array; claims without chunks get an empty one."""
    top = R.top_k(scored_chunks(s, d), ["claim_id"], [F.desc("score"), F.asc("doc_id"), F.asc("chunk")], 3)
    arrays = top.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "doc_id", "chunk").alias("key")))), lambda x: x["key"]).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return claims(s, d).join(arrays, "claim_id", "left").select("claim_id", F.array_join(ids, ",").alias("top_ids"), F.size(ids).alias("n"))


@query(f"""with recursive {CHUNKS}, {PAIRS},
top as (select *, row_number() over (partition by claim_id order by 1 - score desc, doc_id, chunk) as rank from pairs)
select claim_id, bool_and(round(1 - score, 6) > 0.9) as accepted, count(*) as n from top where rank <= 3 group by claim_id""")
def neutral_gate(s, d):
    """The three most neutral chunks, accepted only if all are neutral enough."""
    p = scored_chunks(s, d).withColumn("neutral", F.round(1 - F.col("score"), 6))
    return R.gate_neutral(p, ["claim_id"], "neutral", [F.desc("neutral"), F.asc("doc_id"), F.asc("chunk")], 3, 0.9)


@query(f"""with recursive {CHUNKS}, {PAIRS}, lab as (select *, case when score > 0.12 then 2 else 1 end as label from pairs),
m as (select *, count(*) over (partition by claim_id) as cnt, bool_or(label = 2) over (partition by claim_id) as ent, row_number() over (partition by claim_id order by score desc, doc_id, chunk) as rank from lab)
select claim_id, doc_id, chunk, label, score, rank from m where cnt <= 20 or (ent and rank <= 20)""")
def gold_chunk_ranking(s, d):
    """Groups of up to 20 chunks whole, larger ones cut to the best 20 if any chunk entails."""
    from evidentia.operators.evidence import gold_chunks

    lab = scored_chunks(s, d).select("claim_id", F.struct("doc_id", "chunk").alias("chunk_idx"), "score", F.when(F.col("score") > 0.12, 2).otherwise(1).alias("label"))
    return gold_chunks(lab, ["claim_id"], 20).select("claim_id", "chunk_idx.*", "label", "score", "rank")


@query(f"""with recursive {CHUNKS}, {PAIRS}, s as (select claim_id, doc_id, round(sum(score), 6) as total from pairs group by all)
select claim_id, arg_min(doc_id, (-total, doc_id)) as doc_id, -min((-total, doc_id))[1] as total from s group by claim_id""")
def best_answer(s, d):
    """The candidate with the largest sum of scores over its chunks, the lowest among equals."""
    sums = scored_chunks(s, d).groupBy("claim_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("total"))
    return R.best_by(sums, ["claim_id"], "total", "doc_id", ["doc_id", "total"])


@query("""with c as (select doc_id as g, doc_id % 7 / 10.0 as p0, (doc_id // 7) % 9 / 10.0 as p1, (doc_id // 3) % 8 / 10.0 as p2 from documents),
e as (select g, idx, [round((p0 + idx * 0.13) % 1.0, 3), round((p1 + idx * 0.29) % 1.0, 3), round((p2 + idx * 0.41) % 1.0, 3)] as probs, [(g + idx) % 3, (g // 2 + idx) % 3, (g // 5 + 2 * idx) % 3] as labels from c, (select unnest([0, 1, 2]) as idx)),
h as (select g, idx, probs, list_max(probs) as m from e where list_contains(labels, 2))
select c.g as doc_id, b.idx::int as best_idx, (list_position(b.probs, b.m) - 1)::bigint as chunk from c left join (select * from h qualify row_number() over (partition by g order by m desc, idx) = 1) b using (g)""")
def best_supported(s, d):
    """The supported candidate with the largest probability, and its first best chunk."""
    cand = lambda i: F.struct(F.lit(i).alias("index"), F.array(*[F.round((F.col(p) + i * x) % 1.0, 3) for p, x in (("p0", 0.13), ("p1", 0.29), ("p2", 0.41))]).alias("probs"), F.array((F.col("doc_id") + i) % 3, (F.floor(F.col("doc_id") / 2) + i) % 3, (F.floor(F.col("doc_id") / 5) + 2 * i) % 3).alias("labels"))
    base = t(s, d, "documents").select("doc_id", (F.col("doc_id") % 7 / 10.0).alias("p0"), (F.floor(F.col("doc_id") / 7) % 9 / 10.0).alias("p1"), (F.floor(F.col("doc_id") / 3) % 8 / 10.0).alias("p2"))
    best = base.select("doc_id", R.best_supported(F.array(cand(0), cand(1), cand(2))).alias("b"))
    return best.select("doc_id", F.col("b.index").alias("best_idx"), F.col("b.chunk").alias("chunk"))


@query("""with p as (select a.label, a.vec_id as sample_idx, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)), 6) as similarity
from embeddings a join (select label, min(vec_id) as f from embeddings group by label) q using (label) join embeddings b on b.vec_id = q.f where a.vec_id <> q.f)
select label, arg_min(sample_idx, (similarity, sample_idx)) as sample_idx, min(similarity) as similarity from p group by label""")
def least_similar(s, d):
    """The vector of each label that is least like its first."""
    e = cosine_to_first(s, d).withColumnRenamed("vec_id", "sample_idx").withColumnRenamed("cosine", "similarity")
    first = t(s, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("sample_idx"))
    return R.best_by(e.join(R.small(first), ["label", "sample_idx"], "left_anti"), ["label"], "similarity", "sample_idx", ["sample_idx", "similarity"], least=True)


@query("""with r as (select label, vec_id, list_transform(embedding, lambda x: x::double) as v, row_number() over (partition by label order by vec_id) as n from embeddings),
p as (select a.label, a.vec_id, avg(round(list_cosine_similarity(a.v, b.v), 6)) as m from r a join r b on a.label = b.label and b.n <= 3 and a.n > 3 group by a.label, a.vec_id)
select label, arg_min(vec_id, (round(m, 6), vec_id)) as vec_id, min(round(m, 6)) as mean from p group by label""")
def least_average_similar(s, d):
    """The vector least like the three used before, on average; used ones do not count."""
    e = R.ordinal(t(s, d, "embeddings"), [F.asc("vec_id")], "n", ["label"])
    used = e.where("n < 3").select("label", F.col("embedding").alias("u"))
    mean = e.where("n >= 3").join(R.small(used), "label").groupBy("label", "vec_id").agg(F.round(F.avg(F.round(cosine(F.col("embedding"), F.col("u")), 6)), 6).alias("mean"))
    return R.best_by(mean, ["label"], "mean", "vec_id", ["vec_id", "mean"], least=True)


@query("""with o as (select doc_id, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from documents)
select doc_id, pos, floor(pos / (n // 7 + 1))::int as part, floor(pos / ceil(n / 7.0))::int as exact from o""")
def range_partitions(s, d):
    """Ordinals on a stable key and contiguous partitions of them."""
    docs = t(s, d, "documents").select("doc_id")
    n = docs.agg(F.count("*").alias("n"))
    o = R.ordinal(docs, [F.asc("doc_id")], "pos").crossJoin(F.broadcast(n))
    return o.select("doc_id", "pos", R.range_part(F.col("pos"), F.col("n"), 7).alias("part"), R.exact_part(F.col("pos"), F.col("n"), 7).alias("exact"))


@query("""with m as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as a, row_number() over (partition by user_id, event_type order by ts, event_id) as b from events)
select user_id, event_type, min(a) - 1 as start, count(*) as length from m group by user_id, event_type, a - b""")
def entity_runs(s, d):
    """Runs of equal neighbours."""
    return R.islands(t(s, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], "event_type")


@query("""select user_id, event_id, base from (select user_id, event_id, coalesce(sum(v) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as base from (select *, floor(value)::bigint as v from events))""")
def running_offset(s, d):
    """Offsets of rows that hold several entries each."""
    e = t(s, d, "events").withColumn("v", F.floor("value").cast("bigint"))
    return R.running_offset(e, "v", [F.asc("ts"), F.asc("event_id")], ["user_id"]).select("user_id", "event_id", "base")


@query("select vec_id, list_transform(embedding[1:8], lambda x: x::double) as head, round(list_dot_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double)), 6) as squared from embeddings")
def array_truncation(s, d):
    """Arrays cut to their first entries."""
    return t(s, d, "embeddings").select("vec_id", R.truncate(F.col("embedding").cast("array<double>"), 8).alias("head"), F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("squared"))
