"""Text queries: filters, scalar functions, parsers, prompts, pages and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.functions.scorers import CHECKERS, checked, meteor
from evidentia.operators import boundaries as B
from evidentia.operators.rank import small
from evidentia.operators.tables import cut
from evidentia.plans.base import STORED, claims, query, stored, t, tok
from evidentia.sources.readers import page_lines, store_lines

LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_idx from documents)"
PHRASES = "(contains(lower({0}), 'sorry') or contains(lower({0}), 'no information') or contains(lower({0}), 'not provide') or contains(lower({0}), 'no evidence') or contains(lower({0}), 'not enough information'))"


def lines(s, d):
    return t(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))


@query(f"select claim_id, doc_id, line_idx, md5(line) as line_md5, md5(replace(text, chr(10), ' ')) as page_md5 from {STORED} join {LINES} using (doc_id) where text is not null")
def nonempty_store_join(s, d):
    """Non-empty pages of a claim's store as lines, and their lines joined by spaces."""
    got = store_lines(stored(s, d).withColumn("url2text", F.split("text", "\n")))
    return got.select("claim_id", "doc_id", "line_idx", F.md5("line").alias("line_md5"), F.md5("page_text").alias("page_md5"))


@query(f"select doc_id, line_idx, length(line) as n, length(line) >= 50 as in_store from {LINES} where length(line) >= 4")
def line_length_filter(s, d):
    """Lines long enough for the coarse store, marked for the fine one."""
    return lines(s, d).where(F.length("line") >= 4).select("doc_id", "line_idx", F.length("line").cast("bigint").alias("n"), (F.length("line") >= 50).alias("in_store"))


#: SQL of ``operators.boundaries``: word types, abbreviations, sentence starters, and the sentences of a text.
_CORE = r"regexp_replace(lower({0}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g')"
_TYPE = r"(case when rtrim({0}, '.') <> '' and not regexp_matches(rtrim({0}, '.'), '\p{{L}}') then '##number##' else rtrim({0}, '.') end)"
_DOUBT = r"(regexp_matches({0}, '^\p{{L}}$') or list_contains((select types from abbr), {0}))"
_RATIO = "((case when {k} > 0 then {k} * ln({p}) else 0 end) + (case when {n} > {k} then ({n} - {k}) * ln(1 - {p}) else 0 end))"


def _ratio(k: str, n: str, p: str) -> str:
    return _RATIO.format(k=k, n=n, p=p)


def _wide(x: str) -> str:
    return f"translate(trim({x}), chr(9) || chr(10) || chr(13), '   ')"


_LETTERS = "length(replace(type, '.', ''))"
BOUNDARIES = rf"""words as (select doc_id, string_split_regex(text, '[ \t\n\r]+') as w from documents),
types as (select type, count(*) filter (core like '%.') as n_period, count(*) filter (core not like '%.') as n_plain from (select core, {_TYPE.format('core')} as type from (select {_CORE.format('w')} as core from (select unnest(w) as w from words))) where type <> '' group by type),
total as (select sum(n_period + n_plain)::double as n, sum(n_period)::double as p from types),
shortened as (select * from (select type, n_period, n_plain, round(-2 * ({_ratio('n_period::double', '(n_period + n_plain)::double', '(p / n)')} - {_ratio('n_period::double', '(n_period + n_plain)::double', '0.99::double')})
  * exp(-{_LETTERS}::double) * (length(type) - {_LETTERS} + 1) * pow({_LETTERS}::double, -n_plain::double), 6) as score from types, total where n_period > 0 and type <> '##number##' and p < n) where score >= 0.3),
abbr as (select coalesce(list(type), []) as types from shortened),
pairs as (select unnest(list_zip(w, w[2:])) as z from words),
after as (select {_TYPE.format(_CORE.format('b'))} as type, regexp_matches(b, '^[^\p{{L}}\p{{N}}]*\p{{Lu}}') as capital from (select z[1] as a, z[2] as b, {_CORE.format('z[1]')} as core from pairs)
  where b <> '' and (regexp_matches(a, '[!?][^\p{{L}}\p{{N}}]*$') or (core like '%.' and not {_DOUBT.format(_TYPE.format('core'))}))),
found as (select type, count(*) filter (capital)::double as ab from after group by type),
openers as (select * from (select type, ab::bigint as n_after, round(-2 * ({_ratio('ab', 'a', '(b / n)')} + {_ratio('(b - ab)', '(n - a)', '(b / n)')} - {_ratio('ab', 'a', '(ab / a)')} - {_ratio('(b - ab)', '(n - a)', '((b - ab) / (n - a))')}), 6) as score
  from (select type, ab, (n_period + n_plain)::double as b, (select count(*)::double from after) as a, n from found join types using (type), total where type <> '##number##' and ab > 0) where a < n and ab / a > b / n) where score >= 30),
starts as (select coalesce(list(type), []) as types from openers)"""


def split_sql(text: str, rows: str, keep: str) -> str:
    """A table of the columns ``keep`` and ``sents``, the sentences of ``text``, of the rows of ``rows``."""
    core, word = _CORE.format(f"string_split({_wide('pieces[i - 1]')}, ' ')[-1]"), rf"string_split({_wide(r"regexp_replace(p, '^\s+', '')")}, ' ')[1]"
    doubt = _DOUBT.replace("(select types from abbr)", "known").format(_TYPE.format(core))
    goes_on = rf"({core} like '%.' and {doubt} and not (regexp_matches({word}, '^[^\p{{L}}\p{{N}}]*\p{{Lu}}') and list_contains(opening, {_TYPE.format(_CORE.format(word))})))"
    return rf"""(select {keep}, list_filter(list_transform(string_split(array_to_string(list_transform(pieces, lambda p, i: case when i = 1 or {goes_on} then p else chr(1) || p end), ''), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') as sents
  from (select *, string_split(regexp_replace({text}, '([.!?])(\s+)', '\1' || chr(1) || '\2', 'g'), chr(1)) as pieces from {rows}), (select types as known from abbr), (select types as opening from starts))"""


@query(f"with {BOUNDARIES} select type, n_period, n_plain, score from shortened")
def abbreviation_scores(s, d):
    """Abbreviations learnt from all documents by the log-likelihood of the full stop behind them."""
    types = cut(B.word_types(t(s, d, "documents")))
    return B.abbreviations(types).join(types, "type").select("type", "n_period", "n_plain", "score")


@query(f"with {BOUNDARIES} select type, n_after, score from openers")
def sentence_starters(s, d):
    """Words that begin sentences far more often than by chance."""
    docs = t(s, d, "documents")
    types = cut(B.word_types(docs))
    return B.sentence_starters(docs, types, cut(B.abbreviations(types).select("type")))


@query(f"with {BOUNDARIES} select doc_id, len(sents)::int as n, md5(array_to_string(sents, chr(1))) as sentences from {split_sql('text', 'documents', 'doc_id')}")
def learnt_sentences(s, d):
    """Sentences of whole documents, by boundaries learnt from all of them."""
    docs = t(s, d, "documents")
    cut_up = T.sentences(F.col("text"), on=F.col("_on"))
    return B.going_on(docs.select("doc_id", "text"), "text", *B.learn_tables(docs)).select("doc_id", F.size(cut_up).alias("n"), F.md5(F.array_join(cut_up, "\u0001")).alias("sentences"))


@query(rf"""with recursive {BOUNDARIES}, l as {split_sql('line', f"(select * from {LINES} where length(line) >= 50)", 'doc_id, line_idx, line, length(line) > 100 as long')},
f as (
  select doc_id, line_idx, sents, 1 as i, '' as open, []::varchar[] as packed from l where long
  union all
  select doc_id, line_idx, sents, i + 1, case when length(nxt) > 100 then '' else nxt end, case when length(nxt) > 100 then list_append(packed, nxt) else packed end
  from (select *, case when open = '' then sents[i] else open || ' ' || sents[i] end as nxt from f where i <= len(sents))),
done as (select doc_id, line_idx, case when length(open) > 50 then list_append(packed, open) else packed end as packed from f where i = len(sents) + 1),
every as (select doc_id, line_idx, packed from done union all select doc_id, line_idx, [line] from l where not long)
select doc_id, line_idx, unnest(generate_series(0, len(packed) - 1))::int as part, md5(unnest(packed)) as part_md5 from every where len(packed) > 0""")
def line_packer(s, d):
    """Short lines dropped, long ones packed, whole, from their sentences, which end where the
    boundaries learnt from all documents say."""
    known, starters = B.learn_tables(t(s, d, "documents"))
    packed = T.pack_sentences(F.col("line"), on=F.col("_on"))
    got = B.going_on(lines(s, d).where(F.length("line") >= 50), "line", known, starters).select("doc_id", "line_idx", F.posexplode(packed).alias("part", "x"))
    return got.select("doc_id", "line_idx", "part", F.md5("x").alias("part_md5"))


def _html_sql() -> str:
    x = "html"
    for name in ("script", "style", "nav", "footer", "head"):
        x = f"regexp_replace({x}, '(?is)<{name}[^a-zA-Z].*?</{name}>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|body|html)[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for ref, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{ref}', '{c}')"
    x = rf"regexp_replace({x}, '[ \t\r]+', ' ', 'g')"
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"select page_id, generate_subscripts(l, 1) - 1 as line_idx, unnest(l) as line from (select page_id, {_html_sql()} as l from pages)")
def html_to_lines(s, d):
    """Text lines of fetched pages."""
    p = t(s, d, "pages")
    return page_lines(p.select("page_id", "url"), p.select("page_id", "html"), "page_id").select("page_id", F.posexplode("lines").alias("line_idx", "line"))


HOST = r"regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)', 1), '^www\.', '')"


@query(f"select page_id, {HOST} as host, {HOST} not in ('jstor.org', 'facebook.com', 'ftp.cs.princeton.edu', 'nlp.cs.princeton.edu', 'huggingface.co', 'example.com') as host_ok, not contains(url, '/glove.') and not contains(url, '/fr/') as path_ok, not (list_last(string_split(url, '.')) in ('pdf', 'doc', 'org')) as ext_ok from pages")
def url_filters(s, d):
    """Hosts and the three block lists (with entries that the data meets)."""
    u = F.col("url")
    return t(s, d, "pages").select("page_id", T.domain(u).alias("host"), T.host_allowed(u, (*T.BLOCKED_HOSTS, "example.com")).alias("host_ok"), T.path_allowed(u, ("/glove.", "/fr/")).alias("path_ok"), T.extension_allowed(u, ("pdf", "doc", "org")).alias("ext_ok"))


@query("select page_id, url from pages where not contains(url, '#')")
def url_allowed(s, d):
    """P3 to P5 as a filter over whole pages."""
    return t(s, d, "pages").where(T.path_allowed(F.col("url"), ("#",)) & T.extension_allowed(F.col("url"))).select("page_id", "url")


@query("""select conv_id, turn, coalesce(nullif(role, 'system'), 'Unknown') as role_or_unknown,
case when length(trim(role)) > 4 then trim(role) else 'they' end as speaker, case when not contains(role, 'ser') then role end as unless_link from conversations""")
def missing_values(s, d):
    """Fixed words for missing names."""
    r = F.col("role")
    return t(s, d, "conversations").select("conv_id", "turn", T.or_unknown(F.nullif(r, F.lit("system"))).alias("role_or_unknown"), F.when(F.length(F.trim(r)) > 4, T.speaker_or_they(r)).otherwise("they").alias("speaker"), F.when(~F.contains(r, F.lit("ser")), T.speaker_unless_link(r)).alias("unless_link"))


ANSWERS = "[text, case when doc_id % 3 = 0 then 'Sorry, not here' else text end, case when doc_id % 2 = 0 then 'There is no evidence for it' else lang end]"


def answers(s, d):
    x, k = F.col("text"), F.col("doc_id")
    return t(s, d, "documents").select("doc_id", "lang", "text", F.array(x, F.when(k % 3 == 0, "Sorry, not here").otherwise(x), F.when(k % 2 == 0, "There is no evidence for it").otherwise(F.col("lang"))).alias("answers"))


@query(f"select doc_id, (list_position(list_transform({ANSWERS}, lambda a: {PHRASES.format('a')}), true) - 1)::bigint as first_nothing, md5(case when contains(lower(({ANSWERS})[2]), 'sorry') then 'No answer could be found.' else ({ANSWERS})[2] end) as canonical from documents")
def noinfo_detect(s, d):
    """Where the first empty answer is, and the canonical text for it."""
    return answers(s, d).select("doc_id", T.first_without_information(F.col("answers")).cast("bigint").alias("first_nothing"), F.md5(T.canonical_answer(F.col("answers")[1])).alias("canonical"))


@query(f"""select doc_id, list_contains(list_transform({ANSWERS}, lambda c: contains(c, 'Sorry')), true) as has_error, contains(lower(lang), 'e') or (contains(lower(text), 'no ') and not contains(lower(text), 'no answer could be found')) as yes_no,
len({tok('text')}) < 400 as in_budget, not contains(text, 'claim') as no_mention, md5(case when lang = 'en' then text || ', ' || source else text end) as typed, contains(text, 'null null') as placeholder from documents""")
def answer_predicates(s, d):
    """Predicates over answers and chunks."""
    x, lang = F.col("text"), F.col("lang")
    yes = (F.contains(F.lower(lang), F.lit("e")) | (F.contains(F.lower(x), F.lit("no ")) & ~F.contains(F.lower(x), F.lit("no answer could be found"))))
    return answers(s, d).join(t(s, d, "documents").select("doc_id", "source"), "doc_id").select(
        "doc_id", T.has_error(F.col("answers"), "Sorry").alias("has_error"), yes.alias("yes_no"), (F.size(T.tokens(x)) < 400).alias("in_budget"), (~T.mentions_claim(x)).alias("no_mention"),
        F.md5(T.typed_answer(x, F.when(lang == "en", "Boolean"), F.col("source"))).alias("typed"), T.placeholder(x).alias("placeholder"),
    )


@query("select doc_id, contains(lower(text), 'yes') or (contains(lower(text), 'no ') and not contains(lower(text), 'no answer could be found')) as yes_no from documents")
def yes_no_answers(s, d):
    """P12."""
    return t(s, d, "documents").select("doc_id", T.yes_or_no(F.col("text")).alias("yes_no"))


@query("select lang, source, count(*) as n from documents where not (doc_id in (select doc_id from labels where toxic = 1)) group by lang, source")
def split_by_type(s, d):
    """Listed bad rows left out, the rest by type."""
    bad = t(s, d, "labels").where("toxic = 1").select("doc_id")
    return t(s, d, "documents").join(bad, "doc_id", "left_anti").groupBy("lang", "source").agg(F.count("*").alias("n"))


D1 = "strftime(o_orderdate, '%y-%-m-%-d')"


@query(f"""select o_orderkey, (case when p[1]::int <= 30 then '20' else '19' end) || p[1] || lpad(p[2], 2, '0') || lpad(p[3], 2, '0') as check_date,
p[3] || '-' || p[2] || '-20' || p[1] as slash, p[3] || '-' || p[2] || '-' || strftime(o_orderdate, '%Y') as stated,
case when strftime(o_orderdate, '%Y')[1:2] = '19' then 'Unknown' else p[3] || '-' || p[2] || '-' || strftime(o_orderdate, '%Y') end as guarded
from (select *, string_split({D1}, '-') as p from orders)""")
def date_normalise(s, d):
    """The four date normalisers on dates written as the sources write them."""
    x = F.col("o_orderdate")
    dash, slash = F.concat_ws("-", F.date_format(x, "yy"), F.month(x).cast("string"), F.day(x).cast("string")), F.concat_ws("/", F.month(x).cast("string"), F.day(x).cast("string"), F.date_format(x, "yy"))
    free = F.concat(F.lit("stated on "), F.date_format(x, "MMMM d, yyyy"), F.lit(" in an interview"))
    return t(s, d, "orders").select("o_orderkey", T.check_date(dash).alias("check_date"), T.slash_date(slash).alias("slash"), T.stated_date(free).alias("stated"), T.guarded_date(F.concat_ws("-", F.day(x).cast("string"), F.month(x).cast("string"), F.year(x).cast("string"))).alias("guarded"))


QTEXT = "replace(text, '.', '?')"


def _pieces(x: str, low: int, high: int | None = None) -> str:
    cond = f"length(p) > {low}" + (f" and length(p) <= {high}" if high else "")
    return f"list_transform(list_filter(list_transform(string_split({x}, '?'), lambda p: trim(p)), lambda p: {cond}), lambda p: p || '?')"


@query(f"""with q as (select doc_id, 'Questions: ' || {QTEXT} as x from documents), l as (select doc_id, {_pieces("x[12:]", 1)} as a, {_pieces("x[11:]", 0)} as b, {_pieces("string_split(x, chr(10))[1]", 0, 299)} as c, replace(string_split(x[1:250], '?')[1], chr(10), ' ') || '?' as first from q),
f as (select doc_id, first, list_filter(a, lambda v, i: list_position(a, v) = i and len(string_split(v, ' ')) >= 3 and lower(v) not in ('what is the?', 'what is the claim?')) as a, list_filter(b, lambda v, i: list_position(b, v) = i) as b, list_filter(c, lambda v, i: list_position(c, v) = i) as c from l)
select doc_id, first, len(a)::int as n_a, len(b)::int as n_b, len(c)::int as n_c, md5(array_to_string(a, '|')) as a, md5(array_to_string(b, '|')) as b, md5(array_to_string(c, '|')) as c from f""")
def question_parse(s, d):
    """The question parsers on texts with question marks."""
    x = F.concat(F.lit("Questions: "), F.replace(F.col("text"), F.lit("."), F.lit("?")))
    got = t(s, d, "documents").select("doc_id", T.parse_generated(x).alias("a"), T.parse_listed(x).alias("b"), T.parse_first_line(x).alias("c"), T.parse_first(x).alias("first"))
    return got.select("doc_id", "first", *[F.size(c).alias(f"n_{c}") for c in "abc"], *[F.md5(F.array_join(c, "|")).alias(c) for c in "abc"])


@query("select doc_id, md5(case when contains(text[-3:], '?') then text else text || '?' end) as q from (select doc_id, replace(text, '.', '?') as text from documents)")
def question_mark(s, d):
    """T8."""
    return t(s, d, "documents").select("doc_id", F.md5(T.with_question_mark(F.replace(F.col("text"), F.lit("."), F.lit("?")))).alias("q"))


@query(f"""select claim_id, 512 - len({tok('claim')}) - 3 as budget, len(list_slice({tok('claim')}, 1, greatest(0, 30 - 5 - 10)))::int as cut, 'They stated ' || claim || '  ' || claim as q, claim || claim || 'x' as dense, 'Instruct: Find it' || chr(10) || 'Query: ' || claim as instruct,
array_to_string(list_concat(['ann'], list_filter(regexp_split_to_array(trim(claim), '\\s+'), lambda w: lower(w) not in ('a', 'an', 'the', 'of', 'in', 'on', 'at', 'to', 'for', 'and', 'or', 'is', 'are', 'was', 'were', 'be', 'by', 'with', 'that', 'this', 'it', 'as', 'from'))), ' ') as search,
'x [SEP] ' || trim(claim) as triple, '[CLAIM] ' || trim(claim) || ' [QUESTION] why? no, because it is so' as serial from (select item_id as claim_id, text as claim from benchmark)""")
def query_builders(s, d):
    """Budgets, queries, search strings and serialisers."""
    c = F.col("claim")
    return claims(s, d).select(
        "claim_id", T.question_budget(c).cast("bigint").alias("budget"), F.size(T.cut_premise(T.tokens(c), F.array(*[F.lit("x")] * 5), 30)).alias("cut"), T.query_text(c, c, F.lit("They")).alias("q"), T.dense_query(c, F.array(c, F.lit("x"))).alias("dense"),
        T.instruct("Find it", c).alias("instruct"), T.search_string(c, F.lit("ann")).alias("search"), T.triple(F.array(F.lit(" x "), c)).alias("triple"), T.claim_question_answer(c, F.lit("why?"), F.lit("no"), F.lit(" It is so")).alias("serial"),
    )


@query(r"""select claim_id, 'Outrageously, ' || 'Ann' || ' claimed that "' || trim(claim) || '". Criticism includes questions like: who? why?' as shot,
'Evidence: ' || (case when x[-1:] in ('.', '!', '?') then x else x || '.' end) || ' Question answered: why?' as evidence,
'<|begin_of_text|> You are a fact-checker and your task is to generate critical questions for verifying the following claim.' || chr(10) || 'Claim date: 1-2-2020' || chr(10) || 'Claimer: Ann' || chr(10) || 'Claim: ' || claim || chr(10) || 'Questions: ' as prompt, 'who? why?' as target
from (select item_id as claim_id, text as claim, trim(regexp_replace(text, '\s*\n\s*', ' ', 'g')) as x from benchmark)""")
def prompt_builders(s, d):
    """Few-shot examples, evidence pairs and question prompts."""
    c = F.col("claim")
    return claims(s, d).select(
        "claim_id", T.few_shot(c, F.lit("Ann"), F.array(F.lit("who?"), F.lit("why?"))).alias("shot"), T.evidence_question(c, F.lit("why?")).alias("evidence"),
        T.question_prompt(F.lit("1-2-2020"), F.lit("Ann"), c).alias("prompt"), T.question_target(F.array(F.lit("who"), F.lit("why?"))).alias("target"),
    )


@query(f"""with c as (select *, row_number() over (partition by conv_id, role = 'user' order by turn) as n from conversations where role <> 'system')
select conv_id, md5('{T.CHAT_SYSTEM.replace("'", "''")}' || chr(10) || chr(10) || 'ctx' || chr(10) || chr(10) || string_agg(case when role = 'user' then 'User: ' || (case when n = 1 then '{T.CHAT_INSTRUCTION} ' else '' end) || text else 'Assistant: ' || text end, chr(10) || chr(10) order by turn) || chr(10) || chr(10) || 'Assistant:') as rendered, count(*) as turns from c group by conv_id""")
def chat_render(s, d):
    """Conversations as one prompt; the instruction goes before the first user turn only."""
    from pyspark.sql import Window

    turns = t(s, d, "conversations").where("role <> 'system'").withColumn("u", F.col("role") == "user").withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "u").orderBy("turn")))
    line = F.when(F.col("u"), F.concat(F.lit("User: "), F.when(F.col("n") == 1, T.CHAT_INSTRUCTION + " ").otherwise(""), "text")).otherwise(F.concat(F.lit("Assistant: "), "text"))
    got = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda r: r["x"]), "\n\n").alias("c"), F.count("*").alias("turns"))
    return got.select("conv_id", F.md5(F.concat(F.lit(T.CHAT_SYSTEM + "\n\nctx\n\n"), "c", F.lit("\n\nAssistant:"))).alias("rendered"), "turns")


@query("""with r as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as n from conversations)
select conv_id, md5(string_agg(text, chr(10) || chr(10) order by n desc) filter (n <= 3)) as context, md5(string_agg('Question ' || n || ': q' || chr(10) || 'Answer ' || n || ': ' || replace(text, chr(10) || chr(10), chr(10)) || chr(10), '' order by n)) as pairs, md5(string_agg(n || '. ' || text, chr(10) order by n)) as numbered from r group by conv_id""")
def qa_context(s, d):
    """Contexts with the most relevant last, numbered pairs and lists."""
    got = t(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("x"))
    pairs = F.transform("x", lambda a: F.struct(F.lit("q").alias("question"), a.alias("answer")))
    return got.select("conv_id", F.md5(T.reversed_context(F.col("x"), 3)).alias("context"), F.md5(T.numbered_pairs(pairs)).alias("pairs"), F.md5(T.numbered_list(F.col("x"))).alias("numbered"))


GUARD = "Task: Check if there is unsafe content in the conversation.\n\n<CATEGORIES>\n{0}\n</CATEGORIES>\n\n<CONVERSATION>\n\n"


@query("""select conv_id, md5('Task: Check if there is unsafe content in the conversation.' || chr(10) || chr(10) || '<CATEGORIES>' || chr(10) || 'S1: Crime' || chr(10) || 'S2: Hate' || chr(10) || '</CATEGORIES>' || chr(10) || chr(10) || '<CONVERSATION>' || chr(10) || chr(10) ||
string_agg((case when turn % 2 = 0 then 'User' else 'Agent' end) || ': ' || text, chr(10) || chr(10) order by turn)) as prompt from conversations group by conv_id""")
def guard_prompt(s, d):
    """Safety prompts over conversations with alternating roles."""
    names = T.categories([("Crime", ""), ("Hate", "")], "S")
    line = F.concat(T.turn_role(F.col("turn")), F.lit(": "), "text")
    got = t(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda r: r["x"]), "\n\n").alias("c"))
    return got.select("conv_id", F.md5(F.concat(F.lit(GUARD.format(names)), "c")).alias("prompt"))


@query("select doc_id, quality, 'O' || (quality + 1) as code, (('O' || (toxic + 1))[2:])::int - 1 as back, (case when toxic = 1 then 'unsafe' else 'safe' end) = 'safe' as safe from labels")
def guard_codes(s, d):
    """Category codes and verdict lines."""
    lab = t(s, d, "labels")
    return lab.select("doc_id", "quality", T.index_to_code(F.col("quality")).alias("code"), T.code_to_index(T.index_to_code(F.col("toxic"))).alias("back"), T.is_safe(F.when(F.col("toxic") == 1, F.lit("unsafe\nO1")).otherwise("safe\n")).alias("safe"))


@query(f"select conv_id, turn, not list_has_any({tok('text')}, ['kill', 'bomb', 'weapon']) as words_safe, length(trim(text)) > 0 as not_empty from conversations")
def safety_checkers(s, d):
    """Named checkers over turns."""
    got = checked(t(s, d, "conversations"), "text", list(CHECKERS))
    return got.select("conv_id", "turn", F.col("checks")[0]["is_safe"].alias("words_safe"), F.col("checks")[1]["is_safe"].alias("not_empty"))


def _spacing_sql(x: str) -> str:
    for old, new in T.SPACING:
        x = "replace({}, '{}', '{}')".format(x, old.replace("'", "''"), new.replace("'", "''"))
    return x


@query(f"select doc_id, md5({_spacing_sql('text')}) as fixed, string_split(text, ' ')[1] as first_token, md5(array_to_string(list_transform(string_split(text, ' '), lambda w: case w when '-LRB-' then '(' when 'The' then 'The' else w end), ' ')) as unbracketed from documents")
def text_repairs(s, d):
    """Spacing, bracket tokens, first tokens."""
    x = F.col("text")
    return t(s, d, "documents").select("doc_id", F.md5(T.fix_spacing(x)).alias("fixed"), T.first_token(x).alias("first_token"), F.md5(F.array_join(F.transform(T.words(x), T.unbracket), " ")).alias("unbracketed"))


@query("select string_split(text, ' ')[1] as token, count(*) as n from documents group by 1")
def first_token_freq(s, d):
    """How often each first token occurs."""
    return t(s, d, "documents").groupBy(T.first_token(F.col("text")).alias("token")).agg(F.count("*").alias("n"))


@query(f"""with w as (select item_id, {tok('text')} as tk from benchmark), g as (select item_id, s, k, array_to_string(tk[s:s + k - 1], ' ') as g from w, unnest(generate_series(1, len(tk))) as a(s), unnest([1, 2, 3]) as b(k) where s + k - 1 <= len(tk))
select item_id, count(*) as n, md5(string_agg(g, '|' order by s, k)) as grams from g group by item_id""")
def ngram_spans(s, d):
    """All runs of one to three tokens."""
    g = T.ngrams(T.tokens(F.col("text")), 3)
    return t(s, d, "benchmark").select("item_id", F.size(g).cast("bigint").alias("n"), F.md5(F.array_join(g, "|")).alias("grams"))


@query(f"""with w as (select item_id, {tok('text')} as tk from benchmark), g as (select item_id, s, k, array_to_string(tk[s:s + k - 1], ' ') as g from w, unnest(generate_series(1, len(tk))) as a(s), unnest([1, 2, 3]) as b(k)
  where s + k - 1 <= len(tk) and not list_contains({list(T.STOP_WORDS)}, tk[s]) and not list_contains({list(T.STOP_WORDS)}, tk[s + k - 1]))
select item_id, coalesce(count(g), 0) as n, md5(coalesce(string_agg(g, '|' order by s, k), '')) as grams from w left join g using (item_id) group by item_id""")
def ngram_filter(s, d):
    """Runs of one to three tokens that neither begin nor end with a stop word."""
    g = T.ngrams(T.tokens(F.col("text")), 3, T.no_stop_word_outside)
    return t(s, d, "benchmark").select("item_id", F.size(g).cast("bigint").alias("n"), F.md5(F.array_join(g, "|")).alias("grams"))


@query(r"""select item_id, len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> ''))::int as n, regexp_replace(text, '[ \t\n\r]+$', '') as again,
coalesce(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')[1], '') as first_piece, length(regexp_extract(text, '^[ \t\n\r]*[^ \t\n\r]*'))::int as first_end from benchmark""")
def token_tables(s, d):
    """Tokens with offsets, and the text put together again."""
    got = t(s, d, "benchmark").select("item_id", "text", T.token_table(F.col("text")).alias("r"))
    first = F.get("r", F.lit(0))
    return got.select("item_id", F.size("r").alias("n"), T.untokenise(F.col("r")).alias("again"), F.coalesce(F.get(T.by_offsets(F.col("text"), F.transform("r", lambda x: x["span"])), F.lit(0)), F.lit("")).alias("first_piece"), F.coalesce(first["span"]["end"], F.length("text")).alias("first_end"))


@query()
def mojibake_repair(s, d):
    """Texts that were decoded wrongly, put right; null where that fails."""
    return t(s, d, "documents").select("doc_id", F.md5(T.repair_mojibake(F.col("text"))).alias("repaired"))


@query()
def meteor_exact(s, d):
    """METEOR by stems and fewest chunks, between each claim and the whole texts of its store's documents."""
    texts = stored(s, d).select("claim_id", "doc_id", "text")
    return texts.join(small(claims(s, d)), "claim_id").select("claim_id", "doc_id", F.round(meteor(F.col("text"), F.col("claim")), 6).alias("score"))
