"""Connector queries: whole tables written by a sink and read again by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions.scorers import dot
from evidentia.functions.text import html_lines
from evidentia.operators.joins import resume_after
from evidentia.operators.rank import ordinal
from evidentia.plans.base import STORED, claims, query, shared_folder, stored, t
from evidentia.sources import readers, schemas, sinks
from evidentia.streaming.ingest import pages_to_store


@query("select conv_id, turn, role, text from conversations")
def jsonl_round_trip(s, d):
    """JSON lines, appended to in two writes."""
    path, c = shared_folder(s), t(s, d, "conversations")
    sinks.json_lines(c.where("role = 'user'"), path, append=False)
    sinks.json_lines(c.where("role <> 'user'"), path)
    return readers.json_lines(s, path, schemas.CONVERSATION)


@query("select item_id, text from benchmark")
def json_document_round_trip(s, d):
    """One JSON document, as an array and under "data"."""
    one, two, b = shared_folder(s), shared_folder(s), t(s, d, "benchmark")
    sinks.json_document(b, one)
    sinks.json_document(b.select(F.col("item_id").cast("string").alias("prompt"), F.col("text").alias("output")), two, wrapped=True)
    plain = readers.json_document(s, one, "item_id LONG, text STRING")
    wrapped = readers.instruction_json(s, two).select(F.col("prompt").cast("bigint").alias("item_id"), F.col("output").alias("text"))
    return plain.join(wrapped, ["item_id", "text"])


@query("select page_id as index, url as link, (page_id % 3)::int as page, 'q' as search_string from pages")
def tsv_round_trip(s, d):
    """A search log as tab-separated values."""
    path = shared_folder(s)
    log = t(s, d, "pages").select(F.col("page_id").alias("index"), F.lit("c").alias("claim"), F.col("url").alias("link"), (F.col("page_id") % 3).cast("int").alias("page"), F.lit("q").alias("search_string"), F.lit("claim").alias("search_type"), F.lit("f").alias("store_file"))
    sinks.tsv(log, path)
    return readers.search_tsv(s, path).where("link is not null").select("index", "link", "page", "search_string")


@query("select conv_id::varchar as input, role as target from conversations")
def csv_round_trip(s, d):
    """Quoted CSV with a header."""
    path = shared_folder(s)
    sinks.csv(t(s, d, "conversations").select(F.col("conv_id").alias("input"), F.col("role").alias("target")), path)
    return readers.paired_csv(s, path)


@query("select claim_id, doc_id, lang from (select doc_id % (select count(*) from benchmark) as claim_id, doc_id, lang from documents)")
def partitioned_store(s, d):
    """The store, a folder for each claim, so that a filter on the claim prunes the others."""
    path = shared_folder(s)
    sinks.store(stored(s, d).select("claim_id", "doc_id", "lang"), path, append=False)
    return readers.store(s, path).select(F.col("claim_id").cast("bigint").alias("claim_id"), "doc_id", "lang")


@query("select item_id as position, text from benchmark")
def text_folder(s, d):
    """Text files by name."""
    path = shared_folder(s)
    b = t(s, d, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 9, "0").alias("name"), "text")
    b.write.partitionBy("name").text(path)
    return readers.text_folder(s, f"{path}/*").select(F.col("position").cast("bigint").alias("position"), F.regexp_replace("text", r"\n$", "").alias("text"))


@query("select url, min(page_id) as page_id from pages group by url")
def incremental_pages(s, d):
    """Extension, E13, E14, S12: pages ingested in micro-batches, each url once, and again without effect."""
    target, checkpoint = shared_folder(s), shared_folder(s)
    schema = t(s, d, "pages").schema
    for _ in range(2):
        pages_to_store(s, f"{d}/pages.parquet*", schema, target, checkpoint).awaitTermination()
    return s.read.parquet(target).join(t(s, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id")), "url").select("url", "page_id")


@query("select count(*) // 2 as n, count(*) // 2 as ids from documents")
def lazy_take(s, d):
    """The columns of a dataset from elsewhere and as many rows as asked for, whichever come first."""
    docs = t(s, d, "documents")
    some = readers.take(readers.hub(docs, ["doc_id"]), docs.count() // 2)
    return some.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))


@query("select doc_id, lang, md5(text) as text_md5 from documents where regexp_full_match(text, '(?s)[\\x00-\\xff]*') and not contains(text, chr(13))")
def latin1_csv(s, d):
    """S3, K4: documents whose letters Latin-1 has, written in that encoding and read from it."""
    path = shared_folder(s)
    fits = t(s, d, "documents").where(F.col("text").rlike(r"(?s)\A[\x00-\xff]*\z") & ~F.contains("text", F.lit("\r")))
    sinks.csv(fits.select("doc_id", "lang", "text"), path, "ISO-8859-1")
    return readers.csv_latin1(s, path, "doc_id LONG, lang STRING, text STRING").select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("select page_id as index, url as link, 'part-' as prefix from pages")
def tsv_files(s, d):
    """Many search logs with headers as one table, by a prefix of their names."""
    path = shared_folder(s)
    log = t(s, d, "pages").select(F.col("page_id").alias("index"), F.lit("c").alias("claim"), F.col("url").alias("link"), F.lit(0).alias("page"), F.lit("q").alias("search_string"), F.lit("claim").alias("search_type"), F.lit("f").alias("store_file"))
    log.repartition(5, "index").write.option("sep", "\t").option("header", True).csv(path)
    return readers.tsv_union(s, path, "part-").select("index", "link", F.substring("file", 1, 5).alias("prefix"))


@query("select item_id, text from benchmark")
def binary_texts(s, d):
    """Texts of files through a function from bytes to text."""
    path = shared_folder(s)
    t(s, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    got = readers.pdf_texts(s, f"{path}/*", lambda b: b.decode().removesuffix("\n"), "part-*.txt")
    return got.select(F.regexp_extract("url", r"item_id=(\d+)/", 1).cast("bigint").alias("item_id"), "text")


@query("select vec_id, label::varchar as label, round(list_dot_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double)), 6) as squared from embeddings")
def embedding_store(s, d):
    """K5: vectors written by label and read again."""
    path, e = shared_folder(s), t(s, d, "embeddings")
    sinks.embeddings(e.withColumn("claim_id", F.col("label")), path)
    return s.read.parquet(path).select("vec_id", F.col("claim_id").cast("string").alias("label"), F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("squared"))


@query(f"""with r as (select claim_id, doc_id, row_number() over (partition by claim_id order by doc_id) as position from {STORED} where doc_id % 28 <= claim_id % 28)
select claim_id, doc_id, position::int as position from r where position > 2 and position <= 4""")
def search_pages(s, d):
    """The second result page of every claim's search, two results a page, up to the claim's date."""
    asked = claims(s, d).select("claim_id", (F.col("claim_id") % 28).alias("check_date"))
    results = stored(s, d).select("claim_id", "doc_id", (F.col("doc_id") % 28).alias("result_date"))
    return readers.search(asked, results, "claim_id", "result_date", "check_date", "doc_id", page=1, size=2).select("claim_id", "doc_id", "position")


@query("select page_id from (select page_id, row_number() over (order by page_id) - 1 as o, count(*) over () as n from pages) where o >= n // 3")
def resume_by_count(s, d):
    """Rows from the number of lines on that a log already has."""
    pages = t(s, d, "pages").select("page_id")
    path = shared_folder(s)
    done = ordinal(pages, [F.asc("page_id")], "o").where(F.col("o") < pages.count() // 3)
    sinks.json_lines(done.select("page_id"), path, append=False)
    return resume_after(pages, readers.json_lines(s, path, "page_id LONG"), [F.asc("page_id")])


@query("select page_id, url from pages where length(html) > 0")
def page_texts(s, d):
    """Pages with lines."""
    return t(s, d, "pages").where(F.size(html_lines(F.col("html"))) > 0).select("page_id", "url")
