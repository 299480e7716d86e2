import corpus_pipeline as C

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_run_gives_what_they_give(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        assert docs.count() <= n
        n = docs.count()
    last = C.STAGES[-1][1](spark, docs, DATA)
    assert n > 0
    assert sorted(map(tuple, last.select("doc_id", "n_tokens", "exact").collect())) == sorted(map(tuple, C.run(spark, DATA).select("doc_id", "n_tokens", "exact").collect()))


def test_null_rows_pass_through(spark):
    rows = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES[:-1]:
        rows = stage(spark, rows, DATA)
        assert rows.where("doc_id is null").count() == 1
    assert C.STAGES[-1][1](spark, rows, DATA).count() == 2


def test_documents_without_an_id_are_searched(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = spark.createDataFrame([(None, "Before. " + item + " After."), (None, "Nothing of it here."), (None, None), (1, item), (2, "Nor here.")], "doc_id long, text string")
    left = dict(C.STAGES)["decontamination"](spark, rows, DATA).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, ""), (0, "Nothing of it here."), (2, "Nor here.")]


def test_any_columns_and_repeated_ids(spark):
    """Columns with the stages' own names, maps and arrays; two rows with one id, one of them a copy."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, text, 7, {"a": 1}, [1]), (5, text, 8, {"b": 2}, None), (5, "another text that no one else has, word for word", 9, None, [2]), (None, text, 1, None, None), (6, None, 1, None, None), (6, "", 1, {}, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, _key map<string,int>, row array<int>")
    stages = dict(C.STAGES)
    kept = stages["near_duplicates"](spark, docs, DATA)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.key) for r in kept.collect()) == [(1, text, 7), (5, rows[2][1], 9), (6, "", 1), (6, "", 1)]
    left = stages["decontamination"](spark, docs, DATA).collect()
    assert sorted((r.key, str(r._key)) for r in left) == sorted((r[2], str(r[3])) for r in rows)


def test_empty_table_and_a_very_long_text(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i}" for i in range(300_000))
    for rows, n in (([], 0), ([(1, long, "en", "s", len(long)), (2, long + " more", "en", "s", len(long) + 5)], 1)):
        docs = spark.createDataFrame(rows, columns)
        for _, stage in C.STAGES[1:-1]:
            docs = stage(spark, docs, DATA)
        assert C.STAGES[-1][1](spark, docs, DATA).count() == n
    assert C.STAGES[0][1](spark, spark.createDataFrame([], columns), DATA).count() == 0
