"""Text functions on hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T


@pytest.fixture(scope="module")
def of(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first().x

    return value


def ints(*xs):
    return F.array(*map(F.lit, xs)).cast("array<bigint>")


@pytest.mark.parametrize(("sizes", "chunks"), [((4, 5, 3, 9, 1), [0, 0, 1, 2, 2]), ((4, 6, 5), [0, 1, 2]), ((4, 6), [0, 0]), ((), []), ((20,), [0]), ((20, 1), [0, 1])])
def test_chunker(of, sizes, chunks):
    assert of(T.chunk_by_budget(ints(*sizes), 10)) == chunks


@pytest.mark.parametrize(("date", "want"), [("20-8-25", "20200825"), ("99-1-2", "19990102"), ("7-1-2", "20070102"), ("bad", "20220101")])
def test_check_date(of, date, want):
    assert of(T.check_date(F.lit(date))) == want


def test_other_dates(of):
    assert of(T.slash_date(F.lit("3/7/19"))) == "7-3-2019"
    assert of(T.slash_date(F.lit(None).cast("string"))) == "Unknown"
    assert of(T.stated_date(F.lit("stated on January 5, 2016 in an interview"))) == "5-1-2016"
    assert of(T.stated_date(F.lit("no date"))) is None
    assert [of(T.guarded_date(F.lit(x).cast("string"))) for x in ("25-8-2020", "1-1-1999", None)] == ["25-8-2020", "Unknown", "Unknown"]


def test_lines(of):
    lines = F.array(F.lit("x" * 49), F.lit("y" * 50))
    assert of(T.correct_lines(lines)) == ["y" * 50]
    long = ("a" * 60 + ". ") * 3
    assert of(T.pack_sentences(F.lit(long.strip()))) == ["a" * 60 + ". " + "a" * 60 + ".", "a" * 60 + "."]
    assert of(T.html_lines(F.lit(None).cast("string"))) == []
    assert of(T.html_lines(F.lit("<p>a &amp; b</p><script>x</script><p> c"))) == ["a & b", "c"]


def test_questions(of):
    assert of(T.with_question_mark(F.lit("why"))) == "why?"
    assert of(T.with_question_mark(F.lit('"why?"'))) == '"why?"'
    assert of(T.parse_generated(F.lit("Questions: Who did it? Who did it? No? What is the claim?"))) == ["Who did it?"]
    assert of(T.parse_first(F.lit("a\nb? c"))) == "a b?"


def test_answers(of):
    a = F.array(F.lit("x"), F.lit(None).cast("string"), F.lit("I'm SORRY"))
    assert of(T.first_without_information(a)) == 2
    assert of(T.first_without_information(F.array(F.lit("x")))) is None
    assert of(T.canonical_answer(F.lit("Sorry."))) == T.NO_ANSWER


def test_urls(of):
    assert of(T.domain(F.lit("www.a.org:80/x?y"))) == "a.org:80"
    assert of(T.domain(F.lit("https://b.a.org#t"))) == "b.a.org"
    assert not of(T.extension_allowed(F.lit("http://a/b.pdf")))


def test_mojibake(of):
    assert of(T.repair_mojibake(F.lit("cafÃ©"))) == "café"
    assert of(T.repair_mojibake(F.lit("日"))) is None


def test_tokens(of):
    table = of(T.token_table(F.lit("ab c")))
    assert [(r.text, r.span.begin, r.span.end) for r in table] == [("ab", 0, 2), ("c", 3, 4)]
    assert of(T.untokenise(T.token_table(F.lit("ab c")))) == "ab c"
    assert of(T.unbracket(F.lit("-LRB-"))) == "("
    assert of(T.ngrams(F.array(*map(F.lit, "abc")), 2)) == ["a", "a b", "b", "b c", "c"]
