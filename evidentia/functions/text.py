"""Text functions as Column builders: pure expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

# --- Fixed values -------------------------------------------------------------------------------

#: Phrases by which an answer says that nothing was found.
NO_INFORMATION = ("sorry", "no information", "not provide", "no evidence", "not enough information")
NO_ANSWER = "No answer could be found."
ERROR_MARK = "Something went wrong."
EMPTY_QUESTIONS = ("what is the?", "what is the claim?")
BLOCKED_HOSTS = ("jstor.org", "facebook.com", "ftp.cs.princeton.edu", "nlp.cs.princeton.edu", "huggingface.co")
BLOCKED_PATHS = ("/glove.", "ftp://ftp.cs.princeton.edu/pub/cs226/autocomplete/words-333333.txt", "https://web.mit.edu/adamrose/Public/googlelist")
BLOCKED_EXTENSIONS = ("pdf", "doc")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}
SPACING = (
    (" .", "."), (" ,", ","), (" '", "'"), (" ?", "?"), (" !", "!"), (" :", ":"), (" ;", ";"), (" n't", "n't"), (" v", "v"),
    ("2 0 0 6", "2006"), ("5 5", "55"), ("4 0 0", "400"), ("1 7-5 0", "1750"), ("2 0 %", "20%"), ("5 0", "50"), ("1 2", "12"), ("1 0", "10"),
    ('" ballast water', '"ballast water'),
)
STOP_WORDS = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "is", "are", "was", "were", "be", "by", "with", "that", "this", "it", "as", "from")
CHAT_SYSTEM = (
    "System: This is a chat between a user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite "
    "answers to the user's questions based on the context. The assistant should also indicate when the answer cannot be found in the context."
)
CHAT_INSTRUCTION = "Please give a full and complete answer for the question."
QUESTION_PROMPT = "<|begin_of_text|> You are a fact-checker and your task is to generate critical questions for verifying the following claim.\nClaim date: "
VERIFY_PROMPT = (
    "<|begin_of_text|> Your task is to verify the claims based on the context information in format of question answer pairs. Verify the claim "
    "with justification using the following labels: Supported, Refuted, Not Enough Evidence, Conflicting Evidence/Cherrypicking.\n\n"
)

#: Texts of the prompts' parts, in the order in which they come.
STATED = " stated "
INSTRUCT = ("Instruct: ", "\nQuery: ")
CLAIM_QUESTION = ("[CLAIM] ", " [QUESTION] ", ", because ")
FEW_SHOT = ("Outrageously, ", ' claimed that "', '". Criticism includes questions like: ')

# --- Words and sentences ------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives null."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")  # the text is read once, also inside of lambdas


def words(text: Column) -> Column:
    """Pieces between single spaces, as they are."""
    return F.split(text, " ")


#: White space between words, as a pattern.
BLANKS = r"[ \t\n\r]+"


def word_core(word: Column) -> Column:
    """A word in lower case without what is neither letter nor digit around it, but for full stops behind it."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")


def core_type(core: Column) -> Column:
    """The type of a ``word_core``: it without the full stops behind it; whatever has no letter is a number."""
    bare = F.rtrim(core, F.lit("."))
    return F.when((bare != "") & ~F.rlike(bare, F.lit(r"\p{L}")), "##number##").otherwise(bare)


def is_capitalised(word: Column) -> Column:
    return F.rlike(word, F.lit(r"^[^\p{L}\p{N}]*\p{Lu}"))


def pieces(text: Column) -> Column:
    """A text cut after each full stop, exclamation or question mark with white space behind it."""
    return F.split(F.regexp_replace(text, r"([.!?])(\s+)", "$1\u0001$2"), "\u0001")


def _edge(x: Column, i: int) -> Column:
    return F.substring_index(F.translate(F.trim(x), "\t\n\r", "   "), " ", i)


def cuts(text: Column) -> Column:
    """For each cut of ``pieces``, the word before it and the word behind it."""
    parts, n = pieces(text), F.size(pieces(text)) - 1
    both = lambda x, y: F.struct(_edge(x, -1).alias("before"), _edge(F.regexp_replace(y, r"^\s+", ""), 1).alias("behind"))
    return F.zip_with(F.slice(parts, F.lit(1), n), F.slice(parts, F.lit(2), n), both)


def sentences(text: Column, boundaries=None, on: Column | None = None) -> Column:
    """Trimmed sentences: text is cut after a full stop, exclamation or question mark with white space
    behind it. With ``boundaries`` (``operators.boundaries.Boundaries``), a full stop behind one of its
    abbreviations, or behind a single letter, cuts only before a capitalised one of its starters; with
    ``on``, the cuts of these numbers, from 1, are none (``operators.boundaries.going_on``)."""
    if on is not None:
        marked = F.array_join(F.transform(pieces(text), lambda p, i: F.when((i == 0) | F.array_contains(on, i), p).otherwise(F.concat(F.lit("\u0001"), p))), "")
    elif boundaries is None:
        marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    else:
        from evidentia.operators.boundaries import doubtful

        def joined(before: Column, piece: Column) -> Column:
            core, word = word_core(_edge(before, -1)), _edge(F.regexp_replace(piece, r"^\s+", ""), 1)
            opens = is_capitalised(word) & (core_type(word_core(word)).isin(*boundaries.starters) if boundaries.starters else F.lit(False))
            goes_on = F.endswith(core, F.lit(".")) & doubtful(core_type(core), boundaries.abbreviations) & ~opens
            return F.when(before.isNull() | goes_on, piece).otherwise(F.concat(F.lit("\u0001"), piece))

        parts = pieces(text)
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(parts, F.lit(1), F.size(parts) - 1))
        marked = F.array_join(F.zip_with(before, parts, joined), "")
    blanks = F.lit(" ") if boundaries is None and on is None else F.lit(" \t\n\r")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s, blanks)), lambda s: s != "")


def first_token(text: Column) -> Column:
    return F.split(text, " ")[0]


def ngrams(items: Column, n: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """All runs of one to ``n`` items, joined by a space, by start and then length; with ``keep``, those whose
    array of items it accepts."""

    def from_start(s: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.least(F.lit(n), F.size(items) - s)), lambda k: F.slice(items, s + 1, k))
        return F.transform(runs if keep is None else F.filter(runs, keep), lambda r: F.array_join(r, " "))

    spans = F.transform(F.sequence(F.lit(0), F.size(items) - 1), from_start)
    return F.when(F.size(items) > 0, F.flatten(spans)).otherwise(F.array().cast("array<string>"))


def no_stop_word_outside(gram: Column) -> Column:
    """Whether a run of words neither begins nor ends with a stop word."""
    return ~F.element_at(gram, 1).isin(*STOP_WORDS) & ~F.element_at(gram, -1).isin(*STOP_WORDS)


def unbracket(token: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in BRACKETS.items() for x in kv)), token), token)


def fix_spacing(text: Column) -> Column:
    """Literal replacements, in order."""
    for old, new in SPACING:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def by_offsets(text: Column, spans: Column) -> Column:
    """Pieces of a text by an array of (begin, end) offsets, end exclusive."""
    return F.transform(spans, lambda s: F.substring(text, s["begin"] + 1, s["end"] - s["begin"]))


@F.pandas_udf(ArrayType(IntegerType()))
def _sums_before(sizes: pd.Series) -> pd.Series:
    """Of each array, the sum of the entries before each."""
    return sizes.map(lambda x: None if x is None else np.cumsum(x, dtype=np.int32) - x)


def token_table(text: Column) -> Column:
    """Tokens with their text, the text with the white space after it, and offsets: runs of what is not
    white space, in linear time. Part of speech, lemma and entity are null: no annotator was asked for."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^ \t\n\r]+[ \t\n\r]*|[ \t\n\r]+"), F.lit(0))
    starts = _sums_before(F.transform(pieces, lambda p: F.length(p)))

    def row(p: Column, s: Column) -> Column:
        word = F.rtrim(p, F.lit(" \t\n\r"))
        return F.struct(word.alias("text"), p.alias("text_ws"), F.struct(s.alias("begin"), (s + F.length(word)).alias("end")).alias("span"), *[F.lit(None).cast("string").alias(n) for n in ("pos", "lemma", "ner")])

    return F.filter(F.zip_with(pieces, starts, row), lambda r: r["text"] != "")


def untokenise(rows: Column) -> Column:
    return F.rtrim(F.array_join(F.transform(rows, lambda r: r["text_ws"]), ""), F.lit(" \t\n\r"))


# --- Addresses ----------------------------------------------------------------------------------


def domain(url: Column) -> Column:
    """The authority of a URL, with its port; a scheme may be absent; a leading "www." goes."""
    return F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1), r"^www\.", "")


def host_allowed(url: Column, blocked: tuple[str, ...] = BLOCKED_HOSTS) -> Column:
    return ~domain(url).isin(*blocked)


def path_allowed(url: Column, blocked: tuple[str, ...] = BLOCKED_PATHS) -> Column:
    out = F.lit(True)
    for b in blocked:
        out = out & ~F.contains(url, F.lit(b))
    return out


def extension_allowed(url: Column, blocked: tuple[str, ...] = BLOCKED_EXTENSIONS) -> Column:
    return ~F.substring_index(url, ".", -1).isin(*blocked)


# --- Missing values and names -------------------------------------------------------------------


def or_unknown(value: Column) -> Column:
    return F.coalesce(value, F.lit("Unknown"))


def speaker_or_they(name: Column) -> Column:
    return F.when(F.length(F.trim(name)) > 1, F.trim(name)).otherwise("they")


def speaker_unless_link(name: Column) -> Column:
    return F.when(~F.contains(name, F.lit("http")), name)


# --- Dates as strings ---------------------------------------------------------------------------


def check_date(date: Column) -> Column:
    """``y-m-d`` as ``yyyymmdd``; years of two digits up to 30 are 20yy, above it 19yy, of one digit
    200y; anything without three parts is the start of 2022."""
    parts = F.split(date, "-")
    year, month, day = (F.get(parts, F.lit(i)) for i in range(3))
    full = F.when(F.length(year) == 2, F.when(year.try_cast("int") <= 30, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))).when(F.length(year) == 1, F.concat(F.lit("200"), year)).otherwise(year)
    return F.when(F.size(parts) == 3, F.concat(full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))).otherwise("20220101")


def slash_date(date: Column) -> Column:
    """``m/d/yy`` as ``d-m-20yy``; null is Unknown."""
    p = F.split(date, "/")
    return F.when(date.isNull(), "Unknown").otherwise(F.concat(F.get(p, F.lit(1)), F.lit("-"), F.get(p, F.lit(0)), F.lit("-20"), F.get(p, F.lit(2))))


def stated_date(text: Column) -> Column:
    """``… on Month d, yyyy in …`` as ``d-m-yyyy``; null if there is none."""
    pattern = r"on ([A-Z][a-z]+) (\d{1,2}), (\d{4}) in"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(text, pattern, 1))
    return F.when(month > 0, F.concat_ws("-", F.regexp_extract(text, pattern, 2), month.cast("string"), F.regexp_extract(text, pattern, 3)))


def guarded_date(date: Column) -> Column:
    """Dates without a value or with a year of the last century are Unknown."""
    return F.when(date.isNull() | F.coalesce(F.startswith(F.get(F.split(date, "-"), F.lit(2)), F.lit("19")), F.lit(False)), "Unknown").otherwise(date)


# --- Answers and questions ----------------------------------------------------------------------


def says_nothing(answer: Column) -> Column:
    low = F.lower(answer)
    out = F.lit(False)
    for phrase in NO_INFORMATION:
        out = out | F.contains(low, F.lit(phrase))
    return out


def first_without_information(answers: Column) -> Column:
    """0-based place of the first answer that says nothing; null if all say something."""
    flags = F.transform(answers, lambda a: F.coalesce(says_nothing(a), F.lit(False)))
    return F.nullif(F.array_position(flags, True), F.lit(0)) - 1


def canonical_answer(answer: Column) -> Column:
    return F.when(F.contains(F.lower(answer), F.lit("sorry")), NO_ANSWER).otherwise(answer)


def typed_answer(answer: Column, kind: Column, explanation: Column) -> Column:
    """Yes-no answers carry their explanation."""
    return F.when(kind == "Boolean", F.concat(answer, F.lit(", "), explanation)).otherwise(answer)


def valid_question(question: Column) -> Column:
    return (F.size(F.split(question, " ")) >= 3) & ~F.lower(question).isin(*EMPTY_QUESTIONS)


def mentions_claim(question: Column) -> Column:
    return F.contains(question, F.lit("claim"))


def has_error(chunks: Column, mark: str = ERROR_MARK) -> Column:
    return F.exists(chunks, lambda c: F.contains(c, F.lit(mark)))


def yes_or_no(answer: Column) -> Column:
    """Answers that look like yes or no, but for the one that says none was found."""
    low = F.lower(answer)
    return F.contains(low, F.lit("yes")) | (F.contains(low, F.lit("no ")) & ~F.contains(low, F.lit("no answer could be found")))


def placeholder(chunk: Column) -> Column:
    return F.contains(chunk, F.lit("null null"))


def with_question_mark(question: Column) -> Column:
    return F.when(F.contains(F.substring(question, -3, 3), F.lit("?")), question).otherwise(F.concat(question, F.lit("?")))


def _parsed(text: Column, least: int, most: int | None = None) -> Column:
    pieces = F.filter(F.transform(F.split(text, r"\?"), lambda p: F.trim(p)), lambda p: F.length(p) > least if most is None else (F.length(p) > least) & (F.length(p) <= most))
    return F.array_distinct(F.transform(pieces, lambda p: F.concat(p, F.lit("?"))))


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark, or the whole text."""
    return F.when(F.contains(text, F.lit(mark)), F.substring(text, F.instr(text, mark) + len(mark), 1 << 30)).otherwise(text)


def parse_generated(text: Column) -> Column:
    """Questions after ``Questions: ``: longer than a character, without repeats in order of first
    occurrence, and valid."""
    return F.filter(_parsed(_after(text, "Questions: "), 1), valid_question)


def parse_listed(text: Column) -> Column:
    return _parsed(_after(text, "Questions:"), 0)


def parse_first_line(text: Column) -> Column:
    return _parsed(F.split(text, "\n")[0], 0, 299)


def parse_first(text: Column) -> Column:
    return F.concat(F.replace(F.split(F.substring(text, 1, 250), r"\?")[0], F.lit("\n"), F.lit(" ")), F.lit("?"))


# --- Pages and lines ----------------------------------------------------------------------------


def html_lines(page: Column) -> Column:
    """Text lines of a page by one documented chain of patterns: script, style and page furniture go,
    block tags end lines, other tags vanish, the common character references are decoded. Blank pages
    give no lines. (The training-data operators have a learnt extractor.)"""
    x = page
    for name in ("script", "style", "nav", "footer", "head"):
        x = F.regexp_replace(x, rf"(?is)<{name}[^a-zA-Z].*?</{name}>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|body|html)[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for ref, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(ref), F.lit(c))
    x = F.regexp_replace(x, r"[ \t\r]+", " ")
    return F.coalesce(F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), lambda s: s != ""), F.array().cast("array<string>"))


def packs(parts: list[str], longer: int, tail: int) -> list[str]:
    """Consecutive parts joined by spaces: each pack ends at the first part with which it passes
    ``longer``, found in the running sums of the lengths; a rest has to pass ``tail``."""
    until = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))  # with a space behind each
    out, start, before = [], 0, 0
    while start < len(parts):
        end = int(np.searchsorted(until, before + longer + 2)) + 1
        if end <= len(parts) or until[-1] - before - 1 > tail:
            out.append(" ".join(parts[start:end]))
        if end > len(parts):
            break
        start, before = end, int(until[end - 1])
    return out


@F.pandas_udf(ArrayType(StringType()))
def _packed(lines: pd.Series, parts: pd.Series, longer: pd.Series, tail: pd.Series) -> pd.Series:
    """Of arrays of lines and of their parts: the packs of all lines; lines without parts are whole."""

    def one(lines: np.ndarray | None, parts: np.ndarray, longer: int, tail: int) -> list[str] | None:
        if lines is None:
            return None
        return [x for line, some in zip(lines, parts) for x in ([line] if some is None else packs(some, longer, tail))]

    return pd.Series([one(*row) for row in zip(lines, parts, longer, tail)], dtype=object)


def pack_sentences(line: Column, longer: int = 100, first: int | None = None, tail: int = 50, boundaries=None, on: Column | None = None) -> Column:
    """A line of up to ``longer`` characters as it is; a longer one as its sentences joined by spaces
    until they pass ``longer``, a rest only if it passes ``tail``. With ``first``, the characters of a line
    beyond so many are dropped."""
    text = line if first is None else F.substring(line, 1, first)
    parts = F.when(F.length(line) > longer, sentences(text, boundaries, on))
    return _packed(F.when(line.isNotNull(), F.array(line)), F.array(parts), F.lit(longer), F.lit(tail))


def correct_lines(lines: Column, least: int = 50, longer: int = 100, tail: int | None = None, boundaries=None) -> Column:
    """Short lines dropped, long ones packed."""
    kept = F.filter(lines, lambda x: F.length(x) >= least)
    parts = F.transform(kept, lambda x: F.when(F.length(x) > longer, sentences(x, boundaries)))
    return _packed(kept, parts, F.lit(longer), F.lit(least if tail is None else tail))


def budget_chunks(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Chunk number of each size by the rule of ``chunk_by_budget``. The size before which a chunk closes
    is found in the running sums by a binary search, so the work is that of one pass and a search for
    each chunk."""
    n = len(sizes)
    sums = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    total, starts, at = int(sums[-1]), [0], 0
    while total - sums[at] > limit:
        # The first size that brings the sum to the limit, and the first with something before it.
        full = int(np.searchsorted(sums, sums[at] + limit)) - 1
        at = max(full, int(np.searchsorted(sums, sums[at], side="right")))
        if at >= n:
            break
        starts.append(at)
    return np.repeat(np.arange(len(starts), dtype=np.int32), np.diff([*starts, n]))


@F.pandas_udf(ArrayType(IntegerType()))
def _chunks(sizes: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else budget_chunks(np.asarray(x, dtype=np.int64), int(n)) for x, n in zip(sizes, limit)], dtype=object)


def chunk_by_budget(sizes: Column, budget: Column | int) -> Column:
    """Chunk number of each consecutive size: a chunk closes before the size that brings its sum to the
    budget; when all that is left fits the budget, it stays together; a chunk has one size at least.
    Sizes are not negative; linear time."""
    return _chunks(sizes, budget if isinstance(budget, Column) else F.lit(budget))


def question_budget(query: Column, window: int = 512) -> Column:
    """Tokens left for a chunk beside its query and three separators."""
    return F.lit(window) - F.size(tokens(query)) - 3


def cut_premise(premise: Column, hypothesis: Column, window: int = 1024) -> Column:
    """Premise tokens cut so that both fit the window, ten kept free."""
    return F.slice(F.slice(premise, F.lit(1), F.greatest(F.lit(0), F.lit(window) - F.size(hypothesis) - 10)), 1, window)


# --- Queries, prompts, contexts -----------------------------------------------------------------


def query_text(claim: Column, question: Column, speaker: Column | None = None) -> Column:
    plain = F.concat(claim, F.lit("  "), question)
    return plain if speaker is None else F.when(speaker.isNotNull(), F.concat(speaker, F.lit(STATED), plain)).otherwise(plain)


def dense_query(claim: Column, questions: Column) -> Column:
    """The claim and its questions without anything between them."""
    return F.concat(claim, F.array_join(questions, ""))


def instruct(task: str, query: Column) -> Column:
    return F.concat(F.lit(INSTRUCT[0] + task + INSTRUCT[1]), query)


def search_string(text: Column, author: Column | None = None) -> Column:
    """Author words and the words of the text that are not stop words (the deterministic stand-in for a
    choice by part of speech)."""
    kept = F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~F.lower(w).isin(*STOP_WORDS))
    return F.array_join(kept if author is None else F.concat(F.coalesce(F.split(author, r"\s+"), F.array().cast("array<string>")), kept), " ")


def triple(parts: Column, separator: str = " [SEP] ") -> Column:
    return F.array_join(F.transform(parts, lambda p: F.trim(p)), separator)


def claim_question_answer(claim: Column, question: Column, answer: Column, explanation: Column) -> Column:
    why = F.when(F.length(explanation) > 0, F.concat(F.lit(CLAIM_QUESTION[2]), F.trim(F.lower(explanation)))).otherwise("")
    return F.concat(F.lit(CLAIM_QUESTION[0]), F.trim(claim), F.lit(CLAIM_QUESTION[1]), F.trim(question), F.lit(" "), F.trim(answer), why)


def few_shot(claim: Column, speaker: Column, questions: Column) -> Column:
    """A claim with its questions as one example of a prompt."""
    return F.concat(F.lit(FEW_SHOT[0]), speaker_or_they(speaker), F.lit(FEW_SHOT[1]), F.trim(claim), F.lit(FEW_SHOT[2]), F.array_join(F.transform(questions, lambda q: F.trim(q)), " "))


def evidence_question(answer: Column, question: Column) -> Column:
    """An answer as evidence with the question it answers: ended by a full stop, on one line."""
    flat = F.trim(F.regexp_replace(answer, r"\s*\n\s*", " "))
    ended = F.when(F.substring(flat, -1, 1).isin(".", "!", "?"), flat).otherwise(F.concat(flat, F.lit(".")))
    return F.concat(F.lit("Evidence: "), ended, F.lit(" Question answered: "), F.trim(question))


def question_prompt(date: Column, claimer: Column, claim: Column) -> Column:
    return F.concat(F.lit(QUESTION_PROMPT), date, F.lit("\nClaimer: "), claimer, F.lit("\nClaim: "), claim, F.lit("\nQuestions: "))


def question_target(questions: Column) -> Column:
    return F.array_join(F.transform(questions, lambda q: with_question_mark(F.replace(q, F.lit("\n"), F.lit(" ")))), " ")


def reversed_context(chunks: Column, k: int) -> Column:
    """The first ``k`` chunks with the most relevant last, parted by blank lines."""
    return F.array_join(F.reverse(F.slice(chunks, 1, k)), "\n\n")


def numbered_pairs(pairs: Column) -> Column:
    """Question and answer lines, numbered from one; blank lines in answers are squeezed."""
    lines = F.transform(pairs, lambda p, i: F.concat(F.lit("Question "), (i + 1).cast("string"), F.lit(": "), p["question"], F.lit("\nAnswer "), (i + 1).cast("string"), F.lit(": "), F.replace(p["answer"], F.lit("\n\n"), F.lit("\n")), F.lit("\n")))
    return F.array_join(lines, "")


def numbered_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")


def verification_prompt(claim: Column, pairs: Column) -> Column:
    return F.concat(F.lit(VERIFY_PROMPT + "Claim: "), claim, F.lit("\n"), numbered_pairs(pairs))


def verification_target(justification: Column, label: Column) -> Column:
    return F.concat(F.lit("Justification: "), justification, F.lit("\nLabel: "), label, F.lit(" <|end_of_text|>"))


def categories(names: list[tuple[str, str]], prefix: str = "O", described: bool = False) -> str:
    """Numbered categories of a safety prompt."""
    return "\n".join(f"{prefix}{i}: {name}" + (f"\n{about}" if described else "") for i, (name, about) in enumerate(names, 1))


def turn_role(turn: Column) -> Column:
    return F.when(turn % 2 == 0, "User").otherwise("Agent")


def code_to_index(code: Column, prefix: str = "O") -> Column:
    return F.regexp_replace(code, f"^{prefix}", "").cast("int") - 1


def index_to_code(index: Column, prefix: str = "O") -> Column:
    return F.concat(F.lit(prefix), (index + 1).cast("string"))


def is_safe(report: Column) -> Column:
    return F.split(F.trim(report), "\n")[0] == "safe"


def repair_mojibake(text: Column) -> Column:
    """Text that was decoded as Latin-1 twice, put right; null where it cannot be. The code page work has
    no SQL expression, so this is an Arrow function."""

    @F.pandas_udf("string")
    def fix(s):  # noqa: ANN001, ANN202
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else x.encode("latin-1").decode("unicode_escape").encode("latin-1").decode("utf-8")
            except (UnicodeDecodeError, UnicodeEncodeError):
                return None

        return s.map(one, na_action="ignore")

    return fix(text)


# The instructions of the statement and entailment prompts, and the entailment labels in class order.
STATEMENT_TASK = "Your task is to convert question answer pairs into statements. In the following there are some example showing how to convert question answer pairs into statements.\n\n"
ENTAILMENT_LABELS = ("Refutes", "Not Enough Information", "Supports")


def statement_prompt(question: Column, answer: Column, examples: list[tuple[str, str, str]]) -> Column:
    """The few-shot prompt that turns a question and its answer into a statement; ``examples`` are
    (question, answer, statement)."""
    shots = "".join(f"Question: {q}\nAnswer: {a}\nStatement: {s}\n\n" for q, a, s in examples)
    return F.concat(F.lit(STATEMENT_TASK + shots + "Question: "), question, F.lit("\nAnswer: "), answer, F.lit("\nStatement:"))


def entailment_prompt(contexts: Column, statement: Column, task: str, examples: list[tuple[str, str, str]]) -> Column:
    """The few-shot prompt that asks whether contexts, the most relevant last, entail a statement;
    ``examples`` are (context, statement, label)."""
    shots = "".join(f"Context:\n{c}\n\nStatement:\n{s}\n\nEntailment:\n{e} ###\n\n" for c, s, e in examples)
    return F.concat(F.lit(task + shots + "Context:\n"), F.array_join(F.reverse(contexts), "\n\n"), F.lit("\n\nStatement:\n"), statement, F.lit("\n\nEntailment:\n"))


def entailment_class(answer: Column) -> Column:
    """0 refutes, 1 not enough information, 2 supports, by the label that the answer begins with; else null."""
    said = F.trim(answer)
    out = F.lit(None).cast("int")
    for k, label in enumerate(ENTAILMENT_LABELS):
        out = F.when(F.startswith(said, F.lit(label)), F.lit(k)).otherwise(out)
    return out
