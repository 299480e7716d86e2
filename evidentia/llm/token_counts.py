"""Token counts by prefix dynamic programming over a byte-pair vocabulary with word ends.

For a byte-pair encoding, the encoding of a prefix is the encoding of a shorter prefix plus one
token: the only one that may follow the shorter prefix's last token. So one table per word holds,
for each prefix, its last token and its exact token count, and answers counts, truncation and
budgets at any place without encoding again.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import over_batches, table

WORD_END = "</w>"
#: Words, chunks and token pairs whose answers a worker remembers, of each; it forgets all of a kind
#: beyond that. Longer texts than ``LONG`` letters are not remembered.
REMEMBERED, LONG = 800_000, 64

# Fixed value: the word pattern of the vocabulary file; text that it does not match makes no token.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 bytes are
    themselves, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class PrefixCounter:
    """Exact token counts at every prefix of a text, for one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("end_of_word_suffix") != WORD_END:
            raise ValueError("the vocabulary has no word ends")
        self.rank = {(a, b): i for i, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])}
        self.specials = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.word = regex.compile(WORDS)
        self.blank = regex.compile(r"\s+")
        self.letter = byte_letters()
        #: By token: rank and halves of the first merge that makes it.
        self.made: dict[str, tuple[int, str, str]] = {}
        for (a, b), i in self.rank.items():
            self.made.setdefault(a + b, (i, a, b))
        # Tokens that the merges make out of their own letters, by those letters: inside a word, at its end.
        self.inner: dict[str, str] = {}
        self.final: dict[str, str] = {}
        for token in model["vocab"]:
            last = token.endswith(WORD_END) and len(token) > len(WORD_END)
            letters = token[: -len(WORD_END)] if last else token
            if self.merge(self.symbols(letters, last)) == [token]:
                (self.final if last else self.inner)[letters] = token
        self.longest = max(map(len, [*self.inner, *self.final]))
        # All ends of tokens: reading back from a place, no token begins before what is not among them.
        self.inner_ends, self.final_ends = ({t[i:] for t in of for i in range(len(t))} for of in (self.inner, self.final))
        self.words: dict[str, int] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, int] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging of a few symbols, to judge single tokens and pairs."""
        rank = self.rank
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: rank.get((symbols[i], symbols[i + 1]), 1 << 30))
            pair = (symbols[best], symbols[best + 1])
            if pair not in rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def symbols(self, letters: str, last: bool) -> list[str]:
        out = list(letters)
        if last:
            out[-1] += WORD_END
        return out

    def follows(self, a: str, b: str) -> bool:
        """Whether the merges leave two tokens side by side as they are. Goes back through the merges
        that made them, latest first: a merge across the border that comes before the one taken back
        would have been made instead; of equal ones the left is made first."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        rank, made, x, y, limit, known = self.rank, self.made, a, b, 1 << 30, False
        while (x, y) not in rank or rank[x, y] >= limit:
            left, right = made.get(x), made.get(y)
            if left is None and right is None:
                known = True
                break
            if right is None or (left is not None and left[0] > right[0]):
                limit, x = left[0], left[2]
            else:
                limit, y = right[0] + 1, right[1]
        self.pairs[a, b] = known
        return known

    def last_token(self, word: str, at: int, last: list[str], ended: bool) -> tuple[str, int]:
        """The last token of the prefix up to ``at`` and where it begins, given those of all shorter
        prefixes; with ``ended`` the word ends there."""
        tokens, ends = (self.final, self.final_ends) if ended else (self.inner, self.inner_ends)
        found, start = [], at - 1
        while start >= 0 and (part := word[start:at]) in ends:
            token = tokens.get(part)
            if token is not None:
                found.append((token, start))
            start -= 1
        for token, start in reversed(found):
            if not start:
                return token, 0
            known = self.pairs.get((last[start], token))
            if self.follows(last[start], token) if known is None else known:
                return token, start
        raise ValueError(f"the vocabulary lacks a letter of {word!r}")

    def tables(self, word: str, ends: bool) -> tuple[list[str], list[int]]:
        """For each prefix of a word's letters: its last token and its token count, where the word goes
        on after every prefix but, if ``ends``, the whole one."""
        n = len(word)
        last, count = [""] * (n + 1), [0] * (n + 1)
        for at in range(1, n + 1):
            last[at], start = self.last_token(word, at, last, ends and at == n)
            count[at] = count[start] + 1
        return last, count

    def word_prefixes(self, letters: str) -> list[int]:
        """Token counts of every prefix of a word as a word of its own, the empty one included: from one
        table of the prefixes that go on, each ended by the token that fits."""
        last, count = self.tables(letters, False)
        return [0, *(count[self.last_token(letters, at, last, True)[1]] + 1 for at in range(1, len(letters) + 1))]

    def word_count(self, letters: str) -> int:
        n = self.words.get(letters)
        if n is None:
            n = self.tables(letters, True)[1][-1]
            if len(letters) <= LONG:
                if len(self.words) > REMEMBERED:
                    self.words.clear()
                self.words[letters] = n
        return n

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def letters(self, word: str) -> str:
        return word if word.isascii() and word.isalpha() else "".join(map(self.letter.__getitem__, word.encode("utf-8")))

    def chunk_count(self, chunk: str) -> int:
        """Of text without white space, remembered."""
        n = self.chunks.get(chunk)
        if n is None:
            n = sum(self.word_count(self.letters(w)) for w in self.word.findall(self.normal(chunk)))
            if len(chunk) <= LONG:
                if len(self.chunks) > REMEMBERED:
                    self.chunks.clear()
                self.chunks[chunk] = n
        return n

    def plain_count(self, text: str) -> int:
        known, total = self.chunks, 0
        for chunk in text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else self.blank.split(text):
            if chunk:
                n = known.get(chunk)
                total += self.chunk_count(chunk) if n is None else n
        return total

    def count(self, text: str) -> int:
        """Tokens of the whole text. Special strings are tokens of their own."""
        if self.special is None or "<|" not in text:
            return self.plain_count(text)
        found = self.special.findall(text)
        return len(found) + sum(map(self.plain_count, self.special.split(text)))

    def plain_prefixes(self, chunk: str) -> list[int]:
        """The count of every prefix of a text without white space, special strings taken as any other,
        from one table for each of its words. Where normalisation composes letters, a cut may change
        what comes before it: such texts are counted prefix by prefix."""
        if not unicodedata.is_normalized("NFC", chunk):
            return [0, *(self.plain_count(chunk[:i]) for i in range(1, len(chunk) + 1))]
        lower = [c.lower() for c in chunk]
        out, base = [0], 0
        for m in self.word.finditer("".join(lower)):
            w = m.group()
            out += [base] * (m.start() + 1 - len(out))
            if w[0] == "'" and w[-1] != "'" and len(w) > 1 and w[1].isalpha():  # cut, it would be two words
                out += [*(base + self.plain_count(w[:i]) for i in range(1, len(w))), base + self.word_count(self.letters(w))]
            else:
                table = self.word_prefixes(self.letters(w))
                ends = range(1, len(w) + 1) if len(table) == len(w) + 1 else accumulate(len(c.encode("utf-8")) for c in w)
                out += [base + table[i] for i in ends]
            base = out[-1]
        ends = list(accumulate(map(len, lower)))
        return [0, *(out[i] for i in ends)]

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """The count of every prefix of a text without white space."""
        out, base, done = [0], 0, 0
        for m in self.special.finditer(chunk) if self.special is not None and "<|" in chunk else ():
            # A special string that is cut is text like any other; whole, it is one token.
            table = self.plain_prefixes(chunk[done : m.end()])
            out += [base + n for n in table[1:-1]]
            base += table[m.start() - done] + 1
            out.append(base)
            done = m.end()
        return out + [base + n for n in self.plain_prefixes(chunk[done:])[1:]]

    def prefixes(self, text: str) -> list[int]:
        """The count of every prefix of the text in code points, the empty one first: element i is
        ``count(text[:i])``. Words that a cut changes are counted as cut."""
        out, done = [0], 0
        for m in self.blank.finditer(text + " "):
            base = out[-1]
            out += [base + n for n in self.chunk_prefixes(text[done : m.start()])[1:]]
            out += [out[-1]] * (m.end() - m.start())
            done = m.end()
        return out[: len(text) + 1]

    def cut_at(self, text: str, budget: int) -> int:
        """Code points of the longest prefix up to which no prefix has more than ``budget`` tokens."""
        done = base = 0
        for m in self.blank.finditer(text + " "):
            chunk = text[done : m.start()]
            # No prefix has more tokens than three times its bytes: normal forms are no longer than that.
            if base + 3 * len(chunk.encode("utf-8", "surrogatepass")) > budget:
                # So many code points hold more tokens than are left, or nearly always do.
                far = (budget - base + 2) * max(self.longest, *map(len, self.specials), 1)
                for part in (chunk[:far], chunk):
                    table = self.chunk_prefixes(part)
                    over = next((i for i, n in enumerate(table) if base + n > budget), None)
                    if over is not None:
                        return done + over - 1
                    if len(part) == len(chunk):
                        break
                base += table[-1]
            else:
                base += self.count(chunk)
            done = m.end()
        return len(text)


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """One row per input row: the id as ``id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``kept_chars``:
    with a budget, the length in code points of the longest prefix within it, else null.

    Null and empty texts have no bytes and no tokens; a null id stays; repeated rows each give their
    row; other columns are not read. ``vocabulary`` is a path that every executor can open. One pass
    without a shuffle; a worker remembers a bounded number of words.
    """

    def one(batch: pa.RecordBatch) -> dict[str, list]:
        of = counter(vocabulary)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        return {
            "id": batch.column(0).to_pylist(),
            "n_bytes": [len(t.encode("utf-8")) for t in texts],
            "n_tokens": [of.count(t) for t in texts],
            "kept_chars": [None if budget is None else of.cut_at(t, budget) for t in texts],
        }

    kind = df.schema[id_col].dataType.simpleString()
    return over_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), one, f"id {kind}, n_bytes bigint, n_tokens bigint, kept_chars bigint")


def prefix_tables(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id as ``id`` and ``counts``, the token count of every prefix of the text
    in code points, the empty one first. It answers any budget: ``truncation`` does so by a search.
    Null counts as empty; a text's table has four bytes for each of its code points."""

    def one(batch: pa.RecordBatch) -> dict[str, list]:
        of = counter(vocabulary)
        return {"id": batch.column(0).to_pylist(), "counts": [of.prefixes(t or "") for t in batch.column(1).to_pylist()]}

    kind = df.schema[id_col].dataType.simpleString()
    return over_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), one, f"id {kind}, counts array<int>")


def truncation(counts: Column, budget: int) -> Column:
    """From a column of ``prefix_tables``: code points of the longest prefix up to which no prefix has
    more than ``budget`` tokens."""
    over = F.array_position(F.transform(counts, lambda n: n > budget), True)
    return F.when(over > 0, over - 2).otherwise(F.size(counts) - 1).cast("bigint")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token_counts`` of every document: doc_id, n_bytes, n_tokens, over_limit (more than 2048 tokens)."""
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES = {"op3_token_counts": op3_token_counts}
