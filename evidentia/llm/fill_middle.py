"""Fill-in-middle: a text's prefix, middle and suffix in an order that trains a model to fill gaps.

A text is held as the runs of its character classes, each with the number of units up to its end. The
run that holds a cut is found by a binary search over these sums, and the cut's place in it by
arithmetic; no unit is ever listed.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import SPACE, as_bytes, over_batches, table

#: What stands before prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")

#: Class of each byte: a character's first byte that is not white space, white space, a later byte of a character.
_CLASS = np.where(SPACE, 1, np.where(np.arange(256) & 0xC0 == 0x80, 2, 0)).astype(np.uint8)


class Runs:
    """Maximal runs of one class in a text in UTF-8, with the units up to the end of each.

    ``words``: a unit is a run that is not white space with the white space before it; white space at
    the end is one more. ``chars``: a unit is a code point; classes are first and later bytes.
    """

    def __init__(self, data: bytes, units: str = "words"):
        if units not in ("words", "chars"):
            raise ValueError(f"units are words or chars, not {units!r}")
        self.chars = units == "chars"
        kinds = _CLASS[np.frombuffer(data, dtype=np.uint8)] == (2 if self.chars else 1)
        self.size = len(data)
        self.ends = np.append(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, self.size) if self.size else np.zeros(0, np.int64)
        self.starts = np.append(0, self.ends[:-1]) if self.size else self.ends
        length = self.ends - self.starts
        if not self.size:
            self.units = length
        elif self.chars:
            self.units = np.where(kinds[self.starts], 0, length)
        else:
            self.units = 1 - kinds[self.starts].astype(np.int64)
            self.units[-1] = 1
        self.until = np.cumsum(self.units)
        self.total = int(self.until[-1]) if self.size else 0

    def end_of(self, n: int) -> int:
        """The byte at which the first ``n`` units end."""
        if n <= 0:
            return 0
        if n >= self.total:
            return self.size
        run = int(np.searchsorted(self.until, n))
        start, end, units = int(self.starts[run]), int(self.ends[run]), int(self.units[run])
        at = start + (n - int(self.until[run]) + units) * (end - start) // units
        # The last character of a run of first bytes goes on in the run of later bytes behind it.
        return int(self.ends[run + 1]) if self.chars and at == end and run + 1 < len(self.ends) else at


def code_points(data: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80))


def choices(seed: int, id: object) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the seed and the row's id (a null id counts as an empty string)."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).digest()[:16])


def rearrange(data: bytes, runs: Runs, h: tuple[int, int, int, int], rate: int, spm: int) -> tuple[str, int | None, int | None, bytes]:
    """(form, code points of prefix and of middle, output) of one text."""
    if not data or h[2] % 100 >= rate or any(m in data for m in MARKS):
        return "plain", None, None, data
    n = runs.total + 1
    a, b = map(runs.end_of, sorted((h[0] % n, h[1] % n)))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = MARKS
    form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h[3] % 100 < spm else ("psm", (p, prefix, s, suffix, m, middle))
    return form, code_points(prefix), code_points(middle), b"".join(parts)


def fill_in_middle(df: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, units: str = "words", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id as ``id``, ``n`` (units of the text), ``form`` (plain, psm or spm),
    ``prefix_chars`` and ``middle_chars`` (code points; null if plain) and ``output``.

    ``rate`` in a hundred texts are rearranged, ``spm`` in a hundred of these with the suffix first.
    Texts that are empty or hold a mark stay plain; null counts as empty. Cuts fall between units, so
    words stay whole. All depends on seed and id alone: repeated rows give equal rows, and a row made
    again is the same. A null id stays and counts as an empty string; other columns are not read. One
    pass without a shuffle; memory is bounded by the longest text.
    """

    def one(batch: pa.RecordBatch) -> dict[str, list]:
        ids, out = batch.column(0).to_pylist(), []
        for i, data in zip(ids, as_bytes(batch.column(1))):
            runs = Runs(data, units)
            out.append((runs.total, *rearrange(data, runs, choices(seed, i), rate, spm)))
        n, form, prefix, middle, output = zip(*out)
        return {"id": ids, "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": [x.decode("utf-8", "surrogatepass") for x in output]}

    kind = df.schema[id_col].dataType.simpleString()
    return over_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), one, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of, from it and its form alone."""
    p, s, m = (x.decode() for x in MARKS)
    after = lambda mark: F.substr(output, F.locate(mark, output) + len(mark))
    until = lambda mark, of: F.substring_index(of, mark, 1)
    psm = F.concat(until(s, after(p)), after(m), until(m, after(s)))
    spm = F.concat(until(m, after(p)), after(m), until(p, after(s)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fill_in_middle`` of every document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}

#: White space is a class of its own in the words' pattern; the tokens' list is cut where the operator cuts.
_TOKENS = r"regexp_extract_all(txt, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"
_PART = "array_to_string(tokens[{0}:{1}], '')"
ORACLE = {
    "op13_fill_in_middle": f"""
with d as (select doc_id, coalesce(text, '') as txt, sha256('42:' || doc_id) as hex from documents),
h as (select doc_id, txt, {_TOKENS} as tokens, {", ".join(f"('0x' || substr(hex, {8 * i + 1}, 8))::bigint as h{i + 1}" for i in range(4))} from d),
f as (select *, len(tokens) as n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as b,
  case when txt = '' or contains(txt, '<P>') or contains(txt, '<S>') or contains(txt, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from h),
p as (select *, {_PART.format("1", "a")} as prefix, {_PART.format("a + 1", "b")} as middle, {_PART.format("b + 1", "n")} as suffix from f)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else txt end) as output_sha256,
  sha256(txt) as restored_sha256 from p
"""
}
