"""Secret scans: a keyword automaton finds where a secret could start, an anchored pattern is tried
only there, and kinds that carry a checksum count only if it holds."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import as_bytes, over_batches, table

#: Kinds in the order that breaks ties between spans of one start; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
BASE = 3

# Keywords (lower case) and the kind that each can begin.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "xprv": "xprv",
}

PATTERNS = {
    "assign": re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "xprv": re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"),
}
LEAST = {"assign": 12, "access": 18, "hex": 16}

_HEX_RUN = b"\x01" * LEAST["hex"]
_HEX_MAP = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _crc_holds(body: bytes, tail: bytes) -> bool:
    """Six base-62 digits of the CRC-32 of the body."""
    value, digits = zlib.crc32(body), ""
    while value:
        value, rest = divmod(value, 62)
        digits = _B62[rest] + digits
    return digits.rjust(6, "0").encode() == tail


def _base58_holds(word: bytes) -> bool:
    """Base58Check: the last 4 of 82 bytes are the start of the doubled SHA-256 of the others."""
    value = 0
    for c in word.decode():
        value = value * 58 + _B58.index(c)
    if value >> (82 * 8):
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _accepted(kind: str, m: re.Match[bytes]) -> bool:
    if kind == "assign":
        return len(m.group(1)) >= LEAST[kind]
    if kind in LEAST:
        return m.end() - m.start() >= LEAST[kind]
    return _base58_holds(m.group()) if kind == "xprv" else _crc_holds(m.group(1), m.group(2))


def find_spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of UTF-8, by start, then kind. Per kind matches are leftmost and do
    not overlap; a match that fails its length or checksum still uses up its text."""
    hits = sorted((end - n + 1, kind) for end, (n, kind) in _automaton().iter(data.lower().decode("latin-1")))
    out, past = [], dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start >= past[kind] and (m := PATTERNS[kind].match(data, start)):
            past[kind] = m.end()
            if _accepted(kind, m):
                out.append((start, m.end(), kind))
    classes, at = data.translate(_HEX_MAP), 0
    while (at := classes.find(_HEX_RUN, at)) >= 0:
        m = PATTERNS["hex"].match(data, at)
        out.append((at, m.end(), "hex"))
        at = m.end()
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def in_code_points(data: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if data.isascii():
        return spans
    marks, at, points = {}, 0, 0
    for p in sorted({x for s in spans for x in s[:2]}):
        points += len(data[at:p].decode("utf-8", "surrogatepass"))
        marks[p], at = points, p
    return [(marks[a], marks[b], k) for a, b, k in spans]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id as ``id`` and ``spans``, an array of (kind, start, end) in code
    points, end exclusive, by start and then kind.

    Null and empty texts give an empty array; a null id stays null; repeated rows each give their
    row; other columns are not read. One pass without a shuffle, memory bounded by a few MB of text.
    """

    def one(batch: pa.RecordBatch) -> dict[str, list]:
        rows = []
        for data in as_bytes(batch.column(1)):
            spans = find_spans(data)
            rows.append([{"kind": k, "start": a, "end": b} for a, b, k in (in_code_points(data, spans) if spans else spans)])
        return {"id": batch.column(0).to_pylist(), "spans": rows}

    kind = df.schema[id_col].dataType.simpleString()
    return over_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), one, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by ``mark``; overlapping spans become one mark.
    Null stays null, all columns and rows stay."""

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            data = text.encode("utf-8", "surrogatepass")
            spans = find_spans(data)
            if not spans:
                return text
            parts, at = [], 0
            for a, b in merged((a, b) for a, b, _ in spans):
                parts += [data[at:a], mark.encode()]
                at = b
            return b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass")

        return texts.map(one, na_action="ignore")

    return df.withColumn(text_col, clean(F.col(text_col)))


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the digest of the base spans and all spans of every document."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(*KINDS[:BASE]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("bigint").alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op1_secret_scan": op1_secret_scan}
