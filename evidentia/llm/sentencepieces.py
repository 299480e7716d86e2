"""SentencePiece byte-pair encoding and decoding in vectorised merge rounds.

Text falls into segments (a run of spaces with what follows it) across which no piece of the
vocabulary reaches. The distinct segments of a batch lie in one flat array of symbols. Each round
finds the best pair of every segment with a segmented minimum, merges all its occurrences from the
left at once and compacts the array, until no pair is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import over_batches, sha256_hex, table

SPACE = "▁"
#: Fixed value: how the unknown piece decodes.
UNKNOWN = " ⁇ "
#: Characters of segments and their ids that a worker remembers, about; it forgets all beyond that.
REMEMBERED = 4 << 20

_NEVER = np.int64(1 << 40)


class PieceModel:
    """The vocabulary of a model file, read through the library's accessors, and its merge table."""

    def __init__(self, path: str):
        import sentencepiece

        of = sentencepiece.SentencePieceProcessor(model_file=path)
        n = of.get_piece_size()
        pieces = [of.id_to_piece(i) for i in range(n)]
        special = [of.is_control(i) or of.is_unknown(i) or of.is_unused(i) for i in range(n)]
        self.end, self.n = of.eos_id(), n
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if of.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.id = {p: i for i, p in enumerate(pieces) if not special[i] and not of.is_byte(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.id) or any("\n" in p for p in self.id):
            raise ValueError("pieces reach across segments")
        #: Bytes of each piece in decoded text; control pieces have none, the unknown one has a mark.
        self.raw = [UNKNOWN.encode() if of.is_unknown(i) else b"" if special[i] else bytes([int(p[3:5], 16)]) if of.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.unknown = [of.is_unknown(i) for i in range(n)]
        self.raw_byte = [of.is_byte(i) for i in range(n)]
        # Pieces by score, best first; the place in that order is the rank of a merge into the piece.
        order = sorted(self.id.values(), key=lambda i: (-of.get_score(i), i))
        place = {i: r for r, i in enumerate(order)}
        keys, ranks = [], []
        for piece, i in self.id.items():
            for k in range(1, len(piece)):
                a, b = self.id.get(piece[:k]), self.id.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(place[i])
        by_key = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[by_key]
        self.ranks = np.array(ranks, dtype=np.int64)[by_key]
        self.at_rank = np.array(order, dtype=np.int64)
        #: Each piece's id as text after a space.
        self.written = [f" {i}" for i in range(n)]
        self.forget()

    def forget(self) -> None:
        """Empties what is remembered: for each segment its number, and by number where its ids lie in ``flat``."""
        self.number: dict[str, int] = {}
        self.flat, self.edges, self.size = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a >= 0) & (b >= 0), a * self.n + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def merge_rounds(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all segments in order, index of each one's first symbol, the total at the end).
        A symbol is a piece id, or minus one minus the code point of a character without a piece."""
        known = self.id
        text = "".join(segments)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        distinct, where = np.unique(points, return_inverse=True)
        first = np.array([known.get(SPACE if c == 32 else chr(c), -1 - int(c)) for c in distinct], dtype=np.int64)
        symbols = first[where] if len(points) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        rank = np.full(len(symbols), _NEVER)
        if len(symbols) > 1:
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.pair_ranks(symbols[:-1], symbols[1:]), _NEVER)
        # Segments that are done leave the working arrays; what they became is put together at the end.
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.concatenate((starts, [len(symbols)])))
            least = np.repeat(best, sizes)
            over = least == _NEVER
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                live = ~over
                symbols, owner, rank, least = symbols[live], owner[live], rank[live], least[live]
                if not len(symbols):
                    break
            hit = rank == least
            # In a run of overlapping hits every second one merges, from the left.
            at = np.flatnonzero(hit)
            fresh = np.concatenate(([True], np.diff(at) != 1))
            since = at - np.repeat(at[fresh], np.diff(np.concatenate((np.flatnonzero(fresh), [len(at)]))))
            at = at[since % 2 == 0]
            symbols[at] = self.at_rank[rank[at]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            # Ranks change where a neighbour did.
            moved = np.zeros(len(symbols), dtype=bool)
            moved[at] = True
            symbols, owner, rank, moved = symbols[stay], owner[stay], rank[stay], moved[stay]
            stale = moved.copy()
            stale[:-1] |= moved[1:]
            look = np.flatnonzero(stale)
            nxt = np.minimum(look + 1, len(symbols) - 1)
            rank[look] = np.where((look + 1 < len(symbols)) & (owner[look] == owner[nxt]), self.pair_ranks(symbols[look], symbols[nxt]), _NEVER)
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(segments) + 1, np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(segments)))))

    def learn(self, segments: list[str]) -> None:
        """Encodes segments and remembers their ids, bytes of characters without a piece included."""
        flat, sizes = [self.flat], [np.diff(self.edges)]
        for some in _some(segments):
            symbols, bounds = self.merge_rounds([" " + s if s[:1] != "\n" else s for s in some])
            bare = symbols < 0
            if bare.any():
                points, which = np.unique(symbols[bare], return_inverse=True)
                coded = [[self.byte_id[b] for b in chr(-1 - int(x)).encode("utf-8", "surrogatepass")] for x in points]
                times = np.ones(len(symbols), np.int64)
                times[bare] = np.array([len(c) for c in coded])[which]
                begin = np.cumsum(times) - times
                out = np.repeat(symbols, times)
                for k in range(4):
                    has = times[bare] > k
                    out[begin[bare][has] + k] = np.array([c[k] if k < len(c) else 0 for c in coded])[which][has]
                symbols, bounds = out, np.append(begin, len(out))[bounds]
            flat.append(symbols.astype(np.int32))
            sizes.append(np.diff(bounds))
        first = len(self.number)
        self.number.update(zip(segments, range(first, first + len(segments))))
        self.flat, self.edges = np.concatenate(flat), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        self.size += sum(map(len, segments)) + len(self.flat) - len(flat[0])

    def ids_of(self, parted: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts given as segments, one text after the other; each text's first id, the total at the end)."""
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parted)), np.int64)
        begin, sizes = self.edges[number], np.diff(self.edges)[number]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.concatenate(([0], np.cumsum([len(t) for t in parted])))]


def _some(segments: list[str], limit: int = 1 << 19) -> Iterable[list[str]]:
    """Lists of segments with about ``limit`` characters each."""
    out, size = [], 0
    for s in segments:
        if size and size + len(s) > limit:
            yield out
            out, size = [], 0
        out.append(s)
        size += len(s) + 1
    if out:
        yield out


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


_SEGMENT = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")


def segments_of(text: str) -> list[str]:
    """The text with the space that the model puts before it, as segments. A segment that begins with
    no line break has one more space before it than is written here. No piece holds a line break."""
    if not text:
        return []
    out = text.replace(SPACE, " ").replace("\n", " \n").split(" ")
    if "" in out:  # several spaces in a row, or some at a line's end
        return [s[1:] if s[0] == " " else s for s in _SEGMENT.findall(" " + text.replace(SPACE, " "))]
    return out


def encode_texts(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, one after the other; each text's first id, the total at the end)."""
    of = model(path)
    if of.size > REMEMBERED:
        of.forget()
    parted = [segments_of(t) for t in texts]
    of.learn(sorted(set().union(*parted).difference(of.number)))
    return of.ids_of(parted)


def _with_end(ids: np.ndarray, edges: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, edges[1:], end), edges + np.arange(len(edges))


def decode_ids(path: str, ids: list[int]) -> str:
    """The text of piece ids: control pieces vanish, byte pieces are read as UTF-8 with one mark for
    each byte that is not, and the space that encoding put first goes."""
    of = model(path)
    out, run, first = [], bytearray(), True

    def flush() -> None:
        if run:
            out.append(_utf8(bytes(run)))
            run.clear()

    for i in ids:
        if of.raw_byte[i]:
            run += of.raw[i]
        else:
            flush()
            if not of.raw[i]:
                continue
            text = of.raw[i].decode()
            out.append(text[1:] if first and text.startswith(" ") and not of.unknown[i] else text)
        first = False
    flush()
    return "".join(out)


def _utf8(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """One row per input row: the id as ``id`` and ``ids``, the array of piece ids, with the model's end
    id if ``end``. Null and empty texts have only the end id; a null id stays; other columns are not
    read. One pass without a shuffle."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, edges = encode_texts(model_path, [t or "" for t in batch.column(1).to_pylist()])
        if end:
            ids, edges = _with_end(ids, edges, model(model_path).end)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return over_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), one, f"id {kind}, ids array<int>")


def encode_and_check(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with ``n_tokens`` (end id included) and ``exact``: whether the ids decode to the text
    itself, as they do unless it holds the sign that stands for a space. Null counts as empty."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, texts = model(model_path), [t or "" for t in batch.column(1).to_pylist()]
        ids, edges = encode_texts(model_path, texts)
        exact = [b"".join(map(of.raw.__getitem__, ids[lo:hi].tolist()))[1:] == t.encode("utf-8", "surrogatepass") for t, lo, hi in zip(texts, edges, edges[1:])]
        ids, edges = _with_end(ids, edges, of.end)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(edges)), pa.array(exact)], names=["id", "ids", "n_tokens", "exact"])

    kind = df.schema[id_col].dataType.simpleString()
    return over_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), one, f"id {kind}, ids array<int>, n_tokens bigint, exact boolean")


def decode(df: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id as ``id`` and the ``text`` of the ids; null ids give null."""

    def one(batch: pa.RecordBatch) -> dict[str, list]:
        return {"id": batch.column(0).to_pylist(), "text": [None if x is None else decode_ids(model_path, x) for x in batch.column(1).to_pylist()]}

    kind = df.schema[id_col].dataType.simpleString()
    return over_batches(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), one, f"id {kind}, text string")


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id as ``id``, ``n_tokens`` (with the end id), ``ids_sha256`` and
    ``decoded_sha256``, the digests of the decimal ids joined by one space and of the decoded text.

    Encoded texts decode to their ids' bytes but for the first space: the bytes of a character that has
    no piece are all there, in order. Null counts as empty.
    """

    def one(batch: pa.RecordBatch) -> dict[str, list]:
        of = model(model_path)
        ids, edges = _with_end(*encode_texts(model_path, [t or "" for t in batch.column(1).to_pylist()]), of.end)
        each = [ids[lo:hi].tolist() for lo, hi in zip(edges, edges[1:])]
        return {
            "id": batch.column(0).to_pylist(),
            "n_tokens": np.diff(edges),
            "ids_sha256": [sha256_hex("".join(map(of.written.__getitem__, x))[1:].encode()) for x in each],
            "decoded_sha256": [sha256_hex(b"".join(map(of.raw.__getitem__, x))[1:]) for x in each],
        }

    kind = df.schema[id_col].dataType.simpleString()
    return over_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), one, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``round_trip`` of every document: doc_id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts
    have the end id alone and decode to nothing; null and repeated ids give their rows; very long texts
    are encoded whole, a segment at a time; an empty table gives no rows; other columns are not read."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
