"""Rounds of questions as state: answers may come late, in any order, and move their claim on.

A claim's state is the round it is in, the evidence of rounds before it, and the answers that are held
for this round and later ones. When all answers of its round are there, the claim is done or goes on to
the next; what earlier rounds gave is kept, not read again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.functions import text as T
from evidentia.operators.evidence import lookup

EVIDENCE = "claim_id bigint, round int, q_idx int, question string, answer string, url string"
STATE = "round int, done boolean, held string"
#: The columns of ``prepared`` answers that a claim takes.
ANSWER = ("round", "q_idx", "question", "answer", "url", "answered", "nothing", "expected")


def is_complete(total: int, answered: int, nothing: int) -> bool:
    """The rule of ``operators.metrics.completeness`` for one claim."""
    return answered > 0 and answered / total > 0.8 and nothing / max(answered, 1) < 0.3


def prepared(answers: DataFrame) -> DataFrame:
    """Answers as the state takes them: with the text and address that evidence has, and whether there is
    an answer and whether it says nothing. ``answers`` has claim_id, round (from 1), q_idx, question,
    answer, urls, chunk_idx, and ``expected``, the questions of the claim in that round."""
    shown = F.coalesce(T.canonical_answer(F.col("answer")), F.lit(T.NO_ANSWER))
    return answers.select(
        "claim_id", F.col("round").cast("int").alias("round"), F.col("q_idx").cast("int").alias("q_idx"), "question", shown.alias("answer"), lookup(F.col("urls"), F.col("chunk_idx")).alias("url"),
        F.col("answer").isNotNull().alias("answered"), F.coalesce(T.says_nothing(F.col("answer")), F.lit(False)).alias("nothing"), F.col("expected").cast("int").alias("expected"),
    )


class Claim:
    """A claim's rounds; pure, so that any order of answers can be tried without a stream."""

    def __init__(self, last: int, saved: dict | None = None):
        self.last = last
        saved = saved or {"round": 1, "kept": [], "first": [], "held": {}}
        self.round: int = saved["round"]
        self.kept: list[list] = saved["kept"]  # answered questions of earlier rounds
        self.first: list[list] = saved["first"]  # the first round's questions, in case nothing is answered
        self.held: dict[str, dict[str, list]] = saved["held"]

    def saved(self) -> dict:
        return {"round": self.round, "kept": self.kept, "first": self.first, "held": self.held}

    def add(self, round: int, q_idx: int, *rest) -> None:  # noqa: ANN002
        """An answer: question, answer, url, answered, nothing, expected. One that comes again changes nothing."""
        if self.round <= round <= self.last:
            self.held.setdefault(str(round), {}).setdefault(str(q_idx), list(rest))

    def finished(self) -> list[list] | None:
        """Moves on as far as answers allow; the claim's evidence (round, q_idx, question, answer, url) once
        it is done, else None."""
        while mine := self.held.get(str(self.round)):
            rows = sorted(([self.round, int(q), *x] for q, x in mine.items()), key=lambda r: r[1])
            if len(rows) < rows[0][-1]:
                return None
            del self.held[str(self.round)]
            answered = [r for r in rows if r[5]]
            if is_complete(len(rows), len(answered), sum(r[6] for r in rows)):
                return self.kept + [r[:5] for r in rows]
            self.kept += [r[:5] for r in answered]
            if self.round == 1:
                self.first = [[1, r[1], r[2], T.NO_ANSWER, ""] for r in rows]
            if self.round == self.last:
                return self.kept or self.first
            self.round += 1
        return None


def evidence_by_rounds(answers: DataFrame, last: int) -> DataFrame:
    """The evidence of every claim of a stream of ``prepared`` answers, once it is done: answered questions
    of the rounds that did not complete it and all of the one that did; for a claim that none of the
    ``last`` rounds completed, the answered questions of all, or else the fixed text for the first
    round's. The same rows whatever the batches and the order within.

    State is kept by claim and holds no more than its questions; answers of a claim that is done are
    dropped. A claim whose answers never all come waits on.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = state.get if state.exists else None
        if saved is not None and saved[1]:
            return
        claim = Claim(last, json.loads(saved[2]) if saved is not None else None)
        for pdf in frames:
            for round, q_idx, *rest, answered, nothing, expected in sorted(zip(*(pdf[c].tolist() for c in ANSWER)), key=lambda r: r[:2]):
                claim.add(int(round), int(q_idx), *rest, bool(answered), bool(nothing), int(expected))
        got = claim.finished()
        state.update((claim.round, got is not None, "{}" if got is not None else json.dumps(claim.saved())))
        if got:
            yield pd.DataFrame([[key[0], *r] for r in got], columns=["claim_id", "round", "q_idx", "question", "answer", "url"])

    return answers.groupBy("claim_id").applyInPandasWithState(step, EVIDENCE, STATE, "append", GroupStateTimeout.NoTimeout)
