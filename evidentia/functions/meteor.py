"""METEOR between two token lists: Porter's stems and the alignment with the fewest chunks."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

# --- Fixed values: the suffixes of Porter's algorithm (1980) and what takes their place. ---------

STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

#: States that the search for an alignment keeps.
BEAM = 200
#: Places that a word may newly match, of those that are free: where a run of matches begins come first.
PLACES = 8

_PLAIN = re.compile(r"[a-z]+")
_MEASURE = re.compile("v+c+")


def _shape(word: str) -> str:
    """A letter v or c for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _m(word: str) -> int:
    return len(_MEASURE.findall(_shape(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    """By the rule of the longest suffix, if what is left is long enough."""
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            fits = _m(left) > least and (suffix != "ion" or left[-1:] in ("s", "t"))
            return left + new if fits else word
    return word


def _endings(word: str) -> str:
    """Plurals, -ed and -ing, and a last y."""
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _m(word[:-3]) else word
    else:
        cut = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
        if cut and "v" in _shape(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _m(word) == 1 and _short(word):
                word += "e"
    return word[:-1] + "i" if word.endswith("y") and "v" in _shape(word[:-1]) else word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Porter's stem; words of one or two letters, and words with other letters than a to z, stay."""
    if len(word) < 3 or not _PLAIN.fullmatch(word):
        return word
    word = _replaced(_replaced(_endings(word), STEP_2, 0), STEP_3, 0)
    word = _replaced(word, tuple((s, "") for s in STEP_4), 1)
    if word.endswith("e"):
        m = _m(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _m(word) > 1 else word


#: Choices of places that the search for separate places of runs looks at.
TRIES = 500


def _runs(long: list, short: list) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """What of the long list can matter: its runs in which each word is one of ``short`` and each pair of
    neighbours is one there, and where each begins. Other neighbours are a chunk's end anyway."""
    words, pairs = set(short), set(zip(short, short[1:]))
    found: dict[tuple, list[int]] = {}
    run, begin = [], 0
    for i, w in [*((i, w) for i, w in enumerate(long) if w in words), (-1, None)]:
        if run and i == begin + len(run) and (run[-1], w) in pairs:
            run.append(w)
            continue
        if run:
            found.setdefault(tuple(run), []).append(begin)
        run, begin = [w], i
    return list(found), found


def _separate(choices: list[list[int]], sizes: list[int]) -> bool:
    """Whether a search of ``TRIES`` steps finds a place for each run, none in another's."""
    order = sorted(range(len(sizes)), key=lambda k: len(choices[k]))
    tries, taken = TRIES, set()

    def put(n: int) -> bool:
        nonlocal tries
        if n == len(order):
            return True
        k = order[n]
        for p in choices[k]:
            mine = range(p, p + sizes[k])
            tries -= 1
            if tries < 0:
                return False
            if taken.isdisjoint(mine):
                taken.update(mine)
                if put(n + 1):
                    return True
                taken.difference_update(mine)
        return False

    return put(0)


def aligned(left: list[str], right: list[str], beam: int = BEAM, places: int = PLACES) -> tuple[int, int]:
    """(matches, chunks) of an alignment of equal words, each used once: as many matches as there can be,
    and among those as few runs of neighbours in both lists as the search finds.

    The longer list is first brought down to the runs that can matter, each as often as it can be of
    use, so the work grows with the shorter one but for one pass. If the longer has each word often
    enough, the shorter falls into the longest runs that the longer has; where these find separate
    places, no alignment has fewer. Else a search keeps the ``beam`` states with the fewest runs."""
    long, short = (left, right) if len(left) >= len(right) else (right, left)
    want = Counter(short)
    kinds, places_of = _runs(long, short)
    if not kinds:
        return 0, 0
    # Runs of the same words stand for each other, and no more of them are used than there are words to match.
    kept = [(kind, min(len(places_of[kind]), sum(want[w] for w in set(kind)))) for kind in kinds]
    have = Counter()
    for kind in kinds:
        for w in kind:
            have[w] += len(places_of[kind])
    matches = sum(min(n, want[w]) for w, n in have.items())
    lean: list[str | None] = []
    for kind, n in kept:
        for _ in range(n):
            lean += [*kind, None]
    if all(have[w] >= want[w] for w in have):
        at: dict[str | None, set[int]] = {}
        for j, w in enumerate(lean):
            at.setdefault(w, set()).add(j)
        choices, sizes, begins = [], [], set()
        for w in [*short, None]:
            here = at.get(w, set()) if w is not None else set()
            on = {p for p in begins if p + size in here} if begins else set()
            if on:
                begins, size = on, size + 1
                continue
            if begins:
                choices.append(sorted(begins))
                sizes.append(size)
            begins, size = here, 1
        if _separate(choices, sizes):
            return matches, len(sizes)
    return matches, _searched(lean, short, beam, places)


def _searched(left: list[str | None], right: list[str], beam: int, places: int) -> int:
    """The fewest chunks that a search through the left list finds; None stands for words without a match."""
    have, want = Counter(left), Counter(right)
    at: dict[str, list[int]] = {}
    for j, w in enumerate(right):
        at.setdefault(w, []).append(j)
    spare = {w: n - want[w] for w, n in have.items() if 0 < want[w] < n}
    # State: free places of the right list as bits, the last match if it is the word before, skips used.
    states: dict[tuple[int, int, tuple], int] = {((1 << len(right)) - 1, -2, ()): 0}
    for i, w in enumerate(left):
        new: dict[tuple[int, int, tuple], int] = {}

        def put(state: tuple[int, int, tuple], chunks: int) -> None:
            if chunks < new.get(state, 1 << 60):  # noqa: B023
                new[state] = chunks  # noqa: B023

        follows = left[i + 1] if i + 1 < len(left) else None
        for (free, last, skips), chunks in states.items():
            open_ = [j for j in at.get(w, ()) if free >> j & 1]
            if w in spare or not open_:
                used = dict(skips).get(w, 0)
                if not open_ or used < spare[w]:
                    put((free, -2, skips if not open_ else tuple(sorted({**dict(skips), w: used + 1}.items()))), chunks)
            if len(open_) > places:
                begins = [j for j in open_ if j == last + 1 or (j + 1 < len(right) and right[j + 1] == follows)]
                open_ = [*begins, *(j for j in open_ if j not in set(begins))][:places]
                if last >= 0 and last + 1 < len(right) and right[last + 1] == w and free >> (last + 1) & 1 and last + 1 not in open_:
                    open_.append(last + 1)
            for j in open_:
                put((free & ~(1 << j), j, skips), chunks + (j != last + 1))
        states = dict(sorted(new.items(), key=lambda x: x[1])[:beam]) if len(new) > beam else new
    return min(states.values())


def stemmed(left: list[str], right: list[str]) -> tuple[list[str | None], list[str | None]]:
    """The stems of both lists; None for words of the longer one that begin otherwise than all stems of the
    shorter, which are most. A stem begins as its word does, but for a y that has become an i."""
    short = [stem(w) for w in (left if len(left) < len(right) else right)]
    first, two = {s for s in short if len(s) == 1}, {s[:2] for s in short}
    two |= {s[0] + "y" for s in two if s[1:] == "i"}
    long = [stem(w) if w[:2] in two or w[:1] in first else None for w in (right if len(left) < len(right) else left)]
    return (short, long) if len(left) < len(right) else (long, short)


def meteor_score(left: list[str], right: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """METEOR of token lists: harmonic mean of precision and recall over words with equal stems, less a
    penalty for the chunks that the alignment falls into. There are no synonyms."""
    matches, chunks = aligned(*stemmed(left, right))
    if not matches:
        return 0.0
    p, r = matches / len(left), matches / len(right)
    mean = p * r / (alpha * p + (1 - alpha) * r)
    return mean * (1 - gamma * (chunks / matches) ** beta)
