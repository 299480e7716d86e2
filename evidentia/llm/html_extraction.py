"""HTML main text by a tree-structured graphical model over the page's block elements.

Every block element is a binary variable, content or not. Its own features give a unary potential,
each parent-child edge a pairwise one; two passes of sum-product messages, up and down the tree, give
the exact marginals. Unary weights and edge tables are fitted to labelled pages (``labelled_pages``).
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import over_batches, table

# Element names of HTML by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Text up to the end tag, whatever it holds; none of it is content.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes"}
#: Elements shown as something else than their text.
UNSEEN = {"template", "svg", "canvas", "video", "audio", "annotation", "annotation-xml"}
INLINE = {
    "object", "math", "semantics", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom",
    "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover",
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: A start tag of the first kind ends open elements of the second, up to the nearest of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements inside which an outer paragraph or end tag is not looked for.
SCOPE = {"table", "td", "th", "button", "html", "body"}

FEATURES = 4096
#: Log odds are kept within this, so that no single feature decides beyond all evidence.
CLAMP = 12.0

#: A quote begins a value only behind an equals sign and if the value ends before white space, a slash or
#: the tag's end; any other quote is a character like the rest, and the tag ends at the next ">".
_TAG = r"</?[a-zA-Z](?:[^>=]|=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|=)*+(?:>|\Z)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|{_TAG}|<[^<]*|[^<]+", re.S)
_ELEMENT = re.compile(r"[a-z][a-z0-9-]*")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BLANK = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    name: str
    parent: int
    marks: tuple[str, ...] = ()
    place: int = 0
    chars: int = 0
    linked: int = 0
    stops: int = 0
    runs: int = 0


@dataclass(slots=True)
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: (block, text) of every run of inline content, in page order.
    runs: list[tuple[int, str]] = field(default_factory=list)


class Ends:
    """Where elements end that are passed over whole. Each name's tags are looked for once."""

    def __init__(self, source: str):
        self.source = source
        self.raw: dict[str, list[int]] = {}
        self.nested: dict[str, dict[int, int]] = {}

    def of_raw(self, name: str, at: int) -> int | None:
        """The end of the first end tag of ``name`` from ``at`` on, tags or not in between."""
        found = self.raw.get(name)
        if found is None:
            found = self.raw[name] = [m.end() for m in re.finditer(rf"</{name}(?=[\s/>])[^>]*>", self.source, re.I)][::-1]
        while found and found[-1] <= at:
            found.pop()
        return found[-1] if found else None

    def of_nested(self, name: str, start: int) -> int | None:
        """The end of the end tag that goes with the start tag at ``start``."""
        if name not in self.nested:
            pairs: dict[int, int] = {}
            opened: list[int] = []
            for m in re.finditer(rf"<(/?){name}(?=[\s/>])[^>]*>", self.source, re.I):
                if not m.group(1):
                    opened.append(m.start())
                elif opened:
                    pairs[opened.pop()] = m.end()
            self.nested[name] = pairs
        return self.nested[name].get(start)


def parse(source: str) -> Page:
    """The block elements of a page and their runs of inline text. Unclosed and stray tags are
    tolerated; what is cut off at the end counts as it stands. Scripts and the like end at their end
    tag in the source, whatever stands before it; without one, a script or style takes the rest, while
    other elements that are passed over are ignored as if they were empty."""
    page = Page([Block("html", -1)])
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block they write to
    piece: list[str] = []
    links = 0
    linked = [0]
    blocks = page.blocks

    def flush(owner: int) -> None:
        text = _BLANK.sub(" ", html.unescape("".join(piece))).strip()
        piece.clear()
        if text:
            b = blocks[owner]
            page.runs.append((owner, text))
            b.chars += len(text)
            b.linked += min(linked[0], len(text))
            b.stops += sum(map(text.count, ".!?,;"))
            b.runs += 1
        linked[0] = 0

    def close(until: int) -> None:
        nonlocal links
        while len(stack) > until:
            name, owner = stack.pop()
            if name == "a":
                links -= 1
            if name not in INLINE and _ELEMENT.fullmatch(name):
                flush(owner)

    ends, at = Ends(source), 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        at, token = m.end(), m.group()
        if token[0] != "<" or not (named := _NAME.match(token)):
            if token[:2] not in ("<!", "<?"):
                piece.append(token)
                if links:
                    linked[0] += len(token.strip())
            continue
        name = named.group(1).lower()
        if token[1] == "/":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in SCOPE and name not in ("html", "body", "table", "article", "main", "section", "div"):
                    break
            continue
        if name in RAW or name in UNSEEN:
            if not token.endswith("/>"):
                end = ends.of_raw(name, m.end()) if name in RAW else ends.of_nested(name, m.start())
                at = end or (len(source) if name in ("script", "style") else at)
            piece.append(" ")
            continue
        if name in VOID or name == "html":
            piece.append(" ")
            if name == "hr":
                flush(stack[-1][1])
            continue
        if name in INLINE or not _ELEMENT.fullmatch(name):
            if name == "a":
                links += 1
            stack.append((name, stack[-1][1]))
            continue
        if name in CLOSES:
            closed, until = CLOSES[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in until:
                    break
                if stack[i][0] in closed:
                    close(i)
                    if name not in ("tr", "tbody"):
                        break
        else:  # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        flush(stack[-1][1])
        marks: list[str] = []
        if len(token) > len(name) + 2:
            for a in _ATTRIBUTE.finditer(token[len(name) + 1 :]):
                key, value = a.group(1).lower(), (a.group(2) or "").strip("\"'")
                if key == "hidden" or (key == "style" and _UNSEEN.search(value)):
                    marks.append("hidden")
                elif key != "style":
                    marks += _WORD.findall(_CAMEL.sub(" ", value).lower())
        blocks.append(Block(name, stack[-1][1], tuple(dict.fromkeys(marks)), m.start()))
        stack.append((name, len(blocks) - 1))
    close(1)
    flush(0)
    return page


def _slot(word: str) -> int:
    return 16 + zlib.crc32(word.encode()) % (FEATURES - 16)


def features(page: Page) -> list[dict[int, float]]:
    """Sparse features of every block: its name and marks (hashed), alone and with whether it lies in an
    article, those of the blocks around it, and the shape of the text in it."""
    blocks = page.blocks
    n = len(blocks)
    chars, linked, stops, runs = ([getattr(b, k) for b in blocks] for k in ("chars", "linked", "stops", "runs"))
    for i in range(n - 1, 0, -1):
        p = blocks[i].parent
        chars[p] += chars[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
        runs[p] += runs[i]
    total = max(1, chars[0])
    inside = [False] * n
    around: list[frozenset[int]] = [frozenset()] * n
    out = []
    for i, b in enumerate(blocks):
        inside[i] = i > 0 and (inside[b.parent] or blocks[b.parent].name in ("article", "main"))
        c = max(1, chars[i])
        f = {0: 1.0, 1: linked[i] / c, 2: min(1.0, 20 * stops[i] / c), 3: min(1.0, math.log1p(c / max(1, runs[i])) / 6), 4: chars[i] / total, 5: 1.0 if chars[i] == 0 else 0.0, 6: 1.0 if linked[i] > 0.6 * c else 0.0}
        f[_slot("name:" + b.name)] = 1.0
        f[_slot(("in:" if inside[i] else "out:") + b.name)] = 1.0
        for mark in b.marks:
            f[_slot("mark:" + mark)] = 1.0
        if i:
            p = blocks[b.parent]
            around[i] = around[b.parent] | {_slot("around:" + p.name), *(_slot("around:" + m) for m in p.marks)}
            f.update(dict.fromkeys(around[i], 1.0))
        out.append(f)
    return out


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    #: log P(child label | parent label) less the child's log prior, by parent and child label.
    edge: tuple[tuple[float, float], tuple[float, float]]


def marginals(page: Page, model: Model) -> list[float]:
    """Probability of content for every block, by messages up to the root and down again."""
    w, blocks = model.weights, page.blocks
    score = []
    for f in features(page):
        x = sum(w[k] * v for k, v in f.items())
        score.append(max(-CLAMP, min(CLAMP, x)))
    e = model.edge

    def message(x0: float, x1: float, table: tuple[tuple[float, float], tuple[float, float]]) -> float:
        """Log odds that a neighbour with log beliefs (x0, x1) sends through an edge table."""
        out = []
        for to in (0, 1):
            a, b = x0 + table[to][0], x1 + table[to][1]
            top = max(a, b)
            out.append(top + math.log(math.exp(a - top) + math.exp(b - top)))
        return out[1] - out[0]

    across = ((e[0][0], e[1][0]), (e[0][1], e[1][1]))
    n = len(blocks)
    up, sent = list(score), [0.0] * n
    for i in range(n - 1, 0, -1):
        sent[i] = message(0.0, up[i], e)
        up[blocks[i].parent] += sent[i]
    full = list(up)
    for i in range(1, n):
        p = blocks[i].parent
        full[i] = up[i] + message(0.0, full[p] - sent[i], across)
    return [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in full]


def main_text(source: str | None, model: Model) -> str:
    """Runs of the blocks that are rather content than not, in page order, one a line."""
    if not source:
        return ""
    page = parse(source)
    p = marginals(page, model)
    return "\n".join(text for owner, text in page.runs if p[owner] >= 0.5)


# Names of page parts that the labelled pages use.
BOILERPLATE = {
    "nav": "nav navbar menu navigation mainmenu topnav breadcrumb breadcrumbs toc pagination pager",
    "header": "header masthead topbar site logo branding hero",
    "footer": "footer copyright colophon bottom legal credits",
    "aside": "sidebar side widget related recommended popular trending aside rail more links tags archive author bio",
    "notice": "notice cookie cookies consent banner alert gdpr privacy popup modal overlay warning message announcement toast disclaimer paywall",
    "ad": "ad ads advert advertisement adslot sponsor sponsored promo promotion dfp commercial",
    "form": "form search login signup subscribe newsletter contact register",
    "comment": "comment comments discussion replies reply respond disqus reader feedback thread reviews",
    "share": "share social sharing follow buttons tools meta byline",
}
CONTENT = "content article post entry story main body text page news blog single primary articlebody maincontent"
PLAIN = "wrapper container row col inner box section block wrap grid layout center outer"


def labelled_pages(count: int = 600, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages of many layouts with the label of every block as ``parse`` meets them: 1 for content and
    for wrappers most of whose text is content. Drawn from a rule and a seed, so always the same."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))

    def sentence() -> str:
        s = words(rng.randint(5, 18))
        return (s.replace(" ", ", ", 1) if rng.random() < 0.4 else s).capitalize() + rng.choice("...!?")

    out = []
    for _ in range(count):
        parts: list[tuple[str, int | None]] = []  # markup, and the label of the block that it opens

        def tag(name: str, label: int | None, marks: str = "") -> None:
            parts.append((f'<{name} {rng.choice(("class", "id"))}="{marks}">' if marks else f"<{name}>", label))  # noqa: B023

        def text(x: str) -> None:
            parts.append((x, None))  # noqa: B023

        def paragraphs(label: int, n: int) -> None:
            for _ in range(n):
                name = rng.choices(("p", "h2", "blockquote", "ul", "pre", "div", "h3", "table"), (14, 2, 1, 1, 0.5, 2, 1, 0.5))[0]
                if name == "ul":
                    tag("ul", label)
                    for _ in range(rng.randint(2, 4)):
                        tag("li", label)
                        text(sentence() + "</li>")
                    text("</ul>")
                elif name == "table":
                    tag("table", label)
                    tag("tr", label)
                    for _ in range(3):
                        tag("td", label)
                        text(words(3) + "</td>")
                    text("</tr></table>")
                else:
                    tag(name, label)
                    short = name in ("h2", "h3") or rng.random() < 0.15
                    body = words(rng.randint(1, 6)) if short else " ".join(sentence() for _ in range(rng.randint(1, 6)))
                    if rng.random() < 0.2:
                        body += f' <a href="/x">{words(2)}</a>'
                    text(body if name == "p" and rng.random() < 0.15 else f"{body}</{name}>")

        def chrome(kind: str) -> None:
            marks = rng.choice(BOILERPLATE[kind].split())
            if rng.random() < 0.3:
                marks += " " + rng.choice(BOILERPLATE[kind].split() + PLAIN.split())
            name = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
            bare = name != "div" and rng.random() < 0.4
            name = name if bare or rng.random() < 0.5 else rng.choice(("div", "section", "ul") if kind == "nav" else ("div", "section"))
            tag(name, 0, "" if bare else marks)
            if kind in ("header", "footer", "aside", "notice") and rng.random() < 0.5:
                title = rng.choice(("h1", "h2", "h3", "p"))
                tag(title, 0)
                text(f"{words(rng.randint(1, 4))}</{title}>")
            if kind in ("nav", "aside", "share", "footer", "header") and rng.random() < 0.6:
                if name != "ul":
                    tag("ul", 0)
                for _ in range(rng.randint(2, 6)):
                    tag("li", 0)
                    text(f'<a href="/{words(1)}">{words(rng.randint(1, 4))}</a></li>')
                if name != "ul":
                    text("</ul>")
            elif kind == "form":
                if name != "form":
                    tag("form", 0)
                text(f"<label>{words(2)}</label><input name=q>")
                tag("button", 0)
                text(f"{words(1)}</button>")
                if name != "form":
                    text("</form>")
            if kind in ("comment", "notice", "ad", "footer", "header", "aside"):
                if kind == "comment" and rng.random() < 0.6:
                    tag("h3", 0)
                    text(words(1) + "</h3>")
                for _ in range(rng.randint(1, 4) if kind == "comment" else rng.randint(0, 2)):
                    tag(rng.choice(("p", "div", "article") if kind == "comment" else ("p", "div")), 0, rng.choice(("", marks)) if rng.random() < 0.5 else "")
                    text(" ".join(sentence() for _ in range(rng.randint(1, 3))))
                    text(f"</{parts[-2][0][1:].split()[0].rstrip('>')}>")  # noqa: B023
                text(sentence() if rng.random() < 0.5 else words(3))
            text(f"</{name}>")

        tag("body", 1)
        wraps = rng.randint(0, 2)
        for kind in ("notice", "header", "nav", "ad", "form"):
            if rng.random() < 0.55:
                chrome(kind)
        for _ in range(wraps):
            tag("div", 1, rng.choice(PLAIN.split()))
        if rng.random() < 0.35:
            chrome("aside")
        name = rng.choices(("article", "main", "div", "section"), (6, 2, 3, 1))[0]
        nested = name == "main" and rng.random() < 0.5
        tag(name, 1, rng.choice(CONTENT.split()) if name in ("div", "section") or rng.random() < 0.4 else "")
        if nested:
            tag("article", 1)
        if rng.random() < 0.8:
            title_in = rng.random() < 0.2
            if title_in:
                tag("header", 1)
            tag("h1", 1)
            text(words(rng.randint(2, 9)) + "</h1>" + ("</header>" if title_in else ""))
        tiny = rng.random() < 0.25
        paragraphs(1, 1 if tiny else rng.randint(1, 5))
        for kind in ("ad", "share", "aside", "form", "notice"):
            if rng.random() < 0.4:
                chrome(kind)
        if not tiny:
            paragraphs(1, rng.randint(1, 6))
        if rng.random() < 0.25:
            chrome(rng.choice(("comment", "footer", "share")))
        text(("</article>" if nested else "") + f"</{name}>")
        for kind in ("comment", "aside", "ad"):
            if rng.random() < 0.4:
                chrome(kind)
        text("</div>" * wraps)
        for kind in ("form", "footer", "notice"):
            if rng.random() < 0.6:
                chrome(kind)
        head = f"<!DOCTYPE html><html><head><title>{words(4)}</title><script>var a='<p>';</script></head>"
        out.append((head + "".join(m for m, _ in parts) + "</body></html>", [1, 0, *(x for _, x in parts if x is not None)]))
    return out


def train(pages: list[tuple[str, list[int]]], rounds: int = 500, rate: float = 3.0, ridge: float = 1e-5) -> Model:
    """Logistic unary weights by gradient descent, and the edge table from counted parent-child labels."""
    rows, labels, pairs = [], [], np.ones((2, 2))
    for source, truth in pages:
        page = parse(source)
        if len(page.blocks) != len(truth):
            raise ValueError(f"{len(truth)} labels for {len(page.blocks)} blocks")
        for f, y in zip(features(page), truth):
            rows.append(f)
            labels.append(y)
        for b, y in zip(page.blocks, truth):
            if b.parent >= 0:
                pairs[truth[b.parent], y] += 1
    used = sorted({k for f in rows for k in f})
    column = {k: i for i, k in enumerate(used)}
    x = np.zeros((len(rows), len(used)), dtype=np.float32)
    for i, f in enumerate(rows):
        x[i, [column[k] for k in f]] = list(f.values())
    y, w, speed = np.array(labels, dtype=np.float32), np.zeros(len(used), np.float32), np.zeros(len(used), np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - rate * (x.T @ (p - y) / len(y) + ridge * w)
        w = w + speed
    given = pairs / pairs.sum(axis=1, keepdims=True)
    prior = pairs.sum(axis=0) / pairs.sum()
    edge = np.log(given) - np.log(prior)[None, :]
    weights = np.zeros(FEATURES)
    weights[used] = w
    return Model(tuple(weights.tolist()), tuple(tuple(r) for r in edge.tolist()))


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(df: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id as ``id``, the columns of ``keep`` as they are, and ``text``: blocks
    with character references decoded, white space made single and trimmed, one a line in page order.

    Null and empty pages, and pages without content, give the empty text; a null id stays; repeated
    rows each give their row. One pass without a shuffle; the model is a few KB.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]

    def one(batch: pa.RecordBatch) -> dict[str, list]:
        out = {n: batch.column(i).to_pylist() for i, n in enumerate(("id", *names))}
        return out | {"text": [main_text(x, shared.value) for x in batch.column(len(names) + 1).to_pylist()]}

    kinds = dict(df.dtypes)
    schema = ", ".join([f"id {kinds[id_col]}", *(f"{n} {kinds[k]}" for n, k in zip(names, keep)), "text string"])
    got = over_batches(df.select(F.col(id_col).alias("id"), *(F.col(k).alias(n) for n, k in zip(names, keep)), F.col(html_col).cast("string").alias("html")), one, schema)
    return got.select("id", *(F.col(n).alias(k) for n, k in zip(names, keep)), "text")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``extract`` of every page: page_id, url, text and n_chars, the text's code points."""
    got = extract(table(spark, sf_dir, "pages"), default_model(), keep=("url",))
    return got.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
