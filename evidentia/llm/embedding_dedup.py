"""Embedding near-duplicates over an inverted multi-index.

Vectors are scaled to length one and halved; each half has a codebook, and a cell is a pair of
codewords. A query visits cells by multi-sequence traversal, nearest first. How far a half is from
the border of another codeword's region bounds from below how far it is from any vector in that
region, so the traversal stops when the bound passes the distance that the threshold allows: every
link is found, a recall of one, and candidates are then verified in double precision.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import cut, table
from evidentia.llm.components import components

#: Vectors on which codebooks are fitted, at most; chosen by a hash of the vector.
FIT = 20_000
#: Vectors of the largest label that a cell should hold on average; codebooks grow with the label, as far
#: as there are ``EACH`` fitted vectors for a codeword. Finer cells cost more visits than they save
#: comparisons where vectors fill the space evenly.
PER_CELL, EACH = 1024, 16
#: Vectors that a worker probes at once.
SLICE = 1000
#: Vectors in one block of a cell.
BLOCK = 2048


def codebook(points: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """Codewords by k-means from a spread-out start; the same points give the same codewords."""
    points = np.unique(points, axis=0)
    centres = [points[0]]
    far = ((points - points[0]) ** 2).sum(1)
    while len(centres) < min(codes, len(points)):
        centres.append(points[int(far.argmax())])
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        own = squared(points, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :], 0)


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest codeword of each point, squared least distance from the point to each codeword's region)."""
    d = squared(x, c)
    own = d.argmin(1)
    apart = np.sqrt(squared(c, c))[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        least = (d - d[np.arange(len(x)), own][:, None]) / (2 * apart)
    least[np.arange(len(x)), own] = 0
    return own, np.nan_to_num(least, nan=0.0, posinf=0.0) ** 2


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells (i, j) by growing ``first[i] + second[j]`` up to ``limit``: the multi-sequence algorithm."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    out, queue, seen = [], [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while queue and queue[0][0] <= limit:
        _, i, j = heapq.heappop(queue)
        out.append((int(a[i]), int(b[j])))
        for k, l in ((i + 1, j), (i, j + 1)):
            if k < len(a) and l < len(b) and (k, l) not in seen:
                seen.add((k, l))
                heapq.heappush(queue, (first[a[k]] + second[b[l]], k, l))
    return out


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: the id as ``id``, ``n_links`` (other rows of the same label whose cosine
    is at least ``threshold``) and ``component_id``, the least id reachable by links, its own included.

    Rows without a label, and vectors that are null, empty, zero or hold null or non-finite components,
    link with nothing, as do vectors of different lengths; a null id stays null and links with nothing.
    Rows of equal label and vector are one class, compared once and counted as often as they occur; rows
    of one id with different vectors are rows of their own. An empty table gives no rows.

    Cells are cut into blocks, and a task compares two blocks with one matrix product, so a hot label
    or cell is many tasks; tasks return a count for each vector and a forest of links, never pairs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0, up to 1")
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    good = F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(good, F.lit(False))
    # Equal vectors of a label are one class; the class's vector and its number of rows go on.
    members = cut(rows.where(usable).select("id", "label", "v", F.unhex(F.md5(F.to_json(F.struct("label", "v")))).alias("h")))
    classes = members.groupBy("h").agg(F.first("label").alias("label"), F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"), F.size(F.first("v")).alias("dims"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))  # written, so that the numbers stay
    sizes = classes.groupBy("dims", "label").agg(F.count("*").alias("n")).groupBy("dims").agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect()  # one row for each length of vector
    share = F.coalesce(*[F.when(F.col("dims") == s.dims, F.lit(min(1.0, 1.2 * FIT / s.n))) for s in sizes], F.lit(1.0)) if sizes else F.lit(1.0)
    drawn = classes.withColumn("place", F.pmod(F.xxhash64("h"), F.lit(1 << 30))).where(F.col("place") < share * (1 << 30)).select("dims", "place", "h", "v")
    codes_of = {s.dims: max(2, min(FIT // EACH, int(math.sqrt(s.most / PER_CELL)) + 1)) for s in sizes}

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        dims, out = int(pdf["dims"].iloc[0]), []
        unit, half = _unit(np.array(pdf.sort_values(["place", "h"])["v"].tolist()[:FIT])), max(1, dims // 2)
        for k, part in enumerate((unit[:, :half], unit[:, half:])):
            book = codebook(part, codes_of[dims]) if part.shape[1] else np.zeros((1, 0))
            out.append(pd.DataFrame({"dims": dims, "half": k, "code": range(len(book)), "word": list(book)}))
        return pd.concat(out)

    learnt = drawn.groupBy("dims").applyInPandas(learn, "dims int, half int, code int, word array<double>").collect()  # two codebooks for each length
    books = {}
    for d in codes_of:
        words = ([r.word for r in sorted(learnt, key=lambda r: r.code) if (r.dims, r.half) == (d, k)] for k in (0, 1))
        books[d] = (max(1, d // 2), *(np.array(w, dtype=float).reshape(len(w), -1) if w[0] else np.zeros((1, 0)) for w in words))
    radius = 2 - 2 * threshold + 1e-9
    shared = spark.sparkContext.broadcast(books)  # at most two codebooks of FIT / EACH words for each length

    def probe(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            slices = (part.iloc[at : at + SLICE] for _, part in pdf.groupby("dims") for at in range(0, len(part), SLICE))
            for part in slices:
                dims = int(part["dims"].iloc[0])
                half, one, two = shared.value[dims]
                x = _unit(np.array(part["v"].tolist()))
                own1, low1 = bounds(x[:, :half], one)
                own2, low2 = bounds(x[:, half:], two) if dims > 1 else (np.zeros(len(x), int), np.zeros((len(x), 1)))
                out = {k: [] for k in ("row", "ci", "cj", "home")}
                for r in range(len(x)):
                    home = (int(own1[r]), int(own2[r]))
                    for cell in traverse(low1[r], low2[r], radius):
                        # A pair is met from its lower cell to its higher one.
                        if cell >= home:
                            out["row"].append(r)
                            out["ci"].append(cell[0])
                            out["cj"].append(cell[1])
                            out["home"].append(cell == home)
                at = np.array(out["row"], dtype=int)
                yield part.iloc[at].reset_index(drop=True).assign(ci=out["ci"], cj=out["cj"], home=out["home"])[["label", "dims", "ci", "cj", "home", "rep", "n", "v"]]

    kind = dict(rows.dtypes)["label"]
    visits = classes.select("label", "dims", "rep", "n", "v").mapInPandas(probe, f"label {kind}, dims int, ci int, cj int, home boolean, rep bigint, n bigint, v array<double>")
    cell = ["label", "dims", "ci", "cj"]
    visits = cut(visits)
    # Residents of a cell in blocks; every visitor goes to every block, and residents to those from their own on.
    counts = visits.groupBy(*cell).agg(F.sum(F.col("home").cast("int")).alias("residents"), F.count("*").alias("n")).where("residents > 0")
    counts = counts.select(*cell, F.ceil(F.col("residents") / BLOCK).cast("int").alias("rb"), F.ceil((F.col("n") - F.col("residents")) / BLOCK).cast("int").alias("vb"))
    dealt = visits.join(counts, cell).withColumn("deal", F.xxhash64("rep"))
    home = dealt.where("home").withColumn("mine", F.pmod("deal", "rb"))
    inner = home.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rb") - 1))).select(*cell, F.concat(F.lit("r"), F.least("mine", "other")).alias("p"), F.concat(F.lit("r"), F.greatest("mine", "other")).alias("q"), F.concat(F.lit("r"), "mine").alias("part"), "rep", "n", "v")
    guests = dealt.where("not home").withColumn("mine", F.pmod("deal", "vb")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rb") - 1))).select(*cell, F.concat(F.lit("r"), "other").alias("p"), F.concat(F.lit("v"), "mine").alias("q"), F.concat(F.lit("v"), "mine").alias("part"), "rep", "n", "v")
    hosts = home.where("vb > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))).select(*cell, F.concat(F.lit("r"), "mine").alias("p"), F.concat(F.lit("v"), "other").alias("q"), F.concat(F.lit("r"), "mine").alias("part"), "rep", "n", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        a = pdf[pdf["part"] == p]
        b = a if p == q else pdf[pdf["part"] == q]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "links": []})
        hit = _unit(np.array(a["v"].tolist())) @ _unit(np.array(b["v"].tolist())).T >= threshold
        ra, rb, na, nb = a["rep"].to_numpy(), b["rep"].to_numpy(), a["n"].to_numpy(), b["n"].to_numpy()
        if p == q:
            np.fill_diagonal(hit, False)
        found = [pd.DataFrame({"a": ra, "b": ra, "links": hit @ nb})]
        if p != q:
            found.append(pd.DataFrame({"a": rb, "b": rb, "links": hit.T @ na}))
        forest = _forest(hit, len(ra), same=p == q)
        if len(forest):
            found.append(pd.DataFrame({"a": ra[forest[:, 0]], "b": rb[forest[:, 1]], "links": 0}))
        out = pd.concat(found)
        return out[(out["links"] > 0) | (out["a"] != out["b"])]

    made = cut(inner.unionByName(guests).unionByName(hosts).groupBy(*cell, "p", "q").applyInPandas(compare, "a bigint, b bigint, links bigint"))
    links = made.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(made.where("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    of_class = classes.select("h", "rep", "n", "least").join(links, "rep", "left").join(roots, "rep", "left").select("h", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    component = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.select("id", "h").join(of_class.join(component, "root").select("h", "n_links", "component_id"), "h").select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(hit: np.ndarray, n: int, same: bool) -> np.ndarray:
    """Links (row, column) that connect whatever the matrix connects, without cycles."""
    rows, cols = hit.shape
    parent = list(range(n if same else n + cols))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, reached = [], np.zeros(cols, dtype=bool)
    seen: set[bytes] = set()
    for i in np.flatnonzero(hit.any(axis=1)):
        line = hit[i]
        key = line.tobytes()
        # Once a column is tied to some row, only the first tied column of a row is needed besides new ones.
        tied = np.flatnonzero(line & reached)
        fresh = np.flatnonzero(line & ~reached)
        if key in seen:
            tied = tied[:1]
        seen.add(key)
        for j in [*tied.tolist(), *fresh.tolist()]:
            a, b = root(int(i)), root(j if same else n + j)
            if a != b:
                parent[a] = b
                out.append((int(i), j))
        reached |= line
    return np.array(out, dtype=int).reshape(-1, 2)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of every vector at a cosine of 0.93: vec_id, n_links, component_id and kept, which
    is false for a null id."""
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


QUERIES = {"op9_embedding_dedup": op9_embedding_dedup}

ORACLE = {
    "op9_embedding_dedup": """
with recursive good as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select a.vec_id as a, b.vec_id as b from good a join good b
  on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.93),
reach as (
  select a as start, b as node from pairs union select r.start, p.b from reach r join pairs p on r.node = p.a),
least_of as (select start, min(node) as m from reach group by start),
links as (select a, count(*) as n from pairs group by a)
select e.vec_id, coalesce(l.n, 0)::bigint as n_links, least(e.vec_id, coalesce(m.m, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(m.m, e.vec_id)) as kept
from embeddings e left join links l on l.a = e.vec_id left join least_of m on m.start = e.vec_id"""
}
