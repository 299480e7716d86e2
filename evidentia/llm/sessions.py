"""Sessions of clicks: runs without a long gap, ended by final clicks and by length.

Clicks are summed up by client and time cells as wide as the gap: first and last click of each. Gap
islands are found on these summaries, in blocks of cells, and go back to the clicks of a cell; so a
client with a third of all clicks is spread over its cells. Where a session grows too long, its clicks
point to the first one beyond the length, and pointers are doubled until no chain is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import cut, table

MINUTE = 60_000_000
#: Cells in a block.
BLOCK = 96


def micros(df: DataFrame, name: str) -> Column:
    """A timestamp's microseconds since 1970; one without a zone counts as UTC."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name).cast("timestamp"))


def cell_of(t: Column, gap: int) -> Column:
    """The number of the cell that a time lies in: exact, also before 1970."""
    return ((t - F.pmod(t, F.lit(gap))) / gap).cast("bigint")


def carried(cells: DataFrame, before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """``cells`` (``client``, ``cell``) with the greatest of each of ``before`` over the client's earlier
    cells, and the least of each of ``after`` over its later ones; null where there are none.

    Two levels: inside blocks of cells, and over the blocks of a client.
    """
    values = {**before, **after}
    of = cells.withColumn("_block", F.floor(F.col("cell") / BLOCK)).withColumns({f"_v_{n}": v for n, v in values.items()})
    best = {**{n: F.max for n in before}, **{n: F.min for n in after}}

    def over(df: DataFrame, by: list[str], order: str, names: dict[str, str]) -> dict[str, Column]:
        rows = lambda n: Window.partitionBy(*by).orderBy(F.asc(order) if n in before else F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
        return {names[n]: best[n](F.col(f"_v_{n}")).over(rows(n)) for n in values}

    blocks = of.groupBy("client", "_block").agg(*[best[n](f"_v_{n}").alias(f"_v_{n}") for n in values])
    far = blocks.withColumns(over(blocks, ["client"], "_block", {n: f"_far_{n}" for n in values})).drop(*[f"_v_{n}" for n in values])
    near = of.withColumns(over(of, ["client", "_block"], "cell", {n: f"_near_{n}" for n in values}))
    nearest = {n: F.coalesce(F.col(f"_near_{n}"), F.col(f"_far_{n}")) for n in values}
    return near.join(far, ["client", "_block"]).withColumns(nearest).select(*cells.columns, *values)


def reached(starts: DataFrame, pointers: DataFrame) -> DataFrame:
    """All rows (``id``, ``client``, ``cell``, ``t``) that ``pointers`` (``id`` to ``to``, a struct of those)
    lead to from ``starts``, to which none leads. Pointers are doubled in each round, so rounds are
    the logarithm of the longest chain."""
    known, pointers = cut(starts.withColumn("led", F.lit(False))), cut(pointers)
    while True:
        new = cut(known.join(pointers, "id").select("to.*", F.lit(True).alias("led")))
        if new.isEmpty():
            return known.where("led").drop("led")
        known = cut(known.unionByName(new).distinct(), instead_of=known)
        further = pointers.select("id", F.col("to").alias("_via"), F.col("to.id").alias("_on"))
        pointers = cut(further.join(pointers.select(F.col("id").alias("_on"), "to"), "_on").select("id", "to"), instead_of=pointers)


def sessionise(events: DataFrame, final: Column, amount: Column, gap: int = 15 * MINUTE, span: int = 60 * MINUTE, late: int = 15 * MINUTE, id_col: str = "click_id", client_col: str = "client_id", time_col: str = "ts", arrival_col: str = "arrived_at") -> DataFrame:
    """One row per session: ``client``, ``session`` (id of its first click), ``start_us``, ``end_us``, ``n``,
    ``n_late``, ``amount``, ``closed_by`` (end, gap, length, none) and ``ids``, its clicks' ids in order.

    A client's clicks, by time and id, go on with the session unless the one before is ``final``, or is
    ``gap`` microseconds earlier or more, or the session's first is more than ``span`` earlier. Clicks
    that arrive more than ``late`` after their time join none; they are counted with the client's last
    session that started by then, if any. ``amount`` is summed, nulls as 0.

    Rows without id, client or time are left out; of rows with one id, the one that arrived first
    counts, among equals the least by the other columns. A row without an arrival is not late; a null
    ``final`` is false. Ties in time go by id. Other columns are not read; an empty table gives no rows.
    Times are exact to the microsecond; ``span`` has to be at least ``gap``.

    Rows are shuffled by id and by (client, cell), sessions by client and start. Windows hold one
    client's cell, a block of its cells, or its blocks: no client goes through one task. A session's ids
    meet in one row, as a digest over them needs; ``span`` bounds it in time.
    """
    if not 0 < gap <= span:
        raise ValueError("the length has to be the gap or more")
    taken = events.select(
        F.col(id_col).alias("id"), F.col(client_col).alias("client"), micros(events, time_col).alias("t"), micros(events, arrival_col).alias("arrived"),
        F.coalesce(final, F.lit(False)).alias("final"), F.coalesce(amount.cast("bigint"), F.lit(0)).alias("amount"),
    ).where("id is not null and client is not null and t is not null")
    first = F.min(F.struct("arrived", "client", "t", "final", "amount")).alias("_one")
    clicks = taken.groupBy("id").agg(first).select("id", "_one.*")
    clicks = clicks.withColumn("late", F.coalesce(F.col("arrived") - F.col("t") > late, F.lit(False))).withColumn("cell", cell_of(F.col("t"), gap)).drop("arrived")

    # Breaks inside cells, where timely clicks come first; the first click of a cell is judged on the
    # summaries. The last row of a cell holds what it sums up to.
    inside = Window.partitionBy("client", "cell").orderBy("late", "t", "id")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at, timely = F.struct("t", "id"), ~F.col("late")
    marked = clicks.repartition("client", "cell").withColumns({"previous_t": F.lag("t").over(inside), "_ended": F.lag("final").over(inside), "next_t": F.lead(F.when(timely, F.col("t"))).over(inside), "is_last": F.lead("id").over(inside).isNull()})
    known = timely & F.col("previous_t").isNotNull() & (F.col("_ended") | (F.col("t") - F.col("previous_t") >= gap))
    of_cell = {
        "first_t": F.first(F.when(timely, F.col("t")), ignorenulls=True),
        "first_id": F.first(F.when(timely, F.col("id")), ignorenulls=True),
        "last_t": F.last(F.when(timely, F.col("t")), ignorenulls=True),
        "last_final": F.last(F.when(timely, F.col("final")), ignorenulls=True),
        "break_t": F.first(F.when(F.col("known"), F.col("previous_t")), ignorenulls=True),
        "start_t": F.last(F.when(F.col("known"), F.col("t")), ignorenulls=True),
        "start_id": F.last(F.when(F.col("known"), F.col("id")), ignorenulls=True),
    }
    summed = marked.withColumn("known", known).withColumns({n: v.over(so_far) for n, v in of_cell.items()})
    rows = cut(summed.select("client", "cell", "late", "t", "id", "final", "amount", "next_t", "known", F.when(F.col("is_last"), F.struct(*of_cell)).alias("sums")))

    # Cells of clients: first and last click, breaks inside, and the nearest clicks outside.
    pair = lambda t, x, name: F.when(F.col(t).isNotNull(), F.struct(F.col(t).alias("t"), F.col(x).alias(name)))
    cells = rows.where("sums is not null").select("client", "cell", "sums.*")
    cells = cells.select("client", "cell", pair("first_t", "first_id", "id").alias("first"), pair("last_t", "last_final", "final").alias("last"), "break_t", pair("start_t", "start_id", "id").alias("last_start"))
    cells = carried(cells, {"earlier": F.col("last")}, {"later": F.col("first")})
    apart = lambda a, b: b["t"].isNull() | (b["t"] - a["t"] >= gap) | a["final"]
    opens = F.col("first").isNotNull() & (F.col("earlier").isNull() | apart(F.col("earlier"), F.col("first")))
    closes = F.col("last").isNotNull() & apart(F.col("last"), F.col("later"))
    cells = cells.withColumn("opens", opens).withColumn("closes", closes).withColumn("last_start", F.coalesce("last_start", F.when(F.col("opens"), F.col("first"))))
    # Where the run that comes into a cell ends, if it does not go on behind it.
    stop = F.coalesce("break_t", F.when(F.col("closes"), F.col("last.t")))
    cells = cut(cells.withColumn("_stop", F.when(~F.col("opens"), F.struct("cell", stop.alias("t")))).withColumn("_stop", F.when(F.col("_stop.t").isNotNull(), F.col("_stop"))))
    runs = cut(carried(cells, {}, {"stop": F.col("_stop")}), instead_of=cells).drop("_stop")

    # Clicks whose run goes on for more than the length point to the first one beyond it, which lies in the
    # cell of that time or, if the click is not there, is the first of a later cell.
    onward = F.col("first").isNotNull() & ~F.col("closes") & (F.coalesce(F.col("last_start.t"), F.col("first.t")) + span < F.col("stop.t"))
    long = runs.where(onward).select("client", "cell", F.col("last_start.t").alias("from_t"), F.col("last_start.id").alias("from_id"), F.col("stop.t").alias("stop_t"))
    ahead = F.sequence(*[cell_of(F.col("cell") * gap + x + span, gap) for x in (0, gap - 1)])
    there = long.select("client", F.explode(ahead).alias("cell"), *[F.lit(None).cast("bigint").alias(c) for c in ("from_t", "from_id", "stop_t")])
    wanted = long.unionByName(there).groupBy("client", "cell").agg(*[F.max(c).alias(c) for c in ("from_t", "from_id", "stop_t")])
    some = cut(rows.where(timely).select("client", "cell", "t", "id").join(wanted, ["client", "cell"]))
    begun = F.col("from_t").isNull() | (at >= F.struct(F.col("from_t").alias("t"), F.col("from_id").alias("id")))
    sources = some.where(begun & (F.col("t") + span < F.col("stop_t")))
    probes = sources.select("client", cell_of(F.col("t") + span, gap).alias("cell"), (F.col("t") + span).alias("t"), "id", F.lit(True).alias("probe"))
    targets = some.select("client", "cell", "t", "id", F.lit(False).alias("probe"))
    click = F.when(~F.col("probe"), F.struct("id", "client", "cell", "t"))
    backwards = Window.partitionBy("client", "cell").orderBy(F.desc("t"), F.desc("probe"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = probes.unionByName(targets).withColumn("to", F.last(click, ignorenulls=True).over(backwards)).where("probe")
    beyond = runs.select("client", "cell", F.struct(F.col("later.id").alias("id"), "client", cell_of(F.col("later.t"), gap).alias("cell"), F.col("later.t").alias("t")).alias("_beyond"))
    pointers = found.join(beyond, ["client", "cell"], "left").select("id", F.coalesce("to", "_beyond").alias("to"))
    starts = sources.where((F.col("t") == F.col("from_t")) & (F.col("id") == F.col("from_id"))).select("id", "client", "cell", "t")
    jumps = reached(starts, pointers).groupBy("client", "cell").agg(F.max(at).alias("jump"))

    # All starts: breaks inside cells, first clicks of cells that open a run, ends of jumps; then the last
    # one up to each click, late ones included.
    cells = runs.join(jumps, ["client", "cell"], "left").withColumn("_last", F.greatest("last_start", "jump"))
    cells = carried(cells, {"open": F.col("_last")}, {}).select("client", "cell", "opens", "first", "later", "jump", "open")
    started = F.col("known") | (timely & ((F.col("opens") & (at == F.col("first"))) | F.coalesce(at == F.col("jump"), F.lit(False))))
    up_to = Window.partitionBy("client", "cell").orderBy("t", "late", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At one time, timely clicks come first, so a late click sees all starts of its time.
    of = rows.drop("sums").join(cells, ["client", "cell"]).withColumn("start", F.coalesce(F.last(F.when(started, at), ignorenulls=True).over(up_to), F.col("open"))).where("start is not null")
    wait = F.coalesce("next_t", "later.t") - F.col("t")
    ended = F.struct("t", "id", F.when(F.col("final"), "end").when(wait.isNull(), "none").when(wait >= gap, "gap").otherwise("length").alias("by"))
    sessions = of.groupBy("client", "start").agg(
        F.max(F.when(timely, ended)).alias("_end"),
        F.count(F.when(timely, 1)).alias("n"),
        F.count(F.when(F.col("late"), 1)).alias("n_late"),
        F.sum(F.when(timely, F.col("amount")).otherwise(0)).alias("amount"),
        F.array_sort(F.collect_list(F.when(timely, at))).alias("_clicks"),
    )
    return sessions.select("client", F.col("start.id").alias("session"), F.col("start.t").alias("start_us"), F.col("_end.t").alias("end_us"), "n", "n_late", "amount", F.col("_end.by").alias("closed_by"), F.col("_clicks.id").alias("ids"))


def op12_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions of ``clicks``; purchases and signups of 60 or more are final."""
    clicks = table(spark, sf_dir, "clicks")
    final = (F.col("value") >= 60) & F.col("kind").isin("purchase", "signup")
    got = sessionise(clicks, final, F.floor(100 * F.col("value") + 0.5))
    path = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return got.select(F.col("client").alias("client_id"), F.col("session").alias("session_id"), "start_us", "end_us", F.col("n").alias("n_clicks"), "n_late", F.col("amount").alias("value_cents"), "closed_by", path.alias("path_sha256"))


QUERIES = {"op12_gap_sessions": op12_gap_sessions}

#: Sessions follow from breaks and, along a recursion, from the first time beyond the length of each start.
ORACLE = {
    "op12_gap_sessions": """
with recursive c as (
  select click_id, client_id, epoch_us(ts) as t, arrived_at - ts > interval 15 minutes as late,
    coalesce(value >= 60 and kind in ('purchase', 'signup'), false) as final, coalesce(floor(100 * value + 0.5), 0)::bigint as cents
  from (select distinct on (click_id) * from clicks where ts is not null and client_id is not null order by click_id, arrived_at)),
m as (select *, coalesce(lag(final) over w or t - lag(t) over w >= 900000000, true) as brk, lead(t) over w as next_t from c where not late window w as (partition by client_id order by t, click_id)),
r as (select *, sum(brk::int) over (partition by client_id order by t, click_id) as run from m),
j as (select *, min(t) over (partition by client_id, run order by t range between 3600000001 following and unbounded following) as jump from r),
s(client_id, run, t, jump) as (
  select client_id, run, t, jump from j where brk
  union all
  select j.client_id, j.run, j.t, j.jump from s join (select client_id, run, t, min(jump) as jump from j group by all) j on j.client_id = s.client_id and j.run = s.run and j.t = s.jump),
b as (select client_id, run, t, (select min(click_id) from j where j.client_id = s.client_id and j.run = s.run and j.t = s.t) as click_id from s),
o as (select *, lead(t) over (partition by client_id order by t, click_id) as until_t, lead(click_id) over (partition by client_id order by t, click_id) as until_id from b),
k as (select o.client_id, o.click_id as session_id, o.t as start_us, o.until_t, r.* exclude (client_id) from o join r on r.client_id = o.client_id and r.run = o.run
  and (r.t, r.click_id) >= (o.t, o.click_id) and (o.until_t is null or (r.t, r.click_id) < (o.until_t, o.until_id))),
g as (select client_id, session_id, start_us, any_value(until_t) as until_t, max(t) as end_us, count(*) as n_clicks, sum(cents)::bigint as value_cents,
  arg_max(case when final then 'end' when next_t is null then 'none' when next_t - t >= 900000000 then 'gap' else 'length' end, (t, click_id)) as closed_by,
  sha256(string_agg(click_id::varchar, ',' order by t, click_id)) as path_sha256 from k group by all),
l as (select g.client_id, g.session_id, count(*) as n_late from g join c on c.late and c.client_id = g.client_id and c.t >= g.start_us and (g.until_t is null or c.t < g.until_t) group by all)
select client_id, session_id, start_us, end_us, n_clicks, coalesce(n_late, 0) as n_late, value_cents, closed_by, path_sha256 from g left join l using (client_id, session_id)
"""
}
