"""Ordered records: context windows, neighbourhoods, episodes, budgets, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW_MAX_GAP_S = 8.0
WINDOW_TARGET_WORDS = 40
WINDOW_MAX_OBS = 9
NEIGHBOUR_MAX_WORDS = 120
EPISODE_MAX_OBS = 80
EPISODE_MIN_WORDS = 25
EPISODE_MAX_WORDS = 400


def word_count(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(0)))


def centred_windows(obs: DataFrame, target: int = WINDOW_TARGET_WORDS, most: int = WINDOW_MAX_OBS, gap: float = WINDOW_MAX_GAP_S) -> DataFrame:
    """One window around each observation, grown left and right in turn within its session until it has `target` words or `most` rows.

    A side closes at the session's edge and at a silence longer than `gap`. Each row sees the `most` - 1 rows before and after it,
    and the growth is a fold over them, so a session is sorted once and nothing is joined. Rows of equal start go by id. A row
    without session stands alone.
    """
    near = most - 1
    order = W.partitionBy(F.coalesce(F.col("session").cast("string"), F.concat(F.lit("?"), "id"))).orderBy("started_at", "id")
    rows = obs.select("id", "session", "started_at", "ended_at", F.trim("text").alias("text"), word_count("text").alias("w"))
    rows = rows.withColumns({"gap_before": F.col("started_at") - F.lag("ended_at").over(order), "gap_after": F.lead("started_at").over(order) - F.col("ended_at")})
    side = lambda g: F.struct(F.col(g).alias("gap"), "w", "id", "started_at", "ended_at", "text")
    rows = rows.withColumns({
        "prev": F.reverse(F.collect_list(side("gap_after")).over(order.rowsBetween(-near, -1))),
        "next": F.collect_list(side("gap_before")).over(order.rowsBetween(1, near)),
    })
    grown = F.expr(f"""aggregate(sequence(0, {2 * most - 1}), struct(0 as l, 0 as r, w as words, true as lo, true as ro), (s, k) ->
      if(not (s.lo or s.ro) or s.words >= {target} or s.l + s.r + 1 >= {most}, s,
        if(k % 2 = 0,
          if(not s.lo, s, if(size(prev) > s.l and get(prev, s.l).gap <= {gap}D,
            struct(s.l + 1 as l, s.r as r, s.words + get(prev, s.l).w as words, s.lo as lo, s.ro as ro), struct(s.l as l, s.r as r, s.words as words, false as lo, s.ro as ro))),
          if(not s.ro, s, if(size(next) > s.r and get(next, s.r).gap <= {gap}D,
            struct(s.l as l, s.r + 1 as r, s.words + get(next, s.r).w as words, s.lo as lo, s.ro as ro), struct(s.l as l, s.r as r, s.words as words, s.lo as lo, false as ro))))))""")
    rows = rows.withColumn("g", grown)
    parts = "concat(reverse(slice(prev, 1, g.l)), array(struct(gap_before as gap, w, id, started_at, ended_at, text)), slice(next, 1, g.r))"
    rows = rows.withColumn("rows", F.expr(parts))
    text = F.array_join(F.transform("rows", lambda r: r["text"]), " ")
    return rows.select(
        "id", "session", F.col("rows")[0]["id"].alias("first_id"), F.element_at("rows", -1)["id"].alias("last_id"), F.size("rows").cast("long").alias("n_obs"),
        word_count(text).cast("long").alias("n_words"), F.col("rows")[0]["started_at"].alias("started_at"), F.element_at("rows", -1)["ended_at"].alias("ended_at"), text.alias("text"),
    )


def repaired_windows(windows: DataFrame, obs: DataFrame, gone: DataFrame, **settings) -> DataFrame:
    """Windows after the observations `gone` (id) were deleted: those of untouched sessions stay, sessions that lost a row are built anew."""
    hit = obs.join(gone.select("id"), "id", "left_semi").select("session").distinct()
    left = obs.join(gone.select("id"), "id", "left_anti")
    return windows.join(hit, "session", "left_anti").select(windows.columns).union(centred_windows(left.join(hit, "session", "left_semi"), **settings).select(windows.columns))


def neighbourhood(obs: DataFrame, gap: float = WINDOW_MAX_GAP_S, words: int = NEIGHBOUR_MAX_WORDS) -> DataFrame:
    """Each observation with the one before and the one after, if near enough and within the word budget, which the left side spends first."""
    order = W.partitionBy("session").orderBy("started_at", "id")
    rows = obs.withColumn("w", word_count("text"))
    side = lambda f: f(F.struct("id", "w", "started_at", "ended_at")).over(order)
    rows = rows.withColumns({"p": side(F.lag), "n": side(F.lead)})
    before, after = F.col("started_at") - F.col("p.ended_at"), F.col("n.started_at") - F.col("ended_at")
    left = F.coalesce((before <= gap) & (F.col("w") + F.col("p.w") <= words), F.lit(False))
    spent = F.col("w") + F.when(left, F.col("p.w")).otherwise(0)
    right = F.coalesce((after <= gap) & (spent + F.col("n.w") <= words), F.lit(False))
    return rows.select("id", F.when(left, F.col("p.id")).alias("prev_id"), F.when(right, F.col("n.id")).alias("next_id"), F.when(left, F.round(before, 3)).alias("gap_before"), F.when(right, F.round(after, 3)).alias("gap_after"))


def islands(rows: DataFrame, by: list[str], start: Column, name: str, order: list[str]) -> DataFrame:
    """rows with the running number, from 0, of the island that each lies in: a new one begins where `start` holds (null counts as no)."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_s", start).withColumn(name, F.sum(F.coalesce(F.col("_s").cast("int"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def episodes(rows: DataFrame, gap: float, by: list[str], most: int = EPISODE_MAX_OBS) -> DataFrame:
    """rows (started_at, ended_at, id) with their episode: broken by silences longer than `gap`, and after every `most` rows since the last break."""
    order = W.partitionBy(*by).orderBy("started_at", "id")
    broken = F.col("started_at") - F.lag("ended_at").over(order) > gap
    runs = islands(rows.withColumn("_b", broken), by, F.col("_b"), "run", ["started_at", "id"]).drop("_b")
    place = F.row_number().over(W.partitionBy(*by, "run").orderBy("started_at", "id"))
    return runs.withColumn("part", F.floor((place - 1) / most))


def prefix_within(rows: DataFrame, by: list[str], order: list, cost: Column, budget: int) -> DataFrame:
    """The rows from the first on while their summed cost is within the budget; all after the first overflow go."""
    w = W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order)
    return rows.withColumn("_c", F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("_c") <= budget).drop("_c")


def runs_below(frames: DataFrame, by: list[str], level: Column, least: float) -> DataFrame:
    """Runs of successive frames (t) for which `level` holds that last `least` or more: by, t0, t1, n."""
    w = W.partitionBy(*by).orderBy("t", "id")
    rows = frames.withColumn("_l", F.coalesce(level, F.lit(False)))
    rows = islands(rows.withColumn("_c", F.col("_l") != F.lag("_l").over(w)), by, F.col("_c"), "_i", ["t", "id"])
    return rows.where("_l").groupBy(*by, "_i").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n")).where(F.col("t1") - F.col("t0") >= least).drop("_i")


def complement(runs: DataFrame, by: list[str], bounds: DataFrame, least: float) -> DataFrame:
    """What runs (t0, t1) leave of bounds (lo, hi), pieces of `least` or more."""
    w = W.partitionBy(*by).orderBy("t0")
    inner = runs.join(bounds, by).withColumn("p", F.coalesce(F.lag("t1").over(w), F.col("lo"))).select(*by, F.col("p").alias("s"), F.col("t0").alias("e"))
    tail = bounds.join(runs.groupBy(*by).agg(F.max("t1").alias("m")), by, "left").select(*by, F.coalesce("m", "lo").alias("s"), F.col("hi").alias("e"))
    return inner.union(tail).where(F.col("e") - F.col("s") >= least)


def sliding(regions: DataFrame, by: list[str], size: float, hop: float) -> DataFrame:
    """Windows of `size` every `hop` inside regions (s, e), and a last one that ends with the region where they leave a rest; short regions give themselves."""
    n = F.floor((F.col("e") - F.col("s") - size) / hop)
    rows = regions.withColumn("n", n)
    inside = rows.where("n >= 0").select(*by, "s", "e", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("k"))
    inside = inside.select(*by, (F.col("s") + F.col("k") * hop).alias("a"), (F.col("s") + F.col("k") * hop + size).alias("b"))
    tail = rows.where((F.col("n") >= 0) & (F.col("e") - (F.col("s") + F.col("n") * hop + size) > 1e-6)).select(*by, (F.col("e") - size).alias("a"), F.col("e").alias("b"))
    short = rows.where("n < 0").select(*by, F.col("s").alias("a"), F.col("e").alias("b"))
    return inside.union(tail).union(short)


def merged_segments(spans: DataFrame, by: list[str], touch: float) -> DataFrame:
    """Successive spans (a, b) of one label that lie at most `touch` apart, as one."""
    w = W.partitionBy(*by).orderBy("a", "id")
    rows = islands(spans.withColumn("_n", (F.lag("label").over(w) != F.col("label")) | (F.col("a") - F.lag("b").over(w) > touch)), by, F.col("_n"), "_i", ["a", "id"])
    return rows.groupBy(*by, "_i").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("label").alias("label"), F.count("*").alias("n")).drop("_i")


def overlaps(left: DataFrame, right: DataFrame, by: list[str], width: float) -> DataFrame:
    """Pairs of intervals (a, b) and (c, d) of one key that overlap, with the seconds they share.

    An equi-join on buckets of `width`, in each of which an interval is listed that touches it; a pair is kept in the bucket
    where the later of both begins, so it comes once. Intervals far longer than width cost a row for each bucket.
    """
    listed = lambda x, s, e: x.withColumn("_k", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    pairs = listed(left, "a", "b").join(listed(right, "c", "d"), [*by, "_k"]).where("b > c and a < d")
    pairs = pairs.where(F.col("_k") == F.floor(F.greatest("a", "c") / width))
    return pairs.withColumn("overlap", F.least("b", "d") - F.greatest("a", "c")).drop("_k")


def pending(markers: DataFrame, by: str, today, most: int) -> DataFrame:
    """(by, day, skipped): days after each marker up to yesterday, the last `most` of them, and how many older ones that leaves out. Without a marker yesterday alone."""
    last = F.date_sub(F.lit(today), 1)
    first = F.coalesce(F.date_add("marker", 1), last)
    rows = markers.select(by, first.alias("first"), last.alias("last")).where("first <= last")
    rows = rows.withColumn("skipped", F.greatest(F.datediff("last", "first") + 1 - most, F.lit(0)))
    return rows.select(by, F.explode(F.expr("sequence(date_add(first, skipped), last)")).alias("day"), "skipped")
