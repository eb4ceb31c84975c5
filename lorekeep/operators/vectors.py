"""Exact vector search, fusion of two indexes, people by voice."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import with_checkpoints

WINDOW_WEIGHT = 0.75
OVERSAMPLE = 3
QUESTION_PENALTY = 0.15
MATCH_MAX = 0.70
CONFIDENT_MAX = 0.40
MARGIN_MIN = 0.10
#: Prints of all enrolled people, which are broadcast: 50 MB at 64 dimensions.
MOST_PRINTS = 100_000


def dot(a: Column, b: Column) -> Column:
    """The dot product in double, in the arrays' order; null for arrays of different length or null elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector at unit length. The norm is bound once a row; in the lambda it would be computed for every element."""
    held = F.array(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("n")))
    return F.get(F.transform(held, lambda s: F.transform(s["v"], lambda x: x / s["n"])), F.lit(0))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def vector_of(vectors: DataFrame, key: str, value: int) -> list[float]:
    """One stored vector, for use as a query; the only row that reaches the driver."""
    row = vectors.where(F.col(key) == value).select("embedding").first()
    return list(row[0]) if row and row[0] is not None else []


def top_k(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id") -> DataFrame:
    """The k nearest by cosine of unit vectors: one scan and a bounded sort in each task. Similarities count to six places, ties go by key."""
    return vectors.select(key, F.round(dot(F.col("embedding"), literal(query)), 6).alias("sim")).orderBy(F.desc("sim"), key).limit(k)


#: Vectors that are held in a task against all that are asked for, and similarities that it has at once.
SEARCH_BLOCK, AT_ONCE = 1 << 14, 1 << 22


def _nearest(rows: pd.DataFrame, asked: pd.DataFrame, k: int, key: str) -> pd.DataFrame:
    """(caller, key, sim) of all rows that can be among the k nearest of these, sim summed in the arrays' order as dot() does."""
    if not len(rows) or not len(asked):  # a side without rows has no columns either
        return pd.DataFrame({"caller": [], key: [], "sim": []})
    (v, n), (q, m) = _matrix(rows["embedding"]), _matrix(asked["q"])
    width = max(v.shape[1], q.shape[1])
    v, q = (np.pad(w, ((0, 0), (0, width - w.shape[1]))) for w in (v, q))
    at, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in range(0, len(q), max(1, AT_ONCE // max(len(v), 1))):
        part = slice(b, b + max(1, AT_ONCE // max(len(v), 1)))
        s = q[part] @ v.T
        s[(m[part, None] != n) | np.isnan(s)] = -np.inf
        least = np.partition(s, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(s), -np.inf)
        # similarities count to six places, so what is less by no more may come first
        w, r = np.nonzero(np.isfinite(s) & (s >= least[:, None] - 2e-6))
        at.append(r)
        who.append(w + b)
    at, who = np.concatenate(at), np.concatenate(who)
    sim = np.zeros(len(at))
    for d in range(width):
        sim = sim + v[at, d] * q[who, d]
    return pd.DataFrame({"caller": asked["caller"].to_numpy()[who], key: rows[key].to_numpy()[at], "sim": sim})


def top_k_each(vectors: DataFrame, asked: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(caller, vec_id, sim, place) of the k nearest to each vector asked for (caller, embedding), held against all rows.

    Blocks of rows meet all that is asked for, by matrix products; each gives the k best of its rows for each caller, and those that rounding may put among
    them, so the shuffle moves no more than that from any task. Vectors that are null or of another length are near to none.
    """
    blocks = max(1, -(-vectors.count() // SEARCH_BLOCK))
    rows = vectors.select(key, "embedding", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    each = asked.select("caller", F.col("embedding").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    schema = f"caller {dict(asked.dtypes)['caller']}, {key} {dict(vectors.dtypes)[key]}, sim double"
    near = rows.groupBy("block").cogroup(each.groupBy("block")).applyInPandas(lambda a, b: _nearest(a, b, k, key), schema)
    scored = near.withColumn("sim", F.round("sim", 6))
    return scored.withColumn("place", F.row_number().over(W.partitionBy("caller").orderBy(F.desc("sim"), key)).cast("long")).where(F.col("place") <= k)


def neighbour_mean(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): each vector averaged with those before and after it by id, to unit length. Two equi-joins, no global order."""
    near = [vectors.select((F.col("vec_id") + d).alias("vec_id"), F.col("embedding").alias(n)) for d, n in ((1, "_prev"), (-1, "_next"))]
    v = vectors.join(near[0], "vec_id", "left").join(near[1], "vec_id", "left")
    add = lambda a, b: F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    total = add(add(F.transform("embedding", lambda x: x.cast("double")), F.col("_prev")), F.col("_next"))
    v = v.select("vec_id", total.alias("t"))
    return v.select("vec_id", unit(F.col("t")).alias("embedding"))


def hybrid(windows: DataFrame, own: DataFrame, questions: DataFrame, query: Sequence[float], limit: int, asked: bool) -> DataFrame:
    """Fusion of two indexes (vec_id, embedding): the best OVERSAMPLE * limit of each, missing similarities filled, questions marked down for a question.

    questions: (vec_id, is_question). Candidates number 6 * limit at most, so they are broadcast to the scans that fill gaps.
    """
    k = OVERSAMPLE * limit
    ids = F.broadcast(top_k(windows, query, k).select("vec_id").union(top_k(own, query, k).select("vec_id")).distinct())
    sim = lambda x, n: x.join(ids, "vec_id", "left_semi").select("vec_id", F.round(dot(F.col("embedding"), literal(query)), 6).alias(n))
    both = sim(windows, "win").join(sim(own, "obs"), "vec_id", "full_outer").join(questions, "vec_id", "left")
    raw = WINDOW_WEIGHT * F.coalesce("win", F.lit(0.0)) + (1 - WINDOW_WEIGHT) * F.coalesce("obs", F.lit(0.0))
    mark = F.when(F.lit(asked) & F.coalesce("is_question", F.lit(False)), 1 - QUESTION_PENALTY).otherwise(1.0)
    return both.select("vec_id", "win", "obs", F.round(raw * mark, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(limit)


def belief_search(beliefs: DataFrame, superseded: DataFrame, query: Sequence[float], limit: int, post_filter: bool) -> DataFrame:
    """Beliefs (id, embedding, weight_now) by sim * (0.5 + min(weight, 1) / 2). Superseded ones go before the cut, or after it with post_filter, then fewer come back."""
    scored = beliefs.select("id", "weight_now", F.round(dot(F.col("embedding"), literal(query)), 6).alias("sim"))
    live = lambda x: x.join(superseded.select("id"), "id", "left_anti")
    best = lambda x: x.orderBy(F.desc("sim"), "id").limit(limit)
    kept = live(best(scored)) if post_filter else best(live(scored))
    score = F.round(F.col("sim") * (0.5 + F.least("weight_now", F.lit(1.0)) / 2), 6)
    return kept.select("id", "sim", score.alias("score")).orderBy(F.desc("score"), "id")


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """The unit mean vector of each label; averages are combined by dimension before the shuffle."""
    mean = vectors.select(label, F.posexplode("embedding")).groupBy(label, "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    v = mean.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("p")).select(label, F.col("p.m").alias("v"))
    return v.select(label, F.transform(unit(F.col("v")), lambda x: F.round(x, 6)).alias("centroid"))


def match_people(probes: DataFrame, prints: DataFrame) -> DataFrame:
    """For each probe (vec_id, embedding) the nearest person of prints (person, embedding): distance, margin to the next person, decision, confidence.

    prints is the enrolled set, a few vectors a person, which is checked to be MOST_PRINTS at most; it is broadcast and every probe is held against all of it.
    """
    if prints.limit(MOST_PRINTS + 1).count() > MOST_PRINTS:
        raise ValueError(f"more than {MOST_PRINTS} prints are enrolled")
    pairs = probes.crossJoin(F.broadcast(prints.select("person", F.col("embedding").alias("p"))))
    each = pairs.select("vec_id", "person", F.round(1 - dot(F.col("embedding"), F.col("p")), 6).alias("d")).groupBy("vec_id", "person").agg(F.min("d").alias("d"))
    two = each.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "person"))), 1, 2).alias("t"))
    d, second = F.col("t")[0]["d"], F.get("t", F.lit(1))["d"]
    margin = F.round(second - d, 6)
    rows = two.select("vec_id", F.col("t")[0]["person"].alias("person"), d.alias("distance"), margin.alias("margin"))
    decided = F.when((F.col("distance") <= CONFIDENT_MAX) & (F.coalesce("margin", F.lit(9.0)) >= MARGIN_MIN), "confident").when(F.col("distance") <= MATCH_MAX, "match").otherwise("unknown")
    near = F.least(F.greatest((MATCH_MAX - F.col("distance")) / 0.30, F.lit(0.0)), F.lit(1.0))
    apart = F.least(F.greatest(F.coalesce("margin", F.lit(9.0)) / 0.20, F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("decision", decided)
    return rows.withColumn("confidence", F.when(F.col("decision") == "unknown", 0.0).otherwise(F.round(near * apart, 6)))


#: Vectors of a label in a block, of which every two meet in a task; steps of distance that are counted before single distances are fetched, to one.
PAIR_BLOCK, STEPS = 4096, 16_384
QUANTILES = (0.1, 0.5, 0.9)


def _matrix(arrays: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double with their lengths, shorter ones filled up; null ones and null elements are not numbers."""
    rows = [np.full(1, np.nan) if x is None else np.array(x, np.float64) for x in arrays]
    size = np.array([len(x) for x in rows], np.int64)
    out = np.zeros((len(rows), size.max(initial=0)))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out, size


def _distances(pdf: pd.DataFrame, a: int, b: int) -> Iterator[np.ndarray]:
    """The distances of all pairs of one row of block a and one of block b, in strips; not numbers where there is none."""
    x, y = pdf[pdf["block"] == a], pdf[pdf["block"] == b]
    (u, n), (v, m) = _matrix(x["embedding"]), _matrix(y["embedding"])
    width = max(u.shape[1], v.shape[1])
    u, v = (np.pad(w, ((0, 0), (0, width - w.shape[1]))) for w in (u, v))
    i, j = x["id"].to_numpy(), y["id"].to_numpy()
    for k in range(0, len(u), 256):
        at = slice(k, k + 256)
        pairs = i[at, None] < j if a == b else np.broadcast_to(True, (len(i[at]), len(j)))
        d = 1 - u[at] @ v.T
        d[n[at, None] != m] = np.nan
        yield d[pairs]


def pair_distances(vectors: DataFrame) -> DataFrame:
    """Percentiles of the distances of all pairs within a label, exact: every two blocks of its vectors meet in a task.

    Tasks first count distances in STEPS steps to one, which tells in which steps the percentiles lie, then give the distances of those steps alone, equal ones once with their
    number. So no pair is ever a row, though every one is measured, twice.
    """
    rows = vectors.where("label is not null").select("label", F.col("vec_id").alias("id"), "embedding")
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("blocks"))
    blocks = rows.join(sizes, "label").select("label", "id", "embedding", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = blocks.withColumn("other", other).select("label", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "id", "embedding")
    kind = dict(rows.dtypes)["label"]

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        label, a, b = key
        steps, pairs, far, known = Counter(), 0, 0, 0
        for d in _distances(pdf, a, b):
            pairs += len(d)
            d = d[~np.isnan(d)]
            known, far = known + len(d), far + int((d > 0.9).sum())
            steps.update(dict(zip(*(x.tolist() for x in np.unique(np.floor(d * STEPS).astype(np.int64), return_counts=True)), strict=True)))
        out = [(label, s, n, 0, 0, 0) for s, n in steps.items()] + [(label, None, 0, pairs, far, known)]
        return pd.DataFrame(out, columns=["label", "step", "n", "pairs", "far", "known"]).astype({"step": "Int64"})

    counted = cells.groupBy("label", "a", "b").applyInPandas(count, f"label {kind}, step long, n long, pairs long, far long, known long")
    with_checkpoints(vectors.sparkSession)
    counted = counted.groupBy("label", "step").agg(*[F.sum(c).alias(c) for c in ("n", "pairs", "far", "known")]).checkpoint()
    total = counted.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("pairs", "far", "known")]).where("pairs > 0")
    place = lambda p: p * (F.col("known") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in QUANTILES])))
    wanted = total.where("known > 0").select("label", F.explode(ranks).alias("rank"))
    before = lambda *by: F.coalesce(F.sum("n").over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = counted.where("step is not null").select("label", "step", "n", before("label", "step").alias("before"))  # a label's steps, three times STEPS at most for unit vectors
    there = wanted.join(steps, "label").where("rank >= before and rank < before + n").select("label", "rank", "step", "before")
    sought = there.groupBy("label").agg(F.collect_set("step").alias("steps"))  # six at most

    def fetch(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        label, a, b = key
        steps = np.array(pdf["steps"].iloc[0])
        got = [np.unique(d[np.isin(np.floor(d * STEPS), steps)], return_counts=True) for d in _distances(pdf, a, b)]
        d, n = (np.concatenate(c) for c in zip(*got, strict=True))
        return pd.DataFrame({"label": [label] * len(d), "step": np.floor(d * STEPS).astype(np.int64), "d": d, "n": n})

    fetched = cells.join(F.broadcast(sought), "label").groupBy("label", "a", "b").applyInPandas(fetch, f"label {kind}, step long, d double, n long")
    single = fetched.groupBy("label", "step", "d").agg(F.sum("n").alias("n")).select("label", "step", "d", "n", before("label", "step", "d").alias("within"))
    exact = there.join(single, ["label", "step"]).where("rank >= before + within and rank < before + within + n").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("rank", "d"))).alias("at"))

    def q(p: float) -> Column:
        lo, hi = F.floor(place(p)), F.ceil(place(p))
        low, high = F.element_at("at", lo), F.element_at("at", hi)
        return F.round(low + (place(p) - lo) * (high - low), 6)

    t = total.join(exact, "label", "left")
    return t.select("label", "pairs", *[q(p).alias(f"p{int(p * 100)}") for p in QUANTILES], F.round(F.col("far") / F.nullif("known", F.lit(0)), 6).alias("far_share"))


def same_label_smoothed(labels: DataFrame, order: str = "pos", by: str = "run") -> DataFrame:
    """A width-3 majority filter: the label of any two that agree, else the least; the ends of a run stay."""
    w = W.partitionBy(by).orderBy(order)
    rows = labels.withColumns({"_p": F.lag("label").over(w), "_n": F.lead("label").over(w)})
    x, p, n = F.col("label"), F.col("_p"), F.col("_n")
    out = F.when(p.isNull() | n.isNull(), x).when((p == x) | (x == n), x).when(p == n, p).otherwise(F.least(p, x, n))
    return rows.withColumn("smooth", out).drop("_p", "_n")
