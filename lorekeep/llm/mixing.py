"""Poisson replication: each document is repeated by a hash-seeded Poisson count whose mean is its source's target rate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_enough, written

SEED = 7
#: Without given weights a source weighs the square root of its rows, which lifts small sources and lowers the hot one.
FLATTEN = 0.5
_UNIT = float(1 << 52)


def _draw(*parts: Column) -> Column:
    """52 bits of md5 over the parts joined by ':' (null as empty), as long; the same in any SQL engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _cdf(rate: Column) -> Column:
    """Cumulative probabilities for 0, 1, ... of a Poisson distribution, far into its tail; summed by logarithms, so that no rate underflows."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    first = F.exp(-rate)
    zero = F.struct((-rate).alias("logp"), first.alias("c"), F.array(first).alias("all"))

    def step(s: Column, k: Column) -> Column:
        logp = s["logp"] + F.log(rate / k)
        c = s["c"] + F.exp(logp)
        return F.struct(logp.alias("logp"), c.alias("c"), F.concat(s["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step)["all"]


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, expected_rows: float | None = None) -> DataFrame:
    """(source, n_rows, rate, cdf): rate is the mean number of copies that brings each source to its share of expected_rows.

    weights: by source, others 0; without it rows ** FLATTEN. expected_rows: by default as many as there are. A null source is
    a source of its own. Weights must not be negative.
    """
    per = docs.groupBy("source").agg(F.count("*").alias("n_rows"))
    if weights is None:
        weight = F.pow(F.col("n_rows").cast("double"), F.lit(FLATTEN))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights can't be negative")
        weight = F.lit(0.0)
        for k, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(weight)
    per = written(per.withColumn("weight", weight), "mix-sources")
    rows, total = per.agg(F.sum("n_rows"), F.sum("weight")).first()
    want = float(rows or 0) if expected_rows is None else float(expected_rows)
    rate = F.lit(want) * F.col("weight") / F.lit(float(total or 1.0)) / F.col("n_rows")
    per = per.select("source", "n_rows", rate.alias("rate"))
    return per.withColumn("cdf", F.when(F.col("rate") > 0, _cdf(F.col("rate"))).otherwise(F.array(F.lit(1.0))))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with their rate, each row once for each of its n_copies, with copy_no from 1 and the place key mix_key.

    n_copies is the inverted distribution at a uniform hash of doc_id: retries and lost executors give the same copies. Rows
    with the same doc_id have the same count, null doc_ids too; columns named like the added ones are replaced. The rates,
    one row a source, are broadcast behind a size check.
    """
    added = ("rate", "n_copies", "copy_no", "mix_key")
    docs = docs.select(*[c for c in docs.columns if c not in added])
    rates = written(rates.select(F.col("source").alias("_mix_source"), "rate", F.col("cdf").alias("_mix_cdf")), "mix-rates")
    rows, entries = rates.agg(F.count("*"), F.sum(F.size("_mix_cdf"))).first()
    if small_enough(rows * 64 + (entries or 0) * 8, 1):
        rates = F.broadcast(rates)
    u = _draw(F.lit(seed), F.col("doc_id")) / F.lit(_UNIT)
    joined = docs.join(rates, docs["source"].eqNullSafe(rates["_mix_source"])).drop("_mix_source")
    copies = F.size(F.filter("_mix_cdf", lambda c: c <= u)).cast("int")
    out = joined.withColumn("n_copies", copies).drop("_mix_cdf").where("n_copies > 0")
    out = out.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    return out.withColumn("mix_key", _draw(F.lit(seed), F.col("doc_id"), F.col("copy_no")))


def shuffled(rows: DataFrame) -> DataFrame:
    """rows in global random order: every row goes to the partition and place that its mix_key decides, without a sampling pass."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "mix_key").sortWithinPartitions("mix_key", "doc_id")


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, expected_rows: float | None = None, seed: int = SEED) -> DataFrame:
    """The mixed corpus: docs by source_rates(), replicate() and shuffled(). An empty table gives no rows."""
    return shuffled(replicate(docs, source_rates(docs, weights, expected_rows), seed))


def mix_table(docs: DataFrame) -> DataFrame:
    """One row for each copy: doc_id, source, rate (to 9 places), n_copies, copy_no, mix_key."""
    out = mix(docs.select("doc_id", "source"))
    return out.select("doc_id", "source", F.round("rate", 9).alias("rate"), "n_copies", "copy_no", "mix_key")


#: DuckDB's way to the same rows. {docs}: the table.
MIX_SQL = """
with per as (select source, count(*) as n_rows, sqrt(count(*)) as weight from {docs} group by source),
tot as (select sum(n_rows) as n, sum(weight) as w from per),
rates as (select source, n * weight / w / n_rows as rate from per, tot),
ks as (select unnest(generate_series(0, 200)) as k),
pmf as (select source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) as p from rates, ks where k <= ceil(rate + 12 * sqrt(rate) + 24)),
cdf as (select source, rate, k, sum(p) over (partition by source order by k) as c from pmf),
d as (select *, cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) / 4503599627370496.0 as u from {docs}),
counted as (select d.*, r.rate, (select count(*) from cdf where cdf.source is not distinct from d.source and cdf.c <= d.u) as n_copies from d join rates r on d.source is not distinct from r.source),
copies as (select *, unnest(generate_series(1, n_copies)) as copy_no from counted where n_copies > 0)
"""
MIX_ORACLE = MIX_SQL.replace("{docs}", "documents") + """
select doc_id, source, round(rate, 9) as rate, cast(n_copies as integer) as n_copies, cast(copy_no as integer) as copy_no,
  cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '') || ':' || copy_no), 1, 13) as bigint) as mix_key
from copies
"""


def stage(docs: DataFrame) -> DataFrame:
    """The mixed corpus with the columns of docs, in shuffled order.

    Columns named like those of replicate() pass through unchanged. Null doc_ids and sources are values like others, texts aren't
    looked at, repeated rows have equal counts, and an empty table stays empty.
    """
    own = {c: c if c in ("doc_id", "source") else f"_own_{k}" for k, c in enumerate(docs.columns)}
    mixed = mix(docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()]))
    return mixed.select(*[F.col(name).alias(c) for c, name in own.items()])
