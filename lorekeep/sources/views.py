"""Views that map the test tables to records; each has its DuckDB twin, a common table expression of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(col: str) -> str:
    """Seconds of a timestamp without zone, as double, whatever the session's zone."""
    return f"(datediff(to_date({col}), date'1970-01-01') * 86400.0D + hour({col}) * 3600 + minute({col}) * 60 + extract(second from {col}))"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as observations of one second; silences between them are 10, 5 and 0 seconds in turn."""
    return table(spark, sf_dir, "conversations").select(
        F.expr("concat(lpad(conv_id, 8, '0'), '-', lpad(turn, 4, '0'))").alias("id"),
        F.expr("case role when 'user' then 'speech' when 'assistant' then 'answer' else 'system' end").alias("kind"),
        F.col("conv_id").alias("session"),
        "turn",
        F.expr("cast(conv_id * 100000 + 6 * turn + 5 * (turn * turn % 3) as double)").alias("started_at"),
        F.expr("cast(conv_id * 100000 + 6 * turn + 5 * (turn * turn % 3) + 1 as double)").alias("ended_at"),
        F.col("role").alias("person"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


OBSERVATIONS = """obs as (select printf('%08d-%04d', conv_id, turn) as id, case role when 'user' then 'speech' when 'assistant' then 'answer' else 'system' end as kind,
  conv_id as session, turn, cast(conv_id * 100000 + 6 * turn + 5 * (turn * turn % 3) as double) as started_at, cast(conv_id * 100000 + 6 * turn + 5 * (turn * turn % 3) + 1 as double) as ended_at,
  role as person, coalesce(text, '') as text from conversations)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measured words: their user speaks, a day of a user is a sentence, value gives loudness, duration and pitch (missing below 5)."""
    at = epoch("ts")
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "user_id as speaker", "to_date(ts) as sentence", f"{at} as end", "event_type as kind", "value",
        "40 + 10 * ln(1 + value) as loud", "0.05 + value / 500 as dur", "case when value >= 5 then 80 + 40 * ln(value) end as pitch", "value < 1 or value > 300 as suspect",
    )
    return rows


WORDS = """words as (select event_id as id, user_id as speaker, cast(ts as date) as sentence, epoch(ts) as "end", event_type as kind, value,
  40 + 10 * ln(1 + value) as loud, 0.05 + value / 500 as dur, case when value >= 5 then 80 + 40 * ln(value) end as pitch, (value < 1 or value > 300) as suspect from events)"""


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as beliefs: a customer's next order replaces the one before. Ten days of orders are one of beliefs, so that decay is seen on all of them."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "o_custkey as owner", "o_orderpriority as about", "o_orderstatus as author",
        "least(1.0D, o_totalprice / 500000) as certainty", "1.0D + o_orderkey % 5 as weight", f"{epoch('o_orderdate')} / 10 as formed_at",
    )


BELIEFS = """beliefs as (select o_orderkey as id, o_custkey as owner, o_orderpriority as about, o_orderstatus as author,
  least(cast(1 as double), o_totalprice / 500000) as certainty, 1.0 + o_orderkey % 5 as weight, epoch(o_orderdate) / 10 as formed_at from orders)"""


def replaces(beliefs: DataFrame) -> DataFrame:
    """(src_id, dst_id): src replaces dst, its owner's belief before it by (formed_at, id)."""
    return beliefs.selectExpr("id as src_id", "lag(id) over (partition by owner order by formed_at, id) as dst_id").where("dst_id is not null")


REPLACES = """replaces as (select id as src_id, prev as dst_id from (select id, lag(id) over (partition by owner order by formed_at, id) as prev from beliefs) where prev is not null)"""



def newest(beliefs: DataFrame) -> float:
    """The moment that counts as now: when the newest belief was formed."""
    return beliefs.agg(F.max("formed_at")).first()[0] or 0.0


NEWEST = "(select max(formed_at) from beliefs)"
