"""Enrolled people: their prints in a JSON file with the setup they were made under."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import settings_digest

SCHEMA = "pid string, name string, anchor array<array<double>>, learned array<array<double>>, setup string"


def _setup(spark: SparkSession, settings: dict[str, str]) -> str:
    pairs = F.create_map(*[x for k, v in settings.items() for x in (F.lit(k), F.lit(v))])
    return spark.range(1).select(settings_digest(pairs).alias("d")).first()["d"]


def save(people: DataFrame, path: str, settings: dict[str, str]) -> None:
    """people (pid, name, anchor, learned) as lines of JSON, each with the digest of the setup."""
    people.withColumn("setup", F.lit(_setup(people.sparkSession, settings))).write.json(path)


def load(spark: SparkSession, path: str, settings: dict[str, str] | None = None) -> DataFrame:
    """The people of a file; with settings, refused where any was made under others, as their distances mean nothing together."""
    people = spark.read.schema(SCHEMA).json(path)
    if settings is not None:
        own = _setup(spark, settings)
        if not people.where(F.coalesce(F.col("setup") != own, F.lit(True))).isEmpty():
            raise ValueError("these prints were made under another setup")
    return people


def vectors(people: DataFrame) -> DataFrame:
    """(pid, kind, at, vector): the anchor's and the learned prints, numbered within their kind."""
    each = lambda kind: people.select("pid", F.lit(kind).alias("kind"), F.posexplode(kind).alias("at", "vector"))
    return each("anchor").union(each("learned"))


def found(asked: DataFrame, people: DataFrame) -> DataFrame:
    """asked (said) with the person whose name or id it is, letter case aside; of several the least id."""
    names = people.select("pid", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("pid")))).alias("_said")).groupBy("_said").agg(F.min("pid").alias("pid"))
    return asked.join(names, F.lower("said") == F.col("_said"), "left").drop("_said")
