"""Content-addressed samples: 16-bit form, digests, paths, writes without repeats, levels of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .versions import Files

#: Folders of the archive. Samples of a frame, and of a second.
FANS = 256
FRAME = 512
RATE = 16_000


def pcm16(samples: Column) -> Column:
    """Samples cut to ±1 as whole numbers of 16 bits, towards zero."""
    return F.transform(samples, lambda x: (F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * 32767).cast("int"))


def digest(numbers: Column) -> Column:
    return F.sha2(F.array_join(numbers.cast("array<string>"), ","), 256)


def path(digest: Column) -> Column:
    """Two characters of the digest as folder, then the digest."""
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), digest)


def new_blobs(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """blobs (digest, ...) that aren't stored yet, each digest once: what a write appends. Which of equal blobs is taken makes no difference."""
    return blobs.dropDuplicates(["digest"]).join(stored.select("digest"), "digest", "left_anti")


def append(blobs: DataFrame, folder: str) -> None:
    """Appends blobs that aren't stored yet to a table partitioned by the first two characters of the digest; each of its folders is written by as many tasks as there are for one in FANS. The digest table of a Store says what is
    stored where more than one appends: two that miss each other's blob here leave it twice, with equal content."""
    spark = blobs.sparkSession
    stored = spark.read.parquet(folder) if Files(spark).names(folder) else blobs.limit(0)
    rows = new_blobs(blobs, stored).withColumn("fan", F.substring("digest", 1, 2))
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // FANS)
    rows.repartition("fan", F.pmod(F.xxhash64("digest"), F.lit(salts))).write.mode("append").partitionBy("fan").parquet(folder)


def usage(spark: SparkSession, folder: str) -> DataFrame:
    """How many blobs a folder holds and their bytes."""
    return spark.read.parquet(folder).agg(F.count("*").alias("blobs"), F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0)).alias("bytes"))


def fetched(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """wanted (digest) with its blob's content and whether that still has this digest; null for blobs that aren't there. Dynamic pruning may leave out folders that no wanted digest is in."""
    blobs = spark.read.parquet(folder)
    rows = wanted.withColumn("fan", F.substring("digest", 1, 2)).join(blobs.select("fan", "digest", "content"), ["fan", "digest"], "left").drop("fan")
    return rows.withColumn("intact", F.sha2("content", 256) == F.col("digest"))


def located(samples: Column, offset: Column, length: Column) -> Column:
    """The samples of one utterance in its run's blob; fewer at the end."""
    return F.slice(samples, offset.cast("int") + 1, length.cast("int"))


def framed(blobs: DataFrame, samples: Column, size: int = FRAME) -> DataFrame:
    """One row for each frame of a recording of so many samples: its number and its samples, fewer in the last; an empty one has one frame of none."""
    last = F.greatest(F.ceil(samples / size), F.lit(1)) - 1
    each = blobs.withColumn("_n", samples).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return each.withColumn("bytes", F.least(F.lit(size).cast("long"), F.col("_n") - size * F.col("frame"))).drop("_n")


def bounded(frames: DataFrame, seconds: float, size: int = FRAME, rate: int = RATE) -> DataFrame:
    """Frames that begin before so many seconds."""
    return frames.where(F.col("frame") * size / float(rate) < seconds)


def published(events: DataFrame, most: int) -> DataFrame:
    """events (doc_id, body) as they are sent: bodies of more bytes than `most` are replaced by a stub that says how many there were."""
    size = F.octet_length("body")
    stub = F.concat(F.lit('{"doc_id":'), "doc_id", F.lit(',"oversize":'), size, F.lit("}"))
    return events.select("doc_id", size.cast("long").alias("bytes"), (size > most).alias("stub"), F.when(size > most, stub).otherwise(F.col("body")).alias("sent"))


def decibels(square: Column) -> Column:
    """Of a mean square; silence has minus infinity, where log10 alone gives null."""
    return F.when(square == 0, F.lit(float("-inf"))).otherwise(F.round(10 * F.log10(square), 6))


def block_levels(samples: DataFrame, by: str, size: int) -> DataFrame:
    """samples (by, n, value) in blocks of `size` by their number: root mean square in decibels; nulls don't count."""
    rows = samples.groupBy(by, F.floor(F.col("n") / size).alias("block"))
    return rows.agg(decibels(F.avg(F.col("value") * F.col("value"))).alias("db"), F.count("value").alias("n"))


def envelope(samples: DataFrame, by: str, half: int) -> DataFrame:
    """The level around each sample, `half` samples on either side."""
    w = W.partitionBy(by).orderBy("n").rowsBetween(-half, half)
    return samples.select(by, "n", decibels(F.avg(F.col("value") * F.col("value")).over(w)).alias("db"))
