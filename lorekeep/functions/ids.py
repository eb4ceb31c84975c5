"""Sortable identifiers, logical clocks, digests of settings, spoken dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The digits of conv() and those of sortable ids, which leave out I, L, O and U.
_USUAL, _OWN = "ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHJKMNPQRSTVWXYZ"


def time_prefix(ms: Column) -> Column:
    """Milliseconds as ten digits to base 32, in an order that is that of time."""
    return F.translate(F.lpad(F.conv(ms.cast("string"), 10, 32), 10, "0"), _USUAL, _OWN)


def prefix_time(id: Column) -> Column:
    return F.conv(F.translate(F.substring(id, 1, 10), _OWN, _USUAL), 32, 10).cast("long")


def hybrid_clock(rows: DataFrame, device: str, ms: str, order: list[str]) -> DataFrame:
    """rows with (clock_ms, clock_n): time never runs back on a device, and ticks of one millisecond are counted from 0."""
    w = W.partitionBy(device).orderBy(*order)
    out = rows.withColumn("clock_ms", F.max(ms).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.withColumn("clock_n", F.row_number().over(W.partitionBy(device, "clock_ms").orderBy(*order)) - 1)


def settings_digest(settings: Column) -> Column:
    """sha256 of a map's entries as key=value lines in order of keys."""
    entries = F.array_sort(F.map_entries(settings))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\n"), 256)


def spoken_time(text: Column) -> Column:
    """A timestamp from '1:56 pm on 8 May, 2023'; null if it doesn't read so."""
    p = r"^\s*(\d{1,2}:\d{2})\s*([ap]m) on (\d{1,2}) (\w+), (\d{4})\s*$"
    parts = [F.regexp_extract(F.lower(text), p, k) for k in range(1, 6)]
    joined = F.concat_ws(" ", parts[0], F.upper(parts[1]), parts[2], F.initcap(parts[3]), parts[4])
    return F.try_to_timestamp(joined, F.lit("h:mm a d MMMM yyyy")).cast("timestamp_ntz")
