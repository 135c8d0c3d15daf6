"""Joins to classes of which some may hold a third of all rows, and intervals in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Classes with more than this share of all rows are broadcast: there are at most twice its inverse, whatever the input.
SHARES = 1 << 14


def classed(rows: DataFrame, classes: DataFrame, by: list[str], most: int) -> DataFrame:
    """``rows`` joined to their classes. Classes of more than ``most`` rows are few and are broadcast, so that their rows stay
    where they are; no task of the join of the others holds more than ``most`` rows of one class."""
    large = F.broadcast(classes.where(F.col("n") > most))
    rest = rows.join(large.select(*by), by, "left_anti").join(classes.where(F.col("n") <= most), by)
    return rows.join(large, by).unionByName(rest).drop("n")


def merged(runs: DataFrame) -> DataFrame:
    """Runs of one document joined to intervals that don't touch, by a scan in the order of lines."""
    row = Window.partitionBy("id", "digest").orderBy("pos")
    reach = F.max(F.col("pos") + F.col("len")).over(row.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("opens", F.when(F.col("pos") <= reach, 0).otherwise(1))
    runs = runs.withColumn("island", F.sum("opens").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("id", "digest", "island").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("len")).alias("end"))
    return spans.groupBy("id", "digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
