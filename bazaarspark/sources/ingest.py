"""Imports of user sheets, and the audit of what they drop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarspark.sources.json_lists import read_json_list


def import_users(sheets: list[DataFrame], mapping: dict[str, str], key: str = "customer_code", order: str = "row_order") -> DataFrame:
    """Sheets one after the other under new column names, as text; the first row of each key stays.

    Sheets are in the order of the list and rows in the order of ``order``. A sheet without a mapped column is an error. All
    rows with a null key are one key, as in the order given.
    """
    renamed = []
    for i, sheet in enumerate(sheets):
        if missing := sorted(set(mapping) - set(sheet.columns)):
            raise ValueError(f"sheet {i} lacks columns: {missing}")
        renamed.append(sheet.select(*[F.col(a).cast("string").alias(b) for a, b in mapping.items()], F.lit(i).alias("_sheet"), F.col(order).alias("_row")))
    rows = reduce(DataFrame.unionByName, renamed)
    first = Window.partitionBy(key).orderBy("_sheet", "_row", *[c for c in mapping.values() if c != key])
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth", "_sheet", "_row")


def import_audit(sheets: list[DataFrame], imported: DataFrame) -> DataFrame:
    """One row: rows read, kept and removed."""
    before = reduce(DataFrame.unionByName, [s.select(F.lit(1).alias("x")) for s in sheets]).agg(F.count("*").alias("rows_read"))
    return before.crossJoin(imported.agg(F.count("*").alias("rows_kept"))).withColumn("rows_removed", F.col("rows_read") - F.col("rows_kept"))


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lists of cases, with a fixed schema; anything but a list is an error. One file is read by many tasks."""
    return read_json_list(spark, path, schema)


def parse_labels(df: DataFrame, col: str, signed: bool = True) -> DataFrame:
    """Identifier lists in text: split at commas, semicolons and white space (unsigned: at commas only); others left out."""
    parts = F.split(F.coalesce(F.col(col), F.lit("")), r"[,;\s]+" if signed else r"\s*,\s*")
    pattern = r"^-?[0-9]+\z" if signed else r"^[0-9]+\z"
    return df.withColumn(col, F.transform(F.filter(parts, lambda x: F.trim(x).rlike(pattern)), lambda x: F.trim(x).cast("long")))


def lookup_by_codes(items: DataFrame, products: DataFrame, how: str = "left") -> DataFrame:
    """Items with the catalog's facts; unmatched items stay unless ``how`` is inner."""
    return items.join(products, "product_code", how)


def write_report(results: DataFrame, report: DataFrame, folder: str, passed: str = "passed") -> None:
    """Results, report and failed cases as JSON folders."""
    results.write.mode("overwrite").json(f"{folder}/results")
    report.write.mode("overwrite").json(f"{folder}/report")
    results.where(~F.coalesce(F.col(passed), F.lit(False))).write.mode("overwrite").json(f"{folder}/failed")
