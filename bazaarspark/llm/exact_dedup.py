"""Exact dedup: a tree merge of sorted digest runs. DataFrame functions only.

Each input partition makes one run: its documents' digests, sorted. A run keeps one entry for each digest, with the
identifier that stays and the number of documents. Runs are then merged in rounds: in round k, runs whose numbers
agree but for their lowest 3k bits meet (a binomial tree with eight ways at each node), are sorted by digest and
merged, keeping the best identifier at every level. A node of the tree is cut by the digest's first bytes, so that the
root is many tasks and not one. Since an entry stands for all copies in a run, a text that makes up a third of all
documents is one row for each run from the first level on. The outcome goes down the tree the same way, so that no
join has a key with more rows than one run holds.

An entry is identified by SHA-256 and verified by a second, independent 64-bit digest and the length: entries
that agree in one and not the others are never merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarspark.llm import scratch
from bazaarspark.llm.text import lower_az

ENTRY = ["digest", "check", "size"]
#: Each round merges 2 ** BITS runs into one.
BITS = 3


def _runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = lower_az(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    return rows.select("id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("check"), F.length("norm").alias("size"), F.spark_partition_id().alias("run")).sortWithinPartitions(*ENTRY)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per document: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z. A null text is an empty one. Of equal texts the row with the
    largest (``keep="smallest"``: smallest) identifier stays. Null identifiers lose against any other; a group of null
    identifiers only has a null ``keep_id`` and all its rows are kept, as nothing tells them apart. Rows repeated
    whole count in ``group_size`` and share one decision. Other columns are not read. An empty table gives an empty one.
    """
    best = F.max if keep == "largest" else F.min
    runs = scratch.written(_runs(docs, id_col, text_col), "digest-runs")
    count = (runs.agg(F.max("run")).first()[0] or 0) + 1
    level = runs.groupBy("run", *ENTRY).agg(best("id").alias("best"), F.count("*").alias("n"))
    levels, width = [level], 0
    while count > 1 << width:
        width += BITS
        node = F.shiftright("run", BITS)
        merged = level.select(node.alias("run"), F.substring("digest", 1, 2).alias("cut"), *ENTRY, "best", "n").repartition("run", "cut").sortWithinPartitions(*ENTRY)
        level = merged.groupBy("run", "cut", *ENTRY).agg(best("best").alias("best"), F.sum("n").alias("n")).drop("cut")
        levels.append(level)
    outcome = levels.pop().withColumnsRenamed({"run": "up", "best": "keep_id", "n": "group_size"})
    for below in reversed(levels):
        outcome = below.select("run", F.shiftright("run", BITS).alias("up"), *ENTRY).join(outcome, ["up", *ENTRY]).drop("up").withColumnRenamed("run", "up")
    return (
        runs.withColumnRenamed("run", "up")
        .join(outcome, ["up", *ENTRY])
        .select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )
