"""Written intermediate tables in the folder that the cluster shares.

Cutting lineage by a written table (and never by a local checkpoint) lets a job go on when executors are lost:
the table is in the folder named by ``spark.checkpoint.dir``, which every executor sees.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a folder in the warehouse, on a local master only: elsewhere
    executors might not share that."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return base.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder there, which is deleted when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    return path


#: Shuffle files of a write are deleted as soon as it is done, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and its shuffle files go."""
    spark = df.sparkSession
    path = folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later read needs."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for entry in [x for x in _written if x[1].rstrip("/").rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]]:
            _delete(*entry)
            _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def _drop_all() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            return
