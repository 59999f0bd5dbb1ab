"""Writers, and the shared folder that stage tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local: list[str] = []

# fixed value: Spark's switch for removing a query's shuffle files at its end, since 4.1; an older one keeps them
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. The cluster names it; only a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tagspark-"))
        named = _local[0]
    return named.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: a cut of the lineage that outlives executors.

    What was shuffled on the way goes once the table is there: left to the collector, a run would hold all of its shuffles.
    """
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}/{name}.parquet"
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before) if before is not None else conf.unset(SHUFFLES_GO)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_sorted(df: DataFrame, path: str, keys: list[str]) -> None:
    """A table as CSV in key order, with a header even when it has no row.

    The order is by ranges: every file is sorted and the files follow each other by name, so no task sees the whole.
    """
    as_written = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.sort(*keys).write.mode("overwrite").options(header=True, emptyValue="", nullValue="", **as_written).csv(path)


def write_table(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """A large table as Parquet, ordered within its files so that row-group statistics prune on the key."""
    writer = df.sortWithinPartitions(*keys).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def json_line(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each row as one JSON object with its fields in name order."""
    fields = sorted(c for c in df.columns if c not in keys)
    return df.select(*keys, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def write_json_report(df: DataFrame, path: str) -> None:
    """A run record or report: one JSON object per row, fields in name order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)
