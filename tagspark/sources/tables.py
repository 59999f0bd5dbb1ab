"""Readers: every one declares its schema, so an empty file still carries typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import joins
from ..functions.text import key

READ_QC_COLUMNS = [
    "readsTotal", "readsMatched", "matchedFraction", "cellsDetected", "featuresDetected", "totalUniqueUmis",
    "medianUmisPerCell", "panelAssignedFraction", "featureDroppedShare", "cellBarcodeValidFraction",
    "cellBarcodeIn", "cellBarcodeOut", "aggregateBarcodeFraction", "aggregateBarcodesFlagged",
    "aggregateBarcodeThreshold",
]
UMI_HINT = ". A UMI count is a count of observations; a blank or a decimal is not one."


def read_strings(spark: SparkSession, path, what: str, needed: list[str], sep: str = ",", multi_line: bool = False) -> DataFrame:
    """Delimited text or Parquet as strings. A missing column is fatal.

    Lines end at line ends, so that a large file is split; `multi_line` takes quoted line ends, one task a file.
    """
    first = path[0] if isinstance(path, list) else path
    if str(first).rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(*path) if isinstance(path, list) else spark.read.parquet(path)
    else:
        raw = spark.read.options(header=True, sep=sep, multiLine=multi_line, escape='"', mode="PERMISSIVE").csv(path)
    missing = [c for c in needed if c not in raw.columns]
    if missing:
        raise ValueError(f"{what} {path!r} has no column(s) {missing}; columns are {raw.columns}")
    return raw


def with_whole_numbers(df: DataFrame, what: str, columns: list[str], hint: dict[str, str] | None = None) -> DataFrame:
    """Cast `columns` to whole numbers; a value that is not one stops the work that reads it, with the value named."""

    def number(c: str) -> Column:
        raw = F.col(f"`{c}`").cast("string")
        message = F.concat(F.lit(f"{what} has {c} value(s) that are not whole numbers: '"), F.coalesce(raw, F.lit("")), F.lit(f"'{(hint or {}).get(c, '')}"))
        return F.coalesce(F.expr(f"try_cast(trim(cast(`{c}` as string)) as bigint)"), F.raise_error(message).cast("bigint"))

    return df.withColumns({c: number(c) for c in columns})


def read_counts(spark: SparkSession, path) -> DataFrame:
    """Sparse counts: sampleId, cellId, tag, umiCount and, where the file carries it, totalWeight."""
    raw = read_strings(spark, path, "counts file", ["sampleId", "cellId", "tag", "umiCount"])
    numbers = ["umiCount"] + (["totalWeight"] if "totalWeight" in raw.columns else [])
    typed = with_whole_numbers(
        raw.select("sampleId", "cellId", "tag", *numbers), "counts file", numbers, {"umiCount": UMI_HINT}
    )
    return typed.select(*[key(c).alias(c) for c in ("sampleId", "cellId", "tag")], *numbers)


def read_keys(spark: SparkSession, path, columns: list[str], what: str = "key file") -> DataFrame:
    """Any table as stripped string keys: the linker, the cell list."""
    raw = read_strings(spark, path, what, columns)
    return raw.select(*[key(c).alias(c) for c in columns])


def tag_stat_schema(cell: str = "CELL", feature: str = "FEATURE", umi: str = "UMI") -> T.StructType:
    return T.StructType(
        [
            T.StructField(cell, T.StringType()),
            T.StructField(feature, T.StringType()),
            T.StructField("count", T.LongType()),
            T.StructField("totalWeight", T.LongType()),
            T.StructField(f"unique_{umi}", T.LongType()),
        ]
    )


def read_tag_stat(spark: SparkSession, path, sample: str) -> DataFrame:
    """One sample's tab-separated tag statistics, with the sample id attached."""
    raw = spark.read.options(header=True, sep="\t").schema(tag_stat_schema()).csv(path)
    return raw.select(F.lit(sample).alias("sampleId"), "*")


def read_raw_feature_counts(spark: SparkSession, path) -> DataFrame:
    """Sequences seen before correction with their read weight; aggregate only, never collect."""
    raw = read_strings(spark, path, "raw feature counts file", ["sampleId", "FEATURE", "totalWeight"])
    typed = with_whole_numbers(
        raw.select("sampleId", "FEATURE", "totalWeight"), "raw feature counts file", ["totalWeight"]
    )
    return typed.select(key("sampleId").alias("sampleId"), key("FEATURE").alias("FEATURE"), "totalWeight")


def read_read_qc(spark: SparkSession, path) -> DataFrame:
    """Per-sample read figures; a blank means the figure is absent."""
    raw = read_strings(spark, path, "read QC file", ["sampleId"])
    numbers = [
        (F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)") if c in raw.columns else F.lit(None).cast("double")).alias(c)
        for c in READ_QC_COLUMNS
    ]
    return raw.select(key("sampleId").alias("sampleId"), *numbers)


_PAIR = T.StructType([T.StructField("total", T.LongType()), T.StructField("matched", T.LongType())])
_STEP = T.StructType(
    [
        T.StructField("tagName", T.StringType()),
        T.StructField("inputCount", T.LongType()),
        T.StructField("outputCount", T.LongType()),
    ]
)


def read_parse_reports(spark: SparkSession, path, sample: str | None = None) -> DataFrame:
    """Reads parsed and matched, from `{"parseReport": {...}}` or the unwrapped object; absent counts are 0.

    Report files carry their sample in a `sampleId` field unless `sample` names it.
    """
    schema = T.StructType([T.StructField("parseReport", _PAIR), *_PAIR.fields, T.StructField("sampleId", T.StringType())])
    raw = spark.read.options(multiLine=True).schema(schema).json(path)
    wrapped = F.col("parseReport").isNotNull()

    def number(c):
        return F.coalesce(F.when(wrapped, F.col(f"parseReport.{c}")).otherwise(F.col(c)), F.lit(0)).alias(c)

    who = F.lit(sample) if sample is not None else F.col("sampleId")
    return raw.select(who.alias("sampleId"), number("total"), number("matched"))


def read_refine_reports(spark: SparkSession, path, sample: str | None = None) -> DataFrame:
    """One row per correction step and sample. An unreadable report yields no row, which reads as absent."""
    schema = T.StructType([T.StructField("steps", T.ArrayType(_STEP)), T.StructField("sampleId", T.StringType())])
    raw = spark.read.options(multiLine=True).schema(schema).json(path)
    who = F.lit(sample) if sample is not None else F.col("sampleId")
    return raw.select(who.alias("sampleId"), F.explode("steps").alias("s")).select(
        "sampleId",
        "s.tagName",
        F.coalesce("s.inputCount", F.lit(0)).alias("inputCount"),
        F.coalesce("s.outputCount", F.lit(0)).alias("outputCount"),
    )


def gather_samples(spark: SparkSession, paths: dict[str, str], columns: dict[str, str], schema: str | T.StructType | None = None, sep: str = "\t") -> DataFrame:
    """One table from a file, or a folder of files, per sample: the sample id added, `columns` under their new names.

    All files are read at once, and each row finds its sample by the file it came from, so the plan is as large for a
    thousand samples as for one. Parquet files are told by their ending; others need a `schema` and have a header.
    """
    ends = {p.rstrip("/").endswith(".parquet") for p in paths.values()}
    if len(ends) != 1 or len(set(paths.values())) != len(paths):
        raise ValueError("samples must have files of one format, each its own")
    reader = spark.read if schema is None else spark.read.schema(schema)
    files = [paths[s] for s in sorted(paths)]
    raw = reader.parquet(*files) if ends == {True} else reader.options(header=True, sep=sep).csv(files)
    named = spark.createDataFrame([(sample, _qualified(spark, path)) for sample, path in sorted(paths.items())], "sampleId string, _path string")
    one_slash = lambda c: F.regexp_replace(c, "^([A-Za-z0-9+.-]+):/+", "$1:/")  # noqa: E731  file:/x and file:///x are one file
    rows = raw.select("*", one_slash(F.col("_metadata.file_path")).alias("_file"))
    # a path names the file itself or the folder that it lies in
    parts = F.array(F.col("_file"), F.regexp_replace("_file", "/[^/]*$", ""))
    marked = rows.withColumn("_path", F.explode(parts))
    small = True if len(paths) <= joins.BROADCAST_ROWS else None
    named = named.withColumn("_path", one_slash(F.col("_path")))
    out = joins.lookup(marked, named, ["_path"], "inner", small)
    return out.select("sampleId", *[F.col(old).alias(new) for old, new in columns.items()])


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark names it in a file's metadata."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toUri().toString()
