"""The per-cell feature matrix, its fractions and its one-line summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import joins
from ..functions import terms as t
from ..functions.text import filled, trim_all

MODES = ("sum", "all")
SAMPLE_KEYS = 8


def check_mapping(mapping: DataFrame, combine_column: str | None = None) -> None:
    """A barcode sits on one row; a feature's combine modes are valid and agree. The mapping is panel-sized."""
    twice = mapping.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(SAMPLE_KEYS).collect()
    if twice:
        raise ValueError(f"barcode(s) on more than one row of the mapping: {sorted(r.tag for r in twice)}")
    if combine_column is None:
        return
    modes = mapping.select("feature", F.lower(filled(F.col(f"`{combine_column}`"))).alias("mode")).filter("mode is not null")
    wrong = modes.filter(~F.col("mode").isin(*MODES)).limit(1).collect()
    if wrong:
        raise ValueError(f"invalid {combine_column!r} value {wrong[0].mode!r} for feature {wrong[0].feature!r}; allowed: sum, all")
    mixed = modes.groupBy("feature").agg(F.count_distinct("mode").alias("n")).filter("n > 1").limit(1).collect()
    if mixed:
        raise ValueError(f"feature {mixed[0].feature!r} has conflicting {combine_column!r} values")


def clean_mapping(mapping: DataFrame, barcode: str = "tag", feature: str = "feature") -> DataFrame:
    """The mapping with its two roles stripped and named `tag` and `feature`."""
    if barcode == feature:
        raise ValueError("the barcode and feature columns must differ")
    rest = [c for c in mapping.columns if c not in (barcode, feature)]
    return mapping.select(
        trim_all(F.col(f"`{barcode}`").cast("string")).alias("tag"),
        trim_all(F.col(f"`{feature}`").cast("string")).alias("feature"),
        *[F.col(f"`{c}`") for c in rest],
    )


def cell_feature_counts(
    stat: DataFrame,
    mapping: DataFrame,
    combine_column: str | None = None,
    min_umi: float = 1.0,
    by_sample: bool = False,
    small: bool | None = None,
) -> DataFrame:
    """(sampleId, cellId, feature, umiCount) from tag statistics (sampleId, CELL, FEATURE, unique_UMI).

    Several barcodes of one feature are summed. A feature in mode `all` is kept only in cells where every member
    barcode reached `min_umi`. With `by_sample` the mapping carries a sampleId and applies within it.
    """
    if min_umi < 0:
        raise ValueError("min_umi must be at least 0")
    scope = ["sampleId"] if by_sample else []
    mode = F.max(F.lower(filled(F.col(f"`{combine_column}`")))) if combine_column else F.lit(None).cast("string")
    features = mapping.groupBy(*scope, "feature").agg(
        F.coalesce(mode, F.lit("sum")).alias("mode"), F.count_distinct("tag").alias("members")
    )
    tags = mapping.select(*scope, "tag", "feature").join(features, [*scope, "feature"])
    renamed = tags.withColumnRenamed("feature", "antigen")
    reads = stat.select("sampleId", F.col("CELL").alias("cellId"), F.col("FEATURE").alias("tag"), "unique_UMI")
    return (
        joins.lookup(reads, renamed, [*scope, "tag"], "inner", small)
        .groupBy(*t.CELL, "antigen")
        .agg(
            F.sum("unique_UMI").cast("bigint").alias("umiCount"),
            F.count_if(F.col("unique_UMI") >= min_umi).alias("fired"),
            F.first("mode").alias("mode"),
            F.first("members").alias("members"),
        )
        .filter((F.col("mode") != "all") | (F.col("fired") == F.col("members")))
        .select(*t.CELL, F.col("antigen").alias("feature"), "umiCount")
    )


def empty_join_diagnostics(stat: DataFrame, mapping: DataFrame) -> DataFrame:
    """(side, tag): a few keys of either side where no barcode of the reads is on the panel; nothing otherwise."""
    read_tags = stat.select(F.col("FEATURE").alias("tag")).distinct()
    met = read_tags.join(mapping.select("tag").distinct(), "tag", "left_semi").agg(F.count(F.lit(1)) == 0).scalar()
    sides = read_tags.orderBy("tag").limit(SAMPLE_KEYS).select(F.lit("reads").alias("side"), "tag").unionByName(
        mapping.select("tag").distinct().orderBy("tag").limit(SAMPLE_KEYS).select(F.lit("panel").alias("side"), "tag")
    )
    return sides.withColumn("disjoint", met).filter("disjoint").drop("disjoint")


def with_fraction(counts: DataFrame) -> DataFrame:
    """Each feature's share of its cell's molecules, 0 where the cell holds none."""
    total = F.sum("umiCount").over(Window.partitionBy(*t.CELL))
    return counts.withColumn("fraction", F.when(total > 0, F.col("umiCount") / total).otherwise(F.lit(0.0)))


def per_cell_summary(fractions: DataFrame) -> DataFrame:
    """One row per cell: dominant feature, counts, and every feature as `name (p%, n UMI)` by falling share."""
    pct = F.bround(F.col("fraction") * 100, 0)
    shown = F.when((pct == 0) & (F.col("umiCount") > 0), "<1%").otherwise(F.concat(pct.cast("bigint").cast("string"), F.lit("%")))
    entry = F.concat("feature", F.lit(" ("), shown, F.lit(", "), F.col("umiCount").cast("string"), F.lit(" UMI)"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("fraction")).alias("r"), "feature", entry.alias("entry"))))
    return (
        fractions.groupBy(*t.CELL)
        .agg(
            ranked.alias("ranked"),
            F.max("umiCount").alias("maxUmiCount"),
            F.sum("umiCount").cast("bigint").alias("totalUmiCount"),
            F.max("fraction").alias("maxFraction"),
        )
        .select(
            *t.CELL,
            F.element_at("ranked", 1)["feature"].alias("topFeature"),
            "maxUmiCount",
            "totalUmiCount",
            "maxFraction",
            F.array_join(F.transform("ranked", lambda e: e["entry"]), ", ").alias("featureSummary"),
        )
    )


def cells_in_list(table: DataFrame, cell_list: DataFrame | None) -> DataFrame:
    """The table narrowed to the listed cells; whole where no list arrived."""
    if cell_list is None:
        return table
    return table.join(cell_list.select(*t.CELL).distinct(), t.CELL, "left_semi")
