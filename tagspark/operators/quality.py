"""Quality measures: per sample, per reagent, per undeclared sequence, and the lines they are read against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bins, joins
from ..functions import terms as t
from ..functions.text import grouped_digits, percent_shown

# fixed values: (measurement, warn, alert, how warn is read, how alert is read), in report order
LINES = [
    ("matchedFraction", 0.90, 0.50, "at-least", "at-least"),
    ("cellBarcodeValidFraction", 0.95, 0.75, "at-least", "at-least"),
    ("panelAssignedFraction", 0.50, 0.0, "at-least", "alerting-at"),
    ("refineRescuedShare", 0.05, 0.10, "at-most", "at-most"),
    ("aggregateBarcodeFraction", 0.05, 1.0, "at-most", "alerting-at"),
    ("uniqueCountsPerCell", 4.0, 1.0, "at-least", "alerting-at"),
    ("usableReadFraction", 0.20, 0.0, "at-least", "alerting-at"),
    ("readsPerCell", 5000.0, None, "at-least", None),
    ("undeclaredBarcodeShare", 0.01, 0.05, "at-most", "at-most"),
]
CATEGORICAL = ["cellsDetected"]
# fixed values: the measurements a sample's report holds, in order
SAMPLE_MEASURES = [
    "matchedFraction", "cellBarcodeValidFraction", "panelAssignedFraction", "refineRescuedShare", "cellsDetected",
    "aggregateBarcodeFraction", "uniqueCountsPerCell", "usableReadFraction", "readsPerCell", "floorRemoved",
    "medianControlReading", "cellsSetAside", "medianAntigenReading", "cutoffCountNeeded", "boundReadingShare",
]
CONTROL_MEASURES = ["cellsSetAside", "medianControlReading"]
READ_COUNTS = ["readsTotal", "readsMatched", "featureDroppedShare", "featuresDetected", "totalUniqueUmis", "medianUmisPerCell"]

# fixed values: reasons a measurement has no number
UNSUPPLIED = "nothing in this run supplied a value for this measurement"
NOT_FINITE = "this run computed a value for this measurement that is not a finite number"
NO_READ_QC = "no read QC summary row reached this sample"
NO_REFINE_STEP = "no refine-tags report was produced, or it supplied no %s step with input reads"
NO_READS_TO_DIVIDE = "this sample's read QC reports no reads, so the share has no denominator"
NO_AGGREGATE_FIGURE = "this sample's read QC reports nonzero reads but no aggregate-barcode figure"
NO_READ_COUNT = "this sample's read QC row carries no read count, so the share has no denominator"
NO_MATCHED_COUNT = "this sample's read QC row carries no matched-read count, so the share has no numerator"
NO_RESCUED_FIGURE = (
    "this sample has no pre-refine pass, no panel-assigned fraction, or the two disagree, so what correction "
    "rescued cannot be read"
)
NO_CONTROL = "no cell of this sample carries a control reading"
NO_LIMIT = "no sticky cell limit is set, so no cell is set aside"
NO_LIST_USABLE = "no cell list supplied, so the called-cell condition cannot be evaluated"
NO_TOTAL = "no total read count to divide by"
NO_WEIGHT = "the counts file carries no totalWeight column"
NO_LIST_DEPTH = "no cell list supplied, so depth has no denominator"
NO_CELL_DEPTH = "no cell of this sample is in the cell list, so depth has no denominator"
NO_WEIGHT_DEPTH = "the counts file carries no totalWeight column, so depth has no numerator"
NO_LIST_CELLS = "no cell list supplied, so no cell of this sample is listed"
NO_COUNTED_READING = "no listed cell in this sample holds a counted reading"


def lines_table(spark: SparkSession, overrides: dict[str, tuple] | None = None) -> DataFrame:
    """(measurement, warn, alert, warnReads, alertReads); `overrides` maps a measurement to its (warn, alert)."""
    rows = []
    for name, warn, alert, warn_reads, alert_reads in LINES:
        if overrides and name in overrides:
            warn, alert = overrides[name]
        rows.append((name, float(warn), None if alert is None else float(alert), warn_reads, alert_reads))
    return spark.createDataFrame(rows, "measurement string, warn double, alert double, warnReads string, alertReads string")


def is_number(value: Column) -> Column:
    """Whether a number came back: null, NaN and the infinities are none."""
    v = value.cast("double")
    return F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))


def _breaches(value: Column, line: Column, reads: Column) -> Column:
    return F.when(reads == "at-least", value < line).when(reads == "at-most", value > line).otherwise(value == line)


def with_status(readings: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds `status` to (measurement, value) rows: alert first, then warn; null without a line or a number."""
    value = F.col("value")
    judged = readings.join(F.broadcast(lines), "measurement", "left")
    alert = F.coalesce(F.col("alert").isNotNull() & F.col("alertReads").isNotNull() & _breaches(value, F.col("alert"), F.col("alertReads")), F.lit(False))
    status = (
        F.when(~is_number(value), F.lit(None).cast("string"))
        .when(F.col("measurement").isin(CATEGORICAL), F.when(value == 0, t.ALERT).otherwise(t.OK))
        .when(F.col("warn").isNull(), F.lit(None).cast("string"))
        .when(alert, t.ALERT)
        .when(_breaches(value, F.col("warn"), F.col("warnReads")), t.WARN)
        .otherwise(t.OK)
    )
    return judged.withColumn("status", status).drop("warn", "alert", "warnReads", "alertReads")


def roll_up(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Worst status and coverage per group of (value, status) rows; no status where nothing was judged."""
    rank = F.when(F.col("status") == t.ALERT, 2).when(F.col("status") == t.WARN, 1).when(F.col("status") == t.OK, 0)
    worst = F.max(rank)
    number = is_number(F.col("value"))
    return readings.groupBy(*keys).agg(
        F.when(worst == 2, t.ALERT).when(worst == 1, t.WARN).when(worst == 0, t.OK).alias("status"),
        F.count("status").alias("judged"),
        F.count_if(F.col("status").isNull() & number).alias("unjudged"),
        F.count_if(F.col("status").isNull() & ~number).alias("notEvaluated"),
    )


def per_barcode_totals(stat: DataFrame) -> DataFrame:
    """(sampleId, barcode, umiCount, readCount) per cell barcode."""
    return stat.groupBy("sampleId", F.col("CELL").alias("barcode")).agg(
        F.sum("unique_UMI").cast("bigint").alias("umiCount"), F.sum("count").cast("bigint").alias("readCount")
    )


def aggregate_barcodes(
    per_barcode: DataFrame, multiplier: float = t.AGGREGATE_IQR, minimum: float = t.AGGREGATE_MIN_UMI, top: int = t.AGGREGATE_TOP
) -> DataFrame:
    """(sampleId, tested, threshold, flagged, flaggedReads): outliers among each sample's `top` barcodes by molecules.

    The threshold is q3 + multiplier * (q3 - q1) over those barcodes; under `minimum` nothing is flagged. Barcodes
    of equal count are taken in name order.
    """
    head = joins.top_per_group(per_barcode, ["sampleId"], [F.col("umiCount").desc(), F.col("barcode")], top)
    rows = F.collect_list(F.struct("umiCount", "readCount"))
    quartiles = head.groupBy("sampleId").agg(
        F.percentile("umiCount", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), rows.alias("rows"), F.count(F.lit(1)).alias("tested")
    )
    threshold = F.col("q")[1] + (F.col("q")[1] - F.col("q")[0]) * multiplier
    out = F.filter("rows", lambda r: (F.col("threshold") >= minimum) & (r["umiCount"] >= F.col("threshold")))
    return (
        quartiles.withColumn("threshold", threshold)
        .withColumn("hit", out)
        .select(
            "sampleId",
            "tested",
            "threshold",
            F.size("hit").cast("bigint").alias("flagged"),
            F.aggregate("hit", F.lit(0).cast("bigint"), lambda a, r: a + r["readCount"]).alias("flaggedReads"),
        )
    )


def aggregate_barcode_fraction(flagged: DataFrame, totals: DataFrame, minimum: float = t.AGGREGATE_MIN_UMI) -> DataFrame:
    """(sampleId, value, detail): reads of flagged barcodes over `readsTotal`; null with its reason without a total."""
    have = F.coalesce(F.col("readsTotal"), F.lit(0)) > 0
    limit = grouped_digits(F.lit(minimum))
    head = F.concat(F.lit("Barcodes tested: "), grouped_digits("tested"), F.lit("|Threshold: "), grouped_digits("threshold"), F.lit(" UMIs"))
    detail = (
        F.when(~have, NO_TOTAL)
        .when(F.col("threshold").isNull(), "no antigen barcode observed in this sample")
        .when(F.col("threshold") < minimum, F.concat(head, F.lit(" (below the "), limit, F.lit("-UMI floor, so no barcode is flagged)")))
        .otherwise(F.concat(head, F.lit("|Barcodes flagged: "), grouped_digits("flagged")))
    )
    value = F.when(have, F.coalesce("flaggedReads", F.lit(0)) / F.col("readsTotal"))
    return totals.join(flagged, "sampleId", "left").select("sampleId", value.alias("value"), detail.alias("detail"))


def read_qc(
    stat: DataFrame, parse: DataFrame, refine: DataFrame | None = None,
    multiplier: float = t.AGGREGATE_IQR, minimum: float = t.AGGREGATE_MIN_UMI, top: int = t.AGGREGATE_TOP,
) -> DataFrame:
    """The per-sample read figures. A figure whose inputs are absent is null, never 0.

    One aggregation per (sample, cell) feeds the counts, the median and the outlier rule.
    """
    per_cell = per_barcode_totals(stat)
    cells = per_cell.groupBy("sampleId").agg(F.count(F.lit(1)).alias("cellsDetected"), F.sum("umiCount").cast("bigint").alias("totalUniqueUmis"))
    features = stat.select("sampleId", "FEATURE").distinct().groupBy("sampleId").agg(F.count(F.lit(1)).alias("featuresDetected"))
    medians = joins.group_percentile(per_cell, ["sampleId"], "umiCount", 0.5, "medianUmisPerCell")
    flagged = aggregate_barcodes(per_cell, multiplier, minimum, top)
    base = parse.select("sampleId", F.col("total").alias("readsTotal"), F.col("matched").alias("readsMatched"))
    for part in (cells, features, medians, flagged):
        base = base.join(part, "sampleId", "left")
    steps = None
    if refine is not None:
        at = {(tag, c): F.max(F.when(F.col("tagName") == tag, F.col(c))) for tag in ("CELL", "FEATURE") for c in ("inputCount", "outputCount")}
        steps = refine.groupBy("sampleId").agg(
            at["CELL", "inputCount"].alias("cellBarcodeIn"), at["CELL", "outputCount"].alias("cellBarcodeOut"),
            at["FEATURE", "inputCount"].alias("_in"), at["FEATURE", "outputCount"].alias("_out"),
        )
        base = base.join(steps, "sampleId", "left")
    else:
        base = base.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("cellBarcodeIn", "cellBarcodeOut", "_in", "_out")])
    total, matched = F.col("readsTotal"), F.col("readsMatched")
    zero = F.lit(0).cast("bigint")
    return base.select(
        "sampleId",
        "readsTotal",
        "readsMatched",
        F.when(total > 0, matched / total).alias("matchedFraction"),
        F.coalesce("cellsDetected", zero).alias("cellsDetected"),
        F.coalesce("featuresDetected", zero).alias("featuresDetected"),
        F.coalesce("totalUniqueUmis", zero).alias("totalUniqueUmis"),
        "medianUmisPerCell",
        F.when(matched > 0, F.col("_out") / matched).alias("panelAssignedFraction"),
        F.when(matched > 0, (F.col("_in") - F.col("_out")) / matched).alias("featureDroppedShare"),
        F.when(F.col("cellBarcodeIn") > 0, F.col("cellBarcodeOut") / F.col("cellBarcodeIn")).alias("cellBarcodeValidFraction"),
        "cellBarcodeIn",
        "cellBarcodeOut",
        F.when(total > 0, F.coalesce("flaggedReads", zero) / total).alias("aggregateBarcodeFraction"),
        F.when(total > 0, F.coalesce("flagged", zero)).otherwise(zero).alias("aggregateBarcodesFlagged"),
        F.when(total > 0, F.col("threshold")).alias("aggregateBarcodeThreshold"),
    )


def usable_reads(counts: DataFrame, cell_list: DataFrame) -> DataFrame:
    """(sampleId, usable, listedCells): read weight on listed cells, and how many cells the list holds.

    A listed cell without a reading counts in the denominator.
    """
    per_cell = counts.groupBy(*t.CELL).agg(F.sum("totalWeight").alias("w"))
    return (
        cell_list.select(*t.CELL).distinct().join(per_cell, t.CELL, "left")
        .groupBy("sampleId")
        .agg(F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("usable"), F.count(F.lit(1)).alias("listedCells"))
    )


def usable_read_fraction(totals: DataFrame, usable: DataFrame | None) -> DataFrame:
    """(sampleId, value, detail): usable reads over all reads parsed; null and the reason without a list or a total."""
    if usable is None:
        return totals.select("sampleId", F.lit(None).cast("double").alias("value"), F.lit(NO_LIST_USABLE).alias("detail"))
    have = F.coalesce(F.col("readsTotal"), F.lit(0)) > 0
    used = F.coalesce("usable", F.lit(0))
    detail = F.concat(grouped_digits(used), F.lit(" out of "), grouped_digits("readsTotal"), F.lit(" reads parsed"))
    return totals.join(usable, "sampleId", "left").select(
        "sampleId", F.when(have, used / F.col("readsTotal")).alias("value"), F.when(have, detail).otherwise(F.lit(NO_TOTAL)).alias("detail")
    )


def reads_per_cell(usable: DataFrame) -> DataFrame:
    """(sampleId, readsPerCell): null where the sample has no listed cell."""
    return usable.select("sampleId", F.when(F.col("listedCells") > 0, F.col("usable") / F.col("listedCells")).alias("readsPerCell"))


def undeclared_sequences(raw: DataFrame, declared: DataFrame, small: bool | None = None) -> DataFrame:
    """Raw sequences with `declared`: whether their own sample's panel holds them."""
    marks = declared.select("sampleId", F.col("tag").alias("FEATURE"), F.lit(True).alias("declared"))
    return joins.lookup(raw, marks, ["sampleId", "FEATURE"], "left", small).withColumn("declared", F.coalesce("declared", F.lit(False)))


def undeclared_tally(marked: DataFrame, keep: int | None = t.UNDECLARED_KEPT) -> DataFrame:
    """(sampleId, totalWeight, undeclaredWeight, undeclaredDistinct, undeclaredShare, elided) over every row."""
    own = ~F.col("declared")
    weight = F.coalesce(F.sum(F.when(own, F.col("totalWeight"))), F.lit(0)).cast("bigint")
    total = F.sum("totalWeight").cast("bigint")
    distinct = F.count_if(own)
    elided = F.greatest(F.lit(0), distinct - keep) if keep is not None else F.lit(0)
    return marked.groupBy("sampleId").agg(
        total.alias("totalWeight"),
        weight.alias("undeclaredWeight"),
        distinct.alias("undeclaredDistinct"),
        F.when(total > 0, weight / total).alias("undeclaredShare"),
        elided.cast("bigint").alias("elided"),
    )


def heaviest_undeclared(marked: DataFrame, keep: int | None = t.UNDECLARED_KEPT) -> DataFrame:
    """(sampleId, tag, totalWeight): the heaviest undeclared sequences of each sample, in tag order within a weight."""
    rows = marked.filter(~F.col("declared")).select("sampleId", F.col("FEATURE").alias("tag"), "totalWeight")
    if keep is None:
        return rows
    return joins.top_per_group(rows, ["sampleId"], [F.col("totalWeight").desc(), F.col("tag")], keep)


def undeclared_barcodes(heaviest: DataFrame, tally: DataFrame, read_qc: DataFrame, lines: DataFrame) -> DataFrame:
    """(sampleId, tag, totalWeight, barcodeShare, readShare, status); the status reads the row's own share."""
    totals = tally.select("sampleId", F.col("totalWeight").alias("_all"))
    dropped = read_qc.select("sampleId", F.col("featureDroppedShare").alias("readShare"))
    share = F.when(F.col("_all") > 0, F.col("totalWeight") / F.col("_all"))
    shaped = (
        heaviest.join(totals, "sampleId", "left")
        .join(dropped, "sampleId", "left")
        .withColumn("value", share)
        .withColumn("measurement", F.lit("undeclaredBarcodeShare"))
    )
    return with_status(shaped, lines).select("sampleId", "tag", "totalWeight", F.col("value").alias("barcodeShare"), "readShare", "status")


def rescued_share(undeclared: Column, dropped: Column) -> Column:
    """What correction moved onto the panel: a difference of two shares of the matched reads."""
    value = undeclared - dropped
    return F.when(value >= -1e-9, F.greatest(value, F.lit(0.0)))


def cells_set_aside(reference: DataFrame, threshold: int | None) -> DataFrame:
    """(sampleId, cellsSetAside) among the given (listed) cells; null without a threshold."""
    n = F.count_if(F.col("referenceCount") > threshold) if threshold is not None else F.lit(None)
    return reference.groupBy("sampleId").agg(n.cast("bigint").alias("cellsSetAside"))


def median_control_reading(reference: DataFrame) -> DataFrame:
    """(sampleId, medianControlReading, nonzeroCells, cells) among the given (listed) cells."""
    sizes = reference.groupBy("sampleId").agg(F.count_if(F.col("referenceCount") > 0).alias("nonzeroCells"), F.count(F.lit(1)).alias("cells"))
    return joins.group_percentile(reference, ["sampleId"], "referenceCount", 0.5, "medianControlReading").join(sizes, "sampleId")


def sample_measures(
    roster: DataFrame,
    counts: DataFrame,
    floor: int,
    floor_stats: DataFrame,
    cell_list: DataFrame | None = None,
    read_qc: DataFrame | None = None,
    tally: DataFrame | None = None,
    reference: DataFrame | None = None,
    threshold: int | None = None,
    scores: DataFrame | None = None,
) -> DataFrame:
    """Long readings (sampleId, measurement, value, detail, reason) of every sample.

    Each figure is first aggregated to one row per sample; the rows are then joined, which costs samples and not
    readings, and unfolded. A reading without a number says why.
    """
    from .cells import listed

    qc_names = ["readsTotal", "readsMatched", "cellsDetected", "panelAssignedFraction", "featureDroppedShare",
                "cellBarcodeValidFraction", "cellBarcodeIn", "cellBarcodeOut", "aggregateBarcodeFraction",
                "aggregateBarcodeThreshold"]
    wide = roster.select("sampleId").distinct()
    if read_qc is not None:
        wide = wide.join(read_qc.select("sampleId", *qc_names, F.lit(True).alias("hasQc")), "sampleId", "left")
    else:
        wide = wide.select("sampleId", *[F.lit(None).cast("double").alias(c) for c in qc_names], F.lit(None).cast("boolean").alias("hasQc"))
    has_weight = "totalWeight" in counts.columns
    if cell_list is not None:
        own = listed(counts, cell_list).groupBy(*t.CELL).agg(F.sum("umiCount").alias("umis"))
        wide = wide.join(joins.group_percentile(own, ["sampleId"], "umis", 0.5, "uniqueCountsPerCell"), "sampleId", "left")
        wide = wide.join(own.groupBy("sampleId").agg(F.count(F.lit(1)).alias("readingCells")), "sampleId", "left")
        weights = counts if has_weight else counts.withColumn("totalWeight", F.lit(0))
        wide = wide.join(usable_reads(weights, cell_list), "sampleId", "left")
    else:
        wide = wide.selectExpr("*", "cast(null as double) uniqueCountsPerCell", "cast(null as bigint) readingCells",
                               "cast(null as bigint) usable", "cast(null as bigint) listedCells")
    wide = wide.join(floor_stats, "sampleId", "left")
    if tally is not None:
        wide = wide.join(tally.select("sampleId", "undeclaredShare", F.lit(True).alias("hasTally")), "sampleId", "left")
    else:
        wide = wide.selectExpr("*", "cast(null as double) undeclaredShare", "cast(null as boolean) hasTally")
    if reference is not None:
        own_reference = listed(reference, cell_list)
        wide = wide.join(cells_set_aside(own_reference, threshold), "sampleId", "left").join(median_control_reading(own_reference), "sampleId", "left")
    if scores is not None:
        wide = wide.join(scores, "sampleId", "left")
    else:
        wide = wide.selectExpr("*", "cast(null as double) medianAntigenReading", "cast(null as bigint) cutoffCountNeeded", "cast(null as double) boundReadingShare")

    c, text = F.col, F.lit
    no_qc = c("hasQc").isNull()
    total, matched = c("readsTotal"), c("readsMatched")
    # a list arrived: its read weight is a number even for a sample none of whose cells are listed
    usable = F.coalesce(c("usable"), text(0)) if cell_list is not None and has_weight else text(None).cast("double")
    listed_cells = F.coalesce(c("listedCells"), text(0)) if cell_list is not None else text(None).cast("bigint")

    def entry(name, value, detail=None, reason=None):
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(name).alias("measurement"),
            value.cast("double").alias("value"),
            (none if detail is None else F.when(value.isNotNull(), detail)).alias("detail"),
            (none if reason is None else F.when(value.isNull(), reason)).alias("reason"),
        )

    zero = text(0)
    if cell_list is None:
        depth_reason, counts_reason = text(NO_LIST_DEPTH), text(NO_LIST_CELLS)
    else:
        depth_reason = F.when(listed_cells == 0, NO_CELL_DEPTH).otherwise(text(NO_WEIGHT_DEPTH))
        counts_reason = text(NO_COUNTED_READING)
    usable_reason = text(NO_WEIGHT) if not has_weight else text(NO_LIST_USABLE) if cell_list is None else text(NO_TOTAL)
    rows = [
        entry(
            "matchedFraction",
            F.when(total > 0, matched / total),
            F.concat(grouped_digits(matched), text(" out of "), grouped_digits(total), text(" reads parsed")),
            F.when(no_qc, NO_READ_QC).when(total.isNull(), NO_READ_COUNT).when(total == 0, NO_READS_TO_DIVIDE).otherwise(text(NO_MATCHED_COUNT)),
        ),
        entry(
            "cellBarcodeValidFraction",
            c("cellBarcodeValidFraction"),
            F.concat(grouped_digits("cellBarcodeIn"), text(" reads entered correction, "), grouped_digits("cellBarcodeOut"), text(" passed")),
            F.when(no_qc, NO_READ_QC).otherwise(text(NO_REFINE_STEP % "CELL")),
        ),
        entry("panelAssignedFraction", c("panelAssignedFraction"), None, F.when(no_qc, NO_READ_QC).otherwise(text(NO_REFINE_STEP % "FEATURE"))),
        entry("cellsDetected", c("cellsDetected"), None, text(NO_READ_QC)),
        entry(
            "aggregateBarcodeFraction",
            c("aggregateBarcodeFraction"),
            F.concat(text("Threshold set at "), grouped_digits("aggregateBarcodeThreshold"), text(" UMIs")),
            F.when(no_qc, NO_READ_QC).when(total == 0, NO_READS_TO_DIVIDE).when(total.isNotNull(), NO_AGGREGATE_FIGURE).otherwise(text(NO_READ_COUNT)),
        ),
        entry("uniqueCountsPerCell", c("uniqueCountsPerCell"), F.concat(text("V(D)J-matched cells with a reading: "), grouped_digits("readingCells")), counts_reason),
        entry(
            "usableReadFraction",
            F.when(total > 0, usable / total),
            F.concat(grouped_digits(usable), text(" out of "), grouped_digits(total), text(" reads parsed")),
            usable_reason,
        ),
        entry("readsPerCell", F.when(listed_cells > 0, usable / listed_cells), None, depth_reason),
        entry(
            "floorRemoved",
            F.coalesce("readingsFloored", zero),
            F.concat(
                text(f"Minimum count is set to {floor:,} (Settings > Binding thresholds)|Cell barcodes left with nothing above zero: "),
                grouped_digits(F.coalesce("cellsEmptied", zero)), text(" out of "), grouped_digits(F.coalesce("cellsWithAntigenReadings", zero)),
            ),
        ),
        entry("medianAntigenReading", c("medianAntigenReading")),
        entry("cutoffCountNeeded", c("cutoffCountNeeded")),
        entry("boundReadingShare", c("boundReadingShare")),
    ]
    if tally is not None:
        # a sample without a pre-correction row still went through the pass
        rows.append(entry("refineRescuedShare", rescued_share(c("undeclaredShare"), c("featureDroppedShare")), None, text(NO_RESCUED_FIGURE)))
    if reference is not None:
        limit_reason = F.when(c("cells").isNull(), NO_CONTROL).otherwise(text(NO_LIMIT))
        rows.append(entry("cellsSetAside", c("cellsSetAside"), text(f"Sticky cell limit set at {threshold:,} UMIs" if threshold is not None else ""), limit_reason))
        rows.append(
            entry(
                "medianControlReading",
                c("medianControlReading"),
                F.concat(grouped_digits("nonzeroCells"), text(" of "), grouped_digits("cells"), text(" cells carry a non-zero control count")),
                text(NO_CONTROL),
            )
        )
    return wide.select("sampleId", F.explode(F.array(*rows)).alias("r")).select("sampleId", "r.measurement", "r.value", "r.detail", "r.reason")


def sample_report(readings: DataFrame, roster: DataFrame, lines: DataFrame, with_control: bool = True) -> DataFrame:
    """(sampleId, position, measurement, value, detail, reason, status): every declared measurement has its row."""
    names = [m for m in SAMPLE_MEASURES if with_control or m not in CONTROL_MEASURES]
    spine = roster.select("sampleId").distinct().select("sampleId", F.posexplode(F.array(*[F.lit(m) for m in names])).alias("position", "measurement"))
    value = F.when(is_number(F.col("value")), F.col("value"))
    reason = F.when(
        F.col("shown").isNull(),
        F.when(F.col("value").isNotNull(), F.lit(NOT_FINITE)).otherwise(F.coalesce(F.when(F.col("reason") != "", F.col("reason")), F.lit(UNSUPPLIED))),
    )
    rows = spine.join(readings, ["sampleId", "measurement"], "left").withColumn("shown", value).withColumn("reason", reason)
    judged = with_status(rows.drop("value").withColumnRenamed("shown", "value"), lines)
    return judged.select("sampleId", "position", "measurement", "value", F.when(F.col("detail") != "", F.col("detail")).alias("detail"), "reason", "status")


def sample_report_json(report: DataFrame) -> DataFrame:
    """(sampleId, status, judged, unjudged, notEvaluated, measurements): the report of one sample as one record."""
    entry = F.struct("position", F.col("measurement").alias("id"), "value", "detail", "reason", "status")
    entries = report.groupBy("sampleId").agg(F.array_sort(F.collect_list(entry)).alias("measurements"))
    return roll_up(report, ["sampleId"]).join(entries, "sampleId")


def sample_summary(report: DataFrame, roster: DataFrame, read_qc: DataFrame | None) -> DataFrame:
    """One row per sample: the read counts and a column per declared measurement."""
    measures = report.groupBy("sampleId").pivot("measurement", SAMPLE_MEASURES).agg(F.first("value"))
    out = roster.select("sampleId").distinct().join(measures, "sampleId", "left")
    if read_qc is not None:
        out = out.join(read_qc.select("sampleId", *[F.col(c).cast("double") for c in READ_COUNTS]), "sampleId", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(c) for c in READ_COUNTS])
    return out.select("sampleId", *READ_COUNTS, *SAMPLE_MEASURES)


def reagent_scope(declared: DataFrame, grouping: DataFrame, panels: DataFrame) -> DataFrame:
    """(sampleId, tag, panelId, identity, scopeId): the one row of the reagent table a tag's readings in a sample feed.

    A tag outside the grouping stands under its own name.
    """
    own = grouping.filter(F.col("sample") != t.ANY_SAMPLE).select(F.col("sample").alias("sampleId"), "tag", F.col("identity").alias("_own"))
    every = grouping.filter(F.col("sample") == t.ANY_SAMPLE).select("tag", F.col("identity").alias("_every"))
    return (
        declared.join(own, ["sampleId", "tag"], "left")
        .join(every, "tag", "left")
        .join(panels.select("sampleId", "panelId"), "sampleId")
        .select("sampleId", "tag", "panelId", F.coalesce("_own", "_every", "tag").alias("identity"),
                F.coalesce("_own", "_every").isNotNull().alias("grouped"))
        .withColumn("scopeId", F.concat_ws("\u0001", "panelId", "identity"))
    )


REAGENT = ["panelId", "tag", "identity"]


def per_antigen_measures(
    counts: DataFrame, tag_states: DataFrame, scope: DataFrame, refs: DataFrame, small: bool | None = None
) -> DataFrame:
    """Per (panel, tag, identity): samples seen in, cells with a count and their median, cells above the line.

    `counts` are raw and `tag_states` at tag grain, both of listed cells. A dead tag keeps its row.
    """
    keys = scope.select("sampleId", *REAGENT)
    seen = joins.lookup(counts.filter(F.col("umiCount") > 0).select("sampleId", "tag", "umiCount"), keys, ["sampleId", "tag"], "inner", small)
    hist = seen.groupBy("sampleId", *REAGENT, "umiCount").agg(F.count(F.lit(1)).alias("cells"))
    delivered = hist.groupBy(*REAGENT).agg(
        F.sum("cells").cast("bigint").alias("cellsWithCount"),
        F.percentile("umiCount", 0.5, F.col("cells")).alias("medianCountPerCell"),
        F.array_sort(F.collect_set("sampleId")).alias("seenNames"),
    )
    bound_rows = tag_states.filter(F.col("state") == t.BOUND).select("sampleId", F.col("identity").alias("tag"))
    bound = joins.lookup(bound_rows, keys, ["sampleId", "tag"], "inner", small).groupBy(*REAGENT).agg(F.count(F.lit(1)).alias("bound"))
    roster = keys.groupBy(*REAGENT).agg(F.array_sort(F.collect_set("sampleId")).alias("panelNames"))
    control = refs.select("tag").distinct().withColumn("_ref", F.lit(True))
    empty = F.array().cast("array<string>")
    return (
        roster.join(delivered, REAGENT, "left").join(bound, REAGENT, "left").join(control, "tag", "left")
        .select(
            *REAGENT,
            F.coalesce(F.size("seenNames"), F.lit(0)).cast("bigint").alias("samplesSeenIn"),
            F.size("panelNames").cast("bigint").alias("samplesInPanel"),
            F.coalesce("seenNames", empty).alias("seenNames"),
            "panelNames",
            F.coalesce("cellsWithCount", F.lit(0)).cast("bigint").alias("cellsWithCount"),
            F.when(F.col("_ref").isNull(), F.coalesce("bound", F.lit(0))).cast("double").alias("cellsAboveTheLine"),
            "medianCountPerCell",
            F.coalesce("_ref", F.lit(False)).alias("isReference"),
        )
    )


def sibling_disagreement(tag_states: DataFrame, scope: DataFrame, small: bool | None = None) -> DataFrame:
    """(panelId, tag, identity, siblings, rowCells, judged, siblingDisagreement).

    Per cell and identity the settled votes of its tags are added up once; a tag's own vote is taken off to get
    its siblings' majority, so no tag is paired with another. A sibling votes in a cell on its own reading, also
    where its sample placed it elsewhere.
    """
    members = scope.filter("grouped").select("panelId", "identity", "tag").distinct()
    sizes = members.groupBy("panelId", "identity").agg(F.count(F.lit(1)).alias("siblings"))
    here = scope.select("sampleId", "tag", "panelId", F.col("identity").alias("ownIdentity"))
    states = tag_states.select(*t.CELL, F.col("identity").alias("tag"), "state")
    placed = joins.lookup(states, here, ["sampleId", "tag"], "inner", small)
    settled = placed.filter(F.col("state").isin(t.SETTLED))
    votes = joins.lookup(settled, members, ["panelId", "tag"], "inner", small)
    cell = Window.partitionBy(*t.CELL, "identity")
    is_bound = F.when(F.col("state") == t.BOUND, 1).otherwise(0)
    others = F.count(F.lit(1)).over(cell) - 1
    others_bound = F.sum(is_bound).over(cell) - is_bound
    counted = votes.withColumn("n", others).withColumn("b", others_bound).filter("ownIdentity = identity")
    majority = F.when(F.col("b") * 2 > F.col("n"), t.BOUND).when((F.col("n") - F.col("b")) * 2 > F.col("n"), t.NOT_BOUND)
    judged = counted.withColumn("majority", majority).groupBy(*REAGENT).agg(
        F.count("majority").alias("judged"),
        F.count_if(F.col("majority") != F.col("state")).alias("against"),
    )
    held = placed.groupBy("panelId", "tag", F.col("ownIdentity").alias("identity")).agg(F.count(F.lit(1)).alias("rowCells"))
    rows = scope.select(*REAGENT).distinct()
    return (
        rows.join(sizes, ["panelId", "identity"], "left").join(judged, REAGENT, "left").join(held, REAGENT, "left")
        .select(
            *REAGENT,
            F.coalesce("siblings", F.lit(0)).cast("bigint").alias("siblings"),
            F.coalesce("rowCells", F.lit(0)).cast("bigint").alias("rowCells"),
            F.coalesce("judged", F.lit(0)).cast("bigint").alias("judged"),
            F.when((F.col("siblings") > 1) & (F.col("judged") > 0), F.col("against") / F.col("judged")).alias("siblingDisagreement"),
        )
    )


def reagents(measures: DataFrame, siblings: DataFrame, own: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """The reagent table: one row per (panel, tag, identity), every missing figure with its words.

    `own` is (panelId, tag, identity, selfDisagreement). `labels` maps sample ids to the names shown.
    """
    f = measures.join(siblings, REAGENT).join(own, REAGENT, "left")
    c, text = F.col, F.lit
    is_ref, sib, self_rate = c("isReference"), c("siblingDisagreement"), c("selfDisagreement")
    cause = (
        F.when(is_ref, "held out of the read")
        .when(c("siblings") < 2, "no sibling")
        .when(c("rowCells") == 0, "no cell beside a sibling")
        .otherwise("no sibling majority")
    )
    why = (
        F.when(is_ref, "this tag is held out of the verdict read")
        .when(c("siblings") < 2, "this identity carries one tag, so it has no sibling")
        .when(c("rowCells") == 0, "this tag holds no cell beside a sibling")
        .otherwise("no cell gave this tag's siblings a majority")
    )

    def names(column: str) -> Column:
        if not labels:
            return F.array_join(column, ", ")
        known = F.create_map(*[x for k in sorted(labels) for x in (F.lit(k), F.lit(labels[k]))])
        return F.array_join(F.transform(column, lambda s: F.coalesce(known[s], s)), ", ")

    return f.select(
        *REAGENT,
        "samplesSeenIn",
        "samplesInPanel",
        F.concat(c("samplesSeenIn").cast("string"), text("/"), c("samplesInPanel").cast("string")).alias("seenIn"),
        names("seenNames").alias("samplesSeenInNames"),
        names("panelNames").alias("samplesInPanelNames"),
        "cellsWithCount",
        "cellsAboveTheLine",
        "medianCountPerCell",
        sib.alias("siblingDisagreement"),
        F.when(sib.isNotNull(), percent_shown(sib)).otherwise(cause).alias("siblingDisagreementShown"),
        self_rate.alias("selfDisagreement"),
        F.when(self_rate.isNotNull(), percent_shown(self_rate)).otherwise(text("nothing to compare")).alias("selfDisagreementShown"),
        F.concat_ws(
            "|",
            F.when(c("cellsAboveTheLine").isNull(), "cellsAboveTheLine=none asked, this tag supplies the baseline"),
            F.when(c("medianCountPerCell").isNull(), "medianCountPerCell=no cell holds a count of this tag"),
            F.when(sib.isNull(), F.concat(text("siblingDisagreement="), why)),
            F.when(self_rate.isNull(), "selfDisagreement=no cell set held this tag under an evaluable read"),
        ).alias("reason"),
    )


def count_bins(counts: DataFrame, width: float = t.LOG1P_WIDTH) -> DataFrame:
    """(sampleId, tag, bin, weight): readings per bin of the log1p grid; empty bins are left out.

    The grid is absolute, so a bin's edges are expm1(bin * width) and expm1((bin + 1) * width) in every pair.
    """
    hist = counts.groupBy("sampleId", "tag", "umiCount").agg(F.count(F.lit(1)).alias("n"))
    return hist_bins(hist.withColumnRenamed("n", "cells"), width)


def hist_bins(histogram: DataFrame, width: float = t.LOG1P_WIDTH) -> DataFrame:
    """`count_bins` from a histogram (sampleId, tag, umiCount, cells), so that a fit's zeros are in it."""
    return (
        histogram.withColumn("bin", bins.log1p_bin(F.col("umiCount"), width))
        .groupBy("sampleId", "tag", "bin")
        .agg(F.sum("cells").cast("bigint").alias("weight"))
    )


def filled_bins(binned: DataFrame, shared: bool = True) -> DataFrame:
    """Empty bins as zero weights, up to the last bin of the run (`shared`) or of the pair."""
    last = binned.agg(F.max("bin")).scalar() if shared else None
    per_pair = binned.groupBy("sampleId", "tag").agg(F.max("bin").alias("top"))
    if shared:
        per_pair = per_pair.withColumn("top", last)
    grid = per_pair.select("sampleId", "tag", F.explode(F.sequence(F.lit(0), "top")).alias("bin"))
    return grid.join(binned, ["sampleId", "tag", "bin"], "left").fillna(0, ["weight"])


def score_spread(scores: DataFrame, count: int = t.LINEAR_BINS) -> DataFrame:
    """(bin, low, high, weight) of the pooled scores over `count` even bins, empty bins included."""
    merged = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    ends = scores.agg(F.min("score").alias("a"), F.max("score").alias("b"))
    a, b = ends.select("a").scalar(), ends.select("b").scalar()
    placed = merged.withColumn("a", a).withColumn("b", b)
    binned = placed.withColumn("bin", bins.linear_bin(F.col("score"), F.col("a"), F.col("b"), count)).groupBy("bin").agg(F.sum("n").alias("weight"))
    grid = ends.filter("a is not null").select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("bin"))
    return grid.join(binned, "bin", "left").select(
        "bin",
        bins.linear_edge(F.col("bin"), F.col("a"), F.col("b"), count).alias("low"),
        bins.linear_edge(F.col("bin") + 1, F.col("a"), F.col("b"), count).alias("high"),
        F.coalesce("weight", F.lit(0)).cast("bigint").alias("weight"),
    )


def reference_spread(reference: DataFrame, width: float = t.LOG1P_WIDTH) -> DataFrame:
    """(bin, low, high, weight) of the pooled reference readings on the log1p grid, empty bins included."""
    merged = reference.groupBy("referenceCount").agg(F.count(F.lit(1)).alias("n"))
    binned = merged.withColumn("bin", bins.log1p_bin(F.col("referenceCount"), width)).groupBy("bin").agg(F.sum("n").alias("weight"))
    grid = binned.agg(F.max("bin").alias("top")).filter("top is not null").select(F.explode(F.sequence(F.lit(0), "top")).alias("bin"))
    return grid.join(binned, "bin", "left").select(
        "bin",
        F.expm1(F.col("bin") * F.lit(width)).alias("low"),
        F.expm1((F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("weight", F.lit(0)).cast("bigint").alias("weight"),
    )


VALUES_PER_TASK_ROW = 100_000


def values_from_bins(binned: DataFrame) -> DataFrame:
    """One value per observation, spread evenly inside its bin; from (low, high, weight) rows.

    A heavy bin is cut into runs of bounded length that are spread over the tasks before they are unfolded.
    """
    step = (F.col("high") - F.col("low")) / F.col("weight")
    keys = [c for c in binned.columns if c not in ("low", "high", "weight")]
    size = F.lit(VALUES_PER_TASK_ROW).cast("bigint")
    runs = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("weight") - 1) / size))
    last = F.least(F.col("weight"), (F.col("run") + 1) * size) - 1
    cut = binned.filter("weight > 0").select(*keys, "low", "weight", step.alias("step"), F.explode(runs).alias("run"))
    return (
        cut.repartition(*[F.col(f"`{k}`") for k in keys], "low", "run")
        .select(*keys, "low", "step", F.explode(F.sequence(F.col("run") * size, last)).alias("j"))
        .select(*keys, (F.col("low") + (F.col("j") + 0.5) * F.col("step")).alias("value"))
    )


def run_log(read_qc: DataFrame) -> DataFrame:
    """One row: samples, sums, medians, the range of the panel-assigned share, and the samples without a cell."""
    cells = F.coalesce("cellsDetected", F.lit(0))
    return read_qc.agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.sum("readsTotal"), F.lit(0)).cast("bigint").alias("readsTotal"),
        F.percentile("matchedFraction", 0.5).alias("medianMatched"),
        F.percentile("panelAssignedFraction", 0.5).alias("medianAssigned"),
        F.min("panelAssignedFraction").alias("lowestAssigned"),
        F.max("panelAssignedFraction").alias("highestAssigned"),
        F.sum(cells).cast("bigint").alias("cellsDetected"),
        F.max(F.coalesce("featuresDetected", F.lit(0))).cast("bigint").alias("features"),
        F.count_if(cells == 0).alias("flagged"),
        F.array_join(F.array_sort(F.collect_set(F.when(cells == 0, F.col("sampleId")))), ", ").alias("flaggedSamples"),
    )
