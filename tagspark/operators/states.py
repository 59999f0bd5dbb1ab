"""From counts to a state per (cell, identity): floor, reference, gate, score.

`refs` is (tag), `cells` is the analysed (sampleId, cellId), `reference` is (sampleId, cellId, referenceCount).
Lookup tables that come from the panel are matched through `joins.lookup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import joins
from ..functions import terms as t
from ..functions.score import ZERO_COUNT_SCORE, count_to_reach_column, reaches, specificity_score


def check_settings(
    floor: int = t.FLOOR,
    cutoff: float = t.CUTOFF,
    bound_probability: float = t.BOUND_PROBABILITY,
    min_voters: int = t.MIN_VOTERS,
    min_agreement: float | None = None,
    initial_signal_weight: float | None = None,
    min_cells: int = t.FIT_MIN_CELLS,
    contending: list[list[str]] = (),
) -> None:
    """Refuse settings under which a silent cell could not be counted by arithmetic, or that mean nothing."""
    if floor < 0:
        raise ValueError("the minimum count cannot be negative")
    if not ZERO_COUNT_SCORE < cutoff <= 100.0:
        raise ValueError(f"the cutoff must be above {ZERO_COUNT_SCORE:.4f}, the best score of a zero count, and at most 100")
    if not t.BOUND_PROBABILITY <= bound_probability <= 1.0:
        raise ValueError(f"the bound probability must be within [{t.BOUND_PROBABILITY}, 1]")
    if min_voters < 1:
        raise ValueError("at least one voter is needed")
    if min_agreement is not None and not 0.5 < min_agreement <= 1.0:
        raise ValueError("the agreement must be above 0.5 and at most 1")
    if initial_signal_weight is not None and not 0.0 < initial_signal_weight < 1.0:
        raise ValueError("the expected binder fraction lies strictly between 0 and 1")
    if min_cells < 1:
        raise ValueError("a fit needs at least one cell")
    for group in contending:
        if isinstance(group, str) or not all(isinstance(m, str) for m in group):
            raise ValueError(f"a contending group is a list of identities; got {group!r}")
        if len(group) < 2:
            raise ValueError(f"contending group {group!r} has fewer than two members")


def mark_references(counts: DataFrame, refs: DataFrame, small: bool | None = None) -> DataFrame:
    """Counts with `isReference`."""
    flagged = refs.select("tag").distinct().withColumn("_ref", F.lit(True))
    return (
        joins.lookup(counts, flagged, ["tag"], "left", small)
        .withColumn("isReference", F.coalesce("_ref", F.lit(False)))
        .drop("_ref")
    )


def floored_count(floor: int) -> Column:
    """The count after the floor, for rows that carry `isReference`."""
    below = (F.col("umiCount") < floor) & ~F.col("isReference")
    return F.when(below, F.lit(0)).otherwise(F.col("umiCount")).cast("bigint")


def apply_floor(counts: DataFrame, floor: int, refs: DataFrame, small: bool | None = None) -> DataFrame:
    """Counts below the floor read as 0; reference tags are exempt and a floor of 0 changes nothing."""
    if floor <= 0:
        return counts
    marked = mark_references(counts, refs, small)
    return marked.withColumn("umiCount", floored_count(floor)).drop("isReference")


def floor_stats(counts: DataFrame, floor: int, refs: DataFrame, small: bool | None = None) -> DataFrame:
    """(sampleId, readingsFloored, cellsEmptied, cellsWithAntigenReadings) over non-reference readings."""
    own = mark_references(counts, refs, small).filter(~F.col("isReference"))
    per_cell = own.groupBy(*t.CELL).agg(
        F.count_if(F.col("umiCount") < floor).alias("below"),
        F.max(F.when(F.col("umiCount") >= floor, F.col("umiCount")).otherwise(0)).alias("kept"),
    )
    emptied = F.count_if(F.col("kept") <= 0) if floor > 0 else F.lit(0).cast("bigint")
    floored = F.sum("below").cast("bigint") if floor > 0 else F.lit(0).cast("bigint")
    return per_cell.groupBy("sampleId").agg(
        floored.alias("readingsFloored"),
        emptied.alias("cellsEmptied"),
        F.count(F.lit(1)).alias("cellsWithAntigenReadings"),
    )


def cells_reading_nothing(floored: DataFrame, cells: DataFrame) -> DataFrame:
    """Of `cells`, those left with no count above zero on any tag, reference tags included."""
    reading = floored.filter(F.col("umiCount") > 0).select(*t.CELL)
    return cells.select(*t.CELL).distinct().join(reading, t.CELL, "left_anti")


def served_source(source: str, has_references: bool, panel_size: int, min_members: int = t.PANEL_MIN_MEMBERS) -> str:
    """The baseline asked for, or a refusal naming what it lacks. Nothing falls back to another one."""
    if source not in ("declared", "panel", "distribution"):
        raise ValueError(f"unknown baseline {source!r}")
    if source == "declared" and not has_references:
        raise ValueError("the declared baseline was asked for and the panel declares no reference tag")
    if source == "panel" and panel_size < min_members:
        raise ValueError(f"the panel baseline was asked for with {panel_size} tags; it needs {min_members}")
    return source


def panel_size(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count_distinct("tag").alias("panelSize"))


def _over_cells(found: DataFrame, cells: DataFrame | None) -> DataFrame:
    if cells is None:
        return found
    return (
        cells.select(*t.CELL).distinct().join(found, t.CELL, "left")
        .select(*t.CELL, F.coalesce("referenceCount", F.lit(0)).cast("bigint").alias("referenceCount"))
    )


def reference_declared(counts: DataFrame, refs: DataFrame, cells: DataFrame | None = None, small: bool | None = None) -> DataFrame:
    """Per cell the highest raw count over the reference tags; 0 for a cell that shows none."""
    marked = mark_references(counts, refs, small)
    own = F.max(F.when(F.col("isReference"), F.col("umiCount")))
    found = joins.dealt(marked, t.CELL, counts.count()).groupBy(*t.CELL).agg(F.coalesce(own, F.lit(0)).cast("bigint").alias("referenceCount"))
    return _over_cells(found, cells)


def reference_panel_median(counts: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Per cell the median of its observed raw counts, truncated; 0 for a cell without any."""
    found = counts.groupBy(*t.CELL).agg(F.percentile("umiCount", 0.5).cast("bigint").alias("referenceCount"))
    return _over_cells(found, cells)


def gate_cells(reference: DataFrame, threshold: int | None) -> DataFrame:
    """Cells whose reference reads strictly above the threshold; none without a threshold."""
    if threshold is None:
        return reference.select(*t.CELL).filter(F.lit(False))
    return reference.filter(F.col("referenceCount") > threshold).select(*t.CELL)


def cells_over_limit(counts: DataFrame, refs: DataFrame, threshold: int | None, small: bool | None = None) -> DataFrame:
    """`gate_cells` under a declared reference, straight from the counts.

    A cell's highest reference reading is above the limit where any of them is, so the limit is a filter on the scan
    and only the cells set aside are shuffled.
    """
    if threshold is None:
        return counts.select(*t.CELL).filter(F.lit(False))
    high = counts.select(*t.CELL, "tag", "umiCount").filter(F.col("umiCount") > threshold)
    return joins.lookup(high, refs.select("tag").distinct(), ["tag"], "left_semi", small).select(*t.CELL).distinct()


def cells_high(reference: DataFrame, threshold: int | None) -> DataFrame:
    """(cellsHighReference): null without a threshold or without any reading."""
    n = F.count_if(F.col("referenceCount") > threshold) if threshold is not None else F.lit(None)
    return reference.agg(F.when(F.count(F.lit(1)) > 0, n).cast("bigint").alias("cellsHighReference"))


def with_identity(counts: DataFrame, grouping: DataFrame, small: bool | None = None) -> DataFrame:
    """Counts with their identity in their own sample: a declaration for the sample first, one for all fills."""
    own = grouping.filter(F.col("sample") != t.ANY_SAMPLE).select(F.col("sample").alias("sampleId"), "tag", F.col("identity").alias("_own"))
    every = grouping.filter(F.col("sample") == t.ANY_SAMPLE).select("tag", F.col("identity").alias("_every"))
    keyed = joins.lookup(counts, own, ["sampleId", "tag"], "left", small)
    return joins.lookup(keyed, every, ["tag"], "left", small).withColumn("identity", F.coalesce("_own", "_every")).drop("_own", "_every")


def combine_tags(floored: DataFrame, grouping: DataFrame, small: bool | None = None) -> DataFrame:
    """(sampleId, cellId, identity, umiCount): the highest count over the identity's tags, never the sum."""
    placed = with_identity(floored.select(*t.CELL, "tag", "umiCount"), grouping, small).filter("identity is not null")
    return (
        joins.dealt(placed, [*t.CELL, "identity"], floored.count())
        .groupBy(*t.CELL, "identity")
        .agg(F.max("umiCount").alias("umiCount"))
    )


def state_column(cutoff: float) -> Column:
    """State of a row carrying umiCount, referenceCount and unreliableReason."""
    return (
        F.when(F.col("unreliableReason").isNotNull(), t.UNRELIABLE)
        .when(reaches(F.col("umiCount"), F.coalesce("referenceCount", F.lit(0)), cutoff), t.BOUND)
        .otherwise(t.NOT_BOUND)
    )


def reason_column(threshold: int | None) -> Column:
    """Why a cell cannot be compared, from its referenceCount: the gate first, then a missing comparator."""
    missing = F.when(F.col("referenceCount").isNull(), t.NO_COMPARATOR)
    if threshold is None:
        return missing
    return F.when(F.col("referenceCount") > threshold, t.GATED).otherwise(missing)


STATE_COLUMNS = [*t.CELL, "identity", "umiCount", "referenceCount", "state", "unreliableReason"]


def read_states(identities: DataFrame, reference: DataFrame, threshold: int | None = None, cutoff: float = t.CUTOFF) -> DataFrame:
    """State per (cell, identity) against a per-cell reference. A cell without a reference row has no comparator."""
    return (
        identities.join(reference, t.CELL, "left")
        .withColumn("unreliableReason", reason_column(threshold))
        .withColumn("state", state_column(cutoff))
        .select(*STATE_COLUMNS)
    )


def read_states_probability(
    identities: DataFrame, probabilities: DataFrame, gated: DataFrame, p_cut: float = t.BOUND_PROBABILITY, rows: int = 0
) -> DataFrame:
    """State per (cell, identity) from its probability; a position without one has no comparator.

    `rows` is how many identities there are at most, to deal them by cell for what follows."""
    set_aside = gated.select(*t.CELL).distinct().withColumn("_gated", F.lit(True))
    return (
        joins.dealt(identities.join(probabilities, [*t.CELL, "identity"], "left"), t.CELL, rows)
        .join(set_aside, t.CELL, "left")
        .withColumn("unreliableReason", F.when(F.col("_gated"), t.GATED).when(F.col("pBound").isNull(), t.NO_COMPARATOR))
        .withColumn(
            "state",
            F.when(F.col("unreliableReason").isNotNull(), t.UNRELIABLE)
            .when(F.col("pBound") >= p_cut, t.BOUND)
            .otherwise(t.NOT_BOUND),
        )
        .withColumn("referenceCount", F.lit(None).cast("bigint"))
        .select(*STATE_COLUMNS)
    )


def states_from_counts(
    counts: DataFrame,
    grouping: DataFrame,
    refs: DataFrame,
    source: str = "declared",
    floor: int = t.FLOOR,
    cutoff: float = t.CUTOFF,
    threshold: int | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Floor, reference, identities and states in one pass over the counts.

    The reference of a cell is a window over the cell and the identities are groups within it, so one shuffle by
    cell serves both. A cell's rows number at most its panel's tags.
    """
    cell = Window.partitionBy(*t.CELL)
    marked = mark_references(with_identity(counts.select(*t.CELL, "tag", "umiCount"), grouping, small), refs, small)
    marked = joins.dealt(marked, t.CELL, counts.count())
    if source == "declared":
        reference = F.max(F.when(F.col("isReference"), F.col("umiCount")).otherwise(0)).over(cell)
    else:
        reference = F.percentile("umiCount", 0.5).over(cell)
    return (
        marked.withColumn("referenceCount", reference.cast("bigint"))
        .filter(F.col("identity").isNotNull() & ~F.col("isReference"))
        .withColumn("umiCount", floored_count(floor))
        .groupBy(*t.CELL, "identity")
        .agg(F.max("umiCount").alias("umiCount"), F.max("referenceCount").alias("referenceCount"))
        .withColumn("unreliableReason", reason_column(threshold))
        .withColumn("state", state_column(cutoff))
        .select(*STATE_COLUMNS)
    )


def cell_admissibility(reference: DataFrame, threshold: int | None, keyed_by_cell: bool = True) -> DataFrame:
    """(sampleId, cellId, referenceCount, admissibility): the cell's own part of the reason."""
    reason = reason_column(threshold)
    if not keyed_by_cell:
        reason = F.when(F.col("referenceCount") > threshold, t.GATED) if threshold is not None else F.lit(None).cast("string")
    return reference.select(*t.CELL, "referenceCount", F.coalesce(reason, F.lit("admissible")).alias("admissibility"))


def with_score(states: DataFrame) -> DataFrame:
    """The exported score of every reliable reading."""
    return states.filter("unreliableReason is null").withColumn(
        "score", specificity_score(F.col("umiCount"), F.coalesce("referenceCount", F.lit(0)))
    )


def score_by_sample(scored: DataFrame, cutoff: float = t.CUTOFF) -> DataFrame:
    """(sampleId, medianAntigenReading, cutoffCountNeeded, boundReadingShare) over reliable listed readings."""
    antigen = joins.group_percentile(scored, ["sampleId"], "umiCount", 0.5, "medianAntigenReading")
    baseline = joins.group_percentile(
        scored.withColumn("referenceCount", F.coalesce("referenceCount", F.lit(0))), ["sampleId"], "referenceCount", 0.5, "baseline"
    )
    bound = scored.groupBy("sampleId").agg((F.count_if(F.col("state") == t.BOUND) / F.count(F.lit(1))).alias("boundReadingShare"))
    return (
        antigen.join(baseline, "sampleId")
        .join(bound, "sampleId")
        .select(
            "sampleId",
            "medianAntigenReading",
            count_to_reach_column(F.col("baseline"), cutoff).alias("cutoffCountNeeded"),
            "boundReadingShare",
        )
    )
