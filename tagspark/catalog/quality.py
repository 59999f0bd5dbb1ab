"""Quality measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import quality as Q
from ..operators import reads as R
from ..operators import states as X
from ..plans import roles
from ..sources.sinks import stage
from .base import Bed, aggregate_sql, query, r6, rounded, score_sql
from .inputs import BedReads, bed_read_qc, whole_run

_ROUNDED_QC = ["matchedFraction", "panelAssignedFraction", "featureDroppedShare", "cellBarcodeValidFraction", "aggregateBarcodeFraction"]
_QC_COLUMNS = ", ".join(f'round("{c}", 6) AS "{c}"' for c in _ROUNDED_QC)


@query(f"""SELECT "sampleId", "readsTotal", "readsMatched", "cellsDetected", "featuresDetected", "totalUniqueUmis", "medianUmisPerCell",
    "cellBarcodeIn", "cellBarcodeOut", "aggregateBarcodesFlagged", "aggregateBarcodeThreshold", {_QC_COLUMNS} FROM readqc""")
def read_qc(spark, sf):
    return rounded(bed_read_qc(spark, sf), *_ROUNDED_QC)


def barcode_totals(spark, sf):
    """Counts per cell, with reads, as the whole barcode universe of each sample."""
    return Q.per_barcode_totals(roles.tag_statistics(spark, sf))


_BARCODES = """SELECT "sampleId", "cellId" AS barcode, CAST(sum("umiCount") AS BIGINT) AS "umiCount", CAST(sum("totalWeight") AS BIGINT) AS "readCount" FROM counts GROUP BY 1, 2"""
_OUTLIERS = aggregate_sql(0.5, 10.0, 100).replace("FROM barcodes", f"FROM ({_BARCODES})")


@query(f"SELECT * FROM ({_BARCODES})")
def per_barcode_totals(spark, sf):
    return barcode_totals(spark, sf)


@query(_OUTLIERS)
def aggregate_barcodes(spark, sf):
    """Outlying barcodes among each sample's heaviest hundred, under a rule tight enough to flag some."""
    return Q.aggregate_barcodes(barcode_totals(spark, sf), 0.5, 10.0, 100)


def _grouped(number: str) -> str:
    return f"format('{{:,}}', CAST({number} AS BIGINT))"


@query(f"""SELECT s."sampleId", round(o."flaggedReads" / s.n, 6) AS value, 'Barcodes tested: ' || {_grouped("o.tested")} || '|Threshold: ' || {_grouped("round_even(o.threshold, 0)")}
    || ' UMIs|Barcodes flagged: ' || {_grouped("o.flagged")} AS detail FROM (SELECT "sampleId", sum("totalWeight") AS n FROM counts GROUP BY 1) s JOIN ({_OUTLIERS}) o ON o."sampleId" = s."sampleId\"""")
def aggregate_barcode_fraction(spark, sf):
    totals = roles.counts(spark, sf).groupBy("sampleId").agg(F.sum("totalWeight").alias("readsTotal"))
    flagged = Q.aggregate_barcodes(barcode_totals(spark, sf), 0.5, 10.0, 100)
    return rounded(Q.aggregate_barcode_fraction(flagged, totals, 10.0), "value")


_USABLE = """SELECT l."sampleId", CAST(coalesce(sum(k.w), 0) AS BIGINT) AS usable, count(*) AS "listedCells" FROM listed l LEFT JOIN (
    SELECT "sampleId", "cellId", sum("totalWeight") AS w FROM counts GROUP BY 1, 2) k ON k."sampleId" = l."sampleId" AND k."cellId" = l."cellId" GROUP BY 1"""
_TOTALS = """SELECT "sampleId", CAST(sum("totalWeight") AS BIGINT) AS n FROM counts GROUP BY 1"""


@query(_USABLE)
def usable_reads(spark, sf):
    return Q.usable_reads(roles.counts(spark, sf), roles.cell_list(spark, sf))


@query(f"""SELECT t."sampleId", round(u.usable / t.n, 6) AS value, {_grouped("u.usable")} || ' out of ' || {_grouped("t.n")} || ' reads parsed' AS detail
    FROM ({_TOTALS}) t JOIN ({_USABLE}) u ON u."sampleId" = t."sampleId\"""")
def usable_read_fraction(spark, sf):
    counts = stage(roles.counts(spark, sf), "counts")
    totals = counts.groupBy("sampleId").agg(F.sum("totalWeight").alias("readsTotal"))
    return rounded(Q.usable_read_fraction(totals, Q.usable_reads(counts, roles.cell_list(spark, sf))), "value")


@query(f'SELECT "sampleId", round(usable / "listedCells", 6) AS "readsPerCell" FROM ({_USABLE})')
def reads_per_cell(spark, sf):
    return rounded(Q.reads_per_cell(Q.usable_reads(roles.counts(spark, sf), roles.cell_list(spark, sf))), "readsPerCell")


def marked_sequences(spark, sf):
    return BedReads(spark, sf).marked_sequences


@query('SELECT "sampleId", "totalWeight", "undeclaredWeight", "undeclaredDistinct", round("undeclaredShare", 6) AS "undeclaredShare", elided FROM tally')
def undeclared_tally(spark, sf):
    return rounded(Q.undeclared_tally(marked_sequences(spark, sf)), "undeclaredShare")


_HEAVIEST = """SELECT "sampleId", "FEATURE" AS tag, "totalWeight" FROM (SELECT *, row_number() OVER (PARTITION BY "sampleId" ORDER BY "totalWeight" DESC, "FEATURE") AS rn
    FROM marked WHERE NOT declared) WHERE rn <= 1000"""


@query(_HEAVIEST)
def heaviest_undeclared(spark, sf):
    return Q.heaviest_undeclared(marked_sequences(spark, sf))


@query(f"""SELECT h."sampleId", h.tag, h."totalWeight", round(h."totalWeight" / t."totalWeight", 6) AS "barcodeShare", round(q."featureDroppedShare", 6) AS "readShare",
    CASE WHEN h."totalWeight" / t."totalWeight" > 0.05 THEN 'alert' WHEN h."totalWeight" / t."totalWeight" > 0.01 THEN 'warn' ELSE 'OK' END AS status
    FROM ({_HEAVIEST}) h JOIN tally t ON t."sampleId" = h."sampleId" JOIN readqc q ON q."sampleId" = h."sampleId\"""")
def undeclared_barcodes(spark, sf):
    reads = BedReads(spark, sf)
    marked = stage(reads.marked_sequences, "marked")
    out = Q.undeclared_barcodes(Q.heaviest_undeclared(marked), Q.undeclared_tally(marked), reads.read_qc, Q.lines_table(spark))
    return rounded(out, "barcodeShare", "readShare")


@query("""SELECT t."sampleId", round(CASE WHEN t."undeclaredShare" - q."featureDroppedShare" >= -1e-9 THEN greatest(t."undeclaredShare" - q."featureDroppedShare", 0) END, 6) AS "refineRescuedShare"
    FROM tally t JOIN readqc q ON q."sampleId" = t."sampleId\"""")
def rescued_share(spark, sf):
    reads = BedReads(spark, sf)
    both = Q.undeclared_tally(reads.marked_sequences).join(reads.read_qc.select("sampleId", "featureDroppedShare"), "sampleId")
    return both.select("sampleId", r6(Q.rescued_share(F.col("undeclaredShare"), F.col("featureDroppedShare"))).alias("refineRescuedShare"))


_READINGS_SQL = """SELECT m.measurement, v.value FROM (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN CAST(NULL AS DOUBLE) WHEN l_linenumber = 2 THEN l_discount * 10
    WHEN l_linenumber = 3 THEN l_quantity * 200 ELSE l_discount END AS value FROM lineitem) v, (VALUES ('matchedFraction'), ('cellBarcodeValidFraction'), ('panelAssignedFraction'),
    ('refineRescuedShare'), ('aggregateBarcodeFraction'), ('uniqueCountsPerCell'), ('usableReadFraction'), ('readsPerCell'), ('undeclaredBarcodeShare'), ('cellsDetected'), ('floorRemoved')) m(measurement)"""
_STATUS_SQL = f"""SELECT measurement, value, CASE WHEN value IS NULL THEN NULL
    WHEN measurement = 'cellsDetected' THEN CASE WHEN value = 0 THEN 'alert' ELSE 'OK' END
    WHEN measurement = 'matchedFraction' THEN CASE WHEN value < 0.5 THEN 'alert' WHEN value < 0.9 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'cellBarcodeValidFraction' THEN CASE WHEN value < 0.75 THEN 'alert' WHEN value < 0.95 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'panelAssignedFraction' THEN CASE WHEN value = 0 THEN 'alert' WHEN value < 0.5 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'refineRescuedShare' THEN CASE WHEN value > 0.1 THEN 'alert' WHEN value > 0.05 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'aggregateBarcodeFraction' THEN CASE WHEN value = 1 THEN 'alert' WHEN value > 0.05 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'uniqueCountsPerCell' THEN CASE WHEN value = 1 THEN 'alert' WHEN value < 4 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'usableReadFraction' THEN CASE WHEN value = 0 THEN 'alert' WHEN value < 0.2 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'readsPerCell' THEN CASE WHEN value < 5000 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'undeclaredBarcodeShare' THEN CASE WHEN value > 0.05 THEN 'alert' WHEN value > 0.01 THEN 'warn' ELSE 'OK' END END AS status FROM ({_READINGS_SQL})"""


def readings(spark, sf):
    """Values from the line items, each read as every measurement."""
    n = F.col("l_linenumber")
    value = F.when(n == 1, None).when(n == 2, F.col("l_discount") * 10).when(n == 3, F.col("l_quantity") * 200).otherwise(F.col("l_discount"))
    names = [line[0] for line in Q.LINES] + ["cellsDetected", "floorRemoved"]
    values = roles.table(spark, sf, "lineitem").select(value.alias("value")).distinct()
    return values.select(F.explode(F.array(*[F.lit(m) for m in names])).alias("measurement"), "value")


@query(_STATUS_SQL)
def with_status(spark, sf):
    return Q.with_status(readings(spark, sf), Q.lines_table(spark)).select("measurement", "value", "status")


@query("""SELECT o_orderpriority AS "sampleId", v AS value, CASE WHEN v < 0.5 THEN 'alert' WHEN v < 0.92 THEN 'warn' ELSE 'OK' END AS status
    FROM (SELECT DISTINCT o_orderpriority, l_discount * 10 AS v FROM ol)""")
def lines_overridden(spark, sf):
    """A measure's thresholds moved: warn at 0.92."""
    values = roles.order_lines(spark, sf).select(F.col("o_orderpriority").alias("sampleId"), (F.col("l_discount") * 10).alias("value")).distinct()
    judged = Q.with_status(values.withColumn("measurement", F.lit("matchedFraction")), Q.lines_table(spark, {"matchedFraction": (0.92, 0.5)}))
    return judged.select("sampleId", "value", "status")


@query(f"""SELECT measurement, CASE max(CASE status WHEN 'alert' THEN 2 WHEN 'warn' THEN 1 WHEN 'OK' THEN 0 END) WHEN 2 THEN 'alert' WHEN 1 THEN 'warn' WHEN 0 THEN 'OK' END AS status,
    count(status) AS judged, count(*) FILTER (WHERE status IS NULL AND value IS NOT NULL) AS unjudged, count(*) FILTER (WHERE status IS NULL AND value IS NULL) AS "notEvaluated"
    FROM ({_STATUS_SQL}) GROUP BY 1""")
def roll_up(spark, sf):
    return Q.roll_up(Q.with_status(readings(spark, sf), Q.lines_table(spark)), ["measurement"])


_LISTED_REF = 'SELECT f.* FROM ref f JOIN listed l ON l."sampleId" = f."sampleId" AND l."cellId" = f."cellId"'


@query(f'SELECT "sampleId", count(*) FILTER (WHERE "referenceCount" > 40) AS "cellsSetAside" FROM ({_LISTED_REF}) GROUP BY 1')
def cells_set_aside(spark, sf):
    bed = Bed(spark, sf)
    return Q.cells_set_aside(C.listed(bed.reference, bed.cell_list), roles.GATE)


@query(f"""SELECT "sampleId", median("referenceCount") AS "medianControlReading", count(*) FILTER (WHERE "referenceCount" > 0) AS "nonzeroCells", count(*) AS cells
    FROM ({_LISTED_REF}) GROUP BY 1""")
def median_control_reading(spark, sf):
    bed = Bed(spark, sf)
    return Q.median_control_reading(stage(C.listed(bed.reference, bed.cell_list), "listed"))


def sample_readings(bed: Bed, reads: BedReads):
    spark, sf = bed.spark, bed.sf
    reference = stage(bed.reference, "reference")
    scored = stage(C.listed(bed.states.filter("unreliableReason is null"), bed.cell_list), "scored")
    return Q.sample_measures(
        roles.samples(spark, sf), bed.counts, 4, X.floor_stats(bed.counts, 4, bed.refs, bed.small), bed.cell_list, reads.read_qc,
        stage(Q.undeclared_tally(reads.marked_sequences), "tally"), reference, roles.GATE, X.score_by_sample(scored),
    )


_MEASURE_ROWS = f"""AND u AS ({_USABLE}), lc AS (SELECT k.* FROM counts k JOIN listed l ON l."sampleId" = k."sampleId" AND l."cellId" = k."cellId"),
    cu AS (SELECT "sampleId", median(t) AS med, count(*) AS n FROM (SELECT "sampleId", "cellId", sum("umiCount") AS t FROM lc GROUP BY 1, 2) GROUP BY 1),
    fl AS (SELECT "sampleId", CAST(sum(low) AS BIGINT) AS f, count(*) FILTER (WHERE NOT kept) AS e, count(*) AS w FROM (SELECT "sampleId", "cellId",
        count(*) FILTER (WHERE "umiCount" < 4) AS low, bool_or("umiCount" >= 4) AS kept FROM counts WHERE tag NOT IN (SELECT tag FROM refs) GROUP BY 1, 2) GROUP BY 1),
    rf AS (SELECT "sampleId", count(*) FILTER (WHERE "referenceCount" > 40) AS g, median("referenceCount") AS med, count(*) FILTER (WHERE "referenceCount" > 0) AS nz, count(*) AS n FROM ({_LISTED_REF}) GROUP BY 1),
    sm AS (SELECT t."sampleId", median(t."umiCount") AS a, median(t."referenceCount") AS r, count(*) FILTER (WHERE t.state = 'bound') / count(*) AS b FROM states t
        JOIN listed l ON l."sampleId" = t."sampleId" AND l."cellId" = t."cellId" WHERE t."unreliableReason" IS NULL GROUP BY 1),
    sc AS (SELECT "sampleId", a, b, (SELECT min(n) FROM range(0, 4000) t(n) WHERE {score_sql("n", "CAST(sm.r AS BIGINT)")} >= 75) AS c FROM sm),
    rows AS (
    SELECT "sampleId", 'matchedFraction' AS measurement, "matchedFraction" AS value, {_grouped('"readsMatched"')} || ' out of ' || {_grouped('"readsTotal"')} || ' reads parsed' AS detail FROM readqc
    UNION ALL SELECT "sampleId", 'cellBarcodeValidFraction', "cellBarcodeValidFraction", {_grouped('"cellBarcodeIn"')} || ' reads entered correction, ' || {_grouped('"cellBarcodeOut"')} || ' passed' FROM readqc
    UNION ALL SELECT "sampleId", 'panelAssignedFraction', "panelAssignedFraction", NULL FROM readqc
    UNION ALL SELECT "sampleId", 'cellsDetected', "cellsDetected", NULL FROM readqc
    UNION ALL SELECT "sampleId", 'aggregateBarcodeFraction', "aggregateBarcodeFraction", 'Threshold set at ' || {_grouped('round_even("aggregateBarcodeThreshold", 0)')} || ' UMIs' FROM readqc
    UNION ALL SELECT q."sampleId", 'refineRescuedShare', greatest(t."undeclaredShare" - q."featureDroppedShare", 0), NULL FROM readqc q JOIN tally t ON t."sampleId" = q."sampleId"
    UNION ALL SELECT "sampleId", 'uniqueCountsPerCell', med, 'V(D)J-matched cells with a reading: ' || {_grouped("n")} FROM cu
    UNION ALL SELECT u."sampleId", 'usableReadFraction', u.usable / q."readsTotal", {_grouped("u.usable")} || ' out of ' || {_grouped('q."readsTotal"')} || ' reads parsed' FROM u JOIN readqc q ON q."sampleId" = u."sampleId"
    UNION ALL SELECT "sampleId", 'readsPerCell', usable / "listedCells", NULL FROM u
    UNION ALL SELECT "sampleId", 'floorRemoved', f, 'Minimum count is set to 4 (Settings > Binding thresholds)|Cell barcodes left with nothing above zero: ' || {_grouped("e")} || ' out of ' || {_grouped("w")} FROM fl
    UNION ALL SELECT "sampleId", 'cellsSetAside', g, 'Sticky cell limit set at 40 UMIs' FROM rf
    UNION ALL SELECT "sampleId", 'medianControlReading', med, {_grouped("nz")} || ' of ' || {_grouped("n")} || ' cells carry a non-zero control count' FROM rf
    UNION ALL SELECT "sampleId", 'medianAntigenReading', a, NULL FROM sc
    UNION ALL SELECT "sampleId", 'cutoffCountNeeded', c, NULL FROM sc
    UNION ALL SELECT "sampleId", 'boundReadingShare', b, NULL FROM sc)"""


@query(_MEASURE_ROWS + ' SELECT "sampleId", measurement, round(CAST(value AS DOUBLE), 6) AS value, detail FROM rows')
def sample_measures(spark, sf):
    """Every reading of every sample."""
    rows = sample_readings(Bed(spark, sf), BedReads(spark, sf))
    return rounded(rows.select("sampleId", "measurement", "value", "detail"), "value")


def full_report(spark, sf, reads: BedReads | None = None):
    return stage(Q.sample_report(sample_readings(Bed(spark, sf), reads or BedReads(spark, sf)), roles.samples(spark, sf), Q.lines_table(spark)), "report")


_JUDGED = """CASE WHEN measurement = 'cellsDetected' THEN CASE WHEN value = 0 THEN 'alert' ELSE 'OK' END
    WHEN measurement = 'matchedFraction' THEN CASE WHEN value < 0.5 THEN 'alert' WHEN value < 0.9 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'cellBarcodeValidFraction' THEN CASE WHEN value < 0.75 THEN 'alert' WHEN value < 0.95 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'panelAssignedFraction' THEN CASE WHEN value = 0 THEN 'alert' WHEN value < 0.5 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'refineRescuedShare' THEN CASE WHEN value > 0.1 THEN 'alert' WHEN value > 0.05 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'aggregateBarcodeFraction' THEN CASE WHEN value = 1 THEN 'alert' WHEN value > 0.05 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'uniqueCountsPerCell' THEN CASE WHEN value = 1 THEN 'alert' WHEN value < 4 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'usableReadFraction' THEN CASE WHEN value = 0 THEN 'alert' WHEN value < 0.2 THEN 'warn' ELSE 'OK' END
    WHEN measurement = 'readsPerCell' THEN CASE WHEN value < 5000 THEN 'warn' ELSE 'OK' END END"""


@query(_MEASURE_ROWS + f""" SELECT "sampleId", measurement, round(CAST(value AS DOUBLE), 6) AS value, detail, CAST(NULL AS VARCHAR) AS reason, {_JUDGED} AS status FROM rows""")
def sample_report(spark, sf):
    rows = full_report(spark, sf)
    return rounded(rows.select("sampleId", "measurement", "value", "detail", "reason", "status"), "value")


@query(_MEASURE_ROWS + f""" SELECT "sampleId", CASE max(CASE {_JUDGED} WHEN 'alert' THEN 2 WHEN 'warn' THEN 1 WHEN 'OK' THEN 0 END) WHEN 2 THEN 'alert' WHEN 1 THEN 'warn' WHEN 0 THEN 'OK' END AS status,
    count({_JUDGED}) AS judged, count(*) - count({_JUDGED}) AS unjudged, CAST(0 AS BIGINT) AS "notEvaluated", string_agg(measurement || ':' || CAST(round(CAST(value AS DOUBLE) * 10000) AS BIGINT) || ':' ||
    coalesce({_JUDGED}, '') || ':' || coalesce(detail, ''), chr(10) ORDER BY measurement) AS entries FROM rows GROUP BY 1""")
def sample_report_json(spark, sf):
    report = Q.sample_report_json(full_report(spark, sf))
    one = lambda m: F.concat_ws(":", m["id"], F.round(m["value"] * 10000).cast("bigint"), F.coalesce(m["status"], F.lit("")), F.coalesce(m["detail"], F.lit("")))
    entries = F.array_join(F.array_sort(F.transform("measurements", one)), "\n")
    return report.select("sampleId", "status", "judged", "unjudged", "notEvaluated", entries.alias("entries"))


_SUMMARY_MEASURES = ", ".join(f"round(CAST(max(value) FILTER (WHERE measurement = '{m}') AS DOUBLE), 6) AS \"{m}\"" for m in Q.SAMPLE_MEASURES)


@query(_MEASURE_ROWS + f""" SELECT r."sampleId", CAST(any_value(q."readsTotal") AS DOUBLE) AS "readsTotal", CAST(any_value(q."totalUniqueUmis") AS DOUBLE) AS "totalUniqueUmis",
    {_SUMMARY_MEASURES} FROM rows r JOIN readqc q ON q."sampleId" = r."sampleId" GROUP BY 1""")
def sample_summary(spark, sf):
    reads = BedReads(spark, sf)
    out = Q.sample_summary(full_report(spark, sf, reads), roles.samples(spark, sf), reads.read_qc)
    names = Q.SAMPLE_MEASURES
    return rounded(out.select("sampleId", "readsTotal", "totalUniqueUmis", *names), *names)


# --- reagents -----------------------------------------------------------------------------
def scope_of(bed: Bed):
    from ..operators import panels as P

    samples = stage(roles.samples(bed.spark, bed.sf), "samples")
    declared = P.expand_samples(bed.panel, samples)
    return stage(Q.reagent_scope(declared, bed.grouping, P.panels_of_samples(declared, samples)), "scope")


_SCOPE = """SELECT d."sampleId", d.tag, p."panelId", coalesce(g.identity, d.tag) AS identity, g.identity IS NOT NULL AS grouped FROM declared d
    JOIN panels p ON p."sampleId" = d."sampleId" LEFT JOIN grp g ON g."sampleId" = d."sampleId" AND g.tag = d.tag"""


@query(_SCOPE)
def reagent_scope(spark, sf):
    return scope_of(Bed(spark, sf)).drop("scopeId")


_LISTED_STATES = 'SELECT t.* FROM tstates t JOIN listed l ON l."sampleId" = t."sampleId" AND l."cellId" = t."cellId"'
_MEASURES = f"""SELECT s."panelId", s.tag, s.identity, count(DISTINCT k."sampleId") AS "samplesSeenIn", count(DISTINCT s."sampleId") AS "samplesInPanel",
    coalesce(string_agg(DISTINCT k."sampleId", ', ' ORDER BY k."sampleId"), '') AS seen_names, string_agg(DISTINCT s."sampleId", ', ' ORDER BY s."sampleId") AS panel_names,
    count(k."cellId") AS "cellsWithCount", CASE WHEN s.tag NOT IN (SELECT tag FROM refs) THEN CAST(count(*) FILTER (WHERE k.state = 'bound') AS DOUBLE) END AS "cellsAboveTheLine",
    median(k."umiCount") AS "medianCountPerCell" FROM scope s LEFT JOIN (
        SELECT c.*, t.state FROM counts c JOIN listed l ON l."sampleId" = c."sampleId" AND l."cellId" = c."cellId"
        LEFT JOIN tstates t ON t."sampleId" = c."sampleId" AND t."cellId" = c."cellId" AND t.identity = c.tag WHERE c."umiCount" > 0) k
    ON k."sampleId" = s."sampleId" AND k.tag = s.tag GROUP BY 1, 2, 3"""


@query(f"AND scope AS ({_SCOPE}) SELECT * FROM ({_MEASURES})")
def per_antigen_measures(spark, sf):
    bed = Bed(spark, sf)
    out = Q.per_antigen_measures(C.listed(bed.counts, bed.cell_list), C.listed(bed.tag_states, bed.cell_list), scope_of(bed), bed.refs, bed.small)
    return out.select(
        *Q.REAGENT, "samplesSeenIn", "samplesInPanel", F.array_join("seenNames", ", ").alias("seen_names"),
        F.array_join("panelNames", ", ").alias("panel_names"), "cellsWithCount", "cellsAboveTheLine", "medianCountPerCell",
    )


# the sibling votes of a tag are the other rows of its cell and identity
_SIBLINGS = f"""SELECT b."panelId", b.tag, b.identity, count(*) FILTER (WHERE majority IS NOT NULL) AS judged, count(*) FILTER (WHERE majority <> state) AS against FROM (
    SELECT x."panelId", x.tag, x.identity, x.state, CASE WHEN count(*) FILTER (WHERE y.state = 'bound') * 2 > count(*) THEN 'bound'
        WHEN count(*) FILTER (WHERE y.state = 'not bound') * 2 > count(*) THEN 'not bound' END AS majority
    FROM votes x JOIN votes y ON y."sampleId" = x."sampleId" AND y."cellId" = x."cellId" AND y.identity = x.identity AND y.tag <> x.tag
    GROUP BY x."sampleId", x."cellId", x."panelId", x.tag, x.identity, x.state) b GROUP BY 1, 2, 3"""
_SIBLING_ROWS = f"""AND scope AS ({_SCOPE}), heldrows AS (SELECT t."sampleId", t."cellId", t.identity AS tag, t.state, s."panelId", s.identity, s.grouped FROM ({_LISTED_STATES}) t
        JOIN scope s ON s."sampleId" = t."sampleId" AND s.tag = t.identity),
    votes AS (SELECT * FROM heldrows WHERE grouped AND state IN ('bound', 'not bound')), judged AS ({_SIBLINGS}),
    sib AS (SELECT r."panelId", r.tag, r.identity, coalesce(n.n, 0) AS siblings, coalesce(h.n, 0) AS "rowCells", coalesce(j.judged, 0) AS judged,
        CASE WHEN n.n > 1 AND j.judged > 0 THEN j.against / j.judged END AS rate FROM (SELECT DISTINCT "panelId", tag, identity FROM scope) r
    LEFT JOIN (SELECT "panelId", identity, count(DISTINCT tag) AS n FROM scope WHERE grouped GROUP BY 1, 2) n ON n."panelId" = r."panelId" AND n.identity = r.identity
    LEFT JOIN (SELECT "panelId", tag, identity, count(*) AS n FROM heldrows GROUP BY 1, 2, 3) h ON h."panelId" = r."panelId" AND h.tag = r.tag AND h.identity = r.identity
    LEFT JOIN judged j ON j."panelId" = r."panelId" AND j.tag = r.tag AND j.identity = r.identity)"""


@query(_SIBLING_ROWS + ' SELECT "panelId", tag, identity, siblings, "rowCells", judged, round(rate, 6) AS "siblingDisagreement" FROM sib')
def sibling_disagreement(spark, sf):
    bed = Bed(spark, sf)
    return rounded(Q.sibling_disagreement(C.listed(bed.tag_states, bed.cell_list), scope_of(bed), bed.small), "siblingDisagreement")


def _percent(rate: str) -> str:
    whole = f"CAST(floor({rate} * 100 + 0.5) AS BIGINT)"
    return f"CASE WHEN {whole} = 0 AND {rate} > 0 THEN '<1%' WHEN {whole} = 100 AND {rate} < 1 THEN '>99%' ELSE {whole} || '%' END"


_OWN = """SELECT "panelId", tag, identity, sum(least(b, n)) / nullif(sum(b + n), 0) AS rate FROM (
    SELECT s."panelId", s.tag, s.identity, d."setId", count(*) FILTER (WHERE d.state = 'bound') AS b, count(*) FILTER (WHERE d.state = 'not bound') AS n
    FROM tdense d JOIN scope s ON s."sampleId" = d."sampleId" AND s.tag = d.identity GROUP BY 1, 2, 3, 4) WHERE b + n >= 2 GROUP BY 1, 2, 3"""


@query(_SIBLING_ROWS + f""", own AS ({_OWN}) SELECT m."panelId", m.tag, m.identity, m."samplesSeenIn", m."samplesInPanel", m."samplesSeenIn" || '/' || m."samplesInPanel" AS "seenIn",
    m.seen_names AS "samplesSeenInNames", m.panel_names AS "samplesInPanelNames", m."cellsWithCount", m."cellsAboveTheLine", m."medianCountPerCell", round(s.rate, 6) AS "siblingDisagreement",
    CASE WHEN s.rate IS NOT NULL THEN {_percent("s.rate")} WHEN m."cellsAboveTheLine" IS NULL THEN 'held out of the read' WHEN s.siblings < 2 THEN 'no sibling'
        WHEN s."rowCells" = 0 THEN 'no cell beside a sibling' ELSE 'no sibling majority' END AS "siblingDisagreementShown",
    round(o.rate, 6) AS "selfDisagreement", CASE WHEN o.rate IS NOT NULL THEN {_percent("o.rate")} ELSE 'nothing to compare' END AS "selfDisagreementShown",
    concat_ws('|', CASE WHEN m."cellsAboveTheLine" IS NULL THEN 'cellsAboveTheLine=none asked, this tag supplies the baseline' END,
        CASE WHEN m."medianCountPerCell" IS NULL THEN 'medianCountPerCell=no cell holds a count of this tag' END,
        CASE WHEN s.rate IS NULL THEN 'siblingDisagreement=' || CASE WHEN m."cellsAboveTheLine" IS NULL THEN 'this tag is held out of the verdict read'
            WHEN s.siblings < 2 THEN 'this identity carries one tag, so it has no sibling' WHEN s."rowCells" = 0 THEN 'this tag holds no cell beside a sibling'
            ELSE 'no cell gave this tag''s siblings a majority' END END,
        CASE WHEN o.rate IS NULL THEN 'selfDisagreement=no cell set held this tag under an evaluable read' END) AS reason
    FROM ({_MEASURES}) m JOIN sib s ON s."panelId" = m."panelId" AND s.tag = m.tag AND s.identity = m.identity
    LEFT JOIN own o ON o."panelId" = m."panelId" AND o.tag = m.tag AND o.identity = m.identity""")
def reagents(spark, sf):
    from .inputs import whole_run

    return rounded(whole_run(Bed(spark, sf)).reagents, "siblingDisagreement", "selfDisagreement")


# --- bins -----------------------------------------------------------------------------------
_BIN = "CAST(floor(ln(1 + {0}) / 0.2) AS INTEGER)"


@query(f"""SELECT "sampleId", tag, {_BIN.format('"umiCount"')} AS bin, count(*) AS weight FROM counts GROUP BY 1, 2, 3""")
def count_bins(spark, sf):
    return Q.count_bins(roles.counts(spark, sf))


@query(f"""AND b AS (SELECT "sampleId", tag, {_BIN.format('"umiCount"')} AS bin, count(*) AS weight FROM counts GROUP BY 1, 2, 3)
    SELECT p."sampleId", p.tag, p.bin, coalesce(b.weight, 0) AS weight FROM (SELECT DISTINCT "sampleId", tag, CAST(unnest(range(0, (SELECT max(bin) + 1 FROM b))) AS INTEGER) AS bin FROM counts) p
    LEFT JOIN b ON b."sampleId" = p."sampleId" AND b.tag = p.tag AND b.bin = p.bin""")
def count_bins_filled(spark, sf):
    return Q.filled_bins(stage(Q.count_bins(roles.counts(spark, sf)), "bins"))


_SCORE_PARTS = """s AS (SELECT x.score FROM states t JOIN listed l ON l."sampleId" = t."sampleId" AND l."cellId" = t."cellId" JOIN scores x ON x.n = t."umiCount" AND x.r = t."referenceCount"
        WHERE t."unreliableReason" IS NULL), e AS (SELECT min(score) AS a, max(score) AS b FROM s)"""
_SCORE_SPREAD = """SELECT CAST(g.k AS INTEGER) AS bin, round(e.a + (e.b - e.a) * g.k / 24, 6) AS low, round(e.a + (e.b - e.a) * (g.k + 1) / 24, 6) AS high, coalesce(n.n, 0) AS weight FROM range(0, 24) g(k), e
    LEFT JOIN (SELECT least(23, CAST(floor((score - e.a) / (e.b - e.a) * 24) AS BIGINT)) AS k, count(*) AS n FROM s, e GROUP BY 1) n ON n.k = g.k"""


@query(f"AND {_SCORE_PARTS} {_SCORE_SPREAD}")
def score_spread(spark, sf):
    bed = Bed(spark, sf)
    return rounded(Q.score_spread(stage(C.cell_score(bed.states, bed.cell_list), "scores")), "low", "high")


_READING_PARTS = f"""b AS (SELECT {_BIN.format('"referenceCount"')} AS bin, count(*) AS n FROM ({_LISTED_REF}) GROUP BY 1)"""
_READING_SPREAD = """SELECT CAST(g.k AS INTEGER) AS bin, round(exp(g.k * 0.2) - 1, 6) AS low, round(exp((g.k + 1) * 0.2) - 1, 6) AS high, coalesce(b.n, 0) AS weight
    FROM range(0, (SELECT max(bin) + 1 FROM b)) g(k) LEFT JOIN b ON b.bin = g.k"""


@query(f"AND {_READING_PARTS} {_READING_SPREAD}")
def reference_spread(spark, sf):
    bed = Bed(spark, sf)
    return rounded(Q.reference_spread(C.listed(bed.reference, bed.cell_list)), "low", "high")


@query(f"""AND {_SCORE_PARTS}, {_READING_PARTS} SELECT 'score' AS spread, * FROM ({_SCORE_SPREAD}) UNION ALL SELECT 'referenceReading', * FROM ({_READING_SPREAD})""")
def run_spreads(spark, sf):
    """Both spreads as a whole run saves them."""
    return rounded(whole_run(Bed(spark, sf)).spreads, "low", "high")


@query("""AND b AS (SELECT tag, CAST(floor("umiCount" / 10) AS BIGINT) AS k, count(*) AS n FROM counts GROUP BY 1, 2)
    SELECT tag, round(k * 10 + (j + 0.5) * 10.0 / n, 6) AS value FROM (SELECT tag, k, n, unnest(range(0, n)) AS j FROM b)""")
def values_from_bins(spark, sf):
    """One value per observation out of bins of ten, spread evenly."""
    k = F.floor(F.col("umiCount") / 10)
    binned = roles.counts(spark, sf).groupBy("tag", k.alias("k")).agg(F.count(F.lit(1)).alias("weight"))
    shaped = binned.select("tag", (F.col("k") * 10).cast("double").alias("low"), ((F.col("k") + 1) * 10).cast("double").alias("high"), "weight")
    return rounded(Q.values_from_bins(shaped), "value")


@query("""SELECT count(*) AS samples, CAST(sum("readsTotal") AS BIGINT) AS "readsTotal", round(median("matchedFraction"), 6) AS "medianMatched", round(median("panelAssignedFraction"), 6) AS "medianAssigned",
    round(min("panelAssignedFraction"), 6) AS "lowestAssigned", round(max("panelAssignedFraction"), 6) AS "highestAssigned", CAST(sum("cellsDetected") AS BIGINT) AS "cellsDetected",
    max("featuresDetected") AS features, count(*) FILTER (WHERE "cellsDetected" = 0) AS flagged, coalesce(string_agg("sampleId", ', ') FILTER (WHERE "cellsDetected" = 0), '') AS "flaggedSamples" FROM readqc""")
def run_log(spark, sf):
    return rounded(Q.run_log(bed_read_qc(spark, sf)), "medianMatched", "medianAssigned", "lowestAssigned", "highestAssigned")
