"""Per-cell metrics, states and cell tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.score import count_to_reach_column, specificity_score
from ..operators import cells as C
from ..operators import percell as E
from ..operators import states as X
from ..plans import roles
from ..sources.sinks import stage
from .base import Bed, query, r6, rounded, score_sql

_FAMILY = """SELECT DISTINCT p_brand AS tag, 'F' || (n % 8) AS feature, CASE WHEN n % 8 IN (3, 5) THEN 'all' ELSE 'sum' END AS mode,
    count(*) OVER (PARTITION BY n % 8) AS members FROM (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part)"""
_MATRIX = f"""SELECT c."sampleId", c."cellId", f.feature, CAST(sum(c."umiCount") AS BIGINT) AS "umiCount" FROM counts c JOIN ({_FAMILY}) f ON f.tag = c.tag
    GROUP BY 1, 2, 3 HAVING any_value(f.mode) <> 'all' OR count(*) FILTER (WHERE c."umiCount" >= 2) = any_value(f.members)"""
_FRACTIONS = f"""SELECT *, CASE WHEN sum("umiCount") OVER w > 0 THEN "umiCount" / sum("umiCount") OVER w ELSE 0.0 END AS fraction
    FROM ({_MATRIX}) WINDOW w AS (PARTITION BY "sampleId", "cellId")"""


def matrix(spark, sf):
    mapping = stage(E.clean_mapping(roles.family_mapping(spark, sf)), "mapping")
    E.check_mapping(mapping, "combine")
    return E.cell_feature_counts(roles.tag_statistics(spark, sf), mapping, "combine", 2.0)


@query(_MATRIX)
def cell_feature_counts(spark, sf):
    return matrix(spark, sf)


@query(f'SELECT "sampleId", "cellId", p.family AS feature, CAST(sum("umiCount") AS BIGINT) AS "umiCount" FROM counts c JOIN panel p ON p.tag = c.tag AND p.sample = c."sampleId" GROUP BY 1, 2, 3')
def cell_feature_counts_by_sample(spark, sf):
    """The mapping keyed by sample, applied to all samples in one join."""
    panel = stage(roles.panel(spark, sf), "panel")
    mapping = panel.select(F.col("sample").alias("sampleId"), "tag", F.col("family").alias("feature"))
    return E.cell_feature_counts(roles.tag_statistics(spark, sf), mapping, by_sample=True)


@query("""SELECT 'panel' AS side, tag FROM (SELECT DISTINCT 'x' || p_brand AS tag FROM part ORDER BY 1 LIMIT 8)
    UNION ALL SELECT 'reads', tag FROM (SELECT DISTINCT tag FROM counts ORDER BY 1 LIMIT 8)""")
def empty_join_diagnostics(spark, sf):
    """A mapping whose barcodes are written otherwise meets no read; a few keys of both sides show it."""
    off = roles.family_mapping(spark, sf).withColumn("tag", F.concat(F.lit("x"), "tag"))
    return E.empty_join_diagnostics(roles.tag_statistics(spark, sf), off)


@query(f'SELECT "sampleId", "cellId", feature, "umiCount", round(fraction, 6) AS fraction FROM ({_FRACTIONS})')
def cell_fractions(spark, sf):
    return rounded(E.with_fraction(matrix(spark, sf)), "fraction")


_SUMMARY = f"""SELECT "sampleId", "cellId", arg_min(feature, struct_pack(a := -fraction, b := feature)) AS "topFeature", max("umiCount") AS "maxUmiCount",
    CAST(sum("umiCount") AS BIGINT) AS "totalUmiCount", round(max(fraction), 6) AS "maxFraction",
    string_agg(feature || ' (' || CASE WHEN round_even(fraction * 100, 0) = 0 AND "umiCount" > 0 THEN '<1%' ELSE CAST(CAST(round_even(fraction * 100, 0) AS BIGINT) AS VARCHAR) || '%' END
        || ', ' || "umiCount" || ' UMI)', ', ' ORDER BY fraction DESC, feature) AS "featureSummary" FROM ({_FRACTIONS}) GROUP BY 1, 2"""


@query(_SUMMARY)
def per_cell_summary(spark, sf):
    return rounded(E.per_cell_summary(E.with_fraction(matrix(spark, sf))), "maxFraction")


@query(f"""SELECT s.* FROM ({_SUMMARY}) s JOIN listed l ON l."sampleId" = s."sampleId" AND l."cellId" = s."cellId\"""")
def per_cell_summary_listed(spark, sf):
    summary = E.per_cell_summary(E.with_fraction(matrix(spark, sf)))
    return rounded(E.cells_in_list(summary, roles.cell_list(spark, sf)), "maxFraction")


# --- floor, reference, gate, states ------------------------------------------------
@query('SELECT "sampleId", "cellId", tag, CASE WHEN "umiCount" < 12 AND tag NOT IN (SELECT tag FROM refs) THEN 0 ELSE "umiCount" END AS "umiCount" FROM counts')
def floor_applied(spark, sf):
    bed = Bed(spark, sf)
    return X.apply_floor(bed.counts, 12, bed.refs, bed.small).select("sampleId", "cellId", "tag", "umiCount")


@query("""SELECT "sampleId", CAST(sum(low) AS BIGINT) AS "readingsFloored", count(*) FILTER (WHERE NOT kept) AS "cellsEmptied", count(*) AS "cellsWithAntigenReadings" FROM (
    SELECT "sampleId", "cellId", count(*) FILTER (WHERE "umiCount" < 12) AS low, bool_or("umiCount" >= 12) AS kept FROM counts
    WHERE tag NOT IN (SELECT tag FROM refs) GROUP BY 1, 2) GROUP BY 1""")
def floor_stats(spark, sf):
    bed = Bed(spark, sf)
    return X.floor_stats(bed.counts, 12, bed.refs, bed.small)


@query("""SELECT c."sampleId", c."cellId" FROM cells c WHERE NOT EXISTS (SELECT 1 FROM counts k WHERE k."sampleId" = c."sampleId" AND k."cellId" = c."cellId"
    AND (k."umiCount" >= 12 OR k.tag IN (SELECT tag FROM refs)))""")
def cells_reading_nothing(spark, sf):
    bed = Bed(spark, sf)
    return X.cells_reading_nothing(X.apply_floor(bed.counts, 12, bed.refs, bed.small), bed.cells)


@query("""SELECT 'declared' AS source, (SELECT count(*) FROM refs) > 0 AS serves FROM (SELECT 1)
    UNION ALL SELECT 'panel', count(DISTINCT tag) >= 25 FROM panel UNION ALL SELECT 'distribution', true""")
def baseline_served(spark, sf):
    """Which baselines the settings allow, judged from the panel."""
    bed = Bed(spark, sf)
    size = bed.panel.select(F.count_distinct("tag")).first()[0]
    has_refs = not bed.refs.isEmpty()

    def serves(source):
        try:
            return X.served_source(source, has_refs, size) == source
        except ValueError:
            return False

    flags = [F.struct(F.lit(s).alias("source"), F.lit(serves(s)).alias("serves")) for s in ("declared", "panel", "distribution")]
    return bed.panel.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*flags)).alias("r")).select("r.*")


@query('SELECT "sampleId", "cellId", "referenceCount" FROM ref')
def reference_declared(spark, sf):
    return Bed(spark, sf).reference


@query("""SELECT c."sampleId", c."cellId", CAST(floor(coalesce(median(k."umiCount"), 0)) AS BIGINT) AS "referenceCount" FROM cells c
    LEFT JOIN counts k ON k."sampleId" = c."sampleId" AND k."cellId" = c."cellId" GROUP BY 1, 2""")
def reference_panel_median(spark, sf):
    bed = Bed(spark, sf)
    return X.reference_panel_median(bed.counts, bed.cells)


@query('SELECT "sampleId", "cellId" FROM ref WHERE "referenceCount" > 40')
def cells_gated(spark, sf):
    return X.gate_cells(Bed(spark, sf).reference, roles.GATE)


@query('SELECT "sampleId", "cellId" FROM ref WHERE "referenceCount" > 40')
def cells_over_limit(spark, sf):
    """The same cells without building the reference of every cell."""
    bed = Bed(spark, sf)
    return X.cells_over_limit(bed.counts, bed.refs, roles.GATE, bed.small)


@query('SELECT count(*) FILTER (WHERE "referenceCount" > 40) AS "cellsHighReference" FROM ref')
def cells_high(spark, sf):
    return X.cells_high(Bed(spark, sf).reference, roles.GATE)


@query('SELECT "sampleId", "cellId", identity, "umiCount" FROM ident')
def tags_combined(spark, sf):
    bed = Bed(spark, sf)
    return X.combine_tags(bed.floored, bed.grouping, bed.small)


@query(f"""SELECT n, r, round({score_sql("n", "r")}, 6) AS score FROM (SELECT DISTINCT k."umiCount" AS n, f."referenceCount" AS r
    FROM counts k JOIN ref f ON f."sampleId" = k."sampleId" AND f."cellId" = k."cellId")""")
def specificity_scores(spark, sf):
    """The score at every pair of counts the cells show."""
    bed = Bed(spark, sf)
    pairs = bed.counts.join(bed.reference, ["sampleId", "cellId"]).select(F.col("umiCount").alias("n"), F.col("referenceCount").alias("r")).distinct()
    return pairs.select("n", "r", r6(specificity_score(F.col("n"), F.col("r"))).alias("score"))


@query("""WITH p AS (SELECT s_suppkey AS id, r, CAST(floor(r * (12.3333 + (s_suppkey % 21 - 10) * 0.01)) AS BIGINT) AS n
        FROM (SELECT s_suppkey, CAST(floor(abs(s_acctbal) * 100) AS BIGINT) + 512 AS r FROM supplier)),
    w AS (SELECT *, n + r + 3 AS trials, 15 * sqrt((n + r + 3) * 0.075 * 0.925) AS reach FROM p),
    j AS (SELECT *, unnest(range(CAST(greatest(0, floor(trials * 0.075 - reach)) AS BIGINT), CAST(least(trials, floor(trials * 0.075 + reach)) AS BIGINT))) AS k FROM w),
    l AS (SELECT id, r, n, k, sum(ln((trials - k + 1) / k * 0.075 / 0.925)) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) AS mass FROM j WHERE k > 0),
    m AS (SELECT *, exp(mass - max(mass) OVER (PARTITION BY id)) AS part FROM l)
    SELECT id, n, r, round(100 * coalesce(sum(part) FILTER (WHERE k > r + 2), 0) / sum(part), 4) AS score FROM m GROUP BY 1, 2, 3""")
def specificity_scores_far(spark, sf):
    """The score at references of 512 to a million: each supplier's balance in cents, and a count near where the score turns."""
    r = (F.floor(F.abs("s_acctbal") * 100) + 512).cast("bigint")
    turn = F.floor(F.col("r") * (12.3333 + (F.col("id") % 21 - 10) * 0.01)).cast("bigint")
    pairs = roles.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), r.alias("r")).withColumn("n", turn)
    return pairs.select("id", "n", "r", F.round(specificity_score(F.col("n"), F.col("r")), 4).alias("score"))


@query(f"""SELECT r, CAST(min(n) AS BIGINT) AS needed FROM (SELECT DISTINCT "referenceCount" AS r FROM ref), range(0, 4000) t(n)
    WHERE n BETWEEN CAST(12 * r AS BIGINT) AND CAST(25 * r + 100 AS BIGINT) AND {score_sql("n", "r")} >= 75 GROUP BY 1""")
def count_needed(spark, sf):
    """The count the cutoff asks for at every reference reading the cells show."""
    readings = Bed(spark, sf).reference.select(F.col("referenceCount").alias("r")).distinct()
    return readings.select("r", count_to_reach_column(F.col("r"), 75.0).alias("needed"))


_STATE_COLUMNS = '"sampleId", "cellId", identity, "umiCount", "referenceCount", state, "unreliableReason"'


@query(f"SELECT {_STATE_COLUMNS} FROM states")
def states_read(spark, sf):
    """States from identities and a reference, step by step."""
    bed = Bed(spark, sf)
    return X.read_states(X.combine_tags(bed.floored, bed.grouping, bed.small), bed.reference, roles.GATE)


@query(f"SELECT {_STATE_COLUMNS} FROM states")
def states_in_one_pass(spark, sf):
    """The same states from one shuffle of the counts."""
    return Bed(spark, sf).states


@query(f"SELECT {_STATE_COLUMNS} FROM tstates")
def states_per_tag(spark, sf):
    return Bed(spark, sf).tag_states


@query(f"""AND med AS (SELECT "sampleId", "cellId", CAST(floor(median("umiCount")) AS BIGINT) AS r FROM counts GROUP BY 1, 2),
    pairs AS (SELECT n, r, {score_sql("n", "r")} AS score FROM (SELECT DISTINCT i."umiCount" AS n, m.r FROM ident i JOIN med m ON m."sampleId" = i."sampleId" AND m."cellId" = i."cellId"))
    SELECT i."sampleId", i."cellId", i.identity, i."umiCount", m.r AS "referenceCount", CASE WHEN p.score >= 75 THEN 'bound' ELSE 'not bound' END AS state,
    CAST(NULL AS VARCHAR) AS "unreliableReason" FROM ident i JOIN med m ON m."sampleId" = i."sampleId" AND m."cellId" = i."cellId" JOIN pairs p ON p.n = i."umiCount" AND p.r = m.r""")
def states_against_panel_median(spark, sf):
    bed = Bed(spark, sf)
    return X.states_from_counts(bed.counts, bed.grouping, bed.refs, "panel", 4, 75.0, None, bed.small)


@query("""SELECT "sampleId", "cellId", "referenceCount", CASE WHEN "referenceCount" > 40 THEN 'cell set aside by the sticky cell limit' ELSE 'admissible' END AS admissibility FROM ref""")
def cell_admissibility(spark, sf):
    return X.cell_admissibility(Bed(spark, sf).reference, roles.GATE)


@query("""SELECT i."sampleId", i."cellId", i.identity, i."umiCount", CAST(NULL AS BIGINT) AS "referenceCount",
    CASE WHEN f."referenceCount" > 40 OR i."umiCount" % 7 = 0 THEN 'unreliable' WHEN i."umiCount" >= 45 THEN 'bound' ELSE 'not bound' END AS state,
    CASE WHEN f."referenceCount" > 40 THEN 'cell set aside by the sticky cell limit' WHEN i."umiCount" % 7 = 0 THEN 'no comparator for this cell' END AS "unreliableReason"
    FROM ident i JOIN ref f ON f."sampleId" = i."sampleId" AND f."cellId" = i."cellId\"""")
def states_from_probabilities(spark, sf):
    """States from given probabilities: count / 50 stands in for one, and every seventh count has none."""
    bed = Bed(spark, sf)
    identities = X.combine_tags(bed.floored, bed.grouping, bed.small)
    given = identities.filter("umiCount % 7 <> 0").select("sampleId", "cellId", "identity", (F.col("umiCount") / 50).alias("pBound"))
    return X.read_states_probability(identities, given, X.gate_cells(bed.reference, roles.GATE))


@query(f"""AND s AS (SELECT t.* FROM states t JOIN listed l ON l."sampleId" = t."sampleId" AND l."cellId" = t."cellId" WHERE "unreliableReason" IS NULL),
    m AS (SELECT "sampleId", median("umiCount") AS a, median("referenceCount") AS r, count(*) FILTER (WHERE state = 'bound') / count(*) AS share FROM s GROUP BY 1)
    SELECT "sampleId", a AS "medianAntigenReading", (SELECT min(n) FROM range(0, 4000) t(n) WHERE {score_sql("n", "CAST(m.r AS BIGINT)")} >= 75) AS "cutoffCountNeeded",
    round(share, 6) AS "boundReadingShare" FROM m""")
def score_by_sample(spark, sf):
    bed = Bed(spark, sf)
    scored = C.listed(bed.states.filter("unreliableReason is null"), bed.cell_list)
    return rounded(X.score_by_sample(stage(scored, "scored")), "boundReadingShare")


# --- cell tables ---------------------------------------------------------------------
@query("""SELECT "sampleId", "cellId" FROM counts UNION SELECT "sampleId", "cellId" FROM linker UNION SELECT "sampleId", "cellId" FROM listed""")
def analysed_cells(spark, sf):
    bed = Bed(spark, sf)
    return C.analysed_cells(bed.counts, bed.linker, bed.cell_list)


@query("""SELECT c."sampleId", c."cellId", CASE WHEN l."cellId" IS NULL THEN 'false' ELSE 'true' END AS "inCellList" FROM cells c LEFT JOIN listed l
    ON l."sampleId" = c."sampleId" AND l."cellId" = c."cellId\"""")
def cell_membership(spark, sf):
    return C.in_cell_list(roles.cells(spark, sf), roles.cell_list(spark, sf))


@query("""SELECT "sampleId", "cellId", 'unknown' AS "inCellList" FROM cells""")
def cell_membership_without_list(spark, sf):
    return C.in_cell_list(roles.cells(spark, sf), None)


@query("""SELECT "sampleId", "cellId", 'true' AS "inCellList" FROM listed""")
def cell_list_table(spark, sf):
    return C.cell_list_table(roles.cell_list(spark, sf), roles.cells(spark, sf))


@query('SELECT k.* FROM counts k JOIN listed l ON l."sampleId" = k."sampleId" AND l."cellId" = k."cellId"')
def counts_listed(spark, sf):
    return C.listed(roles.counts(spark, sf), roles.cell_list(spark, sf))


@query("""SELECT k."sampleId", k."cellId", k.tag, k."umiCount", f."referenceCount", CASE WHEN l."cellId" IS NULL THEN 'false' ELSE 'true' END AS "inCellList"
    FROM floored k JOIN ref f ON f."sampleId" = k."sampleId" AND f."cellId" = k."cellId"
    LEFT JOIN listed l ON l."sampleId" = k."sampleId" AND l."cellId" = k."cellId" WHERE k.tag NOT IN (SELECT tag FROM refs)""")
def cell_counts_table(spark, sf):
    bed = Bed(spark, sf)
    return C.cell_counts(bed.floored, bed.refs, bed.reference, bed.cell_list)


@query('SELECT k."sampleId", k."cellId", k.tag, k."umiCount" FROM counts k JOIN listed l ON l."sampleId" = k."sampleId" AND l."cellId" = k."cellId"')
def cell_raw_counts(spark, sf):
    return C.cell_raw_counts(roles.counts(spark, sf), roles.cell_list(spark, sf))


_TAG_COLUMNS = ", ".join(f"max(\"umiCount\") FILTER (WHERE tag = 'Brand#{n}') AS \"Brand#{n}\"" for n in range(1, 26))


@query(f'SELECT k."sampleId", k."cellId", {_TAG_COLUMNS} FROM counts k JOIN listed l ON l."sampleId" = k."sampleId" AND l."cellId" = k."cellId" GROUP BY 1, 2')
def cell_tag_pivot(spark, sf):
    bed = Bed(spark, sf)
    tags = [r[0] for r in bed.panel.select("tag").distinct().collect()]
    return C.cell_tag_pivot(C.cell_raw_counts(bed.counts, bed.cell_list), tags)


@query("""SELECT f."sampleId", f."cellId", f."referenceCount", CASE WHEN f."referenceCount" > 40 THEN 'cell set aside by the sticky cell limit' ELSE 'admissible' END AS admissibility,
    CASE WHEN l."cellId" IS NULL THEN 'false' ELSE 'true' END AS "inCellList" FROM ref f LEFT JOIN listed l ON l."sampleId" = f."sampleId" AND l."cellId" = f."cellId\"""")
def cell_scalars(spark, sf):
    bed = Bed(spark, sf)
    return C.cell_scalars(X.cell_admissibility(bed.reference, roles.GATE), bed.cell_list)


@query('SELECT f."sampleId", f."cellId", f."referenceCount" FROM ref f JOIN listed l ON l."sampleId" = f."sampleId" AND l."cellId" = f."cellId"')
def cell_background(spark, sf):
    bed = Bed(spark, sf)
    return C.cell_background(C.cell_scalars(X.cell_admissibility(bed.reference, roles.GATE), bed.cell_list), bed.cell_list)


@query("""SELECT t."sampleId", t."cellId", t.identity, round(s.score, 6) AS score FROM states t JOIN listed l ON l."sampleId" = t."sampleId" AND l."cellId" = t."cellId"
    JOIN scores s ON s.n = t."umiCount" AND s.r = t."referenceCount" WHERE t."unreliableReason" IS NULL""")
def cell_score(spark, sf):
    bed = Bed(spark, sf)
    return rounded(C.cell_score(bed.states, bed.cell_list), "score")


@query("""SELECT 'declared' AS "referenceChoice", true AS "baselineEstablished", 'cell list' AS "cellListSource", (SELECT count(*) FROM listed) AS "cellsInList",
    (SELECT count(*) FROM cells) AS "cellsAnalysed", 8 AS "identityCount", (SELECT count(*) FROM counts WHERE "umiCount" < 4 AND tag NOT IN (SELECT tag FROM refs)) AS "readingsFloored",
    (SELECT count(*) FROM ref WHERE "referenceCount" > 40) AS "cellsHighReference", (SELECT count(*) FROM ref WHERE "referenceCount" > 40) AS "cellsSetAside",
    (SELECT count(DISTINCT "setId") FROM linker) AS "setCount", (SELECT count(DISTINCT "panelId") FROM panels) AS "samplePanelCount",
    (SELECT string_agg("sampleId", ', ' ORDER BY "sampleId") FROM samples) AS samples, (SELECT string_agg(tag, ', ' ORDER BY tag) FROM refs) AS "referenceTags",
    'declared' AS "referenceSourceRequested", '' AS "noBaselineReason", 'Control' AS "referenceValues", '{"by": "property", "columns": ["family"]}' AS grouping, 'property:family' AS "groupingId",
    'role' AS "roleColumn", '' AS "tagsWithoutGroupingValue", 4 AS floor, CAST(75 AS DOUBLE) AS cutoff, CAST(0.9 AS DOUBLE) AS "boundProbability", 1 AS "minVoters", 40 AS "gateThreshold", true AS "cellPunchEmitted", true AS "identitySummaryEmitted",
    (SELECT count(*) FROM (SELECT DISTINCT * FROM linker)) AS "cellPunchCells", (SELECT string_agg(identity, ', ' ORDER BY identity) FROM (SELECT DISTINCT identity FROM grp)) AS identities,
    'F1, F2, F3; F3, F4, F5, F6' AS contending, '' AS "panelLinesDropped",
    (SELECT count(*) FROM (SELECT "sampleId", "cellId" FROM floored WHERE tag NOT IN (SELECT tag FROM refs) GROUP BY 1, 2 HAVING max("umiCount") = 0)) AS "cellsEmptied\"""")
def run_record(spark, sf):
    from .inputs import whole_run

    names = ["referenceChoice", "baselineEstablished", "cellListSource", "cellsInList", "cellsAnalysed", "identityCount", "readingsFloored",
             "cellsHighReference", "cellsSetAside", "setCount", "samplePanelCount", "samples", "referenceTags", "referenceSourceRequested", "noBaselineReason",
             "referenceValues", "grouping", "groupingId", "roleColumn", "tagsWithoutGroupingValue", "floor", "cutoff", "boundProbability", "minVoters", "gateThreshold",
             "cellPunchEmitted", "identitySummaryEmitted", "cellPunchCells", "identities", "contending", "panelLinesDropped", "cellsEmptied"]
    return whole_run(Bed(spark, sf)).run_record().select(*names)
