"""Sets: tallies, verdicts, their tables, readouts and the checks across arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import joins
from ..operators import crossarm as M
from ..operators import panels as P
from ..operators import readout as K
from ..operators import sets as S
from ..plans import roles
from ..sources.sinks import stage
from .base import Bed, code_sql, query, r6, rounded, verdict_sql

VERDICT_COLUMNS = (
    '"setId", identity, state, "cellsAsked", "cellsAnswered", "cellsBound", "cellsNotBound", round(agreement, 6) AS agreement, "unreliableReason"'
)


def _tally_sql(group: str) -> str:
    return f"""SELECT "{group}", identity, count(*) AS asked, count(*) FILTER (WHERE observed) AS observed,
        count(*) FILTER (WHERE NOT observed AND state = 'unreliable') AS "silentUnreliable",
        count(*) FILTER (WHERE NOT observed AND state = 'not bound') AS "silentNotBound" FROM dense GROUP BY 1, 2"""


@query('SELECT "sampleId", "cellId", "setId" FROM linker')
def cells_by_set(spark, sf):
    """Set membership from a linker that repeats its rows."""
    linker = roles.linker(spark, sf)
    return S.cells_by_set(linker.unionByName(linker))


@query(_tally_sql("sampleId"))
def silent_tally_by_sample(spark, sf):
    bed = Bed(spark, sf)
    return S.silent_tally(bed.states, bed.member_cells, bed.offered, "sampleId", bed.small)


@query(_tally_sql("setId"))
def silent_tally_by_set(spark, sf):
    """Counted positions against the dense grid of cells and identities."""
    bed = Bed(spark, sf)
    return S.silent_tally(bed.states, bed.members, bed.offered, "setId", bed.small)


@query(f"SELECT {VERDICT_COLUMNS} FROM verdicts")
def verdicts_combined(spark, sf):
    return rounded(Bed(spark, sf).verdicts, "agreement")


@query(f"AND v AS ({verdict_sql(2, 0.8)}) SELECT {VERDICT_COLUMNS} FROM v")
def verdicts_strict(spark, sf):
    """At least two voters and four fifths of them agreeing."""
    bed = Bed(spark, sf)
    strict = S.combine_cells(bed.states, bed.members, bed.offered, bed.universe, 2, 0.8, bed.small)
    return rounded(strict, "agreement")


_RIVALS = "(VALUES ('F1','F2'),('F1','F3'),('F2','F1'),('F2','F3'),('F3','F1'),('F3','F2'),('F3','F4'),('F3','F5'),('F3','F6'),('F4','F3'),('F4','F5'),('F4','F6'),('F5','F3'),('F5','F4'),('F5','F6'),('F6','F3'),('F6','F4'),('F6','F5')) g(a, b)"


@query(f"""SELECT v."setId", v.identity, v.state, n.note AS "competedWith", CASE WHEN n.note IS NULL THEN 'false' ELSE 'true' END AS "wasCompeted" FROM verdicts v LEFT JOIN (
    SELECT x."setId", x.identity, string_agg(DISTINCT g.b, ', ' ORDER BY g.b) AS note FROM verdicts x JOIN {_RIVALS} ON g.a = x.identity
    JOIN verdicts y ON y."setId" = x."setId" AND y.identity = g.b AND y.state = 'bound' WHERE x.state = 'not bound' GROUP BY 1, 2) n
    ON n."setId" = v."setId" AND n.identity = v.identity""")
def competitor_notes(spark, sf):
    bed = Bed(spark, sf)
    noted = S.competitor_notes(bed.verdicts, roles.CONTENDING, bed.patterns[0].count() * len(bed.universe))
    return noted.select("setId", "identity", "state", "competedWith", "wasCompeted")


@query("""SELECT "setId", count(*) FILTER (WHERE state = 'bound') AS "boundCount", count(*) FILTER (WHERE state <> 'never asked') AS "offeredCount",
    count(*) FILTER (WHERE state IN ('bound', 'not bound')) AS "settledCount", count(*) FILTER (WHERE state = 'unreliable') AS "unsettledCount" FROM verdicts GROUP BY 1""")
def set_counts(spark, sf):
    bed = Bed(spark, sf)
    return S.set_counts(bed.offered_verdicts, bed.patterns[0])


SET_CELLS = """SELECT l."setId", count(*) AS "cellCount", count(*) FILTER (WHERE r."referenceCount" > 40) AS "cellsSetAside",
    count(*) FILTER (WHERE coalesce(f.top, 0) <= 0) AS "cellsReadingNothing" FROM linker l JOIN ref r ON r."sampleId" = l."sampleId" AND r."cellId" = l."cellId"
    LEFT JOIN (SELECT "sampleId", "cellId", max("umiCount") AS top FROM floored GROUP BY 1, 2) f ON f."sampleId" = l."sampleId" AND f."cellId" = l."cellId" GROUP BY 1"""


@query(SET_CELLS)
def set_cell_counts(spark, sf):
    bed = Bed(spark, sf)
    return S.set_cell_counts(bed.members, bed.floored)


@query(f'SELECT "setId", "cellsSetAside" FROM ({SET_CELLS}) WHERE "cellsSetAside" > 0')
def cells_set_aside_by_set(spark, sf):
    bed = Bed(spark, sf)
    return S.set_aside_by_set(S.set_cell_counts(bed.members, bed.floored))


@query("""AND p AS (SELECT "setId", identity, count(*) FILTER (WHERE state = 'bound') AS b, count(*) FILTER (WHERE state = 'not bound') AS n FROM tdense GROUP BY 1, 2),
    t AS (SELECT identity AS tag, sum(b + n) AS c, sum(least(b, n)) AS m FROM p WHERE b + n >= 2 GROUP BY 1)
    SELECT u.tag, CAST(coalesce(c, 0) AS BIGINT) AS "cellsCompared", CAST(coalesce(m, 0) AS BIGINT) AS "minorityCells", round(m / nullif(c, 0), 6) AS "disagreementRate"
    FROM (SELECT DISTINCT tag FROM tgrp) u LEFT JOIN t ON t.tag = u.tag""")
def self_disagreement(spark, sf):
    bed = Bed(spark, sf)
    universe = bed.tag_grouping.select("tag").distinct()
    return rounded(S.self_disagreement(bed.tag_states, bed.members, bed.offered_tags, universe, small=bed.small), "disagreementRate")


_MEDIAN_VALUES = """SELECT l."setId", o.tag, coalesce(c."umiCount", 0) AS v, c.tag IS NOT NULL AS shown FROM linker l JOIN toffered o ON o."sampleId" = l."sampleId"
    LEFT JOIN counts c ON c."sampleId" = l."sampleId" AND c."cellId" = l."cellId" AND c.tag = o.tag"""
_MEDIANS = f"""SELECT "setId", tag, median(v) AS "medianUmiCount" FROM ({_MEDIAN_VALUES}) GROUP BY 1, 2
    HAVING count(*) FILTER (WHERE shown) > 0 AND count(*) FILTER (WHERE shown) * 2 >= count(*)"""


@query(_MEDIANS)
def set_tag_median(spark, sf):
    """Raw medians with silent cells as zeros, against the padded lists of values."""
    bed = Bed(spark, sf)
    return S.set_tag_median(bed.counts, bed.members, bed.offered_tags, bed.small)


_MEDIAN_COLUMNS = ", ".join(f"max(\"medianUmiCount\") FILTER (WHERE tag = 'Brand#{n}') AS \"Brand#{n}\"" for n in range(2, 26))


@query(f'SELECT "setId", {_MEDIAN_COLUMNS} FROM ({_MEDIANS}) GROUP BY 1')
def set_tag_median_table(spark, sf):
    bed = Bed(spark, sf)
    tags = [r[0] for r in bed.tag_grouping.select("tag").distinct().collect()]
    return S.set_tag_median_table(S.set_tag_median(bed.counts, bed.members, bed.offered_tags, bed.small), tags)


_PER_IDENTITY = ", ".join(f"max({{0}}) FILTER (WHERE identity = 'F{n}') AS \"F{n}\"" for n in range(8))
_PUNCH = """state || '|' || "cellsAnswered" || '|' || "cellsAsked" || '|' || coalesce(CAST(agreement AS VARCHAR), '') || '|' || coalesce("unreliableReason", '') || '|' || "cellsBound\""""


@query(f'SELECT "setId", {_PER_IDENTITY.format("state")} FROM verdicts GROUP BY 1')
def identity_summary(spark, sf):
    bed = Bed(spark, sf)
    return S.identity_summary(bed.offered_verdicts, bed.universe, bed.patterns[0])


@query(f'SELECT "setId", {_PER_IDENTITY.format("punch")} FROM (SELECT *, {_PUNCH} AS punch FROM verdicts) GROUP BY 1')
def identity_punch(spark, sf):
    bed = Bed(spark, sf)
    return S.identity_punch(bed.offered_verdicts, bed.universe, bed.patterns[0])


@query("""SELECT "setId", identity, 'read' AS kind, state, CAST("cellsAnswered" AS DOUBLE) AS answered, CAST("cellsAsked" AS DOUBLE) AS asked,
    round(agreement, 6) AS agreement, "unreliableReason" AS reason, CAST("cellsBound" AS DOUBLE) AS bound FROM verdicts""")
def punch_decoded(spark, sf):
    """Punch values written and taken apart again."""
    punches = Bed(spark, sf).verdicts.select("setId", "identity", S.punch_column().alias("punch"))
    return rounded(S.decode_punch(punches), "agreement")


@query('SELECT "sampleId", "cellId", "setId", identity, state AS "cellState", reason FROM dense')
def cell_punch_long(spark, sf):
    """Read back from the card's three tables, none of which has a row for a silent position."""
    bed = Bed(spark, sf)
    return S.read_card(*[stage(df, "card") for df in S.cell_card(bed.states, bed.members, bed.offered, bed.small)], bed.small)


@query(f"""SELECT "sampleId", "cellId", "setId", count(*) FILTER (WHERE state = 'bound') AS "boundIdentities", {_PER_IDENTITY.format("state || '|' || coalesce(reason, '')")}
    FROM dense GROUP BY 1, 2, 3""")
def cell_punch(spark, sf):
    bed = Bed(spark, sf)
    return S.cell_punch(S.cell_punch_long(bed.states, bed.members, bed.offered, bed.small), bed.universe)


# --- readouts ------------------------------------------------------------------------
_CARD = f'SELECT "setId", {_PER_IDENTITY.format("punch")} FROM (SELECT *, {_PUNCH} AS punch FROM verdicts) GROUP BY 1'


@query(f"""SELECT p.*, c."cellCount", s.orders FROM ({_CARD}) p JOIN (SELECT "setId", count(*) AS "cellCount" FROM linker GROUP BY 1) c ON c."setId" = p."setId"
    JOIN (SELECT CAST(o_custkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS "setId", round(sum(o_totalprice), 2) AS orders FROM orders GROUP BY 1) s ON s."setId" = p."setId\"""")
def punchcard(spark, sf):
    """The card with its cell count and a property of the sets."""
    bed = Bed(spark, sf)
    set_id = F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.year("o_orderdate").cast("string"))
    orders = roles.table(spark, sf, "orders").select(set_id.alias("setId"), "o_orderkey", F.col("o_totalprice").alias("orders"))
    worth = joins.added_up(orders, ["setId"], ["orders"], ["setId"], orders.count()).withColumn("orders", F.round("orders", 2))
    cells = bed.linker.select("setId", "cellId", F.lit(1).alias("cellCount"))
    cells = joins.added_up(cells, ["setId"], ["cellCount"], ["setId"], cells.count())
    labels = {i: f"family {i[1:]}" for i in bed.universe}
    return K.punchcard(S.identity_punch(bed.offered_verdicts, bed.universe, bed.patterns[0]), cells, labels, worth)


@query("SELECT DISTINCT identity AS value, identity AS label FROM grp")
def punchcard_identity_options(spark, sf):
    bed = Bed(spark, sf)
    labels = P.identity_labels(bed.grouping, bed.panel, bed.refs, "property:family", "feature", ["family"])
    return K.punchcard_identity_options(S.identity_punch(bed.offered_verdicts, bed.universe, bed.patterns[0]), labels)


@query('SELECT count(DISTINCT "panelId") AS "samplePanelCount" FROM panels')
def panels_differ(spark, sf):
    samples = stage(roles.samples(spark, sf), "samples")
    declared = P.expand_samples(roles.panel(spark, sf), samples)
    return K.panels_differ(P.panels_of_samples(declared, samples))


_FIRST_SET = '(SELECT min("setId") FROM linker)'


def first_set(bed: Bed) -> str:
    return bed.linker.agg(F.min("setId")).first()[0]


@query(f"""SELECT "setId", identity, state, "cellsAsked", "cellsAnswered", "cellsBound" FROM verdicts WHERE "setId" = {_FIRST_SET} AND state <> 'never asked'""")
def set_expanded(spark, sf):
    bed = Bed(spark, sf)
    return K.expand_set(stage(bed.verdicts, "verdicts"), first_set(bed))


@query(f'SELECT "sampleId", "cellId", "setId", {_PER_IDENTITY.format("state")} FROM dense WHERE "setId" = {_FIRST_SET} GROUP BY 1, 2, 3')
def cells_expanded(spark, sf):
    bed = Bed(spark, sf)
    punch = S.cell_punch(S.cell_punch_long(bed.states, bed.members, bed.offered, bed.small), bed.universe)
    shown = K.expand_cells(stage(punch, "punch"), first_set(bed))
    return shown.select("sampleId", "cellId", "setId", *[F.split(i, r"\|")[0].alias(i) for i in bed.universe])


@query("""SELECT "setId", 'C-' || "setId" || ' — ' || count(*) || ' cells' AS title FROM linker GROUP BY 1""")
def set_title(spark, sf):
    bed = Bed(spark, sf)
    labels = bed.linker.select("setId", F.concat(F.lit("C-"), "setId").alias("label")).distinct()
    return K.set_title(labels, bed.linker.groupBy("setId").agg(F.count(F.lit(1)).alias("cellCount")))


# --- across arms -----------------------------------------------------------------------
@query("""SELECT t."sampleId", t."CELL" AS "cellId", p.feature, count(DISTINCT t."UMI") AS "umiCount" FROM tagged t
    JOIN (SELECT DISTINCT tag, feature FROM cpanel) p ON p.tag = t."FEATURE" WHERE t.matched GROUP BY 1, 2, 3""")
def recounted_from_reads(spark, sf):
    return M.recount_from_reads(roles.reads(spark, sf), roles.coded_panel(spark, sf), roles.GEOMETRY)


@query("""SELECT "sampleId", count(*) AS reads, bool_and(matched) AS "geometryOk", count(*) FILTER (WHERE "FEATURE" NOT IN (SELECT tag FROM cpanel)) AS "offPanel",
    count(DISTINCT CASE WHEN matched THEN "CELL" ELSE substr("CELL", 1, 20) END) AS cells FROM tagged GROUP BY 1""")
def read_geometry_report(spark, sf):
    return M.read_geometry_report(roles.reads(spark, sf), roles.coded_panel(spark, sf), roles.GEOMETRY)


_CHAINS = f"""SELECT o_orderpriority AS "sampleId", CAST(l_orderkey AS VARCHAR) AS "cellId", CASE WHEN l_linenumber % 2 = 1 THEN 'IGK' ELSE 'IGH' END AS locus,
    CASE WHEN l_partkey % 50 = 0 THEN 'TRB' WHEN l_linenumber % 2 = 1 THEN 'IGK' ELSE 'IGH' END || 'V' || (l_suppkey % 7) AS v,
    CASE WHEN l_linenumber % 2 = 1 THEN 'IGK' ELSE 'IGH' END || 'J' || (l_suppkey % 4) AS j,
    {code_sql("l_partkey", 12)} || CASE WHEN l_suppkey % 40 = 0 THEN 'N' WHEN l_suppkey % 41 = 0 THEN 'A' ELSE '' END AS junction,
    l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_tax, l_quantity FROM ol"""
_KEYS = f"""SELECT "sampleId", "cellId", CASE WHEN h IS NOT NULL AND l IS NOT NULL THEN h || '|' || l END AS "setKey" FROM (
    SELECT "sampleId", "cellId", arg_min(v || '|' || j || '|' || junction, struct_pack(n := n, p := p, s := s)) FILTER (WHERE locus = 'IGH') AS h,
        arg_min(v || '|' || j || '|' || junction, struct_pack(n := n, p := p, s := s)) FILTER (WHERE locus = 'IGK') AS l FROM ({_CHAINS}) GROUP BY 1, 2)"""


@query(_KEYS)
def set_keys_from_chains(spark, sf):
    return M.set_key_from_chains(roles.chains(spark, sf))


@query(f"""SELECT "sampleId", count(*) AS chains, count(*) FILTER (WHERE NOT regexp_full_match(junction, '[ACGT]*') OR length(junction) % 3 <> 0) AS "badJunction",
    count(*) FILTER (WHERE l_tax = 0.0 OR l_quantity < 1) AS "badCount", count(*) FILTER (WHERE left(v, 3) <> locus) AS "badGene" FROM ({_CHAINS}) GROUP BY 1""")
def chain_faults(spark, sf):
    return M.chain_faults(roles.chains(spark, sf))


@query(f"""SELECT "sampleId", "cellId", left(sha256("setKey"), 12) AS "setId" FROM ({_KEYS}) WHERE "setKey" IS NOT NULL""")
def linker_from_chains(spark, sf):
    return M.linker_from_chains(roles.chains(spark, sf))


@query(f"""SELECT "sampleId", count(*) AS cells, count(*) FILTER (WHERE "setKey" IS NULL) AS unpaired FROM ({_KEYS}) GROUP BY 1""")
def unpaired_cells(spark, sf):
    return M.unpaired_cells(M.set_key_from_chains(roles.chains(spark, sf)))


_MARKERS = sorted(M.PLASMA_MARKERS)
_GENES = "CASE k " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(_MARKERS)) + " WHEN 11 THEN 'GENE11' ELSE 'ENSG000000000' || lpad(CAST(k AS VARCHAR), 2, '0') END"
_EXPRESSION = f"""SELECT "sampleId", "cellId", CAST(coalesce(sum(value), 0) AS BIGINT) AS total, coalesce(avg(value) FILTER (WHERE k < 5), 0.0) AS "markerMean",
    count(*) FILTER (WHERE value IS NULL OR value < 0) AS "badValues", count(*) FILTER (WHERE NOT regexp_full_match(gene, 'ENSG[0-9]{{11}}')) AS "badGenes" FROM (
    SELECT *, {_GENES} AS gene FROM (SELECT o_orderpriority AS "sampleId", CAST(l_orderkey AS VARCHAR) AS "cellId", l_partkey % 12 AS k,
        CASE WHEN l_discount = 0.1 THEN NULL ELSE CAST(l_quantity AS BIGINT) - 1 END AS value FROM ol)) GROUP BY 1, 2"""


@query(f'SELECT "sampleId", "cellId", total, round("markerMean", 6) AS "markerMean", "badValues", "badGenes" FROM ({_EXPRESSION})')
def expression_cells(spark, sf):
    return rounded(M.expression_cells(roles.expression(spark, sf)), "markerMean")


@query(f"""SELECT "sampleId", count(*) AS cells, sum("badGenes") = 0 AS "geneIdsOk", sum("badValues") = 0 AS "valuesOk", min(total) > 0 AS "noEmptyCell" FROM ({_EXPRESSION}) GROUP BY 1""")
def expression_checks(spark, sf):
    return M.expression_checks(M.expression_cells(roles.expression(spark, sf)))


@query("""SELECT coalesce(a."sampleId", b."sampleId") AS "sampleId", count(*) FILTER (WHERE b."cellId" IS NULL) AS "onlyFirst", count(*) FILTER (WHERE a."cellId" IS NULL) AS "onlySecond",
    count(*) FILTER (WHERE a."cellId" IS NOT NULL AND b."cellId" IS NOT NULL) AS both FROM (SELECT DISTINCT "sampleId", "cellId" FROM counts) a
    FULL JOIN listed b ON b."sampleId" = a."sampleId" AND b."cellId" = a."cellId" GROUP BY 1""")
def arm_coverage(spark, sf):
    return M.arm_coverage(roles.counts(spark, sf), roles.cell_list(spark, sf))


@query("""AND s AS (SELECT l."setId", c.tag, CAST(sum(c."umiCount") AS BIGINT) AS n FROM counts c JOIN linker l ON l."sampleId" = c."sampleId" AND l."cellId" = c."cellId" GROUP BY 1, 2)
    SELECT "setId", arg_min(tag, struct_pack(a := -n, b := tag)) AS "dominantTag", max(n) AS "umiCount" FROM s GROUP BY 1""")
def set_dominant_tag(spark, sf):
    return M.set_dominant_tag(roles.counts(spark, sf).select("sampleId", "cellId", "tag", "umiCount"), roles.linker(spark, sf))


_SET_MARKER = f"""SELECT l."setId", count(*) AS cells, avg(coalesce(e."markerMean", 0.0)) AS "markerMean" FROM linker l LEFT JOIN ({_EXPRESSION}) e
    ON e."sampleId" = l."sampleId" AND e."cellId" = l."cellId" GROUP BY 1"""


@query(f'SELECT "setId", cells, round("markerMean", 6) AS "markerMean" FROM ({_SET_MARKER})')
def set_marker_mean(spark, sf):
    cells = M.expression_cells(roles.expression(spark, sf))
    return rounded(M.set_marker_mean(cells, roles.linker(spark, sf)), "markerMean")


@query(f"""AND p AS (SELECT CAST(o_custkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS "setId", CASE o_orderstatus WHEN 'P' THEN 'ambiguous' ELSE o_orderstatus END AS planted FROM orders)
    SELECT kind, count(*) AS sets, round(avg("markerMean"), 6) AS "markerMean" FROM ({_SET_MARKER}) m JOIN (
        SELECT "setId", CASE WHEN min(planted) = 'ambiguous' THEN 'ambiguous' ELSE 'binder' END AS kind FROM p GROUP BY 1 HAVING count(DISTINCT planted) = 1) k
    ON k."setId" = m."setId" GROUP BY 1""")
def marker_contrast(spark, sf):
    """Sets of one closed status against sets of pending orders, in the roles of binders and ambiguous sets."""
    planted = roles.table(spark, sf, "orders").select(
        F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.year("o_orderdate").cast("string")).alias("setId"),
        F.when(F.col("o_orderstatus") == "P", "ambiguous").otherwise(F.col("o_orderstatus")).alias("planted"),
    )
    means = M.set_marker_mean(M.expression_cells(roles.expression(spark, sf)), roles.linker(spark, sf))
    return M.marker_contrast(means, planted, ["F", "O"]).withColumn("markerMean", r6("markerMean"))
