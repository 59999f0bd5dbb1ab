"""Read-level operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.joins import fits
from ..operators import panels as P
from ..operators import reads as R
from ..plans import roles
from ..plans.reads import ReadSettings, ReadsRun
from ..plans.run import Settings
from ..sources.panel import Panel
from ..sources.sinks import stage
from .base import PARTS, code_sql, corrected_sql, query, r6
from .inputs import bed_read_qc


@query('SELECT "sampleId", matched, CASE WHEN matched THEN "CELL" END AS "CELL", CASE WHEN matched THEN "UMI" END AS "UMI", '
       'CASE WHEN matched THEN "FEATURE" END AS "FEATURE", weight FROM tagged')  # fmt: skip
def tags_extracted(spark, sf):
    geometry = R.parse_geometry(roles.GEOMETRY.pattern())
    tagged = R.extract_tags(roles.reads(spark, sf), geometry)
    return tagged.select("sampleId", "matched", "CELL", "UMI", "FEATURE", F.col("weight").cast("int").alias("weight"))


@query("""SELECT "sampleId", read_id FROM (SELECT *, row_number() OVER (PARTITION BY "sampleId" ORDER BY read_id) AS rn FROM (
    SELECT o_orderpriority AS "sampleId", lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 10, '0') || '-'
    || lpad(CAST(l_partkey AS VARCHAR), 10, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS read_id FROM ol)) WHERE rn <= 100""")
def reads_previewed(spark, sf):
    """The dry run: the first reads of each sample."""
    return R.preview_reads(roles.reads(spark, sf).select("sampleId", "read_id"), 100)


@query('SELECT "sampleId", total, matched FROM parse')
def parse_report(spark, sf):
    return R.parse_report(roles.tagged_reads(spark, sf))


@query('SELECT "sampleId", total, matched, matched > 0 AS "shouldContinue" FROM parse')
def samples_gated(spark, sf):
    return R.gate_samples(R.parse_report(roles.tagged_reads(spark, sf)))


@query("SELECT DISTINCT tag FROM cpanel")
def panel_barcodes(spark, sf):
    return P.panel_barcodes(roles.coded_panel(spark, sf))


@query('SELECT "sampleId", "CELL", "UMI", "FEATURE", reads, weight FROM placed')
def corrected_to_panel(spark, sf):
    mols = stage(R.molecules(roles.tagged_reads(spark, sf)), "molecules")
    return R.correct_to_panel(mols, stage(roles.coded_panel(spark, sf).select("sampleId", "tag"), "panel"))


@query(corrected_sql(2))
def corrected_to_panel_within_two(spark, sf):
    mols = stage(R.molecules(roles.tagged_reads(spark, sf)), "molecules")
    return R.correct_to_panel(mols, stage(roles.coded_panel(spark, sf).select("sampleId", "tag"), "panel"), max_subs=2)


# molecules whose tag lost or gained letters on the way, by the end of the molecule's code
_LAST = 'right("UMI", 2)'
_EDITED = f"""SELECT "sampleId", "CELL", "UMI", CASE
        WHEN {_LAST} IN ('AA', 'CA') THEN substr("FEATURE", 1, 4) || substr("FEATURE", 6)
        WHEN {_LAST} = 'GC' THEN substr("FEATURE", 1, 3) || 'T' || substr("FEATURE", 4)
        WHEN {_LAST} = 'GG' THEN substr("FEATURE", 1, 1) || substr("FEATURE", 3, 6) || substr("FEATURE", 10)
        WHEN {_LAST} = 'TC' THEN translate(substr("FEATURE", 1, 2), 'ACGT', 'CGTA') || substr("FEATURE", 3, 5) || substr("FEATURE", 9)
        WHEN {_LAST} = 'TT' THEN substr("FEATURE", 1, 2) || substr("FEATURE", 4) || 'A'
        WHEN {_LAST} = 'CG' THEN substr("FEATURE", 1, 5) || 'G' || substr("FEATURE", 6, 4) || 'A' || substr("FEATURE", 10)
        WHEN {_LAST} = 'TG' THEN substr("FEATURE", 5) ELSE "FEATURE" END AS "FEATURE", reads, weight FROM mols"""


def edited_molecules(spark, sf):
    """Molecules with letters put in or left out of their tag, as the parts of the SQL above spell it."""
    mols, tag, last = R.molecules(roles.tagged_reads(spark, sf)), F.col("FEATURE"), F.substring("UMI", -2, 2)
    part = lambda start, size=99: F.substring("FEATURE", start, size)
    spelled = (
        F.when(last.isin("AA", "CA"), F.concat(part(1, 4), part(6)))
        .when(last == "GC", F.concat(part(1, 3), F.lit("T"), part(4)))
        .when(last == "GG", F.concat(part(1, 1), part(3, 6), part(10)))
        .when(last == "TC", F.concat(F.translate(part(1, 2), "ACGT", "CGTA"), part(3, 5), part(9)))
        .when(last == "TT", F.concat(part(1, 2), part(4), F.lit("A")))
        .when(last == "CG", F.concat(part(1, 5), F.lit("G"), part(6, 4), F.lit("A"), part(10)))
        .when(last == "TG", part(5))
        .otherwise(tag)
    )
    return stage(mols.withColumn("FEATURE", spelled), "molecules")


def _out_sql(code: str, times: int = 1) -> str:
    """The code with letters taken out."""
    one = f"[substr({code}, 1, i - 1) || substr({code}, i + 1) FOR i IN range(1, length({code}) + 1)]"
    return one if times == 1 else f"flatten([[substr(x, 1, j - 1) || substr(x, j + 1) FOR j IN range(1, length(x) + 1)] FOR x IN {one}])"


def _apart_sql(a: str, b: str) -> str:
    """Errors between two codes by the kinds of an alignment: two substitutions, two indels, three in all."""
    least = lambda xs, y: f"list_min([hamming(q, {y}) FOR q IN {xs}])"
    both = f"list_min(flatten([[hamming(q, r) FOR r IN {_out_sql(b)}] FOR q IN {_out_sql(a)}]))"
    within = lambda n, most, more: f"(CASE WHEN {n} <= {most} THEN {n} + {more} END)"
    same = f"least({within(f'hamming({a}, {b})', 2, 0)}, {within(both, 1, 2)})"
    cases = {0: same, 1: within(least(_out_sql(b), a), 2, 1), -1: within(least(_out_sql(a), b), 2, 1), 2: within(least(_out_sql(b, 2), a), 1, 2), -2: within(least(_out_sql(a, 2), b), 1, 2)}
    return f"CASE length({b}) - length({a}) " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + " END"


@query(f"""AND edited AS ({_EDITED}), whole AS (SELECT "sampleId", "CELL", "UMI", "FEATURE", sum(reads) AS reads, sum(weight) AS weight FROM edited GROUP BY ALL),
    odd AS (SELECT DISTINCT "sampleId", "FEATURE" FROM whole), pairs AS (SELECT s."sampleId", s."FEATURE", p.tag FROM odd s JOIN cpanel p ON p."sampleId" = s."sampleId" AND levenshtein(s."FEATURE", p.tag) <= 3),
    apart AS (SELECT *, CASE WHEN tag = "FEATURE" THEN 0 ELSE {_apart_sql('"FEATURE"', 'tag')} END AS d FROM pairs),
    moves AS (SELECT "sampleId", "FEATURE", min(tag) AS tag FROM (SELECT *, min(d) OVER (PARTITION BY "sampleId", "FEATURE") AS best FROM apart) WHERE d = best GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT m."sampleId", "CELL", "UMI", x.tag AS "FEATURE", CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(weight) AS BIGINT) AS weight
    FROM whole m JOIN moves x ON x."sampleId" = m."sampleId" AND x."FEATURE" = m."FEATURE" GROUP BY 1, 2, 3, 4""")
def corrected_to_panel_with_indels(spark, sf):
    """Up to two substitutions, two letters put in or left out, and three errors in all."""
    panel = stage(roles.coded_panel(spark, sf).select("sampleId", "tag"), "panel")
    return R.correct_to_panel(edited_molecules(spark, sf), panel, max_subs=2, max_indels=2, max_errors=3)


def _near_sql(column: str) -> str:
    """All one-substitution neighbours of a code."""
    return (
        f"unnest(list_filter(flatten([[substr({column}, 1, i - 1) || b || substr({column}, i + 1) FOR b IN ['A', 'C', 'G', 'T']]"
        f" FOR i IN range(1, length({column}) + 1)]), lambda x: x <> {column}))"
    )


def _listed_sql(source: str) -> str:
    """Cells of `source` snapped onto the list of cell codes."""
    return f"""AND wl AS (SELECT DISTINCT repeat(translate(to_base(o_orderkey, 4, 12), '0123', 'ACGT'), 2) AS code FROM orders),
    moves AS (SELECT "CELL", min(near) AS moved FROM (
        SELECT "CELL", {_near_sql('"CELL"')} AS near FROM (SELECT DISTINCT "CELL" FROM {source} WHERE "CELL" NOT IN (SELECT code FROM wl)))
        WHERE near IN (SELECT code FROM wl) GROUP BY 1 HAVING count(DISTINCT near) = 1)
    SELECT m."sampleId", coalesce(w.code, v.moved) AS "CELL", "UMI", "FEATURE", CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(weight) AS BIGINT) AS weight
    FROM {source} m LEFT JOIN wl w ON w.code = m."CELL" LEFT JOIN moves v ON v."CELL" = m."CELL"
    WHERE coalesce(w.code, v.moved) IS NOT NULL GROUP BY 1, 2, 3, 4"""


@query(_listed_sql("mols"))
def corrected_to_whitelist(spark, sf):
    mols = stage(R.molecules(roles.tagged_reads(spark, sf)), "molecules")
    return R.correct_to_whitelist(mols, roles.whitelist(spark, sf))


def _de_novo_sql(column: str, within: str, source: str = "mols") -> str:
    keys = "".join(f', {k}' for k in within.split(", "))
    same = " AND ".join(f"s.{k} = b.{k}" for k in within.split(", "))
    join = " AND ".join(f"m.{k} = v.{k}" for k in [*within.split(", "), column])
    others = [c for c in ('"sampleId"', '"CELL"', '"UMI"', '"FEATURE"') if c != column]
    return f"""AND sizes AS (SELECT {within}, {column}, CAST(sum(reads) AS BIGINT) AS n FROM {source} GROUP BY ALL),
        tries AS (SELECT *, {_near_sql(column)} AS near FROM sizes),
        moves AS (SELECT {", ".join("s." + k for k in within.split(", "))}, s.{column}, arg_min(s.near, struct_pack(a := -b.n, c := s.near)) AS moved FROM tries s
            JOIN sizes b ON {same} AND b.{column} = s.near WHERE b.n >= s.n * 2.0 GROUP BY ALL)
        SELECT {", ".join("m." + c for c in others)}, coalesce(v.moved, m.{column}) AS {column},
            CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(weight) AS BIGINT) AS weight
        FROM {source} m LEFT JOIN moves v ON {join} GROUP BY ALL"""


@query(_de_novo_sql('"CELL"', '"sampleId"'))
def corrected_cells_de_novo(spark, sf):
    return R.correct_de_novo(stage(R.molecules(roles.tagged_reads(spark, sf)), "molecules"), "CELL", 2.0)


# cells whose reads grow from cell to cell, so that a code's neighbour moves on itself: half of them lose letters' weight
_SLOPE = """SELECT "sampleId", "CELL", "UMI", "FEATURE", CAST(reads * pow(3, length("CELL") - length(replace("CELL", 'A', ''))) AS BIGINT) AS reads, weight FROM
    (SELECT "sampleId", left("CELL", 3) || substr("CELL", 10, 3) AS "CELL", "UMI", "FEATURE", sum(reads) AS reads, CAST(sum(weight) AS BIGINT) AS weight FROM mols GROUP BY ALL)"""


@query(f"""AND RECURSIVE slope AS ({_SLOPE}), sizes AS (SELECT "sampleId", "CELL", CAST(sum(reads) AS BIGINT) AS n FROM slope GROUP BY ALL),
    tries AS (SELECT *, {_near_sql('"CELL"')} AS near FROM sizes),
    moves AS (SELECT s."sampleId", s."CELL", arg_min(s.near, struct_pack(a := -b.n, c := s.near)) AS moved FROM tries s
        JOIN sizes b ON b."sampleId" = s."sampleId" AND b."CELL" = s.near WHERE b.n >= s.n * 2.0 GROUP BY ALL),
    walk("sampleId", "CELL", reached, step) AS (SELECT "sampleId", "CELL", moved, 1 FROM moves
        UNION ALL SELECT w."sampleId", w."CELL", m.moved, step + 1 FROM walk w JOIN moves m ON m."sampleId" = w."sampleId" AND m."CELL" = w.reached),
    ends AS (SELECT "sampleId", "CELL", arg_max(reached, step) AS moved FROM walk GROUP BY ALL)
    SELECT m."sampleId", coalesce(v.moved, m."CELL") AS "CELL", "UMI", "FEATURE", CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(weight) AS BIGINT) AS weight
    FROM slope m LEFT JOIN ends v ON v."sampleId" = m."sampleId" AND v."CELL" = m."CELL" GROUP BY ALL""")
def corrected_cells_chained(spark, sf):
    """Short cell codes with reads that rise along the letters, so that moves follow each other."""
    mols = R.molecules(roles.tagged_reads(spark, sf))
    short = mols.withColumn("CELL", F.concat(F.substring("CELL", 1, 3), F.substring("CELL", 10, 3)))
    merged = R.merge_molecules(short)
    letters = F.length("CELL") - F.length(F.replace("CELL", F.lit("A"), F.lit("")))
    return R.correct_de_novo(stage(merged.withColumn("reads", (F.col("reads") * F.pow(F.lit(3), letters)).cast("bigint")), "molecules"), "CELL", 2.0, chained=True)


@query(_de_novo_sql('"UMI"', '"sampleId", "CELL", "FEATURE"'))
def corrected_molecules_de_novo(spark, sf):
    return R.correct_de_novo(stage(R.molecules(roles.tagged_reads(spark, sf)), "molecules"), "UMI", 2.0)


@query("""SELECT 'events' AS "sampleId", CAST(user_id AS VARCHAR) AS "CELL", event_type AS "FEATURE", count(*) AS count,
    CAST(sum(floor(value)) AS BIGINT) AS "totalWeight", count(DISTINCT props) AS "unique_UMI" FROM events GROUP BY 2, 3""")
def tag_stat(spark, sf):
    """Distinct molecules per cell and tag: events by user and type, distinct payloads."""
    return R.tag_stat(R.molecules(roles.event_tags(spark, sf)))


@query('SELECT "sampleId", "FEATURE", count, "totalWeight" FROM raw')
def raw_feature_stat(spark, sf):
    return R.raw_feature_stat(R.molecules(roles.tagged_reads(spark, sf)))


def _nested(sql: str) -> str:
    return sql.replace("AND ", "WITH ", 1)


# the three corrections in their order, and the tables of a run in the reads' own codes
_CHAIN = {
    "cellfix": _nested(_listed_sql("mols")),
    "featurefix": corrected_sql(1, "cellfix"),
    "umifix": _nested(_de_novo_sql('"UMI"', '"sampleId", "CELL", "FEATURE"', "featurefix")),
}
_CODED = {
    **_CHAIN,
    "counts": """SELECT "sampleId", "CELL" AS "cellId", "FEATURE" AS tag, count(*) AS "umiCount", CAST(sum(weight) AS BIGINT) AS "totalWeight" FROM umifix GROUP BY 1, 2, 3""",
    "panel": f"""SELECT repeat({code_sql("CAST(substr(tag, 7) AS BIGINT) - 1", 3)}, 5) AS tag, sample, feature, role, family, lot FROM panel_rows""",
    "cpanel": 'SELECT sample AS "sampleId", tag FROM panel',
    **{k: PARTS[k].replace("CAST(o_orderkey AS VARCHAR)", f"repeat({code_sql('o_orderkey', 12)}, 2)") for k in ("cells", "linker", "listed")},
}


def reads_run(spark, sf) -> ReadsRun:
    barcodes = stage(roles.coded_panel(spark, sf).select("sampleId", "tag"), "panel")
    return ReadsRun(roles.reads(spark, sf, named=False), barcodes, ReadSettings(roles.GEOMETRY), roles.whitelist(spark, sf))


def _step_sql(tag: str, before: str, after: str) -> str:
    return f"""SELECT b."sampleId", '{tag}' AS "tagName", b.n AS "inputCount", coalesce(a.n, 0) AS "outputCount" FROM
        (SELECT "sampleId", CAST(sum(reads) AS BIGINT) AS n FROM {before} GROUP BY 1) b
        LEFT JOIN (SELECT "sampleId", CAST(sum(reads) AS BIGINT) AS n FROM {after} GROUP BY 1) a ON a."sampleId" = b."sampleId\""""


@query(" UNION ALL ".join([_step_sql("CELL", "mols", "cellfix"), _step_sql("FEATURE", "cellfix", "featurefix"), _step_sql("UMI", "featurefix", "umifix")]), instead=_CHAIN)
def refine_report(spark, sf):
    """Reads into and out of the cell, feature and molecule steps of one chain."""
    return reads_run(spark, sf).refine_report


@query('SELECT "sampleId", "cellId", tag, "umiCount", "totalWeight" FROM counts', instead=_CODED)
def reads_to_counts(spark, sf):
    return reads_run(spark, sf).counts


@query("""SELECT "setId", identity, state, "cellsAsked", "cellsAnswered", "cellsBound", "cellsNotBound", round(agreement, 6) AS agreement, "unreliableReason" FROM verdicts""", instead=_CODED)
def reads_to_verdicts(spark, sf):
    """Reads, their corrections, counts and verdicts in one plan; cells and tags are named by their sequences."""
    coded = lambda df: df.withColumn("cellId", roles.cell_code(F.col("cellId")))
    panel = stage(roles.panel(spark, sf).withColumn("tag", roles.tag_code(F.col("tag"))), "panel")
    settings = Settings(source="declared", gate=roles.GATE, role_column="role", reference_values=("Control",), grouping=roles.GROUPING)
    run = reads_run(spark, sf).verdicts(Panel(panel, [], fits(panel)), settings, coded(roles.linker(spark, sf)), coded(roles.cell_list(spark, sf)))
    return run.verdicts.select(
        "setId", "identity", "state", "cellsAsked", "cellsAnswered", "cellsBound", "cellsNotBound", r6("agreement").alias("agreement"), "unreliableReason"
    )


@query("""SELECT "sampleId", segment, CAST(reads AS BIGINT) AS reads, round(reads / "readsTotal", 6) AS share FROM (
    SELECT "sampleId", "readsTotal", 'Panel-assigned' AS segment, round("readsMatched" * "panelAssignedFraction") AS reads FROM readqc
    UNION ALL SELECT "sampleId", "readsTotal", 'Not assigned', greatest(0, "readsMatched" - round("readsMatched" * "panelAssignedFraction")) FROM readqc
    UNION ALL SELECT "sampleId", "readsTotal", 'No pattern match', greatest(0, "readsTotal" - "readsMatched") FROM readqc) WHERE reads > 0""")
def read_recovery(spark, sf):
    return R.read_recovery(bed_read_qc(spark, sf)).withColumn("share", r6("share"))
