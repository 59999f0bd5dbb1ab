"""Registry, shared inputs, and the SQL fragments the oracles are built from."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panels as P
from ..operators import sets as S
from ..operators import states as X
from ..plans import roles
from ..sources.sinks import stage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, instead: dict[str, str] | None = None):
    """Register a (spark, sf_dir) function and the SQL giving the same rows, with some parts replaced."""

    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_parts(sql, instead)
        return fn

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


class Bed:
    """The inputs most queries share. Counts and panel are written once, as a run's first stage would."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    @cached_property
    def counts(self) -> DataFrame:
        return stage(roles.counts(self.spark, self.sf), "counts")

    @cached_property
    def panel(self) -> DataFrame:
        return stage(roles.panel(self.spark, self.sf), "panel")

    @cached_property
    def small(self) -> bool:
        from ..functions.joins import fits

        return fits(self.panel)

    @cached_property
    def refs(self) -> DataFrame:
        return stage(roles.references(self.panel), "references")

    @cached_property
    def grouping(self) -> DataFrame:
        return stage(P.make_grouping(self.panel, roles.GROUPING, self.refs)[0], "grouping")

    @cached_property
    def tag_grouping(self) -> DataFrame:
        return stage(P.default_grouping(self.panel, self.refs), "tags")

    @cached_property
    def universe(self) -> list[str]:
        return sorted(r[0] for r in P.identity_universe(self.grouping).collect())

    @cached_property
    def seen(self) -> DataFrame:
        return stage(P.seen_pairs(self.counts), "seen")

    @cached_property
    def offered(self) -> DataFrame:
        return stage(P.offered(self.grouping, self.seen), "offered")

    @cached_property
    def offered_tags(self) -> DataFrame:
        return stage(P.offered(self.tag_grouping, self.seen).withColumnRenamed("identity", "tag"), "offered")

    @cached_property
    def linker(self) -> DataFrame:
        return roles.linker(self.spark, self.sf)

    @cached_property
    def cell_list(self) -> DataFrame:
        return roles.cell_list(self.spark, self.sf)

    @cached_property
    def cells(self) -> DataFrame:
        return roles.cells(self.spark, self.sf)

    @cached_property
    def floored(self) -> DataFrame:
        return X.apply_floor(self.counts, 4, self.refs, self.small)

    @cached_property
    def reference(self) -> DataFrame:
        return X.reference_declared(self.counts, self.refs, self.cells, self.small)

    @cached_property
    def states(self) -> DataFrame:
        return self.states_by(self.grouping)

    @cached_property
    def tag_states(self) -> DataFrame:
        return self.states_by(self.tag_grouping)

    def states_by(self, grouping: DataFrame) -> DataFrame:
        return X.states_from_counts(self.counts, grouping, self.refs, "declared", 4, 75.0, roles.GATE, self.small)

    @property
    def marked_members(self) -> DataFrame:
        gated = X.cells_over_limit(self.counts, self.refs, roles.GATE, self.small)
        return S.with_admissibility(S.cells_by_set(self.linker), gated)

    @cached_property
    def members(self) -> DataFrame:
        return stage(self.marked_members, "members")

    @cached_property
    def member_cells(self) -> DataFrame:
        """The members without their sets, which need not be sound for what asks for samples alone."""
        return stage(self.marked_members.drop("setId"), "members")

    @cached_property
    def patterns(self) -> tuple[DataFrame, DataFrame]:
        return S.offer_patterns(self.members, self.offered, self.universe, self.small)

    @cached_property
    def offered_verdicts(self) -> DataFrame:
        return S.combine_offered(self.states, self.members, self.offered, small=self.small)

    @property
    def verdicts(self) -> DataFrame:
        return S.whole_verdicts(self.offered_verdicts, *self.patterns)


def score_sql(n: str, r: str) -> str:
    """The score as SQL over whole counts: the upper tail of a binomial."""
    trials = f"(({n}) + ({r}) + 3)"
    term = (
        f"exp(lgamma({trials} + 1) - lgamma(j + 1) - lgamma({trials} - j + 1)"
        f" + j * ln(0.075) + ({trials} - j) * ln(0.925))"
    )
    return f"greatest(0.0, 100 * (1 - list_sum([{term} FOR j IN range(0, CAST(({r}) + 3 AS BIGINT))])))"


# each part may use the parts above it
PARTS: dict[str, str] = {
    "ol": """SELECT l.*, p.p_brand, o.o_orderpriority FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
        JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "counts": """SELECT o_orderpriority AS "sampleId", CAST(l_orderkey AS VARCHAR) AS "cellId", p_brand AS tag,
        CAST(sum(l_quantity) AS BIGINT) AS "umiCount", count(*) AS "totalWeight" FROM ol GROUP BY 1, 2, 3""",
    "cells": """SELECT o_orderpriority AS "sampleId", CAST(o_orderkey AS VARCHAR) AS "cellId" FROM orders""",
    "linker": """SELECT o_orderpriority AS "sampleId", CAST(o_orderkey AS VARCHAR) AS "cellId",
        CAST(o_custkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS "setId" FROM orders""",
    "listed": """SELECT o_orderpriority AS "sampleId", CAST(o_orderkey AS VARCHAR) AS "cellId" FROM orders
        WHERE o_orderstatus <> 'P'""",
    "samples": """SELECT DISTINCT o_orderpriority AS "sampleId" FROM orders""",
    "panel_rows": """SELECT n * 10 + CAST(left(sample, 1) AS BIGINT) AS _row, tag, sample,
        CASE WHEN n = 9 AND sample = '2-HIGH' THEN 'antigen 9b' WHEN n = 10 THEN 'antigen 4' ELSE 'antigen ' || n END AS feature,
        CASE WHEN n = 1 THEN 'Control' ELSE 'Target' END AS role, 'F' || (n % 8) AS family,
        CASE WHEN n = 7 THEN '' WHEN n = 5 AND sample = '3-MEDIUM' THEN 'L9' WHEN n = 1 THEN ' L1 ' ELSE 'L' || (n % 3) END AS lot
        FROM (SELECT DISTINCT p_brand AS tag, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part),
             (SELECT DISTINCT o_orderpriority AS sample FROM orders)
        WHERE NOT (n % 8 = 2 AND sample IN ('1-URGENT', '5-LOW'))""",
    "panel": "SELECT tag, sample, feature, role, family, lot FROM panel_rows",
    "refs": "SELECT DISTINCT tag FROM panel WHERE role = 'Control'",
    "grp": """SELECT tag, sample AS "sampleId", family AS identity FROM panel WHERE role <> 'Control'""",
    "tgrp": """SELECT tag, sample AS "sampleId", tag AS identity FROM panel WHERE role <> 'Control'""",
    "seen": """SELECT DISTINCT "sampleId", tag FROM counts""",
    "offered": """SELECT DISTINCT g."sampleId", g.identity FROM grp g JOIN seen s ON s."sampleId" = g."sampleId" AND s.tag = g.tag""",
    "toffered": """SELECT DISTINCT g."sampleId", g.tag FROM tgrp g JOIN seen s ON s."sampleId" = g."sampleId" AND s.tag = g.tag""",
    "floored": """SELECT "sampleId", "cellId", tag,
        CASE WHEN "umiCount" < 4 AND tag NOT IN (SELECT tag FROM refs) THEN 0 ELSE "umiCount" END AS "umiCount" FROM counts""",
    "ref": """SELECT c."sampleId", c."cellId", coalesce(max(k."umiCount"), 0) AS "referenceCount" FROM cells c
        LEFT JOIN (SELECT * FROM counts WHERE tag IN (SELECT tag FROM refs)) k
        ON k."sampleId" = c."sampleId" AND k."cellId" = c."cellId" GROUP BY 1, 2""",
    "ident": """SELECT f."sampleId", f."cellId", g.identity, max(f."umiCount") AS "umiCount" FROM floored f
        JOIN grp g ON g."sampleId" = f."sampleId" AND g.tag = f.tag GROUP BY 1, 2, 3""",
    "tident": """SELECT f."sampleId", f."cellId", g.identity, max(f."umiCount") AS "umiCount" FROM floored f
        JOIN tgrp g ON g."sampleId" = f."sampleId" AND g.tag = f.tag GROUP BY 1, 2, 3""",
    "scores": f"""SELECT n, r, {score_sql("n", "r")} AS score FROM (
        SELECT DISTINCT i."umiCount" AS n, f."referenceCount" AS r FROM tident i JOIN ref f
        ON f."sampleId" = i."sampleId" AND f."cellId" = i."cellId")""",
}


def _states_sql(ident: str) -> str:
    return f"""SELECT i."sampleId", i."cellId", i.identity, i."umiCount", f."referenceCount",
        CASE WHEN f."referenceCount" > 40 THEN 'unreliable' WHEN s.score >= 75 THEN 'bound' ELSE 'not bound' END AS state,
        CASE WHEN f."referenceCount" > 40 THEN 'cell set aside by the sticky cell limit' END AS "unreliableReason"
        FROM {ident} i JOIN ref f ON f."sampleId" = i."sampleId" AND f."cellId" = i."cellId"
        JOIN scores s ON s.n = i."umiCount" AND s.r = f."referenceCount\""""


PARTS["states"] = _states_sql("ident")
PARTS["tstates"] = _states_sql("tident")
# the dense form: one row per member cell and identity its sample was offered, silent cells included
PARTS["dense"] = """SELECT l."setId", l."sampleId", l."cellId", o.identity, f."referenceCount" > 40 AS gated,
        s.identity IS NOT NULL AS observed, CASE WHEN f."referenceCount" > 40 THEN 'unreliable' ELSE coalesce(s.state, 'not bound') END AS state,
        CASE WHEN f."referenceCount" > 40 THEN 'cell set aside by the sticky cell limit' END AS reason
        FROM linker l JOIN offered o ON o."sampleId" = l."sampleId"
        JOIN ref f ON f."sampleId" = l."sampleId" AND f."cellId" = l."cellId"
        LEFT JOIN states s ON s."sampleId" = l."sampleId" AND s."cellId" = l."cellId" AND s.identity = o.identity"""
PARTS["tdense"] = """SELECT l."setId", l."sampleId", l."cellId", o.tag AS identity, s.identity IS NOT NULL AS observed,
        CASE WHEN f."referenceCount" > 40 THEN 'unreliable' ELSE coalesce(s.state, 'not bound') END AS state
        FROM linker l JOIN toffered o ON o."sampleId" = l."sampleId"
        JOIN ref f ON f."sampleId" = l."sampleId" AND f."cellId" = l."cellId"
        LEFT JOIN tstates s ON s."sampleId" = l."sampleId" AND s."cellId" = l."cellId" AND s.identity = o.tag"""


def verdict_sql(min_voters: int = 1, min_agreement: float | None = None) -> str:
    below = f"agreement < {min_agreement}" if min_agreement is not None else "false"
    return f"""SELECT "setId", identity,
        CASE WHEN asked = 0 THEN 'never asked' WHEN answered < {min_voters} OR answered = 0 OR b = n OR {below} THEN 'unreliable'
             WHEN b > n THEN 'bound' ELSE 'not bound' END AS state,
        asked AS "cellsAsked", answered AS "cellsAnswered", b AS "cellsBound", n AS "cellsNotBound",
        CASE WHEN answered >= {min_voters} AND answered > 0 THEN agreement END AS agreement,
        CASE WHEN asked = 0 THEN 'never-offered' WHEN answered = 0 THEN (CASE WHEN gated = asked THEN 'all-cells-gated' ELSE 'no-comparator' END)
             WHEN answered < {min_voters} THEN 'too-few-voters' WHEN b = n THEN 'tie' WHEN {below} THEN 'below-agreement-floor' END AS "unreliableReason"
        FROM (SELECT *, b + n AS answered, greatest(b, n) / nullif(b + n, 0) AS agreement FROM (
            SELECT u."setId", u.identity, count(d."cellId") AS asked,
                count(*) FILTER (WHERE d.state = 'bound') AS b, count(*) FILTER (WHERE d.state = 'not bound') AS n,
                count(*) FILTER (WHERE d.gated) AS gated
            FROM (SELECT DISTINCT l."setId", g.identity FROM linker l, (SELECT DISTINCT identity FROM grp) g) u
            LEFT JOIN dense d ON d."setId" = u."setId" AND d.identity = u.identity GROUP BY 1, 2))"""


PARTS["verdicts"] = verdict_sql()

# reads, one per line item
_CODE = "translate(to_base({0}, 4, {1}), '0123', 'ACGT')"


def code_sql(number: str, width: int) -> str:
    return _CODE.format(number, width)


def _swap(text: str, at: str) -> str:
    return f"substr({text}, 1, {at} - 1) || translate(substr({text}, {at}, 1), 'ACGT', 'CGTA') || substr({text}, {at} + 1)"


PARTS["coded"] = f"""SELECT o_orderpriority AS "sampleId", l_linenumber AS weight, l_orderkey, l_partkey, l_suppkey, l_linenumber, p_brand,
        (l_orderkey * 7 + l_linenumber * 3 + l_suppkey) % 20 AS kind,
        repeat({code_sql("l_orderkey", 12)}, 2) AS cell0,
        repeat({code_sql("CAST(substr(p_brand, 7) AS BIGINT) - 1", 3)}, 5) AS tag0,
        {code_sql("(l_suppkey * 13 + l_linenumber) % 1048576", 10)} AS umi FROM ol"""
PARTS["tagged"] = f"""SELECT "sampleId", weight, l_orderkey, l_partkey, l_suppkey, l_linenumber, kind <> 2 AS matched,
        CASE WHEN kind = 3 THEN {_swap("cell0", "(l_linenumber % 24 + 1)")} ELSE cell0 END AS "CELL", umi AS "UMI",
        CASE WHEN kind = 0 THEN {_swap("tag0", "(l_suppkey % 15 + 1)")} WHEN kind = 1 THEN {code_sql("l_partkey * 7919 + 11", 15)}
             WHEN kind = 4 THEN translate(substr(tag0, 1, 1), 'ACGT', 'CGTA') || substr(tag0, 2, 6)
                || translate(substr(tag0, 8, 1), 'ACGT', 'CGTA') || substr(tag0, 9) ELSE tag0 END AS "FEATURE" FROM coded"""
PARTS["mols"] = """SELECT "sampleId", "CELL", "UMI", "FEATURE", count(*) AS reads, CAST(sum(weight) AS BIGINT) AS weight
        FROM tagged WHERE matched GROUP BY 1, 2, 3, 4"""
PARTS["cpanel"] = f"""SELECT sample AS "sampleId", repeat({code_sql("CAST(substr(tag, 7) AS BIGINT) - 1", 3)}, 5) AS tag, tag AS feature FROM panel"""
PARTS["parse"] = """SELECT "sampleId", count(*) AS total, count(*) FILTER (WHERE matched) AS matched FROM tagged GROUP BY 1"""


def corrected_sql(max_subs: int, source: str = "mols") -> str:
    """Molecules of `source` snapped onto their sample's panel: the one nearest barcode within the distance."""
    return f"""SELECT m."sampleId", "CELL", "UMI", x.tag AS "FEATURE", CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(weight) AS BIGINT) AS weight
        FROM {source} m JOIN (
            SELECT "sampleId", "FEATURE", min(tag) AS tag FROM (
                SELECT s."sampleId", s."FEATURE", p.tag, hamming(s."FEATURE", p.tag) AS d,
                    min(hamming(s."FEATURE", p.tag)) OVER (PARTITION BY s."sampleId", s."FEATURE") AS best
                FROM (SELECT DISTINCT "sampleId", "FEATURE" FROM {source}) s JOIN cpanel p ON p."sampleId" = s."sampleId")
            WHERE d = best AND d <= {max_subs} GROUP BY 1, 2 HAVING count(*) = 1) x
        ON x."sampleId" = m."sampleId" AND x."FEATURE" = m."FEATURE" GROUP BY 1, 2, 3, 4"""


PARTS["placed"] = corrected_sql(1)
PARTS["stat"] = """SELECT "sampleId", "CELL", "FEATURE", CAST(sum(reads) AS BIGINT) AS count, CAST(sum(weight) AS BIGINT) AS "totalWeight",
        count(*) AS "unique_UMI" FROM placed GROUP BY 1, 2, 3"""
PARTS["refine"] = """SELECT a."sampleId", a."tagName", a.i AS "inputCount", coalesce(b.o, 0) AS "outputCount" FROM
        (SELECT "sampleId", 'CELL' AS "tagName", CAST(sum(reads) AS BIGINT) AS i FROM mols GROUP BY 1
         UNION ALL SELECT "sampleId", 'FEATURE', CAST(sum(reads) AS BIGINT) FROM mols GROUP BY 1) a
        LEFT JOIN (SELECT "sampleId", 'CELL' AS "tagName", CAST(sum(reads) AS BIGINT) AS o FROM mols GROUP BY 1
         UNION ALL SELECT "sampleId", 'FEATURE', CAST(sum(reads) AS BIGINT) FROM placed GROUP BY 1) b
        ON a."sampleId" = b."sampleId" AND a."tagName" = b."tagName\""""
PARTS["barcodes"] = """SELECT "sampleId", "CELL" AS barcode, CAST(sum("unique_UMI") AS BIGINT) AS "umiCount",
        CAST(sum(count) AS BIGINT) AS "readCount" FROM stat GROUP BY 1, 2"""


def aggregate_sql(multiplier: float, minimum: float, top: int) -> str:
    return f"""SELECT "sampleId", any_value(tested) AS tested, any_value(threshold) AS threshold,
        count(*) FILTER (WHERE threshold >= {minimum} AND "umiCount" >= threshold) AS flagged,
        CAST(coalesce(sum("readCount") FILTER (WHERE threshold >= {minimum} AND "umiCount" >= threshold), 0) AS BIGINT) AS "flaggedReads"
        FROM (SELECT *, q3 + (q3 - q1) * {multiplier} AS threshold FROM (
            SELECT *, count(*) OVER w AS tested, quantile_cont("umiCount", 0.25) OVER w AS q1, quantile_cont("umiCount", 0.75) OVER w AS q3 FROM (
                SELECT *, row_number() OVER (PARTITION BY "sampleId" ORDER BY "umiCount" DESC, barcode) AS rn FROM barcodes)
            WHERE rn <= {top} WINDOW w AS (PARTITION BY "sampleId"))) GROUP BY 1"""


PARTS["outliers"] = aggregate_sql(3.0, 1000.0, 100)
PARTS["readqc"] = """SELECT p."sampleId", p.total AS "readsTotal", p.matched AS "readsMatched",
        CASE WHEN p.total > 0 THEN p.matched / p.total END AS "matchedFraction",
        coalesce(c.cells, 0) AS "cellsDetected", coalesce(f.features, 0) AS "featuresDetected", coalesce(c.umis, 0) AS "totalUniqueUmis",
        c.med AS "medianUmisPerCell",
        CASE WHEN p.matched > 0 THEN r.fo / p.matched END AS "panelAssignedFraction",
        CASE WHEN p.matched > 0 THEN (r.fi - r.fo) / p.matched END AS "featureDroppedShare",
        CASE WHEN r.ci > 0 THEN r.co / r.ci END AS "cellBarcodeValidFraction", r.ci AS "cellBarcodeIn", r.co AS "cellBarcodeOut",
        CASE WHEN p.total > 0 THEN coalesce(o."flaggedReads", 0) / p.total END AS "aggregateBarcodeFraction",
        coalesce(o.flagged, 0) AS "aggregateBarcodesFlagged", o.threshold AS "aggregateBarcodeThreshold"
        FROM parse p
        LEFT JOIN (SELECT "sampleId", count(*) AS cells, CAST(sum("umiCount") AS BIGINT) AS umis, median("umiCount") AS med FROM barcodes GROUP BY 1) c ON c."sampleId" = p."sampleId"
        LEFT JOIN (SELECT "sampleId", count(DISTINCT "FEATURE") AS features FROM stat GROUP BY 1) f ON f."sampleId" = p."sampleId"
        LEFT JOIN outliers o ON o."sampleId" = p."sampleId"
        LEFT JOIN (SELECT "sampleId", max("inputCount") FILTER (WHERE "tagName" = 'CELL') AS ci, max("outputCount") FILTER (WHERE "tagName" = 'CELL') AS co,
            max("inputCount") FILTER (WHERE "tagName" = 'FEATURE') AS fi, max("outputCount") FILTER (WHERE "tagName" = 'FEATURE') AS fo FROM refine GROUP BY 1) r
            ON r."sampleId" = p."sampleId\""""
PARTS["raw"] = """SELECT "sampleId", "FEATURE", CAST(sum(reads) AS BIGINT) AS count, CAST(sum(weight) AS BIGINT) AS "totalWeight" FROM mols GROUP BY 1, 2"""
PARTS["marked"] = """SELECT r.*, p.tag IS NOT NULL AS declared FROM raw r LEFT JOIN cpanel p ON p."sampleId" = r."sampleId" AND p.tag = r."FEATURE\""""
PARTS["tally"] = """SELECT "sampleId", CAST(sum("totalWeight") AS BIGINT) AS "totalWeight",
        CAST(coalesce(sum("totalWeight") FILTER (WHERE NOT declared), 0) AS BIGINT) AS "undeclaredWeight",
        count(*) FILTER (WHERE NOT declared) AS "undeclaredDistinct",
        coalesce(sum("totalWeight") FILTER (WHERE NOT declared), 0) / sum("totalWeight") AS "undeclaredShare",
        greatest(0, count(*) FILTER (WHERE NOT declared) - 1000) AS elided FROM marked GROUP BY 1"""
PARTS["declared"] = """SELECT DISTINCT sample AS "sampleId", tag FROM panel"""
PARTS["panels"] = """SELECT "sampleId", left(sha256(array_to_string(list(tag ORDER BY tag), chr(9))), 12) AS "panelId", count(*) AS barcodes
        FROM declared GROUP BY 1"""


def with_parts(body: str, instead: dict[str, str] | None = None) -> str:
    """The body after the parts it uses, directly or through another part; `instead` takes the place of parts by name.

    A body that starts with AND brings further parts, with AND RECURSIVE such that read themselves.
    """
    import re

    parts = {**PARTS, **(instead or {})}
    met: set[str] = set()
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b[a-z_]+\b", re.sub(r"'[^']*'", "''", text)):
            if word in parts and word not in met:
                met.add(word)
                visit(parts[word])
                order.append(word)

    visit(body)
    head = ",\n".join(f"{k} AS MATERIALIZED ({parts[k]})" for k in order)
    body = body.strip()
    if not head:
        return body
    turns = "RECURSIVE " if body.startswith("AND RECURSIVE ") else ""
    return f"WITH {turns}{head}{',' if body.startswith('AND ') else ''}\n{body.removeprefix('AND ').removeprefix(turns)}"
