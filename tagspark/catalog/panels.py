"""What the panel declares, and the checks on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as D
from ..operators import panels as P
from ..operators import states as X
from ..plans import roles
from ..sources.panel import keyed_rows, panel_faults
from ..sources.sinks import stage
from .base import Bed, query

PROPERTIES = ["feature", "role", "family", "lot"]
LONG_SQL = " UNION ALL ".join(
    f"SELECT _row, tag, sample, '{c}' AS \"column\", trim({c}) AS value FROM panel_rows WHERE trim({c}) <> ''" for c in PROPERTIES
)
DISTINCT_SQL = f'SELECT DISTINCT tag, "column", value FROM ({LONG_SQL})'


def panel_of(spark, sf):
    return stage(roles.panel(spark, sf), "panel")


@query("""SELECT 'blank-barcode' AS fault, _row AS line, '' AS what FROM panel_rows WHERE tag = 'Brand#3'
    UNION ALL SELECT 'blank-sample', _row, tag FROM panel_rows WHERE tag <> 'Brand#3' AND tag = 'Brand#4'
    UNION ALL SELECT 'literal-any', _row, tag FROM panel_rows WHERE tag = 'Brand#5'
    UNION ALL SELECT 'declared-twice', NULL, tag || '/' || sample FROM panel_rows WHERE tag = 'Brand#6'
    UNION ALL SELECT DISTINCT 'declared-twice', NULL, 'Brand#4/' FROM panel_rows
    UNION ALL SELECT DISTINCT 'declared-twice', NULL, 'Brand#5/*' FROM panel_rows""")
def panel_faults_found(spark, sf):
    """The reader's checks on a panel with every fault planted in it."""
    rows = roles.panel_rows(spark, sf)
    broken = rows.unionByName(rows.filter("Sequence = 'Brand#6'").withColumn("_row", F.col("_row") + 1000)).select(
        "_row",
        F.when(F.col("Sequence") == "Brand#3", " ").otherwise(F.col("Sequence")).alias("Sequence"),
        F.when(F.col("Sequence") == "Brand#4", "").when(F.col("Sequence") == "Brand#5", "*").otherwise(F.col("Samples")).alias("Samples"),
        "feature", "role", "family", "lot",
    )
    return panel_faults(keyed_rows(broken, roles.ROLES), True)


@query("SELECT * FROM (VALUES ('feature'), ('role'), ('family'), ('lot')) v(name) WHERE (SELECT count(*) FROM panel) > 0")
def property_columns(spark, sf):
    panel = roles.panel(spark, sf)
    names = F.array(*[F.lit(c) for c in P.property_columns(panel)])
    return panel.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.explode(names).alias("name"))


@query(f'SELECT tag, "column", any_value(value) AS value FROM ({DISTINCT_SQL}) GROUP BY 1, 2 HAVING count(*) = 1')
def consistent_properties(spark, sf):
    return P.consistent_properties(panel_of(spark, sf), PROPERTIES)


@query(f"""SELECT tag, "column", array_to_string(list(value ORDER BY value), ' / ') AS declared FROM ({DISTINCT_SQL}) GROUP BY 1, 2 HAVING count(*) > 1""")
def property_conflicts(spark, sf):
    return P.property_conflicts(panel_of(spark, sf), PROPERTIES).withColumn("declared", F.concat_ws(" / ", "declared"))


@query("SELECT tag FROM refs")
def reference_tags(spark, sf):
    return roles.references(panel_of(spark, sf))


@query('SELECT tag, "sampleId" AS sample, identity FROM tgrp')
def default_grouping(spark, sf):
    panel = panel_of(spark, sf)
    return P.default_grouping(panel, roles.references(panel))


@query("""SELECT tag, sample, CASE WHEN trim(lot) <> '' THEN family || ' | ' || trim(lot) ELSE tag END AS identity, trim(lot) <> '' AS grouped
    FROM panel WHERE role <> 'Control'""")
def property_grouping(spark, sf):
    """Identities from two columns; a row without one of the values keeps its tag."""
    panel = panel_of(spark, sf)
    return P.property_grouping(panel, ["family", "lot"], roles.references(panel))


@query("SELECT DISTINCT tag FROM panel WHERE role <> 'Control' AND trim(lot) = ''")
def ungrouped_tags(spark, sf):
    panel = panel_of(spark, sf)
    return P.ungrouped_tags(P.property_grouping(panel, ["family", "lot"], roles.references(panel)))


@query("SELECT DISTINCT feature || '|' || family AS value FROM panel")
def separator_values(spark, sf):
    panel = panel_of(spark, sf)
    return P.separator_values(panel.withColumn("pair", F.concat_ws("|", "feature", "family")), ["pair", "lot"])


@query("SELECT DISTINCT identity FROM grp")
def identity_universe(spark, sf):
    return P.identity_universe(Bed(spark, sf).grouping)


@query('SELECT "sampleId", tag FROM seen')
def seen_pairs(spark, sf):
    return P.seen_pairs(roles.counts(spark, sf))


@query('SELECT "sampleId", identity FROM offered')
def identities_offered(spark, sf):
    return Bed(spark, sf).offered


@query("""SELECT DISTINCT s."sampleId", s.tag AS identity FROM seen s JOIN panel p ON p.tag = s.tag WHERE p.role <> 'Control'""")
def identities_offered_everywhere(spark, sf):
    """A panel that declares its tags over every sample, met with what the reads carry."""
    bed = Bed(spark, sf)
    every = roles.any_sample_panel(bed.panel)
    return P.offered(P.default_grouping(every, bed.refs), bed.seen)


@query("""SELECT "sampleId", identity, 'true' AS offered FROM (SELECT * FROM offered)""")
def offered_table(spark, sf):
    return P.offered_table(Bed(spark, sf).offered)


@query('SELECT "sampleId", tag FROM samples, (SELECT DISTINCT tag FROM panel)')
def declarations_expanded(spark, sf):
    return P.expand_samples(roles.any_sample_panel(panel_of(spark, sf)), roles.samples(spark, sf))


@query('SELECT "sampleId", "panelId", barcodes FROM panels')
def panels_of_samples(spark, sf):
    samples = stage(roles.samples(spark, sf), "samples")
    return P.panels_of_samples(P.expand_samples(panel_of(spark, sf), samples), samples).withColumn("barcodes", F.col("barcodes").cast("bigint"))


PANEL_LABEL_SQL = """SELECT "panelId", 'P-' || row_number() OVER (ORDER BY "panelId") || ' (' || b || CASE WHEN b = 1 THEN ' barcode, ' ELSE ' barcodes, ' END
    || s || CASE WHEN s = 1 THEN ' sample)' ELSE ' samples)' END AS label FROM (SELECT "panelId", max(barcodes) AS b, count(*) AS s FROM panels GROUP BY 1)"""


@query(PANEL_LABEL_SQL)
def panel_labels(spark, sf):
    samples = stage(roles.samples(spark, sf), "samples")
    return P.panel_labels(P.panels_of_samples(P.expand_samples(panel_of(spark, sf), samples), samples))


@query(f'SELECT "sampleId", label AS "panelLabel" FROM panels JOIN ({PANEL_LABEL_SQL}) USING ("panelId")')
def sample_panel(spark, sf):
    samples = stage(roles.samples(spark, sf), "samples")
    return P.sample_panel(P.panels_of_samples(P.expand_samples(panel_of(spark, sf), samples), samples))


@query('SELECT DISTINCT tag, identity, CAST(1 AS BIGINT) AS "1" FROM grp')
def tag_identity(spark, sf):
    return P.tag_identity(Bed(spark, sf).grouping)


@query("SELECT tag, min(_row) AS position FROM panel_rows GROUP BY 1")
def tag_order(spark, sf):
    return P.tag_order(roles.panel_rows(spark, sf).withColumnRenamed("Sequence", "tag"))


_NAMES = f"""SELECT tag, array_to_string(list(value ORDER BY value), ' / ') AS name FROM ({DISTINCT_SQL}) WHERE "column" = 'feature' GROUP BY 1"""
_TAG_LABELS = f"SELECT tag, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || tag || ')' ELSE name END AS label FROM ({_NAMES})"


@query(_TAG_LABELS)
def tag_labels(spark, sf):
    panel = panel_of(spark, sf)
    return P.tag_labels(panel, panel, "feature")


@query(f"""SELECT tag AS identity, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || tag || ')' ELSE name END AS label
    FROM ({_NAMES}) WHERE tag NOT IN (SELECT tag FROM refs) UNION ALL SELECT tag, 'background control' FROM refs""")
def identity_labels_per_tag(spark, sf):
    panel = panel_of(spark, sf)
    refs = roles.references(panel)
    return P.identity_labels(P.default_grouping(panel, refs), panel, refs, "per-tag", "feature")


@query("""SELECT identity, CASE WHEN identity = 'Brand#9' THEN 'antigen 9 / antigen 9b' ELSE identity END AS label FROM (
    SELECT DISTINCT CASE WHEN trim(lot) <> '' THEN family || ' | ' || trim(lot) ELSE tag END AS identity FROM panel WHERE role <> 'Control')
    UNION ALL SELECT tag, 'background control' FROM refs""")
def identity_labels_by_property(spark, sf):
    panel = panel_of(spark, sf)
    refs = roles.references(panel)
    grouping = P.property_grouping(panel, ["family", "lot"], refs)
    return P.identity_labels(grouping, panel, refs, "property:family|lot", "feature", ["family", "lot"])


@query("""SELECT tag AS identity, array_to_string(list(DISTINCT feature ORDER BY feature), ' / ') AS declared FROM panel
    WHERE role <> 'Control' GROUP BY 1 HAVING count(DISTINCT feature) > 1""")
def identity_name_conflicts(spark, sf):
    bed = Bed(spark, sf)
    return P.identity_name_conflicts(bed.tag_grouping, bed.panel, "feature").withColumn("declared", F.concat_ws(" / ", "declared"))


_HELD = f"""SELECT DISTINCT g.identity, 'family' AS "column", g.identity AS value FROM grp g UNION ALL
    SELECT identity, "column", any_value(value) FROM (SELECT DISTINCT g.identity, d."column", d.value, d.n FROM (SELECT DISTINCT tag, identity FROM grp) g
        JOIN (SELECT *, count(*) OVER (PARTITION BY tag, "column") AS n FROM ({DISTINCT_SQL})) d ON d.tag = g.tag WHERE d."column" <> 'family')
    GROUP BY 1, 2 HAVING count(DISTINCT value) = 1 AND max(n) = 1"""


@query(_HELD)
def identity_properties(spark, sf):
    bed = Bed(spark, sf)
    grouping = P.property_grouping(bed.panel, ["family"], bed.refs)
    return P.identity_properties(grouping, bed.panel, PROPERTIES, ["family"])


@query(f"""SELECT identity, coalesce(max(value) FILTER (WHERE "column" = 'role'), '') AS role, coalesce(max(value) FILTER (WHERE "column" = 'family'), '') AS family
    FROM ({_HELD}) GROUP BY 1""")
def identity_property_table(spark, sf):
    bed = Bed(spark, sf)
    grouping = P.property_grouping(bed.panel, ["family"], bed.refs)
    held = stage(P.identity_properties(grouping, bed.panel, PROPERTIES, ["family"]), "held")
    return P.identity_property_table(grouping, held, PROPERTIES)


@query(f'SELECT DISTINCT "column", value FROM ({_HELD})')
def identity_property_values(spark, sf):
    bed = Bed(spark, sf)
    grouping = P.property_grouping(bed.panel, ["family"], bed.refs)
    return P.identity_property_values(P.identity_properties(grouping, bed.panel, PROPERTIES, ["family"]))


_FEATURE_LONG = " UNION ALL ".join(
    f"SELECT _row, feature, '{c}' AS \"column\", trim({c}) AS value FROM panel_rows WHERE trim({c}) <> ''" for c in PROPERTIES[1:]
)
_FIRST = f'SELECT feature, "column", arg_min(value, _row) AS value FROM ({_FEATURE_LONG}) GROUP BY 1, 2'


@query(_FIRST)
def feature_properties(spark, sf):
    """By feature name, the first value in file order."""
    return P.feature_properties(roles.panel_rows(spark, sf), "feature", PROPERTIES[1:])


@query(f"""SELECT DISTINCT l.feature, l."column", f.value AS kept, l.value AS other FROM ({_FEATURE_LONG}) l JOIN ({_FIRST}) f
    ON f.feature = l.feature AND f."column" = l."column" WHERE l.value <> f.value""")
def feature_property_conflicts(spark, sf):
    return P.feature_property_conflicts(stage(roles.panel_rows(spark, sf), "rows"), "feature", PROPERTIES[1:])


@query(f"""SELECT feature, coalesce(max(value) FILTER (WHERE "column" = 'role'), '') AS role, coalesce(max(value) FILTER (WHERE "column" = 'family'), '') AS family,
    coalesce(max(value) FILTER (WHERE "column" = 'lot'), '') AS lot FROM (SELECT feature, "column", value FROM ({_FIRST}) UNION ALL SELECT DISTINCT feature, '', '' FROM panel_rows) GROUP BY 1""")
def feature_property_table(spark, sf):
    return P.feature_property_table(stage(roles.panel_rows(spark, sf), "rows"), "feature", PROPERTIES[1:])


@query("""SELECT feature, min(_row) AS position, 'true' AS value FROM panel_rows WHERE role = 'Control' OR family = 'F4' GROUP BY 1""")
def negative_controls(spark, sf):
    chosen = roles.panel_rows(spark, sf).filter("role = 'Control' or family = 'F4'")
    return P.negative_controls(chosen.withColumn("feature", F.concat(F.lit(" "), "feature", F.lit(" "))))


@query(f'SELECT DISTINCT "column", value FROM ({LONG_SQL}) UNION ALL SELECT DISTINCT \'Sequence\', tag FROM panel_rows UNION ALL SELECT DISTINCT \'Samples\', sample FROM panel_rows')
def column_profile(spark, sf):
    return P.column_profile(roles.panel_rows(spark, sf), ["Sequence", "Samples", *PROPERTIES])


@query('SELECT count(*) AS "rowCount" FROM orders WHERE o_orderstatus <> \'P\'')
def profile_row_count(spark, sf):
    """Rows holding anything: orders whose cells are blanked for one status are no rows."""
    orders = roles.table(spark, sf, "orders")
    blanked = orders.select(*[F.when(F.col("o_orderstatus") != "P", F.col(c).cast("string")).otherwise(" ").alias(c) for c in orders.columns])
    return P.profile_row_count(blanked, blanked.columns)


@query("SELECT tag, sample, family FROM panel WHERE sample = '2-HIGH'")
def panel_for_sample(spark, sf):
    return P.panel_for_sample(roles.panel(spark, sf), "2-HIGH").select("tag", "sample", "family")


@query('SELECT count(DISTINCT tag) AS "panelSize" FROM panel')
def panel_size(spark, sf):
    return X.panel_size(roles.panel(spark, sf))


@query('SELECT min(hamming(a.tag, b.tag)) AS "minDistance" FROM (SELECT DISTINCT tag FROM cpanel) a JOIN (SELECT DISTINCT tag FROM cpanel) b ON a.tag < b.tag')
def min_pairwise_hamming(spark, sf):
    return P.min_pairwise_hamming(roles.coded_panel(spark, sf))


# --- checks ---------------------------------------------------------------------
def _profile(spark, sf):
    """The profile of a file with two columns that hold the sample names, one of them with more."""
    orders = roles.table(spark, sf, "orders")
    rows = orders.select(
        F.col("o_orderpriority").alias("exact"),
        F.when(F.col("o_orderstatus") == "P", F.concat("o_orderpriority", F.lit("-x"))).otherwise(F.col("o_orderpriority")).alias("wider"),
        roles.cell_code(F.col("o_orderkey")).alias("Sequence"),
        F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("Barcode"),
    )
    return P.column_profile(rows, rows.columns), {c: i for i, c in enumerate(rows.columns)}


@query("""SELECT 'exact' AS "column", true AS exact, CAST(0 AS BIGINT) AS extra FROM samples LIMIT 1""")
def sample_column_suggested(spark, sf):
    profile, order = _profile(spark, sf)
    return D.suggest_sample_column(profile, roles.samples(spark, sf).withColumnRenamed("sampleId", "name"), order)


@query("""SELECT 'Barcode' AS "column", count(DISTINCT o_custkey) AS offenders, count(DISTINCT o_custkey) AS checked, 'not sequences' AS reading FROM orders
    UNION ALL SELECT 'Sequence', 0, count(DISTINCT o_orderkey), 'alternative' FROM orders""")
def barcode_alphabet(spark, sf):
    profile, _ = _profile(spark, sf)
    return D.barcode_alphabet(profile, "Barcode", "exact")


@query("""SELECT 'S1' AS name, 'missing' AS side FROM samples WHERE "sampleId" = '1-URGENT' UNION ALL SELECT "sampleId", 'extra' FROM samples WHERE "sampleId" = '1-URGENT'""")
def sample_mapping_issues(spark, sf):
    have = roles.samples(spark, sf).select(F.col("sampleId").alias("name"))
    names = have.replace({"1-URGENT": "S1"}, subset=["name"])
    return D.sample_mapping(have, names)


@query('SELECT count(*) AS rows, count(DISTINCT tag) AS "distinctBarcodes", count(DISTINCT tag) < count(*) AS duplicated FROM panel')
def duplicate_barcodes(spark, sf):
    return D.duplicate_barcodes(roles.panel(spark, sf), "tag")


@query("""SELECT 'exact' AS "column" FROM samples LIMIT 1""")
def unkeyed_panel(spark, sf):
    profile, order = _profile(spark, sf)
    duplicates = D.duplicate_barcodes(roles.table(spark, sf, "part").select(F.col("p_partkey").alias("tag")), "tag")
    return D.unkeyed_panel(duplicates, D.suggest_sample_column(profile, roles.samples(spark, sf).withColumnRenamed("sampleId", "name"), order))


@query("""SELECT 'counts' AS pair, count(*) AS shared, count(*) = 0 AS "noneShared" FROM (SELECT DISTINCT "sampleId" FROM counts) c JOIN samples s ON s."sampleId" = c."sampleId"
    UNION ALL SELECT 'status', 0, true""")
def shared_samples(spark, sf):
    """Counts and linker meet; a linker keyed on other ids meets nothing."""
    counts, samples = roles.counts(spark, sf), roles.samples(spark, sf)
    other = roles.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("sampleId"))
    return (
        D.shared_samples(counts, samples).withColumn("pair", F.lit("counts"))
        .unionByName(D.shared_samples(counts, other).withColumn("pair", F.lit("status")))
    )
