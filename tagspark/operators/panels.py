"""What the panel declares: tags, properties, identities, labels, and what each sample was offered.

All inputs but `counts` are panel-sized. Nothing here pairs samples with tags by a cross join: a declaration
over every sample is matched to the samples through the (sample, tag) pairs the reads carry, or expanded from
the sample roster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import joins
from ..functions import terms as t
from ..functions.text import counted, filled, trim_all
from ..sources.sinks import stage


def property_columns(panel: DataFrame) -> list[str]:
    return [c for c in panel.columns if c not in ("tag", "sample")]


def long_properties(panel: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row per panel row and declared column with a value, the value stripped."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), filled(F.col(f"`{c}`")).alias("value")) for c in columns])
    return (
        panel.select(*keys, F.explode(pairs).alias("p"))
        .select(*keys, "p.column", "p.value")
        .filter(F.col("value").isNotNull())
    )


def property_values(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Per (tag, column) the sorted distinct values its rows declare."""
    return (
        long_properties(panel, columns, ["tag"])
        .groupBy("tag", "column")
        .agg(F.array_sort(F.collect_set("value")).alias("declared"))
    )


def consistent_properties(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(tag, column, value) where all rows of the tag agree."""
    return (
        property_values(panel, columns)
        .filter(F.size("declared") == 1)
        .select("tag", "column", F.element_at("declared", 1).alias("value"))
    )


def property_conflicts(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(tag, column, declared) where the rows of a tag disagree."""
    return property_values(panel, columns).filter(F.size("declared") > 1)


def reference_tags(panel: DataFrame, role_column: str, values: list[str]) -> DataFrame:
    """Tags whose agreed role is one of `values`. A role column the panel lacks is fatal."""
    if role_column not in property_columns(panel):
        raise ValueError(f"role column {role_column!r} is not a panel column")
    wanted = [v.strip() for v in values if v.strip()]
    return consistent_properties(panel, [role_column]).filter(F.col("value").isin(wanted)).select("tag")


def default_grouping(panel: DataFrame, refs: DataFrame) -> DataFrame:
    """(tag, sample, identity): each tag is its own identity; reference tags are left out."""
    return panel.join(refs, "tag", "left_anti").select("tag", "sample", F.col("tag").alias("identity"))


def grouping_columns(rule: dict, declared: list[str]) -> list[str]:
    """The columns a property rule names; the older single `column` is accepted."""
    raw = rule.get("columns")
    if raw is None:
        raw = [rule["column"]] if rule.get("column") else []
    if not isinstance(raw, list) or not all(isinstance(c, str) for c in raw):
        raise ValueError(f"grouping columns must be a list of strings; got {raw!r}")
    named = [c for c in raw if c]
    missing = [c for c in named if c not in declared]
    if not named or missing:
        raise ValueError(f"grouping names {missing or 'no column'}; the panel declares {declared}")
    return named


def property_grouping(panel: DataFrame, columns: list[str], refs: DataFrame) -> DataFrame:
    """(tag, sample, identity, grouped): the stripped values joined, read per panel row.

    A row lacking any of the values keeps its tag as identity and `grouped` is false.
    """
    values = [trim_all(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in columns]
    whole = values[0] != ""
    for v in values[1:]:
        whole = whole & (v != "")
    return panel.join(refs, "tag", "left_anti").select(
        "tag",
        "sample",
        F.when(whole, F.concat_ws(t.GROUPING_SEPARATOR, *values)).otherwise(F.col("tag")).alias("identity"),
        whole.alias("grouped"),
    )


def make_grouping(panel: DataFrame, rule: dict | None, refs: DataFrame) -> tuple[DataFrame, str]:
    """The grouping a rule asks for, and the rule's id."""
    if rule is None or rule.get("by") == "tag":
        return default_grouping(panel, refs), "per-tag"
    if rule.get("by") != "property":
        raise ValueError(f"grouping must be by tag or by property; got {rule!r}")
    columns = grouping_columns(rule, property_columns(panel))
    grouped = property_grouping(panel, columns, refs).select("tag", "sample", "identity")
    return grouped, "property:" + "|".join(columns)


def ungrouped_tags(grouping: DataFrame) -> DataFrame:
    """Tags that stand as their own identity under a property grouping."""
    return grouping.filter(~F.col("grouped")).select("tag").distinct()


def separator_values(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Grouping values that contain the separator, so that two combinations may share one key."""
    mark = t.GROUPING_SEPARATOR.strip()
    return long_properties(panel, columns, ["tag"]).filter(F.col("value").contains(mark)).select("value").distinct()


def identity_universe(grouping: DataFrame) -> DataFrame:
    """Every identity the run asks at."""
    return grouping.select("identity").distinct()


def seen_pairs(counts: DataFrame) -> DataFrame:
    """(sampleId, tag) pairs the raw reads carry."""
    return counts.select("sampleId", "tag").distinct()


def offered(grouping: DataFrame, seen: DataFrame) -> DataFrame:
    """(sampleId, identity) declared for the sample, or for every sample, and seen in its reads."""
    own = seen.join(grouping.withColumnRenamed("sample", "sampleId"), ["sampleId", "tag"])
    every = seen.join(grouping.filter(F.col("sample") == t.ANY_SAMPLE).drop("sample"), "tag")
    return own.select("sampleId", "identity").unionByName(every.select("sampleId", "identity")).distinct()


def offered_table(pairs: DataFrame) -> DataFrame:
    return pairs.select("sampleId", "identity", F.lit("true").alias("offered"))


def translate_sample_labels(panel: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The panel's sample labels as sample ids. `labels` maps sample id to label; an unknown label is kept."""
    by_label: dict[str, str] = {}
    for sample, label in sorted(labels.items()):
        if label in by_label:
            raise ValueError(f"label {label!r} names both {by_label[label]!r} and {sample!r}")
        by_label[label] = sample
    if not by_label:
        return panel
    return panel.replace(by_label, subset=["sample"])


def expand_samples(panel: DataFrame, samples: DataFrame) -> DataFrame:
    """(sampleId, tag) declared by the panel, a declaration over every sample repeated for the roster's samples."""
    slot = F.pmod(F.xxhash64("sampleId"), F.lit(joins.SALTS)).cast("int")
    roster = samples.select("sampleId").filter("sampleId is not null").distinct().withColumn("_slot", slot)
    keyed = panel.filter(F.col("sample") != t.ANY_SAMPLE).select(F.col("sample").alias("sampleId"), "tag")
    every = panel.filter(F.col("sample") == t.ANY_SAMPLE).select("tag").distinct()
    every = every.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(joins.SALTS - 1))))
    return keyed.unionByName(roster.join(every, "_slot").select("sampleId", "tag")).distinct()


def panels_of_samples(declared: DataFrame, samples: DataFrame) -> DataFrame:
    """(sampleId, panelId, barcodes): the id is derived from the sorted tags, so equal panels share it.

    A sample that declares nothing has the panel of no tags.
    """
    tags = declared.groupBy("sampleId").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return samples.join(tags, "sampleId", "left").select(
        "sampleId",
        F.substring(F.sha2(F.concat_ws("\t", F.coalesce("tags", F.array().cast("array<string>"))), 256), 1, 12).alias("panelId"),
        F.coalesce(F.size("tags"), F.lit(0)).alias("barcodes"),
    )


def panel_labels(sample_panels: DataFrame) -> DataFrame:
    """(panelId, label): numbered in the order of the ids, with how many barcodes and samples each holds."""
    sizes = sample_panels.groupBy("panelId").agg(F.max("barcodes").alias("b"), F.count(F.lit(1)).alias("s"))
    n = F.row_number().over(Window.orderBy("panelId"))
    return sizes.select(
        "panelId",
        F.concat(
            F.lit("P-"), n.cast("string"), F.lit(" ("), counted(F.col("b"), "barcode"), F.lit(", "),
            counted(F.col("s"), "sample"), F.lit(")"),
        ).alias("label"),
    )


def sample_panel(sample_panels: DataFrame) -> DataFrame:
    """(sampleId, panelLabel)."""
    labels = panel_labels(sample_panels).withColumnRenamed("label", "panelLabel")
    return sample_panels.join(labels, "panelId").select("sampleId", "panelLabel")


def tag_identity(grouping: DataFrame) -> DataFrame:
    """(tag, identity, 1): which identities each tag feeds in any sample."""
    return grouping.select("tag", "identity").distinct().withColumn("1", F.lit(1).cast("bigint"))


def tag_order(panel: DataFrame, ordinal: str = "_row") -> DataFrame:
    """Tags with the position of their first panel row."""
    return panel.groupBy("tag").agg(F.min(ordinal).alias("position"))


def _unique(named: DataFrame, key: str) -> DataFrame:
    repeats = F.count(F.lit(1)).over(Window.partitionBy("name"))
    return named.select(
        key, F.when(repeats > 1, F.concat("name", F.lit(" ("), key, F.lit(")"))).otherwise(F.col("name")).alias("label")
    )


def _declared_names(panel: DataFrame, column: str) -> DataFrame:
    """(tag, agreed, joined): the agreed value of a column, or the disagreeing values joined."""
    declared = property_values(panel, [column])
    return declared.select(
        "tag",
        F.when(F.size("declared") == 1, F.element_at("declared", 1)).alias("agreed"),
        F.when(F.size("declared") > 1, F.concat_ws(" / ", "declared")).alias("joined"),
    )


def tag_labels(tags: DataFrame, panel: DataFrame, feature_column: str) -> DataFrame:
    """(tag, label): agreed name, else the conflicting names joined, else the tag; a repeated name takes the tag."""
    named = tags.select("tag").distinct().join(_declared_names(panel, feature_column), "tag", "left")
    return _unique(named.select("tag", F.coalesce("agreed", "joined", "tag").alias("name")), "tag")


def identity_labels(
    grouping: DataFrame, panel: DataFrame, refs: DataFrame, rule_id: str, feature_column: str, columns: list[str] = ()
) -> DataFrame:
    """(identity, label) over the universe and the reference tags.

    Per tag the identity takes the tag's name. Under a property rule it is labelled by its value; an identity
    that is a tag left over from a disagreement in the labelling column takes the disagreeing values joined.
    """
    universe = identity_universe(grouping)
    if rule_id == "per-tag":
        named = tag_labels(universe.select(F.col("identity").alias("tag")), panel, feature_column)
        labels = named.select(F.col("tag").alias("identity"), "label")
    else:
        column = columns[0] if len(columns) == 1 else feature_column
        joined = _declared_names(panel, column).filter("joined is not null").select(F.col("tag").alias("identity"), "joined")
        named = universe.join(joined, "identity", "left").select("identity", F.coalesce("joined", "identity").alias("name"))
        labels = _unique(named, "identity")
    held_out = refs.select(F.col("tag").alias("identity"), F.lit(t.REFERENCE_LABEL).alias("label"))
    return labels.unionByName(held_out)


def identity_name_conflicts(grouping: DataFrame, panel: DataFrame, column: str) -> DataFrame:
    """Identities labelled with several names, and the names."""
    names = property_conflicts(panel, [column]).select(F.col("tag").alias("identity"), "declared")
    return identity_universe(grouping).join(names, "identity")


def identity_properties(
    grouping: DataFrame, panel: DataFrame, columns: list[str], grouped_on: list[str] = ()
) -> DataFrame:
    """(identity, column, value): what holds of an identity.

    The columns grouped on are taken from the rows that formed the identity. Any other column holds where all
    member tags that declare it agree; a member whose own rows disagree blocks it, a silent member does not.
    """
    exportable = [c for c in columns if c != "identity"]
    members = grouping.select("tag", "identity").distinct()
    values = property_values(panel, exportable)
    settled = (
        members.join(values, "tag")
        .groupBy("identity", "column")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("declared"))).alias("all"),
            F.max(F.size("declared")).alias("most"),
        )
        .filter((F.size("all") == 1) & (F.col("most") == 1))
        .select("identity", "column", F.element_at("all", 1).alias("value"))
    )
    if not grouped_on:
        return settled
    formed = grouping.filter(F.col("grouped")).select("tag", "sample", "identity")
    rows = long_properties(panel, [c for c in grouped_on if c != "identity"], ["tag", "sample"])
    declared = formed.join(rows, ["tag", "sample"]).groupBy("identity", "column").agg(F.max("value").alias("value"))
    return declared.unionByName(settled.join(declared, ["identity", "column"], "left_anti"))


def identity_property_table(grouping: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """Wide form: a column per property any identity holds, blank where one does not hold it."""
    emitted = {r[0] for r in held.select("column").distinct().collect()}
    kept = [c for c in columns if c in emitted]
    universe = identity_universe(grouping)
    if not kept:
        return universe
    wide = held.groupBy("identity").pivot("column", kept).agg(F.first("value"))
    return universe.join(wide, "identity", "left").fillna("", kept)


def identity_property_values(held: DataFrame) -> DataFrame:
    """(column, value) distinct."""
    return held.select("column", "value").distinct()


def feature_properties(panel: DataFrame, feature_column: str, columns: list[str], ordinal: str = "_row") -> DataFrame:
    """(feature, column, value): per feature name the first value in file order; later rows do not change it."""
    rows = panel.withColumn("feature", filled(F.col(f"`{feature_column}`"))).filter("feature is not null")
    long = long_properties(rows, columns, ["feature", ordinal])
    return long.groupBy("feature", "column").agg(F.min_by("value", ordinal).alias("value"))


def feature_property_conflicts(
    panel: DataFrame, feature_column: str, columns: list[str], ordinal: str = "_row"
) -> DataFrame:
    """(feature, column, kept, other): later values that disagree with the first."""
    rows = panel.withColumn("feature", filled(F.col(f"`{feature_column}`"))).filter("feature is not null")
    long = long_properties(rows, columns, ["feature", ordinal])
    first = feature_properties(panel, feature_column, columns, ordinal).withColumnRenamed("value", "kept")
    return (
        long.join(first, ["feature", "column"])
        .filter(F.col("value") != F.col("kept"))
        .select("feature", "column", "kept", F.col("value").alias("other"))
        .distinct()
    )


def feature_property_table(panel: DataFrame, feature_column: str, columns: list[str], ordinal: str = "_row") -> DataFrame:
    """Wide form of `feature_properties`, one row per feature name, blank where nothing is declared."""
    names = panel.select(filled(F.col(f"`{feature_column}`")).alias("feature")).filter("feature is not null").distinct()
    if not columns:
        return names
    wide = feature_properties(panel, feature_column, columns, ordinal).groupBy("feature").pivot("column", columns).agg(F.first("value"))
    return names.join(wide, "feature", "left").fillna("", columns)


def negative_controls(names: DataFrame, column: str = "feature", ordinal: str = "_row") -> DataFrame:
    """(feature, value, position): each name once, in the order given."""
    return (
        names.select(filled(column).alias("feature"), ordinal)
        .filter("feature is not null")
        .groupBy("feature")
        .agg(F.min(ordinal).alias("position"))
        .withColumn("value", F.lit("true"))
    )


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): the distinct stripped non-blank values of each column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), filled(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns])
    return rows.select(F.explode(cells).alias("p")).select("p.column", "p.value").filter("value is not null").distinct()


def profile_row_count(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(rowCount): rows holding anything at all."""
    anything = F.coalesce(*[filled(F.col(f"`{c}`").cast("string")) for c in columns]).isNotNull()
    return rows.agg(F.count_if(anything).alias("rowCount"))


def panel_for_sample(panel: DataFrame, sample: str) -> DataFrame:
    return panel.filter(F.col("sample") == sample)


def panel_barcodes(rows: DataFrame, column: str = "tag") -> DataFrame:
    """Distinct stripped barcodes; a panel without one is fatal."""
    found = rows.select(filled(F.col(f"`{column}`")).alias("tag")).filter("tag is not null").distinct()
    if found.isEmpty():
        raise ValueError(f"no feature barcodes found in column {column!r}")
    return found




def hamming(a, b):
    """Positions at which two codes differ, over the shorter of the two."""
    n = F.least(F.length(a), F.length(b))
    return F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))


def min_pairwise_hamming(barcodes: DataFrame) -> DataFrame:
    """(minDistance): the smallest distance between two barcodes of the panel; null for fewer than two.

    Codes are compared over the shorter one's length. Two that differ in at most d places agree in one of d + 1 segments,
    so pairs are proposed by equality on a segment and counted out; d grows until a pair within d is there. Many codes
    lie close together, so the search ends while segments are long. The same plan serves a panel of any size.
    """
    codes = barcodes.select("tag").distinct()
    # longer codes are cut to each length that occurs, and one of a pair has that length
    lengths = sorted(r[0] for r in codes.select(F.length("tag")).filter("length(tag) is not null").distinct().collect())
    cuts = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("tag"))
    cut = codes.select("tag", F.explode(cuts).alias("n")).select("n", F.expr("substring(tag, 1, n)").alias("code"), (F.length("tag") == F.col("n")).alias("whole"))
    cut = stage(cut.groupBy("n", "code").agg(F.count(F.lit(1)).alias("codes"), F.max("whole").alias("whole")), "codes")
    found = 0 if not cut.filter("codes > 1 and whole").isEmpty() else None
    for most in range(1, (lengths or [0])[-1] + 1):
        if found is not None:
            break
        segments = cut.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(most))))
        start, end = F.expr(f"at * n div {most + 1}").cast("int"), F.expr(f"(at + 1) * n div {most + 1}").cast("int")
        segments = segments.select("n", "at", F.substring("code", start + 1, end - start).alias("segment"), "code", "whole")
        other = segments.withColumnsRenamed({"code": "code2", "whole": "whole2"})
        pairs = segments.join(other, ["n", "at", "segment"]).filter("code < code2 and (whole or whole2)")
        found = pairs.select(hamming(F.col("code"), F.col("code2")).alias("d")).filter(F.col("d") <= most).agg(F.min("d")).first()[0]
    return codes.sparkSession.range(1).select(F.lit(found).cast("int").alias("minDistance"))
