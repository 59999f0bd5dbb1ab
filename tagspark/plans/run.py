"""One run: counts, panel and linker in, every result table out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import joins
from ..functions import terms as t
from ..operators import cells as C
from ..operators import checks as D
from ..operators import keys as K
from ..operators import mixture as M
from ..operators import panels as P
from ..operators import quality as Q
from ..operators import sets as S
from ..operators import states as X
from ..sources.panel import Panel
from ..sources.sinks import stage

# fixed values: the result tables and their key columns
RESULT_KEYS = {
    "verdicts": ["setId", "identity"],
    "setCounts": ["setId"],
    "setTagMedian": ["setId"],
    "identitySummary": ["setId"],
    "identityPunch": ["setId"],
    "setPatterns": ["setId"],
    "neverOffered": ["pattern", "identity"],
    "cellPunch": ["setId", "sampleId", "cellId"],
    "cellCardRows": ["sampleId", "cellId", "identity"],
    "cellCardCells": ["setId", "sampleId", "cellId"],
    "cellCardAsked": ["sampleId", "identity"],
    "setTagMedianLong": ["setId", "tag"],
    "cellCounts": ["sampleId", "cellId", "tag"],
    "cellRawCounts": ["sampleId", "cellId", "tag"],
    "cellTagPivot": ["sampleId", "cellId"],
    "cellScalars": ["sampleId", "cellId"],
    "cellBackground": ["sampleId", "cellId"],
    "cellScore": ["sampleId", "cellId", "identity"],
    "cellInList": ["sampleId", "cellId"],
    "offered": ["sampleId", "identity"],
    "tagIdentity": ["tag", "identity"],
    "identityLabels": ["identity"],
    "tagLabels": ["tag"],
    "identityProperties": ["identity"],
    "panelLabels": ["panelId"],
    "samplePanel": ["sampleId"],
    "undeclaredBarcodes": ["sampleId", "tag"],
    "qcSummary": ["sampleId"],
    "qcBackgrounds": ["sampleId", "tag"],
    "reagents": ["panelId", "identity", "tag"],
    "runMeta": [],
    "qcBySample": ["sampleId"],
    "qcTagBins": ["sampleId", "tag", "bin"],
    "qcTagFits": ["sampleId", "tag"],
    "qcUnfitted": ["sampleId", "tag"],
    "qcSpreads": ["spread", "bin"],
    "identityNameConflicts": ["identity"],
    "identityPropertyValues": ["column", "value"],
    "pivotColumns": ["table", "tag"],
}

# columns that hold several sample ids in one value; other tables have them in `sampleId`
SAMPLE_LISTS = {"reagents": ["samplesSeenInNames", "samplesInPanelNames"], "runMeta": ["samples"]}

NO_BASELINE = "no pair of sample and tag could be fitted with the {} cells that a fit needs, so no verdicts were read"

# result tables with a column per identity or tag; each has a long form that is saved as well
WIDE_TABLES = ("setTagMedian", "identitySummary", "identityPunch", "cellPunch", "cellTagPivot")
# those that a run makes unasked; cellPunch has a value for every member cell and identity
WIDE_DEFAULT = tuple(w for w in WIDE_TABLES if w != "cellPunch")


@dataclass(frozen=True)
class Settings:
    """`wide` names the tables that get a column per identity or tag: one that is too wide to build is an error, and
    leaving its name out leaves its long form. `cellPunch` is made only if it is named. `undeclared_kept` sequences of a
    sample are listed, all with None."""

    source: str
    floor: int = t.FLOOR
    cutoff: float = t.CUTOFF
    gate: int | None = None
    min_voters: int = t.MIN_VOTERS
    min_agreement: float | None = None
    bound_probability: float = t.BOUND_PROBABILITY
    panel_min_members: int = t.PANEL_MIN_MEMBERS
    min_cells: int = t.FIT_MIN_CELLS
    initial_signal_weight: float | None = None
    feature_column: str = "feature"
    role_column: str = ""
    reference_values: tuple = ()
    grouping: dict | None = None
    contending: tuple = ()
    sample_labels: dict = field(default_factory=dict)
    lines: dict = field(default_factory=dict)
    wide: tuple = WIDE_DEFAULT
    undeclared_kept: int | None = t.UNDECLARED_KEPT


class VerdictRun:
    """A run over one set of inputs. Frames are lazy; the states, which most tables read, are written once.

    The panel, its identities and the samples are metadata of a known size: their names are read to the driver to
    lay out columns. Nothing that grows with the cells is.
    """

    def __init__(
        self,
        counts: DataFrame,
        panel: Panel,
        settings: Settings,
        linker: DataFrame | None = None,
        cell_list: DataFrame | None = None,
        read_qc: DataFrame | None = None,
        raw_counts: DataFrame | None = None,
    ):
        s = settings
        X.check_settings(
            s.floor, s.cutoff, s.bound_probability, s.min_voters, s.min_agreement, s.initial_signal_weight, s.min_cells, s.contending
        )
        self.spark = counts.sparkSession
        self.counts, self.settings, self.read_qc, self.raw_counts = counts, s, read_qc, raw_counts
        self._small_panel, self._panel_rows = panel.small, panel.frame
        self.dropped_lines = panel.dropped_lines
        self.panel = P.translate_sample_labels(panel.frame, s.sample_labels)
        chosen, self.cell_list_source = C.choose_cell_list(linker, cell_list)
        self.cell_list = None if chosen is None else stage(chosen, "cell-list")
        self.linker = linker
        if s.role_column and s.reference_values:
            self.refs = P.reference_tags(self.panel, s.role_column, list(s.reference_values))
        else:
            if s.role_column and s.role_column not in P.property_columns(self.panel):
                raise ValueError(f"role column {s.role_column!r} is not a panel column")
            self.refs = self.panel.select("tag").filter(F.lit(False))
        # panel metadata that every branch reads: written once
        self.refs = stage(self.refs, "references")
        self.has_refs = not self.refs.isEmpty()
        size = self.panel.select(F.count_distinct("tag")).first()[0]
        X.served_source(s.source, self.has_refs, size, s.panel_min_members)
        if linker is not None and D.share_no_sample(counts, linker) and not counts.isEmpty() and not linker.isEmpty():
            raise ValueError("the linker names none of the samples that were counted: every set would be empty")
        grouping, self.rule_id = P.make_grouping(self.panel, s.grouping, self.refs)
        self.grouping = stage(grouping, "grouping")
        by_property = s.grouping is not None and s.grouping.get("by") == "property"
        self.grouping_columns = P.grouping_columns(s.grouping, P.property_columns(self.panel)) if by_property else []
        self.tag_grouping = stage(P.default_grouping(self.panel, self.refs), "tags")
        self.identities = P.identity_universe(self.grouping)
        # named only where they may become columns; a larger universe stays a frame
        self.wide = joins.fits(self.identities, t.IDENTITY_PIVOT_LIMIT)
        self.universe = sorted(r[0] for r in self.identities.collect()) if self.wide else []

    @cached_property
    def small(self) -> bool | None:
        """True where even the panel's rows for every sample stay within what may be broadcast; else joins measure."""
        if not self._small_panel:
            return self._small_panel
        rows = self._panel_rows.count() * max(1, self.seen.select("sampleId").distinct().count())
        return True if rows <= joins.BROADCAST_ROWS else None

    # --- cells -----------------------------------------------------------------
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
    def analysed(self) -> DataFrame:
        return C.analysed_cells(self.counts, self.linker, self.cell_list)

    @cached_property
    def roster(self) -> DataFrame:
        named = self.panel.filter(F.col("sample") != t.ANY_SAMPLE).select(F.col("sample").alias("sampleId"))
        out = self.seen.select("sampleId").unionByName(named)
        for more in (self.linker, self.cell_list):
            if more is not None:
                out = out.unionByName(more.select("sampleId"))
        return stage(out.distinct(), "roster")

    @cached_property
    def reference(self) -> DataFrame | None:
        """The reading every analysed cell is compared with or gated by; None where the run has none."""
        if self.settings.source == "panel":
            return stage(X.reference_panel_median(self.counts, self.analysed), "reference")
        if self.has_refs:
            return stage(X.reference_declared(self.counts, self.refs, self.analysed, self.small), "reference")
        return None

    @cached_property
    def floored(self) -> DataFrame:
        return X.apply_floor(self.counts, self.settings.floor, self.refs, self.small)

    @cached_property
    def gated(self) -> DataFrame:
        if self.reference is None:
            return self.analysed.filter(F.lit(False))
        return X.gate_cells(self.reference, self.settings.gate)

    # --- the fitted background ---------------------------------------------------
    @property
    def fitted(self) -> bool:
        return self.settings.source == "distribution"

    @cached_property
    def fit_universe(self) -> DataFrame:
        return self.cell_list if self.cell_list is not None else self.analysed

    @cached_property
    def histogram(self) -> DataFrame:
        pairs = M.declared_pairs(self.panel, self.fit_universe.select("sampleId").distinct())
        return stage(M.count_histogram(self.counts, self.fit_universe, pairs, self.small), "histogram")

    @cached_property
    def fits(self) -> DataFrame:
        s = self.settings
        return stage(M.fit_two_component_nb(self.histogram, s.min_cells, s.initial_signal_weight), "fits")

    @cached_property
    def curve(self) -> DataFrame:
        return stage(M.score_curve(self.fits, self.histogram, self.settings.floor, self.refs, self.small), "curve")

    @cached_property
    def established(self) -> bool:
        return not self.fitted or not M.comparable_identities(self.fits, self.grouping).isEmpty()

    def _states(self, grouping: DataFrame) -> DataFrame:
        s = self.settings
        if not self.fitted:
            return X.states_from_counts(self.counts, grouping, self.refs, s.source, s.floor, s.cutoff, s.gate, self.small)
        own = joins.lookup(self.floored, self.refs, ["tag"], "left_anti", self.small)
        found = M.identity_probabilities(self.counts, self.fit_universe, self.curve, grouping, s.floor, self.refs, self.small)
        return X.read_states_probability(X.combine_tags(own, grouping, self.small), found, self.gated, s.bound_probability, self.counts.count())

    @cached_property
    def states(self) -> DataFrame:
        return stage(self._states(self.grouping), "states")

    @cached_property
    def tag_states(self) -> DataFrame:
        return self.states if self.rule_id == "per-tag" else stage(self._states(self.tag_grouping), "tag-states")

    # --- sets --------------------------------------------------------------------
    @cached_property
    def members(self) -> DataFrame:
        """Set members with their admissibility."""
        empty = self.analysed.select(*t.CELL, F.lit("").alias("setId")).filter(F.lit(False))
        plain = S.cells_by_set(self.linker) if self.linker is not None else empty
        return stage(S.with_admissibility(plain, self.gated, self.fit_universe if self.fitted else None), "members")

    def _asked(self, offered: DataFrame, grouping: DataFrame) -> DataFrame:
        if not self.fitted:
            return offered
        fitted = M.comparable_identities(self.fits, grouping).withColumn("comparable", F.lit(True))
        return offered.join(fitted, ["sampleId", "identity"], "left").withColumn("comparable", F.coalesce("comparable", F.lit(False)))

    @cached_property
    def offered_verdicts(self) -> DataFrame:
        """The verdicts of offered positions, which are those that are written."""
        s = self.settings
        plain = S.combine_offered(self.states, self.members, self._asked(self.offered, self.grouping), s.min_voters, s.min_agreement, self.small)
        return stage(S.competitor_notes(plain, list(s.contending)), "verdicts")

    @cached_property
    def patterns(self) -> tuple[DataFrame, DataFrame]:
        """(setId, pattern), and the identities that the sets of a pattern were never offered."""
        return S.offer_patterns(self.members, self.offered, self.universe if self.wide else self.identities, self.small)

    @property
    def verdicts(self) -> DataFrame:
        """A verdict for every set and identity, *never asked* included: a view of what is written."""
        return S.whole_verdicts(self.offered_verdicts, *self.patterns)

    @cached_property
    def cell_card(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return S.cell_card(self.states, self.members, self._asked(self.offered, self.grouping), self.small)

    @property
    def cell_punch_long(self) -> DataFrame:
        return S.read_card(*self.cell_card, self.small)

    # --- quality -------------------------------------------------------------------
    @cached_property
    def declared(self) -> DataFrame:
        return stage(P.expand_samples(self.panel, self.roster), "declared")

    @cached_property
    def sample_panels(self) -> DataFrame:
        return P.panels_of_samples(self.declared, self.roster)

    @cached_property
    def marked_raw(self) -> DataFrame | None:
        return None if self.raw_counts is None else Q.undeclared_sequences(self.raw_counts, self.declared)

    @cached_property
    def tally(self) -> DataFrame | None:
        return None if self.marked_raw is None else stage(Q.undeclared_tally(self.marked_raw, self.settings.undeclared_kept), "tally")

    @cached_property
    def scored(self) -> DataFrame:
        rows = self.states if self.settings.source == "declared" else self.states.filter(F.lit(False))
        return C.listed(rows.filter("unreliableReason is null"), self.cell_list)

    @cached_property
    def report(self) -> DataFrame:
        s = self.settings
        readings = Q.sample_measures(
            self.roster, self.counts, s.floor, X.floor_stats(self.counts, s.floor, self.refs, self.small), self.cell_list,
            self.read_qc, self.tally, self.reference if self.has_refs else None, s.gate, X.score_by_sample(self.scored, s.cutoff),
        )
        return stage(Q.sample_report(readings, self.roster, self.lines, self.has_refs), "report")

    @cached_property
    def lines(self) -> DataFrame:
        return Q.lines_table(self.spark, self.settings.lines)

    @cached_property
    def reagents(self) -> DataFrame:
        scope = stage(Q.reagent_scope(self.declared, self.grouping, self.sample_panels), "scope")
        own_states = C.listed(self.tag_states, self.cell_list)
        measures = Q.per_antigen_measures(C.listed(self.counts, self.cell_list), own_states, scope, self.refs, self.small)
        siblings = Q.sibling_disagreement(own_states, scope, self.small)
        offered = self._asked(self.offered_tags.withColumnRenamed("tag", "identity"), self.tag_grouping)
        own = S.self_disagreement(
            self.tag_states, self.members, offered.withColumnRenamed("identity", "tag"), scope.select("scopeId", "tag").distinct(), scope, self.small
        )
        parts = F.split("scopeId", "\u0001", 2)
        rates = own.select(parts[0].alias("panelId"), "tag", parts[1].alias("identity"), F.col("disagreementRate").alias("selfDisagreement"))
        return Q.reagents(measures, siblings, rates, self.settings.sample_labels)

    @cached_property
    def tag_bins(self) -> DataFrame:
        if self.fitted:
            return Q.hist_bins(self.histogram)
        return Q.count_bins(C.listed(self.counts, self.cell_list))

    @cached_property
    def tag_fits(self) -> DataFrame:
        """What is drawn over the bins of each fitted pair: both means, the background's weight, and the count from which it is bound."""
        crossings = M.bound_at_count(self.curve, self.settings.bound_probability)
        return M.backgrounds(self.fits).join(crossings, ["sampleId", "tag"], "left")

    @cached_property
    def spreads(self) -> DataFrame:
        """(spread, bin, low, high, weight): scores and reference readings of the listed cells, over all samples."""
        scores = stage(C.cell_score(self.states, self.cell_list, self.settings.source), "scores")
        out = Q.score_spread(scores).select(F.lit("score").alias("spread"), "*")
        if self.reference is None:
            return out
        readings = Q.reference_spread(C.listed(self.reference, self.cell_list))
        return out.unionByName(readings.select(F.lit("referenceReading").alias("spread"), "*"))

    @cached_property
    def grouped(self) -> DataFrame:
        """The grouping, under a property rule with `grouped`: whether a panel row has all values the rule asks for."""
        return P.property_grouping(self.panel, self.grouping_columns, self.refs) if self.grouping_columns else self.grouping

    @cached_property
    def punched(self) -> bool:
        """Whether the table with a column per identity and a row per member cell is made."""
        return "cellPunch" in self.settings.wide and bool(self.universe) and not self.members.isEmpty()

    def run_record(self) -> DataFrame:
        """One row: the settings in force and what the run counted."""
        s = self.settings
        floors = X.floor_stats(self.counts, s.floor, self.refs, self.small)
        facts = {
            "cellsAnalysed": self.analysed.agg(F.count(F.lit(1))),
            "readingsFloored": floors.agg(F.coalesce(F.sum("readingsFloored"), F.lit(0))),
            "cellsEmptied": floors.agg(F.coalesce(F.sum("cellsEmptied"), F.lit(0))),
            "cellsSetAside": self.gated.agg(F.count(F.lit(1))),
            "setCount": self.members.agg(F.count_distinct("setId")),
            "identityCount": self.identities.agg(F.count(F.lit(1))),
            "samplePanelCount": self.sample_panels.agg(F.count_distinct("panelId")),
            "samples": self.roster.agg(F.array_join(F.array_sort(F.collect_list("sampleId")), ", ")),
            "referenceTags": self.refs.agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ")),
        }
        if self.grouping_columns:
            facts["tagsWithoutGroupingValue"] = P.ungrouped_tags(self.grouped).agg(F.array_join(F.array_sort(F.collect_list("tag")), ", "))
        if self.punched and self.established:
            facts["cellPunchCells"] = self.members.agg(F.count_distinct("setId", *t.CELL))
        if self.fitted:
            facts["pairsUnfitted"] = M.unfitted(self.fits).agg(F.count(F.lit(1)))
        if self.cell_list is not None:
            facts["cellsInList"] = self.cell_list.agg(F.count(F.lit(1)))
        if self.tally is not None:
            facts["undeclaredBarcodesElided"] = self.tally.agg(F.coalesce(F.sum("elided"), F.lit(0)))
        if self.reference is not None:
            facts["cellsHighReference"] = X.cells_high(self.reference, s.gate)
        fixed = {
            "referenceChoice": s.source, "baselineEstablished": self.established, "cellListSource": self.cell_list_source,
            "floor": s.floor, "cutoff": s.cutoff, "boundProbability": s.bound_probability, "minVoters": s.min_voters,
            "minAgreement": s.min_agreement, "gateThreshold": s.gate, "panelMinMembers": s.panel_min_members,
            "distributionMinCells": s.min_cells, "initialSignalWeight": s.initial_signal_weight, "roleColumn": s.role_column,
            "groupingId": self.rule_id, "identities": ", ".join(self.universe) if self.wide else None,
            "contending": "; ".join(", ".join(sorted(g)) for g in s.contending),
            "panelLinesDropped": ", ".join(map(str, self.dropped_lines)),
            "identitySummaryLimit": t.IDENTITY_PIVOT_LIMIT, "cellPunchLimit": t.CELL_PUNCH_LIMIT,
            "undeclaredBarcodeLimit": s.undeclared_kept,
            "identitySummaryEmitted": self.wide, "cellPunchEmitted": self.punched, "referenceSourceRequested": s.source,
            "noBaselineReason": "" if self.established else NO_BASELINE.format(s.min_cells),
            "referenceValues": ", ".join(sorted(s.reference_values)), "grouping": json.dumps(s.grouping or {"by": "tag"}, sort_keys=True),
        }
        one = self.spark.range(1)
        return one.select(*[F.lit(v).alias(k) for k, v in fixed.items()], *[df.scalar().alias(k) for k, df in facts.items()])

    def tables(self) -> dict[str, DataFrame]:
        """Every result table by name. Without a baseline the tables of answers keep their headers and hold no rows."""
        s = self.settings

        def answers(df: DataFrame) -> DataFrame:
            return M.answers(df, self.established)

        def names(table: str, df: DataFrame, limit: int) -> list[str]:
            """Tags that become columns of a wide table; too many of them for one are an error, never fewer rows."""
            if table not in s.wide:
                return []
            distinct = df.select("tag").distinct()
            if not joins.fits(distinct, limit):
                raise ValueError(f"{table} would have over {limit} columns: leave it out of the wide tables, its long form has every row")
            return sorted(r[0] for r in distinct.collect())

        tags = names("cellTagPivot", self.panel, t.IDENTITY_PIVOT_LIMIT)
        asked_tags = names("setTagMedian", self.tag_grouping, t.TAG_MEDIAN_LIMIT)
        by_identity = [w for w in ("identitySummary", "identityPunch", "cellPunch") if w in s.wide]
        if by_identity and not self.wide:
            raise ValueError(f"{', '.join(by_identity)} would have over {t.IDENTITY_PIVOT_LIMIT} columns: leave them out of the wide tables, the long forms have every row")
        reference = self.reference
        keyed = reference is not None and not self.fitted
        cells = reference if reference is not None else self.analysed.select(*t.CELL, F.lit(None).cast("bigint").alias("referenceCount"))
        scalars = answers(C.cell_scalars(X.cell_admissibility(cells, s.gate, keyed), self.cell_list))
        raw = C.cell_raw_counts(self.counts, self.cell_list)
        medians = stage(S.set_tag_median(self.counts, self.members, self.offered_tags, self.small), "medians")
        exported = [c for c in P.property_columns(self.panel) if c != "identity"]
        held = P.identity_properties(self.grouped, self.panel, exported, self.grouping_columns)
        named = self.grouping_columns[0] if len(self.grouping_columns) == 1 else s.feature_column
        labels = P.tag_labels(self.panel, self.panel, s.feature_column)
        pivots = labels.select(F.explode(F.array(F.lit("cellTagPivot"), F.lit("setTagMedian"))).alias("table"), "tag", "label")
        out = {
            "verdicts": answers(self.offered_verdicts),
            "setPatterns": answers(self.patterns[0]),
            "neverOffered": self.patterns[1],
            "setCounts": answers(S.set_counts(self.offered_verdicts, self.patterns[0]).join(S.set_cell_counts(self.members, self.floored), "setId", "left")),
            "setTagMedian": S.set_tag_median_table(medians, asked_tags),
            "setTagMedianLong": medians,
            **{name: answers(df) for name, df in zip(("cellCardRows", "cellCardCells", "cellCardAsked"), self.cell_card)},
            "identitySummary": answers(S.identity_summary(self.offered_verdicts, self.universe, self.patterns[0])),
            "identityPunch": answers(S.identity_punch(self.offered_verdicts, self.universe, self.patterns[0])),
            "cellCounts": C.cell_counts(self.floored, self.refs, cells, self.cell_list),
            "cellRawCounts": raw,
            "cellTagPivot": C.cell_tag_pivot(raw, tags) if tags else raw.select(*t.CELL).distinct(),
            "cellScalars": scalars,
            "cellBackground": C.cell_background(scalars, self.cell_list),
            "cellScore": C.cell_score(self.states, self.cell_list, s.source),
            "cellInList": C.cell_list_table(self.cell_list, self.analysed),
            "offered": P.offered_table(self.offered),
            "tagIdentity": P.tag_identity(self.grouping),
            "identityLabels": P.identity_labels(self.grouping, self.panel, self.refs, self.rule_id, s.feature_column, self.grouping_columns),
            "tagLabels": labels,
            "pivotColumns": pivots.filter(F.col("table").isin([w for w in ("cellTagPivot", "setTagMedian") if w in s.wide])),
            "identityNameConflicts": P.identity_name_conflicts(self.grouping, self.panel, named),
            "identityPropertyValues": P.identity_property_values(held),
            "qcSpreads": self.spreads,
            "identityProperties": P.identity_property_table(self.grouping, held, exported),
            "panelLabels": P.panel_labels(self.sample_panels),
            "samplePanel": P.sample_panel(self.sample_panels),
            "qcSummary": Q.sample_summary(self.report, self.roster, self.read_qc),
            "qcBySample": Q.sample_report_json(self.report),
            "reagents": self.reagents,
            "qcTagBins": self.tag_bins,
            "runMeta": self.run_record(),
        }
        out = {name: df for name, df in out.items() if name not in WIDE_TABLES or name in s.wide}
        if self.punched:
            out["cellPunch"] = answers(S.cell_punch(self.cell_punch_long, self.universe))
        if self.fitted:
            out["qcBackgrounds"] = M.backgrounds(self.fits)
            out["qcTagFits"] = self.tag_fits
            out["qcUnfitted"] = M.unfitted(self.fits)
        if self.tally is not None:
            blank = self.spark.createDataFrame([], "sampleId string, featureDroppedShare double")
            read_qc = self.read_qc if self.read_qc is not None else blank
            out["undeclaredBarcodes"] = Q.undeclared_barcodes(Q.heaviest_undeclared(self.marked_raw, s.undeclared_kept), self.tally, read_qc, self.lines)
        return out

    def translated(self, names: dict[str, str], views: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """The tables with sample ids replaced by `names`, in keys and inside lists; an id without a name is kept.

        `views` are further tables of the run by name, such as `cell_punch_long`, which no run writes.
        """
        mapping = self.spark.createDataFrame(sorted(names.items()), "from string, to string")
        small = True if len(names) <= joins.BROADCAST_ROWS else None
        out = {}
        for name, df in {**self.tables(), **(views or {})}.items():
            if "sampleId" in df.columns:
                df = K.translate_keys(df, "sampleId", mapping, small)
            out[name] = K.translate_joined_lists(df, SAMPLE_LISTS.get(name, []), names)
        return out

    def save(self, folder: str, names: dict[str, str] | None = None) -> list[str]:
        """Write every table as Parquet under `folder`, ordered by its key within files, sample ids replaced by `names`.
        Returns the names written."""
        from ..sources.sinks import write_table

        written = []
        for name, df in (self.translated(names) if names else self.tables()).items():
            keys = RESULT_KEYS[name]
            safe = df.select(*[F.col(f"`{c}`") for c in df.columns])
            write_table(safe, f"{folder.rstrip('/')}/{name}.parquet", keys or [safe.columns[0]])
            written.append(name)
        return written


def saved_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The verdicts of a saved run for every set and identity."""
    read = lambda name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return S.whole_verdicts(read("verdicts"), read("setPatterns"), read("neverOffered"))


def saved_card(spark: SparkSession, folder: str, cells: DataFrame | None = None) -> DataFrame:
    """The card of a saved run's cells, silent positions included; of `cells` (sampleId, cellId) alone where given."""
    rows, own, asked = (spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet") for name in ("cellCardRows", "cellCardCells", "cellCardAsked"))
    if cells is not None:
        own = own.join(cells.select(*t.CELL).distinct(), t.CELL, "left_semi")
    return S.read_card(rows, own, asked)
