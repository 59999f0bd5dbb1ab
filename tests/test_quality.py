import math

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tagspark.functions import bins
from tagspark.functions.text import natural_key, percent_shown
from tagspark.operators import quality as Q


def scalar_status(name, value):
    """The rule for one value, written out."""
    if value is None or math.isnan(value) or math.isinf(value):
        return None
    if name == "cellsDetected":
        return "alert" if value == 0 else "OK"
    for line, warn, alert, warn_reads, alert_reads in Q.LINES:
        if line == name:
            past = {"at-least": lambda v, x: v < x, "at-most": lambda v, x: v > x, "alerting-at": lambda v, x: v == x}
            if alert is not None and past[alert_reads](value, alert):
                return "alert"
            return "warn" if past[warn_reads](value, warn) else "OK"
    return None


def test_status_at_every_boundary(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, 1.0, 3.0, 4.0, 5000.0, 4999.0]
    for _, warn, alert, _, _ in Q.LINES:
        for edge in (warn, alert):
            if edge is not None:
                values += [edge - 1e-6, edge, edge + 1e-6]
    names = [line[0] for line in Q.LINES] + ["cellsDetected", "floorRemoved"]
    df = spark.createDataFrame([(n, v) for n in names for v in values], "measurement string, value double")
    for r in Q.with_status(df, Q.lines_table(spark)).collect():
        assert r.status == scalar_status(r.measurement, r.value), r


def test_roll_up(frame):
    df = frame([("a", 1.0, "OK"), ("a", 2.0, "warn"), ("a", 3.0, None), ("a", None, None), ("b", 1.0, None)], "k string, value double, status string")
    assert rows(Q.roll_up(df, ["k"])) == {("a", "warn", 2, 1, 1), ("b", None, 0, 1, 0)}


def test_aggregate_barcodes(frame):
    data = [("S", f"b{i:03}", 1000 + i, 10) for i in range(99)] + [("S", "big", 90000, 7)] + [("T", f"b{i}", 10, 1) for i in range(5)] + [("T", "big", 900, 1)]
    got = {r.sampleId: r for r in Q.aggregate_barcodes(frame(data, "sampleId string, barcode string, umiCount bigint, readCount bigint")).collect()}
    assert (got["S"].flagged, got["S"].flaggedReads, got["S"].tested) == (1, 7, 100)
    assert got["T"].flagged == 0 and got["T"].threshold == 10.0  # below the floor nothing is flagged


def test_fraction_without_reads_says_why(frame):
    totals = frame([("S", 0)], "sampleId string, readsTotal bigint")
    flagged = frame([], "sampleId string, tested bigint, threshold double, flagged bigint, flaggedReads bigint")
    assert rows(Q.aggregate_barcode_fraction(flagged, totals)) == {("S", None, Q.NO_TOTAL)}
    assert rows(Q.usable_read_fraction(totals, None)) == {("S", None, Q.NO_LIST_USABLE)}


def test_rescued_share(spark):
    data = [(0.3, 0.1), (0.1, 0.1 + 1e-12), (0.1, 0.2), (None, 0.1), (0.1, None)]
    df = spark.createDataFrame(data, "u double, d double").select(Q.rescued_share(F.col("u"), F.col("d")).alias("r"))
    assert [None if r.r is None else round(r.r, 6) for r in df.collect()] == [0.2, 0.0, None, None, None]


def test_percent_shown(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.001, 0.025, 0.5, 0.999, 1.0, None)], "v double").select(percent_shown(F.col("v")).alias("s"))
    assert [r.s for r in df.collect()] == ["0%", "<1%", "3%", "50%", ">99%", "100%", None]


def test_undeclared_tally_is_whole_while_the_list_is_capped(frame):
    raw = frame([("S", f"X{i:02}", 1) for i in range(20)] + [("S", "A", 80), ("S", "X99", 100)], "sampleId string, FEATURE string, totalWeight bigint")
    marked = Q.undeclared_sequences(raw, frame([("S", "A")], "sampleId string, tag string"))
    assert rows(Q.undeclared_tally(marked, 3)) == {("S", 200, 120, 21, 0.6, 18)}
    assert rows(Q.heaviest_undeclared(marked, 3), "tag") == {("X99",), ("X00",), ("X01",)}
    assert Q.heaviest_undeclared(marked, None).count() == 21


def test_log1p_bins_against_the_edges(spark):
    edges = bins.log1p_edges_up_to(5000)
    df = spark.range(5001).select("id", bins.log1p_bin(F.col("id")).alias("b"))
    for r in df.collect():
        assert edges[r.b] <= r.id < edges[r.b + 1]
    assert bins.log1p_edges_up_to(0) == [] and bins.log1p_edges(0) == []


def test_linear_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 23.9, 24)], "score double")
    got = {r.bin: (r.low, r.weight) for r in Q.score_spread(df).collect()}
    assert len(got) == 24 and got[0] == (0.0, 1) and got[23][1] == 2
    same = Q.score_spread(spark.createDataFrame([(7.0,), (7.0,)], "score double"))
    assert {r.weight for r in same.collect() if r.bin == 0} == {2}
    assert Q.score_spread(df.filter("score < 0")).count() == 0


def test_values_from_bins_are_spread_evenly(frame, monkeypatch):
    df = frame([("a", 0.0, 10.0, 5), ("a", 10.0, 20.0, 0)], "k string, low double, high double, weight bigint")
    want = {("a", 1.0), ("a", 3.0), ("a", 5.0), ("a", 7.0), ("a", 9.0)}
    assert rows(Q.values_from_bins(df)) == want
    monkeypatch.setattr(Q, "VALUES_PER_TASK_ROW", 2)
    assert rows(Q.values_from_bins(df)) == want


def test_a_missing_measurement_has_a_reason(spark, frame):
    readings = frame([("S", "cellsDetected", 0.0, None, None), ("S", "readsPerCell", float("nan"), None, None), ("S", "floorRemoved", None, None, "why")],
                     "sampleId string, measurement string, value double, detail string, reason string")
    got = {r.measurement: (r.value, r.reason, r.status) for r in Q.sample_report(readings, frame([("S",)], "sampleId string"), Q.lines_table(spark), False).collect()}
    assert got["cellsDetected"] == (0.0, None, "alert") and got["readsPerCell"] == (None, Q.NOT_FINITE, None)
    assert got["floorRemoved"] == (None, "why", None) and got["matchedFraction"] == (None, Q.UNSUPPLIED, None)
    assert "cellsSetAside" not in got and len(got) == len(Q.SAMPLE_MEASURES) - 2


def test_reads_per_cell_and_usable(frame):
    counts = frame([("S", "a", "A", 1, 10), ("S", "a", "B", 1, 5), ("S", "x", "A", 1, 99)], "sampleId string, cellId string, tag string, umiCount bigint, totalWeight bigint")
    usable = Q.usable_reads(counts, frame([("S", "a"), ("S", "b")], "sampleId string, cellId string"))
    assert rows(usable) == {("S", 15, 2)} and rows(Q.reads_per_cell(usable)) == {("S", 7.5)}


def test_sibling_majority_is_strict_and_excludes_the_tag(frame):
    scope = frame([("S", tag, "P", "X", True) for tag in "ABC"], "sampleId string, tag string, panelId string, identity string, grouped boolean")
    states = frame([("S", "c", "A", "bound"), ("S", "c", "B", "not bound"), ("S", "c", "C", "not bound"), ("S", "d", "A", "bound"), ("S", "d", "B", "not bound"), ("S", "d", "C", "unreliable")],
                   "sampleId string, cellId string, identity string, state string")
    got = {r.tag: (r.judged, r.siblingDisagreement) for r in Q.sibling_disagreement(states, scope).collect()}
    assert got == {"A": (2, 1.0), "B": (1, 1.0), "C": (0, None)}


def test_headings_sort_by_their_numbers():
    assert sorted(["antigen_10", "Antigen_9", "b"], key=natural_key) == ["Antigen_9", "antigen_10", "b"]


@pytest.mark.parametrize("labels", [None, {"S1": "Donor"}])
def test_reagent_names(frame, labels):
    measures = frame([("P", "A", "A", 1, 2, ["S1"], ["S1", "S2"], 3, None, 2.0, True)],
                     "panelId string, tag string, identity string, samplesSeenIn bigint, samplesInPanel bigint, seenNames array<string>, panelNames array<string>, cellsWithCount bigint, cellsAboveTheLine double, medianCountPerCell double, isReference boolean")
    siblings = frame([("P", "A", "A", 0, 0, 0, None)], "panelId string, tag string, identity string, siblings bigint, rowCells bigint, judged bigint, siblingDisagreement double")
    own = frame([], "panelId string, tag string, identity string, selfDisagreement double")
    row = Q.reagents(measures, siblings, own, labels).first()
    assert row.seenIn == "1/2" and row.siblingDisagreementShown == "held out of the read" and row.selfDisagreementShown == "nothing to compare"
    assert row.samplesInPanelNames == ("S1, S2" if labels is None else "Donor, S2")
