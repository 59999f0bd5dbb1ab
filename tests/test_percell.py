import pytest
from helpers import rows

from tagspark.operators import percell as E

STAT = "sampleId string, CELL string, FEATURE string, count bigint, totalWeight bigint, unique_UMI bigint"


@pytest.fixture
def stat(frame):
    data = [("cell1", "t1", 3), ("cell1", "t2", 1), ("cell2", "t1", 1), ("cell2", "t2", 1), ("cell2", "t3", 1), ("cell3", "t1", 2), ("cell3", "off", 9)]
    return frame([("S", c, f, n, n, n) for c, f, n in data], STAT)


@pytest.fixture
def mapping(frame):
    return frame([("t1", "AGX"), ("t2", "BGX"), ("t3", "CGX")], "tag string, feature string")


def test_matrix_and_fractions(stat, mapping):
    got = E.with_fraction(E.cell_feature_counts(stat, mapping))
    assert {(r.cellId, r.feature): (r.umiCount, round(r.fraction, 4)) for r in got.collect()} == {
        ("cell1", "AGX"): (3, 0.75), ("cell1", "BGX"): (1, 0.25), ("cell2", "AGX"): (1, 0.3333), ("cell2", "BGX"): (1, 0.3333),
        ("cell2", "CGX"): (1, 0.3333), ("cell3", "AGX"): (2, 1.0),
    }


def test_summary_order_and_rounding(frame):
    df = frame([("S", "c", "B", 1), ("S", "c", "A", 1), ("S", "c", "Z", 6), ("S", "d", "A", 999), ("S", "d", "B", 1)], "sampleId string, cellId string, feature string, umiCount bigint")
    got = {r.cellId: r for r in E.per_cell_summary(E.with_fraction(df)).collect()}
    assert got["c"].featureSummary == "Z (75%, 6 UMI), A (12%, 1 UMI), B (12%, 1 UMI)"  # 12.5% rounds to even
    assert (got["c"].topFeature, got["c"].maxUmiCount, got["c"].totalUmiCount, got["c"].maxFraction) == ("Z", 6, 8, 0.75)
    assert got["d"].featureSummary == "A (100%, 999 UMI), B (<1%, 1 UMI)"


def test_a_cell_of_zeros_has_zero_fractions(frame):
    df = frame([("S", "c", "A", 0)], "sampleId string, cellId string, feature string, umiCount bigint")
    assert E.with_fraction(df).first().fraction == 0.0


def test_all_mode_needs_every_member(stat, frame):
    mapping = frame([("t1", "X", " ALL "), ("t2", "X", None), ("t3", "Y", "sum")], "tag string, feature string, mode string")
    E.check_mapping(mapping, "mode")
    assert rows(E.cell_feature_counts(stat, mapping, "mode"), "cellId", "feature", "umiCount") == {("cell1", "X", 4), ("cell2", "X", 2), ("cell2", "Y", 1)}
    assert rows(E.cell_feature_counts(stat, mapping, "mode", 2.0), "cellId", "feature") == {("cell2", "Y")}


@pytest.mark.parametrize(
    "rows_in, message",
    [([("t1", "A", ""), ("t1", "B", "")], "more than one row"), ([("t1", "A", "any")], "invalid"), ([("t1", "A", "sum"), ("t2", "A", "all")], "conflicting")],
)
def test_bad_mappings_are_refused(frame, rows_in, message):
    with pytest.raises(ValueError, match=message):
        E.check_mapping(frame(rows_in, "tag string, feature string, mode string"), "mode")


def test_diagnostics_only_where_nothing_met(stat, mapping, frame):
    assert E.empty_join_diagnostics(stat, mapping).count() == 0
    assert rows(E.empty_join_diagnostics(stat, frame([("x", "A")], "tag string, feature string"))) >= {("panel", "x"), ("reads", "t1")}
