import pytest
from helpers import rows

from tagspark.functions import terms as t
from tagspark.operators import states as X


@pytest.fixture
def refs(frame):
    return frame([("Ctrl",), ("Ctrl2",)], "tag string")


@pytest.fixture
def bed(counts):
    return counts(
        [
            ("S1", "c1", "A", 500), ("S1", "c1", "B", 4), ("S1", "c1", "Ctrl", 2), ("S1", "c1", "Ctrl2", 6),
            ("S1", "c2", "A", 3), ("S1", "c2", "B", 2),
            ("S1", "c3", "A", 5000), ("S1", "c3", "Ctrl", 400),
            ("S2", "c1", "A", 8),
        ]
    )


def test_floor_is_strict_and_spares_the_reference(bed, refs):
    got = rows(X.apply_floor(bed, 4, refs))
    assert ("S1", "c1", "B", 4) in got and ("S1", "c1", "Ctrl", 2) in got
    assert ("S1", "c2", "A", 0) in got and ("S1", "c2", "B", 0) in got


def test_floor_off_changes_nothing_and_counts_nothing(bed, refs):
    assert rows(X.apply_floor(bed, 0, refs)) == rows(bed)
    assert rows(X.floor_stats(bed, 0, refs)) == {("S1", 0, 0, 3), ("S2", 0, 0, 1)}


def test_floor_stats(bed, refs):
    assert rows(X.floor_stats(bed, 4, refs)) == {("S1", 2, 1, 3), ("S2", 0, 0, 1)}


def test_reference_takes_the_highest_and_fills_zero(bed, refs, frame):
    cells = frame([("S1", "c1"), ("S1", "c2"), ("S1", "c9")], "sampleId string, cellId string")
    assert rows(X.reference_declared(bed, refs, cells)) == {("S1", "c1", 6), ("S1", "c2", 0), ("S1", "c9", 0)}


def test_panel_median_truncates(counts, frame):
    data = counts([("S", "c", "A", 2), ("S", "c", "B", 5)])
    cells = frame([("S", "c"), ("S", "d")], "sampleId string, cellId string")
    assert rows(X.reference_panel_median(data, cells)) == {("S", "c", 3), ("S", "d", 0)}


def test_gate_is_strictly_above(frame):
    reference = frame([("S", "a", 100), ("S", "b", 101)], "sampleId string, cellId string, referenceCount bigint")
    assert rows(X.gate_cells(reference, 100)) == {("S", "b")}
    assert rows(X.gate_cells(reference, None)) == set()
    assert X.cells_high(reference, 100).first()[0] == 1 and X.cells_high(reference, None).first()[0] is None


def test_identity_is_the_highest_tag_and_own_sample_wins(counts, frame):
    data = counts([("S1", "c", "A", 5), ("S1", "c", "B", 9), ("S2", "c", "A", 7), ("S2", "c", "Z", 3)])
    grouping = frame([("A", "*", "X"), ("B", "*", "X"), ("A", "S2", "Y")], "tag string, sample string, identity string")
    assert rows(X.combine_tags(data, grouping)) == {("S1", "c", "X", 9), ("S2", "c", "Y", 7)}


def test_states_step_by_step_equal_one_pass(bed, refs, frame):
    grouping = frame([("A", "*", "A"), ("B", "*", "B")], "tag string, sample string, identity string")
    steps = X.read_states(X.combine_tags(X.apply_floor(bed, 4, refs), grouping), X.reference_declared(bed, refs), 100)
    once = X.states_from_counts(bed, grouping, refs, "declared", 4, 75.0, 100)
    assert rows(steps) == rows(once)
    states = {(r.sampleId, r.cellId, r.identity): (r.state, r.unreliableReason, r.referenceCount) for r in once.collect()}
    assert states["S1", "c1", "A"] == (t.BOUND, None, 6)
    assert states["S1", "c3", "A"] == (t.UNRELIABLE, t.GATED, 400)
    assert states["S2", "c1", "A"] == (t.NOT_BOUND, None, 0)


def test_a_cell_without_comparator_is_unreliable_with_null_reference(counts, frame):
    identities = frame([("S", "c", "A", 900)], "sampleId string, cellId string, identity string, umiCount bigint")
    none = frame([], "sampleId string, cellId string, referenceCount bigint")
    row = X.read_states(identities, none).first()
    assert (row.state, row.unreliableReason, row.referenceCount) == (t.UNRELIABLE, t.NO_COMPARATOR, None)


def test_probability_states(frame):
    identities = frame([("S", c, "A", 1) for c in "abcd"], "sampleId string, cellId string, identity string, umiCount bigint")
    p = frame([("S", "a", "A", 0.9), ("S", "b", "A", 0.89), ("S", "d", "A", 1.0)], "sampleId string, cellId string, identity string, pBound double")
    gated = frame([("S", "d")], "sampleId string, cellId string")
    got = {r.cellId: (r.state, r.unreliableReason) for r in X.read_states_probability(identities, p, gated).collect()}
    assert got == {"a": (t.BOUND, None), "b": (t.NOT_BOUND, None), "c": (t.UNRELIABLE, t.NO_COMPARATOR), "d": (t.UNRELIABLE, t.GATED)}


def test_settings_that_break_the_silent_count_are_refused():
    for bad in ({"cutoff": 0.04}, {"cutoff": 101}, {"bound_probability": 0.8}, {"min_voters": 0}, {"min_agreement": 0.5},
                {"initial_signal_weight": 1.0}, {"contending": [["A"]]}, {"contending": ["AB"]}, {"floor": -1}):
        with pytest.raises(ValueError):
            X.check_settings(**bad)
    X.check_settings(contending=[["A", "B"]], min_agreement=0.8)


def test_a_baseline_that_cannot_serve_is_refused():
    with pytest.raises(ValueError):
        X.served_source("declared", False, 30)
    with pytest.raises(ValueError):
        X.served_source("panel", True, 24)
    assert X.served_source("panel", False, 25) == "panel" and X.served_source("distribution", False, 1) == "distribution"


def test_cells_reading_nothing_sees_the_reference(bed, refs, frame):
    cells = frame([("S1", "c1"), ("S1", "c2"), ("S1", "c9")], "sampleId string, cellId string")
    assert rows(X.cells_reading_nothing(X.apply_floor(bed, 4, refs), cells)) == {("S1", "c2"), ("S1", "c9")}


def test_score_by_sample(frame):
    schema = "sampleId string, cellId string, identity string, umiCount bigint, referenceCount bigint, state string, unreliableReason string"
    scored = frame([("S", "a", "X", 10, 0, t.NOT_BOUND, None), ("S", "b", "X", 60, 0, t.BOUND, None)], schema)
    assert rows(X.score_by_sample(scored)) == {("S", 35.0, 49, 0.5)}
