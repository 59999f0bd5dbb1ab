import pytest
from helpers import rows

from tagspark.functions import terms as t
from tagspark.operators import checks as D
from tagspark.operators import panels as P
from tagspark.sources.panel import build_panel, check_roles, read_panel

ROLES = {"barcode": "Seq", "feature": "Name", "sample": "Sample"}
RAW = "_row bigint, Seq string, Name string, Sample string, Kind string"


def test_roles():
    with pytest.raises(ValueError, match="no barcode column"):
        check_roles(["Name"], ROLES)
    with pytest.raises(ValueError, match="both name column"):
        check_roles(["Seq", "Name"], {"barcode": "Seq", "feature": "Name", "sample": "Seq"})
    with pytest.raises(ValueError, match="reserved"):
        check_roles(["Seq", "Name", "tag"], {"barcode": "Seq", "feature": "Name"})
    check_roles(["tag", "Name"], {"barcode": "tag", "feature": "Name"})


def test_blank_barcodes_are_reported_before_blank_samples(frame):
    raw = frame([(2, " AA ", "a", "S1", "x"), (3, None, None, None, None), (4, "CC", "c", " S1", "y")], RAW)
    panel = build_panel(raw, ROLES)
    assert panel.dropped_lines == [3] and panel.small
    assert rows(panel.frame, "tag", "sample", "Name") == {("AA", "S1", "a"), ("CC", "S1", "c")}
    assert panel.properties == ["Name", "Kind"]


@pytest.mark.parametrize(
    "row, fault",
    [((3, "CC", "c", " ", "y"), "blank-sample"), ((3, "CC", "c", "*", "y"), "literal-any"), ((3, "AA ", "c", "S1", "y"), "declared-twice")],
)
def test_fatal_rows(frame, row, fault):
    with pytest.raises(ValueError, match=fault):
        build_panel(frame([(2, "AA", "a", "S1", "x"), row], RAW), ROLES)


def test_without_a_sample_column_every_sample_is_meant(frame):
    raw = frame([(2, "AA", "a", "S1", "x")], RAW)
    panel = build_panel(raw.withColumnRenamed("Sample", "Donor"), {"barcode": "Seq", "feature": "Name"})
    assert rows(panel.frame, "tag", "sample", "Donor") == {("AA", "*", "S1")}
    with pytest.raises(ValueError, match="reserved"):
        build_panel(raw, {"barcode": "Seq", "feature": "Name"})


def test_reading_a_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Seq,Name,Sample\nAA,"a, b",S1\n ,x,S1\nCC,c,S2\n')
    panel = read_panel(spark, str(tmp_path / "p.csv"), ROLES)
    assert rows(panel.frame, "tag", "sample", "Name") == {("AA", "S1", "a, b"), ("CC", "S2", "c")} and panel.dropped_lines == [3]


@pytest.fixture
def panel(frame):
    return frame(
        [("A", "S1", "Spike", "Target", "v1"), ("A", "S2", " Spike ", "Target", "v2"), ("B", "S1", "Spike", "Target", None), ("C", "S1", "Ctl", "Control", "v1"),
         ("D", "S1", "one", "Target", "v9"), ("D", "S2", "two", "Target", "v9")],
        "tag string, sample string, Name string, Kind string, Lot string",
    )


def test_properties_and_conflicts(panel):
    assert ("A", "Name", "Spike") in rows(P.consistent_properties(panel, ["Name", "Lot"]))
    got = {(r.tag, r.column): r.declared for r in P.property_conflicts(panel, ["Name", "Lot"]).collect()}
    assert got == {("A", "Lot"): ["v1", "v2"], ("D", "Name"): ["one", "two"]}


def test_reference_and_groupings(panel):
    refs = P.reference_tags(panel, "Kind", ["Control "])
    assert rows(refs) == {("C",)}
    with pytest.raises(ValueError):
        P.reference_tags(panel, "Missing", ["x"])
    grouped = P.property_grouping(panel, ["Name", "Lot"], refs)
    assert ("A", "S2", "Spike | v2", True) in rows(grouped) and ("B", "S1", "B", False) in rows(grouped)
    assert rows(P.ungrouped_tags(grouped)) == {("B",)}
    assert P.grouping_columns({"by": "property", "column": "Lot"}, ["Lot"]) == ["Lot"]
    for rule in ({"by": "property"}, {"by": "property", "columns": ["no"]}, {"by": "else"}):
        with pytest.raises(ValueError):
            P.make_grouping(panel, rule, refs)


def test_labels(panel):
    assert rows(P.tag_labels(panel, panel, "Name")) == {("A", "Spike (A)"), ("B", "Spike (B)"), ("C", "Ctl"), ("D", "one / two")}
    refs = P.reference_tags(panel, "Kind", ["Control"])
    grouping, rule = P.make_grouping(panel, {"by": "property", "columns": ["Name"]}, refs)
    got = rows(P.identity_labels(grouping, panel, refs, rule, "Name", ["Name"]))
    assert ("C", "background control") in got and ("Spike", "Spike") in got


def test_identity_properties_take_what_was_grouped_on(panel):
    refs = P.reference_tags(panel, "Kind", ["Control"])
    grouping = P.property_grouping(panel, ["Name"], refs)
    held = rows(P.identity_properties(grouping, panel, ["Name", "Kind", "Lot"], ["Name"]))
    assert ("one", "Name", "one") in held and ("Spike", "Kind", "Target") in held
    assert not {h for h in held if h[0] == "Spike" and h[1] == "Lot"}  # a member contradicts itself
    assert ("one", "Lot", "v9") in held


def test_offered_needs_declared_and_seen(frame):
    grouping = frame([("A", "S1", "X"), ("B", "*", "Y"), ("C", "S1", "Z")], "tag string, sample string, identity string")
    seen = frame([("S1", "A"), ("S2", "A"), ("S2", "B")], "sampleId string, tag string")
    assert rows(P.offered(grouping, seen)) == {("S1", "X"), ("S2", "Y")}


def test_panels_of_samples(frame):
    declared = frame([("S1", "B"), ("S1", "A"), ("S2", "A"), ("S2", "B")], "sampleId string, tag string")
    got = P.panels_of_samples(declared, frame([("S1",), ("S2",), ("S3",)], "sampleId string"))
    import hashlib

    both = hashlib.sha256(b"A\tB").hexdigest()[:12]
    none = hashlib.sha256(b"").hexdigest()[:12]
    assert rows(got) == {("S1", both, 2), ("S2", both, 2), ("S3", none, 0)}
    assert {r.label[3:] for r in P.panel_labels(got).collect()} == {" (2 barcodes, 2 samples)", " (0 barcodes, 1 sample)"}


def test_feature_properties_keep_the_first_in_file_order(frame):
    df = frame([(2, "x", "", "b"), (3, "x", "v1", None), (4, "x", "v2", "b"), (5, " ", "v3", None)], "_row bigint, Name string, P string, Q string")
    assert rows(P.feature_properties(df, "Name", ["P", "Q"])) == {("x", "P", "v1"), ("x", "Q", "b")}
    assert rows(P.feature_property_conflicts(df, "Name", ["P", "Q"])) == {("x", "P", "v1", "v2")}


def test_labels_translated_once(panel):
    assert {r[0] for r in P.translate_sample_labels(panel, {"id1": "S1"}).select("sample").collect()} == {"id1", "S2"}
    with pytest.raises(ValueError):
        P.translate_sample_labels(panel, {"a": "S1", "b": "S1"})


def test_min_distance_both_ways(frame, monkeypatch):
    codes = frame([("ACGTA",), ("ACGAA",), ("TTTTT",)], "tag string")
    assert P.min_pairwise_hamming(codes).first()[0] == 1
    far = frame([("AAAAA",), ("CCCAA",), ("GGGGG",)], "tag string")
    assert P.min_pairwise_hamming(far).first()[0] == 3
    monkeypatch.setattr(P.joins, "fits", lambda *_: False)
    assert P.min_pairwise_hamming(far).first()[0] == 3 and P.min_pairwise_hamming(codes).first()[0] == 1


def test_sample_column_prefers_the_exact_one(frame):
    profile = frame([("wide", v) for v in "abc"] + [("exact", v) for v in "ab"] + [("short", "a")], "column string, value string")
    names = frame([("a",), ("b",)], "name string")
    assert D.suggest_sample_column(profile, names, {"wide": 0, "exact": 1, "short": 2}).first().column == "exact"
    assert D.suggest_sample_column(profile.filter("column = 'short'"), names, {}).count() == 0


def test_no_shared_sample(frame):
    a, b = frame([("S1",)], "sampleId string"), frame([("S2",)], "sampleId string")
    assert D.share_no_sample(a, b) and not D.share_no_sample(a, a)


def test_a_declaration_for_all_reaches_every_sample_once(frame):
    panel = frame([(t.ANY_SAMPLE, "X"), (t.ANY_SAMPLE, "Y"), ("s3", "X"), ("s9", "Z")], "sample string, tag string")
    samples = frame([(f"s{i}",) for i in range(40)] + [("s1",), (None,)], "sampleId string")
    got = P.expand_samples(panel, samples)
    assert rows(got) == {(f"s{i}", x) for i in range(40) for x in "XY"} | {("s9", "Z")} and got.count() == 81
