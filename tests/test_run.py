"""Whole runs over a small bed with every state planted."""

import pytest
from helpers import rows

from tagspark.functions import terms as t
from tagspark.plans.run import RESULT_KEYS, WIDE_TABLES, Settings, VerdictRun, saved_card, saved_verdicts
from tagspark.sources.panel import build_panel

ROLES = {"barcode": "Seq", "feature": "Name", "sample": "Sample"}


@pytest.fixture
def bed(frame, counts):
    """S01 and S02 share two antigens; S03 declares a third one too, whose reagent is dead there."""
    raw = [("S01", "AAA", "AgA"), ("S01", "CCC", "AgB"), ("S01", "GGG", "Ctrl"), ("S02", "AAA", "AgA"), ("S02", "CCC", "AgB"), ("S02", "GGG", "Ctrl"),
           ("S03", "AAA", "AgA"), ("S03", "TTT", "AgC"), ("S03", "GGG", "Ctrl")]
    file = [(i + 2, seq, name, sample, "Control" if name == "Ctrl" else "Antigen") for i, (sample, seq, name) in enumerate(raw)]
    panel = build_panel(frame(file, "_row bigint, Seq string, Name string, Sample string, Type string"), ROLES)
    data = counts(
        [
            ("S01", "c1", "AAA", 500), ("S01", "c1", "GGG", 6), ("S01", "c2", "AAA", 500), ("S01", "c2", "CCC", 8), ("S01", "c3", "AAA", 2),
            ("S02", "g1", "AAA", 5000), ("S02", "g1", "GGG", 400), ("S02", "d1", "CCC", 8), ("S03", "d2", "AAA", 900), ("S03", "d3", "AAA", 8),
            ("S01", "ambient", "AAA", 9),
        ]
    )
    linker = frame([("S01", "c1", "K1"), ("S01", "c2", "K1"), ("S01", "c3", "K1"), ("S02", "g1", "K2"), ("S02", "d1", "K3"), ("S03", "d2", "K3"), ("S03", "d3", "K4"), ("S03", "silent", "K4")],
                   "sampleId string, cellId string, setId string")
    return data, panel, linker


def settings(**more):
    base = {"source": "declared", "gate": 100, "feature_column": "Name", "role_column": "Type", "reference_values": ("Control",)}
    return Settings(**{**base, **more})


def test_all_four_states_in_one_run(bed):
    data, panel, linker = bed
    run = VerdictRun(data, panel, settings(contending=(("AAA", "CCC"),)), linker)
    got = {(r.setId, r.identity): r for r in run.verdicts.collect()}
    assert run.universe == ["AAA", "CCC", "TTT"]
    assert (got["K1", "AAA"].state, got["K1", "AAA"].cellsBound, got["K1", "AAA"].cellsNotBound) == (t.BOUND, 2, 1)
    assert (got["K1", "CCC"].state, got["K1", "CCC"].competedWith, got["K1", "CCC"].wasCompeted) == (t.NOT_BOUND, "AAA", "true")
    assert (got["K2", "AAA"].state, got["K2", "AAA"].unreliableReason) == (t.UNRELIABLE, t.ALL_CELLS_GATED)
    assert (got["K3", "AAA"].state, got["K3", "AAA"].unreliableReason, got["K3", "AAA"].cellsAsked) == (t.UNRELIABLE, t.TIE, 2)
    assert (got["K3", "CCC"].state, got["K3", "CCC"].cellsAsked) == (t.NOT_BOUND, 1)
    # declared in S03 and never seen there: a dead reagent asks nothing
    assert {got[k, "TTT"].state for k in ("K1", "K2", "K3", "K4")} == {t.NEVER_ASKED}
    assert (got["K4", "AAA"].state, got["K4", "AAA"].cellsAnswered) == (t.NOT_BOUND, 2)


def test_a_linker_of_other_samples_is_refused(bed, frame):
    data, panel, _ = bed
    with pytest.raises(ValueError, match="none of the samples"):
        VerdictRun(data, panel, settings(), frame([("T9", "c1", "K1")], "sampleId string, cellId string, setId string"))


def test_every_table_is_made_and_saved(bed, spark, tmp_path):
    data, panel, linker = bed
    run = VerdictRun(data, panel, settings(wide=WIDE_TABLES), linker)
    written = run.save(str(tmp_path))
    assert set(written) == set(RESULT_KEYS) - {"undeclaredBarcodes", "qcBackgrounds", "qcTagFits", "qcUnfitted"}
    back = spark.read.parquet(str(tmp_path / "setCounts.parquet"))
    assert rows(back, "setId", "cellCount", "cellsSetAside") == {("K1", 3, 0), ("K2", 1, 1), ("K3", 2, 0), ("K4", 2, 0)}
    assert spark.read.parquet(str(tmp_path / "cellScalars.parquet")).filter("cellId = 'ambient'").first().inCellList == "false"
    record = spark.read.parquet(str(tmp_path / "runMeta.parquet")).first()
    assert (record.cellListSource, record.setCount, record.referenceTags, record.samplePanelCount) == ("clonotype linker", 4, "GGG", 2)
    assert (record.noBaselineReason, record.referenceValues, record.grouping, record.cellPunchEmitted, record.cellPunchCells) == ("", "Control", '{"by": "tag"}', True, 8)
    assert rows(saved_verdicts(spark, str(tmp_path))) == rows(run.verdicts)
    assert rows(saved_verdicts(spark, str(tmp_path)).filter(f"state = '{t.NEVER_ASKED}'"), "setId", "identity") == {(k, "TTT") for k in ("K1", "K2", "K3", "K4")} | {("K4", "CCC")}
    assert rows(saved_card(spark, str(tmp_path))) == rows(run.cell_punch_long)
    one = saved_card(spark, str(tmp_path), linker.filter("cellId = 'silent'"))
    assert rows(one, "identity", "cellState", "reason") == {("AAA", t.NOT_BOUND, None)}
    spreads = spark.read.parquet(str(tmp_path / "qcSpreads.parquet"))
    cells = spark.read.parquet(str(tmp_path / "cellBackground.parquet")).count()
    assert spreads.filter("spread = 'referenceReading'").agg({"weight": "sum"}).first()[0] == cells
    assert spreads.filter("spread = 'score'").agg({"weight": "sum"}).first()[0] == spark.read.parquet(str(tmp_path / "cellScore.parquet")).count()


def test_sample_names_replace_ids_in_keys_and_lists(bed):
    data, panel, linker = bed
    run = VerdictRun(data, panel, settings(wide=WIDE_TABLES), linker)
    plain, named = run.tables(), run.translated({"S01": "first", "S03": "third"})
    assert set(plain) == set(named)
    assert {r.sampleId for r in named["offered"].collect()} == {"first", "S02", "third"}
    assert named["cellPunch"].columns == plain["cellPunch"].columns and named["cellPunch"].count() == plain["cellPunch"].count()
    assert named["runMeta"].first().samples == "first, S02, third"
    assert "first" in {n for r in named["reagents"].collect() for n in r.samplesInPanelNames.split(", ")}


def test_fits_travel_with_the_bins(frame, counts):
    raw = [(2, "AAA", "AgA", "S01", "Antigen"), (3, "CCC", "AgB", "S01", "Antigen")]
    panel = build_panel(frame(raw, "_row bigint, Seq string, Name string, Sample string, Type string"), ROLES)
    low, high = [1, 1, 2, 2, 3] * 12, [40, 44, 47, 50, 52, 55, 61, 66] * 8
    data = counts([("S01", f"c{i}", "AAA", n) for i, n in enumerate(low + high)] + [("S01", "c0", "CCC", 4)])
    run = VerdictRun(data, panel, settings(source="distribution", role_column="", reference_values=(), min_cells=50))
    tables = run.tables()
    fit = {r.tag: r for r in tables["qcTagFits"].collect()}
    assert fit["AAA"].backgroundMean < 5 and 40 < fit["AAA"].signalMean < 62 and 3 < fit["AAA"].boundAtCount <= 40
    assert {r.tag for r in tables["qcUnfitted"].collect()} | set(fit) == {"AAA", "CCC"}
    assert tables["runMeta"].first().pairsUnfitted == 2 - len(fit)


def test_without_a_linker_membership_is_unknown(bed):
    data, panel, _ = bed
    tables = VerdictRun(data, panel, settings()).tables()
    assert {r.inCellList for r in tables["cellScalars"].collect()} == {"unknown"}
    assert tables["verdicts"].count() == 0 and "cellPunch" not in tables


def test_no_fit_anywhere_empties_the_answers_and_keeps_the_structure(bed):
    data, panel, linker = bed
    run = VerdictRun(data, panel, settings(source="distribution"), linker)
    tables = run.tables()
    assert not run.established
    assert tables["verdicts"].count() == 0 and tables["verdicts"].columns[:2] == ["setId", "identity"]
    assert tables["offered"].count() > 0 and tables["runMeta"].first().baselineEstablished is False
    assert {r.reason for r in run.fits.collect()} == {t.FIT_TOO_FEW}


def test_a_baseline_the_panel_cannot_serve_is_refused(bed):
    data, panel, linker = bed
    with pytest.raises(ValueError):
        VerdictRun(data, panel, settings(source="panel"), linker)
    with pytest.raises(ValueError):
        VerdictRun(data, panel, settings(reference_values=()), linker)
    with pytest.raises(ValueError):
        VerdictRun(data, panel, settings(role_column="Nope"), linker)
