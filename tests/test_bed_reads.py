"""What the registered queries count of the demonstration reads, and the whole card of a run."""

from tagspark.catalog import ORACLES, inputs
from tagspark.plans import roles
from tagspark.plans.run import VerdictRun


def test_figures_of_the_reads_share_one_pass_over_them(spark, frame, monkeypatch):
    built = []
    tagged = frame([("s", True, "AAAA", "U1", "TT", 1), ("s", True, "AAAA", "U2", "GG", 2)], "sampleId string, matched boolean, CELL string, UMI string, FEATURE string, weight long")
    monkeypatch.setattr(roles, "tagged_reads", lambda *_: built.append(1) or tagged)
    monkeypatch.setattr(roles, "coded_panel", lambda *_: frame([("s", "TT", "x")], "sampleId string, tag string, feature string"))
    reads = inputs.BedReads(spark, "")
    assert [(r.readsTotal, r.readsMatched, r.totalUniqueUmis) for r in reads.read_qc.collect()] == [(2, 2, 1)]
    assert sorted((r.FEATURE, r.declared) for r in reads.marked_sequences.collect()) == [("GG", False), ("TT", True)]
    assert built == [1]


def test_a_translated_run_counts_the_card_with_silent_positions(frame):
    assert "'cellPunchLong'" in ORACLES["run_translated"] and "'cellCardRows'" in ORACLES["run_translated"]

    class Run(VerdictRun):
        def __init__(self, spark):
            self.spark = spark

        def tables(self):
            return {"offered": frame([("a", "f")], "sampleId string, identity string")}

    card = frame([("a", "c1", "f"), ("b", "c2", "f")], "sampleId string, cellId string, identity string")
    made = Run(card.sparkSession).translated({"a": "A"}, {"cellPunchLong": card})
    assert sorted(r.sampleId for r in made["cellPunchLong"].collect()) == ["A", "b"] and made["offered"].first().sampleId == "A"
