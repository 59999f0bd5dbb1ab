import pytest
from helpers import rows

from tagspark.operators import reads as R

GEOMETRY = R.Geometry(cell=4, umi=2, feature=4)


def test_pattern_round_trip():
    for g in (R.Geometry(), R.Geometry(16, 10, 15, 10, False), GEOMETRY):
        assert R.parse_geometry(g.pattern()) == g
    with pytest.raises(ValueError, match="UMI, R2"):
        R.parse_geometry("^(CELL:N{16})(FEATURE:N{15})")
    with pytest.raises(ValueError, match="fixed-length"):
        R.parse_geometry("^(CELL:N{16})AC(UMI:N{10})\\^(FEATURE:N{15})(R2:*)")


@pytest.fixture
def reads(frame):
    data = [
        ("S", "1", "AAAACC", "TTTTxx"), ("S", "2", "AAAACC", "TTTTxx"), ("S", "3", "AAAAGG", "TTTTxx"),
        ("S", "4", "AAAACC", "GGGG"), ("S", "5", "CCCCGG", "TTTA"), ("S", "6", "AAA", "TTTT"), ("S", "7", "CCCCGG", "TTT"),
    ]
    return frame(data, "sampleId string, read_id string, r1 string, r2 string")


def test_reads_to_counts(reads):
    tagged = R.extract_tags(reads, GEOMETRY)
    assert rows(R.parse_report(tagged)) == {("S", 7, 5)}
    stat = R.tag_stat(R.molecules(tagged))
    assert rows(stat, "CELL", "FEATURE", "count", "unique_UMI") == {("AAAA", "TTTT", 3, 2), ("AAAA", "GGGG", 1, 1), ("CCCC", "TTTA", 1, 1)}


def test_an_offset_and_a_closed_first_read(frame):
    data = frame([("S", "1", "AAAACC", "NNTTTT"), ("S", "2", "AAAACCT", "NNTTTT")], "sampleId string, read_id string, r1 string, r2 string")
    got = R.extract_tags(data, R.Geometry(4, 2, 4, 2, False))
    assert rows(got, "read_id", "matched", "FEATURE") == {("1", True, "TTTT"), ("2", False, None)}


def test_correction_places_the_unique_nearest(frame):
    mols = frame(
        [("S", "c", "u1", "AAAA", 5, 5), ("S", "c", "u1", "AAAT", 2, 2), ("S", "c", "u2", "CCGG", 1, 1), ("S", "c", "u3", "AATT", 1, 1), ("T", "c", "u1", "AAAT", 1, 1)],
        "sampleId string, CELL string, UMI string, FEATURE string, reads bigint, weight bigint",
    )
    panel = frame([("S", "AAAA"), ("S", "CCCC"), ("S", "TTTT")], "sampleId string, tag string")
    assert rows(R.correct_to_panel(mols, panel), "UMI", "FEATURE", "reads") == {("u1", "AAAA", 7)}
    two = rows(R.correct_to_panel(mols, panel, 2), "UMI", "FEATURE", "reads")
    assert two == {("u1", "AAAA", 7), ("u2", "CCCC", 1)}  # AATT lies two from both AAAA and TTTT


def errors(a, b, subs, indels, most):
    """The fewest errors that turn `a` into `b`, by trying every alignment within the limits."""
    best, turns = None, [(0, 0, 0, 0)]
    while turns:
        i, j, s, d = turns.pop()
        if s > subs or d > indels or s + d > most:
            continue
        if i == len(a) and j == len(b):
            best = s + d if best is None else min(best, s + d)
            continue
        if i < len(a) and j < len(b):
            turns.append((i + 1, j + 1, s + (a[i] != b[j]), d))
        turns += [(i + 1, j, s, d + 1)] * (i < len(a)) + [(i, j + 1, s, d + 1)] * (j < len(b))
    return best


@pytest.mark.parametrize("limits", [(2, 2, 3), (0, 1, 1), (1, 2, 2), (3, 1, 4)])
def test_indels_against_every_alignment(frame, limits):
    import random

    rng = random.Random(sum(limits))
    word = lambda n: "".join(rng.choice("ACG") for _ in range(n))
    tags = sorted({word(6) for _ in range(12)})
    seen = sorted({word(rng.randrange(1, 9)) for _ in range(60)} - set(tags))
    panel = frame([("S", x) for x in tags] + [("T", "AAAAAA")], "sampleId string, tag string")
    want = {}
    for code in seen:
        near = sorted((d, x) for x in tags if (d := errors(code, x, *limits)) is not None)
        if near and (len(near) == 1 or near[0][0] < near[1][0]):
            want[code] = near[0][1]
    subs, indels, most = limits
    codes = frame([("S", x) for x in seen] * 2, "sampleId string, FEATURE string")
    got = R.feature_corrections(codes, panel, subs, max_indels=indels, max_errors=most)
    assert {r.FEATURE: r.corrected for r in got.collect()} == want
    assert want


def test_limits_of_a_correction(frame):
    panel = frame([("S", "AAAA")], "sampleId string, tag string")
    codes = frame([("S", "AAA")], "sampleId string, FEATURE string")
    for bad in ({"max_subs": 0}, {"max_indels": -1}, {"max_errors": 0}):
        with pytest.raises(ValueError):
            R.feature_corrections(codes, panel, **bad)
    assert R.feature_corrections(codes, panel, 2).count() == 0
    assert rows(R.feature_corrections(codes, panel, 0, max_indels=1), "corrected") == {("AAAA",)}
    assert R.feature_corrections(codes.filter("false"), panel, 0, max_indels=1).count() == 0


def test_chained_moves_end_at_the_code_that_stays(frame):
    sizes = {"AAAA": 1, "AAAC": 3, "AACC": 9, "ACCC": 30, "CCCC": 100, "GGGG": 50, "GGGT": 20}
    mols = frame([("S", c, "u", "F", n, n) for c, n in sizes.items()], "sampleId string, CELL string, UMI string, FEATURE string, reads bigint, weight bigint")
    assert rows(R.correct_de_novo(mols, chained=True), "CELL", "reads") == {("CCCC", 143), ("GGGG", 70)}
    assert rows(R.correct_de_novo(mols), "CELL", "reads") == {("CCCC", 130), ("ACCC", 9), ("AACC", 3), ("AAAC", 1), ("GGGG", 70)}


def test_whitelist_needs_one_neighbour(frame):
    mols = frame([("S", c, "u", "F", 1, 1) for c in ("AAAA", "AAAC", "CCCC", "AACC")], "sampleId string, CELL string, UMI string, FEATURE string, reads bigint, weight bigint")
    listed = frame([("AAAA",), ("CCCC",), ("TACC",), ("AATC",)], "CELL string")
    got = rows(R.correct_to_whitelist(mols, listed), "CELL", "reads")
    assert got == {("AAAA", 1), ("CCCC", 1)}  # AAAC and AACC each have two listed neighbours
    assert R.correct_to_whitelist(mols, None) is mols
    assert rows(R.correct_to_whitelist(mols, listed.filter("CELL <> 'AATC'")), "CELL", "reads") == {("AAAA", 2), ("CCCC", 1), ("TACC", 1)}


def neighbours(a, b):
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1


def test_de_novo_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    sizes = {(s, "".join(rng.choice("ACGT") for _ in range(3))): rng.randrange(1, 60) for s in ("S", "T") for _ in range(40)}
    mols = spark.createDataFrame([(s, c, "u", "F", n, n) for (s, c), n in sizes.items()], "sampleId string, CELL string, UMI string, FEATURE string, reads bigint, weight bigint")
    want = {}
    for (s, c), n in sizes.items():
        near = [(-m, d) for (s2, d), m in sizes.items() if s2 == s and neighbours(c, d) and m >= 2 * n]
        to = min(near)[1] if near else c
        want[s, to] = want.get((s, to), 0) + n
    got = {(r.sampleId, r.CELL): r.reads for r in R.correct_de_novo(mols, "CELL", 2.0).collect()}
    assert got == want
    with pytest.raises(ValueError):
        R.correct_de_novo(mols, "CELL", 1.0)


def test_read_recovery(frame):
    qc = frame([("a", 100.0, 80.0, 0.5), ("b", 100.0, 100.0, None), ("c", 0.0, 0.0, None)], "sampleId string, readsTotal double, readsMatched double, panelAssignedFraction double")
    assert rows(R.read_recovery(qc)) == {
        ("a", "Panel-assigned", 40, 0.4), ("a", "Not assigned", 40, 0.4), ("a", "No pattern match", 20, 0.2), ("b", "Matched", 100, 1.0)
    }


def test_preview_takes_the_first_reads(reads):
    assert rows(R.preview_reads(reads, 2), "read_id") == {("1",), ("2",)}
    with pytest.raises(ValueError):
        R.preview_reads(reads, 0)


def test_reads_to_counts_through_three_corrections(frame):
    from tagspark.plans.reads import ReadSettings, ReadsRun

    # cell AAAA, tag TTTT: molecule CC twice and its misread CG; a misread cell, a misread tag, a stray tag, a short read
    data = [("S", "AAAACC", "TTTT")] * 4 + [("S", "AAAACG", "TTTT"), ("S", "AAATGG", "TTTT"), ("S", "AAAAGG", "TTTA"), ("S", "AAAAGG", "GGGG"), ("S", "AAA", "TTTT"), ("T", "A", "T")]
    panel = frame([("S", "TTTT"), ("T", "TTTT")], "sampleId string, tag string")
    reads = frame(data, "sampleId string, r1 string, r2 string")
    run = ReadsRun(reads, panel, ReadSettings(GEOMETRY), frame([("AAAA",)], "CELL string"))
    assert rows(run.parse_report) == {("S", 9, 8, True), ("T", 1, 0, False)}
    assert rows(run.refine_report, "tagName", "inputCount", "outputCount") == {("CELL", 8, 8), ("FEATURE", 8, 7), ("UMI", 7, 7)}
    assert rows(run.counts, "sampleId", "cellId", "tag", "umiCount", "totalWeight") == {("S", "AAAA", "TTTT", 2, 7)}
    assert rows(run.raw_counts, "FEATURE", "count") == {("TTTT", 6), ("TTTA", 1), ("GGGG", 1)}
    # without a list the rare cell code joins the frequent one as well
    assert rows(ReadsRun(reads, panel, ReadSettings(GEOMETRY)).counts, "cellId", "umiCount") == {("AAAA", 2)}


def test_a_written_stage_leaves_no_shuffle(spark):
    """What was shuffled to write a table goes with it; a chain of corrections holds one step's shuffles at a time."""
    import os
    import time

    from pyspark.sql import functions as F

    from tagspark.sources import sinks

    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {f for d in root for _, _, names in os.walk(d) for f in names if f.startswith("shuffle") and f.endswith(".data")}
    before, was = held(), spark.conf.get(sinks.SHUFFLES_GO, None)
    stage = sinks.stage(spark.range(50_000).groupBy((F.col("id") % 20_000).alias("k")).agg(F.count(F.lit(1)).alias("n")), "sums")
    until = time.time() + 20
    while held() - before and time.time() < until:  # they are removed in the background
        time.sleep(0.2)
    assert held() - before == set()
    assert stage.count() == 20_000 and spark.conf.get(sinks.SHUFFLES_GO, None) == was


MOLS = "sampleId string, CELL string, UMI string, FEATURE string, reads bigint, weight bigint"


def some_molecules(frame, long=20):
    """Molecules of three cells with codes one or two letters from each other, with nulls, and rows that repeat."""
    import random

    rng, out = random.Random(11), []
    for cell in ("AAAA", "CCCC", None):
        seed = "".join(rng.choice("ACGT") for _ in range(long))
        for _ in range(60):
            code = list(seed)
            for _ in range(rng.randrange(3)):
                code[rng.randrange(long)] = rng.choice("ACGT")
            out.append(("S", cell, "".join(code), rng.choice("FG"), rng.randrange(1, 30), 1))
    return frame([*out, *out[:20], ("S", "AAAA", None, "F", 3, 3), ("S", "AAAA", None, "F", 1, 1)], MOLS)


def moved_by_hand(mols, ratio=2.0):
    from collections import Counter

    n, out = Counter(), Counter()
    for r in mols.collect():
        n[r.sampleId, r.CELL, r.FEATURE, r.UMI] += r.reads
    for (s, c, f, u), m in n.items():
        near = [(-k, x) for (s2, c2, f2, x), k in n.items() if c is not None and (s2, c2, f2) == (s, c, f) and u and x and neighbours(u, x) and k >= ratio * m]
        out[s, c, min(near)[1] if near else u, f] += m
    return dict(out)


def test_molecules_are_corrected_in_one_shuffle(frame):
    mols = some_molecules(frame)
    moved = R.correct_de_novo(mols, "UMI", 2.0)
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {(r.sampleId, r.CELL, r.UMI, r.FEATURE): r.reads for r in moved.collect()} == moved_by_hand(mols)


def test_groups_too_large_for_a_task_are_corrected_by_moves(frame, monkeypatch):
    mols = some_molecules(frame)
    monkeypatch.setattr(R.joins, "HOT_ROWS", 30)
    moved = R.correct_de_novo(mols, "UMI", 2.0)
    assert "Join" in moved._jdf.queryExecution().executedPlan().toString()
    assert {(r.sampleId, r.CELL, r.UMI, r.FEATURE): r.reads for r in moved.collect()} == moved_by_hand(mols)


def test_codes_are_shuffled_once_for_each_part_of_eight_letters(frame):
    from pyspark.sql import functions as F

    codes = frame([("A" * 24,), ("ACGTACGTAC",), ("ACG",), (None,)], "CELL string")
    got = R._parted(codes, [], "CELL", 4).groupBy("CELL").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    assert {r.CELL: r["keys"] for r in got.collect()} == {
        "A" * 24: ["*" * 8 + "A" * 16, "A" * 8 + "*" * 8 + "A" * 8, "A" * 16 + "*" * 8], "ACGTACGTAC": ["*****CGTAC", "ACGTA*****"], "ACG": ["***"]
    }


def test_long_cells_against_a_list_and_among_themselves(frame):
    mols = some_molecules(frame, 24).selectExpr("sampleId", "UMI AS CELL", "'u' AS UMI", "FEATURE", "reads", "weight")
    codes = sorted({r.CELL for r in mols.collect() if r.CELL})
    listed = {*codes[::3], codes[1][:5] + "N" + codes[1][6:], "AC"}
    want, n = {}, {}
    for r in mols.collect():
        near = [x for x in listed if r.CELL and neighbours(r.CELL, x) and "N" not in x]
        to = r.CELL if r.CELL in listed else near[0] if len(near) == 1 else None
        if to:
            want[to, r.FEATURE] = want.get((to, r.FEATURE), 0) + r.reads
        n[r.CELL] = n.get(r.CELL, 0) + r.reads
    got = R.correct_to_whitelist(mols, frame([(x,) for x in listed] + [(None,)], "CELL string"))
    assert {(r.CELL, r.FEATURE): r.reads for r in got.collect()} == want
    alone = {}
    for c, m in n.items():
        near = [(-k, x) for x, k in n.items() if c and x and neighbours(c, x) and k >= 2 * m]
        to = min(near)[1] if near else c
        alone[to] = alone.get(to, 0) + m
    moved = R.correct_de_novo(mols, "CELL", 2.0)
    assert {r.CELL: r.n for r in moved.groupBy("CELL").agg({"reads": "sum"}).withColumnRenamed("sum(reads)", "n").collect()} == alone
