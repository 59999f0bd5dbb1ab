import random

import pytest
from helpers import rows

from tagspark.functions import terms as t
from tagspark.operators import sets as S

STATES = "sampleId string, cellId string, identity string, umiCount bigint, referenceCount bigint, state string, unreliableReason string"
MEMBERS = "sampleId string, cellId string, setId string, gated boolean, outside boolean"


def state_rows(pairs):
    out = []
    for sample, cell, identity, state in pairs:
        out.append((sample, cell, identity, 1, 0, state, t.GATED if state == t.UNRELIABLE else None))
    return out


def verdicts(frame, states, members, offered, universe, **more):
    df = S.combine_cells(
        frame(state_rows(states), STATES), frame(members, MEMBERS), frame(offered, "sampleId string, identity string"), universe, **more
    )
    return {(r.setId, r.identity): r for r in df.collect()}


def test_the_four_states_and_their_reasons(frame):
    members = [("S1", c, "K1", False, False) for c in "abc"] + [("S1", "g", "K2", True, False), ("S2", "x", "K3", False, False), ("S2", "y", "K3", False, False)]
    states = [("S1", "a", "A", t.BOUND), ("S1", "b", "A", t.BOUND), ("S1", "g", "A", t.UNRELIABLE), ("S2", "x", "A", t.BOUND)]
    got = verdicts(frame, states, members, [("S1", "A"), ("S2", "A"), ("S1", "B")], ["A", "B"])
    assert (got["K1", "A"].state, got["K1", "A"].cellsBound, got["K1", "A"].cellsNotBound) == (t.BOUND, 2, 1)
    assert got["K1", "A"].agreement == pytest.approx(2 / 3)
    assert (got["K1", "B"].state, got["K1", "B"].cellsAnswered) == (t.NOT_BOUND, 3)
    assert (got["K2", "A"].state, got["K2", "A"].unreliableReason) == (t.UNRELIABLE, t.ALL_CELLS_GATED)
    assert (got["K3", "A"].state, got["K3", "A"].unreliableReason) == (t.UNRELIABLE, t.TIE)
    assert (got["K3", "B"].state, got["K3", "B"].unreliableReason, got["K3", "B"].cellsAsked) == (t.NEVER_ASKED, t.NEVER_OFFERED, 0)
    assert got["K3", "B"].agreement is None


def test_voters_and_agreement_limits(frame):
    members = [("S", c, "K", False, False) for c in "abcd"] + [("S", "z", "L", False, False)]
    states = [("S", c, "A", t.BOUND) for c in "abc"]
    strict = verdicts(frame, states, members, [("S", "A")], ["A"], min_voters=2, min_agreement=0.8)
    assert strict["K", "A"].unreliableReason == t.BELOW_AGREEMENT and strict["L", "A"].unreliableReason == t.TOO_FEW_VOTERS
    assert strict["L", "A"].agreement is None and strict["K", "A"].agreement == 0.75
    exact = verdicts(frame, states, members, [("S", "A")], ["A"], min_agreement=0.75)
    assert exact["K", "A"].state == t.BOUND


def test_a_reading_its_own_sample_did_not_offer_is_no_vote(frame):
    members = [("S1", "a", "K", False, False), ("S2", "b", "K", False, False)]
    got = verdicts(frame, [("S2", "b", "A", t.BOUND)], members, [("S1", "A")], ["A"])
    assert (got["K", "A"].state, got["K", "A"].cellsAsked, got["K", "A"].cellsBound) == (t.NOT_BOUND, 1, 0)


def test_a_cell_in_two_sets_stops_the_job(frame):
    linker = frame([("S", "a", "K1"), ("S", "a", "K2")], "sampleId string, cellId string, setId string")
    with pytest.raises(Exception, match="appears in sets"):
        S.cells_by_set(linker).collect()
    twice = frame([("S", "a", "K1"), ("S", "a", "K1")], "sampleId string, cellId string, setId string")
    assert rows(S.cells_by_set(twice)) == {("S", "a", "K1")}


def test_a_repeated_state_row_is_an_error(frame):
    members = [("S", "a", "K", False, False)]
    with pytest.raises(Exception, match="negative silent term"):
        verdicts(frame, [("S", "a", "A", t.BOUND)] * 2, members, [("S", "A")], ["A"])


def dense(states, members, offered, comparable):
    """Every member cell at every identity its sample was offered, one by one."""
    known = {(s, c, i): state for s, c, i, state in states}
    out = {}
    for sample, cell, set_id, gated, outside in members:
        for s, identity in offered:
            if s != sample:
                continue
            blocked = gated or outside or (sample, identity) not in comparable
            state = t.UNRELIABLE if blocked else known.get((sample, cell, identity), t.NOT_BOUND)
            row = out.setdefault((set_id, identity), [0, 0, 0, 0])
            row[0] += 1
            row[1] += state == t.BOUND
            row[2] += state == t.NOT_BOUND
            row[3] += gated
    return out


@pytest.mark.parametrize("seed", range(3))
def test_counted_silence_equals_the_dense_grid(frame, seed):
    rng = random.Random(seed)
    samples, identities = ["S1", "S2", "S3"], ["A", "B", "C", "D"]
    # one set holds a third of the cells
    members = [
        (s, f"c{i}", "hot" if rng.random() < 0.34 else f"K{rng.randrange(6)}", rng.random() < 0.2, rng.random() < 0.1)
        for s in samples for i in range(20)
    ]
    offered = [(s, i) for s in samples for i in identities if rng.random() < 0.8]
    comparable = {p for p in offered if rng.random() < 0.8}
    states = []
    for s, c, _, gated, outside in members:
        for i in identities:
            if rng.random() < 0.4:
                blocked = gated or outside or (s, i) not in comparable
                states.append((s, c, i, t.UNRELIABLE if blocked else rng.choice([t.BOUND, t.NOT_BOUND])))
    asked = frame([(s, i, (s, i) in comparable) for s, i in offered], "sampleId string, identity string, comparable boolean")
    got = S.combine_cells(frame(state_rows(states), STATES), frame(members, MEMBERS), asked, identities).collect()
    want = dense(states, members, offered, comparable)
    for r in got:
        n, bound, not_bound, gated = want.get((r.setId, r.identity), [0, 0, 0, 0])
        assert (r.cellsAsked, r.cellsBound, r.cellsNotBound) == (n, bound, not_bound)
        if n and not bound + not_bound:
            assert r.unreliableReason == (t.ALL_CELLS_GATED if gated == n else t.SET_NO_COMPARATOR)
    assert {(r.setId, r.identity) for r in got} == {(m[2], i) for m in members for i in identities}


def test_competitor_notes(frame):
    rows_in = [("K", "A", t.NOT_BOUND), ("K", "B", t.BOUND), ("K", "C", t.BOUND), ("K", "D", t.UNRELIABLE), ("L", "A", t.NOT_BOUND)]
    df = frame(rows_in, "setId string, identity string, state string")
    got = {(r.setId, r.identity): (r.competedWith, r.wasCompeted) for r in S.competitor_notes(df, [["A", "B"], ["A", "C", "D"]]).collect()}
    assert got["K", "A"] == ("B, C", "true") and got["K", "D"] == (None, "false")
    assert got["K", "B"] == (None, "false") and got["L", "A"] == (None, "false")
    assert {r.wasCompeted for r in S.competitor_notes(df, []).collect()} == {"false"}


def test_set_counts_and_punch(frame):
    schema = "setId string, identity string, state string, cellsAsked bigint, cellsAnswered bigint, cellsBound bigint, agreement double, unreliableReason string"
    df = frame([("K", "A", t.BOUND, 3, 3, 2, 2 / 3, None), ("K", "B", t.NEVER_ASKED, 0, 0, 0, None, t.NEVER_OFFERED)], schema)
    assert rows(S.set_counts(df)) == {("K", 1, 1, 1, 0)}
    card = S.identity_punch(df, ["A", "B"]).first()
    assert card.B == "never asked|0|0||never-offered|0" and card.A.startswith("bound|3|3|0.666")


def test_punch_decoding(frame):
    df = frame([("bound|3|4|0.75||3",), ("not bound|1|1|1.0|",), ("what|1|1||",), ("bound|x|1|||1",), (None,)], "punch string")
    got = [tuple(r) for r in S.decode_punch(df).collect()]
    assert got[0] == ("read", "bound", 3.0, 4.0, 0.75, None, 3.0) and got[1] == ("read", "not bound", 1.0, 1.0, 1.0, None, None)
    assert [g[0] for g in got[2:]] == ["unparsed"] * 3


def test_set_tag_median_counts_silent_cells_as_zero(frame, counts):
    members = frame([("S", c, "K", False, False) for c in "abcd"], MEMBERS)
    data = counts([("S", "a", "X", 8), ("S", "b", "X", 4), ("S", "a", "Y", 5), ("S", "a", "Z", 2), ("S", "b", "Z", 0), ("S", "c", "Z", 6)])
    got = rows(S.set_tag_median(data, members, frame([("S", "X"), ("S", "Y"), ("S", "Z")], "sampleId string, tag string")))
    assert got == {("K", "X", 2.0), ("K", "Z", 1.0)}


def test_self_disagreement_pools_cells(frame):
    members = frame([("S", c, "K", False, False) for c in "abc"] + [("S", "z", "single", False, False)], MEMBERS)
    states = frame(state_rows([("S", "a", "X", t.BOUND), ("S", "z", "X", t.BOUND)]), STATES)
    universe = frame([("X",), ("Y",)], "tag string")
    got = rows(S.self_disagreement(states, members, frame([("S", "X")], "sampleId string, tag string"), universe))
    assert got == {("X", 3, 1, 1 / 3), ("Y", 0, 0, None)}


def test_a_scope_may_hold_any_character(frame):
    members = frame([("S", c, "K", False, False) for c in "abc"], MEMBERS)
    states = frame(state_rows([("S", "a", "X", t.BOUND)]), STATES)
    scope = frame([("S", "X", 'a\t"b\\')], "sampleId string, tag string, scopeId string")
    universe = frame([('a\t"b\\', "X")], "scopeId string, tag string")
    got = rows(S.self_disagreement(states, members, frame([("S", "X")], "sampleId string, tag string"), universe, scope))
    assert got == {('a\t"b\\', "X", 3, 1, 1 / 3)}


def test_wide_forms_past_their_limit_are_errors(frame, monkeypatch):
    monkeypatch.setattr(t, "TAG_MEDIAN_LIMIT", 1)
    monkeypatch.setattr(t, "IDENTITY_PIVOT_LIMIT", 1)
    medians = frame([("K", "X", 1.0), ("K", "Y", 2.0)], "setId string, tag string, medianUmiCount double")
    with pytest.raises(ValueError, match="long form"):
        S.set_tag_median_table(medians, ["X", "Y"])
    with pytest.raises(ValueError, match="long form"):
        S.identity_summary(frame([("K", "X", "bound")], "setId string, identity string, state string"), ["X", "Y"])


def test_cell_punch(frame):
    members = frame([("S", "a", "K", False, False), ("S", "g", "K", True, False)], MEMBERS)
    states = frame(state_rows([("S", "a", "A", t.BOUND)]), STATES)
    long = S.cell_punch_long(states, members, frame([("S", "A"), ("S", "B")], "sampleId string, identity string"))
    got = {r.cellId: r for r in S.cell_punch(long, ["A", "B", "C"]).collect()}
    assert (got["a"].A, got["a"].B, got["a"].C, got["a"].boundIdentities) == ("bound|", "not bound|", None, 1)
    assert got["g"].A == f"unreliable|{t.GATED}"


def test_a_universe_too_large_to_name_gives_the_same_rows(frame):
    members = frame([("S", "a", "K", False, False), ("S", "b", "L", False, False)], MEMBERS)
    names = [f"I{i}" for i in range(150)]
    large = frame([(n,) for n in names], "identity string")
    assert rows(S.spine(members, large, "setId")) == rows(S.spine(members, names, "setId"))
    offered = frame([("S", "I3"), ("S", "I7")], "sampleId string, identity string")
    sets, absent = S.offer_patterns(members, offered, large)
    assert rows(absent, "identity") == {(n,) for n in names} - {("I3",), ("I7",)}
    assert absent.count() == 148 and rows(sets, "setId") == {("K",), ("L",)}


def test_patterns_are_as_many_as_the_ways_to_combine_declarations(frame):
    cells = [(f"S{i % 4}", f"c{i}", f"K{i % 300}", False, False) for i in range(3000)] + [("none", "x", "alone", False, False)]
    offered = frame([(f"S{s}", i) for s in range(4) for i in (("A", "B") if s < 3 else ("A", "C"))], "sampleId string, identity string")
    sets, absent = S.offer_patterns(frame(cells, MEMBERS), offered, ["A", "B", "C", "D"])
    pattern = {r.setId: r.pattern for r in sets.collect()}
    missing = {}
    for r in absent.collect():
        missing.setdefault(r.pattern, set()).add(r.identity)
    want = {"alone": {"A", "B", "C", "D"}}
    for sample, _, key, *_ in cells[:-1]:
        want[key] = want.get(key, {"A", "B", "C", "D"}) - ({"A", "B"} if sample != "S3" else {"A", "C"})
    assert {k: missing[p] for k, p in pattern.items()} == want
    assert len(set(pattern.values())) <= 4 and len(pattern) == 301


def test_disagreement_against_every_position(frame):
    """Complement counting beside the dense grid of sets and tags, with scopes and cells set aside."""
    import random

    rng = random.Random(11)
    samples, tags = ["S0", "S1", "S2"], [f"T{i}" for i in range(6)]
    offered = sorted((s, x) for s in samples for x in tags if rng.random() < 0.7)
    cells = [(rng.choice(samples), f"c{i}", f"K{rng.randrange(12)}", rng.random() < 0.2, rng.random() < 0.1) for i in range(90)]
    states = [(s, c, x, rng.choice([t.BOUND, t.NOT_BOUND]) if not (g or o) else t.UNRELIABLE) for s, c, _, g, o in cells for s2, x in offered if s2 == s and rng.random() < 0.3]
    scope = {(s, x): f"P{int(s == 'S2')}" for s, x in offered}
    votes = {}
    seen = {(s, c, x): v for s, c, x, v in states}
    for s, c, k, g, o in cells:
        for s2, x in offered:
            if s2 == s and not (g or o):
                votes.setdefault((scope[s, x], k, x), []).append(seen.get((s, c, x), t.NOT_BOUND) == t.BOUND)
    want = {}
    for (p, _, x), v in votes.items():
        if len(v) >= 2:
            n, m = want.get((p, x), (0, 0))
            want[p, x] = n + len(v), m + min(sum(v), len(v) - sum(v))
    scopes = frame([(s, x, p) for (s, x), p in scope.items()], "sampleId string, tag string, scopeId string")
    args = frame(state_rows(states), STATES), frame(cells, MEMBERS), frame(offered, "sampleId string, tag string")
    got = S.self_disagreement(*args, scopes.select("scopeId", "tag").distinct(), scopes)
    assert {(r.scopeId, r.tag): (r.cellsCompared, r.minorityCells) for r in got.collect() if r.cellsCompared} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan


def test_large_sets_are_read_in_more_tasks_with_the_same_rows(frame, monkeypatch):
    from tagspark.functions import joins

    cells = [("s" if i % 3 else "r", f"c{i}", f"k{i % 7 if i % 2 else 0}") for i in range(60)]
    outcome = lambda i, j: ("unreliable", "gated") if i in (1, 3) else ("bound" if (i + j) % 3 else "not bound", None)
    states = frame([(s, c, f"f{j}", 1, 1, *outcome(i, j)) for i, (s, c, _) in enumerate(cells) for j in range(3) if (i + j) % 2],
                   "sampleId string, cellId string, identity string, umiCount long, referenceCount long, state string, unreliableReason string")
    offered = frame([("s", "f0"), ("s", "f1"), ("s", "f2"), ("r", "f0")], "sampleId string, identity string")
    linker = frame(cells, "sampleId string, cellId string, setId string")
    gated = frame([("s", "c1"), ("r", "c3")], "sampleId string, cellId string")
    names = [f"f{j}" for j in range(3)]

    def all_of():
        members = S.with_admissibility(S.cells_by_set(linker), gated)
        sets, absent = S.offer_patterns(members, offered, names, True)
        own = S.combine_offered(states, members, offered, small=True)
        return [own, S.competitor_notes(S.whole_verdicts(own, sets, absent), [["f0", "f1"]], 60), S.set_counts(own, sets), S.identity_punch(own, names, sets), S.silent_tally(states, members, offered, "sampleId", True)]

    plain = [rows(df) for df in all_of()]
    monkeypatch.setattr(joins, "TASK_ROWS", 3)
    dealt = all_of()
    assert [rows(df) for df in dealt] == plain
    assert all(df.rdd.getNumPartitions() >= 32 for df in dealt[:4])


def test_tallies_by_sample_need_no_sound_sets(spark, tmp_path, frame):
    from tagspark.catalog import QUERIES

    tables = {
        "lineitem": ([(1, 7, 9.0, 1), (2, 7, 2.0, 1)], "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int"),
        "part": ([(7, "Brand#2"), (8, "Brand#1")], "p_partkey long, p_brand string"),
        "orders": ([(1, None, "2-HIGH", None), (2, 5, "2-HIGH", None)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp"),
    }
    for name, (given, schema) in tables.items():
        frame(given, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [r.asked for r in QUERIES["silent_tally_by_sample"](spark, str(tmp_path)).collect()] == [2]


def test_medians_of_large_tables_are_the_same_rows(frame, monkeypatch):
    from tagspark.functions import joins

    counts = frame([("s", f"c{i}", f"t{j}", (i * j + i // 4) % 9) for i in range(60) for j in range(3) if i % (j + 2)], "sampleId string, cellId string, tag string, umiCount long")
    members = frame([("s", f"c{i}", f"k{i % 4}", False, False) for i in range(60)], MEMBERS)
    offered = frame([("s", "t0"), ("s", "t1")], "sampleId string, tag string")
    plain = rows(S.set_tag_median(counts, members, offered, True))
    monkeypatch.setattr(joins, "TASK_ROWS", 2)
    dealt = S.set_tag_median(counts, members, offered, True)
    assert len(plain) > 4 and rows(dealt) == plain and dealt.rdd.getNumPartitions() >= 32
