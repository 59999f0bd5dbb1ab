"""The fitted background. The SQL of the fit walks its turns by a recursive query; what is read off a fit is also checked
against components taken from the data by moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import joins
from ..operators import mixture as M
from ..operators import quality as Q
from ..operators import sets as S
from ..operators import states as X
from ..plans import roles
from ..sources.sinks import stage
from .base import Bed, query, rounded

_HIST = """SELECT p.sample AS "sampleId", p.tag, coalesce(c."umiCount", 0) AS "umiCount", count(*) AS cells FROM panel p JOIN listed l ON l."sampleId" = p.sample
    LEFT JOIN counts c ON c."sampleId" = l."sampleId" AND c."cellId" = l."cellId" AND c.tag = p.tag GROUP BY 1, 2, 3"""


def _moments(side: str) -> str:
    mean = f'sum("umiCount" * cells) FILTER (WHERE {side}) / sum(cells) FILTER (WHERE {side})'
    var = f'sum("umiCount" * "umiCount" * cells) FILTER (WHERE {side}) / sum(cells) FILTER (WHERE {side}) - ({mean}) ** 2'
    return f"{mean} AS m, {var} AS v, sum(cells) FILTER (WHERE {side}) / sum(cells) AS w"


def _component(side: str) -> str:
    return f"""SELECT "sampleId", tag, greatest(m, 1e-6) AS m, CASE WHEN v > m THEN m * m / (v - m) ELSE 1e6 END AS s, w FROM (SELECT "sampleId", tag, {_moments(side)} FROM hist GROUP BY 1, 2)
        WHERE CAST(substr(tag, 7) AS INTEGER) % 5 <> 0"""


def _log_mass(c: str) -> str:
    v = 'h."umiCount"'
    return f"(ln({c}.w) + lgamma({v} + {c}.s) - lgamma({c}.s) - lgamma({v} + 1) + {c}.s * ln({c}.s / ({c}.s + {c}.m)) + {v} * ln({c}.m / ({c}.s + {c}.m)))"


def _curve(floor: int) -> str:
    """The curve of every fitted pair: counts below the floor read as 0, the control's kept."""
    return f""", scored AS (SELECT DISTINCT "sampleId", tag, CASE WHEN "umiCount" < {floor} AND tag NOT IN (SELECT tag FROM refs) THEN 0 ELSE "umiCount" END AS "umiCount" FROM hist),
    curve AS MATERIALIZED (SELECT h."sampleId", h.tag, h."umiCount", 1 / (1 + exp({_log_mass("lo")} - {_log_mass("hi")})) AS p FROM scored h
        JOIN lo ON lo."sampleId" = h."sampleId" AND lo.tag = h.tag JOIN hi ON hi."sampleId" = h."sampleId" AND hi.tag = h.tag)"""


def _dense(floor: int) -> str:
    """The dense probabilities: every listed cell at every fitted pair, silent cells included."""
    return f""", full_p AS (SELECT l."sampleId", l."cellId", g.identity, max(c.p) AS p FROM listed l JOIN grp g ON g."sampleId" = l."sampleId"
        LEFT JOIN counts k ON k."sampleId" = l."sampleId" AND k."cellId" = l."cellId" AND k.tag = g.tag
        JOIN curve c ON c."sampleId" = l."sampleId" AND c.tag = g.tag AND c."umiCount" = CASE WHEN coalesce(k."umiCount", 0) < {floor} THEN 0 ELSE k."umiCount" END GROUP BY 1, 2, 3)"""


_GIVEN = f"""AND hist AS ({_HIST}), lo AS ({_component('"umiCount" < 10')}), hi AS ({_component('"umiCount" >= 10')})""" + _curve(12)
_DENSE = _dense(12)


# the fit itself, over lists of a pair's distinct counts `v`, their cells `w` and ln v! `g`
def _rise(v: str, s: str) -> str:
    """ln of the rising factorial of s over v steps."""
    return f"coalesce(list_sum([ln({s} + i) FOR i IN range(CAST({v} AS BIGINT))]), 0.0)"


def _mass(m: str, s: str, x: str = "x") -> str:
    """Log mass of the count in `x.v`, ln of whose factorial is `x.g`."""
    return f"({_rise(f'{x}.v', s)} - {x}.g - {s} * ln(1 + {m} / {s}) + {x}.v * ln({m} / ({s} + {m})))"


def _total(of: str) -> str:
    return f"list_sum([{of} FOR x IN xs])"


_SIZE = "CASE WHEN {v} > {m} AND {m} > 0 THEN {m} * {m} / ({v} - {m}) ELSE 1e6 END"


def _side(k: int, side: str) -> str:
    """A start: the weight, mean and size of the counts on one side of the cut."""
    one = lambda of: f"list_sum([CASE WHEN {side} THEN {of} ELSE 0.0 END FOR x IN xs])"
    return f"{one('x.w')} / n AS w{k}, greatest({one('x.w * x.v')} / {one('x.w')}, 1e-6) AS m{k}, {one('x.w * x.v')} / {one('x.w')} AS p{k}"


def _turn(k: int) -> str:
    """What a turn of the fit makes of component k from its shares `r.r1`, `r.r2`."""
    share = f"list_sum([r.w * r.r{k} FOR r IN shares])"
    mean = f"greatest(list_sum([r.w * r.r{k} * r.v FOR r IN shares]) / ({share}), 1e-6)"
    return f"{share} / n AS w{k}, {mean} AS m{k}"


def _median(m: str, s: str) -> str:
    steps = f"[exp({_mass(m, s, 'y')}) FOR y IN [struct_pack(v := j, g := {_rise('j', '1')}) FOR j IN range(CAST(floor({m}) AS BIGINT) + 16)]]"
    return f"list_min([CASE WHEN list_sum(steps[1:j + 1]) >= 0.5 - 1e-12 THEN j END FOR j IN range(len(steps))]) FROM (SELECT {steps} AS steps)"


def _recursive_fit(populated: int = 300) -> str:
    spread = lambda k: f"list_sum([r.w * r.r{k} * (r.v - m{k}) ** 2 FOR r IN shares]) / list_sum([r.w * r.r{k} FOR r IN shares])"
    var = lambda k, side: f"list_sum([CASE WHEN {side} THEN x.w * (x.v - p{k}) ** 2 ELSE 0.0 END FOR x IN xs]) / list_sum([CASE WHEN {side} THEN x.w ELSE 0.0 END FOR x IN xs])"
    logs = f"struct_pack(v := x.v, w := x.w, a := ln(w1) + {_mass('m1', 's1')}, b := ln(w2) + {_mass('m2', 's2')})"
    return f"""AND RECURSIVE hist AS MATERIALIZED ({_HIST}), every AS (SELECT p.sample AS "sampleId", p.tag, coalesce(c."umiCount", 0) AS v FROM panel p JOIN listed l ON l."sampleId" = p.sample
        LEFT JOIN counts c ON c."sampleId" = l."sampleId" AND c."cellId" = l."cellId" AND c.tag = p.tag),
    trim AS MATERIALIZED (SELECT "sampleId", tag, quantile_cont(v, 0.99) AS top, count(*) AS cells FROM every GROUP BY 1, 2),
    kept AS MATERIALIZED (SELECT h."sampleId", h.tag, CAST(h."umiCount" AS DOUBLE) AS v, CAST(h.cells AS DOUBLE) AS w, {_rise('h."umiCount"', "1")} AS g
        FROM hist h JOIN trim q ON q."sampleId" = h."sampleId" AND q.tag = h.tag WHERE h."umiCount" <= q.top AND q.cells >= {populated}),
    lists AS MATERIALIZED (SELECT "sampleId", tag, list(struct_pack(v := v, w := w, g := g) ORDER BY v) AS xs, sum(w) AS n FROM kept GROUP BY 1, 2 HAVING count(*) >= 2),
    ends AS (SELECT k."sampleId", k.tag, k.v AS c, sum(k.w) OVER a AS lw, sum(k.w * k.v) OVER a AS ls, sum(k.w * k.v * k.v) OVER a AS lq, sum(k.w) OVER p AS n, sum(k.w * k.v) OVER p AS s, sum(k.w * k.v * k.v) OVER p AS q
        FROM kept k WINDOW a AS (PARTITION BY k."sampleId", k.tag ORDER BY k.v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY k."sampleId", k.tag)),
    halves AS (SELECT *, ln(lw / n) AS l1, ln((n - lw) / n) AS l2, greatest(ls / lw, 1e-6) AS m1, greatest((s - ls) / (n - lw), 1e-6) AS m2,
        greatest(lq / lw - (ls / lw) ** 2, 0.0) AS v1, greatest((q - lq) / (n - lw) - ((s - ls) / (n - lw)) ** 2, 0.0) AS v2 FROM ends WHERE lw < n),
    sized AS (SELECT *, {_SIZE.format(v="v1", m="m1")} AS s1, {_SIZE.format(v="v2", m="m2")} AS s2 FROM halves),
    cuts AS MATERIALIZED (SELECT "sampleId", tag, arg_max(c, struct_pack(score := score, first := -c)) AS c FROM (
        SELECT z."sampleId", z.tag, z.c, sum(x.w * CASE WHEN x.v <= z.c THEN z.l1 + {_mass("z.m1", "z.s1")} ELSE z.l2 + {_mass("z.m2", "z.s2")} END) AS score
        FROM sized z JOIN kept x ON x."sampleId" = z."sampleId" AND x.tag = z.tag GROUP BY 1, 2, 3) GROUP BY 1, 2),
    begun AS (SELECT l."sampleId", l.tag, xs, n, c, {_side(1, "x.v <= c")}, {_side(2, "x.v > c")} FROM lists l JOIN cuts k ON k."sampleId" = l."sampleId" AND k.tag = l.tag),
    start AS (SELECT *, {var(1, "x.v <= c")} AS v1, {var(2, "x.v > c")} AS v2 FROM begun),
    turns("sampleId", tag, xs, n, turn, last, done, w1, m1, s1, w2, m2, s2) AS (
        SELECT "sampleId", tag, xs, n, 0, CAST('-inf' AS DOUBLE), false, w1, m1, {_SIZE.format(v="v1", m="m1")}, w2, m2, {_SIZE.format(v="v2", m="m2")} FROM start
        UNION ALL SELECT "sampleId", tag, xs, n, turn + 1, likelihood, failed OR abs(likelihood - last) < 1e-6, w1, m1, {_SIZE.format(v="v1", m="m1")}, w2, m2, {_SIZE.format(v="v2", m="m2")} FROM (
            SELECT *, {spread(1)} AS v1, {spread(2)} AS v2, abs(m1 - m2) <= 1e-9 * abs(m2) AS failed FROM (
                SELECT "sampleId", tag, xs, n, turn, last, shares, list_sum([r.w * r.t FOR r IN shares]) / n AS likelihood, {_turn(1)}, {_turn(2)} FROM (
                    SELECT "sampleId", tag, xs, n, turn, last, [struct_pack(v := r.v, w := r.w, t := r.t, r1 := exp(r.a - r.t), r2 := exp(r.b - r.t)) FOR r IN
                        [struct_pack(v := r.v, w := r.w, a := r.a, b := r.b, t := greatest(r.a, r.b) + ln(1 + exp(-abs(r.a - r.b)))) FOR r IN logs]] AS shares FROM (
                        SELECT *, [{logs} FOR x IN xs] AS logs FROM turns WHERE NOT done AND turn < 200))))),
    fitted AS MATERIALIZED (SELECT *, abs(m1 - m2) <= 1e-9 * abs(m2) AS same, (SELECT {_median("m1", "s1")}) AS d1, (SELECT {_median("m2", "s2")}) AS d2 FROM turns
        QUALIFY turn = max(turn) OVER (PARTITION BY "sampleId", tag)),
    told AS MATERIALIZED (SELECT *, CASE WHEN d1 <> d2 THEN d2 > d1 ELSE m2 > m1 END AS second FROM fitted WHERE NOT same),
    lo AS MATERIALIZED (SELECT "sampleId", tag, if(second, m1, m2) AS m, if(second, s1, s2) AS s, if(second, w1, w2) AS w FROM told),
    hi AS MATERIALIZED (SELECT "sampleId", tag, if(second, m2, m1) AS m, if(second, s2, s1) AS s, if(second, w2, w1) AS w FROM told)"""


_FIT = _recursive_fit()


def histogram(bed: Bed):
    pairs = M.declared_pairs(bed.panel, roles.samples(bed.spark, bed.sf))
    return M.count_histogram(bed.counts, bed.cell_list, pairs, bed.small)


def given_fits(hist):
    """Components by moments below and from a count of 10; every fifth tag stays unfitted."""

    def part(name: str, side):
        v, w = F.col("umiCount"), F.when(side, F.col("cells"))
        mean = F.sum(v * w) / F.sum(w)
        var = F.sum(v * v * w) / F.sum(w) - mean * mean
        size = F.when(var > mean, mean * mean / (var - mean)).otherwise(M.POISSON_SIZE)
        return [F.greatest(mean, F.lit(M.MIN_MEAN)).alias(f"{name}Mean"), size.alias(f"{name}Size"), (F.sum(w) / F.sum("cells")).alias(f"{name}Weight")]

    made = hist.groupBy("sampleId", "tag").agg(
        F.sum("cells").alias("cells"), *part("background", F.col("umiCount") < 10), *part("signal", F.col("umiCount") >= 10)
    )
    reason = F.when(roles.brand_number("tag") % 5 == 0, "left out").cast("string")
    return made.withColumn("reason", reason)


def given_curve(bed: Bed):
    hist = stage(histogram(bed), "histogram")
    return stage(M.score_curve(given_fits(hist), hist, 12, bed.refs, bed.small), "curve")


@query(f"{_HIST}")
def count_histogram(spark, sf):
    return histogram(Bed(spark, sf))


@query('SELECT p.sample AS "sampleId", p.tag FROM panel p')
def declared_pairs(spark, sf):
    return M.declared_pairs(roles.panel(spark, sf), roles.samples(spark, sf))


@query(_FIT + """ SELECT q."sampleId", q.tag, CASE WHEN q.cells < 300 THEN 'the sample holds too few cells for a distribution to be fitted' WHEN lo.m IS NULL THEN 'no two-component fit could be computed for this tag' END AS reason,
    q.cells, round(lo.m, 4) AS "backgroundMean", round(ln(lo.s), 4) AS "backgroundLogSize", round(lo.w, 4) AS "backgroundWeight", round(hi.m, 4) AS "signalMean", round(ln(hi.s), 4) AS "signalLogSize", round(hi.w, 4) AS "signalWeight"
    FROM trim q LEFT JOIN lo ON lo."sampleId" = q."sampleId" AND lo.tag = q.tag LEFT JOIN hi ON hi."sampleId" = q."sampleId" AND hi.tag = q.tag""")
def mixture_fits(spark, sf):
    """The fit of every (sample, tag) over the listed cells to four places, or the reason why there is none."""
    fits = M.fit_two_component_nb(stage(histogram(Bed(spark, sf)), "histogram"))
    values = {f"{k}{name}": F.round(F.log(f"{k}Size") if name == "LogSize" else F.col(f"{k}{name}"), 4) for k in ("background", "signal") for name in ("Mean", "LogSize", "Weight")}
    return fits.select("sampleId", "tag", "reason", "cells", *[v.alias(k) for k, v in values.items()])


@query(_GIVEN + ' SELECT "sampleId", tag, "umiCount", round(p, 6) AS "pBound" FROM curve')
def score_curve(spark, sf):
    return rounded(given_curve(Bed(spark, sf)), "pBound")


@query(_GIVEN + """ SELECT k."sampleId", k."cellId", k.tag, round(c.p, 6) AS "pBound" FROM counts k JOIN listed l ON l."sampleId" = k."sampleId" AND l."cellId" = k."cellId"
    JOIN curve c ON c."sampleId" = k."sampleId" AND c.tag = k.tag AND c."umiCount" = CASE WHEN k."umiCount" < 12 AND k.tag NOT IN (SELECT tag FROM refs) THEN 0 ELSE k."umiCount" END""")
def tag_probabilities(spark, sf):
    bed = Bed(spark, sf)
    return rounded(M.tag_probabilities(bed.counts, bed.cell_list, given_curve(bed), 12, bed.refs, bed.small), "pBound")


@query(_GIVEN + ' SELECT "sampleId", tag, round(p, 6) AS "pSilent" FROM curve WHERE "umiCount" = 0')
def silent_probabilities(spark, sf):
    return rounded(M.silent_probabilities(given_curve(Bed(spark, sf))), "pSilent")


@query(_GIVEN + _DENSE + """ SELECT f."sampleId", f."cellId", f.identity, round(f.p, 6) AS "pBound" FROM full_p f WHERE EXISTS (
    SELECT 1 FROM counts k JOIN grp g ON g."sampleId" = k."sampleId" AND g.tag = k.tag WHERE k."sampleId" = f."sampleId" AND k."cellId" = f."cellId" AND g.identity = f.identity)""")
def identity_probabilities(spark, sf):
    """Highest member probability at the positions a cell shows, against the dense table of all positions."""
    bed = Bed(spark, sf)
    return rounded(M.identity_probabilities(bed.counts, bed.cell_list, given_curve(bed), bed.grouping, 12, bed.refs, bed.small), "pBound")


@query("""SELECT DISTINCT g."sampleId", g.identity FROM grp g WHERE CAST(substr(g.tag, 7) AS INTEGER) % 5 <> 0""")
def comparable_identities(spark, sf):
    bed = Bed(spark, sf)
    return M.comparable_identities(given_fits(histogram(bed)), bed.grouping)


@query(_GIVEN + """, miss AS (SELECT "sampleId", tag, max("umiCount") FILTER (WHERE p < 0.9) AS miss FROM curve GROUP BY 1, 2)
    SELECT m."sampleId", m.tag, min(c."umiCount") FILTER (WHERE m.miss IS NULL OR c."umiCount" > m.miss) AS "boundAtCount" FROM miss m
    JOIN curve c ON c."sampleId" = m."sampleId" AND c.tag = m.tag GROUP BY 1, 2""")
def bound_at_count(spark, sf):
    return M.bound_at_count(given_curve(Bed(spark, sf)))


@query(_GIVEN + """ SELECT lo."sampleId", lo.tag, round(lo.m, 6) AS "backgroundMean", round(hi.m, 6) AS "signalMean", round(lo.w, 6) AS "backgroundWeight"
    FROM lo JOIN hi ON hi."sampleId" = lo."sampleId" AND hi.tag = lo.tag""")
def backgrounds(spark, sf):
    return rounded(M.backgrounds(given_fits(histogram(Bed(spark, sf)))), "backgroundMean", "signalMean", "backgroundWeight")


@query("""SELECT sample AS "sampleId", tag, 'left out' AS reason FROM panel WHERE CAST(substr(tag, 7) AS INTEGER) % 5 = 0""")
def pairs_unfitted(spark, sf):
    return M.unfitted(given_fits(histogram(Bed(spark, sf))))


@query('SELECT count(*) > 0 AS "baselineEstablished" FROM panel WHERE CAST(substr(tag, 7) AS INTEGER) % 5 <> 0')
def baseline_established(spark, sf):
    return M.baseline_established(given_fits(histogram(Bed(spark, sf))))


@query('SELECT "sampleId", "cellId" FROM cells WHERE false')
def answers_without_baseline(spark, sf):
    """A run whose fits all failed keeps the header of an answer and none of its rows."""
    bed = Bed(spark, sf)
    fits = given_fits(histogram(bed)).withColumn("reason", F.lit("none"))
    return M.answers(bed.cells, M.baseline_established(fits).first()[0])


@query(f"""AND hist AS ({_HIST}) SELECT "sampleId", tag, CAST(floor(ln(1 + "umiCount") / 0.2) AS INTEGER) AS bin, CAST(sum(cells) AS BIGINT) AS weight FROM hist GROUP BY 1, 2, 3""")
def fitted_bins(spark, sf):
    """Bins over the population a fit is taken over, its zeros included."""
    return Q.hist_bins(histogram(Bed(spark, sf)))


_TALLY = """, pos AS (SELECT m."setId", o.identity, r."referenceCount" > 40 AS gated,
        CASE WHEN r."referenceCount" > 40 OR f.p IS NULL THEN 'unreliable' WHEN f.p >= 0.9 THEN 'bound' ELSE 'not bound' END AS state
        FROM linker m JOIN offered o ON o."sampleId" = m."sampleId" JOIN ref r ON r."sampleId" = m."sampleId" AND r."cellId" = m."cellId"
        LEFT JOIN full_p f ON f."sampleId" = m."sampleId" AND f."cellId" = m."cellId" AND f.identity = o.identity),
    t AS (SELECT "setId", identity, count(*) AS asked, count(*) FILTER (WHERE state = 'bound') AS b, count(*) FILTER (WHERE state = 'not bound') AS n, count(*) FILTER (WHERE gated) AS g FROM pos GROUP BY 1, 2)"""


@query(_GIVEN + _DENSE + _TALLY + """
    SELECT u."setId", u.identity, CASE WHEN t.asked IS NULL THEN 'never asked' WHEN b + n = 0 OR b = n THEN 'unreliable' WHEN b > n THEN 'bound' ELSE 'not bound' END AS state,
        coalesce(t.asked, 0) AS "cellsAsked", coalesce(b, 0) AS "cellsBound", coalesce(n, 0) AS "cellsNotBound",
        CASE WHEN t.asked IS NULL THEN 'never-offered' WHEN b + n = 0 THEN CASE WHEN g = t.asked THEN 'all-cells-gated' ELSE 'no-comparator' END WHEN b = n THEN 'tie' END AS "unreliableReason"
    FROM (SELECT DISTINCT m."setId", g.identity FROM linker m, (SELECT DISTINCT identity FROM grp) g) u LEFT JOIN t ON t."setId" = u."setId" AND t.identity = u.identity""")
def verdicts_on_fitted_background(spark, sf):
    """Verdicts under a fitted background: silent cells are compared where a tag of the identity fitted and the cell
    is in the population of the fit, and unreliable elsewhere."""
    bed = Bed(spark, sf)
    hist = stage(histogram(bed), "histogram")
    fits = given_fits(hist)
    curve = stage(M.score_curve(fits, hist, 12, bed.refs, bed.small), "curve")
    floored = joins.lookup(X.apply_floor(bed.counts, 12, bed.refs, bed.small), bed.refs, ["tag"], "left_anti", bed.small)
    found = M.identity_probabilities(bed.counts, bed.cell_list, curve, bed.grouping, 12, bed.refs, bed.small)
    gated = X.cells_over_limit(bed.counts, bed.refs, roles.GATE, bed.small)
    states = X.read_states_probability(X.combine_tags(floored, bed.grouping, bed.small), found, gated, rows=bed.counts.count())
    members = stage(S.with_admissibility(S.cells_by_set(bed.linker), gated, bed.cell_list), "members")
    served = M.comparable_identities(fits, bed.grouping).withColumn("comparable", F.lit(True))
    asked = bed.offered.join(served, ["sampleId", "identity"], "left").withColumn("comparable", F.coalesce("comparable", F.lit(False)))
    out = S.combine_cells(states, members, asked, bed.universe, small=bed.small)
    return out.select("setId", "identity", "state", "cellsAsked", "cellsBound", "cellsNotBound", "unreliableReason")


@query(_FIT + _curve(4) + _dense(4) + _TALLY + """,
    told_sets AS (SELECT u."setId", u.identity, CASE WHEN t.asked IS NULL THEN 'never asked' WHEN b + n = 0 OR b = n THEN 'unreliable' WHEN b > n THEN 'bound' ELSE 'not bound' END AS state,
        coalesce(t.asked, 0) AS "cellsAsked", coalesce(b + n, 0) AS "cellsAnswered", coalesce(b, 0) AS "cellsBound", coalesce(n, 0) AS "cellsNotBound", round(greatest(b, n) / nullif(b + n, 0), 6) AS agreement,
        CASE WHEN t.asked IS NULL THEN 'never-offered' WHEN b + n = 0 THEN CASE WHEN g = t.asked THEN 'all-cells-gated' ELSE 'no-comparator' END WHEN b = n THEN 'tie' END AS "unreliableReason"
    FROM (SELECT DISTINCT m."setId", g.identity FROM linker m, (SELECT DISTINCT identity FROM grp) g) u LEFT JOIN t ON t."setId" = u."setId" AND t.identity = u.identity),
    rivals AS (SELECT DISTINCT a.i AS a, b.i AS b FROM (""" + " UNION ALL ".join(f"SELECT {k} AS grp_no, unnest({list(g)}) AS i" for k, g in enumerate(roles.CONTENDING)) + """) a JOIN (""" + " UNION ALL ".join(f"SELECT {k} AS grp_no, unnest({list(g)}) AS i" for k, g in enumerate(roles.CONTENDING)) + """) b ON b.grp_no = a.grp_no AND b.i <> a.i),
    notes AS (SELECT x."setId", x.identity, string_agg(DISTINCT y.identity, ', ' ORDER BY y.identity) AS note FROM told_sets x JOIN rivals r ON r.a = x.identity
        JOIN told_sets y ON y."setId" = x."setId" AND y.identity = r.b AND y.state = 'bound' WHERE x.state = 'not bound' GROUP BY 1, 2)
    SELECT v.*, n.note AS "competedWith", CASE WHEN n.note IS NULL THEN 'false' ELSE 'true' END AS "wasCompeted" FROM told_sets v LEFT JOIN notes n ON n."setId" = v."setId" AND n.identity = v.identity""")
def verdicts_distribution_run(spark, sf):
    """The whole run on the fitted background: fits, probabilities, states and verdicts."""
    from .inputs import whole_run

    return rounded(whole_run(Bed(spark, sf), "distribution").verdicts, "agreement")
