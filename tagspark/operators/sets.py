"""From cell states to a verdict per (set, identity).

A cell that was asked and shows no row still votes. Its votes are counted and never written out: how many cells
of a set each sample holds, times what that sample was offered, less the rows that were observed. Every input
of a verdict is a sum, so the three sources meet in one aggregation by (set, identity), which combines before
the shuffle and takes a set of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import joins
from ..functions import terms as t
from ..sources.sinks import stage


def cells_by_set(linker: DataFrame) -> DataFrame:
    """(sampleId, cellId, setId), each cell once; a cell of two sets stops the job."""
    low, high = F.col("low"), F.col("high")
    clash = F.raise_error(F.concat(F.lit("cell "), "sampleId", F.lit("/"), "cellId", F.lit(" appears in sets "), low, F.lit(" and "), high))
    return (
        joins.dealt(linker, t.CELL, linker.count())
        .groupBy(*t.CELL)
        .agg(F.min("setId").alias("low"), F.max("setId").alias("high"))
        .select(*t.CELL, F.when(low == high, low).otherwise(clash.cast("string")).alias("setId"))
    )


def with_admissibility(members: DataFrame, gated: DataFrame, fit_universe: DataFrame | None = None) -> DataFrame:
    """Members with `gated` and `outside`: whether the cell was set aside, and whether it lies outside the cells a fit
    was taken over."""
    set_aside = gated.select(*t.CELL).distinct().withColumn("gated", F.lit(True))
    out = joins.shuffled_join(members, set_aside, t.CELL, "left").withColumn("gated", F.coalesce("gated", F.lit(False)))
    if fit_universe is None:
        return out.withColumn("outside", F.lit(False))
    inside = fit_universe.select(*t.CELL).distinct().withColumn("_in", F.lit(True))
    return joins.shuffled_join(out, inside, t.CELL, "left").withColumn("outside", F.col("_in").isNull()).drop("_in")


def asked_positions(members: DataFrame, offered: DataFrame, group: str, small: bool | None = None) -> DataFrame:
    """(group, identity) sums over (group, sample): cells asked, those that cannot be compared, those gated.

    `offered` may carry `comparable`, false where no background serves the (sample, identity); then every cell
    asked there is uncomparable.
    """
    comparable = F.col("comparable") if "comparable" in offered.columns else F.lit(True)
    cells = members.select(
        *dict.fromkeys([*t.CELL, group]),
        F.lit(1).alias("cells"),
        F.col("gated").cast("int").alias("gatedCells"),
        (F.col("gated") | F.col("outside")).cast("int").alias("blockedCells"),
    )
    keys, rows = list(dict.fromkeys([group, "sampleId"])), 0 if group == "sampleId" else members.count()
    per_sample = joins.added_up(cells, keys, ["cells", "gatedCells", "blockedCells"], [group], rows)
    return joins.lookup(per_sample, offered, ["sampleId"], "inner", small).select(
        group,
        "identity",
        F.col("cells").alias("asked"),
        F.when(comparable, F.col("blockedCells")).otherwise(F.col("cells")).alias("inadmissible"),
        F.col("gatedCells").alias("gatedAsked"),
    )


def observed_positions(states: DataFrame, members: DataFrame, offered: DataFrame, group: str, small: bool | None = None) -> DataFrame:
    """(group, cellId, identity, state, unreliableReason) of the rows that count: the cell is a member and its own sample
    offered the identity."""
    rows = states.select(*t.CELL, "identity", "state", "unreliableReason")
    members = joins.dealt(members.select(*dict.fromkeys([*t.CELL, group])), t.CELL, members.count())
    own = joins.lookup(rows, offered.select("sampleId", "identity"), ["sampleId", "identity"], "left_semi", small)
    return joins.shuffled_join(own, members, t.CELL).select(group, "cellId", "identity", "state", "unreliableReason")


SUMS = ["asked", "inadmissible", "gatedAsked", "observed", "observedInadmissible", "boundRows", "notBoundRows"]


def position_sums(states: DataFrame, members: DataFrame, offered: DataFrame, group: str, small: bool | None = None) -> DataFrame:
    """Every term of the tally per offered (group, identity), from one aggregation over asked and observed rows.

    `members` is read several times and should be a written table. Sums by set leave a set's rows in one task.
    """

    def shaped(df: DataFrame, cell: Column, **given: Column) -> DataFrame:
        return df.select(group, "identity", cell.alias("cellId"), *[given.get(c, F.lit(0)).cast("bigint").alias(c) for c in SUMS])

    one = F.lit(1)
    asked = asked_positions(members, offered, group, small)
    seen = observed_positions(states, members, offered, group, small)
    rows = shaped(asked, F.lit(None).cast("string"), asked=F.col("asked"), inadmissible=F.col("inadmissible"), gatedAsked=F.col("gatedAsked")).unionByName(
        shaped(
            seen,
            F.col("cellId"),
            observed=one,
            observedInadmissible=F.when(F.col("unreliableReason").isNotNull(), 1).otherwise(0),
            boundRows=F.when(F.col("state") == t.BOUND, 1).otherwise(0),
            notBoundRows=F.when(F.col("state") == t.NOT_BOUND, 1).otherwise(0),
        )
    )
    most = 0 if group == "sampleId" else members.count() * (offered.groupBy("sampleId").count().agg(F.max("count")).first()[0] or 0)
    return with_silent_terms(joins.added_up(rows, [group, "identity"], SUMS, [group], most), group)


def with_silent_terms(sums: DataFrame, group: str) -> DataFrame:
    """The sums with what the silent cells of each position vote."""
    silent_unreliable = F.col("inadmissible") - F.col("observedInadmissible")
    silent_not_bound = F.col("asked") - F.col("observed") - silent_unreliable
    wrong = F.raise_error(F.concat(F.lit("negative silent term at "), F.col(group), F.lit("/"), F.col("identity"), F.lit(": cells or states are not unique")))
    checked = (silent_unreliable >= 0) & (silent_not_bound >= 0)
    # on both terms, because a caller that reads only one of them would otherwise have the check pruned away
    return sums.withColumns(
        {
            "silentUnreliable": F.when(checked, silent_unreliable).otherwise(wrong.cast("bigint")),
            "silentNotBound": F.when(checked, silent_not_bound).otherwise(wrong.cast("bigint")),
        }
    )


def silent_tally(
    states: DataFrame, members: DataFrame, offered: DataFrame, group: str = "sampleId", small: bool | None = None
) -> DataFrame:
    """(group, identity, asked, observed, silentUnreliable, silentNotBound) for every offered position."""
    sums = position_sums(states, members, offered, group, small)
    return sums.select(group, "identity", "asked", "observed", "silentUnreliable", "silentNotBound")


SPINE_SLOTS = 64


def spine(keys: DataFrame, universe: list[str] | DataFrame, key: str) -> DataFrame:
    """(key, identity) over the whole universe, of a few keys: the patterns of what sets were offered.

    A universe given by name is unfolded from a constant. One too large for that is a frame (identity): the keys are
    repeated over slots and meet the identities of each slot by equality.
    """
    each = keys.select(key).distinct()
    if isinstance(universe, DataFrame):
        slot = F.pmod(F.xxhash64("identity"), F.lit(SPINE_SLOTS)).cast("int")
        slots = each.select(key, F.explode(F.sequence(F.lit(0), F.lit(SPINE_SLOTS - 1))).alias("slot"))
        return slots.join(universe.select("identity", slot.alias("slot")), "slot").select(key, "identity")
    identities = F.array(*[F.lit(i) for i in universe]) if universe else F.array().cast("array<string>")
    return each.select(key, F.explode(identities).alias("identity"))


def _named(values: Column) -> Column:
    """A short name for a list of texts."""
    return F.sha2(F.to_json(values), 256)


def offer_patterns(members: DataFrame, offered: DataFrame, universe: list[str] | DataFrame, small: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(setId, pattern) of every set, and (pattern, identity) of what a pattern's sets were never offered.

    Samples that offer the same identities are one panel, and a pattern is the panels of a set's samples: there are as
    many as there are ways to combine declarations, however many sets follow them.
    """
    lists = offered.select("sampleId", "identity").groupBy("sampleId").agg(F.array_sort(F.collect_set("identity")).alias("offers"))
    panels = stage(lists.select("sampleId", _named(F.col("offers")).alias("panel"), "offers"), "panels")
    cells = members.select("setId", *t.CELL, F.lit(1).alias("cells"))
    pairs = joins.added_up(cells, ["setId", "sampleId"], ["cells"], ["setId"], members.count()).select("setId", "sampleId")
    of_set = joins.lookup(pairs, panels.select("sampleId", "panel"), ["sampleId"], "left", small).groupBy("setId").agg(F.array_sort(F.collect_set("panel")).alias("panels"))
    sets = stage(of_set.select("setId", _named(F.col("panels")).alias("pattern"), "panels"), "set-patterns")
    patterns = sets.select("pattern", F.explode("panels").alias("panel")).distinct()
    known = panels.select("panel", "offers").dropDuplicates(["panel"])
    asked = patterns.join(known, "panel").select("pattern", F.explode("offers").alias("identity"))
    absent = spine(sets, universe, "pattern").join(asked, ["pattern", "identity"], "left_anti")
    return sets.select("setId", "pattern"), stage(absent, "never-offered")


def whole_verdicts(offered_verdicts: DataFrame, sets: DataFrame, absent: DataFrame) -> DataFrame:
    """A verdict for every identity of the universe: those of the offered positions, and *never asked* for the others.

    `sets` and `absent` are what `offer_patterns` gives. The added rows exist only in this view.
    """
    given = {
        "state": F.lit(t.NEVER_ASKED), "cellsAsked": F.lit(0), "cellsAnswered": F.lit(0), "cellsBound": F.lit(0), "cellsNotBound": F.lit(0),
        "unreliableReason": F.lit(t.NEVER_OFFERED), "wasCompeted": F.lit("false"), "setId": F.col("setId"), "identity": F.col("identity"),
    }
    rows = sets.join(absent, "pattern")
    types = dict(offered_verdicts.dtypes)
    added = rows.select(*[given.get(c, F.lit(None)).cast(types[c]).alias(c) for c in offered_verdicts.columns])
    return offered_verdicts.unionByName(added)


def combine_offered(
    states: DataFrame, members: DataFrame, offered: DataFrame, min_voters: int = t.MIN_VOTERS, min_agreement: float | None = None, small: bool | None = None
) -> DataFrame:
    """One row per (set, identity) that a cell of the set was asked: verdict, support counts and, where unsettled, the reason.

    `members` carries `gated` and `outside` (see `with_admissibility`).
    """
    sums = position_sums(states, members, offered, "setId", small)
    bound = F.col("boundRows")
    not_bound = F.col("notBoundRows") + F.col("silentNotBound")
    answered = bound + not_bound
    agreement = F.greatest(bound, not_bound) / answered
    below = (agreement < min_agreement) if min_agreement is not None else F.lit(False)
    nobody, few = answered == 0, answered < min_voters
    tied = bound == not_bound
    reason = (
        F.when(nobody, F.when(F.col("gatedAsked") == F.col("asked"), t.ALL_CELLS_GATED).otherwise(t.SET_NO_COMPARATOR))
        .when(few, t.TOO_FEW_VOTERS)
        .when(tied, t.TIE)
        .when(below, t.BELOW_AGREEMENT)
    )
    state = F.when(nobody | few | tied | below, t.UNRELIABLE).when(bound > not_bound, t.BOUND).otherwise(t.NOT_BOUND)
    return sums.select(
        "setId",
        "identity",
        state.alias("state"),
        F.col("asked").alias("cellsAsked"),
        answered.alias("cellsAnswered"),
        bound.alias("cellsBound"),
        not_bound.alias("cellsNotBound"),
        F.when(nobody | few, F.lit(None).cast("double")).otherwise(agreement).alias("agreement"),
        reason.alias("unreliableReason"),
    )


def combine_cells(
    states: DataFrame,
    members: DataFrame,
    offered: DataFrame,
    universe: list[str] | DataFrame,
    min_voters: int = t.MIN_VOTERS,
    min_agreement: float | None = None,
    small: bool | None = None,
) -> DataFrame:
    """`combine_offered` with a row for every identity of the universe."""
    sets, absent = offer_patterns(members, offered, universe, small)
    return whole_verdicts(combine_offered(states, members, offered, min_voters, min_agreement, small), sets, absent)


def competitor_notes(verdicts: DataFrame, contending: list[list[str]], rows: int = 0) -> DataFrame:
    """Names the bound rivals beside a not-bound verdict. The state stays; an identity may sit in several groups.

    `rows` is how many verdicts there are at most, to deal them by set; without it they stay in the tasks they are in.
    """
    rivals: dict[str, set] = {}
    for group in contending:
        for member in group:
            rivals.setdefault(member, set()).update(set(group) - {member})
    if not rivals:
        return verdicts.withColumn("competedWith", F.lit(None).cast("string")).withColumn("wasCompeted", F.lit("false"))
    entries = [x for k in sorted(rivals) for x in (F.lit(k), F.array(*[F.lit(v) for v in sorted(rivals[k])]))]
    bound_here = F.collect_set(F.when(F.col("state") == t.BOUND, F.col("identity"))).over(Window.partitionBy("setId"))
    met = F.array_sort(F.array_intersect(F.create_map(*entries)[F.col("identity")], bound_here))
    note = F.when((F.col("state") == t.NOT_BOUND) & (F.size(met) > 0), F.array_join(met, ", "))
    return joins.dealt(verdicts, ["setId"], rows).withColumn("competedWith", note).withColumn(
        "wasCompeted", F.when(F.col("competedWith").isNotNull(), "true").otherwise("false")
    )


def set_counts(verdicts: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Per set, in identities: bound, offered, settled, unsettled. `sets` adds those without an offered identity."""
    state = F.col("state")
    out = verdicts.groupBy("setId").agg(
        F.count_if(state == t.BOUND).alias("boundCount"),
        F.count_if(state != t.NEVER_ASKED).alias("offeredCount"),
        F.count_if(state.isin(t.SETTLED)).alias("settledCount"),
        F.count_if(state == t.UNRELIABLE).alias("unsettledCount"),
    )
    return out if sets is None else joins.shuffled_join(sets.select("setId"), out, ["setId"], "left").na.fill(0)


def set_cell_counts(members: DataFrame, floored: DataFrame) -> DataFrame:
    """(setId, cellCount, cellsSetAside, cellsReadingNothing), zeros kept. `members` carries `gated`."""
    reading = floored.groupBy(*t.CELL).agg(F.max("umiCount").alias("top"))
    return (
        members.join(reading, t.CELL, "left")
        .groupBy("setId")
        .agg(
            F.count(F.lit(1)).alias("cellCount"),
            F.count_if("gated").alias("cellsSetAside"),
            F.count_if(F.coalesce("top", F.lit(0)) <= 0).alias("cellsReadingNothing"),
        )
    )


def set_aside_by_set(cells: DataFrame) -> DataFrame:
    """(setId, cellsSetAside) of the sets that lost a cell."""
    return cells.filter(F.col("cellsSetAside") > 0).select("setId", "cellsSetAside")


def self_disagreement(
    tag_states: DataFrame,
    members: DataFrame,
    offered_tags: DataFrame,
    universe: DataFrame,
    scope: DataFrame | None = None,
    small: bool | None = None,
) -> DataFrame:
    """How often a tag's cells contradict the rest of their own set, pooled over sets with two or more evaluable cells.

    `tag_states` and `offered_tags` are at tag grain, the tag under `identity`. With `scope`, a frame
    (sampleId, tag, scopeId), a set counts only its cells of the samples of one scope and the result is per
    (scopeId, tag). The rate is null where nothing could be compared.

    A set that shows no row of a tag agrees with itself: it only adds its admissible cells, which depend on the tag
    through the samples that offer it. These sums are taken over the distinct ways in which sets lie in samples, and
    the (set, tag) pairs that show a row are put right one by one. Sets x tags rows never exist.
    """
    offered = offered_tags.select("sampleId", F.col("tag").alias("identity"))
    parts = None
    if scope is not None:
        # a tag has one scope in a sample, so the scope rides on the identity
        marked = scope.select("sampleId", F.col("tag").alias("identity"), F.to_json(F.array("scopeId", "tag")).alias("_key"))
        tag_states = joins.lookup(tag_states, marked, ["sampleId", "identity"], "inner", small).drop("identity").withColumnRenamed("_key", "identity")
        offered = offered.join(marked, ["sampleId", "identity"]).select("sampleId", F.col("_key").alias("identity"))
        parts = F.from_json("identity", "array<string>")
    in_samples = members.groupBy("setId", "sampleId").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("gated") | F.col("outside")).alias("blocked"))
    in_samples = stage(in_samples, "set-samples")
    patterns = offered.groupBy("identity").agg(F.array_sort(F.collect_set("sampleId")).alias("samples"))
    patterns = stage(patterns.withColumn("pattern", _named(F.col("samples"))), "patterns")
    silent = unanimous(in_samples, patterns)
    observed = stage(_observed_sums(tag_states, members, offered, small), "observed")
    asked = joins.lookup(observed.select("setId", "identity").join(in_samples, "setId"), offered, ["sampleId", "identity"], "left_semi", small)
    asked = asked.groupBy("setId", "identity").agg(F.sum("cells").alias("asked"), F.sum("blocked").alias("inadmissible"))
    sums = with_silent_terms(observed.join(asked, ["setId", "identity"]), "setId")
    bound, not_bound = F.col("boundRows"), F.col("notBoundRows") + F.col("silentNotBound")
    counted = lambda n: F.when(n >= 2, n).otherwise(0)
    put_right = sums.groupBy("identity").agg(
        F.sum(counted(bound + not_bound) - counted(F.col("asked") - F.col("inadmissible"))).alias("more"),
        F.sum(F.when(bound + not_bound >= 2, F.least(bound, not_bound))).alias("minority"),
    )
    per_tag = patterns.select("identity", "pattern").join(silent, "pattern", "left").join(put_right, "identity", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per_tag = per_tag.select("identity", (zero("unanimous") + zero("more")).alias("cellsCompared"), zero("minority").alias("minorityCells"))
    keys = {"scopeId": F.lit("") if parts is None else parts[0], "tag": F.col("identity") if parts is None else parts[1]}
    per_tag = per_tag.select(*[c.alias(k) for k, c in keys.items()], "cellsCompared", "minorityCells")
    spread = universe if scope is not None else universe.withColumn("scopeId", F.lit(""))
    out = spread.join(per_tag, ["scopeId", "tag"], "left").select(
        "scopeId",
        "tag",
        F.coalesce("cellsCompared", F.lit(0)).cast("bigint").alias("cellsCompared"),
        F.coalesce("minorityCells", F.lit(0)).cast("bigint").alias("minorityCells"),
    )
    rate = F.when(F.col("cellsCompared") > 0, F.col("minorityCells") / F.col("cellsCompared"))
    out = out.withColumn("disagreementRate", rate)
    return out if scope is not None else out.drop("scopeId")


def unanimous(in_samples: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, unanimous): over the sets with two or more admissible cells in a pattern's samples, those cells.

    Sets with as many admissible cells in the same samples are counted before they meet the patterns.
    """
    held = in_samples.select("setId", F.struct("sampleId", (F.col("cells") - F.col("blocked")).alias("n")).alias("part")).filter("part.n > 0")
    alike = held.groupBy("setId").agg(F.array_sort(F.collect_list("part")).alias("parts")).groupBy("parts").agg(F.count(F.lit(1)).alias("sets"))
    alike = stage(alike.select(_named(F.col("parts")).alias("kind"), "sets", "parts"), "kinds")
    rows = alike.select("kind", "sets", F.explode("parts").alias("part")).select("kind", "sets", "part.*")
    where = patterns.select("pattern", "samples").distinct().select("pattern", F.explode("samples").alias("sampleId"))
    met = joins.lookup(rows, where, ["sampleId"], "inner").groupBy("kind", "pattern").agg(F.sum("n").alias("n"), F.max("sets").alias("sets"))
    return met.filter("n >= 2").groupBy("pattern").agg(F.sum(F.col("n") * F.col("sets")).alias("unanimous"))


def _observed_sums(states: DataFrame, members: DataFrame, offered: DataFrame, small: bool | None) -> DataFrame:
    """(setId, identity) of the positions that show a row, with the votes of those rows."""
    seen = observed_positions(states, members, offered, "setId", small)
    return seen.groupBy("setId", "identity").agg(
        F.count(F.lit(1)).alias("observed"),
        F.count_if(F.col("unreliableReason").isNotNull()).alias("observedInadmissible"),
        F.count_if(F.col("state") == t.BOUND).alias("boundRows"),
        F.count_if(F.col("state") == t.NOT_BOUND).alias("notBoundRows"),
    )


def set_tag_median(counts: DataFrame, members: DataFrame, offered_tags: DataFrame, small: bool | None = None) -> DataFrame:
    """(setId, tag, medianUmiCount): the raw median over the set's cells of offering samples, silent cells as 0.

    Only where at least half of those cells hold a row. Silent cells enter as one zero with their number as
    weight, and equal counts are merged first, so a set of any size arrives as a histogram.
    """
    cells = members.select(*t.CELL, "setId")
    pairs = offered_tags.select("sampleId", "tag")
    own = joins.lookup(counts.select(*t.CELL, "tag", "umiCount"), pairs, ["sampleId", "tag"], "left_semi", small)
    met = joins.shuffled_join(own, joins.dealt(cells, t.CELL, members.count()), t.CELL)
    shown = met.select("setId", "tag", F.col("umiCount").alias("v"), "cellId", F.lit(1).alias("w"))
    hist = stage(joins.added_up(shown, ["setId", "tag", "v"], ["w"], ["setId", "tag"], counts.count()), "histogram")
    per_sample = cells.groupBy("setId", "sampleId").agg(F.count(F.lit(1)).alias("cells"))
    # only a tag that some cell of the set shows can have half of them: the others need no population
    shown = hist.select("setId", "tag").distinct().join(per_sample, "setId")
    population = joins.lookup(shown, pairs, ["sampleId", "tag"], "left_semi", small).select(
        "setId", "tag", F.lit(0).cast("bigint").alias("v"), F.lit(0).cast("bigint").alias("w"), F.col("cells").alias("n")
    )
    # the zero row's weight is the population less the rows, known only once both are in the group
    both = hist.withColumn("n", F.lit(0).cast("bigint")).unionByName(population)
    values = joins.added_up(both, ["setId", "tag", "v"], ["w", "n"], ["setId", "tag"], 2 * hist.count())
    group = Window.partitionBy("setId", "tag")
    weighted = (
        values.withColumn("nz", F.sum("w").over(group))
        .withColumn("n", F.sum("n").over(group))
        .withColumn("w", F.when(F.col("v") == 0, F.col("w") + F.col("n") - F.col("nz")).otherwise(F.col("w")))
        .filter((F.col("nz") > 0) & (F.col("nz") * 2 >= F.col("n")))
    )
    with_zero = weighted.filter("w > 0")
    return with_zero.groupBy("setId", "tag").agg(F.percentile("v", 0.5, F.col("w")).alias("medianUmiCount"))


def set_tag_median_table(medians: DataFrame, tags: list[str]) -> DataFrame:
    """Wide form, a column per panel tag; past the width limit an error, since the long form has every row."""
    if len(tags) > t.TAG_MEDIAN_LIMIT:
        raise ValueError(f"over {t.TAG_MEDIAN_LIMIT} columns: use the long form")
    if not tags:
        return medians.select("setId").filter(F.lit(False))
    return medians.groupBy("setId").pivot("tag", sorted(tags)).agg(F.first("medianUmiCount"))


def identity_summary(verdicts: DataFrame, universe: list[str], sets: DataFrame | None = None, absent: str = t.NEVER_ASKED) -> DataFrame:
    """One row per set, a state column per identity; past the width limit an error, since the long form has every row.

    With `sets`, the verdicts may be those of offered positions alone: the others read `absent`.
    """
    if len(universe) > t.IDENTITY_PIVOT_LIMIT:
        raise ValueError(f"over {t.IDENTITY_PIVOT_LIMIT} columns: use the long form")
    if not universe:
        return (verdicts if sets is None else sets).select("setId").distinct()
    wide = verdicts.groupBy("setId").pivot("identity", sorted(universe)).agg(F.first("state"))
    if sets is None:
        return wide
    filled = [F.coalesce(F.col(f"`{c}`"), F.lit(absent)).alias(c) for c in sorted(universe)]
    return joins.shuffled_join(sets.select("setId"), wide, ["setId"], "left").select("setId", *filled)


PUNCH_FIELDS = ["state", "cellsAnswered", "cellsAsked", "agreement", "unreliableReason", "cellsBound"]


def punch_column() -> Column:
    """`state|answered|asked|agreement|reason|bound`, an absent part left empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PUNCH_FIELDS])


NEVER_PUNCHED = f"{t.NEVER_ASKED}|0|0||{t.NEVER_OFFERED}|0"


def identity_punch(verdicts: DataFrame, universe: list[str], sets: DataFrame | None = None) -> DataFrame:
    """One row per set, everything a reader needs of each identity in one value."""
    return identity_summary(verdicts.withColumn("state", punch_column()), universe, sets, NEVER_PUNCHED)


def decode_punch(punches: DataFrame, column: str = "punch") -> DataFrame:
    """The parts of a punch value; five parts are read as well, anything else is `unparsed`."""
    parts = F.split(F.col(column), r"\|")
    number = {i: F.expr(f"try_cast(get(split(`{column}`, '[|]'), {i}) as double)") for i in (1, 2, 3, 5)}
    ok = F.size(parts).isin(5, 6) & F.get(parts, F.lit(0)).isin(*t.SETTLED, t.UNRELIABLE, t.NEVER_ASKED)
    ok = F.coalesce(ok & number[1].isNotNull() & number[2].isNotNull(), F.lit(False))
    reason = F.get(parts, F.lit(4))
    return punches.select(
        *[c for c in punches.columns if c != column],
        F.when(ok, "read").otherwise("unparsed").alias("kind"),
        F.when(ok, F.get(parts, F.lit(0))).alias("state"),
        F.when(ok, number[1]).alias("answered"),
        F.when(ok, number[2]).alias("asked"),
        F.when(ok, number[3]).alias("agreement"),
        F.when(ok & (reason != ""), reason).alias("reason"),
        F.when(ok, number[5]).alias("bound"),
    )


def cell_card(states: DataFrame, members: DataFrame, offered: DataFrame, small: bool | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The card of every member cell without a row for what it was silent on.

    (sampleId, cellId, identity, cellState, reason) of the observed positions, (sampleId, cellId, setId, reason) of the cells
    with what sets a whole cell aside, and (sampleId, identity, comparable) of what samples were offered. `read_card` gives
    every position from these three.
    """
    rows = joins.lookup(states, offered.select("sampleId", "identity"), ["sampleId", "identity"], "left_semi", small)
    rows = rows.join(members.select(*t.CELL), t.CELL, "left_semi").select(*t.CELL, "identity", F.col("state").alias("cellState"), F.col("unreliableReason").alias("reason"))
    cells = members.select(*t.CELL, "setId", F.when(F.col("gated"), t.GATED).when(F.col("outside"), t.NO_COMPARATOR).alias("reason"))
    comparable = F.col("comparable") if "comparable" in offered.columns else F.lit(True)
    return rows, cells, offered.select("sampleId", "identity", comparable.alias("comparable"))


def read_card(rows: DataFrame, cells: DataFrame, asked: DataFrame, small: bool | None = None) -> DataFrame:
    """(sampleId, cellId, setId, identity, cellState, reason): each member cell at each identity its sample was offered.

    Has a row per silent position, so it is for the cells or sets that a reader asks for.
    """
    grid = joins.lookup(cells.withColumnRenamed("reason", "cellReason"), asked, ["sampleId"], "inner", small)
    grid = grid.withColumn("cellReason", F.coalesce("cellReason", F.when(~F.col("comparable"), t.NO_COMPARATOR)))
    most = cells.count() * (asked.groupBy("sampleId").count().agg(F.max("count")).first()[0] or 0)
    grid = joins.dealt(grid, [*t.CELL, "identity"], most)
    return joins.shuffled_join(grid, rows, [*t.CELL, "identity"], "left").select(
        *t.CELL,
        "setId",
        "identity",
        F.coalesce("cellState", F.when(F.col("cellReason").isNotNull(), t.UNRELIABLE).otherwise(t.NOT_BOUND)).alias("cellState"),
        F.coalesce("reason", "cellReason").alias("reason"),
    )


def cell_punch_long(states: DataFrame, members: DataFrame, offered: DataFrame, small: bool | None = None) -> DataFrame:
    """`read_card` of what `cell_card` keeps."""
    return read_card(*cell_card(states, members, offered, small), small)


def cell_punch(long: DataFrame, universe: list[str]) -> DataFrame:
    """Wide form of `cell_punch_long`: `state|reason` per identity and how many identities the cell bound."""
    value = F.concat_ws("|", "cellState", F.coalesce("reason", F.lit("")))
    columns = sorted(universe)
    wide = long.withColumn("punch", value).groupBy(*t.CELL, "setId").pivot("identity", columns).agg(F.first("punch"))
    bound = F.filter(F.array(*[F.col(f"`{c}`") for c in columns]), lambda v: v.startswith(f"{t.BOUND}|"))
    return wide.select(*t.CELL, "setId", F.size(bound).cast("bigint").alias("boundIdentities"), *[F.col(f"`{c}`") for c in columns])
