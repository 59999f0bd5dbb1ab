"""From paired reads to molecules per cell and tag.

Reads are cut to their tags by fixed positions and at once counted per distinct (sample, cell, molecule, tag):
everything after works on that table, whose size is set by the molecules and not by the sequencing depth.
Sequences are corrected on their distinct values, by looking for one-substitution neighbours through equality.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import joins
from ..sources.sinks import stage

# fixed values: the layout of a read pair and the names of its parts
LAYOUT = r"\^\(CELL:N\{(\d+)\}\)\(UMI:N\{(\d+)\}\)(\*?)\\\^(?:N\{(\d+)\})?\(FEATURE:N\{(\d+)\}\)\(R2:\*\)"
TAGS = ("CELL", "UMI", "FEATURE")
BASES = "ACGT"
MOLECULE = ["sampleId", "CELL", "UMI", "FEATURE"]
# letters of a code's parts, of which codes one substitution apart differ in one; slots in which groups of codes are counted
PART = 8
SLOTS = 4096


@dataclass(frozen=True)
class Geometry:
    cell: int = 16
    umi: int = 10
    feature: int = 15
    offset: int = 0
    open_r1: bool = True

    def pattern(self) -> str:
        skip = f"N{{{self.offset}}}" if self.offset else ""
        tail = "*" if self.open_r1 else ""
        return f"^(CELL:N{{{self.cell}}})(UMI:N{{{self.umi}}}){tail}\\^{skip}(FEATURE:N{{{self.feature}}})(R2:*)"


def missing_tags(pattern: str) -> list[str]:
    """Parts a pattern must define and does not."""
    return [tag for tag in (*TAGS, "R2") if f"({tag}:" not in pattern]


def parse_geometry(pattern: str) -> Geometry:
    """The fixed lengths of a read pattern; any other pattern is refused."""
    missing = missing_tags(pattern)
    if missing:
        raise ValueError(f"the pattern must define {', '.join(missing)}")
    found = re.fullmatch(LAYOUT, pattern.strip())
    if found is None:
        raise ValueError(f"only fixed-length layouts can be read; got {pattern!r}")
    cell, umi, star, skip, feature = found.groups()
    return Geometry(int(cell), int(umi), int(feature), int(skip or 0), star == "*")


def extract_tags(reads: DataFrame, geometry: Geometry) -> DataFrame:
    """Reads with CELL, UMI, FEATURE and `matched`; the tags are null on a read that does not fit the layout."""
    g = geometry
    long_enough = F.length("r1") >= g.cell + g.umi if g.open_r1 else F.length("r1") == g.cell + g.umi
    matched = F.coalesce(long_enough & (F.length("r2") >= g.offset + g.feature), F.lit(False))
    rest = [c for c in reads.columns if c not in ("r1", "r2")]
    return reads.select(
        *rest,
        matched.alias("matched"),
        F.when(matched, F.substring("r1", 1, g.cell)).alias("CELL"),
        F.when(matched, F.substring("r1", g.cell + 1, g.umi)).alias("UMI"),
        F.when(matched, F.substring("r2", g.offset + 1, g.feature)).alias("FEATURE"),
    )


def preview_reads(reads: DataFrame, n: int) -> DataFrame:
    """The first `n` reads of each sample."""
    if n < 1:
        raise ValueError("a preview needs a read limit of at least 1")
    return joins.top_per_group(reads, ["sampleId"], [F.col("read_id")], n)


def parse_report(tagged: DataFrame) -> DataFrame:
    """(sampleId, total, matched)."""
    return tagged.groupBy("sampleId").agg(F.count(F.lit(1)).alias("total"), F.count_if("matched").alias("matched"))


def gate_samples(report: DataFrame) -> DataFrame:
    """(sampleId, total, matched, shouldContinue): a sample without a matched read goes no further."""
    return report.withColumn("shouldContinue", F.col("matched") > 0)


def molecules(tagged: DataFrame) -> DataFrame:
    """Matched reads counted per distinct (sample, cell, molecule, tag): the table every later step works on."""
    weight = F.sum("weight") if "weight" in tagged.columns else F.count(F.lit(1))
    return (
        tagged.filter("matched")
        .groupBy(*MOLECULE)
        .agg(F.count(F.lit(1)).alias("reads"), weight.cast("bigint").alias("weight"))
    )


def _unique_hit(hits: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Keys with exactly one nearest target. Several targets at the least distance leave the key unplaced."""
    return (
        hits.groupBy(*keys, "distance")
        .agg(F.min(target).alias("low"), F.max(target).alias("high"))
        .groupBy(*keys)
        .agg(F.min_by(F.struct("low", "high"), "distance").alias("nearest"))
        .filter("nearest.low = nearest.high")
        .select(*keys, F.col("nearest.low").alias(target))
    )


def _masks(code: Column, distance: int) -> Column:
    """The code with every choice of `distance` positions blanked out."""
    masked = F.array(F.struct(code.alias("m"), F.lit(0).alias("at")))
    for _ in range(distance):
        masked = F.flatten(F.transform(masked, lambda s: F.transform(
            F.filter(F.sequence(F.lit(1), F.length(s["m"])), lambda i: i > s["at"]),
            lambda i: F.struct(F.overlay(s["m"], F.lit("*"), i, F.lit(1)).alias("m"), i.alias("at")),
        )))
    return F.transform(masked, lambda s: s["m"])


def _deletions(code: Column, count: int) -> Column:
    """What is left of the code after taking out any `count` of its letters, each form once."""
    left = F.array(F.struct(code.alias("m"), F.lit(1).alias("at")))
    for _ in range(count):
        left = F.flatten(F.transform(left, lambda s: F.transform(
            F.filter(F.sequence(F.lit(0), F.length(s["m"])), lambda i: i >= s["at"]),
            lambda i: F.struct(F.overlay(s["m"], F.lit(""), i, F.lit(1)).alias("m"), i.alias("at")),
        )))
    return F.array_distinct(F.transform(left, lambda s: s["m"]))


def _differing(a: Column, b: Column) -> Column:
    """Places at which two codes of one length differ."""
    return F.size(F.filter(F.sequence(F.lit(0), F.length(a)), lambda i: (i > 0) & (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))))


def _errors(subs: int, indels: int, most: int) -> list[tuple[int, int, int]]:
    """The (substitutions, insertions, deletions) that the limits allow, but for none at all."""
    counts = [(s, i, j) for s in range(subs + 1) for i in range(indels + 1) for j in range(indels + 1 - i)]
    return [c for c in counts if 0 < sum(c) <= most]


def limited_distance(a: Column, b: Column, max_subs: int, max_indels: int, max_errors: int) -> Column:
    """The least number of errors that turn `a` into `b` within the limits on each kind; null where they can't.

    The banded edit distance decides where it is so small that any mix of errors is allowed. Only above that the mix
    counts: with so many letters taken out of either code, how many of the rest differ.
    """
    total = F.levenshtein(a, b, max_errors)
    costs = []
    for i in range(max_indels + 1):
        for j in range(max_indels + 1 - i):
            least = F.array_min(F.flatten(F.transform(_deletions(a, j), lambda x: F.transform(_deletions(b, i), lambda y: _differing(x, y)))))
            subs = F.when(F.length(b) - F.length(a) == i - j, least)
            costs.append(F.when(subs <= min(max_subs, max_errors - i - j), subs + i + j))
    mixed = F.least(*costs) if len(costs) > 1 else costs[0]
    return F.when(total < 0, F.lit(None)).when(total <= min(max_subs, max_indels), total).otherwise(mixed)


def _substituted_hits(odd: DataFrame, panel: DataFrame, max_subs: int, small: bool | None) -> DataFrame:
    found = None
    for d in range(1, max_subs + 1):
        left = odd.select("sampleId", "FEATURE", F.explode(_masks(F.col("FEATURE"), d)).alias("mask"))
        right = panel.select("sampleId", F.col("tag").alias("corrected"), F.explode(_masks(F.col("tag"), d)).alias("mask"))
        near = joins.lookup(left, right, ["sampleId", "mask"], "inner", small)
        near = near.select("sampleId", "FEATURE", "corrected", F.lit(d).alias("distance"))
        found = near if found is None else found.unionByName(near)
    return found


def _edited_hits(odd: DataFrame, panel: DataFrame, max_subs: int, max_indels: int, max_errors: int, small: bool | None) -> DataFrame:
    """Pairs within the limits, by a deletion neighbourhood: taking the letters that s substitutions, i insertions and j
    deletions touch out of both codes (s + j of one, s + i of the other) leaves the same letters."""
    errors = _errors(max_subs, max_indels, max_errors)
    ways = sorted({(s + j, s + i) for s, i, j in errors})

    def index(code: Column, sizes: list[int]) -> Column:
        form = lambda n: lambda m: F.struct(m.alias("left"), F.lit(n).alias("out"))
        return F.explode(F.concat(*[F.transform(_deletions(code, n), form(n)) for n in sizes]))

    own, other = (sorted({w[k] for w in ways}) for k in (0, 1))
    left = odd.select("sampleId", "FEATURE", index(F.col("FEATURE"), own).alias("v")).select("sampleId", "FEATURE", F.col("v.left").alias("left"), F.col("v.out").alias("a"))
    right = panel.select("sampleId", F.col("tag").alias("corrected"), index(F.col("tag"), other).alias("v"))
    right = right.select("sampleId", F.col("v.left").alias("left"), "corrected", F.col("v.out").alias("b"))
    met = joins.lookup(left, right, ["sampleId", "left"], "inner", joins.fits(right) if small is None or small else small)
    pairs = met.filter((F.col("a") * 64 + F.col("b")).isin([a * 64 + b for a, b in ways])).select("sampleId", "FEATURE", "corrected").distinct()
    near = pairs.withColumn("distance", limited_distance(F.col("FEATURE"), F.col("corrected"), max_subs, max_indels, max_errors))
    return near.filter("distance is not null")


def feature_corrections(
    seen: DataFrame, panel: DataFrame, max_subs: int = 1, small: bool | None = None, max_indels: int = 0, max_errors: int | None = None
) -> DataFrame:
    """(sampleId, FEATURE, corrected) for the sequences seen in a sample that its panel does not hold.

    `panel` is (sampleId, tag). A sequence moves to the one panel barcode with the fewest errors, of at most `max_subs`
    substitutions, `max_indels` letters put in or left out, and `max_errors` of both; a tie leaves it unplaced.
    Candidates come from an equality, so no read is compared with the whole panel: of codes with d positions blanked
    where only substitutions count, else of codes with letters taken out. A sample's barcodes decide how many forms the
    panel side has (576 at most for one of 15 letters and three errors); it is broadcast only if they were counted.
    """
    if max_indels < 0 or max_subs < 0 or max_subs + max_indels < 1:
        raise ValueError("max_subs or max_indels must be at least 1, and neither below 0")
    tags = panel.select("sampleId", F.col("tag").alias("FEATURE"))
    odd = joins.lookup(seen.select("sampleId", "FEATURE").distinct(), tags, ["sampleId", "FEATURE"], "left_anti", small)
    most = max_subs + max_indels if max_errors is None else max_errors
    if most < 1:
        raise ValueError("max_errors must be at least 1")
    if max_indels:
        found = _edited_hits(odd, panel, max_subs, max_indels, most, small)
    else:
        found = _substituted_hits(odd, panel, min(max_subs, most), small)
    return _unique_hit(found, ["sampleId", "FEATURE"], "corrected")


def correct_to_panel(
    mols: DataFrame, panel: DataFrame, max_subs: int = 1, small: bool | None = None, max_indels: int = 0, max_errors: int | None = None
) -> DataFrame:
    """Molecules with FEATURE snapped onto the sample's panel; those that cannot be placed are dropped."""
    tags = panel.select("sampleId", F.col("tag").alias("FEATURE"), F.lit(True).alias("_held"))
    marked = joins.lookup(mols, tags, ["sampleId", "FEATURE"], "left", small)
    moves = feature_corrections(mols, panel, max_subs, small, max_indels, max_errors)
    kept = marked.filter("_held").drop("_held")
    strays = marked.filter("_held is null").drop("_held")
    # a stray sequence may hold a large share of the reads, so its rows are spread before they meet their correction
    placed = joins.salted_join(strays, moves, ["sampleId", "FEATURE"], "inner").drop("FEATURE").withColumnRenamed("corrected", "FEATURE")
    return merge_molecules(kept.unionByName(placed))


def whitelist_corrections(cells: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(CELL, corrected) for barcodes off the list that have exactly one listed neighbour one substitution away."""
    return _off_list(cells, whitelist).filter("corrected is not null")


def _off_list(cells: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(CELL, corrected) for every barcode off the list; `corrected` is null where it has no listed neighbour or several.

    Barcodes and list meet by what they share outside of one part, and are spelled with a letter blanked only there.
    """
    listed = whitelist.select("CELL").distinct()
    off = joins.shuffled_join(cells.select("CELL").filter("CELL is not null").distinct(), listed, ["CELL"], "left_anti")
    off = stage(off, "off-list")
    both = listed.select("CELL", F.lit(True).alias("known")).unionByName(off.select("CELL", F.lit(False).alias("known")))
    key = Window.partitionBy("key")
    parted = _parted(both, [], "CELL", whitelist.count() + off.count())
    met = parted.withColumn("met", F.min("known").over(key) != F.max("known").over(key)).filter("met")
    # a letter that no barcode is corrected to makes a listed code no neighbour
    end = F.when(F.col("known") & F.col("m.letter").isin(*BASES), F.col("CELL"))
    groups = (
        met.select("key", "known", "CELL", F.explode(_part_masks("CELL")).alias("m"))
        .groupBy("key", F.col("m.mask").alias("mask"))
        .agg(F.min(end).alias("low"), F.max(end).alias("high"), F.collect_list(F.when(~F.col("known"), F.col("CELL"))).alias("off"))
    )
    hits = groups.filter("low is not null").select(F.explode("off").alias("CELL"), "low", "high")
    found = hits.groupBy("CELL").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low = high")
    return joins.shuffled_join(off, found.select("CELL", F.col("low").alias("corrected")), ["CELL"], "left")


def correct_to_whitelist(mols: DataFrame, whitelist: DataFrame | None) -> DataFrame:
    """Molecules with CELL snapped onto a supplied list; no list leaves them as they are.

    The list grows with the cells: it is shuffled, never sent through the driver, and no copy of it is made.
    """
    if whitelist is None:
        return mols
    off = stage(_off_list(mols, whitelist).withColumn("off", F.lit(True)), "moves")
    placed = joins.sparse_join(mols.filter("CELL is not null"), off, ["CELL"]).filter("off is null or corrected is not null")
    return merge_molecules(placed.withColumn("CELL", F.coalesce("corrected", "CELL")))


def _part(code: Column, part: Column) -> tuple[Column, Column, Column]:
    """How many parts a code is cut into, each of at most PART letters, and the first and last place of one of them."""
    size = F.length(code)
    parts = F.greatest(F.lit(1), F.ceil(size / F.lit(PART)).cast("int"))
    edge = lambda p: F.floor(p * size / parts).cast("int")
    return parts, edge(part) + 1, edge(part + 1)


def _part_masks(column: str) -> Column:
    """The code with each letter of its `part` blanked in turn, and the letter."""
    code = F.col(column)
    _, first, last = _part(code, F.col("part"))
    masked = lambda i: F.struct(F.overlay(code, F.lit("*"), i, F.lit(1)).alias("mask"), F.substring(code, i, F.lit(1)).alias("letter"))
    return F.transform(F.sequence(first, F.greatest(first, last)), masked)


def _parted(codes: DataFrame, within: list[str], column: str, rows: int) -> DataFrame:
    """Codes once for each of their parts, dealt by `within` and by `key`, the code with that part blanked out.

    Codes one substitution apart meet under the key of the part in which they differ. Whatever the data, a key holds no
    more codes than can be spelled with PART letters, so what follows by key needs no further shuffle and has no hot task.
    """
    code, number = F.col(column), F.col("part")
    parts, first, last = _part(code, number)
    cut = codes.filter(code.isNotNull()).select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    blank = F.greatest(F.lit(1), last - first + 1)
    cut = cut.withColumn("key", F.overlay(code, F.repeat(F.lit("*"), blank), first, last - first + 1))
    return _dealt(cut, [*within, "key"], 2 * rows)


def _dealt(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """`joins.dealt`, and dealt by the keys where it leaves small tables to Spark."""
    many = joins.dealt(df, by, rows)
    return df.repartition(*by) if many is df else many


def _strongest(groups: DataFrame, within: list[str], column: str, ratio: float) -> DataFrame:
    """(within.., column, corrected) from codes that share a blanked form: `members` in falling order of their reads."""
    strongest = F.col("members")[0]
    # the strongest of a group serves all others; it has itself no stronger neighbour there
    return (
        groups.select(*within, strongest.alias("best"), F.explode(F.slice("members", 2, F.size("members") - 1)).alias("own"))
        .filter(F.col("best.r") <= F.col("own.r") * ratio)
        .groupBy(*within, F.col("own.code").alias(column))
        .agg(F.min("best").alias("best"))
        .select(*within, column, F.col("best.code").alias("corrected"))
    )


def _code_sizes(mols: DataFrame, column: str, within: list[str]) -> DataFrame:
    return mols.groupBy(*within, column).agg(F.sum("reads").alias("n"))


def de_novo_corrections(mols: DataFrame, column: str, within: list[str], ratio: float) -> DataFrame:
    """(within.., column, corrected): rare codes and the strongest neighbour holding `ratio` times their reads.

    Codes one substitution apart are equal once the position is blanked. The codes that share a blanked form differ
    in one letter, so such a group holds no more codes than there are letters, whatever the data. One hop: a code
    moves to the neighbour as it was counted before any move.
    """
    sizes = stage(_code_sizes(mols, column, within), "sizes")
    n, key = F.col("n"), Window.partitionBy(*within, "key")
    parted = _parted(sizes, within, column, sizes.count()).withColumns({"most": F.max("n").over(key), "least": F.min("n").over(key)})
    # codes that differ too little from all that share their key neither move nor are moved onto
    able = parted.filter((F.col("most") >= n * ratio) | (n >= F.col("least") * ratio))
    member = F.struct((-n).alias("r"), F.col(column).alias("code"))
    groups = (
        able.select(*within, "key", member.alias("member"), F.explode(_part_masks(column)).alias("m"))
        .groupBy(*within, "key", F.col("m.mask").alias("mask"))
        .agg(F.array_sort(F.collect_list("member")).alias("members"))
        .filter(F.size("members") > 1)
    )
    return _strongest(groups, within, column, ratio)


def strongest_ancestor(moves: DataFrame, within: list[str], column: str) -> DataFrame:
    """The moves with `corrected` the end of each code's chain: the code that itself moves no further.

    A code moves only to one with more reads, so chains end. Pointer jumping: each turn replaces a target by the
    target's own target, which halves the chains, and is a written table. Codes that no one moves onto are never looked
    up as targets, so the joins are on codes, of which a cell or molecule has one row each.
    """
    while True:
        on = moves.select(*within, F.col(column).alias("corrected"), F.col("corrected").alias("next"))
        jumped = stage(moves.join(on, [*within, "corrected"], "left"), "moves")
        if jumped.filter("next is not null").isEmpty():
            return moves
        moves = jumped.select(*within, column, F.coalesce("next", "corrected").alias("corrected"))


def correct_de_novo(mols: DataFrame, column: str = "CELL", ratio: float = 2.0, chained: bool = False) -> DataFrame:
    """Molecules with rare codes of `column` merged onto a frequent neighbour.

    CELL is corrected within its sample, UMI within its sample, cell and feature. With `chained`, a code follows its
    neighbour when that moves as well, up to the code that stays: a cluster may then reach over several substitutions.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, or two equal codes would each move onto the other")
    within = {"CELL": ["sampleId"], "UMI": ["sampleId", "CELL", "FEATURE"]}[column]
    if column == "UMI" and not chained:
        return _corrected_in_place(mols, column, within, ratio)
    return _corrected_by_moves(mols, column, within, ratio, chained)


def _corrected_by_moves(mols: DataFrame, column: str, within: list[str], ratio: float, chained: bool = False) -> DataFrame:
    """Moves are written first; then only molecules whose code may move meet them."""
    moves = stage(de_novo_corrections(mols, column, within, ratio), "moves")
    if chained:
        moves = strongest_ancestor(moves, within, column)
    moved = joins.sparse_join(mols, moves, [*within, column])
    return merge_molecules(moved.withColumn(column, F.coalesce("corrected", column)).drop("corrected"))


def _corrected_in_place(mols: DataFrame, column: str, within: list[str], ratio: float) -> DataFrame:
    """One shuffle by `within`: the codes of a group are counted, compared, moved and added up in one task.

    Groups that may hold too many codes for a task are told by how many molecules share a slot of their hash; theirs are
    corrected by written moves, which no group makes uneven.
    """
    slot = F.pmod(F.xxhash64(*within), F.lit(SLOTS)).cast("int")
    rows = {r[0]: r[1] for r in mols.groupBy(slot.alias("slot")).count().collect()}
    limit = max(joins.HOT_ROWS, 4 * sum(rows.values()) // SLOTS)
    hot = [k for k, n in rows.items() if n > limit]
    if not hot:
        return _moved_in_place(mols, column, within, ratio, sum(rows.values()))
    cold = _moved_in_place(mols.filter(~slot.isin(hot)), column, within, ratio, sum(rows.values()))
    return cold.unionByName(_corrected_by_moves(mols.filter(slot.isin(hot)), column, within, ratio))


def _moved_in_place(mols: DataFrame, column: str, within: list[str], ratio: float, rows: int) -> DataFrame:
    own, code, totals = F.col("reads"), F.col(column), [F.sum(c).alias(c) for c in ("reads", "weight")]
    codes = _dealt(mols, within, rows).groupBy(*within, column).agg(*totals)
    group = Window.partitionBy(*within)
    codes = codes.withColumns({"most": F.max("reads").over(group), "least": F.min("reads").over(group)})
    # a null names no group, as it would meet nothing in a join
    able = (F.col("most") >= own * ratio) | (own >= F.col("least") * ratio)
    for c in within:
        able = able & F.col(c).isNotNull()
    masked = codes.select(*MOLECULE, "reads", "weight", F.explode_outer(F.when(able, _masks(code, 1))).alias("mask"))
    shared = Window.partitionBy(*within, "mask").orderBy(F.desc("reads"), column)
    strongest = F.struct((-F.first("reads").over(shared)).alias("r"), F.first(column).over(shared).alias("code"))
    best = masked.withColumn("best", strongest).withColumn("best", F.when(F.col("mask").isNotNull() & (F.col("best.r") <= -own * ratio), F.col("best")))
    moved = best.groupBy(*within, column, "reads", "weight").agg(F.min("best").alias("best"))
    return moved.withColumn(column, F.coalesce("best.code", column)).groupBy(*within, column).agg(*totals).select(*MOLECULE, "reads", "weight")


def merge_molecules(mols: DataFrame) -> DataFrame:
    """Equal molecules added up again after their codes have moved."""
    return mols.groupBy(*MOLECULE).agg(F.sum("reads").alias("reads"), F.sum("weight").alias("weight"))


def tag_stat(mols: DataFrame) -> DataFrame:
    """(sampleId, CELL, FEATURE, count, totalWeight, unique_UMI). A molecule is one row, so counting rows is exact."""
    return mols.groupBy("sampleId", "CELL", "FEATURE").agg(
        F.sum("reads").cast("bigint").alias("count"),
        F.sum("weight").cast("bigint").alias("totalWeight"),
        F.count(F.lit(1)).alias("unique_UMI"),
    )


def raw_feature_stat(mols: DataFrame) -> DataFrame:
    """(sampleId, FEATURE, count, totalWeight) before any correction."""
    return mols.groupBy("sampleId", "FEATURE").agg(
        F.sum("reads").cast("bigint").alias("count"), F.sum("weight").cast("bigint").alias("totalWeight")
    )


def refine_report(steps: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(sampleId, tagName, inputCount, outputCount) from each step's molecules before and after it."""
    out = None
    for tag, before, after in steps:
        went_in = before.groupBy("sampleId").agg(F.sum("reads").cast("bigint").alias("inputCount"))
        came_out = after.groupBy("sampleId").agg(F.sum("reads").cast("bigint").alias("outputCount"))
        step = went_in.join(came_out, "sampleId", "left").select(
            "sampleId", F.lit(tag).alias("tagName"), "inputCount", F.coalesce("outputCount", F.lit(0)).alias("outputCount")
        )
        out = step if out is None else out.unionByName(step)
    return out


def read_recovery(read_qc: DataFrame) -> DataFrame:
    """(sampleId, segment, reads, share): where a sample's reads went; a segment without reads is left out."""
    total, matched = F.col("readsTotal"), F.coalesce(F.col("readsMatched"), F.lit(0))
    known = F.col("panelAssignedFraction").isNotNull()
    assigned = F.when(known, F.round(matched * F.col("panelAssignedFraction"), 0)).otherwise(matched)
    parts = F.array(
        F.struct(F.when(known, "Panel-assigned").otherwise("Matched").alias("segment"), assigned.cast("double").alias("reads")),
        F.struct(
            F.lit("Not assigned").alias("segment"),
            F.when(known, F.greatest(F.lit(0.0), matched - assigned)).otherwise(F.lit(0.0)).cast("double").alias("reads"),
        ),
        F.struct(F.lit("No pattern match").alias("segment"), F.greatest(F.lit(0.0), total - matched).cast("double").alias("reads")),
    )
    return (
        read_qc.filter(total > 0)
        .select("sampleId", total.alias("_total"), F.explode(parts).alias("p"))
        .filter("p.reads > 0")
        .select("sampleId", "p.segment", F.col("p.reads").cast("bigint").alias("reads"), (F.col("p.reads") / F.col("_total")).alias("share"))
    )
