"""Mixing sources to target weights by Pareto order sampling.

A source that the mix takes r times over gets its whole copies for certain; the rest of its target is a sample without
replacement. Each document has a random number u, made of its content, and an inclusion probability p: that share of the
source which is still wanted, and zero for a document longer than all that is wanted. Documents are taken in order of
(u / (1 - u)) / (p / (1 - p)) until the wanted size is full, so the sample's size is fixed and the probabilities differ
by source and document. One more document, the one that fits best what is left, then closes the gap.

A source may hold a third of all documents: they are summed by slices of the order first, the running sum goes over the
slices, and documents are sorted only within the slice in which it passes the wanted size. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import lookup
from ..sources.sinks import stage
from .rows import pick

WEIGHTS, PERCENT, MOST_COPIES = (5, 2, 1), 150, 2
#: Slices of the order within a source.
SLICES = 1 << 12
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, u, row): u in [0, 1) is the same in every run; `row` numbers the rows of this table."""
    rows = pick(docs, "doc_id", "source", "text")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    return rows.select("doc_id", "source", size.alias("size"), u.alias("u")).withColumn("row", F.monotonically_increasing_id())


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of each source.

    Sources in order of their code points, null last, weigh `weights`, over and over. They share `percent` of all sizes
    by weight; a target stops at `most` times its source's size and the excess goes to the others by weight. So sources
    stop in order of size by weight, and the first k stop where the k-th would exceed what is left for it. One row a
    source, so the two windows over all sources see no documents.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighed = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    order = [(F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last()]
    before, everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # all sums a hundredfold, so that they stay whole numbers
    left = percent * F.sum("source_size").over(everything) - F.coalesce(100 * most * F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    steps = weighed.withColumns({"left": left, "weight_left": weight_left})
    steps = steps.withColumn("stops", F.col("left") * F.col("weight") > 100 * most * F.col("source_size") * F.col("weight_left"))
    # the first source that doesn't stop, before which the most weight is left, says what a unit of weight gets
    unit = F.max(F.when(~F.col("stops"), F.struct("weight_left", "left"))).over(everything)
    share = F.col("weight") * unit["left"] / (100 * unit["weight_left"])
    target = F.when(F.col("stops"), F.lit(float(most)) * F.col("source_size")).otherwise(share)
    return steps.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def ratio(u: Column, p: Column) -> Column:
    """The ranking number between 0 and 1: q / (1 + q) of the random odds q divided by the inclusion odds."""
    q = (u * (1 - p)) / ((1 - u) * p)
    return q / (1 + q)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST_COPIES, slices: int = SLICES) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    Null and empty texts have size zero and nothing taken. Null sources are one source, the last. Rows that repeat id
    and text share their random number, and are taken in any order among themselves, so the result's rows are the same. A source
    without words has the target zero. Where only longer documents than wanted are left, one is taken if that comes nearer.
    """
    rows = stage(sized(docs), "sizes")
    key = lambda df: df.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    goals = key(stage(targets(rows, weights, percent, most), "targets"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("copies", whole).withColumn("wanted", F.col("target") - F.col("copies") * F.col("source_size"))
    marked = lookup(key(rows), goals.drop("source"), ["key"], "inner")
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("wanted"))
    eligible = stage(marked.filter(fits).groupBy("key").agg(F.sum("size").alias("eligible")), "eligible")
    chance = lookup(marked, eligible, ["key"], "left").withColumn("p", F.when(fits, F.least(F.lit(1.0), F.col("wanted") / F.col("eligible"))).otherwise(0.0))
    ranked = stage(chance.withColumn("at", F.when(F.col("p") > 0, ratio(F.col("u"), F.col("p")))), "ranked")

    # where the running sum of sizes passes what is wanted: first by slices, then within the one slice
    ordered = ranked.filter("at is not null").withColumn("slice", F.least(F.floor(F.col("at") * slices), F.lit(slices - 1)).cast("int"))
    sums = ordered.groupBy("key", "slice").agg(F.sum("size").alias("n"), F.first("wanted").alias("wanted"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("slice")))
    edge = upto.filter(F.col("upto") > F.col("wanted")).groupBy("key").agg(F.min(F.struct("slice", (F.col("upto") - F.col("n")).alias("before"))).alias("edge"))
    edge = stage(edge.select("key", F.col("edge.slice").alias("edge"), F.col("edge.before").alias("before")), "edges")
    placed = lookup(ordered, edge, ["key"], "left")
    within = placed.filter("slice = edge").withColumn("upto", F.sum("size").over(Window.partitionBy("key").orderBy("at", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)))
    picked = within.filter(F.col("before") + F.col("upto") <= F.col("wanted")).select("row")
    chosen = placed.filter("edge is null or slice < edge").select("row").unionByName(picked)
    sample = stage(ranked.join(chosen.withColumn("one", F.lit(1)), "row", "left").withColumn("chosen", F.coalesce("one", F.lit(0))).drop("one"), "sample")

    # the document not yet chosen that comes nearest to what is left
    gaps = sample.groupBy("key").agg((F.first("wanted") - F.sum(F.col("size") * F.col("chosen"))).alias("gap"))
    off = F.abs(F.col("gap") - F.col("size"))
    near = lookup(sample.filter("chosen = 0 and size > 0 and wanted > 0"), stage(gaps, "gaps"), ["key"], "inner").filter(off < F.col("gap"))
    best = near.groupBy("key").agg(F.min(F.struct(off.alias("off"), F.coalesce("at", "u").alias("at"), "doc_id", "size", "row")).alias("best"))
    closed = lookup(sample, stage(best.select("key", F.col("best.row").alias("closing")), "closing"), ["key"], "left")
    times = F.col("copies") + F.col("chosen") + F.coalesce((F.col("row") == F.col("closing")).cast("int"), F.lit(0))
    return closed.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))
