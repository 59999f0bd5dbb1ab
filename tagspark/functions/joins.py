"""Joins and per-group picks that stay safe when one key holds a large share of the rows.

A side is broadcast only after its size is known. Past the bound the same lookup runs as a salted shuffle
join, so a hot key is spread over several tasks and the result is the same.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stage

BROADCAST_ROWS = 200_000
SALTS = 16
HOT_ROWS = 100_000
TASK_ROWS = 250_000


def fits(side: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether `side` holds at most `limit` rows. Reads no further than one row past the limit."""
    return side.limit(limit + 1).count() <= limit


def spread(df: DataFrame, salts: int = SALTS):
    """A repeatable salt: a retried task must place a row where the first attempt did."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int")


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """`df` dealt by `keys` over a task for every TASK_ROWS of `rows`, so that a task stays as small as the tables grow.
    The number is a power of two, so that tables of about as many rows meet without being dealt again.

    Left alone, Spark merges what it shuffled into tasks of a size in compressed bytes, which are a small part of what
    sorts and groups of narrow rows take. Tables of fewer tasks than it would use are left to it.
    """
    tasks = _tasks(df, rows)
    return df.repartition(tasks, *keys) if tasks else df


def _tasks(df: DataFrame, rows: int) -> int:
    """How many tasks `rows` are dealt over; 0 where they are left to Spark."""
    session = df.sparkSession
    tasks = 1 << max(0, (rows - 1) // TASK_ROWS).bit_length()
    alone = min(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return tasks if tasks > alone else 0


def added_up(df: DataFrame, keys: list[str], sums: list[str], by: list[str], rows: int, salts: int = SALTS) -> DataFrame:
    """(keys, sums) of `df`, dealt by the keys `by` as `dealt` does, so that what follows by them needs no further shuffle.

    A key may hold a large share of the rows. These are first added up in slots, for which all columns of `df` count.
    """
    totals = [F.sum(c).alias(c) for c in sums]
    tasks = _tasks(df, rows)
    if not tasks:
        return df.groupBy(*keys).agg(*totals)
    parts = df.withColumn("_slot", spread(df, salts)).repartition(tasks, *by, "_slot").groupBy(*keys, "_slot").agg(*totals)
    return parts.repartition(tasks, *by).groupBy(*keys).agg(*totals)


def salted_join(big: DataFrame, side: DataFrame, on: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi-join with the keys of `big` spread over `salts` slots and `side` copied into each slot.

    Both sides are shuffled. Spark guesses a side's size from its compressed files, before it is copied into the slots,
    and would send what it takes for a small one through the driver.
    """
    left = big.withColumn("_salt", spread(big, salts))
    right = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return shuffled_join(left, right, [*on, "_salt"], how).drop("_salt")


def shuffled_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that never broadcasts a side: for two tables that both grow with the input."""
    return left.join(right.hint("merge"), on, how)


def keyed_join(left: DataFrame, side: DataFrame, condition) -> DataFrame:
    """Inner equi-join with a table of keys: broadcast once it was counted, shuffled where it grows past the bound.

    Spark would judge it by its files, which repeated and rising keys keep small, and take it through the driver.
    """
    return left.join(side.hint("broadcast" if fits(side) else "merge"), condition)


def skewed_join(big: DataFrame, side: DataFrame, on: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """`salted_join` for a side too large to copy: only keys with over HOT_ROWS rows of `big` are spread over slots.

    There are at most rows / HOT_ROWS such keys. Rows with a null key meet nothing and are spread as well.
    """
    hot = stage(big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS).select(*on, F.lit(True).alias("_hot")), "hot")
    small, null = fits(hot), F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    marked = big.join(F.broadcast(hot), on, "left") if small else shuffled_join(big, hot, on, "left")
    left = marked.select(*big.columns, F.when(F.coalesce("_hot", F.lit(False)) | null, spread(big, salts)).otherwise(F.lit(0)).alias("_salt"))
    copied = side.join(F.broadcast(hot), on, "left") if small else shuffled_join(side, hot, on, "left")
    slots = F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0)))
    right = copied.select(*side.columns, F.explode(slots).alias("_salt"))
    return shuffled_join(left, right, [*on, "_salt"], how).drop("_salt")


def sparse_join(big: DataFrame, side: DataFrame, on: list[str], salts: int = SALTS) -> DataFrame:
    """Left join with a written `side` that few rows of `big` meet: the others are told by bits of the side's keys, and not shuffled.

    The bits, at most 8 MB, are broadcast; a row that meets one by chance is joined like those that meet a key.
    """
    words, gained = 8, [f for f in side.schema if f.name not in on]
    chunks = 1 << min(17, max(0, side.count() * 16 // (64 * words)).bit_length())
    at = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in on]), F.lit(chunks * 64 * words))
    chunk, word, bit = F.shiftright(at, 9), F.shiftright(at, 6).bitwiseAND(F.lit(words - 1)), at.bitwiseAND(F.lit(63)).cast("int")
    held = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    bits = side.groupBy(chunk.alias("_chunk")).agg(*[F.bit_or(F.when(word == w, held)).alias(f"_w{w}") for w in range(words)])
    own = F.coalesce(*[F.when(word == w, F.col(f"_w{w}")) for w in range(words)], F.lit(0).cast("bigint"))
    met = own.bitwiseAND(held) != 0
    marked = big.withColumn("_chunk", chunk).join(F.broadcast(bits), "_chunk", "left").select(*big.columns, met.alias("_met"))
    joined = skewed_join(marked.filter("_met").drop("_met"), side, on, "left", salts)
    others = marked.filter("not _met").select(*big.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in gained])
    return joined.select(*others.columns).unionByName(others)


def lookup(
    big: DataFrame, side: DataFrame, on: list[str], how: str = "left", small: bool | None = None
) -> DataFrame:
    """Join `big` to a lookup table: broadcast where the table is known to be small, salted otherwise."""
    if fits(side) if small is None else small:
        joined = big.join(F.broadcast(side), on, how)
    else:
        joined = salted_join(big, side, on, how)
    gained = [] if how in ("left_semi", "left_anti") else [c for c in side.columns if c not in on]
    return joined.select(*[F.col(f"`{c}`") for c in [*big.columns, *gained]])


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, salts: int = SALTS) -> DataFrame:
    """The first `k` rows of each group. Each salt slot keeps its own first `k`, so no task sorts a whole hot group."""
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", spread(df, salts))
        .withColumn("_rank", F.row_number().over(local))
        .filter(F.col("_rank") <= k)
        .withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= k)
        .drop("_salt", "_rank")
    )


def group_percentile(df: DataFrame, keys: list[str], value: str, at, out: str, weight: str | None = None) -> DataFrame:
    """Exact interpolated percentile per group, taken over distinct values with their multiplicity.

    Counting equal values first leaves one row per distinct value, so a group of any size reaches the final
    task as a histogram.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("_n"))
    return hist.groupBy(*keys).agg(F.percentile(value, at, F.col("_n")).alias(out))
