"""Near copies by the share of word shingles that two texts have in common, as links for `simhash`.

Fingerprints within two bits find few of them: a text with one word in fifty changed is three to eleven bits away. Here
each distinct set of five-word shingles has 60 minimum hashes in 20 bands of three. Sets that share a band are a
candidate pair, and the sets themselves decide. A pair of a similarity of 0.8 shares no band once in 1.7 million times.

A band shared by more than `crowd` sets first links its members to the one that is in the largest bands. Only members that
this leaves in different components are compared further. Of these, sets with a rare shingle in common are paired by it;
the others have at most the lesser number of shingles in common that many share, which rules out most pairs by four
numbers, exactly. Members with the fewest rare shingles are compared with their band before all the rest is. So no pair
is left out, and copies that are too far apart for a link are not expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import lookup, salted_join, shuffled_join, skewed_join, top_per_group
from ..sources.sinks import stage
from .collocations import bitmap
from .rows import pick, slices, whole_text
from .simhash import SEED, components, fingerprint

WIDTH, PERCENT = 5, 80
BANDS, ROWS = 20, 3
#: Small, since a pair costs the shingles of a text: beyond it a band pairs its members with one of them first.
CROWD = 3
#: Members that a band of several components is compared with before all others are.
CENTRES = 3
#: Sets that may have a shingle which is paired by; more only share it, and the sizes of what they share decide.
RARE = 8
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, BANDS * ROWS, 1), dtype=np.uint64)
_FLIP, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; one of all words where it has fewer."""
    words = text.lower().split()
    k = min(width, len(words))
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1 if k else 0)}
    return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))


def bands(hashes: np.ndarray) -> list[int]:
    """A number for each band: the hash of its three minima, signed."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[None, at : at + 4096] ^ _FLIP) * _TIMES).min(axis=1))
    digests = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(digests, dtype=np.uint64).view(np.int64).tolist()


def _set_name(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketched(texts: DataFrame, width: int) -> DataFrame:
    """(set, fp, n, bands) of each row of `texts` that has words: its set of shingles by digest, and the set's size."""

    def run(batches):
        for batch in slices(batches, "text"):
            rows = []
            for t in batch.column("text").to_pylist():
                hashes = shingles(t)
                if len(hashes):
                    rows.append((_set_name(hashes), np.uint64(fingerprint(t, width)).astype(np.int64), len(hashes), bands(hashes)))
            columns = zip(*rows) if rows else ((), (), (), ())
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["set", "fp", "n", "bands"])

    return texts.mapInArrow(run, "set binary, fp bigint, n bigint, bands array<bigint>")


def members(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(set, hashes) of the sets `asked` for, of each once, and now and then of another."""
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap(asked.select(F.xxhash64("set").alias("h"))))

    def run(batches):
        given = set()
        for batch in slices(batches, "text", 4 << 20):
            found = {_set_name(h): h for h in map(shingles, batch.column("text").to_pylist()) if len(h)}
            names = [s for s in found if s not in given]
            here = wanted.value.holds(np.array([xxhash.xxh64_intdigest(s, SEED) for s in names], dtype=np.uint64))
            names = [s for s, is_held in zip(names, here.tolist()) if is_held]
            given.update(names)
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array([found[s].view(np.int64) for s in names], pa.list_(pa.int64()))], names=["set", "hashes"])

    return texts.mapInArrow(run, "set binary, hashes array<bigint>").groupBy("set").agg(F.first("hashes").alias("hashes"))


def _sized(percent: int, common: Column) -> Column:
    """Can sets of these sizes, with at most `common` shingles in both, be as similar?"""
    return 100 * common >= percent * (F.col("na") + F.col("nb") - common)


def _mixed(rows: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of bands with members in several components over the links `near`, with their component as `root` and the one
    that most members of the band are in as `largest`."""
    found = stage(components(near).toDF("set", "root"), "roots")
    rooted = stage(shuffled_join(rows, found, ["set"], "left").withColumn("root", F.coalesce("root", "set")), "rooted")
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("size", "root")).alias("largest"))
    return stage(lookup(rooted, stage(largest.filter("roots > 1").drop("roots"), "largest"), ["key"], "inner"), "mixed")


def _met(some: DataFrame, rows: DataFrame, percent: int, join) -> DataFrame:
    """Pairs of `some` members of bands with those of other components there whose common shingles `v` allow a link."""
    one = some.select("key", F.col("set").alias("a"), F.col("n").alias("na"), F.col("v").alias("va"), F.col("root").alias("ra"))
    other = rows.select("key", F.col("set").alias("b"), F.col("n").alias("nb"), F.col("v").alias("vb"), F.col("root").alias("rb"))
    met = join(other, one, ["key"], "inner") if join is lookup else join(one, other, ["key"], "inner")
    return met.filter("ra <> rb").filter(_sized(percent, F.least("va", "vb"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _by_rare(rows: DataFrame, hashes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(set, v) of each set of `rows`, with the number of its shingles that more than RARE of them have, and the pairs (a, b) with
    a rarer shingle in common that can be as similar. Sets without such a shingle in common have at most the lesser v."""
    asked = stage(rows.select("set", "n", "root").distinct().withColumn("id", F.monotonically_increasing_id()), "asked")
    each = shuffled_join(hashes, asked.select("set", "id"), ["set"]).select("id", F.explode("hashes").alias("h"))
    few = each.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") <= RARE).select("h")
    rare = stage(shuffled_join(each, few, ["h"]).select("h", "id"), "rare")
    held = shuffled_join(asked, rare.groupBy("id").agg(F.count("*").alias("u")), ["id"], "left")
    held = stage(held.select("id", "set", "n", "root", (F.col("n") - F.coalesce("u", F.lit(0))).alias("v")), "common")
    met = shuffled_join(rare.toDF("h", "x"), rare.toDF("h", "y"), ["h"]).filter("x < y").groupBy("x", "y").agg(F.count("*").alias("c"))
    met = shuffled_join(shuffled_join(met, held.toDF("x", "a", "na", "ra", "va"), ["x"]), held.toDF("y", "b", "nb", "rb", "vb"), ["y"])
    met = met.filter("ra <> rb").filter(_sized(percent, F.least("va", "vb") + F.col("c")))
    return held.select("set", "v"), met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose common shingles are at least `percent` of all that the two have."""
    pairs = stage(pairs.select("a", "b").distinct(), "pairs")
    one = skewed_join(pairs, sets.toDF("a", "ha"), ["a"], "inner")
    both = skewed_join(one, sets.toDF("b", "hb"), ["b"], "inner").withColumn("c", F.size(F.array_intersect("ha", "hb")))
    return stage(both.filter(100 * F.col("c") >= percent * (F.size("ha") + F.size("hb") - F.col("c"))).select("a", "b"), "verified")


def _numbered(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of sets as pairs of their least fingerprints."""
    first = sets.select(F.col("set").alias("a"), F.col("fp").alias("fa"))
    found = salted_join(salted_join(pairs, first, ["a"], "inner"), first.toDF("b", "fb"), ["b"], "inner")
    return found.select(F.col("fa").alias("a"), F.col("fb").alias("b"))


def links(docs: DataFrame, percent: int = PERCENT, crowd: int = CROWD, width: int = 3, text_column: str = "text") -> DataFrame:
    """(a, b): links between fingerprints (of `width` words) of texts whose sets of five-word shingles have a Jaccard
    similarity of at least `percent`, enough to connect all that do. Texts without words have none."""
    texts = pick(docs, text_column).toDF("text").select(whole_text().alias("text"))
    prints = stage(sketched(texts, width).groupBy("set", "fp").agg(F.first("n").alias("n"), F.first("bands").alias("bands")), "sketches")
    sets = stage(prints.groupBy("set").agg(F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")), "shingle_sets")
    equal = salted_join(prints.select("set", F.col("fp").alias("b")), sets.select("set", F.col("fp").alias("a")), ["set"], "inner").filter("a <> b").select("a", "b")

    indexed = sets.select("set", "n", F.explode("bands").alias("key"))
    shared = stage(indexed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "shared_bands")
    held = stage(lookup(indexed, shared, ["key"], "inner"), "held_bands")
    hashes = stage(members(texts, held.select("set").distinct()), "sets")
    few, many = held.filter(F.col("size") <= crowd).drop("size"), held.filter(F.col("size") > crowd)
    paired = few.toDF("a", "na", "key").join(few.toDF("b", "nb", "key"), "key").filter("a < b")
    many = stage(many.withColumn("weight", F.sum("size").over(Window.partitionBy("set"))), "crowds")  # a row a band
    centre = many.groupBy("key").agg(F.max(F.struct("weight", "set", "n")).alias("c")).select("key", F.col("c.set").alias("a"), F.col("c.n").alias("na"))
    star = lookup(many.select(F.col("set").alias("b"), F.col("n").alias("nb"), "key"), centre, ["key"], "inner").filter("a <> b")
    pairs = paired.select("a", "b", "na", "nb").unionByName(star.select("a", "b", "na", "nb"))
    near = _verified(pairs.filter(_sized(percent, F.least("na", "nb"))), hashes, percent)
    if many.limit(1).count():
        mixed = _mixed(many.select("key", "set", "n"), near)
        common, pairs = _by_rare(mixed, hashes, percent)
        left = shuffled_join(mixed.drop("largest"), common, ["set"]).filter(100 * F.col("v") >= percent * F.col("n"))
        # those with the fewest rare shingles are near most of what anything is near
        centres = top_per_group(left, ["key"], [F.col("n") - F.col("v"), F.col("set")], CENTRES)
        near = near.unionByName(_verified(pairs.unionByName(_met(centres, left, percent, lookup)), hashes, percent))
        left = _mixed(left.drop("root"), near)
        near = near.unionByName(_verified(_met(left.filter("root <> largest"), left, percent, salted_join), hashes, percent))
    return stage(equal.unionByName(_numbered(sets, near)).distinct(), "near_links")
