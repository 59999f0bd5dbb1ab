"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. Two that differ in at most two bits agree up to one bit in one of their two halves, so
they share a half with the same bit taken out. Every distinct fingerprint is indexed under its 64 one-wildcard half
signatures; an equality join on the signature proposes pairs and the whole distance decides.

A signature shared by more than `crowd` fingerprints proposes no pairs. Its members are indexed instead by the
points at distance 0 or 1 from them: two fingerprints are within two bits exactly when they share such a point, and
a point has at most 65 fingerprints around it, so each is linked to the least of its point. No link is lost and no
group of copies is expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import lookup
from ..sources.sinks import stage
from .rows import pick, slices, whole_text

BITS, HALF, DISTANCE = 64, 32, 2
SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of a text's word shingles: a bit is set where over half the shingle hashes have it."""
    words = text.lower().split()  # bytes: A-Z alone are lowered, and white space is ASCII's
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    ones, count, block = np.zeros(BITS, dtype=np.int64), 0, []

    def add(block):
        bits = np.unpackbits(np.array(block, dtype="<u8").view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little")
        return bits.sum(axis=0, dtype=np.int64)

    for a, b in spans:
        block.append(digest(joined[a:b], SEED))
        if len(block) == 65536:
            ones, count, block = ones + add(block), count + len(block), []
    if block:
        ones, count = ones + add(block), count + len(block)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed 64-bit number. No words, or null: zero."""

    def run(batches):
        for batch in slices(batches, "text"):
            found = [fingerprint(t, width) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    source = pick(docs, id_column, text_column).toDF("doc_id", "text")
    return source.select("doc_id", whole_text().alias("text")).mapInArrow(run, source.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def signatures(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard half signatures of each fingerprint. A key holds half, bit and the other bits."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", HALF)
    keys = []
    for half, value in enumerate((low, high)):
        for bit in range(HALF):
            rest = value.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit)))
            keys.append(rest.bitwiseOR(F.lit((half * HALF + bit) << HALF)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def signature_links(fps: DataFrame, crowd: int) -> DataFrame:
    """(a, b): links among distinct fingerprints that differ in one or two bits, enough to connect all that do."""
    indexed = signatures(fps)
    shared = stage(
        indexed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "shared"
    )
    pairs = shared.filter("n = 2").select("a", "b")
    held = stage(lookup(indexed, shared.filter("n > 2").select("key", "n"), ["key"], "inner"), "held")
    few = held.filter(F.col("n") <= crowd)
    joined = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter("a < b").select("a", "b")
    verified = pairs.unionByName(joined).filter(differing("a", "b") <= DISTANCE).distinct()
    return verified.unionByName(midpoint_links(held.filter(F.col("n") > crowd).select("fp").distinct()))


def midpoint_links(fps: DataFrame) -> DataFrame:
    """The same links through the points around each fingerprint: each member of a point with the point's least."""
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << BITS if i == BITS - 1 else 0))) for i in range(BITS)]
    around = fps.select("fp", F.explode(F.array(*flips)).alias("point"))
    met = around.groupBy("point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    star = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return star.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches.

    Turns of hooking every neighbour to the least one around (larger neighbours, then smaller ones) until the edges
    form stars. A turn keeps at most as many edges as it got, and each turn is a written table.
    """
    edges = stage(edges.filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = lookup(both.filter("b > a"), least, ["a"], "inner")
        edges = stage(larger.select(F.col("m").alias("a"), "b").filter("a <> b").distinct(), "edges")
        up = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        hooked = lookup(up, least, ["u"], "inner").select(F.col("m").alias("a"), F.col("v").alias("b"))
        edges = stage(hooked.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct(), "edges")
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = state


def near_duplicates(docs: DataFrame, width: int = 3, crowd: int = 32, id_column: str = "doc_id", text_column: str = "text", links: DataFrame | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most two bits, and over `links`
    (a, b) of further fingerprints, such as those of `near_copies`. Null and empty
    texts have fingerprint zero and are linked like any other. Rows that repeat a doc_id are kept, each with its
    own text's fingerprint. A null doc_id is never smallest; its row joins its component, null if that has no id.
    """
    marked = stage(fingerprints(docs, width, id_column, text_column), "fingerprints")
    firsts = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    edges = signature_links(firsts.select("fp"), crowd)
    edges = edges if links is None else edges.unionByName(links)
    found = stage(components(edges).withColumnRenamed("node", "fp"), "components")
    linked = firsts.select("fp", "first").join(found, "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = lookup(linked, smallest, ["root"], "inner").select("fp", "component_id")
    repeated = firsts.filter("n > 1").join(found, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    several = stage(linked.unionByName(repeated), "several")
    placed = lookup(marked, several.withColumn("_met", F.lit(True)), ["fp"], "left")
    return placed.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("_met"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text", links: DataFrame | None = None) -> DataFrame:
    """Exactly one row of each component: that of the smallest doc_id, and of several such rows the one whose text has
    the least digest. Rows without a doc_id come last. Of rows that repeat id and text any one stays.
    """
    columns = docs.columns
    numbered = docs.toDF(*[f"_{i}" for i in range(len(columns))])  # any name may stand in the columns
    number, text = (F.col(f"_{columns.index(c)}") for c in (id_column, text_column))
    row = F.struct(number.isNull().alias("last"), number.alias("id"), F.coalesce(F.sha2(text, 256), F.lit("")).alias("text"))
    keyed = numbered.withColumn("row", row)
    groups = near_duplicates(keyed, width, id_column="row", text_column=f"_{columns.index(text_column)}", links=links)
    groups = groups.select(F.col("doc_id").alias("row"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first"))
    gone = stage(groups.filter("not first").select("row").distinct(), "copies")
    repeated = stage(groups.filter("first").groupBy("row").count().filter("count > 1").select("row"), "repeats")
    kept = lookup(keyed, gone, ["row"], "left_anti")
    if repeated.limit(1).count():
        each = F.struct(*numbered.columns)
        once = lookup(kept, repeated, ["row"], "left_semi").groupBy("row").agg(F.first(each).alias("each")).select("each.*")
        kept = lookup(kept, repeated, ["row"], "left_anti").drop("row").unionByName(once)
    return kept.drop("row").toDF(*columns)
